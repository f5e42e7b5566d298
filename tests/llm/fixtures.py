"""Small documents with every awkward case, and plain versions of the operators to compare with."""

import random
import re
import string

LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)
WORD = re.compile("[^\x20\x09-\x0d]+")


def documents(seed=1, n=120):
    """(doc_id, text) with exact and near copies, shared passages, nulls, empty, short and very long texts."""
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(1, 7))) for _ in range(400)]
    passage = " ".join(rng.choice(vocabulary) for _ in range(60))
    texts = [None, "", "   \t\n", "one", "One  two", "a b c d", "A B C D", "a b c d e", "x\ny\nx", "\n\n", "é ñ ß\u3000日本 😀", "tail  ", "  lead", "line one is long enough here\n" * 5]
    while len(texts) < n:
        kind = rng.random()
        base = " ".join(rng.choice(vocabulary) for _ in range(rng.choice([8, 30, 80, 200])))
        if kind < 0.3 and len(texts) > 20:
            words = (texts[rng.randrange(14, len(texts))] or "").split()
            for _ in range(rng.randint(0, max(1, len(words) // 25))):
                if words:
                    words[rng.randrange(len(words))] = rng.choice(vocabulary)
            base = " ".join(words)
        elif kind < 0.45:
            base += "\n" + passage
        elif kind < 0.55 and len(texts) > 20:
            base = texts[rng.randrange(14, len(texts))] or ""
            base = base.replace(" ", "  ", 1)
        base = "\n".join(base[i : i + 90] for i in range(0, len(base), 90)) if kind > 0.9 else base
        texts.append(base)
    texts.append(" ".join(rng.choice(vocabulary) for _ in range(20000)))
    ids = rng.sample(range(10_000), len(texts))
    return list(zip(ids, texts))


def frame(spark, rows):
    """Documents with other columns, one of them with a clashing name."""
    return spark.createDataFrame([(i, t, "en", None, 7) for i, t in rows], "doc_id long, text string, lang string, source string, digest int")


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def shingles(text, size=5):
    w = words(text)
    if not w:
        return set()
    return {tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))}


def components(rows, percent=75):
    sets = {i: shingles(t) for i, t in rows}
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for a in range(len(ids)):
        for b in ids[a + 1 :]:
            x, y = sets[ids[a]], sets[b]
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                p, q = sorted((find(ids[a]), find(b)))
                parent[q] = p
    return {i: (len(sets[i]), find(i)) for i in sets}
