import hashlib
import random
import re
import sys
import tracemalloc
from collections import Counter, defaultdict
from pathlib import Path

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parent))
import fixtures as X  # noqa: E402

from lakeloom.llm import exact_dedup, line_dedup, ngram_join, quality, shingles  # noqa: E402
from lakeloom.llm.common import in_buckets, materialize  # noqa: E402
from lakeloom.llm.components import components  # noqa: E402

DOCS = X.documents()


def normal(text):
    return re.sub("[\x20\x09-\x0d]+", " ", text or "")


def test_exact_dedup_matches_brute_force(spark):
    got = {r.doc_id: r for r in exact_dedup.exact_dedup(X.frame(spark, DOCS)).collect()}
    groups = defaultdict(list)
    for i, t in DOCS:
        groups[normal(t)].append(i)
    for i, t in DOCS:
        same = groups[normal(t)]
        r = got[i]
        assert (r.keep_id, r.group_size, r.kept) == (min(same), len(same), i == min(same))
        assert bytes(r.digest).hex() == hashlib.sha256(normal(t).encode()).hexdigest()


def test_digest_index_remembers_batches(spark, tmp_path):
    index = exact_dedup.DigestIndex(spark, "digests_test", 4, str(tmp_path / "index"))
    index.ingest(spark.createDataFrame([(5, "a b"), (6, "c")], "doc_id long, text string")).collect()
    got = {r.doc_id: (r.keep_id, r.kept) for r in index.ingest(spark.createDataFrame([(1, "a  b"), (2, "d"), (3, "d"), (None, "e")], "doc_id long, text string")).collect()}
    assert got == {1: (5, False), 2: (2, True), 3: (2, False), None: (None, True)}
    plan = index.rows().join(index.rows().withColumnRenamed("keep_id", "k").hint("merge"), "digest")._jdf.queryExecution().toString()
    assert "Bucketed: true" in plan
    spark.sql("DROP TABLE digests_test")
    again = exact_dedup.DigestIndex(spark, "digests_again", 4, str(tmp_path / "index"))
    assert again.rows().count() == 4


def test_line_dedup_matches_brute_force(spark):
    rows = DOCS + [(20001, "  SHARED line of more than twenty  \nkeep me"), (20002, "shared line of more than twenty\n\nx"), (20003, "Shared Line of more than twenty\nshared line of more than twenty"), (20004, "not shared line of it all")]
    got = {r.doc_id: r for r in line_dedup.line_dedup(X.frame(spark, rows)).collect()}
    strip = " \t\n\x0b\x0c\r"
    key = lambda line: line.strip(strip).translate(X.LOWER)
    holders = defaultdict(set)
    for i, t in rows:
        for line in (t or "").split("\n"):
            if len(key(line)) >= 20:
                holders[key(line)].add(i)
    dropped = 0
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if len(holders[key(x)]) < 3 or max(holders[key(x)]) == i]
        assert (got[i].n_lines, got[i].n_dropped, got[i].kept_text) == (len(lines), len(lines) - len(kept), "\n".join(kept))
        dropped += len(lines) - len(kept)
    assert dropped > 2
    assert len(got) == len(rows)


def test_ngram_join_matches_brute_force(spark):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.ngram_join(X.frame(spark, DOCS)).collect()}
    assert got == X.components(DOCS)


def test_ngram_join_of_hard_groups(spark, monkeypatch):
    """Every list is long and every class is held apart, so that token groups and blocks do the work."""
    monkeypatch.setattr(ngram_join, "RARE", 1)
    monkeypatch.setattr(ngram_join, "LIST_BLOCK", 3)
    monkeypatch.setattr(ngram_join, "GROUP", 2)
    rows = X.documents(seed=4, n=90)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.ngram_join(X.frame(spark, rows)).collect()}
    assert got == X.components(rows)


def near_copies(n, seed=8):
    """A text in many versions; some pairs are similar and many are not."""
    rng = random.Random(seed)
    base = [f"b{k}" for k in range(150)]
    rows = []
    for i in range(n):
        w = list(base)
        for k in rng.sample(range(150), rng.choice([1, 2, 3, 3, 6, 12])):
            w[k] = f"x{rng.randrange(10**6)}"
        rows.append((i * 3 + 1, " ".join(w)))
    return rows


def test_ngram_join_tasks_hold_one_bucket_and_little_text(spark):
    rows = in_buckets(spark.range(400).selectExpr("id % 40 AS bucket", "id"), 40)
    held = rows.count().withColumn("task", F.spark_partition_id()).groupBy("task").count().collect()
    assert [r["count"] for r in held] == [1] * 40
    random.seed(5)
    texts = pa.array([" ".join(random.choices(["alpha", "Beta", "g", "delta\n"], k=700)) for _ in range(400)] + ["", "two words"])
    whole = shingles.shingles(*shingles.word_hashes(texts))
    shingles._powers.clear()
    tracemalloc.start()
    runs = shingles.text_shingles(texts[3:])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(runs) == 399 and all((a == b).all() and len(a) == len(b) for a, b in zip(runs, whole[3:]))
    assert peak < 15 * texts.nbytes


def test_ngram_join_opens_no_pairs_within_a_large_group(spark, monkeypatch):
    opened = []

    def watch(df, name, by=None):
        out = materialize(df, name, by)
        if name == "opened-pairs":
            opened.append(out.count())
        return out

    monkeypatch.setattr(ngram_join, "materialize", watch)
    rows = near_copies(400)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.ngram_join(X.frame(spark, rows)).collect()}
    assert got == X.components(rows)
    # every pair of similar ones would be some ten thousand
    assert opened[0] < len(rows)


def test_ngram_join_of_cut_hub_cells(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "HUB_TOKENS", 3000)
    monkeypatch.setattr(ngram_join, "HUBS", 2)
    rows = near_copies(120, seed=9) + [(i + 5000, t) for i, t in X.documents(seed=10, n=60)]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.ngram_join(X.frame(spark, rows)).collect()}
    assert got == X.components(rows)


def test_ngram_join_of_repeated_rows_and_null_ids(spark):
    rng = random.Random(6)
    rows = X.documents(seed=5, n=100)
    rows += [rows[i] for i in rng.sample(range(14, 100), 20)]  # repeated rows
    rows += [(rows[i][0], rows[j][1]) for i, j in zip(range(20, 30), range(60, 70))]  # one id, two texts
    rows += [(None, rows[i][1]) for i in range(30, 40)] + [(None, " ".join(f"q{k}" for k in range(40)))] * 3
    truth = X.components(list(enumerate(t for _, t in rows)))
    smallest = defaultdict(lambda: None)
    for at, (i, _) in enumerate(rows):
        root = truth[at][1]
        smallest[root] = min((x for x in (smallest[root], i) if x is not None), default=None)
    expected = Counter((i, truth[at][0], smallest[truth[at][1]] if truth[at][0] else i) for at, (i, _) in enumerate(rows))
    assert Counter(map(tuple, ngram_join.ngram_join(X.frame(spark, rows)).collect())) == expected
    with pytest.raises(ValueError):
        ngram_join.ngram_join(X.frame(spark, rows), percent=60)


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (101, 100)], "a long, b long")
    got = {r.node: r.root for r in components(edges).collect()}
    assert got == {**{i: 0 for i in range(1, 41)}, 101: 100}


def test_empty_tables(spark):
    none = X.frame(spark, [])
    assert exact_dedup.exact_dedup(none).count() == 0
    assert line_dedup.line_dedup(none).count() == 0
    assert ngram_join.ngram_join(none).count() == 0
    assert quality.quality_rules(none).count() == 0


def repeats(w):
    where = defaultdict(list)
    for i in range(len(w) - 2):
        where[tuple(w[i : i + 3])].append(i)
    return len({i + k for at in where.values() if len(at) > 1 for i in at for k in range(3)})


def test_quality_features_match_brute_force(spark):
    rows = DOCS + [(30000, "a a a a a a"), (30001, "#$ x|y <b> x\nx\n x\nx"), (30002, "p q r s p q r t p q")]
    got = {r.doc_id: r for r in quality.quality_rules(X.frame(spark, rows)).collect()}
    for i, t in rows:
        t = t or ""
        w = X.WORD.findall(t)
        worded = [x for x in t.split("\n") if X.WORD.search(x)]
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols) == (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t))
        assert (r.n_dup_lines, r.n_repeat_words) == (len(worded) - len(set(worded)), repeats(w))
        assert r.base_failed == (len(w) < 50 or 100 * repeats(w) > 50 * len(w))
        assert not (r.base_failed and r.kept)


def test_quality_model_finds_junk(spark):
    rows = []
    for i in range(60):
        w = [f"w{(i * 31 + k * 7) % 97}z" for k in range(80)]
        rows.append((i, " ".join(w) + "."))
        if i % 6 == 0:
            rows.append((1000 + i, " ".join(x + "$$$" for x in w)))
        if i % 6 == 1:
            rows.append((2000 + i, "!! ".join(w).upper()))
    got = {r.doc_id: r.kept for r in quality.quality_rules(X.frame(spark, rows)).collect()}
    assert all(kept == (i < 1000) for i, kept in got.items())


def test_quality_lets_estimated_accuracies_decide(spark):
    rng = random.Random(1)
    counts = Counter()
    for _ in range(10_000):
        bad = rng.random() < 0.1
        counts[tuple([-1 if rng.random() < (0.6 if bad else 0.02) else 1 for _ in range(6)] + [-1 if rng.random() < 0.08 else 1])] += 1
    classes = quality.expectation_maximisation(sorted(counts.items()))
    names = [f"v_{name}" for name, *_ in quality.RULES]
    rows = [(1,) * 7, (1,) * 6 + (-1,), (-1,) * 6 + (1,), (-1, -1, 1, 1, -1, 1, 1)]
    got = [r[0] for r in spark.createDataFrame(rows, ", ".join(f"{n} int" for n in names)).select(quality.posterior(classes)).collect()]
    # the last rule votes at random: alone it does not reject, as all-must-pass would; votes that go together do
    assert [g >= 0.5 for g in got] == [True, True, False, False]
