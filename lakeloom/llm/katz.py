"""Katz backoff language model: fit on part of a corpus and score all of it.

N-grams back off order by order to unigrams, those to one unknown word.
Good-Turing discounts come from counts over all training documents, and backoff
weights are normalised exactly: what a history's seen words leave is spread over
the lower order's mass of the words it has not been seen with.

Texts are read once. Tasks cut them into chunks and number each chunk's words;
distinct words go to buckets by hash, where they are counted, and come back as
global numbers in order of falling count, so that a word's count can be told
from its number by a short step function.

A chunk's distinct n-grams of the highest order go to the bucket of the last
word of their history. All lower orders that they back off to end their history
in the same word, so a bucket counts, normalises and evaluates every order by
itself, and a text's probabilities are found recursively in one place. A word
that holds more than a bucket's share of all tokens is *hot*: its n-grams are
split by the word before it, over as many buckets as its share asks for, and
only its bigrams, which all of these need, are summed apart and sent to each.
N-grams and backoff weights are stored as tables partitioned by order. Scoring
goes in phases, each with its share of the buckets, so that what travels at a
time is a part of what the corpus asks for; a phase leaves a number for each
document.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lakeloom.llm.common import discard, materialize, partitions, release, small_batches
from lakeloom.llm.shingles import word_hashes

#: Words after which a task closes a chunk.
CHUNK = 1_000_000
#: Counts up to this one are discounted.
CUTOFF = 5
#: Parts in which texts are scored one after another.
PHASES = 4
#: The hash of the token that ends every document, and the number of the history before its first word.
END, BEGIN = np.uint64(0x5BD1E995E6546B64), np.uint32(2**32 - 1)


def pack(values: np.ndarray) -> bytes:
    """An array's bytes, compressed: most of what travels is small numbers."""
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(values).tobytes()) if len(values) else b""


def unpack(data: bytes, kind) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(data) if data else b"", kind)


def discounts(kinds: dict[int, int]) -> np.ndarray:
    """d[r] for r up to ``CUTOFF`` (d[0] unused), from the numbers of n-grams seen r times.

    Good-Turing in Katz's form. Where that gives no factor strictly between 0
    and 1, as it can in small corpora, absolute discounting stands in for all.
    """
    n = [0, *(kinds.get(r, 0) for r in range(1, CUTOFF + 2))]
    d = np.ones(CUTOFF + 1)
    if all(n[1:]):
        tail = (CUTOFF + 1) * n[CUTOFF + 1] / n[1]
        if tail != 1:
            for r in range(1, CUTOFF + 1):
                d[r] = ((r + 1) * n[r + 1] / (r * n[r]) - tail) / (1 - tail)
    if not all(n[1:]) or not ((d[1:] > 0) & (d[1:] < 1)).all():
        off = n[1] / (n[1] + 2 * n[2]) if n[1] and n[2] else 0.5
        d[1:] = 1 - off / np.arange(1, CUTOFF + 1)
    return d


class Unigrams:
    """Counts and probabilities of words by their number: words with equal counts have consecutive numbers."""

    def __init__(self, levels: list[tuple[int, int]]):
        levels = sorted(levels, reverse=True)
        self.counts = np.array([c for c, _ in levels], np.int64)
        sizes = np.array([n for _, n in levels], np.int64)
        self.starts = np.cumsum(sizes) - sizes
        known = self.counts > 0
        self.total = int((self.counts * sizes).sum())
        self.kinds, self.words = int(sizes[known].sum()), int(sizes.sum())
        d = discounts(dict(levels))
        factor = np.where(self.counts <= CUTOFF, d[np.minimum(self.counts, CUTOFF)], 1.0)
        p = factor * self.counts / max(self.total, 1)
        left = 1.0 - float((p * sizes)[known].sum())
        if left <= 1e-12:  # nothing was discounted
            p, left = p * (self.total / (self.total + 1)), 1 / (self.total + 1)
        self.p = np.where(known, p, left)

    def level(self, numbers: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.starts, numbers, "right") - 1


def _chunks(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    """kind 0: a chunk's documents and words, as places in its word list; kind 1: the part of that list in a bucket, with training counts."""
    names = ["kind", "chunk", "bucket", "docs", "held", "sizes", "words", "counts"]
    kinds = [pa.int32(), pa.int64(), pa.int32(), *[pa.binary()] * 5]
    chunk = TaskContext.get().partitionId() << 32
    docs: list[int] = []
    held: list[bool] = []
    sizes: list[np.ndarray] = []
    words: list[np.ndarray] = []
    gathered = 0

    def flush() -> Iterator[pa.RecordBatch]:
        all_words, lengths = np.concatenate(words), np.concatenate(sizes)
        distinct, places = np.unique(all_words, return_inverse=True)
        where = (distinct % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(where, kind="stable")
        rank = np.empty(len(order), np.uint32)
        rank[order] = np.arange(len(order), dtype=np.uint32)
        train = np.repeat(~np.array(held), lengths)
        counts = np.bincount(places[train], minlength=len(distinct)).astype(np.uint32)[order]
        distinct, cuts = distinct[order], np.searchsorted(where[order], np.arange(buckets + 1))
        rows = [(0, chunk, None, np.array(docs, np.int64), np.array(held), lengths.astype(np.int64), rank[places], None)]
        rows += [(1, chunk, b, None, None, None, distinct[cuts[b] : cuts[b + 1]], counts[cuts[b] : cuts[b + 1]]) for b in range(buckets) if cuts[b + 1] > cuts[b]]
        for row in rows:
            yield pa.RecordBatch.from_arrays([pa.array([pack(v) if isinstance(v, np.ndarray) else v], t) for v, t in zip(row, kinds)], names=names)

    for batch in batches:
        with np.errstate(over="ignore"):
            hashes, offsets = word_hashes(batch.column(2))
        n = np.diff(offsets)
        docs += [d if d is not None else -(2**63) for d in batch.column(0).to_pylist()]
        held += batch.column(1).to_pylist()
        sizes.append(n + 1)
        words.append(np.insert(hashes, offsets[1:], END))
        gathered += len(words[-1])
        if gathered >= CHUNK:
            yield from flush()
            chunk, gathered = chunk + 1, 0
            docs, held, sizes, words = [], [], [], []
    if docs:
        yield from flush()


CHUNKS = "kind int, chunk long, bucket int, docs binary, held binary, sizes binary, words binary, counts binary"


def _count_words(table: pa.Table) -> pa.Table:
    words = np.concatenate([unpack(x, np.uint64) for x in table.column("words").to_pylist()])
    counts = np.concatenate([unpack(x, np.uint32) for x in table.column("counts").to_pylist()])
    distinct, places = np.unique(words, return_inverse=True)
    sums = np.bincount(places, counts, len(distinct)).astype(np.int64)
    order = np.lexsort((distinct, -sums))
    distinct, sums = distinct[order], sums[order]
    levels, n = np.unique(sums, return_counts=True)
    return pa.table(
        [pa.array([table.column("bucket")[0].as_py()], pa.int32()), pa.array([pack(distinct)], pa.binary()), pa.array([levels.tolist()[::-1]], pa.list_(pa.int64())), pa.array([n.tolist()[::-1]], pa.list_(pa.int64()))],
        names=["bucket", "words", "levels", "level_sizes"],
    )


def _number_words(asked: pa.Table, known: pa.Table, starts: dict[int, int]) -> pa.Table:
    """Global numbers of each chunk's words in one bucket."""
    words = unpack(known.column("words")[0].as_py(), np.uint64)
    numbers = np.concatenate([starts[v] + shift + np.arange(n) for v, n, shift in zip(*(known.column(c)[0].as_py() for c in ("levels", "level_sizes", "shifts")))]).astype(np.uint32)
    order = np.argsort(words)
    words, numbers = words[order], numbers[order]
    out = [pack(numbers[np.searchsorted(words, unpack(x, np.uint64))]) for x in asked.column("words").to_pylist()]
    return pa.table([asked.column("chunk"), asked.column("bucket"), pa.array(out, pa.binary())], names=["chunk", "bucket", "numbers"])


def _renumber(docs: pa.Table, parts: pa.Table) -> pa.Table:
    """A chunk's documents: the global numbers of its words, rising, and each token as a place in that list."""
    order = np.argsort(parts.column("bucket").to_numpy())
    blobs = parts.column("numbers").to_pylist()
    numbers = np.concatenate([unpack(blobs[i], np.uint32) for i in order])
    order = np.argsort(numbers)
    rank = np.empty(len(order), np.uint32)
    rank[order] = np.arange(len(order), dtype=np.uint32)
    words = squeeze([numbers[order], rank[unpack(docs.column("words")[0].as_py(), np.uint32)]])
    return pa.table([*(docs.column(c) for c in ("chunk", "docs", "held", "sizes")), pa.array([words], pa.binary())], names=["chunk", "docs", "held", "sizes", "words"])


ENCODED = "chunk long, docs binary, held binary, sizes binary, words binary"


def squeeze(arrays: list[np.ndarray]) -> bytes:
    """Arrays of 32-bit numbers, compressed together, byte plane by byte plane."""
    sizes = np.array([len(arrays), *map(len, arrays)], "<i8")
    planes = [np.ascontiguousarray(x, "<u4").view(np.uint8).reshape(-1, 4).T.tobytes() for x in arrays]
    return zstandard.ZstdCompressor(level=1).compress(b"".join([sizes.tobytes(), *planes]))


def unsqueeze(data: bytes) -> list[np.ndarray]:
    data = zstandard.ZstdDecompressor().decompress(data)
    n = int.from_bytes(data[:8], "little")
    at, out = 8 * (n + 1), []
    for size in np.frombuffer(data, "<i8", n, 8).tolist():
        planes = np.frombuffer(data, np.uint8, 4 * size, at).reshape(4, size)
        out.append(np.ascontiguousarray(planes.T).view("<u4").ravel())
        at += 4 * size
    return out


def trie(columns: list[np.ndarray]) -> list[np.ndarray]:
    """Distinct rows, sorted by their columns in turn, as the steps between siblings and the numbers of children."""
    n = len(columns[0])
    parent = np.zeros(n, bool)
    parent[:1] = True
    out = []
    for j, column in enumerate(columns):
        node = parent.copy()
        node[1:] |= column[1:] != column[:-1]
        at = np.flatnonzero(node)
        values, eldest = column[at], parent[at]
        steps = values.copy()
        steps[1:] -= np.where(eldest[1:], np.uint32(0), values[:-1])
        if j:
            out.append(np.diff(np.append(np.flatnonzero(eldest), len(at))).astype(np.uint32))
        out.append(steps)
        parent = node
    return out


def untrie(arrays: list[np.ndarray]) -> list[np.ndarray]:
    columns = [np.cumsum(arrays[0], dtype=np.uint32)]
    for children, steps in zip(arrays[1::2], arrays[2::2]):
        children = children.astype(np.int64)
        sums = np.cumsum(steps, dtype=np.uint32)
        eldest = np.cumsum(children) - children
        columns = [np.repeat(c, children) for c in columns]
        columns.append(sums - np.repeat(sums[eldest] - steps[eldest], children))
    return columns


def _mixed(words: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (words.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        return x ^ (x >> np.uint64(32))


def hot_splits(unigrams: Unigrams, parts: int) -> np.ndarray:
    """Over how many buckets the n-grams after each of the hot words go; those are the lowest numbers, at most ``parts``."""
    hot = unigrams.counts * parts > unigrams.total
    n = int((np.append(unigrams.starts, unigrams.words)[1:][hot]).max(initial=0))
    numbers = np.arange(n)
    return -(-unigrams.counts[unigrams.level(numbers)] * parts // max(unigrams.total, 1)) if n else np.zeros(0, np.int64)


class Keys:
    """Rows of columns as numbers that sort alike, packed into as few 64-bit keys as hold them: one key sorts much faster than two."""

    def __init__(self, columns: list[np.ndarray]):
        self.keys: list[np.ndarray] = []
        self.fields: list[tuple[int, np.ndarray | int]] = []  # bits of each column, and what counts as BEGIN in it, or its values
        values, bits = [], []
        for column in columns:
            first = column == BEGIN  # counts as one more than the largest word here
            most = int(column[~first].max(initial=0)) + 1
            values.append((np.where(first, np.uint32(most), column) if most.bit_length() < 32 else column, most))
            bits.append(most.bit_length())
        for i, column in enumerate(columns):
            if sum(bits) > 64:  # ranks of the values are shorter
                known, ranks = np.unique(column, return_inverse=True)
                values[i], bits[i] = (ranks.astype(np.uint32), known), len(known).bit_length()
        room = 0
        for (column, meaning), n in zip(values, bits):
            if room >= n:
                self.keys[-1] = self.keys[-1] << np.uint64(n) | column
            else:
                self.keys.append(column.astype(np.uint64))
                room = 64
            room -= n
            self.fields.append((n, meaning))

    def sorted(self) -> tuple[np.ndarray, np.ndarray]:
        """The order of the rows, and where a new one begins in it."""
        order = np.argsort(self.keys[0], kind="stable") if len(self.keys) == 1 else np.lexsort(self.keys[::-1])
        new = np.zeros(len(order), bool)
        new[:1] = True
        for key in self.keys:
            key = key[order]
            new[1:] |= key[1:] != key[:-1]
        return order, new

    def distinct(self) -> tuple[list[np.ndarray], np.ndarray] | None:
        """Distinct rows and how often each is there, if one key holds a row."""
        if len(self.keys) > 1:
            return None
        key = np.sort(self.keys[0])
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
        left, columns = key[first], []
        for bits, meaning in reversed(self.fields):
            column = (left & np.uint64((1 << bits) - 1)).astype(np.uint32)
            if isinstance(meaning, int):
                columns.append(np.where(column == meaning, BEGIN, column) if bits < 32 else column)
            else:
                columns.append(meaning[column])
            left = left >> np.uint64(bits)
        return columns[::-1], np.diff(np.append(first, len(key)))


class Asked:
    """A chunk's distinct n-grams, of the ``train`` tokens or of those in the buckets that ``wanted`` picks.

    ``columns`` are the words of the history, last one first, and the word
    after it; rows are sorted by bucket and columns, ``cuts`` tell where each
    bucket begins, ``counts`` how often a row is there, and, if they are to be
    ``placed``, ``places`` the row of each of the ``tokens``.
    """

    def __init__(self, sizes: np.ndarray, known: np.ndarray, local: np.ndarray, order: int, parts: int, splits: np.ndarray, train=None, wanted: Callable[[np.ndarray], np.ndarray] | None = None, placed: bool = False):
        begin = len(known)
        known = np.append(known, BEGIN)
        mixed = _mixed(known)
        first, hot = (mixed % np.uint64(parts)).astype(np.int64), np.searchsorted(known, len(splits))

        def buckets(columns: list[np.ndarray]) -> np.ndarray:
            out = first[columns[0]]
            split = np.flatnonzero(columns[0] < hot)
            if len(split):
                shift = mixed[columns[1][split]] % splits[known[columns[0][split]]].astype(np.uint64)
                out[split] = (out[split] + shift.astype(np.int64)) % parts
            return out

        place = np.arange(len(local)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        columns = []
        for back in range(1, order):
            before = np.full(len(local), begin, np.uint32)
            before[back:] = local[:-back]
            before[place < back] = begin
            columns.append(before)
        columns.append(local)
        self.tokens = np.flatnonzero(train if wanted is None else wanted(buckets(columns)))
        rows = [x[self.tokens] for x in columns]
        keys = Keys(rows)
        places = None
        if placed or (found := keys.distinct()) is None:
            sorted_, new = keys.sorted()
            places = np.empty(len(sorted_), np.int64)
            places[sorted_] = np.cumsum(new) - 1
            found = [x[sorted_[new]] for x in rows], np.diff(np.append(np.flatnonzero(new), len(new)))
        columns, counts = found
        bucket = buckets(columns)
        sorted_ = np.argsort(bucket.astype(np.uint16) if parts <= 2**16 else bucket, kind="stable")
        self.columns, self.counts = [known[x[sorted_]] for x in columns], counts[sorted_]
        if places is not None:
            rank = np.empty(len(sorted_), np.int64)
            rank[sorted_] = np.arange(len(sorted_))
            self.places = rank[places]
        self.buckets, self.cuts = np.unique(bucket[sorted_], return_index=True)
        self.cuts = np.append(self.cuts, len(bucket))

    def slices(self) -> Iterator[tuple[int, slice]]:
        for b, x, y in zip(self.buckets.tolist(), self.cuts[:-1].tolist(), self.cuts[1:].tolist()):
            yield b, slice(x, y)


def _chunk_words(row: tuple) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(held, sizes, known words, each token's place in them) of an encoded chunk."""
    _, _, held, sizes, words = row
    return unpack(held, bool), unpack(sizes, np.int64), *unsqueeze(words)


def _ask_counts(batches: Iterator[pa.RecordBatch], order: int, parts: int, splits: np.ndarray) -> Iterator[pa.RecordBatch]:
    """The training part's distinct n-grams of each chunk by bucket, with their counts."""
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            held, *words = _chunk_words(row)
            asked = Asked(*words, order, parts, splits, train=np.repeat(~held, words[0]))
            for b, part in asked.slices():
                yield pa.RecordBatch.from_arrays([pa.array([b], pa.int32()), pa.array([squeeze([*trie([c[part] for c in asked.columns]), asked.counts[part]])], pa.binary())], names=["bucket", "grams"])


def _ask_scores(batches: Iterator[pa.RecordBatch], order: int, parts: int, splits: np.ndarray, phase: int, phases: int) -> Iterator[pa.RecordBatch]:
    """All distinct n-grams of each chunk in the buckets of a phase."""
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            asked = Asked(*_chunk_words(row)[1:], order, parts, splits, wanted=lambda b: b % phases == phase)
            for b, part in asked.slices():
                yield pa.RecordBatch.from_arrays([pa.array([b], pa.int32()), pa.array([row[0]], pa.int64()), pa.array([squeeze(trie([c[part] for c in asked.columns]))], pa.binary())], names=["bucket", "chunk", "grams"])


def stored(columns: list[np.ndarray], counts: np.ndarray) -> bytes:
    """N-grams with 64-bit counts as they stand in a table."""
    counts = counts.astype(np.uint64)
    return squeeze([*trie(columns), counts & np.uint64(2**32 - 1), counts >> np.uint64(32)])


def restored(data: bytes) -> tuple[list[np.ndarray], np.ndarray]:
    *arrays, low, high = unsqueeze(data)
    return untrie(arrays), (high.astype(np.int64) << 32) + low


def _summed(columns: list[np.ndarray], counts: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Distinct rows with the sums of their counts."""
    order, new = Keys(columns).sorted()
    return [c[order[new]] for c in columns], np.add.reduceat(counts[order], np.flatnonzero(new)) if len(order) else counts


def _kinds(counts: np.ndarray) -> list[int]:
    """How many n-grams were seen once, twice, up to once more than ``CUTOFF``."""
    return np.bincount(np.minimum(counts, CUTOFF + 2), minlength=CUTOFF + 3)[1 : CUTOFF + 2].tolist()


NGRAMS = "n int, bucket int, word long, grams binary, kinds array<long>"


def _count_grams(table: pa.Table, order: int, splits: np.ndarray) -> pa.Table:
    """A bucket's n-grams of every order with their counts; the bigrams of a hot word, which are not all here, in rows of their own."""
    bucket = table.column("bucket")[0].as_py()
    parts = [unsqueeze(x) for x in table.column("grams").to_pylist()]
    rows = [np.concatenate(c) for c in zip(*(untrie(p[:-1]) for p in parts))]
    columns, counts = _summed(rows, np.concatenate([p[-1] for p in parts]).astype(np.int64))
    out = []
    for n in range(order, 1, -1):
        if n < order:
            columns, counts = _summed([*columns[: n - 1], columns[-1]], counts)
        hot = columns[0] < len(splits) if n == 2 else np.zeros(len(counts), bool)
        cold = np.flatnonzero(~hot)
        if len(cold):
            out.append((n, bucket, None, stored([c[cold] for c in columns], counts[cold]), _kinds(counts[cold])))
        for word in np.unique(columns[0][hot]).tolist():
            part = slice(*np.searchsorted(columns[0], [word, word + 1]))
            out.append((n, bucket, word, stored([c[part] for c in columns], counts[part]), None))
    types = [pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.list_(pa.int64())]
    return pa.table([pa.array(c, t) for c, t in zip(zip(*out), types)], names=["n", "bucket", "word", "grams", "kinds"])


def _sum_hot(table: pa.Table) -> pa.Table:
    """All bigrams of a hot word."""
    parts = [restored(x) for x in table.column("grams").to_pylist()]
    columns, counts = _summed([np.concatenate(c) for c in zip(*(p[0] for p in parts))], np.concatenate([p[1] for p in parts]))
    row = ([2], table.column("word").to_pylist()[:1], [stored(columns, counts)], [_kinds(counts)])
    return pa.table([pa.array(c, t) for c, t in zip(row, [pa.int32(), pa.int64(), pa.binary(), pa.list_(pa.int64())])], names=["n", "word", "grams", "kinds"])


def _find(known: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each wanted number lies among the known ones, and whether it does."""
    if not len(known):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    at = np.minimum(np.searchsorted(known, wanted), len(known) - 1)
    return at, known[at] == wanted


class Bucket:
    """What a bucket knows: for each order, histories with weights and n-grams with counts.

    A history's key is the place of the shorter history, without its first
    word, in the order below, and that first word; an n-gram's key is the place
    of its history and its last word.
    """

    def __init__(self, rows: pa.Table, order: int, unigrams: Unigrams, d: list[np.ndarray]):
        self.unigrams, self.d = unigrams, d
        self.histories, self.keys, self.counts, self.bases, self.weights = {}, {}, {}, {}, {}
        self.own: dict[int, np.ndarray] = {}  # places of the histories that only this bucket has
        tables: dict[int, list] = {n: [] for n in range(2, order + 1)}
        weights: dict[int, list] = {n: [] for n in range(2, order + 1)}
        lists = (rows.column(c).to_pylist() for c in ("n", "word", "grams", "weights"))
        for n, word, grams, weight in sorted(zip(*lists), key=lambda r: (r[0], -1 if r[1] is None else r[1])):
            if grams is not None:
                tables[n].append((word is None, *restored(grams)))
            if weight is not None:
                weights[n].append(unpack(weight, "<f8"))
        for n in range(2, order + 1):
            if not tables[n]:
                columns, counts, own = [np.zeros(0, np.uint32)] * n, np.zeros(0, np.int64), np.zeros(0, bool)
            else:
                columns = [np.concatenate(c) for c in zip(*(t[1] for t in tables[n]))]
                counts, own = np.concatenate([t[2] for t in tables[n]]), np.concatenate([np.full(len(t[2]), t[0]) for t in tables[n]])
            if len(tables[n]) > 1:  # hot words among the others
                sorted_ = np.argsort(columns[0], kind="stable")
                columns, counts, own = [c[sorted_] for c in columns], counts[sorted_], own[sorted_]
            keys = columns[0].astype(np.uint64)
            for k in range(2, n):
                keys = _find(self.histories[k], keys)[0].astype(np.uint64) << np.uint64(32) | columns[k - 1]
            first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
            sizes = np.diff(np.append(first, len(keys)))
            self.histories[n], self.own[n] = keys[first], np.flatnonzero(own[first])
            self.keys[n] = np.repeat(np.arange(len(first), dtype=np.uint64), sizes) << np.uint64(32) | columns[-1]
            self.counts[n] = counts
            sums = lambda x: np.add.reduceat(x, first) if len(first) else np.zeros(0)  # noqa: B023, E731
            total = sums(counts)
            lost = sums(np.where(counts <= CUTOFF, counts * (1 - d[n][np.minimum(counts, CUTOFF)]), 0.0))
            # a history whose counts are all above the cutoff lends one count to the words it was not seen with
            self.bases[n] = np.where(lost > 0, total, total + 1)
            if weights[n]:
                known = np.concatenate(weights[n])
                hot_last = np.concatenate([self.own[n], np.flatnonzero(~own[first])])
                self.weights[n] = np.empty(len(first))
                self.weights[n][hot_last] = known
            else:
                lower = self.probabilities([c for i, c in enumerate(columns) if i != n - 2], n - 1)
                self.weights[n] = np.where(lost > 0, lost, 1.0) / self.bases[n] / np.maximum(1 - sums(lower), 1e-12)

    def probabilities(self, columns: list[np.ndarray], order: int) -> np.ndarray:
        """Of each n-gram: the discounted one of the longest order that has seen it, times the weights of those above."""
        words = columns[-1]
        p = self.unigrams.p[self.unigrams.level(words)]
        history, known = columns[0].astype(np.uint64), np.ones(len(words), bool)
        for n in range(2, order + 1):
            at, hit = _find(self.histories[n], history)
            known = known & hit
            if not len(self.histories[n]):
                break
            gram, seen = _find(self.keys[n], at.astype(np.uint64) << np.uint64(32) | words)
            counts = self.counts[n][gram]
            found = np.where(counts <= CUTOFF, self.d[n][np.minimum(counts, CUTOFF)], 1.0) * counts / self.bases[n][at]
            p = np.where(seen & known, found, np.where(known, self.weights[n][at], 1.0) * p)
            if n < order:
                history = at.astype(np.uint64) << np.uint64(32) | columns[n - 1]
        return p


MODEL = ["n", "bucket", "word", "grams", "weights"]


def _weigh(rows: pa.Table, order: int, unigrams, d: list[np.ndarray]) -> pa.Table:
    """The backoff weights of a bucket's own histories, in the order of its n-grams."""
    bucket = Bucket(rows, order, unigrams.value, d)
    out = [(n, rows.column("bucket")[0].as_py(), pack(bucket.weights[n][own])) for n, own in bucket.own.items() if len(own)]
    return pa.table([pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * 3, [pa.int32(), pa.int32(), pa.binary()])], names=["n", "bucket", "weights"])


def _weigh_hot(batches: Iterator[pa.RecordBatch], parts: int, splits: np.ndarray, unigrams, d: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
    """Each hot word's bigrams with its weight and the buckets that hold its n-grams."""
    for batch in batches:
        for i, (n, word, grams) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("n", "word", "grams")))):
            rows = pa.table({"n": [n], "word": [word], "grams": pa.array([grams], pa.binary()), "weights": pa.array([None], pa.binary())})
            weight = Bucket(rows, 2, unigrams.value, d).weights[2]
            first = int(_mixed(np.array([word], np.uint32))[0] % np.uint64(parts))
            buckets = sorted({(first + j) % parts for j in range(int(splits[word]))})
            values = ([n], [word], [grams], [pack(weight)], [buckets])
            types = [pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.list_(pa.int32())]
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(values, types)], names=["n", "word", "grams", "weights", "buckets"])


def _answer(asked: pa.Table, rows: pa.Table, order: int, unigrams, d: list[np.ndarray]) -> pa.Table:
    """For each chunk, the log10 probabilities of the n-grams that it asked a bucket for."""
    out = []
    if asked.num_rows:
        bucket = Bucket(rows, order, unigrams.value, d)
        for b, chunk, grams in zip(*(c.to_pylist() for c in asked.columns)):
            p = bucket.probabilities(untrie(unsqueeze(grams)), order)
            out.append((chunk, b, pack(np.log10(np.maximum(p, 1e-300)))))
    return pa.table([pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * 3, [pa.int64(), pa.int32(), pa.binary()])], names=["chunk", "bucket", "logs"])


def _add_up(encoded: pa.Table, answers: pa.Table, order: int, parts: int, splits: np.ndarray, phase: int, phases: int) -> pa.Table:
    """What the tokens of a phase add to each document of a chunk."""
    row = tuple(c[0].as_py() for c in encoded.columns)
    _, sizes, *words = _chunk_words(row)
    asked = Asked(sizes, *words, order, parts, splits, wanted=lambda b: b % phases == phase, placed=True)
    logs = np.zeros(len(asked.columns[0]))
    of = dict(zip(answers.column("bucket").to_pylist(), answers.column("logs").to_pylist()))
    for b, part in asked.slices():
        logs[part] = unpack(of[b], "<f8")
    document = np.repeat(np.arange(len(sizes)), sizes)[asked.tokens]
    return pa.table([pa.array([row[0]], pa.int64()), pa.array([pack(np.bincount(document, logs[asked.places], len(sizes)))], pa.binary())], names=["chunk", "sums"])


def _document_rows(batches: Iterator[pa.RecordBatch], unigrams) -> Iterator[pa.RecordBatch]:
    """What a chunk's documents are told without n-grams: ids, folds, numbers of tokens and known ones, base scores."""
    model = unigrams.value
    base = np.log10((model.counts + 1) / (model.total + model.kinds + 1))
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            _, sizes, known, local = _chunk_words(row)
            level, first = model.level(known)[local], np.cumsum(sizes) - sizes
            known = np.add.reduceat((model.counts[level] > 0).astype(np.int64), first)
            values = (row[0], row[1], row[2], row[3], pack(known), pack(np.add.reduceat(base[level], first)))
            yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, [pa.int64(), *[pa.binary()] * 5])], names=["chunk", "docs", "held", "sizes", "known", "base"])


def _finish(docs: pa.Table, sums: pa.Table, total: int) -> pa.Table:
    row = {c: docs.column(c)[0].as_py() for c in docs.column_names}
    ids = unpack(row["docs"], np.int64)
    columns = [
        pa.array(ids, pa.int64(), mask=ids == -(2**63)),
        pa.array(unpack(row["held"], bool)),
        pa.array(unpack(row["sizes"], np.int64)),
        pa.array(unpack(row["known"], np.int64)),
        pa.array(np.full(len(ids), total, np.int64)),
        pa.array(unpack(row["base"], "<f8")),
        pa.array(np.sum([unpack(x, "<f8") for x in sums.column("sums").to_pylist()], axis=0)),
    ]
    return pa.table(columns, names=["doc", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])


SCORED = "doc long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _bound(function, *rest):
    """A function of two tables; Spark tells functions apart by their number of arguments."""
    return lambda a, b: function(a, b, *rest)


def held_out(id_col: str = "doc_id", fold: int = 2, folds: int = 7):
    """True for the ids whose CRC-32, as text, leaves ``fold`` modulo ``folds``; a null id is in the training part."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % folds == fold, F.lit(False))


def encode_words(rows: DataFrame, buckets: int) -> tuple[DataFrame, Unigrams]:
    """Chunks of documents (doc, held, text) in global word numbers, and the unigrams of the training part."""
    chunks = materialize(rows.mapInArrow(lambda it: _chunks(it, buckets), CHUNKS), "lm-chunks")
    asked = chunks.filter("kind = 1").select("chunk", "bucket", "words", "counts")
    counted = materialize(asked.groupBy("bucket").applyInArrow(_count_words, "bucket int, words binary, levels array<long>, level_sizes array<long>"), "lm-words")
    levels = counted.select("bucket", F.explode(F.arrays_zip("levels", "level_sizes")).alias("x")).select("bucket", F.col("x.levels").alias("level"), F.col("x.level_sizes").alias("n"))
    # distinct counts: at most the square root of twice the number of tokens
    unigrams = Unigrams([tuple(r) for r in levels.groupBy("level").agg(F.sum("n")).collect()])
    if unigrams.words >= BEGIN:
        raise ValueError("word numbers are 32-bit: the corpus has too many distinct words")
    starts = dict(zip(unigrams.counts.tolist(), unigrams.starts.tolist()))
    before = Window.partitionBy("level").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    shifts = levels.withColumn("shift", F.coalesce(F.sum("n").over(before), F.lit(0)))
    shifts = shifts.groupBy("bucket").agg(F.sort_array(F.collect_list(F.struct("level", "shift")), asc=False).alias("x")).select("bucket", F.col("x.shift").alias("shifts"))
    known = counted.join(shifts, "bucket")
    numbers = asked.select("chunk", "bucket", "words").groupBy("bucket").cogroup(known.groupBy("bucket")).applyInArrow(lambda a, b: _number_words(a, b, starts), "chunk long, bucket int, numbers binary")
    encoded = chunks.filter("kind = 0").select("chunk", "docs", "held", "sizes", "words").groupBy("chunk").cogroup(numbers.groupBy("chunk")).applyInArrow(_renumber, ENCODED)
    encoded = materialize(encoded, "lm-encoded")
    discard(chunks, counted)
    return encoded, unigrams


class KatzModel:
    """Tables of n-grams, of hot words' bigrams, and of backoff weights, with the discounts of each order."""

    def __init__(self, encoded: DataFrame, unigrams: Unigrams, order: int, parts: int):
        """Fit on the training part of encoded chunks."""
        spark = encoded.sparkSession
        self.order, self.parts, self.splits = order, parts, hot_splits(unigrams, parts)
        self.unigrams = spark.sparkContext.broadcast(unigrams)
        parts, splits, shared = self.parts, self.splits, self.unigrams
        asked = encoded.mapInArrow(lambda it: _ask_counts(it, order, parts, splits), "bucket int, grams binary")
        self.ngrams = materialize(asked.groupBy("bucket").applyInArrow(lambda t: _count_grams(t, order, splits), NGRAMS), "lm-ngrams", "n")
        del asked
        release(spark)
        partial = self.ngrams.filter("word is not null").select("word", "grams")
        hot = materialize(partial.groupBy("word").applyInArrow(_sum_hot, "n int, word long, grams binary, kinds array<long>"), "lm-hot-sums")
        kinds = self.ngrams.filter("word is null").select("n", "kinds").union(hot.select("n", "kinds"))
        sums = kinds.select("n", F.posexplode("kinds").alias("r", "k")).groupBy("n", "r").agg(F.sum("k").alias("k")).collect()
        self.d = d = [discounts({r.r + 1: r.k for r in sums if r.n == n}) for n in range(order + 1)]
        self.hot = materialize(hot.mapInArrow(lambda it: _weigh_hot(it, parts, splits, shared, d), "n int, word long, grams binary, weights binary, buckets array<int>"), "lm-hot")
        discard(hot)
        self.backoff = None
        rows = self.rows()
        self.backoff = materialize(rows.groupBy("bucket").applyInArrow(lambda t: _weigh(t, order, shared, d), "n int, bucket int, weights binary"), "lm-backoff", "n")
        del rows, partial, kinds
        release(spark)

    def rows(self, of=None) -> DataFrame:
        """The model's rows by bucket, those of the buckets that ``of`` picks."""
        none = F.lit(None).cast("binary")
        out = self.ngrams.filter("word is null").select("n", "bucket", "word", "grams", none.alias("weights"))
        # without weights while those of the others are being made, as a bucket makes all it lacks
        hot_weights = none if self.backoff is None else F.col("weights")
        out = out.unionByName(self.hot.select("n", F.explode("buckets").alias("bucket"), "word", "grams", hot_weights.alias("weights")))
        if self.backoff is not None:
            out = out.unionByName(self.backoff.select("n", "bucket", F.lit(None).cast("long").alias("word"), none.alias("grams"), "weights"))
        return out if of is None else out.filter(of)

    def score(self, encoded: DataFrame, phase: int, phases: int) -> DataFrame:
        """(chunk, sums): what the tokens in a phase's buckets add to the documents' log10 probabilities."""
        order, parts, splits, shared, d = self.order, self.parts, self.splits, self.unigrams, self.d
        asked = encoded.mapInArrow(lambda it: _ask_scores(it, order, parts, splits, phase, phases), "bucket int, chunk long, grams binary")
        rows = self.rows(F.col("bucket") % phases == phase)
        answers = asked.groupBy("bucket").cogroup(rows.groupBy("bucket")).applyInArrow(_bound(_answer, order, shared, d), "chunk long, bucket int, logs binary")
        return encoded.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(_bound(_add_up, order, parts, splits, phase, phases), "chunk long, sums binary")


def katz_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", held=None, order: int = 2, phases: int = PHASES) -> DataFrame:
    """Fit n-grams of up to ``order`` words on the documents for which ``held`` is false, and score all.

    Returns id, ``held_out``, ``n_tokens`` (words and one end), ``n_known``
    (tokens seen in training), ``train_tokens``, ``base_score`` (add-one
    unigrams) and ``score``, both log10 probabilities of the whole text. A
    null text is empty and has only its end. Rows repeated with one id are
    documents of their own; a null id stays null. An empty table gives an
    empty result; other columns are not read, whatever their names.

    The number of phases changes nothing but how much travels at a time. One
    history's words meet in one task, each chunk's summed up before.
    """
    if order < 2 or phases < 1:
        raise ValueError("the order is 2 at least, and there is a phase at least")
    spark = docs.sparkSession
    small_batches(spark)
    buckets = partitions(spark)
    held = held_out(id_col) if held is None else held
    rows = docs.select(F.col(id_col).cast("long").alias("doc"), held.alias("held"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    encoded, unigrams = encode_words(rows, buckets)
    model = KatzModel(encoded, unigrams, order, 4 * buckets)
    shared, total = model.unigrams, unigrams.total
    known = materialize(encoded.mapInArrow(lambda it: _document_rows(it, shared), "chunk long, docs binary, held binary, sizes binary, known binary, base binary"), "lm-documents")
    sums = None
    for phase in range(phases):
        part = materialize(model.score(encoded, phase, phases), f"lm-scores-{phase}")
        sums = part if sums is None else sums.unionByName(part)
        release(spark)
    discard(encoded)
    return known.groupBy("chunk").cogroup(sums.groupBy("chunk")).applyInArrow(_bound(_finish, total), SCORED).withColumnRenamed("doc", id_col)
