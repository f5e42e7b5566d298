"""Packing documents into fixed-length sequences by cutting-stock column generation.

Documents are cut into full sequences and one remainder. The remainders'
lengths, rounded up to a quantum, form a histogram of bounded size; a linear
program over packing patterns is solved on it, with a knapsack dynamic program
pricing new patterns. The rounded patterns are dealt to the remainders by their
rank within their length class, so no piece passes through the driver.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lakeloom.llm.common import materialize, small_batches
from lakeloom.llm.units import PATTERN, splittable, unit_keys, unit_text

#: Entries of a worker's cache of encoded units, after which it starts anew.
CACHE = 600_000
#: Characters whose class no version of Unicode's tables disputes.
PLAIN = re.compile("[\\x00-\\u024f]*")
#: White space in a row, by a class that holds all that the pattern's does.
DOUBLE = re.compile(r"\s\s")
#: The pattern for texts without white space in a row: its look-ahead, which only matters there, makes matching slow.
SINGLE_PATTERN = PATTERN.replace(r"\s+(?!\S)|", "")

_encoders: dict[str, Callable[[list[str]], list[bytes]]] = {}


def byte_alphabet() -> dict[str, int]:
    """The bytes behind the letters that byte-level models write them with: printable Latin-1 stands for itself, the rest follows from U+0100 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


def merge_ranks(config: dict) -> dict[bytes, int] | None:
    """Token bytes and ids of a byte-level BPE file whose ids follow the order of its merges, else None."""
    pre, model = config["pre_tokenizer"] or {}, config["model"]
    if pre.get("type") != "ByteLevel" or not pre["use_regex"] or pre["add_prefix_space"] or config["normalizer"] or model["type"] != "BPE" or model["dropout"] or model.get("ignore_merges"):
        return None
    vocabulary, alphabet = model["vocab"], byte_alphabet()
    merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    added = {t["content"] for t in config["added_tokens"]}
    if any(vocabulary.get(a + b) != 256 + i for i, (a, b) in enumerate(merges)) or len(vocabulary) - len(added & vocabulary.keys()) != 256 + len(merges):
        return None
    return {bytes(alphabet[c] for c in token): i for token, i in vocabulary.items() if token not in added}


def cached_encoder(path: str) -> Callable[[list[str]], list[bytes]]:
    """Texts to little-endian uint32 ids by the ``tokenizers`` file at ``path``, without added special tokens.

    If the file's ids are merge ranks, for which both give the same, the faster
    of two libraries is used: for plain texts without white space in a row on the
    whole text, for others on units, each of which is encoded once for each
    worker as long as its cache holds it. Texts that name an added token or have an unsafe space
    go through the file's own tokenizer whole, and so do all texts of other
    kinds of tokenizers.
    """
    if path in _encoders:
        return _encoders[path]
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    import tiktoken
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    ranks = merge_ranks(json.loads(tokenizer.to_str()))
    fast, single = (ranks and tiktoken.Encoding("ranks", pat_str=p, mergeable_ranks=ranks, special_tokens={}).encode_ordinary for p in (PATTERN, SINGLE_PATTERN))
    added = [t.content for t in tokenizer.get_added_tokens_decoder().values()]
    units: dict[str, bytes] = {}

    def raw(text: str) -> bytes:
        return array("I", tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def encode(texts: list[str]) -> list[bytes]:
        whole = [bool(single) and DOUBLE.search(t) is None and PLAIN.fullmatch(t) is not None and not any(a in t for a in added) for t in texts]
        rest = iter(by_units([t for t, w in zip(texts, whole) if not w]))
        return [array("I", single(t)).tobytes() if w else next(rest) for t, w in zip(texts, whole)]

    def by_units(texts: list[str]) -> list[bytes]:
        if len(units) > CACHE:
            units.clear()
        keyed = [unit_keys(t) if fast and splittable(t) and not any(a in t for a in added) else None for t in texts]
        missing: set[str] = set()
        for keys in keyed:
            if keys is not None:
                missing.update(keys)
        for key in missing - units.keys():
            text = unit_text(key)
            units[key] = array("I", fast(text)).tobytes() if PLAIN.fullmatch(text) else raw(text)
        look = units.__getitem__
        return [b"".join(map(look, keys)) if keys is not None else raw(text) for text, keys in zip(texts, keyed)]

    _encoders[path] = encode
    return encode


def pieces(docs: DataFrame, tokenizer: str, id_col: str, text_col: str, size: int, quantum: int, end_id: int) -> DataFrame:
    """Cut every document: its pieces, their length class ``bin``, and their rank ``nth`` in it within the task ``part``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = cached_encoder(tokenizer)
        end = np.array([end_id], "<u4").tobytes()
        part = TaskContext.get().partitionId()
        ranks = [0] * (-(-size // quantum) + 1)
        for batch in batches:
            rows: list[tuple] = []
            for doc, ids in zip(batch.column(0).to_pylist(), encode(batch.column(1).to_pylist())):
                ids += end
                n = len(ids) // 4
                for start in range(0, n, size):
                    length = min(size, n - start)
                    kind = -(-length // quantum)
                    rows.append((doc, start, length, zlib.crc32(ids[4 * start : 4 * (start + length)]), n, kind, part, ranks[kind]))
                    ranks[kind] += 1
            columns = list(zip(*rows)) if rows else [[]] * 8
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, [pa.int64()] * 5 + [pa.int32(), pa.int32(), pa.int64()])],
                names=["doc", "start", "length", "ids_crc32", "doc_tokens", "bin", "part", "nth"],
            )

    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return rows.mapInArrow(run, "doc long, start long, length long, ids_crc32 long, doc_tokens long, bin int, part int, nth long")


def knapsack(values: np.ndarray, sizes: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The most valuable multiset of items within ``capacity``; items may repeat."""
    best = np.zeros(capacity + 1)
    took = np.full(capacity + 1, -1)
    for c in range(1, capacity + 1):
        fit = int(np.searchsorted(sizes, c, "right"))
        best[c] = best[c - 1]
        if fit:
            gains = best[c - sizes[:fit]] + values[:fit]
            j = int(gains.argmax())
            if gains[j] > best[c] + 1e-12:
                best[c], took[c] = gains[j], j
    pattern, c = np.zeros(len(sizes), int), capacity
    while c > 0:
        if took[c] < 0:
            c -= 1
        else:
            pattern[took[c]] += 1
            c -= int(sizes[took[c]])
    return float(best[capacity]), pattern


def cutting_stock(histogram: dict[int, int], capacity: int, rounds: int = 1000) -> list[tuple[dict[int, int], int]]:
    """Patterns ({class: items}, times) that cover the histogram exactly.

    Revised simplex with column generation, rounded down; what rounding leaves,
    at most one pattern's worth for each class, is filled greedily, largest
    first. ``rounds`` only bounds the improvement; any stop gives a full cover.
    """
    sizes = np.array(sorted(k for k, n in histogram.items() if n > 0), int)
    if not len(sizes):
        return []
    demand = np.array([histogram[int(k)] for k in sizes], float)
    columns, left = [None] * len(sizes), demand.copy()
    while left.any():  # a greedy cover; each pattern uses up a class that no later one holds, so they form a basis
        pattern, room = np.zeros(len(sizes), int), capacity
        for i in np.flatnonzero(left)[::-1]:
            pattern[i] = min(room // sizes[i], np.ceil(left[i]))
            room -= pattern[i] * sizes[i]
        held = np.flatnonzero(pattern)
        times = (left[held] / pattern[held]).min()
        first = held[(left[held] / pattern[held]).argmin()]
        left[held] = np.maximum(left[held] - pattern[held] * times, 0.0)
        left[first], columns[first] = 0.0, pattern
        left[left < 1e-9] = 0.0
    for i, k in enumerate(sizes):
        if columns[i] is None:
            columns[i] = np.where(np.arange(len(sizes)) == i, capacity // k, 0)
    inverse = np.linalg.inv(np.array(columns, float).T)
    x = np.maximum(inverse @ demand, 0.0)
    for _ in range(rounds):
        duals = inverse.sum(axis=0)
        value, pattern = knapsack(np.maximum(duals, 0.0), sizes, capacity)
        if value <= 1 + 1e-7:
            break
        step = inverse @ pattern
        ratio = np.where(step > 1e-9, x / np.where(step > 1e-9, step, 1.0), np.inf)
        leaves = int(ratio.argmin())
        if not np.isfinite(ratio[leaves]):
            break
        x = np.maximum(x - step * ratio[leaves], 0.0)
        x[leaves] = ratio[leaves]
        row = inverse[leaves] / step[leaves]
        inverse = inverse - np.outer(step, row)
        inverse[leaves] = row
        columns[leaves] = pattern
    left = {int(k): int(n) for k, n in zip(sizes, demand)}
    out: list[tuple[dict[int, int], int]] = []

    def add(pattern: dict[int, int], times: int) -> None:
        times = min([times, *(left[k] // a for k, a in pattern.items())])
        if times > 0:
            out.append((pattern, times))
            for k, a in pattern.items():
                left[k] -= a * times

    for i in np.argsort(-x):
        add({int(k): int(a) for k, a in zip(sizes, columns[i]) if a}, int(np.floor(x[i] + 1e-6)))
    while any(left.values()):
        pattern, room = {}, capacity
        for k in sorted((k for k, n in left.items() if n), reverse=True):
            if a := min(left[k], room // k):
                pattern[k] = a
                room -= a * k
        add(pattern, max(left.values()))
    return out


def pack(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", size: int = 1024, quantum: int = 4, end_id: int = 0) -> DataFrame:
    """Pack all documents: one row per piece, with ``sequence_id`` and its ``offset`` in that sequence.

    A document is its ids with ``end_id`` after them; a null text is empty, so
    just ``end_id``. ``start`` is the piece's place in its document,
    ``ids_crc32`` the unsigned CRC-32 of its ids as little-endian uint32,
    ``doc_tokens`` the document's ids in all. Rows repeated with one id, and
    null ids, are documents of their own. An empty table gives no piece.
    """
    cut = materialize(pieces(docs, tokenizer, id_col, text_col, size, quantum, end_id), "pieces")
    counts = materialize(cut.groupBy("part", "bin").agg(F.count(F.lit(1)).alias("n")), "piece-counts")
    histogram = {r.bin: r.n for r in counts.groupBy("bin").agg(F.sum("n").alias("n")).collect()}

    deal, used, sequence = [], dict.fromkeys(histogram, 0), 0
    for pattern, times in cutting_stock(histogram, size // quantum):
        for kind, each in pattern.items():
            deal.append((kind, used[kind], used[kind] + each * times, each, sequence))
            used[kind] += each * times
        sequence += times
    # at most two patterns for each length class, so a bounded table
    dealt = docs.sparkSession.createDataFrame(deal, "bin int, lo long, hi long, each long, first_sequence long")

    before = Window.partitionBy("bin").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    shifts = counts.select("part", "bin", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("shift"))
    ranked = cut.join(shifts, ["part", "bin"]).withColumn("rank", F.col("nth") + F.col("shift"))
    placed = ranked.join(F.broadcast(dealt), (ranked.bin == dealt.bin) & (ranked["rank"] >= dealt.lo) & (ranked["rank"] < dealt.hi)).drop(dealt.bin)
    placed = placed.withColumn("sequence_id", F.expr("first_sequence + (rank - lo) div each")).withColumn("slot", F.expr("(rank - lo) % each"))
    inside = Window.partitionBy("sequence_id").orderBy(F.desc("bin"), "slot").rowsBetween(Window.unboundedPreceding, -1)
    return placed.select(
        F.col("doc").alias(id_col), "start", "length", "ids_crc32", "doc_tokens", "sequence_id", F.coalesce(F.sum("length").over(inside), F.lit(0)).cast("long").alias("offset")
    )
