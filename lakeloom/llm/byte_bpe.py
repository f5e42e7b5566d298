"""Byte-level BPE by a global shuffle of distinct pre-tokens.

Documents are split, in chunks, into pre-tokens. Each chunk sends its distinct
ones to the bucket of their hash, where each is encoded once for the whole
corpus; ids go back to the chunks, which put them together by position. What
travels is compressed, a row for each chunk and bucket. Decoding joins the
token-byte table.

The pattern need not run over every word: a chunk first cuts its texts where no
pre-token can lie across (see :mod:`lakeloom.llm.units`) and splits each
distinct piece into pre-tokens once.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeloom.llm.common import partitions, small_batches
from lakeloom.llm.units import PATTERN, cut_everywhere, pieces_of

#: Characters of text after which a task closes a chunk.
CHUNK = 8_000_000

_loaded: dict[tuple[str, str], tuple] = {}


def load_ranks(path: str) -> dict[bytes, int]:
    """The token bytes and their ranks in a ``.tiktoken`` file."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def encoding(path: str, pattern: str):
    """(tiktoken encoding without special tokens, ranks, compiled pattern), loaded once for each worker."""
    if (path, pattern) not in _loaded:
        import tiktoken

        ranks = load_ranks(path)
        _loaded[path, pattern] = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}), ranks, regex.compile(pattern)
    return _loaded[path, pattern]


def token_bytes(spark: SparkSession, path: str) -> DataFrame:
    """The token-byte table of a ``.tiktoken`` file: id, bytes."""
    return spark.createDataFrame([(rank, bytearray(token)) for token, rank in load_ranks(path).items()], "id int, bytes binary")


def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list, list[str]]]:
    """(chunk, ids, texts) of a task's rows in scan order, cut after every ``CHUNK`` characters."""
    chunk, size, docs, texts = TaskContext.get().partitionId() << 32, 0, [], []
    for batch in batches:
        for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            docs.append(doc)
            texts.append(text)
            size += len(text) + 1
            if size >= CHUNK:
                yield chunk, docs, texts
                chunk, size, docs, texts = chunk + 1, 0, [], []
    if docs:
        yield chunk, docs, texts


def blob(parts: list[bytes]) -> tuple[bytes, int]:
    """Strings' bytes, compressed together, and the CRC of what is compressed."""
    data = len(parts).to_bytes(8, "little") + np.array([len(p) for p in parts], "<u4").tobytes() + b"".join(parts)
    return zstandard.ZstdCompressor(level=3).compress(data), zlib.crc32(data)


def unblob(compressed: bytes) -> list[bytes]:
    data = zstandard.ZstdDecompressor().decompress(compressed)
    n = int.from_bytes(data[:8], "little")
    ends = (np.cumsum(np.frombuffer(data, "<u4", n, 8), dtype=np.int64) + 8 + 4 * n).tolist()
    return [data[x:y] for x, y in zip([8 + 4 * n, *ends], ends)]


def packed_chunks(rows: DataFrame) -> DataFrame:
    """(chunk, docs, texts): a row for each chunk, its texts compressed together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk, docs, texts in cut(batches):
            yield pa.RecordBatch.from_arrays([pa.array([chunk], pa.int64()), pa.array([docs], pa.list_(pa.int64())), pa.array([blob([t.encode() for t in texts])[0]], pa.binary())], names=["chunk", "docs", "texts"])

    return rows.mapInArrow(run, "chunk long, docs array<long>, texts binary")


#: Pieces that are one pre-token, or a word with a mark after it, whatever the version of Unicode's tables.
WORD, MARKED = "^ ?[A-Za-z]+$", "^ ?[A-Za-z]+[,.;:!?]$"


def gather(values: np.ndarray, offsets: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The lists ``which`` of those that lie between ``offsets`` in ``values``, one after the other, and their offsets."""
    sizes = (offsets[1:] - offsets[:-1])[which]
    ends = np.cumsum(sizes)
    at = np.repeat(offsets[which] - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)
    return values[at], np.append(0, ends)


class Chunk:
    """A chunk's texts as numbers of distinct pieces, and its distinct pre-tokens by bucket.

    ``order`` tells which text comes when. ``tokens`` are the bytes of each
    bucket's pre-tokens, sorted; ``pieces`` and ``texts`` are offsets into
    ``piece_tokens``, places in the buckets' lists one after the other, and
    ``text_pieces``.
    """

    def __init__(self, texts: list[str], pattern: str, split: regex.Pattern, buckets: int):
        # most texts are cut at every space, all of them at once
        every = [cut_everywhere(text, pattern) for text in texts]
        self.order = np.argsort(~np.array(every), kind="stable")
        whole = pc.split_pattern(pa.array([t for t, yes in zip(texts, every) if yes], pa.large_string()), " ")
        others = [pieces_of(t, pattern) for t, yes in zip(texts, every) if not yes]
        flat = pa.concat_arrays([whole.flatten(), pa.array([p for pieces in others for p in pieces], pa.large_string())])
        self.texts = np.cumsum([0, *whole.value_lengths().to_numpy(), *map(len, others)])
        spaced = np.ones(len(flat), bool)
        spaced[self.texts[:-1]] = False
        pieces = pc.binary_join_element_wise(pc.if_else(pa.array(spaced), " ", "").cast(pa.large_string()), flat, pa.scalar("", pa.large_string())).dictionary_encode()
        self.text_pieces, pieces = pieces.indices.to_numpy(), pieces.dictionary
        plain = pattern == PATTERN
        word, marked = (pc.match_substring_regex(pieces, kind).to_numpy(zero_copy_only=False) & plain for kind in (WORD, MARKED))
        found = [split.findall(piece) for piece in pieces.filter(pa.array(~word & ~marked)).to_pylist()]
        ends = pieces.filter(pa.array(marked))
        tokens = pa.concat_arrays(
            [pieces.filter(pa.array(word)), pc.utf8_slice_codeunits(ends, 0, -1), pc.utf8_slice_codeunits(ends, -1), pa.array([t for tokens in found for t in tokens], pa.large_string())]
        ).dictionary_encode()
        sizes = word + 2 * marked
        sizes[~word & ~marked] = [len(tokens) for tokens in found]
        self.pieces = np.append(0, np.cumsum(sizes))
        at = np.empty(self.pieces[-1], np.int64)
        first, n, m = self.pieces[:-1], int(word.sum()), int(marked.sum())
        at[first[word]] = np.arange(n)
        at[first[marked]], at[first[marked] + 1] = n + np.arange(m), n + m + np.arange(m)
        rest = ~np.repeat(word | marked, sizes)
        at[rest] = n + 2 * m + np.arange(int(rest.sum()))
        kinds = tokens.dictionary.cast(pa.large_binary())
        where = np.array([zlib.crc32(token) % buckets for token in kinds.to_pylist()], np.int64)
        sorted_ = pc.sort_indices(kinds).to_numpy()
        sorted_ = sorted_[np.argsort(where[sorted_], kind="stable")]
        rank = np.empty(len(sorted_), np.int64)
        rank[sorted_] = np.arange(len(sorted_))
        self.piece_tokens = rank[tokens.indices.to_numpy()[at]]
        used, cuts = np.unique(where[sorted_], return_index=True)
        listed = kinds.take(pa.array(sorted_))
        self.tokens = {b: listed.slice(x, y - x).to_pylist() for b, x, y in zip(used.tolist(), cuts.tolist(), [*cuts[1:].tolist(), len(sorted_)])}

    def ids(self, values: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All texts' ids and their offsets, in ``order``, from the ids of all pre-tokens and how many each has."""
        values, offsets = gather(values, np.append(0, np.cumsum(sizes)), self.piece_tokens)
        values, offsets = gather(values, offsets[self.pieces], self.text_pieces)
        return values, offsets[self.texts]


def encode_one(token: bytes, bpe, ranks: dict[bytes, int]) -> bytes:
    """The ids of one pre-token."""
    rank = ranks.get(token)
    return np.array(bpe.encode_ordinary(token.decode()) if rank is None else [rank], "<u4").tobytes()


def distinct_tokens(rows: DataFrame, ranks: str, pattern: str, buckets: int) -> DataFrame:
    """(bucket, chunk, units): the pre-tokens that each chunk needs encoded, compressed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split = encoding(ranks, pattern)[2]
        for chunk, _, texts in cut(batches):
            lists = Chunk(texts, pattern, split, buckets).tokens
            if lists:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(list(lists), pa.int32()), pa.array([chunk] * len(lists), pa.int64()), pa.array([blob(u)[0] for u in lists.values()], pa.binary())], names=["bucket", "chunk", "units"]
                )

    return rows.mapInArrow(run, "bucket int, chunk long, units binary")


def encode(docs: DataFrame, ranks: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ``ids`` array<int>): every whole text's ids by the ranks in a ``.tiktoken`` file, each match of ``pattern`` separately."""
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("doc"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    buckets = partitions(spark)

    def encode_bucket(table: pa.Table) -> pa.Table:
        bpe, of, _ = encoding(ranks, pattern)
        known: dict[bytes, bytes] = {}
        ids, sizes, checks = [], [], []
        for compressed in table.column("units").to_pylist():
            tokens = unblob(compressed)
            for token in tokens:
                if token not in known:
                    known[token] = encode_one(token, bpe, of)
            parts = [known[u] for u in tokens]
            ids.append(zstandard.ZstdCompressor(level=1).compress(b"".join(parts)))
            sizes.append(zstandard.ZstdCompressor(level=1).compress(np.array([len(p) // 4 for p in parts], "<u4").tobytes()))
            checks.append(zlib.crc32(zstandard.ZstdDecompressor().decompress(compressed)))
        return pa.table({"chunk": table.column("chunk"), "bucket": table.column("bucket"), "ids": pa.array(ids, pa.binary()), "sizes": pa.array(sizes, pa.binary()), "check": pa.array(checks, pa.int64())})

    encoded = distinct_tokens(rows, ranks, pattern, buckets).groupBy("bucket").applyInArrow(encode_bucket, "chunk long, bucket int, ids binary, sizes binary, check long")

    def reassemble(packed: pa.Table, answers: pa.Table) -> pa.Table:
        bpe, of, split = encoding(ranks, pattern)
        chunk = Chunk([t.decode() for t in unblob(packed.column("texts")[0].as_py())], pattern, split, buckets)
        open_ = zstandard.ZstdDecompressor().decompress
        found = {row[0]: row[1:] for row in zip(*(answers.column(c).to_pylist() for c in ("bucket", "ids", "sizes", "check")))}
        ids, sizes = [np.zeros(0, "<u4")], [np.zeros(0, np.int64)]
        for bucket, tokens in chunk.tokens.items():
            if bucket in found and found[bucket][2] == blob_check(tokens):
                ids.append(np.frombuffer(open_(found[bucket][0]), "<u4"))
                sizes.append(np.frombuffer(open_(found[bucket][1]), "<u4"))
            else:
                own = [encode_one(token, bpe, of) for token in tokens]
                ids.append(np.frombuffer(b"".join(own), "<u4"))
                sizes.append(np.array([len(x) // 4 for x in own]))
        values, offsets = chunk.ids(np.concatenate(ids), np.concatenate(sizes).astype(np.int64))
        lists = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values.astype(np.int32)))
        docs = pa.array(packed.column("docs")[0].as_py(), pa.int64())
        return pa.table([docs.take(pa.array(chunk.order)), lists], names=[id_col, "ids"])

    return packed_chunks(rows).groupBy("chunk").cogroup(encoded.groupBy("chunk")).applyInArrow(reassemble, f"`{id_col}` long, ids array<int>")


def byte_bpe(docs: DataFrame, ranks: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", digests: bool = False) -> DataFrame:
    """Encode every whole text and decode the ids again.

    Returns id, ``ids`` (array of int) and ``decoded`` (binary); with
    ``digests`` their lengths and SHA-256 instead: ``n_tokens``,
    ``ids_sha256`` (of decimal ids joined by commas), ``decoded_sha256``. A null
    text is empty and has no id. Rows are independent: repeated ones and null
    ids give a row each. An empty table gives an empty result. Columns that are
    not named are not read, whatever their names.

    A pre-token that a chunk misses, because a repeated scan gave its rows in
    another order, is encoded where it is missed.
    """
    out = decode(encode(docs, ranks, pattern, id_col, text_col), token_bytes(docs.sparkSession, ranks), id_col)
    if not digests:
        return out
    joined = F.array_join(F.col("ids").cast("array<string>"), ",")
    return out.select(id_col, F.size("ids").cast("long").alias("n_tokens"), F.sha2(joined.cast("binary"), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def blob_check(parts: list[bytes]) -> int:
    """The CRC that :func:`blob` gives."""
    return zlib.crc32(b"".join(parts), zlib.crc32(np.array([len(p) for p in parts], "<u4").tobytes(), zlib.crc32(len(parts).to_bytes(8, "little"))))


def decode(encoded: DataFrame, table: DataFrame, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """Decode arrays of ids by a join with a token-byte table (id, bytes): ``id_col``, ``ids_col`` and ``decoded`` (binary).

    The table is a vocabulary, whose size the tokenizer bounds, so it is
    broadcast, and a batch's ids meet it in one gather: no id is shuffled or
    exploded into a row. Null arrays decode to empty bytes, and so do ids that
    the table lacks.
    """
    tokens = sorted((r.id, bytes(r.bytes)) for r in table.select("id", "bytes").collect())
    shared = encoded.sparkSession.sparkContext.broadcast((np.array([i for i, _ in tokens], np.int64), [b for _, b in tokens]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, texts = shared.value
        texts = pa.array([*texts, b""], pa.large_binary())
        for batch in batches:
            lists = batch.column(1).cast(pa.list_(pa.int64()))
            ids = lists.flatten().to_numpy(zero_copy_only=False)
            sizes = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            at = np.minimum(np.searchsorted(known, ids), max(len(known) - 1, 0))
            at = np.where(known[at] == ids, at, len(known)) if len(known) else np.zeros(len(ids), np.int64)
            joined = texts.take(pa.array(at))
            bounds = np.frombuffer(joined.buffers()[1], np.int64, len(ids) + 1, 8 * joined.offset)[np.cumsum([0, *sizes])]
            decoded = pa.Array.from_buffers(pa.large_binary(), batch.num_rows, [None, pa.py_buffer(bounds.tobytes()), joined.buffers()[2] or pa.py_buffer(b"")]).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), decoded], names=[id_col, ids_col, "decoded"])

    rows = encoded.select(id_col, ids_col)
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    return rows.mapInArrow(run, f"{kinds}, decoded binary")
