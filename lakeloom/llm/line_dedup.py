"""Line deduplication that returns keep bitmaps instead of text.

DataFrame and SQL functions only. Digests of line keys are range-partitioned
and sorted by digest, document and position; windows over that order stream
through each digest's occurrences without another shuffle. Digests that hold a
large share of all lines are met apart, so no range outgrows a task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lakeloom.llm.common import LOWER, UPPER, WS_CHARS, materialize, partitions

#: Digests with at least this share of all line rows are handled apart; there are at most so many of them.
HOT_PARTS = 1024


def line_keys(docs: DataFrame, id_col: str, text_col: str, min_chars: int) -> DataFrame:
    """(doc, pos, h) of each line whose key has at least ``min_chars`` code points."""
    lines = docs.select(F.col(id_col).cast("long").alias("doc"), F.posexplode(F.split(F.coalesce(F.col(text_col), F.lit("")), "\n", -1)).alias("pos", "line"))
    stripped = F.btrim(F.col("line"), F.lit(WS_CHARS))
    return lines.filter((F.length(stripped) >= min_chars) & F.col("doc").isNotNull()).select("doc", "pos", F.unhex(F.md5(F.translate(stripped, UPPER, LOWER).cast("binary"))).alias("h"))


def keep_bitmaps(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    """(id, drop_bits) of the documents that lose lines.

    ``drop_bits`` maps the number of a 64-bit word to its bits; bit ``p % 64``
    of word ``p div 64`` is set if line ``p`` goes. Words without a set bit
    are left out, which is the compression: a document that keeps all its
    lines has no row.
    """
    spark = docs.sparkSession
    lines = materialize(line_keys(docs, id_col, text_col, min_chars), "line-keys")
    counts = lines.groupBy("h").agg(F.count(F.lit(1)).alias("n"))
    total = lines.count()
    hot = materialize(counts.filter(F.col("n") * HOT_PARTS >= total).select("h"), "hot-lines")

    by_hash = Window.partitionBy("h")
    newest_first = by_hash.orderBy(F.desc("doc"))
    cold = lines.join(F.broadcast(hot), "h", "left_anti").repartitionByRange(partitions(spark), "h").sortWithinPartitions("h", F.desc("doc"), "pos")
    cold_drops = (
        cold.withColumn("nth_doc", F.dense_rank().over(newest_first))
        .withColumn("n_docs", F.max("nth_doc").over(by_hash))
        .filter((F.col("n_docs") >= min_docs) & (F.col("nth_doc") > 1))
        .select("doc", "pos")
    )
    hot_lines = lines.join(F.broadcast(hot), "h")
    hot_stats = hot_lines.select("h", "doc").distinct().groupBy("h").agg(F.count(F.lit(1)).alias("n_docs"), F.max("doc").alias("last_doc")).filter(F.col("n_docs") >= min_docs)
    hot_drops = hot_lines.join(F.broadcast(hot_stats), "h").filter("doc <> last_doc").select("doc", "pos")

    drops = cold_drops.unionByName(hot_drops)
    words = drops.groupBy("doc", F.expr("pos div 64").cast("int").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(pos % 64 as int))")).alias("bits"))
    return words.groupBy("doc").agg(F.map_from_entries(F.collect_list(F.struct("word", "bits"))).alias("drop_bits")).withColumnRenamed("doc", id_col)


def kept_lines(text, drop_bits) -> F.Column:
    """The lines of a text that its bitmap keeps; a null bitmap keeps all."""
    lines = F.split(F.coalesce(text, F.lit("")), "\n", -1)

    def keep(_, i):
        return F.coalesce(F.getbit(drop_bits[(i / 64).cast("int")], i % 64), F.lit(0)) == 0

    return F.when(drop_bits.isNull(), lines).otherwise(F.filter(lines, keep))


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    """Drop lines that at least ``min_docs`` documents share, except in the largest id that holds them.

    Line keys are stripped of ASCII white space and lower-cased (A-Z); shorter
    ones than ``min_chars`` code points stay. Returns id, ``n_lines``,
    ``n_dropped`` and ``kept_text``. Null and empty texts are one empty line.
    Rows with a null id are left alone and count for no line; rows repeated
    with one id are one document. An empty table gives an empty result.
    """
    bitmaps = materialize(keep_bitmaps(docs, id_col, text_col, min_chars, min_docs), "line-bitmaps")
    rows = docs.select(F.col(id_col).cast("long").alias(id_col), F.coalesce(F.col(text_col), F.lit("")).alias("text_"))
    joined = rows.join(bitmaps.hint("merge"), id_col, "left").select(id_col, "text_", kept_lines(F.col("text_"), F.col("drop_bits")).alias("kept_"))
    n_lines = F.size(F.split("text_", "\n", -1)).cast("long")
    return joined.select(id_col, n_lines.alias("n_lines"), (n_lines - F.size("kept_")).alias("n_dropped"), F.array_join("kept_", "\n").alias("kept_text"))
