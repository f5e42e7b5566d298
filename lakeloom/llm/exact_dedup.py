"""Exact deduplication against a persistent digest index."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeloom.llm.common import WS_CLASS, attach_groups, materialize, partitions


def normalised(text) -> F.Column:
    """The text with each run of ASCII white space replaced by one space; null counts as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), f"[{WS_CLASS}]+", " ")


class DigestIndex:
    """A table of SHA-256 digests, bucketed and sorted by digest.

    Batches are checked against it by a sort-merge anti-join, for which the
    index side needs no shuffle, and their new digests are appended. With
    ``path`` the index outlives the session: opening the same path again
    registers its files under ``name``.
    """

    def __init__(self, spark: SparkSession, name: str, buckets: int | None = None, path: str | None = None):
        self.spark, self.name = spark, name
        self.buckets = buckets or max(1, partitions(spark))
        where = f"LOCATION '{path}'" if path else ""
        spark.sql(
            f"CREATE TABLE IF NOT EXISTS {name} (digest BINARY, keep_id BIGINT) USING PARQUET "
            f"CLUSTERED BY (digest) SORTED BY (digest) INTO {self.buckets} BUCKETS {where}"
        )

    def rows(self) -> DataFrame:
        return self.spark.table(self.name)

    def append(self, digests: DataFrame) -> None:
        (
            digests.select("digest", "keep_id")
            .repartition(self.buckets, "digest")
            .write.mode("append")
            .format("parquet")
            .bucketBy(self.buckets, "digest")
            .sortBy("digest")
            .saveAsTable(self.name)
        )

    def ingest(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """Deduplicate a batch against itself and all earlier batches, and append what is new.

        Returns one row per row of ``docs``: ``id_col``, ``digest`` (binary),
        ``keep_id`` (the id that stands for the text: the one already in the
        index, else the smallest of the batch), ``group_size`` (rows of the
        batch with this text), ``kept``.

        Null texts equal empty ones. Rows repeated with one id share a
        verdict. A null id loses to any other and stays only if its text has
        no other row. An empty batch gives an empty result; other columns are
        not read, whatever their names.
        """
        rows = materialize(
            docs.select(F.col(id_col).cast("long").alias("row_id"), F.unhex(F.sha2(normalised(F.col(text_col)).cast("binary"), 256)).alias("digest")),
            "digests",
        )
        fresh = rows.groupBy("digest").agg(F.min("row_id").alias("first_id"), F.count(F.lit(1)).alias("group_size"))
        known = self.rows()
        new = fresh.hint("merge").join(known, "digest", "left_anti").select("digest", F.col("first_id").alias("keep_id"), "group_size", F.lit(True).alias("is_new"))
        seen = fresh.hint("merge").join(known, "digest").select("digest", "keep_id", "group_size", F.lit(False).alias("is_new"))
        groups = materialize(new.unionByName(seen), "digest-groups")
        self.append(groups.filter("is_new"))
        out = attach_groups(rows, groups, "digest", "group_size")
        return out.select(
            F.col("row_id").alias(id_col),
            "digest",
            "keep_id",
            "group_size",
            (F.col("is_new") & F.col("row_id").eqNullSafe(F.col("keep_id"))).alias("kept"),
        )


def new_index(spark: SparkSession) -> DigestIndex:
    """An empty index of its own in the warehouse."""
    return DigestIndex(spark, f"lakeloom_digests_{uuid.uuid4().hex}")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Verdicts for one batch and an empty index."""
    return new_index(docs.sparkSession).ingest(docs, id_col, text_col)
