"""The corpus pipeline: quality rules, exact dedup, near-duplicate removal, packing.

Each stage takes (spark, docs, sf_dir) and works on everything its predecessor
kept. Verdicts belong to rows: null ids stay rows of their own, and rows that
share an id are judged one by one. :func:`run` writes each stage's result as Parquet in the shared folder
and reads it back as the next stage's documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeloom.llm import exact_dedup, ngram_join, packing, quality
from lakeloom.llm.common import materialize, table


def keyed(docs: DataFrame) -> DataFrame:
    """With ``row_key``, which tells rows of one id apart by their texts and is never null."""
    return docs.withColumn("row_key", F.xxhash64("doc_id", "text"))


def with_key(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose key is in ``kept``."""
    return keyed(docs).join(kept.select("row_key").hint("merge"), "row_key", "left_semi").select(docs.columns)


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the quality rules keep, each judged by its own text, whatever its id."""
    return with_key(docs, quality.quality_rules(keyed(docs), id_col="row_key").filter("kept"))


def exact_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each text: that of the smallest id, a null one only if there is no other.

    Of rows with the same id and text, the one whose columns come first in order stays.
    """
    kept = exact_dedup.exact_dedup(docs).filter("kept").select(F.col("doc_id").alias("keep_id"), F.col("digest").alias("keep_digest")).distinct()
    digest = F.unhex(F.sha2(exact_dedup.normalised(F.col("text")).cast("binary"), 256))
    rows = docs.withColumn("text_digest", digest)
    rows = rows.join(kept.hint("merge"), (F.col("text_digest") == F.col("keep_digest")) & F.col("doc_id").eqNullSafe(F.col("keep_id")), "left_semi")
    # a text has one id here, so its digest names the group
    return rows.groupBy("text_digest").agg(F.min(F.struct(*docs.columns)).alias("row")).select("row.*")


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row, that of the smallest id, of each group that links of similar texts hold together.

    Null ids come last; of one id's rows in a group the one with the smallest key stays.
    """
    ids = keyed(docs).select("row_key", "doc_id")
    groups = ngram_join.ngram_join(keyed(docs), id_col="row_key").select("row_key", "component_id")
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row_key"))["row_key"]
    return with_key(docs, groups.join(ids.hint("merge"), "row_key").groupBy("component_id").agg(first.alias("row_key")))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all remaining documents in sequences of 1024 tokens."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("quality rules", quality_stage),
    ("exact dedup", exact_dedup_stage),
    ("n-gram Jaccard join", near_dedup_stage),
    ("packing", packing_stage),
]

#: SQL can express neither the quality model nor the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
    return docs
