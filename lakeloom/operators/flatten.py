"""FLATTEN: one row for each element of an array, map or variant."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def flatten(frame: DataFrame, column: Column, kind: str, outer: bool = False, recursive: bool = False, mode: str = "BOTH", path: str | None = None) -> DataFrame:
    """The frame's columns and ``SEQ``, ``KEY``, ``PATH``, ``INDEX``, ``VALUE``, ``THIS``.

    ``kind`` is the column's simple type. ``mode`` limits the result to objects
    (maps) or arrays. Variants open one level; with ``recursive``, JSON text
    opens all levels that it has, level by level.
    """
    rows = frame.withColumn("SEQ", F.monotonically_increasing_id()).withColumn("THIS", column)
    if path:
        rows = rows.withColumn("THIS", F.col(f"THIS.{path}") if not kind.startswith("variant") else F.try_variant_get("THIS", "$." + path, "variant"))
    this = F.col("THIS")
    if kind.startswith("array"):
        empty = mode.upper() == "OBJECT"
        out = rows.filter(F.lit(not empty)).select("*", (F.posexplode_outer if outer else F.posexplode)(this).alias("INDEX", "VALUE"))
        out = out.withColumn("KEY", F.lit(None).cast("string")).withColumn("PATH", F.concat(F.lit("["), F.col("INDEX").cast("string"), F.lit("]")))
    elif kind.startswith("map"):
        empty = mode.upper() == "ARRAY"
        out = rows.filter(F.lit(not empty)).select("*", (F.explode_outer if outer else F.explode)(this).alias("KEY", "VALUE"))
        out = out.withColumn("INDEX", F.lit(None).cast("int")).withColumn("PATH", F.col("KEY").cast("string"))
    else:
        text = F.to_json(this) if kind.startswith("variant") else this
        rows = rows.withColumn("THIS", text)
        out = _level(rows, F.col("THIS"), F.lit(""), outer, mode)
        if recursive:
            level, levels = out, [out]
            while True:
                deeper = level.filter(F.col("VALUE").rlike(r"^\s*[\[{]")).drop("KEY", "INDEX")
                if deeper.isEmpty():
                    break
                level = _level(deeper.withColumnRenamed("PATH", "UP").withColumn("THIS", F.col("VALUE")).drop("VALUE"), F.col("THIS"), F.col("UP"), False, mode).drop("UP")
                levels.append(level)
            for more in levels[1:]:
                out = out.unionByName(more)
    return out.select(*frame.columns, "SEQ", "KEY", "PATH", "INDEX", "VALUE", "THIS")


def _level(rows: DataFrame, text: Column, prefix: Column, outer: bool, mode: str) -> DataFrame:
    array = F.transform(F.from_json(text, "array<string>"), lambda v, i: F.struct(F.lit(None).cast("string").alias("KEY"), i.alias("INDEX"), v.alias("VALUE")))
    members = F.transform(F.map_entries(F.from_json(text, "map<string,string>")), lambda e: F.struct(e["key"].alias("KEY"), F.lit(None).cast("int").alias("INDEX"), e["value"].alias("VALUE")))
    is_array = F.trim(text).startswith("[")
    if mode.upper() == "ARRAY":
        entries = F.when(is_array, array)
    elif mode.upper() == "OBJECT":
        entries = F.when(~is_array, members)
    else:
        entries = F.when(is_array, array).otherwise(members)
    out = rows.select("*", (F.explode_outer if outer else F.explode)(entries).alias("e")).select("*", "e.KEY", "e.INDEX", "e.VALUE").drop("e")
    here = F.when(F.col("KEY").isNull(), F.concat(prefix, F.lit("["), F.col("INDEX").cast("string"), F.lit("]"))).otherwise(F.concat(prefix, F.when(prefix == "", F.lit("")).otherwise(F.lit(".")), F.col("KEY")))
    return out.withColumn("PATH", here)
