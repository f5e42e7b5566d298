"""Lazily evaluated frames over Spark DataFrames."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from lakeloom import functions as L
from lakeloom.column import Col, as_column, as_order, named, spark, unquoted
from lakeloom.operators import analytics as analytics_ops
from lakeloom.operators.asof import asof_join
from lakeloom.operators.distribution import distribution
from lakeloom.operators.flatten import flatten as flatten_rows
from lakeloom.operators.grouping import Grouped, GroupingSets, aggregate_expressions
from lakeloom.operators.sampling import sample as sample_rows
from lakeloom.operators.sampling import sample_by

#: Spellings of join types (fixed values).
JOINS = {
    "inner": "inner", "cross": "cross", "outer": "full_outer", "full": "full_outer", "fullouter": "full_outer", "left": "left_outer", "leftouter": "left_outer", "right": "right_outer", "rightouter": "right_outer", "semi": "left_semi",
    "leftsemi": "left_semi", "anti": "left_anti", "leftanti": "left_anti", "asof": "asof",
}

_threads = ThreadPoolExecutor(8, thread_name_prefix="lakeloom-async")


def join_kind(how: str | None) -> str:
    key = (how or "inner").lower().replace("_", "")
    if key not in JOINS:
        raise ValueError(f"unknown join type {how!r}")
    return JOINS[key]


def _flat(values: tuple) -> list:
    return [v for x in values for v in (x if isinstance(x, (list, tuple)) else [x])]


class AsyncJob:
    """An action that runs on another thread, under a tag by which it can be cancelled."""

    def __init__(self, session: SparkSession, action: Callable[[], Any], frame: Frame | None = None):
        import uuid

        self.session, self.frame, self.query_id = session, frame, f"lakeloom-{uuid.uuid4().hex}"

        def run():
            session.addTag(self.query_id)
            try:
                return action()
            finally:
                session.removeTag(self.query_id)

        self.future = _threads.submit(run)

    def is_done(self) -> bool:
        return self.future.done()

    def is_failed(self) -> bool:
        return self.future.done() and self.future.exception() is not None

    def status(self) -> str:
        return "RUNNING" if not self.is_done() else "FAILED_WITH_ERROR" if self.is_failed() else "SUCCESS"

    def cancel(self) -> None:
        self.session.interruptTag(self.query_id)

    def result(self, timeout: float | None = None) -> Any:
        return self.future.result(timeout)

    def to_df(self) -> Frame | None:
        return self.frame

    @property
    def query(self) -> str:
        return self.query_id


class Frame:
    """A relation that is computed when an action asks for it."""

    def __init__(self, df: DataFrame, alias: str | None = None):
        self._df, self._alias = spark(df), alias

    @property
    def _spark_object(self) -> DataFrame:
        return self._df

    @property
    def session(self) -> SparkSession:
        return self._df.sparkSession

    # schema
    @property
    def columns(self) -> list[str]:
        return self._df.columns

    @property
    def schema(self):
        return self._df.schema

    @property
    def dtypes(self):
        return self._df.dtypes

    def col(self, name: str) -> Col:
        return Col(F.col("*") if name == "*" else self._df[unquoted(name)], label=name)

    def __getitem__(self, item: Any):
        if isinstance(item, str):
            return self.col(item)
        if isinstance(item, int):
            return self.col(self.columns[item])
        if isinstance(item, (list, tuple)):
            return self.select(*item)
        return self.filter(item)

    def __getattr__(self, name: str):
        if name.startswith("_"):
            raise AttributeError(name)
        if name.lower() in {c.lower() for c in self._df.columns}:
            return self.col(name)
        raise AttributeError(f"no method or column {name}")

    def print_schema(self, level: int | None = None) -> None:
        self._df.printSchema(level)

    # projection
    def select(self, *columns: Any) -> Frame:
        from lakeloom.udf import TableCall

        out, calls = [], []
        for c in _flat(columns):
            if isinstance(c, TableCall):
                calls.append(c)
                out += [F.col(n) for n in c.output_names(self.session)]
            else:
                out.append(named(c))
        df = self._df
        for c in calls:
            df = c.joined(df)
        return Frame(df.select(*out))

    def select_expr(self, *exprs: Any) -> Frame:
        return Frame(self._df.selectExpr(*_flat(exprs)))

    def drop(self, *columns: Any) -> Frame:
        names = {(c if isinstance(c, str) else c.get_name()).strip('"').lower() for c in _flat(columns)}
        kept = [c for c in self.columns if c.lower() not in names]
        if not kept:
            raise ValueError("cannot drop all columns")
        return Frame(self._df.select(*[F.col(f"`{c}`") for c in kept]))

    def col_ilike(self, pattern: str) -> Frame:
        """Columns whose names match an ILIKE pattern."""
        regex = re.compile("".join(".*" if ch == "%" else "." if ch == "_" else re.escape(ch) for ch in pattern), re.I | re.S)
        return Frame(self._df.select(*[f"`{c}`" for c in self.columns if regex.fullmatch(c)]))

    def to_df(self, *names: Any) -> Frame:
        return Frame(self._df.toDF(*_flat(names)))

    def with_column(self, name: str, value: Any, keep_column_order: bool = False) -> Frame:
        return self.with_columns([name], [value], keep_column_order)

    def with_columns(self, names: list[str], values: list[Any], keep_column_order: bool = False) -> Frame:
        """Add columns; one that replaces another moves to the end unless its place is to be kept."""
        if len(names) != len(values):
            raise ValueError("as many names as values are needed")
        new = {n: as_column(v) for n, v in zip(names, values)}
        by_lower = {n.lower(): n for n in new}
        if keep_column_order:
            kept = [new[by_lower[c.lower()]].alias(by_lower[c.lower()]) if c.lower() in by_lower else F.col(f"`{c}`") for c in self.columns]
            have = {c.lower() for c in self.columns}
            return Frame(self._df.select(*kept, *[v.alias(n) for n, v in new.items() if n.lower() not in have]))
        return Frame(self._df.select(*[F.col(f"`{c}`") for c in self.columns if c.lower() not in by_lower], *[v.alias(n) for n, v in new.items()]))

    def with_column_renamed(self, existing: Any, new: str) -> Frame:
        name = existing if isinstance(existing, str) else existing.get_name()
        if name.strip('"').lower() not in {c.lower() for c in self.columns}:
            raise ValueError(f"no column {name}")
        return Frame(self._df.withColumnRenamed(name.strip('"'), new))

    def rename(self, column_or_mapper: Any, new_column: str | None = None) -> Frame:
        if isinstance(column_or_mapper, dict):
            out = self
            for old, new in column_or_mapper.items():
                out = out.with_column_renamed(old, new)
            return out
        return self.with_column_renamed(column_or_mapper, new_column)

    def alias(self, name: str) -> Frame:
        return Frame(self._df.alias(name), name)

    # rows
    def filter(self, condition: Any) -> Frame:
        return Frame(self._df.filter(condition if isinstance(condition, str) else as_column(condition)))

    def sort(self, *columns: Any, ascending: Any = None) -> Frame:
        orders = [as_order(c) for c in _flat(columns)]
        if not orders:
            raise ValueError("name at least one column")
        if ascending is not None:
            ways = ascending if isinstance(ascending, (list, tuple)) else [ascending] * len(orders)
            if len(ways) != len(orders):
                raise ValueError("as many directions as columns are needed")
            orders = [type(o)(o.key, bool(w), None) for o, w in zip(orders, ways)]
        return Frame(self._df.orderBy(*[o.column() for o in orders]))

    def limit(self, n: int, offset: int = 0) -> Frame:
        return Frame((self._df.offset(offset) if offset else self._df).limit(n))

    def distinct(self) -> Frame:
        return Frame(self._df.distinct())

    def drop_duplicates(self, *subset: Any) -> Frame:
        names = _flat(subset)
        return Frame(self._df.dropDuplicates(names) if names else self._df.distinct())

    def sample(self, frac: float | None = None, n: int | None = None, seed: int | None = None) -> Frame:
        return Frame(sample_rows(self._df, frac, n, seed))

    def random_split(self, weights: list[float], seed: int | None = None) -> list[Frame]:
        return [Frame(d) for d in self._df.randomSplit(weights, seed)]

    # groups
    def agg(self, *exprs: Any) -> Frame:
        return Frame(self._df.agg(*aggregate_expressions(exprs)))

    def _keys(self, columns: tuple) -> list:
        return [named(c) for c in _flat(columns)]

    def group_by(self, *columns: Any) -> Grouped:
        if len(columns) == 1 and isinstance(columns[0], GroupingSets):
            return self.group_by_grouping_sets(columns[0])
        return Grouped(self._df, self._keys(columns))

    def group_by_grouping_sets(self, *sets: Any) -> Grouped:
        chosen = sets[0] if len(sets) == 1 and isinstance(sets[0], GroupingSets) else GroupingSets(*sets)
        keys = {}
        for names, columns in zip(chosen.names, chosen.sets):
            for n, c in zip(names, columns):
                keys.setdefault(n if isinstance(n, str) else n.get_name(), c)
        return Grouped(self._df, list(keys.values()), "groupingSets", chosen.sets)

    def rollup(self, *columns: Any) -> Grouped:
        return Grouped(self._df, self._keys(columns), "rollup")

    def cube(self, *columns: Any) -> Grouped:
        return Grouped(self._df, self._keys(columns), "cube")

    def pivot(self, pivot_col: Any, values: Any = None, default_on_null: Any = None) -> Pivot:
        return Pivot(self, pivot_col, values, default_on_null)

    def unpivot(self, value_column: str, name_column: str, column_list: list[Any], include_nulls: bool = False) -> Frame:
        names = [c if isinstance(c, str) else c.get_name() for c in column_list]
        lower = {n.lower() for n in names}
        out = self._df.unpivot([c for c in self.columns if c.lower() not in lower], names, name_column, value_column)
        return Frame(out if include_nulls else out.filter(F.col(value_column).isNotNull()))

    # sets
    def union(self, other: Frame) -> Frame:
        """Rows of either, without duplicates."""
        return Frame(self._df.union(spark(other)).distinct())

    def union_all(self, other: Frame) -> Frame:
        return Frame(self._df.union(spark(other)))

    def union_by_name(self, other: Frame, allow_missing_columns: bool = False) -> Frame:
        return Frame(self._df.unionByName(spark(other), allow_missing_columns).distinct())

    def union_all_by_name(self, other: Frame, allow_missing_columns: bool = False) -> Frame:
        return Frame(self._df.unionByName(spark(other), allow_missing_columns))

    def intersect(self, other: Frame) -> Frame:
        return Frame(self._df.intersect(spark(other)))

    def except_(self, other: Frame) -> Frame:
        return Frame(self._df.subtract(spark(other)))

    # joins
    def join(self, right: Any, on: Any = None, how: str | None = None, lsuffix: str = "", rsuffix: str = "", match_condition: Any = None, directed: bool = False, using_columns: Any = None, join_type: str | None = None) -> Frame:
        """Join with a frame or a table function.

        ``on`` is a condition, or names of columns that both sides have, which
        come once and first. Other columns in both get the suffixes. An as-of
        join needs a ``match_condition``: (left column, operator, right column).
        """
        from lakeloom.udf import TableCall

        if isinstance(right, TableCall):
            return self.join_table_function(right)
        kind = join_kind(how or join_type)
        on = using_columns if on is None else on
        if right is self:
            raise ValueError("a frame cannot be joined with itself; give one side an alias")
        if (kind == "asof") != (match_condition is not None):
            raise ValueError("a match condition belongs to as-of joins, and they need one")
        rdf = spark(right)
        names = [on] if isinstance(on, str) else list(on) if isinstance(on, (list, tuple)) and all(isinstance(x, str) for x in on) else None
        if kind == "asof":
            lcol, op, rcol = match_condition
            label = lambda c: c if isinstance(c, str) else c.get_name()
            pairs = [(n, n) for n in names] if names else [(label(a), label(b)) for a, b in on] if isinstance(on, (list, tuple)) else []
            return Frame(asof_join(self._df, rdf, label(lcol), op, label(rcol), pairs, (lsuffix, rsuffix or "_r")))
        if kind in ("left_semi", "left_anti"):
            return Frame(self._df.join(rdf, names if names else self._condition(on), kind))
        keys = {n.lower() for n in names or []}
        shared = {c.lower() for c in self.columns} & {c.lower() for c in rdf.columns} - keys
        ldf = self._df
        if shared and (lsuffix or rsuffix):
            rename = lambda df, suffix: df.select(*[F.col(f"`{c}`").alias(c + suffix) if c.lower() in shared and suffix else F.col(f"`{c}`") for c in df.columns])
            if names is None and on is not None and not isinstance(on, (list, tuple)):
                joined = ldf.join(rdf, self._condition(on), kind)
                left = [ldf[f"`{c}`"].alias(c + lsuffix) if c.lower() in shared else ldf[f"`{c}`"] for c in ldf.columns]
                more = [rdf[f"`{c}`"].alias(c + rsuffix) if c.lower() in shared else rdf[f"`{c}`"] for c in rdf.columns]
                return Frame(joined.select(*left, *more))
            ldf, rdf = rename(ldf, lsuffix), rename(rdf, rsuffix)
        if kind == "cross" or on is None and names is None:
            return Frame(ldf.crossJoin(rdf))
        return Frame(ldf.join(rdf, names if names else self._condition(on), kind))

    @staticmethod
    def _condition(on: Any):
        if isinstance(on, (list, tuple)):
            out = F.lit(True)
            for c in on:
                out = out & as_column(c)
            return out
        return as_column(on)

    def natural_join(self, right: Frame, how: str | None = None, directed: bool = False) -> Frame:
        have = {c.lower() for c in spark(right).columns}
        shared = [c for c in self.columns if c.lower() in have]
        return Frame(self._df.join(spark(right), shared, join_kind(how))) if shared else self.cross_join(right)

    def cross_join(self, right: Frame, lsuffix: str = "", rsuffix: str = "", directed: bool = False) -> Frame:
        return self.join(right, None, "cross", lsuffix, rsuffix)

    def lateral_join(self, right: Frame, on: Any = None, lsuffix: str = "", rsuffix: str = "") -> Frame:
        """Join with a frame that refers to this one's columns through ``outer()``."""
        return Frame(self._df.lateralJoin(spark(right), None if on is None else as_column(on), "inner" if on is not None else "cross"))

    def join_table_function(self, func: Any, *arguments: Any, **named_arguments: Any) -> Frame:
        from lakeloom.udf import TableCall

        call = func if isinstance(func, TableCall) else TableCall(func, *arguments, **named_arguments)
        return Frame(call.joined(self._df))

    def flatten(self, input: Any, path: str | None = None, outer: bool = False, recursive: bool = False, mode: str = "BOTH") -> Frame:
        column = named(input)
        kind = self._df.select(column.alias("x")).dtypes[0][1]
        return Frame(flatten_rows(self._df, column, kind, outer, recursive, mode, path))

    # actions
    def collect(self, block: bool = True, **_: Any):
        return self._df.collect() if block else self.collect_nowait()

    def collect_nowait(self, **_: Any) -> AsyncJob:
        return AsyncJob(self.session, self._df.collect, self)

    def to_local_iterator(self, **_: Any) -> Iterator:
        return self._df.toLocalIterator(prefetchPartitions=True)

    def to_pandas(self, **_: Any):
        return self._df.toPandas()

    def to_pandas_batches(self, **_: Any) -> Iterator:
        for batch in self.to_arrow_batches():
            yield batch.to_pandas()

    def to_arrow(self, **_: Any):
        return self._df.toArrow()

    def to_arrow_batches(self, **_: Any) -> Iterator:
        yield from self._df.toArrow().to_batches()

    def to_pandas_on_spark(self, index_col: Any = None, columns: list[str] | None = None):
        """The pandas-compatible view of the frame."""
        df = self._df.select(*([index_col] if isinstance(index_col, str) else index_col or []), *columns) if columns else self._df
        return df.pandas_api(index_col)

    def count(self, block: bool = True, **_: Any):
        return self._df.count() if block else AsyncJob(self.session, self._df.count, self)

    def first(self, n: int | None = None, block: bool = True, **_: Any):
        return self._df.first() if n is None else self._df.collect() if n < 0 else self._df.take(n)

    take = first

    def show(self, n: int = 10, max_width: int = 50, **_: Any) -> None:
        self._df.show(n, max_width)

    def explain(self) -> None:
        self._df.explain("formatted")

    @property
    def queries(self) -> dict[str, list[str]]:
        return {"queries": [self._df._jdf.queryExecution().optimizedPlan().toString()], "post_actions": []}

    def get_execution_profile(self, output_file: str | None = None, verbose: bool = False) -> str:
        text = self._df._jdf.queryExecution().executedPlan().treeString() if not verbose else self._df._jdf.queryExecution().toString()
        if output_file:
            with open(output_file, "w") as f:
                f.write(text)
        return text

    def describe(self, *columns: Any, strings_include_math_stats: bool = False) -> Frame:
        """count, mean, stddev, min and max of numeric and string columns, a row for each."""
        names = _flat(columns) or [n for n, t in self.dtypes if t in ("string",) or t.startswith(("int", "bigint", "double", "float", "decimal", "small", "tiny"))]
        types = dict(self.dtypes)
        stats = {"count": F.count, "mean": F.mean, "stddev": F.stddev_samp, "min": F.min, "max": F.max}

        def value(stat: str, n: str):
            if types[n] == "string" and stat in ("mean", "stddev"):
                return stats[stat](F.col(n).try_cast("double")).cast("string") if strings_include_math_stats else F.lit(None).cast("string")
            return stats[stat](F.col(n)).cast("string")

        row = self._df.agg(F.array(*[F.struct(F.lit(s).alias("SUMMARY"), *[value(s, n).alias(n) for n in names]) for s in stats]).alias("rows"))
        out = row.select(F.explode("rows").alias("r")).select("r.*")
        return Frame(out.select("SUMMARY", *[F.col(n) if types[n] == "string" else F.col(n).cast("double").alias(n) for n in names]))

    def cache_result(self, **_: Any) -> Cached:
        """Compute once and keep on the executors, in memory and on disk."""
        df = self._df.persist(StorageLevel.MEMORY_AND_DISK)
        df.count()
        return Cached(df)

    def create_or_replace_temp_view(self, name: str, **_: Any) -> None:
        self._df.createOrReplaceTempView(name)

    def create_temp_view(self, name: str, **_: Any) -> None:
        self._df.createTempView(name)

    def create_or_replace_view(self, name: str, **_: Any) -> None:
        """A view for the session's lifetime under the name (a stored view needs SQL text)."""
        self._df.createOrReplaceTempView(name)

    def create_or_replace_dynamic_table(self, name: str, lag: str = "", mode: str = "overwrite", **_: Any) -> DynamicTable:
        return DynamicTable(self, name, lag, mode)

    def copy_into_table(self, table_name: str, target_columns: list[str] | None = None, transformations: list[Any] | None = None, **_: Any) -> None:
        """Append the (transformed) rows to a table, creating it if it is missing."""
        df = self._df.select(*[named(t) for t in transformations]) if transformations else self._df
        df = df.toDF(*target_columns) if target_columns else df
        if self.session.catalog.tableExists(table_name):
            df.select(*[c if c in df.columns else F.lit(None).alias(c) for c in self.session.table(table_name).columns]).write.insertInto(table_name)
        else:
            df.write.saveAsTable(table_name)

    # accessors
    @property
    def write(self):
        from lakeloom.sources.writer import Writer

        return Writer(self)

    @property
    def na(self) -> NA:
        return NA(self)

    @property
    def stat(self) -> Stat:
        return Stat(self)

    @property
    def analytics(self) -> Analytics:
        return Analytics(self)

    @property
    def ai(self) -> AI:
        return AI(self)

    def dropna(self, *args: Any, **kwargs: Any) -> Frame:
        return self.na.drop(*args, **kwargs)

    def fillna(self, *args: Any, **kwargs: Any) -> Frame:
        return self.na.fill(*args, **kwargs)

    def replace(self, *args: Any, **kwargs: Any) -> Frame:
        return self.na.replace(*args, **kwargs)

    # streaming
    def with_watermark(self, column: str, delay: str) -> Frame:
        return Frame(self._df.withWatermark(column, delay))

    where = filter
    selectExpr, groupBy, groupByGroupingSets, orderBy, order_by = select_expr, group_by, group_by_grouping_sets, sort, sort
    crossJoin, naturalJoin, lateralJoin, joinTableFunction = cross_join, natural_join, lateral_join, join_table_function
    dropDuplicates, unionAll, unionByName, unionAllByName, minus, subtract = drop_duplicates, union_all, union_by_name, union_all_by_name, except_, except_
    toDF, toPandas, toLocalIterator, toArrow = to_df, to_pandas, to_local_iterator, to_arrow
    withColumn, withColumns, withColumnRenamed, withWatermark = with_column, with_columns, with_column_renamed, with_watermark
    createOrReplaceTempView, createTempView, createOrReplaceView = create_or_replace_temp_view, create_temp_view, create_or_replace_view
    randomSplit, printSchema, cacheResult = random_split, print_schema, cache_result

    def approxQuantile(self, column: Any, probabilities: list[float]) -> Any:
        return self.stat.approx_quantile(column, probabilities)

    def corr(self, a: str, b: str) -> float:
        return self.stat.corr(a, b)

    def cov(self, a: str, b: str) -> float:
        return self.stat.cov(a, b)

    def crosstab(self, a: str, b: str) -> Frame:
        return self.stat.crosstab(a, b)

    def sampleBy(self, column: Any, fractions: dict, seed: int | None = None) -> Frame:
        return self.stat.sample_by(column, fractions, seed)


class Pivot:
    """A pivot that waits for its aggregate; all columns but the pivoted and the aggregated one are keys."""

    def __init__(self, frame: Frame, column: Any, values: Any, default: Any):
        self.frame, self.column, self.values, self.default = frame, column if isinstance(column, str) else column.get_name(), values, default

    def _run(self, function: str, value: str) -> Frame:
        gone = {self.column.lower(), value.lower()}
        keys = [c for c in self.frame.columns if c.lower() not in gone]
        grouped = Grouped(spark(self.frame), [F.col(f"`{k}`") for k in keys]).pivot(self.column, self.values, self.default)
        return grouped.agg(getattr(L, function)(value))

    def agg(self, expression: Any) -> Frame:
        if isinstance(expression, tuple):
            return self._run(expression[1], expression[0])
        raise ValueError("give the aggregate as (column, name)")


for _f in ("sum", "avg", "min", "max", "count"):
    setattr(Pivot, _f, lambda self, value, _f=_f: self._run(_f, value))


class Cached(Frame):
    """A computed frame; ``drop_table`` or leaving a ``with`` block frees it."""

    def drop_table(self) -> None:
        self._df.unpersist()

    def __enter__(self) -> Cached:
        return self

    def __exit__(self, *_: Any) -> None:
        self.drop_table()


class DynamicTable:
    """A table that is rebuilt from its frame; ``refresh`` swaps in the new rows."""

    def __init__(self, frame: Frame, name: str, lag: str, mode: str):
        self.frame, self.name, self.lag = frame, name, lag
        exists = frame.session.catalog.tableExists(name)
        if exists and mode == "errorifexists":
            raise ValueError(f"table {name} exists")
        if not (exists and mode == "ignore"):
            self.refresh()

    def refresh(self) -> None:
        spark(self.frame).write.mode("overwrite").saveAsTable(self.name)


class NA:
    """Missing values: null, and NaN in floating-point columns."""

    def __init__(self, frame: Frame):
        self.frame = frame

    def drop(self, how: str = "any", thresh: int | None = None, subset: Any = None) -> Frame:
        subset = [subset] if isinstance(subset, str) else subset
        if how not in ("any", "all"):
            raise ValueError("how is any or all")
        return Frame(spark(self.frame).na.drop(how, thresh, subset))

    def _fits(self, kind: str, value: Any, include_decimal: bool) -> bool:
        if isinstance(value, bool):
            return kind == "boolean"
        if isinstance(value, int):
            return kind in ("tinyint", "smallint", "int", "bigint", "float", "double") or include_decimal and kind.startswith("decimal")
        if isinstance(value, float):
            return kind in ("float", "double") or include_decimal and kind.startswith("decimal")
        if isinstance(value, str):
            return kind == "string"
        return True

    def fill(self, value: Any, subset: Any = None, include_decimal: bool = False) -> Frame:
        """Replace missing values in columns that the value's type fits."""
        df = spark(self.frame)
        subset = [subset] if isinstance(subset, str) else subset
        values = value if isinstance(value, dict) else dict.fromkeys(subset or df.columns, value)
        by_lower = {k.lower(): v for k, v in values.items()}
        out = []
        for c, kind in df.dtypes:
            if c.lower() in by_lower and self._fits(kind, by_lower[c.lower()], include_decimal):
                column = F.nanvl(F.col(f"`{c}`"), F.lit(None)) if kind in ("float", "double") else F.col(f"`{c}`")
                out.append(F.coalesce(column, F.lit(by_lower[c.lower()]).cast(kind)).alias(c))
            else:
                out.append(F.col(f"`{c}`"))
        return Frame(df.select(*out))

    def replace(self, to_replace: Any, value: Any = None, subset: Any = None, include_decimal: bool = False) -> Frame:
        """Replace values by others; ``to_replace`` may be a dict, a list (with one or as many values), or None for nulls."""
        if not isinstance(to_replace, dict):
            olds = list(to_replace) if isinstance(to_replace, (list, tuple)) else [to_replace]
            news = list(value) if isinstance(value, (list, tuple)) else [value] * len(olds)
            to_replace = dict(zip(olds, news))
        df = spark(self.frame)
        subset = {s.lower() for s in ([subset] if isinstance(subset, str) else subset or df.columns)}
        out = []
        for c, kind in df.dtypes:
            column = F.col(f"`{c}`")
            new = None
            if c.lower() in subset:
                for old, value in to_replace.items():
                    if (old is None or self._fits(kind, old, include_decimal)) and (value is None or self._fits(kind, value, include_decimal)):
                        hit = column.isNull() if old is None else F.isnan(column) if isinstance(old, float) and old != old else column == F.lit(old)
                        put = F.lit(value).cast(kind)
                        new = F.when(hit, put) if new is None else new.when(hit, put)
            out.append((new.otherwise(column) if new is not None else column).alias(c))
        return Frame(df.select(*out))


class Stat:
    """Statistics over columns."""

    def __init__(self, frame: Frame):
        self.frame = frame

    def approx_quantile(self, column: Any, percentile: list[float], error: float = 0.001) -> Any:
        columns = [column] if isinstance(column, str) else column
        out = spark(self.frame).approxQuantile(columns, list(percentile), error)
        return out[0] if isinstance(column, str) else out

    def corr(self, a: str, b: str) -> float | None:
        return spark(self.frame).agg(F.corr(a, b)).head()[0]

    def cov(self, a: str, b: str) -> float | None:
        return spark(self.frame).agg(F.covar_samp(a, b)).head()[0]

    def crosstab(self, a: str, b: str, most: int = 1000) -> Frame:
        """Counts of pairs of values; refused beyond ``most`` distinct values of the second column."""
        df = spark(self.frame)
        values = [r[0] for r in df.select(b).distinct().limit(most + 1).collect()]
        if len(values) > most:
            raise ValueError(f"more than {most} distinct values in {b}")
        return Frame(df.groupBy(a).pivot(b, sorted(v for v in values if v is not None)).count().na.fill(0))

    def sample_by(self, column: Any, fractions: dict, seed: int | None = None) -> Frame:
        return Frame(sample_by(spark(self.frame), named(column), fractions, seed))

    approxQuantile, sampleBy = approx_quantile, sample_by


class Analytics:
    """Window analytics over named columns."""

    def __init__(self, frame: Frame):
        self.frame = frame

    def moving_agg(self, aggs: dict, window_sizes: list[int], order_by: list[str], group_by: list[str], col_formatter: Any = analytics_ops.default_name) -> Frame:
        return Frame(analytics_ops.moving_agg(spark(self.frame), aggs, window_sizes, order_by, group_by, col_formatter))

    def cumulative_agg(self, aggs: dict, group_by: list[str], order_by: list[str], is_forward: bool, col_formatter: Any = analytics_ops.default_name) -> Frame:
        return Frame(analytics_ops.cumulative_agg(spark(self.frame), aggs, group_by, order_by, is_forward, col_formatter))

    def compute_lag(self, cols: list, lags: list[int], order_by: list[str], group_by: list[str], col_formatter: Any = analytics_ops.default_name) -> Frame:
        return Frame(analytics_ops.shifted(spark(self.frame), cols, lags, order_by, group_by, False, col_formatter))

    def compute_lead(self, cols: list, leads: list[int], order_by: list[str], group_by: list[str], col_formatter: Any = analytics_ops.default_name) -> Frame:
        return Frame(analytics_ops.shifted(spark(self.frame), cols, leads, order_by, group_by, True, col_formatter))

    def time_series_agg(self, time_col: str, aggs: dict, windows: list[str], group_by: list[str], sliding_interval: str = "", col_formatter: Any = analytics_ops.default_name) -> Frame:
        return Frame(analytics_ops.time_series_agg(spark(self.frame), time_col, aggs, windows, group_by, col_formatter))

    def distribution(self, group_by: Any, order_by: Any, percent_rank: str | None = "percent_rank", cume_dist: str | None = "cume_dist") -> Frame:
        """Add ``percent_rank`` and ``cume_dist`` within ``group_by`` by ``order_by``, under these names, where a group need not fit a task."""
        keys, orders = ([*c] if isinstance(c, (list, tuple)) else [c] for c in (group_by, order_by))
        return Frame(distribution(spark(self.frame), [named(k) for k in keys], [as_order(o) for o in orders], percent_rank, cume_dist))


class AI:
    """Model calls that add a column; see :mod:`lakeloom.functions.models`."""

    def __init__(self, frame: Frame):
        self.frame = frame

    def __getattr__(self, task: str):
        if task.startswith("_"):
            raise AttributeError(task)

        def call(*columns: Any, output_column: str | None = None, **options: Any) -> Frame:
            function = getattr(L, task if task.startswith("split_text") else f"ai_{task}")
            value = function(*columns, **options)
            return self.frame.with_column(output_column or f"{task.upper()}_OUTPUT", value)

        return call

    def filter(self, *columns: Any) -> Frame:
        return self.frame.filter(L.ai_filter(*columns))
