"""User-defined functions, aggregates, table functions and procedures."""

from __future__ import annotations

import importlib.util
from collections.abc import Callable
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeloom.column import Col, as_column, named, unquoted


def from_file(path: str, name: str) -> Any:
    """An object of a Python file."""
    spec = importlib.util.spec_from_file_location("lakeloom_user_module", path)
    module = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(module)
    return getattr(module, name)


class Function:
    """A callable over columns."""

    def __init__(self, spark_function: Callable, name: str | None, return_type: Any, kind: str):
        self.spark_function, self.name, self.return_type, self.kind = spark_function, name, return_type, kind

    def __call__(self, *columns: Any) -> Col:
        return Col(self.spark_function(*[named(c) for c in columns]))


class Registry:
    """Registration of one kind of function; names can be used in SQL."""

    def __init__(self, session: SparkSession):
        self.session, self.known = session, {}

    def _keep(self, f: Function) -> Function:
        if f.name:
            self.known[f.name] = f
        return f

    def describe(self, f: Function) -> dict[str, Any]:
        return {"name": f.name, "kind": f.kind, "returns": str(f.return_type)}

    def register_from_file(self, file_path: str, handler_name: str, *args: Any, **kwargs: Any):
        return self.register(from_file(file_path, handler_name), *args, **kwargs)


class UDFs(Registry):
    def register(self, func: Callable, return_type: Any = "string", input_types: Any = None, name: str | None = None, vectorized: bool = False, **_: Any) -> Function:
        """A scalar function; ``vectorized`` ones take and return pandas series, in Arrow batches."""
        made = F.pandas_udf(func, return_type) if vectorized else F.udf(func, return_type, useArrow=True)
        if name:
            self.session.udf.register(name, made)
        return self._keep(Function(made, name, return_type, "UDF"))


class UDAFs(Registry):
    def register(self, handler: type, return_type: Any = "double", input_types: Any = None, name: str | None = None, **_: Any) -> Function:
        """An aggregate class with ``accumulate`` (row by row), ``merge``, ``finish`` and ``aggregate_state``."""

        def run(*columns: pd.Series) -> Any:
            state = handler()
            for row in zip(*columns):
                state.accumulate(*row)
            return state.finish()

        # Spark reads the kind of a pandas UDF off its annotations: series in, a scalar out
        if len(input_types or [None]) <= 1:

            def one(a: pd.Series) -> float:
                return run(a)

            made = F.pandas_udf(one, return_type, F.PandasUDFType.GROUPED_AGG)
        else:
            made = F.pandas_udf(run, return_type, F.PandasUDFType.GROUPED_AGG)
        if name:
            self.session.udf.register(name, made)
        return self._keep(Function(made, name, return_type, "UDAF"))

    def aggregate(self, frame: Any, handler: type, keys: list[str], columns: list[str], return_type: str, name: str = "value"):
        """The aggregate in two steps, partial states first, so that a large group is spread over tasks."""
        import pickle

        from lakeloom.frame import Frame

        df = frame._spark_object if isinstance(frame, Frame) else frame

        def partial(batches):
            states: dict[tuple, Any] = {}
            for pdf in batches:
                for row in pdf.itertuples(index=False):
                    key = tuple(row[: len(keys)])
                    if key not in states:
                        states[key] = handler()
                    states[key].accumulate(*row[len(keys) :])
            if states:
                yield pd.DataFrame([(*k, pickle.dumps(s.aggregate_state)) for k, s in states.items()], columns=[*keys, "state"])

        def finish(pdf: pd.DataFrame) -> pd.DataFrame:
            out = handler()
            for state in pdf["state"]:
                out.merge(pickle.loads(state))
            return pd.DataFrame([(*pdf.iloc[0][keys], out.finish())], columns=[*keys, name])

        types = dict(df.dtypes)
        key_schema = "".join(f"`{k}` {types[k]}, " for k in keys)
        states = df.select(*keys, *columns).mapInPandas(partial, f"{key_schema}state binary")
        return Frame(states.groupBy(*keys).applyInPandas(finish, f"{key_schema}`{name}` {return_type}"))


class TableCall:
    """A call of a table function, with partitioning and order of its input."""

    def __init__(self, function: Any, *arguments: Any, **named_arguments: Any):
        self.function, self.arguments, self.named_arguments = function, arguments, named_arguments
        self.partitions: list[Any] = []
        self.orders: list[Any] = []
        self.names: list[str] | None = None

    def over(self, partition_by: Any = None, order_by: Any = None) -> TableCall:
        as_list = lambda x: [] if x is None else list(x) if isinstance(x, (list, tuple)) else [x]
        self.partitions, self.orders = as_list(partition_by), as_list(order_by)
        return self

    def alias(self, *names: str) -> TableCall:
        self.names = list(names)
        return self

    as_ = alias

    def _table(self, session: SparkSession) -> DataFrame:
        arguments = [as_column(a) if not isinstance(a, str) else F.col(unquoted(a)) for a in self.arguments]
        if isinstance(self.function, TableFunction):
            return self.function.handler(*[a.outer() for a in arguments])
        return getattr(session.tvf, self.function)(*[a.outer() for a in arguments])

    def output_names(self, session: SparkSession) -> list[str]:
        if self.names:
            return self.names
        if isinstance(self.function, TableFunction):
            return self.function.names
        return {"explode": ["col"], "posexplode": ["pos", "col"], "split_to_table": ["SEQ", "INDEX", "VALUE"], "flatten": ["INDEX", "VALUE"]}[self.function]

    def joined(self, df: DataFrame) -> DataFrame:
        """The frame's rows with the function's output for each."""
        if self.function == "split_to_table":
            text, separator = self.arguments
            names = self.output_names(df.sparkSession)
            import re

            separator = re.escape(separator) if isinstance(separator, str) else separator
            rows = df.withColumn(names[0], F.monotonically_increasing_id())
            return rows.select("*", F.posexplode(F.split(named(text), separator, -1)).alias("__i", names[2])).select(*rows.columns, (F.col("__i") + 1).alias(names[1]), names[2])
        if self.function == "flatten":
            names = self.output_names(df.sparkSession)
            return df.select("*", F.posexplode(named(self.arguments[0] if self.arguments else self.named_arguments["input"])).alias(*names))
        if self.partitions and isinstance(self.function, TableFunction):
            return self.function.partitioned(df, self.arguments, self.partitions, self.orders)
        out = self._table(df.sparkSession)
        return df.lateralJoin(out.toDF(*self.names) if self.names else out)


class TableFunction:
    def __init__(self, handler: Any, names: list[str], cls: type, schema: str):
        self.handler, self.names, self.cls, self.schema = handler, names, cls, schema

    def __call__(self, *arguments: Any, **named_arguments: Any) -> TableCall:
        return TableCall(self, *arguments, **named_arguments)

    def partitioned(self, df: DataFrame, arguments: tuple, keys: list, orders: list) -> DataFrame:
        """Each partition's rows go through one instance, in order; ``end_partition`` may add rows."""
        cls, n = self.cls, len(arguments)
        key_names = [f"__k{i}" for i in range(len(keys))]
        order_names = [f"__o{i}" for i in range(len(orders))]
        rows = df.select(*[named(k).alias(a) for k, a in zip(keys, key_names)], *[named(o).alias(a) for o, a in zip(orders, order_names)], *[named(a).alias(f"__a{i}") for i, a in enumerate(arguments)])
        names = self.names

        def run(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values(order_names) if order_names else pdf
            worker, out = cls(), []
            for row in pdf[[f"__a{i}" for i in range(n)]].itertuples(index=False):
                out += list(worker.process(*row) or [])
            if hasattr(worker, "end_partition"):
                out += list(worker.end_partition() or [])
            made = pd.DataFrame(out, columns=names)
            for k in key_names:
                made.insert(0, k, pdf[k].iloc[0])
            return made[[*key_names, *names]]

        types = dict(rows.dtypes)
        labels = [k if isinstance(k, str) else k.get_name() or f"key{i}" for i, k in enumerate(keys)]
        schema = "".join(f"{k} {types[k]}, " for k in key_names) + self.schema
        return rows.groupBy(*key_names).applyInPandas(run, schema).toDF(*labels, *names)


class UDTFs(Registry):
    def register(self, handler: type, output_schema: Any, input_types: Any = None, name: str | None = None, **_: Any) -> TableFunction:
        """A class with ``process`` (yields rows for a row) and perhaps ``end_partition``."""
        schema = output_schema if isinstance(output_schema, str) else ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in output_schema.fields)

        class Spark:
            def __init__(self):
                self.inner = handler()

            def eval(self, *args):
                yield from self.inner.process(*args) or []

            def terminate(self):
                if hasattr(self.inner, "end_partition"):
                    yield from self.inner.end_partition() or []

        made = F.udtf(Spark, returnType=schema)
        if name:
            self.session.udtf.register(name, made)
        names = [f.name for f in self.session.createDataFrame([], schema).schema.fields]
        out = TableFunction(made, names, handler, schema)
        if name:
            self.known[name] = out
        return out


class Procedures(Registry):
    def register(self, func: Callable, return_type: Any = None, input_types: Any = None, name: str | None = None, **_: Any) -> Callable:
        """A Python function whose first argument is the session; ``Session.call`` runs it by name."""
        name = name or func.__name__
        self.known[name] = func
        return lambda *args, session=None: func(session, *args)
