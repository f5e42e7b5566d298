"""Sessions: where frames come from."""

from __future__ import annotations

import json
from typing import Any

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from lakeloom.column import named
from lakeloom.frame import AsyncJob, Frame
from lakeloom.operators.flatten import flatten as flatten_rows
from lakeloom.sources.files import FileOperation
from lakeloom.sources.reader import Reader
from lakeloom.table import Table
from lakeloom.udf import UDAFs, UDFs, UDTFs, Procedures, TableCall


class Session:
    """Entry point over a Spark session."""

    _active: Session | None = None

    def __init__(self, spark: SparkSession | None = None):
        self.spark = spark or SparkSession.builder.getOrCreate()
        self.udf, self.udtf, self.udaf, self.sproc = UDFs(self.spark), UDTFs(self.spark), UDAFs(self.spark), Procedures(self.spark)
        self.file, self.catalog, self.lineage = FileOperation(self.spark), Catalog(self), Lineage()
        self._tag: str | None = None
        self._imports: dict[str, str] = {}
        self._packages: dict[str, str] = {}
        Session._active = self

    @staticmethod
    def get_active_session() -> Session | None:
        return Session._active

    @property
    def read(self) -> Reader:
        return Reader(self.spark)

    @property
    def conf(self):
        return self.spark.conf

    @property
    def session_id(self) -> str:
        return self.spark.sparkContext.applicationId

    # frames
    def table(self, name: Any) -> Table:
        return Table(self.spark, name if isinstance(name, str) else ".".join(name))

    def sql(self, query: str, params: Any = None) -> Frame:
        return Frame(self.spark.sql(query, args=params) if params else self.spark.sql(query))

    def range(self, start: int, end: int | None = None, step: int = 1) -> Frame:
        if end is None:
            start, end = 0, start
        return Frame(self.spark.range(start, end, step).toDF("ID"))

    def create_dataframe(self, data: Any, schema: Any = None) -> Frame:
        if isinstance(data, (list, tuple)) and data and not isinstance(data[0], (list, tuple, dict)) and not hasattr(data[0], "__fields__"):
            data = [(x,) for x in data]
            schema = schema or ["_1"]
        return Frame(self.spark.createDataFrame(data, schema))

    def write_pandas(self, frame: Any, table_name: str, mode: str = "append", **_: Any) -> Table:
        self.spark.createDataFrame(frame).write.mode(mode).saveAsTable(table_name)
        return self.table(table_name)

    def write_arrow(self, table: Any, table_name: str, mode: str = "append", **_: Any) -> Table:
        self.spark.createDataFrame(table).write.mode(mode).saveAsTable(table_name)
        return self.table(table_name)

    def generator(self, *columns: Any, rowcount: int, timelimit: int = 0) -> Frame:
        """``rowcount`` rows of the given expressions."""
        return Frame(self.spark.range(rowcount).select(*[named(c) for c in columns]))

    def table_function(self, function: Any, *arguments: Any, **named_arguments: Any) -> Frame:
        call = function if isinstance(function, TableCall) else TableCall(function, *arguments, **named_arguments)
        return Frame(call.joined(self.spark.range(1)).drop("id"))

    def flatten(self, input: Any, path: str | None = None, outer: bool = False, recursive: bool = False, mode: str = "BOTH") -> Frame:
        df = self.spark.range(1).select(named(input).alias("x"))
        return Frame(flatten_rows(df, F.col("x"), df.dtypes[0][1], outer, recursive, mode, path).drop("x"))

    def directory(self, path: str) -> Frame:
        return self.read.directory(path)

    # procedures and jobs
    def call(self, name: str, *arguments: Any) -> Any:
        return self.sproc.known[name](self, *arguments)

    def call_nowait(self, name: str, *arguments: Any) -> AsyncJob:
        return AsyncJob(self.spark, lambda: self.call(name, *arguments))

    def cancel_all(self) -> None:
        self.spark.interruptAll()

    def close(self) -> None:
        self.spark.stop()
        Session._active = None

    # context
    def use_database(self, name: str) -> None:
        self.spark.catalog.setCurrentCatalog(name)

    def use_schema(self, name: str) -> None:
        self.spark.catalog.setCurrentDatabase(name)

    def use_warehouse(self, name: str) -> None:
        """The scheduler pool of this thread's jobs."""
        self.spark.sparkContext.setLocalProperty("spark.scheduler.pool", name)

    def get_current_database(self) -> str:
        return self.spark.catalog.currentCatalog()

    def get_current_schema(self) -> str:
        return self.spark.catalog.currentDatabase()

    def get_current_user(self) -> str:
        return self.spark.range(1).select(F.current_user()).head()[0]

    def get_fully_qualified_current_schema(self) -> str:
        return f"{self.get_current_database()}.{self.get_current_schema()}"

    @property
    def query_tag(self) -> str | None:
        return self._tag

    @query_tag.setter
    def query_tag(self, tag: str | None) -> None:
        self._tag = tag
        self.spark.sparkContext.setJobDescription(tag or "")

    def append_query_tag(self, tag: str, separator: str = ",") -> None:
        self.query_tag = f"{self._tag}{separator}{tag}" if self._tag else tag

    def update_query_tag(self, tag: dict) -> None:
        self.query_tag = json.dumps({**json.loads(self._tag or "{}"), **tag})

    # code
    def add_import(self, path: str, import_path: str | None = None) -> None:
        self.spark.sparkContext.addPyFile(path)
        self._imports[path] = import_path or path

    def remove_import(self, path: str) -> None:
        del self._imports[path]

    def get_imports(self) -> list[str]:
        return list(self._imports)

    def clear_imports(self) -> None:
        self._imports.clear()

    def add_packages(self, *packages: Any) -> None:
        """Check that packages are installed where the driver runs."""
        import importlib.metadata

        for p in packages:
            name = p if isinstance(p, str) else p.__name__
            name = name.split("==")[0]
            self._packages[name] = importlib.metadata.version(name)

    def remove_package(self, package: str) -> None:
        del self._packages[package]

    def get_packages(self) -> dict[str, str]:
        return dict(self._packages)

    def clear_packages(self) -> None:
        self._packages.clear()

    createDataFrame, getActiveSession, useSchema, useDatabase = create_dataframe, get_active_session, use_schema, use_database


class Catalog:
    """Databases (catalogs), schemas, tables, views and functions."""

    def __init__(self, session: Session):
        self.session, self._c = session, session.spark.catalog

    def list_databases(self, pattern: str | None = None) -> list[str]:
        return [c.name for c in self._c.listCatalogs(pattern)]

    def list_schemas(self, pattern: str | None = None) -> list[str]:
        return [d.name for d in self._c.listDatabases(pattern)]

    def list_tables(self, schema: str | None = None, pattern: str | None = None) -> list[str]:
        return [t.name for t in self._c.listTables(schema, pattern) if t.tableType not in ("VIEW", "TEMPORARY")]

    def list_views(self, schema: str | None = None, pattern: str | None = None) -> list[str]:
        return [t.name for t in self._c.listTables(schema, pattern) if t.tableType in ("VIEW", "TEMPORARY")]

    def list_columns(self, table: str) -> list[str]:
        return [c.name for c in self._c.listColumns(table)]

    def list_procedures(self) -> list[str]:
        return list(self.session.sproc.known)

    def list_user_defined_functions(self, pattern: str | None = None) -> list[str]:
        return [*self.session.udf.known, *self.session.udaf.known, *self.session.udtf.known]

    def get_current_database(self) -> str:
        return self._c.currentCatalog()

    def get_current_schema(self) -> str:
        return self._c.currentDatabase()

    def get_schema(self, name: str):
        return self._c.getDatabase(name)

    def get_table(self, name: str):
        return self._c.getTable(name)

    get_view = get_table

    def get_user_defined_function(self, name: str):
        return self._c.getFunction(name)

    def set_current_database(self, name: str) -> None:
        self._c.setCurrentCatalog(name)

    def set_current_schema(self, name: str) -> None:
        self._c.setCurrentDatabase(name)

    def database_exists(self, name: str) -> bool:
        return name in self.list_databases()

    def schema_exists(self, name: str) -> bool:
        return self._c.databaseExists(name)

    def table_exists(self, name: str) -> bool:
        return self._c.tableExists(name) and self._c.getTable(name).tableType not in ("VIEW", "TEMPORARY")

    def view_exists(self, name: str) -> bool:
        return self._c.tableExists(name) and self._c.getTable(name).tableType in ("VIEW", "TEMPORARY")

    def procedure_exists(self, name: str) -> bool:
        return name in self.session.sproc.known

    def user_defined_function_exists(self, name: str) -> bool:
        return self._c.functionExists(name)

    def drop_schema(self, name: str) -> None:
        self.session.spark.sql(f"DROP SCHEMA IF EXISTS {name} CASCADE")

    def drop_table(self, name: str) -> None:
        self.session.spark.sql(f"DROP TABLE IF EXISTS {name}")

    def drop_view(self, name: str) -> None:
        self._c.dropTempView(name) or self.session.spark.sql(f"DROP VIEW IF EXISTS {name}")

    listDatabases, listSchemas, listTables, listViews, listColumns = list_databases, list_schemas, list_tables, list_views, list_columns
    currentDatabase, tableExists, databaseExists, functionExists = get_current_schema, table_exists, schema_exists, user_defined_function_exists


class Lineage:
    """Where a frame's rows come from, out of its analysed plan."""

    def trace(self, frame: Frame) -> list[str]:
        text = frame._spark_object._jdf.queryExecution().analyzed().toString()
        import re

        named_tables = re.findall(r"SubqueryAlias (\S+)", text)
        files = re.findall(r"Relation \[[^\]]*\] (\S+)", text)
        return sorted(set(named_tables) | set(files))
