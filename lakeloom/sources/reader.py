"""Reading tables, files and external databases."""

from __future__ import annotations

from typing import Any

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from lakeloom.column import named
from lakeloom.frame import Frame
from lakeloom.sources.dbapi import bounds_predicates, read_dbapi
from lakeloom.sources.writer import option


class Reader:
    """Options and schema of a read; nothing is read before an action."""

    def __init__(self, session: SparkSession):
        self.session, self._options, self._schema, self._format, self._metadata = session, {}, None, "parquet", []

    def schema(self, schema: Any) -> Reader:
        self._schema = schema
        return self

    def option(self, key: str, value: Any) -> Reader:
        name, value = option(key, value)
        self._options[name] = value
        return self

    def options(self, configs: dict | None = None, **kwargs: Any) -> Reader:
        for k, v in {**(configs or {}), **kwargs}.items():
            self.option(k, v)
        return self

    def format(self, name: str) -> Reader:
        self._format = name.lower()
        return self

    def with_metadata(self, *columns: Any) -> Reader:
        """Add columns of the file a row is from: ``file_path``, ``file_modification_time``, ``file_size``, ``row_index``."""
        self._metadata = list(columns)
        return self

    def load(self, path: Any = None) -> Frame:
        reader = self.session.read.format(self._format).options(**{k: str(v).lower() if isinstance(v, bool) else v for k, v in self._options.items()})
        if self._schema is not None:
            reader = reader.schema(self._schema)
        df = reader.load(path)
        if self._metadata:
            df = df.select(*[F.col(f"_metadata.{m}").alias(m) if isinstance(m, str) else named(m) for m in self._metadata], "*")
        return Frame(df)

    def csv(self, path: Any) -> Frame:
        return self.format("csv").load(path)

    def json(self, path: Any, variant: bool = False) -> Frame:
        """JSON lines, as columns or as one variant column."""
        return (self.option("singleVariantColumn", "value") if variant else self).format("json").load(path)

    def parquet(self, path: Any) -> Frame:
        return self.format("parquet").load(path)

    def orc(self, path: Any) -> Frame:
        return self.format("orc").load(path)

    def avro(self, path: Any) -> Frame:
        return self.format("avro").load(path)

    def xml(self, path: Any) -> Frame:
        if "rowTag" not in self._options:
            raise ValueError("XML needs the option rowTag")
        return self.format("xml").load(path)

    def text(self, path: Any) -> Frame:
        return self.format("text").load(path)

    def table(self, name: Any, time_travel_mode: str | None = None, timestamp: Any = None, version: Any = None, **_: Any) -> Frame:
        """A table, as of a version or time if its format keeps them."""
        from lakeloom.table import Table

        reader = self.session.read
        if version is not None:
            reader = reader.option("versionAsOf", version)
        if timestamp is not None:
            reader = reader.option("timestampAsOf", str(timestamp))
        name = name if isinstance(name, str) else ".".join(name)
        return Table(self.session, name, reader.table(name))

    def jdbc(self, url: str, table: str | None = None, query: str | None = None, column: str | None = None, lower_bound: Any = None, upper_bound: Any = None, num_partitions: int | None = None, predicates: list[str] | None = None, properties: dict | None = None, fetch_size: int = 100_000, **_: Any) -> Frame:
        """A database table or query by JDBC, read in ranges of a column or by predicates."""
        if (table is None) == (query is None):
            raise ValueError("give either table or query")
        properties = {**(properties or {}), "fetchsize": str(fetch_size)}
        source = table or f"({query}) q"
        if predicates:
            return Frame(self.session.read.jdbc(url, source, predicates=predicates, properties=properties))
        if column:
            return Frame(self.session.read.jdbc(url, source, column=column, lowerBound=lower_bound, upperBound=upper_bound, numPartitions=num_partitions or 1, properties=properties))
        return Frame(self.session.read.jdbc(url, source, properties=properties))

    def dbapi(self, create_connection: Any, table: str | None = None, query: str | None = None, column: str | None = None, lower_bound: Any = None, upper_bound: Any = None, num_partitions: int | None = None, predicates: list[str] | None = None, custom_schema: Any = None, fetch_size: int = 100_000, session_init_statement: Any = None, **_: Any) -> Frame:
        """A database through a DB-API connection that each task opens for its part."""
        if (table is None) == (query is None):
            raise ValueError("give either table or query")
        if predicates is None and column is not None:
            predicates = bounds_predicates(column, lower_bound, upper_bound, num_partitions or 1)
        return Frame(read_dbapi(self.session, create_connection, table, query, predicates, custom_schema, fetch_size, session_init_statement))

    def file(self, path: str) -> Frame:
        return Frame(self.session.read.format("binaryFile").load(path).select("path", "length", "modificationTime"))

    def directory(self, path: str) -> Frame:
        """Files below a folder, without their content."""
        out = self.session.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
        return Frame(out.select(F.col("path").alias("RELATIVE_PATH"), F.col("length").alias("SIZE"), F.col("modificationTime").alias("LAST_MODIFIED")))
