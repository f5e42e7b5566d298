"""Writing frames to tables and files."""

from __future__ import annotations

from typing import Any

from pyspark.sql import functions as F

from lakeloom.column import named, spark

MODES = {"append": "append", "overwrite": "overwrite", "truncate": "truncate", "errorifexists": "errorifexists", "error": "errorifexists", "ignore": "ignore"}
#: Option names of other dialects and Spark's (fixed values).
OPTIONS = {"field_delimiter": "sep", "delimiter": "sep", "record_delimiter": "lineSep", "skip_header": "header", "parse_header": "header", "null_if": "nullValue", "date_format": "dateFormat", "timestamp_format": "timestampFormat", "field_optionally_enclosed_by": "quote", "compression": "compression", "encoding": "encoding", "escape": "escape", "strip_outer_array": "multiLine", "infer_schema": "inferSchema", "pattern": "pathGlobFilter"}


def option(key: str, value: Any) -> tuple[str, Any]:
    name = OPTIONS.get(key.lower(), key)
    if name == "header" and not isinstance(value, bool) and str(value).isdigit():
        value = int(value) > 0
    return name, value


class Writer:
    def __init__(self, frame: Any):
        self.frame, self._mode, self._options, self._format, self._by = frame, "errorifexists", {}, "csv", None

    def mode(self, save_mode: str) -> Writer:
        if save_mode.lower() not in MODES:
            raise ValueError(f"unknown save mode {save_mode!r}")
        self._mode = MODES[save_mode.lower()]
        return self

    def option(self, key: str, value: Any) -> Writer:
        name, value = option(key, value)
        self._options[name] = value
        return self

    def options(self, configs: dict | None = None, **kwargs: Any) -> Writer:
        for k, v in {**(configs or {}), **kwargs}.items():
            self.option(k, v)
        return self

    def format(self, name: str) -> Writer:
        self._format = name.lower()
        return self

    def partition_by(self, expr: Any) -> Writer:
        """A column, or an expression whose value becomes the folder."""
        self._by = expr
        return self

    def save_as_table(self, table_name: Any, mode: str | None = None, column_order: str = "index", table_type: str = "", table_exists: bool | None = None, **_: Any) -> None:
        """Create or change a table; ``truncate`` keeps its schema, ``column_order="name"`` matches columns by name."""
        name = table_name if isinstance(table_name, str) else ".".join(table_name)
        df, session = spark(self.frame), self.frame.session
        mode = MODES[mode.lower()] if mode else self._mode
        if table_type in ("temp", "temporary"):
            df.createOrReplaceTempView(name)
            return
        exists = session.catalog.tableExists(name) if table_exists is None else table_exists
        if exists and mode in ("append", "truncate"):
            target = session.table(name).columns
            df = df.select(*target) if column_order == "name" else df.toDF(*target)
            df.write.insertInto(name, overwrite=mode == "truncate")
            return
        df.write.mode("errorifexists" if mode in ("append", "truncate") else mode).options(**{k: str(v) for k, v in self._options.items()}).saveAsTable(name)

    def insert_into(self, table_name: str, overwrite: bool = False) -> None:
        spark(self.frame).write.insertInto(table_name, overwrite)

    def save(self, location: str, **options: Any) -> None:
        df = spark(self.frame)
        for k, v in options.items():
            if k in ("header",):
                self._options["header"] = v
        writer = None
        if self._by is not None:
            label = self._by if isinstance(self._by, str) and self._by in df.columns else "part"
            df = df if label != "part" else df.withColumn("part", F.expr(self._by) if isinstance(self._by, str) else named(self._by))
            writer = df.write.partitionBy(label)
        writer = (writer or df.write).format(self._format).mode("overwrite" if self._mode == "truncate" else self._mode)
        writer.options(**{k: (str(v).lower() if isinstance(v, bool) else v) for k, v in self._options.items()}).save(location)

    def copy_into_location(self, location: str, file_format_type: str | None = None, partition_by: Any = None, format_type_options: dict | None = None, header: bool = False, overwrite: bool = False, **_: Any) -> None:
        self._format = (file_format_type or self._format).lower()
        self._by = partition_by if partition_by is not None else self._by
        self._mode = "overwrite" if overwrite else self._mode
        self.options({**(format_type_options or {}), "header": header}).save(location)

    def csv(self, location: str, **options: Any) -> None:
        self.format("csv").save(location, **options)

    def json(self, location: str, **options: Any) -> None:
        self.format("json").save(location, **options)

    def parquet(self, location: str, **options: Any) -> None:
        self.format("parquet").save(location, **options)

    def orc(self, location: str, **options: Any) -> None:
        self.format("orc").save(location, **options)

    def xml(self, location: str, **options: Any) -> None:
        self.format("xml").save(location, **options)

    saveAsTable, insertInto, partitionBy = save_as_table, insert_into, partition_by
