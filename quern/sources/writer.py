"""Writing tables and files."""

from __future__ import annotations

from typing import TYPE_CHECKING

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quern.errors import AnalysisException, TableExistsError, UnsupportedFeatureError
from quern.tables.format import with_id

if TYPE_CHECKING:
    from quern.session import Session

_MODES = {"append": "append", "overwrite": "overwrite", "error": "error", "errorifexists": "error", "default": "error", "ignore": "ignore"}


class DataFrameWriter:
    """`session.write(df)`: how rows go into a table, or out to files."""

    def __init__(self, session: Session, data: DataFrame) -> None:
        self._session, self._data, self._mode, self._format = session, data, "error", "table"
        self._options: dict[str, object] = {}
        self._partition: list[str] = []
        self._order: list[str] = []
        self._properties: dict[str, str] = {}

    def mode(self, saveMode: str) -> DataFrameWriter:
        if saveMode.lower() not in _MODES:
            raise AnalysisException(f"unknown save mode {saveMode}; modes: {', '.join(_MODES)}")
        self._mode = _MODES[saveMode.lower()]
        return self

    def format(self, source: str) -> DataFrameWriter:
        self._format = source.lower()
        return self

    def option(self, key: str, value) -> DataFrameWriter:
        self._options[key] = value
        return self

    def options(self, **options) -> DataFrameWriter:
        self._options.update(options)
        return self

    def partitionBy(self, *cols: str) -> DataFrameWriter:
        """Partition terms of a new table; an existing one keeps its own."""
        self._partition = list(cols)
        return self

    partitionedBy = partitionBy

    def sortBy(self, *cols: str) -> DataFrameWriter:
        """The ascending sort order of a new table."""
        self._order = list(cols)
        return self

    def tableProperty(self, key: str, value: str) -> DataFrameWriter:
        self._properties[key] = str(value)
        return self

    def _option(self, name: str):
        found = [v for k, v in self._options.items() if k.rsplit(".", 1)[-1].lower() == name.lower()]
        return found[-1] if found else None

    def saveAsTable(self, name: str) -> None:
        """Create the table if it is missing; otherwise do as the mode says."""
        store, where = self._session.store, self._session.resolve(name)
        if store.exists(where):
            if self._mode == "error":
                raise TableExistsError(f"table {where} exists already")
            if self._mode != "ignore":
                self._into(where, self._mode == "overwrite", by_name=True)
            return
        schema = self._data.schema
        voids = [f.name for f in schema if f.dataType.typeName() == "void"]
        if voids:
            raise AnalysisException(f"columns without a type: {', '.join(voids)}")
        relaxed = StructType([type(f)(f.name, f.dataType, True, f.metadata) for f in schema])
        store.create(where, relaxed, self._partition, self._order, self._properties)
        store.append(where, self._data)

    def insertInto(self, tableName: str, overwrite: bool = False) -> None:
        """Into an existing table, by position."""
        where = self._session.resolve(tableName)
        width = len(self._session.store.load(where).schema)
        if len(self._data.columns) != width:
            raise AnalysisException(f"{where} has {width} columns, the data {len(self._data.columns)}")
        self._into(where, overwrite or self._mode == "overwrite", by_name=False)

    def _into(self, where, overwrite: bool, by_name: bool) -> None:
        store, data = self._session.store, self._data
        if str(self._option("mergeSchema")).lower() == "true":
            merge_schema(store, where, data.schema)
        if by_name:
            data = conform(data, store.load(where).schema, missing_ok=str(self._option("mergeSchema")).lower() == "true")
        if overwrite:
            chosen = self._option("partitionOverwriteMode") or self._session.spark.conf.get("spark.sql.sources.partitionOverwriteMode", "static")
            store.overwrite(where, data, dynamic=str(chosen).lower() == "dynamic")
        else:
            store.append(where, data)

    def save(self, path: str | None = None) -> None:
        """Files, by Spark's own writer."""
        if self._format == "table" or path is None:
            raise UnsupportedFeatureError("save of a table by path", "saveAsTable, or format() and a path")
        mode = {"error": "errorifexists"}.get(self._mode, self._mode)
        writer = self._data.write.mode(mode).format(self._format).options(**self._options)
        (writer.partitionBy(*self._partition) if self._partition else writer).save(path)

    def parquet(self, path: str) -> None:
        self.format("parquet").save(path)

    def csv(self, path: str) -> None:
        self.format("csv").save(path)

    def json(self, path: str) -> None:
        self.format("json").save(path)


def conform(data: DataFrame, schema: StructType, missing_ok: bool = False) -> DataFrame:
    """data's columns by name in the schema's order; those that are absent null, if that is allowed."""
    have = {c.lower(): c for c in data.columns}
    extra = [c for c in data.columns if c.lower() not in {f.name.lower() for f in schema}]
    missing = [f.name for f in schema if f.name.lower() not in have]
    if extra or (missing and not missing_ok):
        raise AnalysisException(f"columns differ from the table's: {', '.join(extra + missing)}")
    return data.select(*[F.col(f"`{have[f.name.lower()]}`").alias(f.name) if f.name.lower() in have else F.lit(None).cast(f.dataType).alias(f.name) for f in schema])


def merge_schema(store, where, schema: StructType) -> None:
    """Add the columns that a table lacks, at its end; none is dropped or retyped."""

    def change(table):
        own = table.metadata.schema()
        new = [f for f in schema if f.name.lower() not in {g.name.lower() for g in own}]
        if not new:
            return None
        for f in new:
            table.metadata.last_field_id += 1
            own = own.add(with_id(type(f)(f.name, f.dataType, True), table.metadata.last_field_id))
        table.metadata.set_schema(own)
        return table.metadata

    store.commit(where, change)
