"""Reading tables and files."""

from __future__ import annotations

from typing import TYPE_CHECKING

from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

from quern.errors import AnalysisException, UnsupportedFeatureError

if TYPE_CHECKING:
    from quern.session import Session


class DataFrameReader:
    """`session.read`: options gather until a table or files are named."""

    def __init__(self, session: Session) -> None:
        self._session, self._options, self._format, self._schema = session, {}, None, None

    def format(self, source: str) -> DataFrameReader:
        self._format = source.lower()
        return self

    def option(self, key: str, value) -> DataFrameReader:
        self._options[key] = value
        return self

    def options(self, **options) -> DataFrameReader:
        self._options.update(options)
        return self

    def schema(self, schema: str | StructType) -> DataFrameReader:
        """The columns to read files with; tables have their own."""
        self._schema = schema
        return self

    def _last(self, name: str):
        """An option by the last part of its dotted name."""
        found = [v for k, v in self._options.items() if k.rsplit(".", 1)[-1] == name]
        return found[-1] if found else None

    def table(self, tableName: str) -> DataFrame:
        """A table, at `snapshot-id` or `as-of-timestamp` (ms or ISO text) if set."""
        number, moment = self._last("snapshot-id"), self._last("as-of-timestamp")
        if number is not None and moment is not None:
            raise AnalysisException("snapshot-id and as-of-timestamp exclude each other")
        if self._schema is not None:
            raise UnsupportedFeatureError("a schema for a table", "select and cast")
        return self._session.table_at(tableName, version=None if number is None else int(number), timestamp=moment)

    def load(self, path: str | list[str] | None = None, format: str | None = None, **options) -> DataFrame:
        self.options(**options)
        kind = (format or self._format or "parquet").lower()
        if kind in ("quern", "iceberg", "table"):
            if not isinstance(path, str):
                raise AnalysisException("load of a table needs its name")
            return self.table(path)
        paths = [path] if isinstance(path, str) else list(path or [])
        if kind in ("parquet", "csv", "json"):
            return getattr(self, kind)(*paths)
        reader = self._session.spark.read.format(kind).options(**self._options)
        if self._schema is not None:
            reader = reader.schema(self._schema)
        return reader.load(paths or None)

    def _reader(self, **extra):
        reader = self._session.spark.read.options(**{k: v for k, v in (self._options | extra).items() if v is not None})
        return reader.schema(self._schema) if self._schema is not None else reader

    def parquet(self, *paths: str) -> DataFrame:
        """Files, their columns united by name; folder names are not columns."""
        return self._reader(mergeSchema=True, recursiveFileLookup=True).parquet(*paths)

    def csv(self, *paths: str, header: bool | None = None, sep: str | None = None, inferSchema: bool | None = None, nullValue: str | None = None) -> DataFrame:
        """Types are inferred unless inferSchema is off or a schema is given."""
        infer = self._options.get("inferSchema", True) if inferSchema is None else inferSchema
        more = {"header": header, "sep": sep, "nullValue": nullValue}
        if self._schema is None:
            more["inferSchema"] = infer
        return self._reader(**{k: v for k, v in more.items() if v is not None}).csv(list(paths))

    def json(self, *paths: str) -> DataFrame:
        """One object a line, or one array of objects: the first character that isn't white space tells."""
        first = self._session.spark.read.text(list(paths)).where("trim(value) <> ''").limit(1).collect()
        multi = bool(first) and first[0][0].lstrip().startswith("[")
        return self._reader(multiLine=multi).json(list(paths))

    def orc(self, *paths: str) -> DataFrame:
        return self._reader().orc(list(paths))

    def text(self, *paths: str) -> DataFrame:
        return self._reader().text(list(paths))
