"""Session settings that fix one meaning for both surfaces, and the Session facade."""

from __future__ import annotations

import os
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, MapType, StringType, StructField, StructType, _infer_type

from quern.errors import AnalysisException, NoSuchTableError, QuernError

_MISSING = object()

#: Runtime settings under which every query of this library is defined.
SEMANTICS = {
    "spark.sql.ansi.enabled": "false",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
    "spark.sql.legacy.sizeOfNull": "true",
    "spark.sql.adaptive.enabled": "true",
}

#: Bytes of a batch on its way to or from Python: what a task holds of long texts at once.
LIMITS = {"spark.sql.execution.arrow.maxBytesPerBatch": "8m"}


def configure(spark: SparkSession) -> SparkSession:
    """Put SEMANTICS and LIMITS in force on a session that somebody else made."""
    for key, value in (SEMANTICS | LIMITS).items():
        spark.conf.set(key, value)
    return spark


class RuntimeConfig:
    """`session.conf`: Spark's runtime settings, with this library's defaults."""

    def __init__(self, spark: SparkSession) -> None:
        self._spark = spark

    def get(self, key: str, default=_MISSING):
        return self._spark.conf.get(key) if default is _MISSING else self._spark.conf.get(key, default)

    def set(self, key: str, value) -> None:
        self._spark.conf.set(key, str(value).lower() if isinstance(value, bool) else str(value))

    def unset(self, key: str) -> None:
        self._spark.conf.unset(key)

    def isModifiable(self, key: str) -> bool:
        return self._spark.conf.isModifiable(key)

    def getAll(self) -> dict[str, str]:
        return dict(self._spark.conf.getAll)


class Session:
    """One SparkSession, one table store: SQL and DataFrames over managed tables, files and Spark's own sources.

    DataFrames, columns, rows, types and functions are PySpark's; this class adds versioned tables to them.
    """

    _active: Session | None = None

    class Builder:
        """Settings gather until getOrCreate() or create()."""

        def __init__(self) -> None:
            self._name, self._settings, self._warehouse = "quern", {}, None

        def appName(self, name: str) -> Session.Builder:
            self._name = name
            return self

        def config(self, key: str | None = None, value=None, *, map: dict | None = None) -> Session.Builder:
            self._settings.update(map or {})
            if key is not None:
                self._settings[key] = value
            return self

        def withCatalog(self, warehouse: str) -> Session.Builder:
            """The folder that holds the managed tables."""
            self._warehouse = warehouse
            return self

        def getOrCreate(self) -> Session:
            return Session._active if Session._active is not None else self.create()

        def create(self) -> Session:
            settings = resolve_settings(self._settings)
            own = SparkSession.getActiveSession() is None
            builder = SparkSession.builder.appName(self._name)
            for key, value in settings.items():
                if key.startswith("spark."):
                    builder = builder.config(key, value)
            return Session(builder.getOrCreate(), self._warehouse or settings.get("quern.warehouse"), settings.get("quern.namespace", "default"), owns_spark=own)

    def __init__(self, spark: SparkSession, warehouse: str | None = None, namespace: str = "default", owns_spark: bool = False) -> None:
        from quern.plans.router import Router
        from quern.tables.store import TableStore

        self.spark = configure(spark)
        self.store = TableStore(spark, warehouse or f"{spark.conf.get('spark.sql.warehouse.dir')}/quern")
        self.namespace, self._owns, self._stopped = namespace, owns_spark, False
        self.store.create_namespace(namespace, exist_ok=True)
        self._router = Router(self)
        Session._active = self

    @classmethod
    def getActiveSession(cls) -> Session | None:
        return cls._active

    @classmethod
    def active(cls) -> Session:
        if cls._active is None:
            raise QuernError("no active session; make one with Session.builder()")
        return cls._active

    @staticmethod
    def builder() -> Session.Builder:
        return Session.Builder()

    @property
    def version(self) -> str:
        return self.spark.version

    @property
    def conf(self) -> RuntimeConfig:
        return RuntimeConfig(self.spark)

    @property
    def settings(self) -> dict[str, str]:
        """The settings of this library that are in force, by layer resolved (see resolve_settings), with the warehouse."""
        return resolve_settings() | {"quern.warehouse": self.store.warehouse, "quern.namespace": self.namespace}

    @property
    def reference_semantics(self) -> dict[str, str]:
        """The Spark settings that fix the meaning of both surfaces, as they are in force."""
        return {key: self.spark.conf.get(key) for key in SEMANTICS}

    @property
    def read(self):
        from quern.sources.reader import DataFrameReader

        return DataFrameReader(self)

    def write(self, data: DataFrame):
        """How to write a DataFrame into a managed table, or to files."""
        from quern.sources.writer import DataFrameWriter

        return DataFrameWriter(self, data)

    @property
    def catalog(self):
        from quern.plans.catalog import Catalog

        return Catalog(self)

    @property
    def udf(self):
        from quern.functions.udf import UDFRegistration

        return UDFRegistration(self.spark)

    def maintenance(self, tableName: str):
        from quern.tables.maintenance import TableMaintenance

        where = self.resolve(tableName)
        self.store.load(where)
        return TableMaintenance(self.store, where)

    # Names

    def resolve(self, name: str):
        """`table`, `namespace.table` or `catalog.namespace.table`, with backticks where needed."""
        return self._name(split_name(name))

    def _name(self, parts: list[str]):
        from quern.tables.store import Name

        if not 1 <= len(parts) <= 3 or not all(parts):
            raise AnalysisException(f"not a table name: {'.'.join(parts)}")
        return Name(parts[-2] if len(parts) > 1 else self.namespace, parts[-1])

    def find(self, parts: list[str]):
        """(name, metadata kind) of a managed table; (None, None) if there is none by that name."""
        from quern.tables.metadata_tables import KINDS

        if len(parts) <= 3 and self.store.exists(where := self._name(parts)):
            return where, None
        if 2 <= len(parts) <= 4 and parts[-1].lower() in KINDS and self.store.exists(where := self._name(parts[:-1])):
            return where, parts[-1].lower()
        return None, None

    def frame(self, name, kind: str | None = None, version: int | None = None, timestamp=None) -> DataFrame:
        """A table, a version of it, or one of its metadata tables."""
        from quern.tables import metadata_tables
        from quern.tables.maintenance import _ms

        table = self.store.load(name)
        if kind:
            return metadata_tables.read(table, kind)
        if timestamp is not None:
            moment = int(timestamp) if isinstance(timestamp, str) and timestamp.isdigit() else timestamp
            seen = [i for ms, i in table.metadata.snapshot_log if ms <= _ms(moment)]
            if not seen:
                raise AnalysisException(f"{name} has no snapshot as old as {timestamp}")
            version = seen[-1]
        return table.read(snapshot_id=version)

    # Frames

    def table(self, tableName: str) -> DataFrame:
        """A temporary view, a managed table or one of its metadata tables, in that order."""
        return self.table_at(tableName)

    def table_at(self, tableName: str, version: int | None = None, timestamp=None) -> DataFrame:
        parts = split_name(tableName)
        if len(parts) == 1 and self._is_view(parts[0]):
            return self.spark.table(parts[0])
        name, kind = self.find(parts)
        if name is None:
            raise NoSuchTableError(f"no table {tableName}")
        return self.frame(name, kind, version, timestamp)

    def _is_view(self, name: str) -> bool:
        return self.spark.catalog.tableExists(name) and self.spark.catalog.getTable(name).isTemporary

    def sql(self, sqlQuery: str, args=None) -> DataFrame:
        """One statement. Queries are lazy; statements that change something run at once and give an empty frame."""
        return self._router.run(sqlQuery, args)

    def createDataFrame(self, data, schema=None) -> DataFrame:
        """As Spark's, but a typed schema casts, a value that can't be cast becoming null, instead of checking."""
        if schema is None or isinstance(schema, list | tuple):
            return self.spark.createDataFrame(data, schema) if schema is not None else self.spark.createDataFrame(data)
        wanted = schema if isinstance(schema, StructType) else StructType.fromDDL(schema)
        if not isinstance(data, list):
            frame = self.spark.createDataFrame(data)
        else:
            if not data:
                return self.spark.createDataFrame([], wanted)
            rows = [tuple(r.get(n) for n in wanted.names) if isinstance(r, dict) else tuple(r) if isinstance(r, list | tuple) else (r,) for r in data]
            columns = []
            for i, f in enumerate(wanted):
                values = [r[i] for r in rows]
                kinds = {type(v) for v in values if v is not None}
                atomic = not isinstance(f.dataType, ArrayType | MapType | StructType)
                columns.append([v if v is None or not atomic or len(kinds) < 2 else str(v) for v in values])
            rows = list(zip(*columns, strict=True))
            loose = []
            for i, f in enumerate(wanted):
                values = [v for v in columns[i] if v is not None]
                atomic = not isinstance(f.dataType, ArrayType | MapType | StructType)
                loose.append(StructField(f.name, _infer_type(values[0]) if values and atomic else f.dataType if not atomic else StringType()))
            frame = self.spark.createDataFrame(rows, StructType(loose))
        if len(frame.columns) != len(wanted):
            raise AnalysisException(f"{len(frame.columns)} columns, but the schema has {len(wanted)}")
        return frame.toDF(*wanted.names).select(*[F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in wanted])

    def range(self, start: int, end: int | None = None, step: int = 1, numPartitions: int | None = None) -> DataFrame:
        if step == 0:
            raise AnalysisException("step can't be 0")
        return self.spark.range(start, end, step, numPartitions)

    def dropTempView(self, viewName: str) -> bool:
        return self.spark.catalog.dropTempView(viewName)

    def stop(self) -> None:
        """Forget this session, and stop Spark if this session started it."""
        if not self._stopped:
            self._stopped = True
            Session._active = None
            if self._owns:
                self.spark.stop()

    def __enter__(self) -> Session:
        return self

    def __exit__(self, *_) -> None:
        self.stop()


def split_name(name: str) -> list[str]:
    """A dotted name's parts; backticks quote, a doubled one stands for itself."""
    parts, rest = [], name.strip()
    while True:
        if rest.startswith("`"):
            m = re.match(r"`((?:[^`]|``)+)`(?:\.|$)", rest)
        else:
            m = re.match(r"([^.`]+)(?:\.|$)", rest)
        if not m:
            raise AnalysisException(f"not a name: {name}")
        parts.append(m[1].replace("``", "`"))
        rest = rest[m.end() :]
        if not rest:
            if m[0].endswith("."):
                raise AnalysisException(f"not a name: {name}")
            return parts


def resolve_settings(conf: dict | None = None, *, env: dict | None = None, dotenv_path: str | None = None) -> dict[str, str]:
    """Settings by layer, the later the weaker: conf, the environment, a .env file.

    An environment name QUERN_A_B is the key quern.a.b, QUERN_SPARK_A_B the key spark.a.b.
    """

    def keyed(pairs: dict) -> dict[str, str]:
        out = {}
        for k, v in pairs.items():
            if k.startswith("QUERN_"):
                key = k[6:].lower().replace("_", ".")
                out[key if key.startswith("spark.") else f"quern.{key}"] = v
        return out

    filed = {}
    if dotenv_path and os.path.exists(dotenv_path):
        with open(dotenv_path) as f:
            for line in f:
                key, eq, value = line.strip().partition("=")
                if eq and not key.startswith("#"):
                    filed[key.strip()] = value.strip().strip("\"'")
    return keyed(filed) | keyed(dict(os.environ if env is None else env)) | {k: str(v) for k, v in (conf or {}).items()}
