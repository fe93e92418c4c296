"""`session.catalog`: what there is, over managed tables and Spark's temporary views and functions."""

from __future__ import annotations

import fnmatch
from typing import TYPE_CHECKING, NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

from quern.errors import AnalysisException, NoSuchNamespaceError, NoSuchTableError, UnsupportedFeatureError

if TYPE_CHECKING:
    from quern.session import Session

CATALOG = "quern"


class CatalogMetadata(NamedTuple):
    name: str
    description: str | None


class Database(NamedTuple):
    name: str
    catalog: str
    description: str | None
    locationUri: str


class TableInfo(NamedTuple):
    name: str
    catalog: str | None
    namespace: list[str] | None
    description: str | None
    tableType: str
    isTemporary: bool


class ColumnInfo(NamedTuple):
    name: str
    description: str | None
    dataType: str
    nullable: bool
    isPartition: bool
    isBucket: bool


def _matches(name: str, pattern: str | None) -> bool:
    return pattern is None or any(fnmatch.fnmatchcase(name.lower(), p.strip().lower()) for p in pattern.split("|"))


class Catalog:
    def __init__(self, session: Session) -> None:
        self._session, self._spark, self._store = session, session.spark, session.store

    def currentCatalog(self) -> str:
        return CATALOG

    def setCurrentCatalog(self, catalogName: str) -> None:
        if catalogName != CATALOG:
            raise AnalysisException(f"no catalog {catalogName}")

    def listCatalogs(self, pattern: str | None = None) -> list[CatalogMetadata]:
        return [CatalogMetadata(CATALOG, None)] if _matches(CATALOG, pattern) else []

    def currentDatabase(self) -> str:
        return self._session.namespace

    def setCurrentDatabase(self, dbName: str) -> None:
        self.getDatabase(dbName)
        self._session.namespace = dbName

    def listDatabases(self, pattern: str | None = None) -> list[Database]:
        return [self.getDatabase(n) for n in self._store.namespaces() if _matches(n, pattern)]

    def databaseExists(self, dbName: str) -> bool:
        return dbName in self._store.namespaces()

    def getDatabase(self, dbName: str) -> Database:
        if not self.databaseExists(dbName):
            raise NoSuchNamespaceError(f"no namespace {dbName}")
        return Database(dbName, CATALOG, None, f"{self._store.warehouse}/{dbName}")

    def _views(self) -> list[TableInfo]:
        return [TableInfo(t.name, None, None, None, "TEMPORARY", True) for t in self._spark.catalog.listTables() if t.isTemporary and not t.name.startswith("__quern_")]

    def listTables(self, dbName: str | None = None, pattern: str | None = None) -> list[TableInfo]:
        space = dbName or self._session.namespace
        own = [self.getTable(f"`{space}`.`{t}`") for t in self._store.tables(space)]
        return [t for t in own + self._views() if _matches(t.name, pattern)]

    def getTable(self, tableName: str) -> TableInfo:
        if "." not in tableName and (found := [v for v in self._views() if v.name.lower() == tableName.lower()]):
            return found[0]
        name = self._session.resolve(tableName)
        table = self._store.load(name)
        return TableInfo(name.table, CATALOG, [name.namespace], table.metadata.properties.get("comment"), "MANAGED", False)

    def tableExists(self, tableName: str, dbName: str | None = None) -> bool:
        name = f"`{dbName}`.`{tableName}`" if dbName else tableName
        return self._session.find(self._session_parts(name))[0] is not None or ("." not in tableName and any(v.name.lower() == tableName.lower() for v in self._views()))

    @staticmethod
    def _session_parts(name: str) -> list[str]:
        from quern.session import split_name

        return split_name(name)

    def listColumns(self, tableName: str, dbName: str | None = None) -> list[ColumnInfo]:
        if dbName is None and self._session._is_view(tableName):
            return [ColumnInfo(f.name, None, f.dataType.simpleString(), f.nullable, False, False) for f in self._spark.table(tableName).schema]
        m = self._store.load(self._session.resolve(f"`{dbName}`.`{tableName}`" if dbName else tableName)).metadata
        sources = {t.source_id for t in m.spec()}
        return [ColumnInfo(f.name, f.metadata.get("comment"), f.dataType.simpleString(), f.nullable, f.metadata["parquet.field.id"] in sources, False) for f in m.schema()]

    def createTable(self, tableName: str, path: str | None = None, source: str | None = None, schema: StructType | str | None = None, description: str | None = None, **options) -> DataFrame:
        if path is not None:
            raise UnsupportedFeatureError("a table at a path of its own", "the warehouse")
        if schema is None:
            raise AnalysisException("createTable needs a schema")
        own = schema if isinstance(schema, StructType) else StructType.fromDDL(schema)
        properties = {k: str(v) for k, v in options.items()} | ({"comment": description} if description else {})
        self._store.create(self._session.resolve(tableName), own, (), (), properties)
        return self._session.table(tableName)

    def dropTable(self, tableName: str, ifExists: bool = False) -> None:
        self._store.drop(self._session.resolve(tableName), ifExists)

    def refreshTable(self, tableName: str) -> None:
        """Frames made from now on see the newest version anyway; the table must exist."""
        if self._session.find(self._session_parts(tableName))[0] is None:
            raise NoSuchTableError(f"no table {tableName}")

    recoverPartitions = refreshTable

    def dropTempView(self, viewName: str) -> bool:
        return self._spark.catalog.dropTempView(viewName)

    def dropGlobalTempView(self, viewName: str) -> bool:
        return self._spark.catalog.dropGlobalTempView(viewName)

    def clearCache(self) -> None:
        self._spark.catalog.clearCache()

    def cacheTable(self, tableName: str) -> None:
        raise UnsupportedFeatureError("cacheTable", "session.table(name).cache()")

    uncacheTable = isCached = cacheTable

    def refreshByPath(self, path: str) -> None:
        self._spark.catalog.refreshByPath(path)

    def listFunctions(self, dbName: str | None = None, pattern: str | None = None) -> list[str]:
        from quern import functions

        registered = {f.name for f in self._spark.catalog.listFunctions() if f.isTemporary}
        return sorted(n for n in {*functions.__all__, *registered} if _matches(n, pattern))

    def functionExists(self, functionName: str, dbName: str | None = None) -> bool:
        return functionName in self.listFunctions() or self._spark.catalog.functionExists(functionName)

    def getFunction(self, functionName: str) -> str:
        if not self.functionExists(functionName):
            raise AnalysisException(f"no function {functionName}")
        return functionName

    def registerFunction(self, *_) -> None:
        raise UnsupportedFeatureError("registerFunction", "session.udf.register")
