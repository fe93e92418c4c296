"""Queries that write managed tables and read them back: the final state must be what one SELECT says."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quern.session import Session

_QUERIES: dict[str, tuple[Callable, str | None]] = {}


def _table(sql: str | None):
    """Register a function (session, orders) as a query over a fresh namespace."""

    def keep(f):
        def run(spark: SparkSession, d: str) -> DataFrame:
            before = Session._active
            folder = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/quern_{uuid.uuid4().hex}"
            session = Session(spark, folder, "ns")
            session.store.files._at(folder)[0].deleteOnExit(session.store.files._at(folder)[1])
            try:
                return f(session, spark.read.parquet(f"{d}/orders.parquet").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice"))
            finally:
                Session._active = before

        _QUERIES[f"table_{f.__name__}"] = (run, sql)
        return f

    return keep


_ALL = "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM orders"


@_table(_ALL + " WHERE o_orderkey % 2 = 0 UNION ALL " + _ALL + " WHERE o_orderkey % 2 = 1")
def append(s, orders):
    s.write(orders.where("o_orderkey % 2 = 0")).saveAsTable("ns.t")
    s.write(orders.where("o_orderkey % 2 = 1")).mode("append").saveAsTable("ns.t")
    return s.table("ns.t")


@_table(_ALL + " WHERE o_orderstatus = 'P'")
def overwrite(s, orders):
    s.write(orders).saveAsTable("ns.t")
    s.write(orders.where("o_orderstatus = 'P'")).mode("overwrite").saveAsTable("ns.t")
    return s.table("ns.t")


@_table(_ALL + " WHERE o_orderstatus <> 'P' OR o_orderkey % 3 = 0")
def dynamic_overwrite(s, orders):
    s.write(orders).partitionBy("o_orderstatus").saveAsTable("ns.t")
    s.write(orders.where("o_orderstatus = 'P' AND o_orderkey % 3 = 0")).mode("overwrite").option("partitionOverwriteMode", "dynamic").saveAsTable("ns.t")
    return s.table("ns.t")


@_table("SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, CASE WHEN o_orderkey % 2 = 0 THEN 'x' END AS extra FROM orders")
def merge_schema(s, orders):
    s.write(orders.where("o_orderkey % 2 = 1")).saveAsTable("ns.t")
    s.write(orders.where("o_orderkey % 2 = 0").selectExpr("*", "'x' AS extra")).mode("append").option("mergeSchema", "true").saveAsTable("ns.t")
    return s.table("ns.t")


@_table(_ALL + " WHERE NOT (o_totalprice > 100000 AND o_orderstatus = 'O')")
def delete(s, orders):
    s.write(orders).partitionBy("o_orderstatus").saveAsTable("ns.t")
    s.sql("DELETE FROM ns.t WHERE o_totalprice > 100000 AND o_orderstatus = 'O'")
    return s.table("ns.t")


@_table("SELECT o_orderkey, o_custkey, CASE WHEN o_totalprice < 50000 THEN 'S' ELSE o_orderstatus END AS o_orderstatus, CASE WHEN o_totalprice < 50000 THEN o_totalprice * 2 ELSE o_totalprice END AS o_totalprice FROM orders")
def update(s, orders):
    s.write(orders).saveAsTable("ns.t")
    s.sql("UPDATE ns.t SET o_orderstatus = 'S', o_totalprice = o_totalprice * 2 WHERE o_totalprice < 50000")
    return s.table("ns.t")


@_table(
    "SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey % 5 = 0 THEN 'U' ELSE o_orderstatus END AS o_orderstatus, o_totalprice FROM orders WHERE o_orderkey % 2 = 0 AND o_orderkey % 7 <> 0 "
    "UNION ALL SELECT o_orderkey, o_custkey, 'I', NULL FROM orders WHERE o_orderkey % 2 = 1 AND o_orderkey % 5 = 0 AND o_orderkey % 3 = 0"
)
def merge(s, orders):
    s.write(orders.where("o_orderkey % 2 = 0")).saveAsTable("ns.t")
    orders.where("o_orderkey % 5 = 0 OR o_orderkey % 7 = 0").createOrReplaceTempView("quern_merge_source")
    s.sql(
        "MERGE INTO ns.t AS t USING quern_merge_source AS s ON t.o_orderkey = s.o_orderkey WHEN MATCHED AND s.o_orderkey % 7 = 0 THEN DELETE "
        "WHEN MATCHED THEN UPDATE SET o_orderstatus = 'U' WHEN NOT MATCHED AND s.o_orderkey % 5 = 0 AND s.o_orderkey % 3 = 0 THEN INSERT (o_orderkey, o_custkey, o_orderstatus) VALUES (s.o_orderkey, s.o_custkey, 'I')"
    )
    return s.table("ns.t")


@_table(_ALL)
def time_travel(s, orders):
    s.write(orders).saveAsTable("ns.t")
    first = s.table("ns.t.snapshots").first()["snapshot_id"]
    s.sql("DELETE FROM ns.t WHERE o_orderkey > 100")
    return s.sql(f"SELECT * FROM ns.t VERSION AS OF {first}")


@_table("SELECT o_orderkey, o_custkey AS buyer, NULL::int AS note, o_totalprice FROM orders")
def evolution(s, orders):
    s.write(orders).saveAsTable("ns.t")
    s.sql("ALTER TABLE ns.t RENAME COLUMN o_custkey TO buyer")
    s.sql("ALTER TABLE ns.t DROP COLUMN o_orderstatus")
    s.sql("ALTER TABLE ns.t ADD COLUMN note INT")
    return s.table("ns.t").select("o_orderkey", "buyer", "note", "o_totalprice")


@_table("SELECT o_orderstatus AS part, count(*) AS n FROM orders GROUP BY 1")
def metadata_partitions(s, orders):
    s.write(orders).partitionBy("o_orderstatus").saveAsTable("ns.t")
    return s.sql("SELECT partition['o_orderstatus'] AS part, sum(record_count) AS n FROM ns.t.files GROUP BY 1")


@_table(_ALL)
def compaction(s, orders):
    for k in range(5):
        s.write(orders.where(f"o_orderkey % 5 = {k}")).mode("append").sortBy("o_custkey").saveAsTable("ns.t")
    s.maintenance("ns.t").compact(minInputFiles=2)
    s.maintenance("ns.t").expireSnapshots(retainLast=1)
    return s.table("ns.t")


@_table("SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1")
def ctas(s, orders):
    orders.createOrReplaceTempView("quern_ctas_source")
    s.sql("CREATE TABLE ns.t PARTITIONED BY (bucket(4, o_custkey)) AS SELECT o_custkey, count(*) AS n FROM quern_ctas_source GROUP BY o_custkey")
    return s.sql("SELECT * FROM ns.t")


@_table("SELECT count(*) AS n FROM orders")
def count_from_manifests(s, orders):
    s.write(orders).saveAsTable("ns.t")
    return s.spark.createDataFrame([(s.store.load(s.resolve("ns.t")).count(),)], "n long")


@_table(_ALL + " WHERE o_orderkey % 2 = 0 UNION ALL " + _ALL + " WHERE o_orderkey % 3 = 0")
def insert_into(s, orders):
    s.write(orders.where("o_orderkey % 2 = 0")).saveAsTable("ns.t")
    s.write(orders.where("o_orderkey % 3 = 0")).insertInto("ns.t")
    return s.table("ns.t")


@_table(_ALL + " WHERE o_orderkey % 3 = 0")
def insert_into_overwrite(s, orders):
    s.write(orders).saveAsTable("ns.t")
    s.write(orders.where("o_orderkey % 3 = 0")).insertInto("ns.t", overwrite=True)
    return s.read.table("ns.t")


@_table(_ALL + " WHERE o_orderkey % 2 = 0 UNION ALL SELECT o_orderkey, NULL, NULL, o_totalprice FROM orders WHERE o_orderkey % 2 = 1 UNION ALL SELECT -1, 7, 'V', 2.5")
def sql_insert(s, orders):
    orders.createOrReplaceTempView("quern_insert_source")
    s.write(orders.where("o_orderkey % 2 = 0")).saveAsTable("ns.t")
    s.sql("INSERT INTO ns.t (o_totalprice, o_orderkey) SELECT o_totalprice, o_orderkey FROM quern_insert_source WHERE o_orderkey % 2 = 1")
    s.sql("INSERT INTO ns.t VALUES (-1, 7, 'V', 2.5)")
    return s.table("ns.t")


@_table(_ALL + " WHERE o_totalprice > 100000")
def sql_insert_overwrite(s, orders):
    s.write(orders).saveAsTable("ns.t")
    s.sql("INSERT OVERWRITE ns.t SELECT * FROM ns.t WHERE o_totalprice > 100000")
    return s.sql("SELECT * FROM ns.t")


@_table("SELECT o_orderstatus, count(*) AS n FROM orders WHERE o_orderkey <> 0 GROUP BY 1")
def partition_fields(s, orders):
    s.write(orders.where("o_orderkey % 3 = 0")).partitionBy("o_orderstatus").saveAsTable("ns.t")
    s.sql("ALTER TABLE ns.t ADD PARTITION FIELD bucket(4, o_custkey) AS shard")
    s.write(orders.where("o_orderkey % 3 = 1")).mode("append").saveAsTable("ns.t")
    s.sql("ALTER TABLE ns.t DROP PARTITION FIELD shard")
    s.write(orders.where("o_orderkey % 3 = 2")).mode("append").saveAsTable("ns.t")
    s.sql("DELETE FROM ns.t WHERE o_orderkey = 0")
    return s.sql("SELECT o_orderstatus, count(*) AS n FROM ns.t GROUP BY o_orderstatus")


@_table("SELECT count(*) AS n, true AS before, false AS after FROM orders")
def drop(s, orders):
    s.write(orders).saveAsTable("ns.t")
    n, before = s.table("ns.t").count(), s.catalog.tableExists("ns.t")
    s.sql("DROP TABLE ns.t")
    return s.spark.createDataFrame([(n, before, s.catalog.tableExists("ns.t"))], "n long, before boolean, after boolean")


@_table("SELECT * FROM (VALUES ('t', 'o_custkey', 'bigint'), ('t', 'o_orderkey', 'bigint'), ('t', 'o_orderstatus', 'string'), ('u', 'n', 'bigint')) AS x(name, col, kind)")
def catalog_listing(s, orders):
    s.write(orders.selectExpr("bigint(o_orderkey) AS o_orderkey", "bigint(o_custkey) AS o_custkey", "o_orderstatus")).saveAsTable("ns.t")
    s.catalog.createTable("ns.u", schema="n long")
    names = [t.name for t in s.catalog.listTables("ns") if not t.isTemporary]
    rows = [(t, c.name, c.dataType) for t in names for c in s.catalog.listColumns(f"ns.{t}")]
    return s.spark.createDataFrame(rows, "name string, col string, kind string")


@_table(
    "SELECT * FROM (VALUES ('snapshots', 3), ('history', 3), ('refs', 1), ('delete_files', 0), ('all_delete_files', 0)) AS x(kind, n) UNION ALL "
    "SELECT kind, count(*) FILTER (WHERE o_orderkey % 4 <> 0) FROM orders, (VALUES ('files'), ('data_files'), ('entries'), ('manifests'), ('partitions')) AS k(kind) GROUP BY kind"
)
def metadata_tables(s, orders):
    """Rows of the tables of versions, and the data rows that those of files account for."""
    for k in (1, 2):
        s.write(orders.where(f"o_orderkey % 2 = {k % 2}")).mode("append").partitionBy("o_orderstatus").saveAsTable("ns.t")
    s.sql("DELETE FROM ns.t WHERE o_orderkey % 4 = 0")
    out = None
    for kind in ("snapshots", "history", "refs", "delete_files", "all_delete_files"):
        one = s.table(f"ns.t.{kind}").selectExpr(f"'{kind}' AS kind", "1L AS n")
        out = one if out is None else out.union(one)
    for kind in ("files", "data_files", "entries", "manifests", "partitions"):
        rows = "rows" if kind == "manifests" else "record_count"
        out = out.union(s.table(f"ns.t.{kind}").selectExpr(f"'{kind}' AS kind", f"{rows} AS n"))
    kinds = s.spark.createDataFrame([("delete_files", 0), ("all_delete_files", 0)], "kind string, n long")
    return out.union(kinds).groupBy("kind").sum("n").withColumnRenamed("sum(n)", "n")


def _files(kind: str, **options):
    """Register a round trip through files of a kind, beside the session's tables."""

    def round_trip(s, orders):
        path = f"{s.store.warehouse}/files_{kind}"
        data = orders.selectExpr("bigint(o_orderkey) AS o_orderkey", "bigint(o_custkey) AS o_custkey", "o_orderstatus")
        s.write(data).format(kind).options(**options).save(path)
        return s.read.format(kind).options(**options).schema(data.schema).load(path)

    round_trip.__name__ = f"read_{kind}"
    _table("SELECT o_orderkey, o_custkey, o_orderstatus FROM orders")(round_trip)


for _kind, _options in (("parquet", {}), ("csv", {"header": "true"}), ("json", {}), ("orc", {})):
    _files(_kind, **_options)


def queries() -> dict[str, Callable]:
    return {name: f for name, (f, _) in _QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _QUERIES.items() if sql is not None}
