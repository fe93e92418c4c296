"""Versioned tables: writes, schema evolution, time travel, metadata tables, maintenance, catalog."""

import collections

import pyarrow.parquet as pq
import pytest
from pyspark.errors import AnalysisException

from quern.errors import CommitConflictError, NoSuchTableError, TableExistsError, UnsupportedFeatureError
from quern.plans.explain import scan_report
from quern.tables import maintenance
from quern.tables.metadata_tables import KINDS


def ids(frame):
    return sorted(r["id"] for r in frame.select("id").collect())


def test_write_modes(session, plain):
    w = lambda mode: session.write(plain.limit(2)).mode(mode)
    with pytest.raises(TableExistsError):
        w("error").saveAsTable("ns.plain")
    w("ignore").saveAsTable("ns.plain")
    assert session.table("plain").count() == 5
    w("append").saveAsTable("ns.plain")
    assert session.table("plain").count() == 7
    w("overwrite").saveAsTable("ns.plain")
    assert session.table("plain").count() == 2 == session.store.load(session.resolve("plain")).count()
    with pytest.raises(AnalysisException):
        session.write(plain).mode("upsert")


def test_insert_by_position_and_by_name(session, plain):
    session.sql("INSERT INTO ns.plain SELECT 6, 'z', 1.5")
    session.sql("INSERT INTO ns.plain (amount, id) VALUES (2.5, 7)")
    got = {r["id"]: (r["vendor"], r["amount"]) for r in session.table("plain").where("id > 5").collect()}
    assert got == {6: ("z", 1.5), 7: (None, 2.5)}
    with pytest.raises(AnalysisException):
        session.write(plain.select("id")).insertInto("ns.plain")
    session.sql("INSERT OVERWRITE ns.plain SELECT * FROM ns.plain WHERE id = 7")
    assert ids(session.table("plain")) == [7]


def test_dynamic_overwrite_replaces_touched_partitions(session, partitioned):
    new = session.createDataFrame([(100, "2026-08-16", 1.0)], "id bigint, as_at_date string, amount double")
    session.write(new).mode("overwrite").option("partitionOverwriteMode", "dynamic").saveAsTable("ns.partitioned")
    assert ids(session.table("partitioned")) == [0, 1, 2, 3, 8, 9, 10, 11, 100]
    session.write(new).saveAsTable("ns.flat")
    with pytest.raises(AnalysisException):
        session.write(new).mode("overwrite").option("partitionOverwriteMode", "dynamic").saveAsTable("ns.flat")


def test_partition_and_bounds_pruning(session, partitioned):
    report = scan_report(session, "ns.partitioned", "as_at_date = '2026-08-16' AND id > 4 AND length(as_at_date) = 10", ["id"])
    assert (report.files, report.of_files, report.columns, report.of_columns) == (1, 3, 1, 3)
    assert len(report.pushed) == 2 and len(report.unpushed) == 1
    assert scan_report(session, "ns.partitioned", "id >= 8").files == 1
    assert scan_report(session, "ns.partitioned", "amount IS NULL").files == 0
    assert scan_report(session, "ns.partitioned", "id IN (0, 11)").files == 2
    assert scan_report(session, "ns.partitioned", "id = 3 OR id = 8").files == 3


def test_schema_evolution_by_field_id(session):
    session.write(session.createDataFrame([(1, "before-a"), (2, "before-b")], "id bigint, old_name string")).saveAsTable("ns.renamed")
    session.sql("ALTER TABLE ns.renamed RENAME COLUMN old_name TO new_name")
    session.sql("INSERT INTO ns.renamed VALUES (3, 'after-c')")
    session.sql("ALTER TABLE ns.renamed ADD COLUMNS (late INT COMMENT 'x', other STRING)")
    assert {r["id"]: r["new_name"] for r in session.table("renamed").collect()} == {1: "before-a", 2: "before-b", 3: "after-c"}
    assert session.table("renamed").where("late IS NULL").count() == 3
    session.sql("ALTER TABLE ns.renamed DROP COLUMN new_name")
    session.sql("ALTER TABLE ns.renamed ADD COLUMN new_name STRING")
    assert session.table("renamed").where("new_name IS NULL").count() == 3
    session.sql("ALTER TABLE ns.renamed ALTER COLUMN late COMMENT 'y'")
    assert [c.description for c in session.catalog.listColumns("ns.renamed") if c.name == "late"] == ["y"]
    with pytest.raises(UnsupportedFeatureError):
        session.sql("ALTER TABLE ns.renamed ALTER COLUMN late TYPE BIGINT")


def test_merge_schema_on_write(session, plain):
    wider = session.createDataFrame([(9, "n")], "id bigint, extra string")
    with pytest.raises(AnalysisException):
        session.write(wider).mode("append").saveAsTable("ns.plain")
    session.write(wider).mode("append").option("mergeSchema", True).saveAsTable("ns.plain")
    got = session.table("plain")
    assert got.columns == ["id", "vendor", "amount", "extra"]
    assert got.where("id = 9").first().asDict() == {"id": 9, "vendor": None, "amount": None, "extra": "n"}


def test_time_travel(session, plain):
    first = session.table("plain.snapshots").first()
    before = session.table("plain")
    session.sql("DELETE FROM ns.plain WHERE id > 3")
    assert ids(session.table("plain")) == [1, 2, 3]
    assert ids(before) == [1, 2, 3, 4, 5]
    assert ids(session.sql(f"SELECT * FROM ns.plain VERSION AS OF {first['snapshot_id']} AS p WHERE p.id < 9")) == [1, 2, 3, 4, 5]
    assert ids(session.read.option("snapshot-id", first["snapshot_id"]).table("ns.plain")) == [1, 2, 3, 4, 5]
    ms = int(first["committed_at"].timestamp() * 1000) + 1
    assert ids(session.read.option("as-of-timestamp", ms).table("ns.plain")) == [1, 2, 3, 4, 5]
    with pytest.raises(AnalysisException):
        session.read.option("as-of-timestamp", 1).table("ns.plain")
    with pytest.raises(AnalysisException):
        session.read.option("as-of-timestamp", 1).option("snapshot-id", 2).table("ns.plain")
    with pytest.raises(AnalysisException):
        session.read.option("snapshot-id", 17).table("ns.plain")


@pytest.mark.parametrize("kind", KINDS)
def test_metadata_tables_can_be_read_and_joined(session, partitioned, kind):
    n = session.table(f"ns.partitioned.{kind}").count()
    assert n == session.sql(f"SELECT count(*) c FROM ns.partitioned.{kind}").first()["c"]
    expected = {"snapshots": 3, "history": 3, "refs": 1, "files": 3, "data_files": 3, "delete_files": 0, "all_delete_files": 0, "partitions": 3, "entries": 3, "manifests": 3, "metadata_log_entries": 4}
    assert n == expected.get(kind, n)


def test_compaction_sorts_pieces_not_whole_files(session, monkeypatch):
    """No task sorts a file's rows, not even those of one hot key; files are sorted within and between them."""
    monkeypatch.setattr(maintenance, "PIECE_BYTES", 1 << 20, raising=False)
    for k in range(6):
        frame = session.spark.range(k, 120_000, 6).selectExpr("id", "CASE WHEN id % 2 = 0 THEN 500 WHEN id % 1001 > 0 THEN id % 1001 END AS k", "repeat('v', id % 7) AS `odd.name`")
        session.write(frame.coalesce(1)).mode("append").sortBy("k").saveAsTable("ns.pieces")
    table = session.store.load(session.resolve("pieces"))
    before, calls, write = session.table("pieces").collect(), [], session.store.write_files
    monkeypatch.setattr(session.store, "write_files", lambda t, rows: calls.append(write(t, rows)) or calls[-1])
    done = session.maintenance("ns.pieces").compact(targetFileSizeBytes=int(max(f.size for f in table.files()) * 2.2))
    assert done == {"rewritten_files": 6, "added_files": 3} and collections.Counter(session.table("pieces").collect()) == collections.Counter(before)
    assert len(calls[0]) >= 8 and max(f.rows for f in calls[0]) < 40_000
    files = session.store.load(session.resolve("pieces")).files()
    found = [[-1 if v is None else v for v in pq.read_table(f.path.removeprefix("file:")).column("c2").to_pylist()] for f in files]
    found.sort(key=lambda v: (v[0], v[-1]))
    assert len(found) == 3 and sum(found, []) == sorted(sum(found, [])) and min(map(len, found)) > 20_000
    assert not any(session.store.files.exists(f.path) for f in calls[0])


def test_compaction_and_expiry(session):
    for k in range(6):
        rows = [(3 * k + i, f"p{i % 2}", "v") for i in range(3)]
        frame = session.createDataFrame(rows, "id bigint, part string, v string").coalesce(1)
        session.write(frame).mode("append").partitionBy("part").sortBy("id").saveAsTable("ns.fragmented")
    old = session.table("fragmented.files").count()
    done = session.maintenance("ns.fragmented").compact()
    assert done["rewritten_files"] == old == 12 and done["added_files"] == 2
    assert ids(session.table("fragmented")) == list(range(18))
    assert session.maintenance("ns.fragmented").compact()["rewritten_files"] == 0
    counts = session.maintenance("ns.fragmented").expireSnapshots(retainLast=1)
    assert counts["expired_snapshots"] == 6 and counts["deleted_files"] >= 12
    assert ids(session.table("fragmented")) == list(range(18))
    location = session.store.load(session.resolve("fragmented")).metadata.location
    session.store.files.create(f"{location}/data/stray.parquet", "x")
    assert session.maintenance("ns.fragmented").removeOrphanFiles() == []
    found = session.maintenance("ns.fragmented").removeOrphanFiles(olderThan=2**53, dryRun=False)
    assert [p.rsplit("/", 1)[1] for p in found] == ["stray.parquet"]
    assert session.table("fragmented").count() == 18
    with pytest.raises(UnsupportedFeatureError):
        session.maintenance("ns.fragmented").rewriteManifests()


def test_partition_evolution_and_order(session):
    session.sql("CREATE TABLE ns.ev (id BIGINT, ts TIMESTAMP_NTZ, s STRING) PARTITIONED BY (days(ts))")
    session.sql("INSERT INTO ns.ev VALUES (1, TIMESTAMP_NTZ '2026-01-01 10:00:00', 'abc'), (2, TIMESTAMP_NTZ '2026-01-02 10:00:00', 'abd')")
    assert scan_report(session, "ns.ev", "ts >= TIMESTAMP_NTZ '2026-01-02 00:00:00'").files == 1
    session.sql("ALTER TABLE ns.ev ADD PARTITION FIELD bucket(4, id) AS shard")
    session.sql("ALTER TABLE ns.ev REPLACE PARTITION FIELD days(ts) WITH months(ts)")
    session.sql("ALTER TABLE ns.ev WRITE ORDERED BY s DESC NULLS LAST, id")
    session.sql("INSERT INTO ns.ev VALUES (3, TIMESTAMP_NTZ '2026-02-01 10:00:00', 'x')")
    spec = [t.name for t in session.store.load(session.resolve("ev")).metadata.spec()]
    assert spec == ["ts_month", "shard"]
    assert {tuple(sorted(r["partition"])) for r in session.table("ev.files").collect()} == {("ts_day",), ("shard", "ts_month")}
    session.sql("ALTER TABLE ns.ev DROP PARTITION FIELD shard")
    session.sql("ALTER TABLE ns.ev WRITE UNORDERED")
    assert ids(session.table("ev")) == [1, 2, 3]
    with pytest.raises(AnalysisException):
        session.sql("ALTER TABLE ns.ev DROP COLUMN ts")


def test_ddl_and_catalog(session, plain):
    session.sql("CREATE NAMESPACE IF NOT EXISTS other")
    session.sql("CREATE TABLE other.t (a INT NOT NULL COMMENT 'first', b STRING) USING iceberg TBLPROPERTIES ('k'='v') COMMENT 'text'")
    session.sql("CREATE TABLE IF NOT EXISTS other.t (x INT)")
    with pytest.raises(AnalysisException):
        session.sql("CREATE TABLE other.t (x INT)")
    with pytest.raises(Exception, match="NOT NULL"):
        session.sql("INSERT INTO other.t VALUES (NULL, 'x')")
    session.sql("ALTER TABLE other.t ALTER COLUMN a DROP NOT NULL")
    session.sql("INSERT INTO other.t VALUES (NULL, 'x')")
    session.sql("ALTER TABLE other.t SET TBLPROPERTIES ('q'='w')")
    session.sql("ALTER TABLE other.t UNSET TBLPROPERTIES ('k')")
    assert session.store.load(session.resolve("other.t")).metadata.properties == {"comment": "text", "q": "w"}
    session.sql("ALTER TABLE other.t RENAME TO other.u")
    assert session.table("other.u").count() == 1 and not session.catalog.tableExists("other.t")
    session.sql("CREATE OR REPLACE TABLE other.u AS SELECT id, vendor FROM ns.plain")
    assert session.table("other.u").count() == 5 and session.table("other.u.snapshots").count() == 2
    plain.createOrReplaceTempView("seen")
    assert {"u", "seen"} <= {t.name for t in session.catalog.listTables("other")}
    assert [t.name for t in session.catalog.listTables("ns", "pl*|zz")] == ["plain"]
    assert session.catalog.databaseExists("other") and session.catalog.currentDatabase() == "ns"
    assert [c.name for c in session.catalog.listColumns("plain")] == ["id", "vendor", "amount"]
    with pytest.raises(AnalysisException):
        session.sql("DROP NAMESPACE other")
    session.sql("DROP NAMESPACE other CASCADE")
    with pytest.raises(NoSuchTableError):
        session.table("other.u")
    session.sql("DROP TABLE IF EXISTS ns.nothing")
    session.sql("DROP TABLE ns.plain PURGE")
    assert session.catalog.listTables("ns") == [t for t in session.catalog.listTables("ns") if t.isTemporary]
    session.dropTempView("seen")


def test_commit_conflict_is_planned_again_then_refused(session, plain):
    store, name = session.store, session.resolve("plain")
    calls = []

    def change(table):
        calls.append(table.metadata.version)
        if len(calls) == 1:
            store.append(name, plain.limit(1))  # another writer comes first
        table.metadata.properties["a"] = "b"
        return table.metadata

    store.commit(name, change)
    assert len(calls) == 2 and store.load(name).count() == 6

    def never(table):
        store._publish(store.load(name).metadata, table.metadata.version + 1)
        return table.metadata

    with pytest.raises(CommitConflictError):
        store.commit(name, never)


def test_empty_table_and_empty_append(session):
    session.sql("CREATE TABLE ns.e (a INT, b STRING)")
    assert session.table("e").collect() == [] and session.table("e").columns == ["a", "b"]
    session.write(session.table("e")).mode("append").saveAsTable("ns.e")
    assert session.table("e").count() == 0
    session.sql("DELETE FROM ns.e WHERE a = 1")
    session.sql("MERGE INTO ns.e t USING (SELECT 1 AS a, 'x' AS b) s ON t.a = s.a WHEN NOT MATCHED THEN INSERT *")
    assert [tuple(r) for r in session.table("e").collect()] == [(1, "x")]
