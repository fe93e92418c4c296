"""DELETE, UPDATE and MERGE, and queries through the SQL surface."""

import pytest
from pyspark.errors import AnalysisException

from quern.errors import UnsupportedFeatureError


def rows(session, name="plain"):
    return sorted((tuple(r) for r in session.table(name).collect()), key=lambda r: (r[0] is None, r))


def test_delete_keeps_rows_whose_condition_is_unknown(session, plain):
    session.sql("DELETE FROM ns.plain WHERE amount > 15")
    assert [r[0] for r in rows(session)] == [1, 4]
    session.sql("DELETE FROM ns.plain AS p WHERE p.id IN (SELECT max(id) FROM ns.plain)")
    assert [r[0] for r in rows(session)] == [1]
    session.sql("DELETE FROM ns.plain")
    assert rows(session) == []


def test_delete_of_whole_files_rewrites_nothing(session, partitioned):
    session.sql("DELETE FROM ns.partitioned WHERE as_at_date = '2026-08-16'")
    last = session.table("partitioned.snapshots").orderBy("committed_at").collect()[-1]
    assert last["operation"] == "delete" and last["summary"]["added-data-files"] == "0" and last["summary"]["deleted-records"] == "4"
    session.sql("DELETE FROM ns.partitioned WHERE id = 0")
    last = session.table("partitioned.snapshots").orderBy("committed_at").collect()[-1]
    assert last["summary"]["deleted-data-files"] == "1" and last["summary"]["added-records"] == "3"


def test_update_sees_old_values(session, plain):
    session.sql("UPDATE ns.plain SET amount = id * 2, id = id + 100 WHERE vendor = 'a'")
    assert rows(session) == [(2, "b", 20.5), (4, "c", None), (5, None, 50.0), (101, "a", 2.0), (103, "a", 6.0)]
    session.sql("UPDATE ns.plain SET vendor = 'q'")
    assert {r[1] for r in rows(session)} == {"q"}
    with pytest.raises(AnalysisException):
        session.sql("UPDATE ns.plain SET nothing = 1")
    with pytest.raises(UnsupportedFeatureError):
        session.sql("UPDATE ns.plain SET vendor = 'x' WHERE id IN (SELECT 1)")


def test_merge_all_clauses(session, plain):
    session.createDataFrame([(1, "new", 1.0), (2, None, None), (9, "i", 9.0), (10, None, 3.0)], "id bigint, vendor string, amount double").createOrReplaceTempView("src")
    session.sql(
        "MERGE INTO ns.plain AS t USING src AS s ON t.id = s.id "
        "WHEN MATCHED AND s.amount IS NULL THEN DELETE WHEN MATCHED THEN UPDATE SET t.vendor = s.vendor, amount = t.amount + s.amount "
        "WHEN NOT MATCHED AND s.vendor IS NOT NULL THEN INSERT (id, amount) VALUES (s.id, s.amount) "
        "WHEN NOT MATCHED BY SOURCE AND t.vendor = 'c' THEN DELETE WHEN NOT MATCHED BY SOURCE AND t.id = 5 THEN UPDATE SET vendor = 'gone'"
    )
    assert rows(session) == [(1, "new", 11.0), (3, "a", 30.25), (5, "gone", 50.0), (9, None, 9.0)]


def test_merge_star_and_first_clause_wins(session, plain):
    session.createDataFrame([(1, "x", 1.0), (6, "y", 6.0)], "id bigint, vendor string, amount double").createOrReplaceTempView("src")
    session.sql("MERGE INTO ns.plain t USING src s ON t.id = s.id WHEN MATCHED AND t.id = 1 THEN UPDATE SET * WHEN MATCHED THEN DELETE WHEN NOT MATCHED THEN INSERT *")
    assert rows(session)[0] == (1, "x", 1.0) and rows(session)[-1] == (6, "y", 6.0) and len(rows(session)) == 6
    with pytest.raises(AnalysisException):
        session.sql("MERGE INTO ns.plain t USING (SELECT 1 AS id) s ON t.id = s.id WHEN MATCHED THEN UPDATE SET *")


def test_merge_refuses_two_matches_for_one_row(session, plain):
    session.createDataFrame([(1, "x"), (1, "y")], "id bigint, v string").createOrReplaceTempView("src")
    with pytest.raises(AnalysisException, match="several source rows"):
        session.sql("MERGE INTO ns.plain t USING src s ON t.id = s.id WHEN MATCHED THEN UPDATE SET vendor = s.v")
    assert len(rows(session)) == 5


def test_merge_insert_only_appends_and_null_keys_never_match(session, plain):
    session.createDataFrame([(None, "n", 0.0), (1, "x", 0.0)], "id bigint, vendor string, amount double").createOrReplaceTempView("src")
    session.sql("MERGE INTO ns.plain t USING src s ON t.id = s.id WHEN NOT MATCHED THEN INSERT *")
    assert rows(session)[-1] == (None, "n", 0.0) and len(rows(session)) == 6
    assert session.table("plain.snapshots").orderBy("committed_at").collect()[-1]["operation"] == "append"


def test_merge_touches_only_files_with_a_match(session, partitioned):
    session.sql("MERGE INTO ns.partitioned t USING (SELECT 5 AS id, 99.0 AS amount) s ON t.id = s.id WHEN MATCHED THEN UPDATE SET amount = s.amount")
    last = session.table("partitioned.snapshots").orderBy("committed_at").collect()[-1]["summary"]
    assert last["deleted-data-files"] == "1" and last["total-records"] == "12"


def test_queries_join_managed_tables_views_and_ctes(session, plain, partitioned):
    plain.createOrReplaceTempView("v")
    got = session.sql(
        "WITH c AS (SELECT id, amount FROM ns.plain WHERE id IN (SELECT id FROM ns.partitioned)) "
        "SELECT c.id, plain.vendor, v.amount FROM c JOIN ns.plain ON c.id = plain.id JOIN v ON v.id = c.id WHERE EXISTS (SELECT 1 FROM partitioned p WHERE p.id = c.id) ORDER BY 1"
    )
    assert [r["id"] for r in got.collect()] == [1, 2, 3, 4, 5]
    assert session.sql("SELECT count(*) c FROM ns.plain UNION ALL SELECT count(*) FROM ns.partitioned.files").collect()[1]["c"] == 3
    assert session.sql("SELECT :x + 1 AS y", {"x": 1}).first()["y"] == 2


def test_a_view_shadows_a_table(session, plain):
    session.createDataFrame([(77,)], "id bigint").createOrReplaceTempView("plain")
    assert session.table("plain").count() == 1 and session.sql("SELECT * FROM plain").count() == 1
    assert session.sql("SELECT * FROM ns.plain").count() == 5
    assert session.dropTempView("plain") and session.table("plain").count() == 5
