"""Sessions, frames, readers, functions and user functions."""

import datetime as dt
import json

import pandas as pd
import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from quern import functions as qf
from quern.errors import QuernError, UnsupportedFeatureError
from quern.functions import udf
from quern.operators import frames
from quern.session import Session, resolve_settings, split_name


def test_create_data_frame_casts(session):
    got = session.createDataFrame([(1, "7", "x"), ("2", None, 3.5)], "a int, b int, c string").collect()
    assert [tuple(r) for r in got] == [(1, 7, "x"), (2, None, "3.5")]
    assert session.createDataFrame([("bad",)], "a int").first()["a"] is None
    assert session.createDataFrame([{"a": 1}, {"b": 2}], "a int, b int").collect()[1]["b"] == 2
    assert session.createDataFrame([], "a int").columns == ["a"]
    assert session.createDataFrame(pd.DataFrame({"x": [1.9]}), "x int").first()["x"] == 1


def test_range_and_settings(session):
    assert [r[0] for r in session.range(5).collect()] == [0, 1, 2, 3, 4]
    with pytest.raises(AnalysisException):
        session.range(0, 5, 0)
    assert resolve_settings({"quern.a": 1}, env={"QUERN_A": "2", "QUERN_SPARK_X_Y": "z"}) == {"quern.a": "1", "spark.x.y": "z"}
    assert split_name("a.`b.c`.d") == ["a", "b.c", "d"]
    for bad in ("", "a..b", "a.", "`a"):
        with pytest.raises(AnalysisException):
            split_name(bad)
    assert Session.getActiveSession() is session and session.conf.get("spark.sql.ansi.enabled") == "false"


def test_no_active_session():
    Session._active = None
    with pytest.raises(QuernError):
        Session.active()


def test_readers(session, tmp_path):
    frame = session.createDataFrame([(1, "a"), (2, None), (3, "c")], "id int, v string")
    for kind in ("parquet", "csv", "json"):
        session.write(frame).mode("overwrite").format(kind).option("header", True).save(str(tmp_path / kind))
    assert session.read.parquet(str(tmp_path / "parquet")).count() == 3
    assert dict(session.read.csv(str(tmp_path / "csv"), header=True).dtypes) == {"id": "int", "v": "string"}
    assert session.read.format("json").load(str(tmp_path / "json")).count() == 3
    (tmp_path / "array.json").write_text("\n " + json.dumps([{"a": 1}, {"a": 2}]))
    assert [r["a"] for r in session.read.json(str(tmp_path / "array.json")).collect()] == [1, 2]
    (tmp_path / "semi.csv").write_text("id;d\n1;2026-08-17\nNA;\n")
    got = session.read.csv(str(tmp_path / "semi.csv"), header=True, sep=";", nullValue="NA")
    assert got.collect()[0]["d"] == dt.date(2026, 8, 17) and got.collect()[1]["id"] is None
    with pytest.raises(UnsupportedFeatureError):
        session.write(frame).save(str(tmp_path / "x"))


def test_frames(session, plain):
    left, right = plain.alias("l"), plain.alias("r")
    both = frames.join(left, right, F.col("l.id") == F.col("r.id"))
    assert both.columns == ["id", "vendor", "amount", "id_1", "vendor_1", "amount_1"] and both.count() == 5
    for how, n in {"left_outer": 5, "anti": 0, "leftsemi": 5, "full_outer": 5, "cross": 5}.items():
        assert frames.join(plain, plain, "id", how).count() == n
    assert frames.join(plain, plain).count() == 25
    with pytest.raises(AnalysisException):
        frames.join(plain, plain, how="left")
    with pytest.raises(AnalysisException):
        frames.join(plain, plain, "id", "sideways")
    assert frames.agg(plain.groupBy("vendor"), total=F.sum("amount")).columns == ["vendor", "total"]
    assert frames.agg(plain, {"amount": "max"}).first()[0] == 50.0
    assert frames.freq_items(plain, ["vendor"], 0.4).first()["vendor_freqItems"] == ["a"]
    table = {r[0]: r.asDict() for r in frames.crosstab(plain, "vendor", "id").collect()}
    assert table["a"]["1"] == 1 and table["a"]["2"] == 0 and table["null"]["5"] == 1
    assert frames.quantiles(plain, "amount", [0.0, 0.5, 1.0]) == [10.0, 20.5, 50.0]
    with pytest.raises(UnsupportedFeatureError):
        frames.select_one_generator(plain, F.explode(F.array("id")), F.explode(F.array("id")))
    batches = list(frames.arrow_batches(plain.coalesce(1), 2))
    assert [b.num_rows for b in batches] == [2, 2, 1] and batches[0].schema.names == plain.columns
    assert frames.count(session, "ns.plain") == 5
    numbered = qf.consecutive_id(session.range(0, 1000, 1, 7), "n")
    assert numbered.where("n = id").count() == 1000


def test_function_surface(session):
    assert len(qf.__all__) == 316 and all(callable(getattr(qf, n)) for n in qf.__all__)
    one = session.range(1)
    assert one.select(qf.element_at(F.array(F.lit(1)), 5)).first()[0] is None
    assert one.select(qf.any(F.lit(True))).first()[0] is True
    assert "upper" in session.catalog.listFunctions() and session.catalog.functionExists("md5")


def test_user_functions(session, plain):
    calls = []

    def both(a, b):
        calls.append(1)
        return f"{a}/{b}"

    session.udf.register("both", both)
    got = session.sql("SELECT id, both(vendor, amount) b, both(NULL, NULL) n FROM ns.plain ORDER BY id").collect()
    assert got[0]["b"] == "a/10.0" and got[4]["b"] == "None/50.0" and got[0]["n"] is None
    session.udf.register("both", lambda a, b: "again", callOnNull=True)
    assert session.sql("SELECT both(NULL, NULL) b").first()["b"] == "again"
    session.udf.registerVectorised("twice", lambda s: s * 2, "double")
    assert session.sql("SELECT twice(amount) t FROM ns.plain WHERE id = 1").first()["t"] == 20.0
    session.udf.unregister("both")
    with pytest.raises(AnalysisException):
        session.sql("SELECT both(1, 2)").collect()

    @udf(returnType="int")
    def plus(x):
        return x + 1

    assert plain.select(plus("id").alias("p")).orderBy("p").first()["p"] == 2
