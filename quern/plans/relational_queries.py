"""Queries over the driver tables, a family of operators each, through DataFrames or SQL text, and the same in DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.functions import pandas_udf, udf
from quern.operators import frames

_QUERIES: dict[str, tuple[Callable, str | None]] = {}


def _query(sql: str | None):
    """Register the function below under its name, with the SQL that must agree."""

    def keep(f):
        _QUERIES[f.__name__] = (f, sql)
        return f

    return keep


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _sql(name: str, tables: list[str], text: str, duck: str | None = None) -> None:
    """Register a query that is SQL text on both engines."""

    def run(spark: SparkSession, d: str) -> DataFrame:
        frames_ = {t: _t(spark, d, t) for t in tables}
        return spark.sql(text.format(**{t: "{" + t + "}" for t in tables}), **frames_)

    _QUERIES[name] = (run, (duck or text).format(**{t: t for t in tables}))


# Scans, filters, projections


@_query("SELECT l_orderkey, l_linenumber, l_quantity * l_extendedprice AS v FROM lineitem WHERE l_shipdate >= timestamp '1995-01-01' AND l_shipdate < timestamp '1995-07-01' AND l_discount BETWEEN 0.02 AND 0.06")
def scan_filter_project(spark, d):
    rows = _t(spark, d, "lineitem").filter("l_shipdate >= timestamp_ntz'1995-01-01' AND l_shipdate < timestamp_ntz'1995-07-01'")
    return rows.where(F.col("l_discount").between(0.02, 0.06)).select("l_orderkey", "l_linenumber", (F.col("l_quantity") * F.col("l_extendedprice")).alias("v"))


@_query("SELECT p_partkey, p_size * 2 AS twice, upper(p_name) AS p_name FROM part")
def select_with_column_rename_drop(spark, d):
    rows = _t(spark, d, "part").withColumn("p_name", F.upper("p_name")).withColumn("twice", F.col("P_SIZE") * 2)
    return rows.withColumnRenamed("nothing", "x").drop("p_size", "p_brand", "p_type", "p_retailprice", "zz").select("p_partkey", "twice", "p_name")


@_query("SELECT p_partkey AS k, p_size + 1 AS n FROM part WHERE p_size % 2 = 0")
def select_expr(spark, d):
    return _t(spark, d, "part").where("p_size % 2 = 0").selectExpr("p_partkey AS k", "p_size + 1 AS n")


@_query("SELECT id FROM range(3, 20, 4) AS r(id)")
def range_frame(spark, d):
    return spark.range(3, 20, 4)


@_query("SELECT * FROM (VALUES (1, 'a', 10.0::double), (2, NULL, NULL)) AS t(id, vendor, amount)")
def create_data_frame(spark, d):
    return spark.createDataFrame([(1, "a", 10.0), (2, None, None)], "id int, vendor string, amount double")


@_query("SELECT vec_id, embedding[1] AS first, embedding[64] AS last FROM embeddings")
def get_item(spark, d):
    return _t(spark, d, "embeddings").select("vec_id", F.col("embedding").getItem(0).alias("first"), F.col("embedding")[63].alias("last"))


@_query("SELECT p_partkey, p_name AS name, p_size + 1 AS size FROM part")
def struct_fields(spark, d):
    rows = _t(spark, d, "part").select("p_partkey", F.struct("p_name", "p_size", "p_brand").alias("s"))
    rows = rows.withColumn("s", F.col("s").withField("p_size", F.col("s.p_size") + 1).dropFields("p_brand"))
    return rows.select("p_partkey", F.col("s").getField("p_name").alias("name"), F.col("s.p_size").alias("size"))


# Joins


def _join_sql(kind: str) -> str:
    return f"SELECT o_orderkey, c_custkey FROM (SELECT * FROM orders WHERE o_custkey % 3 <> 0) o {kind} JOIN (SELECT * FROM customer WHERE c_custkey % 2 = 0) c ON o_custkey = c_custkey"


def _join(kind: str):
    def run(spark, d):
        orders = _t(spark, d, "orders").where("o_custkey % 3 <> 0")
        customers = _t(spark, d, "customer").where("c_custkey % 2 = 0")
        out = frames.join(orders, customers, orders.o_custkey == customers.c_custkey, kind)
        return out.select("o_orderkey", "c_custkey") if "c_custkey" in out.columns else out.select("o_orderkey")

    return run


for _kind, _text in {"inner": "INNER", "left": "LEFT", "leftouter": "LEFT", "right": "RIGHT", "right_outer": "RIGHT", "full": "FULL", "outer": "FULL", "full_outer": "FULL", "semi": "SEMI", "left_semi": "SEMI", "anti": "ANTI", "left_anti": "ANTI"}.items():
    _s = _join_sql(_text)
    _QUERIES[f"join_{_kind}"] = (_join(_kind), _s.replace(", c_custkey FROM", " FROM", 1) if _text in ("SEMI", "ANTI") else _s)


@_query("SELECT r_name, n_name FROM region CROSS JOIN nation")
def join_cross(spark, d):
    return _t(spark, d, "region").crossJoin(_t(spark, d, "nation")).select("r_name", "n_name")


@_query("SELECT count(*) AS n FROM supplier s JOIN customer c ON s_nationkey = c_nationkey AND s_acctbal > c_acctbal + 500")
def join_theta(spark, d):
    s, c = _t(spark, d, "supplier"), _t(spark, d, "customer")
    return s.join(c, (s.s_nationkey == c.c_nationkey) & (s.s_acctbal > c.c_acctbal + 500)).agg(F.count(F.lit(1)).alias("n"))


@_query("SELECT n_nationkey AS k, a.n_name AS a, b.n_name AS b FROM nation a JOIN nation b USING (n_nationkey)")
def join_using(spark, d):
    n = _t(spark, d, "nation").select(F.col("n_nationkey").alias("k"), "n_name")
    return n.withColumnRenamed("n_name", "a").join(n.withColumnRenamed("n_name", "b"), "k")


@_query("SELECT a.id, a.v, b.id AS id_1, b.v AS v_1 FROM (VALUES (1, 'x'), (NULL, 'n')) a(id, v) JOIN (VALUES (1, 'y'), (NULL, 'm')) b(id, v) ON a.id IS NOT DISTINCT FROM b.id")
def join_null_safe_distinct_names(spark, d):
    a = spark.createDataFrame([(1, "x"), (None, "n")], "id int, v string").alias("a")
    b = spark.createDataFrame([(1, "y"), (None, "m")], "id int, v string").alias("b")
    return frames.join(a, b, F.col("a.id").eqNullSafe(F.col("b.id")))


@_query("SELECT n_name, sum(o_totalprice) AS total FROM customer JOIN orders ON c_custkey = o_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY n_name")
def join_star_broadcast(spark, d):
    # Nation and region have fixed sizes.
    nations = _t(spark, d, "nation").join(F.broadcast(_t(spark, d, "region")), F.col("n_regionkey") == F.col("r_regionkey"))
    buyers = _t(spark, d, "customer").join(F.broadcast(nations), F.col("c_nationkey") == F.col("n_nationkey"))
    return buyers.join(_t(spark, d, "orders"), F.col("c_custkey") == F.col("o_custkey")).groupBy("n_name").agg(F.sum("o_totalprice").alias("total"))


# Aggregation

_PRICING = """SELECT l_returnflag, l_linestatus, sum(l_quantity) AS sum_qty, sum(l_extendedprice) AS sum_base, sum(l_extendedprice * (1 - l_discount)) AS sum_disc,
sum(l_extendedprice * (1 - l_discount) * (1 + l_tax)) AS sum_charge, avg(l_quantity) AS avg_qty, avg(l_extendedprice) AS avg_price, avg(l_discount) AS avg_disc, count(*) AS n
FROM lineitem WHERE l_shipdate <= timestamp '1998-09-02' GROUP BY l_returnflag, l_linestatus"""


@_query(_PRICING)
def agg_pricing_summary(spark, d):
    rows = _t(spark, d, "lineitem").where("l_shipdate <= timestamp_ntz'1998-09-02'")
    net = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    return rows.groupBy("l_returnflag", "l_linestatus").agg(
        F.sum("l_quantity").alias("sum_qty"),
        F.sum("l_extendedprice").alias("sum_base"),
        F.sum(net).alias("sum_disc"),
        F.sum(net * (1 + F.col("l_tax"))).alias("sum_charge"),
        F.avg("l_quantity").alias("avg_qty"),
        F.avg("l_extendedprice").alias("avg_price"),
        F.avg("l_discount").alias("avg_disc"),
        F.count(F.lit(1)).alias("n"),
    )


_sql("sql_pricing_summary", ["lineitem"], _PRICING.replace("FROM lineitem", "FROM {lineitem}").replace("timestamp '", "timestamp_ntz '"), _PRICING.replace("FROM lineitem", "FROM {lineitem}"))


@_query("SELECT l_returnflag, l_linestatus, grouping(l_returnflag)::tinyint AS g, count(*) AS n FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)")
def agg_rollup(spark, d):
    return _t(spark, d, "lineitem").rollup("l_returnflag", "l_linestatus").agg(F.grouping("l_returnflag").alias("g"), F.count(F.lit(1)).alias("n"))


@_query("SELECT l_returnflag, l_linestatus, grouping_id(l_returnflag, l_linestatus)::bigint AS g, sum(l_quantity) AS q FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
def agg_cube(spark, d):
    return _t(spark, d, "lineitem").cube("l_returnflag", "l_linestatus").agg(F.grouping_id("l_returnflag", "l_linestatus").alias("g"), F.sum("l_quantity").alias("q"))


_sql("agg_grouping_sets", ["orders"], "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM {orders} GROUP BY GROUPING SETS ((o_orderstatus), (o_orderpriority), ())")


@_query("SELECT l_returnflag, count(*) FILTER (l_linestatus = 'O') AS O, count(*) FILTER (l_linestatus = 'F') AS F FROM lineitem GROUP BY l_returnflag")
def agg_pivot_values(spark, d):
    return _t(spark, d, "lineitem").groupBy("l_returnflag").pivot("l_linestatus", ["O", "F"]).agg(F.count(F.lit(1))).na.fill(0)


@_query("SELECT o_orderpriority, sum(o_totalprice) FILTER (o_orderstatus = 'F') AS F, sum(o_totalprice) FILTER (o_orderstatus = 'O') AS O, sum(o_totalprice) FILTER (o_orderstatus = 'P') AS P FROM orders GROUP BY 1")
def agg_pivot_discovered(spark, d):
    return _t(spark, d, "orders").groupBy("o_orderpriority").pivot("o_orderstatus").agg(F.sum("o_totalprice"))


@_query("SELECT p_brand, max(p_size) AS \"max(p_size)\", avg(p_retailprice) AS \"avg(p_retailprice)\" FROM part GROUP BY p_brand")
def agg_dict(spark, d):
    return frames.agg(_t(spark, d, "part").groupBy("p_brand"), {"p_size": "max", "p_retailprice": "avg"})


@_query("SELECT p_brand, sum(p_size)::bigint AS total, count(*) AS n FROM part GROUP BY p_brand")
def agg_keywords(spark, d):
    return frames.agg(_t(spark, d, "part").groupBy("p_brand"), total=F.sum("p_size"), n=F.count(F.lit(1)))


@_query("SELECT count(*) AS n, count(DISTINCT c_nationkey) AS nations, sum(c_acctbal) AS total FROM customer")
def agg_whole(spark, d):
    return _t(spark, d, "customer").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("c_nationkey").alias("nations"), F.sum("c_acctbal").alias("total"))


@_query("SELECT c_mktsegment, count(*) AS count FROM customer GROUP BY c_mktsegment")
def agg_count(spark, d):
    return _t(spark, d, "customer").groupBy("c_mktsegment").count()


_sql("agg_having", ["orders"], "SELECT o_custkey, count(*) AS n FROM {orders} GROUP BY o_custkey HAVING count(*) > 12")


# Windows, sorting, limits


@_query("SELECT c_mktsegment, c_custkey, c_acctbal FROM (SELECT *, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal DESC, c_custkey) AS r FROM customer) WHERE r <= 3")
def top_k_per_group(spark, d):
    w = Window.partitionBy("c_mktsegment").orderBy(F.desc("c_acctbal"), "c_custkey")
    return _t(spark, d, "customer").withColumn("r", F.row_number().over(w)).where("r <= 3").select("c_mktsegment", "c_custkey", "c_acctbal")


@_query("SELECT event_id, count(*) FILTER (gap) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS session FROM (SELECT *, ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) > interval 30 minute AS gap FROM events)")
def window_sessions(spark, d):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    gap = F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.lag("ts").over(w).cast("timestamp")) > 30 * 60 * 1_000_000
    return _t(spark, d, "events").withColumn("gap", F.coalesce(gap, F.lit(False)).cast("int")).select("event_id", F.sum("gap").over(w).alias("session"))


@_query("SELECT o_orderkey FROM orders ORDER BY o_totalprice DESC NULLS LAST, o_orderkey LIMIT 25")
def order_by_limit(spark, d):
    return _t(spark, d, "orders").orderBy(F.col("o_totalprice").desc_nulls_last(), "o_orderkey").limit(25).select("o_orderkey")


_sql("order_limit_offset", ["part"], "SELECT p_partkey FROM {part} ORDER BY p_retailprice, p_partkey LIMIT 10 OFFSET 5")


@_query("SELECT k, row_number() OVER (ORDER BY v ASC NULLS FIRST, k) AS r FROM (SELECT p_partkey AS k, nullif(p_size, 10) AS v FROM part)")
def order_nulls_first_by_default(spark, d):
    rows = _t(spark, d, "part").select(F.col("p_partkey").alias("k"), F.nullif(F.col("p_size"), F.lit(10)).alias("v"))
    return rows.select("k", F.row_number().over(Window.orderBy("v", "k")).alias("r"))


@_query(None)
def sample(spark, d):
    return _t(spark, d, "orders").sample(fraction=0.2, seed=7).select("o_orderkey")


@_query("SELECT count(*) AS n FROM orders")
def random_split_is_a_partition(spark, d):
    parts = _t(spark, d, "orders").select("o_orderkey").randomSplit([1.0, 2.0, 3.0], seed=3)
    return parts[0].union(parts[1]).union(parts[2]).distinct().agg(F.count(F.lit(1)).alias("n"))


@_query("SELECT n_regionkey AS k, count(*) AS n FROM nation GROUP BY 1")
def repartition_and_coalesce(spark, d):
    rows = _t(spark, d, "nation").repartition(4, "n_regionkey").sortWithinPartitions("n_name").coalesce(2)
    return rows.groupBy(F.col("n_regionkey").alias("k")).agg(F.count(F.lit(1)).alias("n"))


# Set operations


def _sides(spark, d):
    return _t(spark, d, "customer").select(F.col("c_nationkey").alias("k")), _t(spark, d, "supplier").select(F.col("s_nationkey").alias("k"))


for _name, _op, _run in (
    ("union", "UNION ALL", lambda a, b: a.union(b)),
    ("union_distinct", "UNION", lambda a, b: a.union(b).distinct()),
    ("intersect", "INTERSECT", lambda a, b: a.intersect(b)),
    ("intersect_all", "INTERSECT ALL", lambda a, b: a.intersectAll(b)),
    ("except_all", "EXCEPT ALL", lambda a, b: a.exceptAll(b)),
    ("subtract", "EXCEPT", lambda a, b: a.subtract(b)),
):
    _QUERIES[f"set_{_name}"] = ((lambda f: lambda spark, d: f(*_sides(spark, d)))(_run), f"SELECT c_nationkey AS k FROM customer {_op} SELECT s_nationkey FROM supplier")


@_query("SELECT r_regionkey AS a, r_name AS b, NULL::int AS c FROM region UNION ALL SELECT n_nationkey, NULL, n_regionkey FROM nation")
def set_union_by_name(spark, d):
    a = _t(spark, d, "region").select(F.col("r_regionkey").alias("a"), F.col("r_name").alias("b"))
    b = _t(spark, d, "nation").select(F.col("n_regionkey").alias("c"), F.col("n_nationkey").alias("A"))
    return a.unionByName(b, allowMissingColumns=True).select("a", "b", "c")


@_query("SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders")
def distinct(spark, d):
    return _t(spark, d, "orders").select("o_orderstatus", "o_orderpriority").distinct()


@_query("SELECT DISTINCT o_custkey FROM orders")
def drop_duplicates(spark, d):
    return _t(spark, d, "orders").dropDuplicates(["o_custkey"]).select("o_custkey")


# Nulls and statistics


def _gaps(spark, d):
    return _t(spark, d, "part").select(F.col("p_partkey").alias("k"), F.nullif("p_size", F.lit(10)).alias("a"), F.nullif("p_brand", F.lit("Brand#11")).alias("b"))


_GAPS = "(SELECT p_partkey AS k, nullif(p_size, 10) AS a, nullif(p_brand, 'Brand#11') AS b FROM part)"


@_query(f"SELECT * FROM {_GAPS} WHERE a IS NOT NULL AND b IS NOT NULL")
def na_drop_any(spark, d):
    return _gaps(spark, d).na.drop()


@_query(f"SELECT * FROM {_GAPS} WHERE a IS NOT NULL OR b IS NOT NULL")
def na_drop_thresh(spark, d):
    return _gaps(spark, d).na.drop(thresh=2)


@_query(f"SELECT k, coalesce(a, -1) AS a, b FROM {_GAPS}")
def na_fill_only_fitting_columns(spark, d):
    return _gaps(spark, d).na.fill(-1)


@_query(f"SELECT k, coalesce(a, 0) AS a, coalesce(b, 'none') AS b FROM {_GAPS}")
def na_fill_dict(spark, d):
    return _gaps(spark, d).fillna({"a": 0, "b": "none"})


@_query(f"SELECT k, CASE a WHEN 1 THEN 100 WHEN 2 THEN 200 ELSE a END AS a, b FROM {_GAPS}")
def na_replace(spark, d):
    return _gaps(spark, d).na.replace([1, 2], [100, 200], ["a"])


@_query("SELECT round(corr(p_size, p_retailprice), 9) AS c, round(covar_samp(p_size, p_retailprice), 4) AS v FROM part")
def stat_corr_cov(spark, d):
    part = _t(spark, d, "part")
    return spark.createDataFrame([(round(part.stat.corr("p_size", "p_retailprice"), 9), round(part.stat.cov("p_size", "p_retailprice"), 4))], "c double, v double")


@_query("SELECT o_orderstatus AS o_orderstatus_o_orderpriority, " + ", ".join(f"count(*) FILTER (o_orderpriority = '{p}') AS \"{p}\"" for p in ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")) + " FROM orders GROUP BY 1")
def stat_crosstab(spark, d):
    return frames.crosstab(_t(spark, d, "orders"), "o_orderstatus", "o_orderpriority")


@_query("SELECT list_sort(list(v)) AS n_regionkey_freqItems FROM (SELECT n_regionkey AS v FROM nation GROUP BY 1 HAVING count(*) >= 0.2 * (SELECT count(*) FROM nation))")
def stat_freq_items(spark, d):
    return frames.freq_items(_t(spark, d, "nation"), ["n_regionkey"], 0.2)


@_query("SELECT quantile_disc(p_size, [0.0, 0.25, 0.5, 1.0])::double[] AS q FROM part")
def stat_approx_quantile(spark, d):
    return spark.createDataFrame([(frames.quantiles(_t(spark, d, "part"), "p_size", [0.0, 0.25, 0.5, 1.0]),)], "q array<double>")


# Generators


@_query("SELECT doc_id, unnest(string_split(lang || ',' || source, ',')) AS col FROM documents")
def gen_explode(spark, d):
    return _t(spark, d, "documents").select("doc_id", F.explode(F.split(F.concat_ws(",", "lang", "source"), ",")))


@_query("SELECT p_partkey, unnest(CASE WHEN p_size > 25 THEN [p_size, 1] ELSE [NULL::int] END) AS col FROM part")
def gen_explode_outer(spark, d):
    some = F.when(F.col("p_size") > 25, F.array("p_size", F.lit(1)))
    return _t(spark, d, "part").select("p_partkey", F.explode_outer(some))


@_query("SELECT vec_id, i - 1 AS pos, embedding[i] AS col FROM embeddings, range(1, 65) AS r(i)")
def gen_posexplode(spark, d):
    return _t(spark, d, "embeddings").select("vec_id", F.posexplode("embedding"))


@_query("SELECT p_partkey, CASE WHEN p_size > 25 THEN 0 END AS pos, CASE WHEN p_size > 25 THEN p_size END AS col FROM part")
def gen_posexplode_outer(spark, d):
    return _t(spark, d, "part").select("p_partkey", F.posexplode_outer(F.when(F.col("p_size") > 25, F.array("p_size"))))


@_query("SELECT p_partkey, unnest(['n', 's']) AS key, unnest([p_name, p_size::varchar]) AS value FROM part")
def gen_explode_map(spark, d):
    return _t(spark, d, "part").select("p_partkey", F.explode(F.create_map(F.lit("n"), "p_name", F.lit("s"), F.col("p_size").cast("string"))))


@_query("SELECT p_partkey, unnest([p_size, 0]) AS a, unnest([p_name, 'z']) AS b FROM part")
def gen_inline(spark, d):
    pair = F.array(F.struct(F.col("p_size").alias("a"), F.col("p_name").alias("b")), F.struct(F.lit(0).alias("a"), F.lit("z").alias("b")))
    return _t(spark, d, "part").select("p_partkey", F.inline(pair))


@_query("SELECT p_partkey, CASE WHEN p_size > 25 THEN p_size END AS a FROM part")
def gen_inline_outer(spark, d):
    return _t(spark, d, "part").select("p_partkey", F.inline_outer(F.when(F.col("p_size") > 25, F.array(F.struct(F.col("p_size").alias("a"))))))


@_query("SELECT event_id, json_extract_string(props, '$.k') AS c0, NULL::varchar AS c1 FROM events")
def gen_json_tuple(spark, d):
    return _t(spark, d, "events").select("event_id", F.json_tuple("props", "k", "zz"))


# SQL text

_sql("sql_cte_subquery", ["orders", "customer"], "WITH big AS (SELECT o_custkey, sum(o_totalprice) AS total FROM {orders} GROUP BY o_custkey) SELECT c_custkey, total FROM {customer} JOIN big ON c_custkey = o_custkey WHERE total > (SELECT avg(total) FROM big)")
_sql("sql_exists_in", ["orders", "customer", "lineitem"], "SELECT o_orderkey FROM {orders} o WHERE EXISTS (SELECT 1 FROM {lineitem} l WHERE l.l_orderkey = o.o_orderkey AND l.l_quantity > 45) AND o_custkey IN (SELECT c_custkey FROM {customer} WHERE c_mktsegment = 'BUILDING')")
_sql("sql_set_operations", ["customer", "supplier"], "SELECT c_nationkey AS k FROM {customer} EXCEPT (SELECT s_nationkey FROM {supplier} INTERSECT SELECT c_nationkey FROM {customer} WHERE c_acctbal > 0)")
_sql("sql_shipping_priority", ["customer", "orders", "lineitem"], "SELECT l_orderkey, sum(l_extendedprice * (1 - l_discount)) AS revenue FROM {customer} JOIN {orders} ON c_custkey = o_custkey JOIN {lineitem} ON l_orderkey = o_orderkey WHERE c_mktsegment = 'BUILDING' GROUP BY l_orderkey HAVING sum(l_extendedprice * (1 - l_discount)) > 100000")
_sql("sql_window", ["orders"], "SELECT o_orderkey, rank() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS r FROM {orders}")


# User functions


@_query("SELECT p_partkey, p_brand || '/' || p_size AS v FROM part")
def udf_scalar(spark, d):
    return _t(spark, d, "part").select("p_partkey", udf(lambda b, n: f"{b}/{n}", "string")("p_brand", "p_size").alias("v"))


@_query("SELECT p_partkey, p_retailprice * 2 AS v FROM part")
def udf_vectorised(spark, d):
    return _t(spark, d, "part").select("p_partkey", pandas_udf(lambda s: s * 2, "double")("p_retailprice").alias("v"))


@_query("SELECT p_partkey, CASE WHEN p_size = 10 THEN NULL ELSE 1 END AS v FROM part")
def udf_skips_all_null(spark, d):
    return _t(spark, d, "part").select("p_partkey", udf(lambda n: 1, "int")(F.nullif("p_size", F.lit(10))).alias("v"))


def queries() -> dict[str, Callable]:
    return {name: f for name, (f, _) in _QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _QUERIES.items() if sql is not None}
