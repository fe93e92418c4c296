"""Sharding by a hierarchical weighted hash tree (native).

A tree has regions, a region racks, a rack shards, every shard a weight; a rack's weight is the sum of its shards',
a region's the sum of its racks'. A row descends: at each level every child draws -ln(u) / weight, u being a hash of
the child's place and the row's key, and the least draw wins. A child's draw depends on its own weight and place
alone, so a change of weight moves rows only into or out of the subtrees whose weights changed. `grow` gives a new
shard a region of its own: no old subtree changes weight, and rows move into the new shard only.

Defined results: a null key counts as the text 'null'; a null text has no bytes; an empty table gives no rows; rows
with equal keys share a shard and get slots of their own; other columns than the named ones are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.llm import common

#: Hash bits of a draw: 13 hexadecimal digits, which a double holds exactly.
DIGITS = 13


@dataclass(frozen=True)
class Tree:
    """Weights by region, rack and shard. Shards are numbered in that order from 0."""

    regions: tuple[tuple[tuple[float, ...], ...], ...]

    @staticmethod
    def even(regions: int, racks: int, shards: int) -> Tree:
        return Tree((((1.0,) * shards,) * racks,) * regions)

    def grow(self, weight: float = 1.0) -> Tree:
        """One more shard, in a region of its own."""
        return Tree((*self.regions, ((weight,),)))

    @property
    def shards(self) -> int:
        return sum(len(rack) for region in self.regions for rack in region)


def _numbers(values: list) -> Column:
    return F.array(*[F.lit(float(x)) for x in values])


def _draw(level: str, place: Column, key: Column, weights: Column) -> Column:
    """Index of the child with the least draw; ties go to the first."""

    def one(weight: Column, k: Column) -> Column:
        text = F.concat(F.lit(level), place, F.lit("."), k.cast("string"), F.lit("/"), key)
        bits = F.conv(F.substring(F.md5(text.cast("binary")), 1, DIGITS), 16, 10).cast("double")
        u = (bits + F.lit(0.5)) / F.lit(float(16**DIGITS))
        return F.struct((-F.log(u) / weight).alias("draw"), k.alias("k"))

    return F.array_min(F.transform(weights, one))["k"]


def shard_of(df: DataFrame, key: Column, tree: Tree, name: str) -> DataFrame:
    """df with the shard of each row in column `name`; one pass, no shuffle."""
    racks = F.array(*[_numbers([sum(rack) for rack in region]) for region in tree.regions])
    leaves = F.array(*[F.array(*[_numbers(list(rack)) for rack in region]) for region in tree.regions])
    first, at = [], 0
    for region in tree.regions:
        row = []
        for rack in region:
            row.append(at)
            at += len(rack)
        first.append(F.array(*[F.lit(x) for x in row]))
    text = F.coalesce(key.cast("string"), F.lit("null"))
    tops = _numbers([sum(map(sum, region)) for region in tree.regions])
    r, k, s = (f"__{name}_{x}" for x in ("region", "rack", "shard"))
    df = df.withColumn(r, _draw("region", F.lit(""), text, tops))
    df = df.withColumn(k, _draw("rack", F.col(r).cast("string"), text, F.get(racks, F.col(r))))
    place = F.concat(F.col(r).cast("string"), F.lit("."), F.col(k).cast("string"))
    df = df.withColumn(s, _draw("shard", place, text, F.get(F.get(leaves, F.col(r)), F.col(k))))
    number = F.get(F.get(F.array(*first), F.col(r)), F.col(k)) + F.col(s)
    return df.withColumn(name, number.cast("int")).drop(r, k, s)


def with_slots(df: DataFrame, shard: str, order: str, shards: int, rows_per_group: int = 200_000) -> DataFrame:
    """df with `slot`: 0, 1, 2 ... within each shard by `order`.

    A shard is ranked in ranges of `order`, so no task holds a whole shard: the number of ranges follows the row
    count, rows are numbered within (shard, range), and the ranges' counts, at most shards x 4096 rows, are summed
    before they are joined back.
    """
    n = df.count()
    ranges = min(4096, -(-n // max(1, shards * rows_per_group)))
    bucket = F.lit(0)
    if ranges > 1:
        probabilities = [i / ranges for i in range(1, ranges)]
        bounds = df.agg(F.percentile_approx(order, probabilities, 20 * ranges).alias("b")).first()["b"] or []
        bounds = F.array(*[F.lit(b) for b in sorted(set(bounds))])
        bucket = F.coalesce(F.size(F.filter(bounds, lambda b: b <= F.col(order))), F.lit(0))
    df = df.withColumn("__range", bucket)
    before = Window.partitionBy(shard).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    counts = df.groupBy(shard, "__range").agg(F.count(F.lit(1)).alias("__n"))
    counts = counts.select(shard, "__range", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    within = Window.partitionBy(shard, "__range").orderBy(order)
    ranked = df.withColumn("__rank", F.row_number().over(within))
    joined = ranked.join(F.broadcast(counts), [shard, "__range"])
    return joined.withColumn("slot", F.col("__rank") - 1 + F.col("__before")).drop("__rank", "__before", "__range")


def assign(docs: DataFrame, tree: Tree) -> DataFrame:
    """The `key` law over documents: doc_id, size, text_crc32, law, shard, slot, grown_shard."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(
        "doc_id",
        (F.octet_length(text) + 16).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.lit("key").alias("law"),
    )
    rows = shard_of(rows, F.col("doc_id"), tree, "shard")
    # Ranking reads these rows several times, the texts only once.
    rows = common.checkpointed(shard_of(rows, F.col("doc_id"), tree.grow(), "grown_shard"))
    rows = with_slots(rows, "shard", "doc_id", tree.shards)
    return rows.select("doc_id", "size", "text_crc32", "law", "shard", F.col("slot").cast("long"), "grown_shard")


#: 40 shards: 5 regions of 2 racks of 4 shards.
TREE = Tree.even(5, 2, 4)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign(common.table(spark, sf_dir, "documents").select("doc_id", "text"), TREE)


def _crc_table() -> list[int]:
    out = []
    for i in range(256):
        for _ in range(8):
            i = (i >> 1) ^ (0xEDB88320 if i & 1 else 0)
        out.append(i)
    return out


def oracle() -> str:
    def draw(level: str, place: str, n: str) -> str:
        text = f"concat('{level}', {place}, '.', c, '/', coalesce(doc_id::varchar, 'null'))"
        return f"-ln((('0x' || substr(md5({text}), 1, {DIGITS}))::bigint::double + 0.5) / {float(16**DIGITS)!r}) / {n}"

    return f"""
with d as (select row_number() over () as i, doc_id, coalesce(text, '') as t from documents),
bytes as (select i, doc_id, strlen(t) + 16 as size, hex(encode(t)) as h from d),
crc as (
  select i, doc_id, size, xor(list_reduce(
    list_transform(range(0, length(h) // 2), lambda k: ('0x' || substr(h, (2 * k + 1)::bigint, 2))::bigint),
    lambda a, b: xor(a >> 8, {_crc_table()}[(xor(a, b) & 255) + 1]), 4294967295), 4294967295) as text_crc32
  from bytes),
r5 as (select i, doc_id, arg_min(c, ({draw("region", "''", "8.0")}, c)) as r
       from crc, range(0, 5) as g(c) group by all),
r6 as (select i, ({draw("region", "''", "8.0")}) as old from crc, range(0, 5) as g(c)),
new as (select i, {draw("region", "''", "1.0").replace("'.', c", "'.', '5'")} as fresh from crc),
best as (select i, min(old) as least from r6 group by i),
k as (select i, doc_id, r, arg_min(c, ({draw("rack", "r", "4.0")}, c)) as k from r5, range(0, 2) as g(c) group by all),
s as (select i, k.r * 8 + k.k * 4 + arg_min(c, ({draw("shard", "concat(k.r, '.', k.k)", "1.0")}, c)) as shard
      from k, range(0, 4) as g(c) group by i, doc_id, k.r, k.k)
select crc.doc_id, size, text_crc32, 'key' as law, shard::int as shard,
  row_number() over (partition by shard order by crc.doc_id) - 1 as slot,
  (case when fresh < least then 40 else shard end)::int as grown_shard
from crc join s using (i) join new using (i) join best using (i)"""
