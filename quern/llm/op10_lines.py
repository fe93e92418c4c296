"""Line dedup: fuzzy lines by MinHash (native).

Lines that hold a word are made distinct first, so exact copies cost one row each. A distinct line's shingles are the
strings of `CHARS` characters in it; two lines are alike if the Jaccard similarity of their shingle sets is `similar` or
more. Shingles come from an explode that stays in generated code; each of `POINTS` hash functions keeps its least value
over all of them, whatever the line's length. The functions are the points of the affine plane of order 4, and the values
on each of its 20 lines make a key: two lines meet if they agree on all points of one line. So 16 functions find more than
40 in disjoint bands would. Lines with a common key are candidates, and exact shingle sets decide.

Each line is first compared with one other, the most central line (which meets most) under any of its keys, and
union-find joins what is alike. Under keys whose lines are still in different components, those outside the central
line's component, the key's main one, then meet one line that stands for main components, and what is still outside is compared with all lines of other components, so no pair of a key that could still join two is
left out. Bitmaps of the shingles come before the sets there: they bound the similarity from above, and a pair is ruled
out only where the bound is below `similar`, so nothing is lost and few pairs have their texts fetched. A large group of
variants costs about a comparison each.
Components keep the first occurrence of their lines; all other occurrences go.

Defined results: lines without a word stay and aren't compared; a null text has no line and stays null; repeated rows
count as later occurrences; an empty table gives no rows; docs' own columns may have any names. docs must give the same
rows in the same partitions whenever it is read: a table or a checkpoint.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm import common
from quern.llm.components import components

CHARS = 8
#: Hash functions, the points (x, y) of the affine plane of order 4. Two lines of similarity 0.8 agree on all points of one
#: of its lines at least with probability 0.995, of similarity 0.85 with 0.999.
POINTS = 16
#: Shingles of a line that become one row on their way to the least values.
AT_ONCE = 4
#: Keys in common from which a line is compared with a central one at once; with fewer it may be later. Lines of similarity
#: 0.8 have 8 on average, of 0.6 less than 3.
STAR_KEYS = 4
#: Turns in which lines outside the main component of a key meet one line of it, before they meet all.
TURNS = 1
#: Longs of a bitmap: each shingle turns one of 64 x WORDS bits.
WORDS = 32
#: Parts of the pairs of one line, which keep a line with very many of them out of a single task.
SALTS = 1024
#: Odd multipliers of the hash functions, from a rule: powers of a 64-bit constant.
MULTIPLIERS = [pow(0x9E3779B97F4A7C15, k + 1, 1 << 64) for k in range(POINTS)]


def _times(a: int, b: int) -> int:
    """Product in the field of four elements: of polynomials over bits, modulo x^2 + x + 1."""
    product = (a if b & 1 else 0) ^ (a << 1 if b & 2 else 0)
    return product ^ 0b111 if product & 0b100 else product


#: The plane's 20 lines as lists of points 4x + y: y = mx + c for each m and c, and x = c.
PLANE = [[4 * x + (_times(m, x) ^ c) for x in range(4)] for m in range(4) for c in range(4)]
PLANE += [[4 * c + y for y in range(4)] for c in range(4)]


def lines_of(docs: DataFrame) -> DataFrame:
    """rid, pos, line, id of the lines with a word in docs (rid, text); id: the line's XXH64."""
    parts = docs.select("rid", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    parts = parts.where(_is_line(F.col("line")))
    return parts.select("rid", "pos", "line", F.xxhash64("line").alias("id"))


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def _shingle(units: Column, i: Column) -> Column:
    """The hash of the i-th shingle of a line in UTF-16."""
    return F.xxhash64(F.substr(units, i * 2 + 1, F.lit(2 * CHARS)))


def _last(units: Column) -> Column:
    return F.greatest(F.lit(0), F.floor(F.octet_length(units) / 2).cast("int") - CHARS)


def _shingles(lines: DataFrame) -> DataFrame:
    """id, h: the hash of each shingle, repeats included, of lines (id, line)."""
    units = lines.select("id", F.encode("line", "UTF-16BE").alias("u"))
    places = units.select("id", "u", F.explode(F.sequence(F.lit(0), _last(F.col("u")))).alias("i"))
    return places.select("id", _shingle(F.col("u"), F.col("i")).alias("h"))


def keys_of(lines: DataFrame) -> DataFrame:
    """id, key: the keys of lines (id, line), one for each line of the plane. Without a shuffle if the lines lie by id."""
    units = lines.select("id", F.encode("line", "UTF-16BE").alias("u"))
    rows = units.select("id", "u", _last(F.col("u")).alias("last"), F.explode(F.sequence(F.lit(0), _last(F.col("u")), F.lit(AT_ONCE))).alias("i"))
    rows = rows.select("id", *[_shingle(F.col("u"), F.least("last", F.col("i") + k)).alias(f"h{k}") for k in range(AT_ONCE)])
    values = [F.least(*[F.col(f"h{k}") * F.lit(_signed(a)) for k in range(AT_ONCE)]) for a in MULTIPLIERS]
    least = rows.groupBy("id").agg(*[F.min(v).alias(f"m{k}") for k, v in enumerate(values)])
    keys = [F.xxhash64(F.lit(n), *[F.col(f"m{k}") for k in points]) for n, points in enumerate(PLANE)]
    return least.select("id", F.explode(F.array(*keys)).alias("key"))


def bitmaps_of(lines: DataFrame) -> DataFrame:
    """id, n (a line's different shingles), bits: WORDS longs in which each of them turns one bit; lines: id, line."""
    h = F.col("h")
    words = _shingles(lines).groupBy("id", "h").agg(F.lit(1).alias("one"))
    words = words.select("id", F.shiftrightunsigned(h, 6).bitwiseAND(WORDS - 1).alias("w"), h.bitwiseAND(63).cast("int").alias("bit"))
    words = words.groupBy("id", "w").agg(F.bit_xor(F.expr("shiftleft(1L, bit)")).alias("x"), F.count(F.lit(1)).alias("c"))
    each = [F.max(F.when(F.col("w") == k, F.col("x"))).alias(f"x{k}") for k in range(WORDS)]
    whole = words.groupBy("id").agg(F.sum("c").alias("n"), *each)
    return whole.select("id", "n", F.array(*[F.coalesce(F.col(f"x{k}"), F.lit(0).cast("long")) for k in range(WORDS)]).alias("bits"))


def _differing(bits_a: str, bits_b: str) -> Column:
    """The number of places in which two bitmaps differ."""
    differ = F.lit(0)
    for k in range(WORDS):
        differ = differ + F.bit_count(F.get(bits_a, F.lit(k)).bitwiseXOR(F.get(bits_b, F.lit(k))))
    return differ


def _possible(similar: float, n_a: str, bits_a: str, n_b: str, bits_b: str) -> Column:
    """False only if two lines are less than `similar`.

    A bit can differ only by a shingle that just one of them has: common ones turn it in both. With d such bits and s shingles in
    both sets together, at most (s - d) / 2 are common, and the similarity is at most (s - d) / (s + d).
    """
    sizes = F.least(n_a, n_b) >= similar * F.greatest(n_a, n_b)
    return sizes & (_differing(bits_a, bits_b) * (1 + similar) <= (F.col(n_a) + F.col(n_b)) * (1 - similar) + 1e-6)


def _with_text(pairs: DataFrame, lines: DataFrame, end: str, other: str) -> DataFrame:
    """pairs with the text of one end, dealt by that end and a salt (`salt_<end>`)."""
    salted = pairs.withColumn(f"salt_{end}", F.pmod(F.xxhash64(other), F.lit(SALTS)))
    wanted = salted.select(F.col(end).alias("id"), F.col(f"salt_{end}")).distinct()
    found = lines.select("id", "line").join(wanted.hint("shuffle_hash"), "id")
    return salted.join(found.select(F.col("id").alias(end), f"salt_{end}", F.col("line").alias(f"line_{end}")), [end, f"salt_{end}"])


def similar_pairs(pairs: DataFrame, lines: DataFrame, similar: float) -> DataFrame:
    """The pairs (a, b; distinct) of line ids whose shingle sets have a Jaccard similarity of `similar` or more."""
    texts = _with_text(_with_text(pairs, lines, "a", "b"), lines, "b", "a")
    units = texts.select("a", "b", *[F.encode(f"line_{e}", "UTF-16BE").alias(f"u{e}") for e in "ab"])
    all_of = lambda u: F.transform(F.sequence(F.lit(0), _last(u)), lambda i: _shingle(u, i))
    sets = units.select("a", "b", all_of(F.col("ua")).alias("sa"), all_of(F.col("ub")).alias("sb"))
    counts = sets.select("a", "b", F.size(F.array_union("sa", "sb")).alias("n"), F.size(F.array_intersect("sa", "sb")).alias("both"))
    # A filter would be pushed below the sets and make them again.
    counts = common.checkpointed(counts)
    return counts.where(F.col("both") >= similar * F.col("n")).select("a", "b")


def kept_lines(docs: DataFrame, similar: float = 0.8) -> DataFrame:
    """rid, pos of the lines of docs (rid, text) that are the first of their component."""
    distinct = lines_of(docs).groupBy("id").agg(F.min("line").alias("line"), F.min(F.struct("rid", "pos")).alias("place"))
    # From here on only the text of candidates is shuffled again.
    lines = common.bucketed(distinct, "id")
    # Both uses of `banded` read one shuffle, so they take the same columns.
    banded = keys_of(lines).repartition("key")
    shared = banded.groupBy("key").agg(F.count("id").alias("n")).where("n > 1")
    members = common.checkpointed(banded.join(shared.hint("shuffle_hash"), "key").select("key", "id", "n"))
    # How many lines a line meets under all its keys: the most central line of a key has most.
    met = members.groupBy("id").agg(F.sum("n").alias("met"))
    members = common.checkpointed(members.select("key", "id").join(met, "id"))
    # What is known of a key is checkpointed, so that Spark can split the keys with very many lines in the joins.
    central = common.checkpointed(members.groupBy("key").agg(F.max(F.struct("met", "id")).alias("central")))
    members = common.checkpointed(members.select("key", "id").join(central, "key"))
    # A line's star: the central line that it has most keys in common with, if these make it likely that they are alike.
    both = members.groupBy("id", F.col("central.id").alias("a")).agg(F.count(F.lit(1)).alias("keys")).where(f"a <> id and keys >= {STAR_KEYS}")
    stars = both.groupBy("id").agg(F.max(F.struct("keys", "a")).alias("star")).select("star.a", F.col("id").alias("b"))
    links = similar_pairs(stars, lines, similar)
    roots = common.checkpointed(components(links)).select(F.col("node").alias("id"), "root")
    # Keys whose lines are still in several components.
    members = members.select("key", "id", F.col("central.id").alias("central")).join(roots, "id", "left")
    members = members.select("key", "id", "central", F.coalesce("root", "id").alias("root"))
    mixed = members.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.max(F.when(F.col("id") == F.col("central"), F.col("root"))).alias("main"))
    mixed = common.checkpointed(mixed.where("low <> high").select("key", "main"))
    members = common.checkpointed(members.drop("central").join(mixed, "key"))
    bitmaps = bitmaps_of(lines.join(members.select("id").distinct().hint("shuffle_hash"), "id", "left_semi"))
    # All keys of a line, so that a pair is met under the first of its common keys alone. Bitmaps and keys are wide, so they
    # are kept once a line, not once a line and key, and join the members where they are needed.
    own = members.groupBy("id").agg(F.collect_list("key").alias("keys"))
    known = common.checkpointed(bitmaps.join(own, "id"))
    places = lines.select("id", "place").join(roots, "id", "left").withColumn("root", F.coalesce("root", "id"))
    for turn in range(TURNS + 1):
        found = _last_links(members, known, lines, similar) if turn == TURNS else _next_links(members, known, lines, similar, turn)
        # Components of the components so far.
        now = common.checkpointed(components(found)).select(F.col("node").alias("root"), F.col("root").alias("now"))
        places = places.join(now, "root", "left").withColumn("root", F.coalesce("now", "root")).drop("now")
        if turn < TURNS:
            for name in ("root", "main"):
                members = members.join(now.select(F.col("root").alias(name), "now"), name, "left").withColumn(name, F.coalesce("now", name)).drop("now")
            mixed = members.groupBy("key").agg(F.max(F.col("root") != F.col("main")).alias("mixed")).where("mixed").select("key")
            members = common.checkpointed(members.join(common.checkpointed(mixed), "key"))
    places = places.groupBy("root").agg(F.min("place").alias("place"))
    return places.select("place.rid", "place.pos")


def _next_links(members: DataFrame, known: DataFrame, lines: DataFrame, similar: float, turn: int) -> DataFrame:
    """Links (a, b) between roots: each line outside its key's main component is compared with one of the lines that stand
    for these components in this turn, one a key: with that under most of its keys."""
    one = F.struct(F.xxhash64(F.lit(turn), "id").alias("draw"), F.col("id").alias("b"))
    stands = common.checkpointed(members.where("root = main").groupBy("key").agg(F.max(one).alias("one")).select("key", "one.b"))
    # A pair meets under several keys but is compared once.
    near = members.where("root <> main").join(stands, "key").groupBy("id", "b", "root", "main").agg(F.count(F.lit(1)).alias("keys"))
    bits = known.select("id", "n", "bits")
    near = near.join(bits, "id").join(bits.toDF("b", "n_b", "bits_b"), "b").where(_possible(similar, "n", "bits", "n_b", "bits_b"))
    near = near.select("id", "b", "root", "main", "keys")
    best = near.groupBy("id").agg(F.max(F.struct("keys", "b", "root", "main")).alias("near")).select(F.col("near.b").alias("a"), F.col("id").alias("b"), "near.root", "near.main")
    best = common.checkpointed(best)
    found = similar_pairs(best.select("a", "b"), lines, similar)
    return best.join(found, ["a", "b"]).select(F.col("root").alias("a"), F.col("main").alias("b"))


def _last_links(members: DataFrame, known: DataFrame, lines: DataFrame, similar: float) -> DataFrame:
    """Links (a, b) between roots: each line outside its key's main component meets all lines of other components."""
    members = members.withColumn("apart", F.col("root") != F.col("main")).join(known, "id")
    one, other = (members.select("key", *[F.col(c).alias(f"{c}_{e}") for c in ("id", "root", "apart", "n", "bits", "keys")]) for e in "ab")
    more = one.where("apart_a").join(other, "key").where((F.col("root_a") != F.col("root_b")) & (~F.col("apart_b") | (F.col("id_a") < F.col("id_b"))) & _possible(similar, "n_a", "bits_a", "n_b", "bits_b"))
    # A key that is no longer here has one component left, so its pairs are joined.
    more = more.where(F.array_min(F.array_intersect("keys_a", "keys_b")) == F.col("key"))
    swap = F.col("id_a") > F.col("id_b")
    pick = lambda x, y, name: F.when(swap, F.col(y)).otherwise(F.col(x)).alias(name)
    more = more.select(pick("id_a", "id_b", "a"), pick("id_b", "id_a", "b"), pick("root_a", "root_b", "root_a"), pick("root_b", "root_a", "root_b"))
    more = common.checkpointed(more.distinct())
    found = similar_pairs(more.select("a", "b"), lines, similar)
    return more.join(found, ["a", "b"]).select(F.col("root_a").alias("a"), F.col("root_b").alias("b"))


def dedup(docs: DataFrame, similar: float = 0.8, name: str = "__kept") -> DataFrame:
    """docs with a column `name`, the numbers of their remaining lines that hold a word (null: none)."""
    rid = common.unused("rid", *docs.columns, name)
    rows = docs.withColumn(rid, F.monotonically_increasing_id())
    kept = kept_lines(rows.select(F.col(rid).alias("rid"), "text"), similar).groupBy("rid")
    kept = kept.agg(F.sort_array(F.collect_list("pos")).alias(name)).withColumnRenamed("rid", rid)
    return rows.join(kept, rid, "left").drop(rid)


def _is_line(x: Column) -> Column:
    return F.rlike(x, F.lit(f"[^{common.SPACE}]"))


def remaining(lines: Column, kept: Column) -> Column:
    """The text of those lines (an array) that hold no word or are among kept (their numbers)."""
    others = F.filter(F.transform(lines, lambda x, i: F.when(~_is_line(x), i)), lambda i: i.isNotNull())
    numbers = F.array_sort(F.concat(others, F.coalesce(kept, F.array().cast("array<int>"))))
    return F.array_join(F.transform(numbers, lambda i: F.get(lines, i)), "\n")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    n_lines = F.coalesce(F.size(F.filter(F.split("text", "\n"), _is_line)), F.lit(0))
    found = dedup(docs.withColumn("n_lines", F.greatest(n_lines, F.lit(0)).cast("long")))
    kept = F.coalesce("__kept", F.array().cast("array<int>"))
    return found.select("doc_id", "n_lines", (F.col("n_lines") - F.size(kept)).alias("n_removed"), kept.alias("kept_lines"))
