"""Quality rules by robust multivariate outliers (native).

Base figures of a text reject it outright if it has too few words or too many repeated ones. Five statistics of every
other text, transformed to be about normal among ordinary texts, are compared with those of its language and source:
minimum-covariance-determinant estimates of location and scatter, and the Mahalanobis distance from them.

The estimates, per group: from two starts (all rows; the medians) concentration steps keep the `HALF` of the rows that
are nearest by the present estimate and estimate anew; the start with the smaller determinant wins; a last step
reweights. The nearest rows are found by a histogram of distances that carries each bin's moments, so one pass over the
rows makes a step, pre-aggregated before the shuffle, however large a group is; statistics are whole numbers (ten
thousandths), so moments are exact and no step depends on partitioning. A floor is added to each variance, below which a
deviation means nothing. A group of under `LEAST` rows takes the estimate of its language, or of everything.

Defined results: a null text has no words and fails; a null language or source is a group of its own; repeated rows are
counted as often as they occur; an empty table gives no rows; extra columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.llm import common

#: Characters that count as symbols.
SYMBOLS = "#*$%&|<>"
#: Statistics, and for each the deviation (in its own unit) that its scatter is never taken to be below. Each
#: leaves room for rejection: lines reach ln(101), repeats ln(1.2) before the base rule, over sqrt(REJECT) floors each.
FLOORS = {"size": 0.5, "length": 0.06, "symbols": 0.6, "lines": 0.6, "repeats": 0.025}
STATS = tuple(FLOORS)
UNIT = 10_000
#: Share of a group's rows that an estimate rests on, and the factor that makes their covariance that of the whole
#: normal distribution (5 dimensions).
HALF, CONSISTENT = 0.75, 1.41
STEPS = 4
#: Chi-square with 5 degrees of freedom: at 0.975, for reweighting, and beyond 1 - 1e-6, for rejecting.
REWEIGHT, REJECT = 12.833, 38.0
#: Bins of squared distances to an octave.
BINS = 32
#: Rows that a group needs for an estimate of its own, by default (five statistics have 20 parameters); groups whose
#: estimates may be broadcast.
LEAST, BROADCAST_GROUPS = 200, 100_000
WORD_WINDOW = 5
PAIRS = [(i, j) for i in range(len(STATS)) for j in range(i + 1)]


def base(docs: DataFrame, *keep: str) -> DataFrame:
    """docs (doc_id, text and the columns to keep) with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed."""
    rows = docs.select("doc_id", *keep, F.coalesce("text", F.lit("")).alias("__t"))
    rows = rows.withColumn("__w", F.array_remove(F.split("__t", f"[{common.SPACE}]+"), ""))
    word_line = F.lit(f"[^{common.SPACE}]")
    rows = rows.withColumn("__l", F.filter(F.split("__t", "\n"), lambda x: F.rlike(x, word_line)))
    symbols = [F.octet_length("__t") - F.octet_length(F.replace("__t", F.lit(c), F.lit(""))) for c in SYMBOLS]
    hashes = F.transform("__w", lambda x: F.xxhash64(x))
    rows = rows.select(
        "doc_id",
        *keep,
        F.size("__w").cast("long").alias("n_words"),
        F.aggregate("__w", F.lit(0).cast("long"), lambda a, x: a + F.char_length(x)).alias("word_chars"),
        sum(symbols[1:], symbols[0]).cast("long").alias("n_symbols"),
        (F.size("__l") - F.size(F.array_distinct("__l"))).cast("long").alias("n_dup_lines"),
        hashes.alias("__h"),
    )
    # Windows of words under 64-bit hashes of their words' hashes.
    last = F.size("__h") - WORD_WINDOW
    windows = F.transform(F.sequence(F.lit(0), last), lambda i: F.xxhash64(*[F.get("__h", i + k) for k in range(WORD_WINDOW)]))
    rows = rows.withColumn("__g", F.when(last >= 0, windows).otherwise(F.array().cast("array<bigint>"))).drop("__h")
    repeated = F.size(F.array_distinct("__g")) < F.size("__g")
    rows = rows.withColumn("__s", F.when(repeated, F.array_sort(F.transform("__g", lambda h, i: F.struct(h.alias("h"), i.alias("i")))))).drop("__g")
    same = lambda x, k: F.coalesce(x["h"] == F.get("__s", k)["h"], F.lit(False))
    starts = F.filter("__s", lambda x, k: same(x, k + 1) | same(x, k - 1))
    rows = rows.withColumn("__p", F.sort_array(F.transform(starts, lambda x: x["i"]))).drop("__s")
    # Each start covers the words up to the next, five at most.
    covered = F.transform("__p", lambda p, k: F.least(F.lit(WORD_WINDOW), F.coalesce(F.get("__p", k + 1) - p, F.lit(WORD_WINDOW))))
    rows = rows.withColumn("n_repeat_words", F.coalesce(F.aggregate(covered, F.lit(0).cast("long"), lambda a, x: a + x), F.lit(0).cast("long"))).drop("__p")
    return rows.withColumn("base_failed", (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words")))


def statistics_sql() -> list[str]:
    """The transformed statistics of base figures, in ten thousandths; the text runs on both engines.

    size: log of words; length: log of characters a word, shrunk to 5.5 by 30 words; symbols, lines, repeats: symbols a
    thousand characters, repeated lines and repeated words a hundred words, all by log(1 + x).
    """
    figures = [
        "ln(greatest(n_words, 1))",
        "ln((word_chars + 165.0) / (n_words + 30.0))",
        "ln(1.0 + 1000.0 * n_symbols / greatest(word_chars, 1))",
        "ln(1.0 + 100.0 * n_dup_lines / greatest(n_words, 1))",
        "ln(1.0 + n_repeat_words * 1.0 / greatest(n_words, 1))",
    ]
    return [f"cast(round({x} * {UNIT}) as bigint) as z{i}" for i, x in enumerate(figures)]


def cholesky_sql(s: str) -> list[list[str]]:
    """Stages of columns: from covariances {s}ij, the lower factor l_ij, then its inverse w_ij and log determinant."""
    n = len(STATS)
    stages = []
    for j in range(n):
        gone = "".join(f" - l{j}{k} * l{j}{k}" for k in range(j))
        stages.append([f"sqrt({s}{j}{j}{gone}) as l{j}{j}"])
        if j + 1 < n:
            stages.append([f"({s}{i}{j}" + "".join(f" - l{i}{k} * l{j}{k}" for k in range(j)) + f") / l{j}{j} as l{i}{j}" for i in range(j + 1, n)])
    stages.append([f"1.0 / l{j}{j} as w{j}{j}" for j in range(n)] + [" + ".join(f"ln(l{j}{j})" for j in range(n)) + " as ln_det"])
    for gap in range(1, n):
        stages.append([f"-({' + '.join(f'l{j + gap}{k} * w{k}{j}' for k in range(j, j + gap))}) / l{j + gap}{j + gap} as w{j + gap}{j}" for j in range(n - gap)])
    return stages


def covariance_sql(factor: str) -> list[str]:
    """Means and floored covariances from n and sums of z and products."""
    out = [f"cast(s{i} as double) / n as m{i}" for i in range(len(STATS))]
    for i, j in PAIRS:
        floor = f" + {(FLOORS[STATS[i]] * UNIT) ** 2!r}" if i == j else ""
        out.append(f"(cast(p{i}{j} as double) / n - cast(s{i} as double) / n * (cast(s{j} as double) / n)) * {factor}{floor} as c{i}{j}")
    return out


def distance_sql(suffix: str = "") -> str:
    """Squared Mahalanobis distance, from z, means m and the inverse factor w."""
    terms = []
    for i in range(len(STATS)):
        y = " + ".join(f"w{i}{j}{suffix} * (z{j} - m{j}{suffix})" for j in range(i + 1))
        terms.append(f"({y}) * ({y})")
    return " + ".join(terms)


#: A distance's bin: BINS to an octave, from 2^-10 up.
BIN = "cast(floor(log2(greatest({d}, 0.0009765625)) * " + str(float(BINS)) + ") as int)"
MOMENTS = ["count(*) as n", *[f"sum(z{i}) as s{i}" for i in range(len(STATS))], *[f"sum(z{i} * z{j}) as p{i}{j}" for i, j in PAIRS]]
SUMS = ["n", *[f"s{i}" for i in range(len(STATS))], *[f"p{i}{j}" for i, j in PAIRS]]
#: A group: language and source, language alone, or all; level 2, 1, 0.
KEYS = ["level", "lang_key", "source_key"]


def _moments(rows: DataFrame, *by: str) -> DataFrame:
    exact = [F.expr(x.replace("sum(z", "sum(cast(z").replace(") as", " as decimal(38,0))) as") if x.startswith("sum") else x) for x in MOMENTS]
    return rows.groupBy(*by).agg(*exact)


def _estimate(moments: DataFrame, factor: str, *by: str) -> DataFrame:
    found = moments.selectExpr(*by, "n", *covariance_sql(factor))
    for stage in cholesky_sql("c"):
        found = found.selectExpr("*", *stage)
    return found.select(*by, "ln_det", *[f"m{i}" for i in range(len(STATS))], *[f"w{i}{j}" for i, j in PAIRS])


def _near(rows: DataFrame, estimates: DataFrame, small: bool, *by: str) -> DataFrame:
    """rows with the estimates of their group; broadcast if their number is within the bound."""
    return rows.join(F.broadcast(estimates) if small else estimates, list(by))


def _concentrate(rows: DataFrame, estimates: DataFrame, sizes: DataFrame, small: bool) -> DataFrame:
    """Moments of each group's nearest HALF, by start."""
    by = [*KEYS, "start"]
    binned = _near(rows, estimates, small, *by).withColumn("bin", F.expr(BIN.format(d=distance_sql())))
    bins = _moments(binned, *by, "bin")
    before = Window.partitionBy(*by).orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    bins = bins.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0)))
    bins = bins.join(F.broadcast(sizes) if small else sizes, KEYS).where(F.col("before") < F.col("size") * HALF)
    return bins.groupBy(*by).agg(*[F.sum(c).alias(c) for c in SUMS])


def _medians(rows: DataFrame) -> DataFrame:
    """Each group's medians m0.. and a diagonal inverse factor from the floors, as a start: median by exact histograms."""
    values = F.explode(F.array(*[F.struct(F.lit(i).alias("j"), F.col(f"z{i}").alias("z")) for i in range(len(STATS))]))
    hundredths = rows.select(*KEYS, values.alias("v")).select(*KEYS, "v.j", F.expr(f"cast(floor(v.z / {UNIT / 100!r}) as int)").alias("bin"))
    bins = hundredths.groupBy(*KEYS, "j", "bin").agg(F.count(F.lit(1)).alias("n"))
    own = Window.partitionBy(*KEYS, "j")
    upto = own.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    bins = bins.select(*KEYS, "j", "bin", F.sum("n").over(upto).alias("upto"), F.sum("n").over(own).alias("total"))
    middle = bins.where(F.col("upto") * 2 >= F.col("total")).groupBy(*KEYS, "j").agg(F.min("bin").alias("bin"))
    centre = [F.max(F.when(F.col("j") == i, F.col("bin") * (UNIT / 100))).alias(f"m{i}") for i in range(len(STATS))]
    scale = [F.lit(1 / (FLOORS[STATS[i]] * UNIT) if i == j else 0.0).alias(f"w{i}{j}") for i, j in PAIRS]
    return middle.groupBy(*KEYS).agg(*centre).select(*KEYS, F.lit(1).alias("start"), F.lit(0.0).alias("ln_det"), *[f"m{i}" for i in range(len(STATS))], *scale)


def verdicts(figures: DataFrame, least: int = LEAST) -> DataFrame:
    """figures (doc_id, lang, source and base figures) with kept and distance (null where base_failed).

    A language and source with under `least` passing rows takes its language's estimate, a language with fewer all rows'.
    """
    key = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit(""))
    figures = common.checkpointed(figures.withColumn("__lang", key("lang")).withColumn("__source", key("source")))
    passed = figures.where(~F.col("base_failed")).selectExpr("__lang", "__source", *statistics_sql())
    groups = F.expr("explode(array(struct(2 as level, __lang as lang_key, __source as source_key), struct(1 as level, __lang as lang_key, '' as source_key), struct(0 as level, '' as lang_key, '' as source_key)))")
    z = [f"z{i}" for i in range(len(STATS))]
    rows = passed.select(groups.alias("g"), *z).select("g.*", *z)
    sizes = rows.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("size")).where((F.col("size") >= least) | (F.col("level") == 0))
    sizes = common.checkpointed(sizes)
    small = sizes.count() <= BROADCAST_GROUPS
    rows = rows.join(F.broadcast(sizes.select(*KEYS)) if small else sizes.select(*KEYS), KEYS)
    rows = common.checkpointed(rows)
    whole = _estimate(_moments(rows, *KEYS), "1.0", *KEYS).withColumn("start", F.lit(0))
    estimates = common.checkpointed(whole.unionByName(_medians(rows)))
    starts = rows.withColumn("start", F.explode(F.array(F.lit(0), F.lit(1))))
    for _ in range(STEPS):
        moments = _concentrate(starts, estimates, sizes, small)
        estimates = common.checkpointed(_estimate(moments, repr(CONSISTENT), *KEYS, "start"))
    best = Window.partitionBy(*KEYS).orderBy("ln_det", "start")
    estimates = estimates.withColumn("n", F.row_number().over(best)).where("n = 1").drop("n", "start", "ln_det")
    within = _near(rows, estimates, small, *KEYS).where(F.expr(distance_sql()) <= REWEIGHT)
    final = common.checkpointed(_estimate(_moments(within, *KEYS), "1.0", *KEYS).drop("ln_det"))
    # A row takes the estimate of the narrowest group that has one.
    own = F.broadcast(final) if small else final
    out = figures.selectExpr("*", *statistics_sql())
    for level, on in ((2, ["__lang", "__source"]), (1, ["__lang"]), (0, [])):
        names = dict(zip(["__lang", "__source"], ["lang_key", "source_key"], strict=True))
        est = own.where(F.col("level") == level).select(*[F.col(names[c]).alias(c) for c in on], *[F.col(c).alias(f"{c}_{level}") for c in final.columns if c not in KEYS])
        out = out.join(est, on, "left") if on else out.join(est, how="left")
    distance = F.when(~F.col("base_failed"), F.coalesce(*[F.expr(distance_sql(f"_{level}")) for level in (2, 1, 0)]))
    out = out.withColumn("distance", distance)
    kept = ~F.col("base_failed") & (F.coalesce(F.col("distance"), F.lit(0.0)) <= REJECT)
    return out.withColumn("kept", kept).select(*[c for c in figures.columns if not c.startswith("__")], "distance", "kept")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    found = verdicts(base(docs, "lang", "source"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def oracle() -> str:
    """The same rules in DuckDB SQL, step by step."""
    keys, by = ", ".join(KEYS), ", ".join([*KEYS, "start"])
    sums = ", ".join(f"sum({c}) as {c}" for c in SUMS)
    space = common.SPACE
    params = ", ".join([f"m{i}" for i in range(len(STATS))] + [f"w{i}{j}" for i, j in PAIRS])
    ctes: list[str] = []

    def add(name: str, body: str) -> str:
        ctes.append(f"{name} as ({body})")
        return name

    def estimate(name: str, source: str, factor: str, by: str) -> str:
        at = add(f"{name}_c", f"select {by}, n, {', '.join(covariance_sql(factor))} from {source}")
        for k, stage in enumerate(cholesky_sql("c")):
            at = add(f"{name}_{k}", f"select *, {', '.join(stage)} from {at}")
        return add(name, f"select {by}, ln_det, {params} from {at}")

    add("d", "select row_number() over () as rid, doc_id, lang, source, coalesce(text, '') as t from documents")
    add("w", f"select rid, list_filter(string_split_regex(t, '[{space}]+'), lambda x: x <> '') as w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^{space}]')) as l from d")
    add("g", f"select rid, i, array_to_string(w[i:i + {WORD_WINDOW - 1}], ' ') as g from w, unnest(range(1, len(w) - {WORD_WINDOW - 2})) as u(i)")
    add("r", "select rid, i from g qualify count(*) over (partition by rid, g) > 1")
    add("rw", f"select rid, count(distinct i + k) as n from r, range(0, {WORD_WINDOW}) as x(k) group by rid")
    add(
        "figures",
        "select d.rid, d.doc_id, '=' || lang as lk, '=' || source as sk, len(w)::bigint as n_words, "
        "coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::bigint as word_chars, "
        f"(length(t) - length(translate(t, '{SYMBOLS}', '')))::bigint as n_symbols, (len(l) - len(list_distinct(l)))::bigint as n_dup_lines, "
        "coalesce(rw.n, 0)::bigint as n_repeat_words from d join w using (rid) left join rw using (rid)",
    )
    add("flagged", f"select *, (n_words < 10 or 100 * n_repeat_words > 20 * n_words) as base_failed, coalesce(lk, '') as lang_k, coalesce(sk, '') as source_k, {', '.join(statistics_sql())} from figures")
    add(
        "every",
        "select 2 as level, lang_k as lang_key, source_k as source_key, * from flagged where not base_failed union all "
        "select 1, lang_k, '', * from flagged where not base_failed union all select 0, '', '', * from flagged where not base_failed",
    )
    add("sizes", f"select {keys}, count(*) as size from every group by {keys} having count(*) >= {LEAST} or level = 0")
    add("rows_", f"select every.* from every join sizes using ({keys})")
    moments = ", ".join(MOMENTS)
    add("all_m", f"select {keys}, {moments} from rows_ group by {keys}")
    estimate("whole", "all_m", "1.0", keys)
    add("long_", " union all ".join(f"select {keys}, {i} as j, cast(floor(z{i} / {UNIT / 100!r}) as int) as bin from rows_" for i in range(len(STATS))))
    add("long_n", f"select {keys}, j, bin, count(*) as n from long_ group by all")
    add("long_c", f"select *, sum(n) over (partition by {keys}, j order by bin) as upto, sum(n) over (partition by {keys}, j) as total from long_n")
    add("mid", f"select {keys}, j, min(bin) as bin from long_c where upto * 2 >= total group by all")
    centre = ", ".join(f"max(case when j = {i} then bin * {UNIT / 100!r} end)::double as m{i}" for i in range(len(STATS)))
    scale = ", ".join(f"{1 / (FLOORS[STATS[i]] * UNIT) if i == j else 0.0!r}::double as w{i}{j}" for i, j in PAIRS)
    add("med", f"select {keys}, {centre} from mid group by {keys}")
    at = add("est0", f"select {keys}, 0 as start, ln_det, {params} from whole union all select {keys}, 1, 0.0, {', '.join(f'm{i}' for i in range(len(STATS)))}, {scale} from med")
    for k in range(1, STEPS + 1):
        add(f"bin{k}", f"select {by}, {BIN.format(d=distance_sql())} as bin, {moments} from rows_ join {at} using ({keys}) group by {by}, bin")
        add(f"cum{k}", f"select *, coalesce(sum(n) over (partition by {by} order by bin rows between unbounded preceding and 1 preceding), 0) as before from bin{k}")
        add(f"half{k}", f"select {by}, {sums} from cum{k} join sizes using ({keys}) where before < size * {HALF} group by {by}")
        at = estimate(f"est{k}", f"half{k}", repr(CONSISTENT), by)
    add("best", f"select {keys}, {params} from {at} qualify row_number() over (partition by {keys} order by ln_det, start) = 1")
    add("within_", f"select {keys}, {moments} from rows_ join best using ({keys}) where {distance_sql()} <= {REWEIGHT} group by {keys}")
    estimate("final", "within_", "1.0", keys)
    names = [f"m{i}" for i in range(len(STATS))] + [f"w{i}{j}" for i, j in PAIRS]
    for level in (2, 1, 0):
        add(f"f{level}", f"select lang_key, source_key, {', '.join(f'{c} as {c}_{level}' for c in names)} from final where level = {level}")
    distance = ", ".join(distance_sql(f"_{level}") for level in (2, 1, 0))
    return f"""with {', '.join(ctes)}
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  not base_failed and coalesce(coalesce({distance}), 0.0) <= {REJECT} as kept
from flagged left join f2 on f2.lang_key = lang_k and f2.source_key = source_k left join f1 on f1.lang_key = lang_k left join f0 on true"""
