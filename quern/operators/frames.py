"""Operators on DataFrames that PySpark lacks or defines otherwise. Each takes frames and gives frames."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.errors import AnalysisException, UnsupportedFeatureError

#: Rows of an Arrow batch.
BATCH_ROWS = 131_072
_JOIN_KINDS = {
    "inner": "inner",
    "cross": "cross",
    "left": "left",
    "leftouter": "left",
    "right": "right",
    "rightouter": "right",
    "outer": "full",
    "full": "full",
    "fullouter": "full",
    "semi": "left_semi",
    "leftsemi": "left_semi",
    "anti": "left_anti",
    "leftanti": "left_anti",
}


def join(left: DataFrame, right: DataFrame, on=None, how: str = "inner") -> DataFrame:
    """A join whose columns have different names: a name that both sides keep gets `_1` on the right.

    on: names (kept once), a condition over the two frames, or nothing (inner and cross only: a cartesian product).
    """
    kind = _JOIN_KINDS.get(how.lower().replace("_", ""))
    if kind is None:
        raise AnalysisException(f"unknown join {how}; joins: {', '.join(_JOIN_KINDS)}")
    if on is None:
        if kind not in ("inner", "cross"):
            raise AnalysisException(f"a {how} join needs a condition")
        joined = left.crossJoin(right)
    else:
        joined = left.join(right, on, "inner" if kind == "cross" else kind)
    return distinct_names(joined)


def distinct_names(frame: DataFrame) -> DataFrame:
    """frame with repeated column names numbered: id, id_1, id_2."""
    seen: set[str] = set()
    names = []
    for c in frame.columns:
        name, k = c, 0
        while name.lower() in seen:
            k += 1
            name = f"{c}_{k}"
        seen.add(name.lower())
        names.append(name)
    return frame if names == frame.columns else frame.toDF(*names)


def agg(grouped, *exprs, **named: Column) -> DataFrame:
    """Aggregates of a grouped frame (or a whole one): columns, {column: function}, and keywords as names."""
    if len(exprs) == 1 and isinstance(exprs[0], dict):
        if named:
            return grouped.agg(*[F.expr(f"{f}({c})").alias(f"{f}({c})") for c, f in exprs[0].items()], *[v.alias(k) for k, v in named.items()])
        return grouped.agg(exprs[0])
    flat = [c for e in exprs for c in (e if isinstance(e, list | tuple) else [e])]
    return grouped.agg(*flat, *[v.alias(k) for k, v in named.items()])


def select_one_generator(frame: DataFrame, *cols) -> DataFrame:
    """select, refusing two row generators in one list, which would multiply their rows."""
    texts = [str(c).lower() for c in cols if isinstance(c, Column)]
    if sum("explode" in t or "inline" in t for t in texts) > 1:
        raise UnsupportedFeatureError("two generators in one select", "two selects")
    return frame.select(*cols)


def cache(frame: DataFrame) -> DataFrame:
    """Cached at once, not at first use."""
    kept = frame.cache()
    kept.count()
    return kept


def arrow_batches(frame: DataFrame, batchSize: int = BATCH_ROWS) -> Iterator[pa.RecordBatch]:
    """A finite result as Arrow batches of at most batchSize rows, a partition at a time on the driver.

    Partitions are turned into Arrow on the executors; the driver never holds more than one of them.
    """
    from quern.streaming.batches import batches

    return batches(frame, batchSize)


def freq_items(frame: DataFrame, cols: list[str], support: float = 0.01) -> DataFrame:
    """One row: for each column the values that at least support x rows have, exactly."""
    if not 1e-4 <= support <= 1:
        raise AnalysisException("support is from 0.0001 to 1")
    least = frame.agg(F.count(F.lit(1)).alias("n")).withColumn("least", F.col("n") * F.lit(support))
    out = None
    for c in cols:
        counts = frame.groupBy(F.col(c).alias("v")).agg(F.count(F.lit(1)).alias("c")).crossJoin(F.broadcast(least))
        # At most 1 / support values.
        one = counts.where(F.col("c") >= F.col("least")).agg(F.sort_array(F.collect_list("v")).alias(f"{c}_freqItems"))
        out = one if out is None else out.crossJoin(one)
    return out


def crosstab(frame: DataFrame, col1: str, col2: str) -> DataFrame:
    """Counts of pairs: a row for each col1 value (first column `col1_col2`), a column for each col2 value, 0 where absent."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("null"))
    pairs = frame.select(text(col1).alias(f"{col1}_{col2}"), text(col2).alias("__v"))
    return pairs.groupBy(f"{col1}_{col2}").pivot("__v").agg(F.count(F.lit(1))).na.fill(0)


def quantiles(frame: DataFrame, col, probabilities, relativeError: float = 0.0):
    """approxQuantile; an error of 0 is exact and discrete. A list of columns gives a list of lists."""
    if relativeError < 0 or any(not 0 <= p <= 1 for p in probabilities):
        raise AnalysisException("probabilities are from 0 to 1, the error is not negative")
    return frame.approxQuantile(col, list(probabilities), relativeError)


def count(session, name: str) -> int:
    """The rows of a managed table, from its manifests: no data file is read."""
    return session.store.load(session.resolve(name)).count()
