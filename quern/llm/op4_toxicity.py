"""Toxicity by class-conditional Kneser-Ney models.

Words are spelt byte by byte with an end byte, each byte after the `order` - 1 before it in its word. Two interpolated
Kneser-Ney models, of toxic and of ordinary documents, have counts of their own at the full context and share all
shorter ones: those are continuation counts over both classes, so an expression that either class hardly saw backs off
to the same probabilities in both and says little; the discount is near 1, so what a class has once counts next to nothing of its
own. A word's evidence is the difference of its log-likelihoods. A text is compared by three figures: the length-normalised
difference of all its words, evidence a byte of either sign; the same of what words have above `floor` nats, so that
ordinary words can't drown a few expressions; and the mean evidence of its two strongest words. A logistic curve through labelled documents that the
models did not count turns them into a score from 0 to 1.

The models are fitted on a bounded sample: at most `sample` labelled documents of each class, chosen by a hash of their
id, exact copies counted once; a fifth of them fit the curve. The tables are broadcast: at most 2 x `sample` documents'
distinct strings, all of them. Everything is scored, whole and without a shuffle.

Defined results: a null or empty text has no evidence and gets the curve's value there; several labels of one document
count as the largest; labels that are null are not labels; without labels of both classes every score is 0; repeated
rows give repeated results; an empty table gives no rows; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm import common

END = 0x20
#: Words whose evidence a worker remembers, twice as many at most.
CACHED_WORDS = 500_000


def spell(words: list[bytes], order: int) -> tuple[np.ndarray, np.ndarray]:
    """(strings of `order` bytes that end at each byte of each word and at its end, bytes of each word with its end).

    A string is one number, its last byte lowest; before a word there are zero bytes.
    """
    lengths = np.array([len(w) + 1 for w in words], np.int64)
    data = np.frombuffer(b" ".join(words) + b" ", np.uint8).astype(np.uint64) if words else np.zeros(0, np.uint64)
    place = np.arange(len(data)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    out = data.copy()
    for back in range(1, order):
        inside = place >= back
        out[inside] |= data[np.flatnonzero(inside) - back] << np.uint64(8 * back)
    return out, lengths


def _sums(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    starts = np.flatnonzero(np.diff(keys, prepend=~keys[:1]))
    return keys[starts], np.add.reduceat(counts[order], starts) if len(starts) else counts


def _narrow(counts: np.ndarray) -> np.ndarray:
    """counts in the narrowest unsigned type that holds them."""
    return counts.astype(np.min_scalar_type(int(counts.max(initial=0))))


class _Level:
    """One order's counts: of strings, and of contexts their total and number of distinct next bytes."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray, discount: float | None = None) -> None:
        self.keys, self.counts = keys, _narrow(counts)
        once, twice = (counts == 1).sum(), (counts == 2).sum()
        self.discount = discount or (float(once / (once + 2 * twice)) if once else 0.5)
        contexts = keys >> np.uint64(8)
        # The keys are sorted and counted, so a context's are side by side and each is a type.
        starts = np.flatnonzero(np.diff(contexts, prepend=~contexts[:1]))
        self.contexts, self.types = contexts[starts], _narrow(np.diff(np.append(starts, len(keys))))
        self.totals = _narrow(np.add.reduceat(counts, starts)) if len(starts) else counts

    def smooth(self, strings: np.ndarray, lower: np.ndarray) -> np.ndarray:
        """Interpolated probabilities of the strings' last bytes, given those of the next shorter context."""
        if not len(self.keys):
            return lower
        count = self._look(self.keys, self.counts, strings)
        contexts = strings >> np.uint64(8)
        total, types = (self._look(self.contexts, x, contexts) for x in (self.totals, self.types))
        found = (np.maximum(count - self.discount, 0) + self.discount * types * lower) / np.maximum(total, 1e-300)
        return np.where(total > 0, found, lower)

    @staticmethod
    def _look(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
        return np.where(keys[at] == wanted, values[at], 0.0)


class Models:
    """The two models. counts: strings of `order` bytes, and how often either class has each."""

    def __init__(self, strings: np.ndarray, toxic: np.ndarray, ordinary: np.ndarray, order: int, discount: float) -> None:
        self.order = order
        self.own = [_Level(strings[c > 0], c[c > 0], discount) for c in (toxic, ordinary)]
        self.shared = []
        keys, counts = strings, toxic + ordinary
        for length in range(order - 1, 0, -1):
            first = keys >> np.uint64(8 * length)
            short = keys & np.uint64((1 << (8 * length)) - 1)
            # What stands before a byte counts once; at a word's start nothing does, and occurrences count.
            keys, counts = _sums(short, np.where(first > 0, 1, counts))
            self.shared.append(_Level(keys, counts))

    def evidence(self, strings: np.ndarray) -> np.ndarray:
        """ln of P(toxic model) / P(ordinary model) for the last byte of each string."""
        distinct, at = np.unique(strings, return_inverse=True)
        lower = np.full(len(distinct), 1 / 256)
        for length, level in zip(range(1, self.order), reversed(self.shared), strict=True):
            lower = level.smooth(distinct & np.uint64((1 << (8 * length)) - 1), lower)
        toxic, ordinary = (level.smooth(distinct, lower) for level in self.own)
        return (np.log(toxic) - np.log(ordinary))[at]


class Scorer:
    """Evidence of words, remembered, and of texts."""

    def __init__(self, models: Models, floor: float) -> None:
        self.models, self.floor = models, floor
        self.young: dict[bytes, float] = {}
        self.old: dict[bytes, float] = {}

    def _words(self, texts: list[list[bytes]]) -> dict[bytes, float]:
        known: dict[bytes, float] = {}
        new: list[bytes] = []
        for word in dict.fromkeys(w for words in texts for w in words):
            got = self.young.get(word)
            if got is None:
                got = self.old.get(word)
            if got is None:
                new.append(word)
            else:
                known[word] = self.young[word] = got
        if new:
            strings, lengths = spell(new, self.models.order)
            found = np.add.reduceat(self.models.evidence(strings), np.cumsum(lengths) - lengths)
            known.update(fresh := dict(zip(new, found.tolist(), strict=True)))
            self.young.update(x for x in fresh.items() if len(x[0]) <= 64)
        if len(self.young) > CACHED_WORDS:
            self.old, self.young = self.young, {}
        return known

    def texts(self, texts: list[str | None]) -> np.ndarray:
        """(n, 3): evidence a byte, evidence a byte above the floor, and the mean evidence of the two strongest distinct words."""
        split = [(t or "").encode().lower().split() for t in texts]
        known = self._words(split)
        out = np.zeros((len(split), 3))
        for row, words in enumerate(split):
            if words:
                found = np.array([known[w] for w in words])
                size = sum(map(len, words)) + len(words)
                out[row, 0] = found.sum() / size
                out[row, 1] = np.maximum(found - self.floor, 0).sum() / size
                out[row, 2] = np.mean(sorted([known[w] for w in set(words)])[-2:])
        return out


def curve(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Weights (constant first) of a logistic regression with a slight ridge, by Newton's method on scaled inputs."""
    middle, scale = x.mean(0), x.std(0) + 1e-9
    z = np.column_stack([np.ones(len(x)), (x - middle) / scale])
    w = np.zeros(z.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -40, 40)))
        ridge = np.diag([1e-6, *[1e-2] * x.shape[1]])
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + ridge, z.T @ (y - p) - ridge @ w)
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    return np.array([w[0] - (w[1:] * middle / scale).sum(), *(w[1:] / scale)])


def _strings(order: int):
    """From rows (toxic, text): (string, toxic, ordinary), the occurrences of each distinct string in a partition."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.batches(rows):
            marks, texts = batch.column("toxic").to_pylist(), batch.column("text").to_pylist()
            found = []
            for mark in (1, 0):
                words = [w for t, m in zip(texts, marks, strict=True) if m == mark for w in (t or "").encode().lower().split()]
                found.append(np.unique(spell(words, order)[0], return_counts=True))
            for mark, (keys, counts) in zip((1, 0), found, strict=True):
                yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(counts * mark), pa.array(counts * (1 - mark))], names=["string", "toxic", "ordinary"])

    return run


def score(
    docs: DataFrame,
    labels: DataFrame,
    sample: int = 20_000,
    order: int = 8,
    discount: float = 0.97,
    floor: float = 3.0,
    folds: int = 4,
    held_out: int = 2,
    threshold: float = 0.3,
) -> DataFrame:
    """doc_id, held_out, score, predicted of each row of docs (doc_id, text).

    labels: doc_id, toxic (0 or 1). Labels of documents whose fold is held_out are never read.
    """
    spark = docs.sparkSession
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & (common.fold(F.col("doc_id"), folds) != held_out))
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).withColumn("draw", F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40)))
    sizes = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    chosen = None
    for mark in (0, 1):
        # The hash alone keeps about 1.1 x sample rows; the limit makes the bound exact.
        share = min(1 << 40, int((1 << 40) * 1.1 * sample / max(1, sizes.get(mark, 0))))
        part = known.where((F.col("toxic") == mark) & (F.col("draw") < share)).orderBy("draw", "doc_id").limit(sample)
        chosen = part if chosen is None else chosen.union(part)
    fitted = common.checkpointed(chosen)
    texts = docs.select("doc_id", "text").where(F.col("text").isNotNull()).join(F.broadcast(fitted), "doc_id")
    texts = common.checkpointed(texts.groupBy(F.xxhash64("text"), "text").agg(F.max("toxic").alias("toxic"), F.min("draw").alias("draw")))
    drawn = F.pmod(F.col("draw"), F.lit(5))
    counted = texts.where(drawn != 0).select("toxic", "text").mapInArrow(_strings(order), "string long, toxic long, ordinary long")
    counted = common.checkpointed(counted.groupBy("string").agg(F.sum("toxic").alias("toxic"), F.sum("ordinary").alias("ordinary")))
    rows = counted.toArrow()
    strings = rows.column("string").to_numpy().view(np.uint64)
    order_of = np.argsort(strings)
    toxic, ordinary = (rows.column(c).to_numpy()[order_of].astype(np.int64) for c in ("toxic", "ordinary"))
    usable = bool(toxic.sum() and ordinary.sum())
    models = spark.sparkContext.broadcast(Models(strings[order_of], toxic, ordinary, order, discount) if usable else None)
    del rows, strings, toxic, ordinary
    scorers: list[Scorer] = []

    def scorer() -> Scorer:
        if not scorers:
            scorers.append(Scorer(models.value, floor))
        return scorers[0]

    def features(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.batches(rows):
            found = scorer().texts(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column("toxic"), *[pa.array(found[:, i]) for i in range(3)]], names=["toxic", "whole", "above", "strongest"])

    weights = None
    if usable:
        seen = texts.where(drawn == 0).select(F.col("toxic").cast("int").alias("toxic"), "text").mapInArrow(features, "toxic int, whole double, above double, strongest double").toPandas()
        if seen["toxic"].nunique() == 2:
            weights = curve(seen[["whole", "above", "strongest"]].to_numpy(), seen["toxic"].to_numpy())

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.batches(rows):
            found = np.zeros(batch.num_rows)
            if weights is not None:
                x = scorer().texts(batch.column("text").to_pylist())
                found = 1 / (1 + np.exp(-np.clip(weights[0] + x @ weights[1:], -40, 40)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(found), pa.array((found >= threshold).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    rows = docs.select("doc_id", (common.fold(F.col("doc_id"), folds) == held_out).alias("held_out"), "text")
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels"))
