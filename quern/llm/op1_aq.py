"""Approximate nearest neighbours by additive quantisation.

A vector is approximated by a sum of full-dimensional codewords, one from each of `codebooks` codebooks. They are
fitted on a bounded sample: k-means on what the earlier codebooks leave, then rounds of encoding the sample and solving
all codebooks at once by least squares. Encoding keeps a beam of the best partial sums. Beside its codes each vector
stores the squared norm of its approximation, so that |q - x|^2 = |q|^2 - 2 sum_m q.c_m + |x|^2 needs one look-up a
codebook in a query's table of inner products. Every vector is encoded and scored for every query, block by block; a
query's `shortlist` best of a block are measured exactly on the original vectors, in double precision. Beside the norm a
vector stores its distance from its approximation, so that the score bounds its own distance from below; all whose bound
isn't over the k-th distance found are measured too. So the result is exact whatever the codebooks fit: they decide the
cost alone, which is all distances where vectors differ by less than the quantisation leaves.

Equal vectors are indexed once with their `k` + 1 smallest ids, all that can appear among k results, so a large group
of copies neither fills a shortlist nor lands in one task.

Defined results: vectors that are null, of norm zero, or hold null or non-finite numbers take no part; if fewer than k
other vectors exist, all are returned; ties go to the smaller id; of rows with one id and different vectors, each is a
row of its own; a table without any vector gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.llm import common

#: Queries that one block holds, and bytes of the original vectors in a block of codes.
QUERY_BLOCK, CODE_BLOCK_BYTES = 512, 1 << 20
#: Rounding that one operation may add, with room to spare.
EPS = 4 * np.finfo(float).eps


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    score = x @ centres.T * -2 + (centres**2).sum(1)
    return score.argmin(1)


def fit(sample: np.ndarray, codebooks: int, words: int, beam: int, rounds: int, seed: int = 7) -> np.ndarray:
    """Codebooks (codebooks, words, dimension) from a sample (n, dimension)."""
    rng = np.random.default_rng(seed)
    n, dim = sample.shape
    words = max(1, min(words, n))
    books = np.zeros((codebooks, words, dim))
    rest = sample.copy()
    for m in range(codebooks):
        centres = rest[rng.choice(n, words, replace=False)]
        for _ in range(8):
            own = _nearest(rest, centres)
            count = np.bincount(own, minlength=words)
            total = np.zeros_like(centres)
            np.add.at(total, own, rest)
            centres = np.where(count[:, None] > 0, total / np.maximum(count, 1)[:, None], rest[rng.integers(0, n, words)])
        books[m] = centres
        rest = rest - centres[_nearest(rest, centres)]
    for _ in range(rounds):
        codes = encode(sample, books, beam)[0] + np.arange(codebooks) * words
        gram, right = np.zeros((codebooks * words,) * 2), np.zeros((codebooks * words, dim))
        for a in range(codebooks):
            np.add.at(right, codes[:, a], sample)
            for b in range(codebooks):
                np.add.at(gram, (codes[:, a], codes[:, b]), 1)
        # The ridge keeps unused codewords where they are.
        old = books.reshape(-1, dim)
        books = np.linalg.solve(gram + 0.1 * np.eye(len(gram)), right + 0.1 * old).reshape(books.shape)
    return books


def encode(x: np.ndarray, books: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """Codes (n, codebooks) and squared norms of the approximations, by beam search over the codebooks in turn."""
    count, words, dim = books.shape
    flat = books.reshape(-1, dim)
    cross, norms = flat @ flat.T, (flat**2).sum(1)
    all_codes, all_norms = [], []
    for at in range(0, len(x), 1024):
        part = x[at : at + 1024]
        inner = part @ flat.T
        rows = np.arange(len(part))[:, None]
        codes = np.zeros((len(part), 1, 0), np.int64)
        score = np.zeros((len(part), 1))  # |approximation|^2 - 2 x.approximation
        for m in range(count):
            own = slice(m * words, (m + 1) * words)
            step = norms[own] - 2 * inner[:, None, own] + score[:, :, None]
            for j in range(m):
                step = step + 2 * cross[codes[:, :, j], own]
            step = step.reshape(len(part), -1)
            keep = min(beam if m < count - 1 else 1, step.shape[1])
            best = np.argpartition(step, keep - 1, axis=1)[:, :keep]
            codes = np.concatenate([codes[rows, best // words], (best % words + m * words)[:, :, None]], axis=2)
            score = step[rows, best]
        all_codes.append(codes[:, 0] - np.arange(count) * words)
        all_norms.append(score[:, 0] + 2 * np.take_along_axis(inner, codes[:, 0], 1).sum(1))
    if not all_codes:
        return np.zeros((0, count), np.int64), np.zeros(0)
    return np.concatenate(all_codes), np.concatenate(all_norms)


def decode(codes: np.ndarray, books: np.ndarray) -> np.ndarray:
    """The approximations that codes stand for."""
    out = np.zeros((len(codes), books.shape[2]))
    for m, book in enumerate(books):
        out += book[codes[:, m]]
    return out


def distances(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Distances of rows from q; squares are added in the order of the components, so equal sums stay equal."""
    return np.sqrt(np.cumsum((x - q) ** 2, axis=1)[:, -1])


def _reaching(d: np.ndarray, counts: np.ndarray, k: int) -> float:
    """The distance within which there are k candidates; infinite if there are fewer."""
    order = np.argsort(d)
    at = np.searchsorted(np.cumsum(counts[order]), k)
    return d[order[at]] if at < len(d) else np.inf


def search(
    vectors: DataFrame,
    queries: DataFrame,
    k: int = 10,
    codebooks: int = 16,
    words: int = 128,
    beam: int = 4,
    rounds: int = 2,
    shortlist: int = 256,
    sample: int = 16_384,
) -> DataFrame:
    """query_id, rank, vec_id, score (distance) of the k nearest found; vectors and queries have vec_id and embedding.

    `sample` bounds the vectors that the codebooks are fitted on, chosen by a hash of their content; every vector is
    indexed. A candidate with the query's own id is not returned. Repeated rows, of one id and one vector, count once; an id with
    several vectors is a candidate with each, and asked with each its results are those of all its vectors together.
    """
    spark = vectors.sparkSession

    def valid(df: DataFrame) -> DataFrame:
        x = F.col("embedding").cast("array<double>")
        fine = F.forall(x, lambda v: F.coalesce(~F.isnan(v) & (F.abs(v) < float("inf")), F.lit(False)))
        fine = fine & F.exists(x, lambda v: v != 0) & F.col("vec_id").isNotNull()
        return df.select("vec_id", F.transform(x, lambda v: v + F.lit(0.0)).alias("x")).where(F.coalesce(fine, F.lit(False)))

    near = Window.partitionBy("key", "salt").orderBy("vec_id")
    rows = valid(vectors).withColumn("key", F.xxhash64("x")).withColumn("salt", F.pmod(F.xxhash64("vec_id"), F.lit(16)))
    rows = rows.withColumn("n", F.dense_rank().over(near)).where(F.col("n") <= k + 1)
    unique = rows.groupBy("key", "x").agg(F.slice(F.array_sort(F.collect_set("vec_id")), 1, k + 1).alias("ids"))
    unique = common.checkpointed(unique.select("x", "ids", F.pmod("key", F.lit(1 << 30)).alias("block")))
    total = unique.count()
    asked = valid(queries).select(F.col("vec_id").alias("query_id"), F.col("x").alias("q")).distinct()
    schema = "query_id long, rank int, vec_id long, score double"
    if not total:
        return spark.createDataFrame([], schema)
    share = min(1 << 30, int((1 << 30) * 0.9 * sample / total))
    chosen = unique.where(F.col("block") < share).select("x").limit(sample).collect() or unique.select("x").limit(sample).collect()
    books = fit(np.array(sorted(r["x"] for r in chosen)), codebooks, words, beam, rounds)
    shared = spark.sparkContext.broadcast(books)

    def pack_codes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            step = max(1, CODE_BLOCK_BYTES // (8 * len(batch["x"].iloc[0]))) if len(batch) else 1
            for at in range(0, len(batch), step):
                part = batch.iloc[at : at + step]
                x = np.stack(part["x"].to_numpy())
                codes = encode(x, shared.value, beam)[0]
                near = decode(codes, shared.value)
                sizes = part["ids"].map(len).to_numpy(np.int64)
                packed = {"sizes": sizes, "ids": np.concatenate(part["ids"].to_list()).astype(np.int64), "x": x, "codes": codes.astype(np.uint16)}
                packed |= {"norms": (near**2).sum(1), "errors": np.sqrt(((x - near) ** 2).sum(1))}
                yield pd.DataFrame({name: [value.tobytes()] for name, value in packed.items()})

    def pack_queries(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), QUERY_BLOCK):
                part = batch.iloc[at : at + QUERY_BLOCK]
                yield pd.DataFrame({"query_ids": [part["query_id"].to_numpy(np.int64).tobytes()], "q": [np.stack(part["q"].to_numpy()).tobytes()]})

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        books = shared.value
        count, words, dim = books.shape
        longest = np.sqrt((books**2).sum(2)).max(1).sum()
        limits: dict[int, np.ndarray] = {}  # by block of queries: distances within which this task has seen k candidates
        for batch in batches:
            for r in batch.itertuples():
                query_ids, q = np.frombuffer(r.query_ids, np.int64), np.frombuffer(r.q, float).reshape(-1, dim)
                sizes, ids = np.frombuffer(r.sizes, np.int64), np.frombuffer(r.ids, np.int64)
                starts, owner = np.cumsum(sizes) - sizes, np.repeat(np.arange(len(sizes)), sizes)
                x, codes = np.frombuffer(r.x, float).reshape(-1, dim), np.frombuffer(r.codes, np.uint16).reshape(-1, count).T.astype(np.intp)
                norms, errors = np.frombuffer(r.norms, float), np.frombuffer(r.errors, float) * (1 + dim * EPS)
                squares = (x**2).sum(1)
                tables = np.einsum("qd,mwd->qmw", q, books) * -2
                limit = limits.setdefault(r.part, np.full(len(q), np.inf))
                keep = min(shortlist, len(x))
                out = []
                for at, (query_id, own, table) in enumerate(zip(query_ids, q, tables, strict=True)):
                    near = norms.copy()
                    for m in range(count):
                        near += table[m].take(codes[m])
                    counts, own_square = sizes.copy(), own @ own
                    counts[owner[ids == query_id]] -= 1
                    short = np.argpartition(near, keep - 1)[:keep]
                    d = distances(x[short], own)
                    limit[at] = min(limit[at], _reaching(d, counts[short], k))
                    # No vector is left out but by a bound on its own distance, less what rounding may have added.
                    slack = (dim + count) * EPS * (np.sqrt(own_square) + longest) ** 2
                    rest = ~(np.sqrt(np.maximum(near + own_square - slack, 0)) - errors > limit[at])
                    rest[short] = False
                    rest = np.flatnonzero(rest)
                    square = squares[rest] - 2 * (x[rest] @ own) + own_square
                    rest = rest[~(square > limit[at] ** 2 + dim * EPS * 4 * (squares[rest] + own_square + limit[at] ** 2))]
                    found, d = np.concatenate([short, rest]), np.concatenate([d, distances(x[rest], own)])
                    limit[at] = min(limit[at], _reaching(d, counts[found], k))
                    fine = (counts[found] > 0) & ~(d > limit[at])
                    found, d = found[fine], d[fine]
                    # A vector's smallest id that isn't the query's: k vectors have the k best candidates among them.
                    first = ids[np.minimum(starts[found] + (ids[starts[found]] == query_id), len(ids) - 1)]
                    best = np.lexsort((first, d))[:k]
                    each = sizes[found[best]]
                    places = np.repeat(starts[found[best]] - (np.cumsum(each) - each), each) + np.arange(each.sum())
                    vec_id, d = ids[places], np.repeat(d[best], each)
                    vec_id, d = vec_id[vec_id != query_id], d[vec_id != query_id]
                    best = np.lexsort((vec_id, d))[:k]
                    out.append((np.full(len(best), query_id), vec_id[best], d[best]))
                query_id, vec_id, d = (np.concatenate(c) for c in zip(*out, strict=True))
                yield pd.DataFrame({"query_id": query_id, "vec_id": vec_id, "score": d})

    codes = unique.select("ids", "x").mapInPandas(pack_codes, "sizes binary, ids binary, x binary, codes binary, norms binary, errors binary")
    blocks = asked.mapInPandas(pack_queries, "query_ids binary, q binary").withColumn("part", F.monotonically_increasing_id())
    # Every block of queries meets every block of codes: the stated query set against all rows.
    n_blocks = F.lit(max(1, spark.sparkContext.defaultParallelism * 2))
    codes = codes.withColumn("lane", F.pmod(F.xxhash64("ids"), n_blocks))
    blocks = blocks.withColumn("lane", F.explode(F.sequence(F.lit(0).cast("long"), n_blocks.cast("long") - 1)))
    exact = codes.join(blocks, "lane").mapInPandas(score, "query_id long, vec_id long, score double")
    nearest = Window.partitionBy("query_id").orderBy("score", "vec_id")
    ranked = exact.withColumn("rank", F.row_number().over(nearest)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = common.table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return search(rows, rows.where("vec_id % 100 = 0"))


def oracle() -> str:
    """Exact search."""
    return """
with v as (select vec_id, embedding::double[] as x from embeddings
           where embedding is not null and len(list_filter(embedding, lambda e: e is null or not isfinite(e))) = 0
             and len(list_filter(embedding, lambda e: e <> 0)) > 0),
d as (select q.vec_id as query_id, v.vec_id, list_distance(q.x, v.x) as score
      from v as q join v on q.vec_id <> v.vec_id where q.vec_id % 100 = 0)
select query_id, row_number() over (partition by query_id order by score, vec_id)::int as rank, vec_id, score
from d qualify rank <= 10"""
