"""SimHash near-duplicates by deletion-variant signatures.

A text's fingerprint has 64 bits: bit i is 1 if over half of the XXH64 hashes of its word shingles have it. Two
fingerprints link if they differ in two bits at most. They are cut into two segments of 32 bits, fewer than distance
plus one: of any linked pair one segment differs by one bit at most. So each distinct fingerprint is indexed under 64
keys, a segment with one bit deleted each; an equality join on the key brings every linked pair together, and whole
fingerprints verify it. A pair that meets under several keys is reported under one of them.

A key that over LARGEST distinct fingerprints share isn't compared pair by pair: its members get second keys, the same
cut once more of the segment that the first key leaves free, and meet again. Under such a key 46 bits are fixed and at
most 2^18 fingerprints exist. Linked fingerprints become components; equal texts never make more than one fingerprint.

Defined results: a null text, like an empty one, has no shingle and the fingerprint zero, which links like any other;
repeated rows share a fingerprint and a component; a component's id is its smallest doc_id that isn't null (null if
none); an empty table gives no rows; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm import common
from quern.llm.components import components

#: Distinct fingerprints under one key that are compared pair by pair.
LARGEST = 4096


def fingerprint(text: str | None, words: int = 3) -> int:
    """The 64-bit fingerprint of a text; 0 if it has no words."""
    found = (text or "").encode().lower().split()
    if not found:
        return 0
    n = max(1, len(found) - words + 1)
    digest = xxhash.xxh64_intdigest
    total = np.zeros(64, np.int64)
    for at in range(0, n, 1 << 16):
        hashes = [digest(b" ".join(found[i : i + words]), 42) for i in range(at, min(n, at + (1 << 16)))]
        total += np.unpackbits(np.array(hashes, np.uint64).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * total > n, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, words: int = 3) -> DataFrame:
    """doc_id, fp (the fingerprint as a signed long) of docs (doc_id, text)."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.batches(rows):
            found = np.array([fingerprint(t, words) for t in batch.column("text").to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found.view(np.int64))], names=["doc_id", "fp"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, fp long")


def _without(values: np.ndarray, bits: int) -> Iterator[tuple[int, np.ndarray]]:
    """(i, values without their bit i) for each bit."""
    for i in range(bits):
        low = np.uint64((1 << i) - 1)
        yield i, ((values >> np.uint64(i + 1)) << np.uint64(i)) | (values & low)


def _index(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """key, fp: the 64 first keys of each fingerprint. A key: segment (1 bit), deleted bit (5), the others (31)."""
    for batch in rows:
        fp = batch.column("fp").to_numpy().view(np.uint64)
        for segment in range(2):
            half = (fp >> np.uint64(32 * segment)) & np.uint64(0xFFFFFFFF)
            keys = [rest | np.uint64((segment << 36) | (i << 31)) for i, rest in _without(half, 32)]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).view(np.int64)), pa.array(np.tile(fp, 32).view(np.int64))], names=["key", "fp"])


def _second(key: np.ndarray, fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The 32 second keys: the first key, half of the free segment (1 bit), deleted bit (4), the others (15)."""
    free = np.where((key >> np.uint64(36)) & np.uint64(1), fp, fp >> np.uint64(32)) & np.uint64(0xFFFFFFFF)
    keys = []
    for half in range(2):
        part = (free >> np.uint64(16 * half)) & np.uint64(0xFFFF)
        keys += [(key << np.uint64(20)) | np.uint64((half << 19) | (i << 15)) | rest for i, rest in _without(part, 16)]
    return np.concatenate(keys), np.tile(fp, 32)


def _bits(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x)


def _pairs(key: np.ndarray, fp: np.ndarray, distance: int, level: int) -> tuple[np.ndarray, np.ndarray]:
    """Linked pairs within the runs of equal keys, each under one key of the first level only."""
    a, b = [], []
    at = np.arange(len(key))
    step = 1
    while len(at):
        at = at[at + step < len(key)]
        at = at[key[at] == key[at + step]]
        differ = fp[at] ^ fp[at + step]
        found = (_bits(differ) <= distance) & (differ != 0)
        if level == 1:
            found &= key[at] == _own_key(fp[at], differ)
        a.append(fp[at[found]])
        b.append(fp[at[found] + step])
        step += 1
    return np.concatenate([*a, np.zeros(0, np.uint64)]), np.concatenate([*b, np.zeros(0, np.uint64)])


def _own_key(fp: np.ndarray, differ: np.ndarray) -> np.ndarray:
    """The one first key under which a pair is reported: the low segment's if that differs by one bit at most."""
    low = differ & np.uint64(0xFFFFFFFF)
    segment = (_bits(low) > 1).astype(np.uint64)
    part = np.where(segment, differ >> np.uint64(32), low)
    i = np.where(part, _bits(part - np.uint64(1) & ~part), 0).astype(np.uint64)
    half = (fp >> (segment * np.uint64(32))) & np.uint64(0xFFFFFFFF)
    rest = ((half >> (i + np.uint64(1))) << i) | (half & ((np.uint64(1) << i) - np.uint64(1)))
    return (segment << np.uint64(36)) | (i << np.uint64(31)) | rest


def _match(distance: int, largest: int, level: int):
    """From rows sorted by key: links (a, b), and, at level 1, second keys (key, fp) of members of too large runs."""

    def out(a=(), b=(), key=(), fp=()) -> pa.RecordBatch:
        columns = [np.array(x, np.uint64).view(np.int64) for x in (a, b, key, fp)]
        link = [pa.array(x) for x in columns[:2]] if len(columns[0]) else [pa.nulls(len(columns[2]), pa.int64())] * 2
        more = [pa.array(x) for x in columns[2:]] if len(columns[2]) else [pa.nulls(len(columns[0]), pa.int64())] * 2
        return pa.RecordBatch.from_arrays([*link, *more], names=["a", "b", "key", "fp"])

    def second(key: np.ndarray, fp: np.ndarray) -> Iterator[pa.RecordBatch]:
        for at in range(0, len(key), 1 << 14):
            yield out(**dict(zip(("key", "fp"), _second(key[at : at + (1 << 14)], fp[at : at + (1 << 14)]), strict=True)))

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, fp, large = np.zeros(0, np.uint64), np.zeros(0, np.uint64), None
        for batch in rows:
            if not batch.num_rows:
                continue
            key = np.concatenate([key, batch.column("key").to_numpy().view(np.uint64)])
            fp = np.concatenate([fp, batch.column("fp").to_numpy().view(np.uint64)])
            yield from settle(key, fp, whole := np.searchsorted(key.view(np.int64), key.view(np.int64)[-1]), large)
            key, fp = key[whole:], fp[whole:]
            if level == 1 and len(key) > largest:  # the last run is too large already: let it go
                large = key[-1]
                yield from second(key, fp)
                key, fp = key[:0], fp[:0]
        yield from settle(key, fp, len(key), large)

    def settle(key: np.ndarray, fp: np.ndarray, n: int, large: np.uint64 | None) -> Iterator[pa.RecordBatch]:
        key, fp = key[:n], fp[:n]
        if level == 1 and n:
            starts = np.flatnonzero(np.diff(key, prepend=~key[:1]))
            sizes = np.diff(np.append(starts, n))
            over = np.repeat((sizes > largest) | ((key[starts] == large) if large is not None else False), sizes)
            yield from second(key[over], fp[over])
            key, fp = key[~over], fp[~over]
        a, b = _pairs(key, fp, distance, level)
        yield out(a=a, b=b)

    return run


def links(fps: DataFrame, distance: int = 2, largest: int = LARGEST) -> DataFrame:
    """a, b (signed longs): the pairs of distinct fingerprints in fps (fp) that differ in 1 to `distance` bits (at most 2)."""
    if not 0 <= distance <= 2:
        raise ValueError("two segments with one deleted bit find pairs that differ in at most 2 bits")
    schema = "a long, b long, key long, fp long"
    keys = fps.select("fp").distinct().mapInArrow(_index, "key long, fp long")
    first = common.checkpointed(keys.repartition("key").sortWithinPartitions("key").mapInArrow(_match(distance, largest, 1), schema))
    again = first.where("key is not null").select("key", "fp").repartition("key").sortWithinPartitions("key")
    second = again.mapInArrow(_match(distance, largest, 2), schema).select("a", "b").where("a is not null")
    return first.where("a is not null").select("a", "b").union(second)


def near_duplicates(docs: DataFrame, words: int = 3, distance: int = 2, largest: int = LARGEST) -> DataFrame:
    """doc_id, fp, component_id of each row of docs (doc_id, text)."""
    rows = common.checkpointed(fingerprints(docs, words))
    own = rows.groupBy("fp").agg(F.min("doc_id").alias("first"))
    roots = components(links(own, distance, largest)).select(F.col("node").alias("fp"), "root")
    own = own.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = own.groupBy("root").agg(F.min("first").alias("component_id"))
    return rows.join(own.join(least, "root").select("fp", "component_id"), "fp").select("doc_id", "fp", "component_id")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(common.table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
