"""Best-fit packing of token sequences in bulk-synchronous supersteps.

Every document becomes its token ids and one end id; a document longer than the capacity is cut into full pieces, the
first of which may be shorter. Pieces are range-sorted by length (longest first), document and piece, and numbered
within their length: that number is a piece's rank, and pieces of one length differ in nothing else that packing sees.
So documents and gaps are held as classes: a length, or the gap of a sequence, with a count. A superstep takes all
pieces of one length, the longest left, and sweeps their successors, the gap classes from the smallest that is large
enough upwards; ranks settle which piece takes which gap; what is left over opens new sequences; the gaps are updated
and the next superstep begins. That is best-fit decreasing, for any number of pieces in at most `capacity` supersteps
over at most `capacity` classes: the plan's size doesn't follow the input, so the driver holds it. Rows are touched
twice, to be ranked and to be given their places; nothing gathers a class of pieces in one task.

Defined results: a null text is the empty text and packs as the end id alone; repeated rows are packed as often as
they occur; an empty table gives no rows; extra columns are not read.
"""

from __future__ import annotations

import os
import sys
import zlib
from array import array
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm import common

#: Bytes of texts in a lot.
LOT = 4 << 20
#: Above any count of pieces of one length, below what overflows when multiplied by a length.
RANKS = 1 << 44


class Ids:
    """A byte-level BPE tokenizer file, read by tokenizers, and its ids as little-endian unsigned 32-bit numbers.

    The file's merges are run by tiktoken's engine where that gives the same ids: it contracts whichever neighbours
    make a token, the file only the pair that it lists for the token. If the file's own merges turn the bytes of every
    token into that one token, no other neighbours that make it can ever stand side by side, and the two agree on every
    text. That is tried for every token when a worker loads the file; otherwise, and for a text that may hold one of
    the added tokens, tokenizers encodes.
    """

    def __init__(self, path: str, pattern: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.added = [x.content for x in self.tokenizer.get_added_tokens_decoder().values()]
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=False)
        added = set(self.added)
        vocabulary = {token: i for token, i in vocabulary.items() if token not in added}
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        byte_of = {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(sorted(set(range(256)) - set(plain)))}
        self.engine = None
        model = self.tokenizer.model
        if set(byte_of) <= set(vocabulary) and all([x.id for x in model.tokenize(token)] == [i] for token, i in vocabulary.items()):
            ranks = {bytes([byte_of[c] for c in token]): i for token, i in vocabulary.items()}
            self.engine = tiktoken.Encoding("file", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def encode(self, text: str) -> bytes:
        if self.engine is None or any(x in text for x in self.added):
            ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        else:
            ids = self.engine.encode_ordinary(text)
        return array("I", ids).tobytes() if LITTLE else np.array(ids, "<u4").tobytes()


#: Whether array("I") holds little-endian unsigned 32-bit numbers here.
LITTLE = sys.byteorder == "little" and array("I").itemsize == 4

_loaded: dict[tuple[str, str], Ids] = {}


def _worker(path: str, pattern: str) -> Ids:
    if (path, pattern) not in _loaded:
        _loaded[path, pattern] = Ids(path, pattern)
    return _loaded[path, pattern]


def pieces(docs: DataFrame, tokenizer: str, capacity: int, end_id: int, pattern: str, ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 and, if asked for, ids (binary) of every piece of docs (doc_id, text)."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, end = _worker(tokenizer, pattern), np.array([end_id], "<u4").tobytes()
        for batch in common.batches(rows, LOT):
            texts = ["" if t is None else t for t in batch.column("text").to_pylist()]
            out: tuple[list, ...] = ([], [], [], [], [], [])
            for row, text in enumerate(texts):
                data = encoder.encode(text) + end
                n = len(data) // 4
                start, stop, k = 0, (n - 1) % capacity + 1, 0
                while start < n:
                    own = data[4 * start : 4 * stop]
                    for column, x in zip(out, (row, k, start, stop - start, zlib.crc32(own), own), strict=True):
                        column.append(x)
                    start, stop, k = stop, stop + capacity, k + 1
            columns = [batch.column("doc_id").take(pa.array(out[0], pa.int64())), pa.array(out[1], pa.int32()), *[pa.array(x, pa.int64()) for x in out[2:5]]]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            if ids:
                columns, names = [*columns, pa.array(out[5], pa.binary())], [*names, "ids"]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * ids)


def plan(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, pieces, first sequence, offset): those pieces, by rank, go to sequences in turn, at offset.

    counts: the number of pieces of each length.
    """
    places: list[tuple[int, int, int, int, int]] = []
    gaps: list[int] = []  # gap classes, ascending
    runs: dict[int, list[tuple[int, int]]] = {}  # (first sequence, sequences) of a gap class
    opened = 0

    def leave(gap: int, first: int, n: int) -> None:
        if gap:
            if gap not in runs:
                insort(gaps, gap)
            runs.setdefault(gap, []).append((first, n))

    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        while left and (at := bisect_left(gaps, length)) < len(gaps):
            gap = gaps[at]
            first, n = runs[gap].pop()
            if n > left:
                runs[gap].append((first + left, n - left))
                n = left
            if not runs[gap]:
                del runs[gap], gaps[at]
            places.append((length, rank, n, first, capacity - gap))
            leave(gap - length, first, n)
            rank, left = rank + n, left - n
        each = capacity // length
        for n, fill in ((left // each, each), (1, left % each)):
            if n and fill:
                for k in range(fill):
                    places.append((length, rank, n, opened, k * length))
                    rank += n
                leave(capacity - fill * length, opened, n)
                opened += n
    return places


def pack(rows: DataFrame, capacity: int) -> DataFrame:
    """rows (length from 1 to capacity, and any others) with `sequence_id` and `offset`.

    rows must be cheap to read again: a checkpoint or a written table.
    """

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last, seen = TaskContext.get().partitionId(), -1, 0
        for batch in batches:
            lengths = batch.column("length").to_numpy()
            starts = np.flatnonzero(np.diff(lengths, prepend=-1))
            at = np.arange(len(lengths)) - np.repeat(starts, np.diff(np.append(starts, len(lengths))))
            if len(lengths) and lengths[0] == last:
                at[: starts[1] if len(starts) > 1 else None] += seen
            if len(lengths):
                last, seen = lengths[-1], at[-1] + 1
            yield batch.append_column("__part", pa.array(np.full(len(at), part, np.int64))).append_column("__at", pa.array(at.astype(np.int64)))

    names = rows.columns
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    order = [F.col("length").desc(), *[c for c in ("doc_id", "piece") if c in rows.columns]]
    ranked = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    ranked = common.checkpointed(ranked.mapInArrow(number, f"{schema}, __part long, __at long"))
    # Sorted by length, so at most capacity + partitions rows.
    found = sorted((-r[1], r[0], r[2]) for r in ranked.groupBy("__part", "length").count().collect())
    counts: dict[int, int] = {}
    before = {}
    for minus, part, n in found:
        before[part, -minus] = counts.get(-minus, 0)
        counts[-minus] = before[part, -minus] + n
    groups = np.array(sorted((part * (capacity + 1) + length, n) for (part, length), n in before.items()), np.int64).reshape(-1, 2)
    places = np.array(sorted(plan(counts, capacity)), np.int64).reshape(-1, 5)
    shared = rows.sparkSession.sparkContext.broadcast((groups, places, places[:, 0] * RANKS + places[:, 1]))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups, places, keys = shared.value
        for batch in batches:
            part, at, length = (batch.column(c).to_numpy() for c in ("__part", "__at", "length"))
            rank = at + groups[np.searchsorted(groups[:, 0], part * (capacity + 1) + length), 1]
            found = places[np.searchsorted(keys, length * RANKS + rank, side="right") - 1]
            columns = [batch.column(c) for c in names]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(found[:, 3] + rank - found[:, 1]), pa.array(found[:, 4])], names=[*names, "sequence_id", "offset"])

    return ranked.mapInArrow(place, f"{schema}, sequence_id long, offset long")


def sequences(packed: DataFrame) -> DataFrame:
    """sequence_id and ids (binary, as in the pieces) of packed pieces that carry their ids."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    whole = F.aggregate(parts, F.lit(b""), lambda so_far, x: F.concat(so_far, x["ids"]))
    return packed.groupBy("sequence_id").agg(whole.alias("ids"))


def best_fit(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 0, pattern: str = public_tokenizers.PATTERN, ids: bool = False) -> DataFrame:
    """The pieces of docs (doc_id, text), packed."""
    return pack(common.checkpointed(pieces(docs, tokenizer, capacity, end_id, pattern, ids)), capacity)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_fit(common.table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
