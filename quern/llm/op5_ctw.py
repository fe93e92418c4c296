"""Language-model scoring by context-tree weighting over bytes.

A text is its lower-cased words, each followed by a space but the last by the end byte. The next byte is taken apart
into eight binary choices, each at a node named by the bits before it; every node has a tree of contexts, the 0 to
`depth` bytes before. A context holds counts of both choices and their Krichevsky-Trofimov probability; its weighted
probability halves between that estimate and the product of its longer contexts'. Given the counts of all training
texts, a choice's probability is the mixture over all depths with the weights those probabilities leave; a context that
training never saw leaves its weight to the longest that it did. The score is the sum of log10 probabilities, and its
negative times log2(10) over the bytes is the code length per byte.

Distribution: a partition's texts are taken in blocks of bounded size. A block reports its distinct (context, byte)
strings with training counts, packed by bucket, a hash of the two nearest context bytes, so whatever grows is aggregated
before it is shuffled. A bucket's task merges them and weighs the trees of depth `depth` to 2; the two shallowest levels,
at most 256 x 255 rows, are summed for all and shared. With those a second pass over the buckets sends each block the
log probabilities of its own strings in their order, which the block finds again from its texts, so no string travels
back; a checksum of the strings goes along. The block's texts add the values up. Word counts for the unigram base go the
same way, under 64-bit hashes.

Defined results: a null text is the empty text, one end token; repeated rows are counted as often as they occur; a null
doc_id counts as the empty text in the fold; an empty table gives no rows; extra columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm import common

SPACE, END = 0x20, 0x0A
#: Bytes of text in a block (unless one text has more), and that are counted or scored at once; keys merged at once.
BLOCK, LOT, MERGE = 24 << 20, 1 << 20, 4 << 20
WORDS, STRINGS = 0, 1
#: Random numbers by place and byte, whose sums are the keys of words of up to PLACES bytes; longer ones go by XXH64.
PLACES = 64
TABLE = np.random.default_rng(20).integers(0, 1 << 64, (PLACES, 256), np.uint64)
#: The key of the end token in the unigram base.
END_KEY = np.uint64(xxhash.xxh64_intdigest(b"\n", 20))
CHANGED = "a block's texts changed between two readings of the table"


def _planes(x: np.ndarray) -> bytes:
    """x byte by byte of its elements: like bytes side by side compress better."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(len(x), -1).T).tobytes()


def _compressed(data: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(data)


def _columns(data: bytes, *kinds: type) -> list[np.ndarray]:
    """The arrays of these types whose planes were compressed one after the other."""
    sizes = [np.dtype(t).itemsize for t in kinds]
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(sum(sizes), -1)
    return [np.ascontiguousarray(x.T).view(t).ravel() for x, t in zip(np.split(planes, np.cumsum(sizes)[:-1]), kinds, strict=True)]


def _pack(keys: np.ndarray, values: np.ndarray) -> bytes:
    """Sorted uint64 keys with 4-byte values, compressed."""
    return _compressed(_planes(np.diff(keys, prepend=np.uint64(0))) + _planes(values))


def _unpack(data: bytes, kind: type) -> tuple[np.ndarray, np.ndarray]:
    steps, values = _columns(data, np.uint64, kind)
    return np.cumsum(steps, dtype=np.uint64), values


def _distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, and how often each occurs."""
    keys = np.sort(keys)
    starts = np.flatnonzero(np.diff(keys, prepend=~keys[:1]))
    return keys[starts], np.diff(np.append(starts, len(keys)))


def _total(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, and the sums of their counts, from parts that are in order."""
    if len(parts) == 1:
        return parts[0]
    k, c = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
    order = np.argsort(k, kind="stable")
    k, c = k[order], c[order]
    starts = np.flatnonzero(np.diff(k, prepend=~k[:1]))
    return k[starts], np.add.reduceat(c, starts) if len(starts) else c


def _words(text: str | None) -> list[bytes]:
    return (text or "").encode().lower().split()


class Streams:
    """Texts (as words) in one run of bytes: before each, eight zero bytes; after each word a space, the end byte after the last."""

    def __init__(self, texts: list[list[bytes]]) -> None:
        streams = [b" ".join(words) + b"\n" for words in texts]
        self.lengths = np.array([len(s) for s in streams], np.int64)
        self.raw = b"".join([bytes(8) + s for s in streams])
        self.starts = np.cumsum(self.lengths + 8) - self.lengths
        self.at = np.arange(self.lengths.sum()) + np.repeat(self.starts - (np.cumsum(self.lengths) - self.lengths), self.lengths)
        self.data = np.frombuffer(self.raw, np.uint8)
        self.sizes = np.array([len(words) for words in texts], np.int64)

    def strings(self, depth: int) -> np.ndarray:
        """For each byte in turn: `depth` context bytes from the nearest, then the byte, in one number."""
        before = np.ndarray((len(self.raw) - 7,), "<u8", self.raw, strides=(1,))[self.at - 8]
        return (before >> np.uint64(8 * (8 - depth)) << np.uint64(8)) | self.data[self.at]

    def keys(self) -> np.ndarray:
        """For each text in turn, its words' keys and the end token's."""
        text = self.data[self.at]
        ends = np.flatnonzero((text == SPACE) | (text == END))  # words hold neither; an empty text is its end alone
        first = np.append(0, ends[:-1] + 1)
        place = np.arange(len(text)) - np.repeat(first, ends - first + 1)
        sums = np.concatenate([[np.uint64(0)], np.cumsum(TABLE[np.minimum(place, PLACES - 1), text], dtype=np.uint64)])
        words = sums[ends] - sums[first]
        for i in np.flatnonzero(ends - first > PLACES):
            words[i] = xxhash.xxh64_intdigest(text[first[i] : ends[i]].tobytes(), 20)
        # An end byte closes the text's last word, if it has any, and is a token itself.
        tokens = np.full(len(self.sizes) + self.sizes.sum(), END_KEY)
        mine = np.ones(len(tokens), bool)
        mine[np.cumsum(self.sizes + 1) - 1] = False
        tokens[mine] = words[ends > first] if len(words) else words
        return tokens


class Lookup:
    """Values of distinct keys, by open addressing."""

    def __init__(self, keys: np.ndarray, values: np.ndarray) -> None:
        self.keys, self.values = keys, values
        self.bits = max(4, int(2 * len(keys)).bit_length())
        self.slots = np.full(1 << self.bits, -1, np.int32)
        rest, at = np.arange(len(keys), dtype=np.int32), self._first(keys)
        while len(rest):
            free = self.slots[at] < 0
            self.slots[at[free]] = rest[free]
            left = self.slots[at] != rest
            rest, at = rest[left], (at[left] + 1) & (len(self.slots) - 1)

    def _first(self, keys: np.ndarray) -> np.ndarray:
        return ((keys ^ (keys >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.bits)).astype(np.int64)

    def get(self, wanted: np.ndarray) -> np.ndarray:
        out = self.slots[at := self._first(wanted)]
        left = np.flatnonzero((out < 0) | (self.keys[out] != wanted)) if len(self.keys) else np.arange(len(wanted))
        while len(left):
            if (out[left] < 0).any():
                raise ValueError(CHANGED)
            at[left] = (at[left] + 1) & (len(self.slots) - 1)
            out[left] = self.slots[at[left]]
            left = left[self.keys[out[left]] != wanted[left]]
        return self.values[out]


def _lots(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    """Ranges of about LOT characters, one text at least."""
    start, size = 0, 0
    for i, t in enumerate(texts):
        if size and size + len(t or "") > LOT:
            yield start, i
            start, size = i, 0
        size += len(t or "")
    if start < len(texts):
        yield start, len(texts)


def _bucket(keys: np.ndarray, kind: int, depth: int, buckets: int) -> np.ndarray:
    """A string's bucket depends on its two nearest context bytes, a word's on its key."""
    near = keys >> np.uint64(8 * (depth - 1)) if kind == STRINGS else keys >> np.uint64(20)
    return (((near * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)) % np.uint64(buckets)).astype(np.int32)


def _dealt(keys: np.ndarray, kind: int, depth: int, buckets: int) -> list[tuple[int, np.ndarray]]:
    """Each bucket that sorted keys fall into, with the places of its keys, in order."""
    own = _bucket(keys, kind, depth, buckets)
    order = np.argsort(own.astype(np.uint16) if buckets < 1 << 16 else own, kind="stable")
    starts = np.flatnonzero(np.diff(own[order], prepend=-1))
    return [(kind * buckets + int(own[some[0]]), some) for some in np.split(order, starts[1:])]


def _blocks(rows: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.RecordBatch]]:
    """A partition's rows with their block: a new one begins once the texts so far reach the next multiple of BLOCK bytes."""
    first, size = TaskContext.get().partitionId() << 32, 0
    for batch in rows:
        lengths = pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        own = (size + np.cumsum(lengths) - lengths) // BLOCK
        size += int(lengths.sum())
        starts = np.flatnonzero(np.diff(own, prepend=-1))
        for start, stop in zip(starts, [*starts[1:], len(own)], strict=True):
            yield first + int(own[start]), batch.slice(start, stop - start)


def _tag(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for block, batch in _blocks(rows):
        yield batch.append_column("block", pa.array(np.full(batch.num_rows, block, np.int64)))


def _count(depth: int, buckets: int):
    """From rows (training, text): (bucket, block, data), data holding a block's keys and their training counts."""

    def flush(block: int, found: dict) -> Iterator[pa.RecordBatch]:
        for kind, marks in found.items():
            parts = [(k, c * train) for train, raw in marks.items() if raw for k, c in [_settled(raw)]]
            if not parts:
                continue
            k, c = _total(parts)
            for bucket, some in _dealt(k, kind, depth, buckets):
                data = _pack(k[some], c[some].astype(np.uint32))
                yield pa.RecordBatch.from_arrays([pa.array([bucket], pa.int64()), pa.array([block], pa.int64()), pa.array([data], pa.binary())], names=["bucket", "block", "data"])

    def _settled(raw: list) -> tuple[np.ndarray, np.ndarray]:
        """One part of a list of parts and of arrays of raw keys."""
        keys = [x for x in raw if isinstance(x, np.ndarray)]
        return _total([x for x in raw if isinstance(x, tuple)] + ([_distinct(np.concatenate(keys))] if keys else []))

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, found = -1, {}
        for own, batch in _blocks(rows):
            if own != block:
                yield from flush(block, found)
                block, found = own, {kind: {True: [], False: []} for kind in (WORDS, STRINGS)}
            training, texts = batch.column("training").to_pylist(), batch.column("text").to_pylist()
            for start, stop in _lots(texts):
                for train in (True, False):
                    words = [_words(t) for t, x in zip(texts[start:stop], training[start:stop], strict=True) if x == train]
                    if not words:
                        continue
                    streams = Streams(words)
                    for kind, keys in ((WORDS, streams.keys()), (STRINGS, streams.strings(depth))):
                        raw = found[kind][train]
                        raw.append(keys)
                        if sum(len(x) for x in raw if isinstance(x, np.ndarray)) > MERGE:
                            found[kind][train] = [_settled(raw)]
        yield from flush(block, found)

    return common.released(run)


_SMALL = 1 << 12
_LN_FACTORIAL = np.concatenate([[0.0], np.cumsum(np.log(np.arange(1, _SMALL)))])  # ln k!
_LN_HALF = np.concatenate([[math.lgamma(0.5)], math.lgamma(0.5) + np.cumsum(np.log(np.arange(_SMALL - 1) + 0.5))])  # ln gamma(k + 1/2)


def _ln_gamma(k: np.ndarray, half: bool) -> np.ndarray:
    """ln gamma(k + 1/2) or ln gamma(k + 1), from tables, beyond them by Stirling's series."""
    out = (_LN_HALF if half else _LN_FACTORIAL)[np.minimum(k, _SMALL - 1)]
    big = k >= _SMALL
    if big.any():
        x = k[big] + (0.5 if half else 1.0)
        out[big] = (x - 0.5) * np.log(x) - x + 0.5 * math.log(2 * math.pi) + 1 / (12 * x) - 1 / (360 * x**3)
    return out


def ln_kt(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """ln of the Krichevsky-Trofimov probability of a zeros and b ones in any one order."""
    return _ln_gamma(a, True) + _ln_gamma(b, True) - 2 * math.lgamma(0.5) - _ln_gamma(a + b, False)


def _mix(kt: np.ndarray, longer: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """ln of the weighted probability, and the weight of the own estimate; both 0 where nothing was counted."""
    weighted = np.where(n > 0, np.logaddexp(kt, longer) - math.log(2), 0.0)
    return weighted, np.where(n > 0, np.exp(kt - math.log(2) - weighted), 0.0)


class Trees:
    """The trees' levels from `depth` up to 2 over one bucket's strings (sorted, distinct) and their counts."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray, depth: int) -> None:
        self.depth, self.levels = depth, {}
        entries, n = keys, counts
        parent = below = None  # entry of the level below -> entry
        for d in range(depth, 1, -1):
            if d < depth:
                shorter = ((entries >> np.uint64(16)) << np.uint64(8)) | (entries & np.uint64(255))
                order = np.argsort(shorter, kind="stable")
                starts = np.flatnonzero(np.diff(shorter[order], prepend=~shorter[order][:1]))
                parent = np.empty(len(shorter), np.int64)
                parent[order] = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(shorter))))
                entries, n = shorter[order][starts], np.add.reduceat(n[order], starts) if len(starts) else n
            bits = []
            for k in range(8):
                place = entries >> np.uint64(8 - k)  # context, and the k bits already chosen
                starts = np.flatnonzero(np.diff(place, prepend=~place[:1]))
                node = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(place))))
                one = ((entries >> np.uint64(7 - k)) & np.uint64(1)).astype(bool)
                zeros = np.bincount(node, np.where(one, 0, n), len(starts)).astype(np.int64)
                ones = np.bincount(node, np.where(one, n, 0), len(starts)).astype(np.int64)
                kt = ln_kt(zeros, ones)
                if below is None:
                    weighted, weight = kt, (zeros + ones > 0) * 1.0
                else:
                    first, longer = below[k]
                    sums = np.bincount(node[parent[first]], longer, len(starts))
                    weighted, weight = _mix(kt, sums, zeros + ones)
                bits.append((node, zeros, ones, weight, starts, weighted))
            below = [(b[4], b[5]) for b in bits]
            self.levels[d] = (entries, parent, [b[:4] for b in bits])
            self.top = (entries, [b[1:3] + b[4:] for b in bits])

    def sums(self) -> list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """(nearest byte * 256 + node, zeros, ones, ln weighted) of every context of two bytes, choice by choice."""
        entries, bits = self.top
        out = []
        for k, (zeros, ones, starts, weighted) in enumerate(bits):
            e = entries[starts]
            node = (np.uint64(1) << np.uint64(k)) | ((e & np.uint64(255)) >> np.uint64(8 - k))
            out.append((((e >> np.uint64(16)) << np.uint64(8) | node).astype(np.int64), zeros, ones, weighted))
        return out

    def ln_probability(self, top: np.ndarray) -> np.ndarray:
        """ln of the probability of each string's byte after its context; top: see `shallow`."""

        def step(state: tuple, zeros: np.ndarray, ones: np.ndarray, weight: np.ndarray, one: np.ndarray) -> tuple:
            so_far, left, last = state
            seen = zeros + ones > 0
            estimate = (np.where(one, ones, zeros) + 0.5) / (zeros + ones + 1)
            weight = left * weight
            return so_far + weight * estimate, np.where(seen, left - weight, left), np.where(seen, estimate, last)

        states: list[tuple] = []
        total = np.zeros(0)
        for d in range(2, self.depth + 1):
            entries, _, bits = self.levels[d]
            byte = (entries & np.uint64(255)).astype(np.int64)
            up = self.levels[d - 1][1] if d > 2 else None
            total = np.zeros(len(entries))
            for k, (at, zeros, ones, weight) in enumerate(bits):
                one = ((byte >> (7 - k)) & 1).astype(bool)
                if up is None:
                    node, near = (1 << k) | (byte >> (8 - k)), (entries >> np.uint64(16)).astype(np.int64)
                    state = (np.zeros(len(byte)), np.ones(len(byte)), np.full(len(byte), 0.5))
                    for place in (0, near + 1):
                        state = step(state, top[0, place, node], top[1, place, node], top[2, place, node], one)
                    states.append(state)
                else:
                    states[k] = tuple(x[up] for x in states[k])
                states[k] = step(states[k], zeros[at], ones[at], weight[at], one)
                if d == self.depth:
                    total += np.log(states[k][0] + states[k][1] * states[k][2])
        return total


def shallow(rows: list[tuple[int, int, int, float]]) -> np.ndarray:
    """(3, 257, 256): zeros, ones and weight of each node, without context and after each byte.

    rows: (nearest byte * 256 + node, zeros, ones, sum of ln weighted probabilities of the contexts of two bytes).
    """
    top = np.zeros((3, 257, 256))
    longer = np.zeros((257, 256))
    for at, zeros, ones, ln in rows:
        top[0, 1 + (at >> 8), at & 255], top[1, 1 + (at >> 8), at & 255], longer[1 + (at >> 8), at & 255] = zeros, ones, ln
    for level in (slice(1, 257), slice(0, 1)):
        zeros, ones = top[0, level].astype(np.int64), top[1, level].astype(np.int64)
        weighted, top[2, level] = _mix(ln_kt(zeros, ones), longer[level], zeros + ones)
        if level.start:
            longer[0], top[:2, 0] = weighted.sum(0), top[:2, level].sum(1)
    return top


def _by_bucket(rows: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[tuple[int, bytes]], np.ndarray, np.ndarray]]:
    """From rows (bucket, block, data) in order of bucket: each bucket, its blocks' data (packed), and their total."""

    def settle(bucket: int, held: list) -> tuple:
        parts, size = [], 0
        for _, data in held:
            k, c = _unpack(data, np.uint32)
            parts.append((k, c.astype(np.int64)))
            size += len(k)
            if size > MERGE:
                parts = [_total(parts)]
                size = len(parts[0][0])
        return bucket, held, *_total(parts)

    bucket, held = -1, []
    for batch in rows:
        for own, block, data in zip(*(batch.column(c).to_pylist() for c in ("bucket", "block", "data")), strict=True):
            if own != bucket and held:
                yield settle(bucket, held)
                held = []
            bucket = own
            held.append((block, data))
    if held:
        yield settle(bucket, held)


def _sums(depth: int, buckets: int):
    """The buckets' sums for the shallow levels: (near, zeros, ones, ln); of a bucket of words (-1, tokens, distinct, 0)."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, _, k, c in _by_bucket(rows):
            if bucket < buckets:
                columns = [(np.array([-1]), c.sum(keepdims=True), (c > 0).sum(keepdims=True), np.zeros(1))]
            else:
                columns = Trees(k, c, depth).sums()
            for near, zeros, ones, ln in columns:
                places, at = np.unique(near, return_inverse=True)
                sums = [np.bincount(at, x, len(places)) for x in (zeros, ones, ln)]
                yield pa.RecordBatch.from_arrays([pa.array(places), *[pa.array(x.astype(np.int64)) for x in sums[:2]], pa.array(sums[2])], names=["near", "zeros", "ones", "ln"])

    return common.released(run)


def _answer(depth: int, buckets: int, top):
    """(bucket, block, sum, data): training counts (words) or ln probabilities (strings) of a block's keys in a bucket, in
    their order, and the keys' checksum."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, held, keys, counts in _by_bucket(rows):
            kind = bucket // buckets
            values = counts.astype(np.uint32) if kind == WORDS else Trees(keys, counts, depth).ln_probability(top.value).astype(np.float32)
            for block, data in held:
                k = _unpack(data, np.uint32)[0]
                found = _compressed(_planes(values[np.searchsorted(keys, k)]))
                yield pa.RecordBatch.from_arrays([pa.array([bucket], pa.int64()), pa.array([block], pa.int64()), pa.array([common.crc32(k.tobytes())], pa.int64()), pa.array([found], pa.binary())], names=["bucket", "block", "sum", "data"])

    return common.released(run)


def _own_keys(texts: list[str | None], kind: int, depth: int) -> np.ndarray:
    """The distinct keys of texts, in order."""
    keys, new, size = np.zeros(0, np.uint64), [], 0
    for start, stop in _lots(texts):
        streams = Streams([_words(t) for t in texts[start:stop]])
        new.append(streams.keys() if kind == WORDS else streams.strings(depth))
        size += len(new[-1])
        if size > MERGE or stop == len(texts):
            keys, new, size = _distinct(np.concatenate([keys, *new]))[0], [], 0
    return keys


def _score(depth: int, buckets: int, tokens: int, distinct: int):
    """From a block's texts and its answers: the scores of its texts."""

    def lookup(whole: list[str | None], answers: dict[int, tuple[int, bytes]], kind: int) -> Lookup:
        keys = _own_keys(whole, kind, depth)
        value = np.uint32 if kind == WORDS else np.float32
        values = np.empty(len(keys), value)
        for bucket, some in _dealt(keys, kind, depth, buckets):
            sum_, data = answers.pop(bucket, (None, b""))
            if sum_ != common.crc32(keys[some].tobytes()):
                raise ValueError(CHANGED)
            values[some] = _columns(data, value)[0]
        return Lookup(keys, values)

    def run(texts: pa.Table, answers: pa.Table) -> pa.Table:
        whole = texts.column("text").to_pylist()
        found = {b: (s, d) for b, s, d in zip(*(answers.column(c).to_pylist() for c in ("bucket", "sum", "data")), strict=True)}
        counts, ln = (lookup(whole, found, kind) for kind in (WORDS, STRINGS))
        if found:
            raise ValueError(CHANGED)
        out: tuple[list, ...] = ([], [], [], [])
        for start, stop in _lots(whole):
            streams = Streams([_words(t) for t in whole[start:stop]])
            sizes = streams.sizes + 1
            n = counts.get(streams.keys()).astype(np.float64)
            ends, tops = np.cumsum(streams.lengths), np.cumsum(sizes)
            found_ln = np.add.reduceat(ln.get(streams.strings(depth)).astype(np.float64), ends - streams.lengths)
            base = np.add.reduceat(np.log10((n + 1) / (tokens + distinct + 1)), tops - sizes)
            for column, x in zip(out, (sizes, np.add.reduceat((n > 0).astype(np.int64), tops - sizes), base, found_ln / math.log(10)), strict=True):
                column.append(x)
        sizes, known, base, score = (np.concatenate(x) for x in out)
        columns = [texts.column("doc_id"), texts.column("held_out"), pa.array(sizes), pa.array(known), pa.array(np.full(len(whole), tokens)), pa.array(base), pa.array(score)]
        return pa.table(columns, names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return run


def score(docs: DataFrame, depth: int = 7, folds: int = 7, held_out: int = 2) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of docs (doc_id, text); depth: 2 to 7.

    Rows whose fold is held_out are scored but not learnt from. docs must give the same rows in the same partitions
    whenever it is read: a table or a checkpoint, not the outcome of a shuffle; a difference raises an error.
    """
    spark = docs.sparkSession
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    held = common.fold(F.col("doc_id"), folds) == held_out
    counted = docs.select((~held).alias("training"), "text").mapInArrow(_count(depth, buckets), "bucket long, block long, data binary")
    counted = common.checkpointed(counted.repartition("bucket").sortWithinPartitions("bucket"))
    # At most 256 x 255 rows and one more.
    sums = counted.mapInArrow(_sums(depth, buckets), "near long, zeros long, ones long, ln double")
    sums = sums.groupBy("near").agg(F.sum("zeros"), F.sum("ones"), F.sum("ln")).collect()
    tokens, distinct = next(((r[1], r[2]) for r in sums if r[0] < 0), (0, 0))
    top = spark.sparkContext.broadcast(shallow([tuple(r) for r in sums if r[0] >= 0]))
    answers = counted.mapInArrow(_answer(depth, buckets, top), "bucket long, block long, sum long, data binary")
    texts = docs.select("doc_id", held.alias("held_out"), "text").mapInArrow(_tag, "doc_id long, held_out boolean, text string, block long")
    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return texts.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(_score(depth, buckets, tokens, distinct), schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(common.table(spark, sf_dir, "documents").select("doc_id", "text"))
