"""Suffix-array dedup: every byte of a string of `length` bytes that also starts elsewhere goes.

The suffixes of all texts are sampled at anchors, so that equal strings have equal anchors: of each window of `length`
bytes its anchor is the leftmost GRAM-byte string of least hash in it. A window and its other occurrences thus meet at
one anchor, and a segment, the bytes of all windows that share an anchor, is all that has to be compared there.

Equal segments of one anchor are equal in all their windows, so they only need counting: pre-aggregated in each
partition, then by anchor. Where an anchor has different segments, one of each is put in an enhanced suffix array: sorted
by what follows from the anchor on, with the lengths of common prefixes. A stack-scan yields the tree of common-prefix
intervals, the deepest first. Within an interval all members share that prefix; whether they go on together to the left
is tested on the order of what precedes the anchor, kept by merging the children's orders. Left and right extension
together of at least `length` bytes are a repeat; it is reported for each member that no longer repeat covered so far, with
the string's hash as its group. So copies of thousands, their neighbours or not, are found without comparing pairs.

An anchor with over `largest` different segments is split until none is: windows are divided by the place of the anchor
in them, and segments by the bytes that all windows of one half have in common.

Defined results: a null text is the empty text, and nothing of a text shorter than `length` goes; repeated rows are
repeats of each other; an empty table gives no rows; extra columns are not read.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm import common

#: Bytes of an anchor.
GRAM = 64
#: Bytes of text that are hashed at once (unless one text has more), and anchors that are combined at once.
LOT, COMBINE = 1 << 19, 1 << 17
#: Different segments of an anchor that are compared in one task, and anchors with more that may be broadcast.
LARGEST, BROADCAST = 4096, 100_000
#: Bytes of the shorter repeats that the query counts besides: a passage of over 50 words often has less than 400.
PASSAGE = 256
ROWS = "group long, rid long, start long, size long"
ANCHORS = "h long, s1 long, s2 long, m long, rid long, lo long, hi long, p long"


def _mix(x: np.ndarray) -> np.ndarray:
    x *= np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(32)
    return x


def gram_hashes(data: bytes) -> np.ndarray:
    """A hash of each string of GRAM bytes in data."""
    n = len(data) - GRAM + 1
    h = _mix(np.ndarray((len(data) - 7,), "<u8", data, strides=(1,)).copy())
    for step in (8, 16, 32):
        h = _mix(h[:-step] * np.uint64(0xC2B2AE3D27D4EB4F) + h[step:])
    return h[:n]


def _window_min(x: np.ndarray, w: int) -> np.ndarray:
    """The least of each w neighbours of x."""
    n = len(x) - w + 1
    padded = np.full(-(-len(x) // w) * w, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(x)] = x
    blocks = padded.reshape(-1, w)
    forward = np.minimum.accumulate(blocks, axis=1).ravel()
    backward = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(backward[:n], forward[w - 1 : w - 1 + n])


def anchors(data: bytes, starts: np.ndarray, sizes: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """(text, lo, hi, p, hash): windows lo to hi of a text have their anchor at p. Texts lie in data, of length bytes at least."""
    hashes = gram_hashes(data)
    bits = np.uint64(max(1, len(hashes).bit_length()))
    at = np.arange(len(hashes), dtype=np.uint64)
    least = _window_min(hashes >> bits << bits | at, length - GRAM + 1)
    anchor = (least & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    # The low bits made room for the places: windows in which they decide are looked at again, whatever else the lot holds.
    for i in np.flatnonzero(hashes[anchor] != _window_min(hashes, length - GRAM + 1)):
        anchor[i] = i + np.argmin(hashes[i : i + length - GRAM + 1])
    windows = sizes - length + 1
    text = np.repeat(np.arange(len(sizes)), windows)
    place = np.arange(len(text)) - np.repeat(np.cumsum(windows) - windows, windows)
    p = anchor[place + starts[text]] - starts[text]
    first = np.flatnonzero((np.diff(text, prepend=-1) != 0) | (np.diff(p, prepend=-1) != 0))
    last = np.append(first[1:], len(text)) - 1
    return text[first], place[first], place[last], p[first], hashes[p[first] + starts[text[first]]].view(np.int64)


def _lots(rows: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, list[bytes]]]:
    """(rids, texts as bytes) of about LOT bytes."""
    rids, texts, size = [], [], 0
    for batch in common.batches(rows):
        for rid, text in zip(batch.column("rid").to_pylist(), batch.column("text"), strict=True):
            if size >= LOT:
                yield np.array(rids, np.int64), texts
                rids, texts, size = [], [], 0
            data = text.as_buffer().to_pybytes() if text.is_valid else b""
            rids.append(rid)
            texts.append(data)
            size += len(data)
    if rids:
        yield np.array(rids, np.int64), texts


def _segments(length: int):
    """From rows (rid, text): ANCHORS, one for each different segment of a partition, and ROWS of those it has several of."""

    def combine(parts: list[tuple]) -> Iterator[pa.RecordBatch]:
        h, s1, s2, rid, lo, hi, p = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.lexsort((s2, s1))
        h, s1, s2, rid, lo, hi, p = (x[order] for x in (h, s1, s2, rid, lo, hi, p))
        new = (np.diff(s1, prepend=~s1[:1]) != 0) | (np.diff(s2, prepend=~s2[:1]) != 0)
        starts = np.flatnonzero(new)
        m = np.diff(np.append(starts, len(s1)))
        repeated = np.repeat(m > 1, m)
        found = _row_columns(s1[repeated], rid[repeated], lo[repeated], hi[repeated] - lo[repeated] + length)
        kept = [pa.array(x[starts]) for x in (h, s1, s2)] + [pa.array(m)] + [pa.array(x[starts]) for x in (rid, lo, hi, p)]
        # Rows go along to whichever task their text's number hashes to.
        names = [x.split()[0] for x in (*ANCHORS.split(", "), "group long", "of long", "start long", "size long")]
        extra = [pa.array(rid[repeated] * np.int64(0x2545F4914F6CDD1D)), *[pa.nulls(int(repeated.sum()), pa.int64())] * 7]
        columns = [pa.concat_arrays([a, b]) for a, b in zip(kept, extra, strict=True)]
        columns += [pa.concat_arrays([pa.nulls(len(starts), pa.int64()), x]) for x in found]
        whole = pa.RecordBatch.from_arrays(columns, names=names)
        for at in range(0, whole.num_rows, 1 << 14):
            yield whole.slice(at, 1 << 14)

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, n = [], 0
        for rids, texts in _lots(rows):
            keep = [i for i, t in enumerate(texts) if len(t) >= length]
            if not keep:
                continue
            sizes = np.array([len(texts[i]) for i in keep], np.int64)
            starts = np.cumsum(sizes) - sizes
            data = b"".join([texts[i] for i in keep])
            text, lo, hi, p, h = anchors(data, starts, sizes, length)
            begin, end, a = starts[text] + lo, starts[text] + hi + length, p - lo
            digest, view = xxhash.xxh3_128_digest, memoryview(data)
            s = b"".join([digest(view[x:y], z) for x, y, z in zip(begin.tolist(), end.tolist(), a.tolist(), strict=True)])
            s1, s2 = np.frombuffer(s, np.int64).reshape(-1, 2).T
            parts.append((h, s1, s2, rids[keep][text], lo, hi, p))
            n += len(h)
            if n > COMBINE:
                yield from combine(parts)
                parts, n = [], 0
        if parts:
            yield from combine(parts)

    return common.released(run)


def _row_columns(group: np.ndarray, rid: np.ndarray, start: np.ndarray, size: np.ndarray) -> list[pa.Array]:
    return [pa.array(np.asarray(x, np.int64)) for x in (group, rid, start, size)]


def _classes(length: int):
    """From rows in order of h, s1, s2: ROWS of equal segments, and one segment (single: it is the only one) of each kind of
    an anchor that has several kinds and a single one among them."""
    names = ["group", "rid", "start", "size", "h", "lo", "hi", "p", "single"]

    def settle(x: dict[str, np.ndarray]) -> pa.RecordBatch:
        h, s1, s2, m, rid, lo, hi, p = (x[c.split()[0]] for c in ANCHORS.split(", "))
        anchor = np.flatnonzero(np.diff(h, prepend=~h[:1]) != 0)
        new = (np.diff(s1, prepend=~s1[:1]) != 0) | (np.diff(s2, prepend=~s2[:1]) != 0)
        new[anchor] = True
        kinds = np.flatnonzero(new)
        sizes = np.diff(np.append(kinds, len(h)))
        total = np.add.reduceat(m, kinds) if len(kinds) else m
        again = np.repeat(total > 1, sizes) & (m == 1)
        found = _row_columns(s1[again], rid[again], lo[again], hi[again] - lo[again] + length)
        of = np.searchsorted(anchor, kinds, side="right") - 1
        several = np.bincount(of, minlength=len(anchor)) > 1
        several &= np.bincount(of, total == 1, len(anchor)) > 0
        reps = kinds[several[of]]
        more = [pa.array(y[reps]) for y in (h, rid, lo, hi, p)] + [pa.array(total[several[of]] == 1)]
        n, k = len(found[0]), len(reps)
        nulls = [pa.nulls(n, pa.int64())] * 4 + [pa.nulls(n, pa.bool_())]
        group, rows, start, size = found
        columns = [pa.concat_arrays([y, pa.nulls(k, pa.int64())]) for y in (group,)]
        columns.append(pa.concat_arrays([rows, more[1]]))
        columns += [pa.concat_arrays([y, pa.nulls(k, pa.int64())]) for y in (start, size)]
        columns += [pa.concat_arrays([a, b]) for a, b in zip(nulls, [more[0], *more[2:]], strict=True)]
        return pa.RecordBatch.from_arrays(columns, names=names)

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] | None = None
        for batch in rows:
            if not batch.num_rows:
                continue
            passed = np.asarray(batch.column("group").is_valid())
            if passed.any():
                done = batch.filter(pa.array(passed))
                k = done.num_rows
                columns = [done.column(c) for c in ("group", "of", "start", "size")] + [pa.nulls(k, pa.int64())] * 4 + [pa.nulls(k, pa.bool_())]
                yield pa.RecordBatch.from_arrays(columns, names=names)
                batch = batch.filter(pa.array(~passed))
            new = {c.split()[0]: batch.column(c.split()[0]).to_numpy() for c in ANCHORS.split(", ")}
            held = new if held is None else {c: np.concatenate([held[c], new[c]]) for c in new}
            if len(held["h"]):
                whole = int(np.searchsorted(held["h"], held["h"][-1]))
                if whole:
                    yield settle({c: x[:whole] for c, x in held.items()})
                    held = {c: x[whole:] for c, x in held.items()}
        if held is not None and len(held["h"]):
            yield settle(held)

    return common.released(run)


def _common(a: bytes, b: bytes) -> int:
    """Length of the common prefix."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    low, high = 0, n  # a[:low] == b[:low], a[:high] != b[:high]
    while high - low > 1:
        middle = (low + high) // 2
        if a[low:middle] == b[low:middle]:
            low = middle
        else:
            high = middle
    return low


def repeats(segments: list[tuple[bytes, int]], length: int) -> Iterator[tuple[int, int, int]]:
    """(segment, left, right) for segments (bytes, place of the anchor) of one anchor: the left bytes before the anchor and
    the right ones from it on also occur in another segment, and together are `length` at least. All such bytes are covered.
    """
    after = [s[a:] for s, a in segments]
    before = [s[:a][::-1] for s, a in segments]
    order = sorted(range(len(segments)), key=after.__getitem__)
    lcp = [_common(after[i], after[j]) for i, j in zip(order, order[1:], strict=False)] + [-1]
    reach = [-1] * len(segments)  # the furthest left that a member was reported, always with this much to the right or more
    known: dict[tuple[int, int], int] = {}

    def left(i: int, j: int) -> int:
        if (i, j) not in known:
            known[i, j] = _common(before[i], before[j])
        return known[i, j]

    def visit(members: list[int], right: int) -> Iterator[tuple[int, int, int]]:
        """One interval: members share `right` bytes from the anchor on."""
        if right + max(map(len, (before[i] for i in members))) < length:
            return
        steps = [left(i, j) for i, j in zip(members, members[1:], strict=False)]
        for at, i in enumerate(members):
            far = max(steps[at - 1] if at else -1, steps[at] if at < len(steps) else -1)
            if far > reach[i] and far + right >= length:
                reach[i] = far
                yield i, far, right

    # Each open interval: its prefix length and its children's members, in order of what precedes the anchor.
    stack: list[tuple[int, list[int]]] = []
    for at, i in enumerate(order):
        members, value = [i], lcp[at]
        while stack and stack[-1][0] > value:
            prefix, held = stack.pop()
            members = sorted(held + members, key=before.__getitem__)
            yield from visit(members, prefix)
        if stack and stack[-1][0] == value:
            stack[-1] = (value, stack[-1][1] + members)
        else:
            stack.append((value, members))


def _trees(length: int):
    """From rows (key, rid, p, a, single, bytes) in order of key: ROWS."""

    def settle(rows: list[tuple]) -> Iterator[tuple[int, int, int, int]]:
        if len(rows) < 2:
            return
        for i, far, right in repeats([(r[4], r[2]) for r in rows], length):
            rid, p, a, single, data = rows[i]
            if single:
                yield xxhash.xxh64_intdigest(data[a - far : a + right]) - (1 << 63), rid, p - far, far + right

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []
        for batch in batches:
            out = []
            for own, *row in zip(*(batch.column(c).to_pylist() for c in ("key", "rid", "p", "a", "single", "bytes")), strict=True):
                if own != key:
                    out += settle(held)
                    key, held = own, []
                held.append(row)
            yield _rows(out)
        yield _rows(list(settle(held)))

    return common.released(run)


def _rows(found: list[tuple[int, int, int, int]]) -> pa.RecordBatch:
    columns = _row_columns(*np.array(found, np.int64).reshape(-1, 4).T)
    return pa.RecordBatch.from_arrays(columns, names=["group", "rid", "start", "size"])


def _packed(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """text as compressed bytes, for the way through a shuffle."""
    pack = zstandard.ZstdCompressor(level=1).compress
    for batch in common.batches(rows):
        data = [pack(t.as_buffer()) if t.is_valid else pack(b"") for t in batch.column("text")]
        rest = [c for c in batch.schema.names if c != "text"]
        yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in rest], pa.array(data, pa.binary())], names=[*rest, "packed"])


def _cut(length: int):
    """From rows (packed, wanted): the segments' bytes, as (key, rid, p, a, single, bytes)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        for batch in common.batches(batches, 1 << 20):
            out = []
            for rid, packed, wanted in zip(*(batch.column(c).to_pylist() for c in ("rid", "packed", "wanted")), strict=True):
                data = unpack(packed)
                for w in wanted:
                    out.append((w["h"], rid, w["p"], w["p"] - w["lo"], w["single"], data[w["lo"] : w["hi"] + length]))
                if len(out) > 4096:
                    yield _segment_batch(out)
                    out = []
            yield _segment_batch(out)

    return common.released(run)


def _segment_batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [()] * 6
    types = [pa.int64()] * 4 + [pa.bool_(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["key", "rid", "p", "a", "single", "bytes"])


def _split(segments: DataFrame, length: int, largest: int) -> DataFrame:
    """segments with keys under which at most `largest` lie, or whose segments share a whole window.

    A key starts with all windows of an anchor: those in which `left` bytes precede it, `left` from u = 0 to v = length - GRAM.
    While a key is too large, its windows are halved; a segment goes with each half in which it has a window, under the
    bytes that all windows of the half hold: from u before the anchor to length - v from it on.
    """
    rows = segments.withColumns({"u": F.lit(0), "v": F.lit(length - GRAM)})
    done = None
    while True:
        sizes = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > largest)
        sizes = common.checkpointed(sizes.select("key"))
        if not (n := sizes.count()):
            return rows if done is None else done.unionByName(rows)
        sizes = F.broadcast(sizes) if n <= BROADCAST else sizes
        rest = rows.join(sizes, "key", "left_anti").unionByName(rows.where("u = v").join(sizes, "key", "left_semi"))
        done = rest if done is None else done.unionByName(rest)
        middle = F.floor((F.col("u") + F.col("v")) / 2).cast("int")
        halves = F.array(F.struct(F.col("u"), middle.alias("v")), F.struct((middle + 1).alias("u"), F.col("v")))
        large = rows.where("u < v").join(sizes, "key", "left_semi").withColumn("half", F.explode(halves)).drop("u", "v").select("*", "half.*").drop("half")
        # A segment's own windows: from length - (bytes from the anchor on) to a bytes before it.
        most, least = F.col("a"), F.greatest(F.lit(0), length - (F.octet_length("bytes") - F.col("a")))
        large = large.where((F.greatest("u", least)) <= F.least("v", most))
        shared = F.substring("bytes", (F.col("a") - F.col("u") + 1).cast("int"), (F.col("u") + length - F.col("v")).cast("int"))
        rows = common.checkpointed(large.withColumn("key", F.xxhash64("key", "u", "v", shared)))


def covered(docs: DataFrame, length: int = 400, largest: int = LARGEST) -> DataFrame:
    """ROWS of docs (rid, text): a string of at least `length` bytes at `start` that also starts elsewhere, and its group."""
    schema = f"{ANCHORS}, group long, of long, start long, size long"
    met = docs.select("rid", "text").mapInArrow(_segments(length), schema).repartition("h").sortWithinPartitions("h", "s1", "s2")
    found = common.checkpointed(met.mapInArrow(_classes(length), f"{ROWS}, h long, lo long, hi long, p long, single boolean"))
    wanted = found.where("h is not null").groupBy("rid").agg(F.collect_list(F.struct("h", "lo", "hi", "p", "single")).alias("wanted"))
    texts = docs.select("rid", "text").mapInArrow(common.released(_packed), "rid long, packed binary")
    segments = texts.join(wanted.hint("shuffle_hash"), "rid").mapInArrow(_cut(length), "key long, rid long, p long, a long, single boolean, bytes binary")
    segments = _split(common.checkpointed(segments), length, largest)
    trees = segments.repartition("key").sortWithinPartitions("key").mapInArrow(_trees(length), ROWS)
    return found.where("h is null").select("group", "rid", "start", "size").union(trees)


def _whole(data: bytes, start: int, stop: int) -> tuple[int, int]:
    """The part of data[start:stop] that is whole UTF-8 characters."""
    inner = lambda i: i < len(data) and data[i] & 0xC0 == 0x80
    while start < stop and inner(start):
        start += 1
    while stop > start and inner(stop):
        stop -= 1
    return start, stop


def _runs(spans: list[dict], length: int) -> list[tuple[int, int]]:
    """(start, stop) of the maximal runs that the spans of a length cover."""
    runs: list[tuple[int, int]] = []
    for start, stop in sorted((s["start"], s["start"] + s["size"]) for s in spans if s["length"] == length):
        if runs and start <= runs[-1][1]:
            runs[-1] = (runs[-1][0], max(stop, runs[-1][1]))
        else:
            runs.append((start, stop))
    return runs


def _removed(columns: list[str], length: int, also: Sequence[int], characters: bool):
    """From rows (columns, packed, spans): the columns, n_bytes, n_removed, n_spans, the remaining bytes and n_covered of each in also."""
    counts = [f"n_covered_{n}" for n in also]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        for batch in common.batches(batches, 1 << 20):
            out: tuple[list, ...] = ([], [], [], [], *([] for _ in also))
            for packed, spans in zip(batch.column("packed").to_pylist(), batch.column("spans").to_pylist(), strict=True):
                data, spans = unpack(packed), spans or []
                runs = _runs(spans, length)
                if characters:
                    runs = [_whole(data, *x) for x in runs]
                pieces, at = [], 0
                for start, stop in runs:
                    pieces.append(data[at:start])
                    at = stop
                pieces.append(data[at:])
                covers = [sum(y - x for x, y in _runs(spans, n)) for n in also]
                for column, x in zip(out, (len(data), sum(y - x for x, y in runs), len(runs), b"".join(pieces), *covers), strict=True):
                    column.append(x)
            made = [pa.array(x, pa.binary() if k == 3 else pa.int64()) for k, x in enumerate(out)]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in columns], *made], names=[*columns, "n_bytes", "n_removed", "n_spans", "kept", *counts])

    return common.released(run)


def dedup(docs: DataFrame, *keep: str, length: int = 400, largest: int = LARGEST, characters: bool = False, also: Sequence[int] = ()) -> DataFrame:
    """The columns to keep of docs (those and text), with n_bytes, n_removed, n_spans and kept, the remaining bytes.

    characters: remove whole UTF-8 characters only, so that what remains is text. also: other lengths; for each n,
    n_covered_<n> counts the bytes that strings of n bytes cover which also start elsewhere; these stay. docs must give the same rows in the same
    partitions whenever it is read: a table or a checkpoint.
    """
    own = [f"__{i}" for i in range(len(keep))]
    rows = docs.select(F.monotonically_increasing_id().alias("rid"), *[F.col(c).alias(o) for c, o in zip(keep, own, strict=True)], "text")
    found = [covered(rows, n, largest).withColumn("length", F.lit(n)) for n in dict.fromkeys((length, *also))]
    spans = functools.reduce(DataFrame.union, found).groupBy("rid").agg(F.collect_set(F.struct("length", "start", "size")).alias("spans"))
    kinds = ", ".join(f"{o} {rows.schema[o].dataType.simpleString()}" for o in own)
    texts = rows.mapInArrow(common.released(_packed), f"rid long, {kinds}, packed binary")
    out = texts.join(spans.hint("shuffle_hash"), "rid", "left").select(*own, "packed", "spans")
    counts = "".join(f", n_covered_{n} long" for n in also)
    out = out.mapInArrow(_removed(own, length, also, characters), f"{kinds}, n_bytes long, n_removed long, n_spans long, kept binary{counts}")
    return out.withColumnsRenamed(dict(zip(own, keep, strict=True)))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = dedup(common.table(spark, sf_dir, "documents"), "doc_id", also=[PASSAGE])
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"), f"n_covered_{PASSAGE}")
