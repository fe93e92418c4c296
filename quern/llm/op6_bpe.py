"""Byte-level BPE: DuckDB recursive queries per partition.

A task cuts its texts into words by the public pattern. Words it hasn't met go to DuckDB in lots: token-position rows
of every word join the merge table; each round contracts the leftmost pair of least rank in each word; a word stops
when none of its pairs can merge. Ordered aggregation then gives a word's ids and, through the vocabulary, the bytes
they decode to. A text's ids are those of its words in turn. Words and their ids are remembered by a worker in a cache
of bounded size. Nothing is shuffled, and a lost task is simply run again.

Defined results: a null text is the empty text (no ids, no bytes); repeated rows give repeated results; an empty table
gives no rows; extra columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from quern.llm import common

#: Words that a worker remembers, of at most CACHED_LENGTH characters; longer ones are encoded whenever they occur.
CACHED_WORDS, CACHED_LENGTH = 500_000, 32
#: Bytes of words in one recursive query, unless a single word is longer.
LOT_BYTES = 500_000

#: One contraction a round makes the recursive query quadratic in a word's length, so a longer word, such as a run of
#: thousands of letters, goes to `contract_long`, which does the same contractions from a heap.
LONG_WORD = 512

#: `found` holds a pair's rank above its position: the least is the leftmost pair of least rank.
CONTRACT = """
with recursive state(w, pos, tok, round) as (
  select w, pos, tok, 0 from seed
  union all
  (with pairs as (
     select w, pos, tok, round, lead(tok) over near as after, lag(pos) over near as before
     from state window near as (partition by w order by pos)),
   ranked as (
     select pairs.*, (merges.merged::bigint << 32) | pos as found
     from pairs left join merges on merges.l = tok and merges.r = after),
   best as (select w, min(found) & 4294967295 as spot, (min(found) >> 32)::int as merged
            from ranked group by w having min(found) is not null)
   select w, pos, case when pos = spot then merged else tok end, round + 1
   from ranked join best using (w) where before is distinct from spot))
select w, list(tok order by pos) as ids, list(piece order by pos) as pieces
from (select *, max(round) over (partition by w) as last from state) join vocabulary using (tok)
where round = last group by w order by w"""


class Bpe:
    """Ranks read from a vocabulary file, and a DuckDB connection that holds the merge table."""

    def __init__(self, path: str) -> None:
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.pieces = {rank: token for token, rank in self.ranks.items()}
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": "300MB"})
        parts = [
            (self.ranks[token[:i]], self.ranks[token[i:]], rank)
            for token, rank in self.ranks.items()
            for i in range(1, len(token))
            if token[:i] in self.ranks and token[i:] in self.ranks
        ]
        columns = list(zip(*parts, strict=True)) if parts else [(), (), ()]
        merges = pa.table([pa.array(x, pa.int32()) for x in columns], names=["l", "r", "merged"])
        vocabulary = pa.table({"tok": pa.array(self.ranks.values(), pa.int32()), "piece": pa.array(self.ranks, pa.binary())})
        for name, rows in (("merges", merges), ("vocabulary", vocabulary)):
            self.db.register("rows_in", rows)
            self.db.execute(f"create table {name} as select * from rows_in")
            self.db.unregister("rows_in")
        self.of_byte = np.array([self.ranks.get(bytes([i]), -1) for i in range(256)], np.int32)

    def words(self, words: list[bytes]) -> Iterator[tuple[list[int], bytes]]:
        """(ids, decoded bytes) of each word, in order."""
        at = 0
        while at < len(words):
            lot, size = [], 0
            while at < len(words) and (not lot or size + len(words[at]) <= LOT_BYTES):
                lot.append(words[at])
                size += len(words[at])
                at += 1
            yield from self._lot(lot)

    def _decoded(self, ids: list[int]) -> tuple[list[int], bytes]:
        return ids, b"".join([self.pieces[i] for i in ids])

    def _lot(self, words: list[bytes]) -> Iterator[tuple[list[int], bytes]]:
        found: list[tuple[list[int], bytes] | None] = [self._decoded([r]) if (r := self.ranks.get(w)) is not None else None for w in words]
        for i, word in enumerate(words):
            if found[i] is None and len(word) > LONG_WORD:
                found[i] = self._decoded([self.ranks[x] for x in contract_long(word, self.ranks)])
        rest = [i for i, x in enumerate(found) if x is None]
        if rest:
            lengths = np.array([len(words[i]) for i in rest], np.int64)
            data = np.frombuffer(b"".join(words[i] for i in rest), np.uint8)
            starts = np.repeat(np.cumsum(lengths) - lengths, lengths)
            seed = {"w": np.repeat(np.array(rest, np.int32), lengths), "pos": (np.arange(len(data)) - starts).astype(np.int32), "tok": self.of_byte[data]}
            self.db.register("seed", pa.table(seed))
            for w, ids, pieces in self.db.sql(CONTRACT).fetchall():
                found[w] = (ids, b"".join(pieces))
            self.db.unregister("seed")
        yield from found  # type: ignore[misc]


def contract_long(word: bytes, ranks: dict[bytes, int]) -> list[bytes]:
    """The pieces of a word after contracting its leftmost pair of least rank until none is left."""
    pieces: list[bytes] = [word[i : i + 1] for i in range(len(word))]
    after, before = list(range(1, len(word) + 1)), list(range(-1, len(word) - 1))
    heap = [(r, i, word[i : i + 2]) for i in range(len(word) - 1) if (r := ranks.get(word[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, both = heapq.heappop(heap)
        j = after[i] if pieces[i] else len(word)
        if j >= len(word) or pieces[i] + pieces[j] != both:
            continue
        pieces[i], pieces[j], after[i] = both, b"", after[j]
        if after[i] < len(word):
            before[after[i]] = i
        for a, b in ((before[i], i), (i, after[i])):
            if a >= 0 and b < len(word) and (r := ranks.get(pieces[a] + pieces[b])) is not None:
                heapq.heappush(heap, (r, a, pieces[a] + pieces[b]))
    return [x for x in pieces if x]


class Cache:
    """The words met last, CACHED_WORDS to twice as many: word -> (ids in decimal joined by spaces, decoded bytes)."""

    def __init__(self) -> None:
        self.young: dict[bytes, tuple[bytes, bytes] | bytes] = {}
        self.old: dict[bytes, tuple[bytes, bytes] | bytes] = {}

    def put(self, word: bytes, found: tuple[bytes, bytes]) -> None:
        if len(self.young) >= CACHED_WORDS:
            self.old, self.young = self.young, {}
        # Where decoding gives the word back, it is kept once.
        self.young[word] = found[0] if found[1] == word else found

    def get(self, word: bytes) -> tuple[bytes, bytes] | None:
        if (got := self.young.get(word)) is None:
            if (got := self.old.get(word)) is None:
                return None
            if len(self.young) < CACHED_WORDS:
                self.young[word] = got
        return (got, word) if isinstance(got, bytes) else got


_loaded: dict[str, tuple[Bpe, Cache]] = {}


def _worker(path: str) -> tuple[Bpe, Cache]:
    if path not in _loaded:
        _loaded[path] = (Bpe(path), Cache())
    return _loaded[path]


def encode(texts: list[str], path: str, pattern: regex.Pattern) -> Iterator[tuple[bytes, int, bytes]]:
    """(ids in decimal joined by spaces, their number, decoded bytes) of each text."""
    bpe, cache = _worker(path)
    split = [pattern.findall(t) for t in texts]
    ids_of: dict[str, bytes] = {}
    decoded_of: dict[str, bytes] = {}
    new: list[str] = []
    for word in dict.fromkeys(w for words in split for w in words):
        if (got := cache.get(word.encode())) is None:
            new.append(word)
        else:
            ids_of[word], decoded_of[word] = got
    for word, (ids, decoded) in zip(new, bpe.words([w.encode() for w in new]), strict=True):
        found = (" ".join(map(str, ids)).encode(), decoded)
        ids_of[word], decoded_of[word] = found
        if len(word) <= CACHED_LENGTH:
            cache.put(word.encode(), found)
    for words in split:
        ids = b" ".join([ids_of[w] for w in words])
        yield ids, ids.count(b" ") + 1 if words else 0, b"".join([decoded_of[w] for w in words])


def round_trip(docs: DataFrame, vocabulary: str, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of each row of docs (doc_id, text)."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut = regex.compile(pattern)
        for batch in common.batches(rows, 8 << 20):
            texts = ["" if t is None else t for t in batch.column("text").to_pylist()]
            n, ids_sha, decoded_sha = [], [], []
            for ids, count, decoded in encode(texts, vocabulary, cut):
                n.append(count)
                ids_sha.append(hashlib.sha256(ids).hexdigest())
                decoded_sha.append(hashlib.sha256(decoded).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(decoded_sha, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(common.table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"))
