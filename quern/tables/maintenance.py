"""Keeping tables in shape: compaction, expiry of snapshots, removal of orphan files."""

from __future__ import annotations

import datetime as dt
import re
from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, BooleanType, DataType, DateType, NumericType, TimestampNTZType, TimestampType

from quern.errors import AnalysisException, UnsupportedFeatureError
from quern.tables.format import DataFile, field_id
from quern.tables.store import Name, Table, TableStore, now_ms, sort_key

TARGET_FILE_BYTES, MIN_INPUT_FILES = 512 << 20, 5
#: Rows that one task sorts, in bytes of memory.
PIECE_BYTES = 128 << 20
#: Output files that are put together at a time, at most.
FILES_AT_ONCE = 64
_PART = re.compile(r"/part-(\d+)-[^/]*$")
ORPHAN_AGE_MS = 3 * 86_400_000


def _ms(moment) -> int:
    if isinstance(moment, int):
        return moment
    if isinstance(moment, str):
        moment = dt.datetime.fromisoformat(moment)
    return int((moment if moment.tzinfo else moment.replace(tzinfo=dt.UTC)).timestamp() * 1000)


def _unsorted(table: Table) -> int:
    """The id of the sort order without columns."""
    return next(o["id"] for o in table.metadata.sort_orders if not o["fields"])


def _has_tail(data_type: DataType) -> bool:
    """Whether a row holds values of the type outside its words."""
    return not isinstance(data_type, NumericType | BooleanType | DateType | TimestampType | TimestampNTZType)


class TableMaintenance:
    def __init__(self, store: TableStore, name: Name) -> None:
        self._store, self._name = store, name

    def compact(self, *, targetFileSizeBytes: int = TARGET_FILE_BYTES, minInputFiles: int = MIN_INPUT_FILES, sort: bool = True) -> dict[str, int]:
        """Rewrite each partition's small files as few of the target size; partitions with fewer than minInputFiles stay."""
        counts = {"rewritten_files": 0, "added_files": 0}

        def change(table):
            counts.update(rewritten_files=0, added_files=0)
            groups: dict[tuple, list] = {}
            for f in table.files():
                if f.size < targetFileSizeBytes * 3 // 4 or f.spec_id != table.metadata.spec_id:
                    groups.setdefault((f.spec_id, tuple(sorted(f.partition.items(), key=str))), []).append(f)
            chosen = [g for g in groups.values() if len(g) >= minInputFiles]
            if not chosen:
                return None
            files = [f for g in chosen for f in g]
            parts = sum(max(1, -(-sum(f.size for f in g) // targetFileSizeBytes)) for g in chosen)
            order = table.metadata.order_id
            if not sort:
                table.metadata.order_id = _unsorted(table)
            pieces = self._pieces(table, files) if table.metadata.order() and not table.metadata.spec() else 0
            if pieces > parts:
                written = self._write_pieces(table, files, pieces, parts)
            else:
                rows = table.read(files).repartition(parts) if not table.metadata.spec() else table.read(files)
                written = self._store.write_files(table, rows)
            table.metadata.order_id = order
            counts.update(rewritten_files=len(files), added_files=len(written))
            return self._store.append_snapshot(table.metadata, "replace", written, {f.path for f in files})

        self._store.commit(self._name, change)
        return counts

    def _pieces(self, table: Table, files: list[DataFile]) -> int:
        """How many tasks can sort the rows of some files within PIECE_BYTES each."""
        schema = table.metadata.schema()
        # A sorted row takes a word a column and about ten more, and the bytes of texts and nested values.
        size = sum(f.rows for f in files) * 8 * (len(schema) + 10)
        rows = self._store.scan(files, schema).toDF(*[f"__{i}" for i in range(len(schema))])
        long = [F.col(f"__{i}") if isinstance(f.dataType, BinaryType) else F.col(f"__{i}").cast("string") for i, f in enumerate(schema) if _has_tail(f.dataType)]
        if long:
            size += rows.agg(F.sum(sum((F.coalesce(F.octet_length(c), F.lit(0)).cast("long") for c in long), F.lit(0)))).first()[0] or 0
        return -(-size // PIECE_BYTES)

    def _write_pieces(self, table: Table, files: list[DataFile], pieces: int, parts: int) -> list[DataFile]:
        """The rows of some files as about `parts` new files, in the table's sort order within and between them.

        Ranges of the sort order are sorted and written as pieces, each by a task of its own; then each file is put
        together from its pieces in turn. So no task sorts a whole file, however large files are. Rows that are equal in the sort
        order are dealt by their places, so many of them don't meet in one piece.
        """
        store, schema = self._store, table.metadata.schema()
        at = {field_id(f): f"__{i}" for i, f in enumerate(schema)}
        rows = store.scan(files, schema, place=True).toDF(*at.values(), "__file", "__row").drop("__file")
        keys = [sort_key(F.col(at[i]), up, first) for i, up, first in table.metadata.order()]
        staged = store.write_files(table, rows.repartitionByRange(pieces, *keys, "__row").drop("__row"))
        order = table.metadata.order_id
        try:
            table.metadata.order_id = _unsorted(table)
            staged.sort(key=lambda f: (int(_PART.search(f.path)[1]), f.path))
            total, done = sum(f.size for f in staged), 0
            groups: dict[int, list[DataFile]] = {}
            for f in staged:
                groups.setdefault((2 * done + f.size) * parts // (2 * total), []).append(f)
                done += f.size

            def put_together(group: list[DataFile]) -> list[DataFile]:
                whole: DataFrame | None = None
                for f in group:
                    piece = store.scan([f], schema)
                    whole = piece if whole is None else whole.union(piece)
                return store.write_files(table, whole.coalesce(1))

            with ThreadPoolExecutor(max(1, min(FILES_AT_ONCE, store.spark.sparkContext.defaultParallelism))) as pool:
                # Each thread gets a copy of the job properties of its own.
                running = [pool.submit(inheritable_thread_target(put_together), group) for group in groups.values()]
                return [f for made in running for f in made.result()]
        finally:
            table.metadata.order_id = order
            for folder in {f.path.rpartition("/")[0] for f in staged}:
                store.files.delete(folder)

    def expireSnapshots(self, *, olderThan=None, retainLast: int | None = None, snapshotIds: list[int] | None = None) -> dict[str, int]:
        """Forget snapshots, never the current one, and delete the files that only they had."""
        if olderThan is None and retainLast is None and not snapshotIds:
            raise AnalysisException("expireSnapshots needs olderThan, retainLast or snapshotIds")
        if retainLast is not None and retainLast < 1:
            raise AnalysisException("retainLast is at least 1")
        counts = {"expired_snapshots": 0, "deleted_files": 0}
        dead: list[str] = []

        def change(table):
            m = table.metadata
            order = sorted(m.snapshots, key=lambda s: -s.timestamp_ms)
            if snapshotIds:
                if m.snapshot_id in snapshotIds:
                    raise AnalysisException("the current snapshot can't expire")
                gone = {s.snapshot_id for s in order if s.snapshot_id in set(snapshotIds)}
            else:
                kept = {s.snapshot_id for s in order[: retainLast or 1]} | {m.snapshot_id}
                limit = _ms(olderThan) if olderThan is not None else now_ms() + 1
                gone = {s.snapshot_id for s in order if s.snapshot_id not in kept and s.timestamp_ms < limit}
            if not gone:
                return None
            live = [s for s in m.snapshots if s.snapshot_id not in gone]
            manifests = {p for s in live for p in s.manifests}
            old = {p for s in m.snapshots if s.snapshot_id in gone for p in s.manifests} - manifests
            used = {f.path for f in self._store.read_manifests(sorted(manifests))}
            dead[:] = [f.path for f in self._store.read_manifests(sorted(old)) if f.path not in used] + sorted(old)
            m.snapshots = live
            for s in live:
                if s.parent_id in gone:
                    s.parent_id = None
            m.snapshot_log = [(ms, i) for ms, i in m.snapshot_log if i not in gone]
            counts.update(expired_snapshots=len(gone), deleted_files=len(dead))
            return m

        self._store.commit(self._name, change)
        for path in dead:
            self._store.files.delete(path)
        return counts

    def removeOrphanFiles(self, *, olderThan=None, dryRun: bool = True) -> list[str]:
        """Data and manifest files that no snapshot refers to, older than three days or olderThan; deleted unless dryRun."""
        m = self._store.load(self._name).metadata
        manifests = {p for s in m.snapshots for p in s.manifests}
        used = manifests | {f.path for f in self._store.read_manifests(sorted(manifests))}
        limit = _ms(olderThan) if olderThan is not None else now_ms() - ORPHAN_AGE_MS
        same = {_tail(p) for p in used}
        found = [p for p, _, ms in self._store.files.walk(m.location) if ms < limit and _tail(p) not in same and not p.endswith((".metadata.json", ".crc"))]
        if not dryRun:
            for path in found:
                self._store.files.delete(path)
        return found

    def rewriteManifests(self) -> None:
        raise UnsupportedFeatureError("rewriteManifests", "compact")


def _tail(path: str) -> str:
    return path.partition(":")[2].lstrip("/") or path.lstrip("/")
