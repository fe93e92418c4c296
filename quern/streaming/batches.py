"""Finite results in Arrow batches: what streaming means here. There is no unbounded stream."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame


def batches(frame: DataFrame, rows: int) -> Iterator[pa.RecordBatch]:
    """frame's rows in order, in batches of at most `rows`, a partition at a time.

    Executors write Arrow's stream format into one binary row for each batch; the driver fetches a partition while the
    caller works on the one before.
    """
    if rows < 1:
        raise ValueError("a batch has one row at least")

    def pack(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for at in range(0, part.num_rows, rows):
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, part.schema) as writer:
                    writer.write_batch(part.slice(at, rows))
                yield pa.RecordBatch.from_arrays([pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["batch"])

    for row in frame.mapInArrow(pack, "batch binary").toLocalIterator(prefetchPartitions=True):
        with pa.ipc.open_stream(row["batch"]) as stream:
            yield from stream
