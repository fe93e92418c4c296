"""What the operators share: reading, cutting lineage, folds and batches."""

from __future__ import annotations

import contextlib
import ctypes
import functools
import tempfile
import uuid
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The ASCII white space that separates words, as a regular expression class body.
SPACE = r"\x20\x09-\x0D"
#: Spark's setting that removes the shuffle files of a query when it has run.
SWEEP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def unused(base: str, *names: str) -> str:
    """A column's name from base that none of the names is, in any case."""
    taken, name = {n.lower() for n in names}, f"__{base}"
    while name.lower() in taken:
        name = f"_{name}"
    return name


def checkpoint_folder(spark: SparkSession) -> str:
    """The shared folder for cut lineages: the session's spark.checkpoint.dir.

    Only where that setting is absent and no folder was chosen one is made, in local mode alone: executors elsewhere
    couldn't read it.
    """
    context = spark.sparkContext
    own = context._jsc.sc().getCheckpointDir()
    if not context.getConf().get("spark.checkpoint.dir") and own.isEmpty():
        if not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="quern-checkpoint-"))
        own = context._jsc.sc().getCheckpointDir()
    return own.get()


@contextlib.contextmanager
def _swept(spark: SparkSession) -> Iterator[None]:
    """What runs inside gives its shuffle files back when it ends; else they stay until the driver collects garbage."""
    before = spark.conf.get(SWEEP)
    spark.conf.set(SWEEP, "true")
    try:
        yield
    finally:
        spark.conf.set(SWEEP, before)


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut df's lineage with a reliable checkpoint. Shuffle files of the way there go."""
    checkpoint_folder(df.sparkSession)
    with _swept(df.sparkSession):
        # A frame takes the setting along when it is made.
        return df.select("*").checkpoint(eager=True)


def _new_path(spark: SparkSession) -> str:
    """A new path in the checkpoint folder, whose files go when the application ends."""
    path = f"{checkpoint_folder(spark)}/quern_{uuid.uuid4().hex}"
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(place)
    return path


def written(df: DataFrame) -> DataFrame:
    """df written as Parquet to the checkpoint folder and read again."""
    path = _new_path(df.sparkSession)
    with _swept(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def bucketed(df: DataFrame, by: str) -> DataFrame:
    """df as a written table in the checkpoint folder, bucketed by a column, so that joins on it don't shuffle df again.

    Only its files stay, until the application ends.
    """
    spark = df.sparkSession
    name, path = f"quern_{uuid.uuid4().hex}", _new_path(spark)
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    with _swept(spark):
        df.write.format("parquet").option("path", path).option("compression", "zstd").bucketBy(buckets, by).saveAsTable(name)
    out = spark.table(name)
    out.schema  # noqa: B018  resolved, with its buckets, before the name goes
    spark.sql(f"DROP TABLE {name}")
    return out


def fold(doc_id: Column, folds: int) -> Column:
    """crc32 of doc_id's decimal text, modulo folds; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(folds))


def batches(rows: Iterator[pa.RecordBatch], most_bytes: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about most_bytes, one row at least."""
    for batch in rows:
        if batch.num_rows == 0:
            continue
        step = max(1, int(batch.num_rows * most_bytes / max(batch.nbytes, 1)))
        for at in range(0, batch.num_rows, step):
            yield batch.slice(at, step)


def released(run: Callable) -> Callable:
    """run (batches to batches), giving freed memory back to the machine at its end: workers stay between tasks."""

    @functools.wraps(run)
    def whole(rows):
        yield from run(rows)
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(OSError, AttributeError):  # not a GNU system
            ctypes.CDLL("libc.so.6").malloc_trim(0)

    return whole


def crc32(data: bytes) -> int:
    return zlib.crc32(data) & 0xFFFFFFFF
