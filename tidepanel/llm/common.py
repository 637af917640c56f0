"""Helpers of the operators in this subpackage."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile
import uuid
from collections.abc import Iterable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows that go to a Python worker at once, at most.
BATCH_ROWS, ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", 1000


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir.

    Only where the session names none and runs on one machine, as in tests, a temporary one is set.
    On a cluster without the setting nothing is written: executors would each see a folder of their own.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("tidepanel.shared.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        named = tempfile.mkdtemp(prefix="tidepanel-")
        spark.conf.set("tidepanel.shared.dir", named)
    return named.rstrip("/")


def temporary(spark: SparkSession, kind: str = "tidepanel") -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/{kind}-{uuid.uuid4().hex}"


def until_exit(spark: SparkSession, path: str) -> None:
    """Have the file system delete ``path`` when the driver's JVM ends."""
    of = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    of.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(of)


def materialize(df: DataFrame, **options: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back, which cuts its lineage.

    The written copy outlives executors: if one is lost, only the tasks that read it rerun. It
    goes when the driver ends.
    """
    spark = df.sparkSession
    path = temporary(spark)
    df.write.options(**options).parquet(path)
    until_exit(spark, path)
    return spark.read.schema(df.schema).parquet(path)


def ready(spark: SparkSession) -> SparkSession:
    """Let Python workers on this machine import this package, whatever folder they start in, and send them short batches.

    The batch length is a setting of the session: a larger one is lowered to ROWS and stays so.
    """
    root = str(Path(__file__).resolve().parents[2])
    known = spark.sparkContext.environment
    if root not in known.get("PYTHONPATH", "").split(":"):
        known["PYTHONPATH"] = ":".join(filter(None, [root, known.get("PYTHONPATH", "")]))
    # texts are long: fewer of them in a batch keep workers and their buffers small
    if int(spark.conf.get(BATCH_ROWS)) > ROWS:
        spark.conf.set(BATCH_ROWS, ROWS)
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def crc_fold(doc_id: Column, parts: int) -> Column:
    """crc32(doc_id as text) mod parts; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % F.lit(parts)


def lean(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pass batches on and, after the last, give memory back: idle Python workers stay alive and count."""
    try:
        yield from batches
    finally:
        release()


def release() -> None:
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # other C libraries have no such call
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def give_back(spark: SparkSession) -> None:
    """Have the driver, its JVM and its Python, give memory back.

    Its heap grows with the stages and tasks that it plans and stays so until a full collection; plans that Python
    has let go of go with it.
    """
    release()
    spark.sparkContext._jvm.System.gc()


def rows_by_key(batches: Iterable[pa.RecordBatch], key: list[str]) -> Iterator[tuple[tuple, pa.Table]]:
    """Groups of consecutive rows that share ``key``, from batches sorted by it."""
    held: list[pa.RecordBatch] = []
    held_key: tuple | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(k).to_pylist() for k in key]
        keys = list(zip(*columns, strict=True))
        first = 0
        for i in range(1, len(keys) + 1):
            if i == len(keys) or keys[i] != keys[first]:
                if held_key is not None and keys[first] != held_key:
                    yield held_key, pa.Table.from_batches(held)
                    held = []
                held_key = keys[first]
                held.append(batch.slice(first, i - first))
                first = i
    if held:
        yield held_key, pa.Table.from_batches(held)


def partitions(spark: SparkSession, least: int = 1) -> int:
    return max(least, int(spark.conf.get("spark.sql.shuffle.partitions")))
