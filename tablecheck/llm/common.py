"""What the operators share: written intermediate tables, row identity, Arrow helpers."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from functools import wraps

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# the white space of all contracts: [\x20\x09-\x0D]
SPACE = b" \t\n\x0b\x0c\r"
SPACE_CLASS = r"[\x20\x09-\x0D]"
WORD_CLASS = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

NO_ID = (1 << 63) - 1  # a null doc_id sorts after all others
BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"
SMALL_BATCH = "4m"  # Spark's own bound is 64 MB


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """A folder that driver and executors share: spark.checkpoint.dir, else one in the warehouse.

    On a cluster a warehouse on the driver's own disk is refused, as executors do not see it.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = f"{spark.conf.get('spark.sql.warehouse.dir')}/work"
        own_disk = base.startswith(("file:", "/"))
        if own_disk and not spark.sparkContext.master.startswith("local"):
            raise ValueError("Set spark.checkpoint.dir to a folder all executors can reach.")
    return f"{base.rstrip('/')}/llm-{uuid.uuid4().hex}"


def written(frame: DataFrame) -> DataFrame:
    """The same rows as a table in the shared folder: lineage ends here and lost executors cost nothing."""
    spark, path = frame.sparkSession, shared_folder(frame.sparkSession)
    frame.write.parquet(path)
    return spark.read.schema(frame.schema).parquet(path)


def drop_written(frame: DataFrame) -> None:
    """Remove a table made by ``written`` once nothing reads it any more."""
    spark = frame.sparkSession
    for path in {f.rsplit("/", 1)[0] for f in frame.inputFiles()}:
        if "/llm-" in path:
            place = spark._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def identity(doc_id: str = "doc_id", text: str = "text") -> list[Column]:
    """``_id`` (null last) and ``_tag``: rows that agree in both have the same doc_id and text."""
    return [
        F.coalesce(F.col(doc_id).cast("long"), F.lit(NO_ID)).alias("_id"),
        F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("_tag"),
    ]


def small_batches(frame: DataFrame) -> DataFrame:
    """The same frame; from now on its session sends Python small batches, unless the caller has set a bound.

    A batch is held several times over, by the executor's buffers and by the worker, for each task at once.
    """
    conf = frame.sparkSession.conf
    if conf.get(BATCH_BYTES, None) is None:
        conf.set(BATCH_BYTES, SMALL_BATCH)
    return frame


def released(make: Callable[..., Iterator[pa.RecordBatch]]) -> Callable[..., Iterator[pa.RecordBatch]]:
    """For what tasks run on batches: memory of freed batches is given back after each batch and at the end.

    Arrow keeps it else, also in a worker that waits for its next task.
    """

    @wraps(make)
    def run(*args, **options):
        pool = pa.default_memory_pool()
        try:
            for batch in make(*args, **options):
                yield batch
                del batch
                pool.release_unused()
        finally:
            pool.release_unused()

    return run


def texts(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a text column; null is empty."""
    return [b"" if x is None else x for x in column.cast(pa.binary()).to_pylist()]


def code_points(data: bytes) -> int:
    return len(data) if data.isascii() else len(data.decode())
