"""Helpers shared by the training-data operators: durable intermediate tables,
table loading, ASCII words and hashing."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import give_back, shared_dir, ship_package

#: The white space of every "word" contract here: blank and U+0009 to U+000D.
WORD_GAP = r"[\x20\x09-\x0D]+"
GOLDEN = np.uint64(0x9E3779B97F4A7C15)
#: Bytes of one Arrow batch, unless the session sets its own limit: a task holds
#: a batch in the JVM and again in Python, whatever the lengths of the texts.
BATCH_BYTES = 8 << 20
_BATCH_CONF = "spark.sql.execution.arrow.maxBytesPerBatch"


def bound_batches(spark: SparkSession) -> None:
    """What a session needs before an operator's Python code runs: this package on
    all executors, and Arrow batches limited by bytes where it does not say otherwise."""
    ship_package(spark)
    if _BATCH_CONF not in spark.conf.getAll:
        spark.conf.set(_BATCH_CONF, str(BATCH_BYTES))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One test table; only Spark's readers touch the path."""
    bound_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/ledgerloom/{name}-{uuid.uuid4().hex}"


def store(df: DataFrame, name: str, partition_by: tuple[str, ...] = ()) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: a plan cut that any
    executor can reread after another one is lost."""
    spark = df.sparkSession
    bound_batches(spark)
    path = fresh_path(spark, name)
    out = df.write
    if partition_by:
        out = out.partitionBy(*partition_by)
    out.parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back._ledgerloom_path = path
    return back


def release(*tables: DataFrame) -> None:
    """Delete stored tables that no later plan reads, and let Spark's cleaner
    remove the shuffle files of plans that nothing refers to any more."""
    spark = None
    for df in tables:
        path = getattr(df, "_ledgerloom_path", None)
        if path:
            spark = df.sparkSession
            jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
            jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jvm_path, True)
    if spark is not None:
        spark._jvm.java.lang.System.gc()


def slices_of(batches, rows: int = 1000):
    """Arrow batches in slices of so many rows, which bound what Python holds at
    once; after the last one the worker gives free memory back."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)
    give_back()


def remainder(doc_id: Column, divisor: int) -> Column:
    """crc32 of the id's decimal text, modulo ``divisor``."""
    return F.crc32(doc_id.cast("string").cast("binary")) % F.lit(divisor)


def mix(values: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (bijective), for uint64 arrays."""
    with np.errstate(over="ignore"):
        v = values ^ (values >> np.uint64(30))
        v = v * np.uint64(0xBF58476D1CE4E5B9)
        v ^= v >> np.uint64(27)
        v = v * np.uint64(0x94D049BB133111EB)
        return v ^ (v >> np.uint64(31))
