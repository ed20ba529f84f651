"""Session helpers: what every executor needs before Python code runs there."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
import zipfile
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


def ship_package(spark: SparkSession) -> None:
    """Give the Python workers this package, once per Spark context.

    Spark serves the archive from the driver, so executors that start later
    (after one was lost) fetch it as well.
    """
    context = spark.sparkContext
    if getattr(context, "_ledgerloom_shipped", False):
        return
    root = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="ledgerloom-")) / "ledgerloom.zip"
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as out:
        for path in sorted(root.rglob("*.py")):
            out.write(path, f"{root.name}/{path.relative_to(root)}")
    context.addPyFile(str(archive))
    context._ledgerloom_shipped = True


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder (``spark.checkpoint.dir``).

    Where none is named, a folder of this machine is made once and set, but only
    if all of Spark runs here; on a cluster that is an error, since executors
    would write where nobody reads.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(f"file://{tempfile.mkdtemp(prefix='ledgerloom-')}")
        found = spark.sparkContext.getCheckpointDir()
    # a path without a scheme belongs to the cluster's default file system
    path = spark._jvm.org.apache.hadoop.fs.Path(found)
    full = path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString().rstrip("/")
    return f"file://{full[5:]}" if full.startswith("file:/") and not full.startswith("file://") else full


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back: computed once, and any
    executor can reread it after another one is lost."""
    path = f"{shared_dir(df.sparkSession)}/ledgerloom/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    back = df.sparkSession.read.schema(df.schema).parquet(path)
    back._ledgerloom_path = path
    return back


def release(*tables: DataFrame) -> None:
    """Delete stored tables that no later plan reads."""
    for df in tables:
        path = getattr(df, "_ledgerloom_path", None)
        if path:
            jvm_path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            jvm_path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(jvm_path, True)


def give_back() -> None:
    """Return a worker's free memory to the system: Spark keeps the worker for
    later tasks, and what its allocators hold would count beside theirs."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # only some C libraries have it
    if trim is not None:
        trim(0)
