"""A batch of files with failures captured file by file.

``handle`` turns the name and bytes of one file into the fields of a record.  It
runs inside Spark tasks; what it raises, or a run beyond its time limit, becomes
a row with the error instead of failing the task.  Failed files, and only these,
run again in later passes; what has succeeded is written once and read again, so
a lost executor repeats its own files alone.  The time limit interrupts Python
code; a call that never returns to Python is left to Spark's own task limits.
Spark's file source gives no row for an empty file, so nothing is told of one.
"""

from __future__ import annotations

import signal
import threading
import time
import traceback
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..plans.reports import batch_outcome
from ..session import ship_package, stored
from ..sources.record_store import RecordStore
from .incremental import RuleBook

Handle = Callable[[str, bytes], dict]


class OverTime(Exception):
    """A file took longer than its limit."""


class limited:
    """Raises ``OverTime`` in the block after so many seconds; only a process'
    main thread can be interrupted, elsewhere the block just runs."""

    def __init__(self, seconds: float):
        self.seconds = seconds if threading.current_thread() is threading.main_thread() else 0

    def __enter__(self) -> None:
        if self.seconds:

            def stop(*_):
                raise OverTime(f"more than {self.seconds:g} seconds")

            self.before = signal.signal(signal.SIGALRM, stop)
            signal.setitimer(signal.ITIMER_REAL, self.seconds)

    def __exit__(self, *_) -> None:
        if self.seconds:
            signal.setitimer(signal.ITIMER_REAL, 0)
            signal.signal(signal.SIGALRM, self.before)


def _pass(files: DataFrame, handle: Handle, schema: T.StructType, limit: float, attempt: int) -> DataFrame:
    """path, record (null if it failed), error, attempts, seconds of each file."""
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in schema])  # a failed file has none of them
    record = to_arrow_schema(schema)
    out = pa.schema([("path", pa.string()), ("record", pa.struct(list(record))), ("error", pa.string()), ("attempts", pa.int32()), ("seconds", pa.float64())])

    def run(batches):
        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist()):
                began, found, error = time.monotonic(), None, None
                try:
                    with limited(limit):
                        found = handle(path, content)
                    found = {f.name: found.get(f.name) for f in record}
                    pa.array([found], out.field("record").type)  # a field of the wrong kind is an error of its file
                except Exception as e:
                    where = traceback.extract_tb(e.__traceback__)
                    found, error = None, f"{type(e).__name__}: {e} ({where[-1].name}, line {where[-1].lineno})"
                row = {"path": path, "record": found, "error": error, "attempts": attempt, "seconds": time.monotonic() - began}
                yield pa.RecordBatch.from_pylist([row], schema=out)

    kinds = T.StructType([T.StructField("path", T.StringType()), T.StructField("record", schema), T.StructField("error", T.StringType()), T.StructField("attempts", T.IntegerType()), T.StructField("seconds", T.DoubleType())])
    return files.select("path", "content").mapInArrow(run, kinds)


def run_files(files: DataFrame, handle: Handle, schema: T.StructType, limit: float = 300, attempts: int = 2) -> DataFrame:
    """path, record, error, attempts, seconds: one row a file, from its last
    attempt; ``seconds`` is the time of all of them.  ``files`` has path and content."""
    ship_package(files.sparkSession)
    passes, waiting = [], files
    for attempt in range(1, attempts + 1):
        passes.append(stored(_pass(waiting, handle, schema, limit, attempt), "file-results"))
        failed = passes[-1].where("error IS NOT NULL").select("path")
        if attempt == attempts or failed.isEmpty():
            break
        waiting = files.join(failed, "path", "left_semi")
    every = reduce(DataFrame.unionByName, passes)
    return every.groupBy("path").agg(F.max_by(F.struct("record", "error", "attempts"), "attempts").alias("r"), F.sum("seconds").alias("seconds")).select("path", "r.*", "seconds")


@dataclass
class Outcome:
    """``files``: a row a file; ``summary``: runs, successes, failures and seconds a
    document; what the rule step raised, or None."""

    files: DataFrame
    summary: DataFrame
    rules_error: str | None


def run_batch(
    files: DataFrame, handle: Handle, records: RecordStore, book: RuleBook | None = None, dead_letters: str | None = None, limit: float = 300, attempts: int = 2,
) -> Outcome:
    """Every file to a record, the records into the store, what failed to
    ``dead_letters`` as JSON lines, then the rules over what is stored.  A file
    whose record lacks a part of its key has failed."""
    done = run_files(files, handle, records.schema, limit, attempts)
    lacking = F.concat_ws(", ", *(F.when(F.coalesce(F.col(f"record.{k}"), F.lit("")) == "", F.lit(k)) for k in records.keys))
    error = F.coalesce("error", F.when(lacking != "", F.concat(F.lit("missing "), lacking)))
    done = stored(done.withColumns({"error": error, "record": F.when(error.isNull(), F.col("record"))}), "file-results")
    change = records.upsert(done.where("error IS NULL").select("record.*"))
    if dead_letters:
        done.where("error IS NOT NULL").select("path", "error", "attempts", "seconds").write.mode("append").json(dead_letters)
    rules_error = None
    if book is not None:
        try:
            book.apply(change)
        except Exception as e:  # the records are stored; the next batch judges them
            rules_error = f"{type(e).__name__}: {e}"
    summary = batch_outcome(done.select(F.col("error").isNull().alias("succeeded"), "seconds"))
    return Outcome(done.select("path", F.col("error").isNull().alias("succeeded"), "error", "attempts", "seconds"), summary, rules_error)
