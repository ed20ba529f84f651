"""Objects by key: keys of runs, and writing text or bytes under them."""

from __future__ import annotations

import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import ship_package, stored
from .record_store import Connector, opened

WRITTEN = "key string, size long, error string"


def run_key(area: str, run: Column | str, name: Column | str) -> Column:
    """``area/run/name`` as it is, extension included: ``staging/r1/ocr_text.json``.
    Null where a part is empty or holds a slash."""
    parts = [F.lit(area), *(F.col(p) if isinstance(p, str) else p for p in (run, name))]
    bad = F.lit(False)
    for p in parts:
        bad = bad | (F.coalesce(p, F.lit("")) == "") | p.contains("/") | p.isin(".", "..")
    return F.when(~bad, F.concat_ws("/", *parts))


def write_objects(objects: DataFrame, root: str, connector: Connector | None = None) -> DataFrame:
    """Write every row's ``content`` (text or bytes) to the file of its ``key``
    below ``root``; gives key, size and error.  A file appears whole or not at all;
    a task that runs again writes the same.  Of rows of one key the largest content
    is written.  Keys that are empty or lead out of the root, and null contents,
    are errors of their row."""
    spark = objects.sparkSession
    ship_package(spark)
    connector = connector or Connector()
    options = connector.options() | {"path": connector.root(root)}
    content = F.col("content").cast("binary").alias("content")
    once = objects.select("key", content).groupBy("key").agg(F.max("content").alias("content"))

    def run(batches):
        fs, top = opened(options)
        for batch in batches:
            keys, sizes, errors = batch.column("key").to_pylist(), [], []
            for key, data in zip(keys, batch.column("content").to_pylist()):
                error = None
                if not key or any(p in ("", ".", "..") for p in key.split("/")):
                    error = "no key below the root"
                elif data is None:
                    error = "no content"
                else:
                    path = f"{top}/{key}"
                    draft = f"{path.rsplit('/', 1)[0]}/.{uuid.uuid4().hex}"
                    try:
                        fs.create_dir(path.rsplit("/", 1)[0])
                        with fs.open_output_stream(draft) as f:
                            f.write(data)
                        fs.move(draft, path)
                    except OSError as e:
                        error = str(e)
                sizes.append(None if error else len(data))
                errors.append(error)
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(sizes, pa.int64()), pa.array(errors, pa.string())], names=["key", "size", "error"])

    return stored(once.mapInArrow(run, WRITTEN), "written-objects")
