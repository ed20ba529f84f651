"""What a task of the record store holds and reads is bounded."""

import json
import time

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import types as T

from ledgerloom.operators.incremental import _results_schema
from ledgerloom.schemas import KEY
from ledgerloom.sources.record_store import FilePart, RecordReader, RecordWriter


def test_reading_a_leaf_holds_a_row_group_at_a_time(tmp_path):
    schema = pa.schema([*((k, pa.string()) for k in KEY), ("v", pa.float64())])
    table = T.StructType([*(T.StructField(k, T.StringType()) for k in KEY), T.StructField("v", T.DoubleType())])
    options = {"path": f"file://{tmp_path}", "schema": table.json(), "keys": json.dumps(KEY)}
    rng = np.random.default_rng(1)
    with pq.ParquetWriter(f"{tmp_path}/a.parquet", schema) as out:
        for i in range(60):
            columns = [[f"e{i}"] * 20_000, [f"t{j}" for j in range(20_000)], [f"{1990 + i}"] * 20_000, rng.random(20_000)]
            out.write_table(pa.table(columns, schema=schema))
    for wanted, rows in ({}, 1_200_000), ({"tax_year": {"1995", "2040"}}, 40_000):
        reader = RecordReader(options)
        reader.wanted = wanted
        before, most, found = pa.total_allocated_bytes(), 0, 0
        for batch in reader.read(FilePart(["a.parquet"])):
            time.sleep(0.001)
            most, found = max(most, pa.total_allocated_bytes() - before), found + batch.num_rows
        assert found == rows
        assert most < 6_000_000


def test_a_task_reads_a_bounded_number_of_rows(monkeypatch):
    files = [{"path": str(i), "rows": 400_000, "bytes": 1000} for i in range(6)]
    monkeypatch.setattr(RecordReader, "files", lambda self: files)
    assert [p.paths for p in RecordReader({}).partitions()] == [["0", "1"], ["2", "3"], ["4", "5"]]


def test_a_leaf_of_rule_results_takes_no_more_memory_when_it_grows(tmp_path):
    """incremental_rules: a rule's results of one partnership and year lie in one leaf, whatever their number."""
    kinds = _results_schema()
    schema = pa.schema([*((f.name, {"boolean": pa.bool_(), "double": pa.float64()}.get(f.dataType.typeName(), pa.string())) for f in kinds), ("bucket", pa.int32()), ("part", pa.int32())])
    fixed = {"rule_id": "A3", "category": "A", "severity": "warning", "passed": False, "partnership_ein": "e", "tax_year": "1995", "detail": "interest_income", "threshold": 0.1, "bucket": 0, "part": 0}
    rng = np.random.default_rng(1)

    def batches(n):
        for i in range(n):
            own = {"partner_tin": [f"t{i}-{j}" for j in range(10_000)], "observed": rng.random(10_000)}
            yield pa.RecordBatch.from_pydict({f.name: own.get(f.name, [fixed.get(f.name)] * 10_000) for f in schema}, schema=schema)

    def most(found):
        before, held, rows = pa.total_allocated_bytes(), 0, 0
        for batch in found:
            time.sleep(0.001)
            held, rows = max(held, pa.total_allocated_bytes() - before), rows + batch.num_rows
        return held, rows

    written, read = [], []
    for n in (10, 60):
        options = {"path": f"file://{tmp_path}/{n}", "schema": kinds.json(), "keys": json.dumps(["partnership_ein", "tax_year", "tax_year"])}
        before, held = pa.total_allocated_bytes(), []

        def watched(n=n, before=before, held=held):
            for batch in batches(n):
                held.append(pa.total_allocated_bytes() - before)
                yield batch

        done = RecordWriter(options).write(watched()).files
        assert [f["rows"] for f in done] == [10_000 * n]
        written.append(max(held))
        held, rows = most(RecordReader(options).read(FilePart([done[0]["path"]])))
        assert rows == 10_000 * n
        read.append(held)
    assert written[1] < 1.5 * written[0] + 1_000_000 and read[1] < 1.5 * read[0] + 1_000_000
