"""Operator 6 - sharding by jump consistent hashing (law ``key``).

A stable 64-bit key and the shard count decide the shard: no ring table, no
state, and with one more shard rows move only into the new one.  Slots are
gapless within a shard: rows are dealt by key range, numbered inside each
range in one pass, and each range adds the counts of the ranges before it, so
no shard is ever gathered in one task.

Null keys count as key 0; null texts have size 1 and the crc of no bytes; equal
rows get slots of their own; an empty table gives no rows; other columns are
not read, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import bound_batches, store, table

_STEP = np.uint64(2862933555777941757)


def jump_hash(keys: np.ndarray, shards: int) -> np.ndarray:
    """Jump consistent hash of uint64 keys into ``shards`` (vectorised)."""
    key = keys.astype(np.uint64).copy()
    bucket = np.zeros(len(key), np.int64)
    jump = np.zeros(len(key), np.int64)
    live = np.arange(len(key))
    with np.errstate(over="ignore"):
        while len(live):
            bucket[live] = jump[live]
            key[live] = key[live] * _STEP + np.uint64(1)
            high = ((key[live] >> np.uint64(33)) + np.uint64(1)).astype(np.float64)
            jump[live] = ((bucket[live] + 1) * (float(1 << 31) / high)).astype(np.int64)
            live = live[jump[live] < shards]
    return bucket


def assign_shards(docs: DataFrame, shards: int = 8, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard."""
    bound_batches(docs.sparkSession)
    kind = docs.schema[key].dataType.typeName()
    stable = F.col(key).cast("long") if kind in ("long", "integer", "short", "byte") else F.xxhash64(key)
    rows = docs.select(
        F.col(key).alias("doc_id"),
        F.coalesce(stable, F.lit(0)).alias("stable"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce(F.col(text), F.lit("")).cast("binary")).alias("text_crc32"),
    )
    dealt = rows.repartitionByRange("stable", "text_crc32").sortWithinPartitions("stable", "text_crc32", "size")
    schema = pa.schema([("shard", pa.int32()), ("grown_shard", pa.int32()), ("block", pa.int32()), ("place", pa.int64())])

    def number(batches):
        block, taken = TaskContext.get().partitionId(), np.zeros(shards, np.int64)
        for batch in batches:
            keys = batch.column("stable").to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            shard, place = jump_hash(keys, shards), np.empty(len(keys), np.int64)
            for s in np.unique(shard):
                at = np.flatnonzero(shard == s)
                place[at] = taken[s] + np.arange(len(at))
                taken[s] += len(at)
            new = [shard.astype(np.int32), jump_hash(keys, shards + 1).astype(np.int32), np.full(len(keys), block, np.int32), place]
            kept = [batch.column(n) for n in ("doc_id", "size", "text_crc32")]
            yield pa.RecordBatch.from_arrays(
                kept + [pa.array(x) for x in new], names=["doc_id", "size", "text_crc32", *schema.names]
            )

    doc_type = docs.schema[key].dataType.simpleString()
    numbered = store(
        dealt.mapInArrow(number, f"doc_id {doc_type}, size long, text_crc32 long, shard int, grown_shard int, block int, place long"),
        "shards",
    )
    before = Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        numbered.groupBy("shard", "block").agg(F.count("*").alias("n"))
        .select("shard", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    )
    return numbered.join(offsets, ["shard", "block"]).select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard",
        (F.col("place") + F.col("base")).alias("slot"), "grown_shard",
    )


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign_shards(table(spark, sf_dir, "documents"), shards=8)


#: The query in SQL: crc32 by a table of bytes, jump hashing by recursion in
#: wide integers, slots by row number.
ORACLE = """
WITH RECURSIVE bit(i, v, step) AS (
  SELECT i, i, 0 FROM range(256) r(i)
  UNION ALL SELECT i, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END, step + 1 FROM bit WHERE step < 8
), crc_table AS (SELECT list(v ORDER BY i) AS t FROM bit WHERE step = 8),
rows_ AS (
  SELECT doc_id, coalesce(doc_id, 0) AS stable, CAST(octet_length(encode(coalesce(text, ''))) + 1 AS BIGINT) AS size,
    xor(list_reduce(list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda h: CAST('0x' || h AS BIGINT)),
      lambda c, x: xor(c >> 8, t[CAST(xor(c & 255, x) AS INT) + 1]), 4294967295), 4294967295) AS text_crc32
  FROM documents, crc_table
), jump(stable, n, key, b, j) AS (
  SELECT DISTINCT stable, n, (CAST(stable AS HUGEINT) + 18446744073709551616) % 18446744073709551616, CAST(0 AS BIGINT), CAST(0 AS BIGINT)
  FROM rows_, (VALUES (8), (9)) x(n)
  UNION ALL SELECT stable, n, next, j, CAST(floor((j + 1) * (2147483648.0::DOUBLE / CAST((next // 8589934592) + 1 AS DOUBLE))) AS BIGINT)
  FROM (SELECT *, (key * 2862933555777941757 + 1) % 18446744073709551616 AS next FROM jump WHERE j < n)
), shards AS (
  SELECT stable, CAST(max(b) FILTER (n = 8) AS INT) AS shard, CAST(max(b) FILTER (n = 9) AS INT) AS grown_shard FROM jump WHERE j >= n GROUP BY stable
)
SELECT doc_id, size, text_crc32, 'key' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY stable, text_crc32, size) - 1 AS slot, grown_shard
FROM rows_ JOIN shards USING (stable)
"""
