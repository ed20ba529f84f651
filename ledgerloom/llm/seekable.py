"""Operator 4 - token ids in seekable Zstandard files.

A file is a run of independent Zstandard frames, then a skippable frame with
the document index, then a skippable frame with the seek table (compressed and
decompressed size and checksum of every frame, frame count, descriptor, magic
number - the public seekable layout).  A frame holds whole documents as
little-endian unsigned 32-bit ids, so a reader seeks to the frames of the
requested documents, checks their checksums and decompresses nothing else.

Files follow each other in ascending doc_id order; each is written under a name
of its own attempt and counts only once the committed manifest lists it, so a
task that is lost and run again leaves no doubt.

Null and empty texts hold only the end id; a document longer than a frame's
aim has a frame of its own; equal rows are written once each; an empty table
gives an empty manifest; other columns are not read.  Rows with a null doc_id
are not written, as the document index has no key for them.
"""

from __future__ import annotations

import os
import struct
import uuid
import zlib

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import bound_batches, fresh_path, store, table
from .tokens import SLICE, BpeEncoder, slices

#: Fixed values of the public layout.
SKIPPABLE_INDEX, SKIPPABLE_SEEK_TABLE, SEEKABLE_MAGIC = 0x184D2A50, 0x184D2A5E, 0x8F92EAB1
CHECKSUM_FLAG = 0x80
#: A frame is closed once it holds so many ids.
FRAME_IDS = 32_768


class SeekableWriter:
    """Documents in, one seekable file out; holds one frame and the index."""

    def __init__(self, stream, frame_ids: int = FRAME_IDS, level: int = 3):
        self.stream, self.most = stream, 4 * frame_ids
        self.packer = zstandard.ZstdCompressor(level=level)
        self.frames: list[tuple[int, int, int]] = []
        self.index: list[tuple[int, int, int]] = []  # key, frame, ids
        self.open = bytearray()
        self.written = 0

    def add(self, key: int, ids: bytes) -> None:
        if self.open and len(self.open) + len(ids) > self.most:
            self._close_frame()
        self.index.append((key, len(self.frames), len(ids) // 4))
        self.open += ids

    def _close_frame(self) -> None:
        if self.open:
            raw = bytes(self.open)
            packed = self.packer.compress(raw)
            self.frames.append((len(packed), len(raw), xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF))
            self.stream.write(packed)
            self.written += len(packed)
            self.open.clear()

    def finish(self) -> int:
        self._close_frame()
        index = np.array(self.index, "<i8").reshape(-1, 3)
        body = zstandard.ZstdCompressor().compress(index.tobytes())
        self.stream.write(struct.pack("<II", SKIPPABLE_INDEX, len(body)) + body)
        table_ = b"".join(struct.pack("<III", *f) for f in self.frames)
        foot = struct.pack("<IBI", len(self.frames), CHECKSUM_FLAG, SEEKABLE_MAGIC)
        self.stream.write(struct.pack("<II", SKIPPABLE_SEEK_TABLE, len(table_) + 9) + table_ + foot)
        return self.written + 16 + len(body) + len(table_) + 9


class SeekableReader:
    def __init__(self, stream, size: int):
        self.stream = stream
        count, flags, magic = struct.unpack("<IBI", self._at(size - 9, 9))
        if magic != SEEKABLE_MAGIC or not flags & CHECKSUM_FLAG:
            raise ValueError("not a seekable file with checksums")
        body = 12 * count
        kind, length = struct.unpack("<II", self._at(size - 17 - body, 8))
        if kind != SKIPPABLE_SEEK_TABLE or length != body + 9:
            raise ValueError("damaged seek table")
        self.frames = np.frombuffer(self._at(size - 9 - body, body), "<u4").reshape(-1, 3).astype(np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.frames[:, 0])])
        kind, length = struct.unpack("<II", self._at(int(self.starts[-1]), 8))
        if kind != SKIPPABLE_INDEX:
            raise ValueError("damaged document index")
        raw = zstandard.ZstdDecompressor().decompress(self._at(int(self.starts[-1]) + 8, length))
        self.index = np.frombuffer(raw, "<i8").reshape(-1, 3)

    def _at(self, start: int, size: int) -> bytes:
        self.stream.seek(start)
        return self.stream.read(size)

    def frame(self, number: int) -> bytes:
        packed, size, check = self.frames[number].tolist()
        raw = zstandard.ZstdDecompressor().decompress(self._at(int(self.starts[number]), packed), max_output_size=size)
        if len(raw) != size or xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF != check:
            raise ValueError(f"frame {number} does not match its checksum")
        return raw

    def documents(self, keys=None):
        """(key, ids before it in the file, ids as bytes), of ``keys`` or all;
        one frame at a time, frames without a wanted document untouched."""
        wanted = None if keys is None else set(keys)
        number, raw, at, before = -1, b"", 0, 0
        for key, frame, size in self.index.tolist():
            if frame != number:
                number, raw, at = frame, b"", 0
            if wanted is None or key in wanted:
                raw = raw or self.frame(frame)
                yield key, before, raw[at : at + 4 * size]
            at, before = at + 4 * size, before + size


def write_token_files(docs: DataFrame, tokenizer: str, folder: str, end_id: int = 0) -> DataFrame:
    """Write files under ``folder``; returns their manifest (block, path, bytes,
    n_docs, n_tokens), committed as a table."""

    bound_batches(docs.sparkSession)
    def run(batches):
        from pyarrow import fs

        encoder = BpeEncoder.of(tokenizer)
        end, block = np.array([end_id], "<u4").tobytes(), TaskContext.get().partitionId()
        writer, n_docs, n_tokens = None, 0, 0
        for batch in batches:
            keys, texts = batch.column(0).to_pylist(), batch.column(1)
            for lo, hi in slices(texts, SLICE):
                for key, ids in zip(keys[lo:hi], encoder.encode(texts[lo:hi])):
                    if writer is None:
                        system, base = fs.FileSystem.from_uri(folder)
                        path = f"{base}/tokens-{block:06d}-{uuid.uuid4().hex}.zst"
                        stream = system.open_output_stream(path, compression=None)
                        writer = SeekableWriter(stream)
                    writer.add(key, ids + end)
                    n_docs, n_tokens = n_docs + 1, n_tokens + len(ids) // 4 + 1
        if writer is not None:
            size = writer.finish()
            stream.close()
            yield pa.RecordBatch.from_pydict(
                {"block": [block], "path": [f"{folder}/{os.path.basename(path)}"], "bytes": [size], "n_docs": [n_docs], "n_tokens": [n_tokens]}
            )

    spark = docs.sparkSession
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(folder)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(hadoop)
    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id is not null")
    ordered = ordered.repartitionByRange("doc_id").sortWithinPartitions("doc_id")
    return store(ordered.mapInArrow(run, "block long, path string, bytes long, n_docs long, n_tokens long"), "manifest")


def read_token_files(manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document in the files."""
    bound_batches(manifest.sparkSession)
    spark = manifest.sparkSession
    before = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    # one row a file: the manifest is small however many documents there are
    placed = manifest.select("path", "bytes", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)).alias("base"))
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)

    def run(batches):
        from pyarrow import fs

        for batch in batches:
            for path, size, base in zip(*(batch.column(i).to_pylist() for i in range(3))):
                system, local = fs.FileSystem.from_uri(path)
                with system.open_input_file(local) as stream:
                    rows = [(k, base + s, len(ids) // 4, zlib.crc32(ids)) for k, s, ids in SeekableReader(stream, size).documents()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x, pa.int64()) for x in zip(*rows)], names=["doc_id", "start", "n_tokens", "ids_crc32"]
                )

    return placed.repartition(tasks).mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    manifest = write_token_files(
        table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), fresh_path(spark, "token-files")
    )
    return read_token_files(manifest)
