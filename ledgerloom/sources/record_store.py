"""The record table as a Spark data source, ``ledger_records``, and other tables
of its kind.

A table has three key columns, for records (ein, tin, year).  Files lie in leaves: bucket ``crc32(ein) mod n`` and, inside it, part
``crc32(tin) mod p``, where p is the bucket's own number of parts.  All records
of a partnership share a bucket and all years of a partner a leaf; a partnership
that holds much of the table gets a bucket of many parts.  Rows of a file are
sorted by year, so a filter on ``tax_year`` skips whole files by their range and
row groups by their statistics; one on ``partnership_ein`` (and ``partner_tin``)
leaves the files of its bucket (and leaf).

A write puts its files into a folder of its own and then publishes a manifest,
the list of all files of a version.  Manifests have numbers; one is published by
giving a finished draft its name, which fails where the name is taken (a hard
link locally, a rename on HDFS).  So readers see a version whole or not at all,
of two writers from one version the second gets an error and its files are
removed, and a crash before the manifest leaves only a folder that nothing names
(``remove_orphans``).  Object stores give no such step: there a connector must
say ``single_writer``.

Number of buckets: from the size of the first write; doubled (which rewrites the
table) once leaves would hold four times ``LEAF_BYTES`` on average.  Number of
parts: doubled for a bucket whose leaves hold twice ``LEAF_BYTES``.
"""

from __future__ import annotations

import json
import os
import time
import uuid
import zlib
from collections.abc import Iterator, Mapping
from dataclasses import dataclass, field

import pyarrow as pa
import pyarrow.dataset as ds
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualNullSafe, EqualTo, Filter, In, InputPartition, IsNotNull, WriterCommitMessage

from ..schemas import KEY, TABLE
from ..session import give_back, release, ship_package, stored

FORMAT = "ledger_records"
LEAF_BYTES = 128 << 20
#: Bytes and rows of files that one task reads.
READ_BYTES, READ_ROWS = 64 << 20, 1_000_000
#: Bytes a record takes before any file tells.
_ROW_BYTES = 150
#: Rows of a row group, the unit that statistics skip.
ROW_GROUP = 50_000
#: Versions whose files are kept: readers of the one before go on.
KEPT_VERSIONS = 2


@dataclass(frozen=True)
class Connector:
    """Where a store lies and how to reach it, from settings with defaults."""

    bucket: str = ""
    endpoint: str = ""
    region: str = "us-east-1"
    access_key: str = ""
    secret_key: str = ""
    single_writer: bool = False

    @classmethod
    def from_settings(cls, settings: Mapping[str, str] = os.environ, prefix: str = "LEDGERLOOM_STORE_") -> Connector:
        get = lambda name, default="": settings.get(prefix + name) or default
        return cls(get("BUCKET"), get("ENDPOINT"), get("REGION", cls.region), get("ACCESS_KEY"), get("SECRET_KEY"), get("SINGLE_WRITER").lower() == "true")

    def root(self, path: str) -> str:
        """``path`` in the bucket; without one, a path of the default file system."""
        return f"s3a://{self.bucket}/{path.strip('/')}" if self.bucket else path

    def hadoop_conf(self) -> dict[str, str]:
        """Settings under which Spark's own readers and writers reach the bucket."""
        if not self.bucket:
            return {}
        conf = {"fs.s3a.endpoint.region": self.region, "fs.s3a.path.style.access": "true"}
        found = {"fs.s3a.endpoint": self.endpoint, "fs.s3a.access.key": self.access_key, "fs.s3a.secret.key": self.secret_key}
        return conf | {k: v for k, v in found.items() if v}

    def options(self) -> dict[str, str]:
        """Options of the data source."""
        found = {"endpoint": self.endpoint, "region": self.region, "access_key": self.access_key, "secret_key": self.secret_key}
        return {k: v for k, v in found.items() if v} | {"single_writer": str(self.single_writer).lower()}


def opened(options: Mapping[str, str]) -> tuple[pafs.FileSystem, str]:
    """The file system and path of the option ``path``."""
    path = options["path"].rstrip("/")
    scheme, _, rest = path.partition("://")
    if scheme in ("s3", "s3a"):
        more = {"access_key": options.get("access_key"), "secret_key": options.get("secret_key"), "endpoint_override": options.get("endpoint"), "region": options.get("region")}
        return pafs.S3FileSystem(**{k: v for k, v in more.items() if v}), rest
    return pafs.FileSystem.from_uri(path if rest else f"file://{path}")


@dataclass
class Manifest:
    """A version: parts of every bucket, and files as dicts with bucket, part,
    path, rows, bytes, first and last (the years)."""

    version: int = 0
    parts: list[int] = field(default_factory=list)
    files: list[dict] = field(default_factory=list)

    def leaves(self) -> dict[tuple[int, int], int]:
        """Bytes of every leaf that has files."""
        found: dict[tuple[int, int], int] = {}
        for f in self.files:
            found[f["bucket"], f["part"]] = found.get((f["bucket"], f["part"]), 0) + f["bytes"]
        return found


class Folder:
    """The files of one store, as its drivers and tasks see them."""

    def __init__(self, options: Mapping[str, str]):
        self.fs, self.root = opened(options)
        self.single_writer = options.get("single_writer", "false").lower() == "true"

    def names(self, folder: str) -> list[pafs.FileInfo]:
        return self.fs.get_file_info(pafs.FileSelector(f"{self.root}/{folder}", allow_not_found=True))

    def versions(self) -> list[int]:
        return sorted(int(f.base_name[:-5]) for f in self.names("versions") if f.base_name.endswith(".json"))

    def manifest(self, version: int | None = None) -> Manifest:
        if version is None:
            version = (self.versions() or [0])[-1]
        if not version:
            return Manifest()
        with self.fs.open_input_stream(f"{self.root}/versions/{version:012d}.json") as f:
            return Manifest(version, **json.loads(f.read()))

    def publish(self, manifest: Manifest) -> None:
        draft, final = f"{self.root}/drafts/{uuid.uuid4().hex}.json", f"{self.root}/versions/{manifest.version:012d}.json"
        for folder in ("drafts", "versions"):
            self.fs.create_dir(f"{self.root}/{folder}")
        with self.fs.open_output_stream(draft) as f:
            f.write(json.dumps({"parts": manifest.parts, "files": manifest.files}).encode())
        try:
            if isinstance(self.fs, pafs.LocalFileSystem):
                os.link(draft, final)  # fails where the name is taken
                os.unlink(draft)
            elif self.fs.type_name == "hdfs" or self.single_writer:
                if self.fs.get_file_info(final).type != pafs.FileType.NotFound:
                    raise FileExistsError(final)
                self.fs.move(draft, final)
            else:
                raise RuntimeError(f"{self.fs.type_name} cannot publish a version in one step; set single_writer where only one job writes")
        except OSError as e:
            raise RuntimeError(f"version {manifest.version} of {self.root} was written by someone else; read it and try again") from e

    def remove(self, folder: str) -> None:
        if self.fs.get_file_info(f"{self.root}/{folder}").type == pafs.FileType.Directory:
            self.fs.delete_dir(f"{self.root}/{folder}")

    def remove_old(self) -> None:
        """Forget versions before the last ones, and files that only they name."""
        versions = self.versions()
        kept = {f["path"] for v in versions[-KEPT_VERSIONS:] for f in self.manifest(v).files}
        for version in versions[:-KEPT_VERSIONS]:
            for f in self.manifest(version).files:
                if f["path"] not in kept and self.fs.get_file_info(f"{self.root}/{f['path']}").type == pafs.FileType.File:
                    self.fs.delete_file(f"{self.root}/{f['path']}")
            self.fs.delete_file(f"{self.root}/versions/{version:012d}.json")

    def remove_orphans(self, older_than: float) -> list[str]:
        """Remove folders of writes that no version names and that are older than
        so many seconds; a younger one may belong to a write that still runs."""
        named = {f["path"].split("/")[1] for v in self.versions() for f in self.manifest(v).files}
        gone = []
        for info in self.names("data"):
            inner = [i.mtime_ns for i in self.names(f"data/{info.base_name}")]
            if info.base_name not in named and time.time_ns() - max([info.mtime_ns or 0, *(x or 0 for x in inner)]) >= older_than * 1e9:
                self.remove(f"data/{info.base_name}")
                gone.append(info.base_name)
        return gone


class FilePart(InputPartition):
    """Files that one task reads."""

    def __init__(self, paths: list[str]):
        super().__init__(paths)
        self.paths = paths


def shape(options: Mapping[str, str]) -> tuple[T.StructType, list[str]]:
    """Schema and key columns of a table; those of the record table by default."""
    schema = T.StructType.fromJson(json.loads(options["schema"])) if "schema" in options else TABLE
    return schema, json.loads(options["keys"]) if "keys" in options else KEY


class RecordReader(DataSourceReader):
    """Reads the files that a filter on the key, or the option ``leaves``, leaves."""

    def __init__(self, options: Mapping[str, str]):
        self.options, self.wanted = dict(options), {}
        self.schema, self.keys = shape(options)

    def pushFilters(self, filters: list[Filter]):
        for f in filters:
            name = ".".join(f.attribute) if isinstance(f, (EqualTo, EqualNullSafe, In)) else None
            values = set(f.value) if isinstance(f, In) else {getattr(f, "value", None)}
            if name in self.keys and None not in values:
                self.wanted[name] = self.wanted[name] & values if name in self.wanted else values
            elif isinstance(f, IsNotNull) and f.attribute[0] in self.keys:
                pass  # no key is null
            else:
                yield f

    def files(self) -> list[dict]:
        manifest = Folder(self.options).manifest(int(self.options["version"]) if "version" in self.options else None)
        leaves = {tuple(x) for x in json.loads(self.options["leaves"])} if "leaves" in self.options else None
        eins, tins, years = (self.wanted.get(k) for k in self.keys)
        n, found = len(manifest.parts), []
        buckets = None if eins is None else {zlib.crc32(e.encode()) % n for e in eins if n}
        for f in manifest.files:
            bucket, part = f["bucket"], f["part"]
            if leaves is not None and (bucket, part) not in leaves or buckets is not None and bucket not in buckets:
                continue
            if tins is not None and part not in {zlib.crc32(t.encode()) % manifest.parts[bucket] for t in tins}:
                continue
            if years is None or any(f["first"] <= y <= f["last"] for y in years):
                found.append(f)
        return found

    def partitions(self) -> list[InputPartition]:
        parts, size, rows = [FilePart([])], 0, 0
        for f in self.files():
            if parts[-1].paths and (size + f["bytes"] > READ_BYTES or rows + f["rows"] > READ_ROWS):
                parts.append(FilePart([]))
                size = rows = 0
            parts[-1].paths.append(f["path"])
            size, rows = size + f["bytes"], rows + f["rows"]
        return parts

    def read(self, partition: FilePart) -> Iterator[pa.RecordBatch]:
        folder, test = Folder(self.options), None
        for name, values in sorted(self.wanted.items()):
            one = ds.field(name).isin(sorted(values))
            test = one if test is None else test & one
        # one row group at a time and nothing ahead of it: what a task holds does not grow with the file
        how = ds.ParquetFragmentScanOptions(pre_buffer=False, use_buffered_stream=True)
        for path in partition.paths:
            for whole in ds.dataset(f"{folder.root}/{path}", filesystem=folder.fs, format="parquet").get_fragments():
                for group in whole.split_by_row_group() if test is None else whole.split_by_row_group(test):
                    found = group.to_batches(
                        columns=self.schema.fieldNames(), filter=test, batch_size=8192, batch_readahead=1, fragment_readahead=1, fragment_scan_options=how, use_threads=False,
                    )
                    yield from (b for b in found if b.num_rows)
        give_back()


@dataclass
class Written(WriterCommitMessage):
    files: list[dict]


class RecordWriter(DataSourceArrowWriter):
    """Writes rows that come sorted by (bucket, part) into a file a leaf, and
    publishes them in place of the leaves that ``replaced`` lists."""

    def __init__(self, options: Mapping[str, str]):
        self.options, self.folder = dict(options), f"data/{uuid.uuid4().hex}"
        self.schema, self.keys = shape(options)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        place = Folder(self.options)
        place.fs.create_dir(f"{place.root}/{self.folder}")
        done: list[dict] = []
        writer, now = None, {}

        def close():
            writer.close()
            done.append(now | {"bytes": place.fs.get_file_info(f"{place.root}/{now['path']}").size})

        for batch in iterator:
            rows = pa.table({name: batch.column(name) for name in self.schema.fieldNames()})
            bucket, part = (batch.column(c).to_numpy() for c in ("bucket", "part"))
            changes = (bucket[1:] != bucket[:-1]) | (part[1:] != part[:-1])
            cuts = [0, *(changes.nonzero()[0] + 1).tolist(), len(bucket)]
            for lo, hi in zip(cuts[:-1], cuts[1:]):
                if lo == hi:
                    continue
                leaf = int(bucket[lo]), int(part[lo])
                own = rows.slice(lo, hi - lo)
                years = own.column(self.keys[2])
                first, last = years[0].as_py(), years[-1].as_py()
                if writer is None or (now["bucket"], now["part"]) != leaf:
                    if writer is not None:
                        close()
                    now = {"bucket": leaf[0], "part": leaf[1], "path": f"{self.folder}/{uuid.uuid4().hex}.parquet", "rows": 0, "first": first, "last": last}
                    writer = pq.ParquetWriter(f"{place.root}/{now['path']}", own.schema, filesystem=place.fs, compression="zstd")
                writer.write_table(own, row_group_size=ROW_GROUP)
                now = now | {"rows": now["rows"] + own.num_rows, "last": last}
        if writer is not None:
            close()
        give_back()
        return Written(done)

    def commit(self, messages: list[Written | None]) -> None:
        place = Folder(self.options)
        base = place.manifest(int(self.options["base"]))
        replaced = {tuple(x) for x in json.loads(self.options["replaced"])}
        kept = [] if self.options["replaced"] == '["all"]' else [f for f in base.files if (f["bucket"], f["part"]) not in replaced]
        new = [f for m in messages if m is not None for f in m.files]
        place.publish(Manifest(base.version + 1, json.loads(self.options["layout"]), kept + new))
        own = {f["path"] for f in new}
        for info in place.names(self.folder):  # of attempts that failed or were not needed
            if f"{self.folder}/{info.base_name}" not in own:
                place.fs.delete_file(info.path)
        place.remove_old()

    def abort(self, messages: list[Written | None]) -> None:
        Folder(self.options).remove(self.folder)


class RecordSource(DataSource):
    """``spark.read.format("ledger_records").load(path)``; for writing, use
    ``RecordStore``, which sorts rows into leaves."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self):
        return shape(self.options)[0]

    def reader(self, schema) -> RecordReader:
        return RecordReader(self.options)

    def writer(self, schema, overwrite: bool) -> RecordWriter:
        missing = {"base", "layout", "replaced"} - set(self.options)
        if missing:
            raise ValueError(f"a write needs {sorted(missing)}; RecordStore.upsert gives them")
        return RecordWriter(self.options)


def _power(least: float) -> int:
    n = 1
    while n < least:
        n *= 2
    return n


@dataclass
class Change:
    """What an upsert did: the records that went and those that came (stored
    tables, until ``release``), from one version to the next."""

    replaced: DataFrame
    added: DataFrame
    before: int
    after: int

    def release(self) -> None:
        release(self.replaced, self.added)


class LeafStore:
    """A table in leaves behind ``ledger_records``; its key columns hold no null."""

    def __init__(self, spark: SparkSession, root: str, schema: T.StructType, keys: list[str], connector: Connector | None = None, leaf_bytes: int = LEAF_BYTES):
        ship_package(spark)
        connector = connector or Connector()
        self.spark, self.schema, self.keys, self.leaf_bytes = spark, schema, keys, leaf_bytes
        for name, value in connector.hadoop_conf().items():
            spark._jsc.hadoopConfiguration().set(name, value)
        self.options = connector.options() | {"path": connector.root(root)}
        if (schema, keys) != (TABLE, KEY):
            self.options |= {"schema": schema.json(), "keys": json.dumps(keys)}
        spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
        spark.dataSource.register(RecordSource)

    @property
    def folder(self) -> Folder:
        return Folder(self.options)

    def version(self) -> int:
        return (self.folder.versions() or [0])[-1]

    def read(self, **options: str) -> DataFrame:
        return self.spark.read.format(FORMAT).options(**self.options, **options).load()

    def leaves_of(self, rows: DataFrame, manifest: Manifest, whole_buckets: bool = False) -> list[tuple[int, int]]:
        """The leaves with files that may hold keys of ``rows``; with
        ``whole_buckets`` for their first key alone."""
        if not manifest.files:
            return []
        if whole_buckets:
            mine = rows.select(self._hash(self.keys[0], F.lit(len(manifest.parts)))).distinct().collect()  # at most the number of buckets
            buckets = {r[0] for r in mine}
            return sorted(x for x in manifest.leaves() if x[0] in buckets)
        hit = {tuple(r) for r in self.placed(rows, manifest.parts).select("bucket", "part").distinct().collect()}  # at most the number of leaves
        return sorted(hit & set(manifest.leaves()))

    def read_leaves(self, leaves: list[tuple[int, int]], version: int) -> DataFrame:
        return self.read(version=str(version), leaves=json.dumps(leaves))

    @staticmethod
    def _hash(column: str, n) -> Column:
        return F.pmod(F.crc32(F.col(column).cast("binary")), n).cast("int")

    def placed(self, rows: DataFrame, parts: list[int]) -> DataFrame:
        """``rows`` with the bucket and part of their leaf."""
        out = rows.withColumn("bucket", self._hash(self.keys[0], F.lit(len(parts))))
        if max(parts) == 1:
            return out.withColumn("part", F.lit(0))
        sizes = self.spark.createDataFrame([(b, p) for b, p in enumerate(parts) if p > 1], "bucket int, parts int")  # at most a row a bucket
        return out.join(F.broadcast(sizes), "bucket", "left").withColumn("part", self._hash(self.keys[1], F.coalesce("parts", F.lit(1)))).drop("parts")

    def _layout(self, base: Manifest, rows: int) -> tuple[list[int], bool]:
        """Parts of every bucket after a batch of so many rows, and whether the
        number of buckets is another one."""
        held, count = sum(f["bytes"] for f in base.files), sum(f["rows"] for f in base.files)
        total = held + rows * (held / count if count else _ROW_BYTES)
        n = len(base.parts)
        if not n or total > 4 * n * self.leaf_bytes:
            return [1] * _power(total / self.leaf_bytes), True
        own: dict[int, int] = {}
        for (bucket, _), size in base.leaves().items():
            own[bucket] = own.get(bucket, 0) + size
        return [p if own.get(b, 0) <= 2 * p * self.leaf_bytes else _power(own[b] / self.leaf_bytes) for b, p in enumerate(base.parts)], False

    def change(self, come: DataFrame, gone: DataFrame, match: list[str], base: Manifest | None = None, whole_buckets: bool = False) -> list[tuple[int, int]]:
        """Publish the next version: without the rows whose ``match`` columns (the
        first two keys among them) stand in ``gone``, with the rows of ``come``.
        Only leaves of both are read and written; they are returned.  With
        ``whole_buckets`` the first key of ``gone`` is enough.  A change that
        touches nothing makes no version."""
        base = base or self.folder.manifest()
        rows = come.count()
        parts, moved = self._layout(base, rows)
        keys = come.select(*self.keys[:2])
        keys = keys if whole_buckets else keys.union(gone.select(*self.keys[:2]))
        hit = {tuple(r) for r in self.placed(keys, parts).select("bucket", "part").distinct().collect()}  # at most the number of leaves
        if whole_buckets and not moved:
            hit |= set(self.leaves_of(gone, base, whole_buckets=True))
        split = {b for b, p in enumerate(parts) if not moved and p != base.parts[b]} & {b for b, _ in hit}
        parts = parts if moved else [p if b in split else base.parts[b] for b, p in enumerate(parts)]
        old = set(base.leaves())
        touched = sorted(old if moved else {x for x in old if x in hit or x[0] in split})
        if not rows and not touched:
            return []
        names = self.schema.fieldNames()
        kept = self.read_leaves(touched, base.version).join(gone.select(*match).distinct(), match, "left_anti").select(*names)
        out = self.placed(kept.unionByName(come.select(*names)), parts).repartition("bucket", "part").sortWithinPartitions("bucket", "part", self.keys[2], *self.keys[:2])
        out.write.format(FORMAT).mode("append").options(
            **self.options, base=str(base.version), layout=json.dumps(parts), replaced='["all"]' if moved else json.dumps(touched),
        ).save()
        return touched

    def remove_orphans(self, older_than: float = 86_400) -> list[str]:
        return self.folder.remove_orphans(older_than)


class RecordStore(LeafStore):
    """Records keyed by (ein, tin, year)."""

    def __init__(self, spark: SparkSession, root: str, connector: Connector | None = None, leaf_bytes: int = LEAF_BYTES):
        super().__init__(spark, root, TABLE, KEY, connector, leaf_bytes)

    def upsert(self, new: DataFrame) -> Change:
        """Records of ``new`` replace stored ones of their key; the last of a batch
        (by ingested_at, run_id, then its text) wins; rows without a whole key
        are left out.  Only leaves of the batch's keys are read and written."""
        from .files import last_of_key

        base = self.folder.manifest()
        added = stored(last_of_key(new).select(*(F.col(f.name).cast(f.dataType) for f in TABLE.fields)), "added-records")
        before = self.read_leaves(self.leaves_of(added, base), base.version)
        replaced = stored(before.join(added.select(*KEY), KEY, "left_semi").select(*TABLE.fieldNames()), "replaced-records")
        self.change(added, added, KEY, base)
        return Change(replaced, added, base.version, base.version + 1)
