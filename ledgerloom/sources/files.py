"""File sources and sinks: documents as bytes, the versioned record table, and
the report outputs."""

from __future__ import annotations

import hashlib
import json
import re
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.pdf import counted_pages
from ..functions.text import file_stem, slug
from ..schemas import KEY, SUMMARY_FIELDS, TABLE
from ..session import ship_package


def list_files(spark: SparkSession, folder: str, glob: str = "*", exclude: tuple[str, ...] = ()) -> DataFrame:
    """Paths under ``folder``, sorted; contents are not read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(folder)
    keep = F.lit(True)
    for part in exclude:
        keep = keep & ~F.col("path").contains(f"/{part}/")
    return found.select("path", "length", "modificationTime").where(keep).orderBy("path")


def select_input(files: DataFrame, run_id: str | None = None) -> DataFrame:
    """The file of a run, or else the first by path outside the folders of
    archived and batch files."""
    if run_id:
        return files.where(F.element_at(F.split("path", "/"), -1) == f"{run_id}.pdf")
    waiting = files.where(~F.col("path").contains("/archive/") & ~F.col("path").contains("/batch/"))
    first = waiting.agg(F.min("path").alias("path"))
    return files.join(F.broadcast(first), "path", "left_semi")  # one row


def collect_files(spark: SparkSession, folders: list[str], glob: str) -> DataFrame:
    """Matching files of several folders, by path."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(folders)
    return found.select("path", "length", "modificationTime").orderBy("path")


def read_object(spark: SparkSession, path: str, kind: str = "text", schema: str | None = None) -> DataFrame:
    """Objects at a key or glob: ``bytes``, whole ``text`` or ``json`` documents."""
    if kind == "bytes":
        return spark.read.format("binaryFile").load(path).select("path", "content")
    if kind == "json":
        reader = spark.read.option("multiLine", "true")
        return (reader.schema(schema) if schema else reader).json(path)
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def exists(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def ingest(files: DataFrame, now=None) -> DataFrame:
    """run_id, name, size, hash, pages and bytes of binary files."""
    ship_package(files.sparkSession)
    at = F.current_timestamp() if now is None else F.lit(now).cast("timestamp")
    name = F.element_at(F.split("path", "/"), -1)
    return files.select(
        F.concat_ws("_", file_stem(F.col("path")), F.unix_timestamp("modificationTime").cast("string")).alias("run_id"),
        name.alias("source_pdf_name"), F.col("length").alias("size_bytes"), F.sha2("content", 256).alias("pdf_sha256"),
        counted_pages(F.col("content")).alias("page_count"), at.alias("ingested_at"), "content",
    )


def read_markdown(spark: SparkSession, folder: str, exclude: tuple[str, ...] = (), separator: str = "\n\n") -> DataFrame:
    """One row: all .md files of a folder in name order, joined."""
    texts = spark.read.text(folder, wholetext=True, pathGlobFilter="*.md").select(F.col("_metadata.file_name").alias("name"), "value")
    kept = texts.where(~F.col("name").isin(*exclude)) if exclude else texts
    parts = F.array_sort(F.collect_list(F.struct("name", "value")))
    return kept.agg(F.array_join(F.transform(parts, lambda p: p["value"]), separator).alias("text"))


class RecordTable:
    """Records keyed by (ein, tin, year), in one folder for each write and year.

    A write makes folders for the years it touches and then one manifest, a
    small file with the number of the version and the folder of every year.
    Manifests are never changed: a new one is written under a name of its own
    and renamed to its number, which fails if another writer was there first.
    Readers take the highest number, so they see a version whole or not at all,
    and a write that fails at any point leaves the version before it current.
    The version before the current one is kept for running readers; older
    folders are removed.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def _versions(self) -> list[int]:
        folder = self._path(f"{self.root}/versions")
        if not self._fs.exists(folder):
            return []
        names = [status.getPath().getName() for status in self._fs.listStatus(folder)]
        return sorted(int(n.removesuffix(".json")) for n in names if re.fullmatch(r"[0-9]+[.]json", n))

    def _manifest(self, version: int) -> dict[str, str]:
        """Folder of each year (at most one entry a tax year)."""
        return json.loads(self.spark.read.text(f"{self.root}/versions/{version:012d}.json", wholetext=True).first()[0])

    def _read(self, years: dict[str, str]) -> DataFrame:
        if not years:
            return self.spark.createDataFrame([], TABLE)
        return self.spark.read.schema(TABLE).parquet(*(f"{self.root}/{folder}" for folder in sorted(set(years.values()))))

    def read(self) -> DataFrame:
        versions = self._versions()
        return self._read(self._manifest(versions[-1]) if versions else {})

    def upsert(self, new: DataFrame) -> None:
        """New records replace stored ones of their key; the last in a batch wins.
        Only the years of the batch are written again."""
        versions = self._versions()
        version, years = (versions[-1], self._manifest(versions[-1])) if versions else (0, {})
        touched = [r[0] for r in new.where("tax_year IS NOT NULL").select("tax_year").distinct().collect()]  # a few years
        merged = upsert(self._read({y: f for y, f in years.items() if y in touched}), new)
        name = f"data/{uuid.uuid4().hex}"
        keyed = merged.withColumn("year_folder", F.md5("tax_year"))
        spread = keyed.repartition("tax_year", F.pmod(F.xxhash64("partnership_ein", "partner_tin"), F.lit(8)))
        spread.write.partitionBy("year_folder").parquet(f"{self.root}/{name}")
        folder = lambda year: f"{name}/year_folder={hashlib.md5(year.encode(), usedforsecurity=False).hexdigest()}"
        written = {y: folder(y) for y in touched if self._fs.exists(self._path(f"{self.root}/{folder(y)}"))}
        self._publish(version + 1, years | written)
        self._remove_old()

    def _publish(self, version: int, years: dict[str, str]) -> None:
        draft = self._path(f"{self.root}/drafts/{uuid.uuid4().hex}.json")
        out = self._fs.create(draft, False)
        out.write(bytearray(json.dumps(years).encode()))
        out.close()
        final = self._path(f"{self.root}/versions/{version:012d}.json")
        self._fs.mkdirs(final.getParent())
        if self._fs.exists(final) or not self._fs.rename(draft, final):
            raise RuntimeError(f"version {version} of {self.root} was written by someone else; read it and try again")

    def _remove_old(self) -> None:
        versions = self._versions()
        kept = {f for v in versions[-2:] for f in self._manifest(v).values()}
        for version in versions[:-2]:
            for folder in set(self._manifest(version).values()) - kept:
                self._fs.delete(self._path(f"{self.root}/{folder}"), True)
            self._fs.delete(self._path(f"{self.root}/versions/{version:012d}.json"), False)


def last_of_key(new: DataFrame) -> DataFrame:
    """The last record of every whole key; of records of one time and run the
    last by its text."""
    usable = new.where(" AND ".join(f"{k} IS NOT NULL" for k in KEY))
    order = F.struct(*(F.col(c) for c in ("ingested_at", "run_id") if c in new.columns), F.to_json(F.struct("*")))
    return usable.groupBy(*KEY).agg(F.max_by(F.struct("*"), order).alias("r")).select("r.*")


def upsert(stored: DataFrame, new: DataFrame) -> DataFrame:
    last = last_of_key(new)
    return stored.join(last, KEY, "left_anti").select(*new.columns).unionByName(last)


def summary_rows(reports: DataFrame, keys: list[str]) -> DataFrame:
    """The two-column export: (field, value) in order, null as empty text."""
    pairs = F.array(*(F.struct(F.lit(f).alias("field"), F.coalesce(F.col(f).cast("string"), F.lit("")).alias("value")) for f in SUMMARY_FIELDS))
    return reports.select(*keys, F.posexplode(pairs).alias("position", "p")).select(*keys, "position", "p.*")


def document_key(*parts: Column | str, suffix: str = "") -> Column:
    """A storage key: non-empty parts as slugs, joined by slashes."""
    columns = [slug(F.lit(p) if isinstance(p, str) else p) for p in parts]
    return F.concat(F.concat_ws("/", *(F.nullif(c, F.lit("")) for c in columns)), F.lit(suffix))


def decoded(content: Column) -> Column:
    """Bytes of a base64 text; null where it is none."""
    return F.try_to_binary(content, F.lit("base64"))


def with_ingest_status(records: DataFrame) -> DataFrame:
    """``status`` of each record: skipped with a reason if a part of its key is
    missing, else stored."""
    missing = F.array_compact(F.array(*(F.when(F.coalesce(F.trim(F.col(k).cast("string")), F.lit("")) == "", F.lit(k)) for k in KEY)))
    found = records.withColumn("missing", missing)
    return found.withColumns({
        "status": F.when(F.size("missing") > 0, "skipped").otherwise("stored"),
        "reason": F.when(F.size("missing") > 0, F.concat(F.lit("missing "), F.array_join("missing", ", "))),
    }).drop("missing")


def assemble_records(ingested: DataFrame, extracted: DataFrame, identifiers: DataFrame, checks: DataFrame | None = None, scores: DataFrame | None = None) -> DataFrame:
    """Rows of the record table: each ingested run with its extracted fields, its
    identifiers, the counts of its failed checks and its scores.  ``checks`` has a row
    for each check (severity, passed) or the counts of a report.  Only ``ingested``
    and ``extracted`` must know a run; of repeated rows of a run the first by
    their text stays."""

    def one(df: DataFrame) -> DataFrame:
        rest = [c for c in df.columns if c != "run_id"]
        return df.groupBy("run_id").agg(F.min_by(F.struct(*rest), F.to_json(F.struct(*rest), {"ignoreNullFields": "false"})).alias("r")).select("run_id", "r.*")

    rows = one(ingested).join(one(extracted), "run_id").join(one(identifiers), "run_id", "left")
    if checks is not None:
        counted = "passed" not in checks.columns
        failed = lambda s: (F.sum(f"{s}_count") if counted else F.count_if(~F.col("passed") & (F.col("severity") == s))).cast("int")
        counts = checks.groupBy("run_id").agg(
            failed("critical").alias("deterministic_critical_count"), failed("warning").alias("deterministic_warning_count"),
        ).withColumn("deterministic_passed", F.col("deterministic_critical_count") == 0)
        rows = rows.join(counts, "run_id", "left")
    if scores is not None:
        rows = rows.join(one(scores), "run_id", "left")
    return rows.select(*(F.col(f.name).cast(f.dataType) if f.name in rows.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in TABLE.fields))


def write_summary(reports: DataFrame, path: str) -> None:
    summary_rows(reports, ["run_id"]).write.partitionBy("run_id").option("header", "true").csv(path)


def write_reports(reports: DataFrame, path: str) -> None:
    reports.write.partitionBy("run_id").json(path)


def read_reports(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.json(path)
