"""Cross-record rules kept up to date batch by batch.

A ``RuleBook`` stands beside a record store and holds, in tables of leaves,

* the totals of every (ein, year): sums and counts, so a batch adds the totals of
  the records that came and takes away those of the records that went;
* the results of the group rules, of the pair rules and of repeated files (C3), and
  the file hash of every record.

After an upsert only what the batch touches is judged again: groups that gained
or lost a record, partners (ein, tin) with such a record, files with such a hash.
Their records are read from the leaves of the batch's partnerships, whatever the
size of the table.  The tables' versions are tied together by a marker that is
published last.  Where it does not name the version before the upsert (a run was
lost on the way, or the store was changed by someone else), everything is judged
afresh, so the book never mixes versions.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schemas import INCOME6, KEY, TABLE
from ..session import release, stored
from ..sources.record_store import LEAF_BYTES, Change, Connector, Folder, LeafStore, Manifest, RecordStore
from .cross_rules import GROUP, RESULT, group_rules, pair_rules, repeated_files, totals, year_pairs

#: Results of pairs name their partner in a column of their own: B3 has no partner_tin.
_PAIR = ["partnership_ein", "pair_tin"]
_FILE = ["pdf_sha256", *KEY, "ingested_at", "run_id"]
#: Each nullable total with the count of values that it sums.
_COUNT_OF = {"sum_pct": "n_pct", "sum_valid": "n_valid", "sum_held": "n_held", "sum_end": "n_held", "sum_dist": "n_dist"} | {f"total_{f}": f"n_{f}" for f in INCOME6}


def _results_schema() -> T.StructType:
    kinds = {"passed": T.BooleanType(), "observed": T.DoubleType(), "threshold": T.DoubleType()}
    return T.StructType([T.StructField(c, kinds.get(c, T.StringType())) for c in RESULT])


def combined(*signed: tuple[DataFrame, int]) -> DataFrame:
    """Totals of groups whose records are a sum (1) and difference (-1) of others';
    a group without records has no row."""
    first = signed[0][0]
    numbers = [c for c in first.columns if c not in GROUP]
    parts = [df.select(*GROUP, *((F.col(c) * s).alias(c) if s != 1 else F.col(c) for c in numbers)) for df, s in signed]
    added = reduce(DataFrame.unionByName, parts).groupBy(*GROUP).agg(*(F.sum(c).alias(c) for c in numbers)).where("members > 0")
    exact = {f.name: f.dataType for f in first.schema.fields}
    value = lambda c: F.when(F.col(_COUNT_OF[c]) > 0, F.col(c)) if c in _COUNT_OF else F.col(c)
    return added.select(*GROUP, *(value(c).cast(exact[c]).alias(c) for c in numbers))


def _judged_pairs(records: DataFrame) -> DataFrame:
    return pair_rules(year_pairs(records), more=(F.col("partner_tin").alias("pair_tin"),))


class RuleBook:
    """The rule results of ``records``; ``last_read`` tells the rows of the leaves
    that the last update read."""

    def __init__(self, spark: SparkSession, root: str, records: RecordStore, connector: Connector | None = None, leaf_bytes: int = LEAF_BYTES):
        self.spark, self.records, self.last_read = spark, records, 0
        connector = connector or Connector()
        root = root.rstrip("/")
        make = lambda name, schema, keys: LeafStore(spark, f"{root}/{name}", schema, keys, connector, leaf_bytes)
        results, none = _results_schema(), spark.createDataFrame([], TABLE)
        by_group = [*GROUP, "tax_year"]
        self.stores = {
            "totals": make("totals", totals(none).schema, by_group), "groups": make("groups", results, by_group),
            "pairs": make("pairs", T.StructType([*results, T.StructField("pair_tin", T.StringType())]), [*_PAIR, "tax_year"]), "files": make("files", none.select(*_FILE).schema, ["pdf_sha256", "partner_tin", "tax_year"]),
            "repeats": make("repeats", results, ["detail", "partner_tin", "tax_year"]),
        }
        self.options = connector.options() | {"path": connector.root(f"{root}/marker")}

    def _marker(self) -> dict[str, int]:
        """The version of the records and of every table that belong together."""
        found = Folder(self.options).manifest()
        return found.files[0] if found.files else {"records": -1}

    def _mark(self, records: int) -> None:
        folder = Folder(self.options)
        versions = {name: store.version() for name, store in self.stores.items()}
        folder.publish(Manifest((folder.versions() or [0])[-1] + 1, [], [{"records": records, "path": uuid.uuid4().hex} | versions]))
        folder.remove_old()

    def apply(self, change: Change) -> None:
        """Bring the results to the version that ``change`` has made."""
        marker, held = self._marker(), {name: store.folder.manifest() for name, store in self.stores.items()}
        if marker["records"] == change.after:
            return
        if marker["records"] != change.before or any(marker[name] != m.version for name, m in held.items()):
            self.rebuild()
            return
        records = self.records.folder.manifest(change.after)
        touched = stored(change.added.unionByName(change.replaced).select(*KEY, "pdf_sha256").distinct(), "touched")
        groups, partners = touched.select(*GROUP).distinct(), touched.select("partnership_ein", "partner_tin").distinct()
        hashes = stored(touched.where("pdf_sha256 IS NOT NULL").select("pdf_sha256").distinct(), "hashes")

        # whole partnerships hold all records of a touched group and all years of a touched partner
        leaves = self.records.leaves_of(touched, records, whole_buckets=True)
        near = stored(self.records.read_leaves(leaves, change.after).join(touched.select("partnership_ein").distinct(), "partnership_ein", "left_semi"), "near-records")
        self.last_read = sum(f["rows"] for f in records.files if (f["bucket"], f["part"]) in set(leaves))
        own = stored(near.join(groups, GROUP, "left_semi"), "group-records")

        old_leaves = self.stores["totals"].leaves_of(groups, held["totals"])
        old = self.stores["totals"].read_leaves(old_leaves, held["totals"].version).join(groups, GROUP, "left_semi")
        new = stored(combined((old, 1), (totals(change.added), 1), (totals(change.replaced), -1)), "group-totals")
        pairs = stored(_judged_pairs(near.join(partners, partners.columns, "left_semi")), "pair-results")
        judged = stored(group_rules(own, new), "group-results")
        self.stores["totals"].change(new, groups, GROUP, held["totals"])
        self.stores["groups"].change(judged, groups, GROUP, held["groups"])
        self.stores["pairs"].change(pairs, partners.toDF(*_PAIR), _PAIR, held["pairs"])
        come, gone = (df.where("pdf_sha256 IS NOT NULL").select(*_FILE) for df in (change.added, change.replaced))
        keyed = come.select("pdf_sha256", *KEY).unionByName(gone.select("pdf_sha256", *KEY)).distinct()
        self.stores["files"].change(come, keyed, ["pdf_sha256", *KEY], held["files"])
        files, now = self.stores["files"], self.stores["files"].folder.manifest()
        same = files.read_leaves(files.leaves_of(hashes, now, whole_buckets=True), now.version).join(hashes, "pdf_sha256", "left_semi")
        again = stored(repeated_files(same), "file-results")
        self.stores["repeats"].change(again, hashes.withColumnRenamed("pdf_sha256", "detail"), ["detail"], held["repeats"], whole_buckets=True)
        self._mark(change.after)
        release(touched, hashes, near, own, new, pairs, judged, again)

    def rebuild(self) -> None:
        """Judge everything afresh."""
        version = self.records.version()
        records = stored(self.records.read(version=str(version)), "records")
        self.last_read = records.count()
        new = stored(totals(records), "group-totals")
        judged, pairs = stored(group_rules(records, new), "group-results"), stored(_judged_pairs(records), "pair-results")
        files = records.where("pdf_sha256 IS NOT NULL").select(*_FILE)
        for name, come in {"totals": new, "groups": judged, "pairs": pairs, "files": files, "repeats": repeated_files(files)}.items():
            store = self.stores[name]
            keys = list(dict.fromkeys(store.keys))
            store.change(come, store.read().select(*keys).unionByName(come.select(*keys)).distinct(), keys)
        self._mark(version)
        release(records, new, judged, pairs)

    def results(self) -> DataFrame:
        """All rule results of the version that the book has reached."""
        marker = self._marker()
        read = lambda name: self.stores[name].read(version=str(marker[name]))
        if marker["records"] < 0:
            return self.spark.createDataFrame([], _results_schema())
        return read("groups").unionByName(read("pairs").drop("pair_tin")).unionByName(read("repeats"))

    def totals(self) -> DataFrame:
        return self.stores["totals"].read(version=str(self._marker().get("totals", 0)))


def upsert_and_judge(records: RecordStore, book: RuleBook, new: DataFrame) -> Change:
    """Store a batch and bring the rule results up to it."""
    change = records.upsert(new)
    book.apply(change)
    return change
