"""A table of versions: buckets by ranges of the key, of which a change rewrites only those it touches.

A folder holds ``data`` (a folder per commit, in it one per bucket), ``bounds`` (the
keys at which buckets begin) and ``versions``, a commit file per version that names the
folder of every bucket.  A commit file appears whole, by a rename that never
overwrites, so a commit that is killed leaves the version before it, and of two
commits on one version the second fails.  Data of a version are never changed.

One row is kept per key.  Of rows that repeat a key the greatest stays, by the columns
named as ``latest``, then by the others in their order; null is less than any value,
and a null key is a key.  Columns of maps have no order and are not supported, nor is
a column named ``_bucket``.  A table may be empty.
"""

from __future__ import annotations

import json
import math
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Most buckets of a table: a commit file names each of them.
MOST_BUCKETS = 1 << 16
#: Keys looked at per bucket when the bounds are chosen; they balance the buckets and change no result.
SAMPLE = 20


class VersionedTable:
    """``path`` lies in a folder that driver and executors share; ``keys`` identify a row."""

    def __init__(self, spark: SparkSession, path: str, keys: list[str]):
        self.spark, self.path, self.keys = spark, path.rstrip("/"), list(keys)
        self.jvm = spark.sparkContext._jvm
        self.conf = spark.sparkContext._jsc.hadoopConfiguration()
        self.files = self._place(self.path).getFileSystem(self.conf)

    # --- Versions ---

    def versions(self) -> list[int]:
        place = self._place(f"{self.path}/versions")
        if not self.files.exists(place):
            return []
        names = [f.getPath().getName() for f in self.files.listStatus(place)]
        return sorted(int(n[1:-5]) for n in names if n.startswith("v") and n.endswith(".json"))

    def entry(self, version: int | None = None) -> dict:
        """What the commit file of a version says; of the newest, if none is named."""
        known = self.versions()
        wanted = known[-1] if version is None and known else version
        if wanted not in known:
            raise ValueError(f"{self.path} has no version {version}")
        found = self.spark.read.text(self._commit_file(wanted), wholetext=True).first()
        return json.loads(found[0])

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version."""
        entry = self.entry(version)
        return self._rows(entry, entry["folders"])

    # --- Commits; each returns its number ---

    def save(self, rows: DataFrame, latest: list[str] | None = None, rows_per_bucket: int = 1_000_000) -> int:
        """The whole table anew, with bounds chosen anew."""
        number = (self.versions() or [0])[-1] + 1
        kept = self._one_per_key(rows, latest or [])
        buckets = min(MOST_BUCKETS, max(1, math.ceil(kept.count() / rows_per_bucket)))
        entry = {"schema": rows.schema.json(), "bounds": self._bounds(kept, buckets), "folders": {}}
        return self._commit(number, entry | {"folders": self._write(self._placed(kept, entry))}, "save")

    def upsert(self, rows: DataFrame, latest: list[str] | None = None) -> int:
        """Rows replace those with their keys in the newest version, or are added."""
        number, entry = self.versions()[-1], self.entry()
        names = StructType.fromJson(json.loads(entry["schema"])).names
        new = self._kept(self._placed(self._one_per_key(rows.select(*names), latest or []), entry))
        return self._rewrite(number, entry, new, new, "upsert")

    def remove(self, keys: DataFrame) -> int:
        """Rows with these keys go."""
        number, entry = self.versions()[-1], self.entry()
        gone = self._kept(self._placed(keys.select(*self.keys).distinct(), entry))
        return self._rewrite(number, entry, gone, None, "remove")

    def restore(self, version: int) -> int:
        """A new version with the rows of an older one; no data are written."""
        return self._commit(self.versions()[-1] + 1, self.entry(version), "restore", [])

    def forget(self, keep: int) -> None:
        """Only the newest ``keep`` versions stay, and the data they name; not to be run beside a commit."""
        known = self.versions()
        for version in known[: -keep or None]:
            self.files.delete(self._place(self._commit_file(version)), False)
        left = [self.entry(v) for v in self.versions()]
        named = {folder for e in left for folder in e["folders"].values()} | {e["bounds"] for e in left}
        for kind in ("data", "bounds"):
            for status in self.files.listStatus(self._place(f"{self.path}/{kind}")):
                if f"{kind}/{status.getPath().getName()}" not in named:
                    self.files.delete(status.getPath(), True)

    # --- Parts ---

    def _place(self, path: str):
        return self.jvm.org.apache.hadoop.fs.Path(path)

    def _commit_file(self, version: int) -> str:
        return f"{self.path}/versions/v{version:012d}.json"

    def _one_per_key(self, rows: DataFrame, latest: list[str]) -> DataFrame:
        order = [*latest, *(c for c in rows.columns if c not in latest and c not in self.keys)]
        if not order:
            return rows.distinct()
        best = rows.groupBy(*self.keys).agg(F.max(F.struct(*order)).alias("_best"))
        return best.select(*(F.col(c) if c in self.keys else F.col("_best")[c].alias(c) for c in rows.columns))

    def _kept(self, rows: DataFrame) -> DataFrame:
        """A change, written once, as several jobs read it."""
        path = f"{self.path}/changes/{uuid.uuid4().hex}"
        rows.write.parquet(path)
        self.files.deleteOnExit(self._place(path))
        return self.spark.read.schema(rows.schema).parquet(path)

    def _bounds(self, rows: DataFrame, buckets: int) -> str:
        """A one-row table of the keys where buckets begin, in groups, so that a key is looked up in two short steps."""
        some = rows.select(F.struct(*self.keys).alias("key")).orderBy(F.xxhash64("key"), "key").limit(SAMPLE * buckets)
        ends = F.array_sort(F.collect_list("key"))
        step = F.size("ends") / F.lit(buckets)
        picked = F.transform(F.sequence(F.lit(1), F.lit(buckets)), lambda i: F.get("ends", F.floor(step * i).cast("int")))
        # The last place lies behind the end and is null.
        chosen = F.array_distinct(F.array_compact(picked))
        width = max(1, math.isqrt(buckets))
        starts = F.filter(F.sequence(F.lit(0), F.lit(buckets)), lambda i: (i % width == 0) & (i < F.size("chosen")))
        groups = F.transform(starts, lambda i: F.slice("chosen", i + 1, width))
        name = f"bounds/{uuid.uuid4().hex}"
        found = some.agg(ends.alias("ends")).select(chosen.alias("chosen")).select(groups.alias("groups"), F.lit(width).alias("width"))
        found.write.parquet(f"{self.path}/{name}")
        return name

    def _placed(self, rows: DataFrame, entry: dict) -> DataFrame:
        """Adds _bucket: how many bounds are at most the key."""
        bounds = self.spark.read.parquet(f"{self.path}/{entry['bounds']}").select(F.col("groups").alias("_groups"), F.col("width").alias("_width"))
        key = F.struct(*self.keys)
        group = F.size(F.filter("_groups", lambda g: g[0] <= key))
        inside = F.size(F.filter(F.get("_groups", group - 1), lambda b: b <= key))
        bucket = F.when(group == 0, 0).otherwise((group - 1) * F.col("_width") + inside)
        return rows.crossJoin(F.broadcast(bounds)).withColumn("_bucket", bucket).drop("_groups", "_width")

    def _rows(self, entry: dict, folders: dict[str, str]) -> DataFrame:
        schema = StructType.fromJson(json.loads(entry["schema"]))
        paths = [f"{self.path}/{folder}/_bucket={bucket}" for bucket, folder in folders.items()]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def _write(self, placed: DataFrame) -> dict[str, str]:
        """Writes the buckets, sorted by key, so that row groups prune by it; returns the folder of each that has rows."""
        name = f"data/{uuid.uuid4().hex}"
        sorted_rows = placed.repartition("_bucket").sortWithinPartitions("_bucket", *self.keys)
        sorted_rows.write.partitionBy("_bucket").parquet(f"{self.path}/{name}")
        found = [f.getPath().getName() for f in self.files.listStatus(self._place(f"{self.path}/{name}"))]
        return {n.split("=")[1]: name for n in found if n.startswith("_bucket=")}

    def _rewrite(self, number: int, entry: dict, gone: DataFrame, added: DataFrame | None, action: str) -> int:
        """Buckets that hold a key of ``gone`` without those keys, and with ``added``."""
        touched = [str(r[0]) for r in gone.select("_bucket").distinct().collect()]  # at most MOST_BUCKETS
        old = self._placed(self._rows(entry, {b: entry["folders"][b] for b in touched if b in entry["folders"]}), entry)
        keys = gone.select(*(F.col(k).alias(f"_gone_{k}") for k in self.keys))
        same = None
        for k in self.keys:
            equal = old[k].eqNullSafe(keys[f"_gone_{k}"])
            same = equal if same is None else same & equal
        kept = old.join(keys, same, "left_anti")
        fresh = self._write(kept if added is None else kept.unionByName(added))
        folders = {b: f for b, f in entry["folders"].items() if b not in touched} | fresh
        return self._commit(number + 1, entry | {"folders": folders}, action, touched)

    def _commit(self, number: int, entry: dict, action: str, rewritten: list[str] | None = None) -> int:
        entry = entry | {"version": number, "action": action, "rewritten": list(entry["folders"]) if rewritten is None else rewritten}
        target, draft = self._place(self._commit_file(number)), self._place(f"{self.path}/drafts/{uuid.uuid4().hex}")
        self.files.mkdirs(target.getParent())
        out = self.files.create(draft, False)
        try:
            out.write(json.dumps(entry).encode())
        finally:
            out.close()
        self._rename(draft, target)
        return number

    def _rename(self, draft, target) -> None:
        """Fails if the target exists: one step on HDFS; elsewhere as the file system has it."""
        kind = getattr(self.jvm.org.apache.hadoop.fs, "Options$Rename")
        options = self.spark.sparkContext._gateway.new_array(kind, 1)
        options[0] = kind.NONE
        context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.files.getUri(), self.conf)
        context.rename(self.files.makeQualified(draft), self.files.makeQualified(target), options)
