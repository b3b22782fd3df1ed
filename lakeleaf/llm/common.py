"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: A word: a run of characters other than the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: bytes.translate table that lower-cases A-Z and leaves every other byte alone.
LOWER_BYTES = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
#: Bytes of an Arrow batch between the JVM and Python, and of the texts that are Python objects at a time.
BATCH_BYTES, SLICE_BYTES = 4 << 20, 1 << 19
ARROW_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- Files in the shared folder ---


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: the cluster's spark.checkpoint.dir.

    Only where the session names none and its master is local (tests, a laptop) a
    temporary folder is set; on a cluster a folder of one machine would lose rows.
    """
    sc = spark.sparkContext
    known = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not known:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="lakeleaf-"))
        known = sc.getCheckpointDir()
    return known.rstrip("/")


def _place(spark: SparkSession, path: str):
    """(Hadoop file system, path) of a URI."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), place


def scratch(spark: SparkSession, kind: str) -> str:
    """A new folder name below the shared folder; what is written there goes when the driver's JVM ends, or by ``drop``."""
    path = f"{shared_dir(spark)}/{kind}-{uuid.uuid4().hex}"
    files, place = _place(spark, path)
    files.mkdirs(place)
    files.deleteOnExit(place)
    return path


def drop(spark: SparkSession, path: str) -> None:
    """Remove a scratch folder that no later job reads."""
    files, place = _place(spark, path)
    files.delete(place, True)


def renamed(spark: SparkSession, path: str, to: str) -> None:
    """Move a scratch folder; its parent is made where it lacks."""
    files, place = _place(spark, path)
    _, target = _place(spark, to)
    files.mkdirs(target.getParent())
    if not files.rename(place, target):
        raise OSError(f"{path} could not be moved to {to}")


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut lineage through the shared folder.

    Spark removes the files of a checkpoint that nothing refers to where
    spark.cleaner.referenceTracking.cleanCheckpoints is set; else they stay.
    """
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """Write a frame as Parquet to the shared folder and read it back (smaller than a checkpoint)."""
    path = scratch(df.sparkSession, "lakeleaf") + "/rows"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


# --- Columns ---


def lower_ascii(c: Column) -> Column:
    return F.translate(c, UPPER, UPPER.lower())


def bucket_mod(column: str, modulus: int) -> Column:
    """crc32 of the id as text, modulo; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % modulus


def word_count(c: Column) -> Column:
    """Number of words of a text; null has none."""
    return F.coalesce(F.regexp_count(c, F.lit(WORD)), F.lit(0)).cast("long")


# --- Arrow functions in bounded memory ---


def map_batches(df: DataFrame, f: Callable[[Iterable], Iterator], schema: str | StructType) -> DataFrame:
    """mapInArrow whose input batches hold about BATCH_BYTES, however long the texts; a longer text goes alone.

    The bound is a setting of the session (Spark's own is 64 MB) and is lowered where it is larger.
    """
    conf = df.sparkSession.conf
    if int(conf.get(ARROW_BYTES).removesuffix("b")) > BATCH_BYTES:
        conf.set(ARROW_BYTES, str(BATCH_BYTES))
    return df.mapInArrow(f, schema)


def slices(batch, column: int, rows: int = 1024, most_bytes: int = SLICE_BYTES) -> Iterator:
    """Parts of an Arrow batch of at most so many rows and bytes of a text column; a longer text is a part of its own."""
    import pyarrow.compute as pc

    ends = np.cumsum(pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
    at, before = 0, 0
    while at < batch.num_rows:
        to = min(max(at + 1, int(np.searchsorted(ends, before + most_bytes, "right"))), at + rows)
        yield batch.slice(at, to - at)
        at, before = to, int(ends[to - 1])


def keep_texts(df: DataFrame, keeps: Callable[[str | None], bool]) -> DataFrame:
    """The rows of df, all columns, whose ``text`` passes; a few texts at a time are Python objects."""
    at = df.columns.index("text")

    def kept(batches: Iterable) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for part in slices(batch, at):
                yield part.filter(pa.array([keeps(t) for t in part.column(at).to_pylist()], pa.bool_()))

    return map_batches(df, kept, df.schema)


class RecentCache:
    """Values by short strings or bytes, in about ``limit`` bytes.

    Two generations: when the young one holds half the bytes it becomes the old
    one, and what is not asked for again by then is forgotten.  Keys longer than
    ``longest`` are kept for one call only.
    """

    ENTRY = 240  #: bytes of a dictionary slot, a key and a value, without the key's characters

    def __init__(self, limit: int = 48 << 20, longest: int = 64):
        self.limit, self.longest = limit, longest
        self.young: dict = {}
        self.old: dict = {}
        self.size = 0
        self.passing: list = []

    def lookup(self, keys: set, compute: Callable[[set], dict]) -> dict:
        """A dictionary with a value for every key, good until the next call; ``compute`` gives those of unknown keys."""
        for key in self.passing:
            del self.young[key]
        if self.size > self.limit // 2:
            self.old, self.young, self.size = self.young, {}, 0
        new = keys.difference(self.young)
        again = [key for key in new if key in self.old]  # not an intersection, which walks the larger side
        for key in again:
            self.young[key] = self.old[key]
        new.difference_update(again)
        if new:
            self.young.update(compute(new))
        self.passing = [key for key in new if len(key) > self.longest]
        self.size += sum(map(len, new)) + sum(map(len, again)) + self.ENTRY * (len(new) + len(again)) - sum(len(key) + self.ENTRY for key in self.passing)
        return self.young
