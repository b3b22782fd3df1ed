"""Sessions, and cutting lineage through the shared folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.showConsoleProgress": "false",
}


def session(name: str = "lakeleaf", **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(name)
    for key, value in (DEFAULTS | conf).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The cluster's spark.checkpoint.dir; a temporary folder only on a local master that sets none."""
    sc = spark.sparkContext
    known = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not known:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="lakeleaf-"))
        known = sc.getCheckpointDir()
    return known.rstrip("/")


def scratch(spark: SparkSession, kind: str) -> str:
    """A new folder in the shared folder, removed when the driver's JVM ends."""
    path = f"{shared_dir(spark)}/{kind}-{uuid.uuid4().hex}"
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    files.mkdirs(place)
    files.deleteOnExit(place)
    return path


def checkpoint(df: DataFrame) -> DataFrame:
    """A reliable checkpoint in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


#: Bytes of an Arrow batch between the JVM and Python.
BATCH_BYTES, ARROW_BYTES = 4 << 20, "spark.sql.execution.arrow.maxBytesPerBatch"


def in_batches(df: DataFrame, f, schema: str) -> DataFrame:
    """mapInArrow in batches of about BATCH_BYTES; the bound is a setting of the session and is lowered where it is larger."""
    conf = df.sparkSession.conf
    if int(conf.get(ARROW_BYTES).removesuffix("b")) > BATCH_BYTES:
        conf.set(ARROW_BYTES, str(BATCH_BYTES))
    return df.mapInArrow(f, schema)
