"""Structured Streaming forms of the request-log operators and the incremental reader."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

ALLOWED = "key string, request_id long, ts double, allowed boolean"


def limited(requests: DataFrame, key: str, most: int = 3, window: int = 3600) -> DataFrame:
    """Exact sliding-window limit of one key over a stream of (request_id, key, ts seconds); only allowed requests count (O-240).

    State per key: the times of its allowed requests in the window, ``most`` at most.
    """

    def folded(name: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        times = list(state.get[0]) if state.exists else []
        rows = pd.concat(list(parts)).sort_values(["ts", "request_id"])
        allowed = []
        for ts in rows["ts"]:
            times = [t for t in times if t > ts - window]
            allowed.append(len(times) < most)
            if allowed[-1]:
                times.append(float(ts))
        state.update((times,))
        yield pd.DataFrame({"key": name[0], "request_id": rows["request_id"], "ts": rows["ts"], "allowed": allowed})

    keyed = requests.select(F.col(key).alias("key"), "request_id", F.col("ts").cast("double").alias("ts"))
    return keyed.groupBy("key").applyInPandasWithState(folded, ALLOWED, "times array<double>", "append", GroupStateTimeout.NoTimeout)


def hourly(requests: DataFrame, late: str = "10 minutes") -> DataFrame:
    """Requests per type and hour, late ones within the watermark (append or update mode)."""
    return requests.withWatermark("ts", late).groupBy(F.window("ts", "1 hour"), "event_type").agg(F.count("*").alias("requests"), F.sum("value").alias("value"))


def new_files(spark: SparkSession, root: str, schema: str, out: str, checkpoint: str, transform) -> None:
    """Processes only files not seen before, then stops (O-020)."""
    stream = spark.readStream.schema(schema).option("multiLine", True).json(root)
    transform(stream).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
