"""Row numbers over a whole table without a single task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import checkpoint


def numbered(rows: DataFrame, order: list, name: str) -> DataFrame:
    """Adds 1, 2, ... in the order, which must be total.

    Rows are range-partitioned by the order and numbered within their partition;
    the counts of the partitions before, one row each, are added.  The bounds of
    ranges are sampled anew by every job, so the dealt rows are checkpointed:
    counts and numbers then speak of the same partitions.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = checkpoint(rows.repartitionByRange(parts, *order).withColumn("_part", F.spark_partition_id()))
    inside = placed.withColumn("_n", F.row_number().over(Window.partitionBy("_part").orderBy(*order)))
    sizes = placed.groupBy("_part").agg(F.count("*").alias("_size"))  # a row a partition
    before = F.coalesce(F.sum("_size").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select("_part", before.alias("_before"))
    return inside.join(F.broadcast(starts), "_part").withColumn(name, F.col("_n") + F.col("_before")).drop("_part", "_n", "_before")
