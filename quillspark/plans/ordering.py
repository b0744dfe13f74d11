"""Global row numbers without a single-partition window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.plans.scratch import checkpointed


def numbered(rows: DataFrame, order: list[Column | str], name: str = "n") -> DataFrame:
    """Add ``name``, the 0-based place of each row in the order.

    Rows are range-partitioned, counted per partition, and numbered inside
    their partition from its offset.  The order should be total, so that the
    numbers are the same each time.
    """
    ranged = rows.repartitionByRange(*order).withColumn("_part", F.spark_partition_id())
    ranged = checkpointed(ranged)
    counts = ranged.groupBy("_part").agg(F.count("*").alias("n")).orderBy("_part").collect()
    offsets, seen = [], 0
    for r in counts:  # one row a partition
        offsets.append((r["_part"], seen))
        seen += r["n"]
    if not offsets:
        return rows.withColumn(name, F.lit(None).cast("long"))
    table = F.broadcast(rows.sparkSession.createDataFrame(offsets, "_part int, _offset long"))
    nth = F.row_number().over(Window.partitionBy("_part").orderBy(*order)) - 1
    return ranged.join(table, "_part").withColumn(name, (F.col("_offset") + nth).cast("long")).drop("_part", "_offset")
