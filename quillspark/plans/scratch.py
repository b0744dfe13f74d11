"""Where reliable checkpoints go."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame


def checkpointed(df: DataFrame) -> DataFrame:
    """``df.checkpoint()``; the folder is the session's ``spark.checkpoint.dir``, one under the warehouse where that is unset, a temporary one in local mode."""
    spark = df.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        local = context.master.startswith("local") and "cluster" not in context.master
        own = tempfile.mkdtemp(prefix="quillspark-") if local else spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_quillspark_checkpoints"
        context.setCheckpointDir(spark.conf.get("spark.checkpoint.dir", None) or own)
    return df.checkpoint()
