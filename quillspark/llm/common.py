"""Helpers shared by the operators: scratch tables, salts, skew-proof lookups."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """Folder that the driver and all executors share.

    ``spark.checkpoint.dir`` names it.  Only where that is unset does the
    library choose one: under the warehouse on a cluster, which is shared by
    definition, and a temporary folder in local mode.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    app = spark.sparkContext.applicationId
    if app not in _own:
        if spark.sparkContext.master.startswith("local") and "cluster" not in spark.sparkContext.master:
            _own[app] = "file://" + tempfile.mkdtemp(prefix="quillspark-")
        else:
            _own[app] = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_quillspark_scratch"
    return _own[app]


def saved(df: DataFrame, paths: list[str] | None = None, rows: int | None = None) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back.

    This cuts the lineage and outlives executors.  The path is appended to
    ``paths`` so that a loop can drop tables it has superseded.  ``rows``: about
    how many narrow rows there are at most; the table is then written in as few
    files as that takes (25,000 rows each), not in one for every shuffle
    partition.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/quillspark-{uuid.uuid4().hex}"
    if rows is not None:
        df = df.coalesce(2 + rows // 25_000)
    df.write.parquet(path)
    if paths is not None:
        paths.append(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_saved(spark: SparkSession, paths: list[str]) -> None:
    """Delete scratch tables that no later plan reads."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    while paths:
        where = jvm.org.apache.hadoop.fs.Path(paths.pop())
        where.getFileSystem(conf).delete(where, True)


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only."""
    return F.translate(text, UPPER, LOWER)


def salt_count(rows: int, per_salt: int = 50_000, least: int = 64) -> int:
    """Number of salts that keeps any one (key, salt) cell small at every input size."""
    return max(least, -(-rows // per_salt))


def salt_of(key: Column, salts: int) -> Column:
    """Even, portable salt from an id: leading 28 bits of its MD5, modulo ``salts``."""
    return (F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), 1, 7), 16, 10).cast("long") % salts).cast("int")


def hot_lookup(rows: DataFrame, table: DataFrame, key: str, weight: str, total: int, hot_keys: int = 1000) -> DataFrame:
    """Inner join of ``rows`` with ``table`` (one row a key), safe when a key is hot.

    Keys that hold more than ``total / hot_keys`` rows are fewer than
    ``hot_keys``: that is the proven bound under which they are broadcast.
    All others are joined by a shuffle, where no key is then large.
    ``weight``: the column of ``table`` with the key's number of rows.
    """
    limit = total / hot_keys
    hot = F.broadcast(table.where(F.col(weight) > limit))
    cold = table.where(F.col(weight) <= limit)
    part = rows.join(hot.select(key), key, "left_anti")
    return rows.join(hot, key).unionByName(part.join(cold, key))


def small_batches(batches, rows: int = 500, size: int = 1 << 23):
    """Slices of Arrow batches of up to ``rows`` rows and (unless one row alone has more) ``size`` bytes of text, so that a worker makes Python objects of little at a time."""
    for batch in batches:
        texts = [c for c in batch.columns if pa.types.is_string(c.type)]
        ends = np.cumsum(sum((pc.fill_null(pc.binary_length(c), 0).to_numpy(zero_copy_only=False).astype(np.int64) for c in texts), np.zeros(batch.num_rows, np.int64)))
        i = 0
        while i < batch.num_rows:
            before = int(ends[i - 1]) if i else 0
            j = min(i + rows, max(i + 1, int(np.searchsorted(ends, before + size, "right"))))
            yield batch.slice(i, j - i)
            i = j
