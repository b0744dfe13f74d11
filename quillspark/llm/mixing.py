"""Mixing sources to target weights by Pfair scheduling, in DataFrame functions only.

Weights become whole shares of a frame of ``frame`` slots.  Block i of a
source with share a is released at floor(i * frame / a) and due at
ceil((i + 1) * frame / a); in every slot the released block that is due first
runs.  Shares add up to the frame, so each block meets its window and each
source stays within one block of its ideal number at every slot.  The schedule
repeats each frame, so only one frame is ever worked out, and a block's slot
follows from its number by arithmetic and a look-up in a table of that size.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import salt_count, salt_of, saved

MAX_SOURCES = 1000  # as far as the frame is scheduled in DataFrame functions; its cost is sources times slots


def source_shares(sizes: DataFrame, weights: dict[str, float] | float = 0.9, frame: int = 1000) -> DataFrame:
    """Columns ``source, n, idx, share``; shares are whole, at least 1, and add up to ``frame``.

    ``sizes``: ``source, n``.  ``weights``: a number a gives n ** a; a
    dictionary names each source's weight (sources not in it get its smallest).
    Rounding is by largest remainder, ties to the smaller idx (order of names,
    null first).
    """
    if isinstance(weights, dict):
        if not weights or min(weights.values()) <= 0:
            raise ValueError("weights must be positive")
        known = F.create_map(*[F.lit(x) for kv in weights.items() for x in kv])
        weight = F.coalesce(known[F.col("source")], F.lit(float(min(weights.values()))))
    else:
        weight = F.pow(F.col("n").cast("double"), F.lit(float(weights)))
    everyone = Window.partitionBy()  # one row a source
    ranked = sizes.select("source", "n", weight.cast("double").alias("w"))
    ranked = ranked.withColumn("idx", F.row_number().over(everyone.orderBy(F.asc_nulls_first("source"))) - 1).withColumn("m", F.count("*").over(everyone))
    # one slot each comes first, the rest goes by weight
    exact = F.round((F.lit(frame) - F.col("m")) * F.col("w") / F.sum("w").over(everyone), 9)
    ranked = ranked.withColumn("exact", exact).withColumn("whole", F.floor("exact")).withColumn("left", F.lit(frame) - F.col("m") - F.sum("whole").over(everyone))
    nth = F.row_number().over(everyone.orderBy(F.desc(F.col("exact") - F.col("whole")), "idx"))
    return ranked.select("source", "n", "idx", (1 + F.col("whole") + F.when(nth <= F.col("left"), 1).otherwise(0)).cast("int").alias("share"))


def frame_schedule(shares: DataFrame, frame: int = 1000) -> DataFrame:
    """Columns ``idx, j, slot_in_frame``: earliest deadline first over one frame, ties to the smaller idx."""
    listed = shares.agg(F.transform(F.array_sort(F.collect_list(F.struct("idx", "share"))), lambda x: x["share"]).alias("shares"))
    start = F.struct(F.transform("shares", lambda a: F.lit(0)).alias("done"), F.array().cast("array<int>").alias("picked"))

    def step(state, t):
        def entry(a, i):
            done = F.get(state["done"], i)
            free = (done < a) & (F.floor(done * frame / a) <= t)
            return F.when(free, F.struct(F.ceil((done + 1) * frame / a).alias("due"), i.alias("i")))

        first = F.array_min(F.transform("shares", entry))["i"]
        done = F.transform(state["done"], lambda d, i: F.when(i == first, d + 1).otherwise(d))
        return F.struct(done.alias("done"), F.concat(state["picked"], F.array(first)).alias("picked"))

    order = listed.select(F.posexplode(F.aggregate(F.sequence(F.lit(0), F.lit(frame - 1)), start, step, lambda s: s["picked"])).alias("slot_in_frame", "idx"))
    nth = F.row_number().over(Window.partitionBy("idx").orderBy("slot_in_frame"))
    return order.select("idx", (nth - 1).alias("j"), "slot_in_frame")


def long_schedule(shares: DataFrame, frame: int) -> DataFrame:
    """The same table by two heaps on the driver, for many sources: frame * log(sources) steps."""
    listed = shares.select("idx", "share").toArrow().sort_by("idx")
    idx, share = listed["idx"].to_pylist(), listed["share"].to_pylist()
    done, released, waiting = [0] * len(share), [], [(0, i) for i in range(len(share))]
    picked, nth = np.empty(frame, np.int32), np.empty(frame, np.int32)
    for t in range(frame):
        while waiting and waiting[0][0] <= t:
            i = heapq.heappop(waiting)[1]
            heapq.heappush(released, (-(-(done[i] + 1) * frame // share[i]), i))
        i = heapq.heappop(released)[1]
        picked[t], nth[t] = idx[i], done[i]
        done[i] += 1
        if done[i] < share[i]:
            heapq.heappush(waiting, (done[i] * frame // share[i], i))
    return shares.sparkSession.createDataFrame(pa.table({"idx": picked, "j": nth, "slot_in_frame": np.arange(frame, dtype=np.int32)}))


def key_of(source: str):
    """The source as a join key that is never null."""
    return F.coalesce(F.concat(F.lit("="), F.col(source)), F.lit(""))


def mix(docs: DataFrame, weights: dict[str, float] | float = 0.9, block_docs: int = 16, frame: int = 1000, id_col: str = "doc_id", source_col: str = "source") -> DataFrame:
    """All rows of ``docs`` with their place in the mix, as one struct column ``mix``.

    Fields: ``source_row`` (place in its own source, from 0), ``block``,
    ``release``, ``deadline``, ``slot`` (of the block), ``position`` (slot *
    block_docs + place in the block) and ``in_mix``.  The mix holds its target
    weights up to the first slot in which any source has nothing left; rows
    before it are ``in_mix``.  Later rows are still placed by the same rule, so
    none is lost.

    Within a source rows go by the MD5 of their id, a shuffle that is the same
    each time.  Null sources are one source.  Repeated rows get different
    places.  For more than ``MAX_SOURCES`` sources or more than ``frame``, the
    frame becomes the next multiple that has two slots or more a source.  Other columns pass through unread.  An empty table gives an empty result.
    """
    sizes = saved(docs.groupBy(F.col(source_col).cast("string").alias("source")).agg(F.count("*").alias("n")), rows=0)
    totals = sizes.agg(F.count("*").alias("m"), F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()
    if totals["m"] > min(MAX_SOURCES, frame):
        frame *= -(-2 * totals["m"] // frame)
    shares = saved(source_shares(sizes, weights, frame), rows=0)
    schedule = frame_schedule if totals["m"] <= MAX_SOURCES else long_schedule
    plan = saved(schedule(shares, frame), rows=frame)
    ends = shares.withColumn("blocks", F.ceil(F.col("n") / block_docs))
    ends = ends.withColumn("j", (F.col("blocks") % F.col("share")).cast("int")).join(F.broadcast(plan), ["idx", "j"])
    horizon = ends.agg(F.min(F.floor(F.col("blocks") / F.col("share")) * frame + F.col("slot_in_frame")).alias("h")).first()["h"]

    salts = salt_count(totals["n"])
    cols = docs.columns
    whole = docs.select(F.struct(*[docs[c] for c in cols]).alias("row"), docs[id_col].alias("id"), docs[source_col].cast("string").alias("source"))
    whole = whole.withColumn("salt", salt_of(F.col("id"), salts))
    cells = whole.groupBy("source", "salt").agg(F.count("*").alias("n"))  # sources * salts rows, combined before the shuffle
    skip = F.coalesce(F.sum("n").over(Window.partitionBy("source").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    cells = cells.select("salt", skip.alias("skip"), key_of("source").alias("skey"))
    cells = saved(cells.join(F.broadcast(shares.select(key_of("source").alias("skey"), "idx", "share")), "skey"), rows=totals["m"] * salts)
    nth = F.row_number().over(Window.partitionBy("skey", "salt").orderBy(F.asc_nulls_first("id")))
    rows = whole.withColumn("skey", key_of("source")).withColumn("nth", nth).join(cells, ["skey", "salt"])
    rows = rows.withColumn("source_row", F.col("skip") + F.col("nth") - 1).withColumn("block", F.floor(F.col("source_row") / block_docs))
    rows = rows.withColumn("j", (F.col("block") % F.col("share")).cast("int")).join(F.broadcast(plan), ["idx", "j"])
    before = F.floor(F.col("block") / F.col("share")) * frame
    slot = before + F.col("slot_in_frame")
    mixed = F.struct(
        F.col("source_row").cast("long").alias("source_row"),
        F.col("block").cast("long").alias("block"),
        (before + F.floor(F.col("j") * frame / F.col("share"))).cast("long").alias("release"),
        (before + F.ceil((F.col("j") + 1) * frame / F.col("share"))).cast("long").alias("deadline"),
        slot.cast("long").alias("slot"),
        (slot * block_docs + F.col("source_row") % block_docs).cast("long").alias("position"),
        (slot < F.lit(horizon)).alias("in_mix"),
        F.col("share").alias("share"),
    )
    return rows.select("row", mixed.alias("mix"))


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """All rows of ``docs`` in the order of the mix (range-partitioned and sorted), same columns.

    The mix holds its weights up to its end; what larger sources have left
    follows by the same rule, so no row is lost.
    """
    placed = mix(docs, **options)
    ordered = placed.withColumn("at", F.col("mix.position")).repartitionByRange("at").sortWithinPartitions("at")
    return ordered.select("row.*")


def positioned(docs: DataFrame) -> DataFrame:
    """Add ``position``, the place of each row (from 0) in the order in which the table was written.

    Spark reads files in an order of its own, so what ``mixed_documents`` wrote
    keeps its order only by the numbers of its files and the rows' places in
    them.  Nothing is shuffled; the table of files has one row each.  A plan
    that isn't a plain table of Parquet files is written first.
    """
    if docs._jdf.queryExecution().analyzed().getClass().getSimpleName() != "LogicalRelation":
        docs = saved(docs)
    rows = docs.select("*", F.col("_metadata.file_name").alias("_file"), F.col("_metadata.row_index").alias("position"))
    files = rows.groupBy("_file").agg(F.count("*").alias("n"))
    number = F.regexp_extract("_file", r"^part-(\d+)", 1).try_cast("long")
    before = Window.partitionBy().orderBy(F.asc_nulls_last(number), "_file").rowsBetween(Window.unboundedPreceding, -1)
    files = saved(files.select("_file", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_before")), rows=0)
    placed = rows.join(F.broadcast(files), "_file").withColumn("position", F.col("position") + F.col("_before"))
    return placed.select(*docs.columns, "position")
