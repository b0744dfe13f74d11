"""Near copies by word shingles: SimHash tables and MinHash buckets propose pairs, the exact Jaccard similarity decides.

The covering SimHash tables of ``simhash`` link what lies within two bits.  At
a similarity of 0.8 most pairs lie further apart, beyond any radius that
covering masks can afford, so MinHash buckets propose the rest.

A bucket key joins ``ROWS`` minima; a pair at similarity s shares one of the
``BANDS`` keys with a probability of 1 - (1 - s^ROWS)^BANDS, which is over
0.9999 at 0.8.  Only what a link can still change is compared: first all of a
bucket with one member, then members of a bucket that aren't connected yet,
so a large group of near copies isn't compared pair by pair.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import hot_lookup, saved, small_batches
from .components import ONE_TASK, connected_components
from .simhash import keep_found, majority, named_rows, near_links

BANDS, ROWS = 20, 4
STARS = 3  # rounds that compare with one member of each bucket
HOT = 256  # rows of one key that a task takes beside others with ease
_rng = np.random.default_rng(23)
_TIMES = _rng.integers(0, 2**63, BANDS * ROWS, np.uint64) * np.uint64(2) + np.uint64(1)
_PLUS = _rng.integers(0, 2**63, BANDS * ROWS, np.uint64)


def hashes(text: str | None, words: int = 5) -> np.ndarray:
    """Hashes of all word shingles, repeats included; words as in ``simhash.fingerprint``, fewer than ``words`` make one shingle."""
    found = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not found:
        return np.empty(0, np.uint64)
    line, digest = memoryview(b" ".join(found)), xxhash.xxh64_intdigest
    sizes = np.fromiter(map(len, found), np.int64, len(found))
    ends = np.cumsum(sizes + 1) - 1
    stops = ends[words - 1 :].tolist() or [len(line)]
    return np.array([digest(line[s:e]) for s, e in zip((ends - sizes).tolist(), stops, strict=False)], np.uint64)


def band_keys(hashes: np.ndarray, block: int = 512) -> list[int]:
    """One signed key a band; an empty set has none."""
    if not len(hashes):
        return []
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(hashes), block):
        least = np.minimum(least, (hashes[i : i + block, None] * _TIMES + _PLUS).min(0))
    raw = least.tobytes()
    keys = [xxhash.xxh64_intdigest(raw[8 * ROWS * t : 8 * ROWS * (t + 1)], t + 1) for t in range(BANDS)]
    return np.array(keys, np.uint64).view(np.int64).tolist()


def _signing(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, 200):
            whole = [hashes(t, words) for t in batch.column(1).to_pylist()]
            sets = [np.unique(h) for h in whole]
            sims = np.array([majority(h) for h in whole], np.uint64).view(np.int64)
            bands = pa.array([band_keys(s) for s in sets], pa.list_(pa.int64()))
            yield pa.record_batch([batch.column(0), pa.array(_names(sets)), pa.array(sims), bands], ["id", "fp", "sim", "bands"])

    return run


def _names(sets: list[np.ndarray]) -> np.ndarray:
    return np.array([xxhash.xxh64_intdigest(s.tobytes()) if len(s) else 0 for s in sets], np.uint64).view(np.int64)


def _listing(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, 200):
            sets = [np.unique(hashes(t, words)) for t in batch.column(1).to_pylist()]
            yield pa.record_batch([pa.array(_names(sets)), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))], ["fp", "grams"])

    return run


def _hot(table: DataFrame, total: int) -> bool:
    return not table.where(F.col("uses") > max(total / 1000, HOT)).isEmpty()


def _lookup(rows: DataFrame, table: DataFrame, total: int) -> DataFrame:
    """``hot_lookup`` by ``key`` and ``uses`` of a saved table; where no key is hot a plain join, which spares the driver two broadcasts."""
    return hot_lookup(rows, table, "key", "uses", max(total, 1000 * HOT)) if _hot(table, total) else rows.join(table, "key")


def _similar(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """Those of ``pairs`` (a, b) whose exact similarity reaches the threshold; ``sets``: fp, grams."""
    pairs = listed = saved(pairs)
    m = pairs.count()
    for end in ("a", "b"):
        uses = listed.groupBy(end).agg(F.count("*").alias("uses"))
        table = sets.select(F.col("fp").alias(end), F.col("grams").alias(f"{end}_grams"))
        if m <= HOT or not _hot(uses, m):
            pairs = pairs.join(table, end)
        else:
            pairs = hot_lookup(pairs, table.join(uses, end), end, "uses", max(m, 1000 * HOT)).drop("uses")
    x, y = F.size("a_grams"), F.size("b_grams")
    pairs = pairs.where(F.least(x, y) >= F.greatest(x, y) * (threshold - 1e-9))
    both = F.size(F.array_intersect("a_grams", "b_grams"))
    return pairs.where(both >= (x + y - both) * F.lit(threshold - 1e-9)).select("a", "b")


def _in_blocks(there: DataFrame, sets: DataFrame, threshold: float, block: int = 256) -> DataFrame:
    """Links (a, b) that join what is similar in each bucket of ``there`` (key, fp); all pairs are compared, none is a row.

    A bucket is cut into chunks of about ``block`` sets, and each pair of
    chunks is one matrix product.
    """
    sizes = saved(there.groupBy("key").agg(F.count("*").alias("uses")).withColumn("chunks", F.ceil(F.col("uses") / block).cast("int")))
    members = _lookup(there, sizes, there.count()).withColumn("chunk", F.pmod(F.xxhash64("fp"), F.col("chunks")).cast("int"))
    members = members.select("key", "fp", "chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("other"))
    members = members.select("key", F.least("chunk", "other").alias("left"), F.greatest("chunk", "other").alias("right"), "fp")
    return members.join(sets, "fp").groupBy("key", "left", "right").applyInArrow(_comparing(threshold), "a long, b long").distinct()


def _comparing(threshold: float, wide: int = 8192):
    def run(rows: pa.Table) -> pa.Table:
        fp, grams = rows["fp"].to_numpy(), rows["grams"].combine_chunks()
        sizes, m = np.diff(grams.offsets.to_numpy()), rows.num_rows
        _, gram, uses = np.unique(grams.flatten().to_numpy(), return_inverse=True, return_counts=True)
        of = np.repeat(np.arange(m), sizes)
        shared = uses[gram] > 1
        column, of = (np.cumsum(uses > 1) - 1)[gram[shared]], of[shared]
        order = np.argsort(column, kind="stable")
        column, of = column[order], of[order]
        both = np.zeros((m, m), np.float32)
        for start in range(0, int(column[-1]) + 1 if len(column) else 0, wide):
            a, b = np.searchsorted(column, [start, start + wide])
            held = np.zeros((m, wide), np.float32)
            held[of[a:b], column[a:b] - start] = 1
            both += held @ held.T
        i, j = np.nonzero(np.triu(both >= (sizes[:, None] + sizes[None, :] - both) * (threshold - 1e-9), 1))
        label = np.arange(m)
        while True:
            low, after = np.minimum(label[i], label[j]), label.copy()
            np.minimum.at(after, i, low)
            np.minimum.at(after, j, low)
            after = after[after]
            if (after == label).all():
                break
            label = after
        some = np.flatnonzero(label != np.arange(m))
        return pa.table([pa.array(fp[some]), pa.array(fp[label[some]])], ["a", "b"])

    return run


def _by_simhash(rows: DataFrame, n: int) -> DataFrame:
    """Pairs (a, b) of sets whose SimHash fingerprints are equal or linked: the smallest set of either one, and of each one with its others."""
    least = saved(rows.groupBy("sim").agg(F.min("fp").alias("least"), F.count("*").alias("n")), rows=n)
    links = near_links(least.select(F.col("sim").alias("fp")), 2, rows=n)
    name = lambda c: least.select(F.col("sim").alias(c), F.col("least").alias(f"{c}_fp"))
    linked = links.join(name("a"), "a").join(name("b"), "b").select(F.least("a_fp", "b_fp").alias("a"), F.greatest("a_fp", "b_fp").alias("b"))
    same = rows.select("sim", "fp").distinct().join(least, "sim").select(F.col("least").alias("a"), F.col("fp").alias("b"))
    return linked.unionByName(same.where("a <> b")).distinct()


def _labels(near: DataFrame, links: DataFrame, m: int) -> DataFrame:
    joined = connected_components(links, rows=m, one_task=ONE_TASK).select(F.col("node").alias("fp"), F.col("component").alias("label"))
    return saved(near.join(joined, "fp", "left").withColumn("label", F.coalesce("label", "fp")))


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, threshold: float = 0.8) -> DataFrame:
    """One row per document: ``id``, ``fp`` (of its set of shingles) and ``component``, the smallest id reachable by links.

    Documents of equal sets fall together before any pair is built.  Null and
    blank texts are one set.  Nulls and repeats of ids are as in
    ``simhash.near_duplicates``.
    """
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    rows = saved(source.mapInArrow(_signing(words), f"id {dict(docs.select(id_col).dtypes)[id_col]}, fp long, sim long, bands array<long>"))
    n = rows.count()
    prints = saved(rows.groupBy("fp").agg(F.min("id").alias("least"), F.count("*").alias("n")), rows=n)
    filed = saved(rows.select("fp", F.explode("bands").alias("key")).distinct())
    shared = filed.groupBy("key").agg(F.min("fp").alias("low"), F.max("fp").alias("high"), F.count("*").alias("uses")).where("low < high").select("key", "uses")
    members = saved(_lookup(filed, saved(shared), filed.count()).select("key", "fp"))
    m = members.count()
    first = saved(_by_simhash(rows, n))
    near = saved(members.select("fp").union(first.select("a")).union(first.select("b")).distinct(), rows=n)
    # sets are listed only for documents that have a partner at all; texts are hashed again rather than kept as hashes
    ids = prints.join(near, "fp").select(F.col("least").alias("near_id")).distinct()
    wanted = source.join(ids, source["id"].eqNullSafe(ids["near_id"]), "left_semi")
    sets = saved(wanted.mapInArrow(_listing(words), "fp long, grams array<long>").join(near, "fp", "left_semi").groupBy("fp").agg(F.any_value("grams").alias("grams")))
    links = saved(_similar(first, sets, threshold))
    n_links = links.count()
    labels, there = _labels(near, links, n_links), None
    for turn in range(STARS + 1):
        if there is None:
            labelled = members.join(labels, "fp")
            still = labelled.groupBy("key").agg(F.min("label").alias("first"), F.max("label").alias("last"), F.count("*").alias("uses")).where("first < last").select("key", "uses")
            there = saved(_lookup(labelled, saved(still), m).select("key", "fp", "label"))
            if there.isEmpty():
                break
        if turn < STARS:
            # the smallest first, alike in all bands; then another one in each bucket
            order = F.col("fp") if turn == 0 else F.xxhash64(F.lit(turn), "key", "fp")
            hub = saved(there.groupBy("key").agg(F.min_by(F.struct("fp", "label"), order).alias("hub"), F.count("*").alias("uses")))
            pairs = _lookup(there, hub, m).where("label <> hub.label").select(F.col("hub.fp").alias("a"), F.col("fp").alias("b"))
            found = saved(_similar(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), sets, threshold))
        else:
            found = saved(_in_blocks(there, sets, threshold))
        n_found = found.count()
        if n_found:  # else the labels and what is left of the buckets stay as they are
            links, n_links = links.unionByName(found), n_links + n_found
            labels, there = _labels(near, links, n_links), None
    return named_rows(rows.select("id", "fp"), prints, labels.select(F.col("fp").alias("node"), F.col("label").alias("component")), n)


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` with the smallest id of their component, as ``simhash.keep_one``."""
    return keep_found(docs, near_copies(docs, id_col, text_col, **options), id_col)
