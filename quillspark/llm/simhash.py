"""SimHash near-duplicates by covering locality-sensitive hashing.

A fingerprint has 64 bits, and pairs at Hamming distance ``radius`` or less
are linked.  Every bit position i gets a non-zero vector m(i) of GF(2)^(r+1).
Table v (v non-zero) keeps the bits with <m(i), v> = 1.  For any r positions a
non-zero v exists that is orthogonal to all their vectors, so table v ignores
every differing bit: each pair within the radius collides in some table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import hot_lookup, saved, small_batches
from .components import connected_components

BITS = 64


def fingerprint(text: str | None, shingle: int = 3, seed: int = 42, block: int = 8192) -> int:
    """SimHash of one text: ASCII lower case, words between ASCII white space, word shingles.

    Null, empty and blank texts give zero; fewer words than ``shingle`` make
    one shingle of them all.  Votes are added up in blocks, so a text of any
    length needs bounded memory beside its own bytes.
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z, and 0x20 and 0x09 to 0x0D
    if not words:
        return 0
    line = b" ".join(words)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    starts = (ends - sizes).tolist()
    stops = ends[shingle - 1 :].tolist() or [len(line)]
    view, digest = memoryview(line), xxhash.xxh64_intdigest
    votes = np.zeros(BITS, np.int64)
    for i in range(0, len(stops), block):
        some = stops[i : i + block]
        votes += _votes(np.array([digest(view[s:e], seed) for s, e in zip(starts[i : i + block], some, strict=False)], np.uint64))
    return _bits(votes, len(stops))


def _votes(hashes: np.ndarray) -> np.ndarray:
    return np.unpackbits(hashes.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)


def _bits(votes: np.ndarray, n: int) -> int:
    return int.from_bytes(np.packbits(votes * 2 > n).tobytes(), "big")


def majority(hashes: np.ndarray, block: int = 8192) -> int:
    """The fingerprint of a text's hashes, repeats included; none: zero."""
    votes = np.zeros(BITS, np.int64)
    for i in range(0, len(hashes), block):
        votes += _votes(hashes[i : i + block])
    return _bits(votes, len(hashes))


def _fingerprints(shingle: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            prints = np.array([fingerprint(t, shingle, seed) for t in batch.column(1).to_pylist()], np.uint64).view(np.int64)
            yield pa.record_batch([batch.column(0), pa.array(prints)], ["id", "fp"])

    return run


def masks(radius: int) -> list[int]:
    """The 2^(radius+1) - 1 covering masks over 64 bits, as signed longs."""
    top = 2 ** (radius + 1)
    out = []
    for v in range(1, top):
        kept = sum(1 << i for i in range(BITS) if (((1 + i % (top - 1)) & v).bit_count() & 1))
        out.append(kept - 2**BITS if kept >= 2 ** (BITS - 1) else kept)
    return out


def near_links(prints: DataFrame, radius: int = 2, pair_limit: int = 48, rows: int | None = None) -> DataFrame:
    """Links between distinct fingerprints (column ``fp``): at least enough of them to connect all that are within ``radius``.

    A bucket of up to ``pair_limit`` distinct fingerprints is compared pair by
    pair.  A larger one isn't: each member is filed under itself and under
    itself with one more bit flipped, for the bits that the bucket's mask
    leaves out (members of a bucket differ only there).  Two of them share a
    file just if they differ in at most two bits, so this is exact as well,
    with rows in proportion to the members.  It holds for radius 2 only; other
    radii always compare by pairs.  ``rows``: number of fingerprints, if known.
    """
    tables = F.array(*[F.struct(F.lit(t).cast("byte").alias("t"), F.lit(m).cast("long").alias("mask")) for t, m in enumerate(masks(radius))])
    filed = prints.select("fp", F.inline(tables)).select("t", F.col("fp").bitwiseAND(F.col("mask")).alias("key"), "fp", "mask")
    sizes = saved(filed.groupBy("t", "key").agg(F.count("*").alias("n")).where("n > 1"), rows=rows and 3 * rows)
    members = saved(filed.join(sizes, ["t", "key"]), rows=rows and 7 * rows)
    if radius != 2:
        pair_limit = 2**62
    small = members.where(F.col("n") <= pair_limit)
    other = small.select("t", "key", F.col("fp").alias("fp2"))
    pairs = small.select("t", "key", "fp").join(other, ["t", "key"]).where("fp < fp2").where(F.bit_count(F.col("fp").bitwiseXOR(F.col("fp2"))) <= radius)
    pairs = pairs.select(F.col("fp").alias("a"), F.col("fp2").alias("b")).distinct()
    if radius != 2:
        return pairs
    flips = F.array(F.lit(0).cast("long"), *[F.lit((1 << i) - (2**BITS if i == BITS - 1 else 0)).cast("long") for i in range(BITS)])
    large = members.where(F.col("n") > pair_limit).select("t", "key", "fp", F.explode(F.filter(flips, lambda x: x.bitwiseAND(F.col("mask")) == 0)).alias("flip"))
    large = large.select("t", F.col("fp").bitwiseXOR(F.col("flip")).alias("near"), "fp")
    # a file holds at most 65 fingerprints: itself and its neighbours at one bit
    files = large.groupBy("t", "near").agg(F.min("fp").alias("a"), F.collect_set("fp").alias("all")).where(F.size("all") > 1)
    stars = files.select("a", F.explode("all").alias("b")).where("a <> b").distinct()
    return pairs.unionByName(stars)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, radius: int = 2, seed: int = 42) -> DataFrame:
    """One row per document: ``id``, ``fp`` (signed long) and ``component``, the smallest id reachable by links.

    Exact copies fall together as one fingerprint before any table is built,
    so a group of copies of any size costs one entry.  Null and blank texts
    share fingerprint zero, and are linked like any other.  Repeated rows give
    repeated results; a null id is kept and never the name of a component
    unless its whole component has no other id.  Other columns are ignored, so
    their names can't clash.  An empty table gives an empty result.
    """
    rows = saved(docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(_fingerprints(shingle, seed), f"id {dict(docs.select(id_col).dtypes)[id_col]}, fp long"))
    n = rows.count()
    prints = saved(rows.groupBy("fp").agg(F.min("id").alias("least"), F.count("*").alias("n")), rows=n)
    links = saved(near_links(prints, radius, rows=n), rows=7 * n)
    m = links.count()
    return named_rows(rows, prints, saved(connected_components(links, rows=m), rows=2 * m), n)


def named_rows(rows: DataFrame, prints: DataFrame, labels: DataFrame, n: int) -> DataFrame:
    """``rows`` (id, fp) with the smallest id of their component; ``prints``: fp, least, n; ``labels``: node, component."""
    named = prints.join(labels.select(F.col("node").alias("fp"), "component"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    named = saved(named, rows=n)
    ids = named.groupBy("component").agg(F.min("least").alias("smallest"))
    table = saved(named.join(ids, "component").select("fp", "n", F.col("smallest").alias("component")), rows=n)
    return hot_lookup(rows, table, "fp", "n", n).select("id", "fp", "component")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` with the smallest id of their component, all columns kept.

    Of rows that repeat this very id, one stays.  Rows with a null id stay.
    """
    return keep_found(docs, near_duplicates(docs, id_col, text_col, **options), id_col)


def keep_found(docs: DataFrame, found: DataFrame, id_col: str) -> DataFrame:
    """What ``keep_one`` keeps, given ``found`` with ``id`` and ``component``."""
    keep = saved(found.where("id = component").select(F.col("id").alias(id_col)).distinct(), rows=found.count())
    kept = docs.join(keep.hint("merge"), id_col, "left_semi")  # alike at every size: never a broadcast of ids
    again = kept.groupBy(id_col).count().where("count > 1").limit(1).count()
    if again:
        kept = kept.dropDuplicates([id_col])
    return kept.unionByName(docs.where(F.col(id_col).isNull()))
