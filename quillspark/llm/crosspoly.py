"""Embedding near-duplicates: cross-polytope hashing after fast Hadamard rotations.

A hash rotates the vector (three rounds of random signs and a Hadamard
transform) and names the closest signed axis.  A table's code joins several
hashes; each vector is also filed under the code with its least certain hash
changed to the runner-up.  Vectors that share a bucket are compared exactly.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import hot_lookup, saved
from .components import connected_components
from .vectors import keyed, matrix

PROBES = 2  # the own code and the runner-up


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of each row (length a power of two), orthonormal."""
    n, d = x.shape
    h = 1
    while h < d:
        y = x.reshape(n, d // (2 * h), 2, h)
        x = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], axis=2).reshape(n, d)
        h *= 2
    return x / math.sqrt(d)


def codes(x: np.ndarray, tables: int, hashes: int, seed: int = 11) -> np.ndarray:
    """Codes [row, table, probe] of the rows of ``x``."""
    n, d = x.shape
    wide = 1 << max(1, (d - 1).bit_length())
    padded = np.zeros((n, wide))
    padded[:, :d] = x / np.linalg.norm(x, axis=1, keepdims=True)
    signs = np.random.default_rng((seed, wide)).choice([-1.0, 1.0], (tables, hashes, 3, wide))
    out, rows = np.empty((n, tables, PROBES), np.int64), np.arange(n)
    for t in range(tables):
        best, second, gap = (np.empty((n, hashes), kind) for kind in (np.int64, np.int64, float))
        for k in range(hashes):
            y = padded
            for s in signs[t, k]:
                y = hadamard(y * s)
            size = np.abs(y)
            a = size.argmax(1)
            top = size[rows, a]
            size[rows, a] = -1
            b = size.argmax(1)
            best[:, k], second[:, k] = 2 * a + (y[rows, a] > 0), 2 * b + (y[rows, b] > 0)
            gap[:, k] = top - size[rows, b]
        weak = gap.argmin(1)
        for p in range(PROBES):
            code = np.full(n, d, np.int64)
            for k in range(hashes):
                axis = np.where((weak == k) & (p == 1), second[:, k], best[:, k])
                code = code * (2 * wide) + axis
            out[:, t, p] = code
    return out


@functools.cache
def hit_rate(wide: int, hashes: int, threshold: float, trials: int = 20_000) -> float:
    """Probability that one table files a pair at ``threshold`` together (either's own code or runner-up), measured on random rotations.

    Only the two coordinates along each axis count, and those of a random
    rotation are nearly independent normals.  It is less three standard errors.
    """
    rng, found, step = np.random.default_rng((5, wide, hashes)), 0, max(1, 2_000_000 // (wide * hashes))
    for i in range(0, trials, step):
        n = min(step, trials - i)
        x = rng.standard_normal((n, hashes, wide))
        y = threshold * x + math.sqrt(1 - threshold**2) * rng.standard_normal((n, hashes, wide))
        sides, rows = [], np.arange(n)
        for z in (x, y):
            size = np.abs(z)
            two = np.argpartition(size, wide - 2, axis=2)[:, :, -2:]
            top = np.take_along_axis(size, two, 2)
            two = np.where((top[:, :, :1] > top[:, :, 1:]), two[:, :, ::-1], two)  # the larger one last
            signed = 2 * two + (np.take_along_axis(z, two, 2) > 0)
            gap = np.abs(top[:, :, 1] - top[:, :, 0])
            own = signed[:, :, 1]
            probe, weak = own.copy(), gap.argmin(1)
            probe[rows, weak] = signed[rows, weak, 0]
            sides.append((own, probe))
        found += int(np.logical_or.reduce([(a == b).all(1) for a in sides[0] for b in sides[1]]).sum())
    p = found / trials
    return max(p - 3 * math.sqrt(max(p * (1 - p), 1 / trials) / trials), 1 / trials)


def table_plan(rows: int, d: int, threshold: float, miss: float = 0.003) -> tuple[int, int]:
    """Tables and hashes a table: hashes grow with log(rows) so that buckets stay small, tables so that a pair at the threshold is missed by ``miss`` at most.

    The probability that one table keeps such a pair together is measured
    (``hit_rate``) for this number of hashes.
    """
    wide = 1 << max(1, (d - 1).bit_length())
    hashes = max(3, math.ceil(math.log(max(rows, 2)) / math.log(2 * wide)))
    hashes = min(hashes, int(55 / math.log2(2 * wide)))
    p = hit_rate(wide, hashes, threshold)
    return max(4, math.ceil(math.log(miss) / math.log1p(-min(p, 0.99)))), hashes


def _coding(tables: int, hashes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = np.array([len(v.values) for v in batch.column(1)])
            for d in np.unique(sizes):
                some = batch.take(pa.array(np.flatnonzero(sizes == d)))
                for i in range(0, some.num_rows, 2000):
                    part = some.slice(i, 2000)
                    c = codes(matrix(part.column(1)), tables, hashes).reshape(part.num_rows, -1)
                    listed = pa.ListArray.from_arrays(np.arange(0, c.size + 1, c.shape[1], dtype=np.int32), c.reshape(-1))
                    yield pa.record_batch([*part.columns, listed], ["id", "vec", "n", "codes"])

    return run


def _first_here(a: np.ndarray, b: np.ndarray, table: int, code: int) -> np.ndarray:
    """Whether this bucket is the first one that each pair shares (so that a pair counts once)."""
    out = np.zeros(len(a), bool)
    for i in range(0, len(a), 20_000):
        x, y = a[i : i + 20_000, : table + 1], b[i : i + 20_000, : table + 1]
        same = (x[:, :, :, None] == y[:, :, None, :]).any(3)  # [pair, table, probe of a]
        first = same.any(2).argmax(1) == table
        least = np.where(same[:, table], x[:, table], np.iinfo(np.int64).max).min(1) == code
        out[i : i + 20_000] = first & least
    return out


def _linked(ids: np.ndarray, x: np.ndarray, n: np.ndarray, own: np.ndarray, c: np.ndarray, key: tuple, threshold: float):
    """Of one block: members with new links, how many rows those reach, and a label that joins what they connect."""
    table, code, left, right = key
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = np.triu(x @ x.T >= threshold, 1)
    if left != right:
        near &= own[:, None] != own[None, :]
    i, j = np.nonzero(near)
    if len(i):
        new = _first_here(c[i], c[j], table, code)
        i, j = i[new], j[new]
    if not len(i):
        return None
    m = len(ids)
    links = np.bincount(i, n[j], m) + np.bincount(j, n[i], m)
    label = np.arange(m)
    while True:
        low = np.minimum(label[i], label[j])
        after = label.copy()
        np.minimum.at(after, i, low)
        np.minimum.at(after, j, low)
        after = after[after]
        if (after == label).all():
            break
        label = after
    some = np.flatnonzero(links)
    return ids[some], links[some].astype(np.int64), ids[label[some]]


def _comparing(threshold: float, tables: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None  # the block that may go on in the next batch
        out: list[tuple] = []

        def emit(table: pa.Table) -> None:
            if not table.num_rows:
                return
            keys = np.stack([table[k].to_numpy().astype(np.int64) for k in ("t", "code", "left", "right")], 1)
            cuts = np.flatnonzero(np.r_[True, (keys[1:] != keys[:-1]).any(1), True])
            ids, n, own = (table[k].to_numpy() for k in ("id", "n", "chunk"))
            c = matrix(table["codes"].combine_chunks(), np.int64).reshape(len(ids), tables, PROBES)
            vec = table["vec"].combine_chunks()
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if b - a > 1 and (found := _linked(ids[a:b], matrix(vec.slice(a, b - a)), n[a:b], own[a:b], c[a:b], tuple(keys[a]), threshold)):
                    out.append(found)

        for batch in batches:
            if not batch.num_rows:
                continue
            new = pa.Table.from_batches([batch])
            table = pa.concat_tables([rest, new]) if rest is not None else new
            last = np.ones(table.num_rows, bool)
            for k in ("t", "code", "left", "right"):
                x = table[k].to_numpy()
                last &= x == x[-1]
            start = int(np.flatnonzero(~last)[-1]) + 1 if not last.all() else 0
            emit(table.slice(0, start))
            rest = table.slice(start)
            if out:
                yield _batch(out)
                out.clear()
        if rest is not None:
            emit(rest)
        if out:
            yield _batch(out)

    return run


def _batch(found: list[tuple]) -> pa.RecordBatch:
    return pa.record_batch([pa.array(np.concatenate([f[k] for f in found])) for k in range(3)], ["id", "links", "label"])


def near_vectors(embeddings: DataFrame, threshold: float = 0.9, id_col: str = "vec_id", vec_col: str = "embedding", block: int = 1024) -> DataFrame:
    """One row per row of ``embeddings``: ``id, n_links, component``.

    Rows with a cosine of at least ``threshold`` (double precision) are linked;
    ``n_links`` counts the other rows linked directly, ``component`` is the
    smallest id reachable.  Vectors that are null, empty, zero or hold null or
    non-finite components link with nothing; lengths never mix.  Equal vectors
    are one class with a weight, so copies aren't compared.  A bucket of over
    ``block`` classes is cut into blocks, and each pair of blocks is one task's
    matrix product; all its pairs are compared, none is emitted (only counts
    and labels per member).  Null ids link with nothing; repeated rows with one id are
    rows like any other.  An empty table gives an empty result.
    """
    rows = saved(keyed(embeddings, id_col, vec_col).withColumn("key", F.when(F.col("id").isNotNull(), F.col("key"))))
    valid = rows.where("key is not null")
    classes = saved(valid.groupBy("key").agg(F.min("id").alias("id"), F.first("vec").alias("vec"), F.count("*").alias("n")))
    facts = classes.agg(F.count("*").alias("m"), F.max(F.size("vec")).alias("d"), F.sum("n").alias("rows")).first()
    tables, hashes = table_plan(facts["m"] or 1, facts["d"] or 2, threshold)
    kinds = dict(classes.dtypes)
    coded = saved(classes.select("id", "vec", "n").mapInArrow(_coding(tables, hashes), f"id {kinds['id']}, vec {kinds['vec']}, n long, codes array<long>"))
    filed = coded.select("id", F.posexplode("codes").alias("at", "code")).select("id", F.floor(F.col("at") / PROBES).cast("int").alias("t"), "code").distinct()
    filed = saved(filed)
    sizes = saved(filed.groupBy("t", "code").agg(F.count("*").alias("size")).where("size > 1").withColumn("chunks", F.ceil(F.col("size") / block).cast("int")))
    members = filed.join(sizes, ["t", "code"]).withColumn("chunk", F.pmod(F.xxhash64("id"), F.col("chunks")).cast("int"))
    members = saved(members.select("id", "t", "code", "chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("other")))
    blocks = members.join(coded, "id").select("t", "code", F.least("chunk", "other").alias("left"), F.greatest("chunk", "other").alias("right"), "id", "n", "chunk", "vec", "codes")
    parts = max(int(embeddings.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    blocks = blocks.repartition(parts, "t", "code", "left", "right").sortWithinPartitions("t", "code", "left", "right")
    found = saved(blocks.mapInArrow(_comparing(threshold, tables), f"id {kinds['id']}, links long, label {kinds['id']}"))
    edges = found.select(F.col("id").alias("a"), F.col("label").alias("b"))
    m = edges.count()
    labels = saved(connected_components(edges, rows=m), rows=2 * m)
    links = found.groupBy("id").agg(F.sum("links").alias("links"))
    named = classes.select("key", "id", "n").join(links, "id", "left").join(labels.withColumnRenamed("node", "id"), "id", "left")
    named = saved(named.select("key", "n", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "id").alias("component")))
    done = hot_lookup(valid.select("id", "key"), named, "key", "n", facts["rows"] or 0).select("id", "n_links", "component")
    alone = rows.where("key is null").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component"))
    return done.unionByName(alone)
