"""Approximate nearest neighbours by balanced posting lists.

Centroids of a balanced clustering stand in an in-memory neighbour graph.
Every vector is filed under its nearest centroid and, near a boundary, under
further ones.  A query walks the graph, takes all lists whose centroid is
within a distance ratio of the nearest one, and scans them exactly.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from heapq import heappop, heappush

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import saved
from .vectors import keyed, matrix


@dataclass
class Index:
    """Centroids of lifted vectors, their graph and the tree that names a walk's first node; its size is bounded by the sample's."""

    centroids: np.ndarray
    neighbours: np.ndarray  # padded with the node itself
    normals: np.ndarray  # the tree's inner nodes: a row goes right where its product is over the cut
    cuts: np.ndarray
    children: np.ndarray  # an inner node, or -1 - leaf
    top: float  # largest squared norm
    ratio: float
    sample: np.ndarray
    sample_ids: np.ndarray

    def lift(self, x: np.ndarray, query: bool = False) -> np.ndarray:
        """One more component makes all norms equal, so that the largest inner product is the least distance."""
        extra = np.zeros(len(x)) if query else np.sqrt(np.maximum(self.top - (x * x).sum(1), 0))
        return np.column_stack([x, extra])

    def entry(self, q: np.ndarray) -> np.ndarray:
        """A centroid near each row: the leaf that the clustering tree puts it in."""
        if not len(self.normals):
            return np.zeros(len(q), np.int64)
        at = np.zeros(len(q), np.int64)
        open_ = np.arange(len(q))
        while len(open_):
            node = at[open_]
            right = np.einsum("ij,ij->i", q[open_], self.normals[node]) > self.cuts[node]
            at[open_] = self.children[node, right.astype(np.int64)]
            open_ = open_[at[open_] >= 0]
        return -1 - at

    def nearest(self, q: np.ndarray, many: int, beam: int = 8) -> tuple[np.ndarray, np.ndarray]:
        """Distances and numbers of the ``many`` nearest centroids of each row, by a walk of all rows at once.

        Each row keeps its ``beam`` best nodes; the best one not yet opened is
        opened until none is left.
        """
        width = min(max(beam, many), len(self.centroids))
        rows = np.arange(len(q))
        ids = np.full((len(q), width), -1)
        dist = np.full((len(q), width), np.inf)
        done = np.ones((len(q), width), bool)
        ids[:, 0] = self.entry(q)
        dist[:, 0] = ((self.centroids[ids[:, 0]] - q) ** 2).sum(1)
        done[:, 0] = False
        while len(rows := np.flatnonzero(~done.all(1))):
            first = (~done[rows]).argmax(1)
            done[rows, first] = True
            near = self.neighbours[ids[rows, first]]
            seen = (near[:, :, None] == ids[rows][:, None, :]).any(2)
            seen[:, 1:] |= near[:, 1:] == near[:, :-1]  # padding repeats a node; neighbours are sorted
            far = self.centroids[near] - q[rows][:, None, :]
            d = np.where(seen, np.inf, np.einsum("ijk,ijk->ij", far, far))
            all_d, all_i = np.concatenate([dist[rows], d], 1), np.concatenate([ids[rows], near], 1)
            all_done = np.concatenate([done[rows], np.isinf(d)], 1)
            best = np.argsort(all_d, axis=1, kind="stable")[:, :width]
            dist[rows], ids[rows], done[rows] = (np.take_along_axis(x, best, 1) for x in (all_d, all_i, all_done))
        return np.sqrt(dist[:, :many]), ids[:, :many]

    def search(self, q: np.ndarray, start: int, ratio: float, least: int) -> list[tuple[float, int]]:
        """(distance, centroid) of all within ``ratio`` of the nearest, at least ``least`` of them, nearest first.

        Best-first walk from ``start``, which ends once the closest open node
        is outside the ratio and ``least`` nearer ones are known.
        """
        first = float(np.sqrt(((self.centroids[start] - q) ** 2).sum()))
        open_, seen, found = [(first, start)], {start}, []
        best, outside = first, 0
        while open_:
            d, i = heappop(open_)
            if d > best * ratio and len(found) >= least:
                outside += 1
                if outside > 16:  # a few steps beyond the edge, as the graph is not monotone
                    break
            found.append((d, i))
            best = min(best, d)
            fresh = [j for j in self.neighbours[i].tolist() if j not in seen]
            if fresh:
                seen.update(fresh)
                for e, j in zip(np.sqrt(((self.centroids[fresh] - q) ** 2).sum(1)).tolist(), fresh, strict=True):
                    heappush(open_, (e, j))
        found.sort()
        keep = sum(d <= best * ratio for d, _ in found)
        return found[: max(keep, min(least, len(found)))]


def balanced_clusters(x: np.ndarray, leaves: int, seed: int = 5) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Leaf number of each row, and the tree (normals, cuts, children): halves at the median between two centres, again and again, so that sizes differ little."""
    rng, out = np.random.default_rng(seed), np.zeros(len(x), np.int64)
    normals, cuts, children = [], [], []
    todo, n = [(np.arange(len(x)), leaves, None)], 0
    while todo:
        rows, want, up = todo.pop()
        inner = want > 1 and len(rows) > 1
        if up is not None:
            children[up[0]][up[1]] = len(normals) if inner else -1 - n
        if not inner:
            out[rows], n = n, n + 1
            continue
        a, b = x[rows[rng.integers(len(rows))]], x[rows[rng.integers(len(rows))]]
        for _ in range(6):
            side = x[rows] @ (b - a) > (b @ b - a @ a) / 2
            if side.all() or not side.any():
                break
            a, b = x[rows[~side]].mean(0), x[rows[side]].mean(0)
        left = want // 2
        along = x[rows] @ (b - a)
        order = np.argsort(along, kind="stable")
        cut = max(1, min(len(rows) - 1, round(len(rows) * left / want)))
        here = len(normals)
        normals.append(b - a)
        cuts.append((along[order[cut - 1]] + along[order[cut]]) / 2)
        children.append([0, 0])
        todo += [(rows[order[cut:]], want - left, (here, 1)), (rows[order[:cut]], left, (here, 0))]
    return out, np.array(normals).reshape(len(normals), x.shape[1]), np.array(cuts), np.array(children, np.int64).reshape(-1, 2)


def linked(near: np.ndarray, degree: int) -> np.ndarray:
    """Neighbours of each node, sorted and padded with the node itself: its nearest ones, those that name it as far as ``degree`` has room, and its place in a ring (which keeps the graph whole)."""
    m = len(near)
    named: list[list[int]] = [[] for _ in range(m)]
    for place in range(near.shape[1]):  # closest links first
        for i in range(m):
            if len(named[near[i, place]]) < degree:
                named[near[i, place]].append(i)
    links = [sorted({*near[i].tolist(), *named[i], (i + 1) % m} - {i}) for i in range(m)]
    wide = max(map(len, links))
    return np.array([s + [s[-1] if s else i] * (wide - len(s)) for i, s in enumerate(links)], np.int64).reshape(m, wide)


def build_index(sample: np.ndarray, ids: np.ndarray, top: float, lists: int, k: int = 20, degree: int = 16, target: float = 0.97, replicas: int = 2, edge: float = 1.1) -> Index:
    """Cluster the sample, link each centroid with its nearest ones, and fit the pruning ratio.

    A node has 2 * ``degree`` + 1 links at most.  The ratio is the smallest that
    finds ``target`` of the sample's own nearest neighbours; the whole table's
    are closer, so it errs to the safe side.
    """
    none = np.zeros((0, sample.shape[1] + 1))
    index = Index(none, none, none, none, none, top, 1.0, sample, ids)
    lifted = index.lift(sample)
    leaf, index.normals, index.cuts, index.children = balanced_clusters(lifted, max(1, min(lists, len(sample))))
    m = leaf.max() + 1
    order = np.argsort(leaf, kind="stable")
    starts = np.searchsorted(leaf[order], np.arange(m))
    index.centroids = np.add.reduceat(lifted[order], starts) / np.diff(np.r_[starts, len(leaf)])[:, None]
    norms = (index.centroids**2).sum(1)
    near = np.zeros((m, min(degree, m - 1)), np.int64)
    for i in range(0, m if m > 1 else 0, 1024):
        d = norms[None, :] - 2 * index.centroids[i : i + 1024] @ index.centroids.T
        d[np.arange(len(d)), i + np.arange(len(d))] = np.inf
        some = np.argpartition(d, near.shape[1] - 1, axis=1)[:, : near.shape[1]]
        near[i : i + 1024] = np.take_along_axis(some, np.argsort(np.take_along_axis(d, some, 1), axis=1, kind="stable"), 1)
    index.neighbours = linked(near, degree)
    rng = np.random.default_rng(3)
    some = rng.choice(len(sample), min(400, len(sample)), replace=False)
    products = sample[some] @ sample.T
    products[np.arange(len(some)), some] = -np.inf
    near = np.argsort(-products, axis=1, kind="stable")[:, : min(k, len(sample) - 1)]
    if near.size:
        q = index.lift(sample[some], True)
        to = np.sqrt(np.maximum((q**2).sum(1)[:, None] - 2 * q @ index.centroids.T + norms[None, :], 0))
        wanted, place = np.unique(near, return_inverse=True)
        row, filed, _ = lists_of(index, lifted[wanted], replicas, edge)
        best = np.full((len(some), len(wanted)), np.inf)
        for at, c in zip(row.tolist(), filed.tolist(), strict=True):
            best[:, at] = np.minimum(best[:, at], to[:, c])
        need = np.take_along_axis(best, place.reshape(near.shape), 1) / np.maximum(to.min(1), 1e-12)[:, None]
        index.ratio = float(np.quantile(need, target)) + 1e-9
    return index


def lists_of(index: Index, lifted: np.ndarray, replicas: int, edge: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, list and whether it is the row's own one: the nearest centroid's, and further ones within ``edge`` times its distance, ``replicas`` at most."""
    d, c = index.nearest(lifted, replicas)
    there = np.isfinite(d) & (d <= d[:, :1] * edge)
    there[:, 0] = True
    row, nth = np.nonzero(there)
    return row, c[row, nth], nth == 0


def _filing(shared, replicas: int, edge: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        for batch in batches:
            for s in range(0, batch.num_rows, 1000):
                part = batch.slice(s, 1000)
                row, where, own = lists_of(index, index.lift(matrix(part.column(1))), replicas, edge)
                out = part.take(pa.array(row))
                yield pa.record_batch([out.column(0), out.column(1), pa.array(where.astype(np.int32)), pa.array(own)], ["id", "vec", "list", "own"])

    return run


def _asking(shared, sizes: np.ndarray, k: int):
    """Lists of each query, a floor under its k-th score, and (on its first row) its k best of the sample."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        for batch in batches:
            for s in range(0, batch.num_rows, 500):
                part = batch.slice(s, 500)
                x, ids = matrix(part.column(1)), part.column(0).to_numpy()
                products = x @ index.sample.T
                products[ids[:, None] == index.sample_ids[None, :]] = -np.inf
                floor_ = np.full(len(x), -np.inf)
                if len(index.sample) > k:
                    floor_ = np.partition(products, -k, axis=1)[:, -k]
                floor_ = floor_ - 1e-9 * (1 + np.abs(floor_))
                i, j = np.nonzero((products >= floor_[:, None]) & np.isfinite(products))
                score = np.concatenate([(x[i[a : a + 100_000]] * index.sample[j[a : a + 100_000]]).sum(1) for a in range(0, len(i), 100_000)] or [np.zeros(0)])
                i, best, score = _best(i, index.sample_ids[j], score, k)
                where = []
                lifted = index.lift(x, True)
                for q, start in zip(lifted, index.entry(lifted).tolist(), strict=True):
                    least = 1
                    found = index.search(q, start, index.ratio, least)
                    # lists must hold k candidates besides the query itself; each row has one own list
                    while sizes[[c for _, c in found]].sum() <= k and len(found) < len(sizes):
                        least = min(2 * max(least, len(found)), len(sizes))
                        found = index.search(q, start, index.ratio, least)
                    where.append([c for _, c in found])
                rows = np.repeat(np.arange(len(where)), [len(w) for w in where])
                first = np.r_[True, rows[1:] != rows[:-1]] if len(rows) else np.zeros(0, bool)
                held = np.zeros(len(rows), np.int64)
                held[first] = np.bincount(i, minlength=len(x))
                cut = pa.array(np.r_[0, np.cumsum(held)].astype(np.int32))
                known = pa.StructArray.from_arrays([pa.array(best), pa.array(score)], ["vec_id", "score"])
                out = part.take(pa.array(rows))
                yield pa.record_batch([out.column(0), out.column(1), pa.array(floor_[rows]), pa.array(np.concatenate(where).astype(np.int32)), pa.ListArray.from_arrays(cut, known)], ["id", "vec", "floor", "list", "known"])

    return run


def _scan(k: int):
    def run(postings: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        none = pd.DataFrame({"query_id": np.zeros(0, np.int64), "vec_id": np.zeros(0, np.int64), "score": np.zeros(0)})
        if not len(postings) or not len(asked):
            return none
        ids = postings["id"].to_numpy()
        x = np.stack(postings["vec"].to_numpy()).astype(np.float64)
        order = np.argsort(ids, kind="stable")
        ids, x = ids[order], x[order]
        # of equal vectors only the k + 1 smallest ids can be among a query's k best
        _, same = np.unique(x, axis=0, return_inverse=True)
        by = np.argsort(same.reshape(-1), kind="stable")
        start = np.r_[0, np.flatnonzero(np.diff(same.reshape(-1)[by])) + 1]
        nth = np.arange(len(by)) - np.repeat(start, np.diff(np.r_[start, len(by)]))
        keep = np.sort(by[nth <= k])
        ids, x = ids[keep], x[keep]
        out = []
        for s in range(0, len(asked), 256):
            part = asked.iloc[s : s + 256]
            q, own, least = np.stack(part["vec"].to_numpy()).astype(np.float64), part["id"].to_numpy(), part["floor"].to_numpy()
            near = (q @ x.T >= least[:, None]) & (own[:, None] != ids[None, :])
            i, j = np.nonzero(near)
            for a in range(0, len(i), 200_000):
                cut = slice(a, a + 200_000)
                out.append((own[i[cut]], ids[j[cut]], (q[i[cut]] * x[j[cut]]).sum(1)))
                if len(i) > 200_000:
                    out[-1] = _best(*out[-1], k)
        if not out:
            return none
        return pd.DataFrame(dict(zip(("query_id", "vec_id", "score"), _best(*(np.concatenate(c) for c in zip(*out, strict=True)), k), strict=True)))

    return run


def _best(query: np.ndarray, vec: np.ndarray, score: np.ndarray, k: int) -> tuple:
    """The k best of each query: highest score, then smaller id."""
    order = np.lexsort((vec, -score, query))
    query, vec, score = query[order], vec[order], score[order]
    start = np.r_[0, np.flatnonzero(np.diff(query)) + 1] if len(query) else np.zeros(0, int)
    nth = np.arange(len(query)) - np.repeat(start, np.diff(np.r_[start, len(query)]))
    return query[nth < k], vec[nth < k], score[nth < k]


def search(embeddings: DataFrame, is_query, k: int = 20, id_col: str = "vec_id", vec_col: str = "embedding", list_rows: int = 256, sample_rows: int = 20_000, max_lists: int = 32_768, replicas: int = 2, edge: float = 1.1, block: int = 4096) -> DataFrame:
    """``query_id, rank, vec_id, score`` for each row for which the column ``is_query`` (of ``id``) holds: its k nearest by inner product.

    All rows are indexed; only centroids, graph and pruning ratio are fitted on
    a sample, chosen by a hash of the id: ``sample_rows`` rows, or four a list
    where that is more.  There is a list for every ``list_rows`` rows up to
    ``max_lists``, which bounds the index in memory; beyond that lists grow,
    and are cut into parts.  Scores are double precision on the original
    vectors, ties go to the smaller id, the query's own id is left out.
    Vectors that are null, empty, zero or hold null or non-finite components
    take no part, nor do those whose length isn't the table's most common one,
    nor null ids.  Of rows that repeat an id the one with the smallest digest
    of its vector counts.  An empty table gives an empty result.

    A list of more than ``block`` rows is cut into parts of about that size,
    its queries likewise; each part yields at most k candidates a query.  The
    sample's own k best are candidates of every query, so that there are never
    fewer than k (or all rows, if fewer); they also set a floor under its k-th
    best score, which drops only what can't be among the k best.
    """
    spark = embeddings.sparkSession
    rows = saved(keyed(embeddings, id_col, vec_col).where("key is not null and id is not null"))
    lengths = {r["d"]: r["n"] for r in rows.groupBy(F.size("vec").alias("d")).agg(F.count("*").alias("n")).collect()}
    schema = "query_id long, rank int, vec_id long, score double"
    if not lengths:
        return spark.createDataFrame([], schema)
    d = max(lengths, key=lambda x: (lengths[x], x))
    rows = rows.where(F.size("vec") == d).select(F.col("id").cast("long").alias("id"), "vec", "key")
    if rows.groupBy("id").count().where("count > 1").limit(1).count():
        rows = saved(rows.groupBy("id").agg(F.min_by(F.struct("vec", "key"), "key").alias("one")).select("id", "one.vec", "one.key"))
    n = rows.count()
    square = F.aggregate("vec", F.lit(0.0), lambda a, v: a + v.cast("double") * v.cast("double"))
    top = rows.agg(F.max(square).alias("t")).first()["t"]
    lists = min(max_lists, max(1, n // list_rows))
    sample_rows = max(sample_rows, 4 * lists)
    share = min(1.0, 1.05 * sample_rows / n)
    picked = rows.where(F.pmod(F.xxhash64("id"), F.lit(2**40)) < int(share * 2**40) + 1).select("id", "vec").limit(2 * sample_rows).toArrow().sort_by("id").slice(0, sample_rows)
    index = build_index(matrix(picked["vec"].combine_chunks()), picked["id"].to_numpy(), float(top), lists, k, replicas=replicas, edge=edge)
    shared = spark.sparkContext.broadcast(index)
    kind = dict(rows.dtypes)["vec"]
    filed = saved(rows.select("id", "vec").mapInArrow(_filing(shared, replicas, edge), f"id long, vec {kind}, list int, own boolean"))
    held = filed.groupBy("list").agg(F.count("*").alias("n"), F.count(F.when(F.col("own"), 1)).alias("own")).collect()  # max_lists rows at most
    sizes, owns = np.zeros(len(index.centroids), np.int64), np.zeros(len(index.centroids), np.int64)
    for r in held:
        sizes[r["list"]], owns[r["list"]] = r["n"], r["own"]
    known = "known array<struct<vec_id:bigint,score:double>>"
    asked = saved(rows.where(is_query(F.col("id"))).select("id", "vec").mapInArrow(_asking(shared, owns, k), f"id long, vec {kind}, floor double, list int, {known}"))
    asks = {r["list"]: r["n"] for r in asked.groupBy("list").agg(F.count("*").alias("n")).collect()}
    plan = [(c, int(-(-sizes[c] // block) or 1), -(-asks[c] // block)) for c in asks]
    plan = F.broadcast(spark.createDataFrame(plan, "list int, parts int, shares int")) if plan else None
    if plan is None:
        return spark.createDataFrame([], schema)
    first = asked.select(F.col("id").alias("query_id"), F.inline("known"))
    salt = lambda what, many: F.pmod(F.xxhash64("id", F.lit(what)), F.col(many)).cast("int")
    postings = filed.join(plan, "list").select("list", salt(1, "parts").alias("part"), F.explode(F.sequence(F.lit(0), F.col("shares") - 1)).alias("turn"), "id", "vec")
    asked = asked.join(plan, "list").select("list", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), salt(2, "shares").alias("turn"), "id", "vec", "floor")
    key = ["list", "part", "turn"]
    found = postings.groupBy(*key).cogroup(asked.groupBy(*key)).applyInPandas(_scan(k), "query_id long, vec_id long, score double")
    found = found.unionByName(first).groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
