"""URL filter: host and path rules, and for all other URLs a character language-model ratio.

The URLs that a rule accepts or rejects are the two training sets.  For each
set the whole table's characters are counted in contexts of 0 to ``order``
bytes; each context length is smoothed towards the next shorter one.  A URL's
score is the difference of the two mean log-likelihoods per byte; the cut is
calibrated on rule-decided URLs that weren't counted.

Counts are a table with one row a context and one a context with its next
byte, so they are exact and grow with the corpus.  It is never broadcast: a
block of URLs asks for each count it needs once, by a join.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, saved


@dataclass(frozen=True)
class Rule:
    host: str
    path: str
    allow: bool

    @property
    def name(self) -> str:
        return self.host + self.path


#: The rules of the production query: host, path.
RULES = (
    Rule("org", "/", True),
    Rule("example.org", "/es/", False),
    Rule("example.org", "/en/1", False),
    Rule("com", "/fr/", True),
    Rule("com", "/de/", False),
)


def host_of(url: Column) -> Column:
    return ascii_lower(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_for(host: Column, path: Column, rules=RULES) -> Column:
    """Index of the longest rule that fits (of equal ones the one with the longer host, then the first), else null."""
    out = None
    for i, r in sorted(enumerate(rules), key=lambda x: (-len(x[1].name), -len(x[1].host), x[0])):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        out = F.when(fits, F.lit(i)) if out is None else out.when(fits, F.lit(i))
    return F.lit(None).cast("int") if out is None else out


START, END = 0xFF, 0xFE  # bytes that UTF-8 never has
MOST_ORDER = 6


def places(urls: list[bytes], order: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys of the context and of the context with its byte, at each byte (end mark included) and context length, and the number of the URL that each byte is in.

    A key is the bytes themselves, then the context's length and which of the
    two it is: whole numbers below 2^60, so none is shared.
    """
    pad = bytes([START]) * order
    data = np.frombuffer(b"".join(pad + u + bytes([END]) for u in urls), np.uint8).astype(np.int64)
    sizes = np.array([len(u) + 1 + order for u in urls], np.int64)
    of = np.repeat(np.arange(len(urls)), sizes)
    first = np.repeat(np.cumsum(sizes) - sizes, sizes)
    at = np.flatnonzero(np.arange(len(data)) - first >= order)
    context = np.zeros(len(at), np.int64)
    contexts, grams = np.empty((order + 1, len(at)), np.int64), np.empty((order + 1, len(at)), np.int64)
    for k in range(order + 1):
        if k:
            context = context | data[at - k] << 8 * (k - 1)
        contexts[k] = context << 4 | k << 1
        grams[k] = (context << 8 | data[at]) << 4 | k << 1 | 1
    return contexts, grams, of[at]


def _parts(urls: list[str | None], rows: int = 2000, size: int = 1 << 18) -> Iterator[list[bytes]]:
    """URLs as bytes, so many rows or bytes at a time."""
    part, n = [], 0
    for u in urls:
        part.append((u or "").encode())
        n += len(part[-1])
        if len(part) >= rows or n >= size:
            yield part
            part, n = [], 0
    if part:
        yield part


def _counting(order: int, most: int = 4_000_000):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, n = [], 0

        def summed() -> tuple[np.ndarray, np.ndarray]:
            keys, inverse = np.unique(np.concatenate([k for k, _ in waiting]), return_inverse=True)
            return keys, np.bincount(inverse, np.concatenate([c for _, c in waiting])).astype(np.int64)

        def rows() -> Iterator[pa.RecordBatch]:
            keys, c = summed()
            for i in range(0, len(keys), 50_000):
                k = keys[i : i + 50_000]
                yield pa.record_batch([pa.array(k >> 1), pa.array((k & 1).astype(np.int32)), pa.array(c[i : i + 50_000])], ["key", "allow", "n"])

        for batch in batches:
            urls, allow = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for label in (0, 1):
                for part in _parts([u for u, a in zip(urls, allow, strict=True) if a == label]):
                    contexts, grams, _ = places(part, order)
                    waiting.append(np.unique(np.concatenate([contexts, grams]).reshape(-1) << 1 | label, return_counts=True))
                    n += len(waiting[-1][0])
                    if n >= most:
                        waiting = [summed()]
                        n = len(waiting[0][0])
                        if n >= most // 2:
                            yield from rows()
                            waiting, n = [], 0
        if waiting:
            yield from rows()

    return run


def counts(labelled: DataFrame, order: int = 5) -> DataFrame:
    """``key, rejected, accepted``: how often each context, and each context with its next byte, stands in all of ``labelled`` (url, allow 0/1)."""
    found = labelled.select("url", "allow").mapInArrow(_counting(order), "key long, allow int, n long")
    side = lambda a: F.sum(F.when(F.col("allow") == a, F.col("n")).otherwise(0))
    return found.groupBy("key").agg(side(0).alias("rejected"), side(1).alias("accepted"))


def likelihoods(urls: list[bytes], keys: np.ndarray, table: np.ndarray, order: int, strength: float = 2.0) -> np.ndarray:
    """Mean log-likelihood per byte (end mark included) under either class: [class, url]; ``table``: counts [class, key] of the sorted ``keys``."""
    contexts, grams, of = places(urls, order)

    def known(wanted: np.ndarray) -> np.ndarray:
        if not len(keys):
            return np.zeros((2, *wanted.shape))
        at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
        return np.where(keys[at] == wanted, table[:, at], 0)

    whole, here, n = known(contexts), known(grams), np.bincount(of, minlength=len(urls))
    out = np.zeros((2, len(urls)))
    for c in (0, 1):
        p = np.full(len(of), 1 / 256)
        for k in range(order + 1):
            p = (here[c, k] + strength * p) / (whole[c, k] + strength)
        out[c] = np.bincount(of, np.log(p), minlength=len(urls)) / n
    return out


def _asking(order: int):
    def run(rows: pa.Table) -> pa.Table:
        found = np.zeros(0, np.int64)
        for part in _parts(rows["url"].to_pylist()):
            contexts, grams, _ = places(part, order)
            found = np.union1d(found, np.unique(np.concatenate([contexts, grams])))
        return pa.table([pa.array(np.full(len(found), rows["block"][0].as_py(), np.int64)), pa.array(found)], ["block", "key"])

    return run


def _scoring(order: int):
    def run(rows: pa.Table, known: pa.Table) -> pa.Table:
        keys = known["key"].to_numpy().astype(np.int64)
        at = np.argsort(keys)
        table = np.stack([known[c].to_numpy()[at] for c in ("rejected", "accepted")]).astype(float)
        scored, ratio = [], np.full(rows.num_rows, np.nan)
        wanted = np.flatnonzero(rows["scored"].to_numpy(zero_copy_only=False)) if rows.num_rows else np.zeros(0, np.int64)
        for part in _parts(rows["url"].take(pa.array(wanted)).to_pylist()):
            rejected, accepted = likelihoods(part, keys[at], table, order)
            scored.append(accepted - rejected)
        if scored:
            ratio[wanted] = np.concatenate(scored)
        return rows.select(["id", "host", "path", "rule", "allow", "held"]).append_column("ratio", pa.array(ratio, mask=np.isnan(ratio)))

    return run


def _best_cut(bins) -> float:
    """The cut with the best balanced accuracy; of equal ones the nearest to 0."""
    seen = np.zeros((2, 2001))
    for r in bins:
        seen[r["allow"], r["bin"] + 1000] = r["count"]
    if not seen[0].sum() or not seen[1].sum():
        return 0.0
    below = np.concatenate([np.zeros((2, 1)), np.cumsum(seen, axis=1)], axis=1)
    right = below[0] / below[0, -1] + 1 - below[1] / below[1, -1]
    cuts = (np.arange(2002) - 1000) / 100
    best = np.flatnonzero(right >= right.max() - 1e-12)
    return float(cuts[best[np.argmin(np.abs(cuts[best]))]])


def judge_urls(pages: DataFrame, rules=RULES, id_col: str = "page_id", url_col: str = "url", order: int = 5, block_rows: int = 1 << 15) -> DataFrame:
    """One row per row of ``pages``: ``id, host, path, rule, verdict, ratio``.

    Null URLs and those without ``://`` have an empty host and path and fit no
    rule.  ``ratio`` is the log-likelihood difference less the calibrated cut,
    where no rule fits (null urls as empty ones); it decides there (0 or more:
    allow).  If the rules leave one of the two training sets empty, as in an
    empty table, those rows are allowed and ``ratio`` is null.  Repeated rows
    give repeated results; other columns aren't read; a URL of any length is
    taken whole.
    """
    if not 0 <= order <= MOST_ORDER:
        raise ValueError(f"contexts of 0 to {MOST_ORDER} bytes")
    url = F.col(url_col).cast("string")
    rows = pages.select(F.col(id_col).alias("id"), url.alias("url"), host_of(url).alias("host"), path_of(url).alias("path"))
    rows = rows.withColumn("n", rule_for(F.col("host"), F.col("path"), rules))
    allows = F.array(*[F.lit(int(r.allow)) for r in rules]) if rules else F.array().cast("array<int>")
    names = F.array(*[F.lit(r.name) for r in rules]) if rules else F.array().cast("array<string>")
    rows = rows.withColumn("rule", F.get(names, F.col("n"))).withColumn("allow", F.get(allows, F.col("n"))).drop("n")
    # a fifth of the decided URLs calibrates the cut; a block is a run of rows of one partition
    rows = rows.withColumn("held", F.col("allow").isNotNull() & (F.crc32(F.col("url").cast("binary")) % 5 == 0))
    rows = saved(rows.withColumn("scored", F.col("allow").isNull() | F.col("held")).withColumn("block", F.floor(F.monotonically_increasing_id() / block_rows)))
    labelled = rows.where("allow is not null and not held")
    kinds = dict(rows.dtypes)
    if labelled.agg(F.count_distinct("allow")).first()[0] < 2:
        allow = F.coalesce("allow", F.lit(1))
        return rows.select("id", "host", "path", "rule", F.when(allow == 1, "allow").otherwise("block").alias("verdict"), F.lit(None).cast("double").alias("ratio"))
    asked = rows.where("scored").select("block", "url").groupBy("block").applyInArrow(_asking(order), "block long, key long")
    known = asked.join(counts(labelled, order), "key").groupBy("block")
    schema = f"id {kinds['id']}, host string, path string, rule string, allow int, held boolean, ratio double"
    scored = saved(rows.groupBy("block").cogroup(known).applyInArrow(_scoring(order), schema))
    bins = scored.where("held").groupBy("allow", F.greatest(F.lit(-1000), F.least(F.lit(1000), F.floor(F.col("ratio") * 100))).cast("int").alias("bin")).count().collect()
    ratio = F.when(F.col("allow").isNull(), F.col("ratio") - F.lit(_best_cut(bins)))
    allow = F.coalesce(F.col("allow"), F.when(ratio >= 0, 1).otherwise(0))
    return scored.select("id", "host", "path", "rule", F.when(allow == 1, "allow").otherwise("block").alias("verdict"), ratio.alias("ratio"))
