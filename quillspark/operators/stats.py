"""Small-sample statistics over paired scores (M1-M4)."""

from __future__ import annotations

import random
from collections.abc import Iterator
from functools import lru_cache
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RESAMPLES, FLIPS, EXACT = 2000, 20_000, 12


def deltas(pairs: DataFrame, group: str) -> DataFrame:
    """M1: ``group, delta``: baseline less treatment."""
    return pairs.select(group, (F.col("baseline") - F.col("treatment")).alias("delta"))


def percentile(ordered: np.ndarray, q: float) -> float:
    """Linear between order statistics; 0 for none."""
    return float(np.percentile(ordered, 100 * q)) if len(ordered) else 0.0


def _generator(seed: int) -> np.random.MT19937:
    """The generator of ``random.Random(seed)``, whose 32-bit words come in arrays."""
    *key, at = random.Random(seed).getstate()[1]
    words = np.random.MT19937()
    words.state = {"bit_generator": "MT19937", "state": {"key": np.array(key, np.uint32), "pos": at}}
    return words


def resamples(n: int, seed: int, cells: int = 1 << 19) -> Iterator[np.ndarray]:
    """``RESAMPLES`` rows of n draws of ``random.Random(seed).randrange(n)``, in blocks of about ``cells`` draws.

    ``randrange`` takes the leading bits of a word, and the next word while they are n or more.
    """
    words, shift, rows = _generator(seed), np.uint64(32 - n.bit_length()), max(1, cells // n)
    rest = np.empty(0, np.intp)
    for first in range(0, RESAMPLES, rows):
        need = n * min(rows, RESAMPLES - first)
        parts = [rest]
        while (have := sum(map(len, parts))) < need:
            drawn = words.random_raw(max(1024, (need - have) * 2**n.bit_length() // n)) >> shift
            parts.append(drawn[drawn < n].astype(np.intp))
        rest = np.concatenate(parts)
        yield rest[:need].reshape(-1, n)
        rest = rest[need:]


def bca(sample: list[float], seed: int, alpha: float = 0.05) -> tuple[float, float]:
    """M2: bias-corrected, accelerated bootstrap interval of the mean; the percentile interval where the bias can't be told."""
    n = len(sample)
    if n < 2:
        return 0.0, 0.0
    x = np.array(sample)
    boot = np.sort(np.concatenate([x[draws].mean(1) for draws in resamples(n, seed)]))
    below = float((boot < x.mean()).mean())
    if not 0 < below < 1:
        return percentile(boot, alpha / 2), percentile(boot, 1 - alpha / 2)
    normal = NormalDist()
    shift, jack = normal.inv_cdf(below), (x.sum() - x) / (n - 1)
    d = jack.mean() - jack
    spread = 6 * float((d**2).sum()) ** 1.5
    bend = float((d**3).sum()) / spread if spread else 0.0

    def at(z: float) -> float:
        return normal.cdf(shift + (shift + z) / (1 - bend * (shift + z)))

    return percentile(boot, at(normal.inv_cdf(alpha / 2))), percentile(boot, at(normal.inv_cdf(1 - alpha / 2)))


@lru_cache(16)
def sign_patterns(n: int) -> np.ndarray:
    return 1 - 2 * (np.arange(2**n)[:, None] >> np.arange(n) & 1)


class Flips:
    """Bits of ``random.Random(seed).random() >= 0.5`` in order, packed; samples of all sizes read the same ones.

    ``random`` takes two words, and the leading bit of the first says which
    half it falls in.  The first ``most`` pieces are kept, later ones are drawn
    again for each use, so memory is bounded at every size.
    """

    def __init__(self, seed: int, most: int = 32, size: int = 1 << 20):
        self.words, self.most, self.size, self.kept = _generator(seed), most, size, []

    def _draw(self, words: np.random.MT19937) -> np.ndarray:
        pieces = [np.packbits(words.random_raw(1 << 20)[::2] >> np.uint64(31) > 0) for _ in range(self.size >> 16)]
        return np.concatenate(pieces)

    def __iter__(self) -> Iterator[np.ndarray]:
        i = 0
        while i < self.most:
            if i == len(self.kept):
                self.kept.append(self._draw(self.words))
            yield self.kept[i]
            i += 1
        words = np.random.MT19937()
        words.state = self.words.state
        while True:
            yield self._draw(words)

    def blocks(self, size: int) -> Iterator[np.ndarray]:
        """The bytes in blocks of ``size``, without end."""
        rest, pieces = np.empty(0, np.uint8), iter(self)
        while True:
            parts, have = [rest], len(rest)
            while have < size:
                parts.append(next(pieces))
                have += len(parts[-1])
            rest = np.concatenate(parts)
            yield rest[:size]
            rest = rest[size:]


@lru_cache(2)
def flips(seed: int) -> Flips:
    return Flips(seed)


_SIGNS = 1.0 - 2 * np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1)


def flipped_sums(x: np.ndarray, seed: int, cells: int = 1 << 19) -> Iterator[np.ndarray]:
    """Sums of x under ``FLIPS`` rows of seeded signs, in blocks.

    Row r begins at bit r * n, so rows r, r + 8, ... begin at the same bit of a
    byte, n bytes apart.  For each of the eight, a table has the sum of what a
    byte at each place stands for, and a row is a sum of look-ups.
    """
    n = len(x)
    tables = []
    for r in range(8):
        padded = np.zeros(-(-(r * n % 8 + n) // 8) * 8)
        padded[r * n % 8 : r * n % 8 + n] = x
        tables.append((padded.reshape(-1, 8) @ _SIGNS.T).ravel())
    turns = max(1, cells // n)  # of eight rows, which take n bytes
    blocks = flips(seed).blocks(turns * n)
    for first in range(0, FLIPS // 8, turns):
        bits, many = np.append(next(blocks), np.uint8(0)), min(turns, FLIPS // 8 - first)
        for r, table in enumerate(tables):
            own = np.lib.stride_tricks.as_strided(bits[r * n // 8 :], (many, len(table) // 256), (n, 1))
            yield table.take(own + np.arange(0, len(table), 256)).sum(1)


def sign_flip(sample: list[float], seed: int) -> float:
    """M3: two-sided p-value that the mean is 0; exact up to 12 values, else 20,000 seeded flips."""
    n = len(sample)
    if not n:
        return 1.0
    x = np.array(sample)
    least = abs(x.sum()) - 1e-12
    if n <= EXACT:
        return float((np.abs(sign_patterns(n) @ x) >= least).mean())
    hits = sum(int((np.abs(sums) >= least).sum()) for sums in flipped_sums(x, seed))
    return (hits + 1) / (FLIPS + 1)


def analyze(pairs: DataFrame, group: str, seed: int = 7) -> DataFrame:
    """M1-M4 per group (few pairs each, by nature of the test): ``n, mean_delta, ci_low, ci_high, p_value, improved``."""
    kind = dict(pairs.dtypes)[group]

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        sample = sorted(rows["delta"].tolist())
        low, high = bca(sample, seed)
        p = sign_flip(sample, seed)
        return pd.DataFrame([(key[0], len(sample), float(np.mean(sample)), low, high, p, len(sample) >= 2 and low > 0 and p < 0.05)], columns=["g", "n", "mean_delta", "ci_low", "ci_high", "p_value", "improved"])

    out = deltas(pairs, group).where("delta is not null").groupBy(group).applyInPandas(run, f"g {kind}, n long, mean_delta double, ci_low double, ci_high double, p_value double, improved boolean")
    return out.withColumnRenamed("g", group)


def sign_flip_exact(samples: DataFrame, group: str, value: str, most: int = EXACT) -> DataFrame:
    """M3, exact, JVM-side, for groups of up to ``most`` values: ``n, hits, p_value``; larger groups are left out.

    Each group's values are one small array; every sign pattern is a number
    whose bits are the signs.
    """
    small = samples.groupBy(group).agg(F.count(value).alias("n"), F.slice(F.array_sort(F.collect_list(value)), 1, most).alias("x")).where(F.col("n").between(1, most))
    flips = small.withColumn("least", F.abs(_sum(F.col("x"))) - 1e-9).select(group, "n", "x", "least", F.explode(F.sequence(F.lit(0), F.pow(F.lit(2), F.col("n")).cast("int") - 1)).alias("s"))
    signed = F.abs(_sum(F.transform("x", lambda v, i: F.when(F.shiftright("s", 0).bitwiseAND(F.pow(F.lit(2), i).cast("int")) > 0, -v).otherwise(v))))
    hits = flips.withColumn("hit", (signed >= F.col("least")).cast("long")).groupBy(group, "n").agg(F.sum("hit").alias("hits"))
    return hits.select(group, "n", "hits", (F.col("hits") / F.pow(F.lit(2), F.col("n"))).alias("p_value"))


def _sum(xs: Column) -> Column:
    return F.aggregate(xs, F.lit(0.0), lambda a, x: a + x)
