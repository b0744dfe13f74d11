"""Statistics over array columns, without leaving the row."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body) -> Column:
    """``body(value)`` with the value worked out once: a lambda's argument, which the optimizer doesn't copy into every use."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def rounded(x: Column, places: int) -> Column:
    """Half away from zero after scaling, as SQL's ``round`` on doubles: 29.849999999999998 is 29.9 at one place.  ``F.round`` goes by the decimal digits of ``x`` itself."""
    scale = F.lit(10.0**places)
    return F.round(x.cast("double") * scale, 0) / scale


def total(xs: Column) -> Column:
    return F.aggregate(xs, F.lit(0.0), lambda a, x: a + x.cast("double"))


def mean(xs: Column) -> Column:
    """Null for an empty array."""
    return F.when(F.size(xs) > 0, total(xs) / F.size(xs))


def variance(xs: Column) -> Column:
    """Population variance, in one fold (count, mean, squared deviations)."""
    start = F.struct(F.lit(0.0).alias("n"), F.lit(0.0).alias("m"), F.lit(0.0).alias("s"))

    def step(a, x):
        n, d = a["n"] + 1, x.cast("double") - a["m"]
        m = a["m"] + d / n
        return F.struct(n.alias("n"), m.alias("m"), (a["s"] + d * (x.cast("double") - m)).alias("s"))

    return F.aggregate(xs, start, step, lambda a: F.when(a["n"] > 0, a["s"] / a["n"]).otherwise(F.lit(0.0)))


def variation(xs: Column) -> Column:
    """Coefficient of variation; 0 for an empty array or a zero mean."""
    m = mean(xs)
    return F.coalesce(F.when(m != 0, F.sqrt(variance(xs)) / m), F.lit(0.0))


def median(ordered: Column) -> Column:
    """Median of an array in order; null if empty."""
    n = F.size(ordered)
    low, high = F.get(ordered, F.floor((n - 1) / 2).cast("int")), F.get(ordered, F.floor(n / 2).cast("int"))
    return F.when(n > 0, (low + high) / 2.0)


def longest_run(xs: Column, holds) -> Column:
    """Longest run of elements for which ``holds(previous, current)``; previous is null at the first."""
    start = F.struct(F.lit(0).alias("run"), F.lit(0).alias("best"))
    pairs = F.zip_with(xs, F.concat(F.array(F.lit(None)), F.slice(xs, 1, F.greatest(F.size(xs) - 1, F.lit(0)))), lambda x, p: F.struct(x.alias("x"), p.alias("p")))

    def step(a, z):
        run = F.when(F.coalesce(holds(z["p"], z["x"]), F.lit(False)), a["run"] + 1).otherwise(0)
        return F.struct(run.alias("run"), F.greatest(a["best"], run).alias("best"))

    return F.aggregate(pairs, start, step, lambda a: a["best"])
