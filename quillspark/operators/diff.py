"""Word-level difference of two texts."""

from __future__ import annotations

from collections import Counter
from difflib import SequenceMatcher

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions import text

OPS = "struct<added:int,removed:int,changed:int,ratio:double,shared:int>"


def operations(a: Column, b: Column) -> Column:
    """Added, removed and changed tokens and the ratio between two token arrays (difflib, default settings), and their shared multiset."""
    kind = pa.struct([("added", pa.int32()), ("removed", pa.int32()), ("changed", pa.int32()), ("ratio", pa.float64()), ("shared", pa.int32())])

    @F.arrow_udf(OPS)
    def run(xs: pa.Array, ys: pa.Array) -> pa.Array:
        out = []
        for x, y in zip(xs.to_pylist(), ys.to_pylist(), strict=True):
            if x is None or y is None:
                out.append(None)
                continue
            m, n = SequenceMatcher(None, x, y), {"replace": 0, "delete": 0, "insert": 0, "equal": 0}
            for tag, i, j, k, end in m.get_opcodes():
                n[tag] += max(j - i, end - k)
            out.append({"added": n["insert"], "removed": n["delete"], "changed": n["replace"], "ratio": m.ratio(), "shared": (Counter(x) & Counter(y)).total()})
        return pa.array(out, kind)

    return run(a, b)


def bag_overlap(pairs: DataFrame, id_col: str, original: str, rewritten: str) -> DataFrame:
    """X3 relationally: ``id, shared, tokens, overlap`` by one aggregation over both bags.

    Every token is a row with a side; per token the smaller count is shared.
    """
    side = lambda c, s: pairs.select(id_col, F.explode_outer(text.diff_tokens(F.col(c))).alias("w"), F.lit(s).alias("side"))
    n = side(original, 0).unionByName(side(rewritten, 1)).groupBy(id_col, "w").agg(F.count(F.when((F.col("side") == 0) & F.col("w").isNotNull(), 1)).alias("a"), F.count(F.when((F.col("side") == 1) & F.col("w").isNotNull(), 1)).alias("b"))
    sums = n.groupBy(id_col).agg(F.sum(F.least("a", "b")).alias("shared"), F.sum("a").alias("tokens"))
    return sums.select(id_col, "shared", "tokens", F.when(F.col("tokens") > 0, F.round(F.col("shared") / F.col("tokens"), 6)).otherwise(0.0).alias("overlap"))


def diff(pairs: DataFrame, original: str = "original", rewritten: str = "rewritten") -> DataFrame:
    """Add ``diff``, X1-X4 as a struct, to every pair; nothing is shuffled.  Null if either text is."""
    rows = pairs.withColumn("_a", text.diff_tokens(F.col(original))).withColumn("_b", text.diff_tokens(F.col(rewritten)))
    rows = rows.withColumn("_o", operations(F.col("_a"), F.col("_b"))).withColumn("_n", F.size("_a")).withColumn("_m", F.size("_b"))
    o, n, m = F.col("_o"), F.col("_n"), F.col("_m")
    rows = rows.withColumn("_p", F.when(n > 0, (o["added"] + o["removed"] + o["changed"]) / n * 100).otherwise(0.0))
    rows = rows.withColumn("_k", F.when(n > 0, F.col("_o")["shared"] / n).otherwise(0.0)).withColumn("_l", F.when(n > 0, m / n).otherwise(0.0))
    p, k, size = F.col("_p"), F.col("_k"), F.col("_l")
    percent = lambda x: F.concat(F.bround(x * 100, 0).cast("int"), F.lit("%"))
    flags = F.array_compact(
        F.array(
            F.when((p > 40) & (k >= 0.9), F.concat(F.lit("Mostly reordered ("), percent(k), F.lit(" tokens shared)"))).when(p > 40, F.concat(F.lit("Excessive change ("), F.format_string("%.1f", p), F.lit("% > 40% threshold)"))),
            F.when(m < n * 0.3, F.lit("Transformed text is less than 30% of original length")),
            F.when(m > n * 1.5, F.lit("Transformed text is 50%+ longer than original")),
            F.when(size < 0.5, F.concat(F.lit("Significant condensation ("), percent(size), F.lit(" of original)"))).when(size > 1.2, F.concat(F.lit("Text expanded ("), percent(size), F.lit(" of original)"))),
        )
    )
    out = F.struct(
        n.alias("original_word_count"),
        m.alias("transformed_word_count"),
        F.round(o["ratio"], 3).alias("similarity_ratio"),
        F.round(p, 1).alias("change_percentage"),
        o["added"].alias("words_added"),
        o["removed"].alias("words_removed"),
        o["changed"].alias("words_changed"),
        (((p > 40) & (k < 0.9)) | (m < n * 0.3)).alias("excessive"),
        flags.alias("flags"),
    )
    return rows.select(*pairs.columns, F.when(F.col(original).isNotNull() & F.col(rewritten).isNotNull(), out).alias("diff"))


def largest_changes(pairs: DataFrame, k: int, group: str, score: str) -> DataFrame:
    """The ``k`` rows of each group with the highest ``score``: a report."""
    rank = F.row_number().over(Window.partitionBy(group).orderBy(F.desc(score)))
    return pairs.withColumn("rank", rank).where(F.col("rank") <= k)
