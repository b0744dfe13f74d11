"""Discourse silhouette scanner (D30-D37): how a document arranges its ideas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions import numbers, text

# Cue classes in order, reference distribution, thresholds.
CUES = {
    "contrast": ["on the other hand", "on one hand", "however", "conversely", "in contrast", "yet", "but ", "perhaps most", "that said", "still,"],
    "addition": ["moreover", "furthermore", "additionally", "in addition", "also,", "another", "second", "third", "next,", "finally,", "besides"],
    "conclusion": ["in conclusion", "ultimately", "overall", "in the end", "to sum", "in summary", "as we", "remember", "the future"],
    "enumeration": ["first,", "firstly", r"1\.", r"step \d", "there are"],
    "cause": ["therefore", "thus", "consequently", "as a result", "because of"],
}
REFERENCE = {  # metric: median, iqr, fence, weight
    "scaffold_opener_share": (0.0, 0.05, 0.2, 2.0),
    "role_entropy_bits": (0.0, 0.05, 0.8, 1.0),
    "heading_preview": (0.0, 0.05, 0.2, 1.0),
    "preview_fulfillment": (0.0, 0.05, 0.25, 1.0),
    "callback_content": (0.0, 0.05, 0.3, 1.5),
}
PENALTY = 1.0
SUPPRESSED = {"docs": {"callback_content"}}
HEADING = r"(?m)^[^\S\n]{0,3}#{2,3}[^\S\n]+(.*)$"


def cue(name: str) -> str:
    return "(?i)^(?:" + "|".join(CUES[name]) + ")"


ANY_CUE = "(?i)^(?:" + "|".join(c for cs in CUES.values() for c in cs) + ")"


def role(p: Column) -> Column:
    """First cue class that a paragraph opens with, else ``topic``."""
    out = None
    for name in CUES:
        out = F.when(p.rlike(cue(name)), F.lit(name)) if out is None else out.when(p.rlike(cue(name)), F.lit(name))
    return out.otherwise(F.lit("topic"))


def vocabulary(contents: Column, first: Column, many: Column) -> Column:
    """Distinct content words of ``many`` paragraphs from 1-based ``first`` on."""
    return F.array_distinct(F.flatten(F.slice(contents, first, F.greatest(many, F.lit(0)))))


def entropy(roles: Column) -> Column:
    out = F.lit(0.0)
    for x in (_share(roles, name, F.size(roles)) for name in [*CUES, "topic"]):
        out = out + F.when(x > 0, -x * F.log2(x)).otherwise(0.0)
    return out


def _share(roles: Column, name: str, n: Column) -> Column:
    return F.size(F.filter(roles, lambda r: r == name)) / n


def metrics(p: Column, c: Column, roles: Column, heads: Column) -> Column:
    """The five metrics from paragraphs, their content words, their roles and the headings' content words."""
    n = F.size(p)
    intro = F.get(c, F.lit(0))
    body = F.filter(F.slice(c, 2, F.greatest(n - 2, F.lit(0))), lambda x: F.size(x) > 0)
    met = F.filter(body, lambda x: F.array_contains(intro, F.get(x, F.lit(0))))
    third = F.greatest(F.lit(1), F.floor(n / 3).cast("int"))
    early, late = vocabulary(c, F.lit(1), third), vocabulary(c, n - third + 1, third)
    middle = vocabulary(c, third + 1, n - 2 * third)
    back = F.array_except(F.array_intersect(early, late), middle)
    scaffold = F.filter(F.slice(p, F.when(n > 1, 2).otherwise(1), F.greatest(n, F.lit(0))), lambda x: x.rlike(ANY_CUE))
    previewed = F.filter(heads, lambda h: F.arrays_overlap(h, intro))
    return F.struct(
        F.round(F.size(scaffold) / F.greatest(n - 1, F.lit(1)), 3).alias("scaffold_opener_share"),
        F.when(n >= 3, F.round(entropy(roles), 3)).alias("role_entropy_bits"),
        F.when(F.size(heads) >= 3, F.when(F.size(intro) > 0, F.round(F.size(previewed) / F.size(heads), 3)).otherwise(0.0)).alias("heading_preview"),
        F.when(n >= 4, F.when((F.size(intro) > 0) & (F.size(body) > 0), F.round(F.size(met) / F.size(body), 3)).otherwise(0.0)).alias("preview_fulfillment"),
        F.when(n >= 5, F.round(F.size(back) / n, 3)).alias("callback_content"),
    )


def scan(docs: DataFrame, text_col: str = "text", genre: str = "prose", separator: str = text.BLANK_LINE, reference: dict = REFERENCE) -> DataFrame:
    """Add ``silhouette``: metrics, contributions, penalty, flags; and ``declined``.  Nothing is shuffled.

    Under three paragraphs metrics, contributions and penalty are null.
    ``reference`` is a small dictionary, as ``fit_reference`` returns it.
    """
    rows = docs.withColumn("_p", text.paragraphs(F.col(text_col), strip_bold=True, separator=separator))
    rows = rows.withColumn("_c", F.transform("_p", text.silhouette_content)).withColumn("_r", F.transform("_p", role))
    rows = rows.withColumn("_h", F.transform(F.regexp_extract_all(text_col, F.lit(HEADING), F.lit(1)), text.silhouette_content))
    enough = F.size("_p") >= 3

    def weighed(m: Column) -> Column:
        parts = []
        for name, (median, iqr, fence, weight) in reference.items():
            part = F.round(F.greatest(F.lit(0.0), (m[name] - median) / max(iqr, fence)) * weight, 3)
            parts.append((F.lit(0.0) if name in SUPPRESSED.get(genre, set()) else F.when(m[name].isNotNull(), part)).alias(name))
        return numbers.let(F.struct(*parts), lambda k: summed(m, k))

    def summed(m: Column, k: Column) -> Column:
        penalty = F.lit(0.0)
        for name in reference:
            penalty = penalty + F.coalesce(k[name], F.lit(0.0))
        return numbers.let(F.round(penalty, 3), lambda y: report(m, k, y))

    def report(m: Column, k: Column, y: Column) -> Column:
        fired = [F.when(y >= PENALTY, F.struct(F.lit("silhouette_penalty").alias("metric"), y.alias("value"), F.lit(PENALTY).alias("fence")))]
        for name, (*_, fence, _weight) in reference.items():
            if name not in SUPPRESSED.get(genre, set()):
                fired.append(F.when(m[name] >= fence, F.struct(F.lit(name).alias("metric"), m[name].alias("value"), F.lit(float(fence)).alias("fence"))))
        none = F.array().cast("array<struct<metric:string,value:double,fence:double>>")
        return F.struct(
            F.size("_p").alias("prose_paragraphs"),
            F.when(enough, m).alias("metrics"),
            F.when(enough, k).alias("contributions"),
            F.when(enough, y).alias("penalty"),
            F.when(enough, F.array_compact(F.array(*fired))).otherwise(none).alias("flags"),
            F.lit(genre).alias("genre"),
        )

    there = F.col(text_col).isNotNull()
    whole = numbers.let(metrics(F.col("_p"), F.col("_c"), F.col("_r"), F.col("_h")), weighed)
    rows = rows.select(*docs.columns, F.when(there, whole).alias("silhouette"))
    declined = (F.size(F.col("silhouette")["flags"]) == 0) & ~text.is_english(text.english_tokens(F.col(text_col)))
    return rows.withColumn("declined", F.when(there, declined))


def fit_reference(docs: DataFrame, text_col: str = "text", separator: str = text.BLANK_LINE, iqr_floor: float = 0.05) -> DataFrame:
    """``metric, median, iqr, fence, weight, n`` from a corpus: exact medians and inclusive quartiles, one aggregation."""
    rows = scan(docs, text_col, separator=separator).select("silhouette.metrics.*")
    names = list(REFERENCE)
    aggs = [x for n in names for x in (F.percentile(n, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias(f"q_{n}"), F.count(n).alias(f"n_{n}"))]
    one = rows.agg(*aggs)
    stacked = F.array(*[F.struct(F.lit(n).alias("metric"), F.col(f"q_{n}").alias("q"), F.col(f"n_{n}").alias("n"), F.lit(REFERENCE[n][2]).alias("fence"), F.lit(REFERENCE[n][3]).alias("weight")) for n in names])
    long = one.select(F.inline(stacked))
    return long.select("metric", F.round(F.col("q")[1], 6).alias("median"), F.round(F.greatest(F.col("q")[2] - F.col("q")[0], F.lit(iqr_floor)), 6).alias("iqr"), "fence", "weight", "n")
