"""Co-writer suggestions (G1-G8): from violations to spans, thinning, replacements, gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions import text
from quillspark.operators import detect, facts, structure
from quillspark.plans.rules import Rule

SUGGESTION = "struct<span:struct<start:int,end:int,text:string>,severity:string,category:string,rationale:string,suggested_replacement:string,phrased_as_question:boolean>"


def from_violations(violations: Column, t: Column) -> Column:
    """G1: a span-anchored suggestion for each violation, with the rule's own suggestion where it has one; soft ones ask."""

    def one(v):
        said, soft = F.substring(t, v["start"] + 1, v["end"] - v["start"]), v["severity"] == "soft"
        hint = F.coalesce(F.concat(F.lit(" Consider: "), v["suggestion"], F.lit(".")), F.lit(""))
        ask = F.concat(F.lit("Soft tell ("), v["category"], F.lit("): could “"), said, F.lit("” be cut or reworded here?"), hint)
        tell = F.concat(F.lit("AI-writing tell ("), v["category"], F.lit("): replace “"), said, F.coalesce(F.concat(F.lit("” — "), v["suggestion"]), F.lit("”.")))
        return F.struct(
            F.struct(v["start"].alias("start"), v["end"].alias("end"), said.alias("text")).alias("span"),
            v["severity"].alias("severity"),
            v["category"].alias("category"),
            F.when(soft, ask).otherwise(tell).alias("rationale"),
            F.lit(None).cast("string").alias("suggested_replacement"),
            soft.alias("phrased_as_question"),
        )

    return F.transform(violations, one)


def thinned(suggestions: Column) -> Column:
    """By (start, end, category), each kept that starts at or after the end of the last kept one: one fold."""
    ordered = F.array_sort(
        suggestions,
        lambda a, b: F.when(a["span"]["start"] != b["span"]["start"], a["span"]["start"] - b["span"]["start"])
        .when(a["span"]["end"] != b["span"]["end"], a["span"]["end"] - b["span"]["end"])
        .when(a["category"] < b["category"], -1)
        .when(a["category"] > b["category"], 1)
        .otherwise(0),
    )
    start = F.struct(F.lit(-1).alias("end"), F.array().cast(f"array<{SUGGESTION}>").alias("kept"))

    def step(a, s):
        fits = s["span"]["start"] >= a["end"]
        return F.struct(F.when(fits, s["span"]["end"]).otherwise(a["end"]).alias("end"), F.when(fits, F.concat(a["kept"], F.array(s.cast(SUGGESTION)))).otherwise(a["kept"]).alias("kept"))

    return F.aggregate(ordered, start, step, lambda a: a["kept"])


def suggest(docs: DataFrame, text_col: str = "text", rules: list[Rule] | None = None) -> DataFrame:
    """Add ``suggestions``, ``structure_flags`` and ``declined``; declined texts (not English, whatever they hold) get none."""
    rows = structure.scan(detect.scan(docs, text_col, rules).drop("declined"), text_col).drop("declined")
    rows = rows.withColumn("declined", ~text.is_english(text.english_tokens(F.col(text_col))))
    none = F.array().cast(f"array<{SUGGESTION}>")
    rows = rows.withColumn("suggestions", F.when(F.col("declined"), none).otherwise(thinned(from_violations(F.col("violations"), F.col(text_col)))))
    return rows.select(*docs.columns, "suggestions", F.col("structure")["flags"]["metric"].alias("structure_flags"), "declined")


def counts(suggested: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``id, severity, category, n`` with totals."""
    rows = suggested.select(id_col, F.inline("suggestions"))
    sets = [[id_col], [id_col, "severity"], [id_col, "category"]]
    return rows.groupingSets(sets, id_col, "severity", "category").agg(F.count("*").alias("n"))


def _scanned(rows: DataFrame, text_col: str, rules: list[Rule] | None) -> DataFrame:
    """Add ``clean``: whether neither scanner has a finding in ``text_col``."""
    found = structure.scan(rows.withColumn("_v", detect.violations(F.col(text_col), rules)), text_col)
    own = [c for c in rows.columns]
    return found.select(*own, ((F.size("_v") == 0) & (F.size(F.coalesce(F.col("structure")["flags"]["metric"], F.array().cast("array<string>"))) == 0)).alias("clean"))


def merge(suggestions: DataFrame, replacements: DataFrame, id_col: str = "doc_id", rules: list[Rule] | None = None) -> tuple[DataFrame, DataFrame]:
    """Suggestions (id, start, end, span_text) with replacements of the same span; and warnings ``id, start, end, warning``.

    A replacement is warned of if it is the span itself, else if a scanner has
    a finding in it alone, or if it has no suggestion.
    """
    keys = [id_col, "start", "end"]
    merged = suggestions.join(replacements.select(*keys, F.col("replacement").alias("suggested_replacement")), keys, "left")
    new = F.col("suggested_replacement")
    same = merged.where(new == F.col("span_text")).select(*keys, F.lit("identical to span text").alias("warning"))
    other = _scanned(merged.where(new.isNotNull() & (new != F.col("span_text"))), "suggested_replacement", rules)
    dirty = other.where("not clean").select(*keys, F.lit("does not pass the scanners alone").alias("warning"))
    unknown = replacements.join(suggestions, keys, "left_anti").select(*keys, F.lit("targets unknown span").alias("warning"))
    return merged, same.unionByName(dirty).unionByName(unknown)


def overlaps(suggestions: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Neighbours in order of (start, end) that overlap: ``id, start, end, previous_end``."""
    order = Window.partitionBy(id_col).orderBy("start", "end")
    return suggestions.withColumn("previous_end", F.lag("end").over(order)).where("start < previous_end").select(id_col, "start", "end", "previous_end")


def shared_words(a: Column, b: Column) -> Column:
    """Number of equal leading elements of two arrays."""
    pairs = F.zip_with(a, b, lambda x, y: F.coalesce(x == y, F.lit(False)))
    state = F.aggregate(pairs, F.struct(F.lit(0).alias("n"), F.lit(True).alias("on")), lambda s, same: F.struct((s["n"] + F.when(s["on"] & same, 1).otherwise(0)).alias("n"), (s["on"] & same).alias("on")))
    return state["n"]


def minimality(suggestions: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Failures ``id, start, end, failure`` of (id, text, start, end, span_text, suggested_replacement)."""
    real = F.substring(F.col(text_col), F.col("start") + 1, F.col("end") - F.col("start"))
    new = F.col("suggested_replacement")
    split = lambda c: text.nonempty(F.split(c, r"(?U)\s+"))
    edge = (shared_words(split(real), split(new)) > 0) | (shared_words(F.reverse(split(real)), F.reverse(split(new))) > 0)
    why = F.array_compact(
        F.array(
            F.when(real != F.col("span_text"), F.lit("span text doesn't match the document")),
            F.when(new == real, F.lit("identical to the span text")).when(new.isNotNull() & edge, F.lit("shares leading or trailing words with the span")),
        )
    )
    return suggestions.select(id_col, "start", "end", F.explode(why).alias("failure"))


def in_context(suggestions: DataFrame, text_col: str = "text", id_col: str = "doc_id", rules: list[Rule] | None = None) -> DataFrame:
    """Failures of replacements that aren't clean alone, or touch a violation where they stand."""
    rows = suggestions.where("suggested_replacement is not null")
    t, new = F.col(text_col), F.col("suggested_replacement")
    rows = rows.withColumn("_ctx", F.concat(F.substring(t, F.lit(1), F.col("start")), new, F.substring(t, F.col("end") + 1, F.length(t))))
    rows = rows.withColumn("_alone", F.size(detect.spans(new, rules))).withColumn("_in", detect.spans(F.col("_ctx"), rules))
    hit = F.exists("_in", lambda s: (s["start"] < F.col("start") + F.length(new)) & (F.col("start") < s["end"]))
    why = F.array_compact(F.array(F.when(F.col("_alone") > 0, F.lit("not clean in isolation")), F.when(hit, F.lit("introduces a violation in context"))))
    return rows.select(id_col, "start", "end", F.explode(why).alias("failure"))


def apply_all(t: Column, edits: Column) -> Column:
    """Every replacement of an array of (start, end, replacement), from right to left so that offsets stay valid."""
    ordered = F.reverse(F.array_sort(edits))
    return F.aggregate(ordered, t, lambda a, e: F.concat(F.substring(a, F.lit(1), e["start"]), e["replacement"], F.substring(a, e["end"] + 1, F.length(a))))


def accept_all(documents: DataFrame, text_col: str = "text", edits_col: str = "edits", rules: list[Rule] | None = None) -> DataFrame:
    """Add ``applied``, ``clean`` (for both scanners) and ``preserved`` to documents with an array of edits."""
    edits = F.filter(edits_col, lambda e: e["replacement"].isNotNull())
    rows = _scanned(documents.withColumn("applied", apply_all(F.col(text_col), edits)), "applied", rules)
    return rows.withColumn("preserved", facts.preserved(F.col(text_col), F.col("applied")))
