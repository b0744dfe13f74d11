"""Harvest of writing samples (F5-F15, K9-K16): filters, near-duplicates, coverage, ranking."""

from __future__ import annotations

from collections import defaultdict

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions import text
from quillspark.operators import detect, structure
from quillspark.plans.rules import Rule
from quillspark.plans.scratch import checkpointed

# Patterns of the filters and cells.
TAG = r"(?i)<(?:system-reminder|[^>\s]+)[^>]*>[\s\S]*?</(?:system-reminder|[^>\s]+)>"
QUOTED = r"(?im)^\s*(?:>|you said:|assistant:|claude said:)"
QUOTE_LEADS = ["you wrote:", "your answer:", "your response:"]
VERBS = "open read write edit fix review run grep search cat sed python3? npm git"
COMMAND = r"(?i)^\s*(?:/[\w-]+|" + structure.one_of(VERBS.split()) + r"\b.*(?:/[\w./-]+|--?\w+))"
PATH_OR_FLAG = r"(^|\s)(?:/[\w./-]+|--?\w+)"
FILLER = r"(?i)\b(?:um|uh)\b,?"
CELLS = {
    "numbers_data": r"\b\d+(?:[,.]\d+)?%?\b",
    "question_addressed": r"\?|\b(?:why|how|what|when|where|which)\b",
    "anecdote_markers": r"\b(?:last quarter|yesterday|once|during|when we|i noticed|i remember)\b",
    "disagreement": r"\b(?:disagree|however|instead|not convinced|push back)\b",
    "openings_closings": r"\b(?:hi|thanks|best|regards|closing|opening|first off)\b",
}
REASONS = ["since", "quoted-assistant", "command-likeness", "length", "fragment-share", "duplication"]


def clean(t: Column) -> Column:
    """tags and quoted lines go, white space collapses."""
    t = F.regexp_replace(F.regexp_replace(t, TAG, " "), text.LINE_BREAKS, "\n")
    return text.strip(F.regexp_replace(F.regexp_replace(t, r"(?m)^[^\S\n]*>.*$", ""), r"(?U)\s+", " "))


def in_time(date: Column, since: str | None) -> Column:
    """true without ``since``, without a date or with one that can't be read; time zones are dropped."""
    if since is None:
        return F.lit(True)
    bare = F.regexp_replace(F.regexp_replace(date, "Z$", ""), r"[+-]\d{2}:?\d{2}$", "")
    return F.coalesce(F.try_to_timestamp(bare) >= F.lit(since).cast("timestamp"), F.lit(True))


def quoted_assistant(t: Column) -> Column:
    """F7."""
    hit = t.rlike(QUOTED)
    for lead in QUOTE_LEADS:
        hit = hit | F.lower(F.trim(t)).startswith(lead)
    return hit


def command_like(t: Column, words: Column) -> Column:
    """F8."""
    return t.rlike(COMMAND) | ((F.size(words) <= 8) & t.rlike(PATH_OR_FLAG))


def dictated(t: Column, words: Column) -> Column:
    """two fillers or more, and over 3.5 % of the words."""
    n = text.count_of(t, FILLER)
    return (n >= 2) & (n / F.greatest(F.size(words), F.lit(1)) > 0.035)


def tripwire(docs: DataFrame, text_col: str = "text", rules: list[Rule] | None = None) -> DataFrame:
    """add ``suspect_ai``: a hard violation (quotes included), or two distinct categories of either scanner."""
    scanned = structure.scan(detect.scan(docs, text_col, rules, include_quoted=True).drop("declined"), text_col).drop("declined")
    v = F.col("violations")
    kinds = F.array_distinct(F.concat(v["category"], F.transform(F.col("structure")["flags"], lambda f: F.concat(F.lit("struct:"), f["metric"]))))
    hit = F.exists(v, lambda x: x["severity"] == "hard") | (F.size(kinds) >= 2)
    return scanned.withColumn("suspect_ai", hit).select(*docs.columns, "suspect_ai")


def waterfall(raw: DataFrame, min_words: int = 40, since: str | None = None, text_col: str = "text", date: Column | None = None) -> DataFrame:
    """F15 but for duplicates: the text cleaned, ``words``, ``dictated`` and ``drop_reason`` (first that applies, else null)."""
    rows = raw.withColumn("_d", F.lit(None).cast("string") if date is None else date).withColumn(text_col, clean(F.col(text_col)))
    rows = rows.withColumn("_w", text.harvest_words(F.col(text_col)))
    t, w = F.col(text_col), F.col("_w")
    reason = (
        F.when(~in_time(F.col("_d"), since), "since")
        .when(quoted_assistant(t), "quoted-assistant")
        .when(command_like(t, w), "command-likeness")
        .when(F.size(w) < min_words, "length")
        .when(text.complete_sentence_count(t) < 2, "fragment-share")
    )
    return rows.select(*raw.columns, F.size(w).alias("words"), dictated(t, w).alias("dictated"), reason.alias("drop_reason"))


# --- near-duplicates ------------------------------------------------------------------------------------------------


def duplicate_edges(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 5, least: float = 0.6) -> DataFrame:
    """``a, b, shared, overlap`` (a < b) where over ``least`` of the smaller one's distinct n-grams is shared.

    Equal gram sets fall together as one class before the join, so a large
    group of copies is one row there; a class's members are linked to its
    first.  Grams are hashed (64 bits) and only those in two classes or more
    are joined.  Rarest grams first, a pair over the threshold shares one of
    the first ``size - ceil(least * size) + 1`` grams of both, so only those
    prefixes meet in the join; the candidates are then verified on whole sets.
    """
    grams = F.array_sort(F.transform(text.word_grams(text.prose_words(F.col(text_col)), n), lambda g: F.xxhash64(g)))
    rows = docs.select(F.col(id_col).alias("id"), grams.alias("g")).where(F.size("g") > 0)
    sets = rows.groupBy(F.sha2(F.to_json(F.struct("g")), 256).alias("k")).agg(F.min("id").alias("id"), F.first("g").alias("g"), F.count("*").alias("copies"))
    flat = sets.select("id", F.size("g").alias("n"), F.explode("g").alias("h"))
    frequency = flat.groupBy("h").agg(F.count("*").alias("df")).where("df > 1")
    ranked = flat.join(frequency, "h")
    nth = F.row_number().over(Window.partitionBy("id").orderBy("df", "h"))
    # grams of one class only can't be shared; they take the first places of the prefix
    alone = F.col("n") - F.count("*").over(Window.partitionBy("id"))
    # containment in the smaller set says nothing about the larger one's size, so its whole set is probed
    need = F.floor(F.col("n") * least).cast("int") + 1
    ranked = ranked.withColumn("place", nth + alone).select("id", "n", "h", (F.col("place") <= F.col("n") - need + 1).alias("prefix"))
    small, large = ranked.where("prefix").select(F.col("id").alias("a"), F.col("n").alias("na"), "h"), ranked.select(F.col("id").alias("b"), F.col("n").alias("nb"), "h")
    met = small.join(large, "h").where("a <> b and (na < nb or (na = nb and a < b))").select("a", "b", "na").distinct()
    both = met.join(sets.select(F.col("id").alias("a"), F.col("g").alias("ga")), "a").join(sets.select(F.col("id").alias("b"), F.col("g").alias("gb")), "b")
    shared = F.size(F.array_intersect("ga", "gb"))
    found = both.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), shared.cast("long").alias("shared"), (shared / F.col("na")).alias("overlap")).where(F.col("overlap") > least)
    whole = rows.select("id", F.size("g").alias("n"), F.sha2(F.to_json(F.struct("g")), 256).alias("k")).join(sets.where("copies > 1").select("k", F.col("id").alias("first")), "k")
    copies = whole.where("id <> first").select(F.col("first").alias("a"), F.col("id").alias("b"), F.col("n").cast("long").alias("shared"), F.lit(1.0).alias("overlap"))
    return found.unionByName(copies)


def _groups(edges: DataFrame) -> DataFrame:
    """``id, group``: the smallest id reachable, for every end of an edge; the way to it halves at least with each round."""
    both = checkpointed(edges.select("a", "b").union(edges.select("b", "a")).distinct())
    state = checkpointed(both.groupBy("a").agg(F.min(F.least("a", "b")).alias("group")).withColumnRenamed("a", "id"))
    while True:
        near = both.join(state.select(F.col("id").alias("b"), "group"), "b").groupBy("a").agg(F.min("group").alias("near"))
        lower = checkpointed(state.join(near.withColumnRenamed("a", "id"), "id").select("id", F.col("group").alias("old"), F.least("group", "near").alias("group")))
        up = lower.select(F.col("id").alias("group"), F.col("group").alias("top"))
        after = checkpointed(lower.join(up, "group").select("id", "old", F.col("top").alias("group")))
        if not after.where("old <> group").limit(1).count():
            return after.select("id", "group")
        state = after.select("id", "group")


def _folded(rows: pd.DataFrame) -> pd.DataFrame:
    """Decisions of one group of edges, in order of id."""
    earlier = defaultdict(list)
    for a, b in zip(rows["a"], rows["b"], strict=True):
        earlier[b].append(a)
    kept: dict = {}
    for i in sorted(set(rows["a"]) | set(rows["b"])):
        kept[i] = not any(kept[a] for a in earlier[i])
    return pd.DataFrame({"id": list(kept), "kept": list(kept.values())})


def resolve_greedy(ids: DataFrame, edges: DataFrame, most_edges: int = 100_000) -> DataFrame:
    """``id, kept``, as if rows were taken in order of id and dropped for an edge to a kept earlier one.

    Edges fall into connected groups.  A group of up to ``most_edges`` edges is
    decided in one task, in order of id.  Larger ones are decided in rounds:
    each keeps every undecided row without an undecided or kept earlier
    neighbour and drops those with a kept one; the smallest undecided row is
    decided every time, so the rounds end.  Decisions are checkpointed.
    """
    kind = dict(ids.dtypes)["id"]
    edges = checkpointed(edges.select("a", "b").where("a < b").distinct())
    of = _groups(edges)
    grouped = edges.join(of.select(F.col("id").alias("a"), "group"), "a")
    sizes = grouped.groupBy("group").agg(F.count("*").alias("n"))
    grouped = checkpointed(grouped.join(sizes, "group"))
    decided = checkpointed(grouped.where(F.col("n") <= most_edges).groupBy("group").applyInPandas(_folded, f"id {kind}, kept boolean"))
    rest = grouped.where(F.col("n") > most_edges).select("a", "b")
    if rest.limit(1).count():
        decided = decided.unionByName(_by_rounds(rest))
    return ids.select("id").distinct().join(decided, "id", "left").select("id", F.coalesce("kept", F.lit(True)).alias("kept"))


def _by_rounds(edges: DataFrame) -> DataFrame:
    ends = edges.select(F.col("a").alias("id")).union(edges.select("b")).distinct()
    state = checkpointed(ends.withColumn("kept", F.lit(None).cast("boolean")))
    while True:
        view = edges.join(state.select(F.col("id").alias("a"), F.col("kept").alias("ka")), "a")
        facts = view.groupBy("b").agg(F.max(F.coalesce("ka", F.lit(False))).alias("hit"), F.max(F.col("ka").isNull()).alias("open"))
        after = state.join(facts.withColumnRenamed("b", "id"), "id", "left")
        decided = F.coalesce(F.col("kept"), F.when(F.coalesce("hit", F.lit(False)), F.lit(False)).when(~F.coalesce("open", F.lit(False)), F.lit(True)))
        state = checkpointed(after.select("id", decided.alias("kept")))
        if not state.where("kept is null").limit(1).count():
            return state


# --- classification and ranking -------------------------------------------------------------------------------------


def cells(t: Column) -> Column:
    """K9: names of the coverage cells that a text fills."""
    return F.array_compact(F.array(*[F.when(F.lower(t).rlike(p), F.lit(name)) for name, p in CELLS.items()]))


def quality(words: Column, filled: Column, suspect: Column, dictated_: Column) -> Column:
    """1 to 5."""
    score = F.lit(3) + F.when(words.between(40, 220), 1).otherwise(0) + F.when(F.size(filled) > 0, 1).otherwise(0)
    score = score - F.when(F.coalesce(suspect, F.lit(False)), 2).otherwise(0) - F.when(F.coalesce(dictated_, F.lit(False)), 1).otherwise(0)
    return F.greatest(F.lit(1), F.least(F.lit(5), score))


def recency(date: Column, mtime: Column) -> Column:
    """Seconds of the date, else the file's time, else 0."""
    return F.coalesce(F.unix_timestamp(F.try_to_timestamp(date)).cast("double"), mtime, F.lit(0.0))


def fills_empty(candidates: DataFrame, index: str = "index", cells_col: str = "cells") -> DataFrame:
    """Add ``fills_empty``: whether the row is the first to fill one of its cells."""
    firsts = candidates.select(index, F.explode(cells_col).alias("cell")).groupBy("cell").agg(F.min(index).alias(index)).select(index).distinct()
    return candidates.join(F.broadcast(firsts.withColumn("fills_empty", F.lit(True))), index, "left").fillna(False, ["fills_empty"])  # a row a cell at most


def coverage(candidates: DataFrame, cells_col: str = "cells") -> DataFrame:
    """``cell, n`` for every cell, 0 included."""
    names = candidates.sparkSession.createDataFrame([(c,) for c in CELLS], "cell string")
    n = candidates.select(F.explode(cells_col).alias("cell")).groupBy("cell").agg(F.count("*").alias("n"))
    return names.join(n, "cell", "left").fillna(0, ["n"])


def ranking_order(path: str = "path", position: str = "position") -> list[Column]:
    """The eight keys in order; position compares as a string."""
    return [F.desc("fills_empty"), F.desc("quality"), F.desc("recency"), F.asc("suspect_ai"), F.asc("dictated"), F.asc(path), F.asc(F.col(position).cast("string")), F.asc("index")]


def merge_results(candidates: DataFrame, results: DataFrame) -> DataFrame:
    """``candidates`` (index, id, words, ...) with the last classifier row of their id, else of their index.

    ``results``: ``key, at, cells, quality, why``; ``at`` orders rows.
    """
    last = results.groupBy("key").agg(F.max_by(F.struct("cells", "quality", "why"), "at").alias("r"))
    by_id = last.select(F.col("key").alias("_id"), F.col("r").alias("_r1"))
    by_index = last.select(F.col("key").alias("_index"), F.col("r").alias("_r2"))
    rows = candidates.join(by_id, F.col("id").cast("string") == F.col("_id"), "left").join(by_index, F.col("index").cast("string") == F.col("_index"), "left")
    r = F.coalesce("_r1", "_r2")
    rows = rows.withColumn("cells", F.coalesce(r["cells"], F.array().cast("array<string>")))
    none = F.lit(None).cast("boolean")
    suspect = F.col("suspect_ai") if "suspect_ai" in candidates.columns else none
    said = F.col("dictated") if "dictated" in candidates.columns else none
    score = F.coalesce(r["quality"], quality(F.col("words"), F.col("cells"), suspect, said))
    rows = rows.withColumn("quality", F.greatest(F.lit(1), F.least(F.lit(5), score))).withColumn("why", F.coalesce(r["why"], F.lit("no classifier result")))
    return rows.drop("_id", "_index", "_r1", "_r2")


def rank(candidates: DataFrame, limit: int = 200) -> DataFrame:
    """Suspects last, newest first, then path and line; the first ``limit`` rows are the report."""
    return candidates.orderBy(F.coalesce("suspect_ai", F.lit(False)), F.desc("recency"), "path", "line").limit(limit)
