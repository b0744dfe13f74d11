"""Situation coverage and voice cards (K1-K8)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions import numbers, text

# Taxonomy and lexical signals.
TAXONOMY = "explaining-technical anecdote argument disagreement praise hedging-uncertainty numbers-data addressing-reader openings closings".split()
STRUCTURAL = ["openings", "closings"]
NUMBER_WORDS = """one two three four five six seven eight nine ten eleven twelve dozen hundred thousand million twenty thirty forty
fifty sixty seventy eighty ninety percent half quarter double triple"""
NUMBER_ALTERNATIVES = "|".join(NUMBER_WORDS.split())
SIGNALS = {
    "explaining-technical": "because|so that|which means|the reason|works by|depends on|the way it|in order to|that's how|this is how|the trick is|you have to|the point of",
    "argument": "therefore|thus|consequently|the point is|i distrust|clearly|obviously|in fact|the truth is|matters because|that's the point|either way|that's rare|nobody|no one",
    "disagreement": "but i|i don't|no one|nobody|wrong|i distrust|rather than|not because|i hate|don't trust|disagree|however|i wasn't|makes sense|i can't",
    "praise": "extraordinary|wonderful|dependable|lovely|beautiful|kindly|generous|grateful|delightful|plenty|good choice|with care|extraordinary care|almost pleasant|i like",
    "hedging-uncertainty": "maybe|perhaps|probably|might|i guess|i think|seems|sort of|kind of|possibly|i suppose|not sure|or won't|or it won't|i believed|or maybe",
}
FIRST_PERSON = "i we my me we've i've i'll i'd our".split()
TIME_CUES = "today yesterday tonight morning evening night ago monday tuesday wednesday thursday friday saturday sunday last once then later week year".split()
LEAST_SENTENCES = 2
HOW_TO = {
    "explaining-technical": "Name the mechanism; short causal sentences.",
    "anecdote": "First person, past tense, one scene at a time.",
    "argument": "State the claim flat, then the reason.",
    "disagreement": "Disagree by contrast, not by confrontation.",
    "praise": "Praise by specific, restrained detail.",
    "hedging-uncertainty": "Hold uncertainty lightly, with plain words.",
    "numbers-data": "Keep numbers small and woven into the scene.",
    "addressing-reader": "Address the reader sparingly and plainly.",
    "openings": "Open on a concrete fact or action.",
    "closings": "Close on a small, specific image.",
}


def _signal(listed: str) -> str:
    """Single words at word boundaries, several anywhere."""
    return "|".join(s if " " in s else rf"\b{s}\b" for s in listed.split("|"))


def dimensions(sentence: Column) -> Column:
    """K1: the lexical dimensions of one sentence, in the taxonomy's order."""
    low, words = F.lower(sentence), text.style_words(sentence)
    first, timed = F.arrays_overlap(words, text.words_in(FIRST_PERSON)), F.arrays_overlap(words, text.words_in(TIME_CUES))
    past = F.exists(words, lambda w: w.endswith("ed") & (F.length(w) > 3))
    tests = {name: low.rlike(_signal(s)) for name, s in SIGNALS.items()} | {
        "numbers-data": low.rlike(rf"\d|\b(?:{NUMBER_ALTERNATIVES})\b"),
        "addressing-reader": F.rtrim(sentence).endswith("?") | low.rlike(r"\b(?:you|your)\b"),
        "anecdote": first & (timed | past),
    }
    return F.array_compact(F.array(*[F.when(tests[d], F.lit(d)) for d in TAXONOMY if d in tests]))


def situations(docs: DataFrame, by: str, text_col: str = "text") -> DataFrame:
    """``by, dimension, sentence``: every sentence under each dimension it exercises, and each document's first and last."""
    s = text.nonempty(F.transform(text.card_sentences(F.col(text_col)), lambda x: F.regexp_replace(x, r"(?U)\s+", " ")))
    rows = docs.select(by, s.alias("s")).where(F.size("s") > 0)
    lexical = rows.select(by, F.explode("s").alias("sentence")).select(by, F.explode(dimensions(F.col("sentence"))).alias("dimension"), "sentence")
    ends = rows.select(by, F.inline(F.array(F.struct(F.lit("openings").alias("dimension"), F.element_at("s", 1).alias("sentence")), F.struct(F.lit("closings").alias("dimension"), F.element_at("s", -1).alias("sentence")))))
    return lexical.unionByName(ends)


def coverage(sits: DataFrame, by: str) -> DataFrame:
    """K2: ``by, dimension, n, covered`` for every dimension of the taxonomy."""
    n = sits.groupBy(by, "dimension").agg(F.count("*").alias("n"))
    names = F.broadcast(sits.sparkSession.createDataFrame([(d, 1 if d in STRUCTURAL else LEAST_SENTENCES) for d in TAXONOMY], "dimension string, least int"))
    grid = n.select(by).distinct().join(names, F.lit(True))  # ten rows an author
    return grid.join(n, [by, "dimension"], "left").select(by, "dimension", F.coalesce("n", F.lit(0)).alias("n"), (F.coalesce("n", F.lit(0)) >= F.col("least")).alias("covered"))


def shortest(sits: DataFrame, by: str, k: int = 3) -> DataFrame:
    """K3: the ``k`` shortest distinct sentences of each dimension, ties by text."""
    rank = F.row_number().over(Window.partitionBy(by, "dimension").orderBy(F.length("sentence"), "sentence"))
    return sits.distinct().withColumn("rank", rank).where(F.col("rank") <= k)


def top_words(docs: DataFrame, by: str, what: str, k: int, text_col: str = "text") -> DataFrame:
    """K4: top contractions or opening words: ``by, rank, word, n``; count desc, word asc."""
    sentences = docs.select(by, F.explode(text.card_sentences(F.col(text_col))).alias("s")).select(by, text.style_words(F.col("s")).alias("w"))
    picked = F.filter("w", lambda x: x.contains("'")) if what == "contractions" else F.slice("w", 1, 1)
    n = sentences.select(by, F.explode(picked).alias("word")).groupBy(by, "word").agg(F.count("*").alias("n"))
    rank = F.row_number().over(Window.partitionBy(by).orderBy(F.desc("n"), "word"))
    return n.withColumn("rank", rank).where(F.col("rank") <= k).select(by, "rank", "word", "n")


def burstiness(median: Column, iqr: Column) -> Column:
    """K5."""
    ratio = F.try_divide(iqr, median)
    return F.when(median <= 0, "uneven").when(ratio < 0.5, "steady").when(ratio < 1.1, "moderately bursty").otherwise("very bursty")


def never_does(punctuation: Column) -> Column:
    """K6: names of the marks with rate 0 in a map of rates."""
    named = [(";", "semicolons"), ("!", "exclamation points"), (":", "colons"), ("-", "hyphenated dashes"), ("(", "parentheticals")]
    return F.array_compact(F.array(*[F.when(F.coalesce(punctuation[m], F.lit(0.0)) == 0.0, F.lit(name)) for m, name in named]))


def sheets(sits: DataFrame, by: str) -> DataFrame:
    """K7: one markdown sheet for each covered situation: ``by, situation, text``."""
    facts = sits.groupBy(by, F.col("dimension").alias("situation")).agg(F.count("*").alias("n"), F.percentile(F.size(text.style_words(F.col("sentence"))), 0.5).alias("median"), F.count(F.when(F.rtrim("sentence").endswith("?"), 1)).alias("questions"))
    snippets = shortest(sits, by).groupBy(by, F.col("dimension").alias("situation")).agg(F.array_sort(F.collect_list(F.struct("rank", "sentence"))).alias("x"))
    covered = coverage(sits, by).where("covered").select(by, F.col("dimension").alias("situation"))
    how = F.create_map(*[F.lit(x) for kv in HOW_TO.items() for x in kv])
    rows = covered.join(facts, [by, "situation"]).join(snippets, [by, "situation"])
    body = F.concat_ws(
        "\n",
        F.concat(F.lit("# Voice sheet: "), F.replace("situation", F.lit("-"), F.lit(" "))),
        F.lit(""),
        how[F.col("situation")],
        F.lit(""),
        F.lit("## Sample snippets"),
        F.array_join(F.transform("x", lambda s: F.concat(F.lit("> "), s["sentence"])), "\n"),
        F.lit(""),
        F.lit("## Measured markers"),
        F.format_string("- Sentences in samples exercising this: %d.", "n"),
        F.format_string("- Median length of those sentences: %d words.", F.col("median").cast("long")),
        F.format_string("- Direct questions to the reader: %d.", "questions"),
    )
    return rows.select(by, "situation", body.alias("text"))


def first_difference(a: DataFrame, b: DataFrame, id_col: str, tolerance: float = 1e-6) -> DataFrame:
    """K8: ``id, path``: the first path at which two flattened profiles (id, path, value double, whole boolean) disagree.

    Whole numbers compare exactly, others within the tolerance; rows of the
    word background should be left out beforehand.
    """
    j = a.alias("a").join(b.alias("b"), [id_col, "path"], "full")
    same = F.when(F.col("a.whole") & F.col("b.whole"), F.col("a.value") == F.col("b.value")).otherwise(F.abs(F.col("a.value") - F.col("b.value")) <= tolerance)
    return j.where(~F.coalesce(same, F.lit(False))).groupBy(id_col).agg(F.min("path").alias("path"))


def typical_length(sits: DataFrame, by: str) -> DataFrame:
    """Mean words of each dimension's sentences."""
    return sits.groupBy(by, "dimension").agg(F.round(F.avg(F.size(text.style_words(F.col("sentence")))), 3).alias("words"), F.count("*").alias("n"))


def card_stats(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Median and IQR of sentence lengths with the burstiness label, per row."""
    from quillspark.operators.style import length_stats

    lengths = F.transform(text.style_sentences(F.col(text_col)), lambda s: F.size(text.style_words(s)))
    rows = docs.withColumn("_s", length_stats(lengths)).withColumn("mean_length", F.round(numbers.mean(lengths), 3))
    return rows.withColumn("median", F.col("_s")["median"]).withColumn("iqr", F.col("_s")["iqr"]).withColumn("burstiness", burstiness(F.col("median"), F.col("iqr"))).drop("_s")
