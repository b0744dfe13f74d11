"""Readability: Flesch scores, sentence statistics, runs, repetition, flags."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions import numbers, text

EMPTY_FLAG = "Empty or invalid text"


def lengths(sentences: Column) -> Column:
    return F.transform(sentences, lambda s: F.size(text.readability_words(s)))


def flesch(words: Column, sentences: Column, syllables: Column) -> tuple[Column, Column]:
    """Reading ease and grade from counts."""
    per_sentence, per_word = F.try_divide(words, sentences), F.try_divide(syllables, words)
    return F.lit(206.835) - per_sentence * 1.015 - per_word * 84.6, per_sentence * 0.39 + per_word * 11.8 - 15.59


def measure(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Add ``readability`` (a struct of all measures) to every row; nothing is shuffled.

    Texts without sentences or words get zeros and one flag; a null text gives
    a null struct.
    """
    t = F.col(text_col)
    rows = docs.withColumn("_words", text.readability_words(t)).withColumn("_sentences", text.sentences(t))
    rows = rows.withColumn("_lengths", lengths(F.col("_sentences"))).withColumn("_units", lengths(text.staccato_units(t)))
    rows = rows.withColumn("_paragraphs", lengths(text.plain_paragraphs(t))).withColumn("_content", text.readability_content(F.col("_words")))
    rows = rows.withColumn("_syllables", text.total_syllables(F.col("_words")))
    rows = rows.withColumn("_freq", _frequencies(F.col("_content")))
    w, s, n = F.size("_words"), F.size("_sentences"), F.col("_lengths")
    ease, grade = flesch(w, s, F.col("_syllables"))
    average, spread = F.try_divide(w, s), F.array_max(n) - F.array_min(n)
    varied = numbers.variance(n)
    similar = numbers.longest_run(n, lambda p, x: F.abs(x - p) <= 3)
    tiny = _longest_tiny(F.col("_units"))
    repeated = F.aggregate(F.filter("_freq", lambda f: f["n"] >= 3), F.lit(0), lambda a, f: a + f["n"])
    repetition = F.when(F.size("_content") > 0, repeated / F.size("_content") * 100).otherwise(0.0)
    top = F.slice(F.array_sort("_freq", lambda a, b: F.when(a["n"] != b["n"], b["n"] - a["n"]).otherwise(a["at"] - b["at"])), 1, 10)
    empty = (s == 0) | (w == 0)
    one = lambda x: F.format_string("%.1f", x)
    measured = F.struct(ease.alias("ease"), grade.alias("grade"), average.alias("average"), varied.alias("varied"), similar.alias("similar"), tiny.alias("tiny"), repetition.alias("repetition"), spread.alias("spread"))

    def report(m: Column) -> Column:
        flags = F.array_compact(
            F.array(
                F.when(m["grade"] > 12, F.concat(F.lit("High reading level ("), one(m["grade"]), F.lit(" grade)"))),
                F.when((m["varied"] < 10) & (s > 3), F.lit("Low sentence length variance (monotonous rhythm)")),
                F.when(m["similar"] >= 3, F.concat(m["similar"], F.lit("+ consecutive similar-length sentences"))),
                F.when(m["repetition"] > 15, F.concat(F.lit("High word repetition ("), one(m["repetition"]), F.lit("%)"))),
                F.when(m["average"] > 25, F.concat(F.lit("Long average sentence length ("), one(m["average"]), F.lit(" words)"))),
                F.when((m["average"] < 8) & (s > 3), F.lit("Very short sentences (may feel choppy)")),
                F.when(m["tiny"] >= 3, F.concat(F.lit("Staccato cadence: "), m["tiny"], F.lit(" consecutive tiny sentences (anti-slop AI tell)"))).when(
                    (m["average"] < 6) & (s >= 2), F.concat(F.lit("Staccato cadence (avg "), one(m["average"]), F.lit(" words/sentence — anti-slop AI tell)"))
                ),
                F.when((m["spread"] < 5) & (s > 5), F.lit("Sentences all similar length (AI tell)")),
            )
        )
        zero = lambda x, kind="double": F.when(empty, F.lit(0).cast(kind)).otherwise(x.cast(kind))
        return F.struct(
            zero(numbers.rounded(m["grade"], 1)).alias("flesch_kincaid_grade"),
            zero(numbers.rounded(m["ease"], 1)).alias("flesch_reading_ease"),
            zero(s, "int").alias("sentence_count"),
            zero(w, "int").alias("word_count"),
            zero(F.round(m["average"], 1)).alias("avg_sentence_length"),
            zero(F.round(m["varied"], 1)).alias("sentence_length_variance"),
            zero(F.array_min(n), "int").alias("min_sentence_length"),
            zero(F.array_max(n), "int").alias("max_sentence_length"),
            zero(m["similar"], "int").alias("consecutive_similar_length"),
            zero(m["tiny"], "int").alias("staccato_run"),
            zero(F.round(m["repetition"], 1)).alias("word_repetition_score"),
            F.when(empty, F.array().cast("array<struct<word:string,n:int>>")).otherwise(F.transform(top, lambda f: F.struct(f["word"].alias("word"), f["n"].alias("n")))).alias("top_repeated_words"),
            F.size("_paragraphs").alias("paragraph_count"),
            zero(F.round(numbers.mean(F.col("_paragraphs")), 1)).alias("avg_paragraph_length"),
            F.when(empty, F.array(F.lit(EMPTY_FLAG))).otherwise(flags).alias("flags"),
            F.col("_syllables").alias("syllable_count"),
        )

    return rows.select(*docs.columns, F.when(t.isNotNull(), numbers.let(measured, report)).alias("readability"))


def _frequencies(content: Column) -> Column:
    """(word, n, first place) of each distinct word: one sort, then the places where a new word starts; linear beside the sort."""
    placed = F.array_sort(F.transform(content, lambda w, i: F.struct(w.alias("word"), i.alias("at"))))

    def runs(p: Column) -> Column:
        firsts = F.filter(F.transform(p, lambda x, i: F.when((i == 0) | (x["word"] != F.get(p, i - 1)["word"]), i)), lambda i: i.isNotNull())
        return numbers.let(firsts, lambda f: F.transform(f, lambda s, k: F.struct(F.get(p, s)["word"].alias("word"), (F.coalesce(F.get(f, k + 1), F.size(p)) - s).alias("n"), F.get(p, s)["at"].alias("at"))))

    return numbers.let(placed, runs)


def _longest_tiny(units: Column) -> Column:
    """Longest run of units of five words or fewer."""
    start = F.struct(F.lit(0).alias("run"), F.lit(0).alias("best"))

    def step(a, n):
        run = F.when(n <= 5, a["run"] + 1).otherwise(0)
        return F.struct(run.alias("run"), F.greatest(a["best"], run).alias("best"))

    return F.aggregate(units, start, step, lambda a: a["best"])


def by_source(docs: DataFrame, by: str = "source", text_col: str = "text") -> DataFrame:
    """Flesch scores of whole sources from summed counts: one partial and one final aggregation."""
    t = F.col(text_col)
    rows = docs.select(by, text.readability_words(t).alias("w"), F.size(text.sentences(t)).alias("s"))
    rows = rows.select(by, "s", F.size("w").alias("n"), text.total_syllables(F.col("w")).alias("y"))
    sums = rows.groupBy(by).agg(F.count("*").alias("docs"), F.sum("s").alias("sentences"), F.sum("n").alias("words"), F.sum("y").alias("syllables"))
    ease, grade = flesch(F.col("words"), F.col("sentences"), F.col("syllables"))
    return sums.select(by, "docs", "sentences", "words", "syllables", F.round(ease, 3).alias("reading_ease"), F.round(grade, 3).alias("grade"))


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Content words of each document in long form: ``id, word, n, first``."""
    words = text.readability_content(text.readability_words(F.col(text_col)))
    rows = docs.select(id_col, F.posexplode(words).alias("at", "word"))
    return rows.groupBy(id_col, "word").agg(F.count("*").alias("n"), F.min("at").alias("first"))


def repetition(docs: DataFrame, k: int = 10, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """R5, R6 relationally: the top ``k`` words of each document and its repetition score."""
    counts = word_counts(docs, id_col, text_col)
    whole = Window.partitionBy(id_col)
    rows = counts.withColumn("repeated", F.sum(F.when(F.col("n") >= 3, F.col("n")).otherwise(0)).over(whole)).withColumn("content", F.sum("n").over(whole))
    rows = rows.withColumn("rank", F.row_number().over(whole.orderBy(F.desc("n"), "first")))
    return rows.where(F.col("rank") <= k).select(id_col, "rank", "word", "n", F.round(F.col("repeated") / F.col("content") * 100, 3).alias("repetition_score"))


def sentence_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """R3 relationally: longest run of neighbouring sentences within three words, by lag and islands."""
    rows = docs.select(id_col, F.posexplode(lengths(text.sentences(F.col(text_col)))).alias("at", "n"))
    order = Window.partitionBy(id_col).orderBy("at")
    rows = rows.withColumn("near", F.coalesce((F.abs(F.col("n") - F.lag("n").over(order)) <= 3).cast("int"), F.lit(0)))
    rows = rows.withColumn("island", F.sum(1 - F.col("near")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    islands = rows.groupBy(id_col, "island").agg(F.sum("near").alias("run"), F.count("*").alias("sentences"))
    return islands.groupBy(id_col).agg(F.max("run").cast("long").alias("similar_run"), F.sum("sentences").alias("sentences"))
