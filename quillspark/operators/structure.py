"""Macro-structure scanner (D10-D26): cadence, openers, closers, lists, as columns of one document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions import numbers, text

# Patterns and thresholds of the metrics.
CONNECTIVES = "however moreover furthermore additionally in_addition overall consequently nevertheless".split()
PREDICATES = "is are was were be been being has have had do does did can will shall must should would may might".split()
SIGNPOSTS = ["first,", "next,", "having (?:covered|established)", "in (?:this|the following|the next) section", "as (?:mentioned|noted) (?:above|earlier)", "let us turn", "let's turn"]
TAILS = "ensuring highlighting reflecting allowing enabling underscoring showcasing emphasizing fostering driving paving reinforcing solidifying demonstrating contributing_to".split()
CODAS = ["ultimately,", "in the end,", "in conclusion", "as we've seen", "only time will tell", "remember,", r"the future\b"]
ENUMERATION = "the a an section chapter figure table step part appendix".split()
SUPPRESSED = {"docs": {"bold_colon_listicle"}, "social": {"one_line_staccato"}}


def one_of(items: list[str]) -> str:
    return "(?:" + "|".join(x.replace("_", " ") for x in items) + ")"


CONNECTIVE_OPENER = f"(?i)^{one_of(CONNECTIVES)}\\b"
EVERY_OPENER = rf"(?i)^every\s+[a-z][\w'-]*\s+(?:{one_of(PREDICATES)}|[a-z]+(?:s|ed))\b"
SIGNPOST = rf"(?i)\b{one_of(SIGNPOSTS)}\b"
CLOSER = rf"(?i),\s+{one_of(TAILS)}\b[^.!?]*[.!?\"]?$"
CODA = f"(?i)^{one_of(CODAS)}"
BOLD_LABEL = r"(?m)^\s*[-*+]?\s*\*\*[^*]{1,40}\*\*\s*:"
TRIAD = r"\b[A-Za-z][A-Za-z-]+,\s+[A-Za-z][A-Za-z-]+,\s+and\s+[A-Za-z][A-Za-z-]+\b"


def bigrams(tokens: Column) -> Column:
    """Distinct neighbouring pairs."""
    return text.word_grams(tokens, 2)


def openers(sentences: Column) -> Column:
    """First T1 word of each sentence that has one, without enumeration leaders."""
    firsts = F.transform(sentences, lambda s: F.get(text.prose_words(s), F.lit(0)))
    return F.filter(firsts, lambda w: w.isNotNull() & ~F.array_contains(text.words_in(ENUMERATION), w))


def top_count(xs: Column) -> Column:
    """Count of the most frequent element: the longest run of equals in sorted order."""
    return F.when(F.size(xs) > 0, numbers.longest_run(F.array_sort(xs), lambda p, x: p == x) + 1).otherwise(0)


def prepared(docs: DataFrame, text_col: str = "text", separator: str = text.BLANK_LINE) -> DataFrame:
    """The views that the metrics share: ``_p`` paragraphs, ``_s`` sentences, ``_n`` their lengths, ``_w`` number of words, ``_o`` openers."""
    rows = docs.withColumn("_p", text.paragraphs(F.col(text_col), blank_blockquotes=True, separator=separator))
    rows = rows.withColumn("_prose", F.array_join("_p", "\n\n"))
    rows = rows.withColumn("_s", text.sentences(F.col("_prose")))
    rows = rows.withColumn("_n", F.transform("_s", lambda s: F.size(text.prose_words(s))))
    rows = rows.withColumn("_w", F.size(text.prose_words(F.col("_prose"))))
    rows = rows.withColumn("_first", text.structure_content(F.element_at("_p", 1))).withColumn("_last", text.structure_content(F.element_at("_p", -1)))
    rows = rows.withColumn("_first", F.when(F.size("_p") > 0, bigrams(F.col("_first")))).withColumn("_last", F.when(F.size("_p") > 0, bigrams(F.col("_last"))))
    return rows.withColumn("_o", openers(F.col("_s")))


def views(t: Column, separator: str = text.BLANK_LINE) -> Column:
    """The views of ``prepared`` as one struct; each is bound, so the optimizer can't copy one into every use."""

    def of(p: Column, prose: Column, s: Column) -> Column:
        edge = lambda at: F.when(F.size(p) > 0, bigrams(text.structure_content(F.element_at(p, at))))
        return F.struct(
            p.alias("_p"),
            prose.alias("_prose"),
            s.alias("_s"),
            F.transform(s, lambda x: F.size(text.prose_words(x))).alias("_n"),
            F.size(text.prose_words(prose)).alias("_w"),
            edge(1).alias("_first"),
            edge(-1).alias("_last"),
            openers(s).alias("_o"),
        )

    def joined(p: Column) -> Column:
        return numbers.let(F.array_join(p, "\n\n"), lambda prose: numbers.let(text.sentences(prose), lambda s: of(p, prose, s)))

    return numbers.let(text.paragraphs(t, blank_blockquotes=True, separator=separator), joined)


def metrics(text_col: str | Column = "text", view=F.col) -> Column:
    """The 16 metrics over the prepared views, as one struct; ``view`` gives a view by its name."""
    text_col = F.col(text_col) if isinstance(text_col, str) else text_col
    p, s, w, o = F.size(view("_p")), F.size(view("_s")), view("_w"), view("_o")
    per = lambda n, of, times: F.when(of > 0, F.round(n / of * times, 3)).otherwise(0.0)
    shared, either = F.size(F.array_intersect(view("_first"), view("_last"))), F.size(F.array_union(view("_first"), view("_last")))
    short = F.filter(view("_p"), lambda x: (F.size(text.sentences(x)) == 1) & (F.size(text.prose_words(x)) < 12))
    enough = (s >= 5) & (F.size(o) > 0)
    return F.struct(
        F.round(numbers.variation(view("_n")), 3).alias("sentence_burstiness"),
        F.when((p >= 2) & (either > 0), F.round(shared / either, 3)).otherwise(0.0).alias("summary_sandwich"),
        F.round(numbers.variation(F.transform(view("_p"), lambda x: F.size(text.prose_words(x)))), 3).alias("paragraph_cv"),
        F.coalesce(F.round(numbers.mean(view("_n")), 1), F.lit(0.0)).alias("sentence_mean_len"),
        per(text.count_of(view("_prose"), TRIAD), w, 1000).alias("triad_density"),
        per(F.length(text_col) - F.length(F.replace(text_col, F.lit("—"), F.lit(""))), w, 1000).alias("em_dash_per_1k"),
        text.count_of(text_col, BOLD_LABEL).alias("bold_colon_listicle_count"),
        F.when(p > 0, F.round(F.size(short) / p, 3)).otherwise(0.0).alias("one_line_staccato_share"),
        F.size(F.filter(view("_p"), lambda x: x.rlike(CONNECTIVE_OPENER))).alias("connective_paragraph_openers"),
        F.size(F.filter(view("_p"), lambda x: x.rlike(EVERY_OPENER))).alias("every_template_openers"),
        per(text.count_of(view("_prose"), SIGNPOST), w, 100).alias("signpost_density"),
        F.when(enough, F.round(F.size(F.array_distinct(o)) / F.size(o), 3)).otherwise(0.0).alias("opener_unique_ratio"),
        F.when(enough, F.round(top_count(o) / F.size(o), 3)).otherwise(0.0).alias("top_opener_share"),
        F.when(enough, numbers.longest_run(o, lambda a, b: a == b) + 1).otherwise(0).alias("max_consecutive_opener"),
        F.when(s > 0, F.round(F.size(F.filter(view("_s"), lambda x: x.rlike(CLOSER))) / s, 3)).otherwise(0.0).alias("participial_closer_share"),
        F.when(p >= 3, F.element_at(view("_p"), -1).rlike(CODA) | (shared >= 2)).otherwise(F.lit(False)).alias("conclusion_coda"),
    )


#: metric -> (value, condition, threshold); m: metrics, p and s: paragraphs and sentences, w: words.
def rules(m, p, s, w, openers_, genre: str) -> list[tuple[str, Column, Column, str]]:
    top = F.round(m["top_opener_share"] * F.size(openers_), 0)
    found = [
        ("sentence_burstiness", m["sentence_burstiness"], (s >= 8) & (m["sentence_burstiness"] < 0.55), "< 0.55 over at least 8 prose sentences"),
        ("conclusion_coda", F.lit(1.0), m["conclusion_coda"], "last paragraph starts with a stock coda or repeats 2+ first-paragraph content bigrams"),
        ("bold_colon_listicle", m["bold_colon_listicle_count"], m["bold_colon_listicle_count"] >= 3, ">= 3 bold-label colon lines"),
        ("one_line_staccato", m["one_line_staccato_share"], (p >= 6) & (m["one_line_staccato_share"] > 0.6), "> 0.60 over at least 6 paragraphs"),
        (
            "connective_paragraph_openers",
            m["connective_paragraph_openers"],
            (m["connective_paragraph_openers"] >= 3) | ((p >= 8) & (m["connective_paragraph_openers"] / p > 0.4)),
            ">= 3 paragraphs or > 40% of 8+ paragraphs",
        ),
        ("every_template_openers", m["every_template_openers"], m["every_template_openers"] >= 2, ">= 2 paragraphs opening 'Every <noun> <verb>'"),
        ("signpost_density", m["signpost_density"], (w >= 150) & (m["signpost_density"] > 0.6), "> 0.6 per 100 prose words, minimum 150 words"),
        (
            "opener_repetition",
            m["opener_unique_ratio"],
            (s >= 5) & ((m["opener_unique_ratio"] < 0.55) | ((m["top_opener_share"] > 0.25) & (top >= 4)) | (m["max_consecutive_opener"] >= 4)),
            "unique ratio < 0.55, one opener > 25% with 4+ uses, or 4 consecutive identical openers",
        ),
        ("participial_closer_share", m["participial_closer_share"], (s >= 8) & (m["participial_closer_share"] >= 0.15), ">= 0.15 over at least 8 prose sentences"),
    ]
    return [r for r in found if r[0] not in SUPPRESSED.get(genre, set())]


def scan(docs: DataFrame, text_col: str = "text", genre: str = "prose", separator: str = text.BLANK_LINE) -> DataFrame:
    """Add ``structure``: metrics, flags, genre, numbers of sentences and paragraphs; and ``declined``.

    A text is declined only if nothing was flagged and it isn't English.
    Null texts give null.  Nothing is shuffled.
    """

    def judged(v: Column, m: Column) -> Column:
        p, s = F.size(v["_p"]), F.size(v["_s"])
        fired = [
            F.when(fires, F.struct(F.lit(name).alias("metric"), value.cast("double").alias("value"), F.lit(limit).alias("threshold"), F.lit("soft").alias("severity")))
            for name, value, fires, limit in rules(m, p, s, v["_w"], v["_o"], genre)
        ]
        return F.struct(m.alias("metrics"), F.array_compact(F.array(*fired)).alias("flags"), F.lit(genre).alias("genre"), s.alias("prose_sentences"), p.alias("prose_paragraphs"))

    def measured(t: Column) -> Column:
        return numbers.let(views(t, separator), lambda v: numbers.let(metrics(t, v.__getitem__), lambda m: judged(v, m)))

    there = F.col(text_col).isNotNull()
    rows = docs.select(*docs.columns, F.when(there, numbers.let(F.col(text_col), measured)).alias("structure"))
    declined = (F.size(F.col("structure")["flags"]) == 0) & ~text.is_english(text.english_tokens(F.col(text_col)))
    return rows.withColumn("declined", F.when(there, declined))
