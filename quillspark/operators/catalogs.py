"""Catalog sync, contribution, staleness."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions import text
from quillspark.operators import detect, structure

# Keyword, target section; the first that a title holds decides.
TARGETS = [
    ("words to watch", "AI Vocabulary (Additional)"),
    ("promotional", "Promotional Language"),
    ("significance", "Significance & Legacy Inflation"),
    ("legacy", "Significance & Legacy Inflation"),
    ("vague", "Vague Attributions"),
    ("attribution", "Vague Attributions"),
    ("copula", "Copula Avoidance"),
    ("participial", "Superficial -ing Analyses"),
    ("chatbot", "Communication Artifacts"),
    ("jargon", "Business Jargon"),
    ("structure", "Structural Patterns to Avoid"),
    ("synonym", "Elegant Variation / Synonym Cycling"),
]
DEFAULT_TARGET = "AI Vocabulary (Additional)"
STALE_DAYS = {"wiki": 90, "bench": 180, "rows": 60}
HEADING = r"^(={2,6})\s*(.+?)\s*\1\s*$"


def sections(pages: DataFrame, id_col: str = "page_id", text_col: str = "text") -> DataFrame:
    """``id, place, title, level, content, watch_words, examples``; text before the first heading is Introduction, level 1.

    Lines are numbered inside their row; a running count of headings tells the
    section, so only a page's own lines meet in a task.
    """
    lines = pages.select(id_col, F.posexplode(F.split(text_col, "\n")).alias("at", "line"))
    level = F.length(F.regexp_extract("line", HEADING, 1))
    lines = lines.withColumn("level", F.when(level > 0, level)).withColumn("title", F.when(level > 0, F.regexp_extract("line", HEADING, 2)))
    so_far = Window.partitionBy(id_col).orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    lines = lines.withColumn("place", F.count("title").over(so_far))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("title").isNull(), F.struct("at", "line")))), lambda x: x["line"]), "\n")
    rows = lines.groupBy(id_col, "place").agg(F.coalesce(F.max("title"), F.lit("Introduction")).alias("title"), F.coalesce(F.max("level"), F.lit(1)).alias("level"), F.count(F.when(F.col("title").isNull(), 1)).alias("n"), body.alias("content"))
    rows = rows.where("n > 0").withColumn("content", text.strip(F.col("content")))
    return rows.select(id_col, "place", "title", "level", "content", watch_words(F.col("content")).alias("watch_words"), examples(F.col("content")).alias("examples"))


def watch_words(content: Column) -> Column:
    """Bold words in message boxes, bold runs under 50 characters, bold list items; distinct, in order."""
    bold = lambda t: F.transform(F.regexp_extract_all(t, F.lit(r"'''(.+?)'''"), F.lit(1)), F.trim)
    boxes = F.regexp_extract_all(content, F.lit(r"(?s)\{\{tmbox\|[^}]*text\s*=\s*([^}]+)\}\}"), F.lit(1))
    short = F.filter(bold(content), lambda w: (w != "") & (F.length(w) < 50))
    items = F.transform(F.regexp_extract_all(content, F.lit(r"(?m)^\*\s*'''(.+?)'''"), F.lit(1)), F.trim)
    return F.array_distinct(F.concat(F.flatten(F.transform(boxes, bold)), short, items))


def examples(content: Column) -> Column:
    """Block quotes, before-and-after templates, runs of indented lines."""
    quotes = F.transform(F.regexp_extract_all(content, F.lit(r"(?s)\{\{blockquote\|([^}]+)\}\}"), F.lit(1)), F.trim)
    pair = r"(?s)\{\{textdiff\|[^}]*old\s*=\s*([^|]+)\|[^}]*new\s*=\s*([^}]+)\}\}"
    both = F.zip_with(F.regexp_extract_all(content, F.lit(pair), F.lit(1)), F.regexp_extract_all(content, F.lit(pair), F.lit(2)), lambda o, n: F.concat(F.lit("BEFORE: "), F.trim(o), F.lit("\nAFTER: "), F.trim(n)))
    runs = F.transform(F.regexp_extract_all(content, F.lit(r"(?m)(?:^:.*(?:\n|$))+"), F.lit(0)), lambda r: F.regexp_replace(F.rtrim(F.regexp_replace(r, r"\n$", "")), r"(?m)^[: ]+", ""))
    return F.concat(quotes, both, runs)


def section_diff(old: DataFrame, new: DataFrame, id_col: str = "page_id") -> DataFrame:
    """``id, title, change, words`` between two versions: new_section, new_words, modified (only without new words), removed."""
    o = old.select(id_col, "title", F.col("content").alias("co"), F.col("watch_words").alias("wo"))
    n = new.select(id_col, "title", F.col("content").alias("cn"), F.col("watch_words").alias("wn"))
    added = F.array_sort(F.array_except("wn", "wo"))
    change = F.when(F.col("co").isNull(), "new_section").when(F.col("cn").isNull(), "removed").when(F.size(added) > 0, "new_words").when(F.sha2("co", 256) != F.sha2("cn", 256), "modified")
    words = F.when(F.col("co").isNull(), F.col("wn")).when(F.col("cn").isNull(), F.col("wo")).otherwise(added)
    return o.join(n, [id_col, "title"], "full").select(id_col, "title", change.alias("change"), words.alias("words")).where("change is not null")


def target(title: Column) -> Column:
    """Catalog section of a page section: the first keyword that the title holds."""
    out = None
    for keyword, section in TARGETS:
        hit = F.lower(title).contains(keyword)
        out = F.when(hit, F.lit(section)) if out is None else out.when(hit, F.lit(section))
    return out.otherwise(F.lit(DEFAULT_TARGET))


def changed(state: DataFrame, current: DataFrame, id_col: str = "page_id") -> DataFrame:
    """Ids whose content hash differs from the saved state, or has none."""
    was = state.select(id_col, F.col("sha256").alias("was"))
    now = current.select(id_col, F.sha2("text", 256).alias("now"))
    return now.join(was, id_col, "left").where("was is null or was <> now").select(id_col)


def prompts(changes: DataFrame, id_col: str = "page_id") -> DataFrame:
    """One markdown task per page listing its changes by target."""
    line = F.concat(F.lit("- ["), F.col("change"), F.lit("] "), F.col("title"), F.lit(" -> "), target(F.col("title")), F.lit(": "), F.array_join("words", ", "))
    rows = changes.groupBy(id_col).agg(F.array_sort(F.collect_list(line)).alias("lines"))
    return rows.select(id_col, F.concat(F.lit("# Catalog changes\n\n"), F.array_join("lines", "\n")).alias("prompt"))


def redacted(t: Column, terms: Column) -> Column:
    """Every (secret, placeholder) of an array replaced, in order."""
    return F.aggregate(terms, t, lambda a, x: F.replace(a, x["secret"], x["placeholder"]))


def redact(rows: DataFrame, text_col: str = "text", tell_col: str = "tell", terms_col: str = "terms") -> DataFrame:
    """Add ``redacted`` and ``valid``: the tell still occurs, as often as before."""
    times = lambda t, x: (F.length(t) - F.length(F.replace(t, x, F.lit("")))) / F.length(x)
    out = rows.withColumn("redacted", redacted(F.col(text_col), F.col(terms_col)))
    before, after = times(F.col(text_col), F.col(tell_col)), times(F.col("redacted"), F.col(tell_col))
    return out.withColumn("valid", (before > 0) & (before == after))


def precheck(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules=None) -> DataFrame:
    """Findings of both scanners as one relation: ``id, source, kind``."""
    words = detect.scan(docs, text_col, rules).select(id_col, F.lit("phrase").alias("source"), F.explode_outer(F.col("violations")["category"]).alias("kind"))
    shape = structure.scan(docs, text_col).select(id_col, F.lit("structure").alias("source"), F.explode_outer(F.col("structure")["flags"]["metric"]).alias("kind"))
    return words.unionByName(shape).where("kind is not null").distinct()


def manifest_problems(bundles: DataFrame) -> DataFrame:
    """U3, its checks: ``slug, problem`` for a bad slug, a hash that doesn't fit, or an open TODO."""
    why = F.array_compact(
        F.array(
            F.when(~F.col("slug").rlike("^[a-z0-9]+(?:-[a-z0-9]+)*$"), F.lit("slug")),
            F.when(F.sha2("redacted", 256) != F.col("post_redaction_sha256"), F.lit("hash")),
            F.when(F.col("redacted").contains("TODO"), F.lit("todo")),
        )
    )
    return bundles.select("slug", F.explode(why).alias("problem"))


def staleness(last: DataFrame, today: Column, key: str, limit: Column) -> DataFrame:
    """U4: add ``days`` and ``stale``; an unknown date is stale."""
    days = F.date_diff(today, F.col("last"))
    return last.withColumn("days", days).withColumn("stale", days.isNull() | (days > limit))


def latest_per_key(events: DataFrame, key: str, at: str) -> DataFrame:
    """Last time of each key: a partial and a final aggregation."""
    return events.groupBy(key).agg(F.max(at).alias("last"))
