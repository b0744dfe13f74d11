"""Rule matching, masking, facts, differences."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillspark.functions import text
from quillspark.operators import detect, diff, facts, grading
from quillspark.plans import rules
from quillspark.queries import sql
from quillspark.queries.base import altered, altered_sql, documents, query, seeded, seeded_sql, table

#: All literals.
SQL_PHRASES = [r for r in rules.catalog() if r.kind == "phrase"]


def _doubled(phrase: str) -> str:
    """A literal in a text whose separators are doubled, so that neighbours don't use up each other's edge."""
    return "".join(c if c.isascii() and (c.isalnum() or c in "_-") else c + c for c in phrase)


def _bounded(r: rules.Rule) -> str:
    """A literal with its boundary classes consumed."""
    left = "(?:^|[^a-z0-9_-])" if r.pattern[0].isalnum() else ""
    right = "(?:$|[^a-z0-9_-])" if r.pattern[-1].isalnum() else ""
    return left + "".join("\\" + c if c in ".+*?()[]|^$\\" else c for c in _doubled(r.pattern)) + right


def _seeded(spark, sf, *more):
    return seeded(documents(spark, sf, "doc_id", "text", *more))


@query(
    f"""
    WITH d AS (SELECT doc_id, regexp_replace(lower(text), '([^a-z0-9_-])', '\\1\\1', 'g') AS t FROM ({seeded_sql('doc_id')})),
    r AS (SELECT unnest({sql.listed(r.category for r in SQL_PHRASES)}) AS category, unnest({sql.listed(_bounded(r) for r in SQL_PHRASES)}) AS pattern, unnest({sql.listed(_doubled(r.pattern) for r in SQL_PHRASES)}) AS phrase),
    h AS (SELECT doc_id, category, len(regexp_extract_all(t, pattern)) AS n FROM d JOIN r ON contains(t, phrase))
    SELECT doc_id, category, sum(n)::BIGINT AS n FROM h WHERE n > 0 GROUP BY doc_id, category
    """
)
def phrase_counts_by_category(spark, sf):
    """Literal phrases by document and category."""
    return detect.phrase_counts(_seeded(spark, sf), SQL_PHRASES)


@query()
def phrase_scan(spark, sf):
    """All rules over all documents: violations by rule."""
    rows = detect.scan(_seeded(spark, sf)).select(F.explode_outer("violations").alias("v")).where("v is not null")
    return rows.groupBy(F.col("v")["rule_id"].alias("rule_id"), F.col("v")["category"].alias("category"), F.col("v")["severity"].alias("severity"), F.col("v")["suggestion"].alias("suggestion")).agg(F.count("*").alias("n"), F.min("v.line_number").alias("first_line"))


@query()
def severity_gate(spark, sf):
    """Documents by what the gate over all their findings says."""
    return detect.severity_gate(detect.scan(_seeded(spark, sf))).groupBy("gate").agg(F.count("*").alias("n"), F.sum("hard").alias("hard"), F.sum("soft").alias("soft"))


@query()
def masked_text(spark, sf):
    """Documents with code and quotes blanked: lengths stay."""
    rows = documents(spark, sf, "doc_id", "text").withColumn("m", detect.masked(F.col("text")))
    return rows.select("doc_id", F.length("text").alias("length"), F.length("m").alias("masked_length"), (F.col("m") != F.col("text")).alias("changed"))


_WORDS = f"""
    w AS (SELECT doc_id, list_transform(range(1, len(t) + 1), lambda i: {{'i': i, 'w': t[i]}}) AS x FROM (SELECT doc_id, {sql.prose_words('text')} AS t FROM documents)),
    s AS (SELECT doc_id, (x.i - 1)::INT AS start, (x.i - 1 + length(x.w) % 5)::INT AS "end", (length(x.w) % 4)::INT AS rule_id FROM (SELECT doc_id, unnest(x) AS x FROM w) WHERE length(x.w) > 2)
"""


def _spans(spark, sf):
    """A span relation from word places: each word over two letters is a span of its place and length."""
    rows = documents(spark, sf, "doc_id", "text").select("doc_id", F.posexplode(text.prose_words(F.col("text"))).alias("at", "w")).where(F.length("w") > 2)
    return rows.select("doc_id", F.col("at").alias("start"), (F.col("at") + F.length("w") % 5).cast("int").alias("end"), (F.length("w") % 4).cast("int").alias("rule_id"))


@query(f"WITH {_WORDS}, g AS (SELECT *, count(*) OVER (PARTITION BY doc_id, rule_id) AS n FROM s) SELECT doc_id, rule_id, count(*) AS kept FROM g WHERE n >= rule_id * 20 GROUP BY ALL")
def phrase_findings_gated(spark, sf):
    """Frequency gate over a span relation (rule r needs 20 r matches)."""
    spans = _spans(spark, sf).withColumn("min_matches", F.col("rule_id") * 20)
    return detect.frequency_gate(spans).groupBy("doc_id", "rule_id").agg(F.count("*").alias("kept"))


@query(
    f"""
    WITH {_WORDS}, c AS (SELECT *, (coalesce(max("end") OVER (PARTITION BY doc_id ORDER BY start RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) >= "end"
      OR max("end") OVER (PARTITION BY doc_id, start) > "end") AND rule_id <> 3 AS contained FROM s)
    SELECT doc_id, count(*) AS spans, count(*) FILTER (contained) AS contained FROM c GROUP BY doc_id
    """
)
def span_containment(spark, sf):
    """Containment over a span relation; rule 3 is exempt."""
    spans = detect.containment(_spans(spark, sf).withColumn("exempt", F.col("rule_id") == 3))
    return spans.groupBy("doc_id").agg(F.count("*").alias("spans"), F.count_if("contained").alias("contained"))


_HITS = f"""
    d AS (SELECT doc_id, source, lower(text) AS t FROM ({seeded_sql()})),
    r AS (SELECT unnest({sql.listed(r.category for r in SQL_PHRASES)}) AS category, unnest({sql.listed(r.severity for r in SQL_PHRASES)}) AS severity, unnest({sql.listed(r.pattern for r in SQL_PHRASES)}) AS phrase),
    h AS (SELECT doc_id, source, category, severity FROM d JOIN r ON contains(t, phrase))
"""


def _hits(spark, sf):
    """Which phrases a document holds at all: a narrow pass with the rules as an array."""
    rules_ = F.array(*[F.struct(F.lit(r.category).alias("category"), F.lit(r.severity).alias("severity"), F.lit(r.pattern).alias("phrase")) for r in SQL_PHRASES])
    low = _seeded(spark, sf, "source").withColumn("t", F.lower("text"))
    return low.select("doc_id", "source", F.inline(F.filter(rules_, lambda r: F.col("t").contains(r["phrase"])))).drop("phrase")


_PACKS = f"SELECT unnest({sql.listed(rules.pack_of())}) AS category, unnest({sql.listed(rules.pack_of().values())}) AS pack"


@query(f"WITH {_HITS}, p AS ({_PACKS}) SELECT pack, severity, count(*) AS n FROM h LEFT JOIN p USING (category) GROUP BY ROLLUP (pack, severity)")
def category_pack_rollup(spark, sf):
    """Findings by pack and severity with subtotals."""
    return detect.by_pack(_hits(spark, sf))


@query(f"WITH {_HITS} SELECT source, severity, category, count(*) AS n FROM h GROUP BY GROUPING SETS ((source), (source, severity), (source, category))")
def finding_summary(spark, sf):
    """Totals by severity and by category of each source in one pass."""
    return detect.summary(_hits(spark, sf), "source")


_ALL = [r for r in rules.catalog() if r.kind == "phrase"]
_ALL_SQL = f"SELECT unnest({[r.rule_id for r in _ALL]})::INT AS rule_id, unnest({sql.listed(r.pattern for r in _ALL)}) AS pattern, unnest({sql.listed(r.category for r in _ALL)}) AS category"


@query(f"WITH r AS ({_ALL_SQL}) SELECT rule_id, pattern, category FROM r WHERE NOT EXISTS (SELECT 1 FROM ({seeded_sql('doc_id')}) d WHERE contains(lower(d.text), r.pattern))")
def uncovered_rules(spark, sf):
    """Literal rules that no document holds."""
    patterns = F.array(*[F.struct(F.lit(r.rule_id).alias("rule_id"), F.lit(r.pattern).alias("p")) for r in _ALL])
    low = _seeded(spark, sf).select(F.lower("text").alias("t"))
    hits = low.select(F.inline(F.filter(patterns, lambda r: F.col("t").contains(r["p"])))).select("rule_id").distinct()
    return grading.uncovered_rules(rules.as_table(spark, _ALL).select("rule_id", "pattern", "category"), hits)


@query(
    f"""
    WITH r AS ({_ALL_SQL}), c AS (SELECT DISTINCT regexp_replace(lower(event_type), '[^a-z]', '_', 'g') AS category FROM events UNION SELECT 'jargon' UNION SELECT 'filler')
    SELECT DISTINCT category, 'unprotected' AS problem FROM r WHERE category NOT IN (SELECT category FROM c)
    UNION ALL SELECT category, 'unknown' FROM c WHERE category NOT IN (SELECT category FROM r)
    """
)
def unprotected_categories(spark, sf):
    """Rule categories without a claim, and claims without a category (event types stand in for claims)."""
    claims = table(spark, sf, "events").select(F.regexp_replace(F.lower("event_type"), "[^a-z]", "_").alias("category")).distinct()
    claims = claims.union(spark.createDataFrame([("jargon",), ("filler",)], "category string"))
    return grading.protection_problems(rules.as_table(spark, _ALL), claims)


@query(
    f"""
    WITH r AS (SELECT DISTINCT category FROM ({_ALL_SQL})), p AS ({_PACKS})
    SELECT category, 'in no pack' AS problem FROM r WHERE category NOT IN (SELECT category FROM p)
    UNION ALL SELECT category, 'without a rule' FROM p WHERE category NOT LIKE 'macro_%' AND category NOT IN (SELECT category FROM r)
    """
)
def pack_integrity(spark, sf):
    """Literal categories and packs that don't fit each other."""
    packs = spark.createDataFrame(sorted(rules.pack_of().items()), "category string, pack string")
    return detect.pack_problems(packs, rules.as_table(spark, _ALL).select("category"))


_DOC = " ".join(r.category for r in rules.catalog()) + " robust seamless delve into in order to studies show"


@query(f"SELECT pattern FROM ({_ALL_SQL}) WHERE NOT contains({sql.quoted(_DOC.lower())}, lower(pattern))")
def catalog_parity(spark, sf):
    """Literals that a document's text doesn't hold."""
    return grading.missing_entries(rules.as_table(spark, _ALL).select("pattern"), _DOC)


#: Types whose patterns need no lookaround.
SQL_TYPES = ["currency", "percentage", "date_iso", "date_quarter", "year", "email", "url", "and_or", "version", "reference", "quote", "count", "range"]


def _facts_sql() -> str:
    parts = []
    for kind, pattern in facts.PATTERNS:
        if kind in SQL_TYPES:
            parts.append(f"SELECT doc_id, '{kind}' AS type, {sql.count_of('text', pattern)} AS n FROM d")
    return f"WITH d AS ({seeded_sql('doc_id')}), x AS ({' UNION ALL '.join(parts)}) SELECT doc_id, type, n FROM x WHERE n > 0"


@query(_facts_sql())
def constraint_counts(spark, sf):
    """Facts of each type in every document, counted JVM-side."""
    return facts.counts(_seeded(spark, sf), SQL_TYPES)


@query()
def constraint_spans(spark, sf):
    """Facts with their spans, by type."""
    rows = _seeded(spark, sf).select("doc_id", F.inline(facts.constraints(F.col("text"))))
    return rows.groupBy("type").agg(F.count("*").alias("n"), F.sum(F.col("end") - F.col("start")).alias("characters"))


def _plain(c: str) -> str:
    """Lower case, with a letter for every non-ASCII character, so that word boundaries agree."""
    return f"regexp_replace(lower({c}), '[^\\x00-\\x7F]', 'x', 'g')"


def _drift_sql() -> str:
    scope = facts.whole(facts.SCOPES)
    n = lambda c, w: f"{sql.count_of(_plain(c), facts.whole(w))}::INT"
    cols = ", ".join(f"{n('original', w)} AS {k}, {n('rewritten', w)} AS {k}_left" for k, w in (("negations", facts.NEGATIONS), ("conditions", facts.CONDITIONS), ("weak", facts.WEAK), ("strong", facts.STRONG)))
    lost = f"array_to_string(list_sort(list_filter(list_distinct({sql.found(_plain('original'), scope)}), lambda w: NOT list_contains({sql.found(_plain('rewritten'), scope)}, w))), ',')"
    return f"SELECT doc_id, {cols}, {lost} AS lost_scope FROM ({altered_sql()})"


@query(_drift_sql())
def preservation_drift(spark, sf):
    """Negations, conditions, modals and scope words lost between a document and its rewrite."""
    rows = altered(_seeded(spark, sf)).withColumn("d", facts.drift(F.col("original"), F.col("rewritten")))
    return rows.select("doc_id", *[f"d.{k}{s}" for k in ("negations", "conditions", "weak", "strong") for s in ("", "_left")], F.array_join("d.lost_scope", ",").alias("lost_scope"))


@query()
def preservation(spark, sf):
    """Facts kept and lost between a document and its rewrite."""
    rows = facts.validate(altered(_seeded(spark, sf)))
    return rows.select("doc_id", "preservation.passed", "preservation.total_constraints", "preservation.preserved", F.size("preservation.warnings").alias("warnings"))


_TOKENS = r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]"


@query(
    f"""
    WITH p AS ({altered_sql()}),
    t AS (SELECT doc_id, unnest({sql.found('lower(original)', _TOKENS)}) AS w, 0 AS side FROM p UNION ALL SELECT doc_id, unnest({sql.found('lower(rewritten)', _TOKENS)}), 1 FROM p),
    n AS (SELECT doc_id, w, count(*) FILTER (side = 0) AS a, count(*) FILTER (side = 1) AS b FROM t GROUP BY ALL)
    SELECT doc_id, sum(least(a, b))::BIGINT AS shared, sum(a)::BIGINT AS tokens, round(sum(least(a, b)) / sum(a), 6) AS overlap FROM n GROUP BY doc_id
    """
)
def bag_overlap(spark, sf):
    """Tokens shared as multisets between a document and its rewrite."""
    return diff.bag_overlap(altered(_seeded(spark, sf)), "doc_id", "original", "rewritten")


@query()
def word_diff(spark, sf):
    """Word-level difference of a document and its rewrite."""
    return diff.diff(altered(_seeded(spark, sf))).select("doc_id", "diff.*")


@query(
    f"""
    WITH d AS (SELECT doc_id, text AS t, strpos(text, chr(10)) - 1 AS s FROM documents WHERE contains(text, chr(10)))
    SELECT doc_id, (length(substr(t, 1, s + 1)) - length(replace(substr(t, 1, s + 1), chr(10), '')) + 1)::INT AS line, 1::INT AS "column" FROM d
    """
)
def line_positions(spark, sf):
    """Line and column of the character after each document's first newline."""
    d = documents(spark, sf, "doc_id", "text").where(F.col("text").contains("\n"))
    s = F.instr("text", "\n")
    return d.select("doc_id", text.line_of(F.col("text"), s).alias("line"), text.column_of(F.col("text"), s).alias("column"))


@query()
def top_changes(spark, sf):
    """The three most changed documents of each source: a top-k report."""
    rows = diff.diff(altered(_seeded(spark, sf, "source"))).withColumn("changed", F.col("diff")["change_percentage"])
    return diff.largest_changes(rows, 3, "source", "changed").select("source", "rank", "doc_id", "changed")
