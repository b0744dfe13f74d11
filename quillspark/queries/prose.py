"""Readability, structure and silhouette queries.

The driver's documents have no blank lines, so a newline separates paragraphs
here; carriers (see ``base``) make rare findings occur.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from quillspark.functions import numbers, text
from quillspark.operators import readability, silhouette, structure
from quillspark.queries import sql
from quillspark.queries.base import documents, query, seeded, seeded_sql

NEWLINE = "\n"

_SYL = sql.total(f"list_transform(w, lambda x: {sql.syllables('x')})")


@query(
    f"""
    WITH d AS (SELECT source, {sql.readability_words('text')} AS w, len({sql.sentences('text')}) AS s FROM documents WHERE lang = 'en'),
    c AS (SELECT source, s, len(w) AS n, {_SYL} AS y FROM d),
    g AS (SELECT source, count(*) AS docs, sum(s)::BIGINT AS sentences, sum(n)::BIGINT AS words, sum(y)::BIGINT AS syllables FROM c GROUP BY source)
    SELECT *, round(206.835 - words / sentences * 1.015 - syllables / words * 84.6, 3) AS reading_ease, round(words / sentences * 0.39 + syllables / words * 11.8 - 15.59, 3) AS grade FROM g
    """
)
def readability_by_source(spark, sf):
    """Flesch scores of the English documents of each source."""
    return readability.by_source(documents(spark, sf).where("lang = 'en'"))


@query(
    f"""
    WITH d AS (SELECT doc_id, text, {sql.readability_words('text')} AS w, {sql.sentences('text')} AS s FROM documents),
    n AS (SELECT doc_id, w, s, list_transform(s, lambda x: len({sql.readability_words('x')})) AS l,
          list_transform({sql.staccato_units('text')}, lambda x: len({sql.readability_words('x')})) AS u, {_SYL} AS y FROM d),
    r AS (SELECT *, list_transform(u, lambda x: CASE WHEN x <= 5 THEN 'x' ELSE ' ' END) AS tiny FROM n)
    SELECT doc_id,
      CASE WHEN len(s) = 0 OR len(w) = 0 THEN 0 ELSE round(len(w) / len(s) * 0.39 + y / len(w) * 11.8 - 15.59, 1) END AS grade,
      CASE WHEN len(s) = 0 OR len(w) = 0 THEN 0 ELSE round(206.835 - len(w) / len(s) * 1.015 - y / len(w) * 84.6, 1) END AS ease,
      CASE WHEN len(w) = 0 THEN 0 ELSE len(s) END::INT AS sentences, CASE WHEN len(s) = 0 THEN 0 ELSE len(w) END::INT AS words,
      CASE WHEN len(s) = 0 OR len(w) = 0 THEN 0 ELSE list_min(l) END::INT AS shortest, CASE WHEN len(s) = 0 OR len(w) = 0 THEN 0 ELSE list_max(l) END::INT AS longest,
      CASE WHEN len(s) = 0 OR len(w) = 0 THEN 0 ELSE coalesce(list_max(list_transform(string_split(array_to_string(tiny, ''), ' '), lambda x: length(x))), 0) END::INT AS staccato_run
    FROM r
    """
)
def readability_metrics(spark, sf):
    """Readability struct of every document (the parts that SQL states)."""
    r = readability.measure(documents(spark, sf, "doc_id", "text"))
    x = F.col("readability")
    return r.select(
        "doc_id",
        x["flesch_kincaid_grade"].alias("grade"),
        x["flesch_reading_ease"].alias("ease"),
        x["sentence_count"].alias("sentences"),
        x["word_count"].alias("words"),
        x["min_sentence_length"].alias("shortest"),
        x["max_sentence_length"].alias("longest"),
        x["staccato_run"].alias("staccato_run"),
    )


@query()
def readability_flags(spark, sf):
    """How often each readability flag is raised (numbers in it left out)."""
    rows = readability.measure(documents(spark, sf, "doc_id", "text")).select(F.explode_outer("readability.flags").alias("flag")).where("flag is not null")
    return rows.groupBy(F.regexp_replace("flag", r"[\d.]+", "#").alias("flag")).agg(F.count("*").alias("n"))


@query(
    f"""
    WITH d AS (SELECT doc_id, {sql.found("lower(text)", "[a-z']+")} AS t FROM documents)
    SELECT doc_id, len(t)::INT AS tokens,
      round(CASE WHEN len(t) = 0 THEN 1.0 ELSE len(list_filter(t, lambda w: list_contains({sql.listed(text.ENGLISH_FUNCTION_WORDS)}, w))) / len(t) END, 6) AS share,
      (len(t) < 15 OR len(list_filter(t, lambda w: list_contains({sql.listed(text.ENGLISH_FUNCTION_WORDS)}, w))) / len(t) >= 0.10) AS english
    FROM d
    """
)
def english_gate(spark, sf):
    """Share of English function words, and the gate."""
    rows = documents(spark, sf, "doc_id", "text").select("doc_id", text.english_tokens(F.col("text")).alias("t"))
    return rows.select("doc_id", F.size("t").alias("tokens"), F.round(text.english_share(F.col("t")), 6).alias("share"), text.is_english(F.col("t")).alias("english"))


@query(
    f"""
    WITH d AS (SELECT doc_id, {sql.content(sql.readability_words('text'), text.READABILITY_STOPWORDS, 2)} AS w FROM documents),
    x AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS pos FROM d),
    c AS (SELECT doc_id, word, count(*) AS n, min(pos) AS first FROM x GROUP BY ALL),
    r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, first) AS rank,
      sum(CASE WHEN n >= 3 THEN n ELSE 0 END) OVER (PARTITION BY doc_id) / sum(n) OVER (PARTITION BY doc_id) * 100 AS score FROM c)
    SELECT doc_id, rank::INT AS rank, word, n, round(score, 3) AS repetition_score FROM r WHERE rank <= 10
    """
)
def word_repetition_top10(spark, sf):
    """The ten most frequent content words of each document, with its repetition score."""
    return readability.repetition(documents(spark, sf, "doc_id", "text"), 10)


@query(
    f"""
    WITH d AS (SELECT doc_id, list_transform({sql.sentences('text')}, lambda s: len({sql.readability_words('s')})) AS l FROM documents),
    x AS (SELECT doc_id, unnest(l) AS n, generate_subscripts(l, 1) AS pos FROM d),
    y AS (SELECT *, CASE WHEN abs(n - lag(n) OVER (PARTITION BY doc_id ORDER BY pos)) <= 3 THEN 1 ELSE 0 END AS near FROM x),
    z AS (SELECT *, sum(1 - near) OVER (PARTITION BY doc_id ORDER BY pos) AS island FROM y),
    i AS (SELECT doc_id, island, sum(near) AS run, count(*) AS sentences FROM z GROUP BY ALL)
    SELECT doc_id, max(run)::BIGINT AS similar_run, sum(sentences)::BIGINT AS sentences FROM i GROUP BY doc_id
    """
)
def sentence_run_lengths(spark, sf):
    """Longest run of neighbouring sentences of similar length."""
    return readability.sentence_runs(documents(spark, sf, "doc_id", "text"))


_PROSE = f"SELECT doc_id, text, {sql.line_paragraphs('text', True)} AS p FROM (SELECT doc_id, text FROM documents)"
_SEEDED = f"SELECT doc_id, text, {sql.line_paragraphs('text', True)} AS p FROM ({seeded_sql('doc_id')})"


def _lines(spark, sf, with_carriers=False):
    docs = documents(spark, sf, "doc_id", "text")
    return structure.prepared(seeded(docs) if with_carriers else docs, separator=NEWLINE)


@query(
    f"""
    WITH d AS ({_PROSE}), s AS (SELECT doc_id, {sql.sentences("array_to_string(p, chr(10) || chr(10))")} AS s FROM d),
    n AS (SELECT doc_id, list_transform(s, lambda x: len({sql.prose_words('x')})) AS l FROM s),
    m AS (SELECT doc_id, l, list_avg(l) AS m FROM n)
    SELECT doc_id, len(l)::INT AS sentences, round(coalesce(CASE WHEN m <> 0 THEN sqrt(list_sum(list_transform(l, lambda x: (x - m) * (x - m))) / len(l)) / m END, 0.0), 3) AS burstiness,
      round(coalesce(m, 0.0), 1) AS mean_len FROM m
    """
)
def sentence_burstiness(spark, sf):
    """Variation and mean of sentence lengths of the prose view."""
    n = F.col("_n")
    return _lines(spark, sf).select("doc_id", F.size("_s").alias("sentences"), F.round(numbers.variation(n), 3).alias("burstiness"), F.coalesce(F.round(numbers.mean(n), 1), F.lit(0.0)).alias("mean_len"))


@query(
    f"""
    WITH d AS ({_PROSE}), s AS (SELECT doc_id, {sql.sentences("array_to_string(p, chr(10) || chr(10))")} AS s FROM d),
    o AS (SELECT doc_id, len(s) AS ns, list_filter(list_transform(s, lambda x: {sql.prose_words('x')}[1]), lambda w: w IS NOT NULL AND NOT list_contains({sql.listed(structure.ENUMERATION)}, w)) AS o FROM s),
    x AS (SELECT doc_id, unnest(o) AS w, generate_subscripts(o, 1) AS pos FROM o WHERE ns >= 5),
    y AS (SELECT *, pos - row_number() OVER (PARTITION BY doc_id, w ORDER BY pos) AS island FROM x),
    r AS (SELECT doc_id, max(n) AS run FROM (SELECT doc_id, w, island, count(*) AS n FROM y GROUP BY ALL) GROUP BY doc_id),
    c AS (SELECT doc_id, count(*) AS kinds, sum(n) AS n, max(n) AS top FROM (SELECT doc_id, w, count(*) AS n FROM x GROUP BY ALL) GROUP BY doc_id)
    SELECT o.doc_id, coalesce(round(kinds / n, 3), 0.0) AS unique_ratio, coalesce(round(top / n, 3), 0.0) AS top_share, coalesce(run, 0)::INT AS longest_run
    FROM o LEFT JOIN c USING (doc_id) LEFT JOIN r USING (doc_id)
    """
)
def opener_stats(spark, sf):
    """Sentence openers: distinct share, mode share, longest run."""
    m = structure.metrics()
    return _lines(spark, sf).select("doc_id", m["opener_unique_ratio"].alias("unique_ratio"), m["top_opener_share"].alias("top_share"), m["max_consecutive_opener"].alias("longest_run"))


def _hits(pattern: str, case: bool = False) -> str:
    return f"len(list_filter(p, lambda x: regexp_matches(x, {sql.quoted(pattern)})))"


@query(
    f"""
    WITH d AS ({_SEEDED}), w AS (SELECT *, array_to_string(p, chr(10) || chr(10)) AS prose FROM d),
    n AS (SELECT *, len({sql.prose_words('prose')}) AS n FROM w)
    SELECT doc_id,
      CASE WHEN len(p) > 0 THEN round(len(list_filter(p, lambda x: len({sql.sentences('x')}) = 1 AND len({sql.prose_words('x')}) < 12)) / len(p), 3) ELSE 0.0 END AS one_line_share,
      {_hits(structure.CONNECTIVE_OPENER)}::INT AS connective_openers,
      {_hits(structure.EVERY_OPENER)}::INT AS every_openers,
      CASE WHEN n > 0 THEN round({sql.count_of('prose', structure.SIGNPOST)} / n * 100, 3) ELSE 0.0 END AS signposts,
      CASE WHEN n > 0 THEN round({sql.count_of('prose', structure.TRIAD)} / n * 1000, 3) ELSE 0.0 END AS triads,
      CASE WHEN n > 0 THEN round((length(text) - length(replace(text, '—', ''))) / n * 1000, 3) ELSE 0.0 END AS em_dashes,
      {sql.count_of('text', structure.BOLD_LABEL)}::INT AS bold_labels
    FROM n
    """
)
def paragraph_metrics(spark, sf):
    """One-line paragraphs, stock openers, signposts, triads, dashes, bold labels."""
    m = structure.metrics()
    return _lines(spark, sf, True).select(
        "doc_id",
        m["one_line_staccato_share"].alias("one_line_share"),
        m["connective_paragraph_openers"].alias("connective_openers"),
        m["every_template_openers"].alias("every_openers"),
        m["signpost_density"].alias("signposts"),
        m["triad_density"].alias("triads"),
        m["em_dash_per_1k"].alias("em_dashes"),
        m["bold_colon_listicle_count"].alias("bold_labels"),
    )


_ENDS = f"SELECT doc_id, p, {sql.structure_content('p[1]')} AS f, {sql.structure_content('p[len(p)]')} AS l FROM d"


@query(
    f"""
    WITH d AS ({_SEEDED}), e AS ({_ENDS}), b AS (SELECT doc_id, p, {sql.bigrams('f')} AS f, {sql.bigrams('l')} AS l FROM e),
    s AS (SELECT doc_id, p, len(list_intersect(f, l)) AS shared, len(list_distinct(list_concat(f, l))) AS either FROM b)
    SELECT doc_id, CASE WHEN len(p) >= 2 AND either > 0 THEN round(shared / either, 3) ELSE 0.0 END AS sandwich,
      coalesce(len(p) >= 3 AND (regexp_matches(p[len(p)], {sql.quoted(structure.CODA)}) OR shared >= 2), false) AS coda FROM s
    """
)
def summary_sandwich(spark, sf):
    """Overlap of first and last paragraph, and the stock coda."""
    m = structure.metrics()
    return _lines(spark, sf, True).select("doc_id", m["summary_sandwich"].alias("sandwich"), m["conclusion_coda"].alias("coda"))


@query()
def structure_scan(spark, sf):
    """Flags of the structure scanner over all documents: how many, by metric, and how many texts it declines."""
    rows = structure.scan(seeded(documents(spark, sf, "doc_id", "text")), separator=NEWLINE)
    names = F.concat(F.col("structure")["flags"]["metric"], F.when(F.col("declined"), F.array(F.lit("declined"))).otherwise(F.array().cast("array<string>")))
    # outer: else the optimizer puts a filter on the whole scan in front, and runs it again
    return rows.select(F.explode_outer(names).alias("metric")).where("metric is not null").groupBy("metric").agg(F.count("*").alias("n"))


def _role(p: str) -> str:
    whens = " ".join(f"WHEN regexp_matches({p}, {sql.quoted(silhouette.cue(n))}) THEN '{n}'" for n in silhouette.CUES)
    return f"CASE {whens} ELSE 'topic' END"


_SIL = f"""
    WITH d AS (SELECT doc_id, {sql.line_paragraphs('text')} AS p FROM ({seeded_sql('doc_id')})),
    c AS (SELECT doc_id, p, len(p) AS n, list_transform(p, lambda x: {sql.silhouette_content('x')}) AS c, list_transform(p, lambda x: {_role('x')}) AS r FROM d),
    t AS (SELECT *, greatest(1, n // 3) AS k FROM c),
    v AS (SELECT *, list_distinct(flatten(c[1:k])) AS early, list_distinct(flatten(c[n - k + 1:n])) AS late, list_distinct(flatten(c[k + 1:n - k])) AS mid,
      list_filter(c[2:n - 1], lambda x: len(x) > 0) AS body FROM t),
    e AS (SELECT doc_id, -sum(q * log2(q)) AS e FROM (SELECT doc_id, count(*) / any_value(n) AS q FROM (SELECT doc_id, n, unnest(r) AS r FROM v) GROUP BY doc_id, r) GROUP BY doc_id),
    m AS (SELECT doc_id, n,
      CASE WHEN n = 0 THEN 0.0 ELSE round(len(list_filter(p[CASE WHEN n > 1 THEN 2 ELSE 1 END:n], lambda x: regexp_matches(x, {sql.quoted(silhouette.ANY_CUE)}))) / greatest(n - 1, 1), 3) END AS scaffold,
      CASE WHEN n >= 3 THEN round(e, 3) END AS entropy,
      CASE WHEN n >= 4 THEN CASE WHEN len(c[1]) > 0 AND len(body) > 0 THEN round(len(list_filter(body, lambda x: list_contains(c[1], x[1]))) / len(body), 3) ELSE 0.0 END END AS preview,
      CASE WHEN n >= 5 THEN round(len(list_filter(list_intersect(early, late), lambda x: NOT list_contains(mid, x))) / n, 3) END AS callback
      FROM v LEFT JOIN e USING (doc_id))
"""


def _silhouettes(spark, sf):
    return silhouette.scan(seeded(documents(spark, sf, "doc_id", "text")), separator=NEWLINE)


@query(_SIL + "SELECT doc_id, CASE WHEN n >= 3 THEN scaffold END AS scaffold, CASE WHEN n >= 3 THEN entropy + 0.0 END AS entropy, preview, callback FROM m")
def silhouette_metrics(spark, sf):
    """The discourse metrics; null under their least number of paragraphs."""
    x = F.col("silhouette")["metrics"]
    return _silhouettes(spark, sf).select("doc_id", x["scaffold_opener_share"].alias("scaffold"), x["role_entropy_bits"].alias("entropy"), x["preview_fulfillment"].alias("preview"), x["callback_content"].alias("callback"))


def _part(m: str, name: str) -> str:
    median, iqr, fence, weight = silhouette.REFERENCE[name]
    return f"coalesce(round(greatest(0.0, ({m} - {median}) / {max(iqr, fence)}) * {weight}, 3), 0.0)"


@query(
    _SIL
    + f""", y AS (SELECT doc_id, n, scaffold, round({_part('scaffold', 'scaffold_opener_share')} + {_part('entropy', 'role_entropy_bits')} + {_part('preview', 'preview_fulfillment')} + {_part('callback', 'callback_content')}, 3) AS penalty FROM m)
    SELECT doc_id, CASE WHEN n >= 3 THEN penalty END AS penalty, coalesce(n >= 3 AND penalty >= 1.0, false) AS flagged FROM y
    """
)
def silhouette_penalty(spark, sf):
    """Composite penalty and the document flag."""
    x = F.col("silhouette")["penalty"]
    return _silhouettes(spark, sf).select("doc_id", x.alias("penalty"), F.coalesce(x >= silhouette.PENALTY, F.lit(False)).alias("flagged"))


def _fit(m: str, name: str) -> str:
    q = f"quantile_cont({m}, [0.25, 0.5, 0.75])"
    _, _, fence, weight = silhouette.REFERENCE[name]
    return f"SELECT '{name}' AS metric, round({q}[2], 6) AS median, round(greatest({q}[3] - {q}[1], 0.05), 6) AS iqr, {fence}::DOUBLE AS fence, {weight}::DOUBLE AS weight, count({m}) AS n FROM m WHERE n >= 3"


@query(_SIL + " UNION ALL ".join(_fit(m, n) for m, n in (("scaffold", "scaffold_opener_share"), ("entropy", "role_entropy_bits"), ("preview", "preview_fulfillment"), ("callback", "callback_content"))))
def reference_fit(spark, sf):
    """Reference distribution fitted on all documents (heading metric left out, as there are no headings)."""
    fitted = silhouette.fit_reference(seeded(documents(spark, sf, "doc_id", "text")), separator=NEWLINE)
    return fitted.where("metric <> 'heading_preview'")
