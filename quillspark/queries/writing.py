"""Harvest, near-duplicates, coverage, preferences, suggestions."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillspark.functions import text
from quillspark.operators import detect, facts, harvest, prefs, suggest
from quillspark.plans import rules
from quillspark.queries import sql
from quillspark.queries.base import documents, query, seeded, seeded_sql, table
from quillspark.sources import corpus, transcripts

# --- transcripts ----------------------------------------------------------------------------------------------------


def _transcripts(spark, sf):
    """Conversations as transcript lines: a file per conversation; every seventh is an envelope file, every eleventh has a broken line."""
    c = table(spark, sf, "conversations")
    envelope = F.col("conv_id") % 7 == 0
    tagged = F.to_json(F.struct(F.col("role").alias("type"), F.struct("role", F.col("text").alias("content")).alias("message"), F.lit("2024-03-01T10:00:00Z").alias("timestamp")))
    kind = F.when(F.col("role") == "user", "user_message").when(F.col("role") == "assistant", "agent_message").otherwise("token_count")
    wrapped = F.to_json(F.struct(F.lit("event_msg").alias("type"), F.lit("2024-03-01T10:00:00Z").alias("timestamp"), F.struct(kind.alias("type"), F.col("text").alias("message")).alias("payload")))
    line = F.when((F.col("conv_id") % 11 == 0) & (F.col("turn") == 0), F.lit("{broken")).when(envelope, wrapped).otherwise(tagged)
    return c.select(F.format_string("c%d.jsonl", "conv_id").alias("path"), (F.col("turn") + 1).cast("int").alias("line"), line.alias("value"))


_CONV = """
    c AS (SELECT 'c' || conv_id || '.jsonl' AS path, (turn + 1)::INT AS line, role, text, conv_id % 7 = 0 AS envelope FROM conversations),
    bad AS (SELECT DISTINCT 'c' || conv_id || '.jsonl' AS path FROM conversations WHERE conv_id % 11 = 0 AND turn = 0),
    known AS (SELECT path FROM c GROUP BY path HAVING max(CASE WHEN envelope OR role IN ('user', 'assistant') THEN 1 ELSE 0 END) = 1),
    good AS (SELECT * FROM c WHERE path NOT IN (SELECT path FROM bad) AND path IN (SELECT path FROM known))
"""


@query(f"WITH {_CONV} SELECT path, line, CASE WHEN envelope THEN 'envelope' ELSE 'role-tagged' END AS adapter, text FROM good WHERE role = 'user' AND text IS NOT NULL")
def transcript_candidates(spark, sf):
    """Users' messages of both transcript formats."""
    kept, _, _ = transcripts.read(_transcripts(spark, sf))
    return kept.select("source.path", "source.line", "source.adapter", "text")


@query(f"WITH {_CONV} SELECT 'authorship' AS drop_reason, count(*) AS n FROM good WHERE role = 'assistant' HAVING count(*) > 0")
def transcript_drops(spark, sf):
    """Messages dropped for their author."""
    return transcripts.read(_transcripts(spark, sf))[1]


@query(f"WITH {_CONV} SELECT path, 'invalid JSON; skipping file' AS warning FROM bad UNION ALL SELECT DISTINCT path, 'unknown jsonl schema; skipped' FROM c WHERE path NOT IN (SELECT path FROM bad) AND path NOT IN (SELECT path FROM known)")
def transcript_warnings(spark, sf):
    """Files skipped whole."""
    return transcripts.read(_transcripts(spark, sf))[2]


# --- waterfall ------------------------------------------------------------------------------------------------------


def _raw(spark, sf):
    """Conversation turns and documents as candidates; some carry a command, a quote or fillers."""
    c = table(spark, sf, "conversations").where("role = 'user'")
    lead = F.when(F.col("conv_id") % 5 == 0, F.lit("Assistant: ")).when(F.col("conv_id") % 5 == 1, F.lit("run the tests with --fast and ")).when(F.col("conv_id") % 5 == 2, F.lit("um, uh, um, uh, so. ")).otherwise(F.lit(""))
    turns = c.select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.concat(lead, F.col("text")).alias("text"), F.when(F.col("conv_id") % 3 == 0, "2020-01-05T00:00:00Z").otherwise("2024-03-01T00:00:00+02:00").alias("date"))
    docs = documents(spark, sf, "doc_id", "text").select((-1 - F.col("doc_id")).alias("id"), "text", F.lit(None).cast("string").alias("date"))
    return turns.unionByName(docs)


_RAW = r"""
    raw AS (SELECT conv_id * 1000 + turn AS id, CASE conv_id % 5 WHEN 0 THEN 'Assistant: ' WHEN 1 THEN 'run the tests with --fast and ' WHEN 2 THEN 'um, uh, um, uh, so. ' ELSE '' END || text AS text, conv_id % 3 = 0 AS old FROM conversations WHERE role = 'user'
      UNION ALL SELECT -1 - doc_id, text, false FROM documents),
    cl AS (SELECT id, old, regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '(?i)<(?:system-reminder|[^>\s]+)[^>]*>[\s\S]*?</(?:system-reminder|[^>\s]+)>', ' ', 'g'), '(?m)^[ \t]*>.*$', '', 'g'), '\s+', ' ', 'g'), '^\s+|\s+$', '', 'g') AS t FROM raw),
    w AS (SELECT *, len(regexp_extract_all(t, '[A-Za-z0-9]+(?:[-''][A-Za-z0-9]+)?')) AS n, len(regexp_extract_all(t, '[.!?](?:\s|$)')) AS s, len(regexp_extract_all(t, '(?i)\b(?:um|uh)\b,?')) AS f FROM cl)
"""
_REASON = rf"""CASE WHEN old THEN 'since' WHEN regexp_matches(t, '(?i)^\s*(?:>|you said:|assistant:|claude said:)') OR regexp_matches(lower(t), '^(?:you wrote:|your answer:|your response:)') THEN 'quoted-assistant'
    WHEN regexp_matches(t, {sql.quoted(harvest.COMMAND)}) OR (n <= 8 AND regexp_matches(t, {sql.quoted(harvest.PATH_OR_FLAG)})) THEN 'command-likeness' WHEN n < 40 THEN 'length' WHEN s < 2 THEN 'fragment-share' END"""


@query(f"WITH {_RAW} SELECT id, n::INT AS words, (f >= 2 AND f / greatest(n, 1) > 0.035) AS dictated, {_REASON} AS drop_reason FROM w")
def harvest_waterfall(spark, sf):
    """First reason to drop each candidate, words, dictation."""
    rows = harvest.waterfall(_raw(spark, sf), 40, "2023-01-01", date=F.col("date"))
    return rows.select("id", "words", "dictated", "drop_reason")


@query(f"WITH {_RAW}, r AS (SELECT {_REASON} AS drop_reason FROM w) SELECT drop_reason, count(*) AS n FROM r WHERE drop_reason IS NOT NULL GROUP BY ALL")
def drop_stats(spark, sf):
    """Dropped candidates by reason."""
    return corpus.drop_stats(harvest.waterfall(_raw(spark, sf), 40, "2023-01-01", date=F.col("date")))


@query()
def near_duplicates(spark, sf):
    """Links between different texts over 0.6, and each copy's link to the first of its class."""
    e = harvest.duplicate_edges(documents(spark, sf, "doc_id", "text"))
    return e.select("a", "b", "shared", F.round("overlap", 6).alias("overlap"))


@query()
def greedy_kept(spark, sf):
    """Which documents a greedy pass over ids keeps."""
    docs = documents(spark, sf, "doc_id", "text")
    return harvest.resolve_greedy(docs.select(F.col("doc_id").alias("id")), harvest.duplicate_edges(docs))


@query()
def suspect_texts(spark, sf):
    """Contamination tripwire over all documents."""
    return harvest.tripwire(documents(spark, sf, "doc_id", "text")).select("doc_id", "suspect_ai")


# --- coverage -------------------------------------------------------------------------------------------------------


def _candidates(spark, sf):
    docs = seeded(documents(spark, sf, "doc_id", "text"))
    w = F.size(text.harvest_words(F.col("text")))
    rows = docs.withColumn("cells", harvest.cells(F.col("text"))).withColumn("words", w).withColumn("suspect_ai", F.col("doc_id") % 9 == 0).withColumn("dictated", F.col("doc_id") % 13 == 0)
    return rows.withColumn("quality", harvest.quality(F.col("words"), F.col("cells"), F.col("suspect_ai"), F.col("dictated"))).withColumn("index", F.col("doc_id"))


def _cells_sql() -> str:
    return "list_filter([" + ", ".join(f"CASE WHEN regexp_matches(regexp_replace(lower(text), '[^\\x00-\\x7F]', 'x', 'g'), {sql.quoted(p)}) THEN '{n}' END" for n, p in harvest.CELLS.items()) + "], lambda c: c IS NOT NULL)"


_CAND = f"""
    c AS (SELECT doc_id, {_cells_sql()} AS cells, len({sql.found('text', text.PROSE_WORD)}) AS words FROM ({seeded_sql('doc_id')})),
    q AS (SELECT *, greatest(1, least(5, 3 + CASE WHEN words BETWEEN 40 AND 220 THEN 1 ELSE 0 END + CASE WHEN len(cells) > 0 THEN 1 ELSE 0 END - CASE WHEN doc_id % 9 = 0 THEN 2 ELSE 0 END - CASE WHEN doc_id % 13 = 0 THEN 1 ELSE 0 END))::INT AS quality FROM c),
    x AS (SELECT doc_id, unnest(cells) AS cell FROM q), f AS (SELECT cell, min(doc_id) AS doc_id FROM x GROUP BY cell)
"""


@query(f"WITH {_CAND} SELECT n.cell, coalesce(count(x.cell), 0) AS n FROM (SELECT unnest({sql.listed(harvest.CELLS)}) AS cell) n LEFT JOIN x USING (cell) GROUP BY n.cell")
def coverage_matrix(spark, sf):
    """Candidates by coverage cell."""
    return harvest.coverage(_candidates(spark, sf))


@query(f"WITH {_CAND} SELECT doc_id, quality, array_to_string(cells, ',') AS cells, doc_id IN (SELECT doc_id FROM f) AS fills_empty FROM q")
def coverage_ranking(spark, sf):
    """Cells, quality and whether a candidate is the first in a cell."""
    return harvest.fills_empty(_candidates(spark, sf)).select("doc_id", "quality", F.array_join("cells", ",").alias("cells"), "fills_empty")


@query()
def task_chunks(spark, sf):
    """Candidates in chunks of ten, in order of id."""
    docs = documents(spark, sf, "doc_id", "text", "source")
    return corpus.task_chunks(docs, ["doc_id"]).select("chunk", F.length("payload").alias("length"))


# --- preferences ----------------------------------------------------------------------------------------------------

_DIM = sql.listed(prefs.DIMENSIONS)
_PREF = f"""
    p AS (SELECT CASE WHEN event_id % 10 = 0 THEN NULL ELSE 'p' || (user_id % 97) || '-' || (event_id % 50) END AS pair_id, {_DIM}[event_id % 5 + 1] AS dimension,
      CASE WHEN value > 100 THEN 'neither' WHEN event_id % 3 = 0 THEN 'b' ELSE 'a' END AS choice, strftime(ts, '%Y-%m-%dT%H:%M') AS ts, event_id AS "at",
      CASE WHEN event_id % 4 = 0 THEN 'contracted' END AS a_label FROM events),
    l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY pair_id ORDER BY ts DESC, "at" DESC) AS r FROM p WHERE pair_id IS NOT NULL) WHERE r = 1
      UNION ALL SELECT *, 1 FROM p WHERE pair_id IS NULL),
    v AS (SELECT dimension, CASE choice WHEN 'a' THEN coalesce(a_label, 'a') WHEN 'b' THEN 'b' END AS label, count(*) AS c, count(*) FILTER (choice = 'neither') AS neither FROM l GROUP BY ALL),
    t AS (SELECT dimension, sum(c)::BIGINT AS n, sum(neither)::BIGINT AS neither, coalesce(sum(c) FILTER (label IS NOT NULL), 0) AS decisive, max(c) FILTER (label IS NOT NULL) AS best, max(label) FILTER (label IS NOT NULL AND c = (SELECT max(c) FROM v u WHERE u.dimension = v.dimension AND u.label IS NOT NULL)) AS top,
      count(*) FILTER (label IS NOT NULL AND c = (SELECT max(c) FROM v u WHERE u.dimension = v.dimension AND u.label IS NOT NULL)) AS ties FROM v GROUP BY dimension),
    d AS (SELECT x.dimension, x.place, coalesce(n, 0) AS n, coalesce(neither, 0) AS neither, CASE WHEN coalesce(n, 0) < 5 OR coalesce(decisive, 0) = 0 THEN 'insufficient' WHEN ties > 1 THEN 'tied' ELSE 'confident' END AS status, top, best, decisive
      FROM (SELECT unnest({_DIM}) AS dimension, unnest(range(0, 5))::INT AS place) x LEFT JOIN t USING (dimension)),
    s AS (SELECT dimension, place, n, neither, status, CASE WHEN status = 'confident' THEN top END AS preferred,
      CASE WHEN status = 'confident' THEN round(greatest(0.0, (best / decisive + 3.8416 / (2 * decisive) - 1.96 * sqrt((best / decisive * (1 - best / decisive) + 3.8416 / (4 * decisive)) / decisive)) / (1 + 3.8416 / decisive)), 3) ELSE 0.0 END AS confidence FROM d)
"""


def _preferences(spark, sf):
    """Events as rounds of the game."""
    e = table(spark, sf, "events")
    pair = F.when(F.col("event_id") % 10 != 0, F.concat(F.lit("p"), F.col("user_id") % 97, F.lit("-"), F.col("event_id") % 50))
    return e.select(
        pair.alias("pair_id"),
        F.element_at(text.words_in(prefs.DIMENSIONS), (F.col("event_id") % 5 + 1).cast("int")).alias("dimension"),
        F.when(F.col("value") > 100, "neither").when(F.col("event_id") % 3 == 0, "b").otherwise("a").alias("choice"),
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm").alias("ts"),
        F.col("event_id").alias("at"),
        F.when(F.col("event_id") % 4 == 0, "contracted").alias("a_label"),
        F.lit(None).cast("string").alias("b_label"),
    )


@query(f'WITH {_PREF} SELECT pair_id, dimension, choice, ts, "at" FROM l')
def latest_preference(spark, sf):
    """Last choice of each pair; rows without a pair all stay."""
    return prefs.latest(_preferences(spark, sf)).select("pair_id", "dimension", "choice", "ts", "at")


@query(f"WITH {_PREF} SELECT * FROM s")
def wilson_bounds(spark, sf):
    """Tally, status, preferred label and confidence of each dimension."""
    return prefs.dimensions(prefs.latest(_preferences(spark, sf)))


@query(f"WITH {_PREF} SELECT dimension AS next_dimension, 'fewest_observations' AS reason, n, confidence FROM s ORDER BY n, confidence, place LIMIT 1")
def next_dimension(spark, sf):
    """The dimension to ask about next."""
    return prefs.next_dimension(prefs.dimensions(prefs.latest(_preferences(spark, sf))))


@query()
def preference_conflicts(spark, sf):
    """Confident preferences against rates measured over all documents."""
    measured = prefs.style_rates(documents(spark, sf).withColumn("all", F.lit(1)), "all").select("key", "value")
    return prefs.conflicts(prefs.dimensions(prefs.latest(_preferences(spark, sf))), measured)


@query(
    r"""
    WITH d AS (SELECT doc_id, text || ' The plan, untested and rushed, still shipped.' AS t FROM documents)
    SELECT doc_id, CASE WHEN regexp_matches(t, '\s—\s(.+?)\s—\s') THEN CASE WHEN NOT contains(regexp_replace(t, '\s—\s(.+?)\s—\s', ', \1, ', 'g'), '—') THEN md5(regexp_replace(t, '\s—\s(.+?)\s—\s', ', \1, ', 'g')) END
      WHEN NOT contains(t, '—') AND regexp_matches(t, ',\s+(.+?),\s+') THEN md5(regexp_replace(t, ',\s+(.+?),\s+', ' — \1 — ', 'g')) END AS dashed FROM d
    """
)
def em_dash_pairs(spark, sf):
    """Paired dashes and commas exchanged, as a digest."""
    d = documents(spark, sf, "doc_id", "text").withColumn("text", F.concat("text", F.lit(" The plan, untested and rushed, still shipped.")))
    return d.select("doc_id", F.md5(prefs.em_dash_native(F.col("text")).cast("binary")).alias("dashed"))


@query()
def calibration_pairs(spark, sf):
    """How many documents each dimension can be expressed in, by pole."""
    docs = seeded(documents(spark, sf, "doc_id", "text"))
    out = None
    for d in prefs.DIMENSIONS:
        rows = prefs.transformed(docs, d, into="t").groupBy(F.lit(d).alias("dimension"), F.col("t")["pole"].alias("pole")).agg(F.count("*").alias("n"))
        out = rows if out is None else out.unionByName(rows)
    return out


# --- suggestions ----------------------------------------------------------------------------------------------------


def _span_rows(spark, sf):
    """Spans over words: every fourth letter count, with varying ends."""
    w = documents(spark, sf, "doc_id", "text").select("doc_id", F.posexplode(text.prose_words(F.col("text"))).alias("i", "w"))
    return w.select("doc_id", (F.col("i") * 3).alias("start"), (F.col("i") * 3 + F.length("w") % 6).cast("int").alias("end")).where(F.length("w") > 3)


_SPANS = f"""
    w AS (SELECT doc_id, {sql.prose_words('text')} AS t FROM documents), x AS (SELECT doc_id, unnest(t) AS w, generate_subscripts(t, 1) - 1 AS i FROM w),
    s AS (SELECT doc_id, (i * 3)::INT AS start, (i * 3 + length(w) % 6)::INT AS "end" FROM x WHERE length(w) > 3)
"""


@query(f'WITH {_SPANS}, o AS (SELECT *, lag("end") OVER (PARTITION BY doc_id ORDER BY start, "end") AS previous_end FROM s) SELECT doc_id, start, "end", previous_end FROM o WHERE start < previous_end')
def suggestion_overlap(spark, sf):
    """Neighbouring spans that overlap."""
    return suggest.overlaps(_span_rows(spark, sf))


@query()
def suggestions(spark, sf):
    """Thinned suggestions of every document, by category and severity."""
    rows = suggest.suggest(seeded(documents(spark, sf, "doc_id", "text"))).select(F.explode_outer("suggestions").alias("s")).where("s is not null")
    return rows.groupBy(F.col("s")["category"].alias("category"), F.col("s")["severity"].alias("severity")).agg(F.count("*").alias("n"))


@query(f'WITH {_SPANS}, r AS (SELECT doc_id, start, "end", start % 2 = 0 AS hit FROM s), k AS (SELECT doc_id, start FROM r WHERE hit GROUP BY ALL) SELECT doc_id, count(*) AS merged FROM r WHERE hit GROUP BY doc_id')
def merged_replacements(spark, sf):
    """Replacements joined to the spans they name (every even start)."""
    s = _span_rows(spark, sf)
    merged, _ = suggest.merge(s.withColumn("span_text", F.lit("x")), s.where("start % 2 = 0").withColumn("replacement", F.lit("y")))
    return merged.where("suggested_replacement is not null").groupBy("doc_id").agg(F.count("*").alias("merged"))


@query(
    f"""
    WITH d AS (SELECT doc_id, text AS t, {sql.found('text', '[A-Za-z]+')} AS w FROM documents)
    SELECT doc_id, 0 AS start, length(w[1])::INT AS "end", 'shares leading or trailing words with the span' AS failure FROM d WHERE len(w) > 0 AND t LIKE w[1] || '%' AND doc_id % 2 = 0
    """
)
def suggestion_minimality(spark, sf):
    """Replacements of each document's first word that aren't minimal: every second one repeats the word."""
    d = documents(spark, sf, "doc_id", "text").withColumn("w", F.regexp_extract("text", "^[A-Za-z]+", 0)).where("w <> ''")
    new = F.when(F.col("doc_id") % 2 == 0, F.concat("w", F.lit(" again"))).otherwise(F.lit("zzz"))
    rows = d.select("doc_id", "text", F.lit(0).alias("start"), F.length("w").alias("end"), F.col("w").alias("span_text"), new.alias("suggested_replacement"))
    return suggest.minimality(rows)


@query()
def accept_all(spark, sf):
    """Documents with all literal findings of one category replaced: clean and preserved?"""
    wanted = [r for r in rules.catalog() if r.kind == "phrase" and r.category == "filler"]
    docs = seeded(documents(spark, sf, "doc_id", "text"))
    edits = F.transform(detect.spans(F.col("text"), wanted), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.lit("to").alias("replacement")))
    rows = suggest.accept_all(docs.withColumn("edits", edits), rules=wanted)
    return rows.groupBy("clean", "preserved").agg(F.count("*").alias("n"))


@query("SELECT doc_id, md5(replace(replace(text, 'the', '[A]'), 'and', '[B]')) AS redacted, (length(text) - length(replace(text, 'ing', ''))) > 0 AS valid FROM documents")
def redaction(spark, sf):
    """Secrets replaced in order; the tell must occur as often as before."""
    from quillspark.operators import catalogs

    d = documents(spark, sf, "doc_id", "text").withColumn("tell", F.lit("ing"))
    d = d.withColumn("terms", F.array(*[F.struct(F.lit(a).alias("secret"), F.lit(b).alias("placeholder")) for a, b in (("the", "[A]"), ("and", "[B]"))]))
    return catalogs.redact(d).select("doc_id", F.md5(F.col("redacted").cast("binary")).alias("redacted"), "valid")


@query("SELECT source, doc_id, n_chars FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS r FROM documents) WHERE r = 1")
def longest_of_source(spark, sf):
    """Last row of each key by an order."""
    return corpus.latest(documents(spark, sf, "source", "doc_id", "n_chars"), "source", [F.desc("n_chars"), F.asc("doc_id")]).select("source", "doc_id", "n_chars")


@query("SELECT doc_id, sha256(text) AS sha256, len(regexp_extract_all(text, '[A-Za-z0-9'']+'))::INT AS words FROM documents")
def provenance(spark, sf):
    """Digest and word count of every document."""
    return documents(spark, sf, "doc_id", "text").select("doc_id", F.sha2("text", 256).alias("sha256"), text.card_word_count(F.col("text")).alias("words"))


@query()
def standalone_facts(spark, sf):
    """Facts of each document, and how many stand alone in it."""
    rows = seeded(documents(spark, sf, "doc_id", "text")).withColumn("c", facts.constraints(F.col("text")))
    return rows.select("doc_id", F.size("c").alias("facts"), F.size(F.array_distinct(F.col("c")["type"])).alias("types"))


# --- classification results, ranking, replacement grades -----------------------------------------------------------


@query(
    f"""
    WITH {_CAND}, r AS (SELECT doc_id % 300 AS key, quality AS q, doc_id AS pos FROM labels),
    last AS (SELECT key, arg_max(q, pos) AS q FROM r GROUP BY key)
    SELECT q.doc_id AS index, greatest(1, least(5, coalesce(last.q, greatest(1, least(5, 3 + CASE WHEN words BETWEEN 40 AND 220 THEN 1 ELSE 0 END - CASE WHEN q.doc_id % 9 = 0 THEN 2 ELSE 0 END - CASE WHEN q.doc_id % 13 = 0 THEN 1 ELSE 0 END)))))::INT AS quality
    FROM q LEFT JOIN last ON last.key = q.doc_id
    """
)
def merged_results(spark, sf):
    """Candidates with the last classifier row of their id; labels stand for results."""
    c = _candidates(spark, sf).select("index", F.col("doc_id").alias("id"), "words", "suspect_ai", "dictated")
    none = F.array().cast("array<string>")
    r = table(spark, sf, "labels").select((F.col("doc_id") % 300).cast("string").alias("key"), F.col("doc_id").alias("at"), none.alias("cells"), F.col("quality").cast("int").alias("quality"), F.lit("label").alias("why"))
    return harvest.merge_results(c, r).select("index", "quality")


@query("SELECT conv_id, turn, CASE WHEN conv_id % 3 = 0 THEN 1577836800.0 WHEN conv_id % 3 = 1 THEN 12.5 ELSE 0.0 END AS recency FROM conversations")
def candidate_recency(spark, sf):
    """Recency from a date, else a file time, else 0."""
    c = table(spark, sf, "conversations")
    date = F.when(F.col("conv_id") % 3 == 0, "2020-01-01T00:00:00Z").when(F.col("conv_id") % 3 == 1, "no date")
    return c.select("conv_id", "turn", harvest.recency(date, F.when(F.col("conv_id") % 3 == 1, F.lit(12.5))).alias("recency"))


@query(
    """
    WITH c AS (SELECT conv_id, turn, conv_id % 4 = 0 AS suspect_ai, (conv_id * 7 % 50)::DOUBLE AS recency FROM conversations)
    SELECT conv_id, turn FROM c ORDER BY suspect_ai, recency DESC, conv_id, turn LIMIT 200
    """
)
def ranked_candidates(spark, sf):
    """The first 200 candidates: a top-k report."""
    c = table(spark, sf, "conversations").select("conv_id", "turn", (F.col("conv_id") % 4 == 0).alias("suspect_ai"), (F.col("conv_id") * 7 % 50).cast("double").alias("recency"), F.col("conv_id").alias("path"), F.col("turn").alias("line"))
    return harvest.rank(c).select("conv_id", "turn")


@query()
def replacement_grades(spark, sf):
    """Each carrier phrase replaced in its document: grades."""
    from quillspark.operators import grading

    docs = seeded(documents(spark, sf, "doc_id", "text"))
    span = F.regexp_extract("text", "(in order to|studies show|let me be clear|it turns out)", 1)
    rows = docs.select("doc_id", F.col("text").alias("context"), span.alias("span"), F.when(F.col("doc_id") % 2 == 0, "to").otherwise("delve into a robust realm of things").alias("replacement")).where("span <> ''")
    return grading.grade_replacements(rows).groupBy("span_found", "scanners_ok", "constraints_preserved", "span_minimal", "passed").agg(F.count("*").alias("n"))


@query()
def replacements_in_context(spark, sf):
    """Replacements that aren't clean alone or where they stand."""
    docs = seeded(documents(spark, sf, "doc_id", "text"))
    rows = docs.withColumn("start", F.lit(0)).withColumn("end", F.lit(1)).withColumn("suggested_replacement", F.when(F.col("doc_id") % 2 == 0, "A robust").otherwise("A"))
    return suggest.in_context(rows).groupBy("failure").agg(F.count("*").alias("n"))


@query("SELECT doc_id, list_sort([source || '-a', lang || '-b'])[1] AS first, 2::INT AS n FROM documents WHERE source IS NOT NULL AND lang IS NOT NULL")
def parsed_findings(spark, sf):
    """Fenced replies parsed into findings."""
    from quillspark.operators import grading

    d = documents(spark, sf, "doc_id", "source", "lang").where("source is not null and lang is not null")
    raw = F.format_string('```json\n[{"span": "%s-a"}, {"span": "%s-b"}, 7]\n```', "source", "lang")
    rows = d.select("doc_id", grading.findings(raw).alias("f"))
    return rows.select("doc_id", F.array_min(F.col("f")["span"]).alias("first"), F.size("f").alias("n"))


@query()
def precheck(spark, sf):
    """Kinds of findings of both scanners, by number of documents."""
    from quillspark.operators import catalogs

    return catalogs.precheck(seeded(documents(spark, sf, "doc_id", "text"))).groupBy("source", "kind").agg(F.count("*").alias("n"))
