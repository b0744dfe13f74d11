"""Statistics, refinement replays, graders, catalog sync."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillspark.operators import catalogs, grading, loops, stats, style
from quillspark.queries import sql
from quillspark.queries.base import documents, query, table

# --- paired scores: events of a user are its pairs ------------------------------------------------------------------

_PAIRS = "p AS (SELECT event_type || '-' || (user_id % 200) AS g, (event_id % 23)::DOUBLE AS baseline, ((event_id * 7 + user_id) % 19)::DOUBLE AS treatment FROM events)"


def _pairs(spark, sf):
    e = table(spark, sf, "events")
    return e.select(F.concat("event_type", F.lit("-"), F.col("user_id") % 200).alias("g"), (F.col("event_id") % 23).cast("double").alias("baseline"), ((F.col("event_id") * 7 + F.col("user_id")) % 19).cast("double").alias("treatment"))


@query(f"WITH {_PAIRS} SELECT g, count(*) AS n, round(avg(baseline - treatment), 6) AS mean_delta FROM p GROUP BY g")
def paired_deltas(spark, sf):
    """Mean difference of each group."""
    return stats.deltas(_pairs(spark, sf), "g").groupBy("g").agg(F.count("*").alias("n"), F.round(F.avg("delta"), 6).alias("mean_delta"))


@query(
    f"""
    WITH {_PAIRS}, a AS (SELECT g, count(*) AS n, list_sort(list(round(baseline - treatment, 4))) AS x FROM p GROUP BY g HAVING count(*) BETWEEN 1 AND 12),
    s AS (SELECT g, n, x, unnest(range(0, (2 ** n)::BIGINT)) AS s FROM a),
    f AS (SELECT g, n, abs(list_sum(list_transform(x, lambda v, i: CASE WHEN (s >> (i - 1)) & 1 = 1 THEN -v ELSE v END))) >= abs(list_sum(x)) - 1e-9 AS hit FROM s)
    SELECT g, n, count(*) FILTER (hit) AS hits, count(*) FILTER (hit) / (2 ** n) AS p_value FROM f GROUP BY g, n
    """
)
def sign_flip_exact(spark, sf):
    """Exact sign-flip test of every group of up to twelve pairs."""
    d = _pairs(spark, sf).select("g", F.round(F.col("baseline") - F.col("treatment"), 4).alias("delta"))
    return stats.sign_flip_exact(d, "g", "delta")


@query()
def bca_interval(spark, sf):
    """Bootstrap interval, sign-flip test and verdict of every group."""
    return stats.analyze(_pairs(spark, sf), "g", 7)


# --- replays: a user is a run, its events are rounds ----------------------------------------------------------------


def _rounds(spark, sf):
    e = table(spark, sf, "events").where("event_type is not null")
    rank = F.row_number().over(style.Window.partitionBy("user_id").orderBy("event_id")) - 1
    return e.select(F.col("user_id").alias("run"), rank.cast("bigint").alias("iteration"), F.format_string("e%d", "event_id").alias("best"), F.round(F.col("value") / 100, 4).alias("dev"), F.round((F.col("event_id") % 17) / 10, 4).alias("a"))


_ROUNDS = "r AS (SELECT user_id AS run, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS iteration, round(value / 100, 4) AS dev, round((event_id % 17) / 10, 4) AS a FROM events)"


@query(f"WITH {_ROUNDS} SELECT run, iteration, dev, min(dev) OVER w AS best_before, coalesce(dev < min(dev) OVER w, true) AS improved FROM r WINDOW w AS (PARTITION BY run ORDER BY iteration ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)")
def running_best(spark, sf):
    """Best score before each round."""
    return loops.running_best(_rounds(spark, sf)).select("run", "iteration", "dev", "best_before", "improved")


@query(
    f"""
    WITH RECURSIVE {_ROUNDS},
    l AS (SELECT run, 0::BIGINT AS iteration, dev, a, true AS accepted, dev AS score, 0 AS div, 0 AS wait FROM r WHERE iteration = 0
      UNION ALL
      SELECT r.run, r.iteration, r.dev, r.a, r.dev <= l.score - 0.01, CASE WHEN r.dev <= l.score - 0.01 THEN r.dev ELSE l.score END,
        CASE WHEN r.a < l.a AND r.dev > l.dev THEN l.div + 1 ELSE 0 END, CASE WHEN r.dev <= l.score - 0.01 THEN 0 ELSE l.wait + 1 END
      FROM l JOIN r ON r.run = l.run AND r.iteration = l.iteration + 1 WHERE l.div < 2 AND l.wait < 2)
    SELECT run, iteration, accepted, score AS best_score, div AS divergence_run, wait AS since_accept FROM l
    """
)
def loop_replay(spark, sf):
    """Acceptance, divergence and patience of every recorded round, up to the stop."""
    return loops.replay(_rounds(spark, sf)).select("run", "iteration", "accepted", "best_score", "divergence_run", "since_accept")


@query(
    f"""
    WITH {_ROUNDS}, c AS (SELECT run, iteration AS rnd, floor(a)::INT AS left_over, dev < 1.9 AS preserved FROM r WHERE iteration < 4),
    g AS (SELECT run, rnd, CASE WHEN NOT preserved THEN 'preservation_violation' WHEN left_over = 0 THEN 'converged' END AS ended FROM c),
    f AS (SELECT run, min(rnd) FILTER (ended IS NOT NULL) AS first_end, arg_min(ended, rnd) FILTER (ended IS NOT NULL) AS ended, max(rnd) AS last_rnd FROM g GROUP BY run)
    SELECT run, coalesce(ended, 'capped') AS state, coalesce(first_end, last_rnd) + 1 AS rounds FROM f
    """
)
def climb_states(spark, sf):
    """How every climb ends within four rounds."""
    r = _rounds(spark, sf).select("run", F.col("iteration").alias("round"), F.floor("a").cast("int").alias("violation_count"), (F.col("dev") < 1.9).alias("preserved"))
    return loops.terminal_state(r)


@query(
    """
    WITH g AS (SELECT event_id, value > 5 AS length, event_id % 3 <> 0 AS preservation, event_id % 5 <> 0 AS phrases, event_id % 7 <> 0 AS structure, true AS copy FROM events),
    x AS (SELECT CASE WHEN NOT length THEN 'length' WHEN NOT preservation THEN 'preservation' WHEN NOT phrases THEN 'phrases' WHEN NOT structure THEN 'structure' WHEN NOT copy THEN 'copy' END AS reason FROM g)
    SELECT reason, count(*) AS n FROM x GROUP BY reason
    """
)
def gate_reasons(spark, sf):
    """First failing gate."""
    e = table(spark, sf, "events")
    i = F.col("event_id")
    g = e.select((F.col("value") > 5).alias("length"), (i % 3 != 0).alias("preservation"), (i % 5 != 0).alias("phrases"), (i % 7 != 0).alias("structure"), F.lit(True).alias("copy"))
    return loops.first_failing(g).groupBy("reason").agg(F.count("*").alias("n"))


_W = " ".join(f"WHEN '{f}' THEN {w}" for f, w in style.WEIGHTS.items())


@query(
    f"""
    WITH d AS (SELECT user_id AS profile, event_type AS candidate, {sql.listed(style.WEIGHTS)}[event_id % 7 + 1] AS feature, round(max(value), 4) AS distance FROM events GROUP BY ALL),
    w AS (SELECT *, distance * CASE feature {_W} END AS weighted FROM d), r AS (SELECT *, row_number() OVER (PARTITION BY profile, candidate ORDER BY weighted DESC, feature) AS rank FROM w)
    SELECT profile, candidate, feature, rank::INT AS rank FROM r WHERE rank <= 4
    """
)
def top_directives(spark, sf):
    """The four largest weighted distances of each pair."""
    f = F.element_at(F.array(*[F.lit(x) for x in style.WEIGHTS]), (F.col("event_id") % 7 + 1).cast("int"))
    d = table(spark, sf, "events").groupBy(F.col("user_id").alias("profile"), F.col("event_type").alias("candidate"), f.alias("feature")).agg(F.round(F.max("value"), 4).alias("distance"))
    return loops.directives(d).select("profile", "candidate", "feature", "rank")


# --- graders --------------------------------------------------------------------------------------------------------

_WORDS = "w AS (SELECT doc_id, source, string_split_regex(lower(text), '[^a-z]+') AS w FROM documents)"


@query(
    f"""
    WITH {_WORDS}, f AS (SELECT source AS key, doc_id AS finding, coalesce(w[3], '') AS span FROM w), m AS (SELECT source AS key, doc_id AS expected, w[2] AS alt FROM w WHERE w[2] IS NOT NULL),
    h AS (SELECT f.key, finding, expected FROM f JOIN m USING (key) WHERE span <> '' AND alt <> '' AND (contains(span, alt) OR contains(alt, span))),
    e AS (SELECT key, count(DISTINCT expected) AS n_expected FROM m GROUP BY key), k AS (SELECT key, count(DISTINCT expected) AS n_matched FROM h GROUP BY key), r AS (SELECT key, count(*) AS n_returned FROM f GROUP BY key),
    x AS (SELECT key, count(*) AS false_findings FROM f WHERE span <> '' AND NOT EXISTS (SELECT 1 FROM h WHERE h.key = f.key AND h.finding = f.finding) GROUP BY key)
    SELECT key, n_expected, coalesce(n_matched, 0) AS n_matched, coalesce(n_returned, 0) AS n_returned, coalesce(false_findings, 0) AS false_findings, round(coalesce(n_matched, 0) / n_expected, 6) AS recall
    FROM e LEFT JOIN k USING (key) LEFT JOIN r USING (key) LEFT JOIN x USING (key)
    """
)
def finding_recall(spark, sf):
    """Recall and false findings by source: third words of the documents are findings, second words expected."""
    w = documents(spark, sf, "doc_id", "source", "text").select("doc_id", "source", F.split(F.lower("text"), "[^a-z]+").alias("w"))
    f = w.select(F.col("source").alias("key"), F.col("doc_id").alias("finding"), F.coalesce(F.get("w", F.lit(2)), F.lit("")).alias("span"))
    m = w.where("size(w) > 1").select(F.col("source").alias("key"), F.col("doc_id").alias("expected"), F.array(F.get("w", F.lit(1))).alias("any_of"))
    return grading.recall(f, m, "key")


def _cases(spark, sf):
    e = table(spark, sf, "events")
    out = F.format_string('{"n":%d,"violations":[{"phrase":"p%d","category":"c%d"}]}', "event_id", F.col("event_id") % 5, F.col("event_id") % 3)
    kind = F.element_at(F.array(*[F.lit(x) for x in ("exit_code", "stdout_contains", "violation_phrase_contains", "violation_category_equals", "json")]), (F.col("event_id") % 5 + 1).cast("int"))
    value = F.element_at(F.array(*[F.lit(x) for x in ("1", "p2", "p2", "c0", "500")]), (F.col("event_id") % 5 + 1).cast("int"))
    return e.select((F.col("user_id") % 300).alias("case_id"), F.col("event_id").alias("at"), (F.col("event_id") % 2).cast("int").alias("exit_code"), out.alias("stdout"), kind.alias("type"), F.lit("n").alias("path"), F.lit("gte").alias("op"), value.alias("value"), (F.col("user_id") % 300 % 50 == 0).alias("xfail"))


_OK = 'a AS (SELECT user_id % 300 AS case_id, event_id AS "at", event_id % 5 AS k, CASE event_id % 5 WHEN 0 THEN event_id % 2 = 1 WHEN 1 THEN false WHEN 2 THEN true WHEN 3 THEN event_id % 3 = 0 ELSE event_id >= 500 END AS ok, user_id % 300 % 50 = 0 AS xfail FROM events)'


@query(f'WITH {_OK} SELECT "at", ok FROM a')
def assertion_results(spark, sf):
    """Every assertion type over recorded outputs."""
    return grading.assertions(_cases(spark, sf)).select("at", "ok")


@query(f"WITH {_OK}, s AS (SELECT case_id, CASE WHEN bool_or(xfail) THEN CASE WHEN bool_and(ok) THEN 'XPASS' ELSE 'XFAIL' END WHEN bool_and(ok) THEN 'PASS' ELSE 'FAIL' END AS status FROM a GROUP BY case_id) SELECT status, count(*) AS n FROM s GROUP BY ROLLUP (status)")
def suite_rollup(spark, sf):
    """Cases by status with the total."""
    return grading.rollup(grading.case_status(grading.assertions(_cases(spark, sf))))


@query("SELECT toxic AS label, count(*) AS n, count(*) FILTER (quality = 0) AS flagged FROM labels GROUP BY toxic")
def label_separation(spark, sf):
    """Low quality among toxic and other documents."""
    return grading.separation(table(spark, sf, "labels").select(F.col("toxic").alias("label"), (F.col("quality") == 0).alias("flagged")))


@query("SELECT source AS model, round(avg(n_chars % 100 / 100), 6) AS mean_recall, sum(doc_id % 4)::BIGINT AS false_findings, round(avg(CASE WHEN doc_id % 3 = 0 THEN 1 ELSE 0 END), 6) AS pass_rate, count(*) AS n FROM documents GROUP BY source")
def scoreboard(spark, sf):
    """Per-model means; a source stands for a model."""
    d = documents(spark, sf, "doc_id", "source", "n_chars")
    return grading.scoreboard(d.select(F.col("source").alias("model"), (F.col("n_chars") % 100 / 100).alias("recall"), (F.col("doc_id") % 4).alias("false_findings"), (F.col("doc_id") % 3 == 0).alias("passed")))


@query("SELECT doc_id::VARCHAR AS id, 'id shape' AS problem FROM documents UNION ALL SELECT doc_id::VARCHAR, 'missing field' FROM documents WHERE doc_id % 5 = 0 UNION ALL SELECT doc_id::VARCHAR, 'assertion type' FROM documents WHERE doc_id % 6 = 0")
def schema_problems(spark, sf):
    """Cases with malformed ids, missing fields or unknown assertion types."""
    d = documents(spark, sf, "doc_id")
    rows = d.select(F.col("doc_id").cast("string").alias("id"), F.when(F.col("doc_id") % 5 != 0, "t").alias("target"), F.lit("c").alias("command"), F.when(F.col("doc_id") % 6 == 0, F.array(F.lit("odd"))).otherwise(F.array(F.lit("json"))).alias("types"))
    return grading.schema_problems(rows, ["json", "exit_code"])


@query(
    """
    WITH p AS (SELECT doc_id // 2 AS slug, doc_id % 2 = 0 AS w, n_chars AS words, doc_id % 10 = 3 AS dirty, doc_id % 14 <> 0 AS hit FROM documents),
    j AS (SELECT coalesce(a.slug, b.slug) AS slug, a.words AS a, b.words AS b, b.dirty, a.hit FROM (SELECT * FROM p WHERE w) a FULL JOIN (SELECT * FROM p WHERE NOT w) b ON a.slug = b.slug)
    SELECT slug, 'twin missing' AS problem FROM j WHERE a IS NULL OR b IS NULL UNION ALL SELECT slug, 'length differs by over 25 %' FROM j WHERE abs(a - b) > 0.25 * greatest(a, b) AND a IS NOT NULL AND b IS NOT NULL
    UNION ALL SELECT slug, 'clean twin has findings' FROM j WHERE dirty UNION ALL SELECT slug, 'seeded twin misses its target' FROM j WHERE NOT hit
    """
)
def paired_hygiene(spark, sf):
    """Problems of twins: neighbouring ids are a pair."""
    d = documents(spark, sf, "doc_id", "n_chars")
    i = F.col("doc_id")
    rows = d.select(F.floor(i / 2).alias("slug"), F.when(i % 2 == 0, "with").otherwise("without").alias("variant"), F.col("n_chars").alias("words"), F.when(i % 10 == 3, 1).otherwise(0).alias("findings"), (i % 14 != 0).alias("targets_hit"))
    return grading.paired_hygiene(rows)


# --- catalog sync ---------------------------------------------------------------------------------------------------


def _wiki(spark, sf, version: int):
    """Each benchmark passage as a page of two sections; the second version changes some."""
    b = table(spark, sf, "benchmark")
    word = F.regexp_extract("text", r"^(\S+)", 1)
    extra = F.when((F.col("item_id") % 3 == 0) & F.lit(version == 2), F.lit("\n* '''novel'''")).otherwise(F.lit(""))
    tail = F.when((F.col("item_id") % 5 == 0) & F.lit(version == 2), F.lit(" changed")).otherwise(F.lit(""))
    third = F.when((F.col("item_id") % 4 == 0) & F.lit(version == 2), F.lit("\n== Vague claims ==\n* '''some say'''")).otherwise(F.lit(""))
    page = F.concat(F.lit("intro line\n== Words to watch ==\n* '''"), word, F.lit("'''"), extra, F.lit("\n== Structure ==\nplain"), tail, third)
    return b.select(F.col("item_id").alias("page_id"), page.alias("text"))


@query(
    """
    SELECT item_id AS page_id, 'Words to watch' AS title, 'new_words' AS change, 'novel' AS words FROM benchmark WHERE item_id % 3 = 0
    UNION ALL SELECT item_id, 'Structure', 'modified', '' FROM benchmark WHERE item_id % 5 = 0
    UNION ALL SELECT item_id, 'Vague claims', 'new_section', 'some say' FROM benchmark WHERE item_id % 4 = 0
    """
)
def section_diff(spark, sf):
    """Changes between two versions of the benchmark pages."""
    old, new = catalogs.sections(_wiki(spark, sf, 1)), catalogs.sections(_wiki(spark, sf, 2))
    return catalogs.section_diff(old, new).select("page_id", "title", "change", F.array_join("words", ",").alias("words"))


@query()
def catalog_prompts(spark, sf):
    """A task per changed page."""
    old, new = catalogs.sections(_wiki(spark, sf, 1)), catalogs.sections(_wiki(spark, sf, 2))
    return catalogs.prompts(catalogs.section_diff(old, new))


@query(
    """
    WITH l AS (SELECT event_type, max(ts)::DATE AS last FROM events GROUP BY event_type)
    SELECT event_type, last, date_diff('day', last, DATE '2024-06-30') AS days, date_diff('day', last, DATE '2024-06-30') > 155 AS stale FROM l
    """
)
def staleness(spark, sf):
    """Days since the last event of each type, and whether it is stale."""
    last = catalogs.latest_per_key(table(spark, sf, "events"), "event_type", "ts").withColumn("last", F.to_date("last"))
    out = catalogs.staleness(last, F.lit("2024-06-30").cast("date"), "event_type", F.lit(155))
    return out.withColumn("days", F.col("days").cast("long"))


@query("SELECT item_id AS page_id FROM benchmark WHERE item_id % 7 = 0")
def changed_pages(spark, sf):
    """Pages whose hash differs from the saved state."""
    pages = table(spark, sf, "benchmark").select(F.col("item_id").alias("page_id"), "text")
    state = pages.where("page_id % 7 <> 0").select("page_id", F.sha2("text", 256).alias("sha256"))
    return catalogs.changed(state, pages)


# --- manifests, seeded documents, climb findings -------------------------------------------------------------------


@query("SELECT doc_id::VARCHAR AS id FROM documents WHERE doc_id % 8 = 0 UNION ALL SELECT 'x' || item_id FROM benchmark")
def manifest_gaps(spark, sf):
    """Ids that only one of cases and splits has."""
    d = documents(spark, sf, "doc_id")
    cases = d.select(F.col("doc_id").cast("string").alias("id"))
    splits = d.where("doc_id % 8 <> 0").select(F.col("doc_id").cast("string").alias("id"), F.lit("tune").alias("split")).unionByName(table(spark, sf, "benchmark").select(F.format_string("x%d", "item_id").alias("id"), F.lit("holdout").alias("split")))
    return grading.split_manifest(cases, splits)[1]


@query("SELECT source AS slug, lang AS category FROM documents GROUP BY ALL HAVING count(*) < 3")
def seeded_problems(spark, sf):
    """Expected (source, language) rows that too few documents show."""
    d = documents(spark, sf, "source", "lang").select(F.col("source").alias("slug"), F.col("lang").alias("category"))
    seen = d.groupBy("slug", "category").count().where("count >= 3").drop("count")
    return grading.seeded_problems(d.distinct(), seen)


@query(
    """
    SELECT doc_id::VARCHAR || CASE WHEN doc_id % 3 = 0 THEN '_' ELSE '' END AS slug, 'slug' AS problem FROM documents WHERE doc_id % 3 = 0
    UNION ALL SELECT doc_id::VARCHAR || CASE WHEN doc_id % 3 = 0 THEN '_' ELSE '' END, 'hash' FROM documents WHERE doc_id % 4 = 0
    """
)
def manifest_problems(spark, sf):
    """Bundles with a bad slug or a hash that doesn't fit."""
    d = documents(spark, sf, "doc_id", "text")
    slug = F.concat(F.col("doc_id").cast("string"), F.when(F.col("doc_id") % 3 == 0, "_").otherwise(""))
    digest = F.when(F.col("doc_id") % 4 == 0, "0").otherwise(F.sha2("text", 256))
    return catalogs.manifest_problems(d.select(slug.alias("slug"), F.replace("text", F.lit("TODO"), F.lit("")).alias("redacted"), digest.alias("post_redaction_sha256")))


@query()
def climb_rounds(spark, sf):
    """Violation counts of a climb round over all documents, newline paragraphs."""
    from quillspark.operators import silhouette, structure
    from quillspark.queries.base import seeded

    docs = seeded(documents(spark, sf, "doc_id", "text"))
    rows = silhouette.scan(structure.scan(docs, separator=chr(10)).drop("declined"), separator=chr(10)).drop("declined")
    return loops.climb_violations(rows).groupBy("violation_count").agg(F.count("*").alias("n"))


@query("SELECT doc_id, 'Cut -ing tails: ' || (doc_id % 7)::DOUBLE || ' of the sentences end on one.' AS directive FROM documents WHERE doc_id % 2 = 0 UNION ALL SELECT doc_id, 'Vary sentence openers: only ' || (doc_id % 7)::DOUBLE || ' are distinct.' FROM documents WHERE doc_id % 2 = 1")
def climb_directives(spark, sf):
    """Directives joined to findings."""
    d = documents(spark, sf, "doc_id").withColumn("metric", F.when(F.col("doc_id") % 2 == 0, "participial_closer_share").otherwise("opener_repetition")).withColumn("value", (F.col("doc_id") % 7).cast("double"))
    return loops.climb_directives(d).select("doc_id", "directive")


@query("SELECT doc_id, row_number() OVER (ORDER BY n_chars DESC, doc_id) - 1 AS n FROM documents")
def global_numbers(spark, sf):
    """Place of each document by length, without a single-partition window."""
    from quillspark.plans.ordering import numbered

    return numbered(documents(spark, sf, "doc_id", "n_chars"), [F.desc("n_chars"), F.asc("doc_id")], "n").select("doc_id", "n")
