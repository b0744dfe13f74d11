"""Stylometry queries: ``source`` is the author; sources are compared with each other."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillspark.functions import text
from quillspark.operators import card, style
from quillspark.plans.scratch import checkpointed
from quillspark.queries import sql
from quillspark.queries.base import documents, query, seeded, seeded_sql, table

_FW = sql.listed(style.function_words())
_W = f"w AS (SELECT doc_id, source, text, {sql.style_words('text')} AS w FROM documents)"
_FREQ = f"""
    {_W}, t AS (SELECT source, sum(len(w)) AS total FROM w GROUP BY source),
    x AS (SELECT source, unnest(list_filter(w, lambda x: list_contains({_FW}, x))) AS word FROM w),
    f AS (SELECT source, word, count(*) / any_value(total) AS freq FROM x JOIN t USING (source) GROUP BY ALL)
"""


@query(f"WITH {_FREQ} SELECT source AS entity, word AS key, round(freq, 9) AS value FROM f")
def function_word_profile(spark, sf):
    """Function-word shares of each source."""
    f = style.function_frequencies(documents(spark, sf), "source")
    return f.select("entity", "key", F.round("value", 9).alias("value"))


_BACK = """
    n AS (SELECT count(DISTINCT source) AS m FROM documents),
    b AS (SELECT word, sum(freq) / any_value(m) AS mean, sqrt(greatest(0, sum(freq * freq) / any_value(m) - (sum(freq) / any_value(m)) ** 2)) AS sd FROM f, n GROUP BY word)
"""


@query(f"WITH {_FREQ}, {_BACK} SELECT word AS key, round(mean, 9) AS mean, round(CASE WHEN sd > 0 THEN sd ELSE 0.0001 END, 7) AS std FROM b")
def function_word_background(spark, sf):
    """Mean and deviation of each function word over the sources."""
    docs = documents(spark, sf)
    b = style.background(style.function_frequencies(docs, "source"), docs.select(F.col("source").alias("entity")))
    return b.select("key", F.round("mean", 9).alias("mean"), F.round("std", 7).alias("std"))


def _marks() -> str:
    each = " UNION ALL ".join(f"SELECT source, {sql.quoted(m)} AS key, sum(length(text) - length(replace(text, {sql.quoted(m)}, ''))) / sum(len(w)) AS v FROM w GROUP BY source" for m in style.MARKS)
    return f"WITH {_W} SELECT source AS entity, key, round(v, 9) AS value FROM ({each})"


@query(_marks())
def punctuation_rates(spark, sf):
    """Marks per word of each source."""
    return style.punctuation(documents(spark, sf), "source").select("entity", "key", F.round("value", 9).alias("value"))


@query(
    f"""
    WITH {_W}, x AS (SELECT source, least(length(u), 15)::INT AS key FROM (SELECT source, unnest(w) AS u FROM w)),
    n AS (SELECT source, key, count(*) AS n FROM x GROUP BY ALL)
    SELECT source AS entity, key, round(n / sum(n) OVER (PARTITION BY source), 9) AS value FROM n
    """
)
def word_length_histogram(spark, sf):
    """Shares of words by length."""
    return style.word_lengths(documents(spark, sf), "source").select("entity", "key", F.round("value", 9).alias("value"))


@query(
    f"""
    WITH {_W}, p AS (SELECT source, len(w) AS n, len(list_filter(w, lambda x: contains(x, ''''))) AS c FROM w)
    SELECT source AS entity, sum(n)::BIGINT AS words, round(sum(c) / sum(n), 9) AS contraction_rate FROM p GROUP BY source
    """
)
def style_scalars(spark, sf):
    """Words and contraction rate of each source."""
    return style.scalars(documents(spark, sf), "source").select("entity", "words", F.round("contraction_rate", 9).alias("contraction_rate"))


_G3 = f"""
    g AS (SELECT source, unnest({sql.char_grams('t')}) AS key FROM (SELECT source, {sql.normalized('text')} AS t FROM documents)),
    c AS (SELECT source, key, count(*)::DOUBLE AS value FROM g GROUP BY ALL),
    k AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY value DESC, key) AS r FROM c) WHERE r <= 2000)
"""


@query(f"WITH {_G3} SELECT source AS entity, key, value FROM k")
def char3_top_k(spark, sf):
    """The 2000 most frequent character 3-grams of each source."""
    return style.char3(documents(spark, sf), "source")


@query(
    f"""
    WITH {_G3}, n AS (SELECT source, sqrt(sum(value * value)) AS n FROM k GROUP BY source),
    d AS (SELECT a.source AS profile, b.source AS candidate, sum(a.value * b.value) AS dot FROM k a JOIN k b USING (key) GROUP BY ALL)
    SELECT profile, candidate, round(1 - dot / (x.n * y.n), 6) AS distance FROM d JOIN n x ON x.source = profile JOIN n y ON y.source = candidate
    """
)
def char3_cosine(spark, sf):
    """3-gram cosine distance between all sources."""
    g = style.char3(documents(spark, sf), "source")
    return style.cosine(g, g).select("profile", "candidate", F.round("distance", 6).alias("distance"))


_DELTA = f"""
    {_FREQ}, {_BACK}, k AS (SELECT word, mean, CASE WHEN sd > 0 THEN sd ELSE 0.0001 END AS sd FROM (SELECT *, row_number() OVER (ORDER BY round(mean, 15) DESC, word) AS r FROM b) WHERE r <= 200),
    s AS (SELECT DISTINCT source FROM documents),
    z AS (SELECT s.source, k.word, (coalesce(f.freq, 0) - mean) / sd AS z FROM s JOIN k ON true LEFT JOIN f ON f.source = s.source AND f.word = k.word),
    zn AS (SELECT source, sqrt(sum(z * z)) AS n FROM z GROUP BY source),
    dd AS (SELECT a.source AS profile, b.source AS candidate, sum(a.z * b.z) AS dot FROM z a JOIN z b USING (word) GROUP BY ALL)
"""


@query(f"WITH {_DELTA} SELECT profile, candidate, round(1 - dot / (x.n * y.n), 5) AS distance FROM dd JOIN zn x ON x.source = profile JOIN zn y ON y.source = candidate")
def burrows_delta(spark, sf):
    """Cosine of function-word z-vectors between all sources."""
    docs = documents(spark, sf)
    f, e = checkpointed(style.function_frequencies(docs, "source")), docs.select(F.col("source").alias("entity")).distinct()
    b = style.background(f, e)
    return style.delta(f, e, f, e, b, 200).select("profile", "candidate", F.round("distance", 5).alias("distance"))


_LEN = f"""
    l AS (SELECT source, unnest(list_transform({sql.style_sentences('text')}, lambda s: len({sql.style_words('s')}))) AS key FROM documents),
    h AS (SELECT source, key, count(*) / sum(count(*)) OVER (PARTITION BY source) AS p FROM l GROUP BY source, key)
"""


@query(
    f"""
    WITH {_LEN}, m AS (SELECT max(key) AS m FROM l), s AS (SELECT DISTINCT source FROM documents),
    g AS (SELECT a.source AS profile, b.source AS candidate, i.i FROM s a, s b, (SELECT unnest(range(1, (SELECT m + 1 FROM m))) AS i) i),
    j AS (SELECT g.profile, g.candidate, g.i, coalesce(x.p, 0) - coalesce(y.p, 0) AS d FROM g LEFT JOIN h x ON x.source = g.profile AND x.key = g.i LEFT JOIN h y ON y.source = g.candidate AND y.key = g.i),
    c AS (SELECT profile, candidate, abs(sum(d) OVER (PARTITION BY profile, candidate ORDER BY i)) AS c FROM j)
    SELECT profile, candidate, round(sum(c), 4) AS distance FROM c GROUP BY ALL
    """
)
def sentence_emd(spark, sf):
    """Earth mover's distance of sentence lengths between all sources."""
    docs = documents(spark, sf)
    n = style.sentence_lengths(docs, "source")
    s = docs.select("source").distinct()
    pairs = s.select(F.col("source").alias("profile")).join(s.select(F.col("source").alias("candidate")), F.lit(True))
    return style.earth_mover(n, n, pairs).select("profile", "candidate", F.round("distance", 4).alias("distance"))


@query(f"WITH {_LEN} SELECT source AS entity, median(key) AS median FROM l GROUP BY source")
def sentence_medians(spark, sf):
    """Median sentence length of each source."""
    return style.median_lengths(style.sentence_lengths(documents(spark, sf), "source"))


def _distances(spark, sf):
    """Sources as profiles; candidates are sources by language, impostors sources as well."""
    docs = documents(spark, sf)
    g, p = style.char3(docs, "source"), style.punctuation(docs, "source")
    w = style.word_lengths(docs, "source")
    parts = [style.cosine(g, g).withColumn("feature", F.lit("char3")), style.l1(p, p).withColumn("feature", F.lit("punctuation")), style.l1(w, w).withColumn("feature", F.lit("word_length"))]
    out = parts[0].unionByName(parts[1]).unionByName(parts[2]).where("profile <> candidate")
    return out.select("profile", "candidate", "feature", F.round("distance", 6).alias("distance"))


def _l1_sql(name: str, relation: str) -> str:
    return f"SELECT a.source AS profile, b.source AS candidate, '{name}' AS feature, round(sum(abs(a.v - b.v)), 6) AS distance FROM {relation} a JOIN {relation} b USING (key) GROUP BY ALL"


def _distance_sql() -> str:
    marks = " UNION ALL ".join(f"SELECT source, {sql.quoted(m)} AS key, sum(length(text) - length(replace(text, {sql.quoted(m)}, ''))) / sum(len(w)) AS v FROM w GROUP BY source" for m in style.MARKS)
    return f"""
    {_G3}, {_W}, pm AS ({marks}),
    wl AS (SELECT source, least(length(u), 15)::INT AS key FROM (SELECT source, unnest(w) AS u FROM w)),
    wn AS (SELECT source, key, count(*) / sum(count(*)) OVER (PARTITION BY source) AS v FROM wl GROUP BY source, key),
    wh AS (SELECT s.source, i.key, coalesce(wn.v, 0) AS v FROM (SELECT DISTINCT source FROM documents) s JOIN (SELECT unnest(range(1, 16))::INT AS key) i ON true LEFT JOIN wn ON wn.source = s.source AND wn.key = i.key),
    kn AS (SELECT source, sqrt(sum(value * value)) AS n FROM k GROUP BY source),
    kd AS (SELECT a.source AS profile, b.source AS candidate, sum(a.value * b.value) AS dot FROM k a JOIN k b USING (key) GROUP BY ALL),
    di AS (SELECT profile, candidate, 'char3' AS feature, round(1 - dot / (x.n * y.n), 6) AS distance FROM kd JOIN kn x ON x.source = profile JOIN kn y ON y.source = candidate
      UNION ALL {_l1_sql('punctuation', 'pm')} UNION ALL {_l1_sql('word_length', 'wh')}),
    ds AS (SELECT * FROM di WHERE profile <> candidate)
    """


@query(
    f"""
    WITH {_distance_sql()}, st AS (SELECT profile, feature, avg(distance) AS m, stddev_pop(distance) AS s FROM ds GROUP BY ALL)
    SELECT profile, candidate, feature, round((distance - m) / CASE WHEN s > 0 THEN s ELSE 0.0001 END, 2) AS z FROM ds JOIN st USING (profile, feature)
    """
)
def impostor_zscores(spark, sf):
    """z-scores of three distances of every source against all others."""
    d = _distances(spark, sf)
    return style.z_scores(d, d).select("profile", "candidate", "feature", F.round("z", 2).alias("z"))


@query()
def gi_exact(spark, sf):
    """Exact General-Impostors score of every source against all others, over three distances."""
    d = _distances(spark, sf)
    return style.gi_exact(d, d).select("profile", "candidate", F.round("gi", 6).alias("gi"))


@query()
def gi_seeded(spark, sf):
    """The same by 64 seeded trials."""
    d = _distances(spark, sf)
    return style.gi_seeded(d, d, seed=1)


@query()
def voice_scores(spark, sf):
    """All seven distances, z-scores, GI and composite of each source against each language's documents."""
    docs = documents(spark, sf)
    own = style.distances(docs, docs, "source", "lang")
    others = style.distances(docs, docs, "source", "source").where("profile <> candidate")
    z, gi = style.z_scores(own, others), style.gi_exact(own, others)
    return style.composite(z, gi)


@query()
def separation_matrix(spark, sf):
    """Whether each source's own documents score lowest against its profile."""
    docs = documents(spark, sf)
    d = style.distances(docs, docs, "source", "source")
    scores = style.composite(style.z_scores(d, d.where("profile <> candidate")), style.gi_exact(d, d.where("profile <> candidate")))
    return style.separation(scores)


@query()
def mtld(spark, sf):
    """Lexical diversity of every document."""
    return documents(spark, sf, "doc_id", "text").select("doc_id", F.round(style.mtld(text.style_words(F.col("text"))), 6).alias("mtld"))


@query()
def voice_bundles(spark, sf):
    """Feature bundle of every document: sizes and scalars of its parts."""
    b = style.bundle(documents(spark, sf, "doc_id", "text"))
    x = F.col("style")
    return b.select("doc_id", F.size(x["char3"]).alias("grams"), x["sentence_stats"]["median"].alias("median"), x["sentence_stats"]["iqr"].alias("iqr"), F.round(x["mtld"], 6).alias("mtld"), x["total_words"].alias("words"))


_NG = sql.word_grams("w", 4)


@query(
    f"""
    WITH {_W}, a AS (SELECT doc_id AS candidate, unnest({_NG}) AS g FROM w),
    b AS (SELECT item_id AS sample, unnest({_NG}) AS g FROM (SELECT item_id, {sql.style_words('text')} AS w FROM benchmark)),
    s AS (SELECT candidate, sample, count(*) AS n FROM a JOIN b USING (g) GROUP BY ALL), t AS (SELECT candidate, count(*) AS grams FROM a GROUP BY ALL)
    SELECT candidate, grams, round(coalesce(max(n), 0) / grams, 6) AS max_overlap FROM t LEFT JOIN s USING (candidate) GROUP BY candidate, grams
    """
)
def ngram_overlap(spark, sf):
    """Share of each document's 4-grams that one benchmark passage holds."""
    o = style.ngram_overlap(documents(spark, sf, "doc_id", "text"), table(spark, sf, "benchmark"), "doc_id", "item_id")
    return o.select("candidate", "grams", F.round("max_overlap", 6).alias("max_overlap"))


@query(
    """
    WITH a AS (SELECT doc_id, unnest(list_transform(range(1, length(text) - 119), lambda i: substring(text, i, 121))) AS w FROM documents WHERE length(text) >= 121),
    b AS (SELECT item_id, unnest(list_transform(range(1, length(text) - 119), lambda i: substring(text, i, 121))) AS w FROM benchmark WHERE length(text) >= 121)
    SELECT DISTINCT doc_id AS candidate, item_id AS sample FROM a JOIN b USING (w)
    """
)
def long_common_substring(spark, sf):
    """Documents that share 121 characters or more with a benchmark passage."""
    return style.long_copies(documents(spark, sf, "doc_id", "text"), table(spark, sf, "benchmark"), "doc_id", "item_id")


@query(
    f"""
    WITH gc AS (SELECT source, key, count(*)::DOUBLE AS value FROM (SELECT source, unnest({sql.char_grams('t')}) AS key FROM (SELECT source, {sql.normalized('text')} AS t FROM documents)) GROUP BY ALL),
    ka AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY value DESC, key) AS r FROM gc) WHERE r <= 2000),
    gb AS (SELECT item_id, key, count(*)::DOUBLE AS value FROM (SELECT item_id, unnest({sql.char_grams('t')}) AS key FROM (SELECT item_id, {sql.normalized('text')} AS t FROM benchmark)) GROUP BY ALL),
    kb AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY value DESC, key) AS r FROM gb) WHERE r <= 2000),
    d AS (SELECT source, item_id, sum(a.value * b.value) AS dot FROM ka a JOIN kb b USING (key) GROUP BY ALL),
    na AS (SELECT source, sqrt(sum(value * value)) AS n FROM ka GROUP BY ALL), nb AS (SELECT item_id, sqrt(sum(value * value)) AS n FROM kb GROUP BY ALL),
    x AS (SELECT source AS candidate, item_id AS sample, 1 - dot / (na.n * nb.n) AS distance FROM d JOIN na USING (source) JOIN nb USING (item_id)),
    r AS (SELECT *, row_number() OVER (PARTITION BY candidate ORDER BY distance, sample) AS rank FROM x)
    SELECT candidate, sample, rank::INT AS rank, round(distance, 6) AS distance FROM r WHERE rank <= 2
    """
)
def nearest_samples(spark, sf):
    """The two benchmark passages nearest to each source by 3-gram cosine."""
    n = style.nearest_samples(documents(spark, sf), table(spark, sf, "benchmark"), "source", "item_id", 2)
    return n.withColumn("distance", F.round("distance", 6))


@query(
    """
    WITH r AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY sha256('1|' || doc_id::VARCHAR)) AS r, count(*) OVER (PARTITION BY source) AS n FROM documents)
    SELECT doc_id, source, r <= greatest(2, floor(n * 0.4)) AS dev FROM r
    """
)
def dev_split(spark, sf):
    """A seeded split of each source's documents."""
    return style.dev_split(documents(spark, sf, "doc_id", "source"), "source", "doc_id")


# --- situations -----------------------------------------------------------------------------------------------------


def _dimension(name: str) -> str:
    if name in card.SIGNALS:
        return f"regexp_matches(lower(s), {sql.quoted(card._signal(card.SIGNALS[name]))})"
    if name == "numbers-data":
        return f"regexp_matches(lower(s), {sql.quoted(r'[0-9]|' + chr(92) + 'b' + '(?:' + card.NUMBER_ALTERNATIVES + ')' + chr(92) + 'b')})"
    if name == "addressing-reader":
        return r"(rtrim(s) LIKE '%?' OR regexp_matches(lower(s), '\b(?:you|your)\b'))"
    w = sql.style_words("s")
    return f"(list_has_any({w}, {sql.listed(card.FIRST_PERSON)}) AND (list_has_any({w}, {sql.listed(card.TIME_CUES)}) OR len(list_filter({w}, lambda x: x LIKE '%ed' AND length(x) > 3)) > 0))"


def _sits() -> str:
    split = sql.nonempty(r"list_transform(string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: regexp_replace(x, '\s+', ' ', 'g'))")
    lexical = " UNION ALL ".join(f"SELECT source, '{d}' AS dimension, s AS sentence FROM x WHERE {_dimension(d)}" for d in card.TAXONOMY if d not in card.STRUCTURAL)
    return f"""
    c AS (SELECT source, {split} AS l FROM ({seeded_sql()})), x AS (SELECT source, unnest(l) AS s FROM c),
    si AS ({lexical} UNION ALL SELECT source, 'openings', l[1] FROM c WHERE len(l) > 0 UNION ALL SELECT source, 'closings', l[len(l)] FROM c WHERE len(l) > 0)
    """


def _situations(spark, sf):
    return card.situations(seeded(documents(spark, sf)), "source")


@query(
    f"""
    WITH {_sits()}, n AS (SELECT source, dimension, count(*) AS n FROM si GROUP BY ALL),
    g AS (SELECT * FROM (SELECT DISTINCT source FROM n) s, (SELECT unnest({sql.listed(card.TAXONOMY)}) AS dimension) d)
    SELECT source, dimension, coalesce(n, 0) AS n, coalesce(n, 0) >= CASE WHEN dimension IN ('openings', 'closings') THEN 1 ELSE 2 END AS covered FROM g LEFT JOIN n USING (source, dimension)
    """
)
def situation_coverage(spark, sf):
    """Which situations each source's sentences cover."""
    return card.coverage(_situations(spark, sf), "source")


@query(
    f"""
    WITH {_sits()}, d AS (SELECT DISTINCT * FROM si), r AS (SELECT *, row_number() OVER (PARTITION BY source, dimension ORDER BY length(sentence), sentence) AS rank FROM d)
    SELECT source, dimension, sentence, rank::INT AS rank FROM r WHERE rank <= 3
    """
)
def shortest_snippets(spark, sf):
    """The three shortest sentences of each source and situation."""
    return card.shortest(_situations(spark, sf), "source")


@query(
    f"""
    WITH c AS (SELECT source, unnest({sql.nonempty(chr(10).join(["string_split(regexp_replace(text, '([.!?])" + chr(92) + "s+', '" + chr(92) + "1' || chr(1), 'g'), chr(1))"]))}) AS s FROM ({seeded_sql()})),
    n AS (SELECT source, {sql.style_words('s')}[1] AS word, count(*) AS n FROM c WHERE len({sql.style_words('s')}) > 0 GROUP BY ALL),
    r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n DESC, word) AS rank FROM n)
    SELECT source, rank::INT AS rank, word, n FROM r WHERE rank <= 5
    """
)
def opening_words(spark, sf):
    """The five most frequent opening words of each source."""
    return card.top_words(seeded(documents(spark, sf)), "source", "openers", 5)


@query()
def voice_sheets(spark, sf):
    """A markdown sheet for every covered situation."""
    return card.sheets(_situations(spark, sf), "source")


@query()
def burstiness_labels(spark, sf):
    """Rhythm label of every document."""
    return card.card_stats(documents(spark, sf, "doc_id", "text")).select("doc_id", "median", "iqr", "burstiness")


@query("SELECT source AS id, 'words' AS path FROM (SELECT source, count(*) AS n, sum(n_chars) AS c FROM documents GROUP BY source) WHERE n % 2 = 1")
def profile_difference(spark, sf):
    """First path at which two flattened profiles disagree: every odd-sized source is changed at ``words``."""
    d = documents(spark, sf, "source", "n_chars").groupBy(F.col("source").alias("id")).agg(F.count("*").cast("double").alias("n"), F.sum("n_chars").cast("double").alias("c"))
    flat = lambda n: d.select("id", F.inline(F.array(F.struct(F.lit("words").alias("path"), n.alias("value"), F.lit(True).alias("whole")), F.struct(F.lit("zchars").alias("path"), F.col("c").alias("value"), F.lit(True).alias("whole")))))
    return card.first_difference(flat(F.col("n")), flat(F.col("n") + F.col("n") % 2), "id")
