"""The ``opN_*`` queries: each applies one operator to its whole table and derives the result columns."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, crosspoly, langid, licenses, mixing, sharding, simhash, spann, urls

BPE_FILE = "byte_bpe_50k.json"
TOKEN_LIMIT = 512


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 40 contiguous shards of nearly equal bytes; equal texts stay together."""
    rows = sharding.shard_documents(table(spark, sf_dir, "documents").select("doc_id", "text"), 40)
    return rows.select(F.col("id").alias("doc_id"), "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    rows = simhash.near_duplicates(table(spark, sf_dir, "documents"), shingle=3, radius=2)
    return rows.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host, path, rule and verdict of every page."""
    rows = urls.judge_urls(table(spark, sf_dir, "pages"))
    return rows.select(F.col("id").alias("page_id"), "host", "path", "rule", "verdict", "ratio")


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's block, window and slot in the mix of sources (weights: size ** 0.9)."""
    rows = mixing.mix(table(spark, sf_dir, "documents").select("doc_id", "source"))
    return rows.select("row.doc_id", "row.source", "mix.*")


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base phrases and template matches of every document."""
    rows = licenses.scan_licenses(table(spark, sf_dir, "documents"))
    at = F.col("places")["word"]
    base = F.array_sort(F.array_distinct(F.col("places")["label"]))
    found = F.array_sort(F.array_distinct(F.concat(base, F.col("matches")["label"])))
    score = F.when(F.size("places") > 0, F.lit(1.0)).otherwise(F.coalesce(F.array_max(F.col("matches")["containment"]), F.lit(0.0)))
    return rows.select(
        F.col("id").alias("doc_id"),
        "n_words",
        F.size("places").cast("long").alias("n_base"),
        F.array_min(at).alias("first_word"),
        F.array_max(at).alias("last_word"),
        F.array_join(base, ",").alias("base_labels"),
        F.array_join(found, ",").alias("labels"),
        score.alias("score"),
    )


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes and tokens of every document."""
    rows = bpe.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path(BPE_FILE))
    return rows.select(F.col("id").alias("doc_id"), "n_bytes", "n_tokens", (F.col("n_tokens") > TOKEN_LIMIT).alias("over_limit"))


def op7_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Direct links, component and whether it is kept, for every vector."""
    rows = crosspoly.near_vectors(table(spark, sf_dir, "embeddings"), 0.9)
    return rows.select(F.col("id").alias("vec_id"), "n_links", F.col("component").alias("component_id"), F.col("id").eqNullSafe(F.col("component")).alias("kept"))


def op8_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest of every vector whose id is divisible by 20, by inner product."""
    return spann.search(table(spark, sf_dir, "embeddings"), lambda vec_id: vec_id % 20 == 0, k=20)


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language of every document, learnt from those that aren't held out."""
    docs = table(spark, sf_dir, "documents")
    model = langid.train(docs.where(~langid.held_out("doc_id")), "doc_id")
    found = langid.identify(docs, model, ["doc_id"])
    return found.select("row.doc_id", "lang_pred", "score").select("doc_id", langid.held_out("doc_id").alias("held_out"), "lang_pred", "score")


def bpe_digest(docs: DataFrame) -> DataFrame:
    rows = bpe.encode_decode(docs, public_tokenizers.path(BPE_FILE))
    return rows.select(F.col("id").alias("doc_id"), "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("text").cast("binary"), 256).alias("decoded_sha256"))


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded and decoded again, as digests."""
    return bpe_digest(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_sharding, op2_simhash, op3_url_filter, op4_mixing, op5_license_scan, op6_token_counts, op7_embedding_dedup, op8_ann, op9_language_id, op10_bpe)}


def _text(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def _list(items) -> str:
    return "[" + ", ".join(_text(x) for x in items) + "]"


def _license_sql() -> str:
    """Places by comparing words one by one; matches by counting template words between a word and as many further on as the template has."""
    starts = []
    for label, phrase in licenses.PHRASES:
        same = " AND ".join(f"w[i + {k}] = {_text(x)}" for k, x in enumerate(licenses.tokens(phrase), 1))
        starts.append(f"list_transform(list_filter(range(0, len(w)), lambda i: {same}), lambda i: {{'label': {_text(label)}, 'at': i}})")
    rows = []
    for k, (label, text, keys) in enumerate(licenses.TEMPLATES):
        own = licenses.tokens(text)
        rows.append(f"({k}, {_text(label)}, {_list(dict.fromkeys(own))}, {_list(licenses.tokens(keys))}, {len(own)})")
    return f"""
    WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
    p AS (SELECT doc_id, w, flatten([{", ".join(starts)}]) AS p FROM d),
    t(template, label, own, keys, wide) AS (VALUES {", ".join(rows)}),
    u AS (SELECT template, label, wide, len(own) AS size, unnest(own) AS word FROM t),
    s AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS at FROM d),
    h AS (SELECT s.doc_id, s.at, s.word, u.template, u.label, u.wide, u.size FROM s JOIN u USING (word)),
    b AS (SELECT x.doc_id, x.at, x.template, any_value(x.label) AS label, count(DISTINCT y.word) / any_value(x.size) AS share, list(DISTINCT y.word) AS inside
      FROM h x JOIN h y ON x.doc_id = y.doc_id AND x.template = y.template AND y.at >= x.at AND y.at < x.at + x.wide GROUP BY x.doc_id, x.at, x.template),
    m AS (SELECT doc_id, list(DISTINCT b.label) AS labels, max(share) AS share FROM b JOIN t USING (template) WHERE share >= 0.8 - 1e-9 AND list_has_all(inside, keys) GROUP BY doc_id)
    SELECT p.doc_id, len(w)::BIGINT AS n_words, len(p)::BIGINT AS n_base, list_min(list_transform(p, lambda x: x.at)) AS first_word, list_max(list_transform(p, lambda x: x.at)) AS last_word,
      array_to_string(list_sort(list_distinct(list_transform(p, lambda x: x.label))), ',') AS base_labels,
      array_to_string(list_sort(list_distinct(list_concat(list_transform(p, lambda x: x.label), coalesce(m.labels, []::VARCHAR[])))), ',') AS labels,
      CASE WHEN len(p) > 0 THEN 1.0 ELSE coalesce(share, 0.0) END AS score
    FROM p LEFT JOIN m ON p.doc_id = m.doc_id
    """


_MIXING_SQL = """
    WITH RECURSIVE z AS (SELECT source, count(*) AS n FROM documents GROUP BY source),
    e AS (SELECT source, n, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS idx, round((1000 - count(*) OVER ()) * pow(n, 0.9) / sum(pow(n, 0.9)) OVER (), 9) AS exact FROM z),
    s AS (SELECT source, n, idx, (1 + floor(exact) + CASE WHEN row_number() OVER (ORDER BY exact - floor(exact) DESC, idx) <= 1000 - count(*) OVER () - sum(floor(exact)) OVER () THEN 1 ELSE 0 END)::INT AS share FROM e),
    l AS (SELECT list(share ORDER BY idx) AS a FROM s),
    f AS (SELECT 0 AS t, list_transform(a, lambda x: 0) AS done, a, -1 AS pick FROM l
      UNION ALL
      SELECT t + 1, list_transform(done, lambda d, j: CASE WHEN j - 1 = k THEN d + 1 ELSE d END), a, k FROM (
        SELECT t, done, a, list_min(list_transform(range(1, len(a) + 1), lambda i: CASE WHEN done[i] < a[i] AND done[i] * 1000 // a[i] <= t THEN ((done[i] + 1) * 1000 + a[i] - 1) // a[i] * 10000 + i - 1 END)) % 10000 AS k
        FROM f WHERE t < 1000)),
    g AS (SELECT pick AS idx, t - 1 AS slot, row_number() OVER (PARTITION BY pick ORDER BY t) - 1 AS j FROM f WHERE pick >= 0),
    h AS (SELECT min((n + 15) // 16 // share * 1000 + slot) AS h FROM s JOIN g ON g.idx = s.idx AND g.j = (n + 15) // 16 % share),
    r AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY ('0x' || substr(md5(doc_id::VARCHAR), 1, 7))::BIGINT % greatest(64, ((SELECT count(*) FROM documents) + 49999) // 50000), doc_id) - 1 AS source_row FROM documents),
    b AS (SELECT r.doc_id, r.source, source_row, source_row // 16 AS block, share, idx, source_row // 16 // share * 1000 AS before, source_row // 16 % share AS j FROM r JOIN s ON r.source IS NOT DISTINCT FROM s.source)
    SELECT doc_id, source, source_row, block, before + j * 1000 // share AS release, before + ((j + 1) * 1000 + share - 1) // share AS deadline, before + slot AS slot,
      (before + slot) * 16 + source_row % 16 AS position, before + slot < h.h AS in_mix, share
    FROM b JOIN g USING (idx, j), h
"""

_NEAR_VECTORS_SQL = """
    WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS x FROM embeddings WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda y: y IS NULL OR NOT isfinite(y))) = 0 AND len(list_filter(embedding, lambda y: y <> 0)) > 0),
    e AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.x) = len(b.x) AND list_inner_product(a.x, b.x) / (sqrt(list_inner_product(a.x, a.x)) * sqrt(list_inner_product(b.x, b.x))) >= 0.9),
    r AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
    c AS (SELECT a AS vec_id, min(b) AS component_id FROM r GROUP BY a), n AS (SELECT a AS vec_id, count(*) AS n_links FROM e GROUP BY a)
    SELECT vec_id, coalesce(n_links, 0)::BIGINT AS n_links, component_id, vec_id = component_id AS kept FROM c LEFT JOIN n USING (vec_id)
"""

#: The others aren't stated in SQL: XXH64, trained models, byte-pair merging, minimax search and approximate search are tested against plain versions.
ORACLE: dict[str, str] = {"op4_mixing": _MIXING_SQL, "op5_license_scan": _license_sql(), "op7_embedding_dedup": _NEAR_VECTORS_SQL}
