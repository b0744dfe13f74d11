"""Each opN query over a whole small table, held against a plain version."""

import hashlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from quillspark.llm import licenses, queries, urls

from . import brute

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def docs(spark, sf):
    return [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang", "source").collect()]


def test_sharding(spark, sf, docs):
    rows = queries.op1_sharding(spark, sf).collect()
    capacity, want = brute.shards([(d[0], d[1]) for d in docs], 40)
    text, sizes, slots = {d[0]: d[1] for d in docs}, defaultdict(int), defaultdict(list)
    assert len(rows) == len(docs)
    for r in rows:
        t = text[r["doc_id"]]
        assert r["shard"] == want[t]
        assert r["size"] == len((t or "").encode()) + 16
        assert r["text_crc32"] == (None if t is None else brute.crc(t))
        sizes[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
    assert max(sizes.values()) == capacity
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_simhash(spark, sf, docs):
    want = brute.near_texts([(d[0], d[1]) for d in docs])
    got = {r["doc_id"]: (int(r["fingerprint"], 16), r["component_id"]) for r in queries.op2_simhash(spark, sf).collect()}
    assert got == want


def test_url_filter(spark, sf):
    pages = {r["page_id"]: r["url"] for r in spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "url").collect()}
    rules = {i: brute.url_rule(*brute.url_parts(u), urls.RULES) for i, u in pages.items()}
    want = dict(zip(pages, brute.url_ratios(list(pages.values()), [rules[i] and int(rules[i].allow) for i in pages]), strict=True))
    rows = queries.op3_url_filter(spark, sf).collect()
    assert len(rows) == len(pages)
    for r in rows:
        rule, ratio = rules[r["page_id"]], want[r["page_id"]]
        assert (r["host"], r["path"], r["rule"]) == (*brute.url_parts(pages[r["page_id"]]), rule and rule.name)
        assert r["ratio"] == (None if rule else pytest.approx(ratio, abs=1e-9))
        assert r["verdict"] == ("allow" if (rule.allow if rule else ratio >= 0) else "block")


def test_mixing(spark, sf, docs):
    rows = queries.op4_mixing(spark, sf).collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(d[0] for d in docs)
    names = sorted({r["source"] for r in rows})
    share = {r["source"]: r["share"] for r in rows}
    shares = [share[s] for s in names]
    assert sum(shares) == 1000
    picks = brute.pfair(shares, 1000)
    assert brute.deviation(picks, shares, 1000) < 1
    place = defaultdict(list)
    for t, i in enumerate(picks):
        place[names[i]].append(t)
    for r in rows:
        frames, j = divmod(r["block"], r["share"])
        assert r["block"] == r["source_row"] // 16
        assert r["slot"] == frames * 1000 + place[r["source"]][j]
        assert r["release"] <= r["slot"] < r["deadline"]
    for s in names:
        mine = sorted(r["source_row"] for r in rows if r["source"] == s)
        assert mine == list(range(len(mine)))


def test_license_scan(spark, sf, docs):
    text = {d[0]: d[1] for d in docs}
    for r in queries.op5_license_scan(spark, sf).collect():
        t = text[r["doc_id"]]
        places = brute.license_places(t, licenses.PHRASES)
        matches = brute.license_matches(t, licenses.TEMPLATES, 0.8)
        starts = [w for _, w in places]
        assert r["n_words"] == len(brute.license_words(t))
        assert (r["n_base"], r["first_word"], r["last_word"]) == (len(places), min(starts, default=None), max(starts, default=None))
        base = {label for label, _ in places}
        assert r["base_labels"] == ",".join(sorted(base))
        assert r["labels"] == ",".join(sorted(base | {m[0] for m in matches}))
        assert r["score"] == (1 if places else max([m[3] for m in matches], default=0))


def test_token_counts(spark, sf, docs):
    library = Tokenizer.from_file(PATH)
    want = {d[0]: len(library.encode(d[1] or "", add_special_tokens=False).ids) for d in docs}
    for r in queries.op6_token_counts(spark, sf).collect():
        assert r["n_tokens"] == want[r["doc_id"]]
        assert r["over_limit"] == (r["n_tokens"] > 512)


def test_embedding_dedup(spark, sf):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    want = brute.near_vectors(rows, 0.9)
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in queries.op7_embedding_dedup(spark, sf).collect()}
    assert got == want


def test_ann(spark, sf):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    want = brute.nearest(rows, 20, lambda i: i % 20 == 0)
    got = defaultdict(dict)
    for r in queries.op8_ann(spark, sf).collect():
        got[r["query_id"]][r["rank"]] = (r["vec_id"], r["score"])
    assert got.keys() == want.keys()
    hits = 0
    for q, mine in got.items():
        assert sorted(mine) == list(range(1, 21))
        exact = dict(want[q])
        hits += len({v for v, _ in mine.values()} & exact.keys())
        scores = [mine[k][1] for k in sorted(mine)]
        assert scores == sorted(scores, reverse=True)
    assert hits / (20 * len(want)) >= 0.9


def test_language_id(spark, sf, docs):
    rows = {r["doc_id"]: r for r in queries.op9_language_id(spark, sf).collect()}
    right = []
    for i, text, lang, _ in docs:
        assert rows[i]["held_out"] == (brute.crc(str(i)) % 5 == 0)
        if rows[i]["held_out"] and lang and text and any(c.isalpha() for c in text):
            right.append(rows[i]["lang_pred"] == lang)
    assert np.mean(right) >= 0.9


def test_bpe(spark, sf, docs):
    library = Tokenizer.from_file(PATH)
    rows = {r["doc_id"]: r for r in queries.op10_bpe(spark, sf).collect()}
    for i, text, *_ in docs:
        ids = library.encode(text or "", add_special_tokens=False).ids
        back = library.decode(ids, skip_special_tokens=False)
        r = rows[i]
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(back.encode()).hexdigest()
