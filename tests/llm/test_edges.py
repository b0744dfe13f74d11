"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing extra columns, for every operator and stage."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from quillspark.llm import bpe, components, crosspoly, langid, licenses, mixing, sharding, simhash, spann, urls

from . import brute

PATH = public_tokenizers.path("byte_bpe_50k.json")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
CLASH = ["id", "fp", "component", "key", "salt", "n", "row", "mix", "score", "lang_pred", "ids", "n_tokens", "rank", "vec", "slot", "size", "kept", "a", "b", "t"]


def _rows():
    rng = random.Random(4)
    words = ["alpha", "béta", "gamma", "delta", "the", "of", "license", "mit", "naïve", "42"]
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n))
    base = prose(60)
    rows = [(0, None, "en", "a", None), (1, "", None, "a", 0), (2, " \n\t ", "en", None, 3), (3, base, "en", "a", 9), (4, base, "en", "a", 9), (5, base + " end", "en", "b", 9)]
    rows += [(6, "Released under the MIT License. gnu general public license", "en", "b", 1), (7, "<|endoftext|>x<|endoftext|>", "fr", "b", 1), (8, prose(40_000), "fr", "a", 1), (9, "x" * 150_000, "fr", "c", 1)]
    rows += [(10, "no", "en", "a", 1), (10, "no", "en", "a", 1), (11, "ÀÉ 漢字   ²", None, "c", 1)]
    rows += [(12 + i, base, "en", "hot", 9) for i in range(60)]
    return rows


@pytest.fixture(scope="module")
def odd(spark):
    df = spark.createDataFrame(_rows(), SCHEMA)
    for c in CLASH:
        df = df.withColumn(c, F.lit("clash"))
    return df.repartition(3)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def test_components_of_long_paths_and_hubs(spark):
    edges = [(i, i + 1) for i in range(200)] + [(1000, 1001 + i) for i in range(300)] + [(5, 5), (7, 8), (8, 7), (2000, 1100)]
    got = {r["node"]: r["component"] for r in components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = brute.components({x for e in edges for x in e}, edges)
    assert got == {n: c for n, c in want.items()}


def test_components_in_one_task_are_those_of_rounds(spark):
    rng = random.Random(8)
    path = [rng.randrange(-(2**62), 2**62) for _ in range(150)]
    edges = [*zip(path, path[1:], strict=False), *((2**62, i) for i in range(50)), (5, 6), (6, 5), (7, 7), (None, 8), (9, None), (-(2**63), 2**63 - 1)]
    links = spark.createDataFrame(edges, "a long, b long")
    one = components.connected_components(links, rows=len(edges), one_task=len(edges))
    rounds = components.connected_components(links, rows=len(edges))
    assert one.dtypes == rounds.dtypes
    assert sorted(one.collect()) == sorted(rounds.collect())
    assert components.connected_components(links.limit(0), rows=0, one_task=1).collect() == []


@pytest.mark.parametrize("shards", [1, 3, 40])
def test_sharding(odd, shards):
    rows = sharding.shard_documents(odd, shards).collect()
    capacity, want = brute.shards([(r[0], r[1]) for r in _rows()], shards)
    sizes, slots = defaultdict(int), defaultdict(list)
    for r in rows:
        sizes[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
    assert len(rows) == len(_rows())
    assert max(sizes.values()) == capacity == rows[0]["capacity"]
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    text = {r[0]: r[1] for r in _rows()}
    assert all(r["shard"] == want[text[r["id"]]] for r in rows)


def test_minimax_with_few_known_places():
    rng = random.Random(1)
    for _ in range(60):
        sizes = [rng.choice([1, 2, 5, 40, 300]) for _ in range(rng.randint(1, 400))]
        ends = np.cumsum(sizes).tolist()
        shards = rng.randint(1, 12)
        fetch = lambda windows, width: [(r, ends[r - 1]) for a, b in windows for r in range(a, b + 1, width)]  # noqa: B023, E731
        capacity, last = sharding.minimax_cuts(len(sizes), ends[-1], max(sizes), shards, fetch, cells=16)
        low, high = max(max(sizes), -(-ends[-1] // shards)) - 1, ends[-1]

        def greedy(c):
            out, used = [], 0
            for r, s in enumerate(sizes, 1):  # noqa: B023
                if used + s > c:
                    out.append(r - 1)
                    used = 0
                used += s
            return [*out, len(sizes)]  # noqa: B023

        while high - low > 1:
            mid = (low + high) // 2
            low, high = (low, mid) if len(greedy(mid)) <= shards else (mid, high)
        assert capacity == high
        assert last == greedy(capacity)


def test_simhash(odd):
    rows = simhash.near_duplicates(odd).collect()
    want = brute.near_texts([(r[0], r[1]) for r in _rows()])
    assert len(rows) == len(_rows())
    assert all((r["fp"] % 2**64, r["component"]) == want[r["id"]] for r in rows)
    kept = simhash.keep_one(odd)
    assert kept.columns == odd.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted({c for _, c in want.values()})


def test_simhash_masks_cover_every_pair():
    covers = [m % 2**64 for m in simhash.masks(2)]
    for i in range(64):
        for j in range(i, 64):
            assert any(not m >> i & 1 and not m >> j & 1 for m in covers)


def test_simhash_large_buckets_lose_no_link(spark):
    rng = random.Random(2)
    centre = rng.getrandbits(64)
    prints = {centre} | {centre ^ 1 << rng.randrange(64) ^ 1 << rng.randrange(64) for _ in range(300)} | {rng.getrandbits(64) for _ in range(50)}
    df = spark.createDataFrame([((p - 2**64 if p >= 2**63 else p),) for p in prints], "fp long")
    want = brute.components(prints, [(a, b) for a in prints for b in prints if a < b and (a ^ b).bit_count() <= 2])
    for limit in (2, 48, 10_000):
        links = [(r["a"] % 2**64, r["b"] % 2**64) for r in simhash.near_links(df, 2, limit).collect()]
        assert all((a ^ b).bit_count() <= 2 for a, b in links)
        assert brute.components(prints, links) == want


def test_urls(spark):
    data = [None, "", "no scheme", "HTTP://A.ORG", "http://x.org/", "https://Deep.Example.ORG/es/1?q=http://b", "http://example.org/en/1", "http://notexample.org/es/", "http://com/de/", "http://a.com/fr/x#y", "http://a.net/p\nq"] + [f"http://s{i}.org/a{i}" for i in range(30)] + [f"http://s{i}.com/de/{i}" for i in range(30)]
    data += data[-5:] + ["http://q.net/" + "x" * 100_000]  # repeated rows, a very long one
    pages = spark.createDataFrame([(i, u, "clash", "clash") for i, u in enumerate(data)], "page_id long, url string, host string, block string")
    rules = [brute.url_rule(*brute.url_parts(u), urls.RULES) for u in data]
    want = brute.url_ratios(data, [r and int(r.allow) for r in rules])
    for options in ({}, {"block_rows": 3}):
        rows = urls.judge_urls(pages, **options).collect()
        assert len(rows) == len(data)
        for r in rows:
            rule, ratio = rules[r["id"]], want[r["id"]]
            assert (r["host"], r["path"], r["rule"]) == (*brute.url_parts(data[r["id"]]), rule and rule.name)
            assert r["ratio"] == (None if rule else pytest.approx(ratio, abs=1e-9))
            assert r["verdict"] == ("allow" if (rule.allow if rule else ratio >= 0) else "block")
    assert {r["verdict"] for r in urls.judge_urls(pages.where("page_id < 4")).collect()} == {"allow"}
    assert urls.judge_urls(pages.where("page_id < 0")).count() == 0


def test_mixing(odd):
    rows = mixing.mix(odd, {"a": 3.0, "b": 1.0}, block_docs=2, frame=50).select("row.doc_id", "row.source", "mix.*").collect()
    assert Counter(r["doc_id"] for r in rows) == Counter(r[0] for r in _rows())
    assert len({r["position"] for r in rows}) == len(rows)
    shares = [s for _, s in sorted({(r["source"] is not None, r["source"] or ""): r["share"] for r in rows}.items())]
    picks = brute.pfair(shares, 50)
    assert sum(shares) == 50
    assert brute.deviation(picks, shares, 50) < 1
    assert all(r["release"] <= r["slot"] < r["deadline"] for r in rows)
    mixed = mixing.mixed_documents(odd, block_docs=2, frame=50)
    assert mixed.columns == odd.columns


def test_mixing_holds_its_weights(spark):
    docs = spark.range(900).select(F.col("id").alias("doc_id"), F.when(F.col("id") < 600, "big").otherwise("small").alias("source"))
    mix = [r["source"] for r in mixing.mix(docs, {"big": 1.0, "small": 1.0}, block_docs=5, frame=20).where("mix.in_mix").orderBy("mix.position").select("row.source").collect()]
    assert 600 <= len(mix) <= 605  # less than one block ahead
    for i in range(5, len(mix) + 1, 5):
        assert abs(mix[:i].count("big") - i / 2) < 5 + (i == len(mix))


def test_licenses(odd):
    text = {r[0]: r[1] for r in _rows()}
    for r in licenses.scan_licenses(odd).collect():
        t = text[r["id"]]
        assert r["n_words"] == len(brute.license_words(t))
        assert sorted((p["label"], p["word"]) for p in r["places"]) == brute.license_places(t, licenses.PHRASES)
        assert sorted((m["label"], m["template"], m["word"], m["containment"]) for m in r["matches"]) == brute.license_matches(t, licenses.TEMPLATES, 0.8)


def test_license_labels(spark):
    """Each text with the labels that a reader would give it."""
    texts = {
        "Licensed under CC BY-NC 4.0.": {"cc-by-nc"},
        "All of it is licensed under CC BY SA 4.0": {"cc-by-sa"},
        "Licensed under CC BY 4.0.": set(),
        "Licensed under CC BY-NC-SA 4.0.": {"cc-by-nc", "cc-by-sa"},
        "released under the old license": set(),
        "It is released under the MIT license.": {"mit"},
        "licensed under the Apache License, Version 2.0": {"apache"},
        "licensed under the old license version 2.0": set(),
        "This work is licensed under the GNU General Public License, version 3.": {"gpl"},
        "this work is licensed under the general public transport license version 3": set(),
        "gnu " + "word " * 40 + "this work is licensed under the general public license version 3": set(),
        "Redistribution and use in source or binary forms, with or without modification, are permitted provided that the following terms are met": {"bsd"},
        "words in any order under license mit the released": {"mit"},
        "the of and " * 2000: set(),
        "released under the mit license " * 500: {"mit"},
    }
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    rows = {r["id"]: r for r in licenses.scan_licenses(docs).collect()}
    for i, (text, labels) in enumerate(texts.items()):
        assert {m["label"] for m in rows[i]["matches"]} == labels, text
        assert sorted(map(tuple, rows[i]["matches"])) == brute.license_matches(text, licenses.TEMPLATES, 0.8)
    bare = licenses.scan_licenses(docs, templates=(), phrases=()).collect()
    assert all(not r["matches"] and not r["places"] for r in bare) and len(bare) == len(texts)


def test_license_candidates_lose_nothing(spark):
    """Random texts of template words, so that blocks lie close to the threshold."""
    rng = random.Random(11)
    words = sorted({w for _, t, _ in licenses.TEMPLATES[:4] for w in licenses.tokens(t)}) + ["other", "plain"]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randint(0, 90))) for _ in range(120)]
    for label, t, _ in licenses.TEMPLATES[:4] * 20:
        part = [w if rng.random() < 0.85 else rng.choice(words) for w in licenses.tokens(t)]
        texts.append(" ".join([rng.choice(words) for _ in range(5)] + part + [rng.choice(words) for _ in range(5)]))
    some = tuple((label, t, "license" if label == "gpl" else "") for label, t, _ in licenses.TEMPLATES[:4])
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    got = {r["id"]: sorted(map(tuple, r["matches"])) for r in licenses.scan_licenses(docs, templates=some, threshold=0.7).collect()}
    want = {i: brute.license_matches(t, some, 0.7) for i, t in enumerate(texts)}
    assert got == want
    assert sum(map(bool, want.values())) > 40


def test_tokens(odd):
    library, text = Tokenizer.from_file(PATH), {r[0]: r[1] for r in _rows()}
    for r in bpe.count_tokens(odd, PATH).collect():
        assert r["n_tokens"] == len(library.encode(text[r["id"]] or "", add_special_tokens=False).ids)


def test_encode_and_decode(odd, nothing):
    library, want = Tokenizer.from_file(PATH), Counter()
    for r in _rows():
        want[(r[0], tuple(library.encode(r[1] or "", add_special_tokens=False).ids), r[1] or "")] += 1
    for block in ({}, {"most_words": 1}, {"most_text": 1}):  # whole tasks, and every batch a block of its own
        got = Counter()
        for r in bpe.encode_decode(odd, PATH, **block).collect():
            ids = np.frombuffer(bytes(r["ids"]), "<u4")
            assert r["n_tokens"] == len(ids)
            got[(r["id"], tuple(ids.tolist()), r["text"])] += 1
        assert got == want
    rows = bpe.decode(bpe.encode(odd, PATH), PATH).collect()
    assert Counter((r["id"], r["text"]) for r in rows) == Counter((r[0], r[1] or "") for r in _rows())
    assert bpe.encode_decode(nothing, PATH).count() == 0
    blank = odd.where("doc_id < 2")
    assert {(r["id"], r["n_tokens"], r["text"]) for r in bpe.encode_decode(blank, PATH).collect()} == {(0, 0, ""), (1, 0, "")}


def test_each_distinct_word_is_encoded_once(odd, spark):
    split = bpe.split_words(odd, PATH, False, most_text=1)
    uses = split.selectExpr("block", "explode(words) as word")
    assert uses.groupBy("word").count().where("count > 1").count() > 0  # many blocks use a word
    rows = bpe.encode_words(split, PATH).collect()
    sizes = [bpe.unpack(r["sizes"]) for r in rows]
    assert sum(map(len, sizes)) == uses.count()
    assert all(len(s) == len(bpe.unpack(r["steps"])) and s.sum() == len(bpe.unpack(r["ids"])) for r, s in zip(rows, sizes, strict=True))
    blocks = {r["block"] for r in bpe.split_words(odd, PATH, True, most_text=1).collect()}
    assert {r["block"] for r in rows} <= blocks


def test_packed_numbers():
    for a in ([], [0], [1, 2**31 - 1, 255, 256, 0]):
        assert bpe.unpack(bpe.pack(np.array(a, np.int32))).tolist() == a


def test_decode_of_any_ids(spark):
    library = Tokenizer.from_file(PATH)
    lists = [[220, 50256, 447], [447, 247], [], [999_999, 15496], None]
    data = [(i, 0, None if x is None else np.array(x, "<u4").tobytes()) for i, x in enumerate(lists)]
    got = {r["id"]: r["text"] for r in bpe.decode(spark.createDataFrame(data, "id int, n_tokens long, ids binary"), PATH).collect()}
    assert [got[i] for i in range(5)] == [library.decode(x or [], skip_special_tokens=False) for x in lists[:3]] + ["Hello", ""]


def _vectors():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(60, 16))
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(100 + i, (x[0] + rng.normal(size=16) * 0.05).tolist()) for i in range(40)] + [(200 + i, x[1].tolist()) for i in range(30)]
    return rows + [(300, None), (301, []), (302, [0.0] * 16), (303, [float("nan")] * 16), (304, [None] + [1.0] * 15), (305, [1.0, 2.0]), (306, [2.0, 4.0]), (307, [float("inf")] * 16)]


def test_near_vectors(spark):
    df = spark.createDataFrame(_vectors(), "vec_id long, embedding array<double>").withColumn("n", F.lit("clash")).withColumn("key", F.lit("clash"))
    want = brute.near_vectors(_vectors(), 0.9)
    for block in (8, 1024):  # one bucket in many blocks, and whole
        got = {r["id"]: (r["n_links"], r["component"]) for r in crosspoly.near_vectors(df, 0.9, block=block).collect()}
        assert got == want
    assert crosspoly.near_vectors(df.where("vec_id < 0")).count() == 0


def test_nearest(spark):
    df = spark.createDataFrame(_vectors(), "vec_id long, embedding array<double>").withColumn("list", F.lit("clash"))
    rows = [(i, v) for i, v in _vectors() if not (v and len(v) == 2)]
    want = brute.nearest(rows, 20, lambda i: i % 20 == 0)
    for options in ({"list_rows": 16, "block": 8}, {"list_rows": 1000}):
        got = defaultdict(list)
        for r in spann.search(df, lambda i: i % 20 == 0, **options).orderBy("query_id", "rank").collect():
            got[r["query_id"]].append((r["vec_id"], r["score"]))
        assert got.keys() == want.keys()
        hits = sum(len({v for v, _ in got[q]} & {v for v, _ in want[q]}) for q in want)
        assert hits >= 0.9 * sum(map(len, want.values()))
        assert all(len(got[q]) == 20 for q in want)
    few = spann.search(df.where("vec_id < 5"), lambda i: i % 20 == 0).collect()
    assert [r["vec_id"] for r in few if r["query_id"] == 0] == [v for v, _ in brute.nearest(rows[:5], 20, lambda i: i == 0)[0]]
    assert spann.search(df.where("vec_id < 0"), lambda i: i % 20 == 0).count() == 0


def test_language_id(odd, nothing):
    model = langid.train(odd.where(~langid.held_out("doc_id")), "doc_id")
    rows = langid.identify(odd, model, odd.columns).select("row.doc_id", "lang_pred", "score").collect()
    assert len(rows) == len(_rows())
    for r in rows:
        blank = r["doc_id"] in (0, 1, 2)
        assert (r["lang_pred"] == "und") == blank
        assert 0 <= r["score"] <= 1
    assert langid.train(nothing, "doc_id") is None
    assert langid.identify(odd, None, ["doc_id"]).where("lang_pred <> 'und'").count() == 0


def test_empty_tables(nothing):
    assert sharding.shard_documents(nothing).count() == 0
    assert simhash.near_duplicates(nothing).count() == 0
    assert mixing.mix(nothing).count() == 0
    assert licenses.scan_licenses(nothing).count() == 0
    assert bpe.count_tokens(nothing, PATH).count() == 0
    assert bpe.encode(nothing, PATH).count() == 0


def _stage_results(docs):
    """What each stage makes of documents (doc_id, text, lang, source, ...), stage by stage, from plain versions."""
    texts = {r["doc_id"]: r["text"] for r in docs}
    sets = {i: brute.shingles(t) for i, t in texts.items()}
    links = [(i, j) for i in sets for j in sets if j < i and (sets[i] == sets[j] or brute.jaccard(sets[i], sets[j]) >= 0.8)]
    of = brute.components(set(sets), links)
    return sorted({of[i] for i in of})


def test_pipeline_stages(spark, odd, nothing, sf):
    documents = spark.read.parquet(f"{sf}/documents.parquet")
    language_id, near_dedup, mix_sources, encode_decode = (f for _, f in corpus_pipeline.STAGES)
    library = Tokenizer.from_file(PATH)
    for docs in (documents, odd, nothing):
        columns, source = docs.columns, docs.collect()
        kept = language_id(spark, docs, sf)
        assert kept.columns == columns
        model = langid.train(docs.where(~langid.held_out("doc_id")), "doc_id")
        good = [r for r in source if any(c.isalpha() for c in r["text"] or "") and model.predict(r["text"])[1] >= 0.4] if model else []
        rows = kept.collect()
        assert Counter(map(str, rows)) == Counter(map(str, good))
        kept = spark.createDataFrame(rows, docs.schema)
        rows = near_dedup(spark, kept, sf).collect()
        assert sorted(r["doc_id"] for r in rows) == _stage_results(good)
        assert {str(r) for r in rows} <= set(map(str, good))
        kept = spark.createDataFrame(rows, docs.schema)
        mixed = mix_sources(spark, kept, sf)
        assert mixed.columns == columns
        order = [str(r) for r in mixed.collect()]
        assert Counter(order) == Counter(map(str, rows))
        places = [str(r["row"]) for r in mixing.mix(kept).orderBy("mix.position").collect()]
        assert order == places
        got = {r["doc_id"]: r for r in encode_decode(spark, mixed, sf).collect()}
        assert got.keys() == {r["doc_id"] for r in rows}
        for r in rows:
            ids = library.encode(r["text"] or "", add_special_tokens=False).ids
            d = got[r["doc_id"]]
            assert (d["n_tokens"], d["ids_sha256"]) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
            assert d["decoded_sha256"] == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_pipeline_run(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    want = docs
    for _, stage in corpus_pipeline.STAGES:
        rows = stage(spark, want, sf)
        want = spark.createDataFrame(rows.collect(), rows.schema)
    assert sorted(map(str, corpus_pipeline.run(spark, sf).collect())) == sorted(map(str, want.collect()))
    assert want.count() > 0
