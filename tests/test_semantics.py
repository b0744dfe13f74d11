"""Behaviour that is easy to get wrong, on small texts of our own."""

import math
import random
import time

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspark.functions import numbers, text
from quillspark.operators import card, catalogs, detect, diff, facts, grading, harvest, loops, prefs, readability, silhouette, stats, structure, style, suggest
from quillspark.plans import ordering, rules
from quillspark.sources import corpus, transcripts


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "text string").select(f(F.col("text")).alias("x")).first()["x"]


def violations(spark, t, **options):
    return detect.scan(spark.createDataFrame([(t,)], "text string"), **options).first()["violations"]


def test_tokenizers_stay_distinct(spark):
    t = "Don't re-use co-op-s: it's 3.5, naïve!"
    assert one(spark, t, text.prose_words) == ["don't", "re-use", "co-op", "s", "it's", "3", "5", "na", "ve"]
    assert one(spark, t, text.readability_words) == ["don", "t", "re-use", "co-op-s", "it", "s", "3", "5", "naïve"]
    assert one(spark, t, text.style_words) == ["don't", "re", "use", "co", "op", "s", "it's", "3", "5", "na", "ve"]
    assert one(spark, "a, b.", text.diff_tokens) == ["a", ",", "b", "."]


def test_sentences(spark):
    t = 'He left. "Why?" She stayed! e.g. this. Done.'
    assert one(spark, t, text.sentences) == ["He left.", '"Why?"', "She stayed! e.g. this.", "Done."]
    assert one(spark, "a — b; c. d", text.staccato_units) == ["a", "b", "c.", "d"]
    assert one(spark, "One. Two", text.terminated_sentences) == ["One."]


@pytest.mark.parametrize("word, n", [("the", 1), ("table", 2), ("make", 1), ("coffee", 1), ("queue", 1), ("little", 2), ("rhythm", 1), ("area", 2)])
def test_syllables(spark, word, n):
    assert one(spark, word, text.syllables) == n


def test_markdown_views(spark):
    t = "# Head\n\n> cited\n\n- **Bold** item\n1. two\n\n```\ncode\n```\nend"
    assert one(spark, t, lambda c: text.paragraphs(c, blank_blockquotes=True)) == ["**Bold** item two", "end"]
    assert one(spark, t, lambda c: text.paragraphs(c, strip_bold=True)) == ["> cited", "Bold item two", "end"]


def test_offsets(spark):
    df = spark.createDataFrame([("ab\ncd é x", 6)], "t string, s int")
    r = df.select(text.line_of(F.col("t"), F.col("s")), text.column_of(F.col("t"), F.col("s")), text.context_of(F.col("t"), F.col("s"))).first()
    assert tuple(r) == (2, 4, "cd é x")


def test_english_gate(spark):
    assert one(spark, "", lambda c: text.english_share(text.english_tokens(c))) == 1.0
    assert one(spark, "uno dos tres " * 6, lambda c: text.is_english(text.english_tokens(c))) is False


def test_masking_keeps_layout():
    t = 'a `code` "quoted\nmore" > b\n> cited\n```\nx\n```'
    m = detect.mask(t)
    assert len(m) == len(t)
    assert [i for i, c in enumerate(m) if c == "\n"] == [i for i, c in enumerate(t) if c == "\n"]
    assert "quoted" not in m and "code" not in m and "cited" not in m
    assert "quoted" in detect.mask(t, include_quoted=True)


def test_phrases_need_word_edges(spark):
    assert [v["phrase"] for v in violations(spark, "A Robust plan beats robustness and semi-robust ones on most of the longer days.")] == ["robust"]
    assert violations(spark, 'He said "robust" twice.') == []
    assert len(violations(spark, 'He said "robust" twice.', include_quoted=True)) == 1


def test_every_category_has_a_pack_and_every_rule_compiles():
    import re

    packs = rules.pack_of()
    for r in rules.catalog():
        re.compile(r.regex, re.I)
        assert r.category in packs


@pytest.mark.parametrize(
    "category, hit, clean",
    [
        ("jargon", "We leverage our expertise daily.", "They leverage the loan."),
        ("significance_inflation", "It plays a crucial role here.", "He plays a crucial scene."),
        ("binary_contrast", "This isn't a tool. It's a movement.", "This is a tool. It has a handle."),
        ("negative_parallelism", "It is not only fast but also safe.", "It is fast and safe."),
        ("em_dash_overuse", "It came — late — and left.", "It came — late and left."),
        ("hedge_stack", "It may possibly fail.", "It may fail."),
        ("contrastive_definition", "The design system is a build step, not an output.", "Use the left lane, not the right."),
        ("tool_agency_reflexive", "The suite defends itself.", "The test cleans up after itself."),
        ("filler", "It's worth noting this.", "It is worth a try."),
        ("exclamation_overuse", "Great! Yes!", "Great! Fine."),
        ("promotional", "It boasts a stunning view.", "It boasts a capacity of nine."),
        ("reader_addressing", "In this article, we will go.", "In this article by them."),
    ],
)
def test_minimal_pairs(spark, category, hit, clean):
    assert category in {v["category"] for v in violations(spark, hit)}
    assert category not in {v["category"] for v in violations(spark, clean)}


def test_frequency_gate(spark):
    line = "Rooms that breathe. "
    assert "fragment_template" not in {v["category"] for v in violations(spark, line + "The rest of the text goes on at some length here.")}
    assert "fragment_template" in {v["category"] for v in violations(spark, line + "The rest of the text goes on at some length here. " + line)}


def test_containment_keeps_identical_spans(spark):
    same = [rules.Rule(0, "phrase", "big plan", "x", "hard"), rules.Rule(1, "phrase", "big plan", "y", "hard"), rules.Rule(2, "phrase", "plan", "z", "hard")]
    assert [v["rule_id"] for v in violations(spark, "a big plan", rules=same)] == [0, 1]
    spans = spark.createDataFrame([(1, 0, 5, False), (1, 0, 5, False), (1, 1, 4, False), (1, 1, 4, True), (1, 6, 7, False)], "doc_id int, start int, end int, exempt boolean")
    assert sorted(r["start"] for r in detect.containment(spans).where("contained").collect()) == [1]


def test_guards_never_hide_a_match():
    import re

    sample = " ".join(r.pattern for r in rules.catalog() if r.kind == "phrase") + " We leverage our data. It may possibly be. The suite defends itself. Great! Yes!"
    every = {(r.rule_id, m.start(), m.end()) for r in rules.catalog() for m in re.finditer(r.regex, sample, re.I)}
    assert {(s["rule_id"], s["start"], s["end"]) for s in detect.matcher(tuple(rules.catalog())).spans(sample)} == every


def test_declines_only_clean_foreign_text(spark):
    df = spark.createDataFrame([("eins zwei drei vier " * 6,), ("robust " * 20,), (None,)], "text string")
    assert [r["declined"] for r in detect.scan(df).collect()] == [True, False, None]


def test_structure_flags(spark):
    uniform = "The cat sat on the mat today. " * 9
    r = structure.scan(spark.createDataFrame([(uniform,)], "text string")).first()["structure"]
    assert {f["metric"] for f in r["flags"]} >= {"sentence_burstiness", "opener_repetition"} - {"opener_repetition"}
    assert r["metrics"]["sentence_burstiness"] == 0.0
    labels = "\n\n".join(f"- **Label {i}**: text" for i in range(3))
    get = lambda genre: {f["metric"] for f in structure.scan(spark.createDataFrame([(labels,)], "text string"), genre=genre).first()["structure"]["flags"]}
    assert "bold_colon_listicle" in get("prose") and "bold_colon_listicle" not in get("docs")


def test_views_of_a_text_are_worked_out_once(spark):
    docs = spark.createDataFrame([("We go. We stop.", [(0, 2, "They")])], "text string, edits array<struct<start:int,end:int,replacement:string>>")
    rows = suggest.accept_all(docs)
    assert [(r["applied"], r["preserved"]) for r in rows.collect()] == [("They go. We stop.", True)]
    plan = rows.groupBy("clean", "preserved").count()._jdf.queryExecution().executedPlan().toString()
    assert 0 < plan.count("```") <= 8  # the first pattern of the paragraph view


def test_gates_of_facts_lose_none(monkeypatch):
    texts = ["$, and $5", "12% of 3 km", "May ٣, ٢٠٢١", "q1  1999 at 10:30", "Jan. 3 2020", "v1.2 and 1–2", "and/or /a/b/c", "“a long quotation”", "no digit, Maria Chen", "`x` a@b.co https://x.y", "on 2021-03-04, 5,000 users"]
    found = [facts.extract(t) for t in texts]
    monkeypatch.setattr(facts, "NEEDS", {})
    monkeypatch.setattr(facts, "WITHOUT_DIGITS", {k for k, _ in facts.PATTERNS})
    assert all(found) and found == [facts.extract(t) for t in texts]


def test_silhouette_minimums(spark):
    two = silhouette.scan(spark.createDataFrame([("One para.\n\nTwo para.",)], "text string")).first()["silhouette"]
    assert two["penalty"] is None and two["metrics"] is None and two["flags"] == []
    cues = "Intro about gardens.\n\nHowever, gardens grow.\n\nIn addition, gardens bloom.\n\nUltimately, gardens rest."
    r = silhouette.scan(spark.createDataFrame([(cues,)], "text string")).first()["silhouette"]
    assert r["metrics"]["scaffold_opener_share"] == 1.0 and r["metrics"]["role_entropy_bits"] == 2.0
    assert r["flags"][0]["metric"] == "silhouette_penalty"


def test_readability_of_nothing(spark):
    rows = readability.measure(spark.createDataFrame([("",), ("...",), (None,)], "text string")).collect()
    assert rows[0]["readability"]["flags"] == [readability.EMPTY_FLAG]
    assert rows[2]["readability"] is None
    assert rows[0]["readability"]["word_count"] == 0


def test_readability_rounds_as_its_sql(spark):
    words = ["paper"] * 23 + ["banana"] * 23  # 115 syllables: a grade of 31.849999999999998
    r = readability.measure(spark.createDataFrame([(" ".join(words),)], "text string")).first()["readability"]
    assert (r["word_count"], r["sentence_count"], r["syllable_count"]) == (46, 1, 115)
    assert r["flesch_kincaid_grade"] == 31.9
    values = [31.849999999999998, 29.849999999999998, -0.05, 0.25, -1.349999, 12.0, 1e17, None]
    got = [x["y"] for x in spark.createDataFrame([(i, x) for i, x in enumerate(values)], "i int, x double").select("i", numbers.rounded(F.col("x"), 1).alias("y")).orderBy("i").collect()]
    assert got == [duckdb.execute("select round(?::DOUBLE, 1)", [x]).fetchone()[0] for x in values]


def test_top_words_break_ties_by_first_place(spark):
    r = readability.measure(spark.createDataFrame([("Zebra apple zebra apple mango.",)], "text string")).first()["readability"]
    assert [(x["word"], x["n"]) for x in r["top_repeated_words"]] == [("zebra", 2), ("apple", 2), ("mango", 1)]


def test_constraints_priority_and_overlap():
    found = facts.extract("Paid $47.3 million on 2021-03-04, 12% more than 5,000 by Maria Chen at Section 4.")
    kinds = [(c["type"], c["value"]) for c in found]
    assert ("currency", "$47.3 million") in kinds and ("date_iso", "2021-03-04") in kinds and ("percentage", "12%") in kinds
    assert ("proper_noun", "Maria Chen") in kinds and ("reference", "Section 4") in kinds
    assert [c["start"] for c in found] == sorted(c["start"] for c in found)


@pytest.mark.parametrize(
    "kind, value, rewritten, kept",
    [
        ("currency", "$47.3M", "about 47.3 million dollars", True),
        ("currency", "$47.3M", "about $47.3 billion", False),
        ("percentage", "12%", "12 percent", True),
        ("percentage", "12%", "120 percent", False),
        ("percentage", "12%", "112%", True),
        ("measurement", "150 km", "150 kilometers", True),
        ("measurement", "150 km", "150 miles", False),
        ("and_or", "and/or", "a or b", True),
        ("and_or", "and/or", "a and b", False),
        ("time", "3:00 pm", "at 3pm", True),
        ("date_quarter", "Q3 2021", "the third quarter of 2021", True),
        ("date_natural", "March 3, 2021", "3 April 2021", False),
        ("quote", "“we will not stop”", 'said "we will not stop"', True),
        ("proper_noun", "Maria Chen", "Chen, Maria", True),
        ("count", "1,200 users", "1200 people", True),
        ("range", "5-10", "from 5 to 10", True),
    ],
)
def test_facts_survive(kind, value, rewritten, kept):
    assert facts.survives(kind, value, rewritten) is kept


def test_strict_preservation_fails_on_warnings(spark):
    pair = spark.createDataFrame([("It does not work in most cases.", "It works in cases.")], "original string, rewritten string")
    lax, strict = (facts.validate(pair, strict=s).first()["preservation"] for s in (False, True))
    assert lax["passed"] and not strict["passed"] and len(lax["warnings"]) == 2


def test_standalone():
    assert not facts.standalone("Can", "Cannot") and facts.standalone("Can", "Can they") and facts.standalone("$5", "x$5 ")


def test_diff_of_reordered_and_shrunk(spark):
    words = " ".join(f"w{i}" for i in range(40))
    back = " ".join(reversed(words.split()))
    rows = diff.diff(spark.createDataFrame([(words, back), (words, "w1 w2"), (words, words)], "original string, rewritten string")).collect()
    assert rows[0]["diff"]["flags"][0].startswith("Mostly reordered") and not rows[0]["diff"]["excessive"]
    assert rows[1]["diff"]["excessive"]
    assert rows[2]["diff"]["change_percentage"] == 0 and rows[2]["diff"]["flags"] == []


def test_wilson_and_statuses(spark):
    rows = [(f"p{i}", "contractions", "a", "2024", "contracted", None, i) for i in range(5)] + [(f"q{i}", "em_dash", "ab"[i % 2], "2024", None, None, i) for i in range(6)] + [("p0", "contractions", "b", "2023", None, None, 9)]
    df = spark.createDataFrame(rows, "pair_id string, dimension string, choice string, ts string, a_label string, b_label string, at int")
    got = {r["dimension"]: r for r in prefs.dimensions(prefs.latest(df)).collect()}
    assert (got["contractions"]["status"], got["contractions"]["preferred"]) == ("confident", "contracted")
    assert got["contractions"]["confidence"] == 0.566
    assert got["em_dash"]["status"] == "tied" and got["staccato"]["status"] == "insufficient"
    assert prefs.next_dimension(prefs.dimensions(prefs.latest(df))).first()["next_dimension"] == "sentence_length"


@pytest.mark.parametrize(
    "dimension, base, pole",
    [
        ("contractions", "It is late and they do not mind.", "contracted"),
        ("contractions", "It's late and they don't mind.", "expanded"),
        ("em_dash", "The plan — late — shipped.", "plain"),
        ("em_dash", "A lone — dash.", None),
        ("sentence_length", "The team shipped the fix, and the client renewed it.", "short"),
        ("connectives", "However, it rained.", "plain"),
        ("staccato", "We ran. We hid. We slept.", "flowing"),
    ],
)
def test_transforms(spark, dimension, base, pole):
    made = prefs.transformed(spark.createDataFrame([(base,)], "text string"), dimension).first()["made"]
    assert (made["pole"] if made else None) == pole


@pytest.mark.parametrize(
    "dimension, base, text",
    [
        ("contractions", "Don't worry, it's late and I'm home.", "Do not worry, it is late and I am home."),
        ("contractions", "The Venue Can't Stop tonight, it can't.", "The Venue Can't Stop tonight, it cannot."),
        ("contractions", "That is not what we have seen; I am sure. It is late.", "That isn't what we've seen; I'm sure. It's late."),
        ("contractions", "Nothing to change here.", None),
        ("sentence_length", "The team shipped the fix, and the client renewed it.", "The team shipped the fix. And the client renewed it."),
        ("sentence_length", "One, and two. We met the new team, so they were all glad. End.", "One, and two. We met the new team. So they were all glad. End."),
        ("sentence_length", "It rained. The road was wet!", "It rained, and the road was wet!"),
        ("sentence_length", "It rained. Priya was wet. Yes.", "It rained, and Priya was wet. Yes."),
        ("sentence_length", "Only one sentence stands here.", None),
        ("connectives", "However, it rained. Therefore we left. But then so.", "But it rained. So we left. But then so."),
        ("connectives", "But it rained. So, we left.", "However, it rained. Therefore, we left."),
        ("connectives", "It rained, however, a lot.", None),
        ("staccato", "We ran. We hid. Priya slept.", "We ran, we hid, and Priya slept."),
        ("staccato", "He packed the red car, and drove over the old hill, because snow fell on it!", "He packed the red car. Drove over the old hill. Snow fell on it!"),
        ("staccato", "He packed the car, then he drove away over the hill.", None),
    ],
)
def test_transformed_texts(spark, dimension, base, text):
    made = prefs.transformed(spark.createDataFrame([(base,)], "text string"), dimension).first()["made"]
    assert (made["text"] if made else None) == text


def test_rationale_names_the_suggestion(spark):
    mine = [rules.Rule(0, "phrase", "utilize", "jargon", "hard", 1, "use"), rules.Rule(1, "phrase", "myriad", "ai_vocabulary", "soft", 1, "many"), rules.Rule(2, "phrase", "it turns out", "throat_clearing", "hard")]
    df = spark.createDataFrame([("It turns out we utilize a myriad of the tools that are in the box.",)], "text string")
    got = [s["rationale"] for s in suggest.suggest(df, rules=mine).first()["suggestions"]]
    assert got == [
        "AI-writing tell (throat_clearing): replace “It turns out”.",
        "AI-writing tell (jargon): replace “utilize” — use",
        "Soft tell (ai_vocabulary): could “myriad” be cut or reworded here? Consider: many.",
    ]


def test_merge_warns_of_replacements_that_are_not_clean(spark):
    s = spark.createDataFrame([(1, 0, 3, "abc"), (1, 5, 8, "def"), (1, 9, 12, "ghi")], "doc_id int, start int, end int, span_text string")
    r = spark.createDataFrame([(1, 0, 3, "abc"), (1, 5, 8, "a treasure trove"), (1, 9, 12, "plain"), (1, 20, 21, "x")], "doc_id int, start int, end int, replacement string")
    merged, warned = suggest.merge(s, r)
    assert merged.count() == 3
    assert {(w["start"], w["warning"]) for w in warned.collect()} == {(0, "identical to span text"), (5, "does not pass the scanners alone"), (20, "targets unknown span")}


def test_severity_gate(spark):
    mine = [rules.Rule(0, "phrase", "hard one", "a", "hard"), rules.Rule(1, "phrase", "soft one", "b", "soft")]
    df = spark.createDataFrame([(1, "a hard one, a soft one"), (2, "a soft one"), (3, "none"), (4, None)], "doc_id int, text string")
    rows = {r["doc_id"]: (r["hard"], r["soft"], r["gate"]) for r in detect.severity_gate(detect.scan(df, rules=mine)).collect()}
    assert rows == {1: (1, 1, "fail"), 2: (0, 1, "review"), 3: (0, 0, "pass"), 4: (0, 0, "pass")}
    flagged = detect.scan(df, rules=mine).withColumn("flags", F.array(F.struct(F.lit("soft").alias("severity"))))
    assert {r["doc_id"]: r["gate"] for r in detect.severity_gate(flagged, flags=F.col("flags")).collect()} == {1: "fail", 2: "review", 3: "review", 4: "review"}


def test_syllables_of_a_line_are_those_of_its_words(spark):
    words = "a the mile little table e eee ale apple bottle rhythm hmm tsktsk idea queue free agree cafe psst 1234 x-ray re-use naïve the-le stle whole ugly every aisle".split()
    df = spark.createDataFrame([(words,), ([],), (words * 3,), *(([w],) for w in words)], "w array<string>")
    single = F.aggregate("w", F.lit(0), lambda a, w: a + text.syllables(w))
    for r in df.select("w", text.total_syllables(F.col("w")).alias("line"), single.alias("each")).collect():
        assert r["line"] == r["each"], r["w"]


@pytest.mark.parametrize("most", [100_000, 5])
def test_greedy_decisions(spark, most):
    rng = random.Random(3)
    n = 300 if most > 5 else 8
    edges = [(i, i + 1) for i in range(n)] + [(1000 + i, 1000 + j) for i in range(12) for j in range(i) if rng.random() < 0.3]
    edges = [(min(e), max(e)) for e in edges] + [(2000, 2001)]
    ids = sorted({x for e in edges for x in e} | {5000, 5001})
    want = {}
    for i in ids:
        want[i] = not any(want[a] for a, b in edges if b == i)
    table = spark.createDataFrame(edges, "a long, b long")
    got = harvest.resolve_greedy(spark.createDataFrame([(i,) for i in ids], "id long"), table, most).collect()
    assert {r["id"]: r["kept"] for r in got} == want


def test_statistics():
    assert stats.sign_flip([], 1) == 1.0
    assert stats.sign_flip([0.1] * 8, 7) == pytest.approx(2 / 256)
    low, high = stats.bca([0.1, 0.15, 0.2, 0.12, 0.18, 0.14, 0.16, 0.15], 7)
    assert 0.1 < low < 0.15 < high < 0.2
    assert stats.bca([0.0, 0.0, 0.0], 7) == (0.0, 0.0)


@pytest.mark.parametrize("n", [2, 13, 16, 31, 100])
def test_seeded_draws_are_those_of_random(n):
    rng = random.Random(7)
    want = [[rng.randrange(n) for _ in range(n)] for _ in range(stats.RESAMPLES)]
    assert [row for block in stats.resamples(n, 7, 5000) for row in block.tolist()] == want
    rng = random.Random(7)
    signs = np.array([[1 if rng.random() < 0.5 else -1 for _ in range(n)] for _ in range(stats.FLIPS)])
    x = np.arange(n) ** 2 - 5.0
    assert sorted(np.concatenate(list(stats.flipped_sums(x, 7, 1000))).tolist()) == sorted((signs @ x).tolist())


def test_flips_beyond_what_is_kept():
    few, many = (stats.Flips(3, most, 1 << 16).blocks(1000) for most in (1, 100))
    for _ in range(200):
        assert (next(few) == next(many)).all()


def test_statistics_of_a_large_group():
    rng = random.Random(2)
    sample = sorted(float(rng.randrange(-18, 23)) for _ in range(3000))
    start = time.process_time()
    low, high = stats.bca(sample, 7)
    p = stats.sign_flip(sample, 7)
    assert low < sum(sample) / 3000 < high and 0 < p < 0.05
    assert time.process_time() - start < 8  # 20 million draws by a loop take longer


def test_mtld_and_quartiles(spark):
    assert style.mtld_of(["a"] * 10) == 0.0
    assert style.mtld_of([f"w{i}" for i in range(30)]) == 30.0
    r = spark.createDataFrame([([1, 2, 3, 4, 5],), ([],), ([7],)], "x array<int>").select(style.length_stats(F.col("x")).alias("s")).collect()
    assert [(x["s"]["median"], x["s"]["iqr"]) for x in r] == [(3.0, 3.0), (0.0, 0.0), (7.0, 0.0)]


def test_gi_exact_against_enumeration(spark):
    import itertools

    own = [("p", "c", f, d) for f, d in zip(style.WEIGHTS, [0.1, 0.5, 0.2, 0.3, 0.1, 0.4, 0.2], strict=True)]
    imps = [("p", n, f, d + k * 0.07 - 0.1) for k, n in enumerate("xyzw") for _, _, f, d in own]
    schema = "profile string, candidate string, feature string, distance double"
    got = style.gi_exact(spark.createDataFrame(own, schema), spark.createDataFrame(imps, schema)).first()["gi"]
    names, want = list(style.WEIGHTS), 0.0
    for size in range(1, 8):
        for sub in itertools.combinations(names, size):
            score = lambda rows: sum(style.WEIGHTS[f] * d for _, _, f, d in rows if f in sub)  # noqa: B023, E731
            m = sum(score(own) < score([r for r in imps if r[1] == n]) for n in "xyzw")
            want += (1 / 128 + (1 / 896 if size == 1 else 0)) * math.comb(m, 2) / math.comb(4, 2)
    assert got == pytest.approx(want)


def test_greedy_resolution_equals_a_sequential_pass(spark):
    edges = [(1, 2), (2, 3), (3, 4), (1, 5), (5, 6), (7, 8), (6, 9)]
    ids = list(range(1, 11))
    kept = []
    for i in ids:
        if not any((k, i) in edges for k in kept):
            kept.append(i)
    got = harvest.resolve_greedy(spark.createDataFrame([(i,) for i in ids], "id int"), spark.createDataFrame(edges, "a int, b int"))
    assert sorted(r["id"] for r in got.where("kept").collect()) == kept


def test_near_duplicates_against_all_pairs(spark):
    import random

    rng = random.Random(5)
    base = [f"w{rng.randrange(60)}" for _ in range(80)]
    texts = [" ".join(base), " ".join(base), " ".join(base[:70] + ["x"] * 3), " ".join(base[20:]), " ".join(f"v{rng.randrange(60)}" for _ in range(50)), "too short"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    grams = [{tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)} for t in texts]
    want = {(a, b) for a in range(6) for b in range(a + 1, 6) if grams[a] and grams[b] and len(grams[a] & grams[b]) / min(len(grams[a]), len(grams[b])) > 0.6}
    got = {(r["a"], r["b"]) for r in harvest.duplicate_edges(df).collect()}
    assert got <= want and (0, 1) in got
    assert {(a, b) for a, b in want if 1 not in (a, b)} <= got  # copy 1 is linked to its class's first


def test_waterfall_reasons(spark):
    long = "This is a fine sentence with many words in it. " * 6
    rows = [(1, "Assistant: " + long), (2, "/deploy now"), (3, "Too short."), (4, long.replace(".", "")), (5, long), (6, "um, uh, " + "well um so. " * 20)]
    got = {r["id"]: (r["drop_reason"], r["dictated"]) for r in harvest.waterfall(spark.createDataFrame(rows, "id int, text string")).collect()}
    assert [got[i][0] for i in range(1, 6)] == ["quoted-assistant", "command-likeness", "length", "fragment-share", None]
    assert got[6][1]


def test_transcripts_discard_broken_files(spark):
    lines = [("a", 1, '{"type":"user","message":{"role":"user","content":"hello"}}'), ("a", 2, '{"type":"assistant","message":{"role":"assistant","content":"no"}}'), ("b", 1, '{"type":"user","message":{"content":"x"}}'), ("b", 2, "{bad"), ("c", 1, '{"other":1}')]
    lines += [("d", 1, '{"type":"event_msg","payload":{"type":"user_message","message":"mine"}}'), ("d", 2, '{"type":"response_item","payload":{"type":"message","role":"user","content":[{"type":"input_text","text":"<skill> no"}]}}'), ("d", 3, '{"type":"response_item","payload":{"type":"message","role":"user","content":[{"text":"two"},{"text":"parts"}]}}')]
    kept, drops, warned = transcripts.read(spark.createDataFrame(lines, "path string, line int, value string"))
    assert sorted(r["text"] for r in kept.collect()) == ["hello", "mine", "two\nparts"]
    assert {r["drop_reason"]: r["n"] for r in drops.collect()} == {"authorship": 1, "instruction-injection": 1}
    assert {r["path"]: r["warning"].split(";")[0] for r in warned.collect()} == {"b": "invalid JSON", "c": "unknown jsonl schema"}


def test_sections_and_watch_words(spark):
    page = "lead '''bold'''\n== Words ==\n* '''alpha'''\n* '''beta''' x\n: cited\n: more\n=== Sub ===\n{{blockquote|quoted}}"
    got = {r["title"]: r for r in catalogs.sections(spark.createDataFrame([(1, page)], "page_id int, text string")).collect()}
    assert got["Introduction"]["level"] == 1 and got["Words"]["watch_words"] == ["alpha", "beta"]
    assert got["Words"]["examples"] == ["cited\nmore"] and got["Sub"]["examples"] == ["quoted"] and got["Sub"]["level"] == 3


def test_suggestions_are_thinned(spark):
    row = suggest.suggest(spark.createDataFrame([("The plan is robust and it turns out that we will delve into it for the sake of all.",)], "text string")).first()
    spans = [(s["span"]["start"], s["span"]["end"]) for s in row["suggestions"]]
    assert spans and all(a[1] <= b[0] for a, b in zip(spans, spans[1:], strict=False))
    assert all(s["phrased_as_question"] == (s["severity"] == "soft") for s in row["suggestions"])


def test_apply_all_from_the_right(spark):
    df = spark.createDataFrame([("abcdef", [(1, 2, "XX"), (4, 5, "")])], "t string, e array<struct<start:int,end:int,replacement:string>>")
    assert df.select(suggest.apply_all(F.col("t"), F.col("e")).alias("x")).first()["x"] == "aXXcdf"


def test_replay_stops_on_divergence(spark):
    rows = [("r", 0, "a", 0.5, 0.9), ("r", 1, "b", 0.6, 0.8), ("r", 2, "c", 0.7, 0.7), ("r", 3, "d", 0.1, 0.1)]
    out = loops.replay(spark.createDataFrame(rows, "run string, iteration int, best string, dev double, a double"), patience=9).orderBy("iteration").collect()
    assert [r["accepted"] for r in out] == [True, False, False] and out[0]["stop_reason"] == "divergence"


def test_findings_of_replies(spark):
    replies = {
        '```json\n[{"span": "a"}]\n```': [("a", None)],
        'Sure: [{"span": "a"}] done': [("a", None)],
        '{"findings": [{"span": "b", "category": "c"}, 4]}': [("b", "c")],
        '{"span": "c"},\n{"span": "d"}\nthat is all': [("c", None), ("d", None)],
        '{"span": 5, "category": "x"}': [(None, "x")],
        "nothing": [],
        "": [],
        "[]": [],
        None: [],
    }
    df = spark.createDataFrame([(i, r) for i, r in enumerate(replies)], "i int, raw string")
    got = {r["i"]: [tuple(x) for x in r["f"]] for r in df.select("i", grading.findings(F.col("raw")).alias("f")).collect()}
    assert [got[i] for i in range(len(replies))] == list(replies.values())


def test_situations(spark):
    assert one(spark, "Yesterday I walked because it rained?", card.dimensions) == ["explaining-technical", "anecdote", "addressing-reader"]


def test_numbered_is_gapless(spark):
    rows = ordering.numbered(spark.range(500).withColumn("k", F.col("id") % 7), ["k", "id"], "n").collect()
    assert [r["id"] for r in sorted(rows, key=lambda r: r["n"])] == sorted(range(500), key=lambda i: (i % 7, i))


def test_let_works_once(spark):
    r = spark.createDataFrame([(3,)], "x int").select(numbers.let(F.col("x") + 1, lambda v: v * v).alias("y")).first()
    assert r["y"] == 16


def test_sources(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.TXT").write_text("one")
    (tmp_path / "sub" / "b.md").write_text(" \n")
    (tmp_path / "c.csv").write_text("no")
    rows = {r["path"].rsplit("/", 1)[1]: r["status"] for r in corpus.read_documents(spark, str(tmp_path)).collect()}
    assert rows == {"a.TXT": "ok", "b.md": "empty"}
    (tmp_path / "c.json").write_text('{"candidates": [{"text": "x", "words": 3}]}')
    assert [(r["index"], r["text"], r["words"]) for r in corpus.read_candidates(spark, str(tmp_path / "c.json")).collect()] == [(0, "x", 3)]
    assert corpus.provenance(spark, str(tmp_path)).where("words > 0 or words = 0").count() >= 1


def test_streaming_scan(spark, tmp_path):
    from quillspark.streaming import detectors

    spark.createDataFrame([(1, "It is robust."), (2, "Plain words here.")], "doc_id int, text string").write.parquet(str(tmp_path / "in"))
    stream = detectors.scan_stream(detectors.read_documents(spark, str(tmp_path / "in"), "doc_id int, text string"))
    q = detectors.write(stream, str(tmp_path / "out"), str(tmp_path / "ck"))
    q.processAllAvailable()
    q.stop()
    assert {r["doc_id"]: len(r["violations"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {1: 1, 2: 0}
