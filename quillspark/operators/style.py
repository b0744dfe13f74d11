"""Stylometry (A1-A23): feature relations per author or text, distances, impostor scores, copy gates.

Features are kept in long form, ``(entity, key, value)``, so that every
distance is an equi-join and a sum.  An author's features are sums over the
documents (combined before the shuffle); n-grams that would straddle two
documents aren't counted.
"""

from __future__ import annotations

import itertools
import random

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions import numbers, text

# Word list, marks, weights.
FUNCTION_WORDS = """
the of and to in a is that it for as with was on be by he i this are or his from at which but have an had they you
were their one all we can her has there been if more when will would who so no she about out up into do any your
what than them some could these other then its our two may first my now such like over only also after most did
many before must through back where much should well people down own just because good each those how under see
made very being make between both even another while last might still same never every against since off though
yet without within upon among until during per either neither nor whether whose whom why again once here there
therefore however although nevertheless moreover instead indeed perhaps rather thus else already almost around
across behind beyond near toward towards above below beside inside outside along plus minus except despite via
versus including regarding concerning am were does done doing having let lets cannot dont didn't doesn't isn't
aren't wasn't weren't haven't hasn't hadn't won't wouldn't shouldn't couldn't mightn't mustn't i'm you're he's
she's it's we're they're i've you've we've they've i'd you'd he'd she'd we'd they'd i'll you'll he'll she'll we'll
they'll me him us mine yours ours theirs myself yourself himself herself itself ourselves yourselves themselves
"""
MARKS = [",", ".", ";", ":", "?", "!", "-", "(", ")", '"', "'"]
WEIGHTS = {"char3": 0.30, "delta": 0.25, "sentence_emd": 0.10, "punctuation": 0.08, "contraction": 0.07, "mtld": 0.10, "word_length": 0.10}
TOP_GRAMS = 2000
LEAST_STD = 0.0001
LONG_COPY = 121


def function_words() -> list[str]:
    return list(dict.fromkeys(FUNCTION_WORDS.split()))


# --- features in long form ------------------------------------------------------------------------------------------


def char3(docs: DataFrame, by: str, text_col: str = "text", top: int | None = TOP_GRAMS) -> DataFrame:
    """``entity, key, value``: counts of character 3-grams, the ``top`` ones by (count, gram); every document counts whole."""
    grams = docs.select(F.col(by).alias("entity"), F.explode(text.char_grams(text.normalized(F.col(text_col)))).alias("key"))
    n = grams.groupBy("entity", "key").agg(F.count("*").cast("double").alias("value"))
    if top is None:
        return n
    rank = F.row_number().over(Window.partitionBy("entity").orderBy(F.desc("value"), "key"))
    return n.withColumn("_r", rank).where(F.col("_r") <= top).drop("_r")


def function_frequencies(docs: DataFrame, by: str, text_col: str = "text") -> DataFrame:
    """A1: ``entity, key, value``: share of each function word that occurs, among all T5 words.

    Words are exploded once and counted before the shuffle, all others as one
    key; so an entity has a row for each function word and one more.
    """
    words = docs.select(F.col(by).alias("entity"), F.explode(text.style_words(F.col(text_col))).alias("w"))
    key = F.when(F.col("w").isin(function_words()), F.col("w"))
    n = words.groupBy("entity", key.alias("key")).agg(F.count("*").alias("n"))
    shares = n.withColumn("value", F.col("n") / F.sum("n").over(Window.partitionBy("entity")))
    return shares.where("key is not null").select("entity", "key", "value")


def background(frequencies: DataFrame, entities: DataFrame) -> DataFrame:
    """``key, mean, std`` of each function word over ``entities`` (column ``entity``), absent ones as 0; std at least 1e-4 where it is 0."""
    n = entities.select("entity").distinct().agg(F.count("*").alias("m"))
    sums = frequencies.groupBy("key").agg(F.sum("value").alias("s"), F.sum(F.col("value") * F.col("value")).alias("q"))
    rows = sums.crossJoin(F.broadcast(n))  # one row
    mean = F.col("s") / F.col("m")
    var = F.greatest(F.lit(0.0), F.col("q") / F.col("m") - mean * mean)
    return rows.select("key", mean.alias("mean"), F.when(F.sqrt(var) > 0, F.sqrt(var)).otherwise(LEAST_STD).alias("std"))


def sentence_lengths(docs: DataFrame, by: str, text_col: str = "text") -> DataFrame:
    """``entity, key, value``: number of T9 sentences of each length in T5 words."""
    lengths = F.transform(text.style_sentences(F.col(text_col)), lambda s: F.size(text.style_words(s)))
    rows = docs.select(F.col(by).alias("entity"), F.explode(lengths).alias("key"))
    return rows.groupBy("entity", "key").agg(F.count("*").cast("double").alias("value"))


def punctuation(docs: DataFrame, by: str, text_col: str = "text") -> DataFrame:
    """A3: ``entity, key, value``: each mark per T5 word."""
    t = F.col(text_col)
    n = lambda mark: F.length(t) - F.length(F.replace(t, F.lit(mark), F.lit("")))
    rows = docs.select(F.col(by).alias("entity"), F.size(text.style_words(t)).alias("w"), *[n(m).alias(f"m{i}") for i, m in enumerate(MARKS)])
    sums = rows.groupBy("entity").agg(F.sum("w").alias("w"), *[F.sum(f"m{i}").alias(f"m{i}") for i in range(len(MARKS))])
    each = F.array(*[F.struct(F.lit(m).alias("key"), (F.col(f"m{i}") / F.greatest("w", F.lit(1))).alias("value")) for i, m in enumerate(MARKS)])
    return sums.select("entity", F.inline(each))


def word_lengths(docs: DataFrame, by: str, text_col: str = "text") -> DataFrame:
    """``entity, key, value``: share of words of 1 to 15 (and more) characters."""
    rows = docs.select(F.col(by).alias("entity"), F.explode(text.style_words(F.col(text_col))).alias("w"))
    n = rows.groupBy("entity", F.least(F.length("w"), F.lit(15)).alias("key")).agg(F.count("*").alias("n"))
    return n.select("entity", "key", (F.col("n") / F.sum("n").over(Window.partitionBy("entity"))).alias("value"))


def scalars(docs: DataFrame, by: str, text_col: str = "text") -> DataFrame:
    """``entity, words, contraction_rate, paragraphs, paragraph_words``."""
    w = text.style_words(F.col(text_col))
    rows = docs.select(F.col(by).alias("entity"), w.alias("w"), F.transform(text.style_paragraphs(F.col(text_col)), lambda p: F.size(text.style_words(p))).alias("p"))
    rows = rows.select("entity", F.size("w").alias("n"), F.size(F.filter("w", lambda x: x.contains("'"))).alias("c"), F.size("p").alias("m"), numbers.total(F.col("p")).alias("s"))
    sums = rows.groupBy("entity").agg(*[F.sum(c).alias(c) for c in "ncms"])
    return sums.select("entity", F.col("n").alias("words"), (F.col("c") / F.greatest("n", F.lit(1))).alias("contraction_rate"), F.col("m").alias("paragraphs"), F.coalesce(F.col("s") / F.when(F.col("m") > 0, F.col("m")), F.lit(0.0)).alias("paragraph_words"))


def length_stats(lengths: Column) -> Column:
    """A2: median, and quartiles as medians of the halves, of an array."""
    xs = F.array_sort(lengths)
    n = F.size(xs)
    half = F.floor(n / 2).cast("int")
    lower = F.when(half > 0, F.slice(xs, 1, half)).otherwise(xs)
    upper = F.when(n - F.floor((n + 1) / 2) > 0, F.slice(xs, F.floor((n + 1) / 2).cast("int") + 1, F.greatest(half, F.lit(0)))).otherwise(xs)
    return F.struct(F.coalesce(numbers.median(xs), F.lit(0.0)).alias("median"), F.coalesce(numbers.median(upper) - numbers.median(lower), F.lit(0.0)).alias("iqr"))


def mtld_of(tokens: list[str], threshold: float = 0.72) -> float:
    """A5: tokens per factor, forward only; a factor ends where the share of types falls to the threshold."""
    if len(tokens) < 20:
        return 0.0
    factors, types, n = 0.0, set(), 0
    for w in tokens:
        types.add(w)
        n += 1
        if len(types) / n <= threshold:
            factors, types, n = factors + 1, set(), 0
    if n:
        factors += (1 - len(types) / n) / (1 - threshold)
    return len(tokens) / factors if factors else float(len(tokens))


def mtld(tokens: Column) -> Column:
    @F.arrow_udf("double")
    def run(xs: pa.Array) -> pa.Array:
        return pa.array([None if x is None else mtld_of(x) for x in xs.to_pylist()], pa.float64())

    return run(tokens)


def author_mtld(docs: DataFrame, by: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``entity, value``: MTLD over each author's documents, weighted by their words (one task never holds an author)."""
    w = text.style_words(F.col(text_col))
    rows = docs.select(F.col(by).alias("entity"), F.size(w).alias("n"), mtld(w).alias("m")).where("n >= 20")
    return rows.groupBy("entity").agg((F.sum(F.col("m") * F.col("n")) / F.sum("n")).alias("value"))


def bundle(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """A1-A8 of each single text as one struct ``style`` (maps and arrays), without a shuffle."""
    t = F.col(text_col)
    rows = docs.withColumn("_w", text.style_words(t)).withColumn("_g", F.array_sort(text.char_grams(text.normalized(t))))
    rows = rows.withColumn("_l", F.transform(text.style_sentences(t), lambda s: F.size(text.style_words(s)))).withColumn("_p", F.transform(text.style_paragraphs(t), lambda p: F.size(text.style_words(p))))
    n = F.greatest(F.size("_w"), F.lit(1))
    share = lambda k: F.size(F.filter("_w", lambda x: F.least(F.length(x), F.lit(15)) == k)) / n
    out = F.struct(
        char3_map(F.col("_g")).alias("char3"),
        F.map_from_arrays(text.words_in(function_words()), F.transform(text.words_in(function_words()), lambda f: F.size(F.filter("_w", lambda x: x == f)) / n)).alias("function_words"),
        F.col("_l").alias("sentence_lengths"),
        length_stats(F.col("_l")).alias("sentence_stats"),
        F.map_from_arrays(text.words_in(MARKS), F.array(*[(F.length(t) - F.length(F.replace(t, F.lit(m), F.lit("")))) / n for m in MARKS])).alias("punctuation"),
        (F.size(F.filter("_w", lambda x: x.contains("'"))) / n).alias("contraction_rate"),
        mtld(F.col("_w")).alias("mtld"),
        F.map_from_arrays(F.transform(F.sequence(F.lit(1), F.lit(15)), lambda i: i.cast("string")), F.transform(F.sequence(F.lit(1), F.lit(15)), share)).alias("word_length_histogram"),
        F.struct(F.size("_p").alias("count"), F.coalesce(numbers.mean(F.col("_p")), F.lit(0.0)).alias("mean_words")).alias("paragraph_stats"),
        F.size("_w").alias("total_words"),
    )
    return rows.select(*docs.columns, F.when(t.isNotNull(), out).alias("style"))


def char3_map(ordered_grams: Column, top: int = TOP_GRAMS) -> Column:
    """Counts of the ``top`` grams by (count, gram): runs of the sorted array."""
    kind = pa.map_(pa.string(), pa.int32())

    @F.arrow_udf("map<string,int>")
    def run(xs: pa.Array) -> pa.Array:
        out = []
        for x in xs.to_pylist():
            runs = [(g, sum(1 for _ in same)) for g, same in itertools.groupby(x or [])]
            out.append(sorted(runs, key=lambda r: (-r[1], r[0]))[:top])
        return pa.array(out, kind)

    return run(ordered_grams)


# --- distances ------------------------------------------------------------------------------------------------------


def _norms(f: DataFrame) -> DataFrame:
    return f.groupBy("entity").agg(F.sqrt(F.sum(F.col("value") * F.col("value"))).alias("norm"))


def cosine(profiles: DataFrame, others: DataFrame, pairs: DataFrame | None = None) -> DataFrame:
    """A10: ``profile, candidate, distance`` for pairs that share a key (all others, and zero norms, are at 1).

    Keys are joined, never entities crossed.  ``pairs`` (profile, candidate)
    limits the result and adds the pairs that share nothing.
    """
    a, b = profiles.select(F.col("entity").alias("profile"), "key", F.col("value").alias("x")), others.select(F.col("entity").alias("candidate"), "key", F.col("value").alias("y"))
    dots = a.join(b, "key").groupBy("profile", "candidate").agg(F.sum(F.col("x") * F.col("y")).alias("dot"))
    if pairs is not None:
        dots = pairs.join(dots, ["profile", "candidate"], "left")
    na, nb = _norms(profiles).select(F.col("entity").alias("profile"), F.col("norm").alias("na")), _norms(others).select(F.col("entity").alias("candidate"), F.col("norm").alias("nb"))
    rows = dots.join(na, "profile", "left").join(nb, "candidate", "left")
    zero = (F.coalesce("na", F.lit(0.0)) == 0) | (F.coalesce("nb", F.lit(0.0)) == 0)
    return rows.select("profile", "candidate", F.when(zero, 1.0).otherwise(1 - F.coalesce("dot", F.lit(0.0)) / (F.col("na") * F.col("nb"))).alias("distance"))


def delta_vectors(frequencies: DataFrame, entities: DataFrame, back: DataFrame, top: int) -> DataFrame:
    """Z-scores on the ``top`` words of the background by (mean desc, word), for every entity."""
    rank = F.row_number().over(Window.orderBy(F.desc("mean"), "key"))  # over the word list, 234 rows at most
    words = F.broadcast(back.withColumn("_r", rank).where(F.col("_r") <= top).drop("_r"))
    grid = entities.select("entity").distinct().join(words, F.lit(True)).join(frequencies, ["entity", "key"], "left")
    return grid.select("entity", "key", ((F.coalesce("value", F.lit(0.0)) - F.col("mean")) / F.col("std")).alias("value"))


def delta(profiles: DataFrame, profile_entities: DataFrame, others: DataFrame, other_entities: DataFrame, back: DataFrame, top: int = 200) -> DataFrame:
    """Cosine distance of the z-vectors."""
    return cosine(delta_vectors(profiles, profile_entities, back, top), delta_vectors(others, other_entities, back, top))


def l1(profiles: DataFrame, others: DataFrame) -> DataFrame:
    """Sum of absolute differences over all keys, absent ones as 0: sum(x) + sum(y) - 2 * sum(least) over shared keys."""
    a, b = profiles.select(F.col("entity").alias("profile"), "key", F.col("value").alias("x")), others.select(F.col("entity").alias("candidate"), "key", F.col("value").alias("y"))
    both = a.join(b, "key").groupBy("profile", "candidate").agg(F.sum(F.least("x", "y")).alias("m"))
    sa = profiles.groupBy("entity").agg(F.sum("value").alias("sx")).withColumnRenamed("entity", "profile")
    sb = others.groupBy("entity").agg(F.sum("value").alias("sy")).withColumnRenamed("entity", "candidate")
    return both.join(sa, "profile").join(sb, "candidate").select("profile", "candidate", (F.col("sx") + F.col("sy") - 2 * F.col("m")).alias("distance"))


def earth_mover(profiles: DataFrame, others: DataFrame, pairs: DataFrame) -> DataFrame:
    """Sum of absolute differences of the cumulative shares over all lengths up to the longest, for each of ``pairs``.

    Between two lengths that occur the difference stands still, so only
    occurring lengths are rows, each weighted by the gap to the next.
    """
    share = lambda f, name: f.select(F.col("entity").alias(name), "key", (F.col("value") / F.sum("value").over(Window.partitionBy("entity"))).alias("s"))
    a = pairs.join(share(profiles, "profile"), "profile").select("profile", "candidate", "key", F.col("s").alias("d"))
    b = pairs.join(share(others, "candidate"), "candidate").select("profile", "candidate", "key", (-F.col("s")).alias("d"))
    steps = a.unionByName(b).groupBy("profile", "candidate", "key").agg(F.sum("d").alias("d"))
    order = Window.partitionBy("profile", "candidate").orderBy("key")
    rows = steps.withColumn("gap", F.coalesce(F.lead("key").over(order), F.col("key") + 1) - F.col("key")).withColumn("c", F.sum("d").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.groupBy("profile", "candidate").agg(F.sum(F.abs("c") * F.col("gap")).alias("distance"))


def median_lengths(lengths: DataFrame) -> DataFrame:
    """``entity, median`` of weighted sentence lengths, by running counts (no array of all sentences)."""
    order = Window.partitionBy("entity").orderBy("key").rowsBetween(Window.unboundedPreceding, 0)
    rows = lengths.withColumn("c", F.sum("value").over(order)).withColumn("n", F.sum("value").over(Window.partitionBy("entity")))
    low, high = F.floor((F.col("n") - 1) / 2), F.floor(F.col("n") / 2)
    return rows.groupBy("entity").agg(((F.min(F.when(F.col("c") > low, F.col("key"))) + F.min(F.when(F.col("c") > high, F.col("key")))) / 2.0).alias("median"))


def distances(profiles: DataFrame, candidates: DataFrame, profile_by: str, candidate_by: str, background_docs: DataFrame | None = None, text_col: str = "text") -> DataFrame:
    """All seven distances in long form: ``profile, candidate, feature, distance``.

    ``profiles`` and ``candidates`` are documents; the columns named tell which
    author or candidate each belongs to.  Background: the profiles' authors
    unless given.
    """
    pe, ce = profiles.select(F.col(profile_by).alias("entity")).distinct(), candidates.select(F.col(candidate_by).alias("entity")).distinct()
    pairs = pe.select(F.col("entity").alias("profile")).join(ce.select(F.col("entity").alias("candidate")), F.lit(True))
    back_docs = profiles if background_docs is None else background_docs
    pf, cf = function_frequencies(profiles, profile_by, text_col), function_frequencies(candidates, candidate_by, text_col)
    back = background(function_frequencies(back_docs, profile_by, text_col), back_docs.select(F.col(profile_by).alias("entity")))
    ps, cs = scalars(profiles, profile_by, text_col), scalars(candidates, candidate_by, text_col)
    few = cs.where("words < 300").select("entity")
    many = cs.where("words >= 300").select("entity")
    wide, narrow = delta(pf, pe, cf, many, back, 200), delta(pf, pe, cf, few, back, 50)
    pl, cl = sentence_lengths(profiles, profile_by, text_col), sentence_lengths(candidates, candidate_by, text_col)
    medians = median_lengths(pl).withColumnRenamed("entity", "profile")
    emd = earth_mover(pl, cl, pairs).join(medians, "profile").select("profile", "candidate", (F.col("distance") / F.when(F.col("median") > 0, F.col("median")).otherwise(1.0)).alias("distance"))
    pm, cm = author_mtld(profiles, profile_by, text_col=text_col), author_mtld(candidates, candidate_by, text_col=text_col)
    scalar = pairs.join(ps.select(F.col("entity").alias("profile"), F.col("contraction_rate").alias("x")), "profile").join(cs.select(F.col("entity").alias("candidate"), F.col("contraction_rate").alias("y")), "candidate")
    lexical = pairs.join(pm.select(F.col("entity").alias("profile"), F.col("value").alias("x")), "profile", "left").join(cm.select(F.col("entity").alias("candidate"), F.col("value").alias("y")), "candidate", "left").fillna(0.0, ["x", "y"])
    named = {
        "char3": cosine(char3(profiles, profile_by, text_col), char3(candidates, candidate_by, text_col), pairs),
        "delta": wide.unionByName(narrow),
        "sentence_emd": emd,
        "punctuation": l1(punctuation(profiles, profile_by, text_col), punctuation(candidates, candidate_by, text_col)),
        "contraction": scalar.select("profile", "candidate", F.abs(F.col("x") - F.col("y")).alias("distance")),
        "mtld": lexical.select("profile", "candidate", (F.abs(F.col("x") - F.col("y")) / F.when(F.col("x") > 0, F.col("x")).otherwise(1.0)).alias("distance")),
        "word_length": l1(word_lengths(profiles, profile_by, text_col), word_lengths(candidates, candidate_by, text_col)),
    }
    out = None
    for name, d in named.items():
        d = d.select("profile", "candidate", F.lit(name).alias("feature"), "distance")
        out = d if out is None else out.unionByName(d)
    return out


def z_scores(own: DataFrame, impostors: DataFrame) -> DataFrame:
    """``profile, candidate, feature, z`` against the impostors' distances to the same profile."""
    stats = impostors.groupBy("profile", "feature").agg(F.avg("distance").alias("mean"), F.stddev_pop("distance").alias("std"))
    std = F.when(F.col("std") > 0, F.col("std")).otherwise(LEAST_STD)
    return own.join(stats, ["profile", "feature"], "left").select("profile", "candidate", "feature", ((F.col("distance") - F.col("mean")) / std).alias("z"))


def weights(spark) -> DataFrame:
    return F.broadcast(spark.createDataFrame(list(WEIGHTS.items()), "feature string, weight double"))


def gi_exact(own: DataFrame, impostors: DataFrame) -> DataFrame:
    """A16, exact: expected share of General-Impostors trials won, over all feature subsets and all samples of impostors.

    A subset of seven features has probability 1/128; the empty one falls back
    on one feature, so each single feature gets 1/128 + 1/896.  With m of n
    impostors beaten and k = max(1, n // 2) sampled, a trial is won with
    probability C(m, k) / C(n, k).  ``profile, candidate, gi``.
    """
    spark, names = own.sparkSession, list(WEIGHTS)
    subsets = [(s, f, WEIGHTS[f], 1 / 128 + (1 / 896 if bin(s).count("1") == 1 else 0)) for s in range(1, 128) for i, f in enumerate(names) if s >> i & 1]
    table = F.broadcast(spark.createDataFrame(subsets, "subset int, feature string, weight double, p double"))  # 448 rows
    score = lambda d: d.join(table, "feature").groupBy("profile", "candidate", "subset", "p").agg(F.sum(F.col("weight") * F.col("distance")).alias("score"))
    mine, theirs = score(own), score(impostors).select("profile", "subset", F.col("score").alias("other"))
    beaten = mine.join(theirs, ["profile", "subset"]).groupBy("profile", "candidate", "subset", "p").agg(F.count(F.when(F.col("score") < F.col("other"), 1)).alias("m"), F.count("*").alias("n"))
    k = F.greatest(F.lit(1), F.floor(F.col("n") / 2))
    win = F.aggregate(F.sequence(F.lit(0), (k - 1).cast("int")), F.lit(1.0), lambda a, i: a * F.greatest(F.lit(0.0), (F.col("m") - i).cast("double")) / (F.col("n") - i))
    return beaten.groupBy("profile", "candidate").agg(F.sum(F.col("p") * win).alias("gi"))


def gi_seeded(own: DataFrame, impostors: DataFrame, seed: int = 1, trials: int = 64) -> DataFrame:
    """A16 as 64 seeded trials; one small group (a profile's impostors) per task.  ``profile, candidate, gi``."""
    names = list(WEIGHTS)

    def run(key: tuple, mine: pd.DataFrame, others: pd.DataFrame) -> pd.DataFrame:
        by = {c: dict(zip(g["feature"], g["distance"], strict=True)) for c, g in others.groupby("candidate", sort=True)}
        out = []
        for c, g in mine.groupby("candidate", sort=True):
            have, rng, wins = dict(zip(g["feature"], g["distance"], strict=True)), random.Random(seed), 0
            for _ in range(trials):
                subset = [f for f in names if rng.random() < 0.5] or [rng.choice(names)]
                total = lambda d: sum(WEIGHTS[f] * d.get(f, 0.0) for f in subset)  # noqa: B023, E731
                drawn = rng.sample(sorted(by), k=min(len(by), max(1, len(by) // 2)))
                wins += all(total(have) < total(by[x]) for x in drawn)
            out.append((key[0], c, wins / trials))
        return pd.DataFrame(out, columns=["profile", "candidate", "gi"])

    kinds = dict(own.dtypes)
    others = impostors.toDF(*impostors.columns)  # columns of its own, as both may be one relation
    return own.groupBy("profile").cogroup(others.groupBy("profile")).applyInPandas(run, f"profile {kinds['profile']}, candidate {kinds['candidate']}, gi double")


def composite(z: DataFrame, gi: DataFrame) -> DataFrame:
    """Half (1 - GI), half the weighted z-scores clipped to 3."""
    clipped = F.greatest(F.lit(-3.0), F.least(F.lit(3.0), F.coalesce("z", F.lit(0.0))))
    sums = z.join(weights(z.sparkSession), "feature").groupBy("profile", "candidate").agg(F.sum(F.col("weight") * clipped).alias("z_sum"))
    return sums.join(gi, ["profile", "candidate"]).select("profile", "candidate", "gi", "z_sum", (0.5 * (1 - F.col("gi")) + 0.5 * F.col("z_sum")).alias("composite"))


def with_confidence(d: DataFrame, words: DataFrame, column: str = "distance", least: int = 150) -> DataFrame:
    """Null for length-dependent features of short candidates.  ``words``: candidate, words."""
    low = (F.col("words") < least) & F.col("feature").isin("sentence_emd", "mtld")
    return d.join(words, "candidate").withColumn(column, F.when(~low, F.col(column)))


# --- copying --------------------------------------------------------------------------------------------------------


def ngram_overlap(candidates: DataFrame, samples: DataFrame, candidate_id: str, sample_id: str, n: int = 4, text_col: str = "text") -> DataFrame:
    """``candidate, grams, max_overlap``: largest share of a candidate's distinct word n-grams that one sample holds."""
    grams = lambda d, i, name: d.select(F.col(i).alias(name), F.explode(text.word_grams(text.style_words(F.col(text_col)), n)).alias("g"))
    a, b = grams(candidates, candidate_id, "candidate"), grams(samples, sample_id, "sample")
    shared = a.join(b, "g").groupBy("candidate", "sample").agg(F.count("*").alias("shared"))
    best = shared.groupBy("candidate").agg(F.max("shared").alias("shared"))
    totals = a.groupBy("candidate").agg(F.count("*").alias("grams"))
    return totals.join(best, "candidate", "left").select("candidate", "grams", (F.coalesce("shared", F.lit(0)) / F.col("grams")).alias("max_overlap"))


def long_copies(candidates: DataFrame, samples: DataFrame, candidate_id: str, sample_id: str, length: int = LONG_COPY, text_col: str = "text") -> DataFrame:
    """Distinct ``candidate, sample`` that share a run of ``length`` characters.

    Candidates, the larger side, are cut into windows of half the length, one
    after the other, so any shared run holds one of them whole; samples are cut
    at every place.  Windows are joined, and each hit is verified on both texts
    around it.
    """
    half = length // 2
    cut = lambda step: F.transform(F.sequence(F.lit(1), F.length("t") - (half - 1), F.lit(step)), lambda i: F.struct(i.alias("at"), F.substring("t", i, half).alias("w")))
    # short texts give no window: a sequence may not run backwards
    a = candidates.select(F.col(candidate_id).alias("candidate"), F.col(text_col).alias("t")).where(F.length("t") >= length)
    b = samples.select(F.col(sample_id).alias("sample"), F.col(text_col).alias("t")).where(F.length("t") >= length)
    wa = a.select("candidate", F.inline(cut(half))).select("candidate", F.col("at").alias("i"), "w")
    wb = b.select("sample", F.inline(cut(1))).select("sample", F.col("at").alias("j"), "w")
    hits = wa.join(wb, "w").select("candidate", "sample", "i", "j")
    rows = hits.join(a.withColumnRenamed("t", "ta"), "candidate").join(b.withColumnRenamed("t", "tb"), "sample")
    # a run of the length that holds this window starts up to length - half places before it
    shifts = F.sequence(F.lit(0), F.lit(length - half))
    run = lambda t, at, s: F.substring(F.col(t), at - s, F.lit(length))
    same = F.exists(shifts, lambda s: (F.col("i") > s) & (F.col("j") > s) & (F.length(run("ta", F.col("i"), s)) == length) & (run("ta", F.col("i"), s) == run("tb", F.col("j"), s)))
    return rows.where(same).select("candidate", "sample").distinct()


def nearest_samples(candidates: DataFrame, samples: DataFrame, candidate_id: str, sample_id: str, k: int = 2, text_col: str = "text") -> DataFrame:
    """The ``k`` samples nearest to each candidate by 3-gram cosine, ties by name."""
    d = cosine(char3(candidates, candidate_id, text_col), char3(samples, sample_id, text_col))
    rank = F.row_number().over(Window.partitionBy("profile").orderBy("distance", "candidate"))
    return d.withColumn("rank", rank).where(F.col("rank") <= k).select(F.col("profile").alias("candidate"), F.col("candidate").alias("sample"), "rank", "distance")


def dev_split(samples: DataFrame, by: str, id_col: str, seed: str = "1", share: float = 0.4, least: int = 2) -> DataFrame:
    """Adds ``dev``: 40 % of each author's samples (two at least), by a hash of seed and id; the same on any cluster."""
    order = Window.partitionBy(by).orderBy(F.sha2(F.concat_ws("|", F.lit(seed), F.col(id_col).cast("string")), 256))
    n = F.count("*").over(Window.partitionBy(by))
    return samples.withColumn("dev", F.row_number().over(order) <= F.greatest(F.lit(least), F.floor(n * share)))


def separation(scores: DataFrame) -> DataFrame:
    """Per profile, whether its own candidate (same name) has the lowest composite: ``profile, own, best_other, separated``."""
    own = F.min(F.when(F.col("profile") == F.col("candidate"), F.col("composite")))
    other = F.min(F.when(F.col("profile") != F.col("candidate"), F.col("composite")))
    return scores.groupBy("profile").agg(own.alias("own"), other.alias("best_other")).withColumn("separated", F.col("own") < F.col("best_other"))
