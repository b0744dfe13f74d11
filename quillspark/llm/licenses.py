"""License scan: base phrases at word places, and an exact containment join with templates.

DataFrame functions only.  A block of a text is as many consecutive words as
the template has.  It matches if it holds all of the template's key words and
at least ``threshold`` of its distinct words.  Template words are put in the
order of how many documents of the corpus hold them, rarest first.  A text can
only hold a matching block if it shares one of the template's rarest words
(prefix filter), holds enough template words at all (length filter), and
enough of them after that one in this order, on either side (positional
filter).  The pairs of text and template that a join by these words leaves are
verified block by block.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, UPPER, ascii_lower, saved

SPLIT = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

PHRASES = (
    ("gpl", "gnu general public license"),
    ("apache", "apache license"),
    ("cc-by", "cc by"),
    ("mit", "mit license"),
)

#: Label, text, and the words without which a block isn't this license however much it shares with the text.
TEMPLATES = (
    ("gpl", "this work is licensed under the gnu general public license version 3", "gnu"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", "gnu"),
    ("apache", "licensed under the apache license version 2.0", "apache license"),
    ("mit", "released under the mit license", "mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "permission granted"),
    ("cc-by-nc", "licensed under cc by nc 4.0", "cc by nc"),
    ("cc-by-sa", "licensed under cc by sa 4.0", "cc by sa"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "redistribution"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license", "mozilla"),
)


def words(text: Column) -> Column:
    """ASCII-lower-cased runs of digits, letters and non-ASCII characters; null: none."""
    return F.filter(F.split(ascii_lower(F.coalesce(text.cast("string"), F.lit(""))), SPLIT), lambda w: w != "")


def tokens(text: str) -> list[str]:
    return [w for w in re.split(SPLIT, text.translate(str.maketrans(UPPER, LOWER))) if w]


def _strings(items) -> Column:
    return F.array(*[F.lit(x) for x in items]) if items else F.array().cast("array<string>")


def _table(spark, rows: list[tuple], names: str) -> DataFrame:
    """A small table from literals."""
    line = lambda r: F.struct(*[(F.array(*map(F.lit, x)) if isinstance(x, list) else F.lit(x)).alias(n) for x, n in zip(r, names.split(), strict=True)])
    return spark.range(1).select(F.inline(F.array(*map(line, rows))))


def word_places(docs: DataFrame, vocabulary: list[str], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``row, id, n_words, held, at``: for each text the numbers (in ``vocabulary``, from 1) and places of the words it has of it."""
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), words(F.col(text_col)).alias("words"))
    w, n, none = F.col("words"), F.size("words"), F.array().cast("array<int>")
    at = F.when(n > 0, F.filter(F.sequence(F.lit(0), n - 1), lambda i: F.get(w, i).isin(vocabulary))).otherwise(none) if vocabulary else none
    rows = rows.select("row", "id", "words", n.cast("long").alias("n_words"), at.alias("at"))
    held = F.transform("at", lambda i: F.array_position(_strings(vocabulary), F.get(w, i)).cast("int"))
    return rows.select("row", "id", "n_words", held.alias("held"), "at")


def candidates(rows: DataFrame, order: list[int], sets: list[tuple[list[int], int]]) -> DataFrame:
    """``row, template``: the pairs that prefix, length and positional filter leave.

    ``order``: all words (numbers), rarest first.  ``sets``: words of each
    template, and how many of them a block must hold.
    """
    rank = {w: i for i, w in enumerate(order)}
    prefixes = []
    for k, (own, need) in enumerate(sets):
        ranked = sorted(rank[w] for w in own)
        prefixes += [(r, k, place, len(own), need) for place, r in enumerate(ranked[: len(own) - need + 1], 1)]
    table = F.broadcast(_table(rows.sparkSession, prefixes, "rank template place size need"))  # as many rows as the templates have words
    ranks = F.array(*[F.lit(rank[w]) for w in range(1, len(order) + 1)])
    listed = F.array_sort(F.array_distinct(F.transform("held", lambda w: F.get(ranks, w - 1))))
    shared = rows.select("row", listed.alias("ranks")).select("row", F.size("ranks").alias("n"), F.posexplode("ranks").alias("at", "rank")).join(table, "rank")
    after = 1 + F.least(F.col("size") - F.col("place"), F.col("n") - F.col("at") - 1)
    return shared.where((F.col("n") >= F.col("need")) & (after >= F.col("need"))).select("row", "template").distinct()


def blocks(pairs: DataFrame) -> DataFrame:
    """``row, matches`` for pairs of text and template: ``row, held, at, template, label, words, keys, wide, need``.

    A block starts at a template word (any other one can be moved on to its
    first without losing words).  Of matching blocks that overlap, those are
    left that no overlapping one beats: by containment, then by earlier start.
    """
    wide = F.col("wide")
    both = F.arrays_zip(F.col("held").alias("held"), F.col("at").alias("at"))
    own = F.filter(both, lambda x: F.array_contains("words", x["held"]))
    pairs = pairs.select("row", "template", "label", "words", "keys", "wide", "need", own.alias("own"))

    def block(x: Column, i: Column) -> Column:
        inside = F.filter(F.slice("own", i + 1, wide), lambda y: y["at"] < x["at"] + wide)
        return F.struct(x["at"].alias("word"), F.array_distinct(F.transform(inside, lambda y: y["held"])).alias("inside"))

    fits = lambda b: (F.size(b["inside"]) >= F.col("need")) & (F.size(F.array_except("keys", b["inside"])) == 0)
    found = F.transform(F.filter(F.transform("own", block), fits), lambda b: F.struct(b["word"].alias("word"), F.size(b["inside"]).alias("n")))
    pairs = pairs.select("row", "template", "label", "words", "wide", found.alias("found")).where(F.size("found") > 0)

    def best(x: Column, i: Column) -> Column:
        beats = lambda y: (F.abs(y["word"] - x["word"]) < wide) & ((y["n"] > x["n"]) | ((y["n"] == x["n"]) & (y["word"] < x["word"])))
        return ~F.exists(F.slice("found", F.greatest(i + 1 - wide, F.lit(1)), 2 * wide), beats)

    match = lambda b: F.struct(F.col("label").alias("label"), F.col("template").alias("template"), b["word"].cast("long").alias("word"), (b["n"] / F.size("words")).alias("containment"))
    pairs = pairs.select("row", F.transform(F.filter("found", best), match).alias("matches"))
    return pairs.groupBy("row").agg(F.array_sort(F.flatten(F.collect_list("matches"))).alias("matches"))


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", phrases=PHRASES, templates=TEMPLATES, threshold: float = 0.8) -> DataFrame:
    """One row per row of ``docs``: ``id, n_words, places, matches``.

    ``places``: array of (label, word), one for every place where a phrase's
    words stand consecutively.  ``matches``: array of (label, template, word,
    containment) as in ``blocks``; ``word`` is where the block starts.  Null
    and empty texts have no words and empty arrays; repeated rows give repeated
    results; an empty table gives an empty result; other columns are ignored.
    Texts of any length are taken whole: a text costs its words, and for each
    candidate template the template's words in it times its length.
    """
    listed = [(label, tokens(text), tokens(keys)) for label, text, keys in templates if tokens(text)]
    spoken = [(label, tokens(text)) for label, text in phrases if tokens(text)]
    vocabulary = sorted({w for _, ws, keys in listed for w in ws + keys} | {w for _, ws in spoken for w in ws})
    if len(vocabulary) > 5000:
        raise ValueError("phrases and templates hold more than 5000 distinct words; they are compiled into the plan")
    number = {w: i for i, w in enumerate(vocabulary, 1)}
    rows = saved(word_places(docs, vocabulary, id_col, text_col))
    none = F.array().cast("array<struct<label:string,word:bigint>>")
    found = [_places(label, [number[w] for w in ws]) for label, ws in spoken]
    out = rows.select("row", "id", "n_words", F.concat(*found).alias("places") if found else none.alias("places"))
    nothing = F.array().cast("array<struct<label:string,template:int,word:bigint,containment:double>>")
    if not listed:
        return out.select("id", "n_words", "places", nothing.alias("matches"))
    counts = rows.select(F.explode(F.array_distinct("held")).alias("w")).groupBy("w").agg(F.count("*").alias("n"))
    counts = {r["w"]: r["n"] for r in counts.collect()}  # one row a vocabulary word
    order = sorted(number.values(), key=lambda w: (counts.get(w, 0), w))
    sets = [(sorted({number[w] for w in ws}), sorted({number[w] for w in keys}), len(ws)) for _, ws, keys in listed]
    needs = [max(1, math.ceil(threshold * len(own) - 1e-9)) for own, *_ in sets]
    pairs = candidates(rows, order, [(own, need) for (own, *_), need in zip(sets, needs, strict=True)])
    table = [(k, label, own, keys or [0], wide, need) for k, ((label, *_), (own, keys, wide), need) in enumerate(zip(listed, sets, needs, strict=True))]
    table = _table(docs.sparkSession, table, "template label words keys wide need").withColumn("keys", F.array_except("keys", F.array(F.lit(0))))
    pairs = pairs.join(F.broadcast(table), "template").join(rows.select("row", "held", "at"), "row")
    out = out.join(blocks(pairs), "row", "left")
    return out.select("id", "n_words", "places", F.coalesce("matches", nothing).alias("matches"))


def _places(label: str, phrase: list[int]) -> Column:
    """(label, word) for each place where the phrase's words stand consecutively."""
    same = lambda i, at: [(F.get("held", i + k) == x) & (F.get("at", i + k) == at + k) for k, x in enumerate(phrase)]
    starts = F.filter(F.transform("at", lambda at, i: F.when(_all(same(i, at)), at)), lambda at: at.isNotNull())
    return F.transform(starts, lambda at: F.struct(F.lit(label).alias("label"), at.cast("long").alias("word")))


def _all(conditions) -> Column:
    out = F.lit(True)
    for c in conditions:
        out = out & c
    return out
