"""Pieces of DuckDB SQL that say the same as the column functions."""

from __future__ import annotations

from quillspark.functions import text


def quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def listed(items) -> str:
    return "[" + ",".join(quoted(x) for x in items) + "]"


def found(t: str, pattern: str) -> str:
    return f"regexp_extract_all({t}, {quoted(pattern)})"


def count_of(t: str, pattern: str) -> str:
    return f"len({found(t, pattern)})"


def strip(t: str) -> str:
    return rf"regexp_replace({t}, '^\s+|\s+$', '', 'g')"


def nonempty(parts: str) -> str:
    return f"list_filter(list_transform({parts}, lambda s: {strip('s')}), lambda s: s <> '')"


def prose_words(t: str) -> str:
    return found(f"lower({t})", "[a-z0-9]+(?:[-'][a-z0-9]+)?")


def readability_words(t: str) -> str:
    return rf"list_filter(string_split_regex(lower(regexp_replace({t}, '[^\p{{L}}\p{{N}}_\s-]', ' ', 'g')), '\s+'), lambda w: w <> '')"


def style_words(t: str) -> str:
    return found(f"lower({t})", r"[a-z]+(?:'[a-z]+)?|\d+")


def style_sentences(t: str) -> str:
    return f"list_filter({found(t, '[^.!?]+[.!?]?')}, lambda s: regexp_matches(s, '[A-Za-z]|[0-9]'))"


def sentences(t: str) -> str:
    marked = rf"""regexp_replace({t}, '([.!?]["”]?)\s+(["“]?[A-Z])', '\1' || chr(1) || '\2', 'g')"""
    return nonempty(f"string_split({marked}, chr(1))")


def staccato_units(t: str) -> str:
    marked = rf"regexp_replace(regexp_replace({t}, '\s*[—;]\s*', chr(1), 'g'), '([.!?])\s+', '\1' || chr(1), 'g')"
    return nonempty(f"string_split({marked}, chr(1))")


def line_paragraphs(t: str, blank_blockquotes: bool = False) -> str:
    """Paragraphs with a newline as the separator, markdown marks off."""
    t = rf"regexp_replace({t}, '(?s)```.*?```', E'\n\n', 'g')"
    if blank_blockquotes:
        t = rf"regexp_replace({t}, '(?m)^[ \t]*>.*$', '', 'g')"
    for pattern in (r"(?m)^[ \t]{0,3}#{1,6}[ \t]+.*$", r"(?m)^[ \t]*[-*+][ \t]+", r"(?m)^[ \t]*\d+[.)][ \t]+"):
        t = f"regexp_replace({t}, {quoted(pattern)}, '', 'g')"
    if not blank_blockquotes:
        t = rf"regexp_replace({t}, '\*\*([^*\n]+)\*\*', '\1', 'g')"
    return nonempty(rf"list_transform(string_split({t}, E'\n'), lambda p: regexp_replace(p, '\s+', ' ', 'g'))")


def content(tokens: str, stopwords: list[str], longer_than: int) -> str:
    return f"list_filter({tokens}, lambda w: length(w) > {longer_than} AND NOT list_contains({listed(stopwords)}, w))"


def structure_content(t: str) -> str:
    return content(prose_words(t), text.STRUCTURE_STOPWORDS, 3)


def silhouette_content(t: str) -> str:
    return content(prose_words(t), text.SILHOUETTE_STOPWORDS, 3)


def bigrams(xs: str) -> str:
    return f"list_distinct(list_transform(range(1, greatest(len({xs}), 1)), lambda i: {xs}[i] || ' ' || {xs}[i + 1]))"


def syllables(w: str) -> str:
    groups = f"len(regexp_extract_all({w}, '[aeiouy]+'))"
    return f"CASE WHEN length({w}) <= 3 THEN 1 ELSE greatest(1, {groups} - CASE WHEN {w} LIKE '%e' AND {groups} > 1 THEN 1 ELSE 0 END + CASE WHEN regexp_matches({w}, '[^aeiouy]le$') THEN 1 ELSE 0 END) END"


def total(xs: str) -> str:
    return f"coalesce(list_sum({xs}), 0)"


def normalized(t: str) -> str:
    return strip(rf"regexp_replace(lower({t}), '\s+', ' ', 'g')")


def char_grams(t: str) -> str:
    return f"list_transform(range(1, greatest(length({t}) - 1, 1)), lambda i: substring({t}, i, 3))"


def word_grams(xs: str, n: int) -> str:
    return f"list_distinct(list_transform(range(1, greatest(len({xs}) - {n - 2}, 1)), lambda i: array_to_string({xs}[i:i + {n - 1}], ' ')))"
