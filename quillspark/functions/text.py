"""Tokenizers and segmenters as Column expressions.

Several are alike and none may stand in for another: thresholds downstream
depend on the exact one.  Null texts give null arrays throughout.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillspark.functions import numbers

NO_STRINGS = "array<string>"

# The word lists and patterns below must be as they are for results to match.
ENGLISH_FUNCTION_WORDS = """
the and is are was were of to in that it for with on this but not you have be as at or we they will would there
their what which when from been has had its an by our your if than then them these those about into over after
before how why where who can could should do does did so out just more most some such only also because while
between through during being
""".split()

STRUCTURE_STOPWORDS = """
the a an and or but in on at to for of with by from is are was were be been being have has had do does did will
would could should may might must can it its this that these those we you they i he she as than if then so not no
yes into over under
""".split()

SILHOUETTE_STOPWORDS = STRUCTURE_STOPWORDS + """
our your their my me us them his her what which who when where how why there here about just more most some all
also out up one two get got like much many very every only
""".split()

READABILITY_STOPWORDS = """
the a an and or but in on at to for of with by from is are was were be been being have has had do does did will
would could should may might must shall can need it its this that these those i you he she we they what which who
when where why how not no yes if then else so as than just
""".split()

PROSE_WORD = "[A-Za-z0-9]+(?:[-'][A-Za-z0-9]+)?"
STYLE_WORD = r"[A-Za-z]+(?:'[A-Za-z]+)?|\d+"
SENTENCE_BREAK = r"""(?U)(?<=[.!?]["”]?)\s+(?=["“]?[A-Z])"""
UNIT_BREAK = r"(?U)\s*[—;]\s*|(?<=[.!?])\s+"
LINE_BREAKS = r"\r\n|[\r\x0B\x0C\x1C-\x1E\x85  ]"
BLANK_LINE = r"\n\s*\n"


def strip(t: Column) -> Column:
    return F.regexp_replace(t, r"(?U)^\s+|\s+$", "")


def nonempty(parts: Column) -> Column:
    """Trimmed parts, without those that are blank."""
    return F.filter(F.transform(parts, strip), lambda x: x != "")


def found(t: Column, pattern: str) -> Column:
    return F.regexp_extract_all(t, F.lit(pattern), F.lit(0))


def count_of(t: Column, pattern: str) -> Column:
    return F.regexp_count(t, F.lit(pattern))


def words_in(words: list[str]) -> Column:
    return F.array(*[F.lit(w) for w in words])


# --- tokenizers ------------------------------------------------------------------------------------------------------


def prose_words(t: Column) -> Column:
    """Lower-case alphanumeric runs with at most one hyphen or apostrophe inside."""
    return found(F.lower(t), PROSE_WORD)


def english_tokens(t: Column) -> Column:
    """Runs of a-z and apostrophes in lower case."""
    return found(F.lower(t), "[a-z']+")


def readability_words(t: Column) -> Column:
    """Everything but word characters, white space and hyphens becomes a space; split at white space."""
    return F.filter(F.split(F.lower(F.regexp_replace(t, r"(?U)[^\w\s-]", " ")), r"(?U)\s+"), lambda w: w != "")


def diff_tokens(t: Column) -> Column:
    """T4: word runs, and every punctuation mark by itself."""
    return found(F.lower(t), r"(?U)\w+|[^\w\s]")


def style_words(t: Column) -> Column:
    """T5: letters with one optional apostrophe part, or a run of digits."""
    return found(F.lower(t), STYLE_WORD)


def harvest_words(t: Column) -> Column:
    """As T1, case kept."""
    return found(t, PROSE_WORD)


def card_word_count(t: Column) -> Column:
    """Number of runs of letters, digits and apostrophes."""
    return count_of(t, "[A-Za-z0-9']+")


def content_words(tokens: Column, stopwords: list[str], longer_than: int) -> Column:
    """Tokens over a length that aren't stop words."""
    return F.filter(tokens, lambda w: (F.length(w) > longer_than) & ~F.array_contains(words_in(stopwords), w))


def structure_content(t: Column) -> Column:
    return content_words(prose_words(t), STRUCTURE_STOPWORDS, 3)


def silhouette_content(t: Column) -> Column:
    return content_words(prose_words(t), SILHOUETTE_STOPWORDS, 3)


def readability_content(words: Column) -> Column:
    return content_words(words, READABILITY_STOPWORDS, 2)


# --- sentences -------------------------------------------------------------------------------------------------------


def sentences(t: Column) -> Column:
    """Breaks after . ! ? and an optional closing quote, before an optional opening quote and a capital."""
    return nonempty(F.split(t, SENTENCE_BREAK))


def staccato_units(t: Column) -> Column:
    """Breaks at em dashes, semicolons and after . ! ?"""
    return nonempty(F.split(t, UNIT_BREAK))


def style_sentences(t: Column) -> Column:
    """Runs up to a terminator that hold a T5 word."""
    return F.filter(found(t, "[^.!?]+[.!?]?"), lambda s: s.rlike(r"[A-Za-z]|\d"))


def card_sentences(t: Column) -> Column:
    """Breaks after . ! ? and white space; wording kept."""
    return nonempty(F.split(t, r"(?U)(?<=[.!?])\s+"))


def terminated_sentences(t: Column) -> Column:
    """Runs that end in one or more terminators; a tail without one is dropped."""
    return nonempty(found(t, "[^.!?]+[.!?]+"))


def complete_sentence_count(t: Column) -> Column:
    """Terminators before white space or the end."""
    return count_of(t, r"(?U)[.!?](?:\s|$)")


# --- paragraphs ------------------------------------------------------------------------------------------------------


def markdown_prose(t: Column, blank_blockquotes: bool = False, strip_bold: bool = False) -> Column:
    """T13 (blockquotes blanked) and T14 (bold unwrapped): fences and headings go, list marks are taken off."""
    t = F.regexp_replace(t, r"```[\s\S]*?```", "\n\n")
    t = F.regexp_replace(t, LINE_BREAKS, "\n")
    if blank_blockquotes:
        t = F.regexp_replace(t, r"(?m)^[^\S\n]*>.*$", "")
    t = F.regexp_replace(t, r"(?m)^[^\S\n]{0,3}#{1,6}[^\S\n]+.*$", "")
    t = F.regexp_replace(t, r"(?m)^[^\S\n]*[-*+][^\S\n]+", "")
    t = F.regexp_replace(t, r"(?m)^[^\S\n]*\d+[.)][^\S\n]+", "")
    return F.regexp_replace(t, r"\*\*([^*\n]+)\*\*", "$1") if strip_bold else t


def paragraphs(t: Column, blank_blockquotes: bool = False, strip_bold: bool = False, separator: str = BLANK_LINE) -> Column:
    """Blocks between blank lines (or another ``separator``), white space collapsed, blank ones dropped."""
    blocks = F.split(markdown_prose(t, blank_blockquotes, strip_bold), separator)
    return nonempty(F.transform(blocks, lambda p: F.regexp_replace(p, r"(?U)\s+", " ")))


def plain_paragraphs(t: Column) -> Column:
    """Blocks between double newlines."""
    return nonempty(F.split(t, "\n\n"))


def style_paragraphs(t: Column, separator: str = BLANK_LINE) -> Column:
    """Blocks between blank lines, no markdown taken off."""
    return nonempty(F.split(strip(t), separator))


# --- smaller pieces --------------------------------------------------------------------------------------------------


def syllables(word: Column) -> Column:
    """Vowel groups; 1 up to three letters; a last e less, a consonant before le more; never under 1."""
    groups = count_of(word, "[aeiouy]+")
    groups = groups - F.when(word.endswith("e") & (groups > 1), 1).otherwise(0)
    groups = groups + F.when(word.rlike("[^aeiouy]le$"), 1).otherwise(0)
    return F.when(F.length(word) <= 3, 1).otherwise(F.greatest(F.lit(1), groups))


def total_syllables(words: Column) -> Column:
    """Sum of T18 over lower-case words without blanks, by four counts over the line of all longer ones.

    Vowel groups, less those of words with an earlier group and a last e, and
    one more for each consonant before a last le and each word without vowels.
    """
    long_ones = F.filter(words, lambda w: F.length(w) > 3)

    def counted(some: Column) -> Column:
        line = F.concat(F.lit(" "), F.array_join(some, "  "), F.lit(" "))
        return numbers.let(line, lambda t: count_of(t, "[aeiouy]+") - count_of(t, "[aeiouy][^aeiouy ][^ ]*e ") + count_of(t, "[^aeiouy ]le ") + count_of(t, " [^aeiouy ]+ "))

    return numbers.let(long_ones, lambda some: F.size(words) - F.size(some) + counted(some))


def normalized(t: Column) -> Column:
    """Lower case, white space collapsed, trimmed."""
    return strip(F.regexp_replace(F.lower(t), r"(?U)\s+", " "))


def char_grams(norm: Column, n: int = 3) -> Column:
    """All n-grams of characters, in order.  The text is split into characters once, so the cost is linear in its length."""
    none = F.array().cast(NO_STRINGS)

    def grams(chars: Column) -> Column:
        all_ = F.transform(chars, lambda c, i: F.concat(c, *[F.coalesce(F.get(chars, i + k), F.lit("")) for k in range(1, n)]))
        return F.when(F.size(chars) >= n, F.slice(all_, 1, F.greatest(F.size(chars) - (n - 1), F.lit(0)))).otherwise(none)

    return numbers.let(F.filter(F.split(norm, ""), lambda c: c != ""), grams)


def word_grams(tokens: Column, n: int) -> Column:
    """Distinct n-grams of words, space-joined."""
    none = F.array().cast(NO_STRINGS)

    def grams(w: Column) -> Column:
        all_ = F.transform(F.sequence(F.lit(1), F.size(w) - (n - 1)), lambda i: F.array_join(F.slice(w, i, n), " "))
        return F.when(F.size(w) >= n, F.array_distinct(all_)).otherwise(none)

    return numbers.let(tokens, grams)


def line_of(t: Column, start: Column) -> Column:
    """1-based line of a 0-based offset."""
    before = F.substring(t, F.lit(1), start)
    return F.length(before) - F.length(F.replace(before, F.lit("\n"), F.lit(""))) + 1


def column_of(t: Column, start: Column) -> Column:
    """1-based column of a 0-based offset."""
    return F.length(F.substring_index(F.substring(t, F.lit(1), start), "\n", -1)) + 1


def context_of(t: Column, start: Column) -> Column:
    """The trimmed line around an offset, cut at 100 characters and '...'."""
    head = F.substring_index(F.substring(t, F.lit(1), start), "\n", -1)
    tail = F.substring_index(F.substring(t, start + 1, F.length(t)), "\n", 1)
    line = strip(F.concat(head, tail))
    return F.when(F.length(line) > 100, F.concat(F.substring(line, 1, 100), F.lit("..."))).otherwise(line)


def english_share(tokens: Column) -> Column:
    """share of T2 tokens that are English function words; 1 without tokens."""
    hits = F.size(F.filter(tokens, lambda w: F.array_contains(words_in(ENGLISH_FUNCTION_WORDS), w)))
    return F.when(F.size(tokens) == 0, F.lit(1.0)).otherwise(hits / F.size(tokens))


def is_english(tokens: Column, threshold: float = 0.10, min_tokens: int = 15) -> Column:
    """under ``min_tokens`` always true."""
    return (F.size(tokens) < min_tokens) | (english_share(tokens) >= threshold)
