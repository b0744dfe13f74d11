"""Phrase and pattern detector (F1, D1-D8): spans per document, gate, containment, summary, packs."""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from itertools import groupby

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions import text
from quillspark.plans.rules import Rule, as_table, catalog, pack_of

SPAN = "array<struct<rule_id:int,start:int,end:int>>"


def _between(t: str, first: str, last: str, one_line: bool = False) -> Iterator[tuple[int, int]]:
    """Places from one mark to the next closing one; ``one_line``: with something between, and no line break."""
    a = t.find(first)
    while a >= 0:
        b = t.find(last, a + len(first))
        if b < 0:
            return
        inner = t[a + len(first) : b]
        if one_line and (not inner or "\n" in inner):
            a = t.find(first, a + 1)
        else:
            yield a, b + len(last)
            a = t.find(first, b + len(last))


def _cited(t: str) -> Iterator[tuple[int, int]]:
    """Lines that begin with the mark of a block quote."""
    a = 0
    while a <= len(t):
        b = t.find("\n", a)
        b = len(t) if b < 0 else b
        if t.startswith(">", a):
            yield a, b
        a = b + 1


def _blanked(t: str, places: Iterator[tuple[int, int]]) -> str:
    out, at = [], 0
    for a, b in places:
        out += [t[at:a], "\n".join(" " * len(line) for line in t[a:b].split("\n"))]
        at = b
    return "".join([*out, t[at:]]) if out else t


def mask(t: str, include_quoted: bool = False) -> str:
    """code, and unless wanted quoted lines and double-quoted spans, blanked at the same length; newlines stay.

    Each kind is sought in what the kinds before it left, so a quotation mark
    in code opens nothing.
    """
    if "`" in t:
        t = _blanked(t, _between(t, "```", "```"))
        t = _blanked(t, _between(t, "`", "`", one_line=True))
    if include_quoted:
        return t
    t = _blanked(t, _cited(t)) if ">" in t else t
    t = _blanked(t, _between(t, '"', '"'))
    return _blanked(t, _between(t, "“", "”"))


def masked(t: Column, include_quoted: bool = False) -> Column:
    """F1 as a column."""

    @F.arrow_udf("string")
    def run(xs: pa.Array) -> pa.Array:
        return pa.array([None if x is None else mask(x, include_quoted) for x in xs.to_pylist()], pa.string())

    return run(t)


def required(pattern: str) -> frozenset[str] | None:
    """Strings (case-folded) one of which every match must hold, or None if there is nothing to go by.

    Read off the parsed pattern: the longest run of literals that stands in
    every match, or the union over alternatives that all have one.
    """
    return _needed(re._parser.parse(pattern, re.IGNORECASE))


def _needed(items) -> frozenset[str] | None:
    best, run = None, ""

    def better(new):
        nonlocal best
        if new and (best is None or min(map(len, new)) > min(map(len, best))):
            best = new

    for op, arg in items:
        name = str(op)
        if name == "LITERAL" and chr(arg).isascii():
            run += chr(arg)
            continue
        better(frozenset({run.casefold()}) if len(run) > 1 else None)
        run = ""
        if name == "SUBPATTERN":
            better(_needed(arg[3]))
        elif name == "BRANCH":
            each = [_needed(x) for x in arg[1]]
            better(frozenset().union(*each) if all(each) else None)
        elif name in ("MAX_REPEAT", "MIN_REPEAT") and arg[0] > 0:
            better(_needed(arg[2]))
    better(frozenset({run.casefold()}) if len(run) > 1 else None)
    return best


class Matcher:
    """All rules over one text: one automaton pass tells which rules can match at all, only those are run."""

    def __init__(self, rules: tuple[Rule, ...]):
        self.rules = [(r.rule_id, re.compile(r.regex, re.IGNORECASE)) for r in rules]
        self.always, keys = [], {}
        for i, r in enumerate(rules):
            needs = frozenset({r.pattern.casefold()}) if r.kind == "phrase" else required(r.regex)
            if not needs:
                self.always.append(i)
            for s in needs or ():
                keys.setdefault(s, []).append(i)
        self.automaton = ahocorasick.Automaton() if keys else None
        for s, rows in keys.items():
            self.automaton.add_word(s, rows)
        if keys:
            self.automaton.make_automaton()

    def spans(self, t: str) -> list[dict]:
        can = set(self.always)
        if self.automaton is not None:
            for _, rows in self.automaton.iter(t.casefold()):
                can.update(rows)
        return [{"rule_id": self.rules[i][0], "start": m.start(), "end": m.end()} for i in sorted(can) for m in self.rules[i][1].finditer(t)]


@lru_cache(8)
def matcher(rules: tuple[Rule, ...]) -> Matcher:
    return Matcher(rules)


def spans(t: Column, rules: list[Rule] | None = None, include_quoted: bool = False) -> Column:
    """Every non-overlapping match of every rule on the masked text, as 0-based half-open code-point spans."""
    fixed = tuple(catalog() if rules is None else rules)
    kind = pa.list_(pa.struct([("rule_id", pa.int32()), ("start", pa.int32()), ("end", pa.int32())]))

    @F.arrow_udf(SPAN)
    def run(xs: pa.Array) -> pa.Array:
        m = matcher(fixed)
        return pa.array([None if x is None else m.spans(mask(x, include_quoted)) for x in xs.to_pylist()], kind)

    return run(t)


def kept(found: list[dict], rules: dict[int, Rule]) -> list[dict]:
    """D3 and D4 of one text: rules with fewer matches than their least go, then spans that a different one encloses.

    Spans of categories with a frequency gate are never enclosed.  One sort by
    (start, longest first), and one pass with the furthest end of earlier
    starts and of this one.
    """
    n = Counter(s["rule_id"] for s in found)
    found = [s for s in found if n[s["rule_id"]] >= rules[s["rule_id"]].min_matches]
    exempt = {r.category for r in rules.values() if r.min_matches > 1}
    out, furthest = [], -1
    for _, same in groupby(sorted(found, key=lambda s: (s["start"], -s["end"])), key=lambda s: s["start"]):
        same = list(same)
        longest = same[0]["end"]
        out += [s for s in same if rules[s["rule_id"]].category in exempt or (furthest < s["end"] and longest == s["end"])]
        furthest = max(furthest, longest)
    return sorted(out, key=lambda s: (s["start"], s["rule_id"], s["end"]))


VIOLATIONS = "array<struct<phrase:string,category:string,severity:string,suggestion:string,line_number:int,column:int,context:string,start:int,end:int,rule_id:int>>"


def _violations(t: str, found: list[dict], rules: dict[int, Rule]) -> list[dict]:
    """Spans with their rule's facts, and line, column and trimmed line (T24) by bisection."""
    lines = [0, *(m.end() for m in re.finditer("\n", t))]
    out = []
    for s in found:
        r, line = rules[s["rule_id"]], bisect_right(lines, s["start"])
        context = t[lines[line - 1] : lines[line] - 1 if line < len(lines) else len(t)].strip()
        out.append(
            {
                "phrase": r.pattern if r.kind == "phrase" else t[s["start"] : s["end"]].lower(),
                "category": r.category,
                "severity": r.severity,
                "suggestion": r.suggestion,
                "line_number": line,
                "column": s["start"] - lines[line - 1] + 1,
                "context": context if len(context) <= 100 else context[:100] + "...",
                **s,
            }
        )
    return out


def violations(t: Column, rules: list[Rule] | None = None, include_quoted: bool = False) -> Column:
    """D1 to D5 as a column, in order of place, then rule: one Arrow function, linear in text and findings."""
    fixed = tuple(catalog() if rules is None else rules)
    text_, int_ = pa.string(), pa.int32()
    kind = pa.list_(pa.struct([(n, text_) for n in ("phrase", "category", "severity", "suggestion")] + [("line_number", int_), ("column", int_), ("context", text_), ("start", int_), ("end", int_), ("rule_id", int_)]))

    @F.arrow_udf(VIOLATIONS)
    def run(xs: pa.Array) -> pa.Array:
        m, by_id = matcher(fixed), {r.rule_id: r for r in fixed}
        return pa.array([None if x is None else _violations(x, kept(m.spans(mask(x, include_quoted)), by_id), by_id) for x in xs.to_pylist()], kind)

    return run(t)


def scan(docs: DataFrame, text_col: str = "text", rules: list[Rule] | None = None, include_quoted: bool = False) -> DataFrame:
    """Add ``violations`` (in order of place, then rule) and ``declined`` to every row; nothing is shuffled.

    Null texts give null.  A text is declined only if it has no violation and
    isn't English.
    """
    t = F.col(text_col)
    rows = docs.withColumn("_v", violations(t, rules, include_quoted))
    declined = (F.size("_v") == 0) & ~text.is_english(text.english_tokens(t))
    return rows.select(*docs.columns, F.col("_v").alias("violations"), F.when(t.isNotNull(), declined).alias("declined"))


def severity_gate(scanned: DataFrame, id_col: str = "doc_id", flags: Column | None = None) -> DataFrame:
    """``id, hard, soft, gate`` over the union of all findings of a text.

    ``scanned`` has ``violations``; ``flags``: further findings of the
    document, an array of structs with ``severity``.  Gate: ``fail`` with a hard
    finding, ``review`` with soft ones only, else ``pass``; null texts pass.
    """
    all_ = F.transform(F.coalesce("violations", F.array().cast(VIOLATIONS)), lambda v: v["severity"])
    if flags is not None:
        all_ = F.concat(all_, F.transform(F.coalesce(flags, F.array().cast("array<struct<severity:string>>")), lambda f: f["severity"]))
    rows = scanned.select(id_col, F.size(F.filter(all_, lambda x: x == "hard")).alias("hard"), F.size(F.filter(all_, lambda x: x == "soft")).alias("soft"))
    return rows.withColumn("gate", F.when(F.col("hard") > 0, "fail").when(F.col("soft") > 0, "review").otherwise("pass"))


# --- the same steps over a span relation ----------------------------------------------------------------------------


def findings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: list[Rule] | None = None, include_quoted: bool = False) -> DataFrame:
    """Spans in long form: ``id, rule_id, category, severity, min_matches, start, end``; the text itself isn't carried."""
    rules = catalog() if rules is None else rules
    found = docs.select(id_col, F.inline_outer(spans(F.col(text_col), rules, include_quoted))).where("rule_id is not null")
    facts = F.broadcast(as_table(docs.sparkSession, rules).select("rule_id", "category", "severity", "min_matches"))  # one row a rule
    return found.join(facts, "rule_id").select(id_col, "rule_id", "category", "severity", "min_matches", "start", "end")


def frequency_gate(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """D3 over a relation."""
    n = F.count("*").over(Window.partitionBy(id_col, "rule_id"))
    return found.withColumn("_n", n).where(F.col("_n") >= F.col("min_matches")).drop("_n")


def containment(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """D4 over a relation with ``start, end, exempt``: adds ``contained``, by two running maxima, never a self-join."""
    earlier = Window.partitionBy(id_col).orderBy("start").rangeBetween(Window.unboundedPreceding, -1)
    beside = Window.partitionBy(id_col, "start")
    inside = (F.coalesce(F.max("end").over(earlier), F.lit(-1)) >= F.col("end")) | (F.max("end").over(beside) > F.col("end"))
    return found.withColumn("contained", inside & ~F.col("exempt"))


def summary(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Totals, by severity and by category, in one pass of grouping sets."""
    sets = found.groupingSets([[id_col], [id_col, "severity"], [id_col, "category"]], id_col, "severity", "category")
    return sets.agg(F.count("*").alias("n"))


def by_pack(found: DataFrame) -> DataFrame:
    """Findings per pack and severity with subtotals."""
    packs = F.broadcast(found.sparkSession.createDataFrame(sorted(pack_of().items()), "category string, pack string"))
    return found.join(packs, "category", "left").rollup("pack", "severity").agg(F.count("*").alias("n"))


def pack_problems(assigned: DataFrame, categories: DataFrame) -> DataFrame:
    """Categories in no pack or in several, and pack entries that no rule has: ``category, problem``.

    ``assigned``: category, pack; ``categories``: category (of the rules).
    """
    used = categories.distinct()
    twice = assigned.groupBy("category").agg(F.count_distinct("pack").alias("n")).where("n > 1").select("category", F.lit("in several packs").alias("problem"))
    loose = used.join(assigned, "category", "left_anti").select("category", F.lit("in no pack").alias("problem"))
    idle = assigned.where(~F.col("category").startswith("macro_")).join(used, "category", "left_anti").select("category", F.lit("without a rule").alias("problem")).distinct()
    return twice.unionByName(loose).unionByName(idle)


# --- counts without spans -------------------------------------------------------------------------------------------


def phrase_counts(docs: DataFrame, phrases: list[Rule], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Matches of literal phrases by document and category: ``id, category, n``; documents without any are left out.

    The automaton reads each text once, whatever the number of phrases.
    """
    fixed = tuple(phrases)
    of = {r.rule_id: r.category for r in fixed}

    @F.arrow_udf("array<struct<category:string,n:bigint>>")
    def run(xs: pa.Array) -> pa.Array:
        m, out = matcher(fixed), []
        for x in xs.to_pylist():
            n = Counter(of[s["rule_id"]] for s in m.spans(x or ""))
            out.append([{"category": c, "n": n[c]} for c in sorted(n)])
        return pa.array(out, pa.list_(pa.struct([("category", pa.string()), ("n", pa.int64())])))

    return docs.select(id_col, F.inline(run(F.col(text_col))))
