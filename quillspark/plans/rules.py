"""The rule catalog: literal phrases and structural patterns, as data.

``catalog`` gives the built-in rules; ``load`` reads further ones from a table.  A rule is literal or a pattern in the dialect that Python
and Java share; patterns are matched without regard to case, ``^`` is the
start of the document unless the pattern says otherwise.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import cache
from importlib.resources import files

from pyspark.sql import DataFrame, SparkSession

RULE_SCHEMA = "rule_id int, kind string, pattern string, category string, severity string, min_matches int, suggestion string"


@dataclass(frozen=True)
class Rule:
    rule_id: int
    kind: str  # phrase or pattern
    pattern: str
    category: str
    severity: str  # hard or soft
    min_matches: int = 1
    suggestion: str | None = None

    @property
    def regex(self) -> str:
        """A literal is guarded only on sides whose edge is a letter or digit."""
        if self.kind == "pattern":
            return self.pattern
        left = "(?<![a-z0-9_-])" if self.pattern[0].isalnum() else ""
        right = "(?![a-z0-9_-])" if self.pattern[-1].isalnum() else ""
        return left + re.escape(self.pattern) + right


# Which rule pack a category belongs to.
PACKS = {
    "pack-phrases-core": """
    academic_excess acknowledgment_loop ai_vocabulary assistant_artifact communication_artifact conclusion_scaffold
    copula_avoidance editorializing emphasis_crutch false_agency false_concession false_range filler filler_opener
    formulaic_challenges generic_conclusion jargon knowledge_cutoff meta novelty_inflation numbered_list_inflation
    performative promotional reader_addressing reader_steering reasoning_chain rhetorical_question rhetorical_setup
    significance_inflation superficial_ing throat_clearing unnecessary_permission vague_attribution vague_endorsement
    """,
    "pack-structure": "macro_both_sidesism macro_redemption_arc macro_preview_recap macro_over_determination macro_emotional_flatness",
    "pack-register-guards": "hedge_stack parenthetical_hedging",
    "pack-voice": """
    anthropomorphic_shipping anti_slop_register binary_contrast colon_reveal contrastive_definition dramatic_fragment
    em_dash_overuse exclamation_overuse formatting fragment_template headline_cadence headline_container_agency
    imperative_slogan negative_listing negative_parallelism numeric_parallelism slogan_fragment spec_fragment
    staccato_fragmentation tool_agency_reflexive tool_agency_volitional
    """,
    "pack-facts": "",
}


def pack_of() -> dict[str, str]:
    return {category: pack for pack, listed in PACKS.items() for category in listed.split()}


@cache
def _built_in() -> tuple[Rule, ...]:
    lines = files("quillspark.plans").joinpath("catalog.tsv").read_text("utf-8").splitlines()
    rows = [line.split("\t") for line in lines[2:]]
    return tuple(Rule(i, kind, pattern, category, severity, int(least), suggestion or None) for i, (kind, category, severity, least, suggestion, pattern) in enumerate(rows))


def catalog() -> list[Rule]:
    """All built-in rules, as ``catalog.tsv`` beside this module has them; rule ids follow its order."""
    return list(_built_in())


def as_table(spark: SparkSession, rules: list[Rule]) -> DataFrame:
    return spark.createDataFrame([(r.rule_id, r.kind, r.pattern, r.category, r.severity, r.min_matches, r.suggestion) for r in rules], RULE_SCHEMA)


def load(table: DataFrame, limit: int = 20_000) -> list[Rule]:
    """Rules from a table with the columns of ``RULE_SCHEMA``; more than ``limit`` rows are refused, as rules go to every worker."""
    rows = table.select("rule_id", "kind", "pattern", "category", "severity", "min_matches", "suggestion").limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"more than {limit} rules")
    return sorted((Rule(*r) for r in rows), key=lambda r: r.rule_id)
