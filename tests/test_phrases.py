from collections import Counter

from quillspark.operators import detect
from quillspark.plans import rules

PHRASES = [r for r in rules.catalog() if r.kind == "phrase"]


def test_all_phrases_of_the_reference_are_built_in():
    assert len({r.pattern for r in PHRASES}) == len(PHRASES) == 313
    assert Counter(r.severity for r in PHRASES) == {"hard": 237, "soft": 76}
    assert len({r.category for r in PHRASES}) == 27
    assert {r.category for r in PHRASES} <= set(rules.pack_of())


def test_phrases_once_left_out_are_found():
    text = "Importantly, analysts predict synergy. We delve deeper, to be honest, into a rich mosaic that will revolutionize it."
    names = {r.rule_id: r.pattern for r in PHRASES}
    found = {names[s["rule_id"]] for s in detect.matcher(tuple(PHRASES)).spans(text)}
    assert {"importantly,", "analysts predict", "synergy", "delve deeper", "to be honest", "rich mosaic", "revolutionize"} <= found
