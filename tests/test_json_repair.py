"""Repair of JSON: every prefix of whole answers, loose ones of many kinds, and no text that breaks it."""

import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from caseweave.functions.json_repair import repaired
from caseweave.operators.records import extracted

SCALAR = st.none() | st.booleans() | st.integers(-(10**6), 10**6) | st.floats(allow_nan=False, allow_infinity=False) | st.text(max_size=12)
EVENT = st.dictionaries(st.text(max_size=6), SCALAR | st.lists(SCALAR, max_size=3) | st.dictionaries(st.text(max_size=3), SCALAR, max_size=2), max_size=4)


@settings(max_examples=60, deadline=None)
@given(st.lists(EVENT, max_size=4), st.booleans(), st.sampled_from([None, 1]))
def test_every_prefix_gives_the_whole_objects_before_the_cut(events, plain, indent):
    text = json.dumps({"events": events}, ensure_ascii=plain, indent=indent)
    ends, decoder = [], json.JSONDecoder()
    at = text.index("[") + 1
    for _ in events:
        while text[at] in " \n,":
            at += 1
        _, at = decoder.raw_decode(text, at)
        ends.append(at)
    for cut in range(1, len(text) + 1):
        found = json.loads(repaired(text[:cut]))
        whole = sum(e <= cut for e in ends)
        got = found.get("events") or []
        assert got[:whole] == events[:whole] and len(got) <= whole + 1


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="{}[]\"'“,:\\/*un 1-.etrfalsN\n", max_size=40) | st.text(max_size=40))
def test_any_text_gives_json_or_nothing(text):
    found = repaired(text)
    if found is not None:
        json.loads(found)


LOOSE = [
    ('{"a": 1, "b": [1, 2,],}', {"a": 1, "b": [1, 2]}),
    ("{'a': 'it''s', b: True, c: None, d: NaN}", {"a": "it", "s": None, "b": True, "c": None, "d": None}),
    ('{"a": "il "grande" caso", "b": 2}', {"a": 'il "grande" caso', "b": 2}),
    ('{"a": 1 "b": "x" "c": [1 2 "z"]}', {"a": 1, "b": "x", "c": ["1 2", "z"]}),
    ('{"a": "line\nbreak\ttab"}', {"a": "line\nbreak\ttab"}),
    ('Ecco il risultato:\n```json\n{"a": [1]}\n```\nfine', {"a": [1]}),
    ('{"events": [{"a": 1}, {"a": 2}}', {"events": [{"a": 1}, {"a": 2}]}),
    ('{"events": [{"a": 1 {"a": 2}]}', {"events": [{"a": 1}, {"a": 2}]}),
    ('{"a": // why\n 1, /* so */ "b": 2}', {"a": 1, "b": 2}),
    ('{"a": "cut \\u12', {"a": "cut "}),
    ('{"a": "cut \\', {"a": "cut "}),
    ('{"a": "\\ud83d', {"a": ""}),
    ('{"a": "C:\\dir \\x"}', {"a": "C:dir x"}),
    ('{"a": tru', {"a": True}),
    ('{"a": 12.', {"a": 12}),
    ('{"a": -', {"a": None}),
    ('{"a"', {"a": None}),
    ('{"a":', {"a": None}),
    ('{"a" 1}', {"a": 1}),
    ("{“a”: “b”}", {"a": "b"}),
    ('[{"a": 1}, {"a": 2}', [{"a": 1}, {"a": 2}]),
    ('{"a": 1}} trailing', {"a": 1}),
    ("{2024: x y, n: 1}", {"2024": "x y", "n": 1}),
]


@pytest.mark.parametrize("text, want", LOOSE)
def test_loose_answers(text, want):
    assert json.loads(repaired(text)) == want


def test_texts_without_brackets_and_long_ones():
    assert repaired(None) is None and repaired("no json") is None and repaired("") is None
    text = '{"events": [' + '{"title": "a \\" b", "n": [1, 2, {"x": null}]}, ' * 20000
    assert len(json.loads(repaired(text))["events"]) == 20000
    assert json.loads(repaired("[" * 900)) is not None


def test_broken_answers_give_their_events(spark):
    rows = [(1, '{"events": [{"title": "a",}, {"title": "b" "description": "c"'), (2, "```json\n{'eventi': [{'title': 'd'}]}\n```"), (3, '{"events": [{"title": "e"}]}'), (4, "none"), (5, None), (6, "")]
    found = extracted(spark.createDataFrame(rows, "id long, raw string"), "id", "raw").collect()
    assert sorted((r.id, r.number, r.title) for r in found) == [(1, 0, "a"), (1, 1, "b"), (2, 0, "d"), (3, 0, "e")]
