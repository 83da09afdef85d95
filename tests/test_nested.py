import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from citeloom.operators import nested
from citeloom.plans.p_core import CITATION, TRACES


def rows(spark, values, shape=TRACES):
    df = spark.createDataFrame([(str(i), v) for i, v in enumerate(values)], "id string, j string")
    found = nested.nodes(df, "id", "j", shape)
    return found, found.collect()


def test_every_shape_of_a_list(spark):
    t = {"agent_type": "A", "retrieved_metadata": {"authors": ["x", None, " "]}, "evidence_snippets": "lone"}
    forms = [[t, None], t, {"traces": [t]}, {"10": t, "9": {"evidence_snippets": []}}, json.dumps([t])]
    found, got = rows(spark, [json.dumps(f) for f in forms] + [None, "", "  ", "{bad", "{}", "null"])
    traces = sorted((r["id"], r["position"], r["empty"]) for r in got if r["kind"] == "trace")
    assert traces == [("0", 1, False), ("0", 2, True), ("1", 1, False), ("2", 1, False), ("3", 1, False), ("3", 2, False), ("4", 1, False)]
    authors = [(r["position"], r["empty"]) for r in got if r["kind"] == "trace_author" and r["id"] == "0"]
    assert sorted(authors) == [(1, False), (2, True), (3, True)]
    linked = nested.link(found.where("kind = 'trace'"), found.where("kind = 'trace_author'"), "id", "trace_no")
    assert {(r["id"], r["trace_no"]) for r in linked.collect()} == {("0", 1), ("1", 1), ("2", 1), ("3", 2), ("4", 1)}


def test_intervals_nest_and_never_cross(spark):
    v = [{"retrieved_metadata": {"authors": ["a", "b"]}, "evidence_snippets": [{"text": "s", "rank": 0}], "more": {"deep": [[1, {"k": 2}]]}}] * 3
    _, got = rows(spark, [json.dumps(v)])
    spans = [(r["pre"], r["post"]) for r in got]
    assert all(a < b for a, b in spans) and len({x for s in spans for x in s}) == 2 * len(spans)
    for a, b in spans:
        for c, d in spans:
            assert b < c or d < a or (a <= c and d <= b) or (c <= a and b <= d)


def test_paths_and_very_long_values(spark):
    _, got = rows(spark, [json.dumps({"authors": ["n" * 200_000]}), json.dumps({"authors": "one"}), json.dumps({"authors": []}), "[]"], CITATION)
    assert sorted((r["id"], r["position"], len(r["value"])) for r in got) == [("0", 1, 200_000), ("1", 1, 3)]
    assert rows(spark, [])[1] == []


def test_a_hundred_thousand_levels(spark):
    n = 100_000
    deep = "[" * n + "]" * n
    chain = '{"k": ' * n + "1" + "}" * n
    wrapped = '{"traces": ' * n + '[{"agent_type": "A", "retrieved_metadata": {"authors": ["x", ' + deep + "]}}]" + "}" * n
    texts = "[null]"
    for _ in range(12):
        texts = json.dumps(texts)
    found, got = rows(spark, [deep, f"[{chain}]", wrapped, texts, deep[:-1], f"[1]{deep}"])
    by = lambda i, kind: [(r["position"], r["empty"]) for r in got if r["id"] == i and r["kind"] == kind]
    assert by("0", "trace") == [(1, False)] and by("1", "trace") == [(1, False)] and by("2", "trace") == [(1, False)] and by("3", "trace") == [(1, True)]
    assert sorted(by("2", "trace_author")) == [(1, False), (2, False)] and not by("4", "trace") and not by("5", "trace")
    assert {len(r["value"]) for r in got if r["id"] == "0"} == {2 * n - 2}
    assert all(0 < r["pre"] < r["post"] for r in got)


def test_lists_that_are_columns_already(spark):
    lists = [["a", None, " ", "\u00a0", "b"], [], None, [None]]
    df = spark.createDataFrame([(str(i), v) for i, v in enumerate(lists)], "id string, authors array<string>")
    ours = {tuple(r) for r in nested.list_nodes(df, "id", "authors", "citation_author").collect()}
    _, want = rows(spark, [json.dumps({"authors": v}) for v in lists], CITATION)
    assert ours == {tuple(r) for r in want} and len(ours) == 6


JSON = st.recursive(st.none() | st.booleans() | st.integers() | st.floats(allow_nan=False) | st.text(), lambda c: st.lists(c) | st.dictionaries(st.text(), c), max_leaves=30)


@settings(max_examples=150, deadline=None)
@given(JSON)
def test_own_parser_and_writer_agree_with_the_library(v):
    text = json.dumps(v, ensure_ascii=False)
    assert nested.parsed(text) == v and nested.written(v) == text and nested.parsed(json.dumps(v, indent=1)) == v


@pytest.mark.parametrize("bad", ["", "[", "]", "[1,]", "{,}", '{"a"}', '{"a":}', '{"a":1,}', "[1 2]", "1 2", '{"a":1', '"x', "[}", "{]", "tru", "[,1]", '{1:2}'])
def test_own_parser_refuses_what_the_library_refuses(bad):
    for f in (nested.parsed, json.loads):
        with pytest.raises(ValueError):
            f(bad)
