"""Tool-call linking: links, order, validation and canonical form, with ties, repeats, cycles, nulls and clashing columns."""

import json
import random

import pytest

from tidewalk.llm import tool_calls

PARAMETERS = [("f", "a", "string", True), ("f", "n", "number", False), ("f", "deep", "object", False), ("none", None, None, None)]
CALLS = [
    (1, 1, "x", "f", '{"n": 1, "a": "ü\\n"}', ["y", "y"], "extra"),
    (1, 0, "y", "f", '{"a": "b", "deep": {"z": 1, "b": [true, null]}}', [], None),
    (1, 2, "z", "none", "{}", ["x", "y", "gone"], None),
    (1, 3, "x", "f", '{"a": "again"}', None, None),
    (2, 0, "x", "f", '{"n": "1", "other": 2.5}', ["x"], None),
    (2, 1, "w", "g", "{", ["x"], None),
    (None, 0, "x", "f", None, None, None),
    (3, 0, None, "f", "[1]", ["x"], None),
    (3, 1, "big", "f", '{"a": "' + "long " * 20_000 + '"}', None, None),
]
RESULTS = [(1, 5, "x", "done", 1), (1, 4, "x", "first", 1), (1, 6, "nobody", None, 1), (None, 1, "x", "null conv", 1), (3, 1, None, "lost", 1)]


@pytest.fixture(scope="module")
def tables(spark):
    calls = spark.createDataFrame(CALLS, "conv_id long, turn int, call_id string, name string, arguments string, depends_on array<string>, layer string")
    results = spark.createDataFrame(RESULTS, "conv_id long, turn int, call_id string, content string, salt int")
    return calls, results, spark.createDataFrame(PARAMETERS, "name string, parameter string, type string, required boolean")


def test_links_order_and_validation(tables):
    rows = {(r.conv_id, r.turn, r.call_id): r for r in tool_calls.link_tool_calls(*tables).collect()}
    assert len(rows) == len(CALLS) + 1
    x, y, z = rows[1, 1, "x"], rows[1, 0, "y"], rows[1, 2, "z"]
    assert (y.layer, x.layer, z.layer) == (0, 1, 2)
    assert x.status == "linked" and x.result_turn == 4 and y.status == "pending" and rows[1, 3, "x"].status == "repeated"
    assert x.problems == [] and z.problems == ["unknown dependency gone"]
    assert rows[2, 0, "x"].status == rows[2, 1, "w"].status == "cyclic" and rows[2, 0, "x"].layer is None
    assert rows[2, 0, "x"].problems == ["missing a", "unknown other", "wrong type n"] and rows[2, 1, "w"].problems == ["unknown tool"]
    assert rows[None, 0, "x"].status == "linked" and rows[None, 0, "x"].problems == ["arguments are no object"] and rows[3, 0, None].problems == ["arguments are no object"]
    assert rows[3, 0, None].status == "pending" and rows[3, 1, "big"].problems == [] and rows[1, None, "nobody"].status == "orphan"


def test_canonical_json(tables):
    rows = {(r.conv_id, r.turn): r.json for r in tool_calls.link_tool_calls(*tables).collect()}
    want = {"arguments": {"a": "ü\n", "n": 1}, "call_id": "x", "conv_id": 1, "depends_on": ["y"], "name": "f", "result": "first", "turn": 1}
    assert rows[1, 1] == json.dumps(want, ensure_ascii=False, sort_keys=True, separators=(",", ":"))
    assert '"deep":{"b":[true,null],"z":1}' in rows[1, 0] and '"result":null' in rows[1, 0]
    assert json.loads(rows[2, 1])["arguments"] is None


def _layers(edges, calls):
    known, out = {c: set(e for e in edges.get(c, ()) if e in calls) for c in calls}, {}
    while ready := [c for c in known if c not in out and known[c] <= set(out)]:
        out |= {c: 1 + max((out[p] for p in known[c]), default=-1) for c in ready}
    return out


def test_layers_of_long_chains_and_forks(spark, monkeypatch):
    r, rows, want, rounds = random.Random(2), [], {}, []
    graphs = [{f"c{k}": [f"c{k - 1}"] * (k > 0) for k in range(1000)}]  # a chain
    graphs.append({f"d{k}": [f"d{k // 3 * 3 - j}" for j in (1, 2, 3)] * (k > 2) for k in range(300)})  # three side by side
    graphs.append({f"e{k}": r.sample([f"e{j}" for j in range(k)], min(k, 2)) + ["gone"] for k in range(40)})
    graphs.append({f"f{k}": [f"f{(k + 1) % 5}"] if k < 5 else [f"f{k - 1}", "f9"] for k in range(12)})  # a cycle and what is behind it
    for conv, graph in enumerate(graphs):
        rows += [(conv, k, c, "f", "{}", deps) for k, (c, deps) in enumerate(graph.items())]
        want |= {(f"={conv}", c): n for c, n in _layers(graph, set(graph)).items()}
    calls = spark.createDataFrame(rows, "conv_id long, turn int, call_id string, name string, arguments string, depends_on array<string>")
    kept = tool_calls.cut
    monkeypatch.setattr(tool_calls, "cut", lambda df, name: rounds.append(name) or kept(df, name))
    got = {(x["_conv"], x.call_id): x.layer for x in tool_calls.layers(tool_calls._keyed(calls)).collect()}
    assert got == want and max(got.values()) == 999 and len(rounds) < 30


def test_nested_parameters_and_allowed_values(spark):
    rows = [("f", "where", "object", True, None), ("f", "where.city", "string", True, None), ("f", "where.zone", "integer", False, None), ("f", "unit", "string", False, ["c", "f"]), ("f", "n", "number", False, ["1", "2"]), ("g", "a", "object", False, None), ("g", "a.b", "object", False, None), ("g", "a.b.c", "boolean", True, None)]
    parameters = spark.createDataFrame(rows, "name string, parameter string, type string, required boolean, allowed array<string>")
    cases = [
        ("f", '{"where": {"city": "x", "zone": 3}, "unit": "c", "n": 1}', []),
        ("f", '{"where": {"zone": "3", "more": 1}, "unit": "k", "n": 3}', ["missing where.city", "not allowed n", "not allowed unit", "unknown where.more", "wrong type where.zone"]),
        ("f", '{"where": "here"}', ["missing where.city", "wrong type where"]),
        ("f", '{"unit": null}', ["missing where", "wrong type unit"]),
        ("g", '{"a": {"b": {}}}', ["missing a.b.c"]),
        ("g", '{"a": {}}', []),
        ("g", '{"a": {"b": {"c": 1, "it\'s": 2}}}', ["unknown a.b.it's", "wrong type a.b.c"]),
    ]
    calls = spark.createDataFrame([(k, 0, "x", name, text, []) for k, (name, text, _) in enumerate(cases)], "conv_id long, turn int, call_id string, name string, arguments string, depends_on array<string>")
    results = spark.createDataFrame([], "conv_id long, turn int, call_id string, content string")
    got = {r.conv_id: r.problems for r in tool_calls.link_tool_calls(calls, results, parameters).collect()}
    assert [got[k] for k in range(len(cases))] == [p for _, _, p in cases]


def test_empty(spark, tables):
    calls, results, parameters = tables
    assert tool_calls.link_tool_calls(calls.filter("false"), results.filter("false"), parameters.filter("false")).count() == 0
    assert {r.status for r in tool_calls.link_tool_calls(calls.filter("false"), results, parameters).collect()} == {"orphan"}
    assert tool_calls.link_tool_calls(calls, results, parameters.filter("false")).filter("array_contains(problems, 'unknown tool')").count() == len(CALLS)


def test_no_python_in_the_plan(tables):
    plan = tool_calls.link_tool_calls(*tables)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan


def test_names_and_repeated_parameters(spark):
    """Repeated and conflicting rows of parameters; quotes, brackets, dots and empty strings in names."""
    rules = [("f", "it's", "integer", True, None), ("f", "it's", "integer", True, None), ("f", 'q"]', "string", False, ["u"]), ("f", "", "string", False, None), ("f", "a", "object", False, None), ("f", "a.b", "integer", False, None), ("f", "a.c d", "string", True, None), ("f", "twice", "string", False, None), ("f", "twice", "integer", False, None)]
    arguments = [{"it's": 1}, {"it's": "x", 'q"]': "u", "": 1}, {"it's": 1, 'q"]': "v", "$": 2}, {"it's": 1, "a.b": 1}, {"it's": 1, "a": {"b": "x", "c d": "y"}, "a.b": 1}, {"it's": 1, "a": {"b": 1}, "twice": 1}, {"it's": 1, "a": {"c d": "", "e.f": 0}, "twice": "s"}]
    want = [[], ["wrong type ", "wrong type it's"], ["not allowed q\"]", "unknown $"], ["unknown a.b"], ["unknown a.b", "wrong type a.b"], ["missing a.c d"], ["unknown a.e.f", "wrong type twice"]]
    calls = spark.createDataFrame([(1, k, f"c{k}", "f", json.dumps(x), None) for k, x in enumerate(arguments)] + [(1, 100 + k, None, "f", "{}", None) for k in range(5)], "conv_id long, turn int, call_id string, name string, arguments string, depends_on array<string>")
    results = spark.createDataFrame([], "conv_id long, turn int, call_id string, content string")
    parameters = spark.createDataFrame(rules, "name string, parameter string, type string, required boolean, allowed array<string>")
    rows = {r.turn: r for r in tool_calls.link_tool_calls(calls, results, parameters).collect()}
    assert [rows[k].problems for k in range(len(want))] == want
    assert all(rows[100 + k].problems == ["missing it's"] and rows[100 + k].status == "pending" for k in range(5))
