"""The nested-record operator against hand-made shapes, clashing columns and empty tables."""

import json

from pyspark.sql import functions as F

from quarrymill.operators import nested
from tests.conftest import call, message, rows, tool

LINES = "shard STRING, line_no BIGINT, line STRING"


def line_rows(*lines):
    return [("s", i, x if x is None or isinstance(x, str) else json.dumps(x)) for i, x in enumerate(lines)]


def test_typed_calls_and_tools(spark, conversations):
    c = conversations([
        ("a#1", [message("user", "q"), message("assistant", "", calls=[call("k1", "f"), call(None, "g"), call("k3", None), None])], [tool("g"), tool("f"), tool("f"), tool(None)]),
        ("a#1", [message("user", "q"), message("assistant", "", calls=[call("k1", "f"), call(None, "g"), call("k3", None), None])], [tool("g"), tool("f"), tool("f"), tool(None)]),
        ("a#2", None, None), ("a#3", [], []), (None, [message("assistant", "x", calls=[call("k", "f")])], None), ("a#4", [None, message("assistant", None, calls=[call("z", "h")])], None),
    ])
    got = rows(nested.items(c, spark.createDataFrame([], LINES)), "rec_id", "kind", "msg_pos", "item_pos", "item_key", "tool_pos")
    assert got == sorted([
        ("a#1", "call", 1, 0, "k1", 1), ("a#1", "call", 1, 1, "", 0), ("a#1", "call", 1, 2, "k3", -1), ("a#4", "call", 1, 0, "z", -1),
        ("a#1", "tool", -1, 0, "g", 0), ("a#1", "tool", -1, 1, "f", 1), ("a#1", "tool", -1, 2, "f", 2), ("a#1", "tool", -1, 3, "", 3),
    ])


def test_raw_wrappings(spark, conversations):
    k = lambda i, n: {"id": i, "type": "function", "function": {"name": n, "arguments": {}}}
    t = {"type": "function", "function": {"name": "f"}}
    raw = spark.createDataFrame(
        line_rows(
            {"id": 7, "messages": [{"role": "assistant", "tool_calls": [[k("a", "f")], [k("b", "g")]]}], "tools": json.dumps([t])},
            {"conversations": [{"from": "gpt", "value": "", "tool_calls": json.dumps([k("c", "f")])}], "tools": [{"name": "f"}, {"description": "none"}]},
            json.dumps(json.dumps({"id": "x", "messages": [{"role": "assistant", "tool_calls": k("d", None)}]})),
            {"id": "y", "messages": [{"role": "assistant", "tool_calls": '[{"id": "e", '}], "tools": "[{"},
            '{"id": "cut", "messages": [', "null", "[]", "", "   ", None,
            {"id": 7, "messages": [{"role": "assistant", "tool_calls": [[k("a", "f")], [k("b", "g")]]}], "tools": json.dumps([t])},
        ),
        LINES,
    )
    got = rows(nested.items(conversations([]), raw), "rec_id", "kind", "msg_pos", "item_pos", "item_key", "tool_pos")
    assert got == sorted([
        ("7", "call", 0, 0, "a", 0), ("7", "call", 0, 1, "b", -1), ("7", "tool", -1, 0, "f", 0), ("s:1", "call", 0, 0, "c", 0), ("s:1", "tool", -1, 0, "f", 0), ("s:1", "tool", -1, 1, "", 1), ("x", "call", 0, 0, "d", -1),
    ])


def test_extra_clashing_columns_and_long_texts(spark, conversations):
    c = conversations([("a", [message("assistant", "x" * 200_000, calls=[call("k", "f")])], [tool("f")])]).withColumn("rec_id", F.lit(1)).withColumn("kind", F.lit("z")).withColumn("names", F.lit(0))
    raw = spark.createDataFrame(line_rows({"id": "b", "messages": [{"role": "user", "content": "y" * 300_000}], "tools": [{"name": "g"}]}), LINES).withColumn("kind", F.lit("q"))
    assert nested.items(c, raw).count() == 3
    flat = nested.flat_tables(c, raw)
    assert rows(flat["records"]) == [("a",), ("b",)]
    assert rows(flat["messages"].select("rec_id", F.length("content"))) == [("a", 200_000), ("b", 300_000)]


def test_generic_shredding_keeps_links(spark, conversations):
    c = conversations([("a", [message("user", "q"), None, message("assistant", "r", calls=[call("k", "f")])], [tool("f")])]).select("id", "conversations", "tools")
    assert nested.repeated_paths(c.schema) == ["conversations", "conversations.tool_calls", "tools"]
    flat = nested.shred(c, "id")
    assert rows(flat["conversations"], "id", "pos_0", "role") [0] == ("a", 0, "user")
    assert flat["conversations"].count() == 3
    assert rows(flat["conversations.tool_calls"], "id", "pos_0", "pos_1", "function_name") == [("a", 2, 0, "f")]


def test_empty_tables(spark, conversations):
    assert nested.items(conversations([]), spark.createDataFrame([], LINES)).count() == 0


def test_triples_of_any_record():
    """The scanner knows no key: paths, ordinals and values of a record in no layout at all."""
    found = nested.triples('{"a": {"b": [1, {"c": null}, [2.5]], "b": [true, {"c": "x"}]}, "e": {}, "f": []}', nested.Layout({}))
    leaves = [(p, o, v) for p, o, v in found if not isinstance(v, nested.Whole)]
    assert leaves == [("a.b[]", (0,), True), ("a.b[].c", (1,), "x")]
    assert [(p, nested.text_of(v)) for p, o, v in found if isinstance(v, nested.Whole) and not o] == [("a.b", '[true, {"c": "x"}]'), ("a", '{"b": [true, {"c": "x"}]}'), ("e", "{}"), ("f", "[]")]
    for broken in ("", "{", "[1]", '{"a": 1,}', '{"a" 1}', '{"a": tru}', '{"a": 1} x', '"{"', "{" * 5000, '{"a": "\x01"}'):
        assert nested.triples(broken, nested.Layout({})) is None
    groups = nested.pivot(nested.triples('{"x": [{"y": [{"z": 1}, {"z": 2}]}, {"y": []}]}', nested.Layout({})))
    assert {k: v["z"] for k, v in groups["x[].y[]"].items()} == {(0, 0): 1, (0, 1): 2} and list(groups["x[]"]) == [(0,), (1,)]


def test_scanner_reads_what_the_parser_reads():
    import random

    rng = random.Random(5)

    def value(depth):
        kind = rng.randrange(8)
        if depth == 0 or kind < 4:
            return rng.choice([None, True, -3, 2.5e-7, "", "é\n\"x", "{", 10**30])
        return [value(depth - 1) for _ in range(rng.randrange(4))] if kind < 6 else {rng.choice("abcd"): value(depth - 1) for _ in range(rng.randrange(4))}

    def leaves(v, path=""):
        if isinstance(v, dict):
            return [x for k, y in v.items() for x in leaves(y, f"{path}.{k}" if path else k)]
        return [x for y in v for x in leaves(y, path + "[]")] if isinstance(v, list) else [(path, v)]

    for _ in range(300):
        record = {"r": value(4), "s": value(3)}
        text = json.dumps(record, indent=rng.choice([None, 2]))
        got = [(p, v) for p, _, v in nested.triples(text, nested.Layout({})) if not isinstance(v, nested.Whole)]
        assert list(map(repr, leaves(record))) == list(map(repr, got))
        cut = text[: rng.randrange(len(text))]
        assert nested.triples(cut, nested.Layout({})) is None
