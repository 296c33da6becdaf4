"""Validators, projections and text functions on small cases."""

import pytest
from pyspark.sql import functions as F

from quarrymill.functions import text as X
from quarrymill.operators import projections as P
from quarrymill.operators import validation as V
from tests.conftest import message, rows

U, S = message("user", "hi"), message("system", "s")
A = message("assistant", "yes")


@pytest.mark.parametrize("messages,error", [
    ([S, U, A], None), ([U, A, U], None), (None, "conversations must be a non-empty list"), ([], "conversations must be a non-empty list"), ([S], "conversation has no user message"),
    ([A], "message 0 expected role 'user', got 'assistant'"), ([U, U], "message 1 expected role 'assistant', got 'user'"), ([U, message("assistant", " ")], "message 1 content must be a non-empty string"),
    ([U, None], "message 1 must be an object"), ([U, A, S], "message 2 has unsupported role 'system'"), ([U, message("tool", "x")], "message 1 has unsupported role 'tool'"), ([message(None, "x")], "message 0 has unsupported role None"),
])
def test_conversation_errors(conversations, messages, error):
    assert conversations([("a", messages)]).select(V.conversation_error(F.col("conversations"))).first()[0] == error


def test_regeneration_wording(conversations):
    df = conversations([("a", [A]), ("b", [U, U])])
    assert rows(df.select("id", V.conversation_error(F.col("conversations"), "regeneration"))) == [("a", "Data starts with an assistant message"), ("b", "Invalid conversation role order at position 1: expected assistant, got user")]


def test_row_policies_and_summary(conversations):
    think = message("assistant", "<think>x</think>y")
    df = conversations([("a", [U, A]), ("a", [U, A]), ("b", [U]), ("c", [U, message("assistant", "y", "because")]), ("d", [U, think]), ("", [U, A])])
    get = lambda **k: [r[0] for r in df.select(V.row_error(**k)).collect()]
    assert get() == [None, None, "conversation has no assistant message", None, None, "id must be a non-empty string"]
    assert get(reasoning="forbidden")[3] == "assistant message 1 has non-empty reasoning_content"
    assert get(reasoning="required")[0] == "assistant message 1 has empty reasoning_content"
    assert get(strict_markers=True)[4] == "assistant message 1 contains a thinking marker"
    assert tuple(V.validation_summary(df).first()) == (6, 4, 4, 1)


def test_sanitize(conversations):
    df = conversations([("a", [message("system", " "), U, message("assistant", ""), A]), ("b", [message("user", None)]), ("c", [message("user", " <image> ")]), ("d", None)])
    got = {r.id: (r.n, r.reason) for r in df.select("id", V.sanitized(F.col("conversations")).alias("s")).select("id", F.size("s.kept").alias("n"), "s.reason").collect()}
    assert got["a"] == (2, None) and got["b"][1] == "User turn has no text" and got["c"][1] == "User turn is empty apart from the image placeholder" and got["d"][1] is None


def test_reject_reasons(conversations):
    long = "word " * 30
    df = conversations([("a", [U]), ("b", [U, message("assistant", None)]), ("c", [message("user", long), message("assistant", long)]), ("d", [U, message("assistant", "abcd" * 1600)]), ("e", [U, A])])
    got = [r[0] for r in df.select(V.answer_reject_reason(F.col("conversations"), F.lit(False), F.lit(None).cast("string"))).collect()]
    assert got == ["no assistant turn", "empty answer", "answer repeats the prompt", "degenerate repetition", None]


def test_require_raises(conversations):
    df = V.require(conversations([("a", [A])]), V.conversation_error(F.col("conversations")))
    with pytest.raises(Exception, match="expected role"):
        df.collect()


def test_sharegpt_drops_and_counts(spark):
    df = spark.createDataFrame([(1, [("system", "s"), ("human", "q"), ("gpt", "a"), ("user", "x")])], "id BIGINT, conversations ARRAY<STRUCT<`from`: STRING, value: STRING>>")
    r = P.sharegpt(df).first()
    assert r.skipped == 2 and [m.role for m in r.conversations] == ["user", "assistant"] and r.id == "1"


def test_events_and_pairs(conversations):
    df = conversations([("a", [S, U, message("assistant", "r1", "t1"), U, message("assistant", "r2", "t2")])])
    e = {r.event_id: r for r in P.generation_events(df).collect()}
    assert set(e) == {"a#turn0", "a#turn1"} and [m.reasoning_content for m in e["a#turn1"].conversations] == [None, None, None, None, "t2"]
    assert tuple(conversations([("a", [A, U, U, A, U])]).select(P.pair_counts(F.col("conversations")).alias("p")).select("p.*").first()) == (1, 2, 1)
    assert rows(P.turn_pairs(df), "pair", "answer") == [(0, "r1"), (1, "r2")]


def test_paths_and_parts(spark):
    df = spark.createDataFrame([("/x/a/1.png",), ("/x/ab/2.png",), (None,)], "p STRING")
    assert P.common_root(df, "p").first()[0] == "/x"
    assert [r[0] for r in df.select(P.rebased(F.col("p"), "/x/a", "/y")).collect()] == ["/y/1.png", None, None]
    parts = spark.createDataFrame([("a <image> b",)], "t STRING").select(X.image_parts(F.col("t"))).first()[0]
    assert [(p.type, p.text) for p in parts] == [("text", "a"), ("image", ""), ("text", "b")]


def test_channels(spark):
    t = "<|channel|>analysis<|message|>why<|end|><|channel|>final<|message|>so<|return|>"
    got = spark.createDataFrame([(t,), ("plain",)], "t STRING").select(P.channel_messages(F.col("t"))).collect()
    assert [tuple(x) for x in got[0][0]] == [("analysis", "why"), ("final", "so")] and [tuple(x) for x in got[1][0]] == [("text", "plain")]


def test_phrases_and_suffix(spark):
    df = spark.createDataFrame([("Q?\nAnswer briefly.\n\n\n\nx",)], "t STRING")
    assert df.select(X.strip_phrases(F.col("t"), ["Answer briefly."])).first()[0] == "Q?\n\n\nx".replace("\n\n\n", "\n\n")
    once = df.select(X.append_once(F.lit("q"), "think").alias("t"))
    assert once.select(X.append_once(F.col("t"), "think")).first()[0] == "q\nthink"


def test_functions_on_nulls(spark):
    df = spark.createDataFrame([(None,), ("",), (" ",)], "t STRING")
    r = df.select(X.is_blank(F.col("t")), X.word_count(F.col("t")), X.is_degenerate(F.col("t")), X.has_think_marker(F.col("t"))).collect()
    assert [x[0] for x in r] == [True, True, True] and [x[3] for x in r] == [False, False, False]
