"""Gates, prompts and program-backed scores on small cases."""

import pytest
from pyspark.sql import functions as F

from quarrymill.functions import python_scores as PS
from quarrymill.operators import gates as G
from quarrymill.operators import prompts as P
from tests.conftest import message, rows


def test_sequence_errors(spark):
    df = spark.createDataFrame([([1, 2], [0, 1]), ([], []), ([1], [2]), ([1, 2], [1]), ([-1], [1]), (None, None), ([None], [1])], "t ARRAY<INT>, m ARRAY<INT>")
    assert [r[0] for r in df.select(G.sequence_error(F.col("t"), F.col("m"))).collect()] == [None, "empty sequence", "mask entry not 0 or 1", "mask of another length", "negative id", "empty sequence", "null entry"]


def test_candidates(conversations, spark):
    df = conversations([("a", [message("user", "q"), message("assistant", "r")]), ("b", [message("user", "q"), message("assistant", "r", "why")]), ("c", [message("user", "q")]), ("d", None)])
    assert rows(G.single_turn(df), "id") == [("a",), ("b",)] and rows(G.single_turn(df, "required"), "id") == [("b",)] and rows(G.single_turn(df, "forbidden"), "id") == [("a",)]
    s = spark.createDataFrame([(1, [1, 2], [0, 1]), (2, [1, 2, 3], [1, 1, 1]), (3, [1, 2], [1, 1])], "k INT, tokens ARRAY<INT>, mask ARRAY<INT>")
    assert G.first_qualifying(s, "k", least=2).first().k == 2 and G.first_qualifying(s, "k", least=2, longest=2).first().k == 3


def test_gates(spark):
    m = spark.createDataFrame([(1.0, 0.5), (3.0, None)], "loss DOUBLE, acc DOUBLE")
    assert [r.errors for r in G.threshold_errors(m, {"acc": 0.4}, {"loss": 2}).collect()] == [None, "acc below 0.4: missing; loss above 2: 3.0"]
    j = spark.createDataFrame([("scored",), ("missing",), ("text",)], "status STRING")
    assert tuple(G.unscored_level(j, 0.2).first()) == (2, 1, 0.5, "error")
    h = "STRUCT<role: STRING, content: STRING, reasoning_content: STRING>"
    v = spark.createDataFrame([(4.0, [1, 2], [1, 2], [("assistant", "x", None)]), (1.0, [1, 2], [1, 3], [("assistant", "x", "t")])], f"accept_length DOUBLE, expected ARRAY<INT>, got ARRAY<INT>, history ARRAY<{h}>")
    assert [len(r.errors) for r in G.serving_errors(v, 2).collect()] == [0, 3]
    ev = spark.createDataFrame([("a", 1, "leased"), ("a", 2, "failed"), ("a", 3, "leased"), ("a", 4, "failed"), ("b", 1, "leased"), ("b", 2, "done"), ("c", 1, "leased")], "task_id STRING, at INT, kind STRING")
    assert rows(G.lease_outcomes(ev, 2), "task_id", "outcome") == [("a", "exhausted"), ("b", "done"), ("c", "pending")]
    log = spark.createDataFrame([("s", 1, "put", 1, 5), ("s", 2, "release", 1, 0), ("s", 3, "put", 2, 7), ("t", 1, "put", 1, 9), ("t", 2, "release", 1, 0)], "sample_id STRING, at INT, op STRING, generation INT, bytes BIGINT")
    assert rows(G.stored_features(log, 6), "sample_id", "generation", "state", "over_budget") == [("s", 2, "held", True), ("t", 1, "released", True)]
    assert G.horizon(1000, 4, 3, 8, 2) == {"batches_per_epoch": 31, "steps_per_epoch": 10, "steps": 20, "dropped_batches": 2}
    with pytest.raises(ValueError):
        G.horizon(3, 4, 1, 1, 1)


def test_support_and_overlap(spark):
    a = F.array(F.lit(0.5), F.lit(0.5), F.lit(0.0), F.lit(0.0))
    b = F.array(F.lit(0.4), F.lit(0.1), F.lit(0.5), F.lit(0.0))
    r = spark.range(1).select(G.effective_support(a), G.top_overlap(a, b, 2)).first()
    assert abs(r[0] - 2.0) < 1e-9 and r[1] == 0.5


def test_counters_and_fallback(spark):
    s = lambda **k: spark.createDataFrame([(k,)], "c MAP<STRING, DOUBLE>")
    assert rows(G.counter_deltas(s(a=1.0), s(a=3.0, b=2.0), "c")) == [("a", 2.0), ("b", 2.0)]
    t = lambda *x: spark.createDataFrame(list(x), "k STRING, v INT")
    assert rows(G.lookup_with_fallback(t(("a", 0), ("b", 0), ("c", 0)).select("k"), "k", t(("a", 1)), t(("a", 2), ("b", 3)), "v"), "k") == [("a",), ("b",), ("c",)]


def test_prompts(spark, conversations):
    df = conversations([("a", [message("system", "s"), message("user", "Q? Answer briefly."), message("user", "z")])])
    assert [m.content for m in df.select(P.with_reasoning_request(F.col("conversations"), "Think.")).first()[0]] == ["s", "Q? Answer briefly.\nThink.", "z"]
    r = df.select(P.without_terse_requests(F.col("conversations"), ["Answer briefly."]).alias("r")).select("r.*").first()
    assert r.removed == ["Answer briefly."] and r.conversations[1].content == "Q?"
    q = spark.createDataFrame([("<image>\nWhat?\nA. one\nB. two\nPick.",), ("What?\nB. one\nA. two",), ("no options",)], "t STRING").select(P.parsed_choice(F.col("t"))).collect()
    assert (q[0][0].question, q[0][0].options, q[0][0].tail) == ("What?", ["one", "two"], "Pick.") and q[1][0] is None and q[2][0] is None
    x = spark.range(1).select(
        P.interleaved_parts(F.lit("a <image 2> b <image 9>"), F.array(F.lit("p1"), F.lit("p2"))), P.run_settings(F.lit("run_win32_f8")), P.run_settings(F.lit("run_winfull")), P.picture_tokens(F.lit(80), F.lit(10)), P.offline_sample(F.array(F.lit(1), F.lit(2), F.lit(3)), F.array(F.lit(1), F.lit(1), F.lit(1)), 2),
    ).first()
    assert [(p.type, p.value) for p in x[0]] == [("text", "a "), ("image", "p2"), ("text", " b ")] and tuple(x[1]) == (32, 8) and tuple(x[2]) == (None, None) and x[3] == 2 and x[4].mask == [1, 0]
    t = spark.createDataFrame([(1, "b", "a", None)], "k INT, question_10 STRING, question_2 STRING, question_1 STRING")
    assert [(r.turn, r.prompt) for r in P.prompt_turns(t, "k").orderBy("turn").collect()] == [(2, "a"), (10, "b")]
    with pytest.raises(KeyError, match="unknown template"):
        P.template("none")
    P.register_template("own", P.Template(user="U:"), override=True)
    assert df.select(P.template("own").text(F.col("conversations"))).first()[0].startswith("<|system|>\ns\nU:Q?")


@pytest.mark.parametrize("a,b,want", [(r"\frac{1}{2}", "0.5", True), (r"$\dfrac12$", "1/2", True), ("1,000", "1000", True), ("(1, 2)", "(1,2)", True), ("x=3", "3", True), (r"3\text{ cm}", "3", True), ("2", "3", False), (None, "1", False), (r"2\pi", r"2 \pi", True)])
def test_maths(a, b, want):
    assert PS.maths_match(a, b) is want


def test_pandas_scores(spark):
    df = spark.createDataFrame([("blu", ["red", "blue"], "1/2", "0.5"), (None, ["x"], None, "1"), ("a", None, "2", "2")], "a STRING, o ARRAY<STRING>, x STRING, y STRING")
    got = df.select(PS.nearest_option("a", "o"), PS.same_maths("x", "y")).collect()
    assert [tuple(r) for r in got] == [("blue", True), (None, False), (None, True)]
