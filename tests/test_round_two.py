"""Sources, specifications, channels, span masks, readers that keep apart what is broken, ledgers, and plans."""

import pytest
from pyspark.sql import functions as F

from quarrymill.functions import answers as A
from quarrymill.operators import blocks as B
from quarrymill.operators import gates as G
from quarrymill.operators import metrics as M
from quarrymill.operators import projections as P
from quarrymill.operators import prompts as R
from quarrymill.operators import tokens as T
from quarrymill.plans import catalog
from quarrymill.sources import readers as RD
from quarrymill.streaming import refs as S
from tests.conftest import message, rows


def test_ranked_choices(spark):
    given = {"A teddy bear (B) is shown": "A", "C is wrong, (B)": "C", "(A) or (B)": "B", "the answer is D, not (A)": "A", "I pick D then": "D", "it is B": "B", "maybe B. or x": "B", "": None, "  ": None, "nothing": None, "H!": "H", "'E'": "E", None: None}
    df = spark.createDataFrame([(k, v) for k, v in given.items()], "t STRING, want STRING").select("t", "want", A.ranked_choice(F.col("t")).alias("got"))
    assert all(r.got == r.want for r in df.collect())


def test_boxes_and_stated_answers(spark):
    df = spark.createDataFrame([("x \\boxed{a{b}c} y", "a{b}c"), ("\\boxed{1} \\boxed{ 2 }", "2"), ("\\boxed{open", "open"), ("\\boxed{}", None), ("none", None), (None, None)], "t STRING, want STRING").select("want", A.boxed(F.col("t")).alias("got"))
    assert all(r.got == r.want for r in df.collect())
    s = spark.createDataFrame([("so\nAnswer: 5 \nbye", "5"), ("a\n\nlast\n", "last"), (None, None)], "t STRING, want STRING").select("want", A.stated_answer(F.col("t")).alias("got"))
    assert all(r.got == r.want for r in s.collect())


def test_source_specs_and_handles(spark):
    assert P.parse_source_specs(["a=5", "b", "c=ALL"]) == [("a", 5), ("b", None), ("c", None)]
    for bad in ("=5", "", "a=x", "a=0", "a=-3", "a=1.5"):
        with pytest.raises(ValueError):
            P.parse_source_specs([bad])
    h, s = spark.createDataFrame([("Mask",), ("k",), ("zz",), ("mask",)], "handle STRING"), spark.createDataFrame([("mask-wiki",), ("kernel",), ("talk",), (None,), ("kernel",)], "source STRING")
    assert {r.handle: (r.source, r.error) for r in P.resolved_handles(h, s).collect()} == {"Mask": ("mask-wiki", None), "mask": ("mask-wiki", None), "zz": (None, "matches none"), "k": (None, "ambiguous: matches 3")}
    assert P.resolved_handles(h, s.limit(0)).where("error = 'matches none'").count() == 4 and P.resolved_handles(h.limit(0), s).count() == 0
    with pytest.raises(KeyError):
        P.project_source("nothing", [h])
    assert len(P.SOURCES) == 21 and all(s.projection in P.PRESETS for s in P.SOURCES.values())


def test_channels(spark):
    m = lambda *x: F.array(*[F.struct(F.lit(r).alias("role"), F.lit(c).cast("string").alias("content")) for r, c in x])
    one = spark.range(1)
    text = one.select(P.render_channels(m(("user", "q"), ("assistant_final", None))).alias("t")).first().t
    assert text.startswith("<|start|>system<|message|>You are") and "Reasoning: low" in text and text.endswith("<|start|>user<|message|>q<|end|><|start|>assistant<|channel|>final<|message|><|end|>")
    assert one.select(P.render_channels(m(("user", "lost"), ("system", "s"), ("user", "q"))).alias("t")).first().t == "<|start|>system<|message|>s<|end|><|start|>user<|message|>q<|end|>"
    with pytest.raises(Exception, match="unknown role"):
        one.select(P.render_channels(m(("tool", "q")))).collect()


def test_span_masks(spark):
    t = R.template("turns")
    text = t.example([("user", "a b"), ("assistant", "c d"), ("user", "e"), ("assistant", "")])
    df = spark.createDataFrame([(text,), (None,), ("",), ("no answer here",)], "t STRING")
    got = [r.m for r in df.select(T.span_mask(t.assistant_pattern())(F.col("t")).alias("m")).collect()]
    assert got == [[0, 0, 0, 0, 1, 1, 0, 0, 0, 1], None, [], [0, 0, 0]]
    last = df.select(T.span_mask(t.assistant_pattern(), last_only=True)(F.col("t")).alias("m")).first().m
    assert sum(last) == 1 and R.Template("U ", "A ", "", " .").control_texts() == ("A ", " .")
    think = R.Template("U ", "A ", "", " .\n").assistant_pattern("thinking")
    assert spark.createDataFrame([("U q\nA <think> </think> yes .\n",)], "t STRING").select(T.span_mask(think)(F.col("t")).alias("m")).first().m == [0, 0, 0, 0, 0, 1, 1]
    with pytest.raises(ValueError):
        R.Template("", "", "", "").control_texts()


def test_gates_of_metadata(spark):
    schema = spark.sql("SELECT X'00' AS b, struct(array(X'01') AS c, 1 AS n) AS s, map('k', X'02') AS m").schema
    assert G.tensor_columns(schema) == ["b", "s.c[]", "m.value"]
    leased = spark.createDataFrame([("r", i, f"s{i}") for i in range(4)] + [("q", 0, "t0")], "g STRING, n INT, id STRING")
    acks = spark.createDataFrame([("s0",), ("s2",), ("s2",), ("zz",), (None,)], "id STRING")
    assert rows(G.prefix_errors(leased, acks, "g", "n", "id").na.fill("")) == [("q", 1, 0, ""), ("r", 4, 2, "not a prefix: 1")]
    with pytest.raises(ValueError):
        G.batch_slice(F.col("n"), 10, 0, 3)
    family = spark.createDataFrame([("Cook Book", "food"), ("sea", "water")], "handle STRING, family STRING")
    df = spark.createDataFrame([("cookbook-part-01-of-02#1", None), ("x#1", "The Sea!"), ("y#1", "land"), (None, None)], "id STRING, source STRING").withColumn("_h", F.lit(1))
    assert rows(G.of_family(df, family, ["food", "water"]), "id") == [("cookbook-part-01-of-02#1",), ("x#1",)] and G.of_family(df.limit(0), family, ["food"]).count() == 0


def test_measures_of_blocks_and_series(spark):
    blocks = spark.createDataFrame([("a", i, [True, i % 2 == 0, True], [0.1, float(i), 0.3], [0.2, None, 0.4]) for i in range(9)], "id STRING, block INT, correct ARRAY<BOOLEAN>, kl ARRAY<DOUBLE>, entropy ARRAY<DOUBLE>")
    got = B.accept_by_block(blocks)
    assert got.where("measure = 'kl_first'").agg(F.sum("n")).first()[0] == 9 and B.accept_by_block(blocks, least=10).count() == 0 and B.accept_by_block(blocks.limit(0)).count() == 0
    s = spark.createDataFrame([([0.0, 1.0, float("nan"), None],), (None,), ([2.0],)], "v ARRAY<DOUBLE>")
    r = M.pooled_series(s, "v").first()
    assert (r.n_rows, r.n_values, r["mean"], r.p50) == (2, 3, 1.0, 1.0) and M.pooled_series(s.limit(0), "v").first().n_values == 0


def test_arrays_and_lines_are_kept_apart(spark, tmp_path):
    (tmp_path / "a.json").write_text('\n  [{"id": "x"},\n 3, {"id": "y", "more": [1]}, "z"]')
    (tmp_path / "b.json").write_text('{"id": "l"}\n\n{"id": \n')
    (tmp_path / "c.json").write_text('[{"id": "lost"}, ')
    schema = "id STRING"
    assert rows(RD.read_records(spark, str(tmp_path), schema, on_error="drop")) == [("l",), ("x",), ("y",)]
    kept = RD.read_records(spark, str(tmp_path), schema, on_error="keep")
    assert kept.where("_broken IS NOT NULL").count() == 4 and kept.count() == 7
    with pytest.raises(Exception, match="not a JSON object"):
        RD.read_records(spark, str(tmp_path), schema).count()
    with pytest.raises(ValueError):
        RD.read_dataset(spark, str(tmp_path / "a.csv"), schema)


def test_quota_falls_short(spark):
    df = spark.createDataFrame([("a", i) for i in range(40)] + [("b", i) for i in range(2)], "c STRING, k INT")
    q = spark.createDataFrame([("a", 7), ("b", 2)], "c STRING, quota BIGINT")
    assert rows(RD.quota_per_config(df, "c", "k", q, 1).groupBy("c").count()) == [("a", 7), ("b", 2)]
    with pytest.raises(Exception, match="too few rows"):
        RD.quota_per_config(df, "c", "k", q.withColumn("quota", F.lit(3).cast("long")), 1).collect()


REFS = "sample_id STRING, run_id STRING, strategy STRING, schema_version INT, num_tokens INT, estimated_bytes BIGINT, published_at TIMESTAMP"


def test_ledgers_and_fixed_settings(spark, tmp_path):
    batch = lambda *ids: spark.createDataFrame([(i, f"run{n}", None, 1, 1, 1, None) for n, i in enumerate(ids)], REFS)
    for kind, want in ((S.Ledger, [("a", "run0"), ("b", "run1"), ("c", "run1")]), (S.SessionLedger, [("a", "run0"), ("b", "run1"), ("c", "run1")]), (S.ForgetfulLedger, [])):
        ledger = kind(spark, str(tmp_path / kind.__name__))
        assert ledger.read("committed").count() == 0 and ledger.read("acked").count() == 0
        for n, ids in enumerate((("a", "b", None, "a"), ("b", "c"))):
            ledger.commit(batch(*ids).where("sample_id IS NULL OR sample_id <> 'a' OR run_id = 'run0'"), n)
        ledger.commit(batch("b", "c"), 1)
        assert rows(ledger.read("committed"), "sample_id", "run_id") == want
    assert S.fixed_once(spark, str(tmp_path / "q"), 8) == 8
    with pytest.raises(ValueError):
        S.fixed_once(spark, str(tmp_path / "q"), 9)


def test_no_query_shuffles_messages(spark):
    """Results are made in the row before redelivered rows are dropped."""
    names = ["conversation_errors", "conversation_errors_regen", "row_validation", "row_validation_policies", "sanitize", "answer_filter", "status_routes", "sharegpt_projection", "turn_pairs", "pair_accounting", "single_pair_records", "generation_events", "event_summary",
             "truncated_turns", "rendered_prompts", "prompt_leaks", "frame_positions", "corpus_profile", "context_lengths", "call_sanitizer", "trainable_samples", "last_turn_masks", "span_masks", "chat_payloads", "serving_checks", "p2_found", "p2_typed"]
    for n in names:
        df = catalog.QUERIES[n](spark, "/root/testdata/sf0.001")
        plan = spark._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")
        moved = [b for b in plan.split("\n\n") if ") Exchange\n" in b and ("conversations#" in b or "history#" in b or " m#" in b)]
        assert not moved, (n, moved)


def test_pairs_in_the_row(conversations):
    df = conversations([("a", [message("system", "s"), message("user", "q1"), message("system", "t"), message("assistant", "r1"), message("assistant", "r2"), message("user", "q2"), message("user", "q3"), message("tool", "x"), message("assistant", "r3"), message(None, "n"), message("user", "q4"), message("assistant", None)]), ("b", []), ("c", None)])
    assert rows(P.turn_pairs(df).select("id", "pair", "user_pos", "question", F.coalesce("answer", F.lit("-")))) == [("a", 0, 1, "q1", "r1"), ("a", 1, 10, "q4", "-")]
