"""Sampling plans, metrics, blocks, scores and ledgers on small hand-computed cases."""

import random

import numpy as np
from pyspark.sql import functions as F

from quarrymill.operators import blocks as B
from quarrymill.operators import ledger as L
from quarrymill.operators import metrics as M
from quarrymill.operators import sampling as O
from quarrymill.operators import scores as S
from quarrymill.operators import tokens as T
from tests.conftest import rows


def test_split_is_exact_and_stable(spark):
    df = spark.range(101).withColumnRenamed("id", "k")
    a = rows(O.train_test(df, "k"), "k", "split")
    assert sum(s == "test" for _, s in a) == 6 and a == rows(O.train_test(df.repartition(7), "k"), "k", "split")


def test_quota_caps_and_redistributes(spark):
    df = spark.createDataFrame([("a", 1), ("b", 100), ("c", 2)], "g STRING, n BIGINT")
    got = {r.g: r.quota for r in O.largest_remainder(df, "g", "n", 50).collect()}
    assert sum(got.values()) == 50 and got["a"] <= 1 and got["c"] <= 2
    assert sum(r.quota for r in O.largest_remainder(df, "g", "n", 1000).collect()) == 103


def test_caps_by_group(spark):
    df = spark.range(4000).select(F.when(F.col("id") < 3900, "hot").otherwise("cold").alias("g"), "id")
    one = O.capped_per_group(df, "g", "id", 7, 1)
    assert rows(one.groupBy("g").count()) == [("cold", 7), ("hot", 7)]
    by = O.capped_per_group(df, "g", "id", None, 1, spark.createDataFrame([("hot", 7), ("cold", None)], "g STRING, n INT"))
    assert rows(by.where("g = 'hot'"), "id") == rows(one.where("g = 'hot'"), "id") and by.where("g = 'cold'").count() == 100 and by.columns == df.columns


def test_epochs_pad_by_wrapping(spark):
    df = spark.range(10).withColumnRenamed("id", "k")
    s = O.shards_of_epochs(df, "k", epochs=2, ranks=4, seed=1)
    assert s.groupBy("epoch", "rank").count().select("count").distinct().collect()[0][0] == 3
    assert s.where("padded").count() == 4


def test_positions(spark):
    got = spark.range(1).select(O.even_positions(F.lit(10), 4), O.even_positions(F.lit(3), 5)).first()
    assert got[0] == [0, 3, 6, 9] and got[1] == [0, 1, 2]


def test_busy_time_against_brute_force(spark):
    rng = random.Random(3)
    data = [("g", rng.uniform(0, 300), 0.0) for _ in range(200)]
    data = [(g, a, a + rng.expovariate(0.3)) for g, a, _ in data] + [("h", 1.0, None), ("h", 5.0, 4.0), ("h", 2.0, 3.0), ("h", 2.5, 200.0)]
    got = {r.g: r.busy for r in M.busy_time(spark.createDataFrame(data, "g STRING, a DOUBLE, b DOUBLE"), "g", "a", "b").collect()}
    total, end = 0.0, float("-inf")
    for _, a, b in sorted(x for x in data if x[0] == "g"):
        total += max(0.0, b - max(a, end))
        end = max(end, b)
    assert abs(got["g"] - total) < 1e-9 and abs(got["h"] - 198.0) < 1e-9


def test_quantiles_against_numpy(spark):
    v = [random.Random(5).gauss(0, 1) for _ in range(333)] + [0.25] * 40
    df = spark.createDataFrame([(x,) for x in v] + [(None,)], "v DOUBLE").repartition(5)
    got = [r.edge for r in M.quantile_edges(df, "v", 51).orderBy("k").collect()]
    assert np.allclose(got, np.quantile(v, np.linspace(0, 1, 51)))
    assert M.value_at(df, "v", [("m", "n div 2")]).first()[0] == sorted(v)[len(v) // 2]
    assert M.quantile_edges(df.limit(0), "v", 5).count() == 0


def test_correlations(spark):
    df = spark.createDataFrame([(float(i), float(i * i), float(-i)) for i in range(20)], "x DOUBLE, y DOUBLE, z DOUBLE")
    assert M.spearman(df, "x", "y").first()[0] == 1.0
    assert df.limit(2).agg(M.pearson("x", "y")).first()[0] is None
    assert M.partial_correlation(df, "x", "y", "z").first()[0] is None  # nothing varies once z is held


def test_series_and_deciles(spark):
    df = spark.createDataFrame([("a", [0.05, 1.5, float("nan"), None]), ("b", None), ("c", [])], "id STRING, e ARRAY<DOUBLE>")
    got = {r.id: r for r in M.series_stats(df, "id", "e").collect()}
    assert got["a"].n == 2 and got["a"].below == 0.5 and got["a"].above == 0.5 and got["b"].n == 0 and got["c"].mean is None
    n = 23
    want = [len(c) for c in np.array_split(np.arange(n), 10)]
    d = spark.range(n).select(M.decile_of(F.col("id"), F.lit(n)).alias("d")).groupBy("d").count().orderBy("d").collect()
    assert [r["count"] for r in d] == want


BLOCKS = "id STRING, block INT, correct ARRAY<BOOLEAN>, kl ARRAY<DOUBLE>, entropy ARRAY<DOUBLE>"


def test_blocks(spark):
    t, f = True, False
    df = spark.createDataFrame([("a", 0, [t, t, t, f, t], [0.0, 1.0, 2.0, 3.0, 4.0], [0.0] * 5), ("a", 1, [t, t, t], [0.0, 5.0, 6.0], [0.0] * 3), ("b", 0, [t], [0.0], [0.0]), ("c", 0, [t, f, t, t, f], [0.0, 7.0, 8.0, None, 9.0], [0.0] * 5)], BLOCKS)
    assert [r[0] for r in df.select(B.accepted_length(F.col("correct"))).collect()] == [2, 2, 0, 0]
    assert [r[0] for r in df.select(B.first_miss(F.col("correct"))).collect()] == [3, None, None, 1]
    total = B.truncation(df).where("quartile = 0").first()
    assert (total.culprits, total.discarded_own, total.discarded_by) == (2, 4, 4)
    assert sum(r.n * r.gain for r in B.marginal_gain(df).collect()) == 2 + 3
    p = spark.createDataFrame([([t, f, t], [t, f, t]), ([f, t], [t, t]), ([], [])], "c ARRAY<BOOLEAN>, v ARRAY<BOOLEAN>").select(B.accepted_prefix(F.col("c"), F.col("v"))).collect()
    assert [x[0] for x in p] == [2, 0, 0]


def test_scores(spark):
    got = spark.range(1).select(
        S.quantised(F.lit(0.00025)), S.quantised(F.lit(0.00035)), S.quantised(F.lit(None).cast("double")), S.by_quantile(F.array(*[F.lit(float(x)) for x in range(0, 11)]), F.lit(5.0)),
        S.expanded(F.array(*[F.lit(x) for x in (0, 0, 1, 1, 0, 1)]), F.array(F.lit(0.25), F.lit(1.0), F.lit(0.0)), F.lit(-1.0)), S.expanded(F.array(F.lit(1)), F.array().cast("array<double>"), F.lit(-1.0)),
    ).first()
    assert got[0] == 2 and got[1] in (3, 4) and got[2] == -1 and abs(got[3] - 6 / 11) < 1e-9 and got[4] == [-1.0, -1.0, 0.25, 1.0, -1.0, 0.0] and got[5] is None


def test_score_audit_counts(spark):
    s = spark.createDataFrame([("a", 2, [1.0, 2.0], [0.1, 0.2]), ("a", 2, [1.0, 2.0], [0.1, 0.2]), ("b", 1, [1.0], [0.1, 0.2]), ("z", 1, [float("inf")], [0.1]), ("n", 1, None, None)], "id STRING, n_loss INT, kl ARRAY<DOUBLE>, entropy ARRAY<DOUBLE>")
    r = S.audit(s, spark.createDataFrame([("a",), ("b",), ("q",), ("n",)], "id STRING")).first()
    assert (r.n_rows, r.repeated_ids, r.null_ids, r.ragged_ids, r.wild_ids, r.orphan_ids, r.unscored_records) == (5, 1, 1, 1, 1, 1, 1)


def test_tokens(spark):
    df = spark.createDataFrame([("a", [("user", "one two"), ("assistant", "three four five"), ("assistant", None), ("user", "x"), ("assistant", "y")])], "id STRING, m ARRAY<STRUCT<role: STRING, content: STRING>>")
    s = df.select("id", T.supervised(F.col("m")).alias("s")).select("id", "s.*")
    assert s.first().mask == [0, 0, 1, 1, 1, 0, 1]
    assert T.materialised(s, max_length=4, min_trainable=2).first().mask == [0, 0, 1, 1] and T.materialised(s, max_length=4, min_trainable=3).count() == 0
    ids = lambda *x: F.array(*[F.lit(v) for v in x])
    got = spark.range(1).select(T.find_all(ids(1, 2, 1, 2, 2), ids(1, 2)), T.mask_after(ids(9, 1, 2, 5, 0, 7, 1, 2, 8), ids(1, 2), F.lit(0)), T.common_prefix(ids(1, 2, 3), ids(1, 2)), T.common_prefix(ids(1, 2), ids(1, 3))).first()
    assert got[0] == [0, 2] and got[1] == [0, 0, 0, 1, 1, 0, 0, 0, 1] and got[2] == 2 and got[3] == 1
    v = T.reduced_vocabulary(spark.createDataFrame([("b", 3), ("a", 3), ("c", 1)], "token STRING, n BIGINT"), 2).orderBy("draft_id").collect()
    assert [(r.draft_id, r.token) for r in v] == [(0, "a"), (1, "b")] and abs(v[0].coverage - 6 / 7) < 1e-5


REFS = "sample_id STRING, run_id STRING, strategy STRING, schema_version INT, num_tokens INT, estimated_bytes BIGINT, published_at TIMESTAMP"


def test_ledger(spark):
    import datetime as dt

    at = lambda m: dt.datetime(2025, 1, 1, 0, m)
    refs = spark.createDataFrame([(f"s{i}", "r", "e", 1, 5, 10, at(i)) for i in range(5)] + [("s0", "r", "e", 1, 5, 10, at(9)), (None, "r", "e", 1, 5, 10, at(1))], REFS)
    acks = spark.createDataFrame([("s0", at(6)), ("s1", at(7)), ("s1", at(8)), ("zz", at(1)), (None, at(1))], "sample_id STRING, acked_at TIMESTAMP")
    assert rows(L.reconcile(refs, acks).groupBy("outcome").count()) == [("released", 2), ("requeued", 3), ("unknown", 1)]
    d = L.dispatch(L.committed(refs), [F.col("published_at"), F.col("sample_id")], ranks=2, per_rank=1)
    assert rows(d, "sample_id", "window", "rank") == [("s0", 0, 0), ("s1", 0, 1), ("s2", 1, 0), ("s3", 1, 1)]
    q = L.pause_latch(L.queue_depth(refs, acks, "run_id"), "run_id", high=4, low=3, high_bytes=10**9, low_bytes=10**9).orderBy("at").collect()
    assert [r.n for r in q] == [1, 2, 3, 4, 5, 4, 3] and [r.paused for r in q] == [False, False, False, True, True, True, False]
