"""Queries over evaluation facts: requests, acceptance, scores, blocks, references; with DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrymill.functions import text as X
from quarrymill.operators import blocks as B
from quarrymill.operators import ledger as L
from quarrymill.operators import metrics as M
from quarrymill.operators import sampling as O
from quarrymill.operators import scores as S
from quarrymill.operators import tokens as T
from quarrymill.plans.corpus_queries import conversations, once
from quarrymill.session import cut_lineage, table


def requests(spark: SparkSession, d: str) -> DataFrame:
    """Each request once, as first logged."""
    r = table(spark, d, "request_stats").where("rid IS NOT NULL")
    rest = [c for c in r.columns if c not in ("rid", "logged_at")]
    return r.groupBy("rid").agg(F.min_by(F.struct(*rest), "logged_at").alias("r"), F.min("logged_at").alias("logged_at")).select("rid", "r.*", "logged_at")


def blocks_of(spark: SparkSession, d: str, size: int = 8) -> DataFrame:
    """Blocks of ``size`` slots made of the score rows: a slot counts as correct when its entropy is below 0.9."""
    s = S.once(table(spark, d, "score_sidecar")).where("kl IS NOT NULL AND entropy IS NOT NULL AND size(kl) = size(entropy) AND size(kl) > 0")
    n = F.ceil(F.size("kl") / F.lit(size)).cast("int")
    cut = lambda c, b: F.slice(c, b * size + 1, F.lit(size))
    parts = F.transform(F.sequence(F.lit(0), n - 1), lambda b: F.struct(b.alias("block"), cut(F.col("kl"), b).alias("kl"), cut(F.col("entropy"), b).alias("entropy")))
    e = s.select("id", F.explode(parts).alias("p")).select("id", "p.block", "p.kl", "p.entropy")
    return e.withColumn("correct", F.transform("entropy", lambda x: F.coalesce(x < 0.9, F.lit(False))))


def request_samples(spark: SparkSession, d: str) -> DataFrame:
    return M.per_request(requests(spark, d)).withColumn("accept_length", F.round("accept_length", 6))


def run_metrics(spark: SparkSession, d: str) -> DataFrame:
    return M.run_metrics(requests(spark, d))


def length_summary(spark: SparkSession, d: str) -> DataFrame:
    return M.length_summary(requests(spark, d))


def busy_time(spark: SparkSession, d: str) -> DataFrame:
    r = requests(spark, d).select("run_id", (F.col("send_offset") + F.when(F.col("first_token_latency") >= 0, F.col("first_token_latency"))).alias("a"), (F.col("send_offset") + F.when(F.col("e2e_latency") >= 0, F.col("e2e_latency"))).alias("b"))
    return M.busy_time(r, "run_id", "a", "b").select("run_id", F.round("busy", 6).alias("busy"))


def throughput(spark: SparkSession, d: str) -> DataFrame:
    return M.throughput(requests(spark, d))


def acceptance_report(spark: SparkSession, d: str) -> DataFrame:
    return M.acceptance_report(M.per_request(requests(spark, d)), "run_id")


def acceptance_histogram(spark: SparkSession, d: str) -> DataFrame:
    return M.histogram(M.per_request(requests(spark, d)), "accept_length", 1.0, 9.0, 16)


def acceptance_extremes(spark: SparkSession, d: str) -> DataFrame:
    s = M.per_request(requests(spark, d)).withColumn("key", F.concat_ws("/", "run_id", "index"))
    return M.extremes(s, "accept_length", "key", 20).select("side", "key", F.round("accept_length", 6).alias("accept_length"))


def finish_reasons(spark: SparkSession, d: str) -> DataFrame:
    r = requests(spark, d)
    return r.groupBy(F.coalesce(F.lower(F.trim("finish_reason")), F.lit("none")).alias("reason")).agg(F.count("*").alias("n"), F.coalesce(F.sum("completion_tokens"), F.lit(0)).alias("tokens"))


def rate_by_run(spark: SparkSession, d: str) -> DataFrame:
    """Requests that stopped by themselves, by benchmark of their run, with micro and macro averages."""
    r = requests(spark, d).join(table(spark, d, "runs").select("run_id", "benchmark"), "run_id")
    return M.grouped_accuracy(r.withColumn("hit", F.coalesce(F.lower("finish_reason") == "stop", F.lit(False))), "benchmark", "hit")


def average_and_worst(spark: SparkSession, d: str) -> DataFrame:
    r = requests(spark, d).where("run_id IS NOT NULL").withColumn("hit", F.coalesce(F.lower("finish_reason") == "stop", F.lit(False)))
    return M.average_and_worst(r, "run_id", "hit")


def step_timing(spark: SparkSession, d: str) -> DataFrame:
    """Seconds by phase and strategy, per verification step and as shares."""
    r = requests(spark, d).join(table(spark, d, "runs").select("run_id", "strategy"), "run_id")
    ok = lambda c: F.sum(F.when(M.finite(F.col(c)) >= 0, F.col(c)))
    g = r.groupBy(F.coalesce("strategy", F.lit("none")).alias("strategy")).agg(ok("first_token_latency").alias("prefill"), ok("decode_latency").alias("decode"), F.sum("spec_verify_ct").alias("steps"))
    return g.select("strategy", F.round("prefill", 4).alias("prefill_s"), F.round("decode", 4).alias("decode_s"), F.round(F.try_divide(F.col("decode") * 1000, "steps"), 6).alias("decode_ms_per_step"), F.round(F.try_divide("prefill", F.col("prefill") + F.col("decode")), 6).alias("prefill_share"))


def benchmark_pivot(spark: SparkSession, d: str) -> DataFrame:
    """Target and draft model by benchmark: tokens per verification, one column a benchmark."""
    r = requests(spark, d).join(table(spark, d, "runs").where("target_model IS NOT NULL AND draft_model IS NOT NULL").select("run_id", "target_model", "draft_model", "benchmark"), "run_id")
    g = r.groupBy("target_model", "draft_model", "benchmark").agg(F.round(F.try_divide(F.sum("completion_tokens"), F.nullif(F.sum("spec_verify_ct"), F.lit(0))), 4).alias("v"))
    return g.groupBy("target_model", "draft_model").pivot("benchmark", ["draftqa", "longread", "maskmath", "stepcheck", "tooltrace"]).agg(F.first("v"))


def run_speedups(spark: SparkSession, d: str) -> DataFrame:
    t = requests(spark, d).groupBy("run_id").agg(F.try_divide(F.sum("completion_tokens"), F.sum(F.when(M.finite(F.col("e2e_latency")) > 0, F.col("e2e_latency")))).alias("throughput"))
    runs = table(spark, d, "runs").where("target_model IS NOT NULL").select("run_id", F.col("target_model").alias("model"), "block_size", "started_at").join(t, "run_id")
    return L.speedups(runs).select("run_id", "model", "speedup")


def complete_benchmarks(spark: SparkSession, d: str) -> DataFrame:
    r = requests(spark, d).join(table(spark, d, "runs").where("draft_model IS NOT NULL AND benchmark IS NOT NULL").select("run_id", "draft_model", "benchmark"), "run_id")
    g = r.groupBy("draft_model", "benchmark").agg(F.avg("completion_tokens").alias("v"))
    return L.complete_sets(g, ["draft_model"], "benchmark", "v")


def request_correlations(spark: SparkSession, d: str) -> DataFrame:
    r = requests(spark, d).where("e2e_latency >= 0 AND completion_tokens IS NOT NULL AND prompt_tokens IS NOT NULL").select(F.col("completion_tokens").cast("double").alias("x"), F.col("e2e_latency").alias("y"), F.col("prompt_tokens").cast("double").alias("z"))
    return r.agg(F.round(M.pearson("x", "y"), 6).alias("pearson")).crossJoin(M.spearman(r, "x", "y")).crossJoin(M.partial_correlation(r, "x", "y", "z"))


def completion_buckets(spark: SparkSession, d: str) -> DataFrame:
    return M.equal_count_buckets(requests(spark, d).where("completion_tokens IS NOT NULL").select("completion_tokens", "prompt_tokens"), "completion_tokens", "prompt_tokens", 7).select("bucket", "n", "low", "high")


def token_quartiles(spark: SparkSession, d: str) -> DataFrame:
    return M.quartile_cross(requests(spark, d).where("completion_tokens IS NOT NULL AND prompt_tokens IS NOT NULL"), "completion_tokens", "prompt_tokens")


def entropy_series(spark: SparkSession, d: str) -> DataFrame:
    return M.series_stats(S.once(table(spark, d, "score_sidecar")), "id", "entropy")


def entropy_deciles(spark: SparkSession, d: str) -> DataFrame:
    return M.decile_profile(S.once(table(spark, d, "score_sidecar")), "id", "entropy")


def position_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Accuracy and loss by slot of the blocks; the denominators are 1 a slot."""
    b = blocks_of(spark, d)
    ones = F.transform("entropy", lambda x: F.lit(1.0))
    rows = b.select(F.transform("correct", lambda c: c.cast("double")).alias("c"), ones.alias("n"), F.transform("kl", lambda k: F.coalesce(M.finite(k), F.lit(0.0))).alias("l"))
    return M.position_metrics(rows, "c", "n", "l")


def simulated_acceptance(spark: SparkSession, d: str) -> DataFrame:
    p = position_metrics(spark, d).agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "accuracy"))), lambda s: s.accuracy).alias("a"))  # one value a slot of a block
    return p.select(F.round(M.simulated_acceptance(F.col("a")), 6).alias("acceptance"), F.size("a").alias("positions"))


def score_edges(spark: SparkSession, d: str) -> DataFrame:
    return M.quantile_edges(S.kl_values(S.once(table(spark, d, "score_sidecar"))), "kl", 101).select("k", F.round("edge", 9).alias("edge"))


def score_stats(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "score_sidecar")
    return S.table_stats(s, M.quantile_edges(S.kl_values(S.once(s)), "kl", 101))


def score_transforms(spark: SparkSession, d: str) -> DataFrame:
    s = S.once(table(spark, d, "score_sidecar")).where("kl IS NOT NULL AND entropy IS NOT NULL AND size(kl) = size(entropy)")
    v = s.select("id", F.posexplode(F.arrays_zip("kl", "entropy")).alias("pos", "z")).select("id", "pos", M.finite(F.col("z.kl")).alias("kl"), M.finite(F.col("z.entropy")).alias("entropy"))
    return v.agg(
        F.count("kl").alias("n"), F.round(F.sum(S.by_threshold(F.col("kl"), 0.5)), 6).alias("binary"), F.round(F.sum(S.by_saturation(F.col("kl"), 0.5)), 4).alias("saturated"), F.round(F.sum(S.by_identity(F.col("kl"))), 4).alias("identity"),
        F.round(F.sum(S.gated(S.by_identity(F.col("kl")), F.col("entropy"))), 4).alias("gated"), F.sum(S.quantised(S.by_identity(F.col("kl"))).cast("long")).alias("quantised"),
    )


def score_join(spark: SparkSession, d: str) -> DataFrame:
    rec = once(spark, d, "image").select("id", F.col("image").isNotNull().alias("has_image"))
    return S.join_scores(rec, table(spark, d, "score_sidecar")).groupBy("status").agg(F.count("*").alias("n"), F.coalesce(F.sum("n_loss"), F.lit(0)).alias("n_loss"))


def score_audit(spark: SparkSession, d: str) -> DataFrame:
    return S.audit(table(spark, d, "score_sidecar"), once(spark, d).select("id"), 60)


def expanded_scores(spark: SparkSession, d: str) -> DataFrame:
    """Scores put back at the trained positions of a made mask (every position whose number has a digit sum by 3)."""
    s = S.once(table(spark, d, "score_sidecar")).where("kl IS NOT NULL AND size(kl) > 0")
    mask = F.transform(F.sequence(F.lit(0), F.size("kl") * 3 - 1), lambda i: F.when(i % 3 == 0, 1).otherwise(0))
    e = s.select("id", S.expanded(mask, F.col("kl"), F.lit(-1.0)).alias("g"))
    return e.select("id", F.size("g").alias("n"), F.size(F.filter("g", lambda x: x == -1.0)).alias("n_fill"))


def draft_overview(spark: SparkSession, d: str) -> DataFrame:
    return B.overview(blocks_of(spark, d))


def accepted_prefixes(spark: SparkSession, d: str) -> DataFrame:
    b = blocks_of(spark, d)
    valid = F.transform("kl", lambda k: M.finite(k).isNotNull())
    return b.select(B.accepted_prefix(F.col("correct"), valid).alias("prefix"), B.accepted_length(F.col("correct")).alias("accepted")).groupBy("prefix", "accepted").agg(F.count("*").alias("n"))


def slot_hits(spark: SparkSession, d: str) -> DataFrame:
    return B.slot_hits(blocks_of(spark, d))


def truncation_economics(spark: SparkSession, d: str) -> DataFrame:
    return B.truncation(blocks_of(spark, d))


def marginal_gain(spark: SparkSession, d: str) -> DataFrame:
    return B.marginal_gain(blocks_of(spark, d))


def conditional_hits(spark: SparkSession, d: str) -> DataFrame:
    return B.conditional_hits(blocks_of(spark, d))


def sign_test(spark: SparkSession, d: str) -> DataFrame:
    return B.sign_test(blocks_of(spark, d), 2)


def draft_correlations(spark: SparkSession, d: str) -> DataFrame:
    return B.correlations(blocks_of(spark, d))


def reference_outcomes(spark: SparkSession, d: str) -> DataFrame:
    r = L.reconcile(table(spark, d, "sample_refs"), table(spark, d, "acked"))
    return r.groupBy("outcome").agg(F.count("*").alias("n"), F.min("sample_id").alias("first_id"))


def committed_refs(spark: SparkSession, d: str) -> DataFrame:
    return L.committed(table(spark, d, "sample_refs")).select("sample_id", "run_id", "strategy", "num_tokens", "deliveries")


def resume_inputs(spark: SparkSession, d: str) -> DataFrame:
    refs = table(spark, d, "sample_refs").select(F.col("source_task_id").alias("id"))
    return L.remaining(once(spark, d), [refs, table(spark, d, "score_sidecar").select("id")], "id").select("id")


def dispatch_windows(spark: SparkSession, d: str) -> DataFrame:
    c = L.committed(table(spark, d, "sample_refs"))
    return L.dispatch(c, [F.col("published_at"), F.col("sample_id")], ranks=4, per_rank=8)


def back_pressure(spark: SparkSession, d: str) -> DataFrame:
    q = L.queue_depth(table(spark, d, "sample_refs"), table(spark, d, "acked"), "run_id")
    return L.pause_latch(q, "run_id", high=6, low=2, high_bytes=400_000, low_bytes=150_000).groupBy("run_id").agg(F.count("*").alias("events"), F.sum(F.col("paused").cast("long")).alias("paused"), F.max("n").alias("deepest"))


def mixed_batches(spark: SparkSession, d: str) -> DataFrame:
    refs = cut_lineage(L.committed(table(spark, d, "sample_refs")))
    j = L.dispatch(refs, [F.col("published_at"), F.col("sample_id")], ranks=2, per_rank=8).join(refs, "sample_id")
    return L.homogeneous(j, "window").select("window", "n", "strategies", "versions", "ok")


def missing_features(spark: SparkSession, d: str) -> DataFrame:
    m = L.missing_features(table(spark, d, "sample_refs"), ["input_ids", "loss_mask", "hidden_state"])
    return m.select(F.explode("missing").alias("feature")).groupBy("feature").agg(F.count("*").alias("n"))


def question_set_match(spark: SparkSession, d: str) -> DataFrame:
    e = O.global_rank(table(spark, d, "eval_items").select("item_id", "text"), [F.col("item_id")], "p")
    other = e.select("p", F.when(F.col("p") == 123, F.lit("changed")).otherwise(F.col("text")).alias("text"))
    return L.first_difference(e, other, "p", "text")


def token_frequency(spark: SparkSession, d: str) -> DataFrame:
    m = once(spark, d, "conversations").where(F.size("conversations") > 0).select("id", T.supervised(F.filter("conversations", lambda x: x.isNotNull())).alias("s")).select("id", "s.*")
    return T.token_counts(m)


def reduced_vocabulary(spark: SparkSession, d: str) -> DataFrame:
    return T.reduced_vocabulary(token_frequency(spark, d), 500)


def trainable_samples(spark: SparkSession, d: str) -> DataFrame:
    m = conversations(spark, d).where(F.size("conversations") > 0).select("id", T.supervised(F.filter("conversations", lambda x: x.isNotNull())).alias("s")).select("id", "s.*").where(F.size("tokens") > 0)
    return T.materialised(m, max_length=256, min_trainable=64).select("id", F.size("tokens").alias("n_tokens"), T.trainable(F.col("mask")).alias("n_trainable")).dropDuplicates(["id"])


def last_turn_masks(spark: SparkSession, d: str) -> DataFrame:
    m = conversations(spark, d).where(F.size("conversations") > 0).select("id", T.supervised(F.filter("conversations", lambda x: x.isNotNull()), last_only=True).alias("s"))
    return m.select("id", F.size("s.tokens").alias("n_tokens"), T.trainable(F.col("s.mask")).alias("n_trainable")).dropDuplicates(["id"])


def padded_batches(spark: SparkSession, d: str) -> DataFrame:
    s = S.once(table(spark, d, "score_sidecar")).where("kl IS NOT NULL").select("id", "kl")
    b = O.global_rank(s, [F.col("id")], "p").withColumn("batch", F.floor(F.col("p") / 8))
    return T.collate(b, "batch", "kl", -1.0, 4).groupBy("batch").agg(F.max(F.size("kl")).alias("width"), F.min(F.size("kl")).alias("narrowest"), F.count("*").alias("n"))


def acceptance_of_vectors(spark: SparkSession, d: str) -> DataFrame:
    """Expected acceptance, divergence, entropy and mixed loss of neighbouring vectors as distributions."""
    e = table(spark, d, "embeddings").select("vec_id", S.softmax(F.col("embedding")).alias("p"))
    q = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("p").alias("q"))
    j = e.join(q, "vec_id").select("vec_id", "p", "q").select("vec_id", S.expected_acceptance(F.col("p"), F.col("q")).alias("a"), S.kl_divergence(F.col("p"), F.col("q")).alias("k"), S.tail_entropy(F.slice("p", 1, 32)).alias("h"))
    return j.select("vec_id", F.round("a", 6).alias("acceptance"), F.round("k", 6).alias("divergence"), F.round("h", 6).alias("entropy"), F.round(S.mixed_loss(F.col("a"), F.col("k")), 6).alias("loss"))


QUERIES = {
    f.__name__: f
    for f in (
        request_samples, run_metrics, length_summary, busy_time, throughput, acceptance_report, acceptance_histogram, acceptance_extremes, finish_reasons, rate_by_run, average_and_worst, step_timing, benchmark_pivot,
        run_speedups, complete_benchmarks, request_correlations, completion_buckets, token_quartiles, entropy_series, entropy_deciles, position_metrics, simulated_acceptance, score_edges, score_stats, score_transforms,
        score_join, score_audit, expanded_scores, draft_overview, accepted_prefixes, slot_hits, truncation_economics, marginal_gain, conditional_hits, sign_test, draft_correlations, reference_outcomes, committed_refs,
        resume_inputs, dispatch_windows, back_pressure, mixed_batches, missing_features, question_set_match, token_frequency, reduced_vocabulary, trainable_samples, last_turn_masks, padded_batches, acceptance_of_vectors,
    )
}

# --- SQL -------------------------------------------------------------------------------------------------------------

_R = "r AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY rid ORDER BY logged_at) AS rn FROM request_stats WHERE rid IS NOT NULL) WHERE rn = 1)"
_P = f"""{_R}, p AS (SELECT run_id, index, CAST(coalesce(sum(completion_tokens), 0) AS BIGINT) AS completion_tokens, CAST(coalesce(sum(spec_verify_ct), 0) AS BIGINT) AS spec_verify_ct, max(prompt_tokens) AS prompt_tokens, max(cached_tokens) AS cached_tokens,
 lower(arg_max(finish_reason, logged_at) FILTER (WHERE finish_reason IS NOT NULL)) AS finish_reason, coalesce(sum(completion_tokens), 0) / nullif(coalesce(sum(spec_verify_ct), 0), 0)::DOUBLE AS accept_length FROM r GROUP BY run_id, index)"""
_FIN = "isfinite({0})"
_C = "c AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY ingested_at) AS rn FROM tool_use_conversation WHERE id IS NOT NULL) WHERE rn = 1)"
_S = "s AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id) AS rn FROM score_sidecar WHERE id IS NOT NULL) WHERE rn = 1)"
_B = f"""{_S},
z AS (SELECT id, CAST(floor(i / 8) AS INTEGER) AS block, i % 8 AS slot, CASE WHEN isfinite(k) THEN k END AS kl, CASE WHEN isfinite(e) THEN e END AS entropy, coalesce(e < 0.9, false) AS correct FROM (SELECT id, unnest(kl) AS k, unnest(entropy) AS e, generate_subscripts(kl, 1) - 1 AS i FROM s WHERE kl IS NOT NULL AND entropy IS NOT NULL AND len(kl) = len(entropy) AND len(kl) > 0)),
b AS (SELECT id, block, max(slot) AS last, min(slot) FILTER (WHERE slot > 0 AND NOT correct) AS miss FROM z GROUP BY id, block),
a AS (SELECT *, coalesce(miss - 1, last) AS acc FROM b)"""
_Q = f"""{_B},
o AS (SELECT list_sort(list(kl)) AS v, count(*) AS n FROM z WHERE slot > 0 AND kl IS NOT NULL),
cut AS (SELECT v[n // 4 + 1] AS q1, v[n // 2 + 1] AS q2, v[(3 * n) // 4 + 1] AS q3 FROM o),
x AS (SELECT z.*, CASE WHEN kl IS NULL THEN NULL WHEN kl <= q1 THEN 1 WHEN kl <= q2 THEN 2 WHEN kl <= q3 THEN 3 ELSE 4 END AS q FROM z, cut)"""
_REF = "ref AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY published_at) AS rn, count(*) OVER (PARTITION BY sample_id) AS deliveries FROM sample_refs WHERE sample_id IS NOT NULL) WHERE rn = 1)"
_ACK = "ack AS (SELECT DISTINCT sample_id FROM acked WHERE sample_id IS NOT NULL)"
_BUSY = """i AS (SELECT run_id, send_offset + CASE WHEN first_token_latency >= 0 THEN first_token_latency END AS a, send_offset + CASE WHEN e2e_latency >= 0 THEN e2e_latency END AS b FROM r),
j AS (SELECT *, max(b) OVER (PARTITION BY run_id ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS mb FROM i WHERE isfinite(a) AND isfinite(b) AND b > a),
k AS (SELECT *, sum(CASE WHEN mb IS NULL OR a > mb THEN 1 ELSE 0 END) OVER (PARTITION BY run_id ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS g FROM j),
busy AS (SELECT run_id, sum(e - s) AS busy FROM (SELECT run_id, g, min(a) AS s, max(b) AS e FROM k GROUP BY run_id, g) GROUP BY run_id)"""
_TOK = f"""{_C},
tm AS (SELECT id, unnest(conversations) AS m, generate_subscripts(conversations, 1) AS i FROM c WHERE len(conversations) > 0),
tt AS (SELECT id, i, m.role AS role, list_filter(regexp_split_to_array(coalesce(m.content, ''), '\\s+'), lambda w: w <> '') AS t FROM tm WHERE m IS NOT NULL)"""


def _length_sql(c: str) -> str:
    w = f"count({c}) = count(*)"
    return f"CASE WHEN {w} THEN round(avg({c}), 6) END AS {c}_mean, CASE WHEN {w} THEN median({c}) END AS {c}_median, CASE WHEN {w} THEN min({c}) END AS {c}_min, CASE WHEN {w} THEN max({c}) END AS {c}_max, CASE WHEN {w} THEN CAST(sum({c}) AS BIGINT) END AS {c}_sum"


_RANKS = "SELECT {0} AS v, avg(rn) AS rk FROM (SELECT {0}, row_number() OVER (ORDER BY {0}) AS rn FROM u) GROUP BY {0}"
_PART = "round(({0} - {1} * {2}) / sqrt((1 - {1} * {1}) * (1 - {2} * {2})), 6)"

SQL = {
    "request_samples": f"WITH {_P} SELECT run_id, index, completion_tokens, spec_verify_ct, prompt_tokens, cached_tokens, finish_reason, round(accept_length, 6) AS accept_length FROM p",
    "run_metrics": f"WITH {_R} SELECT run_id, round(coalesce(sum(completion_tokens), 0) / sum(CASE WHEN isfinite(e2e_latency) AND e2e_latency > 0 THEN e2e_latency END), 6) AS output_throughput, round(CASE WHEN coalesce(sum(spec_verify_ct), 0) > 0 THEN coalesce(sum(completion_tokens), 0) / sum(spec_verify_ct)::DOUBLE ELSE 1.0 END, 6) AS accept_length FROM r GROUP BY run_id",
    "length_summary": f"WITH {_R} SELECT run_id, {_length_sql('prompt_tokens')}, {_length_sql('completion_tokens')} FROM r GROUP BY run_id",
    "busy_time": f"WITH {_R}, {_BUSY} SELECT run_id, round(busy, 6) AS busy FROM busy",
    "throughput": f"""
WITH {_R}, {_BUSY},
t AS (SELECT run_id, count(*) AS requests, CAST(coalesce(sum(prompt_tokens), 0) AS BIGINT) AS prompt, CAST(coalesce(sum(completion_tokens), 0) AS BIGINT) AS completion, CAST(coalesce(sum(cached_tokens), 0) AS BIGINT) AS cached,
 sum(e2e_latency) FILTER (WHERE isfinite(e2e_latency) AND e2e_latency >= 0) AS e2e, avg(e2e_latency) FILTER (WHERE isfinite(e2e_latency) AND e2e_latency >= 0) AS em, sum(first_token_latency) FILTER (WHERE isfinite(first_token_latency) AND first_token_latency >= 0) AS tt, avg(first_token_latency) FILTER (WHERE isfinite(first_token_latency) AND first_token_latency >= 0) AS tm,
 sum(decode_latency) FILTER (WHERE isfinite(decode_latency) AND decode_latency >= 0) AS dec, CAST(sum(greatest(coalesce(completion_tokens, 0) - 1, 0)) AS BIGINT) AS decoded FROM r GROUP BY run_id)
SELECT t.run_id AS run_id, requests, prompt AS prompt_tokens, completion AS completion_tokens, round(completion / nullif(e2e, 0), 6) AS e2e_output_throughput, round(em + 1e-9, 6) AS e2e_latency_mean, round(prompt / nullif(tt, 0), 6) AS prefill_throughput, round(tm + 1e-9, 6) AS ttft_mean,
 round(cached / nullif(prompt, 0), 6) AS cached_prompt_share, decoded, round(decoded / nullif(dec, 0), 6) AS decode_output_throughput, round(busy, 6) AS decode_busy_time, round(decoded / nullif(busy, 0), 6) AS decode_busy_throughput, round(dec / nullif(busy, 0), 6) AS decode_overlap, round(tt / nullif(e2e, 0), 6) AS prefill_share
FROM t LEFT JOIN busy ON busy.run_id IS NOT DISTINCT FROM t.run_id AND t.run_id IS NOT NULL
""",
    "acceptance_report": f"WITH {_P} SELECT run_id, count(*) AS n, round(avg(accept_length), 6) AS mean, round(sum(accept_length * completion_tokens) / nullif(sum(completion_tokens), 0), 6) AS token_weighted_mean, round(stddev_pop(accept_length), 6) AS std, " + ", ".join(f"round(quantile_cont(accept_length, {q / 100}), 6) AS p{q}" for q in (10, 25, 50, 75, 90)) + " FROM p WHERE accept_length IS NOT NULL GROUP BY run_id",
    "acceptance_histogram": f"WITH {_P} SELECT CAST(CASE WHEN accept_length < 1 THEN 0 WHEN accept_length > 9 THEN 17 ELSE least(floor((accept_length - 1) / 0.5) + 1, 16) END AS INTEGER) AS bin, count(*) AS n FROM p WHERE accept_length IS NOT NULL GROUP BY 1",
    "acceptance_extremes": f"""
WITH {_P}, k AS (SELECT run_id || '/' || index AS key, accept_length FROM p WHERE accept_length IS NOT NULL)
SELECT * FROM (SELECT 'low' AS side, key, round(accept_length, 6) AS accept_length FROM k ORDER BY k.accept_length, key LIMIT 20) UNION ALL SELECT * FROM (SELECT 'high' AS side, key, round(accept_length, 6) AS accept_length FROM k ORDER BY k.accept_length DESC, key LIMIT 20)
""",
    "finish_reasons": f"WITH {_R} SELECT coalesce(lower(trim(finish_reason)), 'none') AS reason, count(*) AS n, CAST(coalesce(sum(completion_tokens), 0) AS BIGINT) AS tokens FROM r GROUP BY 1",
    "rate_by_run": f"""
WITH {_R}, h AS (SELECT benchmark, coalesce(lower(finish_reason) = 'stop', false)::INT AS hit FROM r JOIN runs USING (run_id)), g AS (SELECT benchmark, count(*) AS n, CAST(sum(hit) AS BIGINT) AS hits, avg(hit) AS acc FROM h GROUP BY benchmark)
SELECT benchmark, n, hits, round(acc, 6) AS accuracy FROM g UNION ALL SELECT '*micro*', CAST(sum(n) AS BIGINT), CAST(sum(hits) AS BIGINT), round(sum(hits) / sum(n), 6) FROM g UNION ALL SELECT '*macro*', CAST(sum(n) AS BIGINT), CAST(sum(hits) AS BIGINT), round(avg(acc), 6) FROM g
""",
    "average_and_worst": f"WITH {_R}, q AS (SELECT run_id, avg(h) AS m, min(h) AS w FROM (SELECT run_id, coalesce(lower(finish_reason) = 'stop', false)::INT AS h FROM r WHERE run_id IS NOT NULL) GROUP BY run_id) SELECT count(*) AS questions, round(avg(m), 6) AS average, round(avg(w), 6) AS worst FROM q",
    "step_timing": f"""
WITH {_R}, g AS (SELECT coalesce(strategy, 'none') AS strategy, sum(first_token_latency) FILTER (WHERE isfinite(first_token_latency) AND first_token_latency >= 0) AS p, sum(decode_latency) FILTER (WHERE isfinite(decode_latency) AND decode_latency >= 0) AS d, sum(spec_verify_ct) AS s FROM r JOIN runs USING (run_id) GROUP BY 1)
SELECT strategy, round(p, 4) AS prefill_s, round(d, 4) AS decode_s, round(d * 1000 / nullif(s, 0), 6) AS decode_ms_per_step, round(p / nullif(p + d, 0), 6) AS prefill_share FROM g
""",
    "benchmark_pivot": f"""
WITH {_R}, g AS (SELECT target_model, draft_model, benchmark, round(sum(completion_tokens) / nullif(sum(spec_verify_ct), 0)::DOUBLE, 4) AS v FROM r JOIN runs USING (run_id) WHERE target_model IS NOT NULL AND draft_model IS NOT NULL GROUP BY 1, 2, 3)
SELECT target_model, draft_model, """ + ", ".join(f"max(v) FILTER (WHERE benchmark = '{b}') AS {b}" for b in ("draftqa", "longread", "maskmath", "stepcheck", "tooltrace")) + " FROM g GROUP BY 1, 2",
    "run_speedups": f"""
WITH {_R}, t AS (SELECT run_id, sum(completion_tokens) / nullif(sum(e2e_latency) FILTER (WHERE isfinite(e2e_latency) AND e2e_latency > 0), 0) AS th FROM r GROUP BY run_id),
u AS (SELECT run_id, target_model AS model, block_size, started_at, th FROM runs JOIN t USING (run_id) WHERE target_model IS NOT NULL),
b AS (SELECT model, th AS base FROM (SELECT *, row_number() OVER (PARTITION BY model ORDER BY started_at, run_id) AS k FROM u WHERE coalesce(block_size, 0) = 0 AND started_at IS NOT NULL) WHERE k = 1)
SELECT run_id, model, round(th / nullif(base, 0), 4) AS speedup FROM u LEFT JOIN b USING (model)
""",
    "complete_benchmarks": f"""
WITH {_R}, g AS (SELECT draft_model, benchmark, avg(completion_tokens) AS v FROM r JOIN runs USING (run_id) WHERE draft_model IS NOT NULL AND benchmark IS NOT NULL GROUP BY 1, 2)
SELECT draft_model, count(DISTINCT benchmark) AS members, round(avg(v), 6) AS mean FROM g GROUP BY 1 HAVING count(DISTINCT benchmark) = (SELECT count(DISTINCT benchmark) FROM g)
""",
    "request_correlations": f"""
WITH {_R}, u AS (SELECT completion_tokens::DOUBLE AS x, e2e_latency AS y, prompt_tokens::DOUBLE AS z FROM r WHERE e2e_latency >= 0 AND completion_tokens IS NOT NULL AND prompt_tokens IS NOT NULL),
rx AS ({_RANKS.format('x')}), ry AS ({_RANKS.format('y')}), k AS (SELECT corr(x, y) AS xy, corr(x, z) AS xz, corr(y, z) AS yz FROM u), sp AS (SELECT corr(rx.rk, ry.rk) AS sp FROM u JOIN rx ON u.x = rx.v JOIN ry ON u.y = ry.v)
SELECT round(xy, 6) AS pearson, round(sp, 6) AS spearman, {_PART.format('xy', 'xz', 'yz')} AS partial FROM k, sp
""",
    "completion_buckets": f"""
WITH {_R}, u AS (SELECT completion_tokens AS x, row_number() OVER (ORDER BY completion_tokens, prompt_tokens NULLS FIRST) - 1 AS g, count(*) OVER () AS n FROM r WHERE completion_tokens IS NOT NULL)
SELECT CAST(floor(((g + 1) * 7 - 1) / n) AS INTEGER) AS bucket, count(*) AS n, min(x) AS low, max(x) AS high FROM u GROUP BY 1
""",
    "token_quartiles": f"""
WITH {_R}, u AS (SELECT completion_tokens AS x, prompt_tokens AS y FROM r WHERE completion_tokens IS NOT NULL AND prompt_tokens IS NOT NULL), l AS (SELECT list_sort(list(x)) AS a, list_sort(list(y)) AS b, count(*) AS n FROM u)
SELECT CAST((x >= a[CAST(floor(n * 0.25) AS BIGINT) + 1])::INT + (x >= a[CAST(floor(n * 0.5) AS BIGINT) + 1])::INT + (x >= a[CAST(floor(n * 0.75) AS BIGINT) + 1])::INT AS INTEGER) AS row_bucket,
 CAST((y >= b[CAST(floor(n * 0.25) AS BIGINT) + 1])::INT + (y >= b[CAST(floor(n * 0.5) AS BIGINT) + 1])::INT + (y >= b[CAST(floor(n * 0.75) AS BIGINT) + 1])::INT AS INTEGER) AS column_bucket, count(*) AS n FROM u, l GROUP BY 1, 2
""",
    "entropy_series": f"""
WITH {_S}, v AS (SELECT id, list_filter(coalesce(entropy, []), lambda x: x IS NOT NULL AND isfinite(x)) AS v FROM s)
SELECT id, CAST(len(v) AS INTEGER) AS n, round(list_avg(v), 6) AS mean, round(list_aggregate(v, 'quantile_cont', 0.1), 6) AS p10, round(list_aggregate(v, 'quantile_cont', 0.5), 6) AS p50, round(list_aggregate(v, 'quantile_cont', 0.9), 6) AS p90,
 round(len(list_filter(v, lambda x: x < 0.1)) / nullif(len(v), 0)::DOUBLE, 6) AS below, round(len(list_filter(v, lambda x: x > 1.0)) / nullif(len(v), 0)::DOUBLE, 6) AS above FROM v
""",
    "entropy_deciles": f"""
WITH {_S}, e AS (SELECT id, unnest(entropy) AS x, generate_subscripts(entropy, 1) AS p, len(entropy) AS n FROM s WHERE len(entropy) >= 10),
t AS (SELECT id, x, ntile(10) OVER (PARTITION BY id ORDER BY p) - 1 AS d FROM e), m AS (SELECT id, d, avg(x) AS m FROM t WHERE isfinite(x) GROUP BY id, d)
SELECT CAST(d AS INTEGER) AS decile, round(avg(m), 6) AS mean, count(*) AS n_series FROM m GROUP BY d
""",
    "position_metrics": f"WITH {_B} SELECT CAST(slot AS INTEGER) AS pos, round(avg(correct::INT), 6) AS accuracy, round(sum(coalesce(kl, 0)) / count(*), 6) AS loss FROM z GROUP BY slot",
    "simulated_acceptance": f"WITH {_B}, p AS (SELECT slot, round(avg(correct::INT), 6) AS a FROM z GROUP BY slot), q AS (SELECT product(a) OVER (ORDER BY slot) AS c FROM p) SELECT round(sum(c), 6) AS acceptance, CAST(count(*) AS INTEGER) AS positions FROM q",
    "score_edges": f"WITH {_S}, v AS (SELECT unnest(kl) AS k FROM s) SELECT i AS k, round((SELECT list_extract(quantile_cont(k, [x / 100.0 for x in range(0, 101)]), CAST(i + 1 AS BIGINT)) FROM v WHERE isfinite(k)), 9) AS edge FROM range(0, 101) t(i)",
    "score_stats": f"""
WITH {_S}, v AS (SELECT unnest(kl) AS k FROM s), f AS (SELECT k FROM v WHERE isfinite(k)), e AS (SELECT quantile_cont(k, [x / 100.0 for x in range(0, 101)]) AS e FROM f),
g AS (SELECT len(list_filter(e, lambda x: x <= k)) / 101.0::DOUBLE AS g FROM f, e)
SELECT (SELECT count(*) FROM s WHERE len(kl) > 0) AS n_rows, count(*) AS n_values, round(avg(g), 6) AS mean, round(avg((g >= 0.5)::INT), 6) AS over_half, round(avg((g >= 0.75)::INT), 6) AS over_three_quarters FROM g
""",
    "score_transforms": f"""
WITH {_S}, z AS (SELECT unnest(kl) AS k, unnest(entropy) AS e FROM s WHERE kl IS NOT NULL AND entropy IS NOT NULL AND len(kl) = len(entropy)), f AS (SELECT CASE WHEN isfinite(k) THEN k END AS k, CASE WHEN isfinite(e) THEN e END AS e FROM z),
h AS (SELECT k, e, CASE WHEN k IS NOT NULL THEN least(1.0::DOUBLE, greatest(0.0::DOUBLE, k)) END AS g FROM f)
SELECT count(k) AS n, round(sum((k >= 0.5)::INT::DOUBLE), 6) AS binary, round(sum(greatest(k, 0) / (greatest(k, 0) + 0.5)) FILTER (WHERE k IS NOT NULL), 4) AS saturated, round(sum(g), 4) AS identity, round(sum(g * exp(-greatest(e, 0))) FILTER (WHERE e IS NOT NULL), 4) AS gated, CAST(sum(coalesce(CAST(round_even(g * 10000, 0) AS INTEGER), -1)) AS BIGINT) AS quantised FROM h
""",
    "score_join": f"WITH {_C}, {_S} SELECT CASE WHEN c.image IS NULL THEN 'text' WHEN s.id IS NOT NULL THEN 'scored' ELSE 'missing' END AS status, count(*) AS n, CAST(coalesce(sum(n_loss), 0) AS BIGINT) AS n_loss FROM c LEFT JOIN s ON s.id = c.id GROUP BY 1",
    "score_audit": f"""
WITH {_C}, p AS (SELECT id, count(*) AS k, max((kl IS NULL OR entropy IS NULL)::INT) AS nulls, max((coalesce(len(kl) <> len(entropy), false) OR coalesce(len(kl) <> n_loss, false))::INT) AS ragged,
 max((coalesce(len(list_filter(kl, lambda x: x IS NULL OR NOT isfinite(x))) > 0, false) OR coalesce(len(list_filter(entropy, lambda x: x IS NULL OR NOT isfinite(x))) > 0, false))::INT) AS wild, max(coalesce(n_loss > 60, false)::INT) AS long FROM score_sidecar GROUP BY id)
SELECT CAST(coalesce(sum(k), 0) AS BIGINT) AS n_rows, count(*) FILTER (WHERE k > 1) AS repeated_ids, CAST(coalesce(sum(nulls), 0) AS BIGINT) AS null_ids, CAST(coalesce(sum(ragged), 0) AS BIGINT) AS ragged_ids, CAST(coalesce(sum(wild), 0) AS BIGINT) AS wild_ids, CAST(coalesce(sum(long), 0) AS BIGINT) AS long_ids,
 count(*) FILTER (WHERE k IS NOT NULL AND c.id IS NULL) AS orphan_ids, count(*) FILTER (WHERE k IS NULL) AS unscored_records FROM p FULL JOIN c ON p.id = c.id
""",
    "expanded_scores": f"WITH {_S} SELECT id, CAST(len(kl) * 3 AS INTEGER) AS n, CAST(len(kl) * 2 + len(list_filter(kl, lambda x: x = -1.0)) AS INTEGER) AS n_fill FROM s WHERE len(kl) > 0",
    "draft_overview": f"WITH {_B} SELECT count(*) AS n_blocks, round(avg(acc), 6) AS mean, round(median(acc), 6) AS median, round(sum(least(acc, 1)) / sum(acc), 6) AS kept_1, round(sum(least(acc, 3)) / sum(acc), 6) AS kept_3, round(sum(least(acc, 7)) / sum(acc), 6) AS kept_7 FROM a",
    "accepted_prefixes": f"""
WITH {_B}, bad AS (SELECT id, block, min(slot) FILTER (WHERE NOT correct AND kl IS NOT NULL) AS stop FROM z GROUP BY id, block),
pre AS (SELECT z.id, z.block, count(*) FILTER (WHERE correct AND kl IS NOT NULL AND (stop IS NULL OR slot < stop)) AS prefix FROM z JOIN bad ON bad.id = z.id AND bad.block = z.block GROUP BY 1, 2)
SELECT CAST(prefix AS INTEGER) AS prefix, CAST(acc AS INTEGER) AS accepted, count(*) AS n FROM pre JOIN a ON a.id = pre.id AND a.block = pre.block GROUP BY 1, 2
""",
    "slot_hits": f"WITH {_Q} SELECT CASE WHEN slot <= 3 THEN '1-3' WHEN slot <= 7 THEN '4-7' WHEN slot <= 11 THEN '8-11' ELSE '12-' END AS band, CAST(q AS INTEGER) AS quartile, count(*) AS n, CAST(sum(correct::INT) AS BIGINT) AS hits FROM x WHERE slot > 0 AND q IS NOT NULL GROUP BY 1, 2",
    "truncation_economics": f"""
WITH {_Q}, w AS (SELECT a.id, a.block, a.miss, x.q AS cq FROM a JOIN x ON x.id = a.id AND x.block = a.block AND x.slot = a.miss), bh AS (SELECT w.cq, x.q FROM w JOIN x ON x.id = w.id AND x.block = w.block AND x.slot > w.miss AND x.correct),
n AS (SELECT unnest([1, 2, 3, 4]) AS quartile)
SELECT * FROM (SELECT quartile, (SELECT count(*) FROM w WHERE cq = quartile) AS culprits, (SELECT count(*) FROM bh WHERE q = quartile) AS discarded_own, (SELECT count(*) FROM bh WHERE cq = quartile) AS discarded_by FROM n) WHERE culprits + discarded_own + discarded_by > 0
UNION ALL SELECT 0, count(miss), CAST(sum(acc) AS BIGINT), count(*) FROM a
""",
    "marginal_gain": f"""
WITH {_Q}, nx AS (SELECT a.id, a.block, a.miss, a.last, min(z.slot) AS next FROM a LEFT JOIN z ON z.id = a.id AND z.block = a.block AND z.slot > a.miss AND NOT z.correct WHERE a.miss IS NOT NULL GROUP BY 1, 2, 3, 4)
SELECT CAST(x.q AS INTEGER) AS quartile, count(*) AS n, round(avg(1 + coalesce(next - miss - 1, last - miss)), 6) AS gain FROM nx JOIN x ON x.id = nx.id AND x.block = nx.block AND x.slot = nx.miss WHERE x.q IS NOT NULL GROUP BY 1
""",
    "conditional_hits": f"WITH {_Q} SELECT CAST(l.q AS INTEGER) AS first, count(*) AS n, CAST(sum(r.correct::INT) AS BIGINT) AS hits FROM x l JOIN x r ON l.id = r.id AND l.block = r.block AND r.slot > l.slot WHERE l.slot > 0 AND l.q IN (1, 4) AND r.q = 1 GROUP BY 1",
    "sign_test": f"WITH {_Q}, p AS (SELECT id, count(*) FILTER (WHERE q = 1) AS n1, count(*) FILTER (WHERE q = 4) AS n4, avg(correct::INT) FILTER (WHERE q = 1) AS h1, avg(correct::INT) FILTER (WHERE q = 4) AS h4 FROM x WHERE slot > 0 GROUP BY id) SELECT count(*) AS n_ids, count(*) FILTER (WHERE h4 < h1) AS worse FROM p WHERE n1 >= 2 AND n4 >= 2",
    "draft_correlations": f"""
WITH {_B}, u AS (SELECT kl, correct::INT::DOUBLE AS hit, slot::DOUBLE AS slot, entropy FROM z WHERE slot > 0 AND kl IS NOT NULL AND entropy IS NOT NULL), k AS (SELECT count(*) AS n, corr(kl, hit) AS kh, corr(kl, slot) AS ks, corr(slot, hit) AS sh, corr(kl, entropy) AS ke, corr(entropy, hit) AS eh FROM u)
SELECT n, round(kh, 6) AS kl_hit, {_PART.format('kh', 'ks', 'sh')} AS kl_hit_at_slot, {_PART.format('kh', 'ke', 'eh')} AS kl_hit_at_entropy FROM k
""",
    "reference_outcomes": f"WITH {_REF}, {_ACK} SELECT CASE WHEN ref.sample_id IS NULL THEN 'unknown' WHEN ack.sample_id IS NULL THEN 'requeued' ELSE 'released' END AS outcome, count(*) AS n, min(coalesce(ref.sample_id, ack.sample_id)) AS first_id FROM ref FULL JOIN ack ON ref.sample_id = ack.sample_id GROUP BY 1",
    "committed_refs": f"WITH {_REF} SELECT sample_id, run_id, strategy, num_tokens, deliveries FROM ref",
    "resume_inputs": f"WITH {_C} SELECT id FROM c WHERE id NOT IN (SELECT source_task_id FROM sample_refs WHERE source_task_id IS NOT NULL UNION SELECT id FROM score_sidecar WHERE id IS NOT NULL)",
    "dispatch_windows": f"WITH {_REF}, i AS (SELECT sample_id, row_number() OVER (ORDER BY published_at, sample_id) - 1 AS i FROM ref) SELECT sample_id, CAST(floor(i / 32) AS BIGINT) AS \"window\", CAST(i % 4 AS INTEGER) AS rank, CAST(floor((i % 32) / 4) AS INTEGER) AS round FROM i WHERE floor(i / 32) < (SELECT floor(count(*) / 32) FROM ref)",
    "back_pressure": f"""
WITH {_REF}, f AS (SELECT sample_id, min(acked_at) AS acked_at FROM acked WHERE sample_id IS NOT NULL AND acked_at IS NOT NULL GROUP BY 1),
e AS (SELECT run_id, sample_id, published_at AS moment, 1 AS dn, coalesce(estimated_bytes, 0) AS db FROM ref UNION ALL SELECT run_id, sample_id, greatest(acked_at, published_at), -1, -coalesce(estimated_bytes, 0) FROM ref JOIN f USING (sample_id)),
q AS (SELECT *, sum(dn) OVER w AS n, sum(db) OVER w AS bytes FROM e WINDOW w AS (PARTITION BY run_id ORDER BY moment, dn DESC, sample_id ROWS UNBOUNDED PRECEDING)),
x AS (SELECT *, CASE WHEN n >= 6 OR bytes >= 400000 THEN 1 WHEN n <= 2 AND bytes <= 150000 THEN 0 END AS c FROM q),
y AS (SELECT *, coalesce(last_value(c IGNORE NULLS) OVER (PARTITION BY run_id ORDER BY moment, dn DESC, sample_id ROWS UNBOUNDED PRECEDING), 0) AS paused FROM x)
SELECT run_id, count(*) AS events, CAST(sum(paused) AS BIGINT) AS paused, CAST(max(n) AS BIGINT) AS deepest FROM y GROUP BY run_id
""",
    "mixed_batches": f"""
WITH {_REF}, i AS (SELECT *, row_number() OVER (ORDER BY published_at, sample_id) - 1 AS i FROM ref)
SELECT CAST(floor(i / 16) AS BIGINT) AS "window", count(*) AS n, count(DISTINCT strategy) AS strategies, count(DISTINCT schema_version) AS versions, count(DISTINCT strategy) <= 1 AND count(DISTINCT schema_version) <= 1 AS ok FROM i WHERE floor(i / 16) < (SELECT floor(count(*) / 16) FROM ref) GROUP BY 1
""",
    "missing_features": f"WITH {_REF}, k AS (SELECT unnest(['input_ids', 'loss_mask', 'hidden_state']) AS feature) SELECT feature, count(*) AS n FROM ref, k WHERE NOT list_contains(coalesce(map_keys(feature_keys), []), feature) OR NOT list_contains(coalesce(map_keys(feature_specs), []), feature) GROUP BY 1",
    "question_set_match": "WITH p AS (SELECT text, row_number() OVER (ORDER BY item_id) - 1 AS p FROM eval_items), o AS (SELECT p, text AS a, CASE WHEN p = 123 THEN 'changed' ELSE text END AS b FROM p) SELECT count(*) AS n_a, count(*) AS n_b, min(p) FILTER (WHERE a <> b) AS first FROM o",
    "token_frequency": f"WITH {_TOK}, u AS (SELECT unnest(t) AS token FROM tt WHERE role = 'assistant') SELECT token, count(*) AS n FROM u GROUP BY 1",
    "reduced_vocabulary": f"""
WITH {_TOK}, u AS (SELECT unnest(t) AS token FROM tt WHERE role = 'assistant'), g AS (SELECT token, count(*) AS n FROM u GROUP BY 1), k AS (SELECT * FROM g ORDER BY n DESC, token LIMIT 500)
SELECT CAST(row_number() OVER (ORDER BY token) - 1 AS INTEGER) AS draft_id, token, n, round((SELECT sum(n) FROM k) / (SELECT sum(n) FROM g), 6) AS coverage FROM k
""",
    "trainable_samples": f"""
WITH {_TOK}, u AS (SELECT id, i, role, unnest(t) AS token, generate_subscripts(t, 1) AS j FROM tt), w AS (SELECT id, role, row_number() OVER (PARTITION BY id ORDER BY i, j) AS p FROM u)
SELECT id, CAST(count(*) AS INTEGER) AS n_tokens, CAST(count(*) FILTER (WHERE role = 'assistant') AS INTEGER) AS n_trainable FROM w WHERE p <= 256 GROUP BY id HAVING count(*) FILTER (WHERE role = 'assistant') >= 64
""",
    "last_turn_masks": f"""
WITH {_TOK}, l AS (SELECT id, max(i) FILTER (WHERE role = 'assistant') AS l FROM tt GROUP BY id)
SELECT id, CAST(sum(len(t)) AS INTEGER) AS n_tokens, CAST(coalesce(sum(len(t)) FILTER (WHERE i = l), 0) AS INTEGER) AS n_trainable FROM tt JOIN l USING (id) GROUP BY id
""",
    "padded_batches": f"WITH {_S}, p AS (SELECT len(kl) AS n, CAST(floor((row_number() OVER (ORDER BY id) - 1) / 8) AS BIGINT) AS batch FROM s WHERE kl IS NOT NULL) SELECT batch, CAST(ceil(max(n) / 4.0) * 4 AS INTEGER) AS width, CAST(ceil(max(n) / 4.0) * 4 AS INTEGER) AS narrowest, count(*) AS n FROM p GROUP BY batch",
    "acceptance_of_vectors": """
WITH e AS (SELECT vec_id, list_transform(embedding, lambda v: exp(v::DOUBLE - list_max(embedding)::DOUBLE)) AS e FROM embeddings), p AS (SELECT vec_id, list_transform(e, lambda v: v / list_sum(e)) AS p FROM e),
j AS (SELECT a.vec_id, a.p AS p, b.p AS q FROM p a JOIN p b ON b.vec_id = a.vec_id + 1),
k AS (SELECT vec_id, list_sum(list_transform(list_zip(p, q), lambda z: least(z[1], z[2]))) AS a, list_sum(list_transform(list_zip(p, q), lambda z: CASE WHEN z[1] > 0 AND z[2] > 0 THEN z[1] * ln(z[1] / z[2]) ELSE 0 END)) AS k,
 greatest(0, -list_sum(list_transform(p[1:32], lambda v: CASE WHEN v > 0 THEN v * ln(v) ELSE 0 END)) - CASE WHEN 1 - list_sum(p[1:32]) > 0 THEN (1 - list_sum(p[1:32])) * ln(1 - list_sum(p[1:32])) ELSE 0 END) AS h FROM j)
SELECT vec_id, round(a, 6) AS acceptance, round(k, 6) AS divergence, round(h, 6) AS entropy, round(exp(-2 * a) * k + (1 - exp(-2 * a)) * (1 - a), 6) AS loss FROM k
""",
}
