"""Queries of gates, candidate selection, lookups, run checks, leases and further metrics; with DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarrymill.functions import text as X
from quarrymill.operators import blocks as B
from quarrymill.operators import gates as G
from quarrymill.operators import ledger as L
from quarrymill.operators import metrics as M
from quarrymill.operators import sampling as O
from quarrymill.operators import scores as S
from quarrymill.operators import tokens as T
from quarrymill.plans import eval_queries as E
from quarrymill.plans.corpus_queries import _C, _CFG, _FOLD, CONV, once
from quarrymill.session import table
from quarrymill.sources import readers as RD
from quarrymill.sources import sinks as K

c, lit = F.col, F.lit


def sequence_checks(spark: SparkSession, d: str) -> DataFrame:
    """Why made token sequences can't be samples."""
    s = table(spark, d, "score_sidecar").select(F.size("kl").alias("n"), "n_loss").where("n > 0").groupBy("n", "n_loss").agg(F.count("*").alias("k"))
    v = F.transform(F.sequence(lit(1), c("n")), lambda i: F.when((i == 3) & (c("n") % 4 == 0), lit(None).cast("int")).when((i == 2) & (c("n") % 4 == 1), -1).otherwise(i))
    m = F.transform(F.sequence(lit(1), c("n") + (c("n") % 5 == 2).cast("int")), lambda i: F.when((i == 1) & (c("n") % 7 == 3), 2).otherwise(i % 2))
    return s.groupBy(G.sequence_error(F.when(c("n") % 11 != 0, v), m).alias("error")).agg(F.sum("k").alias("n"))


def single_turns(spark: SparkSession, d: str) -> DataFrame:
    """Conversations of one question and one answer, by what their reasoning may be."""
    o = table(spark, d, CONV).where("id IS NOT NULL").select("id", "image", "conversations")
    out = None
    for policy in ("allow", "forbidden", "required"):
        part = G.single_turn(o, policy).select("id").distinct().agg(F.count("*").alias("n")).select(lit(policy).alias("policy"), "n")
        out = part if out is None else out.unionByName(part)
    return out


def first_samples(spark: SparkSession, d: str) -> DataFrame:
    """The first sequence in id order with enough trained tokens that isn't too long."""
    s = S.once(table(spark, d, "score_sidecar").select("id", F.size("kl").alias("n"))).where("n > 0")
    q = s.select("id", F.sequence(lit(1), c("n")).alias("tokens"), F.transform(F.sequence(lit(1), c("n")), lambda i: i % 2).alias("mask"))
    pick = G.first_qualifying(q, "id", least=12, longest=40).select(lit("bounded").alias("rule"), "id").unionByName(G.first_qualifying(q, "id", least=30).select(lit("long").alias("rule"), "id"))
    return pick.unionByName(T.within_length(q, 30).agg(F.min("id").alias("id")).select(lit("within").alias("rule"), "id"))


FAMILY = [("opsdiary", "operations"), ("Stepwise QA", "reasoning"), ("tool", "tools"), ("draftbench", "drafts")]


def family_rows(spark: SparkSession, d: str) -> DataFrame:
    """Conversations of two task families, by the configuration in their id or by their source."""
    o = table(spark, d, CONV).where("id IS NOT NULL").select("id", "source")
    return G.of_family(o, spark.createDataFrame(FAMILY, "handle STRING, family STRING"), ["reasoning", "tools"]).select("id").distinct()


def run_thresholds(spark: SparkSession, d: str) -> DataFrame:
    """Final figures of runs against thresholds, all misses together."""
    m = M.run_metrics(E.requests(spark, d)).where("run_id IS NOT NULL")
    return G.threshold_errors(m.withColumn("steps", F.length("run_id")), {"accept_length": 2.5, "steps": 8}, {"output_throughput": 120.0}).select("run_id", F.size(F.split("errors", "; ")).alias("n_errors"), c("errors").isNull().alias("passed"))


def serving_checks(spark: SparkSession, d: str) -> DataFrame:
    """A served answer against the expected one: acceptance, matching prefix, reasoning left in the history."""
    o = table(spark, d, CONV).where("id IS NOT NULL AND size(conversations) > 1").select("id", c("conversations").alias("history"), F.size("conversations").alias("n")).withColumn("accept_length", (c("n") % 9).cast("double"))
    w = T.whitespace_tokens(F.get("history", 1).content)
    s = G.serving_errors(o.withColumn("expected", w).withColumn("got", F.when(c("n") % 2 == 0, w).otherwise(F.concat(F.slice(w, 1, 2), F.array(lit("?"))))), 4)
    return s.select("id", F.array_join("errors", "; ").alias("errors")).dropDuplicates(["id"])


def unscored_shares(spark: SparkSession, d: str) -> DataFrame:
    """How many picture rows have no score, and whether that is an error."""
    rec = once(spark, d, "image").select("id", c("image").isNotNull().alias("has_image"))
    j = S.join_scores(rec, table(spark, d, "score_sidecar"))
    out = [G.unscored_level(j, limit).select(lit(limit).alias("max_share"), "n", "missing", F.round("share", 6).alias("share"), "level") for limit in (0.2, 0.99)]
    return out[0].unionByName(out[1])


def counter_deltas(spark: SparkSession, d: str) -> DataFrame:
    """Tokens by finish reason between two snapshots of counters."""
    r = E.requests(spark, d).select(F.coalesce(F.lower(F.trim("finish_reason")), lit("none")).alias("k"), F.coalesce("completion_tokens", lit(0)).cast("double").alias("v"), (c("index") % 3).alias("part"))
    snap = lambda parts: r.where(c("part") < parts).groupBy("k").agg(F.sum("v").alias("v")).select(F.create_map("k", "v").alias("counters"))
    return G.counter_deltas(snap(1), snap(3), "counters").select("key", F.round("delta", 3).alias("delta"))


def fallback_lookup(spark: SparkSession, d: str) -> DataFrame:
    """Block sizes of runs from a first table that lacks some, then from a second."""
    r = table(spark, d, "runs")
    first = r.where("block_size >= 8").select("run_id", c("block_size").alias("v"))
    second = r.where("block_size IS NOT NULL").select("run_id", (-c("block_size")).alias("v"))
    return G.lookup_with_fallback(r.select("run_id"), "run_id", first, second, "v")


def aligned_drafts(spark: SparkSession, d: str) -> DataFrame:
    """Slots of the same blocks under two drafts, by whether each is right."""
    a = E.blocks_of(spark, d)
    b = a.where("block % 3 <> 1").withColumn("correct", F.transform("kl", lambda k: F.coalesce(k < 0.7, lit(False))))
    return G.aligned_drafts(a, b).groupBy("slot", "correct_a", "correct_b").agg(F.count("*").alias("n"))


def attention_measures(spark: SparkSession, d: str) -> DataFrame:
    """Support, overlap of the largest places and divergence of neighbouring vectors as distributions."""
    e = table(spark, d, "embeddings").select("vec_id", S.softmax(c("embedding")).alias("p"))
    j = e.join(e.select((c("vec_id") - 1).alias("vec_id"), c("p").alias("q")), "vec_id")
    mid = F.zip_with("p", "q", lambda x, y: (x + y) / 2)
    js = j.select("vec_id", "p", "q", mid.alias("m")).select("vec_id", "p", "q", ((S.kl_divergence(c("p"), c("m")) + S.kl_divergence(c("q"), c("m"))) / 2).alias("js"))
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda u, v: u * v), lit(0.0), lambda s, v: s + v)
    return js.select("vec_id", F.round(G.effective_support(c("p")), 4).alias("support"), G.top_overlap(c("p"), c("q"), 16).alias("overlap"), F.round("js", 8).alias("js"), F.round(dot("p", "q") / F.sqrt(dot("p", "p") * dot("q", "q")), 6).alias("cosine"))


def score_losses(spark: SparkSession, d: str) -> DataFrame:
    """Entropy of the largest probabilities with the rest in one bucket, and losses from acceptance."""
    e = table(spark, d, "embeddings").select("vec_id", S.softmax(c("embedding")).alias("p"))
    top = F.slice(F.reverse(F.array_sort("p")), 1, 8)
    return e.select("vec_id", F.round(S.tail_entropy(top), 6).alias("entropy"), F.round(-F.log(F.element_at(F.array_sort("p"), -1)), 6).alias("surprise"), F.round(S.mixed_loss(F.element_at(F.array_sort("p"), -1) * 20, lit(0.25), scale=0.9), 6).alias("loss"))


def lease_states(spark: SparkSession, d: str) -> DataFrame:
    """Attempts and outcomes of tasks in a log made of the requests: stopped ones are done, others failed."""
    r = E.requests(spark, d).where("run_id IS NOT NULL").select(F.concat_ws("/", "run_id", c("index") % 7).alias("task_id"), c("logged_at").alias("at"), F.when(F.coalesce(F.lower("finish_reason"), lit("")) == "stop", "done").otherwise("failed").alias("kind"), c("index"))
    log = r.where("kind = 'failed' OR index % 5 = 0").drop("index").unionByName(r.drop("index").withColumn("kind", lit("leased")))
    return G.lease_outcomes(log, 3).select("task_id", c("attempts").cast("int").alias("attempts"), "outcome")


def feature_states(spark: SparkSession, d: str) -> DataFrame:
    """What a feature store holds after puts, releases and stale releases."""
    r = table(spark, d, "sample_refs").where("sample_id IS NOT NULL").withColumn("generation", F.row_number().over(Window.partitionBy("sample_id").orderBy("published_at", "run_id")))
    put = r.select("sample_id", c("published_at").alias("at"), lit("put").alias("op"), "generation", F.coalesce("estimated_bytes", lit(0)).alias("bytes"))
    gone = table(spark, d, "acked").where("sample_id IS NOT NULL").select("sample_id", c("acked_at").alias("at"), lit("release").alias("op"), lit(1).alias("generation"), lit(0).cast("bigint").alias("bytes"))
    return G.stored_features(put.unionByName(gone), 10_000_000).groupBy("state", "over_budget").agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes"))


def in_flight(spark: SparkSession, d: str) -> DataFrame:
    """References of a run that were published but not consumed."""
    p = L.committed(table(spark, d, "sample_refs")).where("run_id IS NOT NULL").select("sample_id", "run_id")
    return G.in_flight(p, p.join(table(spark, d, "acked").select("sample_id").distinct(), "sample_id", "left_semi"), "run_id")


def prefix_acks(spark: SparkSession, d: str) -> DataFrame:
    """Whether a run's acknowledgements are those of its first leases."""
    p = L.committed(table(spark, d, "sample_refs")).where("run_id IS NOT NULL").withColumn("n", F.row_number().over(Window.partitionBy("run_id").orderBy("published_at", "sample_id")))
    return G.prefix_errors(p.select("run_id", "n", "sample_id"), table(spark, d, "acked"), "run_id", "n", "sample_id")


def step_horizons(spark: SparkSession, d: str) -> DataFrame:
    """Steps of training on each benchmark's items, or why there is none."""
    sizes = {r.benchmark: r.n for r in table(spark, d, "eval_items").groupBy("benchmark").agg(F.count("*").alias("n")).collect()}  # one row a benchmark
    rows = []
    for name, n in sizes.items():
        for batch, accumulation in ((2, 3), (8, 8), (0, 1)):
            try:
                h = G.horizon(n, batch, accumulation, 2, 3)
                rows.append((name, batch, h["batches_per_epoch"], h["steps"], h["dropped_batches"], None))
            except ValueError as e:
                rows.append((name, batch, None, None, None, str(e)))
    return spark.createDataFrame(rows, "benchmark STRING, batch INT, batches INT, steps INT, dropped INT, error STRING")


def key_choices(spark: SparkSession, d: str) -> DataFrame:
    """Two items a category by seeded order."""
    return G.seeded_choice(table(spark, d, "eval_items").select(F.coalesce("category", lit("none")).alias("category"), "item_id"), "category", "item_id", 2, 13)


def head_rows(spark: SparkSession, d: str) -> DataFrame:
    """The first 100 documents, and 100 by seeded order: a cap and a sample of a fixed size."""
    doc = table(spark, d, "documents").select("doc_id")
    return O.head(doc, 100, "doc_id").select(lit("head").alias("part"), "doc_id").unionByName(O.head(doc, 100, O.ticket(23, "doc_id"), "doc_id").select(lit("sample").alias("part"), "doc_id"))


def batch_slices(spark: SparkSession, d: str) -> DataFrame:
    """The contiguous quarter of each whole batch of 16 that belongs to one rank."""
    e = O.global_rank(table(spark, d, "eval_items").select("item_id"), [c("item_id")], "position")
    return O.batches(e, "position", 16).where(G.batch_slice(c("position"), 16, 2, 4)).select("batch", "item_id")


def frame_windows(spark: SparkSession, d: str) -> DataFrame:
    """Frames of time windows of made clips: evenly spaced, ends included."""
    r = table(spark, d, "runs").where("block_size IS NOT NULL").select("run_id", c("block_size").cast("double").alias("b"), (c("block_size") * 40).cast("bigint").alias("total"))
    w = O.window_positions(c("b") / 4, c("b") / 2 + 3, lit(4.0), c("total"), 5)
    return r.select("run_id", F.array_join(w.cast("array<string>"), ",").alias("frames"))


def position_lookup(spark: SparkSession, d: str) -> DataFrame:
    """Parallel lists joined by position: the n-th item of each benchmark with its n-th example."""
    w = lambda o: F.row_number().over(Window.partitionBy("benchmark").orderBy(o))
    e = table(spark, d, "eval_items").select("benchmark", "item_id", w(F.col("item_id")).alias("n"))
    shots = table(spark, d, "eval_items").select("benchmark", c("item_id").alias("shot_id"), w(F.col("item_id").desc()).alias("n"))
    return e.join(shots, ["benchmark", "n"]).select("item_id", "shot_id")


def generation_records(spark: SparkSession, d: str) -> DataFrame:
    """Requests with their run and the entropy that was measured for the same number, where there is any."""
    q = E.requests(spark, d).where("rid IS NOT NULL AND run_id IS NOT NULL").select("rid", "run_id", "index")
    s = S.once(table(spark, d, "score_sidecar").select("id", "n_tokens")).withColumn("index", F.substring_index("id", "#", -1).try_cast("int")).groupBy("index").agg(F.max("n_tokens").alias("n_tokens"))
    return K.generation_dump(q, table(spark, d, "runs").select("run_id", "benchmark"), lit_key(s), ["run_id"], ["index"]).groupBy("benchmark").agg(F.count("*").alias("n"), F.count("n_tokens").alias("matched"))


def lit_key(df: DataFrame) -> DataFrame:
    return df.where("index IS NOT NULL")


def method_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Throughput of each strategy against a baseline strategy on the same benchmark."""
    r = E.requests(spark, d).join(table(spark, d, "runs").where("strategy IS NOT NULL AND benchmark IS NOT NULL").select("run_id", "strategy", "benchmark"), "run_id")
    t = r.groupBy("strategy", "benchmark").agg(F.try_divide(F.sum("completion_tokens"), F.sum(F.when(M.finite(c("e2e_latency")) > 0, c("e2e_latency")))).alias("v"))
    return L.against_baseline(t, ["benchmark"], "strategy", "dflash", "v")


def rank_means(spark: SparkSession, d: str) -> DataFrame:
    """Ratios of sums over runs, and plain means of scalars."""
    r = E.requests(spark, d).groupBy("run_id").agg(F.sum("completion_tokens").alias("a"), F.sum("spec_verify_ct").alias("b"), F.sum("cached_tokens").alias("e"), F.sum("prompt_tokens").alias("f"))
    return M.ratio_metrics(r.na.fill(0), {"accept": ("a", "b"), "cached": ("e", "f")}, ["a", "f"])


def block_acceptance(spark: SparkSession, d: str) -> DataFrame:
    return B.accept_by_block(E.blocks_of(spark, d))


def pooled_entropy(spark: SparkSession, d: str) -> DataFrame:
    return M.pooled_series(S.once(table(spark, d, "score_sidecar").select("id", "entropy")), "entropy")


def request_totals(spark: SparkSession, d: str) -> DataFrame:
    """Tokens over elapsed time, and the mean of requests' own acceptance (not weighted by tokens)."""
    p = M.per_request(E.requests(spark, d)).where("run_id IS NOT NULL")
    span = E.requests(spark, d).where("e2e_latency >= 0").groupBy("run_id").agg(F.max(c("send_offset") + c("e2e_latency")).alias("elapsed"))
    t = p.groupBy("run_id").agg(F.sum("completion_tokens").alias("tokens"), F.round(F.avg("accept_length"), 6).alias("mean_accept"), F.count("*").alias("requests"))
    return t.join(span, "run_id", "left").select("run_id", "requests", "tokens", "mean_accept", F.round(F.try_divide("tokens", "elapsed"), 4).alias("tokens_per_second"))


def metric_scalars(spark: SparkSession, d: str) -> DataFrame:
    """Metric arrays of runs as named scalars, in rows of a metrics sink."""
    r = table(spark, d, "runs").where("block_size IS NOT NULL").select("run_id", "block_size", F.create_map(lit("acc"), F.array(c("block_size") / 2, c("block_size") / 4), lit("loss"), F.array(lit(0.5))).alias("m"))
    flat = r.select("run_id", "block_size", F.map_from_entries(M.flattened(c("m"), "train")).alias("m"))
    return flat.select(*K.metric_rows("bench", c("block_size"), c("m")), "run_id").select("run_id", "run", c("step").cast("int").alias("step"), "name", "value")


def vocabulary_offsets(spark: SparkSession, d: str) -> DataFrame:
    """Numbers of a reduced vocabulary and their offsets to the full one; the used ids are the prompt sizes that occur."""
    used = E.requests(spark, d).where("prompt_tokens IS NOT NULL").select(c("prompt_tokens").alias("token_id")).distinct()
    return T.vocabulary_maps(used, "token_id").select(c("draft_id").cast("int").alias("draft_id"), "token_id", c("offset").cast("int").alias("offset"))


def warm_prompts(spark: SparkSession, d: str) -> DataFrame:
    """Prompts sent in turn, without those of the warm-up."""
    e = table(spark, d, "eval_items").select("item_id")
    return RD.repeated_prompts(e, "item_id", 1200, 70).select("sent", "item_id")


def category_subset(spark: SparkSession, d: str) -> DataFrame:
    """Questions of a registered set in two categories, by name without case; unknown categories are named."""
    q = RD.select_questions(spark, "eval-items", f"{d}/eval_items.parquet", ["TOKEN", "metric"])
    try:
        RD.select_questions(spark, "eval-items", f"{d}/eval_items.parquet", ["metric", "nothing"])
        unknown = ""
    except KeyError as e:
        unknown = str(e.args[0]).partition(";")[0]
    return q.select(c("id").alias("item_id"), "category", lit(unknown).alias("unknown"))


QUERIES = {
    f.__name__: f
    for f in (
        sequence_checks, single_turns, first_samples, family_rows, run_thresholds, serving_checks, unscored_shares, counter_deltas, fallback_lookup, aligned_drafts, attention_measures, score_losses, lease_states, feature_states, in_flight, prefix_acks, step_horizons,
        key_choices, head_rows, batch_slices, frame_windows, position_lookup, generation_records, method_pairs, rank_means, block_acceptance, pooled_entropy, request_totals, metric_scalars, vocabulary_offsets, warm_prompts, category_subset,
    )
}

# --- SQL -------------------------------------------------------------------------------------------------------------

_S = E._S
_B = E._B
_BLANK = "NOT coalesce(regexp_matches({0}, '\\S'), false)"
_REF, _R, _P = E._REF, E._R, E._P
_SOFT = "e AS (SELECT vec_id, list_transform(embedding, lambda v: exp(v::DOUBLE - list_max(embedding)::DOUBLE)) AS e FROM embeddings), p AS (SELECT vec_id, list_transform(e, lambda v: v / list_sum(e)) AS p FROM e)"
_KL = "list_sum(list_transform(list_zip({0}, {1}), lambda z: CASE WHEN z[1] > 0 AND z[2] > 0 THEN z[1] * ln(z[1] / z[2]) ELSE 0 END))"
_DOT = "list_sum(list_transform(list_zip({0}, {1}), lambda z: z[1] * z[2]))"
_TOP16 = "list_transform(list_sort(list_transform(range(1, len({0}) + 1), lambda i: {{'v': -({0}[i]), 'i': i}}))[1:16], lambda s: s.i)"

SQL = {
    "sequence_checks": """
WITH s AS (SELECT len(kl) AS n, count(*) AS k FROM score_sidecar WHERE len(kl) > 0 GROUP BY len(kl), n_loss)
SELECT CASE WHEN n % 11 = 0 THEN 'empty sequence' WHEN n % 4 = 0 AND n >= 3 THEN 'null entry' WHEN n % 4 = 1 AND n >= 2 THEN 'negative id' WHEN n % 5 = 2 THEN 'mask of another length' WHEN n % 7 = 3 THEN 'mask entry not 0 or 1' END AS error, CAST(sum(k) AS BIGINT) AS n FROM s GROUP BY 1
""",
    "single_turns": f"""
WITH {_C}, k AS (SELECT id, regexp_matches(conversations[2].reasoning_content, '\\S') AS r FROM c WHERE image IS NULL AND len(conversations) = 2 AND conversations[1].role = 'user' AND conversations[2].role = 'assistant' AND NOT ({_BLANK.format('conversations[1].content')}) AND NOT ({_BLANK.format('conversations[2].content')}))
SELECT 'allow' AS policy, count(*) AS n FROM k UNION ALL SELECT 'forbidden', count(*) FILTER (WHERE NOT coalesce(r, false)) FROM k UNION ALL SELECT 'required', count(*) FILTER (WHERE r) FROM k
""",
    "first_samples": "WITH s AS (SELECT id, len(any_value(kl)) AS n FROM score_sidecar WHERE id IS NOT NULL GROUP BY id HAVING len(any_value(kl)) > 0) SELECT 'bounded' AS rule, min(id) AS id FROM s WHERE (n + 1) // 2 >= 12 AND n <= 40 UNION ALL SELECT 'long', min(id) FROM s WHERE (n + 1) // 2 >= 30 UNION ALL SELECT 'within', min(id) FROM s WHERE n <= 30",
    "family_rows": f"""
WITH r AS (SELECT DISTINCT id, {_FOLD.format("regexp_replace(" + _CFG + ", '-part-[0-9]+-of-[0-9]+$', '')")} AS i, {_FOLD.format('source')} AS s FROM tool_use_conversation WHERE id IS NOT NULL)
SELECT DISTINCT id FROM r WHERE i IN ('stepwiseqa', 'tool') OR contains(s, 'stepwiseqa') OR contains(s, 'tool')
""",
    "run_thresholds": f"""
WITH {_R}, m AS (SELECT run_id, round(coalesce(sum(completion_tokens), 0) / sum(CASE WHEN isfinite(e2e_latency) AND e2e_latency > 0 THEN e2e_latency END), 6) AS t, round(CASE WHEN coalesce(sum(spec_verify_ct), 0) > 0 THEN coalesce(sum(completion_tokens), 0) / sum(spec_verify_ct)::DOUBLE ELSE 1.0 END, 6) AS a FROM r WHERE run_id IS NOT NULL GROUP BY run_id),
e AS (SELECT run_id, (NOT coalesce(a >= 2.5, false))::INT + (length(run_id) < 8)::INT + (NOT coalesce(t <= 120, false))::INT AS n FROM m)
SELECT run_id, CASE WHEN n > 0 THEN n END AS n_errors, n = 0 AS passed FROM e
""",
    "serving_checks": f"""
WITH {_C}, k AS (SELECT id, conversations AS h, len(conversations) AS n, coalesce(list_filter(regexp_split_to_array(conversations[2].content, '\\s+'), lambda w: w <> ''), []) AS w FROM c WHERE len(conversations) > 1)
SELECT id, array_to_string(list_filter([CASE WHEN n % 9 < 4 THEN 'acceptance below the block' END, CASE WHEN n % 2 = 1 AND len(w) > 2 THEN 'prefix differs' END, CASE WHEN len(list_filter(h, lambda m: m.role = 'assistant' AND regexp_matches(m.reasoning_content, '\\S'))) > 0 THEN 'reasoning in history' END], lambda x: x IS NOT NULL), '; ') AS errors FROM k
""",
    "unscored_shares": f"""
WITH {_C}, {_S}, j AS (SELECT s.id IS NULL AS lost FROM c LEFT JOIN s ON s.id = c.id WHERE c.image IS NOT NULL), t AS (SELECT count(*) AS n, count(*) FILTER (WHERE lost) AS missing FROM j)
SELECT l AS max_share, n, missing, round(coalesce(missing / nullif(n, 0)::DOUBLE, 0), 6) AS share, CASE WHEN missing / nullif(n, 0)::DOUBLE > l THEN 'error' WHEN missing > 0 THEN 'warning' ELSE 'ok' END AS level FROM t, (SELECT unnest([0.2::DOUBLE, 0.99::DOUBLE]) AS l)
""",
    "counter_deltas": f"WITH {_R} SELECT coalesce(lower(trim(finish_reason)), 'none') AS key, round(sum(CASE WHEN index % 3 = 0 THEN 0 ELSE coalesce(completion_tokens, 0) END)::DOUBLE, 3) AS delta FROM r GROUP BY 1 HAVING count(index % 3) > 0",
    "fallback_lookup": "SELECT run_id, CASE WHEN block_size >= 8 THEN block_size ELSE -block_size END AS v FROM runs",
    "aligned_drafts": f"WITH {_B} SELECT CAST(slot AS INTEGER) AS slot, correct AS correct_a, coalesce(kl < 0.7, false) AS correct_b, count(*) AS n FROM z WHERE slot > 0 AND block % 3 <> 1 GROUP BY 1, 2, 3",
    "attention_measures": f"""
WITH {_SOFT}, j AS (SELECT a.vec_id, a.p AS p, b.p AS q FROM p a JOIN p b ON b.vec_id = a.vec_id + 1), k AS (SELECT *, list_transform(list_zip(p, q), lambda z: (z[1] + z[2]) / 2) AS m FROM j)
SELECT vec_id, round(exp(-list_sum(list_transform(p, lambda v: CASE WHEN v > 0 THEN v * ln(v) ELSE 0 END))), 4) AS support, len(list_intersect({_TOP16.format('p')}, {_TOP16.format('q')})) / 16.0::DOUBLE AS overlap, round(({_KL.format('p', 'm')} + {_KL.format('q', 'm')}) / 2, 8) AS js, round({_DOT.format('p', 'q')} / sqrt({_DOT.format('p', 'p')} * {_DOT.format('q', 'q')}), 6) AS cosine FROM k
""",
    "score_losses": f"""
WITH {_SOFT}, t AS (SELECT vec_id, list_max(p) AS top, list_reverse_sort(p)[1:8] AS k FROM p)
SELECT vec_id, round(greatest(0, -list_sum(list_transform(k, lambda v: CASE WHEN v > 0 THEN v * ln(v) ELSE 0 END)) - CASE WHEN 1 - list_sum(k) > 0 THEN (1 - list_sum(k)) * ln(1 - list_sum(k)) ELSE 0 END), 6) AS entropy, round(-ln(top), 6) AS surprise,
 round(0.9::DOUBLE * exp(-2 * 20 * top) * 0.25::DOUBLE + (1 - 0.9::DOUBLE * exp(-2 * 20 * top)) * (1 - 20 * top), 6) AS loss FROM t
""",
    "lease_states": f"""
WITH {_R}, k AS (SELECT run_id || '/' || (index % 7) AS task_id, coalesce(lower(finish_reason), '') = 'stop' AS stopped, index FROM r WHERE run_id IS NOT NULL)
SELECT task_id, CAST(count(*) AS INTEGER) AS attempts, CASE WHEN count(*) FILTER (WHERE stopped AND index % 5 = 0) > 0 THEN 'done' WHEN count(*) FILTER (WHERE NOT stopped) >= 3 THEN 'exhausted' ELSE 'pending' END AS outcome FROM k GROUP BY task_id
""",
    "feature_states": """
WITH r AS (SELECT sample_id, row_number() OVER (PARTITION BY sample_id ORDER BY published_at, run_id) AS g, coalesce(estimated_bytes, 0) AS b FROM sample_refs WHERE sample_id IS NOT NULL), l AS (SELECT sample_id, max(g) AS g, arg_max(b, g) AS b FROM r GROUP BY 1),
s AS (SELECT CASE WHEN g = 1 AND sample_id IN (SELECT sample_id FROM acked WHERE sample_id IS NOT NULL) THEN 'released' ELSE 'held' END AS state, b FROM l)
SELECT state, (SELECT sum(b) FROM s WHERE state = 'held') > 10000000 AS over_budget, count(*) AS n, CAST(sum(b) AS BIGINT) AS bytes FROM s GROUP BY state
""",
    "in_flight": f"WITH {_REF}, a AS (SELECT DISTINCT sample_id FROM acked WHERE sample_id IS NOT NULL) SELECT run_id, count(*) AS published, count(a.sample_id) AS consumed, count(*) - count(a.sample_id) AS in_flight FROM ref LEFT JOIN a ON a.sample_id = ref.sample_id WHERE run_id IS NOT NULL GROUP BY run_id",
    "prefix_acks": f"""
WITH {_REF}, a AS (SELECT DISTINCT sample_id FROM acked WHERE sample_id IS NOT NULL), n AS (SELECT run_id, ref.sample_id, a.sample_id IS NOT NULL AS acked, row_number() OVER (PARTITION BY run_id ORDER BY published_at, ref.sample_id) AS n FROM ref LEFT JOIN a ON a.sample_id = ref.sample_id WHERE run_id IS NOT NULL)
SELECT run_id, count(*) AS leased, count(*) FILTER (WHERE acked) AS acked, CASE WHEN min(n) FILTER (WHERE NOT acked) < max(n) FILTER (WHERE acked) THEN 'not a prefix: ' || min(n) FILTER (WHERE NOT acked) END AS error FROM n GROUP BY run_id
""",
    "step_horizons": """
WITH s AS (SELECT benchmark, count(*) AS n FROM eval_items GROUP BY 1), o AS (SELECT benchmark, n, unnest([2, 8, 0]) AS batch, unnest([3, 8, 1]) AS acc FROM s), h AS (SELECT *, CASE WHEN batch > 0 THEN n // (batch * 2) END AS b FROM o)
SELECT benchmark, CAST(batch AS INTEGER) AS batch, CAST(CASE WHEN b // acc > 0 THEN b END AS INTEGER) AS batches, CAST(CASE WHEN b // acc > 0 THEN b // acc * 3 END AS INTEGER) AS steps, CAST(CASE WHEN b // acc > 0 THEN (b - b // acc * acc) * 3 END AS INTEGER) AS dropped,
 CASE WHEN batch = 0 THEN 'batch must be at least 1' WHEN b // acc = 0 THEN 'too few samples for one step an epoch' END AS error FROM h
""",
    "key_choices": "SELECT category, item_id FROM (SELECT *, row_number() OVER (PARTITION BY category ORDER BY md5('13|' || category || '|' || item_id), item_id) AS r FROM (SELECT coalesce(category, 'none') AS category, item_id FROM eval_items)) WHERE r <= 2",
    "head_rows": "SELECT * FROM (SELECT 'head' AS part, doc_id FROM documents ORDER BY doc_id LIMIT 100) UNION ALL SELECT * FROM (SELECT 'sample' AS part, doc_id FROM documents ORDER BY md5('23|' || doc_id), doc_id LIMIT 100)",
    "batch_slices": "SELECT CAST(floor(p / 16) AS BIGINT) AS batch, item_id FROM (SELECT item_id, row_number() OVER (ORDER BY item_id) - 1 AS p FROM eval_items) WHERE floor(p / 16) < (SELECT floor(count(*) / 16) FROM eval_items) AND p % 16 BETWEEN 8 AND 11",
    "frame_windows": """
WITH r AS (SELECT run_id, block_size::DOUBLE AS b, block_size * 40 AS total FROM runs WHERE block_size IS NOT NULL), k AS (SELECT run_id, greatest(0, CAST(floor(b / 4 * 4) AS BIGINT)) AS f, total, b FROM r), l AS (SELECT run_id, f, least(total - 1, greatest(f, CAST(ceil((b / 2 + 3) * 4) AS BIGINT) - 1)) - f + 1 AS n FROM k)
SELECT run_id, array_to_string(CASE WHEN n <= 5 THEN list_transform(range(0, n), lambda i: i + f) ELSE list_transform(range(0, 5), lambda i: CAST(round_even(i * (n - 1) / 4.0, 0) AS BIGINT) + f) END, ',') AS frames FROM l
""",
    "position_lookup": "WITH a AS (SELECT benchmark, item_id, row_number() OVER (PARTITION BY benchmark ORDER BY item_id) AS n, row_number() OVER (PARTITION BY benchmark ORDER BY item_id DESC) AS m FROM eval_items) SELECT a.item_id AS item_id, b.item_id AS shot_id FROM a JOIN a b ON a.benchmark = b.benchmark AND a.n = b.m",
    "generation_records": f"""
WITH {_R}, t AS (SELECT TRY_CAST(regexp_extract(id, '([^#]*)$', 1) AS INTEGER) AS index, max(n_tokens) AS n_tokens FROM score_sidecar WHERE id IS NOT NULL GROUP BY 1)
SELECT benchmark, count(*) AS n, count(n_tokens) AS matched FROM r LEFT JOIN runs USING (run_id) LEFT JOIN t ON t.index = r.index WHERE r.run_id IS NOT NULL GROUP BY benchmark
""",
    "method_pairs": f"""
WITH {_R}, g AS (SELECT strategy, benchmark, sum(completion_tokens) / nullif(sum(e2e_latency) FILTER (WHERE isfinite(e2e_latency) AND e2e_latency > 0), 0) AS v FROM r JOIN runs USING (run_id) WHERE strategy IS NOT NULL AND benchmark IS NOT NULL GROUP BY 1, 2)
SELECT a.benchmark, a.strategy, round(a.v / b.v, 4) AS ratio FROM g a JOIN g b ON a.benchmark = b.benchmark AND b.strategy = 'dflash' WHERE a.strategy <> 'dflash'
""",
    "rank_means": f"""
WITH {_R}, g AS (SELECT run_id, coalesce(sum(completion_tokens), 0) AS a, coalesce(sum(spec_verify_ct), 0) AS b, coalesce(sum(cached_tokens), 0) AS e, coalesce(sum(prompt_tokens), 0) AS f FROM r GROUP BY run_id)
SELECT round(sum(a) / greatest(sum(b), 1e-12)::DOUBLE, 6) AS accept, round(sum(e) / greatest(sum(f), 1e-12)::DOUBLE, 6) AS cached, round(avg(a), 6) AS mean_a, round(avg(f), 6) AS mean_f FROM g
""",
    "block_acceptance": f"""
WITH {_B}, m AS (SELECT id, block, round(avg(kl), 9) AS kl, max(kl) FILTER (WHERE slot = 1) AS kl_first, round(avg(entropy), 9) AS entropy FROM z GROUP BY 1, 2), v AS (SELECT a.acc, unnest(['kl', 'kl_first', 'entropy']) AS measure, unnest([m.kl, m.kl_first, m.entropy]) AS x FROM m JOIN a ON a.id = m.id AND a.block = m.block),
o AS (SELECT measure, list_sort(list(x)) AS l, count(*) AS n FROM v WHERE x IS NOT NULL GROUP BY measure HAVING count(*) >= 8)
SELECT measure, CAST(CASE WHEN x <= l[n // 4 + 1] THEN 1 WHEN x <= l[n // 2 + 1] THEN 2 WHEN x <= l[(3 * n) // 4 + 1] THEN 3 ELSE 4 END AS INTEGER) AS quartile, count(*) AS n, round(avg(acc), 6) AS mean FROM v JOIN o USING (measure) WHERE x IS NOT NULL GROUP BY 1, 2
""",
    "pooled_entropy": f"""
WITH {_S}, f AS (SELECT id, list_filter(coalesce(entropy, []), lambda x: x IS NOT NULL AND isfinite(x)) AS v FROM s), x AS (SELECT unnest(v) AS x FROM f)
SELECT (SELECT count(*) FROM f WHERE len(v) > 0) AS n_rows, count(*) AS n_values, round(avg(x), 6) AS mean, round(stddev_pop(x), 6) AS std, round(avg((x < 0.1)::INT), 6) AS below, round(avg((x > 1.0)::INT), 6) AS above, """ + ", ".join(f"round(quantile_cont(x, {p / 100}), 6) AS p{p}" for p in (10, 25, 50, 75, 90, 99)) + " FROM x",
    "request_totals": f"""
WITH {_P}, t AS (SELECT run_id, CAST(sum(completion_tokens) AS BIGINT) AS tokens, round(avg(accept_length), 6) AS mean_accept, count(*) AS requests FROM p WHERE run_id IS NOT NULL GROUP BY run_id), e AS (SELECT run_id, max(send_offset + e2e_latency) AS elapsed FROM r WHERE e2e_latency >= 0 GROUP BY run_id)
SELECT run_id, requests, tokens, mean_accept, round(tokens / nullif(elapsed, 0), 4) AS tokens_per_second FROM t LEFT JOIN e USING (run_id)
""",
    "metric_scalars": "SELECT run_id, 'bench' AS run, block_size AS step, unnest(['train/acc/0', 'train/acc/1', 'train/loss/0']) AS name, unnest([block_size / 2.0::DOUBLE, block_size / 4.0::DOUBLE, 0.5::DOUBLE]) AS value FROM runs WHERE block_size IS NOT NULL",
    "vocabulary_offsets": f"WITH {_R}, u AS (SELECT DISTINCT prompt_tokens AS t FROM r WHERE prompt_tokens IS NOT NULL), n AS (SELECT t, row_number() OVER (ORDER BY t) - 1 AS k FROM u) SELECT CAST(k AS INTEGER) AS draft_id, t AS token_id, CAST(t - k AS INTEGER) AS offset FROM n",
    "warm_prompts": "WITH p AS (SELECT item_id, row_number() OVER (ORDER BY item_id) - 1 AS p FROM eval_items), n AS (SELECT count(*) AS n FROM eval_items) SELECT s AS sent, item_id FROM range(70, 1270) t(s), n JOIN p ON p.p = s % n.n",
    "category_subset": "SELECT item_id, category, 'unknown categories [''nothing'']' AS unknown FROM eval_items WHERE lower(category) IN ('token', 'metric')",
}
