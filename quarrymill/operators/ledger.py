"""References, acknowledgements and resumption: semi and anti joins over ids, dispatch windows, back-pressure.

Nothing is collected: sets of ids are joined, not looked up. Null ids never match.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrymill.operators.sampling import global_rank


def committed(refs: DataFrame) -> DataFrame:
    """Each reference once, as first published."""
    return refs.where("sample_id IS NOT NULL").groupBy("sample_id").agg(F.min_by(F.struct("run_id", "strategy", "schema_version", "num_tokens", "estimated_bytes"), "published_at").alias("r"), F.min("published_at").alias("published_at"), F.count("*").alias("deliveries")).select("sample_id", "r.*", "published_at", "deliveries")


def reconcile(refs: DataFrame, acks: DataFrame) -> DataFrame:
    """(sample_id, outcome): committed references that were acknowledged are ``released``, others ``requeued``;
    acknowledgements of no reference are ``unknown``."""
    a = acks.where("sample_id IS NOT NULL").select("sample_id").distinct()
    c = committed(refs).select("sample_id")
    return (
        c.join(a, "sample_id", "left_semi").withColumn("outcome", F.lit("released"))
        .unionByName(c.join(a, "sample_id", "left_anti").withColumn("outcome", F.lit("requeued")))
        .unionByName(a.join(c, "sample_id", "left_anti").withColumn("outcome", F.lit("unknown")))
    )


def remaining(inputs: DataFrame, done: list[DataFrame], key: str) -> DataFrame:
    """Inputs whose key is in none of the outputs."""
    ids = done[0].select(key)
    for d in done[1:]:
        ids = ids.unionByName(d.select(key))
    return inputs.join(ids.distinct(), key, "left_anti")


def dispatch(refs: DataFrame, order: list[Column], *, ranks: int, per_rank: int) -> DataFrame:
    """(sample_id, window, rank, round): references dealt in turn within windows of ranks x per_rank; a last partial
    window is dropped."""
    quantum = ranks * per_rank
    placed = global_rank(refs, order, "_i")
    full = refs.agg(F.floor(F.count("*") / F.lit(quantum)).alias("_full"))
    return (
        placed.crossJoin(F.broadcast(full)).withColumn("window", F.floor(F.col("_i") / F.lit(quantum))).where(F.col("window") < F.col("_full"))
        .select("sample_id", "window", (F.col("_i") % ranks).cast("int").alias("rank"), F.floor((F.col("_i") % quantum) / F.lit(ranks)).cast("int").alias("round"))
    )


def queue_depth(refs: DataFrame, acks: DataFrame, group: str) -> DataFrame:
    """(group, at, n, bytes): references and bytes in flight after every event of a group; an event releases or adds."""
    c = committed(refs).select("sample_id", group, "published_at", F.coalesce("estimated_bytes", F.lit(0)).alias("b"))
    a = acks.where("sample_id IS NOT NULL AND acked_at IS NOT NULL").groupBy("sample_id").agg(F.min("acked_at").alias("acked_at"))
    up = c.select(group, "sample_id", F.col("published_at").alias("at"), F.lit(1).alias("dn"), F.col("b").alias("db"))
    down = c.join(a, "sample_id").select(group, "sample_id", F.greatest("acked_at", "published_at").alias("at"), F.lit(-1).alias("dn"), (-F.col("b")).alias("db"))
    w = Window.partitionBy(group).orderBy("at", F.col("dn").desc(), "sample_id").rowsBetween(Window.unboundedPreceding, 0)
    return up.unionByName(down).withColumn("n", F.sum("dn").over(w)).withColumn("bytes", F.sum("db").over(w)).select(group, "sample_id", "at", "dn", "n", "bytes")


def pause_latch(depth: DataFrame, group: str, *, high: int, low: int, high_bytes: int, low_bytes: int) -> DataFrame:
    """Adds ``paused``: set when either depth reaches its high mark, cleared when both are at or below their low marks,
    otherwise as before: the last crossing decides."""
    cross = F.when((F.col("n") >= high) | (F.col("bytes") >= high_bytes), True).when((F.col("n") <= low) & (F.col("bytes") <= low_bytes), False)
    w = Window.partitionBy(group).orderBy("at", F.col("dn").desc(), "sample_id").rowsBetween(Window.unboundedPreceding, 0)
    return depth.withColumn("paused", F.coalesce(F.last(cross, ignorenulls=True).over(w), F.lit(False)))


def homogeneous(refs: DataFrame, batch: str) -> DataFrame:
    """(batch, n, strategies, versions, ok): whether a batch has one strategy and one schema version."""
    return refs.groupBy(batch).agg(F.count("*").alias("n"), F.count_distinct("strategy").alias("strategies"), F.count_distinct("schema_version").alias("versions")).withColumn("ok", (F.col("strategies") <= 1) & (F.col("versions") <= 1))


def missing_features(refs: DataFrame, required: list[str]) -> DataFrame:
    """(sample_id, missing): references that lack a required feature key or spec."""
    keys = F.coalesce(F.map_keys("feature_keys"), F.array().cast("array<string>"))
    specs = F.coalesce(F.map_keys("feature_specs"), F.array().cast("array<string>"))
    lost = F.filter(F.array(*[F.lit(r) for r in required]), lambda r: ~F.array_contains(keys, r) | ~F.array_contains(specs, r))
    return refs.where("sample_id IS NOT NULL").dropDuplicates(["sample_id"]).select("sample_id", lost.alias("missing")).where(F.size("missing") > 0)


def speedups(runs: DataFrame) -> DataFrame:
    """Runs (model, run_id, block_size, started_at, throughput) with their speed over the model's first run without
    drafting (block size 0 or null)."""
    plain = F.coalesce(F.col("block_size"), F.lit(0)) == 0
    base = runs.where(plain).groupBy("model").agg(F.min_by("throughput", F.struct("started_at", "run_id")).alias("base"))
    return runs.join(base, "model", "left").withColumn("speedup", F.round(F.try_divide(F.col("throughput"), F.nullif("base", F.lit(0.0))), 4))


def against_baseline(scores: DataFrame, group: list[str], method: str, baseline: str, value: str) -> DataFrame:
    """(group, method, ratio): each method's value over that of the baseline in the same group; groups without one are
    left out."""
    base = scores.where(F.col(method) == baseline).select(*group, F.col(value).alias("_base"))
    return scores.where(F.col(method) != baseline).join(base, group).select(*group, method, F.round(F.try_divide(value, "_base"), 4).alias("ratio"))


def complete_sets(scores: DataFrame, group: list[str], member: str, value: str) -> DataFrame:
    """Mean of a value over groups that have every member that occurs anywhere."""
    n = scores.agg(F.count_distinct(member).alias("_n"))
    g = scores.groupBy(*group).agg(F.count_distinct(member).alias("members"), F.round(F.avg(value), 6).alias("mean"))
    return g.crossJoin(F.broadcast(n)).where(F.col("members") == F.col("_n")).drop("_n")


def first_difference(a: DataFrame, b: DataFrame, position: str, value: str) -> DataFrame:
    """(n_a, n_b, first): sizes of two ordered lists and the first position at which they differ (null: none)."""
    x = a.select(F.col(position).alias("p"), F.col(value).alias("va"), F.lit(1).alias("ia"))
    y = b.select(F.col(position).alias("p"), F.col(value).alias("vb"), F.lit(1).alias("ib"))
    j = x.join(y, "p", "full")
    return j.agg(F.coalesce(F.sum("ia"), F.lit(0)).alias("n_a"), F.coalesce(F.sum("ib"), F.lit(0)).alias("n_b"), F.min(F.when(~F.col("va").eqNullSafe(F.col("vb")) | F.col("ia").isNull() | F.col("ib").isNull(), F.col("p"))).alias("first"))
