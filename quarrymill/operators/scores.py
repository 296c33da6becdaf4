"""Per-token score tables: transforms, joins to records, expansion to positions, and audits.

A score row is (id, n_tokens, n_loss, fp, kl ARRAY, entropy ARRAY), its arrays compact over the trained positions.
Ids listed twice with equal scores count once; ragged or non-finite rows are told apart by the audit, not dropped
silently.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrymill.operators import metrics as M


def once(scores: DataFrame) -> DataFrame:
    return scores.where("id IS NOT NULL").dropDuplicates(["id"])


def kl_values(scores: DataFrame) -> DataFrame:
    """(kl): every finite score of every row."""
    return scores.select(F.explode("kl").alias("kl")).select(M.finite(F.col("kl")).alias("kl")).where("kl IS NOT NULL")


def by_quantile(edges: Column, kl: Column) -> Column:
    """Share of quantile edges that aren't above a score, clipped to [0, 1]."""
    n = F.size(edges)
    return F.when(kl.isNotNull(), F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.size(F.filter(edges, lambda e: e <= kl)) / n)))


def by_threshold(kl: Column, threshold: float) -> Column:
    return F.when(kl.isNotNull(), (kl >= threshold).cast("double"))


def by_saturation(kl: Column, c: float) -> Column:
    return F.when(kl.isNotNull(), F.greatest(kl, F.lit(0.0)) / (F.greatest(kl, F.lit(0.0)) + c))


def by_identity(kl: Column) -> Column:
    return F.when(kl.isNotNull(), F.least(F.lit(1.0), F.greatest(F.lit(0.0), kl)))


def gated(g: Column, entropy: Column) -> Column:
    """A score times exp(-max(entropy, 0))."""
    return g * F.exp(-F.greatest(entropy, F.lit(0.0)))


def quantised(g: Column) -> Column:
    """A score in [0, 1] as an integer of 10000ths, half to even; -1 for null."""
    return F.when(g.isNull(), -1).otherwise(F.rint(F.least(F.lit(1.0), F.greatest(F.lit(0.0), g)) * 10000).cast("int"))


def expanded(mask: Column, compact: Column, fill: Column) -> Column:
    """Compact values put at the positions where the mask is 1, ``fill`` elsewhere; null unless their numbers match."""
    ones = F.aggregate(mask, F.lit(0), lambda s, m: s + m)
    # rank of each position among the ones: prefix sums kept in the fold's state
    state = F.aggregate(
        mask, F.struct(F.lit(0).alias("k"), F.expr("cast(array() as array<double>)").alias("out")),
        lambda s, m: F.struct((s.k + m).alias("k"), F.array_append(s.out, F.when(m == 1, F.get(compact, s.k)).otherwise(fill)).alias("out")),
    )
    return F.when(ones == F.size(compact), state.out)


def join_scores(records: DataFrame, scores: DataFrame) -> DataFrame:
    """Records (id, has_image, ...) with their scores and ``status``: scored, missing or text."""
    s = once(scores).select("id", F.lit(True).alias("_hit"), "n_loss", "kl")
    j = records.join(s, "id", "left")
    return j.withColumn("status", F.when(~F.col("has_image"), "text").when(F.col("_hit"), "scored").otherwise("missing")).drop("_hit")


def audit(scores: DataFrame, ids: DataFrame, longest: int = 1 << 20) -> DataFrame:
    """One row of counts: rows, ids listed twice, ragged, null, not finite and over-long arrays, ids without record,
    records without score."""
    finite_all = lambda c: F.forall(c, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    per = scores.groupBy("id").agg(
        F.count("*").alias("k"), F.max((F.col("kl").isNull() | F.col("entropy").isNull()).cast("int")).alias("nulls"),
        F.max((F.coalesce(F.size("kl") != F.size("entropy"), F.lit(False)) | F.coalesce(F.size("kl") != F.col("n_loss"), F.lit(False))).cast("int")).alias("ragged"),
        F.max((~(F.coalesce(finite_all("kl"), F.lit(True)) & F.coalesce(finite_all("entropy"), F.lit(True)))).cast("int")).alias("wild"),
        F.max(F.coalesce(F.col("n_loss") > longest, F.lit(False)).cast("int")).alias("long"),
    )
    j = per.join(ids.select(F.col("id"), F.lit(1).alias("there")).distinct(), "id", "full")
    n = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0))
    have = F.col("k").isNotNull()
    return j.agg(
        F.coalesce(F.sum("k"), F.lit(0)).alias("n_rows"), n(have & (F.col("k") > 1)).alias("repeated_ids"), n(F.coalesce(F.col("nulls"), F.lit(0))).alias("null_ids"), n(F.coalesce(F.col("ragged"), F.lit(0))).alias("ragged_ids"),
        n(F.coalesce(F.col("wild"), F.lit(0))).alias("wild_ids"), n(F.coalesce(F.col("long"), F.lit(0))).alias("long_ids"), n(have & F.col("there").isNull()).alias("orphan_ids"), n(~have).alias("unscored_records"),
    )


def table_stats(scores: DataFrame, edges: DataFrame) -> DataFrame:
    """(n_rows, n_values, mean, over_half, over_three_quarters) of scores by quantile; ``edges(k, edge)`` is bounded by
    the number of points and broadcast. Equal scores are counted before they are compared with the edges."""
    e = edges.agg(F.sort_array(F.collect_list("edge")).alias("edges"))
    v = kl_values(once(scores)).groupBy("kl").agg(F.count("*").alias("c")).crossJoin(F.broadcast(e)).select("c", by_quantile(F.col("edges"), F.col("kl")).alias("g"))
    rows = once(scores).where(F.size("kl") > 0).agg(F.count("*").alias("n_rows"))
    s = v.agg(F.sum("c").alias("n_values"), F.round(F.sum(F.col("g") * F.col("c")) / F.sum("c"), 6).alias("mean"), F.round(F.sum(F.when(F.col("g") >= 0.5, F.col("c")).otherwise(0)) / F.sum("c"), 6).alias("over_half"), F.round(F.sum(F.when(F.col("g") >= 0.75, F.col("c")).otherwise(0)) / F.sum("c"), 6).alias("over_three_quarters"))
    return rows.crossJoin(s)


# --- token distributions -----------------------------------------------------------------------------------------------


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once a row, however often the body uses it."""
    return F.get(F.transform(F.array(value), body), 0)


def softmax(x: Column) -> Column:
    """Probabilities of an array of logits; null for null. Top and total are computed once a row."""
    shifted = let(F.array_max(x).cast("double"), lambda top: F.transform(x, lambda v: F.exp(v.cast("double") - top)))
    return let(shifted, lambda e: let(F.aggregate(e, F.lit(0.0), lambda s, v: s + v), lambda total: F.transform(e, lambda v: v / total)))


def expected_acceptance(p: Column, q: Column) -> Column:
    """Sum of the smaller of two probabilities over the vocabulary."""
    return F.aggregate(F.zip_with(p, q, lambda a, b: F.least(a, b)), F.lit(0.0), lambda s, v: s + v)


def tail_entropy(p: Column) -> Column:
    """Entropy of listed probabilities with all the rest in one bucket; never below 0."""
    h = F.aggregate(p, F.lit(0.0), lambda s, v: s - F.when(v > 0, v * F.log(v)).otherwise(0.0))
    rest = F.greatest(F.lit(0.0), 1 - F.aggregate(p, F.lit(0.0), lambda s, v: s + v))
    return let(rest, lambda r: F.greatest(F.lit(0.0), h - F.when(r > 0, r * F.log(r)).otherwise(0.0)))


def kl_divergence(p: Column, q: Column) -> Column:
    return F.aggregate(F.zip_with(p, q, lambda a, b: F.when((a > 0) & (b > 0), a * F.log(a / b)).otherwise(0.0)), F.lit(0.0), lambda s, v: s + v)


def mixed_loss(acceptance: Column, divergence: Column, *, scale: float = 1.0, decay: float = 2.0) -> Column:
    """w KL + (1 - w)(1 - acceptance) with w = scale exp(-decay acceptance)."""
    return let(scale * F.exp(-decay * acceptance), lambda w: w * divergence + (1 - w) * (1 - acceptance))
