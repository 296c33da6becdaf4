"""Deterministic sampling, splitting, quotas and partition plans.

Random order is the order of md5(seed | key), so every draw is exact in size, the same on every run and engine, and
needs no driver-side state. Ranks per group use one shuffle on the group; where a single group may be the whole table
(global splits), ranks are found from range-partitioned counts instead of one sorted task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ticket(seed: int, *keys: str | Column) -> Column:
    """The row's place in the seeded order, as a hexadecimal text of fixed width."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(k).cast("string") if isinstance(k, str) else k for k in keys]))


def unit(seed: int, *keys: str | Column) -> Column:
    """A uniform number in [0, 1) made from the ticket's first 52 bits."""
    return F.conv(F.substring(ticket(seed, *keys), 1, 13), 16, 10).cast("double") / F.lit(float(16**13))


def global_rank(df: DataFrame, order: list[Column], name: str = "rank") -> DataFrame:
    """Adds the row's position (from 0) in a total order. The order's columns must make it unique.

    Range partitioning plus per-partition counts; the only rows in one task are the partitions' counts.
    """
    key = F.struct(*order)
    ranged = df.withColumn("__key", key).repartitionByRange("__key").withColumn("__range", F.spark_partition_id())
    sizes = ranged.groupBy("__range").agg(F.count("*").alias("__size"))
    start = sizes.select("__range", (F.sum("__size").over(Window.orderBy("__range")) - F.col("__size")).alias("__start"))
    within = ranged.withColumn("__within", F.row_number().over(Window.partitionBy("__range").orderBy("__key")) - 1)
    return within.join(F.broadcast(start), "__range").withColumn(name, F.col("__start") + F.col("__within")).drop("__key", "__range", "__start", "__within")


def capped_per_group(df: DataFrame, group: str, key: str, limit: int | None, seed: int, limits: DataFrame | None = None) -> DataFrame:
    """At most ``limit`` rows a group, drawn by ticket; ``limits(group, n)`` gives a limit a group (null: all).

    With one limit, each task keeps its own best ``limit`` rows of a group before the shuffle (a rank limit that
    Catalyst pushes below the exchange), so a hot group is never sorted whole. With limits by group, rows are first
    cut to twice their limit's share of the group plus a margin by the ticket's value, which is uniform; a group in
    which the cut leaves too few rows (as good as impossible) keeps them all.
    """
    t = df.withColumn("__t", ticket(seed, key))
    w = Window.partitionBy(group).orderBy("__t", key)
    if limits is None:
        return t.withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= limit).drop("__t", "__r")
    n = limits.select(F.col(limits.columns[0]).alias(group), F.col(limits.columns[1]).cast("long").alias("__n"))
    sizes = df.groupBy(group).agg(F.count("*").alias("__all")).join(n, group).withColumn("__share", F.when(F.col("__n").isNotNull(), (2 * F.col("__n") + 50) / F.col("__all")))
    u = unit(seed, key)
    near = t.withColumn("__u", u).join(sizes, group).withColumn("__in", F.col("__share").isNull() | (F.col("__u") < F.col("__share")))
    kept = near.where("__in").groupBy(group).agg(F.count("*").alias("__have"))
    ranked = near.join(kept, group, "left").where(F.col("__in") | (F.coalesce("__have", F.lit(0)) < F.least("__n", "__all"))).withColumn("__r", F.row_number().over(w))
    return ranked.where(F.col("__n").isNull() | (F.col("__r") <= F.col("__n"))).select(*df.columns)


def train_test(df: DataFrame, key: str, *, share: float = 0.05, seed: int = 42) -> DataFrame:
    """Adds ``split``: exactly ceil(share x rows) rows are ``test``. Nulls in the key count as one value ''."""
    ranked = global_rank(df.withColumn("_t", ticket(seed, F.coalesce(F.col(key).cast("string"), F.lit("")))), [F.col("_t"), F.col(key)], "_rank")
    n = df.agg(F.ceil(F.count("*") * F.lit(share)).alias("_cut"))
    return ranked.crossJoin(F.broadcast(n)).withColumn("split", F.when(F.col("_rank") < F.col("_cut"), "test").otherwise("train")).drop("_t", "_rank", "_cut")


def largest_remainder(sizes: DataFrame, group: str, size: str, total: int) -> DataFrame:
    """(group, size, quota): ``total`` split in proportion to size by largest remainder, none above its size; ties go
    to the greater name. What a full group can't take goes to the others in a second pass by headroom."""
    s = sizes.select(F.col(group).alias("g"), F.col(size).cast("long").alias("n"))
    all_n = s.agg(F.sum("n").alias("all_n"))
    exact = F.col("n") * F.lit(float(total)) / F.col("all_n")
    a = s.crossJoin(F.broadcast(all_n)).withColumn("base", F.least(F.floor(exact), F.col("n"))).withColumn("frac", exact - F.floor(exact))
    left = a.agg((F.least(F.lit(total).cast("long"), F.first("all_n")) - F.sum("base")).alias("left"))
    room = F.when(F.col("base") < F.col("n"), 0).otherwise(1)
    order = Window.orderBy(room, F.col("frac").desc(), F.col("g").desc())
    b = a.crossJoin(F.broadcast(left)).withColumn("r", F.row_number().over(order)).withColumn("quota", F.col("base") + ((F.col("r") <= F.col("left")) & (F.col("base") < F.col("n"))).cast("long"))
    rest = b.agg((F.first("left") - F.sum(F.col("quota") - F.col("base"))).alias("rest"))
    before = F.coalesce(F.sum(F.col("n") - F.col("quota")).over(Window.orderBy(F.col("frac").desc(), F.col("g").desc()).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    c = b.crossJoin(F.broadcast(rest)).withColumn("more", F.least(F.col("n") - F.col("quota"), F.greatest(F.col("rest") - before, F.lit(0))))
    return c.select(F.col("g").alias(group), F.col("n").alias(size), (F.col("quota") + F.col("more")).alias("quota"))


def stratified(df: DataFrame, group: str, order: str, total: int) -> DataFrame:
    """The first ``quota`` rows of each stratum in ``order``, quotas by largest remainder."""
    quotas = largest_remainder(df.groupBy(group).agg(F.count("*").alias("n")), group, "n", total).select(group, "quota")
    # no quota is above the total: a constant limit, which each task applies before the shuffle
    ranked = df.withColumn("_r", F.row_number().over(Window.partitionBy(group).orderBy(order))).where(F.col("_r") <= total)
    return ranked.join(quotas, group).where(F.col("_r") <= F.col("quota")).drop("_r", "quota")


def round_robin(df: DataFrame, group: str, order: str, limit: int) -> DataFrame:
    """The first row of each group, then the second of each, ..., up to ``limit`` rows; ``turn`` is the position."""
    ranked = df.withColumn("_r", F.row_number().over(Window.partitionBy(group).orderBy(order))).where(F.col("_r") <= limit)
    top = ranked.orderBy("_r", group).limit(limit)
    return top.withColumn("turn", F.row_number().over(Window.orderBy("_r", group)) - 1).drop("_r")


def whole_groups(df: DataFrame, stratum: str, group: str, total: int) -> DataFrame:
    """Whole groups in name order within strata, taken in turn until ``total`` rows are reached or passed over."""
    sizes = df.groupBy(stratum, group).agg(F.count("*").alias("n"))
    turned = sizes.withColumn("k", F.row_number().over(Window.partitionBy(stratum).orderBy(group)))
    upto = turned.withColumn("upto", F.sum("n").over(Window.orderBy("k", stratum, group).rowsBetween(Window.unboundedPreceding, 0)))
    return df.join(upto.where(F.col("upto") <= total).select(stratum, group), [stratum, group])


def weighted_draw(weights: DataFrame, key: str, weight: str, cover: float, seed: int) -> DataFrame:
    """Keys drawn without replacement with probability by weight until their weights reach ``cover``; by the order of
    -ln(u) / weight. Keys of no weight are never drawn."""
    keyed = weights.where(F.col(weight) > 0).withColumn("arrival", F.round(-F.log(unit(seed, key) + F.lit(2.0**-53)) / F.col(weight), 12))
    before = F.coalesce(F.sum(weight).over(Window.orderBy("arrival", key).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return keyed.withColumn("_b", before).where(F.col("_b") < cover).drop("_b")


def shards_of_epochs(df: DataFrame, key: str, *, epochs: int, ranks: int, seed: int) -> DataFrame:
    """(epoch, position, rank, padded, key): every epoch's seeded order dealt to ``ranks`` in turn, padded by wrapping
    around to a multiple of ``ranks``."""
    each = df.select(F.col(key)).crossJoin(df.sparkSession.range(epochs).select(F.col("id").cast("int").alias("epoch")))
    placed = global_rank(each.withColumn("_t", ticket(seed, "epoch", key)), [F.col("epoch"), F.col("_t"), F.col(key)], "_g")
    n = df.agg(F.count("*").alias("n"))
    withn = placed.crossJoin(F.broadcast(n)).withColumn("position", (F.col("_g") % F.col("n")).cast("long"))
    pad = F.pmod(-F.col("n"), F.lit(ranks))
    extra = withn.where(F.col("position") < pad).withColumn("position", F.col("position") + F.col("n")).withColumn("padded", F.lit(True))
    return withn.withColumn("padded", F.lit(False)).unionByName(extra).select("epoch", "position", (F.col("position") % ranks).cast("int").alias("rank"), "padded", key)


def batches(ranked: DataFrame, rank: str, size: int, *, drop_last: bool = True, skip: int = 0) -> DataFrame:
    """Adds ``batch`` to rows ranked from 0; drops a last partial batch, and the first ``skip`` batches."""
    b = ranked.withColumn("batch", F.floor(F.col(rank) / F.lit(size)))
    if drop_last:
        n = ranked.agg((F.floor(F.count("*") / F.lit(size))).alias("_full"))
        b = b.crossJoin(F.broadcast(n)).where(F.col("batch") < F.col("_full")).drop("_full")
    return b.where(F.col("batch") >= skip)


def head(df: DataFrame, n: int, *order: str | Column) -> DataFrame:
    """The first ``n`` rows in an order that makes rows unique; each task keeps its own first ``n``."""
    return df.orderBy(*order).limit(n)


def even_positions(total: Column, wanted: int) -> Column:
    """``wanted`` evenly spaced positions of 0..total-1, ends included, rounded half to even; all if there are fewer."""
    step = (total - 1) / F.lit(float(max(1, wanted - 1)))
    return F.when(total <= wanted, F.sequence(F.lit(0).cast("long"), total.cast("long") - 1)).otherwise(F.transform(F.sequence(F.lit(0), F.lit(wanted - 1)), lambda i: F.bround(i * step).cast("long")))


def window_positions(seconds_from: Column, seconds_to: Column, fps: Column, total: Column, wanted: int) -> Column:
    """Evenly spaced frame positions between two times."""
    first = F.greatest(F.lit(0).cast("long"), F.floor(seconds_from * fps))
    last = F.least(total.cast("long") - 1, F.greatest(first, F.ceil(seconds_to * fps) - 1))
    return F.transform(even_positions(last - first + 1, wanted), lambda i: i + first)


def categorical(u: Column, weights: dict[str, float]) -> Column:
    """The name whose cumulative weight first exceeds ``u`` x total."""
    total, upto, out = sum(weights.values()), 0.0, None
    for name, w in weights.items():
        upto += w / total
        out = F.when(u < upto, name) if out is None else out.when(u < upto, name)
    return out.otherwise(name)
