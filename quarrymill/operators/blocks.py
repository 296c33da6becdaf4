"""Draft blocks and their slots: accepted prefixes, truncation economics, conditional and marginal rates.

A block has ``correct ARRAY<BOOLEAN>`` (slot 0 is the anchor), ``kl ARRAY<DOUBLE>`` and ``entropy ARRAY<DOUBLE>``.
What belongs to one block is computed inside its row; only counts are shuffled. Quartile cuts of a per-slot measure
are one small row, joined to the blocks by broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrymill.operators import metrics as M


def first_miss(correct: Column) -> Column:
    """The first slot after the anchor that isn't correct; null if there is none."""
    p = F.array_position(F.slice(correct, 2, 1 << 20), F.lit(False))
    return F.when(F.coalesce(p, F.lit(0)) > 0, p.cast("int"))


def accepted_length(correct: Column) -> Column:
    """Number of correct slots after the anchor before the first miss."""
    return F.coalesce(first_miss(correct) - 1, F.greatest(F.size(correct) - 1, F.lit(0)))


def accepted_prefix(correct: Column, valid: Column) -> Column:
    """Length of the prefix that is correct where valid; slots that aren't valid neither count nor end it."""
    s = F.aggregate(
        F.arrays_zip(correct.alias("c"), valid.alias("v")), F.struct(F.lit(True).alias("on"), F.lit(0).alias("n")),
        lambda s, x: F.struct((s.on & (x.c | ~x.v)).alias("on"), (s.n + (s.on & x.c & x.v).cast("int")).alias("n")),
    )
    return s.n


def slots(blocks: DataFrame) -> DataFrame:
    """(id, block, slot, correct, kl, entropy) of all slots after the anchor."""
    z = F.arrays_zip(F.col("correct").alias("c"), F.col("kl").alias("k"), F.col("entropy").alias("e"))
    return blocks.select("id", "block", F.posexplode(z).alias("slot", "z")).where("slot > 0").select("id", "block", "slot", F.col("z.c").alias("correct"), M.finite(F.col("z.k")).alias("kl"), M.finite(F.col("z.e")).alias("entropy"))


CUTS = [("q1", "n div 4"), ("q2", "n div 2"), ("q3", "(3 * n) div 4")]


def kl_cuts(blocks: DataFrame) -> DataFrame:
    """One row (q1, q2, q3): quartile cuts of the slots' kl at positions n div 4, n div 2 and 3n div 4."""
    return M.value_at(slots(blocks), "kl", CUTS).select("q1", "q2", "q3")


def quartile(kl: Column) -> Column:
    """1 to 4 by the cuts q1, q2, q3; a value on a cut belongs below it; null for null."""
    return M.cut_bucket(kl, [F.col("q1"), F.col("q2"), F.col("q3")], inclusive="upper")


def overview(blocks: DataFrame, caps: tuple[int, ...] = (1, 3, 7)) -> DataFrame:
    """Blocks, mean and median accepted length, and the share of accepted tokens left with drafts of a few slots."""
    a = blocks.select(accepted_length(F.col("correct")).alias("a"))
    return a.agg(F.count("*").alias("n_blocks"), F.round(F.avg("a"), 6).alias("mean"), F.round(F.median("a"), 6).alias("median"), *[F.round(F.try_divide(F.sum(F.least("a", F.lit(k))), F.sum("a")), 6).alias(f"kept_{k}") for k in caps])


def slot_hits(blocks: DataFrame) -> DataFrame:
    """(band, quartile, n, hits): slots 1-3, 4-7, 8-11 and 12 on by quartile of kl."""
    s = slots(blocks).crossJoin(F.broadcast(kl_cuts(blocks)))
    band = F.when(F.col("slot") <= 3, "1-3").when(F.col("slot") <= 7, "4-7").when(F.col("slot") <= 11, "8-11").otherwise("12-")
    return s.where("kl IS NOT NULL").groupBy(band.alias("band"), quartile(F.col("kl")).alias("quartile")).agg(F.count("*").alias("n"), F.sum(F.col("correct").cast("long")).alias("hits"))


def truncation(blocks: DataFrame) -> DataFrame:
    """(quartile, culprits, discarded_own, discarded_by): first misses by their quartile of kl, correct slots behind
    them by their own and by the culprit's quartile; the row of quartile 0 has accepted tokens and truncated blocks."""
    b = blocks.withColumn("miss", first_miss(F.col("correct"))).crossJoin(F.broadcast(kl_cuts(blocks)))
    cut = b.where("miss IS NOT NULL").withColumn("cq", quartile(M.finite(F.get(F.col("kl"), F.col("miss")))))
    culprit = cut.groupBy(F.col("cq").alias("quartile")).agg(F.count("*").alias("culprits"))
    z = F.arrays_zip(F.col("correct").alias("c"), F.col("kl").alias("k"))
    behind = cut.select("cq", "miss", "q1", "q2", "q3", F.posexplode(z).alias("slot", "z")).where("slot > miss AND z.c")
    own = behind.groupBy(quartile(M.finite(F.col("z.k"))).alias("quartile")).agg(F.count("*").alias("discarded_own"))
    by = behind.groupBy(F.col("cq").alias("quartile")).agg(F.count("*").alias("discarded_by"))
    total = b.agg(F.lit(0).alias("quartile"), F.sum(F.col("miss").isNotNull().cast("long")).alias("culprits"), F.sum(accepted_length(F.col("correct"))).alias("discarded_own"), F.count("*").alias("discarded_by"))
    ks = culprit.where("quartile IS NOT NULL").join(own.where("quartile IS NOT NULL"), "quartile", "full").join(by.where("quartile IS NOT NULL"), "quartile", "full")
    return ks.na.fill(0).unionByName(total)


def marginal_gain(blocks: DataFrame) -> DataFrame:
    """(quartile, n, gain): what fixing the first miss would add: 1 and the correct run behind it."""
    c, miss = F.col("correct"), F.col("miss")
    rest = F.slice(c, miss + 2, F.lit(1 << 20))
    run = F.when(F.array_position(rest, F.lit(False)) > 0, F.array_position(rest, F.lit(False)) - 1).otherwise(F.size(rest))
    b = blocks.withColumn("miss", first_miss(c)).where("miss IS NOT NULL").crossJoin(F.broadcast(kl_cuts(blocks)))
    return b.select(quartile(M.finite(F.get(F.col("kl"), miss))).alias("quartile"), (1 + run).alias("gain")).where("quartile IS NOT NULL").groupBy("quartile").agg(F.count("*").alias("n"), F.round(F.avg("gain"), 6).alias("gain"))


def conditional_hits(blocks: DataFrame) -> DataFrame:
    """(first, n, hits): slots of the lowest kl quartile behind a slot of the lowest or highest quartile in the same
    block: how often they hit. Pairs are made inside the block's row; a block's length is bounded by its draft."""
    b = blocks.crossJoin(F.broadcast(kl_cuts(blocks)))
    q = F.transform(F.col("kl"), lambda k: quartile(M.finite(k)))
    z = b.select(F.posexplode(F.arrays_zip(F.col("correct").alias("c"), q.alias("q"))).alias("slot", "z"), "id", "block")
    s = z.where("slot > 0").groupBy("id", "block").agg(F.sort_array(F.collect_list(F.struct("slot", "z.c", "z.q"))).alias("s"))
    pairs = F.flatten(F.transform("s", lambda a: F.transform(F.filter("s", lambda x: (x.slot > a.slot) & (x.q == 1) & a.q.isin(1, 4)), lambda x: F.struct(a.q.alias("first"), x.c.alias("hit")))))
    return s.select(F.explode(pairs).alias("p")).groupBy("p.first").agg(F.count("*").alias("n"), F.sum(F.col("p.hit").cast("long")).alias("hits"))


def sign_test(blocks: DataFrame, least: int = 5) -> DataFrame:
    """(n_ids, worse): ids with at least ``least`` slots in both outer quartiles; how many hit less in the highest."""
    s = slots(blocks).crossJoin(F.broadcast(kl_cuts(blocks))).withColumn("q", quartile(F.col("kl")))
    hit = F.col("correct").cast("double")
    per = s.groupBy("id").agg(F.sum((F.col("q") == 1).cast("int")).alias("n1"), F.sum((F.col("q") == 4).cast("int")).alias("n4"), F.avg(F.when(F.col("q") == 1, hit)).alias("h1"), F.avg(F.when(F.col("q") == 4, hit)).alias("h4"))
    return per.where((F.col("n1") >= least) & (F.col("n4") >= least)).agg(F.count("*").alias("n_ids"), F.coalesce(F.sum((F.col("h4") < F.col("h1")).cast("long")), F.lit(0)).alias("worse"))


def correlations(blocks: DataFrame) -> DataFrame:
    """One row: slot-level correlation of kl and hit, and with the slot and the entropy held."""
    s = slots(blocks).where("kl IS NOT NULL AND entropy IS NOT NULL").withColumn("hit", F.col("correct").cast("double")).withColumn("slot", F.col("slot").cast("double"))
    r = s.agg(M.pearson("kl", "hit").alias("kh"), M.pearson("kl", "slot").alias("ks"), M.pearson("slot", "hit").alias("sh"), M.pearson("kl", "entropy").alias("ke"), M.pearson("entropy", "hit").alias("eh"), F.count("*").alias("n"))
    part = lambda xy, xz, yz: F.round((F.col(xy) - F.col(xz) * F.col(yz)) / F.sqrt((1 - F.col(xz) ** 2) * (1 - F.col(yz) ** 2)), 6)
    return r.select("n", F.round("kh", 6).alias("kl_hit"), part("kh", "ks", "sh").alias("kl_hit_at_slot"), part("kh", "ke", "eh").alias("kl_hit_at_entropy"))


def accept_by_block(blocks: DataFrame, least: int = 8) -> DataFrame:
    """(measure, quartile, n, mean): accepted length by quartile of a block's own mean kl, kl of its first slot and mean
    entropy; a measure that fewer than ``least`` blocks have is left out. Each measure's cuts are one row."""
    mean = lambda c: F.aggregate(F.filter(c, lambda x: M.finite(x).isNotNull()), F.struct(F.lit(0.0).alias("s"), F.lit(0).alias("n")), lambda s, x: F.struct((s.s + x).alias("s"), (s.n + 1).alias("n")), lambda s: F.try_divide(s.s, s.n))
    b = blocks.select(accepted_length(F.col("correct")).alias("a"), F.round(mean("kl"), 9).alias("kl"), M.finite(F.get("kl", F.lit(1))).alias("kl_first"), F.round(mean("entropy"), 9).alias("entropy"))
    out = None
    for measure in ("kl", "kl_first", "entropy"):
        cuts = M.value_at(b, measure, CUTS).where(F.col("n") >= least).drop("n")
        part = b.where(F.col(measure).isNotNull()).crossJoin(F.broadcast(cuts)).groupBy(quartile(F.col(measure)).alias("quartile")).agg(F.count("*").alias("n"), F.round(F.avg("a"), 6).alias("mean")).select(F.lit(measure).alias("measure"), "quartile", "n", "mean")
        out = part if out is None else out.unionByName(part)
    return out
