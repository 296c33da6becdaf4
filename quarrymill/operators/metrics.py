"""Aggregates over evaluation facts: lengths, throughput, acceptance, entropy, correlation, quartile tables.

Ratios are formed after the sums they are of, so that partial aggregation changes nothing. Nulls and values that aren't
finite are left out of sums and counts where the docstring doesn't say otherwise; a ratio without denominator is null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def finite(c: Column) -> Column:
    """The value if it is a finite number, else null."""
    return F.when(c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))), c)


def index_quantiles(df: DataFrame, group: str, value: str, shares: dict[str, float]) -> DataFrame:
    """The value at position min(int(n x share), n - 1) of each group's sorted values.

    Values are counted first, so a hot group costs its distinct values, not its rows, in the ordered step."""
    counted = df.where(F.col(value).isNotNull()).groupBy(group, value).agg(F.count("*").alias("_c"))
    w = Window.partitionBy(group).orderBy(value)
    upto = counted.withColumn("_upto", F.sum("_c").over(w)).withColumn("_n", F.sum("_c").over(Window.partitionBy(group)))
    pick = [F.min(F.when(F.col("_upto") > F.least(F.floor(F.col("_n") * F.lit(s)), F.col("_n") - 1), F.col(value))).alias(name) for name, s in shares.items()]
    return upto.groupBy(group).agg(F.first("_n").alias("n_rows"), *pick)


def length_profile(df: DataFrame, group: str, value: str, tiny: int = 3) -> DataFrame:
    """(group, n_rows, share, p50, p90, tiny_share): index-quantiles and the share of values up to ``tiny``."""
    q = index_quantiles(df, group, value, {"p50": 0.5, "p90": 0.9})
    small = df.where(F.col(value) <= tiny).groupBy(group).agg(F.count("*").alias("_t"))
    total = q.agg(F.sum("n_rows").alias("_all"))
    return q.join(small, group, "left").crossJoin(F.broadcast(total)).select(group, "n_rows", F.round(F.col("n_rows") / F.col("_all"), 6).alias("share"), "p50", "p90", F.round(F.coalesce("_t", F.lit(0)) / F.col("n_rows"), 6).alias("tiny_share"))


# --- exact order statistics over a whole table -------------------------------------------------------------------------


def ranked_values(df: DataFrame, value: str) -> DataFrame:
    """(v, rank from 0) of all non-null values in order, by range partitions and their counts: no task sorts all."""
    from quarrymill.operators.sampling import global_rank

    counted = df.where(F.col(value).isNotNull()).groupBy(F.col(value).alias("v")).agg(F.count("*").alias("c"))
    ranged = counted.repartitionByRange("v").withColumn("_p", F.spark_partition_id())
    sizes = ranged.groupBy("_p").agg(F.sum("c").alias("_n"))
    start = sizes.select("_p", (F.sum("_n").over(Window.orderBy("_p")) - F.col("_n")).alias("_s"))
    upto = F.sum("c").over(Window.partitionBy("_p").orderBy("v"))
    return ranged.withColumn("_u", upto).join(F.broadcast(start), "_p").select("v", (F.col("_s") + F.col("_u") - F.col("c")).alias("first"), (F.col("_s") + F.col("_u") - 1).alias("last"))


def value_at(df: DataFrame, value: str, places: list[tuple[str, str]]) -> DataFrame:
    """One row with the value at each place of the sorted values; a place is (name, SQL over ``n``, counted from 0)."""
    ranks = ranked_values(df, value)
    n = df.where(F.col(value).isNotNull()).agg(F.count("*").alias("n"))
    at = ranks.crossJoin(F.broadcast(n))
    return at.agg(*[F.max(F.when(F.expr(f"({sql}) BETWEEN first AND last"), F.col("v"))).alias(name) for name, sql in places], F.coalesce(F.max("n"), F.lit(0)).alias("n"))


def quantile_edges(df: DataFrame, value: str, points: int = 1001) -> DataFrame:
    """(k, edge): linearly interpolated quantiles at k / (points - 1)."""
    ranks = ranked_values(df, value)
    n = df.where(F.col(value).isNotNull()).agg(F.count("*").alias("n"))
    spark = df.sparkSession
    want = spark.range(points).select(F.col("id").alias("k")).crossJoin(F.broadcast(n)).where("n > 0").withColumn("x", F.col("k") * (F.col("n") - 1) / F.lit(points - 1)).withColumn("lo", F.floor("x")).withColumn("hi", F.ceil("x"))
    side = want.select("k", F.array_distinct(F.array("lo", "hi")).alias("places"), "x", "lo", "hi").select("k", "x", "lo", "hi", F.explode("places").alias("place"))
    hit = ranks.join(F.broadcast(side), (F.col("place") >= F.col("first")) & (F.col("place") <= F.col("last")))
    pair = hit.groupBy("k", "x", "lo").agg(F.min("v").alias("a"), F.max("v").alias("b"))
    return pair.select("k", (F.col("a") + (F.col("x") - F.col("lo")) * (F.col("b") - F.col("a"))).alias("edge"))


# --- requests ------------------------------------------------------------------------------------------------------------


def per_request(stats: DataFrame) -> DataFrame:
    """One row per (run_id, index): completion and verify counts summed over turns, prompt and cached counts at their
    greatest, the last finish reason, and tokens per verification (null without any)."""
    return (
        stats.groupBy("run_id", "index")
        .agg(
            F.coalesce(F.sum("completion_tokens"), F.lit(0)).alias("completion_tokens"), F.coalesce(F.sum("spec_verify_ct"), F.lit(0)).alias("spec_verify_ct"), F.max("prompt_tokens").alias("prompt_tokens"),
            F.max("cached_tokens").alias("cached_tokens"), F.max_by(F.lower("finish_reason"), F.when(F.col("finish_reason").isNotNull(), F.col("logged_at"))).alias("finish_reason"),
        )
        .withColumn("accept_length", F.try_divide(F.col("completion_tokens"), F.nullif("spec_verify_ct", F.lit(0))))
    )


def run_metrics(stats: DataFrame) -> DataFrame:
    """(run_id, output_throughput, accept_length): completion over latency, completion over verifications (1 if none)."""
    done, ver = F.coalesce(F.sum("completion_tokens"), F.lit(0)), F.coalesce(F.sum("spec_verify_ct"), F.lit(0))
    return stats.groupBy("run_id").agg(
        F.round(F.try_divide(done, F.sum(F.when(finite(F.col("e2e_latency")) > 0, F.col("e2e_latency")))), 6).alias("output_throughput"), F.round(F.when(ver > 0, done / ver).otherwise(1.0), 6).alias("accept_length"),
    )


def length_summary(stats: DataFrame, columns: tuple[str, ...] = ("prompt_tokens", "completion_tokens")) -> DataFrame:
    """Per run: mean, median, least, greatest and sum of token counts; null in all if any request lacks the count."""
    aggs = []
    for c in columns:
        whole = F.count(c) == F.count("*")
        for name, a in (("mean", F.round(F.avg(c), 6)), ("median", F.round(F.median(c), 6)), ("min", F.min(c)), ("max", F.max(c)), ("sum", F.sum(c))):
            aggs.append(F.when(whole, a).alias(f"{c}_{name}"))
    return stats.groupBy("run_id").agg(*aggs)


def busy_time(intervals: DataFrame, group: str, start: str, end: str, bin_width: float = 60.0) -> DataFrame:
    """(group, busy): total length of the union of intervals; null and empty intervals are left out.

    Intervals are merged twice: inside bins of their start, then the few islands of all bins. A hot group's first
    merge is spread over its bins, and only disjoint islands meet in one task.
    """
    ok = intervals.where(finite(F.col(start)).isNotNull() & finite(F.col(end)).isNotNull() & (F.col(end) > F.col(start)))
    islands = _merge(ok.select(group, F.floor(F.col(start) / bin_width).alias("bin"), F.col(start).alias("a"), F.col(end).alias("b")), [group, "bin"])
    merged = _merge(islands.select(group, "a", "b"), [group])
    return merged.groupBy(group).agg(F.sum(F.col("b") - F.col("a")).alias("busy"))


def _merge(df: DataFrame, keys: list[str]) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy("a", "b")
    before = F.max("b").over(w.rowsBetween(Window.unboundedPreceding, -1))
    marked = df.withColumn("new", F.when(before.isNull() | (F.col("a") > before), 1).otherwise(0))
    island = F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0))
    return marked.withColumn("island", island).groupBy(*keys, "island").agg(F.min("a").alias("a"), F.max("b").alias("b"))


def throughput(stats: DataFrame) -> DataFrame:
    """Per run: wall-free throughputs of all phases as ratios of sums, and the overlap of decode windows."""
    e2e, ttft, dec = (F.when(finite(F.col(c)) >= 0, F.col(c)) for c in ("e2e_latency", "first_token_latency", "decode_latency"))
    s = stats.groupBy("run_id").agg(
        F.count("*").alias("requests"), F.coalesce(F.sum("prompt_tokens"), F.lit(0)).alias("prompt"), F.coalesce(F.sum("completion_tokens"), F.lit(0)).alias("completion"), F.coalesce(F.sum("cached_tokens"), F.lit(0)).alias("cached"),
        F.sum(e2e).alias("e2e"), F.avg(e2e).alias("e2e_mean"), F.sum(ttft).alias("ttft"), F.avg(ttft).alias("ttft_mean"), F.sum(dec).alias("dec"), F.sum(F.greatest(F.coalesce("completion_tokens", F.lit(0)) - 1, F.lit(0))).alias("decoded"),
    )
    windows = stats.select("run_id", (F.col("send_offset") + F.when(F.col("first_token_latency") >= 0, F.col("first_token_latency"))).alias("a"), (F.col("send_offset") + F.when(F.col("e2e_latency") >= 0, F.col("e2e_latency"))).alias("b"))
    r = lambda c: F.round(c, 6)
    return s.join(busy_time(windows, "run_id", "a", "b"), "run_id", "left").select(
        "run_id", "requests", F.col("prompt").alias("prompt_tokens"), F.col("completion").alias("completion_tokens"), r(F.try_divide("completion", "e2e")).alias("e2e_output_throughput"), r(F.col("e2e_mean") + 1e-9).alias("e2e_latency_mean"),
        r(F.try_divide("prompt", "ttft")).alias("prefill_throughput"), r(F.col("ttft_mean") + 1e-9).alias("ttft_mean"), r(F.try_divide("cached", F.nullif("prompt", F.lit(0)))).alias("cached_prompt_share"), "decoded",
        r(F.try_divide("decoded", "dec")).alias("decode_output_throughput"), r(F.col("busy")).alias("decode_busy_time"), r(F.try_divide("decoded", "busy")).alias("decode_busy_throughput"),
        r(F.try_divide("dec", "busy")).alias("decode_overlap"), r(F.try_divide("ttft", "e2e")).alias("prefill_share"),
    )


def acceptance_report(samples: DataFrame, group: str) -> DataFrame:
    """Per group over requests with an accept length: mean, token-weighted mean, population deviation, percentiles."""
    a = samples.where(F.col("accept_length").isNotNull())
    q = [F.round(F.percentile("accept_length", F.lit(p / 100)), 6).alias(f"p{p}") for p in (10, 25, 50, 75, 90)]
    return a.groupBy(group).agg(
        F.count("*").alias("n"), F.round(F.avg("accept_length"), 6).alias("mean"), F.round(F.try_divide(F.sum(F.col("accept_length") * F.col("completion_tokens")), F.sum("completion_tokens")), 6).alias("token_weighted_mean"),
        F.round(F.stddev_pop("accept_length"), 6).alias("std"), *q,
    )


def histogram(df: DataFrame, value: str, low: float, high: float, bins: int) -> DataFrame:
    """(bin, n): counts in ``bins`` equal bins of [low, high]; values outside go to bin 0 and bins + 1."""
    x = F.col(value)
    b = F.when(x < low, 0).when(x > high, bins + 1).otherwise(F.least(F.floor((x - low) / F.lit((high - low) / bins)) + 1, F.lit(bins)))
    return df.where(finite(x).isNotNull()).groupBy(b.cast("int").alias("bin")).agg(F.count("*").alias("n"))


def extremes(df: DataFrame, value: str, key: str, k: int) -> DataFrame:
    """The k least and the k greatest rows, told apart by ``side``."""
    some = df.where(F.col(value).isNotNull())
    low = some.orderBy(F.col(value), F.col(key)).limit(k).withColumn("side", F.lit("low"))
    high = some.orderBy(F.col(value).desc(), F.col(key)).limit(k).withColumn("side", F.lit("high"))
    return low.unionByName(high)


# --- series ------------------------------------------------------------------------------------------------------------


def decile_of(pos: Column, n: Column, parts: int = 10) -> Column:
    """Part of a position when n values are cut into ``parts`` near-equal parts, the longer ones first."""
    size, more = F.floor(n / parts), n % parts
    return F.when(pos < more * (size + 1), F.floor(pos / (size + 1))).otherwise(more + F.floor((pos - more * (size + 1)) / F.greatest(size, F.lit(1)))).cast("int")


def series_stats(df: DataFrame, key: str, series: str) -> DataFrame:
    """Per row: number, mean, percentiles of a series and its shares below 0.1 and above 1.0, without leaving the row.

    Values that are null or not finite are left out."""
    v = F.filter(series, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    n = F.size("_v")

    def percentile(q: float) -> Column:
        x = (n - 1) * F.lit(q)
        lo, hi = F.get(F.col("_s"), F.floor(x).cast("int")), F.get(F.col("_s"), F.ceil(x).cast("int"))
        return F.when(n > 0, F.round(lo + (hi - lo) * (x - F.floor(x)), 6))

    share = lambda test: F.when(n > 0, F.round(F.size(F.filter("_v", test)) / n, 6))
    mean = F.when(n > 0, F.round(F.aggregate("_v", F.lit(0.0), lambda s, x: s + x) / n, 6))
    return df.withColumn("_v", F.coalesce(v, F.array().cast("array<double>"))).withColumn("_s", F.array_sort("_v")).select(
        key, n.alias("n"), mean.alias("mean"), percentile(0.1).alias("p10"), percentile(0.5).alias("p50"), percentile(0.9).alias("p90"), share(lambda x: x < 0.1).alias("below"), share(lambda x: x > 1.0).alias("above"),
    )


def decile_profile(df: DataFrame, key: str, series: str, parts: int = 10) -> DataFrame:
    """(decile, mean): mean over rows with at least ``parts`` values of the mean value in each part of the series."""
    p = df.where(F.size(series) >= parts).select(key, F.size(series).alias("n"), F.posexplode(series).alias("pos", "x")).where(finite(F.col("x")).isNotNull())
    each = p.groupBy(key, decile_of(F.col("pos"), F.col("n"), parts).alias("decile")).agg(F.avg("x").alias("m"))
    return each.groupBy("decile").agg(F.round(F.avg("m"), 6).alias("mean"), F.count("*").alias("n_series"))


def pooled_series(df: DataFrame, series: str, percents: tuple[int, ...] = (10, 25, 50, 75, 90, 99)) -> DataFrame:
    """One row: rows with values, values, mean, deviation, percentiles and shares below 0.1 and above 1.0 of the values of
    all rows together. Percentiles come from ranks over value counts: no task holds all values."""
    each = df.select(F.filter(series, lambda x: finite(x).isNotNull()).alias("v")).where(F.size("v") > 0)
    pooled = each.select(F.explode("v").alias("x"))
    s = pooled.agg(F.count("*").alias("n_values"), F.round(F.avg("x"), 6).alias("mean"), F.round(F.stddev_pop("x"), 6).alias("std"), F.round(F.avg((F.col("x") < 0.1).cast("double")), 6).alias("below"), F.round(F.avg((F.col("x") > 1.0).cast("double")), 6).alias("above"))
    q = quantile_edges(pooled, "x", 101).agg(*[F.round(F.max(F.when(F.col("k") == p, F.col("edge"))), 6).alias(f"p{p}") for p in percents])
    return each.agg(F.count("*").alias("n_rows")).crossJoin(s).crossJoin(q)


# --- correlation and tables of ranks -----------------------------------------------------------------------------------


def pearson(x: str, y: str) -> Column:
    """Correlation of two columns of a group; null for under 3 rows or no variance."""
    both = F.col(x).isNotNull() & F.col(y).isNotNull()
    n, dx, dy = F.sum(both.cast("long")), F.stddev_pop(F.when(both, F.col(x))), F.stddev_pop(F.when(both, F.col(y)))
    return F.when((n >= 3) & (dx > 0) & (dy > 0), F.corr(F.when(both, F.col(x)), F.when(both, F.col(y))))


def average_ranks(df: DataFrame, value: str, name: str) -> DataFrame:
    """Adds the average rank of ties, from 1; exact, from range-partitioned counts."""
    r = ranked_values(df, value).select(F.col("v").alias(value), ((F.col("first") + F.col("last")) / 2 + 1).alias(name))
    return df.join(r, value)


def spearman(df: DataFrame, x: str, y: str) -> DataFrame:
    """(spearman): correlation of average ranks over rows with both values."""
    both = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(x, y)
    return average_ranks(average_ranks(both, x, "_rx"), y, "_ry").agg(F.round(pearson("_rx", "_ry"), 6).alias("spearman"))


def partial_correlation(df: DataFrame, x: str, y: str, z: str) -> DataFrame:
    """(partial): correlation of x and y with z held; null for under 4 rows or without variance left."""
    s = df.where(F.col(x).isNotNull() & F.col(y).isNotNull() & F.col(z).isNotNull()).agg(pearson(x, y).alias("xy"), pearson(x, z).alias("xz"), pearson(y, z).alias("yz"), F.count("*").alias("n"))
    under = (1 - F.col("xz") ** 2) * (1 - F.col("yz") ** 2)
    return s.select(F.round(F.when((F.col("n") >= 4) & (under > 0), (F.col("xy") - F.col("xz") * F.col("yz")) / F.sqrt(under)), 6).alias("partial"))


def equal_count_buckets(df: DataFrame, value: str, other: str, buckets: int) -> DataFrame:
    """(bucket, n, low, high, mean_other): rows sorted by (value, other) and cut at int(i x n / buckets)."""
    from quarrymill.operators.sampling import global_rank

    some = df.where(F.col(value).isNotNull()).withColumn("_id", F.monotonically_increasing_id())
    r = global_rank(some, [F.col(value), F.coalesce(F.col(other), F.lit(float("-inf"))), F.col("_id")], "_g")
    n = some.agg(F.count("*").alias("_n"))
    b = F.floor(((F.col("_g") + 1) * buckets - 1) / F.col("_n")).cast("int")
    return r.crossJoin(F.broadcast(n)).groupBy(b.alias("bucket")).agg(F.count("*").alias("n"), F.min(value).alias("low"), F.max(value).alias("high"), F.round(F.avg(other), 6).alias("mean_other"))


def cut_bucket(value: Column, cuts: list[Column], *, inclusive: str) -> Column:
    """Bucket of a value among cuts: ``lower``: number of cuts not above it; ``upper``: 1 + number of cuts below it."""
    test = (lambda c: value >= c) if inclusive == "lower" else (lambda c: value > c)
    total = sum((test(c).cast("int") for c in cuts[1:]), test(cuts[0]).cast("int"))
    return F.when(value.isNotNull(), total if inclusive == "lower" else total + 1)


def quartile_cross(df: DataFrame, row: str, column: str) -> DataFrame:
    """(row_bucket, column_bucket, n): both values in quartiles with cuts at position int(n x q)."""
    both = df.where(F.col(row).isNotNull() & F.col(column).isNotNull()).select(row, column)
    places = [(f"c{i}", f"cast(floor(n * {i / 4}) as bigint)") for i in (1, 2, 3)]
    r = value_at(both, row, places).select(*[F.col(f"c{i}").alias(f"r{i}") for i in (1, 2, 3)])
    c = value_at(both, column, places).select("c1", "c2", "c3")
    cut = both.crossJoin(F.broadcast(r)).crossJoin(F.broadcast(c))
    rb = cut_bucket(F.col(row), [F.col(f"r{i}") for i in (1, 2, 3)], inclusive="lower")
    cb = cut_bucket(F.col(column), [F.col(f"c{i}") for i in (1, 2, 3)], inclusive="lower")
    return cut.groupBy(rb.alias("row_bucket"), cb.alias("column_bucket")).agg(F.count("*").alias("n"))


# --- accuracies --------------------------------------------------------------------------------------------------------


def grouped_accuracy(df: DataFrame, group: str, hit: str) -> DataFrame:
    """(group, n, hits, accuracy) and the micro and macro averages over all, as group ``*micro*`` and ``*macro*``."""
    g = df.groupBy(F.col(group).alias("grp")).agg(F.count("*").alias("n"), F.sum(F.col(hit).cast("long")).alias("hits")).withColumn("accuracy", F.col("hits") / F.col("n"))
    all_ = g.agg(F.lit("*micro*").alias("grp"), F.sum("n").alias("n"), F.sum("hits").alias("hits"), (F.sum("hits") / F.sum("n")).alias("accuracy"))
    macro = g.agg(F.lit("*macro*").alias("grp"), F.sum("n").alias("n"), F.sum("hits").alias("hits"), F.avg("accuracy").alias("accuracy"))
    return g.unionByName(all_).unionByName(macro).select(F.col("grp").alias(group), "n", "hits", F.round("accuracy", 6).alias("accuracy"))


def share_of_run(df: DataFrame, group: str, hit: str, seconds: float) -> DataFrame:
    """(group, n, hits, accuracy, answers_per_second, share): accuracy by group ('' for null), with the answers a second
    over the latency of the whole run and the group's share of all answers."""
    total = df.agg(F.count("*").alias("_all"))
    g = df.groupBy(F.coalesce(F.col(group), F.lit("")).alias(group)).agg(F.count("*").alias("n"), F.sum(F.col(hit).cast("long")).alias("hits"))
    return g.crossJoin(F.broadcast(total)).select(group, "n", "hits", F.round(F.col("hits") / F.col("n"), 6).alias("accuracy"), F.round(F.col("n") / F.lit(seconds), 6).alias("answers_per_second"), F.round(F.col("n") / F.col("_all"), 6).alias("share"))


def average_and_worst(df: DataFrame, question: str, hit: str) -> DataFrame:
    """(questions, average, worst): means over questions of the mean and of the least hit of their variants."""
    q = df.groupBy(question).agg(F.avg(F.col(hit).cast("double")).alias("m"), F.min(F.col(hit).cast("double")).alias("w"))
    return q.agg(F.count("*").alias("questions"), F.round(F.avg("m"), 6).alias("average"), F.round(F.avg("w"), 6).alias("worst"))


def position_metrics(df: DataFrame, corrects: str, denominators: str, losses: str, decay: float = 0.8) -> DataFrame:
    """(pos, accuracy, loss): sums over all rows first, then ratios; denominators are at least 1e-6."""
    z = df.select(F.posexplode(F.arrays_zip(F.col(corrects).alias("c"), F.col(denominators).alias("d"), F.col(losses).alias("l"))).alias("pos", "z"))
    return z.groupBy("pos").agg(F.round(F.sum("z.c") / F.greatest(F.sum("z.d"), F.lit(1e-6)), 6).alias("accuracy"), F.round(F.sum(F.col("z.l") * F.col("z.d")) / F.greatest(F.sum("z.d"), F.lit(1e-6)), 6).alias("loss"))


def ratio_metrics(df: DataFrame, pairs: dict[str, tuple[str, str]], means: list[str], tiny: float = 1e-12) -> DataFrame:
    """One row: each name's sum over its denominator's sum (at least ``tiny``), and means of plain scalars over ranks."""
    return df.agg(*[F.round(F.sum(a) / F.greatest(F.sum(b), F.lit(tiny)), 6).alias(n) for n, (a, b) in pairs.items()], *[F.round(F.avg(m), 6).alias(f"mean_{m}") for m in means])


def simulated_acceptance(accuracies: Column) -> Column:
    """a0 + a0 a1 + a0 a1 a2 + ...: the accepted length that per-position accuracies imply."""
    s = F.aggregate(accuracies, F.struct(F.lit(1.0).alias("p"), F.lit(0.0).alias("t")), lambda s, a: F.struct((s.p * a).alias("p"), (s.t + s.p * a).alias("t")))
    return s.t


def flattened(metrics: Column, prefix: str) -> Column:
    """A map of metric arrays as an array of (name, value) scalars named ``prefix/name/index``."""
    return F.flatten(F.transform(F.map_entries(metrics), lambda e: F.transform(e.value, lambda v, i: F.struct(F.concat_ws("/", F.lit(prefix), e.key, i.cast("string")).alias("name"), v.alias("value")))))
