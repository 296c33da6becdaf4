"""Gates, candidate selection and run checks: each gives rows or a row of errors, none stops a job by itself."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarrymill.functions import text as X
from quarrymill.operators import tokens as TK


def sequence_error(values: Column, mask: Column) -> Column:
    """Why two arrays can't be a sample: null or empty, null or negative entries, unlike lengths, masks not of 0 and 1."""
    return (
        F.when(values.isNull() | (F.size(values) == 0), "empty sequence").when(F.exists(values, lambda v: v.isNull()), "null entry").when(F.exists(values, lambda v: v < 0), "negative id")
        .when(mask.isNull() | (F.size(mask) != F.size(values)), "mask of another length").when(F.exists(mask, lambda m: m.isNull() | ~m.isin(0, 1)), "mask entry not 0 or 1")
    )


def single_turn(df: DataFrame, reasoning: str = "allow") -> DataFrame:
    """Rows without a picture of exactly one user and one assistant message, both with text; ``reasoning``: ``allow``,
    ``forbidden`` or ``required`` in the answer."""
    c = F.col("conversations")
    ok = (F.size(c) == 2) & (F.get(c, 0).role == "user") & (F.get(c, 1).role == "assistant") & ~X.is_blank(F.get(c, 0).content) & ~X.is_blank(F.get(c, 1).content)
    if "image" in df.columns:
        ok = ok & F.col("image").isNull()
    has = ~X.is_blank(F.get(c, 1).reasoning_content)
    if reasoning == "forbidden":
        ok = ok & ~has
    if reasoning == "required":
        ok = ok & has
    return df.where(ok)


def first_qualifying(df: DataFrame, order: str, *, least: int, longest: int | None = None) -> DataFrame:
    """The first row in ``order`` with at least ``least`` trained tokens (and not longer than ``longest``)."""
    ok = TK.trainable(F.col("mask")) >= least
    if longest is not None:
        ok = ok & (F.size("tokens") <= longest)
    return df.where(ok).orderBy(order).limit(1)


def structured_prompt(content: Column, marks: list[str]) -> Column:
    """Whether a prompt follows a template: one of the marks occurs in it."""
    out = F.lit(False)
    for m in marks:
        out = out | F.contains(content, F.lit(m))
    return out


def wants_short_answer(content: Column) -> Column:
    """Whether a prompt asks a question that isn't for a description."""
    return F.rtrim(content).endswith("?") & ~content.rlike(r"(?i)\b(describe|explain|why|how|list|summari[sz]e)\b")


def of_family(df: DataFrame, family: DataFrame, names: list[str]) -> DataFrame:
    """Rows whose id's configuration, or whose folded source, belongs to one of the named families; ``family(handle,
    family)`` is a small dimension. Handles are resolved against the sources that occur, not against every row."""
    dim = F.broadcast(family.where(F.col("family").isin(names)).select(X.fold_handle(F.col("handle")).alias("h")).distinct())
    keyed = df.select(F.struct("*").alias("row"), X.fold_handle(X.config_base(X.id_config(F.col("id")))).alias("i"), X.fold_handle(F.col("source")).alias("s"))
    wanted = keyed.select("s").where("s IS NOT NULL").distinct().join(dim, F.contains(F.col("s"), F.col("h")), "left_semi").select(F.col("s").alias("k"))
    by_id = keyed.join(dim, F.col("i") == F.col("h"), "left_semi")
    rest = keyed.join(dim, F.col("i") == F.col("h"), "left_anti").join(F.broadcast(wanted), F.col("s") == F.col("k"), "left_semi")
    return by_id.unionByName(rest).select("row.*")


def tensor_columns(schema: T.DataType, path: str = "") -> list[str]:
    """Paths of a schema's values that aren't plain data (raw bytes and user types): rows of metadata must have none."""
    if isinstance(schema, T.StructType):
        return [x for f in schema.fields for x in tensor_columns(f.dataType, f"{path}.{f.name}" if path else f.name)]
    if isinstance(schema, T.ArrayType):
        return tensor_columns(schema.elementType, path + "[]")
    if isinstance(schema, T.MapType):
        return tensor_columns(schema.keyType, path + ".key") + tensor_columns(schema.valueType, path + ".value")
    return [path] if isinstance(schema, (T.BinaryType, T.UserDefinedType)) else []


def threshold_errors(df: DataFrame, least: dict[str, float], most: dict[str, float]) -> DataFrame:
    """(…, errors): every threshold a row of final metrics misses, joined by ``; ``; null if it passes."""
    parts = [F.when(~F.coalesce(F.col(k) >= v, F.lit(False)), F.concat(F.lit(f"{k} below {v}: "), F.coalesce(F.col(k).cast("string"), F.lit("missing")))) for k, v in least.items()]
    parts += [F.when(~F.coalesce(F.col(k) <= v, F.lit(False)), F.concat(F.lit(f"{k} above {v}: "), F.coalesce(F.col(k).cast("string"), F.lit("missing")))) for k, v in most.items()]
    return df.withColumn("errors", F.nullif(F.concat_ws("; ", *parts), F.lit("")))


def serving_errors(df: DataFrame, block: int) -> DataFrame:
    """(…, errors ARRAY): acceptance and matching prefix below the block size, reasoning left in a history."""
    history = F.exists("history", lambda m: (m.role == "assistant") & ~X.is_blank(m.reasoning_content))
    found = F.array(
        F.when(F.coalesce(F.col("accept_length") < block, F.lit(True)), "acceptance below the block"), F.when(TK.common_prefix(F.col("expected"), F.col("got")) < F.least(F.lit(block), F.size("expected")), "prefix differs"), F.when(F.coalesce(history, F.lit(False)), "reasoning in history"),
    )
    return df.withColumn("errors", F.filter(found, lambda e: e.isNotNull()))


def unscored_level(joined: DataFrame, limit: float) -> DataFrame:
    """(n, missing, share, level) of picture rows by ``status``: ``error`` above the limit, ``warning`` above none."""
    s = joined.where("status <> 'text'").agg(F.count("*").alias("n"), F.coalesce(F.sum((F.col("status") != "scored").cast("long")), F.lit(0)).alias("missing")).withColumn("share", F.coalesce(F.try_divide("missing", "n"), F.lit(0.0)))
    return s.withColumn("level", F.when(F.col("share") > limit, "error").when(F.col("missing") > 0, "warning").otherwise("ok"))


def counter_deltas(before: DataFrame, after: DataFrame, counters: str) -> DataFrame:
    """(key, delta): increase of named counters (MAP<STRING, DOUBLE>) between two snapshots; a new counter began at 0."""
    b, a = before.select(F.explode(counters).alias("key", "b")), after.select(F.explode(counters).alias("key", "a"))
    return a.groupBy("key").agg(F.sum("a").alias("a")).join(b.groupBy("key").agg(F.sum("b").alias("b")), "key", "left").select("key", (F.col("a") - F.coalesce("b", F.lit(0.0))).alias("delta"))


def lookup_with_fallback(df: DataFrame, key: str, first: DataFrame, second: DataFrame, value: str) -> DataFrame:
    """``value`` from the first table that has the key."""
    a, b = first.select(key, F.col(value).alias("_a")), second.select(key, F.col(value).alias("_b"))
    return df.join(a, key, "left").join(b, key, "left").withColumn(value, F.coalesce("_a", "_b")).drop("_a", "_b")


def aligned_drafts(a: DataFrame, b: DataFrame) -> DataFrame:
    """(id, block, slot, correct_a, correct_b) of blocks that two drafts share."""
    from quarrymill.operators.blocks import slots

    x = slots(a).select("id", "block", "slot", F.col("correct").alias("correct_a"))
    return x.join(slots(b).select("id", "block", "slot", F.col("correct").alias("correct_b")), ["id", "block", "slot"])


def effective_support(weights: Column) -> Column:
    """exp of the entropy of a distribution: how many entries carry it."""
    total = F.aggregate(weights, F.lit(0.0), lambda s, w: s + w)
    h = F.aggregate(weights, F.lit(0.0), lambda s, w: s - F.when(w > 0, w / total * F.log(w / total)).otherwise(0.0))
    return F.when(total > 0, F.exp(h))


def top_overlap(a: Column, b: Column, k: int) -> Column:
    """Share of the k greatest positions that two distributions have in common."""
    top = lambda x: F.transform(F.slice(F.reverse(F.array_sort(F.transform(x, lambda v, i: F.struct(v.alias("v"), (-i).alias("i"))))), 1, k), lambda s: s.i)
    return F.size(F.array_intersect(top(a), top(b))) / F.lit(float(k))


def in_flight(published: DataFrame, consumed: DataFrame, group: str) -> DataFrame:
    """(group, published, consumed, in_flight): what a channel holds that its reader hasn't counted yet."""
    p = published.groupBy(group).agg(F.count("*").alias("published"))
    c = consumed.groupBy(group).agg(F.count("*").alias("consumed"))
    return p.join(c, group, "left").select(group, "published", F.coalesce("consumed", F.lit(0)).alias("consumed"), (F.col("published") - F.coalesce("consumed", F.lit(0))).alias("in_flight"))


def prefix_errors(leased: DataFrame, acked: DataFrame, group: str, order: str, key: str) -> DataFrame:
    """(group, leased, acked, error): acknowledgements of a group must be those of its first leases in order; the error
    is the first place at which one is missing before the last that is acknowledged."""
    j = leased.join(acked.select(key).distinct().withColumn("_a", F.lit(1)), key, "left")
    g = j.groupBy(group).agg(F.count("*").alias("leased"), F.coalesce(F.sum("_a"), F.lit(0)).alias("acked"), F.max(F.when(F.col("_a") == 1, F.col(order))).alias("_last"), F.min(F.when(F.col("_a").isNull(), F.col(order))).alias("_gap"))
    return g.select(group, "leased", "acked", F.when(F.col("_gap") < F.col("_last"), F.concat(F.lit("not a prefix: "), F.col("_gap").cast("string"))).alias("error"))


def lease_outcomes(events: DataFrame, most: int) -> DataFrame:
    """(task_id, attempts, outcome) of a log (task_id, at, kind: leased, done, failed): ``done`` once done,
    ``exhausted`` after ``most`` failed attempts, else ``pending``."""
    g = events.groupBy("task_id").agg(F.sum((F.col("kind") == "leased").cast("int")).alias("attempts"), F.max((F.col("kind") == "done").cast("int")).alias("done"), F.sum((F.col("kind") == "failed").cast("int")).alias("failed"))
    return g.select("task_id", "attempts", F.when(F.col("done") == 1, "done").when(F.col("failed") >= most, "exhausted").otherwise("pending").alias("outcome"))


def stored_features(log: DataFrame, budget: int) -> DataFrame:
    """(sample_id, generation, bytes, state) of a feature-store log (sample_id, at, op: put, release, abort,
    generation, bytes): the last generation put, released only by an operation of that generation, and whether all
    that is held fits the budget."""
    put = log.where("op = 'put'").groupBy("sample_id").agg(F.max("generation").alias("generation"), F.max_by("bytes", "generation").alias("bytes"))
    gone = log.where("op IN ('release', 'abort')").select("sample_id", "generation", F.lit(True).alias("gone")).distinct()
    s = put.join(gone, ["sample_id", "generation"], "left").withColumn("state", F.when(F.coalesce("gone", F.lit(False)), "released").otherwise("held")).drop("gone")
    held = s.agg(F.sum(F.when(F.col("state") == "held", F.col("bytes")).otherwise(0)).alias("_held"))
    return s.crossJoin(F.broadcast(held)).withColumn("over_budget", F.col("_held") > budget).drop("_held")


def horizon(n_samples: int, batch: int, accumulation: int, ranks: int, epochs: int) -> dict[str, int]:
    """Steps of a run: whole batches a rank and epoch, whole accumulations of them. Rejects an epoch without a step."""
    for name, v in (("batch", batch), ("accumulation", accumulation), ("ranks", ranks), ("epochs", epochs)):
        if v < 1:
            raise ValueError(f"{name} must be at least 1")
    batches = n_samples // (batch * ranks)
    steps = batches // accumulation
    if steps == 0:
        raise ValueError("too few samples for one step an epoch")
    return {"batches_per_epoch": batches, "steps_per_epoch": steps, "steps": steps * epochs, "dropped_batches": (batches - steps * accumulation) * epochs}


def seeded_choice(df: DataFrame, key: str, item: str, n: int, seed: int) -> DataFrame:
    """n items a key by seeded order, given back in item order."""
    from quarrymill.operators.sampling import ticket

    r = df.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(ticket(seed, key, item), item)))
    return r.where(F.col("_r") <= n).drop("_r")


def batch_slice(position: Column, size: int, rank: int, ranks: int) -> Column:
    """Whether a position within a batch is in a rank's contiguous slice. The ranks must divide the batch."""
    if size % ranks:
        raise ValueError(f"{ranks} ranks don't divide a batch of {size}")
    part = size // ranks
    return F.floor(position % size / F.lit(part)) == rank
