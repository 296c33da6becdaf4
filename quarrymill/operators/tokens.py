"""Tokens: whitespace tokenisation, loss masks, truncation and filters, token frequencies and reduced vocabularies.

Token sequences are arrays inside the row; only frequencies are shuffled, after a map-side count.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrymill.session import cut_lineage


def whitespace_tokens(text: Column) -> Column:
    """Runs of non-space characters; [] for null and blank texts."""
    return F.coalesce(F.filter(F.split(text, r"\s+"), lambda w: w != ""), F.array().cast("array<string>"))


def supervised(messages: Column, *, last_only: bool = False) -> Column:
    """(tokens, mask): all messages' tokens in order; 1 for tokens of assistant contents (of the last one only)."""
    n = F.size(messages)
    last = F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(-1), lambda s, i: F.when(F.get(messages, i).role == "assistant", i).otherwise(s))
    parts = F.transform(messages, lambda m, i: F.struct(whitespace_tokens(m.content).alias("t"), F.when((m.role == "assistant") & (F.lit(not last_only) | (i == last)), 1).otherwise(0).alias("y")))
    return F.when(
        n > 0,
        F.struct(
            F.flatten(F.transform(parts, lambda p: p.t)).alias("tokens"),
            F.flatten(F.transform(parts, lambda p: F.array_repeat(F.coalesce(p.y, F.lit(0)), F.size(p.t)))).alias("mask"),
        ),
    )


def trainable(mask: Column) -> Column:
    return F.aggregate(mask, F.lit(0), lambda s, m: s + m)


def materialised(df: DataFrame, *, max_length: int, min_trainable: int) -> DataFrame:
    """Rows (id, tokens, mask) cut to ``max_length`` with at least ``min_trainable`` trained tokens left. Arrays of
    unlike length are errors, checked before the cut; empty ones have no trained token and are left out."""
    bad = (F.col("tokens").isNull() != F.col("mask").isNull()) | F.coalesce(F.size("tokens") != F.size("mask"), F.lit(False))
    checked = df.withColumn("mask", F.when(bad, F.raise_error(F.concat(F.lit("tokens and mask differ: "), F.col("id")))).otherwise(F.col("mask")))
    return checked.select("id", F.slice("tokens", 1, max_length).alias("tokens"), F.slice("mask", 1, max_length).alias("mask")).where(trainable(F.col("mask")) >= min_trainable)


def within_length(df: DataFrame, max_length: int) -> DataFrame:
    """Rows that aren't longer than ``max_length`` and have a trained token; longer ones are dropped, never cut."""
    return df.where((F.size("tokens") <= max_length) & (trainable(F.col("mask")) > 0))


def token_counts(df: DataFrame) -> DataFrame:
    """(token, n) of trained tokens."""
    z = df.select(F.explode(F.arrays_zip("tokens", "mask")).alias("z")).where("z.mask = 1")
    return z.groupBy(F.col("z.tokens").alias("token")).agg(F.count("*").alias("n"))


def reduced_vocabulary(counts: DataFrame, size: int) -> DataFrame:
    """(draft_id, token, n, coverage): the ``size`` most frequent tokens, ties by token, numbered in token order;
    ``coverage``: their share of all occurrences. Counts are written once and used three times."""
    counts = cut_lineage(counts)
    top = counts.orderBy(F.desc("n"), "token").limit(size)
    total = counts.agg(F.sum("n").alias("_all"))
    kept = top.agg(F.sum("n").alias("_kept"))
    ids = F.row_number().over(Window.orderBy("token")) - 1  # bounded by ``size``
    return top.crossJoin(F.broadcast(total)).crossJoin(F.broadcast(kept)).select(ids.alias("draft_id"), "token", "n", F.round(F.col("_kept") / F.col("_all"), 6).alias("coverage"))


def vocabulary_maps(used: DataFrame, token_id: str) -> DataFrame:
    """(draft_id, token_id, offset): offsets token_id - draft_id of used token ids in order."""
    d = F.row_number().over(Window.orderBy(token_id)) - 1
    return used.select(d.alias("draft_id"), F.col(token_id).alias("token_id"), (F.col(token_id) - d).alias("offset"))


def find_all(tokens: Column, header: Column) -> Column:
    """All positions (from 0) at which ``header`` occurs in ``tokens``."""
    w = F.size(header)
    return F.when(F.size(tokens) >= w, F.filter(F.sequence(F.lit(0), F.size(tokens) - w), lambda i: F.slice(tokens, i + 1, w) == header)).otherwise(F.array().cast("array<int>"))


def mask_after(tokens: Column, header: Column, end: Column) -> Column:
    """1 from behind each header up to and with the first end token behind it."""
    starts = find_all(tokens, header)
    return F.transform(
        tokens,
        lambda t, i: F.when(
            F.exists(starts, lambda s: (s + F.size(header) <= i) & ~F.exists(F.sequence(s + F.size(header), F.greatest(i - 1, s + F.size(header))), lambda k: (k < i) & (F.get(tokens, k) == end))), 1
        ).otherwise(0),
    )


def padded(values: Column, length: Column, fill) -> Column:
    """An array filled up to ``length``."""
    return F.concat(values, F.array_repeat(F.lit(fill), F.greatest(length - F.size(values), F.lit(0))))


def collate(df: DataFrame, batch: str, values: str, fill, multiple: int = 1) -> DataFrame:
    """Arrays padded to the longest of their batch, rounded up to a multiple."""
    longest = df.groupBy(batch).agg((F.ceil(F.max(F.size(values)) / F.lit(multiple)) * multiple).cast("int").alias("_n"))
    return df.join(longest, batch).withColumn(values, padded(F.col(values), F.col("_n"), fill)).drop("_n")


def sequence_shards(tokens: Column, shards: int, overlap: int, fill: int = 0) -> Column:
    """(shard, start, values): equal chunks of a sequence, each with ``overlap`` values of the next, padded."""
    size = F.ceil(F.size(tokens) / F.lit(shards)).cast("int")
    return F.transform(F.sequence(F.lit(0), F.lit(shards - 1)), lambda r: F.struct(r.alias("shard"), (r * size).alias("start"), padded(F.slice(tokens, r * size + 1, size + overlap), size + overlap, fill).alias("values")))


def common_prefix(a: Column, b: Column) -> Column:
    """Length of the longest common prefix of two arrays."""
    n = F.least(F.size(a), F.size(b))
    same = F.transform(F.slice(F.arrays_zip(a.alias("x"), b.alias("y")), F.lit(1), n), lambda z: z.x.eqNullSafe(z.y))
    p = F.array_position(same, F.lit(False))
    return F.when(p > 0, p - 1).otherwise(F.size(same)).cast("int")


def span_mask(pattern: str, *, last_only: bool = False, ignore: tuple[str, ...] = ()) -> Callable[[Column], Column]:
    """A function of a rendered text: 1 for each of its whitespace tokens in a span of the pattern's first group, 0
    elsewhere. A span's tokens are those between the token counts of the texts before its two ends; ``ignore``: texts
    whose tokens are never trained. An Arrow-batched function: expressions know no places of matches."""
    compiled, token = re.compile(pattern), re.compile(r"[^ \t\n\x0b\f\r]+")  # blanks as in ``whitespace_tokens``
    count = lambda t: sum(1 for _ in token.finditer(t))

    def mask(text: str | None) -> list[int] | None:
        if text is None:
            return None
        out = [0] * count(text)
        spans = [m.span(1) for m in compiled.finditer(text)]
        for value, found in ((1, spans[-1:] if last_only else spans), (0, [m.span() for t in ignore for m in re.finditer(re.escape(t), text)])):
            for a, b in found:
                first, last = count(text[:a]), count(text[:b])
                out[first:last] = [value] * (last - first)
        return out

    @F.pandas_udf("array<int>")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(mask)

    return run


def fingerprint(tokens: Column) -> Column:
    """A digest of a token sequence, to be stored with what was computed from it."""
    return F.md5(F.array_join(tokens.cast("array<string>"), ","))


def alignment_status(tokens: Column, mask: Column, n_tokens: Column, n_scores: Column, stored: Column) -> Column:
    """``scored`` if scores were made from this very sequence, else ``misaligned``; ``missing`` without scores. Counts
    decide first, then the fingerprint, where one is stored."""
    same = (n_tokens == F.size(tokens)) & (n_scores == trainable(mask))
    return F.when(n_scores.isNull(), "missing").when(F.coalesce(same, F.lit(False)) & (stored.isNull() | (stored == "") | (stored == fingerprint(tokens))), "scored").otherwise("misaligned")
