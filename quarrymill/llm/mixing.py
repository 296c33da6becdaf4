"""Mixing sources to target shares of all tokens.

Method: the cube method. A source's rows get the same expected number of copies, chosen so that its tokens make up
its share of the mix; the whole part of it is used outright, and the fraction is an inclusion probability. The flight
phase moves the probabilities of three rows at a time along the null space of the balancing constraints (number of
rows, number of tokens of the source) until a coordinate reaches 0 or 1. It runs in bounded blocks of a source; each
block leaves at most two fractional rows, which meet again in the next level's blocks, until one small landing
problem a source remains. That is solved by trying all its roundings for the least miss in tokens, then in rows.

The mix is as large as it can be with every reachable share exact: the least of max_repeats x tokens / share over
the targeted sources that have tokens. Shares are rescaled over these; a source without tokens is reported with 0.

Edge cases: null, blank and unknown sources have no target and aren't used; sources are compared by their folded
handle; rows with null or blank texts have no tokens and aren't used; null or non-positive shares and max_repeats
count as no target; of targets listed twice the larger share counts; repeated rows are rows of their own; extra
columns are ignored; empty tables give empty results. The same rows give the same mix however they are partitioned.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarrymill.session import cut_lineage

#: Place of a public byte-level vocabulary (rank file); a parameter everywhere.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: How that vocabulary's tokenizer splits text before merging. A fixed value.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"
BLOCK, SEED = 4096, 11
LANDING = 12  # rows a source whose rounding is decided together at the end


@lru_cache(maxsize=2)
def tokenizer(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding(os.path.basename(path), pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def count_tokens(df: DataFrame, column: str, keep: list[str], vocabulary: str = VOCABULARY) -> DataFrame:
    """``keep`` and ``n_tokens`` of ``column``'s whole text; null texts have 0."""
    chosen = df.select(*keep, F.col(column).cast("string").alias("_text"))
    names = [*keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = tokenizer(vocabulary).encode_ordinary
        for b in batches:
            sizes = [len(encode(t)) if t else 0 for t in b.column(len(names)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(len(names))), pa.array(sizes, pa.int64())], names=[*names, "n_tokens"])

    kinds = dict(chosen.dtypes)
    return chosen.mapInArrow(run, ", ".join([f"`{k}` {kinds[k]}" for k in keep] + ["n_tokens bigint"]))


def fold(column):
    """Letters and digits of a handle in lower case; null if there are none."""
    f = F.regexp_replace(F.lower(F.col(column)), r"[^\p{L}\p{N}]", "")
    return F.when(f != "", f)


def flight(p: np.ndarray, size: np.ndarray, rng: np.random.Generator, keep: int = 2) -> np.ndarray:
    """The flight phase for the constraints (rows, tokens): all but at most ``keep`` (2 at least) probabilities end at
    0 or 1, their sum and their token-weighted sum stay as they were, and each keeps its expectation."""
    p = p.copy()
    eps = 1e-12
    queue = [i for i in range(len(p)) if eps < p[i] < 1 - eps]
    held: list[int] = []
    draws = iter(rng.random(4 * len(queue) + 8).tolist())
    q, s = p.tolist(), size.astype(float).tolist()
    at = 0
    while True:
        while len(held) < 3 and at < len(queue):
            held.append(queue[at])
            at += 1
        if len(held) < 3 or len(held) + len(queue) - at <= keep:
            break
        a, b, c = held
        u = [s[c] - s[b], s[a] - s[c], s[b] - s[a]]
        if not any(u):
            u = [1.0, -1.0, 0.0]
        up = min(((1 - q[i]) / v if v > 0 else q[i] / -v) for i, v in zip(held, u) if v)
        down = min((q[i] / v if v > 0 else (1 - q[i]) / -v) for i, v in zip(held, u) if v)
        step = up if next(draws) < down / (up + down) else -down
        for i, v in zip(held, u):
            q[i] += step * v
            if q[i] < eps:
                q[i] = 0.0
            elif q[i] > 1 - eps:
                q[i] = 1.0
        held = [i for i in held if 0.0 < q[i] < 1.0]
    return np.array(q)


def landing(p: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Rounds the few fractional probabilities so that tokens, then rows, are missed least: all roundings are tried."""
    p = p.copy()
    left = np.flatnonzero((p > 0.0) & (p < 1.0))
    if len(left):
        tries = (np.arange(1 << len(left))[:, None] >> np.arange(len(left))) & 1
        miss_t = np.abs(tries @ size[left] - (p[left] * size[left]).sum())
        miss_n = np.abs(tries.sum(axis=1) - p[left].sum())
        p[left] = tries[np.lexsort((miss_n, np.round(miss_t, 6)))[0]]
    return p


_GROUP = "row string, source string, n_tokens bigint, p double, block bigint, last boolean"


def _fly(level: int, seed: int):
    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        source, block, last = key
        rows = rows.sort_values(["n_tokens", "row"], ascending=[False, True], kind="stable").reset_index(drop=True)  # the last ones left are small
        digest = int(pd.util.hash_array(np.array([f"{source}|{block}|{level}|{seed}"], dtype=object))[0])
        size = rows["n_tokens"].to_numpy()
        p = flight(rows["p"].to_numpy(), size, np.random.default_rng(digest), LANDING if last else 2)
        rows["p"] = landing(p, size) if last else p
        return rows

    return run


def balanced_rows(rows: DataFrame, *, block: int = BLOCK, seed: int = SEED) -> DataFrame:
    """(row, source, n_tokens, p in {0, 1}) from (row, source, n_tokens, p in (0, 1)), balanced in each source.

    ``row`` identifies a row. A level's blocks hold about ``block`` rows, however many a source has; a source lands at
    the first level at which its fractional rows fit one block. The driver only sees one number a level.
    """
    rest, done, level = rows.select(F.col("row").cast("string").alias("row"), "source", "n_tokens", "p"), [], 0
    while True:
        counts = rest.groupBy("source").agg(F.count("*").alias("n"))
        placed = (
            rest.join(counts, "source")
            .withColumn("last", F.col("n") <= block)
            .withColumn("block", F.pmod(F.xxhash64("row", F.lit(level)), F.ceil(F.col("n") / F.lit(float(block)))))
            .select("row", "source", "n_tokens", "p", F.col("block").cast("long").alias("block"), "last")
        )
        flown = cut_lineage(placed.groupBy("source", "block", "last").applyInPandas(_fly(level, seed), _GROUP))
        done.append(flown.where("p = 0 OR p = 1"))
        rest = flown.where("p > 0 AND p < 1").drop("block", "last")
        if rest.isEmpty():
            break
        level += 1
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out.select("row", "source", "n_tokens", "p")


def clean_targets(targets: DataFrame) -> DataFrame:
    return (
        targets.select(fold("source").alias("source"), F.col("target_share").cast("double").alias("target_share"), F.col("max_repeats").cast("int").alias("max_repeats"))
        .where("source IS NOT NULL AND target_share > 0 AND NOT isnan(target_share) AND max_repeats > 0")
        .groupBy("source").agg(F.max_by(F.struct("target_share", "max_repeats"), F.struct("target_share", "max_repeats")).alias("t")).select("source", "t.*")
    )


def plan(sizes: DataFrame, targets: DataFrame) -> DataFrame:
    """(source, target_share, max_repeats, n_docs, n_tokens, copies) with the expected copies of each row of a source."""
    t = clean_targets(targets)
    have = sizes.groupBy("source").agg(F.count("*").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
    joined = t.join(have, "source", "left").na.fill({"n_docs": 0, "n_tokens": 0})
    usable = F.col("n_tokens") > 0
    total = joined.where(usable).agg(F.sum("target_share").alias("reach"), F.min(F.col("max_repeats") * F.col("n_tokens") / F.col("target_share")).alias("scale"))
    # tokens of a source = scale x share: the scarcest source is used to its cap
    return joined.crossJoin(F.broadcast(total)).withColumn("copies", F.when(usable, F.least(F.col("scale") * F.col("target_share") / F.col("n_tokens"), F.col("max_repeats").cast("double"))).otherwise(F.lit(0.0))).select("source", "target_share", "max_repeats", "n_docs", "n_tokens", "reach", "copies")


def named_rows(sized: DataFrame) -> DataFrame:
    """Adds ``row``, a name that depends on the row alone: its id, its text's digest and its number among rows that
    share both. However the table is partitioned, the same rows get the same names, and hence the same draw."""
    same = Window.partitionBy("doc_id", "digest").orderBy("n_tokens", "source")
    name = F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.hex("digest"), F.row_number().over(same))
    return sized.withColumn("row", name).drop("digest")


def mixed_rows(documents: DataFrame, targets: DataFrame, *, vocabulary: str = VOCABULARY, seed: int = SEED) -> DataFrame:
    """(doc_id, source, n_tokens, n_copies, target_share, max_repeats, ...) of every usable row of a targeted source."""
    texts = documents.where(F.col("text").isNotNull() & (F.trim(F.col("text")) != "")).select(F.col("doc_id").cast("long").alias("doc_id"), fold("source").alias("source"), F.xxhash64("text").alias("digest"), "text")
    wanted = clean_targets(targets).select("source")
    sized = count_tokens(texts.join(wanted, "source", "left_semi"), "text", ["doc_id", "source", "digest"], vocabulary).where("n_tokens > 0")
    sized = cut_lineage(named_rows(sized))
    shares = cut_lineage(plan(sized, targets))
    rows = sized.join(shares.select("source", "copies"), "source").withColumn("whole", F.floor(F.col("copies") + 1e-9)).withColumn("p", F.greatest(F.col("copies") - F.col("whole"), F.lit(0.0)))
    split = rows.where("p > 1e-9").select("row", "source", "n_tokens", "p")
    drawn = balanced_rows(split, seed=seed).select("row", F.col("p").cast("int").alias("extra"))
    return rows.join(drawn, "row", "left").select("row", "doc_id", "source", "n_tokens", (F.col("whole") + F.coalesce("extra", F.lit(0))).cast("int").alias("n_copies"))


def _report(rows: DataFrame, targets: DataFrame) -> DataFrame:
    per = rows.groupBy("source").agg(
        F.count("*").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"), F.sum((F.col("n_copies") > 0).cast("long")).alias("docs_used"),
        F.sum(F.col("n_copies").cast("long")).alias("rows_used"), F.sum(F.col("n_copies") * F.col("n_tokens")).alias("tokens_used"), F.max("n_copies").alias("most_copies"),
    )
    total = per.agg(F.sum("tokens_used").alias("all_tokens"))
    zero = {c: 0 for c in ("n_docs", "n_tokens", "docs_used", "rows_used", "tokens_used", "most_copies")}
    return (
        clean_targets(targets).join(per, "source", "left").na.fill(zero).crossJoin(F.broadcast(total))
        .select("source", "target_share", F.round(F.coalesce(F.try_divide("tokens_used", "all_tokens"), F.lit(0.0)), 9).alias("actual_share"), "max_repeats", *zero)
    )


def mix_report(documents: DataFrame, targets: DataFrame, **options) -> DataFrame:
    """One row per target: its share wanted and reached, rows and tokens there and used, and repeats."""
    return _report(mixed_rows(documents, targets, **options), targets)


def mixed_with_shares(documents: DataFrame, targets: DataFrame, **options) -> DataFrame:
    """The mix itself: every used row with its copies, and the share of its source wanted and reached."""
    rows = cut_lineage(mixed_rows(documents, targets, **options))
    shares = _report(rows, targets).select("source", "target_share", "actual_share")  # one row a target
    return rows.where("n_copies > 0").join(F.broadcast(shares), "source").select("doc_id", "source", "n_tokens", "n_copies", "target_share", "actual_share")
