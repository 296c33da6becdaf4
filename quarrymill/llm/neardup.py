"""Near-duplicate conversations: small edits, insertions and reordering under other ids.

Method: ProbMinHash. Each shingle is a Poisson process whose rate is its weight; its arrivals fall on random
components of the signature, and a document's processes are run only until no later arrival can still lower a
component (early termination). Equal components estimate the probability Jaccard index. ``weights`` says what a shingle
weighs: ``equal`` (1: the index is the Jaccard index of the sets, which the pairs of p4_found are defined by) or
``counts`` (how often it occurs, for similarity of multisets). Signatures are banded; documents that share a band are
candidates, and every candidate is verified on its whole (multi)set of shingles.

Exact copies form a class first: one representative is banded and verified, and the class' members join the result
at its end. Buckets are joined in blocks, so that a bucket that holds a third of all rows is spread over many tasks.
Texts are read twice and never shuffled: a bitmap of fixed size over hashed ids tells the second reading which rows may
be candidates, at any size of the table by the same plan; only candidates' sets are shuffled.

Edge cases: null or empty messages, null contents and null ids are passed over; a document with fewer words than a
shingle has no shingle and no partner; redelivered rows count once by id; texts of any length are used whole; extra
columns are ignored; empty tables give no pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrymill.llm.words import WORD, messages
from quarrymill.session import cut_lineage, release

ROWS, BANDS, SHINGLE, THRESHOLD, SEED = 4, 36, 3, 0.6, 20_240_607
BLOCK = 256  # members of a bucket that meet in one join key
SLOTS = 1 << 26  # bits of the bitmap of candidates (a broadcast of at most 2^20 rows of two numbers)

_U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64's), element by element."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


class Hasher:
    """Words to 64-bit numbers, shingles to mixed numbers; keeps the numbers of words it has seen, up to a bound."""

    def __init__(self, shingle: int, bound: int = 500_000) -> None:
        self.shingle, self.bound, self.seen = shingle, bound, {}

    def words(self, text: str) -> np.ndarray:
        seen = self.seen
        if len(seen) > self.bound:
            seen.clear()
        out = []
        for w in WORD.findall(text.lower()):
            h = seen.get(w)
            if h is None:
                h = seen[w] = xxhash.xxh64_intdigest(w)
            out.append(h)
        return np.array(out, dtype=np.uint64)

    def weighted(self, text: str, counted: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
        """(words, distinct shingles, how often each occurs) of a text; the last is None unless ``counted``."""
        w = self.words(text)
        found = self.shingles(w)
        return (w, *np.unique(found, return_counts=True)) if counted else (w, np.unique(found), None)

    def shingles(self, words: np.ndarray) -> np.ndarray:
        n = len(words) - self.shingle + 1
        if n <= 0:
            return np.empty(0, np.uint64)
        h = np.zeros(n, np.uint64)
        for i in range(self.shingle):
            h = mix(h * _U(0x9E3779B97F4A7C15) + words[i : i + n])
        return h


def probminhash(doc: np.ndarray, element: np.ndarray, weight: np.ndarray | None, n_docs: int, m: int, seed: int = SEED) -> np.ndarray:
    """Signatures (n_docs x m) of weighted sets given as flat arrays sorted by document.

    Round k draws the k-th arrival of every process that is still running. A process stops when its arrival is
    behind the largest component of its document: arrivals only grow, so it can't lower a component any more.
    Elements of weight 0 have no arrivals. A document without elements gets zeros.
    """
    best = np.full(n_docs * m, np.inf)
    who = np.zeros(n_docs * m, np.uint64)
    at = np.zeros(len(element))
    if weight is not None:
        keep = weight > 0
        doc, element, weight, at = doc[keep], element[keep], weight[keep], at[keep]
    k = 0
    while len(element):
        k += 1
        r = mix(element + _U((seed * 2 + 1) * k * 0x9E3779B97F4A7C15 % 2**64))
        step = -np.log((r >> _U(11)).astype(np.float64) / 2.0**53 + 2.0**-54)
        at = at + (step if weight is None else step / weight)
        place = doc * m + (mix(r ^ _U(0xD6E8FEB86659FD93)) % _U(m)).astype(np.int64)
        np.minimum.at(best, place, at)
        won = best[place] == at
        who[place[won]] = element[won]
        last = best.reshape(n_docs, m).max(axis=1)
        on = at < last[doc]
        doc, element, at = doc[on], element[on], at[on]
        if weight is not None:
            weight = weight[on]
    return who.reshape(n_docs, m)


def spoken(roles: list | None, contents: list | None) -> str:
    """The contents of all messages but the system's, in order."""
    return "\n".join(c for r, c in zip(roles or [], contents or []) if c and r != "system")


_SIGNED = pa.schema([("id", pa.string()), ("class", pa.binary()), ("bands", pa.list_(pa.int64()))])


def _sign(shingle: int, rows: int, bands: int, counted: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher(shingle)
        for big in batches:
            for start in range(0, big.num_rows, 512):
                batch = big.slice(start, 512)
                ids, classes, sets, weights = [], [], [], []
                for record, roles, contents in zip(*(batch.column(c).to_pylist() for c in ("id", "role", "content"))):
                    w, s, n = hasher.weighted(spoken(roles, contents), counted)
                    if len(s):
                        ids.append(record)
                        classes.append(xxhash.xxh128_digest(w.tobytes()))
                        sets.append(s)
                        weights.append(n)
                if not ids:
                    continue
                doc = np.repeat(np.arange(len(ids)), [len(s) for s in sets])
                weight = np.concatenate(weights).astype(np.float64) if counted else None
                sig = probminhash(doc, np.concatenate(sets), weight, len(ids), rows * bands)
                h = np.zeros((len(ids), bands), np.uint64)
                for i in range(rows):
                    h = mix(h * _U(0x9E3779B97F4A7C15) + sig[:, i * bands : (i + 1) * bands])
                h = mix(h + np.arange(bands, dtype=np.uint64))  # the band is part of the bucket
                flat = pa.array(h.astype(np.int64).ravel())
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(ids) * bands + 1, bands), pa.int32()), flat)
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(classes, pa.binary()), lists], schema=_SIGNED)

    return run


_SETS = pa.schema([("id", pa.string()), ("set", pa.list_(pa.int64()))])


def occurrences(element: np.ndarray, count: np.ndarray | None) -> np.ndarray:
    """A multiset as a set: the k-th occurrence of an element is an element of its own."""
    if count is None:
        return element
    before = np.repeat(np.cumsum(count) - count, count)
    return np.unique(mix(np.repeat(element, count) + (np.arange(len(before)) - before).astype(np.uint64) * _U(0xD6E8FEB86659FD93)))


def _shingle_sets(shingle: int, counted: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher(shingle)
        for big in batches:
            for start in range(0, big.num_rows, 512):
                batch = big.slice(start, 512)
                rows = [(i, occurrences(*hasher.weighted(spoken(r, c), counted)[1:]).astype(np.int64)) for i, r, c in zip(*(batch.column(c).to_pylist() for c in ("id", "role", "content")))]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in rows]), pa.array([s for _, s in rows], pa.list_(pa.int64()))], schema=_SETS)

    return run


def signatures(conversations: DataFrame, *, shingle: int = SHINGLE, rows: int = ROWS, bands: int = BANDS, weights: str = "equal") -> DataFrame:
    """(id, class, bands) of every conversation with at least one shingle; class is equal for equal word sequences."""
    return messages(conversations, fields=("role", "content")).mapInArrow(_sign(shingle, rows, bands, weights == "counts"), "id string, class binary, bands array<bigint>")


def maybe_among(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows whose id may be one of ``ids`` (and some others): a test of one bit in a bitmap over hashed ids.

    The bitmap has ``SLOTS`` bits at any number of ids and is broadcast as words of 64 bits; more ids only let more
    other rows pass, which a later join drops."""
    slot = F.pmod(F.xxhash64("id"), F.lit(SLOTS))
    bits = ids.select(slot.alias("_s")).groupBy(F.shiftright("_s", 6).alias("_word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(_s % 64 as int))")).alias("_bits"))
    held = rows.withColumn("_s", slot).withColumn("_word", F.shiftright("_s", 6)).join(F.broadcast(bits), "_word")
    return held.where("getbit(_bits, cast(_s % 64 as int)) = 1").select(*rows.columns)


def candidate_pairs(members: DataFrame, block: int = BLOCK) -> DataFrame:
    """Distinct (id_a < id_b) that share a bucket, from (bucket, id).

    Buckets of one are dropped before the join. A bucket of n members is cut into ceil(n / block) blocks by the hash
    of the id, and each pair of blocks is a join key of its own: no task gets more than two blocks of a bucket.
    """
    sizes = members.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1")
    blocks = F.ceil(F.col("n") / F.lit(block)).cast("int")
    shared = (
        members.join(sizes, "bucket")
        .withColumn("blocks", blocks)
        .withColumn("own", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
        .select("bucket", "id", "own", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
        .select("bucket", "id", "own", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"))
    )
    a = shared.select("bucket", "lo", "hi", F.col("id").alias("id_a"), F.col("own").alias("own_a"))
    b = shared.select("bucket", "lo", "hi", F.col("id").alias("id_b"), F.col("own").alias("own_b"))
    pairs = a.join(b, ["bucket", "lo", "hi"]).where((F.col("id_a") < F.col("id_b")) & ((F.col("own_a") != F.col("own_b")) | (F.col("lo") == F.col("hi"))))
    return pairs.select("id_a", "id_b").distinct()


def linked_classes(conversations: DataFrame, *, threshold: float = THRESHOLD, shingle: int = SHINGLE, rows: int = ROWS, bands: int = BANDS, weights: str = "equal") -> tuple[DataFrame, DataFrame]:
    """(members, links): ``members(id, rep)`` for every conversation with a shingle, where rep is the least id of its
    class; ``links(id_a, id_b, similarity)`` between representatives that are alike."""
    signed = cut_lineage(signatures(conversations, shingle=shingle, rows=rows, bands=bands, weights=weights))
    distinct = signed.groupBy("id").agg(F.first("class").alias("class"))  # redelivered rows have the same words
    classes = distinct.groupBy("class").agg(F.min("id").alias("rep"))
    members = distinct.join(classes, "class").select("id", "rep")
    reps = signed.join(classes.select(F.col("rep").alias("id")), "id", "left_semi").dropDuplicates(["id"])
    buckets = reps.select("id", F.explode("bands").alias("bucket"))
    pairs = cut_lineage(candidate_pairs(buckets))
    wanted = pairs.select(F.col("id_a").alias("id")).union(pairs.select(F.col("id_b").alias("id")))
    chosen = maybe_among(messages(conversations, fields=("role", "content")), wanted)
    sets = chosen.mapInArrow(_shingle_sets(shingle, weights == "counts"), "id string, set array<bigint>").groupBy("id").agg(F.first("set").alias("set"))
    a = sets.select(F.col("id").alias("id_a"), F.col("set").alias("set_a"))
    b = sets.select(F.col("id").alias("id_b"), F.col("set").alias("set_b"))
    both = F.size(F.array_intersect("set_a", "set_b"))
    alike = both / (F.size("set_a") + F.size("set_b") - both)
    links = pairs.join(a, "id_a").join(b, "id_b").select("id_a", "id_b", alike.alias("similarity")).where(F.col("similarity") >= threshold)
    return members, links


def alike_pairs(conversations: DataFrame, **options) -> DataFrame:
    """(id_a < id_b): all pairs of ids whose conversations are alike, members of exact classes included."""
    members, links = linked_classes(conversations, **options)
    links = cut_lineage(links.select("id_a", "id_b"))
    several = members.join(members.groupBy("rep").agg(F.count("*").alias("n")).where("n > 1"), "rep").select("id", "rep")
    within = candidate_pairs(several.select(F.col("rep").alias("bucket"), "id"))
    m = members.select("id", "rep")
    across = (
        links.join(m.select(F.col("rep").alias("id_a"), F.col("id").alias("x")), "id_a")
        .join(m.select(F.col("rep").alias("id_b"), F.col("id").alias("y")), "id_b")
        .select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b"))
    )
    return within.unionByName(across)


def components(links: DataFrame) -> DataFrame:
    """(id, group_id) of connected components; group_id is the least id. Large-star and small-star alternate until a
    round changes nothing, however many rounds that takes; each round is written to the checkpoint folder, the one
    before it is deleted, and only a count reaches the driver."""
    edges = cut_lineage(links.select(F.col("id_a").alias("u"), F.col("id_b").alias("v")).where("u <> v").distinct())
    n_edges = -1
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        low2 = down.groupBy("u").agg(F.min("v").alias("m"))
        joined = down.join(low2, "u")
        small = joined.select("u", F.col("m").alias("v")).union(joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))).distinct()
        new = cut_lineage(small)
        n_new = new.count()
        done = n_new == n_edges and new.join(edges, ["u", "v"], "left_anti").isEmpty()
        release(edges)
        edges, n_edges = new, n_new
        if done:
            break
    return edges.groupBy("u").agg(F.min("v").alias("group_id")).select(F.col("u").alias("id"), "group_id").union(edges.select(F.col("v").alias("id"), F.col("v").alias("group_id"))).groupBy("id").agg(F.min("group_id").alias("group_id"))


def groups(conversations: DataFrame, **options) -> DataFrame:
    """One row per conversation with a shingle: (id, class_id, group_id, n_links), where n_links counts the classes
    that its class is alike to."""
    members, links = linked_classes(conversations, **options)
    links = cut_lineage(links.select("id_a", "id_b"))
    degree = links.select(F.col("id_a").alias("rep")).union(links.select(F.col("id_b").alias("rep"))).groupBy("rep").agg(F.count("*").alias("n_links"))
    group = components(links).withColumnRenamed("id", "rep")
    return (
        members.join(degree, "rep", "left").join(group, "rep", "left")
        .select("id", F.col("rep").alias("class_id"), F.coalesce("group_id", "rep").alias("group_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))
    )
