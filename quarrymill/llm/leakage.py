"""Evaluation passages inside training documents.

Method: pigeonhole edit matching. The words of a test item are split into pieces so short that each of its runs of
five words holds a whole one: an item that keeps enough runs whatever its edits must keep their pieces. Exact piece
hits come from one Aho-Corasick pass over the document's words. Each stretch of hits on one diagonal is verified with
Myers' bit-parallel distance (on words, with integers of any width): a stretch of L words at distance d holds at most
L - d - 4 whole runs, and an item whose stretches can't hold enough runs is rejected there. What Myers' distance lets
pass is checked exactly: the share of the item's distinct runs of five words decides.

Why no leak is lost: a document has a run only if it has every piece inside it, on the run's diagonal, whatever was
changed, inserted, left out, repeated or moved around it. So the share of the item's runs whose pieces are all hit is
never below the share that the document has (stock phrases of many items are dropped by that before any alignment);
and on a diagonal the words that runs cover are matched by the alignment along it, so the distance is at most the
number of the others. Items of few pieces use all their runs as pieces.

Items are sent to the tasks in blocks of bounded size, each block a scan of the documents of its own.

Edge cases: null and blank texts have no hits; items with fewer words than a run never match; null ids stay null;
items listed twice count once by id; texts of any length are matched whole; extra columns are ignored; empty tables
give no rows.
"""

from __future__ import annotations

import uuid
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterator
from itertools import accumulate

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrymill.llm.truncation import to_batches
from quarrymill.llm.words import runs, words

RUN, THRESHOLD = 5, 0.4
#: UTF-8 bytes of items that are sent to the tasks at once; more items are matched in several blocks. A block's automaton
#: takes about 80 times that in each Python worker (8 MB: 11 500 items, 419 000 pieces, 670 MB, built in 15 s).
ITEM_BYTES = 4 << 20


def piece_length(run: int = RUN) -> int:
    """The longest p for which any ``run`` words hold a whole one of the pieces of p words laid end to end."""
    return max(1, (run + 1) // 2)


def myers_distance(pattern: list[str], text: list[str]) -> int:
    """The least edit distance between ``pattern`` and any stretch of ``text``, in words (Myers 1999)."""
    m = len(pattern)
    if not m:
        return 0
    where: dict[str, int] = {}
    for i, w in enumerate(pattern):
        where[w] = where.get(w, 0) | (1 << i)
    full, top = (1 << m) - 1, 1 << (m - 1)
    up, down, score = full, 0, m
    best = m
    for w in text:
        eq = where.get(w, 0)
        xv = eq | down
        xh = (((eq & up) + up) ^ up) | eq
        ph = down | (full & ~(xh | up))
        mh = up & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        ph = (ph << 1) & full  # the first row is free: a match may begin anywhere
        up = ((mh << 1) & full) | (full & ~(xv | ph))
        down = ph & xv
        if score < best:
            best = score
    return best


class Item:
    """A test item, its pieces and what their hits can amount to."""

    def __init__(self, item_id: int, text: str | None, run: int, p: int) -> None:
        self.item_id, self.words = item_id, words(text)
        self.runs = runs(self.words, run)
        self.known: dict[int, float] = {}
        n, self.run, self.p = len(self.words), run, p
        if n < run:
            self.starts, self.size = [], run
        elif n <= 4 * p:
            self.starts, self.size = list(range(n - run + 1)), run
        else:
            self.starts, self.size = list(range(0, n - p + 1, p)), p
        # for each distinct run the pieces it holds whole, as bits
        needs: dict[tuple[str, ...], int] = dict.fromkeys(self.runs, 0)
        if self.size < run:
            for j, s in enumerate(self.starts):
                for i in range(max(0, s + p - run), min(s, n - run) + 1):
                    needs[tuple(self.words[i : i + run])] |= 1 << j
        self.needs = list(needs.values())

    def most(self, hit: set[int]) -> float:
        """As ``bound``; sets of hits that occurred before (stock phrases) are looked up."""
        mask = 0
        for j in hit:
            mask |= 1 << j
        value = self.known.get(mask)
        if value is None:
            if len(self.known) > 5_000:
                self.known.clear()
            value = self.known[mask] = self.bound(hit)
        return value

    def bound(self, hit: set[int]) -> float:
        """The largest share of distinct runs that a document can hold if only the pieces in ``hit`` are in it."""
        if self.size == self.run:
            return 1.0 if hit else 0.0
        missed = 0
        for j in range(len(self.starts)):
            if j not in hit:
                missed |= 1 << j
        return sum(not need & missed for need in self.needs) / len(self.runs)


class Matcher:
    """The automaton over all pieces of a block of items."""

    def __init__(self, items: list[tuple], run: int, threshold: float) -> None:
        p = piece_length(run)
        self.run, self.threshold = run, threshold
        self.items = [Item(i, t, run, p) for i, t in items]
        owners: dict[tuple[str, ...], list[tuple[int, int]]] = defaultdict(list)
        for k, item in enumerate(self.items):
            for j, s in enumerate(item.starts):
                owners[tuple(item.words[s : s + item.size])].append((k, j))
        self.owners = list(owners.values())
        self.automaton = ahocorasick.Automaton()
        for n, piece in enumerate(owners):
            self.automaton.add_word(" " + " ".join(piece) + " ", (n, len(piece)))
        if owners:
            self.automaton.make_automaton()
        # items that the pieces they share with many others can't carry over the threshold alone
        shared = [set() for _ in self.items]
        for own in self.owners:
            if len({k for k, _ in own}) > 3:
                for k, j in own:
                    shared[k].add(j)
        self.needs_own = [item.most(s) < threshold for item, s in zip(self.items, shared)]
        self.stock = [len({k for k, _ in own}) > 3 for own in self.owners]

    def leaks(self, text: str | None) -> Iterator[tuple]:
        """(item_id, n_hits, leaked_words, edit_distance, containment) of each item of which ``text`` has enough."""
        if not text or not self.owners:
            return
        tokens = words(text)
        if len(tokens) < self.run:
            return
        joined = " " + " ".join(tokens) + " "
        found = list(self.automaton.iter(joined))
        if not found:
            return
        behind = list(accumulate((len(w) + 1 for w in tokens), initial=0))  # where the blank behind each word stands
        hits: dict[int, list[tuple[int, int]]] = defaultdict(list)  # by item: (piece, first word in the document)
        stock: list[tuple[int, int]] = []
        for end, (n, size) in found:
            at = bisect_left(behind, end) - size
            if self.stock[n]:
                stock.append((n, at))
            for k, j in self.owners[n]:
                if not (self.stock[n] and self.needs_own[k]):
                    hits[k].append((j, at))
        if not hits:
            return
        for n, at in stock:
            for k, j in self.owners[n]:
                if self.needs_own[k] and k in hits:
                    hits[k].append((j, at))
        have = None
        for k, at in hits.items():
            item = self.items[k]
            if item.most({j for j, _ in at}) < self.threshold:
                continue
            most, leaked, distance = self.verify(item, at, tokens)
            if most < self.threshold * len(item.runs):
                continue
            if have is None:
                have = runs(tokens, self.run)
            share = len(item.runs & have) / len(item.runs)
            if share >= self.threshold:
                yield item.item_id, len({j for j, _ in at}), leaked, distance, round(share, 6)

    def verify(self, item: Item, at: list[tuple[int, int]], tokens: list[str]) -> tuple[int, int, int]:
        """(whole runs of the item that the document can hold at most, words of the item found, edit distance) from
        Myers' distances of the stretches of hits, widened by a piece on both sides."""
        diagonals: dict[int, set[int]] = defaultdict(set)
        for j, d in at:
            diagonals[d - item.starts[j]].add(item.starts[j])
        most = leaked = distance = 0
        seen = bytearray(len(item.words))
        for diagonal in sorted(diagonals, key=lambda x: (-len(diagonals[x]), x)):
            places = sorted(diagonals[diagonal])
            first = places[0]
            for here, after in zip(places, [*places[1:], None]):
                if after is not None and after - here <= 8 * item.p:
                    continue
                a, b = max(0, first - item.p), min(len(item.words), here + item.size + item.p)
                d = myers_distance(item.words[a:b], tokens[max(0, diagonal + a - item.p) : max(0, diagonal + b + item.p)])
                most += max(0, b - a - d - (self.run - 1))
                fresh = b - a - sum(seen[a:b])
                leaked += max(0, fresh - d)
                distance += min(d, fresh)
                seen[a:b] = b"\x01" * (b - a)
                first = after
        return most, leaked, distance


_HELD: dict[str, Matcher] = {}


def held_matcher(name: str, block: list[tuple], run: int, threshold: float) -> Matcher:
    """The matcher of a block, built once in each Python worker; only the block in use is held."""
    if name not in _HELD:
        _HELD.clear()
        _HELD[name] = Matcher(block, run, threshold)
    return _HELD[name]


SCHEMA = "doc_id bigint, item_id bigint, n_hits int, leaked_words int, edit_distance int, containment double"
_ARROW = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("n_hits", pa.int32()), ("leaked_words", pa.int32()), ("edit_distance", pa.int32()), ("containment", pa.float64())])


def item_blocks(items: DataFrame, limit: int) -> Iterator[list[tuple]]:
    """The items in blocks of at most ``limit`` bytes of text, read one row after the other."""
    held, size, last = [], 0, object()
    rows = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("item_id IS NOT NULL AND text IS NOT NULL").orderBy("item_id", "text")
    for item_id, text in rows.toLocalIterator():
        if item_id == last:
            continue
        last = item_id
        n = len(text.encode("utf-8", "replace"))
        if held and size + n > limit:
            yield held
            held, size = [], 0
        held.append((item_id, text))
        size += n
    if held:
        yield held


def leaked_items(documents: DataFrame, items: DataFrame, *, run: int = RUN, threshold: float = THRESHOLD, item_bytes: int = ITEM_BYTES) -> DataFrame:
    """(doc_id, item_id, n_hits, leaked_words, edit_distance, containment) of every leak; one scan of the documents a
    block of items and no shuffle."""
    spark = documents.sparkSession
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = None
    for block in item_blocks(items, item_bytes):
        sent = spark.sparkContext.broadcast(block)

        def match(batches: Iterator[pa.RecordBatch], sent=sent, name=uuid.uuid4().hex) -> Iterator[pa.RecordBatch]:
            matcher = held_matcher(name, sent.value, run, threshold)

            def rows() -> Iterator[tuple]:
                for b in batches:
                    for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                        for leak in matcher.leaks(text):
                            yield (doc, *leak)

            yield from to_batches(rows(), _ARROW)

        part = texts.mapInArrow(match, SCHEMA)
        out = part if out is None else out.unionByName(part)
    return spark.createDataFrame([], SCHEMA) if out is None else out
