"""Word and message helpers used by several operators of this subpackage."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A run of letters or digits.
WORD = re.compile(r"[^\W_]+")


def words(text: str | None) -> list[str]:
    """The words of ``text`` in lower case; [] for null."""
    return WORD.findall(text.lower()) if text else []


def runs(tokens: list[str], n: int) -> set[tuple[str, ...]]:
    """The distinct runs of ``n`` consecutive tokens; empty if there are fewer than ``n``."""
    return set(zip(*(tokens[i:] for i in range(n)))) if len(tokens) >= n else set()


def lcs_length(a: list[str], b: list[str]) -> int:
    """Length of the longest common subsequence, one big-integer word per row (bit-parallel)."""
    if not a or not b:
        return 0
    where: dict[str, int] = {}
    for i, x in enumerate(a):
        where[x] = where.get(x, 0) | (1 << i)
    full = (1 << len(a)) - 1
    row = full
    for y in b:
        hit = row & where.get(y, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


def messages(df: DataFrame, *, fields: Iterable[str] = ("role", "content", "reasoning_content")) -> DataFrame:
    """``id`` and one array per message field, in message order. Null structs give nulls; rows without an id or
    without messages are left out. Only the named leaves are read from the file."""
    arrays = [F.col("conversations").getField(f).alias(f) for f in fields]
    return df.where(F.col("id").isNotNull() & (F.size("conversations") > 0)).select(F.col("id").cast("string").alias("id"), *arrays)


def source_of(record_id: str) -> str:
    """The folded handle before ``#`` in a record id: letters and digits in lower case."""
    return "".join(WORD.findall(record_id.rpartition("#")[0].lower())) or "unknown"


def rows_of(batches: Iterator, *names: str) -> Iterator[tuple]:
    """Rows of Arrow batches as tuples of Python values."""
    for batch in batches:
        yield from zip(*(batch.column(n).to_pylist() for n in names))
