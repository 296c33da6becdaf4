"""Text functions: identifiers, rewriting, repetition and leak tests. All are built-in expressions (no Python rows)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Marks of hidden reasoning in lower case. Fixed values.
THINK_MARKERS = ("<think>", "</think>", "<|channel>", "<channel|>", "<|think|>")
IMAGE = "<image>"


def stable_id(*parts: Column) -> Column:
    """md5 of the parts joined without a separator; a null part counts as ''."""
    return F.md5(F.concat(*[F.coalesce(p, F.lit("")) for p in parts]))


def fold_handle(c: Column) -> Column:
    """Letters and digits of a handle in lower case."""
    return F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]", "")


def config_base(c: Column) -> Column:
    """A sharded configuration's name without ``-part-NN-of-NN``."""
    return F.regexp_replace(c, r"-part-\d+-of-\d+$", "")


def id_config(c: Column) -> Column:
    """The part of a record id before its last ``#``; the whole id if there is none."""
    return F.when(F.instr(c, "#") > 0, F.regexp_extract(c, r"(?s)^(.*)#[^#]*$", 1)).otherwise(c)


def is_blank(c: Column) -> Column:
    """Null, empty or white space only."""
    return F.coalesce(~c.rlike(r"\S"), F.lit(True))


def word_count(c: Column) -> Column:
    """Number of runs of non-space characters."""
    return F.size(F.filter(F.split(c, r"\s+"), lambda w: w != ""))


def has_think_marker(c: Column) -> Column:
    low = F.lower(F.coalesce(c, F.lit("")))
    out = F.lit(False)
    for m in THINK_MARKERS:
        out = out | F.contains(low, F.lit(m))
    return out


def strip_reasoning(c: Column) -> Column:
    """What follows the last closing reasoning mark, without an unclosed block."""
    return F.trim(F.regexp_replace(F.substring_index(c, "</think>", -1), r"(?is)<think>.*", ""))


def squeeze(c: Column) -> Column:
    """White space runs as single spaces, none at the ends."""
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def repeats_prompt(question: Column, answer: Column, *, least: int = 40, ratio: float = 0.8) -> Column:
    """Whether one of two texts of similar length holds the other (white space apart)."""
    q, a = squeeze(F.coalesce(question, F.lit(""))), squeeze(F.coalesce(answer, F.lit("")))
    lq, la = F.length(q), F.length(a)
    return (lq >= least) & (la >= least) & (F.least(lq, la) >= ratio * F.greatest(lq, la)) & (F.contains(q, a) | F.contains(a, q))


def distinct_chunk_share(c: Column, chunk: int = 64) -> Column:
    """Distinct windows of ``chunk`` characters over all windows; null for null and empty texts."""
    n = F.ceil(F.length(c) / F.lit(chunk)).cast("int")
    parts = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.substring(c, i * chunk + 1, F.lit(chunk)))
    return F.when(F.length(c) > 0, F.size(F.array_distinct(parts)) / n)


def is_degenerate(c: Column, *, least: int = 4000, share: float = 0.25) -> Column:
    """Whether a long text keeps repeating the same windows."""
    return F.when(F.length(c) >= least, distinct_chunk_share(c) < share).otherwise(F.lit(False))


def count_of(c: Column, needle: str) -> Column:
    """Non-overlapping occurrences of a fixed string."""
    return ((F.length(c) - F.length(F.replace(c, F.lit(needle), F.lit("")))) / len(needle)).cast("int")


def image_parts(c: Column) -> Column:
    """Text and picture parts of a message in order: array of (type, text); blank text parts are left out."""
    pieces = F.split(c, IMAGE, -1)
    last = F.size(pieces) - 1
    pairs = F.transform(
        pieces,
        lambda t, i: F.array(F.struct(F.lit("text").alias("type"), F.trim(t).alias("text")), F.struct(F.when(i < last, "image").otherwise("none").alias("type"), F.lit("").alias("text"))),
    )
    return F.filter(F.flatten(pairs), lambda p: (p.type == "image") | ((p.type == "text") & (p.text != "")))


def append_once(content: Column, suffix: str) -> Column:
    """``content`` with an instruction at its end, unless it is there."""
    return F.when(F.contains(content, F.lit(suffix)), content).otherwise(F.concat(F.rtrim(content), F.lit("\n" + suffix)))


def strip_phrases(content: Column, phrases: list[str]) -> Column:
    """Fixed instructions replaced by a space, the longest first; line ends trimmed, three or more line feeds as two."""
    out = content
    for p in sorted(phrases, key=len, reverse=True):
        out = F.replace(out, F.lit(p), F.lit(" "))
    out = F.array_join(F.transform(F.split(out, "\n", -1), lambda x: F.rtrim(x)), "\n")
    return F.trim(F.regexp_replace(out, "\n{3,}", "\n\n"))


def removed_phrases(content: Column, phrases: list[str]) -> Column:
    """Which of the phrases a text holds, the longest first."""
    return F.filter(F.array(*[F.when(F.contains(content, F.lit(p)), F.lit(p)) for p in sorted(phrases, key=len, reverse=True)]), lambda x: x.isNotNull())


def model_label(c: Column) -> Column:
    """A model path as a short label: no leading folders, no maker's prefix, no format suffix."""
    out = F.regexp_replace(c, r"^.*/", "")
    out = F.regexp_replace(out, r"(?i)[-_](bf16|fp16|fp8|int4|int8|awq|gptq)$", "")
    return F.regexp_replace(out, r"(?i)[-_](instruct|chat|base)$", "")


def data_url(content: Column, path: Column) -> Column:
    """Bytes of a picture as a data URL; its type by suffix."""
    kind = F.when(F.lower(path).rlike(r"\.jpe?g$"), "image/jpeg").when(F.lower(path).rlike(r"\.webp$"), "image/webp").when(F.lower(path).rlike(r"\.gif$"), "image/gif").otherwise("image/png")
    return F.concat(F.lit("data:"), kind, F.lit(";base64,"), F.regexp_replace(F.base64(content), r"\s", ""))


def image_suffix(content: Column) -> Column:
    """File suffix of a picture by its first bytes; null if unknown."""
    h = F.hex(F.substring(content, 1, 12))
    return (
        F.when(h.startswith("FFD8FF"), ".jpg").when(h.startswith("89504E470D0A1A0A"), ".png").when(h.startswith("474946383761") | h.startswith("474946383961"), ".gif")
        .when(h.startswith("52494646") & (F.substring(h, 17, 8) == "57454250"), ".webp").when(h.startswith("424D"), ".bmp")
    )
