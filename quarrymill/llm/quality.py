"""Per-document measures of wording and layout, and the verdict which documents aren't natural prose.

Method: tables and lists are found from vertical delimiter alignment, from the period of indentation and entry signs
(which joins continuation lines to their entry, and is evidence for a list of lines), and from the autocorrelation of
line lengths, combined with word, symbol and punctuation ratios.

A document is judged on its body: what is left without heading lines and without one opening sentence. ``kind`` is
``junk``, ``table`` or ``list``; null for natural prose, and for null and blank texts, whose measures are 0.

Edge cases: a null id stays null; repeated rows give repeated rows; texts of any length are measured whole; extra
columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrymill.llm.pairs import FUNCTION_WORDS
from quarrymill.llm.truncation import to_batches

COMMON = frozenset(w for v in FUNCTION_WORDS.values() for w in v.split())
WORD = re.compile(r"[^\W_]+")
WIDE = re.compile(r"[぀-ヿ㐀-鿿가-힯฀-๿]")
WRECK = re.compile(r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\x9f�]|[ÂÃ][ -¿]|â€|[ÐÑ][ -¿]")
HEX = re.compile(r"(?<!\w)(?:0x[0-9a-fA-F]+|(?=[0-9a-fA-F]*\d)[0-9a-fA-F]{8,}|\d{8,})(?!\w)")
ENTRY = re.compile(r"[ \t]*(?:[-*+•‣◦–▪>→☐☑✓]|\[[ xX]\]|\(?\d{1,4}(?:\.\d+)*[.):]|\(?[A-Za-z][.)]|\(?[ivxIVX]{1,5}[.)]|v?\d+(?:\.\d+)+)[ \t]+\S")
LEADER = re.compile(r"(?:\.{3,}|(?:\. ){3,}|_{4,}|-{4,})\s*\S{1,8}$")
FIELD = re.compile(r"[^\s:=][^:=]{0,40}(?::|=|->|→| - | – )[ \t]*\S")
HEADING = re.compile(r"\s*(?:#{1,6}[ \t]|={3,}$|-{3,}$|\*{3,}$)")
TERMINALS, CLOSERS = frozenset(".?!。？！…"), "\"'»”)]` "
NUMERIC = re.compile(r"[-+]?[\d.,]+%?$|n/?a$|-$", re.IGNORECASE)
GAP = re.compile(r"(?<=\S)(?: {2,}|\t+)(?=\S)")
TAG = re.compile(r"<[^<>\n]+>")
SENTENCE_END = re.compile(r"[.?!。？！][\"'»”)]*(?:\s|$)|[。？！]")
CELL = re.compile(r"</t[dh]>|</tr>|<t[dh][ >]", re.IGNORECASE)
DELIMITERS = ("\t", "|", "│", "¦", ";", ",", "&", " :: ", "</td>")


def is_entry(line: str) -> bool:
    """Whether a line begins with the sign or number of an entry, or leads to a page number."""
    return ENTRY.match(line) is not None or (line[-1:].isdigit() and LEADER.search(line) is not None)


def is_full(line: str) -> bool:
    """Whether a line ends as a sentence does."""
    return line[-1:] in TERMINALS or line.rstrip(CLOSERS)[-1:] in TERMINALS


def autocorrelation(lengths: list[int], most: int = 12) -> tuple[float, int]:
    """The largest autocorrelation of line lengths over lags 1 to ``most``, and its lag; (1, 1) if all are equal."""
    n = len(lengths)
    if n < 4:
        return 0.0, 0
    mean = sum(lengths) / n
    d = [x - mean for x in lengths]
    var = sum(x * x for x in d)
    if var == 0:
        return 1.0, 1
    best = max(((sum(d[i] * d[i + k] for i in range(n - k)) / var, k) for k in range(1, min(most, n // 2) + 1)), default=(0.0, 0))
    return round(best[0], 6), best[1]


def period(values: list[int], most: int = 12) -> tuple[float, int]:
    """(strength, lag) of the period of a sequence: the largest autocorrelation over lags from 2 on, each lag by the
    terms it has; 0 for sequences that are constant or too short to repeat."""
    n = len(values)
    mean = sum(values) / max(1, n)
    d = [x - mean for x in values]
    var = sum(x * x for x in d)
    if n < 4 or var == 0:
        return 0.0, 0
    best = max((sum(d[i] * d[i + k] for i in range(n - k)) / (n - k) / (var / n), -k) for k in range(2, min(most, n // 2) + 1))
    return round(min(1.0, best[0]), 6), -best[1]


def depths(lines: list[str]) -> list[int]:
    return [len(x) - len(x.lstrip()) for x in lines]


def indent_period(lines: list[str]) -> float:
    """How strongly the indentation of lines recurs with a period."""
    return max(0.0, period(depths(lines))[0])


def folded(lines: list[str], signs: list[bool], least: float = 0.3) -> list[bool]:
    """Whether each line is an entry, once continuation lines are joined to theirs: where indentation or entry signs
    recur with a period, a line without a sign that stands deeper than the last sign belongs to that entry."""
    deep = depths(lines)
    if all(signs) or not any(signs) or max(period(deep)[0], period([int(s) for s in signs])[0]) < least:
        return signs
    out: list[bool] = []
    level = -1
    for sign, d in zip(signs, deep):
        if sign:
            level = d
        elif 0 <= level < d:
            continue
        else:
            level = -1
        out.append(sign)
    return out


def aligned_delimiter(lines: list[str]) -> tuple[str, float, int]:
    """(delimiter, share of lines with its modal count, modal count) of the delimiter that aligns best."""
    best = ("", 0.0, 0)
    for d in DELIMITERS:
        counts = [x.count(d) for x in lines]
        present = [c for c in counts if c]
        if len(present) < 0.7 * len(lines):
            continue
        modal, n = Counter(present).most_common(1)[0]
        share = n / len(lines)
        if (share * min(modal, 3), share) > (best[1] * min(best[2], 3), best[1]):
            best = (d, share, modal)
    return best


def aligned_columns(lines: list[str]) -> int:
    """Number of text columns at which at least 85 % of the lines begin a field after a gap of blanks."""
    starts: Counter[int] = Counter()
    for x in lines:
        starts.update({m.end() for m in GAP.finditer(x)})
    return sum(n >= 0.85 * len(lines) for n in starts.values())


def short_opening(text: str, room: int = 1) -> bool:
    """Whether a text may be an opening: one sentence of any length, or a few (``room``: none if negative) in 60 words."""
    return sum(1 for _ in SENTENCE_END.finditer(text)) <= 1 or room >= 0 and len(text.split()) <= 60


def body_of(text: str) -> list[str]:
    """Lines of the body: no blank lines, no headings, no opening sentence (if anything is left without it)."""
    lines = [x.rstrip() for x in text.split("\n")]
    kept = [x for x in lines if x.strip() and not HEADING.match(x)]
    if len(kept) > 1 and is_full(kept[0]) and not is_entry(kept[0]) and len(kept[0].split()) >= 4 and short_opening(kept[0]):
        return kept[1:]
    if len(kept) > 3:  # an opening sentence may be wrapped: up to the first blank line
        first = next((i for i, x in enumerate(lines) if not x.strip()), 0)
        opening = [x for x in lines[:first] if not HEADING.match(x)]
        if opening and is_full(opening[-1]) and short_opening(" ".join(opening), 4 - len(opening)) and not any(map(is_entry, opening)):
            return kept[len(opening) :] or kept
    return kept


def repeated(body: str, lines: list[str], low: list[str]) -> str | None:
    """``repeated`` if the body says the same over and over."""
    if len(lines) >= 6 and len({x.strip() for x in lines}) <= 0.34 * len(lines):
        return "repeated"
    if len(low) >= 30 and len(set(low)) < 0.15 * len(low) ** 0.9:
        raw = body.encode("utf-8", "replace")
        if len(zlib.compress(raw, 6)) < 0.12 * len(raw):
            return "repeated"
    return None


def junk_reason(lines: list[str], found: list[str], common: int, table: bool) -> str | None:
    """Why nobody would read the body; None if it reads as something.

    ``found``: its words in lower case; ``common``: how many of them are common words of two letters or more. A body
    in which they are as frequent as in prose can only be wrecked or endlessly repeated."""
    body = "\n".join(lines)
    solid = len(body) - sum(body.count(c) for c in " \n\t")
    if solid == 0:
        return None
    tokens = body.split()
    low = [w for w in found if w.isalpha()]
    per_token = solid / len(tokens)
    readable = len(low) >= 8 and common >= 0.1 * len(low) and per_token < 20  # pieces of a blob may look like words
    n_wide = len(WIDE.findall(body)) if not body.isascii() else 0
    if not body.isascii() and len(WRECK.findall(body)) > 0.03 * solid:
        return "wrecked"
    if len(tokens) >= 12 and per_token < 2.5 and sum(len(t) == 1 and t.isalpha() for t in tokens) > 0.6 * len(tokens) and not n_wide:
        return "spaced"
    if readable:
        return repeated(body, lines, low)
    cells = CELL.search(body) is not None
    tags = sum(len(t) for t in TAG.findall(body)) if "<" in body else 0
    if tags > 0.5 * solid and not cells:
        return "markup"
    if not table and sum(map(len, found)) < 0.5 * solid:
        return "symbols"
    if not table and len(HEX.findall(body)) >= 0.25 * len(tokens) and len(tokens) >= 3:
        return "dump"
    if not n_wide and max(map(len, tokens)) > 40 and sum(len(t) for t in tokens if len(t) > 40 and not t.startswith(("http", "www.")) and not cells) > 0.5 * solid:
        return "blob"
    if not table and body.lstrip()[:1] in "{[" and sum(body.count(c) for c in '{}[]":,') > 0.3 * solid:
        return "dump"
    if reason := repeated(body, lines, low):
        return reason
    if not table and not n_wide and len(low) >= 12 and len(low) >= 7 * len(lines) and common < 0.05 * len(low):
        return "gibberish"
    return None


def measures(text: str | None) -> tuple:
    """(n_words, mean_word_length, symbol_ratio, punctuated_lines, common_words, alignment, entry_share,
    indent_recurrence, line_autocorrelation, kind, reason)."""
    if text is None or not text.strip():
        return (0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, None, None)
    lines = [x.rstrip() for x in text.split("\n") if x.strip()]
    body = body_of(text)
    rest = list((Counter(lines) - Counter(body)).elements()) if len(body) < len(lines) else []
    found = WORD.findall("\n".join(body).lower())
    beside = WORD.findall("\n".join(rest).lower())
    n, size = len(found) + len(beside), sum(map(len, found)) + sum(map(len, beside))
    common = sum(w in COMMON for w in found if len(w) > 1)
    solid = len(text) - sum(map(text.count, " \n\t\r"))
    delimiter, share, modal = aligned_delimiter(body) if len(body) >= 2 else ("", 0.0, 0)
    signs = folded(body, list(map(is_entry, body)))
    entries = sum(signs) / len(signs) if signs else 0.0
    recurrence = indent_period(body)
    correlation, _ = autocorrelation(list(map(len, body)))
    kind, reason = verdict(body, found, common, delimiter, share, modal, entries, correlation, recurrence)
    return (
        n, round(size / n, 6) if n else 0.0, round(max(0, solid - size) / max(1, solid), 6), round(sum(map(is_full, lines)) / len(lines), 6),
        round((common + sum(w in COMMON for w in beside if len(w) > 1)) / n, 6) if n else 0.0, round(share, 6), round(entries, 6), round(recurrence, 6), correlation, kind, reason,
    )


def verdict(body: list[str], found: list[str], common: int, delimiter: str, share: float, modal: int, entries: float, correlation: float, recurrence: float) -> tuple[str | None, str | None]:
    """(kind, reason) of a document from its body and layout measures."""
    if not body:
        return None, None
    n = len(body)
    full = sum(map(is_full, body)) / n
    per_line = sum(len(x.split()) for x in body) / n
    table = None
    if n >= 3 and delimiter and share >= 0.8 and entries < 0.8:
        fields = [f.strip() for x in body for f in x.split(delimiter) if f.strip()]
        short = sum(len(f.split()) <= 4 and not is_full(f) for f in fields) / max(1, len(fields))
        numeric = sum(NUMERIC.match(f) is not None for f in fields) / max(1, len(fields))
        if short >= 0.85 and (delimiter != "," or modal >= 2 or numeric >= 0.3) and (delimiter not in ",;" or numeric >= 0.2 or modal >= 2 and full < 0.2):
            table = "delimiter"
    if table is None and n >= 3 and sum(CELL.search(x) is not None for x in body) >= 0.7 * n:
        table = "cells"
    if table is None and n >= 3 and entries < 0.8 and full < 0.3 and aligned_columns(body) >= 1 and per_line <= 12:
        if sum(len(GAP.findall(x)) >= 1 for x in body) >= 0.85 * n:
            table = "columns"
    reason = junk_reason(body, found, common, table is not None)
    if reason:
        return "junk", reason
    if table:
        return "table", table
    if n >= 3 and entries >= 0.8:
        return "list", "entries"
    if n >= 4 and full <= 0.1 and per_line <= 7 and sum(len(x) for x in body) / n <= 60:
        named = sum(FIELD.match(x) is not None for x in body) / n
        if entries >= 0.5 or named >= 0.8 or per_line <= 6 or correlation >= 0.5 or recurrence >= 0.5 or common < 0.12 * max(1, len(found)):
            return "list", "lines"
    return None, None


SCHEMA = "doc_id bigint, n_words long, mean_word_length double, symbol_ratio double, punctuated_lines double, common_words double, alignment double, entry_share double, indent_recurrence double, line_autocorrelation double, kind string, reason string"
_ARROW = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), *((c, pa.float64()) for c in ("mean_word_length", "symbol_ratio", "punctuated_lines", "common_words", "alignment", "entry_share", "indent_recurrence", "line_autocorrelation")), ("kind", pa.string()), ("reason", pa.string())])


def _run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def rows() -> Iterator[tuple]:
        for b in batches:
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                yield (doc, *measures(text))

    yield from to_batches(rows(), _ARROW, 5_000)


def document_quality(documents: DataFrame) -> DataFrame:
    """One row per document with its measures, kind and reason; no shuffle."""
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(_run, SCHEMA)
