"""Values that lost their end.

Method: a structural completeness check with a stack automaton (quotes, brackets, fences, markup, broken multibyte
sequences and escapes), missing terminators against the source's own baseline, and two corpus statistics for what
structure can't tell: lengths at which a source's values pile up (size limits), and words that occur only as ends.

Edge cases: null, empty and blank values are never cases; a value that only consists of a marker isn't either; null
structs and null roles are passed over; system messages are passed over; of redelivered rows the first counts, so a
case is listed once; a value of any length is processed whole; extra columns are ignored; empty tables give no rows.
"""

from __future__ import annotations

import json
import re
from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrymill.llm.words import messages, rows_of, source_of
from quarrymill.session import cut_lineage

CLOSED, OPEN, CASUAL, ITEM, PLAIN = "closed", "open", "casual", "item", "plain"

#: Signs that transfer tools leave at a cut. Fixed values.
MARKER = re.compile(r"\s*(?:\.\.\.|…|[\[(<{](?:\.\.\.|…|truncated|snip|snipped|cut|cut off|clipped|continued|more|omitted|gekürzt|tronqué|truncado|обрезано)[\])>}])$", re.IGNORECASE)
BROKEN = re.compile(r"(?:\ufffd|[\ud800-\udfff]|\\u[0-9a-fA-F]{0,3}|\\x[0-9a-fA-F]?|(?<!\\)\\|&#?\w{0,6}|%[0-9A-Fa-f]|</?)$")
OPEN_TAG = re.compile(r"</?[A-Za-z][\w:.-]*(?:\s[^<>\n]*)?")
FENCE = re.compile(r"^[ \t]*(```+|~~~+)", re.MULTILINE)
ENTRY = re.compile(r"\s*(?:[-*+•‣◦–]|\(?\d{1,3}[.)]|\(?[A-Za-z][.)])\s+")
STRUCT = re.compile(r'["(){}\[\]`«»“”„「」]|\*\*|\\.')
TERMINAL = frozenset(".?!。？！؟।")
CLOSERS = frozenset(")]}\"'`»”’」*_>")
PAIRS = {")": "(", "]": "[", "}": "{", "»": "«", "”": "“", "」": "「"}
TOKEN = re.compile(r"[^\W_]+")
ENDED = re.compile(r"[.?!。？！][\"'»”)`*]*$")
CUT_SENTENCE = re.compile(r"[.?!:]['\"»”)]*\s+|\n+|[。？！]")
LETTERS, DIGITS = re.compile(r"[^\W\d_]+"), re.compile(r"\d+")


def json_complete(text: str) -> bool | None:
    """Whether a text that begins like JSON also ends like it; None if it isn't JSON at all.

    A pushdown automaton over brackets and quoted strings; anything after the outermost value makes it 'not JSON'.
    """
    if text[-1] in "}]":
        try:
            json.loads(text)
            return True
        except ValueError:
            pass
    head = text[1:].lstrip()
    if head and not (head[0] in '"[{]}-' or head[0].isdigit() or head[:4] in ("true", "null") or head[:5] == "false"):
        return None
    stack, in_string = [], False
    for m in re.finditer(r'\\.|["{}\[\]]', text):
        c = m[0]
        if c == '"':
            in_string = not in_string
        elif not in_string and c in "{[":
            stack.append(c)
        elif not in_string and c in "}]":
            if not stack or stack.pop() != {"}": "{", "]": "["}[c]:
                return None
            if not stack:
                return True if m.end() == len(text) else None
    return not (stack or in_string)


def stack_open(text: str) -> bool:
    """Whether brackets, quotes, inline code or strong markup opened in ``text`` are still open at its end.

    Closing signs without an opening one (entries like ``a)``) are ignored; so are signs inside inline code.
    """
    stack: list[str] = []
    code = False
    for m in STRUCT.finditer(text):
        c = m[0]
        if c[0] == "\\" and len(c) == 2:
            continue
        if c == "`":
            code = not code
        elif code:
            continue
        elif c in ('"', "**"):
            if c in stack:
                del stack[stack.index(c) :]
            else:
                stack.append(c)
        elif c in "([{«“„「":
            stack.append(c)
        elif c in PAIRS:
            want = PAIRS[c]
            if want in stack:
                del stack[len(stack) - 1 - stack[::-1].index(want) :]
            elif c == "”" and "„" in stack:
                stack.remove("„")
        if c == "“" and len(stack) > 1 and stack[-2] == "„":
            del stack[-2:]
    return code or bool(stack)


def shape(line: str) -> str:
    return DIGITS.sub("9", LETTERS.sub("a", line.strip()))


def first_cased(text: str) -> str:
    for c in text:
        if c in "`\"'“„«([{*":
            continue
        if c.isalpha():
            return c
        if c.isdigit():
            return "9"
    return ""


def end_state(value: str) -> tuple[str, str, str]:
    """(state, reason, last word) of one value.

    ``closed``: it ends as a whole text does. ``open``: it is cut. ``casual``, ``item``, ``plain``: it has no
    terminator but is of a kind that needs none (questions in casual spelling; entries of a list; values and rows
    of logs), so that only the corpus can tell.
    """
    text = value.rstrip()
    if not text:
        return CLOSED, "blank", ""
    last = text[-1]
    if last in "\ufffd\\":
        return OPEN, "bytes", ""
    if last in ".…])>}" and (m := MARKER.search(text)):
        body = text[: m.start()]
        if TOKEN.search(body):
            return OPEN, "marker", ""
        return CLOSED, "blank", ""
    lead = text.lstrip()
    if lead[0] in "{[" and (whole := json_complete(lead)) is not None:
        return (CLOSED, "json", "") if whole else (OPEN, "json", "")
    tail = text
    if "```" in text or "~~~" in text:
        marks = list(FENCE.finditer(text))
        if len(marks) % 2:
            return OPEN, "fence", ""
        if marks:
            tail = text[marks[-1].end() :].strip("`~")
            if not tail.strip():
                return CLOSED, "fence", ""
    tail = tail.rstrip()
    paragraph = tail.rpartition("\n\n")[2]
    if not TOKEN.search(tail):
        return CLOSED, "fence" if tail is not text else "signs", ""
    if stack_open(paragraph) and stack_open(tail):
        return OPEN, "stack", ""
    if last in TERMINAL:
        return CLOSED, "terminator", ""
    if last in CLOSERS:
        return CLOSED, "closer", ""
    line = paragraph.rpartition("\n")[2].rstrip()
    if last == "," or BROKEN.search(text[-12:]) or OPEN_TAG.fullmatch(text, max(0, text.rfind("<"))):
        return OPEN, "separator" if last == "," else "escape", ""
    found = TOKEN.findall(line)
    end = found[-1].lower() if found and line.endswith(found[-1]) else ""
    before = [x for x in paragraph.split("\n")[:-1] if x.strip()]
    if m := ENTRY.match(line):
        if CUT_SENTENCE.search(line[m.end() :]) is None:
            return ITEM, "entry", end
    elif len(before) >= 1 and " " in line.strip() or "/" in line or "=" in line:
        form, forms = shape(line), [shape(x) for x in before]
        if form in forms:
            return PLAIN, "row", end
        if len(forms) >= 2 and len(set(forms)) == 1 and not forms[0].endswith((".", "?", "!")) and form != forms[0]:
            return OPEN, "row", end
    letters = [w for w in found if len(w) > 1 and w.isalpha()]
    if not before and CUT_SENTENCE.search(line) is None and (len(letters) <= 2 or "=" in line or "/" in line.split(" ")[0]):
        return PLAIN, "value", end
    if last == ":":
        return PLAIN, "colon", end
    pieces = CUT_SENTENCE.split(line)
    begin = first_cased(pieces[-1]) or first_cased(line)
    cased = LETTERS.findall(line)
    if begin.islower() or cased and all(w.isupper() for w in cased):
        return CASUAL, "casual", end
    return OPEN, "sentence", end


#: kind 'v': a value; kind 'w': how often a word occurred, and how often as the end of a sentence (with an id: in one
#: delivery of that conversation). ``again``: the row's conversation may have been delivered more than once.
SCHEMA = "kind string, id string, msg_pos int, field string, source string, role string, n_chars int, state string, reason string, word string, total long, ending long, again boolean"
_TYPES = {"int": pa.int32(), "long": pa.int64(), "boolean": pa.bool_(), "string": pa.string()}
_ARROW = pa.schema([(n, _TYPES[t]) for n, t in (c.split() for c in SCHEMA.split(", "))])

FLUSH = 4_000_000  # characters of words held by a task before partial counts are passed on
SLOTS = 1 << 23  # bits of the bitmap of redelivered ids (1 MB); n such ids let n / SLOTS of the other rows be compared by key too


class EndCounts:
    """Partial counts of words and of sentence ends; bounded memory, summed by a later aggregate.

    Strings between blanks are counted as they are, and signs are taken off once per distinct string; strings of over
    ``LONG`` characters (scripts without blanks, blobs), which hardly recur, are taken apart at once.
    """

    LONG = 60

    def __init__(self) -> None:
        self.held: Counter[str] = Counter()
        self.total: Counter[str] = Counter()
        self.ending: Counter[str] = Counter()
        self.seen = 0

    def add(self, value: str) -> None:
        parts = value.lower().split()
        self.seen += len(value)
        if len(value) > self.LONG and max(map(len, parts)) > self.LONG:
            for x in parts:
                if len(x) > self.LONG:
                    self._count(x, 1)
            parts = [x for x in parts if len(x) <= self.LONG]
        self.held.update(parts)

    def _count(self, blank_free: str, n: int) -> None:
        found = TOKEN.findall(blank_free)
        for w in found:
            self.total[w] += n
        if found and ENDED.search(blank_free):
            self.ending[found[-1]] += n

    @property
    def full(self) -> bool:
        """Whether enough text was seen to pass the counts on; a bound on memory even if no word recurs."""
        return self.seen > FLUSH

    def rows(self, record: str | None = None) -> Iterator[tuple]:
        """What is held, as rows; ``record``: the id, where the counts are those of one delivery of it."""
        for blank_free, n in self.held.items():
            self._count(blank_free, n)
        for w, n in self.total.items():
            yield ("w", record, None, None, None, None, None, None, None, w, n, self.ending.get(w, 0))
        self.__init__()


def value_row(record: str, pos: int, field: str, role: str, value: str) -> tuple:
    state, reason, word = end_state(value)
    return ("v", record, pos, field, source_of(record), role, len(value), state, reason, word, None, None)


def to_batches(rows: Iterator[tuple], schema: pa.Schema, size: int = 20_000) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    for r in rows:
        held.append(r)
        if len(held) >= size:
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*held), schema)], schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*held), schema)], schema=schema)


def slot(record_id: str = "id") -> Column:
    """The place of an id in the bitmap of ``repeated_slots``."""
    return F.pmod(F.xxhash64(record_id), F.lit(SLOTS)).cast("int")


def repeated_slots(records: DataFrame) -> bytes:
    """A bitmap of fixed size with a bit for every id that occurs more than once. Other ids may share a bit: it only
    tells which rows must name their id with their counts. Reads the ids alone and shuffles their hashes."""
    twice = records.groupBy(F.xxhash64("id").alias("h")).agg(F.count("*").alias("n")).where("n > 1").select(F.pmod("h", F.lit(SLOTS)).cast("int").alias("at"))
    parts = twice.groupBy(F.shiftright("at", 15).alias("part")).agg(F.bitmap_construct_agg(F.col("at").bitwiseAND(F.lit(32767)).cast("long")).alias("bits"))
    out = bytearray(SLOTS // 8)
    for part, bits in parts.toLocalIterator():
        out[part * 4096 : (part + 1) * 4096] = bits
    return bytes(out)


def scan_texts(conversations: DataFrame, extra: Callable[..., Iterator[tuple]] | None = None) -> DataFrame:
    """One pass over the texts: a small row for each value, partial word counts, and the rows that ``extra`` makes of
    (id, roles, contents). Ids that may be redelivered get counts of their own, which ``judge`` takes once."""
    fields = ("content", "reasoning_content")
    texts = messages(conversations, fields=("role", *fields)).withColumn("slot", slot())
    sent = conversations.sparkSession.sparkContext.broadcast(repeated_slots(messages(conversations, fields=()).select("id")))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            repeated, counts, single = sent.value, EndCounts(), EndCounts()
            for record, at, roles, *values in rows_of(batches, "id", "slot", "role", *fields):
                again = bool(repeated[at >> 3] >> (at & 7) & 1)
                held = single if again else counts
                for pos, role in enumerate(roles or []):
                    if role not in ("user", "assistant", "tool"):
                        continue
                    for field, column in zip(fields, values):
                        if (value := column[pos]) and not value.isspace():
                            yield (*value_row(record, pos, field, role, value), again)
                            held.add(value)
                if extra and roles:
                    for row in extra(record, roles, values[0]):
                        yield (*row, again)
                if again:
                    for row in single.rows(record):
                        yield (*row, True)
                elif counts.full:
                    for row in counts.rows():
                        yield (*row, False)
            for row in counts.rows():
                yield (*row, False)

        yield from to_batches(rows(), _ARROW)

    return texts.mapInArrow(scan, SCHEMA)


def value_ends(conversations: DataFrame) -> DataFrame:
    """One pass over the texts: a small row for each value, and word counts."""
    return scan_texts(conversations)


def once_each(rows: DataFrame, keys: list[str]) -> DataFrame:
    """One row for each key. Only rows of conversations that may have been delivered again are compared by key."""
    return rows.where("NOT again").unionByName(rows.where("again").dropDuplicates(keys))


def size_limits(values: DataFrame, *, min_count: int = 5, factor: float = 6.0, reach: int = 25) -> DataFrame:
    """Lengths at which the values of a source and field pile up: (source, field, n_chars, at_limit).

    A length is a limit if it occurs at least ``min_count`` times and ``factor`` times as often as the lengths of the
    ``reach`` characters below it on average, and at least half of these values end amid something (short answers
    and status words also pile up, but are whole). Lengths are
    pre-aggregated, so a hot source costs no more than its number of distinct lengths.
    """
    by = values.groupBy("source", "field", "n_chars").agg(F.count("*").alias("n"), F.sum((F.col("state") == OPEN).cast("int")).alias("unclosed"))
    w = Window.partitionBy("source", "field").orderBy("n_chars").rangeBetween(-reach, -1)
    near = F.coalesce(F.sum("n").over(w), F.lit(0)) / F.lit(float(reach))
    return (
        by.withColumn("near", near)
        .where((F.col("n") >= min_count) & (F.col("n") >= factor * F.greatest(F.col("near"), F.lit(0.5))) & (F.col("unclosed") * 2 >= F.col("n")))
        .select("source", "field", "n_chars", F.lit(True).alias("at_limit"))
    )


def judge(values: DataFrame, counts: DataFrame, *, fragment: float = 0.5, rare_end: float = 0.004, casual_sources: float = 0.6, evidence: int = 30) -> DataFrame:
    """Adds ``cut`` to rows of kind 'v' (one per id, msg_pos and field) from the corpus' own statistics.

    * unclosed at a size limit of its source: cut;
    * a last word that is hardly ever seen but as such an end (``fragment``: other occurrences per end): cut;
    * a casual question that ends with a common word that ends sentences in less than ``rare_end`` of its
      occurrences: cut;
    * a sentence without terminator: cut, unless the share of such values in its source, role and field is above
      ``casual_sources`` over at least ``evidence`` values (a source that never writes terminators); then only the
      tests above count.
    """
    values = once_each(values, ["id", "msg_pos", "field"]).drop("total", "ending", "again")
    counts = once_each(counts, ["id", "word"])
    limits = size_limits(values)
    soft = values.where(F.col("state") != CLOSED)
    ends = soft.where(F.col("word") != "").groupBy("word").agg(F.count("*").alias("as_end"))
    known = counts.groupBy("word").agg(F.sum("total").alias("total"), F.sum("ending").alias("ending")).join(ends, "word")
    key = ["source", "role", "field"]
    base = values.where(F.col("reason").isin("terminator", "sentence")).groupBy(*key).agg(F.avg((F.col("reason") == "sentence").cast("double")).alias("unterminated"), F.count("*").alias("n_prose")).where(F.col("n_prose") >= evidence)
    rest = F.col("total") - F.col("as_end")
    return (
        soft.join(limits, ["source", "field", "n_chars"], "left")
        .join(known, "word", "left")
        .join(base, key, "left")
        .withColumn("piece", F.coalesce((F.col("word") != "") & (F.col("reason") != "value") & ~F.col("word").rlike(r"\d") & (rest < fragment * F.col("as_end")), F.lit(False)))
        .withColumn("mid", F.coalesce((F.col("state") == CASUAL) & (F.col("total") >= 200) & (F.col("ending") < rare_end * F.col("total")) & ~F.col("word").rlike(r"\d"), F.lit(False)))
        .withColumn("lax", F.coalesce((F.col("reason") == "sentence") & (F.col("unterminated") > casual_sources), F.lit(False)))
        .withColumn("cut", ((F.col("state") == OPEN) & ~F.col("lax")) | F.coalesce("at_limit", F.lit(False)) | F.col("piece") | F.col("mid"))
    )


def truncated_values(conversations: DataFrame) -> DataFrame:
    """(id, msg_pos, field, source, reason) of every value that lost its end."""
    scanned = cut_lineage(value_ends(conversations))
    judged = judge(scanned.where("kind = 'v'"), scanned.where("kind = 'w'"))
    reason = F.when(F.col("state") == OPEN, F.col("reason")).when(F.coalesce("at_limit", F.lit(False)), "limit").when(F.col("piece"), "fragment").otherwise("mid-sentence")
    return judged.where("cut").select("id", "msg_pos", "field", "source", "role", reason.alias("reason"))


def truncation_report(conversations: DataFrame) -> DataFrame:
    """(source, field, n_values, n_cut, share_cut): how often each source truncates. Blank values don't count."""
    scanned = cut_lineage(value_ends(conversations))
    values = once_each(scanned.where("kind = 'v'"), ["id", "msg_pos", "field"])
    cut = judge(scanned.where("kind = 'v'"), scanned.where("kind = 'w'")).where("cut").groupBy("source", "field").agg(F.count("*").alias("n_cut"))
    return (
        values.groupBy("source", "field").agg(F.count("*").alias("n_values"))
        .join(cut, ["source", "field"], "left")
        .select("source", "field", "n_values", F.coalesce("n_cut", F.lit(0)).alias("n_cut"), F.round(F.coalesce("n_cut", F.lit(0)) / F.col("n_values"), 6).alias("share_cut"))
    )
