"""Deeply nested records as related flat tables that keep parent-child links.

Method: each record becomes path-value-ordinal triples, paths are grouped by their nearest repeated ancestor, and each
group is pivoted into one table whose key is the record and the ordinals along the path. ``shred`` does this for typed
columns: the paths are in the schema, so Catalyst keeps positions with one explode per repeated ancestor and reads only
the leaves below the ancestors that are asked for. Raw JSON lines are scanned once from left to right by ``Scanner``,
which emits the triples of any record as it goes (no tree is built and no key is known to it); ``pivot`` groups them.
Neither needs a shuffle: a record's triples never leave its task.

Raw lines: ``Layout`` says which paths hold lists of records, however they are wrapped, and which names mean the same.
There values encoded again as text are decoded, and a lone object, an object of entries or lists of lists count as one
plain list; ``messages``/``conversations``, ``role``/``from`` and ``content``/``value`` are the same keys. What can't be
parsed whole gives no rows.

Edge cases: null or empty containers give no rows; entries that are no objects keep their place but give no row;
missing ids and names are ''; redelivered rows and lines count once by record id; a raw record without id is named
``<shard>:<line_no>``; texts of any length are parsed whole; extra columns are ignored; empty tables give no rows.
"""

from __future__ import annotations

import copy
import itertools
import json
import math
import re
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from json.decoder import scanstring

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# --- typed columns -----------------------------------------------------------------------------------------------


def repeated_paths(schema: T.DataType, prefix: str = "") -> list[str]:
    """Dotted paths of all repeated ancestors in a schema, outermost first."""
    out: list[str] = []
    if isinstance(schema, T.StructType):
        for f in schema.fields:
            out += repeated_paths(f.dataType, f"{prefix}.{f.name}" if prefix else f.name)
    elif isinstance(schema, T.ArrayType):
        out += [prefix, *repeated_paths(schema.elementType, prefix)]
    return list(dict.fromkeys(out))


def leaf_columns(schema: T.DataType, value: Column, taken: list[str], owner: str, prefix: str = "") -> list[Column]:
    """The leaves below ``value`` that aren't repeated, named by their path with underscores; a name that is taken by
    a key column gets its owner's name in front."""
    if isinstance(schema, T.StructType):
        return [c for f in schema.fields for c in leaf_columns(f.dataType, value.getField(f.name), taken, owner, f"{prefix}_{f.name}" if prefix else f.name)]
    name = prefix or "value"
    return [] if isinstance(schema, T.ArrayType) else [value.alias(f"{owner}_{name}" if name in taken else name)]


def repeated_children(schema: T.DataType, prefix: tuple[str, ...] = ()) -> list[tuple[tuple[str, ...], T.ArrayType]]:
    """(path, type) of the arrays below a type that only structs lead to."""
    if isinstance(schema, T.StructType):
        return [c for f in schema.fields for c in repeated_children(f.dataType, (*prefix, f.name))]
    return [(prefix, schema)] if isinstance(schema, T.ArrayType) else []


def shred(df: DataFrame, key: str | list[str]) -> dict[str, DataFrame]:
    """One flat table per repeated ancestor of a typed DataFrame, and one (path '') for the root.

    A table's key is ``key`` (a column or several) and one ordinal ``pos_<k>`` per repeated ancestor on its path, counted
    from 0; its other columns are the group's leaves and ``present``. Null entries keep their ordinal with null leaves
    and are not ``present``. A table reads the leaves of its own ancestor only."""
    keys = [key] if isinstance(key, str) else list(key)
    root = df.select(*keys, *[c for f in df.schema.fields if f.name not in keys for c in leaf_columns(f.dataType, F.col(f.name), keys, "root", f.name)])
    tables = {"": root}

    def walk(frame: DataFrame, keys: list[str], value: Column, schema: T.ArrayType, path: str, level: int) -> None:
        pos = f"pos_{level}"
        entry = frame.select(*keys, F.posexplode(value).alias(pos, "item_"))
        taken = [*keys, pos, "present"]
        tables[path] = entry.select(*keys, pos, F.col("item_").isNotNull().alias("present"), *leaf_columns(schema.elementType, F.col("item_"), taken, path.rpartition(".")[2]))
        for below, child in repeated_children(schema.elementType):
            inner = value
            for f in below:
                inner = inner.getField(f)
            walk(frame.select(*keys, F.posexplode(inner).alias(pos, "item_")), [*keys, pos], F.col("item_"), child, ".".join((path, *below)) if below else path + "[]", level + 1)

    for f in df.schema.fields:
        if f.name not in keys:
            for below, child in repeated_children(f.dataType):
                value = F.col(f.name)
                for x in below:
                    value = value.getField(x)
                walk(df, keys, value, child, ".".join((f.name, *below)), 0)
    return tables


def typed_calls(conversations: DataFrame) -> DataFrame:
    """(rec_id, msg_pos, item_pos, item_key, function_name, arguments, tool_pos) of every tool call."""
    names = F.col("tools").getField("function").getField("name").alias("names")
    calls = shred(conversations.where("id IS NOT NULL").select(F.col("id").cast("string").alias("rec_id"), names, "conversations"), ["rec_id", "names"])["conversations.tool_calls"]
    return calls.where("present").select(
        "rec_id", F.col("pos_0").alias("msg_pos"), F.col("pos_1").alias("item_pos"), F.coalesce("id", F.lit("")).alias("item_key"), "function_name", F.col("function_arguments").alias("arguments"),
        F.coalesce(F.array_position("names", F.col("function_name")).cast("int") - 1, F.lit(-1)).alias("tool_pos"),
    )


def typed_tools(conversations: DataFrame) -> DataFrame:
    """(rec_id, item_pos, item_key, type, description, parameters) of every declared tool."""
    tools = shred(conversations.where("id IS NOT NULL").select(F.col("id").cast("string").alias("rec_id"), "tools"), "rec_id")["tools"]
    return tools.where("present").select("rec_id", F.col("pos_0").alias("item_pos"), F.coalesce("function_name", F.lit("")).alias("item_key"), "type", F.col("function_description").alias("description"), F.col("function_parameters").alias("parameters"))


# --- raw lines ---------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Layout:
    """Paths (``[]`` behind each repeated ancestor) at which a record holds lists of records, with the names that tell a
    lone record from an object of entries; and paths of single objects that may be encoded again as text."""

    lists: dict[str, frozenset[str]]
    objects: frozenset[str] = frozenset()


_CALL, _MESSAGE = frozenset({"id", "type", "function"}), frozenset({"role", "from", "content", "value"})
CONVERSATION = Layout(
    {"conversations": _MESSAGE, "messages": _MESSAGE, "conversations[].tool_calls": _CALL, "messages[].tool_calls": _CALL, "tools": frozenset({"type", "function", "name"})},
    frozenset({"conversations[].tool_calls[].function", "messages[].tool_calls[].function", "tools[].function"}),
)

Triple = tuple[str, tuple[int, ...], object]
_SPACE, _SCALAR = re.compile(r"[ \t\n\r]*"), re.compile(r"null|true|false|NaN|-?Infinity|-?(?:0|[1-9]\d*)(\.\d+)?([eE][-+]?\d+)?")
_CONSTANTS = {"null": None, "true": True, "false": False, "NaN": math.nan, "Infinity": math.inf, "-Infinity": -math.inf}
DEPTH = 8  # how often a value may be encoded again as text


class Whole:
    """The value of a triple of an object or a list itself: where it stands in its text."""

    __slots__ = ("text", "start", "end")

    def __init__(self, text: str, start: int, end: int) -> None:
        self.text, self.start, self.end = text, start, end


class Scanner:
    """Reads one JSON text from left to right and emits (path, ordinals, value) of every leaf, object and list to
    ``out``. An entry of a list of records also gives a triple for itself (value: whether it is an object), so that
    entries without leaves keep their place. Raises ValueError at text that is no JSON."""

    def __init__(self, text: str, layout: Layout, out: list[Triple], depth: int = DEPTH) -> None:
        self.text, self.layout, self.out, self.depth = text, layout, out, depth

    def _skip(self, i: int) -> int:
        return _SPACE.match(self.text, i).end()

    def whole(self, path: str, ordinals: tuple[int, ...]) -> str:
        """Scans the text as one value; gives its first character."""
        i = self._skip(0)
        if self._skip(self.value(i, path, ordinals)) != len(self.text):
            raise ValueError("text behind the value")
        return self.text[i]

    def value(self, i: int, path: str, ordinals: tuple[int, ...]) -> int:
        """Scans the value at ``i``; gives the place behind it."""
        if path in self.layout.lists:
            return self.records(i, path, ordinals)
        c = self.text[i : i + 1]
        if c == "{":
            end, _ = self.object(i, path, ordinals)
            self.out.append((path, ordinals, Whole(self.text, i, end)))
            return end
        if c == "[":
            end = self.elements(i, lambda j, n: self.value(j, path + "[]", (*ordinals, n)))
            self.out.append((path, ordinals, Whole(self.text, i, end)))
            return end
        value, end = self.scalar(i)
        if isinstance(value, str) and path in self.layout.objects and self.inner(value, path, ordinals, "{") is not None:
            return end
        self.out.append((path, ordinals, value))
        return end

    def scalar(self, i: int) -> tuple[object, int]:
        if self.text[i : i + 1] == '"':
            return scanstring(self.text, i + 1)
        m = _SCALAR.match(self.text, i)
        if not m:
            raise ValueError("no value")
        word = m[0]
        return (_CONSTANTS[word] if word in _CONSTANTS else float(word) if m[1] or m[2] else int(word)), m.end()

    def object(self, i: int, path: str, ordinals: tuple[int, ...]) -> tuple[int, dict[str, tuple[int, str]]]:
        """Scans an object; gives the place behind it and where each key's value begins, with its first character. Of
        a key given twice the last value counts."""
        found: dict[str, tuple[int, str]] = {}
        i = self._skip(i + 1)
        if self.text[i : i + 1] == "}":
            return i + 1, found
        while True:
            if self.text[i : i + 1] != '"':
                raise ValueError("no key")
            key, i = scanstring(self.text, i + 1)
            i = self._skip(i)
            if self.text[i : i + 1] != ":":
                raise ValueError("no colon")
            i = self._skip(i + 1)
            below = f"{path}.{key}" if path else key
            if key in found:
                self.out[:] = [t for t in self.out if not (t[1][: len(ordinals)] == ordinals and (t[0] == below or t[0].startswith((below + ".", below + "[]"))))]
            found[key] = (i, self.text[i : i + 1])
            i = self._skip(self.value(i, below, ordinals))
            if self.text[i : i + 1] == "}":
                return i + 1, found
            if self.text[i : i + 1] != ",":
                raise ValueError("no comma")
            i = self._skip(i + 1)

    def elements(self, i: int, each: Callable[[int, int], int]) -> int:
        """Scans a list, ``each`` element (place, number) by the caller; gives the place behind it."""
        i, n = self._skip(i + 1), 0
        if self.text[i : i + 1] == "]":
            return i + 1
        while True:
            i = self._skip(each(i, n))
            n += 1
            if self.text[i : i + 1] == "]":
                return i + 1
            if self.text[i : i + 1] != ",":
                raise ValueError("no comma")
            i = self._skip(i + 1)

    def records(self, i: int, path: str, ordinals: tuple[int, ...]) -> int:
        """Scans a list of records in any wrapping as one plain list."""
        count = itertools.count()
        start, mark = i, len(self.out)
        if self.text[i : i + 1] == "{":
            end, found = self.object(i, path, ordinals)
            if not self.layout.lists[path].isdisjoint(found):  # a lone record: its triples belong to entry 0
                at = len(ordinals)
                self.out[mark:] = [(path + "[]" + p[len(path) :], (*o[:at], 0, *o[at:]), v) for p, o, v in self._again(start, path, ordinals, mark)]
                self.out.append((path + "[]", (*ordinals, 0), True))
            else:
                del self.out[mark:]
                if found and all(c in "{[" for _, c in found.values()):
                    for j, _ in found.values():
                        self.record(j, path, ordinals, count)
        elif self.text[i : i + 1] == "[":
            end = self.elements(i, lambda j, n: self.record(j, path, ordinals, count))
        else:
            value, end = self.scalar(i)
            if isinstance(value, str):
                self.inner(value, path, ordinals, "{[")
            self.out.append((path, ordinals, value))
            return end
        self.out.append((path, ordinals, Whole(self.text, start, end)))
        return end

    def _again(self, start: int, path: str, ordinals: tuple[int, ...], mark: int) -> list[Triple]:
        """The triples of a lone record, scanned with the paths of an entry where its own lists are declared by them."""
        deeper = [p for p in (*self.layout.lists, *self.layout.objects) if p.startswith(path + "[]")]
        if not deeper:
            return self.out[mark:]
        cut = len(path) + 2
        inner = Layout({path + p[cut:]: k for p, k in self.layout.lists.items() if p.startswith(path + "[]")}, frozenset(path + p[cut:] for p in self.layout.objects if p.startswith(path + "[]")))
        out: list[Triple] = []
        Scanner(self.text, inner, out, self.depth).object(start, path, ordinals)
        return out

    def record(self, i: int, path: str, ordinals: tuple[int, ...], count: Iterator[int]) -> int:
        """Scans one element of a list of records: a record, a list of records, either as text, or something else."""
        c = self.text[i : i + 1]
        if c == "[":
            return self.elements(i, lambda j, n: self.record(j, path, ordinals, count))
        if c == "{":
            here = (*ordinals, next(count))
            self.out.append((path + "[]", here, True))
            return self.object(i, path + "[]", here)[0]
        value, end = self.scalar(i)
        if isinstance(value, str) and value.lstrip()[:1] in ("{", "[") and self.depth:
            out: list[Triple] = []
            inner = Scanner(value, self.layout, out, self.depth - 1)
            taken = copy.copy(count)
            try:
                j = inner._skip(inner.record(inner._skip(0), path, ordinals, taken))
                if j != len(value):
                    raise ValueError("text behind the value")
            except (ValueError, RecursionError):
                pass
            else:
                for _ in range(next(taken) - next(copy.copy(count))):
                    next(count)
                self.out += out
                return end
        self.out.append((path + "[]", (*ordinals, next(count)), False))
        return end

    def inner(self, value: str, path: str, ordinals: tuple[int, ...], wanted: str) -> str | None:
        """Scans a text that was encoded again; gives its first character, or null (and no triples) if it isn't what is
        ``wanted`` or can't be parsed whole."""
        depth = self.depth
        while depth:
            depth -= 1
            out: list[Triple] = []
            try:
                text = value
                first = text.lstrip(" \t\n\r")[:1]
                if first == '"':
                    value = json.loads(text)
                    continue
                if not first or first not in wanted:
                    return None
                Scanner(text, self.layout, out, depth).whole(path, ordinals)
            except (ValueError, RecursionError):
                return None
            self.out += out
            return first
        return None


def triples(text: str, layout: Layout = CONVERSATION) -> list[Triple] | None:
    """(path, ordinals, value) of everything in one JSON record, which may be encoded again as text or be the only
    element of a list; null if it can't be parsed whole or is no object."""
    for _ in range(DEPTH + 1):
        out: list[Triple] = []
        scanner = Scanner(text, layout, out)
        try:
            i = scanner._skip(0)
            first = text[i : i + 1]
            if first == '"':
                value, end = scanstring(text, i + 1)
                if scanner._skip(end) != len(text):
                    return None
                text = value
                continue
            if first == "[":  # a list of one record
                ends: list[int] = []
                end = scanner.elements(i, lambda j, n: (ends.append(j), Scanner(text, layout, []).value(j, "", ()))[1])
                if scanner._skip(end) != len(text) or len(ends) != 1 or text[ends[0]] != "{":
                    return None
                scanner.object(ends[0], "", ())
                return out
            if first != "{" or scanner._skip(scanner.object(i, "", ())[0]) != len(text):
                return None
            return out
        except (ValueError, RecursionError):
            return None
    return None


def pivot(found: Iterable[Triple]) -> dict[str, dict[tuple[int, ...], dict[str, object]]]:
    """Triples by repeated ancestor and ordinals: ``{ancestor: {ordinals: {leaf: value}}}``, root under ''."""
    groups: dict[str, dict[tuple[int, ...], dict[str, object]]] = {}
    for path, ordinals, value in found:
        ancestor, mark, leaf = path.rpartition("[]")
        row = groups.setdefault(ancestor + mark, {}).setdefault(ordinals, {})
        row[leaf[1:] if mark and leaf else leaf] = value
    return groups


def text_of(value) -> str | None:
    """A leaf as text: strings as they are, other values as JSON."""
    if value is None or isinstance(value, str):
        return value
    if isinstance(value, Whole):
        value = json.loads(value.text[value.start : value.end])
    return json.dumps(value, ensure_ascii=False)


def either(row: dict[str, object], name: str, other: str) -> object:
    value = row.get(name)
    return row.get(other) if value is None else value


RAW_SCHEMA = "kind string, rec_id string, msg_pos int, item_pos int, item_key string, type string, function_name string, tool_pos int, role string, content string, reasoning_content string, name string, tool_call_id string, payload string, description string"
_RAW = pa.schema([(n, pa.int32() if n in ("msg_pos", "item_pos", "tool_pos") else pa.string()) for n in (x.split()[0] for x in RAW_SCHEMA.split(", "))])


def raw_rows(shard: str | None, line_no: int | None, line: str | None, texts: bool) -> Iterator[tuple]:
    """Rows of all four tables for one line; ``texts``: also those of records and messages, with their texts."""
    found = triples(line) if line else None
    if found is None:
        return
    groups = pivot(found)
    root = groups.get("", {}).get((), {})
    rec = root.get("id")
    rec = f"{shard}:{line_no}" if rec is None or rec == "" else text_of(rec)
    messages = "conversations[]" if root.get("conversations") is not None else "messages[]"
    if texts:
        yield ("record", rec, -1, -1, None, None, None, None, None, None, None, None, None, None, None)
        for (m,), r in sorted(groups.get(messages, {}).items()):
            if r[""]:
                said = (either(r, "role", "from"), either(r, "content", "value"), *(r.get(k) for k in ("reasoning_content", "name", "tool_call_id")))
                yield ("message", rec, m, -1, None, None, None, None, *map(text_of, said), None, None)
    first: dict[str, int] = {}
    for (t,), r in sorted(groups.get("tools[]", {}).items()):
        if r[""]:
            leaf = (lambda k: r.get(f"function.{k}")) if "function" in r or "function.name" in r else r.get  # noqa: B023
            name = text_of(leaf("name")) or ""
            if name:
                first.setdefault(name, t)
            yield ("tool", rec, -1, t, name, text_of(r.get("type")), name, t, None, None, None, None, None, text_of(leaf("parameters")) if texts else None, text_of(leaf("description")) if texts else None)
    for (m, c), r in sorted(groups.get(f"{messages}.tool_calls[]", {}).items()):
        if r[""]:
            name = text_of(r.get("function.name"))
            yield ("call", rec, m, c, text_of(r.get("id")) or "", text_of(r.get("type")), name, first.get(name, -1) if name else -1, None, None, None, None, None, text_of(r.get("function.arguments")) if texts else None, None)


def raw_tables(lines: DataFrame, *, texts: bool = True) -> DataFrame:
    """All rows of the four tables of raw JSON lines (shard, line_no, line), told apart by ``kind``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [r for s, n, t in zip(*(b.column(i).to_pylist() for i in range(3))) for r in raw_rows(s, n, t, texts)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _RAW)], schema=_RAW)

    return lines.select(F.col("shard").cast("string"), F.col("line_no").cast("long"), F.col("line").cast("string")).mapInArrow(run, RAW_SCHEMA)


# --- the tables ----------------------------------------------------------------------------------------------------

KEY = ["rec_id", "kind", "msg_pos", "item_pos"]


_ITEM = ["rec_id", "kind", "msg_pos", "item_pos", "item_key", "tool_pos"]


def _typed_items(conversations: DataFrame) -> DataFrame:
    calls = typed_calls(conversations).withColumn("kind", F.lit("call")).select(_ITEM)
    tools = typed_tools(conversations).select("rec_id", F.lit("tool").alias("kind"), F.lit(-1).alias("msg_pos"), "item_pos", "item_key", F.col("item_pos").alias("tool_pos"))
    return calls.unionByName(tools)


def typed_items(conversations: DataFrame) -> DataFrame:
    """(rec_id, kind, msg_pos, item_pos, item_key, tool_pos): calls and declared tools of typed rows, each once."""
    return _typed_items(conversations).dropDuplicates(KEY)


def items(conversations: DataFrame, lines: DataFrame) -> DataFrame:
    """As ``typed_items``, of typed rows and raw lines together."""
    return _typed_items(conversations).unionByName(raw_tables(lines, texts=False).select(_ITEM)).dropDuplicates(KEY)


def flat_tables(conversations: DataFrame, lines: DataFrame) -> dict[str, DataFrame]:
    """``records``, ``messages``, ``calls`` and ``tools`` of both tables; each row names its parents by rec_id,
    msg_pos and tool_pos. Redelivered rows count once."""
    raw = raw_tables(lines)
    typed = conversations.where("id IS NOT NULL")
    pick = lambda kind, *columns: raw.where(F.col("kind") == kind).select(*columns)
    records = typed.select(F.col("id").cast("string").alias("rec_id")).unionByName(pick("record", "rec_id")).dropDuplicates(["rec_id"])
    message = ["role", "content", "reasoning_content", "name", "tool_call_id"]
    messages = (
        typed.select(F.col("id").cast("string").alias("rec_id"), F.posexplode("conversations").alias("msg_pos", "m")).where("m IS NOT NULL").select("rec_id", "msg_pos", *[F.col("m").getField(c).alias(c) for c in message])
        .unionByName(pick("message", "rec_id", "msg_pos", *message)).dropDuplicates(["rec_id", "msg_pos"])
    )
    calls = typed_calls(conversations).unionByName(pick("call", "rec_id", "msg_pos", "item_pos", "item_key", "function_name", F.col("payload").alias("arguments"), "tool_pos")).dropDuplicates(["rec_id", "msg_pos", "item_pos"])
    tools = typed_tools(conversations).unionByName(pick("tool", "rec_id", "item_pos", "item_key", "type", "description", F.col("payload").alias("parameters"))).dropDuplicates(["rec_id", "item_pos"])
    return {"records": records, "messages": messages, "calls": calls, "tools": tools}
