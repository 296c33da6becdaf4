"""Projections of source rows onto one conversation schema, and row expansions.

A conversation row is (id, conversations ARRAY<STRUCT<role, content>>[, source]). Projections are expressions over the
columns of their source; rows that a projection can't use get a null ``conversations``; messages that it drops are
counted in ``skipped``. All shapes are kept per row: no shuffle but where a row number over the table is asked for.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrymill.functions import text as X

#: Names that chat exports use for roles. Fixed values.
SHAREGPT_ROLES = {"human": "user", "gpt": "assistant", "chatgpt": "assistant", "bing": "assistant", "bard": "assistant"}


def message(role: str, content: Column) -> Column:
    return F.struct(F.lit(role).alias("role"), content.alias("content"))


def exchange(question: Column, answer: Column) -> Column:
    """A conversation of one question and one answer."""
    return F.array(message("user", question), message("assistant", answer))


def sharegpt_role(c: Column) -> Column:
    return reduce(lambda out, kv: out.when(c == kv[0], kv[1]), SHAREGPT_ROLES.items(), F.when(F.lit(False), None))


def from_sharegpt(turns: Column) -> tuple[Column, Column]:
    """(conversations, skipped) of turns (from, value): turns of any other speaker are dropped and counted."""
    mapped = F.transform(turns, lambda t: F.struct(sharegpt_role(t.getField("from")).alias("role"), t.getField("value").alias("content")))
    kept = F.filter(mapped, lambda m: m.role.isNotNull())
    return kept, F.coalesce(F.size(turns) - F.size(kept), F.lit(0))


def from_chat(messages: Column) -> Column:
    """Messages of users and assistants as they are; any other role is an error."""
    return F.transform(
        messages,
        lambda m: F.struct(F.when(m.role.isin("user", "assistant"), m.role).otherwise(F.raise_error(F.concat(F.lit("unexpected role: "), F.coalesce(m.role, F.lit("null"))))).alias("role"), m.content.alias("content")),
    )


def normalised(m: Column) -> Column:
    """One message of either naming (role, content) or (from, value) as (role, content)."""
    return F.struct(F.coalesce(F.when(m.role != "", m.role), sharegpt_role(m.getField("from")), m.getField("from")).alias("role"), F.coalesce(F.when(m.content != "", m.content), m.getField("value"), F.lit("")).alias("content"))


def lettered(options: Column) -> Column:
    """Options as ``A. text`` lines."""
    return F.array_join(F.transform(options, lambda o, i: F.concat(F.substring(F.lit("ABCDEFGHIJ"), i + 1, F.lit(1)), F.lit(". "), o)), "\n")


def shuffled(options: Column, key: Column, seed: int) -> Column:
    """Options in the order of md5(seed, key, option): the same on every run."""
    keyed = F.transform(options, lambda o: F.struct(F.md5(F.concat_ws("|", F.lit(str(seed)), key, o)).alias("k"), o.alias("o")))
    return F.transform(F.array_sort(keyed), lambda s: s.o)


Projection = Callable[[DataFrame], DataFrame]
PRESETS: dict[str, Projection] = {}


def preset(name: str) -> Callable[[Projection], Projection]:
    """Registers a projection under a source's name."""

    def add(f: Projection) -> Projection:
        PRESETS[name] = f
        return f

    return add


def _pair_preset(name: str, question: Callable[[], Column], answer: Callable[[], Column], key: Callable[[], Column] | None = None) -> None:
    @preset(name)
    def project(df: DataFrame) -> DataFrame:
        given = F.col("id").cast("string") if "id" in df.columns else F.lit(None).cast("string")
        made = X.stable_id(question(), answer())
        return df.select((key() if key else F.coalesce(F.when(given != "", given), made)).alias("id"), exchange(question(), answer()).alias("conversations"), F.lit(0).alias("skipped"))


_c = F.col
_pair_preset("instruction-output", lambda: _c("instruction"), lambda: _c("output"), lambda: X.stable_id(_c("instruction"), _c("output")))
_pair_preset("instruction-response", lambda: _c("instruction"), lambda: _c("response"))
_pair_preset("input-output", lambda: _c("input"), lambda: _c("output"))
_pair_preset("question-answer", lambda: _c("question"), lambda: _c("answer"))
_pair_preset("problem-solution", lambda: _c("problem"), lambda: _c("solution"))
_pair_preset("problem-options", lambda: F.concat_ws("\n", _c("Problem"), _c("options")), lambda: _c("Rationale"))
_pair_preset("message-pair", lambda: _c("message_1"), lambda: _c("message_2"))


@preset("sharegpt")
def sharegpt(df: DataFrame) -> DataFrame:
    kept, skipped = from_sharegpt(_c("conversations"))
    return df.select(_c("id").cast("string").alias("id"), kept.alias("conversations"), skipped.alias("skipped"))


@preset("blended")
def blended(df: DataFrame) -> DataFrame:
    kept, skipped = from_sharegpt(_c("conversations"))
    return df.select(_c("id").cast("string").alias("id"), kept.alias("conversations"), skipped.alias("skipped"), "source")


@preset("pictured")
def pictured(df: DataFrame) -> DataFrame:
    """As ``sharegpt``, but only rows with a picture placeholder."""
    return sharegpt(df).where(F.exists("conversations", lambda m: F.contains(m.content, F.lit(X.IMAGE))))


@preset("chat")
def chat(df: DataFrame) -> DataFrame:
    return df.select(_c("id").cast("string").alias("id"), from_chat(_c("conversations")).alias("conversations"), F.lit(0).alias("skipped"))


@preset("first-user-generated")
def first_user_generated(df: DataFrame) -> DataFrame:
    first = F.element_at(F.filter("conversation", lambda m: m.role == "user"), 1).content
    return df.select(_c("id").cast("string").alias("id"), exchange(first, _c("generated_message")).alias("conversations"), F.lit(0).alias("skipped"))


@preset("science-choice")
def science_choice(df: DataFrame) -> DataFrame:
    options = shuffled(F.array("correct_answer", "distractor1", "distractor2", "distractor3"), _c("question"), 42)
    place = F.array_position(options, _c("correct_answer")).cast("int")
    letter = F.substring(F.lit("abcd"), place, F.lit(1))
    answer = F.concat(_c("support"), F.lit("\nanswer: "), letter, F.lit(") "), _c("correct_answer"))
    listed = F.array_join(F.transform(options, lambda o, i: F.concat(F.substring(F.lit("abcd"), i + 1, F.lit(1)), F.lit(") "), o)), "\n")
    question = F.concat(_c("question"), F.lit("\n"), listed)
    return df.select(X.stable_id(_c("question"), _c("correct_answer")).alias("id"), exchange(question, answer).alias("conversations"), F.lit(0).alias("skipped"))


def add_index(df: DataFrame, *order: str) -> DataFrame:
    """``id`` as the position of the row in the order of a unique key, counted from 0.

    Ranks within ranges and adds the ranges' offsets, so that no single task sorts the whole table."""
    key = F.struct(*order)
    ranged = df.withColumn("_key", key).repartitionByRange("_key").withColumn("_part", F.spark_partition_id())
    within = ranged.withColumn("_rn", F.row_number().over(Window.partitionBy("_part").orderBy("_key")))
    sizes = ranged.groupBy("_part").agg(F.count("*").alias("_n"))
    starts = sizes.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_start"))
    return within.join(F.broadcast(starts), "_part").withColumn("id", F.col("_start") + F.col("_rn") - 1).drop("_key", "_part", "_rn", "_start")


def paired_turns(messages: Column) -> Column:
    """(user_pos, question, answer) of each assistant turn whose previous non-system turn is a user turn, in order,
    without leaving the row."""
    start = F.expr("named_struct('user', cast(null as int), 'at', 0, 'out', cast(array() as array<struct<user_pos:int,pos:int>>))")

    def step(s: Column, m: Column) -> Column:
        passed = F.coalesce(m.role == "system", F.lit(True))
        hit = (m.role == "assistant") & s.user.isNotNull()
        return F.struct(
            F.when(passed, s.user).when(m.role == "user", s.at).alias("user"), (s.at + 1).cast("int").alias("at"),
            F.when(F.coalesce(hit, F.lit(False)), F.array_append(s.out, F.struct(s.user.alias("user_pos"), s.at.alias("pos")))).otherwise(s.out).alias("out"),
        )

    found = F.aggregate(messages, start, step).out
    return F.transform(found, lambda p: F.struct(p.user_pos.alias("user_pos"), F.get(messages, p.user_pos).content.alias("question"), F.get(messages, p.pos).content.alias("answer")))


def turn_pairs(conversations: DataFrame) -> DataFrame:
    """(id, pair, user_pos, question, answer) of ``paired_turns``; no shuffle."""
    p = conversations.select("id", F.posexplode(paired_turns(F.col("conversations"))).alias("pair", "p"))
    return p.select("id", "pair", "p.user_pos", "p.question", "p.answer")


def pair_counts(messages: Column) -> Column:
    """(pairs, unanswered, orphans) of one conversation, system turns aside, without leaving the row."""
    turns = F.filter(messages, lambda m: m.role != "system")
    start = F.struct(F.lit(False).alias("open"), F.lit(0).alias("pairs"), F.lit(0).alias("unanswered"), F.lit(0).alias("orphans"))

    def step(s: Column, m: Column) -> Column:
        user, reply = m.role == "user", m.role == "assistant"
        return F.struct(
            F.when(user, True).when(reply, False).otherwise(s.open).alias("open"), (s.pairs + (reply & s.open).cast("int")).alias("pairs"),
            (s.unanswered + (user & s.open).cast("int")).alias("unanswered"), (s.orphans + (reply & ~s.open).cast("int")).alias("orphans"),
        )

    end = F.aggregate(turns, start, step)
    return F.struct(end.pairs.alias("pairs"), (end.unanswered + end.open.cast("int")).alias("unanswered"), end.orphans.alias("orphans"))


def single_pair_records(conversations: DataFrame) -> DataFrame:
    """One record per pair that doesn't repeat its prompt: id ``<id>-<k>``, k counting kept records, with exactly one
    leading picture placeholder if the question has any. Pairs are kept and numbered in the row; no shuffle."""
    kept = F.filter(paired_turns(F.col("conversations")), lambda p: ~X.repeats_prompt(p.question, p.answer))
    pairs = conversations.select("id", F.posexplode(kept).alias("k", "p")).select("id", "k", "p.question", "p.answer")
    bare = F.trim(F.replace(F.col("question"), F.lit(X.IMAGE), F.lit("")))
    asked = F.when(F.contains(F.col("question"), F.lit(X.IMAGE)), F.concat(F.lit(X.IMAGE + "\n"), bare)).otherwise(F.col("question"))
    return pairs.select(F.concat_ws("-", "id", "k").alias("id"), exchange(asked, F.col("answer")).alias("conversations"))


def generation_events(conversations: DataFrame) -> DataFrame:
    """One row per assistant turn: its history without the reasoning of earlier assistant turns, the turn intact. Turns
    are numbered in the row; no shuffle."""
    turns = conversations.select("id", "conversations", F.posexplode("conversations").alias("pos", "m")).where("m.role = 'assistant'")
    k = F.size(F.filter(F.slice("conversations", F.lit(1), F.col("pos")), lambda m: m.role == "assistant"))
    bare = F.transform(F.col("conversations"), lambda m, i: F.when((m.role == "assistant") & (i < F.col("pos")), m.withField("reasoning_content", F.lit(None).cast("string"))).otherwise(m))
    return turns.select(F.concat(F.col("id"), F.lit("#turn"), k.cast("string")).alias("event_id"), F.col("id").alias("source_id"), k.cast("int").alias("assistant_turn_index"), F.col("pos").cast("int").alias("msg_pos"), F.slice(bare, F.lit(1), F.col("pos") + 1).alias("conversations"))


def render(messages: Column, *, bos: str = "", user: str = "<|user|>\n", assistant: str = "<|assistant|>\n", system: str = "<|system|>\n", end: str = "<|end|>\n") -> Column:
    """A conversation as one prompt text; null contents count as ''."""
    head = lambda m: F.when(m.role == "user", user).when(m.role == "assistant", assistant).otherwise(system)
    tail = lambda m: F.when(m.role == "assistant", end).otherwise("\n")
    return F.concat(F.lit(bos), F.array_join(F.transform(messages, lambda m: F.concat(head(m), F.coalesce(m.content, F.lit("")), tail(m))), ""))


def truncate_turns(messages: Column) -> Column:
    """Messages from the first user turn on, up to the first turn that its predecessor doesn't allow: tool results
    follow assistant or tool turns, assistant turns follow user or tool turns, user turns follow assistant turns."""
    start = F.array_position(F.transform(messages, lambda m: F.coalesce(m.role, F.lit(""))), "user").cast("int")
    kept = F.when(start > 0, F.slice(messages, start, F.size(messages))).otherwise(F.slice(messages, 1, 0))
    roles = F.transform(kept, lambda m: F.coalesce(m.role, F.lit("")))
    bad = F.filter(
        F.transform(
            kept,
            lambda m, i: F.when(
                (i > 0)
                & ~F.coalesce(
                    ((m.role == "tool") & F.get(roles, i - 1).isin("assistant", "tool")) | ((m.role == "assistant") & F.get(roles, i - 1).isin("user", "tool")) | ((m.role == "user") & (F.get(roles, i - 1) == "assistant")),
                    F.lit(False),
                ),
                i,
            ),
        ),
        lambda i: i.isNotNull(),
    )
    return F.when(F.size(bad) > 0, F.slice(kept, F.lit(1), F.element_at(bad, 1))).otherwise(kept)


def channel_messages(text: Column) -> Column:
    """(channel, content) of a text with channel marks, in order; one ``text`` message if it has none."""
    pattern = r"(?s)<\|channel\|>(\w+)<\|message\|>(.*?)(?=<\|(?:end|return|call|start|channel)\|>|\z)"
    channels, contents = F.regexp_extract_all(text, F.lit(pattern), F.lit(1)), F.regexp_extract_all(text, F.lit(pattern), F.lit(2))
    found = F.zip_with(channels, contents, lambda c, t: F.struct(c.alias("channel"), t.alias("content")))
    return F.when(F.size(found) > 0, found).otherwise(F.array(F.struct(F.lit("text").alias("channel"), text.alias("content"))))


def sanitized_calls(calls: Column) -> Column:
    """Tool calls reduced to id, type and function, with arguments that are JSON objects; others become ``{}``."""
    return F.transform(
        F.filter(calls, lambda c: c.isNotNull()),
        lambda c: F.struct(
            c.id.alias("id"), F.coalesce(c.type, F.lit("function")).alias("type"), c.function.getField("name").alias("name"),
            F.when(F.coalesce(F.try_parse_json(c.function.arguments).isNotNull() & F.ltrim(c.function.arguments).startswith("{"), F.lit(False)), F.trim(c.function.arguments)).otherwise("{}").alias("arguments"),
        ),
    )


def common_root(df: DataFrame, path: str) -> DataFrame:
    """(root): the longest common folder of all paths, from the least and the greatest path alone."""
    ends = df.where(F.col(path).isNotNull()).agg(F.min(path).alias("a"), F.max(path).alias("b"))
    pa, pb = F.slice(F.split("a", "/"), F.lit(1), F.size(F.split("a", "/")) - 1), F.slice(F.split("b", "/"), F.lit(1), F.size(F.split("b", "/")) - 1)
    n = F.least(F.size(pa), F.size(pb))
    same = F.aggregate(F.sequence(F.lit(0), n), F.struct(F.lit(0).alias("k"), F.lit(True).alias("on")), lambda s, i: F.struct((s.k + (s.on & (i < n) & F.coalesce(F.get(pa, i) == F.get(pb, i), F.lit(False))).cast("int")).alias("k"), (s.on & F.coalesce(F.get(pa, i) == F.get(pb, i), F.lit(False))).alias("on"))).k
    return ends.select(F.array_join(F.slice(pa, F.lit(1), same), "/").alias("root"))


def rebased(path: Column, old: str, new: str) -> Column:
    """A path below ``old`` moved below ``new``; null if it isn't below ``old``."""
    return F.when(path.startswith(old.rstrip("/") + "/"), F.concat(F.lit(new.rstrip("/")), F.substring(path, len(old.rstrip("/")) + 1, 1 << 30)))


# --- named sources -----------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Source:
    """How a public instruction set is read: its projection, columns to rename, configurations to concatenate, and
    whether rows are numbered (in the order of a key) because they have no id."""

    projection: str
    rename: dict[str, str] = field(default_factory=dict)
    configs: tuple[str, ...] = ()
    numbered: bool = False


#: Names of public instruction sets and of their configurations. Fixed values.
SOURCES = {
    "ultrachat": Source("chat", {"prompt_id": "id", "messages": "conversations"}), "sharegpt": Source("sharegpt"), "eaglechat": Source("identity"), "perfectblend": Source("blended", numbered=True),
    "perfectblend-llama3.1-8b-instruct": Source("identity", numbered=True), "perfectblend-llama3.3-70b-instruct": Source("identity", numbered=True), "perfectblend-llama4-scout-instruct": Source("identity", numbered=True), "perfectblend-llama4-maverick-instruct": Source("identity", numbered=True),
    "magpie-qwen2.5-pro-1m-v0.1": Source("sharegpt", {"uuid": "id"}), "opc": Source("instruction-output", configs=("largescale_diverse_instruct", "filtered_infinity_instruct", "realuser_instruct")), "gsm8k": Source("question-answer", configs=("main",)),
    "hendrycks_math": Source("problem-solution", configs=("algebra", "counting_and_probability", "geometry", "intermediate_algebra", "number_theory", "prealgebra", "precalculus")), "math_qa": Source("problem-options"), "codealpaca-20k": Source("instruction-output"), "opencodeinstruct": Source("input-output"),
    "magicoder-evol-instruct": Source("instruction-response"), "sciq": Source("science-choice"), "camel": Source("message-pair", configs=("biology", "chemistry", "physics")), "nebius-llama31-8b-infinity-instruct": Source("first-user-generated", numbered=True),
    "sharegpt4v": Source("pictured", configs=("ShareGPT4V",)), "sharegpt4v-pt": Source("pictured", configs=("ShareGPT4V-PT",)),
}


@preset("identity")
def identity(df: DataFrame) -> DataFrame:
    return df.withColumn("skipped", F.lit(0))


def project_source(name: str, parts: list[DataFrame], order: tuple[str, ...] = ()) -> DataFrame:
    """The rows of a named source, its configurations one after the other, as conversation rows. ``order``: a unique
    key for sources whose rows are numbered. Unknown names fail and say what there is."""
    if name not in SOURCES:
        raise KeyError(f"unknown source {name!r}; known: {sorted(SOURCES)}")
    s = SOURCES[name]
    df = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    df = df.withColumnsRenamed(s.rename)
    return PRESETS[s.projection](add_index(df, *order) if s.numbered else df)


def parse_source_specs(specs: list[str]) -> list[tuple[str, int | None]]:
    """(handle, count) of ``name``, ``name=all`` and ``name=<count>``; null counts take every row. Malformed specs fail."""
    out: list[tuple[str, int | None]] = []
    for spec in specs:
        name, mark, count = (x.strip() for x in spec.partition("="))
        if not name:
            raise ValueError(f"{spec!r} names no source")
        if mark and count.lower() != "all":
            if not re.fullmatch(r"[-+]?\d+", count):
                raise ValueError(f"{spec!r}: the count must be an integer or 'all'")
            if int(count) <= 0:
                raise ValueError(f"{spec!r}: the count must be greater than zero")
            out.append((name, int(count)))
        else:
            out.append((name, None))
    return out


def resolved_handles(handles: DataFrame, sources: DataFrame) -> DataFrame:
    """(handle, source, error): the one source whose folded name holds each folded handle; an error where none or several
    do. Both sides are names, not rows."""
    names = sources.select("source").where("source IS NOT NULL").distinct()
    hit = handles.select("handle").distinct().join(F.broadcast(names), F.contains(X.fold_handle(F.col("source")), X.fold_handle(F.col("handle"))), "left")
    g = hit.groupBy("handle").agg(F.count("source").alias("n"), F.min("source").alias("source"))
    return g.select("handle", F.when(F.col("n") == 1, F.col("source")).alias("source"), F.when(F.col("n") == 0, "matches none").when(F.col("n") > 1, F.concat(F.lit("ambiguous: matches "), F.col("n").cast("string"))).alias("error"))


# --- channels and histories --------------------------------------------------------------------------------------------

#: The system block of a channel prompt that has none. A fixed value.
CHANNEL_SYSTEM = "You are ChatGPT, a large language model trained by OpenAI.\nKnowledge cutoff: 2024-06\nCurrent date: 2025-06-28\n\nReasoning: {level}\n\n# Valid channels: analysis, commentary, final. Channel must be included for every message."


def render_channels(messages: Column, level: str = "low") -> Column:
    """Messages of roles system, assistant_reasoning_effort, user, assistant_analysis, assistant_commentary and
    assistant_final as one prompt with channels. A system message or an effort begins the prompt anew; without one
    first, the default system block with ``level`` stands there. Other roles fail."""
    head, tail = CHANNEL_SYSTEM.split("{level}")
    block = lambda effort: F.concat(F.lit("<|start|>system<|message|>" + head), effort, F.lit(tail + "<|end|>"))
    part = lambda start, content: F.concat(F.lit(start + "<|message|>"), content, F.lit("<|end|>"))

    def step(s: Column, m: Column) -> Column:
        text = F.coalesce(m.content, F.lit(""))
        return (
            F.when(m.role == "system", part("<|start|>system", text)).when(m.role == "assistant_reasoning_effort", block(F.lower(text))).when(m.role == "user", F.concat(s, part("<|start|>user", text)))
            .when(m.role.isin("assistant_analysis", "assistant_commentary", "assistant_final"), F.concat(s, F.lit("<|start|>assistant<|channel|>"), F.substring_index(m.role, "_", -1), F.lit("<|message|>"), text, F.lit("<|end|>")))
            .otherwise(F.raise_error(F.concat(F.lit("unknown role: "), F.coalesce(m.role, F.lit("null")))))
        )

    return F.aggregate(messages, block(F.lit(level)), step)


def without_reasoning(messages: Column) -> Column:
    """Messages as a chat payload: assistant messages without their reasoning."""
    return F.transform(messages, lambda m: F.when(m.role == "assistant", m.withField("reasoning_content", F.lit(None).cast("string"))).otherwise(m))
