"""Prompt building and parsing: templates, formatters, rewriting rules, multiple-choice and interleaved prompts."""

from __future__ import annotations

import os
import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrymill.functions import text as X
from quarrymill.operators.projections import render


@dataclass(frozen=True)
class Template:
    """How a chat is laid out: what stands before each role's content and after an answer."""

    user: str = "<|user|>\n"
    assistant: str = "<|assistant|>\n"
    system: str = "<|system|>\n"
    end: str = "<|end|>\n"
    bos: str = ""

    def text(self, messages: Column) -> Column:
        return render(messages, bos=self.bos, user=self.user, assistant=self.assistant, system=self.system, end=self.end)


    def example(self, messages: list[tuple[str, str]]) -> str:
        """The layout of a few (role, content) messages, made on the driver."""
        heads = {"user": self.user, "assistant": self.assistant}
        return self.bos + "".join(heads.get(r, self.system) + c + (self.end if r == "assistant" else "\n") for r, c in messages)

    def control_texts(self, probe: str = "\u0001probe\u0001") -> tuple[str, str]:
        """(header, end): what stands between a question and an answer, and behind an answer, read off two layouts."""
        asked, full = self.example([("user", "x")]), self.example([("user", "x"), ("assistant", probe)])
        before, _, behind = full.partition(probe)
        header = before[len(os.path.commonprefix([asked, before])) :]
        if not header:
            raise ValueError("the template has no assistant header")
        return header, behind

    def assistant_pattern(self, kind: str = "general") -> str:
        """A pattern whose first group is what an answer is trained on. ``kind``: ``general``, ``thinking`` (an empty
        reasoning block isn't trained), ``rounds`` and ``channel`` (an answer ends where the next turn begins)."""
        header, end = self.control_texts()
        stop = {"rounds": r"\[Round \d+\] USER:", "channel": r"<\|start\|>user<\|message\|>"}.get(kind, re.escape(end.strip()))
        return re.escape(header) + (r"(?:<think>\s*</think>)?" if kind == "thinking" else "") + (rf"([\s\S]*?)(?={stop}|$)" if kind == "channel" else rf"([\s\S]*?(?:{stop}|$))")


TEMPLATES: dict[str, Template] = {"plain": Template(), "turns": Template("USER: ", "ASSISTANT: ", "", "</s>\n")}


def register_template(name: str, template: Template, *, override: bool = False) -> None:
    if name in TEMPLATES and not override:
        raise KeyError(f"template {name!r} is there; pass override to replace it")
    TEMPLATES[name] = template


def template(name: str) -> Template:
    if name not in TEMPLATES:
        raise KeyError(f"unknown template {name!r}; known: {sorted(TEMPLATES)}")
    return TEMPLATES[name]


def to_first_user(messages: Column, change: Callable[[Column], Column]) -> Column:
    """Messages with the first user message's content changed."""
    at = F.array_position(F.transform(messages, lambda m: F.coalesce(m.role, F.lit(""))), "user") - 1
    return F.transform(messages, lambda m, i: F.when(i == at, m.withField("content", change(m.content))).otherwise(m))


def with_reasoning_request(messages: Column, suffix: str) -> Column:
    """A request appended to the first user message, once."""
    return to_first_user(messages, lambda c: X.append_once(c, suffix))


def without_terse_requests(messages: Column, phrases: list[str]) -> Column:
    """(conversations, removed): fixed short-answer requests taken out of the first user message."""
    first = F.element_at(F.filter(messages, lambda m: m.role == "user"), 1).content
    removed = F.when(F.exists(messages, lambda m: m.role == "user"), X.removed_phrases(first, phrases))
    changed = to_first_user(messages, lambda c: X.strip_phrases(c, phrases))
    return F.struct(F.when(F.size(removed) > 0, changed).otherwise(messages).alias("conversations"), removed.alias("removed"))


def choice_prompt(question: Column, options: Column, tail: str = "Answer with the letter of the option.") -> Column:
    listed = F.array_join(F.transform(options, lambda o, i: F.concat(F.substring(F.lit("ABCDEFGHIJ"), i + 1, F.lit(1)), F.lit(". "), o)), "\n")
    return F.concat(question, F.lit("\n"), listed, F.lit("\n" + tail))


def few_shot(question: Column, shots: list[tuple[str, str]]) -> Column:
    head = "".join(f"Question: {q}\nAnswer: {a}\n\n" for q, a in shots)
    return F.concat(F.lit(head + "Question: "), question, F.lit("\nAnswer:"))


def parsed_choice(text: Column) -> Column:
    """(question, options, tail) of a question with 2 to 5 lettered options in order; null if it isn't one."""
    lines = F.filter(F.split(F.replace(text, F.lit(X.IMAGE), F.lit("")), "\n"), lambda x: ~X.is_blank(x))
    is_option = lambda x: x.rlike(r"^\s*\(?[A-E][.)]\s+\S")
    kinds = F.transform(lines, lambda x: F.when(is_option(x), 1).otherwise(0))
    first = F.array_position(kinds, 1).cast("int")
    n = F.aggregate(kinds, F.lit(0), lambda s, k: s + k)
    options = F.slice(lines, F.greatest(first, F.lit(1)), n)
    in_order = F.array_join(F.transform(options, lambda o: F.regexp_extract(o, r"([A-E])", 1)), "") == F.substring(F.lit("ABCDE"), F.lit(1), n)
    ok = (first > 1) & n.between(2, 5) & in_order & F.forall(options, is_option)
    return F.when(
        ok,
        F.struct(
            F.trim(F.array_join(F.slice(lines, F.lit(1), first - 1), "\n")).alias("question"), F.transform(options, lambda o: F.trim(F.regexp_replace(o, r"^\s*\(?[A-E][.)]\s+", ""))).alias("options"),
            F.array_join(F.slice(lines, first + n, F.size(lines)), "\n").alias("tail"),
        ),
    )


def video_record(subset: Column, stem: Column, k: Column, frames: Column, prompt: Column, answer: Column) -> Column:
    """(id, conversations, image) of a clip: all frames' placeholders before the text."""
    asked = F.concat(F.repeat(F.lit(X.IMAGE), F.size(frames)), F.lit("\n"), prompt)
    return F.struct(
        F.concat(subset, F.lit("#"), stem, F.lit("-"), k.cast("string")).alias("id"),
        F.array(F.struct(F.lit("user").alias("role"), asked.alias("content")), F.struct(F.lit("assistant").alias("role"), answer.alias("content"))).alias("conversations"), frames.alias("image"),
    )


def interleaved_parts(text: Column, images: Column) -> Column:
    """(type, value) parts of a text with ``<image k>`` places, in order; places without a picture are left out."""
    pieces = F.split(text, r"<image \d+>", -1)
    places = F.regexp_extract_all(text, F.lit(r"<image (\d+)>"), F.lit(1))
    return F.filter(
        F.flatten(F.transform(pieces, lambda p, i: F.array(
            F.struct(F.lit("text").alias("type"), p.alias("value")), F.struct(F.lit("image").alias("type"), F.get(images, F.coalesce(F.get(places, i).cast("int") - 1, F.lit(-1))).alias("value"))))),
        lambda s: (s.type == "image") & s.value.isNotNull() | (s.type == "text") & (F.trim(s.value) != ""),
    )


def prompt_turns(df: DataFrame, key: str, prefix: str = "question_") -> DataFrame:
    """(key, turn, prompt) of columns ``question_1``, ``question_2``, ...: turns in numeric order, nulls left out."""
    columns = sorted((c for c in df.columns if c.startswith(prefix) and c[len(prefix) :].isdigit()), key=lambda c: int(c[len(prefix) :]))
    parts = F.array(*[F.struct(F.lit(int(c[len(prefix) :])).alias("turn"), F.col(c).cast("string").alias("prompt")) for c in columns])
    return df.select(key, F.explode(parts).alias("p")).select(key, "p.turn", "p.prompt").where("prompt IS NOT NULL")


def run_settings(name: Column) -> Column:
    """(window, frames) in a run's name: ``_win<n>`` or ``_winfull``, ``_f<n>``; window is null for full or none."""
    return F.struct(F.nullif(F.regexp_extract(name, r"_win(\d+)", 1), F.lit("")).cast("int").alias("window"), F.nullif(F.regexp_extract(name, r"_f(\d+)", 1), F.lit("")).cast("int").alias("frames"))


def picture_tokens(width: Column, height: Column, patch: int = 32) -> Column:
    """Estimated tokens of a picture: patches by side, half to even, at least 1 each."""
    side = lambda x: F.greatest(F.lit(1), F.rint(x / F.lit(float(patch))).cast("int"))
    return side(width) * side(height)


def offline_sample(tokens: Column, mask: Column, longest: int) -> Column:
    """(tokens, mask) cut to ``longest``, the last place never trained."""
    t, m = F.slice(tokens, 1, longest), F.slice(mask, 1, longest)
    return F.struct(t.alias("tokens"), F.transform(m, lambda x, i: F.when(i == F.size(m) - 1, 0).otherwise(x)).alias("mask"))
