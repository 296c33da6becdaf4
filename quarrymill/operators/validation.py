"""Validators and filters of conversation rows.

Every validator is one expression that gives the first error (null: valid), so that routing, counting and filtering
are plain DataFrame operations. Null structs are errors of their position; null arrays count as empty; texts are
tested whole; columns other than the named ones are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrymill.functions import text as X


def conversation_error(messages: Column, style: str = "validation") -> Column:
    """The first error of a conversation: user and assistant messages with content that alternate from a user message
    on, after leading system messages. ``style``: ``validation`` or ``regeneration`` wording."""
    regen = style == "regeneration"

    def at(i: Column, before: str, after: str) -> Column:
        return F.concat(F.lit(before), i.cast("string"), F.lit(after))

    start = F.struct(F.lit(0).cast("int").alias("i"), F.lit("user").alias("want"), F.lit(False).alias("begun"), F.lit(None).cast("string").alias("error"))

    def step(s: Column, m: Column) -> Column:
        role, i = m.getField("role"), s.i
        said = F.coalesce(role, F.lit("None"))
        unsupported = F.concat(F.lit("Invalid message role: "), said) if regen else F.concat(F.lit("message "), i.cast("string"), F.lit(" has unsupported role "), F.when(role.isNull(), "None").otherwise(F.concat(F.lit("'"), said, F.lit("'"))))
        order = (
            F.when(~s.begun & (role == "assistant"), "Data starts with an assistant message").otherwise(F.concat(at(i, "Invalid conversation role order at position ", ": expected "), s.want, F.lit(", got "), said))
            if regen
            else F.concat(at(i, "message ", " expected role '"), s.want, F.lit("', got '"), said, F.lit("'"))
        )
        skip = (role == "system") & ~s.begun
        error = (
            F.when(m.isNull(), at(i, "Invalid message at position ", ": expected object") if regen else at(i, "message ", " must be an object"))
            .when(X.is_blank(m.getField("content")), at(i, "Invalid message content at position ", ": expected non-empty string") if regen else at(i, "message ", " content must be a non-empty string"))
            .when(F.coalesce(skip, F.lit(False)), None)
            .when(~F.coalesce(role.isin("user", "assistant"), F.lit(False)), unsupported)
            .when(role != s.want, order)
        )
        moved = ~F.coalesce(skip, F.lit(False))
        return F.struct(
            (i + 1).cast("int").alias("i"),
            F.when(moved, F.when(role == "user", "assistant").otherwise("user")).otherwise(s.want).alias("want"),
            (s.begun | moved).alias("begun"),
            F.coalesce(s.error, error).alias("error"),
        )

    end = F.aggregate(messages, start, step)
    none = F.lit("Data does not contain a user message" if regen else "conversation has no user message")
    empty = F.lit("Missing or empty conversations list" if regen else "conversations must be a non-empty list")
    return F.when(F.coalesce(F.size(messages), F.lit(0)) <= 0, empty).otherwise(F.coalesce(end.error, F.when(~end.begun, none)))


def _first_message(messages: Column, test, before: str, after: str) -> Column:
    """``before<position>after`` of the first assistant message for which ``test`` holds."""
    hits = F.filter(F.transform(messages, lambda m, i: F.when((m.role == "assistant") & test(m), i)), lambda i: i.isNotNull())
    return F.when(F.size(hits) > 0, F.concat(F.lit(before), F.element_at(hits, 1).cast("string"), F.lit(after)))


def row_error(*, reasoning: str = "any", strict_markers: bool = False) -> Column:
    """The first error of a generated row (id, status, conversations). ``reasoning``: ``any``, ``forbidden`` or
    ``required``; ``strict_markers``: no marks of hidden reasoning in content or reasoning."""
    m = F.col("conversations")
    chain = [
        F.when(X.is_blank(F.col("id")), "id must be a non-empty string"),
        F.when(F.coalesce(F.col("status") != "success", F.lit(True)), "status must be 'success'"),
        conversation_error(m),
    ]
    if reasoning == "forbidden":
        chain.append(_first_message(m, lambda x: ~X.is_blank(x.reasoning_content), "assistant message ", " has non-empty reasoning_content"))
    if reasoning == "required":
        chain.append(_first_message(m, lambda x: X.is_blank(x.reasoning_content), "assistant message ", " has empty reasoning_content"))
    if strict_markers:
        chain.append(_first_message(m, lambda x: X.has_think_marker(x.content), "assistant message ", " contains a thinking marker"))
        chain.append(_first_message(m, lambda x: X.has_think_marker(x.reasoning_content), "assistant message ", " reasoning_content contains a thinking marker"))
    chain.append(F.when(~F.exists(m, lambda x: x.role == "assistant"), "conversation has no assistant message"))
    chain.append(F.when(F.element_at(m, -1).role != "assistant", "conversation must end with an assistant message"))
    return F.coalesce(*chain)


def assistant_count(messages: Column) -> Column:
    return F.coalesce(F.size(F.filter(messages, lambda m: m.role == "assistant")), F.lit(0))


def validation_summary(df: DataFrame, **policy) -> DataFrame:
    """One row: rows, valid rows, assistant messages of valid rows, and rows beyond the first of an id."""
    checked = df.select("id", assistant_count(F.col("conversations")).alias("n"), row_error(**policy).alias("error"))
    by_id = checked.groupBy("id").agg(F.count("*").alias("rows"), F.sum(F.col("error").isNull().cast("long")).alias("valid"), F.sum(F.when(F.col("error").isNull(), F.col("n")).otherwise(0)).alias("assistants"))
    return by_id.agg(
        F.coalesce(F.sum("rows"), F.lit(0)).alias("n_rows"), F.coalesce(F.sum("valid"), F.lit(0)).alias("n_valid"),
        F.coalesce(F.sum("assistants"), F.lit(0)).alias("assistant_messages"), F.coalesce(F.sum(F.col("rows") - 1), F.lit(0)).alias("duplicate_rows"),
    )


def sanitized(messages: Column) -> Column:
    """(kept, reason): blank system and assistant turns dropped; the reason why a row can't be used, or null."""
    kept = F.filter(messages, lambda m: m.isNull() | ~F.coalesce(m.role.isin("system", "assistant"), F.lit(False)) | ~X.is_blank(m.content))
    no_text = F.exists(messages, lambda m: (m.role == "user") & m.content.isNull())
    only_image = F.exists(messages, lambda m: (m.role == "user") & m.content.isNotNull() & X.is_blank(F.replace(m.content, F.lit(X.IMAGE), F.lit(""))))
    first = F.filter(
        F.transform(messages, lambda m: F.when((m.role == "user") & m.content.isNull(), "User turn has no text").when((m.role == "user") & X.is_blank(F.replace(m.content, F.lit(X.IMAGE), F.lit(""))), "User turn is empty apart from the image placeholder")),
        lambda e: e.isNotNull(),
    )
    return F.struct(kept.alias("kept"), F.when(no_text | only_image, F.element_at(first, 1)).alias("reason"))


def last_content(messages: Column, role: str) -> Column:
    """The content of the last message of a role; '' if it is null; null if there is none."""
    of = F.filter(messages, lambda m: m.role == role)
    return F.when(F.size(of) > 0, F.coalesce(F.element_at(of, -1).content, F.lit("")))


def answer_reject_reason(messages: Column, is_video: Column, finish_reason: Column) -> Column:
    """Why a regenerated row's last answer is rejected; null if it is kept."""
    answer, question = last_content(messages, "assistant"), last_content(messages, "user")
    return (
        F.when(answer.isNull(), "no assistant turn").when(X.is_blank(answer), "empty answer").when(X.has_think_marker(answer), "thinking marker in answer")
        .when(X.repeats_prompt(question, answer), "answer repeats the prompt").when(X.is_degenerate(answer), "degenerate repetition")
        .when(is_video & (finish_reason == "length"), "video answer cut at --max-tokens")
    )


def placeholder_error(messages: Column, images: Column) -> Column:
    """Whether the picture placeholders of user turns are as many as the pictures; null if they are."""
    n = F.aggregate(F.filter(messages, lambda m: m.role == "user"), F.lit(0), lambda s, m: s + F.coalesce(X.count_of(m.content, X.IMAGE), F.lit(0)))
    have = F.coalesce(F.size(images), F.lit(0))
    return F.when(n != F.greatest(have, F.lit(0)), F.concat(F.lit("expected "), have.cast("string"), F.lit(" placeholders, got "), n.cast("string")))


def require(df: DataFrame, error: Column, what: str = "row") -> DataFrame:
    """``df``, failing at the first row with an error."""
    return df.where(F.when(error.isNotNull(), F.raise_error(F.concat(F.lit(f"invalid {what}: "), error))).otherwise(F.lit(True)).cast("boolean"))


def route(df: DataFrame, error: Column) -> DataFrame:
    """Adds ``sink``: success, error, skipped or rejected, from ``status`` and a row error."""
    status = F.lower(F.col("status"))
    return df.withColumn("sink", F.when(status == "error", "error").when(status == "skipped", "skipped").when(error.isNotNull(), "rejected").otherwise("success"))
