"""Queries of corpus preparation: projections, validation, expansion, sampling, identifiers; with DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrymill.functions import text as X
from quarrymill.operators import projections as P
from quarrymill.operators import sampling as O
from quarrymill.operators import validation as V
from quarrymill.session import table

CONV = "tool_use_conversation"


def once(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    """Each conversation once (redelivered rows are equal but for their arrival), for small columns: what is asked for
    is shuffled by id. What is made of messages comes from ``per_conversation``."""
    return table(spark, d, CONV).where("id IS NOT NULL").select("id", *columns).dropDuplicates(["id"])


def conversations(spark: SparkSession, d: str) -> DataFrame:
    """Every delivery of every conversation."""
    return table(spark, d, CONV).where("id IS NOT NULL")


def per_conversation(spark: SparkSession, d: str, **made) -> DataFrame:
    """``id`` and what is made of each conversation, once: computed in the row first, so that only results are shuffled
    to drop redelivered rows, never messages."""
    return conversations(spark, d).select("id", *[c.alias(n) for n, c in made.items()]).dropDuplicates(["id"])


def _heard() -> Column:
    """Messages of users, assistants and systems that aren't blank: the input of pair and event operators."""
    return F.filter("conversations", lambda m: m.role.isin("user", "assistant", "system") & ~X.is_blank(m.content))


def _spoken(spark: SparkSession, d: str) -> DataFrame:
    return conversations(spark, d).select("id", _heard().alias("conversations")).where(F.size("conversations") > 0)


def _messages() -> Column:
    return F.filter("conversations", lambda m: m.isNotNull())


def conversation_errors(spark: SparkSession, d: str) -> DataFrame:
    return per_conversation(spark, d, error=V.conversation_error(F.col("conversations")))


def conversation_errors_regen(spark: SparkSession, d: str) -> DataFrame:
    return per_conversation(spark, d, error=V.conversation_error(F.col("conversations"), "regeneration")).groupBy("error").agg(F.count("*").alias("n"))


def row_validation(spark: SparkSession, d: str) -> DataFrame:
    return V.validation_summary(table(spark, d, CONV).select("id", "status", "conversations"))


def row_validation_policies(spark: SparkSession, d: str) -> DataFrame:
    policies = ("any", "forbidden", "required")
    valid = F.array(*[F.struct(F.lit(r).alias("policy"), V.row_error(reasoning=r, strict_markers=True).isNull().alias("valid")) for r in policies])
    return per_conversation(spark, d, v=valid).select(F.explode("v").alias("v")).groupBy("v.policy").agg(F.sum(F.col("v.valid").cast("long")).alias("n_valid"), F.count("*").alias("n_rows"))


def sanitize(spark: SparkSession, d: str) -> DataFrame:
    s = V.sanitized(F.col("conversations"))
    return per_conversation(spark, d, n_kept=F.coalesce(F.size(s.kept), F.lit(0)), reason=s.reason)


def answer_filter(spark: SparkSession, d: str) -> DataFrame:
    video = F.coalesce(F.ltrim("image").startswith("["), F.lit(False))
    return per_conversation(spark, d, filtered_reason=V.answer_reject_reason(F.col("conversations"), video, F.when(F.col("status") == "success", "length")))


def reject_histogram(spark: SparkSession, d: str) -> DataFrame:
    return answer_filter(spark, d).where("filtered_reason IS NOT NULL").groupBy("filtered_reason").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "filtered_reason")


def status_routes(spark: SparkSession, d: str) -> DataFrame:
    c = per_conversation(spark, d, status=F.col("status"), error=V.conversation_error(F.col("conversations")))
    return V.route(c, F.col("error")).groupBy("sink").agg(F.count("*").alias("n"))


def sharegpt_projection(spark: SparkSession, d: str) -> DataFrame:
    """A chat export made of the conversations (tool and system turns under their own names), projected back."""
    turns = F.transform(_messages(), lambda m: F.struct(F.when(m.role == "user", "human").when(m.role == "assistant", "gpt").otherwise(m.role).alias("from"), m.content.alias("value")))
    p = P.sharegpt(conversations(spark, d).select("id", turns.alias("conversations")))
    return p.select("id", F.size("conversations").alias("n_messages"), F.col("skipped").cast("int").alias("skipped"), F.get("conversations", 0).role.alias("first_role")).dropDuplicates(["id"])


def instruction_projection(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "eval_items").select(F.col("text").alias("instruction"), F.col("label").alias("output"))
    p = P.PRESETS["instruction-output"](e)
    return p.select("id", F.element_at("conversations", 1).content.alias("question"), F.element_at("conversations", 2).content.alias("answer"))


def turn_pairs(spark: SparkSession, d: str) -> DataFrame:
    p = P.turn_pairs(_spoken(spark, d))
    return p.select("id", "pair", F.col("user_pos").cast("int").alias("user_pos"), F.length("question").alias("question_chars"), F.length("answer").alias("answer_chars")).dropDuplicates(["id", "pair"])


def pair_accounting(spark: SparkSession, d: str) -> DataFrame:
    p = _spoken(spark, d).select("id", P.pair_counts(F.col("conversations")).alias("p"))
    return p.select("id", "p.pairs", "p.unanswered", "p.orphans").dropDuplicates(["id"])


def single_pair_records(spark: SparkSession, d: str) -> DataFrame:
    r = P.single_pair_records(_spoken(spark, d))
    return r.select("id", F.md5(F.element_at("conversations", 1).content).alias("question_md5"), F.md5(F.element_at("conversations", 2).content).alias("answer_md5")).dropDuplicates(["id"])


def generation_events(spark: SparkSession, d: str) -> DataFrame:
    e = P.generation_events(conversations(spark, d).select("id", "conversations"))
    reasons = F.size(F.filter("conversations", lambda m: (m.role == "assistant") & ~X.is_blank(m.reasoning_content)))
    return e.select("event_id", "source_id", "assistant_turn_index", F.size("conversations").alias("n_messages"), reasons.alias("n_reasoned")).dropDuplicates(["event_id"])


def event_summary(spark: SparkSession, d: str) -> DataFrame:
    per = per_conversation(spark, d, n=V.assistant_count(F.col("conversations")))
    return per.agg(
        F.count("*").alias("input_rows"), F.coalesce(F.sum("n"), F.lit(0)).alias("output_rows"), F.sum((F.col("n") == 0).cast("long")).alias("skipped_rows"),
        F.sum((F.col("n") > 1).cast("long")).alias("multi_turn_rows"), F.round(F.try_divide(F.sum("n"), F.sum((F.col("n") > 0).cast("long"))), 6).alias("average_turns"),
    )


def truncated_turns(spark: SparkSession, d: str) -> DataFrame:
    return per_conversation(spark, d, n_kept=F.coalesce(F.size(P.truncate_turns(_messages())), F.lit(0)))


def rendered_prompts(spark: SparkSession, d: str) -> DataFrame:
    return per_conversation(spark, d, prompt_md5=F.md5(P.render(_messages())))


def think_markers(spark: SparkSession, d: str) -> DataFrame:
    doc = table(spark, d, "documents")
    return doc.agg(F.sum(X.has_think_marker(F.col("text")).cast("long")).alias("marked"), F.count("*").alias("n_docs"))


def degenerate_documents(spark: SparkSession, d: str) -> DataFrame:
    doc = table(spark, d, "documents")
    return doc.select("doc_id", F.round(X.distinct_chunk_share(F.col("text")), 6).alias("distinct_share"), X.is_degenerate(F.col("text")).alias("degenerate"))


def prompt_leaks(spark: SparkSession, d: str) -> DataFrame:
    p = P.turn_pairs(_spoken(spark, d))
    return p.where(X.repeats_prompt(F.col("question"), F.col("answer"))).select("id", "pair").dropDuplicates(["id", "pair"])


def image_placeholders(spark: SparkSession, d: str) -> DataFrame:
    c = once(spark, d, "image")
    trimmed = F.trim("image")
    images = F.when(F.col("image").isNull(), F.array().cast("array<string>")).when(trimmed.startswith("["), F.from_json("image", "array<string>")).otherwise(F.array(F.trim(F.lit('"') , trimmed)))
    kind = F.when(F.col("image").isNull(), "text").when(trimmed.startswith("["), "video").otherwise("image")
    return c.select(kind.alias("image_kind"), F.size(images).alias("n")).groupBy("image_kind").agg(F.count("*").alias("n_rows"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_images"))


def source_counts(spark: SparkSession, d: str) -> DataFrame:
    s = once(spark, d).select(X.fold_handle(X.id_config(F.col("id"))).alias("source")).groupBy("source").agg(F.count("*").alias("n"))
    total = s.agg(F.sum("n").alias("all_n"))
    return s.crossJoin(F.broadcast(total)).select("source", "n", F.round(F.col("n") / F.col("all_n"), 9).alias("share"))


def source_sample(spark: SparkSession, d: str) -> DataFrame:
    """At most 25 conversations of each source, drawn by ticket."""
    s = once(spark, d).withColumn("source", X.fold_handle(X.id_config(F.col("id"))))
    return O.capped_per_group(s, "source", "id", 25, 42).select("source", "id")


def train_test_split(spark: SparkSession, d: str) -> DataFrame:
    return O.train_test(table(spark, d, "documents").select("doc_id"), "doc_id").select("doc_id", "split")


def seeded_order(spark: SparkSession, d: str) -> DataFrame:
    doc = table(spark, d, "documents").select("doc_id").withColumn("t", O.ticket(7, "doc_id"))
    return O.global_rank(doc, [F.col("t"), F.col("doc_id")], "position").select("doc_id", "position")


def proportional_quota(spark: SparkSession, d: str) -> DataFrame:
    sizes = table(spark, d, "documents").where("source IS NOT NULL").groupBy(X.fold_handle(F.col("source")).alias("source")).agg(F.count("*").alias("n"))
    return O.largest_remainder(sizes, "source", "n", 333)


def stratified_subset(spark: SparkSession, d: str) -> DataFrame:
    doc = table(spark, d, "documents").where("lang IS NOT NULL").select("doc_id", F.lower(F.trim("lang")).alias("stratum"))
    return O.stratified(doc, "stratum", "doc_id", 120)


def round_robin_items(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "eval_items").select("item_id", "benchmark")
    return O.round_robin(e, "benchmark", "item_id", 60).select("turn", "benchmark", "item_id")


def whole_group_subset(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "eval_items").select("benchmark", F.coalesce("category", F.lit("none")).alias("category"), "item_id")
    return O.whole_groups(e, "benchmark", "category", 150)


def weighted_configs(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "documents").where("source IS NOT NULL").groupBy(X.fold_handle(F.col("source")).alias("source")).agg(F.count("*").alias("n"))
    return O.weighted_draw(n, "source", "n", 200.0, 5).select("source", "n", "arrival")


def sampler_partitions(spark: SparkSession, d: str) -> DataFrame:
    s = O.shards_of_epochs(table(spark, d, "eval_items").select("item_id"), "item_id", epochs=2, ranks=8, seed=3)
    return s.select("epoch", "position", "rank", "padded", "item_id")


def fixed_batches(spark: SparkSession, d: str) -> DataFrame:
    e = O.global_rank(table(spark, d, "eval_items").select("item_id"), [F.col("item_id")], "position")
    return O.batches(e, "position", 16, skip=2).groupBy("batch").agg(F.min("item_id").alias("first_item"), F.count("*").alias("n"))


def frame_positions(spark: SparkSession, d: str) -> DataFrame:
    c = per_conversation(spark, d, total=F.coalesce(F.size("conversations"), F.lit(0))).where("total > 0")
    return c.select("id", F.array_join(O.even_positions(F.col("total"), 5).cast("array<string>"), ",").alias("positions"))


def style_draw(spark: SparkSession, d: str) -> DataFrame:
    doc = table(spark, d, "documents").select("doc_id", O.categorical(O.unit(9, "doc_id"), {"low": 4, "medium": 4, "high": 2}).alias("style"))
    return doc.groupBy("style").agg(F.count("*").alias("n"), F.sum("doc_id").alias("sum_ids"))


def family_join(spark: SparkSession, d: str) -> DataFrame:
    """Benchmarks joined to a small dimension of task families; unknown ones are kept without family."""
    dim = spark.createDataFrame([("stepcheck", "reasoning"), ("maskmath", "maths"), ("longread", "reading"), ("draftqa", "knowledge"), ("tooltrace", "tools")], "benchmark string, family string")
    e = table(spark, d, "eval_items")
    return e.join(F.broadcast(dim), "benchmark", "left").groupBy("benchmark", "family").agg(F.count("*").alias("n"))


def corpus_profile(spark: SparkSession, d: str) -> DataFrame:
    """Rows, share, index-quantiles of answer length and share of tiny answers by source of the conversations."""
    from quarrymill.operators import metrics as M

    p = P.turn_pairs(_spoken(spark, d)).select("id", "pair", X.fold_handle(X.id_config(F.col("id"))).alias("source"), F.length("answer").alias("chars")).dropDuplicates(["id", "pair"])
    return M.length_profile(p, "source", "chars")


def context_lengths(spark: SparkSession, d: str) -> DataFrame:
    n = per_conversation(spark, d, n=F.aggregate("conversations", F.lit(0), lambda s, m: s + F.coalesce(X.word_count(m.content), F.lit(0)))).where("n IS NOT NULL")
    return n.agg(F.min("n").alias("least"), F.max("n").alias("most"), F.round(F.avg("n"), 6).alias("average"))


def stable_ids(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "eval_items").select("item_id", X.stable_id(F.col("text"), F.col("label")).alias("stable_id"))


def call_sanitizer(spark: SparkSession, d: str) -> DataFrame:
    calls = F.flatten(F.transform("conversations", lambda m: F.coalesce(P.sanitized_calls(m.tool_calls), P.sanitized_calls(F.slice(m.tool_calls, 1, 0)), F.expr("cast(array() as array<struct<id:string,type:string,name:string,arguments:string>>)"))))
    s = per_conversation(spark, d, n_calls=F.coalesce(F.size(calls), F.lit(0)), n_empty=F.coalesce(F.size(F.filter(calls, lambda x: x.arguments == "{}")), F.lit(0)))
    return s.agg(F.sum("n_calls").alias("n_calls"), F.sum("n_empty").alias("n_empty"))


QUERIES = {
    f.__name__: f
    for f in (
        conversation_errors, conversation_errors_regen, row_validation, row_validation_policies, sanitize, answer_filter, reject_histogram, status_routes, sharegpt_projection, instruction_projection,
        turn_pairs, pair_accounting, single_pair_records, generation_events, event_summary, truncated_turns, rendered_prompts, think_markers, degenerate_documents, prompt_leaks, image_placeholders, source_counts,
        source_sample, train_test_split, seeded_order, proportional_quota, stratified_subset, round_robin_items, whole_group_subset, weighted_configs, sampler_partitions, fixed_batches, frame_positions, style_draw,
        family_join, corpus_profile, context_lengths, stable_ids, call_sanitizer,
    )
}

# --- SQL -------------------------------------------------------------------------------------------------------------

_C = "c AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY ingested_at) AS rn FROM tool_use_conversation WHERE id IS NOT NULL) WHERE rn = 1)"
_M = f"{_C},\nm AS (SELECT id, unnest(conversations) AS m, generate_subscripts(conversations, 1) - 1 AS i FROM c WHERE len(conversations) > 0)"
_BLANK = "NOT coalesce(regexp_matches({0}, '\\S'), false)"
_SQ = "trim(regexp_replace({0}, '\\s+', ' ', 'g'))"


def _errors(style: str) -> str:
    regen = style == "regeneration"
    return f"""
{_M},
s AS (SELECT id, i, m, m.role AS role, count(*) FILTER (WHERE m IS NOT NULL AND coalesce(m.role, '') <> 'system') OVER (PARTITION BY id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS k FROM m),
e AS (SELECT id, i, CASE
 WHEN m IS NULL THEN {"'Invalid message at position ' || i || ': expected object'" if regen else "'message ' || i || ' must be an object'"}
 WHEN {_BLANK.format('m.content')} THEN {"'Invalid message content at position ' || i || ': expected non-empty string'" if regen else "'message ' || i || ' content must be a non-empty string'"}
 WHEN role = 'system' AND k = 0 THEN NULL
 WHEN role IS NULL OR role NOT IN ('user', 'assistant') THEN {"'Invalid message role: ' || coalesce(role, 'None')" if regen else "'message ' || i || ' has unsupported role ' || coalesce('''' || role || '''', 'None')"}
 WHEN role <> CASE k % 2 WHEN 0 THEN 'user' ELSE 'assistant' END THEN {"CASE WHEN k = 0 THEN 'Data starts with an assistant message' ELSE 'Invalid conversation role order at position ' || i || ': expected ' || CASE k % 2 WHEN 0 THEN 'user' ELSE 'assistant' END || ', got ' || role END" if regen else "'message ' || i || ' expected role ''' || CASE k % 2 WHEN 0 THEN 'user' ELSE 'assistant' END || ''', got ''' || role || ''''"}
 END AS error, CASE WHEN m IS NOT NULL AND role IN ('user', 'assistant') THEN 1 ELSE 0 END AS spoke FROM s),
f AS (SELECT id, arg_min(error, i) FILTER (WHERE error IS NOT NULL) AS first_error, max(spoke) AS spoke FROM e GROUP BY id),
err AS (SELECT c.id, c.conversations, c.status, c.source, CASE WHEN f.id IS NULL THEN {"'Missing or empty conversations list'" if regen else "'conversations must be a non-empty list'"} WHEN first_error IS NOT NULL THEN first_error
 WHEN spoke = 0 THEN {"'Data does not contain a user message'" if regen else "'conversation has no user message'"} END AS error FROM c LEFT JOIN f USING (id))
"""


_SPOKEN = f"""{_M},
sp AS (SELECT id, row_number() OVER (PARTITION BY id ORDER BY i) - 1 AS pos, m.role AS role, m.content AS content FROM m WHERE m.role IN ('user', 'assistant', 'system') AND NOT ({_BLANK.format('m.content')})),
ns AS (SELECT *, lag(role) OVER w AS before, lag(content) OVER w AS asked, lag(pos) OVER w AS user_pos FROM sp WHERE role <> 'system' WINDOW w AS (PARTITION BY id ORDER BY pos)),
pr AS (SELECT id, row_number() OVER (PARTITION BY id ORDER BY pos) - 1 AS pair, user_pos, asked AS question, content AS answer FROM ns WHERE role = 'assistant' AND before = 'user')"""

_LEAK = f"""(length({_SQ.format('q')}) >= 40 AND length({_SQ.format('a')}) >= 40 AND least(length({_SQ.format('q')}), length({_SQ.format('a')})) >= 0.8 * greatest(length({_SQ.format('q')}), length({_SQ.format('a')}))
 AND (contains({_SQ.format('q')}, {_SQ.format('a')}) OR contains({_SQ.format('a')}, {_SQ.format('q')})))"""


def _leak(q: str, a: str) -> str:
    return _LEAK.replace("(q,", f"({q},").replace("(a,", f"({a},")


_FOLD = "regexp_replace(lower({0}), '[^\\p{{L}}\\p{{N}}]', '', 'g')"
_CFG = "CASE WHEN contains(id, '#') THEN regexp_extract(id, '(?s)^(.*)#[^#]*$', 1) ELSE id END"

_ANSWER = f"""{_M},
la AS (SELECT id, arg_max(coalesce(m.content, ''), i) FILTER (WHERE m.role = 'assistant') AS a, arg_max(coalesce(m.content, ''), i) FILTER (WHERE m.role = 'user') AS q FROM m GROUP BY id),
af AS (SELECT c.id, CASE WHEN a IS NULL THEN 'no assistant turn' WHEN {_BLANK.format('a')} THEN 'empty answer'
 WHEN contains(lower(a), '<think>') OR contains(lower(a), '</think>') OR contains(lower(a), '<|channel>') OR contains(lower(a), '<channel|>') OR contains(lower(a), '<|think|>') THEN 'thinking marker in answer'
 WHEN {_leak("coalesce(q, '')", 'a')} THEN 'answer repeats the prompt'
 WHEN length(a) >= 4000 AND len(list_distinct(list_transform(range(0, CAST(ceil(length(a) / 64.0) AS BIGINT)), lambda k: substring(a, k * 64 + 1, 64)))) / ceil(length(a) / 64.0) < 0.25 THEN 'degenerate repetition'
 WHEN starts_with(ltrim(image), '[') AND status = 'success' THEN 'video answer cut at --max-tokens' END AS filtered_reason FROM c LEFT JOIN la USING (id))"""

_QUOTA = """
a AS (SELECT g, n, least(floor(n * {t}.0::DOUBLE / (SELECT sum(n) FROM s)), n) AS base, n * {t}.0::DOUBLE / (SELECT sum(n) FROM s) - floor(n * {t}.0::DOUBLE / (SELECT sum(n) FROM s)) AS frac FROM s),
b AS (SELECT *, row_number() OVER (ORDER BY CASE WHEN base < n THEN 0 ELSE 1 END, frac DESC, g DESC) AS r, least({t}, (SELECT sum(n) FROM s)) - (SELECT sum(base) FROM a) AS left_over FROM a),
q AS (SELECT g, n, CAST(base + CASE WHEN r <= left_over AND base < n THEN 1 ELSE 0 END AS BIGINT) AS quota FROM b)"""

SQL = {
    "conversation_errors": "WITH " + _errors("validation") + "SELECT id, error FROM err",
    "conversation_errors_regen": "WITH " + _errors("regeneration") + "SELECT error, count(*) AS n FROM err GROUP BY error",
    "row_validation": f"""
WITH {_errors('validation')},
v AS (SELECT id, CASE WHEN {_BLANK.format('id')} OR status IS DISTINCT FROM 'success' OR error IS NOT NULL THEN 0 WHEN list_last(conversations).role <> 'assistant' THEN 0 ELSE 1 END AS valid, len(list_filter(conversations, lambda x: x.role = 'assistant')) AS n FROM err),
k AS (SELECT id, count(*) AS rows FROM tool_use_conversation GROUP BY id)
SELECT CAST(sum(rows) AS BIGINT) AS n_rows, CAST(sum(valid * rows) AS BIGINT) AS n_valid, CAST(sum(CASE WHEN valid = 1 AND n > 0 THEN n * rows ELSE 0 END) AS BIGINT) AS assistant_messages, CAST(sum(rows - 1) AS BIGINT) AS duplicate_rows FROM k LEFT JOIN v USING (id)
""",
    "row_validation_policies": f"""
WITH {_errors('validation')},
v AS (SELECT id, conversations, CASE WHEN {_BLANK.format('id')} OR status IS DISTINCT FROM 'success' OR error IS NOT NULL OR list_last(conversations).role <> 'assistant' THEN 0 ELSE 1 END AS valid,
 len(list_filter(coalesce(conversations, []), lambda x: x.role = 'assistant' AND coalesce(regexp_matches(x.reasoning_content, '\\S'), false))) AS filled, len(list_filter(coalesce(conversations, []), lambda x: x.role = 'assistant')) AS n,
 len(list_filter(coalesce(conversations, []), lambda x: x.role = 'assistant' AND regexp_matches(lower(coalesce(x.content, '') || ' ' || coalesce(x.reasoning_content, '')), '<think>|</think>|<\\|channel>|<channel\\|>|<\\|think\\|>'))) AS marked FROM err)
SELECT policy, CAST(sum(CASE WHEN valid = 1 AND marked = 0 AND (policy = 'any' OR policy = 'forbidden' AND filled = 0 OR policy = 'required' AND filled = n) THEN 1 ELSE 0 END) AS BIGINT) AS n_valid, count(*) AS n_rows
FROM v, (SELECT unnest(['any', 'forbidden', 'required']) AS policy) GROUP BY policy
""",
    "sanitize": f"""
WITH {_M},
b AS (SELECT id, i, CASE WHEN m.role IN ('system', 'assistant') AND {_BLANK.format('m.content')} THEN 0 ELSE 1 END AS kept,
 CASE WHEN m.role = 'user' AND m.content IS NULL THEN 'User turn has no text' WHEN m.role = 'user' AND {_BLANK.format("replace(m.content, '<image>', '')")} THEN 'User turn is empty apart from the image placeholder' END AS reason FROM m),
g AS (SELECT id, sum(kept) AS n, arg_min(reason, i) FILTER (WHERE reason IS NOT NULL) AS reason FROM b GROUP BY id)
SELECT c.id AS id, CAST(coalesce(n, 0) AS INTEGER) AS n_kept, reason FROM c LEFT JOIN g USING (id)
""",
    "answer_filter": f"WITH {_ANSWER} SELECT id, filtered_reason FROM af",
    "reject_histogram": f"WITH {_ANSWER} SELECT filtered_reason, count(*) AS n FROM af WHERE filtered_reason IS NOT NULL GROUP BY filtered_reason",
    "status_routes": "WITH " + _errors("validation") + "SELECT CASE WHEN lower(status) = 'error' THEN 'error' WHEN lower(status) = 'skipped' THEN 'skipped' WHEN error IS NOT NULL THEN 'rejected' ELSE 'success' END AS sink, count(*) AS n FROM err GROUP BY 1",
    "sharegpt_projection": f"""
WITH {_C}, k AS (SELECT id, list_filter(conversations, lambda x: x IS NOT NULL) AS t FROM c),
r AS (SELECT id, t, list_filter(t, lambda x: x.role IN ('user', 'assistant')) AS kept FROM k)
SELECT id, CAST(coalesce(len(kept), -1) AS INTEGER) AS n_messages, CAST(coalesce(len(t) - len(kept), 0) AS INTEGER) AS skipped, kept[1].role AS first_role FROM r
""".replace("coalesce(len(kept), -1)", "len(kept)"),
    "instruction_projection": "SELECT md5(coalesce(text, '') || coalesce(label, '')) AS id, text AS question, label AS answer FROM eval_items",
    "turn_pairs": f"WITH {_SPOKEN} SELECT id, CAST(pair AS INTEGER) AS pair, CAST(user_pos AS INTEGER) AS user_pos, CAST(length(question) AS INTEGER) AS question_chars, CAST(length(answer) AS INTEGER) AS answer_chars FROM pr",
    "pair_accounting": f"""
WITH {_SPOKEN},
x AS (SELECT *, lead(role) OVER (PARTITION BY id ORDER BY pos) AS after FROM ns),
y AS (SELECT id, count(*) FILTER (WHERE role = 'assistant' AND before = 'user') AS pairs, count(*) FILTER (WHERE role = 'user' AND coalesce(after, 'user') = 'user') AS unanswered, count(*) FILTER (WHERE role = 'assistant' AND coalesce(before, 'assistant') = 'assistant') AS orphans FROM x GROUP BY id)
SELECT id, CAST(coalesce(pairs, 0) AS INTEGER) AS pairs, CAST(coalesce(unanswered, 0) AS INTEGER) AS unanswered, CAST(coalesce(orphans, 0) AS INTEGER) AS orphans FROM (SELECT DISTINCT id FROM sp) LEFT JOIN y USING (id)
""",
    "single_pair_records": f"""
WITH {_SPOKEN}, kept AS (SELECT id, pair, question, answer FROM pr WHERE NOT {_leak('question', 'answer')})
SELECT id || '-' || (row_number() OVER (PARTITION BY id ORDER BY pair) - 1) AS id, md5(CASE WHEN contains(question, '<image>') THEN '<image>' || chr(10) || trim(replace(question, '<image>', '')) ELSE question END) AS question_md5, md5(answer) AS answer_md5 FROM kept
""",
    "generation_events": f"""
WITH {_M},
r AS (SELECT id, i, CASE WHEN m.role = 'assistant' THEN 1 ELSE 0 END AS a, CASE WHEN m.role = 'assistant' AND coalesce(regexp_matches(m.reasoning_content, '\\S'), false) THEN 1 ELSE 0 END AS own FROM m),
k AS (SELECT id, i, own, row_number() OVER (PARTITION BY id ORDER BY i) - 1 AS k FROM r WHERE a = 1)
SELECT id || '#turn' || k AS event_id, id AS source_id, CAST(k AS INTEGER) AS assistant_turn_index, CAST(i + 1 AS INTEGER) AS n_messages, own AS n_reasoned FROM k
""",
    "event_summary": f"""
WITH {_C}, n AS (SELECT coalesce(len(list_filter(conversations, lambda x: x.role = 'assistant')), 0) AS n FROM c)
SELECT count(*) AS input_rows, CAST(sum(n) AS BIGINT) AS output_rows, count(*) FILTER (WHERE n = 0) AS skipped_rows, count(*) FILTER (WHERE n > 1) AS multi_turn_rows, round(sum(n) / count(*) FILTER (WHERE n > 0), 6) AS average_turns FROM n
""",
    "truncated_turns": f"""
WITH {_M},
z AS (SELECT id, row_number() OVER (PARTITION BY id ORDER BY i) - 1 AS i, coalesce(m.role, '') AS role FROM m WHERE m IS NOT NULL),
u AS (SELECT id, min(i) FILTER (WHERE role = 'user') AS u, max(i) + 1 AS n FROM z GROUP BY id),
l AS (SELECT z.id, z.i, role, lag(role) OVER (PARTITION BY z.id ORDER BY z.i) AS before, u FROM z JOIN u USING (id) WHERE z.i >= u),
b AS (SELECT id, min(i) AS b FROM l WHERE i > u AND NOT (role = 'tool' AND before IN ('assistant', 'tool') OR role = 'assistant' AND before IN ('user', 'tool') OR role = 'user' AND before = 'assistant') GROUP BY id)
SELECT c.id AS id, CAST(coalesce(coalesce(b, n) - u, 0) AS INTEGER) AS n_kept FROM c LEFT JOIN u USING (id) LEFT JOIN b USING (id)
""",
    "rendered_prompts": f"""
WITH {_C}
SELECT id, md5(array_to_string(list_transform(list_filter(conversations, lambda x: x IS NOT NULL), lambda x: CASE WHEN x.role = 'user' THEN '<|user|>' WHEN x.role = 'assistant' THEN '<|assistant|>' ELSE '<|system|>' END || chr(10) || coalesce(x.content, '') || CASE WHEN x.role = 'assistant' THEN '<|end|>' || chr(10) ELSE chr(10) END), '')) AS prompt_md5 FROM c
""",
    "think_markers": "SELECT CAST(sum(CASE WHEN regexp_matches(lower(coalesce(text, '')), '<think>|</think>|<\\|channel>|<channel\\|>|<\\|think\\|>') THEN 1 ELSE 0 END) AS BIGINT) AS marked, count(*) AS n_docs FROM documents",
    "degenerate_documents": """
WITH x AS (SELECT doc_id, len(list_distinct(list_transform(range(0, CAST(ceil(length(text) / 64.0) AS BIGINT)), lambda k: substring(text, k * 64 + 1, 64)))) / nullif(ceil(length(text) / 64.0), 0) AS s, length(text) >= 4000 AS long FROM documents)
SELECT doc_id, round(s, 6) AS distinct_share, coalesce(long AND s < 0.25, false) AS degenerate FROM x
""",
    "prompt_leaks": f"WITH {_SPOKEN} SELECT id, CAST(pair AS INTEGER) AS pair FROM pr WHERE {_leak('question', 'answer')}",
    "image_placeholders": f"""
WITH {_C}, k AS (SELECT CASE WHEN image IS NULL THEN 'text' WHEN starts_with(trim(image), '[') THEN 'video' ELSE 'image' END AS image_kind, CASE WHEN image IS NULL THEN 0 WHEN starts_with(trim(image), '[') THEN json_array_length(image) ELSE 1 END AS n FROM c)
SELECT image_kind, count(*) AS n_rows, CAST(sum(n) AS BIGINT) AS n_images FROM k GROUP BY image_kind
""",
    "source_counts": f"WITH {_C}, s AS (SELECT {_FOLD.format(_CFG)} AS source, count(*) AS n FROM c GROUP BY 1) SELECT source, n, round(n / (SELECT sum(n) FROM s), 9) AS share FROM s",
    "source_sample": f"WITH {_C}, s AS (SELECT id, {_FOLD.format(_CFG)} AS source FROM c) SELECT source, id FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY md5('42|' || id), id) AS r FROM s) WHERE r <= 25",
    "train_test_split": "SELECT doc_id, CASE WHEN row_number() OVER (ORDER BY md5('42|' || doc_id), doc_id) <= (SELECT ceil(count(*) * 0.05) FROM documents) THEN 'test' ELSE 'train' END AS split FROM documents",
    "seeded_order": "SELECT doc_id, row_number() OVER (ORDER BY md5('7|' || doc_id), doc_id) - 1 AS position FROM documents",
    "proportional_quota": f"WITH s AS (SELECT {_FOLD.format('source')} AS g, count(*) AS n FROM documents WHERE source IS NOT NULL GROUP BY 1), {_QUOTA.format(t=333)} SELECT g AS source, n, quota FROM q",
    "stratified_subset": f"WITH d AS (SELECT doc_id, lower(trim(lang)) AS stratum FROM documents WHERE lang IS NOT NULL), s AS (SELECT stratum AS g, count(*) AS n FROM d GROUP BY 1), {_QUOTA.format(t=120)} SELECT stratum, doc_id FROM (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY doc_id) AS r FROM d) JOIN q ON q.g = stratum WHERE r <= quota",
    "round_robin_items": "SELECT row_number() OVER (ORDER BY r, benchmark) - 1 AS turn, benchmark, item_id FROM (SELECT *, row_number() OVER (PARTITION BY benchmark ORDER BY item_id) AS r FROM eval_items) ORDER BY r, benchmark LIMIT 60",
    "whole_group_subset": """
WITH e AS (SELECT benchmark, coalesce(category, 'none') AS category, item_id FROM eval_items), s AS (SELECT benchmark, category, count(*) AS n, row_number() OVER (PARTITION BY benchmark ORDER BY category) AS k FROM e GROUP BY 1, 2),
u AS (SELECT *, sum(n) OVER (ORDER BY k, benchmark, category ROWS UNBOUNDED PRECEDING) AS upto FROM s)
SELECT benchmark, category, item_id FROM e JOIN u USING (benchmark, category) WHERE upto <= 150
""",
    "sampler_partitions": """
WITH e AS (SELECT epoch, item_id, row_number() OVER (PARTITION BY epoch ORDER BY md5('3|' || epoch || '|' || item_id), item_id) - 1 AS p FROM eval_items, (SELECT unnest([0, 1]) AS epoch)), n AS (SELECT count(*) AS n FROM eval_items),
x AS (SELECT epoch, p AS position, false AS padded, item_id FROM e UNION ALL SELECT epoch, p + n, true, item_id FROM e, n WHERE p < (8 - n % 8) % 8)
SELECT CAST(epoch AS INTEGER) AS epoch, position, CAST(position % 8 AS INTEGER) AS rank, padded, item_id FROM x
""",
    "fixed_batches": "SELECT b AS batch, min(item_id) AS first_item, count(*) AS n FROM (SELECT item_id, CAST(floor((row_number() OVER (ORDER BY item_id) - 1) / 16.0) AS BIGINT) AS b FROM eval_items) WHERE b < (SELECT floor(count(*) / 16.0) FROM eval_items) AND b >= 2 GROUP BY b",
    "frame_positions": f"""
WITH {_C}, n AS (SELECT id, len(conversations) AS n FROM c WHERE len(conversations) > 0)
SELECT id, array_to_string(CASE WHEN n <= 5 THEN range(0, n) ELSE list_transform(range(0, 5), lambda i: CAST(round_even(i * (n - 1) / 4.0, 0) AS BIGINT)) END, ',') AS positions FROM n
""",
    "style_draw": """
WITH u AS (SELECT doc_id, CAST(('0x' || substring(md5('9|' || doc_id), 1, 13)) AS BIGINT)::DOUBLE / 4503599627370496.0 AS u FROM documents)
SELECT CASE WHEN u < 0.4 THEN 'low' WHEN u < 0.8 THEN 'medium' ELSE 'high' END AS style, count(*) AS n, CAST(sum(doc_id) AS BIGINT) AS sum_ids FROM u GROUP BY 1
""",
    "weighted_configs": f"""
WITH s AS (SELECT {_FOLD.format('source')} AS source, count(*) AS n FROM documents WHERE source IS NOT NULL GROUP BY 1),
a AS (SELECT *, round(-ln(CAST(('0x' || substring(md5('5|' || source), 1, 13)) AS BIGINT)::DOUBLE / 4503599627370496.0 + pow(2.0, -53)) / n, 12) AS arrival FROM s),
b AS (SELECT *, coalesce(sum(n) OVER (ORDER BY arrival, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM a)
SELECT source, n, arrival FROM b WHERE before < 200
""",
    "family_join": """
WITH d(benchmark, family) AS (VALUES ('stepcheck', 'reasoning'), ('maskmath', 'maths'), ('longread', 'reading'), ('draftqa', 'knowledge'), ('tooltrace', 'tools'))
SELECT benchmark, family, count(*) AS n FROM eval_items LEFT JOIN d USING (benchmark) GROUP BY benchmark, family
""",
    "corpus_profile": f"""
WITH {_SPOKEN}, p AS (SELECT {_FOLD.format(_CFG)} AS source, length(answer) AS chars FROM pr), g AS (SELECT source, list_sort(list(chars)) AS v, count(*) AS n, count(*) FILTER (WHERE chars <= 3) AS tiny FROM p GROUP BY source)
SELECT source, n AS n_rows, round(n / (SELECT sum(n) FROM g), 6) AS share, CAST(v[least(CAST(floor(n * 0.5) AS BIGINT), n - 1) + 1] AS INTEGER) AS p50, CAST(v[least(CAST(floor(n * 0.9) AS BIGINT), n - 1) + 1] AS INTEGER) AS p90, round(tiny / n, 6) AS tiny_share FROM g
""",
    "context_lengths": f"""
WITH {_C}, n AS (SELECT list_sum(list_transform(conversations, lambda x: coalesce(len(list_filter(regexp_split_to_array(x.content, '\\s+'), lambda w: w <> '')), 0))) AS n, conversations FROM c WHERE conversations IS NOT NULL)
SELECT CAST(min(coalesce(n, 0)) AS INTEGER) AS least, CAST(max(coalesce(n, 0)) AS INTEGER) AS most, round(avg(coalesce(n, 0)), 6) AS average FROM n
""",
    "stable_ids": "SELECT item_id, md5(coalesce(text, '') || coalesce(label, '')) AS stable_id FROM eval_items",
    "call_sanitizer": f"""
WITH {_M}, k AS (SELECT unnest(m.tool_calls) AS call FROM m WHERE len(m.tool_calls) > 0)
SELECT count(*) AS n_calls, count(*) FILTER (WHERE NOT coalesce(json_valid(call."function".arguments) AND starts_with(ltrim(call."function".arguments), '{{'), false) OR trim(call."function".arguments) = '{{}}') AS n_empty FROM k WHERE call IS NOT NULL
""",
}
