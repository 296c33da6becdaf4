"""Queries of named sources, prompt building, rewriting, rendering and token sequences; with DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrymill.functions import answers as A
from quarrymill.functions import text as X
from quarrymill.operators import gates as G
from quarrymill.operators import projections as P
from quarrymill.operators import prompts as R
from quarrymill.operators import scores as S
from quarrymill.operators import tokens as T
from quarrymill.plans.corpus_queries import _C, _M, CONV, once
from quarrymill.session import table

c, lit = F.col, F.lit
TERSE = ["Explain your reasoning in one short sentence before you answer.", "Give your final answer as a single letter on the last line.", "Read the passage carefully and then answer the question that follows it."]
THINK = "Think step by step before you answer."


def _items(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "eval_items")


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def preset_projections(spark: SparkSession, d: str) -> DataFrame:
    """The items in the columns of each public set of questions and answers, projected onto conversations."""
    e = _items(spark, d).withColumn("k", c("item_id") % 3)
    named = lambda q, a, *more: e.select(c("text").alias(q), c("label").alias(a), *more)
    parts = {
        "opc": [named("instruction", "output", "k").where(c("k") == i).drop("k") for i in range(3)], "gsm8k": [named("question", "answer")], "hendrycks_math": [named("problem", "solution")], "math_qa": [named("Problem", "Rationale", c("category").alias("options"))], "codealpaca-20k": [named("instruction", "output")],
        "opencodeinstruct": [named("input", "output", F.when(c("k") == 0, "").otherwise(c("item_id").cast("string")).alias("id"))], "magicoder-evol-instruct": [named("instruction", "response")], "camel": [named("message_1", "message_2")],
        "sciq": [named("question", "correct_answer", lit("one").alias("distractor1"), lit("two").alias("distractor2"), lit("six").alias("distractor3"), c("benchmark").alias("support"))],
        "nebius-llama31-8b-infinity-instruct": [e.select("item_id", F.array(F.struct(lit("system").alias("role"), lit("s").alias("content")), F.struct(lit("user").alias("role"), c("text").alias("content"))).alias("conversation"), c("label").alias("generated_message"))],
    }
    out = [P.project_source(n, p, ("item_id",)).select(lit(n).alias("source"), c("id").cast("string").alias("id"), F.md5(F.get("conversations", 0).content).alias("question_md5"), F.md5(F.get("conversations", 1).content).alias("answer_md5")) for n, p in parts.items()]
    return _union(out)


def chat_sources(spark: SparkSession, d: str) -> DataFrame:
    """The conversations in the shape of each public chat set: rows, messages and skipped messages."""
    o = table(spark, d, CONV).where("id IS NOT NULL").select("id", "source", F.filter("conversations", lambda m: m.isNotNull()).alias("m"))
    turns = F.transform("m", lambda m: F.struct(F.when(m.role == "user", "human").when(m.role == "assistant", "gpt").otherwise(m.role).alias("from"), F.coalesce(m.content, lit("")).alias("value")))
    chat = F.transform(F.filter("m", lambda m: m.role.isin("user", "assistant")), lambda m: F.struct(m.role.alias("role"), m.content.alias("content")))
    shapes = {
        "ultrachat": o.select(c("id").alias("prompt_id"), chat.alias("messages")), "sharegpt": o.select("id", turns.alias("conversations")), "magpie-qwen2.5-pro-1m-v0.1": o.select(c("id").alias("uuid"), turns.alias("conversations")),
        "eaglechat": o.select("id", chat.alias("conversations")), "sharegpt4v": o.select("id", turns.alias("conversations")),
    }
    small = lambda n, df: df.select(lit(n).alias("source"), "id", F.coalesce(F.size("conversations"), lit(0)).alias("n"), "skipped").dropDuplicates(["source", "id"])
    parts = [small(n, P.project_source(n, [s])) for n, s in shapes.items()]
    blend = P.project_source("perfectblend", [once(spark, d, "source", "conversations").select(c("id").alias("key"), "source", F.transform(F.filter("conversations", lambda m: m.isNotNull()), lambda m: F.struct(lit("human").alias("from"), m.role.alias("value"))).alias("conversations"))], ("key",))
    parts.append(small("perfectblend", blend.withColumn("id", c("id").cast("string"))))
    return _union(parts).groupBy("source").agg(F.count("*").alias("n_rows"), F.sum(F.when(c("n") > 0, c("n")).otherwise(0)).alias("n_messages"), F.sum(c("skipped").cast("long")).alias("skipped"))


def blended_rows(spark: SparkSession, d: str) -> DataFrame:
    """Rows of a blend, numbered in the order of a key, with their source as it is."""
    e = _items(spark, d).select("item_id", c("benchmark").alias("source"), F.array(F.struct(lit("human").alias("from"), c("text").alias("value")), F.struct(lit("other").alias("from"), lit("x").alias("value"))).alias("conversations"))
    return P.project_source("perfectblend", [e], ("item_id",)).select(c("id").cast("long").alias("id"), "source", F.size("conversations").alias("n"), c("skipped").cast("int").alias("skipped"))


def dual_turns(spark: SparkSession, d: str) -> DataFrame:
    """Messages in either naming, brought to one."""
    e = _items(spark, d)
    m = F.when(c("item_id") % 2 == 0, F.struct(lit("").alias("role"), lit(None).cast("string").alias("content"), lit("human").alias("from"), c("text").alias("value"))).otherwise(F.struct(lit("user").alias("role"), c("text").alias("content"), lit(None).cast("string").alias("from"), lit(None).cast("string").alias("value")))
    return e.select("item_id", P.normalised(m).alias("m")).select("item_id", "m.role", F.md5("m.content").alias("content_md5"))


def choice_prompts(spark: SparkSession, d: str) -> DataFrame:
    """Items that ask with lettered options, taken apart and put together again; and every item behind an example."""
    e = _items(spark, d).select("item_id", "text", R.parsed_choice(c("text")).alias("p"))
    again = F.when(c("p").isNotNull(), R.choice_prompt(c("p.question"), c("p.options")))
    return e.select("item_id", F.md5("p.question").alias("question_md5"), F.size("p.options").alias("n_options"), c("p.tail").alias("tail"), F.md5(again).alias("prompt_md5"), F.md5(R.few_shot(c("text"), [("1+1?", "2")])).alias("shot_md5"))


def video_records(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, CONV).where("id IS NOT NULL AND ltrim(image) LIKE '[%'").select("id", F.from_json("image", "array<string>").alias("frames"))
    r = o.select(R.video_record(lit("clips"), c("id"), lit(3), c("frames"), lit("What happens?"), lit("A")).alias("r")).select("r.id", F.size("r.image").alias("n_frames"), F.md5(F.get("r.conversations", 0).content).alias("asked_md5"))
    return r.dropDuplicates(["id"])


def channel_prompts(spark: SparkSession, d: str) -> DataFrame:
    """Items rendered with channels, and the channels read back."""
    m = lambda role, content: F.struct(lit(role).alias("role"), content.alias("content"))
    talk = F.when(c("item_id") % 2 == 0, F.array(m("user", c("text")), m("assistant_analysis", F.coalesce("category", lit("none"))), m("assistant_final", c("label")))).otherwise(F.array(m("assistant_reasoning_effort", lit("HIGH")), m("user", c("text")), m("assistant_final", c("label"))))
    e = _items(spark, d).select("item_id", P.render_channels(talk).alias("t"))
    found = P.channel_messages(c("t"))
    return e.select("item_id", F.md5("t").alias("prompt_md5"), F.array_join(F.transform(found, lambda x: x.channel), ",").alias("channels"), F.element_at(found, -1).content.alias("last"))


def message_parts(spark: SparkSession, d: str) -> DataFrame:
    """Texts with picture places taken apart: in order of the places, and by number."""
    t = F.concat(lit("see <image> and "), F.coalesce("category", lit("")), lit("<image>"))
    numbered = F.concat(lit("first <image 2> then <image 1>"), F.when(c("item_id") % 2 == 0, lit(" again <image 2> and <image 7>.")).otherwise(lit("")))
    kinds = lambda parts, value: F.array_join(F.transform(parts, lambda p: F.concat(p.type, lit("="), p[value])), "|")
    return _items(spark, d).select("item_id", kinds(X.image_parts(t), "text").alias("parts"), kinds(R.interleaved_parts(numbered, F.array("benchmark", "label")), "value").alias("numbered"))


def chat_payloads(spark: SparkSession, d: str) -> DataFrame:
    """Histories as they are sent: messages stay, reasoning of assistants goes."""
    m = F.filter("conversations", lambda x: x.isNotNull())
    n = lambda a: F.size(F.filter(a, lambda x: ~X.is_blank(x.reasoning_content)))
    o = table(spark, d, CONV).where("id IS NOT NULL AND conversations IS NOT NULL").select("id", F.size(P.without_reasoning(m)).alias("n_messages"), n(m).alias("n_before"), n(P.without_reasoning(m)).alias("n_after"))
    return o.dropDuplicates(["id"])


def _sequences(spark: SparkSession, d: str) -> DataFrame:
    s = S.once(table(spark, d, "score_sidecar").select("id", "n_loss", "n_tokens", F.size("kl").alias("n"))).where("n > 0")
    return s.withColumn("tokens", F.transform(F.sequence(lit(1), c("n")), lambda i: (i * i) % 97)).withColumn("mask", F.transform(F.sequence(lit(1), c("n")), lambda i: (i % 3 == 0).cast("int")))


def offline_samples(spark: SparkSession, d: str) -> DataFrame:
    """Sequences cut to a length with the last place untrained, and padded with a sentinel."""
    o = R.offline_sample(c("tokens"), c("mask"), 20)
    s = _sequences(spark, d).select("id", o.alias("o"))
    return s.select("id", F.size("o.tokens").alias("n"), T.trainable(c("o.mask")).alias("trained"), F.element_at("o.mask", -1).alias("last"), F.array_join(T.padded(c("o.mask"), lit(22), -1).cast("array<string>"), "").alias("padded"))


def sequence_shards(spark: SparkSession, d: str) -> DataFrame:
    s = _sequences(spark, d).select("id", F.explode(T.sequence_shards(c("tokens"), 4, 2)).alias("s"))
    return s.select("id", c("s.shard").cast("int").alias("shard"), c("s.start").cast("int").alias("start"), F.array_join(c("s.values").cast("array<string>"), ",").alias("v"))


def prompt_columns(spark: SparkSession, d: str) -> DataFrame:
    e = _items(spark, d).select("item_id", c("label").alias("question_10"), c("category").alias("question_2"), c("benchmark").alias("question_1"), lit("x").alias("question_x"))
    t = R.prompt_turns(e, "item_id")
    return t.select("item_id", c("turn").cast("int").alias("turn"), "prompt")


def rebased_paths(spark: SparkSession, d: str) -> DataFrame:
    """Paths of documents moved from their common folder to another."""
    doc = table(spark, d, "documents").where("path IS NOT NULL")
    root = P.common_root(doc, "path")
    j = doc.select("doc_id", "path").crossJoin(F.broadcast(root))
    moved = F.when(c("path").startswith(F.concat("root", lit("/"))), F.concat(lit("/data"), F.substring(c("path"), F.length("root") + 1, F.length("path"))))
    return j.select("doc_id", "root", moved.alias("moved"), P.rebased(c("path"), "corpus/", "/elsewhere/").alias("fixed"))


def rewritten_prompts(spark: SparkSession, d: str) -> DataFrame:
    """First user messages with a request for reasoning appended once, with stock requests taken out, and with a request
    for a short answer where the question is for a fact."""
    m = F.array(F.struct(lit("system").alias("role"), lit("s").alias("content")), F.struct(lit("user").alias("role"), c("text").alias("content")), F.struct(lit("user").alias("role"), c("label").alias("content")))
    asked = R.with_reasoning_request(R.with_reasoning_request(m, THINK), THINK)
    e = _items(spark, d).select("item_id", "text", asked.alias("a"), R.without_terse_requests(m, TERSE).alias("t"))
    short = F.when(G.wants_short_answer(c("text")) & ~G.structured_prompt(c("text"), ["Suppose", "passage"]), X.append_once(c("text"), "Answer briefly.")).otherwise(c("text"))
    return e.select("item_id", F.md5(F.get("a", 1).content).alias("reasoned_md5"), F.md5(F.get("a", 2).content).alias("other_md5"), F.md5(F.get("t.conversations", 1).content).alias("stripped_md5"), F.size("t.removed").alias("n_removed"), F.md5(short).alias("short_md5"))


def span_masks(spark: SparkSession, d: str) -> DataFrame:
    """Trained tokens of rendered conversations by the spans of their answers: all answers, and the last one only."""
    t = R.template("plain")
    m = F.filter("conversations", lambda x: x.role.isin("user", "assistant"))
    o = table(spark, d, CONV).where("id IS NOT NULL").select("id", t.text(m).alias("t")).where("t <> ''")
    n = lambda mask: F.aggregate(mask, lit(0), lambda s, x: s + x)
    masked = o.select("id", T.span_mask(t.assistant_pattern())(c("t")).alias("all_"), T.span_mask(t.assistant_pattern(), last_only=True, ignore=("<|end|>",))(c("t")).alias("last_"))
    return masked.select("id", F.size("all_").alias("n_tokens"), n("all_").alias("n_trained"), n("last_").alias("n_last")).dropDuplicates(["id"])


def template_controls(spark: SparkSession, d: str) -> DataFrame:
    """What the registered templates put before and behind an answer, read off a probe."""
    R.register_template("braces", R.Template("[U] ", "[A] ", "[S] ", " [/A]\n", "<s>"), override=True)
    rows = [(n, *R.template(n).control_texts(), R.template(n).assistant_pattern("channel")) for n in ("plain", "turns", "braces")]
    return spark.createDataFrame(rows, "template STRING, header STRING, ending STRING, pattern STRING")


def header_masks(spark: SparkSession, d: str) -> DataFrame:
    """Places of a header in token sequences, and the tokens from behind each header to the next end token."""
    e = _items(spark, d).select("item_id", T.whitespace_tokens(F.lower("text")).alias("w"))
    header, end = F.array(lit("the"), lit("same")), lit("every")
    return e.select("item_id", F.array_join(T.find_all(c("w"), header).cast("array<string>"), ",").alias("starts"), T.trainable(T.mask_after(c("w"), header, end)).alias("n_masked"))


def common_prefixes(spark: SparkSession, d: str) -> DataFrame:
    e = _items(spark, d).select("item_id", T.whitespace_tokens(c("text")).alias("a"), T.whitespace_tokens(F.replace("text", lit(" that "), lit(" those "))).alias("b"))
    return e.select("item_id", T.common_prefix(c("a"), c("b")).alias("n"))


def run_names(spark: SparkSession, d: str) -> DataFrame:
    """Settings read from made run names; short labels of models; names of configurations; tokens of pictures."""
    r = table(spark, d, "runs").withColumn("name", F.concat("run_id", F.when(c("block_size").isNull(), "_winfull").otherwise(F.concat(lit("_win"), c("block_size").cast("string"))), lit("_f"), F.length("run_id").cast("string")))
    s = R.run_settings(c("name"))
    model = X.model_label(F.concat(lit("maker/"), c("draft_model"), lit("-Instruct-FP8")))
    return r.select("run_id", s.window.alias("window"), s.frames.alias("frames"), model.alias("model"), X.config_base(F.concat("benchmark", lit("-part-03-of-11"))).alias("config"), R.picture_tokens(c("block_size") * 37, c("block_size") * 5).alias("picture_tokens"))


#: First bytes of pictures, as hexadecimal text. Fixed values.
MAGIC = ("FFD8FFE000104A46", "89504E470D0A1A0A0000", "474946383961", "524946460000000057454250", "424D36", "00112233")


def picture_types(spark: SparkSession, d: str) -> DataFrame:
    e = _items(spark, d).select("item_id", F.unhex(F.get(F.array(*map(lit, MAGIC)), (c("item_id") % 6).cast("int"))).alias("b"), F.concat(lit("p."), F.get(F.array(*map(lit, ("JPG", "png", "gif", "webp"))), (c("item_id") % 4).cast("int"))).alias("path"))
    return e.select("item_id", X.image_suffix(c("b")).alias("suffix"), X.data_url(c("b"), c("path")).alias("url"))


def score_alignment(spark: SparkSession, d: str) -> DataFrame:
    """Whether scores belong to a sequence: by counts, then by the stored fingerprint."""
    s = _sequences(spark, d).withColumn("fp", F.when(c("n") % 3 == 0, T.fingerprint(c("tokens"))).when(c("n") % 3 == 1, "other"))
    status = T.alignment_status(c("tokens"), c("mask"), c("n") + (c("n") % 5 == 0).cast("int"), F.when(c("n") % 7 != 0, F.floor(c("n") / 3)), c("fp"))
    return s.select("id", T.fingerprint(c("tokens")).alias("fingerprint"), status.alias("status"))


def source_specs(spark: SparkSession, d: str) -> DataFrame:
    """Specifications of sources, parsed or refused."""
    rows = []
    for spec in ("maskwiki=5", "glossary", " kerneltalk = all", "=3", "labminutes=x", "labminutes=0", "a=-1", "b=+2"):
        try:
            rows.append((spec, *P.parse_source_specs([spec])[0], None))
        except ValueError as e:
            rows.append((spec, None, None, str(e).partition(" ")[2] if "names" in str(e) else str(e).rpartition(": ")[2]))
    return spark.createDataFrame(rows, "spec STRING, handle STRING, n INT, error STRING")


def resolved_handles(spark: SparkSession, d: str) -> DataFrame:
    """Short handles resolved against the sources that occur in the targets."""
    h = spark.createDataFrame([("Mask-Wiki",), ("kernel",), ("e",), ("nowhere",), ("RUN book",)], "handle STRING")
    return P.resolved_handles(h, table(spark, d, "mix_targets"))


def source_draw(spark: SparkSession, d: str) -> DataFrame:
    """Rows of the sources that specifications name, each capped at its own draw."""
    from quarrymill.operators.sampling import capped_per_group

    specs = P.parse_source_specs(["maskwiki=5", "glossary", "kernel=12"])
    docs = table(spark, d, "documents").select("doc_id", X.fold_handle(c("source")).alias("source"))
    h = spark.createDataFrame(specs, "handle STRING, n INT")
    r = P.resolved_handles(h, table(spark, d, "mix_targets")).join(h, "handle").select("source", c("n").cast("long").alias("n"))
    return capped_per_group(docs, "source", "doc_id", None, 17, r).select("source", "doc_id")


def tensor_columns(spark: SparkSession, d: str) -> DataFrame:
    """Columns of metadata tables that hold no plain data (none may), and those of a table of pictures."""
    rows = [(n, p) for n in ("sample_refs", "acked", "request_stats", "score_sidecar") for p in G.tensor_columns(table(spark, d, n).schema)]
    rows += [("pictures", p) for p in G.tensor_columns(spark.sql("SELECT array(named_struct('b', X'00')) AS a, map('k', X'01') AS m, 1 AS n").schema)]
    return spark.createDataFrame(rows, "name STRING, path STRING")


QUERIES = {
    f.__name__: f
    for f in (
        preset_projections, chat_sources, blended_rows, dual_turns, choice_prompts, video_records, channel_prompts, message_parts, chat_payloads, offline_samples, sequence_shards, prompt_columns, rebased_paths, rewritten_prompts, span_masks, template_controls,
        header_masks, common_prefixes, run_names, picture_types, score_alignment, source_specs, resolved_handles, source_draw, tensor_columns,
    )
}

# --- SQL -------------------------------------------------------------------------------------------------------------

_SEQ = "s AS (SELECT id, len(any_value(kl)) AS n FROM (SELECT * FROM score_sidecar WHERE id IS NOT NULL) GROUP BY id HAVING len(any_value(kl)) > 0), q AS (SELECT id, n, list_transform(range(1, n + 1), lambda i: (i * i) % 97) AS tokens, list_transform(range(1, n + 1), lambda i: (i % 3 = 0)::INT) AS mask FROM s)"
_WORDS = "list_filter(regexp_split_to_array({0}, '\\s+'), lambda x: x <> '')"
_PAIR = "SELECT '{0}' AS source, md5(coalesce(text, '') || coalesce(label, '')) AS id, text AS q, label AS a FROM eval_items"
_TEMPLATE = "md5('<|start|>system<|message|>'"
_HEAD, _TAIL = (x.replace("\n", "' || chr(10) || '").replace("||  ||", "||") for x in P.CHANNEL_SYSTEM.split("{level}"))


def _terse(t: str) -> str:
    out = t
    for p in sorted(TERSE, key=len, reverse=True):
        out = f"replace({out}, '{p}', ' ')"
    return f"trim(regexp_replace(array_to_string(list_transform(string_split({out}, chr(10)), lambda x: rtrim(x)), chr(10)), '\\n{{3,}}', chr(10) || chr(10), 'g'), ' ')"


SQL = {
    "preset_projections": " UNION ALL ".join([
        "SELECT source, id, md5(q) AS question_md5, md5(a) AS answer_md5 FROM (" + " UNION ALL ".join(_PAIR.format(n) for n in ("opc", "gsm8k", "hendrycks_math", "codealpaca-20k", "magicoder-evol-instruct", "camel")) + ")",
        "SELECT 'math_qa', md5(coalesce(q, '') || coalesce(label, '')), md5(q), md5(label) FROM (SELECT text || coalesce(chr(10) || category, '') AS q, label FROM eval_items)",
        "SELECT 'opencodeinstruct', CASE WHEN item_id % 3 = 0 THEN md5(coalesce(text, '') || coalesce(label, '')) ELSE CAST(item_id AS VARCHAR) END, md5(text), md5(label) FROM eval_items",
        "SELECT 'nebius-llama31-8b-infinity-instruct', CAST(row_number() OVER (ORDER BY item_id) - 1 AS VARCHAR), md5(text), md5(label) FROM eval_items",
        """SELECT 'sciq', md5(coalesce(text, '') || coalesce(label, '')), md5(text || chr(10) || 'a) ' || o[1] || chr(10) || 'b) ' || o[2] || chr(10) || 'c) ' || o[3] || chr(10) || 'd) ' || o[4]), md5(benchmark || chr(10) || 'answer: ' || substring('abcd', list_position(o, label), 1) || ') ' || label)
 FROM (SELECT *, list_transform(list_sort(list_transform([label, 'one', 'two', 'six'], lambda x: {'k': md5('42|' || text || '|' || x), 'o': x})), lambda s: s.o) AS o FROM eval_items)""",
    ]),
    "chat_sources": f"""
WITH {_C}, m AS (SELECT id, source, list_filter(conversations, lambda x: x IS NOT NULL) AS m FROM c),
k AS (SELECT id, len(m) AS n, len(list_filter(m, lambda x: x.role IN ('user', 'assistant'))) AS s, len(list_filter(m, lambda x: x.role IN ('user', 'assistant') AND contains(coalesce(x.content, ''), '<image>'))) AS pics FROM m)
SELECT source, count(*) AS n_rows, CAST(coalesce(sum(n), 0) AS BIGINT) AS n_messages, CAST(sum(coalesce(skipped, 0)) AS BIGINT) AS skipped FROM (
 SELECT 'ultrachat' AS source, s AS n, 0 AS skipped FROM k UNION ALL SELECT 'eaglechat', s, 0 FROM k UNION ALL SELECT 'sharegpt', s, n - s FROM k UNION ALL SELECT 'magpie-qwen2.5-pro-1m-v0.1', s, n - s FROM k UNION ALL SELECT 'sharegpt4v', s, n - s FROM k WHERE pics > 0 UNION ALL SELECT 'perfectblend', n, 0 FROM k) GROUP BY source
""",
    "blended_rows": "SELECT row_number() OVER (ORDER BY item_id) - 1 AS id, benchmark AS source, 1 AS n, 1 AS skipped FROM eval_items",
    "dual_turns": "SELECT item_id, 'user' AS role, md5(coalesce(nullif(text, ''), '')) AS content_md5 FROM eval_items",
    "choice_prompts": """
WITH l AS (SELECT item_id, text, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '\\S')) AS l FROM eval_items), k AS (SELECT *, list_transform(l, lambda x: regexp_matches(x, '^\\s*\\(?[A-E][.)]\\s+\\S')::INT) AS o FROM l),
f AS (SELECT *, coalesce(list_position(o, 1), 0) AS first, list_sum(o) AS n FROM k), p AS (SELECT *, l[first:first + n - 1] AS opts FROM f),
g AS (SELECT *, first > 1 AND n BETWEEN 2 AND 5 AND list_sum(o[first:first + n - 1]) = n AND array_to_string(list_transform(opts, lambda x: regexp_extract(x, '([A-E])', 1)), '') = substring('ABCDE', 1, CAST(n AS BIGINT)) AS ok FROM p),
h AS (SELECT item_id, text, ok, trim(array_to_string(l[1:first - 1], chr(10))) AS q, list_transform(opts, lambda x: trim(regexp_replace(x, '^\\s*\\(?[A-E][.)]\\s+', ''))) AS opts, array_to_string(l[first + n:], chr(10)) AS tail FROM g)
SELECT item_id, CASE WHEN ok THEN md5(q) END AS question_md5, CASE WHEN ok THEN CAST(len(opts) AS INTEGER) END AS n_options, CASE WHEN ok THEN tail END AS tail,
 CASE WHEN ok THEN md5(q || chr(10) || array_to_string(list_transform(opts, lambda x, i: substring('ABCDEFGHIJ', i, 1) || '. ' || x), chr(10)) || chr(10) || 'Answer with the letter of the option.') END AS prompt_md5, md5('Question: 1+1?' || chr(10) || 'Answer: 2' || chr(10) || chr(10) || 'Question: ' || text || chr(10) || 'Answer:') AS shot_md5 FROM h
""",
    "video_records": f"WITH {_C} SELECT 'clips#' || id || '-3' AS id, CAST(json_array_length(image) AS INTEGER) AS n_frames, md5(repeat('<image>', CAST(json_array_length(image) AS BIGINT)) || chr(10) || 'What happens?') AS asked_md5 FROM c WHERE starts_with(ltrim(image), '[')",
    "channel_prompts": f"""
WITH e AS (SELECT item_id, label, '<|start|>system<|message|>{_HEAD}' || CASE WHEN item_id % 2 = 0 THEN 'low' ELSE 'high' END || '{_TAIL}<|end|><|start|>user<|message|>' || text || '<|end|>' || CASE WHEN item_id % 2 = 0 THEN '<|start|>assistant<|channel|>analysis<|message|>' || coalesce(category, 'none') || '<|end|>' ELSE '' END || '<|start|>assistant<|channel|>final<|message|>' || label || '<|end|>' AS t FROM eval_items)
SELECT item_id, md5(t) AS prompt_md5, array_to_string(regexp_extract_all(t, '<\\|channel\\|>(\\w+)<\\|message\\|>', 1), ',') AS channels, label AS last FROM e
""",
    "message_parts": """
SELECT item_id, 'text=see|image=|text=' || trim('and ' || coalesce(category, '')) || '|image=' AS parts, 'text=first |image=' || label || '|text= then |image=' || benchmark || CASE WHEN item_id % 2 = 0 THEN '|text= again |image=' || label || '|text= and |text=.' ELSE '' END AS numbered FROM eval_items
""",
    "chat_payloads": f"WITH {_C} SELECT id, CAST(len(list_filter(conversations, lambda x: x IS NOT NULL)) AS INTEGER) AS n_messages, CAST(len(list_filter(conversations, lambda x: regexp_matches(x.reasoning_content, '\\S'))) AS INTEGER) AS n_before, CAST(len(list_filter(conversations, lambda x: regexp_matches(x.reasoning_content, '\\S') AND coalesce(x.role, '') <> 'assistant')) AS INTEGER) AS n_after FROM c WHERE conversations IS NOT NULL",
    "offline_samples": f"""
WITH {_SEQ}, o AS (SELECT id, list_transform(mask[1:20], lambda x, i: CASE WHEN i = least(n, 20) THEN 0 ELSE x END) AS m FROM q)
SELECT id, CAST(len(m) AS INTEGER) AS n, CAST(list_sum(m) AS INTEGER) AS trained, list_last(m) AS last, array_to_string(m, '') || repeat('-1', 22 - len(m)) AS padded FROM o
""",
    "sequence_shards": f"""
WITH {_SEQ}, z AS (SELECT id, n, tokens, unnest(range(0, 4)) AS shard, CAST(ceil(n / 4.0) AS BIGINT) AS size FROM q)
SELECT id, CAST(shard AS INTEGER) AS shard, CAST(shard * size AS INTEGER) AS start, array_to_string(list_transform(range(1, size + 3), lambda i: CAST(coalesce(tokens[shard * size + i], 0) AS VARCHAR)), ',') AS v FROM z
""",
    "prompt_columns": "SELECT item_id, CAST(turn AS INTEGER) AS turn, prompt FROM (SELECT item_id, unnest([1, 2, 10]) AS turn, unnest([benchmark, category, label]) AS prompt FROM eval_items) WHERE prompt IS NOT NULL",
    "rebased_paths": """
WITH e AS (SELECT string_split(min(path), '/') AS a, string_split(max(path), '/') AS b FROM documents WHERE path IS NOT NULL), k AS (SELECT a, list_filter(range(1, least(len(a), len(b)) + 1), lambda i: i >= least(len(a), len(b)) OR a[i] IS DISTINCT FROM b[i]) AS bad FROM e), r AS (SELECT array_to_string(a[1:bad[1] - 1], '/') AS root FROM k)
SELECT doc_id, root, CASE WHEN starts_with(path, root || '/') THEN '/data' || substring(path, length(root) + 1) END AS moved, CASE WHEN starts_with(path, 'corpus/') THEN '/elsewhere' || substring(path, 7) END AS fixed FROM documents, r WHERE path IS NOT NULL
""",
    "rewritten_prompts": f"""
SELECT item_id, md5(CASE WHEN contains(text, '{THINK}') THEN text ELSE rtrim(text, ' ') || chr(10) || '{THINK}' END) AS reasoned_md5, md5(label) AS other_md5, md5(CASE WHEN r > 0 THEN {_terse('text')} ELSE text END) AS stripped_md5, CAST(r AS INTEGER) AS n_removed,
 md5(CASE WHEN ends_with(rtrim(text, ' '), '?') AND NOT regexp_matches(text, '(?i)\\b(describe|explain|why|how|list|summari[sz]e)\\b') AND NOT contains(text, 'Suppose') AND NOT contains(text, 'passage') AND NOT contains(text, 'Answer briefly.') THEN rtrim(text, ' ') || chr(10) || 'Answer briefly.' ELSE text END) AS short_md5
FROM (SELECT *, {' + '.join(f"contains(text, '{p}')::INT" for p in TERSE)} AS r FROM eval_items)
""",
    "span_masks": f"""
WITH {_M}, t AS (SELECT id, i, m.role AS role, coalesce(m.content, '') AS x FROM m WHERE m.role IN ('user', 'assistant')),
w AS (SELECT id, i, role, 1 + len({_WORDS.format("x || CASE WHEN role = 'assistant' THEN '<|end|>' ELSE '' END")}) AS n, len({_WORDS.format("x || '<|end|>'")}) AS own, (x = '' OR regexp_matches(x, '\\s$'))::INT AS apart, max(CASE WHEN role = 'assistant' THEN i END) OVER (PARTITION BY id) AS l FROM t)
SELECT id, CAST(sum(n) AS INTEGER) AS n_tokens, CAST(coalesce(sum(own) FILTER (WHERE role = 'assistant'), 0) AS INTEGER) AS n_trained, CAST(coalesce(sum(own - apart) FILTER (WHERE i = l), 0) AS INTEGER) AS n_last FROM w GROUP BY id
""",
    "template_controls": r"""
SELECT * FROM (VALUES ('plain', '<|assistant|>' || chr(10), '<|end|>' || chr(10), '<\|assistant\|>\' || chr(10) || '([\s\S]*?)(?=<\|start\|>user<\|message\|>|$)'), ('turns', 'ASSISTANT: ', '</s>' || chr(10), 'ASSISTANT:\ ([\s\S]*?)(?=<\|start\|>user<\|message\|>|$)'), ('braces', '[A] ', ' [/A]' || chr(10), '\[A\]\ ([\s\S]*?)(?=<\|start\|>user<\|message\|>|$)')) t(template, header, ending, pattern)
""",
    "header_masks": f"""
WITH e AS (SELECT item_id, {_WORDS.format('lower(text)')} AS w FROM eval_items), s AS (SELECT item_id, w, list_filter(range(0, len(w) - 1), lambda i: w[i + 1:i + 2] = ['the', 'same']) AS s FROM e),
m AS (SELECT item_id, s, list_filter(range(0, len(w)), lambda i: len(list_filter(s, lambda p: p + 2 <= i AND NOT list_contains(w[p + 3:i], 'every'))) > 0) AS m FROM s)
SELECT item_id, array_to_string(s, ',') AS starts, CAST(len(m) AS INTEGER) AS n_masked FROM m
""",
    "common_prefixes": f"""
WITH e AS (SELECT item_id, {_WORDS.format('text')} AS a, {_WORDS.format("replace(text, ' that ', ' those ')")} AS b FROM eval_items), k AS (SELECT item_id, a, list_filter(range(1, len(a) + 1), lambda i: a[i] IS DISTINCT FROM b[i]) AS d FROM e)
SELECT item_id, CAST(CASE WHEN len(d) > 0 THEN d[1] - 1 ELSE len(a) END AS INTEGER) AS n FROM k
""",
    "run_names": """
SELECT run_id, block_size AS "window", CAST(length(run_id) AS INTEGER) AS frames, draft_model AS model, benchmark AS config, CAST(greatest(1, round_even(block_size * 37 / 32.0, 0)) * greatest(1, round_even(block_size * 5 / 32.0, 0)) AS INTEGER) AS picture_tokens FROM runs
""",
    "picture_types": f"""
SELECT item_id, CASE item_id % 6 WHEN 0 THEN '.jpg' WHEN 1 THEN '.png' WHEN 2 THEN '.gif' WHEN 3 THEN '.webp' WHEN 4 THEN '.bmp' END AS suffix,
 'data:image/' || CASE item_id % 4 WHEN 0 THEN 'jpeg' WHEN 1 THEN 'png' WHEN 2 THEN 'gif' ELSE 'webp' END || ';base64,' || to_base64(unhex(CASE item_id % 6 {' '.join(f"WHEN {i} THEN '{m}'" for i, m in enumerate(MAGIC))} END)) AS url FROM eval_items
""",
    "score_alignment": f"""
WITH {_SEQ}, f AS (SELECT *, md5(array_to_string(tokens, ',')) AS fingerprint, CASE n % 3 WHEN 0 THEN md5(array_to_string(tokens, ',')) WHEN 1 THEN 'other' END AS fp FROM q)
SELECT id, fingerprint, CASE WHEN n % 7 = 0 THEN 'missing' WHEN n % 5 <> 0 AND floor(n / 3) = list_sum(mask) AND (fp IS NULL OR fp = fingerprint) THEN 'scored' ELSE 'misaligned' END AS status FROM f
""",
    "source_specs": """
SELECT * FROM (VALUES ('maskwiki=5', 'maskwiki', 5, NULL), ('glossary', 'glossary', NULL, NULL), (' kerneltalk = all', 'kerneltalk', NULL, NULL), ('=3', NULL, NULL, 'names no source'), ('labminutes=x', NULL, NULL, 'the count must be an integer or ''all'''), ('labminutes=0', NULL, NULL, 'the count must be greater than zero'), ('a=-1', NULL, NULL, 'the count must be greater than zero'), ('b=+2', 'b', 2, NULL)) t(spec, handle, n, error)
""",
    "resolved_handles": """
WITH h AS (SELECT unnest(['Mask-Wiki', 'kernel', 'e', 'nowhere', 'RUN book']) AS handle), j AS (SELECT handle, count(source) AS n, min(source) AS source FROM h LEFT JOIN (SELECT DISTINCT source FROM mix_targets WHERE source IS NOT NULL) s ON contains(regexp_replace(lower(source), '[^a-z0-9]', '', 'g'), regexp_replace(lower(handle), '[^a-z0-9]', '', 'g')) GROUP BY handle)
SELECT handle, CASE WHEN n = 1 THEN source END AS source, CASE WHEN n = 0 THEN 'matches none' WHEN n > 1 THEN 'ambiguous: matches ' || n END AS error FROM j
""",
    "source_draw": """
WITH k AS (SELECT doc_id, regexp_replace(lower(source), '[^\\p{L}\\p{N}]', '', 'g') AS source FROM documents), r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY md5('17|' || doc_id), doc_id) AS r FROM k WHERE source IS NOT NULL)
SELECT source, doc_id FROM r WHERE source = 'maskwiki' AND r <= 5 OR source = 'glossary' OR source = 'kerneltalk' AND r <= 12
""",
    "tensor_columns": "SELECT * FROM (VALUES ('pictures', 'a[].b'), ('pictures', 'm.value')) t(name, path)",
}
