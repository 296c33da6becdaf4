"""Queries of readers, writers and channels: tables are written to the shared folder and read back; with DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrymill.functions import text as X
from quarrymill.operators import projections as P
from quarrymill.operators import sampling as O
from quarrymill.operators import scores as S
from quarrymill.plans.corpus_queries import _C, _FOLD, _errors, once
from quarrymill.session import table
from quarrymill.sources import readers as R
from quarrymill.sources import sinks as K
from quarrymill.streaming import refs as T

c, lit = F.col, F.lit


def _items(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "eval_items")


def json_lines(spark: SparkSession, d: str) -> DataFrame:
    """Documents as JSON lines of which some are cut, no objects or blank: what is read, and what is told apart."""
    folder = T.work_folder(spark, "lines")
    whole = F.to_json(F.struct("doc_id", "lang"))
    k = c("doc_id") % 10
    table(spark, d, "documents").select(F.when(k == 0, F.substring(whole, lit(1), F.length(whole) - 1)).when(k == 1, lit("71")).when(k == 2, lit("  ")).otherwise(whole).alias("value")).write.text(folder)
    r = R.read_records(spark, folder, "doc_id BIGINT, lang STRING", on_error="keep")
    return r.groupBy(c("_broken").isNotNull().alias("broken")).agg(F.count("*").alias("n"), F.coalesce(F.sum("doc_id"), lit(0)).alias("ids"), F.count("lang").alias("n_lang"))


def json_arrays(spark: SparkSession, d: str) -> DataFrame:
    """Items as one JSON array a benchmark, with elements that are no objects among them, beside lines."""
    folder = T.work_folder(spark, "arrays")
    one = F.when(c("item_id") % 9 == 0, "7").when(c("item_id") % 9 == 1, '"x"').otherwise(F.to_json(F.struct("item_id", "label")))
    _items(spark, d).groupBy("benchmark").agg(F.concat(lit(" ["), F.array_join(F.collect_list(one), ",\n"), lit("]")).alias("value")).repartition("benchmark").write.partitionBy("benchmark").text(folder)  # the items are a fixed set
    r = R.read_records(spark, folder, "item_id BIGINT, label STRING", on_error="drop")
    return r.select("item_id", "label")


def committed_lines(spark: SparkSession, d: str) -> DataFrame:
    """Lines of files of which a crash cut the last one."""
    folder = T.work_folder(spark, "crash")
    e = _items(spark, d).select("benchmark", "item_id", F.to_json(F.struct("item_id")).alias("j"))
    last = e.groupBy("benchmark").agg(F.max("item_id").alias("m"))
    cut = e.join(last, "benchmark").select("benchmark", "item_id", F.when((c("item_id") == c("m")) & (c("benchmark") > "k"), F.substring("j", 1, 6)).otherwise(c("j")).alias("value"))
    cut.repartition("benchmark").sortWithinPartitions("benchmark", "item_id").drop("item_id").write.partitionBy("benchmark").text(folder)
    return R.read_committed_lines(spark, folder).select(F.get_json_object("line", "$.item_id").cast("bigint").alias("item_id"))


def config_parts(spark: SparkSession, d: str) -> DataFrame:
    """Configurations of which one lacks a column, one after the other; written one folder each, and which are finished."""
    doc = table(spark, d, "documents").select("doc_id", F.coalesce(F.lower(F.trim("lang")), lit("none")).alias("config"), "n_chars")
    both = R.concat_configs([doc.where("config = 'en'"), doc.where("config <> 'en'").drop("n_chars")])
    folder = T.work_folder(spark, "configs")
    K.write_configs(both, folder, "config")
    K.write_configs(both.where("config = 'de'").limit(1), folder, "config")  # only that configuration is replaced
    wanted = both.groupBy("config").agg(F.count("*").alias("n"))
    done = K.finished_configs(spark, folder, "config", wanted).select("config", lit(True).alias("finished"))
    return both.groupBy("config").agg(F.count("*").alias("n"), F.count("n_chars").alias("n_sized")).join(done, "config", "left").select("config", "n", "n_sized", F.coalesce("finished", lit(False)).alias("finished"))


def quota_draw(spark: SparkSession, d: str) -> DataFrame:
    """An exact quota of documents of each source that has enough."""
    doc = table(spark, d, "documents").where("source IS NOT NULL").select("doc_id", X.fold_handle(c("source")).alias("source"))
    quotas = doc.groupBy("source").agg(F.count("*").alias("n")).where("n > 3").select("source", (c("n") - F.floor(c("n") / 2)).cast("long").alias("quota"))
    return R.quota_per_config(doc, "source", "doc_id", quotas, 31).select("source", "doc_id")


def feature_shards(spark: SparkSession, d: str) -> DataFrame:
    """Rows written in folders of consecutive numbers; the rows of some shards, read back without the others."""
    folder = T.work_folder(spark, "buckets")
    K.write_buckets(_items(spark, d).select("item_id"), folder, "item_id", 500)
    return R.read_shards(spark, folder, "bucket", [7500, 8500, 9500]).select(c("bucket").cast("long").alias("bucket"), "item_id")


def feature_references(spark: SparkSession, d: str) -> DataFrame:
    """References to feature files in path order, once their columns were checked."""
    folder = T.work_folder(spark, "features")
    e = _items(spark, d).select(F.floor(c("item_id") / 1000).alias("shard"), c("item_id").alias("input_ids"), lit(1).alias("loss_mask"))
    e.repartition("shard").write.partitionBy("shard").parquet(folder)
    m = R.require_columns(R.feature_manifest(spark, folder, "run-7", ["input_ids", "loss_mask"]), {"uri": c("uri")})
    return m.select("sample_id", F.regexp_extract("uri", r"shard=(\d+)", 1).cast("int").alias("shard"))


def archive_members(spark: SparkSession, d: str) -> DataFrame:
    """Items written as members of tar archives and read back."""
    folder = T.work_folder(spark, "archives")
    e = _items(spark, d).select((c("item_id") % 5).cast("string").alias("g"), F.concat(c("item_id").cast("string"), lit(".txt")).alias("name"), c("text").cast("binary").alias("content"))
    K.write_archives(e, folder, "g", "name", "content").agg(F.sum("n")).collect()  # one number
    spark.dataSource.register(R.ArchiveSource)
    r = spark.read.format("tar").load(folder)
    return r.select(F.regexp_extract("archive", r"([^/]*)$", 1).alias("archive"), "name", "size", F.md5("content").alias("content_md5"))


def score_files(spark: SparkSession, d: str) -> DataFrame:
    """Scores as JSON files, beside the dumps of further processes."""
    folder = T.work_folder(spark, "scores")
    s = table(spark, d, "score_sidecar")
    s.where("n_tokens % 2 = 0").write.json(f"{folder}/dump")
    s.where("n_tokens % 2 = 1").write.json(f"{folder}/dump.pid7")
    one = R.read_scores(spark, f"{folder}/dump").select("id", "n_loss", F.size("kl").alias("n_kl"), lit("own").alias("part"))
    return one.unionByName(R.read_process_dumps(spark, f"{folder}/dump", R.SCORES).where("n_tokens % 2 = 1").select("id", "n_loss", F.size("kl").alias("n_kl"), lit("other").alias("part")))


def result_documents(spark: SparkSession, d: str) -> DataFrame:
    """Documents of results, one object a file with text behind it, and their figures by path."""
    folder = T.work_folder(spark, "results")
    g = _items(spark, d).groupBy("benchmark").agg(F.count("*").alias("n"))
    g.select("benchmark", F.concat(lit('{\n "'), "benchmark", lit('": [{"n": '), c("n").cast("string"), lit('}]\n}'), F.when(c("n") % 2 == 0, "\ndone").otherwise("")).alias("value")).repartition("benchmark").write.partitionBy("benchmark").text(folder)
    r = R.read_document(spark, folder).select(F.regexp_extract("file", r"benchmark=([^/]*)", 1).alias("benchmark"), "document")
    figures = F.from_json(F.to_json("document"), "map<string, array<struct<n: bigint>>>")
    return r.select("benchmark", F.get(F.element_at(figures, c("benchmark")), 0).n.alias("n"))


def log_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Last figures of made training logs, and settings of key=value files, by run."""
    folder = T.work_folder(spark, "logs")
    runs = table(spark, d, "runs").select("run_id", F.coalesce("block_size", lit(0)).alias("b"))
    line = lambda step, tail: F.concat(lit("[info] step="), step.cast("string"), lit(" loss="), (c("b") / step).cast("string"), lit(tail))
    logs = runs.select("run_id", F.explode(F.array(line(lit(1), ""), lit("noise"), line(lit(4), " {'acc': 0.25}"), line(lit(8), ""), F.concat(lit("block="), c("b").cast("string")), lit("# block=x"), F.concat(lit("block = "), (c("b") + 1).cast("string")))).alias("value"))
    logs.repartition("run_id").write.partitionBy("run_id").text(folder)
    run = lambda df: df.withColumn("run_id", F.regexp_extract("file", r"run_id=([^/]*)", 1))
    m = run(R.scrape_metrics(spark, folder, ["loss", "acc"]))
    s = run(R.read_settings(spark, folder)).where("key = 'block'").select("run_id", c("value").alias("block"))
    return m.join(s, "run_id").select("run_id", "step", "loss", "acc", "block")


def split_files(spark: SparkSession, d: str) -> DataFrame:
    """A split written with its counts, a train and test part that isn't written twice, and a table with a header."""
    folder = T.work_folder(spark, "splits")
    o = once(spark, d, "conversations").select("id", F.transform(F.filter("conversations", lambda m: m.isNotNull()), lambda m: F.struct(F.when(m.role == "user", "human").when(m.role == "assistant", "gpt").otherwise(m.role).alias("from"), m.content.alias("value"))).alias("conversations"))
    counts = K.write_split(P.sharegpt(o), f"{folder}/all")
    parts = O.train_test(once(spark, d), "id").select("id", "split")
    K.write_train_test(parts, f"{folder}/parts")
    K.write_train_test(parts.limit(1), f"{folder}/parts")  # refused: the parts are there
    n = {r.split: r["count"] for r in spark.read.json(f"{folder}/parts").groupBy("split").count().collect()}  # two rows
    K.write_csv(table(spark, d, "runs").select("run_id", "block_size"), f"{folder}/csv")
    csv = spark.read.option("header", True).csv(f"{folder}/csv").count()
    rows = [(k, int(v)) for k, v in {**counts, **n, "csv": csv, "read": spark.read.json(f"{folder}/all").count()}.items()]
    return spark.createDataFrame(rows, "name STRING, n BIGINT")


def routed_files(spark: SparkSession, d: str) -> DataFrame:
    """Rows written by their sink in one pass and read back by sink."""
    from quarrymill.operators import validation as V

    folder = T.work_folder(spark, "routes")
    o = table(spark, d, "tool_use_conversation").where("id IS NOT NULL")
    K.write_routes(V.route(o, V.conversation_error(c("conversations"))).select("id", "sink").distinct(), folder)
    return spark.read.json(folder).select("id", "sink")


def lost_pictures(spark: SparkSession, d: str) -> DataFrame:
    """Documents whose file isn't among those that are there, by folder."""
    doc = table(spark, d, "documents").select("doc_id", "path")
    files = doc.where("doc_id % 3 <> 0").select("path")
    return K.missing_images(doc, "path", files)


def table_versions(spark: SparkSession, d: str) -> DataFrame:
    """A table with its paths moved in a new version; the version before stays."""
    folder = T.work_folder(spark, "versions")
    K.new_version(table(spark, d, "documents").where("path IS NOT NULL").select("doc_id", "path"), folder)
    moved = K.rewrite_paths(spark, folder, "path", "corpus", "/archive/corpus")
    old = spark.read.parquet(f"{folder}/v=0").select("doc_id", c("path").alias("old"))
    return spark.read.parquet(moved).join(old, "doc_id").select("doc_id", "path", (c("path") != c("old")).alias("changed"), lit(K.latest_version(spark, folder).rpartition("/")[2]).alias("version"))


def prompt_artifacts(spark: SparkSession, d: str) -> DataFrame:
    """What follows a prompt in its full text."""
    e = _items(spark, d).select("item_id", F.concat("text", lit("\n\nAnswer: "), "label").alias("full"), F.concat("text", lit("\n\nAnswer: ")).alias("prompt"))
    return K.prompt_artifact(e, "full", "prompt").select("item_id", "target")


def reference_channel(spark: SparkSession, d: str) -> DataFrame:
    """References published in batches of which one fails, read from the channel as a stream, and what was cleaned up."""
    folder = T.work_folder(spark, "channel")
    r = table(spark, d, "sample_refs").where("sample_id IS NOT NULL").select("sample_id", "run_id", "strategy", "schema_version", "num_tokens", "estimated_bytes", "published_at")
    part = lambda k: r.where(F.conv(F.substring(F.md5("sample_id"), 1, 2), 16, 10).cast("int") % 4 == k)
    bad = part(2).withColumn("run_id", F.raise_error(lit("lost")).cast("string"))
    dropped: list[DataFrame] = []
    n = T.publish_prefix([part(0), part(1), bad, part(3)], f"{folder}/refs", lambda b: dropped.append(b.drop("run_id").select("sample_id")))
    read = T.drain(T.channel(spark, f"{folder}/refs"), f"{folder}/reader").groupBy(F.coalesce("strategy", lit("none")).alias("name")).agg(F.count("*").alias("n"))
    lost = dropped[0].unionByName(dropped[1]).agg(F.count("*").alias("n")).select(lit("*dropped*").alias("name"), "n")
    quantum = T.fixed_once(spark, f"{folder}/quantum", 32) + T.fixed_once(spark, f"{folder}/quantum", 32)
    return read.unionByName(lost).unionByName(spark.createDataFrame([("*published*", n), ("*quantum*", quantum)], "name STRING, n BIGINT"))


def enriched_rows(spark: SparkSession, d: str) -> DataFrame:
    """Rows sent to a service that fails on some: the others go on."""

    def client():
        def call(frame):
            import pandas as pd

            if (frame["item_id"] % 11 == 0).any():
                raise ValueError("refused")
            return pd.DataFrame({"id": frame["id"], "answer": frame["label"] + "!", "error": None})

        return call

    e = _items(spark, d).select(c("item_id").cast("string").alias("id"), "item_id", "label")
    return T.enrich(e, client, "id STRING, answer STRING, error STRING", parallel=3).select(c("id").alias("item_id"), "answer", "error")


def ledger_kinds(spark: SparkSession, d: str) -> DataFrame:
    """The same batches in a ledger of files, of the session, and of none."""
    r = table(spark, d, "sample_refs").select("sample_id", "run_id", "strategy", "schema_version", "num_tokens", "estimated_bytes", "published_at")
    out = None
    for kind in (T.Ledger, T.SessionLedger, T.ForgetfulLedger):
        ledger = kind(spark, T.work_folder(spark, "ledger"))
        ledger.commit(r.where("num_tokens % 2 = 0"), 0)
        ledger.commit(r, 1)
        ledger.commit(r, 1)  # the same batch again
        ledger.acknowledge(table(spark, d, "acked"), 0)
        part = ledger.outcomes().groupBy("outcome").agg(F.count("*").alias("n")).select(lit(kind.__name__).alias("ledger"), "outcome", "n")
        out = part if out is None else out.unionByName(part)
    return out


def registered_sets(spark: SparkSession, d: str) -> DataFrame:
    """Every registered question set loaded from a local table in its own columns."""
    folder = T.work_folder(spark, "sets")
    e = _items(spark, d)
    columns = sorted({x for q in R.QUESTION_SETS.values() for x in (q.question, q.label, q.category) if x})
    named = {**{q.question: c("text") for q in R.QUESTION_SETS.values()}, **{q.category: c("category") for q in R.QUESTION_SETS.values() if q.category}, **{q.label: c("label") for q in R.QUESTION_SETS.values()}}
    e.select(c("item_id").alias("id"), *[named[x].alias(x) for x in columns]).write.parquet(folder)
    out = None
    for name, q in R.QUESTION_SETS.items():
        part = R.select_questions(spark, name, folder).agg(lit(name).alias("name"), lit(q.kind).alias("kind"), F.count("question").alias("n_questions"), F.count("label").alias("n_labels"), F.count("category").alias("n_categories"))
        out = part if out is None else out.unionByName(part)
    return out


QUERIES = {
    f.__name__: f
    for f in (
        json_lines, json_arrays, committed_lines, config_parts, quota_draw, feature_shards, feature_references, archive_members, score_files, result_documents, log_metrics, split_files, routed_files, lost_pictures, table_versions, prompt_artifacts, reference_channel,
        enriched_rows, ledger_kinds, registered_sets,
    )
}

# --- SQL -------------------------------------------------------------------------------------------------------------

_FOLDED = _FOLD.format("source")
_SETS = {k: [n for n, q in R.QUESTION_SETS.items() if bool(q.category) == k] for k in (True, False)}

SQL = {
    "json_lines": """
SELECT broken, count(*) AS n, CAST(coalesce(sum(CASE WHEN NOT broken THEN doc_id END), 0) AS BIGINT) AS ids, count(CASE WHEN NOT broken THEN lang END) AS n_lang FROM (SELECT doc_id % 10 < 2 AS broken, doc_id, lang FROM documents WHERE doc_id % 10 <> 2) GROUP BY broken
""",
    "json_arrays": "SELECT item_id, label FROM eval_items WHERE item_id % 9 > 1",
    "committed_lines": "SELECT item_id FROM eval_items WHERE benchmark <= 'k' OR item_id <> (SELECT max(item_id) FROM eval_items x WHERE x.benchmark = eval_items.benchmark)",
    "config_parts": "WITH k AS (SELECT coalesce(lower(trim(lang)), 'none') AS config, n_chars FROM documents) SELECT config, count(*) AS n, CASE WHEN config = 'en' THEN count(n_chars) ELSE 0 END AS n_sized, config <> 'de' OR count(*) = 1 AS finished FROM k GROUP BY config",
    "quota_draw": f"WITH k AS (SELECT doc_id, {_FOLDED} AS source FROM documents WHERE source IS NOT NULL), r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY md5('31|' || doc_id), doc_id) AS r, count(*) OVER (PARTITION BY source) AS n FROM k) SELECT source, doc_id FROM r WHERE n > 3 AND r <= n - n // 2",
    "feature_shards": "SELECT CAST(item_id // 500 * 500 AS BIGINT) AS bucket, item_id FROM eval_items WHERE item_id // 500 * 500 IN (7500, 8500, 9500)",
    "feature_references": "WITH s AS (SELECT DISTINCT item_id // 1000 AS shard FROM eval_items) SELECT 'run-7:' || lpad(CAST(row_number() OVER (ORDER BY CAST(shard AS VARCHAR)) - 1 AS VARCHAR), 8, '0') AS sample_id, CAST(shard AS INTEGER) AS shard FROM s",
    "archive_members": "SELECT (item_id % 5) || '.tar' AS archive, item_id || '.txt' AS name, CAST(strlen(text) AS BIGINT) AS size, md5(text) AS content_md5 FROM eval_items",
    "score_files": "SELECT id, n_loss, CAST(len(kl) AS INTEGER) AS n_kl, CASE WHEN n_tokens % 2 = 0 THEN 'own' ELSE 'other' END AS part FROM score_sidecar WHERE n_tokens IS NOT NULL",
    "result_documents": "SELECT benchmark, count(*) AS n FROM eval_items GROUP BY benchmark",
    "log_metrics": "SELECT run_id, CAST(8 AS BIGINT) AS step, coalesce(block_size, 0) / 8.0::DOUBLE AS loss, 0.25::DOUBLE AS acc, CAST(coalesce(block_size, 0) + 1 AS VARCHAR) AS block FROM runs",
    "split_files": f"""
WITH {_C}, k AS (SELECT conversations IS NOT NULL AS there, coalesce(len(list_filter(conversations, lambda x: x IS NOT NULL AND coalesce(x.role, '') NOT IN ('user', 'assistant'))), 0) AS lost FROM c)
SELECT 'written' AS name, count(*) FILTER (WHERE there) AS n FROM k UNION ALL SELECT 'left_out', count(*) FILTER (WHERE NOT there) FROM k UNION ALL SELECT 'skipped', CAST(sum(lost) AS BIGINT) FROM k UNION ALL SELECT 'test', CAST(ceil(count(*) * 0.05) AS BIGINT) FROM k
UNION ALL SELECT 'train', count(*) - CAST(ceil(count(*) * 0.05) AS BIGINT) FROM k UNION ALL SELECT 'csv', count(*) FROM runs UNION ALL SELECT 'read', count(*) FILTER (WHERE there) FROM k
""",
    "lost_pictures": "WITH k AS (SELECT path FROM documents WHERE path IS NOT NULL AND path NOT IN (SELECT path FROM documents WHERE doc_id % 3 <> 0 AND path IS NOT NULL)) SELECT regexp_replace(path, '/?[^/]*$', '') AS folder, count(*) AS n FROM k GROUP BY 1",
    "table_versions": "SELECT doc_id, CASE WHEN starts_with(path, 'corpus/') THEN '/archive/' || path ELSE path END AS path, starts_with(path, 'corpus/') AS changed, 'v=1' AS version FROM documents WHERE path IS NOT NULL",
    "prompt_artifacts": "SELECT item_id, label AS target FROM eval_items",
    "reference_channel": """
WITH r AS (SELECT strategy, CAST('0x' || substring(md5(sample_id), 1, 2) AS INTEGER) % 4 AS k FROM sample_refs WHERE sample_id IS NOT NULL)
SELECT coalesce(strategy, 'none') AS name, count(*) AS n FROM r WHERE k < 2 GROUP BY 1 UNION ALL SELECT '*dropped*', count(*) FROM r WHERE k > 1 UNION ALL SELECT '*published*', 2 UNION ALL SELECT '*quantum*', 64
""",
    "enriched_rows": "SELECT CAST(item_id AS VARCHAR) AS item_id, CASE WHEN item_id % 11 <> 0 THEN label || '!' END AS answer, CASE WHEN item_id % 11 = 0 THEN 'ValueError: refused' END AS error FROM eval_items",
    "ledger_kinds": """
WITH r AS (SELECT DISTINCT sample_id FROM sample_refs WHERE sample_id IS NOT NULL), a AS (SELECT DISTINCT sample_id FROM acked WHERE sample_id IS NOT NULL), o AS (SELECT CASE WHEN r.sample_id IS NULL THEN 'unknown' WHEN a.sample_id IS NULL THEN 'requeued' ELSE 'released' END AS outcome FROM r FULL JOIN a ON r.sample_id = a.sample_id)
SELECT l AS ledger, outcome, count(*) AS n FROM o, (SELECT unnest(['Ledger', 'SessionLedger']) AS l) GROUP BY ALL
""",
    "registered_sets": "WITH n AS (SELECT count(text) AS q, count(label) AS l, count(category) AS c FROM eval_items), s AS (SELECT unnest(" + str(_SETS[True] + _SETS[False]) + ") AS name, unnest(" + str([1] * len(_SETS[True]) + [0] * len(_SETS[False])) + ") AS has, unnest(" + str([R.QUESTION_SETS[n].kind for n in _SETS[True] + _SETS[False]]) + ") AS kind) SELECT name, kind, q AS n_questions, l AS n_labels, c * has AS n_categories FROM s, n",
}
SQL["routed_files"] = "WITH " + _errors("validation") + "SELECT DISTINCT id, CASE WHEN lower(status) = 'error' THEN 'error' WHEN lower(status) = 'skipped' THEN 'skipped' WHEN error IS NOT NULL THEN 'rejected' ELSE 'success' END AS sink FROM err"
