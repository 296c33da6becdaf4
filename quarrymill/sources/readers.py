"""Readers: JSON records, feature files, score tables, logs, result documents, archives.

Readers plan scans; they collect nothing but what a docstring names. Broken records are kept apart with their file, so
that a caller decides whether to fail, to drop or to look at them.
"""

from __future__ import annotations

import tarfile
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from quarrymill.operators.sampling import capped_per_group, global_rank


def read_records(spark: SparkSession, path: str, schema: T.StructType | str, *, on_error: str = "fail") -> DataFrame:
    """Records of JSON lines or of one JSON array a file, told apart by each file's first character that isn't white
    space. Blank lines are skipped; lines and elements that are no objects fail (``fail``), are left out (``drop``), or
    come with their text in ``_broken`` and null fields (``keep``).

    Lines are read in splits. A file that is an array is read whole, by one task, and its elements are told apart as
    variants, so that one bad element costs no other; text that is no JSON array as a whole is one broken record. The
    test is a filter of its own: it runs whichever columns are asked for."""
    schema = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
    lines = spark.read.text(path).where(r"value RLIKE '\\S'").select("value", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_at"))
    first = lines.where("_at = 0").withColumn("_n", F.monotonically_increasing_id()).groupBy("_file").agg(F.min_by(F.ltrim("value").startswith("["), "_n").alias("_array"))
    # left joins, and a test that names their flag: a test that may raise mustn't run below the join
    arrays = F.broadcast(first.where("_array").select("_file", F.lit(True).alias("_is")))
    single = lines.join(arrays, "_file", "left").select("_file", F.col("value").alias("_text"), F.col("_is").isNotNull().alias("_skip"))
    whole = spark.read.text(path, wholetext=True).select("value", F.col("_metadata.file_path").alias("_file")).join(arrays, "_file", "left").select("_file", "value", F.col("_is").isNull().alias("_skip"), F.when(F.col("_is"), F.try_parse_json("value")).alias("_v"))
    is_list = F.coalesce(F.expr("schema_of_variant(_v) LIKE 'ARRAY%'"), F.lit(False))
    texts = F.when(is_list, F.expr("transform(cast(_v AS ARRAY<VARIANT>), x -> coalesce(to_json(x), 'null'))")).otherwise(F.array("value"))
    elements = whole.where("NOT _skip").select("_file", F.explode(texts).alias("_text"), "_skip")
    rows = single.unionByName(elements).withColumn("_ok", F.coalesce(F.try_parse_json("_text").isNotNull() & F.ltrim("_text").startswith("{"), F.lit(False)))
    if on_error == "fail":
        stop = F.raise_error(F.concat(F.lit("not a JSON object in "), F.col("_file"), F.lit(": "), F.substring("_text", 1, 80)))
        rows = rows.where(F.when(F.col("_skip"), False).when(F.col("_ok"), True).otherwise(stop.cast("boolean")))
    else:
        rows = rows.where("NOT _skip AND _ok" if on_error == "drop" else "NOT _skip")
    record = rows.withColumn("r", F.from_json("_text", schema))
    return record.select("r.*") if on_error != "keep" else record.select("r.*", F.when(~F.col("_ok"), F.col("_text")).alias("_broken"))


def read_dataset(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """Records of a ``.json`` or ``.jsonl`` file or of a folder; other suffixes are refused."""
    name = path.rstrip("/").rpartition("/")[2]
    if "." in name and not name.endswith((".json", ".jsonl")):
        raise ValueError(f"not a .json or .jsonl file: {path}")
    return read_records(spark, path, schema)


def read_committed_lines(spark: SparkSession, path: str) -> DataFrame:
    """(line, file) of JSON-line files that a crash may have cut: a broken last line of a file is left out, a whole
    one without its line feed is kept, and a broken line anywhere else fails.

    The last line of a file is the greatest row number of the file's last block; only one row a file is joined."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), (F.col("_metadata.file_block_start") + F.col("_metadata.file_block_length") >= F.col("_metadata.file_size")).alias("_end")).withColumn("_n", F.monotonically_increasing_id())
    lines = lines.where(r"value RLIKE '\\S'").withColumn("_ok", F.try_parse_json("value").isNotNull())
    last = lines.where("_end").groupBy("file").agg(F.max("_n").alias("_last"))
    j = lines.join(last, "file", "left").where(F.col("_ok") | ~F.coalesce(F.col("_n") == F.col("_last"), F.lit(False)))
    stop = F.raise_error(F.concat(F.lit("broken line in "), F.col("file")))
    return j.select(F.when(F.col("_ok"), F.col("value")).otherwise(stop).alias("line"), "file")


def concat_configs(parts: list[DataFrame]) -> DataFrame:
    """All rows of several configurations; columns that one lacks are null."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def feature_files(spark: SparkSession, path: str, suffixes: tuple[str, ...] = (".ckpt", ".ckpt.gz", ".parquet")) -> DataFrame:
    """(path, length) of feature files below a folder; contents aren't read."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length")
    test = F.lit(False)
    for s in suffixes:
        test = test | F.col("path").endswith(s)
    return f.where(test)


def feature_manifest(spark: SparkSession, path: str, run_id: str, required: list[str]) -> DataFrame:
    """(sample_id, uri, bytes) of Parquet feature files, as ``feature_refs``; a file that lacks a required column fails."""
    files = feature_files(spark, path, (".parquet",))
    have = set(spark.read.option("mergeSchema", "false").parquet(path).columns)
    lost = [c for c in required if c not in have]
    if lost:
        raise ValueError(f"feature files lack {lost}")
    return feature_refs(files, run_id)


def read_shards(spark: SparkSession, path: str, column: str, wanted: list[int]) -> DataFrame:
    """Rows of some shards of a table written in folders by ``column``; others aren't listed or read."""
    return spark.read.parquet(path).where(F.col(column).isin(wanted))


def feature_refs(files: DataFrame, run_id: str) -> DataFrame:
    """(sample_id, uri, bytes): references ``<run>:<number>`` in path order."""
    ranked = global_rank(files, [F.col("path")], "n")
    return ranked.select(F.format_string("%s:%08d", F.lit(run_id), F.col("n")).alias("sample_id"), F.col("path").alias("uri"), F.col("length").alias("bytes"))


SCORES = "id STRING, n_tokens INT, n_loss INT, fp STRING, kl ARRAY<DOUBLE>, entropy ARRAY<DOUBLE>"


def read_scores(spark: SparkSession, path: str) -> DataFrame:
    """A score table of JSON lines: a file or a folder (hidden files are skipped)."""
    return spark.read.schema(SCORES).json(path)


def read_process_dumps(spark: SparkSession, base: str, schema: str) -> DataFrame:
    """A dump and its siblings ``<base>.pid*`` of further processes."""
    return spark.read.schema(schema).json(f"{base}*")


def read_document(spark: SparkSession, path: str) -> DataFrame:
    """(file, document VARIANT) of whole-file JSON documents; text behind the first object is ignored."""
    raw = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), "value")
    return raw.select("file", F.coalesce(F.try_parse_json("value"), F.try_parse_json(F.regexp_extract("value", r"(?s)^(\s*\{.*\n\})", 1))).alias("document"))


def scrape_metrics(spark: SparkSession, path: str, names: list[str]) -> DataFrame:
    """(file, step, one column a name): the last step of each log with ``step=<n>`` and ``name=<number>`` or
    ``'name': <number>`` on its lines."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"))
    step = F.regexp_extract("value", r"step['\"]?\s*[=:]\s*(\d+)", 1).try_cast("bigint")
    number = lambda n: F.regexp_extract("value", rf"\b{n}['\"]?\s*[=:]\s*([-+]?[\d.]+(?:[eE][-+]?\d+)?)", 1).try_cast("double").alias(n)
    found = lines.select("file", step.alias("step"), *[number(n) for n in names]).where("step IS NOT NULL")
    return found.groupBy("file").agg(F.max("step").alias("step"), *[F.max_by(n, F.when(F.col(n).isNotNull(), F.col("step"))).alias(n) for n in names])


def read_settings(spark: SparkSession, path: str) -> DataFrame:
    """(file, key, value) of ``key=value`` lines; lines without ``=`` and comments are skipped; the last one wins."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file")).withColumn("_n", F.monotonically_increasing_id())
    kv = lines.where(r"value RLIKE '^\\s*[^#=\\s][^=]*='").select("file", "_n", F.trim(F.substring_index("value", "=", 1)).alias("key"), F.trim(F.regexp_extract("value", r"^[^=]*=(.*)$", 1)).alias("v"))
    return kv.groupBy("file", "key").agg(F.max_by("v", "_n").alias("value"))


def repeated_prompts(prompts: DataFrame, order: str, total: int, warm_up: int) -> DataFrame:
    """``total`` measured prompts in order, repeated in turn; the first ``warm_up`` sent are left out of the measure."""
    ranked = global_rank(prompts, [F.col(order)], "_p")
    n = prompts.agg(F.count("*").alias("_n"))
    sent = prompts.sparkSession.range(total + warm_up).withColumnRenamed("id", "sent").crossJoin(F.broadcast(n)).where("_n > 0").withColumn("_p", F.col("sent") % F.col("_n"))
    return sent.join(ranked, "_p").where(F.col("sent") >= warm_up).drop("_p", "_n")


QUESTIONS: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def question_set(name: str, *, question: str = "text", label: str = "label", category: str | None = "category", key: str = "item_id"):
    """Registers a local table as a benchmark's questions (id, question, label, category)."""

    def load(spark: SparkSession, path: str) -> DataFrame:
        return spark.read.parquet(path).select(F.col(key).alias("id"), F.col(question).alias("question"), F.col(label).alias("label"), (F.col(category) if category else F.lit(None).cast("string")).alias("category"))

    QUESTIONS[name] = load
    return load


question_set("eval-items")


@dataclass(frozen=True)
class QuestionSet:
    """A public benchmark: what its questions come with, and the scorer (see ``answers.SCORERS``) of its answers."""

    kind: str
    scorer: str
    question: str = "question"
    label: str = "answer"
    category: str | None = None


#: Public benchmarks with the columns of their question tables. Fixed values.
QUESTION_SETS = {
    "aime": QuestionSet("text", "contest-integer", "problem"), "ceval": QuestionSet("text", "first-letter", category="subject"), "financeqa": QuestionSet("text", "none"), "gpqa": QuestionSet("text", "marked"), "gsm8k": QuestionSet("text", "word-problem"), "humaneval": QuestionSet("text", "code", "prompt", "test"), "livecodebench": QuestionSet("text", "code", "question_content", "tests"),
    "math500": QuestionSet("text", "maths", "problem", category="subject"), "mbpp": QuestionSet("text", "code", "text", "test_list"), "mmlu": QuestionSet("text", "marked", category="subject"), "mmstar": QuestionSet("picture", "choice", category="category"), "mtbench": QuestionSet("text", "none", "prompt", "reference", "category"), "simpleqa": QuestionSet("text", "none", "problem"),
    "chartqa": QuestionSet("picture", "relaxed", category="type"), "charxiv": QuestionSet("picture", "reasoning"), "dynamath": QuestionSet("picture", "lenient", category="subject"), "mathverse": QuestionSet("picture", "lenient", category="problem_version"), "mathvision": QuestionSet("picture", "maths", category="subject"), "mathvista": QuestionSet("picture", "lenient", category="task"),
    "mmbench": QuestionSet("picture", "choice", category="category"), "mmmu": QuestionSet("picture", "lenient", category="subfield"), "ocrbench": QuestionSet("picture", "holds", category="question_type"), "realworldqa": QuestionSet("picture", "lenient"), "seedbench-image": QuestionSet("picture", "choice", category="question_type_id"), "simplevqa": QuestionSet("picture", "lenient"),
    "textvqa": QuestionSet("picture", "votes", label="answers"), "longvideobench": QuestionSet("video", "ranked-choice", category="question_category"), "moviechat": QuestionSet("video", "none"), "mvbench": QuestionSet("video", "ranked-choice", category="task"), "vdc": QuestionSet("video", "none", label="caption"), "videomme": QuestionSet("video", "ranked-choice", category="duration"),
}

for _name, _set in QUESTION_SETS.items():
    question_set(_name, question=_set.question, label=_set.label, category=_set.category, key="id")


def select_questions(spark: SparkSession, name: str, path: str, categories: list[str] | None = None) -> DataFrame:
    """Questions of a registered set, of the named categories only; unknown names fail and say what there is."""
    if name not in QUESTIONS:
        raise KeyError(f"unknown question set {name!r}; known: {sorted(QUESTIONS)}")
    q = QUESTIONS[name](spark, path)
    if categories is None:
        return q
    wanted = spark.createDataFrame([(c.lower(),) for c in categories], "category STRING")
    known = q.select(F.lower("category").alias("category")).distinct()
    unknown = [r.category for r in wanted.join(known, "category", "left_anti").collect()]
    if unknown:
        raise KeyError(f"unknown categories {sorted(unknown)}; known: {sorted(r.category for r in known.where('category IS NOT NULL').collect())}")
    return q.join(F.broadcast(wanted.withColumnRenamed("category", "_c")), F.lower("category") == F.col("_c"), "left_semi")


def _files_of(path: str) -> tuple[pafs.FileSystem, str]:
    """The Arrow file system of a path or URI, and the path in it."""
    return pafs.FileSystem.from_uri(path if ":/" in path else f"file://{path}")


class ArchiveSource(DataSource):
    """``spark.read.format("tar").load(path)``: members of tar archives as (archive, name, size, content), from a folder
    or a single archive in any file system that Arrow opens; one partition an archive. An archive is read as a stream,
    member by member. Option ``content`` = false leaves contents out."""

    @classmethod
    def name(cls) -> str:
        return "tar"

    def schema(self) -> str:
        return "archive STRING, name STRING, size BIGINT, content BINARY"

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return _ArchiveReader(self.options.get("path", ""), self.options.get("content", "true").lower() != "false")


class _ArchiveReader(DataSourceReader):
    def __init__(self, path: str, content: bool) -> None:
        self.path, self.content = path, content

    def partitions(self) -> list[InputPartition]:
        system, inner = _files_of(self.path)
        info = system.get_file_info(inner)
        found = [info] if info.type == pafs.FileType.File else system.get_file_info(pafs.FileSelector(inner, allow_not_found=True))
        prefix = self.path[: len(self.path) - len(inner)] if self.path.endswith(inner) else ""
        names = sorted(f.path for f in found if f.type == pafs.FileType.File and ".tar" in f.base_name and not f.base_name.startswith("."))
        return [InputPartition(prefix + n) for n in names]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        if partition is None:
            return
        system, inner = _files_of(partition.value)
        with system.open_input_stream(inner, compression=None) as raw, tarfile.open(fileobj=raw, mode="r|*") as archive:
            for m in archive:
                if m.isfile():
                    yield partition.value, m.name, m.size, archive.extractfile(m).read() if self.content else None


def quota_per_config(df: DataFrame, config: str, key: str, quotas: DataFrame, seed: int) -> DataFrame:
    """Exactly ``quota`` rows of each configuration in ``quotas(config, quota)`` by seeded order; one that falls short
    fails. A hot configuration is cut by ticket before it is ranked (see ``sampling.capped_per_group``)."""
    have = df.groupBy(config).agg(F.count("*").alias("_have"))
    checked = quotas.join(have, config, "left").select(config, F.when(F.coalesce("_have", F.lit(0)) >= F.col("quota"), F.col("quota")).otherwise(F.raise_error(F.concat(F.lit("too few rows in "), F.col(config))).cast("long")).alias("quota"))
    return capped_per_group(df, config, key, None, seed, checked)


def require_columns(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """``df``, failing at the first row in which a required value is null."""
    for name, c in columns.items():
        df = df.where(F.when(c.isNull(), F.raise_error(F.lit(f"missing {name}"))).otherwise(F.lit(True)).cast("boolean"))
    return df
