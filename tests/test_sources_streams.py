"""Readers, writers and streams on files of a temporary folder."""

import datetime as dt
import io
import json
import tarfile

import pandas as pd
import pytest
from pyspark.sql import functions as F

from quarrymill.sources import readers as R
from quarrymill.sources import sinks as K
from quarrymill.streaming import refs as S
from tests.conftest import rows

SCHEMA = "id STRING, n INT"


def put(path, text):
    path.write_text(text)
    return str(path)


def test_records_of_both_forms(spark, tmp_path):
    lines = put(tmp_path / "a.jsonl", '\n{"id": "x", "n": 1}\n\n{"id": "y"}\n')
    array = put(tmp_path / "b.json", '  [{"id": "x", "n": 1},\n {"id": "y"}]')
    assert rows(R.read_records(spark, lines, SCHEMA), "id") == rows(R.read_records(spark, array, SCHEMA), "id") == [("x",), ("y",)]
    bad = put(tmp_path / "c.jsonl", '{"id": "x"}\n[1]\n{"id": \n')
    assert rows(R.read_records(spark, bad, SCHEMA, on_error="drop"), "id") == [("x",)]
    assert R.read_records(spark, bad, SCHEMA, on_error="keep").where("_broken IS NOT NULL").count() == 2
    with pytest.raises(Exception, match="not a JSON object"):
        R.read_records(spark, bad, SCHEMA).collect()


def test_cut_last_line(spark, tmp_path):
    put(tmp_path / "a.jsonl", '{"id": "1"}\n{"id": "2"}')
    put(tmp_path / "b.jsonl", '{"id": "3"}\n{"id": ')
    assert sorted(json.loads(r.line)["id"] for r in R.read_committed_lines(spark, str(tmp_path)).collect()) == ["1", "2", "3"]
    put(tmp_path / "c.jsonl", '{"id": \n{"id": "4"}\n')
    with pytest.raises(Exception, match="broken line"):
        R.read_committed_lines(spark, str(tmp_path)).collect()


def test_feature_files_and_refs(spark, tmp_path):
    for n in ("b.ckpt", "a.ckpt.gz", "c.txt"):
        put(tmp_path / n, "x")
    got = rows(R.feature_refs(R.feature_files(spark, str(tmp_path)), "run"), "sample_id", "uri")
    assert [g[0] for g in got] == ["run:00000000", "run:00000001"] and got[0][1].endswith("a.ckpt.gz")


def test_logs_settings_documents(spark, tmp_path):
    put(tmp_path / "t.log", "start\nstep=1 loss=0.5 acc=0.1\n{'step': 3, 'loss': 0.25}\nstep=2 loss=0.4\n")
    r = R.scrape_metrics(spark, str(tmp_path / "t.log"), ["loss", "acc"]).first()
    assert (r.step, r.loss, r.acc) == (3, 0.25, 0.1)
    assert rows(R.read_settings(spark, put(tmp_path / "c.txt", "# c\na=1\nb = x=y\na=2\nnone\n")), "key", "value") == [("a", "2"), ("b", "x=y")]
    doc = R.read_document(spark, put(tmp_path / "d.json", '{\n "a": {"b": 2}\n}\ntrailing'))
    assert doc.select(F.try_variant_get("document", "$.a.b", "int")).first()[0] == 2


def test_scores_skip_hidden_and_dumps(spark, tmp_path):
    put(tmp_path / "s.jsonl", '{"id": "a", "kl": [1.0]}\n')
    put(tmp_path / ".h.jsonl", '{"id": "z"}\n')
    assert rows(R.read_scores(spark, str(tmp_path)), "id") == [("a",)]
    put(tmp_path / "e.jsonl.pid7", '{"id": "q"}\n')
    put(tmp_path / "e.jsonl", '{"id": "p"}\n')
    assert rows(R.read_process_dumps(spark, str(tmp_path / "e.jsonl"), "id STRING")) == [("p",), ("q",)]


def test_archives(spark, tmp_path):
    with tarfile.open(tmp_path / "v.tar", "w") as t:
        info = tarfile.TarInfo("clip/1.mp4")
        info.size = 3
        t.addfile(info, io.BytesIO(b"abc"))
    spark.dataSource.register(R.ArchiveSource)
    got = spark.read.format("tar").load(str(tmp_path)).collect()
    assert [(r.name, r.size, bytes(r.content)) for r in got] == [("clip/1.mp4", 3, b"abc")]


def test_prompts_quotas_questions(spark, tmp_path):
    p = spark.createDataFrame([(i, f"p{i}") for i in range(3)], "k INT, p STRING")
    assert [r.p for r in R.repeated_prompts(p, "k", 4, 2).orderBy("sent").collect()] == ["p2", "p0", "p1", "p2"]
    df = spark.range(20).select(F.when(F.col("id") < 12, "a").otherwise("b").alias("c"), "id")
    q = spark.createDataFrame([("a", 5), ("b", 2)], "c STRING, quota INT")
    assert rows(R.quota_per_config(df, "c", "id", q, 1).groupBy("c").count()) == [("a", 5), ("b", 2)]
    with pytest.raises(Exception, match="too few rows"):
        R.quota_per_config(df, "c", "id", spark.createDataFrame([("b", 9)], "c STRING, quota INT"), 1).collect()
    spark.createDataFrame([(1, "q", "A", "Maths"), (2, "r", "B", None)], "item_id INT, text STRING, label STRING, category STRING").write.parquet(str(tmp_path / "q"))
    assert R.select_questions(spark, "eval-items", str(tmp_path / "q"), ["maths"]).count() == 1
    with pytest.raises(KeyError, match="unknown categories"):
        R.select_questions(spark, "eval-items", str(tmp_path / "q"), ["art"])
    with pytest.raises(KeyError, match="unknown question set"):
        R.select_questions(spark, "none", "x")
    assert R.concat_configs([p, p.drop("p")]).where("p IS NULL").count() == 3
    with pytest.raises(Exception, match="missing p"):
        R.require_columns(R.concat_configs([p, p.drop("p")]), {"p": F.col("p")}).collect()


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("a", [("user", "q")], 1), ("b", None, 2)], "id STRING, conversations ARRAY<STRUCT<role: STRING, content: STRING>>, skipped INT")
    assert K.write_split(df, str(tmp_path / "s")) == {"written": 1, "left_out": 1, "skipped": 3}
    s = spark.createDataFrame([(1, "train"), (2, "test")], "id INT, split STRING")
    first = K.write_train_test(s, str(tmp_path / "t"))
    K.write_train_test(s.where("id = 9"), str(tmp_path / "t"))
    assert spark.read.json(first).count() == 1
    K.write_routes(s.withColumn("sink", F.col("split")), str(tmp_path / "r"))
    assert spark.read.json(str(tmp_path / "r")).count() == 2
    K.write_buckets(spark.range(25), str(tmp_path / "b"), "id", 10)
    assert rows(spark.read.parquet(str(tmp_path / "b")).groupBy("bucket").count()) == [(0, 10), (10, 10), (20, 5)]
    K.write_configs(s, str(tmp_path / "c"), "split")
    K.write_configs(s.where("split = 'test'").withColumn("id", F.lit(7)), str(tmp_path / "c"), "split")
    assert rows(spark.read.parquet(str(tmp_path / "c")), "id", "split") == [(1, "train"), (7, "test")]
    assert rows(K.finished_configs(spark, str(tmp_path / "c"), "split", spark.createDataFrame([("test", 1), ("train", 5)], "split STRING, n BIGINT"))) == [("test", 1)]
    rec = spark.createDataFrame([("x/a.png",), ("x/b.png",), (None,)], "image STRING")
    assert rows(K.missing_images(rec, "image", spark.createDataFrame([("x/a.png",)], "path STRING"))) == [("x", 1)]
    assert K.new_version(s, str(tmp_path / "v")).endswith("v=0") and K.new_version(s, str(tmp_path / "v")).endswith("v=1")
    a = spark.createDataFrame([("abc", "ab")], "f STRING, p STRING")
    assert K.prompt_artifact(a, "f", "p").first().target == "c"
    with pytest.raises(Exception, match="begin with its prompt"):
        K.prompt_artifact(spark.createDataFrame([("abc", "x")], "f STRING, p STRING"), "f", "p").collect()


def refs(spark, *ids):
    at = dt.datetime(2025, 1, 1)
    return spark.createDataFrame([(i, "r", "e", 1, 5, 10, at) for i in ids], S.REF)


def test_channel_ledger_and_restart(spark, tmp_path):
    ch = str(tmp_path / "channel")
    S.publish(refs(spark, "s0", "s1"), ch)
    ledger = S.Ledger(spark, str(tmp_path / "ledger"))
    assert ledger.read("committed").count() == 0
    S.run_ledger(S.channel(spark, ch), ledger, str(tmp_path / "state")).awaitTermination()
    S.publish(refs(spark, "s1", "s2"), ch)
    S.run_ledger(S.channel(spark, ch), ledger, str(tmp_path / "state")).awaitTermination()
    assert rows(ledger.read("committed"), "sample_id") == [("s0",), ("s1",), ("s2",)]
    ledger.commit(refs(spark, "s1", "s2"), 1)  # the same batch again
    assert ledger.read("committed").count() == 3
    ledger.acknowledge(refs(spark, "s0", "s1"), 0)
    assert rows(ledger.outcomes()) == [("s0", "released"), ("s1", "released"), ("s2", "requeued")]


def test_dedup_stream(spark, tmp_path):
    ch = str(tmp_path / "c")
    S.publish(refs(spark, "a", "b", "a"), ch)
    S.publish(refs(spark, "b", "c"), ch)
    out = S.drain(S.once(S.channel(spark, ch, files_per_batch=1), "sample_id", "published_at", "1 day"), str(tmp_path / "w"))
    assert rows(out, "sample_id") == [("a",), ("b",), ("c",)]


def test_pause_latch_stream(spark, tmp_path):
    ch = str(tmp_path / "c")
    at = dt.datetime(2025, 1, 1)
    for k, n in enumerate([3, 2, -3, -1]):
        spark.createDataFrame([("r", at + dt.timedelta(seconds=k), n, 0)], "run_id STRING, at TIMESTAMP, refs BIGINT, bytes BIGINT").coalesce(1).write.mode("append").json(ch)
    s = spark.readStream.schema("run_id STRING, at TIMESTAMP, refs BIGINT, bytes BIGINT").option("maxFilesPerTrigger", 1).json(ch)
    seen = []
    q = S.pause_latch(s, high=5, low=1, high_bytes=100, low_bytes=50).writeStream.outputMode("update").foreachBatch(lambda df, i: seen.extend((r.refs, r.paused) for r in df.collect())).option("checkpointLocation", str(tmp_path / "k")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert seen == [(3, False), (5, True), (2, True), (1, False)]


def test_enrichment_isolates_failures(spark):
    def client():
        def call(p):
            if (p["id"] == 3).any():
                raise ValueError("no")
            return pd.DataFrame({"id": p["id"], "answer": p["id"].astype(str) + "!", "error": None})

        return call

    out = S.enrich(spark.range(6), client, "id BIGINT, answer STRING, error STRING", parallel=2)
    got = {r.id: (r.answer, r.error) for r in out.collect()}
    assert got[3] == (None, "ValueError: no") and got[5] == ("5!", None) and len(got) == 6
