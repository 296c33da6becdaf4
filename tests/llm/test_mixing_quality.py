"""Mixing and document quality on small made inputs."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarrymill.llm import mixing as M
from quarrymill.llm import quality as Q
from tests.conftest import rows


def test_flight_keeps_balance():
    rng = np.random.default_rng(1)
    size = rng.integers(1, 500, 700)
    p = np.full(700, 0.37)
    out = M.flight(p, size, np.random.default_rng(2))
    assert ((out > 0) & (out < 1)).sum() <= 2 and abs(out.sum() - p.sum()) < 1e-6 and abs((out * size).sum() - (p * size).sum()) < 1e-3
    done = M.landing(M.flight(p, size, np.random.default_rng(2), 12), size)
    assert set(done) <= {0.0, 1.0} and abs((done * size).sum() - (p * size).sum()) < 40
    assert set(M.landing(M.flight(np.full(9, 0.5), np.full(9, 7), rng), np.full(9, 7))) <= {0.0, 1.0}


def test_flight_is_unbiased():
    p = np.array([0.2, 0.5, 0.7, 0.6, 0.4, 0.6])
    size = np.array([5, 1, 9, 4, 7, 2])
    mean = np.mean([M.flight(p, size, np.random.default_rng(s)) for s in range(3000)], axis=0)
    assert np.abs(mean - p).max() < 0.05


def docs(spark):
    rng = random.Random(1)
    words_ = ["queue", "router", "window", "anchor", "ledger"]
    data = [(s * 1000 + i, " ".join(rng.choice(words_) for _ in range(rng.randint(5, 60))), name) for s, (name, n) in enumerate([("Big Source", 300), ("small_source", 6), ("mid", 80), ("other", 50)]) for i in range(n)]
    return spark.createDataFrame(data + [(9000, None, "mid"), (9001, " ", "mid"), (9002, "queue", None)], "doc_id BIGINT, text STRING, source STRING").withColumn("n_tokens", F.lit("x")).withColumn("row", F.lit(0))


TARGETS = "source STRING, target_share DOUBLE, max_repeats INT"


def test_mix_reaches_shares_within_caps(spark):
    targets = spark.createDataFrame([("bigsource", 0.5, 1), ("smallsource", 0.2, 3), ("mid", 0.2, 2), ("absent", 0.1, 2), (None, 0.1, 1), ("mid", 0.1, 9)], TARGETS)
    got = {r.source: r for r in M.mix_report(docs(spark), targets).collect()}
    assert set(got) == {"bigsource", "smallsource", "mid", "absent"} and got["absent"].actual_share == 0 and got["absent"].n_docs == 0
    for name, want in (("bigsource", 0.5 / 0.9), ("smallsource", 0.2 / 0.9), ("mid", 0.2 / 0.9)):
        assert abs(got[name].actual_share - want) < 0.01 and got[name].most_copies <= got[name].max_repeats
    assert got["smallsource"].most_copies == 3 and got["mid"].n_docs == 80
    mix = M.mixed_with_shares(docs(spark), targets)
    assert mix.where("n_copies < 1").count() == 0 and mix.count() == mix.select("doc_id").distinct().count()
    assert mix.agg(F.sum(F.col("n_copies") * F.col("n_tokens"))).first()[0] == sum(r.tokens_used for r in got.values())


def test_blocks_and_levels(spark):
    df = spark.range(3000).select(F.col("id").alias("row"), F.when(F.col("id") < 2900, "hot").otherwise("cold").alias("source"), (F.col("id") % 97 + 1).alias("n_tokens"), F.lit(0.31).alias("p"))
    out = M.balanced_rows(df, block=64)
    assert out.count() == 3000 and out.where("p NOT IN (0, 1)").count() == 0
    s = out.groupBy("source").agg(F.sum(F.col("p") * F.col("n_tokens")).alias("t"), F.sum(0.31 * F.col("n_tokens")).alias("w")).collect()
    assert all(abs(r.t - r.w) < 10 for r in s)


def test_mix_of_empty_tables(spark):
    targets = spark.createDataFrame([("mid", 1.0, 1)], TARGETS)
    assert M.mix_report(docs(spark).limit(0), targets).first().tokens_used == 0
    assert M.mix_report(docs(spark), targets.limit(0)).count() == 0 and M.mixed_with_shares(docs(spark), targets.limit(0)).count() == 0


def test_tokens_are_counted_whole(spark):
    df = spark.createDataFrame([(1, "hello world"), (2, None), (3, ""), (4, "word " * 50_000)], "k INT, t STRING")
    got = dict(rows(M.count_tokens(df, "t", ["k"])))
    assert got[1] == 2 and got[2] == got[3] == 0 and got[4] >= 50_000


PROSE = "The queue drains when the window of the other shard is full. It was slow at night, and we saw that the anchor of the ledger was not the same as before."
LETTERS = random.Random(3)


@pytest.mark.parametrize("text,kind", [
    (None, None), ("", None), (" \n ", None), (PROSE, None), ("# Heading\n\n" + PROSE + "\n\n- one thing\n- another\n\n" + PROSE, None), (PROSE.lower().replace(".", "").replace(",", ""), None),
    ("\n".join(f"- point {i} of plan" for i in range(9)), "list"), ("The points are these.\n\n" + "\n".join(f"{i}. step of plan" for i in range(1, 9)), "list"), ("\n".join(f"silent {w} cursor" for w in "router window anchor ledger shard queue lease tensor".split()), "list"),
    ("\n".join(f"1.{i} Chapter on things ........ {i * 7}" for i in range(1, 9)), "list"), ("\n".join(f"{w}_key: quiet {w} value" for w in "router window anchor ledger shard queue".split()), "list"),
    ("name\tcount\tshare\n" + "\n".join(f"row_{i}\t{i}\t{i / 7:.2f}" for i in range(9)), "table"), ("| a | b |\n| --- | --- |\n" + "\n".join(f"| r{i} | {i * 3} |" for i in range(9)), "table"), ("a,b,c\n" + "\n".join(f"r{i},{i * 3},{i * 5}" for i in range(9)), "table"),
    ("<table>\n" + "\n".join(f"<tr><td>r{i}</td><td>{i}</td></tr>" for i in range(9)) + "\n</table>", "table"), ("\n".join(f"{'row' + str(i):<20}{i * 3:<20}{i * 5}" for i in range(9)), "table"), ("\n".join(f"│ r{i} │ {i * 3} │ {i * 5} │" for i in range(9)), "table"),
    ("{}[]<>;:!@#$%^&*()_+ " * 30, "junk"), ("".join(LETTERS.choice("abcdefXYZ0123456789+/") for _ in range(600)), "junk"), (" ".join("".join(LETTERS.choice("bcdfghjklmnpqrstvwxz") for _ in range(LETTERS.randint(2, 9))) for _ in range(80)), "junk"),
    ("same words again " * 60, "junk"), ("same line\n" * 40, "junk"), (" ".join(PROSE.replace(" ", "")), "junk"), ("Plusieurs tâches répétées après l'été à côté du café où ça dépend. ".encode().decode("latin-1") * 5, "junk"), ('<div class="a"><a href=#1></a><br/></div>' * 30, "junk"),
    ("\n".join(f"00012345{i} ERR 0x{i * 7919:012x} stage:{i} rc={i} {i * 104729:08x}" for i in range(9)), "junk"),
])
def test_kinds(text, kind):
    assert Q.measures(text)[9] == kind


def test_measures_are_whole_and_defined(spark):
    df = spark.createDataFrame([(1, PROSE), (1, PROSE), (2, None), (None, "x"), (3, PROSE + " " + "more words. " * 40_000)], "doc_id BIGINT, text STRING").withColumn("kind", F.lit(9)).withColumn("reason", F.lit(9))
    got = Q.document_quality(df).collect()
    assert len(got) == 5 and sum(r.doc_id == 1 for r in got) == 2
    by = {r.doc_id: r for r in got}
    assert by[1].n_words == 32 and by[1].punctuated_lines == 1.0 and by[2].n_words == 0 and by[2].kind is None and by[3].n_words == 32 + 80_000
    assert Q.document_quality(df.limit(0)).count() == 0


def test_layout_measures():
    assert Q.autocorrelation([5, 9, 5, 9, 5, 9, 5, 9])[1] == 2 and Q.autocorrelation([4, 4, 4, 4]) == (1.0, 1) and Q.autocorrelation([1]) == (0.0, 0)
    assert Q.aligned_columns(["a   b   c", "d   e   f", "g   h   i"]) == 2 and Q.indent_period(["a", "  b", "a", "  b"]) > 0.6


def test_mix_is_the_same_however_rows_are_partitioned(spark):
    targets = spark.createDataFrame([("bigsource", 0.5, 1), ("smallsource", 0.2, 3), ("mid", 0.2, 2)], TARGETS)
    twice = docs(spark).unionByName(docs(spark).where("doc_id < 40"))
    mix = lambda df: rows(M.mixed_with_shares(df, targets), "doc_id", "n_copies")
    first = mix(twice.repartition(3))
    assert first and first == mix(twice.repartition(7, "text")) == mix(twice.coalesce(1).orderBy(F.desc("doc_id")))


def test_periods():
    assert Q.period([0, 2, 2, 0, 2, 2, 0, 2, 2]) == (1.0, 3) and Q.period([1, 1, 1, 1]) == (0.0, 0) and Q.period([1, 2]) == (0.0, 0)
    wrapped = [x for i in range(6) for x in (f"- the router drains window {i} of the other shard", "  when its queue is full, and that is", "  the end of it")]
    assert Q.indent_period(wrapped) == 1.0 and Q.folded(wrapped, [x[0] == "-" for x in wrapped]) == [True] * 6
    prose = ["The queue drains.", "- one", "  more", "It was slow.", "It was late.", "- two", "  more", "It was done."]
    assert Q.folded(prose, [x[0] == "-" for x in prose]).count(False) == 4


def test_wrapped_entries_make_a_list():
    """Told by the period of indentation alone: a third of the lines have signs."""
    text = "\n".join(f"{i}. step {i} drains the window of a shard\n   once the queue is full and the other\n   ledger is closed for that night" for i in range(1, 9))
    assert Q.measures(text)[9:] == ("list", "entries")
    assert Q.measures(PROSE + "\n\n- one thing\n  and more of it\n- another\n  and more\n\n" + PROSE + "\n" + PROSE)[9] is None


def test_openings_of_any_length():
    items = "\n".join(f"- point {i} of plan" for i in range(9))
    assert Q.measures("The points " + "of the plan and of the other plan " * 40 + "are these.\n\n" + items)[9] == "list"
    assert Q.measures((PROSE + " ") * 6 + "\n\n" + "\n".join(f"- point {i} of plan" for i in range(2)))[9] is None
