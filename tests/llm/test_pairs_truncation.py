"""Pairs and truncation: rules on single texts, and the operators with statistics, nulls and repeats."""

import random

import pytest
from pyspark.sql import functions as F

from quarrymill.llm import pairs as P
from quarrymill.llm import truncation as T
from quarrymill.llm.words import lcs_length
from tests.conftest import message, rows

Q = "How can I tell whether the router buffer drains the same queue within 20 rows?"


@pytest.mark.parametrize("text,state", [
    ("A whole sentence.", "closed"), ("Cut in the middle of the sent", "open"), ("lower case question without its mark", "casual"), ("done", "plain"), ("0.25", "plain"), ("lr = 0.3", "plain"),
    ('{"a": [1, 2]}', "closed"), ('{"a": [1, 2', "open"), ('{"a": "b', "open"), ("```py\nx = 1\n```", "closed"), ("```py\nx = 1", "open"), ("See (this one", "open"), ("See (this one)", "closed"),
    ("Some words [truncated]", "open"), ("Some words...", "open"), ("Some words …", "open"), ("...", "closed"), ("Broken �", "open"), ("Ends on a comma,", "open"), ("Ends in \\u00", "open"),
    ("Steps.\n\n- one part\n- another part", "item"), ("[info] step=1 lag=0.5\n[info] step=2 lag=0.7", "plain"), ("[info] step=1 lag=0.5\n[info] step=2 lag=0.7\n[info] st", "open"), ("", "closed"), ("Ист", "plain"), ("这是一个完整的句子。", "closed"),
    ('"Quoted\n\nover two parts."', "closed"), ("1. first\n2. second (half", "open"),
])
def test_end_state(text, state):
    assert T.end_state(text)[0] == state


def test_long_value_is_read_whole():
    assert T.end_state("word " * 200_000 + "end.")[0] == "closed" and T.end_state('{"a": "' + "x" * 500_000)[0] == "open"


def test_truncated_values_with_statistics(spark, conversations):
    rng = random.Random(1)
    vocabulary = ["router", "buffer", "queue", "window", "shard", "ledger", "anchor"]
    sentence = lambda: " ".join(rng.choice(vocabulary) for _ in range(8)).capitalize() + "."
    data = [(f"plain#{i}", [message("user", Q), message("assistant", " ".join(sentence() for _ in range(rng.randint(2, 9))))]) for i in range(60)]
    long = [(f"capped#{i}", [message("user", Q), message("assistant", " ".join(sentence() for _ in range(12))[:200])]) for i in range(40)]
    odd = [("odd#1", [message("user", Q), message("assistant", "Items.\n\n- router window\n- shard buff")]), ("odd#2", [message("user", "why does the router queue"), message("assistant", "fine")]), ("odd#3", [None, message(None, "Cut he"), message("system", "Cut he")]), ("odd#4", None)]
    df = conversations(data + long + odd + odd)
    got = rows(T.truncated_values(df), "id", "msg_pos", "field")
    assert len(got) == len(set(got)) and all(not g[0].startswith("plain#") for g in got)
    assert ("odd#1", 1, "content") in got and sum(g[0].startswith("capped#") for g in got) >= 38 and not any(g[0] == "odd#3" for g in got)
    report = {(r.source, r.field): r for r in T.truncation_report(df).collect()}
    assert report["plain", "content"].n_cut == 0 and report["capped", "content"].n_cut >= 38 and report["capped", "content"].n_values == 80


def test_size_limit_decides_soft_values(spark):
    schema = "source STRING, field STRING, n_chars INT, state STRING"
    cut = [("s", "content", 300, "open")] * 20 + [("s", "content", n, "closed") for n in range(200, 300)]
    words_ = [("s", "content", 4, "plain")] * 500
    assert rows(T.size_limits(spark.createDataFrame(cut + words_, schema)), "n_chars") == [(300,)]


@pytest.mark.parametrize("answer,defect", [
    (None, "empty"), ("", "empty"), (" \n", "empty"), ("—", "empty"), ("...", "empty"), ("N/A", "empty"), ("[no content]", "empty"), ("​", "empty"), ("42", None), ("`x_y`", None),
    ("I'm sorry, but I can't help with router buffers.", "refusal"), ("I see. Unfortunately, I'm unable to provide that information about queues. Feel free to ask again.", "refusal"), ("No puedo ayudarte con colas.", "refusal"), ("Je préfère ne pas parler de files.", "refusal"),
    ("Leider zu Warteschlangen darf ich keine Auskunft geben.", "refusal"), ("Я не могу помочь с темой очереди.", "refusal"), ("I can't reproduce this with 3 workers, but the buffer drains.", None), ("Unfortunately the queue stalls, and I could not avoid it.", None),
    (Q, "copy"), ("You asked: " + Q.upper(), "copy"), (Q + "\n" + Q, "copy"), (Q.replace("router", "lease"), "copy"), (Q + "\n\nThe first thing to look at is how many rows each of the other tables holds at night.", None),
    ("Die Warteschlange ist leer, weil der Puffer nicht mit den anderen läuft und die Daten bei uns nicht ankommen.", "other_language"), ("The buffer is drained when the queue of the other shard is full.", None), ("因为队列会影响缓存所以需要减慢。", "other_language"),
])
def test_pair_defects(answer, defect):
    assert P.pair_defect(Q, answer) == defect


def test_language_request_and_code():
    german = "Die Warteschlange ist leer, weil der Puffer nicht mit den anderen läuft und die Daten bei uns nicht ankommen."
    assert P.pair_defect("Reply in German only. " + Q, german) is None and P.pair_defect("Reply in French only. " + Q, german) == "other_language"
    assert P.pair_defect(Q, "```\nder die das und nicht\n```") is None and P.pair_defect(None, "The answer.") is None


def test_lcs_against_table():
    rng = random.Random(2)
    for _ in range(60):
        a, b = [rng.choice("abcd") for _ in range(rng.randint(0, 14))], [rng.choice("abcd") for _ in range(rng.randint(0, 14))]
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i in range(len(a)):
            for j in range(len(b)):
                t[i + 1][j + 1] = t[i][j] + 1 if a[i] == b[j] else max(t[i][j + 1], t[i + 1][j])
        assert lcs_length(a, b) == t[-1][-1]


def test_pairs_positions_repeats_and_nulls(spark, conversations):
    long = "The buffer is drained when the queue of the other shard is full. " * 3000
    data = [
        ("a", [message("system", "s"), message("user", Q), message("assistant", None), message("tool", "x"), message("assistant", "The queue is fine."), message("user", Q), message("assistant", "")]),
        ("b", [message("assistant", ""), message("user", Q)]), ("c", None), ("d", [None, message("user", None), message("assistant", "—")]), ("e", [message("user", long), message("assistant", long)]), ("f", [message("user", Q), message("assistant", "The queue of the router is dra")]),
    ]
    df = conversations(data + data[:1]).withColumn("defect", F.lit(1)).withColumn("user_pos", F.lit(1)).withColumn("role", F.lit("x"))
    assert rows(P.broken_pairs(df), "id", "user_pos", "defect") == [("a", 5, "empty"), ("d", 1, "empty"), ("e", 0, "copy"), ("f", 0, "truncated")]
    assert P.broken_pairs(conversations([])).count() == 0 and T.truncated_values(conversations([])).count() == 0


def test_copy_of_a_question_that_was_cut_later(conversations):
    whole = "Some background first. The ledger drains the anchor near the window of the other shard each night. " + Q
    df = conversations([("a", [message("user", whole[:70]), message("assistant", whole)]), ("b", [message("user", whole[:70]), message("assistant", whole[:70] + " as it is.\n\nThe first thing to look at is the table of the other shard.")])])
    assert rows(P.broken_pairs(df), "id", "defect") == [("a", "copy")]


def test_redelivery_is_no_evidence_for_a_word(conversations):
    data = [("a#1", [message("user", "why does the router drop the profi"), message("assistant", "The queue is fine.")]), ("a#2", [message("user", "why does the router drop the queue"), message("assistant", "The queue is fine.")])]
    for df in (conversations(data), conversations(data + data[:1]), conversations(data + data + data)):
        assert rows(T.truncated_values(df), "id", "msg_pos") == [("a#1", 0)]
        counts = T.value_ends(df).where("kind = 'w'").select("id", "word", "total").distinct()
        assert counts.where("word = 'profi'").count() == 1


def test_changed_or_wrapped_copy_of_a_question_that_was_cut_later(conversations):
    whole = "Some background first. The ledger drains the anchor near the window of the other shard each night. " + Q
    cut = whole[:82]
    given = {
        "wrapped": "You asked: " + whole, "changed": whole.replace("drains the anchor", "drains that anchor").replace("Some background", "Background some"), "both": 'Your question was: "' + whole.replace("near the", "near a") + '"',
        "answered": "You asked: " + cut + " each night.\n\nThe first thing to look at is the table of the other shard.", "other": "The ledger is drained at night because the other shard holds its window.", "asks back": "You asked about the ledger. It drains the anchor when the window is full. Does this help?",
    }
    df = conversations([(k, [message("user", cut), message("assistant", v)]) for k, v in given.items()] + [("whole", [message("user", Q), message("assistant", "You asked: " + Q + " It does, and the first thing to look at is the other shard. Is that all?")])])
    assert rows(P.broken_pairs(df), "id", "defect") == [("both", "copy"), ("changed", "copy"), ("wrapped", "copy")]


def test_pairs_judge_cuts_by_the_words_of_both_fields(conversations):
    said = "Items.\n\n- router window\n- shard buff"
    alone = [("a", [message("user", Q), message("assistant", said)])]
    known = alone + [("b", [message("user", Q), message("assistant", "The queue is fine.", "A buff is a buff, and the buff holds.")])]
    cut_thought = [("c", [message("user", Q), message("assistant", "The queue is fine.", "The queue of the router is dra")])]
    for data, want in ((alone, [("a", "truncated")]), (known, []), (cut_thought, [])):
        df = conversations(data)
        assert rows(P.broken_pairs(df), "id", "defect") == want
        assert rows(T.truncated_values(df).where("field = 'content'"), "id") == [(x[0],) for x in want]


@pytest.mark.parametrize("answer,defect", [
    ("As an AI language model, I cannot fulfill this request.", "refusal"), ("I cannot comply with this request.", "refusal"), ("I'm not comfortable providing that information.", "refusal"), ("我无法帮助您完成这个请求。", "refusal"), ("抱歉，答案是四十二。", "other_language"),
    ("I can't help with that. " + "Our safety policies do not allow it, and I understand that the topic matters to you. " * 40, "refusal"), ("I cannot share the log, but the buffer drains when the queue of the other shard is full at night.", None),
    ("I can't help with the log. " + "The buffer drains when the queue of the other shard is full at night. " * 4, None), ("-" * 300, "empty"), ("\u200b" * 5000, "empty"), ("- " * 400 + "7", None),
    ("Bufor jest opróżniany, gdy kolejka nie jest pełna, ale to nie jest problem, który się pojawia.", "other_language"), ("Bufferen tømmes når køen ikke er full, og det er ikke noe som skjer ved den andre.", "other_language"),
])
def test_answers_of_any_length_and_language(answer, defect):
    assert P.pair_defect(Q, answer) == defect


def test_copy_in_a_script_without_blanks():
    asked = "请问缓存队列为什么会在夜间变慢并且丢失数据？"
    assert P.pair_defect(asked, asked.replace("夜间", "夜晚")) == "copy" and P.pair_defect(asked, "因为缓存队列在夜间需要等待其他分片的数据，所以变慢。") is None


def test_open_tag_of_any_length_and_long_strings():
    assert T.end_state("Done. <a class=x" + "y" * 1000)[0] == "open" and T.end_state("why is x < y in the queue")[0] == "casual"
    counts = T.EndCounts()
    counts.add("数据" * 50 + "。 word " + "x" * 200 + ".")
    got = {r[9]: r[10:] for r in counts.rows()}
    assert got["数据" * 50] == (1, 1) and got["x" * 200] == (1, 1) and got["word"] == (1, 0) and not list(counts.rows())
