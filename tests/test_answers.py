"""Answer extraction and scoring on single texts."""

import pytest
from pyspark.sql import functions as F

from quarrymill.functions import answers as A
from quarrymill.plans import answer_queries


def one(spark, f, *values):
    return spark.range(1).select(f(*[F.lit(v) for v in values])).first()[0]


@pytest.mark.parametrize("f,text,want", [
    (A.boxed, r"so \boxed{\frac{1}{2}} ok", r"\frac{1}{2}"), (A.boxed, r"\boxed{1} then \boxed{2", "2"), (A.boxed, "none", None), (A.boxed, r"\boxed{}", None),
    (A.choice, "C", "C"), (A.choice, "(b).", "B"), (A.choice, "C is wrong, the answer is B", "B"), (A.choice, "A teddy bear is shown", None), (A.choice, "<think>D</think> answer: A", "A"), (A.choice, r"thus \boxed{D}", "D"), (A.choice, "B. a bird", "B"), (A.choice, "maybe C", "C"), (A.choice, "", None),
    (A.ranked_choice, "The answer is B", "B"), (A.ranked_choice, "(A) or (C)", "C"), (A.ranked_choice, "D", "D"), (A.ranked_choice, " ", None),
    (A.competition_integer, r"\boxed{x = 42}", "42"), (A.competition_integer, "Answer: 7", "7"), (A.competition_integer, "in 2024 we get 31 apples", "31"), (A.competition_integer, "no", None),
    (A.maths_answer, r"\boxed{ 3.5 }", "3.5"), (A.maths_answer, "the answer is -2.5", "-2.5"), (A.maths_answer, "x", None), (A.last_integer, "1,200 then 3,400", "3400"), (A.first_letter, "i say (b) or c", "B"), (A.after_mark, "x Answer: 5", "5"), (A.after_mark, "x", None),
    (A.code_block, "```python\nx = 1\n```", "x = 1"), (A.code_block, "def f(x):\n    return x", "def f(x):\n    return x"), (A.code_block, " ", None), (A.parsed_number, "about $1,500", 1500.0), (A.parsed_number, "10^-2", 0.01), (A.parsed_number, "none", None),
    (A.short_text, '**"(b)"**', "b"), (A.vote_text, "The  two, Nokia.", "2 nokia"),
])
def test_extraction(spark, f, text, want):
    got = one(spark, f, text)
    assert got == want if not isinstance(want, float) else abs(got - want) < 1e-12


@pytest.mark.parametrize("p,t,want", [("95", "100", 1.0), ("94", "100", 0.0), ("$1,000.", "1000", 1.0), ("50%", "0.5", 1.0), ("blue", "Blue", 1.0), ("Blue.", "blue", 1.0), ("A) yes", "a", 1.0), ("x", "yy", 0.0)])
def test_relaxed(spark, p, t, want):
    assert one(spark, A.relaxed_match, p, t) == want


def test_comparisons(spark):
    assert one(spark, A.maths_equal, "0.50", "1/2") is False and one(spark, A.maths_equal, "0.50", "0.5") is True and one(spark, A.maths_equal, None, "1") is False
    assert one(spark, A.holds_reference, "a 35 b", "3") is False and one(spark, A.holds_reference, "a 3 b", "3") is True and one(spark, A.holds_reference, "这是湖", "湖") is True and one(spark, A.holds_reference, "x", "") is False
    assert one(spark, A.lenient_score, "there are three of them", "three") == 1.0 and one(spark, A.lenient_score, r"\boxed{Two}", "2") == 1.0 and one(spark, A.lenient_score, "the answer is C", "c") == 1.0
    got = spark.range(1).select(
        A.vote_score(F.lit("cat"), F.array(*[F.lit(x) for x in ("cat", "cat", "cat", "dog")])), A.only_contained(F.lit("a red bird"), F.array(F.lit("bird"), F.lit("fish"))), A.only_contained(F.lit("bird fish"), F.array(F.lit("bird"), F.lit("fish"))),
        A.last_option(F.lit("The answer is B or C"), F.lit(2)), A.holds_any(F.lit("ＡＢＣ x"), F.array(F.lit("abc")), F.lit(False)), A.reasoning_score(F.lit("b, a"), F.lit("a, b"), F.lit(False)), A.reasoning_score(F.lit("1,500"), F.lit("1.5e3"), F.lit(True)),
    ).first()
    assert abs(got[0] - (3 * (2 / 3) + 1.0) / 4) < 1e-9 and got[1] == "A" and got[2] is None and got[3] == "B" and got[4] == 1 and got[5] == 1.0 and got[6] == 1.0


def test_registry(spark):
    p, hit = A.scored("choice", F.lit("(A)"), F.lit("a"))
    assert spark.range(1).select(p, hit).first() == ("A", True)
    p, hit = A.scored("maths", F.lit("x"), F.lit(None).cast("string"))
    assert tuple(spark.range(1).select(p, hit).first()) == (None, None)


def test_options(spark):
    assert one(spark, A.options_of, "Q?\nA. one\nB. two") == ["one", "two"] and one(spark, A.options_of, "Q?\nB. two\nA. one") is None
    assert spark.range(1).select(A.strip_wrapper(F.lit("<q>x</q>"), ["<q>"], ["</q>"])).first()[0] == "x"


def test_every_item_is_answered_and_scored(spark, tmp_path):
    """Against the made forms, one by one: all state the label but for 'no idea'. No item may be left out."""
    labels = ["A", "B", "17", None, "C", "204", "D", "B", "A", "5"] * 7
    items = [(i, f"bench{i % 3}", None, "Q", x) for i, x in enumerate(labels)]
    spark.createDataFrame(items, "item_id BIGINT, benchmark STRING, category STRING, text STRING, label STRING").write.parquet(f"{tmp_path}/eval_items.parquet")
    want = {i: None if i % 7 == 6 else x for i, _, _, _, x in items if x in ("A", "B", "C", "D")}
    assert {r.item_id: r.prediction for r in answer_queries.answer_choices(spark, str(tmp_path)).collect()} == want
    got = {r.benchmark: (r.n, r.hits) for r in answer_queries.accuracy_by_benchmark(spark, str(tmp_path)).collect()}
    for k in range(3):
        mine = [i for i, b, _, _, x in items if b == f"bench{k}" and x is not None]
        assert got[f"bench{k}"] == (len(mine), sum(i % 7 != 6 for i in mine))
    assert got["*micro*"] == (63, sum(i % 7 != 6 for i, _, _, _, x in items if x is not None))
