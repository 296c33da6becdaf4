"""Queries of answer extraction and scoring on generations made from the evaluation items; with DuckDB SQL.

The SQL computes the extraction from the generated text; it doesn't look at how the text was made."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrymill.functions import answers as A
from quarrymill.functions import python_scores as PS
from quarrymill.functions import text as X
from quarrymill.operators import metrics as M
from quarrymill.session import table

#: How the made generations state an item's label, by the item's number. The same in Spark SQL and DuckDB.
GENERATION = """CASE item_id % 7 WHEN 0 THEN '<think>first guess (Z)</think>The answer is (' || label || ').' WHEN 1 THEN 'We get \\boxed{' || label || '}' WHEN 2 THEN label
 WHEN 3 THEN 'Answer: ' || label || chr(10) || 'done' WHEN 4 THEN 'After 1,2 steps it is ' || label WHEN 5 THEN label || '. as computed' ELSE 'no idea' END"""
#: Responses in every format that ``ranked_choice`` ranks; some hold a wrong letter in a lower format.
RESPONSE = """CASE item_id % 10 WHEN 0 THEN 'A teddy bear (' || l || ') is shown' WHEN 1 THEN l || ' is wrong, (B)' WHEN 2 THEN 'so the best option is really ' || l || ' and not (C) here' WHEN 3 THEN 'maybe ' || l || '. or E: x' WHEN 4 THEN 'it must be ' || l || '!'
 WHEN 5 THEN 'we say ' || l || ': yes' WHEN 6 THEN '"' || l || ') first"' WHEN 7 THEN 'see x' || l || 'y' WHEN 8 THEN ' ' ELSE 'I pick ' || l || ' or F here' END"""
#: Short free answers against a target of numbers, percentages and words.
SAID = """CASE item_id % 8 WHEN 0 THEN t || '%' WHEN 1 THEN '$' || t || '.' WHEN 2 THEN 'The ' || t || ' of it' WHEN 3 THEN upper(t) WHEN 4 THEN '"' || t || '"' WHEN 5 THEN 'about ' || t || chr(10) || 'answer: ' || t || ' !' WHEN 6 THEN t || ', two' ELSE 'Three' END"""
TARGET = "CASE item_id % 3 WHEN 0 THEN CAST(item_id % 41 AS VARCHAR(9)) WHEN 1 THEN 'yes' ELSE coalesce(category, 'two') END"


def _sql(expression: str):
    return F.expr(expression.replace("\\boxed", "\\\\boxed").replace("VARCHAR(9)", "STRING"))


def generations(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "eval_items").select("item_id", "benchmark", "category", "text", "label", _sql(GENERATION).alias("generation"))


def answer_choices(spark: SparkSession, d: str) -> DataFrame:
    """Letters of the items that are answered by a letter."""
    return generations(spark, d).where("label RLIKE '^[A-D]$'").select("item_id", A.choice(F.col("generation")).alias("prediction"), A.first_letter(F.col("label")).alias("label"))


def ranked_choices(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "eval_items").withColumn("l", F.expr("substring('ABCDEFGH', cast(item_id % 8 + 1 as int), 1)"))
    return e.select("item_id", A.ranked_choice(_sql(RESPONSE)).alias("prediction"))


def maths_answers(spark: SparkSession, d: str) -> DataFrame:
    p = A.maths_answer(F.col("generation"))
    return generations(spark, d).select("item_id", p.alias("prediction"), A.maths_equal(p, F.col("label")).alias("hit"))


def contest_answers(spark: SparkSession, d: str) -> DataFrame:
    return generations(spark, d).select("item_id", A.competition_integer(F.col("generation")).alias("prediction"))


def word_problem_answers(spark: SparkSession, d: str) -> DataFrame:
    return generations(spark, d).select("item_id", A.last_integer(F.col("generation")).alias("prediction"))


def marked_answers(spark: SparkSession, d: str) -> DataFrame:
    return generations(spark, d).select("item_id", A.after_mark(F.col("generation")).alias("prediction"))


def boxed_answers(spark: SparkSession, d: str) -> DataFrame:
    return generations(spark, d).select("item_id", A.boxed(F.col("generation")).alias("prediction"))


def accuracy_by_benchmark(spark: SparkSession, d: str) -> DataFrame:
    g = generations(spark, d)
    _, number = A.scored("maths", F.col("generation"), F.col("label"))
    _, letter = A.scored("choice", F.col("generation"), F.col("label"))
    hit = F.when(F.col("label").rlike("^[A-D]$"), letter).otherwise(number)
    return M.grouped_accuracy(g.where("label IS NOT NULL").withColumn("hit", hit), "benchmark", "hit")


def category_accuracy(spark: SparkSession, d: str) -> DataFrame:
    """Accuracy by category with its share of the run: latency of the whole run over all answers."""
    g = generations(spark, d).where("label IS NOT NULL")
    hit = A.maths_equal(A.maths_answer(F.col("generation")), F.col("label"))
    return M.share_of_run(g.withColumn("hit", hit), "category", "hit", 250.0)


def option_lists(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "eval_items").select("item_id", A.options_of(F.col("text")).alias("options"))
    return e.select("item_id", F.coalesce(F.size("options"), F.lit(0)).alias("n_options"), F.get("options", 0).alias("first_option"))


def option_answers(spark: SparkSession, d: str) -> DataFrame:
    """The last standalone letter among an item's options, and the only option whose text the answer holds."""
    o = A.options_of(F.col("text"))
    said = F.when(F.col("item_id") % 2 == 0, F.concat(F.lit("It is "), F.get(o, (F.col("item_id") % 3).cast("int")), F.lit(" I think"))).otherwise(F.concat(F.lit("A or B, then E, so the answer is: "), F.expr("substring('ABCDE', cast(item_id % 5 + 1 as int), 1)"), F.lit("."))) 
    e = table(spark, d, "eval_items").select("item_id", o.alias("o"), said.alias("said")).where("o IS NOT NULL")
    return e.select("item_id", A.last_option(F.col("said"), F.size("o")).alias("letter"), A.only_contained(F.col("said"), F.col("o")).alias("held"))


def relaxed_matches(spark: SparkSession, d: str) -> DataFrame:
    """Quantities stated with rounding, percent signs and words against their exact values."""
    r = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").cast("int").alias("q"))
    said = F.when(F.col("q") % 4 == 0, F.concat(F.col("q").cast("string"), F.lit("%"))).when(F.col("q") % 4 == 1, F.concat((F.col("q") + 1).cast("string"), F.lit(" ."))).when(F.col("q") % 4 == 2, F.concat(F.lit("$"), F.col("q").cast("string"))).otherwise("unknown")
    return r.groupBy("q").agg(F.count("*").alias("n"), F.max(A.relaxed_match(said, F.col("q").cast("string"))).alias("score"))


def _said(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "eval_items").select("item_id", "text", "label", _sql(TARGET).alias("t")).withColumn("said", _sql(SAID))


def stated_answers(spark: SparkSession, d: str) -> DataFrame:
    """The stated answer, whether it is the target as it stands, and whether the response ends with the target."""
    p = A.stated_answer(F.col("said"))
    return _said(spark, d).select("item_id", p.alias("prediction"), (F.lower(p) == F.lower("t")).alias("exact"), A.ends_with_answer(F.col("said"), F.col("t")).alias("at_end"))


def reference_matches(spark: SparkSession, d: str) -> DataFrame:
    """References found in a text: on word boundaries, in normalised form without spaces, as sets of terms."""
    s = _said(spark, d)
    low = F.lower("said")
    return s.select("item_id", A.holds_reference(low, F.lower("t")).alias("held"), A.holds_any(F.col("said"), F.array("t", F.lit("ｔｈｒｅｅ")), F.col("item_id") % 2 == 0).alias("any_held"), (A.terms(F.col("said")) == A.terms(F.concat(F.lit("two, "), "t"))).alias("same_terms"))


def open_scores(spark: SparkSession, d: str) -> DataFrame:
    """Scores of open answers: by value and short text, leniently, and by votes of other answers."""
    s = _said(spark, d)
    numeric = F.col("t").rlike("^[0-9]+$")
    votes = F.array(F.col("t"), F.concat(F.lit("the "), "t"), F.lit("3"), F.lit("Two."))
    return s.select(
        "item_id", A.short_text(F.col("said")).alias("short"), A.parsed_number(F.col("said")).alias("number"), A.reasoning_score(F.col("said"), F.col("t"), numeric).alias("reasoned"), A.lenient_score(F.col("said"), F.col("t")).alias("lenient"),
        A.vote_text(F.col("said")).alias("vote"), F.round(A.vote_score(F.col("said"), votes), 6).alias("vote_score"),
    )


def code_blocks(spark: SparkSession, d: str) -> DataFrame:
    """Code taken out of answers: fenced, bare functions, or the text itself."""
    body = F.concat(F.lit("def f(x):\n    return "), F.col("item_id").cast("string"))
    said = F.when(F.col("item_id") % 4 == 0, F.concat(F.lit("So:\n```python\n"), body, F.lit("\n```\nand ```x```"))).when(F.col("item_id") % 4 == 1, F.concat(F.lit("Use\n"), body, F.lit("\n\ndef g():\n    pass"))).when(F.col("item_id") % 4 == 2, F.concat(F.lit("  "), F.col("label"), F.lit(" \n"))).otherwise(" \n")
    return table(spark, d, "eval_items").select("item_id", A.code_block(said).alias("code"))


def captions(spark: SparkSession, d: str) -> DataFrame:
    text, score = A.caption(F.concat(F.lit("<think>hm</think> "), F.coalesce("label", F.lit("")), F.when(F.col("item_id") % 2 == 0, F.lit(" <think>cut off")).otherwise(F.lit(""))))
    return table(spark, d, "eval_items").select("item_id", text.alias("caption"), score.alias("score"))


def maths_equality(spark: SparkSession, d: str) -> DataFrame:
    """Mathematical answers that are written differently: fractions, units, percentages, tuples and LaTeX."""
    k = F.col("item_id") % 40 + 1
    given = F.when(k % 5 == 0, F.concat(F.lit("\\frac{"), k.cast("string"), F.lit("}{4}"))).when(k % 5 == 1, F.concat(F.lit("$"), k.cast("string"), F.lit("\\text{ cm}$"))).when(k % 5 == 2, F.concat(F.lit("("), k.cast("string"), F.lit(", 2)"))).when(k % 5 == 3, F.concat(F.lit("x = "), k.cast("string"), F.lit(".0"))).otherwise(k.cast("string"))
    want = F.when(k % 5 == 0, (k / 4).cast("string")).when(k % 5 == 2, F.concat(F.lit("("), k.cast("string"), F.lit(",2.0)"))).when(k % 10 == 4, (k + 1).cast("string")).otherwise(k.cast("string"))
    return table(spark, d, "eval_items").select("item_id", PS.same_maths(given, want).alias("equal"))


def nearest_options(spark: SparkSession, d: str) -> DataFrame:
    """The option that a slightly changed option text is most like."""
    o = A.options_of(F.col("text"))
    e = table(spark, d, "eval_items").select("item_id", o.alias("o")).where("o IS NOT NULL").withColumn("want", F.get("o", (F.col("item_id") % F.size("o")).cast("int")))
    return e.select("item_id", PS.nearest_option(F.concat(F.lit("the "), F.upper("want")), F.col("o")).alias("nearest"))


def prompt_wrappers(spark: SparkSession, d: str) -> DataFrame:
    wrapped = F.concat(F.when(F.col("item_id") % 2 == 0, "Question: ").otherwise(""), F.col("label"), F.when(F.col("item_id") % 3 == 0, " Answer briefly.").otherwise(""))
    return table(spark, d, "eval_items").select("item_id", A.strip_wrapper(wrapped, ["Question: "], [" Answer briefly."]).alias("bare"))


QUERIES = {
    f.__name__: f
    for f in (
        answer_choices, ranked_choices, maths_answers, contest_answers, word_problem_answers, marked_answers, boxed_answers, accuracy_by_benchmark, category_accuracy, option_lists, option_answers, relaxed_matches, stated_answers, reference_matches,
        open_scores, code_blocks, captions, maths_equality, nearest_options, prompt_wrappers,
    )
}

# --- SQL -------------------------------------------------------------------------------------------------------------


def _all(t: str, p: str) -> str:
    return f"list_last(regexp_extract_all({t}, '{p}', 1, 'i'))"


def _one(t: str, p: str) -> str:
    return f"nullif(regexp_extract({t}, '{p}', 1, 'i'), '')"


_G = f"g AS (SELECT item_id, benchmark, category, label, text, {GENERATION} AS t FROM eval_items)"
_BARE = "trim(regexp_replace(list_last(string_split(t, '</think>')), '(?is)<think>.*', ''))"
# the last token that is a single capital letter A-D and isn't followed by a blank and a small letter
_LONE = "list_last(list_filter(list_transform(range(1, len(k) + 1), lambda i: CASE WHEN regexp_matches(k[i], '^[A-D]$') AND NOT coalesce(regexp_matches(k[i + 1], '^\\s+$') AND regexp_matches(k[i + 2], '^[a-z]'), false) THEN k[i] END), lambda x: x IS NOT NULL))"
_CHOICE = f"""b AS (SELECT *, {_BARE} AS s, regexp_extract_all({_BARE}, '[A-Za-z0-9_]+|\\s+|[^A-Za-z0-9_\\s]') AS k FROM g),
c AS (SELECT *, upper(coalesce({_one('s', '^\\**\\(?([A-D])\\)?\\**\\s*[.):,]?$')}, {_all('s', '\\\\boxed\\{\\s*\\(?([A-D])\\)?\\s*\\}')}, {_all('s', '(?:answer|option|choice)\\s*(?:is|:|：)?\\s*\\**\\(?([A-D])\\)?\\b')},
 {_all('s', '(?:^|\\n)\\s*\\**\\(?([A-D])\\)?\\**\\s*[.):,]')}, {_LONE})) AS chosen FROM b)"""
_MATHS = f"trim(coalesce({_one('t', '\\\\boxed\\{([^}]+)\\}')}, {_one('t', '\\\\boxed\\s+([^\\s]+)')}, {_all('t', 'answer[\\s:]+([-+]?\\d*\\.?\\d+)')}, {_all('t', '(?:is|equals?|=\\s*)([-+]?\\d*\\.?\\d+)\\s*$')}, {_all('t', '([-+]?\\d*\\.?\\d+)')}))"
_BOX = _one("t", "\\\\boxed\\{([^}]+)\\}")
_EQUAL = "coalesce(lower(trim({0})) = lower(trim({1})) OR abs(TRY_CAST(trim({0}) AS DOUBLE) - TRY_CAST(trim({1}) AS DOUBLE)) < 1e-6, lower(trim({0})) = lower(trim({1})), false)"
_RFIND = "(length(x) - strpos(reverse(x), reverse({0})) - length({0}) + 1)"
_PHRASES = "[" + ", ".join(f"'{p}'" for p in A.ANSWER_PHRASES) + "]"
_S = f"s AS (SELECT *, {SAID} AS said FROM (SELECT item_id, text, label, {TARGET} AS t FROM eval_items))"
_SHORT = "lower(trim(regexp_replace(regexp_replace(regexp_replace(trim(regexp_replace(trim(regexp_replace({0}, '[*`]', '', 'g')), '^[\"'']+|[\"'']+$', '', 'g')), '^\\(\\s*([A-Za-z])\\s*\\)$', '\\1'), '\\s+', ' ', 'g'), '[.!?;:]+$', '')))"
_TERMS = "list_sort(list_distinct(list_filter(list_transform(string_split({0}, ','), lambda x: " + _SHORT.format("x") + "), lambda x: x <> '')))"
_NUMBER = "TRY_CAST(replace(nullif(regexp_extract(regexp_replace({0}, '[$\\\\]', '', 'g'), '([-+]?(?:\\d{{1,3}}(?:,\\d{{3}})+|\\d+)(?:\\.\\d+)?(?:[eE][-+]?\\d+)?|[-+]?\\.\\d+)', 1), ''), ',', '') AS DOUBLE)"
_DIGITS = "CASE {0} WHEN 'none' THEN '0' WHEN 'zero' THEN '0' WHEN 'one' THEN '1' WHEN 'two' THEN '2' WHEN 'three' THEN '3' WHEN 'four' THEN '4' WHEN 'five' THEN '5' WHEN 'six' THEN '6' WHEN 'seven' THEN '7' WHEN 'eight' THEN '8' WHEN 'nine' THEN '9' WHEN 'ten' THEN '10' ELSE {0} END"
_HOLDS = "(regexp_matches({0}, '(^|[^a-zA-Z0-9_])' || regexp_escape({1}) || '($|[^a-zA-Z0-9_])') AND {1} <> '')"
_VOTE = "array_to_string(list_transform(list_filter(regexp_split_to_array(regexp_replace(regexp_replace(lower(trim(regexp_replace({0}, '[\\n\\t]', ' ', 'g'))), '(^|[^0-9])\\.', '\\1', 'g'), '[;/\\[\\]\"{{}}()=+\\\\_\\-><@`,?!]', '', 'g'), '\\s+'), lambda w: w <> '' AND w NOT IN ('a', 'an', 'the')), lambda w: " + _DIGITS.format("w") + "), ' ')"
_OPTIONS = "regexp_extract_all(text, '(?m)^\\(?([A-J])[.):]\\)?\\s+(.+)$', {0})"
_O = f"o AS (SELECT item_id, {_OPTIONS.format(1)} AS l, {_OPTIONS.format(2)} AS x FROM eval_items), q AS (SELECT item_id, x AS o FROM o WHERE len(l) >= 2 AND l = string_split('ABCDEFGHIJ', '')[1:len(l)])"

SQL = {
    "answer_choices": f"WITH {_G}, {_CHOICE} SELECT item_id, chosen AS prediction, label FROM c WHERE regexp_matches(label, '^[A-D]$')",
    "ranked_choices": f"""
WITH r AS (SELECT item_id, {RESPONSE} AS t FROM (SELECT *, substring('ABCDEFGH', CAST(item_id % 8 + 1 AS INTEGER), 1) AS l FROM eval_items)),
p AS (SELECT item_id, ' ' || trim(trim(trim(trim(trim(trim(trim(trim(trim(t), ','), '.'), '!'), '?'), ';'), ':'), ''''), '"') || ' ' AS x FROM r WHERE trim(t) <> ''),
c AS (SELECT item_id, x, trim(x) AS s, lower(x) AS low, unnest(string_split('ABCDEFGH', '')) AS c FROM p),
f AS (SELECT item_id, c, unnest([
 CASE WHEN contains(x, '(' || c || ')') THEN {{'r': 6, 'p': {_RFIND.format("('(' || c || ')')")}}} END, CASE WHEN contains(x, c || '.') THEN {{'r': 5, 'p': {_RFIND.format("(c || '.')")}}} END, CASE WHEN contains(x, c || ':') THEN {{'r': 4, 'p': {_RFIND.format("(c || ':')")}}} END,
 CASE WHEN contains(x, c || ')') THEN {{'r': 3, 'p': {_RFIND.format("(c || ')')")}}} END, CASE WHEN contains(x, c || ' ') THEN {{'r': 2, 'p': {_RFIND.format("(c || ' ')")}}} END,
 CASE WHEN regexp_matches(s, '^' || c || '([^\\p{{L}}]|$)') THEN {{'r': 10, 'p': 0}} END, CASE WHEN regexp_matches(s, '(^|[^\\p{{L}}])' || c || '$') THEN {{'r': 9, 'p': length(x) - 1}} END, CASE WHEN contains(x, c) THEN {{'r': 0, 'p': {_RFIND.format('c')}}} END,
 (SELECT max({{'r': 7, 'p': strpos(low, ph) + length(ph) - 2 + strpos(substring(x, CAST(strpos(low, ph) + length(ph) AS BIGINT)), c)}}) FROM (SELECT unnest({_PHRASES}) AS ph) WHERE strpos(low, ph) > 0 AND strpos(substring(x, CAST(strpos(low, ph) + length(ph) AS BIGINT)), c) > 0)]) AS h FROM c),
b AS (SELECT item_id, c, row_number() OVER (PARTITION BY item_id ORDER BY h.r DESC, h.p DESC) AS k FROM f WHERE h IS NOT NULL)
SELECT e.item_id AS item_id, b.c AS prediction FROM eval_items e LEFT JOIN b ON b.item_id = e.item_id AND b.k = 1
""",
    "maths_answers": f"WITH {_G}, p AS (SELECT item_id, label, {_MATHS} AS p FROM g) SELECT item_id, p AS prediction, {_EQUAL.format('p', 'label')} AS hit FROM p",
    "contest_answers": f"""
WITH {_G} SELECT item_id, coalesce(CASE WHEN {_BOX} IS NOT NULL THEN coalesce(list_last(regexp_extract_all({_BOX}, '(\\d+)', 1)), trim({_BOX})) END, {_one('t', '\\\\boxed\\s+(\\d+)')}, {_all('t', 'answer[\\s:]+(\\d+)')}, {_all('t', 'final\\s+answer[\\s:]+(\\d+)')}, {_all('t', '(?:is|equals?|=\\s*)(\\d+)\\s*$')},
 list_last(list_filter(regexp_extract_all(t, '\\b(\\d+)\\b', 1), lambda n: length(ltrim(n, '0')) <= 3))) AS prediction FROM g
""",
    "word_problem_answers": f"WITH {_G} SELECT item_id, list_last(regexp_extract_all(replace(t, ',', ''), '[0-9]+')) AS prediction FROM g",
    "marked_answers": f"WITH {_G} SELECT item_id, CASE WHEN contains(t, 'Answer: ') THEN trim(split_part(t, 'Answer: ', 2)) END AS prediction FROM g",
    "boxed_answers": f"WITH {_G} SELECT item_id, CASE WHEN contains(t, 'oxed{{') THEN nullif(trim(split_part(list_last(string_split(t, 'oxed{{')), '}}', 1)), '') END AS prediction FROM g",
    "accuracy_by_benchmark": f"""
WITH {_G}, {_CHOICE}, h AS (SELECT benchmark, CASE WHEN regexp_matches(label, '^[A-D]$') THEN coalesce(chosen = upper(trim(label)), false) ELSE {_EQUAL.format(_MATHS, 'label')} END AS hit FROM c WHERE label IS NOT NULL),
s AS (SELECT benchmark, count(*) AS n, CAST(sum(hit::INT) AS BIGINT) AS hits FROM h GROUP BY 1)
SELECT benchmark, n, hits, round(hits / n, 6) AS accuracy FROM s UNION ALL SELECT '*micro*', CAST(sum(n) AS BIGINT), CAST(sum(hits) AS BIGINT), round(sum(hits) / sum(n), 6) FROM s UNION ALL SELECT '*macro*', CAST(sum(n) AS BIGINT), CAST(sum(hits) AS BIGINT), round(avg(hits / n), 6) FROM s
""",
    "category_accuracy": f"""
WITH {_G}, h AS (SELECT coalesce(category, '') AS category, {_EQUAL.format(_MATHS, 'label')}::INT AS hit FROM g WHERE label IS NOT NULL)
SELECT category, count(*) AS n, CAST(sum(hit) AS BIGINT) AS hits, round(avg(hit), 6) AS accuracy, round(count(*) / 250.0::DOUBLE, 6) AS answers_per_second, round(count(*) / (SELECT count(*) FROM h)::DOUBLE, 6) AS share FROM h GROUP BY category
""",
    "option_lists": f"WITH {_O} SELECT e.item_id AS item_id, CAST(coalesce(len(o), 0) AS INTEGER) AS n_options, q.o[1] AS first_option FROM eval_items e LEFT JOIN q USING (item_id)",
    "option_answers": f"""
WITH {_O}, s AS (SELECT item_id, o, CASE WHEN item_id % 2 = 0 THEN 'It is ' || o[item_id % 3 + 1] || ' I think' ELSE 'A or B, then E, so the answer is: ' || substring('ABCDE', CAST(item_id % 5 + 1 AS INTEGER), 1) || '.' END AS said FROM q),
k AS (SELECT *, list_filter(regexp_extract_all(regexp_replace(said, '(?i)(?:the )?(?:best |correct )?(?:answer|option) is:?', '', 'g'), '[A-Za-z]+'), lambda w: length(w) = 1 AND upper(w) = w AND ascii(w) - 64 <= len(o)) AS l, list_filter(range(1, len(o) + 1), lambda i: o[i] <> '' AND contains(lower(said), lower(o[i]))) AS h FROM s)
SELECT item_id, list_last(l) AS letter, CASE WHEN len(h) = 1 THEN substring('ABCDEFGHIJ', h[1], 1) END AS held FROM k
""",
    "relaxed_matches": """
WITH r AS (SELECT CAST(l_quantity AS INTEGER) AS q FROM lineitem), s AS (SELECT q, count(*) AS n, CASE q % 4 WHEN 0 THEN q || '%' WHEN 1 THEN (q + 1) || ' .' WHEN 2 THEN '$' || q ELSE 'unknown' END AS said FROM r GROUP BY q),
c AS (SELECT q, n, regexp_replace(regexp_replace(said, '[\\s.,;:!?]+$', ''), '[,$]', '', 'g') AS p FROM s), v AS (SELECT *, TRY_CAST(rtrim(p, '%') AS DOUBLE) AS x, ends_with(p, '%') AS pct FROM c)
SELECT q, n, CASE WHEN x IS NULL THEN (lower(p) = CAST(q AS VARCHAR))::INT::DOUBLE ELSE (abs(x - q) / q <= 0.05 OR pct AND (abs(x / 100 - q) / q <= 0.05))::INT::DOUBLE END AS score FROM v
""",
    "stated_answers": f"""
WITH {_S}, p AS (SELECT *, trim(coalesce(list_last(regexp_extract_all(said, '(?im)answer\\s*[:：]\\s*(.*)$', 1)), list_last(list_filter(string_split(said, chr(10)), lambda x: trim(x) <> '')))) AS p FROM s)
SELECT item_id, p AS prediction, lower(p) = lower(t) AS exact, ends_with(lower(regexp_replace(trim(said), '[\\s[:punct:]]+$', '')), lower(regexp_replace(trim(t), '[\\s[:punct:]]+$', ''))) AS at_end FROM p
""",
    "reference_matches": f"""
WITH {_S} SELECT item_id, {_HOLDS.format('lower(said)', 'lower(t)')} AS held,
 CAST(CASE WHEN item_id % 2 = 0 THEN contains(regexp_replace(said, '[ \\n]', '', 'g'), regexp_replace(trim(t), '[ \\n]', '', 'g')) OR contains(said, 'ｔｈｒｅｅ') ELSE contains(replace(trim(lower(said)), chr(10), ' '), lower(t)) OR contains(lower(said), 'three') END AS INTEGER) AS any_held,
 {_TERMS.format('said')} = {_TERMS.format("'two, ' || t")} AS same_terms FROM s
""",
    "open_scores": f"""
WITH {_S}, k AS (SELECT *, {_SHORT.format('said')} AS short, {_NUMBER.format('said')} AS number, {_NUMBER.format('t')} AS want, {_VOTE.format('said')} AS vote, lower(trim(t)) AS ref, rtrim(lower(trim(said)), '.') AS opened, list_transform([t, 'the ' || t, '3', 'Two.'], lambda r: {_VOTE.format('r')}) AS refs FROM s)
SELECT item_id, short, number, CASE WHEN trim(said) = '' THEN 0.0::DOUBLE WHEN regexp_matches(t, '^[0-9]+$') AND number IS NOT NULL AND want IS NOT NULL THEN (abs(number - want) <= greatest(1e-6 * greatest(abs(number), abs(want)), 1e-9))::INT::DOUBLE
 ELSE ({_SHORT.format('t')} <> '' AND (short = {_SHORT.format('t')} OR len({_TERMS.format('t')}) > 1 AND {_TERMS.format('said')} = {_TERMS.format('t')} OR {_SHORT.format('t')} IN ('yes', 'no') AND starts_with(short, {_SHORT.format('t')})))::INT::DOUBLE END AS reasoned,
 (opened = ref OR {_DIGITS.format('opened')} = {_DIGITS.format('ref')} OR {_HOLDS.format('opened', 'ref')})::INT::DOUBLE AS lenient, vote,
 round(list_sum(list_transform(refs, lambda r: least(1.0::DOUBLE, (len(list_filter(refs, lambda z: z = vote)) - (r = vote)::INT) / 3.0::DOUBLE))) / 4, 6) AS vote_score FROM k
""",
    "code_blocks": """
WITH s AS (SELECT item_id, CASE item_id % 4 WHEN 0 THEN 'So:' || chr(10) || '```python' || chr(10) || b || chr(10) || '```' || chr(10) || 'and ```x```' WHEN 1 THEN 'Use' || chr(10) || b || chr(10) || chr(10) || 'def g():' || chr(10) || '    pass' WHEN 2 THEN '  ' || label || ' ' || chr(10) ELSE ' ' || chr(10) END AS said
 FROM (SELECT *, 'def f(x):' || chr(10) || '    return ' || item_id AS b FROM eval_items))
SELECT item_id, nullif(trim(coalesce(nullif(regexp_extract(said, '(?s)```(?:python)?\\n(.*?)```', 1), ''), nullif(regexp_extract(string_split(said, chr(10) || chr(10) || 'def ')[1], '(?s)(def\\s+\\w+\\([^)]*\\):.*)$', 1), ''), said), ' ' || chr(10) || chr(9) || chr(13)), '') AS code FROM s
""",
    "captions": """
WITH s AS (SELECT item_id, '<think>hm</think> ' || coalesce(label, '') || CASE WHEN item_id % 2 = 0 THEN ' <think>cut off' ELSE '' END AS said FROM eval_items)
SELECT item_id, trim(regexp_replace(list_last(string_split(said, '</think>')), '(?is)<think>.*', '')) AS caption, CAST(NULL AS DOUBLE) AS score FROM s
""",
    "maths_equality": "SELECT item_id, (item_id % 40 + 1) % 10 <> 4 AS equal FROM eval_items",
    "nearest_options": f"WITH {_O} SELECT item_id, o[item_id % len(o) + 1] AS nearest FROM q",
    "prompt_wrappers": """
WITH w AS (SELECT item_id, CASE WHEN item_id % 2 = 0 THEN 'Question: ' ELSE '' END || label || CASE WHEN item_id % 3 = 0 THEN ' Answer briefly.' ELSE '' END AS w FROM eval_items)
SELECT item_id, regexp_replace(regexp_replace(w, '^Question: ', ''), ' Answer briefly\\.$', '') AS bare FROM w
""",
}
