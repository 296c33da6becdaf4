"""Queries of this subpackage: name -> callable(spark, directory), and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrymill.llm import leakage, mixing, neardup, pairs, quality, truncation
from quarrymill.session import table


def _conversations(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "tool_use_conversation")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return pairs.broken_pairs(_conversations(spark, d))


def p1_defects(spark: SparkSession, d: str) -> DataFrame:
    return pairs.broken_pairs(_conversations(spark, d)).groupBy("defect").agg(F.count("*").alias("n_pairs"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return truncation.truncated_values(_conversations(spark, d)).select("id", "msg_pos", "field")


def p3_sources(spark: SparkSession, d: str) -> DataFrame:
    return truncation.truncation_report(_conversations(spark, d))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return neardup.alike_pairs(_conversations(spark, d))


def p4_groups(spark: SparkSession, d: str) -> DataFrame:
    return neardup.groups(_conversations(spark, d))


def p4_weighted(spark: SparkSession, d: str) -> DataFrame:
    """Pairs by similarity of multisets: a run of words counts as often as it occurs."""
    return neardup.alike_pairs(_conversations(spark, d), weights="counts")


def _leaks(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leaked_items(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return _leaks(spark, d).select("doc_id", "item_id").distinct()


def p5_items(spark: SparkSession, d: str) -> DataFrame:
    return _leaks(spark, d).groupBy("item_id").agg(F.count("*").alias("n_docs"), F.max("containment").alias("most_contained"))


def p6_mix(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mixed_with_shares(table(spark, d, "documents"), table(spark, d, "mix_targets"))


def p6_shares(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix_report(table(spark, d, "documents"), table(spark, d, "mix_targets"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return quality.document_quality(table(spark, d, "documents")).where("kind IS NOT NULL").select("doc_id", "kind")


def p7_measures(spark: SparkSession, d: str) -> DataFrame:
    return quality.document_quality(table(spark, d, "documents"))


def p7_words(spark: SparkSession, d: str) -> DataFrame:
    """The measures of wording that SQL can express."""
    return quality.document_quality(table(spark, d, "documents")).select("doc_id", "n_words", "mean_word_length", "punctuated_lines")


QUERIES = {f.__name__: f for f in (p1_found, p1_defects, p3_found, p3_sources, p4_found, p4_groups, p4_weighted, p5_found, p5_items, p6_mix, p6_shares, p7_found, p7_measures, p7_words)}

_WORDS = r"""c AS (SELECT id, arg_min(conversations, ingested_at) AS m FROM tool_use_conversation WHERE id IS NOT NULL GROUP BY id),
t AS (SELECT id, array_to_string(list_transform(list_filter(m, lambda x: x.content IS NOT NULL AND coalesce(x.role, '') <> 'system'), lambda x: x.content), chr(10)) AS s FROM c),
w AS (SELECT id, list_filter(regexp_split_to_array(lower(s), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM t)"""
_EACH = "SELECT id, array_to_string(w[i:i+2], ' ') AS r FROM (SELECT id, w, unnest(range(1, len(w) - 1)) AS i FROM w WHERE len(w) >= 3)"
_RUNS = f"r AS (SELECT DISTINCT id, r FROM ({_EACH}))"
_MULTI = f"r AS (SELECT id, r || '#' || row_number() OVER (PARTITION BY id, r) AS r FROM ({_EACH}))"
_ALIKE = """n AS (SELECT id, count(*) AS n FROM r GROUP BY id),
f AS (SELECT r, count(*) AS f FROM r GROUP BY r),
o AS (SELECT id, r, n, row_number() OVER (PARTITION BY id ORDER BY f, r) AS k FROM r JOIN f USING (r) JOIN n USING (id)),
p AS (SELECT * FROM o WHERE k <= n - ceil(0.6 * n) + 1),
x AS (SELECT DISTINCT a.id AS id_a, b.id AS id_b, a.n AS na, b.n AS nb FROM p a JOIN p b ON a.r = b.r AND a.id < b.id),
links AS (SELECT id_a, id_b FROM x JOIN r a ON a.id = id_a JOIN r b ON b.id = id_b AND a.r = b.r GROUP BY id_a, id_b, na, nb HAVING count(*) >= 0.6 * (na + nb - count(*)))"""

_LEAKS = r"""WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM documents WHERE text IS NOT NULL),
e AS (SELECT item_id, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM eval_items WHERE text IS NOT NULL),
dr AS (SELECT DISTINCT doc_id, array_to_string(w[i:i+4], ' ') AS r FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM d WHERE len(w) >= 5)),
er AS (SELECT DISTINCT item_id, array_to_string(w[i:i+4], ' ') AS r FROM (SELECT item_id, w, unnest(range(1, len(w) - 3)) AS i FROM e WHERE len(w) >= 5)),
n AS (SELECT item_id, count(*) AS n FROM er GROUP BY item_id),
leaks AS (SELECT doc_id, item_id, n, count(*) AS k FROM dr JOIN er USING (r) JOIN n USING (item_id) GROUP BY doc_id, item_id, n HAVING count(*) >= 0.4 * n)"""

#: DuckDB SQL. p4 and p5 are given as their definition; the others have no SQL (see tests/llm).
SQL = {
    "p7_words": r"""
WITH w AS (SELECT doc_id, text, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '\S')) AS l FROM documents)
SELECT doc_id, CASE WHEN len(l) > 0 THEN len(w) ELSE 0 END AS n_words, CASE WHEN len(w) > 0 THEN round_even(list_sum(list_transform(w, lambda x: length(x))) / len(w), 6) ELSE 0.0 END AS mean_word_length,
CASE WHEN len(l) > 0 THEN round_even(len(list_filter(l, lambda x: regexp_matches(rtrim(x), '[.?!。？！…]["''»”)\]` ]*$'))) / len(l), 6) ELSE 0.0 END AS punctuated_lines FROM w
""",
    "p5_found": f"{_LEAKS} SELECT doc_id, item_id FROM leaks",
    "p5_items": f"{_LEAKS} SELECT item_id, count(*) AS n_docs, max(round(k / n::DOUBLE, 6)) AS most_contained FROM leaks GROUP BY item_id",
    "p4_found": f"WITH {_WORDS}, {_RUNS}, {_ALIKE} SELECT id_a, id_b FROM links",
    "p4_weighted": f"WITH {_WORDS}, {_MULTI}, {_ALIKE} SELECT id_a, id_b FROM links",
    "p4_groups": f"""
WITH RECURSIVE {_WORDS}, {_RUNS}, {_ALIKE},
k AS (SELECT id, min(id) OVER (PARTITION BY w) AS class_id FROM w WHERE len(w) >= 3),
e AS (SELECT DISTINCT a.class_id AS x, b.class_id AS y FROM links JOIN k a ON a.id = id_a JOIN k b ON b.id = id_b WHERE a.class_id <> b.class_id),
s AS (SELECT x, y FROM e UNION SELECT y, x FROM e),
reach AS (SELECT DISTINCT class_id AS x, class_id AS y FROM k UNION SELECT reach.x, s.y FROM reach JOIN s ON s.x = reach.y)
SELECT k.id, k.class_id, (SELECT min(y) FROM reach WHERE reach.x = k.class_id) AS group_id, (SELECT count(*) FROM s WHERE s.x = k.class_id) AS n_links FROM k
""",
}
