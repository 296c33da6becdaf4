"""Queries of the nested-record operator."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrymill.operators import nested
from quarrymill.session import tables


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return nested.items(*tables(spark, d, "tool_use_conversation", "tool_use_raw"))


def p2_calls(spark: SparkSession, d: str) -> DataFrame:
    """Calls of the typed table with function and declaration, each once."""
    (c,) = tables(spark, d, "tool_use_conversation")
    return nested.typed_calls(c).dropDuplicates(["rec_id", "msg_pos", "item_pos"]).select("rec_id", "msg_pos", "item_pos", "item_key", "function_name", "arguments", "tool_pos")


def p2_tools(spark: SparkSession, d: str) -> DataFrame:
    (c,) = tables(spark, d, "tool_use_conversation")
    return nested.typed_tools(c).dropDuplicates(["rec_id", "item_pos"])


def p2_typed(spark: SparkSession, d: str) -> DataFrame:
    """What p2_found has of the typed table."""
    return nested.typed_items(*tables(spark, d, "tool_use_conversation"))


def p2_sizes(spark: SparkSession, d: str) -> DataFrame:
    """Rows of each flat table over both inputs."""
    flat = nested.flat_tables(*tables(spark, d, "tool_use_conversation", "tool_use_raw"))
    out = [t.agg(F.count("*").alias("n_rows"), F.countDistinct("rec_id").alias("n_records")).select(F.lit(k).alias("table_name"), "n_rows", "n_records") for k, t in flat.items()]
    return out[0].unionByName(out[1]).unionByName(out[2]).unionByName(out[3])


QUERIES = {f.__name__: f for f in (p2_found, p2_calls, p2_tools, p2_typed, p2_sizes)}

_ONCE = "c AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY ingested_at) AS rn FROM tool_use_conversation WHERE id IS NOT NULL) WHERE rn = 1)"

SQL = {
    "p2_calls": f"""
WITH {_ONCE},
m AS (SELECT id, tools, unnest(conversations) AS m, generate_subscripts(conversations, 1) - 1 AS msg_pos FROM c),
k AS (SELECT id AS rec_id, tools, msg_pos, unnest(m.tool_calls) AS call, generate_subscripts(m.tool_calls, 1) - 1 AS item_pos FROM m WHERE len(m.tool_calls) > 0)
SELECT rec_id, CAST(msg_pos AS INTEGER) AS msg_pos, CAST(item_pos AS INTEGER) AS item_pos, coalesce(call.id, '') AS item_key, call."function".name AS function_name, call."function".arguments AS arguments,
CASE WHEN call."function".name IS NULL THEN -1 ELSE CAST(coalesce(list_position(list_transform(tools, lambda t: t."function".name), call."function".name), 0) - 1 AS INTEGER) END AS tool_pos FROM k WHERE call IS NOT NULL
""",
    "p2_typed": f"""
WITH {_ONCE},
m AS (SELECT id, tools, unnest(conversations) AS m, generate_subscripts(conversations, 1) - 1 AS msg_pos FROM c),
k AS (SELECT id AS rec_id, tools, msg_pos, unnest(m.tool_calls) AS call, generate_subscripts(m.tool_calls, 1) - 1 AS item_pos FROM m WHERE len(m.tool_calls) > 0),
t AS (SELECT id, unnest(tools) AS t, generate_subscripts(tools, 1) - 1 AS item_pos FROM c WHERE len(tools) > 0)
SELECT rec_id, 'call' AS kind, CAST(msg_pos AS INTEGER) AS msg_pos, CAST(item_pos AS INTEGER) AS item_pos, coalesce(call.id, '') AS item_key,
CASE WHEN call."function".name IS NULL THEN -1 ELSE CAST(coalesce(list_position(list_transform(tools, lambda t: t."function".name), call."function".name), 0) - 1 AS INTEGER) END AS tool_pos FROM k WHERE call IS NOT NULL
UNION ALL SELECT id, 'tool', -1, CAST(item_pos AS INTEGER), coalesce(t."function".name, ''), CAST(item_pos AS INTEGER) FROM t WHERE t IS NOT NULL
""",
    "p2_tools": f"""
WITH {_ONCE},
t AS (SELECT id, unnest(tools) AS t, generate_subscripts(tools, 1) - 1 AS item_pos FROM c WHERE len(tools) > 0)
SELECT id AS rec_id, CAST(item_pos AS INTEGER) AS item_pos, coalesce(t."function".name, '') AS item_key, t.type AS type, t."function".description AS description, t."function".parameters AS parameters FROM t WHERE t IS NOT NULL
""",
}
