import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parents[1]))

from quarrymill.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    return local_session(4, "4g", "tests")


MESSAGE = "STRUCT<role: STRING, content: STRING, reasoning_content: STRING, name: STRING, tool_call_id: STRING, tool_calls: ARRAY<STRUCT<id: STRING, type: STRING, function: STRUCT<name: STRING, arguments: STRING>>>>"
TOOL = "STRUCT<type: STRING, function: STRUCT<name: STRING, description: STRING, parameters: STRING>>"
CONVERSATION = f"id STRING, conversations ARRAY<{MESSAGE}>, tools ARRAY<{TOOL}>, source STRING, status STRING, image STRING, ingested_at TIMESTAMP"


def message(role, content, reasoning=None, calls=None):
    return (role, content, reasoning, None, None, calls)


def call(call_id, name, arguments="{}"):
    return (call_id, "function", None if name is None else (name, arguments))


def tool(name, description=None):
    return ("function", None if name is None else (name, description, "{}"))


@pytest.fixture(scope="session")
def conversations(spark):
    """Makes a conversation table of (id, messages[, tools]) tuples; further columns are null."""

    def make(rows):
        return spark.createDataFrame([(r[0], r[1], r[2] if len(r) > 2 else None, None, "success", None, None) for r in rows], CONVERSATION)

    return make


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect()) if columns else sorted(tuple(r) for r in df.collect())
