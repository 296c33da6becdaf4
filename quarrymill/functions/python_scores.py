"""Scores that need a program, not an expression: Arrow-batched functions of pandas series.

``nearest_option`` compares an answer with options by matching blocks, which no built-in distance equals;
``same_maths`` compares mathematical answers after LaTeX is brought to one form.
"""

from __future__ import annotations

import math
import re
from difflib import SequenceMatcher
from fractions import Fraction

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

_WORDS = {r"\cdot": "*", r"\times": "*", r"\div": "/", r"\pi": "pi", r"\left": "", r"\right": "", r"\!": "", r"\,": "", r"\;": "", r"\%": "", r"\$": "", r"^\circ": "", r"^{\circ}": "", r"\degree": ""}
_NUMBER = re.compile(r"[-+]?(?:\d+\.?\d*|\.\d+)$")


def closest(answer: str | None, options) -> str | None:
    """The option most like the answer by ratio of matching blocks; the first of equals; null without options."""
    if answer is None or options is None or len(options) == 0:
        return None
    return max(options, key=lambda o: SequenceMatcher(None, answer.lower(), (o or "").lower()).ratio())


@F.pandas_udf(T.StringType())
def nearest_option(answers: pd.Series, options: pd.Series) -> pd.Series:
    return pd.Series([closest(a, o) for a, o in zip(answers, options)], dtype=object)


def plain_maths(text: str) -> str:
    """A mathematical answer in one form: no spacing commands, units or text, fractions as (a)/(b), roots as sqrt(a)."""
    t = text.strip().strip("$").rstrip(".")
    for a, b in _WORDS.items():
        t = t.replace(a, b)
    t = re.sub(r"\\(?:text|mathrm|mbox|textbf)\{([^{}]*)\}", "", t)
    for _ in range(4):
        t = re.sub(r"\\[dt]?frac\{([^{}]*)\}\{([^{}]*)\}", r"((\1)/(\2))", t)
        t = re.sub(r"\\sqrt\{([^{}]*)\}", r"sqrt(\1)", t)
    t = re.sub(r"\\[dt]?frac(\d)(\d)", r"(\1/\2)", t)
    return re.sub(r"(?<=\d),(?=\d{3})", "", t).replace(" ", "").replace("{", "").replace("}", "").lower()


def number(text: str) -> float | None:
    """The value of a plain number, percentage or quotient; no other expression is evaluated."""
    t = text.strip("()").replace(")(", "").rstrip("%")
    if _NUMBER.match(t):
        return float(t)
    m = re.fullmatch(r"([-+]?)\(*([-+]?[\d.]+)\)*/\(*([-+]?[\d.]+)\)*", t)
    try:
        if m and float(m[3]):
            return float(Fraction(m[2]) / Fraction(m[3])) * (-1 if m[1] == "-" else 1)
    except (ValueError, ZeroDivisionError):
        return None
    return None


def maths_match(a: str | None, b: str | None) -> bool:
    if a is None or b is None:
        return False
    x, y = plain_maths(a), plain_maths(b)
    if x == y:
        return True
    parts_x, parts_y = (re.split(r",(?![^()]*\))", t.strip("()[]")) for t in (x, y))
    if len(parts_x) == len(parts_y) > 1:
        return all(maths_match(p, q) for p, q in zip(parts_x, parts_y))
    u, v = number(x.split("=")[-1]), number(y.split("=")[-1])
    return u is not None and v is not None and math.isclose(u, v, rel_tol=1e-4, abs_tol=1e-8)


@F.pandas_udf(T.BooleanType())
def same_maths(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([maths_match(x, y) for x, y in zip(a, b)])
