"""Answer extraction and scoring as column expressions: the answer stays in the row, nothing leaves the JVM.

All functions give null for null texts unless said otherwise. Letters are compared in upper case.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from quarrymill.functions.text import strip_reasoning

LETTERS = "ABCD"

#: Number words and their digits. Fixed values.
NUMBER_WORDS = {"none": "0", "zero": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9", "ten": "10"}
ARTICLES = ("a", "an", "the")


def _first(text: Column, pattern: str, group: int = 1) -> Column:
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def _last(text: Column, pattern: str, group: int = 1) -> Column:
    return F.try_element_at(F.regexp_extract_all(text, F.lit(pattern), F.lit(group)), F.lit(-1))


def boxed(text: Column) -> Column:
    """The content of the last box, closed by brace counting; an unclosed box gives what it holds; null if empty."""
    fold = F.aggregate(
        F.split(F.substring_index(text, "oxed{", -1), ""), F.struct(F.lit(1).alias("d"), F.lit("").alias("s")),
        lambda a, c: F.when(a.d == 0, a).otherwise(
            F.struct((a.d + F.when(c == "{", 1).when(c == "}", -1).otherwise(0)).alias("d"), F.when((c == "}") & (a.d == 1), a.s).otherwise(F.concat(a.s, c)).alias("s"))
        ),
    )
    return F.when(F.contains(text, F.lit("oxed{")), F.nullif(F.trim(fold.s), F.lit("")))


# Patterns that decide what a response's answer is. Scores must equal those of the established scorers.
CHOICE_WHOLE = r"(?i)^\**\(?([{L}])\)?\**\s*[.):,]?$"
CHOICE_STATED = (
    r"(?i)\\boxed\{{\s*\(?([{L}])\)?\s*\}}", r"(?i)(?:answer|option|choice)\s*(?:is|:|：)?\s*\**\(?([{L}])\)?\b", r"(?i)答案\s*[:：是]?\s*\(?([{L}])\)?",
    r"(?i)选择\s*[:：是]?\s*\(?([{L}])\)?", r"(?i)(?:^|\n)\s*\**\(?([{L}])\)?\**\s*[.):,]", r"(?<![\w])([{L}])(?![\w])(?!\s+[a-z])",
)
INTEGER_BOX, INTEGER_SPACED_BOX = r"\\boxed\{([^}]+)\}", r"\\boxed\s+(\d+)"
INTEGER_STATED = (r"(?i)answer[\s:]+(\d+)", r"(?i)final\s+answer[\s:]+(\d+)", r"(?i)(?:is|equals?|=\s*)(\d+)\s*$")
MATHS_BOX, MATHS_SPACED_BOX = r"\\boxed\{([^}]+)\}", r"\\boxed\s+([^\s]+)"
MATHS_STATED = (r"(?i)answer[\s:]+([-+]?\d*\.?\d+)", r"(?i)(?:is|equals?|=\s*)([-+]?\d*\.?\d+)\s*$", r"([-+]?\d*\.?\d+)")
ANSWER_PHRASES = (
    "the answer is", "answer is", "the correct answer is", "correct answer is", "the best answer is", "best answer is", "the correct option is", "correct option is", "the best option is", "best option is",
    "the choice is", "choice is", "the correct choice is", "correct choice is", "i choose", "i select", "i pick", "my answer is", "my choice is", "옵션", "정답은", "답은", "답:", "答案是", "答案为", "选", "答えは",
)
RANKS = {"start": 10, "end": 9, "phrase": 7, "({c})": 6, "{c}.": 5, "{c}:": 4, "{c})": 3, "{c} ": 2, "anywhere": 0}
RANKED_LETTERS, EDGES = "ABCDEFGH", ",.!?;:'\""


def choice(response: Column, letters: str = LETTERS) -> Column:
    """The option letter a response settles on: the whole answer, an announced answer, a letter that opens a line, an
    isolated letter that can't be an article; within a kind the last one wins."""
    t = F.trim(strip_reasoning(response))
    stated = [_last(t, p.replace("{{", "{").replace("}}", "}").replace("{L}", letters)) for p in CHOICE_STATED]
    return F.upper(F.coalesce(_first(t, CHOICE_WHOLE.replace("{L}", letters)), *stated))


def ranked_choice(response: Column, letters: str = RANKED_LETTERS) -> Column:
    """The letter found in the format of highest rank (``RANKS``), and within it at the latest place; null for blank
    responses and those without a letter."""
    bare = F.trim(response)
    for c in EDGES:
        bare = F.trim(bare, F.lit(c))
    hit = lambda rank, test, place: F.when(test, F.struct(F.lit(rank).alias("r"), place.cast("int").alias("p")))

    def best(t: Column, behind: Column) -> Column:
        """``t``: the text between blanks; ``behind``: the places behind each phrase's first occurrence, from 1."""
        last = lambda x: F.length(t) - F.instr(F.reverse(t), F.reverse(x)) - F.length(x) + 1

        def formats(c: Column) -> Column:
            marks = [(RANKS[m], F.concat(*[F.lit(x) for x in m.split("{c}")[:1]], c, F.lit(m.split("{c}")[1]))) for m in ("({c})", "{c}.", "{c}:", "{c})", "{c} ")]
            found = [hit(rank, F.contains(t, m), last(m)) for rank, m in marks]
            phrase = F.array_max(F.transform(behind, lambda a: F.when(F.instr(F.substring(t, a, F.length(t)), c) > 0, a + F.instr(F.substring(t, a, F.length(t)), c) - 1)))
            s = F.trim(t)
            found += [hit(RANKS["phrase"], phrase.isNotNull(), phrase - 1), hit(RANKS["start"], F.regexp_like(s, F.concat(F.lit("^"), c, F.lit(r"(?:[^\p{L}]|$)"))), F.lit(0))]
            found += [hit(RANKS["end"], F.regexp_like(s, F.concat(F.lit(r"(?:^|[^\p{L}])"), c, F.lit("$"))), F.length(t) - 1), hit(RANKS["anywhere"], F.contains(t, c), last(c))]
            top = F.array_max(F.array(*found))
            return F.when(top.isNotNull(), F.struct(top.alias("top"), c.alias("c")))

        return F.array_max(F.transform(F.array(*[F.lit(x) for x in letters]), formats)).c

    let = lambda value, body: F.get(F.transform(F.array(value), body), 0)
    phrases = F.array(*[F.lit(p) for p in ANSWER_PHRASES])
    places = lambda t: F.filter(F.transform(phrases, lambda p: F.when(F.instr(F.lower(t), p) > 0, F.instr(F.lower(t), p) + F.length(p))), lambda a: a.isNotNull())
    return F.when(F.trim(response) != "", let(F.concat(F.lit(" "), bare, F.lit(" ")), lambda t: let(places(t), lambda behind: best(t, behind))))


def competition_integer(text: Column) -> Column:
    """An answer of a contest with integer answers: the box, a stated answer, or the last integer up to 999."""
    box = _first(text, INTEGER_BOX)
    bare = F.filter(F.regexp_extract_all(text, F.lit(r"\b(\d+)\b"), F.lit(1)), lambda n: F.length(F.ltrim(n, F.lit("0"))) <= 3)
    return F.coalesce(F.when(box.isNotNull(), F.coalesce(_last(box, r"(\d+)"), F.trim(box))), _first(text, INTEGER_SPACED_BOX), *[_last(text, p) for p in INTEGER_STATED], F.try_element_at(bare, F.lit(-1)))


def maths_answer(text: Column) -> Column:
    """The first box, a stated answer, or the last number."""
    return F.coalesce(F.trim(_first(text, MATHS_BOX)), F.trim(_first(text, MATHS_SPACED_BOX)), *[_last(text, p) for p in MATHS_STATED])


def maths_equal(prediction: Column, label: Column) -> Column:
    """Whether two answers are the same text or numbers within 1e-6; null without a label."""
    p, t = F.lower(F.trim(prediction)), F.lower(F.trim(label))
    near = F.abs(p.try_cast("double") - t.try_cast("double")) < 1e-6
    return F.when(label.isNotNull(), F.coalesce((p == t) | near, p == t, F.lit(False)))


def last_integer(text: Column) -> Column:
    """The last run of digits once thousands separators are gone."""
    return _last(F.replace(text, F.lit(","), F.lit("")), r"(\d+)")


def first_letter(text: Column, letters: str = LETTERS) -> Column:
    """The first standalone letter of the upper-cased text, else the first letter anywhere."""
    u = F.upper(F.trim(text))
    return F.coalesce(_first(u, rf"\b([{letters}])\b"), _first(u, rf"([{letters}])"))


def after_mark(text: Column, mark: str = "Answer: ") -> Column:
    """What follows the first mark, up to the next."""
    return F.when(F.contains(text, F.lit(mark)), F.trim(F.get(F.split(text, mark, 3), 1)))


def code_block(text: Column) -> Column:
    """The first fenced block, else the first function, else the text; null for blank texts."""
    fenced = _first(text, r"(?s)```(?:python)?\n(.*?)```")
    function = _first(text, r"(?s)(def\s+\w+\([^)]*\):.*?)(?=\n\ndef\s+|\z)")
    return F.nullif(F.trim(F.coalesce(fenced, function, text), F.lit(" \n\t\r")), F.lit(""))


def last_option(text: Column, options: Column) -> Column:
    """The last standalone letter among the first ``options`` letters; no random fallback."""
    t = F.regexp_replace(strip_reasoning(text), r"(?i)(?:the )?(?:best |correct )?(?:answer|option) is:?", "")
    found = F.regexp_extract_all(t, F.lit(r"(?<![A-Za-z])([A-Z])(?![A-Za-z])"), F.lit(1))
    return F.try_element_at(F.filter(found, lambda c: F.ascii(c) - 64 <= options), F.lit(-1))


def only_contained(text: Column, options: Column) -> Column:
    """The letter of the only option whose text the answer holds."""
    held = F.filter(F.transform(options, lambda o, i: F.when((o != "") & F.contains(F.lower(text), F.lower(o)), i)), lambda i: i.isNotNull())
    return F.when(F.size(held) == 1, F.substring(F.lit("ABCDEFGHIJ"), F.element_at(held, 1) + 1, F.lit(1)))


def holds_reference(prediction: Column, reference: Column) -> Column:
    """Whether a normalised reference is in a prediction: on word boundaries if it is ASCII, as a substring if not."""
    bounded = F.regexp_like(prediction, F.concat(F.lit(r"(?<!\w)\Q"), reference, F.lit(r"\E(?!\w)")))
    ascii_only = ~reference.rlike(r"[^\x00-\x7F]")
    return F.coalesce((reference != "") & (prediction != "") & F.when(ascii_only, bounded).otherwise(F.contains(prediction, reference)), F.lit(False))


def _number(text: Column) -> tuple[Column, Column]:
    t = F.trim(text)
    return F.rtrim(t, F.lit("%")).try_cast("double"), t.endswith("%")


def _cleaned(text: Column) -> Column:
    digits = text.rlike(r"\d")
    quoted = text.rlike(r"(?s)^(\".*\"|'.*')$") & (F.length(text) > 1)
    plain = F.when(quoted, F.substring(text, F.lit(2), F.length(text) - 2)).otherwise(text)
    number = F.regexp_replace(F.regexp_replace(text, r"[\s\p{Punct}&&[^%]]+$", ""), "[,$]", "")
    return F.when(digits, number).otherwise(plain)


def relaxed_match(prediction: Column, target: Column, tolerance: float = 0.05) -> Column:
    """1 or 0: numbers within a relative tolerance (percent signs on either side allowed for), single letters by the
    prediction's first letter, other texts without case and end punctuation."""
    p, t = _cleaned(prediction), _cleaned(target)
    (pv, pp), (tv, tp) = _number(p), _number(t)
    near = lambda a, b: F.abs(a - b) / F.greatest(F.abs(b), F.lit(1e-10)) <= tolerance
    as_part = lambda v, pct: F.when(pct, v / 100).otherwise(v)
    numeric = near(pv, tv) | ((pp | tp) & (near(as_part(pv, pp), tv) | near(pv, as_part(tv, tp))))
    letter = t.rlike(r"^\p{L}$") & (F.length(p) > 0)
    same = F.lower(F.regexp_replace(p, r"\p{Punct}+$", "")) == F.lower(t)
    return F.when(pv.isNotNull() & tv.isNotNull(), numeric).when(letter, F.lower(F.substring(p, 1, 1)) == F.lower(t)).otherwise(same).cast("double")


def stated_answer(text: Column) -> Column:
    """What stands behind the last ``answer:`` on its line, else the last line that isn't blank."""
    t = strip_reasoning(text)
    marked = _last(t, r"(?im)answer\s*[:：]\s*(.*)$")
    return F.trim(F.coalesce(marked, F.try_element_at(F.filter(F.split(t, "\n"), lambda x: F.trim(x) != ""), F.lit(-1))))


def ends_with_answer(prediction: Column, target: Column) -> Column:
    """Whether a prediction ends with the target, without case and end punctuation."""
    bare = lambda x: F.lower(F.regexp_replace(F.trim(x), r"[\s\p{Punct}]+$", ""))
    return F.coalesce(bare(prediction).endswith(bare(target)) & (bare(target) != ""), F.lit(False))


def caption(text: Column) -> tuple[Column, Column]:
    """(caption, score) of an answer that isn't scored: the text without reasoning; the score is null."""
    return strip_reasoning(text), F.lit(None).cast("double")


def fold_fullwidth(text: Column) -> Column:
    """Full-width ASCII and the ideographic space as ASCII."""
    wide = "".join(chr(c) for c in range(0xFF01, 0xFF5F)) + "　"
    return F.translate(text, wide, "".join(chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F)) + " ")


def holds_any(prediction: Column, references: Column, formula: Column) -> Column:
    """1 if a reference is in the prediction: without spaces for formulas, else without case and width."""
    plain = lambda x: F.replace(F.trim(F.lower(fold_fullwidth(x))), F.lit("\n"), F.lit(" "))
    tight = lambda x: F.regexp_replace(x, r"[ \n]", "")
    return F.exists(references, lambda r: F.when(formula, F.contains(tight(prediction), tight(F.trim(r)))).otherwise(F.contains(plain(prediction), plain(r)))).cast("int")


def short_text(text: Column) -> Column:
    """A short answer without emphasis, quotes, option parentheses, end punctuation and case."""
    t = F.trim(F.regexp_replace(F.trim(F.regexp_replace(text, "[*`]", "")), "^[\"']+|[\"']+$", ""))
    t = F.regexp_replace(t, r"^\(\s*([A-Za-z])\s*\)$", "$1")
    return F.lower(F.trim(F.regexp_replace(F.regexp_replace(t, r"\s+", " "), r"[.!?;:]+$", "")))


def terms(text: Column) -> Column:
    return F.array_sort(F.array_distinct(F.filter(F.transform(F.split(text, ","), short_text), lambda x: x != "")))


def parsed_number(text: Column) -> Column:
    """The first number of a text: 1,500, 1.5e3, 10^-2, 94%, $94."""
    t = F.regexp_replace(text, r"[$\\]", "")
    power = _first(t, r"10\s*\^\s*\{?\s*([-+]?\d+(?:\.\d+)?)").try_cast("double")
    plain = F.replace(_first(t, r"([-+]?(?:\d{1,3}(?:,\d{3})+|\d+)(?:\.\d+)?(?:[eE][-+]?\d+)?|[-+]?\.\d+)"), F.lit(","), F.lit("")).try_cast("double")
    return F.coalesce(F.pow(F.lit(10.0), power), plain)


def reasoning_score(prediction: Column, target: Column, numeric: Column) -> Column:
    """1 or 0: numbers by value for numeric targets; else equal short texts, equal sets of terms, or yes and no by
    the beginning of the prediction."""
    a, b = parsed_number(prediction), parsed_number(target)
    close = F.abs(a - b) <= F.greatest(1e-6 * F.greatest(F.abs(a), F.abs(b)), F.lit(1e-9))
    p, t = short_text(prediction), short_text(target)
    same = (p == t) | ((F.size(terms(target)) > 1) & (terms(prediction) == terms(target))) | (t.isin("yes", "no") & p.startswith(t))
    return F.when(F.coalesce(F.trim(prediction), F.lit("")) == "", 0.0).when(numeric & a.isNotNull() & b.isNotNull(), close.cast("double")).otherwise(((t != "") & same).cast("double"))


def open_text(text: Column) -> Column:
    return F.rtrim(F.lower(F.trim(text)), F.lit("."))


def lenient_score(generation: Column, answer: Column) -> Column:
    """1 or 0 against a letter (by ``choice``) or an open answer: equal, equal as number words, or held in it."""
    ref = F.trim(answer)
    is_letter = F.upper(ref).rlike(f"^[{LETTERS}]$")
    words = F.create_map(*[F.lit(x) for kv in NUMBER_WORDS.items() for x in kv])
    p, t = open_text(F.coalesce(boxed(generation), generation)), F.lower(ref)
    digit = lambda x: F.coalesce(F.try_element_at(words, x), x)
    opened = (p == t) | (digit(p) == digit(t)) | holds_reference(p, t)
    return F.when(is_letter, F.coalesce(choice(generation) == F.upper(ref), F.lit(False))).otherwise(opened).cast("double")


def vote_text(text: Column) -> Column:
    """An answer for vote counting: no punctuation, articles or case, number words as digits."""
    t = F.lower(F.trim(F.regexp_replace(text, r"[\n\t]", " ")))
    t = F.regexp_replace(F.regexp_replace(t, r"(?<!\d)\.(?!\d)", ""), r"[;/\[\]\"{}()=+\\_\-><@`,?!]", "")
    words = F.create_map(*[F.lit(x) for kv in NUMBER_WORDS.items() for x in kv])
    kept = F.filter(F.split(t, r"\s+"), lambda w: (w != "") & ~w.isin(*ARTICLES))
    return F.array_join(F.transform(kept, lambda w: F.coalesce(F.try_element_at(words, w), w)), " ")


def vote_score(prediction: Column, references: Column) -> Column:
    """Mean over references of min(1, matches among the other references / 3); 0 without references."""
    refs = F.transform(references, vote_text)
    p = vote_text(prediction)
    hits = F.size(F.filter(refs, lambda r: r == p))
    each = F.transform(refs, lambda r: F.least(F.lit(1.0), (hits - (r == p).cast("int")) / F.lit(3.0)))
    return F.when(F.size(refs) > 0, F.aggregate(each, F.lit(0.0), lambda s, x: s + x) / F.size(refs)).otherwise(0.0)


def options_of(text: Column) -> Column:
    """Texts of ``A. text`` lines in order, if the letters run A, B, C, ...; null otherwise."""
    letters = F.regexp_extract_all(text, F.lit(r"(?m)^\(?([A-J])[.):]\)?\s+(.+)$"), F.lit(1))
    found = F.regexp_extract_all(text, F.lit(r"(?m)^\(?([A-J])[.):]\)?\s+(.+)$"), F.lit(2))
    want = F.slice(F.array(*[F.lit(c) for c in "ABCDEFGHIJ"]), F.lit(1), F.size(letters))
    return F.when((F.size(letters) >= 2) & (letters == want), found)


def strip_wrapper(text: Column, prefixes: list[str], suffixes: list[str]) -> Column:
    """A prompt without one of the given beginnings and endings."""
    out = reduce(lambda c, p: F.when(c.startswith(p), F.substring(c, len(p) + 1, 1 << 30)).otherwise(c), prefixes, text)
    return reduce(lambda c, s: F.when(c.endswith(s), F.substring(c, F.lit(1), F.length(c) - len(s))).otherwise(c), suffixes, out)


#: Scorers by benchmark kind: extraction, and comparison with a label. Extend with ``SCORERS[name] = (f, g)``.
SCORERS = {
    "choice": (choice, lambda p, t: p == F.upper(F.trim(t))),
    "ranked-choice": (ranked_choice, lambda p, t: p == F.upper(F.trim(t))),
    "first-letter": (first_letter, lambda p, t: p == F.upper(F.trim(t))),
    "contest-integer": (competition_integer, maths_equal),
    "maths": (maths_answer, maths_equal),
    "word-problem": (last_integer, maths_equal),
    "marked": (after_mark, lambda p, t: p == F.trim(t)),
    "relaxed": (lambda g: F.coalesce(boxed(g), g), lambda p, t: relaxed_match(p, t) == 1.0),
}


def scored(kind: str, generation: Column, label: Column) -> tuple[Column, Column]:
    """(prediction, hit) of a registered scorer; hit is null without a label and false without a prediction."""
    extract, equal = SCORERS[kind]
    p = extract(generation)
    return p, F.when(label.isNotNull(), F.coalesce(equal(p, label), F.lit(False)))
