"""Text: digit windows, character n-grams, numbers in prose, groundedness."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

RUN = 7


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def windows(text: str | Column, k: int) -> Column:
    """All substrings of length k, with repeats; none for a shorter or null text."""
    t = F.coalesce(_col(text), F.lit(""))
    return F.when(F.length(t) >= k, F.transform(F.sequence(F.lit(1), F.length(t) - k + 1), lambda i: F.substring(t, i, F.lit(k)))).otherwise(F.array().cast("array<string>"))


def digit_windows(text: str | Column, k: int = RUN) -> Column:
    """The distinct substrings of k digits."""
    return F.array_distinct(F.regexp_extract_all(F.coalesce(_col(text), F.lit("")), F.lit(f"(?=([0-9]{{{k}}}))"), F.lit(1)))


def shares_run(a: str | Column, b: str | Column, k: int = RUN) -> Column:
    """Whether a run of k digits of a occurs in b."""
    t = F.coalesce(_col(b), F.lit(""))
    return F.exists(digit_windows(a, k), lambda w: F.contains(t, w))


def longest_run(a: str | Column, b: str | Column, most: int = 12, least: int = RUN) -> Column:
    """Length of the longest run of digits of a that occurs in b, from least to most; 0 if there is none.

    A longer run holds a shorter one, so the first length without a shared run ends the search.
    """
    out = F.when(~shares_run(a, b, least), 0)
    for k in range(least + 1, most + 1):
        out = out.when(~shares_run(a, b, k), k - 1)
    return out.otherwise(most)


def normal(text: str | Column) -> Column:
    """Lower case, runs of two or more white characters as one space."""
    return F.regexp_replace(F.lower(_col(text)), r"\s\s+", " ")


def char_ngrams(normalised: str | Column, low: int = 3, high: int = 5) -> Column:
    """The n-grams of a text that is normalised already, as a column of its own: an expression here would be evaluated for each n-gram."""
    return F.flatten(F.array(*[windows(normalised, n) for n in range(low, high + 1)]))


#: Fixed value: a number in prose.
NUMBER = r"(?<![\w.])[-+]?\d[\d,]*(?:\.\d+)?%?"


def numbers(text: str | Column) -> Column:
    """Numbers as written; a sign glued to a word before it does not count."""
    return F.regexp_extract_all(F.coalesce(_col(text), F.lit("")), F.lit(NUMBER), F.lit(0))


def number_value(token: Column) -> Column:
    """Value of a number as written, without separators, sign + and %."""
    return F.regexp_replace(F.regexp_replace(token, "[,%]", ""), r"^\+", "").try_cast("double")


def ungrounded(text: str | Column, values: str | Column, counts: list[Column]) -> Column:
    """The numbers of a text that evidence does not give.

    values: array of doubles in the evidence. A number is grounded when it equals a value or a value rounded to the decimals
    written, or is a count that the evidence's shape gives: one of `counts`, or 0 to the first of them.
    """
    v = F.coalesce(_col(values), F.array().cast("array<double>"))
    shape = F.flatten(F.array(F.array(*[c.cast("double") for c in counts]), F.transform(F.sequence(F.lit(0), counts[0].cast("int")), lambda i: i.cast("double"))))
    allowed = F.concat(v, shape)

    def free(token: Column) -> Column:
        n = number_value(token)
        decimals = F.length(F.regexp_extract(token, r"\.(\d+)", 1))
        scale = F.pow(F.lit(10.0), decimals)
        return ~F.exists(allowed, lambda x: (x == n) | (F.abs(F.rint(x * scale) / scale - n) < 1e-9))

    return F.filter(numbers(text), free)


#: Phrases that propose a match.
PROPOSALS = (
    r"\bis (?:the|a) (?:correct|right|true) match\b",
    r"\bshould be matched to\b",
    r"\bmatch(?:es)? (?:to )?candidate\b",
    r"\bcandidate \d+ is (?:the )?(?:correct|right|best|likely)\b",
    r"\bI recommend matching\b",
    r"\bthe correct allocation is\b",
)


def proposes_match(text: str | Column) -> Column:
    t = F.coalesce(_col(text), F.lit(""))
    out = F.lit(False)
    for p in PROPOSALS:
        out = out | t.rlike("(?i)" + p)
    return out
