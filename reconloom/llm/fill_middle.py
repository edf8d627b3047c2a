"""Fill-in-middle: a document is cut into prefix, middle and suffix, whose order then changes.

A document's units are words with the white space before them. `regex` finds them one after another and only the
offsets of their ends are kept, eight bytes a unit; where the cuts fall is read off two of these offsets, so a text is sliced
and never taken apart. Everything random comes from the sha256 of seed and id.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reconloom.llm.common import packed, small_batches

#: The units, and the marks of prefix, suffix and middle.
UNIT = regex.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"

SCHEMA = "n long, form string, prefix_chars long, middle_chars long, output string, output_sha256 string"


def unit_ends(text: str) -> array:
    """Offsets of the ends of a text's units, after a first 0."""
    ends = array("Q", [0])
    ends.extend(m.end() for m in UNIT.finditer(text))
    return ends


def _sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def transform(doc_id: int | None, text: str, seed: int, rate: int, spm_rate: int) -> tuple:
    """(n, form, prefix_chars, middle_chars, output) of one text."""
    ends = unit_ends(text)
    n = len(ends) - 1
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[i : i + 8], 16) for i in (0, 8, 16, 24))
    if not text or h3 % 100 >= rate or any(mark in text for mark in (PREFIX, SUFFIX, MIDDLE)):
        return n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    first, last = ends[a], ends[b]
    prefix, middle, suffix = text[:first], text[first:last], text[last:]
    if h4 % 100 < spm_rate:
        form, out = "spm", SUFFIX + suffix + PREFIX + prefix + MIDDLE + middle
    else:
        form, out = "psm", PREFIX + prefix + SUFFIX + suffix + MIDDLE + middle
    return n, form, first, last - first, out


def rebuilt(form: str, output: str) -> str:
    """The text that became output. No mark overlaps itself or another, and marked texts stay plain, so the first of each is the cut."""
    if form == "plain":
        return output
    inner = output[len(PREFIX) :]
    head, _, rest = inner.partition(SUFFIX if form == "psm" else PREFIX)
    other, _, middle = rest.partition(MIDDLE)
    return head + middle + other if form == "psm" else other + middle + head


def fill_in_middle(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = 42, rate: int = 50, spm_rate: int = 80) -> DataFrame:
    """One row for each row of df: id, n, form, prefix_chars, middle_chars, output, output_sha256.

    Of 100 texts about `rate` are cut, and of these about `spm_rate` are written suffix first. A null or empty text is plain
    with n = 0 and output ''; so are texts that hold a mark (with their own n). prefix_chars and middle_chars are null for plain
    ones. Cuts follow the id: repeated ids of equal texts give equal rows, and a null id has its own seed, that of no digits. A
    text of white space alone is one unit. No shuffle; an empty table gives no rows. Other columns of df play no part.
    """
    small_batches(df.sparkSession)

    @F.pandas_udf(SCHEMA)
    def cut(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for ids, texts in parts:
            done = [transform(None if i is None else int(i), t or "", seed, rate, spm_rate) for i, t in zip(ids, texts, strict=True)]
            out = pd.DataFrame(done, columns=["n", "form", "prefix_chars", "middle_chars", "output"])
            for c in ("prefix_chars", "middle_chars"):
                out[c] = out[c].astype("Int64")
            out["output_sha256"] = [_sha(x[4]) for x in done]
            yield out

    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    # The id goes to Python as text: integers beside a null would become floating-point numbers there.
    return rows.select("id", cut(F.col("id").cast("string"), "text").alias("cut")).select(F.col("id").alias(id_col), "cut.*")


def restore(df: DataFrame, form_col: str = "form", output_col: str = "output") -> DataFrame:
    """df with column `restored`, the text that its form and output were made of, and `restored_sha256`. A null output gives null."""

    @F.pandas_udf("restored string, restored_sha256 string")
    def back(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for forms, outputs in parts:
            texts = [None if o is None else rebuilt(f, o) for f, o in zip(forms, outputs, strict=True)]
            yield pd.DataFrame({"restored": texts, "restored_sha256": [None if t is None else _sha(t) for t in texts]})

    held = packed(df, back=back(form_col, output_col))
    return held.select("row.*", "back.*")


def digest(df: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """What identifies the result of fill_in_middle, without its texts."""
    return restore(df).select(id_col, "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256")
