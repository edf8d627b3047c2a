"""Allocation keys and key sets (arrays of distinct strings)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def unquote(part: str | Column) -> Column:
    """Without one matched pair of quotes around the trimmed part; a part that is not quoted stays as it is."""
    p = _col(part)
    t = F.trim(p)
    first = F.substring(t, 1, 1)
    quoted = (F.length(t) >= 2) & first.isin('"', "'") & (first == F.right(t, F.lit(1)))
    return F.when(quoted, F.substring(t, F.lit(2), F.length(t) - 2)).otherwise(p)


def parse_keys(label: str | Column, quotes: bool = True) -> Column:
    """The set in a label: blank or 'nan' is empty, '[a,b]' has its parts, anything else is one key with its spaces.

    quotes=False keeps quotes as part of a key and strips each part, as the profiling does.
    """
    s = F.coalesce(_col(label), F.lit(""))
    t = F.trim(s)
    inner = F.substring(t, F.lit(2), F.length(t) - 2)
    bracketed = t.startswith("[") & t.endswith("]")
    parts = F.when(bracketed, F.split(inner, ",", -1)).otherwise(F.array(s if quotes else t))
    clean = unquote if quotes else F.trim
    keys = F.filter(F.transform(parts, lambda k: clean(k)), lambda k: k != "")
    empty = F.array().cast("array<string>")
    return F.when((t == "") | (F.lower(t) == "nan") | (bracketed & (F.trim(inner) == "")), empty).otherwise(F.array_distinct(keys))


def encode_keys(keys: str | Column) -> Column:
    """'' for none, the key itself for one, '[a,b]' for more; order kept, repeats dropped."""
    k = F.array_distinct(_col(keys))
    return F.when(F.size(k) <= 0, "").when(F.size(k) == 1, F.element_at(k, 1)).otherwise(F.concat(F.lit("["), F.array_join(k, ","), F.lit("]")))


def canonical(keys: str | Column) -> Column:
    return F.array_sort(F.array_distinct(F.coalesce(_col(keys), F.array().cast("array<string>"))))


def same_set(a: str | Column, b: str | Column) -> Column:
    return canonical(a) == canonical(b)


def subset(a: str | Column, b: str | Column) -> Column:
    """Whether every key of a is in b."""
    return F.size(F.array_except(canonical(a), canonical(b))) == 0


def stratum(keys: str | Column) -> Column:
    n = F.size(canonical(keys))
    return F.when(n == 0, "blank").when(n == 1, "single_key").otherwise("multi_key")


def allocation_key(currency, value_date, account, attributes) -> Column:
    return F.concat_ws("_", currency, value_date, account, attributes)


def key_fields(key: str | Column) -> Column:
    """The four fields of an allocation key; the last keeps further underscores."""
    return F.split(_col(key), "_", 4)
