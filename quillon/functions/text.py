"""Scalar functions on values: normalising, nulls, signatures, truncation."""

from __future__ import annotations

import re
import unicodedata
from pyspark.sql import Column
from pyspark.sql import functions as F

from quillon.fixed import LONG_SIDE, LONG_VALUE, NULL_LIKE

# What counts as white space, and hyphens that become a plain one.
_BLANKS = r"(?U)[\s\x1c-\x1f]+"
_DASHES = "‐‑‒–—"
_PLAIN = dict.fromkeys(map(ord, _DASHES), "-")


def constants(values: list) -> Column:
    """A literal array, parsed at once: one call to the JVM instead of one for each value."""

    def sql(v: object) -> str:
        if isinstance(v, str):
            return "'" + v.replace("\\", "\\\\").replace("'", "\\'") + "'"
        return f"{v!r}D" if isinstance(v, float) else str(v).lower()

    return F.expr(f"array({', '.join(map(sql, values))})")


def tidy(value: Column) -> Column:
    """Normalised text as a Column, but for compatibility forms (NFKC), which only texts beyond ASCII need."""
    plain = F.translate(value, " " + _DASHES, " " + "-" * len(_DASHES))
    return F.trim(F.regexp_replace(plain, _BLANKS, " "))


def beyond_ascii(value: Column) -> Column:
    return value.rlike(r"[^\x00-\x7F]")


def normalize_value(value: str) -> str:
    """``value`` in compatibility form (NFKC), with plain hyphens and single blanks."""
    if not value.isascii():
        value = unicodedata.normalize("NFKC", value).translate(_PLAIN)
    return " ".join(value.split())  # split() knows the same white space as _BLANKS


def is_null_like(value: Column) -> Column:
    return F.lower(value).isin(*NULL_LIKE)


def digits_only(value: Column) -> Column:
    return F.regexp_replace(value, r"(?U)\D", "")


def compact_alnum(value: Column) -> Column:
    return F.regexp_replace(value, "[^A-Za-z0-9]", "")


def truncated(value: Column, mark: str) -> Column:
    """Values of over LONG_VALUE characters become their first and last LONG_SIDE with a mark between."""
    return F.when(F.length(value) > LONG_VALUE, F.concat(F.left(value, F.lit(LONG_SIDE)), F.lit(mark), F.right(value, F.lit(LONG_SIDE)))).otherwise(value)


def signature(value: Column) -> Column:
    """Shape of a value: digits as 9, capitals as A, small letters as a; runs of three or more as 9{n}; at most 100 characters."""
    shape = F.regexp_replace(F.trim(value), r"\p{Nd}", "9")
    shape = F.regexp_replace(F.regexp_replace(shape, r"\p{Lu}", "A"), r"\p{Ll}", "a")
    runs = F.regexp_extract_all(shape, F.lit("(?s)9{3,}|A{3,}|a{3,}|."), F.lit(0))
    named = F.transform(runs, lambda r: F.when(F.length(r) > 1, F.concat(F.left(r, F.lit(1)), F.lit("{"), F.length(r).cast("string"), F.lit("}"))).otherwise(r))
    return F.left(F.array_join(named, ""), F.lit(100))


def normalize_name(name: str) -> str:
    """A column name as lower-case words; names are few, so this is plain Python on the driver."""
    text = unicodedata.normalize("NFKC", name).translate({0xA0: " ", **dict.fromkeys(map(ord, _DASHES), "-")})
    parts = re.sub(r"(?<=[a-z0-9])(?=[A-Z])", " ", text)
    return " ".join(re.split(r"[\s_\-.]+", parts.strip())).strip().lower()
