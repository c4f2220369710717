"""Cell-by-cell encryption of columns with AES-256-GCM, and back.

A cell becomes ``AES::`` and the URL-safe base64 of nonce, ciphertext and tag. The key comes from the
password and the column's name, once a column on the driver. It enters the plan as a broadcast row, not
as a literal, which ``explain`` would print; treat event logs as secret all the same.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence
from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.fixed import CELL_PREFIX, COLUMN_SUFFIX, KEY_BYTES, KEY_ROUNDS

#: What stands for hidden characters in previews, and how many at least.
DOT, DOTS = "●", 6


@lru_cache(maxsize=512)
def column_key(password: str, column: str) -> bytes:
    return hashlib.pbkdf2_hmac("sha256", password.encode(), hashlib.sha256(column.encode()).digest(), KEY_ROUNDS, KEY_BYTES)


def _with_keys(df: DataFrame, password: str, keys: dict[str, str]) -> DataFrame:
    """``df`` with a binary column of each name in ``keys``, for the column that it maps to."""
    row = df.sparkSession.createDataFrame([tuple(bytearray(column_key(password, c)) for c in keys.values())], ", ".join(f"`{k}` binary" for k in keys))
    return df.join(F.broadcast(row))  # one row


def encrypt(value: Column, key: Column) -> Column:
    coded = F.base64(F.aes_encrypt(F.encode(value, "UTF-8"), key, F.lit("GCM")))
    return F.concat(F.lit(CELL_PREFIX), F.translate(F.regexp_replace(coded, "[\r\n]", ""), "+/", "-_"))


def decrypt(value: Column, key: Column, strict: bool = True) -> Column:
    """Plain text of an encrypted cell; a wrong key or changed text is an error, or null if not ``strict``."""
    raw = F.unbase64(F.translate(F.substring(value, len(CELL_PREFIX) + 1, 2**31 - 1), "-_", "+/"))
    plain = (F.aes_decrypt if strict else F.try_aes_decrypt)(raw, key, F.lit("GCM"))
    return F.decode(plain, "UTF-8")


def is_encrypted(value: Column) -> Column:
    return F.coalesce(F.startswith(value.cast("string"), F.lit(CELL_PREFIX)), F.lit(False))


def mask_table(df: DataFrame, columns: Sequence[str], password: str) -> DataFrame:
    """``df`` with the columns encrypted and renamed with COLUMN_SUFFIX; null and blank cells stay; other names are ignored.

    Each evaluation draws new nonces: write the result once and read that.
    """
    chosen = [c for c in df.columns if c in set(columns)]
    if not chosen:
        return df
    keys = {f"_key_{i}": c for i, c in enumerate(chosen)}
    of = {c: k for k, c in keys.items()}

    def cell(c: str) -> Column:
        text = F.col(f"`{c}`").cast("string")
        return F.when(F.trim(F.regexp_replace(text, r"(?U)\s+", " ")) == "", text).otherwise(encrypt(text, F.col(of[c]))).alias(c + COLUMN_SUFFIX)

    return _with_keys(df, password, keys).select(*[cell(c) if c in of else F.col(f"`{c}`") for c in df.columns])


def masked_columns(df: DataFrame) -> list[str]:
    """Columns with an encrypted cell, from one pass over the table."""
    if not df.columns:
        return []
    row = df.agg(*[F.coalesce(F.bool_or(is_encrypted(F.col(f"`{c}`"))), F.lit(False)).alias(f"_{i}") for i, c in enumerate(df.columns)]).first()
    return [c for c, hit in zip(df.columns, row) if hit]


def original_name(column: str) -> str:
    return column.removesuffix(COLUMN_SUFFIX).strip() if column.endswith(COLUMN_SUFFIX) else column


def unmask_table(df: DataFrame, password: str) -> DataFrame:
    """Encrypted cells decrypted and names restored; plain, blank and null cells stay. A wrong password is an error when it runs."""
    masked = masked_columns(df)
    keys = {f"_key_{i}": original_name(c) for i, c in enumerate(masked)}
    of = {c: f"_key_{i}" for i, c in enumerate(masked)}

    def cell(c: str) -> Column:
        value = F.col(f"`{c}`")
        if c in of:
            value = F.when(is_encrypted(value), decrypt(value, F.col(of[c]))).otherwise(value)
        return value.alias(original_name(c))

    return (_with_keys(df, password, keys) if keys else df).select(*[cell(c) for c in df.columns])


def preview(value: Column, shown: int = 2) -> Column:
    """First characters, then dots; null and blank values stay."""
    text = value.cast("string")
    hidden = F.concat(F.left(text, F.lit(shown)), F.repeat(F.lit(DOT), F.greatest(F.lit(DOTS), F.length(text) - shown)))
    return F.when(F.trim(text) == "", text).otherwise(hidden)
