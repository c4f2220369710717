"""Streams: stateless detection and masking of rows as they come."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.fixed import V16, Profile
from quillon.functions.text import tidy
from quillon.operators.masking import mask_table
from quillon.operators.scan import match_rows


def detect_stream(stream: DataFrame, column: str, as_of: date | None = None, profile: Profile = V16) -> DataFrame:
    """A row for each match in ``column`` of a stream (or table): its columns, entity, pattern, score, span, validator_pass.

    Texts are tidied, but compatibility forms stay as they are: no Python runs in the stream.
    """
    return match_rows(stream.withColumn(column, tidy(F.col(column))), column, as_of, profile)


def mask_stream(stream: DataFrame, columns: Sequence[str], password: str) -> DataFrame:
    """The stream with the columns encrypted; each row is written once, so each cell is encrypted once."""
    return mask_table(stream, columns, password)
