"""From a wide table to the distinct values of its columns."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.functions.text import is_null_like, normalize_value


def as_strings(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """The columns (all by default) cast to string; a name that isn't there is an error."""
    names = list(columns) if columns is not None else df.columns
    if missing := [c for c in names if c not in df.columns]:
        raise ValueError(f"columns not in the table: {missing}")
    if len(set(names)) < len(names) or len(set(df.columns)) < len(df.columns):
        raise ValueError("column names repeat")
    return df.select(*[F.col(f"`{c}`").cast("string").alias(c) for c in names])


def cells(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """(column_name, value) of every cell, in one pass over the table."""
    text = as_strings(df, columns)
    return text.unpivot([], [F.col(f"`{c}`") for c in text.columns], "column_name", "value")


def tidied(raw: DataFrame) -> DataFrame:
    """(column_name, value, rows) of cells: the distinct values of each Arrow batch, normalised once each. Nulls are left out."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, values = batch.column("column_name"), batch.column("value")
            for name in pc.unique(names).to_pylist():
                counted = pc.value_counts(pc.drop_null(values.filter(pc.equal(names, name))))
                texts = [normalize_value(v) for v in counted.field("values").to_pylist()]
                yield pa.record_batch({"column_name": pa.array([name] * len(texts), pa.string()), "value": pa.array(texts, pa.string()), "rows": counted.field("counts")})

    return raw.mapInArrow(scan, "column_name string, value string, rows long")


def dictionary(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """(column_name, value, rows): distinct normalised values that aren't null-like, and how many rows have them.

    The table is read once and values are shuffled once, after those of each batch have been counted.
    """
    tidy = tidied(cells(df, columns)).filter(~is_null_like(F.col("value")))
    # The number of partitions is said, for what follows is costly for each byte: else few would be left of a small table.
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return tidy.repartition(n, "column_name", "value").groupBy("column_name", "value").agg(F.sum("rows").alias("rows"))


def column_sizes(values: DataFrame) -> DataFrame:
    """(column_name, distinct_values, value_rows) of a dictionary."""
    return values.groupBy("column_name").agg(F.count(F.lit(1)).alias("distinct_values"), F.sum("rows").alias("value_rows"))
