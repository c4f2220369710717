"""Sources: CSV as both generations read it, any table, and the policy overlay."""

from __future__ import annotations

import json
from collections import Counter
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

from quillon.fixed import IDENTIFIERS
from quillon.operators.cells import as_strings
from quillon.operators.scoring import Policy

# Cells that the default reader takes for missing.
MISSING = ("#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null")


def read_csv(spark: SparkSession, path: str, keep_missing: bool = False, encoding: str = "UTF-8", delimiter: str = ",", columns: Sequence[str] | None = None, multiline: bool = True) -> DataFrame:
    """All cells as strings; types are never inferred. Missing cells are empty strings.

    By default cells of MISSING are empty too; ``keep_missing`` leaves them as they are, as the older
    generation does. A missing file is an error, and so are repeated names in the header. A file whose cells
    hold no line breaks can be read with ``multiline=False``, and is then split among tasks.
    """
    header = spark.read.option("encoding", encoding).option("sep", delimiter).option("quote", '"').option("escape", '"').option("multiLine", multiline).csv(path, header=False).head()
    if header is not None and (again := [n for n, k in Counter(header).items() if k > 1]):
        raise ValueError(f"column names repeat: {again}")
    df = spark.read.csv(path, header=True, inferSchema=False, multiLine=multiline, quote='"', escape='"', encoding=encoding, sep=delimiter, nullValue="\x00", emptyValue="").na.fill("")
    if not keep_missing:
        df = df.replace(list(MISSING), [""] * len(MISSING))
    return as_strings(df, columns)


def read_table(spark: SparkSession, path: str, kind: str = "parquet", columns: Sequence[str] | None = None, **options: str) -> DataFrame:
    """Any source of Spark, its columns cast to strings (CSV is one source among others)."""
    return as_strings(spark.read.format(kind).options(**options).load(path), columns)


def policy_overlay(text: str) -> Policy:
    """A policy from JSON; unknown identifiers and values other than true and false are errors."""
    given, policy = json.loads(text), Policy()

    def flag(name: str, value: object) -> bool:
        if not isinstance(value, bool):
            raise ValueError(f"{name} must be true or false")
        return value

    for entity, value in given.get("identifier_policy", {}).items():
        if entity not in IDENTIFIERS:
            raise ValueError(f"unknown identifier: {entity}")
        policy.identifiers[entity] = flag(entity, value)
    policy.coarse_locations = flag("treat_coarse_location_as_pii", given.get("treat_coarse_location_as_pii", policy.coarse_locations))
    policy.organizations = flag("treat_organization_as_pii", given.get("treat_organization_as_pii", policy.organizations))
    return policy
