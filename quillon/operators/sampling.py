"""Stratified samples of a column's evidence for inference, and how well they cover its entities."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.fixed import V16, Profile
from quillon.functions.text import signature
from quillon.operators.scan import agree, has_source, priority

#: Strength from which a detection counts for an entity's own sample.
CREDIBLE = 0.28
SUPPORTED = 0.08
STRATA = ("agree", "disagree", "ner_only", "regex_only")
SHAPE_CAP = 2

_SAMPLE = "column_name string, place int, value string, priority double, entities array<string>"


def _ranked(keys: list[str], order: list[Column]) -> Column:
    return F.row_number().over(Window.partitionBy(*keys).orderBy(*order))


def stratified_sample(found: DataFrame, k: int | None = None, profile: Profile = V16) -> DataFrame:
    """At most ``k`` values a column: (column_name, place, value, priority, entities), in order of choice.

    First one value for each entity by strength, then one for each stratum of sources, then by priority;
    the first two passes (for the older profile also a third) take at most two values of a shape. Choosing
    is greedy, so it runs in one task for each column, but on few rows: at most ``k`` values are ever chosen
    and a pass takes two of a shape, so of each entity, stratum and shape the first two are enough, of each
    entity and stratum the first 2 (k + 1) of these, and of all values the first ``k``. These limits are
    applied before the shuffle too, and any that is left out could not have been chosen.
    """
    k = profile.samples if k is None else k
    strength = F.transform("entities", lambda e: F.struct(e["entity"].alias("entity"), F.greatest(e["ner_score"], e["regex_score"]).alias("strength")))
    stratum = F.when(has_source("ner") & has_source("regex"), F.when(agree(), STRATA[0]).otherwise(STRATA[1])).when(has_source("ner"), STRATA[2]).otherwise(STRATA[3])
    rows = found.select("column_name", "value", priority(profile).alias("priority"), signature(F.col("value")).alias("shape"), stratum.alias("stratum"), strength.alias("strengths"))
    order = [F.col("priority").desc(), F.col("value")]
    few = 2 * (k + 1)

    def best(df: DataFrame, group: list[str]) -> DataFrame:
        two = df.withColumn("_r", _ranked([*group, "shape"], order)).filter(F.col("_r") <= SHAPE_CAP)
        return two.withColumn("_r", _ranked(group, order)).filter(F.col("_r") <= few).drop("_r")

    entity = F.filter("strengths", lambda s: s["strength"] >= CREDIBLE)
    by_entity = best(rows.withColumn("entity", F.explode(F.transform(entity, lambda s: s["entity"]))), ["column_name", "entity"]).drop("entity")
    by_stratum = best(rows, ["column_name", "stratum"])
    overall = rows.withColumn("_r", _ranked(["column_name"], order)).filter(F.col("_r") <= few).drop("_r")
    shapes = best(rows, ["column_name"]) if profile.capped_fill else overall
    pool = by_entity.unionByName(by_stratum).unionByName(overall).unionByName(shapes)
    pool = pool.groupBy("column_name", "value").agg(*[F.first(c).alias(c) for c in ("priority", "shape", "stratum", "strengths")])
    tops = rows.select("column_name", F.inline("strengths")).groupBy("column_name", "entity").agg(F.max("strength").alias("top"))
    by_column = tops.groupBy("column_name").agg(F.array_sort(F.collect_list(F.struct((-F.col("top")).alias("o"), "entity"))).alias("tops"))
    counts = rows.groupBy("column_name").agg(F.count(F.lit(1)).alias("n"))

    def choose(pdf: pd.DataFrame) -> pd.DataFrame:
        ranked = pdf.sort_values(["priority", "value"], ascending=[False, True], kind="stable").to_dict("records")
        chosen: list[dict] = []
        taken: set[str] = set()
        shape_use: dict[str, int] = {}

        def take(rows: list[dict], how_many: int, cap: float) -> None:
            """Adds up to so many of the rows, in their order."""
            for row in rows:
                if how_many <= 0 or len(chosen) >= k:
                    return
                if row["value"] not in taken and shape_use.get(row["shape"], 0) < cap:
                    chosen.append(row)
                    taken.add(row["value"])
                    shape_use[row["shape"]] = shape_use.get(row["shape"], 0) + 1
                    how_many -= 1

        if pdf["n"].iloc[0] <= k:
            take(ranked, k, float("inf"))
        else:
            strengths = [{s["entity"]: s["strength"] for s in row["strengths"]} for row in ranked]
            for top in pdf["tops"].iloc[0]:
                take([row for row, s in zip(ranked, strengths) if s.get(top["entity"], 0.0) >= CREDIBLE], 1, SHAPE_CAP)
            for name in STRATA:
                take([row for row in ranked if row["stratum"] == name], 1, SHAPE_CAP)
            if profile.capped_fill:
                take(ranked, k, SHAPE_CAP)
            take(ranked, k, float("inf"))
        rows = [(row["column_name"], i, row["value"], row["priority"], sorted(s["entity"] for s in row["strengths"])) for i, row in enumerate(chosen)]
        return pd.DataFrame(rows, columns=["column_name", "place", "value", "priority", "entities"])

    return pool.join(by_column, "column_name").join(counts, "column_name").groupBy("column_name").applyInPandas(choose, _SAMPLE)


def sample_coverage(samples: DataFrame, metrics: DataFrame, found: DataFrame) -> DataFrame:
    """(column_name, covered, credible, coverage): entities of enough weighted support among the evidence that a sample has."""
    values = found.groupBy("column_name").agg(F.count(F.lit(1)).alias("values"))
    credible = metrics.join(values, "column_name").filter(F.col("best_hundredths") >= F.col("values") * (SUPPORTED * 100)).select("column_name", "entity")
    seen = samples.select("column_name", F.explode("entities").alias("entity")).distinct().withColumn("seen", F.lit(1))
    counts = credible.join(seen, ["column_name", "entity"], "left").groupBy("column_name").agg(F.count("seen").alias("covered"), F.count(F.lit(1)).alias("credible"))
    whole = values.select("column_name").join(counts, "column_name", "left").select("column_name", F.coalesce("covered", F.lit(0)).alias("covered"), F.coalesce("credible", F.lit(0)).alias("credible"))
    return whole.withColumn("coverage", F.when(F.col("credible") > 0, F.col("covered") / F.col("credible")).otherwise(1.0))
