"""Metrics of each column and entity, in one aggregation over the evidence."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.functions.text import signature


def entity_metrics(found: DataFrame, sizes: DataFrame) -> DataFrame:
    """One row for each (column_name, entity) of the evidence, with supports, rates and shares.

    Reliabilities are summed in hundredths as integers, so results don't depend on the order of addition.
    Values are first counted by shape, then shapes are put together; both steps combine before the shuffle.
    """
    rows = found.withColumns({"shape": signature(F.col("value")), "addressed": F.exists("entities", lambda e: e["entity"] == "Address")})
    rows = rows.select("column_name", "rows", "shape", "addressed", F.inline("entities"))
    ner, regex = F.col("ner"), F.col("regex")
    both = (ner > 0) & (regex > 0)
    by_shape = rows.groupBy("column_name", "entity", "shape").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(ner > 0).alias("n_ner"), F.count_if(regex > 0).alias("n_regex"),
        F.sum(ner).alias("ner"), F.sum(regex).alias("regex"), F.sum(F.greatest(ner, regex)).alias("best"), F.sum(F.when(both, F.least(ner, regex)).otherwise(0)).alias("agreed"),
        F.count_if("passed").alias("passed"), F.count("passed").alias("judged"), F.sum("weight").alias("weight"), F.sum("matches").alias("matches"),
        F.count_if("exact").alias("exact"), F.sum("rows").alias("rows"), F.sum(F.when(~F.col("addressed"), F.col("rows")).otherwise(0)).alias("rows_unaddressed"),
    )
    sums = ("n", "n_ner", "n_regex", "ner", "regex", "best", "agreed", "passed", "judged", "weight", "matches", "exact", "rows", "rows_unaddressed")
    totals = by_shape.groupBy("column_name", "entity").agg(*[F.sum(c).alias(c) for c in sums], F.max("n").alias("largest_shape"))
    every = F.greatest(F.col("distinct_values"), F.lit(1))
    return totals.join(sizes, "column_name").select(
        "column_name", "entity", F.col("n").alias("support_count"),
        (F.col("n_ner") / every).alias("ner_raw"), (F.col("n_regex") / every).alias("regex_raw"), (F.col("n") / every).alias("union_raw"),
        (F.col("ner") / (every * 100)).alias("ner_weighted"), (F.col("regex") / (every * 100)).alias("regex_weighted"), (F.col("best") / (every * 100)).alias("union_weighted"),
        F.coalesce(F.try_divide("agreed", "best"), F.lit(0.0)).alias("agreement"), F.try_divide("passed", "judged").alias("validator"),
        F.coalesce(F.try_divide(F.col("weight"), F.col("matches") * 100), F.lit(0.0)).alias("specificity"),
        (F.col("largest_shape") / F.col("n")).alias("structure"), (F.col("exact") / every).alias("exact_support"),
        (F.col("rows") / F.greatest("value_rows", F.lit(1))).alias("row_support"), (F.col("rows_unaddressed") / F.greatest("value_rows", F.lit(1))).alias("row_unaddressed"),
        F.col("best").alias("best_hundredths"),
    )


def candidate_text(metrics: DataFrame) -> DataFrame:
    """(column_name, candidates): the supports of all entities as text, strongest first; and the strongest by union."""
    w = 0.40 * F.col("ner_weighted") + 0.40 * F.col("regex_weighted") + 0.20 * F.col("union_weighted")
    line = F.format_string("%s:w=%.2f,p=%.2f,r=%.2f,u=%.2f", "entity", w, "ner_weighted", "regex_weighted", "union_weighted")
    ranked = F.array_sort(F.collect_list(F.struct((-w).alias("o"), "entity", line.alias("line"))))
    strongest = F.array_sort(F.collect_list(F.struct((-F.col("union_weighted")).alias("o"), "entity")))
    return metrics.groupBy("column_name").agg(F.array_join(F.transform(ranked, lambda x: x["line"]), " | ").alias("candidates"), F.get(strongest, F.lit(0))["entity"].alias("strongest"))
