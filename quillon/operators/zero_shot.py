"""Zero-shot confirmation of samples: predictions of two views of each value, combined into metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.fixed import FAMILIES, MEANS_UNKNOWN, ZERO_SHOT_LABELS
from quillon.functions.text import normalize_name

METRICS = ("g_value", "g_context", "g_consistency", "g_mean", "g_success")


def context_prefix(column: str, meaning: str) -> str:
    """What stands before a value in its second view."""
    said = f" ({meaning})" if meaning and meaning != MEANS_UNKNOWN else ""
    return f"Field '{normalize_name(column) or column}'{said} value: "


def canonical(label: Column) -> Column:
    """Entity of a model's label (in compatibility form); of another label each run of letters gets a capital."""
    known = F.create_map(*[F.lit(x) for pair in ZERO_SHOT_LABELS.items() for x in pair])
    runs = F.regexp_extract_all(F.trim(label), F.lit(r"\p{L}+|\P{L}+"), F.lit(0))
    return F.coalesce(F.try_element_at(known, F.lower(F.trim(label))), F.array_join(F.transform(runs, F.initcap), ""))


def predictions(raw: DataFrame) -> DataFrame:
    """Model output (column_name, value, view, label, text, start, end, offset, score, inference_ok) as predictions.

    A found entity counts if it overlaps the value's part of the view, which begins at ``offset``, or if its
    text is in the value; of each label the best score stays. Rows without a label tell that inference ran.
    """
    inside = (F.col("start") < F.col("offset") + F.length("value")) & (F.col("end") > F.col("offset"))
    in_text = (F.length("text") > 0) & F.contains(F.lower("value"), F.lower("text"))
    counts = F.col("label").isNotNull() & (F.coalesce(inside, F.lit(False)) | F.coalesce(in_text, F.lit(False)))
    rows = raw.withColumn("entity", F.when(counts, canonical(F.col("label"))))
    return rows.groupBy("column_name", "value", "view", "entity").agg(F.max("score").alias("score"), F.min("inference_ok").alias("inference_ok"))


def combined(predicted: DataFrame) -> DataFrame:
    """(column_name, value, entity, score): both views together, best first by score, then entity."""
    view = lambda name: F.coalesce(F.max(F.when(F.col("view") == name, F.col("score"))), F.lit(0.0))
    by_entity = predicted.filter(F.col("entity").isNotNull()).groupBy("column_name", "value", "entity").agg(view("value").alias("v"), view("context").alias("c"))
    from_context = 0.12 * F.least("c", F.lit(0.85))
    score = F.when(F.col("v") > 0, F.least(F.lit(1.0), 0.88 * F.col("v") + from_context)).otherwise(from_context)
    return by_entity.select("column_name", "value", "entity", score.alias("score"))


def family(entity: Column) -> Column:
    known = F.create_map(*[x for e, others in FAMILIES.items() for x in (F.lit(e), F.array(*map(F.lit, others)))])
    return F.coalesce(F.element_at(known, entity), F.array(entity))


def zero_shot_metrics(candidates: DataFrame, samples: DataFrame, predicted: DataFrame) -> DataFrame:
    """METRICS of each candidate (column_name, entity).

    They are taken over the samples in which the entity was found before, or over all if there are none;
    samples of which a view failed count only against success. A sample has at most a few dozen
    predictions and a column few samples, so all joins here are small.
    """
    pair = F.struct(F.col("score").alias("score"), F.col("entity").alias("entity"))
    of = lambda name: F.collect_list(F.when((F.col("view") == name) & F.col("entity").isNotNull(), pair))
    by_value = predicted.groupBy("column_name", "value").agg(of("value").alias("v"), of("context").alias("c"), F.min("inference_ok").alias("ok"))
    none = F.array().cast("array<struct<score:double,entity:string>>")
    seen = samples.select("column_name", "value", "entities").join(by_value, ["column_name", "value"], "left")
    seen = seen.select("column_name", "entities", F.coalesce("v", none).alias("v"), F.coalesce("c", none).alias("c"), F.coalesce("ok", F.lit(True)).alias("ok"))
    rows = candidates.join(seen, "column_name").withColumns({"has": F.array_contains("entities", F.col("entity")), "family": family(F.col("entity"))})
    rows = rows.join(rows.groupBy("column_name", "entity").agg(F.max("has").alias("any")), ["column_name", "entity"]).filter(F.col("has") | ~F.col("any"))
    mine = lambda side: F.filter(side, lambda p: F.array_contains("family", p["entity"]))
    # First by score, then by name.
    first = F.get(F.array_sort(F.transform("v", lambda p: F.struct((-p["score"]).alias("o"), p["entity"].alias("entity")))), F.lit(0))["entity"]
    ok = F.col("ok")
    sums = rows.withColumns({"hit": F.size(mine("v")) > 0, "seen": F.size(mine("c")) > 0, "best": F.array_max(F.transform(mine("v"), lambda p: p["score"])), "first": first}).groupBy("column_name", "entity").agg(
        F.count_if(ok).alias("ran"), F.count(F.lit(1)).alias("all"), F.count_if(ok & F.col("hit")).alias("hits"), F.count_if(ok & F.col("seen")).alias("contexts"),
        F.avg(F.when(ok, F.col("best"))).alias("mean"), F.avg(F.when(ok & F.col("first").isNotNull(), F.array_contains("family", F.col("first")).cast("int"))).alias("consistency"),
    )
    ran = F.greatest("ran", F.lit(1))
    return sums.select(
        "column_name", "entity", (F.col("hits") / ran).alias("g_value"), (F.col("contexts") / ran).alias("g_context"),
        F.coalesce("consistency", F.lit(0.0)).alias("g_consistency"), F.coalesce("mean", F.lit(0.0)).alias("g_mean"), (F.col("ran") / F.col("all")).alias("g_success"),
    )
