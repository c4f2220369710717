"""From scored candidates to one decision for each column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.fixed import PARENT, Profile
from quillon.operators.scoring import secondary

_PROFILE = (
    "entity", "score", "threshold", "detected", "accepted", "policy_excluded", "hard_reject", "ner_raw", "regex_raw", "union_raw", "agreement", "g_value", "g_context",
    "g_success", "g_effective", "validator", "kind", "semantic", "contradiction", "collision", "ner_weighted", "regex_weighted", "union_weighted", "support_count",
    "row_support", "related", "material",
)

# The columns of the report in order.
RESULT = (
    "Output_Schema_Version", "Detector_Version", "Column_Name", "PII_Detected", "Entity_Detected", "Policy_PII", "Policy_Action", "Final_Entity_Type", "Adjudicated_Entity",
    "Primary_Entity", "Stage1_Detected_Entity", "Stage1_Primary_Candidate", "Stage1_Candidate_Entities", "Detected_Entity_Set", "Presidio_Support", "Regex_Support",
    "Detector_Agreement", "Weighted_Presidio_Support", "Weighted_Regex_Support", "Weighted_Union_Support", "Collision_Penalty", "GLiNER_Confirmation_Ratio",
    "GLiNER_Combined_Support", "GLiNER_Effective_Evidence", "GLiNER_Value_Confirmation", "GLiNER_Context_Confirmation", "GLiNER_Inference_Success_Rate",
    "Validator_Pass_Rate", "Validator_Type", "Confidence_Score", "Confidence_Is_Calibrated", "Evidence_Score", "Decision_Margin", "Runner_Up_Entity", "Runner_Up_Score",
    "Runner_Up_Margin", "Decision_Reason", "Sampling_Entity_Coverage", "Sampling_Entities_Covered", "Sampling_Entities_Total", "Time_Presidio_sec", "Time_Regex_sec",
    "Time_GLiNER_sec", "Time_Aggregation_sec", "Time_Total_sec",
)

#: The older generation's report, in its order.
OLD_RESULT = (
    "Output_Schema_Version", "Detector_Version", "Column_Name", "PII_Detected", "Policy_Action", "Final_Entity_Type", "Primary_Entity", "Detected_Entity_Set",
    "Evidence_Score", "Decision_Margin", "Presidio_Support", "Regex_Support", "Detector_Agreement", "GLiNER_Value_Confirmation", "GLiNER_Context_Confirmation",
    "Validator_Pass_Rate", "Validator_Type", "Runner_Up_Entity", "Runner_Up_Score", "Decision_Reason",
)

# Reasons of columns that are clean before any scoring.
NO_VALUES = "Column has no non-empty values."
NO_EVIDENCE = "No Presidio or regex candidate evidence; semantic fallback not confirmed."


def _names(profiles: Column) -> Column:
    return F.transform(profiles, lambda p: p["entity"])


def ranked_profiles(scored: DataFrame) -> DataFrame:
    """(column_name, ranked): a column's candidates by score, then name. A column has a few dozen at most."""
    address_context = (F.col("entity") == "Address") & (F.col("related") >= 0.20) & (F.col("semantic") >= 0.75) & (F.col("g_context") >= 0.45)
    enough = (F.col("union_raw") >= 0.05) | (F.col("support_count") >= 2) | (F.col("related") >= 0.20)
    rows = scored.withColumn("material", (F.col("accepted") | secondary() | address_context) & enough)
    item = F.struct((-F.col("score")).alias("o"), F.col("entity").alias("e"), F.struct(*_PROFILE).alias("p"))
    return rows.groupBy("column_name").agg(F.transform(F.array_sort(F.collect_list(item)), lambda x: x["p"]).alias("ranked"))


def decisions(scored: DataFrame, text: DataFrame) -> DataFrame:
    """RESULT columns, but versions, samples and times, of every column with candidates. ``text``: ``candidate_text``."""
    df = ranked_profiles(scored).join(text, "column_name", "left")
    ranked = F.col("ranked")
    first = lambda items: F.get(items, F.lit(0))
    df = df.withColumns({"accepted": F.filter(ranked, lambda p: p["accepted"]), "found": F.filter(ranked, lambda p: p["detected"])})
    df = df.withColumn("adjudicated", F.coalesce(first(F.col("found")), first(ranked)))
    df = df.withColumn("primary", F.coalesce(first(F.col("accepted")), F.col("adjudicated")))
    p, accepted, found, adjudicated = F.col("primary"), F.col("accepted"), F.col("found"), F.col("adjudicated")
    may_follow = lambda x: (x["entity"] != p["entity"]) & ((x["union_raw"] >= 0.03) | (x["support_count"] >= 2) | (x["g_value"] >= 0.35) | ((x["entity"] == "Address") & (x["related"] >= 0.20)))
    child, parent = next(iter(PARENT.items()))
    strong_child = F.exists(ranked, lambda x: (x["entity"] == child) & (x["accepted"] | ((x["semantic"] >= 0.70) & (x["related"] >= 0.20))))
    material = _names(F.filter(ranked, lambda x: x["material"]))
    df = df.withColumns({
        "runner": first(F.filter(ranked, may_follow)),
        "held": F.when(F.array_contains(material, child) & strong_child, F.array_remove(material, parent)).otherwise(material),
    })
    runner, held = F.col("runner"), F.col("held")
    is_pii, is_found = F.size(accepted) > 0, F.size(found) > 0
    second = F.get(accepted, F.lit(1))
    parent_of_first = F.when(p["entity"] == child, parent).otherwise("")
    conflict = F.coalesce((second["score"] >= p["score"] - 0.05) & (second["entity"] != parent_of_first), F.lit(False))
    r4 = lambda c: F.round(c, 4)
    two = lambda label, c: F.format_string(f"{label}=%.2f", c)
    # The texts of reasons.
    reason_accepted = F.concat(
        F.concat_ws(
            "; ",
            F.concat(p["entity"], F.lit(" accepted")), two("support", p["union_raw"]), two("weighted_support", p["union_weighted"]), two("semantic", p["semantic"]),
            two("GLiNER_value", p["g_value"]), two("GLiNER_context", p["g_context"]), two("row_support", p["row_support"]),
            F.when(p["validator"].isNotNull(), F.format_string("validator=%.2f(%s)", p["validator"], p["kind"])),
            F.when(conflict, F.lit("multiple accepted entity families")),
            F.when(F.size(held) > 1, F.concat(F.lit("mixed PII: "), F.array_join(F.slice(held, 1, 6), ", "))),
        ),
        F.lit("."),
    )
    shut_out = _names(F.filter(found, lambda x: x["policy_excluded"]))
    base = F.when(adjudicated["policy_excluded"], F.concat(adjudicated["entity"], F.lit(" detected from evidence but excluded by configured privacy policy"))).otherwise(F.concat(adjudicated["entity"], F.lit(" detected but no entity passed the protection policy")))
    reason_found = F.concat(base, F.when(F.size(shut_out) > 0, F.concat(F.lit("; excluded entities: "), F.array_join(F.slice(shut_out, 1, 6), ", "))).otherwise(""), F.lit("."))
    reason_rejected = F.coalesce(
        p["hard_reject"],
        F.format_string(
            "Rejected %s: evidence score %.2f below threshold %.2f; support=%.2f, weighted_support=%.2f, semantic=%.2f, GLiNER_value=%.2f, row_support=%.2f, contradiction_penalty=%.2f, collision_penalty=%.2f.",
            p["entity"], p["score"], p["threshold"], p["union_raw"], p["union_weighted"], p["semantic"], p["g_value"], p["row_support"], p["contradiction"], p["collision"],
        ),
    )
    stage1 = F.when(p["support_count"] > 0, p["entity"]).otherwise(F.col("strongest"))
    return df.select(
        F.col("column_name").alias("Column_Name"), is_pii.alias("PII_Detected"), is_found.alias("Entity_Detected"), is_pii.alias("Policy_PII"),
        F.when(is_pii, "PROTECT").when(is_found, "DETECTED_EXCLUDED").otherwise("NONE").alias("Policy_Action"),
        F.when(is_pii, F.array_join(_names(accepted), " | ")).alias("Final_Entity_Type"), F.when(is_found, adjudicated["entity"]).alias("Adjudicated_Entity"),
        F.when(is_pii | is_found, p["entity"]).alias("Primary_Entity"), stage1.alias("Stage1_Detected_Entity"), stage1.alias("Stage1_Primary_Candidate"),
        F.col("candidates").alias("Stage1_Candidate_Entities"), F.when(F.size(held) > 0, F.array_join(held, " | ")).alias("Detected_Entity_Set"),
        r4(p["ner_raw"]).alias("Presidio_Support"), r4(p["regex_raw"]).alias("Regex_Support"), r4(p["agreement"]).alias("Detector_Agreement"),
        r4(p["ner_weighted"]).alias("Weighted_Presidio_Support"), r4(p["regex_weighted"]).alias("Weighted_Regex_Support"), r4(p["union_weighted"]).alias("Weighted_Union_Support"),
        r4(p["collision"]).alias("Collision_Penalty"), r4(p["g_value"]).alias("GLiNER_Confirmation_Ratio"),
        r4(F.least(F.lit(1.0), 0.90 * p["g_value"] + 0.10 * F.least(p["g_context"], F.lit(0.70)))).alias("GLiNER_Combined_Support"),
        r4(p["g_effective"]).alias("GLiNER_Effective_Evidence"), r4(p["g_value"]).alias("GLiNER_Value_Confirmation"), r4(p["g_context"]).alias("GLiNER_Context_Confirmation"),
        r4(p["g_success"]).alias("GLiNER_Inference_Success_Rate"), r4(p["validator"]).alias("Validator_Pass_Rate"), p["kind"].alias("Validator_Type"),
        r4(p["score"]).alias("Confidence_Score"), F.lit(False).alias("Confidence_Is_Calibrated"), r4(p["score"]).alias("Evidence_Score"), r4(p["score"] - p["threshold"]).alias("Decision_Margin"),
        runner["entity"].alias("Runner_Up_Entity"), r4(runner["score"]).alias("Runner_Up_Score"), r4(F.when(runner.isNull(), 1.0).otherwise(F.greatest(F.lit(0.0), p["score"] - runner["score"]))).alias("Runner_Up_Margin"),
        F.when(is_pii, reason_accepted).when(is_found, reason_found).otherwise(reason_rejected).alias("Decision_Reason"),
    )


#: Stages of a profile whose times are reported, in order of the columns for them.
STAGES = ("ner", "regex", "zero_shot", "aggregation")


def results(columns: DataFrame, decided: DataFrame, coverage: DataFrame, profile: Profile, seconds: dict[str, float] | None = None) -> DataFrame:
    """RESULT for every column. ``columns``: (column_name, place, distinct_values); those without a decision are clean.

    Numbers of clean columns are zero, texts are null, and the reason tells values from evidence. ``seconds`` of
    STAGES, which run for all columns at once, are shared among the columns by their distinct values; a stage
    that isn't in it has null.
    """
    seconds = seconds or {}
    share = F.coalesce(F.try_divide(F.coalesce("distinct_values", F.lit(0)), F.sum("distinct_values").over(Window.partitionBy())), F.lit(0.0))
    times = [F.round(share * seconds[s], 3) if s in seconds else F.lit(None).cast("double") for s in STAGES]
    total = F.round(share * sum(seconds.values()), 3) if seconds else F.lit(None).cast("double")
    nulls = {"Final_Entity_Type", "Adjudicated_Entity", "Primary_Entity", "Stage1_Detected_Entity", "Stage1_Primary_Candidate", "Stage1_Candidate_Entities", "Detected_Entity_Set", "Validator_Pass_Rate", "Runner_Up_Entity", "Runner_Up_Score"}
    df = columns.join(decided.withColumnRenamed("Column_Name", "c"), F.col("column_name") == F.col("c"), "left").join(coverage, "column_name", "left")
    clean = {"Policy_Action": "NONE", "Validator_Type": "NONE"}
    out = []
    for f in decided.schema:
        if f.name == "Column_Name":
            continue
        if f.name == "Decision_Reason":
            other = F.when(F.coalesce("distinct_values", F.lit(0)) == 0, NO_VALUES).otherwise(NO_EVIDENCE)
        elif f.name in clean:
            other = F.lit(clean[f.name])
        else:
            other = F.lit(None if f.name in nulls else False if f.dataType.simpleString() == "boolean" else 0.0)
        out.append(F.when(F.col("c").isNotNull(), F.col(f.name)).otherwise(other).alias(f.name))
    more = [
        F.lit(profile.schema_version).alias("Output_Schema_Version"), F.lit(profile.detector_version).alias("Detector_Version"), F.col("column_name").alias("Column_Name"),
        F.round(F.coalesce("coverage", F.lit(0.0)), 4).alias("Sampling_Entity_Coverage"), F.coalesce("covered", F.lit(0)).cast("int").alias("Sampling_Entities_Covered"),
        F.coalesce("credible", F.lit(0)).cast("int").alias("Sampling_Entities_Total"), *[t.alias(c) for t, c in zip([*times, total], RESULT[-5:])],
    ]
    return df.select("place", *more, *out).select("place", *RESULT)
