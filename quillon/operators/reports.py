"""Reports of a profile: detailed, summary, timing, masked data, and counts for the terminal."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.fixed import V16
from quillon.operators.masking import mask_table

# Labels of actions, and what stands for no entity.
LABELS = {"PROTECT": "🔴 PII DETECTED", "DETECTED_EXCLUDED": "🟡 DETECTED (excluded by policy)", "NONE": "🟢 SAFE"}
SHORT_LABELS = {"PROTECT": "PII", "DETECTED_EXCLUDED": "EXCLUDED", "NONE": "SAFE"}
NOTHING = "—"

#: Stages of a profile as they are named in the report of times, and their columns.
STAGES = (("named entities", "Time_Presidio_sec"), ("patterns", "Time_Regex_sec"), ("zero-shot", "Time_GLiNER_sec"), ("aggregation", "Time_Aggregation_sec"))


def _label(labels: dict[str, str]) -> Column:
    action = F.coalesce("Policy_Action", F.lit("NONE"))
    return F.when(action == "PROTECT", labels["PROTECT"]).when(action == "DETECTED_EXCLUDED", labels["DETECTED_EXCLUDED"]).otherwise(labels["NONE"])


def summary(results: DataFrame) -> DataFrame:
    """Column_Name, PII_Status, Entity_Type, Policy_Action."""
    entity = F.coalesce("Final_Entity_Type", "Primary_Entity", F.lit(NOTHING))
    return results.select("Column_Name", _label(LABELS).alias("PII_Status"), F.when(F.col("Policy_Action") != "NONE", entity).otherwise(NOTHING).alias("Entity_Type"), "Policy_Action")


def short_summary(results: DataFrame) -> DataFrame:
    """Column, Status, Entity, Confidence."""
    return results.select(F.col("Column_Name").alias("Column"), _label(SHORT_LABELS).alias("Status"), F.coalesce("Final_Entity_Type", F.lit(NOTHING)).alias("Entity"), F.col("Confidence_Score").alias("Confidence"))


def action_counts(results: DataFrame) -> DataFrame:
    """Columns and seconds for each action."""
    return results.groupBy("Policy_Action").agg(F.count(F.lit(1)).alias("n_columns"), F.sum("Time_Total_sec").alias("seconds"))


def stage_totals(results: DataFrame) -> dict[str, float | None]:
    """Seconds of each stage over all columns, and of all together; None for a stage that didn't run."""
    sums = results.agg(*[F.sum(c).alias(name) for name, c in STAGES], F.sum("Time_Total_sec").alias("total")).first()
    return sums.asDict()


def bar(value: float | None, largest: float, width: int = 24) -> str:
    return "#" * round(width * (value or 0.0) / largest) if largest else ""


def timing_report(results: DataFrame) -> str:
    """Times of a profile as text: stages over all columns first, then a line a column. A profile has a row for each column, so it is small."""
    totals = stage_totals(results)
    rows = results.select("Column_Name", "Policy_Action", F.coalesce("Final_Entity_Type", "Primary_Entity", F.lit(NOTHING)).alias("entity"), *[c for _, c in STAGES], "Time_Total_sec").collect()
    said = lambda x: f"{x:9.3f}" if x is not None else f"{'not run':>9}"
    out = [f"Column profile, detector {V16.detector_version}, schema {V16.schema_version}", "", f"{len(rows)} columns"]
    out += [f"  {label}: {sum(r.Policy_Action == action for r in rows)}" for action, label in LABELS.items()]
    most = max((x for x in totals.values() if x is not None), default=0.0)
    out += ["", "Seconds by stage"] + [f"  {name:<16}{said(x)}  {bar(x, most)}".rstrip() for name, x in totals.items()]
    out += ["", "Seconds by column"]
    for r in rows:
        out.append(f"  {r.Column_Name}  [{SHORT_LABELS[r.Policy_Action]}, {r.entity}]  " + ", ".join(f"{name} {said(r[c]).strip()}" for name, c in (*STAGES, ("total", "Time_Total_sec"))))
    return "\n".join(out)


def terminal_summary(results: DataFrame) -> str:
    """Columns by action and seconds by stage, as shown at the end of a run."""
    counts = {r.Policy_Action: r.n_columns for r in action_counts(results).collect()}
    lines = [f"{label}: {counts.get(action, 0)} columns" for action, label in LABELS.items()]
    return "\n".join(lines + [f"{name}: {x:.2f} s" if x is not None else f"{name}: not run" for name, x in stage_totals(results).items()])


def protected_columns(results: DataFrame) -> list[str]:
    return [r.Column_Name for r in results.filter(F.col("Policy_Action") == "PROTECT").select("Column_Name").collect()]


def write_csv(df: DataFrame, path: str, single: bool = False) -> str:
    """One folder of CSV with a header; ``single`` for reports, which are a row a column."""
    (df.coalesce(1) if single else df).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)
    return path


def write_reports(results: DataFrame, table: DataFrame, folder: str, password: str | None = None) -> dict[str, str]:
    """Writes all reports under ``folder``, any store that Spark writes to; returns name and path of each."""
    paths = {
        "detailed_report": write_csv(results.withColumn("Validator_Pass_Rate", F.coalesce(F.col("Validator_Pass_Rate").cast("string"), F.lit("N/A"))), f"{folder}/detailed_report", True),
        "summary_report": write_csv(summary(results), f"{folder}/summary_report", True),
        "timing_report": f"{folder}/timing_report",
    }
    spark = results.sparkSession
    spark.createDataFrame([(timing_report(results),)], "value string").coalesce(1).write.mode("overwrite").text(paths["timing_report"])
    if password:
        paths["masked_data"] = write_csv(mask_table(table, protected_columns(results), password), f"{folder}/masked_data")
    return paths
