"""Evidence scores of a column's candidate entities, as chained columns over a small table."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillon.fixed import IDENTIFIERS, NAME_TERMS, NATURAL, OPAQUE, SPARSE, THRESHOLD_ELSE, THRESHOLDS, V16, Profile
from quillon.functions.names import contradiction, name_facts, rivalry
from quillon.operators.zero_shot import METRICS
from quillon.work import stash


@dataclass
class Policy:
    """What counts as personal data: coarse places, organisations, and each kind of identifier."""

    coarse_locations: bool = False
    organizations: bool = False
    identifiers: dict[str, bool] = field(default_factory=lambda: dict.fromkeys(IDENTIFIERS, True))
    own_thresholds: bool = True  # False: a passport's rescue takes the threshold of the candidate before it


def name_tables(spark: SparkSession, columns: Sequence[str], profile: Profile = V16) -> tuple[DataFrame, DataFrame]:
    """What the names say: (column_name, entity, semantic, negative, rival_gap, contradiction), and a row for each column.

    Both have a few dozen rows for each column of the input table.
    """
    by_entity, by_column = [], []
    for column in columns:
        facts = name_facts(column, profile.fuzzy_names)
        others = {e for e in THRESHOLDS} | set(NAME_TERMS) | {"Date Time"}
        for entity in sorted(others):
            by_entity.append((column, entity, facts.scores.get(entity, 0.0), entity in facts.negatives, rivalry(entity, facts.scores), contradiction(entity, facts.scores)))
        of = lambda entity: facts.scores.get(entity, 0.0)
        by_column.append((column, facts.generic, facts.coarse_place, facts.meaning, of("Address"), of("Passport Number"), of("Driver License Number")))
    return (
        spark.createDataFrame(by_entity, "column_name string, entity string, semantic double, negative boolean, rival_gap double, contradiction double"),
        spark.createDataFrame(by_column, "column_name string, generic boolean, coarse_place boolean, meaning string, name_address double, name_passport double, name_license double"),
    )


def candidates(metrics: DataFrame, names: DataFrame, predicted: DataFrame | None = None) -> DataFrame:
    """(column_name, entity) to score: found in the evidence, meant by the name, or predicted; only of columns with evidence."""
    found = metrics.select("column_name", "entity")
    rows = found.unionByName(names.filter(F.col("semantic") > 0).select("column_name", "entity"))
    if predicted is not None:
        rows = rows.unionByName(predicted.filter(F.col("entity").isNotNull()).select("column_name", "entity"))
    return rows.distinct().join(found.select("column_name").distinct(), "column_name", "left_semi")


_ZERO = (
    "support_count", "ner_raw", "regex_raw", "union_raw", "ner_weighted", "regex_weighted", "union_weighted", "agreement", "specificity", "structure",
    "exact_support", "row_support", "row_unaddressed",
)


def _threshold(entity: Column) -> Column:
    known = F.create_map(*[F.lit(x) for pair in THRESHOLDS.items() for x in pair])
    return F.coalesce(F.element_at(known, entity), F.lit(THRESHOLD_ELSE))


def _kind(entity: Column, profile: Profile) -> Column:
    known = F.create_map(*[F.lit(x) for e, (kind, _) in profile.validators.items() for x in (e, kind)])
    return F.coalesce(F.element_at(known, entity), F.lit("NONE"))


# Weights of the evidence score by family: named-entity support, pattern support, their union, name, agreement,
# zero-shot, its consistency; what a validator's rate adds, and what its complement takes.
_WEIGHTS = (
    (NATURAL, (0.46, 0.0, 0.06, 0.24, 0.0, 0.18, 0.06), (0.0, 0.0)),
    (("Date of Birth",), (0.10, 0.24, 0.08, 0.34, 0.0, 0.10, 0.0), (0.14, 0.0)),
    (("Aadhaar Number", "Credit Card Number", "IBAN"), (0.12, 0.30, 0.08, 0.16, 0.08, 0.08, 0.0), (0.24, 0.45)),
    (("PAN Number", "IFSC Code", "MAC Address", "Email Address", "IP Address", "Crypto Wallet Address"), (0.16, 0.30, 0.08, 0.18, 0.08, 0.08, 0.0), (0.12, 0.24)),
    (("Bank Account Number", "Passport Number", "Driver License Number", "Phone Number", "Social Security Number", "Voter ID"), (0.16, 0.26, 0.05, 0.25, 0.08, 0.10, 0.0), (0.10, 0.18)),
    (IDENTIFIERS, (0.10, 0.24, 0.10, 0.38, 0.0, 0.12, 0.0), (0.0, 0.0)),
    (None, (0.22, 0.22, 0.10, 0.24, 0.08, 0.14, 0.0), (0.0, 0.0)),
)


def _base_score() -> Column:
    of = lambda c: F.least(F.lit(1.0), F.col(c) / 0.50)
    parts = (of("ner_weighted"), of("regex_weighted"), of("union_weighted"), F.col("semantic"), F.col("agreement"), F.col("g_effective"), F.col("g_consistency"))
    out: Column | None = None
    for family, weights, (adds, takes) in reversed(_WEIGHTS):
        score = sum((p * w for p, w in zip(parts, weights) if w), F.lit(0.0))
        if adds or takes:
            score = score + F.coalesce(F.col("validator") * adds - (1 - F.col("validator")) * takes, F.lit(0.0))
        out = score if family is None else F.when(F.col("entity").isin(*family), score).otherwise(out)
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), out - F.when(F.col("negative"), 0.24).otherwise(0.0)))


def _is(*entities: str) -> Column:
    return F.col("entity").isin(*entities)


def profiles(rows: DataFrame, metrics: DataFrame, names: DataFrame, columns: DataFrame, zero_shot: DataFrame | None = None, policy: Policy | None = None, profile: Profile = V16) -> DataFrame:
    """One scored row for each candidate. ``columns``: the table of column names joined with sizes.

    Every table here has at most a few dozen rows for each column of the input.
    """
    policy = policy or Policy()
    df = rows.join(metrics, ["column_name", "entity"], "left").join(names, ["column_name", "entity"], "left").join(columns, "column_name")
    if zero_shot is None:
        df = df.withColumns({m: F.lit(0.0) for m in METRICS})
    else:
        df = df.join(zero_shot, ["column_name", "entity"], "left")
    # Written here, so that the steps below are planned over a scan and not over all that led to it.
    df = stash(df.fillna(0, [*_ZERO, "semantic", "rival_gap", "contradiction", *METRICS]).fillna(False, ["negative"]), "candidates")
    entity, s, v, g, cnt = (F.col(c) for c in ("entity", "semantic", "validator", "g_value", "support_count"))
    whole = Window.partitionBy("column_name")
    of = lambda name, c: F.coalesce(F.max(F.when(entity == name, F.col(c))).over(whole), F.lit(0.0))
    df = df.withColumns({f"place_{c}": of("Location", c) for c in ("union_weighted", "ner_weighted", "union_raw", "ner_raw", "row_unaddressed")} | {"address_union": of("Address", "union_weighted"), "org_union": of("Organization", "union_weighted")})

    # Places count for addresses, for recognisers call whole addresses places.
    address, place = _is("Address"), _is("Location")
    df = df.withColumn("related", F.when(address, F.col("place_union_weighted")).when(place, F.col("address_union")).otherwise(0.0))
    df = df.withColumns({c: F.when(address & (F.col("related") > 0), F.greatest(F.col(c), 0.72 * F.col(f"place_{c}"))).otherwise(F.col(c)) for c in ("union_weighted", "ner_weighted", "union_raw", "ner_raw")})
    df = df.withColumn("row_support", F.col("row_support") + F.when(address & (F.col("name_address") >= 0.55), F.col("place_row_unaddressed")).otherwise(0.0))

    context = F.least("g_context", F.lit(0.70))
    df = df.withColumns({
        "threshold": _threshold(entity),
        "kind": _kind(entity, profile),
        "g_effective": F.when(_is(*NATURAL), F.least(F.lit(1.0), 0.90 * g + 0.10 * context)).when(_is(*OPAQUE), F.least(F.lit(0.22), 0.90 * g + 0.04 * context)).otherwise(F.least(F.lit(0.45), 0.88 * g + 0.07 * context)),
        "collision": F.least(F.lit(0.32), 0.30 * F.col("rival_gap") * F.when(v >= 0.95, 0.55).otherwise(1.0)),
    })
    df = df.withColumn("score", _base_score())
    score, rows_share, union_raw, ge = F.col("score"), F.col("row_support"), F.col("union_raw"), F.col("g_effective")
    negative, agreement, specificity = F.col("negative"), F.col("agreement"), F.col("specificity")

    def plus(condition: Column, amount: Column) -> None:
        nonlocal df
        df = df.withColumn("score", score + F.when(condition, amount).otherwise(0.0))

    def times(condition: Column, factor: float) -> None:
        nonlocal df
        df = df.withColumn("score", score * F.when(condition, factor).otherwise(1.0))

    def at_least(condition: Column, floor: Column) -> None:
        nonlocal df
        df = df.withColumn("score", F.when(condition, F.greatest(score, floor)).otherwise(score))

    one = F.lit(1.0)
    plus(_is("Address", "Location") & (F.col("related") > 0), 0.08 * F.least(one, F.col("related") / 0.40))
    plus(F.lit(True), 0.04 * F.least(one, rows_share / 0.50) - F.col("contradiction") - F.col("collision"))
    plus(_is("Person Name") & (F.col("org_union") >= 0.20) & (s < 0.60), -F.least(F.lit(0.20), 0.24 * F.col("org_union")))
    plus(v.isNotNull() & (F.col("kind") == "BASIC_STRUCTURE"), -0.05 * v)
    plus(v.isNotNull() & (F.col("kind") == "STRICT_FORMAT") & (s < 0.55) & (g < 0.50), -0.04 * v)
    times((F.col("regex_raw") > 0) & (specificity < 0.50) & (s < 0.55) & (ge < 0.35), 0.58)
    sparse_phone = _is("Phone Number") & (cnt >= 1) & F.coalesce(v >= 0.95, F.lit(False)) & (specificity >= 0.70) & ~negative & ((s >= 0.55) | (g >= 0.60) | (agreement >= 0.50))
    times((cnt == 1) & (F.col("distinct_values") >= 20) & (s < 0.55) & (ge < 0.45) & ~sparse_phone, 0.62)

    # Gates of single entities: a reason to reject, or a factor or bonus. The reasons' texts.
    weak_name = (s < 0.55) & (g < 0.50)
    below = lambda x: F.coalesce(v < x, F.lit(False))
    reject = (
        F.when(_is("Aadhaar Number") & below(0.80), "Aadhaar candidates fail Verhoeff validation.")
        .when(_is("PAN Number") & negative & weak_name, "PAN-shaped values contradicted by code/token semantics.")
        .when(_is("PAN Number") & below(0.95), "PAN candidates fail strict format validation.")
        .when(_is("Credit Card Number") & F.coalesce(v < 0.85, F.lit(True)), "Credit-card candidates lack sufficient Luhn-valid support.")
        .when(_is("Date of Birth") & (s < 0.55), "Valid date structure lacks birth-related column semantics.")
        .when(_is("Date of Birth") & below(0.70), "Birth-date candidates fail date plausibility validation.")
        .when(_is("Bank Account Number") & weak_name, "Long numeric pattern lacks bank-account semantics.")
        .when(_is("Phone Number") & negative & weak_name, "Phone-shaped values contradicted by identifier/sequence semantics.")
        .when(_is("IP Address") & negative & weak_name, "IP-shaped values contradicted by version/build semantics.")
        .when(_is("IP Address") & below(0.90), "IP candidates fail deterministic parsing.")
    )
    df = df.withColumn("hard_reject", reject)
    free = F.col("hard_reject").isNull()
    rate = F.coalesce(v, F.lit(0.0))
    structured = F.greatest("exact_support", "structure")
    alone = (s < 0.50) & (g < 0.45) & (agreement < 0.30)
    licensed, known_passport = (F.col("name_license") >= 0.70) & (s < 0.70), F.col("name_passport") >= 0.60
    shaped = (s >= 0.70) & (union_raw >= 0.40) & ((F.col("exact_support") >= 0.30) | (F.col("structure") >= 0.60))
    times(free & _is("Aadhaar Number") & (s < 0.55) & (rate < 0.95), 0.65)
    plus(free & _is("Date of Birth") & (s >= 0.70) & (union_raw >= 0.20) & (rate >= 0.90) & (rows_share >= 0.20), 0.06 * F.least(one, union_raw) * F.least(one, rows_share))
    times(_is("Passport Number") & licensed, 0.42)
    plus(_is("Passport Number") & ~licensed & shaped, 0.08 * F.least(one, union_raw) * structured)
    times(_is("Passport Number") & ~licensed & ~shaped & alone, 0.52)
    times(_is("Driver License Number") & known_passport, 0.38)
    times(_is("Driver License Number") & ~known_passport & alone, 0.52)
    times(free & _is("Phone Number") & (s < 0.50) & (g < 0.35) & (agreement < 0.25), 0.68)

    # Rescues.
    checked = F.when(F.col("kind") == "CHECKSUM", (s >= 0.55) | (g >= 0.50) | (cnt >= 2)).when(_is("Email Address", "MAC Address", "IBAN", "IFSC Code", "Crypto Wallet Address"), (g >= 0.50) | (cnt >= 2)).otherwise((s >= 0.55) | (g >= 0.75))
    sparse = _is(*SPARSE) & (rows_share > 0) & (rows_share <= 0.10) & (cnt >= 1) & (rate >= 0.95) & (specificity >= 0.85) & ~negative & checked
    at_least(free & (sparse | sparse_phone), F.col("threshold") + 0.05)
    before = F.col("threshold")
    if not policy.own_thresholds:
        before = F.coalesce(F.lag("threshold").over(whole.orderBy("entity")), F.col("threshold"))
    at_least(free & _is("Passport Number") & (s >= 0.70) & (union_raw >= 0.20) & ((F.col("structure") >= 0.60) | (F.col("exact_support") >= 0.20)), before)
    at_least(free & _is("Date of Birth") & (s >= 0.70) & (rate >= 0.90) & (union_raw >= 0.10), F.col("threshold") + 0.02)
    times(F.col("generic") & _is("Phone Number", "Bank Account Number", "Aadhaar Number", "Credit Card Number", "Date of Birth"), 0.50)
    plus(address & (s >= 0.75), F.lit(0.10))
    plus(address & (s >= 0.75) & (F.col("related") >= 0.20), 0.10 * F.least(one, F.col("related") / 0.60) + 0.05 * F.least(one, rows_share / 0.50))
    plus(place & (F.col("name_address") >= 0.75), F.lit(-0.20))
    plus(_is("Organization") & (s >= 0.70), F.lit(0.10))
    plus(_is("Organization") & (F.col("ner_raw") >= 0.50) & (g >= 0.30), 0.10 * F.least(one, F.col("ner_raw")))

    # Policy.
    refused = [e for e in IDENTIFIERS if not policy.identifiers.get(e, True)]
    excluded = (place & F.col("coarse_place") & (not policy.coarse_locations)) | (_is("Organization") & (not policy.organizations)) | (_is(*refused) if refused else F.lit(False))
    wanted = [e for e in IDENTIFIERS if policy.identifiers.get(e, True)]
    certain = ((s >= 0.75) & (F.col("regex_raw") >= 0.20) & (specificity >= 0.85)) | ((F.col("regex_raw") >= 0.50) & (specificity >= 0.85)) | ((s >= 0.80) & (g >= 0.55))
    df = df.withColumns({"policy_excluded": excluded, "policy_positive": (_is(*wanted) if wanted else F.lit(False)) & certain})
    at_least(free & F.col("policy_positive"), F.col("threshold") + 0.05)
    df = df.withColumn("score", F.least(one, F.greatest(F.lit(0.0), score)))
    corroborated = _is("Organization") & (F.col("ner_raw") >= 0.50) & (rows_share >= 0.40) & ((g >= 0.30) | (s >= 0.70))
    df = df.withColumn("detected", free & ((score >= F.col("threshold")) | F.col("policy_positive") | corroborated))
    return df.withColumn("accepted", F.col("detected") & ~F.col("policy_excluded"))


def secondary() -> Column:
    """Whether an entity that isn't accepted still belongs in the set of entities that a column holds."""
    s, v, g, cnt = F.col("semantic"), F.coalesce("validator", F.lit(0.0)), F.col("g_value"), F.col("support_count")
    part = lambda share: F.floor(F.col("distinct_values") * share)
    checked = (cnt >= 2) & (v >= 0.95) & (F.col("specificity") >= 0.85)
    phone = ((cnt >= F.greatest(F.lit(3), part(0.05))) & (F.col("union_raw") >= 0.05) & (s >= 0.55)) | (
        (cnt >= F.greatest(F.lit(5), part(0.10))) & (F.col("agreement") >= 0.50) & (v >= 0.90) & ~F.col("negative")
    )
    person = (cnt >= F.greatest(F.lit(5), part(0.10))) & (F.col("ner_raw") >= 0.15) & (F.col("row_support") >= 0.10) & ((s >= 0.55) | (g >= 0.45)) & ~F.col("negative")
    where = (cnt >= F.greatest(F.lit(3), part(0.05))) & (F.col("ner_raw") >= 0.10) & ((g >= 0.25) | (s >= 0.70))
    rule = F.when(_is("Email Address", "Credit Card Number", "Aadhaar Number", "IBAN", "MAC Address"), checked).when(_is("Phone Number"), phone).when(_is("Person Name"), person).when(_is("Address", "Location"), where).otherwise(False)
    return F.col("hard_reject").isNull() & (F.col("accepted") | rule)
