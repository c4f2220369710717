"""The decision layer against a plain scorer, one column and entity after the other, on metrics on both sides of every threshold."""

import math
import random

import pytest

from quillon.fixed import IDENTIFIERS, NATURAL, OPAQUE, SPARSE, V16
from quillon.operators.decide import decisions
from quillon.operators.scoring import Policy, profiles, secondary

ENTITIES = (
    "Person Name", "Address", "Location", "Organization", "Date of Birth", "Aadhaar Number", "Credit Card Number", "IBAN", "PAN Number", "IFSC Code", "MAC Address", "Email Address",
    "IP Address", "Crypto Wallet Address", "Bank Account Number", "Passport Number", "Driver License Number", "Phone Number", "Social Security Number", "Voter ID", "UK NHS Number", *IDENTIFIERS,
)
EDGES = [0.0, 0.02, 0.05, 0.1, 0.15, 0.2, 0.25, 0.3, 0.35, 0.4, 0.45, 0.5, 0.55, 0.6, 0.7, 0.75, 0.8, 0.85, 0.9, 0.95, 1.0]
WEIGHTED = ("union_weighted", "ner_weighted", "union_raw", "ner_raw")


def rate(rng):
    return rng.choice(EDGES) if rng.random() < 0.7 else max(0.0, min(1.0, rng.choice(EDGES) + rng.choice([-0.01, 0.01])))


def column(rng, name):
    few = rng.sample(ENTITIES, rng.randint(1, 5))
    if rng.random() < 0.3:
        few = list({*few, "Address", "Location"})
    facts = {"generic": rng.random() < 0.2, "coarse_place": rng.random() < 0.4, "name_address": rate(rng), "name_passport": rate(rng), "name_license": rate(rng), "distinct_values": rng.choice([5, 19, 20, 40, 100, 200])}
    rows = []
    for e in few:
        r = {"entity": e, "support_count": rng.choice([0, 1, 1, 2, 3, 5, 10, 20]), "negative": rng.random() < 0.15, "rival_gap": rng.choice([0.0, 0.0, rate(rng)]), "contradiction": rng.choice([0.0, 0.0, 0.1])}
        for c in ("semantic", "agreement", "specificity", "structure", "exact_support", "row_support", "row_unaddressed", "ner_raw", "regex_raw", "union_raw", "ner_weighted", "regex_weighted", "union_weighted", "g_value", "g_context", "g_consistency", "g_mean", "g_success"):
            r[c] = rate(rng)
        r["row_support"] = rng.choice([r["row_support"], 0.05, 0.1])
        r["validator"] = rng.choice([rate(rng), 0.95, 1.0]) if e in V16.validators else None
        rows.append(r)
    return {"column_name": name, **facts, "rows": rows}


def base(r, g):
    p, x, u = (min(1.0, r[c] / 0.5) for c in ("ner_weighted", "regex_weighted", "union_weighted"))
    s, a, c, v, e = r["semantic"], r["agreement"], r["g_consistency"], r["validator"], r["entity"]
    if e in NATURAL:
        score = 0.46 * p + 0.06 * u + 0.24 * s + 0.18 * g + 0.06 * c
    elif e == "Date of Birth":
        score = 0.10 * p + 0.24 * x + 0.08 * u + 0.34 * s + 0.10 * g + (0.14 * v if v is not None else 0)
    elif e in ("Aadhaar Number", "Credit Card Number", "IBAN"):
        score = 0.12 * p + 0.30 * x + 0.08 * u + 0.16 * s + 0.08 * a + 0.08 * g + (0.24 * v - 0.45 * (1 - v) if v is not None else 0)
    elif e in ("PAN Number", "IFSC Code", "MAC Address", "Email Address", "IP Address", "Crypto Wallet Address"):
        score = 0.16 * p + 0.30 * x + 0.08 * u + 0.18 * s + 0.08 * a + 0.08 * g + (0.12 * v - 0.24 * (1 - v) if v is not None else 0)
    elif e in ("Bank Account Number", "Passport Number", "Driver License Number", "Phone Number", "Social Security Number", "Voter ID"):
        score = 0.16 * p + 0.26 * x + 0.05 * u + 0.25 * s + 0.08 * a + 0.10 * g + (0.10 * v - 0.18 * (1 - v) if v is not None else 0)
    elif e in IDENTIFIERS:
        score = 0.10 * p + 0.24 * x + 0.10 * u + 0.38 * s + 0.12 * g
    else:
        score = 0.22 * p + 0.22 * x + 0.10 * u + 0.24 * s + 0.08 * a + 0.14 * g
    return max(0.0, min(1.0, score - (0.24 if r["negative"] else 0)))


THRESHOLD = {"Address": 0.58, "Location": 0.58, "Passport Number": 0.58, "PAN Number": 0.58, "Phone Number": 0.58, "Aadhaar Number": 0.62, "Credit Card Number": 0.62, "Bank Account Number": 0.68, "Driver License Number": 0.60}


def gate(r):
    """A reason to reject: any text."""
    e, s, g, v = r["entity"], r["semantic"], r["g_value"], r["validator"]
    vague = s < 0.55 and g < 0.5
    if e == "Aadhaar Number":
        return v is not None and v < 0.8
    if e == "PAN Number":
        return r["negative"] and vague or v is not None and v < 0.95
    if e == "Credit Card Number":
        return v is None or v < 0.85
    if e == "Date of Birth":
        return s < 0.55 or v is not None and v < 0.7
    if e == "Bank Account Number":
        return vague
    if e == "Phone Number":
        return r["negative"] and vague
    if e == "IP Address":
        return r["negative"] and vague or v is not None and v < 0.9
    return False


def score_column(col, policy):
    by = {r["entity"]: dict(r) for r in col["rows"]}
    place, address, org = (dict(by.get(e, {})) for e in ("Location", "Address", "Organization"))
    out = {}
    for e, r in by.items():
        r["related"] = place.get("union_weighted", 0.0) if e == "Address" else address.get("union_weighted", 0.0) if e == "Location" else 0.0
        if e == "Address" and r["related"] > 0:
            for c in WEIGHTED:
                r[c] = max(r[c], 0.72 * place[c])
        if e == "Address" and col["name_address"] >= 0.55:
            r["row_support"] += place.get("row_unaddressed", 0.0)
        s, v, g, gc, cnt, a, spec, row, raw = (r[c] for c in ("semantic", "validator", "g_value", "g_context", "support_count", "agreement", "specificity", "row_support", "union_raw"))
        capped = min(gc, 0.7)
        ge = min(1.0, 0.9 * g + 0.1 * capped) if e in NATURAL else min(0.22, 0.9 * g + 0.04 * capped) if e in OPAQUE else min(0.45, 0.88 * g + 0.07 * capped)
        threshold, kind = THRESHOLD.get(e, 0.56), V16.validators.get(e, ("NONE",))[0]
        r["collision"] = min(0.32, 0.30 * r["rival_gap"] * (0.55 if v is not None and v >= 0.95 else 1.0))
        score = base(r, ge)
        if e in ("Address", "Location") and r["related"] > 0:
            score += 0.08 * min(1.0, r["related"] / 0.4)
        score += 0.04 * min(1.0, row / 0.5) - r["contradiction"] - r["collision"]
        if e == "Person Name" and org.get("union_weighted", 0.0) >= 0.2 and s < 0.6:
            score -= min(0.2, 0.24 * org["union_weighted"])
        if v is not None and kind == "BASIC_STRUCTURE":
            score -= 0.05 * v
        if v is not None and kind == "STRICT_FORMAT" and s < 0.55 and g < 0.5:
            score -= 0.04 * v
        if r["regex_raw"] > 0 and spec < 0.5 and s < 0.55 and ge < 0.35:
            score *= 0.58
        phone = e == "Phone Number" and cnt >= 1 and v is not None and v >= 0.95 and spec >= 0.7 and not r["negative"] and (s >= 0.55 or g >= 0.6 or a >= 0.5)
        if cnt == 1 and col["distinct_values"] >= 20 and s < 0.55 and ge < 0.45 and not phone:
            score *= 0.62
        rejected = bool(gate(r))
        vague = s < 0.5 and g < 0.45 and a < 0.3
        if not rejected and e == "Aadhaar Number" and s < 0.55 and (v or 0) < 0.95:
            score *= 0.65
        if not rejected and e == "Date of Birth" and s >= 0.7 and raw >= 0.2 and (v or 0) >= 0.9 and row >= 0.2:
            score += 0.06 * min(1.0, raw) * min(1.0, row)
        if e == "Passport Number":
            shape = max(r["exact_support"], r["structure"])
            if col["name_license"] >= 0.7 and s < 0.7:
                score *= 0.42
            elif s >= 0.7 and raw >= 0.4 and (r["exact_support"] >= 0.3 or r["structure"] >= 0.6):
                score += 0.08 * min(1.0, raw) * shape
            elif vague:
                score *= 0.52
        if e == "Driver License Number":
            score *= 0.38 if col["name_passport"] >= 0.6 else 0.52 if vague else 1.0
        if not rejected and e == "Phone Number" and s < 0.5 and g < 0.35 and a < 0.25:
            score *= 0.68
        known = s >= 0.55 or g >= 0.5 or cnt >= 2 if kind == "CHECKSUM" else g >= 0.5 or cnt >= 2 if e in ("Email Address", "MAC Address", "IBAN", "IFSC Code", "Crypto Wallet Address") else s >= 0.55 or g >= 0.75
        sparse = e in SPARSE and 0 < row <= 0.1 and cnt >= 1 and v is not None and v >= 0.95 and spec >= 0.85 and not r["negative"] and known
        if not rejected:
            if sparse or phone:
                score = max(score, threshold + 0.05)
            if e == "Passport Number" and s >= 0.7 and raw >= 0.2 and (r["structure"] >= 0.6 or r["exact_support"] >= 0.2):
                score = max(score, threshold)
            if e == "Date of Birth" and s >= 0.7 and (v or 0) >= 0.9 and raw >= 0.1:
                score = max(score, threshold + 0.02)
        if col["generic"] and e in ("Phone Number", "Bank Account Number", "Aadhaar Number", "Credit Card Number", "Date of Birth"):
            score *= 0.5
        if e == "Address" and s >= 0.75:
            score += 0.1
            if r["related"] >= 0.2:
                score += 0.1 * min(1.0, r["related"] / 0.6) + 0.05 * min(1.0, row / 0.5)
        if e == "Location" and col["name_address"] >= 0.75:
            score -= 0.2
        if e == "Organization":
            score += 0.1 if s >= 0.7 else 0.0
            score += 0.1 * min(1.0, r["ner_raw"]) if r["ner_raw"] >= 0.5 and g >= 0.3 else 0.0
        excluded = e == "Location" and col["coarse_place"] and not policy.coarse_locations or e == "Organization" and not policy.organizations or e in IDENTIFIERS and not policy.identifiers[e]
        positive = e in IDENTIFIERS and policy.identifiers[e] and (s >= 0.75 and r["regex_raw"] >= 0.2 and spec >= 0.85 or r["regex_raw"] >= 0.5 and spec >= 0.85 or s >= 0.8 and g >= 0.55)
        if positive and not rejected:
            score = max(score, threshold + 0.05)
        score = max(0.0, min(1.0, score))
        backed = e == "Organization" and r["ner_raw"] >= 0.5 and row >= 0.4 and (g >= 0.3 or s >= 0.7)
        r["detected"] = not rejected and (score >= threshold or positive or backed)
        r["accepted"] = r["detected"] and not excluded
        r |= {"score": score, "threshold": threshold, "rejected": rejected, "excluded": excluded}
        u = col["distinct_values"]
        r["secondary"] = not rejected and (
            r["accepted"]
            or e in ("Email Address", "Credit Card Number", "Aadhaar Number", "IBAN", "MAC Address") and cnt >= 2 and (v or 0) >= 0.95 and spec >= 0.85
            or e == "Phone Number" and (cnt >= max(3, math.floor(0.05 * u)) and raw >= 0.05 and s >= 0.55 or cnt >= max(5, math.floor(0.1 * u)) and a >= 0.5 and (v or 0) >= 0.9 and not r["negative"])
            or e == "Person Name" and cnt >= max(5, math.floor(0.1 * u)) and r["ner_raw"] >= 0.15 and row >= 0.1 and (s >= 0.55 or g >= 0.45) and not r["negative"]
            or e in ("Address", "Location") and cnt >= max(3, math.floor(0.05 * u)) and r["ner_raw"] >= 0.1 and (g >= 0.25 or s >= 0.7)
        )
        out[e] = r
    return out


def decide(scored):
    ranked = sorted(scored.values(), key=lambda r: (-r["score"], r["entity"]))
    accepted, found = [r for r in ranked if r["accepted"]], [r for r in ranked if r["detected"]]
    adjudicated = (found or ranked)[0]
    primary = (accepted or [adjudicated])[0]
    held = []
    for r in ranked:
        context = r["entity"] == "Address" and r["related"] >= 0.2 and r["semantic"] >= 0.75 and r["g_context"] >= 0.45
        if (r["accepted"] or r["secondary"] or context) and (r["union_raw"] >= 0.05 or r["support_count"] >= 2 or r["related"] >= 0.2):
            held.append(r["entity"])
    strong = any(r["entity"] == "Address" and (r["accepted"] or r["semantic"] >= 0.7 and r["related"] >= 0.2) for r in ranked)
    if "Address" in held and strong and "Location" in held:
        held.remove("Location")
    others = [r for r in ranked if r["entity"] != primary["entity"] and (r["union_raw"] >= 0.03 or r["support_count"] >= 2 or r["g_value"] >= 0.35 or r["entity"] == "Address" and r["related"] >= 0.2)]
    runner = others[0] if others else None
    return {
        "Policy_Action": "PROTECT" if accepted else "DETECTED_EXCLUDED" if found else "NONE",
        "PII_Detected": bool(accepted), "Entity_Detected": bool(found), "Policy_PII": bool(accepted),
        "Final_Entity_Type": " | ".join(r["entity"] for r in accepted) or None,
        "Adjudicated_Entity": adjudicated["entity"] if found else None,
        "Primary_Entity": primary["entity"] if accepted or found else None,
        "Detected_Entity_Set": " | ".join(held) or None,
        "Evidence_Score": primary["score"], "Confidence_Score": primary["score"], "Decision_Margin": primary["score"] - primary["threshold"],
        "Presidio_Support": primary["ner_raw"], "Regex_Support": primary["regex_raw"], "Detector_Agreement": primary["agreement"], "Collision_Penalty": primary["collision"],
        "Weighted_Union_Support": primary["union_weighted"], "Weighted_Regex_Support": primary["regex_weighted"], "Weighted_Presidio_Support": primary["ner_weighted"],
        "Validator_Pass_Rate": primary["validator"], "GLiNER_Value_Confirmation": primary["g_value"], "GLiNER_Context_Confirmation": primary["g_context"],
        "Runner_Up_Entity": runner and runner["entity"], "Runner_Up_Score": runner and runner["score"],
        "Runner_Up_Margin": max(0.0, primary["score"] - runner["score"]) if runner else 1.0,
    }


MEASURES = ("support_count", "ner_raw", "regex_raw", "union_raw", "ner_weighted", "regex_weighted", "union_weighted", "agreement", "validator", "specificity", "structure", "exact_support", "row_support", "row_unaddressed")
ZERO_SHOT = ("g_value", "g_context", "g_consistency", "g_mean", "g_success")


@pytest.mark.parametrize("policy", [Policy(), Policy(coarse_locations=True, organizations=True, identifiers={e: i % 2 == 0 for i, e in enumerate(IDENTIFIERS)})])
def test_scores_and_decisions_by_the_plain_rules(spark, policy):
    rng = random.Random(7)
    columns = [column(rng, f"c{i}") for i in range(1500)]
    rows = [(c["column_name"], r) for c in columns for r in c["rows"]]
    frame = lambda names, kinds: spark.createDataFrame([(c, r["entity"], *[r[n] for n in names]) for c, r in rows], "column_name string, entity string, " + ", ".join(f"{n} {k}" for n, k in zip(names, kinds)))
    metrics = frame(MEASURES, ["long"] + ["double"] * 13)
    names = frame(("semantic", "negative", "rival_gap", "contradiction"), ["double", "boolean", "double", "double"])
    zero_shot = frame(ZERO_SHOT, ["double"] * 5)
    facts = ("generic", "coarse_place", "name_address", "name_passport", "name_license", "distinct_values")
    table = spark.createDataFrame([(c["column_name"], *[c[f] for f in facts]) for c in columns], "column_name string, generic boolean, coarse_place boolean, name_address double, name_passport double, name_license double, distinct_values long")
    scored = profiles(metrics.select("column_name", "entity"), metrics, names, table, zero_shot, policy).cache()
    want = {c["column_name"]: score_column(c, policy) for c in columns}
    kinds = set()
    for r in scored.withColumn("second", secondary()).collect():
        w = want[r.column_name][r.entity]
        assert r.score == pytest.approx(w["score"], abs=1e-9), (r.column_name, r.entity)
        assert (r.hard_reject is not None, r.detected, r.accepted, r.policy_excluded, r.threshold, r.second) == (w["rejected"], w["detected"], w["accepted"], w["excluded"], w["threshold"], w["secondary"]), (r.column_name, r.entity)
        kinds.add((r.entity, w["rejected"], w["detected"], w["accepted"]))
    assert len(kinds) >= 55  # gates and thresholds are met on both sides
    text = metrics.select("column_name").distinct().selectExpr("column_name", "'x' as candidates", "'y' as strongest")
    for r in decisions(scored, text).collect():
        for name, value in decide(want[r.Column_Name]).items():
            got = r[name]
            assert got == (pytest.approx(value, abs=6e-5) if isinstance(value, float) else value), (r.Column_Name, name, got, value)
