"""Stratified samples against a greedy choice over all the evidence, without the limits that the operator puts before its shuffle."""

import itertools
import random

import pytest

from quillon.fixed import V13, V16
from quillon.operators.sampling import sample_coverage, stratified_sample
from quillon.operators.scan import ENTITY

NAMES = ("Email Address", "Phone Number", "Person Name", "Location", "IP Address")


def shape(value):
    kinds = ["9" if c.isdigit() else "A" if c.isupper() else "a" if c.islower() else c for c in value.strip()]
    runs = [(k, len(list(g))) for k, g in itertools.groupby(kinds)]
    return "".join(f"{k}{{{n}}}" if n > 2 and k in "9Aa" else k * n for k, n in runs)[:100]


def priority(row, rich):
    found = row["entities"]
    ner, regex, agree = any(e["ner"] for e in found), any(e["regex"] for e in found), any(e["ner"] and e["regex"] for e in found)
    more = [(ner and regex, 0.55), (agree, 0.35)]
    if rich:
        more += [(ner and regex and not agree, 0.30), (any(e["passed"] for e in found), 0.30), (any(e["failed"] for e in found), 0.22), (0.35 <= max(e["top"] for e in found) <= 0.72, 0.15)]
    out = max(max(e["ner_score"], e["regex_score"]) for e in found)
    for holds, extra in more:  # one after the other: ties depend on how sums are rounded
        out += extra if holds else 0.0
    return out


def plain_choice(rows, k, profile):
    ranked = sorted(rows, key=lambda r: (-priority(r, profile.rich_priority), r["value"]))
    if len(ranked) <= k:
        return [r["value"] for r in ranked]
    strength = lambda r, name: max((max(e["ner_score"], e["regex_score"]) for e in r["entities"] if e["entity"] == name), default=0.0)
    chosen, used = [], {}

    def first(rows, many, cap):
        for r in rows:
            if many == 0 or len(chosen) == k:
                break
            if r["value"] not in chosen and used.get(shape(r["value"]), 0) < cap:
                chosen.append(r["value"])
                used[shape(r["value"])] = used.get(shape(r["value"]), 0) + 1
                many -= 1

    best = {n: max(strength(r, n) for r in ranked) for n in {e["entity"] for r in ranked for e in r["entities"]}}
    for name in sorted(best, key=lambda n: (-best[n], n)):
        first([r for r in ranked if strength(r, name) >= 0.28], 1, 2)
    kinds = lambda r: (any(e["ner"] for e in r["entities"]), any(e["regex"] for e in r["entities"]), any(e["ner"] and e["regex"] for e in r["entities"]))
    for wanted in (lambda n, x, a: n and x and a, lambda n, x, a: n and x and not a, lambda n, x, a: n and not x, lambda n, x, a: not n):
        first([r for r in ranked if wanted(*kinds(r))], 1, 2)
    if profile.capped_fill:
        first(ranked, k, 2)
    first(ranked, k, 10**9)
    return chosen


def evidence(rng, n):
    rows = {}
    for _ in range(n):
        value = rng.choice(["user{}@x.org", "{}-{}", "Name {}", "{}", "AB{}", "x{}y{}"]).format(rng.randint(0, 9999), rng.randint(0, 99))
        found = []
        for name in rng.sample(NAMES, rng.choice([1, 1, 1, 2, 3])):
            ner, regex = rng.choice([(0, 70), (80, 0), (80, 70), (0, 90)])
            score = lambda on: rng.choice([0.1, 0.27, 0.28, 0.3, 0.5, 0.5, 0.9]) if on else 0.0
            verdict = rng.choice([(None, None), (True, False), (False, True)])
            found.append({"entity": name, "ner": ner, "regex": regex, "ner_score": score(ner), "regex_score": score(regex), "matches": 1, "weight": 72, "exact": True, "passed": verdict[0], "failed": verdict[1], "top": rng.choice([0.2, 0.35, 0.72, 0.9])})
        rows[value] = {"value": value, "rows": rng.randint(1, 5), "entities": found}
    return list(rows.values())


@pytest.mark.parametrize("profile", [V16, V13], ids=["v16", "v13"])
def test_samples_are_those_of_the_plain_choice(spark, profile):
    rng = random.Random(2)
    columns = {f"c{i}": evidence(rng, rng.choice([1, 5, 14, 15, 16, 20, 21, 60, 400])) for i in range(40)}
    data = [(c, r["value"], r["rows"], [tuple(e.values()) for e in r["entities"]]) for c, rows in columns.items() for r in rows]
    found = spark.createDataFrame(data, f"column_name string, value string, rows long, entities array<{ENTITY}>").repartition(5).cache()
    for k in (profile.samples, 6):
        got = {}
        for r in stratified_sample(found, k, profile).orderBy("column_name", "place").collect():
            got.setdefault(r.column_name, []).append(r.value)
            own = next(x for x in columns[r.column_name] if x["value"] == r.value)
            assert r.priority == pytest.approx(priority(own, profile.rich_priority)) and r.entities == sorted(e["entity"] for e in own["entities"])
        assert got == {c: plain_choice(rows, k, profile) for c, rows in columns.items()}


def test_coverage_counts_entities_of_enough_support(spark):
    samples = spark.createDataFrame([("a", ["X", "Y"]), ("a", ["X"]), ("b", ["Z"])], "column_name string, entities array<string>")
    found = spark.createDataFrame([("a", str(i)) for i in range(50)] + [("b", "1"), ("c", "1")], "column_name string, value string")
    metrics = spark.createDataFrame([("a", "X", 4000), ("a", "Y", 399), ("a", "W", 400), ("b", "Z", 100), ("c", "Q", 7)], "column_name string, entity string, best_hundredths long")
    out = {r.column_name: (r.covered, r.credible, r.coverage) for r in sample_coverage(samples, metrics, found).collect()}
    assert out == {"a": (1, 2, 0.5), "b": (1, 1, 1.0), "c": (0, 0, 1.0)}
