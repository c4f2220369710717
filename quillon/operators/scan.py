"""Pattern scans of values, and the evidence of each distinct value."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from datetime import date
from functools import partial, reduce
from operator import or_

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.fixed import GRADE_WEIGHT, LONG_VALUE, NER_RELIABILITY_ELSE, V16, Pattern, Profile
from quillon.functions.text import beyond_ascii, constants, truncated
from quillon.functions.validators import validator, verdict
from quillon.work import stash

ENTITY = (
    "struct<entity:string, ner:int, regex:int, ner_score:double, regex_score:double, matches:int, weight:int, exact:boolean, "
    "passed:boolean, failed:boolean, top:double>"
)
# ner, regex: reliability in hundredths, 0 without a detection, so that sums over partitions are exact; weight: sum over matches
# of the grade's weight in hundredths; exact: a strict or moderate pattern matched; passed, failed: some verdict was so (null: none).


#: What a text must hold for a pattern to match: any of some strings, or a field of ``_flags`` (digits in a row, for most).
#: A cheap test, which spares most texts most patterns.
_NEEDS: dict[str, tuple[str, ...] | str] = {
    "email": ("@",), "ipv4": "dotted", "ipv6_full": (":",), "ifsc": ("0",), "mac_colon": (":",), "mac_hyphen": ("-",), "btc_legacy": ("1", "3"), "eth": ("0x",),
    "dob_iso": "two", "dob_dmy": "two", "employee_id": ("EMP", "STAFF"), "customer_id": ("CUST", "CLIENT"), "user_id": ("USR", "USER"),
    "contract_number": ("CTR", "CONTRACT", "AGR"), "device_serial": ("SN", "SERIAL", "DEV"),
}


def _flags(value: Column) -> Column:
    return F.struct(
        (~beyond_ascii(value)).alias("ascii"),
        value.rlike(r"\p{Nd}{2}").alias("two"),
        value.rlike(r"\p{Nd}{3}").alias("three"),
        value.rlike(r"\p{Nd}\.\p{Nd}").alias("dotted"),
    )


def with_flags(value: Column, make: Callable[[Column], Column]) -> Column:
    """``make(flags)`` with the flags of the value bound to a variable, so that they are found once."""
    return F.get(F.transform(F.array(_flags(value)), make), F.lit(0))


def matches(value: Column, pattern: Pattern, flags: Column) -> Column:
    """All non-overlapping matches, with word edges and classes as for Unicode, which differ beyond ASCII only."""
    needs = _NEEDS.get(pattern.name, "three")
    may = flags[needs] if isinstance(needs, str) else reduce(or_, [F.contains(value, F.lit(n)) for n in needs])
    found = lambda regex: F.regexp_extract_all(value, F.lit(regex), F.lit(0))
    return F.when(~may, F.array().cast("array<string>")).when(flags["ascii"], found(pattern.regex)).otherwise(found(f"(?U){pattern.regex}"))


def spread(df: DataFrame) -> DataFrame:
    """Rows dealt evenly to all cores: patterns cost far more for each byte than a shuffle, and small files have few parts."""
    n = max(df.sparkSession.sparkContext.defaultParallelism, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return df.repartition(n)


def match_rows(df: DataFrame, column: str = "value", as_of: date | None = None, profile: Profile = V16, patterns: tuple[str, ...] | None = None) -> DataFrame:
    """``df`` with a row for each match: entity, pattern, score, span, validator_pass (null without a validator)."""

    def as_struct(p: Pattern, span: Column) -> Column:
        passed = validator(p.entity, span, as_of, profile)
        passed = F.lit(None).cast("boolean") if passed is None else passed
        return F.struct(F.lit(p.entity).alias("entity"), F.lit(p.name).alias("pattern"), F.lit(p.score).alias("score"), span.alias("span"), passed.alias("validator_pass"))

    chosen = [p for p in profile.patterns if patterns is None or p.name in patterns]
    value = F.col(column)
    parts = lambda flags: F.flatten(F.array(*[F.transform(matches(value, p, flags), partial(as_struct, p)) for p in chosen]))
    return df.select("*", F.inline(with_flags(value, parts)))


def match_spans(df: DataFrame, column: str = "value", profile: Profile = V16, patterns: tuple[str, ...] | None = None) -> DataFrame:
    """``df`` with a row for each match of the patterns (all by default) and its place (start, end in code points), for those who need places."""
    compiled = [(p.entity, p.name, p.score, re.compile(p.regex)) for p in profile.patterns if patterns is None or p.name in patterns]
    names = df.columns

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [
                (*row, entity, name, score, m.group(), m.start(), m.end())
                for row, text in zip(pdf.itertuples(index=False, name=None), pdf[column])
                if text
                for entity, name, score, pattern in compiled
                for m in pattern.finditer(text)
            ]
            yield pd.DataFrame(rows, columns=[*names, "entity", "pattern", "score", "span", "start", "end"])

    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    return df.mapInPandas(scan, f"{kept}, entity string, pattern string, score double, span string, start int, end int")


def _lookup(values: list, key: Column) -> Column:
    return F.get(constants(values), key)


def _hits(value: Column, place: int, p: Pattern, flags: Column, as_of: date | None, profile: Profile) -> Column:
    """Array of one struct: the pattern's place, its number of matches, and whether any verdict is true, any false.

    Matches become their verdicts, and these are bound to a variable, so that the pattern stands in the
    plan, and runs, once.
    """
    known = p.entity in profile.validators
    spans = matches(value, p, flags)
    verdicts = F.transform(spans, lambda m: validator(p.entity, m, as_of, profile)) if known else spans

    def counted(found: Column) -> Column:
        none = F.lit(None).cast("boolean")
        any_is = lambda test: F.when(F.size(found) > 0, F.exists(found, test)) if known else none
        return F.struct(F.lit(place).alias("p"), F.size(found).alias("n"), any_is(lambda v: v).alias("passed"), any_is(lambda v: ~v).alias("failed"))

    return F.transform(F.array(verdicts), counted)


def regex_entities(value: Column, as_of: date | None, profile: Profile) -> Column:
    """Array of ENTITY, one for each entity with a match in the value; no row is made for a match."""
    table = profile.patterns
    all_ = lambda flags: F.flatten(F.array(*[_hits(value, i, p, flags, as_of, profile) for i, p in enumerate(table)]))
    hits = F.filter(with_flags(value, all_), lambda h: h["n"] > 0)
    entity = partial(_lookup, [p.entity for p in table])
    reliability = partial(_lookup, [round(p.reliability * 100) for p in table])
    strength = partial(_lookup, [p.score * p.reliability for p in table])
    score = partial(_lookup, [p.score for p in table])
    weight = partial(_lookup, [round(GRADE_WEIGHT[p.grade] * 100) for p in table])
    exact = partial(_lookup, [p.grade != "broad" for p in table])

    def summed(name: Column, own: Column) -> Column:
        most = lambda of: F.array_max(F.transform(own, of))
        total = lambda of: F.aggregate(own, F.lit(0), lambda acc, h: acc + of(h))
        return F.struct(
            name.alias("entity"), F.lit(0).alias("ner"), most(lambda h: reliability(h["p"])).alias("regex"), F.lit(0.0).alias("ner_score"),
            most(lambda h: strength(h["p"])).alias("regex_score"), total(lambda h: h["n"]).alias("matches"), total(lambda h: h["n"] * weight(h["p"])).alias("weight"),
            F.exists(own, lambda h: exact(h["p"])).alias("exact"), most(lambda h: h["passed"]).alias("passed"), most(lambda h: h["failed"]).alias("failed"),
            most(lambda h: score(h["p"])).alias("top"),
        )

    def by_entity(all_hits: Column) -> Column:
        names = F.array_distinct(F.transform(all_hits, lambda h: entity(h["p"])))
        return F.transform(names, lambda name: summed(name, F.filter(all_hits, lambda h: entity(h["p"]) == name)))

    return F.get(F.transform(F.array(hits), by_entity), F.lit(0)).cast(f"array<{ENTITY}>")


def scanned_values(values: DataFrame, profile: Profile = V16) -> DataFrame:
    """A dictionary's values as they are scanned: long ones cut, and counted without rows, for no row has the cut text."""
    long = F.length("value") > LONG_VALUE
    cut = values.filter(long).select("column_name", truncated(F.col("value"), profile.cut_mark).alias("value")).distinct()
    return values.filter(~long).select("column_name", "value", "rows").unionByName(cut.withColumn("rows", F.lit(0).cast("long")))


def scan_table(values: DataFrame, as_of: date | None = None, profile: Profile = V16) -> DataFrame:
    """Every value of a dictionary with its entities: (column_name, value, rows, long, entities), in one projection without a shuffle.

    ``value`` is as it was scanned, and null where nothing was found, so that a written table holds no more text than it must.
    """
    found = values.select("column_name", "rows", (F.length("value") > LONG_VALUE).alias("long"), truncated(F.col("value"), profile.cut_mark).alias("value"))
    found = found.select("column_name", "value", "rows", "long", regex_entities(F.col("value"), as_of, profile).alias("entities"))
    return found.withColumn("value", F.when(F.size("entities") > 0, F.col("value")))


def evidence_of(scanned: DataFrame) -> DataFrame:
    """(column_name, value, rows, entities) of the values of a scan table with a match; cut values count once, without rows."""
    found = scanned.filter(F.size("entities") > 0)
    cut = found.filter("long").dropDuplicates(["column_name", "value"]).withColumn("rows", F.lit(0).cast("long"))
    return found.filter(~F.col("long")).unionByName(cut).drop("long")


def regex_evidence(values: DataFrame, as_of: date | None = None, profile: Profile = V16) -> DataFrame:
    """(column_name, value, rows, entities): values of a dictionary with a match.

    The scan is written before it is filtered, else Spark would run all patterns in the filter as well.
    """
    return evidence_of(stash(scan_table(values, as_of, profile), "scanned"))


def ner_entities(detections: DataFrame, as_of: date | None = None, profile: Profile = V16) -> DataFrame:
    """ENTITY columns of named-entity detections (column_name, value, entity, score, start, end), by value and entity.

    Spans are cut from the value for the validators; places are code points from 0.
    """
    span = F.substring(F.col("value"), F.col("start") + 1, F.col("end") - F.col("start"))
    known = F.create_map(*[F.lit(x) for pair in profile.ner_reliability.items() for x in pair])
    reliability = F.coalesce(F.element_at(known, F.col("entity")), F.lit(NER_RELIABILITY_ELSE))
    passed = verdict(F.col("entity"), span, as_of, profile)
    rows = detections.withColumns({"reliability": reliability, "passed": passed})
    return rows.groupBy("column_name", "value", "entity").agg(
        F.max(F.round(F.col("reliability") * 100).cast("int")).alias("ner"), F.lit(0).alias("regex"), F.max(F.col("score") * F.col("reliability")).alias("ner_score"),
        F.lit(0.0).alias("regex_score"), F.lit(0).alias("matches"), F.lit(0).alias("weight"), F.lit(False).alias("exact"),
        F.max("passed").alias("passed"), F.max(~F.col("passed")).alias("failed"), F.max("score").alias("top"),
    )


def with_ner(found: DataFrame, values: DataFrame, ner: DataFrame, as_of: date | None = None, profile: Profile = V16) -> DataFrame:
    """Evidence from patterns (``found``) and named-entity detections on the scanned values of a dictionary."""
    both = found.select("column_name", "value", F.inline("entities")).unionByName(ner_entities(ner, as_of, profile))
    tops = ("ner", "regex", "ner_score", "regex_score", "matches", "weight", "exact", "passed", "failed", "top")
    merged = both.groupBy("column_name", "value", "entity").agg(*[F.max(c).alias(c) for c in tops])
    by_value = merged.groupBy("column_name", "value").agg(F.array_sort(F.collect_list(F.struct("entity", *tops))).alias("entities"))
    return scanned_values(values, profile).join(by_value, ["column_name", "value"]).select("column_name", "value", "rows", F.col("entities").cast(f"array<{ENTITY}>").alias("entities"))


def has_source(source: str) -> Column:
    return F.exists("entities", lambda e: e[source] > 0)


def agree() -> Column:
    return F.exists("entities", lambda e: (e["ner"] > 0) & (e["regex"] > 0))


def priority(profile: Profile = V16) -> Column:
    """Sampling priority of a value: its strongest detection, more if both sources found something, and the same."""
    both = has_source("ner") & has_source("regex")
    value = F.array_max(F.transform("entities", lambda e: F.greatest(e["ner_score"], e["regex_score"])))
    value = value + F.when(both, 0.55).otherwise(0.0) + F.when(agree(), 0.35).otherwise(0.0)
    if profile.rich_priority:
        top = F.array_max(F.transform("entities", lambda e: e["top"]))
        value = value + F.when(both & ~agree(), 0.30).otherwise(0.0)
        value = value + F.when(F.exists("entities", lambda e: F.coalesce(e["passed"], F.lit(False))), 0.30).otherwise(0.0)
        value = value + F.when(F.exists("entities", lambda e: F.coalesce(e["failed"], F.lit(False))), 0.22).otherwise(0.0)
        value = value + F.when((top >= 0.35) & (top <= 0.72), 0.15).otherwise(0.0)
    return value
