"""The whole plan: profile every column of a table for personal data, in one job for all columns."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager
from dataclasses import dataclass
from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.fixed import V16, Profile
from quillon.operators.cells import as_strings, column_sizes, dictionary
from quillon.operators.decide import OLD_RESULT, RESULT, decisions, results
from quillon.operators.metrics import candidate_text, entity_metrics
from quillon.operators.sampling import sample_coverage, stratified_sample
from quillon.operators.scan import evidence_of, scan_table, scanned_values, with_ner
from quillon.operators.scoring import Policy, candidates, name_tables, profiles
from quillon.operators.zero_shot import zero_shot_metrics
from quillon.work import stash

#: A provider takes rows (column_name, value) and gives detections or predictions of them.
Provider = Callable[[DataFrame], DataFrame]


@dataclass
class Profiled:
    """The tables of a profile."""

    values: DataFrame
    evidence: DataFrame
    metrics: DataFrame
    samples: DataFrame
    scored: DataFrame
    decided: DataFrame
    results: DataFrame


def profile_tables(
    df: DataFrame, columns: Sequence[str] | None = None, ner: DataFrame | Provider | None = None, zero_shot: DataFrame | Provider | None = None, policy: Policy | None = None,
    profile: Profile = V16, samples: int | None = None, as_of: date | None = None,
) -> Profiled:
    """``ner``: detections (column_name, value, entity, score, start, end) or their provider, which gets all scanned values.

    ``zero_shot``: predictions (column_name, value, view, entity, score, inference_ok) or their provider, which
    gets the samples. Without them these parts of the evidence are zero, and their times null. ``as_of`` is the
    day for ages. Times are those of the written tables of each stage: reading and patterns, named entities,
    zero-shot, and metrics, samples and scores.
    """
    if profile.max_samples and samples is not None and not 1 <= samples <= profile.max_samples:
        raise ValueError(f"samples must be 1 to {profile.max_samples}")
    spark = df.sparkSession
    seconds: dict[str, float] = {}

    @contextmanager
    def timed(stage: str) -> Iterator[None]:
        start = time.perf_counter()
        yield
        seconds[stage] = seconds.get(stage, 0.0) + time.perf_counter() - start

    names = as_strings(df, columns).columns
    values = dictionary(df, columns)
    with timed("regex"):
        if ner is not None:
            values = stash(values, "values")  # a provider's detections are joined with them
        # Patterns are run once: what follows reads the table of what they found.
        scanned = stash(scan_table(values, as_of, profile), "scanned")
    sizes = column_sizes(scanned)
    found = evidence_of(scanned)
    if ner is not None:
        with timed("ner"):
            detections = ner(scanned_values(values, profile).select("column_name", "value")) if callable(ner) else ner
            found = stash(with_ner(found, values, detections, as_of, profile), "evidence")
    with timed("aggregation"):
        metrics = stash(entity_metrics(found, sizes), "metrics")
        chosen = stash(stratified_sample(found, samples, profile), "samples")
    if callable(zero_shot):
        with timed("zero_shot"):
            zero_shot = stash(zero_shot(chosen), "predictions")  # a model runs once
    by_entity, by_column = name_tables(spark, names, profile)
    rows = candidates(metrics, by_entity, zero_shot)
    confirmed = None if zero_shot is None else zero_shot_metrics(rows, chosen, zero_shot)
    with timed("aggregation"):
        scored = stash(profiles(rows, metrics, by_entity, by_column.join(sizes, "column_name"), confirmed, policy, profile), "scored")
    decided = decisions(scored, candidate_text(metrics))
    places = spark.createDataFrame([(c, i) for i, c in enumerate(names)], "column_name string, place int").join(sizes, "column_name", "left")
    out = results(places, decided, sample_coverage(chosen, metrics, found), profile, seconds)
    return Profiled(values, found, metrics, chosen, scored, decided, out)


def profile_table(df: DataFrame, columns: Sequence[str] | None = None, profile: Profile = V16, **options) -> DataFrame:
    """One row for each column: RESULT, or OLD_RESULT for the older profile."""
    out = profile_tables(df, columns, profile=profile, **options).results
    return out.select(*(RESULT if profile.name == "v16" else OLD_RESULT))
