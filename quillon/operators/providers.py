"""Named-entity and zero-shot models as providers: models are loaded once in each Python worker."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.fixed import NER_IGNORED, NER_LABELS, NER_RENAMED, NER_WEAK_FACTOR, V16, ZERO_SHOT_PROMPTS
from quillon.functions.names import name_facts
from quillon.functions.text import normalize_value
from quillon.operators.zero_shot import context_prefix, predictions

_MODELS: dict[str, object] = {}


def _once(name: str, load: Callable[[], object]) -> object:
    if name not in _MODELS:
        _MODELS[name] = load()
    return _MODELS[name]


def ner_entity(label: str) -> str:
    """Entity of a recogniser's label; others become words with capitals."""
    return NER_LABELS.get(label, label.replace("_", " ").title())


def ner_provider(
    name: str, load: Callable[[], Callable[[str], list[tuple[str, float, int, int]]]], ignored: tuple[str, ...] = NER_IGNORED, renamed: dict[str, str] = NER_RENAMED, weak: tuple[str, ...] = (), factor: float = NER_WEAK_FACTOR
) -> Callable[[DataFrame], DataFrame]:
    """From a loader of a function text -> [(label, score, start, end)]. A text on which it fails has no detections.

    Labels in ``ignored`` are left out, those in ``renamed`` changed, and scores of labels in ``weak`` multiplied by ``factor``.
    """

    def provide(values: DataFrame) -> DataFrame:
        def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            find = _once(name, load)
            for pdf in batches:
                rows = []
                for column, value in zip(pdf["column_name"], pdf["value"]):
                    try:
                        found = find(value)
                    except Exception:  # noqa: BLE001  any failure of a model counts as nothing found
                        found = []
                    rows += [
                        (column, value, ner_entity(renamed.get(label, label)), float(score) * (factor if label in weak else 1.0), int(start), int(end))
                        for label, score, start, end in found
                        if label not in ignored
                    ]
                yield pd.DataFrame(rows, columns=["column_name", "value", "entity", "score", "start", "end"])

        return values.select("column_name", "value").mapInPandas(scan, "column_name string, value string, entity string, score double, start int, end int")

    return provide


def zero_shot_provider(name: str, load: Callable[[], Callable[[str, tuple[str, ...], float], list[dict]]], threshold: float = V16.zero_shot_threshold, fuzzy: bool = True) -> Callable[[DataFrame], DataFrame]:
    """From a loader of a function (text, labels, threshold) -> [{label, text, start, end, score}], run on two views of each sample.

    If a view fails, the sample's inference counts as failed and the other view's predictions stay.
    """
    fields = ["column_name", "value", "view", "label", "text", "start", "end", "offset", "score", "inference_ok"]

    def provide(samples: DataFrame) -> DataFrame:
        def infer(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            predict = _once(name, load)
            for pdf in batches:
                rows = []
                for column, value in zip(pdf["column_name"], pdf["value"]):
                    prefix = context_prefix(column, name_facts(column, fuzzy).meaning)
                    for view, before in (("value", ""), ("context", prefix)):
                        try:
                            found = predict(before + value, ZERO_SHOT_PROMPTS, threshold)
                            rows.append((column, value, view, None, None, None, None, len(before), None, True))
                            rows += [(column, value, view, normalize_value(str(e["label"])), normalize_value(str(e.get("text", ""))), e.get("start"), e.get("end"), len(before), float(e["score"]), True) for e in found]
                        except Exception:  # noqa: BLE001
                            rows.append((column, value, view, None, None, None, None, len(before), None, False))
                yield pd.DataFrame(rows, columns=fields)

        schema = "column_name string, value string, view string, label string, text string, start int, end int, offset int, score double, inference_ok boolean"
        return predictions(samples.select("column_name", F.col("value")).mapInPandas(infer, schema))

    return provide
