"""Shared work folder of the library, and helpers for Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.work import discard, new_folder, scratch, shared_folder, stash

__all__ = ["beside", "discard", "free_name", "new_folder", "scratch", "shared_folder", "stash", "text_slices", "trimmed", "whole_groups"]


def free_name(taken: Iterable[str], name: str) -> str:
    """``name``, with as many underscores after it as make it none of ``taken``, in whatever case."""
    low = {t.lower() for t in taken}
    while name.lower() in low:
        name += "_"
    return name


def beside(docs: DataFrame, names: Iterable[str], step: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The columns of ``docs`` after ``step``, which adds columns of ``names``: what had such a name before keeps its values.

    Names with a dot are changed for the step too: functions over Arrow batches can't have them.
    """
    low, taken, new = {n.lower() for n in names}, [*docs.columns, *names], {}
    for c in docs.columns:
        if c.lower() in low or "." in c:
            new[c] = free_name(taken, f"{c}_kept".replace(".", "_"))
            taken.append(new[c])
    out = step(docs.withColumnsRenamed(new))
    return out.select(*[F.col(f"`{new.get(c, c)}`").alias(c) for c in docs.columns])


def text_slices(batch: pa.RecordBatch, column: str = "text", limit: int = 1 << 22) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about ``limit`` bytes of text each, so that temporary arrays stay small.

    A text longer than the limit is a slice of its own.
    """
    import pyarrow.compute as pc

    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes, dtype=np.int64)
    at = 0
    while at < batch.num_rows:
        before = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, before + limit, side="right")))
        yield batch.slice(at, to - at)
        at = to


def trimmed(scan: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``scan`` for mapInArrow, after which the worker gives back what its allocators hold: Spark keeps workers for other stages."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ctypes

        try:
            yield from scan(batches)
        finally:
            pa.default_memory_pool().release_unused()
            if hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
                libc.malloc_trim(0)

    return run


def whole_groups(batches: Iterator[pa.RecordBatch], names: tuple[str, ...], by: tuple[str, ...], chunk: int = 1 << 16) -> Iterator[dict[str, np.ndarray]]:
    """Rows of batches that are sorted by the columns ``by``, in chunks of about ``chunk`` that hold whole groups."""
    parts: list[dict[str, np.ndarray]] = []
    n, enough = 0, chunk
    for batch in batches:
        if not batch.num_rows:
            continue
        parts.append({c: batch.column(c).to_numpy(zero_copy_only=False) for c in names})
        n += batch.num_rows
        if n < enough:
            continue
        held = {c: np.concatenate([p[c] for p in parts]) for c in names}
        differs = np.zeros(n, bool)
        for c in by:
            differs |= held[c] != held[c][-1]
        last = int(np.flatnonzero(differs)[-1]) + 1 if differs.any() else 0
        if last:
            yield {c: v[:last] for c, v in held.items()}
        parts, n = [{c: v[last:].copy() for c, v in held.items()}], n - last
        enough = max(chunk, 2 * n)
    if n:
        yield {c: np.concatenate([p[c] for p in parts]) for c in names}
