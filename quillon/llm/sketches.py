"""Document fingerprints as threshold-scaled sketches, and their likeness.

A sketch keeps every distinct hash of a 5-word shingle that lies below a fixed fraction of the hash
range, and where none does the smallest one. Sketches of the same fraction merge by union, and
shared hashes estimate containment whatever the sizes of the two documents. As text, a sketch is
its hashes in ascending order, 16 hexadecimal digits each.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm._work import stash, text_slices, trimmed
from quillon.llm.words import flat, shingle_hashes, word_hashes

WIDTH = 5

#: One in so many shingle hashes is kept.
SCALE = 8

#: Runs of adjacent ids are this many for each shuffle partition, so that partitions get even shares.
RUNS = 8


def sketches(texts: list[bytes], width: int = WIDTH, scale: int = SCALE) -> list[np.ndarray]:
    """Sorted distinct hashes kept of each text; empty for a text without words."""
    data, offsets = flat(texts)
    words, before = word_hashes(data, offsets)
    hashes, ends = shingle_hashes(words, before, width)
    kept = hashes < np.uint64((1 << 64) // scale)
    places = np.flatnonzero(kept)
    cuts = np.searchsorted(places, ends)
    out = []
    for i in range(len(texts)):
        if cuts[i] < cuts[i + 1]:
            out.append(np.unique(hashes[places[cuts[i] : cuts[i + 1]]]))
        else:
            own = hashes[ends[i] : ends[i + 1]]
            out.append(own[own.argmin() :][:1] if len(own) else own)
    return out


def merge(a: np.ndarray, b: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """The sketch of two documents together, from theirs (shingles across the seam aside)."""
    both = np.union1d(a, b)
    kept = both[both < np.uint64((1 << 64) // scale)]
    return kept if len(kept) else both[:1]


def shared(a: np.ndarray, b: np.ndarray) -> int:
    return len(np.intersect1d(a, b, assume_unique=True))


def containment(a: np.ndarray, b: np.ndarray) -> float:
    """Estimated share of the first document's shingles that the second has; 1 for two without words."""
    return shared(a, b) / len(a) if len(a) else float(not len(b))


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """The larger containment, 0 to 1: the shared hashes by the smaller sketch."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    return shared(a, b) / min(len(a), len(b))


def as_hex(sketch: np.ndarray) -> str:
    return sketch.astype(">u8").tobytes().hex()


def from_hex(text: str) -> np.ndarray:
    return np.frombuffer(bytes.fromhex(text), ">u8").astype(np.uint64)


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and fingerprint of every whole text. Null and empty texts have the empty fingerprint."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, limit=1 << 21):
                own = sketches([t or b"" for t in part.column("text").cast(pa.binary()).to_pylist()])
                yield pa.record_batch([part.column("doc_id"), pa.array(map(as_hex, own), pa.string())], names=["doc_id", "fingerprint"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(trimmed(scan), "doc_id long, fingerprint string")


def with_next(docs: DataFrame) -> DataFrame:
    """Rows (run, ghost, doc_id, text), sorted so that each row's next document follows it.

    Documents go in descending doc_id, null ids last, repeated ids in order of their texts; after the
    last comes the first. Ids alone are range-partitioned to find runs of adjacent ids; then every text
    is shuffled once, to its run. A run's first document is also sent, as a ghost, to the end of the run
    before it. There is one pair of bounds a run, so the bounds stay small at any size. All rows without doc_id are
one run, as are all rows of one doc_id.
    """
    spark = docs.sparkSession
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id")).filter(F.col("doc_id").isNotNull())
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = stash(ids.repartitionByRange(n * RUNS, "doc_id").groupBy(F.spark_partition_id().alias("k")).agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")), "runs")
    bounds = sorted((r.low, r.high) for r in dealt.toLocalIterator())
    lows, highs = np.array([b[0] for b in bounds], np.int64), np.array([b[1] for b in bounds], np.int64)
    runs = max(1, len(bounds))
    limits = spark.sparkContext.broadcast((lows, highs))  # two numbers a run

    @F.pandas_udf("array<int>")
    def places(doc_id: pd.Series) -> pd.Series:
        lows, highs = limits.value
        known = doc_id.notna().to_numpy()
        key = doc_id.fillna(0).astype("int64").to_numpy()
        if not len(lows):
            return pd.Series([[0]] * len(key))
        run = np.where(known, np.maximum(np.searchsorted(lows, key, side="right") - 1, 0), 0)
        first = known & (key == highs[run])
        return pd.Series([[r, (r + 1) % runs] if f else [r] for r, f in zip(run.tolist(), first.tolist())])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("places", places("doc_id"))
    rows = rows.select("doc_id", "text", F.posexplode("places").alias("ghost", "run"))
    return rows.repartition(n, "run").sortWithinPartitions("run", "ghost", F.col("doc_id").desc_nulls_last(), "text").select("run", "ghost", "doc_id", "text")


EDITED = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def compare_with_edited(docs: DataFrame) -> DataFrame:
    """Fingerprints of each text and of its edit, with likenesses to the edit and to the next document.

    The edit replaces the last floor(n_chars / 2) code points by as many of the next document's first,
    or all it has. Null text counts as empty; a single document is its own next. Repeated rows stay.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())])

    def records(rows: list[tuple]) -> pa.RecordBatch:
        """From (doc_id, text, sketch, next text, next sketch)."""
        edits = [t[: len(t) - len(t) // 2] + nxt[: len(t) // 2] for _, t, _, nxt, _ in rows]
        coded = [e.encode() for e in edits]
        out = [
            (d, len(t), hashlib.sha256(c).hexdigest(), as_hex(own), as_hex(new), likeness(own, new), likeness(own, after))
            for (d, t, own, _, after), c, new in zip(rows, coded, sketches(coded))
        ]
        return pa.record_batch([pa.array(column, field.type) for column, field in zip(zip(*out), schema)], schema=schema)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run, first, held = None, None, None  # held: the row whose next is still to come
        for batch in batches:
            for part in text_slices(batch, limit=1 << 21):
                texts = [t or "" for t in part.column("text").to_pylist()]
                own = sketches([t.encode() for t in texts])
                ready = []
                for r, ghost, d, t, s in zip(part.column("run").to_pylist(), part.column("ghost").to_pylist(), part.column("doc_id").to_pylist(), texts, own):
                    if r != run:
                        if held is not None:  # a run without a ghost: all ids are null, and its first row is the next
                            ready.append((*held, *first))
                        run, held, first = r, None, (t, s)
                    if held is not None:
                        ready.append((*held, t, s))
                    held = None if ghost else (d, t, s)
                if ready:
                    yield records(ready)
        if held is not None:
            yield records([(*held, *first)])

    return with_next(docs).mapInArrow(trimmed(scan), EDITED)
