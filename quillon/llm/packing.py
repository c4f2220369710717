"""Best-fit packing of token pieces into sequences by the sum-of-squares rule.

A group of pieces is packed in one task: pieces go in descending length; each goes to the open bin
whose residual gap makes the sum over gaps of (open bins with that gap) squared smallest (the smallest
such gap that is left, if several do), and a new bin opens only if none has room. Groups hold about ``GROUP`` pieces dealt by a hash of their row
number, so tasks and memory stay the same size however large the input is. Any-fit leaves at most
one bin a group that is half empty or more; those bins are packed again as units, group over
group, until a single group is left. Only row numbers and lengths are shuffled for packing; pieces
themselves are joined with their places at the end.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm._work import free_name, stash, text_slices, trimmed

CAPACITY = 2048

#: Pieces that are packed together: about half a second of one core.
GROUP = 32_768

#: Tasks that groups are dealt to at most.
TASKS = 20_000

PIECES = "doc_id long, piece int, start long, length long, ids binary"


def token_pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = 0, specials_as_text: bool = False) -> DataFrame:
    """The ids of every whole text, with ``end_id`` after them, cut every ``capacity`` ids.

    ``docs`` needs doc_id and text; other columns are left aside. Null text counts as empty and
    gives the end id alone; a null doc_id and repeated rows stay. ``ids`` holds little-endian
    unsigned 32-bit integers; ``start`` counts the document's ids before the piece. Texts of any length
    are encoded whole; an empty table gives an empty one. ``specials_as_text``: strings of special tokens
    in a text are ordinary text and not these tokens.
    """
    end = int(end_id).to_bytes(4, "little")
    schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from quillon.llm.encoding import encoder

        encode = encoder(tokenizer, specials_as_text).encode
        for batch in batches:
            for part in text_slices(batch):
                ids = [x + end for x in encode([t or "" for t in part.column("text").to_pylist()])]
                rows = [(d, k, k * capacity, x[k * capacity * 4 : (k + 1) * capacity * 4]) for d, x in zip(part.column("doc_id").to_pylist(), ids) for k in range(-(-len(x) // (4 * capacity)))]
                columns = list(zip(*rows))
                yield pa.record_batch([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int32()), pa.array(columns[2], pa.int64()), pa.array([len(x) // 4 for x in columns[3]], pa.int64()), pa.array(columns[3], pa.binary())], schema=schema)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(trimmed(cut), PIECES)


def place(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bin, offset and final fill of its bin for each length, in any order given; all lengths are 1 to capacity."""
    order = np.argsort(-lengths, kind="stable")
    open_bins: list[list[int]] = [[] for _ in range(capacity + 1)]  # by gap
    counts = np.zeros(capacity + 1, np.int64)
    bins, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    gaps: list[int] = []
    for i in order:
        size = int(lengths[i])
        left = np.flatnonzero(counts[size:])  # the gap that would be left, for each gap in use
        if len(left):
            # Half the change of the sum of squares: a gap g goes, a gap g - size comes; a full bin leaves the count.
            change = np.where(left == 0, 1 - 2 * counts[left + size], 2 - 2 * counts[left + size] + 2 * counts[left])
            rest = int(left[change.argmin()])
            at = open_bins[rest + size].pop()
            counts[rest + size] -= 1
        else:
            at, rest = len(gaps), capacity - size
            gaps.append(capacity)
        bins[i], offsets[i] = at, capacity - gaps[at]
        gaps[at] = rest
        if rest:
            open_bins[rest].append(at)
            counts[rest] += 1
    fills = capacity - np.array(gaps, np.int64)
    return bins, offsets, fills[bins] if len(lengths) else bins


def _pack_units(units: DataFrame, capacity: int, group_rows: int) -> DataFrame:
    """``units``: uid, length, of a written table. Gives uid, sequence_id (the uid at offset 0), offset, fill."""
    groups = max(1, -(-units.count() // group_rows))

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["length", "uid"], ascending=[False, True], ignore_index=True)
        bins, offsets, fills = place(pdf["length"].to_numpy(), capacity)
        first = np.empty(int(bins.max()) + 1, np.int64)
        uid = pdf["uid"].to_numpy()
        first[bins[offsets == 0]] = uid[offsets == 0]
        return pd.DataFrame({"uid": uid, "sequence_id": first[bins], "offset": offsets, "fill": fills})

    # So many partitions are asked for, else small ones would be put together by bytes, and a task would pack many groups.
    dealt = units.withColumn("g", F.pmod(F.xxhash64("uid"), F.lit(groups))).repartition(min(groups, TASKS), "g")
    placed = stash(dealt.groupBy("g").applyInPandas(pack, "uid long, sequence_id long, offset long, fill long"), "packed")
    if groups == 1:
        return placed
    loose = placed.filter((F.col("offset") == 0) & (F.col("fill") * 2 <= capacity)).select("uid", F.col("fill").alias("length"))
    again = _pack_units(stash(loose, "loose"), capacity, group_rows).select(F.col("uid").alias("sequence_id"), F.col("sequence_id").alias("into"), F.col("offset").alias("base"))
    return placed.join(again, "sequence_id", "left").select("uid", F.coalesce("into", "sequence_id").alias("sequence_id"), (F.col("offset") + F.coalesce("base", F.lit(0))).alias("offset"), "fill")


def pack(pieces: DataFrame, capacity: int = CAPACITY, group_rows: int = GROUP) -> DataFrame:
    """``pieces`` with sequence_id and offset; whatever other columns there are stay as they are.

    ``length`` must be 1 to ``capacity``; other rows, null lengths among them, get null for both.
    Pieces of a sequence lie at offsets without gaps from 0. A full piece is a sequence of its own.
    Repeated rows are packed one by one. An empty table gives an empty table.
    """
    names = [c for c in pieces.columns if c not in ("sequence_id", "offset")]
    uid = free_name(names, "uid")
    table = stash(pieces.select(*names).withColumn(uid, F.monotonically_increasing_id()), "pieces")
    length = F.col("length")
    units = table.filter((length > 0) & (length < capacity)).select(F.col(uid).alias("uid"), length.cast("long").alias("length"))
    placed = _pack_units(units, capacity, group_rows).select(F.col("uid").alias(uid), "sequence_id", "offset")
    alone = length == capacity
    return (
        table.join(placed, uid, "left")
        .withColumn("sequence_id", F.when(alone, F.col(uid)).otherwise(F.col("sequence_id")))
        .withColumn("offset", F.when(alone, F.lit(0).cast("long")).otherwise(F.col("offset")))
        .drop(uid)
    )
