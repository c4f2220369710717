"""Embedding near-duplicates by a forest of random-projection trees.

Each tree splits recursively at the median of a random projection; vectors within ``SPILL`` of the
median go to both sides. Vectors of equal label that meet in a leaf of any tree are compared exactly,
in double precision. Splits are fitted on a bounded sample, for each of the ``DIMS`` most frequent dimensions;
every vector is put through every tree of its dimension.

No pair is ever written. A leaf counts, for each vector, the links whose two ends meet in no leaf
before it in order of tree and node, so each link counts once; and it writes one edge a vector to the
smallest of its local component. Identical vectors are compared as one with a weight. A leaf of more
than ``BLOCK`` vectors (a large group of near copies can't be split) is dealt into blocks, and pairs
of blocks are compared in tasks of their own, so no task holds more than two blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm._work import stash, trimmed
from quillon.llm.components import components

COSINE = 0.93
TREES = 6
SPILL = 0.02

#: A node is split while one label has more vectors in it, by the sample's estimate.
LEAF = 512
BLOCK = 2048

#: Vectors that splits are fitted on, about.
SAMPLE = 20_000

#: Dimensions that trees are grown for, those of most vectors; vectors of others are compared in blocks of their label.
DIMS = 16

#: A node is left whole if more than this share of it would go to both sides.
TOO_TIGHT = 0.6


class Tree:
    """Splits by heap number of the node; a node without a split is a leaf."""

    def __init__(self, number: int, directions: np.ndarray, splits: dict[int, float]):
        self.number, self.directions, self.splits = number, directions, splits

    def leaves(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows of ``x`` (unit vectors) and the nodes of the leaves that they are in."""
        rows, nodes, todo = [], [], [(1, 0, np.arange(len(x)))]
        while todo:
            node, level, own = todo.pop()
            if node not in self.splits:
                rows.append(own)
                nodes.append(np.full(len(own), node, np.int64))
            elif len(own):
                at, cut = x[own] @ self.directions[level % len(self.directions)], self.splits[node]
                todo += [(2 * node, level + 1, own[at <= cut + SPILL]), (2 * node + 1, level + 1, own[at >= cut - SPILL])]
        return np.concatenate(rows), np.concatenate(nodes)


def grow(x: np.ndarray, labels: np.ndarray, share: float, trees: int = TREES, leaf: int = LEAF) -> list[Tree]:
    """Trees over a sample ``x`` of unit vectors that is ``share`` of all."""
    forest = []
    for number in range(trees):
        dim = x.shape[1] if len(x) else 1
        directions = np.linalg.qr(np.random.default_rng(number).normal(size=(dim, dim)))[0].T
        splits: dict[int, float] = {}
        todo = [(1, 0, np.arange(len(x)))]
        while todo:
            node, level, own = todo.pop()
            if len(own) < 16 or level >= 40 or np.unique(labels[own], return_counts=True)[1].max() <= leaf * share:
                continue
            at = x[own] @ directions[level % dim]
            cut = float(np.median(at))
            if (np.abs(at - cut) <= SPILL).mean() > TOO_TIGHT:
                continue
            splits[node] = cut
            todo += [(2 * node, level + 1, own[at <= cut + SPILL]), (2 * node + 1, level + 1, own[at >= cut - SPILL])]
        forest.append(Tree(number, directions, splits))
    return forest


def _unit(raw: list[bytes], kind: str) -> np.ndarray:
    x = np.frombuffer(b"".join(raw), kind).reshape(len(raw), -1).astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True, initial=0)  # else squares may overflow or vanish
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def float_kind(vectors: DataFrame) -> str:
    """How components are kept: single precision as it comes, everything else in double precision."""
    return "<f4" if vectors.schema["embedding"].dataType.elementType.simpleString() == "float" else "<f8"


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id, label, dim and ``raw`` (bytes of the components) of the vectors that can link with any."""
    dtype = float_kind(vectors)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("embedding")
            flat, at = lists.flatten().to_numpy(zero_copy_only=False).astype(dtype), np.concatenate([[0], np.cumsum(lists.value_lengths().fill_null(0).to_numpy())])
            raw = []
            for k in range(batch.num_rows):
                own = flat[at[k] : at[k + 1]]
                raw.append(own.tobytes() if len(own) and np.isfinite(own).all() and own.any() else None)
            yield pa.record_batch([batch.column("vec_id"), batch.column("label"), pa.array([len(r) // np.dtype(dtype).itemsize if r else 0 for r in raw], pa.int32()), pa.array(raw, pa.binary())], names=["vec_id", "label", "dim", "raw"])

    good = vectors.filter(F.col("label").isNotNull() & F.col("vec_id").isNotNull() & F.col("embedding").isNotNull())
    kind = vectors.schema["label"].dataType.simpleString()
    cast = good.select(F.col("vec_id").cast("long").alias("vec_id"), "label", F.col("embedding").cast("array<float>" if dtype == "<f4" else "array<double>").alias("embedding"))
    return cast.mapInArrow(trimmed(scan), f"vec_id long, label {kind}, dim int, raw binary").filter(F.col("raw").isNotNull())


def _local_roots(linked: np.ndarray) -> np.ndarray:
    """Smallest index of the component of each row of a symmetric matrix of links."""
    root = np.full(len(linked), -1)
    for i in range(len(linked)):
        if root[i] < 0:
            root[i], reach = i, np.array([i])
            while len(reach):
                reach = np.flatnonzero(linked[reach].any(axis=0) & (root < 0))
                root[reach] = i
    return root


def _members(codes: list[np.ndarray], before: int) -> np.ndarray:
    """Which rows are in which of the leaves that come before this one."""
    rows = np.repeat(np.arange(len(codes)), [len(c) for c in codes])
    all_codes = np.concatenate(codes)
    earlier = all_codes < before
    known, column = np.unique(all_codes[earlier], return_inverse=True)
    out = np.zeros((len(codes), len(known)), np.float32)
    out[rows[earlier], column] = 1
    return out


def compare_leaf(pdf: pd.DataFrame, cosine: float, dtype: str) -> pd.DataFrame:
    """One leaf, or two blocks of one: rows of vec_id, links that count here, and the local component's smallest vec_id."""
    pdf = pdf.sort_values("vec_id", ignore_index=True)
    ids, x = pdf["vec_id"].to_numpy(), _unit(pdf["raw"].tolist(), dtype)
    linked = x @ x.T >= cosine
    np.fill_diagonal(linked, False)
    if pdf["left"][0] != pdf["right"][0]:  # two blocks: only links between them
        block = pdf["block"].to_numpy()
        linked &= block[:, None] != block[None, :]
    some = np.flatnonzero(linked.any(axis=1))
    if not len(some):
        return pd.DataFrame({"vec_id": ids[:0], "links": ids[:0], "root": ids[:0]})
    linked = linked[np.ix_(some, some)]
    codes = [np.frombuffer(c, "<i8") for c in pdf["codes"].iloc[some]]
    before = _members(codes, int(pdf["code"][0]))
    counted = linked & (before @ before.T == 0)
    links = counted @ pdf["copies"].to_numpy()[some]
    return pd.DataFrame({"vec_id": ids[some], "links": links.astype(np.int64), "root": ids[some][_local_roots(linked)]})


def near_vectors(vectors: DataFrame, cosine: float = COSINE, trees: int = TREES) -> DataFrame:
    """One row a vector: vec_id, n_links, component_id (smallest vec_id reachable), kept (it is its own).

    ``vectors``: vec_id, embedding, label; other columns are left aside. Vectors link if labels are equal
    and not null, dimensions are equal and their cosine is at least ``cosine``. Vectors that are null,
    empty, zero or hold null or non-finite components, and rows without vec_id, link with nothing (a null
    vec_id has a null component and isn't kept). Rows are vectors, so repeated rows link with each other.
    Components of any type but float are taken in double precision. An empty table gives an empty one.
    """
    spark = vectors.sparkSession
    kind = vectors.schema["label"].dataType.simpleString()
    good = stash(usable(vectors), "vectors")
    reps = stash(good.groupBy("label", "dim", "raw").agg(F.min("vec_id").alias("vec_id"), F.count(F.lit(1)).alias("copies")), "distinct")
    dtype, total = float_kind(vectors), reps.count()
    sizes = reps.groupBy("dim").agg(F.count(F.lit(1)).alias("n"))
    dims = [r.dim for r in sizes.orderBy(F.col("n").desc(), "dim").limit(DIMS).collect()]
    share = min(1.0, SAMPLE / max(total, 1))
    sample = reps.filter(F.col("dim").isin(dims) & (F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(1 << 20)) < share * (1 << 20))).select("label", "dim", "raw").toPandas()  # about SAMPLE rows
    own = {dim: sample[sample["dim"] == dim] for dim in dims}
    forests = {dim: grow(_unit(rows["raw"].tolist(), dtype), rows["label"].to_numpy(), share, trees) for dim, rows in own.items() if len(rows)}
    links = stash(_compare_all(reps, forests, cosine, kind, dtype), "links")
    counts = links.groupBy("vec_id").agg(F.sum("links").alias("links"))
    stars = components(links.select(F.col("vec_id").alias("a"), F.col("root").alias("b")))
    by_rep = reps.join(counts, "vec_id", "left").join(stars, F.col("vec_id") == F.col("id"), "left")
    by_rep = by_rep.select("label", "dim", "raw", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "vec_id").alias("component_id"))
    linked = good.join(by_rep, ["label", "dim", "raw"]).select("vec_id", "n_links", "component_id")
    out = linked.unionByName(_left_over(vectors))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def _left_over(vectors: DataFrame) -> DataFrame:
    """The vectors that ``usable`` leaves out, as vectors without links."""
    x = F.col("embedding").cast("array<float>" if float_kind(vectors) == "<f4" else "array<double>")
    fine = x.isNotNull() & (F.size(x) > 0) & ~F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))) & F.exists(x, lambda v: v != 0)
    lost = ~F.coalesce(F.col("label").isNotNull() & F.col("vec_id").isNotNull() & fine, F.lit(False))
    return vectors.filter(lost).select(F.col("vec_id").cast("long").alias("vec_id"), F.lit(0).cast("long").alias("n_links"), F.col("vec_id").cast("long").alias("component_id"))


def _compare_all(reps: DataFrame, forests: dict[int, list[Tree]], cosine: float, kind: str, dtype: str) -> DataFrame:
    shared = reps.sparkSession.sparkContext.broadcast(forests)  # a float for each node of trees over SAMPLE vectors, and DIMS matrices

    def codes(dim: int, raw: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Rows and the codes of the leaves they are in; without trees there is one leaf."""
        forest = shared.value.get(dim)
        if forest is None:
            return np.arange(len(raw)), np.ones(len(raw), np.int64)
        x = _unit(raw, dtype)
        parts = [t.leaves(x) for t in forest]
        return np.concatenate([r for r, _ in parts]), np.concatenate([n | (np.int64(t.number) << np.int64(48)) for t, (_, n) in zip(forest, parts)])

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            raw, dims = batch.column("raw").to_pylist(), batch.column("dim").to_numpy()
            each: list[bytes] = [b""] * len(raw)
            for dim in np.unique(dims).tolist():
                mine = np.flatnonzero(dims == dim)
                rows, found = codes(dim, [raw[i] for i in mine])
                order = np.lexsort((found, rows))
                rows, found = rows[order], found[order]
                ends = np.searchsorted(rows, np.arange(len(mine) + 1))
                for k, i in enumerate(mine.tolist()):
                    each[i] = found[ends[k] : ends[k + 1]].astype("<i8").tobytes()
            yield pa.record_batch([*batch.columns, pa.array(each, pa.binary())], names=[*batch.schema.names, "codes"])

    fields = f"vec_id long, label {kind}, dim int, copies long, raw binary, codes binary"
    base = stash(reps.select("vec_id", "label", "dim", "copies", "raw").mapInArrow(trimmed(put), fields), "leaves")

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [np.frombuffer(c, "<i8") for c in batch.column("codes").to_pylist()]
            rows = np.repeat(np.arange(batch.num_rows), [len(c) for c in own])
            yield pa.record_batch([*batch.take(pa.array(rows)).columns, pa.array(np.concatenate(own) if own else np.empty(0, np.int64))], names=[*batch.schema.names, "code"])

    at = base.mapInArrow(trimmed(unpack), f"{fields}, code long")
    large = at.groupBy("label", "dim", "code").agg(F.count(F.lit(1)).alias("rows")).filter(F.col("rows") > BLOCK)
    blocks = large.select(F.col("label").alias("l"), F.col("dim").alias("m"), F.col("code").alias("c"), F.ceil(F.col("rows") / (BLOCK * 0.9)).cast("int").alias("blocks"))
    dealt = at.join(blocks, (F.col("label") == F.col("l")) & (F.col("dim") == F.col("m")) & (F.col("code") == F.col("c")), "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    dealt = dealt.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.col("blocks")).cast("int"))
    pairs = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda b: F.struct(F.least(b, F.col("block")).alias("left"), F.greatest(b, F.col("block")).alias("right")))
    tasks = dealt.select("vec_id", "label", "dim", "copies", "raw", "codes", "code", "block", F.inline(pairs))
    return tasks.groupBy("label", "dim", "code", "left", "right").applyInPandas(lambda pdf: compare_leaf(pdf, cosine, dtype), "vec_id long, links long, root long")
