"""SimHash near-duplicates by anchor-point covering.

Two fingerprints that differ in at most ``BITS`` = 3 of 64 bits differ in at most one bit of one of
their halves. On each half of 32 bits the anchors are a covering code of radius 1: the words of the
perfect Hamming code of length 31, each with either last bit. A half has one anchor within the
radius, its home; it is replicated to all 16 or 17 anchors within radius plus threshold (1 + 1), and
at each anchor the homes are compared with the visitors on all 64 bits. That finds every pair. (A
covering code of whole fingerprints would need the threshold 3 on 64 bits: with a radius of 1 about
ten thousand replicas each, so the threshold is first divided between the halves.)

Only distinct fingerprints are compared; documents of equal fingerprints are joined by grouping. No pair
is written where others join its ends at the same anchor.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.llm._work import stash, text_slices, trimmed, whole_groups
from quillon.llm.components import components

BITS = 3

#: Fingerprints of an anchor that are all compared with each other's homes at once; each has under so many links there.
FEW = 32

SEED = 42
SHINGLE = 3


def simhashes(texts: list[bytes | None], width: int = SHINGLE) -> np.ndarray:
    """Unsigned fingerprints: a bit is 1 if it is set in over half of the XXH64 of word shingles.

    A-Z count as a-z; words are runs of anything but space and 0x09-0x0D; a text of fewer words than
    ``width`` is one shingle, one without words has fingerprint zero.
    """
    from xxhash import xxh64_intdigest

    hashes, counts = [], []
    for text in texts:
        words = (text or b"").lower().split()  # bytes: only A-Z change, only ASCII white space splits
        n = len(words)
        if n < width:
            counts.append(int(n > 0))
            if n:
                hashes.append(np.array([xxh64_intdigest(b" ".join(words), SEED)], np.uint64))
            continue
        counts.append(n - width + 1)
        shingles = map(b" ".join, zip(*[words[k:] for k in range(width)]))
        hashes.append(np.fromiter(map(xxh64_intdigest, shingles, repeat(SEED)), np.uint64, n - width + 1))
    out = np.zeros(len(texts), np.uint64)
    counts = np.array(counts, np.int64)
    full = np.flatnonzero(counts)
    if len(full):
        bits = np.unpackbits(np.concatenate(hashes).astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        starts = np.cumsum(counts[full]) - counts[full]
        sums = np.add.reduceat(bits, starts, axis=0, dtype=np.int32)
        out[full] = np.packbits(2 * sums > counts[full, None], axis=1, bitorder="little").view("<u8").ravel()
    return out


def fingerprints(docs: DataFrame, digest: Column | None = None) -> DataFrame:
    """doc_id and fingerprint (the 64 bits as a signed long) of every whole text; null text counts as empty.

    ``digest``: a column of longs over ``docs`` that is returned beside these.
    """
    more = [] if digest is None else ["digest"]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, limit=1 << 21):
                found = simhashes(part.column("text").cast(pa.binary()).to_pylist())
                yield pa.record_batch([part.column("doc_id"), pa.array(found.view(np.int64)), *[part.column(c) for c in more]], names=["doc_id", "fingerprint", *more])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *([] if digest is None else [digest.alias("digest")]))
    return rows.mapInArrow(trimmed(scan), "doc_id long, fingerprint long" + "".join(f", {c} long" for c in more))


def anchors(half: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Home anchor of each 32-bit half; rows of halves and anchors within distance 2 of them, 2 or 17 each."""
    x = half.astype(np.int64)
    low, last = x & 0x7FFFFFFF, x & 0x80000000
    syndrome = np.zeros_like(x)
    for i in range(31):
        syndrome ^= (i + 1) * (low >> i & 1)
    one = np.int64(1)
    home = np.where(syndrome > 0, low ^ (one << np.maximum(syndrome - 1, 0)), low)
    near = np.stack([home | last, home | (last ^ 0x80000000)], axis=1)
    rows, visits = [np.repeat(np.arange(len(x)), 2)], [near.ravel()]
    for s in range(1, 32):  # code words at distance 2 flip two positions that add up to the syndrome
        flips = np.array([(one << (i - 1)) | (one << ((i ^ s) - 1)) for i in range(1, 32) if i < i ^ s], np.int64)
        own = np.flatnonzero(syndrome == s)
        rows.append(np.repeat(own, len(flips)))
        visits.append(((low[own, None] ^ flips) | last[own, None]).ravel())
    return home | last, np.concatenate(rows), np.concatenate(visits)


def spanning(prints: np.ndarray, home: np.ndarray, bits: int) -> Iterator[tuple[int, int]]:
    """Of the links between homes and all others at one anchor, those that join what wasn't joined before: under len(prints)."""
    label = np.arange(len(prints))
    for h in np.flatnonzero(home):
        near = np.flatnonzero(np.bitwise_count(prints ^ prints[h]) <= bits)
        parts, first = np.unique(label[near], return_index=True)
        if len(parts) > 1:
            for part, other in zip(parts.tolist(), near[first].tolist()):
                if part != label[h]:
                    yield int(h), other
            label[np.isin(label, parts)] = parts[0]


def _links(rows: dict[str, np.ndarray], bits: int, few: int) -> tuple[np.ndarray, np.ndarray]:
    """Links of whole anchors: small ones are compared side by side, larger ones give spanning links."""
    key, prints, home = rows["anchor"], rows["fingerprint"].view(np.uint64), rows["home"].astype(bool)
    begin = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    size = np.diff(np.append(begin, len(key)))
    small = np.repeat(size <= few, size)
    a, b = [], []
    for by in range(1, min(few, len(key))):
        i = np.flatnonzero((key[by:] == key[:-by]) & small[by:] & (home[by:] | home[:-by]))
        if not len(i):
            break
        i = i[np.bitwise_count(prints[i] ^ prints[i + by]) <= bits]
        a.append(i)
        b.append(i + by)
    for k in np.flatnonzero(size > few):
        own = slice(begin[k], begin[k] + size[k])
        pairs = np.array([*spanning(prints[own], home[own], bits)], np.int64).reshape(-1, 2) + begin[k]
        a.append(pairs[:, 0])
        b.append(pairs[:, 1])
    none = np.empty(0, np.int64)
    return prints[np.concatenate([none, *a])].view(np.int64), prints[np.concatenate([none, *b])].view(np.int64)


def linked(prints: DataFrame, bits: int = BITS) -> DataFrame:
    """Links (a, b) between distinct fingerprints that differ in at most ``bits`` (3 at most) bits; a < b.

    These join whatever all such pairs join, but aren't all of them: an anchor with more than ``FEW`` fingerprints
    gives only links that span what is joined there.
    """
    if bits > BITS:
        raise ValueError("the covering code is made for 3 bits at most")

    def replicate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 20_000):
                own = batch.slice(at, 20_000).column("fingerprint").to_numpy().view(np.uint64)
                for k in (0, 1):
                    home, rows, visits = anchors(own >> np.uint64(32 * k) & np.uint64(0xFFFFFFFF))
                    key = np.concatenate([home, visits]) | (np.int64(k) << np.int64(32))
                    who = np.concatenate([own, own[rows]]).view(np.int64)
                    yield pa.record_batch([pa.array(key), pa.array(who), pa.array(np.arange(len(key)) < len(home))], names=["anchor", "fingerprint", "home"])

    few = FEW

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in whole_groups(batches, ("anchor", "fingerprint", "home"), ("anchor",)):
            a, b = _links(rows, bits, few)
            yield pa.record_batch([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])

    at = prints.select("fingerprint").mapInArrow(trimmed(replicate), "anchor long, fingerprint long, home boolean")
    return at.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(trimmed(compare), "a long, b long").filter("a <> b").distinct()


def simhash_groups(docs: DataFrame, bits: int = BITS, digest: Column | None = None) -> DataFrame:
    """doc_id, fingerprint (signed long) and component_id, the smallest doc_id reachable over links.

    All rows return, repeated ones too; a component whose ids are all null has a null component_id.
    Null and empty texts have fingerprint zero and link like any other. Other columns are left aside. An
    empty table gives an empty one; texts of any length are worked on whole. With ``digest`` (a column of
    longs over ``docs``) it is returned too, and ``root``, a fingerprint that tells the component.
    """
    prints = stash(fingerprints(docs, digest), "fingerprints")
    reps = stash(prints.groupBy("fingerprint").agg(F.min("doc_id").alias("rep")), "representatives")
    stars = components(linked(reps, bits))
    rooted = reps.join(stars, F.col("fingerprint") == F.col("id"), "left").select("fingerprint", "rep", F.coalesce("component", "fingerprint").alias("root"))
    smallest = rooted.groupBy(F.col("root").alias("r")).agg(F.min("rep").alias("component_id"))
    whole = rooted.join(smallest, F.col("root") == F.col("r")).select(F.col("fingerprint").alias("f"), "component_id", "root")
    return prints.join(whole, F.col("fingerprint") == F.col("f")).select("doc_id", "fingerprint", "component_id", *([] if digest is None else ["digest", "root"]))
