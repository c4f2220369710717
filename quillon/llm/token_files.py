"""Token-ID files: flat unsigned integers and 64-bit document offsets, read back memory-mapped.

Documents are range-partitioned by id; each partition writes shards of at most about ``SHARD`` ids, of three flat files
each, under the shared folder: ``*.bin`` (ids, 16 bits if the vocabulary allows, else 32, little-endian),
``*.off`` (64-bit offsets of documents within the shard, one more than documents) and ``*.doc``
(64-bit document ids). One manifest row per shard holds the counts; the base of a shard, the ids of
all shards before it, is their prefix sum. A shard's name is new in each attempt of a task and only
the manifest makes it count, so a lost executor or a second attempt leaves nothing half-written in
the result; files of attempts that did not count are deleted at the end. Names begin with the run, so
a folder may hold several writes and other files.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillon.llm._work import new_folder, stash, text_slices, trimmed

MANIFEST = "part int, place int, name string, n_docs long, n_nulls long, n_tokens long, width int"
#: Ids from which a partition goes on in a new shard, after whole documents.
SHARD = 1 << 28

READ = "doc_id long, start long, n_tokens long, ids_crc32 long"
WITH_IDS = "doc_id long, start long, n_tokens long, ids binary"


def _files(folder: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder)


class _Shard:
    """The three files of a shard while they are written."""

    def __init__(self, folder: str, name: str, width: int):
        self.store, self.top = _files(folder)
        self.store.create_dir(self.top, recursive=True)
        self.name, self.width = name, width
        self.out = self.store.open_output_stream(f"{self.top}/{name}.bin")
        self.lengths, self.ids, self.nulls, self.n_tokens = [], [], 0, 0

    def add(self, doc_ids: pa.Array, coded: list[bytes]) -> None:
        data = b"".join(coded)
        self.out.write(data if self.width == 4 else np.frombuffer(data, "<u4").astype("<u2").tobytes())
        self.lengths.append(np.array([len(c) // 4 for c in coded], np.int64))
        self.nulls += doc_ids.null_count
        self.ids.append(doc_ids.fill_null(0).to_numpy(zero_copy_only=False))
        self.n_tokens += len(data) // 4

    def close(self, part: int, place: int) -> pa.RecordBatch:
        """Writes offsets and document ids; gives the shard's row of the manifest."""
        self.out.close()
        ends = np.cumsum(np.concatenate(self.lengths))
        for kind, values in (("off", np.concatenate([[0], ends])), ("doc", np.concatenate(self.ids))):
            with self.store.open_output_stream(f"{self.top}/{self.name}.{kind}") as f:
                f.write(values.astype("<i8").tobytes())
        numbers = {"part": pa.array([part], pa.int32()), "place": pa.array([place], pa.int32())}
        return pa.RecordBatch.from_pydict(numbers | {"name": [self.name], "n_docs": [len(ends)], "n_nulls": [self.nulls], "n_tokens": [self.n_tokens], "width": pa.array([self.width], pa.int32())})


def write_token_files(docs: DataFrame, tokenizer: str, end_id: int, folder: str | None = None, specials_as_text: bool = False) -> DataFrame:
    """Encode every whole text of ``docs`` (doc_id, text), add ``end_id``, write files; returns the manifest.

    Null text is written as the end id alone. Documents lie in ascending doc_id order, null ids first;
    rows of the same id in the order of their texts. An empty table gives a manifest without rows.
    The manifest is a table of its own in the shared folder, with ``base`` and ``doc_base`` added. Other files
    of the folder stay. ``specials_as_text``: strings of special tokens in a text are not these tokens.
    """
    spark = docs.sparkSession
    folder = folder or new_folder(spark, "tokens")
    run = uuid.uuid4().hex

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        from quillon.llm.encoding import encoder

        own = encoder(tokenizer, specials_as_text)
        width = 2 if max(own.whole.get_vocab_size(), end_id + 1) <= 1 << 16 else 4
        end = int(end_id).to_bytes(4, "little")
        part, place = TaskContext.get().partitionId(), 0
        shard = None
        for batch in batches:
            for piece in text_slices(batch):
                shard = shard or _Shard(folder, f"{run}-{part:06d}-{place:06d}-{uuid.uuid4().hex}", width)
                shard.add(piece.column("doc_id"), [c + end for c in own.encode([t or "" for t in piece.column("text").to_pylist()])])
                if shard.n_tokens >= SHARD:
                    yield shard.close(part, place)
                    shard, place = None, place + 1
        if shard:
            yield shard.close(part, place)

    dealt = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    manifest = stash(dealt.mapInArrow(trimmed(write), MANIFEST), "manifest")
    _sweep(manifest, folder, run)
    # One row a shard, so that a single partition of them is small at any size of the corpus.
    before = Window.orderBy("part", "place").rowsBetween(Window.unboundedPreceding, -1)
    return manifest.select("*", F.lit(folder).alias("folder"), F.coalesce(F.sum("n_tokens").over(before), F.lit(0)).alias("base"), F.coalesce(F.sum("n_docs").over(before), F.lit(0)).alias("doc_base"))


def _sweep(manifest: DataFrame, folder: str, run: str) -> None:
    """Delete shards of this run's attempts that did not count, and nothing else."""
    from pyarrow import fs

    store, top = _files(folder)
    counted = {r.name for r in manifest.select("name").toLocalIterator()}
    for f in store.get_file_info(fs.FileSelector(top, allow_not_found=True)):
        if f.is_file and f.base_name.startswith(f"{run}-") and f.base_name.rpartition(".")[0] not in counted:
            store.delete_file(f.path)


def read_token_files(spark: SparkSession, manifest: DataFrame, with_ids: bool = False) -> DataFrame:
    """Per document, from the files: doc_id, start (ids of all documents before it), n_tokens and
    ids_crc32 (of the ids as little-endian unsigned 32-bit integers), or the ``ids`` themselves.

    Files of a local or mounted folder are memory-mapped; those of another store are read through it.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard in batch.to_pylist():
                yield from _read_shard(shard, with_ids)

    # One small row a shard: dealt one by one, else a single task would read all the files.
    n = max(1, manifest.count())
    return manifest.repartition(n, "part", "place").mapInArrow(trimmed(read), WITH_IDS if with_ids else READ)


def _read_shard(shard: dict, with_ids: bool, rows: int = 4096) -> Iterator[pa.RecordBatch]:
    from pyarrow import fs

    store, top = _files(shard["folder"])

    def flat(kind: str, dtype: str) -> np.ndarray:
        path = f"{top}/{shard['name']}.{kind}"
        if isinstance(store, fs.LocalFileSystem):
            return np.memmap(path, dtype, "r")
        with store.open_input_file(path) as f:
            return np.frombuffer(f.read_buffer(), dtype)

    ids, offsets, docs = flat("bin", f"<u{shard['width']}"), flat("off", "<i8"), flat("doc", "<i8")
    for at in range(0, shard["n_docs"], rows):
        to = min(at + rows, shard["n_docs"])
        texts = [ids[offsets[i] : offsets[i + 1]].astype("<u4").tobytes() for i in range(at, to)]
        known = pa.array(docs[at:to], mask=np.arange(at, to) < shard["n_nulls"])
        starts, counts = pa.array(offsets[at:to] + shard["base"]), pa.array(np.diff(offsets[at : to + 1]))
        last = pa.array(texts, pa.binary()) if with_ids else pa.array([zlib.crc32(x) for x in texts], pa.int64())
        yield pa.RecordBatch.from_arrays([known, starts, counts, last], ["doc_id", "start", "n_tokens", "ids" if with_ids else "ids_crc32"])
