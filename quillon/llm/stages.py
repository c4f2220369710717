"""Pipeline stages over tables with the columns of documents: doc_id, text, lang, source, n_chars.

Each function takes (spark, docs, sf_dir). All columns ride along but for the last stage, whatever they are
called: what a stage adds while it works never replaces a column of the input. Empty tables give empty ones;
texts of any length are worked on whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm._work import beside, free_name, stash
from quillon.ship import ensure_shipped

#: Least share of letters that a document's language must have: texts of several languages pass.
LEAST_SCORE = 0.2


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects texts without letters (null and empty ones too) and those of which no language has a fifth of the letters.

    The model is learned from the labelled rows that aren't held out. A null lang becomes the predicted one.
    Where no row is labelled no language can be told: all texts with letters stay, their lang null. Rows
    without doc_id and repeated rows are judged like any other.
    """
    ensure_shipped(spark)
    from quillon.llm.language import UNKNOWN, held_out, identify, learn

    model = learn(docs.filter(~held_out()))
    if not model.langs:
        return docs.filter(F.col("text").rlike("\\p{L}"))

    def keep(rows: DataFrame) -> DataFrame:
        kept = identify(rows, model).filter((F.col("lang_pred") != UNKNOWN) & (F.col("lang_score") >= LEAST_SCORE))
        return kept.withColumn("lang", F.coalesce("lang", "lang_pred"))

    return beside(docs, ("lang_pred", "lang_score", "lang_spans"), keep)


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group: that of smallest doc_id, and of several texts with this id the one with the smallest hash.

    A document is an id with a text: repeated rows of both are one (which of their other columns stays is not
    told), and a second text of an id is judged by its own group. Rows without doc_id stay. Null and empty
    texts are a group as well.

    Decisions are made on ids and hashes. Texts stay where they are, but for the few that may be among the
    rows to leave out: a bitmap of bounded size tells these, and they are looked up exactly.
    """
    ensure_shipped(spark)
    return beside(docs, ("own", "hit", "id", "d", "once"), _first_of_groups)


def _first_of_groups(docs: DataFrame) -> DataFrame:
    from quillon.llm.simhash import simhash_groups

    digest = F.xxhash64(F.coalesce("text", F.lit("")), F.col("text").isNull())
    groups = simhash_groups(docs.filter(F.col("doc_id").isNotNull()), digest=digest)
    documents = groups.groupBy("doc_id", "digest", "component_id", "root").agg(F.count(F.lit(1)).alias("rows"))
    first = documents.filter(F.col("doc_id") == F.col("component_id")).groupBy(F.col("root").alias("r")).agg(F.min("digest").alias("kept"))
    judged = documents.join(first, F.col("root") == F.col("r"))
    stays = (F.col("doc_id") == F.col("component_id")) & (F.col("digest") == F.col("kept"))
    judged = judged.filter(~stays | (F.col("rows") > 1)).select(F.col("doc_id").alias("id"), F.col("digest").alias("d"), stays.alias("once"))
    listed = stash(judged, "left_out")

    marked = docs.withColumn("own", F.struct(F.col("doc_id").cast("long").alias("id"), digest.alias("d")))
    marked = in_bitmap(marked, listed.select("id", "d"), "own", "hit")
    known = F.col("own.id").isNotNull() & F.col("hit")
    found = marked.filter(known).join(listed, (F.col("own.id") == F.col("id")) & (F.col("own.d") == F.col("d")), "left")
    once = found.filter("once").dropDuplicates(["id", "d"])
    return marked.filter(~known).unionByName(found.filter(F.col("once").isNull()).select(*marked.columns)).unionByName(once.select(*marked.columns))


#: Bits of the bitmap: 8 MB, whatever the table; with many more keys than bits all rows are looked up exactly.
BITMAP = 1 << 26


def in_bitmap(rows: DataFrame, keys: DataFrame, own: str, hit: str, bits: int = BITMAP) -> DataFrame:
    """``rows`` with ``hit``: false where ``own`` (id, d) is certainly none of ``keys`` (id, d), or has a null id."""
    place = lambda a, b: F.pmod(F.xxhash64(a, b, F.lit(5)), F.lit(bits))
    at = keys.select(place("id", "d").alias("place"))
    maps = at.groupBy(F.bitmap_bucket_number("place").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("place")).alias("map"))
    bucket, bitmap, spot = (free_name(rows.columns, n) for n in ("bucket", "map", "place"))
    maps = maps.withColumnsRenamed({"bucket": bucket, "map": bitmap})
    marked = rows.withColumn(spot, place(F.col(own)["id"], F.col(own)["d"]))
    joined = marked.join(F.broadcast(maps), F.bitmap_bucket_number(spot) == F.col(bucket), "left")
    position = F.bitmap_bit_position(spot)
    byte = F.conv(F.hex(F.substr(F.col(bitmap), (F.floor(position / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    bit = F.pmod(F.floor(byte / F.pow(F.lit(2.0), F.pmod(position, F.lit(8)))).cast("int"), F.lit(2))
    return joined.withColumn(hit, F.coalesce(bit == 1, F.lit(False))).drop(bucket, bitmap, spot)


def secret_redaction(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces secrets in texts by their kinds; n_chars of changed texts is counted anew. All rows stay, nulls as they are."""
    ensure_shipped(spark)
    from quillon.llm.secrets import redact

    return beside(docs, (), redact)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it: up to three times, or not at all.

    A null source is a source of its own; texts without words (null ones too) stay once. Rows of one doc_id and
    size are taken alike, a null doc_id being a value.
    """
    ensure_shipped(spark)
    from quillon.llm.mixing import mix

    added = ("size", "source_size", "target", "copies")
    times = lambda rows: rows.filter(F.col("copies") > 0).withColumn("copies", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    return beside(docs, added, lambda rows: times(mix(rows)))


def sequence_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token ids, by digest, with their places in sequences.

    Null and empty texts give the end id alone; rows without doc_id and repeated rows are packed like any other.
    """
    ensure_shipped(spark)
    from quillon.llm.packing import pack, token_pieces
    from quillon.llm.queries import tokenizer_path

    pieces = token_pieces(docs, tokenizer_path("word_bpe_49k.json"))
    return pack(pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32")))
