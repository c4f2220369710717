"""Thin queries over the driver's tables, one for each operator of this folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillon.llm.packing import pack, token_pieces

    pieces = token_pieces(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))
    digests = pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"))
    return pack(digests).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillon.llm.token_files import read_token_files, write_token_files

    manifest = write_token_files(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), end_id=2)
    return read_token_files(spark, manifest)


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillon.llm.secrets import STRONG, as_text, count_of, find_secrets

    found, spans = find_secrets(table(spark, sf_dir, "documents")), F.col("spans")
    return found.select(
        "doc_id",
        *[count_of(spans, k).alias(f"n_{k}") for k in STRONG],
        F.sha2(as_text(spans, STRONG), 256).alias("base_sha256"),
        as_text(spans).alias("spans"),
    )


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillon.llm._work import stash
    from quillon.llm.mixing import mix, word_count

    # Written, so that words are counted once.
    docs = stash(table(spark, sf_dir, "documents").select("doc_id", "source", word_count(F.col("text")).alias("size")), "counted")
    return mix(docs, size=F.col("size")).select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def op9_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillon.llm.passages import repeated_passages

    return repeated_passages(table(spark, sf_dir, "documents"))


def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillon.llm.chat import as_events, read_loss, read_turns, reconstruct, render

    says = "</s>[INST] ok [/INST]"
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    own = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(says).alias("text"))
    chats = render(reconstruct(as_events(rows.unionByName(own))))
    chats = chats.select("conv_id", "formatted", read_turns(F.col("formatted")).alias("turns"), read_loss(F.col("segments")).alias("loss"))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return chats.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def op1_vector_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillon.llm.vectors import near_vectors

    return near_vectors(table(spark, sf_dir, "embeddings"))


def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillon.llm.language import held_out, identify, learn

    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = learn(docs.filter(~held_out()))
    return identify(docs.select("doc_id", "text"), model).select("doc_id", held_out().alias("held_out"), "lang_pred", F.col("lang_score").alias("score"))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillon.llm.simhash import simhash_groups

    groups = simhash_groups(table(spark, sf_dir, "documents"))
    return groups.select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")


def op7_sketches(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillon.llm.sketches import compare_with_edited

    return compare_with_edited(table(spark, sf_dir, "documents"))


def mixing_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What of op8_mixing has a form in SQL."""
    return op8_mixing(spark, sf_dir).select("doc_id", "size", "source_size", "target")


def secret_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What of op4_secret_scan has a form in SQL."""
    return op4_secret_scan(spark, sf_dir).select("doc_id", "n_assign", "n_access", "n_hex")


def edited_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What of op7_sketches has a form in SQL."""
    return op7_sketches(spark, sf_dir).select("doc_id", "n_chars", "edited_sha256")


OPERATORS = (op1_vector_forest, op2_language, op3_best_fit_packing, op4_secret_scan, op5_token_files, op6_simhash, op7_sketches, op8_mixing, op9_passages, op10_chat_format)
PARTS = (mixing_targets, secret_counts, edited_texts)
QUERIES = {f.__name__: f for f in OPERATORS + PARTS}

# Characters that escaping adds: one for each backslash and each control string.
_ADDED = "+".join(f"(length({{0}}) - length(replace({{0}}, '{s}', ''))) // {len(s)}" for s in ("\\", "<s>", "</s>", "[INST]", "[/INST]"))

_KEYWORDS = "|".join("".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in w) for w in ("password", "passwd", "secret", "token", "api_?key"))

ORACLES: dict[str, str] = {
    "op1_vector_forest": """
        with recursive v as (
            select vec_id, label, embedding::double[] as e from embeddings
            where label is not null and len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0
        ),
        links as (select a.vec_id as x, b.vec_id as y from v a join v b on a.label = b.label and a.vec_id <> b.vec_id and len(a.e) = len(b.e) where list_cosine_similarity(a.e, b.e) >= 0.93),
        reach(x, y) as (select vec_id, vec_id from embeddings union select r.x, l.y from reach r join links l on l.x = r.y),
        roots as (select x, min(y) as component_id from reach group by x),
        counts as (select x, count(*) as n from links group by x)
        select e.vec_id, coalesce(c.n, 0) as n_links, r.component_id, e.vec_id = r.component_id as kept from embeddings e join roots r on r.x = e.vec_id left join counts c on c.x = e.vec_id
    """,
    "mixing_targets": r"""
        with d as (select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as size from documents),
        s as (select source, sum(size) as source_size from d group by source),
        w as (select *, [5, 2, 1][(row_number() over (order by source nulls last) - 1) % 3 + 1] as weight from s),
        o as (select *, 3 * source_size / weight as ratio, row_number() over (order by 3 * source_size / weight, source nulls last) as place from w),
        l as (select a.place, a.ratio, ((select sum(source_size) from o) - coalesce((select sum(3 * source_size) from o b where b.place < a.place), 0))::double / (select sum(weight) from o b where b.place >= a.place)::double as level from o a),
        f as (select level from l where level <= ratio order by place limit 1)
        select d.doc_id, d.size::bigint as size, o.source_size::bigint as source_size,
            case when coalesce(o.ratio < (select level from f), true) then 3.0 * o.source_size else (select level from f) * o.weight end::double as target
        from d join o on o.source is not distinct from d.source
    """,
    "secret_counts": rf"""
        select doc_id, len(list_filter(regexp_extract_all(t, '({_KEYWORDS})["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 2), lambda x: length(x) >= 8)) as n_assign,
            len(list_filter(regexp_extract_all(t, 'AKIA[A-Z0-9]+'), lambda x: length(x) >= 16)) as n_access, len(list_filter(regexp_extract_all(t, '[0-9a-f]+'), lambda x: length(x) >= 32)) as n_hex
        from (select doc_id, coalesce(text, '') as t from documents)
    """,
    "edited_texts": """
        with d as (select doc_id, coalesce(text, '') as t from documents),
        n as (select doc_id, t, length(t) as n, coalesce(lead(t) over (order by doc_id desc), first_value(t) over (order by doc_id desc)) as after from d)
        select doc_id, n as n_chars, sha256(left(t, n - n // 2) || left(after, n // 2)) as edited_sha256 from n
    """,
    "op10_chat_format": f"""
        with said as (
            select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
            union all select -1, 0, 'user', '</s>[INST] ok [/INST]'
            union all select -1, 1, 'assistant', '</s>[INST] ok [/INST]'
        )
        select conv_id, count(*) as n_turns,
            sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn nulls first, role, text)) as turns_sha256,
            cast(coalesce(sum(length(text)) filter (where role = 'assistant'), 0) as bigint) as loss_chars,
            sha256(coalesce(string_agg(text, '' order by turn nulls first, text) filter (where role = 'assistant'), '')) as loss_sha256,
            cast(sum(20 + length(role) + length(text) + {_ADDED.format("role")} + {_ADDED.format("text")}) as bigint) as formatted_chars
        from said group by conv_id
    """,
}
