"""Language identification of mixed-language text.

A word (a run of letters) scores, for every language, the log-odds of its character 3- and 4-grams.
The script of its first letter narrows the languages down to those that were seen to use it.
Viterbi over a document's words, with a penalty for each switch of language, labels spans; the
language of most letters is the document's, and their share its score.

Counts of n-grams are learned on a sample of labelled rows, at most about ``ROWS`` for each language,
taken by a hash of doc_id, and for at most ``LANGS`` languages. The model is a table of ``BUCKETS`` log-odds a language.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.llm._work import stash, text_slices, trimmed

#: Labelled rows learned from for each language, about, and languages that are learned at most: those of most rows.
ROWS = 5_000
LANGS = 256

#: Code points beyond which none is a letter.
POINTS = 0x40000
BUCKETS = 1 << 17

#: Nats that a switch of language costs, what a word outside a language's scripts loses, letters of a script that make it a language's.
SWITCH, OUTSIDE, SCRIPT_SHARE = 12.0, 60.0, 0.01

#: Words that are walked one by one; documents are walked side by side in chunks of so many.
CHUNK = 64

UNKNOWN = "und"

# First code points of blocks of one script, and its name; ranges not listed count as the one before.
SCRIPTS = (
    (0x0000, "Latin"), (0x0370, "Greek"), (0x0400, "Cyrillic"), (0x0530, "Armenian"), (0x0590, "Hebrew"), (0x0600, "Arabic"),
    (0x0900, "Devanagari"), (0x0980, "Bengali"), (0x0A00, "Gurmukhi"), (0x0A80, "Gujarati"), (0x0B00, "Oriya"), (0x0B80, "Tamil"),
    (0x0C00, "Telugu"), (0x0C80, "Kannada"), (0x0D00, "Malayalam"), (0x0D80, "Sinhala"), (0x0E00, "Thai"), (0x0E80, "Lao"),
    (0x0F00, "Tibetan"), (0x1000, "Myanmar"), (0x10A0, "Georgian"), (0x1100, "Hangul"), (0x1200, "Ethiopic"), (0x13A0, "Cherokee"),
    (0x1780, "Khmer"), (0x1800, "Mongolian"), (0x1E00, "Latin"), (0x1F00, "Greek"), (0x2000, "Latin"), (0x2C80, "Coptic"), (0x2E80, "Han"),
    (0x3040, "Hiragana"), (0x30A0, "Katakana"), (0x3100, "Han"), (0xAC00, "Hangul"), (0xF900, "Han"), (0xFB00, "Latin"), (0xFB1D, "Hebrew"),
    (0xFB50, "Arabic"), (0xFF00, "Latin"), (0x10000, "Other"), (0x20000, "Han"),
)
SCRIPT_NAMES = sorted({name for _, name in SCRIPTS})


@lru_cache(maxsize=1)
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each code point below POINTS its lower-case form if it is a letter, else 0; and the blocks of scripts."""
    letter = np.zeros(POINTS, np.uint32)
    for c in range(POINTS):
        if unicodedata.category(ch := chr(c))[0] == "L":
            low = ch.lower()
            letter[c] = ord(low) if len(low) == 1 else c
    return letter, np.array([s for s, _ in SCRIPTS]), np.array([SCRIPT_NAMES.index(n) for _, n in SCRIPTS])


def letters_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Lower-case code points of all texts (0 for anything but letters), each text after a 0, and where each begins."""
    letter, _, _ = _tables()
    points = np.frombuffer(("\0" + "\0".join(texts) + "\0").encode("utf-32-le", "surrogatepass"), "<u4")
    lengths = np.array([len(t) + 1 for t in texts], np.int64)
    return np.where(points < len(letter), letter[np.minimum(points, len(letter) - 1)], 0), np.concatenate([[0], np.cumsum(lengths)]) + 1


def grams(c: np.ndarray, at: np.ndarray) -> list[np.ndarray]:
    """Buckets of the 3-gram around and the 4-gram from before each of the letters ``at``; 0 stands for a word's edge."""
    three = c[at - 1] * np.uint64(0x9E3779B97F4A7C15) + c[at] * np.uint64(0xC2B2AE3D27D4EB4F) + c[at + 1] * np.uint64(0x165667B19E3779F9)
    beyond = np.where(c[at + 1] > 0, c[np.minimum(at + 2, len(c) - 1)], np.uint64(0))
    four = three + beyond * np.uint64(0x27D4EB2F165667C5) + np.uint64(1)
    shift = np.uint64(64 - (BUCKETS.bit_length() - 1))
    return [((x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> shift).astype(np.int64) for x in (three, four)]


def words_of(c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    letter = c > 0
    return np.flatnonzero(letter[1:] & ~letter[:-1]) + 1, np.flatnonzero(letter[:-1] & ~letter[1:]) + 1


def script_of(points: np.ndarray) -> np.ndarray:
    _, starts, names = _tables()
    return names[np.searchsorted(starts, points, side="right") - 1]


class Model:
    """Languages, log-odds of buckets (BUCKETS, languages), and penalties of scripts (scripts, languages)."""

    def __init__(self, langs: list[str], counts: np.ndarray, scripts: np.ndarray):
        self.langs = langs
        self.odds = np.zeros((BUCKETS, len(langs)), np.float32)
        if langs:
            total = counts.sum(axis=0, keepdims=True)
            rate = np.log((counts + 0.5) / (total + 0.5 * BUCKETS))
            self.odds[:] = 0.5 * (rate - rate.mean(axis=1, keepdims=True))  # both orders tell much the same
        used = scripts >= SCRIPT_SHARE * np.maximum(scripts.sum(axis=0, keepdims=True), 1)
        # A script that no language was seen to use narrows nothing.
        self.scripts = np.where(used | ~used.any(axis=1, keepdims=True), 0.0, -OUTSIDE).astype(np.float32)

    def word_scores(self, c: np.ndarray, starts: np.ndarray, stops: np.ndarray, block: int = 1 << 18) -> np.ndarray:
        """Scores (words, languages); words are taken in blocks of about so many code points."""
        out = np.empty((len(starts), len(self.langs)), np.float32)
        wide, at = c.astype(np.uint64), 0
        while at < len(starts):
            to = max(at + 1, int(np.searchsorted(stops, starts[at] + block)))
            sizes = stops[at:to] - starts[at:to]
            places = np.repeat(starts[at:to] - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
            three, four = grams(wide, places)
            out[at:to] = np.add.reduceat(self.odds[three] + self.odds[four], np.cumsum(sizes) - sizes, axis=0)
            at = to
        return out + self.scripts[script_of(c[starts])]


def viterbi(scores: np.ndarray, before: np.ndarray, switch: float = SWITCH) -> np.ndarray:
    """Best language of each word. ``before``: words before each document, and of all.

    Documents are cut into chunks of CHUNK words. First each chunk's best score from every language at
    its start to every language at its end is found, for all chunks side by side; then these are
    chained along each document; then each chunk is walked from its known start, and back from its end.
    """
    n_langs = scores.shape[1]
    counts = np.diff(before)
    chunks = -(-counts // CHUNK)
    first = np.cumsum(chunks) - chunks
    total = int(chunks.sum())
    if not total or n_langs == 1:
        return np.zeros(len(scores), np.int64)
    order = np.arange(len(scores)) - np.repeat(before[:-1], counts)
    row, column = np.repeat(first, counts) + order // CHUNK, order % CHUNK
    x = np.zeros((CHUNK, total, n_langs), np.float32)  # what is beyond a document's end scores nothing
    x[column, row] = scores
    whole = np.full((total, n_langs, n_langs), -np.inf, np.float32)
    whole[:, np.arange(n_langs), np.arange(n_langs)] = 0
    for k in range(CHUNK):
        whole = np.maximum(whole, whole.max(axis=2, keepdims=True) - np.float32(switch)) + x[k][:, None, :]
    start = np.zeros((total, n_langs), np.float32)
    docs = np.flatnonzero(chunks)
    docs = docs[np.argsort(-chunks[docs], kind="stable")]
    depth = chunks[docs]
    for k in range(1, int(depth[0])):
        own = first[docs[: np.searchsorted(-depth, -k)]] + k - 1
        end = (start[own][:, :, None] + whole[own]).max(axis=1)
        start[own + 1] = end - end.max(axis=1, keepdims=True)
    came = np.empty((CHUNK, total, n_langs), np.uint8 if n_langs < 256 else np.uint16)
    v, own_lang = start.copy(), np.arange(n_langs)
    for k in range(CHUNK):
        best = v.max(axis=1, keepdims=True) - np.float32(switch)
        came[k] = np.where(v >= best, own_lang, v.argmax(axis=1)[:, None])
        v = np.maximum(v, best) + x[k]
    rows = np.arange(total)
    back = np.tile(own_lang, (total, 1))
    for k in range(CHUNK - 1, -1, -1):
        back = came[k][rows[:, None], back]
    end = np.zeros(total, np.int64)
    last = first[docs] + depth - 1
    end[last] = v[last].argmax(axis=1)
    for k in range(int(depth[0]) - 1, 0, -1):
        own = first[docs[: np.searchsorted(-depth, -k)]] + k
        end[own - 1] = back[own, end[own]]
    labels = np.empty((CHUNK, total), np.int64)
    for k in range(CHUNK - 1, -1, -1):
        labels[k] = end
        end = came[k][rows, end]
    return labels[column, row]


def held_out(doc_id: str = "doc_id") -> Column:
    return F.crc32(F.col(doc_id).cast("string")) % 5 == 0


def learn(docs: DataFrame, rows: int = ROWS) -> Model:
    """Model of the rows of ``docs`` (doc_id, text, lang) that have a lang. A null doc_id is never learned from.

    Of more than ``LANGS`` languages those of most rows are learned, so the model stays bounded whatever lang holds.
    Null and empty texts count as rows, and teach nothing. No labelled row gives a model without languages.
    """
    labelled = docs.select("doc_id", "text", "lang").filter(F.col("lang").isNotNull() & F.col("doc_id").isNotNull())
    counted = labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    sizes = {r.lang: r.n for r in counted.orderBy(F.col("n").desc(), "lang").limit(LANGS).collect()}
    langs = sorted(sizes)
    if not langs:
        return Model([], np.zeros((BUCKETS, 0)), np.zeros((len(SCRIPT_NAMES), 0)))
    share = F.try_element_at(F.create_map(*[F.lit(v) for lang in langs for v in (lang, min(1.0, rows / sizes[lang]))]), F.col("lang"))
    sample = labelled.filter(F.col("lang").isin(langs)).filter(F.pmod(F.xxhash64("doc_id", F.lit(2)), F.lit(1 << 20)) < share * (1 << 20))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((len(langs), BUCKETS + len(SCRIPT_NAMES)), np.int64)
        number = {lang: k for k, lang in enumerate(langs)}
        for batch in batches:
            for part in text_slices(batch, limit=1 << 20):
                by_lang: dict[int, list[str]] = {}
                for text, lang in zip(part.column("text").to_pylist(), part.column("lang").to_pylist()):
                    by_lang.setdefault(number[lang], []).append(text or "")
                for k, texts in by_lang.items():
                    c, _ = letters_of(texts)
                    at = np.flatnonzero(c)
                    for g in grams(c.astype(np.uint64), at):
                        sums[k, :BUCKETS] += np.bincount(g, minlength=BUCKETS)
                    sums[k, BUCKETS:] += np.bincount(script_of(c[at]), minlength=len(SCRIPT_NAMES))
        own, bucket = np.nonzero(sums)
        yield pa.record_batch([pa.array(own.astype(np.int32)), pa.array(bucket.astype(np.int32)), pa.array(sums[own, bucket])], names=["lang", "bucket", "n"])

    counted = sample.select("text", "lang").mapInArrow(trimmed(count), "lang int, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    table = stash(counted, "grams").toPandas()  # at most a row for each language and bucket
    sums = np.zeros((BUCKETS + len(SCRIPT_NAMES), len(langs)))
    sums[table["bucket"], table["lang"]] = table["n"]
    return Model(langs, sums[:BUCKETS], sums[BUCKETS:])


def label(model: Model, texts: list[str]) -> list[tuple[str, float, list[dict]]]:
    """Language, score and spans (start, end in code points, lang) of each text."""
    c, begin = letters_of(texts)
    starts, stops = words_of(c)
    before = np.searchsorted(starts, begin)
    before[-1] = len(starts)
    if not model.langs:
        return [(UNKNOWN, 0.0, [])] * len(texts)
    labels = viterbi(model.word_scores(c, starts, stops), before)
    doc = np.repeat(np.arange(len(texts)), np.diff(before))
    n = len(model.langs)
    weight = np.bincount(doc * n + labels, (stops - starts).astype(float), len(texts) * n).reshape(-1, n)
    total, best = weight.sum(axis=1), weight.argmax(axis=1)
    new = np.flatnonzero(np.concatenate([[True], (labels[1:] != labels[:-1]) | (doc[1:] != doc[:-1])])) if len(labels) else np.empty(0, np.int64)
    until = np.concatenate([new[1:], [len(labels)]])[: len(new)]
    spans: list[list[dict]] = [[] for _ in texts]
    for a, b in zip(new.tolist(), until.tolist()):
        d = doc[a]
        spans[d].append({"start": int(starts[a] - begin[d]), "end": int(stops[b - 1] - begin[d]), "lang": model.langs[labels[a]]})
    return [(model.langs[best[i]], float(weight[i, best[i]] / total[i]), spans[i]) if total[i] else (UNKNOWN, 0.0, []) for i in range(len(texts))]


SPANS = "array<struct<start:int,end:int,lang:string>>"
_SPANS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("lang", pa.string())]))


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with lang_pred, lang_score and lang_spans; columns of these names are replaced.

    Null texts and texts without letters are ``und`` with score 0, as is everything where nothing could
    be learned. Every row returns; only ``text`` is looked at. Ties go to the language first by name.
    """
    names = ("lang_pred", "lang_score", "lang_spans")
    rest = docs.drop(*names)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS floats a language

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            for part in text_slices(batch, limit=1 << 20):
                found = label(own, [t or "" for t in part.column("text").to_pylist()])
                new = [pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64()), pa.array([f[2] for f in found], _SPANS)]
                yield pa.record_batch([*part.columns, *new], names=[*part.schema.names, *names])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rest.schema)
    return rest.mapInArrow(trimmed(scan), f"{fields}, lang_pred string, lang_score double, lang_spans {SPANS}")
