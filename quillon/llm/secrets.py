"""Secret scans with multipart credential linking.

Strong parts (keyword assignments, access keys, long hex) always count. Weak parts (identifiers of
an account, bare key-like tokens, endpoints) are what clean texts hold as well; they count only as
part of a credential: parts are joined with the scopes that their intervals lie in, a scope being a
run of lines without an empty line between them. An identifier needs a secret in its scope; a bare
token an identifier, an access key or the endpoint of a service; the endpoint of a service a secret;
and a web address, which is seldom part of one, an assignment, or a secret and an identifier. Parts
and scopes are swept in order, so a text of any length takes n log n.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon.llm._work import text_slices, trimmed

# The patterns of the strong kinds, in the order in which kinds are listed.
ASSIGN = re.compile("((?ai:password|passwd|secret|token|api_?key))[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
ACCESS = re.compile("AKIA[A-Z0-9]+")
HEX = re.compile("[0-9a-f]{32,}")  # runs are maximal, so this equals all runs without the short ones
STRONG = ("assign", "access", "hex")
WEAK = ("identifier", "key", "endpoint")
KINDS = STRONG + WEAK

_WORDS = ("passw", "secret", "token", "api")
IDENTIFIER = re.compile("(?ai:client_?id|account_?id|tenant_?id|user_?name|login|user)[\"']?\\x20*[:=]\\x20*[\"']?[A-Za-z0-9_.@-]{3,}")
KEY = re.compile("(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*[0-9])(?=[A-Z0-9+/_-]*[a-z])(?=[a-z0-9+/_-]*[A-Z])[A-Za-z0-9+/_-]{20,}={0,2}")
ENDPOINT = re.compile("(?ai:https?|postgres(?:ql)?|mysql|redis|amqp|mongodb|s3)://[^\\s\"'<>]+|(?ai:host|endpoint|region|server)[\"']?\\x20*[:=]\\x20*[\"']?[A-Za-z0-9_.:-]{3,}")
EMPTY_LINE = re.compile("\\n[ \\t\\r]*\\n")

Span = tuple[str, int, int]


def strong_spans(text: str) -> list[Span]:
    """Leftmost non-overlapping matches of each strong kind, in code points, end exclusive, in order."""
    found: list[Span] = []
    low = text.lower()
    if any(w in low for w in _WORDS):
        found += [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        found += [("access", *m.span()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    found += [("hex", *m.span()) for m in HEX.finditer(text)]
    return ordered(found)


def ordered(spans: list[Span]) -> list[Span]:
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def linked_spans(text: str, strong: list[Span]) -> list[Span]:
    """The weak parts of ``text`` that complementary parts of their scope make credentials.

    Weak parts that overlap strong ones don't count. One sweep over the parts notes what each scope holds.
    """
    named = ":" in text or "=" in text
    found: list[Span] = [("identifier", *m.span()) for m in IDENTIFIER.finditer(text)] if named else []
    endpoints = [("endpoint", *m.span()) for m in ENDPOINT.finditer(text)] if named else []
    services = [s for s in endpoints if text[s[1] : s[1] + 4].lower() != "http"]
    if found or services or any(kind == "access" for kind, _, _ in strong):
        found += [("key", *m.span()) for m in KEY.finditer(text)]
    found += endpoints
    if not found:
        return []
    starts, ends, reach = [], [], 0
    for _, start, end in strong:  # in order of start, so the furthest end so far tells whether any goes on
        reach = max(reach, end)
        starts.append(start)
        ends.append(reach)

    def free(span: Span) -> bool:
        before = bisect_left(starts, span[2])
        return span[0] == "identifier" or not before or ends[before - 1] <= span[1]

    found = [s for s in found if free(s)]
    cuts = [m.start() for m in EMPTY_LINE.finditer(text)]
    scope = lambda span: bisect_right(cuts, span[1])
    held: dict[int, set[str]] = {}
    for span in strong + found:
        held.setdefault(scope(span), set()).add(span[0])
    for span in services:
        if free(span):
            held[scope(span)].add("service")

    def complete(span: Span) -> bool:
        has = held[scope(span)]
        owner, secret = has & {"access", "identifier"}, has & {"assign", "hex", "key"}
        if span[0] == "identifier":
            return bool(secret)
        if span[0] == "key":
            return bool(owner or "service" in has)
        web = text[span[1] : span[1] + 4].lower() == "http"
        return bool(secret and (owner or "assign" in has or not web))

    return [s for s in found if complete(s)]


def secret_spans(text: str | None) -> list[Span]:
    strong = strong_spans(text or "")
    return ordered(strong + linked_spans(text or "", strong))


SPANS = "array<struct<kind:string,start:int,end:int>>"
_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))


def find_secrets(docs: DataFrame) -> DataFrame:
    """doc_id and ``spans`` (kind, start, end in code points of the whole text), in order of start.

    Null and empty texts have no spans. Repeated rows give repeated rows; other columns are left aside.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch):
                spans = [[{"kind": k, "start": s, "end": e} for k, s, e in secret_spans(t)] for t in part.column("text").to_pylist()]
                yield pa.record_batch([part.column("doc_id"), pa.array(spans, _SPANS)], names=["doc_id", "spans"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(trimmed(scan), f"doc_id long, spans {SPANS}")


def masked(text: str, spans: list[Span]) -> str:
    """``text`` with every maximal overlap of spans replaced by the kind of its first span."""
    out, at, kind, last = [], 0, "", -1
    for k, s, e in spans:
        if s < last:
            last = max(last, e)
            continue
        if last >= 0:
            out.append(f"[{kind.upper()}]")
            at = last
        out.append(text[at:s])
        kind, last = k, e
    if last >= 0:
        out.append(f"[{kind.upper()}]")
        at = last
    return "".join(out) + text[at:]


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with found spans replaced in ``text``, and ``n_chars``, if there is one, counted anew.

    All rows and all other columns stay; texts without secrets, and nulls, stay as they are.
    """
    fields = docs.schema

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch):
                texts = part.column("text").to_pylist()
                new = [masked(t, s) if t and (s := secret_spans(t)) else t for t in texts]
                at = part.schema.get_field_index("text")
                part = part.set_column(at, part.schema.field(at), pa.array(new, part.schema.field(at).type))
                if (n := part.schema.get_field_index("n_chars")) >= 0:
                    kind = part.schema.field(n)
                    counts = [len(b) if b != a else c for a, b, c in zip(texts, new, part.column(n).to_pylist())]
                    part = part.set_column(n, kind, pa.array(counts, kind.type))
                yield part

    return docs.mapInArrow(trimmed(clean), T.StructType([T.StructField(f.name, f.dataType) for f in fields]))


def as_text(spans: Column, kinds: tuple[str, ...] = KINDS) -> Column:
    """Spans of some kinds as kind:start:end, joined by commas."""
    own = F.filter(spans, lambda s: s["kind"].isin(*kinds))
    return F.array_join(F.transform(own, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def count_of(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")
