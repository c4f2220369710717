"""Whole-text token ids of a public tokenizer, with a memo of what lies between white space.

A byte-pair tokenizer works on pre-tokens that never reach across the start of a run of white
space, so the ids of a text are the ids of its chunks, one after the other. Running text repeats
most of its chunks; each worker keeps the ids of those it has met, in two generations of bounded
size, and gives only new ones to the library. Tokenizers of another shape, and texts that hold the
string of an added token, are run as they are.
"""

from __future__ import annotations

import json
import os
import re
import unicodedata
from collections.abc import Iterable

import numpy as np

# The code points with the Unicode property White_Space, and the pattern by which
# byte-level tokenizers cut text before merging.
WHITE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
BYTE_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: The pattern of word-level ones, and signs that are one piece by either pattern where they follow letters to the end of a chunk.
WORD_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
SIGNS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"

#: Chunks kept in a generation of the memo: about 90 MB at most in each worker.
MEMO = 400_000

#: Long chunks (base64 lines, say) seldom return; they aren't kept.
KEPT_CHARS = 40


def _byte_letters() -> dict[int, str]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return {b: chr(b if b in plain else next(spare)) for b in range(256)}


class Encoder:
    """``encode(texts)`` gives for each text its ids as little-endian unsigned 32-bit bytes.

    These are what the library gives with add_special_tokens=False. It takes strings of special tokens in a text
    for these tokens; ``as_text`` makes them ordinary text.
    """

    def __init__(self, path: str, as_text: bool = False):
        import regex
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.whole.encode_special_tokens = as_text
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.model = self.whole.model
        kinds = [n["type"] for n in (spec.get("normalizer") or {}).get("normalizers", [])]
        before = spec.get("pre_tokenizer") or {}
        steps = before.get("pretokenizers", [])
        plain_model = spec["model"]["type"] == "BPE" and not spec["model"].get("dropout")
        self.fold, self.chunks, self.cut, self.known = False, None, None, False
        if plain_model and spec.get("normalizer") is None and before.get("type") == "ByteLevel" and before.get("use_regex") and not before.get("add_prefix_space"):
            self.chunks = re.compile(f"[{WHITE}]*[^{WHITE}]+|[{WHITE}]+")
            self.cut, self.known = regex.compile(BYTE_LEVEL), True
        elif plain_model and kinds == ["NFC", "Replace", "Lowercase"] and [s["type"] for s in steps] == ["Split", "ByteLevel"] and steps[0]["behavior"] == "Removed" and steps[0]["invert"] and not steps[1]["use_regex"] and not steps[1]["add_prefix_space"]:
            self.fold, self.chunks = True, re.compile(f"[^{WHITE}]+")
            self.cut, self.known = regex.compile(steps[0]["pattern"]["Regex"]), steps[0]["pattern"]["Regex"] == WORD_LEVEL
        self.letters = _byte_letters()
        self.bytes = [i.to_bytes(4, "little") for i in range(1 + max(spec["model"]["vocab"].values(), default=-1))] if plain_model else []
        # What this module cuts itself; anything else goes to the library as a chunk.
        self.simple = re.compile("[\\t\\n\\r -~\\u00a1-\\u024f\\u0370-\\u03ff\\u0400-\\u04ff]+").fullmatch
        # A text with a string of an added token, in whatever case, goes to the library whole: it cuts these out first.
        added = [t["content"] for t in spec.get("added_tokens") or [] if t["content"]]
        start = re.match("[^A-Za-z\x80-\U0010ffff]*", os.path.commonprefix(added))[0]  # signs that all begin with, quick to look for
        held = re.compile("|".join(map(re.escape, added)), re.IGNORECASE).search
        self.added = (lambda text: start in text and held(text)) if added else lambda text: None
        self.memo = type("Memo", (dict,), {"__missing__": self._missing})
        self.young: dict[str, bytes] = self.memo()
        self.old: dict[str, bytes] = {}
        self.pieces: dict[str, bytes] = {}

    def _whole(self, text: str) -> bytes:
        return np.array(self.whole.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def _piece(self, piece: str) -> bytes:
        ids = self.pieces.get(piece)
        if ids is None:
            if not piece.isascii():
                shown = "".join(map(self.letters.__getitem__, piece.encode()))
            elif piece.isalnum():
                shown = piece
            elif piece[0] == " " and piece[1:].isalnum():
                shown = self.letters[32] + piece[1:]
            else:
                shown = "".join(map(self.letters.__getitem__, piece.encode()))
            ids = b"".join([self.bytes[t.id] for t in self.model.tokenize(shown)])
            if len(self.pieces) >= MEMO:
                self.pieces.clear()
            if len(piece) <= KEPT_CHARS:
                self.pieces[piece] = ids
        return ids

    def _chunk(self, chunk: str) -> bytes:
        plain = chunk.isascii()
        if not plain and not self.simple(chunk):
            return self._whole(chunk)
        if self.fold:
            chunk = chunk.lower() if plain else "".join(map(str.lower, unicodedata.normalize("NFC", chunk)))
        if self.known:
            # Most new chunks are a word of letters, perhaps after a line's end or before signs: these need no pattern.
            line = chunk[0] == "\n"
            rest = chunk[1:] if line else chunk
            body = rest.rstrip(SIGNS)
            if body[not line and body[:1] == " " :].isalpha():
                ids = self._piece(body) if len(body) == len(rest) else self._piece(body) + self._piece(rest[len(body) :])
                return self._piece("\n") + ids if line else ids
        if plain and not self.simple(chunk):
            return self._whole(chunk)
        return b"".join([self._piece(p) for p in self.cut.findall(chunk)])

    def _missing(self, chunk: str) -> bytes:
        ids = self.old.get(chunk)
        if ids is None:
            ids = self._chunk(chunk)
        if len(chunk) <= KEPT_CHARS:
            if len(self.young) >= MEMO:
                self.old, self.young = self.young, self.memo()
            self.young[chunk] = ids
        return ids

    def encode(self, texts: Iterable[str]) -> list[bytes]:
        if self.chunks is None:
            return [self._whole(t) for t in texts]
        return [self._whole(t) if self.added(t) else b"".join(map(self.young.__getitem__, self.chunks.findall(t))) for t in texts]


_ENCODERS: dict[tuple[str, bool], Encoder] = {}


def encoder(path: str, as_text: bool = False) -> Encoder:
    """One encoder a tokenizer in each Python worker, which Spark keeps for later tasks."""
    if (path, as_text) not in _ENCODERS:
        _ENCODERS[path, as_text] = Encoder(path, as_text)
    return _ENCODERS[path, as_text]
