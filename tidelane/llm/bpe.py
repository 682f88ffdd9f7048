"""Byte-level BPE by dynamic programming over prefixes, and decoding.

For every prefix of a piece one token ends its encoding. It is found among the tokens that an automaton reports as
suffixes of the prefix: the one that is compatible with the last token of the prefix before it. Two tokens are
compatible if no merge across their border would have come before a merge inside them. The ids are read off the
back-pointers. No step depends on the order of merges in the piece, so a piece of n bytes costs O(n) automaton steps.
"""

from __future__ import annotations

import hashlib
import json
from array import array
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_limits, lean

#: Segments of each of the two generations in a worker's cache, and token pairs before that cache is emptied.
SEGMENTS, PAIRS = 250_000, 500_000
#: Stands for the rank of a merge that never comes.
_NEVER = 1 << 40

#: Fixed by the vocabulary: how texts are cut into pieces before merging. White space as Unicode defines it.
_BLANKS = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
PIECE = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_BLANKS}\p{{L}}\p{{N}}]+|[{_BLANKS}]+(?![^{_BLANKS}])|[{_BLANKS}]+")
#: Characters whose classes no Unicode version changes; texts with others are cut by the tokenizers library itself.
_STABLE = regex.compile(r"[^\x00-\u024f\u2010-\u2027]")

_TOUCHING = regex.compile(rf"[{_BLANKS}]{{2}}")


def byte_characters() -> dict[str, int]:
    """The printable stand-ins for bytes in the vocabulary file: printable Latin-1 characters stand for themselves, the other bytes for 256, 257 and so on, in order."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class Vocabulary:
    """Tokens, merges and added tokens of a byte-level BPE file (its JSON text)."""

    def __init__(self, text: str):
        data = json.loads(text)
        model, bytes_of = data["model"], byte_characters()
        raw = lambda token: bytes(bytes_of[c] for c in token)
        self.tokens: dict[int, bytes] = {i: raw(t) for t, i in model["vocab"].items()}
        self.ids = {t: i for i, t in self.tokens.items()}
        self.added = {t["content"]: t["id"] for t in data["added_tokens"]}
        self.tokens |= {i: t.encode() for t, i in self.added.items()}
        self.rank: dict[int, int] = {}  # of a pair, first << 20 | second
        self.made: dict[int, tuple[int, int, int]] = {}
        for n, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            a, b, both = model["vocab"][a], model["vocab"][b], model["vocab"][a + b]
            self.rank[a << 20 | b] = n
            self.made.setdefault(both, (n, a, b))
        self.left = {t: self._edge(t, 1) for t in self.ids.values()}
        self.right = {t: [(p << 20, end) for p, end in self._edge(t, 2)] for t in self.ids.values()}
        self.reachable: dict[int, bool] = {}
        for token in self.ids.values():
            self._reach(token)
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for token, i in self.ids.items():
            if self.reachable[i]:
                self.automaton.add_word(token.decode("latin-1"), (i, len(token)))
        self.automaton.make_automaton()
        self.special = regex.compile("(" + "|".join(map(regex.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        self.pairs: dict[int, bool] = {}
        self.segments: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.numerals = {i: str(i) for i in self.tokens}
        self._cut = None

    def _edge(self, token: int, side: int) -> list[tuple[int, int]]:
        """The parts that lie at the token's left (1) or right (2) edge while it is merged, from the whole down, each with the rank of the merge that absorbs it."""
        out, end = [(token, _NEVER)], _NEVER
        while token in self.made:
            end, token = self.made[token][0], self.made[token][side]
            out.append((token, end))
        return out

    def _apart(self, left: int, right: int, before: int, joint: int = -1) -> bool:
        """Whether no pair of parts across the border of left and right merges, by a merge before `before` and other than `joint`.

        A pair of parts merges, and spoils both tokens, if its rank comes before the absorption of either; of equal
        ranks the leftmost pair goes first, which is the one inside left.
        """
        rank = self.rank
        for a, a_end in self.right[left]:
            a_end = min(a_end, before)
            for b, b_end in self.left[right]:
                n = rank.get(a | b)
                if n is not None and n < a_end and n <= b_end and n != joint:
                    return False
        return True

    def _reach(self, token: int) -> bool:
        """Whether the encoding of the token's bytes is the token: its two halves come about, and join each other before any of their parts do."""
        known = self.reachable.get(token)
        if known is None:
            if token in self.made:
                n, a, b = self.made[token]
                known = self._reach(a) and self._reach(b) and self._apart(a, b, n + 1, n)
            else:
                known = len(self.tokens[token]) == 1
            self.reachable[token] = known
        return known

    def compatible(self, left: int, right: int) -> bool:
        """Whether the encoding of left's bytes followed by right's is just these two tokens."""
        key = left << 20 | right
        known = self.pairs.get(key)
        if known is None:
            if len(self.pairs) >= PAIRS:
                self.pairs.clear()
            known = self.pairs[key] = self._apart(left, right, _NEVER)
        return known

    def encode_piece(self, piece: bytes) -> list[int]:
        token = self.ids.get(piece)
        if token is not None and self.reachable[token]:
            return [token]
        last = [-1] * (len(piece) + 1)  # of each prefix, by its length
        pairs = self.pairs
        for end, (token, size) in self.automaton.iter(piece.decode("latin-1")):
            end += 1
            if last[end] < 0:
                if size == end:
                    last[end] = token
                else:
                    before = last[end - size]
                    known = pairs.get(before << 20 | token)
                    if known if known is not None else self.compatible(before, token):
                        last[end] = token
        out, at = [], len(piece)
        while at:
            out.append(last[at])
            at -= len(self.tokens[last[at]])
        out.reverse()
        return out

    def cut(self, text: str) -> list[str]:
        """The pieces of a text without added tokens."""
        if not _STABLE.search(text):
            return PIECE.findall(text)
        if self._cut is None:
            from tokenizers.pre_tokenizers import ByteLevel

            self._cut = ByteLevel(add_prefix_space=False, use_regex=True)
        return [text[a:b] for _, (a, b) in self._cut.pre_tokenize_str(text)]

    def _segment(self, segment: str) -> bytes:
        """Ids of a text, its pieces encoded."""
        out: list[int] = []
        for piece in self.cut(segment):
            out += self.encode_piece(piece.encode())
        return array("I", out).tobytes()

    def _part(self, text: str) -> bytes:
        """Ids of a text without added tokens.

        Where no two blanks touch, no piece reaches across a space but by having it in front: then the text is cut at
        spaces, and a segment with the space in front of it has its own ids. Else pieces are looked up one by one.
        """
        if _STABLE.search(text) or _TOUCHING.search(text):
            first, rest, mark = "", self.cut(text), ""
        else:
            (first, *rest), mark = text.split(" "), " "
        # without a mark in front a piece is filed under a name that no segment has
        names = rest if mark else [" " + s for s in rest]
        found = list(map(self.segments.get, names))
        if None in found:
            if len(self.segments) >= SEGMENTS:  # what was seen since the last change of generation outlives this one
                self.segments, self.older = {}, self.segments
            for i, ids in enumerate(found):
                if ids is None:
                    name = names[i]
                    ids = self.segments.get(name) or self.older.get(name)
                    if ids is None:
                        ids = self._segment(mark + rest[i]) if mark else array("I", self.encode_piece(rest[i].encode())).tobytes()
                    if len(name) <= 64:
                        self.segments[name] = ids
                    found[i] = ids
        return self._segment(first) + b"".join(found)

    def encode_bytes(self, text: str) -> bytes:
        """Unsigned 32-bit little-endian ids."""
        if not self.special or not self.special.search(text):
            return self._part(text)
        return b"".join([array("I", [self.added[p]]).tobytes() if p in self.added else self._part(p) for p in self.special.split(text) if p])

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.encode_bytes(text), dtype="<u4").tolist()

    def decode(self, ids: list[int]) -> str:
        """Unknown ids are left out, as are none of the added tokens; bytes that aren't UTF-8 become U+FFFD."""
        tokens = self.tokens
        return b"".join([tokens.get(i, b"") for i in ids]).decode("utf-8", errors="replace")


_LOADED: dict[int, Vocabulary] = {}


def _vocabulary(shared) -> Vocabulary:
    """One for each Python worker: workers live on between tasks."""
    text = shared.value
    key = hash(text)
    if key not in _LOADED:
        _LOADED.clear()
        _LOADED[key] = Vocabulary(text)
    return _LOADED[key]


def share_vocabulary(df: DataFrame, path: str):
    """The file's text (a few MB, whatever the input's size), read once on the driver, so executors need no copy."""
    with open(path, encoding="utf-8") as f:
        return df.sparkSession.sparkContext.broadcast(f.read())


@lean
def _encode(batches, shared) -> Iterator[pa.RecordBatch]:
    v = _vocabulary(shared)
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([v.encode_bytes(x.as_py() or "") for x in batch.column(1)], pa.binary())], ["doc_id", "ids"])


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids (unsigned 32-bit little-endian numbers): the whole text of every row, null as empty.

    An added token's string in a text is that token, as the library does by default. Doc ids pass through, null or repeated; other columns are not read.
    """
    arrow_limits(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(partial(_encode, shared=share_vocabulary(docs, path)), "doc_id long, ids binary")


@lean
def _decode(batches, shared) -> Iterator[pa.RecordBatch]:
    v = _vocabulary(shared)
    for batch in batches:
        rows = [np.frombuffer(x.as_py() or b"", dtype="<u4").tolist() for x in batch.column(1)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(map(v.decode, rows), pa.string())], ["doc_id", "text"])


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id, text from doc_id, ids; null ids give an empty text."""
    return encoded.select("doc_id", "ids").mapInArrow(partial(_decode, shared=share_vocabulary(encoded, path)), "doc_id long, text string")


@lean
def _round_trip(batches, shared) -> Iterator[pa.RecordBatch]:
    v = _vocabulary(shared)
    numeral = v.numerals
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    for batch in batches:
        n, ids_sha, text_sha = [], [], []
        for text in batch.column(1):
            ids = np.frombuffer(v.encode_bytes(text.as_py() or ""), dtype="<u4").tolist()
            n.append(len(ids))
            ids_sha.append(sha(",".join([numeral[i] for i in ids])))
            text_sha.append(sha(v.decode(ids)))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])


def round_trip(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (of decimal ids joined by commas), decoded_sha256 (of the text that the ids decode to): encode() and decode() in one pass, for every row; the cases are encode()'s."""
    arrow_limits(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(partial(_round_trip, shared=share_vocabulary(docs, path)), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
