"""Byte-level BPE encoding and decoding.

A text is cut into pre-tokens by the vocabulary's pattern; each pre-token's
bytes are read as Latin-1 characters, an Aho-Corasick automaton over the
vocabulary gives the longest token at each place, and the encoder walks from
longest matches, stepping back where two adjacent tokens could not both have
come out of the merge order. Whether two tokens may stand side by side is
decided once per pair and remembered, so the walk is linear in the bytes and
its result is that of applying the merges one by one.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from struct import pack

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import check_names, list_array

PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: A blank inside a run of white space: such texts can't be cut at blanks.
_INNER_BLANK = re.compile(r"\s (?=\s|\Z)")


class Codec:
    """Encoder and decoder over one vocabulary file of ranked byte strings."""

    def __init__(self, path: str, pattern: str = PATTERN, remember: int = 500_000):
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.token = {i: t for t, i in ranks.items()}
        self.id = {t.decode("latin-1"): i for t, i in ranks.items()}
        self.remember, self.split = remember, regex.compile(pattern).findall
        self.automaton = ahocorasick.Automaton()
        for text, i in self.id.items():
            self.automaton.add_word(text, (len(text), i))
        self.automaton.make_automaton()
        self.parts: dict[int, tuple[int, int]] = {}
        self.merged: dict[tuple[int, int], int] = {}
        self.agrees: dict[int, bool] = {}
        self.shorter_than: dict[int, int | None] = {}
        text_of = {i: t for t, i in self.id.items()}
        self.text_of = text_of
        self.size = {i: len(t) for i, t in text_of.items()}
        get = self.id.get
        for i in sorted(text_of):
            t = text_of[i]
            self.parts[i] = (i, i)
            for cut in range(1, len(t)):
                a, b = get(t[:cut]), get(t[cut:])
                if a is not None and b is not None and a < i and b < i and self._stand(a, b):
                    self.parts[i], self.merged[a, b] = (a, b), i
                    break
        self.agrees.clear()
        self.piece_cache = _Pieces(self, {})
        self.word_cache: dict[str, bytes] = {}
        self.old_words: dict[str, bytes] = {}

    def _stand(self, a: int, b: int) -> bool:
        """Whether the merges leave ``a`` and ``b`` side by side: undo the later
        merge at the border, step by step; no earlier merge may cross it."""
        parts, merged, limit = self.parts, self.merged, 1 << 60
        while True:
            if merged.get((a, b), limit) < limit:
                return False
            if a > b:
                limit, a = a, parts[a][1]
                if a == limit:
                    limit, b = b + 1, parts[b][0]
                    if b + 1 == limit:
                        return True
            else:
                limit, b = b + 1, parts[b][0]
                if b + 1 == limit:
                    limit, a = a, parts[a][1]
                    if a == limit:
                        return True

    def _fits(self, a: int, b: int) -> bool:
        known = self.agrees.get(a << 32 | b)
        if known is None:
            if len(self.agrees) > 4_000_000:
                self.agrees.clear()
            known = self.agrees[a << 32 | b] = self._stand(a, b)
        return known

    def _shorter(self, i: int) -> int | None:
        """The longest token that is a proper prefix of token ``i``."""
        if i not in self.shorter_than:
            t, get = self.text_of[i], self.id.get
            self.shorter_than[i] = next((x for n in range(len(t) - 1, 0, -1) if (x := get(t[:n])) is not None), None)
        return self.shorter_than[i]

    def merge(self, text: str) -> list[int]:
        """Token ids of one pre-token, given as Latin-1 characters."""
        whole = self.id.get(text)
        if whole is not None:
            return [whole]
        known, size_of = self.agrees, self.size
        greedy = [i for _, (_, i) in self.automaton.iter_long(text)]
        last, at = greedy[0], size_of[greedy[0]]
        for k in range(1, len(greedy)):
            token = greedy[k]
            fit = known.get(last << 32 | token)
            if not (self._fits(last, token) if fit is None else fit):
                return self._walk(text, greedy, k, at)
            last = token
            at += size_of[token]
        return greedy

    def _walk(self, text: str, greedy: list[int], k: int, at: int) -> list[int]:
        """Go on from token ``k`` of the longest matches, which doesn't fit at byte ``at``."""
        known, size_of, shorter, longest_from = self.agrees, self.size, self.shorter_than, self.automaton.iter_long
        n, out, token = len(text), greedy[:k], greedy[k]
        longest, start = {}, at
        for i in greedy[k:]:
            longest[start] = i
            start += size_of[i]
        closed: set[int] = set()
        while True:
            last = out[-1] if out else -1
            end = at + size_of[token]
            fit = end not in closed
            if fit and last >= 0:
                fit = known.get(last << 32 | token)
                if fit is None:
                    fit = self._fits(last, token)
            if fit:
                out.append(token)
                if end == n:
                    return out
                at = end
                token = longest.get(at)
                if token is None:
                    token = longest[at] = next(longest_from(text, at))[1][1]
                continue
            smaller = shorter[token] if token in shorter else self._shorter(token)
            if smaller is not None:
                token = smaller
            else:
                closed.add(at)
                token = out.pop()
                at -= size_of[token]

    def _pretoken(self, word: str) -> bytes:
        known = self.word_cache.get(word)
        if known is None:
            known = self.old_words.get(word)
        else:
            return known
        if len(self.word_cache) >= self.remember // 2:
            self.old_words, self.word_cache = self.word_cache, {}
        if known is None:
            ids = self.merge(word if word.isascii() else word.encode("utf-8").decode("latin-1"))
            known = pack(f"={len(ids)}i", *ids)
        self.word_cache[word] = known
        return known

    def encode_bytes(self, text: str) -> bytes:
        """Token ids of a whole text as native 32-bit integers."""
        if _INNER_BLANK.search(text):
            return b"".join(map(self._pretoken, self.split(text)))
        # every blank starts a pre-token here, so the text may be cut before blanks
        first, *rest = text.split(" ")
        if len(self.piece_cache) >= self.remember:
            self.piece_cache = _Pieces(self, self.piece_cache)
        head = b"".join(map(self._pretoken, self.split(first)))
        return head + b"".join(map(self.piece_cache.__getitem__, rest))

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.encode_bytes(text), np.int32).tolist()

    def decode(self, ids) -> str:
        return b"".join(map(self.token.__getitem__, ids)).decode("utf-8", "replace")


class _Pieces(dict):
    """Ids of what follows a blank, up to the next one; the blank belongs to it."""

    def __init__(self, codec: Codec, old: dict[str, bytes]):
        self.codec, self.old = codec, old
        if isinstance(old, _Pieces):
            old.old = {}

    def __missing__(self, piece: str) -> bytes:
        ids = self.old.get(piece)
        if ids is None:
            ids = b"".join(map(self.codec._pretoken, self.codec.split(" " + piece)))
        self[piece] = ids
        return ids


_CODECS: dict[tuple[str, str], Codec] = {}


def codec(path: str = VOCABULARY, pattern: str = PATTERN) -> Codec:
    """One codec a process and vocabulary."""
    if (path, pattern) not in _CODECS:
        _CODECS[path, pattern] = Codec(path, pattern)
    return _CODECS[path, pattern]


def encode(docs: DataFrame, path: str = VOCABULARY, pattern: str = PATTERN, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Token ids of every row: (doc_id, n_tokens, ids).

    A null text gives null ids and 0 tokens, an empty one an empty list; texts
    are read whole, whatever their length. Rows are handled one by one, so
    repeated rows and null ids come out as they went in; columns other than the
    two named are not carried. An empty table gives an empty result.
    """
    check_names(id_col, "n_tokens", "ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, pattern)
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                found = [None if t is None else c.encode_bytes(t) for t in part.column(1).to_pylist()]
                lengths = np.array([len(x or b"") // 4 for x in found], np.int64)
                flat = pa.array(np.frombuffer(b"".join(x for x in found if x), np.int32))
                ids = list_array(flat, lengths)
                if any(x is None for x in found):
                    ids = pa.ListArray.from_arrays(ids.offsets, ids.values, mask=pa.array([x is None for x in found]))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(lengths.astype(np.int32)), ids], names=[id_col, "n_tokens", "ids"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, n_tokens int, ids array<int>")


def decode(encoded: DataFrame, path: str = VOCABULARY, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """Texts of token ids: (doc_id, text); null ids give a null text.

    Ids that no text encodes to may join into bytes that are not UTF-8; those
    bytes become U+FFFD. An id outside the vocabulary raises KeyError. Rows are
    handled one by one, as in ``encode``.
    """
    check_names(id_col, "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                texts = [None if ids is None else c.decode(ids) for ids in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(texts, pa.string())], names=[id_col, "text"])

    kind = encoded.schema[id_col].dataType.simpleString()
    return encoded.select(id_col, ids_col).mapInArrow(run, f"`{id_col}` {kind}, text string")


def round_trip(docs: DataFrame, path: str = VOCABULARY, pattern: str = PATTERN, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode, decode what came out, and compare: (doc_id, n_tokens, ids, exact).

    ``exact`` is whether the decoded text is the original one, null for a null
    text. One pass: nothing is shuffled and the decoded text is not kept. Nulls,
    empty texts, repeated rows and other columns are as in ``encode``.
    """
    check_names(id_col, "n_tokens", "ids", "exact")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, pattern)
        spell = c.token.__getitem__
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                found, exact = [], []
                for t in part.column(1).to_pylist():
                    if t is None:
                        found.append(None)
                        exact.append(None)
                        continue
                    ids = c.encode_bytes(t)
                    found.append(ids)
                    exact.append(b"".join(map(spell, memoryview(ids).cast("i"))) == t.encode("utf-8"))
                lengths = np.array([len(x or b"") // 4 for x in found], np.int64)
                ids = list_array(pa.array(np.frombuffer(b"".join(x for x in found if x), np.int32)), lengths)
                if any(x is None for x in found):
                    ids = pa.ListArray.from_arrays(ids.offsets, ids.values, mask=pa.array([x is None for x in found]))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(lengths.astype(np.int32)), ids, pa.array(exact, pa.bool_())], names=[id_col, "n_tokens", "ids", "exact"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(run, f"`{id_col}` {kind}, n_tokens int, ids array<int>, exact boolean")
