"""Postings of documents, made where the documents lie: a batch's words are coded,
stemmed once a distinct word and grouped by sorting their codes, so no row is moved.
The same words give the terms of documents counted, and the postings of a few terms."""

from __future__ import annotations

import ctypes
import re
import sys
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Callable, Iterable, Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import profiles
from ..functions.analysis import cut

POSTING = "lang string, term string, doc_id long, boost double, fields array<struct<field:string,tf:int,pos:array<int>,len:int>>"
_FIELD = pa.struct([("field", pa.string()), ("tf", pa.int32()), ("pos", pa.list_(pa.int32())), ("len", pa.int32())])
_OUT = pa.schema([("lang", pa.string()), ("term", pa.string()), ("doc_id", pa.int64()), ("boost", pa.float64()), ("fields", pa.list_(_FIELD))])
OCCURRENCE = "lang string, term string, doc_id long, field string, tf int, len int"
_FLAT = pa.schema([("lang", pa.string()), ("term", pa.string()), ("doc_id", pa.int64()), ("field", pa.string()), ("tf", pa.int32()), ("len", pa.int32())])
COUNT = "lang string, term string, field string, n long"
_COUNT = pa.schema([("lang", pa.string()), ("term", pa.string()), ("field", pa.string()), ("n", pa.int64())])

#: Batches are cut to about so many bytes of text, but for a longer single document.
BATCH_BYTES = 1 << 20
#: A worker forgets the stems it has met, of all languages, beyond so many.
KEPT_STEMS = 100_000
#: A worker hands on the counts of terms that it holds beyond so many.
KEPT_COUNTS = 200_000
#: Characters of a text whose words are listed at once.
PIECE = 1 << 20
_BLANK = re.compile(r"\s")
#: The letters that don't become one other letter whatever their neighbours.
_ODD = re.compile("[İΣ]")


def cut_batches(batches: Iterable[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """Batches of up to about ``size`` bytes, but for a longer single row."""
    for batch in batches:
        start = 0
        while start < batch.num_rows:
            n = batch.num_rows - start
            while n > 1 and batch.slice(start, n).nbytes > size:
                n = (n + 1) // 2
            yield batch.slice(start, n)
            start += n


def _pieces(t: str) -> Iterator[str]:
    """A text cut at blanks into pieces whose words fit in memory."""
    start = 0
    while len(t) - start > PIECE:
        blank = _BLANK.search(t, start + PIECE)
        if blank is None:
            break
        yield t[start : blank.start()]
        start = blank.start()
    yield t[start:]


def lowered(t: str | None, segment: str, normalise: bool = True) -> Iterator[list[str]]:
    """A text's words in lower case, piece by piece."""
    if not t:
        return
    if normalise and not t.isascii():
        t = unicodedata.normalize("NFKC", t)
    whole = t.isascii() or not _ODD.search(t)
    for piece in _pieces(t.lower() if whole else t):
        yield cut(piece, segment) if whole else [w.lower() for w in cut(piece, segment)]


def lean(run: Callable) -> Callable:
    """``run``, a function for mapInArrow, whose task gives the memory it has freed back to the
    system: workers are used again, and what their allocators keep would add up."""

    def task(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            if sys.platform == "linux":
                ctypes.CDLL(None).malloc_trim(0)

    return task


class Inverter:
    """Of batches (lang, doc_id, boost, then the text of each field in ``fields``)
    the postings, one row a document and term, fields by name."""

    def __init__(self, fields: list[str], rules: dict[str, profiles.Profile], normalise: bool = True):
        self.fields, self.rules, self.normalise = fields, rules, normalise
        self.known: dict[tuple[str, str], str] = {}

    def term(self, lang: str, word: str) -> str | None:
        """Stem of a word in lower case, None for a stopword."""
        p = self.rules[lang]
        if word in p.stopwords:
            return None
        if p.stem is None:
            return word
        found = self.known.get((lang, word))
        if found is None:
            if len(self.known) >= KEPT_STEMS:
                self.known.clear()
            found = self.known[lang, word] = p.stem(word)
        return found

    def coded(self, t: str | None, segment: str, ids: defaultdict[str, int]) -> Iterator[np.ndarray]:
        """Numbers of a text's words; ``ids`` numbers the new ones."""
        for words in lowered(t, segment, self.normalise):
            yield np.fromiter(map(ids.__getitem__, words), np.int64, len(words))

    def grouped(self, batch: pa.RecordBatch):
        """A batch's words in the order of document, term, field and place: terms by number, then for each
        word its term, document, field and position, the length of each field of each document, and where
        postings and their fields begin. None where no word is left."""
        n, most = batch.num_rows, len(self.fields)
        langs = batch.column(0).dictionary_encode()
        lang_of = langs.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        names = langs.dictionary.to_pylist()
        segments = [self.rules[names[c]].segment for c in lang_of.tolist()]
        words: defaultdict[str, int] = defaultdict(count().__next__)
        codes, sizes = [], np.zeros((most, n), np.int64)
        for k in range(most):
            for i, t in enumerate(batch.column(3 + k).to_pylist()):
                for found in self.coded(t, segments[i], words):
                    codes.append(found)
                    sizes[k, i] += len(found)
        if not words:
            return None
        code = np.concatenate(codes)
        vocabulary = list(words)
        row = np.concatenate([np.repeat(np.arange(n), s) for s in sizes])
        part = np.repeat(np.arange(most), sizes.sum(axis=1))
        # one look at each distinct word of each language
        pair = lang_of[row] * len(vocabulary) + code
        of_pair = np.full(len(names) * len(vocabulary), -2, np.int64)
        of_pair[pair] = -1
        ids: dict[str, int] = {}
        for p in np.flatnonzero(of_pair == -1).tolist():
            t = self.term(names[p // len(vocabulary)], vocabulary[p % len(vocabulary)])
            if t is not None:
                of_pair[p] = ids.setdefault(t, len(ids))
        term = of_pair[pair]
        kept = term >= 0
        term, row, part = term[kept], row[kept], part[kept]
        if not len(term):
            return None
        # words lie by field and document: a word's position is its distance from the first one kept
        group = part * n + row
        first = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
        size = np.diff(np.r_[first, len(group)])
        pos = np.arange(len(group)) - np.repeat(first, size)
        length = np.zeros(n * most, np.int32)
        length[group[first]] = size
        key = (row * len(ids) + term) * most + part
        if n * len(ids) * most * len(key) < 1 << 62:  # a key that holds the place as well needs no stable sort
            order = np.sort(key * len(key) + np.arange(len(key))) % len(key)
        else:
            order = np.argsort(key, kind="stable")
        term, row, part, pos = term[order], row[order], part[order], pos[order]
        new_row = np.r_[True, (row[1:] != row[:-1]) | (term[1:] != term[:-1])]
        entry = np.flatnonzero(new_row | np.r_[True, part[1:] != part[:-1]])
        return list(ids), term, row, part, pos, length, np.flatnonzero(new_row), entry

    def postings(self, batch: pa.RecordBatch) -> pa.RecordBatch | None:
        made = self.grouped(batch)
        if made is None:
            return None
        ids, term, row, part, pos, length, posting, entry = made
        ends = np.r_[entry, len(pos)].astype(np.int32)
        fields = pa.StructArray.from_arrays(
            [
                pa.array(self.fields, pa.string()).take(pa.array(part[entry])),
                pa.array(np.diff(ends), pa.int32()),
                pa.ListArray.from_arrays(pa.array(ends), pa.array(pos, pa.int32())),
                pa.array(length[part[entry] * batch.num_rows + row[entry]], pa.int32()),
            ],
            fields=list(_FIELD),
        )
        docs = pa.array(row[posting])
        return pa.RecordBatch.from_arrays(
            [
                batch.column(0).take(docs),
                pa.array(ids, pa.string()).take(pa.array(term[posting])),
                batch.column(1).take(docs),
                batch.column(2).take(docs),
                pa.ListArray.from_arrays(pa.array(np.searchsorted(entry, np.r_[posting, len(pos)]).astype(np.int32)), fields),
            ],
            schema=_OUT,
        )

    def run(self, batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in cut_batches(batches, BATCH_BYTES):
            out = self.postings(batch)
            if out is not None:
                yield out

    def occurrences(self, batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """OCCURRENCE rows: a row a document, term and field, without positions."""
        for batch in cut_batches(batches, BATCH_BYTES):
            made = self.grouped(batch)
            if made is None:
                continue
            ids, term, row, part, pos, length, _, entry = made
            docs = pa.array(row[entry])
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(docs),
                    pa.array(ids, pa.string()).take(pa.array(term[entry])),
                    batch.column(1).take(docs),
                    pa.array(self.fields, pa.string()).take(pa.array(part[entry])),
                    pa.array(np.diff(np.r_[entry, len(pos)]), pa.int32()),
                    pa.array(length[part[entry] * batch.num_rows + row[entry]], pa.int32()),
                ],
                schema=_FLAT,
            )

    def _rows(self, batch: pa.RecordBatch) -> Iterator[tuple]:
        """(language, its stopwords, the word lists of each field) of each document."""
        texts = [batch.column(3 + k).to_pylist() for k in range(len(self.fields))]
        for i, lang in enumerate(batch.column(0).to_pylist()):
            p = self.rules[lang]
            yield lang, p.stopwords, [[w for ws in lowered(t[i], p.segment, self.normalise) for w in ws] for t in texts]

    def counts(self, batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """COUNT rows: in how many documents a term is, in parts to be added up, and with a null
        term how many words a field has."""
        held: dict[str, Counter] = {}
        words_in: Counter = Counter()

        def given() -> pa.RecordBatch:
            rows = [(lang, t, None, n) for lang, c in held.items() for t, n in c.items()] + [(lang, None, f, n) for (lang, f), n in words_in.items()]
            held.clear()
            words_in.clear()
            return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*rows), _COUNT)], schema=_COUNT)

        for batch in cut_batches(batches, BATCH_BYTES):
            for lang, stop, lists in self._rows(batch):
                seen: set[str] = set()
                for f, words in zip(self.fields, lists):
                    seen.update(words)
                    n = len(words) - sum(map(stop.__contains__, words))
                    if n:
                        words_in[lang, f] += n
                seen -= stop
                if self.rules[lang].stem is not None:
                    seen = {self.term(lang, w) for w in seen}
                held.setdefault(lang, Counter()).update(seen)
            if sum(map(len, held.values())) > KEPT_COUNTS:
                yield given()
        if words_in or any(held.values()):
            yield given()

    def found(self, lang: str, exact: frozenset[str], starts: tuple[str, ...]) -> Callable:
        """A function from batches to POSTING rows of some terms of one language: those named and those that
        begin in one of some ways. Rows with a null term have the number of words of each field as ``tf``."""

        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in cut_batches(batches, BATCH_BYTES):
                rows: list[tuple[str, str | None, int | None]] = []  # language, term, row
                begin, entries, places, ends = [0], [], [], [0]
                words_in: Counter = Counter()
                for i, (code, stop, lists) in enumerate(self._rows(batch)):
                    at: dict[str, list] = {}
                    for f, words in zip(self.fields, lists):
                        met: dict[str, str] = {}
                        if code == lang:
                            distinct = set(words)
                            if self.rules[lang].stem is None:
                                met = {w: w for w in exact & distinct}
                                if starts:
                                    met |= {w: w for w in distinct if w.startswith(starts)}
                            else:
                                for w in distinct - stop:
                                    t = self.term(lang, w)
                                    if t in exact or t.startswith(starts):
                                        met[w] = t
                        n = len(words) - sum(map(stop.__contains__, words))
                        if n:
                            words_in[code, f] += n
                        if met:
                            kept = (w for w in words if w not in stop)
                            mine: dict[str, list[int]] = {}
                            for p, w in enumerate(kept):
                                if w in met:
                                    mine.setdefault(met[w], []).append(p)
                            for t, ps in mine.items():
                                at.setdefault(t, []).append((f, ps, n))
                    for t, fields in at.items():
                        rows.append((code, t, i))
                        for f, ps, n in fields:
                            entries.append((f, len(ps), n))
                            places += ps
                            ends.append(len(places))
                        begin.append(len(entries))
                for (code, f), n in words_in.items():
                    rows.append((code, None, None))
                    entries.append((f, n, None))
                    ends.append(len(places))
                    begin.append(len(entries))
                if not rows:
                    continue
                names, tf, size = zip(*entries)
                fields = pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(tf, pa.int32()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(places, pa.int32())), pa.array(size, pa.int32())], fields=list(_FIELD))
                codes, terms, at_row = zip(*rows)
                docs = pa.array(at_row, pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(codes, pa.string()), pa.array(terms, pa.string()), batch.column(1).take(docs), batch.column(2).take(docs), pa.ListArray.from_arrays(pa.array(begin, pa.int32()), fields)], schema=_OUT)

        return run


def flat_texts(docs: DataFrame, fields: list[str]) -> DataFrame:
    """(lang, doc_id, boost, and the text of each field) of documents (lang, doc_id, boost, indexed)."""
    return docs.select("lang", "doc_id", F.coalesce("boost", F.lit(1.0)).alias("boost"), *[F.col("indexed")[n].alias(f"t{i}") for i, n in enumerate(fields)])


def inverter(fields: Iterable[str], langs: Iterable[str], normalise: bool = True, fallback: bool = False) -> Inverter:
    return Inverter(sorted(fields), {code: profiles.profile(code, fallback) for code in langs}, normalise)


def invert(docs: DataFrame, fields: Iterable[str], langs: Iterable[str], normalise: bool = True, fallback: bool = False) -> DataFrame:
    """POSTING rows of documents (lang, doc_id, boost, indexed): one scan for all
    languages and one Arrow pass, which normalisation and stems need in any case; no exchange."""
    by = inverter(fields, langs, normalise, fallback)
    return flat_texts(docs, by.fields).mapInArrow(lean(by.run), POSTING)


def token_rows(docs: DataFrame, profile: profiles.Profile, normalise: bool = True) -> DataFrame:
    """(doc_id, position, term) of every word of documents (doc_id, text) that is no stopword."""
    out = pa.schema([("doc_id", pa.int64()), ("position", pa.int32()), ("term", pa.string())])
    by = Inverter(["text"], {profile.code: profile}, normalise)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in cut_batches(batches, BATCH_BYTES):
            terms: list[str] = []
            sizes = []
            for t in batch.column(1).to_pylist():
                before = len(terms)
                for words in lowered(t, profile.segment, normalise):
                    kept = [w for w in words if w not in profile.stopwords]
                    terms += kept if profile.stem is None else [by.term(profile.code, w) for w in kept]
                sizes.append(len(terms) - before)
            size = np.array(sizes, np.int64)
            first = np.cumsum(size) - size
            docs_ = batch.column(0).take(pa.array(np.repeat(np.arange(len(size)), size)))
            yield pa.RecordBatch.from_arrays([docs_, pa.array(np.arange(len(terms)) - np.repeat(first, size), pa.int32()), pa.array(terms, pa.string())], schema=out)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(lean(run), "doc_id long, position int, term string")
