"""Text functions as Catalyst expressions: segmentation, tokens, detection, edits.

Everything here stays in the JVM but for Unicode normalisation and stemming,
which Spark has no built-in for and which run as Arrow UDFs.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Iterable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import profiles
from .profiles import Profile

CJK = r"\x{3040}-\x{30FF}\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}"
_LATIN = "latin"  # stands for no script of its own
SEA = r"\x{0E00}-\x{0EFF}\x{1780}-\x{17FF}"


@F.pandas_udf(T.StringType())
def nfkc(text: pd.Series) -> pd.Series:
    """NFKC-normalised text."""
    return text.map(lambda t: t if t is None or t.isascii() else unicodedata.normalize("NFKC", t))


@F.pandas_udf(T.StringType())
def strip_diacritics(text: pd.Series) -> pd.Series:
    """Text without combining marks, by NFKD."""
    def fold(t):
        return "".join(c for c in unicodedata.normalize("NFKD", t) if unicodedata.category(c)[0] != "M")

    return text.map(lambda t: t if t is None else fold(t))


def latin_words(text: Column) -> Column:
    """Runs of letters and digits."""
    return F.regexp_extract_all(text, F.lit(r"([\p{L}\p{N}]+)"), 1)


def ngram_words(text: Column, script: str, n: int) -> Column:
    """Runs of the script as overlapping n-grams (short runs whole), other words as they are."""
    runs = F.regexp_extract_all(text, F.lit(rf"([{script}]+|[\p{{L}}\p{{N}}&&[^{script}]]+)"), 1)

    def pieces(run: Column) -> Column:
        size = F.length(run)
        grams = F.transform(F.sequence(F.lit(1), F.greatest(size - (n - 1), F.lit(1))), lambda i: F.substring(run, i, F.lit(n)))
        return F.when(run.rlike(f"^[{script}]"), grams).otherwise(F.array(run))

    return F.flatten(F.transform(runs, pieces))


def words(text: Column, profile: Profile) -> Column:
    if profile.segment == "cjk":
        return ngram_words(text, CJK, 2)
    if profile.segment == "sea":
        return ngram_words(text, SEA, 3)
    return latin_words(text)


def literals(text: Column, profile: Profile, normalise: bool = True) -> Column:
    """Lower-cased words of a text without the profile's stopwords, in order."""
    if normalise:
        text = nfkc(text)
    lowered = F.transform(words(text, profile), F.lower)
    stop = sorted(profile.stopwords)
    return F.filter(lowered, lambda w: ~w.isin(*stop)) if stop else lowered


def stems(words_: Column, profile: Profile) -> Column:
    """Stems of an array of literals: each worker keeps those it has met."""
    if profile.stem is None:
        return words_
    stem = profile.stem
    known: dict[str, str] = {}

    def one(w: str) -> str:
        s = known.get(w)
        if s is None:
            if len(known) > 500_000:
                known.clear()
            s = known[w] = stem(w)
        return s

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def run(lists: pd.Series) -> pd.Series:
        return lists.map(lambda ws: None if ws is None else [one(w) for w in ws])

    return run(words_)


def tokens(text: Column, profile: Profile, normalise: bool = True) -> Column:
    """array<struct<term, position, literal>>: removed stopwords take no position."""
    lit_ = literals(text, profile, normalise)
    return F.transform(F.arrays_zip(stems(lit_, profile).alias("term"), lit_.alias("literal")), lambda t, i: F.struct(t["term"].alias("term"), i.cast("int").alias("position"), t["literal"].alias("literal")))


def terms(text: Column, profile: Profile, normalise: bool = True) -> Column:
    return stems(literals(text, profile, normalise), profile)


def normalize_phrase(text: Column, profile: Profile, normalise: bool = True) -> Column:
    """The text's terms joined by one blank."""
    return F.array_join(terms(text, profile, normalise), " ")


def script_counts(text: Column) -> Column:
    """struct<letters, han, kana, thai, lao, khmer>: letters by script."""
    def count(cls: str) -> Column:
        return F.length(text) - F.length(F.regexp_replace(text, cls, ""))

    return F.struct(
        count(r"\p{L}").alias("letters"),
        count(r"[\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}]").alias("han"),
        count(r"[\x{3040}-\x{30FF}&&\p{L}]").alias("kana"),
        count(r"[\x{0E00}-\x{0E7F}&&\p{L}]").alias("thai"),
        count(r"[\x{0E80}-\x{0EFF}&&\p{L}]").alias("lao"),
        count(r"[\x{1780}-\x{17FF}&&\p{L}]").alias("khmer"),
    )


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, however often it occurs there."""
    return F.transform(F.array(value), use)[0]


def detect_language(text: Column, codes: Iterable[str]) -> Column:
    """Language by script share, else by the unique greatest count of marker words, else null."""
    codes = sorted(set(codes))

    def if_candidate(code: str) -> Column:
        return F.lit(code if code in codes else None).cast("string")

    def by_script(s: Column) -> Column:
        share = lambda x: (s["letters"] > 0) & (x / s["letters"] >= 0.3)
        return (
            F.when(share(s["han"] + s["kana"]), F.when(s["kana"] > 0, if_candidate("ja")).otherwise(if_candidate("zh")))
            .when(share(s["thai"]), if_candidate("th"))
            .when(share(s["lao"]), if_candidate("lo"))
            .when(share(s["khmer"]), if_candidate("km"))
            .otherwise(F.lit(_LATIN))
        )

    markers = {c: sorted(profiles.MARKERS[c]) for c in codes if c in profiles.MARKERS}

    def number(found: Column, of: list[str]) -> Column:
        return F.size(F.filter(found, lambda w: w.isin(*of)))

    def by_markers(found: Column) -> Column:
        """The language with most of the marker words found; a count is its place in an array."""
        counts = F.array(*[number(found, m) for m in markers.values()])

        def named(n: Column) -> Column:
            best = F.array_max(n)
            alone = F.size(F.filter(n, lambda x: x == best)) == 1
            return F.when((best > 0) & alone, F.array(*[F.lit(c) for c in markers])[F.array_position(n, best).cast("int") - 1])

        return once(counts, named)

    latin = F.lit(None).cast("string")
    if markers:
        every = sorted({w for m in markers.values() for w in m})
        words_ = F.regexp_extract_all(F.lower(text), F.lit(r"(\p{L}+)"), 1)
        latin = once(F.filter(words_, lambda w: w.isin(*every)), by_markers)
    # letters are counted where the text has some of another script only
    other = text.rlike(r"[\x{0E00}-\x{0EFF}\x{1780}-\x{17FF}\x{3040}-\x{30FF}\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}]")
    script = F.when(other, once(script_counts(text), by_script)).otherwise(F.lit(_LATIN))
    return once(script, lambda k: F.when(k == _LATIN, latin).otherwise(k))


def is_rtl(code: Column) -> Column:
    """Whether a language tag's primary subtag is written from right to left."""
    return F.lower(F.split(code, "-")[0]).isin(*profiles.RTL)


def deletes(term: Column, max_edits: int = 1) -> Column:
    """The term and all it becomes by deleting up to ``max_edits`` characters, distinct."""
    def shorter(t: Column) -> Column:
        every = F.transform(F.sequence(F.lit(1), F.length(t)), lambda i: F.concat(F.substring(t, F.lit(1), i - 1), F.substring(t, i + 1, F.length(t))))
        return F.when(F.length(t) > 0, every).otherwise(F.array(t))

    out = level = F.array(term)
    for _ in range(max_edits):
        level = F.array_distinct(F.flatten(F.transform(level, shorter)))
        out = F.array_distinct(F.concat(out, level))
    return out


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance on a sphere of 6371 km."""
    p1, p2 = F.radians(lat1), F.radians(lat2)
    a = F.pow(F.sin((p2 - p1) / 2), 2) + F.cos(p1) * F.cos(p2) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return F.lit(2 * 6371.0) * F.atan2(F.sqrt(a), F.sqrt(F.lit(1.0) - a))


def collapse(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def excerpt(body: Column, size: int = 200) -> Column:
    cut = F.regexp_replace(F.substring(body, 1, size), r"\s+$", "")
    return F.when(F.length(body) <= size, body).otherwise(F.concat(cut, F.lit("…")))


def excerpt_of(raw: Column, size: int = 200) -> Column:
    """The excerpt of a collapsed text; of a long one only the beginning is collapsed, where that is enough."""
    head = collapse(F.substring(raw, 1, 5 * size))
    enough = (F.length(raw) > 5 * size) & (F.length(head) > size + 1)
    return F.when(enough, excerpt(head, size)).otherwise(excerpt(collapse(raw), size))


def hierarchy_paths(path: Column, separator: str = ">") -> Column:
    """All ancestors of a path, itself last; segments trimmed, empty ones dropped."""
    import re

    seg = F.filter(F.transform(F.split(path, re.escape(separator)), lambda s: F.trim(s)), lambda s: s != "")
    return F.when(F.size(seg) == 0, F.array().cast("array<string>")).otherwise(F.transform(F.sequence(F.lit(1), F.size(seg)), lambda n: F.array_join(F.slice(seg, F.lit(1), n), separator)))


def short_hash(content: Column) -> Column:
    """The first eight hex digits of the SHA-256."""
    return F.substring(F.sha2(content, 256), 1, 8)


def contains_phrase(query: Column, phrase: Column) -> Column:
    """Whether the phrase's words are consecutive words of the query; both are
    blank-joined terms, so padded text search is exact."""
    return F.instr(F.concat(F.lit(" "), query, F.lit(" ")), F.concat(F.lit(" "), phrase, F.lit(" "))) > 0


def geo_point(raw: Column) -> Column:
    """struct<lat, lon> of "lat,lon", null where it is no such pair or out of range."""
    parts = F.split(raw, ",")
    lat, lon = (parts[i].try_cast("double") for i in (0, 1))
    ok = (F.size(parts) == 2) & lat.between(-90, 90) & lon.between(-180, 180) & ~F.isnan(lat) & ~F.isnan(lon)
    return F.when(ok, F.struct(lat.alias("lat"), lon.alias("lon")))


def register(spark) -> None:
    """SQL names of the functions that take plain columns."""
    spark.udf.register("lexi_nfkc", nfkc)
    spark.udf.register("lexi_strip_diacritics", strip_diacritics)
    for code, p in profiles.PROFILES.items():
        if p.stem is not None:
            spark.udf.register(f"lexi_stem_{code}", lambda w, s=p.stem: None if w is None else s(w), "string")
