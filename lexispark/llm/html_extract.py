"""Main text of web pages, by differencing each page with its nearest URL.

Within a host, pages are put in the order of their URL paths, and each is
paired with the neighbour whose path shares most with its own. Pages of one
site share their navigation, notices and footers, so the lines of the longest
common subsequence of a pair's text lines are deleted and the rest is kept.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator
from urllib.parse import urlsplit

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded, check_names, sendable, stored

#: The alignment of so many cells (bits) is held whole; a longer one is halved first.
_CELLS = 1 << 28

_HIDDEN = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style|head|template|noscript)\b[^>]*>.*?(?:</\1\s*>|\Z)", re.S | re.I)
_BLOCK = re.compile(
    r"</?(?:address|article|aside|blockquote|body|br|caption|dd|details|div|dl|dt|fieldset|figcaption|figure|footer|form|h[1-6]|header|hr|html|legend|li|main|nav|ol|option|p|pre|section|summary|table|tbody|td|tfoot|th|thead|title|tr|ul)\b(?:[^<>\"']|\"[^\"]*\"|'[^']*')*>",
    re.I,
)
_TAG = re.compile(r"<[a-zA-Z/!?](?:[^<>\"']|\"[^\"]*\"|'[^']*')*>")


def text_lines(html: str | None) -> list[str]:
    """Text of a page, a line for each block; inline tags end no line, white space
    is collapsed, entities are decoded, what is never shown is left out."""
    if not html:
        return []
    # a line break in the source is white space; only blocks end a line
    shown = _HIDDEN.sub(" ", html)
    parts = _BLOCK.split(shown)
    out = []
    for part in parts:
        if "<" in part:
            part = _TAG.sub("", part)
        if "&" in part:
            part = entities.unescape(part)
        line = " ".join(part.split())
        if line:
            out.append(line)
    return out


def url_place(url: str | None) -> tuple[str | None, str | None]:
    """(host, path) that a URL stands for: query, fragment, a last slash and the
    suffixes .html and .htm don't matter. (None, None) where there is no host."""
    if not url:
        return None, None
    try:
        parts = urlsplit(url.strip())
        host = parts.hostname
    except ValueError:
        return None, None
    if not host:
        return None, None
    path = re.sub(r"\.html?$", "", parts.path.rstrip("/"), flags=re.I)
    return host, path or "/"


def likeness(a: str, b: str) -> tuple[int, int]:
    """How much two paths share: leading segments, then leading characters."""
    s = 0
    for x, y in zip(a.split("/"), b.split("/")):
        if x != y:
            break
        s += 1
    c = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    return s, c


def nearest(path: str, before, after):
    """Of the neighbours (path, key) in the order of paths the one more alike; the earlier one of equals."""
    if before is None or after is None:
        return before or after
    return after if likeness(path, after[0]) > likeness(path, before[0]) else before


def _row(v: int, mask: int) -> int:
    """The next row of the alignment, a bit a line of ``b``: 0 where the common run grows."""
    u = v & mask
    return (v + u) | (v - u)


def _lengths(a: list, b: list) -> np.ndarray:
    """Lengths of the longest common subsequence of ``a`` with each prefix of ``b``."""
    masks: dict = {}
    for j, x in enumerate(b):
        masks[x] = masks.get(x, 0) | 1 << j
    all_ = (1 << len(b)) - 1
    v = all_
    for x in a:
        if x in masks:
            v = _row(v, masks[x]) & all_
    bits = np.unpackbits(np.frombuffer(v.to_bytes(len(b) // 8 + 1, "little"), np.uint8), bitorder="little")[: len(b)]
    return np.concatenate([[0], np.cumsum(bits == 0)])


def _common(a: list, b: list) -> list[int]:
    """Places in ``a`` of a longest common subsequence with ``b``, by rows of bits: a row
    costs the length of ``b`` over 64, however often lines repeat."""
    if not a or not b:
        return []
    if len(a) * len(b) > _CELLS and len(a) > 1:
        half = len(a) // 2
        cut = int(np.argmax(_lengths(a[:half], b) + _lengths(a[half:][::-1], b[::-1])[::-1]))
        return _common(a[:half], b[:cut]) + [half + i for i in _common(a[half:], b[cut:])]
    masks: dict = {}
    for j, x in enumerate(b):
        masks[x] = masks.get(x, 0) | 1 << j
    all_ = (1 << len(b)) - 1
    rows, v = [], all_
    for x in a:
        v = _row(v, masks.get(x, 0)) & all_
        rows.append(v)
    out, i, j = [], len(a), len(b)
    while i and j:
        if rows[i - 1] >> (j - 1) & 1:
            j -= 1
        else:
            i -= 1
            if not i or rows[i - 1] >> (j - 1) & 1:
                j -= 1
                out.append(i)
    return out[::-1]


def shared(a: list, b: list) -> list[int]:
    """Places in ``a`` of a longest common subsequence with ``b``."""
    lo = 0
    while lo < len(a) and lo < len(b) and a[lo] == b[lo]:
        lo += 1
    hi = 0
    while hi < len(a) - lo and hi < len(b) - lo and a[-1 - hi] == b[-1 - hi]:
        hi += 1
    # lines that only one page has take no part
    mine, theirs = a[lo : len(a) - hi], b[lo : len(b) - hi]
    known, asked = set(theirs), set(mine)
    at = [lo + i for i, x in enumerate(mine) if x in known]
    middle = [at[i] for i in _common([a[i] for i in at], [x for x in theirs if x in asked])]
    return [*range(lo), *middle, *range(len(a) - hi, len(a))]


def _hash_lines(lines: list[str]) -> bytes:
    return np.array([xxhash.xxh3_64_intdigest(x) for x in lines], np.uint64).tobytes()


def _keyed(pages: DataFrame, id_col: str, url_col: str, html_col: str) -> DataFrame:
    return pages.select(F.xxhash64(id_col, url_col, html_col).alias("k"), F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))


def neighbours(places: DataFrame) -> DataFrame:
    """(host, path, partner): for each distinct (host, path, rep) the ``rep`` of the
    nearest other path of the host, null where there is none.

    Rows are range-partitioned in order, so that a host may span tasks; only the
    two rows at a partition's edges meet on the driver.
    """
    ordered = places.repartitionByRange("host", "path").sortWithinPartitions("host", "path")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        names = ["host", "path", "rep", "partner", "partner_path", "part", "edge"]
        kinds = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.int32()]
        done: list[tuple] = []

        def flush():
            rows = list(zip(*done)) or [()] * len(names)
            done.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(rows, kinds)], names=names)

        def settle(before, own, after):
            """A row is settled once the next one is known; only three are held."""
            near = nearest(own[1], *((x[1], x[2]) if x is not None and x[0] == own[0] else None for x in (before, after)))
            done.append((*own, near and near[1], near and near[0], part, (before is None) + 2 * (after is None)))

        before = own = None
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if own is not None:
                    settle(before, own, row)
                before, own = own, row
                if len(done) >= 20_000:
                    yield flush()
        if own is not None:
            settle(before, own, None)
        yield flush()

    form = "host string, path string, rep long, partner long, partner_path string, part int, edge int"
    found = stored(ordered.mapInArrow(run, form), "neighbours")
    edges = sorted(found.where("edge > 0").collect(), key=lambda r: (r["part"], r["edge"] & 2))
    fixes = []
    for x, y in zip(edges, edges[1:]):
        # x ends a partition, y begins a later one, with nothing between them
        if x["part"] != y["part"] and x["host"] == y["host"]:
            fixes += [(x, y, 1), (y, x, 0)]
    changed: dict = {}
    for own, other, later in fixes:
        key = (own["host"], own["path"])
        have = changed.get(key) or ((own["partner_path"], own["partner"]) if own["partner"] is not None else None)
        extra = (other["path"], other["rep"])
        changed[key] = nearest(own["path"], have, extra) if later else nearest(own["path"], extra, have)
    if not changed:
        return found.select("host", "path", "partner")
    fixed = found.sparkSession.createDataFrame([(h, p, x[1]) for (h, p), x in changed.items()], "host string, path string, fixed long")
    joined = found.join(F.broadcast(fixed), ["host", "path"], "left")  # at most two rows a partition
    return joined.select("host", "path", F.coalesce("fixed", "partner").alias("partner"))


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_lines, n_shared), a row for a row.

    ``text`` is the page's lines, joined by line breaks, without those shared
    with the nearest other path of its host; URLs that differ only in query,
    fragment, last slash or suffix stand for one place and aren't paired with
    each other, and of one place's pages the least id speaks for it. A page
    without a URL or host, or alone at its host, keeps all its lines. A null or
    empty page has an empty text and 0 lines. Repeated rows and null ids give a
    row each. Other columns are not carried; an empty table gives no rows. Lines
    may repeat, and a page be long, without more than the product of both pages'
    lines over 64 steps.
    """
    check_names(id_col, "text", "n_lines", "n_shared", url_col.lower())
    keyed = _keyed(pages, id_col, url_col, html_col)
    kind = pages.schema[id_col].dataType.simpleString()

    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches, 2000):
            k, id_, url, html = batch.columns
            where = [url_place(u) for u in url.to_pylist()]
            raw = [_hash_lines(text_lines(x)) for x in html.to_pylist()]
            yield pa.RecordBatch.from_arrays([k, id_, pa.array([w[0] for w in where], pa.string()), pa.array([w[1] for w in where], pa.string()), pa.array(raw, pa.binary())], names=["k", "id", "host", "path", "hashes"])

    hashed = stored(keyed.mapInArrow(lines, f"k long, id {kind}, host string, path string, hashes binary"), "lines").where("host is not null").dropDuplicates(["k"])
    places = hashed.groupBy("host", "path").agg(F.min(F.struct(F.col("id").isNull(), "id", "k"))["k"].alias("rep"))
    pairs = neighbours(places).where("partner is not null")
    own = hashed.join(pairs, ["host", "path"]).select("k", "partner", "hashes")
    other = hashed.select(F.col("k").alias("partner"), F.col("hashes").alias("theirs"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            gone = []
            for a, b in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                gone.append(shared(np.frombuffer(a, np.uint64).tolist(), np.frombuffer(b, np.uint64).tolist()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(gone, pa.list_(pa.int32()))], names=["k", "gone"])

    both = own.join(other, "partner").select("k", "hashes", "theirs")
    gone = stored(both.mapInArrow(compare, "k long, gone array<int>").where(F.size("gone") > 0), "shared")
    gone = sendable(gone, F.size("gone").cast("long") * 4)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches, 2000):
            text, total, away = [], [], []
            for page, drop in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                own_lines = text_lines(page)
                out = set(drop or ())
                text.append("\n".join(x for i, x in enumerate(own_lines) if i not in out))
                total.append(len(own_lines))
                away.append(len(out))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(text, pa.string()), pa.array(total, pa.int32()), pa.array(away, pa.int32())], names=["id", "u", "text", "n_lines", "n_shared"])

    joined = keyed.join(gone, "k", "left").select("id", "url", "html", "gone")
    done = joined.mapInArrow(keep, f"id {kind}, u string, text string, n_lines int, n_shared int")
    return done.withColumnsRenamed({"id": id_col, "u": url_col})
