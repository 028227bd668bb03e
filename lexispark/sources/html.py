"""HTML pages as a source: extraction of pages and of heading-bounded sections.

Controls in a page's meta tags and attributes carry a prefix (``CONTROLS``, a
parameter of every function here): noindex, boost, facet-<f>, facet-range-<f>,
facet-geo-<f>, stored-<f>, pin, pin-mode, pin-priority, pin-exclusive and
meta-<f>; and the attributes data-<prefix>-body and data-<prefix>-ignore.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from html.parser import HTMLParser
from urllib.parse import urljoin, urlsplit

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions import profiles, text
from ..plans.index import FieldDef, LexicalIndex, build_documents
from ..plans.invert import cut_batches, lean
from ..plans.scratch import running, stored

CONTROLS = "lexi"
HEADINGS = {f"h{i}": i for i in range(1, 7)}
_VOID = set("area base br col embed hr img input link meta source track wbr".split())
_BOILERPLATE = {"nav", "header", "footer", "aside", "script", "style"}
_CLOSES_P = set("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
_IN_HEAD = set("title meta link base style script noscript template".split())
_SAME = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
_STOPS = {"ul", "ol", "table", "dl", "select", "body", "html"}
RESERVED = {"title", "excerpt", "pageTitle"}
_OPEN_REFERENCE = re.compile(r"&(?!(?:[a-zA-Z][a-zA-Z0-9]*|#[0-9]+|#[xX][0-9a-fA-F]+);)")
#: HTML is handed on in parts of about so many bytes, but for a longer single page.
BATCH_BYTES = 1 << 20


@dataclass
class Node:
    tag: str
    attrs: dict[str, str] = field(default_factory=dict)
    children: list = field(default_factory=list)  # Node or str

    def inside(self) -> Iterator:
        """All that is below, in order, nodes before what they hold; depth is no limit."""
        rest = self.children[::-1]
        while rest:
            c = rest.pop()
            yield c
            if isinstance(c, Node):
                rest.extend(reversed(c.children))

    def walk(self) -> Iterator[Node]:
        return (c for c in self.inside() if isinstance(c, Node))

    def texts(self) -> Iterator[str]:
        return (c for c in self.inside() if not isinstance(c, Node))

    def text(self) -> str:
        return squash(" ".join(self.texts()))


class _Tree(HTMLParser):
    """A tolerant tree: html, head and body are implied, p and list items close themselves."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.html, self.head, self.body = Node("html"), Node("head"), Node("body")
        self.html.children = [self.head, self.body]
        self.open: list[Node] = [self.html, self.body]
        self.begun = False

    def _place(self, tag: str) -> Node:
        if not self.begun and tag in _IN_HEAD:
            return self.head
        self.begun = True
        return self.open[-1]

    def _close(self, tags: set[str], stops: set[str]) -> None:
        for i in range(len(self.open) - 1, 1, -1):
            if self.open[i].tag in tags:
                del self.open[i:]
                return
            if self.open[i].tag in stops:
                return

    def handle_starttag(self, tag, attrs):
        known = {}
        for k, v in attrs:
            known.setdefault(k, v or "")
        if tag in ("html", "body", "head"):
            node = {"html": self.html, "body": self.body, "head": self.head}[tag]
            for k, v in known.items():
                node.attrs.setdefault(k, v)
            self.begun |= tag == "body"
            return
        if tag in _CLOSES_P:
            self._close({"p"}, _STOPS | {"button"})
        if tag in _SAME:
            self._close(_SAME[tag], _STOPS)
        node = Node(tag, known)
        parent = self.open[-1] if self.open[-1] is not self.body else self._place(tag)
        parent.children.append(node)
        if tag not in _VOID:
            self.open.append(node)

    def handle_startendtag(self, tag, attrs):
        # a slash closes nothing but void elements in HTML
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag):
        for i in range(len(self.open) - 1, 1, -1):
            if self.open[i].tag == tag:
                del self.open[i:]
                return

    def handle_data(self, data):
        if self.open[-1] is self.body:
            if not self.begun and not data.strip():
                return
            self.begun = True
        self.open[-1].children.append(data)


def parse(html: str) -> Node:
    t = _Tree()
    t.feed(html or "")
    t.close()
    return t.html


def squash(s: str) -> str:
    return " ".join(s.split())


def number(raw: str | None) -> float:
    """The number a text stands for, NaN where it is none."""
    try:
        return float(raw) if raw else math.nan
    except ValueError:
        return math.nan


def point(raw: str) -> tuple[float, float] | None:
    parts = [number(p.strip()) for p in raw.split(",")]
    if len(parts) != 2 or not all(map(math.isfinite, parts)) or abs(parts[0]) > 90 or abs(parts[1]) > 180:
        return None
    return parts[0], parts[1]


def safe_url(canonical: str, own: str, origins: list[str] | None = None, base: str | None = None, warn=None) -> str:
    """The canonical URL where it is one to trust, else the page's own.

    A path from the root passes as it is; else only http and https, resolved
    against ``base``, and only the allowed origins if any are named.
    """
    if not canonical:
        return own
    if canonical[0] == "/" and canonical[:2] != "//":
        return canonical
    try:
        parts = urlsplit(canonical)
        if not (parts.scheme and parts.netloc):
            parts = urlsplit(urljoin(base, canonical)) if base else None
        ok = parts is not None and parts.scheme in ("http", "https") and bool(parts.netloc)
        if ok and origins is not None:
            ok = f"{parts.scheme}://{parts.hostname}" + (f":{parts.port}" if parts.port else "") in origins
    except ValueError:
        ok = False
    if not ok:
        if warn is not None:
            warn.append(f"canonical URL {canonical!r} is not used")
        return own
    return parts.geturl()


def _first(root: Node, test) -> Node | None:
    return next((n for n in root.walk() if test(n)), None)


def _body(root: Node, controls: str) -> Node | None:
    return _first(root, lambda n: f"data-{controls}-body" in n.attrs) or _first(root, lambda n: n.tag == "main") or _first(root, lambda n: n.tag == "body")


def _prune(node: Node, controls: str) -> None:
    rest = [node]
    while rest:
        at = rest.pop()
        at.children = [c for c in at.children if not isinstance(c, Node) or not (c.tag in _BOILERPLATE or f"data-{controls}-ignore" in c.attrs)]
        rest.extend(c for c in at.children if isinstance(c, Node))


def extract(html: str, url: str, controls: str = CONTROLS, origins: list[str] | None = None, base: str | None = None, closed_references: bool = False) -> tuple[dict, Node]:
    """A page's row (without detected language) and its pruned tree. With ``closed_references``
    only character references that end in a semicolon are decoded."""
    root = parse(_OPEN_REFERENCE.sub("&amp;", html) if closed_references else html)
    warn: list[str] = []
    metas = [n for n in root.walk() if n.tag == "meta"]
    content = lambda n: n.attrs.get("content", "").strip()
    one = lambda name: next((n for n in metas if n.attrs.get("name") == f"{controls}-{name}"), None)
    title = _first(root, lambda n: n.tag == "title")
    link = _first(root, lambda n: n.tag == "link" and n.attrs.get("rel") == "canonical")
    described = next((n for n in metas if n.attrs.get("name") == "description"), None)
    noindex = one("noindex") is not None
    body = _body(root, controls)
    if body is not None:
        _prune(body, controls)
    boost = number(one("boost").attrs.get("content") if one("boost") else None)
    row: dict = {
        "title": title.text() if title else "",
        "declared": root.attrs.get("lang", "").strip(),
        "body": body.text() if body else "",
        "excerpt": squash(described.attrs.get("content", "")) if described else "",
        "url": safe_url(link.attrs.get("href", "").strip() if link else "", url, origins, base, warn),
        "noindex": noindex,
        "boost": boost if math.isfinite(boost) and boost > 0 else 1.0,
        "facets": {},
        "range_facets": {},
        "geo_facets": {},
        "stored": {},
        "metadata": {},
    }
    # the longer prefixes first: one begins with the other
    for n in metas:
        name, value = n.attrs.get("name", ""), content(n)
        for prefix, kind in (("stored-", "stored"), ("facet-range-", "range_facets"), ("facet-geo-", "geo_facets"), ("facet-", "facets"), ("meta-", "metadata")):
            if not name.startswith(f"{controls}-{prefix}"):
                continue
            f = name[len(controls) + 1 + len(prefix) :]
            if not f:
                pass
            elif kind == "metadata":
                row[kind].setdefault(f, value)
            elif kind == "stored":
                if f in RESERVED:
                    warn.append(f"{name}: the name is reserved")
                elif value:
                    row[kind].setdefault(f, value)
            elif kind == "range_facets":
                if math.isfinite(number(value)):
                    row[kind].setdefault(f, number(value))
            elif kind == "geo_facets":
                if value and f not in row[kind]:
                    p = point(value)
                    if p is None:
                        warn.append(f"{name}: {value!r} is no latitude and longitude")
                    else:
                        row[kind][f] = {"lat": p[0], "lon": p[1]}
            elif value and value not in row[kind].setdefault(f, []):
                row[kind][f].append(value)
            break
    row["facets"] = {k: v for k, v in row["facets"].items() if v}
    priority = number(one("pin-priority").attrs.get("content") if one("pin-priority") else None)
    how = {
        "mode": "contains" if one("pin-mode") and content(one("pin-mode")) == "contains" else "exact",
        "priority": priority if math.isfinite(priority) else 0.0,
        "exclusive": one("pin-exclusive") is not None,
    }
    row["pins"] = [{"phrase": content(n), **how} for n in metas if n.attrs.get("name") == f"{controls}-pin" and content(n)]
    row["warnings"] = warn
    return row, root


def split_sections(root: Node, url: str, levels: tuple[str, ...], controls: str = CONTROLS) -> tuple[list[dict], str]:
    """The sections that headings with ids begin, and the text before the first heading.

    A heading without an id ends a section and begins none; of two with one URL
    the first counts; text belongs to the last heading that is still open.
    """
    body = _body(root, controls)
    frames: list[dict] = []
    open_: list[dict] = []
    intro: list[str] = []

    rest = body.children[::-1] if body is not None else []
    while rest:
        c = rest.pop()
        if not isinstance(c, Node):
            s = squash(c)
            if s:
                (open_[-1]["parts"] if open_ else intro if not frames else []).append(s)
        elif c.tag in levels:
            level = HEADINGS[c.tag]
            while open_ and open_[-1]["level"] >= level:
                open_.pop()
            open_.append({"level": level, "title": c.text(), "anchor": c.attrs.get("id", "").strip(), "parts": []})
            frames.append(open_[-1])
        else:
            rest.extend(reversed(c.children))
    out, seen = [], set()
    for f in frames:
        at = url.split("#", 1)[0] + "#" + f["anchor"]
        text_ = " ".join(f["parts"])
        if f["anchor"] and at not in seen and (f["title"] or text_):
            seen.add(at)
            out.append({"title": f["title"], "body": text_, "url": at, "anchor": f["anchor"], "level": f["level"]})
    return out, " ".join(intro)


_PAGE = (
    "title string, declared string, body string, excerpt string, url string, noindex boolean, boost double, facets map<string,array<string>>, range_facets map<string,double>, "
    "geo_facets map<string,struct<lat:double,lon:double>>, stored map<string,string>, metadata map<string,string>, pins array<struct<phrase:string,mode:string,priority:double,exclusive:boolean>>, "
    "warnings array<string>, sections array<struct<title:string,body:string,url:string,anchor:string,level:int>>, intro string"
)
_STRUCT = "struct<" + re.sub(r"(^|, )(\w+) ", r"\1\2:", _PAGE) + ">"


def extract_pages(pages: DataFrame, sections: tuple[str, ...] = ("h2", "h3"), default_language: str = "en", controls: str = CONTROLS, origins: list[str] | None = None, base: str | None = None, closed_references: bool = False) -> DataFrame:
    """(doc_id, page): pages (doc_id, url, html) with a struct of all that was extracted.

    A page's language is the declared one, else the one detected, else the default.
    """
    bad = [s for s in sections if s not in HEADINGS]
    if bad or not sections:
        raise ValueError(f"sections are headings h1 to h6, not {bad}")
    given = pages.select("doc_id", "html", "url")
    made = T.StructType([given.schema["doc_id"], *T._parse_datatype_string(f"page {_STRUCT}").fields])
    out = to_arrow_schema(made)
    maps = ("facets", "range_facets", "geo_facets", "stored", "metadata")

    def one(html: str | None, url: str | None) -> dict:
        row, tree = extract(html or "", url or "", controls, origins, base, closed_references)
        row["sections"], row["intro"] = split_sections(tree, row["url"], sections, controls)
        return row | {k: list(row[k].items()) for k in maps}

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in cut_batches(batches, BATCH_BYTES):
            rows = [one(h, u) for h, u in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(out.field(0).type), pa.array(rows, out.field(1).type)], schema=out)

    p = given.mapInArrow(lean(run), made)
    page = F.col("page")
    found = text.detect_language(F.concat_ws(" ", page["title"], page["body"]), profiles.codes())
    lang = F.when(page["declared"] != "", page["declared"]).otherwise(F.coalesce(found, F.lit(default_language)))
    return p.select("doc_id", page.withField("lang", lang).alias("page"))


def prepare(pages: DataFrame, sections: tuple[str, ...] | None = None, mode: str = "sections", **how) -> DataFrame:
    """Documents (DOC_SCHEMA) of pages; pages marked noindex give none.

    Without ``sections`` a page is a document. With them, mode "sections" gives a
    document a section, and the page itself for the text before the first heading
    or where no section is eligible; "page-and-sections" gives both. Section ids
    follow the greatest page id in the order of pages and sections; sections have
    their page's language, boost, facets, stored fields and metadata, but no pins.
    """
    if mode not in ("sections", "page-and-sections"):
        raise ValueError(f"the mode is sections or page-and-sections, not {mode!r}")
    read = extract_pages(pages, sections or ("h2", "h3"), **how).where(~F.col("page.noindex"))
    p = F.col("page")
    held = F.to_json(p["metadata"])
    meta = F.when(F.size(p["metadata"]) > 0, held)

    def document(id_: Column, url: Column, title: Column, body: Column, page_title: Column | None, pins: Column, given: Column | None) -> list[Column]:
        indexed = F.create_map(F.lit("title"), title, F.lit("body"), body, *([F.lit("pageTitle"), page_title] if page_title is not None else []))
        shown = text.excerpt(body) if given is None else F.when(given != "", given).otherwise(text.excerpt(body))
        stored = F.map_concat(p["stored"], F.create_map(F.lit("title"), title, F.lit("excerpt"), shown, *([F.lit("pageTitle"), page_title] if page_title is not None else [])))
        return [id_.alias("doc_id"), F.lit(None).cast("string").alias("external_id"), url.alias("url"), p["lang"].alias("lang"), indexed.alias("indexed"), stored.alias("stored"), meta.alias("metadata"), p["boost"].alias("boost"), p["facets"].alias("facets"), p["range_facets"].alias("range_facets"), p["geo_facets"].alias("geo_facets"), pins.alias("pins")]

    whole = document(F.col("doc_id"), p["url"], p["title"], p["body"], p["title"] if sections else None, p["pins"], p["excerpt"])
    if not sections:
        return read.select(*whole)
    read = stored(read, "pages")  # HTML is parsed once
    if mode == "sections":
        own = read.where((F.size(p["sections"]) == 0) | (p["intro"] != ""))
        body = F.when(F.size(p["sections"]) == 0, p["body"]).otherwise(p["intro"])
        first = own.select(*document(F.col("doc_id"), p["url"], p["title"], body, p["title"], p["pins"], p["excerpt"]))
    else:
        first = read.select(*whole)
    top = pages.agg(F.coalesce(F.max("doc_id"), F.lit(-1)).alias("top"))
    counts = read.select("doc_id", F.size(p["sections"]).alias("n")).where("n > 0")
    offsets = running(counts, F.col("doc_id"), F.col("n"), "offset").select("doc_id", "offset")
    parts = read.select("doc_id", "page", F.posexplode("page.sections").alias("k", "s")).join(offsets, "doc_id").crossJoin(F.broadcast(top))  # one row
    s = F.col("s")
    rest = parts.select(*document(F.col("top") + 1 + F.col("offset") + F.col("k"), s["url"], s["title"], s["body"], p["title"], F.array().cast("array<struct<phrase:string,mode:string,priority:double,exclusive:boolean>>"), None))
    return first.unionByName(rest)


def read_directory(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, url, html) of the .html files below a folder, in the order of their
    path components; the URL is the path without the suffix."""
    files = spark.read.format("text").option("wholetext", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.html").load(path)
    root = path.rstrip("/").split("://")[-1].removeprefix("file:")
    rel = F.regexp_replace(F.expr("replace(_metadata.file_path, 'file:', '')"), "^/*" + re.escape(root.lstrip("/")) + "/", "")
    rows = files.select(rel.alias("rel"), F.col("value").alias("html"))
    # paths alone are ordered; pages are joined to their number
    numbered = running(rows.select("rel"), F.split("rel", "/"), F.lit(1), "doc_id")
    return rows.join(numbered, "rel").select("doc_id", F.concat(F.lit("/"), F.regexp_replace("rel", r"\.html$", "")).alias("url"), "html")


def build_pages(pages: DataFrame, sections: tuple[str, ...] | None = None, mode: str = "sections", field_boosts: dict[str, float] | None = None, extract_options: dict | None = None, **build) -> LexicalIndex:
    """An index of pages (doc_id, url, html). Title counts three times as much as body;
    stored meta fields join the registry as they are found."""
    boosts = field_boosts or {}
    docs = stored(prepare(pages, sections, mode, **(extract_options or {})), "pages")  # HTML is parsed once
    fields = {"title": FieldDef(True, True, boosts.get("title", 3.0)), "body": FieldDef(True, False, boosts.get("body", 1.0)), "excerpt": FieldDef(False, True)}
    if sections:
        fields["pageTitle"] = FieldDef(True, True, 1.0)
    found = [r[0] for r in docs.select(F.explode(F.map_keys("stored"))).distinct().collect()]
    for name in sorted(set(found) - set(fields)):
        fields[name] = FieldDef(False, True)
    index = build_documents(docs, fields, **build)
    index.scratch += (docs,)
    return index
