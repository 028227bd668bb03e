"""Command line: ``python -m lexispark.cli index|query|facet``."""

from __future__ import annotations

import argparse
import json
import sys
from dataclasses import asdict, is_dataclass

from pyspark.sql import SparkSession

from .client import SearchClient
from .operators.search import Options
from .plans import store
from .plans.index import FieldDef, build_documents
from .sources import html, shards


def camel(name: str) -> str:
    first, *rest = name.split("_")
    return first + "".join(x.title() for x in rest)


def jsonable(x, keep: bool = False):
    """Dataclasses as objects with camelCase keys; what they hold under other keys stays as it is."""
    if is_dataclass(x):
        return {camel(k): jsonable(getattr(x, k)) for k in asdict(x) if getattr(x, k) is not None}
    if isinstance(x, dict):
        return {k: jsonable(v) for k, v in x.items()}
    return [jsonable(v) for v in x] if isinstance(x, (list, tuple)) else x


def pairs(given: list[str] | None) -> dict[str, str]:
    out = {}
    for p in given or []:
        key, eq, value = p.partition("=")
        if not eq:
            raise SystemExit(f"a filter is field=value, not {p!r}")
        out[key] = value
    return out


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="lexispark")
    sub = p.add_subparsers(dest="command", required=True)
    i = sub.add_parser("index", help="index a folder of HTML pages or a JSON list of documents")
    i.add_argument("source")
    i.add_argument("out")
    i.add_argument("--sections", help="headings that begin sections, as h2,h3")
    i.add_argument("--page-and-sections", action="store_true")
    i.add_argument("--json", action="store_true", help="write JSON shards, not tables")
    i.add_argument("--fuzzy", type=int, default=0, metavar="EDITS")
    for name in ("query", "facet"):
        q = sub.add_parser(name)
        q.add_argument("index")
        q.add_argument("text" if name == "query" else "field")
        q.add_argument("--filter", action="append", metavar="FIELD=VALUE")
        q.add_argument("--json", action="store_true")
        if name == "query":
            q.add_argument("--limit", type=int, default=10)
            q.add_argument("--language")
            q.add_argument("--facets", default="")
            for flag in ("synonyms", "fuzzy", "highlight"):
                q.add_argument(f"--{flag}", action="store_true")
    return p


def index(spark: SparkSession, a: argparse.Namespace) -> None:
    levels = tuple(a.sections.split(",")) if a.sections else ("h2", "h3") if a.page_and_sections else None
    mode = "page-and-sections" if a.page_and_sections else "sections"
    options = {"fuzzy": bool(a.fuzzy), "max_edits": a.fuzzy or 1}
    if a.source.endswith(".json"):
        docs, structured = shards.read_config(spark, a.source)
    else:
        docs, structured = html.read_directory(spark, a.source), False
    if structured:
        from pyspark.sql import functions as F

        names = {c: sorted(r[0] for r in docs.select(F.explode(F.map_keys(c))).distinct().collect()) for c in ("indexed", "stored")}
        fields = {n: FieldDef(n in names["indexed"], n in names["stored"]) for n in sorted({*names["indexed"], *names["stored"]})}
        built = build_documents(docs, fields, **options)
    else:
        built = html.build_pages(docs, levels, mode, **options)
    shards.export(built, a.out) if a.json else store.save(built, a.out)


def main(args: list[str] | None = None) -> int:
    a = parser().parse_args(args)
    spark = SparkSession.builder.appName("lexispark").getOrCreate()
    if a.command == "index":
        index(spark, a)
        return 0
    client = SearchClient(spark, a.index)
    if a.command == "facet":
        found = client.facet_values(a.field, pairs(a.filter))
        lines = [f"{v.value}\t{v.count}" for v in found.values]
    else:
        found = client.search(a.text, Options(limit=a.limit, language=a.language, filters=pairs(a.filter), facets=tuple(f for f in a.facets.split(",") if f), synonyms=a.synonyms, fuzzy=a.fuzzy, highlight=a.highlight))
        lines = [f"{h.id}\t{h.score:.4f}\t{h.url}" for h in found.hits]
    sys.stdout.write(json.dumps(jsonable(found), ensure_ascii=False) + "\n" if a.json else "".join(x + "\n" for x in lines))
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
