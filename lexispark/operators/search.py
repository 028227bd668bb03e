"""Search: one plan from postings to ranked documents, and the result around it."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field, replace
from functools import cached_property, reduce
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import profiles, text
from ..plans.index import LexicalIndex, json_or_none
from . import filters as fl
from .highlight import highlight
from .query import Query, parse
from .score import posting_score


@dataclass(frozen=True)
class Options:
    language: str | None = None
    limit: int = 10
    operator: str = "and"
    filters: dict[str, Any] = field(default_factory=dict)
    facets: tuple[str, ...] = ()
    synonyms: bool = False
    synonym_weight: float = 0.5
    fuzzy: bool = False
    fuzzy_weight: float = 0.5
    fuzzy_among: str | None = None  # a pattern of the terms that typo tolerance may take, None: all
    field_boosts: dict[str, float] = field(default_factory=dict)
    term_boosts: dict[str, float] = field(default_factory=dict)
    highlight: bool = False
    sort_by_distance: bool = False


@dataclass
class Hit:
    id: int
    score: float
    url: str = ""
    fields: dict[str, str] = field(default_factory=dict)
    external_id: str | None = None
    metadata: Any = None
    content_hash: str | None = None
    pinned: bool = False
    highlights: dict[str, list[tuple[str, bool]]] | None = None
    distance_km: float | None = None


@dataclass
class FacetValue:
    value: str
    count: int
    selected: bool


@dataclass
class Facet:
    values: list[FacetValue]
    separator: str | None = None


@dataclass
class Result:
    hits: list[Hit]
    total_hits: int
    language: str
    facets: dict[str, Facet] | None = None
    did_you_mean: list[str] | None = None


@dataclass
class Plan:
    """The parts of a search, each a DataFrame that nothing has run yet."""

    candidates: DataFrame  # doc_id that the query matches
    scored: DataFrame  # doc_id, score of whatever holds one of its terms
    failed: list[str]


def single_edits(term: str, max_edits: int) -> int:
    return 1 if len(term) <= 3 else max_edits


class Searcher:
    """Searches of one index. What a query needs of the small tables (statistics,
    synonyms) is read once; postings and documents stay distributed."""

    def __init__(self, index: LexicalIndex):
        self.index = index
        self.spark = index.stats.sparkSession
        self.counts = {r["lang"]: r["doc_count"] for r in index.stats.collect()}

    @cached_property
    def means(self) -> dict[str, dict[str, float]]:
        """Mean lengths of fields by language."""
        means: dict[str, dict[str, float]] = {}
        for r in self.index.field_stats.collect():
            means.setdefault(r["lang"], {})[r["field"]] = r["avg_len"]
        return means

    # --- expansion ---

    def variants(self, lang: str, term: str, kinds: tuple[str, ...]) -> list[str]:
        return sorted({v for l, k, key, v in self.index.synonyms if l == lang and k in kinds and key == term and v != term})

    def fuzzy_terms(self, lang: str, term: str) -> list[tuple[str, int]]:
        """(term, distance) of the dictionary terms within the allowed edits, by the deletion table."""
        most = single_edits(term, self.index.max_edits)
        return [(t, d) for t, d in self._met(lang, term) if 0 < d <= most]

    def _met(self, lang: str, term: str) -> list[tuple[str, int]]:
        if self.index.deletions is None:
            return []
        mine = self.spark.range(1).select(F.explode(text.deletes(F.lit(term), self.index.max_edits)).alias("deletion"))
        # a term that shares a deletion with another differs from it by so many characters at most
        near = F.abs(F.length("term") - F.lit(len(term))) <= self.index.max_edits
        met = self.index.deletions.where((F.col("lang") == lang) & near).join(F.broadcast(mine), "deletion").select("term").distinct()
        rows = met.select("term", F.levenshtein(F.col("term"), F.lit(term)).alias("d")).orderBy("d", "term").collect()
        return [(r["term"], r["d"]) for r in rows]

    # --- the plan ---

    def plan(self, query: Query, o: Options, lang: str) -> Plan:
        exact: list[tuple[int, str, float, int]] = []  # slot, term, weight, order
        heads: list[tuple[int, str]] = []  # slot, beginning
        attempts: list[tuple[int, list[str], float, int]] = []  # slot, words, weight, order
        slots: list[str | None] = []
        for t in query.terms:
            slot = len(slots)
            slots.append(None if t.prefix else t.term)
            if t.prefix:
                heads.append((slot, t.term))
                continue
            ways: dict[str, float] = {t.term: 1.0}
            if o.synonyms:
                for v in self.variants(lang, t.term, ("equivalence", "directional")):
                    ways.setdefault(v, o.synonym_weight)
            if o.fuzzy:
                for v, d in self.fuzzy_terms(lang, t.term):
                    if o.fuzzy_among is not None and not re.fullmatch(o.fuzzy_among, v):
                        continue
                    ways.setdefault(v, o.fuzzy_weight**d)
            exact += [(slot, term, w, slot * 1000 + i) for i, (term, w) in enumerate(ways.items())]
        phrase_words: list[str] = []
        for words in query.phrases:
            slot = len(slots)
            slots.append(None)
            own = [w.term for w in words]
            phrase_words += own
            tried = [(own, 1.0)]
            if o.synonyms:
                tried += [(v.split(" "), o.synonym_weight) for v in self.variants(lang, " ".join(own), ("phrase",))]
            attempts += [(slot, terms_, weight, slot * 1000 + i * 50) for i, (terms_, weight) in enumerate(tried)]
        # all that the query asks of the postings comes at once
        wanted = sorted({t for _, t, _, _ in exact})
        postings = self.index.postings_of(lang, [*wanted, *(t for _, words, _, _ in attempts for t in words)], [h for _, h in heads])
        parts: list[DataFrame] = []
        if exact:
            # a row an expanded query term
            clauses = self.spark.createDataFrame(exact, "slot int, term string, weight double, ord int")
            rows = postings.where(F.col("term").isin(*wanted))
            parts.append(rows.join(F.broadcast(clauses), "term").select("slot", "term", "weight", "ord", "doc_id", "boost", "df", "fields"))
        for slot, head in heads:
            rows = postings.where(F.col("term").startswith(head))
            parts.append(rows.select(F.lit(slot).alias("slot"), "term", F.lit(1.0).alias("weight"), F.lit(slot * 1000).alias("ord"), "doc_id", "boost", "df", "fields"))
        parts += [self._phrase(postings, *a) for a in attempts]
        matched = reduce(DataFrame.unionByName, parts)
        # a document must be in as many slots as the operator asks
        slot_docs = matched.select("slot", "doc_id").distinct()
        if o.operator == "or":
            candidates = slot_docs.select("doc_id").distinct()
        elif len(slots) == 1:
            candidates = slot_docs.select("doc_id")
        else:
            candidates = slot_docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") == len(slots)).select("doc_id")
        failed: list[str] = []
        if o.fuzzy:
            found = {r[0] for r in slot_docs.select("slot").distinct().collect()}
            failed = [s for i, s in enumerate(slots) if s is not None and i not in found]
            missing = sorted(set(phrase_words))
            if missing:
                have = {r[0] for r in postings.where(F.col("term").isin(*missing)).select("term").distinct().collect()}
                failed += [w for w in dict.fromkeys(phrase_words) if w not in have and w not in failed]
        boosts = {k: f.boost for k, f in self.index.fields.items()} | o.field_boosts
        one = posting_score(F.col("fields"), F.col("df"), self.counts.get(lang, 0), self.means.get(lang, {}), boosts) * F.col("weight")
        if o.term_boosts:
            table = F.create_map(*[F.lit(x) for k, v in o.term_boosts.items() for x in (k, float(v))])
            one = one * F.coalesce(table[F.col("term")], F.lit(1.0))
        # clauses add up in the order of the query, whatever the order of rows
        scored = (
            matched.select("doc_id", F.coalesce("boost", F.lit(1.0)).alias("b"), F.struct("ord", "term", one.alias("s")).alias("c"))
            .groupBy("doc_id")
            .agg(F.max("b").alias("b"), F.array_sort(F.collect_list("c")).alias("cs"))
            .select("doc_id", (F.aggregate("cs", F.lit(0.0), lambda a, c: a + c["s"]) * F.col("b")).alias("score"))
        )
        return Plan(candidates, scored, failed)

    def _phrase(self, postings: DataFrame, slot: int, words: list[str], weight: float, order: int) -> DataFrame:
        """Postings of a phrase's words in the documents that hold them side by side in one field."""
        distinct = sorted(set(words))
        rows = postings.where(F.col("term").isin(*distinct))
        docs = rows.groupBy("doc_id").agg(F.max("boost").alias("boost"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("term", F.struct("df", "fields").alias("p"))))).alias("of"))
        docs = docs.where(F.size("of") == len(distinct))
        first = F.col("of")[words[0]]["fields"]

        def here(f: Column) -> Column:
            def follows(p: Column, i: int) -> Column:
                return F.exists(F.col("of")[words[i]]["fields"], lambda g: (g["field"] == f["field"]) & F.array_contains(g["pos"], (p + F.lit(i)).cast("int")))

            def run(p: Column) -> Column:
                return reduce(lambda a, b: a & b, [follows(p, i) for i in range(1, len(words))], F.lit(True))

            return F.exists(f["pos"], run)

        hits = docs.where(F.exists(first, here)).withColumn("w", F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(w).alias("term")) for i, w in enumerate(words)])))
        return hits.select(F.lit(slot).alias("slot"), "w.term", F.lit(float(weight)).alias("weight"), (F.lit(order) + F.col("w.i")).alias("ord"), "doc_id", "boost", F.col("of")[F.col("w.term")]["df"].alias("df"), F.col("of")[F.col("w.term")]["fields"].alias("fields"))

    # --- results ---

    def matched_pins(self, query: Query, lang: str, allowed: list[DataFrame]) -> list[tuple[int, float, bool]]:
        """(doc_id, priority, exclusive) of the pins the query calls up, first one first."""
        if not query.whole:
            return []
        p = self.index.pins.where(F.col("lang") == lang)
        exact = (F.col("mode") != "contains") & (F.col("phrase") == query.whole)
        inside = (F.col("mode") == "contains") & text.contains_phrase(F.lit(query.whole), F.col("phrase"))
        rows = p.where(exact | inside)
        order = Window.partitionBy("doc_id").orderBy(F.desc("priority"), "phrase", "ord")
        rows = rows.withColumn("k", F.row_number().over(order)).where("k = 1")
        for docs in allowed:
            rows = rows.join(docs, "doc_id", "left_semi")
        return [(r["doc_id"], r["priority"], r["exclusive"]) for r in rows.orderBy(F.desc("priority"), "phrase", "ord").collect()]

    def search(self, query_text: str, options: Options | None = None) -> Result:
        o = options or Options()
        if o.operator not in ("and", "or"):
            raise ValueError(f"the operator is and or or, not {o.operator!r}")
        lang = o.language or self.index.default_language
        profile = profiles.profile(lang, lang in self.counts and lang not in profiles.PROFILES)
        query = parse(query_text, profile)
        if query.empty:
            return Result([], 0, lang)
        plan = self.plan(query, o, lang)
        kinds = fl.facet_types(self.index, sorted({*o.filters, *o.facets}))
        active = {f: fl.docs_of(self.index, f, kinds[f], v) for f, v in o.filters.items() if f in kinds}
        candidates = plan.candidates
        for docs in active.values():
            candidates = candidates.join(docs, "doc_id", "left_semi")
        for f, v in o.filters.items():
            known = self.index.fields.get(f)
            if f not in kinds and known is not None and known.stored:
                wanted = fl.values_of(v)
                stored = self.index.doc_store.where(F.col("stored")[f].isin(*wanted) if wanted else F.lit(False))
                candidates = candidates.join(stored.select("doc_id"), "doc_id", "left_semi")
        pins = self.matched_pins(query, lang, list(active.values()))
        exclusive = any(x for _, _, x in pins)
        shown = pins[: o.limit]
        pinned = [d for d, _, _ in shown]
        distance = None
        geo = [f for f in active if kinds[f] == "geo"]
        if len(geo) == 1 and fl.is_geo(o.filters[geo[0]]):
            g = o.filters[geo[0]]
            distance = self.index.facet_geo.where(F.col("field") == geo[0]).select("doc_id", text.haversine_km(F.lit(float(g["lat"])), F.lit(float(g["lon"])), F.col("lat"), F.col("lon")).alias("km"))
        ranked = plan.scored.join(candidates, "doc_id", "left_semi")
        ranked = ranked.join(distance, "doc_id", "left") if distance is not None else ranked.withColumn("km", F.lit(None).cast("double"))
        # the nearest first, and of those equally far the one of the least id
        by = [F.asc_nulls_last("km")] if o.sort_by_distance and distance is not None else [F.desc("score")]
        organic = ranked.where(~F.col("doc_id").isin(*pinned)) if pinned else ranked
        # limit first, then fetch what the hits show
        room = 0 if exclusive else max(0, o.limit - len(shown))
        top = [(r["doc_id"], r["score"], r["km"]) for r in organic.orderBy(*by, "doc_id").limit(room).collect()] if room else []
        pin_scores: dict[int, float] = {}
        pin_km: dict[int, float] = {}
        if pinned:
            pin_scores = {r["doc_id"]: r["score"] for r in plan.scored.where(F.col("doc_id").isin(*pinned)).collect()}
            if distance is not None:
                pin_km = {r["doc_id"]: r["km"] for r in distance.where(F.col("doc_id").isin(*pinned)).collect()}
        order = [(d, pin_scores.get(d, 0.0), pin_km.get(d), True) for d in pinned] + [(*t, False) for t in top]
        hits = self._hits(order, query if o.highlight else None)
        if exclusive:
            total = len(shown)
        else:
            extra = self.spark.createDataFrame([(d,) for d in pinned], "doc_id long")
            total = (candidates.union(extra).distinct() if pinned else candidates).count()
        facets = None
        if o.facets:
            facets = {}
            for f in o.facets:
                if f not in kinds:
                    continue
                base = plan.candidates
                for other, docs in active.items():
                    if other != f:
                        base = base.join(docs, "doc_id", "left_semi")
                facets[f] = self._facet(f, kinds[f], base, fl.values_of(o.filters.get(f)))
        suggestions = None
        if o.fuzzy and not hits and plan.failed and self.index.deletions is not None:
            suggestions = list(dict.fromkeys(t for f in plan.failed for t, _ in self._met(lang, f)[:3])) or None
        return Result(hits, total, lang, facets, suggestions)

    def _facet(self, name: str, kind: str, base: DataFrame | None, selected: list[str]) -> Facet:
        rows = [] if kind == "geo" else [FacetValue(r["value"], r["count"], r["selected"]) for r in fl.facet_counts(self.index, name, base, selected).collect()]
        if name in self.index.buckets:
            place = {v: i for i, v in enumerate(self.index.buckets[name])}
            rows.sort(key=lambda v: place.get(v.value, 0))
        return Facet(rows, self.index.separators.get(name, ">") if kind == "hierarchy" else None)

    def _hits(self, order: list[tuple], query: Query | None = None) -> list[Hit]:
        if not order:
            return []
        ids = sorted({d for d, *_ in order})
        docs = {r["doc_id"]: r for r in self.index.doc_store.where(F.col("doc_id").isin(*ids)).collect()}
        out = []
        for d, score, km, pin in order:
            r = docs.get(d)
            h = Hit(d, score, pinned=pin, distance_km=km)
            if r is not None:
                h.url, h.fields, h.external_id = r["url"] or "", dict(r["stored"] or {}), r["external_id"]
                h.metadata, h.content_hash = json_or_none(r["metadata"]), r["content_hash"]
            if query is not None:
                words = [(t.literal, t.prefix) for t in query.terms] + [(t.literal, False) for p in query.phrases for t in p]
                h.highlights = {f: highlight(t, words) for f, t in h.fields.items()}
            out.append(h)
        return out

    def stream(self, query_text: str, options: Options | None = None) -> Iterator[Result]:
        """The literal result first and then the expanded one, where expansion is on; else one result."""
        o = options or Options()
        if o.synonyms or o.fuzzy:
            yield self.search(query_text, replace(o, synonyms=False, fuzzy=False))
        yield self.search(query_text, o)

    def facet_values(self, name: str, filters: dict[str, Any] | None = None) -> Facet:
        """Counts of a field's values over all documents that the other fields' filters let through."""
        filters = filters or {}
        kinds = fl.facet_types(self.index, sorted({name, *filters}))
        if name not in kinds:
            return Facet([])
        base = None
        for f, v in filters.items():
            if f != name and f in kinds:
                docs = fl.docs_of(self.index, f, kinds[f], v)
                base = docs if base is None else base.join(docs, "doc_id", "left_semi")
        return self._facet(name, kinds[name], base, fl.values_of(filters.get(name)))

    def get_documents(self, ids: list[int]) -> list[Hit]:
        """Documents in the order asked for, repeats included, missing ones left out."""
        have = {h.id: h for h in self._hits([(d, 0.0, None, False) for d in dict.fromkeys(ids)]) if h.url or h.fields or h.content_hash}
        return [replace(have[i]) for i in ids if i in have]
