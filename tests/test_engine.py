"""Golden cases of the retrieval engine on small indexes."""

import json
import math

import pytest
from pyspark.sql import functions as F

from lexispark.client import SearchClient
from lexispark.operators.query import analyze, parse
from lexispark.operators.search import Options, Searcher
from lexispark.plans import store
from lexispark.plans.index import DOC_SCHEMA, FieldDef, build_documents
from lexispark.functions import profiles, text
from lexispark.sources import shards

FIELDS = {"title": FieldDef(True, True, 3.0), "body": FieldDef(True), "sku": FieldDef(False, True)}

DOCS = [
    # id, title, body, boost, facets, ranges, geo, pins, sku
    (1, "Red widget", "A red widget for the wireless workshop", None, {"category": ["red"], "stock": ["in"], "place": ["Shop > Tools > Hand"]}, {"price": 10.0}, {"at": (51.5074, -0.1278)}, None, "A1"),
    (2, "Blue widget", "noise cancelling headphones are no widget", 2.0, {"category": ["red"], "stock": ["out"], "place": ["Shop > Tools"]}, {"price": 50.0}, {"at": (40.7128, -74.006)}, [("best widget", "exact", 5.0, False)], "B2"),
    (3, "Green gadget", "the red gadget and headphones cancelling noise", None, {"category": ["blue"], "stock": ["in"], "place": ["Shop"]}, {"price": 20.0}, {}, [("widget", "contains", 1.0, False), ("best widget", "exact", 9.0, False)], "C3"),
    (4, "Television", "a television guide", None, {"category": ["blue"]}, {}, {}, None, "D4"),
]


def frame(spark, rows=DOCS):
    made = [(i, f"x{i}", f"/p/{i}", "en", {"title": t, "body": b}, {"title": t, "sku": s}, json.dumps({"k": i}), boost, f, r, {k: {"lat": v[0], "lon": v[1]} for k, v in g.items()}, p and [{"phrase": a, "mode": m, "priority": q, "exclusive": e} for a, m, q, e in p]) for i, t, b, boost, f, r, g, p, s in rows]
    return spark.createDataFrame(made, DOC_SCHEMA)


@pytest.fixture(scope="module")
def index(spark):
    synonyms = {"en": {"equivalences": [["gadget", "gizmo", "doodad"]], "directional": {"tv": ["television"]}, "multiWord": [["noise cancelling", "headphones cancelling"]]}}
    return build_documents(frame(spark), FIELDS, synonyms=synonyms, fuzzy=True, hierarchical={"place": ">"}, buckets={"price": [20.0, 40.0]}).cache()


@pytest.fixture(scope="module")
def s(index):
    return Searcher(index)


def ids(r):
    return [h.id for h in r.hits]


def model(query, boosts=None, doc=None):
    """BM25F by plain loops over DOCS."""
    p = profiles.PROFILES["en"]
    held = {d[0]: {"title": [t for t, _ in analyze(d[1], p)], "body": [t for t, _ in analyze(d[2], p)]} for d in DOCS}
    weight = {"title": 3.0, "body": 1.0} | (boosts or {})
    mean = {f: sum(len(v[f]) for v in held.values()) / len(held) for f in weight}
    total = 0.0
    for t in [x.term for x in parse(query, p).terms]:
        df = sum(any(t in v[f] for f in v) for v in held.values())
        w = sum(weight[f] * held[doc][f].count(t) / (0.25 + 0.75 * len(held[doc][f]) / mean[f]) for f in weight)
        total += math.log(1 + (len(held) - df + 0.5) / (df + 0.5)) * w / (w + 1.2)
    return total * (next(d[3] for d in DOCS if d[0] == doc) or 1.0)


def test_scores_follow_the_formula(s):
    r = s.search("widgets red", Options(operator="or", filters={"stock": ["in", "out"]}))
    for h in r.hits:
        assert math.isclose(h.score, model("widgets red", doc=h.id), rel_tol=1e-9)
    boosted = s.search("red", Options(field_boosts={"title": 0.0}))
    assert all(math.isclose(h.score, model("red", {"title": 0.0}, h.id)) for h in boosted.hits)
    once, twice = s.search("red"), s.search("red", Options(term_boosts={"red": 2.0}))
    assert math.isclose(twice.hits[0].score, 2 * once.hits[0].score)


def test_operators_prefixes_and_stopwords(s):
    assert set(ids(s.search("red widget", Options(limit=9)))) == {1, 3}  # 3 is pinned on "widget"
    assert {1, 3} <= set(ids(s.search("red tele*", Options(operator="or")))) and ids(s.search("tele*")) == [4]
    assert s.search("the").hits == [] and s.search("").total_hits == 0
    with pytest.raises(ValueError):
        s.search("red", Options(operator="xor"))
    with pytest.raises(ValueError):
        s.search("red", Options(language="xx"))


def test_phrases(s):
    assert ids(s.search('"noise cancelling"')) == [2]
    assert ids(s.search('"cancelling noise"')) == [3]
    assert set(ids(s.search('"noise cancelling"', Options(synonyms=True)))) == {2, 3}
    assert s.search('"widget red"', Options(filters={"category": "red"})).hits == []


def test_expansion(s):
    assert ids(s.search("gizmo")) == [] and ids(s.search("gizmo", Options(synonyms=True))) == [3]
    half, whole = s.search("gizmo", Options(synonyms=True)), s.search("gadget")
    assert math.isclose(half.hits[0].score, whole.hits[0].score / 2)
    assert ids(s.search("tv", Options(synonyms=True))) == [4] and ids(s.search("television", Options(synonyms=True))) == [4]
    assert ids(s.search("gadgot", Options(fuzzy=True))) == [3]
    r = s.search("televisionxx", Options(fuzzy=True))
    assert r.hits == [] and r.did_you_mean is None  # no term shares a deletion with it
    swapped = s.search("gadegt", Options(fuzzy=True))
    assert swapped.hits == [] and swapped.did_you_mean == ["gadget"]
    first, second = list(s.stream("gizmo", Options(synonyms=True)))
    assert first.hits == [] and ids(second) == [3] and len(list(s.stream("red"))) == 1


def test_filters_and_facets(s):
    r = s.search("red", Options(filters={"category": "red"}, facets=("category", "stock", "place", "price", "at", "none")))
    assert ids(r) == [1] and r.total_hits == 1
    got = {k: {v.value: (v.count, v.selected) for v in f.values} for k, f in r.facets.items()}
    assert got["category"] == {"red": (1, True), "blue": (1, False)} and got["stock"] == {"in": (1, False), "out": (0, False)}
    assert got["place"] == {"Shop": (1, False), "Shop>Tools": (1, False), "Shop>Tools>Hand": (1, False)} and r.facets["place"].separator == ">"
    assert [v.value for v in r.facets["price"].values] == ["<20", "20-40", "40+"] and got["at"] == {} and "none" not in got
    assert ids(s.search("red", Options(filters={"price": {"min": 20}}))) == [3]
    assert sorted(ids(s.search("red", Options(filters={"price": {"min": 10, "max": 20}})))) == [1, 3]
    assert s.search("red", Options(filters={"price": "10"})).hits == []
    assert ids(s.search("red", Options(filters={"sku": ["A1", "zz"]}))) == [1] and len(ids(s.search("red", Options(filters={"nothing": "x"})))) == 2
    everything = {v.value: v.count for v in s.facet_values("category").values}
    assert everything == {"red": 2, "blue": 2}
    assert {v.value: v.count for v in s.facet_values("category", {"stock": "in", "category": "red"}).values} == {"red": 1, "blue": 1}


def test_geo(s):
    near = s.search("widget", Options(filters={"at": {"lat": 51.5, "lon": -0.1, "radius_km": 6000}}, sort_by_distance=True))
    assert ids(near) == [1, 2] and near.hits[0].distance_km < 5 and 5500 < near.hits[1].distance_km < 5650
    assert ids(s.search("widget", Options(filters={"at": {"lat": 51.5, "lon": -0.1, "radius_km": 100}}))) == [1]


def test_documents_equally_far_come_by_id(spark):
    rows = [(i, "", "widget " * i, None, {}, {}, {"at": (10.0, 20.0)}, None, "") for i in (1, 2, 3)]
    near = Searcher(build_documents(frame(spark, rows), FIELDS)).search("widget", Options(filters={"at": {"lat": 10.0, "lon": 20.5, "radius_km": 100}}, sort_by_distance=True))
    assert ids(near) == [1, 2, 3]


def test_pins(s):
    r = s.search("best widget")
    assert ids(r)[:2] == [3, 2] and [h.pinned for h in r.hits[:2]] == [True, True]
    assert ids(s.search("best widget", Options(limit=1))) == [3]
    assert ids(s.search("best widget", Options(filters={"stock": "out"}))) == [2]
    assert s.search("some widget here", Options(limit=1)).hits[0].id == 3


def test_documents_and_highlights(s):
    hits = s.get_documents([3, 99, 1, 3])
    assert ids(type("R", (), {"hits": hits})) == [3, 1, 3] and hits[0].metadata == {"k": 3} and hits[0].content_hash.startswith("sha256:")
    r = s.search("wid*", Options(highlight=True, filters={"sku": "A1"}, limit=20))
    own = next(h for h in r.hits if h.id == 1)
    assert own.highlights["title"] == [("Red ", False), ("widget", True)]


def test_tables_and_shards_give_the_same(spark, index, tmp_path):
    store.save(index, str(tmp_path / "t"))
    shards.export(index, str(tmp_path / "j"))
    again = shards.export(index, str(tmp_path / "k"))
    names = sorted(p.name for p in (tmp_path / "j" / "terms" / "en").iterdir())
    assert names == sorted(p.name for p in (tmp_path / "k" / "terms" / "en").iterdir()) and again["version"] == 2
    for c in (SearchClient(spark, str(tmp_path / "t"), cache=False), SearchClient(spark, str(tmp_path / "j" / "manifest.json"), strict=True, cache=False)):
        for q, o in (("red widget", Options(operator="or")), ("gizmo", Options(synonyms=True)), ("best widget", Options(facets=("place",))), ("gadgot", Options(fuzzy=True))):
            assert c.search(q, o) == Searcher(index).search(q, o)
        assert c.facet_values("category").values


def test_manifest_checks():
    good = {"version": 2, "languages": ["en"], "fields": {}, "docCount": {"en": 1}, "avgFieldLength": {"en": {}}, "defaultLanguage": "en", "shards": {"terms": [{"lang": "en", "prefix": "a", "file": "a.json"}], "docs": [{"file": "d.json", "idRange": [0, 1]}]}}
    assert shards.validate(good, "http://a/m.json", strict=True) is good

    def broken(**k):
        return {**good, "shards": {**good["shards"], **k}}

    for m in ([], {}, {**good, "version": "2"}, {**good, "version": 3}, {**good, "languages": []}, {**good, "defaultLanguage": "de"}, {**good, "docCount": []}, {**good, "pins": []}, broken(terms=[{"prefix": "a"}]), broken(docs=[{"file": "http://b/d.json"}])):
        with pytest.raises(shards.ManifestError):
            shards.validate(m, "http://a/m.json")
    for m in (broken(terms=good["shards"]["terms"] * 2), broken(docs=[{"file": "d", "idRange": [2, 1]}]), {**good, "docCount": {}}, {**good, "avgFieldLength": {}}, {**good, "format": "x"}):
        shards.validate(m, "http://a/m.json")
        with pytest.raises(shards.ManifestError):
            shards.validate(m, "http://a/m.json", strict=True)
    shards.validate(broken(docs=[{"file": "http://b/d.json"}]), "http://a/m.json", cross_origin=True)


def test_export_has_the_published_form(index, tmp_path):
    m = shards.export(index, str(tmp_path))
    read = lambda f: json.loads((tmp_path / f).read_text())
    assert set(m) == {"version", "buildId", "languages", "defaultLanguage", "fields", "docCount", "avgFieldLength", "shards", "facetFields", "pins", "synonyms", "fuzzy"}
    assert m["docCount"] == {"en": 4} and set(m["avgFieldLength"]["en"]) == {"title", "body"} and m == read("manifest.json")
    facets = {f["field"]: read(f["file"]) for f in m["shards"]["facets"]}
    assert set(facets["price"]) == {"type", "values", "sorted"} and facets["price"]["sorted"] == [{"value": 10.0, "doc": 1}, {"value": 20.0, "doc": 3}, {"value": 50.0, "doc": 2}]
    assert set(facets["at"]) == {"type", "values", "points"} and facets["at"]["values"] == {} and facets["place"]["separator"] == ">"
    assert read(m["synonyms"]["en"]) == {"directional": {"tv": ["televis"]}, "equivalences": [["doodad", "gadget", "gizmo"]], "multiWord": [["headphon cancel", "nois cancel"]]}
    for t in m["shards"]["terms"]:
        for e in read(t["file"]).values():
            assert set(e) == {"df", "postings"} and all(set(p) <= {"doc", "boost", "fields"} and all(set(f) == {"tf", "pos", "len"} for f in p["fields"].values()) for p in e["postings"])


def test_synonyms_tied_in_part_stay_so():
    rows = [("en", "equivalence", a, b) for x, y in (("a", "b"), ("b", "c"), ("d", "e")) for a, b in ((x, y), (y, x))]
    groups = shards.synonym_groups(rows)
    assert groups == {"en": {"equivalences": [["a", "b"], ["b", "c"], ["d", "e"]]}} and set(shards.group_rows("en", groups["en"])) == set(rows)


def test_an_index_written_by_hand_is_read(spark, tmp_path):
    term = lambda *docs: {"df": len(docs), "postings": [{"doc": d, "fields": {"body": {"tf": 1, "pos": [p], "len": 2}}} for d, p in docs]}
    files = {
        "t.json": {"red": term((0, 0), (1, 1)), "roof": term((0, 1))},
        "d.json": {"0": {"url": "/a", "fields": {"title": "A", "tags": ["x", "y"]}}, "1": {"url": "/b", "fields": {}, "externalId": "b", "metadata": {"k": 1}}},
        "f.json": {"type": "range", "values": {"9-10": {"count": 1, "docs": [1]}, "100+": {"count": 1, "docs": [0]}}, "sorted": [{"value": 9, "doc": 1}, {"value": 100, "doc": 0}]},
        "s.json": {"equivalences": [["red", "crimson"]]},
        "manifest.json": {
            "version": 2, "buildId": "x", "languages": ["en"], "defaultLanguage": "en", "fields": {"body": {"stored": False}, "title": {"stored": True, "indexed": False}},
            "docCount": {"en": 2}, "avgFieldLength": {"en": {"body": 2}}, "synonyms": {"en": "s.json"},
            "shards": {"terms": [{"lang": "en", "prefix": "r", "file": "t.json", "termCount": 2}], "docs": [{"shard": 0, "file": "d.json", "idRange": [0, 1]}], "facets": [{"field": "size", "file": "f.json"}]},
        },
    }
    for name, data in files.items():
        (tmp_path / name).write_text(json.dumps(data))
    c = SearchClient(spark, str(tmp_path / "manifest.json"), strict=True, cache=False)
    r = c.search("red", Options(facets=("size",)))
    assert ids(r) == [0, 1] and [v.value for v in r.facets["size"].values] == ["9-10", "100+"] and r.hits[0].fields == {"title": "A", "tags": "x, y"} and r.hits[1].metadata == {"k": 1}
    assert ids(c.search('"red roof"')) == [0] and ids(c.search("crimson", Options(synonyms=True))) == [0, 1] and ids(c.search("red", Options(filters={"size": {"max": 50}}))) == [1]


def test_postings_of_fields_languages_and_long_texts(spark, monkeypatch):
    from lexispark.plans import index as ix
    from lexispark.plans import invert

    rows = [(1, "en", {"body": "The running dogs ran, dogs", "title": "Dog"}), (2, "zh", {"body": "日本語 dog the"}), (3, "xx", {"body": "the dogs"}), (4, "en", {"body": None}), (5, "en", {"body": ""}), (6, "en", None), (7, "en", {"body": "ab " * 3000 + "ＡＢ"})]
    docs = spark.createDataFrame(rows, "doc_id long, lang string, indexed map<string,string>").withColumn("boost", F.lit(None).cast("double"))
    got = {(r.lang, r.term, r.doc_id): [tuple(f) for f in r.fields] for r in invert.invert(docs, ["title", "body"], ["en", "zh", "xx"], True, True).collect()}
    assert got[("en", "dog", 1)] == [("body", 2, [1, 3], 4), ("title", 1, [0], 1)] and got[("en", "run", 1)] == [("body", 1, [0], 4)]
    assert got[("zh", "本語", 2)] == [("body", 1, [1], 3)] and got[("zh", "dog", 2)] == [("body", 1, [2], 3)] and got[("xx", "the", 3)] == [("body", 1, [0], 2)]
    assert got[("en", "ab", 7)] == [("body", 3001, list(range(3001)), 3001)] and {k[2] for k in got} == {1, 2, 3, 7}
    pieces = list(invert._pieces("x" * (invert.PIECE + 5) + " y\nz"))
    assert "".join(pieces) == "x" * (invert.PIECE + 5) + " y\nz" and len(pieces) == 2
    # every way of joining the frequency gives the same rows
    inverted = invert.invert(docs, ["title", "body"], ["en", "zh", "xx"], True, True)
    df = inverted.groupBy("lang", "term").agg(F.count(F.lit(1)).alias("df"))
    small = sorted(map(str, ix.build_postings(inverted, df).collect()))
    monkeypatch.setattr(ix, "sendable", lambda d, *a: d)
    monkeypatch.setattr(ix, "HOT_POSTINGS", 1)
    assert sorted(map(str, ix.build_postings(inverted, df).collect())) == small


def test_prefix_shards():
    entries = {f"ab{c}{d}": {"x": c * 50} for c in "abcdef" for d in "xyz"} | {"a": {}, "b": {}}
    out = shards.split_by_prefix(entries, most=60)
    assert {t for g in out.values() for t in g} == set(entries) and len(out) > 5
    assert all(t.startswith(p) for p, g in out.items() for t in g)
    assert set(shards.split_by_prefix(entries)) == {"a", "b"}


def test_validation(spark):
    two = frame(spark, [DOCS[0], DOCS[0]])
    for docs, fields, how in ((two, FIELDS, {}), (frame(spark), {"title": FieldDef(False, True)}, {}), (frame(spark), {"title": FieldDef()}, {}), (frame(spark), FIELDS, {"fuzzy": True, "max_edits": 3}), (frame(spark), FIELDS, {"buckets": {"price": [2, 1]}}), (frame(spark).withColumn("boost", F.lit(0.0)), FIELDS, {}), (frame(spark).withColumn("lang", F.lit("xx")), FIELDS, {})):
        with pytest.raises(ValueError):
            build_documents(docs, fields, **how)
    ok = build_documents(frame(spark).withColumn("lang", F.lit("fr")), FIELDS, on_unsupported_language="fallback", default_language="fr")
    assert ids(Searcher(ok).search("widget"))[0] == 3 and set(ids(Searcher(ok).search("red"))) == {1, 3}


def test_text_functions(spark):
    row = spark.range(1).select(
        text.deletes(F.lit("cat"), 1).alias("d"),
        F.size(text.deletes(F.lit("abcd"), 2)).alias("n"),
        text.hierarchy_paths(F.lit(" a > b>> c "), ">").alias("h"),
        text.excerpt(F.lit("x " * 150)).alias("e"),
        text.geo_point(F.lit("12.5, -7")).alias("g"),
        text.geo_point(F.lit("95,1")).alias("g2"),
        text.is_rtl(F.lit("AR-eg")).alias("r"),
        text.terms(F.lit("検索 engine"), profiles.PROFILES["ja"]).alias("j"),
        text.terms(F.lit("The ponies' Cafés ＡＢ"), profiles.PROFILES["en"]).alias("t"),
        text.strip_diacritics(F.lit("Ünïté")).alias("u"),
    ).collect()[0]
    assert sorted(row.d) == ["at", "ca", "cat", "ct"] and row.n == 11
    assert row.h == ["a", "a>b", "a>b>c"] and row.e == ("x " * 100).rstrip() + "…"
    assert row.g == (12.5, -7.0) and row.g2 is None and row.r
    assert row.j == ["検索", "engine"] and row.t == ["poni", "cafés", "ab"] and row.u == "Unite"


def test_detection(spark):
    cases = [("det är inte också och", "sv"), ("het een van niet zijn", "nl"), ("ikke jeg hva", "nb"), ("ikkje eg kva", "nn"), ("東京タワー", "ja"), ("東京", "zh"), ("ภาษาไทย", "th"), ("the der", None), ("", None), ("the and of", "en")]
    df = spark.createDataFrame(cases, "t string, want string")
    for r in df.select("t", "want", text.detect_language(F.col("t"), profiles.codes()).alias("got")).collect():
        assert r.got == r.want, r


def test_driver_and_cluster_analysis_agree(spark):
    samples = ["The ponies' running-shoes don't fit 12 CAFÉS", "検索エンジンx日 and", "ภาษาไทย 12", "Häuser über größe"]
    for code in ("en", "de", "ja", "th", "nl", "sv", "no"):
        p = profiles.PROFILES[code]
        df = spark.createDataFrame([(x,) for x in samples], "t string")
        got = [r[0] for r in df.select(text.terms(F.col("t"), p)).collect()]
        assert got == [[t for t, _ in analyze(x, p)] for x in samples]


def test_an_index_not_written_answers_as_a_written_one(spark):
    from lexispark.plans import index as ix

    synonyms = {"en": {"equivalences": [["gadget", "gizmo", "doodad"]], "multiWord": [["noise cancelling", "headphones cancelling"]]}}
    build = lambda: build_documents(frame(spark), FIELDS, synonyms=synonyms, fuzzy=True, hierarchical={"place": ">"}, buckets={"price": [20.0, 40.0]})
    written = build().cache()
    for q, o in (("red widget", Options(operator="or", facets=("place",))), ("tele*", Options()), ('"noise cancelling" gadgot', Options(synonyms=True, fuzzy=True, operator="or")), ("gadegt", Options(fuzzy=True)), ("best widget", Options(limit=3))):
        fresh = build()
        assert Searcher(fresh).search(q, o) == Searcher(written).search(q, o)
        assert isinstance(fresh.__dict__["postings"], ix.Later) and "inverted" not in fresh.texts.__dict__
        fresh.release()
    # facets need no postings, and from the third search of an index on all of them are written
    fresh = build()
    assert Searcher(fresh).facet_values("category").values and not fresh.texts.scratch
    s = Searcher(fresh)
    for q in ("red", "widget", "gadget"):
        assert s.search(q).total_hits == Searcher(written).search(q).total_hits
    assert "inverted" in fresh.texts.__dict__ and sorted(map(tuple, fresh.occurrences().collect())) == sorted(map(tuple, build().occurrences().collect()))
    for name in ("terms", "field_stats"):
        assert sorted(map(tuple, getattr(build(), name).collect())) == sorted(map(tuple, getattr(written, name).select(getattr(build(), name).columns).collect()))


def test_occurrences_are_written_nowhere(spark):
    index = build_documents(frame(spark), FIELDS)
    assert index.occurrences().count() > 10 and not index.texts.scratch


def test_workers_keep_few_stems_and_small_batches():
    import pyarrow as pa

    from lexispark.plans import invert

    by = invert.inverter(["body"], ["en", "de"])
    for code in ("en", "de"):
        for i in range(invert.KEPT_STEMS + 10):
            by.term(code, f"w{i}")
    assert len(by.known) <= invert.KEPT_STEMS <= 100_000
    batch = pa.RecordBatch.from_arrays([pa.array(["x" * 1000] * 5000)], names=["t"])
    parts = list(invert.cut_batches([batch], invert.BATCH_BYTES))
    assert sum(p.num_rows for p in parts) == 5000 and max(p.nbytes for p in parts) <= invert.BATCH_BYTES <= 1 << 20



def test_words_are_those_of_the_pattern():
    from lexispark.functions import analysis

    for t in ("a_b c-d ½x", "naïve: été_x ÀB²", "".join(map(chr, range(1, 3000))), ""):
        assert analysis.latin(t) == analysis._LATIN.findall(t)
