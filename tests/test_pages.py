"""Pages as a source: extraction controls, sections, directories."""

import pytest

from lexispark.operators.search import Options, Searcher
from lexispark.sources import html as h

PAGE = """<html lang="en"><head><title> A  <b>page</b></title><meta name="description" content="short  text">
<meta name="lexi-boost" content="2.5"><meta name="lexi-facet-topic" content="x"><meta name="lexi-facet-topic" content="y"><meta name="lexi-facet-topic" content="x">
<meta name="lexi-facet-range-price" content="12"><meta name="lexi-facet-range-price" content="13"><meta name="lexi-facet-geo-at" content="10, 20"><meta name="lexi-facet-geo-bad" content="100,0">
<meta name="lexi-stored-sku" content="A1"><meta name="lexi-stored-title" content="no"><meta name="lexi-meta-author" content="me">
<meta name="lexi-pin" content="best page"><meta name="lexi-pin" content=" "><meta name="lexi-pin-mode" content="contains"><meta name="lexi-pin-priority" content="3">
<link rel="canonical" href="/canon"></head>
<body><nav>menu</nav><main>Intro text<h2 id="a">Alpha</h2><p>one wid<b>get</b><h4>ignored</h4>mid<h3 id="b">Beta</h3><p>two<h2>No id</h2>lost
<h2 id="a">Again</h2>dup<h2 id="e"></h2><div data-lexi-ignore>skip</div><footer>foot</footer></main><script>var x = "<p>";</script></body></html>"""


def test_extraction_controls():
    row, tree = h.extract(PAGE, "/own")
    assert row["title"] == "A page" or row["title"] == "A <b>page</b>"
    assert row["body"] == "Intro text Alpha one wid get ignored mid Beta two No id lost Again dup"
    assert row["excerpt"] == "short text" and row["url"] == "/canon" and row["boost"] == 2.5 and not row["noindex"]
    assert row["facets"] == {"topic": ["x", "y"]} and row["range_facets"] == {"price": 12.0} and row["geo_facets"] == {"at": {"lat": 10.0, "lon": 20.0}}
    assert row["stored"] == {"sku": "A1"} and row["metadata"] == {"author": "me"} and len(row["warnings"]) == 2
    assert row["pins"] == [{"phrase": "best page", "mode": "contains", "priority": 3.0, "exclusive": False}]
    parts, intro = h.split_sections(tree, row["url"], ("h2", "h3"))
    assert intro == "Intro text"
    assert [(p["title"], p["body"], p["url"], p["level"]) for p in parts] == [("Alpha", "one wid get ignored mid", "/canon#a", 2), ("Beta", "two", "/canon#b", 3)]


def test_other_prefix_and_body_choice():
    row, _ = h.extract('<body>out<div data-zz-body>in <aside>no</aside></div><meta name="zz-noindex"></body>', "/u", controls="zz")
    assert row["body"] == "in" and row["noindex"] and row["boost"] == 1.0
    assert h.extract("just text <p>here", "/u")[0]["body"] == "just text here"


@pytest.mark.parametrize(
    "canonical, options, want",
    [
        ("", {}, "/own"), ("/x", {}, "/x"), ("//evil.com/x", {}, "/own"), ("javascript:alert(1)", {}, "/own"), ("rel", {}, "/own"),
        ("rel", {"base": "https://a.com/b/"}, "https://a.com/b/rel"), ("https://a.com/x", {}, "https://a.com/x"),
        ("https://b.com/x", {"origins": ["https://a.com"]}, "/own"), ("https://a.com:8080/x", {"origins": ["https://a.com:8080"]}, "https://a.com:8080/x"),
    ],
)
def test_canonical_urls(canonical, options, want):
    assert h.safe_url(canonical, "/own", **options) == want


def test_sections_as_documents(spark):
    pages = spark.createDataFrame([(0, "/own", PAGE), (4, "/plain", "<title>P</title><p>only text"), (5, "/no", '<meta name="lexi-noindex"><p>x')], "doc_id long, url string, html string")
    rows = {r.doc_id: r for r in h.prepare(pages, ("h2", "h3")).collect()}
    assert sorted(rows) == [0, 4, 6, 7] and rows[0].indexed["body"] == "Intro text" and rows[6].url == "/canon#a" and rows[7].indexed["pageTitle"] == rows[0].indexed["title"]
    assert rows[6].facets == {"topic": ["x", "y"]} and list(rows[6].pins or []) == [] and rows[0].pins[0].phrase == "best page"
    both = {r.doc_id: r for r in h.prepare(pages, ("h2", "h3"), "page-and-sections").collect()}
    assert sorted(both) == [0, 4, 6, 7] and both[0].indexed["body"].startswith("Intro text Alpha")
    assert sorted(r.doc_id for r in h.prepare(pages).collect()) == [0, 4]
    with pytest.raises(ValueError):
        h.prepare(pages, ("h9",))
    with pytest.raises(ValueError):
        h.prepare(pages, ("h2",), "other")


def test_directory_to_search(spark, tmp_path):
    (tmp_path / "b").mkdir()
    (tmp_path / "b" / "c.html").write_text("<title>Second</title><p>banana split")
    (tmp_path / "a.html").write_text(PAGE)
    (tmp_path / "skip.txt").write_text("banana")
    pages = h.read_directory(spark, str(tmp_path))
    assert [(r.doc_id, r.url) for r in pages.orderBy("doc_id").collect()] == [(0, "/a"), (1, "/b/c")]
    s = Searcher(h.build_pages(pages))
    assert [x.url for x in s.search("bananas").hits] == ["/b/c"]
    r = s.search("best page here", Options(operator="or", facets=("topic",)))
    assert r.hits[0].pinned and r.hits[0].fields["sku"] == "A1" and r.facets["topic"].values[0].value == "x"
    assert [x.id for x in s.search("widget", Options(filters={"sku": "A1"})).hits] == [] and [x.id for x in s.search("mid", Options(filters={"sku": "A1"})).hits] == [0]


def test_nesting_without_limit():
    from lexispark.sources import html

    deep = "<html><body>" + "<div>" * 5000 + "<h2 id=a>A</h2>text" + "</div>" * 5000 + "</body></html>"
    row, tree = html.extract(deep, "/d")
    assert row["body"] == "A text" and html.split_sections(tree, "/d", ("h2",))[0][0]["body"] == "text"


def test_running_sums_over_ranges(spark):
    from pyspark.sql import functions as F

    from lexispark.plans.scratch import running

    rows = spark.range(1000).select((F.col("id") * 7 % 1000).alias("k"), (F.col("id") % 3).alias("n"))
    got = {r.k: r.s for r in running(rows, F.col("k"), F.col("n"), "s").collect()}
    total = 0
    for k, n in sorted((i * 7 % 1000, i % 3) for i in range(1000)):
        assert got[k] == total
        total += n


def test_pages_are_handed_on_in_small_parts(spark):
    """A worker holds the rows of about a megabyte of HTML at once, not those of 10,000 pages."""
    from pyspark.sql import functions as F

    pages = spark.createDataFrame([(i, f"/{i}", f"<title>T{i}</title><p>{'x ' * 2000}{i}") for i in range(700)], "doc_id long, url string, html string").coalesce(1)
    df = h.extract_pages(pages)
    assert {(r.doc_id, r.t) for r in df.select("doc_id", F.col("page.title").alias("t")).collect()} == {(i, f"T{i}") for i in range(700)}
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "ArrowEvalPython" not in plan and h.BATCH_BYTES <= 1 << 20
