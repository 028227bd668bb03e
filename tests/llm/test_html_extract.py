import numpy as np

from lexispark.llm import html_extract as he
from lexispark.plans import scratch


def lcs(a, b):
    t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
    return t[-1][-1]


def test_shared_is_a_longest_common_subsequence():
    rng = np.random.default_rng(0)
    for _ in range(300):
        a, b = rng.integers(0, 6, rng.integers(0, 12)).tolist(), rng.integers(0, 6, rng.integers(0, 12)).tolist()
        at = he.shared(a, b)
        assert at == sorted(set(at)) and len(at) == lcs(a, b)
        it = iter(b)
        assert all(a[i] in it for i in at)


def test_lines():
    html = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body><!-- no <p>x</p> -->
    <script>var t="</p>";</script><nav><ul><li><a href="/a>b">One</a></li><li>Two &amp; 2</li></ul></nav>
    <p>Some <b>bold</b>ness
      here<br>next</p><div title="a > b">in</div> tail &lt;p&gt; <p>open"""
    assert he.text_lines(html) == ["One", "Two & 2", "Some boldness here", "next", "in", "tail <p>", "open"]
    assert he.text_lines("") == he.text_lines(None) == []
    assert he.text_lines("plain") == ["plain"]
    assert he.text_lines("<script>never closed <p>x") == []


def test_places_and_likeness():
    assert he.url_place("http://A.example.com:80/en/5.html?x=1#top") == ("a.example.com", "/en/5")
    assert he.url_place("http://a.example.com/") == ("a.example.com", "/")
    assert he.url_place("no url") == he.url_place(None) == he.url_place("http://[bad") == (None, None)
    assert he.nearest("/a/b/3", ("/a/a", 1), ("/a/b/9", 2)) == ("/a/b/9", 2)
    assert he.nearest("/a/5", ("/a/4", 1), ("/a/6", 2)) == ("/a/4", 1)


def brute(rows):
    """Row by row, from the docstring."""
    reps = {}
    for i, u, h in rows:
        place = he.url_place(u)
        if place[0]:
            reps.setdefault(place, []).append((i is None, i or 0, h))
    out = []
    for i, u, h in rows:
        lines, gone = he.text_lines(h), set()
        host, path = he.url_place(u)
        if host:
            paths = sorted((p for x, p in reps if x == host), key=lambda p: p.encode())
            k = paths.index(path)
            near = he.nearest(path, (paths[k - 1], 0) if k else None, (paths[k + 1], 0) if k + 1 < len(paths) else None)
            if near:
                other = he.text_lines(min(reps[host, near[0]], key=lambda r: r[:2])[2])
                gone = set(he.shared(lines, other))
        out.append((i, u, "\n".join(x for n, x in enumerate(lines) if n not in gone), len(lines), len(gone)))
    return out


def site(n, hosts=3, seed=0):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        h = int(rng.integers(hosts))
        body = "".join(f"<p>text {rng.integers(10**6)}</p>" for _ in range(rng.integers(1, 5)))
        rows.append((i, f"http://h{h}.example.com/{rng.choice(['en', 'de'])}/{rng.integers(400)}", f"<nav><a>Home {h}</a></nav><p>Hello {h}</p>{body}<footer>(c) {h}</footer>"))
    return rows


def order(rows):
    return sorted((tuple(r) for r in rows), key=str)


def test_against_row_by_row(spark):
    rows = site(80)
    rows += [(None, None, "<p>lone</p>"), (90, "bad", "<p>lone</p>"), (91, "http://only.example.com/x", "<p>kept</p>"), (92, rows[0][1], None), (93, rows[0][1] + "?q=1", ""), rows[4], (None, "http://h0.example.com/zz", "<p>Hello 0</p><p>own</p>")]
    pages = spark.createDataFrame([(*r, "x", 1) for r in rows], "page_id long, url string, html string, text string, k int")
    assert order(he.extract(pages).collect()) == order(brute(rows))
    assert he.extract(pages.limit(0)).collect() == []


def test_boilerplate_goes_and_text_stays(spark):
    pages = spark.createDataFrame(site(60, 1, 3), "page_id long, url string, html string")
    for r in he.extract(pages).collect():
        assert r.n_shared == 3 and "Home" not in r.text and r.text.count("text") == r.n_lines - 3


def test_hosts_that_span_partitions(spark, monkeypatch):
    monkeypatch.setattr(scratch, "BROADCAST_BYTES", 0)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "9")
    try:
        rows = site(120, 2, 5)
        pages = spark.createDataFrame(rows, "page_id long, url string, html string")
        assert order(he.extract(pages).collect()) == order(brute(rows))
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_very_long_page(spark):
    many = "".join(f"<p>line {i % 50}</p>" for i in range(4000))
    pages = spark.createDataFrame([(1, "http://a.b/1", many + "<p>mine</p>"), (2, "http://a.b/2", "<p>line 3</p>" * 3000 + "<p>yours</p>")], "page_id long, url string, html string")
    out = {r.page_id: r for r in he.extract(pages).collect()}
    assert out[1].text.endswith("mine") and out[1].n_lines == 4001


def test_alignment_of_long_pages_with_repeated_lines(monkeypatch):
    assert he.shared(["x"] * 30_000 + ["a"], ["x"] * 30_000 + ["b"] + ["x"] * 9) == list(range(30_000))
    rng = np.random.default_rng(2)
    for cells in (1 << 28, 64):  # whole, and halved again and again
        monkeypatch.setattr(he, "_CELLS", cells)
        for _ in range(60):
            a, b = rng.integers(0, 4, rng.integers(0, 40)).tolist(), rng.integers(0, 4, rng.integers(0, 40)).tolist()
            at = he.shared(a, b)
            it = iter(b)
            assert at == sorted(set(at)) and len(at) == lcs(a, b) and all(a[i] in it for i in at)
