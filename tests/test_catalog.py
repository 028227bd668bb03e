"""Registered queries over whole tables, on small fixtures."""

from lexispark import catalog
from lexispark.operators.highlight import highlight


def test_build_index_takes_every_language(spark, tmp_path):
    rows = [(1, "red widgets and wires", "en"), (2, "rote Geräte", "de"), (3, "des outils rouges", "fr"), (4, "una herramienta roja", "es"), (5, "rood gereedschap", "xx"), (6, "a blue gadget", None)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["lang"]: r["count"] for r in catalog.build_index(spark, str(tmp_path)).groupBy("lang").count().collect()}
    assert set(got) == {"en", "de", "fr", "es", "xx"} and got["fr"] == 3 and got["es"] == 3 and got["xx"] == 2


TEXTS = ["The theory of the thing, OF course", "naïve: the cafés of Paris", "éof théof the_ of1 ofé Theé the", "日本 the 東京of of", None, ""]


def written(spark, path, texts):
    rows = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars int").write.parquet(f"{path}/documents.parquet")
    return str(path)


def test_every_document_is_marked(spark, tmp_path):
    got = {r["doc_id"]: r["marked"] for r in catalog.highlight_marked(spark, written(spark, tmp_path, TEXTS)).collect()}
    want = {i: t and "".join(f"[{x}]" if m else x for x, m in highlight(t, [("the", False), ("of", False)])) for i, t in enumerate(TEXTS)}
    assert got == want


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_fuzzy_terms_with_digits_and_accents(spark, tmp_path):
    terms = "tionble tionblé tïonble tionble1 tion8le 1ionbl2 tïonblé tionbles tionb tonbel xionbly tiônblès other".split()
    got = {r["term"]: r["distance"] for r in catalog.fuzzy_expand(spark, written(spark, tmp_path, [" ".join(terms), "tionble tiobnle"])).collect()}
    want = {t: d for t in [*terms, "tiobnle"] if 0 < (d := edits(t, "tionble")) <= 2}
    assert got == want and {"tionblé", "tion8le"} <= set(got)


def test_fuzzy_search_takes_the_terms_of_its_sql(spark, tmp_path):
    path = written(spark, tmp_path, ["tionble", "tionblé", "tionbles", "other", "tïonble tionble"])
    assert {r["doc_id"] for r in catalog.fuzzy_search(spark, path).collect()} == {0, 2, 4}
    assert {r["doc_id"] for r in catalog.fuzzy_search_all(spark, path).collect()} == {0, 1, 2, 4}


def test_titles_keep_references_without_a_semicolon(spark, tmp_path):
    rows = [(1, "/a", '<html lang="en"><title>A &amp;&amp;&amp</title>'), (2, "/b", '<html lang="de"><title>&lt;b&gt; &quot;x&#x27; & &ampy</title>')]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = {r["page_id"]: (r["title"], r["lang"]) for r in catalog.html_title_lang(spark, str(tmp_path)).collect()}
    assert got == {1: ("A &&&amp", "en"), 2: ("<b> \"x' & &ampy", "de")}


def test_token_rows_are_those_of_the_expressions(spark, tmp_path):
    from pyspark.sql import functions as F

    from lexispark.functions import text

    path = written(spark, tmp_path, [*TEXTS, "ΑΣ'Α ΟΔΟΣ İx", "日本語 ＡＢ ½ x_y"])
    docs = catalog.table(spark, path, "documents")
    want = docs.select("doc_id", F.explode(text.tokens(F.col("text"), catalog.PROFILE)).alias("t")).select("doc_id", "t.position", "t.term")
    df = catalog.token_positions(spark, path)
    assert sorted(map(tuple, df.collect())) == sorted(map(tuple, want.collect()))
    assert "MapInArrow" in df._jdf.queryExecution().executedPlan().toString()
