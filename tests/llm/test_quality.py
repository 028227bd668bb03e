import math
import re

import numpy as np
import pyarrow as pa
import pytest

from lexispark.llm import quality as q
from lexispark.llm.common import byte_view


def doc(i, rng):
    words = [f"w{rng.integers(400)}" for _ in range(rng.integers(20, 120))]
    if i % 3 == 0:
        return (" ".join(w.upper() + "!!" for w in words), 0) if i % 2 else (" ".join(words[:5] * 12), 0)
    return ". ".join(words), 1


def test_features_by_hand():
    texts = ["The Cat, the cat!\nthe cat", "", "a|b\na|b\n\nééé 12", None]
    x = q.features_of(*byte_view(pa.array(texts)))
    col = {n: i for i, n in enumerate(q.FEATURES)}
    assert not x[1].any() and not x[3].any()
    t = texts[0]
    assert np.isclose(x[0, col["capital_share"]], 2 / len(t))
    assert np.isclose(x[0, col["repeated_word_share"]], 4 / 6)
    assert np.isclose(x[0, col["line_words"]], 3) and x[0, col["repeated_line_share"]] == 0
    assert np.isclose(x[2, col["repeated_line_share"]], 1 / 3)
    n = len(texts[2].encode())
    assert np.isclose(x[2, col["bar_share"]], 2 / n) and np.isclose(x[2, col["digit_share"]], 2 / n)
    assert np.isclose(x[2, col["beyond_ascii_share"]], 6 / n)


def test_features_do_not_depend_on_neighbours():
    rng = np.random.default_rng(0)
    texts = [doc(i, rng)[0] for i in range(30)]
    whole = q.features_of(*byte_view(pa.array(texts)))
    single = np.concatenate([q.features_of(*byte_view(pa.array([t]))) for t in texts])
    assert np.allclose(whole, single)
    for t, row in zip(texts, single):
        words = re.findall(r"[a-z0-9]+", t.lower())
        assert np.isclose(row[q.FEATURES.index("repeated_word_share")], 1 - len(set(words)) / len(words))


def test_held_out_accuracy_and_scoring_by_tables():
    rng = np.random.default_rng(1)
    rows = [doc(i, rng) for i in range(600)]
    x = q.features_of(*byte_view(pa.array([t for t, _ in rows])))
    y = np.array([float(k) for _, k in rows])
    model = q.train(x[:400], y[:400])
    p = model.probability(x[400:])
    assert ((p >= 0.5) == y[400:]).mean() > 0.97
    z = model.base
    for j, t in enumerate(model.tables):
        z += t[np.searchsorted(model.cuts[j], x[450, j], side="right")]
    for (a, b), g in zip(model.pairs, model.grids):
        z += g[np.searchsorted(model.coarse[a], x[450, a], side="right"), np.searchsorted(model.coarse[b], x[450, b], side="right")]
    assert np.isclose(p[50], 1 / (1 + np.exp(-z)))


def test_pairs_learn_what_single_features_cannot():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(3000, 3))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0)).astype(float)
    single = q.train(x[:2000], y[:2000], pairs=0)
    both = q.train(x[:2000], y[:2000], pairs=1)
    assert both.pairs == [(0, 1)]
    assert ((single.probability(x[2000:]) > 0.5) == y[2000:]).mean() < 0.65
    assert ((both.probability(x[2000:]) > 0.5) == y[2000:]).mean() > 0.9


def test_rows_nulls_and_clashing_columns(spark):
    rng = np.random.default_rng(3)
    rows = [(i, *doc(i, rng)) for i in range(120)]
    docs = spark.createDataFrame([(i, t, 0.0, True) for i, t, _ in rows], "doc_id long, text string, score double, keep boolean")
    extra = spark.createDataFrame([(None, "x y", 0.0, True), (500, None, 0.0, True), (501, "", 0.0, True), (1, rows[1][1], 0.0, True), (502, "long word " * 30000, 0.0, True)], docs.schema)
    labels = spark.createDataFrame([(i, k, "t") for i, _, k in rows] + [(None, 1, "t"), (5, None, "t"), (501, 7, "t")], "doc_id long, quality int, text string")
    model = q.fit(docs, labels)
    out = q.classify(docs.unionAll(extra), model).collect()
    assert len(out) == 125
    by = {r.doc_id: r for r in out}
    assert by[500].score is None and not by[500].keep and by[501].score is not None and by[None].score is not None
    kept = q.keep_good(docs.unionAll(extra), model)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id or -1 for r in kept.collect()) == sorted(r.doc_id or -1 for r in out if r.keep)
    assert q.classify(docs.limit(0), model).collect() == []
    for none in (q.fit(docs.limit(0), labels), q.fit(docs, labels.limit(0))):
        assert {r.score for r in q.classify(docs, none).collect()} == {0.5}
    assert len(q.fit(docs, labels, most=20).tables) == len(q.FEATURES)
    with pytest.raises(ValueError):
        q.classify(docs.drop("score").withColumnRenamed("doc_id", "score"), model, id_col="score")


def by_hand(text):
    """The features of one text, from their names."""
    raw = text.encode()
    w = re.findall(rb"[A-Za-z0-9\x80-\xff]+", raw)
    low = [re.sub(rb"[A-Z]", lambda m: m[0].lower(), x) for x in w]
    lines = [tuple(re.findall(rb"[a-z0-9\x80-\xff]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), x))) for x in raw.split(b"\n")]
    lines = [x for x in lines if x]
    runs = list(zip(low, low[1:], low[2:]))
    kind = lambda cls: sum(b in cls for b in raw)
    space, n, nw, nl = kind(b"\t\n\x0b\x0c\r "), max(len(raw), 1), max(len(w), 1), max(len(lines), 1)
    plain = set(b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789\t\n\x0b\x0c\r .,;:?'\"-()|")
    again = lambda xs: len(xs) - len(set(xs))
    return [
        math.log1p(len(raw)), (len(raw) - space) / nw, kind(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ") / n, kind(b"0123456789") / n,
        sum(len(x) <= 3 for x in w) / nw, sum(b < 128 and b not in plain for b in raw) / n, kind(b"|") / n, sum(b >= 128 for b in raw) / n,
        len(w) / nl, again(low) / nw, again(lines) / nl, again(runs) / nw,
    ]


def test_query_against_brute_force(spark, tmp_path):
    """The registered query: features by hand, tables looked up one by one."""
    from lexispark.llm import registry

    rng = np.random.default_rng(5)
    rows = [(i, *doc(i, rng)) for i in range(150)] + [(200, "", 1), (201, "Ünder | the\nThe the\nthe THE the the !!", 0)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, k) for i, _, k in rows], "doc_id long, quality int")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    model = q.fit(docs, labels)
    for r in registry.op9_quality(spark, str(tmp_path)).collect():
        x = by_hand(dict((i, t) for i, t, _ in rows)[r.doc_id])
        z = model.base + sum(t[sum(c <= v for c in cut)] for t, cut, v in zip(model.tables, model.cuts, x))
        for (a, b), grid in zip(model.pairs, model.grids):
            z += grid[sum(c <= x[a] for c in model.coarse[a])][sum(c <= x[b] for c in model.coarse[b])]
        assert math.isclose(r.score, 1 / (1 + math.exp(-z)), rel_tol=1e-6) and r.keep == (r.score >= 0.5)
