import numpy as np
import pyarrow as pa
import pytest

from lexispark.llm import common
from lexispark.llm import language_id as li
from lexispark.llm.common import byte_view

EN = "the house and the garden of this town are with that other one "
DE = "der garten und die stadt ist mit einem anderen haus über schöne "
FR = "la maison et le jardin de cette ville sont avec une autre qui est "


def corpus(n, seed):
    rng = np.random.default_rng(seed)
    out = []
    for i in range(n):
        words = (EN, DE, FR)[i % 3].split()
        out.append((i, " ".join(rng.choice(words, rng.integers(8, 60))), ("en", "de", "fr")[i % 3]))
    return out


@pytest.fixture(scope="module")
def net():
    rows = corpus(150, 1)
    labels = ["de", "en", "fr"]
    return li.train([t.encode() for _, t, _ in rows], [labels.index(x) for _, _, x in rows], labels, steps=120, lanes=96, span=48)


def slow_positions(net, text):
    """One byte at a time, windows of WINDOW bytes, as the module's text says."""
    x = np.frombuffer(text, np.uint8)
    H, out = net.hidden, []
    for at in range(0, len(x), li.WINDOW):
        w = x[at : at + li.WINDOW]
        sides = []
        for d, order in ((0, range(len(w))), (1, range(len(w) - 1, -1, -1))):
            h, hs = np.zeros(H), {}
            for t in order:
                e = net.tables[d][:, w[t]].astype(float)
                f = (1 + li._squash(e[:H] + net.gates[d] @ h)) / 2
                c = li._squash(e[H:] + net.states[d] @ (f * h))
                h = h + f * (c - h)
                hs[t] = h
            sides.append(hs)
        for t in range(len(w)):
            z = net.out @ np.concatenate([sides[0][t], sides[1][t]]) + net.bias[:, 0]
            p = np.exp(z - z.max())
            out.append(p / p.sum())
    return np.array(out)


def test_same_as_byte_by_byte(net):
    texts = [EN * 12, "", DE[:7], FR * 5, EN[:256], DE * 30]
    data, ends = byte_view(pa.array(texts))
    labels, pooled = li.label_bytes(net, data, ends)
    for i, t in enumerate(texts):
        if not t:
            assert not pooled[i].any()
            continue
        p = slow_positions(net, t.encode())
        assert np.allclose(pooled[i], p.mean(0), atol=1e-4)
        sure = np.sort(p, 1)[:, -1] - np.sort(p, 1)[:, -2] > 1e-3
        assert (labels[ends[i] : ends[i + 1]][sure] == p.argmax(1)[sure]).all()


def test_held_out_accuracy(net):
    rows = corpus(300, 2)
    data, ends = byte_view(pa.array([t for _, t, _ in rows]))
    labels, pooled = li.label_bytes(net, data, ends)
    truth = np.array([net.labels.index(x) for _, _, x in rows])
    assert (pooled.argmax(1) == truth).mean() > 0.97
    assert (labels == np.repeat(truth, np.diff(ends))).mean() > 0.9


def test_gradient_lowers_the_loss(net):
    rows = corpus(60, 3)
    labels = ["de", "en", "fr"]
    raw = [t.encode() for _, t, _ in rows], [labels.index(x) for _, _, x in rows]
    data, ends = byte_view(pa.array([t for _, t, _ in rows]))
    truth = np.array(raw[1])

    def loss(n):
        return -np.log(li.label_bytes(n, data, ends)[1][np.arange(len(truth)), truth]).mean()

    assert loss(li.train(*raw, labels, steps=60)) < 0.6 * loss(li.train(*raw, labels, steps=1))


def test_rows_nulls_and_clashing_columns(spark, net):
    rows = [(1, EN, "x", 0.0), (None, DE, "x", 0.0), (2, None, "x", 0.0), (3, "", None, 0.0), (1, EN, "x", 0.0), (4, FR * 3000, "x", 0.0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, confidence double")
    out = li.identify(docs, net).collect()
    assert len(out) == 6
    by = {r.doc_id: r for r in out}
    assert by[1].lang == "en" and by[None].lang == "de" and by[4].lang == "fr"
    assert by[2].lang is None and by[2].confidence == 0 and by[2].spans == [] and by[3].lang is None
    for r in out:
        assert sum(s.end - s.start for s in r.spans) == r.n_bytes
        assert all(a.end == b.start and a.lang != b.lang for a, b in zip(r.spans, r.spans[1:]))
    kept = li.keep_identified(docs, net)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id or 0 for r in kept.collect()) == [0, 1, 1, 4]
    assert li.identify(docs.limit(0), net).collect() == [] and li.keep_identified(docs.limit(0), net).collect() == []


def test_fit_skips_what_has_no_label(spark):
    rows = [(i, t, l) for i, t, l in corpus(60, 4)] + [(None, EN, "en"), (99, None, "en"), (98, EN, None), (97, "", "de")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    net = li.fit(docs, steps=3)
    assert net.labels == ["de", "en", "fr"]
    with pytest.raises(ValueError):
        li.identify(docs.drop("lang").withColumnRenamed("doc_id", "lang"), net, id_col="lang")


def test_fewer_than_two_labels(spark):
    docs = spark.createDataFrame([(1, "some text", "en"), (2, "", "en"), (3, None, None)], "doc_id long, text string, lang string")
    for some, want in ((docs, "en"), (docs.limit(0), None)):
        net = li.fit(some)
        out = {r.doc_id: r for r in li.identify(docs, net).collect()}
        assert out[1].lang == want and out[2].lang is None and sum(s.end - s.start for s in out[1].spans) == 9 * (want is not None)
        assert [r.doc_id for r in li.keep_identified(docs, net).collect()] == [1]


def test_more_labels_than_a_byte_holds():
    labels = [f"l{i:03}" for i in range(300)]
    z = np.zeros((300, 2), np.float32)
    z[299, 0] = z[256, 1] = 1
    assert li._argmax(z).tolist() == [299, 256] and li._kind(len(labels)) is np.int32


def test_small_shares_and_labels_without_a_sample(spark, monkeypatch):
    many = spark.range(100_000_000)
    assert common.sampled(many, 120, 100_000_000, "id").count() == 120
    assert common.sampled(many.limit(50), 120, 50, "id").count() == 50
    same = spark.createDataFrame([(1, "x")] * 500 + [(2, "y")], "id long, t string")
    assert common.sampled(same, 20, 501, "id", "t").count() <= 20
    docs = spark.createDataFrame([(i, "some text", "ab"[i % 2]) for i in range(8)], "doc_id long, text string, lang string")
    monkeypatch.setattr(li, "sampled", lambda df, *a, **k: df.where("l = 'a'"))
    with pytest.raises(ValueError, match="no document was sampled"):
        li.fit(docs)


def test_the_rejection_bound_follows_the_number_of_labels():
    assert np.isclose(li.least_probability(4), 0.4) and np.isclose(li.least_probability(2), 0.6)
    assert all(1 / n < li.least_probability(n) < 1 for n in range(2, 200))
