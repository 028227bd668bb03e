from collections import Counter

import numpy as np
import pyarrow as pa

from lexispark.llm import lm_scoring as lm
from lexispark.llm.common import byte_view

TEXTS = ["the cat sat on the mat. " * 9, "abracadabra " * 20, "x", "", "ünïcödé text, ünïcödé text " * 5, "the dog sat on the log. " * 7]


def plain_counts(texts, depth):
    out = Counter()
    for t in texts:
        b = b"\0" * depth + (t or "").encode()
        for i in range(depth, len(b)):
            out[b[i - depth : i + 1]] += 1
    return out


def plain_tree(texts, depth, least, divergence, smooth):
    """Contexts and distributions by the definition, with dictionaries."""
    grams = plain_counts(texts, depth)
    total = sum(grams.values())
    follow = {}
    for g, n in grams.items():
        for k in range(depth + 1):
            follow.setdefault(g[depth - k : depth], Counter())[g[-1]] += n
    seen = sorted({s for s in follow.get(b"", ())} | {0})
    base = {s: 0.5 + follow.get(b"", Counter())[s] for s in seen}
    other = 0.5
    z = sum(base.values()) + other
    tree = {b"": {**{s: v / z for s, v in base.items()}, None: other / z}}
    for c in sorted(follow, key=len):
        n = sum(follow[c].values())
        if not c or n < least * total:
            continue
        s = c[1:]
        while s not in tree:
            s = s[1:]
        p = tree[s]
        if sum(k / n * np.log(k / n / p[x]) for x, k in follow[c].items()) >= divergence:
            tree[c] = {x: (follow[c][x] + smooth * q) / (n + smooth) for x, q in p.items()}
    return tree


def plain_score(tree, text, depth):
    b = b"\0" * depth + text.encode()
    out = 0.0
    for i in range(depth, len(b)):
        c = b[i - depth : i]
        while c not in tree:
            c = c[1:]
        out += np.log(tree[c].get(b[i], tree[c][None]))
    return out


def test_grams_do_not_cross_texts():
    data, ends = byte_view(pa.array(TEXTS))
    codes = lm.grams(data, ends, 5)
    assert Counter(int(c).to_bytes(6, "big") for c in codes) == plain_counts(TEXTS, 5)


def test_tree_and_scores_against_the_definition(spark, monkeypatch):
    monkeypatch.setattr(lm, "_WINDOW", 16)
    rows = [(i, t, 0.0) for i, t in enumerate(TEXTS)] + [(None, "the cat", 1.0), (70, None, 1.0), (0, TEXTS[0], 0.0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, log_prob double")
    tree = lm.fit(docs, least=0.002, long=0)
    texts = [t for _, t, _ in rows if t]
    want = plain_tree(texts, 5, 0.002, lm.DIVERGENCE, lm.SMOOTH)
    assert set(tree.contexts) == set(want) and len(want) > 20
    out = lm.score(docs, tree).collect()
    assert len(out) == len(rows)
    for r in out:
        text = next((t for i, t, _ in rows if i == r.doc_id), None)
        if text is None:
            assert r.log_prob is None and r.n_bytes is None and r.bits_per_byte is None
        elif not text:
            assert r.log_prob == 0 and r.n_bytes == 0 and r.bits_per_byte is None
        else:
            assert np.isclose(r.log_prob, plain_score(want, text, 5), rtol=1e-4)
            assert np.isclose(r.bits_per_byte, -r.log_prob / np.log(2) / r.n_bytes)


def test_probabilities_sum_to_one_and_unseen_bytes_have_some():
    rows = [(0, 0, [97, 98], [5, 5]), (1, 97, [98], [5])]
    tree = lm.grow(rows, 5)
    assert np.allclose(np.exp(tree.log_p).sum(1), 1)
    data, ends = byte_view(pa.array(["zzz", "abab"]))
    s = tree.score(data, ends)
    assert np.isfinite(s).all() and s[1] / 4 > s[0] / 3


def test_ordinary_text_scores_better_than_noise(spark):
    rng = np.random.default_rng(0)
    rows = [(i, " ".join(rng.choice("the cat sat on a mat with one hat".split(), 60))) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    tree = lm.fit(docs)
    noise = "".join(rng.permutation(list(rows[0][1])))
    data, ends = byte_view(pa.array([rows[0][1], noise]))
    good, bad = tree.score(data, ends)[0] / np.diff(ends)
    assert good > bad + 1


def test_long_texts_and_tables_without_text(spark, monkeypatch):
    monkeypatch.setattr(lm, "_HELD", 10)
    long = spark.createDataFrame([(1, "all work and no play " * 8000)], "doc_id long, text string")
    tree = lm.fit(long)
    assert lm.score(long, tree).collect()[0].bits_per_byte < 1
    none = spark.createDataFrame([(1, None)], "doc_id long, text string")
    tree = lm.fit(none)
    assert tree.contexts == [b""] and lm.score(none.limit(0), tree).collect() == []


def test_more_text_keeps_what_was_retained_and_adds_contexts(spark, monkeypatch):
    monkeypatch.setattr(lm, "_SHARD", 5000)
    rare = [(i, "zyx qwv zyx jkq qwv. " * 2) for i in range(4)]
    rng = np.random.default_rng(1)
    words = ["".join(rng.choice(list("abcdefghij"), 5)) for _ in range(3000)]
    common = [(100 + i, " ".join(rng.choice(words, 3000))) for i in range(60)]
    sizes, scores = [], []
    for n in (6, 60):
        docs = spark.createDataFrame(rare + common[:n], "doc_id long, text string")
        tree = lm.fit(docs, depth=7)
        assert tree.shards > 1 and sum(tree.retained) == len(tree.contexts)
        assert b"x qwv" in tree.contexts  # in 8 places, whatever else there is
        sizes.append(sum(tree.retained))
        scores.append(lm.score(docs, tree).where("doc_id = 0").collect()[0].bits_per_byte)
    assert sizes[1] > 1.2 * sizes[0]
    assert abs(scores[1] - scores[0]) < 0.1


def test_shards_and_depth_seven_against_the_definition(spark, monkeypatch):
    monkeypatch.setattr(lm, "_SHARD", 20)
    monkeypatch.setattr(lm, "_SLICE", 64)
    texts = TEXTS + ["\xff\x00é" * 9, "unseen elsewhere: 0123456789 ~"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    tree = lm.fit(docs, depth=7, least=2, long=0)
    total = sum(plain_counts(texts, 7).values())
    want = plain_tree(texts, 7, 2 / total, lm.DIVERGENCE, lm.SMOOTH)
    assert tree.shards > 5 and set(tree.contexts) == set(want) and len(tree.contexts) == len(want)
    for r in lm.score(docs, tree).collect():
        if texts[r.doc_id]:
            assert np.isclose(r.log_prob, plain_score(want, texts[r.doc_id], 7), rtol=1e-4)


def test_long_contexts_against_the_definition(spark, monkeypatch):
    """Short scores by a tree without long contexts; the long ones from dictionaries."""
    monkeypatch.setattr(lm, "_LONG_SHARD", 40)
    monkeypatch.setattr(lm, "_SLICE", 100)
    rng = np.random.default_rng(7)
    texts = ["".join(rng.choice(list("abcdefgh "), 400)) for _ in range(12)]
    texts += [texts[0], texts[1][:200] + "~" * 30, "short", "", "x" * 21]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    plain, tree = lm.fit(docs, long=0), lm.fit(docs, anchor=3)
    assert tree.long_shards > 3 and len(tree.long_files) > 1
    where, follow = {}, {}
    for i, t in enumerate(texts):
        b = t.encode()
        data, ends = byte_view(pa.array([t]))
        codes = lm.grams(data, ends, 5)
        q = plain.log_p(codes)
        anchored = [p for p in range(20, len(b)) if int(lm.mix(codes[p : p + 1] >> np.uint64(8))[0]) % 3 == 0]
        where[i] = b, q, anchored
        for p in anchored:
            follow.setdefault(b[p - 20 : p], {}).setdefault(b[p], []).append(q[p])
    kept = {}
    for c, nexts in follow.items():
        n = sum(map(len, nexts.values()))
        if n >= 2 and sum(len(x) / n * (np.log(len(x) / n) - x[0]) for x in nexts.values()) >= lm.DIVERGENCE:
            kept[c] = n, nexts
    for r in lm.score(docs, tree).collect():
        b, q, anchored = where[r.doc_id]
        total, known = q.sum(), 0
        for p in anchored:
            if b[p - 20 : p] in kept:
                n, nexts = kept[b[p - 20 : p]]
                total += np.log((len(nexts.get(b[p], ())) + lm.SMOOTH * np.exp(q[p])) / (n + lm.SMOOTH)) - q[p]
                known += 1
        assert np.isclose(r.log_prob, total, rtol=1e-4, atol=1e-4)
        assert r.known_share == (known / len(anchored) if anchored else None)
        if r.doc_id in (0, 12):
            assert r.known_share == 1
        if 2 <= r.doc_id < 12:
            assert r.known_share == 0


def test_every_position_may_have_a_long_context(spark):
    rng = np.random.default_rng(2)
    passage = "".join(rng.choice(list("abcdefgh "), 21))
    noise = ["".join(rng.choice(list("abcdefgh "), 60)) for _ in range(2)]
    docs = spark.createDataFrame([(i, n + passage) for i, n in enumerate(noise)], "doc_id long, text string")
    # of the 61 positions with 20 bytes before them the last alone follows a context that repeats
    assert [r.known_share for r in lm.score(docs, lm.fit(docs)).collect()] == [1 / 61] * 2


def test_rounds_move_a_share_at_a_time(spark, monkeypatch):
    """The result of one round and of several; a round moves its own positions alone."""
    rng = np.random.default_rng(8)
    texts = ["".join(rng.choice(list("abcdefgh "), 500)) for _ in range(20)]
    texts += texts[:5] + [texts[6][:300] + "~" * 90, "é" * 12, "", "short"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = sorted(map(tuple, lm.score(docs, lm.fit(docs)).collect()), key=lambda r: r[0])
    assert want[26][4] is not None  # 24 bytes, though 12 characters
    monkeypatch.setattr(lm, "_ROUND", 1000)
    monkeypatch.setattr(lm, "_ROUNDS", 7)
    monkeypatch.setattr(lm, "_LONG_SHARD", 300)
    tree = lm.fit(docs)
    assert tree.long_rounds == 7 and len(tree.long_files) > 14
    got = sorted(map(tuple, lm.score(docs, tree).collect()), key=lambda r: r[0])
    for x, y in zip(got, want, strict=True):
        assert x[:2] == y[:2] and x[4] == y[4] and (x[2] is None or np.isclose(x[2], y[2], rtol=1e-6))
    data, ends = byte_view(pa.array(texts))
    shares = [len(lm.anchors(data, ends, None, 20, 1, 7, i)[0]) for i in range(7)]
    assert sum(shares) == len(lm.anchors(data, ends, None, 20, 1)[0]) == sum(max(0, len(t.encode()) - 20) for t in texts)
    assert max(shares) < 0.3 * sum(shares)


def test_spans_hold_each_position_once_and_move_little():
    """What is counted travels as text: a share of the 12 bytes that each position took."""
    rng = np.random.default_rng(5)
    words = ["".join(rng.choice(list("abcdefghij"), 6)) for _ in range(400)]
    texts = [" ".join(rng.choice(words, 300)) for _ in range(30)] + ["short", "", "é" * 30, "x" * 5000, "exactly twenty bytes"]
    data, ends = byte_view(pa.array(texts))
    at, keys, where = lm.anchors(data, ends, None, 20, 1)
    context = {p: bytes(data[p - 20 : p]) for p in at}
    assert len(at) == sum(max(0, len(t.encode()) - 20) for t in texts)
    place = {}
    assert all(place.setdefault(context[p], w) == w for p, w in zip(at, where))  # a context lies in one shard
    assert len({(context[p], data[p]) for p in at}) == len(set(keys.tolist()))
    met, moved = [], 0
    for turn in range(3):
        start, length, of = lm.spans(data, ends, 20, 3, turn)
        moved += length.sum()
        met += [(p, w) for s, n, w in zip(start, length, of) for p in range(s + 20, s + n)]
    assert sorted(met) == list(zip(at, where))
    assert moved < 6 * len(at) and lm._ROUNDS <= 3


def test_a_large_shard_is_sorted_in_parts(spark, monkeypatch):
    rng = np.random.default_rng(9)
    texts = ["".join(rng.choice(list("abcdefgh "), 700)) for _ in range(12)]
    docs = spark.createDataFrame(list(enumerate([*texts, *texts[:4], "ab" * 900])), "doc_id long, text string")
    want = sorted(map(tuple, lm.score(docs, lm.fit(docs)).collect()))
    monkeypatch.setattr(lm, "_PART", 900)
    monkeypatch.setattr(lm, "_DEALT", 2000)
    tree = lm.fit(docs)
    assert tree.long_shards == 1
    assert sorted(map(tuple, lm.score(docs, tree).collect())) == want and sum(r[4] == 1 for r in want) == 8


def test_log_probabilities_of_grams_that_the_corpus_lacks(spark):
    docs = spark.createDataFrame([(0, "the cat sat on the mat. " * 30), (1, "abracadabra " * 30)], "doc_id long, text string")
    tree = lm.fit(docs, depth=6, long=0)
    texts = [t for _, t in docs.collect()]
    grams = plain_counts(texts, 6)
    want = plain_tree(texts, 6, lm.COUNT / sum(grams.values()), lm.DIVERGENCE, lm.SMOOTH)
    for text in ("the dog sat", "cabra the cab", "~~ the mat ~", "on the bat. abracad"):
        data, ends = byte_view(pa.array([text]))
        assert np.isclose(tree.score(data, ends)[0][0], plain_score(want, text, 6), rtol=1e-4)
