import numpy as np
import pytest

from lexispark.llm import topk


def brute(queries, vectors, k, skip_own=True):
    def usable(rows):
        best = {}
        for i, v in rows:
            if i is not None and v and all(x is not None and np.isfinite(x) for x in v):
                v = tuple(np.float32(v).tolist())
                best[i] = min(best.get(i, v), v)
        return best

    q, v = usable(queries), usable(vectors)
    out = set()
    for a, x in q.items():
        s = sorted((-topk.exact_scores(np.float32([y]), np.float64(x))[0], b) for b, y in v.items() if len(y) == len(x) and not (skip_own and a == b))
        out |= {(a, b, n + 1) for n, (_, b) in enumerate(s[:k])}
    return out


def rows_of(n, d, seed, ties=False):
    rng = np.random.default_rng(seed)
    v = rng.integers(-2, 3, (n, d)).astype(float) if ties else rng.normal(size=(n, d))
    return [(i, x.tolist()) for i, x in enumerate(v)]


def got(df):
    return {(r.query_id, r.vec_id, r.rank) for r in df.collect()}


def test_against_brute_force(spark):
    for d, ties in ((6, False), (6, True), (40, False)):
        rows = rows_of(300, d, d, ties)
        df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
        assert got(topk.top_k(df, df, k=5, shard_rows=90)) == brute(rows, rows, 5)


def depths(v, k=10, queries=20):
    """Share of the lists read for each of some queries, with results held against a full scan."""
    lists, out = topk.Lists(v.astype(np.float32)), []
    for q in v[:queries]:
        rows, scores, depth = lists.top(q, k)
        want = np.argsort(-topk.exact_scores(lists.v, q), kind="stable")[:k]
        assert rows.tolist() == want.tolist()
        out.append(depth / len(v))
    return np.array(out)


def test_how_deep_the_lists_are_read():
    """The bound stops the reading early where few dimensions carry the scores, and in
    many alike dimensions it does so only after a good part of each list."""
    rng = np.random.default_rng(0)
    skewed = rng.exponential(size=(20000, 3)) * [10, 1, 0.1]
    even = rng.normal(size=(20000, 64))
    even /= np.linalg.norm(even, axis=1, keepdims=True)
    assert depths(skewed).max() < 0.25
    deep = depths(even)
    assert deep.max() < 1 and deep.mean() > 0.02


def test_a_query_of_zeros_meets_all():
    v = np.float32([[3, 1], [1, 2], [0, 5]])
    rows, scores, depth = topk.Lists(v).top(np.zeros(2), 2)
    assert rows.tolist() == [0, 1] and scores.tolist() == [0, 0] and depth == 3


def test_odd_rows(spark):
    rows = rows_of(30, 3, 1) + [(50, [1.0, 2.0]), (51, [2.0, 1.0]), (52, None), (53, []), (None, [1.0, 1.0, 1.0]), (54, [float("nan"), 1.0, 1.0]), (55, [None, 1.0, 1.0]), (3, [9.0, 9.0, 9.0]), (56, [0.0, 0.0, 0.0]), (57, [float("inf"), 0.0, 0.0])]
    rows.append(rows[4])
    df = spark.createDataFrame([(i, v, 1.0, 7) for i, v in rows], "vec_id long, embedding array<float>, score double, rank int")
    assert got(topk.top_k(df, df, k=4)) == brute(rows, rows, 4)
    other = spark.createDataFrame([(0, [1.0, 0.0, -1.0]), (1, None)], "vec_id long, embedding array<float>")
    assert got(topk.top_k(other, df, k=100, skip_own=False)) == brute([(0, [1.0, 0.0, -1.0])], rows, 100, False)
    assert topk.top_k(df.limit(0), df).collect() == [] and topk.top_k(df, df.limit(0)).collect() == []
    named = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.5, 0.5]), ("c", [0.0, 1.0])], "name string, embedding array<float>")
    assert {(r.query_id, r.name) for r in topk.top_k(named, named, k=1, id_col="name").collect()} == {("a", "b"), ("b", "a"), ("c", "b")}
    with pytest.raises(ValueError):
        topk.top_k(df.drop("rank").withColumnRenamed("vec_id", "rank"), df, id_col="rank")
