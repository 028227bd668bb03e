import itertools

import numpy as np
import pytest

from lexispark.llm import embed_dedup as ed


def brute(rows, threshold=ed.THRESHOLD):
    """Of every id (class, links), and the linked pairs of different vectors."""
    vectors = {}
    for i, v in rows:
        if i is not None:
            ok = v and not any(x is None or np.isnan(x) or np.isinf(x) for x in v) and any(v)
            vectors.setdefault(i, set()).add(tuple(np.float32(v).tolist()) if ok else None)
    holders = {}
    for i, own in vectors.items():
        for v in own - {None}:
            holders.setdefault(v, set()).add(i)
    linked, pairs = {v: {v} for v in holders}, set()
    unit = {v: np.array(v) / np.linalg.norm(np.array(v)) for v in holders}
    for x, y in itertools.combinations(holders, 2):
        if len(x) == len(y) and unit[x] @ unit[y] >= threshold:
            linked[x].add(y)
            linked[y].add(x)
            pairs.add((x, y))
    name = {}
    for v in holders:
        if v not in name:
            seen, todo = {v}, [v]
            while todo:
                for y in linked[todo.pop()] - seen:
                    seen.add(y)
                    todo.append(y)
            name |= dict.fromkeys(seen, min(min(holders[y]) for y in seen))
    out = {}
    for i, own in vectors.items():
        rows_ = [(name[v], sum(len(holders[y]) for y in linked[v]) - 1) if v else (i, 0) for v in own]
        out[i] = min(c for c, _ in rows_), sum(n for _, n in rows_)
    return out, pairs


def clouds(n, d, seed, noise):
    rng = np.random.default_rng(seed)
    rows = []
    while len(rows) < n:
        c = rng.normal(size=d)
        for _ in range(int(rng.integers(1, 8))):
            rows.append((len(rows), (c + noise * rng.normal(size=d)).astype(np.float32).tolist()))
    return rows


def found(df, **how):
    return {r.vec_id: (r.class_id, r.n_links) for r in ed.near_classes(df, **how).collect()}


def test_recall_against_brute_force(spark):
    rows = clouds(900, 32, 0, 0.2)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got, (want, pairs) = found(df), brute(rows)
    assert set(got) == set(want) and len(pairs) > 500
    assert all(n <= want[i][1] for i, (_, n) in got.items())
    assert sum(n for _, n in got.values()) >= 0.95 * sum(n for _, n in want.values())
    assert np.mean([got[i] == want[i] for i in want]) >= 0.95
    # long lists in parts give the same
    assert found(df, block=20) == got


def test_odd_rows(spark):
    base = clouds(60, 8, 1, 0.01)
    rows = base + [(100, base[0][1]), (101, [0.0] * 8), (102, []), (103, None), (None, base[0][1]), (104, [float("nan")] * 8), (105, [1.0, None]), base[3], (5, base[9][1]), (106, [1.0, 2.0]), (107, [1.0, 2.001]), (108, [float("inf")] * 8), (109, [2.0 * x for x in base[0][1]])]
    df = spark.createDataFrame([(i, v, 1, 2, 3) for i, v in rows], "vec_id long, embedding array<float>, id int, s int, pivot int")
    got, want = found(df), brute(rows)[0]
    assert got == want
    assert got[100][0] == got[109][0] == got[0][0] and got[107] == (106, 1) and got[101] == (101, 0)
    assert ed.near_classes(df.limit(0)).collect() == []
    with pytest.raises(ValueError):
        ed.near_classes(df.withColumnRenamed("vec_id", "n_links"), id_col="n_links")


def test_many_equal_vectors_are_one_node(spark):
    rows = [(i, [1.0, 0.0, 0.0]) for i in range(300)] + [(400, [1.0, 0.01, 0.0]), (401, [0.0, 0.0, 1.0])]
    got = found(spark.createDataFrame(rows, "vec_id long, embedding array<float>"))
    assert got == {i: (0, 300) for i in [*range(300), 400]} | {401: (401, 0)}


def test_ties_among_pivots_are_broken_by_order():
    v = ed.unit([[1, 0], [0, 1]])
    pivots = ed.unit([[1, 0], [1, 0], [0, 1]])
    assert ed.describe(v, pivots, 3).tolist() == [[0, 1, 2], [2, 0, 1]]
