import itertools

import numpy as np
import pytest

from lexispark.llm import packing as pk


def least_bins(sizes, capacity):
    """The optimum, by trying all: only for a few items."""
    best = len(sizes)

    def go(i, fill):
        nonlocal best
        if len(fill) >= best:
            return
        if i == len(sizes):
            best = len(fill)
            return
        for b in sorted(set(range(len(fill))), key=lambda b: fill[b]):
            if fill[b] + sizes[i] <= capacity:
                fill[b] += sizes[i]
                go(i + 1, fill)
                fill[b] -= sizes[i]
        go(i + 1, fill + [sizes[i]])

    go(0, [])
    return best


def test_best_fit_against_the_plain_rule():
    rng = np.random.default_rng(0)
    for _ in range(50):
        sizes = rng.integers(1, 50, 40)
        assign, fill = np.zeros(40, np.int32), []
        pk.best_fit(sizes, np.arange(40), assign, fill, 50)
        room = []
        for s, b in zip(sizes, assign):
            fits = [r for r in room if r >= s]
            if fits:
                assert room[b] == min(fits)
                room[b] -= s
            else:
                assert b == len(room)
                room.append(50 - s)
        assert [50 - r for r in room] == fill


def test_children_are_packings_and_hold_whole_bins():
    rng = np.random.default_rng(1)
    sizes = rng.integers(1, 60, 80)
    a, b = pk.start(sizes, 2, 100, rng)
    bins = lambda p: {tuple(np.flatnonzero(p == k)) for k in range(p.max() + 1)}
    for _ in range(20):
        child = pk.cross(sizes, a, b, 100, rng)
        assert np.bincount(child, sizes).max() <= 100 and len(child) == 80 and child.min() == 0
        assert bins(child) & bins(b)


@pytest.mark.parametrize("seed", range(4))
def test_near_the_optimum(seed):
    rng = np.random.default_rng(seed)
    sizes = rng.integers(15, 60, 12)
    pool = pk.evolve(sizes, pk.start(sizes, 6, 100, rng), 100, 150, rng)
    assert pool[0].max() + 1 <= least_bins(sizes.tolist(), 100)
    assert pk.fitness(sizes, pool[0], 100) >= max(pk.fitness(sizes, p, 100) for p in pool)


def test_nothing_is_lost(spark):
    rng = np.random.default_rng(2)
    rows = [(i, "w " * int(rng.integers(1, 90)), "x", 1) for i in range(150)]
    rows += [(200, None, "x", 1), (201, "", "x", 1), (202, "w " * 1000, "x", 1), (203, "w " * 100, "x", 1), (None, "w w", "x", 1), (None, "w w", "x", 1), rows[0], (204, "w " * 200, None, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, bin_id string, piece int")
    out = pk.pack(docs, capacity=100, shard_items=40).collect()
    fill, tokens = {}, {}
    for r in out:
        tokens[r.doc_id] = tokens.get(r.doc_id, 0) + r.n_tokens
        assert r.start == r.piece * 100
        if r.bin_id is None:
            assert r.n_tokens == 0
        else:
            assert r.n_tokens > 0
            fill[r.bin_id] = fill.get(r.bin_id, 0) + r.n_tokens
    want = {}
    for i, t, *_ in rows:
        want[i] = want.get(i, 0) + len((t or "").split())
    assert tokens == want and max(fill.values()) <= 100
    assert sorted(r.piece for r in out if r.doc_id == 202) == list(range(10))
    assert [r.bin_id for r in out if r.doc_id in (200, 201)] == [None, None]
    total = sum(want.values())
    assert len(fill) <= total / 100 * 1.12 + 4
    again = pk.pack(docs.orderBy("text"), capacity=100, shard_items=40).collect()
    key = lambda r: tuple(-1 if x is None else x for x in r)
    assert sorted(map(key, out)) == sorted(map(key, again))
    assert pk.pack(docs.limit(0)).collect() == []


def test_own_length_column(spark):
    from pyspark.sql import functions as F

    docs = spark.createDataFrame([(1, "a", 5), (2, "b", None), (3, "c", 6)], "doc_id long, text string, n int")
    out = {r.doc_id: r for r in pk.pack(docs, capacity=11, length=F.col("n")).collect()}
    assert out[1].bin_id == out[3].bin_id and out[2].bin_id is None


def test_guests_keep_a_packing_valid():
    rng = np.random.default_rng(3)
    sizes = rng.integers(1, 90, 60)
    pools = [pk.start(sizes, 3, 100, np.random.default_rng(k)) for k in range(3)]
    best = [pk.evolve(sizes, p, 100, 20, rng)[0] for p in pools]
    for mine, guest in itertools.permutations(best, 2):
        out = pk.evolve(sizes, [mine, guest], 100, 20, rng)[0]
        assert pk.fitness(sizes, out, 100) >= max(pk.fitness(sizes, mine, 100), pk.fitness(sizes, guest, 100))


@pytest.mark.parametrize("seed", range(4))
def test_evolution_needs_fewer_bins_than_best_fit_decreasing(seed):
    """Triplets that fill a bin exactly: falling size puts two large ones together."""
    rng = np.random.default_rng(seed)
    sizes = []
    for _ in range(30):
        x = int(rng.integers(380, 491))
        y = int(rng.integers(250, (1000 - x) // 2 + 1))
        sizes += [x, y, 1000 - x - y]
    sizes = np.array(sizes)
    plain = pk.start(sizes, 1, 1000, rng)[0]
    best = pk.evolve(sizes, pk.start(sizes, 8, 1000, rng), 1000, 400, rng)[0]
    assert best.max() < plain.max()


def test_pack_against_enumeration(spark):
    from pyspark.sql import functions as F

    rng = np.random.default_rng(4)
    sizes = rng.integers(15, 60, 12).tolist()
    docs = spark.createDataFrame(list(enumerate(sizes)), "doc_id long, n int")
    out = pk.pack(docs.withColumn("text", F.lit("")), capacity=100, generations=60, length=F.col("n")).collect()
    assert len({r.bin_id for r in out}) == least_bins(sizes, 100)


def test_token_counts_as_length(spark):
    from pyspark.sql import functions as F

    from lexispark.llm import bpe

    docs = spark.createDataFrame([(i, f"some words {i} " * (i + 1)) for i in range(30)], "doc_id long, text string")
    counted = bpe.encode(docs).select("doc_id", "n_tokens", F.lit("").alias("text"))
    out = pk.pack(counted, capacity=200, length=F.col("n_tokens")).collect()
    want = {r.doc_id: r.n_tokens for r in counted.collect()}
    got = {}
    for r in out:
        got[r.doc_id] = got.get(r.doc_id, 0) + r.n_tokens
    assert got == want


def test_many_rows_alike_are_dealt_among_all_shards(spark):
    docs = spark.createDataFrame([(None, "w w w")] * 2500, "doc_id long, text string")
    out = pk.pack(docs, capacity=30, shard_items=250, generations=1, epochs=1).collect()
    shards = {}
    for r in out:
        shards[r.bin_id >> 24] = shards.get(r.bin_id >> 24, 0) + 1
    assert len(out) == 2500 and len(shards) == 10 and max(shards.values()) < 400
