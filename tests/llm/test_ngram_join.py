import itertools
import re
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lexispark.llm import common
from lexispark.llm import ngram_join as nj
from lexispark.llm.common import byte_view
from lexispark.plans import scratch


def grams(text, n=2):
    w = re.findall(r"[a-z0-9\x80-\U0010ffff]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} or ({tuple(w)} if w else set())


def brute(rows, threshold=nj.THRESHOLD):
    """(pairs, classes) by the docstrings: pairs of different sets stand behind their
    least ids; every id has (class, links)."""
    texts = {}
    for i, t in rows:
        if i is not None:
            texts.setdefault(i, set()).add(frozenset(grams(t or "")))
    holders = {}
    for i, sets in texts.items():
        for s in sets:
            if s:
                holders.setdefault(s, set()).add(i)
    pairs, linked = {}, {s: {s} for s in holders}
    for x, y in itertools.combinations(holders, 2):
        j = len(x & y) / len(x | y)
        if j >= threshold:
            linked[x].add(y)
            linked[y].add(x)
            a, b = sorted((min(holders[x]), min(holders[y])))
            if a != b:
                pairs[a, b] = max(j, pairs.get((a, b), 0))
    name = {}
    for s in holders:
        if s not in name:
            seen, todo = {s}, [s]
            while todo:
                for y in linked[todo.pop()] - seen:
                    seen.add(y)
                    todo.append(y)
            least = min(min(holders[y]) for y in seen)
            name |= dict.fromkeys(seen, least)
    classes = {}
    for i, sets in texts.items():
        own = [(name[s], sum(len(holders[y]) for y in linked[s]) - 1) for s in sets if s] + [(i, 0) for s in sets if not s]
        classes[i] = min(c for c, _ in own), sum(n for _, n in own)
    return pairs, classes


def as_dict(df):
    return {r.doc_id: (r.class_id, r.n_links) for r in df.collect()}


def corpus(seed=0, groups=40, start=0):
    rng = np.random.default_rng(seed)
    rows, i = [], start
    for g in range(groups):
        base = [f"w{rng.integers(3000)}" for _ in range(int(rng.integers(5, 400)))]
        for _ in range(int(rng.integers(1, 6))):
            words = [f"x{rng.integers(3000)}" if rng.random() < rng.choice([0, 0.02, 0.06]) else w for w in base]
            rows.append((i, " ".join(words)))
            i += 1
    return rows


def test_grams_match_the_plain_ones():
    texts = ["The cat, the CAT sat", "", "one", "--", "Ünder ünder a_b", None, "a b a b a b"]
    g, first = nj.gram_sets(*byte_view(pa.array(texts)))
    assert np.diff(first).tolist() == [len(grams(t or "")) for t in texts]
    single = [nj.gram_sets(*byte_view(pa.array([t], pa.string())))[0].tolist() for t in texts]
    assert [g[a:b].tolist() for a, b in zip(first, first[1:])] == single


def test_sketch_distance_never_exceeds_the_difference():
    rows = corpus(3, 10)
    data, ends = byte_view(pa.array([t for _, t in rows]))
    wide = nj.sketch(data, ends, 2, 0.7, 7, 40)[2]
    sets = [grams(t) for _, t in rows]
    for a, b in itertools.combinations(range(len(rows)), 2):
        assert sum(int(x).bit_count() for x in wide[a] ^ wide[b]) <= len(sets[a] ^ sets[b])


def odd_rows():
    rows = corpus()
    return rows + [(900, rows[3][1]), (901, rows[3][1].upper()), (None, rows[3][1]), (902, None), (903, ""), (904, "--"), (905, "hi"), (906, "Hi!"), rows[5], (907, "long tail " * 20000 + "end")]


def test_pairs_against_brute_force(spark):
    rows = odd_rows()
    docs = spark.createDataFrame([(i, t, 1, 2) for i, t in rows], "doc_id long, text string, size int, id int")
    got = {(r.id_a, r.id_b): r.jaccard for r in nj.jaccard_pairs(docs).collect()}
    want = brute(rows)[0]
    assert set(got) <= set(want) and all(np.isclose(want[k], j) for k, j in got.items())
    assert len(got) >= 0.97 * len(want)
    assert all(k in got for k, j in want.items() if j >= 0.85)


def test_classes_against_brute_force(spark, monkeypatch):
    rows = odd_rows()
    docs = spark.createDataFrame([(i, t, 1, 2, 3, 4) for i, t in rows], "doc_id long, text string, s int, id int, rep int, root int")
    want = brute(rows)[1]
    got = as_dict(nj.jaccard_classes(docs))
    assert got == want and any(n > 3 for _, n in got.values())
    monkeypatch.setattr(common, "HOT", 2)
    monkeypatch.setattr(nj, "HOT_SAMPLED", 1)
    assert as_dict(nj.jaccard_classes(docs)) == want


def test_one_id_with_two_texts(spark):
    base = " ".join(f"w{i}" for i in range(100))
    rows = [(1, base), (1, "other words here"), (2, base + " end"), (3, "other words here"), (4, base), (4, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {(r.id_a, r.id_b) for r in nj.jaccard_pairs(docs).collect()} == {(1, 2)}
    assert as_dict(nj.jaccard_classes(docs)) == brute(rows)[1]


def test_ids_of_text_and_clashing_names(spark):
    rows = [("b", "some words of a text"), ("a", "some words of a text"), ("c", "others")]
    docs = spark.createDataFrame([(i, t, "x", "y") for i, t in rows], "key string, text string, n string, m string")
    assert {r.key: r.class_id for r in nj.jaccard_classes(docs, id_col="key").collect()} == {"a": "a", "b": "a", "c": "c"}
    with pytest.raises(ValueError):
        nj.jaccard_classes(docs.withColumnRenamed("key", "class_id"), id_col="class_id")
    again = docs.union(docs.limit(1)).withColumnsRenamed({"key": "count", "m": "__n"}).withColumn("__id", F.lit(1))
    kept = nj.keep_one(again, id_col="count")
    assert kept.columns == again.columns and sorted(r["count"] for r in kept.collect()) == ["a", "c"]


def test_relatives_of_a_stranger_with_a_lesser_hash(spark):
    """Families whose members are too far from most, with near siblings among them."""
    rng = np.random.default_rng(3)
    rows = []
    for _ in range(8):
        base = [f"w{rng.integers(9000)}" for _ in range(150)]
        for _ in range(25):
            one = [w if rng.random() > 0.12 else f"x{rng.integers(9000)}" for w in base]
            two = [w if rng.random() > 0.08 else f"y{rng.integers(9000)}" for w in one]
            rows += [(len(rows), " ".join(one)), (len(rows) + 1, " ".join(two))]
    want = brute(rows)[0]
    got = {(r.id_a, r.id_b) for r in nj.jaccard_pairs(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got <= set(want) and len(want) > 100 and len(got) >= 0.9 * len(want)


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert nj.jaccard_pairs(docs).collect() == [] and nj.jaccard_classes(docs).collect() == [] and nj.keep_one(docs).collect() == []


def test_components_both_ways(spark, monkeypatch):
    edges = [(1, 2), (2, 3), (9, 8), (8, 7), (7, 6), (6, 5), (20, 30), (30, 20), (4, 4), (11, 12), (12, 13), (13, 14), (14, 15), (15, 16)]
    pairs = spark.createDataFrame(edges, "u long, v long")
    want = {i: r for r, m in ((1, (1, 2, 3)), (5, (5, 6, 7, 8, 9)), (20, (20, 30)), (11, range(11, 17))) for i in m}
    assert {r.node: r.root for r in common.components(pairs).collect()} == want
    monkeypatch.setattr(common, "ONE_TASK_EDGES", 0)
    assert {r.node: r.root for r in common.components(pairs).collect()} == want


def test_one_of_each_group_stays(spark):
    base = " ".join(f"w{i}" for i in range(100))
    rows = [(5, base, "en"), (3, base + " more", "en"), (7, "alone in the world", None), (None, base, "en"), (8, None, "en"), (9, "", "en"), (7, "alone in the world", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, root string")
    kept = nj.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id or 0) for r in kept.collect()) == [0, 3, 7, 8, 9]


def test_large_blocks_are_split_without_loss(spark, monkeypatch):
    rng = np.random.default_rng(5)
    base = [f"w{i}" for i in range(80)]
    rows = [(i, " ".join(w if rng.random() > 0.02 else f"z{rng.integers(99)}" for w in base)) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    whole = {tuple(r) for r in nj.jaccard_pairs(docs).collect()}
    classes = as_dict(nj.jaccard_classes(docs))
    monkeypatch.setattr(nj, "BLOCK", 7)
    monkeypatch.setattr(scratch, "BROADCAST_BYTES", 0)
    assert {tuple(r) for r in nj.jaccard_pairs(docs).collect()} == whole and len(whole) > 300
    assert as_dict(nj.jaccard_classes(docs)) == classes == brute(rows)[1]


def test_no_pair_at_the_threshold_is_left_out(spark, monkeypatch):
    """Sets of 1 to 400 grams, each with one just above the threshold and one just below it."""
    rng = np.random.default_rng(11)
    rows = []
    for size in [*range(1, 41)] * 3 + [*range(50, 400, 5)]:
        # grams of one word where there are n = 1; shared ones first
        mine = [f"a{rng.integers(10**9)}" for _ in range(size)]
        for same in (int(np.ceil(0.7 * size)), int(np.ceil(0.7 * size)) - 1):
            rows += [(len(rows), " ".join(mine)), (len(rows) + 1, " ".join(mine[:same]))]
            more = int(same / 0.7 + 1e-9) - size  # others of the second set
            if more > 0:
                rows[-1] = (len(rows) - 1, rows[-1][1] + "".join(f" b{rng.integers(10**9)}" for _ in range(more)))
        half = int(np.ceil(0.8236 * size))  # as many in both, of equal size
        rows.append((len(rows), " ".join(mine[:half] + [f"c{rng.integers(10**9)}" for _ in range(size - half)])))
    sets = {i: frozenset(t.split()) for i, t in rows}
    want = {}
    for (a, x), (b, y) in itertools.combinations(sets.items(), 2):
        if x != y and len(x & y) / len(x | y) >= 0.7:
            least = tuple(sorted(min(i for i, z in list(sets.items())[max(0, a - 5) : b + 6] if z == s) for s in (x, y)))
            want[least] = len(x & y) / len(x | y)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for hot, listed in ((nj.HOT_SAMPLED, 1 << 21), (1, 10)):
        monkeypatch.setattr(nj, "HOT_SAMPLED", hot)
        monkeypatch.setattr(nj, "_LISTED", listed, raising=False)
        got = {(r.id_a, r.id_b): r.jaccard for r in nj.jaccard_pairs(docs, n=1).collect()}
        assert set(got) == set(want) and len(want) > 300 and all(np.isclose(want[k], j) for k, j in got.items())


def test_sets_of_a_large_group_are_kept_once(spark, monkeypatch):
    """What is written for a group grows with its sets, not with its blocks."""
    base = [f"w{i}" for i in range(400)]
    rows = [(i, " ".join([*base[:i], f"z{i}", *base[i:]])) for i in range(90)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = {i: (0, 89) for i, _ in rows}
    held = []
    for block in (100, 9):
        monkeypatch.setattr(nj, "BLOCK", block)
        plan = nj._Plan(docs, nj.N, nj.THRESHOLD, "doc_id", "text")
        sets = [r.sets for r in plan.work.collect() if r.sets is not None]
        files = sum(f.stat().st_size for p in Path(scratch.shared_dir(spark)).glob("parts-*") if p.is_dir() for f in p.iterdir() if "_" in f.name and "part-" not in f.name)
        held.append(sum(len(x.grams) for s in sets for x in s) + files)
        assert as_dict(nj.jaccard_classes(docs)) == want
    assert held[1] < 1.5 * held[0]


def test_tasks_give_their_memory_back(spark):
    """What workers keep after the join's tasks would add up with what the next ones take."""

    def own(batches):
        for batch in batches:
            status = dict(x.split(":", 1) for x in Path("/proc/self/status").read_text().splitlines())
            yield pa.RecordBatch.from_arrays([pa.array([int(status["RssAnon"].split()[0]) >> 10])], names=["mb"])

    rng = np.random.default_rng(4)
    text = [" ".join(f"w{x}" for x in rng.integers(0, 400_000, 400)) for _ in range(6000)]
    docs = common.stored(spark.createDataFrame(list(enumerate(text)), "doc_id long, text string").repartition(4), "docs")
    assert nj.jaccard_classes(docs).count() == len(text)
    held = spark.range(64).repartition(16).mapInArrow(own, "mb long").collect()
    assert max(r.mb for r in held) < 150


def test_sketches_in_many_files(spark, monkeypatch):
    rows = odd_rows()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(nj, "_FILE_SETS", 7, raising=False)
    assert as_dict(nj.jaccard_classes(docs)) == brute(rows)[1]
