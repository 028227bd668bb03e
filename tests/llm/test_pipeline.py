import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

import corpus_pipeline as cp
from lexispark.llm import common, language_id, quality
from lexispark.llm.common import byte_view

from test_language_id import corpus
from test_ngram_join import brute


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    """Documents in three languages, shouted junk, copies, and labels."""
    d = tmp_path_factory.mktemp("tables")
    rows = [(i, t, lang, f"s{i % 3}") for i, t, lang in corpus(90, 7)]
    rng = np.random.default_rng(0)
    rows += [(100 + i, " ".join(f"{x.upper()}!!" for x in rng.permutation(rows[i][1].split() * 3)), "en", "s0") for i in range(30)]
    unique = [(200 + i, " ".join(f"the{a} and{b}" for a, b in rng.integers(0, 900, (60, 2))), "en", "s1") for i in range(6)]
    rows += unique + [(300 + i, t + " more", lang, s) for i, (_, t, lang, s) in enumerate(unique)] + [(400, unique[0][1], "en", "s2")]
    rows += [(500, "", "en", "s0"), (501, None, "en", "s0")]
    ids, texts, langs, sources = map(list, zip(*rows))
    pq.write_table(pa.table({"doc_id": pa.array(ids, pa.int64()), "text": pa.array(texts, pa.string()), "lang": langs, "source": sources, "n_chars": pa.array([len(t or "") for t in texts], pa.int64())}), d / "documents.parquet")
    known = [i for i in ids if i % 4 or i >= 200]
    pq.write_table(pa.table({"doc_id": pa.array(known, pa.int64()), "quality": pa.array([0 if 100 <= i < 200 else 1 for i in known], pa.int32()), "toxic": pa.array([0] * len(known), pa.int32())}), d / "labels.parquet")
    return str(d), {i: t for i, t, *_ in rows}


def test_each_stage_against_its_plain_version(spark, folder):
    sf_dir, texts = folder
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns = docs.columns

    kept = cp.good_quality(spark, docs, sf_dir)
    assert kept.columns == columns
    model = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    score = {i: model.probability(quality.features_of(*byte_view(pa.array([t]))))[0] for i, t in texts.items() if t is not None}
    left = {r.doc_id for r in kept.collect()}
    assert left == {i for i, s in score.items() if s >= 0.5}
    assert not left & set(range(100, 130)) and set(range(90)) <= left and set(range(200, 206)) <= left

    docs = kept
    named = cp.known_language(spark, docs, sf_dir)
    assert named.columns == columns
    net = language_id.fit(docs)
    sure = {i for i in left if texts[i] and language_id.label_bytes(net, *byte_view(pa.array([texts[i]])))[1].max() >= 0.4}
    assert {r.doc_id for r in named.collect()} == sure

    one = cp.one_of_each(spark, named, sf_dir)
    assert one.columns == columns
    root = {i: i for i in sure}
    for i, (least, _) in brute([(i, texts[i]) for i in sorted(sure)])[1].items():
        root[i] = least
    assert {r.doc_id for r in one.collect()} == {i for i in sure if root[i] == i}

    rows = cp.packed(spark, one, sf_dir).collect()
    tokens = {}
    for r in rows:
        tokens[r.doc_id] = tokens.get(r.doc_id, 0) + r.n_tokens
    assert tokens == {i: len(texts[i].split()) for i in sure if root[i] == i}


def test_run_applies_all_stages(spark, folder):
    sf_dir, _ = folder
    rows = cp.run(spark, sf_dir).collect()
    ids = {r.doc_id for r in rows}
    assert len(cp.STAGES) == 4 and ids and not ids & ({400} | set(range(100, 130)) | set(range(300, 306)))


def tables(path, rows, labels):
    ids, texts, langs = (list(x) for x in zip(*rows)) if rows else ([], [], [])
    path.mkdir()
    pq.write_table(pa.table({"doc_id": pa.array(ids, pa.int64()), "text": pa.array(texts, pa.string()), "lang": pa.array(langs, pa.string()), "n": pa.array([1] * len(ids)), "__id": pa.array([2] * len(ids))}), path / "documents.parquet")
    pq.write_table(pa.table({"doc_id": pa.array([i for i, _ in labels], pa.int64()), "quality": pa.array([q for _, q in labels], pa.int32())}), path / "labels.parquet")
    return str(path)


def test_odd_tables_run_through_all_stages(spark, tmp_path):
    """No documents; one language; no labels; nulls, repeats, ties and clashing columns."""
    assert cp.run(spark, tables(tmp_path / "a", [], [])).collect() == []
    rows = [(1, "one text of some words", "en"), (1, "one text of some words", "en"), (2, "one text of some words", "en"), (3, "", "en"), (4, None, None), (None, "a row without id", None), (5, "quite another", None)]
    for name, labels in (("b", []), ("c", [(1, 1), (5, 1)])):
        out = cp.run(spark, tables(tmp_path / name, rows, labels)).collect()
        assert sorted((r.doc_id or 0, r.n_tokens) for r in out) == [(0, 4), (1, 5), (5, 2)]


def test_tables_of_earlier_stages_are_not_kept_in_the_join():
    """The quality stage's batches of 3 MB leave a larger table of powers in the workers than the join's take."""
    data = np.full(3 << 20, 97, np.uint8)
    common.words_of(data, np.array([0, len(data)]))
    seen = list(common.lean(lambda batches: (sum(x.nbytes for x in common._POWERS.values()) for _ in batches))([1]))
    assert seen == [0]
    common.words_of(data[: 1 << 19], np.array([0, 1 << 19]))
    assert sum(x.nbytes for x in common._POWERS.values()) <= 1 << 24
