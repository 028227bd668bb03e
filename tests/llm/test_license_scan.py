import re

import numpy as np

from lexispark.llm import license_scan as ls
from lexispark.plans import scratch


def words(text):
    return re.findall(r"[a-z0-9]+", text.lower())


def lcs(a, b):
    t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
    return t[-1][-1]


def test_common_words_against_plain_lcs():
    rng = np.random.default_rng(0)
    for _ in range(200):
        a, b = rng.integers(0, 5, rng.integers(0, 12)), rng.integers(0, 5, rng.integers(0, 15))
        n, i, j = ls.common_words(a, b)
        assert n == lcs(a.tolist(), b.tolist())
        if n:
            assert lcs(a.tolist(), b[i : j + 1].tolist()) == n


def filler(n, seed):
    rng = np.random.default_rng(seed)
    return " ".join(f"f{x}" for x in rng.integers(0, 500, n))


def test_exact_occurrences_are_where_they_were_put(spark):
    rows, want = [], set()
    for i, (name, text) in enumerate(sorted(ls.TEMPLATES.items())):
        rows.append((i, filler(7 + i, i) + "\n" + text.upper() + "\n" + filler(9, i)))
        want.add((i, name, 7 + i, 7 + i + len(words(text))))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = ls.scan(docs).collect()
    got = {(r.doc_id, r.license, r.start_word, r.end_word) for r in out if r.coverage == 1.0}
    assert want <= got
    # a longer notice may hold a shorter one; nothing else may be found
    for r in out:
        w = words(rows[r.doc_id][1])[r.start_word : r.end_word]
        assert lcs(words(ls.TEMPLATES[r.license]), w) == round(r.coverage * len(words(ls.TEMPLATES[r.license])))
        assert r.coverage >= ls.COVERAGE


def test_changed_notices_and_two_in_one_document(spark):
    text = ls.TEMPLATES["mit"].split()
    changed = text[:12] + ["quite"] + text[12:30] + text[32:60] + ["really", "so"] + text[60:]
    rows = [
        (1, filler(20, 1) + " " + " ".join(changed) + " " + filler(20, 2)),
        (2, filler(50, 3) + " Released under the MIT License. " + filler(40, 4) + " released under the mit license " + filler(3, 5)),
        (3, "the license of the software is under the general public"),
        (4, filler(300, 6)),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = ls.scan(docs).collect()
    one = [r for r in out if r.doc_id == 1]
    assert [r.license for r in one] == ["mit"] and one[0].coverage > 0.95 and one[0].start_word == 20
    assert sorted(r.start_word for r in out if r.doc_id == 2) == [50, 95]
    assert {r.doc_id for r in out} == {1, 2}


def test_rows_nulls_and_clashing_columns(spark):
    line = ls.TEMPLATES["gpl-3.0-line"]
    rows = [(1, line, "x", 1, 2), (1, line, "x", 1, 2), (1, "well " + line, "x", 1, 2), (None, line, "x", 1, 2), (2, None, "x", 1, 2), (3, "", "x", 1, 2), (4, "ä " * 30000 + line, "x", 1, 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, license string, t long, votes int")
    out = [(r.doc_id, r.start_word) for r in ls.scan(docs).collect() if r.license == "gpl-3.0-line"]
    assert sorted(out, key=str) == [(1, 0), (1, 1), (4, 30000), (None, 0)]
    assert ls.scan(docs.limit(0)).collect() == []


def test_own_templates(spark, monkeypatch):
    monkeypatch.setattr(scratch, "BROADCAST_BYTES", 0)
    known = spark.createDataFrame([("a", "one two three four"), ("b", None), (None, "x y z"), ("c", "short"), ("d", "")], "license string, text string")
    docs = spark.createDataFrame([(1, "zero one two three four five short"), (2, "one two x y z")], "doc_id long, text string")
    assert sorted(tuple(r)[:4] for r in ls.scan(docs, known).collect()) == [(1, "a", 1, 5), (1, "c", 6, 7)]
    assert ls.scan(docs, known.limit(0)).collect() == []


def held(text, template):
    """The greatest share of the template's words that a stretch of up to 1.5 times its length shows in order."""
    w, t = words(text), words(template)
    size = int(1.5 * len(t))
    return max(lcs(t, w[i : i + size]) for i in range(max(1, len(w) - size + 1))) / len(t)


def test_every_changed_notice_against_brute_force(spark):
    """One word missing, replaced or put in at every place of every short notice, and
    texts that hold some of their words; the search must name the same notices."""
    rows = []
    for name, text in ls.TEMPLATES.items():
        own = text.split()
        if name.endswith("-line"):
            for i in range(len(own)):
                rows += [own[:i] + own[i + 1 :], own[:i] + ["zz"] + own[i + 1 :], own[:i] + ["zz"] + own[i:]]
        rows += [own[: len(own) * 7 // 10], own[len(own) // 5 :], own[::-1]]
    rows = [(i, filler(6, i) + " " + " ".join(r) + " " + filler(5, i + 1)) for i, r in enumerate(rows)]
    got = {(r.doc_id, r.license) for r in ls.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    want = {(i, name) for i, text in rows for name, t in ls.TEMPLATES.items() if held(text, t) >= ls.COVERAGE}
    assert got == want and len(want) > 100


def test_a_text_of_one_notices_words_over_and_over(spark):
    text = " ".join(["permission to use copy"] * 20_000)
    assert [r.license for r in ls.scan(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()] == []
    a, b = np.arange(10), np.concatenate([np.full(90_000, 3), np.arange(10)])
    assert ls.occurrence(a, b) == (10, 90_000, 90_009)
