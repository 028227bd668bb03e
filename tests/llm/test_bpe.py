import base64
import os

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lexispark.llm import bpe

pytestmark = pytest.mark.skipif(not os.path.exists(bpe.VOCABULARY), reason="no vocabulary file")


def reference(path):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=bpe.PATTERN, mergeable_ranks=ranks, special_tokens={})


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=" \n\t aab'sreTHing12３é漢字🙂—$#\r", max_size=30) | st.text(max_size=30))
def test_same_ids_as_merging(text):
    c = bpe.codec()
    ids = c.encode(text)
    assert ids == ENC.encode_ordinary(text)
    assert c.decode(ids) == text


ENC = reference(bpe.VOCABULARY) if os.path.exists(bpe.VOCABULARY) else None


def test_caches_turn_over():
    c = bpe.Codec(bpe.VOCABULARY, remember=6)
    text = " ".join(f"word{i} theword{i % 3}, banana{i}." for i in range(60))
    assert c.encode(text) == ENC.encode_ordinary(text)
    assert c.encode(text) == ENC.encode_ordinary(text)


def test_backtracking_words():
    c = bpe.codec()
    for w in ["indivisibleness", " antidisestablishmentarianism", "aaaaaaaaaaaaaaaaaaaaaaa", "$$$###!!!", "thethethethe"]:
        assert c.encode(w) == ENC.encode_ordinary(w)


def test_rows_nulls_and_clashing_columns(spark):
    rows = [(1, "the cat", 9, 9), (None, "", 9, 9), (2, None, 9, 9), (1, "the cat", 9, 9), (3, "x " * 40000, 9, 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids int, n_tokens int")
    out = bpe.round_trip(docs).collect()
    assert len(out) == 5
    by = {(r.doc_id, r.n_tokens): r for r in out}
    assert by[1, 2].ids == ENC.encode_ordinary("the cat") and by[1, 2].exact
    assert by[None, 0].ids == [] and by[None, 0].exact
    assert by[2, 0].ids is None and by[2, 0].exact is None
    assert [r.exact for r in out if r.doc_id == 3] == [True]
    back = {r.doc_id: r.text for r in bpe.decode(bpe.encode(docs)).collect()}
    assert back[1] == "the cat" and back[2] is None and back[None] == ""
    assert bpe.round_trip(docs.limit(0)).collect() == []
