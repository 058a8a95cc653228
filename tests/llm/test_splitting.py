from __future__ import annotations

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quillgraph.functions.unicode import PY_WORD
from quillgraph.llm.splitting import pieces, split_texts


def words(t: str) -> list[str]:
    return PY_WORD.findall(t)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["a", "bb.", "Cc", "dd,", "\n\n", "\n", " ", " ", "Art.", "5"]), max_size=120), st.integers(2, 12), st.data())
def test_round_trip_limit_and_overlap(parts, capacity, data):
    text = " ".join(parts)
    overlap = data.draw(st.integers(0, capacity - 1))
    cuts = pieces(text, capacity, overlap)
    rebuilt, w = [], words(text)
    for i, (a, b, _) in enumerate(cuts):
        assert 0 < b - a <= capacity
        if i:
            assert a == cuts[i - 1][1] - overlap
        rebuilt += w[a + (overlap if i else 0) : b]
    assert rebuilt == w


def test_prefers_paragraph_then_sentence_then_hard():
    text = "a b c. D e f\n\ng h i j k l m n"
    assert pieces(text, 8, 0)[0] == (0, 6, "paragraph")
    assert pieces("a b c d e. F g h i", 6, 0)[0] == (0, 5, "sentence")
    assert pieces("see Art. 5 of the long old act now", 4, 1)[0] == (0, 4, "hard")


def test_bad_limits():
    with pytest.raises(ValueError):
        pieces("a", 3, 3)


def test_nulls_blanks_repeats_and_long(spark):
    long = " ".join(["word"] * 50_001)
    df = spark.createDataFrame([("n", None, 1), ("e", "", 1), ("b", "  ", 1), ("r", "x y z", 1), ("r", "x y z", 2), ("l", long, 3)], "chunk_id string, text string, piece int")
    rows = split_texts(df, "chunk_id", "text", 400, 40).collect()
    by: dict[str, list] = {}
    for r in rows:
        by.setdefault(r.chunk_id, []).append(r)
    assert set(by) == {"r", "l"} and len(by["r"]) == 2
    assert max(r.n_words for r in by["l"]) == 400
    assert sum(r.n_words for r in by["l"]) - 40 * (len(by["l"]) - 1) == 50_001


def test_empty_table(spark):
    assert split_texts(spark.createDataFrame([], "chunk_id string, text string"), "chunk_id", "text", 5, 1).count() == 0
