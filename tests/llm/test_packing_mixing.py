from __future__ import annotations

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillgraph.llm import mixing as M
from quillgraph.llm import packing as P
from quillgraph.llm.tokens import VOCABULARY, count_tokens, tokenizer


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 64), max_size=80), st.sets(st.integers(1, 64), max_size=3))
def test_pack_is_whole_and_fits(sizes, caps):
    caps = sorted({*caps, 64})
    where, capacity = P.pack(sizes, caps)
    used = [0] * len(capacity)
    for s, w in zip(sizes, where, strict=True):
        used[w] += s
    assert all(0 < u <= c and c in caps for u, c in zip(used, capacity, strict=True))
    assert all(c == min(x for x in caps if x >= u) for u, c in zip(used, capacity, strict=True))


def test_fills_tightly():
    rng = np.random.default_rng(1)
    sizes = rng.lognormal(5, 1, 5000).astype(int).clip(1, 8192).tolist()
    _, capacity = P.pack(sizes, [512, 2048, 8192])
    assert 1 - sum(sizes) / sum(capacity) < 0.005
    assert P.pack([6, 4, 5, 5], [10]) == ([0, 0, 1, 1], [10, 10])


def test_pack_items(spark, monkeypatch):
    monkeypatch.setattr(P, "SHARD_ITEMS", 10)
    rows = [(i, 1 + i * 7 % 50, 0) for i in range(40)] + [(100, 205, 0), (101, None, 0), (102, 0, 0), (103, -1, 0), (7, 8, 1)]
    out = P.pack_items(spark.createDataFrame(rows, "doc_id bigint, n_tokens int, container int"), "doc_id", "n_tokens", [16, 100]).collect()
    by = {}
    for r in out:
        if r.container is not None:
            by.setdefault((r.container, r.capacity), []).append(r.n)
    assert all(sum(v) <= c for (_, c), v in by.items()) and len({c for c, _ in by}) == len(by)
    assert sorted((r.part, r.first, r.n) for r in out if r.doc_id == 100) == [(0, 0, 100), (1, 100, 100), (2, 200, 5)]
    assert [r.container for r in out if r.doc_id in (101, 102, 103)] == [None] * 3 and len(out) == 47
    assert P.pack_items(spark.createDataFrame([], "doc_id bigint, n_tokens int"), "doc_id", "n_tokens", [5]).count() == 0
    with pytest.raises(ValueError):
        P.pack_items(spark.createDataFrame([], "doc_id bigint, n_tokens int"), "doc_id", "n_tokens", [])


@pytest.mark.parametrize("n", [1, 2, 3, 7, 64, 65, 1000])
def test_permutation_hits_all_once(n):
    assert sorted(M.permute(np.arange(n), n, "k").tolist()) == list(range(n))


@pytest.mark.parametrize("n", [1, 2, 7, 65, 1000])
def test_permutation_back(n):
    x = np.arange(n)
    assert (M.permute(M.permute(x, n, "k"), n, "k", back=True) == x).all()


@settings(max_examples=100, deadline=None)
@given(st.dictionaries(st.sampled_from("abcde"), st.tuples(st.integers(0, 30), st.integers(0, 30)), min_size=2))
def test_repairs_move_every_slot_too_many_to_a_draw_that_lacks(sources):
    drawn, quota = ({s: x[i] for s, x in sources.items()} for i in (0, 1))
    first = min(quota)
    quota[first] += sum(drawn.values()) - sum(quota.values())
    if quota[first] < 0:
        return
    surplus, lacking = M.repairs(drawn, quota)
    new = [k for n, k0 in surplus.values() for k in range(k0, k0 + n)]
    made = []
    for k in new:
        s, at, begin = [x for x in lacking if x[1] <= k][-1]
        made.append((s, begin + k - at))
    assert sorted(made) == sorted((s, j) for s in quota for j in range(drawn[s], quota[s])) and all(n == drawn[s] - quota[s] for s, (n, _) in surplus.items())


@settings(max_examples=100, deadline=None)
@given(st.dictionaries(st.sampled_from("abcdef"), st.tuples(st.integers(0, 5000), st.floats(0, 1), st.integers(0, 4)), min_size=1), st.sampled_from([None, 100, 5000]))
def test_due_respects_repeats(sources, total):
    got = M.due({s: t for s, (t, _, _) in sources.items()}, {s: (w, r) for s, (_, w, r) in sources.items()}, 10, total)
    for s, b in got.items():
        t, w, r = sources[s]
        assert t > 0 and w > 0 and 0 <= b <= r * -(-t // 10)


def _sized(spark):
    rows = [(i, "Big " if i % 2 else "big", 37 + i % 13) for i in range(300)] + [(1000 + i, "small", 11) for i in range(20)] + [(2000, None, 5), (2001, "other", 5), (2002, "small", None), (2003, "small", 0)]
    return spark.createDataFrame([(*r, 0) for r in rows], "doc_id bigint, source string, n_tokens int, block int")


TARGETS = "source string, target_share double, max_repeats int"


def test_mix_shares_repeats_and_whole_blocks(spark, monkeypatch):
    monkeypatch.setattr(M, "BUCKET_DOCS", 50)
    monkeypatch.setattr(M, "SHARD_BLOCKS", 16)
    t = spark.createDataFrame([("big", 0.6, 1), ("small", 0.2, 3), ("absent", 0.2, 2), ("none", None, None)], TARGETS)
    col, shares = M.mix(_sized(spark), t, block=20)
    rows, s = col.collect(), {r.source: r for r in shares.collect()}
    slots = {}
    for r in rows:
        slots.setdefault((r.shard, r.slot), []).append(r)
    last = {"big": -(-s["big"].tokens_held // 20) - 1, "small": s["small"].tokens_held // 20 - (s["small"].tokens_held % 20 == 0)}
    full = lambda x: 20 if x.block < last[x.source] else s[x.source].tokens_held - 20 * last[x.source]
    assert all(sum(x.n for x in v) == full(v[0]) and len({(x.source, x.block, x.repeat) for x in v}) == 1 for v in slots.values())
    assert all([x.part for x in sorted(v, key=lambda x: x.part)] == np.concatenate([[0], np.cumsum([x.n for x in sorted(v, key=lambda x: x.part)])[:-1]]).tolist() for v in slots.values())
    assert abs(s["small"].actual_share - 0.25) < 0.02 and s["absent"].tokens == 0 and s["small"].repeats <= 3 and s["big"].repeats == 1
    used = {}
    for (_, _), v in slots.items():
        used[v[0].source, v[0].block] = used.get((v[0].source, v[0].block), 0) + 1
    assert max(n for (x, _), n in used.items() if x == "big") == 1 and max(n for (x, _), n in used.items() if x == "small") <= 3
    for source in ("big", "small"):
        assert s[source].tokens == sum(r.n for r in rows if r.source == source)
    assert {(x, last[x]) for x in ("big", "small")} & used.keys()  # short last blocks are drawn too
    again = M.mix(_sized(spark).repartition(7), t, block=20)[0]
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, rows))


def test_tiny_sources_give_all_their_tokens_and_shards_are_many(spark, monkeypatch):
    monkeypatch.setattr(M, "SHARD_BLOCKS", 2)
    monkeypatch.setattr(M, "BUCKET_SHARDS", 7)
    rows = [(i, "big", 25) for i in range(200)] + [(1000, "tiny", 13), (1001, "tiny", 18)]
    t = spark.createDataFrame([("big", 0.97, 1), ("tiny", 0.03, 4)], TARGETS)
    col, shares = M.mix(spark.createDataFrame(rows, "doc_id bigint, source string, n_tokens int"), t, block=20)
    got, s = col.collect(), {r.source: r for r in shares.collect()}
    assert {(r.doc_id) for r in got if r.source == "tiny"} == {1000, 1001} and len({r.shard for r in got}) > 100
    assert all(s[x].tokens == sum(r.n for r in got if r.source == x) for x in s) and len({(r.shard, r.slot) for r in got}) == len({(r.shard, r.slot, r.source, r.block, r.repeat) for r in got})
    assert abs(s["tiny"].actual_share - 0.03) < 0.005 and s["tiny"].repeats <= 4 and s["big"].repeats == 1


def test_mix_empty(spark):
    t = spark.createDataFrame([("big", 1.0, 1)], TARGETS)
    assert M.mix(_sized(spark).limit(0), t)[0].count() == 0
    assert M.mix(_sized(spark), t.limit(0))[0].count() == 0 and M.mix(_sized(spark), t.limit(0))[1].count() == 0


def test_block_tokens_round_trip(spark):
    texts = [(i, ["a", "b"][i % 2], f"Text {i} über die Frist von {i * 3} Tagen. " * 4) for i in range(30)]
    docs = spark.createDataFrame(texts, "doc_id bigint, source string, text string")
    sized = count_tokens(docs, "doc_id", "text", "source")
    col, _ = M.mix(sized, spark.createDataFrame([("a", 0.5, 1), ("b", 0.5, 1)], TARGETS), block=16)
    enc = tokenizer(VOCABULARY)
    whole = {i: enc.encode_ordinary(t) for i, _, t in texts}
    want = {}
    for r in sorted(col.collect(), key=lambda r: (r.shard, r.slot, r.part)):
        want.setdefault((r.shard, r.slot), []).extend(whole[r.doc_id][r.first : r.first + r.n])
    got = {(r.shard, r.slot): r.tokens for r in M.block_tokens(col, docs).collect()}
    short = sum(len(v) != 16 for v in got.values())
    assert got == want and short <= 2
    n = {r.doc_id: r.n_tokens for r in sized.collect()}
    assert n == {i: len(v) for i, v in whole.items()}
    assert count_tokens(docs.withColumn("text", F.lit(None).cast("string")).limit(2), "doc_id", "text").first().n_tokens == 0
