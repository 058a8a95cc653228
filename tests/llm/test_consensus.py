from __future__ import annotations

import datetime as dt
import random
from collections import Counter

import pytest

from quillgraph.llm.consensus import LABELS, consensus

T0 = dt.datetime(2025, 1, 1)
SCHEMA = "run_tag string, id string, stratum string, verdict string, graded_at timestamp, vote int, votes string"


def df(spark, rows):
    return spark.createDataFrame([(*r, 7, "clash") for r in rows], SCHEMA)


def planted(n=400, seed=3):
    rng = random.Random(seed)
    truth = {f"i{i:03d}": rng.choices(LABELS, (5, 3, 2, 1))[0] for i in range(n)}
    rows = []
    for i, t in truth.items():
        for tag, p in (("good", 0.9), ("fair", 0.75), ("poor1", 0.5), ("poor2", 0.45), ("lazy", 0.0)):
            v = t if rng.random() < p else rng.choice(LABELS)
            rows.append((tag, i, "s", "correct" if tag == "lazy" else v, T0))
        v = t if rng.random() < 0.45 else rng.choice(LABELS)
        rows += [(f"copy{k}", i, "s", v, T0) for k in range(2)]
    return truth, rows


def test_recovers_planted_truth_better_than_majority(spark):
    truth, rows = planted()
    c = consensus(df(spark, rows))
    got = {r.id: r.verdict for r in c.items.collect()}
    votes = {}
    for _, i, _, v, _ in rows:
        votes.setdefault(i, Counter())[v] += 1
    right = sum(got[i] == t for i, t in truth.items())
    majority = sum(votes[i].most_common(1)[0][0] == t for i, t in truth.items())
    assert right > majority and right / len(truth) > 0.85
    a = {r.run_tag: r for r in c.annotators.collect()}
    assert a["good"].reliability > a["fair"].reliability > a["lazy"].reliability
    assert a["copy0"].independence < 0.6 and 0.6 < a["good"].independence


def test_spelling_regrading_repeats_and_nulls(spark):
    rows = [("a", "x", "s", " Correct.", T0), ("a", "x", "s", " Correct.", T0), ("b", "x", None, "WRONG", T0), ("b", "x", None, "correct", T0 + dt.timedelta(days=1)), ("c", "x", "s", "n/a", T0), (None, "x", "s", None, None), ("a", "y", "s", None, T0)]
    c = consensus(df(spark, rows), spark.createDataFrame([("x", "correct"), ("x", "wrong"), ("zzz", "wrong")], "id string, verdict string"))
    got = {r.id: (r.verdict, r.n_votes) for r in c.items.collect()}
    assert got["x"] == ("correct", 2) and set(got) == {"x", "y"} and got["y"][1] == 0
    assert c.alpha is None and c.n_votes == 2


def test_alpha_by_hand(spark):
    # two units of two equal votes and one of two different ones: D_o = 2/6, D_e from 3 and 3 of 6
    rows = [("a", "1", "s", "correct", T0), ("b", "1", "s", "correct", T0), ("a", "2", "s", "wrong", T0), ("b", "2", "s", "wrong", T0), ("a", "3", "s", "wrong", T0), ("b", "3", "s", "correct", T0), ("a", "4", "s", "correct", T0)]
    assert consensus(df(spark, rows)).alpha == pytest.approx(1 - (2 / 6) / (18 / 30))


def test_empty(spark):
    c = consensus(df(spark, []))
    assert c.items.count() == 0 and c.annotators.count() == 0 and c.alpha is None


def test_more_annotators_than_a_square_table_would_hold(spark):
    rng = random.Random(8)
    truth = {f"i{i:04d}": rng.choices(LABELS, (5, 3, 2, 1))[0] for i in range(1500)}
    rows = []
    for n, (i, t) in enumerate(truth.items()):
        for tag, p in (("expert", 0.95), *((f"crowd{(n * 7 + j) % 2600}", 0.6) for j in range(4))):
            rows.append((tag, i, "s" + str(n % 2100), t if rng.random() < p else rng.choice(LABELS), T0))
    c = consensus(df(spark, rows))
    got = {r.id: r.verdict for r in c.items.collect()}
    assert c.annotators.count() == 2601 and c.converged
    assert sum(got[i] == t for i, t in truth.items()) / len(truth) > 0.85


def test_pairs_agree_with_brute_force():
    import numpy as np
    import pyarrow as pa

    from quillgraph.llm.consensus import _PairSums, _same_item

    rng = np.random.default_rng(4)
    votes = [[{"tag": int(t), "vote": int(rng.integers(4))} for t in sorted(rng.choice(9, rng.integers(0, 7), replace=False))] for _ in range(60)]
    b = pa.RecordBatch.from_arrays([pa.array([str(i) for i in range(60)]), pa.array([0] * 60), pa.array(votes, pa.list_(pa.struct([("tag", pa.int32()), ("vote", pa.int32())])))], names=["id", "stratum", "votes"])
    vote = b.column(2).flatten().field(1).to_numpy()
    sums, want = _PairSums(), {}
    for codes, x in _same_item(b, lambda i, j: vote[i] == vote[j], nt=9):
        sums.add(codes, x)
    for v in votes:
        for i in range(len(v)):
            for j in range(i + 1, len(v)):
                w = want.setdefault(v[i]["tag"] * 9 + v[j]["tag"], [0, 0])
                w[0] += 1
                w[1] += v[i]["vote"] == v[j]["vote"]
    codes, x = sums.pack()
    assert {int(c): [int(a), int(g)] for c, a, g in zip(codes, *x, strict=True)} == want
