from __future__ import annotations

import datetime as dt
import math

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from quillgraph.llm import quantiles as Q


def rank_error(values, x, rank):
    s = np.sort(values)
    return max(0, np.searchsorted(s, x, "left") + 1 - rank, rank - np.searchsorted(s, x, "right"))


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.integers(0, 30).map(float), min_size=1, max_size=120), min_size=1, max_size=6), st.sampled_from([0.01, 0.05, 0.2]))
def test_merged_summaries_keep_their_bound(parts, eps):
    s = Q.compress(Q._all([Q.summarise(np.array(p), eps / 2) for p in parts], eps / 2), eps)
    v = np.concatenate([np.array(p) for p in parts])
    assert s[3] == len(v) and Q.error(s) <= eps + 1e-12
    for lo, hi, x in zip(s[1], s[2], s[0], strict=True):
        assert lo <= hi and lo <= np.searchsorted(np.sort(v), x, "right") and hi >= np.searchsorted(np.sort(v), x, "left") + 1
    for q in (0.0, 0.25, 0.5, 0.95, 1.0):
        x, lo, hi = Q.read(s, q)
        rank = min(len(v), max(1, math.ceil(q * len(v))))
        assert rank_error(v, x, rank) <= eps * len(v) + 1e-9


def test_rollup_against_brute_force(spark):
    rng = np.random.default_rng(0)
    rows = []
    for i in range(3000):
        at = dt.datetime(2025, 1 + i % 3, 1 + i % 20)
        lat = float(rng.lognormal(7, 1)) if i % 50 else [None, float("nan"), -5.0][i // 50 % 3]
        rows.append((i, at, [" Vector", "both", None][i % 3] if i % 7 else "vector", lat, 0.0 if i % 11 else None, "x"))
    rows += rows[:40]
    df = spark.createDataFrame(rows, "ask_id bigint, asked_at timestamp, route string, latency_ms double, cost_usd double, day string").repartition(5)
    out = Q.rollup(df, (0.5, 0.95), 0.02).collect()
    x = {}
    for r in dict((r[0], r) for r in rows).values():
        if r[3] is not None and r[3] >= 0:
            x.setdefault((r[2] or "(none)").strip().lower(), []).append(r[3])
    for r in (r for r in out if r.scope == "all" and r.metric == "latency_ms"):
        assert r.n == len(x[r.route]) and rank_error(np.array(x[r.route]), r.percentile, math.ceil(r.q * r.n)) <= 0.02 * r.n
    assert {r.percentile for r in out if r.metric == "cost_usd"} == {0.0} and {r.scope for r in out} == {"day", "month", "all"}


def test_combining_days_equals_files_apart(spark):
    v = spark.createDataFrame([("d1", "r", "m", float(i)) for i in range(500)] + [("d2", "r", "m", float(i)) for i in range(500, 700)], "day string, route string, metric string, x double")
    days = Q.day_summaries(v, 0.02)
    both = Q.combine(days.drop("day"), ["route", "metric"], 0.02).first()
    assert both.n == 700 and abs(Q.read((np.array(both.value), np.array(both.lo), np.array(both.hi), both.n), 0.5)[0] - 349) <= 14


def test_empty_and_all_unusable(spark):
    s = "ask_id bigint, asked_at timestamp, route string, latency_ms double, cost_usd double"
    assert Q.rollup(spark.createDataFrame([], s)).count() == 0
    assert Q.rollup(spark.createDataFrame([(1, None, None, float("nan"), None)], s)).count() == 0
