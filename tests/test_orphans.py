from __future__ import annotations

import datetime as dt
import random

from quillgraph.operators.orphans import Parent, orphan_references, relationship_orphans
from quillgraph.plans import runtime

T = dt.datetime
CHILD = "rel_id bigint, head string, tail string, source_chunk_id string, extracted_at timestamp, field string, kind string"
NODES = "type string, canonical_name string, aliases array<string>, ingested_at timestamp, retired_at timestamp, key string"
CHUNKS = "chunk_id string, ingested_at timestamp, retired_at timestamp, month int"


def run(spark, rels, nodes, chunks=()):
    out = relationship_orphans(spark.createDataFrame([(*r, "clash", "clash") for r in rels], CHILD), spark.createDataFrame([(*n, "clash") for n in nodes], NODES), spark.createDataFrame([(*c, 1) for c in chunks], CHUNKS))
    return sorted((r.id, r.field, r.kind) for r in out.collect())


def test_kinds_boundaries_and_spelling(spark):
    nodes = [("A", "high risk ai system", ["HR-AI"], T(2025, 3, 10), T(2025, 6, 1)), ("A", None, None, T(2025, 1, 1), None), ("A", "other", ["high risk ai system", "two"], T(2024, 1, 1), None), ("A", "third", ["two"], T(2025, 7, 1), None)]
    rels = [
        (1, "“High‑risk AI System.”", None, None, T(2025, 3, 10)),  # arrives at this very moment: there
        (2, "hr ai", "nowhere", "c9", T(2025, 3, 9, 23)),  # late, missing, missing
        (3, "HIGH RISK AI SYSTEM", "", "c1", T(2025, 6, 1)),  # retired at this very moment; an empty key is missing
        (3, "HIGH RISK AI SYSTEM", "", "c1", T(2025, 6, 1)),
        (4, "two", "two", "c1", T(2025, 5, 1)),  # one of its nodes is there
        (5, "high risk ai system", None, None, None),  # no time: only missing could be told
    ]
    got = run(spark, rels, nodes, [("c1", T(2025, 5, 5), None)])
    assert got == [(2, "head", "late"), (2, "source_chunk_id", "missing"), (2, "tail", "missing"), (3, "head", "deleted"), (3, "tail", "missing"), (4, "source_chunk_id", "late")]


def test_empty_tables(spark):
    assert run(spark, [], []) == []
    assert run(spark, [(1, "x", None, "c", T(2025, 1, 1))], []) == [(1, "head", "missing"), (1, "source_chunk_id", "missing")]


def test_brute_force_with_hot_key_and_salted_join(spark, monkeypatch):
    rng = random.Random(5)
    days = [T(2025, 1, 1) + dt.timedelta(days=i) for i in range(200)]
    parents = {f"k{i}": (rng.choice(days), rng.choice([None, *days])) for i in range(60)}
    rows = [(i, "hot" if i % 3 == 0 else f"k{rng.randrange(80)}", rng.choice(days)) for i in range(900)]
    parents["hot"] = (days[50], days[120])
    monkeypatch.setattr(runtime, "small_enough", lambda *_: False)
    child = spark.createDataFrame(rows, "id bigint, ref string, at timestamp")
    p = spark.createDataFrame([(k, 0, a, b) for k, (a, b) in parents.items()], "key string, rank int, since timestamp, until timestamp")
    got = {(r.id, r.kind) for r in orphan_references(child, "id", "at", [Parent("p", p, ("ref",))]).collect()}
    want = set()
    for i, k, t in rows:
        if k not in parents:
            want.add((i, "missing"))
        elif parents[k][0] > t:
            want.add((i, "late"))
        elif parents[k][1] is not None and parents[k][1] <= t:
            want.add((i, "deleted"))
    assert got == want
