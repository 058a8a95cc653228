from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from quillgraph.operators import graph as G
from quillgraph.plans.runtime import cut

NODES = [("SystemType", "sys", "Sys", []), ("RiskCategory", "high", "High", []), ("Obligation", "log it", "log it", ["the logging"]), ("Obligation", "o2", "o2", []), ("Article", "aia art. 26(9)", "AIA Art. 26(9)", []), ("Article", "gdpr art. 35", "GDPR Art. 35", []), ("ActorRole", "deployer", "deployer", []), ("Annex", "aia annex viii", "AIA Annex VIII", [])]
T0 = dt.datetime(2025, 1, 1)


@pytest.fixture
def make(spark):
    def run(edges):
        nodes = spark.createDataFrame([(*n, T0, None) for n in NODES], "type string, canonical_name string, display_name string, aliases array<string>, ingested_at timestamp, retired_at timestamp")
        rel = spark.createDataFrame([(i, *e, 0.5, T0) for i, e in enumerate(edges)], "rel_id bigint, type string, head string, tail string, source_chunk_id string, confidence double, loaded_at timestamp")
        return G.build(rel, nodes)

    return run


def test_parallel_edges_multiply_no_rows(make):
    edges = [("CLASSIFIED_AS", "sys", "high", f"c{i}") for i in range(3)]
    bare = G.obligations_for_system(make(edges).edges).collect()
    assert len(bare) == 1 and bare[0].o is None and bare[0].applies_chunks == [] and len(bare[0].classified_chunks) == 3
    edges += [("APPLIES_TO", "log it", "sys", "d"), ("IMPOSES", "aia art. 26(9)", "The-Logging", "e"), ("APPLIES_TO", "o2", "sys", "d"), ("IMPOSES", "gdpr art. 35", "o2", "e")]
    rows = G.obligations_for_system(make(edges).edges).collect()
    assert len(rows) == 2 and all(len(r.classified_chunks) == 3 for r in rows)
    with_half = G.obligations_for_system(make([("CLASSIFIED_AS", "sys", "high", "c"), ("APPLIES_TO", "o2", "sys", "d")]).edges).collect()
    assert len(with_half) == 1 and with_half[0].o is None


def test_bridges_skips_and_violations(make):
    g = make([("REFERENCES", "aia art. 26(9)", "gdpr art. 35", "c1"), ("REFERENCES", "aia art. 26(9)", "article 35", "c1"), ("ENFORCED_BY", "log it", "sys", "c2"), ("REFERENCES", None, "sys", "c")])
    assert [(r.head, r.tail, r.derived) for r in G.bridges(g.edges).collect()] == [("aia art. 26(9)", "gdpr art. 35", True)]
    assert {r.missing for r in g.skipped.collect()} == {"article 35", ""}
    assert {r.type: r.violation for r in g.edges.collect()} == {"REFERENCES": False, "ENFORCED_BY": True}


def test_self_loop_stands_once_and_direction(make):
    g = make([("INTERACTS_WITH", "aia art. 26(9)", "aia art. 26(9)", "c"), ("INTERACTS_WITH", "aia art. 26(9)", "gdpr art. 35", "c")])
    rows = {(r.a, r.b): r.provenance for r in G.cross_regulation(g.edges).collect()}
    assert len(rows) == 3 and len(rows["aia art. 26(9)", "aia art. 26(9)"]) == 1
    assert rows["gdpr art. 35", "aia art. 26(9)"][0].outbound is False


def test_paths_and_components(make, spark):
    g = make([("APPLIES_TO", "log it", "deployer", "c1"), ("IMPOSES", "aia art. 26(9)", "log it", "c2"), ("IMPOSES", "aia art. 26(9)", "log it", "c0"), ("CLASSIFIED_AS", "sys", "high", "c3")])
    p = G.run_template(g.edges, "path_between", {"entity_a": "deployer", "entity_b": "aia art. 26(9)"}).collect()
    assert [(r.hops, r.nodes, [tuple(x) for x in r.legs]) for r in p] == [(2, ["deployer", "log it", "aia art. 26(9)"], [("c1", "APPLIES_TO", False), ("c0", "IMPOSES", False)])]
    assert G.run_template(g.edges, "path_between", {"entity_a": "deployer", "entity_b": "sys"}).collect() == []
    assert sorted(r.n for r in G.components(g.edges).groupBy("component").agg(F.count("*").alias("n")).collect()) == [2, 3]
    with pytest.raises(ValueError):
        G.validate("path_between", {"entity_a": "x"})
    with pytest.raises(ValueError):
        G.validate("DROP", {})


def test_statements(make, spark):
    g = make([("DEFINED_IN", "o2", "aia annex viii", f"c{i}") for i in range(5)])
    labels = spark.createDataFrame([(f"c{i}", f"L{i}") for i in range(5)], "chunk_id string, citation_label string")
    r = G.statements(G.definition_of(g.edges), "definition_of", g.nodes, labels).collect()
    assert [x.text for x in r] == ["o2 is defined in AIA Annex VIII. (L0, L1, L2, +2 more) [unverified annex section]"]
    with pytest.raises(Exception, match="no label"):
        G.statements(G.definition_of(g.edges), "definition_of", g.nodes, labels.where("chunk_id <> 'c4'")).collect()


def test_names_resolve_without_accents_and_lone_brackets(make):
    g = make([("APPLIES_TO", "The Lògging)", "[Déployer]", "c"), ("APPLIES_TO", "(the logging", "deployer.", "c"), ("APPLIES_TO", "the logging", "deployer", "d")])
    assert {(r.head, r.tail, r.source_chunk_id) for r in g.edges.collect()} == {("log it", "deployer", "c"), ("log it", "deployer", "d")}
    assert [r.missing for r in g.skipped.collect()] == ["[Déployer]"]  # brackets in a pair belong to the name


def test_unusable_confidence_is_null(make, spark):
    nodes = spark.createDataFrame([(*n, T0, None) for n in NODES], "type string, canonical_name string, display_name string, aliases array<string>, ingested_at timestamp, retired_at timestamp")
    rel = [("c0", float("nan")), ("c1", 1.5), ("c2", -0.1), ("c3", None), ("c4", 0.0), ("c5", 1.0), ("c6", 0.5), ("c6", float("nan"))]
    rows = [(i, "APPLIES_TO", "log it", "deployer", c, x, T0) for i, (c, x) in enumerate(rel)]
    g = G.build(spark.createDataFrame(rows, "rel_id bigint, type string, head string, tail string, source_chunk_id string, confidence double, loaded_at timestamp"), nodes)
    assert {r.source_chunk_id: r.confidence for r in g.edges.collect()} == {"c0": None, "c1": None, "c2": None, "c3": None, "c4": 0.0, "c5": 1.0, "c6": 0.5}


def test_search_runs_plans_and_tells_each_sentence_once(make, spark):
    g = make([("APPLIES_TO", "log it", "deployer", "c1"), ("IMPOSES", "aia art. 26(9)", "log it", "c2"), ("CLASSIFIED_AS", "sys", "high", "c3"), ("APPLIES_TO", "log it", "sys", "c4")])
    labels = spark.createDataFrame([(f"c{i}", f"L{i}") for i in range(6)], "chunk_id string, citation_label string")
    calls = [(1, 0, "obligations_for_system", "sys", None), (1, 1, "obligations_for_role", "deployer", None), (2, 0, "definition_of", "nothing", None), (3, 0, "path_between", "deployer", "aia art. 26(9)")]
    said, report = G.search(spark.createDataFrame(calls, "qid int, call int, template string, a string, b string"), g, labels)
    got = {(r.qid, r.call, r.text) for r in said.collect()}
    assert got == {
        (1, 0, "Sys is classified as High. (L3)"), (1, 0, "log it applies to Sys. (L4)"), (1, 0, "AIA Art. 26(9) imposes: log it. (L2)"), (1, 1, "log it applies to deployer. (L1)"),
        (3, 0, "deployer applies to log it. (L1)"), (3, 0, "log it imposes AIA Art. 26(9). (L2)"),
    }
    assert {(r.qid, r.call): r.n_rows for r in report.collect()} == {(1, 0): 1, (1, 1): 1, (2, 0): 0, (3, 0): 1}
    with pytest.raises(Exception, match="no template"):
        G.search(spark.createDataFrame([(1, 0, "DROP", "x", None)], "qid int, call int, template string, a string, b string"), g, labels)
    assert G.provenance(spark.createDataFrame(calls, "qid int, call int, template string, a string, b string"), g.edges).where("call = 1").collect()[0].chunk in ("c1", "c2")


def test_merges_keep_what_is_known(spark):
    old = spark.createDataFrame([("Article", "a", "A", 1), ("Annex", "b", "B", 1)], "type string, canonical_name string, display string, n int")
    new = spark.createDataFrame([("Article", "a", None, 2), ("Right", "c", "C", 3), ("Right", "c", "C", 3)], old.schema)
    for _ in range(2):
        old = G.upsert_nodes(old, new)
        assert {tuple(r) for r in old.collect()} == {("Article", "a", "A", 2), ("Annex", "b", "B", 1), ("Right", "c", "C", 3)}
    with pytest.raises(Exception, match="no such type"):
        G.upsert_nodes(old, new.withColumn("type", F.lit("X"))).collect()
    e = spark.createDataFrame([("T", "h", "t", "c", 0.1)], "type string, head string, tail string, source_chunk_id string, confidence double")
    assert [r.confidence for r in G.upsert_edges(e, e.withColumn("confidence", F.lit(0.7))).collect()] == [0.7]
    assert G.key_violations(e.union(e), G.EDGE_KEY).first().n == 2 and G.key_violations(e, G.EDGE_KEY).count() == 0


def test_empty(make):
    g = make([])
    assert G.obligations_for_role(g.edges).count() == 0 and G.components(g.edges).count() == 0


def test_cover(spark):
    p = spark.createDataFrame([(1, "definition_of", ["DEFINED_IN"]), (2, "path_between", ["IMPOSES"])], "qid int, template string, edges array<string>")
    assert {r.qid: r.hit for r in G.cover(p).collect()} == {1: True, 2: False}


def _dense(make):
    """A graph whose legs meet in hubs: every obligation applies to all and is imposed by both articles, on many chunks."""
    o, a, to = ("log it", "o2"), ("aia art. 26(9)", "gdpr art. 35"), ("deployer", "sys")
    edges = [("APPLIES_TO", x, y, f"c{i}") for x in o for y in to for i in range(5)] + [("IMPOSES", x, y, f"c{i}") for x in a for y in o for i in range(3, 8)]
    edges += [("CLASSIFIED_AS", "sys", "high", "c9"), ("ENFORCED_BY", "o2", "deployer", "c1"), ("PENALIZED_UNDER", "log it", "gdpr art. 35", "c1"), ("DEFINED_IN", "o2", "aia annex viii", "c2")]
    return make([*edges, ("INTERACTS_WITH", *a, "c1"), ("INTERACTS_WITH", a[1], a[0], "c1"), ("INTERACTS_WITH", a[0], a[0], "c2")])


def test_rows_of_calls_are_counted_without_joining_them(make, spark):
    edges = _dense(make).edges
    for t, build in G.BUILDERS.items():
        want = {r[0]: r[1] for r in build(edges).groupBy(G.ANCHORS[t]).count().collect()}
        names = [*want, "nothing"]
        calls = spark.createDataFrame([(i, 0, t, n, None) for i, n in enumerate(names)], "qid int, call int, template string, a string, b string")
        assert {names[r.qid]: r.n_rows for r in G.report(calls, edges).collect()} == want | {"nothing": 0}
        plan = G.row_counts(edges, t)._jdf.queryExecution().optimizedPlan().toString()
        assert "collect_set" not in plan  # no leg gathers its chunks to be counted


def test_legs_told_alone_are_those_of_the_rows(make):
    edges = cut(_dense(make).edges)
    for t, build in G.BUILDERS.items():
        alone = G.told_alone(edges, t)
        assert {tuple(r) for r in alone.collect()} == {tuple(r) for r in G.told(build(edges), t).collect()}
        assert "Join Inner" not in alone._jdf.queryExecution().optimizedPlan().toString()  # nothing is multiplied


def test_search_words_a_shared_sentence_once_and_joins_no_chunks(make, spark, monkeypatch):
    g = _dense(make)
    labels = spark.createDataFrame([(f"c{i}", f"L{i}") for i in range(8)] + [("c9", None)], "chunk_id string, citation_label string")
    kept = []
    monkeypatch.setattr(G, "cut", lambda df: kept.append(df.columns) or cut(df))
    plan = [("obligations_for_role", "deployer"), ("obligations_for_system", "sys"), ("cross_regulation", "gdpr art. 35")]
    calls = [(q, i, *plan[i], None) for q in (1, 2) for i in range(3)] + [(3, 0, *plan[1], None)]
    said, _ = G.search(spark.createDataFrame(calls, "qid int, call int, template string, a string, b string"), g, labels, strict=False)
    got = {q: {(r.call, r.statement, r.n_chunks) for r in said.where(F.col("qid") == q).collect()} for q in (1, 2, 3)}
    imposed = {(f"{a} imposes: {o}.", 5) for a in ("AIA Art. 26(9)", "GDPR Art. 35") for o in ("log it", "o2")}
    system = {(f"{o} applies to Sys.", 5) for o in ("log it", "o2")}
    assert got[3] == {(0, *x) for x in imposed | system}  # the classification's chunk has no label
    role = imposed | {(f"{o} applies to deployer.", 5) for o in ("log it", "o2")}
    meets = {("AIA Art. 26(9) interacts with GDPR Art. 35.", 1), ("GDPR Art. 35 interacts with AIA Art. 26(9).", 1)}
    assert got[1] == got[2] == {(0, *x) for x in role} | {(1, *x) for x in system} | {(2, *x) for x in meets}
    assert not any("imposes_chunks" in c for c in kept)


def test_provenance_within_the_chunks_asked_for(make, spark):
    edges = cut(_dense(make).edges)
    calls = [(i, 0, t, a, None) for i, (t, a) in enumerate([("obligations_for_role", "deployer"), ("obligations_for_system", "sys"), ("enforcement_chain", "log it"), ("definition_of", "o2"), ("cross_regulation", "gdpr art. 35"), ("cross_regulation", "sys"), ("path_between", "sys")])]
    calls = spark.createDataFrame(calls, "qid int, call int, template string, a string, b string")
    whole = {(r.qid, r.chunk) for r in G.provenance(calls, edges).collect()}
    assert whole == {(q, f"c{i}") for q in (0, 1) for i in range(8)} | {(1, "c9"), (3, "c2"), (4, "c1")}
    asked = {(q, c) for q in range(7) for c in ("c1", "c5", "c9")}
    some = {(r.qid, r.chunk) for r in G.provenance(calls, edges, spark.createDataFrame(sorted(asked), "qid int, chunk string")).collect()}
    assert some == whole & asked | {(q, None) for q, _ in whole}
