from __future__ import annotations

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillgraph.operators import assembly as A
from quillgraph.operators import cite as C
from quillgraph.operators import route as R


def _fold(spark, docs):
    s = spark.createDataFrame([(docs,)], "d array<struct<id:string,text:string>>")
    return [(r.id, r.text) for r in s.select(F.inline(A.dedupe_two_keys(F.col("d")))).collect()]


def test_two_key_dedupe_counts_only_kept(spark):
    assert _fold(spark, [("i1", "t1"), ("i2", "t1"), ("i2", "t3")]) == [("i1", "t1"), ("i2", "t3")]


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(st.sampled_from("abc"), st.sampled_from("xyz")), max_size=7))
def test_two_key_dedupe_brute_force(spark, docs):
    kept = []
    for d in docs:
        if not any(k[0] == d[0] or k[1] == d[1] for k in kept):
            kept.append(d)
    assert _fold(spark, docs) == kept


def test_round_robin_and_budgets(spark):
    d = spark.createDataFrame([(1, 0, 0, "a"), (1, 0, 1, "b"), (1, 0, 2, "c"), (1, 1, 3, "Deployer d")], "qid int, call int, pos int, text string")
    assert [r.pos for r in A.round_robin(d, 3).orderBy("at").collect()] == [0, 3, 1]
    names = spark.createDataFrame([(1, ["deployer", ""])], "qid int, names array<string>")
    assert [r.pos for r in A.budget_anchor(d, names, 2).orderBy("at").collect()] == [3, 0]
    assert A.budget_anchor(d, names.limit(0), 2).orderBy("at").first().pos == 0


def test_assemble_order_and_ids(spark):
    g = spark.createDataFrame([(1, 0, "g", "s1"), (1, 1, "h", "s1")], "qid int, pos int, id string, text string")
    p = spark.createDataFrame([(1, 0, "c1", "t1"), (1, 1, "c1", "t2"), (1, 2, "c2", "t3")], "qid int, pos int, id string, text string")
    assert [(r.document_id, r.id, r.source) for r in A.assemble(g, p, 50).orderBy("document_id").collect()] == [("d0", "g", "GRAPH"), ("d1", "c1", "PASSAGE"), ("d2", "c2", "PASSAGE")]


def test_spans_are_code_points(spark):
    r = spark.createDataFrame([("ré 𝒳y", 1, 3, "é "), ("ab", 1, 3, "b"), ("ab", -1, 1, "a"), (None, 0, 1, "a")], "a string, s int, e int, t string")
    assert [x.ok for x in r.select(C.span_fits(*map(F.col, "aset")).alias("ok")).collect()] == [True, False, False, False]


def test_rebase_and_defects(spark):
    blocks = A.offsets(spark.createDataFrame([(1, 0, "abc"), (1, 1, None), (1, 2, "defg")], "qid int, i int, text string"))
    cites = spark.createDataFrame([(1, 2, 1, 3, "ef", "d0"), (1, 2, 1, 9, "ef", "d0"), (1, 7, 0, 1, "x", "d0"), (1, 0, 0, 1, "z", "d0"), (1, 0, 0, 1, "a", None)], "qid int, i int, start int, end int, text string, document_id string")
    got = {(r.start, r.dropped) for r in C.rebase(cites, blocks).collect()}
    assert got == {(4, None), (4, "out of range"), (None, "no such block"), (0, "other text"), (0, "no document")}
    v = spark.createDataFrame([("out-of-scope", "correct_refusal", 1), ("two-hop", "correct", 0), ("two-hop", "wrong", 0), ("two-hop", "correct", 2)], "s string, v string, n int")
    assert [x.c for x in v.select(C.cap_verdict(F.col("v"), C.citation_defect(F.col("s"), F.lit(True), F.col("n"))).alias("c")).collect()] == ["partially_correct", "partially_correct", "wrong", "correct"]
    assert A.joined_spans(spark.createDataFrame([(1, 0, "ab"), (1, 1, "c")], "qid int, i int, text string")).orderBy("i").collect()[1][2:] == (3, 4)


def _nodes(spark):
    rows = [("SystemType", "high risk ai system", "high-risk AI system", []), ("SystemType", "ai system", "AI system", []), ("Authority", "notified body", "notified body", ["body"]), ("ActorRole", "deployer", "deployer", []), ("Regulation", "gdpr", "GDPR", []), ("Obligation", "log", "log", [])]
    return spark.createDataFrame(rows, "type string, canonical_name string, display_name string, aliases array<string>")


def test_link_longest_first_plural_and_possessive(spark):
    q = spark.createDataFrame([(1, "Is this a high-risk AI system?"), (2, "Does it require a notified body?"), (3, "List the deployers' duties, and who enforces the GDPR's rules"), (4, "nothing here"), (5, "")], "qid int, question string")
    linked = R.link(q, _nodes(spark))
    got: dict[int, list[str]] = {}
    for r in linked.orderBy("qid", "at").collect():
        got.setdefault(r.qid, []).append(r.name)
    assert got == {1: ["high risk ai system"], 2: ["notified body"], 3: ["gdpr"]} or got == {1: ["high risk ai system"], 2: ["notified body"], 3: ["deployer", "gdpr"]}
    routes = {r.qid: (r.route, r.rule) for r in R.route(q, linked).collect()}
    assert routes[4] == ("vector", "R1-no-links") and routes[2] == ("vector", "R2-no-anchor") and routes[1] == ("vector", "R5-default")


def test_plans(spark):
    q = spark.createDataFrame([(1, "What is the definition of deployer under the GDPR log?"), (2, "x")], "qid int, question string")
    linked = R.link(q, _nodes(spark))
    p = {r.qid: r for r in R.plan_text(R.select_templates(q, linked)).collect()}
    assert p[1].rule == "S1-definitional+S2-obligation+S3-cross-instrument" and p[2].rule == "S0-none" and p[2].plan == ""
    calls, bad = R.parse_plan("- definition_of term=high risk ai system\ndrop all\npath_between entity_a=x\npath_between entity_a=a b entity_b=c")
    assert calls == [("definition_of", {"term": "high risk ai system"}), ("path_between", {"entity_a": "a b", "entity_b": "c"})] and len(bad) == 2
    assert R.parse_plan("none\n* None\n\n") == ([], [])
    twice = "\n".join(f"definition_of term={x}" for x in "abcd")
    assert [c[1]["term"] for c in R.parse_plan(twice)[0]] == ["a", "b", "c"] and R.parse_plan("definition_of a term=b") == ([], ["definition_of a term=b"])
    assert [tuple(r) for r in R.plan_calls(R.select_templates(q, linked)).select("qid", "call", "template", "a").where("call = 1").collect()] == [(1, 1, "enforcement_chain", "log")]
    offers = spark.createDataFrame([(1, "deployer", "ActorRole"), (1, "log", "Obligation"), (2, "x", "Penalty")], "qid int, name string, type string")
    assert {(r.qid, r.template) for r in R.single_calls(offers).collect()} == {(1, "definition_of"), (1, "obligations_for_role"), (1, "enforcement_chain"), (2, "definition_of")}


def test_enumeration_target(spark):
    q = spark.createDataFrame([("Which areas of Annex III and Article 6?",), ("GDPR articles 5",), ("annex iiii",)], "q string")
    assert [r.t for r in q.select(R.enumeration_target(F.col("q")).alias("t")).collect()] == ["AIA annex III", "GDPR article 5", None]
