from __future__ import annotations

from pyspark.sql import functions as F

from quillgraph.functions.text import ABBREVIATIONS, json_object, labels_in, name_key, normalise, normalised, parse_route, query_terms, redact, words
from quillgraph.functions.unicode import WHITE_SPACE, reference_key
from quillgraph.operators import resolve as R
from quillgraph.operators.resolve import display_name, plural_map, reconcile


def test_normalise_cases():
    assert normalise("AIA Art. 1(1)") == "aia art. 1(1)"
    assert normalise("law-enforcement authority") == "law enforcement authority"
    assert normalise(" (a) stray]") == "(a) stray"
    assert normalise("“Café”") == "cafe"
    assert all(normalise(k) == v for k, v in ABBREVIATIONS.items())
    assert [normalise(x) for x in ("((a)", "(a))", ").", "", "a) (b", "[x].", "eu  AI-Act")] == ["(a)", "(a)", "", "", "a) (b", "[x]", "AI Act"]


def test_reference_key():
    assert reference_key(None) is None
    assert reference_key(" “High‑Risk   ÄI system”;") == "high risk ai system"
    assert len(WHITE_SPACE) == 25


def test_column_functions(spark):
    row = spark.createDataFrame([("AIA Annex III(1)(a) and AIA  Art. 9, AIA Art. 9", " Vector. ", 'x {"a": [1,],} y', "a of the the duty", "pw=secret", "Höhe—“X”,")], "a string, r string, j string, t string, s string, n string")
    r = row.select(
        labels_in(F.col("a")).alias("l"), parse_route(F.col("r")).alias("r"), json_object(F.col("j")).alias("j"), query_terms(F.col("t")).alias("t"), redact(F.col("s"), ["secret"]).alias("s"), name_key(F.col("n")).alias("n"), words(F.lit("")).alias("w"), normalised(F.col("n")).alias("m")
    ).first()
    assert r.l == ["AIA Annex III(1)(a)", "AIA Art. 9"] and r.r == "vector" and r.j == '{"a": [1]}' and r.t == ["the", "duty"] and r.s == "pw=***" and r.w == 0
    assert r.n == "höhe x" and r.m == "hohe x"


def test_plurals_need_an_attested_singular(spark):
    df = spark.createDataFrame([("deployer",), ("deployers",), ("premises",), ("duty",), ("duties",)], "key string")
    assert {(r.plural, r.singular) for r in plural_map(df).collect()} == {("deployers", "deployer"), ("duties", "duty")}


def test_reconcile_rules(spark):
    votes = [("org", "DefinedTerm", 18), ("org", "ActorRole", 1), ("org", "Authority", 1), ("certification body", "Authority", 5), ("certification body", "ActorRole", 5), ("x", "Right", 2), ("x", "Penalty", 2), ("one", "Annex", 1), ("y", "DefinedTerm", 1), ("y", "Right", 1)]
    got = {r.key: (r.type, r.rule) for r in reconcile(spark.createDataFrame(votes, "key string, type string, n bigint")).collect()}
    assert got["org"] == ("DefinedTerm", "majority")
    assert got["certification body"] == ("Authority", "tie, authority")
    assert got["x"] == ("Right", "tie, priority") and got["one"] == ("Annex", "single") and got["y"][0] == "Right"


def test_display_name(spark):
    df = spark.createDataFrame([("k", "A"), ("k", "A"), ("k", "bb"), ("k", "cc"), ("j", "x"), ("j", "yy")], "key string, raw string")
    assert {r.key: r.display for r in display_name(df).collect()} == {"k": "A", "j": "yy"}


def test_mentions_fold_before_voting(spark):
    rows = [("Deployer", "ActorRole", "c1"), ("deployers.", "ActorRole", "c2"), ("Déployers", "DefinedTerm", None), (None, "Right", "c"), (" ;", "Right", "c"), ("deployer", None, "c1")]
    m = R.mentions_of(spark.createDataFrame(rows, "raw string, type string, chunk_id string"))
    assert {(r.key, r.type, r.n) for r in R.type_votes(m).collect()} == {("deployer", "ActorRole", 2), ("deployer", "DefinedTerm", 1)}
    n = R.build_nodes(m, R.reconcile(R.type_votes(m)).select("key", "type")).collect()
    assert [tuple(r) for r in n] == [("deployer", "ActorRole", 4, 2, 3)]
    assert {r.alias for r in R.node_aliases(m).collect()} == {"Deployer", "deployers.", "Déployers"} and R.node_chunks(m).count() == 2


def test_repairs_and_gaps(spark):
    r = spark.createDataFrame([(" Regulation (EU) 2016/679", "a", "b"), ("other", "c", "c")], "name string, claimed string, true string")
    short = spark.createDataFrame([("regulation (eu) 2016/679", "GDPR")], "full string, short string")
    assert [(x.name, x.renamed) for x in R.instrument_names(r, "name", short).collect()] == [("GDPR", True), ("other", False)]
    assert [(x.claimed, x.repaired) for x in R.repaired_provenance(r, "claimed", "true").collect()] == [("b", True), ("c", False)]
    e = spark.createDataFrame([("c1", "x"), ("c1", "y"), ("c2", "aia art. 9")], "chunk_id string, key string")
    rel = spark.createDataFrame([("c1", "x", "z"), ("c1", "x", None)], "chunk_id string, head string, tail string")
    assert {tuple(g) for g in R.chunk_gaps(e, rel).collect()} == {("c1", "z", "dangling"), ("c1", "y", "orphan"), ("c2", "aia art. 9", "orphan")}
    chunks = spark.createDataFrame([("c2", "AIA", 9, 2), ("c1", "AIA", 3, 1)], "chunk_id string, regulation string, article int, paragraph int")
    assert [tuple(x) for x in R.granularity_misses(e, chunks).collect()] == [("c2", "aia art. 9", "aia art. 9(2)")]
