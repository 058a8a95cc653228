from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from quillgraph.schemas import CHUNK, DECISION
from quillgraph.sources import jsonl, law_html, providers
from quillgraph.streaming import log_stream

ACT = """<html xmlns="http://www.w3.org/1999/xhtml"><head><meta><script></head><body>
<div id="art_1"><p class="oj-ti-art">Article 1</p><div class="eli-title"><p class="oj-sti-art">Subject matter`</p></div>
<div id="001.001"><p>1.&#160;&#160; The first<span class="oj-note-tag">7</span> rule, <span>in</span>line.</p><table><tbody><tr><td>(a)</td><td>one</td></tr><tr><td>(b)</td><td>two</td></tr></tbody></table></div>
<div id="001.002"><p>No marker.</p></div></div>
<div id="art_2"><p class="oj-ti-art">Article 2</p><p>Plain</p><p>prose.</p><div><div id="002.009">deep</div></div></div>
<div id="art_3"><table><tbody><tr><td>(1)</td><td>term means x</td></tr></tbody></table><table><tbody><tr><td>no</td><td>skip</td></tr></tbody></table></div>
<div id="anx_VIII"><p class="oj-doc-ti">ANNEX VIII</p><p class="oj-doc-ti">Information</p><p class="oj-ti-grseq-1">Section A</p>
<table><tbody><tr><td>1.</td><td>Name</td></tr><tr><td>(a)</td><td>sub</td></tr></tbody></table><p class="oj-ti-grseq-1">Section B - x</p><table><tbody><tr><td>1.</td><td>Other</td></tr></tbody></table><p class="oj-normal">tail</p></div>
<div id="anx_II"><p class="oj-doc-ti">ANNEX II</p><p>a</p><p>b</p></div></body></html>"""


def test_act_parsing(spark):
    rows = law_html.parse_acts(spark.createDataFrame([("f", ACT)], "path string, content string"), (3,)).collect()
    by = {(r.article, r.paragraph, r.definition, r.annex, r.section, r.point): r.text for r in rows}
    assert by[1, 1, None, None, None, None] == "The first rule, inline. (a) one (b) two"
    assert by[1, 2, None, None, None, None] == "No marker." and by[2, 1, None, None, None, None] == "Plain prose. deep"
    assert by[3, None, 1, None, None, None] == "term means x"
    assert by[None, None, None, "VIII", "A", 1] == "Name (a) sub" and by[None, None, None, "VIII", "B", 1] == "Other tail"
    assert by[None, None, None, "II", None, 1] == "a b" and len(rows) == 7
    assert {r.article_title for r in rows if r.article == 1} == {"Subject matter"} and {r.annex_title for r in rows if r.annex == "VIII"} == {"Information"}
    with pytest.raises(ValueError):
        law_html.body("<p>")


ANNEXES = """<html><body><div id="anx_I"><p class="oj-doc-ti">ANNEX I</p>
<table><tbody><tr><td>(a)</td><td>loose</td></tr><tr><td>only<table><tbody><tr><td>9.</td><td>nested</td></tr></tbody></table></td></tr></tbody></table>
<div class="oj-enumeration-spacing"><p>unmarked</p></div><p class="oj-ti-grseq-1">7. Seven</p><p class="oj-normal">more</p><p>ignored</p>
<table><tbody><tr><td>-</td><td>of seven</td></tr><tr><td>8.</td><td></td></tr></tbody></table></div>
<div id="anx_III"><p class="oj-normal">before any point</p><p class="oj-ti-grseq-1">1.Part</p></div></body></html>"""


def test_annex_points_without_numbers(spark):
    rows = law_html.parse_acts(spark.createDataFrame([("f", ANNEXES)], "path string, content string")).collect()
    assert {(r.annex, r.section, r.point): r.text for r in rows} == {("I", None, 1): "(a) loose", ("I", None, 2): "only 9. nested", ("I", None, 3): "unmarked", ("I", None, 7): "Seven more - of seven", ("I", None, 8): "", ("III", None, 1): "Part"}
    assert law_html.parse_acts(spark.createDataFrame([], "path string, content string")).count() == 0


def test_strict_reads(spark, tmp_path):
    good = '{"chunk_id":"a","regulation":"AIA","shape":"paragraph","citation_label":"l","text":"é","entity_ids":[]}'
    (tmp_path / "1.jsonl").write_text(good + "\n\n")
    (tmp_path / "2.jsonl").write_text(good.replace('"a"', '"b"') + "\n")
    assert [r.chunk_id for r in jsonl.read_strict(spark, [str(tmp_path / "1.jsonl"), str(tmp_path / "2.jsonl")], CHUNK).collect()] == ["a", "b"]
    for bad in (good.replace('"text"', '"txt"'), "{broken", good.replace("[]", '"x"')):
        (tmp_path / "3.jsonl").write_text(bad)
        with pytest.raises(Exception, match="(unknown fields|MALFORMED|FAILFAST|malformed)"):
            jsonl.read_strict(spark, [str(tmp_path / "3.jsonl")], CHUNK).collect()


def test_upsert_file_is_idempotent(spark, tmp_path):
    path = str(tmp_path / "t")
    schema = spark.createDataFrame([], "k string, v int").schema
    jsonl.write(spark.createDataFrame([("a", 1), ("b", 2)], schema), path)
    for _ in range(2):
        jsonl.upsert_file(spark, path, schema, spark.createDataFrame([("b", 3)], schema), "k")
        assert {(r.k, r.v) for r in spark.read.schema(schema).json(path).collect()} == {("a", 1), ("b", 3)}


def test_log_and_stream(spark, tmp_path):
    path = str(tmp_path / "log")
    assert jsonl.log_read(spark, path).count() == 0
    row = dict.fromkeys(DECISION.fieldNames()) | {"run_id": "r", "question_id": "q", "route": "graph", "latency_ms": 2.0, "ts": "2025-01-01T00:10:00Z"}
    for q in ("q", "q", "p"):
        jsonl.log_append(spark.createDataFrame([tuple((row | {"question_id": q}).values())], DECISION), path)
    assert jsonl.log_read(spark, path).count() == 3
    jsonl.log_append(spark.createDataFrame([tuple((row | {"ts": None, "question_id": "z"}).values())], DECISION), path)
    assert jsonl.log_read(spark, path).where("ts is null").count() == 0
    out, ck = str(tmp_path / "out"), str(tmp_path / "ck")
    for _ in range(2):
        log_stream.start(log_stream.stream(spark, path), out, ck).awaitTermination(120)
        assert spark.read.parquet(out).count() == 3
    counts = log_stream.route_counts(spark.read.parquet(out)).collect()
    assert sum(r.n for r in counts) == 3
    assert len(spark.range(1).select(jsonl.run_id().alias("r")).first().r) == 25


def test_provider_cache_and_retries(spark):
    req = spark.createDataFrame([("x",), ("x",), ("y",), (None,)], "request string")
    first, _ = providers.ask(req, lambda b: [s.upper() for s in b])
    kept = spark.createDataFrame([(r.key, r.request, r.answer) for r in first.where("request = 'x'").collect()], "key string, request string, answer string")
    both, new = providers.ask(req, lambda b: ["new"] * len(b), kept)
    assert {(r.request, r.answer) for r in both.collect()} == {("x", "X"), ("y", "new")} and new.count() == 1
    calls = []

    def flaky(b):
        calls.append(1)
        if len(calls) < 3:
            raise TimeoutError
        return b

    assert providers.with_retries(flaky, wait=0)(["a"]) == ["a"] and len(calls) == 3
    with pytest.raises(ValueError):
        providers.with_retries(lambda b: [], wait=0)(["a"])


def test_rerank_and_embedding(spark):
    pairs = spark.createDataFrame([(1, 0, "risk system", "nothing"), (1, 1, "risk system", "a system of risk"), (1, 2, "risk system", "also a risk system")], "qid int, pos int, question string, text string")
    r = providers.rerank(pairs, 2).orderBy("rank").collect()
    assert [(x.rank, x.pos, x.relevance) for x in r] == [(1, 1, 1.0), (2, 2, 1.0)]
    with pytest.raises(Exception, match="blank"):
        providers.rerank(pairs.withColumn("text", F.lit(" ")), 1).collect()
    e = providers.embed_texts(spark.createDataFrame([("a", "risk risk"), ("b", None)], "k string, t string"), "k", "t").collect()
    assert abs(sum(x * x for x in e[0].embedding) - 1) < 1e-6 and e[1].embedding is None
