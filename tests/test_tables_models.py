from __future__ import annotations

import json

import numpy as np
import pytest

from quillgraph.operators import vector as V
from quillgraph.sources import models as M
from quillgraph.sources import tables as T


def test_tables(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int")
    name = f"t{tmp_path.name.replace('-', '_')}"
    spark.sql(f"DROP TABLE IF EXISTS {name}")
    spark.sql(f"CREATE TABLE {name} (k string, v int) USING parquet LOCATION '{tmp_path}/t'")
    for _ in range(2):
        T.ensure_table(spark, name, rows.schema)
    with pytest.raises(ValueError, match="another schema"):
        T.ensure_table(spark, name, rows.select("k").schema)
    T.append_checked(rows, name, ("k",))
    with pytest.raises(ValueError, match="repeated"):
        T.append_checked(rows.limit(1), name, ("k",))
    assert spark.table(name).count() == 2
    T.reset(spark, name)
    assert spark.table(name).count() == 0
    T.append_durably(rows, f"{tmp_path}/log")
    T.append_durably(rows, f"{tmp_path}/log")
    assert spark.read.json(f"{tmp_path}/log").count() == 4
    spark.sql(f"DROP TABLE {name}")


def test_stored_index(spark, tmp_path):
    rng = np.random.default_rng(1)
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(rng.normal(size=(100, 6)))], "vec_id bigint, embedding array<float>")
    cells = V.fit_cells(df, 5)
    path = f"file://{tmp_path}/index"
    T.build_index(df, cells, path)
    q = df.where("vec_id < 5")
    assert sorted(V.top_k_cells(spark.read.parquet(path), q, 3, cells, 5).collect()) == sorted(V.top_k(df, q, 3).collect())
    assert T.drop_index(spark, path) and not T.drop_index(spark, path)


def test_extraction_is_repaired_once(spark):
    good = M.as_json([{"type": "Article", "canonical_name": "aia art. 9", "aliases": []}], [{"type": "REFERENCES", "head": "a", "tail": "b", "source_chunk_id": "elsewhere", "confidence": 0.5}])
    bad = good.replace("Article", "Planet")
    chunks = spark.createDataFrame([("c1", "L1", "fine"), ("c2", "L2", "wrong"), ("c3", "L3", "broken")], "chunk_id string, citation_label string, text string")
    provider = M.recorded({"L1": f"```json\n{good}\n```", "Give only the JSON": good, "L2": bad, "L3": "no"})
    got = {r.chunk_id: r for r in M.extract(chunks.where("chunk_id <> 'c3'"), provider, "Extract.").collect()}
    assert got["c1"].attempts == 1 and got["c1"].defect is None and got["c1"].relationships[0].source_chunk_id == "c1"
    assert got["c2"].attempts == 2 and got["c2"].entities[0].type == "Article"
    lost = M.extract(chunks.where("chunk_id = 'c3'"), M.recorded({}, "no"), "Extract.").first()
    assert lost.defect == "no valid extraction" and lost.entities is None


def test_model_router_plans_answers_and_judge(spark):
    q = spark.createDataFrame([(1, "one"), (2, "two"), (3, None)], "qid int, question string")
    assert {r.qid: r.route for r in M.route_by_model(q, M.recorded({"one": " Graph. ", "two": "graph or vector"}), "Route.").collect()} == {1: "graph", 2: None, 3: None}
    plans = {r.qid: r for r in M.plans_by_model(q, M.recorded({"one": "definition_of term=log\nDROP x=y", "two": "none"}), "Plan.").collect()}
    assert plans[1].calls[0].params == {"term": "log"} and plans[1].rejected == ["DROP x=y"] and plans[2].calls == [] == plans[2].rejected
    answer = json.dumps({"blocks": ["ab", "cde"], "citations": [{"i": 1, "start": 0, "end": 2, "text": "cd", "document_id": "d0"}, {"i": 1, "start": 0, "end": 9, "text": "x", "document_id": "d0"}]})
    said, cited = M.generate(spark.createDataFrame([(1, "p")], "qid int, prompt string"), M.recorded({"p": answer}))
    assert said.first().answer == "abcde" and {(r.start, r.end, r.dropped) for r in cited.collect()} == {(2, 4, None), (2, 11, "out of range")}
    pairs = spark.createDataFrame([("a", "q", "x", "r"), ("b", "q", "y", None)], "id string, question string, answer string, reference string")
    assert {r.id: r.verdict for r in M.judge(pairs, M.recorded({"x": '{"verdict": "Partially correct"}', "y": "maybe"}), "Grade.").collect()} == {"a": "partially_correct", "b": None}
