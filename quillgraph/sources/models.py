"""Operators backed by a language model, as compositions of a prompt, ``providers.ask`` and a strict reading of the answer.

A provider is a callable from requests to answers; nothing is read from an answer that its format does not hold, and
what cannot be read is reported, never repaired by guessing (an extraction alone may be asked for once more).
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillgraph.functions.text import json_object, parse_route
from quillgraph.operators.cite import rebase
from quillgraph.operators.route import parse_plan
from quillgraph.operators.scores import verdict_key
from quillgraph.plans.runtime import cut
from quillgraph.schemas import ENDPOINTS, ENTITY, RELATION, TYPE_PRIORITY
from quillgraph.sources.providers import Provider, ask

_BODY = T.StructType([T.StructField("entities", T.ArrayType(ENTITY)), T.StructField("relationships", T.ArrayType(RELATION))])


def asked(rows: DataFrame, prompt: Column, provider: Provider, kept: DataFrame | None = None, version: str = "1") -> DataFrame:
    """rows with the provider's ``answer`` to each one's prompt; equal prompts are asked once, a null prompt not at all."""
    r = rows.withColumn("request", prompt)
    answers = cut(ask(r.select("request"), provider, kept, version)[0].select("request", "answer"))
    return r.join(answers, "request", "left").drop("request")


def _read(answers: DataFrame) -> DataFrame:
    """``x`` read from the answer's JSON, null where it breaks the closed lists or the format."""
    x = F.from_json(json_object(F.col("answer")), _BODY, {"mode": "PERMISSIVE"})
    types = F.forall(F.coalesce("x.entities", F.array().cast("array<struct<type:string,canonical_name:string,aliases:array<string>>>")), lambda e: e["type"].isin(*TYPE_PRIORITY) & (F.length(F.trim(e["canonical_name"])) > 0))
    edges = F.forall(F.coalesce("x.relationships", F.array().cast("array<struct<type:string,head:string,tail:string,source_chunk_id:string,confidence:double>>")), lambda r: r["type"].isin(*ENDPOINTS) & r["head"].isNotNull() & r["tail"].isNotNull() & r["confidence"].between(0, 1))
    good = F.coalesce(types & edges & (F.col("x.entities").isNotNull() | F.col("x.relationships").isNotNull()), F.lit(False))
    return answers.withColumn("x", x).withColumn("x", F.when(good, F.col("x")))


def extract(chunks: DataFrame, provider: Provider, instruction: str, kept: DataFrame | None = None) -> DataFrame:
    """chunks(chunk_id, citation_label, text) -> ``chunk_id, entities, relationships, attempts, defect``, one paragraph each.

    An answer that is no valid extraction is asked for once more with its defect named; then it is reported. The chunk
    read from beats the one a relation claims.
    """
    prompt = F.concat(F.lit(instruction + "\n\n"), F.col("citation_label"), F.lit("\n"), F.col("text"))
    first = cut(_read(asked(chunks.select("chunk_id", "citation_label", "text"), prompt, provider, kept)))
    again = first.where(F.col("x").isNull()).drop("answer", "x")
    repair = F.concat(prompt, F.lit("\n\nYour last answer was no valid JSON of this schema. Give only the JSON."))
    second = _read(asked(again, repair, provider, kept))
    both = first.where(F.col("x").isNotNull()).withColumn("attempts", F.lit(1)).unionByName(second.withColumn("attempts", F.lit(2)))
    own = F.transform("x.relationships", lambda r: r.withField("source_chunk_id", F.col("chunk_id")))
    return both.select("chunk_id", F.col("x.entities").alias("entities"), own.alias("relationships"), "attempts", F.when(F.col("x").isNull(), "no valid extraction").alias("defect"))


def route_by_model(questions: DataFrame, provider: Provider, instruction: str, kept: DataFrame | None = None) -> DataFrame:
    """questions(qid, question) -> ``qid, route, raw``; an answer that is not exactly one route is null."""
    r = asked(questions.select("qid", "question"), F.concat(F.lit(instruction + "\n\n"), F.col("question")), provider, kept)
    return r.select("qid", parse_route(F.col("answer")).alias("route"), F.col("answer").alias("raw"))


def plans_by_model(questions: DataFrame, provider: Provider, instruction: str, kept: DataFrame | None = None) -> DataFrame:
    """questions(qid, question) -> ``qid, calls(template, params), rejected``: validated before anything can run."""

    @F.udf("struct<calls:array<struct<template:string,params:map<string,string>>>,rejected:array<string>>", useArrow=True)
    def read(text: str | None):
        calls, rejected = parse_plan(text or "")
        return {"calls": [{"template": t, "params": p} for t, p in calls], "rejected": rejected}

    r = asked(questions.select("qid", "question"), F.concat(F.lit(instruction + "\n\n"), F.col("question")), provider, kept)
    return r.select("qid", read("answer").alias("r")).select("qid", "r.calls", "r.rejected")


def generate(prompts: DataFrame, provider: Provider, kept: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """prompts(qid, prompt), answered with JSON {"blocks": [text], "citations": [{i, start, end, text, document_id}]} ->
    ``(answers(qid, answer), citations)``: blocks joined, citations moved to the answer's offsets or dropped with the reason."""
    kind = "struct<blocks:array<string>,citations:array<struct<i:int,start:int,end:int,text:string,document_id:string>>>"
    r = cut(asked(prompts.select("qid", "prompt"), F.col("prompt"), provider, kept).select("qid", F.from_json(json_object(F.col("answer")), kind).alias("x")))
    before = lambda i: F.aggregate(F.slice("x.blocks", 1, i), F.lit(0), lambda n, b: n + F.length(b))
    blocks = r.select("qid", "x", F.posexplode("x.blocks").alias("i", "text")).select("qid", "i", "text", before(F.col("i")).alias("offset"))
    return r.select("qid", F.array_join("x.blocks", "").alias("answer")), rebase(r.select("qid", F.inline("x.citations")), blocks)


def judge(pairs: DataFrame, provider: Provider, rubric: str, kept: DataFrame | None = None) -> DataFrame:
    """pairs(id, question, answer, reference) -> ``id, verdict, raw``; an answer that names no verdict is null."""
    p = pairs.select("id", "question", F.col("answer").alias("given"), "reference")
    prompt = F.concat_ws("\n\n", F.lit(rubric), F.col("question"), F.coalesce("reference", F.lit("")), F.coalesce("given", F.lit("")))
    r = asked(p, prompt, provider, kept)
    said = F.coalesce(F.get_json_object(json_object(F.col("answer")), "$.verdict"), F.col("answer"))
    return r.select("id", verdict_key(said).alias("verdict"), F.col("answer").alias("raw"))


def recorded(answers: dict[str, str], otherwise: str = "") -> Callable[[list[str]], list[str]]:
    """A deterministic provider for tests and replays: the answer recorded for whichever key a request contains."""
    return lambda batch: [next((a for k, a in sorted(answers.items()) if k in r), otherwise) for r in batch]


def as_json(entities: list[dict], relationships: list[dict]) -> str:
    return json.dumps({"entities": entities, "relationships": relationships})
