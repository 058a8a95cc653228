"""Model-backed operators behind a provider: a callable per operator, run in batches on the executors.

Offline stand-ins are deterministic. A provider retries by itself; a task retry would bill twice, so answers are kept
in a table keyed by the request's hash and only missing ones are asked for.
"""

from __future__ import annotations

import hashlib
import random
import re
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.plans.runtime import ship

BATCH, ATTEMPTS = 96, 6
Provider = Callable[[list[str]], list[str]]


def with_retries(call: Provider, transient: tuple[type[Exception], ...] = (ConnectionError, TimeoutError), attempts: int = ATTEMPTS, wait: float = 0.5) -> Provider:
    """Exponential waits with jitter on transient errors only."""

    def run(batch: list[str]) -> list[str]:
        for i in range(attempts):
            try:
                out = call(batch)
                if len(out) != len(batch):
                    raise ValueError(f"{len(out)} answers to {len(batch)} requests")
                return out
            except transient:
                if i == attempts - 1:
                    raise
                time.sleep(wait * 2**i * (0.5 + random.random()))
        raise AssertionError

    return run


def request_key(request: str = "request", version: str = "1"):
    return F.sha2(F.concat_ws("\n", F.lit(version), F.col(request)), 256)


def ask(requests: DataFrame, provider: Provider, kept: DataFrame | None = None, version: str = "1", batch: int = BATCH) -> tuple[DataFrame, DataFrame]:
    """requests(request) -> ``(answers(key, request, answer), new ones only)``; equal requests are asked once."""
    ship(requests.sparkSession)
    call = with_retries(provider)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in parts:
            for i in range(0, len(df), batch):
                b = df.iloc[i : i + batch]
                yield b.assign(answer=call(b["request"].tolist()))

    wanted = requests.select("request").where(F.col("request").isNotNull()).distinct().withColumn("key", request_key(version=version))
    todo = wanted.join(kept.select("key"), "key", "left_anti") if kept is not None else wanted
    new = todo.select("key", "request").mapInPandas(run, "key string, request string, answer string")
    if kept is None:
        return new, new
    return wanted.join(kept.select("key", "answer"), "key").select("key", "request", "answer").unionByName(new), new


def hashed_embedding(dim: int = 64) -> Callable[[str], list[float]]:
    """Stand-in for an embedding model: signed feature hashing of words, unit length."""

    def embed(text: str) -> list[float]:
        v = [0.0] * dim
        for w in re.findall(r"[a-z0-9]+", text.lower()):
            h = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "little")
            v[h % dim] += 1.0 if h >> 63 else -1.0
        n = sum(x * x for x in v) ** 0.5
        return [x / n for x in v] if n else v

    return embed


def embed_texts(texts: DataFrame, key: str, text: str, dim: int = 64) -> DataFrame:
    ship(texts.sparkSession)
    embed = hashed_embedding(dim)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in parts:
            yield pd.DataFrame({key: df[key], "embedding": [embed(t) if t else None for t in df[text]]})

    return texts.select(key, text).mapInPandas(run, f"{key} {texts.schema[key].dataType.simpleString()}, embedding array<float>")


def overlap_relevance(question: str, document: str) -> float:
    """Stand-in for a cross-encoder: share of the question's words the document has."""
    q = set(re.findall(r"[a-z0-9]+", question.lower()))
    return len(q & set(re.findall(r"[a-z0-9]+", document.lower()))) / len(q) if q else 0.0


def rerank(pairs: DataFrame, top: int, relevance: Callable[[str, str], float] = overlap_relevance) -> DataFrame:
    """pairs(qid, pos, question, text): the ``top`` most relevant per question, ties in the order given; a blank text is an error."""
    ship(pairs.sparkSession)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in parts:
            if df["text"].fillna("").str.strip().eq("").any():
                raise ValueError("a document to rerank is blank")
            yield df.assign(relevance=[round(relevance(q, t), 6) for q, t in zip(df["question"], df["text"], strict=True)])

    scored = pairs.select("qid", "pos", "question", "text").mapInPandas(run, f"qid {pairs.schema['qid'].dataType.simpleString()}, pos {pairs.schema['pos'].dataType.simpleString()}, question string, text string, relevance double")
    best = scored.groupBy("qid").agg(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("relevance")).alias("r"), "pos"))), 1, top).alias("b"))
    return best.select("qid", F.posexplode("b").alias("rank", "b")).select("qid", (F.col("rank") + 1).alias("rank"), "b.pos", (-F.col("b.r")).alias("relevance"))
