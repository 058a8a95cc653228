"""Mixing sources to target weights out of fixed-length blocks of tokens.

Each source's tokens are laid end to end and cut into blocks, the last of which may be short. Every output shard draws
its source counts from a multinomial, in a task of its own, from the shard's number alone. What the draws of all
shards together miss of what a source is due, or exceed it by, is a share of slots that shrinks with the root of their
number; these slots change their source, so totals are met exactly. A slot finds its block through a keyed permutation
of the source's block numbers, which needs no sort; blocks join by number.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillgraph.llm.tokens import VOCABULARY, tokenizer
from quillgraph.llm.truncation import source_name
from quillgraph.plans.runtime import cut

BLOCK_TOKENS = 512
#: Blocks of an output shard; documents of a bucket; shards of a prefix sum's bucket.
SHARD_BLOCKS, BUCKET_DOCS, BUCKET_SHARDS = 256, 20_000, 1_000


def permute(x: np.ndarray, n: int, key: str, back: bool = False) -> np.ndarray:
    """A keyed permutation of 0..n-1 at x, or where it takes x from: four Feistel rounds over the next even power of two, walked back into range."""
    half = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
    low = np.uint64((1 << half) - 1)
    keys = np.frombuffer(hashlib.blake2b(key.encode(), digest_size=32).digest(), np.uint64)

    def mixed(v: np.ndarray, k: np.uint64) -> np.ndarray:
        h = (v + k) * np.uint64(0x9E3779B97F4A7C15)
        h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
        return (h >> np.uint64(33)) & low

    out = x.astype(np.uint64)
    todo = np.ones(len(out), bool)
    while todo.any():
        left, right = out[todo] >> np.uint64(half), out[todo] & low
        for k in keys[::-1] if back else keys:
            left, right = (right ^ mixed(left, k), left) if back else (right, left ^ mixed(right, k))
        out[todo] = (left << np.uint64(half)) | right
        todo = out >= n
    return out.astype(np.int64)


def blocks_of(tokens: int, block: int) -> int:
    return -(-tokens // block)


def due(tokens: dict[str, int], targets: dict[str, tuple[float, int]], block: int, total: int | None = None) -> dict[str, int]:
    """Blocks due from each source. Without ``total``, the largest collection in which every source that has tokens
    holds its share (shares are scaled to those sources) and none is repeated more often than allowed. With it, a
    source that falls short gives all it may and the others share the rest by their weights. A block counts with the
    mean length of its source's blocks, as the last one may be short."""
    most = {s: r * tokens[s] for s, (w, r) in targets.items() if w > 0 and r > 0 and tokens.get(s, 0) > 0}
    if not most:
        return {}
    weight = sum(targets[s][0] for s in most)
    share = {s: max(targets[s][0] / weight, 1e-300) for s in most}
    want = min(most[s] / share[s] if share[s] * 1e18 > most[s] else 1e18 for s in most) if total is None else float(max(1, total))
    out, open_, left = {}, dict(share), want
    while open_:
        whole = sum(open_.values())
        short = [s for s in open_ if most[s] < open_[s] / whole * left]
        if not short:
            out |= {s: x / whole * left for s, x in open_.items()}
            break
        for s in short:
            out[s] = float(most[s])
            left -= most[s]
            del open_[s]
    return {s: min(targets[s][1] * blocks_of(tokens[s], block), round(x * blocks_of(tokens[s], block) / tokens[s])) for s, x in out.items()}


def repairs(drawn: dict[str, int], quota: dict[str, int]) -> tuple[dict[str, tuple[int, int]], list[tuple[str, int, int]]]:
    """How draws are turned into quotas: ``(surplus, lacking)``. surplus: source -> (slots to give up, number of the
    first of them); lacking: (source, first number, first new draw) in order of numbers, so slot k goes to the last
    entry at or before k."""
    surplus, lacking, given, taken = {}, [], 0, 0
    for s in sorted(quota):
        if (d := drawn.get(s, 0) - quota[s]) > 0:
            surplus[s] = (d, given)
            given += d
        elif d < 0:
            lacking.append((s, taken, drawn.get(s, 0)))
            taken -= d
    return surplus, lacking


def mix(sized: DataFrame, targets: DataFrame, key: str = "doc_id", block: int = BLOCK_TOKENS, total: int | None = None, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """``(collection, shares)`` from sized(key, source, n_tokens).

    collection: ``shard, slot, source, repeat, block, part, key, first, n``: the stretches of documents, in order,
    that make up each slot. shares: ``source, target_share, max_repeats, tokens_held, tokens, actual_share, repeats``
    for every target source, absent ones included.

    A source's last block may be short, and so may slots that draw it; shares count its real tokens. Documents of null
    or unlisted sources and those without tokens are not drawn. A target row of null weight or repeats counts as 0.
    Empty tables give an empty collection. The targets are a setting and stay on the driver, as do sums per source.
    """
    spark = sized.sparkSession
    rows = targets.select(source_name(F.col("source")).alias("source"), F.coalesce("target_share", F.lit(0.0)).alias("w"), F.coalesce("max_repeats", F.lit(0)).alias("r")).groupBy("source").agg(F.sum("w").alias("w"), F.max("r").alias("r")).collect()
    goal = {r.source: (r.w, r.r) for r in rows}
    listed = F.broadcast(spark.createDataFrame([(s,) for s in goal], "source string"))
    kind = sized.schema[key].dataType.simpleString()
    docs = sized.select(F.col(key).alias("key"), source_name(F.col("source")).alias("source"), "n_tokens").where("n_tokens > 0").join(listed, "source")
    buckets = max(1, -(-sized.count() // BUCKET_DOCS))
    docs = docs.withColumn("bucket", F.pmod(F.xxhash64("key"), F.lit(buckets)).cast("int"))
    # a prefix sum in two steps: over the few buckets of a source, and within a bucket of bounded size
    sums = cut(docs.groupBy("source", "bucket").agg(F.sum("n_tokens").alias("held")))
    before = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.withColumn("base", F.coalesce(F.sum("held").over(before), F.lit(0))).drop("held")
    within = Window.partitionBy("source", "bucket").orderBy("key", "n_tokens").rowsBetween(Window.unboundedPreceding, -1)
    placed = docs.withColumn("at", F.coalesce(F.sum("n_tokens").over(within), F.lit(0))).join(starts, ["source", "bucket"]).withColumn("at", F.col("at") + F.col("base"))
    held = {r.source: r.held for r in sums.groupBy("source").agg(F.sum("held").alias("held")).collect()}
    quota = {s: q for s, q in due(held, goal, block, total).items() if q > 0}
    names, want = sorted(quota), sum(quota.values())
    n_blocks = {s: blocks_of(held[s], block) for s in names}
    n_shards, per_shard = -(-want // SHARD_BLOCKS), SHARD_BLOCKS
    weights = np.array([quota[s] for s in names], float) / max(1, want)

    def draw(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts:
            shards = b.column(0).to_numpy()
            sizes = np.minimum(per_shard, want - shards * per_shard)
            counts = np.array([np.random.default_rng([seed, int(s)]).multinomial(int(n), weights) for s, n in zip(shards, sizes, strict=True)]).reshape(len(shards), len(names))
            at = np.cumsum(counts, axis=1) - counts
            i, j = np.nonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array(shards[i]), pa.array([names[x] for x in j.tolist()], pa.string()), pa.array(counts[i, j]), pa.array(at[i, j])], names=["shard", "source", "c", "at"])

    parts = max(1, min(n_shards, max(spark.sparkContext.defaultParallelism, n_shards // 500)))
    drawn = cut(spark.range(0, n_shards, 1, parts).mapInArrow(draw, "shard bigint, source string, c bigint, at bigint"))
    bucket = F.floor(F.col("shard") / BUCKET_SHARDS)
    totals = cut(drawn.groupBy("source", bucket.alias("bucket")).agg(F.sum("c").alias("held")))
    got = {r.source: r.c for r in totals.groupBy("source").agg(F.sum("held").alias("c")).collect()}
    surplus, lacking = repairs(got, quota)
    base = totals.withColumn("base", F.coalesce(F.sum("held").over(before), F.lit(0))).drop("held")
    earlier = Window.partitionBy("source", "bucket").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    numbered = drawn.withColumn("bucket", bucket).join(F.broadcast(base) if n_shards < BUCKET_SHARDS**2 else base, ["source", "bucket"]).withColumn("begin", F.col("base") + F.coalesce(F.sum("c").over(earlier), F.lit(0)))
    slots = numbered.select("shard", "source", "begin", "at", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("c") - 1)).alias("i"))
    slots = slots.select("shard", "source", (F.col("begin") + F.col("i")).alias("j"), (F.col("at") + F.col("i")).alias("slot"))

    def find(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        firsts = np.array([k for _, k, _ in lacking], np.int64)
        for b in parts:
            drew = np.array(b.column(1).to_pylist(), object)
            source, j = drew.copy(), b.column(2).to_numpy().copy()
            for s in set(drew.tolist()):
                m = np.flatnonzero(drew == s)
                j[m] = permute(j[m], got[s], f"{seed}/draw/{s}")
                if s in surplus:
                    n, k = surplus[s]
                    out = m[j[m] < n]
                    to = np.searchsorted(firsts, j[out] + k, "right") - 1
                    j[m] -= n
                    j[out] += n + k - firsts[to] + np.array([lacking[t][2] for t in to.tolist()], np.int64)
                    source[out] = [lacking[t][0] for t in to.tolist()]
            repeat, found = np.zeros(len(j), np.int64), np.zeros(len(j), np.int64)
            for s in set(source.tolist()):
                m = np.flatnonzero(source == s)
                repeat[m] = j[m] // n_blocks[s]
                for turn in np.unique(repeat[m]):  # every pass over a source has its own order
                    t = m[repeat[m] == turn]
                    found[t] = permute(j[t] % n_blocks[s], n_blocks[s], f"{seed}/{s}/{turn}")
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(3), pa.array(source.tolist(), pa.string()), pa.array(repeat), pa.array(found)], names=["shard", "slot", "source", "repeat", "block"])

    chosen = slots.mapInArrow(find, "shard bigint, slot bigint, source string, repeat bigint, block bigint")
    end = F.col("at") + F.col("n_tokens")
    spans = placed.select("source", "key", "at", "n_tokens", F.explode(F.sequence(F.floor(F.col("at") / block), F.floor((end - 1) / block))).alias("block"))
    first = F.greatest(F.lit(0), F.col("block") * block - F.col("at"))
    spans = spans.select("source", "block", "key", first.alias("first"), (F.least(F.col("n_tokens"), (F.col("block") + 1) * block - F.col("at")) - first).alias("n"), F.greatest(F.col("at"), F.col("block") * block).alias("pos"))
    stretches = spans.select("source", "block", "key", "first", "n", (F.col("pos") - F.col("block") * block).alias("part"))
    collection = chosen.join(stretches, ["source", "block"]).select("shard", "slot", "source", "repeat", "block", F.col("part").cast("bigint").alias("part"), F.col("key").cast(kind).alias(key), F.col("first").cast("bigint").alias("first"), F.col("n").cast("bigint").alias("n"))

    def size(s: str) -> int:
        """Tokens of all blocks drawn: whole passes, and those of the last one, in which the short block may be."""
        passes, rest = divmod(quota[s], n_blocks[s])
        missing = n_blocks[s] * block - held[s]
        drew = int(permute(np.array([n_blocks[s] - 1]), n_blocks[s], f"{seed}/{s}/{passes}", back=True)[0]) < rest
        return passes * held[s] + rest * block - (missing if drew else 0)

    sizes = {s: size(s) for s in names}
    all_ = sum(sizes.values())
    report = [(s, float(w), int(r), int(held.get(s, 0)), int(sizes.get(s, 0)), sizes.get(s, 0) / all_ if all_ else 0.0, -(-quota[s] // n_blocks[s]) if s in quota else 0) for s, (w, r) in sorted(goal.items())]
    shares = spark.createDataFrame(report, "source string, target_share double, max_repeats int, tokens_held bigint, tokens bigint, actual_share double, repeats int")
    return collection, shares


def block_tokens(collection: DataFrame, documents: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """``shard, slot, source, tokens``: the token ids of each slot, its stretches put together in order."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = tokenizer(vocabulary).encode_ordinary
        for b in parts:
            ids = [encode(t)[f : f + n] for t, f, n in zip(*(b.column(i).to_pylist() for i in (4, 5, 6)), strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns[:4], pa.array(ids, pa.list_(pa.int32()))], names=["shard", "slot", "source", "part", "ids"])

    texts = documents.select(F.col(key), F.col(text).alias("text"))
    cut_ = collection.join(texts, key).select("shard", "slot", "source", "part", "text", "first", "n").mapInArrow(run, "shard bigint, slot bigint, source string, part bigint, ids array<int>")
    whole = cut_.groupBy("shard", "slot", "source").agg(F.sort_array(F.collect_list(F.struct("part", "ids"))).alias("p"))
    return whole.select("shard", "slot", "source", F.flatten(F.transform("p", lambda x: x["ids"])).alias("tokens"))
