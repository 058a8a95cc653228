"""Percentiles of very large columns from deterministic rank-interval summaries that can be merged.

A summary of n values is a sorted array of tuples (value, least rank, greatest rank). Each partition summarises what
it holds of a group, so no group is ever gathered; summaries merge exactly, and compressing to a gap of 2 * eps * n
ranks keeps every rank known to eps * n. The tuples carry their own error, so days or files done apart combine.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.plans.runtime import cut, ship

EPS = 0.005
#: Share of EPS spent by each level: a partition, a fan-in of partitions, a day, a month, everything.
LEVELS = (0.125, 0.25, 0.5, 0.75, 1.0)
FAN_IN = 32
_SUMMARY = "n bigint, value array<double>, lo array<bigint>, hi array<bigint>"
Summary = tuple[np.ndarray, np.ndarray, np.ndarray, int]


def summarise(values: np.ndarray, eps: float) -> Summary:
    v = np.sort(values)
    ranks = np.arange(1, len(v) + 1, dtype=np.int64)
    return compress((v, ranks, ranks, len(v)), eps)


def merge(a: Summary, b: Summary) -> Summary:
    """Ranks add: what lies surely before a tuple in the other summary, and what may."""
    (av, al, ah, an), (bv, bl, bh, bn) = a, b
    if not an or not bn:
        return b if not an else a
    i, j = np.searchsorted(bv, av, "left"), np.searchsorted(av, bv, "right")
    below = lambda lo, at: np.where(at > 0, lo[np.maximum(at - 1, 0)], 0)
    above = lambda hi, at, n: np.where(at < len(hi), hi[np.minimum(at, len(hi) - 1)] - 1, n)
    v = np.concatenate([av, bv])
    lo = np.concatenate([al + below(bl, i), bl + below(al, j)])
    hi = np.concatenate([ah + above(bh, i, bn), bh + above(ah, j, an)])
    order = np.lexsort((hi, lo, v))
    return v[order], lo[order], hi[order], an + bn


def compress(s: Summary, eps: float) -> Summary:
    """The fewest tuples (ends kept) whose neighbours are at most 2 * eps * n ranks apart, where that is possible."""
    v, lo, hi, n = s
    gap = int(2 * eps * n)
    if len(v) <= 2 or gap < 2:
        return s
    keep, at, last = [0], 0, len(v) - 1
    while at < last:
        nxt = int(np.searchsorted(hi, lo[at] + gap, "right")) - 1
        at = min(last, max(nxt, at + 1))
        keep.append(at)
    k = np.array(keep)
    return v[k], lo[k], hi[k], n


def error(s: Summary) -> float:
    """The largest rank error of any percentile read from s, as a share of n."""
    _, lo, hi, n = s
    return float(np.max((hi[1:] - lo[:-1]) // 2, initial=0) / n) if n else 0.0


def read(s: Summary, q: float) -> tuple[float, int, int]:
    """``(value, least rank, greatest rank)`` of the tuple nearest to rank ceil(q * n)."""
    v, lo, hi, n = s
    rank = min(n, max(1, math.ceil(q * n)))
    i = int(np.argmin(np.maximum(rank - lo, hi - rank)))
    return float(v[i]), int(lo[i]), int(hi[i])


def _batches(keys: list[str], schema: pa.Schema, done: dict[tuple, Summary]) -> Iterator[pa.RecordBatch]:
    for i in range(0, len(done), 500):
        some = list(done.items())[i : i + 500]
        cols = [pa.array([k[c] for k, _ in some], schema.field(x).type) for c, x in enumerate(keys)]
        at = pa.array(np.concatenate([[0], np.cumsum([len(s[0]) for _, s in some])]).astype(np.int32))
        lists = [pa.ListArray.from_arrays(at, pa.array(np.concatenate([s[c] for _, s in some]))) for c in range(3)]
        yield pa.RecordBatch.from_arrays([*cols, pa.array([s[3] for _, s in some], pa.int64()), *lists], names=[*keys, "n", "value", "lo", "hi"])


def partition_summaries(rows: DataFrame, keys: list[str], value: str, eps: float) -> DataFrame:
    """One summary per partition and group; null, NaN and infinite values are left out."""
    ship(rows.sparkSession)
    kinds = ", ".join(f"{k} {rows.schema[k].dataType.simpleString()}" for k in keys)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, list[Summary]] = {}
        schema, waiting, n = None, [], 0

        def take() -> None:
            t = pa.Table.from_batches(waiting).combine_chunks()
            waiting.clear()
            code, names = np.zeros(t.num_rows, np.int64), [()]
            for k in keys:
                d = t.column(k).combine_chunks().dictionary_encode(null_encoding="encode")
                code = code * len(d.dictionary) + d.indices.to_numpy(zero_copy_only=False)
                names = [(*a, b) for a in names for b in d.dictionary.to_pylist()]
            x = t.column(value).to_numpy()
            ok = np.isfinite(x)
            x, code = x[ok], code[ok]
            order = np.lexsort((x, code))
            x, code = x[order], code[order]
            at = np.concatenate([[0], np.flatnonzero(np.diff(code)) + 1, [len(code)]]) if len(code) else np.zeros(1, int)
            for a, b in zip(at[:-1], at[1:], strict=True):
                group = held.setdefault(names[code[a]], [])
                group.append(summarise(x[a:b], eps / 2))
                if len(group) >= 16:
                    group[:] = [_all(group, eps / 2)]

        for b in parts:
            schema = b.schema
            waiting.append(b)
            n += b.num_rows
            if n > 400_000:
                take()
                n = 0
        if waiting:
            take()
        yield from _batches(keys, schema, {k: compress(_all(v, eps / 2), eps) for k, v in held.items()})

    return rows.select(*keys, F.col(value).cast("double").alias(value)).mapInArrow(run, f"{kinds}, {_SUMMARY}")


def _all(parts: list[Summary], eps: float) -> Summary:
    """Merge in a balanced tree; nothing is lost beyond compressing to eps."""
    while len(parts) > 1:
        parts = [compress(merge(parts[i], parts[i + 1]), eps) if i + 1 < len(parts) else parts[i] for i in range(0, len(parts), 2)]
    return parts[0]


def combine(summaries: DataFrame, keys: list[str], eps: float) -> DataFrame:
    """Merge summaries, of days or files or partitions, into one per key; eps must not be below theirs."""
    kinds = ", ".join(f"{k} {summaries.schema[k].dataType.simpleString()}" for k in keys)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, list[Summary]] = {}
        schema = None
        for b in parts:
            schema = b.schema
            names = list(zip(*(b.column(k).to_pylist() for k in keys), strict=True))
            n = b.column("n").to_pylist()
            lists = [(c.offsets.to_numpy(), c.values.to_numpy()) for c in (b.column(x) for x in ("value", "lo", "hi"))]
            for i, k in enumerate(names):
                group = held.setdefault(k, [])
                group.append((*(v[o[i] : o[i + 1]].copy() for o, v in lists), n[i]))
                if len(group) >= 16:
                    group[:] = [_all(group, eps)]
        yield from _batches(keys, schema, {k: compress(_all(v, eps), eps) for k, v in held.items()})

    return summaries.select(*keys, "n", "value", "lo", "hi").repartition(*keys).mapInArrow(run, f"{kinds}, {_SUMMARY}")


def percentiles(summaries: DataFrame, keys: list[str], at: tuple[float, ...]) -> DataFrame:
    """``keys, n, q, percentile, rank_lo, rank_hi, rank_error`` read from summaries."""
    kinds = ", ".join(f"{k} {summaries.schema[k].dataType.simpleString()}" for k in keys)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in parts:
            out = []
            for r in df.itertuples():
                s = (np.asarray(r.value, float), np.asarray(r.lo, np.int64), np.asarray(r.hi, np.int64), int(r.n))
                out += [(*(getattr(r, k) for k in keys), s[3], q, *read(s, q), error(s)) for q in at] if s[3] else []
            yield pd.DataFrame(out, columns=[*keys, "n", "q", "percentile", "rank_lo", "rank_hi", "rank_error"]).astype({k: object for k in keys})

    return summaries.select(*keys, *[c for c in ("n", "value", "lo", "hi")]).mapInPandas(run, f"{kinds}, n bigint, q double, percentile double, rank_lo bigint, rank_hi bigint, rank_error double")


def run_values(runs: DataFrame) -> DataFrame:
    """``day, route, metric, x`` of ask_runs: each ask_id once, route in one spelling, only usable values.

    Latencies that are null, NaN or below zero and costs that are null, NaN or below zero are no measurements; a cost
    of zero is one. A null route is ``(none)``. Of differing rows of one ask_id the least counts.
    """
    one = runs.groupBy("ask_id").agg(F.min(F.struct("asked_at", "route", "latency_ms", "cost_usd")).alias("r")).select("r.*")
    route = F.coalesce(F.nullif(F.lower(F.trim("route")), F.lit("")), F.lit("(none)"))
    each = F.inline(F.array(*(F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("x")) for c in ("latency_ms", "cost_usd"))))
    return one.select(F.date_format("asked_at", "yyyy-MM-dd").alias("day"), route.alias("route"), each).where(F.col("x").isNotNull() & ~F.isnan("x") & (F.col("x") >= 0))


def day_summaries(values: DataFrame, eps: float = EPS) -> DataFrame:
    """One summary per day, route and metric, through summaries of partitions and a fan-in of them."""
    keys = ["day", "route", "metric"]
    parts = partition_summaries(values, keys, "x", eps * LEVELS[0])
    # the summaries of a group, one per partition, are first merged in several tasks
    parts = combine(parts.withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(FAN_IN))), [*keys, "salt"], eps * LEVELS[1])
    return combine(parts, keys, eps * LEVELS[2])


def rollup(runs: DataFrame, at: tuple[float, ...] = (0.5, 0.75, 0.9, 0.95, 0.99), eps: float = EPS) -> DataFrame:
    """Percentiles per day, per month and over everything, each level merged from the summaries below it.

    ``scope, period, route, metric, n, q, percentile, rank_lo, rank_hi, rank_error``; the true value at rank
    ceil(q * n) lies within rank_error * n <= eps * n ranks. Groups without a usable value have no rows; an empty
    table gives an empty result.
    """
    days = cut(day_summaries(run_values(runs), eps))
    months = cut(combine(days.withColumn("day", F.substring("day", 1, 7)), ["day", "route", "metric"], eps * LEVELS[3]))
    whole = combine(months.withColumn("day", F.lit("all")), ["day", "route", "metric"], eps * LEVELS[4])
    out = None
    for scope, s in (("day", days), ("month", months), ("all", whole)):
        p = percentiles(s, ["day", "route", "metric"], at).select(F.lit(scope).alias("scope"), F.col("day").alias("period"), "route", "metric", "n", "q", "percentile", "rank_lo", "rank_hi", "rank_error")
        out = p if out is None else out.unionByName(p)
    return out
