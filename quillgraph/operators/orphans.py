"""References to records that do not exist, by key bitmaps per period.

Keys are dictionary-encoded as integers, split into ranges of 32,768. Per range and month one bitmap holds the
keys referenced, one the keys that arrive and one the keys that retire; ``referenced AND NOT (arrived AND NOT
retired)`` leaves the keys that are not surely present through the whole month. Only references to those
surviving keys are looked at again, with exact timestamps.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillgraph.functions.unicode import reference_key
from quillgraph.plans.runtime import cut, join_sized, ship

RANGE_BITS = 15


@dataclass(frozen=True)
class Parent:
    """A referenced table: ``rows`` has key, rank (0 beats 1), since and until; ``fields`` are the columns referring to it."""

    name: str
    rows: DataFrame
    fields: tuple[str, ...]
    normalise: bool = False


@F.pandas_udf(T.StringType())
def _normal(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    seen: dict[str | None, str | None] = {}
    for names in parts:
        yield names.map(lambda x: seen[x] if x in seen else seen.setdefault(x, reference_key(x)))


def normal_key(name: Column) -> Column:
    """``reference_key`` as an Arrow UDF; meant for distinct names, not for fact rows."""
    return _normal(name)


def _month(at: Column) -> Column:
    return F.year(at) * 12 + F.month(at) - 1


def _decode(group: pd.DataFrame) -> pd.DataFrame:
    """The surviving codes of one key range, for each month in which it is referenced."""
    bits = {(r.kind, r.month): np.frombuffer(r.bits, np.uint8) for r in group.itertuples()}
    here = np.zeros((1 << RANGE_BITS) // 8, np.uint8)
    gone = here.copy()
    moves = sorted((m, k) for k, m in bits if k != "ref")
    months, codes, done = [], [], 0
    first = int(group["range"].iloc[0]) << RANGE_BITS
    for month in sorted(m for k, m in bits if k == "ref"):
        while done < len(moves) and moves[done][0] <= month:
            m, k = moves[done]
            target = here if k == "arrive" else gone
            np.bitwise_or(target, bits[k, m], out=target)
            done += 1
        left = bits["ref", month] & ~(here & ~gone)
        at = np.flatnonzero(np.unpackbits(left, bitorder="little")) if left.any() else np.empty(0, int)
        codes.append(at + first)
        months.append(np.full(len(at), month))
    return pd.DataFrame({"month": np.concatenate(months or [[]]).astype("int32"), "code": np.concatenate(codes or [[]]).astype("int64")})


def _bitmaps(df: DataFrame, kind: str) -> DataFrame:
    """df(month, code) -> range, kind, month, bits."""
    # bitmap_construct_agg aggregates on the map side, so one row per range and month is shuffled
    return df.groupBy(F.shiftright("code", RANGE_BITS).alias("range"), F.lit(kind).alias("kind"), "month").agg(
        F.bitmap_construct_agg(F.col("code").bitwiseAND((1 << RANGE_BITS) - 1)).alias("bits")
    )


def orphan_references(child: DataFrame, id_col: str, at_col: str, parents: list[Parent]) -> DataFrame:
    """``(id, field, kind, parent, month)``: one row per reference of ``child`` whose target is not there at ``at_col``.

    kind is ``missing`` (no such key), ``late`` (every target arrives after ``at_col``) or ``deleted`` (a target was
    there and its ``until`` is not after ``at_col``). A key of several targets is an orphan only if none of them is
    there. Rows repeated in ``child`` are reported once. A null reference is none; an empty or blank one is a key
    like any other; a row whose ``at_col`` is null is compared with no time, so it can only be ``missing``. Empty
    tables give an empty result (an empty parent makes every reference ``missing``). Further columns, whatever
    their names, are not read.
    """
    ship(child.sparkSession)
    of = {f: p for p in parents for f in p.fields}
    rows = child.select(
        F.col(id_col).alias("id"),
        F.col(at_col).alias("at"),
        F.coalesce(_month(F.col(at_col)), F.lit(-1)).alias("month"),
        F.inline(F.array(*(F.struct(F.lit(f).alias("field"), F.lit(p.name).alias("parent"), F.col(f).cast("string").alias("raw")) for f, p in of.items()))),
    ).where(F.col("raw").isNotNull())

    spelled = rows.select("parent", "raw", "month").distinct()  # pre-aggregated: a hot key is one row a month
    plain = [p.name for p in parents if not p.normalise]
    keyed = spelled.where(F.col("parent").isin(plain)).withColumn("key", F.col("raw")).unionByName(spelled.where(~F.col("parent").isin(plain)).withColumn("key", normal_key(F.col("raw"))))
    keyed = cut(keyed)
    codes = cut(keyed.select("parent", "key").distinct().withColumn("code", F.monotonically_increasing_id()))

    targets = None
    for p in parents:
        one = p.rows.select(F.lit(p.name).alias("parent"), (normal_key(F.col("key")) if p.normalise else F.col("key")).alias("key"), F.col("rank").cast("int").alias("rank"), "since", "until")
        targets = one if targets is None else targets.unionByName(one)
    best = targets.where(F.col("key").isNotNull()).groupBy("parent", "key").agg(F.collect_set(F.struct("rank", "since", "until")).alias("all"))
    best = best.withColumn("top", F.array_min(F.transform("all", lambda x: x["rank"])))
    best = best.select("parent", "key", F.transform(F.filter("all", lambda x: x["rank"] == F.col("top")), lambda x: F.struct(x["since"].alias("since"), x["until"].alias("until"))).alias("spans"))
    found = cut(codes.join(best, ["parent", "key"]).select("code", "spans"))

    coded = keyed.join(codes, ["parent", "key"])
    # a key with one lifetime is surely present from the first month it begins in or before, to the month it ends in
    single = found.where(F.size("spans") == 1).select("code", F.col("spans")[0]["since"].alias("since"), F.col("spans")[0]["until"].alias("until"))
    arrive = single.where(F.col("since").isNotNull()).select(
        "code", (_month(F.col("since")) + (F.col("since") > F.date_trunc("month", "since")).cast("int")).alias("month")
    )
    retire = single.where(F.col("until").isNotNull()).select("code", _month(F.col("until")).alias("month"))
    maps = _bitmaps(coded.select("month", "code"), "ref").unionByName(_bitmaps(arrive, "arrive")).unionByName(_bitmaps(retire, "retire"))
    surviving = maps.groupBy("range").applyInPandas(_decode, "month int, code long")

    suspect = cut(coded.join(surviving, ["month", "code"]).join(found, "code", "left").select("parent", "raw", "month", "spans"))
    at = F.col("at")
    there = F.exists("spans", lambda x: F.coalesce(x["since"] <= at, F.lit(True)) & F.coalesce(x["until"] > at, F.lit(True)))
    ended = F.exists("spans", lambda x: F.coalesce(x["since"] <= at, F.lit(True)) & F.coalesce(x["until"] <= at, F.lit(False)))
    kind = F.when(F.col("spans").isNull(), "missing").when(~there, F.when(ended, "deleted").otherwise("late"))
    return join_sized(rows, suspect, ["parent", "raw", "month"]).withColumn("kind", kind).where(F.col("kind").isNotNull()).select("id", "field", "kind", "parent", "month").distinct()


def node_parent(nodes: DataFrame) -> DataFrame:
    """Nodes as a Parent's rows: the canonical name first, else any alias."""
    keys = F.concat(F.array(F.struct(F.col("canonical_name").alias("key"), F.lit(0).alias("rank"))), F.coalesce(F.transform("aliases", lambda a: F.struct(a.alias("key"), F.lit(1).alias("rank"))), F.array()))
    return nodes.select(F.inline(keys), F.col("ingested_at").alias("since"), F.col("retired_at").alias("until"))


def chunk_parent(chunks: DataFrame) -> DataFrame:
    return chunks.select(F.col("chunk_id").alias("key"), F.lit(0).alias("rank"), F.col("ingested_at").alias("since"), F.col("retired_at").alias("until"))


def relationship_orphans(relationships: DataFrame, nodes: DataFrame, chunks: DataFrame) -> DataFrame:
    return orphan_references(
        relationships, "rel_id", "extracted_at", [Parent("graph_nodes", node_parent(nodes), ("head", "tail"), normalise=True), Parent("chunks", chunk_parent(chunks), ("source_chunk_id",))]
    )
