from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from quillgraph.plans.runtime import BROADCAST_BYTES, hot_keys, join_sized, small_enough


def _sides(spark):
    rng = random.Random(1)
    big = [(i, "hot" if i % 3 == 0 else None if i % 50 == 1 else f"k{rng.randrange(400)}", i % 2) for i in range(3000)]
    side = [(k, j, f"{k}-{j}") for k in ["hot", *(f"k{n}" for n in range(0, 400, 2))] for j in (0, 1)] + [(None, 0, "null")]
    return spark.createDataFrame(big, "i int, k string, j int"), spark.createDataFrame(side, "k string, j int, v string")


@pytest.mark.parametrize("how", ["inner", "left"])
@pytest.mark.parametrize("on", [["k"], ["k", "j"]])
def test_salted_joins_equal_plain_ones(spark, how, on):
    big, side = _sides(spark)
    side = side if len(on) == 2 else side.where("j = 0").drop("j")
    want = sorted(map(str, big.join(side, on, how).select(*sorted({*big.columns, *side.columns})).collect()))
    got = join_sized(big, side, on, how, rows=0).select(*sorted({*big.columns, *side.columns}))
    assert sorted(map(str, got.collect())) == want
    assert sorted(map(str, join_sized(big, side, on, how).select(*got.columns).collect())) == want


def test_hot_keys_are_found_and_sides_measured(spark):
    big, side = _sides(spark)
    hot = spark.createDataFrame([("hot",)], "k string").select(F.xxhash64(F.struct("k"))).first()[0]
    assert hot in hot_keys(big, F.struct("k")) and len(hot_keys(big, F.struct("k"))) < 60
    assert small_enough(side, 1000) and not small_enough(side, 10) and not small_enough(side, 1000, 100)
    wide = spark.range(3).select(F.repeat(F.lit("x"), F.lit(100)).alias("t"), F.array(F.lit(1.0)).alias("a"))
    assert not small_enough(wide, 10, 200) and small_enough(wide, 10, BROADCAST_BYTES) and small_enough(wide.limit(0))
