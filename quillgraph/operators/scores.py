"""Scoreboards over stored runs: recall and loss, percentiles by their several definitions, votes, pairings, costs."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillgraph.plans.runtime import cut, join_sized


def verdict_key(verdict: Column) -> Column:
    """A verdict in one spelling; null if it is none of the four."""
    v = F.regexp_replace(F.regexp_replace(F.lower(verdict), "[^a-z]+", "_"), "^_+|_+$", "")
    return F.when(v.isin("correct", "partially_correct", "wrong", "correct_refusal"), v)


def passes(verdict: Column) -> Column:
    return verdict.isin("correct", "correct_refusal")


def recall_at(ranked: DataFrame, gold: DataFrame, k: int) -> DataFrame:
    """ranked(qid, pos, key), gold(qid, key): micro recall and hit rate at k over the queries that have gold."""
    n = gold.groupBy("qid").agg(F.count("*").alias("gold"))
    hit = ranked.where(F.col("pos") <= k).join(gold, ["qid", "key"], "left_semi").groupBy("qid").agg(F.count("*").alias("hits"))
    r = n.join(hit, "qid", "left").withColumn("hits", F.coalesce("hits", F.lit(0)))
    return r.agg(F.sum("gold").alias("gold"), F.sum("hits").alias("hits"), F.round(F.try_divide(F.sum("hits"), F.sum("gold")), 6).alias("recall"), F.round(F.avg((F.col("hits") > 0).cast("int")), 6).alias("hit_rate"))


def loss_split(per_query: DataFrame, k: int) -> DataFrame:
    """per_query(stratum, gold, pooled, found): what retrieval, the cap k and the order each lose, per stratum and in all.

    The losses and what is found add up to the gold.
    """
    q = per_query.withColumn("cap", F.least("gold", F.lit(k))).withColumn("oracle", F.least("pooled", F.lit(k)))
    s = q.groupingSets([["stratum"], []], "stratum").agg(*(F.sum(c).alias(c) for c in ("gold", "pooled", "found", "cap", "oracle")), F.grouping("stratum").alias("g"))
    return s.select(F.when(F.col("g") == 1, "(all)").otherwise(F.col("stratum")).alias("stratum"), "gold", "cap", "oracle", "found", (F.col("gold") - F.col("pooled")).alias("retrieval_loss"), (F.col("pooled") - F.col("oracle")).alias("cap_loss"), (F.col("oracle") - F.col("found")).alias("order_loss"))


#: Ranges a group's values are counted in before any is sorted.
RANGES = 64


def values_at_ranks(rows: DataFrame, keys: list[str], value: str, ranks: dict[str, Column]) -> DataFrame:
    """``keys, n, x_<name>...``: the values at given ranks (1 to n, over a column ``n``) of every group's sorted values, exact.

    Equal values are counted on the map side. Approximate quantiles cut each group into ranges, whose counts tell
    which few ranges hold the wanted ranks; only those are sorted, each by itself, so no task sorts a whole group.
    """
    counted = cut(rows.select(*keys, F.col(value).cast("double").alias("x")).where(F.col("x").isNotNull() & ~F.isnan("x")).groupBy(*keys, "x").agg(F.count("*").alias("c")))
    at = [i / RANGES for i in range(1, RANGES)]
    bounds = counted.groupBy(*keys).agg(F.percentile_approx("x", at, F.lit(20 * RANGES)).alias("bounds"), F.sum("c").alias("n"))
    eq = [F.col(f"{k}").alias(f"_{k}") for k in keys]
    codes = cut(bounds.select(*eq, F.col("bounds"), "n", F.xxhash64(*keys).alias("g")))
    # null keys are groups too, so rows meet their group by the hash of the keys and compare null-safe
    tagged = join_sized(counted.withColumn("g", F.xxhash64(*keys)), codes, ["g"]).where(reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys)))
    tagged = cut(tagged.select("g", *keys, "n", "x", "c", F.size(F.filter("bounds", lambda b: b < F.col("x"))).alias("range")))
    sums = tagged.groupBy("g", *keys, "n", "range").agg(F.sum("c").alias("held"))
    upto = Window.partitionBy("g").orderBy("range")
    wanted = F.array(*(F.struct(F.lit(name).alias("name"), r.cast("bigint").alias("rank")) for name, r in ranks.items()))
    sums = sums.withColumn("upto", F.sum("held").over(upto)).select("g", "range", (F.col("upto") - F.col("held")).alias("before"), "upto", F.filter(wanted, lambda w: (w["rank"] > F.col("upto") - F.col("held")) & (w["rank"] <= F.col("upto"))).alias("w")).where(F.size("w") > 0)
    near = join_sized(tagged, cut(sums), ["g", "range"])
    near = near.withColumn("to", F.col("before") + F.sum("c").over(Window.partitionBy("g", "range").orderBy("x")))
    hit = near.select(*keys, "n", "x", "c", "to", F.inline("w")).where((F.col("rank") <= F.col("to")) & (F.col("rank") > F.col("to") - F.col("c")))
    return hit.groupBy(*keys).agg(F.max("n").alias("n"), *(F.max(F.when(F.col("name") == name, F.col("x"))).alias(f"x_{name}") for name in ranks))


def ranked_percentiles(rows: DataFrame, keys: list[str], value: str, q: float = 0.95) -> DataFrame:
    """Nearest rank with a half-even round (v1), its variant without the shift (v2), the upper median (v3), the median.

    Null and NaN are left out; a group without values has no row.
    """
    n = F.col("n")
    ranks = {
        "v1": F.least(n, F.greatest(F.lit(1), F.bround(q * n + 0.5))),
        "v2": F.greatest(F.lit(1), F.bround(q * n)),
        "upper": F.floor(n / 2) + 1,
        "lo": F.floor((n + 1) / 2),
        "hi": F.floor(n / 2) + 1,
    }
    # half a group of one lies behind its end
    ranks = {k: F.least(n, r.cast("bigint")) for k, r in ranks.items()}
    v = values_at_ranks(rows, keys, value, ranks)
    return v.select(*keys, "n", F.col("x_v1").alias("p95_v1"), F.col("x_v2").alias("p95_v2"), F.col("x_upper").alias("p50_upper"), ((F.col("x_lo") + F.col("x_hi")) / 2).alias("median"))


def scored(rows: DataFrame) -> DataFrame:
    """Graded rows with one verdict per id, system and tag: the latest, then the least."""
    v = rows.withColumn("v", verdict_key(F.col("verdict"))).where(F.col("v").isNotNull())
    return v.groupBy("id", "run_tag").agg(F.max_by("v", F.struct("graded_at", "v")).alias("v"), F.min("stratum").alias("stratum"))


def common(rows: DataFrame, arm: str, key: str) -> DataFrame:
    """Rows of the ids every arm has scored: the common denominator."""
    arms = rows.select(arm).distinct().count()
    full = rows.groupBy(key).agg(F.countDistinct(arm).alias("n")).where(F.col("n") == arms).select(key)
    return rows.join(full, key, "left_semi")


def majority(rows: DataFrame) -> DataFrame:
    """Strict majority of the pass bit per id; a tie is flagged and is no pass."""
    g = rows.groupBy("id").agg(F.count_if(passes(F.col("v"))).alias("passes"), F.count("*").alias("n"))
    return g.select("id", "n", "passes", (2 * F.col("passes") > F.col("n")).alias("passed"), (2 * F.col("passes") == F.col("n")).alias("tied"))


def mcnemar_exact(wins: int, losses: int) -> float:
    """Two-sided exact binomial on discordant pairs; 1 if there are none."""
    n, k = wins + losses, min(wins, losses)
    return 1.0 if n == 0 else min(1.0, 2 * sum(math.comb(n, i) for i in range(k + 1)) / 2**n)


def paired(a: DataFrame, b: DataFrame) -> DataFrame:
    """Per stratum and in all: how often verdict and pass bit differ between two runs of the same ids."""
    j = a.select("id", "stratum", F.col("v").alias("va")).join(b.select("id", F.col("v").alias("vb")), "id")
    pa_, pb = passes(F.col("va")), passes(F.col("vb"))
    s = j.groupingSets([["stratum"], []], "stratum").agg(F.count("*").alias("n"), F.count_if(F.col("va") != F.col("vb")).alias("verdict_flips"), F.count_if(pa_ & ~pb).alias("a_only"), F.count_if(~pa_ & pb).alias("b_only"), F.grouping("stratum").alias("g"))
    return s.select(F.when(F.col("g") == 1, "(all)").otherwise(F.col("stratum")).alias("stratum"), "n", "verdict_flips", "a_only", "b_only")


def agreement(judged: DataFrame, hand: DataFrame) -> DataFrame:
    """judged(id, v), hand(id, v): hand labels met, missed and without a judged verdict."""
    j = hand.select("id", F.col("v").alias("h")).join(judged.select("id", F.col("v").alias("j")), "id", "left")
    return j.agg(F.count("*").alias("n"), F.count_if(F.col("h") == F.col("j")).alias("matches"), F.count_if(F.col("j").isNull()).alias("missing"), F.count_if(passes(F.col("h")) == passes(F.col("j"))).alias("pass_matches"))


def even_sample(rows: DataFrame, stratum: str, key: str, fraction: float) -> DataFrame:
    """Evenly spaced keys per stratum: max(1, round half-even of n * fraction) of them, at floor(i * n / take)."""
    w = Window.partitionBy(stratum)
    r = rows.select(stratum, key, (F.row_number().over(w.orderBy(key)) - 1).alias("i"), F.count("*").over(w).alias("n"))
    take = F.greatest(F.lit(1), F.bround(F.col("n") * fraction)).cast("bigint")
    r = r.withColumn("take", take)
    picked = F.ceil(F.col("i") * F.col("take") / F.col("n")).cast("bigint")  # the only slot that could point here
    return r.where((picked < F.col("take")) & (F.floor(picked * F.col("n") / F.col("take")) == F.col("i"))).select(stratum, key)


def cost(priced: Column, tokens_in: Column, tokens_out: Column, rate_in: Column, rate_out: Column) -> Column:
    """Price of a call; a rate that is needed and unknown makes it unknown. The output rate is needed only for output."""
    return F.when(priced, tokens_in * rate_in + F.when(tokens_out > 0, tokens_out * rate_out).otherwise(0.0))


def cost_totals(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Strict total (null if any is unknown), known total, and how many are unknown."""
    unknown = F.count_if(F.col(value).isNull())
    return rows.groupBy(*keys).agg(F.count("*").alias("n"), unknown.alias("unpriced"), F.round(F.sum(value), 6).alias("known_cost"), F.when(unknown == 0, F.round(F.sum(value), 6)).alias("strict_cost"))


def gaps(rows: DataFrame, number: str) -> DataFrame:
    """Whether numbers run from 1 without a gap."""
    return rows.agg(F.count("*").alias("n"), F.max(number).alias("top"), (F.max(number) == F.count_distinct(number)).alias("gapless"))


def linker_board(strata: DataFrame, links: DataFrame, gold: DataFrame) -> DataFrame:
    """strata(qid, stratum), links(qid, name, ambiguous), gold(qid, name): how links meet gold, with all of them and with
    unambiguous ones only, per stratum and in all. recall_superset is a share of all gold names, which no question needs to name."""
    arms = F.explode(F.when(F.col("ambiguous"), F.array(F.lit("all"))).otherwise(F.array(F.lit("all"), F.lit("unambiguous"))))
    said = links.select("qid", "name", arms.alias("arm")).distinct()
    g = gold.select("qid", "name").distinct()
    hit = said.join(g.withColumn("hit", F.lit(1)), ["qid", "name"], "left").groupBy("qid", "arm").agg(F.count("*").alias("linked"), F.count("hit").alias("in_gold"))
    every = strata.join(g.groupBy("qid").agg(F.count("*").alias("gold")), "qid", "left").select("qid", "stratum", F.coalesce("gold", F.lit(0)).alias("gold"), F.explode(F.array(F.lit("all"), F.lit("unambiguous"))).alias("arm"))
    per = every.join(hit, ["qid", "arm"], "left").na.fill(0, ["linked", "in_gold"])
    s = per.groupingSets([["arm", "stratum"], ["arm"]], "arm", "stratum").agg(F.count("*").alias("rows"), F.count_if(F.col("linked") > 0).alias("linked_rows"), F.count_if(F.col("in_gold") > 0).alias("hit_rows"), *(F.sum(c).alias(c) for c in ("linked", "in_gold", "gold")), F.grouping("stratum").alias("g"))
    share = lambda a, b: F.round(F.coalesce(F.try_divide(F.col(a), F.col(b)), F.lit(0.0)), 6)
    return s.select("arm", F.when(F.col("g") == 1, "(all)").otherwise(F.col("stratum")).alias("stratum"), "rows", "linked_rows", "hit_rows", "linked", "in_gold", "gold", share("linked_rows", "rows").alias("link_rate"), share("hit_rows", "rows").alias("hit_rate"), share("in_gold", "linked").alias("precision"), share("in_gold", "gold").alias("recall_superset"))


def selector_board(calls: DataFrame, found: DataFrame, offered: DataFrame, gold: DataFrame) -> DataFrame:
    """calls(qid, call), found and offered(qid, call, chunk), gold(qid, chunk): one row over the questions that have gold.

    gold_hit is what the plans' chunks hold of it; oracle what the best single offered call would; ceiling_anchor
    the questions some call could be offered for.
    """
    gold = gold.select("qid", "chunk").distinct()
    base = gold.groupBy("qid").agg(F.count("*").alias("gold"))
    planned = calls.groupBy("qid").agg(F.count("*").alias("calls"))
    filled = found.select("qid", "call").distinct().groupBy("qid").agg(F.count("*").alias("filled"))
    hits = found.select("qid", "chunk").distinct().join(gold, ["qid", "chunk"], "left_semi").groupBy("qid").agg(F.count("*").alias("hits"))
    best = offered.join(gold, ["qid", "chunk"], "left_semi").groupBy("qid", "call").agg(F.count("*").alias("h")).groupBy("qid").agg(F.max("h").alias("oracle"))
    open_ = offered.select("qid").distinct().withColumn("open", F.lit(1))
    per = reduce(lambda a, b: a.join(b, "qid", "left"), (base, planned, filled, hits, best, open_)).na.fill(0)
    return per.agg(F.count("*").alias("n"), F.sum("gold").alias("gold_total"), F.sum("hits").alias("gold_hit"), F.count_if(F.col("hits") > 0).alias("rows_with_a_hit"), F.count_if(F.col("calls") > 0).alias("rows_with_a_plan"), F.sum("calls").alias("calls"), (F.sum("calls") - F.sum("filled")).alias("empty_calls"), F.sum("oracle").alias("oracle"), F.sum("open").cast("bigint").alias("ceiling_anchor"))


def untagged(rows: DataFrame, tag: str = "run_tag") -> DataFrame:
    """Published rows: those of no named trial run."""
    return rows.where(F.col(tag).isNull() | (F.trim(tag) == ""))


def stage_latency(*stages: str) -> Column:
    """Latency of a request as the sum of its stages; a stage that did not run took no time."""
    return sum((F.coalesce(F.col(c), F.lit(0.0)) for c in stages), F.lit(0.0))


def own_and_common(rows: DataFrame, arm: str, key: str, family: Column) -> DataFrame:
    """rows(arm, key, v): verdicts per arm over its own keys and over those every arm of its family scored.

    ``family, arm, scope, n, passed, partial, wrong, pass_rate``.
    """
    r = rows.select(family.alias("family"), F.col(arm).alias("arm"), F.col(key).alias("key"), "v")
    arms = r.groupBy("family").agg(F.count_distinct("arm").alias("arms"))
    full = r.groupBy("family", "key").agg(F.count_distinct("arm").alias("n")).join(arms, "family").where(F.col("n") == F.col("arms")).select("family", "key", F.lit(True).alias("all"))
    scopes = F.explode(F.when(F.col("all"), F.array(F.lit("own"), F.lit("common"))).otherwise(F.array(F.lit("own")))).alias("scope")
    each = r.join(full, ["family", "key"], "left").select("family", "arm", "v", scopes)
    g = each.groupBy("family", "arm", "scope").agg(F.count("*").alias("n"), F.count_if(passes(F.col("v"))).alias("passed"), F.count_if(F.col("v") == "partially_correct").alias("partial"), F.count_if(F.col("v") == "wrong").alias("wrong"))
    return g.withColumn("pass_rate", F.round(F.col("passed") / F.col("n"), 6))


def router_board(runs: DataFrame, constants: tuple[str, ...] = ("vector", "graph", "both")) -> DataFrame:
    """runs(gold_route, route, stratum, latency_ms, cost_usd): the recorded router and constant arms per stratum and in all.

    Only the recorded arm has latency and cost; ``beats`` of a row is whether it is right more often than the best constant.
    """
    said = F.inline(F.array(F.struct(F.lit("recorded").alias("arm"), F.col("route").alias("said")), *(F.struct(F.lit(f"always-{x}").alias("arm"), F.lit(x).alias("said")) for x in constants)))
    each = runs.select("gold_route", "stratum", "latency_ms", "cost_usd", said)
    own = F.col("arm") == "recorded"
    usable = own & F.col("latency_ms").isNotNull() & ~F.isnan("latency_ms") & (F.col("latency_ms") >= 0)
    g = each.groupingSets([["arm", "stratum"], ["arm"]], "arm", "stratum").agg(
        F.count("*").alias("n"), F.count_if(F.col("said") == F.col("gold_route")).alias("right"), F.count_if(F.col("said").isNull()).alias("unparsed"),
        F.round(F.avg(F.when(usable, F.col("latency_ms"))), 3).alias("mean_ms"), F.round(F.sum(F.when(own, F.col("cost_usd"))), 6).alias("cost_usd"), F.grouping("stratum").alias("g"),
    )
    g = g.withColumn("stratum", F.when(F.col("g") == 1, "(all)").otherwise(F.col("stratum"))).withColumn("accuracy", F.round(F.col("right") / F.col("n"), 6))
    best = g.where(F.col("arm") != "recorded").groupBy("stratum").agg(F.max("right").alias("best"))
    return g.join(best, "stratum").select("arm", "stratum", "n", "right", "unparsed", "accuracy", "mean_ms", "cost_usd", (F.col("right") > F.col("best")).alias("beats"))


def analytic_cost(rows: DataFrame, retrieval: DataFrame, key: str) -> DataFrame:
    """Cost of generation plus that of the same question's retrieval; either unknown makes the sum unknown."""
    return rows.join(retrieval.select(key, F.col("cost_usd").alias("_r")), key, "left").withColumn("total_usd", F.col("cost_usd") + F.col("_r")).drop("_r")


def set_violations(rows: DataFrame, refusals: tuple[str, ...] = ("out-of-scope", "unanswerable"), most: float = 0.6) -> DataFrame:
    """rows(id, stratum, gold_route, expected_fail, status_code, n_sources): rows that break an evaluation set's rules.

    ``id, rule``: a stratum that asks for citations without sources, a refusal with some, an expected failure that
    succeeds, an unknown route; and, with a null id, a route that more than ``most`` of the rows share.
    """
    refused = F.col("stratum").isin(*refusals)
    rules = F.array(
        F.when(~refused & (F.col("n_sources") == 0), "no sources"),
        F.when(refused & (F.col("n_sources") > 0), "sources for a refusal"),
        F.when(F.col("expected_fail") & (F.col("status_code") == 200), "expected to fail"),
        F.when(F.col("gold_route").isNull() | ~F.col("gold_route").isin("vector", "graph", "both"), "unknown route"),
    )
    own = rows.select(F.col("id"), F.explode(F.array_compact(rules)).alias("rule"))
    shares = rows.groupBy("gold_route").agg(F.count("*").alias("n"))
    total = rows.agg(F.count("*").alias("total"))  # one row
    crowded = shares.crossJoin(F.broadcast(total)).where(F.col("n") > most * F.col("total")).select(F.lit(None).cast(rows.schema["id"].dataType).alias("id"), F.concat(F.lit("majority "), "gold_route").alias("rule"))
    return own.unionByName(crowded)
