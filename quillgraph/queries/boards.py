"""Scoreboards over interface runs, graded sweeps and hand labels."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillgraph.operators import scores as S
from quillgraph.operators.cite import citation_defect, keep_better
from quillgraph.plans.runtime import cut, table


def _runs(spark, d):
    """Each run once, its route in one spelling."""
    one = table(spark, d, "ask_runs").groupBy("ask_id").agg(F.min(F.struct("question_id", "stratum", "gold_route", "expected_fail", "status_code", "route", "latency_ms", "cost_usd", "n_citations", "answer_chars")).alias("r"))
    return one.select("ask_id", "r.*").withColumn("route", F.lower(F.trim("route")))


def interface_board(spark, d):
    """Per route: runs, median and 95th percentiles of latency by their definitions."""
    return S.ranked_percentiles(_runs(spark, d).where(F.col("latency_ms") >= 0), ["route"], "latency_ms").select("route", "n", *(F.round(c, 6).alias(c) for c in ("p95_v1", "p95_v2", "p50_upper", "median")))


def interface_costs(spark, d):
    return S.cost_totals(_runs(spark, d), ["route"], "cost_usd")


def latency_stalls(spark, d):
    """Per route how many runs took over a second, and the slowest."""
    r = _runs(spark, d).where(F.col("latency_ms").isNotNull() & ~F.isnan("latency_ms"))
    return r.groupBy("route").agg(F.count_if(F.col("latency_ms") > 1000).alias("stalls"), F.round(F.max("latency_ms"), 6).alias("slowest"))


def route_confusion(spark, d):
    return _runs(spark, d).groupBy("gold_route").pivot("route", ["vector", "graph", "both"]).agg(F.count(F.lit(1))).select("gold_route", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("vector", "graph", "both")))


def route_accuracy(spark, d):
    """The recorded router beside arms that always answer the same."""
    r = _runs(spark, d).where(F.col("gold_route").isNotNull())
    arms = F.inline(F.array(F.struct(F.lit("recorded").alias("arm"), F.col("route").alias("said")), *(F.struct(F.lit(f"always-{x}").alias("arm"), F.lit(x).alias("said")) for x in ("vector", "graph", "both"))))
    return r.select("gold_route", arms).groupBy("arm").agg(F.count("*").alias("n"), F.count_if(F.col("said") == F.col("gold_route")).alias("right"), F.count_if(F.col("said").isNull()).alias("unparsed"))


def scorable_runs(spark, d):
    """Runs that count: answered, not expected to fail."""
    return _runs(spark, d).groupBy("stratum").agg(F.count("*").alias("n"), F.count_if((F.col("status_code") == 200) & ~F.col("expected_fail")).alias("scorable"))


def _scored(spark, d):
    return S.scored(table(spark, d, "bench_verdicts"))


#: Trial runs of one arm share what stands before the last dash of their tag.
FAMILY = r"^(.*?)(?:-[^-]*)?$"


def benchmark_board(spark, d):
    """Per run_tag over its own ids and over those all tags of its family graded: passes, partial, wrong."""
    return S.own_and_common(cut(_scored(spark, d)), "run_tag", "id", F.regexp_extract("run_tag", FAMILY, 1))


def answer_board(spark, d):
    """Per system, by majority of its tags, over its own ids and over those every system has."""
    v = S.scored(table(spark, d, "bench_verdicts").withColumn("run_tag", F.col("system")))
    return S.own_and_common(cut(v), "run_tag", "id", F.lit("systems"))


def excluded_ids(spark, d):
    """Per family of tags the ids some tag graded and another did not."""
    v = cut(_scored(spark, d).withColumn("family", F.regexp_extract("run_tag", FAMILY, 1)))
    arms = v.groupBy("family").agg(F.count_distinct("run_tag").alias("arms"))
    return v.groupBy("family", "id").agg(F.count_distinct("run_tag").alias("n")).join(arms, "family").where(F.col("n") < F.col("arms")).select("family", "id")


def router_board(spark, d):
    return S.router_board(cut(_runs(spark, d).where(F.col("gold_route").isNotNull())))


def eval_set_violations(spark, d):
    """Rules of an evaluation set broken by the recorded runs, by rule and stratum-free count."""
    r = table(spark, d, "ask_runs").groupBy("ask_id").agg(F.min(F.struct("stratum", "gold_route", "expected_fail", "status_code", F.size("sources").alias("n_sources"))).alias("r")).select(F.col("ask_id").alias("id"), "r.*")
    return S.set_violations(r).groupBy("rule").agg(F.count("*").alias("n"))


def regenerations(spark, d):
    """Each question's first two runs as an answer and its regeneration: which is kept, and what both cost."""
    r = _runs(spark, d).select("question_id", "ask_id", F.when(citation_defect(F.col("stratum"), F.lit(True), F.col("n_citations")).isNotNull(), 1).otherwise(0).cast("bigint").alias("defects"), F.col("cost_usd").alias("cost"))
    two = r.groupBy("question_id").agg(F.min("ask_id").alias("a1")).join(r, "question_id")
    firsts = two.where(F.col("ask_id") > F.col("a1")).groupBy("question_id").agg(F.min("ask_id").alias("ask_id")).withColumn("attempt", F.lit(2)).unionByName(two.where(F.col("ask_id") == F.col("a1")).select("question_id", "ask_id", F.lit(1).alias("attempt")))
    kept = keep_better(cut(r.join(firsts, ["question_id", "ask_id"]).select(F.col("question_id").alias("qid"), "attempt", "defects", "cost")))
    return kept.select(F.col("qid").alias("question_id"), "attempt", "defects", "attempts", "fixed", F.round("cost", 6).alias("cost"))


def majority_votes(spark, d):
    return S.majority(_scored(spark, d))


def repeat_flips(spark, d, first="e1-run-a", second="e1-run-b"):
    v = cut(_scored(spark, d))
    return S.paired(v.where(F.col("run_tag") == first), v.where(F.col("run_tag") == second))


def arm_comparison(spark, d, one="e1", other="e2"):
    """Two arms of three runs each by majority, ties left out."""
    v = cut(_scored(spark, d))
    a, b = (S.majority(v.where(F.col("run_tag").startswith(x))).where("not tied") for x in (one, other))
    j = a.select("id", F.col("passed").alias("pa")).join(b.select("id", F.col("passed").alias("pb")), "id")
    return j.agg(F.count("*").alias("common"), F.count_if(F.expr("pa and not pb")).alias("wins"), F.count_if(F.expr("pb and not pa")).alias("losses"), F.count_if(F.expr("pa = pb")).alias("concordant"))


def mcnemar(spark, d):
    """Exact two-sided test of the comparison, worked out on its one row of counts when the query runs."""

    def test(parts):
        for df in parts:
            yield df.assign(p=[round(S.mcnemar_exact(w, x), 9) for w, x in zip(df["wins"], df["losses"], strict=True)])

    return arm_comparison(spark, d).select("wins", "losses").mapInPandas(test, "wins bigint, losses bigint, p double")


def judge_agreement_board(spark, d, judge="panel-x"):
    h = table(spark, d, "judge_agreement").withColumn("v", S.verdict_key(F.col("verdict"))).where("v is not null").groupBy("id").agg(F.min("v").alias("v"))
    return S.agreement(_scored(spark, d).where(F.col("run_tag") == judge), h)


def stratified_sample(spark, d):
    q = table(spark, d, "bench_verdicts").groupBy("id").agg(F.min("stratum").alias("stratum"))
    return S.even_sample(q, "stratum", "id", 0.2)


def blind_rows(spark, d, system="hybrid"):
    """What a blind grader sees of one system: no verdict, no cost."""
    return table(spark, d, "bench_verdicts").where(F.col("system") == system).drop("verdict", "judge_cost_usd", "graded_at", "system").distinct()


def judge_costs(spark, d):
    v = table(spark, d, "bench_verdicts").distinct()
    return S.cost_totals(v, ["system"], "judge_cost_usd")


def cost_per_question(spark, d):
    """Cost of answering joined with cost of grading per stratum; an unknown part makes a row's cost unknown."""
    a = _runs(spark, d).groupBy("stratum").agg(F.avg("cost_usd").alias("ask"))
    b = table(spark, d, "bench_verdicts").distinct().groupBy("stratum").agg(F.avg("judge_cost_usd").alias("judge"))
    return a.join(b, "stratum", "left").select("stratum", F.round(F.col("ask") + F.col("judge"), 6).alias("cost"))


def citation_defects(spark, d):
    """Runs whose citations break the rule of their stratum."""
    r = _runs(spark, d).select("stratum", citation_defect(F.col("stratum"), F.lit(True), F.col("n_citations")).alias("defect"))
    return r.where("defect is not null").groupBy("stratum", "defect").agg(F.count("*").alias("n"))


def run_gaps(spark, d):
    return S.gaps(table(spark, d, "ask_runs").select((F.col("ask_id") + 1).alias("n")), "n")


_ONE = "runs AS (SELECT ask_id, r.question_id, r.stratum, r.gold_route, r.expected_fail, r.status_code, lower(trim(r.route)) AS route, r.latency_ms, r.cost_usd, r.n_citations FROM (SELECT ask_id, min({'question_id': question_id, 'stratum': stratum, 'gold_route': gold_route, 'expected_fail': expected_fail, 'status_code': status_code, 'route': route, 'latency_ms': latency_ms, 'cost_usd': cost_usd, 'n_citations': n_citations, 'answer_chars': answer_chars}) AS r FROM ask_runs GROUP BY ask_id))"
_V = "regexp_replace(regexp_replace(lower(verdict), '[^a-z]+', '_', 'g'), '^_+|_+$', '', 'g')"
_SCORED = f"sc AS (SELECT id, run_tag, arg_max(v, (graded_at, v)) AS v, min(stratum) AS stratum FROM (SELECT *, {_V} AS v FROM bench_verdicts) WHERE v IN ('correct', 'partially_correct', 'wrong', 'correct_refusal') GROUP BY id, run_tag)"
_PASS = "v IN ('correct', 'correct_refusal')"
_FAMILY = "regexp_extract(run_tag, '^(.*?)(?:-[^-]*)?$', 1)"


def _own_common(rows: str) -> str:
    """rows(family, arm, key, v) as CTE r."""
    return f"""r AS ({rows}), arms AS (SELECT family, count(DISTINCT arm) AS arms FROM r GROUP BY family), ok AS (SELECT r.family, key FROM r JOIN arms USING (family) GROUP BY r.family, key, arms HAVING count(DISTINCT arm) = arms),
e AS (SELECT family, arm, v, 'own' AS scope FROM r UNION ALL SELECT family, arm, v, 'common' FROM r SEMI JOIN ok USING (family, key))
SELECT family, arm, scope, count(*) AS n, count(*) FILTER ({_PASS}) AS passed, count(*) FILTER (v = 'partially_correct') AS partial, count(*) FILTER (v = 'wrong') AS wrong, round(count(*) FILTER ({_PASS}) / count(*), 6) AS pass_rate FROM e GROUP BY family, arm, scope"""


def _maj(name: str, where: str) -> str:
    return f"{name} AS (SELECT id, count(*) AS n, count(*) FILTER ({_PASS}) AS passes FROM sc WHERE {where} GROUP BY id)"


_ARMS = f"WITH {_SCORED}, {_maj('a', "run_tag LIKE 'e1%'")}, {_maj('b', "run_tag LIKE 'e2%'")}, j AS (SELECT 2 * a.passes > a.n AS pa, 2 * b.passes > b.n AS pb FROM a JOIN b USING (id) WHERE 2 * a.passes <> a.n AND 2 * b.passes <> b.n), w AS (SELECT count(*) AS common, count(*) FILTER (pa AND NOT pb) AS wins, count(*) FILTER (pb AND NOT pa) AS losses, count(*) FILTER (pa = pb) AS concordant FROM j)"
_COST = "count(*) AS n, count(*) FILTER ({c} IS NULL) AS unpriced, round(sum({c}), 6) AS known_cost, CASE WHEN count(*) FILTER ({c} IS NULL) = 0 THEN round(sum({c}), 6) END AS strict_cost"

QUERIES = {
    f.__name__: f
    for f in (interface_board, interface_costs, latency_stalls, route_confusion, route_accuracy, scorable_runs, benchmark_board, answer_board, excluded_ids, router_board, eval_set_violations, regenerations, majority_votes, repeat_flips, arm_comparison, mcnemar, judge_agreement_board, stratified_sample, blind_rows, judge_costs, cost_per_question, citation_defects, run_gaps)
}
ORACLE = {
    "interface_board": f"""WITH {_ONE}, x AS (SELECT route, latency_ms AS x, row_number() OVER (PARTITION BY route ORDER BY latency_ms) AS r, count(*) OVER (PARTITION BY route) AS n FROM runs WHERE latency_ms >= 0 AND CAST(latency_ms AS VARCHAR) <> 'nan')
SELECT route, max(n) AS n, round(max(x) FILTER (r = least(n, greatest(1, round_even(0.95 * n + 0.5, 0)))), 6) AS p95_v1, round(max(x) FILTER (r = greatest(1, round_even(0.95 * n, 0))), 6) AS p95_v2, round(max(x) FILTER (r = n // 2 + 1), 6) AS p50_upper, round((max(x) FILTER (r = (n + 1) // 2) + max(x) FILTER (r = n // 2 + 1)) / 2, 6) AS median FROM x GROUP BY route""",
    "interface_costs": f"WITH {_ONE} SELECT route, {_COST.format(c='cost_usd')} FROM runs GROUP BY route",
    "latency_stalls": f"WITH {_ONE} SELECT route, count(*) FILTER (latency_ms > 1000) AS stalls, round(max(latency_ms), 6) AS slowest FROM runs WHERE CAST(latency_ms AS VARCHAR) <> 'nan' GROUP BY route",
    "route_confusion": f"WITH {_ONE} SELECT gold_route, count(*) FILTER (route = 'vector') AS vector, count(*) FILTER (route = 'graph') AS graph, count(*) FILTER (route = 'both') AS \"both\" FROM runs GROUP BY gold_route",
    "route_accuracy": f"WITH {_ONE}, a AS (SELECT gold_route, 'recorded' AS arm, route AS said FROM runs UNION ALL SELECT gold_route, 'always-' || x, x FROM runs, (VALUES ('vector'), ('graph'), ('both')) t(x)) SELECT arm, count(*) AS n, count(*) FILTER (said = gold_route) AS \"right\", count(*) FILTER (said IS NULL) AS unparsed FROM a GROUP BY arm",
    "scorable_runs": f"WITH {_ONE} SELECT stratum, count(*) AS n, count(*) FILTER (status_code = 200 AND NOT expected_fail) AS scorable FROM runs GROUP BY stratum",
    "benchmark_board": f"WITH {_SCORED}, {_own_common(f'SELECT {_FAMILY} AS family, run_tag AS arm, id AS key, v FROM sc')}",
    "answer_board": f"WITH sc AS (SELECT id, system, arg_max(v, (graded_at, v)) AS v FROM (SELECT *, {_V} AS v FROM bench_verdicts) WHERE v IN ('correct', 'partially_correct', 'wrong', 'correct_refusal') GROUP BY id, system), {_own_common("SELECT 'systems' AS family, system AS arm, id AS key, v FROM sc")}",
    "excluded_ids": f"WITH {_SCORED}, r AS (SELECT {_FAMILY} AS family, run_tag, id FROM sc), a AS (SELECT family, count(DISTINCT run_tag) AS arms FROM r GROUP BY family) SELECT family, id FROM r JOIN a USING (family) GROUP BY family, id, arms HAVING count(DISTINCT run_tag) < arms",
    "router_board": f"""WITH {_ONE}, a AS (SELECT *, 'recorded' AS arm, route AS said, true AS own FROM runs WHERE gold_route IS NOT NULL UNION ALL SELECT runs.*, 'always-' || x, x, false FROM runs, (VALUES ('vector'), ('graph'), ('both')) t(x) WHERE gold_route IS NOT NULL),
g AS (SELECT arm, CASE WHEN grouping(stratum) = 1 THEN '(all)' ELSE stratum END AS stratum, count(*) AS n, count(*) FILTER (said = gold_route) AS "right", count(*) FILTER (said IS NULL) AS unparsed, round(count(*) FILTER (said = gold_route) / count(*), 6) AS accuracy,
 round(avg(latency_ms) FILTER (own AND latency_ms >= 0 AND NOT isnan(latency_ms)), 3) AS mean_ms, round(sum(cost_usd) FILTER (own), 6) AS cost_usd FROM a GROUP BY GROUPING SETS ((arm, stratum), (arm)))
SELECT *, "right" > max("right") FILTER (arm <> 'recorded') OVER (PARTITION BY stratum) AS beats FROM g""",
    "eval_set_violations": """WITH r AS (SELECT ask_id, min({'stratum': stratum, 'gold_route': gold_route, 'expected_fail': expected_fail, 'status_code': status_code, 'n': len(sources)}) AS s FROM ask_runs GROUP BY ask_id), x AS (SELECT ask_id, unnest(s) FROM r),
v AS (SELECT unnest(list_filter([CASE WHEN stratum NOT IN ('out-of-scope', 'unanswerable') AND n = 0 THEN 'no sources' END, CASE WHEN stratum IN ('out-of-scope', 'unanswerable') AND n > 0 THEN 'sources for a refusal' END, CASE WHEN expected_fail AND status_code = 200 THEN 'expected to fail' END, CASE WHEN gold_route IS NULL OR gold_route NOT IN ('vector', 'graph', 'both') THEN 'unknown route' END], lambda z: z IS NOT NULL)) AS rule FROM x
UNION ALL SELECT 'majority ' || gold_route FROM x GROUP BY gold_route HAVING count(*) > 0.6 * (SELECT count(*) FROM x)) SELECT rule, count(*) AS n FROM v WHERE rule IS NOT NULL GROUP BY rule""",
    "regenerations": f"""WITH {_ONE}, x AS (SELECT question_id, CAST(CASE WHEN stratum IN ('out-of-scope', 'unanswerable') THEN n_citations > 0 ELSE n_citations = 0 END AS BIGINT) AS defects, cost_usd AS cost, row_number() OVER (PARTITION BY question_id ORDER BY ask_id) AS i FROM runs),
j AS (SELECT a.question_id, coalesce(a.defects, 0) AS d1, a.cost AS c1, coalesce(b.defects, 0) AS d2, b.cost AS c2, b.i IS NOT NULL AS has FROM x a LEFT JOIN x b ON b.question_id = a.question_id AND b.i = 2 WHERE a.i = 1)
SELECT question_id, CAST(CASE WHEN has AND d2 < d1 THEN 2 ELSE 1 END AS BIGINT) AS attempt, CASE WHEN has AND d2 < d1 THEN d2 ELSE d1 END AS defects, CAST(CASE WHEN has AND d1 > 0 THEN 2 ELSE 1 END AS BIGINT) AS attempts, has AND d2 < d1 AND d2 = 0 AS fixed, round(CASE WHEN has AND d1 > 0 THEN c1 + c2 ELSE c1 END, 6) AS cost FROM j""",
    "majority_votes": f"WITH {_SCORED}, {_maj('a', 'true')} SELECT id, n, passes, 2 * passes > n AS passed, 2 * passes = n AS tied FROM a",
    "repeat_flips": f"WITH {_SCORED}, j AS (SELECT a.stratum, a.v AS va, b.v AS vb, a.{_PASS} AS pa, b.{_PASS} AS pb FROM sc a JOIN sc b USING (id) WHERE a.run_tag = 'e1-run-a' AND b.run_tag = 'e1-run-b') SELECT CASE WHEN grouping(stratum) = 1 THEN '(all)' ELSE stratum END AS stratum, count(*) AS n, count(*) FILTER (va <> vb) AS verdict_flips, count(*) FILTER (pa AND NOT pb) AS a_only, count(*) FILTER (pb AND NOT pa) AS b_only FROM j GROUP BY GROUPING SETS ((stratum), ())",
    "arm_comparison": _ARMS + " SELECT * FROM w",
    "mcnemar": _ARMS + ", s AS (SELECT wins, losses, wins + losses AS n, least(wins, losses) AS k FROM w), t AS (SELECT wins, losses, n, sum(exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) - n * ln(2))) AS tail FROM s, (SELECT unnest(range(0, 100000)) AS i) WHERE i <= k GROUP BY ALL) SELECT wins, losses, CASE WHEN n = 0 THEN 1.0 ELSE round(least(1.0, 2 * tail), 9) END AS p FROM t",
    "judge_agreement_board": f"WITH {_SCORED}, h AS (SELECT id, min({_V}) AS h FROM judge_agreement WHERE {_V} IN ('correct', 'partially_correct', 'wrong', 'correct_refusal') GROUP BY id), j AS (SELECT id, v FROM sc WHERE run_tag = 'panel-x') SELECT count(*) AS n, count(*) FILTER (h = v) AS matches, count(*) FILTER (v IS NULL) AS missing, count(*) FILTER ((h IN ('correct', 'correct_refusal')) = ({_PASS})) AS pass_matches FROM h LEFT JOIN j USING (id)",
    "stratified_sample": "WITH q AS (SELECT id, min(stratum) AS stratum FROM bench_verdicts GROUP BY id), r AS (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY id) - 1 AS i, count(*) OVER (PARTITION BY stratum) AS n FROM q), t AS (SELECT DISTINCT stratum, n, greatest(1, round_even(n * 0.2, 0))::BIGINT AS take FROM r), p AS (SELECT stratum, s * n // take AS i FROM (SELECT stratum, n, take, unnest(range(0, take)) AS s FROM t)) SELECT stratum, id FROM r JOIN p USING (stratum, i)",
    "blind_rows": "SELECT DISTINCT run_tag, id, stratum FROM bench_verdicts WHERE system = 'hybrid'",
    "judge_costs": f"SELECT system, {_COST.format(c='judge_cost_usd')} FROM (SELECT DISTINCT * FROM bench_verdicts) GROUP BY system",
    "cost_per_question": f"WITH {_ONE}, a AS (SELECT stratum, avg(cost_usd) AS ask FROM runs GROUP BY stratum), b AS (SELECT stratum, avg(judge_cost_usd) AS judge FROM (SELECT DISTINCT * FROM bench_verdicts) GROUP BY stratum) SELECT stratum, round(ask + judge, 6) AS cost FROM a LEFT JOIN b USING (stratum)",
    "citation_defects": f"WITH {_ONE}, x AS (SELECT stratum, CASE WHEN stratum IN ('out-of-scope', 'unanswerable') THEN CASE WHEN n_citations > 0 THEN 'cited a refusal' END WHEN n_citations = 0 THEN 'uncited' END AS defect FROM runs) SELECT stratum, defect, count(*) AS n FROM x WHERE defect IS NOT NULL GROUP BY ALL",
    "run_gaps": "SELECT count(*) AS n, max(ask_id + 1) AS top, max(ask_id + 1) = count(DISTINCT ask_id) AS gapless FROM ask_runs",
}
