"""p1 to p4 and p6 to p9 as named queries; each reads its whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillgraph.functions.unicode import WHITE_SPACE
from quillgraph.llm.answers import defects
from quillgraph.llm.consensus import consensus
from quillgraph.llm.linking import link_spans, unmatched_spans
from quillgraph.llm.mixing import mix
from quillgraph.llm.packing import pack_items
from quillgraph.llm.quantiles import EPS, day_summaries, rollup, run_values
from quillgraph.llm.splitting import limit, split_texts
from quillgraph.llm.tokens import count_tokens
from quillgraph.llm.truncation import truncation
from quillgraph.plans.runtime import cut, join_sized, table


def _consensus(spark: SparkSession, sf_dir: str):
    return consensus(table(spark, sf_dir, "bench_verdicts"), table(spark, sf_dir, "judge_agreement"))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _consensus(spark, sf_dir).items.select("id", "verdict")


def p1_annotators(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per run_tag its votes, its smoothed reliability without its own say, and how independent its mistakes are."""
    return _consensus(spark, sf_dir).annotators


def p1_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _consensus(spark, sf_dir)
    return spark.createDataFrame([(c.alpha, c.n_items, c.n_votes)], "alpha double, n_items bigint, n_votes bigint").select(F.round("alpha", 6).alias("alpha"), "n_items", "n_votes")


def p2_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollup(table(spark, sf_dir, "ask_runs"))


def p2_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mergeable form: one rank-interval summary per day, route and metric."""
    return day_summaries(run_values(table(spark, sf_dir, "ask_runs")), EPS)


def p2_verified(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every percentile held against the values themselves: whether its true ranks meet the wanted rank within the error it states, and this within EPS."""
    runs = table(spark, sf_dir, "ask_runs")
    keys = ["scope", "period", "route", "metric"]
    p = cut(rollup(runs))
    told = p.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("q", "percentile", "rank_error"))).alias("p"), F.max("n").alias("stated"))  # five of a group
    v = run_values(runs)
    each = v.select("route", "metric", "x", F.inline(F.array(*(F.struct(F.lit(s).alias("scope"), x.alias("period")) for s, x in (("day", F.col("day")), ("month", F.substring("day", 1, 7)), ("all", F.lit("all")))))))
    counted = join_sized(each, told, keys).select(*keys, "stated", F.posexplode("p").alias("i", "p"), "x")
    c = counted.groupBy(*keys, F.col("p.q").alias("q"), F.col("p.rank_error").alias("e")).agg(F.count("*").alias("n"), F.count_if(F.col("x") < F.col("p.percentile")).alias("below"), F.count_if(F.col("x") <= F.col("p.percentile")).alias("upto"), F.max("stated").alias("stated"))
    rank, room = F.ceil(F.col("q") * F.col("n")), F.floor(F.col("e") * F.col("n") + 1e-6)
    met = (F.col("below") + 1 <= rank + room) & (F.col("upto") >= rank - room) & (F.col("stated") == F.col("n")) & (F.col("e") <= EPS)
    return c.select(*keys, "q", "n", met.alias("met"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_spans(table(spark, sf_dir, "linked_spans"), table(spark, sf_dir, "graph_nodes"))


def p3_unmatched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report of spans that mean no entry or fit several alike."""
    return unmatched_spans(table(spark, sf_dir, "linked_spans"), table(spark, sf_dir, "graph_nodes"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return defects(table(spark, sf_dir, "answers"))


def p6_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    capacity, overlap = limit(table(spark, sf_dir, "size_limits"), "chunk_words")
    return split_texts(table(spark, sf_dir, "chunks"), "chunk_id", "text", capacity, overlap)


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks that come out in more than one piece."""
    return p6_pieces(spark, sf_dir).where((F.col("piece") == 0) & (F.col("pieces") > 1)).select("chunk_id").distinct()


def p6_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per chunk with a word: the words its pieces hold without their overlaps, and whether each piece fits and joins the one before."""
    capacity, overlap = limit(table(spark, sf_dir, "size_limits"), "chunk_words")
    held = F.collect_list(F.struct("piece", "first_word", "n_words"))  # the pieces of one text
    g = p6_pieces(spark, sf_dir).groupBy("chunk_id").agg(F.sort_array(held).alias("p"), F.max("pieces").alias("pieces"))
    at = lambda i: F.get("p", i)
    joins = F.forall(F.sequence(F.lit(0), F.size("p") - 1), lambda i: (at(i)["n_words"] <= capacity) & F.when(i == 0, at(i)["first_word"] == 0).otherwise(at(i)["first_word"] == at(i - 1)["first_word"] + at(i - 1)["n_words"] - overlap))
    last = F.element_at("p", -1)
    return g.select("chunk_id", (last["first_word"] + last["n_words"]).cast("bigint").alias("n_words"), (joins & (F.size("p") == F.col("pieces"))).alias("whole"))


def _sized(spark: SparkSession, sf_dir: str, *kept: str) -> DataFrame:
    """Documents in tokens, written once: packing and mixing read the counts more than once."""
    return cut(count_tokens(table(spark, sf_dir, "documents"), "doc_id", "text", *kept))


def p7_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    limits = table(spark, sf_dir, "size_limits").where(F.col("unit") == "tokens").select("capacity").distinct().collect()  # a table of settings
    return pack_items(_sized(spark, sf_dir), "doc_id", "n_tokens", [r.capacity for r in limits])


def p7_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per capacity its containers, their tokens and the share of space left unused."""
    boxes = p7_containers(spark, sf_dir).where(F.col("container").isNotNull()).groupBy("container", "capacity").agg(F.sum("n").alias("n"))
    return boxes.groupBy("capacity").agg(F.count("*").alias("n_containers"), F.sum("n").alias("tokens"), F.round(1 - F.sum("n") / F.sum("capacity"), 6).alias("unused_share"))


def p7_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row: documents with tokens, whether each lies whole in containers, and whether no container holds more than it can."""
    boxes = cut(p7_containers(spark, sf_dir).where(F.col("container").isNotNull()))
    sized = _sized(spark, sf_dir).where("n_tokens > 0").select("doc_id", "n_tokens")
    per = boxes.groupBy("doc_id").agg(F.sum("n").alias("held"), F.max(F.col("first") + F.col("n")).alias("upto"), F.count("*").alias("parts"), F.min("n").alias("least"))
    j = sized.join(per, "doc_id", "full")
    top = boxes.agg(F.max("capacity")).first()[0]
    whole = (F.col("held") == F.col("n_tokens")) & (F.col("upto") == F.col("n_tokens")) & ((F.col("parts") == 1) | (F.col("n_tokens") > top))
    fits = boxes.groupBy("container", "capacity").agg(F.sum("n").alias("n")).agg(F.bool_and(F.col("n") <= F.col("capacity")).alias("fits"))
    return j.agg(F.count("*").alias("n_docs"), F.bool_and(F.coalesce(whole, F.lit(False))).alias("whole")).crossJoin(fits)  # one row each


def p8_collection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(_sized(spark, sf_dir, "source"), table(spark, sf_dir, "mix_targets"))[0]


def p8_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(_sized(spark, sf_dir, "source"), table(spark, sf_dir, "mix_targets"))[1]


def p8_verified(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per target source: whether the collection itself, counted by its stretches, holds the share reported, near the target, and repeats within the cap."""
    col, shares = mix(_sized(spark, sf_dir, "source"), table(spark, sf_dir, "mix_targets"))
    got = col.groupBy("source").agg(F.sum("n").alias("n"), (F.max("repeat") + 1).alias("most"))
    j = shares.join(got, "source", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    held = F.sum(F.when(F.col("tokens_held") > 0, F.col("target_share"))).over(Window.partitionBy())  # one row a target
    wanted = F.when(F.col("tokens_held") > 0, F.col("target_share") / held).otherwise(0.0)
    met = (F.col("n") == F.col("tokens")) & (F.coalesce("most", F.lit(0)) <= F.col("max_repeats")) & (F.abs(F.col("actual_share") - wanted) < 0.005)
    return j.select("source", F.round("target_share", 6).alias("target_share"), met.alias("met"))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return truncation(table(spark, sf_dir, "documents")).where("truncated").select("doc_id")


def p9_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per source how many texts are cut and how many of those at a limit of the source."""
    cut_at_limit = F.col("truncated") & F.col("at_limit")
    return truncation(table(spark, sf_dir, "documents")).groupBy("source").agg(F.count("*").alias("n_texts"), F.count_if("truncated").alias("n_truncated"), F.count_if(cut_at_limit).alias("n_at_limit"), F.round(F.avg(F.col("truncated").cast("int")), 6).alias("rate"))


_WORDS = "[^" + "".join(f"\\x{{{ord(c):X}}}" for c in WHITE_SPACE) + "]+"

QUERIES = {
    "p1_found": p1_found,
    "p1_annotators": p1_annotators,
    "p1_agreement": p1_agreement,
    "p2_percentiles": p2_percentiles,
    "p2_summaries": p2_summaries,
    "p2_verified": p2_verified,
    "p3_found": p3_found,
    "p3_unmatched": p3_unmatched,
    "p4_found": p4_found,
    "p6_found": p6_found,
    "p6_pieces": p6_pieces,
    "p6_round_trip": p6_round_trip,
    "p7_containers": p7_containers,
    "p7_report": p7_report,
    "p7_whole": p7_whole,
    "p8_collection": p8_collection,
    "p8_shares": p8_shares,
    "p8_verified": p8_verified,
    "p9_found": p9_found,
    "p9_rates": p9_rates,
}
_VERDICT = "regexp_replace(regexp_replace(lower(verdict), '[^a-z]+', '_', 'g'), '^_+|_+$', '', 'g')"

ORACLE: dict[str, str] = {
    "p1_agreement": f"""
WITH v AS (SELECT id, run_tag, list_position(['correct', 'partially_correct', 'wrong', 'correct_refusal'], {_VERDICT}) AS vote, graded_at FROM bench_verdicts),
one AS (SELECT id, run_tag, arg_max(vote, (graded_at, -vote)) AS vote FROM v WHERE vote > 0 GROUP BY id, run_tag),
per AS (SELECT id, vote, count(*) AS n FROM one GROUP BY id, vote), m AS (SELECT id, sum(n) AS m FROM per GROUP BY id),
paired AS (SELECT * FROM per JOIN m USING (id) WHERE m > 1), t AS (SELECT vote, sum(n) AS t FROM paired GROUP BY vote), total AS (SELECT sum(t) AS total FROM t)
SELECT round(CAST(1 - (1 - (SELECT sum(n * (n - 1) / (m - 1)) FROM paired) / total) / ((SELECT sum(t * (total - t)) FROM t) / (total * (total - 1))) AS DOUBLE), 6) AS alpha,
  CAST((SELECT count(*) FROM m) AS BIGINT) AS n_items, CAST((SELECT sum(m) FROM m) AS BIGINT) AS n_votes FROM total""",
    "p6_found": f"SELECT chunk_id FROM chunks, (SELECT max(capacity) AS most FROM size_limits WHERE limit_name = 'chunk_words') WHERE len(regexp_extract_all(text, '{_WORDS}')) > most",
    "p2_verified": """WITH r AS (SELECT ask_id, min({'asked_at': asked_at, 'route': route, 'latency_ms': latency_ms, 'cost_usd': cost_usd}) AS r FROM ask_runs GROUP BY ask_id), one AS (SELECT unnest(r) FROM r),
v AS (SELECT strftime(asked_at, '%Y-%m-%d') AS day, coalesce(nullif(lower(trim(route)), ''), '(none)') AS route, unnest(['latency_ms', 'cost_usd']) AS metric, unnest([latency_ms, cost_usd]) AS x FROM one),
e AS (SELECT route, metric, unnest(['day', 'month', 'all']) AS scope, unnest([day, left(day, 7), 'all']) AS period FROM v WHERE x >= 0 AND NOT isnan(x))
SELECT scope, period, route, metric, CAST(q AS DOUBLE) AS q, count(*) AS n, true AS met FROM e, (VALUES (0.5), (0.75), (0.9), (0.95), (0.99)) t(q) GROUP BY ALL""",
    "p6_round_trip": f"SELECT * FROM (SELECT chunk_id, CAST(len(regexp_extract_all(text, '{_WORDS}')) AS BIGINT) AS n_words, true AS whole FROM chunks) WHERE n_words > 0",
    "p7_whole": "SELECT count(*) AS n_docs, true AS whole, true AS fits FROM documents WHERE length(text) > 0",
    "p8_verified": "SELECT source, round(sum(target_share), 6) AS target_share, true AS met FROM (SELECT regexp_replace(lower(trim(source)), '[-\\s]+', '_', 'g') AS source, target_share FROM mix_targets) GROUP BY source",
}
