"""Context assembly: interleaving, deduplication, budgets, spans and positions of documents per question."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def round_robin(docs: DataFrame, n: int) -> DataFrame:
    """docs(qid, call, pos, ...): the calls' first documents, then their second ones, and so on, n in all."""
    turn = F.row_number().over(Window.partitionBy("qid", "call").orderBy("pos"))
    at = F.row_number().over(Window.partitionBy("qid").orderBy("turn", "call"))
    return docs.withColumn("turn", turn).withColumn("at", at).where(F.col("at") <= n).drop("turn")


def first_per_text(docs: DataFrame) -> DataFrame:
    """Of documents of equal text per question the first by pos."""
    return docs.withColumn("_r", F.row_number().over(Window.partitionBy("qid", "text").orderBy("pos"))).where("_r = 1").drop("_r")


def dedupe_two_keys(docs: Column) -> Column:
    """Fold an ordered array of struct(id, text): drop what shares its id or text with one already kept.

    Only kept documents block others, so this is no pair of distincts. One question's list is bounded by its depth.
    """
    empty = F.expr("cast(array() as array<struct<id:string,text:string>>)")
    return F.aggregate(docs, empty, lambda kept, d: F.when(F.exists(kept, lambda k: (k["id"] == d["id"]) | (k["text"] == d["text"])), kept).otherwise(F.array_append(kept, d)))


def budget_first(docs: DataFrame, n: int) -> DataFrame:
    return docs.withColumn("at", F.row_number().over(Window.partitionBy("qid").orderBy("pos"))).where(F.col("at") <= n)


def budget_anchor(docs: DataFrame, names: DataFrame, n: int) -> DataFrame:
    """Documents naming a linked entity (names(qid, names)) first, the others behind, each in order."""
    low = F.lower("text")
    hit = F.exists(F.coalesce("names", F.array().cast("array<string>")), lambda x: (x != "") & F.contains(low, F.lower(x)))
    ranked = docs.join(names, "qid", "left").withColumn("hit", hit)
    return ranked.withColumn("at", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("hit"), "pos"))).where(F.col("at") <= n).drop("names")


def budget_rerank(docs: DataFrame, relevance: DataFrame, n: int) -> DataFrame:
    """docs(qid, pos, ...), relevance(qid, pos, relevance): the n most relevant documents, ties in the order given."""
    at = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("relevance"), "pos"))
    return docs.join(relevance.select("qid", "pos", "relevance"), ["qid", "pos"]).withColumn("at", at).where(F.col("at") <= n)


def rank_shifts(before: DataFrame, after: DataFrame) -> DataFrame:
    """Lists (qid, pos, key) before and after reranking: ``qid, key, before, after, shift``; null where a list lacks the key."""
    b, a = before.select("qid", "key", F.col("pos").alias("before")), after.select("qid", "key", F.col("pos").alias("after"))
    return b.join(a, ["qid", "key"], "full").withColumn("shift", F.col("before") - F.col("after"))


def overlap(one: DataFrame, other: DataFrame) -> DataFrame:
    """Lists (qid, key) of two paths: ``qid, n_one, n_other, n_both``; a report, nothing is dropped."""
    both = one.select("qid", "key").distinct().withColumn("o", F.lit(1)).join(other.select("qid", "key").distinct().withColumn("p", F.lit(1)), ["qid", "key"], "full")
    return both.groupBy("qid").agg(F.count("o").alias("n_one"), F.count("p").alias("n_other"), F.count(F.when(F.col("o").isNotNull() & F.col("p").isNotNull(), 1)).alias("n_both"))


def offsets(blocks: DataFrame) -> DataFrame:
    """blocks(qid, i, text): where each text block begins in the joined answer; null texts take no room."""
    before = Window.partitionBy("qid").orderBy("i").rowsBetween(Window.unboundedPreceding, -1)
    return blocks.withColumn("offset", F.coalesce(F.sum(F.coalesce(F.length("text"), F.lit(0))).over(before), F.lit(0)))


def joined_spans(records: DataFrame, separator: str = "\n") -> DataFrame:
    """records(qid, i, text): start and end of each record in their concatenation."""
    w = Window.partitionBy("qid").orderBy("i").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.length("text") + len(separator)).over(w), F.lit(0))
    return records.select("qid", "i", start.alias("start"), (start + F.length("text")).alias("end"))


def augment(enumerated: DataFrame, ranked: DataFrame) -> DataFrame:
    """Lists (qid, pos, key): the enumerated provision first, then what ranking adds to it."""
    rest = ranked.join(enumerated.select("qid", "key"), ["qid", "key"], "left_anti")
    both = enumerated.select("qid", "key", F.lit(0).alias("arm"), "pos").unionByName(rest.select("qid", "key", F.lit(1).alias("arm"), "pos"))
    return both.select("qid", F.row_number().over(Window.partitionBy("qid").orderBy("arm", "pos")).alias("pos"), "key", "arm")


def assemble(graph: DataFrame, passages: DataFrame, n: int) -> DataFrame:
    """Graph statements within the budget, then passages without repeats, numbered d0, d1, ... per question."""
    g = budget_first(first_per_text(graph), n).select("qid", F.lit(0).alias("part"), F.col("at").alias("pos"), "id", "text", F.lit("GRAPH").alias("source"))
    packed = passages.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("pos", "id", "text"))).alias("d"))
    kept = packed.select("qid", F.posexplode(dedupe_two_keys(F.transform("d", lambda x: F.struct(x["id"].alias("id"), x["text"].alias("text"))))).alias("pos", "d"))
    p = kept.select("qid", F.lit(1).alias("part"), "pos", "d.id", "d.text", F.lit("PASSAGE").alias("source"))
    at = F.row_number().over(Window.partitionBy("qid").orderBy("part", "pos")) - 1
    return g.unionByName(p).withColumn("document_id", F.concat(F.lit("d"), at)).select("qid", "document_id", "id", "text", "source")
