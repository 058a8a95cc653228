"""Citations: labels in prose, allowed ids, spans, and what must be repaired."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgraph.functions.text import labels_in


def all_allowed(cited: Column, retrieved: Column) -> Column:
    """Whether every cited id was retrieved."""
    return F.size(F.array_except(cited, retrieved)) == 0


def span_fits(answer: Column, start: Column, end: Column, text: Column) -> Column:
    """Whether answer[start:end], in code points, is in range and equals the cited text."""
    inside = (start >= 0) & (end >= start) & (end <= F.length(answer))
    return F.coalesce(inside & (F.substring(answer, start + 1, end - start) == text), F.lit(False))


def uncited(answer: Column, shown: Column) -> Column:
    """Labels the prose names though no document showed them, in order of first appearance."""
    return F.array_except(labels_in(answer), shown)


def rebase(citations: DataFrame, blocks: DataFrame) -> DataFrame:
    """citations(qid, i, start, end, text, document_id) index a block; blocks(qid, i, text, offset) place it in the answer.

    Out come ``qid, start, end, text, document_id, dropped``: offsets in the answer, or why the citation is dropped.
    """
    j = citations.join(blocks.select("qid", "i", F.col("text").alias("block"), "offset"), ["qid", "i"], "left")
    why = F.when(F.col("block").isNull(), "no such block").when((F.col("start") < 0) | (F.col("end") > F.length("block")) | (F.col("end") < F.col("start")), "out of range").when(F.substring(F.col("block"), F.col("start") + 1, F.col("end") - F.col("start")) != F.col("text"), "other text").when(F.col("document_id").isNull(), "no document")
    return j.select("qid", (F.col("start") + F.col("offset")).alias("start"), (F.col("end") + F.col("offset")).alias("end"), "text", "document_id", why.alias("dropped"))


def fan_out(kept: DataFrame, documents: DataFrame, labels: DataFrame) -> DataFrame:
    """A citation of a document is one of each chunk behind it: documents(qid, document_id, provenance)."""
    each = documents.select("qid", "document_id", F.explode("provenance").alias("chunk_id"))
    return kept.join(each, ["qid", "document_id"]).join(labels.select("chunk_id", "citation_label"), "chunk_id", "left")


def citation_defect(stratum: Column, must_cite: Column, n_citations: Column) -> Column:
    """What is wrong with the number of citations: some where a refusal is due, or none where one must be; else null."""
    return F.when(stratum.isin("out-of-scope", "unanswerable") & (n_citations > 0), "cited a refusal").when(~stratum.isin("out-of-scope", "unanswerable") & must_cite & (n_citations == 0), "uncited")


def cap_verdict(verdict: Column, defect: Column) -> Column:
    """A right verdict with a citation defect is at most partially correct."""
    return F.when(verdict.isin("correct", "correct_refusal") & defect.isNotNull(), "partially_correct").otherwise(verdict)


def labels_shown(documents: DataFrame) -> DataFrame:
    """documents(qid, citation_label, text) -> ``qid, labels``: every label a prompt showed, a document's own or in its text.

    A count of further labels is no label.
    """
    own = F.array_compact(F.array(F.regexp_replace(F.trim("citation_label"), r"\s+", " ")))
    each = documents.select("qid", F.explode(F.array_union(own, F.coalesce(labels_in(F.col("text")), F.array().cast("array<string>")))).alias("label"))
    return each.groupBy("qid").agg(F.array_sort(F.collect_set("label")).alias("labels"))


def keep_better(attempts: DataFrame) -> DataFrame:
    """attempts(qid, attempt, defects, cost): of a first answer and its one regeneration the better; ties keep the first.

    ``qid, attempt, defects, attempts, fixed, cost``: both are paid for, and an unknown cost makes the sum unknown. A
    first answer without defects is never asked again, so later attempts of it are left out.
    """
    first = attempts.where(F.col("attempt") == 1).select("qid", F.col("defects").alias("d1"), F.col("cost").alias("c1"))
    again = attempts.where(F.col("attempt") == 2).select("qid", F.col("defects").alias("d2"), F.col("cost").alias("c2"))
    j = first.join(again, "qid", "left")
    used = (F.col("d1") > 0) & F.col("d2").isNotNull()
    better = used & (F.col("d2") < F.col("d1"))
    return j.select(
        "qid",
        F.when(better, 2).otherwise(1).cast("bigint").alias("attempt"),
        F.when(better, F.col("d2")).otherwise(F.col("d1")).alias("defects"),
        F.when(used, 2).otherwise(1).cast("bigint").alias("attempts"),
        (better & (F.col("d2") == 0)).alias("fixed"),
        F.when(used, F.col("c1") + F.col("c2")).otherwise(F.col("c1")).alias("cost"),
    )
