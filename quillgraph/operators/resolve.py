"""Entity resolution: normalised keys, plural folding, type votes, nodes and their names, audits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.functions.text import name_keys
from quillgraph.plans.runtime import cut, join_sized
from quillgraph.schemas import AUTHORITY_WORDS, CATCH_ALL, TYPE_PRIORITY


def plural_map(names: DataFrame) -> DataFrame:
    """names(key) -> ``plural, singular`` where both are attested; -s before -ies before -es, one step only."""
    n = names.select("key").distinct()
    forms = F.array(
        F.struct(F.lit(0).alias("r"), F.when(F.col("key").endswith("s"), F.expr("left(key, length(key) - 1)")).alias("s")),
        F.struct(F.lit(1).alias("r"), F.when(F.col("key").endswith("ies"), F.concat(F.expr("left(key, length(key) - 3)"), F.lit("y"))).alias("s")),
        F.struct(F.lit(2).alias("r"), F.when(F.col("key").endswith("es"), F.expr("left(key, length(key) - 2)")).alias("s")),
    )
    tried = n.select(F.col("key").alias("plural"), F.inline(forms)).where(F.col("s").isNotNull() & (F.col("s") != ""))
    hit = tried.join(n.select(F.col("key").alias("s")), "s")
    return hit.groupBy("plural").agg(F.min_by("s", "r").alias("singular"))


def mentions_of(records: DataFrame) -> DataFrame:
    """records(raw, type, chunk_id) -> ``key, raw, type, chunk_id``: names normalised, a plural folded into its attested singular.

    Folding comes before any vote. Distinct names are normalised once; null and empty names are left out.
    """
    keys = name_keys(records.select("raw")).where(F.col("key") != "")
    folded = keys.join(plural_map(keys).withColumnRenamed("plural", "key"), "key", "left").select("raw", F.coalesce("singular", "key").alias("key"))
    return join_sized(records.select("raw", "type", "chunk_id"), cut(folded), ["raw"]).select("key", "raw", "type", "chunk_id")


def type_votes(mentions: DataFrame) -> DataFrame:
    """mentions(key, type) -> ``key, type, n``; a mention without a type casts no vote."""
    return mentions.where(F.col("type").isNotNull()).groupBy("key", "type").agg(F.count("*").alias("n"))


def reconcile(votes: DataFrame) -> DataFrame:
    """``key, type, rule``: the catch-all is dropped unless it holds a majority; most votes win; ties go to an authority
    hinted at by the name, else by fixed priority. An unknown type ranks after all known ones."""
    priority = F.array_position(F.array(*map(F.lit, TYPE_PRIORITY)), F.col("type"))
    v = votes.withColumn("prio", F.when(priority == 0, 99).otherwise(priority))
    per = v.groupBy("key").agg(F.sum("n").alias("total"), F.sum(F.when(F.col("type") == CATCH_ALL, F.col("n")).otherwise(0)).alias("loose"), F.count("*").alias("kinds"), F.collect_list(F.struct("type", "n", "prio")).alias("v"))
    keep_all = (F.col("loose") == F.col("total")) | (2 * F.col("loose") > F.col("total"))
    per = per.withColumn("c", F.when(keep_all, F.col("v")).otherwise(F.filter("v", lambda x: x["type"] != CATCH_ALL)))
    per = per.withColumn("lead", F.filter("c", lambda x: x["n"] == F.array_max(F.transform("c", lambda y: y["n"]))))
    hinted = F.exists("lead", lambda x: x["type"] == "Authority") & F.col("key").rlike(AUTHORITY_WORDS)
    first = F.array_min(F.transform("lead", lambda x: F.struct(x["prio"].alias("p"), x["type"].alias("t"))))["t"]
    winner = F.when(F.size("lead") == 1, F.col("lead")[0]["type"]).when(hinted, "Authority").otherwise(first)
    how = F.when(F.size("lead") == 1, F.when(F.size("c") > 1, "majority").otherwise("only")).when(hinted, "tie, authority").otherwise("tie, priority")
    return per.select("key", winner.alias("type"), F.when(F.col("kinds") == 1, "single").otherwise(how).alias("rule"))


def display_name(spellings: DataFrame) -> DataFrame:
    """spellings(key, raw) -> ``key, display``: the most frequent spelling, then the longest, then the last by letter."""
    n = spellings.groupBy("key", "raw").agg(F.count("*").alias("n"))
    return n.groupBy("key").agg(F.max_by("raw", F.struct("n", F.length("raw"), "raw")).alias("display"))


def build_nodes(mentions: DataFrame, types: DataFrame) -> DataFrame:
    """mentions(key, raw, chunk_id) with resolved types -> ``key, type, mentions, n_chunks, n_aliases``; lists stay in rows (``node_aliases``, ``node_chunks``)."""
    per = mentions.groupBy("key").agg(F.count("*").alias("mentions"), F.countDistinct("chunk_id").alias("n_chunks"), F.countDistinct(F.when(F.col("raw") != F.col("key"), F.col("raw"))).alias("n_aliases"))
    return per.join(types, "key").select("key", "type", "mentions", "n_chunks", "n_aliases")


def node_aliases(mentions: DataFrame) -> DataFrame:
    """``key, alias, n``: the spellings of a node other than its key, with their uses."""
    return mentions.where(F.col("raw") != F.col("key")).groupBy("key", F.col("raw").alias("alias")).agg(F.count("*").alias("n"))


def node_chunks(mentions: DataFrame) -> DataFrame:
    return mentions.where(F.col("chunk_id").isNotNull()).select("key", "chunk_id").distinct()


def chunk_entities(nodes: DataFrame) -> DataFrame:
    """Inverted list: per chunk the sorted names of its nodes."""
    return nodes.select("canonical_name", F.explode("chunk_ids").alias("chunk_id")).groupBy("chunk_id").agg(F.array_sort(F.collect_set("canonical_name")).alias("names"))


def instrument_names(records: DataFrame, column: str, renames: DataFrame) -> DataFrame:
    """Full citations of instruments replaced by their short names (renames(full, short)); unknown ones keep theirs."""
    full = F.lower(F.trim(column))
    j = records.withColumn("_full", full).join(F.broadcast(renames.select(F.lower(F.trim("full")).alias("_full"), "short")), "_full", "left")
    return j.withColumn("renamed", F.col("short").isNotNull()).withColumn(column, F.coalesce("short", column)).drop("_full", "short")


def repaired_provenance(records: DataFrame, claimed: str, true: str) -> DataFrame:
    """The chunk a record was read from beats the one it claims; ``repaired`` marks the rows that differed."""
    return records.withColumn("repaired", ~F.col(claimed).eqNullSafe(F.col(true))).withColumn(claimed, F.col(true))


def chunk_gaps(entities: DataFrame, relations: DataFrame) -> DataFrame:
    """entities(chunk_id, key), relations(chunk_id, head, tail) -> ``chunk_id, key, gap``: ends no entity of the chunk
    has (``dangling``) and entities no relation of the chunk uses (``orphan``)."""
    ends = relations.select("chunk_id", F.explode(F.array("head", "tail")).alias("key")).where(F.col("key").isNotNull()).distinct()
    have = entities.select("chunk_id", "key").where(F.col("key").isNotNull()).distinct()
    lost = ends.join(have, ["chunk_id", "key"], "left_anti").withColumn("gap", F.lit("dangling"))
    return lost.unionByName(have.join(ends, ["chunk_id", "key"], "left_anti").withColumn("gap", F.lit("orphan")))


def granularity_misses(entities: DataFrame, chunks: DataFrame) -> DataFrame:
    """``chunk_id, named, expected``: chunks of a numbered paragraph whose own article is named bare but not with its number.

    entities(chunk_id, key); keys are normalised names, an article's being ``aia art. 9`` and a paragraph's ``aia art. 9(2)``.
    """
    article = F.concat(F.lower("regulation"), F.lit(" art. "), F.col("article"))
    own = chunks.where(F.col("article").isNotNull() & F.col("paragraph").isNotNull()).select("chunk_id", article.alias("named"), F.concat(article, F.lit("("), F.col("paragraph"), F.lit(")")).alias("expected"))
    e = entities.select("chunk_id", "key").distinct()
    bare = own.join(e.withColumnRenamed("key", "named"), ["chunk_id", "named"], "left_semi")
    return bare.join(e.withColumnRenamed("key", "expected"), ["chunk_id", "expected"], "left_anti").select("chunk_id", "named", "expected")


def confidence_histogram(relationships: DataFrame) -> DataFrame:
    """Tenths of confidence; values out of range, NaN and null are counted as such."""
    c = F.col("confidence")
    bucket = F.when(c.isNull(), "null").when(F.isnan(c), "nan").when((c < 0) | (c > 1), "out of range").otherwise(F.format_string("%.1f", F.floor(c * 10) / 10))
    return relationships.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"))
