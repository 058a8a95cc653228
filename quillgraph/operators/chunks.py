"""The corpus: shapes, keys and labels of chunks, lookup by locator, upserts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillgraph.functions.text import words

MOST_ENUMERATED = 16
# fixed values: roman numerals of the annexes
ROMAN = ("I", "II", "III", "IV", "V", "VI", "VII", "VIII", "IX", "X", "XI", "XII", "XIII")


def shape() -> Column:
    """The one shape whose locator columns are filled, else null."""
    c = F.col
    return F.when(c("annex").isNotNull() & c("point").isNotNull(), "annex").when(c("article").isNotNull() & c("definition").isNotNull(), "definition").when(c("article").isNotNull() & c("paragraph").isNotNull(), "paragraph")


def checked_shape() -> Column:
    return F.coalesce(shape(), F.raise_error(F.concat(F.lit("chunk of no shape: "), F.col("chunk_id"))).cast("string"))


def roman_number(numeral: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, ROMAN)), numeral)


def chunk_key() -> Column:
    c, low = F.col, F.lower("regulation")
    annex = F.concat(low, F.lit("-annex"), roman_number(c("annex")), F.coalesce(F.concat(F.lit("-section"), c("section")), F.lit("")), F.lit("-point"), c("point"))
    return F.when(shape() == "annex", annex).when(shape() == "definition", F.concat(low, F.lit("-art"), c("article"), F.lit("-def"), c("definition"))).otherwise(F.concat(low, F.lit("-art"), c("article"), F.lit("-para"), c("paragraph")))


def citation_label() -> Column:
    c = F.col
    annex = F.concat(c("regulation"), F.lit(" Annex "), c("annex"), F.coalesce(F.concat(F.lit("("), c("section"), F.lit(")")), F.lit("")), F.lit("("), c("point"), F.lit(")"))
    return F.when(shape() == "annex", annex).otherwise(F.concat(c("regulation"), F.lit(" Art. "), c("article"), F.lit("("), F.coalesce("definition", "paragraph"), F.lit(")")))


def project(chunks: DataFrame) -> DataFrame:
    """Shape, key, label and word count derived from the locators, beside what is stored."""
    return chunks.select("chunk_id", shape().alias("shape"), chunk_key().alias("derived_id"), citation_label().alias("label"), words(F.col("text")).alias("n_words"))


def violations(chunks: DataFrame) -> DataFrame:
    """Rows that break the table's constraints: no or another shape, duplicate key or label.

    Keys are counted by themselves, so only the few repeated ones are joined back and no row is sorted by its key.
    """
    bad = chunks.select("chunk_id", "citation_label", shape().alias("s"), F.col("shape").alias("stored"))
    for i, k in enumerate(("chunk_id", "citation_label")):
        again = bad.groupBy(k).agg(F.count("*").alias("n")).where(F.col("n") > 1).select(k, F.lit(True).alias(f"d{i}"))
        bad = bad.join(again, k, "left")
    why = F.when(F.col("s").isNull(), "no shape").when(F.col("s") != F.col("stored"), "other shape").when(F.col("d0"), "duplicate key").when(F.col("d1"), "duplicate label")
    return bad.select("chunk_id", why.alias("violation")).where(F.col("violation").isNotNull())


def enumerate_provisions(chunks: DataFrame, most: int = MOST_ENUMERATED) -> DataFrame:
    """Every provision's chunks in statutory order; a provision of more than ``most`` is refused as a whole."""
    provision = F.coalesce(F.concat(F.lit("art "), F.col("article")), F.concat(F.lit("annex "), F.col("annex")))
    rows = chunks.withColumn("provision", provision)
    own = Window.partitionBy("regulation", "provision")
    order = own.orderBy(F.asc_nulls_first("section"), F.coalesce("paragraph", "definition", "point"), "chunk_id")
    sized = rows.withColumn("n", F.count("*").over(own)).where(F.col("n") <= most)
    return sized.select("regulation", "provision", F.row_number().over(order).alias("pos"), "chunk_id", "citation_label")


def provision_of(chunks: DataFrame) -> DataFrame:
    """``target, at, chunk_id``: each provision as a question names it (``AIA article 9``, ``GDPR annex III``), its chunks in statutory order."""
    p = enumerate_provisions(chunks)
    name = F.when(F.col("provision").startswith("art "), F.concat(F.lit("article "), F.substring(F.col("provision"), 5, 20))).otherwise(F.col("provision"))
    return p.select(F.concat_ws(" ", "regulation", name).alias("target"), F.col("pos").alias("at"), "chunk_id")


def passages(targets: DataFrame, ranked: DataFrame, provisions: DataFrame, shown: int = 5, votes: int = 10) -> DataFrame:
    """Enumerate or rank: targets(qid, enumerates, target), ranked(qid, pos, key), provisions(target, at, chunk_id).

    ``qid, pos, key, arm``. A question that enumerates gets the whole provision it names, or else the one most of its
    first ``votes`` ranked chunks belong to, and behind it the first ``shown`` ranked chunks not in it; any other
    question, and one whose provision is unknown or too large, gets its first ``shown`` ranked chunks.
    """
    of = provisions.select("target", F.col("chunk_id").alias("key"))
    cast = ranked.where(F.col("pos") <= votes).join(of, "key").groupBy("qid", "target").agg(F.count("*").alias("n"), F.min("pos").alias("best"))
    modal = cast.groupBy("qid").agg(F.min_by("target", F.struct(-F.col("n"), "best", "target")).alias("modal"))
    chosen = targets.where("enumerates").join(modal, "qid", "left").select("qid", F.coalesce("target", "modal").alias("target")).where("target is not null")
    listed = chosen.join(provisions, "target").select("qid", F.lit(0).alias("arm"), F.col("at").alias("pos"), F.col("chunk_id").alias("key"))
    rest = ranked.where(F.col("pos") <= shown).join(listed.select("qid", "key"), ["qid", "key"], "left_anti").select("qid", F.lit(1).alias("arm"), "pos", "key")
    both = listed.unionByName(rest)
    return both.select("qid", F.row_number().over(Window.partitionBy("qid").orderBy("arm", "pos")).alias("pos"), "key", "arm")


def missing(rows: DataFrame, key: str, column: str) -> DataFrame:
    """Keys whose derived column is still to be made."""
    return rows.where(F.col(column).isNull()).select(key)


def replayed(rows: DataFrame, key: str, ordering: str, documents: DataFrame, id_: str, first: int) -> DataFrame:
    """The first documents of a stored ordering (an array of ids) in its order, hydrated; ids without a document drop out."""
    each = rows.select(key, F.posexplode(F.slice(ordering, 1, first)).alias("pos", id_))
    return each.join(documents, id_)


def upsert(old: DataFrame, new: DataFrame, key: str, touched: DataFrame | None = None) -> DataFrame:
    """Old rows whose key was not touched, then the new ones."""
    return old.join((touched if touched is not None else new).select(key).distinct(), key, "left_anti").unionByName(new)


def splice(rows: DataFrame, key: str, old_key: str, new: DataFrame, order: str) -> DataFrame:
    """Replace one key's row by new rows at the same place; ``order`` gets a second level."""
    at = rows.where(F.col(key) == old_key).agg(F.min(order).alias(order))
    kept = rows.where(F.col(key) != old_key).withColumn("sub", F.lit(0).cast("bigint"))
    put = new.drop(order).withColumn("sub", F.monotonically_increasing_id()).crossJoin(F.broadcast(at))  # at is one row
    return kept.unionByName(put)


def update_column(rows: DataFrame, values: DataFrame, key: str, column: str) -> DataFrame:
    return rows.join(values.select(key, F.col(column).alias("_new")), key, "left").withColumn(column, F.coalesce("_new", column)).drop("_new")


def status(chunks: DataFrame) -> DataFrame:
    """Per shape the rows, those with a token count and those linked to entities, in one pass."""
    return chunks.groupBy("shape").agg(F.count("*").alias("n"), F.count("token_count").alias("n_counted"), F.count_if(F.size("entity_ids") > 0).alias("n_linked"), F.count("retired_at").alias("n_retired"))


def modal_provision(ranked: DataFrame, first: int = 10) -> DataFrame:
    """ranked(qid, pos, chunk_id): the provision most of the first chunks belong to; then the best place, then the name."""
    part = F.regexp_extract("chunk_id", r"^([a-z0-9]+)-(art|annex)(\d+)-", 0)
    votes = ranked.where((F.col("pos") <= first) & (part != "")).groupBy("qid", F.regexp_replace(part, "-$", "").alias("provision")).agg(F.count("*").alias("votes"), F.min("pos").alias("best"))
    return votes.groupBy("qid").agg(F.min_by("provision", F.struct(-F.col("votes"), "best", "provision")).alias("provision"), F.max("votes").alias("votes"))
