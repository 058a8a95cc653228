"""Queries over the corpus: keys, enumeration, lexical and vector search, citations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quillgraph.functions.text import LABEL, approx_tokens, labels_in, words
from quillgraph.operators import chunks as C
from quillgraph.operators import lexical as L
from quillgraph.operators import vector as V
from quillgraph.operators.assembly import budget_anchor, budget_first, first_per_text, rank_shifts, round_robin
from quillgraph.operators.cite import labels_shown, uncited
from quillgraph.operators.resolve import chunk_entities
from quillgraph.operators.route import ENUMERATES_WIDE, enumeration_target
from quillgraph.operators.scores import loss_split, recall_at
from quillgraph.plans.runtime import cut, join_sized, table, wide
from quillgraph.sources.providers import rerank

#: Sizes of the retention curve.
RETAINED = (1, 2, 3, 5, 10, 25, 50, 100)


def chunk_keys(spark, d):
    return C.project(table(spark, d, "chunks"))


def chunk_violations(spark, d):
    return C.violations(table(spark, d, "chunks"))


def chunk_status(spark, d):
    return C.status(table(spark, d, "chunks"))


def provisions(spark, d):
    return C.enumerate_provisions(table(spark, d, "chunks"))


def chunk_entity_index(spark, d):
    return chunk_entities(table(spark, d, "graph_nodes")).select("chunk_id", F.array_join("names", "|").alias("names"))


def entity_sources_differ(spark, d):
    """Chunks whose stored entity_ids are not those the nodes name."""
    a = table(spark, d, "chunks").select("chunk_id", F.array_sort(F.array_distinct("entity_ids")).alias("stored")).where(F.size("stored") > 0)
    b = chunk_entities(table(spark, d, "graph_nodes"))
    j = a.join(b, "chunk_id", "full")
    return j.where(~F.col("stored").eqNullSafe(F.col("names"))).select("chunk_id", F.coalesce(F.size("stored"), F.lit(0)).alias("n_stored"), F.coalesce(F.size("names"), F.lit(0)).alias("n_named"))


def _questions(spark, d):
    """The stated query set: answers whose id is divisible by 20."""
    return table(spark, d, "answers").where(F.col("answer_id") % 20 == 0).select(F.col("answer_id").alias("qid"), "question").distinct()


def bm25_topk(spark, d):
    return L.bm25(table(spark, d, "chunks"), "chunk_id", "text", _questions(spark, d), 10).withColumnRenamed("key", "chunk_id")


def term_statistics(spark, d):
    return L.term_stats(table(spark, d, "chunks"), "chunk_id", "text").select("term", "df", F.round("idf", 6).alias("idf"))


def _title_arm(spark, d):
    q = _questions(spark, d)
    c = table(spark, d, "chunks").where(F.coalesce("article_title", "annex_title").isNotNull()).select("chunk_id", F.coalesce("article_title", "annex_title").alias("text"))
    return L.bm25(c, "chunk_id", "text", q, 5)


def _ranked(spark, d, k=10):
    return L.bm25(table(spark, d, "chunks"), "chunk_id", "text", _questions(spark, d), k)


def title_union(spark, d):
    """Chunks best by text, then those best by title."""
    return L.ordered_union(_ranked(spark, d, 5), _title_arm(spark, d)).select("qid", "pos", F.col("key").alias("chunk_id"), "arm")


def lexical_union(spark, d):
    """BM25 first, then full-text search, each chunk at its first place."""
    return L.ordered_union(_ranked(spark, d, 10), L.full_text(table(spark, d, "chunks"), "chunk_id", "text", _questions(spark, d), 10)).select("qid", "pos", F.col("key").alias("chunk_id"), "arm")


def candidate_pool(spark, d):
    """Vector draw of the stated queries, then mates of the same label in key order, without a score."""
    e = table(spark, d, "embeddings")
    q = e.where(F.col("vec_id") % 20 == 0)
    drawn = V.top_k(e, q, 10)
    # the first keys of a label, found before any query meets them
    first = e.groupBy("label", F.col("vec_id").alias("key")).agg(F.count("*").alias("n")).withColumn("pos", F.row_number().over(Window.partitionBy("label").orderBy("key"))).where("pos <= 10")
    mates = q.select(F.col("vec_id").alias("qid"), "label").join(F.broadcast(first), "label").select("qid", "pos", "key")
    return L.pool(drawn, mates, 10).select("qid", "pos", F.col("key").alias("vec_id"), "arm", "score")


def augmented(spark, d):
    """Enumerate or rank: the provision a question names or votes for, in statutory order, before what is ranked."""
    c = table(spark, d, "chunks")
    q = F.col("question")
    targets = _questions(spark, d).select("qid", q.rlike(ENUMERATES_WIDE).alias("enumerates"), enumeration_target(q).alias("target"))
    return C.passages(targets, cut(_ranked(spark, d).select("qid", "pos", "key")), cut(C.provision_of(c))).select("qid", "pos", F.col("key").alias("chunk_id"), "arm")


def reranked(spark, d):
    """Each question's ten best chunks by BM25, reranked by the share of its words they have: places before and after."""
    q, c = _questions(spark, d), table(spark, d, "chunks").select(F.col("chunk_id").alias("key"), "text")
    before = cut(_ranked(spark, d).select("qid", "pos", "key"))
    pairs = join_sized(c, before, ["key"]).join(q, "qid").select("qid", "pos", "question", "text", "key")
    after = rerank(pairs, 10)
    again = after.join(before, ["qid", "pos"]).select("qid", F.col("rank").alias("pos"), "key")
    return rank_shifts(before, again).select("qid", F.col("key").alias("chunk_id"), "before", "after", "shift")


def modal_provision(spark, d):
    return C.modal_provision(L.bm25(table(spark, d, "chunks"), "chunk_id", "text", _questions(spark, d), 10).select("qid", "pos", F.col("key").alias("chunk_id")))


def vector_topk(spark, d):
    e = table(spark, d, "embeddings")
    return V.top_k(e, e.where(F.col("vec_id") % 20 == 0), 10).withColumnRenamed("key", "vec_id")


def vector_index(spark, d):
    """Approximate search through stored cells, and how much of the exact result it finds."""
    e = table(spark, d, "embeddings")
    q = e.where(F.col("vec_id") % 20 == 0)
    cells = max(1, int(e.count() ** 0.5))
    centroids = V.fit_cells(e, cells)
    found = V.top_k_cells(cut(V.in_cells(e, centroids)), q, 10, centroids, V.fit_probes(e, centroids, 10))
    exact = V.top_k(e, q, 10)
    both = exact.join(found.select("qid", "key", F.lit(1).alias("hit")), ["qid", "key"], "left")
    return both.agg(F.count("*").alias("wanted"), F.count("hit").alias("found"), (F.count("hit") >= 0.9 * F.count("*")).alias("good"))


def fulltext_topk(spark, d):
    return L.full_text(table(spark, d, "chunks"), "chunk_id", "text", _questions(spark, d), 10).withColumnRenamed("key", "chunk_id")


def _asked_runs(spark, d):
    """The stated set of runs, whose id is divisible by 20, with their question and the labels their answer cited."""
    r = table(spark, d, "ask_runs").where(F.col("ask_id") % 20 == 0)
    return _first_rows(r.select("ask_id", "question", "labels"), "ask_id").withColumnRenamed("ask_id", "qid")


def retention_curve(spark, d):
    """How many of the chunks a run cited stand among its question's first n lexical candidates, for several n, beside all it cited."""
    q = cut(_asked_runs(spark, d))
    c = table(spark, d, "chunks").select(F.col("chunk_id").alias("key"), "citation_label")
    gold = cut(join_sized(q.select("qid", F.explode("labels").alias("citation_label")), c, ["citation_label"]).select("qid", "key").distinct())
    ranked = L.bm25_places(table(spark, d, "chunks"), "chunk_id", "text", q.select("qid", "question"), gold, max(RETAINED))
    each = gold.join(ranked, ["qid", "key"], "left").select("pos", F.explode(F.array(*map(F.lit, RETAINED))).alias("n"))
    return each.groupBy("n").agg(F.count("*").alias("gold"), F.count_if(F.col("pos") <= F.col("n")).alias("kept"))


def similar_vectors(spark, d):
    e = table(spark, d, "embeddings")
    return V.similar_rows(e, e.where(F.col("vec_id") % 20 == 0), "label", 0.3)


def _gold(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", "label")
    return e.where(F.col("vec_id") % 20 == 0).select(F.col("vec_id").alias("qid"), "label").join(e, "label").select("qid", "label", F.col("vec_id").alias("key"))


def vector_recall(spark, d):
    return recall_at(vector_topk(spark, d).withColumnRenamed("vec_id", "key"), _gold(spark, d), 10)


def vector_losses(spark, d):
    e = table(spark, d, "embeddings")
    gold = _gold(spark, d)
    pool = V.top_k(e, e.where(F.col("vec_id") % 20 == 0), 50).join(gold, ["qid", "key"])
    per = gold.groupBy("qid", "label").agg(F.count("*").alias("gold")).join(pool.groupBy("qid").agg(F.count("*").alias("pooled"), F.count_if(F.col("pos") <= 5).alias("found")), "qid", "left")
    return loss_split(per.select(F.col("label").cast("string").alias("stratum"), "gold", F.coalesce("pooled", F.lit(0)).alias("pooled"), F.coalesce("found", F.lit(0)).alias("found")), 5)


def _cited(spark, d):
    return _first_rows(table(spark, d, "ask_runs").select("ask_id", "question_id", "labels"), "ask_id").select("ask_id", "question_id", F.posexplode("labels").alias("pos", "citation_label"))


def hydrated(spark, d):
    """Labels of answers turned into chunks, in the order given; unknown ones drop out."""
    c = table(spark, d, "chunks").select("chunk_id", "citation_label")
    return join_sized(_cited(spark, d), c, ["citation_label"]).select("ask_id", "pos", "chunk_id")


def citations_valid(spark, d):
    """Per run, labels that no chunk of the corpus carries."""
    c = table(spark, d, "chunks").select("citation_label").distinct().withColumn("known", F.lit(True))
    j = join_sized(_cited(spark, d), c, ["citation_label"], "left")
    return j.groupBy("ask_id").agg(F.count("*").alias("n_cited"), F.count_if(F.col("known").isNull()).alias("n_unknown"), (F.count_if(F.col("known").isNull()) == 0).alias("valid"))


def prose_labels(spark, d):
    a = _first_rows(table(spark, d, "answers").select("answer_id", "answer", "question"), "answer_id").select("answer_id", labels_in(F.col("answer")).alias("l"))
    return a.where(F.size("l") > 0).select("answer_id", F.array_join("l", "|").alias("labels"))


def prose_labels_not_asked(spark, d):
    """Labels an answer names that its question did not."""
    a = _first_rows(table(spark, d, "answers").select("answer_id", "answer", "question"), "answer_id").select("answer_id", uncited(F.col("answer"), labels_in(F.col("question"))).alias("l"))
    return a.where(F.size("l") > 0).select("answer_id", F.array_join("l", "|").alias("labels"))


def text_sizes(spark, d):
    t = table(spark, d, "documents").where(F.col("text").isNotNull())
    return t.select("doc_id", words(F.col("text")).alias("n_words"), approx_tokens(F.col("text")).alias("approx_tokens"))


def _docs(spark, d):
    """Chunks as documents on the way to a prompt: a question per regulation and shape's call, in key order."""
    return table(spark, d, "chunks").select(F.col("regulation").alias("qid"), F.coalesce("article", "definition", F.lit(0)).alias("call"), F.col("chunk_id").alias("pos"), "text")


def interleaved(spark, d):
    return round_robin(_docs(spark, d), 50).select("qid", "call", F.col("pos").alias("chunk_id"), "at")


def distinct_texts(spark, d):
    return first_per_text(_docs(spark, d)).select("qid", F.col("pos").alias("chunk_id"))


def first_budget(spark, d):
    return budget_first(_docs(spark, d), 50).select("qid", F.col("pos").alias("chunk_id"), "at")


def anchor_budget(spark, d):
    """Documents of each regulation that name an entity its own chunks are linked to most, first."""
    named = table(spark, d, "chunks").select(F.col("regulation").alias("qid"), F.explode("entity_ids").alias("name")).groupBy("qid", "name").agg(F.count("*").alias("n"))
    top = named.withColumn("r", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("n"), "name"))).where("r <= 5")
    names = top.groupBy("qid").agg(F.array_sort(F.collect_list("name")).alias("names"))
    return budget_anchor(_docs(spark, d), names, 20).select("qid", F.col("pos").alias("chunk_id"), "hit", "at")


def labels_in_prompts(spark, d):
    """The labels each regulation's first documents show."""
    c = table(spark, d, "chunks").select("chunk_id", "citation_label")
    docs = budget_first(_docs(spark, d), 50).withColumnRenamed("pos", "chunk_id").join(c, "chunk_id")
    return labels_shown(docs.select("qid", "citation_label", "text")).select("qid", F.array_join("labels", "|").alias("labels"))


def _first_rows(rows, key):
    """One row per key, the least of differing ones."""
    rest = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.min(F.struct(*rest)).alias("r")).select(key, "r.*")


_SHAPE = "CASE WHEN annex IS NOT NULL AND point IS NOT NULL THEN 'annex' WHEN article IS NOT NULL AND definition IS NOT NULL THEN 'definition' WHEN article IS NOT NULL AND paragraph IS NOT NULL THEN 'paragraph' END"
_NORM = r"regexp_replace(regexp_replace(lower(coalesce({x}, '')), '[^a-z0-9]+', ' ', 'g'), '^ | $', '', 'g')"
_QUESTIONS = "q AS (SELECT DISTINCT answer_id AS qid, question FROM answers WHERE answer_id % 20 = 0)"


def _bm25_sql(name: str, docs: str, k: int) -> str:
    return f"""{name}_t AS (SELECT key, regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+') AS t FROM ({docs})),
{name}_p AS (SELECT key, term, count(*) AS tf, any_value(dl) AS dl FROM (SELECT key, len(t) AS dl, unnest(t) AS term FROM {name}_t) GROUP BY key, term),
{name}_s AS (SELECT count(*) AS n, avg(len(t)) AS avgdl FROM {name}_t),
{name}_i AS (SELECT term, count(*) AS df, ln(1 + ((SELECT n FROM {name}_s) - count(*) + 0.5) / (count(*) + 0.5)) AS idf FROM {name}_p GROUP BY term),
{name}_a AS (SELECT qid, unnest(list_distinct(regexp_extract_all(lower(question), '[a-z0-9]+'))) AS term FROM q),
{name}_r AS (SELECT qid, key, round(sum(idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / (SELECT avgdl FROM {name}_s)))), 6) AS score FROM {name}_a JOIN {name}_p USING (term) JOIN {name}_i USING (term) GROUP BY qid, key),
{name} AS (SELECT * FROM (SELECT qid, key, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, key) AS pos FROM {name}_r) WHERE pos <= {k})"""


_CHUNKS, _TITLES = "SELECT chunk_id AS key, text FROM chunks", "SELECT chunk_id AS key, coalesce(article_title, annex_title) AS text FROM chunks WHERE coalesce(article_title, annex_title) IS NOT NULL"
_DOCS = "docs AS (SELECT regulation AS qid, coalesce(article, definition, 0) AS call, chunk_id AS pos, text FROM chunks)"
_SIM = "sims AS (SELECT q.vec_id AS qid, e.vec_id AS key, q.label, e.label AS other, round(list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(e.embedding AS DOUBLE[])), 6) AS similarity FROM embeddings q, embeddings e WHERE q.vec_id % 20 = 0), top AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY similarity DESC, key) AS pos FROM sims)"
_PIECES = "(SELECT ask_id, r.labels AS labels FROM (SELECT ask_id, min({'question_id': question_id, 'labels': labels}) AS r FROM ask_runs GROUP BY ask_id))"


def _labels(x: str) -> str:
    return f"list_transform(regexp_extract_all({x}, '{LABEL}'), lambda y: regexp_replace(y, '\\s+', ' ', 'g'))"


def _first_seen(x: str) -> str:
    """SQL keeping the first of equal list elements in order."""
    return f"list_filter({x}, lambda y, i: list_position({x}, y) = i)"


QUERIES = {
    f.__name__: f
    for f in (chunk_keys, chunk_violations, chunk_status, provisions, chunk_entity_index, entity_sources_differ, bm25_topk, term_statistics, title_union, lexical_union, candidate_pool, augmented, reranked, modal_provision, vector_topk, vector_index, fulltext_topk, retention_curve, similar_vectors, vector_recall, vector_losses, hydrated, citations_valid, prose_labels, prose_labels_not_asked, text_sizes, interleaved, distinct_texts, first_budget, anchor_budget, labels_in_prompts)
}
for _name in ("chunk_keys", "provisions", "entity_sources_differ", "bm25_topk", "title_union", "lexical_union", "candidate_pool", "augmented", "reranked", "fulltext_topk", "vector_topk", "hydrated", "text_sizes", "interleaved", "first_budget", "anchor_budget", "retention_curve"):
    QUERIES[_name] = wide(QUERIES[_name])
_ROMAN = "list_position(['I','II','III','IV','V','VI','VII','VIII','IX','X','XI','XII','XIII'], annex)"
ORACLE = {
    "chunk_keys": f"""SELECT chunk_id, {_SHAPE} AS shape, CASE {_SHAPE} WHEN 'annex' THEN lower(regulation) || '-annex' || {_ROMAN} || coalesce('-section' || section, '') || '-point' || point WHEN 'definition' THEN lower(regulation) || '-art' || article || '-def' || definition ELSE lower(regulation) || '-art' || article || '-para' || paragraph END AS derived_id,
CASE {_SHAPE} WHEN 'annex' THEN regulation || ' Annex ' || annex || coalesce('(' || section || ')', '') || '(' || point || ')' ELSE regulation || ' Art. ' || article || '(' || coalesce(definition, paragraph) || ')' END AS label, len(regexp_extract_all(text, '[^ \\t\\n\\x0B\\f\\r]+')) AS n_words FROM chunks""",
    "chunk_violations": f"SELECT chunk_id, violation FROM (SELECT chunk_id, CASE WHEN {_SHAPE} IS NULL THEN 'no shape' WHEN {_SHAPE} <> shape THEN 'other shape' WHEN count(*) OVER (PARTITION BY chunk_id) > 1 THEN 'duplicate key' WHEN count(*) OVER (PARTITION BY citation_label) > 1 THEN 'duplicate label' END AS violation FROM chunks) WHERE violation IS NOT NULL",
    "chunk_status": "SELECT shape, count(*) AS n, count(token_count) AS n_counted, count(*) FILTER (len(entity_ids) > 0) AS n_linked, count(retired_at) AS n_retired FROM chunks GROUP BY shape",
    "provisions": """SELECT regulation, provision, row_number() OVER (PARTITION BY regulation, provision ORDER BY section NULLS FIRST, o, chunk_id) AS pos, chunk_id, citation_label FROM (
SELECT *, coalesce(paragraph, definition, point) AS o, count(*) OVER (PARTITION BY regulation, provision) AS n FROM (SELECT *, coalesce('art ' || article, 'annex ' || annex) AS provision FROM chunks)) WHERE n <= 16""",
    "chunk_entity_index": "SELECT chunk_id, string_agg(canonical_name, '|' ORDER BY canonical_name) AS names FROM (SELECT DISTINCT canonical_name, unnest(chunk_ids) AS chunk_id FROM graph_nodes) GROUP BY chunk_id",
    "entity_sources_differ": """WITH a AS (SELECT chunk_id, list_sort(list_distinct(entity_ids)) AS stored FROM chunks WHERE len(entity_ids) > 0),
b AS (SELECT chunk_id, list(canonical_name ORDER BY canonical_name) AS names FROM (SELECT DISTINCT canonical_name, unnest(chunk_ids) AS chunk_id FROM graph_nodes) GROUP BY chunk_id)
SELECT chunk_id, coalesce(len(stored), 0) AS n_stored, coalesce(len(names), 0) AS n_named FROM a FULL JOIN b USING (chunk_id) WHERE stored IS DISTINCT FROM names""",
    "bm25_topk": f"WITH {_QUESTIONS}, {_bm25_sql('b', _CHUNKS, 10)} SELECT qid, pos, key AS chunk_id, score FROM b",
    "term_statistics": f"WITH {_QUESTIONS}, {_bm25_sql('b', _CHUNKS, 10)} SELECT term, df, round(idf, 6) AS idf FROM b_i",
    "title_union": f"""WITH {_QUESTIONS}, {_bm25_sql("b", _CHUNKS, 5)}, {_bm25_sql("t", _TITLES, 5)}, u AS (SELECT qid, 0 AS arm, pos, key FROM b UNION ALL SELECT qid, 1, pos, key FROM t),
m AS (SELECT qid, key, min((arm, pos)) AS w FROM u GROUP BY qid, key) SELECT qid, row_number() OVER (PARTITION BY qid ORDER BY w, key) AS pos, key AS chunk_id, w[1] AS arm FROM m""",
    "candidate_pool": f"""WITH {_SIM}, first AS (SELECT * FROM (SELECT label, vec_id AS key, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS pos FROM (SELECT DISTINCT label, vec_id FROM embeddings)) WHERE pos <= 10),
u AS (SELECT qid, 0 AS arm, pos, key, similarity AS score FROM top WHERE pos <= 10 UNION ALL SELECT q.vec_id, 1, f.pos, f.key, NULL FROM embeddings q JOIN first f USING (label) WHERE q.vec_id % 20 = 0 AND NOT EXISTS (SELECT 1 FROM top t WHERE t.pos <= 10 AND t.qid = q.vec_id AND t.key = f.key))
SELECT qid, row_number() OVER (PARTITION BY qid ORDER BY arm, pos) AS pos, key AS vec_id, arm, score FROM u""",
    "reranked": f"""WITH {_QUESTIONS}, {_bm25_sql("b", _CHUNKS, 10)}, o AS (SELECT b.qid, pos, key, list_distinct(regexp_extract_all(lower(question), '[a-z0-9]+')) AS w, regexp_extract_all(lower(text), '[a-z0-9]+') AS t FROM b JOIN q USING (qid) JOIN chunks ON chunk_id = key),
r AS (SELECT qid, pos, key, row_number() OVER (PARTITION BY qid ORDER BY round(CASE WHEN len(w) = 0 THEN 0 ELSE len(list_intersect(w, t)) / len(w) END, 6) DESC, pos) AS after FROM o) SELECT qid, key AS chunk_id, pos AS before, after, pos - after AS shift FROM r""",
    "labels_in_prompts": f"""WITH {_DOCS}, f AS (SELECT qid, pos, text FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY pos) AS n FROM docs) WHERE n <= 50), l AS (SELECT qid, citation_label AS l FROM f JOIN chunks ON chunk_id = pos UNION SELECT qid, unnest({_labels("text")}) FROM f)
SELECT qid, string_agg(l, '|' ORDER BY l) AS labels FROM (SELECT DISTINCT qid, regexp_replace(trim(l), '\\s+', ' ', 'g') AS l FROM l WHERE l IS NOT NULL) GROUP BY qid""",
    "augmented": f"""WITH {_QUESTIONS}, {_bm25_sql("b", _CHUNKS, 10)}, pr AS (SELECT regulation || ' ' || replace(provision, 'art ', 'article ') AS target, row_number() OVER (PARTITION BY regulation, provision ORDER BY section NULLS FIRST, o, chunk_id) AS at_, chunk_id FROM (SELECT *, coalesce(paragraph, definition, point) AS o, count(*) OVER (PARTITION BY regulation, provision) AS n FROM (SELECT *, coalesce('art ' || article, 'annex ' || annex) AS provision FROM chunks)) WHERE n <= 16),
x AS (SELECT qid, question, lower(question) AS l FROM q), y AS (SELECT *, CASE WHEN regexp_matches(l, '\\bgdpr\\b') THEN 'GDPR' ELSE 'AIA' END AS reg, regexp_extract(l, '\\bannex\\s+([ivx]+)\\b', 1) AS an, regexp_extract(l, '\\barticles?\\s+(\\d+)\\b', 1) AS ar FROM x),
z AS (SELECT qid, CASE WHEN an IN ('i','ii','iii','iv','v','vi','vii','viii','ix','x','xi','xii','xiii') THEN reg || ' annex ' || upper(an) WHEN ar <> '' THEN reg || ' article ' || ar END AS target FROM y WHERE regexp_matches(question, '{ENUMERATES_WIDE}')),
v AS (SELECT qid, target, count(*) AS n, min(pos) AS best FROM b JOIN pr ON chunk_id = key GROUP BY qid, target), mo AS (SELECT qid, arg_min(target, (-n, best, target)) AS modal FROM v GROUP BY qid),
li AS (SELECT z.qid, at_ AS pos, chunk_id AS key FROM z LEFT JOIN mo USING (qid) JOIN pr ON pr.target = coalesce(z.target, modal)),
u AS (SELECT qid, 0 AS arm, pos, key FROM li UNION ALL SELECT qid, 1, pos, key FROM b WHERE pos <= 5 AND NOT EXISTS (SELECT 1 FROM li WHERE li.qid = b.qid AND li.key = b.key))
SELECT qid, row_number() OVER (PARTITION BY qid ORDER BY arm, pos) AS pos, key AS chunk_id, arm FROM u""",
    "modal_provision": f"""WITH {_QUESTIONS}, {_bm25_sql("b", _CHUNKS, 10)}, v AS (SELECT qid, regexp_extract(key, '^[a-z0-9]+-(art|annex)\\d+') AS provision, count(*) AS votes, min(pos) AS best FROM b GROUP BY ALL)
SELECT qid, arg_min(provision, (-votes, best, provision)) AS provision, max(votes) AS votes FROM v GROUP BY qid""",
    "retention_curve": f"""WITH q AS (SELECT ask_id AS qid, r.question AS question, r.labels AS labels FROM (SELECT ask_id, min({{'question': question, 'labels': labels}}) AS r FROM ask_runs WHERE ask_id % 20 = 0 GROUP BY ask_id)), {_bm25_sql('b', _CHUNKS, 100)}, g AS (SELECT DISTINCT qid, chunk_id AS key FROM (SELECT qid, unnest(labels) AS citation_label FROM q) JOIN chunks USING (citation_label)), k AS (SELECT pos FROM g LEFT JOIN b USING (qid, key)) SELECT n, count(*) AS gold, count(*) FILTER (pos <= n) AS kept FROM k, (VALUES {", ".join(f"({n})" for n in RETAINED)}) t(n) GROUP BY n""",
    "vector_topk": f"WITH {_SIM} SELECT qid, pos, key AS vec_id, similarity FROM top WHERE pos <= 10",
    "similar_vectors": "SELECT * FROM (SELECT x.label, x.vec_id AS a, y.vec_id AS b, round(list_cosine_similarity(CAST(x.embedding AS DOUBLE[]), CAST(y.embedding AS DOUBLE[])), 6) AS similarity FROM embeddings x JOIN embeddings y ON x.label = y.label AND x.vec_id <> y.vec_id WHERE x.vec_id % 20 = 0) WHERE similarity >= 0.3",
    "vector_recall": f"WITH {_SIM}, p AS (SELECT qid, count(*) FILTER (label = other) AS gold, count(*) FILTER (label = other AND pos <= 10) AS hits FROM top GROUP BY qid) SELECT sum(gold) AS gold, sum(hits) AS hits, round(sum(hits) / sum(gold), 6) AS recall, round(avg((hits > 0)::INT), 6) AS hit_rate FROM p",
    "vector_losses": f"""WITH {_SIM}, p AS (SELECT qid, CAST(any_value(label) AS VARCHAR) AS stratum, count(*) FILTER (label = other) AS gold, count(*) FILTER (label = other AND pos <= 50) AS pooled, count(*) FILTER (label = other AND pos <= 5) AS found FROM top GROUP BY qid)
SELECT CASE WHEN grouping(stratum) = 1 THEN '(all)' ELSE stratum END AS stratum, sum(gold) AS gold, sum(least(gold, 5)) AS cap, sum(least(pooled, 5)) AS oracle, sum(found) AS found, sum(gold - pooled) AS retrieval_loss, sum(pooled - least(pooled, 5)) AS cap_loss, sum(least(pooled, 5) - found) AS order_loss FROM p GROUP BY GROUPING SETS ((stratum), ())""",
    "hydrated": f"SELECT ask_id, pos, chunk_id FROM (SELECT ask_id, unnest(labels) AS citation_label, generate_subscripts(labels, 1) - 1 AS pos FROM {_PIECES}) JOIN chunks USING (citation_label)",
    "citations_valid": f"SELECT ask_id, count(*) AS n_cited, count(*) FILTER (c.citation_label IS NULL) AS n_unknown, count(*) FILTER (c.citation_label IS NULL) = 0 AS valid FROM (SELECT ask_id, unnest(labels) AS citation_label FROM {_PIECES}) l LEFT JOIN (SELECT DISTINCT citation_label FROM chunks) c USING (citation_label) GROUP BY ask_id",
    "prose_labels": f"WITH l AS (SELECT DISTINCT answer_id, {_labels("answer")} AS l FROM answers) SELECT answer_id, array_to_string({_first_seen('l')}, '|') AS labels FROM l WHERE len(l) > 0",
    "prose_labels_not_asked": f"WITH l AS (SELECT DISTINCT answer_id, {_labels("answer")} AS a, {_labels("question")} AS s FROM answers), m AS (SELECT answer_id, list_filter(a, lambda y: NOT list_contains(s, y)) AS l FROM l) SELECT answer_id, array_to_string({_first_seen('l')}, '|') AS labels FROM m WHERE len(l) > 0",
    "text_sizes": "SELECT doc_id, len(regexp_extract_all(text, '[^ \\t\\n\\x0B\\f\\r]+')) AS n_words, CAST(ceil(length(text) / 4) AS BIGINT) AS approx_tokens FROM documents WHERE text IS NOT NULL",
    "interleaved": f"WITH {_DOCS} SELECT qid, call, pos AS chunk_id, \"at\" FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY turn, call) AS \"at\" FROM (SELECT *, row_number() OVER (PARTITION BY qid, call ORDER BY pos) AS turn FROM docs)) WHERE \"at\" <= 50",
    "distinct_texts": f"WITH {_DOCS} SELECT qid, min(pos) AS chunk_id FROM docs GROUP BY qid, text",
    "first_budget": f"WITH {_DOCS} SELECT qid, pos AS chunk_id, \"at\" FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY pos) AS \"at\" FROM docs) WHERE \"at\" <= 50",
    "anchor_budget": f"""WITH {_DOCS}, nm AS (SELECT qid, list(name) AS names FROM (SELECT qid, name, row_number() OVER (PARTITION BY qid ORDER BY count(*) DESC, name) AS r FROM (SELECT regulation AS qid, unnest(entity_ids) AS name FROM chunks) GROUP BY qid, name) WHERE r <= 5 GROUP BY qid)
SELECT qid, pos AS chunk_id, hit, "at" FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY hit DESC, pos) AS "at" FROM (SELECT qid, pos, coalesce(len(list_filter(names, lambda x: x <> '' AND contains(lower(text), lower(x)))) > 0, false) AS hit FROM docs LEFT JOIN nm USING (qid))) WHERE "at" <= 20""",
}
for _name, _text, _sums in (("vector_recall", "recall, hit_rate", "gold hits"), ("vector_losses", "stratum", "gold cap oracle found retrieval_loss cap_loss order_loss")):
    ORACLE[_name] = f"SELECT {_text}, {', '.join(f'CAST({c} AS BIGINT) AS {c}' for c in _sums.split())} FROM ({ORACLE[_name]})"
for _name, _ints in (("title_union", ("arm",)), ("candidate_pool", ("arm",)), ("augmented", ("arm",)), ("interleaved", ("call",)), ("retention_curve", ("n",)), ("chunk_keys", ())):
    ORACLE[_name] = f"SELECT * REPLACE ({', '.join(f'CAST({c} AS BIGINT) AS {c}' for c in _ints)}) FROM ({ORACLE[_name]})" if _ints else ORACLE[_name]
