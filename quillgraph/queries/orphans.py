"""p5: references to records that do not exist."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.operators.orphans import relationship_orphans
from quillgraph.plans.runtime import table


def _orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relationship_orphans(*(table(spark, sf_dir, t) for t in ("relationships", "graph_nodes", "chunks")))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _orphans(spark, sf_dir).select(F.col("id").alias("rel_id"), "field", "kind")


def p5_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orphan references per referred table, field, kind and month of extracted_at."""
    month = F.format_string("%04d-%02d", F.floor(F.col("month") / 12).cast("int"), (F.col("month") % 12 + 1).cast("int"))
    return _orphans(spark, sf_dir).groupBy(F.col("parent").alias("referred_table"), "field", "kind", month.alias("month")).agg(F.count("*").alias("n_orphans"))


_KEY = r"""trim(trim(regexp_replace(regexp_replace(regexp_replace(lower(strip_accents({x})), '[''"`´‘’‚‛“”„‟«»‹›′″]', '', 'g'), '[\p{{Pd}}\x{{AD}}\x{{2212}}]', ' ', 'g'), '[\s\x{{85}}\x{{A0}}\x{{1680}}\x{{2000}}-\x{{200A}}\x{{2028}}\x{{2029}}\x{{202F}}\x{{205F}}\x{{3000}}]+', ' ', 'g')), ' .,;:')"""

_FOUND = f"""
WITH keys AS (
  SELECT {_KEY.format(x="canonical_name")} AS k, 0 AS r, ingested_at, retired_at FROM graph_nodes
  UNION ALL SELECT {_KEY.format(x="a")} AS k, 1 AS r, ingested_at, retired_at FROM (SELECT unnest(aliases) AS a, ingested_at, retired_at FROM graph_nodes)
), best AS (SELECT k, min(r) AS r FROM keys GROUP BY k),
nodes AS (SELECT keys.* FROM keys JOIN best USING (k, r)),
refs AS (
  SELECT DISTINCT rel_id, 'head' AS field, {_KEY.format(x="head")} AS k, extracted_at FROM relationships WHERE head IS NOT NULL
  UNION SELECT rel_id, 'tail', {_KEY.format(x="tail")}, extracted_at FROM relationships WHERE tail IS NOT NULL
  UNION SELECT rel_id, 'source_chunk_id', source_chunk_id, extracted_at FROM relationships WHERE source_chunk_id IS NOT NULL
), targets AS (
  SELECT 'n' AS kind, k, ingested_at, retired_at FROM nodes UNION ALL SELECT 'c', chunk_id, ingested_at, retired_at FROM chunks
), judged AS (
  SELECT rel_id, field, extracted_at, count(targets.k) AS n,
    coalesce(bool_or(ingested_at <= extracted_at AND (retired_at IS NULL OR retired_at > extracted_at)), false) AS there,
    coalesce(bool_or(ingested_at <= extracted_at AND retired_at <= extracted_at), false) AS ended
  FROM refs LEFT JOIN targets ON targets.k = refs.k AND targets.kind = CASE WHEN field = 'source_chunk_id' THEN 'c' ELSE 'n' END
  GROUP BY rel_id, field, extracted_at
), orphans AS (
  SELECT rel_id, field, extracted_at, CASE WHEN n = 0 THEN 'missing' WHEN ended THEN 'deleted' ELSE 'late' END AS kind FROM judged WHERE NOT there
)
"""

QUERIES = {"p5_found": p5_found, "p5_report": p5_report}
ORACLE = {
    "p5_found": _FOUND + "SELECT DISTINCT rel_id, field, kind FROM orphans",
    "p5_report": _FOUND
    + """SELECT CASE WHEN field = 'source_chunk_id' THEN 'chunks' ELSE 'graph_nodes' END AS referred_table, field, kind, strftime(extracted_at, '%Y-%m') AS month, count(*) AS n_orphans
FROM orphans GROUP BY ALL""",
}
