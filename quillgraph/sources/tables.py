"""Stored tables: idempotent creation, checks of what may be written, reset, and a stored vector index."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillgraph.operators.graph import key_violations


def ensure_table(spark: SparkSession, name: str, schema: T.StructType, partition: str | None = None) -> None:
    """Create a Parquet table if there is none; the second call changes nothing. Another schema under the name is an error."""
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
    spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({columns}) USING parquet" + (f" PARTITIONED BY (`{partition}`)" if partition else ""))
    have = {f.name: f.dataType for f in spark.table(name).schema}
    if have != {f.name: f.dataType for f in schema}:
        raise ValueError(f"{name} exists with another schema")


def append_checked(rows: DataFrame, name: str, key: tuple[str, ...]) -> None:
    """Append rows whose keys are complete and new to the table; otherwise nothing is written."""
    spark = rows.sparkSession
    both = spark.table(name).select(*key).unionByName(rows.select(*key))
    if bad := key_violations(both, key).limit(3).collect():
        raise ValueError(f"keys repeated or incomplete: {[tuple(r)[:-1] for r in bad]}")
    rows.select(*spark.table(name).columns).write.mode("append").insertInto(name)


def reset(spark: SparkSession, name: str) -> None:
    """Delete all rows and keep the table."""
    spark.createDataFrame([], spark.table(name).schema).write.mode("overwrite").insertInto(name)


def append_durably(rows: DataFrame, path: str) -> None:
    """Append rows as JSON lines in files that appear only when written whole (each append is one committed job)."""
    rows.write.mode("append").option("ignoreNullFields", "false").json(path)


def build_index(base: DataFrame, centroids: np.ndarray, path: str, key: str = "vec_id", vector: str = "embedding") -> None:
    """Store vectors by their nearest cell, so a search reads only the cells it probes. Overwrites an older index."""
    from quillgraph.operators.vector import in_cells

    in_cells(base, centroids, key, vector).repartition(F.col("cell")).write.mode("overwrite").partitionBy("cell").parquet(path)


def drop_index(spark: SparkSession, path: str) -> bool:
    """Delete a stored index; whether there was one."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)
