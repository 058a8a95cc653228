"""JSON lines: strict reads against a closed schema, truncating writes, upserts by key, and the append-only log."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillgraph.operators.chunks import upsert
from quillgraph.plans.runtime import cut
from quillgraph.schemas import DECISION


def read_strict(spark: SparkSession, paths: list[str], schema: T.StructType) -> DataFrame:
    """Files in the order given, blank lines skipped. A broken line or an unknown field fails the read.

    Each line is parsed twice in the JVM: into the schema, and into a map whose keys are held against it.
    """
    lines = None
    for i, p in enumerate(paths):
        part = spark.read.text(p).where(F.trim("value") != "").select(F.lit(i).alias("file"), "value")
        lines = part if lines is None else lines.unionByName(part)
    known = F.array(*map(F.lit, schema.fieldNames()))
    row = F.from_json("value", schema, {"mode": "FAILFAST"})
    unknown = F.array_except(F.coalesce(F.json_object_keys("value"), F.array().cast("array<string>")), known)
    checked = lines.withColumn("r", F.when(F.size(unknown) == 0, row).otherwise(F.raise_error(F.concat(F.lit("unknown fields: "), F.array_join(unknown, ", "))).cast(schema)))
    return checked.select("r.*")


def write(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def upsert_file(spark: SparkSession, path: str, schema: T.StructType, new: DataFrame, key: str, touched: DataFrame | None = None) -> None:
    """Replace the touched keys' rows in a JSON-lines folder; the result is written aside first, as it is read from there."""
    write(cut(upsert(spark.read.schema(schema).json(path), new, key, touched)), path)


def log_append(decisions: DataFrame, path: str) -> None:
    """Append decisions with their time in UTC seconds; never truncates."""
    stamp = F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ssXXX")
    decisions.withColumn("ts", F.coalesce("ts", stamp)).select(*DECISION.fieldNames()).write.mode("append").option("ignoreNullFields", "false").json(path)


def log_read(spark: SparkSession, path: str) -> DataFrame:
    """The log, empty if there is none yet."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop):
        return spark.createDataFrame([], DECISION)
    return spark.read.schema(DECISION).json(path)


def run_id():
    """A sortable stamp and eight random hex digits."""
    return F.concat(F.date_format(F.current_timestamp(), "yyyyMMdd'T'HHmmss'Z'"), F.lit("-"), F.substring(F.replace(F.uuid(), F.lit("-"), F.lit("")), 1, 8))
