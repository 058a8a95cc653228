"""Run-time helpers shared by operators: reading tables, cutting lineage, measuring before broadcasting."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
import zipfile
from collections.abc import Callable
from functools import wraps
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A side is broadcast only when its counted rows and bytes stay under these bounds; beyond them operators shuffle.
BROADCAST_ROWS, BROADCAST_BYTES = 200_000, 64 << 20
#: A key with this share of a table's rows is salted when joined.
HOT_SHARE = 0.02

_written: list[tuple[SparkSession, str]] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One driver table; Parquet footers carry the schema, so nothing is inferred."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir`` if set, else one made here (local runs only)."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if where:
        return where.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
    where = Path(tempfile.gettempdir(), f"quillgraph-{uuid.uuid4().hex}").as_uri()
    spark.conf.set("spark.checkpoint.dir", where)
    return where


def ship(spark: SparkSession) -> None:
    """Give the executors' Python workers this package, once per session; a cluster need not have it installed.

    Every operator whose rows pass through Python calls it, itself or by ``cut``. The zip is removed at exit.
    """
    sc = spark.sparkContext
    if getattr(sc, "_quillgraph_shipped", False):
        return
    root = Path(__file__).resolve().parent.parent
    where = Path(tempfile.mkdtemp(prefix="quillgraph-"), "quillgraph.zip")
    atexit.register(shutil.rmtree, where.parent, ignore_errors=True)
    with zipfile.ZipFile(where, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    sc.addPyFile(str(where))
    sc._quillgraph_shipped = True


def _remove_all() -> None:
    for spark, path in _written:
        try:
            hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)
        except Exception:  # the session is gone; the folder's owner clears it
            pass


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Survives lost executors (unlike a local checkpoint), keeps ids that were drawn non-deterministically
    stable, and lets later scans prune columns, which ``checkpoint()`` would not.
    """
    spark = df.sparkSession
    ship(spark)
    if not _written:
        atexit.register(_remove_all)
    path = f"{shared_dir(spark)}/cut-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    _written.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """A small table in few files spread over all cores before a stage that is heavy on each row; large ones stay."""
    least = 2 * df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(least) if len(df.inputFiles()) < least and df.rdd.getNumPartitions() < least else df


_WIDTHS = {"boolean": 1, "tinyint": 1, "smallint": 2, "int": 4, "float": 4, "date": 4}


def _row_bytes(df: DataFrame) -> Column:
    """Bytes of a row's values: fixed widths, lengths of strings, and of other values their length as JSON."""
    size = F.lit(0).cast("bigint")
    for f in df.schema:
        kind, c = f.dataType.simpleString(), F.col(f"`{f.name}`")
        size += F.lit(_WIDTHS.get(kind, 8)) if not isinstance(f.dataType, (T.StringType, T.BinaryType, T.ArrayType, T.MapType, T.StructType)) else F.coalesce(F.octet_length(c) if isinstance(f.dataType, (T.StringType, T.BinaryType)) else F.octet_length(F.to_json(F.struct(c))), F.lit(0))
    return size


def small_enough(df: DataFrame, rows: int = BROADCAST_ROWS, most: int = BROADCAST_BYTES) -> bool:
    """Whether ``df`` has at most ``rows`` rows of ``most`` bytes together; reads no more of it than needed to tell."""
    r = df.limit(rows + 1).agg(F.count("*").alias("n"), F.sum(_row_bytes(df)).alias("b")).first()
    return r.n <= rows and (r.b or 0) <= most


def hot_keys(df: DataFrame, key: Column, share: float = HOT_SHARE) -> list[int]:
    """Hashes of the keys that may hold ``share`` of the rows, at most a few per 1 / share: every such key is among them."""
    found = df.select(F.xxhash64(key).alias("k")).freqItems(["k"], share).first()
    return sorted(k for k in found[0] if k is not None)


def join_sized(big: DataFrame, side: DataFrame, on: list[str], how: str = "inner", rows: int = BROADCAST_ROWS, salts: int = 16, small: bool | None = None) -> DataFrame:
    """Inner or left join of a large, possibly skewed table with a side of unknown size.

    The side is broadcast if rows and bytes are counted small. Otherwise both shuffle; keys measured to hold a large
    share of the big table get a salt, and only their rows of the side are repeated, once per salt.
    """
    if small_enough(side, rows):
        return big.join(F.broadcast(side), on, how)
    key = F.struct(*on)
    hot = hot_keys(big, key)
    if not hot:
        return big.join(side, on, how)
    is_hot = F.xxhash64(key).isin(hot)
    salted = big.withColumn("_salt", F.when(is_hot, F.pmod(F.xxhash64(*big.columns), F.lit(salts)).cast("int")).otherwise(0))
    repeated = side.withColumn("_salt", F.explode(F.when(is_hot, F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))))
    return salted.join(repeated, [*on, "_salt"], how).drop("_salt")


def wide(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    """The query with its counts and positions as bigint, as SQL returns them."""

    @wraps(query)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = query(spark, sf_dir)
        return df.withColumns({f.name: F.col(f.name).cast("bigint") for f in df.schema if f.dataType.simpleString() == "int"})

    return run
