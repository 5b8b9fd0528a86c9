"""Helpers shared by the corpus operators: shared storage, checked broadcasts, ASCII lower-casing."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, MapType, StringType, StructField, StructType

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

#: Rows and bytes beyond which a side is no longer broadcast.
BROADCAST_ROWS, BROADCAST_BYTES = 200_000, 16 << 20

#: The paths that each settled() under way has written, innermost last.
_under_way: list[list[str]] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Only on one machine may it be unset."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if where is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that all machines share")
        where = "file://" + tempfile.mkdtemp(prefix="tessella-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


def _hadoop_path(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder, removed when the driver ends at the latest."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    files, where = _hadoop_path(spark, path)
    files.deleteOnExit(where)
    if _under_way:
        _under_way[-1].append(path)
    return path


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet to the shared folder and read it back: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def settled(spark: SparkSession, make: Callable[[], DataFrame], name: str) -> DataFrame:
    """The table that make() gives, stored. What make() itself stored on the way is removed then."""
    path = new_path(spark, name)
    _under_way.append([])
    try:
        df = make()
        df.write.parquet(path)
        schema = df.schema
    finally:
        for used in _under_way.pop():
            files, where = _hadoop_path(spark, used)
            files.delete(where, True)
    return spark.read.schema(schema).parquet(path)


def _width(field: StructField) -> Column:
    """The bytes of a value, about."""
    if isinstance(field.dataType, StringType | BinaryType):
        return 16 + F.coalesce(F.octet_length(field.name), F.lit(0))
    if isinstance(field.dataType, ArrayType | MapType | StructType):
        return 16 + F.coalesce(F.octet_length(F.to_json(F.struct(field.name))), F.lit(0))
    return F.lit(16)


def broadcast_if_small(df: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> DataFrame:
    """Hint a broadcast only if df, a stored or otherwise cheap table, is counted to have few rows and bytes."""
    width = sum((_width(f) for f in df.schema.fields), F.lit(0)).cast("long")
    n, total = df.limit(rows + 1).agg(F.count("*"), F.coalesce(F.sum(width), F.lit(0))).first()
    return F.broadcast(df) if n <= rows and total <= size else df


def free_name(name: str, df: DataFrame) -> str:
    """name, with as many underscores after it as it takes not to be a column of df."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def ascii_lower(col: Column) -> Column:
    """Lower-case A-Z alone. lower() does the same, faster, where all characters are ASCII."""
    return F.when(F.length(col) == F.octet_length(col), F.lower(col)).otherwise(
        F.translate(col, UPPER, UPPER.lower())
    )


def text_or_empty() -> Column:
    return F.coalesce(F.col("text"), F.lit(""))


def row_key() -> Column:
    """Stands for a row of documents: rows that repeat both doc_id and text share it, and so share their results."""
    return F.xxhash64("doc_id", "text")


def held_out() -> Column:
    """Documents kept from learning: crc32 of the id's text modulo 4 is 2. A null id counts as learnable."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
