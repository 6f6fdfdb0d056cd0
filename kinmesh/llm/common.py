"""Helpers that several operators share: tables, the shared folder, cut lineage, native word splitting."""

from __future__ import annotations

import string
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: White space as the word contracts define it.
SPACES = " \t\n\x0b\x0c\r"
SPACE_RUN = r"[\x20\x09-\x0D]+"
#: What separates the words of the license and benchmark contracts, upper case not yet lowered.
NON_WORD_RUN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; one of our own only where the session names none and all runs on one machine."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    if not getattr(shared_dir, "own", None):
        shared_dir.own = tempfile.mkdtemp(prefix="kinmesh-")
    return f"file://{shared_dir.own}"


def scratch(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def deleted_at_exit(spark: SparkSession, path: str) -> None:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(target)


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet to the shared folder and read back: cuts lineage and keeps column pruning. Deleted at exit."""
    spark, path = df.sparkSession, scratch(df.sparkSession, name)
    df.write.parquet(path)
    deleted_at_exit(spark, path)
    return spark.read.schema(df.schema).parquet(path)


def cut(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: survives lost executors. The application's own folder below the shared one is deleted at exit."""
    spark = df.sparkSession
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(shared_dir(spark))
    deleted_at_exit(spark, context._jsc.sc().getCheckpointDir().get())
    return df.checkpoint(eager=True)


def running(df: DataFrame, keys: list[str], order: list[Column], value: Column, out: str, name: str) -> DataFrame:
    """df with the sum of value over the rows before it that have the same keys, 0 for the first.

    Rows are dealt by ranges of keys and order, so that one key may span tasks; a key's sums of whole ranges are added up apart.
    """
    part, before = "_km_part", Window.unboundedPreceding
    rows = df.withColumn("_km_value", value.cast("bigint")).withColumn("_km_tie", F.monotonically_increasing_id())
    rows = stored(rows.repartitionByRange(*keys, *order, "_km_tie").withColumn(part, F.spark_partition_id()), name)
    sums = rows.groupBy(*keys, part).agg(F.sum("_km_value").alias("_km_sum"))
    offset = F.coalesce(F.sum("_km_sum").over(Window.partitionBy(*keys).orderBy(part).rowsBetween(before, -1)), F.lit(0))
    local = F.coalesce(F.sum("_km_value").over(Window.partitionBy(*keys, part).orderBy(*order, "_km_tie").rowsBetween(before, -1)), F.lit(0))
    offsets = sums.select(*keys, part, offset.alias("_km_offset"))
    rows = rows.withColumn("_km_local", local).join(offsets.hint("merge"), [*keys, part])
    return rows.withColumn(out, F.col("_km_local") + F.col("_km_offset")).drop("_km_local", "_km_offset", "_km_value", "_km_tie", part)


def ascii_lower(text: Column) -> Column:
    """Lowers A-Z and nothing else; null becomes the empty text."""
    return F.translate(F.coalesce(text, F.lit("")), string.ascii_uppercase, string.ascii_lowercase)


def space_words(text: Column) -> Column:
    """Runs of anything but white space, as an array; none for null and blank texts."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACES))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACE_RUN))


def alnum_words(text: Column) -> Column:
    """Words of ASCII letters, digits and everything beyond ASCII, A-Z lowered; none for null."""
    parts = F.split(ascii_lower(text), NON_WORD_RUN)
    return F.filter(parts, lambda word: word != "")
