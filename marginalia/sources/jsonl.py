"""Append-only JSON lines with an envelope ``v, ts, host``: reading all, reading the tail, appending, rotating."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import host_name

VERSION = 1


def lines(spark: SparkSession, path: str) -> DataFrame:
    """``file, line_no, value``. Files are splittable, so line numbers come from the order within a file's blocks."""
    raw = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_b"), F.monotonically_increasing_id().alias("_i"), "value")
    return raw.withColumn("line_no", F.row_number().over(Window.partitionBy("file").orderBy("_b", "_i"))).drop("_b", "_i")


def decode(rows: DataFrame) -> DataFrame:
    """``file, line_no, v, ts, host, kind, session, payload, torn``. ``rows``: ``file, line_no, value``."""
    get = lambda k: F.get_json_object("value", f"$.{k}")
    whole = F.try_parse_json("value").isNotNull() & F.startswith(F.ltrim("value"), F.lit("{"))
    return rows.select("file", "line_no", get("v").cast("int").alias("v"), get("ts").cast("long").alias("ts"), get("host").alias("host"), get("kind").alias("kind"), get("session").alias("session"), F.col("value").alias("payload"), (~F.coalesce(whole, F.lit(False))).alias("torn"))


def read_all(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Records of all files in order of time, and per file ``torn_lines, readable``.

    A line that doesn't parse is counted; one record of another version makes its whole file unreadable."""
    found = decode(rows)
    files = found.groupBy("file").agg(F.count(F.when(F.col("torn"), 1)).alias("torn_lines"), (F.count(F.when(~F.col("torn") & (F.coalesce("v", F.lit(-1)) != VERSION), 1)) == 0).alias("readable"))
    records = found.where("not torn").join(files.where("not readable").select("file"), "file", "left_anti")
    return records, files


def tail(rows: DataFrame, bytes_: int) -> DataFrame:
    """Whole lines from the end within a byte budget, per host, in append order; ``truncated`` tells absence from not having looked."""
    size = F.octet_length("value") + 1
    w = Window.partitionBy("host").orderBy(F.desc("pos")).rowsBetween(Window.unboundedPreceding, 0)
    kept = rows.withColumn("_s", F.sum(size).over(w)).withColumn("_total", F.sum(size).over(Window.partitionBy("host")))
    return kept.where(F.col("_s") <= bytes_).withColumn("truncated", F.col("_total") > bytes_).drop("_s", "_total")


def append(records: DataFrame, path: str) -> None:
    """Write records (``ts, host`` and others) under the folder of their host, each line in the envelope."""
    out = records.withColumn("v", F.lit(VERSION)).withColumn("host", host_name(F.col("host")))
    out.withColumn("_host", F.col("host")).write.mode("append").partitionBy("_host").json(path)


def rotate(rows: DataFrame, bytes_: int, generations: int = 2) -> DataFrame:
    """The newest lines of each host that fit into ``generations`` files of a byte cap."""
    return tail(rows, bytes_ * generations).drop("truncated")


def footprint(rows: DataFrame) -> DataFrame:
    return rows.groupBy("host").agg(F.sum(F.octet_length("value") + 1).alias("bytes"))
