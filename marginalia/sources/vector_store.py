"""Vectors in a table partitioned by their specification, and the plain record format: an index text and a file of fixed-width codes."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

HEAD_LINES = 8


def write(records: DataFrame, path: str, spec: str) -> None:
    """Append records ``hash, v`` of one specification, known hashes left out."""
    spark = records.sparkSession
    fresh = records.dropDuplicates(["hash"])
    try:
        known = read(spark, path, spec)
        fresh = fresh.join(known.select("hash"), "hash", "left_anti")
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
    fresh.withColumn("spec", F.lit(spec)).write.mode("append").partitionBy("spec").parquet(path)


def read(spark: SparkSession, path: str, spec: str) -> DataFrame:
    return spark.read.parquet(path).where(F.col("spec") == spec).drop("spec")


def read_records(indexes: DataFrame, width: int) -> DataFrame:
    """``hash, ord, v`` of record files given as ``index`` text and ``data`` bytes.

    An index has 8 lines of head and one hash a line; its last line counts only when ended. Hashes and records pair up to the shorter."""

    def run(batches):
        for batch in batches:
            for index, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                names = index.split("\n")[:-1][HEAD_LINES:]
                n = min(len(names), len(data) // width)
                codes = np.frombuffer(data[: n * width], np.int8).reshape(n, width)
                yield pa.RecordBatch.from_pydict({"hash": names[:n], "ord": list(range(n)), "v": codes.astype(np.int32).tolist()}, schema=pa.schema([("hash", pa.string()), ("ord", pa.int32()), ("v", pa.list_(pa.int32()))]))

    return indexes.select("index", "data").mapInArrow(run, "hash string, ord int, v array<int>")


def half_codes(column):
    """IEEE half precision, there and back, as the store keeps it."""
    @F.pandas_udf("array<float>")
    def convert(values: pd.Series) -> pd.Series:
        return values.map(lambda v: None if v is None else np.asarray(v, np.float32).astype(np.float16).astype(np.float32))

    return convert(column)
