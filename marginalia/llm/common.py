"""Shared pieces: table access, shared-folder tables and connected components."""

from __future__ import annotations

import ctypes
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the contracts: \x20 and \x09-\x0D.
SPACES = " \t\n\x0b\x0c\r"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


#: Bytes that one Arrow batch hands to a Python worker; Spark's own bound is eight times as large.
BATCH_BYTES = 8 << 20


def bound_batches(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bound_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lean(run):
    """``run`` for mapInArrow, followed by handing unused memory back to the system: Python workers outlive their tasks and are used again."""

    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
            if trim:
                trim(0)

    return wrapped


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``, or one of our own where that is unset on a local master (tests)."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="marginalia-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/marginalia/{name}-{uuid.uuid4().hex}"


def drop_path(spark: SparkSession, path: str) -> None:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)


def materialize(spark: SparkSession, df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """Write ``df`` as Parquet in the shared folder and read it back: a short lineage that outlives any executor."""
    bound_batches(spark)
    path = shared_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def ascii_lower(col):
    """Lower-case A-Z only. ASCII strings take Spark's fast path, others a code point map."""
    return F.when(F.octet_length(col) == F.char_length(col), F.lower(col)).otherwise(F.translate(col, _UPPER, _LOWER))


def fresh(columns: list[str]) -> str:
    """A prefix with which no column name begins, whatever its case."""
    prefix = "_"
    while any(c.lower().startswith(prefix) for c in columns):
        prefix += "_"
    return prefix


def column(name: str):
    """A column by its exact name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


def key128(col) -> list:
    """Two independent 64-bit hashes of one column; together they serve as its identity."""
    return [F.xxhash64(col), F.xxhash64(F.lit(0x5EED), col)]


def components(spark: SparkSession, edges: DataFrame, max_rounds: int = 100) -> DataFrame:
    """Connected components of ``edges(a, b)``: rows ``(node, component)`` with component the smallest node reachable.

    Contraction: each node takes the smallest label of its closed neighbourhood, edges are relabelled and made distinct,
    and the smaller graph goes into the next round, until no edge is left. A component's smallest node is always
    its own label, so it names the result. The minima are partially aggregated before their shuffle, and the relabelling
    joins meet one row per node, so a hub's edges can be split by the adaptive skew join. Nodes without an edge
    and null ends have no row. No edges give no rows.
    """
    live = edges.where("a is not null and b is not null and a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    live, path = materialize(spark, live, "edges")
    mapping, mapping_path = None, None
    for _ in range(max_rounds):
        both = live.select(F.col("a").alias("node"), F.col("b").alias("other")).unionAll(live.select("b", "a"))
        hooked, hooked_path = materialize(spark, both.groupBy("node").agg(F.least("node", F.min("other")).alias("up")), "hook")
        # one pointer jump: node -> up(up(node))
        jumped = hooked.join(hooked.select(F.col("node").alias("up"), F.col("up").alias("top")), "up").select("node", F.col("top").alias("label"))
        label, label_path = materialize(spark, jumped, "label")
        if mapping is None:
            step = label.select("node", F.col("label").alias("component"))
        else:
            step = mapping.join(label.withColumnRenamed("node", "component"), "component", "left").select("node", F.coalesce("label", "component").alias("component"))
        step, step_path = materialize(spark, step, "components")
        shrunk = (
            live.join(label.select(F.col("node").alias("a"), F.col("label").alias("la")), "a")
            .join(label.select(F.col("node").alias("b"), F.col("label").alias("lb")), "b")
            .where("la <> lb")
            .select(F.least("la", "lb").alias("a"), F.greatest("la", "lb").alias("b"))
            .distinct()
        )
        shrunk, shrunk_path = materialize(spark, shrunk, "edges")
        for old in (path, hooked_path, label_path, mapping_path):
            if old:
                drop_path(spark, old)
        live, path, mapping, mapping_path = shrunk, shrunk_path, step, step_path
        if live.isEmpty():
            return mapping
    raise RuntimeError("components did not converge")
