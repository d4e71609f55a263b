"""The test tables seen as a catalog of documents, an event log and transcripts, in Spark and in SQL."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T

SMALL = 256 << 20
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """A table of ``SMALL`` bytes at most dealt to all cores: its file may be a single row group, which one task reads. Larger ones stay as they are."""
    size = df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism) if int(size) <= SMALL else df


def shared_path(spark: SparkSession, name: str) -> str:
    """A new folder below ``spark.checkpoint.dir``; where that is unset, below a temporary one, and on a local master only."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = "file://" + tempfile.mkdtemp(prefix="marginalia-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/marginalia/{name}-{uuid.uuid4().hex}"


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``doc_id, path, ring, lang, size, text``: source/language/number as the path, the source's number as the ring."""
    d = spread(table(spark, sf_dir, "documents"))
    path = F.concat("source", F.lit("/"), "lang", F.lit("/d"), F.col("doc_id").cast("string"), F.lit(".md"))
    ring = F.pmod(F.regexp_extract("source", "([0-9]+)", 1).cast("int"), F.lit(5))
    return d.select("doc_id", path.alias("path"), ring.alias("ring"), "lang", F.octet_length("text").cast("long").alias("size"), "text")


def blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One block per line that is not blank."""
    lines = docs(spark, sf_dir).select("doc_id", "path", "ring", F.col("lang").alias("chain"), F.col("lang").alias("ctx"), F.posexplode(F.split("text", "\n")).alias("i", "text"))
    b = lines.where(T.collapse(F.col("text")) != "").withColumn("hash", T.content_hash(F.col("text")))
    return b.select((F.col("doc_id") * 100000 + F.col("i") + 1).alias("block_id"), "doc_id", "path", "ring", (F.col("i") + 1).alias("line"), "chain", "ctx", "text", "hash", T.citation(F.col("ring"), F.col("hash")).alias("cite"))


DOCS_SQL = f"""
docs AS (SELECT doc_id, source || '/' || lang || '/d' || doc_id || '.md' AS path, CAST(regexp_extract(source, '[0-9]+') AS INTEGER) % 5 AS ring, lang,
  CAST(octet_length(encode(text)) AS BIGINT) AS size, text FROM documents)"""
COLLAPSE = "trim(regexp_replace(text, '\\s+', ' ', 'g'))"
HASH = f"sha256(translate({COLLAPSE}, '{UPPER}', '{LOWER}'))"
BLOCKS_SQL = DOCS_SQL + f""",
raw_lines AS (SELECT doc_id, path, ring, lang, unnest(string_split(text, chr(10))) AS text, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS line FROM docs),
hashed AS (SELECT *, {HASH} AS hash FROM raw_lines WHERE {COLLAPSE} <> ''),
blocks AS (SELECT doc_id * 100000 + line AS block_id, doc_id, path, ring, line, lang AS chain, lang AS ctx, text, hash, 'r' || ring || '-' || substr(hash, 1, 10) AS cite FROM hashed)"""


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors are failed commands, purchases successful ones, sign-ups writes, the rest reads; the user is the session."""
    e = table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("int")
    kind = F.when(F.col("event_type").isin("error", "purchase"), "bash").when(F.col("event_type") == "signup", "write").otherwise("read")
    return e.select(
        F.col("event_id").alias("pos"), F.unix_timestamp("ts").alias("ts"), F.concat(F.lit("h"), F.pmod("user_id", F.lit(3)).cast("string")).alias("host"), F.concat(F.lit("s"), F.col("user_id").cast("string")).alias("session"),
        kind.alias("kind"), (F.col("event_type") == "error").alias("failed"), F.concat(F.lit("run job n"), F.pmod(k, F.lit(11)).cast("string")).alias("norm"), F.concat(F.lit("run job "), k.cast("string")).alias("command"),
        F.concat(F.lit("notes/f"), F.pmod(k, F.lit(40)).cast("string"), F.lit(".md")).alias("file_path"), F.pmod(k, F.lit(5)).alias("ring"), F.col("value"), k.alias("k"),
    )


EVENTS_SQL = """
ev AS (SELECT event_id AS pos, CAST(floor(epoch(ts)) AS BIGINT) AS ts, 'h' || (user_id % 3) AS host, 's' || user_id AS session,
  CASE WHEN event_type IN ('error', 'purchase') THEN 'bash' WHEN event_type = 'signup' THEN 'write' ELSE 'read' END AS kind, event_type = 'error' AS failed,
  CAST(json_extract(props, '$.k') AS INTEGER) AS k, value FROM events),
evs AS (SELECT *, 'run job n' || (k % 11) AS norm, 'run job ' || k AS command, 'notes/f' || (k % 40) || '.md' AS file_path, k % 5 AS ring FROM ev),
bash AS (SELECT * FROM evs WHERE kind = 'bash')"""


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nation to nation: a customer's nation to the nation of each supplier of its orders; an edge bag ``src, dst``."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey")
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    s = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    j = o.join(li, o.o_orderkey == li.l_orderkey).join(c, o.o_custkey == c.c_custkey).join(s, li.l_suppkey == s.s_suppkey)
    return j.select(F.col("c_nationkey").cast("long").alias("src"), F.col("s_nationkey").cast("long").alias("dst"))


EDGES_SQL = """
edges AS MATERIALIZED (SELECT CAST(c_nationkey AS BIGINT) AS src, CAST(s_nationkey AS BIGINT) AS dst FROM orders JOIN lineitem ON o_orderkey = l_orderkey
  JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey)"""


def order_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customer to customer: the buyer of each order to the customer whose number its key folds to; an edge bag ``src, dst``."""
    n = F.lit(max(1, table(spark, sf_dir, "customer").count()))
    return table(spark, sf_dir, "orders").select(F.col("o_custkey").cast("long").alias("src"), F.pmod("o_orderkey", n).cast("long").alias("dst"))


ORDER_EDGES_SQL = """
edges AS MATERIALIZED (SELECT CAST(o_custkey AS BIGINT) AS src, CAST(o_orderkey % n AS BIGINT) AS dst FROM orders, (SELECT greatest(1, count(*)) AS n FROM customer))"""


def doc_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bag ``from_doc, to_doc``: each line of an order links its part to its supplier's number, both folded into the number of documents."""
    n = F.lit(max(1, table(spark, sf_dir, "documents").count()))
    li = table(spark, sf_dir, "lineitem")
    return li.select(F.pmod("l_partkey", n).alias("from_doc"), F.pmod(F.col("l_suppkey") * 7, n).alias("to_doc")).where("from_doc <> to_doc")


DOC_EDGES_SQL = """links AS (SELECT l_partkey % n AS from_doc, (l_suppkey * 7) % n AS to_doc FROM lineitem, (SELECT greatest(1, count(*)) AS n FROM documents) WHERE l_partkey % n <> (l_suppkey * 7) % n)"""


def sql_list(values) -> str:
    return ", ".join(f"'{v}'" for v in values)
