"""Queries of the graph, code and streaming operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import code, graph, logs
from ..streaming import sessions
from . import base
from .base import EDGES_SQL, ORDER_EDGES_SQL
from .registry import query

_NEXT = "nx AS (SELECT DISTINCT src AS node, dst AS nxt FROM edges WHERE src <> dst)"


def _levels(depth: int, edges: str) -> str:
    """Level by level in SQL: place by the first discoverer, then by name."""
    parts = ["l0 AS (SELECT CAST(0 AS BIGINT) AS node, 0 AS level, CAST(1 AS BIGINT) AS ord, CAST(NULL AS BIGINT) AS via), s0 AS (SELECT * FROM l0)"]
    for i in range(1, depth + 1):
        parts.append(f"""f{i} AS (SELECT x.nxt AS node, min(ord) AS o, arg_min(p.node, p.ord) AS via FROM l{i - 1} p JOIN {edges} x ON x.node = p.node WHERE x.nxt NOT IN (SELECT node FROM s{i - 1}) GROUP BY x.nxt),
l{i} AS (SELECT node, {i} AS level, row_number() OVER (ORDER BY o, node) AS ord, via FROM f{i}), s{i} AS (SELECT * FROM s{i - 1} UNION ALL SELECT * FROM l{i})""")
    return ",\n".join(parts)


@query("c7_bfs", f"WITH {ORDER_EDGES_SQL}, {_NEXT}, {_levels(4, 'nx')} SELECT node, CAST(level AS INTEGER) AS level, ord, coalesce(via, -1) AS via FROM s4")
def _(spark, d):
    return graph.bfs(base.order_edges(spark, d), 0, 4).withColumn("via", F.coalesce("via", F.lit(-1)))


@query("c7_shortest_path", f"WITH RECURSIVE {ORDER_EDGES_SQL}, {_NEXT}, {_levels(6, 'nx')}, w AS (SELECT node, level, via FROM s6 WHERE node = 24 UNION ALL SELECT s.node, s.level, s.via FROM w JOIN s6 s ON s.node = w.via) SELECT CAST(level AS INTEGER) AS step, node FROM w")
def _(spark, d):
    return graph.shortest_path(base.order_edges(spark, d), 0, 24, 6)


_IN = "nx AS (SELECT DISTINCT dst AS node, src AS nxt FROM edges WHERE src <> dst)"


@query("c8_impact", f"WITH {ORDER_EDGES_SQL}, {_IN}, {_levels(4, 'nx')} SELECT node, CAST(level AS INTEGER) AS level, via, CAST((SELECT count(*) FROM s4 WHERE level > 0) AS INTEGER) AS total, CAST(greatest(0, (SELECT count(*) FROM s4 WHERE level > 0) - 10) AS INTEGER) AS omitted FROM s4 WHERE level > 0 ORDER BY level, node LIMIT 10")
def _(spark, d):
    return graph.impact(base.order_edges(spark, d), 0, 4, 10)


_BOTH = "nx AS (SELECT DISTINCT * FROM (SELECT src AS node, dst AS nxt FROM edges UNION ALL SELECT dst, src FROM edges) WHERE node <> nxt)"


@query("c9_context", f"WITH {ORDER_EDGES_SQL}, {_BOTH}, {_levels(2, 'nx')} SELECT node, CAST(level AS INTEGER) AS level, via, CASE WHEN EXISTS (SELECT 1 FROM edges e WHERE e.src = s.via AND e.dst = s.node) THEN 'uses' ELSE 'used-by' END AS relation FROM s2 s WHERE level > 0 ORDER BY level, node LIMIT 50")
def _(spark, d):
    return graph.context(base.order_edges(spark, d), 0, 2, 50)


def _pagerank_sql(restart: str = "1.0 / 25") -> str:
    parts = [f"nodes AS (SELECT CAST(n_nationkey AS BIGINT) AS node, CAST({restart} AS DOUBLE) AS r FROM nation), w AS (SELECT src, dst, count(*) AS w FROM edges WHERE src <> dst GROUP BY ALL), o AS (SELECT src, sum(w) AS o FROM w GROUP BY src), sh AS MATERIALIZED (SELECT w.src, w.dst, w.w / CAST(o.o AS DOUBLE) AS s FROM w JOIN o USING (src)), p0 AS (SELECT node, r, r AS rank FROM nodes)"]
    for i in range(1, 31):
        parts.append(f"""p{i} AS MATERIALIZED (SELECT n.node, n.r, n.r * (CAST(0.15 AS DOUBLE) + CAST(0.85 AS DOUBLE) * (SELECT coalesce(sum(rank), 0) FROM p{i - 1} WHERE node NOT IN (SELECT src FROM o))) + CAST(0.85 AS DOUBLE) * coalesce((SELECT sum(p.rank * sh.s) FROM p{i - 1} p JOIN sh ON sh.src = p.node WHERE sh.dst = n.node), 0) AS rank FROM nodes n)""")
    return ",\n".join(parts)


def _nodes(spark, d):
    return base.table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("node"))


@query("c11_pagerank", f"WITH {EDGES_SQL}, {_pagerank_sql()} SELECT node, round(rank, 8) AS rank FROM p30")
def _(spark, d):
    return graph.pagerank(_nodes(spark, d), base.edges(spark, d)).select("node", F.round("rank", 8).alias("rank"))


@query("c13_personalised_pagerank", f"WITH {EDGES_SQL}, {_pagerank_sql('CASE WHEN n_nationkey IN (3, 4) THEN 0.5 ELSE 0 END')} SELECT node, round(rank, 8) AS rank FROM p30")
def _(spark, d):
    restart = spark.createDataFrame([(3, 1.0), (4, 1.0)], "node long, weight double")
    return graph.pagerank(_nodes(spark, d), base.edges(spark, d), restart).select("node", F.round("rank", 8).alias("rank"))


@query("c12_rank_percentiles", f"""WITH {EDGES_SQL}, {_pagerank_sql()}, r AS (SELECT node, round(rank, 12) AS rank, n_regionkey AS root FROM p30 JOIN nation ON n_nationkey = node)
SELECT root, node, round((rank() OVER (PARTITION BY root ORDER BY rank) + (count(*) OVER (PARTITION BY root, rank) - 1) / CAST(2 AS DOUBLE) - CAST(0.5 AS DOUBLE)) / count(*) OVER (PARTITION BY root) * 100, 6) AS rank_pct FROM r""")
def _(spark, d):
    e = base.edges(spark, d)
    roots = base.table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("node"), F.col("n_regionkey").alias("root"))
    return graph.rank_percentiles(graph.pagerank(_nodes(spark, d), e), roots, e)


@query("c14_t6_repo_map")
def _(spark, d):
    symbols = base.table(spark, d, "customer").select(F.col("c_nationkey").cast("long").alias("node"), F.col("c_name").alias("name"), F.col("c_custkey").alias("start_line"))
    return graph.repo_map(_nodes(spark, d), base.edges(spark, d), symbols, None, 400)


@query("c16_t9_knowledge_graph", f"""WITH {base.DOCS_SQL.strip()}, {base.DOC_EDGES_SQL}, e AS (SELECT DISTINCT * FROM links), x AS (SELECT d.doc_id, path, ring, (SELECT count(*) FROM e WHERE to_doc = d.doc_id) AS inbound, (SELECT count(*) FROM e WHERE from_doc = d.doc_id) AS outbound FROM docs d)
SELECT doc_id, path, ring, inbound, outbound FROM x ORDER BY inbound + outbound DESC, ring, path LIMIT 40""")
def _(spark, d):
    nodes, _edges = graph.knowledge_graph(base.docs(spark, d).select("doc_id", "path", "ring"), base.doc_edges(spark, d), None)
    return nodes.select("doc_id", "path", "ring", "inbound", "outbound")


@query("c16_focused_graph")
def _(spark, d):
    nodes, edges = graph.knowledge_graph(base.docs(spark, d).select("doc_id", "path", "ring"), base.doc_edges(spark, d), "d0")
    return edges


@query("c17_expansion", f"WITH {base.DOCS_SQL.strip()}, {base.DOC_EDGES_SQL}, n AS (SELECT to_doc AS doc_id FROM links WHERE from_doc IN (0, 7, 14) UNION SELECT from_doc FROM links WHERE to_doc IN (0, 7, 14)) SELECT doc_id, path FROM n JOIN docs USING (doc_id) WHERE doc_id NOT IN (0, 7, 14) ORDER BY ring, path LIMIT 8")
def _(spark, d):
    from ..operators import catalog

    seeds = spark.createDataFrame([(0,), (7,), (14,)], "doc_id long")
    return catalog.linked(base.doc_edges(spark, d), base.docs(spark, d).select("doc_id", "path", "ring"), seeds).select("doc_id", "path")


@query("c6_file_resolution", "SELECT p_brand || '/' || p_partkey || '.rs' AS path, 3 AS level FROM part WHERE p_partkey = 7")
def _(spark, d):
    files = base.table(spark, d, "part").select(F.concat("p_brand", F.lit("/"), F.col("p_partkey").cast("string"), F.lit(".rs")).alias("path"))
    return graph.file_resolution(files, "7.RS")


@query("c5_dependency_index", "WITH f AS (SELECT s_nationkey % 2 AS root, 'f' || (s_suppkey % 40) AS path FROM supplier GROUP BY ALL) SELECT root, path, CASE WHEN count(*) OVER (PARTITION BY path) > 1 THEN '@' || root || '/' || path ELSE path END AS display FROM f")
def _(spark, d):
    files = base.table(spark, d, "supplier").select((F.col("s_nationkey") % 2).alias("root"), F.concat(F.lit("f"), (F.col("s_suppkey") % 40).cast("string")).alias("path")).distinct()
    edges = spark.createDataFrame([], "src string, dst string, start_line int, end_line int, evidence string")
    return graph.dependency_index(files, edges)[0]


@query("c15_edge_prune", f"WITH {EDGES_SQL} SELECT DISTINCT src, dst FROM edges WHERE src % 5 <> 0 AND dst % 5 <> 0")
def _(spark, d):
    files = _nodes(spark, d).where("node % 5 <> 0").withColumnRenamed("node", "path")
    return code.prune_edges(base.edges(spark, d), files).select("src", "dst").distinct()


# ---- code: one small module for each part, which imports the next one

_SOURCES = "concat('from .m', (p_partkey + 1) % {n}, ' import run as go\nimport os\n\nclass Box:\n    def open(self):\n        return go(', p_size, ')\n\ndef run(x):\n    return x\n')"


#: Modules that one task parses: their table is small on disk, so its splits say nothing about the work.
_TASK_MODULES = 50_000


def _modules(spark, d):
    parts = base.table(spark, d, "part").select("p_partkey", "p_size")
    n = parts.count()
    parts = parts.repartition(max(spark.sparkContext.defaultParallelism, -(-n // _TASK_MODULES)))
    return parts.select(F.concat(F.lit("pkg/m"), F.col("p_partkey").cast("string"), F.lit(".py")).alias("path"), F.expr(_SOURCES.format(n=max(1, n))).alias("source"))


_M = "m AS (SELECT p_partkey AS i, 'pkg/m' || p_partkey || '.py' AS path FROM part)"


@query("c1_symbols", f"WITH {_M} SELECT path, name, kind, CAST(a AS INTEGER) AS start_line, CAST(b AS INTEGER) AS end_line, CAST(coalesce(p, 0) AS INTEGER) AS parent FROM m, (VALUES ('Box', 'class', 4, 6, NULL), ('open', 'function', 5, 6, 4), ('run', 'function', 8, 9, NULL)) s(name, kind, a, b, p)")
def _(spark, d):
    return code.symbol_table(_modules(spark, d)).select("path", "name", "kind", "start_line", "end_line", F.coalesce("parent_start_line", F.lit(0)).alias("parent"))


@query("c2_uses", f"WITH {_M} SELECT path, 'go' AS name, 'calls' AS relation, 6 AS start_line FROM m")
def _(spark, d):
    return code.use_table(_modules(spark, d)).select("path", "name", "relation", "start_line")


@query("c3_imports", f"WITH {_M} SELECT path AS src, 'pkg/m' || ((i + 1) % (SELECT count(*) FROM part)) || '.py' AS dst, 1 AS start_line FROM m")
def _(spark, d):
    return code.import_tables(_modules(spark, d))[0]


@query("c10_j9_j10_symbol_context", f"WITH {_M} SELECT relation, path, name, CAST(line AS INTEGER) AS start_line FROM (SELECT 'calls' AS relation, path, 'open' AS name, 6 AS line FROM m) ORDER BY path LIMIT 1000")
def _(spark, d):
    files, path = _modules(spark, d), base.shared_path(spark, "modules")
    code.parsed(files).write.parquet(path)  # parsed once, read by each of the tables below
    made = spark.read.parquet(path)
    symbols, uses = code.parsed_table(made, "symbols"), code.parsed_table(made, "uses")
    resolved = code.resolve_uses(uses, code.import_tables(files, found=code.parsed_table(made, "imports"))[1], symbols)
    held = code.containers(uses, symbols).select("path", "name", "qualifier", "relation", "start_line", "end_line", "container")
    return code.symbol_context("run", symbols, resolved, held, 1000).select("relation", "path", "name", "start_line")


@query("c4_incremental_code_scan", f"WITH {_M} SELECT path, CASE WHEN i % 7 = 0 THEN 'new' ELSE 'old' END AS state FROM m WHERE i % 10 <> 9")
def _(spark, d):
    files = _modules(spark, d).withColumn("i", F.regexp_extract("path", "m([0-9]+)", 1).cast("int")).withColumn("size", F.col("i")).withColumn("unmeasured", F.lit(None).cast("string"))
    old = files.withColumn("mtime", F.lit(1))
    new = files.where("i % 10 <> 9").withColumn("mtime", F.when(F.col("i") % 7 == 0, 2).otherwise(1))
    return code.incremental(old.select("path", F.lit("old").alias("state")), old, new, lambda x: x.select("path", F.lit("new").alias("state")))


@query("t10_symbol_slices", "SELECT name, start_line, end_line FROM (VALUES ('Box', 4, 6), ('open', 5, 6), ('run', 8, 9)) t(name, start_line, end_line)")
def _(spark, d):
    return code.largest_symbols(code.symbol_table(_modules(spark, d)), "pkg/m3.py").select("name", "start_line", "end_line")


# ---- streams: the batch table read as a file stream, run to its end


def _stream(spark, d, columns):
    """The events as a stream of files written for it, so any table path will do."""
    path = base.shared_path(spark, "stream")
    columns(base.events(spark, d)).repartition(4, "session").sortWithinPartitions("pos").write.parquet(f"{path}/in")
    return spark.readStream.schema(spark.read.parquet(f"{path}/in").schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/in"), path


def _finish(query_) -> None:
    query_.awaitTermination()


@query("s6_s7_session_state", f"""WITH {base.EVENTS_SQL}, x AS (SELECT *, 'f' || (k % 5) AS file FROM evs), y AS (SELECT *, count(*) FILTER (WHERE kind = 'write') OVER (PARTITION BY session, file ORDER BY pos ROWS UNBOUNDED PRECEDING) AS s FROM x WHERE kind <> 'bash'),
z AS (SELECT *, row_number() OVER (PARTITION BY session, file, s ORDER BY pos) AS n FROM y WHERE kind = 'read'), c AS (SELECT session, pos, row_number() OVER (PARTITION BY session ORDER BY pos) AS n FROM evs)
SELECT session, pos, 'repeat-read' AS advice FROM z WHERE n = 2 UNION ALL SELECT session, pos, 'cadence' FROM c WHERE n % 25 = 0""")
def _(spark, d):
    stream, path = _stream(spark, d, lambda e: e.select("session", "pos", "kind", F.concat(F.lit("f"), (F.col("k") % 5).cast("string")).alias("file_path")))
    q = sessions.session_advice(stream).writeStream.format("parquet").option("checkpointLocation", f"{path}/state").option("path", f"{path}/out").trigger(availableNow=True).start()
    _finish(q)
    return spark.read.parquet(f"{path}/out")


@query("s9_stream_deltas", f"WITH {base.EVENTS_SQL} SELECT pos, CAST(greatest(0, k - coalesce(lag(k) OVER (PARTITION BY host, session ORDER BY pos), 0)) AS BIGINT) AS delta FROM evs")
def _(spark, d):
    stream, path = _stream(spark, d, lambda e: e.select("host", "session", "pos", F.col("k").cast("long").alias("total")))
    q = sessions.counter_deltas(stream).writeStream.format("parquet").option("checkpointLocation", f"{path}/state").option("path", f"{path}/out").trigger(availableNow=True).start()
    _finish(q)
    return spark.read.parquet(f"{path}/out").select("pos", "delta")


@query("s10_trap_stream", f"WITH {base.EVENTS_SQL}, f AS (SELECT norm FROM bash WHERE failed GROUP BY norm HAVING count(DISTINCT session) >= 2) SELECT 'recurring-failure' AS reason, norm AS key FROM f")
def _(spark, d):
    stream, path = _stream(spark, d, lambda e: e)
    q = sessions.traps_per_batch(stream, f"{path}/out", f"{path}/state")
    _finish(q)
    return spark.read.parquet(f"{path}/out").where("reason = 'recurring-failure'").select("reason", "key").distinct()


@query("s1_s2_refresh", f"WITH {base.EVENTS_SQL} SELECT session, count(*) AS n FROM evs GROUP BY session")
def _(spark, d):
    stream, path = _stream(spark, d, lambda e: e.select("session", "pos"))
    q = sessions.refresh(stream, lambda rows, g: rows.groupBy("session").agg(F.count("*").alias("n")), f"{path}/state", f"{path}/out")
    _finish(q)
    return spark.read.parquet(f"{path}/out").groupBy("session").agg(F.sum("n").alias("n"))


@query("s5_labels", "SELECT r_name, 'local' AS origin, 7 AS generation, false AS fresh, 'over budget' AS stale_note FROM region")
def _(spark, d):
    return sessions.labelled(base.table(spark, d, "region").select("r_name"), "local", 7, False, "over budget")


@query("s3_s15_windowed_counts", "SELECT date_trunc('day', ts) AS start, event_type, count(*) AS n FROM events GROUP BY ALL")
def _(spark, d):
    """Addition beside the session operators: event-time windows with a watermark, here on the batch table."""
    return sessions.windowed_counts(base.table(spark, d, "events"))


@query("s10_traps_batch", f"WITH {base.EVENTS_SQL}, f AS (SELECT norm FROM bash WHERE failed GROUP BY norm HAVING count(DISTINCT session) >= 2) SELECT norm AS key FROM f")
def _(spark, d):
    return sessions.traps(base.events(spark, d)).where("reason = 'recurring-failure'").select("key")


@query("s12_vector_worker")
def _(spark, d):
    """Missing vectors derived from a stream of hashes; the store ends with each hash once."""
    from ..sources import vector_store

    stream, path = _stream(spark, d, lambda e: e.select("session", "pos", F.md5("norm").alias("hash"), F.col("norm").alias("text")))
    q = sessions.vector_worker(stream.select("hash", "text"), f"{path}/store", lambda texts: [[float(len(t))] for t in texts], f"{path}/state")
    _finish(q)
    return vector_store.read(spark, f"{path}/store", "default").groupBy("hash").agg(F.count("*").alias("n"))


@query("j_ledger_liveness_join", f"WITH {base.EVENTS_SQL} SELECT session, count(*) AS n FROM bash GROUP BY session")
def _(spark, d):
    return logs.turn_summary(base.events(spark, d)).where("bash > 0").select("session", F.col("bash").alias("n"))


@query("s11_code_scan", f"WITH {_M} SELECT path, name FROM m, (VALUES ('Box'), ('open'), ('run')) t(name)")
def _(spark, d):
    """Symbols of a stream of modules, which arrive in two files, each scanned once under the gate."""
    path = base.shared_path(spark, "scan")
    gate, files = sessions.ScanGate(), _modules(spark, d)
    late = F.pmod(F.xxhash64("path"), F.lit(2)) == 1
    for part in (files.where(~late), files.where(late)):
        part.write.mode("append").parquet(f"{path}/in")
        stream = spark.readStream.schema(files.schema).parquet(f"{path}/in")
        assert sessions.scan_code(stream, code.symbol_table, gate, f"{path}/state", f"{path}/out")
    if gate.status()["last_error"]:
        raise RuntimeError(gate.status()["last_error"])
    return spark.read.parquet(f"{path}/out").select("path", "name")
