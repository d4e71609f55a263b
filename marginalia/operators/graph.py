"""Graphs as edge tables: breadth-first levels with explanations, PageRank, percentiles, knowledge graph."""

from __future__ import annotations

import uuid
from itertools import count

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import catalog, comparison

DAMPING, ITERATIONS = 0.85, 30


def _cut(df: DataFrame) -> DataFrame:
    """A short lineage: a table in the shared folder where one is named, else the plan as it is, cached."""
    spark = df.sparkSession
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        return df.cache()
    path = f"{base.rstrip('/')}/marginalia/graph-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def neighbours(edges: DataFrame, direction: str) -> DataFrame:
    """Distinct ``node, next`` along edges (out), against them (in) or both ways."""
    out = edges.select(F.col("src").alias("node"), F.col("dst").alias("next"))
    into = edges.select(F.col("dst").alias("node"), F.col("src").alias("next"))
    chosen = {"out": out, "in": into, "both": out.unionByName(into)}[direction]
    return chosen.where("node <> next").distinct()


def bfs(edges: DataFrame, start, depth: int | None, direction: str = "out", enough: int | None = None) -> DataFrame:
    """``node, level, ord, via`` of every node within ``depth`` steps; without a depth, of all that can be reached.

    With ``enough``, the level that reaches so many nodes is the last one.

    Within a level nodes are in queue order: by the place of their first discoverer, then by name; ``via`` is that discoverer.
    A level is one join of the frontier with the edges; the frontier's places are ranks of its own rows only."""
    spark = edges.sparkSession
    steps = _cut(neighbours(edges, direction))
    kind = dict(steps.dtypes)["node"]
    seen = spark.createDataFrame([(start, 0, 1, None)], f"node {kind}, level int, ord long, via {kind}")
    frontier = seen
    total = 1
    for level in count(1) if depth is None else range(1, depth + 1):
        if enough is not None and total >= enough:
            break
        found = frontier.join(steps, "node").join(seen.select(F.col("node").alias("next")), "next", "left_anti")
        first = found.groupBy("next").agg(F.min(F.struct("ord", "node")).alias("m")).select(F.col("next").alias("node"), F.lit(level).alias("level"), F.col("m.ord").alias("_o"), F.col("m.node").alias("via"))
        frontier = _cut(first.withColumn("ord", F.row_number().over(Window.orderBy("_o", "node")).cast("long")).select("node", "level", "ord", "via"))
        new = frontier.count()
        if not new:
            break
        total += new
        seen = _cut(seen.unionByName(frontier))
    return seen


def shortest_path(edges: DataFrame, start, goal, depth: int = 12) -> DataFrame:
    """``step, node`` of the path found first, no rows without one. The walk back reads one row a step."""
    seen = bfs(edges, start, depth)
    spark, kind = edges.sparkSession, dict(edges.dtypes)["src"]
    path, node = [], goal
    while node is not None:
        row = seen.where(F.col("node") == F.lit(node)).select("via").first()
        if row is None:
            break
        path.append(node)
        node = row["via"]
    rows = list(enumerate(reversed(path))) if path and path[-1] == start else []
    return spark.createDataFrame(rows, f"step int, node {kind}")


def impact(edges: DataFrame, target, depth: int = 4, limit: int = 50) -> DataFrame:
    """Nodes that reach the target against the edges, nearest first, with the number left out by the limit."""
    found = bfs(edges, target, depth, "in").where("level > 0")
    total = found.count()
    top = found.orderBy("level", "node").limit(limit)
    return top.select("node", "level", "via").withColumn("total", F.lit(total)).withColumn("omitted", F.lit(max(0, total - limit)))


def context(edges: DataFrame, target, depth: int = 2, limit: int = 50) -> DataFrame:
    """Nodes around the target in either direction, each with one edge that explains it and that edge's direction."""
    found = bfs(edges, target, depth, "both").where("level > 0")
    forward = edges.select(F.col("src").alias("via"), F.col("dst").alias("node")).distinct().withColumn("f", F.lit(True))
    return found.join(forward, ["via", "node"], "left").select("node", "level", "via", F.when(F.col("f"), "uses").otherwise("used-by").alias("relation")).orderBy("level", "node").limit(limit)


def pagerank(nodes: DataFrame, edges: DataFrame, restart: DataFrame | None = None, iterations: int = ITERATIONS, damping: float = DAMPING, cut_every: int = 5) -> DataFrame:
    """``node, rank``: parallel edges keep their weight, self-loops don't count, rank without an exit restarts.

    ``restart``: ``node, weight``; uniform without it. One iteration is one join and one sum per node; sums combine before the
    shuffle, so a hub is one row a task. The plan is cut every few iterations."""
    w = edges.where("src <> dst").groupBy("src", "dst").agg(F.count("*").alias("w"))
    out = w.groupBy("src").agg(F.sum("w").alias("out"))
    share = _cut(w.join(out, "src").select("src", "dst", (F.col("w") / F.col("out")).alias("share")))
    n = nodes.count()
    if restart is None:
        base = nodes.select("node").withColumn("r", F.lit(1.0 / max(n, 1)))
    else:
        total = restart.agg(F.sum("weight")).first()[0] or 0
        base = nodes.select("node").join(restart, "node", "left").select("node", (F.coalesce("weight", F.lit(0.0)) / F.lit(float(total)) if total else F.lit(1.0 / max(n, 1))).alias("r"))
    base = _cut(base.join(out.select(F.col("src").alias("node"), F.lit(True).alias("has")), "node", "left").select("node", "r", F.coalesce("has", F.lit(False)).alias("has")))
    ranks = base.withColumn("rank", F.col("r"))
    for i in range(1, iterations + 1):
        got = ranks.join(share, F.col("node") == F.col("src")).groupBy(F.col("dst").alias("node")).agg(F.sum(F.col("rank") * F.col("share")).alias("g"))
        lost = ranks.agg(F.sum(F.when(~F.col("has"), F.col("rank")).otherwise(0.0)).alias("lost"))
        new = F.col("r") * (1 - damping + damping * F.col("lost")) + damping * F.coalesce("g", F.lit(0.0))
        ranks = base.join(got, "node", "left").crossJoin(F.broadcast(lost)).select("node", "r", "has", new.alias("rank"))
        if i % cut_every == 0:
            ranks = _cut(ranks)
    return ranks.select("node", "rank")


def rank_percentiles(ranks: DataFrame, roots: DataFrame, edges: DataFrame) -> DataFrame:
    """Percentile of each file within its root; null for a root without an edge. ``roots``: ``node, root``."""
    live = edges.select(F.col("src").alias("node")).union(edges.select("dst")).join(roots, "node").select("root").distinct().withColumn("live", F.lit(True))
    out = comparison.hazen(ranks.join(roots, "node").withColumn("rank", F.round("rank", 12)), "rank", ["root"])
    return out.join(live, "root", "left").select("root", "node", F.when(F.col("live"), F.col("percentile")).alias("rank_pct"))


def focus_restart(nodes: DataFrame, focus: str) -> DataFrame | None:
    """Uniform weight on nodes whose normalised name holds the focus; None without a match."""
    from ..functions import text

    q = "".join(c for c in focus.lower() if c.isascii() and c.isalnum())
    hit = nodes.where(F.contains(text.identifier(F.col("node").cast("string")), F.lit(q)))
    return None if not q or hit.isEmpty() else hit.select("node").withColumn("weight", F.lit(1.0))


def repo_map(nodes: DataFrame, edges: DataFrame, symbols: DataFrame, focus: str | None, budget: int, shown: int = 4) -> DataFrame:
    """Files by personalised rank with their first symbols, as many as the token budget holds."""
    from . import ranking

    ranks = pagerank(nodes, edges, focus_restart(nodes, focus) if focus else None)
    first = symbols.withColumn("_n", F.row_number().over(Window.partitionBy("node").orderBy("start_line", "name"))).where(F.col("_n") <= shown)
    named = first.groupBy("node").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_n", "name"))), lambda x: x["name"]), ", ").alias("symbols"))
    rows = ranks.join(named, "node", "left").select("node", F.round("rank", 9).alias("rank"), F.coalesce("symbols", F.lit("")).alias("symbols"))
    cost = F.ceil((F.octet_length(F.col("node").cast("string")) + F.octet_length("symbols") + 3) / F.lit(3.5))
    return ranking.within_budget(rows, cost, budget, [F.desc("rank"), "node"])


def file_resolution(files: DataFrame, name: str) -> DataFrame:
    """Files a name means: the same path, else a suffix at a slash, else that in any case; more than one row is ambiguous."""
    low = name.lower()
    level = F.when(F.col("path") == name, 1).when(F.endswith("path", F.lit("/" + name)), 2).when((F.lower("path") == low) | F.endswith(F.lower("path"), F.lit("/" + low)), 3)
    hit = files.withColumn("level", level).where("level is not null")
    best = hit.agg(F.min("level").alias("best"))
    return hit.join(F.broadcast(best), F.col("level") == F.col("best")).select("path", "level")


def dependency_index(files: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Display paths (``@N/`` before paths that repeat across roots) and the first evidence of each pair. ``files``: ``root, path``."""
    many = F.count("*").over(Window.partitionBy("path")) > 1
    shown = files.withColumn("display", F.when(many, F.concat(F.lit("@"), F.col("root").cast("string"), F.lit("/"), F.col("path"))).otherwise(F.col("path")))
    first = edges.groupBy("src", "dst").agg(F.min(F.struct("start_line", "end_line", "evidence")).alias("e")).select("src", "dst", "e.*")
    return shown, first


def knowledge_graph(docs: DataFrame, edges: DataFrame, focus: str | None, limit: int = 40) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges about a focus, or of the whole: ambiguous focus gives the overview.

    Nodes are taken by steps from the focus, then degree, ring and path; edges among them are four times their number at most."""
    from ..functions import text

    degree = catalog.graph_degrees(edges, docs).withColumn("degree", F.col("inbound") + F.col("outbound"))
    rows = docs.join(degree, "doc_id")
    chosen = None
    if focus:
        scored = docs.withColumn("s", text.focus_score(F.col("path"), focus)).where("s is not null").orderBy(F.desc("s"), "path").limit(2).collect()
        if len(scored) == 1 or (len(scored) == 2 and scored[0]["s"] > scored[1]["s"]):
            chosen = scored[0]["doc_id"]
    if chosen is not None:
        known = docs.select("doc_id")
        inner = edges.join(known.withColumnRenamed("doc_id", "from_doc"), "from_doc", "left_semi").join(known.withColumnRenamed("doc_id", "to_doc"), "to_doc", "left_semi")
        levels = bfs(inner.select(F.col("from_doc").alias("src"), F.col("to_doc").alias("dst")), chosen, None, "both", limit).select(F.col("node").alias("doc_id"), "level")
        rows = rows.join(levels, "doc_id")
    else:
        rows = rows.withColumn("level", F.lit(0))
    nodes = _cut(rows.orderBy("level", F.desc("degree"), "ring", "path").limit(limit).select("doc_id", "path", "ring", "inbound", "outbound", "level", text.knowledge_kind(F.col("path")).alias("kind")))
    inside = edges.distinct().join(nodes.select(F.col("doc_id").alias("from_doc")), "from_doc", "left_semi").join(nodes.select(F.col("doc_id").alias("to_doc")), "to_doc", "left_semi")
    return nodes, inside.orderBy("from_doc", "to_doc").limit(4 * limit)
