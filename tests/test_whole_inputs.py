"""Queries without SQL see the whole of their tables."""

import numpy as np

from marginalia.operators import graph
from marginalia.plans import registry
from tests.compare import connect

registry.load()


def test_repo_map_ranks_by_all_edges(spark, data):
    pairs = connect(data).sql("SELECT c_nationkey, s_nationkey FROM orders JOIN lineitem ON o_orderkey = l_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey WHERE c_nationkey <> s_nationkey").fetchall()
    w = np.zeros((25, 25))
    for a, b in pairs:
        w[a, b] += 1
    exits = w.sum(1)
    share = np.divide(w, exits[:, None], out=np.zeros_like(w), where=exits[:, None] > 0)
    rank = np.full(25, 1 / 25)
    for _ in range(30):
        rank = (0.15 + 0.85 * rank[exits == 0].sum()) / 25 + 0.85 * (rank @ share)
    got = {r["node"]: r["rank"] for r in registry.QUERIES["c14_t6_repo_map"](spark, data).collect()}
    assert got and all(abs(rank[n] - x) < 1e-8 for n, x in got.items())


def test_focused_graph_links_every_document(spark, tmp_path):
    n = 300
    spark.createDataFrame([(i, "t", "en", "src1") for i in range(n)], "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 0, 35), (3, 245, 280)], "l_orderkey long, l_partkey long, l_suppkey long").write.parquet(f"{tmp_path}/lineitem.parquet")
    got = {(r["from_doc"], r["to_doc"]) for r in registry.QUERIES["c16_focused_graph"](spark, str(tmp_path)).collect()}
    assert got == {(0, 245), (245, 160)}


def test_embed_batches_takes_every_line(spark, data):
    from marginalia.plans import base

    got = {r["hash"] for r in registry.QUERIES["v15_embed_batches"](spark, data).collect()}
    assert got == {r["hash"] for r in base.blocks(spark, data).select("hash").distinct().collect()}


def test_focused_graph_has_no_depth_bound(spark):
    docs = spark.createDataFrame([(i, f"src/d{i}.md", 1) for i in range(12)], "doc_id long, path string, ring int")
    chain = spark.createDataFrame([(i, i + 1) for i in range(9)] + [(0, 99), (99, 10)], "from_doc long, to_doc long")  # 99 is no document
    nodes = {r["doc_id"]: r["level"] for r in graph.knowledge_graph(docs, chain, "d0", 40)[0].collect()}
    assert nodes == {i: i for i in range(10)}
    assert {r["doc_id"] for r in graph.knowledge_graph(docs, chain, "d0", 7)[0].collect()} == set(range(7))
