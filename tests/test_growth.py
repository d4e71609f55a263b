"""Steps that must not gather a growing table in the driver or in one task."""

import re
from fractions import Fraction

import numpy as np
from pyspark.sql import functions as F

from marginalia.functions import markdown
from marginalia.operators import catalog, lexical, ranking, vectors
from marginalia.plans import registry

registry.load()


def physical(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_imports_do_not_broadcast_paths(spark, data):
    assert "BroadcastHashJoin" not in physical(registry.QUERIES["c3_imports"](spark, data))


def test_vector_search_has_no_join_and_breaks_ties_exactly(spark):
    rng = np.random.default_rng(5)
    codes = rng.integers(-127, 128, (700, 8))
    codes[300:650] = codes[7]  # more equal vectors than the limit
    codes[650:660] = 0
    rows = [(i, [int(x) for x in v]) for i, v in enumerate(codes)] + [(900, None), (901, [1, 2]), (902, [1] * 7 + [None])]
    store = spark.createDataFrame(rows, "id long, v array<int>")
    queries = store.where("id % 20 = 0").selectExpr("cast(id as int) as query_id", "v as q")
    found = vectors.search(store, queries, 12)
    assert "NestedLoop" not in physical(found) and dict(found.dtypes)["query_id"] == "int"
    got = {}
    for r in sorted(found.collect(), key=lambda r: (r["query_id"], r["rank"])):
        got.setdefault(r["query_id"], []).append(r["id"])
    alive = [i for i in range(700) if codes[i].any()]
    for q in range(0, 700, 20):
        d = {i: int(codes[q] @ codes[i]) for i in alive}
        want = sorted(alive, key=lambda i: (-Fraction(d[i] * abs(d[i]), int(codes[i] @ codes[i])), i))[:12]
        assert got[q] == want
    assert [r["id"] for r in vectors.search(store, store.where("id = 901").selectExpr("id as query_id", "v as q"), 12).collect()] == [901]


def test_relevant_pairs_are_counted_and_not_made(spark, data):
    plan = physical(registry.QUERIES["v20_ir_metrics"](spark, data))
    assert "NestedLoop" not in plan and not re.search(r"Join \[label.*NOT \(query_id", plan)
    labels = spark.createDataFrame([(20, 1), (21, 1), (22, 1), (40, 2), (60, None), (23, 2)], "id long, label int")
    ranked = spark.createDataFrame([(20, 22, 1), (20, 23, 2), (20, 21, 3), (40, 20, 1), (60, 20, 1)], "query_id long, doc_id long, rank int")
    qrels = spark.createDataFrame([(20, 21), (20, 22), (40, 23)], "query_id long, doc_id long")
    got = sorted(map(tuple, ranking.label_metrics(ranked, labels, "id % 20 = 0").collect()))
    assert got == sorted(map(tuple, ranking.ir_metrics(ranked, qrels).collect())) and len(got) == 2


def test_recall_folds_before_it_ranks_with_the_same_hits(spark):
    rng = np.random.default_rng(2)
    words = ["license", "thand", "other", "License  thand", "grant"]
    rows = []
    for i in range(400):
        text = " ".join(rng.choice(words, rng.integers(1, 4)))
        rows.append((i, f"p{i % 90}", int(rng.integers(0, 5)), "ab"[i % 2], "en", text, f"r{i % 5}-{'%02x' % (len(text) % 7)}"))
    blocks = spark.createDataFrame(rows, "block_id long, path string, ring int, chain string, ctx string, text string, cite string")
    phrases = lexical.phrase_table(spark, {1: "license thand", 2: "grant", 3: "absent"})
    ranked = lexical.rank(lexical.score(blocks, phrases)).select("query_id", "block_id", "rank")
    old = catalog.reserve_ring_band(catalog.dedup_mirrors(ranked.join(blocks, "block_id"), ["query_id"]), 1, ["query_id"])
    for limit in (1, 3, 50):
        new = lexical.recall(lexical.score(blocks, phrases, ("cite", "chain")), blocks, phrases, limit)
        columns = ["query_id", "rank", "block_id", "chain", "cite", "path", "ring", "ctx", "text", "mirrors"]
        rows_ = lambda df: sorted(tuple(map(str, r)) for r in df.select(columns).collect())
        assert rows_(new) == rows_(old.where(F.col("rank") <= limit))
    assert "[query_id" in physical(new) and physical(new).count("WindowGroupLimit") >= 2


def test_markdown_blocks_come_in_bounded_batches(spark):
    text = "\n\n".join(f"line {i} " + "x" * 2000 for i in range(700))
    docs = spark.createDataFrame([(i, text) for i in range(4)] + [(9, None)], "doc_id long, text string").coalesce(1)
    blocks = markdown.explode_blocks(docs)
    assert blocks.count() == 2800
    plan = physical(blocks)
    assert "MapInArrow" in plan and "MapInPandas" not in plan
    pieces = [b.nbytes for b in markdown.block_batches(iter(docs.toArrow().combine_chunks().to_batches()))]
    assert len(pieces) >= 5 and max(pieces) < 2 * markdown.PIECE_CHARS


def test_private_regions_use_no_data_frames(spark, data):
    plan = physical(registry.QUERIES["p4_p5_private"](spark, data))
    assert "ArrowEvalPython" in plan and markdown.without_private.__module__ == "marginalia.functions.markdown" and not hasattr(markdown, "pd")


def test_symbol_context_parses_once(spark, data):
    plan = physical(registry.QUERIES["c10_j9_j10_symbol_context"](spark, data))
    assert "MapInPandas" not in plan and "WindowGroupLimit" in plan
