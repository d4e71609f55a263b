"""Retrieval from query text to a cut list with notes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import catalog, lexical, ranking, vectors


def ranked(blocks: DataFrame, store: DataFrame | None, queries: dict[int, str], limit: int, query_vectors: DataFrame | None = None, hybrid: bool = True, prefixes: list[str] | None = None, reranker=None) -> DataFrame:
    """``query_id, rank, cite, path, ring, snippet, mirrors, note`` of many queries in one plan.

    The slice filters before anything is ranked, on both halves. Without vectors for the queries or in the store the answer is lexical
    and says so; a lexical answer is retrieved twice as wide and gated. ``reranker(hits)`` adds ``model_score``."""
    spark = blocks.sparkSession
    inside = blocks.where(T.under_prefix(F.col("path"), prefixes)) if prefixes else blocks
    notes, semantic = [], None
    if query_vectors is not None and store is not None:
        covered = vectors.coverage(inside, store).first()
        if not covered["reachable"]:
            notes.append("no vectors for these blocks; lexical results")
        else:
            if covered["reachable"] < covered["total"]:
                notes.append(f"vectors cover {covered['reachable']} of {covered['total']} blocks")
            reachable = vectors.block_vectors(inside.select("block_id", "hash"), store).select(F.col("block_id").alias("id"), "v")
            semantic = vectors.search(reachable, query_vectors, max(4 * limit, 20)).select("query_id", "id", "rank")
    else:
        notes.append("no query vectors; lexical results")
    # statistics of all blocks, ranks within the slice
    phrases = lexical.phrase_table(spark, queries)
    scored = lexical.score(blocks, phrases, ("cite", "chain", "path"))
    if prefixes:
        scored = scored.where(T.under_prefix(F.col("path"), prefixes))
    columns = ["query_id", "rank", "block_id", "cite", "path", "ring", "ctx", "chain", "text"]
    if semantic is None:
        hits = lexical.recall(scored, inside, phrases, 2 * limit)
    else:
        lists = [semantic, lexical.rank(scored, max(4 * limit, 20)).select("query_id", F.col("block_id").alias("id"), "rank")] if hybrid else [semantic]
        top = vectors.fuse(lists, 2.0, limit).select("query_id", F.col("id").alias("block_id"), "rank")
        hits = catalog.dedup_mirrors(top.join(inside, "block_id").select(columns), ["query_id"])
    if reranker is not None:
        hits = ranking.rerank(reranker(hits)).drop("rank", "model_score").withColumnRenamed("new_rank", "rank")
    if semantic is None:
        names = spark.createDataFrame(list(queries.items()), "query_id int, query string")
        hits = ranking.gate(hits.join(F.broadcast(names), "query_id"))
    out = hits.where(F.col("rank") <= 2 * limit).select("query_id", "rank", "cite", "path", "ring", T.snippet(F.col("text"), F.col("ctx")).alias("snippet"), F.array_join("mirrors", ",").alias("mirrors"))
    from pyspark.sql import Window

    cut = out.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("rank"))).where(F.col("rank") <= limit)
    return cut.withColumn("note", F.lit("; ".join(notes)))
