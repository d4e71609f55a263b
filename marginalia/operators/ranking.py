"""What happens to ranked lists: gate, rerank, budgets, metrics, find."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text


def gate(hits: DataFrame, least: int = 2) -> DataFrame:
    """Keep hits whose text covers enough content terms of the query; where all are refused, the best stays.

    ``hits``: ``query_id, query, text, rank``; adds ``covered``."""
    terms = text.content_terms(F.col("query"))
    marked = hits.withColumn("covered", text.covered_terms(terms, text.gate_words(F.col("text"))))
    marked = marked.withColumn("_ok", F.col("covered") >= F.least(F.lit(least), F.size(terms)))
    w = Window.partitionBy("query_id")
    best = F.row_number().over(w.orderBy("rank")) == 1
    marked = marked.withColumn("_any", F.max(F.col("_ok").cast("int")).over(w) == 1).withColumn("_best", best)
    return marked.where(F.col("_ok") | (~F.col("_any") & F.col("_best"))).drop("_ok", "_any", "_best")


def rerank(hits: DataFrame, candidates: int = 40) -> DataFrame:
    """The first ``candidates`` of each query by ``model_score``, equals in their order; the tail behind them as it was."""
    head = F.col("rank") <= candidates
    order = Window.partitionBy("query_id").orderBy(~head, F.desc(F.when(head, F.col("model_score"))), "rank")
    return hits.withColumn("new_rank", F.row_number().over(order))


def placement_faults(scores: DataFrame, documents: int) -> DataFrame:
    """One row per query whose scores don't name each document exactly once."""
    out = scores.groupBy("query_id").agg(F.count("*").alias("n"), F.count_distinct("doc_index").alias("d"), F.min("doc_index").alias("lo"), F.max("doc_index").alias("hi"), F.count("score").alias("s"))
    return out.where((F.col("n") != documents) | (F.col("d") != documents) | (F.col("lo") != 0) | (F.col("hi") != documents - 1) | (F.col("s") != documents))


def within_budget(rows: DataFrame, cost: Column, budget: int, order: list, partition: list | None = None) -> DataFrame:
    """Ranked prefix whose running cost fits, at least one row; 0 is no limit. Adds ``spent`` and ``dropped``."""
    w = Window.partitionBy(*(partition or [F.lit(0)]))
    ordered = w.orderBy(*order)
    out = rows.withColumn("spent", F.sum(cost).over(ordered.rowsBetween(Window.unboundedPreceding, 0))).withColumn("_n", F.row_number().over(ordered))
    keep = (F.col("spent") <= budget) | (F.col("_n") == 1) if budget else F.lit(True)
    return out.withColumn("_k", keep).withColumn("dropped", F.sum((~F.col("_k")).cast("long")).over(w)).where("_k").drop("_k", "_n")


def clip_lines(body: Column, chars: int) -> Column:
    """The lines that fit whole, at least the first piece."""
    cut = F.substring(body, 1, chars)
    return F.when(F.char_length(body) <= chars, body).when(F.instr(cut, "\n") > 0, F.regexp_replace(cut, r"\n[^\n]*\z", "")).otherwise(cut)


def clip_tokens(body: Column, budget: int) -> tuple[Column, Column]:
    """The text that fits a budget of tokens, 0 being no limit, and the tokens left out: up to the last line end that fits, or else the last whole character."""
    if not budget:
        return body, F.lit(0).cast("long")
    raw = F.encode(body, "utf-8")
    cut = F.coalesce(*(F.when(F.is_valid_utf8(part), part) for k in range(4) for part in [F.substring(raw, 1, int(budget * 3.5) - k).cast("string")]))
    whole = F.when(F.instr(cut, "\n") > 0, F.regexp_replace(cut, r"\n[^\n]*\z", "")).otherwise(cut)
    fits = text.token_estimate(body) <= budget
    left = F.ceil((F.octet_length(body) - F.octet_length(whole)) / F.lit(3.5)).cast("long")
    return F.when(fits, body).otherwise(whole), F.when(fits, F.lit(0).cast("long")).otherwise(left)


def shared_budget(rows: DataFrame, cost: str, budget: int, partition: list[str], order: str) -> DataFrame:
    """One budget over several entries in order: each takes what it wants of what is left. Entries of one answer only are folded together."""
    entries = F.array_sort(F.collect_list(F.struct(order, cost)))
    start = F.struct(F.lit(budget).cast("long").alias("left"), F.array().cast("array<struct<o: bigint, granted: bigint>>").alias("out"))
    step = lambda s, x: F.struct((s["left"] - F.least(s["left"], x[cost])).alias("left"), F.concat(s["out"], F.array(F.struct(x[order].cast("long").alias("o"), F.least(s["left"], x[cost]).cast("long").alias("granted")))).alias("out"))
    folded = rows.groupBy(*partition).agg(F.aggregate(entries, start, step).alias("s"))
    return folded.select(*partition, F.explode("s.out").alias("e")).select(*partition, F.col("e.o").alias(order), "e.granted")


def capped_events(rows: DataFrame, partition: list[str], order: str, size: str, most: int = 96, bytes_: int = 128 << 10) -> DataFrame:
    """Events in order while they fit; one that is too large is skipped and later ones are still tried."""
    entries = F.array_sort(F.collect_list(F.struct(order, size)))
    start = F.struct(F.lit(0).cast("long").alias("used"), F.array().cast("array<bigint>").alias("out"))
    fits = lambda s, x: (s["used"] + x[size] <= bytes_) & (F.size(s["out"]) < most)
    step = lambda s, x: F.when(fits(s, x), F.struct((s["used"] + x[size]).cast("long").alias("used"), F.concat(s["out"], F.array(x[order].cast("long"))).alias("out"))).otherwise(s)
    return rows.groupBy(*partition).agg(F.aggregate(entries, start, step).alias("s")).select(*partition, F.explode("s.out").alias(order))


def ir_metrics(ranked: DataFrame, qrels: DataFrame, k: int = 10, deep: int = 100) -> DataFrame:
    """``query_id, ndcg, recall, mrr`` with binary relevance: at ``k``, ``deep`` and ``k``."""
    rel = qrels.groupBy("query_id").agg(F.count("*").alias("n_rel"))
    return hit_metrics(ranked.join(qrels.select("query_id", "doc_id"), ["query_id", "doc_id"], "left_semi"), rel, k, deep)


def label_metrics(ranked: DataFrame, labels: DataFrame, is_query: Column | str, k: int = 10, deep: int = 100) -> DataFrame:
    """``ir_metrics`` where the documents of a query's own label, itself left out, are relevant. ``labels``: ``id, label``.

    The pairs of a query and a relevant document grow with the square of a label's size and are not made: they are counted by label, and a hit is one whose label agrees."""
    once = labels.where("label is not null").groupBy("id", "label").agg(F.count("*").alias("own"))
    asked = once.where(is_query).withColumnRenamed("id", "query_id")
    sizes = once.groupBy("label").agg(F.sum("own").alias("n"))
    rel = asked.join(sizes, "label").groupBy("query_id").agg(F.sum(F.col("own") * (F.col("n") - F.col("own"))).alias("n_rel")).where("n_rel > 0")
    found = ranked.where("query_id <> doc_id").join(asked.select("query_id", "label").hint("merge"), "query_id")
    hit = found.join(once.select(F.col("id").alias("doc_id"), "label").hint("merge"), ["doc_id", "label"], "left_semi")
    return hit_metrics(hit, rel, k, deep)


def hit_metrics(hit: DataFrame, rel: DataFrame, k: int = 10, deep: int = 100) -> DataFrame:
    """``ir_metrics`` of the ranked documents that are relevant and of the number ``n_rel`` of relevant ones of each query."""
    gains = hit.groupBy("query_id").agg(
        F.sum(F.when(F.col("rank") <= k, 1 / F.log2(F.col("rank") + 1))).alias("dcg"),
        F.sum(F.when(F.col("rank") <= deep, 1)).alias("found"),
        F.min(F.when(F.col("rank") <= k, F.col("rank"))).alias("first"),
    )
    ideal = F.aggregate(F.sequence(F.lit(1), F.least("n_rel", F.lit(k)).cast("int")), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1))
    out = rel.join(gains, "query_id", "left")
    return out.select("query_id", F.round(F.coalesce("dcg", F.lit(0.0)) / ideal, 6).alias("ndcg"), F.round(F.coalesce("found", F.lit(0)) / F.col("n_rel"), 6).alias("recall"), F.round(F.coalesce(1 / F.col("first"), F.lit(0.0)), 6).alias("mrr"))


def find(symbols: DataFrame, files: DataFrame, query: str, limit: int = 20) -> DataFrame:
    """Best names: symbols 100/60/30 and files 50/25/10 for equal, prefix, substring, plus a quarter of the rank percentile in tens."""
    q = "".join(c for c in query.lower() if c.isascii() and c.isalnum())

    def scored(rows: DataFrame, name: Column, points: tuple[int, int, int]) -> DataFrame:
        p = F.when(name == q, points[0]).when(F.startswith(name, F.lit(q)), points[1]).when(F.contains(name, F.lit(q)), points[2])
        found = rows.withColumn("points", p).where("points is not null").withColumn("score", F.round(F.col("points") + F.coalesce("rank_pct", F.lit(0.0)) / 25, 6))
        return found.select("kind", "name", "path", "score").orderBy(F.desc("score"), "path", "name").limit(limit)

    s = scored(symbols.withColumn("kind", F.lit("symbol")), text.identifier(F.col("name")), (100, 60, 30))
    f = scored(files.withColumn("kind", F.lit("file")).withColumn("name", F.col("path")), text.norm_stem(F.col("path")), (50, 25, 10))
    return s.unionByName(f).orderBy(F.desc("score"), "path", "name").limit(limit)


def water_fill(entries: list[tuple[int, float]], usable: int) -> list[int]:
    """Share a budget by weight; what a small entry leaves goes round again; the last round clips.

    Entries are the few sections of one digest, so this runs in the driver or within one group."""
    got, open_, pool = [0] * len(entries), list(range(len(entries))), usable
    while open_ and pool and (total := sum(entries[i][1] for i in open_)) > 0:
        shares = {i: int(pool * entries[i][1] / total) for i in open_}
        done = [i for i in open_ if shares[i] >= entries[i][0] - got[i]]
        for i in open_:
            take = min(shares[i], entries[i][0] - got[i], pool)
            got[i] += take
            pool -= take
        open_ = [i for i in open_ if got[i] < entries[i][0]]
        if not done:
            break
    return got


def demote(entries: list[tuple[str, int, float, bool]], usable: int, index_cost: int = 80) -> tuple[list[str], dict[str, int]]:
    """Entries (name, wants, weight, pinned) that would be clipped go to the index, lightest first, then largest; the rest is allocated anew."""
    live, indexed = list(entries), []
    while True:
        granted = water_fill([(w, weight) for _, w, weight, _ in live], max(0, usable - index_cost * len(indexed)))
        clipped = [e for e, g in zip(live, granted, strict=True) if g < e[1] and not e[3]]
        if not clipped:
            return indexed, {e[0]: g for e, g in zip(live, granted, strict=True)}
        out = min(clipped, key=lambda e: (e[2], -e[1], e[0]))
        live.remove(out)
        indexed.append(out[0])
