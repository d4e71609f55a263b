"""Operator 5, embedding near-dedup by collision-counting projections, and operator 6, exact top-k by columnar branch-and-bound."""

from __future__ import annotations

from math import floor, sqrt

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

PROJECTIONS = 256
MISSES = 0.65
BLOCK_ROWS = 2048
QUERY_BLOCK = 16_384
TOP_K = 20
DIMENSION_BLOCK = 8


def _finite(vector):
    """True where a vector has components, none of them null or non-finite."""
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    return F.coalesce(F.forall(vector, fine), F.lit(False)) & (F.size(vector) > 0)


# ---------------------------------------------------------------- operator 5


def rotation(dim: int, seed: int = 5) -> np.ndarray:
    """Orthonormal directions, min(dim, PROJECTIONS) of them; the same on every executor."""
    q, _ = np.linalg.qr(np.random.default_rng(seed).standard_normal((dim, dim)))
    return q[:, : min(dim, PROJECTIONS)]


def calibrated(threshold: float, projections: int) -> tuple[float, int]:
    """Window and least collision count with recall 1.

    Unit vectors of cosine ``threshold`` or more differ by a vector of squared length ``2 - 2 * threshold`` at most. Along
    orthonormal directions the squared differences sum to no more than that, so at most ``(2 - 2 * threshold) / window**2``
    of them exceed the window: a pair that links collides in all the other projections. The window is the one at which that is
    MISSES of the projections: narrow, so that runs are short, while the count left is far above that of unrelated vectors.
    """
    square = 2 - 2 * threshold
    misses = floor(MISSES * projections)
    return sqrt(square / (misses + 0.25)) + 1e-7, projections - misses


def _linked_block(a: np.ndarray, b: np.ndarray, same: bool, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i, j) of the rows of two blocks with cosine at or over the threshold; within one block, i < j.

    Each projection of the second block is sorted. The window about a query's projection is a run of that order; the collisions of the query are
    counted over the runs of all projections, and only rows that reach the count are verified, in double precision."""
    directions = rotation_cached(a.shape[1])
    window, least = calibrated(threshold, directions.shape[1])
    na, nb = np.linalg.norm(a, axis=1), np.linalg.norm(b, axis=1)
    pa_, pb_ = (a / na[:, None]) @ directions, (b / nb[:, None]) @ directions
    orders = np.ascontiguousarray(np.argsort(pb_, axis=0, kind="stable").T)
    low, high = np.empty(pa_.shape, np.int64), np.empty(pa_.shape, np.int64)
    for k, order in enumerate(orders):
        keys = pb_[order, k]
        low[:, k], high[:, k] = np.searchsorted(keys, pa_[:, k] - window), np.searchsorted(keys, pa_[:, k] + window, side="right")
    left, right = [], []
    for i, (start, stop) in enumerate(zip(low.tolist(), high.tolist(), strict=True)):
        hits = np.bincount(np.concatenate([order[x:y] for order, x, y in zip(orders, start, stop, strict=True)]), minlength=len(b))
        j = np.flatnonzero(hits >= least)
        j = j[j > i] if same else j
        if len(j):
            cosine = (b[j] @ a[i]) / (nb[j] * na[i])
            j = j[cosine >= threshold]
            left.append(np.full(len(j), i))
            right.append(j)
    return (np.concatenate(left), np.concatenate(right)) if left else (np.zeros(0, int), np.zeros(0, int))


def _roots(n: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for x, y in zip(left.tolist(), right.tolist(), strict=True):
        x, y = find(x), find(y)
        if x != y:
            parent[max(x, y)] = min(x, y)
    return np.array([find(x) for x in range(n)])


def _to_blocks(classes: DataFrame, partitions: int) -> DataFrame:
    """Rows sorted by label, dimension and first projection, packed to blocks of BLOCK_ROWS at most."""
    schema = "label long, dim long, block long, low double, high double, ids binary, counts binary, rows binary"

    def project(batches):
        for batch in batches:
            first = [float(rotation_cached(len(v))[:, 0] @ (v / np.linalg.norm(v))) for v in (np.asarray(x, np.float64) for x in batch.column("embedding").to_pylist())]
            yield batch.append_column("first", pa.array(first, pa.float64()))

    def pack(batches):
        from pyspark import TaskContext

        held, number = [], TaskContext.get().partitionId() << 32

        def block(rows):
            nonlocal number
            number += 1
            return [rows[0][0], rows[0][1], number, rows[0][2], rows[-1][2], np.array([r[3] for r in rows], np.int64).tobytes(), np.array([r[4] for r in rows], np.int64).tobytes(), np.array([r[5] for r in rows], np.float64).tobytes()]

        def out(blocks):
            return pa.RecordBatch.from_pylist([dict(zip(("label", "dim", "block", "low", "high", "ids", "counts", "rows"), b, strict=True)) for b in blocks], schema=pa.schema([("label", pa.int64()), ("dim", pa.int64()), ("block", pa.int64()), ("low", pa.float64()), ("high", pa.float64()), ("ids", pa.binary()), ("counts", pa.binary()), ("rows", pa.binary())]))

        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("label", "dim", "first", "rep", "copies", "embedding")), strict=True):
                if held and (row[:2] != held[0][:2] or len(held) >= BLOCK_ROWS):
                    yield out([block(held)])
                    held = []
                held.append(row)
        if held:
            yield out([block(held)])

    columns = ["label", "dim", "rep", "copies", "embedding"]
    named = classes.withColumn("dim", F.size("embedding").cast("long")).withColumn("label", F.col("label").cast("long")).withColumn("embedding", F.col("embedding").cast("array<double>")).select(columns)
    projected = named.mapInArrow(project, "label long, dim long, rep long, copies long, embedding array<double>, first double")
    dealt = projected.repartitionByRange(partitions, "label", "dim", "first").sortWithinPartitions("label", "dim", "first", "rep")
    return dealt.mapInArrow(pack, schema)


_rotations: dict[int, np.ndarray] = {}


def rotation_cached(dim: int) -> np.ndarray:
    if dim not in _rotations:
        _rotations[dim] = rotation(dim)
    return _rotations[dim]


def near_vectors(vectors: DataFrame, threshold: float = 0.98) -> DataFrame:
    """One row per row of ``vectors(vec_id, embedding, label)``: ``vec_id, n_links, component_id, kept``.

    Equal vectors of a label are one class, so a hot vector is one row. Classes are sorted by label and first projection and cut into
    blocks; two blocks of a label meet only when their intervals are within the largest distance of a link. Within a
    pair of blocks links are counted per vector and leave as counts and one edge to a root, never as pairs.

    Defined results: null label, or a vector that is null, empty, zero or holds null or non-finite components: no links; vectors of different
    length don't link; repeated rows are separate vectors that link with each other and share their id's component; null
    vec_id: no links, component and kept null; an empty table gives no rows; other columns are ignored.
    """
    spark = vectors.sparkSession
    base = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding", F.col("label").cast("long").alias("label"))
    fine = base.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & _finite(F.col("embedding"))).where(F.exists("embedding", lambda x: x != 0))
    # the same vector written with -0.0 is the same class
    fine = fine.withColumn("embedding", F.transform("embedding", lambda x: x + F.lit(0).cast("float"))).withColumn("h1", F.xxhash64("embedding")).withColumn("h2", F.xxhash64(F.lit(0x5EED), "embedding"))
    classes, _ = common.materialize(spark, fine.groupBy("label", "h1", "h2", "embedding").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies")), "vector-classes")
    partitions = max(1, min(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-classes.count() // BLOCK_ROWS)))
    blocks, _ = common.materialize(spark, _to_blocks(classes, partitions), "vector-blocks")

    reach = sqrt(2 - 2 * threshold) + 1e-6
    meta = blocks.select("label", "dim", "block", "low", "high")
    left, right = (meta.select("label", "dim", F.col("block").alias(f"block_{s}"), F.col("low").alias(f"low_{s}"), F.col("high").alias(f"high_{s}")) for s in "ab")
    meet = left.join(right, ["label", "dim"]).where("block_a <= block_b").where((F.col("low_b") <= F.col("high_a") + reach) & (F.col("low_a") <= F.col("high_b") + reach)).select("dim", "block_a", "block_b")
    payload = lambda s: blocks.select(F.col("block").alias(f"block_{s}"), *(F.col(c).alias(f"{c}_{s}") for c in ("ids", "counts", "rows")))
    pairs = meet.repartition("block_a", "block_b").join(payload("a"), "block_a").join(payload("b"), "block_b")

    def link(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                row = {c: batch.column(c)[k].as_py() for c in batch.schema.names}
                same = row["block_a"] == row["block_b"]
                ids_a, ids_b = (np.frombuffer(row[f"ids_{s}"], np.int64) for s in "ab")
                n_a, n_b = (np.frombuffer(row[f"counts_{s}"], np.int64) for s in "ab")
                a, b = (np.frombuffer(row[f"rows_{s}"], np.float64).reshape(-1, row["dim"]) for s in "ab")
                i, j = _linked_block(a, b, same, threshold)
                ids = ids_a if same else np.concatenate([ids_a, ids_b])
                shift = 0 if same else len(a)
                links = np.bincount(i, weights=n_b[j], minlength=len(ids)) + np.bincount(j + shift, weights=n_a[i], minlength=len(ids))
                root = _roots(len(ids), i, j + shift)
                at = np.flatnonzero(links)
                yield pa.RecordBatch.from_arrays([pa.array(ids[at]), pa.array(ids[root[at]]), pa.array(links[at].astype(np.int64))], names=["rep", "root", "links"])

    # two large payloads a row: few rows a batch
    counted, _ = common.materialize(spark, pairs.mapInArrow(link, "rep long, root long, links long"), "vector-links")
    per_class = counted.groupBy("rep").agg(F.sum("links").alias("links"))
    # classes of one id (repeated rows) share its node; copies point to their representative
    member = fine.select("vec_id", "label", "h1", "h2").join(classes.select("label", "h1", "h2", "rep", "copies"), ["label", "h1", "h2"])
    edges = counted.select(F.col("rep").alias("a"), F.col("root").alias("b")).unionByName(member.where("vec_id <> rep").select(F.col("rep").alias("a"), F.col("vec_id").alias("b")))
    comp = common.components(spark, edges)
    own = member.join(per_class, "rep", "left").select("vec_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    usable = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & _finite(F.col("embedding")) & F.coalesce(F.exists("embedding", lambda x: x != 0), F.lit(False))
    isolated = base.where(~F.coalesce(usable, F.lit(False))).select("vec_id", F.lit(0).cast("long").alias("n_links"))
    return (
        own.unionByName(isolated)
        .join(comp.withColumnRenamed("node", "vec_id"), "vec_id", "left")
        .select("vec_id", "n_links", F.coalesce("component", "vec_id").alias("component_id"))
        .withColumn("kept", F.col("vec_id") == F.col("component_id"))
    )


def op5_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(common.table(spark, sf_dir, "embeddings"))


# ---------------------------------------------------------------- operator 6


class _Best:
    """The k best (score, smallest id) of each query so far, merged chunk by chunk."""

    def __init__(self, queries: int, k: int):
        self.score = [np.zeros(0, np.int64)] * queries
        self.ids = [np.zeros(0, np.int64)] * queries
        self.k, self.floor = k, np.full(queries, -np.inf)

    def add(self, q: int, score: np.ndarray, ids: np.ndarray) -> None:
        score, ids = np.concatenate([self.score[q], score]), np.concatenate([self.ids[q], ids])
        if len(score) > self.k:
            cut = np.partition(score, len(score) - self.k)[len(score) - self.k]
            near = np.flatnonzero(score >= cut)
            near = near[np.lexsort((ids[near], -score[near]))][: self.k]
            score, ids = score[near], ids[near]
        self.score[q], self.ids[q] = score, ids
        if len(score) == self.k:
            self.floor[q] = score.min()


def search_chunk(best: _Best, q: int, query: np.ndarray, query_id: int, columns: np.ndarray, squares: np.ndarray, mass: np.ndarray, ids: np.ndarray) -> None:
    """Branch and bound over one chunk in vertical layout: ``columns[d]`` holds dimension d of all candidates.

    Dimensions go in order of the query's magnitude. After each block of them a candidate can gain at most the product of what is left of both
    norms; candidates whose bound stays below the k-th best score go, and the survivors are compacted. A bound equal
    to that score survives, so ties are decided by id. All quantities are integers below 2**53, held exactly in doubles."""
    order = np.argsort(-np.abs(query), kind="stable")
    left = float(query @ query)
    floor_ = best.floor[q]
    score, rest, alive = np.zeros(len(ids)), mass, None
    for at in range(0, len(order), DIMENSION_BLOCK):
        dims = order[at : at + DIMENSION_BLOCK]
        block = columns[dims] if alive is None else columns[np.ix_(dims, alive)]
        score = score + query[dims] @ block
        left -= float(query[dims] @ query[dims])
        if left <= 0:  # the query is zero from here on
            break
        if floor_ > -np.inf and at + DIMENSION_BLOCK < len(order):
            rest = rest - (squares[dims].sum(0) if alive is None else np.square(block).sum(0))
            stay = np.flatnonzero(score + np.sqrt(np.maximum(rest, 0) * left) + 1e-3 >= floor_)
            if len(stay) < 0.7 * len(score):
                alive = stay if alive is None else alive[stay]
                score, rest = score[stay], rest[stay]
                if not len(alive):
                    return
    found = ids if alive is None else ids[alive]
    keep = (score >= floor_) & (found != query_id)
    if keep.any():
        best.add(q, score[keep].astype(np.int64), found[keep])


def top_k(vectors: DataFrame, is_query, k: int = TOP_K, scale: int = 64, query_block: int = QUERY_BLOCK) -> DataFrame:
    """``query_id, rank, vec_id, score``: the k largest integer inner products of each query row against all rows but its own.

    Queries go in blocks of about ``query_block`` rows, dealt by hash of their id: one block at a time is held by the driver and broadcast,
    whatever the number of queries; each task keeps the k best of each of its queries, and those meet in a grouped top-k.

    Defined results: vectors that are null, empty or hold null or non-finite components take no part, nor do rows with null vec_id; vectors of
    different length are not compared; a repeated id is a candidate once a row, never of its own id, and as a query the row with
    the smallest vector counts; an empty table gives no rows; other columns are ignored.
    """
    spark = vectors.sparkSession
    whole = F.transform("embedding", lambda x: F.floor(F.lit(float(scale)) * x.cast("double")))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").where(F.col("vec_id").isNotNull() & _finite(F.col("embedding"))).select("vec_id", whole.alias("v"))
    queries = rows.where(is_query).groupBy("vec_id").agg(F.min("v").alias("v"))
    rounds = max(1, -(-queries.count() // query_block))
    queries = queries.withColumn("round", F.pmod(F.xxhash64("vec_id"), F.lit(rounds)))
    parts = [_search_round(spark, rows, queries.where(F.col("round") == r).select("vec_id", "v"), k) for r in range(rounds)]
    found = parts[0]
    for part in parts[1:]:
        found = found.unionByName(part)
    from pyspark.sql import Window

    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("vec_id"))))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _search_round(spark: SparkSession, rows: DataFrame, block: DataFrame, k: int) -> DataFrame:
    by_dim: dict[int, list] = {}
    for r in block.collect():  # one bounded block of queries
        by_dim.setdefault(len(r["v"]), []).append((r["vec_id"], r["v"]))
    held = spark.sparkContext.broadcast({d: (np.array([i for i, _ in q], np.int64), np.array([v for _, v in q], np.float64)) for d, q in by_dim.items()})

    def run(batches):
        best = {d: _Best(len(ids), k) for d, (ids, _) in held.value.items()}
        for batch in batches:
            ids, column = batch.column("vec_id").to_numpy(), batch.column("v")
            length = pa.compute.list_value_length(column).to_numpy()
            for d, (query_ids, queries) in held.value.items():
                at = np.flatnonzero(length == d)
                if not len(at):
                    continue
                flat = column.take(pa.array(at)).flatten().to_numpy().astype(np.float64).reshape(-1, d)
                columns = np.ascontiguousarray(flat.T)
                squares = np.square(columns)
                mass, own = squares.sum(0), ids[at]
                for q in range(len(query_ids)):
                    search_chunk(best[d], q, queries[q], int(query_ids[q]), columns, squares, mass, own)
        for d, (query_ids, _) in held.value.items():
            for a in range(0, len(query_ids), 1024):
                n = range(a, min(a + 1024, len(query_ids)))
                sizes = [len(best[d].ids[q]) for q in n]
                if sum(sizes):
                    yield pa.RecordBatch.from_arrays([pa.array(np.repeat(query_ids[list(n)], sizes)), pa.array(np.concatenate([best[d].ids[q] for q in n])), pa.array(np.concatenate([best[d].score[q] for q in n]))], names=["query_id", "vec_id", "score"])

    return rows.mapInArrow(run, "query_id long, vec_id long, score long")


def op6_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(common.table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


OP6_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM p)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 20
"""

OP5_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
  AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
n AS (SELECT *, sqrt(list_dot_product(e, e)) AS norm FROM v),
l AS (SELECT a.vec_id AS x, b.vec_id AS y FROM n a JOIN n b ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE list_dot_product(a.e, b.e) / (a.norm * b.norm) >= 0.98),
c(x, y) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT c.x, l.y FROM c JOIN l ON c.y = l.x),
m AS (SELECT x AS vec_id, min(y) AS component_id FROM c GROUP BY x),
k AS (SELECT x AS vec_id, count(*) AS n_links FROM l GROUP BY x)
SELECT m.vec_id, coalesce(n_links, 0) AS n_links, component_id, m.vec_id = component_id AS kept FROM m LEFT JOIN k USING (vec_id)
"""
