"""Dense vectors: normalising, INT8 codes, exact cosine order, fusion and the bookkeeping of a vector store."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

EPSILON = 1e-6

QUERY_BLOCK = 16_384
#: Queries and vectors that meet in one product of matrices, and pairs whose exact product is taken at once.
QUERY_CHUNK, VECTOR_CHUNK, PAIRS = 512, 2_048, 16_384
#: Stands for a null id, which Spark orders first too.
NO_ID = -(1 << 63)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def normalised(v: Column) -> Column:
    """Unit length; a zero vector stays."""
    return F.when(norm(v) > 0, F.transform(v, lambda x: x / norm(v))).otherwise(F.transform(v, lambda x: x.cast("double")))


def quantised(v: Column) -> Column:
    """INT8 codes: the largest magnitude becomes 127, ties round to even; computed in single precision."""
    top = F.array_max(F.transform(v, lambda x: F.abs(x.cast("float"))))
    scale = F.when(top > 0, top).otherwise(F.lit(1.0).cast("float"))
    # the scale is bound as the one element of an array: within the inner function it would be sought again for each component
    return F.get(F.transform(F.array(scale), lambda s: F.transform(v, lambda x: F.greatest(F.lit(-127), F.least(F.lit(127), F.rint(((x.cast("float") / s).cast("float") * F.lit(127).cast("float")).cast("float").cast("double")).cast("int"))))), F.lit(0))


def int_dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x * y).cast("long")), F.lit(0).cast("long"), lambda s, x: s + x)


def exact_key(dot_: Column, norm_sq: Column) -> Column:
    """Orders by exact cosine of integer vectors: sign, then dot squared over the other norm squared, as a decimal."""
    q = ((dot_ * dot_).cast("decimal(24,9)") / norm_sq.cast("decimal(8,0)"))
    return F.when(dot_ < 0, -q).otherwise(q)


def degenerate(v: Column) -> Column:
    """Why a vector can't be stored, or null."""
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    return F.when(v.isNull() | (F.size(v) == 0), "empty").when(bad, "non-finite").when(norm(v) < EPSILON, "zero")


def _by_width(ids, column) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Ids and vectors as the rows of a matrix, by width; null and empty vectors and those with a null component are left out. A null id is NO_ID."""
    import pyarrow.compute as pc

    length = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).copy()
    flat = column.flatten()
    if flat.null_count:
        length[np.unique(pc.list_parent_indices(column).to_numpy()[flat.is_null().to_numpy(zero_copy_only=False)])] = 0
    ids = pc.fill_null(ids.cast(pa.int64()), NO_ID).to_numpy()
    found = {}
    for width in np.unique(length[length > 0]).tolist():
        at = np.flatnonzero(length == width)
        found[width] = ids[at], column.take(pa.array(at)).flatten().to_numpy().astype(np.float64).reshape(-1, width)
    return found


def _units(m: np.ndarray) -> np.ndarray:
    length = np.sqrt(np.square(m).sum(1))
    return (m / np.where(length > 0, length, 1.0)[:, None]).astype(np.float32)


class _Top:
    """The best candidates of a chunk of queries among the vectors seen so far, all that may still win by exact order and no more.

    Cosines in single precision pick who is looked at, with a margin above twice their error; the exact product then decides: integers for codes,
    for floats the sum in order of the dimensions, as ``dot`` has it. Floats are rounded by Spark, so what lies within two steps of the last one
    stays, and of equal products the first ``limit`` ids."""

    def __init__(self, ids: np.ndarray, queries: np.ndarray, limit: int, exact: bool):
        self.ids, self.queries, self.limit, self.exact = ids, queries, limit, exact
        self.units, self.floor = _units(queries), np.full(len(ids), -np.inf)
        self.margin = (queries.shape[1] + 8) * 4.8e-7
        self.found = [np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0), np.empty(0)]  # query's place, id, product, norm squared or norm
        self.fresh: list[list[np.ndarray]] = []

    def add(self, ids: np.ndarray, rows: np.ndarray, units: np.ndarray, sizes: np.ndarray) -> None:
        near = self.units @ units.T
        if near.shape[1] > self.limit and np.isneginf(self.floor).any():
            self.floor = np.maximum(self.floor, np.partition(near, -self.limit, axis=1)[:, -self.limit].astype(np.float64) - self.margin)
        place, at = np.nonzero(near >= self.floor.astype(np.float32)[:, None])
        for k in range(0, len(place), PAIRS):
            p, c = place[k : k + PAIRS], at[k : k + PAIRS]
            product = np.zeros(len(p))
            for x, y in zip(self.queries[p].T, rows[c].T, strict=True):
                product += x * y
            self.fresh.append([p, ids[c], product, sizes[c]])
        if sum(len(x[0]) for x in self.fresh) >= self.limit * len(self.ids):
            self.compact()

    def compact(self) -> None:
        place, ids, product, sizes = (np.concatenate([self.found[i], *(x[i] for x in self.fresh)]) for i in range(4))
        self.fresh = []
        if self.exact:  # as SQL has it: the sign, then the floor of product squared * 10^18 / norm squared, here in two halves
            d, n = product.astype(np.int64), sizes.astype(np.int64)
            high, rest = np.divmod(d * d, n)
            tens, rest = np.divmod(rest * 10**9, n)
            low = tens * 10**9 + rest * 10**9 // n
            sign = np.where(d < 0, -1, 1)
            order = np.lexsort((ids, -sign * low, -sign * high, place))
        else:
            cosine = product / (self.norms[place] * sizes)
            order = np.lexsort((ids, -cosine, place))
        place, ids, product, sizes = place[order], ids[order], product[order], sizes[order]
        if not self.exact:
            cosine = cosine[order]
            stay = _within((np.diff(place) != 0) | (np.diff(cosine) != 0)) < self.limit
            place, ids, product, sizes, cosine = place[stay], ids[stay], product[stay], sizes[stay], cosine[stay]
        rank = _within(np.diff(place) != 0)
        last = np.flatnonzero(rank == self.limit - 1)
        if self.exact:
            stay = rank < self.limit
            length = self.norms[place[last]] * np.sqrt(sizes[last])
            self.floor[place[last]] = product[last] / np.where(length > 0, length, 1.0) - self.margin
        else:
            least = np.full(len(self.ids), -np.inf)
            least[place[last]] = cosine[last] - 2e-12
            stay = cosine >= least[place]
            self.floor[place[last]] = least[place[last]] - self.margin
        self.found = [place[stay], ids[stay], product[stay], sizes[stay]]

    @property
    def norms(self) -> np.ndarray:
        if not hasattr(self, "_norms"):
            self._norms = np.sqrt(_squares(self.queries))
        return self._norms

    def rows(self, names: list[str]) -> pa.RecordBatch:
        self.compact()
        place, ids, product, sizes = self.found
        d = pa.array(product.astype(np.int64)) if self.exact else pa.array(product / (self.norms[place] * sizes))
        n2 = pa.array(sizes.astype(np.int64) if self.exact else np.ones(len(sizes), np.int64))
        return pa.RecordBatch.from_arrays([pa.array(self.ids[place]), pa.array(ids, mask=ids == NO_ID), d, n2], names=names)


def _within(steps: np.ndarray) -> np.ndarray:
    """Place of each row in its group, where ``steps`` marks the rows after the first that begin one."""
    begins = np.concatenate([[0], np.flatnonzero(steps) + 1])
    n = len(steps) + 1
    return np.arange(n) - np.repeat(begins, np.diff(np.concatenate([begins, [n]])))


def _squares(m: np.ndarray) -> np.ndarray:
    """Squared norms, summed in order of the dimensions."""
    total = np.zeros(len(m))
    for x in m.T:
        total += x * x
    return total


def search(vectors: DataFrame, queries: DataFrame, limit: int, exact: bool = True) -> DataFrame:
    """``query_id, id, d, n2, key, rank`` by cosine of the stored codes; ids are whole numbers. Every query meets every vector: that is quadratic, and dealt to all cores.

    ``queries(query_id, q)`` go in blocks of about QUERY_BLOCK, each of them held by the driver and broadcast for one pass over the store. A task keeps the best of each of its
    queries, and those alone are shuffled: as many rows as cores times queries times ``limit``, whatever the store's size. Widths must agree; zero codes are left out,
    and of floats all vectors that are zero or not finite."""
    spark = vectors.sparkSession
    rounds = max(1, -(-queries.count() // QUERY_BLOCK))
    blocks = [queries.where(F.pmod(F.xxhash64("query_id"), F.lit(rounds)) == r) for r in range(rounds)] if rounds > 1 else [queries]
    store = vectors.select("id", "v").repartition(spark.sparkContext.defaultParallelism)
    found = None
    for block in blocks:
        part = _search_block(spark, store, block, limit, exact)
        found = part if found is None else found.unionByName(part)
    key = exact_key(F.col("d"), F.col("n2")) if exact else F.round("d", 12)
    order = Window.partitionBy("query_id").orderBy(F.desc("key"), "id")
    found = found.select(F.col("query_id").cast(queries.schema["query_id"].dataType), F.col("id").cast(vectors.schema["id"].dataType), "d", "n2")
    return found.withColumn("key", key).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit)


def _usable(m: np.ndarray, exact: bool) -> np.ndarray:
    return np.isfinite(m).all(1) & ((m != 0).any(1) | exact)


def _search_block(spark, store: DataFrame, block: DataFrame, limit: int, exact: bool) -> DataFrame:
    asked = block.select("query_id", "q").toArrow().combine_chunks()
    by_width = _by_width(asked.column("query_id").combine_chunks(), asked.column("q").combine_chunks()) if len(asked) else {}
    held = spark.sparkContext.broadcast({w: (ids[ok], m[ok]) for w, (ids, m) in by_width.items() if (ok := _usable(m, exact)).any()})

    def run(batches):
        tops = {w: [_Top(ids[k : k + QUERY_CHUNK], m[k : k + QUERY_CHUNK], limit, exact) for k in range(0, len(ids), QUERY_CHUNK)] for w, (ids, m) in held.value.items()}
        for batch in batches:
            for width, (ids, m) in _by_width(batch.column("id"), batch.column("v")).items():
                if width not in tops:
                    continue
                stay = _usable(m, False)
                ids, m = ids[stay], m[stay]
                for k in range(0, len(ids), VECTOR_CHUNK):
                    part = m[k : k + VECTOR_CHUNK]
                    sizes = _squares(part) if exact else np.sqrt(_squares(part))
                    units = _units(part)
                    for top in tops[width]:
                        top.add(ids[k : k + VECTOR_CHUNK], part, units, sizes)
        for top in (t for ts in tops.values() for t in ts):
            if len(top.found[0]) or top.fresh:
                yield top.rows(["query_id", "id", "d", "n2"])

    return store.mapInArrow(run, f"query_id long, id long, d {'long' if exact else 'double'}, n2 long")


def fuse(lists: list[DataFrame], k: float = 2.0, limit: int | None = None) -> DataFrame:
    """Reciprocal rank fusion of ``query_id, id, rank`` lists; ties to the smaller id."""
    union = lists[0].select("query_id", "id", "rank")
    for other in lists[1:]:
        union = union.unionByName(other.select("query_id", "id", "rank"))
    summed = union.groupBy("query_id", "id").agg(F.round(F.sum(F.lit(1.0) / (F.lit(k) + F.col("rank"))), 12).alias("fused"))
    out = summed.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("fused"), "id")))
    return out if limit is None else out.where(F.col("rank") <= limit)


def work_queue(blocks: DataFrame, store: DataFrame) -> DataFrame:
    """Hashes without a vector: a representative text, in the order of their first block."""
    return blocks.join(store.select("hash"), "hash", "left_anti").groupBy("hash").agg(F.min("text").alias("text"), F.min("block_id").alias("first_block"))


def coverage(blocks: DataFrame, store: DataFrame) -> DataFrame:
    """One row: blocks whose vector is there, blocks in all."""
    have = store.select("hash").distinct().withColumn("has", F.lit(1))
    return blocks.join(have, "hash", "left").agg(F.count("has").alias("reachable"), F.count("*").alias("total"))


def block_vectors(blocks: DataFrame, store: DataFrame) -> DataFrame:
    """Blocks with their vector ``v``, joined on the content hash: copies of a text share one vector."""
    return blocks.join(store.select("hash", "v"), "hash")


def prune(store: DataFrame, blocks: DataFrame) -> DataFrame:
    """Vectors whose hash is still in the catalog."""
    return store.join(blocks.select("hash"), "hash", "left_semi")


def append_new(store: DataFrame, derived: DataFrame) -> DataFrame:
    """Derive once: the first record of a hash stays, known hashes are not written again."""
    first = derived.withColumn("_r", F.row_number().over(Window.partitionBy("hash").orderBy("ord"))).where("_r = 1").drop("_r")
    return first.join(store.select("hash"), "hash", "left_anti")


def hydrate(cache: DataFrame, store: DataFrame, blocks: DataFrame) -> DataFrame:
    """Records of the store that the catalog needs and the cache lacks; degenerate records are skipped."""
    needed = blocks.select("hash").distinct().join(cache.select("hash"), "hash", "left_anti")
    return store.join(needed, "hash", "left_semi").where(degenerate(F.col("v")).isNull())


def import_peers(store: DataFrame, peers: DataFrame) -> DataFrame:
    """Records that are missing, from the peer of best priority that has each. ``peers``: ``hash, v, priority, origin``."""
    missing = peers.join(store.select("hash"), "hash", "left_anti")
    return missing.withColumn("_r", F.row_number().over(Window.partitionBy("hash").orderBy("priority", "origin"))).where("_r = 1").drop("_r")


def adversarial(scores: DataFrame, relevant: DataFrame) -> DataFrame:
    """Worst case over producers: a relevant document takes its smallest key, any other its largest."""
    marked = scores.join(relevant.withColumn("rel", F.lit(True)), ["query_id", "doc_id"], "left").withColumn("rel", F.coalesce("rel", F.lit(False)))
    return marked.groupBy("query_id", "doc_id", "rel").agg(F.min("key").alias("low"), F.max("key").alias("high")).select("query_id", "doc_id", F.when(F.col("rel"), F.col("low")).otherwise(F.col("high")).alias("key"))


def embed_batches(queue: DataFrame, embedder, batch: int = 64) -> DataFrame:
    """Vectors of ``hash, text`` from a pluggable batch embedder; a failing batch is tried row by row, failing rows are skipped."""
    import pandas as pd

    def run(frames):
        for frame in frames:
            for at in range(0, len(frame), batch):
                part = frame.iloc[at : at + batch]
                hashes, texts = part["hash"].tolist(), part["text"].tolist()
                try:
                    made = list(zip(hashes, embedder(texts), strict=True))
                except Exception:
                    made = []
                    for h, t in zip(hashes, texts, strict=True):
                        try:
                            made.append((h, embedder([t])[0]))
                        except Exception:
                            continue
                yield pd.DataFrame(made, columns=["hash", "v"])

    return queue.select("hash", "text").mapInPandas(run, "hash string, v array<float>")
