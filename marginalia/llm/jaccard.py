"""Operator 7, n-gram Jaccard join: size-aware heavy-light join on sets of word shingles.

Two documents link when ``100 * |A & B| >= 75 * |A | B|``. Sizes a and b then need an overlap of ``ceil(3 * (a + b) / 7)``.

* Equal sets are one class from the start; only one representative goes on.
* Light: sets of at most ``boundary`` shingles enumerate all their subsets of exactly the overlap that each possible partner size
  needs. Two such sets share a subset if and only if they link, so nothing is left to verify.
* Heavy: larger sets, and the sets that can link with them, post their signature to inverted lists: the smallest hashes, as many as
  guarantee a common one (``n - ceil(0.75 n) + 1``), but ``SIGNATURE`` at most. Where that bound cuts (more than 128
  shingles), a pair at 0.75 has no common posting with a probability of 0.25 ** 32 < 1e-19: the smallest hash of the union of two sets
  lies in both with the probability of their similarity, and so do the next 31. Every candidate is verified on whole sets.
* A shingle is a 128-bit hash of its words; equality of sets, subsets and verification use all of it.
* The boundary is the one of least cost: subsets enumerated below it plus postings and expected list lengths above.

The result is components, so a list need not emit all its pairs. First each list compares with its leader (the smallest
hash of an id), which joins large groups at once; then lists that still hold several components compare the rest across
components in blocks, by parity bitmaps that never rule out a link; what passes is verified. Of a block with more candidates than
join its components, the nearest that do are verified first; only lists with such blocks are compared again, in full.
Neither lists nor partners are capped.
"""

from __future__ import annotations

from itertools import combinations
from math import ceil, comb

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .shingles import fold, mix, overlap, parity_bits, shingle_sets, slices

SIGNATURE = 32
LARGEST_LIGHT = 12
BLOCK = 2048
PAIRS = 1 << 18  # words of bitmaps that are compared at once


def needed(a: int, b: int) -> int:
    """Smallest overlap with which sets of these sizes link."""
    return -(-3 * (a + b) // 7)


def partner_sizes(a: int) -> range:
    return range(-(-3 * a // 4), 4 * a // 3 + 1)


def sets(docs: DataFrame, width: int = 5, full: bool = False) -> DataFrame:
    """``doc_id, n, h1, h2, sig, bits`` of every row, or with ``full`` also ``shingles``, the whole sorted set in bytes."""
    schema = "doc_id long, n long, h1 long, h2 long, sig array<long>, bits binary" + ", shingles binary" * full

    def run(batches):
        import xxhash

        for batch in batches:
            ids, column = batch.column(0), batch.column(1)
            sizes = [0 if x is None else x for x in pa.compute.binary_length(column).to_pylist()]
            for a, b in slices(sizes):
                texts = [t or b"" for t in column.slice(a, b - a).cast(pa.binary()).to_pylist()]
                found = shingle_sets(texts, width)
                digest = [xxhash.xxh3_128_intdigest(x.tobytes()) for x in found]
                half = lambda shift: pa.array(np.array([d >> shift & 0xFFFFFFFFFFFFFFFF for d in digest], np.uint64).view(np.int64))
                as_lists = lambda values: pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, values)]), pa.int32()), pa.array(np.concatenate(values).view(np.int64) if values else np.zeros(0, np.int64)))
                columns = [
                    ids.slice(a, b - a), pa.array([x.shape[1] for x in found], pa.int64()), half(64), half(0),
                    as_lists([x[0, : min(SIGNATURE, x.shape[1] - ceil(0.75 * x.shape[1]) + 1)] if x.shape[1] else x[0] for x in found]),
                    pa.array([parity_bits(x[0]) for x in found], pa.binary()),
                ]
                names = ["doc_id", "n", "h1", "h2", "sig", "bits"]
                if full:
                    columns.append(pa.array([x.tobytes() for x in found], pa.binary()))
                    names.append("shingles")
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text")).mapInArrow(common.lean(run), schema)


def light_keys(a: int, boundary: int) -> int:
    """Subsets that a set of this size enumerates."""
    return sum(comb(a, needed(a, b)) for b in partner_sizes(a) if b <= boundary)


def choose_boundary(histogram: dict[int, int], list_length: float) -> int:
    """Boundary of least cost. histogram: sets by size, up to 4/3 of LARGEST_LIGHT; list_length: mean length of their posting lists."""

    def cost(x: int) -> float:
        enumerated = sum(n * light_keys(a, x) for a, n in histogram.items() if a <= x)
        scanned = sum(n * (a - ceil(0.75 * a) + 1) * (1 + 2 * list_length) for a, n in histogram.items() if a > x or a >= ceil(0.75 * (x + 1)))
        return enumerated + scanned

    return min(range(LARGEST_LIGHT + 1), key=cost)


def light_links(small: DataFrame, boundary: int) -> DataFrame:
    """Edges among sets of at most ``boundary`` shingles (``doc_id, n, shingles``), found by common subsets."""

    def run(batches):
        schema = pa.schema([("lo", pa.int64()), ("hi", pa.int64()), ("k1", pa.int64()), ("k2", pa.int64()), ("doc_id", pa.int64()), ("n", pa.int64())])
        for batch in batches:
            rows = batch.to_pydict()
            out = []
            for doc, n, shingles in zip(rows["doc_id"], rows["n"], rows["shingles"], strict=True):
                for b in partner_sizes(n):
                    if 0 < b <= boundary:
                        halves = np.frombuffer(shingles, np.uint64).reshape(2, n)
                        subsets = np.array(list(combinations(range(n), needed(n, b))))
                        with np.errstate(over="ignore"):
                            k1, k2 = np.zeros(len(subsets), np.uint64), np.ones(len(subsets), np.uint64)
                            for j in range(subsets.shape[1]):
                                k1 = mix(k1 * np.uint64(31) + halves[0, subsets[:, j]])
                                k2 = mix(k2 * np.uint64(0x9E3779B97F4A7C15) + halves[1, subsets[:, j]])
                        out += [(min(n, b), max(n, b), x, y, doc, n) for x, y in zip(k1.view(np.int64).tolist(), k2.view(np.int64).tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*out, strict=True) if out else [[]] * 6)], schema=schema)

    keys = small.select("doc_id", "n", "shingles").mapInArrow(common.lean(run), "lo long, hi long, k1 long, k2 long, doc_id long, n long")
    names = ["lo", "hi", "k1", "k2"]
    # sets of size lo all link with those of size hi, so one edge to the smallest id joins them
    groups = keys.groupBy(names).agg(F.min("doc_id").alias("head"), F.count("*").alias("c"), F.min("n").alias("least"), F.max("n").alias("most")).where("c > 1 and least = lo and most = hi")
    return keys.join(groups, names).where("doc_id <> head").select(F.col("head").alias("a"), F.col("doc_id").alias("b")).distinct()


def _popcount_differs(left: bytes, right: bytes) -> int:
    a, b = np.frombuffer(left, np.uint64), np.frombuffer(right, np.uint64)
    size = min(len(a), len(b))
    return int(np.bitwise_count(fold(a, size) ^ fold(b, size)).sum())


def _may_link(pairs: DataFrame) -> DataFrame:
    """Pairs ``a, b, na, nb, bits_a, bits_b`` that sizes and bitmaps don't rule out."""

    def run(batches):
        for batch in batches:
            a, b = batch.column("bits_a"), batch.column("bits_b")
            na, nb = batch.column("na").to_numpy(), batch.column("nb").to_numpy()
            keep = [7 * _popcount_differs(x.as_py(), y.as_py()) <= int(n) for x, y, n in zip(a, b, na + nb, strict=True)]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    sized = pairs.where("4 * na >= 3 * nb and 4 * nb >= 3 * na")
    return sized.select("a", "b", "na", "nb", "bits_a", "bits_b").mapInArrow(common.lean(run), "a long, b long")


def verify(spark: SparkSession, pairs: DataFrame, docs: DataFrame, width: int) -> DataFrame:
    """The pairs ``a, b`` that link, by their whole sets. Only the texts that occur in a pair are read again.

    The partners of an ``a`` are dealt to blocks of about BLOCK; its set goes once to each of them and stays there while theirs pass by."""
    wanted = pairs.select(F.col("a").alias("doc_id")).unionAll(pairs.select("b")).distinct()
    whole = sets(docs.select("doc_id", "text").join(wanted, "doc_id", "left_semi"), width, full=True)
    whole, path = common.materialize(spark, whole.select("doc_id", "h1", "h2", "shingles").dropDuplicates(["doc_id", "h1", "h2"]).select("doc_id", "shingles"), "shingles")
    parts = pairs.groupBy("a").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("parts"))
    dealt = pairs.join(parts, "a").select("a", F.pmod(F.xxhash64("b"), F.col("parts")).cast("int").alias("part"), "b")
    partners = dealt.join(whole.withColumnRenamed("doc_id", "b"), "b").select("a", "part", "b", "shingles")
    own = parts.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).join(whole.withColumnRenamed("doc_id", "a"), "a").select("a", "part", F.lit(None).cast("long").alias("b"), "shingles")
    rows = own.unionByName(partners).repartition("a", "part").sortWithinPartitions("a", "part", F.asc_nulls_first("b"))

    def run(batches):
        key, held = None, []
        for batch in batches:
            found = []
            for a, part, b, shingles in zip(*(batch.column(c) for c in ("a", "part", "b", "shingles")), strict=True):
                a, b, x = a.as_py(), b.as_py(), np.frombuffer(shingles.as_buffer(), np.uint64).reshape(2, -1)
                if (a, part.as_py()) != key:
                    key, held = (a, part.as_py()), []
                if b is None:
                    held.append(x.copy())
                    continue
                for y in held:  # one, but for repeated ids
                    shared = overlap(x, y)
                    if 100 * shared >= 75 * (x.shape[1] + y.shape[1] - shared):
                        found.append((a, b))
                        break
            yield pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], pa.int64()) for k in (0, 1)], names=["a", "b"])

    out, _ = common.materialize(spark, rows.mapInArrow(common.lean(run), "a long, b long").distinct(), "links")
    common.drop_path(spark, path)
    return out


def _folded(words: np.ndarray, start: np.ndarray, length: np.ndarray, size: int) -> np.ndarray:
    """The bitmaps at ``start`` of ``words``, of ``length`` each, folded to ``size`` words."""
    out = np.empty((len(start), size), np.uint64)
    for whole in np.unique(length).tolist():
        at, step = np.flatnonzero(length == whole), max(1, PAIRS // whole)
        for k in range(0, len(at), step):
            rows = words[start[at[k : k + step], None] + np.arange(whole)]
            while rows.shape[1] > size:
                half = rows.shape[1] // 2
                rows = rows[:, :half] ^ rows[:, half:]
            out[at[k : k + step]] = rows
    return out


def _near(i: np.ndarray, j: np.ndarray, n: np.ndarray, words: np.ndarray, start: np.ndarray, length: np.ndarray, first: np.ndarray):
    """The pairs ``i, j`` that whole bitmaps don't rule out and the bits in which they differ. Short foldings (``first``) rule out most."""
    d = np.bitwise_count(first[i] ^ first[j]).sum(1, dtype=np.int64)
    size = first.shape[1]
    while True:
        keep = 7 * d <= n[i] + n[j]
        i, j, d = i[keep], j[keep], d[keep]
        full = np.minimum(length[i], length[j])
        if not (full > size).any():
            return i, j, d
        for width in np.unique(np.minimum(full[full > size], 4 * size)).tolist():
            at = np.flatnonzero((full > size) & (np.minimum(full, 4 * size) == width))
            step = max(1, PAIRS // width)
            for k in range(0, len(at), step):
                some = at[k : k + step]
                rows, place = np.unique(np.concatenate([i[some], j[some]]), return_inverse=True)
                bits = _folded(words, start[rows], length[rows], width)
                d[some] = np.bitwise_count(bits[place[: len(some)]] ^ bits[place[len(some) :]]).sum(1, dtype=np.int64)
        size *= 4


def _across(lists: DataFrame, everything: bool) -> DataFrame:
    """Candidates ``a, b`` across components within blocks of a list; a row with null ends and ``token, left, right`` for each pair of
    blocks where some are left for later.

    Input rows: ``token, left, right, side, doc_id, n, comp, bits``, where (left, right) names a pair of blocks of the list. Unless
    ``everything``, only a spanning forest of the nearest candidates over components is given: one fewer than components at most."""
    names = ["token", "left", "right"]

    def forest(rows):
        """Of one list's candidates ``d, a, b, comp of a, comp of b``, nearest first, those that join components."""
        parent: dict[int, int] = {}

        def top(x):
            while x in parent:
                x = parent[x]
            return x

        taken = []
        for _, a, b, left, right in sorted(rows):
            left, right = top(left), top(right)
            if left != right:
                parent[left] = right
                taken.append((a, b))
        return taken

    def group(held):
        """Pairs and names of unfinished lists of some whole lists, all compared at once."""
        rows = pa.Table.from_batches(held)
        keys = np.stack([rows.column(c).to_numpy().astype(np.int64) for c in names])
        which = np.cumsum(np.concatenate([[False], (keys[:, 1:] != keys[:, :-1]).any(0)]))
        doc, n, comp, side = (rows.column(c).to_numpy().astype(np.int64) for c in ("doc_id", "n", "comp", "side"))
        bits = rows.column("bits").cast(pa.large_binary()).combine_chunks()
        words = np.frombuffer(bits.buffers()[2], np.uint64)
        ends = np.frombuffer(bits.buffers()[1], np.int64)[bits.offset : bits.offset + len(bits) + 1] // 8
        order = np.lexsort((doc, n, which))  # by size, then id
        start, length = ends[:-1][order], np.diff(ends)[order]
        doc, n, comp, side, which, keys = doc[order], n[order], comp[order], side[order], which[order], keys[:, order]
        first = _folded(words, start, length, 4)
        # row i meets the rows after it in its list whose size can link; sizes are ranked, so that list and size make one sorted number
        sizes, rank = np.unique(n, return_inverse=True)
        most = np.searchsorted(sizes, 4 * n // 3, side="right")
        count = np.searchsorted(which * (len(sizes) + 1) + rank, which * (len(sizes) + 1) + most, side="left") - np.arange(len(n)) - 1
        total = np.cumsum(count)
        found, at = [], 0
        while at < len(n):
            stop = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + PAIRS // 4, side="right")))
            c = count[at:stop]
            i = np.repeat(np.arange(at, stop), c)
            j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(c) - c, c)
            other = (comp[i] != comp[j]) & ((side[i] == 2) | (side[i] != side[j]))
            found.append(_near(i[other], j[other], n, words, start, length, first))
            at = stop
        i, j, d = (np.concatenate([f[k] for f in found]) for k in range(3))
        a, b = np.minimum(doc[i], doc[j]), np.maximum(doc[i], doc[j])
        if everything:
            return [(x, y, None, None, None) for x, y in set(zip(a.tolist(), b.tolist(), strict=True))]
        out = set()
        bounds = np.flatnonzero(np.diff(which[i], prepend=-1, append=-1)) if len(i) else np.zeros(1, np.int64)
        for x, y in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            rows = set(zip(*(v[x:y].tolist() for v in (d, a, b, comp[i], comp[j])), strict=True))
            taken = forest(rows)
            out.update((p, q, None, None, None) for p, q in taken)
            if len(taken) < len(rows):
                out.add((None, None, *keys[:, i[x]].tolist()))
        return list(out)

    def run(batches):
        def flush():
            rows = group(held) if sum(len(h) for h in held) > 1 else []
            types = [pa.int64()] * 3 + [pa.int32()] * 2
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], names=["a", "b", *names])

        held, last = [], None
        for batch in batches:
            if not len(batch):
                continue
            keys = np.stack([batch.column(c).to_numpy().astype(np.int64) for c in names])
            begins = np.flatnonzero((keys != np.concatenate([keys[:, :1] if last is None else last, keys[:, :-1]], 1)).any(0))
            if len(begins):  # the lists before the last one are whole
                held.append(batch.slice(0, begins[-1]))
                yield flush()
                held, batch = [], batch.slice(begins[-1])
            held.append(batch)
            last = keys[:, -1:]
        if held:
            yield flush()

    dealt = lists.repartition(*names).sortWithinPartitions(*names)
    return dealt.select(*names, "side", "doc_id", "n", "comp", "bits").mapInArrow(common.lean(run), "a long, b long, token long, left int, right int")


def _blocks(lists: DataFrame) -> DataFrame:
    """Deal the rows of lists longer than BLOCK to pairs of blocks: each document meets every other in exactly one pair, or within its own block."""
    parts = F.ceil(F.col("f") / BLOCK).cast("int")
    own = F.pmod(F.xxhash64("doc_id"), F.col("parts")).cast("int")
    dealt = lists.withColumn("parts", parts).withColumn("own", own).withColumn("with", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    side = F.when(F.col("own") == F.col("with"), F.lit(2)).when(F.col("own") < F.col("with"), F.lit(0)).otherwise(F.lit(1))
    return dealt.withColumn("left", F.least("own", "with")).withColumn("right", F.greatest("own", "with")).withColumn("side", side)


def near_duplicates(docs: DataFrame, width: int = 5) -> DataFrame:
    """One row per input row: ``doc_id, n_shingles, component_id`` (smallest doc_id reachable by links).

    Defined results: null or wordless text: size 0, linked with nothing; rows with one doc_id are one node, which has the links
    of all its rows; null doc_id: sized, linked with nothing, component null; an empty table gives no rows; other columns of ``docs`` are ignored.
    """
    spark = docs.sparkSession
    table, _ = common.materialize(spark, sets(docs, width), "sets")
    usable = table.where("n > 0 and doc_id is not null")
    classes = usable.groupBy("h1", "h2", "n").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"))
    member = usable.select("doc_id", "h1", "h2", "n").join(classes.where("copies > 1"), ["h1", "h2", "n"]).where("doc_id <> rep").select(F.col("rep").alias("a"), F.col("doc_id").alias("b"))
    reps = classes.select("h1", "h2", "n", F.col("rep").alias("doc_id"))
    distinct, _ = common.materialize(spark, usable.join(reps, ["h1", "h2", "n", "doc_id"], "left_semi").dropDuplicates(["doc_id", "h1", "h2"]), "distinct-sets")

    # the sizes up to 4/3 of the largest boundary: at most 17 rows
    short = distinct.where(F.col("n") <= 4 * LARGEST_LIGHT // 3)
    histogram = {int(r["n"]): int(r["c"]) for r in short.groupBy("n").agg(F.count("*").alias("c")).collect()}
    seen = short.select(F.explode("sig").alias("t")).agg(F.count("*").alias("rows"), F.approx_count_distinct("t").alias("lists")).first()
    boundary = choose_boundary(histogram, seen["rows"] / max(1, seen["lists"]))
    edges = [member]
    if boundary:
        tiny = docs.select("doc_id", "text").join(distinct.where(F.col("n") <= boundary).select("doc_id"), "doc_id", "left_semi")
        edges.append(light_links(sets(tiny, width, full=True).where(F.col("n").between(1, boundary)), boundary))

    heavy = distinct.where(F.col("n") >= ceil(0.75 * (boundary + 1)))
    posted = heavy.select("doc_id", "n", F.explode("sig").alias("token"))
    lists = posted.groupBy("token").agg(F.count("*").alias("f"), F.min_by("doc_id", F.struct(F.xxhash64("doc_id"), F.col("doc_id"))).alias("leader"), F.max("n").alias("longest")).where(F.col("f") > 1).where(F.col("longest") > boundary)
    shared, _ = common.materialize(spark, posted.join(lists, "token").select("token", "f", "leader", "doc_id", "n"), "lists")
    info = distinct.select("doc_id", "n", "bits")

    def described(pairs: DataFrame) -> DataFrame:
        left = info.select(F.col("doc_id").alias("a"), F.col("n").alias("na"), F.col("bits").alias("bits_a"))
        right = info.select(F.col("doc_id").alias("b"), F.col("n").alias("nb"), F.col("bits").alias("bits_b"))
        return pairs.join(left, "a").join(right, "b")

    led = shared.where("doc_id <> leader").select(F.least("leader", "doc_id").alias("a"), F.greatest("leader", "doc_id").alias("b")).distinct()
    candidates, _ = common.materialize(spark, _may_link(described(led)).distinct(), "candidates")
    edges.append(verify(spark, candidates, docs, width))

    found, again = _union(edges), None
    while True:
        found, _ = common.materialize(spark, found, "found")
        comp = common.components(spark, found)
        open_lists = shared.where("f > 2")
        if again is not None:
            open_lists = open_lists.join(again, "token", "left_semi")
        named = open_lists.join(comp.withColumnRenamed("node", "doc_id"), "doc_id", "left").withColumn("comp", F.coalesce("component", "doc_id"))
        mixed = named.groupBy("token").agg(F.min("comp").alias("c1"), F.max("comp").alias("c2")).where("c1 <> c2").select("token")
        rest = _blocks(named.join(mixed, "token").join(info.drop("n"), "doc_id").select("token", "f", "doc_id", "n", "comp", "bits"))
        across, across_path = common.materialize(spark, _across(rest, again is not None).distinct(), "across")
        links = verify(spark, across.where("a is not null").select("a", "b"), docs, width)
        merged = not links.isEmpty()
        if merged:
            found = found.unionByName(links)
        if again is not None:
            common.drop_path(spark, again_path)
        # what the forest has not joined is compared in full; of the other lists every candidate has been verified
        again, again_path = across.where("a is null").select("token").distinct(), across_path
        if again.isEmpty():
            common.drop_path(spark, again_path)
            break
    if merged:
        comp = common.components(spark, found)
    return (
        table.select("doc_id", F.col("n").alias("n_shingles"))
        .join(comp.withColumnRenamed("node", "doc_id"), "doc_id", "left")
        .select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))
    )


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def keep_one_of_each(docs: DataFrame, width: int = 5) -> DataFrame:
    """The rows of ``docs`` that stand for their component: one row of the smallest doc_id; rows with null doc_id stay."""
    spark = docs.sparkSession
    found, _ = common.materialize(spark, near_duplicates(docs, width), "near-duplicates")
    keep = found.where("doc_id = component_id").groupBy("doc_id").agg(F.count("*").alias("c"))
    out = docs.join(keep.select("doc_id"), "doc_id", "left_semi")
    if not keep.where("c > 1").isEmpty():  # repeated ids: one row of each
        out = out.dropDuplicates(["doc_id"])
    return out.select(docs.columns).unionByName(docs.where("doc_id is null"))


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(common.table(spark, sf_dir, "documents").select("doc_id", "text"))
