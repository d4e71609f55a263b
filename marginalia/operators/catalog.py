"""Document catalog: blocks with citations, links, fingerprints, incremental refresh, census."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import markdown, text

MAX_CHANGES = 32


def build(docs: DataFrame, rules: text.Rules, native_prefix: str = "native:") -> tuple[DataFrame, DataFrame]:
    """Docs and blocks of ``doc_id, path, text``: rings above 4 and blocks of generated data are left out."""
    native = F.startswith("path", F.lit(native_prefix))
    location = F.when(native, F.lit(2)).otherwise(text.ring_of(F.col("path"), rules))
    ranked = docs.withColumn("ring", text.effective_ring(text.frontmatter_ring(F.col("text")), location, native)).where("ring <= 4")
    body = markdown.explode_blocks(ranked)
    body = body.where(~text.generated_blob(F.col("text"))).withColumn("hash", text.content_hash(F.col("text")))
    blocks = body.join(ranked.select("doc_id", "path", "ring"), "doc_id").withColumn("cite", text.citation(F.col("ring"), F.col("hash")))
    return ranked.select("doc_id", "path", "ring"), blocks


def dedup_mirrors(hits: DataFrame, partition: list[str] | None = None) -> DataFrame:
    """One hit per (hash part of cite, chain): the lowest ring at the first rank, other paths as sorted ``mirrors``.

    ``hits``: ``cite, chain, rank, ring, path`` and any others, which follow the kept hit."""
    keys = [*(partition or []), "_h", "chain"]
    rest = [c for c in hits.columns if c not in (*keys, "rank")]
    grouped = hits.withColumn("_h", text.cite_hash(F.col("cite"))).groupBy(*keys).agg(F.min("rank").alias("rank"), F.min_by(F.struct(*rest), F.struct("ring", "rank")).alias("_k"), F.collect_set("path").alias("_p"))
    return grouped.select(*(partition or []), "chain", "rank", "_k.*", F.array_sort(F.array_except("_p", F.array("_k.path"))).alias("mirrors"))


def reserve_ring_band(hits: DataFrame, highest: int = 1, partition: list[str] | None = None) -> DataFrame:
    """The best hit of rings 0 to ``highest`` moves to rank 1; the others keep their order."""
    w = Window.partitionBy(*(partition or [F.lit(0)]))
    first = F.min(F.when(F.col("ring") <= highest, F.col("rank"))).over(w)
    order = Window.partitionBy(*(partition or [F.lit(0)])).orderBy(F.desc(F.coalesce(F.col("rank") == F.col("_first"), F.lit(False))), "rank")
    return hits.withColumn("_first", first).withColumn("rank", F.row_number().over(order)).drop("_first")


def linked(edges: DataFrame, docs: DataFrame, seeds: DataFrame, limit: int = 8) -> DataFrame:
    """Documents one link away from the seeds in either direction, seeds left out, by ring then path."""
    out = edges.join(seeds.select(F.col("doc_id").alias("from_doc")), "from_doc").select(F.col("to_doc").alias("doc_id"))
    into = edges.join(seeds.select(F.col("doc_id").alias("to_doc")), "to_doc").select(F.col("from_doc").alias("doc_id"))
    near = out.union(into).distinct().join(seeds.select("doc_id"), "doc_id", "left_anti")
    return near.join(docs, "doc_id").orderBy("ring", "path").limit(limit)


def path_suffixes(path: Column) -> Column:
    """``c``, ``b/c``, ``a/b/c`` of ``a/b/c``."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, F.size(parts) - k + 1, k), "/"))


def resolve_links(docs: DataFrame, targets: DataFrame) -> DataFrame:
    """``from_doc, to_doc`` for each target that names exactly one document by a path suffix, its .md left out or not.

    A native store's own folder is tried first. Links of a document to itself are dropped, repeated ones are kept."""
    names = docs.select(F.col("doc_id").alias("to_doc"), F.explode(path_suffixes(F.regexp_replace(F.lower("path"), r"\.md\z", ""))).alias("key"))
    unique = names.groupBy("key").agg(F.count("*").alias("n"), F.min("to_doc").alias("to_doc")).where("n = 1").drop("n")
    keyed = targets.join(docs.select("doc_id", "path"), "doc_id").withColumn("key", F.regexp_replace(F.lower("target"), r"\.md\z", ""))
    sibling = F.when(F.startswith("path", F.lit("native:")), F.concat(F.regexp_replace(F.lower("path"), r"[^/]*\z", ""), F.col("key")))
    keyed = keyed.withColumn("near", sibling)
    found = keyed.join(unique, "key", "left").join(unique.select(F.col("key").alias("near"), F.col("to_doc").alias("near_doc")), "near", "left")
    return found.select(F.col("doc_id").alias("from_doc"), F.coalesce("near_doc", "to_doc").alias("to_doc")).where("to_doc is not null and from_doc <> to_doc")


def fingerprint(files: DataFrame) -> DataFrame:
    """One row: a digest of all (path, mtime_ns, size), equal for any order.

    Rows are digested in parallel; digests meet by folder first, so no task holds all of them."""
    row = F.sha2(F.concat_ws("\0", "path", F.col("mtime_ns").cast("string"), F.col("size").cast("string")), 256)
    return _digest(files.select(row.alias("d")))


def checksum(blocks: DataFrame) -> DataFrame:
    """One row: a digest of the set of (cite, path, ring), equal however the catalog came about."""
    return _digest(blocks.select(F.sha2(F.concat_ws("\0", "cite", "path", F.col("ring").cast("string")), 256).alias("d")))


def _digest(rows: DataFrame) -> DataFrame:
    buckets = rows.groupBy(F.substring("d", 1, 3).alias("b")).agg(F.sha2(F.array_join(F.array_sort(F.collect_list("d")), ""), 256).alias("d"))
    return buckets.agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("b", "d"))), lambda x: x["d"]), ""), 256).alias("digest"))


def changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """``path, change`` (added, vanished, changed, same) between two listings ``path, mtime_ns, size``."""
    o = old.select("path", F.col("mtime_ns").alias("om"), F.col("size").alias("os"))
    n = new.select("path", F.col("mtime_ns").alias("nm"), F.col("size").alias("ns"))
    kind = F.when(F.col("om").isNull(), "added").when(F.col("nm").isNull(), "vanished").when((F.col("om") != F.col("nm")) | (F.col("os") != F.col("ns")), "changed").otherwise("same")
    return o.join(n, "path", "full_outer").select("path", kind.alias("change"))


def rescan(old_rows: DataFrame, old: DataFrame, new: DataFrame, derive, most: int = MAX_CHANGES) -> DataFrame:
    """Rows of the new tree: those of unchanged paths stay, the others are derived; beyond ``most`` changes all are."""
    diff = changes(old, new)
    moved = diff.where("change <> 'same'")
    if moved.limit(most + 1).count() > most:
        return derive(new)
    kept = old_rows.join(moved.select("path"), "path", "left_anti")
    return kept.unionByName(derive(new.join(moved.where("change <> 'vanished'").select("path"), "path", "left_semi")))


def block_counts(docs: DataFrame, blocks: DataFrame) -> DataFrame:
    counted = blocks.groupBy("doc_id").agg(F.count("*").alias("blocks"))
    return docs.join(counted, "doc_id", "left").select("path", F.coalesce("blocks", F.lit(0)).cast("long").alias("blocks"))


def census(docs: DataFrame) -> DataFrame:
    """Documents under each folder, every ancestor counting them: a rollup over the path."""
    parts = F.split("path", "/")
    folders = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/"))
    return docs.where(F.size(parts) > 1).select(F.explode(folders).alias("prefix")).groupBy("prefix").agg(F.count("*").alias("docs"))


def concentrations(docs: DataFrame, share: float = 0.2, most: float = 0.9) -> DataFrame:
    """Deepest folders that hold ``share`` of all documents but less than ``most`` of them."""
    total = docs.count()
    tall = census(docs).where((F.col("docs") >= F.ceil(F.lit(share * total))) & (F.col("docs") < F.lit(most * total)))
    inner = tall.select(F.col("prefix").alias("inner"))
    # at most 1 / share folders a level pass, so this join stays small
    covered = tall.join(inner, F.startswith(F.col("inner"), F.concat("prefix", F.lit("/"))), "left_semi").select("prefix")
    return tall.join(covered, "prefix", "left_anti")


def ring_price(docs: DataFrame, injected: DataFrame) -> DataFrame:
    """Documents and bytes by ring that were not injected."""
    return docs.join(injected.select("path"), "path", "left_anti").groupBy("ring").agg(F.count("*").alias("docs"), F.sum("size").alias("bytes")).where("bytes > 0")


def expand(blocks: DataFrame, cite: str) -> DataFrame:
    """All copies that share the hash part of a citation."""
    return blocks.where(text.cite_hash(F.col("cite")) == cite.split("-", 1)[-1]).orderBy("ring", "path", "start_line")


def graph_degrees(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Distinct links into and out of each document."""
    once = edges.distinct()
    out = once.groupBy(F.col("from_doc").alias("doc_id")).agg(F.count("*").alias("outbound"))
    into = once.groupBy(F.col("to_doc").alias("doc_id")).agg(F.count("*").alias("inbound"))
    return nodes.select("doc_id").join(out, "doc_id", "left").join(into, "doc_id", "left").na.fill(0, ["outbound", "inbound"])


def unresolved(targets: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: references written minus links resolved, both with repetition."""
    return targets.agg(F.count("*").alias("written")).crossJoin(edges.agg(F.count("*").alias("resolved"))).select((F.col("written") - F.col("resolved")).alias("unresolved"))
