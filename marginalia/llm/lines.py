"""Operator 2, line dedup (DataFrame functions only): drop lines whose key occurs in too many documents.

Lines are the pieces between ``\\n``. Keys are stripped, A-Z lower-cased and hashed to 128 bits; documents are counted
distinct per key; a key that reaches ``min_docs`` loses its lines everywhere but in the largest doc_id holding it, and
documents are put together again by line position. Lines are split once, to a table of hashes and positions. Rows are dealt to
SALTS places; a key remembers in a bit mask where it occurs, so that the lines of a hot one meet it in many tasks.

Defined results: null or empty text: one empty line, kept as it is (null text is returned null when nothing is dropped);
rows with one doc_id are one document to the count and each row loses its own lines, by its own positions; rows with null
doc_id never count as documents and lose every dropped key; an empty table gives no rows; other columns pass through untouched,
whatever their names, but for ``n_lines`` and ``n_dropped``, which are replaced.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

SALTS = 64  # bits of a long

def _lines(text):
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _key(line):
    return common.ascii_lower(F.btrim(line, F.lit(common.SPACES)))


def _hashes(lines, min_chars: int):
    """Hashes and position of each line that is long enough."""
    keyed = F.transform(lines, lambda line, i: F.struct(_key(line).alias("key"), i.alias("pos")))
    long = F.filter(keyed, lambda x: F.char_length(x["key"]) >= min_chars)
    return F.transform(long, lambda x: F.struct(F.xxhash64(x["key"]).alias("h1"), F.xxhash64(F.lit(0x5EED), x["key"]).alias("h2"), x["pos"].alias("pos")))


def _row_key() -> list:
    """The identity of a row: 128 bits of its doc_id and text. It survives recomputation; rows equal in both lose the same lines."""
    row = [F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.coalesce(F.col("text"), F.lit(""))]
    return [F.xxhash64(F.col("doc_id").isNull(), *row), F.xxhash64(F.lit(0x5EED), F.col("doc_id").isNull(), *row)]


def dropped_positions(docs: DataFrame, min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    """``r1, r2, drops``: the positions of the lines that each row loses; rows that lose none are not listed."""
    r1, r2 = _row_key()
    split = docs.select("doc_id", r1.alias("r1"), r2.alias("r2"), F.explode(_hashes(_lines(F.col("text")), min_chars)).alias("l"))
    lines, _ = common.materialize(docs.sparkSession, split.select("doc_id", "r1", "r2", F.pmod("r1", F.lit(SALTS)).cast("int").alias("salt"), "l.*"), "lines")
    # keys and ids only: distinct (key, document), then partial counts per key before the last shuffle
    place = F.lit(1).cast("long")
    common_keys = (
        lines.groupBy("h1", "h2", "doc_id").agg(F.bit_or(F.call_function("shiftleft", place, F.col("salt"))).alias("mask"))
        .groupBy("h1", "h2").agg(F.count("doc_id").alias("n"), F.max("doc_id").alias("holder"), F.bit_or("mask").alias("mask"))
        .where(F.col("n") >= min_docs)
    )
    salts = F.filter(F.sequence(F.lit(0), F.lit(SALTS - 1)), lambda i: F.getbit(F.col("mask"), i) == 1)
    hit = lines.join(common_keys.select("h1", "h2", "holder", F.explode(salts).alias("salt")), ["h1", "h2", "salt"]).where(~F.col("doc_id").eqNullSafe(F.col("holder")))
    return hit.groupBy("r1", "r2").agg(F.collect_set("pos").alias("drops"))


def drop_common_lines(docs: DataFrame, min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    """``docs`` with ``text`` reassembled from the lines that stay, plus ``n_lines`` and ``n_dropped``."""
    own = common.fresh(docs.columns)
    r1, r2, drops, held = (own + x for x in ("r1", "r2", "drops", "lines"))
    found = dropped_positions(docs, min_chars, min_docs).toDF(r1, r2, drops)
    joined = docs.withColumns(dict(zip((r1, r2), _row_key(), strict=True))).join(found, [r1, r2], "left").withColumn(held, _lines(F.col("text")))
    kept = F.array_except(F.sequence(F.lit(0), F.size(held) - 1), F.col(drops))  # hashed, keeps the order
    text = F.when(F.col(drops).isNull(), F.col("text")).otherwise(F.array_join(F.transform(kept, lambda i: F.get(F.col(held), i)), "\n"))
    columns = [common.column(c) for c in docs.columns if c.lower() not in ("text", "n_lines", "n_dropped")]
    return joined.select(*columns, text.alias("text"), F.size(held).cast("long").alias("n_lines"), F.coalesce(F.size(drops), F.lit(0)).cast("long").alias("n_dropped"))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    return drop_common_lines(docs).select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


OP2_SQL = r"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, unnest(ls) AS line, unnest(range(len(ls))) AS pos FROM d),
k AS (SELECT doc_id, pos, line,
  translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
c AS (SELECT key, max(doc_id) AS holder FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
m AS (SELECT k.doc_id, k.pos, k.line, c.holder IS NOT NULL AND c.holder IS DISTINCT FROM k.doc_id AS dropped FROM k LEFT JOIN c USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE dropped) AS n_dropped,
  sha256(encode(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT dropped), ''))) AS kept_sha256
FROM m GROUP BY doc_id
"""
