"""A corpus from raw documents: quality, repeated lines, near duplicates, mixture, ids.

Each stage works on all rows its predecessor kept and is written and read again before the next. All but the last return the
columns of ``documents``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.llm import common, jaccard, lines, mixing, pieces, quality

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _documents(docs: DataFrame) -> DataFrame:
    return docs.select(*COLUMNS)


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 9: documents that the classifier rejects go."""
    return quality.keep_good(_documents(docs))


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 2: lines that many documents share go; n_chars follows the text. A document that loses all its lines goes with them."""
    kept = lines.drop_common_lines(_documents(docs))
    whole = kept.where((F.col("n_dropped") == 0) | (F.btrim("text", F.lit(common.SPACES)) != ""))
    return _documents(whole.withColumn("n_chars", F.char_length("text").cast("long")))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 7: one document of each group of near duplicates stays."""
    return _documents(jaccard.keep_one_of_each(_documents(docs)))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 3: documents are dropped and repeated to the target weights of sources, languages and topics."""
    return _documents(mixing.copies(mixing.mix(_documents(docs))))


def piece_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4: ids of each whole text, ready for training."""
    return pieces.encode(_documents(docs)).select("doc_id", F.size("ids").cast("long").alias("n_pieces"), "ids", "restored")


STAGES: list[tuple[str, Stage]] = [
    ("quality", quality_stage),
    ("line_dedup", line_stage),
    ("near_duplicates", near_duplicate_stage),
    ("mixing", mixing_stage),
    ("pieces", piece_stage),
]

#: The classifier, the similarity join and the tokenizer are beyond SQL; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs, _ = common.materialize(spark, stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
