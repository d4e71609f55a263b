"""Operator 8, language ID by compression: the dictionary under which a text compresses best names its language.

Per language a raw-content zstandard dictionary is filled with a bounded sample of whole training texts. A text is cut into pieces, all of which
are compressed with every dictionary, after lower-casing and with one blank for each run of other characters than letters; the language of the smallest total wins, ties to the one with more training texts, then the smaller name. When the margin to
the runner-up is narrow, ``rejected`` is set; the best guess is still given.

Bounds of the sample, all parameters: at most ``sample_docs`` texts a language, each of at most ``sample_chars`` characters,
the first by hash of doc_id, filled up to ``dict_bytes``.

Defined results: null text or one without a letter: ``und``, score 0; no training text at all: ``und`` for every text; null doc_id: held out is null, not trained on; null lang: not trained on; repeated rows get a row each; an empty table gives no
rows; other columns are ignored.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

SAMPLE_DOCS, SAMPLE_CHARS, DICT_BYTES = 256, 16_384, 112_640
PIECE = 4096
SHORT = 512
LEVELS = (19, 3)  # for pieces of up to SHORT bytes, and for longer ones
NARROW = 0.01
_OTHER = re.compile(r"[\W\d_]+")


def letters(text: str) -> bytes:
    return _OTHER.sub(" ", text.lower()).encode()


def held_out():
    return F.crc32(F.col("doc_id").cast("string")) % 4 == 2


def dictionaries(docs: DataFrame, sample_docs: int = SAMPLE_DOCS, sample_chars: int = SAMPLE_CHARS, dict_bytes: int = DICT_BYTES) -> dict[str, bytes]:
    """Raw content by language, from the bounded sample of rows that are not held out; languages of more training texts come first."""
    usable = docs.where(~held_out() & F.col("lang").isNotNull() & F.col("text").isNotNull() & F.char_length("text").between(1, sample_chars))
    order = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    # only ids are ranked; the top of each language is taken within each task before anything is shuffled
    ids = usable.select("doc_id", "lang").withColumn("r", F.row_number().over(order)).where(F.col("r") <= sample_docs).select("doc_id", "lang", "r").collect()
    size = {x["lang"]: x["count"] for x in usable.groupBy("lang").count().collect()}  # one row a language
    if not ids:
        return {}
    wanted = sorted({x["doc_id"] for x in ids})
    found = usable.where(F.col("doc_id").isin(wanted)).select("doc_id", "lang", "text").dropDuplicates(["doc_id", "lang"])
    texts: dict[str, list] = {}
    rank = {(x["doc_id"], x["lang"]): x["r"] for x in ids}
    for row in found.toLocalIterator():
        if (row["doc_id"], row["lang"]) in rank:
            texts.setdefault(row["lang"], []).append((rank[row["doc_id"], row["lang"]], row["text"]))
    # the end of a dictionary is nearest to the text, so the first of the sample go last
    order = sorted(texts, key=lambda lang: (-size[lang], lang))
    return {lang: b"\n".join(letters(t) for _, t in sorted(texts[lang], reverse=True))[-dict_bytes:] for lang in order}


class Classifier:
    def __init__(self, contents: dict[str, bytes]):
        import regex
        import zstandard

        self.langs = list(contents)  # ties go to the first
        self.letter = regex.compile(r"\p{L}")
        self.packers = []
        for level in LEVELS:
            own = []
            for lang in self.langs:
                data = zstandard.ZstdCompressionDict(contents[lang], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
                data.precompute_compress(level=level)
                own.append(zstandard.ZstdCompressor(dict_data=data, write_content_size=False, write_checksum=False, write_dict_id=False))
            self.packers.append(own)

    def __call__(self, text: str | None) -> tuple[str, float, bool]:
        """Language, score (twice the saving over the runner-up as a share of its size, 1 at most) and whether the margin is narrow."""
        if not text or not self.langs or not self.letter.search(text):
            return "und", 0.0, True
        raw = letters(text)
        sizes = [0] * len(self.langs)
        for at in range(0, len(raw), PIECE):
            piece = raw[at : at + PIECE]
            for k, packer in enumerate(self.packers[len(piece) > SHORT]):
                sizes[k] += len(packer.compress(piece))
        order = sorted(range(len(sizes)), key=lambda k: (sizes[k], k))
        if len(order) == 1:
            return self.langs[0], 1.0, False
        margin = (sizes[order[1]] - sizes[order[0]]) / sizes[order[1]]
        return self.langs[order[0]], min(1.0, 2 * margin), margin < NARROW


def identify(docs: DataFrame, contents: dict[str, bytes]) -> DataFrame:
    """``doc_id, lang_pred, score, rejected``; only doc_id and text are read. The dictionaries are bounded by dict_bytes a language."""
    held = docs.sparkSession.sparkContext.broadcast(contents)

    def run(batches):
        classify = Classifier(held.value)
        for batch in batches:
            column = batch.column(1)
            for at in range(0, batch.num_rows, 500):
                part = column.slice(at, 500)
                out = [classify(x.as_py()) for x in part]
                names, scores, narrow = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, 500), pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array(narrow, pa.bool_())], names=["doc_id", "lang_pred", "score", "rejected"])

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"]).mapInArrow(run, "doc_id long, lang_pred string, score double, rejected boolean")


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    found = identify(docs, dictionaries(docs))
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "rejected")
