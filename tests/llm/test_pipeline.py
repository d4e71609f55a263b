"""The pipeline stage by stage, and its whole run against plain loops."""

import hashlib
import re

from pyspark.sql import functions as F

import corpus_pipeline
from marginalia.llm import common, jaccard, mixing, pieces, registry
from tests.llm.test_operators import _brute_components


def test_stages(spark, data):
    docs = common.table(spark, data, "documents")
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs, _ = common.materialize(spark, stage(spark, before, data), f"test-{name}")
        assert docs.count() > 0
        if name != "pieces":
            assert docs.columns == before.columns
            assert docs.join(before, "doc_id", "left_anti").count() == 0
        if name == "quality":
            labels = common.table(spark, data, "labels").where("quality = 1 and toxic = 0")
            assert before.join(labels, "doc_id").join(docs, "doc_id", "left_anti").count() <= 1
        if name == "near_duplicates":
            groups = jaccard.near_duplicates(before)
            assert docs.count() == groups.where("doc_id = component_id").count()
            again = jaccard.near_duplicates(docs)
            assert again.where(F.col("doc_id") != F.col("component_id")).count() == 0


def test_run_of_an_empty_table(spark, data, tmp_path):
    common.table(spark, data, "documents").limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_mixing_stage_reaches_the_targets(spark, data):
    docs = common.table(spark, data, "documents")
    many = docs.withColumn("doc_id", F.explode(F.transform(F.sequence(F.lit(0), F.lit(59)), lambda i: F.col("doc_id") + i * 1_000_000)))
    many, _ = common.materialize(spark, many, "test-many")
    mixed, _ = common.materialize(spark, corpus_pipeline.mixing_stage(spark, many, data), "test-mixed")

    def shares(df, col):
        total = df.groupBy(col.alias("k")).agg(F.sum(mixing.token_count(F.col("text"))).alias("n")).collect()
        return {r["k"]: r["n"] / sum(x["n"] for x in total) for r in total}

    topics, languages = shares(mixed, mixing.topic_of(F.col("text"))), shares(mixed, F.col("lang"))
    natural = shares(many, mixing.topic_of(F.col("text")))
    assert all(abs(topics[k] - v) < 0.02 for k, v in mixing.TOPICS.items()), (natural, topics)
    assert all(abs(languages[k] - v) < 0.02 for k, v in mixing.LANGUAGES.items()), languages


def _topic(text):
    n = len(text.encode())
    if "License" in text or "Licensed" in text or "Copyright" in text:
        return "legal"
    return "contact" if "@" in text else "short" if n < 600 else "medium" if n < 6000 else "long"


def _copies(rows):
    """Copies by doc_id of ``(doc_id, text, lang, source)``: proportional fitting over cells held in dictionaries."""
    cell = {i: (source, lang, _topic(text)) for i, text, lang, source in rows}
    mass = {}
    for i, text, _, _ in rows:
        mass[cell[i]] = mass.get(cell[i], 0) + -(-len(text.encode()) // 4)
    total = sum(mass.values())
    natural = {s: sum(x for c, x in mass.items() if c[0] == s) ** 0.7 for s, _, _ in mass}
    want = [{s: x / sum(natural.values()) for s, x in natural.items()}]
    for axis, targets in ((1, mixing.LANGUAGES), (2, mixing.TOPICS)):
        present = {k: v for k, v in targets.items() if any(c[axis] == k for c in mass)}
        want.append({k: v / sum(present.values()) for k, v in present.items()})
    weight = {c: float(x) for c, x in mass.items()}
    for _ in range(mixing.ROUNDS):
        for axis in range(3):
            share = {k: sum(x for c, x in weight.items() if c[axis] == k) for k in want[axis]}
            weight = {c: x * want[axis][c[axis]] / share[c[axis]] for c, x in weight.items()}
    out = {}
    for i, *_ in rows:
        wanted = round(weight[cell[i]] * total / mass[cell[i]], 6)
        drawn = int(hashlib.md5(f"3:{i}".encode()).hexdigest()[:13], 16) / (1 << 52)
        out[i] = int(wanted) + (drawn < wanted - int(wanted))
    return out


def test_run_by_plain_loops(spark, data):
    import sentencepiece

    keep = {r["doc_id"] for r in registry.QUERIES["op9_quality"](spark, data).collect() if r["keep"]}  # its own test holds it against plain loops
    docs = {r["doc_id"]: r for r in common.table(spark, data, "documents").collect() if r["doc_id"] in keep}
    key = lambda x: re.sub("[A-Z]", lambda m: m[0].lower(), x.strip(" \t\n\r\x0b\x0c"))
    holders = {}
    for i, r in docs.items():
        for x in r["text"].split("\n"):
            if len(key(x)) >= 20:
                holders.setdefault(key(x), set()).add(i)
    texts = {}
    for i, r in docs.items():
        own = r["text"].split("\n")
        stay = [x for x in own if len(holders.get(key(x), ())) < 3 or i == max(holders[key(x)])]
        if len(stay) == len(own) or "\n".join(stay).strip(" \t\n\r\x0b\x0c"):
            texts[i] = "\n".join(stay)
    component = _brute_components(list(texts.items()))
    alone = [(i, t, docs[i]["lang"], docs[i]["source"]) for i, t in texts.items() if component[i][1] == i]
    lib = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    copies = _copies(alone)
    want = sorted((i, lib.encode(t)) for i, t, _, _ in alone for _ in range(copies[i]))
    got = sorted((r["doc_id"], r["ids"]) for r in corpus_pipeline.run(spark, data).collect())
    assert got == want and len(want) > 50
