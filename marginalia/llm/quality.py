"""Operator 9, quality classifier: a weak-label model over heuristic labellers, whose posteriors train a hashed linear scorer.

1. Each labeller votes good, bad or abstains on every document. The vote patterns (3 ** 9 at most) are counted over all documents.
2. Expectation-maximisation on the pattern counts estimates the share of good documents and, for each labeller, the
   probability of a vote for or against given the class; labellers are independent given the class, and an abstention says nothing.
3. A bounded sample of documents (``train_rows`` at most, by the smallest hashes of doc_id and text), labelled by the posterior of their
   pattern, trains a logistic scorer on hashed 4-byte windows and hashed buckets of the labellers' measures.
4. Every document is scored over its whole text and rejected below ``threshold``.

Gold labels are not used; tests hold the result against them.

Defined results: null text or one without words: score 0, rejected; null doc_id passes through; repeated rows get a row each and count as often,
but are drawn to the sample together or not at all, once; very long texts are counted and scored whole, those over TRAIN_BYTES never train;
an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import operator
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .shingles import mix

FEATURES = 1 << 16
TRAIN_ROWS = 4000
TRAIN_BYTES = 20_000  # longest text in the training sample
THRESHOLD = 0.5
#: Frequent function words of English, German, French and Spanish.
FUNCTION_WORDS = frozenset("the of and to in a is that it for on with as are be by this was at from or an der die das und in zu den von mit ist im nicht ein eine auf für des le la les de et des en un une du est que qui dans pour au sur el los las y en que un una por con se del su es".split())
SYMBOLS = "#*$%&|@^~<>{}[]=+\\_!"
NAMES = ("symbols", "separators", "repeats", "runs", "capitals", "function_words", "punctuation", "variety", "compression")


def measures(text: str) -> tuple[float, ...] | None:
    """One number a labeller; None where there are no words."""
    words = text.split()
    n = len(words)
    if not n:
        return None
    symbols = sum(map(text.count, SYMBOLS)) / n
    separators = sum(map(text.count, ("| ", "***", "$$$", "%%%", "&&&", "###", "!! "))) / n
    same = list(map(operator.eq, words, words[1:]))
    repeats = sum(same) / n
    runs = sum(map(operator.and_, same, same[1:])) / n
    capitals = sum(map(str.isupper, words)) / n
    function = sum(map(FUNCTION_WORDS.__contains__, text.lower().split())) / n
    ends = (text.count(". ") + text.count(".\n") + text.count(", ") + text.endswith(".")) / n
    variety = len(set(words)) / min(n, 400) if n >= 20 else -1.0
    packed = len(zlib.compress(text.encode(), 1)) / len(text) if n >= 20 else -1.0
    return symbols, separators, repeats, runs, capitals, function, ends, variety, packed


def votes(m: tuple[float, ...]) -> tuple[int, ...]:
    """1 good, -1 bad, 0 abstain, one for each of NAMES. Short texts get no vote on what only long ones show."""
    symbols, separators, repeats, runs, capitals, function, ends, variety, packed = m
    step = lambda x, good, bad: 1 if x <= good else -1 if x >= bad else 0
    long = variety >= 0
    return (
        step(symbols, 0.05, 0.25),
        step(separators, 0.02, 0.15),
        step(repeats, 0.05, 0.25),
        step(runs, 0.03, 0.15),
        step(capitals, 0.15, 0.4),
        1 if function >= 0.1 else -1 if long and function < 0.02 else 0,
        1 if 0.02 <= ends <= 0.6 else -1 if long and (ends < 0.01 or ends > 0.9) else 0,
        0 if not long else -1 if variety < 0.2 else 1 if variety > 0.4 else 0,
        0 if not long else -1 if packed < 0.15 else 1 if packed > 0.3 else 0,
    )


def _pattern(v: tuple[int, ...]) -> int:
    out = 0
    for x in v:
        out = out * 3 + x + 1
    return out


def _votes_of(pattern: int) -> tuple[int, ...]:
    out = []
    for _ in NAMES:
        pattern, x = divmod(pattern, 3)
        out.append(x - 1)
    return tuple(reversed(out))


def patterns(docs: DataFrame) -> DataFrame:
    """``doc_id, pattern`` of every row; null pattern where there are no words."""

    def run(batches):
        for batch in batches:
            out = [None if (m := measures(x.as_py() or "")) is None else _pattern(votes(m)) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.int32())], names=["doc_id", "pattern"])

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"]).mapInArrow(common.lean(run), "doc_id long, pattern int")


def label_model(counts: dict[int, int], rounds: int = 200) -> tuple[dict[int, float], np.ndarray]:
    """Posterior of good by pattern, and each labeller's accuracy, from pattern counts."""
    if not counts:
        return {}, np.zeros(len(NAMES))
    keys = sorted(counts)
    n = np.array([counts[k] for k in keys], float)
    v = np.array([_votes_of(k) for k in keys]) + 1
    good = np.where((v == 0).sum(1) < 2, 0.9, 0.1)  # start: two votes against
    for _ in range(rounds):
        prior = (n @ good + 1) / (n.sum() + 2)
        like = np.empty((2, len(keys)))
        tables = np.empty((2, len(NAMES), 3))
        for c, weight in enumerate((n * (1 - good), n * good)):
            for k in range(len(NAMES)):
                hits = np.bincount(v[:, k], weights=weight, minlength=3) + 0.5
                tables[c, k] = hits / (hits[0] + hits[2])
                tables[c, k, 1] = 1  # an abstention says nothing
            like[c] = np.log(np.take_along_axis(tables[c], v.T, 1)).sum(0)
        odds = np.log(prior / (1 - prior)) + like[1] - like[0]
        new = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
        if np.abs(new - good).max() < 1e-9:
            break
        good = new
    accuracy = (1 - prior) * tables[0, :, 0] + prior * tables[1, :, 2]
    return dict(zip(keys, good.tolist(), strict=True)), accuracy


def features(text: str, m: tuple[float, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed features and their values: 4-byte windows with the square root of their share, and one bucket a measure."""
    data = np.frombuffer(text.encode(), np.uint8).astype(np.uint32)
    if len(data) >= 4:
        code = data[:-3] | data[1:-2] << 8 | data[2:-1] << 16 | data[3:] << 24
        slot = (code * np.uint32(0x9E3779B1)) >> np.uint32(16)
        count = np.bincount(slot, minlength=FEATURES)
        at = np.flatnonzero(count)
        value = np.sqrt(count[at] / len(code))
    else:
        at, value = np.zeros(0, np.int64), np.zeros(0)
    buckets = [int(k * 64 + min(63, max(0, x * 40 + 1))) for k, x in enumerate(m)]
    own = (mix(np.array(buckets, np.uint64) + np.uint64(1 << 40)) % np.uint64(FEATURES)).astype(np.int64)
    return np.concatenate([at, own]), np.concatenate([value, np.full(len(own), 0.4)])


def fit(rows: list[tuple[str, float]], rounds: int = 150, rate: float = 2.0, decay: float = 1e-4) -> np.ndarray:
    """Weights (the last is the bias) of a logistic scorer on texts with the probability of being good."""
    made = [(features(t, m), p) for t, p in rows if (m := measures(t)) is not None]
    w = np.zeros(FEATURES + 1)
    if not made:
        return w
    at = np.concatenate([x[0][0] for x in made])
    value = np.concatenate([x[0][1] for x in made])
    owner = np.repeat(np.arange(len(made)), [len(x[0][0]) for x in made])
    p = np.array([x[1] for x in made])
    weight = np.full(len(p), 1 / len(p))
    seen = np.full(FEATURES + 1, 1e-8)
    for _ in range(rounds):
        score = np.bincount(owner, weights=w[at] * value, minlength=len(p)) + w[-1]
        error = (1 / (1 + np.exp(-np.clip(score, -30, 30))) - p) * weight
        gradient = np.bincount(at, weights=error[owner] * value, minlength=FEATURES + 1) + decay * w
        gradient[-1] = error.sum()
        seen += gradient**2
        w -= rate * 0.1 * gradient / np.sqrt(seen)
    return w


def sample(docs: DataFrame, total: int, train_rows: int) -> DataFrame:
    """``text`` of train_rows documents at most, those of the smallest hashes of doc_id and text; ``total`` is about the number of rows."""
    drawn = F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "text")
    # a filter that leaves about twice the sample, so that few rows are sorted, then the bound itself: hashes of texts spread evenly, null ids too
    few = docs.where(F.octet_length("text").between(1, TRAIN_BYTES)).select("text", drawn.alias("drawn")).where(F.pmod("drawn", F.lit(1 << 30)) < F.lit(int((1 << 30) * min(1.0, 2 * train_rows / total))))
    return few.dropDuplicates(["drawn"]).orderBy("drawn").limit(train_rows).select("text")


def train(docs: DataFrame, train_rows: int = TRAIN_ROWS) -> tuple[np.ndarray, dict[int, float], np.ndarray]:
    """Weights of the scorer, posteriors by pattern and labeller accuracies. All rows are counted; train_rows bound only the scorer's sample."""
    spark = docs.sparkSession
    counted = {int(r["pattern"]): int(r["n"]) for r in patterns(docs).where("pattern is not null").groupBy("pattern").agg(F.count("*").alias("n")).collect()}
    posterior, accuracy = label_model(counted)
    total = max(1, sum(counted.values()))
    picked = sample(docs, total, train_rows)
    held = spark.sparkContext.broadcast(posterior)

    def run(batches):
        rows = [(t, held.value.get(_pattern(votes(m)), 0.5)) for b in batches for t in b.column(0).to_pylist() if (m := measures(t)) is not None]
        yield pa.RecordBatch.from_arrays([pa.array([fit(rows).tobytes()], pa.binary())], names=["weights"])

    weights = picked.repartition(1).mapInArrow(common.lean(run), "weights binary").collect()
    return (np.frombuffer(weights[0]["weights"]) if weights else np.zeros(FEATURES + 1)), posterior, accuracy


def score(docs: DataFrame, weights: np.ndarray, posterior: dict[int, float], threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id, weak_label, quality, keep`` of every row; weights and posteriors are of fixed size."""
    held = docs.sparkSession.sparkContext.broadcast((weights, posterior))

    def run(batches):
        w, post = held.value
        for batch in batches:
            weak, out = [], []
            for x in batch.column(1):
                text = x.as_py() or ""
                m = measures(text)
                if m is None:
                    weak.append(0.0)
                    out.append(0.0)
                    continue
                at, value = features(text, m)
                weak.append(post.get(_pattern(votes(m)), 0.5))
                out.append(float(1 / (1 + np.exp(-np.clip(w[at] @ value + w[-1], -30, 30)))))
            keep = [q >= threshold and q > 0 for q in out]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(weak, pa.float64()), pa.array(out, pa.float64()), pa.array(keep, pa.bool_())], names=["doc_id", "weak_label", "quality", "keep"])

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"]).mapInArrow(common.lean(run), "doc_id long, weak_label double, quality double, keep boolean")


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are not rejected; texts pass through the scorer and nothing is shuffled."""
    weights, posterior, _ = train(docs)
    held = docs.sparkSession.sparkContext.broadcast((weights, posterior))

    def run(batches):
        w, _ = held.value
        for batch in batches:
            keep = []
            for x in batch.column("text"):
                text = x.as_py() or ""
                m = measures(text)
                if m is None:
                    keep.append(False)
                    continue
                at, value = features(text, m)
                keep.append(bool(1 / (1 + np.exp(-np.clip(w[at] @ value + w[-1], -30, 30))) >= THRESHOLD))
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(common.lean(run), docs.schema)


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    weights, posterior, _ = train(docs)
    return score(docs, weights, posterior)
