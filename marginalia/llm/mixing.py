"""Operator 3, mixing sources to target weights (DataFrame functions only): iterative proportional fitting and calibrated sampling.

Token masses are summed per (source, language, topic). Targets for languages and topics are parameters, so their number is known; names
without a target share the rest in their natural proportion. Sources may be many: their targets are their own shares, tempered
by a power, and stay in a table. A round rakes source, language and topic factors; it is one pass over one row per source,
which returns one sum per language and topic to the driver, until no factor moves any more. A document is then wanted ``keep * ratio``
times, ratio being target over natural share of its cell: as often as the whole part of that says, and once more with the
probability of the rest. ``mix_p`` is that number and ``mix_copies`` what was drawn, so the tokens drawn of each cell meet its target.

Defined results: null source, lang: a category of its own; null or empty text: no tokens, and the ratio of its cell (1 where the
cell has no mass); repeated rows with one doc_id are kept or dropped together; null doc_id is drawn as one id; an empty table gives no rows;
columns of the input pass through, whatever their names, and a column named like one of the results is replaced.
"""

from __future__ import annotations

from itertools import product

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

LANGUAGES = {"en": 0.55, "de": 0.15, "fr": 0.15, "es": 0.15}
TOPICS = {"legal": 0.1, "contact": 0.1, "short": 0.2, "medium": 0.35, "long": 0.25}
REST = "*"
NONE = "(none)"
ROUNDS, SETTLED = 25, 1e-12
BROADCAST_SOURCES = 20_000
SALTS = 32


def token_count(text):
    """Tokens by a quarter of the bytes, as the usual estimate has it."""
    return F.ceil(F.octet_length(F.coalesce(text, F.lit(""))) / 4).cast("long")


def topic_of(text):
    """Kind of content by plain rules: licence lines, addresses, else length."""
    n = F.octet_length(text)
    return F.when(text.contains("License") | text.contains("Licensed") | text.contains("Copyright"), "legal").when(text.contains("@"), "contact").when(n < 600, "short").when(n < 6000, "medium").when(n >= 6000, "long").otherwise(NONE)


def _named(col, targets: dict[str, float]):
    return F.when(col.isin(list(targets)), col).otherwise(F.lit(REST))


def _rescaled(targets: dict[str, float], masses: dict[str, float]) -> dict[str, float]:
    """Targets of the names that have mass, to sum 1; REST takes what the others leave, or its natural share where they leave none."""
    total = sum(masses.values())
    given = {k: v for k, v in targets.items() if masses.get(k)}
    if masses.get(REST):
        left = 1 - sum(given.values())
        given[REST] = left if left > 1e-12 else masses[REST] / total
    scale = sum(given.values())
    return {k: v / scale for k, v in given.items()}


def fit(cells: DataFrame, languages: dict[str, float], topics: dict[str, float], power: float, rounds: int) -> DataFrame:
    """``_source, _lang, _topic, ratio`` for each of the cells ``_source, _lang, _topic, mass``."""
    spark = cells.sparkSession
    pairs = list(product([*languages, REST], [*topics, REST]))
    sums = [F.coalesce(F.sum(F.when((F.col("_lang") == lang) & (F.col("_topic") == topic), F.col("mass"))), F.lit(0)).cast("double").alias(f"m{i}") for i, (lang, topic) in enumerate(pairs)]
    sources, _ = common.materialize(spark, cells.groupBy("_source").agg(*sums, F.sum("mass").cast("double").alias("mass")).where("mass > 0"), "sources")
    names = [f"m{i}" for i in range(len(pairs))]
    total = sources.agg(F.sum("mass"), F.sum(F.pow("mass", F.lit(power))), *(F.sum(c) for c in names)).first()
    if not total[0]:
        return cells.select("_source", "_lang", "_topic", F.lit(1.0).alias("ratio"))
    per_lang, per_topic = {}, {}
    for (lang, topic), x in zip(pairs, total[2:], strict=True):
        per_lang[lang] = per_lang.get(lang, 0) + x
        per_topic[topic] = per_topic.get(topic, 0) + x
    want_lang, want_topic = _rescaled(languages, per_lang), _rescaled(topics, per_topic)
    b, c = dict.fromkeys([*languages, REST], 1.0), dict.fromkeys([*topics, REST], 1.0)
    share = F.pow("mass", F.lit(power)) / F.lit(total[1])

    def source_factor():
        weighted = [F.col(n) * F.lit(b[lang] * c[topic]) for n, (lang, topic) in zip(names, pairs, strict=True)]
        whole = weighted[0]
        for x in weighted[1:]:
            whole = whole + x
        return F.when(whole > 0, share / whole).otherwise(F.lit(0.0))

    for _ in range(rounds):
        before = [*b.values(), *c.values()]
        a = source_factor()
        row = sources.select(a.alias("a"), *names).agg(*(F.sum(F.col("a") * F.col(n)) for n in names)).first()
        mass = dict(zip(pairs, row, strict=True))
        for lang in b:
            s = sum(x * c[t] for (g, t), x in mass.items() if g == lang)
            b[lang] = want_lang.get(lang, 0.0) / s if s > 0 else 1.0
        for topic in c:
            s = sum(x * b[g] for (g, t), x in mass.items() if t == topic)
            c[topic] = want_topic.get(topic, 0.0) / s if s > 0 else 1.0
        if all(abs(x - y) <= SETTLED * abs(y) for x, y in zip([*b.values(), *c.values()], before, strict=True)):
            break
    # b and c of the last round, with the source factor of its start
    factors = sources.select("_source", a.alias("a"))
    cased = F.lit(0.0)
    for lang, topic in pairs:
        cased = F.when((F.col("_lang") == lang) & (F.col("_topic") == topic), F.lit(b[lang] * c[topic])).otherwise(cased)
    return cells.join(factors, "_source", "left").select("_source", "_lang", "_topic", F.when(F.col("mass") > 0, F.col("a") * cased * F.lit(float(total[0]))).otherwise(F.lit(1.0)).alias("ratio"))


def draw(key, seed: int):
    """A number in [0, 1) from a key, equal on every run."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("null")))), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def mix(docs: DataFrame, languages: dict[str, float] | None = None, topics: dict[str, float] | None = None, power: float = 0.7, keep: float = 1.0, seed: int = 3, rounds: int = ROUNDS) -> DataFrame:
    """The sampled rows of ``docs`` with ``mix_topic, mix_tokens, mix_p, mix_copies``."""
    languages, topics = languages or LANGUAGES, topics or TOPICS
    spark, own = docs.sparkSession, common.fresh(docs.columns)
    names = {x: own + x for x in ("source", "lang", "topic", "kind", "tokens", "salt", "ratio", "p", "copies")}
    at = lambda x: F.col(names[x])
    on = [names[x] for x in ("source", "lang", "topic")]
    tagged = docs.withColumns({
        names["source"]: F.coalesce("source", F.lit(NONE)), names["lang"]: _named(F.col("lang"), languages), names["kind"]: topic_of(F.col("text")), names["tokens"]: token_count(F.col("text")),
    }).withColumn(names["topic"], _named(at("kind"), topics))
    masses = tagged.groupBy(*on).agg(F.sum(names["tokens"]).alias("mass"), F.count("*").alias("rows")).toDF("_source", "_lang", "_topic", "mass", "rows")
    cells, _ = common.materialize(spark, masses, "cells")
    ratios, _ = common.materialize(spark, fit(cells, languages, topics, power, rounds), "ratios")
    few = ratios.count() <= BROADCAST_SOURCES
    ratios = ratios.toDF(*on, names["ratio"])
    if few:
        joined = tagged.join(F.broadcast(ratios), on)
    else:  # too many for a broadcast: deal each cell to SALTS places, so a source of a third of all rows is split
        salted = ratios.withColumn(names["salt"], F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = tagged.withColumn(names["salt"], F.pmod(F.xxhash64("doc_id", "text"), F.lit(SALTS)).cast("int")).join(salted, [*on, names["salt"]])
    weighed = joined.withColumn(names["p"], F.round(at("ratio") * keep, 6))
    drawn = F.floor(at("p")) + F.when(draw(F.col("doc_id"), seed) < at("p") - F.floor(at("p")), 1).otherwise(0)
    kept = weighed.withColumn(names["copies"], drawn.cast("long")).where(at("copies") > 0)
    columns = [common.column(c) for c in docs.columns if c.lower() not in ("mix_topic", "mix_tokens", "mix_p", "mix_copies")]
    return kept.select(*columns, at("kind").alias("mix_topic"), at("tokens").alias("mix_tokens"), at("p").alias("mix_p"), at("copies").alias("mix_copies"))


def copies(mixed: DataFrame) -> DataFrame:
    """The rows of ``mix`` as often as ``mix_copies`` says. With the rows that ``mix`` drops, token masses meet the targets in expectation, and their total is ``keep`` times that of the input."""
    own = common.fresh(mixed.columns) + "copy"
    return mixed.withColumn(own, F.explode(F.sequence(F.lit(1).cast("long"), F.col("mix_copies")))).drop(own)


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    return mix(docs, keep=0.8).select("doc_id", "source", "lang", F.col("mix_topic").alias("topic"), F.col("mix_tokens").alias("tokens"), F.round("mix_p", 4).alias("p"), F.col("mix_copies").alias("copies"))


def _sql() -> str:
    names = lambda d: ", ".join(f"'{k}'" for k in d)
    values = lambda d: " UNION ALL ".join(f"SELECT '{k}' AS k, CAST({v} AS DOUBLE) AS v" for k, v in d.items())
    head = f"""
WITH t0 AS (SELECT doc_id, source, lang, octet_length(encode(text)) AS n, text FROM documents),
t AS MATERIALIZED (SELECT doc_id, source, lang, coalesce(source, '{NONE}') AS s,
  CASE WHEN lang IN ({names(LANGUAGES)}) THEN lang ELSE '{REST}' END AS g,
  CASE WHEN contains(text, 'License') OR contains(text, 'Licensed') OR contains(text, 'Copyright') THEN 'legal' WHEN contains(text, '@') THEN 'contact'
    WHEN n < 600 THEN 'short' WHEN n < 6000 THEN 'medium' WHEN n >= 6000 THEN 'long' ELSE '{NONE}' END AS kind,
  CAST(ceil(coalesce(n, 0) / 4.0) AS BIGINT) AS tokens FROM t0),
c AS MATERIALIZED (SELECT s, g, CASE WHEN kind IN ({names(TOPICS)}) THEN kind ELSE '{REST}' END AS k, CAST(sum(tokens) AS DOUBLE) AS mass FROM t GROUP BY ALL HAVING sum(tokens) > 0),
ts AS MATERIALIZED (SELECT s, pow(sum(mass), 0.7) / sum(pow(sum(mass), 0.7)) OVER () AS v FROM c GROUP BY s),
tg0 AS (SELECT k, v FROM ({values(LANGUAGES)}) WHERE k IN (SELECT g FROM c)),
tg AS MATERIALIZED (SELECT k, v / sum(v) OVER () AS v FROM tg0),
tk0 AS (SELECT k, v FROM ({values(TOPICS)}) WHERE k IN (SELECT k FROM c)),
tk AS MATERIALIZED (SELECT k, v / sum(v) OVER () AS v FROM tk0),
w0 AS MATERIALIZED (SELECT s, g, k, mass, CAST(1 AS DOUBLE) AS r FROM c)"""
    at, parts = 0, []
    for _ in range(ROUNDS):
        for axis, target, key in (("s", "ts", "s"), ("g", "tg", "k"), ("k", "tk", "k")):
            parts.append(f"w{at + 1} AS MATERIALIZED (SELECT w.s, w.g, w.k, w.mass, w.r * x.v / sum(w.mass * w.r) OVER (PARTITION BY w.{axis}) AS r FROM w{at} w JOIN {target} x ON x.{key} = w.{axis})")
            at += 1
    return (
        head + ",\n" + ",\n".join(parts) + f""",
f AS (SELECT t.*, coalesce(w.r * (SELECT sum(mass) FROM c), 1.0) * 0.8 AS e FROM t LEFT JOIN w{at} w ON w.s = t.s AND w.g = t.g AND w.k = CASE WHEN t.kind IN ({names(TOPICS)}) THEN t.kind ELSE '{REST}' END),
g AS (SELECT *, CAST(floor(q) AS BIGINT) + CASE WHEN CAST('0x' || substr(md5('3:' || coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 13) AS BIGINT) / 4503599627370496.0 < q - floor(q) THEN 1 ELSE 0 END AS copies
  FROM (SELECT *, round(e, 6) AS q FROM f))
SELECT doc_id, source, lang, kind AS topic, tokens, round(q, 4) AS p, copies FROM g WHERE copies > 0
"""
    )


OP3_SQL = _sql()
