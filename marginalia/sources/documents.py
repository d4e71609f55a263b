"""Document trees, notes from other tools, staged candidates and cards."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text


def read_tree(spark: SparkSession, root: str, glob: str = "*.md") -> DataFrame:
    """``path, text, mtime_ns, size`` of all files below a root; hidden ones are skipped by the reader, links aren't followed."""
    raw = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(root)
    base = root.split(":", 1)[-1].rstrip("/")
    path = F.regexp_replace(F.regexp_replace("path", "^[a-z]+:/*", "/"), "^" + re.escape("/" + base.lstrip("/")) + "/", "")
    return raw.where(~path.rlike(r"(^|/)\.")).select(path.alias("path"), F.col("content").cast("string").alias("text"), (F.unix_micros("modificationTime") * 1000).alias("mtime_ns"), F.col("length").alias("size"))


def ignored(path: Column, patterns: list[str]) -> Column:
    """Rules of an ignore file: later ones win, ``!`` takes back, ``/`` at the end names folders, at the start the root."""
    out = F.lit(False)
    for line in patterns:
        line = line.strip()
        if not line or line.startswith("#"):
            continue
        keep = line.startswith("!")
        rule = line.removeprefix("!")
        folder, rooted = rule.endswith("/"), "/" in rule.rstrip("/")
        parts = re.split(r"(\*\*/|\*\*|\*|\?)", rule.strip("/"))
        body = "".join({"**/": "(?:.*/)?", "**": ".*", "*": "[^/]*", "?": "[^/]"}.get(x, re.escape(x)) for x in parts)
        pattern = ("^" if rooted else "(^|.*/)") + body + ("/.*$" if folder else "(/.*)?$")
        out = F.when(path.rlike(pattern), F.lit(not keep)).otherwise(out)
    return out


def collect_files(tree: DataFrame, cards: DataFrame, stores: DataFrame, excluded: list[str]) -> DataFrame:
    """One listing of the tree, managed cards and native stores (``slug, file, ...``); the first source of a path wins."""
    native = stores.withColumn("path", F.concat(F.lit("native:"), "slug", F.lit("/"), "file")).drop("slug", "file")
    rows = tree.withColumn("_o", F.lit(0)).unionByName(cards.withColumn("_o", F.lit(1))).unionByName(native.withColumn("_o", F.lit(2)))
    rows = rows.where(text.indexable(F.col("path"), excluded))
    columns = [c for c in rows.columns if c not in ("path", "_o")]
    return rows.groupBy("path").agg(F.min_by(F.struct(*columns), F.col("_o")).alias("r")).select("path", "r.*")


def import_bugs(rows: DataFrame) -> DataFrame:
    """Notes from a bug log: ``json`` with ``id, title, symptom, cause, fix``; rows without id or title are left out."""
    j = F.from_json("json", "id string, title string, symptom string, cause string, fix string")
    out = rows.select(j.alias("b")).where("b.id is not null and b.title is not null")
    part = lambda name, field: F.when(F.coalesce(field, F.lit("")) != "", F.concat(F.lit(f"## {name}\n\n"), field, F.lit("\n")))
    safe = F.regexp_replace(F.lower("b.id"), "[^a-z0-9._-]", "-")
    body = F.concat_ws("\n", F.lit("---\nring: 3\n---"), F.concat(F.lit("# "), F.col("b.id"), F.lit(": "), F.col("b.title"), F.lit("\n")), part("Symptom", F.col("b.symptom")), part("Cause", F.col("b.cause")), part("Fix", F.col("b.fix")))
    return out.select(F.concat(F.lit("bugs/"), safe, F.lit(".md")).alias("path"), body.alias("text"))


def import_exhaust(rows: DataFrame, host: str) -> DataFrame:
    """Rows of an older event table as log records; their times stay."""
    return rows.select(F.col("ts").cast("long").alias("ts"), F.lit(host).alias("host"), "kind", F.col("session").cast("string").alias("session"), "payload")


def render_candidate(id_: Column, reason: Column, session: Column, host: Column, ts: Column, kind: Column, payload: Column) -> Column:
    """A staged candidate as a note: head lines and its payload in a fence."""
    head = F.concat_ws("\n", F.lit("---"), F.concat(F.lit("id: "), id_), F.concat(F.lit("reason: "), reason), F.concat(F.lit("session: "), session), F.concat(F.lit("host: "), host), F.concat(F.lit("ts: "), ts.cast("string")), F.concat(F.lit("kind: "), kind), F.lit("---"))
    return F.concat(head, F.lit("\n\n```json\n"), payload, F.lit("\n```\n"))


def parse_candidates(notes: DataFrame) -> DataFrame:
    """``id, reason, session, host, ts, kind, payload`` of staged notes (``path, text``); notes that don't parse are left out, newest first."""
    field = lambda k: F.nullif(F.regexp_extract("text", rf"(?m)^{k}:[ \t]*(.*)$", 1), F.lit(""))
    payload = F.nullif(F.regexp_extract("text", r"(?s)```json\n(.*?)\n```", 1), F.lit(""))
    out = notes.select(*(field(k).alias(k) for k in ("id", "reason", "session", "host")), field("ts").cast("long").alias("ts"), field("kind").alias("kind"), payload.alias("payload"))
    return out.where("id is not null and ts is not null and payload is not null").orderBy(F.desc("ts"), "id")


def card_faults(cards: DataFrame, schema: int = 1) -> DataFrame:
    """``path, fault`` of cards whose schema, id or place is wrong or repeated. ``cards``: ``path, json``."""
    j = cards.select("path", F.get_json_object("json", "$.schema").cast("int").alias("schema"), F.get_json_object("json", "$.id").alias("id"))
    n = j.groupBy("id").agg(F.count("*").alias("n"))
    fault = F.when(F.coalesce("schema", F.lit(-1)) != schema, "schema").when(F.col("id").isNull(), "no id").when(F.regexp_extract("path", r"([^/]+)\.json\z", 1) != F.col("id"), "path").when(F.col("n") > 1, "repeated id")
    return j.join(n, "id", "left").select("path", fault.alias("fault")).where("fault is not null")


def search_json(value: str | None, marker: str) -> int:
    """Strings anywhere in a JSON text that hold a marker."""
    try:
        todo, n = [json.loads(value)], 0
    except (TypeError, ValueError):
        return 0
    while todo:
        x = todo.pop()
        if isinstance(x, str):
            n += marker in x
        elif isinstance(x, list):
            todo += x
        elif isinstance(x, dict):
            todo += x.values()
    return n


def marker_count(value: Column, marker: str) -> Column:
    @F.pandas_udf("long")
    def count(column: pd.Series) -> pd.Series:
        return column.map(lambda x: search_json(x, marker))

    return count(value)
