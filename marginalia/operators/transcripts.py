"""Transcripts of model calls: usage by message, cache rebuilds with causes, injections that arrived."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

COUNTERS = ("input_tokens", "output_tokens", "cache_read_input_tokens", "cache_creation_input_tokens")
CAUSES = ("compaction", "model", "version", "idle")


def readable(lines: DataFrame, probe: int = 20, share: float = 0.5) -> DataFrame:
    """Files of which half or more of the first non-empty lines are JSON objects. ``lines``: ``file, line_no, value``."""
    head = lines.where(F.trim("value") != "").withColumn("_n", F.row_number().over(Window.partitionBy("file").orderBy("line_no"))).where(F.col("_n") <= probe)
    is_object = F.startswith(F.ltrim(F.col("value")), F.lit("{")) & F.get_json_object("value", "$").isNotNull()
    return head.groupBy("file").agg(F.avg(F.coalesce(is_object, F.lit(False)).cast("int")).alias("objects")).where(F.col("objects") >= share).select("file")


def parse(lines: DataFrame) -> DataFrame:
    """``file, pos, kind, sidechain, subtype, version, ts, id, model`` and the counters of each line."""
    schema = "type string, isSidechain boolean, subtype string, version string, timestamp string, message struct<id: string, model: string, role: string, usage: struct<" + ", ".join(f"{c}: bigint" for c in COUNTERS) + ">>"
    from ..functions.text import epoch_seconds

    j = lines.withColumn("j", F.from_json("value", schema))
    return j.select("file", F.col("line_no").alias("pos"), F.col("j.type").alias("kind"), F.coalesce("j.isSidechain", F.lit(False)).alias("sidechain"), F.col("j.subtype").alias("subtype"), F.col("j.version").alias("version"), epoch_seconds(F.col("j.timestamp")).alias("ts"), F.col("j.message.id").alias("id"), F.col("j.message.model").alias("model"), *(F.coalesce(F.col(f"j.message.usage.{c}"), F.lit(0)).alias(c) for c in COUNTERS))


def usage(calls: DataFrame) -> DataFrame:
    """Per file: calls and counters, each message counted once with its last values; files of zeros only are left out."""
    last = calls.where("id is not null").groupBy("file", "id").agg(*(F.max_by(c, "pos").alias(c) for c in COUNTERS))
    out = last.groupBy("file").agg(F.count("*").alias("api_calls"), *(F.sum(c).alias(c) for c in COUNTERS))
    return out.where(" + ".join(COUNTERS) + " > 0")


def cache_rebuilds(calls: DataFrame, least: int = 50_000, percent: int = 30, idle: int = 3900) -> DataFrame:
    """Calls that wrote much of the context anew, with all signals and the cause, the first of CAUSES or unattributed.

    A message keeps its first position and its last counters. A compaction marks the next call."""
    w = Window.partitionBy("file").orderBy("pos")
    main = calls.where("not sidechain")
    compacted = main.where("subtype = 'compact_boundary'").select("file", "pos", F.lit(None).cast("string").alias("id"), F.lit(True).alias("compact"))
    per = main.where("id is not null").groupBy("file", "id").agg(F.min("pos").alias("pos"), *(F.max_by(c, "pos").alias(c) for c in (*COUNTERS, "model", "version", "ts")))
    per = per.where(" + ".join(COUNTERS) + " > 0")
    both = per.withColumn("compact", F.lit(False)).unionByName(compacted, allowMissingColumns=True)
    # the flag is carried to the next call: the nearest earlier row is a compaction
    flagged = both.withColumn("_c", F.lag("compact").over(Window.partitionBy("file").orderBy("pos", "compact"))).where("id is not null").withColumn("compaction", F.coalesce("_c", F.lit(False)))
    prior = F.lag(F.col("input_tokens") + F.col("cache_read_input_tokens") + F.col("cache_creation_input_tokens")).over(w)
    seq = flagged.withColumns({"prior": prior, "pm": F.lag("model").over(w), "pv": F.lag("version").over(w), "pt": F.lag("ts").over(w)})
    made = F.col("cache_creation_input_tokens")
    hit = seq.where((made >= least) & (F.col("prior") > 0) & (made * 100 >= F.col("prior") * percent))
    tests = {"compaction": F.col("compaction"), "model": F.col("pm") != F.col("model"), "version": F.col("pv") != F.col("version"), "idle": F.col("ts") - F.col("pt") > idle}
    signals = F.array_compact(F.array(*(F.when(tests[c], F.lit(c)) for c in CAUSES)))
    return hit.select("file", "pos", "id", made.alias("rebuilt_tokens"), F.array_join(signals, ",").alias("signals"), F.coalesce(F.get(signals, F.lit(0)), F.lit("unattributed")).alias("cause"))


def rebuild_totals(rebuilds: DataFrame) -> DataFrame:
    return rebuilds.groupBy("cause").agg(F.count("*").alias("rebuilds"), F.sum("rebuilt_tokens").alias("tokens"))


def verified_injections(lines: DataFrame, marker: str) -> DataFrame:
    """Per file: records that fired an injection and those that show it was delivered; files where none fired are left out.

    Any text inside a record may hold the marker; records of the user don't count."""
    rec = lines.where(F.coalesce(F.get_json_object("value", "$.type"), F.lit("")) != "user")
    fired = F.contains("value", F.lit(f"<{marker}>"))
    delivered = fired & F.contains("value", F.lit(f"</{marker}>"))
    return rec.groupBy("file").agg(F.count(F.when(fired, 1)).alias("fired"), F.count(F.when(delivered, 1)).alias("delivered")).where("fired > 0")
