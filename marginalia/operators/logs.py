"""Event-log analytics over rows ``pos, ts, host, session, kind, norm, command, failed, file_path, ring``; pos is the append order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def failure_history(events: DataFrame, query: str = "") -> DataFrame:
    """One row per failed command norm whose text holds all words of the query.

    Recovered: sessions in which a later run of the norm succeeded. Success after failure needs the last success and the first
    failure of a (norm, session) only, so both aggregations combine before their shuffle and no window is needed."""
    words = query.lower().split()
    wanted = events
    for w in words:
        wanted = wanted.where(F.contains("norm", F.lit(w)))
    per = wanted.groupBy("norm", "session").agg(
        F.count(F.when(F.col("failed"), 1)).alias("failures"),
        F.min(F.when(F.col("failed"), F.col("pos"))).alias("first_fail"),
        F.max(F.when(~F.col("failed"), F.col("pos"))).alias("last_ok"),
        F.collect_set(F.when(F.col("failed"), F.col("host"))).alias("hosts"),
        F.min(F.when(F.col("failed"), F.col("ts"))).alias("first_ts"),
        F.max(F.when(F.col("failed"), F.col("ts"))).alias("last_ts"),
        F.max_by("command", F.when(F.col("failed"), F.struct("ts", "pos"))).alias("command"),
        F.max(F.when(F.col("failed"), F.struct("ts", "pos"))).alias("at"),
    ).where("failures > 0")
    out = per.groupBy("norm").agg(
        F.sum("failures").alias("failures"), F.count("*").alias("sessions"), F.count(F.when(F.col("last_ok") > F.col("first_fail"), 1)).alias("recovered"),
        F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_list("hosts")))), ",").alias("hosts"),
        F.min("first_ts").alias("first_ts"), F.max("last_ts").alias("last_ts"), F.max_by("command", "at").alias("last_command"),
    )
    return out.withColumn("exact", F.col("norm") == query.lower())


def failure_totals(events: DataFrame) -> DataFrame:
    """One row: the denominators of the history."""
    return events.agg(F.count(F.when(F.col("failed"), 1)).alias("failures"), F.count("*").alias("runs"), F.count_distinct("session").alias("sessions"), F.count_distinct(F.when(F.col("failed"), F.col("norm"))).alias("norms"))


def fix_discovered(events: DataFrame) -> DataFrame:
    """Per session and norm: the first failure that a later success follows; ts is that of the first such success.

    The last success bounds the failures that have a fix: the first failure before it has one, and its fix is the first success after it."""
    keys = ["session", "norm"]
    bounds = events.groupBy(*keys).agg(F.min(F.when(F.col("failed"), F.struct("pos", "command"))).alias("fail"), F.max(F.when(~F.col("failed"), F.col("pos"))).alias("last_ok")).where(F.col("last_ok") > F.col("fail.pos"))
    later = events.where(~F.col("failed")).join(bounds, keys).where(F.col("pos") > F.col("fail.pos"))
    return later.groupBy(*keys).agg(F.min(F.struct("pos", "ts", "host")).alias("fix"), F.min("fail").alias("fail")).select(*keys, F.col("fail.command").alias("command"), F.col("fail.pos").alias("fail_pos"), F.col("fix.ts").alias("ts"))


def recurring_failures(events: DataFrame, least: int = 2) -> DataFrame:
    """Norms that failed in several sessions: first command, last time, the session seen last for the first time."""
    per = events.where("failed").groupBy("norm", "session").agg(F.min("pos").alias("since"), F.min(F.struct("pos", "command")).alias("first"), F.max(F.struct("pos", "ts")).alias("last"))
    out = per.groupBy("norm").agg(F.count("*").alias("sessions"), F.min("first").alias("f"), F.max("last").alias("l"), F.max_by("session", "since").alias("session")).where(F.col("sessions") >= least)
    return out.select("norm", "sessions", F.col("f.command").alias("command"), F.col("l.ts").alias("ts"), "session")


def hot_files(writes: DataFrame, stopping: str | None = None, sessions: int = 2, writes_: int = 10) -> DataFrame:
    """Files of rings 0 to 3 written in several sessions, or often in one."""
    per = writes.where(F.col("ring").between(0, 3)).groupBy("file_path", "session").agg(F.count("*").alias("n"), F.min(F.struct("pos", "ring")).alias("first"))
    most = F.max("n") if stopping is None else F.max(F.when(F.col("session").cast("string") == stopping, F.col("n")))
    out = per.groupBy("file_path").agg(F.count("*").alias("sessions"), F.coalesce(most, F.lit(0)).alias("most"), F.sum("n").alias("writes"), F.min("first").alias("f"))
    return out.where((F.col("sessions") >= sessions) | (F.col("most") >= writes_)).select("file_path", "sessions", "most", "writes", F.col("f.ring").alias("ring"))


def candidate_id(reason: Column, key: Column) -> Column:
    slug = F.regexp_replace(F.lower(reason), "[^a-z0-9]+", "-")
    return F.concat(slug, F.lit("-"), F.substring(F.sha2(F.concat(reason, F.lit("\0"), key), 256), 1, 8))


def stage(pending: DataFrame, candidates: DataFrame, cap: int = 2000) -> DataFrame:
    """Candidates that are not pending yet, in order, up to the cap of pending ones; then one ``staging-full``.

    The running count is over new candidates only, which the cap bounds by a limit first."""
    room = max(0, cap - pending.count())
    fresh = candidates.join(pending.select("id"), "id", "left_anti").dropDuplicates(["id"])
    taken = fresh.orderBy("ts", "id").limit(room)
    if fresh.limit(room + 1).count() <= room:
        return taken
    full = taken.sparkSession.createDataFrame([("staging-full", "staging-full")], "id string, reason string")
    return taken.unionByName(full, allowMissingColumns=True)


def turn_summary(events: DataFrame) -> DataFrame:
    return events.groupBy("session").pivot("kind", ["bash", "write", "read"]).count().na.fill(0, ["bash", "write", "read"])


def measured_deltas(rows: DataFrame, counters: list[str], lost: str | None = None) -> DataFrame:
    """Growth of cumulative counters per (host, session) in order: never negative, whole at the start, zero where the watermark was lost."""
    w = Window.partitionBy("host", "session").orderBy("pos")
    gone = F.col(lost) if lost else F.lit(False)
    return rows.select("*", *(F.when(gone, F.lit(0)).otherwise(F.greatest(F.lit(0), F.col(c) - F.coalesce(F.lag(c).over(w), F.lit(0)))).cast("long").alias(f"{c}_delta") for c in counters))


def ledger_fold(injections: DataFrame, measured: DataFrame) -> DataFrame:
    """Per session: start, totals by source as a sorted text, measured growth and the last booked value. Negative values count as zero."""
    clean = injections.where("coalesce(session, '') <> '' and coalesce(source, '') <> ''")
    by = clean.groupBy("session", "source").agg(F.count("*").alias("n"), F.sum(F.greatest(F.lit(0), "chars")).alias("chars"), F.min("ts").alias("start"))
    listed = by.groupBy("session").agg(F.min("start").alias("start"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("source", "n", "chars"))), lambda s: F.concat_ws(":", s["source"], s["n"].cast("string"), s["chars"].cast("string"))), ",").alias("sources"))
    grown = measured.groupBy("session").agg(F.sum(F.greatest(F.lit(0), "delta")).alias("measured"), F.max_by("cumulative", F.struct("ts", "pos")).alias("booked"))
    return listed.join(grown, "session", "full_outer")


def audit_sources(injections: DataFrame, budget: int) -> DataFrame:
    """Per source: sessions, injections, characters, tokens, the largest session, whether it is twice over budget, and integer averages."""
    per = injections.groupBy("source", "session").agg(F.count("*").alias("n"), F.sum("chars").alias("chars"), F.sum("tokens").alias("tokens"))
    out = per.groupBy("source").agg(F.count("*").alias("sessions"), F.sum("n").alias("injections"), F.sum("chars").alias("chars"), F.sum("tokens").alias("tokens"), F.max("chars").alias("max_session_chars"))
    return out.select("*", (F.col("max_session_chars") > 2 * budget).alias("warn"), F.expr("tokens div sessions").alias("avg_tokens"), F.expr("(tokens div sessions) * (injections div sessions)").alias("recurring"))


def staging_stats(candidates: DataFrame) -> DataFrame:
    order = F.when(F.col("reason") == "fix-discovered", 0).when(F.col("reason") == "recurring-failure", 1).when(F.col("reason") == "hot-file", 2).otherwise(3)
    return candidates.groupBy("reason").agg(F.count("*").alias("n")).withColumn("place", F.row_number().over(Window.orderBy(order, "reason")))


def evidence_coverage(matched: DataFrame) -> DataFrame:
    """Per candidate: whether the events at hand back its reason."""
    out = matched.groupBy("id", "reason").agg(F.bool_or("failed").alias("bad"), F.bool_or(~F.col("failed")).alias("good"), F.count_distinct("session").alias("sessions"), F.count("*").alias("n"))
    fine = F.when(F.col("reason") == "fix-discovered", F.col("bad") & F.col("good")).when(F.col("reason") == "recurring-failure", F.col("sessions") >= 2).otherwise((F.col("sessions") >= 2) | (F.col("n") >= 10))
    return out.withColumn("covered", fine)


def match_candidates(candidates: DataFrame, events: DataFrame) -> DataFrame:
    """Events of each candidate: by norm, by file or by host and session, each an equal join of its own."""
    by_norm = candidates.where("reason in ('fix-discovered', 'recurring-failure')").join(events, F.col("norm") == F.col("key")).where("reason <> 'fix-discovered' or session = at_session")
    by_file = candidates.where("reason = 'hot-file'").join(events, F.col("file_path") == F.col("key"))
    return by_norm.unionByName(by_file)


def runs(rows: DataFrame, partition: list[str], order: str, flag: str) -> DataFrame:
    """Lengths of consecutive rows with ``flag`` set: gaps and islands."""
    w = Window.partitionBy(*partition).orderBy(order)
    island = F.row_number().over(w) - F.row_number().over(Window.partitionBy(*partition, flag).orderBy(order))
    return rows.withColumn("_i", island).where(flag).groupBy(*partition, "_i").agg(F.count("*").alias("length"), F.min(order).alias("since")).drop("_i")


def liveness(beats: DataFrame, registered: DataFrame, failing: int = 3) -> DataFrame:
    """Per hook: unobserved, healthy or failing (so many failures since the last success); unregistered hooks are listed too."""
    last = beats.groupBy("hook").agg(F.max(F.when(F.col("ok"), F.col("pos"))).alias("last_ok"))
    since = beats.join(last, "hook").where("not ok and pos > coalesce(last_ok, -1)").groupBy("hook").agg(F.count("*").alias("streak"))
    seen = last.select("hook").join(since, "hook", "left").na.fill(0, ["streak"]).withColumn("seen", F.lit(True))
    out = registered.select("hook").withColumn("registered", F.lit(True)).join(seen, "hook", "full_outer")
    state = F.when(F.col("seen").isNull(), "unobserved").when(F.col("streak") >= failing, "failing").otherwise("healthy")
    return out.select("hook", F.coalesce("registered", F.lit(False)).alias("registered"), F.coalesce("streak", F.lit(0)).cast("long").alias("streak"), state.alias("state"))


def staleness_onset(observations: DataFrame) -> DataFrame:
    """Per host: the first disagreement since the last agreement, null where the last observation agrees."""
    agreed = observations.groupBy("host").agg(F.max(F.when(F.col("fresh"), F.col("pos"))).alias("ok"))
    return observations.join(agreed, "host").groupBy("host").agg(F.min(F.when(~F.col("fresh") & (F.col("pos") > F.coalesce("ok", F.lit(-1))), F.col("ts"))).alias("stale_since"))


def repeat_reads(events: DataFrame) -> DataFrame:
    """Reads of a file that the session has read since its last write, the first repeat of each stretch only."""
    w = Window.partitionBy("session", "file_path").orderBy("pos")
    stretch = F.sum((F.col("kind") == "write").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    reads = events.withColumn("_s", stretch).where("kind = 'read'")
    nth = F.row_number().over(Window.partitionBy("session", "file_path", "_s").orderBy("pos"))
    return reads.withColumn("_n", nth).where("_n = 2").drop("_s", "_n")


def cadence(events: DataFrame, every: int = 25) -> DataFrame:
    """Every n-th event of a session."""
    n = F.row_number().over(Window.partitionBy("session").orderBy("pos"))
    return events.withColumn("count", n).where(F.col("count") % every == 0)


def once_per(events: DataFrame, keys: list[str]) -> DataFrame:
    return events.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy("pos"))).where("_n = 1").drop("_n")


def status_nudges(events: DataFrame, least: int = 3) -> DataFrame:
    """Sessions with several writes and none of their status file."""
    out = events.where("kind = 'write'").groupBy("session").agg(F.count("*").alias("writes"), F.bool_or(F.endswith("file_path", F.lit("STATUS.md"))).alias("status"))
    return out.where((F.col("writes") >= least) & ~F.col("status")).select("session", "writes")
