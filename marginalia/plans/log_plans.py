"""Queries of the event-log, ledger, transcript and comparison operators."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import comparison, logs, transcripts
from ..sources import documents, jsonl
from . import base
from .base import EVENTS_SQL
from .registry import query

EV = f"WITH {EVENTS_SQL}"


def _bash(spark, d):
    return base.events(spark, d).where("kind = 'bash'")


@query("g6_f7_failure_history", f"""{EV}, w AS (SELECT * FROM bash WHERE contains(norm, 'job')), p AS (SELECT norm, session, count(*) FILTER (WHERE failed) AS f, min(pos) FILTER (WHERE failed) AS ff, max(pos) FILTER (WHERE NOT failed) AS lo FROM w GROUP BY ALL HAVING count(*) FILTER (WHERE failed) > 0),
a AS (SELECT norm, CAST(sum(f) AS BIGINT) AS failures, count(*) AS sessions, count(*) FILTER (WHERE lo > ff) AS recovered FROM p GROUP BY norm)
SELECT a.*, (SELECT string_agg(DISTINCT host, ',' ORDER BY host) FROM w WHERE w.norm = a.norm AND failed) AS hosts, (SELECT min(ts) FROM w WHERE w.norm = a.norm AND failed) AS first_ts, (SELECT max(ts) FROM w WHERE w.norm = a.norm AND failed) AS last_ts,
  (SELECT command FROM w WHERE w.norm = a.norm AND failed ORDER BY ts DESC, pos DESC LIMIT 1) AS last_command FROM a""")
def _(spark, d):
    return logs.failure_history(_bash(spark, d), "job").drop("exact")


@query("g6_failure_totals", f"{EV} SELECT count(*) FILTER (WHERE failed) AS failures, count(*) AS runs, count(DISTINCT session) AS sessions, count(DISTINCT norm) FILTER (WHERE failed) AS norms FROM bash")
def _(spark, d):
    return logs.failure_totals(_bash(spark, d))


@query("g7_j13_fix_discovered", f"""{EV}, f AS (SELECT session, norm, pos, command, min(pos) OVER (PARTITION BY session, norm) AS first FROM bash WHERE failed), ff AS (SELECT * FROM f WHERE pos = first),
s AS (SELECT ff.session, ff.norm, ff.command, ff.pos AS fail_pos, min(b.pos) AS fix FROM ff JOIN bash b ON b.session = ff.session AND b.norm = ff.norm AND NOT b.failed AND b.pos > ff.pos GROUP BY ALL)
SELECT s.session, s.norm, s.command, s.fail_pos, b.ts FROM s JOIN bash b ON b.pos = s.fix""")
def _(spark, d):
    return logs.fix_discovered(_bash(spark, d))


@query("g8_recurring_failure", f"""{EV}, f AS (SELECT * FROM bash WHERE failed), s AS (SELECT norm, session, min(pos) AS since FROM f GROUP BY ALL)
SELECT norm, count(DISTINCT session) AS sessions, arg_min(command, pos) AS command, arg_max(ts, pos) AS ts, (SELECT arg_max(session, since) FROM s WHERE s.norm = f.norm) AS session FROM f GROUP BY norm HAVING count(DISTINCT session) >= 2""")
def _(spark, d):
    return logs.recurring_failures(_bash(spark, d))


@query("g9_hot_files", f"""{EV}, w AS (SELECT * FROM evs WHERE kind = 'write' AND ring BETWEEN 0 AND 3), s AS (SELECT file_path, session, count(*) AS n FROM w GROUP BY ALL)
SELECT file_path, count(*) AS sessions, max(n) AS most, CAST(sum(n) AS BIGINT) AS writes, (SELECT arg_min(ring, pos) FROM w WHERE w.file_path = s.file_path) AS ring FROM s GROUP BY file_path HAVING count(*) >= 2 OR max(n) >= 10""")
def _(spark, d):
    return logs.hot_files(base.events(spark, d).where("kind = 'write'"))


@query("g10_turn_summary", f"{EV} SELECT session, count(*) FILTER (WHERE kind = 'bash') AS bash, count(*) FILTER (WHERE kind = 'write') AS write, count(*) FILTER (WHERE kind = 'read') AS read FROM evs GROUP BY session")
def _(spark, d):
    return logs.turn_summary(base.events(spark, d))


@query("g11_candidate_ids", f"{EV} SELECT DISTINCT norm, 'recurring-failure-' || substr(sha256('recurring failure' || chr(0) || norm), 1, 8) AS id FROM bash")
def _(spark, d):
    return _bash(spark, d).select("norm", logs.candidate_id(F.lit("recurring failure"), F.col("norm")).alias("id")).distinct()


@query("g11_staging_cap", f"{EV}, c AS (SELECT DISTINCT 'c' || k AS id, k AS ts FROM evs WHERE k >= 10 ORDER BY ts, id LIMIT 40) SELECT id FROM c UNION ALL SELECT 'staging-full'")
def _(spark, d):
    c = base.events(spark, d).select(F.concat(F.lit("c"), F.col("k").cast("string")).alias("id"), F.lit("r").alias("reason"), F.col("k").alias("ts")).dropDuplicates(["id"])
    return logs.stage(c.where("ts < 10"), c, 50).select("id")


@query("g12_staging_stats", f"{EV}, r AS (SELECT CASE k % 4 WHEN 0 THEN 'hot-file' WHEN 1 THEN 'fix-discovered' WHEN 2 THEN 'recurring-failure' ELSE 'else' END AS reason FROM evs) SELECT reason, count(*) AS n, CAST(CASE reason WHEN 'fix-discovered' THEN 1 WHEN 'recurring-failure' THEN 2 WHEN 'hot-file' THEN 3 ELSE 4 END AS INTEGER) AS place FROM r GROUP BY reason")
def _(spark, d):
    k = F.col("k") % 4
    return logs.staging_stats(base.events(spark, d).select(F.when(k == 0, "hot-file").when(k == 1, "fix-discovered").when(k == 2, "recurring-failure").otherwise("else").alias("reason")))


@query("g13_ledger_fold", f"""{EV}, i AS (SELECT session, CASE WHEN k % 10 = 0 THEN '' ELSE 'src' || (k % 4) END AS source, greatest(0, k - 20) AS chars, ts, pos FROM evs WHERE kind = 'read'), c AS (SELECT * FROM i WHERE source <> ''),
b AS (SELECT session, source, count(*) AS n, sum(chars) AS chars, min(ts) AS start FROM c GROUP BY ALL), l AS (SELECT session, min(start) AS start, string_agg(source || ':' || n || ':' || chars, ',' ORDER BY source) AS sources FROM b GROUP BY session),
m AS (SELECT session, CAST(sum(greatest(0, k - 50)) AS BIGINT) AS measured, arg_max(k, ts * 1000000 + pos) AS booked FROM evs WHERE kind = 'bash' GROUP BY session)
SELECT session, start, sources, measured, booked FROM l FULL JOIN m USING (session)""")
def _(spark, d):
    e = base.events(spark, d)
    inj = e.where("kind = 'read'").select("session", F.when(F.col("k") % 10 == 0, "").otherwise(F.concat(F.lit("src"), (F.col("k") % 4).cast("string"))).alias("source"), (F.col("k") - 20).alias("chars"), "ts")
    return logs.ledger_fold(inj, e.where("kind = 'bash'").select("session", "ts", "pos", (F.col("k") - 50).alias("delta"), F.col("k").alias("cumulative")))


@query("g14_s9_measured_deltas", f"{EV} SELECT pos, CAST(CASE WHEN k % 17 = 0 THEN 0 ELSE greatest(0, k - coalesce(lag(k) OVER (PARTITION BY host, session ORDER BY pos), 0)) END AS BIGINT) AS k_delta FROM evs")
def _(spark, d):
    e = base.events(spark, d).withColumn("lost", F.col("k") % 17 == 0)
    return logs.measured_deltas(e, ["k"], "lost").select("pos", "k_delta")


@query("g15_j16_audit_sources", f"""{EV}, p AS (SELECT 'src' || (k % 6) AS source, session, count(*) AS n, sum(k) AS chars, sum(k // 4) AS tokens FROM evs GROUP BY ALL)
SELECT source, count(*) AS sessions, CAST(sum(n) AS BIGINT) AS injections, CAST(sum(chars) AS BIGINT) AS chars, CAST(sum(tokens) AS BIGINT) AS tokens, CAST(max(chars) AS BIGINT) AS max_session_chars, max(chars) > 1600 AS warn,
  CAST(sum(tokens) // count(*) AS BIGINT) AS avg_tokens, CAST((sum(tokens) // count(*)) * (sum(n) // count(*)) AS BIGINT) AS recurring FROM p GROUP BY source""")
def _(spark, d):
    e = base.events(spark, d).select(F.concat(F.lit("src"), (F.col("k") % 6).cast("string")).alias("source"), "session", F.col("k").alias("chars"), F.expr("k div 4").alias("tokens"))
    return logs.audit_sources(e, 800)


@query("f8_time_window", f"{EV} SELECT pos FROM evs WHERE ts >= 1704672000")
def _(spark, d):
    return base.events(spark, d).where("ts >= 1704672000").select("pos")


@query("f10_j17_candidate_events", f"""{EV} SELECT 'a' AS id, pos FROM evs WHERE norm = 'run job n3' AND session = 's5' UNION ALL SELECT 'b', pos FROM evs WHERE norm = 'run job n4' UNION ALL SELECT 'c', pos FROM evs WHERE file_path = 'notes/f7.md'""")
def _(spark, d):
    c = spark.createDataFrame([("a", "fix-discovered", "run job n3", "s5"), ("b", "recurring-failure", "run job n4", None), ("c", "hot-file", "notes/f7.md", None)], "id string, reason string, key string, at_session string")
    return logs.match_candidates(c, base.events(spark, d)).select("id", "pos")


@query("f11_evidence_coverage", f"""{EV}, m AS (SELECT 'b' || (k % 11) AS id, CASE k % 11 % 3 WHEN 0 THEN 'fix-discovered' WHEN 1 THEN 'recurring-failure' ELSE 'hot-file' END AS reason, failed, session FROM evs WHERE kind = 'bash')
SELECT id, CASE reason WHEN 'fix-discovered' THEN bool_or(failed) AND bool_or(NOT failed) WHEN 'recurring-failure' THEN count(DISTINCT session) >= 2 ELSE count(DISTINCT session) >= 2 OR count(*) >= 10 END AS covered FROM m GROUP BY id, reason""")
def _(spark, d):
    k = F.col("k") % 11
    m = _bash(spark, d).select(F.concat(F.lit("b"), k.cast("string")).alias("id"), F.when(k % 3 == 0, "fix-discovered").when(k % 3 == 1, "recurring-failure").otherwise("hot-file").alias("reason"), "failed", "session")
    return logs.evidence_coverage(m).select("id", "covered")


@query("g27_j18_liveness", f"""{EV}, b AS (SELECT 'hook' || (k % 9) AS hook, NOT failed AS ok, pos FROM bash WHERE k % 9 < 7), l AS (SELECT hook, max(pos) FILTER (WHERE ok) AS ok FROM b GROUP BY hook),
s AS (SELECT l.hook, (SELECT count(*) FROM b WHERE b.hook = l.hook AND NOT b.ok AND b.pos > coalesce(l.ok, -1)) AS streak FROM l), r AS (SELECT 'hook' || i AS hook FROM range(2, 9) t(i))
SELECT coalesce(r.hook, s.hook) AS hook, r.hook IS NOT NULL AS registered, coalesce(streak, 0) AS streak, CASE WHEN s.hook IS NULL THEN 'unobserved' WHEN streak >= 3 THEN 'failing' ELSE 'healthy' END AS state FROM r FULL JOIN s ON r.hook = s.hook""")
def _(spark, d):
    beats = _bash(spark, d).where("k % 9 < 7").select(F.concat(F.lit("hook"), (F.col("k") % 9).cast("string")).alias("hook"), (~F.col("failed")).alias("ok"), "pos")
    return logs.liveness(beats, spark.range(2, 9).select(F.concat(F.lit("hook"), F.col("id").cast("string")).alias("hook")))


@query("w12_failure_runs", f"""{EV}, x AS (SELECT *, row_number() OVER (PARTITION BY session ORDER BY pos) - row_number() OVER (PARTITION BY session, failed ORDER BY pos) AS i FROM bash)
SELECT session, count(*) AS length, min(pos) AS since FROM x WHERE failed GROUP BY session, i""")
def _(spark, d):
    return logs.runs(_bash(spark, d), ["session"], "pos", "failed")


@query("w11_staleness_onset", f"{EV}, a AS (SELECT host, max(pos) FILTER (WHERE NOT failed) AS ok FROM bash GROUP BY host) SELECT b.host, min(ts) FILTER (WHERE failed AND pos > coalesce(ok, -1)) AS stale_since FROM bash b JOIN a ON a.host = b.host GROUP BY b.host")
def _(spark, d):
    return logs.staleness_onset(_bash(spark, d).select("host", "pos", "ts", (~F.col("failed")).alias("fresh")))


@query("w2_j14_previous_call", "SELECT conv_id, turn, length(text) - coalesce(lag(length(text)) OVER (PARTITION BY conv_id ORDER BY turn), 0) AS grown FROM conversations")
def _(spark, d):
    n = F.char_length("text").cast("long")
    return base.table(spark, d, "conversations").select("conv_id", "turn", (n - F.coalesce(F.lag(n).over(Window.partitionBy("conv_id").orderBy("turn")), F.lit(0))).alias("grown"))


@query("w9_s8_cadence", f"{EV} SELECT pos, n AS count FROM (SELECT pos, CAST(row_number() OVER (PARTITION BY session ORDER BY pos) AS INTEGER) AS n FROM evs) WHERE n % 5 = 0")
def _(spark, d):
    return logs.cadence(base.events(spark, d), 5).select("pos", "count")


@query("w10_once_per_session", f"{EV} SELECT min(pos) AS pos FROM evs GROUP BY session, file_path")
def _(spark, d):
    return logs.once_per(base.events(spark, d), ["session", "file_path"]).select("pos")


_READS = """x AS (SELECT *, 'f' || (k % 5) AS file FROM evs WHERE kind <> 'bash'), y AS (SELECT *, count(*) FILTER (WHERE kind = 'write') OVER (PARTITION BY session, file ORDER BY pos ROWS UNBOUNDED PRECEDING) AS s FROM x),
z AS (SELECT *, row_number() OVER (PARTITION BY session, file, s ORDER BY pos) AS n FROM y WHERE kind = 'read')"""


@query("s7_repeat_reads", f"{EV}, {_READS} SELECT pos FROM z WHERE n = 2")
def _(spark, d):
    e = base.events(spark, d).where("kind <> 'bash'").withColumn("file_path", F.concat(F.lit("f"), (F.col("k") % 5).cast("string")))
    return logs.repeat_reads(e).select("pos")


@query("s14_status_nudges", f"{EV}, w AS (SELECT session, count(*) AS writes, bool_or(k % 40 = 3) AS st FROM evs WHERE kind = 'write' GROUP BY session) SELECT session, writes FROM w WHERE writes >= 3 AND NOT st")
def _(spark, d):
    e = base.events(spark, d)
    return logs.status_nudges(e.withColumn("file_path", F.when(F.col("k") % 40 == 3, "x/STATUS.md").otherwise(F.col("file_path"))))


# ---- log files: lines rendered from the events, one torn and one of another version per file set


def _lines(spark, d):
    e = base.events(spark, d)
    line = F.to_json(F.struct(F.when((F.col("host") == "h2") & (F.col("pos") % 100 == 2), 2).otherwise(1).alias("v"), "ts", "host", "kind", "session", "pos"))
    return e.select(F.concat(F.lit("logs/"), F.col("host")).alias("file"), F.col("host"), F.col("pos").alias("line_no"), "pos", F.when((F.col("host") == "h1") & (F.col("pos") % 500 == 4), F.substring(line, 1, 20)).otherwise(line).alias("value"))


@query("a8_s15_read_all", f"{EV} SELECT count(*) AS records, min(ts) AS first_ts, max(ts) AS last_ts FROM evs WHERE host <> CASE WHEN (SELECT count(*) FROM evs WHERE host = 'h2' AND pos % 100 = 2) > 0 THEN 'h2' ELSE '' END AND NOT (host = 'h1' AND pos % 500 = 4)")
def _(spark, d):
    records, _files = jsonl.read_all(_lines(spark, d))
    return records.agg(F.count("*").alias("records"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


@query("a8_file_states", f"{EV} SELECT 'logs/' || host AS file, count(*) FILTER (WHERE host = 'h1' AND pos % 500 = 4) AS torn_lines, count(*) FILTER (WHERE host = 'h2' AND pos % 100 = 2) = 0 AS readable FROM evs GROUP BY host")
def _(spark, d):
    return jsonl.read_all(_lines(spark, d))[1]


@query("a9_w7_tail", f"{EV}, l AS (SELECT host, pos, octet_length(encode(session)) + 1 AS n FROM evs), s AS (SELECT *, sum(n) OVER (PARTITION BY host ORDER BY pos DESC ROWS UNBOUNDED PRECEDING) AS c, sum(n) OVER (PARTITION BY host) AS t FROM l) SELECT host, pos, t > 700 AS truncated FROM s WHERE c <= 700")
def _(spark, d):
    return jsonl.tail(base.events(spark, d).select("host", "pos", F.col("session").alias("value")), 700).select("host", "pos", "truncated")


@query("a7_append_roundtrip", f"{EV} SELECT host, count(*) AS n FROM evs GROUP BY host")
def _(spark, d):
    path = base.shared_path(spark, "log")
    jsonl.append(base.events(spark, d).select("ts", "host", "kind", "session"), path)
    return jsonl.decode(jsonl.lines(spark, path + "/*")).groupBy("host").agg(F.count("*").alias("n"))


@query("a7_rotation", f"""{EV}, l AS (SELECT host, pos, length(command) + 1 AS n FROM evs), s AS (SELECT *, sum(n) OVER (PARTITION BY host ORDER BY pos DESC) AS upto FROM l)
SELECT host, CAST(sum(n) AS BIGINT) AS bytes, min(pos) AS oldest FROM s WHERE upto <= 2 * 4000 GROUP BY host""")
def _(spark, d):
    """What two generations of 4,000 bytes keep of each host's log."""
    rows = base.events(spark, d).select("host", "pos", F.col("command").alias("value"))
    kept = jsonl.rotate(rows, 4000)
    return jsonl.footprint(kept).join(kept.groupBy("host").agg(F.min("pos").alias("oldest")), "host")


@query("s4_coverage_barrier", f"""{EV}, x AS (SELECT pos, CASE WHEN k % 13 = 0 THEN NULL ELSE k % 5 END AS entry, CAST(k % 3 AS INTEGER) AS applied, ts, ts + k % 7 - 4 AS walk, k % 100 AS ms FROM evs)
SELECT pos, CASE WHEN entry IS NULL OR ms > 80 THEN false ELSE entry = applied OR walk >= ts END AS fresh,
  CASE WHEN entry IS NULL THEN 'barrier unavailable: no fingerprint of the tree' WHEN ms > 80 THEN 'barrier over budget: a walk took ' || ms || ' ms, the budget is 80 ms'
  WHEN NOT (entry = applied OR walk >= ts) THEN 'barrier timeout: no scan has covered the tree as of this query' ELSE '' END AS note FROM x""")
def _(spark, d):
    """Events as queries: their numbers give the fingerprints, the times and the cost of the walk."""
    from ..streaming import sessions

    k = F.col("k")
    fresh, note = sessions.coverage_barrier(F.when(k % 13 != 0, k % 5), F.col("ts"), k % 3, F.col("ts") + k % 7 - 4, k % 100, F.lit(80))
    return base.events(spark, d).select("pos", fresh.alias("fresh"), note.alias("note"))


@query("a16_import_exhaust", f"{EV} SELECT ts, 'old' AS host, kind, session FROM evs")
def _(spark, d):
    return documents.import_exhaust(base.events(spark, d).withColumn("payload", F.lit("{}")), "old").drop("payload")


# ---- transcripts: each conversation is a file, each turn a message


def _calls(spark, d):
    c = base.table(spark, d, "conversations")
    n = F.char_length("text").cast("long")
    usage = F.struct((n % 100).alias("input_tokens"), (n % 50).alias("output_tokens"), (n * 100).alias("cache_read_input_tokens"), (n * 173 % 90000).alias("cache_creation_input_tokens"))
    message = F.struct(F.concat(F.lit("m"), (F.col("turn") - F.col("turn") % 2 * (F.col("conv_id") % 2)).cast("string")).alias("id"), F.when(F.col("turn") > 3, "large").otherwise("small").alias("model"), F.col("role").alias("role"), usage.alias("usage"))
    stamp = F.concat(F.lit("2024-01-01T0"), (F.col("turn") % 10).cast("string"), F.lit(":00:00Z"))
    sub = F.when(F.col("role") == "system", "compact_boundary")
    line = F.to_json(F.struct(F.lit("assistant").alias("type"), (F.col("conv_id") % 13 == 0).alias("isSidechain"), sub.alias("subtype"), F.concat(F.lit("v"), F.expr("turn div 3").cast("string")).alias("version"), stamp.alias("timestamp"), message.alias("message")))
    return c.select(F.concat(F.lit("c"), F.col("conv_id").cast("string")).alias("file"), F.col("turn").alias("line_no"), line.alias("value"))


_CALLS_SQL = """c AS (SELECT 'c' || conv_id AS file, turn AS pos, 'm' || (turn - turn % 2 * (conv_id % 2)) AS id, CASE WHEN turn > 3 THEN 'large' ELSE 'small' END AS model, 'v' || (turn // 3) AS version, 1704067200 + (turn % 10) * 3600 AS ts, conv_id % 13 = 0 AS side,
  length(text) % 100 AS i, length(text) % 50 AS o, length(text) * 100 AS r, length(text) * 173 % 90000 AS w FROM conversations)"""


@query("a10_readable_transcripts", "SELECT 'c' || conv_id AS file FROM conversations GROUP BY conv_id HAVING avg(CASE WHEN turn % 3 = 1 OR conv_id % 7 = 0 THEN 0 ELSE 1 END) >= 0.5")
def _(spark, d):
    lines = base.table(spark, d, "conversations").select(F.concat(F.lit("c"), F.col("conv_id").cast("string")).alias("file"), F.col("turn").alias("line_no"), F.when((F.col("turn") % 3 == 1) | (F.col("conv_id") % 7 == 0), "no json").otherwise('{"a": 1}').alias("value"))
    return transcripts.readable(lines)


@query("g16_w4_transcript_usage", f"""WITH {_CALLS_SQL}, l AS (SELECT file, id, arg_max(i, pos) AS i, arg_max(o, pos) AS o, arg_max(r, pos) AS r, arg_max(w, pos) AS w FROM c GROUP BY ALL)
SELECT file, count(*) AS api_calls, CAST(sum(i) AS BIGINT) AS input_tokens, CAST(sum(o) AS BIGINT) AS output_tokens, CAST(sum(r) AS BIGINT) AS cache_read_input_tokens, CAST(sum(w) AS BIGINT) AS cache_creation_input_tokens FROM l GROUP BY file HAVING sum(i) + sum(o) + sum(r) + sum(w) > 0""")
def _(spark, d):
    return transcripts.usage(transcripts.parse(_calls(spark, d)))


_REBUILDS = f"""{_CALLS_SQL}, sys AS (SELECT 'c' || conv_id AS file, turn AS pos FROM conversations WHERE role = 'system' AND conv_id % 13 <> 0),
l AS (SELECT file, id, min(pos) AS pos, arg_max(i, pos) AS i, arg_max(o, pos) AS o, arg_max(r, pos) AS r, arg_max(w, pos) AS w, arg_max(model, pos) AS model, arg_max(version, pos) AS version, arg_max(ts, pos) AS ts FROM c WHERE NOT side GROUP BY file, id),
u AS (SELECT *, false AS compact FROM l WHERE i + o + r + w > 0 UNION ALL SELECT file, NULL, pos, NULL, NULL, NULL, NULL, NULL, NULL, NULL, true FROM sys),
f AS (SELECT *, coalesce(lag(compact) OVER (PARTITION BY file ORDER BY pos, compact), false) AS cp FROM u), g AS (SELECT *, lag(i + r + w) OVER win AS prior, lag(model) OVER win AS pm, lag(version) OVER win AS pv, lag(ts) OVER win AS pt FROM f WHERE id IS NOT NULL WINDOW win AS (PARTITION BY file ORDER BY pos)),
h AS (SELECT file, pos, id, w AS rebuilt_tokens, list_filter([CASE WHEN cp THEN 'compaction' END, CASE WHEN pm <> model THEN 'model' END, CASE WHEN pv <> version THEN 'version' END, CASE WHEN ts - pt > 3900 THEN 'idle' END], lambda x: x IS NOT NULL) AS s FROM g WHERE w >= 50000 AND prior > 0 AND w * 100 >= prior * 30)"""


@query("g17_w5_cache_rebuilds", f"WITH {_REBUILDS} SELECT file, pos, id, rebuilt_tokens, array_to_string(s, ',') AS signals, coalesce(s[1], 'unattributed') AS cause FROM h")
def _(spark, d):
    return _rebuilds(spark, d)


def _rebuilds(spark, d):
    lines = _calls(spark, d)
    parsed = transcripts.parse(lines)
    return transcripts.cache_rebuilds(parsed)


@query("g18_rebuild_totals", f"WITH {_REBUILDS} SELECT coalesce(s[1], 'unattributed') AS cause, count(*) AS rebuilds, CAST(sum(rebuilt_tokens) AS BIGINT) AS tokens FROM h GROUP BY 1")
def _(spark, d):
    return transcripts.rebuild_totals(_rebuilds(spark, d))


@query("g19_verified_injections", "WITH x AS (SELECT conv_id, role, turn % 3 = 0 AS fired, turn % 2 = 0 AS done FROM conversations) SELECT 'c' || conv_id AS file, count(*) FILTER (WHERE fired) AS fired, count(*) FILTER (WHERE fired AND done) AS delivered FROM x WHERE role <> 'user' GROUP BY conv_id HAVING count(*) FILTER (WHERE fired) > 0")
def _(spark, d):
    c = base.table(spark, d, "conversations")
    body = F.concat(F.when(F.col("turn") % 3 == 0, "<note>").otherwise(""), F.lit("x"), F.when((F.col("turn") % 3 == 0) & (F.col("turn") % 2 == 0), "</note>").otherwise(""))
    return transcripts.verified_injections(c.select(F.concat(F.lit("c"), F.col("conv_id").cast("string")).alias("file"), F.to_json(F.struct(F.col("role").alias("type"), F.array(body).alias("content"))).alias("value")), "note")


# ---- arms: odd customers are bare, even ones treated; a market segment and nation pair them


def _sessions(spark, d):
    o = base.table(spark, d, "orders").join(base.table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return o.select(F.col("o_custkey").alias("session"), F.when(F.col("o_custkey") % 2 == 0, "treated").otherwise("bare").alias("arm"), F.concat("c_mktsegment", F.col("c_nationkey").cast("string")).alias("pair_key"), F.col("o_totalprice").alias("price"), F.col("o_orderpriority").alias("command"))


_ARMS = "s AS (SELECT o_custkey AS session, CASE WHEN o_custkey % 2 = 0 THEN 'treated' ELSE 'bare' END AS arm, c_mktsegment || c_nationkey AS pair_key, o_totalprice AS price, o_orderpriority AS command FROM orders JOIN customer ON o_custkey = c_custkey)"


@query("g20_arm_medians", f"WITH {_ARMS} SELECT arm, count(*) AS sessions, round(median(price), 4) AS median_price FROM s GROUP BY arm")
def _(spark, d):
    return comparison.medians(_sessions(spark, d), ["price"]).withColumn("median_price", F.round("median_price", 4))


_RATES = "p AS (SELECT arm, session, count(*) AS n, count(DISTINCT command) AS d FROM s GROUP BY ALL HAVING count(*) >= 5), r AS (SELECT arm, count(*) AS sessions, CAST(sum(n) AS BIGINT) AS calls, CAST(sum(n - d) AS BIGINT) AS repeats, round(sum(n - d) * CAST(100 AS DOUBLE) / sum(n), 6) AS rate FROM p GROUP BY arm)"


@query("g21_rerun_rate", f"WITH {_ARMS}, {_RATES} SELECT * FROM r")
def _(spark, d):
    return comparison.rerun_rate(_sessions(spark, d))


@query("g22_j15_paired_delta", f"WITH {_ARMS}, m AS (SELECT pair_key, median(price) FILTER (WHERE arm = 'bare') AS b, median(price) FILTER (WHERE arm = 'treated') AS t FROM s GROUP BY pair_key), q AS (SELECT t - b AS x FROM m WHERE t IS NOT NULL AND b IS NOT NULL) SELECT count(*) AS pairs, CASE WHEN count(*) >= 3 THEN round(median(x), 6) END AS median_delta FROM q")
def _(spark, d):
    return comparison.paired_delta(_sessions(spark, d), "price")


@query("g23_rerun_verdict", f"WITH {_ARMS}, {_RATES}, x AS (SELECT max(rate) FILTER (WHERE arm = 'bare') AS b, max(rate) FILTER (WHERE arm = 'treated') AS t, max(sessions) FILTER (WHERE arm = 'bare') AS nb, max(sessions) FILTER (WHERE arm = 'treated') AS nt FROM r) SELECT CASE WHEN coalesce(nb, 0) < 3 OR coalesce(nt, 0) < 3 OR t IS NULL OR b IS NULL THEN 'not-measured' WHEN abs(t - b) <= 2 AND b <= 2 THEN 'not-measured' WHEN abs(t - b) <= 2 THEN 'tie' WHEN t < b THEN 'lower' ELSE 'higher' END AS verdict FROM x")
def _(spark, d):
    return comparison.rerun_verdict(comparison.rerun_rate(_sessions(spark, d)))


@query("g24_arm_classes", "SELECT CASE WHEN c_custkey % 3 = 0 THEN 'bare' WHEN c_custkey % 5 > 0 THEN 'treated' ELSE 'gap' END AS arm, count(*) AS n FROM customer GROUP BY 1")
def _(spark, d):
    c = base.table(spark, d, "customer").select((F.col("c_custkey") % 3 != 0).alias("mentions"), (F.col("c_custkey") % 5).alias("delivered"))
    return comparison.arms(c).groupBy("arm").agg(F.count("*").alias("n"))


@query("g28_mann_whitney", """WITH x AS (SELECT c_mktsegment AS g, round(c_acctbal, -2) AS v FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY')), t AS (SELECT v, count(*) AS t, count(*) FILTER (WHERE g = 'BUILDING') AS a FROM x GROUP BY v),
r AS (SELECT *, coalesce(sum(t) OVER (ORDER BY v ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + (t + 1) / CAST(2 AS DOUBLE) AS r FROM t), s AS (SELECT sum(a * r) AS rs, CAST(sum(a) AS BIGINT) AS n1, CAST(sum(t) - sum(a) AS BIGINT) AS n2 FROM r)
SELECT round(rs - n1 * (n1 + 1) / CAST(2 AS DOUBLE), 3) AS u, round((rs - n1 * (n1 + 1) / CAST(2 AS DOUBLE) - n1 * n2 / CAST(2 AS DOUBLE)) / sqrt(n1 * n2 * (n1 + n2 + 1) / CAST(12 AS DOUBLE)), 6) AS z, n1, n2 FROM s""")
def _(spark, d):
    c = base.table(spark, d, "customer").select("c_mktsegment", F.round("c_acctbal", -2).alias("v"))
    return comparison.mann_whitney(c, "c_mktsegment", "v", "BUILDING", "MACHINERY")


@query("g28_bootstrap")
def _(spark, d):
    return comparison.bootstrap_median(base.table(spark, d, "supplier"), "s_nationkey", "s_acctbal")


@query("g29_w8_hazen", "SELECT p_partkey, round((rank() OVER (ORDER BY p_size) + (count(*) OVER (PARTITION BY p_size) - 1) / CAST(2 AS DOUBLE) - CAST(0.5 AS DOUBLE)) / count(*) OVER () * 100, 6) AS percentile FROM part")
def _(spark, d):
    return comparison.hazen(base.table(spark, d, "part").select("p_partkey", "p_size"), "p_size").select("p_partkey", "percentile")


@query("w1_row_position", "SELECT c_custkey, CAST(row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS INTEGER) AS rank FROM customer")
def _(spark, d):
    return base.table(spark, d, "customer").select("c_custkey", F.row_number().over(Window.partitionBy("c_nationkey").orderBy(F.desc("c_acctbal"), "c_custkey")).alias("rank"))


@query("w3_later_success", f"{EV} SELECT pos, min(CASE WHEN NOT failed THEN pos END) OVER (PARTITION BY session, norm ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) IS NOT NULL AS fixed FROM bash")
def _(spark, d):
    w = Window.partitionBy("session", "norm").orderBy("pos").rowsBetween(1, Window.unboundedFollowing)
    return _bash(spark, d).select("pos", F.min(F.when(~F.col("failed"), F.col("pos"))).over(w).isNotNull().alias("fixed"))


@query("t11_newest_first", f"{EV} SELECT pos FROM evs ORDER BY ts DESC, pos LIMIT 25")
def _(spark, d):
    return base.events(spark, d).orderBy(F.desc("ts"), "pos").limit(25).select("pos")
