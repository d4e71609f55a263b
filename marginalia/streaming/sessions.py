"""Streams: incremental refresh of a tree, session state, cumulative counters, traps over all batches so far."""

from __future__ import annotations

import threading
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators import logs


def refresh(listings: DataFrame, apply, checkpoint: str, table: str, trigger: dict | None = None):
    """Run ``apply(rows, generation)`` on each micro-batch of a file stream and write its rows with the generation.

    The generation is the batch id, so it is committed with the data; a repeated batch overwrites its own folder."""

    def step(rows: DataFrame, generation: int) -> None:
        out = apply(rows, generation).withColumn("generation", F.lit(generation))
        out.write.mode("overwrite").parquet(f"{table}/generation={generation}")

    return listings.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def drained(query) -> bool:
    """Barrier: everything that had arrived when this was called is applied."""
    query.processAllAvailable()
    return query.lastProgress is None or query.exception() is None


def coverage_barrier(entry: Column, entered_at: Column, applied: Column, walk_started_at: Column, walk_ms: Column, budget_ms: Column) -> tuple[Column, Column]:
    """``(fresh, note)`` of a query over a source without an order of arrival.

    The applied catalog covers the query when its fingerprint is that of the tree on entry, or when the walk that it came from began after
    the query did. Where a walk of the tree costs more than the budget, none is made and the answer is labelled. No fingerprint to
    compare with proves nothing."""
    over = F.coalesce(walk_ms > budget_ms, F.lit(False))
    covered = F.coalesce(applied == entry, F.lit(False)) | F.coalesce(walk_started_at >= entered_at, F.lit(False))
    note = (
        F.when(entry.isNull(), F.lit("barrier unavailable: no fingerprint of the tree"))
        .when(over, F.concat(F.lit("barrier over budget: a walk took "), walk_ms.cast("string"), F.lit(" ms, the budget is "), budget_ms.cast("string"), F.lit(" ms")))
        .when(~covered, F.lit("barrier timeout: no scan has covered the tree as of this query"))
        .otherwise(F.lit(""))
    )
    return entry.isNotNull() & ~over & covered, note


class ScanGate:
    """One scan at a time: a second is refused, not queued. A failure keeps the counts of the last good scan, a success clears the error."""

    def __init__(self) -> None:
        self._lock = threading.Lock()
        self._running, self._counts, self._error = False, None, None

    def status(self) -> dict:
        with self._lock:
            return {"running": self._running, "last_counts": self._counts, "last_error": self._error}

    def run(self, scan) -> bool:
        """Run ``scan()``, which returns its counts; false if another holds the gate. Errors go to the status."""
        with self._lock:
            if self._running:
                return False
            self._running = True
        counts, error = None, None
        try:
            counts = scan()
        except Exception as e:  # the status must not stay at running
            error = f"{type(e).__name__}: {e}"
        with self._lock:
            self._running, self._error = False, error
            self._counts = self._counts if error else counts
        return True


def scan_code(files: DataFrame, derive, gate: ScanGate, checkpoint: str, table: str) -> bool:
    """Derive rows from the code files ``path, ...`` that a file stream has not seen before, under the gate; its counts are files and rows."""
    spark = files.sparkSession

    def scan() -> dict:
        refresh(files, lambda rows, generation: derive(rows), checkpoint, table).awaitTermination()
        done = spark.read.parquet(table)
        return done.agg(F.count_distinct("path").alias("files"), F.count("*").alias("rows")).first().asDict()

    return gate.run(scan)


def labelled(answers: DataFrame, origin: str, generation: int, fresh: bool, note: str = "") -> DataFrame:
    return answers.withColumns({"origin": F.lit(origin), "generation": F.lit(generation), "fresh": F.lit(fresh), "stale_note": F.lit(note)})


def session_advice(events: DataFrame, every: int = 25, idle_ms: int | None = None) -> DataFrame:
    """Keyed state over ``session, pos, kind, file_path``: repeat reads (once a stretch without a write), each n-th event, resets on start.

    Output ``session, pos, advice``. State is the files read of one session, dropped ``idle_ms`` after its last event where that is given (a
    query that runs until stopped; with it a query that runs what is available would wait for the timeout)."""

    def update(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        count, files, seen = state.get if state.exists else (0, [], [])
        files, out = dict(zip(files, seen, strict=True)), []
        rows = pd.concat(list(frames)).sort_values("pos")
        for pos, kind, path in zip(rows["pos"], rows["kind"], rows["file_path"], strict=True):
            if kind == "start":
                count, files = 0, {}
                continue
            count += 1
            if kind == "read":
                files[path] = files.get(path, 0) + 1
                if files[path] == 2:
                    out.append((key[0], pos, "repeat-read"))
            elif kind == "write":
                files.pop(path, None)
            if count % every == 0:
                out.append((key[0], pos, "cadence"))
        state.update((count, list(files), list(files.values())))
        if idle_ms:
            state.setTimeoutDuration(idle_ms)
        yield pd.DataFrame(out, columns=["session", "pos", "advice"])

    return events.groupBy("session").applyInPandasWithState(update, "session string, pos long, advice string", "count long, files array<string>, seen array<long>", "append", GroupStateTimeout.ProcessingTimeTimeout if idle_ms else GroupStateTimeout.NoTimeout)


def counter_deltas(rows: DataFrame, idle_ms: int | None = None) -> DataFrame:
    """Growth of a cumulative counter per (host, session) from ``pos, total``, never negative, from keyed state."""

    def update(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last = state.get[0] if state.exists else 0
        out, rows = [], pd.concat(list(frames)).sort_values("pos")
        for pos, total in zip(rows["pos"], rows["total"], strict=True):
            out.append((key[0], key[1], pos, max(0, int(total) - last)))
            last = int(total)
        state.update((last,))
        if idle_ms:
            state.setTimeoutDuration(idle_ms)
        yield pd.DataFrame(out, columns=["host", "session", "pos", "delta"])

    return rows.groupBy("host", "session").applyInPandasWithState(update, "host string, session string, pos long, delta long", "last long", "append", GroupStateTimeout.ProcessingTimeTimeout if idle_ms else GroupStateTimeout.NoTimeout)


def traps_per_batch(events: DataFrame, sink: str, checkpoint: str):
    """The three traps over all batches so far; each batch writes the candidates that it adds.

    What later traps can need of earlier batches is kept beside the sink, in one of two folders by turns: a repeated batch reads that of its
    predecessor again and overwrites its own. Events of a session arrive in the order of pos."""

    def step(rows: DataFrame, batch: int) -> None:
        every = rows
        if batch:
            known = rows.sparkSession.read.schema(rows.schema).parquet(f"{sink}-kept/{(batch - 1) % 2}")
            every = known.unionByName(rows)
        remembered(every).write.mode("overwrite").parquet(f"{sink}-kept/{batch % 2}")
        out = traps(every)
        if batch:
            out = out.join(traps(known).select("id"), "id", "left_anti")
        out.write.mode("overwrite").parquet(f"{sink}/batch={batch}")

    return events.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def traps(events: DataFrame) -> DataFrame:
    """``id, reason, key, ts`` of all three traps."""
    bash = events.where("kind = 'bash'")
    fix = logs.fix_discovered(bash).select(F.lit("fix-discovered").alias("reason"), F.col("norm").alias("key"), "ts")
    again = logs.recurring_failures(bash).select(F.lit("recurring-failure").alias("reason"), F.col("norm").alias("key"), "ts")
    hot = logs.hot_files(events.where("kind = 'write'")).select(F.lit("hot-file").alias("reason"), F.col("file_path").alias("key"), F.lit(None).cast("long").alias("ts"))
    every = fix.unionByName(again).unionByName(hot)
    return every.groupBy("reason", "key").agg(F.min("ts").alias("ts")).select(logs.candidate_id(F.col("reason"), F.col("key")).alias("id"), "reason", "key", "ts")


def remembered(events: DataFrame, writes: int = 10) -> DataFrame:
    """The events that give the same traps as all of them, now and with any that follow: of each norm and session the first and last failure
    and the first success after the first failure; of each file and session as many writes as make it hot alone."""
    row = F.struct("pos", *(c for c in events.columns if c != "pos"))
    back = [F.col("e")[c].alias(c) for c in events.columns]
    bash = events.where("kind = 'bash'")
    bounds = bash.where("failed").groupBy("norm", "session").agg(F.min(row).alias("first"), F.max(row).alias("last"))
    failures = bounds.select(F.explode(F.array_distinct(F.array("first", "last"))).alias("e")).select(*back)
    since = bounds.select("norm", "session", F.col("first.pos").alias("_since"))
    fixes = bash.where("not failed").join(since, ["norm", "session"]).where("pos > _since").groupBy("norm", "session").agg(F.min(row).alias("e")).select(*back)
    nth = F.row_number().over(Window.partitionBy("file_path", "session").orderBy("pos"))
    written = events.where("kind = 'write' and ring between 0 and 3").withColumn("_n", nth).where(F.col("_n") <= writes).drop("_n")
    return failures.unionByName(fixes).unionByName(written.select(*events.columns))


def windowed_counts(events: DataFrame, size: str = "1 day", late: str = "2 days") -> DataFrame:
    """Counts by event time window with a watermark: rows later than ``late`` are dropped, finished windows leave the state."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", size), "event_type").agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "event_type", "n")


def vector_worker(hashes: DataFrame, store: str, embedder, checkpoint: str):
    """Derive missing vectors of each micro-batch of ``hash, text``."""
    from ..operators import vectors
    from ..sources import vector_store

    def step(rows: DataFrame, batch: int) -> None:
        vector_store.write(vectors.embed_batches(rows.dropDuplicates(["hash"]), embedder), store, "default")

    return hashes.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
