"""Streams whose sessions fall into different batches."""

from marginalia.streaming import sessions

EVENTS = "pos long, ts long, host string, session string, kind string, norm string, failed boolean, command string, file_path string, ring int"


def _event(pos, session, kind, norm=None, failed=None, path=None, ring=1):
    return (pos, pos * 10, "h", session, kind, norm, failed, norm, path, ring)


def test_traps_across_batches(spark, tmp_path):
    batches = [
        [_event(1, "a", "bash", "make", True), _event(2, "a", "write", path="f"), _event(3, "a", "bash", "fix", True), *(_event(4 + i, "a", "write", path="often") for i in range(5)), _event(9, "a", "bash", "once", True)],
        [_event(11, "b", "bash", "make", True), _event(12, "b", "bash", "other", False)],
        [_event(21, "c", "write", path="f"), _event(22, "a", "bash", "fix", False), *(_event(23 + i, "a", "write", path="often") for i in range(5)), _event(29, "c", "write", path="far", ring=4), _event(30, "a", "bash", "fix", False)],
        [_event(41, "d", "write", path="far", ring=4), _event(42, "e", "bash", "make", True)],
    ]
    frames = [spark.createDataFrame(rows, EVENTS) for rows in batches]
    every = frames[0]
    for frame in frames[1:]:
        every = every.unionByName(frame)
    for n, frame in enumerate(frames):  # one run each, so each is a batch
        frame.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(frame.schema).parquet(f"{tmp_path}/in")
        sessions.traps_per_batch(stream, f"{tmp_path}/out", f"{tmp_path}/state").awaitTermination()
        assert n == max(int(p.name[6:]) for p in (tmp_path / "out").glob("batch=*"))
    got = sorted((r["reason"], r["key"]) for r in spark.read.parquet(f"{tmp_path}/out").collect())
    assert got == sorted((r["reason"], r["key"]) for r in sessions.traps(every).collect())
    assert got == [("fix-discovered", "fix"), ("hot-file", "f"), ("hot-file", "often"), ("recurring-failure", "make")]
    assert sorted(map(tuple, sessions.traps(sessions.remembered(every)).collect())) == sorted(map(tuple, sessions.traps(every).collect()))
