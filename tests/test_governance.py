"""Slices by name, grants, code roots, barriers, the scan gate and the catalog on hand-made cases."""

import pytest
from pyspark.sql import functions as F

from marginalia.functions import text as T
from marginalia.operators import catalog, code, governance
from marginalia.plans import registry
from marginalia.streaming import sessions

registry.load()
SLICES = [("core", "src1"), ("core", "lib"), ("docs", "docs")]


def test_slice_names():
    assert T.prefixes_of(SLICES, "core") == ["src1", "lib"]
    assert T.prefixes_of(SLICES, None) == T.prefixes_of(SLICES, "root") == []
    with pytest.raises(ValueError, match="no slice named 'cor' .*core, docs"):
        T.prefixes_of(SLICES, "cor")
    with pytest.raises(ValueError, match="none"):
        T.prefixes_of([], "core")


def test_grants(spark):
    grants = [("a", "p", 1, 2, None, "write"), ("a", "p", 2, 1, 5.0, "write"), ("a", "p", 3, 1, None, "read"), ("a", None, 0, 1, None, "write"), ("b", "q", 1, 1, 10.0, "read")]
    g = spark.createDataFrame(grants, "slice string, peer string, ord int, network_major int, expires_at double, mode string")
    ask = lambda rows: sorted(map(tuple, governance.grant_access(spark.createDataFrame(rows, "slice string, peer string, now double"), g).collect()), key=repr)
    assert ask([("a", "p", 4.9), ("b", "q", 9.0), ("c", "p", 0.0)]) == [("a", "p", "write"), ("b", "q", "read"), ("c", "p", None)]
    assert ask([("a", "p", 5.0), ("b", "q", 10.0), ("a", None, 0.0)]) == [("a", "p", "read"), ("a", None, None), ("b", "q", None)]


def test_code_roots(spark):
    files = spark.createDataFrame([("/r/a/x.py",), ("/r/b.py",), ("/rr/c.py",), ("/r/a/x.py",), (None,)], "path string")
    assert sorted(map(tuple, code.code_roots(files, ["/r/", "/r/a"]).collect())) == [("/r/a/x.py", 0, "a/x.py"), ("/r/b.py", 0, "b.py")]
    assert sorted(map(tuple, code.code_roots(files, ["/r/a", "/r"]).collect())) == [("/r/a/x.py", 0, "x.py"), ("/r/b.py", 1, "b.py")]
    with pytest.raises(ValueError, match="no code roots"):
        code.code_roots(files, [])


def test_barrier_over_a_tree(spark):
    tree = spark.createDataFrame([("a.md", 1, 10), ("b.md", 2, 20)], "path string, mtime_ns long, size long")
    entry = catalog.fingerprint(tree).first()["digest"]
    moved = catalog.fingerprint(tree.withColumn("mtime_ns", F.col("mtime_ns") + 1)).first()["digest"]
    rows = [(entry, 5, entry, 1, 3), (entry, 5, moved, 4, 3), (entry, 5, moved, 5, 3), (entry, 5, entry, 1, 99), (None, 5, entry, 9, 3), (entry, 5, None, None, None)]
    d = spark.createDataFrame(rows, "entry string, at long, applied string, walk long, ms long")
    fresh, note = sessions.coverage_barrier(F.col("entry"), F.col("at"), F.col("applied"), F.col("walk"), F.col("ms"), F.lit(50))
    got = d.select(fresh, F.regexp_extract(note, "barrier ([a-z ]+):", 1)).collect()
    assert [tuple(r) for r in got] == [(True, ""), (False, "timeout"), (True, ""), (False, "over budget"), (False, "unavailable"), (False, "timeout")]


def test_scan_gate():
    gate, inner = sessions.ScanGate(), []
    assert gate.run(lambda: inner.append(gate.run(dict)) or {"files": 2}) and inner == [False]
    assert gate.status() == {"running": False, "last_counts": {"files": 2}, "last_error": None}
    assert gate.run(lambda: 1 / 0)
    assert gate.status() == {"running": False, "last_counts": {"files": 2}, "last_error": "ZeroDivisionError: division by zero"}
    assert gate.run(lambda: {"files": 3}) and gate.status()["last_error"] is None


def test_catalog(spark):
    texts = [
        (1, "a.md", "---\nring: 1\n---\n# T\n\nseen <private>hidden</private> here\n"),
        (2, "b.md", "---\nring: 6\n---\nout of rings\n"),
        (3, "c.md", "plain\n\nplain\n"),
        (4, "d.md", None),
    ]
    docs, blocks = catalog.build(spark.createDataFrame(texts, "doc_id long, path string, text string"), [])
    rows = blocks.orderBy("doc_id", "start_line").collect()
    assert {r["doc_id"] for r in rows} == {1, 3} and all("hidden" not in r["text"] for r in rows)
    assert 2 not in {r["doc_id"] for r in docs.collect()}
    assert len({r["cite"] for r in rows if r["doc_id"] == 3}) == 1 and len([r for r in rows if r["doc_id"] == 3]) == 2


def test_semantic_half_runs(spark, data):
    rows = registry.QUERIES["v16_v19_semantic"](spark, data).collect()
    assert {r["query_id"] for r in rows} == {1, 2, 3, 4} and all(r["note"].startswith("vectors cover") for r in rows)
