"""Parsers and formulas on hand-made cases."""

import math
import sqlite3

from pyspark.sql import functions as F

from marginalia.functions import markdown, shell
from marginalia.operators import code, comparison, graph, lexical, ranking, vectors
from marginalia.sources import documents, jsonl, vector_store


def test_private_regions():
    assert markdown.strip_private("a<private>b<private>c</private>d</private>e") == "ae"
    assert markdown.blank_private("a<private>\nx") == "a" + " " * 9 + "\n "
    assert markdown.private_spans("x</private><private>")[1]


def test_segments():
    text = "# T\n\npara one\nmore\n\n- item\n  tail\n\n  loose\n- next\n```\ncode\n~~~\n```\n| a |\n| b |\nTitle\n=====\n"
    assert [(a, b) for a, b, _ in markdown.segment(text)] == [(1, 1), (3, 4), (6, 9), (10, 10), (11, 14), (15, 15), (16, 16), (17, 18)]


def test_chain_and_table_header():
    got = [(c, ch) for _, _, _, c, ch in markdown.blocks_of("# A\n## B\ntext\n| h |\n| r |\n\n| x |\n# C\nend\n")]
    assert got == [("", ""), ("A", "A"), ("A > B", "A > B"), ("A > B", "A > B"), ("A > B > | h |", "A > B"), ("A > B", "A > B"), ("", ""), ("C", "C")]


def test_frontmatter_lines():
    assert markdown.frontmatter_lines("---\nring: 1\n---\nx") == 3
    assert markdown.frontmatter_lines("---\nring: 1\n") == 0


def test_links():
    assert markdown.wikilinks("[[A|b]] [[C#d]] [[ ]]\n```\n[[E]]\n```") == ["a", "c"]
    assert markdown.markdown_links('[x](./A.md#p "t") [y](b.txt) [z](C.MD)') == ["a.md"]


def test_redaction():
    assert shell.redact("API_KEY=abc run") == "API_KEY=[redacted] run"
    assert shell.redact("curl --token abc -x") == "curl --token [redacted] -x"
    assert shell.redact("mysql -pSECRETpass db") == "mysql [redacted] db"
    assert shell.redact("git clone https://u:p@h/r") == "git clone https://[redacted]@h/r"
    assert shell.redact("set MY_TOKEN abc") == "set MY_TOKEN [redacted]"
    assert shell.redact("TOKEN = abc") == "TOKEN = [redacted]"
    assert shell.redact("echo " + "a1" * 16) == "echo [redacted]"
    assert shell.redact("echo plain words") == "echo plain words"


def test_families():
    assert shell.family("sudo -u me /usr/bin/git log") == "vcs"
    assert shell.family("npm install") == "generic"
    assert shell.family("npm run build") == "verification"
    assert shell.is_write("echo 'a > b' > c") and not shell.is_write("echo 'a > b'")
    assert shell.read_target("head -n 5 x.txt") == "x.txt" and shell.read_target("cat a | wc") is None


def test_water_fill():
    assert ranking.water_fill([(10, 1.0), (100, 1.0)], 60) == [10, 50]
    assert ranking.water_fill([(100, 1.0), (100, 3.0)], 80) == [20, 60]
    assert ranking.demote([("a", 50, 1.0, False), ("b", 50, 2.0, True)], 60, 10) == (["a"], {"b": 50})


def test_bm25_equals_fts5(spark):
    rows = [(1, "the quick fox", "alpha"), (2, "quick quick brown dog", "beta quick"), (3, "lazy state machine", ""), (4, "state-machine fox", "alpha fox"), (5, "nothing here", "")]
    con = sqlite3.connect(":memory:")
    con.execute("CREATE VIRTUAL TABLE f USING fts5(text, ctx)")
    con.executemany("INSERT INTO f(rowid, text, ctx) VALUES (?, ?, ?)", rows)
    want = dict(con.execute("SELECT rowid, bm25(f, 1.0, 0.3) FROM f WHERE f MATCH '\"quick\"* OR \"state-machine\" OR \"state\"* OR \"machine\"*'"))
    blocks = spark.createDataFrame([(*r, 0) for r in rows], "block_id long, text string, ctx string, ring int")
    got = {r["block_id"]: r["score"] for r in lexical.score(blocks, lexical.phrase_table(spark, {1: "quick state-machine"})).collect()}
    assert got.keys() == want.keys()
    assert all(math.isclose(got[k], want[k], rel_tol=1e-9) for k in got)


def test_exact_key_separates_close_fractions(spark):
    df = spark.createDataFrame([(1, 1, 12387072), (2, 1, 12387071), (3, -1, 5), (4, 0, 7)], "id int, d long, n long")
    order = [r["id"] for r in df.orderBy(F.desc(vectors.exact_key(F.col("d"), F.col("n")))).collect()]
    assert order == [2, 1, 4, 3]


def test_quantise_ties_to_even(spark):
    v = spark.createDataFrame([([2.5 / 127, -127.0 / 127, 3.5 / 127, 0.0],), ([0.0, 0.0],)], "v array<float>")
    assert [r[0] for r in v.select(vectors.quantised(F.col("v"))).collect()] == [[2, -127, 4, 0], [0, 0]]


def test_pagerank_cycle_dangling_and_star(spark):
    nodes = spark.range(3).select(F.col("id").alias("node"))
    cycle = spark.createDataFrame([(0, 1), (1, 2), (2, 0)], "src long, dst long")
    assert all(abs(r["rank"] - 1 / 3) < 1e-9 for r in graph.pagerank(nodes, cycle).collect())
    star = spark.createDataFrame([(1, 0), (2, 0), (2, 2)], "src long, dst long")
    ranks = {r["node"]: r["rank"] for r in graph.pagerank(nodes, star).collect()}
    assert abs(sum(ranks.values()) - 1) < 1e-9 and ranks[0] > ranks[1] == ranks[2]


def test_bfs_queue_order(spark):
    edges = spark.createDataFrame([("a", "c"), ("a", "b"), ("c", "d"), ("b", "d"), ("b", "e")], "src string, dst string")
    assert [tuple(r) for r in graph.bfs(edges, "a", 3).orderBy("level", "ord").collect()] == [("a", 0, 1, None), ("b", 1, 1, "a"), ("c", 1, 2, "a"), ("d", 2, 1, "b"), ("e", 2, 2, "b")]
    assert [r["node"] for r in graph.shortest_path(edges, "a", "d").orderBy("step").collect()] == ["a", "b", "d"]
    assert graph.shortest_path(edges, "d", "a").count() == 0


def test_hazen_ties(spark):
    rows = spark.createDataFrame([(1, 1.0), (2, 1.0), (3, 2.0), (4, 5.0)], "id int, v double")
    assert [r["percentile"] for r in comparison.hazen(rows, "v").orderBy("id").collect()] == [25.0, 25.0, 62.5, 87.5]


def test_code_of_other_languages():
    rust = "pub struct A {\n  x: i32,\n}\n\nimpl A {\n  pub fn go(&self) {\n    run(1);\n  }\n}\n"
    assert [(n, k, a, b) for n, k, a, b, _ in code.symbols("a.rs", rust)] == [("A", "struct", 1, 3), ("go", "function", 6, 8)]
    assert code.uses("a.rs", rust) == [("run", None, "calls", 7, 7)]
    ts = code.imports("src/a.ts", "import { x as y } from './b.js';\nimport * as n from '../c';\n")
    assert [(t[2], t[3], t[4]) for t in ts] == [("y", "x", "symbol"), ("n", "", "namespace")] and ts[0][1][1] == "src/b.ts"
    assert code.imports("src/lib.rs", "mod a;\nuse crate::b::{c, d as e};\n")[0][1] == ["src/a.rs", "src/a/mod.rs"]
    go = code.imports("m.go", 'import (\n\tx "mod/pkg"\n\t. "mod/q"\n)\n')
    assert [(g[1], g[2], g[4]) for g in go] == [(["go:mod/pkg"], "x", "namespace"), (["go:mod/q"], "", "edge")]


def test_jsonl_bad_version_clears_file(spark):
    rows = spark.createDataFrame([("a", 1, '{"v":1,"ts":5,"host":"h"}'), ("a", 2, '{"v":1,"ts"'), ("b", 1, '{"v":1,"ts":1}'), ("b", 2, '{"v":2,"ts":2}')], "file string, line_no int, value string")
    records, files = jsonl.read_all(rows)
    assert [r["ts"] for r in records.collect()] == [5]
    assert {(r["file"], r["torn_lines"], r["readable"]) for r in files.collect()} == {("a", 1, True), ("b", 0, False)}


def test_vector_records(spark):
    index = "\n".join(["head"] * 8 + ["h1", "h2", "unended"])
    rows = spark.createDataFrame([(index, bytes([1, 255, 3, 4, 5]))], "index string, data binary")
    assert [(r["hash"], r["v"]) for r in vector_store.read_records(rows, 2).collect()] == [("h1", [1, -1]), ("h2", [3, 4])]


def test_tree_reader_and_ignore_rules(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a/x.md").write_text("hello")
    (tmp_path / ".hidden.md").write_text("no")
    got = documents.read_tree(spark, f"file://{tmp_path}")
    assert [(r["path"], r["text"], r["size"]) for r in got.collect()] == [("a/x.md", "hello", 5)]
    paths = spark.createDataFrame([("build/a.md",), ("b/c.md",), ("keep.log",), ("d/keep.log",)], "path string")
    ignored = {r["path"] for r in paths.where(documents.ignored(F.col("path"), ["build/", "*.log", "!/keep.log"])).collect()}
    assert ignored == {"build/a.md", "d/keep.log"}


def test_marker_in_json():
    assert documents.search_json('{"a": ["<m> x", {"b": "<m>"}], "c": 1}', "<m>") == 2
    assert documents.search_json("broken", "<m>") == 0


def test_clipping_keeps_whole_lines(spark):
    from marginalia.operators import ranking

    rows = [("ab\ncd\nef", 6), ("ab\ncd\nef", 5), ("abcdefgh", 3), ("ab\n\ncd", 4), ("\nabc", 2)]
    got = [spark.createDataFrame([(t,)], "t string").select(ranking.clip_lines(F.col("t"), n)).first()[0] for t, n in rows]
    assert got == ["ab\ncd", "ab", "abc", "ab\n", ""]

    def plain(body, budget):  # bytes that fit, back to a whole character, back to the last line end
        data = body.encode()
        if -(-len(data) * 2 // 7) <= budget:
            return body, 0
        shown = data[: int(budget * 3.5)].decode("utf-8", "ignore")
        shown = shown[: shown.rfind("\n")] if "\n" in shown else shown
        return shown, -(-(len(data) - len(shown.encode())) * 2 // 7)

    texts = ["ærste linje\nzweite Zeile mit Umlauten äöü\nthird line\n", "äöü" * 9, "ab\n" * 9, "😀" * 7, "", "one"]
    for budget in (1, 2, 3, 4, 7, 50):
        rows = spark.createDataFrame([(x,) for x in texts], "t string").select("t", *ranking.clip_tokens(F.col("t"), budget)).collect()
        assert all((r[1], r[2]) == plain(r[0], budget) for r in rows), budget
