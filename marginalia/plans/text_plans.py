"""Queries of the text and catalog operators."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import markdown, shell
from ..functions import text as T
from ..operators import catalog, ranking
from ..sources import documents
from . import base
from .base import BLOCKS_SQL, DOCS_SQL, sql_list
from .registry import query

RULES = [("src0/", 0), ("src1/en/", 1), ("src2/de/d42.md", 4), ("src3/", 2)]
SLICES = [("core", "src1"), ("english", "src1/en"), ("german", "src2/de"), ("other", "src3")]


@query("p2_ring_taxonomy", f"WITH {DOCS_SQL} SELECT doc_id, CASE WHEN path LIKE 'src0/%' THEN 0 WHEN path LIKE 'src1/en/%' THEN 1 WHEN path = 'src2/de/d42.md' THEN 4 WHEN path LIKE 'src3/%' THEN 2 ELSE 3 END AS ring FROM docs")
def _(spark, d):
    return base.docs(spark, d).select("doc_id", T.ring_of(F.col("path"), RULES).alias("ring"))


@query("p3_effective_ring", f"""WITH {DOCS_SQL}, x AS (SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN NULL ELSE doc_id % 7 END AS fm, doc_id % 6 AS loc, doc_id % 5 = 0 AS native FROM docs),
y AS (SELECT doc_id, native, CASE WHEN loc >= 5 THEN greatest(loc, coalesce(fm, loc)) ELSE coalesce(fm, loc) END AS r FROM x), z AS (SELECT doc_id, CASE WHEN native THEN greatest(r, 2) ELSE r END AS ring FROM y)
SELECT doc_id, ring, ring <= 4 AS indexed FROM z""")
def _(spark, d):
    fm = F.when(F.col("doc_id") % 4 != 0, F.col("doc_id") % 7)
    x = base.docs(spark, d).select("doc_id", T.effective_ring(fm, F.col("doc_id") % 6, F.col("doc_id") % 5 == 0).alias("ring"))
    return x.withColumn("indexed", F.col("ring") <= 4)


@query("p10_p11_hash_cite", f"WITH {BLOCKS_SQL} SELECT block_id, hash, cite FROM blocks")
def _(spark, d):
    return base.blocks(spark, d).select("block_id", "hash", "cite")


@query("p9_generated_blob", f"WITH {DOCS_SQL} SELECT doc_id, len(list_filter(string_split(text, chr(10)), lambda x: octet_length(encode(x)) > 8192)) > 0 AS blob FROM docs")
def _(spark, d):
    return base.docs(spark, d).select("doc_id", T.generated_blob(F.col("text")).alias("blob"))


@query("p14_snippet", f"WITH {BLOCKS_SQL} SELECT block_id, '[' || ctx || '] ' || substr({base.COLLAPSE}, 1, 160) AS snippet FROM blocks")
def _(spark, d):
    return base.blocks(spark, d).select("block_id", T.snippet(F.col("text"), F.col("ctx")).alias("snippet"))


@query("p15_p16_identifiers", "SELECT p_partkey, lower(regexp_replace(p_name || p_brand, '[^A-Za-z0-9]', '', 'g')) AS norm, lower(regexp_replace(p_type || p_partkey, '[^A-Za-z0-9]', '', 'g')) AS stem FROM part")
def _(spark, d):
    p = base.table(spark, d, "part")
    path = F.concat("p_brand", F.lit("/"), "p_type", F.col("p_partkey").cast("string"), F.lit(".rs"))
    return p.select("p_partkey", T.identifier(F.concat("p_name", "p_brand")).alias("norm"), T.norm_stem(path).alias("stem"))


@query("p17_token_estimate", f"WITH {DOCS_SQL} SELECT doc_id, CAST(ceil(size / CAST(3.5 AS DOUBLE)) AS BIGINT) AS tokens FROM docs")
def _(spark, d):
    return base.docs(spark, d).select("doc_id", T.token_estimate(F.col("text")).alias("tokens"))


@query("p18_p19_content_terms", f"""WITH w AS (SELECT conv_id, turn, list_filter(regexp_split_to_array(lower(text), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '' AND x NOT IN ({sql_list(T.STOPWORDS)})) AS ws FROM conversations)
SELECT conv_id, turn, CAST(len(list_distinct(ws)) AS INTEGER) AS terms, coalesce(ws[1], '') AS first_term FROM w""")
def _(spark, d):
    terms = T.content_terms(F.col("text"))
    return base.table(spark, d, "conversations").select("conv_id", "turn", F.size(terms).alias("terms"), F.coalesce(F.get(terms, F.lit(0)), F.lit("")).alias("first_term"))


@query("p22_command_signature", f"WITH {base.EVENTS_SQL} SELECT pos, 'run n.log' || CASE WHEN k % 2 = 0 THEN ' <path>' ELSE '' END || ' <hex>' AS signature FROM evs")
def _(spark, d):
    e = base.events(spark, d)
    command = F.concat(F.lit("Run  "), F.col("k").cast("string"), F.lit(".LOG"), F.when(F.col("k") % 2 == 0, F.lit(" /tmp/a1")).otherwise(F.lit("")), F.lit(" DEADBEEF"), F.lpad((F.col("k") + 1000).cast("string"), 4, "0"))
    return e.select("pos", T.command_signature(command).alias("signature"))


@query("p23_secret_path", "SELECT p_partkey, p_partkey % 5 IN (0, 1, 2, 3) AS secret FROM part")
def _(spark, d):
    name = F.expr("element_at(array('a/.SSH/x', 'b/.env.local', 'c/my-Password.txt', 'd/key.pem', 'e/readme.md'), cast(p_partkey % 5 as int) + 1)")
    return base.table(spark, d, "part").select("p_partkey", T.secret_path(name).alias("secret"))


@query("p24_secret_shape", f"WITH {DOCS_SQL} SELECT doc_id, CASE " + " ".join(f"WHEN regexp_matches(text, '{p}') THEN '{n}'" for n, p in T.SECRET_PATTERNS.items()) + " END AS shape FROM docs")
def _(spark, d):
    return base.docs(spark, d).select("doc_id", T.secret_shape(F.col("text")).alias("shape"))


@query("p20_redact_runs", f"""WITH {DOCS_SQL} SELECT doc_id, md5(regexp_replace(regexp_replace(regexp_replace(text, 'eyJ[A-Za-z0-9_.-]{{17,}}', '[redacted]', 'g'), '(://)[^\\s/@:]*:[^\\s/@]*@', '\\1[redacted]@', 'g'), '[0-9A-Fa-f]{{32,}}', '[redacted]', 'g')) AS digest FROM docs""")
def _(spark, d):
    return base.docs(spark, d).select("doc_id", F.md5(T.redact_runs(F.col("text"))).alias("digest"))


@query("p20_redact_commands", f"WITH {base.EVENTS_SQL} SELECT pos, CASE k % 4 WHEN 0 THEN 'export API_TOKEN=[redacted]' WHEN 1 THEN 'curl -H Authorization: [redacted] x' WHEN 2 THEN 'mysql --password [redacted] db' ELSE 'git clone https://[redacted]@h/r' END AS clean FROM evs")
def _(spark, d):
    raw = F.expr("element_at(array(concat('export API_TOKEN=v', k), concat('curl -H Authorization: b', k, ' x'), concat('mysql --password p', k, ' db'), concat('git clone https://u:p', k, '@h/r')), k % 4 + 1)")
    return base.events(spark, d).select("pos", shell.redacted(raw).alias("clean"))


@query("p21_p26_p28_commands", f"""WITH {base.EVENTS_SQL} SELECT pos, CASE k % 5 WHEN 0 THEN 'verification' WHEN 1 THEN 'vcs' WHEN 2 THEN 'listing' ELSE 'generic' END AS family, k % 5 IN (2, 4) AS writes,
  CASE k % 5 WHEN 3 THEN 'notes/a b.md' END AS reads FROM evs""")
def _(spark, d):
    raw = F.expr("""element_at(array('sudo -u me cargo test', 'FOO=1 git log', 'ls -l > out.txt', 'cat "notes/a b.md"', 'sed -i s/a/b/ x'), k % 5 + 1)""")
    return base.events(spark, d).select("pos", shell.family_of(raw).alias("family"), shell.writes(raw).alias("writes"), shell.reads(raw).alias("reads"))


@query("p25_clamp", f"WITH {DOCS_SQL} SELECT doc_id, CASE WHEN length(text) > 40 THEN substr(text, 1, 40) || '…' ELSE text END AS short FROM docs")
def _(spark, d):
    return base.docs(spark, d).select("doc_id", T.clamp(F.col("text"), 40).alias("short"))


@query("p27_condense", """WITH o AS (SELECT o_orderkey, CAST(o_orderkey % 120 AS INTEGER) AS n, CASE o_orderkey % 3 WHEN 0 THEN 'vcs' WHEN 1 THEN 'verification' ELSE 'generic' END AS family FROM orders),
l AS (SELECT *, list_transform(range(1, n + 2), lambda i: 'line ' || i) AS ls, CASE family WHEN 'vcs' THEN 10 ELSE 20 END AS keep FROM o),
t AS (SELECT *, array_to_string(ls, chr(10)) AS whole, len(ls) - 40 - keep AS gone FROM l),
s AS (SELECT *, array_to_string(ls[1:40] || ['… ' || gone || ' line(s) elided …'] || ls[len(ls) - keep + 1:], chr(10)) AS short FROM t),
b AS (SELECT *, family <> 'verification' AND len(ls) >= 70 AND (octet_length(encode(whole)) - octet_length(encode(short))) / octet_length(encode(whole)) >= 0.3 AS does FROM s)
SELECT o_orderkey, CASE WHEN does THEN short ELSE whole END AS text, CAST(CASE WHEN does THEN gone ELSE 0 END AS BIGINT) AS elided FROM b""")
def _(spark, d):
    o = base.table(spark, d, "orders")
    family = F.when(F.col("o_orderkey") % 3 == 0, "vcs").when(F.col("o_orderkey") % 3 == 1, "verification").otherwise("generic")
    whole = F.array_join(F.transform(F.sequence(F.lit(1), (F.col("o_orderkey") % 120 + 1).cast("int")), lambda i: F.concat(F.lit("line "), i.cast("string"))), "\n")
    return o.select("o_orderkey", T.condense(whole, family).alias("c")).select("o_orderkey", "c.text", "c.elided")


@query("p32_knowledge_kind", f"""WITH {DOCS_SQL}, b AS (SELECT doc_id, split_part(path, '/', 1) AS kind, regexp_replace(lower(path), '\\.md$', '') AS bare FROM docs)
SELECT doc_id, kind, CASE WHEN bare = 'src1/en/d1' THEN 4 WHEN regexp_extract(bare, '[^/]*$') = 'src1/en/d1' THEN 3 WHEN ends_with(bare, 'src1/en/d1') THEN 2 WHEN contains(bare, 'src1/en/d1') THEN 1 ELSE 0 END AS score FROM b""")
def _(spark, d):
    return base.docs(spark, d).select("doc_id", T.knowledge_kind(F.col("path")).alias("kind"), F.coalesce(T.focus_score(F.col("path"), "src1/en/d1.md"), F.lit(0)).alias("score"))


@query("p33_epoch", "SELECT o_orderkey, CASE WHEN o_orderkey % 3 <> 0 THEN CAST(floor(epoch(o_orderdate)) AS BIGINT) ELSE -1 END AS at FROM orders")
def _(spark, d):
    stamp = F.concat(F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss"), F.when(F.col("o_orderkey") % 3 == 0, F.lit("+00:00")).otherwise(F.lit("Z")))
    return base.table(spark, d, "orders").select("o_orderkey", F.coalesce(T.epoch_seconds(stamp), F.lit(-1)).cast("long").alias("at"))


@query("p34_token_bucket", f"WITH {DOCS_SQL}, n AS (SELECT doc_id, CAST(ceil(size / CAST(3.5 AS DOUBLE)) AS BIGINT) AS n FROM docs) SELECT doc_id, CAST(CASE WHEN n <= 0 THEN -1 " + " ".join(f"WHEN n <= {b} THEN {b}" for b in T.BUCKETS) + " ELSE -1 END AS INTEGER) AS bucket FROM n")
def _(spark, d):
    return base.docs(spark, d).select("doc_id", F.coalesce(T.token_bucket(T.token_estimate(F.col("text"))), F.lit(-1)).cast("int").alias("bucket"))


@query("p35_p36_rendering", "SELECT c_custkey, 'Customer-' || lpad(CAST(c_custkey AS VARCHAR), 12, '0') || '-x' AS host, '---' || chr(10) || 'id: c' || c_custkey AS head FROM customer")
def _(spark, d):
    c = base.table(spark, d, "customer")
    raw = F.concat(F.lit("Customer#"), F.lpad(F.col("c_custkey").cast("string"), 12, "0"), F.lit(".x"))
    note = documents.render_candidate(F.concat(F.lit("c"), F.col("c_custkey").cast("string")), F.lit("r"), F.lit("s"), F.lit("h"), F.lit(1), F.lit("k"), F.lit("{}"))
    return c.select("c_custkey", T.host_name(raw).alias("host"), F.substring_index(note, "\n", 2).alias("head"))


@query("p37_human_bytes", f"WITH {DOCS_SQL} SELECT doc_id, CASE WHEN size < 1024 THEN size || ' B' WHEN size < 1048576 THEN format('{{:,.1f}} KiB', size / 1024.0::DOUBLE) ELSE format('{{:,.1f}} MiB', size / 1048576.0::DOUBLE) END AS shown FROM docs")
def _(spark, d):
    return base.docs(spark, d).select("doc_id", T.human_bytes(F.col("size")).alias("shown"))


@query("p38_position_cost", "SELECT conv_id, sum(CAST(ceil(octet_length(encode(text)) / CAST(3.5 AS DOUBLE)) AS BIGINT) * greatest(0, 5 - turn)) AS cost FROM conversations GROUP BY 1")
def _(spark, d):
    return base.table(spark, d, "conversations").groupBy("conv_id").agg(F.sum(T.position_cost(T.token_estimate(F.col("text")), F.col("turn"), F.lit(5))).alias("cost"))


@query("f1_slice_filter", f"WITH {DOCS_SQL} SELECT doc_id FROM docs WHERE path LIKE 'src1/%' OR path LIKE 'src2/de/%'")
def _(spark, d):
    return base.docs(spark, d).where(T.under_prefix(F.col("path"), ["src1", "src2/de"])).select("doc_id")


@query("f2_innermost_slice", f"WITH {DOCS_SQL} SELECT path, CASE WHEN path LIKE 'src1/en/%' THEN 'english' WHEN path LIKE 'src1/%' THEN 'core' WHEN path LIKE 'src2/de/%' THEN 'german' WHEN path LIKE 'src3/%' THEN 'other' ELSE 'root' END AS slice FROM docs")
def _(spark, d):
    from ..operators import governance

    slices = spark.createDataFrame([(n, p, i) for i, (n, p) in enumerate(SLICES)], "name string, prefix string, ord int")
    return governance.innermost(base.docs(spark, d).select("path"), slices)


@query("f3_slice_expression", f"WITH {DOCS_SQL} SELECT doc_id, CASE WHEN path LIKE 'src1/en/%' THEN 'english' WHEN path LIKE 'src1/%' THEN 'core' WHEN path LIKE 'src2/de/%' THEN 'german' WHEN path LIKE 'src3/%' THEN 'other' ELSE 'root' END AS slice FROM docs")
def _(spark, d):
    return base.docs(spark, d).select("doc_id", T.slice_of(F.col("path"), SLICES).alias("slice"))


@query("f3_named_slice", f"WITH {DOCS_SQL} SELECT 'english' AS slice, doc_id FROM docs WHERE path LIKE 'src1/en/%' UNION ALL SELECT 'core', doc_id FROM docs WHERE path LIKE 'src1/%' UNION ALL SELECT 'root', doc_id FROM docs")
def _(spark, d):
    """Documents by the name of a slice; ``root`` holds all, an unknown name raises."""
    x = base.docs(spark, d).select("doc_id", "path")
    each = [x.where(T.in_slice(F.col("path"), SLICES, name)).select(F.lit(name).alias("slice"), "doc_id") for name in ("english", "core", "root")]
    return each[0].unionByName(each[1]).unionByName(each[2])


@query("f13_grant_access", """SELECT o_orderpriority AS slice, 'p' || (o_custkey % 500) AS peer, arg_min(CASE WHEN o_orderstatus = 'F' THEN 'write' ELSE 'read' END, o_orderkey)
  FILTER (WHERE o_orderkey % 4 <> 0 AND o_orderkey % 10 <> 0 AND (o_orderstatus = 'P' OR o_totalprice > 200000)) AS mode FROM orders GROUP BY ALL""")
def _(spark, d):
    """Each order grants its buyer access to its priority: not yet given to a peer (t = 0), of another network (m = 0), without an end (P), or ending at its price."""
    from ..operators import governance

    o = base.table(spark, d, "orders").select(F.col("o_orderpriority").alias("slice"), F.concat(F.lit("p"), F.pmod("o_custkey", F.lit(500)).cast("string")).alias("peer"), F.col("o_orderkey").alias("ord"), "o_totalprice", "o_orderstatus")
    grants = o.select(
        "slice", F.when(F.col("ord") % 10 != 0, F.col("peer")).alias("peer"), "ord", F.when(F.col("ord") % 4 == 0, 2).otherwise(1).alias("network_major"),
        F.when(F.col("o_orderstatus") != "P", F.col("o_totalprice")).alias("expires_at"), F.when(F.col("o_orderstatus") == "F", "write").otherwise("read").alias("mode"),
    )
    return governance.grant_access(o.select("slice", "peer").distinct().withColumn("now", F.lit(200000.0)), grants)


@query("j11_code_roots", f"""WITH {DOCS_SQL} SELECT path, CASE WHEN path LIKE 'src2/de/%' THEN 0 WHEN path LIKE 'src2/%' THEN 1 WHEN path LIKE 'src1/%' THEN 2 END AS root,
substr(path, CASE WHEN path LIKE 'src2/de/%' THEN 9 ELSE 6 END) AS relative FROM docs WHERE path LIKE 'src2/%' OR path LIKE 'src1/%'""")
def _(spark, d):
    from ..operators import code

    return code.code_roots(base.docs(spark, d).select("path"), ["src2/de", "src2/", "src1", "src1/en"])


@query("a5_catalog_build")
def _(spark, d):
    """The catalog of all documents as Markdown: rings by front matter and folder, parsed blocks without generated data, citations."""
    marked = base.docs(spark, d).select("doc_id", "path", F.concat(F.lit("---\nring: "), (F.col("doc_id") % 7).cast("string"), F.lit("\n---\n# "), F.col("path"), F.lit("\n\n"), F.col("text")).alias("text"))
    return catalog.build(marked, RULES)[1].select("doc_id", "path", "ring", "start_line", "end_line", "chain", "hash", "cite")


@query("a3_indexable", f"WITH {DOCS_SQL} SELECT doc_id FROM docs WHERE NOT path LIKE 'src4/%'")
def _(spark, d):
    return base.docs(spark, d).where(T.indexable(F.col("path"), ["src4"])).select("doc_id")


def _listing(spark, d):
    return base.docs(spark, d).select("path", (F.col("doc_id") * 1000).alias("mtime_ns"), "size")


@query("a2_collect_files", f"""WITH {DOCS_SQL}, r AS (SELECT path, size, 0 AS o FROM docs UNION ALL SELECT path, size + 1, 1 FROM docs WHERE doc_id % 3 = 0 UNION ALL SELECT 'native:s' || (doc_id % 2) || '/m' || doc_id || '.md', size, 2 FROM docs WHERE doc_id % 10 = 0)
SELECT path, arg_min(size, o) AS size FROM r GROUP BY path""")
def _(spark, d):
    x = base.docs(spark, d)
    tree = x.select("path", "size")
    cards = x.where("doc_id % 3 = 0").select("path", (F.col("size") + 1).alias("size"))
    stores = x.where("doc_id % 10 = 0").select(F.concat(F.lit("s"), (F.col("doc_id") % 2).cast("string")).alias("slug"), F.concat(F.lit("m"), F.col("doc_id").cast("string"), F.lit(".md")).alias("file"), "size")
    return documents.collect_files(tree, cards, stores, [])


def _digest_sql(row: str, source: str) -> str:
    return f"""d AS (SELECT sha256({row}) AS d FROM {source}), b AS (SELECT substr(d, 1, 3) AS b, sha256(string_agg(d, '' ORDER BY d)) AS d FROM d GROUP BY 1)
SELECT sha256(string_agg(d, '' ORDER BY b)) AS digest FROM b"""


@query("a4_fingerprint", f"WITH {DOCS_SQL}, " + _digest_sql("path || chr(0) || (doc_id * 1000) || chr(0) || size", "docs"))
def _(spark, d):
    return catalog.fingerprint(_listing(spark, d))


@query("g5_checksum", f"WITH {BLOCKS_SQL}, " + _digest_sql("cite || chr(0) || path || chr(0) || ring", "blocks"))
def _(spark, d):
    return catalog.checksum(base.blocks(spark, d))


@query("a5_full_scan", f"WITH {BLOCKS_SQL} SELECT count(DISTINCT doc_id) AS docs, count(*) AS blocks, count(DISTINCT hash) AS hashes FROM blocks")
def _(spark, d):
    return base.blocks(spark, d).agg(F.count_distinct("doc_id").alias("docs"), F.count("*").alias("blocks"), F.count_distinct("hash").alias("hashes"))


@query("p6_p8_markdown_blocks")
def _(spark, d):
    """Headings, items, rows and fences over documents with marks added; tests hold the parser against hand-made cases."""
    marked = base.docs(spark, d).select("doc_id", F.concat(F.lit("# "), F.col("path"), F.lit("\n\n- item\n  more\n\n| a | b |\n| 1 | 2 |\n\n"), F.col("text")).alias("text"))
    return markdown.explode_blocks(marked)


@query("p1_frontmatter_ring", f"WITH {DOCS_SQL} SELECT doc_id, CAST(CASE doc_id % 4 WHEN 0 THEN doc_id % 7 WHEN 1 THEN 255 ELSE -1 END AS INTEGER) AS ring FROM docs")
def _(spark, d):
    text = F.expr("element_at(array(concat('﻿---\ntitle: x\nring: ', doc_id % 7, '\n---\n', text), concat('---\nring: high\n---\n', text), concat('---\nring: 1\n', replace(text, '---', '')), text), cast(doc_id % 4 as int) + 1)")
    return base.docs(spark, d).select("doc_id", F.coalesce(T.frontmatter_ring(text), F.lit(-1)).alias("ring"))


@query("p4_p5_private", f"WITH {DOCS_SQL} SELECT doc_id, md5(text || 'end') AS stripped, length(text) + 41 AS blanked, false AS unbalanced FROM docs")
def _(spark, d):
    x = base.docs(spark, d)
    body = F.concat("text", F.lit("<private>a<private>b</private></private>"), F.lit("end"))
    whole = F.concat("text", F.lit("<private>x\ny</private>."), F.lit("tail of text 123456"[:18]))
    return x.select("doc_id", F.md5(markdown.without_private(body)).alias("stripped"), F.char_length(markdown.blanked_private(whole)).cast("long").alias("blanked"), markdown.private_unbalanced(body).alias("unbalanced"))


@query("p12_p13_links", f"WITH {DOCS_SQL} SELECT doc_id, 'd' || (doc_id + 1) || ',notes/d' || (doc_id % 10) || '.md' AS links FROM docs")
def _(spark, d):
    body = F.concat(F.lit("see [[D"), (F.col("doc_id") + 1).cast("string"), F.lit("|other#part]] and [x](./notes/D"), (F.col("doc_id") % 10).cast("string"), F.lit(".md \"t\")\n```\n[[inside]]\n```\n"))
    return base.docs(spark, d).select("doc_id", F.array_join(markdown.links(body), ",").alias("links"))


@query("a6_incremental_rescan", f"WITH {DOCS_SQL} SELECT path, size + CASE WHEN doc_id % 100 = 7 THEN 1 ELSE 0 END AS size FROM docs WHERE doc_id % 100 <> 9")
def _(spark, d):
    old = _listing(spark, d)
    n = F.regexp_extract("path", r"d([0-9]+)\.md$", 1).cast("long")
    new = old.where(n % 100 != 9).withColumn("size", F.col("size") + F.when(n % 100 == 7, 1).otherwise(0))
    derive = lambda x: x.select("path", "size")
    return catalog.rescan(derive(old), old, new, derive)


@query("j12_stat_diff", f"WITH {DOCS_SQL} SELECT CASE WHEN doc_id % 100 = 9 THEN 'vanished' WHEN doc_id % 100 = 7 THEN 'changed' WHEN doc_id % 100 = 3 THEN 'added' ELSE 'same' END AS change, count(*) AS n FROM docs GROUP BY 1")
def _(spark, d):
    n = F.regexp_extract("path", r"d([0-9]+)\.md$", 1).cast("long")
    every = _listing(spark, d)
    old, new = every.where(n % 100 != 3), every.where(n % 100 != 9).withColumn("size", F.col("size") + F.when(n % 100 == 7, 1).otherwise(0))
    return catalog.changes(old, new).groupBy("change").agg(F.count("*").alias("n"))


@query("g1_block_counts", f"WITH {BLOCKS_SQL} SELECT d.path, count(b.block_id) AS blocks FROM docs d LEFT JOIN blocks b ON b.doc_id = d.doc_id AND b.line > 1 GROUP BY d.path")
def _(spark, d):
    return catalog.block_counts(base.docs(spark, d), base.blocks(spark, d).where("line > 1"))


@query("g2_ring_price", f"WITH {DOCS_SQL} SELECT ring, count(*) AS docs, sum(size) AS bytes FROM docs WHERE doc_id % 3 <> 0 GROUP BY ring HAVING sum(size) > 0")
def _(spark, d):
    x = base.docs(spark, d)
    return catalog.ring_price(x, x.where("doc_id % 3 = 0"))


@query("g3_census", f"WITH {DOCS_SQL} SELECT prefix, count(*) AS docs FROM (SELECT split_part(path, '/', 1) AS prefix FROM docs UNION ALL SELECT split_part(path, '/', 1) || '/' || split_part(path, '/', 2) FROM docs) GROUP BY prefix")
def _(spark, d):
    return catalog.census(base.docs(spark, d))


@query("g4_concentrations", f"""WITH {DOCS_SQL}, c AS (SELECT prefix, count(*) AS docs FROM (SELECT split_part(path, '/', 1) AS prefix FROM docs UNION ALL SELECT split_part(path, '/', 1) || '/' || split_part(path, '/', 2) FROM docs) GROUP BY prefix),
t AS (SELECT * FROM c WHERE docs >= ceil(0.02 * (SELECT count(*) FROM docs)) AND docs < 0.9 * (SELECT count(*) FROM docs))
SELECT * FROM t WHERE NOT EXISTS (SELECT 1 FROM t i WHERE starts_with(i.prefix, t.prefix || '/'))""")
def _(spark, d):
    return catalog.concentrations(base.docs(spark, d), 0.02)


@query("l4_l6_mirrors_and_copies", f"""WITH {BLOCKS_SQL}, r AS (SELECT cite, chain, ring, path, block_id AS rank, split_part(cite, '-', 2) AS h FROM blocks),
g AS (SELECT h, chain, min(rank) AS rank, arg_min(path, ring * CAST(1000000000000 AS BIGINT) + rank) AS path, min(ring) AS ring, list_distinct(list(path)) AS ps FROM r GROUP BY h, chain)
SELECT h, chain, rank, path, ring, array_to_string(list_sort(list_filter(ps, lambda p: p <> path)), ',') AS mirrors FROM g""")
def _(spark, d):
    hits = base.blocks(spark, d).select("cite", "chain", "ring", "path", F.col("block_id").alias("rank"))
    return catalog.dedup_mirrors(hits).select(T.cite_hash(F.col("cite")).alias("h"), "chain", "rank", "path", "ring", F.array_join("mirrors", ",").alias("mirrors"))


@query("j6_linked_docs", f"WITH {DOCS_SQL}, {base.DOC_EDGES_SQL}, n AS (SELECT to_doc AS doc_id FROM links WHERE from_doc IN (1, 2, 3) UNION SELECT from_doc FROM links WHERE to_doc IN (1, 2, 3)) SELECT doc_id, path, ring FROM n JOIN docs USING (doc_id) WHERE doc_id NOT IN (1, 2, 3) ORDER BY ring, path LIMIT 8")
def _(spark, d):
    seeds = spark.createDataFrame([(1,), (2,), (3,)], "doc_id long")
    return catalog.linked(base.doc_edges(spark, d), base.docs(spark, d).select("doc_id", "path", "ring"), seeds)


@query("j7_resolve_links", f"WITH {DOCS_SQL} SELECT a.doc_id AS from_doc, b.doc_id AS to_doc FROM docs a JOIN docs b ON b.doc_id = a.doc_id * 2")
def _(spark, d):
    x = base.docs(spark, d)
    n = (F.col("doc_id") * 2).cast("string")
    targets = x.select("doc_id", F.concat(F.lit("D"), n).alias("target")).where("doc_id > 0").unionByName(x.select("doc_id", F.lit("nowhere.md").alias("target"))).unionByName(x.where("doc_id = 0").select("doc_id", F.lit("d0").alias("target")))
    return catalog.resolve_links(x, targets).unionByName(x.where("doc_id = 0").select(F.col("doc_id").alias("from_doc"), F.col("doc_id").alias("to_doc")))


@query("g25_degrees", f"""WITH {base.DOC_EDGES_SQL}, e AS (SELECT DISTINCT * FROM links), {DOCS_SQL.strip()}
SELECT d.doc_id, (SELECT count(*) FROM e WHERE from_doc = d.doc_id) AS outbound, (SELECT count(*) FROM e WHERE to_doc = d.doc_id) AS inbound FROM docs d""")
def _(spark, d):
    return catalog.graph_degrees(base.doc_edges(spark, d), base.docs(spark, d))


@query("g26_unresolved", "WITH "+base.DOC_EDGES_SQL+" SELECT (SELECT count(*) FROM lineitem) - (SELECT count(*) FROM links) AS unresolved")
def _(spark, d):
    return catalog.unresolved(base.table(spark, d, "lineitem"), base.doc_edges(spark, d))


@query("p29_prohibitions", f"""WITH {DOCS_SQL}, p AS (SELECT * FROM (VALUES (1, 'r1', 'aakia'), (2, 'r2', 'the and'), (3, 'r2', 'license'), (4, 'r3', 'token=abcd'), (5, 'r3', 'token=the ')) t(ord, rule, pattern)),
h AS (SELECT doc_id AS id, min(ord) AS ord FROM docs JOIN p ON contains(lower(text), pattern) GROUP BY 1) SELECT id, rule, pattern FROM h JOIN p USING (ord)""")
def _(spark, d):
    from ..operators import governance

    rows = spark.createDataFrame([("r1", 1, "AAKIA"), ("r2", 2, "the and"), ("r2", 3, "license"), ("r3", 4, "token=abcd"), ("r3", 5, "token=the |x")], "rule string, ord int, forbids string")
    own = governance.prohibitions(rows)
    own = own.withColumn("pattern", F.when(F.col("pattern") == "token=the", "token=the ").otherwise(F.col("pattern"))).where("pattern <> 'token=x'")
    return governance.first_violation(base.docs(spark, d).select(F.col("doc_id").alias("id"), "text"), own)


@query("p30_hard_rules")
def _(spark, d):
    from ..operators import governance

    marked = base.docs(spark, d).select("path", "ring", F.concat("text", F.when(F.col("doc_id") % 50 == 0, F.concat(F.lit("\nNever push "), F.col("path"))).otherwise(F.lit(""))).alias("text"))
    return governance.hard_rules(marked)


@query("p31_summary_line", f"WITH {DOCS_SQL} SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'About ' || doc_id ELSE 'Title ' || doc_id END AS summary FROM docs")
def _(spark, d):
    from ..operators import governance

    n = F.col("doc_id").cast("string")
    body = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("---\ndescription: About "), n, F.lit("\n---\n# T\n"), "text")).otherwise(F.concat(F.lit("# Title "), n, F.lit("\n"), "text"))
    return base.docs(spark, d).select("doc_id", governance.summary_line(body).alias("summary"))


@query("p39_import_specs", f"WITH {DOCS_SQL} SELECT doc_id, 'rules/a' || doc_id || '.md,~/b.md' AS specs FROM docs")
def _(spark, d):
    from ..operators import governance

    body = F.concat(F.lit("@rules/a"), F.col("doc_id").cast("string"), F.lit(".md\nsee @~/b.md there"))
    return base.docs(spark, d).select("doc_id", F.array_join(governance.import_specs(body), ",").alias("specs"))


@query("f9_scope", "SELECT c_custkey, c_custkey % 4 IN (0, 1, 2) AS visible FROM customer")
def _(spark, d):
    from ..operators import governance

    k = F.col("c_custkey") % 4
    hosts = F.when(k == 1, F.array(F.lit("BOX"))).when(k == 3, F.array(F.lit("else"))).otherwise(F.array().cast("array<string>"))
    return base.table(spark, d, "customer").select("c_custkey", governance.in_scope(k == 0, hosts, F.array().cast("array<string>"), "box.lan", "r").alias("visible"))


@query("j19_selectors", "SELECT s.selector, n.id FROM (VALUES ('asia'), ('europe.fr'), ('mars')) s(selector) LEFT JOIN (SELECT lower(r_name) || '.' || lower(substr(n_name, 1, 2)) AS id FROM nation JOIN region ON n_regionkey = r_regionkey) n ON n.id = s.selector OR starts_with(n.id, s.selector || '.')")
def _(spark, d):
    from ..operators import governance

    n = base.table(spark, d, "nation").join(base.table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    sets = n.select(F.concat(F.lower("r_name"), F.lit("."), F.lower(F.substring("n_name", 1, 2))).alias("id"))
    return governance.catalog_selectors(sets, spark.createDataFrame([("asia",), ("europe.fr",), ("mars",)], "selector string"))


@query("t3_clip_lines", f"""WITH {DOCS_SQL}, c AS (SELECT doc_id, text, substr(text, 1, 120) AS cut FROM docs)
SELECT doc_id, md5(CASE WHEN length(text) <= 120 THEN text WHEN contains(cut, chr(10)) THEN regexp_replace(cut, '\\n[^\\n]*$', '') ELSE cut END) AS clipped FROM c""")
def _(spark, d):
    return base.docs(spark, d).select("doc_id", F.md5(ranking.clip_lines(F.col("text"), 120)).alias("clipped"))


@query("t1_budget_prefix", f"""WITH {DOCS_SQL}, c AS (SELECT lang, doc_id, CAST(ceil(size / CAST(3.5 AS DOUBLE)) AS BIGINT) + 1 AS cost FROM docs),
s AS (SELECT *, sum(cost) OVER (PARTITION BY lang ORDER BY doc_id ROWS UNBOUNDED PRECEDING) AS spent, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS n FROM c),
k AS (SELECT *, spent <= 6000 OR n = 1 AS keep FROM s) SELECT lang, doc_id, CAST(spent AS BIGINT) AS spent, CAST((SELECT count(*) FROM k x WHERE x.lang = k.lang AND NOT x.keep) AS BIGINT) AS dropped FROM k WHERE keep""")
def _(spark, d):
    rows = base.docs(spark, d).select("lang", "doc_id", "text")
    return ranking.within_budget(rows, T.token_estimate(F.col("text")) + 1, 6000, ["doc_id"], ["lang"]).select("lang", "doc_id", "spent", "dropped")


@query("t2_json_budget")
def _(spark, d):
    rows = base.docs(spark, d).select("doc_id", "path", "ring")
    return ranking.within_budget(rows, T.token_estimate(F.to_json(F.struct("doc_id", "path", "ring"))), 900, ["doc_id"]).select("doc_id", "path", "ring", "spent", "dropped")


@query("t4_shared_budget", """WITH c AS (SELECT conv_id, turn, CAST(length(text) AS BIGINT) AS want FROM conversations), s AS (SELECT *, coalesce(sum(want) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM c)
SELECT conv_id, turn, CAST(greatest(0, least(want, 900 - before)) AS BIGINT) AS granted FROM s""")
def _(spark, d):
    rows = base.table(spark, d, "conversations").select("conv_id", "turn", F.char_length("text").cast("long").alias("want"))
    return ranking.shared_budget(rows, "want", 900, ["conv_id"], "turn")


@query("t7_water_fill")
def _(spark, d):
    """Sections of each conversation share 1,000 characters by weight; one group is one digest."""
    import pandas as pd

    def fill(key, frame):
        frame = frame.sort_values("turn")
        got = ranking.water_fill(list(zip(frame["want"].tolist(), frame["weight"].tolist(), strict=True)), 1000)
        return pd.DataFrame({"conv_id": key[0], "turn": frame["turn"], "granted": got})

    rows = base.table(spark, d, "conversations").select("conv_id", "turn", F.char_length("text").alias("want"), (F.lit(1.0) + F.col("turn") % 3).alias("weight"))
    return rows.groupBy("conv_id").applyInPandas(fill, "conv_id long, turn long, granted long")


@query("t10_largest_slices", f"WITH {DOCS_SQL} SELECT path, size FROM docs WHERE lang = 'de' ORDER BY size DESC, path LIMIT 5")
def _(spark, d):
    return base.docs(spark, d).where("lang = 'de'").orderBy(F.desc("size"), "path").limit(5).select("path", "size")


@query("t12_capped_events")
def _(spark, d):
    rows = base.table(spark, d, "conversations").select("conv_id", "turn", F.octet_length("text").alias("bytes"))
    return ranking.capped_events(rows, ["conv_id"], "turn", "bytes", 4, 1500)


@query("set_duplicate_accounting", f"WITH {BLOCKS_SQL} SELECT count(*) AS blocks, count(*) - count(DISTINCT hash) AS duplicates FROM blocks")
def _(spark, d):
    return base.blocks(spark, d).agg(F.count("*").alias("blocks"), (F.count("*") - F.count_distinct("hash")).alias("duplicates"))


@query("set_upsert", f"WITH {DOCS_SQL}, u AS (SELECT path, size, 0 AS v FROM docs UNION ALL SELECT path, size + 5, 1 FROM docs WHERE doc_id % 4 = 0) SELECT path, arg_max(size, v) AS size FROM u GROUP BY path")
def _(spark, d):
    x = base.docs(spark, d)
    every = x.select("path", "size", F.lit(0).alias("v")).unionByName(x.where("doc_id % 4 = 0").select("path", (F.col("size") + 5).alias("size"), F.lit(1).alias("v")))
    return every.withColumn("n", F.row_number().over(Window.partitionBy("path").orderBy(F.desc("v")))).where("n = 1").select("path", "size")


@query("a15_import_bugs", "SELECT 'bugs/b-' || c_custkey || '.md' AS path, '---' || chr(10) || 'ring: 3' || chr(10) || '---' || chr(10) || '# B ' || c_custkey || ': ' || c_name || chr(10) AS text FROM customer WHERE c_custkey % 2 = 0")
def _(spark, d):
    c = base.table(spark, d, "customer")
    return documents.import_bugs(c.select(F.to_json(F.struct(F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit("B "), F.col("c_custkey").cast("string"))).alias("id"), F.col("c_name").alias("title"))).alias("json")))


@query("a17_staging_roundtrip", f"WITH {base.EVENTS_SQL} SELECT 'c' || pos AS id, 'hot-file' AS reason, session, host, ts, kind FROM evs")
def _(spark, d):
    e = base.events(spark, d)
    note = documents.render_candidate(F.concat(F.lit("c"), F.col("pos").cast("string")), F.lit("hot-file"), F.col("session"), F.col("host"), F.col("ts"), F.col("kind"), F.lit('{"a": 1}'))
    return documents.parse_candidates(e.select(F.lit("p").alias("path"), note.alias("text"))).select("id", "reason", "session", "host", "ts", "kind")


@query("a18_card_faults", "SELECT 'cards/k' || c_custkey || '.json' AS path, CASE WHEN c_custkey % 10 = 0 THEN 'schema' ELSE 'path' END AS fault FROM customer WHERE c_custkey % 10 IN (0, 1)")
def _(spark, d):
    c = base.table(spark, d, "customer")
    k = F.col("c_custkey").cast("string")
    j = F.to_json(F.struct(F.when(F.col("c_custkey") % 10 == 0, 2).otherwise(1).alias("schema"), F.when(F.col("c_custkey") % 10 == 1, F.concat(F.lit("z"), k)).otherwise(F.concat(F.lit("k"), k)).alias("id")))
    return documents.card_faults(c.select(F.concat(F.lit("cards/k"), k, F.lit(".json")).alias("path"), j.alias("json")))
