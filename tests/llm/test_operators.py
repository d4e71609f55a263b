"""Each training-data operator on small tables: against brute force or SQL, and with nulls, empties, ties, repeats and odd columns."""

import hashlib
import itertools
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from marginalia.llm import common, jaccard, language, lines, mixing, pieces, quality, registry, secrets, vectors, warc
from tests.compare import assert_same

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, texts, extra=False):
    rows = [(i, t, "en", f"s{(i or 0) % 3}", None) for i, t in texts]
    df = spark.createDataFrame(rows, DOCS)
    return df.withColumn("h1", F.lit(1)).withColumn("n", F.lit("x")).withColumn("drops", F.lit(2)) if extra else df


ODD = [(None, "a b c d e f"), (1, None), (2, ""), (3, " \n "), (4, "x" * 50_000), (5, "same text of words here"), (5, "same text of words here"), (6, "same text of words here")]


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_matches_sql(name, spark, data):
    assert_same(registry.QUERIES[name], registry.SQL[name], spark, data)


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(400, 480)]
    parent = {}

    def find(x):
        while parent.get(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    got = {r["node"]: r["component"] for r in common.components(spark, spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for e in edges if e[0] != e[1] for x in e}
    assert common.components(spark, spark.createDataFrame([], "a long, b long")).count() == 0


# ---- 1


def test_warc_round_trip(spark, tmp_path):
    big = "é" * 300
    rows = [(1, "http://a/ b\n", big), (2, None, big), (2, "http://c", big), (3, "u", "short"), (4, "u", "short"), (5, "u", None), (None, "u", big), (6, "u", "a\r\n\r\nb" * 50)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit(1))
    manifest = warc.write_archives(warc.assign(pages), f"file://{tmp_path}", max_bytes=300)
    found = warc.read_archives(manifest.select("path")).collect()
    assert len(found) == len(rows) and all(r["block_ok"] and r["payload_ok"] is not False for r in found)
    by = {(r["page_id"], r["url"]): r for r in found}
    assert {r["record_type"] for r in found if r["page_id"] == 2} == {"revisit"} and {r["refers_to"] for r in found if r["page_id"] == 2} == {1}
    assert [r["record_type"] for r in found if r["page_id"] in (3, 4, 5, None)] == ["response"] * 4
    assert by[(6, "u")]["payload"] == ("a\r\n\r\nb" * 50).encode() and by[(5, "u")]["payload_bytes"] == 0
    assert by[(1, "http://a/%20b%0A")]["payload_digest"] == hashlib.sha256(big.encode()).hexdigest()
    assert warc.write_archives(warc.assign(pages.limit(0)), f"file://{tmp_path}").count() == 0


def test_warc_broken_archives():
    import io

    record = warc.build_record(1, "http://a", b"payload", hashlib.sha256(b"payload").hexdigest(), None)
    assert [r["payload"] for r in warc.read_records(io.BytesIO(record * 3))] == [b"payload"] * 3
    for bad in (record[:-9], record + b"junk", record[:40]):
        with pytest.raises(Exception):
            list(warc.read_records(io.BytesIO(bad)))
    wrong = warc.build_record(1, "http://a", b"payload", "0" * 64, None)
    assert next(warc.read_records(io.BytesIO(wrong)))["payload_ok"] is False


# ---- 2


def test_line_dedup(spark):
    line = "A line that many documents do share"
    texts = [(1, f"{line}\nown one"), (2, f" {line.upper()}\t\nown two\n{line}"), (3, line), (4, "Ä line that is kept as it stands here"), (5, "ä line that is kept as it stands here"), *((i, "short line") for i in (6, 7, 8)), *ODD[:1]]
    got = {r["doc_id"]: (r["text"], r["n_lines"], r["n_dropped"]) for r in lines.drop_common_lines(docs(spark, texts, True)).collect()}
    assert got[1] == ("own one", 2, 1) and got[2] == ("own two", 3, 2) and got[3] == (line, 1, 0)
    assert got[6] == ("short line", 1, 0) and got[4][2] == got[5][2] == 0
    odd = lines.drop_common_lines(docs(spark, ODD, True))
    assert odd.count() == len(ODD) and odd.where("n_dropped > 0").count() == 0 and "h1" in odd.columns
    assert lines.drop_common_lines(docs(spark, [])).count() == 0
    null_id = lines.drop_common_lines(docs(spark, [(None, line), (1, line), (2, line), (3, line)]))
    assert sorted((r["doc_id"] is None, r["n_dropped"]) for r in null_id.collect()) == [(False, 0), (False, 1), (False, 1), (True, 1)]


def test_line_dedup_keeps_rows_apart(spark):
    line = "A line that many documents do share"
    alone = "a line that stands in one row only, number"
    texts = [(1, line), (2, line), (3, line), (None, f"{line}\nx"), (None, f"{alone} 1\n{line}"), (None, f"{alone} 2"), (None, f"{alone} 2"), (2, f"{alone} 3\n{line}"), (3, f"{alone} 4\n{line}")]
    got = sorted(((r["doc_id"] or 0, r["text"], r["n_lines"], r["n_dropped"]) for r in lines.drop_common_lines(docs(spark, texts, True)).collect()))
    assert got == sorted([(1, "", 1, 1), (2, "", 1, 1), (3, line, 1, 0), (0, "x", 2, 1), (0, f"{alone} 1", 2, 1), *[(0, f"{alone} 2", 1, 0)] * 2, (2, f"{alone} 3", 2, 1), (3, f"{alone} 4\n{line}", 2, 0)])


def test_line_dedup_passes_columns_of_any_name(spark):
    line = "A line that many documents do share"
    odd = docs(spark, [(i, f"{line}\nown {i}") for i in range(5)]).selectExpr("*", *(f"concat('{x}', doc_id) as `{x}`" for x in ("_drops", "_r1", "r2", "_LINES", "__text", "salt", "holder", "a.b", "n_lines")))
    got = sorted(tuple(r) for r in lines.drop_common_lines(odd).select("doc_id", "text", "_drops", "_r1", "r2", "_LINES", "__text", "salt", "holder", "`a.b`", "n_lines", "n_dropped").collect())
    assert got == [(i, f"own {i}" if i < 4 else f"{line}\nown 4", *(f"{x}{i}" for x in ("_drops", "_r1", "r2", "_LINES", "__text", "salt", "holder", "a.b")), 2, int(i < 4)) for i in range(5)]


def test_line_dedup_brute_force(spark):
    rng = random.Random(8)
    pool = [f" Line {k} of the pool, long enough\t" for k in range(12)] + ["short", "", "ÄÄÄÄ a line of twenty points and more"]
    rows = [(rng.choice([None, *range(40)]), "\n".join(rng.choice(pool) + rng.choice(["", "", f" {k}"]) for _ in range(rng.randrange(1, 9)))) for k in range(120)]
    key = lambda x: re.sub("[A-Z]", lambda m: m[0].lower(), x.strip(" \t\r\x0b\x0c"))
    holders = {}
    for i, text in rows:
        for x in text.split("\n"):
            if i is not None and len(key(x)) >= 20:
                holders.setdefault(key(x), set()).add(i)
    dropped = lambda i, x: len(holders.get(key(x), ())) >= 3 and i != max(holders[key(x)])
    want = sorted((i if i is not None else -1, "\n".join(x for x in t.split("\n") if not dropped(i, x)), t.count("\n") + 1, sum(dropped(i, x) for x in t.split("\n"))) for i, t in rows)
    got = lines.drop_common_lines(docs(spark, rows)).collect()
    assert sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["text"], r["n_lines"], r["n_dropped"]) for r in got) == want


# ---- 3


def test_mixing(spark, data):
    d = common.table(spark, data, "documents")
    cells = d.groupBy(F.col("source").alias("_source"), mixing._named(F.col("lang"), mixing.LANGUAGES).alias("_lang"), mixing.topic_of(F.col("text")).alias("_topic")).agg(F.sum(mixing.token_count(F.col("text"))).alias("mass"))
    ratios = mixing.fit(cells, mixing.LANGUAGES, mixing.TOPICS, 0.7, 100).join(cells, ["_source", "_lang", "_topic"]).toPandas()
    weight = ratios["mass"] * ratios["ratio"]
    share = weight.groupby(ratios["_lang"]).sum() / weight.sum()
    assert all(abs(share[k] - v) < 1e-3 for k, v in mixing.LANGUAGES.items())
    odd = mixing.mix(docs(spark, ODD, True)).collect()
    assert all(r["mix_copies"] >= 1 and abs(r["mix_copies"] - r["mix_p"]) < 1 for r in odd)
    assert mixing.mix(docs(spark, [])).count() == 0


@pytest.mark.parametrize("keep", [0.8, 0.1])
def test_mixing_sample_meets_the_targets(spark, data, keep):
    many = common.table(spark, data, "documents").withColumn("doc_id", F.explode(F.transform(F.sequence(F.lit(0), F.lit(199)), lambda i: F.col("doc_id") + i * 1_000_000)))
    got = mixing.mix(many, keep=keep).groupBy("lang", "mix_topic").agg(F.sum(F.col("mix_tokens") * F.col("mix_copies")).alias("n")).toPandas()
    total = got["n"].sum()
    before = many.agg(F.sum(mixing.token_count(F.col("text")))).first()[0]
    assert abs(total / before / keep - 1) < 0.06
    for column, targets in (("mix_topic", mixing.TOPICS), ("lang", mixing.LANGUAGES)):
        shares = got.groupby(column)["n"].sum() / total
        assert all(abs(shares[k] - v) < 0.02 for k, v in targets.items()), shares


def test_mixing_passes_columns_of_any_name(spark):
    odd = docs(spark, [(i, "some words here " * 30) for i in range(30)]).selectExpr("*", *(f"concat('{x}', doc_id) as `{x}`" for x in ("_source", "_p", "_tokens", "__weight", "_salt", "a.b")))
    got = mixing.copies(mixing.mix(odd)).select("doc_id", "_source", "_p", "_tokens", "__weight", "_salt", "`a.b`").collect()
    assert got and all(tuple(r)[1:] == tuple(f"{x}{r['doc_id']}" for x in ("_source", "_p", "_tokens", "__weight", "_salt", "a.b")) for r in got)


def test_mixing_salted_equals_broadcast(spark, data, monkeypatch):
    d = common.table(spark, data, "documents")
    one = {r["doc_id"] for r in mixing.mix(d, keep=0.5).select("doc_id").collect()}
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", 0)
    assert {r["doc_id"] for r in mixing.mix(d, keep=0.5).select("doc_id").collect()} == one


# ---- 4


def test_pieces_equal_library(spark, data):
    import sentencepiece

    lib = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    got = pieces.encode(common.table(spark, data, "documents")).join(common.table(spark, data, "documents").select("doc_id", "text"), "doc_id").collect()
    assert all(r["ids"] == lib.encode(r["text"]) and r["restored"] for r in got)
    odd = {(r["doc_id"], tuple(r["ids"])) for r in pieces.encode(docs(spark, ODD, True)).collect()}
    assert {(i, tuple(lib.encode(t or ""))) for i, t in ODD} == odd
    back = pieces.decode(pieces.encode(docs(spark, [(1, "a  é中😀\n"), (2, "")]))).collect()
    assert {r["text"] for r in back} == {"a  é中😀\n", ""}
    assert pieces.encode(docs(spark, [])).count() == 0


def test_pieces_of_hard_texts_equal_library():
    import sentencepiece

    lib, own, rng = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL), pieces.Tokenizer(pieces.Model(open(pieces.MODEL, "rb").read())), random.Random(4)
    letters = ["".join(rng.choice("aab abcdeehsst t\n-.AÜé中0000") for _ in range(rng.randint(1, 40))) for _ in range(3000)]
    joined = ["".join(rng.choice(own.text[300:]).replace(pieces.BLANK, " ") for _ in range(rng.randint(1, 30))) for _ in range(100)]
    runs = [" " * 8000, " x" * 300 + " " * 77, "a" * 5000, "ab" * 3000, "=" * 3001, "\n" * 999, "中" * 100, "0" * 1000, ("   " * 7 + "word ") * 500]
    assert all(list(own.encode(x)) == lib.encode(x) for x in (*letters, *joined, *runs))


def test_pieces_of_a_megabyte_of_blanks():
    import time

    own = pieces.Tokenizer(pieces.Model(open(pieces.MODEL, "rb").read()))
    began = time.process_time()
    for text in (" " * 1_000_000, "  ab" * 250_000, "x" * 1_000_000):
        assert own.decode(own.encode(text)) == text
    assert time.process_time() - began < 120


def test_pair_fits_as_merging_says():
    """Random merge lists: pieces made of earlier ones, in order of priority."""
    rng = random.Random(5)
    for _ in range(30):
        score = {c: 0.0 for c in "abc"}
        for k in range(25):
            a, b = rng.choice(list(score)), rng.choice(list(score))
            if len(a + b) <= 8 and a + b not in score:
                score[a + b] = -1.0 - k
        merges = pieces.Merges(score)
        for left, right in itertools.product(merges.cut, repeat=2):
            assert merges.fit(left, right) == (merges.merge(left + right)[0] == [left, right])


def test_unigram_viterbi_is_best():
    model = object.__new__(pieces.Model)
    words = {"a": -1.0, "b": -2.0, "ab": -2.5, "ba": -2.2, "aba": -4.9, "▁": -0.5, "▁a": -1.2}
    model.pieces = [("<unk>", 0.0, 2), *((w, s, 1) for w, s in words.items())]
    model.merges, model.bpe = None, False
    model.byte_fallback = model.crossing = False
    model.prefix, model.unknown, model.bytes = True, 0, {}
    model.ids = {p: i for i, (p, _, k) in enumerate(model.pieces) if k == 1}
    own = pieces.Tokenizer(model)

    def best(text):
        if not text:
            return 0.0
        options = [words[w] + best(text[len(w) :]) for w in words if text.startswith(w)]
        return max(options, default=float("-inf"))

    for n in range(1, 7):
        for letters in itertools.product("ab ", repeat=n):
            text = "▁" + "".join(letters).replace(" ", "▁")
            ids = own.encode("".join(letters))
            assert abs(sum(model.pieces[i][1] for i in ids) - best(text)) < 1e-9 and own.decode(ids) == "".join(letters)
    assert list(own.encode("axxa")) == [model.ids["▁a"], 0, model.ids["a"]]


# ---- 5, 6


def _vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")


@pytest.mark.parametrize("dim", [1, 2, 3, 5, 16, 64, 300])
def test_linked_block_loses_no_link(dim):
    """Pairs at and about the threshold, whose difference lies in any direction, one of the projections' own included."""
    rng = np.random.default_rng(dim)
    own = vectors.rotation(dim).T
    rows = []
    for k in range(120):
        v = rng.standard_normal(dim)
        v /= np.linalg.norm(v)
        d = own[k % len(own)] if k % 2 else rng.standard_normal(dim)
        d = d - (d @ v) * v
        if np.linalg.norm(d) > 1e-9:
            cosine = rng.choice([0.9801, 0.98 + 1e-9, 0.985, 0.9799, 0.99])
            rows.append((cosine * v + np.sqrt(1 - cosine**2) * d / np.linalg.norm(d)) * rng.uniform(0.1, 9))
        rows.append(v)
    m = np.array(rows)
    unit = m / np.linalg.norm(m, axis=1)[:, None]
    want = {(i, j) for i, j in zip(*np.nonzero(unit @ unit.T >= 0.98 + 1e-12), strict=True) if i < j}
    never = {(i, j) for i, j in zip(*np.nonzero(unit @ unit.T < 0.98 - 1e-12), strict=True)}
    got = set(zip(*(x.tolist() for x in vectors._linked_block(m, m, True, 0.98)), strict=True))
    assert want <= got and not got & never
    cross = set(zip(*(x.tolist() for x in vectors._linked_block(m[:70], m[70:], False, 0.98)), strict=True))
    assert cross == {(i, j - 70) for i, j in got if i < 70 <= j}


def test_near_vectors_brute_force(spark, monkeypatch):
    monkeypatch.setattr(vectors, "BLOCK_ROWS", 40)
    rng, rows = np.random.default_rng(1), []
    for g in range(40):
        centre = rng.standard_normal(16)
        for _ in range(1 + g % 9):
            rows.append((len(rows), [float(np.float32(x)) for x in centre + rng.standard_normal(16) * 0.09], g % 3))
    rows += [(len(rows) + i, rows[3][1], rows[3][2]) for i in range(5)]
    rows += [(900, None, 1), (901, [0.0] * 16, 1), (902, [float("nan")] * 16, 1), (903, rows[3][1], None), (904, [], 1), (905, rows[3][1][:8], rows[3][2]), (906, [None] + rows[3][1][1:], 1)]
    got = {r["vec_id"]: r for r in vectors.near_vectors(_vectors(spark, rows)).collect()}
    fine = [r for r in rows if r[0] < 900]
    m = np.array([r[1] for r in fine], np.float64)
    m /= np.linalg.norm(m, axis=1)[:, None]
    label = np.array([r[2] for r in fine])
    link = (m @ m.T >= 0.98) & (label[:, None] == label)
    np.fill_diagonal(link, False)
    comp = np.arange(len(fine))
    for _ in fine:
        comp = np.minimum(comp, np.where(link, comp, len(fine)).min(1))
    assert link.sum() > 100
    for i in range(len(fine)):
        assert (got[i]["n_links"], got[i]["component_id"], got[i]["kept"]) == (link[i].sum(), comp[i], comp[i] == i)
    assert all(got[i]["n_links"] == 0 and got[i]["component_id"] == i for i in range(900, 907))
    assert vectors.near_vectors(_vectors(spark, [])).count() == 0


def test_collision_count_never_misses():
    rng = np.random.default_rng(3)
    a = rng.standard_normal((200, 64))
    b = a + rng.standard_normal((200, 64)) * 0.2 / 8 * np.linalg.norm(a, axis=1)[:, None]
    cosine = (a * b).sum(1) / np.linalg.norm(a, axis=1) / np.linalg.norm(b, axis=1)
    i, j = vectors._linked_block(a, b, False, 0.98)
    assert {x for x, y in zip(i, j, strict=True) if x == y} == set(np.flatnonzero(cosine >= 0.98)) and 20 < (cosine >= 0.98).sum() < 200


@pytest.mark.parametrize("dim", range(1, 8))
def test_collision_count_never_misses_in_few_dimensions(dim):
    rng = np.random.default_rng(6)
    a = rng.standard_normal((4000, dim))
    b = a / np.linalg.norm(a, axis=1)[:, None]
    b = b + rng.standard_normal((4000, dim)) * 0.12 / dim**0.5
    linked = (a * b).sum(1) / np.linalg.norm(a, axis=1) / np.linalg.norm(b, axis=1) >= 0.98
    found = [len(vectors._linked_block(a[i : i + 1], b[i : i + 1], False, 0.98)[0]) for i in range(4000)]
    assert linked.sum() > 500 and [bool(n) for n in found] == linked.tolist()


def test_top_k_brute_force(spark):
    rng = np.random.default_rng(4)
    rows = [(i, [float(np.float32(x)) for x in np.round(rng.standard_normal(12), 1)], 0) for i in range(130)] + [(131, None, 0), (140, [float("inf")] * 12, 0), (160, [1.0] * 5, 0)]
    df = _vectors(spark, rows).repartition(5)
    got = [tuple(r) for r in vectors.top_k(df, F.col("vec_id") % 20 == 0, query_block=3).orderBy("query_id", "rank").collect()]
    whole = {i: np.floor(64 * np.array(v, np.float32).astype(float)).astype(int) for i, v, _ in rows if i < 130}
    want = []
    for q in range(0, 130, 20):
        scored = sorted((-int(whole[q] @ v), i) for i, v in whole.items() if i != q)[:20]
        want += [(q, k, i, -s) for k, (s, i) in enumerate(scored, 1)]
    assert got == want
    assert vectors.top_k(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0


# ---- 7


def _brute_components(texts):
    found = {}
    for i, t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        found[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    parent = {i: i for i in found}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(found, 2):
        both, either = len(found[a] & found[b]), len(found[a] | found[b])
        if found[a] and found[b] and 100 * both >= 75 * either:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    return {i: (len(found[i]), find(i)) for i in found}


def _edited(rng, words, n):
    words = list(words)
    for _ in range(n):
        words[rng.randrange(len(words))] = f"w{rng.randrange(9999)}"
    return " ".join(words)


@pytest.mark.parametrize("block", [2048, 8])
def test_jaccard_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(jaccard, "BLOCK", block)
    rng, texts = random.Random(5), []
    for g in range(30):
        base = [f"t{rng.randrange(400)}" for _ in range(rng.choice((3, 5, 6, 7, 8, 9, 11, 14, 30, 90, 300)))]
        texts += [(len(texts) + k, _edited(rng, base, rng.randrange(1 + len(base) // 25 + (k % 3 == 0)))) for k in range(rng.randrange(1, 9))]
    base = [f"g{i}" for i in range(150)]  # one large group whose ends don't link with each other
    for k in range(40):
        base[(k * 7) % 150] = f"z{k}"
        texts.append((len(texts), " ".join(base)))
    texts += [(len(texts), "The SAME  words\tof here now"), (len(texts) + 1, "the same words of here now"), (len(texts) + 2, None), (len(texts) + 3, " \n"), (len(texts) + 4, "one two"), (len(texts) + 5, "one two")]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.near_duplicates(docs(spark, texts, True)).collect()}
    assert got == _brute_components(texts)


def test_jaccard_of_words_whose_sums_collide(spark):
    """Thue-Morse words and their complements have equal polynomial hashes modulo 2 ** 64 for every odd base."""
    bits = [bin(i).count("1") & 1 for i in range(1024)]
    one, other = "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)
    texts = [(1, one), (2, other), (3, " ".join([one] * 9)), (4, " ".join([other] * 9)), (5, " ".join([one, other] * 5)), (6, other)]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.near_duplicates(docs(spark, texts)).collect()}
    assert got == _brute_components(texts) and got[2] == (1, 2) and got[6] == (1, 2)


@pytest.mark.parametrize("block", [2048, 3])
def test_jaccard_of_long_sets_at_the_threshold(spark, monkeypatch, block):
    monkeypatch.setattr(jaccard, "BLOCK", block)
    texts = []
    for g in range(12):
        size = 7 * (20 + 35 * g)  # shingles; at 6/7 in common the similarity is 0.75 exactly
        words = [f"g{g}w{i}" for i in range(size + 4)]
        for k, less in enumerate((0, 0, 1)):
            keep = 6 * size // 7 + 4 - less
            texts += [(len(texts), " ".join(words[:keep] + [f"g{g}k{k}x{i}" for i in range(len(words) - keep)]))]
        texts += [(len(texts), " ".join(words))]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.near_duplicates(docs(spark, texts)).collect()}
    assert got == _brute_components(texts)


def test_jaccard_names_the_blocks_left_open(spark):
    """Only blocks with more candidates than their forest holds are to be compared again; all candidates are those of plain loops."""
    from marginalia.llm import shingles

    rng, rows = np.random.default_rng(11), []

    def near(size, k):
        base = rng.integers(0, 1 << 62, size).astype(np.uint64)
        return [np.concatenate([base[: size - x], rng.integers(0, 1 << 62, x).astype(np.uint64)]) for x in range(k)]

    far = [x for size in (20, 90, 600, 600, 700, 2000) for x in near(size, 1)]
    lists = {(1, 0, 0): near(600, 3) + far, (2, 0, 0): near(40, 2) + far, (3, 0, 0): far, (4, 0, 1): near(900, 4), (5, 0, 0): near(30, 1), (6, 1, 1): near(5000, 5)}
    for (token, left, right), sets in lists.items():
        for k, x in enumerate(sets):
            side = 2 if left == right else k % 2
            rows.append((token, left, right, side, 100 * token + k, len(x), 100 * token + (3 if token == 6 and k > 2 else k), bytearray(shingles.parity_bits(x))))
    df = spark.createDataFrame(rows, "token long, left int, right int, side int, doc_id long, n long, comp long, bits binary")
    plain = {
        (x[4], y[4])
        for x, y in itertools.combinations(rows, 2)
        if x[:3] == y[:3] and x[6] != y[6] and (x[3] == 2 or x[3] != y[3]) and 4 * min(x[5], y[5]) >= 3 * max(x[5], y[5]) and 7 * jaccard._popcount_differs(bytes(x[7]), bytes(y[7])) <= x[5] + y[5]
    }
    assert {(r["a"], r["b"]) for r in jaccard._across(df, True).collect()} == plain and len(plain) >= 16
    some = jaccard._across(df, False).collect()
    assert {(r["token"], r["left"], r["right"]) for r in some if r["a"] is None} == {(1, 0, 0), (4, 0, 1), (6, 1, 1)}
    pairs = {(r["a"], r["b"]) for r in some if r["a"] is not None}
    assert pairs <= plain and sorted(a // 100 for a, _ in pairs) == [1, 1, 2, 4, 4, 4, 6, 6, 6]


def test_overlap_of_sets():
    from marginalia.llm import shingles

    rng = np.random.default_rng(3)
    for _ in range(50):
        a, b = (shingles._sorted_set(rng.integers(0, 6, (2, rng.integers(0, 30))).astype(np.uint64)) for _ in range(2))
        left, right = (set(map(tuple, x.T.tolist())) for x in (a, b))
        assert shingles.overlap(a, b) == len(left & right) and a.shape[1] == len(left) and a.T.tolist() == sorted(map(list, left))


def test_jaccard_odd_rows(spark):
    rows = [tuple(r) for r in jaccard.near_duplicates(docs(spark, ODD, True)).collect()]
    assert sorted(rows, key=str) == sorted([(None, 2, None), (1, 0, 1), (2, 0, 2), (3, 0, 3), (4, 1, 4), (5, 1, 5), (5, 1, 5), (6, 1, 5)], key=str)
    kept = jaccard.keep_one_of_each(docs(spark, ODD)).collect()
    assert sorted((r["doc_id"] for r in kept), key=str) == [1, 2, 3, 4, 5, None]
    assert jaccard.near_duplicates(docs(spark, [])).count() == 0


def test_light_boundary_follows_cost():
    assert jaccard.choose_boundary({}, 1.0) in range(13)
    assert jaccard.choose_boundary({3: 1000, 4: 1000}, 500.0) >= 4 > jaccard.choose_boundary({12: 10}, 1.0)


# ---- 8, 9, 10


def test_language_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.01"
    got = registry.QUERIES["op8_language_id"](spark, folder).join(common.table(spark, folder, "documents").select("doc_id", "lang"), "doc_id").where("held_out").toPandas()
    assert (got["lang"] == got["lang_pred"]).mean() > 0.95
    model = {"en": b"the cat and the dog " * 20, "de": b"der hund und die katze " * 20}
    odd = {r["doc_id"]: r["lang_pred"] for r in language.identify(docs(spark, [*ODD[:4], (9, "123 - 4"), (10, "der hund und katze")], True), model).collect()}
    assert (odd[1], odd[2], odd[3], odd[9], odd[10]) == ("und", "und", "und", "und", "de") and odd[None] in model
    assert language.dictionaries(docs(spark, [])) == {} and language.identify(docs(spark, [(1, "text")]), {}).first()["lang_pred"] == "und"


def test_quality_against_labels(spark):
    folder = "/root/testdata/sf0.01"
    got = registry.QUERIES["op9_quality"](spark, folder).withColumnRenamed("quality", "q").join(common.table(spark, folder, "labels"), "doc_id").toPandas()
    clean, junk = got[got["quality"] == 1], got[got["quality"] == 0]
    assert clean["keep"].mean() > 0.99 and (~junk["keep"]).mean() > 0.9


def test_quality_odd_rows(spark):
    weights, posterior, _ = quality.train(docs(spark, ODD, True))
    got = quality.score(docs(spark, ODD, True), weights, posterior).collect()
    assert len(got) == len(ODD) and all(not r["keep"] and r["quality"] == 0 for r in got if r["doc_id"] in (1, 2, 3))
    assert quality.keep_good(docs(spark, [])).count() == 0


def test_quality_sample_is_bounded_and_draws_null_ids(spark):
    seen = []
    same = spark.range(20_000).select(F.lit(None).cast("long").alias("doc_id"), F.concat(F.lit("some words of text number "), F.col("id")).alias("text"))
    for df in (same, same.withColumn("doc_id", F.lit(1).cast("long")), same.withColumn("doc_id", F.expr("cast(substring_index(text, ' ', -1) as long)")), same.withColumn("text", F.lit("one text of words"))):
        seen.append(quality.sample(df, 20_000, 400).count())
    assert seen[:3] == [400] * 3 and seen[3] <= 1


def test_quality_brute_force(spark, data):
    """The whole operator again in plain loops: expectation-maximisation over documents, a dense scorer, one text at a time."""
    rows = [(r["doc_id"], r["text"]) for r in common.table(spark, data, "documents").collect()]
    m = {i: quality.measures(t) for i, t in rows}
    v = {i: quality.votes(x) for i, x in m.items()}
    good = {i: 0.9 if sum(x == -1 for x in y) < 2 else 0.1 for i, y in v.items()}
    for _ in range(200):
        prior = (sum(good.values()) + 1) / (len(good) + 2)
        odds = {i: np.log(prior / (1 - prior)) for i in v}
        for k in range(len(quality.NAMES)):
            mass = {(c, x): 0.5 + sum(good[i] if c else 1 - good[i] for i in v if v[i][k] == x) for c in (0, 1) for x in (-1, 1)}
            for i in v:
                if v[i][k]:
                    odds[i] += np.log(mass[1, v[i][k]] / (mass[1, -1] + mass[1, 1])) - np.log(mass[0, v[i][k]] / (mass[0, -1] + mass[0, 1]))
        after = {i: 1 / (1 + np.exp(-np.clip(x, -30, 30))) for i, x in odds.items()}
        step, good = max(abs(after[i] - good[i]) for i in v), after
        if step < 1e-9:
            break
    dense = {}
    for i, t in rows:
        dense[i] = np.zeros(quality.FEATURES + 1)
        np.add.at(dense[i], quality.features(t, m[i])[0], quality.features(t, m[i])[1])
        dense[i][-1] = 1
    used = [i for i, t in rows if len(t.encode()) <= quality.TRAIN_BYTES]
    x, p = np.array([dense[i] for i in used]), np.array([good[i] for i in used])
    w, seen = np.zeros(x.shape[1]), np.full(x.shape[1], 1e-8)
    for _ in range(150):
        error = (1 / (1 + np.exp(-np.clip(x @ w, -30, 30))) - p) / len(p)
        slope = x.T @ error + 1e-4 * np.append(w[:-1], 0)
        seen += slope**2
        w -= 0.2 * slope / np.sqrt(seen)
    got = {r["doc_id"]: r for r in registry.QUERIES["op9_quality"](spark, data).collect()}
    assert len(got) == len(rows)
    for i, _ in rows:
        q = 1 / (1 + np.exp(-np.clip(dense[i] @ w, -30, 30)))
        assert abs(got[i]["weak_label"] - good[i]) < 1e-6 and abs(got[i]["quality"] - q) < 1e-3 and (abs(q - 0.5) < 1e-3 or got[i]["keep"] == (q >= 0.5))


def test_language_brute_force(spark, data):
    """Each text compressed whole-piece with each language's dictionary, by the library alone."""
    import zstandard

    d = common.table(spark, data, "documents")
    contents = language.dictionaries(d)
    long = "Der Hund und die Katze. " * 20_000
    rows = [*((r["doc_id"], r["text"]) for r in d.collect()), (-1, long), (-2, "7 8"), (-3, None)]
    got = {r["doc_id"]: r["lang_pred"] for r in language.identify(docs(spark, rows), contents).collect()}
    for i, text in rows:
        raw = re.sub(r"(?:\W|\d|_)+", " ", (text or "").lower()).encode()
        if not re.search(r"[^\W\d_]", text or ""):
            assert got[i] == "und"
            continue
        size = {}
        for lang, content in contents.items():
            for at in range(0, len(raw), language.PIECE):
                piece = raw[at : at + language.PIECE]
                data_ = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
                packer = zstandard.ZstdCompressor(level=language.LEVELS[len(piece) > language.SHORT], dict_data=data_, write_content_size=False, write_checksum=False, write_dict_id=False)
                size[lang] = size.get(lang, 0) + len(packer.compress(piece))
        assert size[got[i]] <= min(size.values()) * 1.01
    assert language.identify(docs(spark, []), contents).count() == 0


def test_label_model_finds_accuracies():
    rng, counts = np.random.default_rng(6), {}
    accuracy = np.array([0.95, 0.9, 0.85, 0.9, 0.95, 0.8, 0.9, 0.85, 0.9])
    for good in rng.random(20_000) < 0.8:
        right = rng.random(9) < accuracy
        v = tuple(int(x) for x in np.where(right == good, 1, -1))
        counts[quality._pattern(v)] = counts.get(quality._pattern(v), 0) + 1
    assert np.abs(quality.label_model(counts)[1] - accuracy).max() < 0.02


def test_secrets_brute_force(spark):
    folder = "/root/testdata/sf0.01"
    got = registry.QUERIES["op10_secret_scan"](spark, folder).collect()
    texts = {r["doc_id"]: r["text"] for r in common.table(spark, folder, "documents").collect()}
    assert all(secrets.brute_force(texts[r["doc_id"]]).items() <= r.asDict().items() for r in got)
    made = [*ODD, (20, 'PASSWORD = "hunter2hunter2" é api-key api_KEY:abcdefgh1 token=short'), (21, "AKIA" + "A" * 12 + " AKIAX " + "0a" * 16 + "g" + "0" * 31), (22, "-----BEGIN RSA PRIVATE KEY-----"), (23, "paſſword=abcdefghijk")]
    rows = registry_scan(spark, made)
    assert all(secrets.brute_force(t).items() <= rows[(i, t)].items() for i, t in made)
    assert rows[made[-4]]["n_assign"] == 2 and rows[made[-3]]["n_access"] == rows[made[-3]]["n_hex"] == 1
    assert rows[made[-2]]["spans"] == "private_key:0:31" and rows[made[-1]]["n_assign"] == 0


def registry_scan(spark, made):
    """The query's columns for rows made here, keyed by row."""
    out = {}
    spans = secrets.scan(docs(spark, [(k, t) for k, (_, t) in enumerate(made)], True)).collect()
    for r in spans:
        listed = [(s["kind"], s["start"], s["end"]) for s in r["spans"]]
        base = [x for x in listed if x[0] in ("assign", "access", "hex")]
        text = lambda xs: ",".join(f"{k}:{a}:{b}" for k, a, b in xs)
        out[made[r["doc_id"]]] = {**{f"n_{k}": sum(x[0] == k for x in base) for k in ("assign", "access", "hex")}, "base_sha256": hashlib.sha256(text(base).encode()).hexdigest(), "spans": text(listed)}
    return out


def test_trigram_queries_hold_for_matches():
    assert secrets.trigram_query(r"[0-9a-f]+") == []
    options = {frozenset({b"abc", b"bcd", b"cde"}), frozenset({b"abc", b"bcd", b"cde", b"deh"}), frozenset({b"abc", b"bcf", b"cfg"}), frozenset({b"abc", b"bcf", b"cfg", b"fgh"})}
    assert {o for c in secrets.trigram_query(r"abc(de|fg)h?") for o in c} == options
    rng = random.Random(7)
    rule = secrets.RULES[0]
    query = secrets.trigram_query(rule.pattern, rule.flags)
    for _ in range(200):
        text = "".join(rng.choice(["Password", "api_Key", "APIKEY", "secret", " ", "=", ":", '"', "abcdefgh", "tok", "en"]) for _ in range(8))
        if re.search(rule.pattern, text, re.I | re.A):
            wanted = sorted({t for c in query for o in c for t in o})
            assert len(secrets.Index(wanted, [b"none", text.encode()]).candidates(query))
