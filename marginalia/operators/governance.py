"""Rules over text: prohibitions, hard rules, summaries, scopes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LEAST_PATTERN = 4


def prohibitions(rules: DataFrame) -> DataFrame:
    """``rule, ord, pattern`` from ``rule, ord, forbids``: ``a=x|y`` is ``a=x`` and ``a=y``; short patterns are dropped."""
    prefix = F.when(F.instr("forbids", "=") > 0, F.regexp_extract("forbids", r"^(.*=)", 1)).otherwise(F.lit(""))
    tail = F.substring("forbids", F.char_length("_p") + 1, F.char_length("forbids"))
    parts = rules.withColumn("_p", prefix).withColumn("_t", tail).withColumn("part", F.explode(F.split("_t", r"\|")))
    return parts.select("rule", "ord", F.lower(F.trim(F.concat("_p", F.trim("part")))).alias("pattern")).where(F.char_length("pattern") >= LEAST_PATTERN)


def first_violation(texts: DataFrame, patterns: DataFrame) -> DataFrame:
    """``id, rule, pattern``: the first rule that each text breaks. Patterns are those of a rule file and broadcast."""
    hit = texts.join(F.broadcast(patterns), F.contains(F.lower("text"), F.col("pattern")))
    return hit.groupBy("id").agg(F.min(F.struct("ord", "pattern", "rule")).alias("m")).select("id", "m.rule", "m.pattern")


def hard_rules(docs: DataFrame, most: int = 3) -> DataFrame:
    """Lines that open with a ban, at most 140 characters, each text once, the first ``most`` by ring and order."""
    lines = docs.select("path", "ring", F.posexplode(F.split("text", "\n")).alias("line_no", "line")).withColumn("line", F.trim("line"))
    found = lines.where(F.col("line").rlike(r"(?i)^(never|no|don't|do not)\b") & (F.char_length("line") <= 140))
    one = found.groupBy(F.lower("line").alias("_l")).agg(F.min(F.struct("ring", "path", "line_no", "line")).alias("m")).select("m.*")
    return one.orderBy("ring", "path", "line_no").limit(most)


def summary_line(text: Column) -> Column:
    """Description, else title, else first line of prose, 80 characters at most."""
    described = F.regexp_extract(text, r"(?m)^description:[ \t]*(.+)$", 1)
    title = F.regexp_extract(text, r"(?m)^#{1,6}[ \t]+(.+?)[ \t#]*$", 1)
    prose = F.get(F.filter(F.split(text, "\n"), lambda x: ~x.rlike(r"^\s*($|[#|>`~-]|---)")), F.lit(0))
    pick = F.coalesce(F.nullif(described, F.lit("")), F.nullif(title, F.lit("")), prose)
    return F.substring(F.trim(pick), 1, 80)


def in_scope(always: Column, hosts: Column, repos: Column, host: str, repo: str) -> Column:
    """Always, unscoped, or of this host (whole name or first label) or repository."""
    here = F.exists(hosts, lambda h: (F.lower(h) == host.lower()) | (F.lower(h) == host.split(".")[0].lower()))
    return always | ((F.size(hosts) == 0) & (F.size(repos) == 0)) | here | F.array_contains(repos, repo)


def import_specs(text: Column) -> Column:
    """``@path`` at the start of a line, and ``@~/path`` anywhere."""
    return F.array_union(F.regexp_extract_all(text, F.lit(r"(?m)^@(\S+)"), F.lit(1)), F.regexp_extract_all(text, F.lit(r"@(~/\S+)"), F.lit(1)))


def catalog_selectors(sets: DataFrame, selectors: DataFrame) -> DataFrame:
    """``selector, id``: sets named by a selector or below it; a selector without a set has a null id. Selectors are of file size."""
    hit = sets.join(F.broadcast(selectors), (F.col("id") == F.col("selector")) | F.startswith("id", F.concat("selector", F.lit("."))))
    return selectors.join(hit, "selector", "left").select("selector", "id")


def innermost(paths: DataFrame, slices: DataFrame) -> DataFrame:
    """Slice of each path as a join: longest prefix, then first; ``root`` without one. ``slices``: ``name, prefix, ord``, of config size."""
    hit = paths.join(F.broadcast(slices), (F.col("path") == F.col("prefix")) | F.startswith("path", F.concat("prefix", F.lit("/"))), "left")
    order = Window.partitionBy("path").orderBy(F.desc(F.char_length("prefix")), "ord")
    return hit.withColumn("_n", F.row_number().over(order)).where("_n = 1").select("path", F.coalesce("name", F.lit("root")).alias("slice"))


def grant_access(requests: DataFrame, grants: DataFrame, major: int = 1) -> DataFrame:
    """``slice, peer, mode`` of each request: the mode of the first grant of its slice, by ``ord``, to that peer on this network that has
    not ended, else null. ``requests``: ``slice, peer, now``, each once; ``grants``: ``slice, peer, ord, network_major, expires_at, mode``.

    A grant without a peer is open to nobody yet, one without an end never ends. Grants that cannot count go before the join."""
    usable = grants.where((F.col("network_major") == major) & F.col("peer").isNotNull()).drop("network_major")
    live = requests.join(usable, ["slice", "peer"]).where(F.col("expires_at").isNull() | (F.col("now") < F.col("expires_at")))
    first = live.groupBy("slice", "peer").agg(F.min_by("mode", "ord").alias("mode"))
    return requests.select("slice", "peer").join(first, ["slice", "peer"], "left")
