"""Readiness of retrieval on many hosts: eight checks over what a fixed fixture returned on each, and a verdict."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PASS, FAIL, NOT_RUN = "pass", "fail", "not-run"
# Device classes that count as local acceleration.
DEVICES = ("npu", "gpu", "cpu")


@dataclass(frozen=True)
class Fixture:
    """Paths of the fixture's documents: the keyword trap, the note that links, the note meant by the query, the end of the link."""

    decoy: str
    linker: str
    meant: str
    link_target: str
    documents: int
    limit: int


def _verdict(passed: Column, ran: Column | None = None, otherwise: Column | None = None) -> Column:
    """Pass or fail where the step ran; elsewhere ``otherwise``, by default not-run."""
    decided = F.when(F.coalesce(passed, F.lit(False)), PASS).otherwise(FAIL)
    if ran is None:
        return decided
    return F.when(F.coalesce(ran, F.lit(False)), decided).otherwise(F.lit(NOT_RUN) if otherwise is None else otherwise)


def checks(seen: DataFrame, fixture: Fixture) -> DataFrame:
    """``host, check, status, required``: eight rows a host.

    ``seen``, a row a host: ``host``; rankings ``bm25, vector, hybrid, neighbours`` (arrays of paths, null where not made); ``profile_ok,
    configured, active, query_vector, edge_active, rerank_enabled`` (boolean); ``documents, rerank_in, rerank_out`` (counts);
    ``rerank_status`` (active, disabled, others are faults); ``route, execution_route, backend, device`` of the embedding call.
    Nulls never pass. A step that is configured and gave nothing fails; one that is not configured did not run."""
    has = lambda c, path: F.array_contains(c, path)
    silent = F.when(F.coalesce("configured", F.lit(False)), FAIL).otherwise(NOT_RUN)
    whole = F.col("active") & F.col("query_vector") & (F.col("documents") == fixture.documents)
    ordered = has("vector", fixture.meant) & has("vector", fixture.decoy) & (F.array_position("vector", fixture.meant) < F.array_position("vector", fixture.decoy))
    both = (F.size("hybrid") == fixture.limit) & has("hybrid", fixture.meant) & has("hybrid", fixture.decoy)
    reranked = (F.col("rerank_status") == "active") & (F.col("rerank_in") > 0) & (F.col("rerank_out") == F.col("rerank_in"))
    local = (F.col("route") == "local-package") & (F.col("execution_route") == "local") & (F.col("backend") != "endpoint") & F.col("device").isin(*DEVICES)
    always = F.lit(True)
    table = [
        ("bm25", _verdict((F.get("bm25", F.lit(0)) == fixture.decoy) & has("bm25", fixture.linker)), always),
        ("profile_admission", _verdict(F.col("profile_ok")), always),
        ("vector_output", F.when(F.coalesce(whole, F.lit(False)), PASS).otherwise(silent), always),
        ("semantic_ranking", _verdict(ordered, F.col("vector").isNotNull(), silent), always),
        ("hybrid_fusion", _verdict(both, F.col("hybrid").isNotNull(), silent), always),
        ("reranker", _verdict(reranked, F.coalesce(F.col("rerank_status") != "disabled", always)), F.coalesce("rerank_enabled", F.lit(False))),
        ("graph_expansion", _verdict(F.col("edge_active") & has("neighbours", fixture.link_target)), always),
        ("local_acceleration", _verdict(local, F.col("active")), always),
    ]
    rows = F.array(*(F.struct(F.lit(n).alias("check"), s.alias("status"), r.alias("required")) for n, s, r in table))
    return seen.select("host", F.explode(rows).alias("c")).select("host", "c.*")


def verdicts(found: DataFrame) -> DataFrame:
    """``host, ready, passed, failed, not_run``: ready where every required check passed."""
    count = lambda status: F.count(F.when(F.col("status") == status, 1))
    return found.groupBy("host").agg(
        F.bool_and((F.col("status") == PASS) | ~F.col("required")).alias("ready"), count(PASS).alias("passed"), count(FAIL).alias("failed"), count(NOT_RUN).alias("not_run")
    )
