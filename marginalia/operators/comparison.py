"""Paired comparisons of arms and benchmark statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def arms(sessions: DataFrame) -> DataFrame:
    """``arm`` of each session: bare without a mention, treated where delivered, else gap."""
    return sessions.withColumn("arm", F.when(~F.col("mentions"), "bare").when(F.col("delivered") > 0, "treated").otherwise("gap"))


def medians(sessions: DataFrame, dimensions: list[str]) -> DataFrame:
    return sessions.groupBy("arm").agg(F.count("*").alias("sessions"), *(F.median(d).alias(f"median_{d}") for d in dimensions))


def rerun_rate(calls: DataFrame, least: int = 5) -> DataFrame:
    """Per arm: repeated commands as a percentage of the calls of sessions with enough of them; null without calls. ``calls``: ``arm, session, command``."""
    per = calls.groupBy("arm", "session").agg(F.count("*").alias("n"), F.count_distinct("command").alias("d")).where(F.col("n") >= least)
    return per.groupBy("arm").agg(F.count("*").alias("sessions"), F.sum("n").alias("calls"), F.sum(F.col("n") - F.col("d")).alias("repeats")).withColumn("rate", F.when(F.col("calls") > 0, F.round(F.col("repeats") * 100.0 / F.col("calls"), 6)))


def paired_delta(sessions: DataFrame, value: str, least: int = 3) -> DataFrame:
    """One row: pairs of arms under one key, and the median of treated minus bare, null below ``least`` pairs."""
    per = sessions.groupBy("pair_key").pivot("arm", ["bare", "treated"]).agg(F.median(value)).where("bare is not null and treated is not null")
    return per.agg(F.count("*").alias("pairs"), F.median(F.col("treated") - F.col("bare")).alias("m")).select("pairs", F.when(F.col("pairs") >= least, F.round("m", 6)).alias("median_delta"))


def rerun_verdict(rates: DataFrame, band: float = 2.0, least: int = 3) -> DataFrame:
    """One row: how treated compares with bare."""
    row = rates.agg(*(F.max(F.when(F.col("arm") == a, F.col(c))).alias(f"{a}_{c}") for a in ("bare", "treated") for c in ("sessions", "rate")))
    d = F.col("treated_rate") - F.col("bare_rate")
    enough = (F.coalesce("bare_sessions", F.lit(0)) >= least) & (F.coalesce("treated_sessions", F.lit(0)) >= least) & d.isNotNull()
    verdict = F.when(~enough, "not-measured").when((F.abs(d) <= band) & (F.col("bare_rate") <= band), "not-measured").when(F.abs(d) <= band, "tie").when(d < 0, "lower").otherwise("higher")
    return row.select(verdict.alias("verdict"))


def hazen(rows: DataFrame, value: str, partition: list[str] | None = None) -> DataFrame:
    """Percentile (average position - 0.5) / n * 100; equals share their average position."""
    part = Window.partitionBy(*(partition or [F.lit(0)]))
    ties = F.count("*").over(Window.partitionBy(*(partition or []), value))
    place = F.rank().over(part.orderBy(value)) + (ties - 1) / 2
    return rows.withColumn("percentile", F.round((place - 0.5) / F.count("*").over(part) * 100, 6))


def bootstrap_median(rows: DataFrame, group: str, value: str, draws: int = 2000, seed: int = 7) -> DataFrame:
    """Quartiles of the bootstrapped median of each group; groups are the few runs of one metric."""
    import numpy as np
    import pandas as pd

    def run(key, frame: pd.DataFrame) -> pd.DataFrame:
        x = np.sort(frame["_v"].to_numpy(float))
        picks = np.random.default_rng(seed).integers(0, len(x), (draws, len(x)))
        q = np.percentile(np.median(x[picks], axis=1), [25, 75])
        return pd.DataFrame({"grp": [key[0]], "n": [len(x)], "median": [float(np.median(x))], "q1": [float(q[0])], "q3": [float(q[1])]})

    return rows.select(F.col(group).cast("string").alias("grp"), F.col(value).cast("double").alias("_v")).groupBy("grp").applyInPandas(run, "grp string, n long, median double, q1 double, q3 double")


def mann_whitney(rows: DataFrame, group: str, value: str, first: str, second: str) -> DataFrame:
    """One row: U of ``first`` and the z of its normal approximation, equals by average rank."""
    own = rows.where(F.col(group).isin(first, second)).select(F.col(group).alias("g"), F.col(value).alias("v"))
    counted = own.groupBy("v").agg(F.count("*").alias("t"), F.sum((F.col("g") == first).cast("long")).alias("a"))
    below = F.coalesce(F.sum("t").over(Window.orderBy("v").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranked = counted.withColumn("r", below + (F.col("t") + 1) / 2)
    s = ranked.agg(F.sum(F.col("a") * F.col("r")).alias("rs"), F.sum("a").alias("n1"), (F.sum("t") - F.sum("a")).alias("n2"))
    u = F.col("rs") - F.col("n1") * (F.col("n1") + 1) / 2
    mean, sd = F.col("n1") * F.col("n2") / 2, F.sqrt(F.col("n1") * F.col("n2") * (F.col("n1") + F.col("n2") + 1) / 12)
    return s.select(F.round(u, 3).alias("u"), F.round((u - mean) / sd, 6).alias("z"), "n1", "n2")
