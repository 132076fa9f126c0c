"""Run metrics: nearest-rank percentiles, arrivals, peak concurrency, query cost, freshness debt."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.operators import ordered


def nearest_rank(rows: DataFrame, by: list[str], value: str, percents: tuple[int, ...] = (50, 95, 99)) -> DataFrame:
    """Exact nearest-rank percentiles per group, with observed count and maximum; null values are censored.

    Distinct values are counted first; the running count of a group is an ordered scan over many tasks.
    """
    seen = rows.filter(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("n"))
    ranked = ordered.running(ordered.spread(seen, by, [value]), by, F.col("n"), "sum", "upto").join(seen.groupBy(*by).agg(F.sum("n").alias("total")), by)
    at = lambda p: F.min(F.when(F.col("upto") >= F.ceil(F.col("total") * p / 100), F.col(value))).alias(f"p{p}")
    told = ranked.groupBy(*by).agg(F.max("total").alias("observed"), *[at(p) for p in percents], F.max(value).alias("max"))
    return rows.groupBy(*by).agg(F.count("*").alias("population")).join(told, by, "left").withColumn("censored", F.col("population") - F.coalesce("observed", F.lit(0))).withColumn("observed", F.coalesce("observed", F.lit(0)))


def arrivals(rows: DataFrame, at: str, start: int, width: int = 1_000_000) -> DataFrame:
    """Rows per time bucket since `start`."""
    return rows.withColumn("bucket", F.floor((F.col(at) - F.lit(start)) / width)).groupBy("bucket").agg(F.count("*").alias("n"))


def peak_concurrency(rows: DataFrame, by: list[str], started: str, finished: str) -> DataFrame:
    """Most intervals open at once per group; at one instant ends come before starts.

    Steps of one instant are summed first; the running sum of a group is an ordered scan over many tasks.
    """
    edges = rows.select(*by, F.explode(F.array(F.struct(F.col(started).alias("t"), F.lit(1).alias("d")), F.struct(F.col(finished).alias("t"), F.lit(-1).alias("d")))).alias("e")).select(*by, "e.t", "e.d")
    steps = edges.groupBy(*by, "t", "d").agg(F.sum("d").alias("s"))
    return ordered.running(ordered.spread(steps, by, ["t", "d"]), by, F.col("s"), "sum", "open").groupBy(*by).agg(F.max("open").alias("peak"))


def query_cost(calls: DataFrame, cap: int = 64) -> DataFrame:
    """Calls, errors, rows, total and longest time per fingerprint; all beyond the first `cap` keys share OVERFLOW.

    calls: fingerprint, first_seq (a call's number), failed, rows, took. Keys count in the order they first appeared.
    """
    per = calls.groupBy("fingerprint").agg(F.min("first_seq").alias("first_seq"), F.count("*").alias("calls"), F.count_if("failed").alias("errors"), F.sum("rows").alias("rows"), F.sum("took").alias("total"), F.max("took").alias("longest"))
    first = per.orderBy("first_seq", "fingerprint").limit(cap).select("fingerprint", F.lit(True).alias("kept"))
    return (
        per.join(F.broadcast(first), "fingerprint", "left").withColumn("key", F.when(F.col("kept"), F.col("fingerprint")).otherwise("OVERFLOW")).groupBy("key")
        .agg(F.sum("calls").alias("calls"), F.sum("errors").alias("errors"), F.sum("rows").alias("rows"), F.sum("total").alias("total"), F.max("longest").alias("longest"))
    )


def freshness_debt(watches: DataFrame, now: int) -> DataFrame:
    """One row: managed watches, the scheduled ones, and by how many seconds these are past their interval in all and at most."""
    age = (F.lit(now) - F.col("fresh_at")) / 1_000_000
    late = F.when(F.col("watch_state") == "WARM", F.greatest(F.lit(0.0), age - F.col("interval_s")))
    return watches.agg(F.count("*").alias("watches"), F.count_if(F.col("watch_state") == "WARM").alias("scheduled"), F.coalesce(F.sum(late), F.lit(0.0)).alias("debt"), F.coalesce(F.max(late), F.lit(0.0)).alias("oldest"))
