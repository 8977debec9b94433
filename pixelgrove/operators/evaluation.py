"""Latency, throughput and cache statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def quantiles(rows: DataFrame, value: str, points: tuple[float, ...], *by: str) -> DataFrame:
    """Per group: p50 and so on, by linear interpolation. Equal values are counted before anything meets in a group."""
    keys = list(by) or [F.lit(1)]
    counts = rows.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("__c"))
    so_far = F.sum("__c").over(Window.partitionBy(*keys).orderBy(value))
    counts = counts.withColumns({"__to": so_far, "__n": F.sum("__c").over(Window.partitionBy(*keys))})
    at = lambda place: F.max(F.when((F.col("__to") - F.col("__c") <= place) & (place < F.col("__to")), F.col(value)))
    places = {p: (F.col("__n") - 1) * p for p in points}
    parts = counts.groupBy(*by).agg(F.max("__n").alias("__n"), *[x for p, place in places.items() for x in (at(F.floor(place)).alias(f"__low{p}"), at(F.ceil(place)).alias(f"__high{p}"))])
    share = lambda p: places[p] - F.floor(places[p])
    return parts.select(*by, *[(F.col(f"`__low{p}`") + (F.col(f"`__high{p}`") - F.col(f"`__low{p}`")) * share(p)).alias(f"p{int(p * 100)}") for p in points])


def latency(requests: DataFrame, value: str, *by: str, duration: Column | None = None, success: Column | None = None) -> DataFrame:
    """Per group: n, mean, min, max, p50, p95, p99 (linear interpolation), and with a duration the throughput of successes."""
    ok = F.count(F.lit(1)) if success is None else F.count_if(success)
    extra = [] if duration is None else [(ok / duration).alias("throughput_rps")]
    plain = requests.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"), F.min(value).alias("min"), F.max(value).alias("max"), *extra)
    points = quantiles(requests, value, (0.5, 0.95, 0.99), *by)
    points = points.select(*[F.col(c).alias(f"__{c}") for c in by], "p50", "p95", "p99")
    same = F.lit(True)
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"__{c}"))
    out = plain.join(points, same, "left").drop(*[f"__{c}" for c in by])
    return out.select(*by, "n", "mean", "min", "max", "p50", "p95", "p99", *(["throughput_rps"] if extra else []))


def speedup(tracks: DataFrame, baseline: str, track: str = "track", rps: str = "throughput_rps") -> DataFrame:
    """Adds speedup against a track, or the slowest where it is missing; a baseline without throughput counts as 1."""
    whole = Window.partitionBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    base = F.coalesce(F.max(F.when(F.col(track) == baseline, F.col(rps))).over(whole), F.min(rps).over(whole))
    return tracks.withColumn("speedup", F.col(rps) / F.when(base > 0, base).otherwise(F.lit(1.0)))


def ranked(tracks: DataFrame, track: str = "track", rps: str = "throughput_rps") -> DataFrame:
    """Adds success_rate_pct and rank by throughput; (total_requests, success_requests) are columns."""
    rate = F.round(F.col("success_requests") / F.greatest("total_requests", F.lit(1)) * 100, 2)
    return tracks.withColumn("success_rate_pct", rate).withColumn("rank", F.row_number().over(Window.orderBy(F.desc(rps), track)).cast("long"))


def best_level(runs: DataFrame, level: str = "clients", rps: str = "throughput_rps", drop: float = 0.95, *by: str) -> DataFrame:
    """The level of the best throughput among those up to the first that falls below ``drop`` of the best so far."""
    keys = list(by) or [F.lit(1)]
    order = Window.partitionBy(*keys).orderBy(level)
    so_far = F.max(rps).over(order.rowsBetween(Window.unboundedPreceding, 0))
    rows = runs.withColumn("__low", (F.col(rps) < so_far * drop).cast("int"))
    rows = rows.withColumn("__before", F.coalesce(F.sum("__low").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    best = rows.where("__before = 0").groupBy(*by).agg(F.max(F.struct(F.col(rps), (-F.col(level)).alias("l"))).alias("m"))
    return best.select(*by, (-F.col("m.l")).alias(level), F.col(f"m.{rps}").alias(rps))


def spread(runs: DataFrame, value: str, *by: str) -> DataFrame:
    """Per group: n, mean, population deviation, min, max."""
    return runs.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"), F.min(value).alias("min"), F.max(value).alias("max"))


def cache_stats(requests: DataFrame, hit: Column, *by: str) -> DataFrame:
    return requests.groupBy(*by).agg(F.count_if(hit).alias("hits"), F.count_if(~hit).alias("misses"), (F.count_if(hit) / F.count(F.lit(1))).alias("hit_rate"))


def embedding_summary(rows: DataFrame, vec_col: str, *by: str) -> DataFrame:
    from pixelgrove.functions.vectors import norm, valid_norm

    v = F.col(vec_col)
    return rows.groupBy(*by).agg(F.avg(norm(v)).alias("avg_norm"), F.count_if(valid_norm(v)).alias("valid"), F.count(F.lit(1)).alias("total"), F.avg(valid_norm(v).cast("int")).alias("validity_rate"))


def ratio_alerts(metrics: DataFrame, bad: str, total: str, above: float) -> DataFrame:
    """Rows whose share of bad events is above a limit."""
    return metrics.withColumn("ratio", F.col(bad) / F.nullif(F.col(total), F.lit(0))).where(F.col("ratio") > above)


def latency_alerts(requests: DataFrame, value: str, above: float, length: str, quantile: float = 0.95, time: str = "ts", by: str = "track") -> DataFrame:
    """Windows (start, group) whose quantile of a latency is above a limit."""
    rows = requests.select(F.window(time, length).alias("w"), by, value).select(F.col("w.start").alias("start"), by, value)
    name = f"p{int(quantile * 100)}"
    return quantiles(rows, value, (quantile,), "start", by).where(F.col(name) > above)
