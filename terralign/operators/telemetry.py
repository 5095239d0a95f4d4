"""Stages, samples, events and transfer tables of runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import frames as fr
from . import ordered


def stage_durations(log: DataFrame, by: list[str], at: str = "ts", stage: str = "stage") -> DataFrame:
    """Seconds of each stage: a stage ends when the next entry begins; re-entering overwrites; the last entry isn't timed.
    Logs may be of any length."""
    seconds = lambda c: c.cast("timestamp").cast("double")
    timed = ordered.beside(log, by, [at, "seq"], [], lambda w: {"seconds": seconds(F.lead(at).over(w)) - seconds(F.col(at))}).filter("seconds IS NOT NULL")
    return timed.groupBy(*by, stage).agg(F.max_by("seconds", F.struct(at, "seq")).alias("seconds"))


def stage_shares(durations: DataFrame, by: list[str]) -> DataFrame:
    every = Window.partitionBy(*by)
    return durations.withColumn("share", F.col("seconds") / F.greatest(F.sum("seconds").over(every), F.lit(0.001)) * 100.0)


def label_events(tiles: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """first_tile for the first tile of a run, tile_written for the others."""
    w = Window.partitionBy(*by).orderBy(*order)
    return tiles.withColumn("event", F.when(F.row_number().over(w) == 1, "first_tile").otherwise("tile_written"))


def time_to_first(log: DataFrame, by: list[str], event: Column, at: str = "ts") -> DataFrame:
    """(by, seconds): from a run's first entry to its first entry for which `event` holds; null where there is none."""
    moment = F.col(at).cast("timestamp").cast("double")
    return log.groupBy(*by).agg((F.min(F.when(event, moment)) - F.min(moment)).alias("seconds"))


def usage(samples: DataFrame, by: list[str]) -> DataFrame:
    """Peak memory and mean load per run, 0 where nothing was sampled."""
    return samples.groupBy(*by).agg(F.coalesce(F.max("rss_ram_mb"), F.lit(0.0)).alias("peak_ram_mb"), F.coalesce(F.avg("cpu_percent"), F.lit(0.0)).alias("avg_cpu_percent"))


def windows(samples: DataFrame, width: str, at: str, value: str) -> DataFrame:
    """Tumbling windows of a series: its mean, peak and number."""
    cut = F.window(F.col(at), width)
    return samples.groupBy(cut.alias("w")).agg(F.avg(value).alias("mean"), F.max(value).alias("peak"), F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), "mean", "peak", "n")


def settled_sessions(arrivals: DataFrame, by: list[str], gap_seconds: int, at: str = "ts") -> DataFrame:
    """Runs of arrivals in which no pause is longer than the gap: when each began and last grew, and how many came.
    Arrivals of one moment are counted together; series may be of any length."""
    moments = ordered.dealt(arrivals.groupBy(*by, at).agg(F.count(F.lit(1)).alias("files")), by, [at])
    seconds = lambda c: c.cast("timestamp").cast("double")
    fresh = lambda w: F.when(F.coalesce(seconds(F.col(at)) - seconds(F.lag(at).over(w)) < gap_seconds, F.lit(False)), 0).otherwise(1)
    marked = ordered.beside(moments, by, [at], [], lambda w: {"__fresh": fresh(w)})
    marked = ordered.running(marked, by, [at], F.col("__fresh"), "session")
    return marked.groupBy(*by, "session").agg(F.min(at).alias("began"), F.max(at).alias("last"), F.sum("files").alias("files"))


def bandwidth_table(sizes: DataFrame, raw: str, out: str, speeds: tuple[float, ...] = (1.0, 5.0, 20.0)) -> DataFrame:
    """For each row and speed: seconds to send the raw bytes and the product, seconds saved and their share."""
    rows = sizes.withColumn("mbps", F.explode(F.array(*map(F.lit, speeds))))
    a, b = fr.transfer_seconds(F.col(raw), F.col("mbps")), fr.transfer_seconds(F.col(out), F.col("mbps"))
    saved = F.greatest(F.lit(0.0), a - b)
    return rows.select(*sizes.columns, "mbps", a.alias("raw_seconds"), b.alias("product_seconds"), saved.alias("saved_seconds"), F.when(a > 0, saved / a * 100.0).otherwise(0.0).alias("saved_percent"))


def reduction(raw: F.Column, cog: F.Column, tif: F.Column) -> F.Column:
    """Input bytes over those of the product, the optimised one if there is one; 0 without either."""
    size = F.coalesce(F.nullif(cog, F.lit(0)), tif)
    return F.when(F.coalesce(size, F.lit(0)) > 0, raw / size).otherwise(0.0)
