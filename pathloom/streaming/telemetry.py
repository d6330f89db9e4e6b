"""Latency windows, the concurrency controller, progress, and directories kept up to date from a stream."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def percentiles(samples: DataFrame, ts: str = "ts", value: str = "value", seconds: int = 2) -> DataFrame:
    """p50 and p99 of each window: sorted samples from 0, the one at n / 2 and at n * 99 / 100, rounded down.

    Equal samples are counted before they are sorted, and no window's samples are held in memory.
    """
    start = F.floor(F.unix_seconds(F.col(ts).cast("timestamp")) / seconds) * seconds
    counts = samples.filter(F.col(value).isNotNull()).groupBy(
        start.cast("long").alias("window_start"),
        F.col(value).alias("v"),
    ).agg(F.count("*").alias("c"))
    whole = Window.partitionBy("window_start")
    up_to = F.sum("c").over(whole.orderBy("v").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    placed = counts.select("window_start", "v", F.sum("c").over(whole).alias("n"), up_to.alias("up_to"))
    at = lambda k: F.min(F.when(F.col("up_to") > k, F.col("v")))
    found = placed.groupBy("window_start").agg(
        F.first("n").alias("n"),
        at(F.floor(F.col("n") / 2)).alias("p50"),
        at(F.floor(F.col("n") * 99 / 100)).alias("p99"),
    )
    return found.select("window_start", "n", "p50", "p99")


def watch(stream: DataFrame, ts: str = "ts", value: str = "value", seconds: int = 2, late: str = "10 seconds") -> DataFrame:
    """The same windows of a stream of samples: each is given out once, when no sample of it may come any more.

    The state holds the samples of open windows, which are those of a few seconds.
    """
    samples = stream.filter(F.col(value).isNotNull()).withWatermark(ts, late)
    windows = samples.groupBy(F.window(ts, f"{seconds} seconds")).agg(F.array_sort(F.collect_list(value)).alias("s"))
    n = F.size("s")
    at = lambda k: F.element_at("s", k.cast("int") + 1)
    start = F.unix_seconds("window.start").alias("window_start")
    return windows.select(start, n.cast("long").alias("n"), at(F.floor(n / 2)).alias("p50"), at(F.floor(n * 99 / 100)).alias("p99"))


def next_limit(limit: int, p99: float | None, ceiling: float, most: int) -> int:
    """Half the limit where p99 is over the ceiling (1 at least), else a 16th of ``most`` (1 at least) more, up to it."""
    if p99 is not None and p99 > ceiling:
        return max(1, limit // 2)
    return min(most, limit + max(1, most // 16))


def controller(
    windows: DataFrame,
    ceiling: float,
    most: int,
    order: str = "window_start",
    p99: str = "p99",
    key: str | None = None,
) -> DataFrame:
    """The limit after each window of a scan, from ``most`` on, by ``next_limit``. ``key`` keeps several scans apart.

    A limit depends on the one before, so the windows of one scan, one for each two seconds, go through one task in order.
    """
    schema = T.StructType([f for f in windows.schema.fields if f.name != "limit"] + [T.StructField("limit", T.IntegerType())])
    place = [f.name for f in schema.fields[:-1]]

    def run(table):
        table = table.sort_by([(order, "ascending")])
        limit, out = most, []
        for x in table.column(p99).to_pylist():
            limit = next_limit(limit, x, ceiling, most)
            out.append(limit)
        return table.select(place).append_column("limit", pa.array(out, pa.int32()))

    return windows.groupBy(*([key] if key else [])).applyInArrow(run, schema)


def progress(done, expected, seconds):
    """(rate, percent, seconds left) as columns; null where they can't be told."""
    rate = F.when(seconds > 0, done / seconds)
    return rate, F.when(
        expected > 0,
        F.least(F.lit(100.0), 100.0 * done / expected),
    ), F.when((rate > 0) & (expected > done), (expected - done) / rate)


def merge_dirs(known: DataFrame, batch: DataFrame) -> DataFrame:
    """Directories after a further batch of sightings: the one with the largest seq wins."""
    both = known.select("ino", "parent", "name", "seq").unionByName(batch.select("ino", "parent", "name", "seq"))
    return both.groupBy("ino").agg(
        F.max_by(F.struct("parent", "name"), "seq").alias("last"),
        F.max("seq").alias("seq"),
    ).select("ino", "last.parent", "last.name", "seq")


def keep_dirs(stream: DataFrame, path: str, checkpoint: str):
    """Writes the newest sighting of each directory below ``path``, a version for each batch of a stream of entries.

    A version holds the batch before it, so a batch that runs again after a failure gives the same version.
    """

    def upsert(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        fresh = batch.filter("type = 'd'").select("ino", "parent", "name", "seq")
        known = spark.read.schema(fresh.schema).parquet(f"{path}/b={number - 1}") if number else fresh.limit(0)
        merge_dirs(known, fresh).write.mode("overwrite").parquet(f"{path}/b={number}")

    return stream.writeStream.foreachBatch(upsert).option("checkpointLocation", checkpoint)
