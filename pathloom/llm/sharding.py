"""Sharding by proportional stratified interleaving."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

#: Rows that one bucket of a ranking holds, about, in small tables and at most; and how many buckets there are in between.
BUCKET_ROWS, MOST_ROWS, BUCKETS = 1_000, 100_000, 4_096


def bucket_count(rows: int) -> int:
    """Buckets of BUCKET_ROWS rows, up to BUCKETS; then that many, which grow to MOST_ROWS; then more of these."""
    return max(1, min(BUCKETS, -(-rows // BUCKET_ROWS)), -(-rows // MOST_ROWS))


def _rank(df: DataFrame, group: list[str], order: list, even: int) -> DataFrame:
    """Adds ``rank``, from 1 within ``group`` by ``bucket``, part and then ``order``, and ``n``, the group's rows.

    No task holds a group: parts are counted, the counts summed up in order, and rows ranked within a part. A bucket is one part,
    but if it has over four times the ``even`` number of rows, as by repeated rows or very many small sources, it is
    cut by the rows' numbers.
    """
    sizes = df.groupBy(*group, "bucket").agg(F.count("*").alias("__size"))
    # each has over 4 * even rows, so they are at most a quarter as many as there are buckets
    crowded = sizes.filter(F.col("__size") > 4 * even).select(*group, "bucket", F.ceil(F.col("__size") / even).alias("__parts"))
    spread = df.join(F.broadcast(crowded), [*group, "bucket"], "left")
    spread = spread.withColumn("__part", F.coalesce(F.pmod(F.xxhash64("row"), F.col("__parts")), F.lit(0))).drop("__parts")
    counts = spread.groupBy(*group, "bucket", "__part").agg(F.count("*").alias("__n"))
    before = F.sum("__n").over(Window.partitionBy(*group).orderBy("bucket", "__part").rowsBetween(Window.unboundedPreceding, -1))
    whole = F.sum("__n").over(Window.partitionBy(*group))
    starts = counts.select(*group, "bucket", "__part", F.coalesce(before, F.lit(0)).alias("__before"), whole.alias("n"))
    inner = spread.withColumn("__in", F.row_number().over(Window.partitionBy(*group, "bucket", "__part").orderBy(*order)))
    ranked = inner.join(starts, [*group, "bucket", "__part"]).withColumn("rank", F.col("__before") + F.col("__in"))
    return ranked.drop("__before", "__in", "bucket", "__part")


def interleave(
    docs: DataFrame,
    shards: int = 16,
    seed: int = 42,
    id_col: str = "doc_id",
    text_col: str = "text",
    strata: str = "source",
) -> DataFrame:
    """doc_id, source, size, text_crc32, shard, slot for every row of ``docs``.

    Rows of a source are ranked in the order of a seeded hash of their id, size and checksum; (rank - u) / (rows of the
    source) is the fractional rank, where u, from 0 to 1, is a hash of the source, so that sources of few rows
    spread too. Sorted by it over all sources, rows are cut into ``shards`` runs whose
    counts are at most one apart, so every shard has each source's share to within a row or so.
    slot counts from 0 in a shard. Ties: by source, hash, id, size and checksum; rows equal in all of these are
    interchangeable, and where very many are, their places in the table decide. A null source is a source of its
    own, a null id hashes as an empty one, and a null text has no bytes and checksum 0. An empty table gives an
    empty result. Other columns take no part, whatever they are called.
    """
    data = F.coalesce(F.encode(F.col(text_col), "UTF-8"), F.lit(b""))
    size, check = (F.octet_length(data) + 1).cast("long"), F.crc32(data)
    mixed = F.md5(F.encode(
        F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col(id_col).cast("string"), F.lit("")), size.cast("string"), check.cast("string")),
        "UTF-8",
    ))
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        F.coalesce(F.concat(F.lit("="), F.col(strata).cast("string")), F.lit("")).alias("source"),
        size.alias("size"),
        check.alias("text_crc32"),
        mixed.alias("mixed"),
        common.row_key().alias("row"),
    )
    rows = common.stage(rows, "rows")
    total = max(1, rows.count())
    buckets = bucket_count(total)
    even = -(-total // buckets)
    whole = ["mixed", F.col("doc_id").asc_nulls_first(), "size", "text_crc32"]
    # the hash is even, so equal ranges of its first 32 bits hold about as many rows of any source
    first = F.conv(F.substring("mixed", 1, 8), 16, 10).cast("long")
    ranked = _rank(rows.withColumn("bucket", F.floor(first * buckets / F.lit(1 << 32)).cast("long")), ["source"], whole, even)
    phase = F.conv(
        F.substring(F.md5(F.encode(F.concat(F.lit(f"{seed}:"), "source"), "UTF-8")), 1, 8),
        16,
        10,
    ).cast("long") / F.lit(float(1 << 32))
    fraction = (F.col("rank") - phase) / F.col("n")
    dealt = ranked.withColumn("fraction", fraction).withColumn(
        "bucket",
        F.least(F.floor(F.col("fraction") * buckets).cast("long"), F.lit(buckets - 1)),
    )
    placed = _rank(dealt.drop("rank", "n").withColumn("all", F.lit(0)), ["all"], ["fraction", "source", *whole], even)
    cut = placed.withColumn("shard", F.expr(f"cast(((rank - 1) * {shards}L) div {total}L as int)"))
    start = F.expr(f"(shard * {total}L + {shards - 1}L) div {shards}L")  # the first place of the shard
    return cut.select(
        "doc_id",
        F.when(F.col("source") != "", F.expr("substring(source, 2)")).alias("source"),
        "size",
        "text_crc32",
        "shard",
        (F.col("rank") - 1 - start).cast("long").alias("slot"),
    )
