"""Counts, directories and paths."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import storage
from ..schema import MAX_DEPTH, ROOT

#: Levels that are resolved in one job before it is looked whether any are left.
LEVELS = 6


def type_counts(entries: DataFrame) -> DataFrame:
    """One row: entries, files, dirs, symlinks, hardlinks, special (all other types)."""
    is_ = lambda t: F.count_if(F.col("type") == t)
    return entries.agg(
        F.count("*").alias("entries"),
        is_("f").alias("files"),
        is_("d").alias("dirs"),
        is_("l").alias("symlinks"),
        is_("h").alias("hardlinks"),
        F.count_if(~F.col("type").isin("f", "d", "l", "h")).alias("special"),
    )


def numbered(rows: DataFrame, order: list[str], name: str) -> DataFrame:
    """Adds ``name``, the place of each row from 0 in an order, found in ranges: no task holds all rows."""
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    stored = storage.stage(ranged.withColumn("__id", F.monotonically_increasing_id()), "ranged")
    part = F.shiftright("__id", 33).cast("int").alias("__part")
    sizes = stored.groupBy(part).count().orderBy("__part").collect()  # a row for each partition
    at, starts = 0, []
    for r in sizes:
        starts.append((r["__part"], at))
        at += r["count"]
    begin = F.broadcast(rows.sparkSession.createDataFrame(starts, "__part int, __begin long"))
    place = F.col("__begin") + F.col("__id").bitwiseAND((1 << 33) - 1)
    return stored.withColumn("__part", part).join(begin, "__part").withColumn(name, place).drop("__part", "__id", "__begin")


def last_sightings(entries: DataFrame) -> DataFrame:
    """One row for each directory: where it was seen last, by emit order. Partial maxima are formed before the shuffle."""
    return entries.filter("type = 'd'").groupBy("ino").agg(
        F.max_by(F.struct("parent", "name"), "seq").alias("last"),
        F.max("seq").alias("seq"),
    ).select("ino", "last.parent", "last.name", "seq")


def duplicate_dirs(entries: DataFrame) -> DataFrame:
    """One row: dirs (sightings), distinct_dirs and dup_dirs, their difference."""
    n = entries.filter("type = 'd'").agg(F.count("*").alias("dirs"), F.countDistinct("ino").alias("distinct_dirs"))
    return n.withColumn("dup_dirs", F.col("dirs") - F.col("distinct_dirs"))


def orphan_mark(ino) -> F.Column:
    """The placeholder for a directory that isn't known, with the unsigned number in hex."""
    return F.concat(F.lit("<ino 0x"), F.lower(F.hex(ino)), F.lit(">"))


def resolve(inos: DataFrame, dirs: DataFrame, prefix: str, levels: int = LEVELS) -> DataFrame:
    """(ino, path) for the distinct directories ``ino`` of a column, their own names included; the root's path is the prefix.

    All open directories go up a level with one equi-join on keys; a few levels make a job. Whatever meets a
    directory that isn't known, or is deeper than MAX_DEPTH, gets the placeholder and no prefix. Work grows with
    the directories asked for and the depth, not with the index.
    """
    prefix = prefix.rstrip("/")
    step = dirs.select(F.col("ino").alias("__ino"), F.col("parent").alias("__parent"), F.col("name").alias("__name"))
    now = inos.select("ino").distinct().select(
        "ino",
        F.col("ino").alias("cur"),
        F.lit("").alias("path"),
        F.lit(0).alias("depth"),
        (F.col("ino") == ROOT).alias("done"),
    )
    while True:
        for _ in range(levels):
            known = F.col("__ino").isNotNull()
            go = ~F.col("done") & known & (F.col("depth") < MAX_DEPTH)
            now = now.join(step, (F.col("cur") == F.col("__ino")) & ~F.col("done"), "left").select(
                "ino",
                F.when(go, F.col("__parent")).otherwise(F.col("cur")).alias("cur"),
                F.when(go, F.concat(F.lit("/"), "__name", "path")).otherwise(F.col("path")).alias("path"),
                F.when(go, F.col("depth") + 1).otherwise(F.col("depth")).alias("depth"),
                (F.col("done") | ~go | (F.col("__parent") == ROOT)).alias("done"),
            )
        now = storage.stage(now, "paths")
        if now.filter("not done").isEmpty():
            break
    return now.select(
        "ino",
        F.when(F.col("cur") == ROOT, F.concat(F.lit(prefix), "path")).otherwise(F.concat(orphan_mark("cur"), "path")).alias("path"),
    )


def all_paths(dirs: DataFrame, prefix: str) -> DataFrame:
    """(ino, path) of every directory by pointer doubling: a round doubles the way that each has gone up."""
    prefix = prefix.rstrip("/")
    now = storage.stage(
        dirs.select("ino", F.col("parent").alias("cur"), F.concat(F.lit("/"), "name").alias("path"), F.lit(1).alias("depth")),
        "doubling",
    )
    for _ in range(MAX_DEPTH.bit_length() - 1):
        up = now.select(
            F.col("ino").alias("__ino"),
            F.col("cur").alias("__cur"),
            F.col("path").alias("__path"),
            F.col("depth").alias("__depth"),
        )
        go = F.col("__ino").isNotNull() & (F.col("depth") + F.col("__depth") <= MAX_DEPTH)
        joined = now.join(up, (F.col("cur") == F.col("__ino")) & (F.col("cur") != ROOT), "left")
        now = storage.stage(
            joined.select(
                "ino",
                F.when(go, F.col("__cur")).otherwise(F.col("cur")).alias("cur"),
                F.when(go, F.concat("__path", "path")).otherwise(F.col("path")).alias("path"),
                F.when(go, F.col("depth") + F.col("__depth")).otherwise(F.col("depth")).alias("depth"),
                go.alias("moved"),
            ),
            "doubling",
        )
        if now.filter("moved").isEmpty():
            break
        now = now.drop("moved")
    # a way that is too long for a whole step goes on by single levels, so that the cut stays exact
    deep = now.filter(F.col("cur") != ROOT).join(dirs.select(F.col("ino").alias("cur")), "cur", "left_semi")
    short = now.filter(F.col("cur") == ROOT).select("ino", F.concat(F.lit(prefix), "path").alias("path"))
    orphans = now.filter(F.col("cur") != ROOT).join(
        dirs.select(F.col("ino").alias("cur")),
        "cur",
        "left_anti",
    ).select("ino", F.concat(orphan_mark("cur"), "path").alias("path"))
    out = short.unionByName(orphans)
    return out if deep.isEmpty() else out.unionByName(resolve(deep, dirs, prefix, 64))


def with_paths(hits: DataFrame, dirs: DataFrame, prefix: str) -> DataFrame:
    """Adds the full path of every row of ``hits`` (parent, name). Only the hits' parents are resolved."""
    parents = resolve(
        hits.select(F.col("parent").alias("ino")),
        dirs,
        prefix,
    ).withColumnRenamed("ino", "parent").withColumnRenamed("path", "__dir")
    return hits.join(parents, "parent").withColumn("path", F.concat("__dir", F.lit("/"), "name")).drop("__dir")
