"""The walk from a start directory over all that can be reached, with its counters."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import storage
from ..functions import codec
from ..operators import tree
from ..schema import ROOT
from ..sources import store as stores
from ..streaming import telemetry


@dataclass
class Walk:
    entries: DataFrame
    counters: DataFrame
    complete: bool
    #: a row for each page read from a store: oid, pages, missing, problem, seconds
    reads: DataFrame | None = None


#: What an object leads to: the fragments of the directories in it.
CHILDREN = "dir long, oid string, nonempty boolean"
#: After so many levels the objects seen are written as one table.
MERGE = 16


def walk(
    omap: DataFrame,
    roots: list[int],
    start: int = ROOT,
    max_levels: int | None = None,
    seconds: float | None = None,
    page: int = stores.PAGE,
) -> Walk:
    """Follows directories from the fragments ``roots`` of ``start``.

    ``omap`` is (oid, key, value); an object without rows but there is a row with a null key. Values are decoded
    once. The levels are found on a narrow table, object to objects, and the decoded rows are joined once, at the end. An object
    is read once, however often its directory is seen, so a cycle ends. seq follows level, object and
    key, so a directory comes before what it holds. With ``max_levels`` or ``seconds``, which is looked
    at between levels, the walk may end early, and isn't complete then.
    """
    rows = storage.stage(codec.decoded(omap.filter("key is not null")), "decoded")
    links = storage.stage(_children(rows, "oid"), "links").withColumnRenamed("oid", "child").withColumnRenamed("in_oid", "oid")
    there = omap.groupBy("oid").agg(F.count("key").alias("keys"))

    def leads_to(visit: DataFrame) -> DataFrame:
        return links.join(visit.select("oid"), "oid").select("dir", F.col("child").alias("oid"), "nonempty")

    visited, complete = _follow(omap.sparkSession, leads_to, roots, start, max_levels, seconds)
    found = visited.join(there, "oid", "left")
    pages = F.greatest(F.lit(1), F.ceil(F.col("keys") / page))
    reads = found.agg(
        F.count("keys").alias("objects"),
        F.coalesce(F.sum(F.when(F.col("keys").isNotNull(), pages)), F.lit(0)).alias("pages"),
        F.count_if(F.col("keys").isNull() & ~F.col("nonempty")).alias("enoent"),
        F.count_if(F.col("keys").isNull() & F.col("nonempty")).alias("missed_dirs"),
        F.lit(0).cast("long").alias("op_errors"),
    )
    seen = rows.join(visited.select("oid", "dir", "level"), "oid")
    return _walk(seen, reads, complete, start)


def _children(rows: DataFrame, oid: str) -> DataFrame:
    """(in_oid, dir, oid, nonempty) for each fragment of the directories in decoded rows."""
    more = F.col("rfiles") + F.col("rsubdirs") > 1  # a directory counts itself
    found = rows.filter("type = 'd' and head and error is null")
    each = found.select(F.col(oid).alias("in_oid"), F.col("ino").alias("dir"), F.explode("frags").alias("frag"), more.alias("nonempty"))
    return each.select("in_oid", "dir", codec.object_name(F.col("dir"), F.col("frag")).alias("oid"), "nonempty")


def root_fragments(store: stores.Store, start: int = ROOT) -> list[int]:
    """The fragments to start from: those that the root's own object tells, or the whole directory elsewhere."""
    return codec.leaves(codec.decode_root(store.read_all("1.00000000.inode"))["fragtree"]) if start == ROOT else [0]


def walk_store(
    spark: SparkSession,
    store: stores.Store,
    start: int = ROOT,
    tasks: int = 32,
    page: int = stores.PAGE,
    max_ops: float = 0,
    max_levels: int | None = None,
    seconds: float | None = None,
    note: Callable[[int, int], None] | None = None,
    ceiling: float | None = None,
) -> Walk:
    """The same walk over a store that is read as it goes, level by level; only what can be reached is read.

    ``reads`` has a row for each page, with the limit of reads under way. That limit is ``tasks`` at first; with a ``ceiling``, in
    seconds, it is halved after a level whose p99 was over it, and else raised again. ``note`` is called after
    each level with its number and the entries so far.
    """
    levels: list[DataFrame] = []
    total, limit = 0, tasks

    def leads_to(visit: DataFrame) -> DataFrame:
        nonlocal total, limit
        read = storage.stage(stores.read_objects(visit, store, limit, page, max_ops), "read").withColumn("limit", F.lit(limit))
        if ceiling is not None:
            took = read.filter("pages > 0").select(F.timestamp_seconds(F.lit(0)).alias("ts"), F.col("seconds").alias("value"))
            one = telemetry.percentiles(took).first()  # one window
            limit = telemetry.next_limit(limit, one["p99"] if one else None, ceiling, tasks)
        level = storage.stage(codec.decoded(read.filter("key is not null")), "level")
        levels.append(level.join(visit.select("oid", "dir", "level"), "oid"))
        reads.append(read.filter("key is null").select("oid", "nonempty", "pages", "missing", "problem", "seconds", "limit"))
        if note is not None:
            total += level.count()
            note(len(levels) - 1, total)
        return _children(level, "oid").select("dir", "oid", "nonempty")

    reads: list[DataFrame] = []
    _, complete = _follow(spark, leads_to, root_fragments(store, start), start, max_levels, seconds)
    pages = reduce(DataFrame.unionByName, reads)
    failed = F.bool_or(F.col("missing") | F.col("problem").isNotNull())
    by_object = pages.groupBy("oid").agg(failed.alias("failed"))
    counted = pages.agg(
        F.sum("pages").alias("pages"),
        F.count_if(F.col("missing") & ~F.col("nonempty")).alias("enoent"),
        F.count_if(F.col("missing") & F.col("nonempty")).alias("missed_dirs"),
        F.count("problem").alias("op_errors"),
    )
    counted = counted.crossJoin(by_object.agg(F.count_if(~F.col("failed")).alias("objects")))  # a row each
    return _walk(reduce(DataFrame.unionByName, levels), counted, complete, start, pages)


def _follow(
    spark: SparkSession,
    leads_to: Callable[[DataFrame], DataFrame],
    roots: list[int],
    start: int,
    max_levels: int | None,
    seconds: float | None,
) -> tuple[DataFrame, bool]:
    """(oid, dir, nonempty, level) of every object that is visited, once each, and whether no other is left.

    ``leads_to`` gives the objects that those of a level lead to. There is no bound on levels: each must bring an
    object that wasn't seen before.
    """
    until = None if seconds is None else time.monotonic() + seconds
    first = [(start, f"{start:x}.{f:08x}", True) for f in roots]
    visit = storage.stage(spark.createDataFrame(first, CHILDREN).withColumn("level", F.lit(0)), "visit")
    old: DataFrame | None = None
    recent, depth = [visit], 0
    while not visit.isEmpty():
        if depth == max_levels or until is not None and depth and time.monotonic() >= until:
            seen = [x for x in recent if x is not visit]
            return reduce(DataFrame.unionByName, seen if old is None else [old, *seen]), False
        depth += 1
        found = leads_to(visit).groupBy("oid").agg(F.min("dir").alias("dir"), F.bool_or("nonempty").alias("nonempty"))
        for seen in recent if old is None else [old, *recent]:
            found = found.join(seen.select("oid"), "oid", "left_anti")
        visit = storage.stage(found.select("dir", "oid", "nonempty", F.lit(depth).alias("level")), "visit")
        recent.append(visit)
        if len(recent) > MERGE:
            old = storage.stage(reduce(DataFrame.unionByName, recent[:-1] if old is None else [old, *recent[:-1]]), "visited")
            recent = [visit]
    return reduce(DataFrame.unionByName, recent if old is None else [old, *recent]), True


def _walk(seen: DataFrame, reads: DataFrame, complete: bool, start: int, pages: DataFrame | None = None) -> Walk:
    """Entries and counters from the decoded rows of the visited objects, with dir and level."""
    wanted = [
        "oid",
        "key",
        "level",
        "dir",
        "name",
        "head",
        "error",
        "type",
        "ino",
        "uid",
        "gid",
        "size",
        "mtime",
        "ctime",
        "rctime",
        "rfiles",
        "rsubdirs",
        "frags",
    ]
    seen = tree.numbered(seen.select(*wanted), ["level", "oid", "key"], "seq")
    live = F.col("error").isNull() & F.col("head")
    entries = seen.filter(live).select(
        "seq",
        F.col("dir").alias("parent"),
        "name",
        "ino",
        "type",
        "uid",
        "gid",
        "size",
        "mtime",
        "ctime",
        "rctime",
    )
    inside = F.when(F.col("type") == "d", F.col("rfiles") + F.col("rsubdirs")).otherwise(1)
    expected = F.sum(F.when(live & (F.col("dir") == start), inside))
    counted = seen.agg(
        F.count_if(live).alias("entries"),
        F.count_if(live & (F.col("type") == "d")).alias("dirs"),
        F.count_if(live & (F.col("type") == "d") & (F.size("frags") > 1)).alias("fragmented"),
        F.count_if(F.col("error").isNotNull()).alias("decode_errors"),
        F.count_if(F.col("error").isNull() & ~F.col("head")).alias("snap_skipped"),
        F.coalesce(expected, F.lit(0)).alias("expected"),
    )
    return Walk(entries, counted.crossJoin(reads), complete, pages)  # a row each
