"""A cluster's JSON reports: volumes with their metadata pools and ranks, and where a pool's primaries are."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DUMP = "struct<filesystems:array<struct<mdsmap:struct<fs_name:string,metadata_pool:bigint,`in`:array<int>>>>>"
RULE = "struct<steps:array<struct<op:string,item_name:string>>>"


class ReportError(RuntimeError):
    """A report that doesn't name what is looked for."""


def filesystems(dumps: DataFrame, pools: DataFrame, text: str = "dump") -> DataFrame:
    """fs, metadata_pool (its name; null where ``pools`` (pool_id, pool) lacks it) and ranks of each volume, by name."""
    each = dumps.select(F.explode(F.from_json(text, DUMP)["filesystems"]).alias("f")).select(
        F.col("f.mdsmap.fs_name").alias("fs"),
        F.col("f.mdsmap.metadata_pool").alias("pool_id"),
        F.col("f.mdsmap.in").alias("ranks"),
    )
    return each.join(
        pools.select("pool_id", F.col("pool").alias("metadata_pool")),
        "pool_id",
        "left",
    ).select("fs", "metadata_pool", "ranks").orderBy("fs")


def lookup(volumes: DataFrame, name: str) -> dict:
    """The volume of a name with its pool; an unknown volume or pool is an error."""
    found = volumes.filter(F.col("fs") == name).head()
    if found is None:
        raise ReportError(f"no volume {name!r}")
    if found["metadata_pool"] is None:
        raise ReportError(f"the metadata pool of {name!r} isn't known")
    return found.asDict()


def primary_bucket(rule: Column) -> Column:
    """The bucket that a rule's first ``take`` step names, without its device class; null if no step takes one."""
    takes = F.filter(F.from_json(rule, RULE)["steps"], lambda s: s["op"] == "take")
    return F.substring_index(F.get(takes, F.lit(0))["item_name"], "~", 1)


def datacenter(location: Column) -> Column:
    """The datacenter of a location such as ``host=a datacenter=b``; parts stand apart by spaces, commas or semicolons. Empty if there is none."""
    named = F.filter(F.split(location, "[ ,;]+"), lambda x: x.startswith("datacenter="))
    return F.coalesce(F.substring(F.get(named, F.lit(0)), len("datacenter=") + 1, 1 << 20), F.lit(""))


def reads_cross(primary: Column, location: Column) -> Column:
    """Whether all reads of a pool leave the client's datacenter; false where either isn't known."""
    here = datacenter(location)
    return F.coalesce((here != "") & (primary != "") & (here != primary), F.lit(False))
