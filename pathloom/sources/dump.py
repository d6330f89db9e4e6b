"""The driver's tables as the dump of a metadata pool: the file system of ``vfs``, written as binary directory entries."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import codec, encoder
from ..schema import ROOT, S_IFDIR, S_IFLNK, S_IFREG
from . import vfs

#: A directory whose number this divides is split into two fragments, dealt by the length of the name.
SPLIT = 7
TREE = {0: 1}
_MODES = {"d": S_IFDIR | 0o755, "f": S_IFREG | 0o644, "l": S_IFLNK | 0o777, "o": 0o010644}
_FIELDS = ("ino", "uid", "gid", "size", "mtime", "ctime", "rctime", "rfiles", "rsubdirs")


def _value(kind: str, split: bool, numbers: tuple) -> bytes:
    fields = dict(zip(_FIELDS, numbers, strict=True))
    if kind == "h":
        return encoder.remote(fields["ino"])
    if kind == "?":
        return b"abc"
    return encoder.primary(mode=_MODES[kind], symlink="../there" if kind == "l" else "", tree=TREE if split else None, **fields)


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the dump's records say: parent, name, snap, type and the inode's fields; ``split`` for a directory in two fragments.

    Beside the entries of ``vfs`` there are, for each supplier, a directory in the root without an object, said to hold files if the
    supplier's number is even, and for each nation an entry in the root of an old snapshot and one that can't be decoded.
    """
    entries = vfs.entries(spark, sf_dir).drop("volume")
    inside = entries.groupBy(F.col("parent").alias("ino")).agg(
        F.count_if(F.col("type") != "d").alias("files"),
        F.count_if(F.col("type") == "d").alias("dirs"),
    )
    folder = F.col("type") == "d"
    held = entries.join(inside.withColumn("type", F.lit("d")), ["ino", "type"], "left").select(
        "parent", "name", F.lit("head").alias("snap"), "type", "ino", "uid", "gid", "size", "mtime", "ctime", "rctime",
        F.when(folder, F.coalesce("files", F.lit(0))).otherwise(0).cast("long").alias("rfiles"),
        F.when(folder, F.coalesce("dirs", F.lit(0)) + 1).otherwise(0).cast("long").alias("rsubdirs"),
    )
    zero = [F.lit(0).cast("long").alias(n) for n in ("uid", "gid", "size", "mtime", "ctime", "rctime")]
    top, number = F.lit(ROOT).cast("long").alias("parent"), lambda c, base: (F.col(c).cast("long") + base).alias("ino")
    stale = spark.read.parquet(f"{sf_dir}/supplier.parquet").select(
        top, F.concat(
            F.lit("supplier-"),
            F.col("s_suppkey").cast("string"),
        ).alias("name"), F.lit("head").alias("snap"), F.lit("d").alias("type"),
        number("s_suppkey", 2 * 10**12), *zero, F.when(
            F.col("s_suppkey") % 2 == 0,
            5,
        ).otherwise(0).cast("long").alias("rfiles"), F.lit(1).cast("long").alias("rsubdirs"),
    )
    nation = spark.read.parquet(f"{sf_dir}/nation.parquet")
    odd = [
        nation.select(
            top, F.concat(
                F.lit(f"{name}_"),
                F.col("n_nationkey").cast("string"),
            ).alias("name"), F.lit(snap).alias("snap"), F.lit(kind).alias("type"),
            number("n_nationkey", 3 * 10**12), *zero, F.lit(0).cast("long").alias("rfiles"), F.lit(0).cast("long").alias("rsubdirs"),
        )
        for name, snap, kind in (("old", "1f", "f"), ("bad", "head", "?"))
    ]
    every = held.unionByName(stale).unionByName(odd[0]).unionByName(odd[1])
    return every.withColumn("split", (F.col("type") == "d") & (F.col("ino") % SPLIT == 0))


def omap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(oid, key, value): the records as a pool's dump holds them."""
    rows = records(spark, sf_dir)
    half = F.length("name") % 2
    frag = F.when((F.col("parent") != ROOT) & (F.col("parent") % SPLIT == 0), F.lit(1 << 24) + half * (1 << 23)).otherwise(0)
    keyed = rows.select(
        codec.object_name(F.col("parent"), frag).alias("oid"),
        F.concat_ws("_", "name", "snap").alias("key"),
        "type",
        "split",
        *_FIELDS,
    )

    def run(batches):
        for batch in batches:
            c = [x.to_pylist() for x in batch.columns]
            values = [_value(kind, split, numbers) for kind, split, *numbers in zip(*c[2:], strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(values, pa.binary())],
                names=["oid", "key", "value"],
            )

    return keyed.mapInArrow(run, "oid string, key string, value binary")


#: The records in DuckDB's SQL, from the tables of vfs.SQL: ``records``.
SQL = f"""
    inside AS (SELECT parent AS ino, count(*) FILTER (type <> 'd') AS files, count(*) FILTER (type = 'd') AS dirs FROM entries GROUP BY parent),
    records AS (
        SELECT e.parent, e.name, 'head' AS snap, e.type, e.ino, e.uid, e.gid, e.size, e.mtime, e.ctime, e.rctime,
               CASE WHEN e.type = 'd' THEN coalesce(files, 0) ELSE 0 END AS rfiles, CASE WHEN e.type = 'd' THEN coalesce(dirs,
                   0) + 1 ELSE 0 END AS rsubdirs
        FROM entries e LEFT JOIN inside i ON e.type = 'd' AND i.ino = e.ino
        UNION ALL SELECT 1, 'supplier-' || s_suppkey, 'head', 'd', 2000000000000 + s_suppkey, 0, 0, 0,
            0, 0, 0, CASE WHEN s_suppkey % 2 = 0 THEN 5 ELSE 0 END, 1 FROM supplier
        UNION ALL SELECT 1, 'old_' || n_nationkey, '1f', 'f', 3000000000000 + n_nationkey, 0, 0, 0, 0, 0, 0, 0, 0 FROM nation
        UNION ALL SELECT 1, 'bad_' || n_nationkey, 'head', '?', 3000000000000 + n_nationkey, 0, 0, 0, 0, 0, 0, 0, 0 FROM nation)"""
