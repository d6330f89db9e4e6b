"""The driver's tables seen as a file system: regions, nations, customers and orders are directories, line items are leaves."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PREFIX = "/vol1"


def _epoch(c: str) -> Column:
    return F.unix_seconds(F.col(c).cast("timestamp"))


def _rows(
    df: DataFrame,
    volume: Column,
    seq: Column,
    parent: Column,
    name: Column,
    ino: Column,
    kind: Column,
    uid: Column,
    size: Column,
    mtime: Column,
) -> DataFrame:
    long = lambda c: c.cast("long")
    return df.select(
        long(seq).alias("seq"), long(parent).alias("parent"), name.alias("name"), long(ino).alias("ino"), kind.alias("type"), long(uid).alias("uid"), long(uid).alias("gid"), long(size).alias("size"),
        long(mtime).alias("mtime"), long(mtime + 1).alias("ctime"), long(F.when(
            kind == "d",
            mtime,
        ).otherwise(F.lit(0))).alias("rctime"), volume.alias("volume"),
    )


def entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries with a ``volume`` column, the lower-cased region."""
    t = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    c, lit = F.col, F.lit
    d = lit("d")
    region = t("region").select("r_regionkey", F.lower("r_name").alias("volume"), "r_name")
    nation = t("nation").join(F.broadcast(region.drop("r_name")), c("n_regionkey") == c("r_regionkey"))  # 25 and 5 rows by the format
    homes = F.broadcast(nation.select("n_nationkey", "volume"))
    customer = t("customer").join(homes, c("c_nationkey") == c("n_nationkey"))
    where = customer.select("c_custkey", "volume")
    orders = t("orders").join(where, c("o_custkey") == c("c_custkey"))
    leaves = t("lineitem").join(t("part").select("p_partkey", "p_name"), c("l_partkey") == c("p_partkey")).join(
        orders.select("o_orderkey", "o_custkey", "volume"),
        c("l_orderkey") == c("o_orderkey"),
    )
    kind = F.when(
        (c("l_returnflag") == "A") | ((c("l_returnflag") == "N") & (c("l_linestatus") == "F")),
        "f",
    ).when(c("l_returnflag") == "N", "l").when((c("l_returnflag") == "R") & (c("l_linestatus") == "F"), "h").otherwise("o")
    own = lambda x: F.when(kind == "h", lit(0)).otherwise(x)
    number = lit(10**12) + c("l_orderkey") * 8 + c("l_linenumber")
    name = F.concat(F.translate("p_name", " ", "_"), lit("-"), c("l_linenumber").cast("string"), lit("."), F.lower("l_linestatus"))
    zero, volume = lit(0), c("volume")
    parts = [
        _rows(region, volume, c("r_regionkey") + 1, lit(1), c("r_name"), c("r_regionkey") + 100, d, zero, zero, zero),
        _rows(nation, volume, c("n_nationkey") + 100, c("n_regionkey") + 100, c("n_name"), c("n_nationkey") + 1000, d, zero, zero, zero),
        _rows(
            customer.filter("c_custkey % 97 <> 0"),
            volume,
            c("c_custkey") + 10000,
            c("c_nationkey") + 1000,
            c("c_name"),
            c("c_custkey") + 10**6,
            d,
            c("c_custkey"),
            zero,
            zero,
        ),
        _rows(
            orders,
            volume,
            c("o_orderkey") + 10**8,
            c("o_custkey") + 10**6,
            F.concat(lit("order-"), c("o_orderkey").cast("string")),
            c("o_orderkey") + 10**9,
            d,
            c("o_custkey"),
            zero,
            _epoch("o_orderdate"),
        ),
        _rows(
            leaves,
            volume,
            number,
            c("l_orderkey") + 10**9,
            name,
            number,
            kind,
            own(c("o_custkey")),
            own(F.floor("l_extendedprice")),
            own(_epoch("l_shipdate")),
        ),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def sightings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Directories seen again and again: a user's events."""
    return spark.read.parquet(f"{sf_dir}/events.parquet").select(
        F.col("event_id").alias("seq"),
        F.lit(1).cast("long").alias("parent"),
        F.col("event_type").alias("name"),
        F.col("user_id").alias("ino"),
        F.lit("d").alias("type"),
    )


#: The same projection in DuckDB's SQL: tables ``entries`` and ``dirs`` for WITH RECURSIVE.
SQL = """
    cust AS (SELECT c_custkey, c_nationkey, c_name, lower(r_name) AS volume FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
    leaf AS (SELECT l.*, p_name, o_custkey, volume,
                    CASE WHEN l_returnflag = 'A' OR (l_returnflag = 'N' AND l_linestatus = 'F') THEN 'f' WHEN l_returnflag = 'N' THEN 'l'
                         WHEN l_returnflag = 'R' AND l_linestatus = 'F' THEN 'h' ELSE 'o' END AS kind
             FROM lineitem l JOIN part ON l_partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey JOIN cust ON o_custkey = c_custkey),
    base AS (
        SELECT CAST(r_regionkey + 1 AS BIGINT) AS seq, CAST(1 AS BIGINT) AS parent, r_name AS name, CAST(100 + r_regionkey AS BIGINT) AS ino,
            'd' AS type,
               CAST(0 AS BIGINT) AS uid, CAST(0 AS BIGINT) AS size, CAST(0 AS BIGINT) AS mtime, lower(r_name) AS volume FROM region
        UNION ALL SELECT 100 + n_nationkey, 100 + n_regionkey, n_name, 1000 + n_nationkey, 'd', 0, 0,
            0, lower(r_name) FROM nation JOIN region ON n_regionkey = r_regionkey
        UNION ALL SELECT 10000 + c_custkey, 1000 + c_nationkey, c_name, 1000000 + c_custkey, 'd', c_custkey,
            0, 0, volume FROM cust WHERE c_custkey % 97 <> 0
        UNION ALL SELECT 100000000 + o_orderkey, 1000000 + o_custkey, 'order-' || o_orderkey, 1000000000 + o_orderkey,
            'd', o_custkey, 0, CAST(epoch(o_orderdate) AS BIGINT), volume FROM orders JOIN cust ON o_custkey = c_custkey
        UNION ALL SELECT 1000000000000 + l_orderkey * 8 + l_linenumber, 1000000000 + l_orderkey, replace(p_name,
            ' ', '_') || '-' || l_linenumber || '.' || lower(l_linestatus),
               1000000000000 + l_orderkey * 8 + l_linenumber, kind, CASE WHEN kind = 'h' THEN 0 ELSE o_custkey END,
               CASE WHEN kind = 'h' THEN 0 ELSE CAST(floor(l_extendedprice) AS BIGINT) END, CASE WHEN kind = 'h' THEN 0 ELSE CAST(epoch(l_shipdate) AS BIGINT) END,
                   volume FROM leaf),
    entries AS (SELECT *, uid AS gid, mtime + 1 AS ctime, CASE WHEN type = 'd' THEN mtime ELSE 0 END AS rctime FROM base),
    dirs AS (SELECT ino, arg_max(parent, seq) AS parent, arg_max(name, seq) AS name, max(seq) AS seq FROM entries WHERE type = 'd' GROUP BY ino)"""
