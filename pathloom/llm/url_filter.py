"""URL filters: a blocked Bloom filter of listed keys, then an exact hash join."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import bloom, common

RULES = T.StructType([
    T.StructField("host", T.StringType()),
    T.StructField("path", T.StringType()),
    T.StructField("verdict", T.StringType()),
])
ADDED = ["host", "path", "rule", "verdict"]


def parse_rules(lines: list[str]) -> list[tuple[str, str, str]]:
    """``block example.com/en/`` becomes (host, path, verdict); the path starts at the first slash."""
    out = []
    for line in lines:
        verdict, rule = line.split(" ", 1)
        at = rule.find("/")
        out.append((rule[:at] if at >= 0 else rule, rule[at:] if at >= 0 else "", verdict))
    return out


def _lowered(host: Column) -> Column:
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def split_url(url: Column) -> tuple[Column, Column]:
    """(host, path) columns. Host: after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased."""
    there = F.coalesce(F.instr(url, "://") > 0, F.lit(False))
    rest = F.substring(url, F.instr(url, "://") + 3, F.length(url))
    host = F.regexp_extract(rest, r"(?s)\A([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"(?s)\A[^/?#]*([^?#]*)", 1)
    return F.when(there, _lowered(host)).otherwise(F.lit("")), F.when(there, path).otherwise(F.lit(""))


def rule_table(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    return spark.createDataFrame(rules, RULES)


def _key(host: str, path: str) -> str:
    return f"{len(host)}:{host}{path}"


def suffixes(host: str) -> list[str]:
    """The host, and what is left of it behind each of its dots."""
    out = [host]
    while (at := host.find(".")) >= 0:
        host = host[at + 1 :]
        out.append(host)
    return out


def _hashes(texts: list[str]) -> np.ndarray:
    """Spark's xxhash64 of each text."""
    import xxhash

    digest = xxhash.xxh64_intdigest
    return np.array([digest(t.encode("utf-8", "surrogatepass"), 42) for t in texts], np.uint64).view(np.int64)


def _prober(listed: DataFrame, count: int, hosts: DataFrame, host_count: int, lengths: list[int]):
    """A function from host and path columns to the keys that the list may hold.

    The hosts' filter goes first, so that path prefixes, of the lengths that rules' paths have, are formed only under suffixes of
    the host that some rule may name.
    """
    spark = listed.sparkSession
    some_hosts = spark.sparkContext.broadcast(bloom.build(hosts.select(F.xxhash64("rh").alias("h")), host_count).tobytes())
    some_keys = spark.sparkContext.broadcast(bloom.build(listed.select(F.xxhash64("key").alias("h")), count).tobytes())

    @F.pandas_udf("array<string>")
    def possible(host, path):
        import pandas as pd

        view = lambda held: np.frombuffer(held.value, np.uint64).reshape(-1, bloom.WORDS)
        out: list[list[str]] = [[] for _ in range(len(host))]
        each = [(i, s) for i, h in enumerate(host) for s in suffixes(h)]
        listed_host = bloom.may_hold(view(some_hosts), _hashes([s for _, s in each])) if each else []
        paths = path.tolist()
        keys = [(i, _key(s, paths[i][:n])) for (i, s), hit in zip(each, listed_host, strict=True) if hit for n in lengths if n <= len(paths[i])]
        if keys:
            for (i, key), hit in zip(keys, bloom.may_hold(view(some_keys), _hashes([k for _, k in keys])), strict=True):
                if hit:
                    out[i].append(key)
        return pd.Series(out)

    return possible


def judge(pages: DataFrame, rules: DataFrame, url_col: str = "url", default: str = "allow") -> DataFrame:
    """Adds host, path, rule and verdict to every row.

    A rule (host, path, verdict) fits its host and the host's subdomains where the url's path starts with
    the rule's; the longest wins (host and path together, then the longer host; of one rule's verdicts the smaller). A rule's host is
    lower-cased as a url's is, and a rule without host or verdict isn't one. Where none fits, rule is null and
    verdict is ``default``. A null url, or one without ``://``, has an empty host and path. An empty list lets all
    pass with the default, an empty table stays empty, and repeated rows come back as often as they went in.
    Columns that clash are replaced; others may have any names.

    A url is looked up by its canonical keys: each host suffix that starts a label, with each path prefix as long as some
    rule's path. Keys go through blocked Bloom filters. Rows without a possible hit are done; the others' keys meet
    the rules in an exact hash join, in which the rules that most rows hit are broadcast, and their rows alone
    are grouped again.
    """
    spark = pages.sparkSession
    common.ship(spark)
    host, path = _lowered(F.col("host")).alias("rh"), F.coalesce("path", F.lit("")).alias("rp")
    listed = rules.select(host, path, F.col("verdict").alias("rv")).filter("rh is not null and rv is not null")
    key = F.concat(F.length("rh").cast("string"), F.lit(":"), F.col("rh"), F.col("rp"))
    listed = common.stage(listed.groupBy("rh", "rp").agg(F.min("rv").alias("rv")).withColumn("key", key), "rules")
    count, hosts = listed.count(), listed.select("rh").distinct()
    lengths = sorted(listed.agg(F.collect_set(F.length("rp"))).first()[0])  # distinct lengths, not rules

    kept = common.others(pages, ADDED).columns
    host, path = split_url(F.col(f"`{url_col}`"))
    rows = common.numbered(pages.select(*[F.col(f"`{c}`") for c in kept], host, path))
    rows = rows.withColumnsRenamed({f"c{len(kept)}_": "host_", f"c{len(kept) + 1}_": "path_"})

    def named(df: DataFrame, rule: Column, verdict: Column) -> DataFrame:
        return common.renamed(
            df,
            kept,
            F.col("host_").alias("host"),
            F.col("path_").alias("path"),
            rule.alias("rule"),
            verdict.alias("verdict"),
        )

    none = (F.lit(None).cast("string"), F.lit(default))
    if not count:
        return named(rows, *none)
    possible = _prober(listed, count, hosts, hosts.count(), lengths)
    # staged, as a row's number must stay the same if a task runs again
    rows = common.stage(rows.withColumns({"row_": common.row_key(), "keys_": possible("host_", "path_")}), "probed")
    clear, hits = rows.filter(F.size("keys_") == 0), rows.filter(F.size("keys_") > 0)
    keys = hits.select("row_", F.explode("keys_").alias("key"))
    asked = keys.groupBy("key").agg(F.count("*").alias("n")).join(listed, "key")  # the keys that are listed indeed
    found = common.join_skewed(keys, asked, "key", "n").filter("rh is not null")
    order = F.struct(
        (F.length("rh") + F.length("rp")).alias("n"),
        F.length("rh").alias("h"),
        F.concat("rh", "rp").alias("rule"),
        F.col("rv").alias("v"),
    )
    best = found.groupBy("row_").agg(F.max(order).alias("best"))
    judged = hits.join(best, "row_", "left")
    return named(clear, *none).unionByName(named(judged, F.col("best.rule"), F.coalesce("best.v", F.lit(default))))
