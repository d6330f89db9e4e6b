"""Command line: ``python -m pathloom.cli build|probe|names|search|decode``.

Exit codes: 0 done; 1 failed, or published with decode or read errors on the way; 2 wrong usage.
"""

from __future__ import annotations

import argparse
import json
import sys
import time
from datetime import UTC, datetime

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from . import storage
from .functions import codec, regex
from .operators import search as ops
from .operators import tree
from .plans import index, walk
from .schema import ROOT, SELECTABLE
from .sources import admin
from .sources.store import PAGE, RadosStore
from .streaming import telemetry


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="pathloom")
    sub = p.add_subparsers(dest="command", required=True)
    source = argparse.ArgumentParser(add_help=False)
    source.add_argument("--fs", required=True, help="volume")
    source.add_argument("--omap", help="Parquet dump with oid, key and value")
    source.add_argument("--root-object", help="file with the root's object, for a dump")
    source.add_argument("--pool", help="metadata pool to read live")
    source.add_argument("--fs-dump", help="the cluster's JSON report of its volumes, to look the pool up in")
    source.add_argument("--pools", help="JSON list of pool_id and pool, for the report")
    source.add_argument("--rule", help="the JSON of the pool's placement rule")
    source.add_argument("--location", default="", help="where this client is, such as datacenter=a")
    source.add_argument("--conf", default="", help="the cluster's configuration file")
    source.add_argument("--id", default="admin", help="the cluster's user")
    source.add_argument("--max-inflight", type=int, default=32, help="reads under way at a time")
    source.add_argument("--max-ops", type=float, default=0, help="reads a second, 0 for no limit")
    source.add_argument("--latency-ceiling", type=float, default=50, help="p99 in ms over which fewer reads are under way, 0 for none")
    source.add_argument("--page-size", type=int, default=PAGE)
    source.add_argument("--duration", type=float, help="seconds after which no further level is begun")
    source.add_argument("--prefix")
    source.add_argument("--journal-flushed", action="store_true", help="the journals were flushed before")
    where = argparse.ArgumentParser(add_help=False)
    where.add_argument("--index", required=True, help="folder of all volumes")
    build = sub.add_parser("build", parents=[source, where])
    build.add_argument("--min-free-pct", type=float, default=10.0)
    build.add_argument("--names", default="", help="names whose paths are stored")
    probe = sub.add_parser("probe", parents=[source])
    probe.add_argument("--start-ino", default="1", help="hex")
    probe.add_argument("--match", help="print uid and path of matching names")
    probe.add_argument("--type", choices=sorted(SELECTABLE))
    names = sub.add_parser("names", parents=[where])
    names.add_argument("--fs", required=True, help="volumes, or all")
    names.add_argument("--names", required=True)
    search = sub.add_parser("search", parents=[where])
    search.add_argument("--fs", default="", help="volumes; all by default")
    search.add_argument("--type", choices=sorted(SELECTABLE))
    search.add_argument("--uid", type=int)
    search.add_argument("pattern")
    decode = sub.add_parser("decode")
    decode.add_argument("--root", action="store_true", help="the file holds the root's object")
    decode.add_argument("args", nargs="+", metavar="[KEY] FILE")
    return p


def say(*text) -> None:
    print(*text, file=sys.stderr)


def _text(path: str) -> str:
    with open(path) as f:
        return f.read()


def _pool(spark: SparkSession, a) -> str | None:
    """The metadata pool: as given, or that of the volume in the cluster's report. Warns if all its reads leave the client's datacenter."""
    pool = a.pool
    if pool is None and a.fs_dump:
        pools = [(p["pool_id"], p["pool"]) for p in json.loads(_text(a.pools))] if a.pools else []
        known = spark.createDataFrame(pools, "pool_id long, pool string")
        dumps = spark.createDataFrame([(_text(a.fs_dump),)], "dump string")
        found = admin.lookup(admin.filesystems(dumps, known), a.fs)
        pool = found["metadata_pool"]
        say(f"{a.fs}: pool {pool}, ranks {','.join(map(str, found['ranks'] or []))}")
    if a.rule and a.location:
        place = spark.createDataFrame([(_text(a.rule), a.location)], "rule string, location string")
        bucket = admin.primary_bucket(F.col("rule"))
        r = place.select(bucket.alias("bucket"), admin.reads_cross(bucket, F.col("location")).alias("crosses")).first()
        if r["crosses"]:
            say(f"warning: primaries are in {r['bucket']}, so every read leaves this client's datacenter")
    return pool


def _walk(spark: SparkSession, a, start: int, note=None) -> walk.Walk:
    pool = None if a.omap is not None else _pool(spark, a)
    if (a.omap is None) == (pool is None) or a.omap is not None and a.pool is not None:
        raise SystemExit(2)
    if pool is not None:
        return walk.walk_store(
            spark,
            RadosStore(pool, a.conf, a.id),
            start,
            a.max_inflight,
            a.page_size,
            a.max_ops,
            seconds=a.duration,
            note=note,
            ceiling=a.latency_ceiling / 1000 or None,
        )
    roots = [0]
    if start == ROOT and a.root_object:
        with open(a.root_object, "rb") as f:
            roots = codec.leaves(codec.decode_root(f.read())["fragtree"])
    return walk.walk(spark.read.parquet(a.omap), roots, start, seconds=a.duration)


def _bad(counters: dict) -> bool:
    return any(counters.get(k) for k in ("decode_errors", "op_errors"))


def progress_line(counters: dict, seconds: float) -> str:
    """All counters of a walk, its rate, and its share of the expected entries."""
    done, expected = counters["entries"], counters["expected"]
    share = f" pct={100 * done / expected:.1f}% of {expected}" if expected and done else ""
    return " ".join(f"{k}={v}" for k, v in counters.items()) + f" ({done / max(seconds, 1e-9):.0f}/s)" + share


def build(spark: SparkSession, a) -> int:
    index.guard(spark, a.index, a.min_free_pct)
    began, clock = datetime.now(UTC), time.monotonic()

    def note(level: int, entries: int) -> None:
        index.guard(spark, a.index, a.min_free_pct)  # the walk may take hours
        say(f"level {level}: {entries} entries ({entries / max(time.monotonic() - clock, 1e-9):.0f}/s)")

    done = _walk(spark, a, ROOT, note)
    entries = storage.stage(done.entries, "entries")
    counters = done.counters.first().asDict()
    took = time.monotonic() - clock
    say(progress_line(counters, took))
    index.guard(spark, a.index, a.min_free_pct)
    meta = {
        "pool": a.pool or "",
        "started_at": f"{began:%Y-%m-%dT%H:%M:%SZ}",
        "scan_seconds": f"{took:.0f}",
        "journal_flushed": str(a.journal_flushed).lower(),
    }
    meta |= {k: str(counters[k]) for k in ("missed_dirs", "enoent", "decode_errors", "op_errors") if k in counters}
    version = index.publish(entries, a.index, a.fs, a.prefix, index.parse_names(a.names), meta, complete=done.complete)
    say(f"published {a.fs}{'' if done.complete else '_partial'} {version}")
    return int(_bad(counters))


def probe(spark: SparkSession, a) -> int:
    start = int(a.start_ino, 16)
    done = _walk(spark, a, start)
    if a.match is not None:
        entries = storage.stage(done.entries, "entries")
        prefix = a.prefix if a.prefix is not None else "/" if start == ROOT else f"<ino 0x{start:x}>"
        hits = ops.Query(a.match, a.type).hits(entries)
        # the start directory stands for the root, under which paths end
        moved = lambda df: df.withColumn("parent", F.when(F.col("parent") == start, ROOT).otherwise(F.col("parent")))
        dirs = moved(tree.last_sightings(entries))
        for r in ops.short_tsv(tree.with_paths(moved(hits), dirs, prefix)).toLocalIterator():
            print(r["line"])
    counters = done.counters.first().asDict()
    if done.reads is not None:
        for r in telemetry.percentiles(done.reads.select(
            F.timestamp_seconds(F.lit(0)).alias("ts"),
            F.col("seconds").alias("value"),
        )).collect():  # one window
            say(f"p50={r['p50'] * 1000:.2f}ms p99={r['p99'] * 1000:.2f}ms")
    say(" ".join(f"{k}={v}" for k, v in counters.items()))
    return int(_bad(counters))


def names(spark: SparkSession, a) -> int:
    wanted = index.parse_names(a.names)
    if not wanted:
        return 2
    done = index.store_names_all(spark, a.index, None if a.fs == "all" else index.parse_names(a.fs), wanted)
    for volume, n in done.items():
        say(f"{volume}: {n} rows" if isinstance(n, int) else f"{volume}: {n}")
    return int(any(not isinstance(n, int) for n in done.values()))


def search(spark: SparkSession, a) -> int:
    query = ops.Query(a.pattern, a.type, a.uid)
    try:
        regex.to_java(a.pattern)
    except regex.PatternError as e:
        say("bad pattern:", e)
        return 2
    volumes = index.parse_names(a.fs) or index.discover(spark, a.index)
    if not volumes:
        raise index.VolumeError(f"no volumes in {a.index}")
    began, total = time.monotonic(), 0
    for name in volumes:
        volume = index.open_volume(spark, a.index, name)
        say("#", volume.describe())
        for r in ops.tsv(volume.search(query)).toLocalIterator():
            print(r["line"])
            total += 1
        sys.stdout.flush()
    say(f"# {total} matches in {time.monotonic() - began:.2f} s ({query.explain()})")
    return 0


def decode(a) -> int:
    if len(a.args) != (1 if a.root else 2):
        return 2
    try:
        with open(a.args[-1], "rb") as f:
            print(json.dumps(codec.report(None if a.root else a.args[0], f.read()), indent=2, ensure_ascii=False))
    except (OSError, ValueError) as e:
        say("error:", e)
        return 1
    return 0


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    a = _parser().parse_args(argv)
    if a.command == "decode":
        return decode(a)
    spark = spark or SparkSession.builder.appName("pathloom").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    try:
        return {"build": build, "probe": probe, "names": names, "search": search}[a.command](spark, a)
    except BrokenPipeError:
        sys.stderr.close()  # such as a pipe into head
        return 0
    except (index.VolumeError, RuntimeError, OSError) as e:
        say(e)
        return 1


if __name__ == "__main__":
    sys.exit(main())
