"""Volumes on disk: immutable versions, a pointer that is swapped in one step, and discovery."""

from __future__ import annotations

import json
import re
import threading
import time
import uuid
from dataclasses import dataclass
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import search as ops
from ..operators import tree
from ..schema import META
from ..storage import Files

LAYOUT = "3"
#: Seconds for which a builder's lock holds without being renewed, and a replaced version stays for those who read it.
LEASE, KEEP = 600.0, 3600.0


class VolumeError(RuntimeError):
    """A volume that can't be built or read."""


def parse_names(text: str) -> list[str]:
    return [x.strip() for x in text.split(",") if x.strip()]


def _check(volume: str) -> str:
    if not re.fullmatch("[a-z0-9_]+", volume):
        raise VolumeError(f"bad volume name {volume!r}")
    return volume


def guard(spark: SparkSession, root: str, min_free_pct: float = 0.0) -> None:
    """Makes the folder of all volumes, for its owner only, as it holds paths of all users; an error if others may read it or space is short."""
    files = Files(spark, root)
    mode = files.private_folder(root)
    if int(mode, 8) & 0o077:
        raise VolumeError(f"{root} has mode {mode}; it holds users' paths and must be closed to others")
    if (free := files.free_percent(root)) < min_free_pct:
        raise VolumeError(f"{free:.1f} % of {root} is free; {min_free_pct:g} % is the least")


class Lock:
    """Keeps other builders of a volume away while its owner lives: a file with a date up to which it holds, renewed by a thread."""

    def __init__(self, files: Files, home: str, lease: float = LEASE):
        self.files, self.path, self.lease = files, f"{home}/LOCK", lease
        self.owner, self.over = uuid.uuid4().hex, threading.Event()

    def _text(self) -> str:
        return json.dumps({"owner": self.owner, "until": time.time() + self.lease})

    def _expired(self) -> bool:
        try:
            return json.loads(self.files.read(self.path))["until"] < time.time()
        except (ValueError, KeyError, TypeError):
            return False  # a lock of another kind is left alone

    def __enter__(self) -> "Lock":
        if not self.files.create(self.path, self._text()):
            # whoever moves the expired lock away may try once more; only one can
            if not (self._expired() and self.files.move(self.path, f"{self.path}.{self.owner}")):
                raise VolumeError(f"{self.path} is held: the volume is being built")
            self.files.delete(f"{self.path}.{self.owner}")
            if not self.files.create(self.path, self._text()):
                raise VolumeError(f"{self.path} is held: the volume is being built")
        self.thread = threading.Thread(target=self._renew, daemon=True)
        self.thread.start()
        return self

    def _renew(self) -> None:
        while not self.over.wait(self.lease / 3):
            self.files.create(f"{self.path}.{self.owner}", self._text())
            self.files.replace(f"{self.path}.{self.owner}", self.path)

    def __exit__(self, *_) -> None:
        self.over.set()
        self.thread.join(self.lease)  # or it might put the lock back
        self.files.delete(self.path)


def publish(
    entries: DataFrame,
    root: str,
    volume: str,
    prefix: str | None = None,
    names: list[str] | None = None,
    meta: dict[str, str] | None = None,
    partitions: int | None = None,
    complete: bool = True,
) -> str:
    """Writes a version of a volume and points to it in one step; readers see the old or the new one, never half.

    Entries are dealt by ranges of name, parent and number, so that a name that very many have is spread, and sorted by them, so that
    row groups can be skipped by their bounds; a Bloom filter on names serves whole names. Beside them stand the
    directories' last sightings and the distinct names, numbered. A lock keeps a second build away. An
    incomplete walk is published beside, as ``<volume>_partial``. A version that is replaced stays for an hour.
    """
    spark = entries.sparkSession
    target = _check(volume) + ("" if complete else "_partial")
    files, home = Files(spark, root), f"{root}/{target}"
    version = f"v-{time.time_ns()}-{uuid.uuid4().hex[:8]}"
    with Lock(files, home):
        try:
            prefix = (f"/{volume}" if prefix is None else prefix).rstrip("/")
            base, order = f"{home}/{version}", ["name", "parent", "ino"]
            ranged = entries.repartitionByRange(partitions, *order) if partitions else entries.repartitionByRange(*order)
            ranged.sortWithinPartitions(*order).write.option("parquet.bloom.filter.enabled#name", "true").parquet(f"{base}/entries")
            stored = spark.read.schema(entries.schema).parquet(f"{base}/entries")
            tree.last_sightings(stored).write.parquet(f"{base}/dirs")
            dirs = spark.read.parquet(f"{base}/dirs")
            numbered = tree.numbered(stored.groupBy("name").agg(F.count("*").alias("n")), ["name"], "id")
            numbered.select("id", "name", "n").write.parquet(f"{base}/names")
            counts = tree.type_counts(stored).first().asDict()
            values = {k: str(v) for k, v in counts.items()}
            values |= {"dup_dirs": str(counts["dirs"] - dirs.count()), "names": str(spark.read.parquet(f"{base}/names").count())}
            values |= {
                "fs": volume,
                "prefix": prefix,
                "layout": LAYOUT,
                "complete": str(complete).lower(),
                "named_paths": ",".join(names or []),
            }
            if names:
                found = ops.named_paths(names, stored, dirs, prefix)
                found.sortWithinPartitions("name", "path").write.parquet(f"{base}/named_paths")
            spark.createDataFrame(sorted((values | (meta or {})).items()), META).coalesce(1).write.parquet(f"{base}/meta")
            files.create(f"{home}/CURRENT.{version}", version)
            files.replace(f"{home}/CURRENT.{version}", f"{home}/CURRENT")
            _sweep(files, home)
        except BaseException:
            if _current(files, home)[:1] != [version]:
                files.delete(f"{home}/{version}")
            raise
    return version


def _sweep(files: Files, home: str) -> None:
    """Deletes what was replaced longer ago than readers are given; what is replaced now is marked with the time."""
    current = _current(files, home)
    for old in files.names(home):
        if not old.startswith(("v-", "names-")) or old in current:
            continue
        mark = f"{home}/replaced-{old}"
        if files.create(mark, str(time.time())):
            continue
        if time.time() - float(files.read(mark)) > KEEP:
            files.delete(f"{home}/{old}")
            files.delete(mark)


def _current(files: Files, home: str) -> list[str]:
    """The version that is published and, where names were stored anew since, the folder of their paths; empty if there is none."""
    return files.read(f"{home}/CURRENT").split() if files.exists(f"{home}/CURRENT") else []


def store_names(spark: SparkSession, root: str, volume: str, names: list[str]) -> int:
    """Stores the paths of ``names`` beside the published version, in place of those it had, and returns their number.

    A volume that is being built is left alone. Readers go over to the new paths in one step.
    """
    files, home = Files(spark, root), f"{root}/{_check(volume)}"
    stored = f"names-{time.time_ns()}-{uuid.uuid4().hex[:8]}"
    with Lock(files, home):
        try:
            now = open_volume(spark, root, volume)
            found = ops.named_paths(names, now.entries, now.dirs, now.prefix)
            found.sortWithinPartitions("name", "path").write.parquet(f"{home}/{stored}/named_paths")
            spark.createDataFrame([("named_paths", ",".join(names))], META).coalesce(1).write.parquet(f"{home}/{stored}/meta")
            version = _current(files, home)[0]
            files.create(f"{home}/CURRENT.{stored}", f"{version} {stored}")
            files.replace(f"{home}/CURRENT.{stored}", f"{home}/CURRENT")
            _sweep(files, home)
            return spark.read.parquet(f"{home}/{stored}/named_paths").count()
        except BaseException:
            if stored not in _current(files, home):
                files.delete(f"{home}/{stored}")
            raise


def store_names_all(spark: SparkSession, root: str, volumes: list[str] | None, names: list[str]) -> dict[str, int | VolumeError]:
    """The same for many volumes, or all: rows stored, or why not. One volume's failure doesn't keep the others back."""
    out: dict[str, int | VolumeError] = {}
    for v in volumes or discover(spark, root):
        try:
            out[v] = store_names(spark, root, v, names)
        except VolumeError as e:
            out[v] = e
    return out


@dataclass
class Volume:
    name: str
    entries: DataFrame
    dirs: DataFrame
    meta: dict[str, str]
    named: DataFrame | None
    names: DataFrame | None = None

    @property
    def prefix(self) -> str:
        return self.meta.get("prefix", "")

    def search(self, query: ops.Query) -> DataFrame:
        """The matches.

        A pattern that is one whole name whose paths were stored is answered from those. One that gives no prefix to look up is held
        against the distinct names, if they are far fewer than the entries, and only their entries are joined.
        """
        literal = ops.regex.name_prefix(query.pattern)
        parsed = ops.regex.parse(query.pattern).subs
        whole = len(parsed) == 3 and parsed[-1].text == r"\z"
        if self.named is not None and whole and literal in parse_names(self.meta.get("named_paths", "")):
            return query.hits(self.named).select(*ops.RESULT)
        if not literal and self.names is not None and 2 * int(self.meta["names"]) <= int(self.meta["entries"]):
            wanted = ops.Query(query.pattern).hits(self.names).select("name")
            hits = ops.Query("", query.type, query.uid).hits(self.entries).join(wanted, "name", "left_semi")
            return tree.with_paths(hits, self.dirs, self.prefix).select(*ops.RESULT)
        return ops.search(query, self.entries, self.dirs, self.prefix)

    def describe(self) -> str:
        """How old and how whole the index is."""
        m = self.meta
        notes = [f"{m.get('entries', '?')} entries", f"{m.get('bytes_per_entry', '?')} bytes each", f"walk took {m.get('scan_seconds', '?')} s"]
        if "started_at" in m:
            notes.append(f"{(datetime.now(UTC) - datetime.fromisoformat(m['started_at'])).total_seconds():.0f} s old")
        notes += ["partial walk"] * (m.get("complete") != "true") + ["journal not flushed"] * (m.get("journal_flushed") != "true")
        notes += [f"{k} {m[k]}" for k in ("missed_dirs", "op_errors") if m.get(k, "0") not in ("", "0")]
        return f"{self.name}: {m.get('prefix', '')}, index of {m.get('started_at', '?')} ({', '.join(notes)})"


def open_volume(spark: SparkSession, root: str, volume: str) -> Volume:
    """Opens the current version; an index that says it has entries but is empty is an error."""
    files, home = Files(spark, root), f"{root}/{volume}"
    current = _current(files, home)
    if not current:
        raise VolumeError(f"no index for {volume}")
    base, names = f"{home}/{current[0]}", f"{home}/{current[-1]}"
    meta: dict[str, str] = {}
    for folder in dict.fromkeys((base, names)):
        meta |= {r["key"]: r["value"] for r in spark.read.schema(META).parquet(f"{folder}/meta").collect()}  # a few dozen keys
    entries = spark.read.parquet(f"{base}/entries")
    if int(meta.get("entries", "0")) > 0 and entries.isEmpty():
        raise VolumeError(f"{volume} is empty but says it has {meta['entries']} entries")
    named = spark.read.parquet(f"{names}/named_paths") if files.exists(f"{names}/named_paths") else None
    distinct = spark.read.parquet(f"{base}/names") if files.exists(f"{base}/names") else None
    return Volume(volume, entries, spark.read.parquet(f"{base}/dirs"), meta, named, distinct)


def discover(spark: SparkSession, root: str) -> list[str]:
    """Published volumes in order, staging and partial ones left out (names are held against LIKE patterns, where ``_`` is any character)."""
    files = Files(spark, root)
    return [v for v in files.names(root) if files.exists(f"{root}/{v}/CURRENT") and not re.fullmatch(".*.(new|partial)", v)]


def search_all(spark: SparkSession, root: str, query: ops.Query, volumes: list[str] | None = None) -> DataFrame:
    parts = [open_volume(spark, root, v) for v in volumes or discover(spark, root)]
    out = None
    for v in parts:
        one = v.search(query).withColumn("volume", F.lit(v.name))
        out = one if out is None else out.unionByName(one)
    if out is None:
        raise VolumeError("no volumes")
    return out
