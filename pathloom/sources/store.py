"""Object stores read page by page in the tasks, with a limit on operations."""

from __future__ import annotations

import json
import time
from collections.abc import Iterator
from typing import Protocol

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

PAGE = 1024


class NotFound(Exception):
    """An object that isn't there."""


class Store(Protocol):
    """What a walk reads from. Stores are pickled into the tasks and open their connection there."""

    def omap_page(self, oid: str, after: str, most: int) -> tuple[list[tuple[str, bytes]], bool]:
        """Rows with keys past ``after`` in order, at most ``most``, and whether there are more."""

    def read_all(self, oid: str) -> bytes: ...


class MemoryStore:
    """Objects in memory, for small trees and tests."""

    def __init__(self, omap: dict[str, dict[str, bytes]], data: dict[str, bytes] | None = None):
        self.omap, self.data = omap, data or {}

    def omap_page(self, oid: str, after: str, most: int) -> tuple[list[tuple[str, bytes]], bool]:
        if oid not in self.omap:
            raise NotFound(oid)
        keys = sorted(k for k in self.omap[oid] if k > after)
        return [(k, self.omap[oid][k]) for k in keys[:most]], len(keys) > most

    def read_all(self, oid: str) -> bytes:
        if oid not in self.data:
            raise NotFound(oid)
        return self.data[oid]


class JsonStore(MemoryStore):
    """Objects in a JSON file that all tasks can read: object name to keys, and to hex values."""

    def __init__(self, path: str):
        with open(path) as f:
            held = json.load(f)
        super().__init__({oid: {k: bytes.fromhex(v) for k, v in page.items()} for oid, page in held.items()})


class RadosStore:
    """A pool read through the cluster's own Python binding, where that is installed."""

    def __init__(self, pool: str, conf: str, user: str):
        self.where, self.pool = (conf, user), pool
        self.ioctx = None

    def __getstate__(self):
        return self.__dict__ | {"ioctx": None}

    def _open(self):
        if self.ioctx is None:
            try:
                import rados
            except ImportError as e:
                raise RuntimeError("the cluster's Python binding isn't installed") from e
            cluster = rados.Rados(conffile=self.where[0], rados_id=self.where[1])
            cluster.connect()
            self.binding, self.ioctx = rados, cluster.open_ioctx(self.pool)
        return self.ioctx

    def omap_page(self, oid: str, after: str, most: int) -> tuple[list[tuple[str, bytes]], bool]:
        ioctx = self._open()
        try:
            with self.binding.ReadOpCtx() as op:
                # one row more than asked for shows whether there are more
                rows, _ = ioctx.get_omap_vals(op, after, "", most + 1)
                ioctx.operate_read_op(op, oid)
                got = list(rows)
        except self.binding.ObjectNotFound as e:
            raise NotFound(oid) from e
        return got[:most], len(got) > most

    def read_all(self, oid: str) -> bytes:
        ioctx, out = self._open(), b""
        try:
            size = ioctx.stat(oid)[0]
            while len(out) < size and (part := ioctx.read(oid, size - len(out), len(out))):
                out += part
        except self.binding.ObjectNotFound as e:
            raise NotFound(oid) from e
        return out


class Pace:
    """Lets at most ``rate`` operations a second pass, without a burst after a pause; 0 for no limit."""

    def __init__(self, rate: float, clock=time.monotonic, sleep=time.sleep):
        self.gap, self.clock, self.sleep = 1 / rate if rate > 0 else 0.0, clock, sleep
        self.next = clock()

    def wait(self) -> None:
        if self.gap:
            now = self.clock()
            if now < self.next:
                self.sleep(self.next - now)
            self.next = max(self.next, now) + self.gap


class StoreSource(DataSource):
    """``spark.read.format("omap")``: the rows (oid, key, value) of a store's objects, read page by page in the tasks.

    Options: ``objects``, names with commas between them; ``pool``, ``conf`` and ``user`` of a cluster, or ``json``, the path of a
    JsonStore; ``page`` and ``tasks``. An object that isn't there has no rows. A read that fails ends the query.
    """

    @classmethod
    def name(cls) -> str:
        return "omap"

    def schema(self) -> str:
        return "oid string, key string, value binary"

    def reader(self, schema) -> "StoreReader":
        return StoreReader(dict(self.options))


class StoreReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.options = options
        self.objects = [x for x in options.get("objects", "").split(",") if x]

    def partitions(self) -> list[InputPartition]:
        tasks = max(1, min(len(self.objects), int(self.options.get("tasks", "32"))))
        return [InputPartition(self.objects[k::tasks]) for k in range(tasks)]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        o, page = self.options, int(self.options.get("page", PAGE))
        store = JsonStore(o["json"]) if "json" in o else RadosStore(o["pool"], o.get("conf", ""), o.get("user", "admin"))
        kinds = pa.schema([("oid", pa.string()), ("key", pa.string()), ("value", pa.binary())])
        for oid in partition.value:
            after, more = "", True
            while more:
                try:
                    rows, more = store.omap_page(oid, after, page)
                except NotFound:
                    break
                if not rows:
                    break
                after = rows[-1][0]
                columns = [[oid] * len(rows), [k for k, _ in rows], [v for _, v in rows]]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, kinds, strict=True)], schema=kinds)


PAGES = "oid string, nonempty boolean, key string, value binary, pages long, missing boolean, problem string, seconds double"
_SCHEMA = pa.schema([
    ("oid", pa.string()),
    ("nonempty", pa.bool_()),
    ("key", pa.string()),
    ("value", pa.binary()),
    ("pages", pa.int64()),
    ("missing", pa.bool_()),
    ("problem", pa.string()),
    ("seconds", pa.float64()),
])


def read_objects(visit: DataFrame, store: Store, tasks: int, page: int = PAGE, max_ops: float = 0) -> DataFrame:
    """The rows of the objects ``oid``, and one row without key for each page or failed read (pages 1 or 0, seconds it took).

    Objects are dealt over ``tasks``, which is also how many reads are under way at most; each task keeps to its share of
    ``max_ops`` a second. A read that fails is a row with its problem and ends that object only.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pace = Pace(max_ops / tasks)
        for batch in batches:
            for oid, nonempty in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                after, more = "", True
                while more:
                    pace.wait()
                    began = time.monotonic()
                    # an object that vanishes after its first page has been seen; it isn't a directory that was missed
                    note = {"oid": oid, "nonempty": nonempty and not after, "pages": 0, "missing": False, "problem": None}
                    rows: list = []
                    try:
                        rows, more = store.omap_page(oid, after, page)
                        more = more and bool(rows)
                        note["pages"] = 1
                    except NotFound:
                        note["missing"], more = True, False
                    except Exception as e:  # noqa: BLE001  one object's failure is counted, the walk goes on
                        note["problem"], more = f"{type(e).__name__}: {e}", False
                    note["seconds"] = time.monotonic() - began
                    if rows:
                        after = rows[-1][0]
                    found = [{"oid": oid, "nonempty": nonempty, "key": k, "value": v} for k, v in rows]
                    yield pa.RecordBatch.from_pylist([note, *found], schema=_SCHEMA)

    return visit.select("oid", "nonempty").repartition(tasks, "oid").mapInArrow(run, PAGES)
