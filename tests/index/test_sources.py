import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pathloom.functions import encoder as enc  # noqa: E402
import pytest  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from pathloom.functions import codec  # noqa: E402
from pathloom.plans import walk  # noqa: E402
from pathloom.sources import admin, store  # noqa: E402


def test_walk_of_a_store(spark, made):
    """Page by page as from the dump, with one directory that can't be read and one that goes away behind its first page."""
    for tree in made[:1]:
        entries, counters = tree.walked(page=5)
        done = walk.walk_store(spark, store.MemoryStore(tree.pages(), {"1.00000000.inode": enc.root({0: 2})}), tasks=3, page=5)
        assert done.complete
        assert sorted((r["parent"], r["name"], r["ino"], r["type"], r["uid"]) for r in done.entries.collect()) == entries
        c = done.counters.first().asDict()
        assert {k: c[k] for k in counters} == counters and c["op_errors"] == 0
        dump = walk.walk(spark.createDataFrame(tree.rows(), "oid string, key string, value binary"), tree.roots)
        assert sorted(map(tuple, done.entries.collect())) == sorted(map(tuple, dump.entries.collect()))


def test_reads_that_fail(spark):
    class Flaky(store.MemoryStore):  # a local class is pickled whole
        def omap_page(self, oid, after, most):
            if oid.startswith("b0."):
                raise OSError("no answer")
            if oid.startswith("b1.") and after:
                raise store.NotFound(oid)
            return super().omap_page(oid, after, most)

    full = {"rfiles": 9, "rsubdirs": 1}
    pages = {"1.00000000": {f"n{i}_head": enc.folder(0xB0 + i, **full) for i in range(4)}, "b3.00000000": {}}
    pages |= {f"b{i}.00000000": {f"f{k}_head": enc.plain(0x900 + 10 * i + k) for k in range(9)} for i in (0, 1)}
    flaky = Flaky(pages, {"1.00000000.inode": enc.root({})})
    heard = []
    done = walk.walk_store(spark, flaky, tasks=2, page=4, note=lambda *x: heard.append(x))
    c = done.counters.first().asDict()
    # b0 can't be read, b1 goes away after a page, b2 isn't there, b3 is empty
    assert {k: c[k] for k in ("objects", "entries", "op_errors", "enoent", "missed_dirs", "pages")} == {
        "objects": 2,
        "entries": 8,
        "op_errors": 1,
        "enoent": 1,
        "missed_dirs": 1,
        "pages": 3,
    }
    assert [r["problem"] for r in done.reads.filter("problem is not null").collect()] == ["OSError: no answer"]
    assert heard == [(0, 4), (1, 8)]
    early = walk.walk_store(spark, flaky, tasks=2, seconds=0)
    assert not early.complete and early.entries.count() == 4
    below = walk.walk_store(spark, flaky, start=0xB1, tasks=2)
    assert (below.complete, below.entries.count()) == (True, 9)


def test_pace():
    now = [0.0]
    slept = []

    def sleep(s):
        slept.append(s)
        now[0] += s

    pace = store.Pace(4, lambda: now[0], sleep)
    for _ in range(5):
        pace.wait()
    assert sum(slept) == 1.0
    now[0] += 100
    pace.wait()
    pace.wait()
    assert sum(slept) == 1.25
    store.Pace(0, lambda: 0.0, sleep).wait()


def test_cluster_reports(spark):
    dump = json.dumps({
        "epoch": 3,
        "filesystems": [{"mdsmap": {"fs_name": n, "metadata_pool": p, "in": [0, p]}} for n, p in (("b", 7), ("a", 5), ("c", 9))],
    })
    pools = spark.createDataFrame([(5, "a_meta"), (7, "b_meta")], "pool_id long, pool string")
    volumes = admin.filesystems(spark.createDataFrame([(dump,), ("not json",), (None,)], "dump string"), pools)
    assert [tuple(r) for r in volumes.collect()] == [("a", "a_meta", [0, 5]), ("b", "b_meta", [0, 7]), ("c", None, [0, 9])]
    assert admin.lookup(volumes, "b")["metadata_pool"] == "b_meta"
    for name in ("c", "nobody"):
        with pytest.raises(admin.ReportError):
            admin.lookup(volumes, name)
    rules = [json.dumps({"steps": s}) for s in (
        [{"op": "set"}, {"op": "take", "item_name": "dc1~ssd"}, {"op": "take", "item_name": "dc2"}],
        [{"op": "emit"}],
        [],
    )]
    assert [r[0] for r in spark.createDataFrame(
        [(r,) for r in rules],
        "rule string",
    ).select(admin.primary_bucket(F.col("rule"))).collect()] == ["dc1", None, None]
    places = ["datacenter=dc1", "host=x datacenter=dc2", "host=x,rack=r;datacenter=dc1", "", None, "mydatacenter=z"]
    got = spark.createDataFrame([(p,) for p in places], "p string").select(
        admin.datacenter(F.col("p")),
        admin.reads_cross(F.lit("dc1"), F.col("p")),
    ).collect()
    assert [tuple(r) for r in got] == [("dc1", False), ("dc2", True), ("dc1", False), ("", False), ("", False), ("", False)]


def test_reports_of_entries(spark):
    rows = [
        ("1.0", "d_head", enc.folder(7, uid=5, rctime=9, rfiles=3, rsubdirs=1, alternate="alt", tree={0: 1})),
        ("1.0", "s_1f", enc.link(8, "../t")),
        ("1.0", "h_head", enc.remote(0x42)),
        ("1.0", "bad_head", b"x"),
        ("2.0", None, None),
    ]
    got = {r["key"]: r for r in codec.reports(spark.createDataFrame(rows, "oid string, key string, value binary")).collect()}
    assert json.loads(got["d_head"]["json"]) == {
        "name": "d",
        "snap": "head",
        "marker": "i",
        "ino": "0x7",
        "type": "dir",
        "mode": "40755",
        "uid": 5,
        "gid": 0,
        "nlink": 1,
        "size": 0,
        "mtime": "1970-01-01T00:00:00Z",
        "ctime": "1970-01-01T00:00:00Z",
        "rctime": "1970-01-01T00:00:09Z",
        "rfiles": 3,
        "rsubdirs": 1,
        "frag_objects": ["7.01000000", "7.01800000"],
        "alternate_name": "alt",
    }
    s = json.loads(got["s_1f"]["json"])
    assert (s["snap"], s["type"], s["symlink"]) == ("0x1f", "symlink", "../t")
    assert json.loads(got["h_head"]["json"]) == {
        "name": "h",
        "snap": "head",
        "marker": "l",
        "type": "hardlink",
        "uid": 0,
        "gid": 0,
        "size": 0,
        "remote_ino": "0x42",
        "remote_d_type": 8,
    }
    assert got["bad_head"]["json"] is None and got["bad_head"]["error"]
    assert codec.report(None, enc.root({}))["frag_objects"] == ["1.00000000"]


def test_fewer_reads_where_they_are_slow(spark):
    class Slow(store.MemoryStore):
        def omap_page(self, oid, after, most):
            time.sleep(0.02)
            return super().omap_page(oid, after, most)

    pages = {f"{ino:x}.00000000": {"n_head": enc.folder(ino + 1, rfiles=1, rsubdirs=1)} for ino in range(1, 4)}
    slow = Slow(pages, {"1.00000000.inode": enc.root({})})
    limits = lambda ceiling: [r["limit"] for r in walk.walk_store(spark, slow, tasks=8, ceiling=ceiling).reads.orderBy("oid").collect()]
    assert limits(0.001) == [8, 4, 2, 1]
    assert limits(5.0) == limits(None) == [8, 8, 8, 8]


def test_data_source(spark, made, tmp_path):
    pages = made[0].pages()
    (tmp_path / "objects.json").write_text(json.dumps({o: {k: v.hex() for k, v in p.items()} for o, p in pages.items()}))
    spark.dataSource.register(store.StoreSource)
    asked = [*list(pages)[:9], "absent.00000000"]
    source = spark.read.format("omap").option("json", f"{tmp_path}/objects.json").option("objects", ",".join(asked))
    rows = source.option("page", 3).option("tasks", 4).load()
    assert sorted((r["oid"], r["key"], bytes(r["value"])) for r in rows.collect()) == sorted((o, k, v) for o in asked for k, v in pages.get(o, {}).items())
    assert codec.decoded(rows).filter("error is null").count() > 0
    assert spark.read.format("omap").option("json", f"{tmp_path}/objects.json").load().count() == 0
