import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pathloom.functions import codec
from pathloom.functions import encoder as enc
from pathloom.plans import walk
from pathloom.schema import NO_SNAP

OMAP = "oid string, key string, value binary"


def test_inode_fields():
    value = enc.plain(0x5EAF00D, uid=4_100_200_300, gid=12, size=77 << 33, mtime=1_234_567, ctime=7_654_321, clients=3)
    d = codec.decode_dentry("week_31_plan_head", value)
    assert (d["name"], d["snap"], d["marker"], d["alternate_name"]) == ("week_31_plan", NO_SNAP, "i", b"")
    wanted = {"ino": 0x5EAF00D, "uid": 4_100_200_300, "gid": 12, "size": 77 << 33, "mtime": 1_234_567, "ctime": 7_654_321}
    assert {k: d["inode"][k] for k in wanted} == wanted


def test_folder_link_and_hardlink():
    d = codec.decode_dentry("x_head", enc.folder(91, old_layout=True, alternate="long name", rfiles=8, rsubdirs=4, rctime=55, tree={0: 2}))
    assert (d["alternate_name"], d["inode"]["rfiles"], d["inode"]["rsubdirs"], d["inode"]["rctime"]) == (b"long name", 8, 4, 55)
    assert codec.leaves(d["inode"]["fragtree"]) == [0x02000000 | i << 22 for i in range(4)]
    assert codec.decode_dentry("y_head", enc.link(92, "/else/where"))["inode"]["symlink"] == "/else/where"
    d = codec.decode_dentry("z_z_head", enc.remote(0xABCDEF, 4))
    assert (d["name"], d["remote_ino"], d["remote_dtype"]) == ("z_z", 0xABCDEF, 4)


def test_leaves_cover_all_once():
    """Random splits: fragments of all depths add up to the whole, and none lies in another."""
    rng = random.Random(11)
    for _ in range(50):
        tree, open_ = {}, [0]
        for _ in range(rng.randrange(6)):
            frag = open_.pop(rng.randrange(len(open_)))
            by = rng.randrange(1, 4)
            tree[frag] = by
            depth = (frag >> 24) + by
            open_ += [depth << 24 | (frag & 0xFFFFFF) | i << (24 - depth) for i in range(1 << by)]
        leaves = codec.leaves(tree)
        assert leaves == sorted(open_)
        assert sum(1 / (1 << (x >> 24)) for x in leaves) == 1
    assert codec.leaves(codec.decode_root(enc.root({0: 1}))["fragtree"]) == [0x01000000, 0x01800000]


def test_keys_and_broken_values():
    assert codec.parse_key("q_w_3c") == ("q_w", 0x3C)
    for key in ("plain", "q_xyz", "q_", "q_" + "f" * 17):
        with pytest.raises(codec.DecodeError):
            codec.parse_key(key)
    whole = enc.folder(93, tree={0: 3})
    for n in range(len(whole) - 1):
        with pytest.raises(codec.DecodeError):
            codec.decode_dentry("x_head", whole[:n])
    with pytest.raises(codec.DecodeError):
        codec.decode_dentry("x_head", enc.num("Q", 7) + b"z")
    with pytest.raises(codec.DecodeError):
        codec.decode_root(enc.text("something else"))


def test_key_columns(spark):
    keys = [
        "r_head",
        "r_s_2d",
        "plain",
        "r_xyz",
        "r_",
        "_head",
        "p\nq_head",
        "r_00000000000000000000ab",
        "r_" + "e" * 17,
        "r_head\n",
        "r_2d\n",
    ]
    name, snap, good = codec.key_columns(F.col("key"))
    for r in spark.createDataFrame([(k,) for k in keys], "key string").select(
        "key",
        name.alias("n"),
        snap.alias("s"),
        good.alias("g"),
    ).collect():
        try:
            expected = codec.parse_key(r["key"])
        except codec.DecodeError:
            expected = None
        assert ((r["n"], int(r["s"], 16)) if r["g"] else None) == expected


def test_batches_decode_as_single_values_do():
    """Values of all shapes, cut off or altered here and there."""
    rng, rows = random.Random(17), []
    for i in range(6000):
        kind = rng.randrange(5)
        if kind == 0:
            value = enc.plain(
                i,
                uid=rng.getrandbits(32),
                size=rng.getrandbits(63),
                mtime=rng.getrandbits(32),
                clients=rng.choice([0, 0, 0, 2]),
                old_layout=rng.random() < 0.2,
            )
        elif kind == 1:
            value = enc.folder(
                i,
                rfiles=rng.randrange(9),
                rsubdirs=1,
                rctime=7,
                tree=rng.choice([None, None, {0: 1}]),
                alternate=rng.choice(["", "other"]),
            )
        elif kind == 2:
            value = enc.remote(rng.getrandbits(64))
        elif kind == 3:
            value = enc.link(i, "t" * rng.randrange(9))
        else:
            value = enc.primary(ino=i, mode=0o060600, gid=3)
        if rng.random() < 0.1:
            value = value[: rng.randrange(len(value))]
        if rng.random() < 0.1:
            value = bytes(rng.randrange(256) if rng.random() < 0.05 else b for b in value)
        rows.append((
            "1.0",
            rng.choice(["n%d_head", "é_%d_head", "n%d_1f", "n%d", "%d_head_head"]) % i,
            None if rng.random() < 0.01 else value,
        ))
    rows.append(("1.0", None, b""))
    batch = pa.RecordBatch.from_arrays(
        [pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.string(), pa.binary()))],
        names=["oid", "key", "value"],
    )
    got = codec.decode_batch(batch).to_pylist()
    assert got == [codec._one(*r) for r in rows]
    assert sum(r["error"] is None for r in got) > 3000
    part = batch.slice(100, 50)
    assert codec.decode_batch(part).to_pylist() == got[100:150]


def entries_of(done):
    return sorted((r["parent"], r["name"], r["ino"], r["type"], r["uid"]) for r in done.entries.collect())


def test_walk_of_made_trees(spark, made, monkeypatch):
    monkeypatch.setattr(walk, "MERGE", 3)
    for tree in made:
        entries, counters = tree.walked(page=4)
        done = walk.walk(spark.createDataFrame(tree.rows(), OMAP), tree.roots, page=4)
        assert done.complete
        assert entries_of(done) == entries
        c = done.counters.first().asDict()
        assert {k: c[k] for k in counters} == counters
        rows = done.entries.collect()
        assert sorted(r["seq"] for r in rows) == sorted({r["seq"] for r in rows})
        first = {}
        for r in sorted(rows, key=lambda r: r["seq"]):
            if r["type"] == "d":
                first.setdefault(r["ino"], r["seq"])
        assert all(first[r["parent"]] < r["seq"] for r in rows if r["parent"] in first and r["ino"] not in first)


def test_walk_that_ends_early(spark, made):
    entries, counters = made[0].walked(levels=2)
    done = walk.walk(spark.createDataFrame(made[0].rows(), OMAP), made[0].roots, max_levels=2)
    assert not done.complete
    assert entries_of(done) == entries
    assert walk.walk(spark.createDataFrame(made[0].rows(), OMAP), made[0].roots, max_levels=10**6).complete


def test_a_chain_of_many_levels(spark, monkeypatch):
    monkeypatch.setattr(walk, "MERGE", 5)
    rows = [(f"{ino:x}.00000000", f"n{ino}_head", enc.folder(ino + 1, rfiles=1, rsubdirs=1)) for ino in range(1, 19)]
    done = walk.walk(spark.createDataFrame(rows, OMAP), [0])
    assert done.complete and done.entries.count() == 18
    assert done.counters.first()["missed_dirs"] == 1
