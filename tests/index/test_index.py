import json
import random
import re
import time

import pytest

from pathloom.operators import search as ops
from pathloom.operators import tree
from pathloom.plans import index
from pathloom.schema import ENTRIES
from pathloom.streaming import telemetry


def made_entries(seed=21, folders=25, leaves=160):
    """(seq, parent, name, ino, type, uid) of a tree with repeated names, lost directories and directories seen twice."""
    rng, out = random.Random(seed), []
    words = ["tally", "draft", "Draft", "roof top", "q1.csv", "q2.csv", "q1.csv.bak", "é-mail", "ledger"]
    known = [1]
    for ino in range(100, 100 + folders):
        parent = rng.choice(known) if rng.random() < 0.9 else 7000 + ino
        out.append((parent, f"{rng.choice(words)}{rng.randrange(3)}", ino, "d", rng.randrange(4)))
        known.append(ino)
    out.append((1, "moved", 105, "d", 3))
    for ino in range(5000, 5000 + leaves):
        out.append((rng.choice(known), rng.choice(words), ino, rng.choice("ffflho"), rng.randrange(4)))
    return [(i, *r) for i, r in enumerate(out)]


def table(spark, rows):
    return spark.createDataFrame([(s, p, n, ino, t, 0 if t == "h" else u, u, ino, s, s + 1, 0) for s, p, n, ino, t, u in rows], ENTRIES)


def paths_by_hand(rows, prefix):
    dirs = {ino: (p, n) for _, p, n, ino, t, _ in rows if t == "d"}  # the last one wins

    def path(cur):
        out, depth = "", 0
        while cur in dirs and depth < 4097:
            out, cur, depth = f"/{dirs[cur][1]}{out}", dirs[cur][0], depth + 1
        return prefix + out if cur == 1 else f"<ino 0x{cur:x}>{out}"

    return [f"{path(p)}/{n}" for _, p, n, *_ in rows]


QUERIES = [
    ops.Query(r"^q1\.csv$"),
    ops.Query(r"^draft"),
    ops.Query(r"(?i)DRAFT"),
    ops.Query(r"\.csv$", uid=2),
    ops.Query(r"^roof top$", "file"),
    ops.Query(r"a.*y", "dir"),
    ops.Query("é"),
    ops.Query("ledger", uid=0),
    ops.Query("ledger", "hardlink"),
    ops.Query("nothing of that kind"),
]


def hits_by_hand(rows, q, prefix):
    out = []
    for (_, _, name, _, kind, uid), path in zip(rows, paths_by_hand(rows, prefix), strict=True):
        kinds = {"file": "f", "dir": "d", "symlink": "l", "hardlink": "h", None: kind}
        if re.search(q.pattern, name) and kinds[q.type] == kind and (q.uid is None or kind != "h" and uid == q.uid):
            out.append(path)
    return sorted(out)


def test_published_volume(spark, tmp_path):
    root, rows = str(tmp_path), made_entries()
    index.publish(table(spark, rows[:3]), root, "shelf", "/store/shelf/")
    index.publish(table(spark, rows), root, "shelf", "/store/shelf/", names=["q1.csv", "absent"])
    volume = index.open_volume(spark, root, "shelf")
    kinds = [r[4] for r in rows]
    wanted = {"entries": len(rows), "names": len({r[2] for r in rows}), "dup_dirs": 1}
    wanted |= {
        "dirs": kinds.count("d"),
        "files": kinds.count("f"),
        "symlinks": kinds.count("l"),
        "hardlinks": kinds.count("h"),
        "special": kinds.count("o"),
    }
    assert {k: int(volume.meta[k]) for k in wanted} == wanted
    for q in QUERIES:
        assert sorted(r["path"] for r in volume.search(q).collect()) == hits_by_hand(rows, q, "/store/shelf"), q
    names = volume.names.orderBy("id").collect()
    assert [(r["id"], r["name"]) for r in names] == list(enumerate(sorted({r[2] for r in rows}, key=str.encode)))
    assert sum(r["n"] for r in names) == len(rows)


def test_the_ways_of_a_search(spark, tmp_path):
    """A prefix reaches the scan of entries; a pattern without one is held against the names first; stored paths answer alone."""
    rows = made_entries()
    index.publish(table(spark, rows), str(tmp_path), "v", names=["q1.csv"])
    volume = index.open_volume(spark, str(tmp_path), "v")
    read = lambda q: "".join(volume.search(ops.Query(q)).inputFiles())
    hits = lambda q: ops.Query(q).hits(volume.entries)._jdf.queryExecution().executedPlan().toString()
    assert "StringStartsWith(name,draf)" in hits("^draf") and "EqualTo(name,ledger)" in hits("^ledger$") + hits(r"\Aledger\z")
    assert "/names/" in read("a.*y") and "/names/" not in read("^draf")
    assert "/named_paths/" in read(r"^q1\.csv$") and "/entries/" not in read(r"^q1\.csv$")


def test_many_volumes(spark, tmp_path):
    root, rows = str(tmp_path), made_entries()
    for name in ("one", "two", "old_new"):
        index.publish(table(spark, rows), root, name)
    index.publish(table(spark, rows), root, "three", complete=False)
    assert index.discover(spark, root) == ["one", "two"]
    q = ops.Query("^tally")
    found = sorted((r["volume"], r["path"]) for r in index.search_all(spark, root, q).collect())
    assert found == sorted((v, p) for v in ("one", "two") for p in hits_by_hand(rows, q, f"/{v}"))
    assert "prefix" in q.explain()


def test_versions_stay_for_their_readers(spark, tmp_path, monkeypatch):
    rows = made_entries()
    old = index.publish(table(spark, rows), str(tmp_path), "v")
    reader = index.open_volume(spark, str(tmp_path), "v")
    index.publish(table(spark, rows[:5]), str(tmp_path), "v")
    assert reader.entries.count() == len(rows)  # replaced just now, however long ago it was built
    monkeypatch.setattr(index, "KEEP", -1.0)
    index.publish(table(spark, rows[:6]), str(tmp_path), "v")
    assert old not in {p.name for p in (tmp_path / "v").iterdir()}
    assert index.open_volume(spark, str(tmp_path), "v").entries.count() == 6


def test_lock(spark, tmp_path):
    rows = made_entries()[:4]
    home = tmp_path / "v"
    home.mkdir()
    lock = home / "LOCK"
    for held in ("", json.dumps({"owner": "x", "until": time.time() + 99})):
        lock.write_text(held)
        with pytest.raises(index.VolumeError):
            index.publish(table(spark, rows), str(tmp_path), "v")
    lock.write_text(json.dumps({"owner": "x", "until": time.time() - 1}))
    index.publish(table(spark, rows), str(tmp_path), "v")
    assert not lock.exists()
    files = index.Files(spark, str(tmp_path))
    with index.Lock(files, str(home), lease=4.0) as mine:
        time.sleep(5.5)  # renewed meanwhile
        assert json.loads(lock.read_text())["until"] > time.time()
        with pytest.raises(index.VolumeError):
            index.Lock(files, str(home)).__enter__()
        assert json.loads(lock.read_text())["owner"] == mine.owner


def test_build_is_guarded(spark, tmp_path):
    root, rows = str(tmp_path), made_entries()
    with pytest.raises(index.VolumeError):
        index.publish(table(spark, rows), root, "No-Name")
    with pytest.raises(index.VolumeError):
        index.open_volume(spark, root, "v")
    version = index.publish(table(spark, rows), root, "w", complete=False)
    base = tmp_path / "w_partial" / version / "entries"
    table(spark, rows).limit(0).write.mode("overwrite").parquet(str(base))
    with pytest.raises(index.VolumeError):
        index.open_volume(spark, root, "w_partial")


def test_the_last_place_of_a_directory_counts(spark):
    rows = made_entries(5)
    entries = table(spark, rows)
    dirs = tree.last_sightings(entries)
    assert tree.duplicate_dirs(entries).first()["dup_dirs"] == 1
    got = tree.with_paths(entries, dirs, "/p").select("seq", "path").collect()
    assert [p for _, p in sorted((r["seq"], r["path"]) for r in got)] == paths_by_hand(rows, "/p")


def test_paths_by_both_ways(spark):
    rng = random.Random(2)
    dirs = {i: (rng.choice([1, *range(2, i)]) if rng.random() < 0.97 else 5_000 + i, f"d{i}") for i in range(2, 120)}
    dirs |= {1000 + i: (999 + i if i else 1, "c") for i in range(40)}
    rows = [(0, p, n, ino, "d", 0) for ino, (p, n) in dirs.items()]
    expected = dict(zip(dirs, paths_by_hand(rows, "/p"), strict=True))
    df = spark.createDataFrame([(k, *v) for k, v in dirs.items()], "ino long, parent long, name string")
    assert {r["ino"]: r["path"] for r in tree.all_paths(df, "/p/").collect()} == expected
    assert {r["ino"]: r["path"] for r in tree.resolve(df, df, "/p", 8).collect()} == expected
    assert tree.resolve(spark.createDataFrame([(1,), (77777,)], "ino long"), df, "/p").count() == 2


def test_numbers_follow_the_order(spark):
    df = spark.createDataFrame([(x * 37 % 1000, x) for x in range(1000)], "k int, v int").repartition(7)
    assert all(r["k"] == r["n"] for r in tree.numbered(df, ["k"], "n").collect())


def test_controller_and_windows(spark):
    rng = random.Random(6)
    p99 = [rng.choice([5.0, 20.0, 80.0]) for _ in range(40)]
    limit, expected = 48, []
    for x in p99:
        limit = max(1, limit // 2) if x > 30 else min(48, limit + 3)
        expected.append(limit)
    df = spark.createDataFrame([(s, i, x) for s in ("a", "b") for i, x in enumerate(p99)], "scan string, window_start long, p99 double")
    for scan in ("a", "b"):
        got = telemetry.controller(df, 30.0, 48, key="scan").filter(f"scan = '{scan}'").orderBy("window_start").collect()
        assert [r["limit"] for r in got] == expected
    values = [(w, rng.randrange(30) / 4) for w in (0, 1, 2) for _ in range(rng.randrange(1, 250))]
    s = spark.createDataFrame(values, "w int, value double").selectExpr("timestamp_seconds(2 * w + 1) AS ts", "value")
    for r in telemetry.percentiles(s).collect():
        mine = sorted(v for w, v in values if 2 * w == r["window_start"])
        assert (r["n"], r["p50"], r["p99"]) == (len(mine), mine[len(mine) // 2], mine[len(mine) * 99 // 100])


def test_windows_of_a_stream(spark, tmp_path):
    rng = random.Random(12)
    values = [(t, rng.randrange(100) / 8) for t in range(60) for _ in range(rng.randrange(6))]
    rows = spark.createDataFrame(values, "t int, value double").selectExpr("timestamp_seconds(t) AS ts", "value")
    for k in range(3):
        rows.filter(f"unix_seconds(ts) div 20 = {k}").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    q = telemetry.watch(stream).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/cp")
    q.trigger(availableNow=True).start().awaitTermination(120)
    got = {tuple(r) for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    whole = {tuple(r) for r in telemetry.percentiles(rows).collect()}
    assert got <= whole and {r for r in whole if r[0] < 46} <= got


def test_stream_keeps_the_last_sighting(spark, tmp_path):
    source, path = str(tmp_path / "in"), str(tmp_path / "out")
    rows = [(s, p, n, ino, t, u) for s, p, n, ino, t, u in made_entries() if t == "d"]
    for part in (rows[:10], rows[10:20], rows[20:]):
        table(spark, part).coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(ENTRIES).option("maxFilesPerTrigger", 1).parquet(source)
    q = telemetry.keep_dirs(stream, path, str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    last = max((tmp_path / "out").iterdir(), key=lambda p: int(p.name.split("=")[1]))
    expected = {ino: n for _, _, n, ino, _, _ in rows}
    assert {r["ino"]: r["name"] for r in spark.read.parquet(str(last)).collect()} == expected


def test_orphans_at_any_depth(spark, monkeypatch):
    from pathloom import queries

    rows = [(2, 1, "a"), (3, 2, "b"), (10, 99, "lost"), (11, 10, "x"), (12, 11, "y"), (13, 12, "z"), (14, 13, "w")]
    dirs = spark.createDataFrame(rows, "ino long, parent long, name string")
    entries = dirs.selectExpr("*", "'d' as type")
    monkeypatch.setattr(queries, "_index", lambda spark, sf: (entries, dirs))
    found = {r["ino"]: r["path"] for r in queries.orphan_paths(spark, "").collect()}
    top = "<ino 0x63>/lost"
    assert found == {10: top, 11: f"{top}/x", 12: f"{top}/x/y", 13: f"{top}/x/y/z", 14: f"{top}/x/y/z/w"}
