import json
import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pathloom.functions import encoder as enc  # noqa: E402
import pytest  # noqa: E402

from pathloom import cli  # noqa: E402
from pathloom.plans import index  # noqa: E402


@pytest.fixture(scope="module")
def dump(spark, tmp_path_factory):
    base = tmp_path_factory.mktemp("dump")
    rows = [
        ("1.00000000", "home_head", enc.folder(0x100, uid=7, rfiles=2, rsubdirs=2)),
        ("1.00000000", "hl_head", enc.remote(0x9001)),
        ("100.00000000", "sub_head", enc.folder(0x101, rfiles=1, rsubdirs=1)),
        ("100.00000000", "a.php_head", enc.plain(0x9001, uid=42, size=3, mtime=5)),
        ("101.00000000", "a.php_head", enc.plain(0x9002, uid=43)),
    ]
    spark.createDataFrame(rows, "oid string, key string, value binary").write.parquet(f"{base}/omap")
    (base / "root").write_bytes(enc.root({}))
    return base


def test_build_search_names(spark, dump, tmp_path, capsys):
    root = str(tmp_path / "volumes")
    source = ["--fs", "v", "--omap", f"{dump}/omap", "--root-object", f"{dump}/root"]
    assert cli.main(["build", "--index", root, "--min-free-pct", "0", *source], spark) == 0
    assert (tmp_path / "volumes").stat().st_mode & 0o777 == 0o700
    capsys.readouterr()
    expected = ["42\t3\t5\t/v/home/a.php", "43\t0\t0\t/v/home/sub/a.php"]
    assert cli.main(["search", "--index", root, r"^a\.php$"], spark) == 0
    out = capsys.readouterr()
    assert sorted(out.out.splitlines()) == expected
    assert "journal not flushed" in out.err and "2 matches" in out.err
    assert cli.main(["search", "--index", root, "--uid", "43", "php"], spark) == 0
    assert capsys.readouterr().out.splitlines() == expected[1:]
    assert cli.main(["names", "--index", root, "--fs", "all", "--names", "a.php, none"], spark) == 0
    volume = index.open_volume(spark, root, "v")
    assert volume.named.count() == 2 and volume.meta["named_paths"] == "a.php,none" and volume.meta["entries"] == "5"
    assert cli.main(["search", "--index", root, r"^a\.php$"], spark) == 0
    assert sorted(capsys.readouterr().out.splitlines()) == expected
    (tmp_path / "volumes" / "v" / "LOCK").write_text("")
    assert cli.main(["names", "--index", root, "--fs", "v,absent", "--names", "x"], spark) == 1
    assert cli.main(["build", "--index", root, "--min-free-pct", "0", *source], spark) == 1
    assert cli.main(["build", "--index", root, "--min-free-pct", "101", *source], spark) == 1
    assert cli.main(["search", "--index", root, "a(?=b)"], spark) == 2
    assert cli.main(["search", "--index", root, "--fs", "absent", "a"], spark) == 1
    os.chmod(root, 0o755)
    assert cli.main(["build", "--index", root, *source], spark) == 1


def test_probe(spark, dump, capsys):
    source = ["probe", "--fs", "v", "--omap", f"{dump}/omap"]
    assert cli.main([*source, "--match", "php|hl"], spark) == 0
    out = capsys.readouterr()
    assert sorted(out.out.splitlines()) == ["-\t/hl", "42\t/home/a.php", "43\t/home/sub/a.php"]
    assert "entries=5" in out.err
    assert cli.main([*source, "--start-ino", "100", "--match", "php", "--type", "file"], spark) == 0
    assert sorted(capsys.readouterr().out.splitlines()) == ["42\t<ino 0x100>/a.php", "43\t<ino 0x100>/sub/a.php"]


def test_pool_is_looked_up(spark, tmp_path, capsys):
    report = {"filesystems": [{"mdsmap": {"fs_name": n, "metadata_pool": p, "in": [0, 1]}} for n, p in (("v", 4), ("w", 5))]}
    for name, what in (
        ("fs", report),
        ("pools", [{"pool_id": 4, "pool": "v_meta"}]),
        ("rule", {"steps": [{"op": "take", "item_name": "east"}]}),
    ):
        (tmp_path / name).write_text(json.dumps(what))
    given = ["--fs-dump", f"{tmp_path}/fs", "--pools", f"{tmp_path}/pools", "--rule", f"{tmp_path}/rule", "--location", "datacenter=west"]
    # the pool is found, but the cluster's binding isn't installed
    assert cli.main(["probe", "--fs", "v", *given], spark) == 1
    out = capsys.readouterr().err
    assert "pool v_meta, ranks 0,1" in out and "primaries are in east" in out
    for name in ("w", "x"):
        assert cli.main(["probe", "--fs", name, *given], spark) == 1
        assert "v_meta" not in capsys.readouterr().err


def test_decode(tmp_path, capsys):
    (tmp_path / "v").write_bytes(enc.plain(0x77, uid=5, size=9))
    assert cli.main(["decode", "f_head", str(tmp_path / "v")]) == 0
    assert json.loads(capsys.readouterr().out)["ino"] == "0x77"
    assert cli.main(["decode", "--root", str(tmp_path / "v")]) == 1
    assert cli.main(["decode", "f_head", str(tmp_path / "absent")]) == 1
    assert cli.main(["decode", str(tmp_path / "v")]) == 2
