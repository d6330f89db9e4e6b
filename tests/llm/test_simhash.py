import random
import re

import numpy as np
import pytest
import xxhash

from pathloom.llm import simhash


def print_by_hand(text):
    text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    if not words:
        return 0
    shingles = [" ".join(words)] if len(words) < 3 else [" ".join(words[i : i + 3]) for i in range(len(words) - 2)]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components_by_hand(prints, radius=3):
    """prints: [(doc_id, fp)]; component ids by brute force."""
    fps = sorted({p for _, p in prints})
    label = {p: p for p in fps}

    def top(x):
        while label[x] != x:
            x = label[x]
        return x

    for i, a in enumerate(fps):
        for b in fps[:i]:
            if (a ^ b).bit_count() <= radius:
                label[max(top(a), top(b))] = min(top(a), top(b))
    least = {}
    for d, p in prints:
        if d is not None:
            least[top(p)] = min(least.get(top(p), d), d)
    return sorted([(d, f"{p:016x}", least.get(top(p))) for d, p in prints], key=str)


def got(df):
    return sorted([tuple(r) for r in df.collect()], key=str)


def test_documents(docs):
    rows = [(r["doc_id"], print_by_hand(r["text"])) for r in docs.collect()]
    assert got(simhash.near_duplicates(docs)) == components_by_hand(rows)


def test_odd_rows(odd, none):
    rows = [(r["doc_id"], print_by_hand(r["text"])) for r in odd.collect()]
    assert got(simhash.near_duplicates(odd)) == components_by_hand(rows)
    assert simhash.near_duplicates(none).count() == 0


def near(rng, fp, bits):
    for b in rng.sample(range(64), bits):
        fp ^= 1 << b
    return fp


def crowd(seed, n=1200):
    """Fingerprints in chains and dense groups, so that links run through many steps."""
    rng = random.Random(seed)
    fps = [rng.getrandbits(64) for _ in range(20)]
    while len(fps) < n:
        fps.append(near(rng, rng.choice(fps), rng.randint(1, 5)))
    return sorted(set(fps))


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def groups_by_links(spark, fps, **sizes):
    nodes = spark.createDataFrame([(signed(x),) for x in fps], "fp long")
    roots = {r["node"]: r["root"] for r in simhash.components(simhash.links(nodes, **sizes)).collect()}
    mine = {}
    for x in fps:
        mine.setdefault(roots.get(signed(x), signed(x)), []).append(x)
    return sorted(sorted(v) for v in mine.values())


def groups_by_hand(fps):
    groups = {}
    for i, _, c in components_by_hand(list(enumerate(fps))):
        groups.setdefault(c, []).append(fps[i])
    return sorted(sorted(v) for v in groups.values())


@pytest.mark.parametrize(
    "sizes",
    [
        {},  # each shard in a task
        {"size": 8, "large": 20, "most": 100_000},  # large shards broadcast
        {"size": 8, "large": 20, "most": 0},  # large shards in parts
        {"size": 8, "large": 20, "most": 200},  # both
    ],
)
def test_links_lose_nothing(spark, sizes):
    for seed in (1, 2):
        fps = crowd(seed)
        assert groups_by_links(spark, fps, **sizes) == groups_by_hand(fps)


def test_one_block_holds_all(spark):
    """Fingerprints that agree in three blocks share shards; copies of a text that changes a little do."""
    rng = random.Random(5)
    fps = sorted({0x123456789ABC0000 | rng.getrandbits(16) for _ in range(400)})
    for sizes in ({"size": 4, "large": 50}, {"size": 4, "large": 50, "most": 100}):
        assert groups_by_links(spark, fps, **sizes) == groups_by_hand(fps)


def test_shards_of_two_blocks(spark, monkeypatch):
    monkeypatch.setattr(simhash, "shard_bits", lambda *a: (16, 3))
    fps = crowd(6)
    assert groups_by_links(spark, fps) == groups_by_hand(fps)


def test_shard_bits():
    assert simhash.shard_bits(0) == (0, 0)
    assert simhash.shard_bits(1000) == (0, 0)
    assert simhash.shard_bits(235_000) == (8, 0)
    assert simhash.shard_bits(1 << 26) == (16, 0)
    assert simhash.shard_bits(50_000_000_000) == (16, 10)


def test_trees_prune():
    """A search compares a part of the pairs only, and less of them in larger trees."""
    rng = random.Random(7)
    shares = []
    for n in (1000, 8000):
        fps = np.array(sorted({signed(rng.getrandbits(64)) for _ in range(n)}), np.int64)
        tree = simhash.Forest(fps, np.zeros(len(fps), np.int64))
        tree.compared = 0
        tree.link()
        shares.append(tree.compared / n / n)
    assert shares[1] < shares[0] < 0.6


def test_forest_in_small_waves(monkeypatch):
    monkeypatch.setattr(simhash, "FRONTIER", 500)
    fps = crowd(3, 700)
    shard = np.arange(len(fps)) * 3 // len(fps)
    label = simhash.Forest(np.array([signed(x) for x in fps], np.int64), shard).link()
    for s in range(3):
        mine = np.flatnonzero(shard == s)
        byhand = components_by_hand([(int(i), fps[i]) for i in mine])
        for a, _, c in byhand:
            assert label[a] == label[c]
        assert len(set(label[mine].tolist())) == len({c for _, _, c in byhand})


def test_small_chunks(spark, monkeypatch):
    fps = crowd(4, 300)
    nodes = spark.createDataFrame([(signed(x),) for x in fps], "fp long")
    whole = {tuple(r) for r in simhash.components(simhash.links(nodes)).collect()}
    monkeypatch.setattr(simhash, "CHUNK", 16)
    assert {tuple(r) for r in simhash.components(simhash.links(nodes)).collect()} == whole


def test_keep_one(spark, odd, none):
    kept = simhash.keep_one(odd).collect()
    assert kept[0].__fields__ == odd.columns
    # empty texts are one group, the pair with the same words another; id 5 has a text of its own beside its copy of 4
    left = [(1, ""), (3, "word ot"), (None, "no id h"), (4, "the sam"), (5, "another"), (6, "\x00 ▁ 😀 漢"), (8, "aaaaaaa")]
    assert sorted([(r["doc_id"], (r["text"] or "")[:7]) for r in kept], key=str) == sorted(left, key=str)
    assert simhash.keep_one(none).count() == 0
    shuffled = simhash.keep_one(odd, most=0).collect()
    assert sorted(map(str, shuffled)) == sorted(map(str, kept))


def test_keep_one_with_odd_columns(spark):
    rows = [(i, f"some words of text {i % 3} stand here", {"k": i}, 1, 2, 3) for i in range(9)]
    df = spark.createDataFrame(rows, "doc_id long, text string, m map<string,int>, __gone int, row int, c1_ int")
    kept = simhash.keep_one(df)
    assert kept.columns == df.columns
    assert sorted((r["doc_id"], r["m"]["k"], r["row"]) for r in kept.collect()) == [(i, i, 2) for i in range(3)]


def test_keep_one_without_ids(spark):
    rows = [(None, "the same words of text stand here")] * 3 + [
        (7, "the same words of text stand here"),
        (None, "quite another text than those"),
    ]
    kept = simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r["doc_id"], r["text"][:5]) for r in kept if r["doc_id"]) == [(7, "the s")] and len(kept) == 2


def test_skewed_join(spark):
    from pathloom.llm import common

    rows = spark.range(300).selectExpr("id", "least(id % 40, 3) AS k")
    look = spark.createDataFrame([(k, k * 10, 270 if k == 3 else 10) for k in range(3)] + [(9, 90, 1)], "k long, v long, n long")
    want = sorted((i, min(i % 40, 3), min(i % 40, 3) * 10 if i % 40 < 3 else None) for i in range(300))
    for most in (0, 1, 2, 100):
        got = common.join_skewed(rows, look, "k", "n", most).select("id", "k", "v").collect()
        assert sorted(map(tuple, got), key=str) == sorted(want, key=str), most
