import math
import random

import numpy as np

from pathloom.llm import topk


def brute(rows, k=20, every=20):
    """Every row is a candidate; rows of a query's id are ranked together."""
    fine = [(i, [math.floor(64 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for i in {i for i, _ in fine if i % every == 0}:
        mine = [v for j, v in fine if j == i]
        scores = sorted((-sum(a * b for a, b in zip(q, v)), j) for q in mine for j, v in fine if j != i and len(v) == len(q))
        out += [(i, r, j, -s) for r, (s, j) in enumerate(scores[:k], 1)]
    return sorted(out)


def found(spark, rows, **more):
    vectors = topk.quantised(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    return sorted(tuple(r) for r in topk.topk(vectors, vectors.filter("vec_id % 20 = 0"), **more).collect())


def test_clusters_copies_and_bad_rows(spark):
    rng = random.Random(1)
    centres = [[rng.gauss(0, 1) for _ in range(8)] for _ in range(6)]
    rows = [(i, [c + rng.gauss(0, 0.1) for c in rng.choice(centres)]) for i in range(600)]
    rows += [(1000 + i, rows[0][1]) for i in range(300)]
    rows += [
        (2000, None),
        (2020, [None] * 8),
        (2040, [math.nan] * 8),
        (2060, [math.inf] + [0.0] * 7),
        (None, rows[1][1]),
        (2080, [1.0, 2.0]),
        (2100, [0.5, 1.0]),
        (40, rows[3][1]),
        (60, rows[60][1]),
        (2120, []),
    ]
    for sizes in ({"block": 200, "group": 16}, {"block": 60, "meet": 9, "group": 4, "pivots": 5}, {}):
        assert found(spark, rows, **sizes) == brute(rows)


def test_few_and_none(spark):
    rows = [(0, [1.0, 0.0]), (20, [0.0, 1.0]), (21, [1.0, 1.0])]
    assert found(spark, rows) == brute(rows)
    assert found(spark, []) == []
    assert found(spark, [(0, [1.0])]) == []


def test_large_numbers_stay_exact():
    d = np.array([[float(1 << 40), 1.0], [float(1 << 40), 2.0], [3.0, 4.0]])
    where, ids, scores = topk.dual_search(np.array([0]), d[:1], np.array([0, 1, 2]), d, 2)
    assert scores.tolist() == [(1 << 80) and (1 << 63) - 1, 3 * (1 << 40) + 4]
    assert ids.tolist() == [1, 2]


def test_far_cells_are_left_out():
    """In clusters far apart the search leaves most pairs out, and kth scores from elsewhere leave out more."""
    rng = np.random.default_rng(4)
    centres = rng.normal(0, 300, (40, 16))
    d = np.floor(centres[rng.integers(0, 40, 6000)] + rng.normal(0, 4, (6000, 16)))
    ids = np.arange(6000)
    counts, again = {}, {}
    where, _, scores = topk.dual_search(ids[::20], d[::20], ids, d, 20, counts=counts)
    assert counts["scored"] < 0.5 * counts["pairs"]
    worst = np.array([scores[where == i].min() for i in range(300)], float)
    topk.dual_search(ids[::20], d[::20], ids, d, 20, worst, again)
    assert again["scored"] < counts["scored"]


def test_bound_holds():
    rng = np.random.default_rng(8)
    cells = topk.Cells([x.tolist() for x in rng.normal(0, 50, (6, 5))])
    x = np.floor(rng.normal(0, 60, (400, 5)))
    cell, far = cells.nearest(x)
    p = cells.pivot(5)
    for a in range(len(p)):
        for b in range(len(p)):
            top = (x[cell == a] @ x[cell == b].T).max(initial=-np.inf)
            assert top <= topk.may_reach(p[a], far[cell == a].max(initial=0), p[b], far[cell == b].max(initial=0))


def test_tree_covers_its_points():
    points = np.unique(np.round(np.random.default_rng(5).normal(0, 30, (500, 6))), axis=0)
    tree = topk.CoverTree(points, leaf=8)
    assert sorted(tree.below(tree.root).tolist()) == list(range(len(points)))
    for node in range(len(tree.centre)):
        far = np.linalg.norm(points[tree.below(node)] - points[tree.centre[node]], axis=1)
        assert far.max() <= tree.radius[node] + 1e-6


def test_data_without_structure():
    rng = np.random.default_rng(9)
    d = np.floor(rng.normal(0, 8, (3000, 64)))
    ids = rng.permutation(3000)
    q = np.flatnonzero(ids % 20 == 0)
    where, found, scores = topk.dual_search(ids[q], d[q], ids, d, 20)
    for r, x in enumerate(q):
        s = d @ d[x]
        best = sorted((-s[j], ids[j]) for j in range(3000) if j != x)[:20]
        assert [(-a, b) for a, b in best] == list(zip(scores[where == r], found[where == r]))


def test_own_row_among_few_columns():
    d = np.array([[9.0, 0.0]] + [[8.0, float(i)] for i in range(40)])
    where, ids, scores = topk.dual_search(np.array([100]), d[:1], np.array([100, *range(40)]), d, 5)
    assert (ids.tolist(), scores.tolist()) == ([0, 1, 2, 3, 4], [72] * 5)


def test_rows_that_share_an_id_all_count(spark, tmp_path):
    """The query gives its SQL's rows where ids repeat, as candidates and as queries, with equal and with different vectors."""
    import duckdb

    from pathloom.llm import queries

    rng = random.Random(6)
    rows = [(i % 90, [rng.gauss(0, 1) for _ in range(4)]) for i in range(200)]
    rows += [(20, rows[20][1])] * 50 + [(41, rows[20][1])] * 30 + [(7, rows[20][1])]
    spark.createDataFrame(rows, "vec_id long, embedding array<double>").coalesce(1).write.parquet(f"{tmp_path}/embeddings.parquet")
    got = sorted(tuple(r) for r in queries.op4_topk(spark, str(tmp_path)).collect())
    db = duckdb.connect()
    db.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    assert got == sorted(db.execute(queries.ORACLES["op4_topk"]).fetchall())
