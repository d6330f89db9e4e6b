"""Exact top-k inner products by a dual-tree search over cover trees."""

from __future__ import annotations

from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

#: Vectors in one data block, which has a cover tree of its own, queries that meet it in a task, and queries in one tree.
BLOCK = 16_384
MEET = 16_384
GROUP = 2_048
#: Sampled vectors around which data, and queries, are dealt into cells.
PIVOTS = 1_024
#: Points of a leaf, queries of a leaf, and points that queries are scored with at a time, at least.
LEAF = 64
QUERY_LEAF = 8
WIDE = 512
#: Queries of a node go on one by one, down to its leaves, only where their bounds leave no more than this share of the points;
#: else all of up to TOGETHER queries are scored at once, which costs less a pair.
WORTH = 0.25
TOGETHER = 1_024
BRANCH = 32
#: Whole numbers below it are exact as floats.
FLOAT_EXACT = float(1 << 52)


class CoverTree:
    """A cover tree over distinct integer vectors, as arrays of nodes.

    A node holds a centre (one of its points), and the covering radius: the largest distance from the centre
    to a point below it. Its children's centres are further apart than half its radius, and each point
    below goes to the first centre within that. Where BRANCH centres don't cover all, as in data without
    structure at this scale, the rest goes to the nearest centre, whose covering radius says so: bounds
    stay exact. Nodes of up to LEAF points are leaves.
    """

    def __init__(self, points: np.ndarray, leaf: int = LEAF):
        self.points = points
        self.norm2 = np.einsum("ij,ij->i", points, points)
        self.centre: list[int] = []
        self.radius: list[float] = []
        self.children: list[list[int]] = []
        self.members: list[np.ndarray] = []
        self.size: list[int] = []
        self.root = self._grow(np.arange(len(points)), 0, leaf) if len(points) else -1

    def _far(self, centre: int, members: np.ndarray) -> np.ndarray:
        p = self.points
        return np.sqrt(np.maximum(self.norm2[members] + self.norm2[centre] - 2 * (p[members] @ p[centre]), 0))

    def _add(self, centre: int, members: np.ndarray, far: np.ndarray) -> int:
        self.centre.append(centre)
        self.radius.append(float(far.max()) if len(far) else 0.0)
        self.children.append([])
        self.members.append(members)
        self.size.append(len(members))
        return len(self.centre) - 1

    def _grow(self, members: np.ndarray, centre: int, leaf: int) -> int:
        root = self._add(centre, members, self._far(centre, members))
        waiting = [root]
        while waiting:
            node = waiting.pop()
            rest, scale = self.members[node], self.radius[node] / 2
            if len(rest) <= leaf or scale == 0:
                continue
            at, centres, groups, reach = self.centre[node], [], [], []
            while len(rest) and len(centres) < BRANCH:
                far = self._far(at, rest)
                near = far <= scale
                near[rest == at] = True
                centres.append(at)
                groups.append([rest[near]])
                reach.append([far[near]])
                rest = rest[~near]
                at = int(rest[0]) if len(rest) else -1
            if len(rest):
                c = np.array(centres)
                far2 = self.norm2[rest][:, None] + self.norm2[c] - 2 * (self.points[rest] @ self.points[c].T)
                nearest = far2.argmin(axis=1)
                far = np.sqrt(np.maximum(far2[np.arange(len(rest)), nearest], 0))
                for k in range(len(centres)):
                    groups[k].append(rest[nearest == k])
                    reach[k].append(far[nearest == k])
            for c, members, far in zip(centres, groups, reach, strict=True):
                child = self._add(c, np.concatenate(members), np.concatenate(far))
                self.children[node].append(child)
                waiting.append(child)
            self.members[node] = self.members[node][:0]
        return root

    def below(self, node: int) -> np.ndarray:
        out, waiting = [], [node]
        while waiting:
            k = waiting.pop()
            out.append(self.members[k])
            waiting += self.children[k]
        return np.concatenate(out)


def _scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Integer inner products, exact."""
    top = max(np.abs(a).max(initial=0), 1.0) * max(np.abs(b).max(initial=0), 1.0) * max(a.shape[1], 1)
    if top < FLOAT_EXACT:
        return (a @ b.T).astype(np.int64)
    wide = a.astype(object) @ b.astype(object).T
    return np.array([[max(-(1 << 63), min((1 << 63) - 1, int(x))) for x in row] for row in wide], np.int64).reshape(len(a), len(b))


def dual_search(
    q_ids: np.ndarray,
    q: np.ndarray,
    d_ids: np.ndarray,
    d: np.ndarray,
    k: int,
    worst: np.ndarray | None = None,
    counts: dict | None = None,
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query's position, vec_id, score) of each query's k best rows of one block, its own id left out.

    Equal vectors share a tree point. A pair of nodes is left out where even the largest inner product that the
    two covering radii allow is below every kth score that the query node's queries have so far. ``worst``
    may give kth scores known from elsewhere: rows below them may be left out. ``counts`` gets the pairs of different vectors
    that were scored, of all there are.
    """
    none = np.zeros(0, np.int64)
    if not len(q_ids) or not len(d_ids):
        return none, none, none
    q, d = q.astype(np.float64), d.astype(np.float64)
    order = np.argsort(d_ids, kind="stable")
    d_ids, d = d_ids[order], d[order]
    points, group = np.unique(d, axis=0, return_inverse=True)
    group = group.reshape(-1)
    by_group = np.argsort(group, kind="stable")  # ids of a point come in order
    qpoints, qgroup = np.unique(q, axis=0, return_inverse=True)
    qgroup = qgroup.reshape(-1)
    data, queries = CoverTree(points), CoverTree(qpoints, QUERY_LEAF)
    asked = np.split(np.argsort(qgroup, kind="stable"), np.cumsum(np.bincount(qgroup))[:-1])
    # of equal vectors 2k rows of the smallest ids can matter, k of each, as k of them may have the query's own id
    fresh = np.r_[True, (np.diff(group[by_group]) != 0) | (np.diff(d_ids[by_group]) != 0)][: len(by_group)]
    again = np.arange(len(by_group)) - np.maximum.accumulate(np.where(fresh, np.arange(len(by_group)), 0))
    by_group = by_group[again < k]
    start = np.searchsorted(group[by_group], np.arange(len(points) + 1))
    place = np.arange(len(by_group)) - start[group[by_group]]
    entries = by_group[place < 2 * k]
    first = np.searchsorted(group[entries], np.arange(len(points) + 1))
    # of each query the best so far, by score and then smaller id
    best_s = np.full((len(q_ids), k), np.iinfo(np.int64).min)
    best_i = np.full((len(q_ids), k), np.iinfo(np.int64).max)
    kth = np.full(len(q_ids), -np.inf) if worst is None else worst.astype(np.float64).copy()
    dc, dr, dn = points[data.centre], np.array(data.radius), np.sqrt(data.norm2[data.centre])

    def base(rows: np.ndarray, some: np.ndarray) -> None:
        if counts is not None:
            counts["scored"] = counts.get("scored", 0) + len(rows) * len(some)
        s = _scores(q[rows], points[some])
        take = s >= kth[rows][:, None]
        mine, some = rows[take.any(axis=1)], some[take.any(axis=0)]
        if not len(mine):
            return
        s = s[take.any(axis=1)][:, take.any(axis=0)]
        count = first[some + 1] - first[some]
        which = np.repeat(np.arange(len(some)), count)
        entry = entries[np.repeat(first[some], count) + np.arange(len(which)) - np.repeat(np.cumsum(count) - count, count)]
        order = np.argsort(entry)  # entries are numbered by id
        entry, s = entry[order], s[:, which[order]]
        _best(best_i, best_s, mine, d_ids[entry], s, q_ids[mine], k)
        full = best_i[mine, -1] != np.iinfo(np.int64).max
        kth[mine[full]] = np.maximum(kth[mine[full]], best_s[mine[full], -1].astype(np.float64))

    slack = 1e-9
    for_node: dict[int, np.ndarray] = {}

    def queries_of(node: int) -> np.ndarray:
        if node not in for_node:
            for_node[node] = np.concatenate([asked[p] for p in queries.below(node)])
        return for_node[node]

    def bounds(qn: int, nodes: np.ndarray) -> np.ndarray:
        """The largest inner product that each data node may hold for a query below ``qn``, or a little more."""
        c, r = qpoints[queries.centre[qn]], queries.radius[qn]
        bound = dc[nodes] @ c + r * dn[nodes] + dr[nodes] * np.sqrt(c @ c) + r * dr[nodes]
        return bound + slack * (np.abs(bound) + 1)

    def finish(qn: int, nodes: np.ndarray, once: bool = False) -> None:
        """Searches for the queries of one node: data nodes by falling bound, until none can reach the worst kth score (or ``once``, a few of them)."""
        rows = queries_of(qn)
        heap = [(-b, int(n)) for n, b in zip(nodes, bounds(qn, nodes), strict=True)]
        heapify(heap)
        held: list[np.ndarray] = []
        size = 0
        while heap or held:
            # own rows may take a place above, so what is left out has a bound strictly below the kth score
            if heap and -heap[0][0] >= kth[rows].min():
                node = heappop(heap)[1]
                if data.children[node]:
                    inner = np.array(data.children[node])
                    for n, b in zip(inner, bounds(qn, inner), strict=True):
                        heappush(heap, (-b, int(n)))
                    continue
                held.append(data.members[node])
                size += len(held[-1])
                if size < WIDE and heap:
                    continue
            elif not held:
                return
            base(rows, np.concatenate(held))
            held, size = [], 0
            if once:
                return

    if worst is None:  # a first kth score for each query, from the points that promise most
        for qn in [n for n, c in enumerate(queries.children) if not c]:
            finish(qn, np.array([data.root]), once=True)
        best_s[:], best_i[:] = np.iinfo(np.int64).min, np.iinfo(np.int64).max
    # the points that the bounds of a query node's leaves leave, summed up over its queries; children come behind their parents
    leaves = np.array([n for n, c in enumerate(data.children) if not c])
    sizes = np.array([data.size[n] for n in leaves])
    left = np.zeros(len(queries.children))
    for qn in range(len(left) - 1, -1, -1):
        below = queries.children[qn]
        left[qn] = left[below].sum() if below else queries.size[qn] * sizes[bounds(qn, leaves) >= kth[queries_of(qn)].min()].sum()
    if counts is not None:
        counts["pairs"] = counts.get("pairs", 0) + len(q_ids) * len(points)
    waiting = [(queries.root, np.array([data.root]))]
    while waiting:
        qn, nodes = waiting.pop()
        nodes = nodes[bounds(qn, nodes) >= kth[queries_of(qn)].min()]
        if not len(nodes):
            continue
        if not queries.children[qn] or queries.size[qn] <= TOGETHER and left[qn] > WORTH * queries.size[qn] * len(points):
            finish(qn, nodes)
            continue
        # data nodes that are wider than the query node are opened, then the query node is
        wide = {n for n in nodes.tolist() if data.children[n] and data.radius[n] > queries.radius[qn]}
        nodes = np.array([n for n in nodes.tolist() if n not in wide] + [c for n in wide for c in data.children[n]])
        for child in queries.children[qn]:
            waiting.append((child, nodes))
    found = best_i != np.iinfo(np.int64).max
    where = np.nonzero(found)[0]
    return where, best_i[found], best_s[found]


def _best(best_i: np.ndarray, best_s: np.ndarray, rows: np.ndarray, ids: np.ndarray, s: np.ndarray, own: np.ndarray, k: int) -> None:
    """Puts the scores ``s`` of ``ids``, which ascend, into the k best of ``rows``."""
    low, high = np.iinfo(np.int64).min, np.iinfo(np.int64).max
    width = s.shape[1]
    mask = ids[None, :] != own[:, None]
    if np.abs(s.astype(np.float64)).max(initial=0) * (width + 1) < FLOAT_EXACT:
        key = np.where(mask, s * width + (width - 1 - np.arange(width)), -(1 << 62))  # ties to the smaller id
        pick = np.argpartition(-key, k - 1, axis=1)[:, :k] if width > k else np.broadcast_to(np.arange(width), s.shape)
    else:
        pick = np.argsort(np.where(mask, s, low)[:, ::-1], axis=1, kind="stable")[:, ::-1][:, : k + 1]
        pick = width - 1 - pick
    fresh = np.take_along_axis(mask, pick, axis=1)
    ids = np.concatenate([best_i[rows], np.where(fresh, ids[pick], high)], axis=1)
    scores = np.concatenate([best_s[rows], np.where(fresh, np.take_along_axis(s, pick, axis=1), low)], axis=1)
    order = np.lexsort((ids, ~scores), axis=1)[:, :k]  # ~x falls as x rises, without overflow
    best_i[rows], best_s[rows] = np.take_along_axis(ids, order, axis=1), np.take_along_axis(scores, order, axis=1)


def quantised(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", scale: int = 64) -> DataFrame:
    """(vec_id, v): each vector as floor(scale * component), of every row whose id and components are finite numbers.

    Rows that share an id all stay. Null ids, vectors and components, and those that aren't finite, take a row out.
    """
    v = F.col(vec_col)
    fine = F.col(id_col).isNotNull() & v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    doubles = F.transform(v, lambda x: F.floor(F.lit(scale) * x.cast("double")).cast("double"))
    return df.filter(F.coalesce(fine, F.lit(False))).select(F.col(id_col).cast("long").alias("vec_id"), doubles.alias("v"))


def _matrix(column: pa.ChunkedArray | pa.Array, rows: int) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(rows, -1) if rows else np.zeros((0, 0))


class Cells:
    """Pivots of each length of vectors; a vector belongs to the cell of the nearest one. Without a pivot of its length, the origin is one."""

    def __init__(self, sampled: list[list[float]]):
        self.pivots: dict[int, np.ndarray] = {}
        for v in sampled:
            known = self.pivots.get(len(v), np.zeros((0, len(v))))
            self.pivots[len(v)] = np.unique(np.vstack([known, np.array(v, np.float64)[None]]), axis=0)

    def pivot(self, dim: int) -> np.ndarray:
        return self.pivots.get(dim, np.zeros((1, dim)))

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(cell, distance to its pivot), the distance a little too large rather than too small."""
        p = self.pivot(x.shape[1])
        far2 = (x * x).sum(axis=1)[:, None] + (p * p).sum(axis=1) - 2 * (x @ p.T)
        cell = far2.argmin(axis=1)
        return cell, np.sqrt(((x - p[cell]) ** 2).sum(axis=1)) * (1 + 1e-12)


def _dealt(df: DataFrame, cells: dict[str, "Cells"]) -> DataFrame:
    """Adds, for each entry of ``cells``, the row's cell and its distance to the pivot."""
    extra = [f"{n}_cell int, {n}_far double" for n in cells]
    schema = "vec_id long, v array<double>, dim int, row long, " + ", ".join(extra)

    def run(batches):
        for batch in batches:
            dims = batch.column(2).to_numpy()
            for dim in np.unique(dims):
                some = batch.filter(pa.array(dims == dim))
                x = _matrix(some.column(1), some.num_rows)
                out = list(some.columns)
                for c in cells.values():
                    cell, far = c.nearest(x)
                    out += [pa.array(cell, pa.int32()), pa.array(far)]
                yield pa.RecordBatch.from_arrays(
                    out,
                    names=["vec_id", "v", "dim", "row", *[f"{n}_{w}" for n in cells for w in ("cell", "far")]],
                )

    return df.select("vec_id", "v", "dim", "row").mapInArrow(run, schema)


def _counted(df: DataFrame, name: str, size: int) -> dict[tuple[int, int], tuple[float, int]]:
    """(dim, cell) -> (radius, parts of about ``size`` rows). There are at most PIVOTS cells of each length."""
    found = df.groupBy("dim", f"{name}_cell").agg(F.count("*").alias("n"), F.max(f"{name}_far").alias("r")).collect()
    return {(r["dim"], r[f"{name}_cell"]): (r["r"], -(-r["n"] // size)) for r in found}


def may_reach(q: np.ndarray, q_radius: float, d: np.ndarray, d_radius: float) -> float:
    """The largest inner product of a vector within ``q_radius`` of ``q`` and one within ``d_radius`` of ``d``, or a little more."""
    bound = q @ d + q_radius * np.sqrt(d @ d) + d_radius * np.sqrt(q @ q) + q_radius * d_radius
    return float(bound + 1e-9 * (abs(bound) + 1))


FOUND = "query_row long, query_id long, vec_id long, score long"


def _searcher(k: int, group: int):
    """The function that searches one block for the queries that meet it, in trees of about ``group`` queries."""

    def search(left, right):
        names = ("query_row", "query_id", "vec_id", "score")
        out = [pa.table({n: pa.array([], pa.int64()) for n in names})]
        if left.num_rows and right.num_rows:
            d_ids, d = left.column("vec_id").to_numpy(), _matrix(left.column("v"), left.num_rows)
            right = right.sort_by([("query_cell", "ascending")])
            for at in range(0, right.num_rows, group):
                some = right.slice(at, group)
                ids, rows = some.column("vec_id").to_numpy(), some.column("row").to_numpy()
                worst = some.column("worst").to_numpy()
                where, found, scores = dual_search(ids, _matrix(some.column("v"), some.num_rows), d_ids, d, k, worst)
                out.append(pa.table({n: pa.array(x, pa.int64()) for n, x in zip(names, (rows[where], ids[where], found, scores), strict=True)}))
        return pa.concat_tables(out)

    return search


def topk(
    vectors: DataFrame,
    queries: DataFrame,
    k: int = 20,
    block: int = BLOCK,
    meet: int = MEET,
    group: int = GROUP,
    pivots: int = PIVOTS,
) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k largest inner products over all rows of other ids, ties to the smaller id.

    Both tables are (vec_id, v). Rows of ``queries`` that share an id are ranked together, and every row of ``vectors`` is a
    candidate, also where rows share an id. Rows with a null id or vector take no part; components must be numbers. Only vectors of the query's length are compared. Scores beyond a
    long are held at its ends. An empty table gives an empty result; with fewer candidates than k, all are returned.

    - Data are dealt into cells around sampled vectors, and cells into blocks, each of which gets a cover tree in the task that
      holds it. Queries are dealt into cells of their own.
    - Each query first searches one block of the cell that is nearest to it. Its kth score there is a bound that it takes along.
    - A cell of queries then meets the blocks of those cells that may reach the worst kth score of its queries, by the two covering
      radii; all other blocks are left out. Inside a task the two trees prune further.

    A task holds at most about ``block`` vectors and ``meet`` queries.
    """
    spark = vectors.sparkSession
    common.ship(spark)

    def shape(df: DataFrame) -> DataFrame:
        fine = df.filter("vec_id is not null and v is not null")
        return fine.select("vec_id", "v", F.size("v").alias("dim"), common.row_key().alias("row"))

    rows, asked = common.stage(shape(vectors), "vectors"), common.stage(shape(queries), "queries")
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    n, m = rows.count(), asked.count()
    if not n or not m:
        return empty

    def sample(df: DataFrame, most: int) -> Cells:
        return Cells([r["v"] for r in df.orderBy(
            F.xxhash64("row", F.lit("pivot")),
            "row",
        ).limit(most).select("v").collect()] if most > 1 else [])

    data_cells, query_cells = sample(rows, min(pivots, -(-n // block))), sample(asked, min(pivots, -(-m // meet)))
    rows = common.stage(_dealt(rows, {"data": data_cells}), "dealt")
    asked = common.stage(_dealt(asked, {"data": data_cells, "query": query_cells}), "asked")
    data, query = _counted(rows, "data", block), _counted(asked, "query", meet)
    home = _counted(asked, "data", meet)

    def numbers(cells: dict, name: str) -> DataFrame:
        at, out = 0, []
        for (dim, cell), (_, parts) in sorted(cells.items()):
            out.append((dim, cell, at, parts))
            at += parts
        return F.broadcast(spark.createDataFrame(out, f"dim int, {name}_cell int, {name}_first long, {name}_parts int"))

    def part(name: str, salt: str):
        return F.pmod(F.xxhash64("row", F.lit(salt)), F.col(f"{name}_parts"))

    blocks = numbers(data, "data")
    left = rows.join(blocks, ["dim", "data_cell"]).withColumn(
        "block",
        F.col("data_first") + part("data", "block"),
    ).select("vec_id", "v", "dim", "data_cell", "block")
    right = asked.join(blocks, ["dim", "data_cell"], "left").withColumn("home", F.col("data_first") + part("data", "home"))
    right = right.select("vec_id", "v", "dim", "row", "data_cell", "query_cell", "home")

    # the first round: each query in one block of the cell nearest to it
    mine = spark.createDataFrame([(*c, parts) for c, (_, parts) in home.items()], "dim int, data_cell int, home_parts int")
    once = left.join(F.broadcast(mine), ["dim", "data_cell"]).withColumn("share", F.explode(F.sequence(F.lit(0), F.col("home_parts") - 1)))
    first = right.join(F.broadcast(mine), ["dim", "data_cell"]).withColumn("share", part("home", "share").cast("int"))
    first = first.withColumn("worst", F.lit(float("-inf"))).withColumn("block", F.col("home"))
    once = once.select("vec_id", "v", "block", "share")
    first = first.select("vec_id", "v", "row", "query_cell", "worst", "block", "share")
    near = once.groupBy("block", "share").cogroup(first.groupBy("block", "share")).applyInArrow(_searcher(k, group), FOUND)
    near = common.stage(near, "near")
    bounds = near.groupBy(F.col("query_row").alias("row")).agg(F.when(F.count("*") >= k, F.min("score").cast("double")).alias("worst"))
    right = common.stage(right.join(bounds, "row", "left").withColumn("worst", F.coalesce("worst", F.lit(float("-inf")))), "bounded")

    # the second round: all other blocks that may hold something better
    least = right.groupBy("dim", "query_cell").agg(F.min("worst").alias("worst")).collect()  # one for each cell
    pairs = []
    for r in least:
        at, (q_radius, parts) = query_cells.pivot(r["dim"])[r["query_cell"]], query[r["dim"], r["query_cell"]]
        for (dim, cell), (d_radius, _) in data.items():
            if dim == r["dim"] and may_reach(at, q_radius, data_cells.pivot(dim)[cell], d_radius) >= r["worst"]:
                pairs.append((dim, r["query_cell"], cell, parts))
    found = near
    if pairs:
        # at most PIVOTS x PIVOTS pairs of cells
        met = F.broadcast(spark.createDataFrame(pairs, "dim int, query_cell int, data_cell int, query_parts int"))
        many = left.join(met, ["dim", "data_cell"]).withColumn("share", F.explode(F.sequence(F.lit(0), F.col("query_parts") - 1)))
        visits = right.drop("data_cell").join(met, ["dim", "query_cell"]).withColumn(
            "share",
            part("query", "share").cast("int"),
        ).join(blocks, ["dim", "data_cell"])
        visits = visits.withColumn(
            "block",
            F.explode(F.sequence(F.col("data_first"), F.col("data_first") + F.col("data_parts") - 1)),
        ).filter("not block <=> home")
        visits = visits.select("vec_id", "v", "row", "query_cell", "worst", "block", "share")
        by = ("block", "query_cell", "share")
        far = many.select("vec_id", "v", *by).groupBy(*by).cogroup(visits.groupBy(*by)).applyInArrow(_searcher(k, group), FOUND)
        found = near.unionByName(far)
    by = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
