"""SimHash near-duplicates: fingerprints, BK-trees in shards, and components of the links."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

RADIUS = 3
#: Fingerprints that an even shard holds, about.
SHARD = 1024
#: A shard with more fingerprints than this is large: one task doesn't search it alone.
LARGE = 8192
#: Fingerprints of large shards whose trees are broadcast, 17 bytes each.
BROADCAST = 2_000_000
#: Items (fingerprint, shard) that a task holds at a time, unless one group alone is larger.
CHUNK = 400_000
#: Pairs (query, tree node) that a search compares at a time.
FRONTIER = 2_000_000


def fingerprint(text: str | None) -> int:
    """The unsigned 64-bit SimHash of 3-word shingles; 0 for a null text or one without words."""
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words)] if len(words) < 3 else list(map(b" ".join, zip(words, words[1:], words[2:])))
    digest = xxhash.xxh64_digest
    ones = np.zeros(64, np.int64)
    for at in range(0, len(shingles), 65536):
        some = shingles[at : at + 65536]
        raw = np.frombuffer(b"".join([digest(s, 42) for s in some]), np.uint8).reshape(-1, 8)
        ones += np.unpackbits(raw, axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(shingles)).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", row_col: str | None = None) -> DataFrame:
    """row (that of ``row_col``, if it is given), doc_id and the fingerprint as a signed long."""
    common.ship(docs.sparkSession)

    def run(batches):
        for batch in batches:
            for some in common.slices(batch):
                known: dict = {}
                values = []
                for text in some.column(2).to_pylist():
                    if text not in known:
                        value = fingerprint(text)
                        known[text] = value - (1 << 64) if value >> 63 else value
                    values.append(known[text])
                yield pa.RecordBatch.from_arrays([*some.columns[:2], pa.array(values, pa.int64())], names=["row", "doc_id", "fp"])

    row = common.row_key() if row_col is None else F.col(f"`{row_col}`")
    source = docs.select(row.alias("row"), F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    return source.mapInArrow(run, "row long, doc_id long, fp long")


class Forest:
    """BK-trees of many shards at once, a child keyed by its Hamming distance to the parent.

    Items come sorted by shard, distinct within one. All items of a shard start at its root and go down
    together; the first to arrive at a free key becomes the child there.
    """

    def __init__(self, fps: np.ndarray, shard: np.ndarray, radius: int = RADIUS, nodes: tuple | None = None):
        """``nodes``, (parent, edge key, level, label) by place within the shard, is what an earlier build has found."""
        n = len(fps)
        self.fps, self.radius, self.compared = fps.view(np.uint64), radius, 0
        first = np.flatnonzero(np.r_[True, shard[1:] != shard[:-1]]) if n else np.zeros(0, np.int64)
        size = np.diff(np.r_[first, n])
        self.root = np.repeat(first, size)
        self.weight = np.repeat(size, size)
        if nodes is None:
            self.label = np.arange(n)
            self._build(first)
        else:
            parent, self.key, self.level, label = nodes
            self.parent, self.label = np.where(parent >= 0, parent + self.root, -1), label + self.root
        self.nodes = np.flatnonzero(self.parent >= 0)
        code = self.parent[self.nodes] * 128 + self.key[self.nodes]
        order = np.argsort(code, kind="stable")
        self.nodes, self.code = self.nodes[order], code[order]
        by_level = np.argsort(self.level, kind="stable")
        self.levels = np.split(by_level, np.flatnonzero(np.diff(self.level[by_level])) + 1)[:0:-1] if n else []

    def _build(self, first: np.ndarray) -> None:
        n = len(self.fps)
        self.parent, self.key, self.level = np.full(n, -1), np.zeros(n, np.int64), np.zeros(n, np.int64)
        at, active, depth = self.root.copy(), np.setdiff1d(np.arange(n), first, assume_unique=True), 0
        while len(active):
            depth += 1
            self.compared += len(active)
            d = common.popcount(self.fps[active] ^ self.fps[at[active]]).astype(np.int64)
            near = d <= self.radius
            self._unite(active[near], at[active][near])
            slot, where, inverse = np.unique(at[active] * 128 + d, return_index=True, return_inverse=True)
            child = active[where]
            self.parent[child], self.key[child], self.level[child] = slot // 128, slot % 128, depth
            at[active] = child[inverse]
            active = np.delete(active, where)

    def _unite(self, a: np.ndarray, b: np.ndarray) -> None:
        label = self.label
        while len(a):
            x, y = label[a], label[b]
            differ = x != y
            if not differ.any():
                return
            a, b, x, y = a[differ], b[differ], x[differ], y[differ]
            np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
            while True:
                up = label[label]
                if np.array_equal(up, label):
                    break
                label[:] = up

    def _whole(self) -> np.ndarray:
        """Of each node the label that its whole subtree has, or -1."""
        whole = self.label.copy()
        for nodes in self.levels:  # deepest first
            p = self.parent[nodes]
            np.minimum.at(whole, p[whole[nodes] != whole[p]], -1)
        return whole

    def link(self, asked: np.ndarray | None = None) -> np.ndarray:
        """A label for each item; equal labels are linked, over one or more steps within the radius.

        Every item is searched for, or only those at the places ``asked``. A search follows only edges whose key lies
        within the radius of the distance to the node, and leaves out subtrees that are already linked to the
        query as a whole. ``compared`` counts the pairs whose distance is computed.
        """
        asked = np.arange(len(self.fps)) if asked is None else asked
        n, at = len(asked), 0
        cost = np.cumsum(self.weight[asked])
        while at < n:
            to = max(at + 1, int(np.searchsorted(cost, (cost[at - 1] if at else 0) + FRONTIER, "right")))
            whole = self._whole()
            q = asked[at:to]
            node = self.root[q]
            keep = whole[node] != self.label[q]
            q, node = q[keep], node[keep]
            found_a, found_b = [], []
            while len(q):
                self.compared += len(q)
                d = common.popcount(self.fps[q] ^ self.fps[node]).astype(np.int64)
                hit = (d <= self.radius) & (q != node)
                found_a.append(q[hit])
                found_b.append(node[hit])
                low = np.searchsorted(self.code, node * 128 + np.maximum(d - self.radius, 0), "left")
                high = np.searchsorted(self.code, node * 128 + np.minimum(d + self.radius, 127), "right")
                count = high - low
                total = int(count.sum())
                q = np.repeat(q, count)
                step = np.arange(total) - np.repeat(np.cumsum(count) - count, count)
                node = self.nodes[np.repeat(low, count) + step]
                keep = whole[node] != self.label[q]
                q, node = q[keep], node[keep]
            if found_a:
                self._unite(np.concatenate(found_a), np.concatenate(found_b))
            at = to
        return self.label


def shard_bits(count: int, size: int = SHARD) -> tuple[int, int]:
    """(bits of the outer block, of the inner block) that a shard's fingerprints agree in, so that an even shard holds about ``size`` of ``count``."""
    bits = max(0, (max(1, count) - 1).bit_length() - (size - 1).bit_length())
    return min(16, bits), max(0, min(12, bits - 16))


def _bands(fp, outer_bits: int, inner_bits: int):
    """Keys of the shards of a fingerprint; fingerprints that differ in 3 bits or fewer share a key at least.

    Three bits leave one of 4 blocks of the 64 bits equal. Where that is too coarse, they leave one of 4 blocks of the other 48
    bits equal too. A key holds the blocks' places and the low bits of their values.
    """
    parts, block, inner = 4, 16, 12
    keys = []
    for i in range(parts):
        outer = F.shiftrightunsigned(fp, i * block).bitwiseAND((1 << outer_bits) - 1)
        if not inner_bits:
            keys.append(F.shiftleft(outer, 8).bitwiseOR(F.lit(i).cast("long")))
            continue
        # the bits left when block i is taken out, as one number
        low = fp.bitwiseAND((1 << (i * block)) - 1) if i else F.lit(0).cast("long")
        high = F.shiftleft(F.shiftrightunsigned(fp, (i + 1) * block), i * block) if i < parts - 1 else F.lit(0).cast("long")
        left = high.bitwiseOR(low)
        for j in range(parts):
            value = F.shiftrightunsigned(left, j * inner).bitwiseAND((1 << inner_bits) - 1)
            keys.append(F.shiftleft(F.shiftleft(outer, 12).bitwiseOR(value), 8).bitwiseOR(F.lit(i * parts + j).cast("long")))
    return F.array(*keys)


def _star(fp: np.ndarray, label: np.ndarray, before: np.ndarray | None = None) -> pa.RecordBatch:
    """Each item whose label isn't its own (or isn't what it was before) with its label's item."""
    linked = np.flatnonzero(label != (np.arange(len(label)) if before is None else before))
    pairs = np.stack([fp[linked], fp[label[linked]]], axis=1)
    pairs = np.unique(pairs, axis=0) if len(linked) else np.zeros((0, 2), np.int64)
    return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0], pa.int64()), pa.array(pairs[:, 1], pa.int64())], names=["a", "b"])


def _searcher(radius: int):
    """A task that builds and searches the trees of whole groups (fp, group), which come in order."""

    def search(fps: list, groups: list):
        fp = np.concatenate(fps)
        return _star(fp, Forest(fp, np.concatenate(groups), radius).link())

    def run(batches):
        fps, groups, held = [], [], 0
        for batch in batches:
            fp, group = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            if held >= CHUNK and groups[-1][-1] != group[-1]:
                cut = int(np.flatnonzero(np.r_[groups[-1][-1], group[:-1]] != group)[0])
                yield search([*fps, fp[:cut]], [*groups, group[:cut]])
                fps, groups, held, fp, group = [], [], 0, fp[cut:], group[cut:]
            fps.append(fp)
            groups.append(group)
            held += len(fp)
        if held:
            yield search(fps, groups)

    return run


def _grow(radius: int):
    """A task's function that builds the tree of one shard: a row for each node, in order of the fingerprints."""

    def one(key, table):
        fp = np.sort(table.column("fp").to_numpy())
        tree = Forest(fp, np.zeros(len(fp), np.int64), radius)
        columns = {"shard": np.full(len(fp), key[0].as_py()), "place": np.arange(len(fp)), "fp": fp}
        columns |= {"parent": tree.parent, "key": tree.key, "level": tree.level, "label": tree.label, "linked": fp[tree.label]}
        return pa.table({n: pa.array(v, pa.int64()) for n, v in columns.items()})

    return one


NODES = ", ".join(f"{n} long" for n in ("shard", "place", "fp", "parent", "key", "level", "label", "linked"))


def _broadcast_links(large: DataFrame, radius: int) -> DataFrame:
    """Links within large shards, whose sizes the caller has checked.

    Each shard's tree is built in one task; the trees are broadcast, and every task searches in them for its part of
    the shards' items.
    """
    spark = large.sparkSession
    trees = common.stage(large.groupBy("shard").applyInArrow(_grow(radius), NODES), "trees")
    table = trees.drop("linked").toArrow().sort_by([("shard", "ascending"), ("place", "ascending")])
    small = {"key": np.int8, "level": np.int32, "parent": np.int32, "label": np.int32}
    held = spark.sparkContext.broadcast({n: table.column(n).to_numpy().astype(small.get(n, np.int64)) for n in table.column_names})

    def run(batches):
        t = {n: v.astype(np.int64) for n, v in held.value.items()}
        fp, shard = t["fp"], t["shard"]
        forest = Forest(fp, shard, radius, (t["parent"], t["key"], t["level"], t["label"]))
        before = forest.label.copy()
        for batch in batches:
            asked_fp, asked_shard = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            places = []
            for s in np.unique(asked_shard):
                low, high = np.searchsorted(shard, s, "left"), np.searchsorted(shard, s, "right")
                places.append(low + np.searchsorted(fp[low:high], asked_fp[asked_shard == s]))
            if places:
                forest.link(np.sort(np.concatenate(places)))
        yield _star(fp, forest.label, before)

    asked = large.select("fp", "shard").repartition(F.xxhash64("fp", "shard"))
    built = trees.filter("label <> place").select(F.col("fp").alias("a"), F.col("linked").alias("b"))
    return built.unionByName(asked.mapInArrow(run, "a long, b long"))


def links(nodes: DataFrame, radius: int = RADIUS, size: int = SHARD, large: int = LARGE, most: int = BROADCAST) -> DataFrame:
    """Edges (a, b) that connect the distinct fingerprints ``fp`` as their links within the radius do.

    A shard holds fingerprints that agree in blocks of bits, about ``size`` of them if bits are even; every link lies in some
    shard. Each shard has a BK-tree, in which all its fingerprints are searched for:

    - up to ``large`` fingerprints, in the task that holds the shard;
    - larger shards, the largest first and up to ``most`` fingerprints in all, through broadcast trees, so that all tasks share
      the search;
    - what is beyond that is cut into parts by a hash, and each two parts of a shard meet in a task of their own.

    A tree's edges are returned as a star, not as all pairs.
    """
    if not 0 <= radius <= 3:
        raise ValueError("shards are keyed for a radius of 0 to 3")
    bits = shard_bits(nodes.count(), size)
    items = nodes.select("fp", F.explode(_bands(F.col("fp"), *bits)).alias("shard"))
    sizes = common.stage(items.groupBy("shard").agg(F.count("*").alias("n")).filter(F.col("n") > large), "sizes")
    groups, more = items.select("fp", F.col("shard").alias("group")), None
    if not sizes.isEmpty():
        held, total = [], 0
        for r in sizes.orderBy(F.desc("n"), "shard").limit(most // large + 1).collect():  # few: each has over ``large`` of ``most``
            if total + r["n"] <= most:
                held.append(r["shard"])
                total += r["n"]
        parts = F.ceil(F.col("n") / large).cast("int")
        marked = sizes.select("shard", "n", parts.alias("parts"), F.col("shard").isin(held).alias("held"))
        dealt = common.join_skewed(items, marked, "shard", "n")
        even = dealt.filter("parts is null").select("fp", F.col("shard").alias("group"))
        own = F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int")
        met = dealt.filter("not held").withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        pair = F.xxhash64("shard", F.least("own", "other"), F.greatest("own", "other"))
        groups = even.unionByName(met.select("fp", pair.alias("group")))
        if held:
            more = _broadcast_links(dealt.filter("held").select("fp", "shard"), radius)
    # a group's rows meet in a task; the tasks see whole groups in order
    found = groups.repartition("group").sortWithinPartitions("group", "fp").mapInArrow(_searcher(radius), "a long, b long")
    return found if more is None else found.unionByName(more)


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node that each node of the edges reaches, by large-star and small-star rounds.

    Every round is a group and a join on keys; a node with very many links meets a skew join, and rounds
    are staged in the shared folder, where the round before is deleted.
    """
    u, v = F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")
    now = common.stage(edges.filter("a <> b").select(u, v).distinct(), "edges")

    def mark(df: DataFrame):
        row = df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        return tuple(row)

    before = mark(now)
    while before[0]:
        # large star: larger neighbours of each node go to the smallest node it knows
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        # small star: a node and its smaller neighbours go to the smallest of them
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")
        old, now = now, common.stage(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "edges")
        common.drop(old)
        after = mark(now)
        if after == before:
            break
        before = after
    return now.select(F.col("u").alias("node"), F.col("v").alias("root"))


def _labelled(prints: DataFrame, radius: int) -> DataFrame:
    """row, doc_id, fp, component_id and first (the row that stays) for staged fingerprints.

    The row that stays has the smallest id; a null id comes after all others, and of equal ids the first row stays.
    """
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")
    nodes = common.stage(prints.groupBy("fp").agg(F.min(order).alias("least"), F.count("*").alias("rows")), "nodes")
    roots = components(links(nodes, radius))
    # a fingerprint without links is its own root, and needs no further join
    linked = roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())
    labelled = common.stage(linked.join(nodes, linked.node == nodes.fp).select("fp", "least", "root"), "labelled")
    best = labelled.groupBy("root").agg(F.min("least").alias("best"), F.count("*").alias("n"))
    moved = common.join_skewed(labelled, best, "root", "n").select("fp", F.col("best").alias("moved"))
    named = nodes.join(moved, "fp", "left").select("fp", "rows", F.coalesce("moved", "least").alias("best"))
    found = common.join_skewed(prints, named, "fp", "rows")
    return found.select("row", "doc_id", "fp", F.col("best.doc_id").alias("component_id"), F.col("best.row").alias("first"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (smallest doc_id that links reach, itself included).

    A null text counts as empty: fingerprint zero, linked like any other. A null doc_id gets its group's
    component_id, and is none itself; where all are null, so is the component_id. Repeated rows come
    back as often as they went in. Other columns take no part. An empty table gives an empty result.
    """
    prints = common.stage(fingerprints(docs, id_col, text_col), "fingerprints")
    shown = F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint")
    return _labelled(prints, radius).select("doc_id", shown, "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS, most: int = BROADCAST) -> DataFrame:
    """The rows of ``docs`` without near-duplicates: of each component one row stays, that with the smallest id.

    A null id comes after all others; of equal ids, the row that comes first in ``docs`` stays. Rows that share an id but
    aren't near-duplicates all stay. Columns may have any names and types.

    What goes is decided on row numbers, ids and fingerprints alone; texts are joined with it once, and not
    shuffled if at most ``most`` rows go, whose numbers are then broadcast.
    """
    spot = {c: f"c{docs.columns.index(c)}_" for c in (id_col, text_col)}
    rows = common.stage(common.numbered(docs).withColumn("row", common.row_key()), "rows")
    prints = common.stage(fingerprints(rows, spot[id_col], spot[text_col], "row"), "fingerprints")
    gone = common.stage(_labelled(prints, radius).filter("row <> first").select("row"), "gone")
    few = gone.count() <= most
    return common.renamed(rows.join(F.broadcast(gone) if few else gone, "row", "left_anti"), docs.columns)
