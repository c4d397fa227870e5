"""Embedding near-dedup by cover trees and their dual traversal: exact pairs above a cosine threshold.

On unit vectors a cosine of at least t is a distance of at most sqrt(2 - 2t). Equal vectors of a label form a class, stood for by
its smallest id. Labels are dealt over cells around pivots (the top of a cover tree of a bounded sample, nested: the first
k pivots serve a label that needs k cells), and cells over blocks of bounded size. A vector is at home in the cell of its nearest pivot, and
visits another cell only if the plane midway between the two pivots is within the threshold's distance of it: whatever is nearer to the
other pivot lies beyond that plane. Visits go one way, from lower to higher cells, so a pair meets once. A task has a block at home and a
bounded part of its visitors: a cover tree of each with halving radii, and a dual traversal that drops node pairs further apart than their
covering radii plus the threshold. What reaches leaves is compared in double precision. Only link counts and spanning edges leave
a task. Pivots and radii decide what is compared where, never what is found.

Vectors of one label that no bound can tell apart cost the square of their number, as in any exact search; copies don't.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.cluster import checkpoint, components, lookup, with_least_ids

THRESHOLD = 0.98
#: Vectors at home in a task, and visitors for each of them.
BLOCK, VISITORS = 1500, 4
PIVOTS, SAMPLE = 1024, 4096
LEAF = 8
SLACK = 1e-9


class CoverTree:
    """Nested levels with halving radii over rows of x. Node k: center[k], radius[k] (to its furthest point), and kids[k] or points[k]."""

    def __init__(self, x: np.ndarray):
        self.x = x
        self.center: list[int] = []
        self.radius: list[float] = []
        self.kids: list[np.ndarray | None] = []
        self.points: list[np.ndarray | None] = []
        every = np.arange(len(x))
        d = np.linalg.norm(x - x[0], axis=1)
        todo = [(self._node(0, float(d.max())), every, float(d.max()))]
        while todo:
            k, mine, level = todo.pop()
            if len(mine) <= LEAF or self.radius[k] <= SLACK:
                self.points[k] = mine
                continue
            half, kids, rest = min(level, self.radius[k]) / 2, [], mine
            while len(rest):
                c = rest[0]
                d = np.sqrt(np.maximum(2 - 2 * (x[rest] @ x[c]), 0))
                d[0] = 0
                near = d <= half
                kid = self._node(int(c), float(d[near].max()))
                kids.append(kid)
                todo.append((kid, rest[near], half))
                rest = rest[~near]
            self.kids[k] = np.array(kids)
        self.center_at, self.radius_at = np.array(self.center), np.array(self.radius)

    def _node(self, center: int, radius: float) -> int:
        self.center.append(center)
        self.radius.append(radius + 1e-7)  # distances from dot products are rough near 0
        self.kids.append(None)
        self.points.append(None)
        return len(self.center) - 1


def dual(a: CoverTree, b: CoverTree, reach: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Candidate pairs of points (of a, of b), leaf pair by leaf pair: all pairs within reach are among them, each once.

    Of one tree with itself, two nodes meet once, and so do two points; no point meets itself.
    """
    todo = [(0, 0)]
    while todo:
        i, j = todo.pop()
        alone = a is b and i == j
        ki, kj = a.kids[i], b.kids[j]
        if ki is None and kj is None:
            p, q = np.triu_indices(len(a.points[i]), 1) if alone else (x.ravel() for x in np.indices((len(a.points[i]), len(b.points[j]))))
            yield a.points[i][p], b.points[j][q]
            continue
        if alone:
            us = vs = ki
        elif ki is not None and (kj is None or a.radius[i] >= b.radius[j]):
            us, vs = ki, np.array([j]) if kj is None or a.radius[i] > 2 * b.radius[j] else kj
        else:
            us, vs = np.array([i]) if ki is None or b.radius[j] > 2 * a.radius[i] else ki, kj
        near = 2 - 2 * (a.x[a.center_at[us]] @ b.x[b.center_at[vs]].T)
        bound = a.radius_at[us][:, None] + b.radius_at[vs][None, :] + reach + SLACK
        p, q = np.nonzero(near <= bound * bound)
        if alone:
            p, q = p[p <= q], q[p <= q]
        todo += zip(us[p].tolist(), vs[q].tolist(), strict=True)


#: Candidate pairs that are compared at once.
COMPARED = 1 << 17


def close_pairs(x: np.ndarray, y: np.ndarray | None, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Exact pairs (row of x, row of y) with cosine >= threshold, each once, in parts of bounded size; with y None, pairs inside x."""
    unit = [v / np.linalg.norm(v, axis=1, keepdims=True) for v in ([x] if y is None else [x, y])]
    a = CoverTree(unit[0])
    b = a if y is None else CoverTree(unit[1])
    y = x if y is None else y
    held: list[tuple[np.ndarray, np.ndarray]] = []
    size = 0

    def compare() -> tuple[np.ndarray, np.ndarray]:
        i, j = np.concatenate([p for p, _ in held]), np.concatenate([q for _, q in held])
        keep = np.zeros(len(i), bool)
        for k in range(0, len(i), COMPARED):
            u, v = x[i[k : k + COMPARED]], y[j[k : k + COMPARED]]
            keep[k : k + COMPARED] = (u * v).sum(1) / (np.sqrt((u * u).sum(1)) * np.sqrt((v * v).sum(1))) >= threshold
        return i[keep], j[keep]

    for p, q in dual(a, b, float(np.sqrt(max(0.0, 2 - 2 * threshold)))):
        held.append((p, q))
        size += len(p)
        if size >= COMPARED:
            yield compare()
            held, size = [], 0
    if size:
        yield compare()


def pairs_within(x: np.ndarray, y: np.ndarray | None, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of ``close_pairs``; with y None, as i < j."""
    parts = [*close_pairs(x, y, threshold)]
    i, j = (np.concatenate([p[k] for p in parts]) if parts else np.zeros(0, np.int64) for k in (0, 1))
    return (np.minimum(i, j), np.maximum(i, j)) if y is None else (i, j)


def _spanning(m: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest index linked to each, directly or not."""
    label = np.arange(m)
    while len(a):
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    return label


def _tile(threshold: float):
    def tile(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        """A block with some of its visitors, or all small labels of a bundle. Pairs inside a block are its first part's."""
        out = []
        for _, part in rows.sort_values("node").groupby(["label", "dim"], sort=True):
            x = np.array(part["embedding"].tolist(), np.float64)
            n, node, home = part["n_copies"].to_numpy(), part["node"].to_numpy(), part["home"].to_numpy()
            p, q = np.flatnonzero(home), np.flatnonzero(~home)
            links, forest = np.zeros(len(x), np.int64), []
            inside = ((p[i], p[j]) for i, j in close_pairs(x[p], None, threshold)) if part["part"].iloc[0] == 0 and len(p) > 1 else ()
            across = ((p[i], q[j]) for i, j in close_pairs(x[p], x[q], threshold)) if len(p) and len(q) else ()
            for a, b in itertools.chain(inside, across):
                np.add.at(links, a, n[b])
                np.add.at(links, b, n[a])
                root = _spanning(len(x), a, b)
                moved = np.flatnonzero(root != np.arange(len(x)))
                forest.append((moved, root[moved]))
            a, b = (np.concatenate([f[k] for f in forest]) if forest else np.zeros(0, np.int64) for k in (0, 1))
            live = links > 0
            out.append(pd.DataFrame({"node": node, "u": node, "v": node[_spanning(len(x), a, b)], "links": links})[live])
        return pd.concat(out) if out else pd.DataFrame({"node": [], "u": [], "v": [], "links": []}).astype("int64")

    return tile


def choose_pivots(sample: np.ndarray, most: int = PIVOTS) -> np.ndarray:
    """Unit vectors, each next one furthest from those before: the first k are the top of a cover tree for every k."""
    if not len(sample):
        return np.zeros((0, 0))
    x = sample / np.linalg.norm(sample, axis=1, keepdims=True)
    chosen, d = [0], np.full(len(x), np.inf)
    while len(chosen) < min(most, len(x)):
        d = np.minimum(d, np.linalg.norm(x - x[chosen[-1]], axis=1))
        k = int(d.argmax())
        if d[k] <= SLACK:
            break
        chosen.append(k)
    return x[chosen]


def _cells(pivots: dict[int, np.ndarray], reach: float):
    apart = {d: np.sqrt(np.maximum(2 - 2 * (t @ t.T), 0)) + 1e-6 if len(t) else t for d, t in pivots.items()}

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 2000):
                batch = whole.slice(at, 2000)
                vectors, k, dim = batch.column("embedding"), batch.column("k").to_numpy(), batch.column("dim").to_numpy()
                cell = np.zeros(len(k), np.int64)
                visits: list[list[int]] = [[] for _ in k]
                for d, want in np.unique(np.stack([dim, k]), axis=1).T.tolist():
                    mine, table = np.flatnonzero((dim == d) & (k == want)), pivots.get(d)
                    if table is None or want <= 1:
                        continue
                    x = np.array(vectors.take(pa.array(mine)).to_pylist(), np.float64)
                    dot = (x / np.linalg.norm(x, axis=1, keepdims=True)) @ table[:want].T
                    near = dot.argmax(1)
                    cell[mine] = near
                    beyond = dot.max(1)[:, None] - dot <= (reach * apart[d][:want, :want] + 1e-6)[near]
                    beyond &= np.arange(dot.shape[1])[None, :] > near[:, None]
                    row, col = np.nonzero(beyond)
                    for r, c in zip(mine[row].tolist(), col.tolist(), strict=True):
                        visits[r].append(c)
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("node", "label", "dim")), pa.array(cell), pa.array(visits, pa.list_(pa.int64()))], names=["node", "label", "dim", "cell", "visits"])

    return cells


def near_duplicates(vectors: DataFrame, *, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label", threshold: float = THRESHOLD, block: int = BLOCK) -> DataFrame:
    """One row per vector: n_links, component_id (smallest id reachable by links, itself included), kept (id = component_id).

    Vectors are compared only where labels are equal and not null. One that is null, empty, all zeros, or holds a null or
    non-finite component links with nothing; so does one without an id, whose component is null and which is kept. Ids may be of any type
    that has an order. Vectors of different dimensions don't link. Rows that repeat an id and vector are copies of each other; other rows
    that share an id are vectors of their own, and components that meet in an id have one number. Other columns are ignored, whatever
    their names. An empty table gives an empty result.
    """
    kind = vectors.schema[vector].dataType.simpleString()
    kind = kind if kind == "array<float>" else "array<double>"  # floats travel as floats; arithmetic is in doubles
    rows = vectors.select(F.col(vec_id).alias("id"), F.col(vector).cast(kind).alias("embedding"), F.col(label).cast("string").alias("label"))
    finite = F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    good = F.coalesce(F.col("id").isNotNull() & F.col("label").isNotNull() & finite & F.exists("embedding", lambda v: v != 0), F.lit(False))
    # Rows go to their class by two hashes, of 96 bits together.
    same = F.when(good, F.struct(F.xxhash64("label", "embedding").alias("a"), F.hash("embedding", "label").alias("b")))
    rows = checkpoint(rows.select("id", same.alias("same"), F.when(good, F.col("label")).alias("label"), F.when(good, F.col("embedding")).alias("embedding")))
    classes = rows.filter("same IS NOT NULL").groupBy("same", "label", "embedding").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("n_copies"))
    classes = checkpoint(classes.select(F.monotonically_increasing_id().alias("node"), "same", "label", "embedding", "rep", "n_copies", F.size("embedding").alias("dim")))
    size = classes.groupBy("label", "dim").agg(F.count(F.lit(1)).alias("n"))
    size = checkpoint(size.withColumn("k", F.least(F.ceil(F.col("n") / block), F.lit(PIVOTS)).cast("long")))
    pivots: dict[int, list] = {}
    for r in classes.orderBy("same").limit(SAMPLE).select("embedding").collect():
        pivots.setdefault(len(r["embedding"]), []).append(r["embedding"])
    tables = {d: choose_pivots(np.array(v)) for d, v in pivots.items()}
    reach = float(np.sqrt(max(0.0, 2 - 2 * threshold)))
    keyed = classes.withColumn("group", F.concat_ws(",", "label", "dim"))
    sized = lookup(keyed, size.select(F.concat_ws(",", "label", "dim").alias("group"), "n", "k"), "group", ["node"]).drop("group")
    big = sized.filter(F.col("n") > block).mapInArrow(_cells(tables, reach), "node long, label string, dim int, cell long, visits array<long>")
    tiles = _tiles(checkpoint(big), sized.filter(F.col("n") <= block).select("node", "label", "dim"), size, block)
    placed = tiles.join(classes.select("node", "label", "dim", "embedding", "n_copies"), "node")
    found = checkpoint(placed.groupBy("tile", "part").applyInPandas(_tile(threshold), "node long, u long, v long, links long"))
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    joined = components(found.filter("u <> v").select("u", "v")).select(F.col("id").alias("node"), "component")
    labels = classes.select("node", "same", "rep", "n_copies").join(links, "node", "left").join(joined, "node", "left")
    labels = labels.select("same", "rep", (F.col("n_copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "node").alias("component"))
    labels = with_least_ids(checkpoint(labels))
    out = lookup(rows.filter("same IS NOT NULL").select("id", "same"), labels.select("same", "n_links", "component_id"), "same", ["id"]).select("id", "n_links", "component_id")
    out = out.unionByName(rows.filter("same IS NULL").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id")))
    return out.select(F.col("id").alias(vec_id), "n_links", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"))


def _tiles(cells: DataFrame, small: DataFrame, size: DataFrame, block: int) -> DataFrame:
    """(node, tile, part, home): which tasks each vector goes to. No vector is in this table, and none of its rows is a pair.

    cells: home cell and visited cells of the vectors of large labels. Small labels share tiles by hash.
    """
    few = F.greatest(F.ceil(F.coalesce(F.sum(F.when(F.col("n") <= block, F.col("n"))), F.lit(0)) * 2 / block), F.lit(1)).cast("long")
    bundles = size.agg(few.alias("n")).first()["n"]
    one = small.select("node", F.concat(F.lit("small "), F.pmod(F.xxhash64("label", "dim"), F.lit(bundles)).cast("string")).alias("tile"), F.lit(0).cast("long").alias("part"), F.lit(True).alias("home"))
    name = F.concat_ws(",", "label", "dim", "cell")
    homes = cells.select("node", name.alias("cell"))
    visits = cells.select("node", "label", "dim", F.explode("visits").alias("cell")).select("node", name.alias("cell"))
    n = homes.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).join(visits.groupBy("cell").agg(F.count(F.lit(1)).alias("m")), "cell", "left")
    blocks = F.ceil(F.col("n") / block)
    # A block's visitors are those of its cell, and the cell's own vectors of lower blocks.
    parts = F.greatest(F.ceil((F.coalesce("m", F.lit(0)) + F.when(blocks > 1, F.col("n")).otherwise(0)) / (VISITORS * block)), F.lit(1))
    table = checkpoint(n.select("cell", blocks.cast("long").alias("blocks"), parts.cast("long").alias("parts")))
    range_of = lambda a, b: F.when(a < b, F.sequence(a, b - 1)).otherwise(F.array().cast("array<bigint>"))
    zero, mine = F.lit(0).cast("long"), F.pmod(F.xxhash64("node"), F.col("blocks"))
    part = F.pmod(F.hash("node", F.lit("part")).cast("long"), F.col("parts"))
    at = lambda b: F.concat_ws(",", F.col("cell"), b)
    at_home = lookup(homes, table, "cell", ["node"])
    own = at_home.select("node", at(mine).alias("tile"), F.explode(range_of(zero, F.col("parts"))).alias("part"), F.lit(True).alias("home"))
    inside = at_home.select("node", "cell", part.alias("part"), F.explode(range_of(mine + 1, F.col("blocks"))).alias("b"))
    across = lookup(visits, table, "cell", ["node"]).select("node", "cell", part.alias("part"), F.explode(range_of(zero, F.col("blocks"))).alias("b"))
    away = inside.unionByName(across).select("node", at(F.col("b")).alias("tile"), "part", F.lit(False).alias("home"))
    return one.unionByName(own).unionByName(away)
