"""Points near points, and points in regions, by a distributed dual-tree join.

Each side's points are summed up in a quadtree of bounded size. The driver
walks two such trees at once: pairs of nodes that can't hold a near pair are
dropped, the others are opened down to leaves. Each pair of leaves left over
is a task's work, where a finer tree of each leaf is walked in the same way:
impossible pairs of nodes are dropped, certainly near ones accepted wholesale
and only uncertain leaves are measured point by point.

Distances are great-circle ones on a sphere. Nodes are bounded by boxes of the
points' unit vectors, so poles and the date line need no special care.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stonegraph.session import checkpointed, shuffle_partitions

EARTH_KM = 6371.0
DEEP = 28  #: levels of the quadtree at most
STEP = 4, 8, 12, 16, 20, 24, 28  #: levels at which the points are counted
LEAF = 8192  #: points, or so, in a leaf of the trees on the driver
FINE = 48  #: points in a leaf of the trees within a task
OUT = pa.schema([("a", pa.string()), ("b", pa.string())])
SENT = pa.schema([("pair", pa.int64()), ("side", pa.int8()), ("id", pa.string()), ("lat", pa.float64()), ("lon", pa.float64())])


def located(lat: Column, lon: Column) -> Column:
    """Both values there and on the earth, and not at the placeholder (0, 0). NaN is no value."""
    return F.coalesce(lat.between(-90, 90) & lon.between(-180, 180) & ~((lat == 0) & (lon == 0)), F.lit(False))


def unit_vectors(lat: np.ndarray, lon: np.ndarray) -> np.ndarray:
    a, o = np.radians(lat), np.radians(lon)
    return np.stack([np.cos(a) * np.cos(o), np.cos(a) * np.sin(o), np.sin(a)], 1)


def great_circle_km(lat1, lon1, lat2, lon2) -> np.ndarray:
    a1, a2 = np.radians(lat1), np.radians(lat2)
    h = np.sin((a2 - a1) / 2) ** 2 + np.cos(a1) * np.cos(a2) * np.sin(np.radians(lon2 - lon1) / 2) ** 2
    return 2 * EARTH_KM * np.arcsin(np.sqrt(np.clip(h, 0, 1)))


def chord(km: float) -> float:
    """The straight line, on the unit sphere, under ``km`` of great circle."""
    return 2 * math.sin(min(km / (2 * EARTH_KM), math.pi / 2))


def box_bounds(alo, ahi, blo, bhi) -> tuple[np.ndarray, np.ndarray]:
    """Squares of the least and of the greatest distance between points of two boxes (rows of three)."""
    gap = np.maximum(0, np.maximum(alo - bhi, blo - ahi))
    span = np.maximum(np.abs(ahi - blo), np.abs(bhi - alo))
    return (gap**2).sum(-1), (span**2).sum(-1)


# ---- the bounded tree on the driver


class Tree:
    """Quadtree nodes (level, i, j) with counts and boxes; leaves hold about ``leaf`` points, and heavier leaves at the last level are cut into chunks."""

    def __init__(self, cells: dict[tuple[int, int, int], tuple], leaf: int):
        self.box, self.n, self.kids, self.leaves = {}, {}, {}, {}
        for cell, (n, *box) in cells.items():
            self.n[cell], self.box[cell], self.kids[cell] = n, np.array(box, float), []
        for level in range(max((c[0] for c in cells), default=0), 0, -1):
            ups = defaultdict(list)
            for c in [c for c in self.n if c[0] == level]:
                ups[(level - 1, c[1] >> 1, c[2] >> 1)].append(c)
            for up, kids in ups.items():
                boxes = np.stack([self.box[k] for k in kids])
                self.n[up] = sum(self.n[k] for k in kids)
                self.box[up] = np.concatenate([boxes[:, :5].min(0), boxes[:, 5:].max(0)])
                if self.n[up] <= leaf and not any(self.kids[k] for k in kids):
                    self.kids[up] = []
                    for k in kids:
                        del self.n[k], self.box[k], self.kids[k]
                else:
                    self.kids[up] = kids
        order = sorted((c for c in self.n if not self.kids[c]), key=lambda c: morton(*(np.array([x << (DEEP - c[0])]) for x in c[1:]))[0])
        self.chunks = [max(1, -(-self.n[c] // (4 * leaf))) for c in order]
        first = np.concatenate([[0], np.cumsum(self.chunks)]).astype(int)
        self.leaves = {c: range(first[k], first[k + 1]) for k, c in enumerate(order)}
        self.first, self.order = first[:-1], order
        self.starts = np.array([morton(*(np.array([x << (DEEP - c[0])]) for x in c[1:]))[0] for c in order], np.int64)

    def root(self):
        return (0, 0, 0) if self.n else None

    def arrays(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of the leaves, in Morton order: where each starts, its first chunk's number, its number of chunks."""
        return self.starts, self.first, np.array(self.chunks, np.int64)

    def under(self, node) -> list[int]:
        if not self.kids[node]:
            return list(self.leaves[node])
        return [x for k in self.kids[node] for x in self.under(k)]

    def lo(self, node):
        return self.box[node][:3]

    def hi(self, node):
        return self.box[node][5:8]


def morton(i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The bits of i and j in turn."""

    def spread(x):
        x = x.astype(np.uint64)
        for s, m in ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555)):
            x = (x | (x << np.uint64(s))) & np.uint64(m)
        return x

    return ((spread(i) << np.uint64(1)) | spread(j)).astype(np.int64)


def grid(lat: np.ndarray, lon: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    top = (1 << DEEP) - 1
    i = np.minimum(((lat + 90) / 180 * (1 << DEEP)).astype(np.int64), top)
    return i, np.minimum(((lon + 180) / 360 * (1 << DEEP)).astype(np.int64), top)


def _unions(names: list[str]) -> list[Column]:
    return [F.min(f"lo_{c}").alias(f"lo_{c}") for c in names] + [F.max(f"hi_{c}").alias(f"hi_{c}") for c in names]


def leaf_cells(points: DataFrame, leaf: int, most: int = 4_000_000) -> dict[tuple[int, int, int], tuple]:
    """(level, i, j) of the quadtree's leaves over (id, lat, lon): their number of points and their box.

    Spark counts the points four levels at a time, of heavy cells only, and
    sums cells up to the largest that hold ``leaf`` points at most before
    anything is sent: of each step at most four cells for each heavier cell
    above them reach the driver. With ``n`` points these are under
    ``16 * n / leaf`` a step, besides at most 256 of the first. RuntimeError
    beyond ``most``.
    """
    lat, lon = F.col("lat"), F.col("lon")
    top = (1 << DEEP) - 1
    deep = points.select(
        F.least(F.floor((lat + 90) / 180 * (1 << DEEP)), F.lit(top)).alias("i"), F.least(F.floor((lon + 180) / 360 * (1 << DEEP)), F.lit(top)).alias("j"), "lat", "lon",
        (F.cos(F.radians(lat)) * F.cos(F.radians(lon))).alias("x"), (F.cos(F.radians(lat)) * F.sin(F.radians(lon))).alias("y"), F.sin(F.radians(lat)).alias("z"),
    )
    names = ["x", "y", "z", "lat", "lon"]
    bounds = [f"{side}_{c}" for side in ("lo", "hi") for c in names]
    cells, heavy, above, spark = {}, None, 0, points.sparkSession
    for level in STEP:
        up = DEEP - level
        part = deep.withColumns({"i": F.shiftright("i", up), "j": F.shiftright("j", up)})
        if heavy is not None:
            some = spark.createDataFrame([c[1:] for c in heavy], "hi bigint, hj bigint")
            part = part.join(F.broadcast(some), (F.shiftright("i", level - above) == F.col("hi")) & (F.shiftright("j", level - above) == F.col("hj")), "left_semi")
        part = part.groupBy("i", "j").agg(F.count("*").alias("n"), *(F.min(c).alias(f"lo_{c}") for c in names), *(F.max(c).alias(f"hi_{c}") for c in names))
        # each cell's largest light ancestor under the heavy one becomes its leaf; none: itself
        steps = range(above + 1, level)
        for k in steps:
            w = Window.partitionBy(F.shiftright("i", level - k), F.shiftright("j", level - k))
            part = part.withColumn(f"n{k}", F.sum("n").over(w))
        held = F.coalesce(*(F.when(F.col(f"n{k}") <= leaf, F.lit(k)) for k in steps), F.lit(level)).alias("level")
        part = part.withColumn("level", held).withColumn("back", F.lit(level) - F.col("level"))
        part = part.select("level", F.expr("shiftright(i, back)").alias("i"), F.expr("shiftright(j, back)").alias("j"), "n", *bounds).groupBy("level", "i", "j").agg(F.sum("n").alias("n"), *_unions(names))
        rows = part.limit(most + 1).collect()
        if len(cells) + len(rows) > most:
            raise RuntimeError(f"the tree has more than {most} leaves; use a larger leaf")
        new = {(r["level"], r["i"], r["j"]): (r["n"], *(r[c] for c in bounds)) for r in rows}
        for c in heavy or []:
            del cells[c]
        cells |= new
        heavy = [c for c, v in new.items() if c[0] == level and v[0] > leaf and not all(lo == hi for lo, hi in zip(v[4:6], v[9:11]))]
        above = level
        if not heavy:
            break
    return cells


def leaf_pairs(a: Tree, b: Tree, km: float, same: bool) -> list[tuple[int, int]]:
    """Pairs of leaves that may hold points within ``km``; if both are one tree, each unordered pair once."""
    if not a.n or not b.n:
        return []
    far = chord(km) ** 2 * (1 + 1e-9) + 1e-30
    found, stack = [], [(a.root(), b.root())]
    while stack:
        p, q = stack.pop()
        near, _ = box_bounds(a.lo(p), a.hi(p), b.lo(q), b.hi(q))
        if near > far:
            continue
        if not a.kids[p] and not b.kids[q]:
            found += [(x, y) for x in a.leaves[p] for y in b.leaves[q] if not (same and p == q and x > y)]
        elif same and p == q:
            kids = a.kids[p]
            stack += [(k, m) for n, k in enumerate(kids) for m in kids[n:]]
        elif a.kids[p] and (not b.kids[q] or a.n[p] >= b.n[q]):
            stack += [(k, q) for k in a.kids[p]]
        else:
            stack += [(p, k) for k in b.kids[q]]
    return found


def leaf_numbers(tree_starts, tree_first, tree_chunks, lat, lon, salt) -> np.ndarray:
    """The number of each point's leaf; a crowded leaf's points are spread over its chunks by ``salt``."""
    at = np.searchsorted(tree_starts, morton(*grid(lat, lon)), side="right") - 1
    return tree_first[at] + salt % tree_chunks[at]


def _sender(shared, km: float):
    """Sends each point to the pairs of leaves its leaf is in, unless it is too far from the other leaf's box.

    ``shared`` broadcasts the tree's leaves and (begin, pair, side, box): of the
    leaf ``n`` the rows ``begin[n]:begin[n + 1]`` of pair, side and the other
    leaf's box.
    """
    far = chord(km) ** 2 * (1 + 1e-9) + 1e-30

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (starts, first, chunks), (begin, pair, side, box) = shared.value
        for b in batches:
            if not b.num_rows or len(begin) < 2:
                continue
            lat, lon = b.column(1).to_numpy(), b.column(2).to_numpy()
            leaf = leaf_numbers(starts, first, chunks, lat, lon, b.column(3).to_numpy())
            xyz = unit_vectors(lat, lon)
            order = np.argsort(leaf, kind="stable")
            cuts = np.flatnonzero(np.diff(leaf[order])) + 1
            went = []
            for rows in np.split(order, cuts):
                n = int(leaf[rows[0]])
                for k in range(begin[n], begin[n + 1]):
                    near, _ = box_bounds(xyz[rows], xyz[rows], box[k, :3], box[k, 3:])
                    go = rows[near <= far]
                    if len(go):
                        went.append((go, k))
                if sum(len(g) for g, _ in went) > 500_000:
                    yield sent(b, went, pair, side)
                    went = []
            if went:
                yield sent(b, went, pair, side)

    def sent(b, went, pair, side):
        rows, ks = np.concatenate([g for g, _ in went]), np.repeat([k for _, k in went], [len(g) for g, _ in went])
        take = pa.array(rows)
        return pa.RecordBatch.from_arrays([pa.array(pair[ks]), pa.array(side[ks]), *(b.column(i).take(take) for i in range(3))], schema=SENT)

    return send


def _sides(leaves: int, rows: list[tuple]) -> tuple:
    """(begin, pair, side, box) for ``_sender`` of (leaf, pair, side, lo, hi)."""
    of = np.array([r[0] for r in rows], np.int64)
    order = np.argsort(of, kind="stable")
    box = np.array([np.concatenate(r[3:]) for r in rows]).reshape(-1, 6)[order]
    begin = np.searchsorted(of[order], np.arange(leaves + 1))
    return begin, np.array([r[1] for r in rows], np.int64)[order], np.array([r[2] for r in rows], np.int8)[order], box


# ---- the finer trees within a task


class Fine:
    """A kd-tree over unit vectors: nodes of rows ``start:end`` of ``order``, their boxes and their two children (-1: none)."""

    def __init__(self, xyz: np.ndarray):
        self.order = np.arange(len(xyz))
        start, end, left, right, lo, hi = [0], [len(xyz)], [-1], [-1], [], []
        k = 0
        while k < len(start):
            s, e = start[k], end[k]
            part = xyz[self.order[s:e]]
            a, b = part.min(0), part.max(0)
            lo.append(a)
            hi.append(b)
            if e - s > FINE and (b > a).any():
                axis, mid = int(np.argmax(b - a)), (e - s) // 2
                self.order[s:e] = self.order[s:e][np.argpartition(part[:, axis], mid)]
                left[k], right[k] = len(start), len(start) + 1
                start += [s, s + mid]
                end += [s + mid, e]
                left += [-1, -1]
                right += [-1, -1]
            k += 1
        self.start, self.end, self.left, self.right = map(np.array, (start, end, left, right))
        self.lo, self.hi = np.array(lo), np.array(hi)


def near_rows(lat1, lon1, lat2, lon2, km: float, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows within ``km``, in pieces; ``same``: of one set, each unordered pair of two rows once."""
    a_xyz = unit_vectors(lat1, lon1)
    a = Fine(a_xyz)
    b = a if same else Fine(unit_vectors(lat2, lon2))
    t = chord(km) ** 2
    p, q = np.array([0]), np.array([0])
    while len(p):
        near, wide = box_bounds(a.lo[p], a.hi[p], b.lo[q], b.hi[q])
        keep = near <= t * (1 + 1e-9) + 1e-30
        sure = keep & (wide <= t * (1 - 1e-9))
        leaf_a, leaf_b = a.left[p] < 0, b.left[q] < 0
        ends = keep & (sure | (leaf_a & leaf_b))
        for k in np.flatnonzero(ends):
            yield from _block(a, b, p[k], q[k], bool(sure[k]), lat1, lon1, lat2, lon2, km, same)
        go = keep & ~ends
        p, q, leaf_a, leaf_b = p[go], q[go], leaf_a[go], leaf_b[go]
        twin = same & (p == q)
        nexts = [(a.left[p[twin]], b.left[q[twin]]), (a.left[p[twin]], b.right[q[twin]]), (a.right[p[twin]], b.right[q[twin]])]
        open_a = ~twin & ~leaf_a & (leaf_b | (a.end[p] - a.start[p] >= b.end[q] - b.start[q]))
        open_b = ~twin & ~open_a
        nexts += [(kid[p[open_a]], q[open_a]) for kid in (a.left, a.right)] + [(p[open_b], kid[q[open_b]]) for kid in (b.left, b.right)]
        p, q = (np.concatenate(x) for x in zip(*nexts))


def _block(a: Fine, b: Fine, p: int, q: int, sure: bool, lat1, lon1, lat2, lon2, km: float, same: bool):
    """The near pairs of two nodes: all of them if it is sure, else those measured; a million at a time."""
    rows_a, rows_b = a.order[a.start[p] : a.end[p]], b.order[b.start[q] : b.end[q]]
    step = max(1, 1_000_000 // max(1, len(rows_b)))
    for s in range(0, len(rows_a), step):
        part = rows_a[s : s + step]
        x, y = np.repeat(part, len(rows_b)), np.tile(rows_b, len(part))
        if same and p == q:
            one = np.repeat(np.arange(s, s + len(part)), len(rows_b)) < np.tile(np.arange(len(rows_b)), len(part))
            x, y = x[one], y[one]
        if not sure:
            ok = great_circle_km(lat1[x], lon1[x], lat2[y], lon2[y]) <= km
            x, y = x[ok], y[ok]
        if len(x):
            yield x, y


def _groups(batches: Iterator[pa.RecordBatch]):
    """The rows of a partition by their first column: arrays of the whole, and for each value the rows of side 0 and 1."""
    kept = [b for b in batches if b.num_rows]
    if not kept:
        return None, []
    t = pa.Table.from_batches(kept).combine_chunks()
    pair, side = t.column(0).to_numpy(), t.column(1).to_numpy()
    order = np.lexsort((side, pair))
    groups = []
    for rows in np.split(order, np.flatnonzero(np.diff(pair[order])) + 1):
        cut = int((side[rows] == 0).sum())
        groups.append((rows[:cut], rows[cut:]))
    return t, groups


def _joiner(selfs: np.ndarray, km: float):
    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t, groups = _groups(batches)
        if t is None:
            return
        pair, ids, lat, lon = t.column(0).to_numpy(), t.column(2).combine_chunks(), t.column(3).to_numpy(), t.column(4).to_numpy()
        for r0, r1 in groups:
            same = len(r0) > 0 and bool(np.isin(pair[r0[0]], selfs))
            if same:
                r1 = r0
            if len(r0) and len(r1):
                for x, y in near_rows(lat[r0], lon[r0], lat[r1], lon[r1], km, same):
                    yield pa.RecordBatch.from_arrays([ids.take(pa.array(r0[x])), ids.take(pa.array(r1[y]))], schema=OUT)

    return join


def near_pairs(left: DataFrame, right: DataFrame | None, km: float, *, leaf: int = LEAF, most_pairs: int = 500_000, left_cells: dict | None = None) -> DataFrame:
    """(a, b): pairs of points at most ``km`` apart, from tables of (id, lat, lon).

    With ``right`` None, pairs of two different rows of ``left``, each
    unordered pair once; ids should then be unique. Rows without an id or
    without a location are left out (see ``located``); an empty side gives no
    rows; extra columns are ignored; an id with several locations may come out
    several times with the same partner. ``leaf`` points or so make a task's
    leaf; if more than ``most_pairs`` pairs of leaves remain, which happens only
    where the distance spans many leaves, leaves are put together by fours. The
    trees are counted when the function is called; ``left_cells`` may give those
    of ``left`` (see ``leaf_cells``), with the same ``leaf``.
    """
    spark = left.sparkSession
    salt = F.pmod(F.xxhash64("id"), F.lit(1 << 30)).alias("salt")
    sides = [d.where(located(F.col("lat"), F.col("lon")) & F.col("id").isNotNull()).select(F.col("id").cast("string").alias("id"), F.col("lat").cast("double").alias("lat"), F.col("lon").cast("double").alias("lon")).select("*", salt) for d in (left, right) if d is not None]
    cells = [left_cells if left_cells is not None and n == 0 else leaf_cells(d, leaf) for n, d in enumerate(sides)]
    while True:
        trees = [Tree(c, leaf) for c in cells]  # leaves of the same cells, put together if need be
        a, b = trees[0], trees[-1]
        pairs = leaf_pairs(a, b, km, right is None)
        if len(pairs) <= most_pairs:
            break
        leaf *= 4
    box_a = {x: (a.lo(c), a.hi(c)) for c, r in a.leaves.items() for x in r}
    box_b = {x: (b.lo(c), b.hi(c)) for c, r in b.leaves.items() for x in r}
    to = [[], []]
    for n, (x, y) in enumerate(pairs):
        to[0].append((x, n, 0, *box_b[y]))
        if right is not None:
            to[1].append((y, n, 1, *box_a[x]))
        elif x != y:
            to[0].append((y, n, 1, *box_a[x]))
    selfs = np.array([n for n, (x, y) in enumerate(pairs) if right is None and x == y], np.int64)
    schema = "pair bigint, side tinyint, id string, lat double, lon double"
    shared = [spark.sparkContext.broadcast((t.arrays(), _sides(sum(t.chunks), s))) for t, s in zip(trees, to)]
    sent = [d.mapInArrow(_sender(s, km), schema) for d, s in zip(sides, shared)]
    both = sent[0] if right is None else sent[0].unionByName(sent[1])
    points = sum(t.n[t.root()] for t in trees if t.n)
    parts = max(shuffle_partitions(spark), min(len(pairs), -(-points // (4 * leaf))))
    return both.repartition(parts, "pair").mapInArrow(_joiner(selfs, km), "a string, b string")


def near_classes(points: DataFrame, km: float, *, leaf: int = LEAF) -> DataFrame:
    """(kind, a, b): near points without the pairs within a crowd.

    Points (id, lat, lon) at exactly one place form a class, named by its
    smallest id: ``member`` rows give each id ``a`` its class ``b``; ``near``
    rows give the pairs of classes at most ``km`` apart, ``a`` the smaller. Two
    points are near each other if and only if their classes are the same or
    near, so nothing is lost and n points at one spot give n rows. Rows without
    an id or a location are left out.
    """
    pts = checkpointed(points.where(located(F.col("lat"), F.col("lon")) & F.col("id").isNotNull()).select(F.col("id").cast("string").alias("id"), (F.col("lat").cast("double") + 0.0).alias("lat"), (F.col("lon").cast("double") + 0.0).alias("lon")))
    spots = checkpointed(pts.groupBy("lat", "lon").agg(F.min("id").alias("id")))
    members = pts.join(spots.withColumnRenamed("id", "b"), ["lat", "lon"]).select(F.lit("member").alias("kind"), F.col("id").alias("a"), "b").distinct()
    near = near_pairs(spots, None, km, leaf=leaf)
    return members.unionByName(near.select(F.lit("near").alias("kind"), F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")))


# ---- regions


def ring(outline) -> np.ndarray | None:
    """The corners (lon, lat) of a polygon, not closed; null corners are left out, and under three make no region."""
    xy = [(p["lon"], p["lat"]) for p in outline or [] if p is not None and p["lon"] is not None and p["lat"] is not None]
    if len(xy) > 1 and xy[0] == xy[-1]:
        xy.pop()
    return np.array(xy, float) if len(xy) > 2 else None


def inside(lon: np.ndarray, lat: np.ndarray, corners: np.ndarray) -> np.ndarray:
    """Even-odd rule, in the plane of lon and lat."""
    x1, y1 = corners[:, 0], corners[:, 1]
    x2, y2 = np.roll(x1, -1), np.roll(y1, -1)
    cross = (y1[:, None] > lat) != (y2[:, None] > lat)
    with np.errstate(divide="ignore", invalid="ignore"):
        at = (x2 - x1)[:, None] * (lat - y1[:, None]) / (y2 - y1)[:, None] + x1[:, None]
    return (cross & (lon < at)).sum(0) % 2 == 1


def touches(lo: np.ndarray, hi: np.ndarray, corners: np.ndarray) -> bool:
    """Whether an edge of the polygon may meet the box (lon, lat): no axis, nor the edge's own normal, parts them."""
    p, q = corners, np.roll(corners, -1, 0)
    mid, half = (lo + hi) / 2, (hi - lo) / 2 + 1e-12
    apart = (np.minimum(p, q) > mid + half).any(1) | (np.maximum(p, q) < mid - half).any(1)
    d = q - p
    off = np.abs(d[:, 0] * (mid[1] - p[:, 1]) - d[:, 1] * (mid[0] - p[:, 0]))
    apart |= off > np.abs(d[:, 0]) * half[1] + np.abs(d[:, 1]) * half[0] + 1e-12
    return bool((~apart).any())


def region_state(lo: np.ndarray, hi: np.ndarray, corners: np.ndarray) -> int:
    """Of a box of points against a polygon: 0 none is inside, 2 all are, 1 not known."""
    if (corners.max(0) < lo).any() or (corners.min(0) > hi).any():
        return 0
    if touches(lo, hi, corners):
        return 1
    return 2 * int(inside(np.array([lo[0]]), np.array([lo[1]]), corners)[0])


def _region_sender(shared):
    """Sends each polygon down the tree of points, which is broadcast: to the leaves it may meet, with its state there."""

    def send(batches):
        tree = shared.value
        kids, leaves, root = tree.kids, tree.leaves, tree.root()
        boxes = {c: (b[[4, 3]], b[[9, 8]]) for c, b in tree.box.items()}
        for b in batches:
            rows = []
            for r in b.to_pylist():
                corners = ring(r["outline"])
                stack = [] if corners is None or root is None else [(root, 1)]
                while stack:
                    c, state = stack.pop()
                    state = state if state == 2 else region_state(*boxes[c], corners)
                    if state and kids[c]:
                        stack += [(k, state) for k in kids[c]]
                    elif state:
                        rows += [(x, state, r["id"], corners.ravel().tolist()) for x in leaves[c]]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(map(list, zip(*rows)), (pa.int64(), pa.int8(), pa.string(), pa.list_(pa.float64())))], names=["pair", "side", "id", "corners"])

    return send


def _region_joiner():
    def join(batches):
        kept = [b for b in batches if b.num_rows]
        if not kept:
            return
        t = pa.Table.from_batches(kept).combine_chunks()
        pair, side, ids = t.column(0).to_numpy(), t.column(1).to_numpy(), t.column(2).combine_chunks()
        lat, lon, corners = t.column(3).to_numpy(zero_copy_only=False), t.column(4).to_numpy(zero_copy_only=False), t.column(5).combine_chunks()
        order = np.lexsort((side, pair))
        for rows in np.split(order, np.flatnonzero(np.diff(pair[order])) + 1):
            cut = int((side[rows] == 0).sum())
            pts, regions = rows[:cut], rows[cut:]
            if not len(pts) or not len(regions):
                continue
            fine = None
            for r in regions:
                if side[r] == 2:
                    hits = [pts]
                else:
                    poly = np.array(corners[int(r)].as_py(), float).reshape(-1, 2)
                    fine = fine or Plane(lon[pts], lat[pts])
                    hits = [pts[h] for h in fine.within(poly)]
                for h in hits:
                    if len(h):
                        yield pa.RecordBatch.from_arrays([ids.take(pa.array(h)), ids.take(pa.array(np.full(len(h), r)))], schema=OUT)

    return join


class Plane:
    """A kd-tree over (lon, lat), to refine polygons against."""

    def __init__(self, lon: np.ndarray, lat: np.ndarray):
        self.xy = np.stack([lon, lat], 1)
        self.tree = Fine(self.xy)

    def within(self, poly: np.ndarray) -> Iterator[np.ndarray]:
        t, stack = self.tree, [0]
        while stack:
            k = stack.pop()
            state = region_state(t.lo[k], t.hi[k], poly)
            rows = t.order[t.start[k] : t.end[k]]
            if state == 2:
                yield rows
            elif state == 1 and t.left[k] >= 0:
                stack += [t.left[k], t.right[k]]
            elif state == 1:
                yield rows[inside(self.xy[rows, 0], self.xy[rows, 1], poly)]


def containing_regions(points: DataFrame, regions: DataFrame, *, leaf: int = LEAF, cells: dict | None = None) -> DataFrame:
    """(a, b): each point (id, lat, lon) and each region (id, outline) that holds it.

    An outline is an array of (lon, lat) corners in either direction, closed or
    not, with edges straight in lon and lat; regions may overlap. Rows without
    an id, points without a location, outlines of under three corners give
    nothing. Points on an edge may fall to either side.
    """
    spark = points.sparkSession
    pts = points.where(located(F.col("lat"), F.col("lon")) & F.col("id").isNotNull()).select(F.col("id").cast("string").alias("id"), F.col("lat").cast("double").alias("lat"), F.col("lon").cast("double").alias("lon"), F.pmod(F.xxhash64("id"), F.lit(1 << 30)).alias("salt"))
    tree = Tree(leaf_cells(pts, leaf) if cells is None else cells, leaf)
    shared = spark.sparkContext.broadcast(tree)

    def place(batches):
        starts, first, chunks = shared.value.arrays()
        for b in batches:
            if b.num_rows:
                n = leaf_numbers(starts, first, chunks, b.column(1).to_numpy(), b.column(2).to_numpy(), b.column(3).to_numpy())
                yield pa.RecordBatch.from_arrays([pa.array(n.astype(np.int64)), pa.array(np.zeros(len(n), np.int8)), *b.columns[:3]], schema=SENT)

    placed = pts.mapInArrow(place, "pair bigint, side tinyint, id string, lat double, lon double").withColumn("corners", F.lit(None).cast("array<double>"))
    sent = regions.where(F.col("id").isNotNull()).select(F.col("id").cast("string").alias("id"), "outline").mapInArrow(_region_sender(shared), "pair bigint, side tinyint, id string, corners array<double>")
    sent = sent.select("pair", "side", "id", F.lit(None).cast("double").alias("lat"), F.lit(None).cast("double").alias("lon"), "corners")
    parts = max(shuffle_partitions(spark), -(-(tree.n[tree.root()] if tree.n else 0) // (4 * leaf)))
    return placed.unionByName(sent).repartition(parts, "pair").mapInArrow(_region_joiner(), "a string, b string")


def findspots(keepers: DataFrame) -> DataFrame:
    """(id, lat, lon): of each stone the location recorded last, if it has one; ties take the greater (lat, lon)."""
    last = keepers.where(F.length("ogham_id") > 0).groupBy(F.col("ogham_id").alias("id")).agg(F.max(F.struct("recorded", F.col("findspot_lat").alias("lat"), F.col("findspot_lon").alias("lon"))).alias("s"))
    return last.select("id", "s.lat", "s.lon").where(located(F.col("lat"), F.col("lon")))


def institutions(keepers: DataFrame) -> DataFrame:
    """(id, lat, lon): every location recorded for each institution."""
    return keepers.where((F.length("keeper_qid") > 0) & located(F.col("keeper_lat"), F.col("keeper_lon"))).select(F.col("keeper_qid").alias("id"), F.col("keeper_lat").alias("lat"), F.col("keeper_lon").alias("lon")).distinct()


def neighbourhood(keepers: DataFrame, areas: DataFrame, *, stone_km: float = 0.1, keeper_km: float = 3.0) -> DataFrame:
    """(kind, id_a, id_b), id_a the smaller: near findspots, institutions near a findspot, areas around it."""
    stones = checkpointed(findspots(keepers))
    cells = leaf_cells(stones, LEAF)
    kinds = {
        "findspot": near_pairs(stones, None, stone_km, left_cells=cells),
        "keeper": near_pairs(stones, checkpointed(institutions(keepers)), keeper_km, left_cells=cells).distinct(),
        "area": containing_regions(stones, areas.select(F.col("area_id").alias("id"), "outline"), cells=cells).distinct(),
    }
    out = None
    for kind, df in kinds.items():
        rows = df.select(F.lit(kind).alias("kind"), F.least("a", "b").alias("id_a"), F.greatest("a", "b").alias("id_b"))
        out = rows if out is None else out.unionByName(rows)
    return out
