"""Spatial partitioners: each adds a column pid and describes its cells.

fixgrid and adaptive are formulas over the bounding box.  kdb, quad and rtree
build a tree on the driver from a seeded sample of bounded size, which grows with the
number of leaves; a small tree becomes one nested CASE over the coordinates, a larger
one a chain of short searches in literal arrays (see _searched), so that placing a
point is a narrow expression at any number of leaves.  Cells are half open and cover the whole plane; a point has
exactly one.  Rows without coordinates get no pid and are left out.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.functions.geometry import is_point
from gridloom.functions.schema import Rect
from gridloom.operators.quadtree import QuadTree, Zone
from gridloom.operators.stats import Stats, stats

SAMPLE = 20_000
LEAF_SAMPLE, MOST_SAMPLE = 20, 2_000_000  # sampled points to a leaf, and in all
INLINE_LEAVES = 256  # of a tree that becomes one CASE; larger ones are searched in arrays
METHODS = ("fixgrid", "adaptive", "kdb", "quad", "rtree")
INF = math.inf


@dataclass(frozen=True)
class Cell:
    pid: int
    x0: float
    y0: float
    x1: float
    y1: float
    lineage: str = ""


@dataclass
class Layout:
    """How points are placed: an expression for pid, and the cells if they are rectangles."""

    method: str
    n: int
    pid: Column
    cells: list[Cell]

    def cells_frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(c.pid, c.x0, c.y0, c.x1, c.y1, c.lineage) for c in self.cells], "pid int, x0 double, y0 double, x1 double, y1 double, lineage string")


def strip_cell(x: Column, x0: float, step: float) -> Column:
    return F.floor((x - F.lit(x0)) / F.lit(step)).cast("long") if step > 0 else F.lit(0).cast("long")


def fixgrid(s: Stats, x: str, n: int = 100, contiguous: bool = False) -> Layout:
    """1,000 strips along x, dealt to n partitions in turn, or in runs if contiguous (prunes better)."""
    step = (s.box.x1 - s.box.x0) / 1000
    cell = strip_cell(F.col(x), s.box.x0, step)
    pid = F.least(F.floor(cell * n / 1000), F.lit(n - 1)) if contiguous else F.pmod(cell, F.lit(n))
    return Layout("fixgrid", n, pid.cast("int"), [])


def adaptive(s: Stats, x: str, n: int = 100, contiguous: bool = False) -> Layout:
    """Equal strips along x, as many as rows to a partition; dealt in turn, or in runs."""
    strips = float(s.n) / min(n, s.n)
    cell = strip_cell(F.col(x), s.box.x0, (s.box.x1 - s.box.x0) / strips)
    pid = F.least(F.floor(cell * n / strips), F.lit(n - 1)) if contiguous else F.pmod(cell, F.lit(n))
    return Layout("adaptive", n, pid.cast("int"), [])


def sample_points(points: DataFrame, total: int, x: str, y: str, seed: int, size: int = SAMPLE) -> list[tuple[float, float]]:
    """About size points, and never more than twice that."""
    rows = points.select(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
    if total > size:
        rows = rows.sample(False, size / total, seed)
    return [(r["x"], r["y"]) for r in rows.limit(2 * size).collect()]


def _case(tree, x: Column, y: Column) -> Column:
    """A tree of (axis, value, below, above) and numbers as a nested CASE."""
    if isinstance(tree, int):
        return F.lit(tree)
    axis, value, below, above = tree
    return F.when((x if axis == 0 else y) < F.lit(value), _case(below, x, y)).otherwise(_case(above, x, y))


def _searched(tree, x: Column, y: Column) -> Column:
    """A tree as arrays of axes, values and children, walked from the root by as many steps as it is deep.

    The arrays are literals, so the plan holds a few nodes at any number of leaves, and no generated
    method grows with the tree.  Inner nodes are numbered from 0, a leaf p is -1 - p.
    """
    axes, values, below, above, depth = [], [], [], [], 0

    def number(node, deep):
        nonlocal depth
        if isinstance(node, int):
            depth = max(depth, deep)
            return -1 - node
        k = len(axes)
        axes.append(node[0])
        values.append(float(node[1]))
        below.append(0)
        above.append(0)
        below[k], above[k] = number(node[2], deep + 1), number(node[3], deep + 1)
        return k

    root = number(tree, 0)
    if root < 0:
        return F.lit(-1 - root)
    literal = lambda items, kind: F.from_json(F.lit(str(items)), f"array<{kind}>")
    nodes = F.arrays_zip(literal(axes, "int").alias("axis"), literal(values, "double").alias("value"), literal(below, "int").alias("below"), literal(above, "int").alias("above"))

    def step(at: Column, _: Column) -> Column:
        node = F.element_at(nodes, at + 1)
        turn = F.when(F.when(node["axis"] == 0, x).otherwise(y) < node["value"], node["below"]).otherwise(node["above"])
        return F.when(at < 0, at).otherwise(turn)

    return -1 - F.aggregate(F.sequence(F.lit(1), F.lit(depth)), F.lit(0), step)


def kdb_tree(sample: list[tuple[float, float]], n: int):
    """Median splits of the wider side until there are n leaves; a run of equal values is not split."""
    cells: list[Cell] = []

    def build(points, want, box):
        if want > 1 and len(points) > 1:
            spans = [max(p[a] for p in points) - min(p[a] for p in points) for a in (0, 1)]
            for axis in sorted((0, 1), key=lambda a: -spans[a]):
                if spans[axis] <= 0:
                    continue
                values = sorted(p[axis] for p in points)
                low = want // 2
                at = values[min(len(values) - 1, len(values) * low // want)]
                if at == values[0]:
                    at = next(v for v in values if v > at)
                below, above = [p for p in points if p[axis] < at], [p for p in points if p[axis] >= at]
                b1, b2 = list(box), list(box)
                b1[2 + axis], b2[axis] = at, at
                return (axis, at, build(below, low, b1), build(above, want - low, b2))
        cells.append(Cell(len(cells), *box))
        return len(cells) - 1

    return build(sample, max(1, n), [-INF, -INF, INF, INF]), cells


def str_tree(sample: list[tuple[float, float]], n: int):
    """Sort-tile-recursive packing: strips of equal count along x, tiles of equal count along y in each."""
    strips = max(1, math.ceil(math.sqrt(n)))
    rows = max(1, math.ceil(n / strips))
    cells: list[Cell] = []

    def cuts(values, k):
        values = sorted(values)
        return sorted({values[len(values) * i // k] for i in range(1, k)} - {values[0]}) if values else []

    def chain(axis, at, leaves):
        """Binary search over cuts."""
        if not at:
            return leaves[0]
        m = len(at) // 2
        return (axis, at[m], chain(axis, at[:m], leaves[: m + 1]), chain(axis, at[m + 1 :], leaves[m + 1 :]))

    xs = cuts([p[0] for p in sample], strips)
    columns = []
    for lo, hi in zip([-INF, *xs], [*xs, INF], strict=True):
        ys = cuts([p[1] for p in sample if lo <= p[0] < hi], rows)
        tiles = []
        for a, b in zip([-INF, *ys], [*ys, INF], strict=True):
            tiles.append(len(cells))
            cells.append(Cell(len(cells), lo, a, hi, b))
        columns.append(chain(1, ys, tiles))
    return chain(0, xs, columns), cells


def quad_tree(sample: list[tuple[float, float]], box: Rect, n: int):
    tree = QuadTree(box, max(1, len(sample) // max(1, n)), max_depth=max(1, min(n, 24)))
    for p in sample:
        tree.insert(*p)
    tree.drop_points()
    tree.number()

    def build(z: Zone):
        if z.is_leaf:
            return z.pid
        mx, my = z.middle
        nw, ne, sw, se = map(build, z.children)
        return (1, my, (0, mx, sw, se), (0, mx, nw, ne))

    cells = [Cell(z.pid, z.box.x0, z.box.y0, z.box.x1, z.box.y1, z.lineage) for z in tree.leaves()]
    return build(tree.root), cells


def layout(points: DataFrame, method: str, n: int = 100, x: str = "x", y: str = "y", seed: int = 42, contiguous: bool = False, known: Stats | None = None) -> Layout:
    if method not in METHODS:
        raise ValueError(f"method is one of {METHODS}, not {method!r}")
    if n < 1:
        raise ValueError("at least one partition is needed")
    points = points.where(is_point(x, y))
    s = known or stats(points, x, y)
    if not s.n:
        return Layout(method, 0, F.lit(0), [])
    if method in ("fixgrid", "adaptive"):
        return (fixgrid if method == "fixgrid" else adaptive)(s, x, n, contiguous)
    sample = sample_points(points, s.n, x, y, seed, min(MOST_SAMPLE, max(SAMPLE, LEAF_SAMPLE * n)))
    tree, cells = quad_tree(sample, s.box, n) if method == "quad" else (kdb_tree if method == "kdb" else str_tree)(sample, n)
    place = _case if len(cells) <= INLINE_LEAVES else _searched
    return Layout(method, len(cells), place(tree, F.col(x).cast("double"), F.col(y).cast("double")).cast("int"), cells)


def with_pid(points: DataFrame, method: str, n: int = 100, x: str = "x", y: str = "y", seed: int = 42, contiguous: bool = False) -> DataFrame:
    """points with a pid column, in place: no shuffle yet."""
    return points.where(is_point(x, y)).withColumn("pid", layout(points, method, n, x, y, seed, contiguous).pid)


def partition_by(points: DataFrame, method: str, n: int = 100, x: str = "x", y: str = "y", seed: int = 42, contiguous: bool = False) -> DataFrame:
    """points dealt by pid."""
    return with_pid(points, method, n, x, y, seed, contiguous).repartition("pid")


def grid_cell_id(x: str, y: str, s: Stats, depth: int, pad: float = 0.01) -> Column:
    """Row-major cell number of a regular quadtree of a given depth; the box is padded on its upper sides."""
    k = 1 << depth
    cx = F.floor((F.col(x) - F.lit(s.box.x0)) / F.lit(s.box.x1 + pad - s.box.x0) * k)
    cy = F.floor((F.col(y) - F.lit(s.box.y0)) / F.lit(s.box.y1 + pad - s.box.y0) * k)
    return (cy * k + cx).cast("long")
