"""A region quadtree on the driver, grown from a bounded sample of points."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

from gridloom.functions.schema import Rect


@dataclass
class Zone:
    """A node: its closed box, depth, path digits from the root, held points and children."""

    box: Rect
    depth: int = 0
    lineage: str = ""
    points: list[tuple[float, float]] = field(default_factory=list)
    children: list[Zone] = field(default_factory=list)
    pid: int | None = None

    @property
    def is_leaf(self) -> bool:
        return not self.children

    @property
    def middle(self) -> tuple[float, float]:
        return (self.box.x0 + self.box.x1) / 2, (self.box.y0 + self.box.y1) / 2

    def split(self) -> None:
        """Quarters in the order NW, NE, SW, SE (digits 0 to 3)."""
        b, (mx, my) = self.box, self.middle
        quarters = (Rect(b.x0, my, mx, b.y1), Rect(mx, my, b.x1, b.y1), Rect(b.x0, b.y0, mx, my), Rect(mx, b.y0, b.x1, my))
        self.children = [Zone(q, self.depth + 1, self.lineage + str(i)) for i, q in enumerate(quarters)]
        held, self.points = self.points, []
        for p in held:
            self.child_of(*p).points.append(p)

    def child_of(self, x: float, y: float) -> Zone:
        """Half open: the middle lines belong to the east and the north."""
        mx, my = self.middle
        return self.children[(0 if y >= my else 2) + (1 if x >= mx else 0)]


class QuadTree:
    def __init__(self, box: Rect, max_items: int = 5, max_depth: int = 10, min_depth: int = 0):
        self.max_items, self.max_depth = max(1, max_items), max_depth
        self.root = Zone(box)
        self.grow(min_depth)

    def grow(self, depth: int) -> None:
        """Splits every leaf above depth."""
        todo = [self.root]
        while todo:
            z = todo.pop()
            if z.depth < depth:
                if z.is_leaf:
                    z.split()
                todo += z.children

    def leaf(self, x: float, y: float) -> Zone:
        z = self.root
        while z.children:
            z = z.child_of(x, y)
        return z

    def insert(self, x: float, y: float) -> None:
        z = self.leaf(x, y)
        z.points.append((x, y))
        while len(z.points) > self.max_items and z.depth < self.max_depth and len(set(z.points)) > 1:
            z.split()
            z = max(z.children, key=lambda c: len(c.points))

    def drop_points(self) -> None:
        self.walk(lambda z: z.points.clear())

    def points_on_path(self, x: float, y: float) -> list[tuple[float, float]]:
        z, out = self.root, []
        while True:
            out += z.points
            if z.is_leaf:
                return out
            z = z.child_of(x, y)

    def zones(self) -> Iterator[Zone]:
        """All nodes, parents first."""
        todo = [self.root]
        while todo:
            z = todo.pop()
            yield z
            todo += reversed(z.children)

    def walk(self, visit: Callable[[Zone], object]) -> None:
        for z in list(self.zones()):
            visit(z)

    def leaves(self) -> list[Zone]:
        return [z for z in self.zones() if z.is_leaf]

    def zone_at(self, x: float, y: float, depth: int | None = None) -> Zone:
        """The leaf of a point, or its ancestor at depth; outside the tree's box is an error."""
        b = self.root.box
        if not (b.x0 <= x <= b.x1 and b.y0 <= y <= b.y1):
            raise ValueError(f"({x}, {y}) is outside the tree")
        z = self.root
        while z.children and (depth is None or z.depth < depth):
            z = z.child_of(x, y)
        return z

    def find(self, rect: Rect) -> list[Zone]:
        """Leaves that meet a closed rectangle."""
        out, todo = [], [self.root]
        while todo:
            z = todo.pop()
            if z.box.intersects(rect):
                if z.is_leaf:
                    out.append(z)
                todo += reversed(z.children)
        return out

    def number(self) -> int:
        """Numbers the leaves in order; how many there are."""
        leaves = self.leaves()
        for i, z in enumerate(leaves):
            z.pid = i
        return len(leaves)
