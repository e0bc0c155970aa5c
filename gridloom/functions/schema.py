"""Shapes as Spark types, and checked literals of them."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import types as T

POINT = T.StructType([T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType())])
RECT = T.StructType([T.StructField(c, T.DoubleType()) for c in ("x0", "y0", "x1", "y1")])
CIRCLE = T.StructType([T.StructField(c, T.DoubleType()) for c in ("cx", "cy", "r")])
EDGE = T.StructType([T.StructField(c, T.DoubleType()) for c in ("x1", "y1", "x2", "y2")])
RING = T.ArrayType(POINT)
KNOT = T.StructType([T.StructField("key", T.DoubleType()), T.StructField("pos", T.DoubleType())])


@dataclass(frozen=True)
class Point:
    x: float
    y: float

    def __post_init__(self):
        if math.isnan(self.x) or math.isnan(self.y):
            raise ValueError("a point needs numbers")

    def __lt__(self, other: Point) -> bool:
        return (self.x, self.y) < (other.x, other.y)

    def __add__(self, other: Point) -> Point:
        return Point(self.x + other.x, self.y + other.y)

    def __sub__(self, other: Point) -> Point:
        return Point(self.x - other.x, self.y - other.y)

    def __str__(self) -> str:
        return f"({self.x}|{self.y})"

    def envelope(self) -> Rect:
        return Rect(self.x, self.y, self.x, self.y)


@dataclass(frozen=True)
class Rect:
    """Closed on all four sides; inverted rectangles are refused."""

    x0: float
    y0: float
    x1: float
    y1: float

    def __post_init__(self):
        if not (self.x0 <= self.x1 and self.y0 <= self.y1):
            raise ValueError(f"inverted rectangle: {self.x0}, {self.y0}, {self.x1}, {self.y1}")

    @classmethod
    def of(cls, a: Point, b: Point) -> Rect:
        return cls(a.x, a.y, b.x, b.y)

    @property
    def area(self) -> float:
        return (self.x1 - self.x0) * (self.y1 - self.y0)

    def intersects(self, o: Rect) -> bool:
        return self.x0 <= o.x1 and self.x1 >= o.x0 and self.y0 <= o.y1 and self.y1 >= o.y0

    def contains(self, o: Rect | Point) -> bool:
        o = o.envelope() if isinstance(o, Point) else o
        return self.x0 <= o.x0 and o.x1 <= self.x1 and self.y0 <= o.y0 and o.y1 <= self.y1

    def __str__(self) -> str:
        return f"({self.x0}|{self.y0}) ({self.x1}|{self.y1})"


@dataclass(frozen=True)
class Circle:
    cx: float
    cy: float
    r: float

    def bounding_box(self) -> Rect:
        return Rect(self.cx - self.r, self.cy - self.r, self.cx + self.r, self.cy + self.r)

    def __str__(self) -> str:
        return f"({self.cx}|{self.cy}) r={self.r}"


@dataclass(frozen=True)
class Edge:
    a: Point
    b: Point

    def __str__(self) -> str:
        return f"{self.a}-{self.b}"


@dataclass(frozen=True)
class TimedPoint:
    """A point with a payload, usually a time."""

    point: Point
    value: object

    def __str__(self) -> str:
        return f"{self.point}@{self.value}"
