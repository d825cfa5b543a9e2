"""Boxes, polygons and hashes of small images as column expressions. A polygon is an array of [x, y]."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def xs(polygon: Column) -> Column:
    return F.transform(polygon, lambda p: p[0])


def ys(polygon: Column) -> Column:
    return F.transform(polygon, lambda p: p[1])


def mean(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x) / F.size(values)


def box(polygon: Column) -> Column:
    """struct<x0, y0, x1, y1> around a polygon."""
    return F.struct(F.array_min(xs(polygon)).alias("x0"), F.array_min(ys(polygon)).alias("y0"), F.array_max(xs(polygon)).alias("x1"), F.array_max(ys(polygon)).alias("y1"))


def text_height(polygon: Column) -> Column:
    """The shorter mean of two opposite edges of a quadrilateral, at least 1."""

    def edge(a: int, b: int) -> Column:
        return F.sqrt(F.pow(polygon[b][0] - polygon[a][0], 2) + F.pow(polygon[b][1] - polygon[a][1], 2))

    return F.greatest(F.lit(1.0), F.least((edge(0, 1) + edge(2, 3)) / 2, (edge(1, 2) + edge(3, 0)) / 2))


def area(polygon: Column) -> Column:
    """Shoelace area."""
    onward = F.concat(F.slice(polygon, 2, F.size(polygon)), F.slice(polygon, 1, 1))
    return F.abs(F.aggregate(F.zip_with(polygon, onward, lambda a, b: a[0] * b[1] - b[0] * a[1]), F.lit(0.0), lambda s, x: s + x)) / 2


def order_quad(polygon: Column) -> Column:
    """Corners clockwise on the page from the top left: by angle around the centre, from the least x + y (then y, then x)."""
    cx, cy = mean(xs(polygon)), mean(ys(polygon))
    around = F.transform(F.array_sort(F.transform(polygon, lambda p: F.struct(F.atan2(p[1] - cy, p[0] - cx).alias("a"), p[0].alias("x"), p[1].alias("y")))), lambda s: F.struct((s["x"] + s["y"]).alias("s"), s["y"].alias("y"), s["x"].alias("x")))
    start = F.array_position(around, F.array_min(around)).cast("int")
    turned = F.concat(F.slice(around, start, F.size(around)), F.slice(around, 1, start - 1))
    return F.transform(turned, lambda s: F.array(s["x"], s["y"]))


def apply_homography(polygon: Column, h: list[list[float]]) -> Column:
    def move(p: Column) -> Column:
        u, v, w = (h[k][0] * p[0] + h[k][1] * p[1] + h[k][2] for k in range(3))
        return F.array(u / w, v / w)

    return F.transform(polygon, move)


def rotate(polygon: Column, width: Column, height: Column, clockwise: bool) -> Column:
    """Points after the image is turned by a right angle."""
    return F.transform(polygon, (lambda p: F.array(height - p[1], p[0])) if clockwise else (lambda p: F.array(p[1], width - p[0])))


def clipped_box(polygon: Column, width: Column, height: Column) -> Column:
    """[x, y, w, h] of the box around a polygon within the image, and the same corners on a scale of 0 to 1000."""
    b = box(polygon)
    x0, y0, x1, y1 = F.greatest(b["x0"], F.lit(0.0)), F.greatest(b["y0"], F.lit(0.0)), F.least(b["x1"], width), F.least(b["y1"], height)
    whole = F.array(*[F.round(v).cast("int") for v in (x0, y0, x1 - x0, y1 - y0)])
    scaled = F.array(*[F.round(v / s * 1000).cast("int") for v, s in ((x0, width), (y0, height), (x1, width), (y1, height))])
    return F.struct(whole.alias("bbox"), scaled.alias("bbox_norm"))


def box_share(line: Column, x: Column, y: Column, w: Column, h: Column) -> Column:
    """Share of a line's box that lies in a rectangle; 0 for a box without area."""
    width, height = line["x1"] - line["x0"], line["y1"] - line["y0"]
    inner = F.greatest(F.lit(0.0), F.least(line["x1"], x + w) - F.greatest(line["x0"], x)) * F.greatest(F.lit(0.0), F.least(line["y1"], y + h) - F.greatest(line["y0"], y))
    return F.when((width > 0) & (height > 0), inner / (width * height)).otherwise(F.lit(0.0))


def _hull(points: list[tuple[float, float]]) -> list[tuple[float, float]]:
    def half(run: list[tuple[float, float]]) -> list[tuple[float, float]]:
        out: list[tuple[float, float]] = []
        for p in run:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(p)
        return out[:-1]

    ordered = sorted(set(points))
    return half(ordered) + half(ordered[::-1]) if len(ordered) > 2 else ordered


def _area(points: list[tuple[float, float]]) -> float:
    return abs(sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(points, points[1:] + points[:1]))) / 2


def _within(points: list[tuple[float, float]], axis: int, limit: float, sign: int) -> list[tuple[float, float]]:
    out = []
    for a, b in zip(points, points[1:] + points[:1]):
        da, db = sign * (limit - a[axis]), sign * (limit - b[axis])
        if da >= 0:
            out.append(a)
        if da * db < 0:
            t = da / (da - db)
            out.append((a[0] + t * (b[0] - a[0]), a[1] + t * (b[1] - a[1])))
    return out


def polygon_in_box(points: list, rect: list) -> float:
    """Share of a polygon's hull that lies in [x, y, w, h]."""
    hull = _hull([(float(p[0]), float(p[1])) for p in points])
    whole = _area(hull) if len(hull) > 2 else 0.0
    if whole <= 0:
        return 0.0
    x, y, w, h = map(float, rect)
    for axis, limit, sign in ((0, x + w, 1), (0, x, -1), (1, y + h, 1), (1, y, -1)):
        hull = _within(hull, axis, limit, sign)
        if len(hull) < 3:
            return 0.0
    return _area(hull) / whole


@F.pandas_udf(DoubleType())
def polygon_share(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """Share of a slanted line's polygon that lies in a rectangle [x, y, w, h]; for upright boxes ``box_share`` does."""
    for lines, rects in batches:
        yield pd.Series([None if p is None or r is None else polygon_in_box(p, r) for p, r in zip(lines, rects)], dtype="float64")


def gradient_hash(pixels: Column, width: int, height: int) -> Column:
    """One bit for each pixel that is brighter than its right neighbour, row by row from the lowest bit."""
    bits = [F.when(pixels[r * width + c] > pixels[r * width + c + 1], F.lit(1 << (r * (width - 1) + c)).cast("bigint")).otherwise(F.lit(0).cast("bigint")) for r in range(height) for c in range(width - 1)]
    out = bits[0]
    for b in bits[1:]:
        out = out.bitwiseOR(b)
    return out
