"""Kernels over grey images in Arrow batches: rectified crops, skew, the page's outline, contrast and noise, each with the
homography that takes places of the old image to the new.

An image is a row with width, height and pixels (one byte each, row by row). Decoding files is up to a model's library; nothing
here needs one.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class Settings(NamedTuple):
    """Which steps are taken, in this order, and how. A step that is None is left out."""

    turn: int = 0
    page_share: tuple[float, float] | None = None
    skew: tuple[float, float] | None = (0.3, 12.0)
    contrast: tuple[float, int] | None = None
    noise: int | None = None


def homography(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """The 3 x 3 matrix that takes four places to four others, its last number 1."""
    rows, right = [], []
    for (x, y), (u, v) in zip(source, target):
        rows += [[x, y, 1, 0, 0, 0, -u * x, -u * y], [0, 0, 0, x, y, 1, -v * x, -v * y]]
        right += [u, v]
    return np.append(np.linalg.solve(np.array(rows, float), np.array(right, float)), 1.0).reshape(3, 3)


def warped(image: np.ndarray, h: np.ndarray, width: int, height: int) -> np.ndarray:
    """The image under a homography: each place takes the value between the four pixels that it comes from, beyond the edge the
    value of the edge."""
    back = np.linalg.inv(h)
    xs, ys = np.meshgrid(np.arange(width), np.arange(height))
    u, v, w = np.tensordot(back, np.stack([xs, ys, np.ones_like(xs)]), 1)
    x, y = np.clip(u / w, 0, image.shape[1] - 1), np.clip(v / w, 0, image.shape[0] - 1)
    x0, y0 = np.floor(x).astype(int), np.floor(y).astype(int)
    x1, y1 = np.minimum(x0 + 1, image.shape[1] - 1), np.minimum(y0 + 1, image.shape[0] - 1)
    fx, fy = x - x0, y - y0
    flat = image.astype(float)
    top, low = flat[y0, x0] * (1 - fx) + flat[y0, x1] * fx, flat[y1, x0] * (1 - fx) + flat[y1, x1] * fx
    return np.rint(top * (1 - fy) + low * fy).astype(np.uint8)


def in_order(quad: np.ndarray) -> np.ndarray:
    """Four corners clockwise on the page from the top left."""
    off = quad - quad.mean(0)
    around = quad[np.argsort(np.arctan2(off[:, 1], off[:, 0]), kind="stable")]
    start = np.lexsort((around[:, 0], around[:, 1], around.sum(1)))[0]
    return np.roll(around, -start, axis=0)


def hull(points: np.ndarray) -> np.ndarray:
    def half(run: list) -> list:
        out: list = []
        for p in run:
            while len(out) > 1 and np.cross(np.append(out[-1] - out[-2], 0), np.append(p - out[-2], 0))[2] <= 0:
                out.pop()
            out.append(p)
        return out[:-1]

    ordered = [np.array(p) for p in sorted(set(map(tuple, points.tolist())))]
    return np.array(half(ordered) + half(ordered[::-1])) if len(ordered) > 2 else np.array(ordered)


def least_rectangle(points: np.ndarray, pad: float = 0.0) -> np.ndarray | None:
    """The corners of the smallest rectangle around points, each side ``pad`` farther out; None if it is thinner than 2."""
    around = hull(np.asarray(points, float))
    if len(around) < 3:
        return None
    best = None
    for a, b in zip(around, np.roll(around, -1, axis=0)):
        d = (b - a) / np.linalg.norm(b - a)
        turn = np.array([d, [-d[1], d[0]]])
        low, high = (around @ turn.T).min(0), (around @ turn.T).max(0)
        if best is None or np.prod(high - low) < best[0]:
            best = np.prod(high - low), turn, low, high
    _, turn, low, high = best
    if (high - low).min() < 2:
        return None
    low, high = low - pad, high + pad
    return in_order(np.array([[low[0], low[1]], [high[0], low[1]], [high[0], high[1]], [low[0], high[1]]]) @ turn)


def rectified(image: np.ndarray, polygon: np.ndarray, upright: float = 1.5, pad: float = 2.0) -> np.ndarray | None:
    """A line of text cut out and put straight; a crop ``upright`` times as high as wide is turned by a right angle. None if
    nothing is left."""
    box = least_rectangle(polygon, pad)
    if box is None:
        return None
    side = lambda i, j: np.linalg.norm(box[i] - box[j])
    width, height = round(max(side(0, 1), side(2, 3))), round(max(side(0, 3), side(1, 2)))
    if min(width, height) < 2:
        return None
    out = warped(image, homography(box, np.array([[0, 0], [width, 0], [width, height], [0, height]], float)), width, height)
    return np.rot90(out) if height >= upright * width else out


def _box_mean(image: np.ndarray, radius: int) -> np.ndarray:
    """The mean of each pixel's square of neighbours, edges repeated."""
    padded = np.pad(image.astype(float), radius, mode="edge")
    total = np.pad(padded.cumsum(0).cumsum(1), ((1, 0), (1, 0)))
    n = 2 * radius + 1
    return (total[n:, n:] - total[:-n, n:] - total[n:, :-n] + total[:-n, :-n]) / (n * n)


def ink(image: np.ndarray, radius: int = 12, darker: float = 15.0) -> np.ndarray:
    """Pixels that are clearly darker than what is around them."""
    return image < _box_mean(image, radius) - darker


def skew(image: np.ndarray, most: float = 12.0, step: float = 0.25, side: int = 600) -> float:
    """The angle in degrees, counter-clockwise, by which the image must be turned so that lines of text are level: the one with
    the most varied sums of ink by row; of equals the smallest."""
    shrink = max(1, -(-max(image.shape) // side))
    small = _box_mean(image, shrink // 2)[::shrink, ::shrink] if shrink > 1 else image
    ys, xs = np.nonzero(ink(small))
    if not len(xs):
        return 0.0
    angles = np.arange(-most, most + step / 2, step)
    best, found = -1.0, 0.0
    for a in sorted(angles, key=lambda a: (abs(a), a)):
        t = np.deg2rad(a)
        level = np.rint((ys - small.shape[0] / 2) * np.cos(t) - (xs - small.shape[1] / 2) * np.sin(t) + small.shape[0] / 2).astype(int)
        sums = np.bincount(level[(level >= 0) & (level < small.shape[0])], minlength=small.shape[0])
        varied = float(np.var(sums))
        if varied > best + 1e-9:
            best, found = varied, float(a)
    return found


def levelled(image: np.ndarray, degrees: float) -> tuple[np.ndarray, np.ndarray]:
    """The image turned counter-clockwise about its centre, on a canvas that holds all of it, and the homography."""
    h, w = image.shape
    c, s = np.cos(np.deg2rad(degrees)), np.sin(np.deg2rad(degrees))
    width, height = round(h * abs(s) + w * abs(c)), round(h * abs(c) + w * abs(s))
    m = np.array([[c, s, width / 2 - c * w / 2 - s * h / 2], [-s, c, height / 2 + s * w / 2 - c * h / 2], [0, 0, 1.0]])
    return warped(image, m, width, height), m


def threshold(image: np.ndarray) -> int:
    """The grey value that parts dark and light so that the two differ most."""
    counts = np.bincount(image.ravel(), minlength=256).astype(float)
    n, total = counts.cumsum(), (counts * np.arange(256)).cumsum()
    rest = n[-1] - n
    with np.errstate(divide="ignore", invalid="ignore"):
        between = np.where((n > 0) & (rest > 0), n * rest * (total / n - (total[-1] - total) / rest) ** 2, -1.0)
    return int(between.argmax())


def page_outline(image: np.ndarray, least: float, most: float) -> np.ndarray | None:
    """The four corners of a page that is lighter, or darker, than what it lies on, if it is nearly a quadrangle and takes a share
    of the image between ``least`` and ``most``; else None."""
    light = _box_mean(image, 3) > threshold(image)
    best, held = None, 0.0
    for mask in (light, ~light):
        ys, xs = np.nonzero(mask)
        share = len(xs) / image.size
        if len(xs) < 4 or not least <= share <= most or share <= held:
            continue
        ends = [f(xs, ys) for f in (lambda x, y: np.argmin(x + y), lambda x, y: np.argmax(x - y), lambda x, y: np.argmax(x + y), lambda x, y: np.argmin(x - y))]
        quad = np.array([[xs[i], ys[i]] for i in ends], float)
        x, y = quad.T
        area = abs(np.dot(x, np.roll(y, -1)) - np.dot(y, np.roll(x, -1))) / 2
        if area and 0.9 <= len(xs) / area <= 1.1:
            best, held = in_order(quad), share
    return best


def contrasted(image: np.ndarray, limit: float, tiles: int) -> np.ndarray:
    """Grey values spread out tile by tile, with no value's count above ``limit`` times the mean, and tiles blended."""
    h, w = image.shape
    tables = np.empty((tiles, tiles, 256))
    rows, columns = np.linspace(0, h, tiles + 1).astype(int), np.linspace(0, w, tiles + 1).astype(int)
    for i in range(tiles):
        for j in range(tiles):
            part = image[rows[i] : max(rows[i + 1], rows[i] + 1), columns[j] : max(columns[j + 1], columns[j] + 1)]
            counts = np.bincount(part.ravel(), minlength=256).astype(float)
            top = max(1.0, limit * part.size / 256)
            counts = np.minimum(counts, top) + np.maximum(counts - top, 0).sum() / 256
            tables[i, j] = counts.cumsum() * 255 / counts.sum()
    at = lambda n, size: np.clip((np.arange(size) + 0.5) * n / size - 0.5, 0, n - 1)
    y, x = at(tiles, h), at(tiles, w)
    y0, x0 = np.floor(y).astype(int), np.floor(x).astype(int)
    y1, x1 = np.minimum(y0 + 1, tiles - 1), np.minimum(x0 + 1, tiles - 1)
    fy, fx = (y - y0)[:, None], (x - x0)[None, :]
    take = lambda a, b: tables[a[:, None], b[None, :], image]
    return np.rint((take(y0, x0) * (1 - fx) + take(y0, x1) * fx) * (1 - fy) + (take(y1, x0) * (1 - fx) + take(y1, x1) * fx) * fy).astype(np.uint8)


def smoothed(image: np.ndarray, radius: int) -> np.ndarray:
    """The median of each pixel's square of neighbours, edges repeated."""
    padded = np.pad(image, radius, mode="edge")
    around = np.lib.stride_tricks.sliding_window_view(padded, (2 * radius + 1, 2 * radius + 1))
    return np.median(around, axis=(2, 3)).astype(np.uint8)


def prepared(image: np.ndarray, settings: Settings) -> tuple[np.ndarray, np.ndarray, dict[str, str]]:
    """(image, homography, what was done) after all steps of ``settings``."""
    h, did = np.eye(3), {}
    if settings.turn not in (0, 180):
        raise ValueError("an image is turned by 0 or 180 degrees")
    if settings.turn:
        image, h, did["turn"] = image[::-1, ::-1], np.array([[-1.0, 0, image.shape[1] - 1], [0, -1.0, image.shape[0] - 1], [0, 0, 1.0]]), "180"
    if settings.page_share:
        quad = page_outline(image, *settings.page_share)
        did["page"] = "kept" if quad is None else "cut"
        if quad is not None:
            side = lambda i, j: np.linalg.norm(quad[i] - quad[j])
            width, height = round(max(side(0, 1), side(2, 3))), round(max(side(0, 3), side(1, 2)))
            m = homography(quad, np.array([[0, 0], [width, 0], [width, height], [0, height]], float))
            image, h = warped(image, m, width, height), m @ h
    if settings.skew:
        angle = skew(image, settings.skew[1])
        did["skew"] = f"{angle:.2f}"
        if abs(angle) >= settings.skew[0]:
            image, m = levelled(image, angle)
            h = m @ h
    if settings.contrast:
        image, did["contrast"] = contrasted(image, *settings.contrast), "applied"
    if settings.noise:
        image, did["noise"] = smoothed(image, settings.noise), "applied"
    return image, h, did


def _pixels(row: tuple) -> np.ndarray | None:
    width, height, pixels = row
    if pixels is None or not width or not height or len(pixels) != width * height:
        return None
    return np.frombuffer(pixels, np.uint8).reshape(int(height), int(width))


def prepare_images(images: DataFrame, settings: Settings) -> DataFrame:
    """(image_id, width, height, pixels, h, did) of each image after the steps; all null but image_id where the image is missing or
    not as large as it says."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for key, *row in zip(batch["image_id"], batch["width"], batch["height"], batch["pixels"]):
                image = _pixels(tuple(row))
                if image is None:
                    out.append((key, None, None, None, None, None))
                else:
                    new, h, did = prepared(image, settings)
                    out.append((key, new.shape[1], new.shape[0], np.ascontiguousarray(new).tobytes(), h.tolist(), did))
            yield pd.DataFrame(out, columns=["image_id", "width", "height", "pixels", "h", "did"]).astype({"width": "Int32", "height": "Int32"})

    return images.select("image_id", "width", "height", "pixels").mapInPandas(run, "image_id string, width int, height int, pixels binary, h array<array<double>>, did map<string, string>")


def crop_lines(images: DataFrame, lines: DataFrame, cut: Callable[[np.ndarray, np.ndarray], np.ndarray | None] = rectified) -> DataFrame:
    """(image_id, line_id, width, height, pixels) of each line that can be cut out of its image. ``lines`` has image_id, line_id and
    polygon; an image goes with all its lines, so it is read once."""
    of = lines.where("polygon is not null").groupBy(F.col("image_id").alias("i")).agg(F.array_sort(F.collect_set(F.struct("line_id", "polygon"))).alias("lines"))
    rows = images.select("image_id", "width", "height", "pixels").join(of, F.col("image_id") == F.col("i")).drop("i")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for key, *row, cuts in zip(batch["image_id"], batch["width"], batch["height"], batch["pixels"], batch["lines"]):
                image = _pixels(tuple(row))
                for line in cuts if image is not None else ():
                    crop = cut(image, np.array([list(p) for p in line["polygon"]], float))
                    if crop is not None:
                        out.append((key, line["line_id"], crop.shape[1], crop.shape[0], np.ascontiguousarray(crop).tobytes()))
            yield pd.DataFrame(out, columns=["image_id", "line_id", "width", "height", "pixels"])

    return rows.mapInPandas(run, "image_id string, line_id bigint, width int, height int, pixels binary")
