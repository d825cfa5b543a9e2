"""Lines of a page in reading order, and lines matched with labelled regions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slipworks.functions import geometry as G
from slipworks.functions.text import fold
from slipworks.sources.tables import by_key


def row_numbers(lines: Column, tolerance: float = 0.5) -> Column:
    """The row of each of an array of struct<cy, h, ...> that is sorted by cy, from 0: a line joins the row above if its centre
    is within ``tolerance`` median heights of the running mean of that row."""
    heights = F.array_sort(F.transform(lines, lambda x: x["h"]))
    n = F.size(lines)
    middle = (F.element_at(heights, F.ceil(n / 2).cast("int")) + F.element_at(heights, (F.floor(n / 2) + 1).cast("int"))) / 2
    limit = F.greatest(middle, F.lit(1.0)) * tolerance
    start = F.struct(F.lit(-1).alias("row"), F.lit(0.0).alias("sum"), F.lit(0).alias("n"), F.array().cast("array<int>").alias("rows"))

    def add(a: Column, x: Column) -> Column:
        joins = (a["n"] > 0) & (F.abs(x["cy"] - a["sum"] / a["n"]) <= limit)
        row = a["row"] + F.when(joins, 0).otherwise(1)
        return F.struct(row.alias("row"), (F.when(joins, a["sum"]).otherwise(0.0) + x["cy"]).alias("sum"), (F.when(joins, a["n"]).otherwise(0) + 1).alias("n"), F.concat(a["rows"], F.array(row)).alias("rows"))

    return F.when(n > 0, F.aggregate(lines, start, add, lambda a: a["rows"])).otherwise(F.array().cast("array<int>"))


def reading_order(lines: DataFrame, homography: list[list[float]] | None = None) -> DataFrame:
    """(image_id, row, pos, idx, line_no, text, key, score, cx, x0, y0, x1, y1, height) of each line; key is the folded text;
    rows, places in them and the whole order count from 0. A row is in order of cx, then line_no.

    ``lines`` has image_id, line_no, text, rec_score and polygon. A null score is 0.5; lines without a polygon are left out,
    lines that are the same in all of these count once. With a ``homography`` rows are made, and places given, in the frame that it
    takes places to, so that pages which were put straight are read as they lie then. A page is one row of a table for a moment, so its lines must fit into
    memory; pages are short. Rows of a page stay together, so steps by page that follow need no shuffle.
    """
    p = G.apply_homography(F.col("polygon"), homography) if homography else F.col("polygon")
    b = G.box(p)
    shaped = lines.where("polygon is not null and size(polygon) > 0").select("image_id", F.struct(G.mean(G.ys(p)).alias("cy"), F.col("line_no").alias("n"), G.mean(G.xs(p)).alias("cx"), (b["y1"] - b["y0"]).alias("h"), G.text_height(p).alias("height"), F.coalesce("text", F.lit("")).alias("text"), F.coalesce("rec_score", F.lit(0.5)).alias("score"), *[b[c].alias(c) for c in ("x0", "y0", "x1", "y1")]).alias("s"))
    pages = by_key(shaped, "image_id").groupBy("image_id").agg(F.array_sort(F.collect_set("s")).alias("lines"))
    keyed = pages.select("image_id", F.zip_with("lines", row_numbers(F.col("lines")), lambda s, r: F.struct(r.alias("row"), s["cx"].alias("cx"), s["n"].alias("n"), s.alias("s"))).alias("lines"))
    placed = keyed.select("image_id", F.array_sort("lines").alias("lines")).select("image_id", F.transform("lines", lambda k: k["row"]).alias("rows"), F.posexplode("lines").alias("idx", "k"))
    pos = F.col("idx") - F.array_position("rows", F.col("k.row")).cast("int") + 1
    return placed.select("image_id", F.col("k.row").alias("row"), pos.alias("pos"), "idx", F.col("k.n").alias("line_no"), "k.s.text", fold(F.col("k.s.text")).alias("key"), "k.s.score", "k.s.cx", *[f"k.s.{c}" for c in ("x0", "y0", "x1", "y1", "height")])


def regions_of(manifest: DataFrame) -> DataFrame:
    """(image_id, region_id, label, role, text, x, y, w, h) of each labelled region, numbered from 0."""
    each = manifest.select("image_id", F.posexplode("regions").alias("region_id", "r"))
    return each.select("image_id", "region_id", "r.label", "r.role", "r.text", *[F.col("r.bbox")[k].cast("double").alias(n) for k, n in enumerate(("x", "y", "w", "h"))])


def lines_in_regions(lines: DataFrame, regions: DataFrame, least: float = 0.5, exact: bool = False) -> DataFrame:
    """(image_id, line_id, region_id, share): each line with the region of its page that holds most of it, at least ``least``;
    of equals the last region. Lines that no region holds are left out.

    Shares are of boxes; with ``exact`` of the polygons themselves, in Arrow-batched Python.
    """
    boxed = lines.where("polygon is not null").select("image_id", "line_id", "polygon", G.box(F.col("polygon")).alias("b"))
    pairs = boxed.join(regions.select("image_id", "region_id", "x", "y", "w", "h"), "image_id")
    x, y, w, h = (F.col(c) for c in "xywh")
    touching = pairs.where((F.col("b.x1") >= x) & (F.col("b.x0") <= x + w) & (F.col("b.y1") >= y) & (F.col("b.y0") <= y + h))
    share = G.polygon_share(F.col("polygon"), F.array(x, y, w, h)) if exact else G.box_share(F.col("b"), x, y, w, h)
    held = touching.select("image_id", "line_id", "region_id", share.alias("share")).where(F.col("share") >= least)
    best = held.groupBy("image_id", "line_id").agg(F.max(F.struct("share", "region_id")).alias("m"))
    return best.select("image_id", "line_id", "m.region_id", "m.share")
