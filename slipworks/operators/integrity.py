"""Integrity of a labelled corpus: counts of each problem with a few examples, and figures of its texts and labels."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from slipworks.functions.text import nfc
from slipworks.operators import spatial

# Labels that a page should have, and the patterns of a plain amount and of a date.
KEY_LABELS = ("SELLER", "ADDRESS", "TIMESTAMP", "TOTAL_COST")
PLAIN_AMOUNT, DATED = r"^\D*\d[\d.,\s]*\D*$", r"\d{1,2}[/\-.]\d{1,2}[/\-.]\d{2,4}"


def counted_problems(problems: DataFrame, examples: int = 3) -> DataFrame:
    """(kind, n, examples): how many rows of (kind, who) there are, and the least few of them in order. A task keeps no more than
    these few of each kind."""
    least = F.array_sort(F.collect_list(F.when(F.col("at") <= examples, F.col("who"))))
    counts = problems.groupBy("kind", "who").agg(F.count(F.lit(1)).alias("c"))
    buckets = counts.withColumn("b", F.pmod(F.xxhash64("who"), F.lit(64)))  # the least of each bucket first, so that no kind is sorted in one task
    few = buckets.withColumn("at", F.row_number().over(Window.partitionBy("kind", "b").orderBy("who"))).where(F.col("at") <= examples)
    few = few.withColumn("at", F.row_number().over(Window.partitionBy("kind").orderBy("who"))).where(F.col("at") <= examples)
    shown = few.groupBy(F.col("kind").alias("k")).agg(least.alias("examples"))
    return counts.groupBy("kind").agg(F.sum("c").alias("n")).join(shown, F.col("kind") == F.col("k")).select("kind", "n", "examples")


def page_problems(manifest: DataFrame) -> DataFrame:
    """(kind, who): duplicate_image_id, size_missing, box_out_of_bounds, polygon_out_of_bounds, empty_text, texts_missing and
    hash_missing of every row of a manifest, one for each page and kind, empty_text one for each region."""
    who = F.col("image_id")
    regions = F.coalesce("regions", F.array().cast(manifest.schema["regions"].dataType))
    out = F.exists(regions, lambda r: (r["bbox"][0] < 0) | (r["bbox"][1] < 0) | (r["bbox"][0] + r["bbox"][2] > F.col("width") + 2) | (r["bbox"][1] + r["bbox"][3] > F.col("height") + 2) | (r["bbox"][2] <= 0) | (r["bbox"][3] <= 0))
    beyond = F.exists(regions, lambda r: F.exists(r["polygon"], lambda p: (p[0] < -2) | (p[1] < -2) | (p[0] > F.col("width") + 2) | (p[1] > F.col("height") + 2)))
    rules: dict[str, Column] = {"size_missing": F.col("width").isNull() | F.col("height").isNull(), "box_out_of_bounds": out, "polygon_out_of_bounds": beyond, "texts_missing": F.size(regions) == 0, "hash_missing": F.col("image_hash").isNull()}
    pages = manifest.dropDuplicates(["image_id"])
    each = pages.select(who.alias("who"), F.explode(F.array_compact(F.array(*[F.when(rule, F.lit(name)) for name, rule in rules.items()]))).alias("kind")).select("kind", "who")
    blank = spatial.regions_of(pages).where(F.trim(F.coalesce("text", F.lit(""))) == "").select(F.lit("empty_text").alias("kind"), who.alias("who"))
    twice = manifest.groupBy("image_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.lit("duplicate_image_id").alias("kind"), who.alias("who"))
    return reduce(DataFrame.union, [each, blank, twice])


def text_figures(manifest: DataFrame) -> DataFrame:
    """(figure, n, of): how many regions of a label there are, how many pages lack a key label, how many texts aren't composed, how
    many dates and amounts look like one. ``of`` is what n is counted among, itself for labels."""
    pages = manifest.dropDuplicates(["image_id"])
    regions = spatial.regions_of(pages)
    texts = regions.where("text is not null").withColumn("_nfc", nfc(F.col("text")))
    is_amount = (F.col("label") == "TOTAL_COST") & F.col("text").rlike(r"\d")
    counts = texts.agg(F.count(F.lit(1)).alias("all"), F.count(F.when(F.col("_nfc") != F.col("text"), 1)).alias("loose"), F.count(F.when(F.col("label") == "TIMESTAMP", 1)).alias("stamps"), F.count(F.when((F.col("label") == "TIMESTAMP") & F.col("text").rlike(DATED), 1)).alias("dated"), F.count(F.when(is_amount, 1)).alias("amounts"), F.count(F.when(is_amount & F.trim("text").rlike(PLAIN_AMOUNT), 1)).alias("plain"))
    rows = counts.select(F.explode(F.array(*[F.struct(F.lit(k).alias("figure"), F.col(n).alias("n"), F.col(of).alias("of")) for k, n, of in (("not_composed", "loose", "all"), ("timestamp_with_date", "dated", "stamps"), ("total_as_amount", "plain", "amounts"))])).alias("x")).select("x.*")
    labels = regions.groupBy(F.concat(F.lit("label:"), F.coalesce("label", F.lit("(none)"))).alias("figure")).agg(F.count(F.lit(1)).alias("n")).withColumn("of", F.col("n"))
    held = pages.select(F.coalesce(F.transform("regions", lambda r: r["label"]), F.array().cast("array<string>")).alias("has"))
    absent = held.agg(F.count(F.lit(1)).alias("of"), *[F.count(F.when(~F.coalesce(F.array_contains("has", k), F.lit(False)), 1)).alias(k) for k in KEY_LABELS])
    absent = absent.select("of", F.explode(F.array(*[F.struct(F.lit(f"pages_without:{k}").alias("figure"), F.col(k).alias("n")) for k in KEY_LABELS])).alias("x")).select("x.figure", "x.n", "of")
    return rows.union(labels).union(absent)
