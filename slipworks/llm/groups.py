"""Groups of photographs that may not be parted by a split: near-equal images, prints of one sale, and one seller or address.

Each kind of likeness is a table of links between nodes (photographs, hashes, names, addresses), and groups are their
connected components, so photographs that share a key are linked through the key and not with each other.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slipworks.llm.splits import hash_to_min
from slipworks.operators import corpus
from slipworks.session import Workspace


def receipt_groups(manifest: DataFrame, work: Workspace | None = None) -> DataFrame:
    """(image_id, group_id, group_size, dup_of) for every photograph; ids in their order are the order of the records.

    group_id is the least photograph of the group. dup_of is the first earlier photograph whose hash is within 3 bits, else the
    first with the same date, time, total and seller, else null.
    """
    work = work or Workspace(manifest.sparkSession, "receipts")
    pages = manifest.where("image_id is not null").dropDuplicates(["image_id"])
    of = corpus.seller_keys(pages).withColumnRenamed("image_id", "_i")
    sale = [F.nullif("gt.transaction_date", F.lit("")).alias("day"), F.nullif("gt.transaction_time", F.lit("")).alias("clock"), F.nullif("gt.total", F.lit(0)).alias("total")]
    rows, _ = work.write(pages.select("image_id", "image_hash", *sale).join(of, F.col("image_id") == F.col("_i")).drop("_i"), "rows")

    near, _ = work.write(corpus.near_hashes(rows, "image_hash").select("hash_a", "hash_b"), "near")
    first = rows.where("image_hash is not null").groupBy(F.col("image_hash").alias("h")).agg(F.min("image_id").alias("first"))
    around = near.select(F.col("hash_a").alias("of"), F.col("hash_b").alias("by")).union(near.select("hash_b", "hash_a")).union(first.select("h", "h"))
    alike = around.join(first, F.col("by") == F.col("h")).groupBy("of").agg(F.min("first").alias("alike"))
    same = corpus.same_receipt_links(rows, [F.col("day"), F.col("clock"), F.col("total"), F.coalesce("any_name", F.lit(""))], "image_id")
    same, _ = work.write(same, "same")

    def node(kind: str, c: str) -> Column:
        return F.concat(F.lit(f"{kind}:"), F.col(c).cast("string"))

    parts = [rows.select(node("i", "image_id").alias("u"), F.coalesce(node(kind, c), node("i", "image_id")).alias("v")) for kind, c in (("h", "image_hash"), ("n", "name"), ("a", "address"))]
    parts += [near.select(node("h", "hash_a"), node("h", "hash_b")), same.select(node("i", "record"), node("i", "first"))]
    parts += [corpus.fuzzy_pairs(rows, c, t, "image_id").select(node(kind, "a"), node(kind, "b")) for kind, c, t in (("n", "name", 0.86), ("a", "address", 0.90))]
    links, _ = work.write(reduce(DataFrame.union, parts), "links")
    found = hash_to_min(links, "u", "v", work).where("node like 'i:%'").select(F.expr("substring(node, 3)").alias("_node"), "component")
    groups = found.groupBy("component").agg(F.min("_node").alias("group_id"), F.count(F.lit(1)).alias("group_size")).withColumnRenamed("component", "_c")
    grouped = found.join(groups, F.col("component") == F.col("_c")).select("_node", "group_id", "group_size")

    out = rows.select("image_id", "image_hash").join(grouped, F.col("image_id") == F.col("_node")).join(alike, F.col("image_hash") == F.col("of"), "left").join(same, F.col("image_id") == F.col("record"), "left")
    return out.select("image_id", "group_id", "group_size", F.coalesce(F.when(F.col("alike") < F.col("image_id"), F.col("alike")), F.col("first")).alias("dup_of"))
