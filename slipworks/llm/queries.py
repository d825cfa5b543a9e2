"""The queries of this subpackage by name, and their SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slipworks.llm import addresses, bpe, components, groups, lookalike, names, overlap, packing, reading, splits
from slipworks.session import Workspace
from slipworks.sources.tables import once, table


def _seller_names(spark: SparkSession, folder: str) -> DataFrame:
    """(src, row_key, name, merchant_id) of all rows that name a merchant."""
    receipts = table(spark, folder, "receipts").select(F.lit("receipts").alias("src"), F.col("id").alias("row_key"), F.col("merchant_name").alias("name"))
    fields = table(spark, folder, "field_results").where("field_key = 'merchant_name'").select(F.lit("field_results").alias("src"), F.col("result_id").cast("string").alias("row_key"), F.col("value").alias("name"))
    register = names.read_register(table(spark, folder, "merchants"), "merchant_id", "legal_name", "trade")
    rows = receipts.union(fields).where("row_key is not null and name is not null")
    register = names.with_learnt_trades(rows, register)
    return names.linked_names(rows, register, ("src", "row_key")).withColumnRenamed("entity", "merchant_id")


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    legal = table(spark, folder, "merchants").select(F.col("merchant_id").alias("m"), "legal_name").distinct()
    linked = _seller_names(spark, folder)
    return linked.join(legal, (F.col("merchant_id") == F.col("m")) & (F.col("name") == F.col("legal_name")), "left_anti").select("src", "row_key", "merchant_id").distinct()


def p1_variants(spark: SparkSession, folder: str) -> DataFrame:
    """How many rows and writings each merchant has."""
    return _seller_names(spark, folder).groupBy("merchant_id").agg(F.countDistinct("src", "row_key").alias("n_rows"), F.countDistinct("name").alias("writings"))


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    lines = table(spark, folder, "ocr_lines").select(F.col("line_id").alias("row_key"), "text")
    corrections = table(spark, folder, "label_corrections").select(F.col("correction_id").alias("row_key"), "old_text", "new_text")
    return lookalike.disguised(lines, corrections, lookalike.phrase_list(table(spark, folder, "print_phrases")))


def p2_canonical(spark: SparkSession, folder: str) -> DataFrame:
    """How many writings and texts each canonical form stands for, over all lines and both texts of all corrections."""
    phrases = lookalike.phrase_list(table(spark, folder, "print_phrases"))
    lines = once(table(spark, folder, "ocr_lines").select("line_id", "text"), "line_id").select("text")
    corrections = once(table(spark, folder, "label_corrections").select("correction_id", "old_text", "new_text"), "correction_id")
    texts = lines.union(corrections.select(F.explode(F.array("old_text", "new_text"))))
    kinds = texts.where("text is not null").groupBy("text").agg(F.count(F.lit(1)).alias("n"))
    forms = kinds.select("n", lookalike.canonical_forms(F.col("text"), phrases)["form"].alias("form"))
    return forms.groupBy("form").agg(F.count(F.lit(1)).alias("writings"), F.sum("n").alias("texts"))


def _photographs(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Accepted links with ends that sort withdrawn photographs last, and the distinct photographs."""
    known = table(spark, folder, "ocr_manifest").where("image_id is not null").select(F.col("image_id").alias("id")).distinct()
    pairs = table(spark, folder, "match_pairs").where("matched and image_a is not null and image_b is not null and image_a <> image_b").select(F.least("image_a", "image_b").alias("a"), F.greatest("image_a", "image_b").alias("b")).distinct()
    for end in ("a", "b"):
        here = known.select("id", F.lit(1).alias("here"))
        pairs = pairs.join(here, F.col(end) == F.col("id"), "left").withColumn(end, F.concat(F.when(F.col("here") == 1, "0").otherwise("1"), F.col(end))).drop("id", "here")
    return pairs, known


def _roots(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    pairs, known = _photographs(spark, folder)
    groups = components.linked_groups(pairs, "a", "b").where("startswith(vertex, '0') and vertex <> root")
    return groups.select(F.substring("vertex", 2, 1 << 30).alias("image_id"), F.substring("root", 2, 1 << 30).alias("root_id")), known


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    """A photograph that isn't the least of its group proves that the group has two; the roots of those are added."""
    members, _ = _roots(spark, folder)
    return members.union(members.select(F.col("root_id").alias("image_id"), "root_id").distinct())


def p3_groups(spark: SparkSession, folder: str) -> DataFrame:
    """Every photograph with its group's identifier, its own where nothing is linked with it."""
    members, known = _roots(spark, folder)
    return known.join(members, F.col("id") == F.col("image_id"), "left").select(F.col("id").alias("image_id"), F.coalesce("root_id", "id").alias("root_id"))


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return splits.torn_groups(table(spark, folder, "ocr_manifest"), "group_id", "split")


def p4_splits(spark: SparkSession, folder: str) -> DataFrame:
    """Every photograph with its group, null without one, and the split that is assigned to it."""
    group = splits.group_number(F.col("group_id"))
    out = splits.assign_splits(table(spark, folder, "ocr_manifest"), "image_id", [group], splits.split_shares(table(spark, folder, "split_targets")))
    return out.withColumnRenamed("component", "group_id")


def p4_invariants(spark: SparkSession, folder: str) -> DataFrame:
    """What must hold of ``p4_splits``: all photographs and groups are there, no group is torn, and each split's share is within
    two hundredths of its target, or, where photographs are few, within the root of their number."""
    work = Workspace(spark, "invariants")
    out, _ = work.write(p4_splits(spark, folder), "assigned")
    kept = out.where("group_id is not null").groupBy("group_id").agg(F.countDistinct("split").alias("n")).agg(F.count(F.lit(1)).alias("groups"), F.coalesce(F.sum((F.col("n") > 1).cast("bigint")), F.lit(0)).alias("torn"))
    targets = splits.split_shares(table(spark, folder, "split_targets"))
    of = [F.abs(F.sum((F.col("split") == s).cast("int")) - F.count(F.lit(1)) * w) <= F.greatest(F.count(F.lit(1)) * 0.02, F.sqrt(F.count(F.lit(1)))) for s, w in targets.items()]
    sizes = out.agg(F.count(F.lit(1)).alias("photographs"), F.countDistinct("image_id").alias("distinct_ids"), reduce(lambda a, b: a & b, of).alias("near_shares"))
    return sizes.select("*", kept.select("groups").scalar().alias("groups"), kept.select("torn").scalar().alias("torn"))


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    pairs = addresses.same_place_pairs(table(spark, folder, "receipts"), "id", "merchant_address")
    return pairs.select(F.col("a").alias("receipt_a"), F.col("b").alias("receipt_b"))


def p5_places(spark: SparkSession, folder: str) -> DataFrame:
    """Each place with its receipts and writings."""
    rows = table(spark, folder, "receipts").select("id", F.col("merchant_address").alias("address")).where("address is not null").distinct()
    of = addresses.places(rows)
    return rows.join(of, "address").groupBy("city", "street", "number", "unit").agg(F.countDistinct("id").alias("receipts"), F.countDistinct("address").alias("writings"))


def _overlaps(spark: SparkSession, folder: str) -> DataFrame:
    lines = table(spark, folder, "ocr_lines").select("image_id", "line_no", "text")
    return overlap.overlaps(lines, table(spark, folder, "ocr_manifest").select("image_id", "split", "image_hash"))


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    return _overlaps(spark, folder).select(F.least("train_id", "other_id").alias("image_a"), F.greatest("train_id", "other_id").alias("image_b"))


def p6_report(spark: SparkSession, folder: str) -> DataFrame:
    """Overlaps with train by split and source: pairs, and photographs that have any."""
    split = F.lower(F.regexp_replace("split", r"(?U)\s+", ""))
    of = table(spark, folder, "ocr_manifest").where("image_id is not null").groupBy("image_id").agg(F.min(split).alias("split"), F.min("source").alias("source"))
    pairs = _overlaps(spark, folder).join(of, F.col("other_id") == F.col("image_id"))
    return pairs.groupBy("split", "source").agg(F.count(F.lit(1)).alias("pairs"), F.countDistinct("other_id").alias("photographs"))


def receipt_groups(spark: SparkSession, folder: str) -> DataFrame:
    """Groups and duplicates by all likenesses: images, sales, names of sellers and addresses."""
    return groups.receipt_groups(table(spark, folder, "ocr_manifest"), Workspace(spark, "receipts"))


def p8_ids(spark: SparkSession, folder: str) -> DataFrame:
    return bpe.encode(table(spark, folder, "documents"))


#: Tokens of capacity for each segment that a container may hold, and the share of it that may bear loss.
SEGMENT_TOKENS, LOSS_SHARE = 128, 0.98


def _packed(spark: SparkSession, folder: str) -> tuple[DataFrame, dict[int, tuple[int, int, int]]]:
    """Containers of each capacity under three limits, and the limits (tokens, segments, loss-bearing tokens); running texts
    bear loss on all tokens, pages on none."""
    capacities = table(spark, folder, "pack_limits").where("capacity_tokens > 0").select("limit_id", "capacity_tokens").distinct().collect()
    limits = {r[0]: (r[1], max(1, r[1] // SEGMENT_TOKENS), int(r[1] * LOSS_SHARE)) for r in sorted(capacities)}
    documents = table(spark, folder, "documents").select(F.struct("doc_id", (F.col("layout") == "prose").alias("prose")).alias("key"), "text")
    counted = bpe.count_tokens(documents, "key")
    sizes = counted.select("key.doc_id", "tokens", F.when(F.col("key.prose"), F.col("tokens")).otherwise(0).alias("loss"))
    return packing.pack(sizes, [(k, *v) for k, v in limits.items()], Workspace(spark, "packing")), limits


def p9_containers(spark: SparkSession, folder: str) -> DataFrame:
    return _packed(spark, folder)[0]


def p9_fill(spark: SparkSession, folder: str) -> DataFrame:
    packed, limits = _packed(spark, folder)
    return packing.fill_report(packed, {k: v[0] for k, v in limits.items()})


def p9_invariants(spark: SparkSession, folder: str) -> DataFrame:
    """What must hold of ``p9_containers`` for each limit: all documents are there, no container is beyond a limit, and no
    document is divided that would fit."""
    packed, limits = _packed(spark, folder)
    work = Workspace(spark, "invariants")
    packed, _ = work.write(packed, "packed")
    bound = spark.createDataFrame([(k, *v) for k, v in limits.items()], "l int, capacity long, segments long, loss_limit long")
    boxes = packed.where("container_id is not null").groupBy("limit_id", "container_id").agg(F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("n"), F.sum("loss").alias("loss"), F.max("tokens").alias("most"))
    over = boxes.join(bound, F.col("limit_id") == F.col("l")).groupBy("limit_id").agg(*[F.count(F.when(F.expr(rule), 1)).alias(name) for name, rule in (("over_tokens", "tokens > capacity"), ("over_segments", "n > segments"), ("over_loss", "loss > loss_limit and n > 1"))])
    whole = packed.groupBy("limit_id", "doc_id").agg(F.sum("tokens").alias("tokens"), F.max("piece").alias("last"))
    kept = whole.join(bound, F.col("limit_id") == F.col("l")).groupBy("limit_id").agg(F.count(F.lit(1)).alias("documents"), F.count(F.when(F.expr("last > 0 and tokens <= capacity"), 1)).alias("divided_short"))
    return kept.join(over, "limit_id")


def p10_found(spark: SparkSession, folder: str) -> DataFrame:
    return reading.documents_with_level(table(spark, folder, "documents"), table(spark, folder, "level_samples"))


def p10_profile(spark: SparkSession, folder: str) -> DataFrame:
    """Documents and characters by source and level."""
    levels = p10_found(spark, folder)
    return table(spark, folder, "documents").select("doc_id", "source", "n_chars").join(levels, "doc_id").groupBy("source", "level").agg(F.count(F.lit(1)).alias("documents"), F.sum("n_chars").alias("chars"))


def queries() -> dict:
    return {f.__name__: f for f in (p1_found, p1_variants, p2_found, p2_canonical, p3_found, p3_groups, p4_found, p4_splits, p4_invariants, p5_found, p5_places, p6_found, p6_report, receipt_groups, p8_ids, p9_containers, p9_fill, p9_invariants, p10_found, p10_profile)}
