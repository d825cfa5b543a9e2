"""Labelled crops of lines: their structural audit, reviewed corrections, leakage between splits, and lineage of derived sets."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slipworks.functions.text import norm

#: Shortest side and longest text of a crop that can be trained on.
LEAST_SIDE, LONGEST_TEXT = 8, 100
ACTIONS = ("correct_text", "rotate", "exclude")


def source_texts(packed: DataFrame, texts: str, labels: str) -> DataFrame:
    """(image_id, source_index, source_text, source_label) of rows whose texts and labels are arrays, places from 0."""
    both = F.arrays_zip(F.col(texts).alias("t"), F.col(labels).alias("l"))
    return packed.select("image_id", F.posexplode(both).alias("source_index", "x")).select("image_id", "source_index", F.col("x.t").alias("source_text"), F.col("x.l").alias("source_label"))


def crop_issues(crops: DataFrame, pages: DataFrame, sources: DataFrame) -> DataFrame:
    """(sample_id, reason): everything that is wrong with crops.

    ``crops`` has sample_id, image_id, source_index, split, text, pixel_hash, width and height; ``pages`` image_id, split and
    group_id; ``sources`` is ``source_texts``. Reasons: empty_text, repeated_id, unknown_page, wrong_split, other_text (than at the
    crop's place in the source), bad_shape_or_length, and for crops of one pixel hash conflicting_text, cross_split_duplicate or
    duplicate_pixels, the first that holds. Copies are counted by hash; no hash is gathered.
    """
    text = norm(F.col("text"))
    rows = crops.withColumn("_text", text)
    repeated = rows.groupBy("sample_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("sample_id", F.lit("repeated_id").alias("reason"))
    of = pages.select(F.col("image_id").alias("_i"), F.col("split").alias("_split"))
    paged = rows.join(of, F.col("image_id") == F.col("_i"), "left")
    there = sources.select(F.col("image_id").alias("_p"), F.col("source_index").alias("_n"), norm(F.col("source_text")).alias("_source"))
    placed = paged.join(there, (F.col("image_id") == F.col("_p")) & (F.col("source_index") == F.col("_n")), "left")
    rules = {
        "empty_text": F.col("_text") == "", "unknown_page": F.col("_i").isNull(), "wrong_split": F.col("_i").isNotNull() & ~F.col("_split").eqNullSafe(F.col("split")),
        "other_text": F.col("_i").isNotNull() & ~F.col("_source").eqNullSafe(F.col("_text")), "bad_shape_or_length": (F.least("width", "height") < LEAST_SIDE) | (F.length("_text") > LONGEST_TEXT),
    }
    single = placed.select("sample_id", F.explode(F.array_compact(F.array(*[F.when(rule, F.lit(name)) for name, rule in rules.items()]))).alias("reason")).distinct()
    kinds = rows.where("pixel_hash is not null").groupBy(F.col("pixel_hash").alias("_h")).agg(F.count(F.lit(1)).alias("n"), F.min("_text").alias("t0"), F.max("_text").alias("t1"), F.min("split").alias("s0"), F.max("split").alias("s1")).where("n > 1")
    reason = F.when(F.col("t0") != F.col("t1"), "conflicting_text").when(F.col("s0") != F.col("s1"), "cross_split_duplicate").otherwise("duplicate_pixels")
    copies = rows.join(kinds, F.col("pixel_hash") == F.col("_h")).select("sample_id", reason.alias("reason")).distinct()
    return single.union(repeated).union(copies)


def correction_faults(corrections: DataFrame, crops: DataFrame) -> DataFrame:
    """(sample_id, fault): corrections that must not be applied: repeated (several of one sample), unknown (no such sample), stale
    (not of the text that the sample has), no_evidence, bad_action, empty_text, bad_rotation.

    ``corrections`` has sample_id, old_text, new_text, action, evidence and rotation_deg; ``crops`` sample_id and text.
    """
    of = crops.select(F.col("sample_id").alias("_s"), norm(F.col("text")).alias("_text")).dropDuplicates(["_s"])
    repeated = corrections.groupBy("sample_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("sample_id", F.lit("repeated").alias("fault"))
    rows = corrections.withColumn("_old", norm(F.col("old_text"))).withColumn("_new", norm(F.col("new_text"))).join(of, F.col("sample_id") == F.col("_s"), "left")
    turn = F.coalesce("rotation_deg", F.lit(0))
    rules = {
        "unknown": F.col("_s").isNull(), "stale": F.col("_s").isNotNull() & (F.col("_text") != F.col("_old")), "no_evidence": F.trim(F.coalesce("evidence", F.lit(""))) == "",
        "bad_action": ~F.coalesce(F.col("action").isin(*ACTIONS), F.lit(False)), "empty_text": (F.col("action") == "correct_text") & (F.col("_new") == ""), "bad_rotation": ~turn.isin(0, 180) | (F.col("action") == "rotate") & (turn != 180),
    }
    return rows.select("sample_id", F.explode(F.array_compact(F.array(*[F.when(rule, F.lit(name)) for name, rule in rules.items()]))).alias("fault")).distinct().union(repeated)


def apply_corrections(crops: DataFrame, corrections: DataFrame, issues: DataFrame | None = None) -> DataFrame:
    """The crops that are left, with their texts as corrected, reviewed and review_rotation_deg.

    Corrections with a fault are refused, as are samples with an issue that no correction excludes. Excluded samples are left out.
    """
    fault = correction_faults(corrections, crops).orderBy("sample_id", "fault").first()
    if fault:
        raise ValueError(f"a correction of {fault['sample_id']} can't be applied: {fault['fault']}")
    gone = corrections.where("action = 'exclude'").select(F.col("sample_id").alias("_x"))
    if issues is not None:
        unsolved = issues.join(gone, F.col("sample_id") == F.col("_x"), "left_anti").orderBy("sample_id").first()
        if unsolved:
            raise ValueError(f"{unsolved['sample_id']} has an issue that no correction excludes: {unsolved['reason']}")
    patch = corrections.where("action <> 'exclude'").select(F.col("sample_id").alias("_s"), F.col("action").alias("_action"), F.col("new_text").alias("_new"), F.coalesce("rotation_deg", F.lit(0)).alias("_turn"))
    kept = crops.join(gone, F.col("sample_id") == F.col("_x"), "left_anti").join(patch, F.col("sample_id") == F.col("_s"), "left")
    text = F.when(F.col("_action") == "correct_text", F.col("_new")).otherwise(F.col("text"))
    out = kept.withColumn("reviewed", F.col("_s").isNotNull()).withColumn("review_rotation_deg", F.coalesce("_turn", F.lit(0))).withColumn("_t", text)
    return out.withColumn("text", norm(F.col("_t"))).drop("_s", "_action", "_new", "_turn", "_t")


def shared_between_splits(crops: DataFrame, one: str = "train", other: str = "val", marks: tuple[str, ...] = ("sample_id", "group_id", "pixel_hash")) -> DataFrame:
    """(mark, value): values of each mark that two splits share; two sets that may be trained and measured on share none."""
    parts = []
    for mark in marks:
        of = lambda s, mark=mark: crops.where((F.col("split") == s) & F.col(mark).isNotNull()).select(F.lit(mark).alias("mark"), F.col(mark).cast("string").alias("value"))
        parts.append(of(one).intersect(of(other)))
    return reduce(DataFrame.union, parts)


def lineage(parent: dict, changes: dict, allowed: tuple[str, ...]) -> dict:
    """The settings of a run over the same crops as its parent, with what was changed; other changes than of ``allowed`` keys are
    refused, as are keys that the parent hasn't got."""
    wrong = sorted(k for k in changes if k not in allowed or k not in parent)
    if wrong:
        raise ValueError(f"a derived run may not change {', '.join(wrong)}")
    return parent | changes | {"parent": {k: parent[k] for k in changes}}


def locked(split: str, unlock: bool = False) -> str:
    """The split, unless it is the test split and nobody has unlocked it."""
    if split.strip().lower() == "test" and not unlock:
        raise PermissionError("the test split is locked")
    return split
