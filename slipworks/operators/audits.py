"""Integrity and leakage audits: each returns the violations, or counts of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def not_exactly_once(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Keys with more than one row, and how many."""
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def match_audit(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """(key, in_left, in_right) of keys that don't occur exactly once on both sides."""
    a = left.groupBy(F.col(key).alias("k")).agg(F.count(F.lit(1)).alias("in_left"))
    b = right.groupBy(F.col(key).alias("k")).agg(F.count(F.lit(1)).alias("in_right"))
    both = a.join(b, "k", "full_outer").select(F.col("k").alias(key), F.coalesce("in_left", F.lit(0)).alias("in_left"), F.coalesce("in_right", F.lit(0)).alias("in_right"))
    return both.where("in_left <> 1 or in_right <> 1")


def orphans(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """(key, side) of keys that occur on one side only."""
    a, b = left.select(key).where(F.col(key).isNotNull()).distinct(), right.select(key).where(F.col(key).isNotNull()).distinct()
    return a.join(b, key, "left_anti").withColumn("side", F.lit("left")).union(b.join(a, key, "left_anti").withColumn("side", F.lit("right")))


def leakage(rows: DataFrame, split: str, marks: dict[str, Column]) -> DataFrame:
    """(mark, split_a, split_b, n): how many values of each mark (group, hash, key) two splits share.

    A value is reduced to its set of splits first, so that a value of very many rows is one row.
    """
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("mark"), c.cast("string").alias("value")) for k, c in marks.items()])).alias("m")
    sets = rows.select(F.col(split).alias("s"), each).where("s is not null and m.value is not null").groupBy("m.mark", "m.value").agg(F.array_sort(F.collect_set("s")).alias("s"))
    shared = sets.where("size(s) > 1").select("mark", F.explode("s").alias("split_a"), "s").select("mark", "split_a", F.explode("s").alias("split_b")).where("split_a < split_b")
    return shared.groupBy("mark", "split_a", "split_b").agg(F.count(F.lit(1)).alias("n"))


def corrections_state(corrections: DataFrame, key: str) -> DataFrame:
    """Adds state: stale (changes nothing), empty (no new text), exclude, conflict (several different corrections of a
    sample) or apply."""
    kinds = corrections.groupBy(F.col(key).alias("_k")).agg(F.countDistinct(F.coalesce("action", F.lit("")), F.coalesce("new_text", F.lit(""))).alias("_n"))
    joined = corrections.join(kinds, F.col(key).eqNullSafe(F.col("_k")))
    state = F.when(F.col("_n") > 1, "conflict").when(F.col("action") == "exclude", "exclude").when(F.col("new_text").isNull(), "empty").when(F.col("old_text").eqNullSafe(F.col("new_text")), "stale").otherwise("apply")
    return joined.withColumn("state", state).drop("_k", "_n")


#: Files of which one hash is made.
MOST_FILES = 5_000_000


def tree_hash(rows: DataFrame, path: str, digest: Column) -> DataFrame:
    """(tree): the hash of "path:digest" of all files, a line each, in order of their paths. The order makes it the work of one task,
    so more files than ``MOST_FILES`` are an error; no files give a null."""
    lines = rows.select(F.col(path).alias("p"), F.concat(F.col(path), F.lit(":"), digest, F.lit("\n")).alias("line"))
    if lines.limit(MOST_FILES + 1).count() > MOST_FILES:
        raise ValueError(f"more than {MOST_FILES} files")
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p", "line"))), lambda s: s["line"]), "")
    return lines.agg(F.nullif(whole, F.lit("")).alias("w")).select(F.sha2("w", 256).alias("tree"))


def violations(rows: DataFrame, key: str, rules: dict[str, Column]) -> DataFrame:
    """(key, broken): rows that break a rule, with the names of the rules; a rule that is null isn't broken."""
    broken = F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(True)), F.lit(name)) for name, ok in rules.items()]))
    return rows.select(F.col(key), broken.alias("broken")).where("size(broken) > 0")
