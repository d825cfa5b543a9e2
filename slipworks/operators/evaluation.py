"""Measuring recognised lines against labelled regions: one row for each region, reports by slice, and runs side by side."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slipworks.functions.edit import score_pairs
from slipworks.functions.text import VARIANTS
from slipworks.functions.values import parse_date, parse_time, parse_vnd
from slipworks.operators import spatial, stats

#: What tells a region of one run from those of another.
REGION = ["image_id", "region_id"]
#: Parsers of what a label's values mean.
PARSED = [("total_vnd", "TOTAL_COST", parse_vnd), ("date", "TIMESTAMP", parse_date), ("time", "TIMESTAMP", parse_time)]


def valid_regions(manifest: DataFrame, least_side: float = 8) -> DataFrame:
    """The regions of ``spatial.regions_of`` with a text and no side below ``least_side``; they keep their numbers."""
    return spatial.regions_of(manifest).where((F.least("w", "h") >= least_side) & (F.trim("text") != ""))


def skipped_regions(manifest: DataFrame, least_side: float = 8) -> DataFrame:
    """(image_id, regions, skipped): how many regions of each page there are, and how many ``valid_regions`` leaves out."""
    fit = F.filter("regions", lambda r: (F.least(r["bbox"][2], r["bbox"][3]) >= least_side) & (F.trim(r["text"]) != ""))
    n = F.coalesce(F.when(F.col("regions").isNotNull(), F.size("regions")), F.lit(0))
    return manifest.select("image_id", n.alias("regions"), (n - F.coalesce(F.when(F.col("regions").isNotNull(), F.size(fit)), F.lit(0))).alias("skipped"))


def sorted_regions(manifest: DataFrame) -> DataFrame:
    """(image_id, place, region_id, label, role, text): the regions of each page from top to bottom, then from left to right, of
    equals the one that was listed first."""
    placed = F.transform("regions", lambda r, i: F.struct(r["bbox"][1].alias("y"), r["bbox"][0].alias("x"), i.alias("region_id"), r["label"].alias("label"), r["role"].alias("role"), r["text"].alias("text")))
    return manifest.select("image_id", F.posexplode(F.array_sort(placed)).alias("place", "r")).select("image_id", "place", "r.region_id", "r.label", "r.role", "r.text")


def evaluation_rows(lines: DataFrame, manifest: DataFrame, least_side: float = 8, least_share: float = 0.5) -> DataFrame:
    """One row for each valid region: image_id, group_id, quality, region_id, label, role, ref, hyp, matched and the counts of
    ``edit.score_pairs``.

    hyp is the text of the lines that lie in the region, in reading order; a region without any is kept, with an empty hyp and
    matched 0. ``manifest`` has one row for each page. Lines of pages that it hasn't got are left out.
    """
    read = spatial.reading_order(lines)
    corner = lambda x, y: F.array(F.col(x).cast("double"), F.col(y).cast("double"))
    boxed = read.select("image_id", F.col("idx").alias("line_id"), F.array(corner("x0", "y0"), corner("x1", "y0"), corner("x1", "y1"), corner("x0", "y1")).alias("polygon"), "text")
    regions = valid_regions(manifest, least_side)
    held = spatial.lines_in_regions(boxed, regions, least_share).select(F.col("image_id").alias("i"), F.col("line_id").alias("n"), F.col("region_id").alias("r"))
    texts = boxed.select("image_id", "line_id", "text").join(held, (F.col("image_id") == F.col("i")) & (F.col("line_id") == F.col("n")))
    joined = texts.groupBy("i", "r").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_id", "text"))), lambda s: s["text"]), " ").alias("hyp"))
    rows = regions.select("image_id", "region_id", "label", "role", F.col("text").alias("ref")).join(joined, (F.col("image_id") == F.col("i")) & (F.col("region_id") == F.col("r")), "left")
    pages = manifest.select(F.col("image_id").alias("p"), "group_id", "quality")
    rows = rows.join(pages, F.col("image_id") == F.col("p")).select("image_id", "group_id", "quality", "region_id", "label", "role", "ref", F.coalesce("hyp", F.lit("")).alias("hyp"), F.col("hyp").isNotNull().cast("int").alias("matched"))
    return score_pairs(rows, "ref", "hyp", rows.columns)


def _positioned(rows: DataFrame) -> DataFrame:
    """Adds a text by which rows are in order of page and region, and a group for every row: its page's where it has none."""
    return rows.withColumn("_at", F.concat_ws("/", "image_id", F.lpad(F.col("region_id").cast("string"), 8, "0"))).withColumn("_group", F.coalesce("group_id", F.concat(F.lit("i:"), "image_id")))


def in_slices(rows: DataFrame) -> DataFrame:
    """Every row once for each slice that it is in: all, its label, its role, its quality."""
    of = {"overall": F.lit("all"), "label": F.col("label"), "role": F.coalesce("role", F.lit("unknown")), "quality": F.when(F.col("quality") < 0.5, "low").otherwise("normal")}
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("slice"), v.alias("value")) for k, v in of.items()]))
    return rows.withColumn("_s", each).select("*", F.col("_s.slice").alias("_slice"), F.col("_s.value").alias("_value")).drop("_s")


def slice_report(rows: DataFrame, draws: int = 1000, seed: int = 42) -> DataFrame:
    """(slice, value, regions, documents, region_coverage, exact_match_rate, and cer_ and wer_ of each variant with _low and _high):
    rates are ratios of sums with an interval over draws of groups. No rows give no rows."""
    sliced = in_slices(_positioned(rows))
    plain = sliced.groupBy("_slice", "_value").agg(F.count(F.lit(1)).alias("regions"), F.countDistinct("image_id").alias("documents"), F.avg("matched").alias("region_coverage"), F.avg("exact_match").alias("exact_match_rate"))
    ratios = {f"{rate}_{v}": stats.Ratio(f"{unit}_err_{v}", f"{unit}_len_{v}") for v in VARIANTS for rate, unit in (("cer", "char"), ("wer", "word"))}
    each = stats.bootstrap_intervals(sliced, ["_slice", "_value"], "_group", "_at", ratios, draws, seed=seed)
    wide = each.groupBy(F.col("_slice").alias("s"), F.col("_value").alias("v")).agg(*[F.max(F.when(F.col("name") == n, F.col(c))).alias(n if c == "value" else f"{n}_{c}") for n in ratios for c in ("value", "low", "high")])
    joined = plain.join(wide, (F.col("_slice") == F.col("s")) & F.col("_value").eqNullSafe(F.col("v")))
    return joined.select(F.col("_slice").alias("slice"), F.col("_value").alias("value"), "regions", "documents", "region_coverage", "exact_match_rate", *[c for n in ratios for c in (n, f"{n}_low", f"{n}_high")])


def normalised_accuracy(rows: DataFrame) -> DataFrame:
    """(field, valid_reference_regions, matches, accuracy): how often ref and hyp of a label's values mean the same, over those
    whose ref means something."""
    each = [F.struct(F.lit(name).alias("field"), F.lit(label).alias("of"), parse(F.col("ref")).cast("string").alias("a"), parse(F.col("hyp")).cast("string").alias("b")) for name, label, parse in PARSED]
    read = rows.where("role = 'value'").select("label", F.explode(F.array(*each)).alias("x")).select("label", "x.*").where((F.col("label") == F.col("of")) & F.col("a").isNotNull())
    same = (F.col("a") == F.coalesce("b", F.lit(""))).cast("int")
    return read.groupBy("field").agg(F.count(F.lit(1)).alias("valid_reference_regions"), F.sum(same).alias("matches"), F.avg(same).alias("accuracy"))


def corpus_metrics(pairs: DataFrame) -> DataFrame:
    """(samples, cer, wer, exact) over all rows of ``edit.score_pairs``; no rows are an error."""
    rate = lambda unit: F.sum(f"{unit}_err_exact") / F.nullif(F.sum(f"{unit}_len_exact"), F.lit(0))
    out = pairs.agg(F.count(F.lit(1)).alias("samples"), rate("char").alias("cer"), rate("word").alias("wer"), F.avg("exact_match").alias("exact"))
    return out.select(F.when(F.col("samples") == 0, F.raise_error(F.lit("nothing to measure")).cast("bigint")).otherwise(F.col("samples")).alias("samples"), "cer", "wer", "exact")


def population_differences(base: DataFrame, candidate: DataFrame) -> DataFrame:
    """(image_id, region_id, ref, side): regions, or texts of them, that only one of two runs has. Runs with any must not be
    compared."""
    keys = [*REGION, "ref"]
    a, b = base.select(*keys), candidate.select(*keys)
    return a.exceptAll(b).withColumn("side", F.lit("base")).union(b.exceptAll(a).withColumn("side", F.lit("candidate")))


def compare_runs(base: DataFrame, candidate: DataFrame, draws: int = 1000, seed: int = 42) -> DataFrame:
    """(unit, candidate, base, diff, low, high, better): error rates of two runs over the same regions, their difference with the
    interval over the same draws of groups, and the share of draws in which the candidate has fewer errors.

    Runs over different regions or texts are refused.
    """
    odd = population_differences(base, candidate).limit(1).collect()
    if odd:
        raise ValueError(f"the runs measure different regions, the first is {tuple(odd[0])}")
    columns = [f"{unit}_{c}_exact" for unit in ("char", "word") for c in ("err", "len")]
    other = candidate.select(F.col("image_id").alias("i"), F.col("region_id").alias("r"), *[F.col(c).alias(f"c_{c}") for c in columns])
    both = _positioned(base).join(other, (F.col("image_id") == F.col("i")) & (F.col("region_id") == F.col("r")))
    ratios = {u: stats.Ratio(f"c_{u}_err_exact", f"c_{u}_len_exact", (f"{u}_err_exact", f"{u}_len_exact")) for u in ("char", "word")}
    diffs = stats.bootstrap_intervals(both, [], "_group", "_at", ratios, draws, seed=seed)
    sums = both.agg(*[F.sum(c).alias(c) for p in ("", "c_") for c in (f"{p}{x}" for x in columns)])
    rate = lambda p, u: F.col(f"{p}{u}_err_exact") / F.nullif(F.col(f"{p}{u}_len_exact"), F.lit(0))
    rates = sums.select(F.explode(F.array(*[F.struct(F.lit(u).alias("unit"), rate("c_", u).alias("candidate"), rate("", u).alias("base")) for u in ("char", "word")])).alias("x")).select("x.*")
    return rates.join(diffs, F.col("unit") == F.col("name")).select("unit", "candidate", "base", F.col("value").alias("diff"), "low", "high", F.col("below").alias("better"))


def summarise_runs(runs: dict[str, DataFrame]) -> DataFrame:
    """(run, regions, region_coverage, cer_exact, wer_exact, cer_nocase, cer_nodiac, and cer_ of each label): runs as rows of one
    table."""
    if not runs:
        raise ValueError("no runs")
    named = None
    for name, rows in runs.items():
        rows = rows.withColumn("run", F.lit(name))
        named = rows if named is None else named.unionByName(rows)
    rate = lambda unit, v, only=F.lit(True): F.sum(F.when(only, F.col(f"{unit}_err_{v}"))) / F.nullif(F.sum(F.when(only, F.col(f"{unit}_len_{v}"))), F.lit(0))
    labels = ("SELLER", "ADDRESS", "TIMESTAMP", "TOTAL_COST")
    return named.groupBy("run").agg(F.count(F.lit(1)).alias("regions"), F.avg("matched").alias("region_coverage"), rate("char", "exact").alias("cer_exact"), rate("word", "exact").alias("wer_exact"), rate("char", "nocase").alias("cer_nocase"), rate("char", "nodiac").alias("cer_nodiac"), *[rate("char", "exact", F.col("label") == x).alias(f"cer_{x.lower()}") for x in labels])
