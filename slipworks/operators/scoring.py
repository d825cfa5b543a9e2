"""Scoring extracted fields against labelled regions, and turning what rules say of a field into a probability."""

from __future__ import annotations

import json
from collections.abc import Callable
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slipworks.functions.text import whole_forms
from slipworks.functions.values import logit, parse_date, parse_time, parse_vnd
from slipworks.operators import stats

#: Error rate up to which a name or an address counts as right.
CLOSE = 0.25
#: Fields of which the probability of a whole page is made, with the score that says whether each is right.
SCORE_OF = {"merchant_name": "seller", "date": "date", "total": "total"}
SCORES = ("total", "date", "time", "seller", "address")

# The rules of totals that are features, and the features of each field in their order.
TOTAL_RULES = ("keyword:same_line", "keyword:same_row", "keyword:next_row")
FEATURES = {
    "merchant_name": ("logit_conf", "ocr_conf", "mean_rec", "brand", "first_line", "index"),
    "date": ("logit_conf", "ocr_conf", "mean_rec", "keyword", "n_distinct_gt1", "agree2"),
    "total": ("logit_conf", "ocr_conf", "mean_rec", *TOTAL_RULES, "agree2", "is_max", "distinct_gt1", "strong_key"),
}


def page_scores(regions: DataFrame, fields: DataFrame, required: tuple[str, ...] = ("total", "date", "seller")) -> DataFrame:
    """(image_id, total, date, time, seller, address, seller_err, seller_len, address_err, address_len, doc_correct) of every page
    of ``fields``: 1 where a field is right, 0 where it isn't, null where no region says.

    ``regions`` are those of ``spatial.regions_of``, ``fields`` has image_id, merchant_name, merchant_address, date, time and total
    as strings. Amounts and dates are right if a region means the same. A name is measured against the region that it is
    nearest to, of equals the first, an address against all regions of addresses from top to bottom; both without case, and
    both are right up to an error rate of ``CLOSE``. A page is right if all required fields are that have a score.
    """
    v = regions.where((F.col("role") == "value") & (F.trim("text") != ""))
    meant = lambda label, parse: F.collect_set(F.when(F.col("label") == label, parse(F.col("text")).cast("string")))
    address = F.array_sort(F.collect_list(F.when(F.col("label") == "ADDRESS", F.struct("y", "x", "region_id", F.trim("text").alias("t")))))
    truth = v.groupBy(F.col("image_id").alias("i")).agg(meant("TOTAL_COST", parse_vnd).alias("totals"), meant("TIMESTAMP", parse_date).alias("dates"), meant("TIMESTAMP", parse_time).alias("times"), F.nullif(F.array_join(F.transform(address, lambda s: s["t"]), " "), F.lit("")).alias("address_ref"))
    names = v.where("label = 'SELLER'").select(F.col("image_id").alias("n"), "region_id", F.col("text").alias("ref")).join(fields.select("image_id", "merchant_name"), F.col("n") == F.col("image_id"))
    names = names.withColumn("a", whole_forms(F.col("ref"))).withColumn("b", whole_forms(F.coalesce("merchant_name", F.lit(""))))
    names = names.select("n", "region_id", F.levenshtein("a.nocase", "b.nocase").alias("err"), F.length("a.nocase").alias("len"))
    best = names.groupBy("n").agg(F.min_by(F.struct("err", "len"), F.struct(F.col("err") / F.greatest("len", F.lit(1)), "region_id")).alias("s")).select("n", F.col("s.err").alias("seller_err"), F.col("s.len").alias("seller_len"))
    rows = fields.select("image_id", "merchant_address", "date", "time", "total").join(truth, F.col("image_id") == F.col("i"), "left").join(best, F.col("image_id") == F.col("n"), "left")
    rows = rows.withColumn("a", whole_forms(F.col("address_ref"))).withColumn("b", whole_forms(F.coalesce("merchant_address", F.lit(""))))
    given = F.col("address_ref").isNotNull()
    rows = rows.withColumn("address_err", F.when(given, F.levenshtein("a.nocase", "b.nocase"))).withColumn("address_len", F.when(given, F.length("a.nocase")))
    among = lambda value, held: F.when(F.size(held) > 0, F.coalesce(F.array_contains(held, F.col(value)), F.lit(False)).cast("int"))
    near = lambda name: F.when(F.col(f"{name}_err").isNotNull(), (F.col(f"{name}_err") <= CLOSE * F.col(f"{name}_len")).cast("int"))
    scored = rows.select("image_id", among("total", "totals").alias("total"), among("date", "dates").alias("date"), among("time", "times").alias("time"), near("seller").alias("seller"), near("address").alias("address"), "seller_err", "seller_len", "address_err", "address_len")
    return scored.withColumn("doc_correct", F.array_min(F.array_compact(F.array(*required))))


def score_report(scores: DataFrame, group: str, draws: int = 1000, seed: int = 42) -> DataFrame:
    """(field, n, correct, accuracy, low, high, cer_nocase): each score over the pages that have it, with an interval over draws of
    groups, and the error rate of names and addresses. A field without any page has no row."""
    names = [*SCORES, "doc_correct"]
    each = scores.select(F.col(group).alias("g"), "image_id", "seller_err", "seller_len", "address_err", "address_len", F.explode(F.array(*[F.struct(F.lit(n).alias("field"), F.col(n).alias("y")) for n in names])).alias("x")).select("*", "x.*").where("y is not null")
    each = each.withColumn("n", F.lit(1)).withColumn("err", F.when(F.col("field") == "seller", F.col("seller_err")).when(F.col("field") == "address", F.col("address_err"))).withColumn("len", F.when(F.col("field") == "seller", F.col("seller_len")).when(F.col("field") == "address", F.col("address_len")))
    plain = each.groupBy("field").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("correct"), (F.sum("err") / F.nullif(F.sum("len"), F.lit(0))).alias("cer_nocase"))
    intervals = stats.bootstrap_intervals(each, ["field"], "g", "image_id", {"y": stats.Ratio("y", "n")}, draws, seed=seed).select(F.col("field").alias("f"), F.col("value").alias("accuracy"), "low", "high")
    return plain.join(intervals, F.col("field") == F.col("f")).select("field", "n", "correct", "accuracy", "low", "high", "cer_nocase")


def as_results(extracted: DataFrame) -> DataFrame:
    """(image_id, field_key, value, confidence, rule, features, mean_rec) of the rows of ``extract.extract_fields``."""
    keys = ("merchant_name", "merchant_address", "date", "time", "total")
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("field_key"), *[F.col(f"{k}.{c}").alias(c) for c in ("value", "confidence", "rule", "features")]) for k in keys]))
    return extracted.select("image_id", F.col("mean_rec_score").alias("mean_rec"), each.alias("x")).select("image_id", "x.*", "mean_rec")


def field_vector(field: str) -> Column:
    """The features of a field, in the order of ``FEATURES``, from value, confidence, rule, features and mean_rec. What a rule
    didn't say is 0, the place of a title 9, and a page without a mean score 0.5."""
    said = lambda name, none=0.0: F.coalesce(F.try_element_at("features", F.lit(name)), F.lit(none))
    yes = lambda c: F.coalesce(c, F.lit(False)).cast("double")
    made = {
        "logit_conf": logit(F.col("confidence")), "ocr_conf": said("ocr_conf"), "mean_rec": F.coalesce("mean_rec", F.lit(0.5)), "brand": said("brand"), "first_line": yes(said("index", 9.0) == 0), "index": said("index", 9.0),
        "keyword": said("keyword"), "n_distinct_gt1": yes(said("n_distinct") > 1), "agree2": yes(said("agree") >= 2), "is_max": said("is_max"), "distinct_gt1": yes(said("distinct") > 1), "strong_key": yes(said("key_weight") >= 3),
    } | {r: yes(F.col("rule") == r) for r in TOTAL_RULES}
    return F.array(*[made[name].cast("double") for name in FEATURES[field]])


class Calibrator(NamedTuple):
    """A fitted model for each field, and what it was fitted on."""

    models: dict[str, dict]
    meta: dict

    def to_json(self) -> str:
        return json.dumps({"meta": self.meta, "models": {k: m | {"features": list(FEATURES[k])} for k, m in self.models.items()}}, ensure_ascii=False, sort_keys=True)

    @classmethod
    def from_json(cls, text: str) -> Calibrator:
        """Refuses models over other features than those of today."""
        data = json.loads(text)
        stale = [k for k, m in data["models"].items() if tuple(m.get("features", ())) != FEATURES.get(k)]
        if stale:
            raise ValueError(f"the models of {', '.join(sorted(stale))} were fitted on other features; fit them again")
        return cls({k: {c: v for c, v in m.items() if c != "features"} for k, m in data["models"].items()}, data["meta"])

    def saw(self, run: str) -> bool:
        """Whether it was fitted on a run, so that its probabilities say nothing new about that run."""
        return run in self.meta.get("runs", [])

    def probability(self) -> Column:
        """The probability of a row of results; 0 without a value, null for a field without a model."""
        out = F.lit(None).cast("double")
        for field, model in self.models.items():
            x = field_vector(field)
            p = stats.logistic_score([F.get(x, F.lit(i)) for i in range(len(FEATURES[field]))], model)
            out = F.when(F.col("field_key") == field, F.when(F.col("value").isNull(), 0.0).otherwise(p)).otherwise(out)
        return out


def page_probabilities(results: DataFrame, calibrator: Calibrator) -> DataFrame:
    """(image_id, fields, probability, product): the least and the product of the probabilities of a page's fields that have a
    model; fields that are missing count as 0."""
    each = results.where(F.col("field_key").isin(*calibrator.models)).select("image_id", "field_key", calibrator.probability().alias("p"))
    n, k = F.countDistinct("field_key"), len(calibrator.models)
    return each.groupBy("image_id").agg(n.cast("int").alias("fields"), F.when(n < k, 0.0).otherwise(F.min("p")).alias("probability"), F.when((n < k) | (F.min("p") <= 0), 0.0).otherwise(F.exp(F.sum(F.ln(F.greatest("p", F.lit(1e-300)))))).alias("product"))


def labelled_results(results: DataFrame, scores: DataFrame) -> DataFrame:
    """Results of the fields of ``SCORE_OF`` with whether each is right (label, null where no region says) and the page's group_id.
    ``scores`` has group_id beside the columns of ``page_scores``."""
    of = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.col(s).alias("label")) for k, s in SCORE_OF.items()]))
    labels = scores.select(F.col("image_id").alias("i"), "group_id", of.alias("x")).select("i", "group_id", "x.*")
    return results.join(labels, (F.col("image_id") == F.col("i")) & (F.col("field_key") == F.col("k"))).drop("i", "k")


def _fit_rows(labelled: DataFrame, field: str) -> DataFrame:
    rows = labelled.where((F.col("field_key") == field) & F.col("value").isNotNull() & F.col("label").isNotNull())
    x = field_vector(field)
    named = rows.select("image_id", F.coalesce("group_id", F.concat(F.lit("i:"), "image_id")).alias("g"), F.col("label").cast("double").alias("y"), *[F.get(x, F.lit(i)).alias(f"x{i}") for i in range(len(FEATURES[field]))])
    return stats.with_group_weights(named, "g")


def fit_calibrator(labelled: DataFrame, runs: list[str], l2: float = 1.0) -> Calibrator:
    """A model for each field over the results that have a value and a label; every group weighs the same."""
    models = {}
    for field, features in FEATURES.items():
        models[field] = stats.fit_logistic(_fit_rows(labelled, field).cache(), [f"x{i}" for i in range(len(features))], "y", "w", l2)
    n = labelled.agg(F.countDistinct("image_id").alias("documents"), F.countDistinct("group_id").alias("groups")).first()
    return Calibrator(models, {"documents": n["documents"], "groups": n["groups"], "l2": l2, "runs": sorted(runs)})


def unseen_probabilities(labelled: DataFrame, folds: int = 10, repeats: int = 5, seed: int = 42) -> DataFrame:
    """(image_id, field_key, prob) of every result that has a value and a label, by models that never saw its group."""
    parts = []
    for field, features in FEATURES.items():
        rows = _fit_rows(labelled, field).drop("w").cache()
        parts.append(stats.grouped_out_of_fold(rows, "image_id", "g", [f"x{i}" for i in range(len(features))], "y", folds, repeats, seed).select("image_id", F.lit(field).alias("field_key"), "prob"))
    return reduce(DataFrame.union, parts)


def calibration_report(pages: DataFrame, label: str, group: str, methods: dict[str, Callable[[], Column]] | dict[str, Column]) -> DataFrame:
    """(method, n, brier, auroc, ece): how well each confidence of a page says whether it is right; every group weighs the same.
    ``methods`` are columns of ``pages``; pages without a label are left out."""
    rows = stats.with_group_weights(pages.where(F.col(label).isNotNull()), group, "_w")
    out = []
    for name, column in methods.items():
        each = rows.select(column.alias("p"), F.col(label).alias("y"), F.col("_w").alias("w"))
        figures = [stats.brier_log_loss(each, "p", "y", "w").select(F.lit("brier").alias("k"), F.col("brier").alias("v")), stats.auroc(each, "p", "y", "w").select(F.lit("auroc"), "auroc"), stats.calibration_error(each, "p", "y", "w").select(F.lit("ece"), "ece"), each.agg(F.count(F.lit(1)).cast("double").alias("n")).select(F.lit("n"), "n")]
        out.append(reduce(DataFrame.union, figures).withColumn("method", F.lit(name)))
    pick = lambda k: F.max(F.when(F.col("k") == k, F.col("v"))).alias(k)
    return reduce(DataFrame.union, out).groupBy("method").agg(pick("n").cast("bigint").alias("n"), pick("brier"), pick("auroc"), pick("ece"))


def plain_risk_coverage(pages: DataFrame, confidence: str, label: str, taus: list[float]) -> DataFrame:
    """(tau, documents, coverage, error_rate) over pages with a label, each counted once, by the confidence as it is stored, with
    four decimals."""
    rows = pages.where(F.col(label).isNotNull()).select(F.round(confidence, 4).alias("p"), F.col(label).alias("y"), F.lit(1.0).alias("w"))
    return stats.risk_coverage(rows, "p", "y", "w", taus)
