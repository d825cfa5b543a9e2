"""Queries over labelled regions, scores, calibration, crops and integrity, each with its SQL where SQL can state it."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slipworks.operators import corpus, crops, evaluation, images, integrity, runs, scoring, spatial
from slipworks.plans.registry import _QUERIES, _REGIONS, _SQL, _extracted, _lines, _manifest, _shared, _sql_norm, query
from slipworks.session import Workspace
from slipworks.sources import documents, files
from slipworks.sources.tables import table

__all__ = ["_QUERIES", "_SQL"]

#: Recognition score from which on the second of two compared runs keeps a line.
KEPT = 0.6
TAUS = [0.0, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 0.95]

# Models that were fitted on 194 documents of 70 groups.
MODELS = {
    "merchant_name": {"mean": [0.9114131178541379, 0.8757217957661312, 0.8762614457831328, 0.5662650602409639, 0.6746987951807228, 0.536144578313253], "std": [0.6775961246889393, 0.08768304873560909, 0.034194143905466955, 0.49558948918561746, 0.46848727940297785, 0.9483121738631819], "coef": [-0.04925161973734021, 1.0617587098850756, 1.5832094523244415, 0.24159816785965707, 1.0760722394618827, -0.026350269347122392], "intercept": 0.9128427835084417},
    "date": {"mean": [1.526597268407698, 0.8950292337995398, 0.8826503546099291, 0.7021276595744681, 0.028368794326241134, 0.15602836879432624], "std": [0.4973319901709363, 0.05546632197877985, 0.02650823135672175, 0.4573230906426523, 0.16602411220878893, 0.36288223561605804], "coef": [-0.5489170400013581, 0.23159624761031888, 1.0298851177141668, 0.6989447940732867, -0.3162245825387093, 0.5437167538761832], "intercept": 3.9268967743392205},
    "total": {"mean": [1.4440266248915077, 0.8994950413142222, 0.8790425000000001, 0.0375, 0.8, 0.1, 0.4, 0.68125, 0.18125, 0.54375], "std": [0.972033601811401, 0.06275109847324117, 0.03041940077894369, 0.18998355191963273, 0.39999999999999947, 0.2999999999999998, 0.48989794855663515, 0.46599188565896793, 0.38522517765587394, 0.49808225977241977], "coef": [1.2615029231101498, -0.3889814030120711, 0.783591245659684, 0.47045182531616603, 0.26934684005864085, -0.13246108894711608, 0.4961347536092529, -0.026806152393502137, -1.0297249317293795, -0.42637347205066695], "intercept": 2.401772799274038},
}
CALIBRATOR = scoring.Calibrator(MODELS, {"documents": 194, "groups": 70, "runs": []})


# Regions


@query(f"WITH {_REGIONS} SELECT image_id, row_number() OVER (PARTITION BY image_id ORDER BY bbox[2], bbox[1], region_id) - 1 AS place, region_id, label, role, text FROM regions")
def sorted_regions(spark: SparkSession, folder: str) -> DataFrame:
    return evaluation.sorted_regions(_manifest(spark, folder)).withColumn("place", F.col("place").cast("bigint"))


@query(f"WITH {_REGIONS} SELECT image_id, region_id, label, role, text FROM regions WHERE least(bbox[3], bbox[4]) >= 24 AND trim(text) <> ''")
def valid_regions(spark: SparkSession, folder: str) -> DataFrame:
    return evaluation.valid_regions(_manifest(spark, folder), 24).select("image_id", "region_id", "label", "role", "text")


@query("WITH m AS (SELECT image_id, any_value(regions) AS r FROM ocr_manifest GROUP BY image_id) SELECT image_id, cast(coalesce(len(r), 0) AS INT) AS regions, cast(coalesce(len(r), 0) - coalesce(len(list_filter(r, lambda x: least(x.bbox[3], x.bbox[4]) >= 24 AND trim(x.text) <> '')), 0) AS INT) AS skipped FROM m")
def skipped_regions(spark: SparkSession, folder: str) -> DataFrame:
    return evaluation.skipped_regions(_manifest(spark, folder), 24)


_READ = "read AS (SELECT DISTINCT image_id, line_no, coalesce(text, '') AS text, coalesce(rec_score, 0.5) AS score, polygon FROM ocr_lines WHERE len(polygon) > 0)"


@query(f"WITH {_READ} SELECT image_id, count(*) AS lines, cast(count(*) AS INT) AS places, true AS rows_in_order FROM read GROUP BY 1")
def reading_invariants(spark: SparkSession, folder: str) -> DataFrame:
    """What must hold of the reading order: every line once, places from 0 on without a gap, and rows one after the other, each
    from its first place on."""
    read = spatial.reading_order(table(spark, folder, "ocr_lines"))
    starts = F.count(F.when(F.col("pos") == 0, 1)) == F.max("row") + 1
    later = F.max(F.col("idx") - F.col("pos")) <= F.max("idx")
    return read.groupBy("image_id").agg(F.count(F.lit(1)).alias("lines"), (F.max("idx") + 1).alias("places"), (starts & later & (F.countDistinct("idx") == F.count(F.lit(1)))).alias("rows_in_order"))


@query(f"WITH {_READ} SELECT image_id, cast(count(*) AS INT) AS lines, round(avg(score), 6) AS mean_rec_score FROM read GROUP BY 1")
def extracted_pages(spark: SparkSession, folder: str) -> DataFrame:
    """The pages of which fields were extracted, with how many lines each had and how well they were read. What a binary sum
    loses is rounded away first, so that a mean halfway between two values goes up whatever the order of its scores."""
    return _extracted(spark, folder).select("image_id", "lines", F.round(F.round("mean_rec_score", 12), 6).alias("mean_rec_score"))


@query(f"""
    WITH {_REGIONS} SELECT image_id, nullif(string_agg(coalesce(text, ''), ' ' ORDER BY region_id) FILTER (label = 'SELLER'), '') AS merchant_name, nullif(string_agg(coalesce(text, ''), ' ' ORDER BY region_id) FILTER (label = 'ADDRESS'), '') AS merchant_address
    FROM regions WHERE role = 'value' GROUP BY image_id""")
def ground_truth_names(spark: SparkSession, folder: str) -> DataFrame:
    return corpus.ground_truth(spatial.regions_of(_manifest(spark, folder))).select("image_id", "merchant_name", "merchant_address")


# Evaluation


def _evaluated(spark: SparkSession, folder: str, least_score: float | None = None) -> DataFrame:
    lines = table(spark, folder, "ocr_lines")
    lines = lines if least_score is None else lines.where(F.col("rec_score") >= least_score)
    return evaluation.evaluation_rows(lines, _manifest(spark, folder))


def _stored(spark: SparkSession, folder: str, least_score: float | None = None) -> DataFrame:
    return Workspace(spark, "evaluated").write(_evaluated(spark, folder, least_score), "rows")[0]


@query()
def evaluation_rows(spark: SparkSession, folder: str) -> DataFrame:
    return _evaluated(spark, folder)


@query()
def region_report(spark: SparkSession, folder: str) -> DataFrame:
    """Coverage, exact matches and error rates with intervals, over all and by label, role and quality."""
    return evaluation.slice_report(_stored(spark, folder))


@query()
def normalised_accuracy(spark: SparkSession, folder: str) -> DataFrame:
    return evaluation.normalised_accuracy(_stored(spark, folder))


@query()
def corpus_metrics(spark: SparkSession, folder: str) -> DataFrame:
    return evaluation.corpus_metrics(_stored(spark, folder))


@query()
def run_comparison(spark: SparkSession, folder: str) -> DataFrame:
    """All lines against those that were read with some certainty, over the same regions."""
    return evaluation.compare_runs(_stored(spark, folder), _stored(spark, folder, KEPT))


@query()
def run_summary(spark: SparkSession, folder: str) -> DataFrame:
    return evaluation.summarise_runs({"all": _stored(spark, folder), "certain": _stored(spark, folder, KEPT)})


@query(f"""
    WITH {_REGIONS}, b AS (SELECT image_id, region_id, text AS ref FROM regions WHERE least(bbox[3], bbox[4]) >= 8 AND trim(text) <> ''), c AS (SELECT image_id, region_id, text AS ref FROM regions WHERE least(bbox[3], bbox[4]) >= 24 AND trim(text) <> '')
    SELECT *, 'base' AS side FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM c) UNION ALL SELECT *, 'candidate' FROM (SELECT * FROM c EXCEPT ALL SELECT * FROM b)""")
def population_differences(spark: SparkSession, folder: str) -> DataFrame:
    """What two runs with other least sides of a region don't have in common."""
    one, other = (evaluation.valid_regions(_manifest(spark, folder), side).withColumnRenamed("text", "ref") for side in (8, 24))
    return evaluation.population_differences(one, other)


# Scores and calibration


def _scored(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """(results, scores with group_id) of all pages, stored."""
    work = Workspace(spark, "scored")
    found, _ = work.write(_extracted(spark, folder), "fields")
    pages = _manifest(spark, folder)
    names = ("merchant_name", "merchant_address", "date", "time", "total")
    scores = scoring.page_scores(spatial.regions_of(pages), found.select("image_id", *[F.col(f"{n}.value").alias(n) for n in names]))
    of = pages.select(F.col("image_id").alias("i"), F.coalesce("group_id", F.concat(F.lit("i:"), "image_id")).alias("group_id"))
    scores, _ = work.write(scores.join(of, F.col("image_id") == F.col("i")).drop("i"), "scores")
    return scoring.as_results(found), scores


@query()
def page_scores(spark: SparkSession, folder: str) -> DataFrame:
    return _scored(spark, folder)[1]


@query()
def score_report(spark: SparkSession, folder: str) -> DataFrame:
    return scoring.score_report(_scored(spark, folder)[1], "group_id")


def _given_results(spark: SparkSession, folder: str) -> DataFrame:
    """The results as they are stored, with the mean score of their page's lines."""
    mean = _lines(spark, folder).groupBy(F.col("image_id").alias("i")).agg(F.avg("rec_score").alias("mean_rec"))
    results = table(spark, folder, "field_results").dropDuplicates(["result_id"])
    return results.join(mean, F.col("image_id") == F.col("i"), "left").drop("i")


def _sql_probability() -> str:
    said = lambda k, none="0.0": f"coalesce(features['{k}'], {none})"
    of = {"logit_conf": "ln(least(greatest(confidence, 1e-3), 1 - 1e-3) / (1 - least(greatest(confidence, 1e-3), 1 - 1e-3)))", "ocr_conf": said("ocr_conf"), "mean_rec": "coalesce(mean_rec, 0.5)", "brand": said("brand"), "first_line": f"cast({said('index', '9.0')} = 0 AS INT)", "index": said("index", "9.0"), "keyword": said("keyword"), "n_distinct_gt1": f"cast({said('n_distinct')} > 1 AS INT)", "agree2": f"cast({said('agree')} >= 2 AS INT)", "is_max": said("is_max"), "distinct_gt1": f"cast({said('distinct')} > 1 AS INT)", "strong_key": f"cast({said('key_weight')} >= 3 AS INT)"} | {r: f"cast(rule IS NOT DISTINCT FROM '{r}' AS INT)" for r in scoring.TOTAL_RULES}
    cases = []
    for field, m in MODELS.items():
        z = " + ".join([repr(m["intercept"]), *[f"({of[name]} - {a!r}) / {b!r} * {c!r}" for name, a, b, c in zip(scoring.FEATURES[field], m["mean"], m["std"], m["coef"])]])
        cases.append(f"WHEN field_key = '{field}' THEN CASE WHEN value IS NULL THEN 0.0 ELSE 1 / (1 + exp(-least(greatest({z}, -30), 30))) END")
    return f"CASE {' '.join(cases)} END"


_PROBABLE = f"""
    l AS (SELECT line_id, any_value(image_id) AS image_id, any_value(rec_score) AS s FROM ocr_lines GROUP BY line_id), q AS (SELECT image_id AS i, avg(s) AS mean_rec FROM l GROUP BY 1),
    r AS (SELECT result_id, any_value(image_id) AS image_id, any_value(field_key) AS field_key, any_value(value) AS value, any_value(confidence) AS confidence, any_value(rule) AS rule, any_value(features) AS features FROM field_results GROUP BY result_id),
    p AS (SELECT result_id, image_id, field_key, {_sql_probability()} AS p FROM r LEFT JOIN q ON image_id = i WHERE field_key IN ('merchant_name', 'date', 'total'))"""


@query(f"WITH {_PROBABLE} SELECT result_id, field_key, round(p, 6) AS probability FROM p")
def field_probabilities(spark: SparkSession, folder: str) -> DataFrame:
    """The stored results by the fixed models."""
    rows = _given_results(spark, folder).where(F.col("field_key").isin(*MODELS))
    return rows.select("result_id", "field_key", F.round(CALIBRATOR.probability(), 6).alias("probability"))


@query(f"WITH {_PROBABLE} SELECT image_id, cast(count(DISTINCT field_key) AS INT) AS fields, round(CASE WHEN count(DISTINCT field_key) < 3 THEN 0.0 ELSE min(p) END, 6) AS probability FROM p GROUP BY image_id")
def page_probabilities(spark: SparkSession, folder: str) -> DataFrame:
    return scoring.page_probabilities(_given_results(spark, folder), CALIBRATOR).select("image_id", "fields", F.round("probability", 6).alias("probability"))


@query()
def fitted_calibrator(spark: SparkSession, folder: str) -> DataFrame:
    """(field, feature, coefficient) of models fitted on the extracted fields of all pages that have a score."""
    results, scores = _scored(spark, folder)
    fitted = scoring.Calibrator.from_json(scoring.fit_calibrator(scoring.labelled_results(results, scores), [folder]).to_json())
    rows = [(k, n, float(c)) for k, m in fitted.models.items() for n, c in zip(("intercept", *scoring.FEATURES[k]), (m["intercept"], *m["coef"]))]
    return spark.createDataFrame(rows, "field string, feature string, coefficient double")


@query()
def calibration_report(spark: SparkSession, folder: str) -> DataFrame:
    """How well the least raw confidence, the least probability and their product say whether a page is right; probabilities are
    of models that never saw the page's group."""
    results, scores = _scored(spark, folder)
    labelled = scoring.labelled_results(results, scores)
    unseen = scoring.unseen_probabilities(labelled)
    fields = list(scoring.FEATURES)
    each = labelled.select("image_id", "field_key", F.when(F.col("value").isNull(), 0.0).otherwise(F.col("confidence")).alias("raw"), F.col("value").isNull().alias("none"))
    of = unseen.select(F.col("image_id").alias("i"), F.col("field_key").alias("k"), "prob")
    both = each.join(of, (F.col("image_id") == F.col("i")) & (F.col("field_key") == F.col("k")), "left").where(F.col("none") | F.col("prob").isNotNull())
    p = F.when(F.col("none"), 0.0).otherwise(F.col("prob"))
    pages = both.where(F.col("field_key").isin(*fields)).groupBy(F.col("image_id").alias("p")).agg(F.min("raw").alias("raw"), F.min(p).alias("least"), F.product(p).alias("product"))
    rows, _ = Workspace(spark, "calibration").write(pages.join(scores, F.col("p") == F.col("image_id")).select("image_id", "group_id", "doc_correct", "raw", "least", "product"), "pages")
    return scoring.calibration_report(rows, "doc_correct", "group_id", {c: F.col(c) for c in ("raw", "least", "product")})


_RECEIPTS = """
    r AS (SELECT id, any_value(image_id) AS image_id, cast(round(any_value(doc_confidence), 4) AS DOUBLE) AS p, any_value(total_amount) AS total FROM receipts GROUP BY id), m AS (SELECT image_id, any_value(gt).total AS truth FROM ocr_manifest GROUP BY image_id),
    s AS (SELECT p, cast(total = truth AS INT) AS y FROM r JOIN m USING (image_id) WHERE total IS NOT NULL AND truth IS NOT NULL AND p IS NOT NULL)"""


@query(f"WITH {_RECEIPTS}, t AS (SELECT unnest({TAUS}::DOUBLE[]) AS tau) SELECT tau, count(*) FILTER (p >= tau) AS documents, round(count(*) FILTER (p >= tau) / count(*), 6) AS coverage, round(1 - sum(y) FILTER (p >= tau) / nullif(count(*) FILTER (p >= tau), 0), 6) AS error_rate FROM s, t GROUP BY tau")
def plain_risk_coverage(spark: SparkSession, folder: str) -> DataFrame:
    """How many receipts a threshold of their stored confidence lets through, and how many of these have a wrong total."""
    receipts = table(spark, folder, "receipts").dropDuplicates(["id"]).select("image_id", F.col("doc_confidence").cast("double").alias("c"), "total_amount")
    truth = _manifest(spark, folder).select(F.col("image_id").alias("i"), F.col("gt.total").alias("truth"))
    pages = receipts.join(truth, F.col("image_id") == F.col("i")).where("total_amount is not null and truth is not null and c is not null").withColumn("right", (F.col("total_amount") == F.col("truth")).cast("int"))
    out = scoring.plain_risk_coverage(pages, "c", "right", TAUS)
    return out.select("tau", "documents", F.round("coverage", 6).alias("coverage"), F.round("error_rate", 6).alias("error_rate"))


# Crops


def _crops(spark: SparkSession, folder: str) -> DataFrame:
    """The labelled regions as crops: named by page and number, hashed by their text and size for want of pixels."""
    pages = _manifest(spark, folder)
    split = pages.select(F.col("image_id").alias("i"), F.lower(F.trim("split")).alias("split"), "group_id")
    regions = spatial.regions_of(pages).join(split, F.col("image_id") == F.col("i"))
    name = F.concat(F.regexp_replace("image_id", r"\.jpg$", ""), F.lit("_"), "region_id")
    pixels = F.sha2(F.concat_ws("x", F.col("w").cast("int"), F.col("h").cast("int"), F.lower(F.coalesce("text", F.lit("")))), 256)
    return regions.select(name.alias("sample_id"), "image_id", F.col("region_id").alias("source_index"), "split", "group_id", "text", pixels.alias("pixel_hash"), F.col("w").alias("width"), F.col("h").alias("height"))


_CROPS = rf"""
    {_REGIONS}, pages AS (SELECT image_id AS i, lower(trim(any_value(split))) AS split, any_value(group_id) AS group_id FROM ocr_manifest GROUP BY image_id),
    crops AS (SELECT regexp_replace(image_id, '\.jpg$', '') || '_' || region_id AS sample_id, image_id, region_id AS source_index, split, group_id, text, sha256(concat_ws('x', bbox[3], bbox[4], lower(coalesce(text, '')))) AS pixel_hash, bbox[3] AS width, bbox[4] AS height FROM regions JOIN pages ON image_id = i)"""


@query(f"""
    WITH {_CROPS}, n AS (SELECT *, {_sql_norm('text')} AS t FROM crops),
    k AS (SELECT pixel_hash AS h, count(*) AS n, min(t) AS t0, max(t) AS t1, min(split) AS s0, max(split) AS s1 FROM n GROUP BY 1 HAVING count(*) > 1)
    SELECT DISTINCT sample_id, 'empty_text' AS reason FROM n WHERE t = '' UNION ALL SELECT DISTINCT sample_id, 'bad_shape_or_length' FROM n WHERE least(width, height) < 8 OR length(t) > 100
    UNION ALL SELECT DISTINCT sample_id, CASE WHEN t0 <> t1 THEN 'conflicting_text' WHEN s0 <> s1 THEN 'cross_split_duplicate' ELSE 'duplicate_pixels' END FROM n JOIN k ON pixel_hash = h""")
def crop_issues(spark: SparkSession, folder: str) -> DataFrame:
    pages = _manifest(spark, folder)
    of = pages.select("image_id", F.lower(F.trim("split")).alias("split"), "group_id")
    packed = pages.select("image_id", F.transform("regions", lambda r: r["text"]).alias("t"), F.transform("regions", lambda r: r["label"]).alias("l"))
    return crops.crop_issues(_crops(spark, folder), of, crops.source_texts(packed, "t", "l"))


def _corrections(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "label_corrections").dropDuplicates(["correction_id"]).withColumn("rotation_deg", F.lit(0))


_FAULTS = f"""
    {_CROPS}, c AS (SELECT correction_id, any_value(sample_id) AS sample_id, {_sql_norm('any_value(old_text)')} AS o, {_sql_norm('any_value(new_text)')} AS n, any_value(action) AS action, any_value(evidence) AS evidence FROM label_corrections GROUP BY correction_id),
    s AS (SELECT sample_id AS s, any_value({_sql_norm('text')}) AS t FROM crops GROUP BY 1), j AS (SELECT * FROM c LEFT JOIN s ON sample_id = s),
    faults AS (SELECT DISTINCT sample_id, unnest(list_filter([CASE WHEN s IS NULL THEN 'unknown' END, CASE WHEN s IS NOT NULL AND t <> o THEN 'stale' END, CASE WHEN trim(coalesce(evidence, '')) = '' THEN 'no_evidence' END, CASE WHEN NOT coalesce(action IN ('correct_text', 'rotate', 'exclude'), false) THEN 'bad_action' END, CASE WHEN action = 'correct_text' AND n = '' THEN 'empty_text' END, CASE WHEN action = 'rotate' THEN 'bad_rotation' END], lambda x: x IS NOT NULL)) AS fault FROM j
    UNION ALL SELECT sample_id, 'repeated' FROM c GROUP BY sample_id HAVING count(*) > 1)"""


@query(f"WITH {_FAULTS} SELECT sample_id, fault FROM faults")
def correction_faults(spark: SparkSession, folder: str) -> DataFrame:
    return crops.correction_faults(_corrections(spark, folder), _crops(spark, folder))


@query(f"""
    WITH {_FAULTS}, good AS (SELECT * FROM c WHERE sample_id NOT IN (SELECT sample_id FROM faults WHERE sample_id IS NOT NULL) AND sample_id IS NOT NULL)
    SELECT a.sample_id, {_sql_norm("CASE WHEN g.action = 'correct_text' THEN g.n ELSE a.text END")} AS text, g.sample_id IS NOT NULL AS reviewed FROM crops a LEFT JOIN good g ON g.sample_id = a.sample_id WHERE g.action IS DISTINCT FROM 'exclude'""")
def corrected_crops(spark: SparkSession, folder: str) -> DataFrame:
    """All crops with the corrections that have no fault applied."""
    all_, given = _crops(spark, folder), _corrections(spark, folder).where("sample_id is not null")
    wrong = crops.correction_faults(given, all_).select(F.col("sample_id").alias("x")).where("x is not null").distinct()
    return crops.apply_corrections(all_, given.join(wrong, F.col("sample_id") == F.col("x"), "left_anti")).select("sample_id", "text", "reviewed")


@query(f"""
    WITH {_CROPS}, t AS (SELECT unnest([struct_pack(mark := 'sample_id', value := sample_id), struct_pack(mark := 'group_id', value := group_id), struct_pack(mark := 'pixel_hash', value := pixel_hash)]) AS m, split FROM crops)
    SELECT m.mark AS mark, m.value AS value FROM t WHERE m.value IS NOT NULL AND split = 'train' INTERSECT SELECT m.mark, m.value FROM t WHERE m.value IS NOT NULL AND split = 'val'""")
def shared_between_splits(spark: SparkSession, folder: str) -> DataFrame:
    return crops.shared_between_splits(_crops(spark, folder))


# Integrity


_PAGES = "pages AS (SELECT image_id, any_value(regions) AS regions, any_value(width) AS width, any_value(height) AS height, any_value(image_hash) AS image_hash FROM ocr_manifest GROUP BY image_id)"


@query(f"""
    WITH {_PAGES}, each AS (SELECT image_id AS who, unnest(list_filter([
        CASE WHEN width IS NULL OR height IS NULL THEN 'size_missing' END,
        CASE WHEN len(list_filter(regions, lambda r: r.bbox[1] < 0 OR r.bbox[2] < 0 OR r.bbox[1] + r.bbox[3] > width + 2 OR r.bbox[2] + r.bbox[4] > height + 2 OR r.bbox[3] <= 0 OR r.bbox[4] <= 0)) > 0 THEN 'box_out_of_bounds' END,
        CASE WHEN len(list_filter(regions, lambda r: len(list_filter(r.polygon, lambda p: p[1] < -2 OR p[2] < -2 OR p[1] > width + 2 OR p[2] > height + 2)) > 0)) > 0 THEN 'polygon_out_of_bounds' END,
        CASE WHEN coalesce(len(regions), 0) = 0 THEN 'texts_missing' END, CASE WHEN image_hash IS NULL THEN 'hash_missing' END], lambda x: x IS NOT NULL)) AS kind FROM pages),
    problems AS (SELECT kind, who FROM each UNION ALL SELECT 'empty_text', image_id FROM (SELECT image_id, unnest(regions) AS r FROM pages) WHERE trim(coalesce(r.text, '')) = '' UNION ALL SELECT 'duplicate_image_id', image_id FROM ocr_manifest GROUP BY image_id HAVING count(*) > 1)
    SELECT kind, count(*) AS n, array_to_string(list_sort(list(DISTINCT who))[1:3], ',') AS examples FROM problems GROUP BY kind""")
def integrity_report(spark: SparkSession, folder: str) -> DataFrame:
    found = integrity.counted_problems(integrity.page_problems(table(spark, folder, "ocr_manifest")))
    return found.select("kind", "n", F.array_join("examples", ",").alias("examples"))


@query(f"""
    WITH {_PAGES}, r AS (SELECT x.label AS label, x.text AS text FROM (SELECT unnest(regions) AS x FROM pages)), h AS (SELECT coalesce(list_transform(regions, lambda x: x.label), []) AS has FROM pages)
    SELECT 'not_composed' AS figure, count(*) FILTER (nfc_normalize(text) <> text) AS n, count(*) AS of FROM r WHERE text IS NOT NULL
    UNION ALL SELECT 'timestamp_with_date', count(*) FILTER (regexp_matches(text, '[0-9]{{1,2}}[/\\-.][0-9]{{1,2}}[/\\-.][0-9]{{2,4}}')), count(*) FROM r WHERE label = 'TIMESTAMP' AND text IS NOT NULL
    UNION ALL SELECT 'total_as_amount', count(*) FILTER (regexp_full_match(trim(text), '[^0-9]*[0-9][0-9.,\\s]*[^0-9]*')), count(*) FROM r WHERE label = 'TOTAL_COST' AND regexp_matches(text, '[0-9]')
    UNION ALL SELECT 'label:' || coalesce(label, '(none)'), count(*), count(*) FROM r GROUP BY 1
    {' '.join(f"UNION ALL SELECT 'pages_without:{k}', count(*) FILTER (NOT list_contains(has, '{k}')), count(*) FROM h" for k in integrity.KEY_LABELS)}""")
def text_figures(spark: SparkSession, folder: str) -> DataFrame:
    return integrity.text_figures(table(spark, folder, "ocr_manifest"))


# Documents around the tables, images, runs


@query(f"WITH {_REGIONS}, s AS (SELECT image_id, any_value(width) AS w, any_value(height) AS h FROM ocr_manifest GROUP BY image_id) SELECT r.image_id, region_id::INT AS region_id, label, role, text, bbox[1]::INT AS x, bbox[2]::INT AS y, bbox[3]::INT AS w, bbox[4]::INT AS h FROM regions r JOIN s ON r.image_id = s.image_id WHERE s.w > 0 AND s.h > 0")
def annotation_roundtrip(spark: SparkSession, folder: str) -> DataFrame:
    """Regions go out as tasks for annotators, in hundredths of the page, and come back."""
    path = _shared(spark, "tasks")
    documents.annotation_tasks(_manifest(spark, folder)).select("task").write.text(path)
    back = documents.imported_regions(spark.read.text(path).withColumnRenamed("value", "task"))
    return back.select("image_id", "region_id", "label", "role", "text", *[F.col("bbox")[k].alias(n) for k, n in enumerate("xywh")])


def _images(spark: SparkSession, folder: str) -> DataFrame:
    """The embeddings as grey images of 8 x 8 pixels, each enlarged five times."""
    rows = table(spark, folder, "embeddings").select(F.col("vec_id").cast("string").alias("image_id"), "embedding")

    def draw(batches):
        for batch in batches:
            pixels = [np.kron(np.clip((np.asarray(e, float).reshape(8, 8) + 1) * 127.5, 0, 255), np.ones((5, 5))).astype(np.uint8).tobytes() for e in batch["embedding"]]
            yield pd.DataFrame({"image_id": batch["image_id"], "width": 40, "height": 40, "pixels": pixels})

    return rows.mapInPandas(draw, "image_id string, width int, height int, pixels binary")


@query()
def prepared_images(spark: SparkSession, folder: str) -> DataFrame:
    """Every step of preparation with the homography of all of them together."""
    settings = images.Settings(turn=180, page_share=(0.2, 0.95), skew=(0.3, 12.0), contrast=(2.0, 4), noise=1)
    out = images.prepare_images(_images(spark, folder), settings)
    return out.select("image_id", "width", "height", F.sha2("pixels", 256).alias("sha256"), F.round(F.col("h")[0][2], 4).alias("shift_x"), F.round(F.col("h")[1][2], 4).alias("shift_y"), F.array_join(F.array_sort(F.map_keys("did")), ",").alias("steps"))


@query("SELECT cast(vec_id AS VARCHAR) AS sample_id, 'w' || 24 || 'h' || 20 AS text, 0.5 AS rec_score FROM embeddings")
def published_run(spark: SparkSession, folder: str) -> DataFrame:
    """A stand-in for a recogniser over crops of images, published with its note."""
    shots = _images(spark, folder)
    box = F.array(*[F.array(F.lit(float(x)), F.lit(float(y))) for x, y in ((10, 10), (30, 10), (30, 26), (10, 26))])
    cut = images.crop_lines(shots, shots.select("image_id", F.lit(0).cast("bigint").alias("line_id"), box.alias("polygon"))).withColumnRenamed("image_id", "sample_id")
    stored, _ = Workspace(spark, "crops").write(cut, "crops")
    model = lambda rows: rows.assign(text="w" + rows["width"].astype(str) + "h" + rows["height"].astype(str), rec_score=0.5)
    return runs.publish_run(stored, model, _shared(spark, "run"), {"model": "stand-in"}, {"images": "embeddings"})


# Flags, rejections, lists


@query("""
    WITH m AS (SELECT image_id, any_value(quality) AS quality, any_value(gt) AS gt, any_value(dup_of) AS dup_of, lower(trim(any_value(split))) AS s FROM ocr_manifest GROUP BY image_id)
    SELECT image_id, coalesce(quality < 0.5, false) AS low_quality, gt.merchant_name IS NOT NULL AND gt.transaction_date IS NOT NULL AND gt.total IS NOT NULL AS complete, CASE WHEN dup_of IS NOT NULL AND s IN ('val', 'test', 'test_seen') THEN 'dropped_dup' ELSE s END AS split FROM m""")
def page_flags(spark: SparkSession, folder: str) -> DataFrame:
    return corpus.with_flags(_manifest(spark, folder).drop("low_quality", "complete")).select("image_id", "low_quality", "complete", "split")


@query(f"""
    WITH {_CROPS}, r AS (SELECT *, length({_sql_norm('text')}) AS n, width / greatest(height, 1) AS shape FROM crops)
    SELECT coalesce(CASE WHEN split = 'dropped_dup' THEN 'dup_image' WHEN n = 0 OR n > 100 THEN 'bad_text_len' WHEN least(width, height) < 24 OR shape > 60 OR shape < 0.3 THEN 'bad_crop_shape' END, 'kept') AS reason, count(*) AS n FROM r GROUP BY 1""")
def crop_rejections(spark: SparkSession, folder: str) -> DataFrame:
    rows = corpus.crop_rejections(_crops(spark, folder).withColumnRenamed("sample_id", "name"), _manifest(spark, folder), least_side=24)
    return rows.groupBy(F.coalesce("reason", F.lit("kept")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


@query("WITH m AS (SELECT image_id, any_value(split) AS split, any_value(group_id) AS group_id FROM ocr_manifest GROUP BY image_id), r AS (SELECT DISTINCT image_id FROM receipts WHERE image_id IS NOT NULL) SELECT r.image_id, split, group_id FROM r JOIN m ON m.image_id = r.image_id")
def reference_splits(spark: SparkSession, folder: str) -> DataFrame:
    """The receipts whose photographs are known, split and grouped as the manifest has them."""
    pages = _manifest(spark, folder)
    known = table(spark, folder, "receipts").select("image_id").where("image_id is not null").distinct().join(pages.select(F.col("image_id").alias("i")), F.col("image_id") == F.col("i"), "left_semi")
    return corpus.with_reference(known, pages, ["split", "group_id"])


@query("SELECT group_id, count(DISTINCT image_id) AS n FROM ocr_manifest WHERE group_id IS NOT NULL GROUP BY 1 ORDER BY n DESC, group_id LIMIT 8")
def largest_groups(spark: SparkSession, folder: str) -> DataFrame:
    """A top-k report: the eight groups with the most photographs."""
    return _manifest(spark, folder).where("group_id is not null").groupBy("group_id").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "group_id").limit(8)


@query(f"WITH {_REGIONS}, s AS (SELECT image_id, any_value(width) AS pw, any_value(height) AS ph FROM ocr_manifest GROUP BY image_id) SELECT r.image_id, region_id::INT AS place, pw::INT AS width, ph::INT AS height, bbox[1]::DOUBLE AS x, bbox[2]::DOUBLE AS y, bbox[3]::DOUBLE AS w, bbox[4]::DOUBLE AS h FROM regions r JOIN s ON r.image_id = s.image_id")
def csv_polygons(spark: SparkSession, folder: str) -> DataFrame:
    """Boxes of regions go into a CSV field as a list of dicts in Python's writing, and come back."""
    one = lambda r: F.concat(F.lit("{'bbox': ["), F.concat_ws(", ", *[r["bbox"][k].cast("string") for k in range(4)]), F.lit("], 'width': "), F.coalesce(F.col("width").cast("string"), F.lit("None")), F.lit(", 'height': "), F.coalesce(F.col("height").cast("string"), F.lit("None")), F.lit("}"))
    packed = _manifest(spark, folder).where("size(regions) > 0").select("image_id", F.concat(F.lit("["), F.array_join(F.transform("regions", one), ", "), F.lit("]")).alias("polygons"))
    path = _shared(spark, "polygons")
    files.write_csv(packed, path)
    back = files.read_csv(spark, path, packed.schema).select("image_id", F.posexplode(files.python_literal(F.col("polygons"), "array<struct<bbox array<double>, width int, height int>>")).alias("place", "p"))
    return back.select("image_id", "place", "p.width", "p.height", *[F.col("p.bbox")[k].alias(n) for k, n in enumerate("xywh")])
