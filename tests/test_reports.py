"""Evaluation, scores, calibration, crops, integrity, images, runs and documents on small fixtures."""

import json
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType, LongType, StringType, DoubleType, ArrayType

from slipworks.operators import crops, evaluation, images, integrity, runs, scoring
from slipworks.sources import documents

MANIFEST = "image_id string, group_id string, quality double, width int, height int, image_hash bigint, regions array<struct<label string, text string, polygon array<array<double>>, bbox array<int>, bbox_norm array<int>, role string, kie_label string>>, hyp string"
LINES = "image_id string, line_id bigint, line_no int, text string, rec_score double, polygon array<array<double>>, ref string"


def _box(x, y, w, h):
    return [[float(a), float(b)] for a, b in ((x, y), (x + w, y), (x + w, y + h), (x, y + h))]


def _manifest(spark, pages):
    rows = [(i, g, q, 160, 100, 5, None if regions is None else [(label, text, _box(*b), list(b), None, role, None) for label, text, b, role in regions], "clash") for i, g, q, regions in pages]
    return spark.createDataFrame(rows, MANIFEST)


MINI = [("TOTAL_COST", "Tổng tiền", (10, 10, 90, 20), "key"), ("TOTAL_COST", "100000", (10, 50, 90, 20), "value"), ("TOTAL_COST", "bad box", (0, 0, 2, 1), None)]


def _mini(spark):
    manifest = _manifest(spark, [("receipt", "g1", 0.9, MINI), ("none", "g2", 0.2, None), ("empty", None, 0.2, [])])
    lines = spark.createDataFrame([("receipt", 1, 1, "Tổng tiền", 0.9, _box(10, 10, 90, 20), "x"), ("receipt", 2, 2, "outside", 0.8, _box(110, 75, 40, 20), "x"), ("other", 3, 1, "x", 0.8, _box(0, 0, 9, 9), "x")], LINES)
    return lines, manifest


def test_golden_mini_run(spark):
    lines, manifest = _mini(spark)
    rows = evaluation.evaluation_rows(lines, manifest)
    got = {r.region_id: (r.hyp, r.matched, r.char_err_exact, r.char_len_exact) for r in rows.collect()}
    assert got == {0: ("Tổng tiền", 1, 0, 9), 1: ("", 0, 6, 6)}
    report = {(r.slice, r.value): r for r in evaluation.slice_report(rows, draws=10).collect()}
    overall = report["overall", "all"]
    assert (overall.regions, overall.documents, overall.region_coverage, overall.exact_match_rate) == (2, 1, 0.5, 0.5) and overall.cer_exact == pytest.approx(6 / 15)
    assert report["role", "key"].cer_exact == 0 and report["role", "value"].cer_exact == 1 and report["quality", "normal"].regions == 2
    assert {r.image_id: (r.regions, r.skipped) for r in evaluation.skipped_regions(manifest).collect()} == {"receipt": (3, 1), "none": (0, 0), "empty": (0, 0)}
    assert [r.region_id for r in evaluation.sorted_regions(manifest).orderBy("place").collect()] == [2, 0, 1]
    same = {r.unit: (r["diff"], r.low, r.high, r.better) for r in evaluation.compare_runs(rows, rows, draws=20).collect()}
    assert same == {"char": (0, 0, 0, 0), "word": (0, 0, 0, 0)}
    worse = {r.unit: r["diff"] for r in evaluation.compare_runs(rows, evaluation.evaluation_rows(lines.where("line_id > 1"), manifest), draws=20).collect()}
    assert worse["char"] == pytest.approx(1 - 6 / 15)
    with pytest.raises(ValueError):
        evaluation.compare_runs(rows, rows.where("region_id = 0"))
    parsed = {r.field: (r.valid_reference_regions, r.matches) for r in evaluation.normalised_accuracy(rows).collect()}
    assert parsed == {"total_vnd": (1, 0)}
    both = {r.run: r.cer_exact for r in evaluation.summarise_runs({"a": rows, "b": rows.where("region_id = 0")}).collect()}
    assert both == {"a": pytest.approx(6 / 15), "b": 0}
    assert evaluation.corpus_metrics(rows).first().cer == pytest.approx(6 / 15)
    with pytest.raises(Exception, match="nothing to measure"):
        evaluation.corpus_metrics(rows.limit(0)).collect()
    assert evaluation.slice_report(rows.limit(0)).count() == 0 and evaluation.evaluation_rows(lines.limit(0), manifest.limit(0)).count() == 0


TRUTH = [("SELLER", "SIEU THI BACH HOA", (0, 0, 90, 20), "value"), ("SELLER", "Bach Hoa Tong Hop", (0, 30, 90, 20), "value"), ("ADDRESS", "Phường 3", (0, 90, 90, 20), "value"), ("ADDRESS", "Số 5 Cẩm Tây", (0, 60, 90, 20), "value"), ("TIMESTAMP", "Ngày 14/08/2020", (0, 120, 90, 20), "value"), ("TOTAL_COST", "Tổng", (0, 150, 90, 20), "key"), ("TOTAL_COST", "72.000 đ", (0, 180, 90, 20), "value")]


def test_page_scores(spark):
    from slipworks.operators import spatial

    fields = [("a", "bach hoa tong hop", "Số 5 Cẩm Tây Phường 3", "2020-08-14", "10:00:00", "72000"), ("b", "xyz", None, "2020-08-15", None, "99000"), ("c", "x", "y", "2020-08-14", None, "1"), ("d", None, None, None, None, None)]
    manifest = _manifest(spark, [("a", "g", 0.9, TRUTH), ("b", "g", 0.9, TRUTH), ("c", "h", 0.9, [TRUTH[0]]), ("d", None, 0.9, None)])
    found = spark.createDataFrame([(*f, 7) for f in fields], "image_id string, merchant_name string, merchant_address string, date string, time string, total string, region_id int")
    scores = scoring.page_scores(spatial.regions_of(manifest), found)
    got = {r.image_id: (r.total, r.date, r.time, r.seller, r.address, r.doc_correct) for r in scores.collect()}
    assert got == {"a": (1, 1, None, 1, 1, 1), "b": (0, 0, None, 0, 0, 0), "c": (None, None, None, 0, None, 0), "d": (None,) * 6}
    errors = {r.image_id: (r.seller_err, r.seller_len, r.address_err, r.address_len) for r in scores.collect()}
    assert errors["a"] == (0, 17, 0, 21) and errors["d"] == (None,) * 4
    report = {r.field: (r.n, r.correct) for r in scoring.score_report(scores.withColumn("g", F.lit("g")), "g", draws=10).collect()}
    assert report == {"total": (2, 1), "date": (2, 1), "seller": (3, 1), "address": (2, 1), "doc_correct": (3, 1)}
    assert scoring.page_scores(spatial.regions_of(manifest.limit(0)), found.limit(0)).count() == 0


def _results(spark, n=60):
    random.seed(3)
    rows, labels = [], []
    for i in range(n):
        good = random.random()
        for k, rule in (("merchant_name", "top_lines"), ("date", "date_regex"), ("total", random.choice(["keyword:same_row", "fallback:max_amount"])), ("time", "time_regex")):
            value = None if random.random() < 0.1 else "v"
            features = {"ocr_conf": good, "brand": float(random.random() < 0.5), "index": float(random.randrange(3)), "keyword": 1.0, "agree": float(random.randrange(3)), "n_distinct": 1.0, "is_max": 1.0, "distinct": 2.0, "key_weight": 3.0}
            rows.append((f"i{i:03}", k, value, good, rule, features if random.random() < 0.9 else None, random.choice([good, None])))
        labels.append((f"i{i:03}", f"g{i % 9}", int(random.random() < good), int(random.random() < good), random.choice([None, 1, 0]), int(random.random() < good)))
    return spark.createDataFrame(rows, "image_id string, field_key string, value string, confidence double, rule string, features map<string,double>, mean_rec double"), spark.createDataFrame(labels, "image_id string, group_id string, seller int, date int, total int, doc_correct int")


def test_calibrator(spark):
    results, scores = _results(spark)
    row = results.where("field_key = 'total' and features is not null").limit(1)
    x, r = row.select(scoring.field_vector("total")).first()[0], row.first()
    p = min(max(r.confidence, 1e-3), 1 - 1e-3)
    assert x == pytest.approx([math.log(p / (1 - p)), r.features["ocr_conf"], 0.5 if r.mean_rec is None else r.mean_rec, 0.0, float(r.rule == "keyword:same_row"), 0.0, float(r.features["agree"] >= 2), 1.0, 1.0, 1.0])
    blank = results.where("features is null and field_key = 'merchant_name'").limit(1)
    assert blank.count() == 0 or blank.select(scoring.field_vector("merchant_name")).first()[0][3:] == [0.0, 0.0, 9.0]
    labelled = scoring.labelled_results(results, scores)
    fitted = scoring.fit_calibrator(labelled, ["run1"])
    assert fitted.saw("run1") and not fitted.saw("run2") and fitted.meta["groups"] == 9
    again = scoring.Calibrator.from_json(fitted.to_json())
    assert again.models == fitted.models
    old = json.loads(fitted.to_json())
    old["models"]["date"]["features"] = ["other"]
    with pytest.raises(ValueError, match="date"):
        scoring.Calibrator.from_json(json.dumps(old))
    each = results.select("image_id", "field_key", "value", fitted.probability().alias("p")).collect()
    assert all((r.p is None) == (r.field_key == "time") and (r.value is not None or r.p in (None, 0.0)) for r in each)
    pages = {r.image_id: r.probability for r in scoring.page_probabilities(results, fitted).collect()}
    for i, p in pages.items():
        assert p == pytest.approx(min(r.p for r in each if r.image_id == i and r.p is not None))
    missing = scoring.page_probabilities(results.where("field_key = 'date'"), fitted).first()
    assert (missing.fields, missing.probability, missing["product"]) == (1, 0.0, 0.0)
    unseen = scoring.unseen_probabilities(labelled, folds=3, repeats=1)
    assert unseen.count() == labelled.where("value is not null and label is not null").count() and unseen.where("prob not between 0 and 1").count() == 0
    joined = scores.join(scoring.page_probabilities(results, fitted).withColumnRenamed("image_id", "i"), F.col("i") == F.col("image_id"))
    report = {r.method: r for r in scoring.calibration_report(joined, "doc_correct", "group_id", {"least": F.col("probability"), "half": F.lit(0.5)}).collect()}
    assert report["least"].n == 60 and report["half"].brier == pytest.approx(0.25) and report["half"].auroc == pytest.approx(0.5) and 0 <= report["least"].ece <= 1
    risk = {r.tau: (r.documents, r.coverage) for r in scoring.plain_risk_coverage(joined, "probability", "doc_correct", [0.0, 1.5]).collect()}
    assert risk == {0.0: (60, 1.0), 1.5: (0, 0.0)}


def _crop_rows(spark):
    rows = [("a_0", "a", 0, "train", "g1", "Tổng  tiền", "h1", 90, 20), ("a_1", "a", 1, "train", "g1", "100", "h2", 90, 20), ("b_0", "b", 0, "val", "g2", "100", "h2", 90, 20), ("c_0", "c", 0, "train", "g2", " ", "h3", 90, 20), ("d_0", "d", 0, "val", "g4", "x", "h4", 90, 4), ("b_1", "b", 1, "train", "g2", "y", "h5", 90, 20), ("e_0", "e", 0, "val", "g5", "one", "h6", 90, 20), ("e_1", "e", 1, "val", "g5", "two", "h6", 90, 20)]
    crop = spark.createDataFrame([(*r, 1) for r in rows], "sample_id string, image_id string, source_index int, split string, group_id string, text string, pixel_hash string, width int, height int, n int")
    pages = spark.createDataFrame([("a", "train", "g1"), ("b", "val", "g2"), ("c", "train", "g3"), ("e", "val", "g5")], "image_id string, split string, group_id string")
    packed = spark.createDataFrame([("a", ["Tổng tiền", "200"], ["T", "T"]), ("b", ["100", "y"], ["T", "T"]), ("c", [" "], ["T"]), ("e", ["one", "two"], ["T", "T"])], "image_id string, t array<string>, l array<string>")
    return crop, pages, crops.source_texts(packed, "t", "l")


def test_crop_issues_and_leakage(spark):
    crop, pages, sources = _crop_rows(spark)
    got = {(r.sample_id, r.reason) for r in crops.crop_issues(crop, pages, sources).collect()}
    assert got == {("a_1", "other_text"), ("a_1", "cross_split_duplicate"), ("b_0", "cross_split_duplicate"), ("c_0", "empty_text"), ("d_0", "unknown_page"), ("d_0", "bad_shape_or_length"), ("b_1", "wrong_split"), ("e_0", "conflicting_text"), ("e_1", "conflicting_text")}
    assert {(r.sample_id, r.reason) for r in crops.crop_issues(crop.union(crop.limit(1)), pages, sources).collect()} >= {("a_0", "repeated_id"), ("a_0", "duplicate_pixels")}
    assert {(r.mark, r.value) for r in crops.shared_between_splits(crop).collect()} == {("group_id", "g2"), ("pixel_hash", "h2")}
    assert crops.crop_issues(crop.limit(0), pages.limit(0), sources.limit(0)).count() == 0 and crops.shared_between_splits(crop.limit(0)).count() == 0


FIXES = "sample_id string, old_text string, new_text string, action string, evidence string, rotation_deg int, text string"


def test_corrections(spark):
    crop, _, _ = _crop_rows(spark)
    good = [("a_0", "Tổng tiền", "TỔNG  TIỀN", "correct_text", "seen", None, "x"), ("a_1", "100", None, "rotate", "seen", 180, "x"), ("c_0", "", None, "exclude", "seen", None, "x")]
    fixes = spark.createDataFrame(good, FIXES)
    assert crops.correction_faults(fixes, crop).count() == 0
    out = {r.sample_id: (r.text, r.reviewed, r.review_rotation_deg) for r in crops.apply_corrections(crop, fixes).collect()}
    assert out["a_0"] == ("TỔNG TIỀN", True, 0) and out["a_1"] == ("100", True, 180) and out["b_0"] == ("100", False, 0) and "c_0" not in out and len(out) == 7
    bad = [("a_0", "old", "n", "correct_text", "seen", None, "x"), ("b_0", "100", " ", "correct_text", "", 90, "x"), ("zz", "x", "y", "paint", "seen", 0, "x"), ("d_0", "x", "y", "correct_text", "s", 0, "x"), ("d_0", "x", "z", "correct_text", "s", 0, "x"), ("e_0", "one", None, "rotate", "s", 0, "x")]
    got = {(r.sample_id, r.fault) for r in crops.correction_faults(spark.createDataFrame(bad, FIXES), crop).collect()}
    assert got == {("a_0", "stale"), ("b_0", "empty_text"), ("b_0", "no_evidence"), ("b_0", "bad_rotation"), ("zz", "unknown"), ("zz", "bad_action"), ("d_0", "repeated"), ("e_0", "bad_rotation")}
    with pytest.raises(ValueError, match="stale"):
        crops.apply_corrections(crop, spark.createDataFrame(bad[:1], FIXES))
    issues = spark.createDataFrame([("c_0", "empty_text")], "sample_id string, reason string")
    assert crops.apply_corrections(crop, fixes, issues).count() == 7
    with pytest.raises(ValueError, match="b_0"):
        crops.apply_corrections(crop, fixes, issues.union(spark.createDataFrame([("b_0", "x")], "a string, b string")))
    assert crops.lineage({"model": "a", "split": "val"}, {"model": "b"}, ("model",)) == {"model": "b", "split": "val", "parent": {"model": "a"}}
    for changes in ({"split": "test"}, {"other": 1}):
        with pytest.raises(ValueError):
            crops.lineage({"model": "a", "split": "val"}, changes, ("model", "other"))
    assert crops.locked("val") == "val" and crops.locked("test", unlock=True) == "test"
    with pytest.raises(PermissionError):
        crops.locked(" Test")


def test_integrity(spark):
    manifest = _manifest(spark, [("a", "g", 1.0, [("SELLER", " ", (0, 0, 50, 20), "value"), ("TOTAL_COST", "1.000", (150, 0, 50, 20), "value")]), ("b", "g", 1.0, []), ("c", "g", 1.0, None), ("d", "g", 1.0, [("TIMESTAMP", "1/2/2020", (0, 0, 0, 9), "value"), (None, "Cộng", (0, 0, 9, 9), "value")])])
    rows = integrity.counted_problems(integrity.page_problems(manifest.union(manifest.where("image_id = 'a'")))).collect()
    assert {r.kind: (r.n, list(r.examples)) for r in rows} == {"box_out_of_bounds": (2, ["a", "d"]), "polygon_out_of_bounds": (1, ["a"]), "texts_missing": (2, ["b", "c"]), "empty_text": (1, ["a"]), "duplicate_image_id": (1, ["a"])}
    many = spark.createDataFrame([("k", f"w{i:05}") for i in range(3000)] + [("k", "w00001")], "kind string, who string")
    assert tuple(integrity.counted_problems(many).first()) == ("k", 3001, ["w00000", "w00001", "w00002"])
    figures = {r.figure: (r.n, r["of"]) for r in integrity.text_figures(manifest).collect()}
    assert figures["not_composed"] == (1, 4) and figures["timestamp_with_date"] == (1, 1) and figures["total_as_amount"] == (1, 1) and figures["label:(none)"] == (1, 1) and figures["pages_without:SELLER"] == (3, 4)


def _page_image(angle=0.0):
    image = np.full((240, 320), 235, np.uint8)
    for y in range(40, 200, 24):
        image[y : y + 8, 40:280] = 20
    return images.levelled(image, angle)[0] if angle else image


def test_skew_is_found_and_undone():
    assert images.skew(_page_image()) == 0.0 and images.skew(np.full((50, 60), 200, np.uint8)) == 0.0
    for angle in (-6.0, 3.5):
        turned = _page_image(angle)
        assert images.skew(turned) == pytest.approx(-angle, abs=0.5)
        out, h, did = images.prepared(turned, images.Settings())
        assert abs(images.skew(out)) <= 0.5 and set(did) == {"skew"} and h.shape == (3, 3)


def test_homographies_take_places_to_places():
    quad = np.array([[20.0, 30], [200, 40], [190, 160], [15, 150]])
    target = np.array([[0.0, 0], [100, 0], [100, 50], [0, 50]])
    h = images.homography(quad, target)
    u, v, w = h @ np.vstack([quad.T, np.ones(4)])
    assert np.allclose(np.stack([u / w, v / w], 1), target)
    image = np.arange(200 * 240, dtype=np.uint32).reshape(200, 240).astype(np.uint8)
    assert (images.warped(image, np.eye(3), 240, 200) == image).all()
    turned, h, did = images.prepared(image, images.Settings(turn=180, skew=None))
    assert (turned[::-1, ::-1] == image).all() and (h @ [3, 4, 1])[:2].tolist() == [236, 195]
    with pytest.raises(ValueError):
        images.prepared(image, images.Settings(turn=90))


def test_outline_contrast_noise_and_crops():
    image = np.full((200, 260), 30, np.uint8)
    image[40:160, 60:220] = 220
    quad = images.page_outline(image, 0.2, 0.95)
    assert np.abs(quad - np.array([[60, 40], [219, 40], [219, 159], [60, 159]])).max() <= 4
    assert images.page_outline(image, 0.6, 0.95) is None and images.page_outline(np.full((40, 40), 9, np.uint8), 0.2, 0.9) is None
    out, _, did = images.prepared(image, images.Settings(page_share=(0.2, 0.5), skew=None, contrast=(2.0, 4), noise=1))
    assert did == {"page": "cut", "contrast": "applied", "noise": "applied"} and abs(out.shape[0] - 119) <= 8
    spots = np.full((30, 30), 100, np.uint8)
    spots[10, 10] = 255
    assert (images.smoothed(spots, 1) == 100).all()
    dull = np.tile(np.linspace(100, 140, 64).astype(np.uint8), (64, 1))
    assert np.ptp(images.contrasted(dull, 4.0, 2)) > np.ptp(dull)
    line = np.full((60, 120), 255, np.uint8)
    line[20:30, 30:90] = 0
    crop = images.rectified(line, np.array([[30, 20], [90, 20], [90, 30], [30, 30]], float))
    assert crop.shape == (14, 64) and crop[7, 32] == 0 and crop[0, 0] == 255
    tall = images.rectified(line.T.copy(), np.array([[20, 30], [30, 30], [30, 90], [20, 90]], float))
    assert tall.shape == (14, 64)
    assert images.rectified(line, np.array([[1, 1], [5, 1], [9, 1]], float)) is None and images.least_rectangle(np.array([[1.0, 1]])) is None
    corner = images.least_rectangle(np.array([[0, 5], [5, 0], [10, 5], [5, 10]], float))
    assert np.allclose(sorted(map(tuple, corner.round(6))), [(0, 5), (5, 0), (5, 10), (10, 5)])


def test_images_in_batches(spark):
    page = _page_image()
    rows = [("a", 320, 240, page.tobytes(), 1), ("b", 10, 10, b"xx", 1), ("c", None, None, None, 1), ("d", 320, 240, _page_image(4.0)[:240, :320].tobytes(), 1)]
    shots = spark.createDataFrame(rows, "image_id string, width int, height int, pixels binary, h int")
    out = {r.image_id: r for r in images.prepare_images(shots, images.Settings()).collect()}
    assert out["a"].did == {"skew": "0.00"} and out["a"].pixels == page.tobytes() and out["b"].pixels is None and out["c"].width is None
    lines = spark.createDataFrame([("a", 1, _box(40, 40, 240, 8)), ("a", 2, None), ("z", 1, _box(0, 0, 9, 9)), ("b", 1, _box(0, 0, 9, 9)), ("a", 3, _box(5, 5, 0, 0))], "image_id string, line_id bigint, polygon array<array<double>>")
    assert [(r.image_id, r.line_id, r.width, r.height) for r in images.crop_lines(shots, lines).collect()] == [("a", 1, 244, 12)]
    assert images.prepare_images(shots.limit(0), images.Settings()).count() == 0


def test_runs_are_published_once_and_whole(spark, tmp_path):
    rows = [(f"s{i}", 10 + i, 10, b"x", "clash") for i in range(20)]
    crop = spark.createDataFrame(rows, "sample_id string, width int, height int, pixels binary, text string")
    model = lambda b: b.assign(text=b["sample_id"].str.upper(), rec_score=0.5)[::-1]
    out = runs.publish_run(crop, model, str(tmp_path / "run"), {"batch": 4}, {"crops": "abc"})
    assert {r.sample_id: r.text for r in out.collect()} == {f"s{i}": f"S{i}" for i in range(20)}
    note = documents.read_document(spark, str(tmp_path / "run.note.json"))
    assert note["settings"] == {"batch": 4} and note["sources"] == {"crops": "abc"} and len(note["settings_sha256"]) == 64
    with pytest.raises(Exception):
        runs.publish_run(crop, model, str(tmp_path / "run"), {}, {})
    with pytest.raises(ValueError, match="results for"):
        runs.publish_run(crop, lambda b: model(b)[1:], str(tmp_path / "half"), {}, {})
    assert not (tmp_path / "half.note.json").exists()


def test_documents(spark, tmp_path):
    path = str(tmp_path / "d.json")
    documents.write_document(spark, {"a": [1, 2.5, "đ"]}, path)
    assert documents.read_document(spark, path) == {"a": [1, 2.5, "đ"]} and sorted(f.name for f in tmp_path.iterdir() if not f.name.startswith(".")) == ["d.json"]
    with pytest.raises(FileExistsError):
        documents.write_document(spark, {}, path)
    with pytest.raises(ValueError):
        documents.write_document(spark, {"a": [float("nan")]}, str(tmp_path / "n.json"))
    for k in (1, 2):
        documents.log_experiment(spark, str(tmp_path / "log"), f"run{k}", {"k": k}, {"cer": 0.1 * k})
    assert {(r.name, r.figures["cer"]) for r in spark.read.parquet(str(tmp_path / "log")).collect()} == {("run1", 0.1), ("run2", 0.2)}
    (tmp_path / "s.json").write_text('{"batch": {"size": 8}, "name": "x"}')
    defaults = {"batch": {"size": 4, "order": "width"}, "name": "", "fast": False, "tau": 0.5}
    got = documents.read_settings(str(tmp_path / "s.json"), defaults, environment={"SLIPWORKS_BATCH__ORDER": "input", "SLIPWORKS_FAST": "yes", "SLIPWORKS_TAU": "0.7", "OTHER": "1"})
    assert got == {"batch": {"size": 8, "order": "input"}, "name": "x", "fast": True, "tau": 0.7} and defaults["batch"]["size"] == 4
    (tmp_path / "s.yaml").write_text("batch:\n  size: 9\n")
    try:
        assert documents.read_settings(str(tmp_path / "s.yaml"), defaults, environment={})["batch"] == {"size": 9, "order": "width"}
    except ValueError as e:
        assert "YAML" in str(e)
    with pytest.raises(ValueError, match="batch.other"):
        documents.read_settings(str(tmp_path / "s.json"), {"batch": {}, "name": ""} | {"batch": {"size": 1}}, environment={"SLIPWORKS_BATCH__OTHER": "1"})
    kind = StructType([StructField("id", StringType(), False), StructField("n", LongType()), StructField("x", ArrayType(DoubleType()))])
    schema = documents.json_schema(kind, "row")
    assert schema["required"] == ["id"] and schema["properties"]["n"] == {"type": ["integer", "null"]} and schema["properties"]["x"] == {"type": ["array", "null"], "items": {"type": "number"}} and schema["title"] == "row"
    ddl = documents.table_ddl("t", kind, "id", {"positive": "n > 0"}, {"n": "other(n)"})
    assert ddl == "create table t (\n    id text primary key,\n    n bigint references other(n),\n    x jsonb,\n    constraint positive check (n > 0)\n);"


def test_tasks_come_back(spark):
    pages = _manifest(spark, [("a", "g", 1.0, MINI), ("b", "g", 1.0, None)]).withColumn("image_path", F.lit("p.jpg"))
    tasks = documents.annotation_tasks(pages)
    assert tasks.count() == 2
    back = sorted((r.image_id, r.region_id, r.label, r.role, r.text, tuple(r.bbox)) for r in documents.imported_regions(tasks).collect())
    assert back == [("a", i, label, role, text, b) for i, (label, text, b, role) in enumerate(MINI)]
    with pytest.raises(Exception):
        documents.imported_regions(spark.createDataFrame([("{nonsense",)], "task string")).collect()


def test_flags_references_and_rejections(spark):
    from slipworks.operators import corpus

    gt = "struct<merchant_name string, transaction_date string, total bigint>"
    rows = spark.createDataFrame([("a", 0.4, ("x", "d", 5), "b", " VAL "), ("b", None, ("x", None, 5), None, "train"), ("c", 0.9, None, "a", "train"), ("d", 0.9, ("x", "d", 0), "a", None)], f"image_id string, quality double, gt {gt}, dup_of string, split string")
    assert {r.image_id: (r.low_quality, r.complete, r.split) for r in corpus.with_flags(rows).collect()} == {"a": (True, True, "dropped_dup"), "b": (False, False, "train"), "c": (False, False, "train"), "d": (False, True, None)}
    new = spark.createDataFrame([("a", "old", 1), ("b", "old", 2)], "image_id string, split string, n int")
    assert {r.image_id: (r.split, r.n) for r in corpus.with_reference(new, rows, ["split"]).collect()} == {"a": (" VAL ", 1), "b": ("train", 2)}
    with pytest.raises(Exception, match="not in the reference"):
        corpus.with_reference(new.union(spark.createDataFrame([("z", "old", 3)], new.schema)), rows, ["split"]).collect()
    with pytest.raises(ValueError):
        corpus.with_reference(new, rows.union(rows.withColumn("split", F.lit("test"))), ["split"])
    names = [("k0", "a", "x", 90, 20), ("k1", "b", "text", 90, 20), ("k1", "b", "text", 90, 20), ("k2", "z", "text", 90, 20), ("k3", "b", " ", 90, 20), ("k4", "b", "y" * 101, 90, 20), ("k5", "b", "text", 90, 7), ("k6", "b", "text", 10, 90)]
    crop = spark.createDataFrame(names, "name string, image_id string, text string, width int, height int")
    got = sorted((r.name, r.reason or "") for r in corpus.crop_rejections(crop, corpus.with_flags(rows)).collect())
    assert got == [("k0", "dup_image"), ("k1", ""), ("k1", "duplicate_line"), ("k2", "image_dropped"), ("k3", "bad_text_len"), ("k4", "bad_text_len"), ("k5", "bad_crop_shape"), ("k6", "bad_crop_shape")]


def test_orientation_is_probed_both_ways_and_replayed(spark):
    from slipworks.operators import corpus

    rows = [(f"s{i}", "p" if i < 4 else "q", 2, 1, bytes([1, 9]) if i < 4 else bytes([9, 1])) for i in range(8)] + [("e", "q", 2, 1, bytes([0, 0]))]
    crop = spark.createDataFrame(rows, "sample_id string, image_id string, width int, height int, pixels binary")
    model = lambda b: b.assign(text=["" if not any(p) else "t" for p in b["pixels"]], rec_score=[p[0] / 10 for p in b["pixels"]])
    probes = runs.probed_both_ways(crop, model)
    got = {r.sample_id: (r.upright, r.turned) for r in probes.collect()}
    assert got["s0"] == (0.1, 0.9) and got["s5"] == (0.9, 0.1) and got["e"] == (None, None) and len(got) == 9
    assert {r.image_id: r.degrees for r in corpus.orientation_votes(probes, "image_id", "upright", "turned").collect()} == {"p": 180, "q": 0}
    note = runs.provenance({"least": 3}, {})
    assert runs.replayed(probes, crop, note, {"least": 3}).count() == 9
    for bad in (lambda: runs.replayed(probes, crop, note, {"least": 4}), lambda: runs.replayed(probes.where("sample_id <> 'e'"), crop, note, {"least": 3})):
        with pytest.raises(ValueError):
            bad()


def test_rows_in_the_frame_of_a_homography(spark):
    from slipworks.operators import spatial

    rows = [("p", 1, 1, "low", 0.9, _box(0, 0, 20, 10), "x"), ("p", 2, 2, "top", 0.9, _box(0, 50, 20, 10), "x")]
    lines = spark.createDataFrame(rows, LINES)
    assert [r.text for r in spatial.reading_order(lines).orderBy("idx").collect()] == ["low", "top"]
    turned = spatial.reading_order(lines, [[-1.0, 0.0, 99.0], [0.0, -1.0, 99.0], [0.0, 0.0, 1.0]]).orderBy("idx").collect()
    assert [(r.text, r.x0, r.y0) for r in turned] == [("top", 79.0, 39.0), ("low", 79.0, 89.0)]


def test_command_line(spark, data, tmp_path, capsys):
    from slipworks.__main__ import main

    assert main(["list"]) == 0 and "norm_text" in capsys.readouterr().out.split()
    assert main(["run", "latencies", data, str(tmp_path / "out"), "--format", "csv"]) == 0
    assert spark.read.option("header", "true").csv(str(tmp_path / "out")).count() > 0 and "rows in" in capsys.readouterr().out
    with pytest.raises(SystemExit):
        main(["run", "nothing", data, str(tmp_path / "x")])


def test_page_means_halfway_go_up_in_any_order(spark, tmp_path):
    from decimal import ROUND_HALF_UP, Decimal

    from slipworks.plans import registry

    random.seed(15)
    rows, exact = [], {}
    for n in range(60):
        scores = [random.randrange(600, 1000) for _ in range(16)]
        scores[0] += 1 - sum(scores) % 2  # an odd sum over 16 ends in 5 beyond the sixth place
        for turn in range(2):
            page = f"p{n:02}_{turn}"
            exact[page] = float((Decimal(sum(scores)) / 16000).quantize(Decimal("0.000001"), ROUND_HALF_UP))
            rows += [(page, len(rows), k, "x", s / 1000, _box(10, 20 * k, 90, 10), None) for k, s in enumerate(scores[:: 1 - 2 * turn], 1)]
    spark.createDataFrame(rows, LINES).write.parquet(f"{tmp_path}/ocr_lines.parquet")
    got = {r.image_id: (r.lines, r.mean_rec_score) for r in registry.queries()["extracted_pages"](spark, str(tmp_path)).collect()}
    assert got == {k: (16, v) for k, v in exact.items()}
