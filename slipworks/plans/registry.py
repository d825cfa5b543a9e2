"""The queries of the core by name, each with its SQL where SQL can state it."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slipworks.functions import edit, geometry, text, values
from slipworks.operators import audits, corpus, extract, spatial, stats
from slipworks.operators.timestamps import InstantDictionary, with_instants
from slipworks.session import shared_folder
from slipworks.sources import files
from slipworks.sources.tables import table
from slipworks.streaming import windows

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}

#: The day after which dates on receipts are in the future; fixed, so that results don't change from day to day.
TODAY = "2026-12-31"

# Words for totals in the keyword query, phrases of sellers that mean nobody, and the weights of a fitted model.
TOTAL_WORDS = ["tong cong", "tong tien", "thanh tien", "total", "subtotal"]
GENERIC = ["hóa đơn", "siêu thị", "phiếu"]
MODEL = {"mean": [0.7, 12.0], "std": [0.2, 6.0], "coef": [1.25, -0.4], "intercept": 0.3}


def query(sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


def _sql_fold(column: str) -> str:
    return f"lower(translate(strip_accents(coalesce({column}, '')), 'đĐ', 'dD'))"


_EDGE = "[^\\p{L}\\p{M}\\p{N}\\p{Pc}\\x{200c}\\x{200d}]"  # what Java's Unicode classes don't count as part of a word
_BLANKS = "[\\s\\x0b\\x{85}\\p{Z}]+"
_LINES = "lines AS (SELECT line_id, any_value(image_id) AS image_id, any_value(line_no) AS line_no, any_value(engine) AS engine, any_value(preproc) AS preproc, any_value(polygon) AS polygon, any_value(det_score) AS det_score, any_value(text) AS text, any_value(rec_score) AS rec_score FROM ocr_lines GROUP BY line_id)"


def _lines(spark: SparkSession, folder: str) -> DataFrame:
    """Lines that were sent twice count once."""
    return table(spark, folder, "ocr_lines").dropDuplicates(["line_id"])


# Text


def _sql_norm(column: str) -> str:
    return f"trim(regexp_replace(nfc_normalize(coalesce({column}, '')), '{_BLANKS}', ' ', 'g'))"


def _sql_key(column: str, least: int, generic: list[str]) -> str:
    """SQL of ``text.dedup_key``."""
    key = f"trim(regexp_replace(lower({_sql_norm(column)}), '[^\\p{{L}}\\p{{M}}\\p{{N}}\\p{{Pc}} ]', '', 'g'))"
    return f"CASE WHEN length({key}) >= {least} AND {' AND '.join(f"NOT contains({key}, '{g}')" for g in generic)} THEN {key} END"


def _sql_edit(a: str, b: str) -> str:
    """SQL of the edit distance of two lists: each distinct element becomes a letter of one byte, which DuckDB counts."""
    kinds = f"list_distinct(list_concat({a}, {b}))"
    coded = lambda x: f"array_to_string(list_transform({x}, lambda e: chr(33 + list_position({kinds}, e)::INT)), '')"
    return f"levenshtein({coded(a)}, {coded(b)})"


def _sql_chars(column: str) -> str:
    return f"list_transform(range(1, length({column}) + 1), lambda i: substr({column}, i, 1))"


@query(f"WITH {_LINES} SELECT line_id, {_sql_norm('text')} AS norm FROM lines")
def norm_text(spark: SparkSession, folder: str) -> DataFrame:
    return _lines(spark, folder).select("line_id", text.norm(F.col("text")).alias("norm"))


@query(f"SELECT doc_id, {_sql_fold('text')} AS folded FROM documents")
def fold_text(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").select("doc_id", text.fold(F.col("text")).alias("folded"))


@query(f"WITH {_LINES} SELECT engine, regexp_matches({_sql_fold('text')}, '(^|{_EDGE})({'|'.join(TOTAL_WORDS)})($|{_EDGE})') AS has_total, count(*) AS n FROM lines GROUP BY ALL")
def keyword_lines(spark: SparkSession, folder: str) -> DataFrame:
    has = text.has_keyword(text.fold(F.col("text")), TOTAL_WORDS)
    return _lines(spark, folder).groupBy("engine", has.alias("has_total")).agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH k AS (SELECT image_id, any_value(gt).merchant_name AS name FROM ocr_manifest GROUP BY image_id) SELECT image_id, {_sql_key('name', 6, GENERIC)} AS merchant_key FROM k")
def merchant_keys(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "ocr_manifest").dropDuplicates(["image_id"])
    return rows.select("image_id", text.dedup_key(F.col("gt.merchant_name"), 6, GENERIC).alias("merchant_key"))


@query(f"WITH {_LINES} SELECT line_id, length(regexp_replace(text, '[^\\p{{L}}]', '', 'g')) AS letters, length(regexp_replace(text, '[^\\p{{Lu}}]', '', 'g')) AS capitals, length(text) AS chars FROM lines WHERE text IS NOT NULL")
def letter_counts(spark: SparkSession, folder: str) -> DataFrame:
    return _lines(spark, folder).where("text is not null").select("line_id", text.letters(F.col("text")).alias("letters"), text.capitals(F.col("text")).alias("capitals"), F.length("text").alias("chars"))


@query(f"""
    WITH {_LINES}, t AS (SELECT 'l' || line_id AS k, text AS t FROM lines UNION ALL SELECT DISTINCT 'o' || correction_id, old_text FROM label_corrections UNION ALL SELECT DISTINCT 'n' || correction_id, new_text FROM label_corrections),
    d AS (SELECT k, t, unnest(range(1, length(t) + 1)) AS i FROM t WHERE t IS NOT NULL) SELECT substr(t, i, 1) AS char, count(*) AS n, count(DISTINCT k) AS texts FROM d GROUP BY 1""")
def charset(spark: SparkSession, folder: str) -> DataFrame:
    """Every character of all lines and of both texts of all corrections."""
    lines = _lines(spark, folder).select(F.concat(F.lit("l"), "line_id").alias("k"), F.col("text").alias("t"))
    fixes = table(spark, folder, "label_corrections").dropDuplicates(["correction_id"])
    texts = lines.union(fixes.select(F.concat(F.lit("o"), "correction_id"), "old_text")).union(fixes.select(F.concat(F.lit("n"), "correction_id"), "new_text"))
    each = texts.select(F.explode(text.characters(F.col("t"))).alias("char"), F.col("k"))
    per_text = each.groupBy("k", "char").agg(F.count(F.lit(1)).alias("n"))
    return per_text.groupBy("char").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("texts"))


@query("SELECT doc_id, sha256(text) AS digest FROM documents WHERE text IS NOT NULL")
def content_hash(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").where("text is not null").select("doc_id", F.sha2("text", 256).alias("digest"))


@query("SELECT sha256(string_agg(doc_id || ':' || sha256(coalesce(text, '')) || chr(10), '' ORDER BY cast(doc_id AS VARCHAR))) AS tree FROM documents")
def tree_hash(spark: SparkSession, folder: str) -> DataFrame:
    return audits.tree_hash(table(spark, folder, "documents").select(F.col("doc_id").cast("string").alias("path"), "text"), "path", F.sha2(F.coalesce("text", F.lit("")), 256))


# Values


@query("SELECT o_orderkey, cast(floor(o_totalprice) AS BIGINT) AS amount FROM orders")
def money_roundtrip(spark: SparkSession, folder: str) -> DataFrame:
    """Prices are written as 1.234.567 đ and read back."""
    written = F.concat(F.translate(F.format_number(F.floor("o_totalprice"), 0), ",", "."), F.lit(" đ"))
    return table(spark, folder, "orders").select("o_orderkey", values.parse_vnd(written).alias("amount"))


@query("SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS day FROM orders")
def date_roundtrip(spark: SparkSession, folder: str) -> DataFrame:
    written = F.concat(F.lit("Ngày: "), F.date_format("o_orderdate", "d/MM/yyyy"), F.lit(" 08:06"))
    return table(spark, folder, "orders").select("o_orderkey", values.parse_date(written).alias("day"))


@query("SELECT event_id, strftime(ts, '%H:%M:%S') AS clock FROM events")
def time_roundtrip(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "events").select("event_id", values.parse_time(F.concat(F.lit("Giờ "), F.date_format("ts", "HH:mm:ss"))).alias("clock"))


@query()
def line_amounts(spark: SparkSession, folder: str) -> DataFrame:
    """Lines that hold amounts; a line without figures is left out before it is folded."""
    keys = _lines(spark, folder).where(F.col("text").rlike(r"(?U)\d")).select("line_id", text.fold(F.col("text")).alias("key"))
    return keys.select("line_id", extract.amounts_of(F.col("key")).alias("amounts")).where("size(amounts) > 0")


@query("SELECT l_orderkey, l_linenumber, round(greatest(100.0, 0.005 * abs(l_extendedprice)), 6) AS tolerance FROM lineitem")
def tolerance(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", F.round(values.tolerance_limit(F.col("l_extendedprice"), 100, 0.005), 6).alias("tolerance"))


@query("""
    WITH r AS (SELECT result_id, any_value(confidence) AS c FROM field_results GROUP BY result_id), p AS (SELECT result_id, least(greatest(c, 1e-3), 1 - 1e-3) AS p FROM r WHERE c IS NOT NULL)
    SELECT result_id, round(ln(p / (1 - p)), 6) AS logit, round(1 / (1 + exp(-ln(p / (1 - p)))), 6) AS back FROM p""")
def logit_sigmoid(spark: SparkSession, folder: str) -> DataFrame:
    z = values.logit(F.col("confidence"))
    return table(spark, folder, "field_results").dropDuplicates(["result_id"]).where("confidence is not null").select("result_id", F.round(z, 6).alias("logit"), F.round(values.sigmoid(z), 6).alias("back"))


@query("SELECT i AS step, round(CASE WHEN i < 50 THEN (i + 1) / 50.0 ELSE 0.1 + 0.9 * 0.5 * (1 + cos(pi() * least(1.0, (i - 50) / 950.0))) END, 6) AS factor FROM range(0, 1000) t(i)")
def warmup_schedule(spark: SparkSession, folder: str) -> DataFrame:
    return spark.range(1000).select(F.col("id").alias("step"), F.round(values.warmup_cosine(F.col("id"), 1000, 0.05, 0.1), 6).alias("factor"))


# Edit counts and slices


_FORMS = f"""
    c AS (SELECT correction_id, any_value(action) AS action, any_value(evidence) AS evidence, {_sql_norm('any_value(new_text)')} AS r, {_sql_norm('any_value(old_text)')} AS h, any_value(new_text) IS NULL AS none FROM label_corrections GROUP BY correction_id),
    v AS (SELECT *, 'exact' AS variant, r AS ref, h AS hyp FROM c UNION ALL SELECT *, 'nocase', lower(r), lower(h) FROM c
    UNION ALL SELECT *, 'nodiac', lower({_sql_fold('r')}), lower({_sql_fold('h')}) FROM c),
    words AS (SELECT *, list_filter(string_split(ref, ' '), lambda w: w <> '') AS rw, list_filter(string_split(hyp, ' '), lambda w: w <> '') AS hw, {_sql_chars('ref')} AS rc, {_sql_chars('hyp')} AS hc FROM v),
    e AS (SELECT correction_id, action, evidence, none, variant, ref, hyp, {_sql_edit('rc', 'hc')} AS errors, length(ref) AS ref_len, {_sql_edit('rw', 'hw')} AS word_errors, len(rw) AS words FROM words)"""


def _edits(spark: SparkSession, folder: str) -> DataFrame:
    """A row for each correction with a new text and each variant: errors and length in code points of the whole texts."""
    rows = table(spark, folder, "label_corrections").dropDuplicates(["correction_id"]).where("new_text is not null")
    forms = edit.with_forms(rows, "new_text", "old_text")
    each = F.explode(F.array(*[F.struct(F.lit(v).alias("variant"), F.levenshtein(f"_ref.{v}", f"_hyp.{v}").alias("errors"), F.length(f"_ref.{v}").alias("ref_len")) for v in text.VARIANTS]))
    return forms.select("correction_id", "action", "evidence", each.alias("e")).select("correction_id", "action", "evidence", "e.*")


@query(f"WITH {_FORMS} SELECT correction_id, variant, errors, ref_len FROM e WHERE NOT none")
def char_edits(spark: SparkSession, folder: str) -> DataFrame:
    return _edits(spark, folder).select("correction_id", "variant", "errors", "ref_len")


_SCORES = ", ".join(f"max({c}) FILTER (variant = '{v}') AS {n}_{v}" for v in text.VARIANTS for c, n in (("errors", "char_err"), ("ref_len", "char_len"), ("word_errors", "word_err"), ("words", "word_len")))


@query(f"WITH {_FORMS} SELECT correction_id, {_SCORES}, max(cast(ref = hyp AS INT)) FILTER (variant = 'exact') AS exact_match FROM e WHERE NOT none GROUP BY 1")
def pair_scores(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "label_corrections").dropDuplicates(["correction_id"]).where("new_text is not null")
    return edit.score_pairs(rows, "new_text", "old_text", ["correction_id"])


@query(f"""
    WITH {_FORMS} SELECT variant, action, evidence, grouping(variant, action, evidence) AS level, count(*) AS pairs, round(sum(errors) / nullif(sum(ref_len), 0), 6) AS rate, round(avg(cast(errors = 0 AS INT)), 6) AS exact FROM e WHERE NOT none
    GROUP BY GROUPING SETS ((variant, action, evidence), (variant, action), (variant))""")
def corpus_rates(spark: SparkSession, folder: str) -> DataFrame:
    slices = _edits(spark, folder).groupingSets([["variant", "action", "evidence"], ["variant", "action"], ["variant"]], "variant", "action", "evidence")
    out = slices.agg(F.grouping_id().cast("bigint").alias("level"), F.count(F.lit(1)).alias("pairs"), F.round(edit.rate(F.col("errors"), F.col("ref_len")), 6).alias("rate"), F.round(F.avg((F.col("errors") == 0).cast("int")), 6).alias("exact"))
    return out.select("variant", "action", "evidence", "level", "pairs", "rate", "exact")


@query(f"""
    WITH {_LINES} SELECT engine, preproc, grouping(engine, preproc) AS level, count(*) AS n, count(DISTINCT image_id) AS pages, round(avg(rec_score), 6) AS mean_score, round(avg(cast(text IS NULL OR trim(text) = '' AS INT)), 6) AS blank
    FROM lines GROUP BY GROUPING SETS ((engine), (engine, preproc), ())""")
def line_slices(spark: SparkSession, folder: str) -> DataFrame:
    blank = (F.col("text").isNull() | (F.trim("text") == "")).cast("int")
    out = _lines(spark, folder).groupingSets([["engine"], ["engine", "preproc"], []], "engine", "preproc").agg(F.grouping_id().cast("bigint").alias("level"), F.count(F.lit(1)).alias("n"), F.countDistinct("image_id").alias("pages"), F.round(F.avg("rec_score"), 6).alias("mean_score"), F.round(F.avg(blank), 6).alias("blank"))
    return out.select("engine", "preproc", "level", "n", "pages", "mean_score", "blank")


@query("SELECT event_type, round(avg(value), 6) AS mean, round(quantile_cont(value, 0.95), 6) AS p95, round(quantile_cont(value, 0.5), 6) AS median FROM events GROUP BY 1")
def latencies(spark: SparkSession, folder: str) -> DataFrame:
    events = table(spark, folder, "events")
    mean = events.groupBy(F.col("event_type").alias("e")).agg(F.round(F.avg("value"), 6).alias("mean"))
    places = stats.exact_quantiles(events, "value", [0.95, 0.5], ["event_type"])
    return mean.join(places, F.col("e").eqNullSafe(F.col("event_type")), "left").select(F.col("e").alias("event_type"), "mean", F.round("q0", 6).alias("p95"), F.round("q1", 6).alias("median"))


@query("WITH s AS (SELECT l_returnflag, list_sort(list(l_quantity)) AS q FROM lineitem GROUP BY 1) SELECT l_returnflag, cast(q[len(q) // 2 + 1] AS DOUBLE) AS upper_median FROM s")
def upper_median(spark: SparkSession, folder: str) -> DataFrame:
    """The upper of the two middle values, from counts of distinct values, so that no group's rows are gathered."""
    counts = table(spark, folder, "lineitem").where("l_quantity is not null").groupBy("l_returnflag", "l_quantity").agg(F.count(F.lit(1)).alias("n"))
    packed = counts.groupBy("l_returnflag").agg(F.array_sort(F.collect_list(F.struct("l_quantity", "n"))).alias("v"), F.sum("n").alias("all"))
    start = F.struct(F.lit(0).cast("bigint").alias("seen"), F.lit(None).cast("double").alias("found"))
    walk = F.aggregate("v", start, lambda a, x: F.struct((a["seen"] + x["n"]).alias("seen"), F.when(a["found"].isNull() & (a["seen"] + x["n"] > F.floor(F.col("all") / 2)), x["l_quantity"].cast("double")).otherwise(a["found"]).alias("found")))
    return packed.select("l_returnflag", walk["found"].alias("upper_median"))


# Geometry


@query(f"""
    WITH {_LINES}, p AS (SELECT line_id, list_transform(polygon, lambda q: q[1]) AS x, list_transform(polygon, lambda q: q[2]) AS y, polygon AS g FROM lines WHERE polygon IS NOT NULL)
    SELECT line_id, round(list_min(x), 3) AS x0, round(list_min(y), 3) AS y0, round(list_max(x), 3) AS x1, round(list_max(y), 3) AS y1,
    round(abs(x[1] * y[2] - x[2] * y[1] + x[2] * y[3] - x[3] * y[2] + x[3] * y[4] - x[4] * y[3] + x[4] * y[1] - x[1] * y[4]) / 2, 3) AS area,
    round(greatest(1.0, least((sqrt(pow(x[2] - x[1], 2) + pow(y[2] - y[1], 2)) + sqrt(pow(x[4] - x[3], 2) + pow(y[4] - y[3], 2))) / 2, (sqrt(pow(x[3] - x[2], 2) + pow(y[3] - y[2], 2)) + sqrt(pow(x[1] - x[4], 2) + pow(y[1] - y[4], 2))) / 2)), 3) AS height FROM p""")
def line_boxes(spark: SparkSession, folder: str) -> DataFrame:
    p = F.col("polygon")
    rows = _lines(spark, folder).where("polygon is not null").select("line_id", geometry.box(p).alias("b"), geometry.area(p).alias("a"), geometry.text_height(p).alias("h"))
    return rows.select("line_id", *[F.round(f"b.{c}", 3).alias(c) for c in ("x0", "y0", "x1", "y1")], F.round("a", 3).alias("area"), F.round("h", 3).alias("height"))


@query()
def reading_rows(spark: SparkSession, folder: str) -> DataFrame:
    return spatial.reading_order(table(spark, folder, "ocr_lines")).select("image_id", "row", "pos", "idx", "line_no", "text")


_REGIONS = "m AS (SELECT image_id, any_value(regions) AS regions FROM ocr_manifest GROUP BY image_id), g AS (SELECT image_id, unnest(range(0, len(regions))) AS region_id, regions FROM m), regions AS (SELECT image_id, region_id, regions[region_id + 1].label AS label, regions[region_id + 1].role AS role, regions[region_id + 1].text AS text, regions[region_id + 1].bbox AS bbox FROM g)"
_HELD = f"""{_LINES}, {_REGIONS},
    b AS (SELECT image_id, line_id, list_min(list_transform(polygon, lambda q: q[1])) AS x0, list_min(list_transform(polygon, lambda q: q[2])) AS y0, list_max(list_transform(polygon, lambda q: q[1])) AS x1, list_max(list_transform(polygon, lambda q: q[2])) AS y1 FROM lines WHERE polygon IS NOT NULL),
    s AS (SELECT b.image_id, line_id, region_id, greatest(0, least(x1, bbox[1] + bbox[3]) - greatest(x0, bbox[1])) * greatest(0, least(y1, bbox[2] + bbox[4]) - greatest(y0, bbox[2])) / ((x1 - x0) * (y1 - y0)) AS share FROM b JOIN regions r ON r.image_id = b.image_id WHERE x1 > x0 AND y1 > y0),
    held AS (SELECT image_id, line_id, region_id, share FROM s WHERE share >= 0.5 QUALIFY row_number() OVER (PARTITION BY image_id, line_id ORDER BY share DESC, region_id DESC) = 1)"""


def _manifest(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "ocr_manifest").dropDuplicates(["image_id"])


@query(f"WITH {_HELD} SELECT image_id, line_id, region_id, round(share, 4) AS share FROM held")
def line_regions(spark: SparkSession, folder: str) -> DataFrame:
    held = spatial.lines_in_regions(_lines(spark, folder), spatial.regions_of(_manifest(spark, folder)))
    return held.select("image_id", "line_id", "region_id", F.round("share", 4).alias("share"))


@query(f"WITH {_HELD} SELECT r.label, r.role, count(*) AS n, count(h.region_id) AS matched FROM regions r LEFT JOIN (SELECT DISTINCT image_id, region_id FROM held) h ON h.image_id = r.image_id AND h.region_id = r.region_id GROUP BY ALL")
def region_coverage(spark: SparkSession, folder: str) -> DataFrame:
    """Regions are kept even if no line lies in them."""
    regions = spatial.regions_of(_manifest(spark, folder))
    held = spatial.lines_in_regions(_lines(spark, folder), regions).select("image_id", "region_id").distinct().withColumn("hit", F.lit(1))
    return regions.join(held, ["image_id", "region_id"], "left").groupBy("label", "role").agg(F.count(F.lit(1)).alias("n"), F.count("hit").alias("matched"))


@query("SELECT vec_id, cast(list_sum(list_transform(range(0, 56), lambda i: CASE WHEN embedding[(i // 7) * 8 + (i % 7) + 1] > embedding[(i // 7) * 8 + (i % 7) + 2] THEN cast(1 AS BIGINT) << i ELSE 0 END)) AS BIGINT) AS hash FROM embeddings")
def gradient_hashes(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "embeddings").select("vec_id", geometry.gradient_hash(F.col("embedding"), 8, 8).alias("hash"))


# Extraction


@query()
def extracted_fields(spark: SparkSession, folder: str) -> DataFrame:
    """The five fields of every page with their confidences and rules."""
    found = _extracted(spark, folder)
    return found.select("image_id", *[F.col(f"{f}.{part}").alias(f if part == "value" else f"{f}_{part}") for f in extract.FIELDS for part in ("value", "confidence", "rule")])


def _extracted(spark: SparkSession, folder: str) -> DataFrame:
    return extract.extract_fields(spatial.reading_order(table(spark, folder, "ocr_lines")), TODAY)


@query(f"""
    WITH {_LINES}, d AS (SELECT image_id, line_no FROM lines WHERE regexp_matches(text, '[0-9]{{2}}/[0-9]{{2}}/[0-9]{{4}}'))
    SELECT d.image_id, d.line_no, count(*) AS near_lines FROM d JOIN lines l ON l.image_id = d.image_id AND l.line_no BETWEEN d.line_no AND d.line_no + 2 GROUP BY ALL""")
def lines_below_dates(spark: SparkSession, folder: str) -> DataFrame:
    """A band join on the page: lines up to two below a line with a date."""
    lines = _lines(spark, folder)
    dated = lines.where(F.col("text").rlike("[0-9]{2}/[0-9]{2}/[0-9]{4}")).select("image_id", "line_no")
    near = dated.join(lines.select("image_id", F.col("line_no").alias("n")), "image_id").where("n between line_no and line_no + 2")
    return near.groupBy("image_id", "line_no").agg(F.count(F.lit(1)).alias("near_lines"))


# Corpus


@query("WITH h AS (SELECT DISTINCT image_hash AS h FROM ocr_manifest WHERE image_hash IS NOT NULL) SELECT a.h AS hash_a, b.h AS hash_b, cast(bit_count(xor(a.h, b.h)) AS INT) AS distance FROM h a JOIN h b ON a.h < b.h AND bit_count(xor(a.h, b.h)) <= 3")
def near_hashes(spark: SparkSession, folder: str) -> DataFrame:
    return corpus.near_hashes(table(spark, folder, "ocr_manifest"), "image_hash")


@query(f"""
    WITH r AS (SELECT DISTINCT image_id, nullif(gt.transaction_date, '') AS d, nullif(gt.transaction_time, '') AS t, nullif(gt.total, 0) AS s, coalesce(nullif({_sql_key('gt.merchant_name', 1, corpus.GENERIC_SELLER)}, ''), '') AS m FROM ocr_manifest),
    f AS (SELECT d, t, s, m, min(image_id) AS first FROM r WHERE d IS NOT NULL AND t IS NOT NULL AND s IS NOT NULL GROUP BY ALL) SELECT DISTINCT image_id AS record, first FROM r JOIN f USING (d, t, s, m) WHERE image_id <> first""")
def same_receipts(spark: SparkSession, folder: str) -> DataFrame:
    """Photographs of one sale: with the same date, time, total and seller, none of the first three missing."""
    pages = table(spark, folder, "ocr_manifest")
    of = corpus.seller_keys(pages).select("image_id", "any_name").distinct()
    sale = pages.select(F.col("image_id").alias("i"), F.nullif("gt.transaction_date", F.lit("")).alias("day"), F.nullif("gt.transaction_time", F.lit("")).alias("clock"), F.nullif("gt.total", F.lit(0)).alias("total")).distinct()
    return corpus.same_receipt_links(sale.join(of, F.col("i") == F.col("image_id")), [F.col("day"), F.col("clock"), F.col("total"), F.coalesce("any_name", F.lit(""))], "image_id")


@query()
def fuzzy_merchants(spark: SparkSession, folder: str) -> DataFrame:
    return corpus.fuzzy_pairs(corpus.seller_keys(_manifest(spark, folder)), "name", 0.86, "image_id")


@query()
def fuzzy_addresses(spark: SparkSession, folder: str) -> DataFrame:
    return corpus.fuzzy_pairs(corpus.seller_keys(_manifest(spark, folder)), "address", 0.90, "image_id")


@query()
def ground_truth(spark: SparkSession, folder: str) -> DataFrame:
    return corpus.ground_truth(spatial.regions_of(_manifest(spark, folder)))


@query(f"""
    WITH {_REGIONS} SELECT image_id, CASE WHEN count(DISTINCT text) = 1 THEN min(text) END AS stamp, count(DISTINCT text) > 1 AS ambiguous FROM regions WHERE label = 'TIMESTAMP' AND role = 'value' GROUP BY 1""")
def single_stamps(spark: SparkSession, folder: str) -> DataFrame:
    rows = spatial.regions_of(_manifest(spark, folder)).where("label = 'TIMESTAMP' and role = 'value'")
    n = F.countDistinct("text")
    return rows.groupBy("image_id").agg(F.when(n == 1, F.min("text")).alias("stamp"), (n > 1).alias("ambiguous"))


@query(f"""
    WITH {_REGIONS}, c AS (SELECT image_id, avg(bbox[1] + bbox[3] / 2.0) FILTER (label = 'SELLER') AS s, avg(bbox[1] + bbox[3] / 2.0) FILTER (label = 'ADDRESS') AS a, avg(bbox[1] + bbox[3] / 2.0) FILTER (label = 'TOTAL_COST') AS t FROM regions GROUP BY 1),
    v AS (SELECT image_id, cast(coalesce(sign(a - s), 0) + 2 * coalesce(sign(t - s), 0) + 2 * coalesce(sign(t - a), 0) AS INT) AS points FROM c)
    SELECT image_id, points, CASE WHEN points > 0 THEN 'cw' WHEN points < 0 THEN 'ccw' END AS rotation FROM v""")
def rotation_votes(spark: SparkSession, folder: str) -> DataFrame:
    return corpus.rotation_votes(spatial.regions_of(_manifest(spark, folder)))


@query(f"""
    WITH {_REGIONS}, w AS (SELECT r.image_id, count(*) AS n, count(*) FILTER (role = 'value') AS n_values, count(*) FILTER (text IS NULL OR trim(text) = '') AS n_blank FROM regions r GROUP BY 1)
    SELECT coalesce(lower(trim(m.split)), 'none') AS split, count(*) AS pages, cast(sum(coalesce(n, 0)) AS BIGINT) AS regions, cast(sum(coalesce(n_values, 0)) AS BIGINT) AS value_regions, cast(sum(coalesce(n_blank, 0)) AS BIGINT) AS blank_regions, round(avg(quality), 6) AS quality
    FROM (SELECT image_id, any_value(split) AS split, any_value(quality) AS quality FROM ocr_manifest GROUP BY 1) m LEFT JOIN w ON w.image_id = m.image_id GROUP BY 1""")
def data_card(spark: SparkSession, folder: str) -> DataFrame:
    """Pages, regions and mean quality of each split; pages without regions count."""
    pages = _manifest(spark, folder)
    blank = F.col("text").isNull() | (F.trim("text") == "")
    each = spatial.regions_of(pages).groupBy(F.col("image_id").alias("i")).agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("role") == "value", 1)).alias("v"), F.count(F.when(blank, 1)).alias("b"))
    zero = lambda c: F.sum(F.coalesce(F.col(c), F.lit(0)))
    return pages.join(each, F.col("image_id") == F.col("i"), "left").groupBy(F.coalesce(F.lower(F.trim("split")), F.lit("none")).alias("split")).agg(F.count(F.lit(1)).alias("pages"), zero("n").alias("regions"), zero("v").alias("value_regions"), zero("b").alias("blank_regions"), F.round(F.avg("quality"), 6).alias("quality"))


_TRAIN = "t AS (SELECT image_id, min(nullif(regexp_extract(lower(group_id), '0*([0-9]+)', 1), '')) AS g FROM ocr_manifest WHERE lower(trim(split)) = 'train' GROUP BY image_id)"


def _train(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "ocr_manifest").where(F.lower(F.trim("split")) == "train")
    return rows.groupBy("image_id").agg(F.min(F.nullif(F.regexp_extract(F.lower("group_id"), "0*([0-9]+)", 1), F.lit(""))).alias("g"))


@query(f"""
    WITH {_TRAIN}, n AS (SELECT image_id, g, count(*) OVER (PARTITION BY g) AS n FROM t), m AS (SELECT avg(1 / sqrt(n)) AS m FROM n)
    SELECT image_id, g, round(least(1 / sqrt(n) / m, 3.0), 4) AS sample_weight FROM n, m""")
def sample_weights(spark: SparkSession, folder: str) -> DataFrame:
    return corpus.sample_weights(_train(spark, folder), "g")


@query("SELECT l_orderkey, l_linenumber, cast(floor((row_number() OVER (ORDER BY l_quantity / l_extendedprice, l_orderkey * 8 + l_linenumber) - 1) / 64) AS BIGINT) AS batch FROM lineitem")
def width_batches(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("k"))
    return corpus.width_batches(rows, "k", "l_quantity", "l_extendedprice", 64).select("l_orderkey", "l_linenumber", F.col("batch").cast("bigint").alias("batch"))


@query(f"""
    WITH {_LINES}, a AS (SELECT image_id, line_id, (list_max(list_transform(polygon, lambda q: q[1])) - list_min(list_transform(polygon, lambda q: q[1]))) * (list_max(list_transform(polygon, lambda q: q[2])) - list_min(list_transform(polygon, lambda q: q[2]))) AS area FROM lines WHERE polygon IS NOT NULL)
    SELECT image_id, line_id FROM a QUALIFY row_number() OVER (PARTITION BY image_id ORDER BY area DESC, line_id) <= 3""")
def largest_lines(spark: SparkSession, folder: str) -> DataFrame:
    b = geometry.box(F.col("polygon"))
    rows = _lines(spark, folder).where("polygon is not null").select("image_id", "line_id", ((b["x1"] - b["x0"]) * (b["y1"] - b["y0"])).alias("area"))
    return corpus.top_of_group(rows, "image_id", [F.col("area").desc(), F.col("line_id")], 3).select("image_id", "line_id")


@query()
def balanced_draws(spark: SparkSession, folder: str) -> DataFrame:
    return corpus.balanced_epoch(table(spark, folder, "documents"), "source", "text", "doc_id", 2, 0.5, 1000, 7)


@query()
def seeded_split(spark: SparkSession, folder: str) -> DataFrame:
    """(image_id, g, split): whole groups in train, val and test, and a share of each big group in test_seen. Photographs
    without a group are groups of their own."""
    number = F.nullif(F.regexp_extract(F.lower("group_id"), "0*([0-9]+)", 1), F.lit(""))
    rows = _manifest(spark, folder).where("image_id is not null").withColumn("g", F.coalesce(number, F.concat(F.lit("i"), F.col("image_id"))))
    given = {c: F.col(c).isNotNull() for c in ("gt.merchant_name", "gt.merchant_address", "gt.transaction_date", "gt.total", "orientation_fix")}
    features = {f"f{i}": v.cast("double") for i, v in enumerate([*given.values(), F.col("quality") < 0.5, F.col("quality")])}
    groups = rows.groupBy("g").agg(F.count(F.lit(1)).alias("n"), *[F.sum(v).alias(k) for k, v in features.items()]).na.fill(0.0)
    chosen = corpus.seeded_group_split(groups, "g", "n", {"val": 0.1, "test": 0.13}, list(features))
    split = spark.createDataFrame(chosen, "k string, split string")
    seen = corpus.seen_draws(rows, "g", "image_id", F.col("dup_of").isNotNull(), chosen.attrs["seed"])
    out = rows.select("image_id", "g").join(split, F.col("g") == F.col("k")).join(seen, F.col("image_id") == F.col("record"), "left")
    return out.select("image_id", "g", F.when(F.col("record").isNotNull(), "test_seen").otherwise(F.col("split")).alias("split"))


@query(f"""
    WITH {_LINES}, v AS (SELECT * FROM lines WHERE det_score BETWEEN 0 AND 1 AND rec_score BETWEEN 0 AND 1 AND NOT isnan(det_score) AND NOT isnan(rec_score)),
    s AS (SELECT image_id, count(*) AS valid_lines, quantile_cont(det_score, 0.5) AS a, quantile_cont(rec_score, 0.5) AS b, quantile_cont(rec_score - det_score, 0.5) AS m, avg(cast(rec_score - det_score > 0 AS INT)) AS f FROM v GROUP BY 1)
    SELECT image_id, valid_lines, round(m, 6) AS median_margin, round(f, 6) AS vote_fraction_180, CASE WHEN valid_lines >= 3 AND m >= 0.05 AND f >= 0.6 AND b >= 0.5 THEN 180 ELSE 0 END AS degrees FROM s""")
def orientation_votes(spark: SparkSession, folder: str) -> DataFrame:
    """Two scores of each line stand for its readings upright and turned."""
    out = corpus.orientation_votes(_lines(spark, folder), "image_id", "det_score", "rec_score")
    return out.select("image_id", "valid_lines", F.round("median_margin", 6).alias("median_margin"), F.round("vote_fraction_180", 6).alias("vote_fraction_180"), "degrees")


# Labelled results, calibration and risk

_LABELS = """
    r AS (SELECT result_id, any_value(image_id) AS image_id, any_value(field_key) AS field_key, any_value(value) AS value, any_value(confidence) AS confidence FROM field_results GROUP BY result_id),
    m AS (SELECT image_id, any_value(gt) AS gt, min(nullif(regexp_extract(lower(group_id), '0*([0-9]+)', 1), '')) AS g FROM ocr_manifest GROUP BY image_id),
    x AS (SELECT result_id, field_key, value, confidence AS p, coalesce(g, 'i' || r.image_id) AS g, CASE field_key WHEN 'merchant_name' THEN gt.merchant_name WHEN 'merchant_address' THEN gt.merchant_address WHEN 'date' THEN gt.transaction_date WHEN 'time' THEN gt.transaction_time WHEN 'total' THEN cast(gt.total AS VARCHAR) END AS truth FROM r JOIN m ON m.image_id = r.image_id),
    labels AS (SELECT result_id, field_key, p, g, cast(value = truth AS INT) AS y FROM x WHERE value IS NOT NULL AND truth IS NOT NULL AND p IS NOT NULL),
    weighed AS (SELECT *, (SELECT count(*) FROM labels) / ((SELECT count(DISTINCT g) FROM labels) * count(*) OVER (PARTITION BY g)) AS w FROM labels)"""


def _labels(spark: SparkSession, folder: str) -> DataFrame:
    """Results with whether they equal the ground truth; rows without a value, a truth or a confidence are left out."""
    results = table(spark, folder, "field_results").dropDuplicates(["result_id"]).select("result_id", F.col("image_id").alias("i"), "field_key", "value", F.col("confidence").alias("p"))
    pages = table(spark, folder, "ocr_manifest").groupBy("image_id").agg(F.first("gt").alias("gt"), F.min(F.nullif(F.regexp_extract(F.lower("group_id"), "0*([0-9]+)", 1), F.lit(""))).alias("g"))
    k = F.col("field_key")
    truth = F.when(k == "merchant_name", F.col("gt.merchant_name")).when(k == "merchant_address", F.col("gt.merchant_address")).when(k == "date", F.col("gt.transaction_date")).when(k == "time", F.col("gt.transaction_time")).when(k == "total", F.col("gt.total").cast("string"))
    rows = results.join(pages, F.col("i") == F.col("image_id")).withColumn("truth", truth).where("value is not null and truth is not null and p is not null")
    return rows.select("result_id", "field_key", "p", F.coalesce("g", F.concat(F.lit("i"), F.col("i"))).alias("g"), (F.col("value") == F.col("truth")).cast("int").alias("y"))


def _weighed(spark: SparkSession, folder: str) -> DataFrame:
    return stats.with_group_weights(_labels(spark, folder), "g")


@query(f"WITH {_LABELS} SELECT field_key, count(*) AS n, cast(sum(y) AS BIGINT) AS correct, round(avg(y), 6) AS accuracy FROM labels GROUP BY 1")
def field_accuracy(spark: SparkSession, folder: str) -> DataFrame:
    return _labels(spark, folder).groupBy("field_key").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("correct"), F.round(F.avg("y"), 6).alias("accuracy"))


@query(f"WITH {_LABELS} SELECT g, min(result_id) AS first, cast(sum(y) AS BIGINT) AS y, count(*) AS n FROM labels GROUP BY 1")
def group_sums(spark: SparkSession, folder: str) -> DataFrame:
    return stats.group_sums(_labels(spark, folder).withColumn("n", F.lit(1)), "g", "result_id", "y", "n")


@query(f"WITH {_LABELS} SELECT result_id, round(w, 6) AS w FROM weighed")
def group_weights(spark: SparkSession, folder: str) -> DataFrame:
    return _weighed(spark, folder).select("result_id", F.round("w", 6).alias("w"))


_TAUS = [0.5, 0.55, 0.6, 0.65, 0.7, 0.75, 0.8, 0.85, 0.9]


@query(f"WITH {_LABELS}, t AS (SELECT unnest({_TAUS}::DOUBLE[]) AS tau) SELECT tau, count(*) FILTER (p >= tau) AS documents, round(coalesce(sum(w) FILTER (p >= tau), 0) / sum(w), 6) AS coverage, round(1 - sum(w * y) FILTER (p >= tau) / sum(w) FILTER (p >= tau), 6) AS error_rate FROM weighed, t GROUP BY tau")
def risk_coverage(spark: SparkSession, folder: str) -> DataFrame:
    out = stats.risk_coverage(_weighed(spark, folder), "p", "y", "w", _TAUS)
    return out.select("tau", "documents", F.round("coverage", 6).alias("coverage"), F.round("error_rate", 6).alias("error_rate"))


@query(f"""
    WITH {_LABELS}, c AS (SELECT p, sum(w) AS w, sum(w * y) AS g, count(*) AS n FROM weighed GROUP BY p),
    k AS (SELECT p, sum(w) OVER o AS w, sum(g) OVER o AS g, sum(n) OVER o AS n FROM c WINDOW o AS (ORDER BY p DESC)) SELECT min(p) AS tau FROM k WHERE n >= 15 AND 1 - g / w <= 0.4""")
def choose_tau(spark: SparkSession, folder: str) -> DataFrame:
    return stats.choose_tau(_weighed(spark, folder), "p", "y", "w", 0.4)


@query(f"""
    WITH {_LABELS}, c AS (SELECT p, coalesce(sum(w) FILTER (y = 1), 0) AS pos, coalesce(sum(w) FILTER (y = 0), 0) AS neg FROM weighed GROUP BY p),
    k AS (SELECT *, sum(pos) OVER (ORDER BY p DESC) - pos / 2 AS above FROM c) SELECT round(sum(neg * above) / (sum(pos) * sum(neg)), 6) AS auroc FROM k""")
def auroc(spark: SparkSession, folder: str) -> DataFrame:
    return stats.auroc(_weighed(spark, folder), "p", "y", "w").select(F.round("auroc", 6).alias("auroc"))


@query(f"WITH {_LABELS}, q AS (SELECT least(greatest(p, 1e-4), 1 - 1e-4) AS p, y, w FROM weighed) SELECT round(sum(w * pow(p - y, 2)) / sum(w), 6) AS brier, round(-sum(w * (y * ln(p) + (1 - y) * ln(1 - p))) / sum(w), 6) AS log_loss FROM q")
def brier_log_loss(spark: SparkSession, folder: str) -> DataFrame:
    out = stats.brier_log_loss(_weighed(spark, folder), "p", "y", "w")
    return out.select(F.round("brier", 6).alias("brier"), F.round("log_loss", 6).alias("log_loss"))


@query(f"""
    WITH {_LABELS}, q AS (SELECT least(greatest(p, 1e-4), 1 - 1e-4) AS p, y, w FROM weighed), e AS (SELECT quantile_cont(p, [0.0, 0.2, 0.4, 0.6, 0.8, 1.0]) AS e FROM q),
    b AS (SELECT len(list_filter(e, lambda x: x <= p AND (p < e[6] OR x < e[6]))) AS bin, p, y, w FROM q, e), s AS (SELECT bin, abs(sum(w * p) - sum(w * y)) AS d, sum(w) AS w FROM b GROUP BY bin)
    SELECT round(sum(d) / sum(w), 6) AS ece FROM s""")
def calibration_error(spark: SparkSession, folder: str) -> DataFrame:
    return stats.calibration_error(_weighed(spark, folder), "p", "y", "w").select(F.round("ece", 6).alias("ece"))


def _features(spark: SparkSession, folder: str) -> DataFrame:
    lengths = table(spark, folder, "field_results").dropDuplicates(["result_id"]).select(F.col("result_id").alias("k"), F.length("value").cast("double").alias("len"))
    return _weighed(spark, folder).join(lengths, F.col("result_id") == F.col("k")).select("result_id", "g", F.col("p").alias("conf"), "len", "y", "w")


@query(f"WITH {_LABELS} SELECT l.result_id, round(1 / (1 + exp(-least(greatest(0.3 + (p - 0.7) / 0.2 * 1.25 + (length(value) - 12.0) / 6.0 * -0.4, -30), 30))), 6) AS prob FROM labels l JOIN r ON r.result_id = l.result_id")
def logistic_scores(spark: SparkSession, folder: str) -> DataFrame:
    return _features(spark, folder).select("result_id", F.round(stats.logistic_score([F.col("conf"), F.col("len")], MODEL), 6).alias("prob"))


@query()
def logistic_fit(spark: SparkSession, folder: str) -> DataFrame:
    model = stats.fit_logistic(_features(spark, folder).cache(), ["conf", "len"], "y", "w")
    return spark.createDataFrame([(n, float(c)) for n, c in zip(("intercept", "conf", "len"), [model["intercept"], *model["coef"]])], "name string, coefficient double")


@query()
def out_of_fold(spark: SparkSession, folder: str) -> DataFrame:
    return stats.grouped_out_of_fold(_features(spark, folder).drop("w").cache(), "result_id", "g", ["conf", "len"], "y", folds=10, repeats=5)


@query()
def bootstrap(spark: SparkSession, folder: str) -> DataFrame:
    """Intervals of the share of right results of each field, and over all of its difference between names and dates."""
    rows = _labels(spark, folder).withColumn("n", F.lit(1))
    for name, key in (("a", "merchant_name"), ("b", "date")):
        is_key = F.col("field_key") == key
        rows = rows.withColumn(f"n{name}", is_key.cast("int")).withColumn(f"y{name}", F.when(is_key, F.col("y")).otherwise(0))
    ratios = {"right": stats.Ratio("y", "n"), "name_less_date": stats.Ratio("ya", "na", ("yb", "nb"))}
    whole = stats.bootstrap_intervals(rows, [], "g", "result_id", ratios).withColumn("field_key", F.lit("all"))
    return stats.bootstrap_intervals(rows, ["field_key"], "g", "result_id", {"right": ratios["right"]}).unionByName(whole)


# Audits


@query("SELECT line_id, count(*) AS n FROM ocr_lines GROUP BY 1 HAVING count(*) > 1")
def repeated_lines(spark: SparkSession, folder: str) -> DataFrame:
    return audits.not_exactly_once(table(spark, folder, "ocr_lines"), ["line_id"])


@query("""
    WITH a AS (SELECT image_id, count(*) AS n FROM receipts GROUP BY 1), b AS (SELECT image_id, count(*) AS n FROM ocr_manifest GROUP BY 1)
    SELECT image_id, coalesce(a.n, 0) AS in_left, coalesce(b.n, 0) AS in_right FROM a FULL OUTER JOIN b USING (image_id) WHERE coalesce(a.n, 0) <> 1 OR coalesce(b.n, 0) <> 1""")
def receipt_matches(spark: SparkSession, folder: str) -> DataFrame:
    return audits.match_audit(table(spark, folder, "receipts"), table(spark, folder, "ocr_manifest"), "image_id")


@query("""
    WITH a AS (SELECT DISTINCT o_orderkey AS k FROM orders), b AS (SELECT DISTINCT l_orderkey AS k FROM lineitem)
    SELECT k, 'left' AS side FROM a ANTI JOIN b USING (k) UNION ALL SELECT k, 'right' FROM b ANTI JOIN a USING (k)""")
def order_orphans(spark: SparkSession, folder: str) -> DataFrame:
    return audits.orphans(table(spark, folder, "orders").select(F.col("o_orderkey").alias("k")), table(spark, folder, "lineitem").select(F.col("l_orderkey").alias("k")), "k")


@query("""
    WITH s AS (SELECT DISTINCT lower(trim(split)) AS s, image_hash AS h, nullif(regexp_extract(lower(group_id), '0*([0-9]+)', 1), '') AS g FROM ocr_manifest WHERE split IS NOT NULL),
    v AS (SELECT DISTINCT 'group' AS mark, g AS v, s FROM s WHERE g IS NOT NULL UNION ALL SELECT DISTINCT 'hash', cast(h AS VARCHAR), s FROM s WHERE h IS NOT NULL)
    SELECT a.mark, a.s AS split_a, b.s AS split_b, count(*) AS n FROM v a JOIN v b ON a.mark = b.mark AND a.v = b.v AND a.s < b.s GROUP BY ALL""")
def split_leakage(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "ocr_manifest").select(F.lower(F.trim("split")).alias("s"), "image_hash", F.nullif(F.regexp_extract(F.lower("group_id"), "0*([0-9]+)", 1), F.lit("")).alias("g"))
    return audits.leakage(rows, "s", {"group": F.col("g"), "hash": F.col("image_hash")})


@query("""
    WITH k AS (SELECT sample_id, count(DISTINCT (coalesce(action, ''), coalesce(new_text, ''))) AS n FROM label_corrections GROUP BY 1)
    SELECT CASE WHEN n > 1 THEN 'conflict' WHEN action = 'exclude' THEN 'exclude' WHEN new_text IS NULL THEN 'empty' WHEN old_text IS NOT DISTINCT FROM new_text THEN 'stale' ELSE 'apply' END AS state, count(*) AS n
    FROM label_corrections c JOIN k ON c.sample_id IS NOT DISTINCT FROM k.sample_id GROUP BY 1""")
def correction_states(spark: SparkSession, folder: str) -> DataFrame:
    return audits.corrections_state(table(spark, folder, "label_corrections"), "sample_id").groupBy("state").agg(F.count(F.lit(1)).alias("n"))


@query("""
    WITH v AS (SELECT id, list_filter([CASE WHEN NOT (total_amount >= 0) THEN 'total' END, CASE WHEN NOT (doc_confidence BETWEEN 0.5 AND 1) THEN 'confidence' END, CASE WHEN NOT (currency = 'VND') THEN 'currency' END, CASE WHEN tax_code IS NOT NULL AND NOT regexp_matches(tax_code, '^[0-9]{10}$') THEN 'tax_code' END], lambda x: x IS NOT NULL) AS broken FROM receipts)
    SELECT id, array_to_string(broken, ',') AS broken FROM v WHERE len(broken) > 0""")
def constraint_violations(spark: SparkSession, folder: str) -> DataFrame:
    rules = {"total": F.col("total_amount") >= 0, "confidence": F.col("doc_confidence").between(0.5, 1), "currency": F.col("currency") == "VND", "tax_code": F.col("tax_code").isNull() | F.col("tax_code").rlike("^[0-9]{10}$")}
    return audits.violations(table(spark, folder, "receipts"), "id", rules).select("id", F.array_join("broken", ",").alias("broken"))


# Sources and sinks


def _shared(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


@query("SELECT correction_id, sample_id, old_text, new_text, action FROM label_corrections")
def jsonl_roundtrip(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "label_corrections").select("correction_id", "sample_id", "old_text", "new_text", "action")
    path = _shared(spark, "jsonl")
    files.write_jsonl(rows, path)
    return files.read_jsonl(spark, path, rows.schema)


@query("SELECT doc_id, i AS place, string_split(replace(text, chr(10), '|||'), '|||')[i] AS line FROM (SELECT doc_id, text, unnest(range(1, len(string_split(replace(text, chr(10), '|||'), '|||')) + 1)) AS i FROM documents WHERE layout = 'page' AND text IS NOT NULL)")
def csv_lists(spark: SparkSession, folder: str) -> DataFrame:
    """Lines of pages are packed into one CSV field with ||| between them, written, read and unpacked again."""
    pages = table(spark, folder, "documents").where("layout = 'page' and text is not null")
    packed = pages.select("doc_id", F.replace(F.col("text"), F.lit("\n"), F.lit("|||")).alias("packed"))
    path = _shared(spark, "csv")
    files.write_csv(packed, path)
    back = files.read_csv(spark, path, packed.schema)
    return back.select("doc_id", F.posexplode(files.split_lists(F.col("packed"))).alias("p", "line")).select("doc_id", (F.col("p") + 1).cast("bigint").alias("place"), "line")


@query("SELECT event_type, cast(json_extract(props, '$.k') AS INT) AS k, count(*) AS n FROM events GROUP BY ALL")
def json_props(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "events").groupBy("event_type", F.from_json("props", "k int")["k"].alias("k")).agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {_REGIONS} SELECT image_id, cast(region_id + 1 AS INT) AS line_no, label, role, text FROM regions")
def region_rows(spark: SparkSession, folder: str) -> DataFrame:
    return files.flatten_items(_manifest(spark, folder), "image_id", "regions").select("image_id", "line_no", "label", "role", "text")


@query()
def model_stub(spark: SparkSession, folder: str) -> DataFrame:
    """The interface for models with a stand-in that scores a text by its length."""
    return files.infer(_lines(spark, folder).select("line_id", F.coalesce("text", F.lit("")).alias("text")), lambda rows: rows.assign(score=rows["text"].str.len() / 100.0)[["line_id", "score"]], "line_id long, score double", order="line_id")


@query("""
    WITH w AS (SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, round(sum(value), 3) AS total FROM events WHERE ts IS NOT NULL GROUP BY ALL)
    SELECT w.* FROM w, (SELECT max(ts) - INTERVAL 1 DAY AS mark FROM events) WHERE start + INTERVAL 1 HOUR <= mark""")
def stream_windows(spark: SparkSession, folder: str) -> DataFrame:
    """An extension: all that a file source holds, through a streaming query with a watermark of a day, as far as it is closed."""
    return windows.drain(spark, f"{folder}/events.parquet", "windows").select("start", "event_type", "n", F.round("total", 3).alias("total"))


# Timestamps


@query()
def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    return with_instants(table(spark, folder, "receipt_flow"), "flow_id", table(spark, folder, "terminals"), InstantDictionary(spark))


@query()
def p7_formats(spark: SparkSession, folder: str) -> DataFrame:
    """How many rows of each locale fix an instant, by the shape of their texts."""
    flow = table(spark, folder, "receipt_flow").dropDuplicates(["flow_id"])
    found = with_instants(flow, "flow_id", table(spark, folder, "terminals"), InstantDictionary(spark)).select(F.col("flow_id").alias("f"), "epoch_s")
    shape = lambda c: F.regexp_replace(F.coalesce(c, F.lit("")), r"\d", "9")
    return flow.join(found, F.col("flow_id") == F.col("f"), "left").groupBy(shape(F.col("date_text")).alias("date_shape"), shape(F.col("time_text")).alias("time_shape")).agg(F.count(F.lit(1)).alias("n"), F.count("epoch_s").alias("fixed"))


def flagship(spark: SparkSession, folder: str) -> DataFrame:
    """Fields of all pages, from lines in reading order to one row a page."""
    return extracted_fields(spark, folder)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    from slipworks.plans import reports  # adds its own

    return dict(reports._QUERIES)


def oracle_sql() -> dict[str, str]:
    from slipworks.plans import reports

    return dict(reports._SQL)
