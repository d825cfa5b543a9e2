"""Runs of a model over crops: in batches of like shapes, with exactly one result for each crop, and a note of how it was made."""

from __future__ import annotations

import hashlib
import json
import platform
from collections.abc import Callable

import pandas as pd
import pyspark
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slipworks.operators.audits import match_audit
from slipworks.sources.documents import publish
from slipworks.sources.files import infer


def provenance(settings: dict, sources: dict[str, str]) -> dict:
    """What a result depends on: settings and their hash, hashes of what was read, and versions."""
    text = json.dumps(settings, sort_keys=True, ensure_ascii=False)
    return {"settings": settings, "settings_sha256": hashlib.sha256(text.encode()).hexdigest(), "sources": dict(sorted(sources.items())), "spark": pyspark.__version__, "python": platform.python_version()}


def exactly_once(results: DataFrame, samples: DataFrame, key: str) -> DataFrame:
    """The results, if there is one for each sample and none besides; else an error that names the first."""
    odd = match_audit(results, samples, key).orderBy(key).first()
    if odd:
        raise ValueError(f"{odd[key]} has {odd['in_left']} results for {odd['in_right']} samples")
    return results


def recognised(crops: DataFrame, model: Callable[[pd.DataFrame], pd.DataFrame], key: str = "sample_id") -> DataFrame:
    """(key, text, rec_score) of every crop. Crops go to the model in order of width over height within each part, so that a batch
    holds like shapes; ``model`` makes of a batch with key, width, height and pixels the rows of its results, in any order."""
    shaped = crops.select(key, "width", "height", "pixels", (F.col("width") / F.greatest("height", F.lit(1))).alias("_shape"))
    kind = crops.schema[key].dataType.simpleString()
    return infer(shaped, lambda rows: model(rows.drop(columns="_shape"))[[key, "text", "rec_score"]], f"`{key}` {kind}, text string, rec_score double", order="_shape")


def publish_run(crops: DataFrame, model: Callable[[pd.DataFrame], pd.DataFrame], path: str, settings: dict, sources: dict[str, str], key: str = "sample_id") -> DataFrame:
    """Recognises all crops once, stores the results and checks what is stored; the note that marks the run as complete is written
    only if there is exactly one result for each crop. An existing run is refused."""
    spark = crops.sparkSession
    part = f"{path}.part"
    recognised(crops, model, key).write.mode("overwrite").parquet(part)
    checked = exactly_once(spark.read.parquet(part), crops, key)
    publish(checked, path, provenance(settings, sources))
    at = spark._jvm.org.apache.hadoop.fs.Path(part)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    return spark.read.parquet(path)


def probed_both_ways(crops: DataFrame, model: Callable[[pd.DataFrame], pd.DataFrame], key: str = "sample_id") -> DataFrame:
    """(key, image_id, upright, turned): the score of every crop as it is and turned by 180 degrees; null for a reading without text.
    What ``corpus.orientation_votes`` decides by."""
    turned = F.reverse(F.transform(F.split(F.hex("pixels"), "(?<=\\G.{2})"), lambda b: b))
    both = crops.select(key, "image_id", "width", "height", F.explode(F.array(F.struct(F.lit("upright").alias("way"), F.col("pixels")), F.struct(F.lit("turned").alias("way"), F.unhex(F.array_join(turned, "")).alias("pixels")))).alias("x"))
    named = both.select(F.struct(key, "image_id", "x.way").alias("probe"), "width", "height", F.col("x.pixels").alias("pixels"))
    read = recognised(named.withColumn("probe", F.to_json("probe")), model, "probe")
    of = read.select(F.from_json("probe", f"`{key}` {crops.schema[key].dataType.simpleString()}, image_id string, way string").alias("p"), F.when(F.trim("text") != "", F.col("rec_score")).alias("s"))
    each = lambda way: F.max(F.when(F.col("p.way") == way, F.col("s"))).alias(way)
    return of.groupBy(F.col(f"p.{key}").alias(key), F.col("p.image_id").alias("image_id")).agg(each("upright"), each("turned"))


def replayed(stored: DataFrame, crops: DataFrame, note: dict, settings: dict, key: str = "sample_id") -> DataFrame:
    """Probes of an earlier run, if it had the same settings and has one result for each crop; else an error."""
    if note.get("settings_sha256") != provenance(settings, {})["settings_sha256"]:
        raise ValueError("the stored run had other settings")
    return exactly_once(stored, crops, key)
