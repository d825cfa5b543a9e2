"""Readers and writers of the formats around the parquet tables, and the interface for models."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def read_jsonl(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """One object a line, blank lines skipped; anything else that doesn't parse fails the read."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def write_jsonl(df: DataFrame, path: str) -> None:
    """Refuses an existing path and numbers that JSON hasn't got."""
    bad = [F.isnan(c) | (F.abs(F.col(c)) == float("inf")) for c, kind in df.dtypes if kind in ("double", "float")]
    guarded = df
    for b in bad:
        guarded = guarded.where(F.when(b, F.raise_error(F.lit("a number that JSON can't hold"))).otherwise(F.lit(True)).cast("boolean"))
    guarded.write.mode("errorifexists").option("ignoreNullFields", "false").json(path)


# How CSV is written here. Blanks at the ends and empty texts stay as they are, a null is an empty field.
CSV = {"header": "true", "quote": '"', "escape": '"', "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false", "emptyValue": '""', "nullValue": ""}


def read_csv(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """Rows of CSV with a header; fields may hold line ends and quotes. A row that doesn't fit the schema fails the read."""
    return spark.read.schema(schema).options(**CSV | {"emptyValue": ""}).option("multiLine", "true").option("mode", "FAILFAST").csv(path)


def write_csv(df: DataFrame, path: str) -> None:
    """Refuses an existing path. A carriage return would come back as a line feed, so a text with one is refused."""
    texts = [c for c, kind in df.dtypes if kind == "string"]
    checked = df.select(*[F.when(F.contains(F.col(c), F.lit("\r")), F.raise_error(F.lit("a carriage return, which CSV can't keep"))).otherwise(F.col(c)).alias(c) if c in texts else F.col(c) for c in df.columns])
    checked.write.mode("errorifexists").options(**CSV).csv(path)


def split_lists(packed: Column, mark: str = "|||") -> Column:
    """The parts of a packed list; null stays null."""
    return F.split(packed, "".join("\\" + c for c in mark))


def python_literal(text: Column, schema: str) -> Column:
    """A list or dict literal with single quotes as a struct; null if a value holds a quote or nothing parses."""
    return F.from_json(F.replace(F.replace(text, F.lit("'"), F.lit('"')), F.lit("None"), F.lit("null")), schema)


def read_tsv(spark: SparkSession, path: str) -> DataFrame:
    """(path, text): lines cut at the first tab."""
    parts = F.split("value", "\t", 2)
    return spark.read.text(path).where("value <> ''").select(parts[0].alias("path"), F.coalesce(F.get(parts, F.lit(1)), F.lit("")).alias("text"))


def write_tsv(df: DataFrame, path: str, columns: list[str]) -> None:
    df.select(F.concat_ws("\t", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns])).write.mode("errorifexists").text(path)


def read_images(spark: SparkSession, path: str) -> DataFrame:
    """(path, content, sha256) of files; decoding is up to a model."""
    return spark.read.format("binaryFile").load(path).select("path", "content", F.sha2("content", 256).alias("sha256"))


def safe_path(root: str, relative: str) -> str:
    """The path below a root; one that leads out of it is refused."""
    import posixpath

    whole = posixpath.normpath(posixpath.join(root, relative))
    if whole != root.rstrip("/") and not whole.startswith(root.rstrip("/") + "/"):
        raise ValueError(f"{relative} leads out of {root}")
    return whole


def infer(df: DataFrame, model: Callable[[pd.DataFrame], pd.DataFrame], schema: str, order: str | None = None) -> DataFrame:
    """Applies a model to Arrow batches; with ``order`` rows are sorted within partitions first, so that batches are alike."""
    rows = df.sortWithinPartitions(order) if order else df

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield model(batch)

    return rows.mapInPandas(run, schema)


def flatten_items(df: DataFrame, key: str, items: str) -> DataFrame:
    """One row for each item with its number from 1."""
    return df.select(key, F.posexplode(items).alias("p", "item")).select(key, (F.col("p") + 1).alias("line_no"), "item.*")
