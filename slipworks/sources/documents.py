"""Single documents around the tables: JSON files, settings, schemas, tasks for annotators and the log of experiments."""

from __future__ import annotations

import json
import math
import os
import uuid
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DataType, DateType, DecimalType, DoubleType, FloatType, IntegerType, LongType, MapType, ShortType, StringType, StructType, TimestampType


def _files(spark: SparkSession, path: str) -> tuple[Any, Any]:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def _finite(value: Any) -> Any:
    if isinstance(value, float) and not math.isfinite(value):
        raise ValueError("a number that JSON can't hold")
    for v in value.values() if isinstance(value, dict) else value if isinstance(value, (list, tuple)) else ():
        _finite(v)
    return value


def write_document(spark: SparkSession, document: dict, path: str) -> None:
    """One JSON file, complete or not there at all: it is written beside its place and moved. An existing file is refused."""
    text = json.dumps(_finite(document), ensure_ascii=False, indent=2, sort_keys=True)
    at, files = _files(spark, path)
    if files.exists(at):
        raise FileExistsError(path)
    part, _ = _files(spark, f"{path}.{uuid.uuid4().hex}.part")
    out = files.create(part)
    out.write(bytearray(text.encode()))
    out.close()
    if not files.rename(part, at):
        files.delete(part, False)
        raise OSError(f"{path} can't be written")


def read_document(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.text(path, wholetext=True).first()[0])


def publish(df: DataFrame, path: str, note: dict) -> None:
    """A table with a note of where it comes from; readers that see the note see all of the table. An existing one is refused."""
    df.write.mode("errorifexists").parquet(path)
    write_document(df.sparkSession, note, f"{path}.note.json")


def log_experiment(spark: SparkSession, path: str, name: str, settings: dict, figures: dict[str, float]) -> None:
    """Adds one row to the log of experiments."""
    row = (name, json.dumps(_finite(settings), sort_keys=True), {k: float(v) for k, v in _finite(figures).items()})
    log = spark.createDataFrame([row], "name string, settings string, figures map<string, double>").withColumn("at", F.current_timestamp())
    log.coalesce(1).write.mode("append").parquet(path)


def read_settings(path: str, defaults: dict, prefix: str = "SLIPWORKS_", environment: dict[str, str] | None = None) -> dict:
    """Settings of a JSON or, where a library for it is there, YAML file over ``defaults``, and under variables of the environment:
    PREFIX_A__B sets b of a. A key that the defaults haven't got is refused, and a value takes the kind of its default."""
    with open(path, encoding="utf-8") as file:
        if path.endswith((".yml", ".yaml")):
            try:
                import yaml
            except ImportError as e:
                raise ValueError(f"{path}: no library for YAML is installed, use JSON") from e
            given = yaml.safe_load(file) or {}
        else:
            given = json.load(file)
    for name, text in sorted((os.environ if environment is None else environment).items()):
        if name.startswith(prefix):
            at, *rest = name[len(prefix) :].lower().split("__")
            value: Any = text
            for key in reversed(rest):
                value = {key: value}
            given = _merged(given, {at: value}, "", None)
    return _merged(defaults, given, "", defaults)


def _merged(base: dict, over: dict, where: str, known: dict | None) -> dict:
    out = dict(base)
    for k, v in over.items():
        if known is not None and k not in known:
            raise ValueError(f"an unknown setting: {where}{k}")
        old = base.get(k)
        if isinstance(v, dict) and isinstance(old, dict):
            out[k] = _merged(old, v, f"{where}{k}.", known[k] if known is not None else None)
        elif known is not None and old is not None and isinstance(v, str) and not isinstance(old, str):
            out[k] = v.strip().lower() in ("1", "true", "yes") if isinstance(old, bool) else json.loads(v) if isinstance(old, (list, dict)) else type(old)(v)
        else:
            out[k] = v
    return out


_JSON = {StringType: "string", BooleanType: "boolean", IntegerType: "integer", LongType: "integer", ShortType: "integer", DoubleType: "number", FloatType: "number", DecimalType: "number"}


def json_schema(kind: DataType, title: str | None = None) -> dict:
    """The JSON Schema of rows: fields that may not be null are required, other fields may be."""
    if isinstance(kind, StructType):
        fields = {f.name: json_schema(f.dataType) if not f.nullable else _or_null(json_schema(f.dataType)) for f in kind.fields}
        out = {"type": "object", "properties": fields, "required": [f.name for f in kind.fields if not f.nullable], "additionalProperties": False}
        return {"$schema": "https://json-schema.org/draft/2020-12/schema", "title": title} | out if title else out
    if isinstance(kind, ArrayType):
        return {"type": "array", "items": json_schema(kind.elementType)}
    if isinstance(kind, MapType):
        return {"type": "object", "additionalProperties": json_schema(kind.valueType)}
    if isinstance(kind, DateType):
        return {"type": "string", "format": "date"}
    if isinstance(kind, TimestampType):
        return {"type": "string", "format": "date-time"}
    return {"type": _JSON[type(kind)]}


def _or_null(schema: dict) -> dict:
    return schema | {"type": [schema["type"], "null"]}


def table_ddl(name: str, kind: StructType, key: str | None = None, checks: dict[str, str] | None = None, references: dict[str, str] | None = None) -> str:
    """CREATE TABLE of a relational database for rows of this schema; nested fields are JSON."""
    plain = {"string": "text", "bigint": "bigint", "int": "integer", "smallint": "smallint", "double": "double precision", "float": "real", "boolean": "boolean", "date": "date", "timestamp": "timestamptz"}
    lines = []
    for f in kind.fields:
        of = f.dataType.simpleString()
        sql = of.replace("decimal", "numeric") if of.startswith("decimal") else plain.get(of, "jsonb")
        lines.append(f"    {f.name} {sql}" + (" primary key" if f.name == key else "" if f.nullable else " not null") + (f" references {references[f.name]}" if references and f.name in references else ""))
    lines += [f"    constraint {n} check ({rule})" for n, rule in (checks or {}).items()]
    return f"create table {name} (\n" + ",\n".join(lines) + "\n);"


def annotation_tasks(pages: DataFrame) -> DataFrame:
    """(image_id, task): a JSON task for annotators of each page with its regions as boxes in hundredths of the page. ``pages`` has
    image_id, image_path, width, height and regions."""
    share = lambda v, of: F.round(v * 100.0 / F.col(of), 4)
    boxes = F.transform("regions", lambda r, i: F.struct(i.cast("string").alias("id"), share(r["bbox"][0], "width").alias("x"), share(r["bbox"][1], "height").alias("y"), share(r["bbox"][2], "width").alias("width"), share(r["bbox"][3], "height").alias("height"), r["label"].alias("label"), r["role"].alias("role"), r["text"].alias("text")))
    usable = pages.where("image_id is not null and width > 0 and height > 0")
    return usable.select("image_id", F.to_json(F.struct(F.struct(F.col("image_path").alias("image"), F.col("image_id").alias("id"), "width", "height").alias("data"), F.coalesce(boxes, F.array().cast("array<struct<id:string,x:double,y:double,width:double,height:double,label:string,role:string,text:string>>")).alias("regions")), {"ignoreNullFields": "false"}).alias("task"))


TASK = "data struct<image string, id string, width int, height int>, regions array<struct<id string, x double, y double, width double, height double, label string, role string, text string>>"


def imported_regions(tasks: DataFrame, column: str = "task") -> DataFrame:
    """(image_id, region_id, label, role, text, bbox) of tasks that came back; a task that isn't one is an error."""
    read = F.from_json(column, TASK, {"mode": "FAILFAST"})
    each = tasks.select(read.alias("t")).select(F.col("t.data.id").alias("image_id"), F.col("t.data.width").alias("w"), F.col("t.data.height").alias("h"), F.explode("t.regions").alias("r"))
    back = lambda v, of: F.round(F.col(f"r.{v}") * F.col(of) / 100).cast("int")
    return each.select("image_id", F.col("r.id").cast("int").alias("region_id"), "r.label", "r.role", "r.text", F.array(back("x", "w"), back("y", "h"), back("width", "w"), back("height", "h")).alias("bbox"))
