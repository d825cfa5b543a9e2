"""Session settings and the folder that all executors share."""

from __future__ import annotations

import atexit
import os
import pickle
import re
import shutil
import tempfile
import uuid
from collections import defaultdict

from pyspark import Broadcast
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql.types import StructType

_OWN: dict[str, str] = {}
_ROOTS: set[str] = set()


def local_session(cpus: int = 8, app: str = "slipworks", **conf: str) -> SparkSession:
    """A local session for tests and benchmarks; clusters bring their own session and settings."""
    settings = {
        "spark.sql.shuffle.partitions": str(cpus),
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false",
        "spark.driver.memory": "8g",
        "spark.driver.host": "127.0.0.1",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    return SparkSession.builder.master(f"local[{cpus}]").appName(app).config(map=settings | conf).getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; one of our own only where a local session names none. A cluster without
    one is refused, since a folder of one machine would lose what its executors write."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("a cluster needs spark.checkpoint.dir, a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        _OWN[app] = tempfile.mkdtemp(prefix="slipworks-")
        atexit.register(shutil.rmtree, _OWN[app], ignore_errors=True)
        spark.sparkContext.setCheckpointDir(_OWN[app])
    return "file://" + os.path.abspath(_OWN[app])


def reachable(spark: SparkSession) -> None:
    """Lets Python workers import this package from where the driver has it, if they share its file system."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    environment = spark.sparkContext.environment
    paths = environment.get("PYTHONPATH", "").split(os.pathsep)
    if root not in paths:
        environment["PYTHONPATH"] = os.pathsep.join([root, *filter(None, paths)])


#: Bytes of what goes to every task.
MOST_SHARED = 512 << 20


def to_tasks(spark: SparkSession, value: object) -> Broadcast:
    """Sends a value to all tasks, if it isn't larger than ``MOST_SHARED`` as it is sent."""
    size = len(pickle.dumps(value, protocol=pickle.HIGHEST_PROTOCOL))
    if size > MOST_SHARED:
        raise ValueError(f"{size} bytes are too many for every task, {MOST_SHARED} may be sent")
    return spark.sparkContext.broadcast(value)


def clean(spark: SparkSession) -> None:
    """Removes the intermediate tables of all queries so far. Call it when their results are stored; a result that is not read yet
    would read what is gone."""
    while _ROOTS:
        at = spark._jvm.org.apache.hadoop.fs.Path(_ROOTS.pop())
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


class Workspace:
    """Intermediate tables in the shared folder, so that lineage is cut and a lost executor costs no recomputation.

    ``write`` stores a table and returns it read back; ``drop`` removes one that no later step reads.
    """

    def __init__(self, spark: SparkSession, what: str) -> None:
        self.spark, self.root = spark, f"{shared_folder(spark)}/{what}-{uuid.uuid4().hex}"
        _ROOTS.add(self.root)
        self.paths: dict[str, str] = {}
        self.schemas: dict[str, StructType] = {}

    def write(self, df: DataFrame, name: str, *measures) -> tuple[DataFrame, dict]:
        """Stores ``df``; ``measures`` are aggregates that are computed in the same job."""
        path, seen = f"{self.root}/{name}", {}
        if measures:
            watch = Observation()
            df.observe(watch, *measures).write.mode("overwrite").parquet(path)
            seen = dict(watch.get)  # may lack all of them if the plan turned out to be empty
        else:
            df.write.mode("overwrite").parquet(path)
        self.paths[name], self.schemas[name] = path, df.schema
        return self.read(name), defaultdict(lambda: None, seen)

    def read(self, *names: str) -> DataFrame:
        """Tables of one schema that were stored before, as one scan."""
        return self.spark.read.schema(self.schemas[names[0]]).parquet(*[self.paths[n] for n in names])

    def drop(self, *names: str) -> None:
        for name in names:
            path = self.paths.pop(name, None)
            if path:
                at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
                at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)
