"""Parquet tables of one data folder."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def once(df: DataFrame, *keys: str) -> DataFrame:
    """Rows that were sent twice count once: one row for each key.

    Which of several rows with one key stays is not defined; use it where rows of one key say the same.
    """
    return df.dropDuplicates(list(keys))


#: Bytes of input for each core up to which ``spread`` moves rows of which it can't tell the parts.
SMALL = 64 << 20
#: Operators behind which the number of parts isn't known before they have run.
_MOVES = re.compile(r"Aggregate|Join|Sort|Window|Exchange|Limit|Repartition|Cartesian|AdaptiveSparkPlan")


def spread(df: DataFrame) -> DataFrame:
    """Rows over all cores, for work that costs much more than moving them.

    Rows that come straight from files in as many parts as there are cores are left as they are, fewer parts are spread. Of
    rows behind a shuffle only the size is known, as the plan estimates it from files: small ones are spread. Nothing runs to
    find out, and the rows are the same either way.
    """
    cores, plan = df.sparkSession.sparkContext.defaultParallelism, df._jdf.queryExecution()
    if _MOVES.search(plan.sparkPlan().toString()):
        few = int(str(plan.optimizedPlan().stats().sizeInBytes())) < SMALL * cores
    else:
        few = df.rdd.getNumPartitions() < cores
    return df.repartition(cores) if few else df


def by_key(df: DataFrame, *keys: str) -> DataFrame:
    """Rows of one key together, in as many parts as the session shuffles into, so that later steps by that key need no
    further shuffle and small tables still use all cores."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)
