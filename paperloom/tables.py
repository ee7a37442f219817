"""Reading the input tables and counting a redelivered row once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def delivered_once(df: DataFrame, key: str, *columns: str) -> DataFrame:
    """One row per ``key`` with the given columns; rows whose key is null are left out.

    A redelivered row has the content of the first one, so whichever copy survives is
    the same.  The duplicates go in the map-side half of the aggregate, before the
    shuffle, so an id delivered millions of times costs one row per input partition.
    """
    kept = df.select(key, *columns).where(F.col(key).isNotNull())
    return kept.dropDuplicates([key])
