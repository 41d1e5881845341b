"""Input tables. A table is ``<dir>/<name>.parquet``: one file or a folder of part files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import TimestampType

from moraine.session import ship_package


def table(spark: SparkSession, base: str, name: str) -> DataFrame:
    """The table with every timestamp as ``timestamp_ntz`` (all times mean UTC)."""
    ship_package(spark)
    df = spark.read.parquet(f"{base}/{name}.parquet")
    zoned = {f.name: F.col(f"`{f.name}`").cast("timestamp_ntz") for f in df.schema if isinstance(f.dataType, TimestampType)}
    return df.withColumns(zoned) if zoned else df
