"""Small helpers on DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def fresh(df: DataFrame) -> DataFrame:
    """The same columns as new attributes, so that a self join tells its two sides apart."""
    return df.select([F.col(c).alias(c) for c in df.columns])
