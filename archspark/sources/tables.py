"""Reader for the driver's Parquet tables (one file per table)."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem",
          "events", "documents", "embeddings", "pages", "benchmark", "labels",
          "conversations"]

#: rows of a spread table in one partition
ROWS_A_PART = 4000

#: short rows in one partition of a table that is kept for several readers
KEPT_A_PART = 32_000


class Tables:
    """Lazy table accessor: ``t = Tables(spark, sf_dir); t.lineitem``.

    Reading is lazy, so column pruning and filter pushdown reach the scan.
    """

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir

    def spread(self, name: str, *cols: str) -> DataFrame:
        """These columns of a table, its rows dealt out by the first one, about ``ROWS_A_PART`` to a partition.

        For tables of short rows from which much is rendered: Spark sees a few small splits in them, and
        everything rendered would be the work of as few tasks.
        """
        df = getattr(self, name).select(*cols)
        return df.repartition(max(1, -(-df.count() // ROWS_A_PART)), cols[0])

    def gathered(self, df: DataFrame, name: str) -> DataFrame:
        """Short rows made from a spread table, in fewer partitions: each reader of what is kept starts a task for each."""
        return df.coalesce(max(self.spark.sparkContext.defaultParallelism, -(-getattr(self, name).count() // KEPT_A_PART)))

    def __getattr__(self, name: str) -> DataFrame:
        if name not in TABLES:
            raise AttributeError(name)
        return self.spark.read.parquet(os.path.join(self.sf_dir, f"{name}.parquet"))
