"""Moments of a stream: cross products are sums, so batches add up.

Each micro-batch writes its own moments under its number; a batch that runs again writes the
same place again, so restarts count nothing twice.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from concord.operators.moments import gram


class GrowingMoments:
    """Counts, sums and cross products of the ``variables`` of a stream, kept in ``path``."""

    def __init__(self, variables: list[str], path: str):
        self.variables, self.path = variables, path

    def add(self, batch: DataFrame, number: int) -> None:
        """For ``foreachBatch``."""
        width = len(self.variables) + 1
        rows = batch.select(F.array(F.lit(1.0), *(F.col(v).cast("double") for v in self.variables)).alias("x"))
        flat = gram(rows, width).ravel().tolist()
        batch.sparkSession.createDataFrame([(flat,)], "moments array<double>").write.mode("overwrite").parquet(f"{self.path}/batch={number}")

    def start(self, stream: DataFrame, checkpoint: str, **trigger):
        writer = stream.writeStream.foreachBatch(self.add).option("checkpointLocation", checkpoint)
        return writer.trigger(**(trigger or {"availableNow": True})).start()

    def total(self, spark: SparkSession) -> tuple[int, np.ndarray, np.ndarray]:
        """Rows, column sums and cross products so far."""
        cells = spark.read.parquet(self.path).select(F.posexplode("moments").alias("k", "v")).groupBy("k").agg(F.sum("v").alias("v")).orderBy("k").collect()
        width = len(self.variables) + 1
        whole = np.array([r["v"] for r in cells]).reshape(width, width)
        return round(whole[0, 0]), whole[0, 1:], whole[1:, 1:]

    def correlations(self, spark: SparkSession) -> np.ndarray:
        n, sums, products = self.total(spark)
        centred = products - np.outer(sums, sums) / n
        sd = np.sqrt(np.diag(centred))
        return centred / np.outer(sd, sd)
