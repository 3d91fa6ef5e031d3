"""Publications of a stream's evaluation: a new one only where its content differs from the last.

Each micro-batch evaluates the log; the evaluation's identity (one SHA-256 over its rows, in any order) is compared
with that of the last publication of an earlier batch, and only if it differs are the rows published, under the next
number. What is written for a batch depends on earlier batches alone, so that a retried batch writes the same again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slotwise.operators.dims import content_identity
from slotwise.streaming.scan import SnapshotStream


class PublishedStream(SnapshotStream):
    """``SnapshotStream`` whose snapshots are numbered and written only when they change."""

    def _last(self, spark: SparkSession, before: int) -> tuple[int, str | None]:
        """Number and identity of the last publication of a batch before ``before``."""
        folder = spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/publications")  # noqa: SLF001
        if not folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):  # noqa: SLF001
            return 0, None
        log = spark.read.schema("publication bigint, identity string, batch_id bigint").parquet(str(folder)).where(F.col("batch_id") < before)
        row = log.agg(F.max(F.struct("publication", "identity"))).first()[0]
        return (0, None) if row is None else (row[0], row[1])

    def process(self, batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        super().process(batch, batch_id)
        found = spark.read.parquet(f"{self.root}/snapshots/batch_id={batch_id}").drop("at")
        identity = content_identity(found, found.columns).first()[0]
        number, last = self._last(spark, batch_id)
        mark = spark.range(1).select(F.lit(number + 1).cast("bigint").alias("publication"), F.lit(identity).alias("identity"))
        if identity != last:
            found.withColumn("publication", F.lit(number + 1).cast("bigint")).write.mode("overwrite").parquet(f"{self.root}/published/batch_id={batch_id}")
            mark.write.mode("overwrite").parquet(f"{self.root}/publications/batch_id={batch_id}")

    def publications(self, spark: SparkSession) -> DataFrame:
        """All that was published, with publication and batch_id."""
        return spark.read.parquet(f"{self.root}/published")
