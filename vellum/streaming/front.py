"""A streaming front: documents that arrive are gated and profiled batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from vellum.plans.runner import profile

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def profile_stream(spark: SparkSession, source: str, sink: str, checkpoint: str):
    """Reads parquet files as they appear; each micro-batch writes its own folder, so that
    a batch that is run again replaces what it wrote.  Per document, hence no state."""

    def write(batch: DataFrame, batch_id: int) -> None:
        profile(batch).write.mode("overwrite").parquet(f"{sink}/batch={batch_id}")

    return spark.readStream.schema(SCHEMA).parquet(source).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
