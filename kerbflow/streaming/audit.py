"""The audit trail as a stream: the last entry of each step wins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def latest_steps(entries: DataFrame) -> DataFrame:
    """A running aggregate (step_id, and the fields of the entry with the greatest arrival and id).

    State is one row a step.
    """
    rest = [c for c in entries.columns if c != "step_id"]
    order = F.struct("arrival", "entry_id")
    return entries.groupBy("step_id").agg(*[F.max_by(c, order).alias(c) for c in rest])


def upsert(entries: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Keeps the current trail as a table below ``path``: each batch writes a new version, whole."""

    def save(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/version={number}")

    return latest_steps(entries).writeStream.outputMode("complete").option("checkpointLocation", checkpoint).foreachBatch(save).start()


def current(spark, path: str) -> DataFrame:
    """The newest version of the trail."""
    df = spark.read.parquet(path)
    last = df.agg(F.max("version")).first()[0]
    return df.where(F.col("version") == last).drop("version")
