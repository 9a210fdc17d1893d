"""An append-only decision ledger as a stream: each batch is merged into the table of standing decisions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from factloom.operators.dml import latest_events, upsert


def read_events(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.readStream.schema(schema).parquet(path)


def fold(standing: DataFrame | None, batch: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The standing rows after a batch of events; applying a batch again changes nothing, and a late event doesn't replace a newer one."""
    newest = latest_events(batch, keys, [F.col(order).desc()])
    if standing is None:
        return newest
    older = standing.select(*keys, F.col(order).alias("_known"))
    fresh = newest.join(older, keys, "left").filter(F.col("_known").isNull() | (F.col(order) > F.col("_known"))).drop("_known")
    return upsert(standing, fresh, keys)


def maintain(events: DataFrame, target: str, checkpoint: str, keys: list[str], order: str) -> StreamingQuery:
    """Keeps target/v<batch>, the standing decisions after each batch; the last version is the current one."""

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        before = spark.read.parquet(f"{target}/v{number - 1}") if number else None
        fold(before, batch, keys, order).write.mode("overwrite").parquet(f"{target}/v{number}")

    return events.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, ts: str, late: str, width: str, by: str) -> DataFrame:
    """Events per window and kind, late ones within the watermark included."""
    return events.withWatermark(ts, late).groupBy(F.window(ts, width), by).agg(F.count(F.lit(1)).alias("n"))
