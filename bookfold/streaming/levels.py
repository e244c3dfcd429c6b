"""Level history over a stream of settings: each micro-batch closes the intervals that it ends."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def stream_history(stream: DataFrame, state_path: str, sink, checkpoint: str, by=("side", "price"), time: str = "time", qty: str = "qty", seq: str = "seq"):
    """Start a query that hands ``sink(rows, batch_id)`` the closed intervals of the level history of ``stream``.

    Settings must come in order of time across batches. The state is each level's last setting and the quantity before
    it (one row a level), written to ``state_path`` under the number of the batch; a batch that is run again reads the
    state of the one before and so gives the same rows. ``open_levels`` reads the intervals that are still open.
    """

    def each(batch: DataFrame, batch_id: int) -> None:
        own = batch.withColumn("was", F.lit(None).cast(batch.schema[qty].dataType))
        if batch_id:
            own = batch.sparkSession.read.parquet(f"{state_path}/{batch_id - 1}").unionByName(own)
        w = Window.partitionBy(*by).orderBy(time, seq)
        told = own.withColumn("was", F.coalesce("was", F.lag(qty).over(w))).withColumn("close", F.lead(time).over(w)).persist()
        try:
            sink(closed(told.where("close is not null"), time, qty).select(*batch.columns, "open", "close", "onqty"), batch_id)
            told.where("close is null").drop("close").write.mode("overwrite").parquet(f"{state_path}/{batch_id}")
        finally:
            told.unpersist()

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def closed(told: DataFrame, time: str = "time", qty: str = "qty") -> DataFrame:
    """Intervals of settings that change something."""
    return told.withColumn("onqty", F.col(qty) - F.coalesce("was", F.lit(0))).where("onqty <> 0").withColumn("open", F.col(time))


def open_levels(state: DataFrame, time: str = "time", qty: str = "qty") -> DataFrame:
    """The intervals that a state leaves open."""
    return closed(state, time, qty).withColumn("close", F.lit(None).cast(state.schema[time].dataType)).drop("was")
