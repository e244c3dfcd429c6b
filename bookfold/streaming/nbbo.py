"""NBBO over a stream of quotes: the latest quote per venue is kept with a watermark-free aggregation, and each
micro-batch is consolidated with what the batches before left behind."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.nbbo import nbbo


def consolidate(stream: DataFrame, n_venues: int, state_path: str, sink, checkpoint: str):
    """Start a query that hands ``sink(rows, batch_id)`` the every-event NBBO of each micro-batch of ``stream``.

    Quotes must come in order of ``t, iline`` across batches. The state is each venue's last quote, at most
    two rows a venue, written to ``state_path`` under the number of the batch; a batch that is run again
    reads the state of the one before it and so gives the same rows.
    """

    def each(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        own = batch.withColumn("old", F.lit(False))
        if batch_id:
            own = spark.read.parquet(f"{state_path}/{batch_id - 1}").withColumn("old", F.lit(True)).unionByName(own)
        own = own.persist()
        try:
            rows = nbbo(own.drop("old"), n_venues, "every_event")
            sink(rows.join(own.where("not old").select("iline"), "iline", "left_semi").select(*rows.columns), batch_id)
            last = lambda v: own.groupBy(v).agg(F.max_by(F.struct(*batch.columns), F.struct("t", "iline")).alias("r")).select("r.*")
            last("bv").unionByName(last("sv")).distinct().write.mode("overwrite").parquet(f"{state_path}/{batch_id}")
        finally:
            own.unpersist()

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
