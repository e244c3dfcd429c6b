"""Sharding: global prefix sums of byte sizes from per-partition totals, cut at equal targets."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, renamed, table


def shard(docs: DataFrame, shards: int, id_col: str = "doc_id", text_col: str = "text", slack: float = 0.01) -> DataFrame:
    """Contiguous shards of nearly equal bytes: ``doc_id, size, text_crc32, law, shard, slot, grown_shard``.

    ``size`` is the text's UTF-8 bytes (null: none) plus 1. Rows are put in the order of a hash of their
    text, then id (nulls first), so equal texts are neighbours; this order is cut where the prefix sum of
    sizes passes k / ``shards`` of the total. A group of equal texts goes whole into the shard in which
    the middle of its first row lies, unless it holds more than ``slack`` of a shard's bytes: then it is cut row by row. So no
    shard is off by more than ``slack`` and its largest row. ``slot`` counts the rows of a shard in this order.

    So a group that is larger than the slack is not kept together: the law is equal bytes, and a hot group would break it.
    Null texts have a ``text_crc32`` of null and form one group; very long texts count by their bytes; repeated rows
    stay; other columns aren't read, whatever their names; an empty table gives none.

    Only totals go through the driver: a row per partition, and the groups too large to stay whole, of
    which there can be at most ``shards / slack``.
    """
    text = F.col(f"`{text_col}`").cast("string")
    sizes = docs.select(
        F.col(f"`{id_col}`").alias("doc_id"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.xxhash64(text).alias("h"),
    )
    sizes = materialize(sizes)
    n, total = sizes.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    group = ["h", "text_crc32"]
    large = sizes.groupBy(*group).agg(F.sum("size").alias("bytes")).where(F.col("bytes") > slack * total / shards).select(*group).collect()
    hot = F.lit(False)
    if large:
        named = docs.sparkSession.createDataFrame(large, sizes.select(*group).schema).withColumn("hot", F.lit(True))
        sizes = sizes.join(F.broadcast(named.withColumnsRenamed({"h": "h2", "text_crc32": "c2"})), F.col("h").eqNullSafe(F.col("h2")) & F.col("text_crc32").eqNullSafe(F.col("c2")), "left").drop("h2", "c2")
        hot = F.coalesce("hot", F.lit(False))
    spread = F.when(hot, F.xxhash64("doc_id")).otherwise(F.lit(0))
    parts = max(1, min(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), n // 1000 + 1))
    order = [*group, "spread", "doc_id"]
    ordered = sizes.select("doc_id", "size", "text_crc32", "h", hot.alias("hot"), spread.alias("spread")).repartitionByRange(parts, *order[:3]).sortWithinPartitions(*order)
    ordered = materialize(ordered.withColumn("pid", F.spark_partition_id()))
    totals = ordered.groupBy("pid").agg(F.sum("size").alias("bytes")).orderBy("pid").collect()
    before, run = {}, 0
    for pid, size in totals:
        before[pid] = run
        run += size
    cuts = [total * k / shards for k in range(1, shards)]

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, last, start = None, None, 0
        for b in batches:
            size = b.column(1).to_numpy()
            if at is None:
                at = start = before[b.column(6)[0].as_py()] if b.num_rows else None
            if at is None:
                continue
            begins = at + np.concatenate([[0], np.cumsum(size)])
            at = int(begins[-1])
            begins = begins[:-1] + size // 2
            keys = [b.column(3).to_numpy(), b.column(2).fill_null(-1).to_numpy(zero_copy_only=False)]
            fresh = np.concatenate([[last is None or last != (keys[0][0], keys[1][0])], (np.diff(keys[0]) != 0) | (np.diff(keys[1]) != 0)])
            last = (keys[0][-1], keys[1][-1])
            lead = np.maximum.accumulate(np.where(fresh, np.arange(len(begins)), -1))
            group_begins = np.where(lead >= 0, begins[np.maximum(lead, 0)], start)
            start = int(group_begins[-1])
            place = np.where(b.column(4).to_numpy(zero_copy_only=False), begins, group_begins)
            found = np.searchsorted(cuts, place, side="right").astype(np.int32) if cuts else np.zeros(len(place), np.int32)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(found), b.column(6)], names=["doc_id", "size", "text_crc32", "shard", "pid"])

    kind = dict(ordered.dtypes)["doc_id"]
    fields = ["doc_id", "size", "text_crc32", "h", "hot", "spread", "pid"]
    placed = ordered.select(*fields).mapInArrow(assign, f"doc_id {kind}, size long, text_crc32 long, shard int, pid int")
    offsets: dict[tuple[int, int], int] = {}
    filled: dict[int, int] = defaultdict(int)
    for pid, s, rows in placed.groupBy("pid", "shard").count().orderBy("pid", "shard").collect():
        offsets[pid, s] = filled[s]
        filled[s] += rows

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[int, int] = defaultdict(int)
        for b in batches:
            where, slots = b.column(3).to_numpy(), np.empty(b.num_rows, np.int64)
            pid = b.column(4)[0].as_py() if b.num_rows else 0
            for s in np.unique(where).tolist():
                own = where == s
                k = int(own.sum())
                slots[own] = offsets[pid, s] + seen[s] + np.arange(k)
                seen[s] += k
            yield pa.RecordBatch.from_arrays([*b.columns[:4], pa.array(slots)], names=["doc_id", "size", "text_crc32", "shard", "slot"])

    out = placed.mapInArrow(count, f"doc_id {kind}, size long, text_crc32 long, shard int, slot long")
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def write_shards(docs: DataFrame, path: str, shards: int, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Write ``docs`` as Parquet, a folder ``shard=k`` for each shard, rows in slot order.

    Rows are matched to their places by id and text; repeated rows take the places of these one each.
    """
    wide, at = renamed(docs)
    again = lambda *by: F.row_number().over(Window.partitionBy(*by).orderBy(by[-1]))
    places = shard(wide, shards, at[id_col], at[text_col]).select(F.col("doc_id").alias("place_id"), F.col("text_crc32").alias("place_crc"), "shard", "slot")
    places = places.withColumn("place_k", again("place_id", "place_crc"))
    keyed = wide.withColumn("crc", F.crc32(F.col(at[text_col]).cast("string").cast("binary"))).withColumn("k", again(at[id_col], "crc"))
    same = F.col(at[id_col]).eqNullSafe(F.col("place_id")) & F.col("crc").eqNullSafe(F.col("place_crc")) & (F.col("k") == F.col("place_k"))
    placed = keyed.join(places, same).select(*at.values(), "shard", "slot")
    parts = max(shards, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = placed.repartition(parts, "shard", (F.col("slot") / 100_000).cast("int")).sortWithinPartitions("shard", "slot")
    dealt.toDF(*docs.columns, "shard", "slot").write.partitionBy("shard").mode("overwrite").parquet(path)


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(table(spark, sf_dir, "documents"), 16)
