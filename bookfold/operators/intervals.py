"""Interval join: all pairs of rows whose intervals overlap, by ranks instead of a range join.

Two intervals overlap if one starts within the other, so the pairs fall in two parts: those whose right row starts within the
left interval (its start included), and those whose left row starts after the right one does and before it ends. In each,
the starts within an interval are a range of ranks, which as-of joins find, and the interval meets the bins of ranks that
it touches: bins hold equally many rows however the starts crowd, and each pair meets in one bin alone. How many rows is
taken from the ranges, so that what is shuffled grows with the rows and not with the pairs, which are only made as they are handed on."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import stored
from .asof import range_before, row_index

#: Rows of a bin at most.
BIN = 4096
#: Bins that a range touches on average, besides those at its ends.
TOUCHED = 16
#: Pairs that a task makes where a shuffle's usual partitions are too few, as long as there are no more than ``TASKS``.
PAIRS = 1 << 22
TASKS = 2048


def _in_pieces(ranges: DataFrame, keys: list[str]) -> tuple[DataFrame, int]:
    """``ranges`` (``row, a, b``; stored) with each ``bin`` of ranks that they touch, dealt over tasks by it, and the rows of a bin.

    Unless bins are full there are at most ``TOUCHED * 2 + 2`` pieces a range, half as many where ranges are long, and the ranks
    in the bins at its ends are an eighth of all pairs or less; no bin has more than a sixteenth of the pairs or one of each range."""
    n, pairs = ranges.agg(F.count("*"), F.coalesce(F.sum(F.col("b") - F.col("a")), F.lit(0))).first()
    width = min(BIN, max(1, pairs // (TOUCHED * max(1, n))))
    pieces = ranges.select("*", F.explode(F.expr(f"sequence(a div {width}, (b - 1) div {width})")).alias("bin"))
    tasks = min(TASKS, pairs // PAIRS)
    # Spark sizes partitions by what goes into the join, which says little of what comes out
    more = tasks > int(ranges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return (pieces.repartition(tasks, *keys, "bin") if more else pieces), width


def _starts_within(holders: DataFrame, points: DataFrame, keys: list[str], at_start: bool, bucket: int) -> DataFrame:
    """``row, other``: each row of ``points`` (``s`` and its rank ``k``) that starts within a row of ``holders`` (``s, e``)."""
    own = range_before(holders.drop("k"), F.col("s"), points, "s", "a", keys, or_at=not at_start, bucket=bucket)
    own = range_before(own, F.col("e"), points, "s", "b", keys, bucket=bucket).where("a < b")
    pieces, width = _in_pieces(stored(own.select(*keys, "row", "a", "b")), keys)
    bins = points.select(*keys, F.expr(f"k div {width}").alias("bin"), "k", F.col("row").alias("other"))
    return pieces.join(bins, [*keys, "bin"]).where("k >= a and k < b").select("row", "other")


def interval_join(left: DataFrame, right: DataFrame, start: str = "open", end: str = "close", by=(), bucket: int = 3_600_000_000) -> DataFrame:
    """Structs ``left`` and ``right`` of each pair of rows that share the values of ``by`` and a moment.

    A row holds from ``start`` to before ``end`` (null: for ever); one with a null start or key, or that ends when it starts or before,
    meets nothing. Repeated rows meet as often as they are there. Times are whole numbers, cut into buckets of ``bucket`` to be ranked.
    """
    keys = [f"k{i}" for i in range(len(by))]

    def sides(rows: DataFrame) -> DataFrame:
        own = rows.select(F.struct(*[F.col(f"`{c}`") for c in rows.columns]).alias("row"), *[F.col(f"`{c}`").alias(k) for c, k in zip(by, keys)], F.col(f"`{start}`").alias("s"), F.col(f"`{end}`").alias("e"))
        return stored(row_index(own.dropna(subset=["s", *keys]).where("e is null or e > s"), "s", bucket, by=keys))

    l, r = sides(left), sides(right)
    within = _starts_within(l, r, keys, True, bucket).toDF("left", "right")
    return within.unionByName(_starts_within(r, l, keys, False, bucket).toDF("right", "left"))


def overlap_counts(rows: DataFrame, start: str = "open", end: str = "close", by=(), name: str = "n", bucket: int = 3_600_000_000) -> DataFrame:
    """``rows`` with ``name``: how many of them share the values of ``by`` and a moment with each, itself included, by the rules of ``interval_join``.

    These are the rows that start before its end, less those of them that end by its start: two ranks, no pairs. Rows that meet nothing are left out."""
    keys = [f"__key_of{i}" for i in range(len(by))]
    own = rows.dropna(subset=[start, *by]).where(F.col(f"`{end}`").isNull() | (F.col(f"`{end}`") > F.col(f"`{start}`")))
    own = stored(own.select("*", *[F.col(f"`{c}`").alias(k) for c, k in zip(by, keys)]))
    starts = row_index(own.select(*keys, F.col(f"`{start}`").alias("__s")), "__s", bucket, by=keys)
    ends = row_index(own.select(*keys, F.col(f"`{end}`").alias("__e")).dropna(), "__e", bucket, by=keys)
    counted = range_before(own, F.col(f"`{end}`"), starts, "__s", "__begun", keys, bucket=bucket)
    counted = range_before(counted, F.col(f"`{start}`"), ends, "__e", "__over", keys, or_at=True, bucket=bucket)
    return counted.withColumn(name, F.col("__begun") - F.col("__over")).drop("__begun", "__over", *keys)
