"""As-of join: one shuffle and a window; without a key, time buckets with a carried-in row."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Parts that rows without a time or a key are dealt over.
_UNPLACED = 1024


def join_same(left: DataFrame, right: DataFrame, keys, how: str = "inner") -> DataFrame:
    """``left`` joined with ``right`` on columns of both where null is like any other value; the columns of ``keys`` are the left's."""
    names = {k: f"__key{i}" for i, k in enumerate(keys)}
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(n)) for k, n in names.items()])
    return left.join(right.withColumnsRenamed(names), same, how).drop(*names.values())


def asof_join(left: DataFrame, right: DataFrame, time: str = "t", by=(), values=("v",), allow_exact: bool = True, tolerance: int | None = None, direction: str = "backward", bucket: int = 3_600_000_000) -> DataFrame:
    """Each left row with ``values`` and ``right_time`` of the last right row at or before its time.

    ``allow_exact`` admits equal times; ``direction`` forward takes the first row at or after. Rows are cut
    into buckets of ``bucket`` time units per key, each sorted by itself; what a bucket inherits is
    the last right row of those before it, from a table with one row per bucket. So a hot key, or no key at
    all, doesn't end in one task. Equal right times: the greatest ``values`` win (least, forward).
    A left row whose time or key is null finds nothing and stays; a right row whose time or key is null isn't found.
    Columns of ``left`` named like ``values`` or ``right_time`` give way to these; other names may be any.
    """
    sign = 1 if direction == "backward" else -1
    keys = [f"k{i}" for i in range(len(by))]
    own = [f"c{i}" for i in range(len(left.columns))]
    at = dict(zip(left.columns, own))
    payload = F.struct((F.col(f"`{time}`") * sign).alias("at"), *[F.col(f"`{v}`").alias(f"v{i}") for i, v in enumerate(values)])
    r = right.select(*[F.col(f"`{c}`").alias(k) for c, k in zip(by, keys)], (F.col(f"`{time}`") * sign).alias("t"), F.lit(0 if allow_exact else 2).alias("rank"), payload.alias("p")).dropna(subset=[*keys, "t"])
    l = left.toDF(*own).select("*", *[F.col(at[c]).alias(k) for c, k in zip(by, keys)], (F.col(at[time]) * sign).alias("t"), F.lit(1).alias("rank"), F.lit(None).cast(r.schema["p"].dataType).alias("p"))
    placed = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in ("t", *keys)])
    # before all buckets, so that these inherit nothing
    nowhere = -(1 << 61) - F.pmod(F.xxhash64(*own), F.lit(_UNPLACED))
    both = l.unionByName(r, allowMissingColumns=True).withColumn("b", F.when(placed, F.floor(F.col("t") / bucket)).otherwise(nowhere))
    inside = Window.partitionBy(*keys, "b").orderBy("t", "rank", "p").rowsBetween(Window.unboundedPreceding, 0)
    lasts = r.withColumn("b", F.floor(F.col("t") / bucket)).groupBy(*keys, "b").agg(F.max("p").alias("last"))
    # only keys and buckets that occur: a bucket without right rows hands on what it got
    frame = both.select(*keys, "b").distinct().join(lasts, [*keys, "b"], "left")
    carry = frame.withColumn("carry", F.last("last", True).over(Window.partitionBy(*keys).orderBy("b").rowsBetween(Window.unboundedPreceding, -1))).drop("last")
    found = both.withColumn("in", F.last("p", True).over(inside)).where(F.col("rank") == 1)
    joined = found.join(carry, [*keys, "b"], "left").withColumn("in", F.coalesce("in", "carry"))
    near = F.lit(True) if tolerance is None else F.col("t") - F.col("in.at") <= tolerance
    more = {"right_time": F.col("in.at") * sign} | {v: F.col(f"in.v{i}") for i, v in enumerate(values)}
    return joined.select(*[F.col(k).alias(c) for c, k in at.items() if c not in more], *[F.when(near, x).alias(c) for c, x in more.items()])


def row_index(rows: DataFrame, time: str = "t", bucket: int = 3_600_000_000, seq=(), name: str = "k", by=()) -> DataFrame:
    """A gapless index in the order of ``time`` (and ``seq``), from 0 (in each key ``by``), from counts per time bucket.

    Rows without a time come first; a null key is a key."""
    dealt = rows.withColumn("__b", F.floor(F.col(time) / bucket))
    counts = dealt.groupBy(*by, "__b").agg(F.count("*").alias("__n"))
    past = Window.partitionBy(*by).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.withColumn("__before", F.coalesce(F.sum("__n").over(past), F.lit(0))).drop("__n")
    inside = F.row_number().over(Window.partitionBy(*by, "__b").orderBy(time, *seq))
    return join_same(dealt.withColumn("__i", inside), before, [*by, "__b"]).withColumn(name, (F.col("__before") + F.col("__i") - 1).cast("long")).drop("__b", "__i", "__before")


def range_before(rows: DataFrame, time: Column, index: DataFrame, column: str, name: str, by=(), or_at: bool = False, bucket: int = 3_600_000_000) -> DataFrame:
    """``rows`` with ``name``: how many rows of ``index`` (``by``, ``column`` and the index ``k``) come before ``time`` (``or_at``: or at it).

    A null ``time`` is after all: it finds the last."""
    late = F.lit((1 << 62) - 1)
    found = asof_join(rows.withColumn("__at", F.coalesce(time, late)), index.select(*by, F.col(column).alias("__at"), F.col("k").alias("__k")), "__at", by, ("__k",), or_at, bucket=bucket)
    return found.withColumn(name, F.coalesce(F.col("__k") + 1, F.lit(0).cast("long"))).drop("__at", "__k", "right_time")
