"""Level history, snapshots and running depth of a book."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..storage import stored
from .asof import asof_join, join_same


def _neighbours(rows: DataFrame, by, order, bucket: int | None, before: dict, after: dict) -> DataFrame:
    """``rows`` with the columns named in ``before`` and ``after``: the value of a column in the row before or after.

    With ``bucket``, rows are sorted within buckets of the first ``order`` column, so that a level with most of the rows
    isn't one task's work; what a bucket has before and after it comes from a table with one row per level and bucket."""
    if bucket is None:
        w = Window.partitionBy(*by).orderBy(*order)
        return rows.withColumns({k: F.lag(c).over(w) for k, c in before.items()} | {k: F.lead(c).over(w) for k, c in after.items()})
    dealt = rows.withColumn("__b", F.floor(F.col(order[0]) / bucket))
    w = Window.partitionBy(*by, "__b").orderBy(*order)
    inside = dealt.withColumns({k: F.lag(F.struct(c)).over(w) for k, c in before.items()} | {k: F.lead(F.struct(c)).over(w) for k, c in after.items()})
    at = F.struct(*order)
    ends = dealt.groupBy(*by, "__b").agg(*[F.max_by(F.struct(c), at).alias(f"__{k}") for k, c in before.items()], *[F.min_by(F.struct(c), at).alias(f"__{k}") for k, c in after.items()])
    over = Window.partitionBy(*by).orderBy("__b")
    ends = ends.select(*by, "__b", *[F.lag(f"__{k}").over(over).alias(f"__{k}") for k in before], *[F.lead(f"__{k}").over(over).alias(f"__{k}") for k in after])
    return join_same(inside, ends, [*by, "__b"]).withColumns({k: F.coalesce(k, f"__{k}")[c] for k, c in (before | after).items()}).select(*rows.columns, *before, *after)


def run_numbers(rows: DataFrame, value: str = "time", seq: str = "seq", bucket: int = 1 << 20, name: str = "run") -> DataFrame:
    """``rows`` with the number, from 0, of the run of equal ``value`` that they are in when sorted by ``seq``.

    Gaps and islands by ranges of ``bucket`` units of ``seq``, each sorted by itself: a range takes the last row before it and
    the number of runs so far from a table with one row a range. ``seq`` tells rows apart; nulls are equal to each other."""
    own = _neighbours(rows.withColumn("__one", F.lit(1)), (), (seq,), bucket, {"__was": value, "__any": "__one"}, {})
    flagged = own.withColumn("__new", F.when(F.col("__any").isNull() | ~F.col("__was").eqNullSafe(F.col(value)), 1).otherwise(0)).withColumn("__b", F.floor(F.col(seq) / bucket))
    past = Window.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    sums = flagged.groupBy("__b").agg(F.sum("__new").alias("__n")).withColumn("__n", F.coalesce(F.sum("__n").over(past), F.lit(0)))
    inside = F.sum("__new").over(Window.partitionBy("__b").orderBy(seq).rowsBetween(Window.unboundedPreceding, 0))
    return join_same(flagged.withColumn("__in", inside), sums, ["__b"]).withColumn(name, (F.col("__in") + F.col("__n") - 1).cast("long")).select(*rows.columns, name)


def level_history(book: DataFrame, by=("side", "price"), time: str = "time", qty: str = "qty", seq: str = "seq", coalesce_intervals: bool = False, bucket: int | None = None, snapshot_resets: bool = False, kind: str = "us01") -> DataFrame:
    """``open, close, onqty`` of each level setting; settings that change nothing are dropped.

    ``close`` is the time of the level's next setting (of the next that changes something, with
    ``coalesce_intervals``), null for the last. One shuffle by level serves lead and lag; with ``bucket`` (in units of
    time) hot levels are cut by time. A setting without a quantity says nothing and is left out; a null side, price or time is a
    value like any other, the first in order. ``snapshot_resets``: see ``with_resets``.
    """
    order = (time, seq)
    book = book.where(F.col(qty).isNotNull())
    if snapshot_resets:
        book = with_resets(book, by, time, qty, seq, kind, bucket)
    if coalesce_intervals:
        own = _neighbours(book, by, order, bucket, {"__was": qty}, {})
        own = own.withColumn("onqty", F.col(qty) - F.coalesce("__was", F.lit(0))).where("onqty <> 0").drop("__was")
        return _neighbours(own, by, order, bucket, {}, {"close": time}).withColumn("open", F.col(time))
    own = _neighbours(book, by, order, bucket, {"__was": qty}, {"close": time})
    return own.withColumn("onqty", F.col(qty) - F.coalesce("__was", F.lit(0))).where("onqty <> 0").drop("__was").withColumn("open", F.col(time))


def with_resets(book: DataFrame, by=("side", "price"), time: str = "time", qty: str = "qty", seq: str = "seq", kind: str = "us01", bucket: int | None = None) -> DataFrame:
    """``book`` with a setting to 0 wherever a snapshot ends a level by not naming it.

    A snapshot is a time with rows of ``kind`` 1. It names the levels that have any row at that time, and ends those that
    stand and have none. A setting is ended by the first snapshot after it, if the level's next row comes later than that: this
    is one as-of join with the snapshots' times and at most one more row for a setting, however many levels and snapshots
    there are. The rows added have null in all columns but ``by``, ``time``, ``qty`` and ``kind`` (1).
    """
    width = bucket or 3_600_000_000
    snapshots = book.where((F.col(kind) == 1) & F.col(time).isNotNull()).select(F.col(time).alias("__s")).distinct()
    own = _neighbours(book.select(*by, time, qty, seq), by, (time, seq), bucket, {}, {"__next": time}).where((F.col(qty) != 0) & F.col(time).isNotNull())
    found = asof_join(own.withColumn("__at", F.col(time)), snapshots.withColumn("__at", F.col("__s")), "__at", values=("__s",), allow_exact=False, direction="forward", bucket=width)
    ended = found.where(F.col("__s").isNotNull() & (F.col("__next").isNull() | (F.col("__next") > F.col("__s"))))
    kinds = {f.name: f.dataType for f in book.schema}
    rows = ended.select(*by, F.col("__s").cast(kinds[time]).alias(time), F.lit(0).cast(kinds[qty]).alias(qty), F.lit(1).cast(kinds[kind]).alias(kind))
    return book.unionByName(rows, allowMissingColumns=True)


def close_times(depth: DataFrame, by=("side", "price"), time: str = "time", name: str = "ctime") -> DataFrame:
    """Depth rows with the time of the level's next row (null for the last)."""
    return depth.withColumn(name, F.lead(time).over(Window.partitionBy(*by).orderBy(time)))


def argsort(rows: DataFrame, by=("side", "price"), order=("time", "seq"), name: str = "rank") -> DataFrame:
    """The position of each row in the order of ``by`` and then ``order`` (nulls first), from 0.

    Rows are dealt over ranges of the whole order, found by a sample, and sorted in them, so neither many levels nor one with
    most of the rows meet in a task; a row's place is its place in its range after the rows of the ranges before, whose counts, one a
    range, go through the driver."""
    own = stored(rows.repartitionByRange(*by, *order).sortWithinPartitions(*by, *order).withColumn("__i", F.monotonically_increasing_id()))
    part, within = F.shiftright("__i", 33), F.col("__i").bitwiseAND(F.lit((1 << 33) - 1))
    counts = sorted(own.groupBy(part.alias("p")).count().collect())
    before = own.sparkSession.createDataFrame([(p, sum(n for _, n in counts[:i])) for i, (p, n) in enumerate(counts)], "__p long, __before long")
    return own.join(F.broadcast(before), part == F.col("__p")).withColumn(name, F.col("__before") + within).drop("__i", "__p", "__before")


def snapshot_at(levels: DataFrame, at, qty: str = "qty") -> DataFrame:
    """Levels alive at a time: opened by then, not closed before, set just then or with quantity left."""
    t = F.lit(at)
    return levels.where((F.col("open") <= t) & (F.col("close").isNull() | (F.col("close") >= t)) & ((F.col("open") == t) | (F.col(qty) > 0)))


def cumulate(orders: DataFrame, by=("side", "price"), qty: str = "qty", t0: str = "t0", t1: str = "t1", bucket: int | None = None) -> DataFrame:
    """Depth of each level over time: orders add their quantity at ``t0`` and take it away at ``t1`` (null: never).

    With ``bucket``, a level is summed bucket by bucket of time, after the totals of the buckets before."""
    ins = orders.select(*by, F.col(t0).alias("time"), F.col(qty).alias("q"))
    outs = orders.where(F.col(t1).isNotNull()).select(*by, F.col(t1).alias("time"), (-F.col(qty)).alias("q"))
    net = ins.unionByName(outs).groupBy(*by, "time").agg(F.sum("q").alias("q"))
    if bucket is None:
        return net.withColumn("cm_qty", F.sum("q").over(Window.partitionBy(*by).orderBy("time").rowsBetween(Window.unboundedPreceding, 0))).drop("q")
    net = net.withColumn("__b", F.floor(F.col("time") / bucket))
    before = Window.partitionBy(*by).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    sums = net.groupBy(*by, "__b").agg(F.sum("q").alias("__q")).withColumn("__q", F.coalesce(F.sum("__q").over(before), F.lit(0)))
    inside = F.sum("q").over(Window.partitionBy(*by, "__b").orderBy("time").rowsBetween(Window.unboundedPreceding, 0))
    return join_same(net.withColumn("__in", inside), sums, [*by, "__b"]).withColumn("cm_qty", F.col("__in") + F.col("__q")).drop("q", "__b", "__in", "__q")


def top_n(rows: DataFrame, by, order, n: int) -> DataFrame:
    """The first ``n`` rows of each group."""
    return rows.withColumn("__n", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("__n") <= n).drop("__n")
