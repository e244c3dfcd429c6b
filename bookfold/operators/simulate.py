"""Simulated mid prices, orders and books. Draws hash the seed and a row's number, so results don't depend on partitioning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..storage import stored
from .asof import asof_join, row_index
from .levels import close_times, cumulate, top_n
from .verify import first_violation

SECOND = 1_000_000_000


def uniform(seed: int, stream: str, row: Column) -> Column:
    """A draw from (0, 1)."""
    return (F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.lit(stream), row), 11).cast("double") + 0.5) / float(1 << 53)


def normal(seed: int, stream: str, row: Column) -> Column:
    return F.sqrt(-2 * F.log(uniform(seed, stream + "r", row))) * F.cos(2 * F.pi() * uniform(seed, stream + "a", row))


def time_grid(spark: SparkSession, start_ns: int, n_mid: int, step_ns: int) -> DataFrame:
    """``i, t``: floor(1.5 n) points from a quarter of n before the start."""
    return spark.range(int(1.5 * n_mid)).select(F.col("id").alias("i"), (F.lit(start_ns - int(0.25 * n_mid) * step_ns) + F.col("id") * step_ns).alias("t"))


def mid_price(spark: SparkSession, start_ns: int, n_mid: int, step_ns: int, start_mid: int = 100, sd: float = 4.0, seed: int = 1, block: int = 100_000) -> DataFrame:
    """``t, mid``: a random walk of whole ticks through 100 x ``start_mid`` at a quarter of the grid."""
    n = int(1.5 * n_mid)
    grid = time_grid(spark, start_ns, n_mid, step_ns)
    steps = grid.withColumn("d", F.round(normal(seed, "mid", F.col("i")) * (sd * 50 / n**0.5)).cast("long")).withColumn("blk", F.floor(F.col("i") / block))
    sums = steps.groupBy("blk").agg(F.sum("d").alias("s")).withColumn("before", F.coalesce(F.sum("s").over(Window.orderBy("blk").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("s")
    walk = steps.withColumn("w", F.sum("d").over(Window.partitionBy("blk").orderBy("i").rowsBetween(Window.unboundedPreceding, 0))).join(sums, "blk").select("i", "t", (F.col("w") + F.col("before")).alias("w"))
    anchor = walk.where(F.col("i") == n // 4).select(F.col("w").alias("w0"))
    return walk.join(F.broadcast(anchor)).select("t", (F.col("w") - F.col("w0") + 100 * start_mid).alias("mid"))  # one row


def fake_orders(spark: SparkSession, n: int, n_mid: int = 5000, n_venues: int = 10, start_ns: int = 1_700_000_000 * SECOND, step_ns: int = int(1.53 * SECOND), start_mid: int = 100, sd: float = 4.0, spread: float = 50.0, seed: int = 1, bucket: int = 600 * SECOND, until_crossed: bool = False, safe: bool = False) -> DataFrame:
    """Orders around the mid as of their open: ``order_id, side, price, venue, qty, open, close, hit, sim_close, v_c, v_b,
    mid_open, k_open, sign, mid_close, mid_sim_close``.

    An order lives until ``sim_close``, or is cancelled before (``hit`` 1) at a time drawn between its open and the first
    time that the mid comes within ``v_b`` of its price or leaves it by more than ``v_c``. ``until_crossed`` takes 0 and
    five times the distance for these. Only orders alive in the window of the mid series, clamped to it; ``safe`` keeps
    at most n / 2 orders of each side that aren't hit, if there are more on both.
    """
    end_ns = start_ns + n_mid * step_ns
    mid = stored(mid_price(spark, start_ns, n_mid, step_ns, start_mid, sd, seed))
    i = F.col("order_id")
    index = stored(row_index(mid, "t", bucket))
    first, last = mid.agg(F.min("t"), F.max("t")).first()
    span = last - first
    raw = spark.range(int(1.5 * n)).select(F.col("id").alias("order_id"))
    raw = raw.select("order_id", F.when(uniform(seed, "side", i) < 0.5, -1).otherwise(1).alias("sign"), F.floor(uniform(seed, "venue", i) * n_venues).cast("int").alias("venue"), F.round(uniform(seed, "qty", i) * 1000).cast("long").alias("qty"), (F.lit(first) + uniform(seed, "t0", i) * span).cast("long").alias("open"))
    raw = raw.withColumn("side", F.when(F.col("sign") == 1, "b").otherwise("s")).withColumn("t", F.col("open"))

    def as_of(rows: DataFrame, time: str, **named: str) -> DataFrame:
        found = asof_join(rows.withColumn("t", F.col(time)), index, "t", values=("mid", "k"), bucket=bucket).drop("right_time", "t")
        return found.withColumnsRenamed(named).drop(*({"mid", "k"} - set(named)))

    placed = as_of(raw, "open", mid="mid_open", k="k_open").where("mid_open is not null")
    away = (1 + F.round(F.abs(normal(seed, "away", i) * spread))).cast("long")
    placed = placed.withColumn("away", away).withColumn("price", F.col("mid_open") - F.col("sign") * F.col("away"))
    near = F.lit(0).cast("long") if until_crossed else F.round(uniform(seed, "near", i) * F.col("away")).cast("long")
    far = 5 * F.col("away") if until_crossed else 2 * F.col("away") + F.round(F.abs(normal(seed, "far", i) * spread)).cast("long")
    placed = placed.withColumn("v_b", near).withColumn("v_c", F.greatest(far, F.col("away"))).drop("away")
    placed = placed.withColumn("sim_close", F.least(F.col("open") + (uniform(seed, "life", i) * span).cast("long"), F.lit(end_ns)))
    placed = stored(placed.withColumn("sim_close", F.greatest("sim_close", "open")))
    barrier = mid.select("t", F.col("mid").alias("nbb"), F.col("mid").alias("nbo"))
    flip = F.when(F.col("side") == "b", "s").otherwise("b")
    tried = lambda side, offset: placed.select("order_id", side.alias("side"), (F.col("price") + F.col("sign") * F.col(offset)).alias("price"), "open", F.col("sim_close").alias("close"))
    seen = [first_violation(tried(side, offset), barrier, bucket=bucket).select("order_id", F.col("first_violation_k").alias(offset + "_k")) for side, offset in ((F.col("side"), "v_b"), (flip, "v_c"))]
    hit = placed.join(seen[0].join(seen[1], "order_id"), "order_id").withColumn("k", F.least("v_b_k", "v_c_k")).drop("v_b_k", "v_c_k")
    hit = hit.join(index.select("k", F.col("t").alias("t_hit")), "k", "left").drop("k")
    stop = (F.col("open") + uniform(seed, "stop", i) * F.greatest(F.col("t_hit") - F.col("open"), F.lit(0))).cast("long")
    lived = hit.withColumn("hit", F.coalesce((F.col("t_hit") < F.col("sim_close")) & (F.col("t_hit") >= F.col("open")), F.lit(False)).cast("int"))
    lived = lived.withColumn("close", F.when(F.col("hit") == 1, stop).otherwise(F.col("sim_close"))).drop("t_hit")
    lived = as_of(as_of(lived, "close", mid="mid_close"), "sim_close", mid="mid_sim_close")
    inside = lived.where((F.col("open") <= end_ns) & (F.col("close") >= start_ns))
    if safe:
        inside = _safe(inside, round(n / 2))
    inside = inside.withColumn("open", F.greatest("open", F.lit(start_ns - 1000))).withColumn("close", F.least("close", F.lit(end_ns + 1000)))
    return inside.select("order_id", "side", "price", "venue", "qty", "open", "close", "hit", "sim_close", "v_c", "v_b", "mid_open", "k_open", "sign", "mid_close", "mid_sim_close")


def _safe(orders: DataFrame, each: int) -> DataFrame:
    orders = stored(orders)
    free = orders.where("hit = 0")
    n = {r["side"]: r["count"] for r in free.groupBy("side").count().collect()}
    if min(n.get("b", 0), n.get("s", 0)) <= each:
        return orders
    return top_n(free, ["side"], ["open", "order_id"], each).unionByName(orders.where("hit = 1"))


def fake_book(orders: DataFrame, only_hit: bool | None = None) -> DataFrame:
    """Depth of each level over time (times floored to 10 us) with the time of the level's next row (``ctime``);
    ``only_hit`` keeps hit or unhit orders."""
    some = orders if only_hit is None else orders.where(F.col("hit") == int(only_hit))
    floor = lambda c: (F.col(c) - F.pmod(F.col(c), F.lit(10_000))).alias(c)
    return close_times(cumulate(some.select("side", "price", "qty", floor("open"), floor("close")), t0="open", t1="close"))


def participant(venue: Column, last: int = 5) -> Column:
    """0 for venues up to ``last``, 1 for others."""
    return (venue > last).cast("int")


def hit_counts(orders: DataFrame) -> DataFrame:
    """Orders and hit orders by side and participant."""
    return orders.groupBy("side", participant(F.col("venue")).alias("participant")).agg(F.count("*").alias("n"), F.sum("hit").alias("hits"))
