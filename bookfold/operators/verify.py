"""Violations of resting orders by a best-bid/offer step function, and level crossings.

The barrier rows become the leaves of a tree of fan-out 16 that keeps each node's least and greatest value, siblings in one row, their
block. An order's rows are a range of leaves, parts of at most two blocks a level; the first node that holds a violation is found
by an equi-join of blocks, then followed down level by level. Each level has a join of its own, so the plan grows with the levels.

For all violations the barrier rows are cut into lists, the worst first, of a length that an order's range spans a few times: in a list that
it spans those that violate it are the beginning, whose end is found by halving, so a row that is returned costs no join. No range join, no nested loop."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import stored
from .asof import asof_join, range_before, row_index

FAN = 16


def first_violation(orders: DataFrame, barrier: DataFrame, pdiff: float = 0, eqstate: bool = False, sameside: bool = False, timetouch: bool = False, bucket: int = 3_600_000_000) -> DataFrame:
    """``orders`` (``order_id, side`` b or s, ``price, open, close``; null close: open-ended) with
    ``first_violation_k``: the first row of ``barrier`` (``t, nbb, nbo``, distinct times) that holds at some time of
    the order's life and violates its price, or the number of rows if none does.

    A row holds from its time to the next row's. Buys are violated when price + pdiff is over the offer
    (``sameside``: the bid), sells when price - pdiff is under the bid (the offer); ``eqstate`` counts
    equality, ``timetouch`` rows that only touch the life's ends. Orders are told apart by a row number of their own, so
    ids may repeat or be null, and other columns may have any names. Side is text or bytes; what starts with b or B buys.
    """
    whole, at, what = _numbered(orders)
    found, n = _violations(whole.select("order_id", *what), barrier, pdiff, eqstate, sameside, timetouch, bucket)
    return whole.join(found, "order_id", "left").select(*at, F.coalesce("node", F.lit(n)).cast("long").alias("first_violation_k"))


def all_violations(orders: DataFrame, barrier: DataFrame, pdiff: float = 0, eqstate: bool = False, sameside: bool = False, timetouch: bool = False, bucket: int = 3_600_000_000) -> DataFrame:
    """A row of ``orders`` with ``violation_k`` for each row of ``barrier`` that violates it, by the rules of ``first_violation``.

    An order that none violates has no row; each pair comes once. Only the lists at the ends of an order's range hold violations outside of it."""
    whole, at, what = _numbered(orders)
    rows, n, spans = _spans(whole.select("*", *what), whole.columns[:-1], barrier, sameside, timetouch, bucket)
    if not n:
        return whole.where("false").select(*at, F.lit(0).cast("long").alias("violation_k"))
    orders_in, total = spans.agg(F.count("*"), F.coalesce(F.sum(F.col("b") - F.col("a")), F.lit(0))).first()
    width = min(LIST, max(LEAST, total // (SPANNED * max(1, orders_in))))
    found = reduce(DataFrame.unionByName, [_listed(spans, rows, buys, pdiff, eqstate, width, total) for buys in (True, False)])
    return found.select(*at, F.col("node").cast("long").alias("violation_k"))


def _numbered(orders: DataFrame) -> tuple[DataFrame, list[Column], list[Column]]:
    """Orders under numbers of their own; their columns by their names; what decides on them."""
    names = orders.columns
    whole = stored(orders.toDF(*[f"o{i}" for i in range(len(names))]).withColumn("order_id", F.monotonically_increasing_id()))
    at = {c: F.col(f"o{i}").alias(c) for i, c in enumerate(names)}
    return whole, [*at.values()], [at["side"], at["price"], at["open"], at["close"]]


#: Nodes of the tree, or rows in lists, that are broadcast at most.
FEW = 1 << 18
#: Rows of a list at least and at most, and lists that an order's range spans on average, unless lists are full.
LEAST, LIST, SPANNED = 64, 1 << 16, 8
#: Leaves in the ranges of a task where a shuffle's usual partitions are too few, as long as there are no more than ``TASKS``.
LEAVES = 1 << 28
TASKS = 2048
#: Parts that the orders of a list are dealt over where lists are broadcast.
DEALT = 16


def _hit(buy: Column, price: Column, least: Column, most: Column, pdiff: float, eqstate: bool) -> Column:
    up, down = price + pdiff, price - pdiff
    if eqstate:
        return F.when(buy, up >= least).otherwise(down <= most)
    return F.when(buy, up > least).otherwise(down < most)


def _spans(orders: DataFrame, kept: list[str], barrier: DataFrame, sameside: bool, timetouch: bool, bucket: int) -> tuple[DataFrame, int, DataFrame]:
    """The barrier's rows in their order (``k, least, most``), their number, and ``order_id, buy, price`` and ``kept`` of the orders with the rows ``a`` to ``b`` - 1
    that each lives through. All stored; no orders without rows."""
    buys, sells = ("nbb", "nbo") if sameside else ("nbo", "nbb")
    rows = stored(row_index(barrier, "t", bucket).select("t", "k", F.col(buys).alias("least"), F.col(sells).alias("most")))
    n = rows.count()
    if not n:
        return rows, n, orders
    last = 1 << 62
    alive = orders.withColumn("__close", F.coalesce(F.col("close"), F.lit(last)))
    # the row in force at open: the last with t <= open; touching takes the one before a row that starts at open
    lo = asof_join(alive.withColumn("t", F.col("open")), rows.select("t", "k"), "t", values=("k",), allow_exact=not timetouch, bucket=bucket).drop("t", "right_time").withColumnRenamed("k", "__lo")
    hi = asof_join(lo.withColumn("t", F.col("__close")), rows.select("t", "k"), "t", values=("k",), allow_exact=timetouch, bucket=bucket).drop("t", "right_time").withColumnRenamed("k", "__hi")
    spans = hi.select("order_id", *kept, (F.lower(F.substring(F.col("side").cast("string"), 1, 1)) == "b").alias("buy"), "price", F.coalesce("__lo", F.lit(0)).alias("a"), (F.col("__hi") + 1).alias("b"))
    return rows, n, stored(spans.where("a < b"))


def _listed(spans: DataFrame, rows: DataFrame, buys: bool, pdiff: float, eqstate: bool, width: int, total: int) -> DataFrame:
    """Orders of one side with each ``node`` (a row's ``k``) that violates them, from lists of ``width`` rows."""
    hit = lambda price, value: _hit(F.lit(buys), price, value, value, pdiff, eqstate)
    own = spans.where(F.coalesce("buy", F.lit(False)) == buys)
    value = F.col("least" if buys else "most")
    # rows that violate the order that is easiest violated; no other is ever listed
    limit = own.agg((F.max if buys else F.min)("price").alias("limit"))
    some = rows.withColumn("v", value).join(F.broadcast(limit), hit(F.col("limit"), F.col("v")))  # one row
    worst = F.sort_array(F.collect_list(F.struct("v", "k")), asc=buys)
    lists = some.groupBy(F.floor(F.col("k") / width).alias("block")).agg(worst.alias("x")).select("block", F.col("x.v").alias("vs"), F.col("x.k").alias("ks"))
    lists = stored(lists)
    few = lists.agg(F.coalesce(F.sum(F.size("ks")), F.lit(0))).first()[0] <= FEW
    tasks = min(TASKS, total // LEAVES)
    # Spark sizes partitions by what goes into the join, which says little of what comes out
    dealt = [tasks] if tasks > int(spans.sparkSession.conf.get("spark.sql.shuffle.partitions")) else []
    pieces = own.withColumn("block", F.explode(F.expr(f"sequence(a div {width}, (b - 1) div {width})")))
    if few:
        # orders of a list follow each other, as their rows begin alike and so take little room where they are written
        met = pieces.repartition(*dealt, "block", F.pmod("order_id", F.lit(DEALT))).join(F.broadcast(lists), "block")
    else:
        met = (pieces.repartition(*dealt, "block") if dealt else pieces).join(lists, "block")
    met = met.withColumn("__n", F.lit(0))
    for bit in range(width.bit_length() - 1, -1, -1):
        further = hit(F.col("price"), F.get("vs", F.col("__n") + ((1 << bit) - 1)))
        met = met.withColumn("__n", F.when(further, F.col("__n") + (1 << bit)).otherwise(F.col("__n")))
    return met.select(*own.columns, F.explode(F.slice("ks", F.lit(1), F.col("__n"))).alias("node")).where("node >= a and node < b")


def _violations(orders: DataFrame, barrier: DataFrame, pdiff: float, eqstate: bool, sameside: bool, timetouch: bool, bucket: int) -> tuple[DataFrame, int]:
    """``order_id, node`` of the first violating row, and the number of rows."""
    rows, n, spans = _spans(orders, [], barrier, sameside, timetouch, bucket)
    if not n:
        return orders.where("false").select("order_id", F.lit(0).cast("long").alias("node")), n
    levels = 1
    while FAN ** (levels - 1) < n:
        levels += 1
    # what lasts to the end has the whole tree before it, not the block of the last rows that all such orders would meet in
    spans = spans.withColumn("b", F.when(F.col("b") == n, F.lit(FAN**levels)).otherwise(F.col("b")))
    blocks, below = [], rows.select(F.col("k").alias("node"), "least", "most")
    for _ in range(levels):
        child = F.struct((F.col("node") % FAN).alias("c"), "least", "most")
        own = stored(below.groupBy(F.floor(F.col("node") / FAN).alias("block")).agg(F.min("least").alias("least"), F.max("most").alias("most"), F.collect_list(child).alias("children")))
        blocks.append(own.select("block", "children"))
        below = own.select(F.col("block").alias("node"), "least", "most")
    own = ["order_id", "buy", "price"]

    def hit(x: Column) -> Column:
        return _hit(F.col("buy"), F.col("price"), x["least"], x["most"], pdiff, eqstate)

    def met(pieces: DataFrame, level: int) -> DataFrame:
        """The first node with a violation of the range ``p`` of a block, as ``node``."""
        # the upper levels have few nodes, which are broadcast, only lower ones are met in a shuffle
        few = 16 / 15 * n / FAN**level <= FEW
        meet = pieces.select(*own, "p.*").join(F.broadcast(blocks[level]) if few else blocks[level], "block")
        nodes = F.transform(F.filter("children", lambda x: (x["c"] >= F.col("lo")) & (x["c"] < F.col("hi")) & hit(x)), lambda x: F.col("block") * FAN + x["c"])
        return meet.select(*own, F.array_min(nodes).alias("node")).where("node is not null")

    def under(nodes: DataFrame) -> DataFrame:
        whole = F.struct(F.col("node").alias("block"), F.lit(0).cast("long").alias("lo"), F.lit(FAN).cast("long").alias("hi"))
        return nodes.select(*own, whole.alias("p"))

    pieces = [spans.select(*own, F.explode(part).alias("p")) for part in _cover(levels)]
    at = F.col("node") * F.col("level").cast("long")
    tops = [met(p, level).withColumn("level", F.lit(FAN**level).cast("long")) for level, p in enumerate(pieces)]
    first = reduce(DataFrame.unionByName, tops).groupBy("order_id", "buy", "price").agg(F.min(F.struct(at.alias("at"), "level", "node")).alias("m"))
    first = stored(first.select(*own, "m.level", "m.node"))
    found = first.where(F.col("level") == FAN ** (levels - 1)).select(*own, "node")
    for level in range(levels - 2, -1, -1):
        found = met(under(found), level).unionByName(first.where(F.col("level") == FAN**level).select(*own, "node"))
    return found.select("order_id", "node"), n


def _cover(levels: int) -> list[Column]:
    """The nodes that make up the leaves a to b - 1: for each level an array of ``block, lo, hi``, the children lo to hi - 1 of a block."""
    a, b, going = F.col("a"), F.col("b"), F.lit(True)
    parts = []

    def run(lo: Column, hi: Column) -> Column:
        each = F.transform(F.sequence(F.floor(lo / FAN), F.floor((hi - 1) / FAN)), lambda x: F.struct(x.alias("block"), F.greatest(lo - x * FAN, F.lit(0)).alias("lo"), F.least(hi - x * FAN, F.lit(FAN)).alias("hi")))
        return F.when(lo < hi, each).otherwise(F.array())

    for level in range(levels):
        up, down = F.ceil(a / FAN), F.floor(b / FAN)
        more = (up < down) if level < levels - 1 else F.lit(False)
        parts.append(F.when(going & more, F.concat(run(a, up * FAN), run(down * FAN, b))).when(going, run(a, b)).otherwise(F.array()))
        going = going & more
        a, b = up, down
    return parts


def level_crossings(series: DataFrame, level, time: str = "t", value: str = "v", bucket: int = 3_600_000_000, start: str | None = None) -> DataFrame:
    """Rows after which the series crosses or touches ``level`` on the way to the next row.

    ``start`` also takes the first row if it is already at or beyond the level: ``above`` for a level that is crossed
    from below (the first value is at most the level), ``below`` for the other way (at least)."""
    nxt = asof_join(series, series.select(time, F.col(value).alias("__v")), time, values=("__v",), allow_exact=False, direction="forward", bucket=bucket)
    v, w = F.col(value) - level, F.col("__v") - level
    crosses = F.col("__v").isNotNull() & (F.signum(v) != F.signum(w))
    if start is not None:
        if start not in ("above", "below"):
            raise ValueError("start is above, below or None")
        nxt = nxt.join(F.broadcast(series.agg(F.min(time).alias("__first"))))  # one row
        crosses = crosses | ((F.col(time) == F.col("__first")) & ((v <= 0) if start == "above" else (v >= 0)))
    return nxt.where(crosses).withColumnRenamed("__v", "next_value").withColumnRenamed("right_time", "next_time").drop("__first")


#: Levels of a block that steps meet as one.
BLOCK = 256


def all_crossings(series: DataFrame, levels: DataFrame, level: str = "price", time: str = "t", value: str = "v", start: str | None = None, bucket: int = 3_600_000_000, width: int = 1 << 20) -> DataFrame:
    """``time, value, next_time, next_value, level`` for each step of the series and each distinct level that it crosses or
    touches on the way to the next row, by the rules of ``level_crossings`` (``start`` included).

    Levels are ranked once (in buckets of ``width`` units of value); the levels that a step crosses are a range of ranks, found by two as-of
    joins, and it meets them in blocks of ranks: so the work grows with the crossings there are. Rows without a time or value and null levels are
    left out.
    """
    if start not in ("above", "below", None):
        raise ValueError("start is above, below or None")
    own = series.where(F.col(time).isNotNull() & F.col(value).isNotNull()).select(F.col(time).alias("t"), F.col(value).alias("v"))
    ranks = stored(row_index(levels.where(F.col(level).isNotNull()).select(F.col(level).alias("price")).distinct(), "price", width))
    steps = asof_join(own, own.withColumnRenamed("v", "w"), "t", values=("w",), allow_exact=False, direction="forward", bucket=bucket)
    v, w = F.col("v"), F.coalesce("w", "v")
    moves = v != w
    lo, hi = F.least(v, w), F.greatest(v, w)
    if start is not None:
        steps = steps.join(F.broadcast(own.agg(F.min("t").alias("first"))))  # one row
        moves = moves | (F.col("t") == F.col("first"))
        if start == "above":
            hi = F.when(F.col("t") != F.col("first"), hi)
        else:
            lo = F.when(F.col("t") != F.col("first"), lo)
    steps = steps.select("t", "v", F.col("right_time").alias("next_time"), F.col("w").alias("next_value"), lo.alias("lo"), hi.alias("hi"), moves.alias("moves")).where("moves")
    placed = range_before(range_before(steps, F.col("lo"), ranks, "price", "a", bucket=width), F.col("hi"), ranks, "price", "b", or_at=True, bucket=width)
    placed = placed.withColumn("a", F.when(F.col("lo").isNull(), 0).otherwise(F.col("a"))).where("a < b")
    blocks = ranks.groupBy(F.floor(F.col("k") / BLOCK).alias("block")).agg(F.sort_array(F.collect_list("price")).alias("prices"))
    pieces = placed.withColumn("block", F.explode(F.sequence(F.floor(F.col("a") / BLOCK), F.floor((F.col("b") - 1) / BLOCK))))
    first = F.greatest(F.col("a") - F.col("block") * BLOCK, F.lit(0))
    last = F.least(F.col("b") - F.col("block") * BLOCK, F.lit(BLOCK))
    met = pieces.join(blocks, "block").withColumn("level", F.explode(F.slice("prices", (first + 1).cast("int"), (last - first).cast("int"))))
    return met.select(F.col("t").alias(time), F.col("v").alias(value), "next_time", "next_value", F.col("level").alias(level))
