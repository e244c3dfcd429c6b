"""NBBO of up to 64 venues: a function of the latest quote per venue.

Of few venues the latest quotes are windows, a column each. Of many, such a plan would have hundreds of windows and branches; there each
bucket of time is a stream of sorted quotes, led by the quotes that it inherits, and numpy carries the venues' quotes forward."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructType

from ..functions.scalar import bit
from .asof import join_same


#: Venues up to which each has a window of its own.
FEW = 16
_SIDES = {"b": ("bv", "bp", "bq"), "s": ("sv", "sp", "sq")}
_OUT = {"b": ("nbb", "nbbq", "b_ii", "num_b"), "s": ("nbo", "nboq", "s_ii", "num_s")}


def nbbo(quotes: DataFrame, n_venues: int, mode: str = "published", bucket: int = 3_600_000_000) -> DataFrame:
    """Consolidate ``quotes`` (``t, iline, bv, bp, bq, sv, sp, sq``); quantity <= 0 withdraws a venue's quote.

    Returns ``time, nbb, nbo, nbbq, nboq, b_ii, s_ii, iline, num_b, num_s``: best prices, their quantities, venue
    masks and counts; an empty side has price, quantity and mask 0.
    A venue outside 0 to ``n_venues`` - 1 is an error; a null venue quotes nothing. ``published`` keeps the last row of each time
    if a price, quantity or mask changed; ``every_event`` keeps each row with a quote on either side.
    Rows are sorted within time buckets, which inherit each venue's last quote from a table of one row per bucket.
    """
    if not 1 <= n_venues <= 64:
        raise ValueError("there are 1 to 64 venues")
    quotes = quotes.withColumns({v: F.when(F.col(v).isNull() | F.col(v).between(0, n_venues - 1), F.col(v)).otherwise(F.raise_error(F.lit(f"{v} is not a venue from 0 to {n_venues - 1}"))) for v in ("bv", "sv")})
    rows = _by_windows(quotes, n_venues, bucket) if n_venues <= FEW else _by_streams(quotes, n_venues, bucket)
    if mode == "every_event":
        return rows.where("b_ii <> 0 or s_ii <> 0")
    fields = ["nbb", "nbo", "nbbq", "nboq", "b_ii", "s_ii"]
    ends = rows.groupBy("time").agg(F.max_by(F.struct("iline", *fields, "num_b", "num_s"), "iline").alias("r")).select("time", "r.*")
    now = F.struct(*fields)
    dealt = ends.withColumn("__b", F.floor(F.col("time") / bucket)).withColumn("__now", now)
    inner = F.lag("__now").over(Window.partitionBy("__b").orderBy("time"))
    lasts = dealt.groupBy("__b").agg(F.max_by("__now", "time").alias("__last")).withColumn("__before", F.lag("__last").over(Window.orderBy("__b"))).drop("__last")
    changed = join_same(dealt.withColumn("__prev", inner), lasts, ["__b"]).withColumn("__prev", F.coalesce("__prev", "__before"))
    return changed.where(F.col("__prev").isNull() | (F.col("__prev") != F.col("__now"))).drop("__b", "__now", "__prev", "__before")


def _by_windows(quotes: DataFrame, n_venues: int, bucket: int) -> DataFrame:
    venues, sides = range(n_venues), _SIDES
    dealt = quotes.withColumn("__b", F.floor(F.col("t") / bucket))
    inside = Window.partitionBy("__b").orderBy("t", "iline").rowsBetween(Window.unboundedPreceding, 0)
    order = F.struct("t", "iline")
    own = {f"{s}{v}": F.when(F.col(c[0]) == v, F.struct(F.col(c[1]).alias("p"), F.when((F.col(c[2]) > 0) & (F.col(c[1]) > 0), F.col(c[2])).otherwise(0).alias("q"))) for s, c in sides.items() for v in venues}
    lasts = dealt.groupBy("__b").agg(*[F.max_by(x, F.when(x.isNotNull(), order)).alias(k) for k, x in own.items()])
    past = Window.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    carry = lasts.select("__b", *[F.last(k, True).over(past).alias(f"c{k}") for k in own])
    state = join_same(dealt.select("t", "iline", "__b", *[F.last(x, True).over(inside).alias(k) for k, x in own.items()]), carry, ["__b"])
    state = state.select("t", "iline", *[F.array(*[F.coalesce(F.col(f"{s}{v}"), F.col(f"c{s}{v}")) for v in venues]).alias(s) for s in sides])

    def best(s: str, pick) -> list[Column]:
        live = F.filter(s, lambda x: x["q"] > 0)
        return [pick(F.transform(live, lambda x: x["p"])).alias(f"p{s}")]

    state = state.select("t", "iline", "b", "s", *best("b", F.array_max), *best("s", F.array_min))
    out = [F.col("t").alias("time"), "iline"]
    for s, (p, q, m, k) in _OUT.items():
        at = [(F.get(F.col(s), F.lit(v))["q"] > 0) & (F.get(F.col(s), F.lit(v))["p"] == F.col(f"p{s}")) for v in venues]
        mask = reduce(lambda a, x: a.bitwiseOR(x), [F.when(c, bit(v)).otherwise(F.lit(0).cast("long")) for v, c in zip(venues, at)])
        total = reduce(lambda a, x: a + x, [F.when(c, F.get(F.col(s), F.lit(v))["q"]).otherwise(0) for v, c in zip(venues, at)])
        out += [F.coalesce(f"p{s}", F.lit(0)).alias(p), total.alias(q), mask.alias(m), F.bit_count(mask).cast("int").alias(k)]
    return state.select(*out)


def _last_quotes(quotes: DataFrame, n_venues: int) -> DataFrame:
    """For each bucket the quotes it inherits, as quotes of one side: of each venue the last in the buckets before."""
    one = [F.struct(F.lit(s).alias("side"), *[F.col(c).alias(k) for c, k in zip(cols, "vpq")]) for s, cols in _SIDES.items()]
    each = quotes.select("__b", "t", "iline", F.explode(F.array(*one)).alias("x")).select("__b", "t", "iline", "x.*").where("v is not null")
    lasts = each.groupBy("__b", "side", "v").agg(F.max_by(F.struct("p", "q"), F.struct("t", "iline")).alias("last"))
    # a row for every bucket and venue, so that a bucket without a venue's quotes hands on what it got
    frame = quotes.select("__b").distinct().withColumn("side", F.explode(F.array(*map(F.lit, _SIDES)))).withColumn("v", F.explode(F.sequence(F.lit(0), F.lit(n_venues - 1))))
    kinds = dict(lasts.dtypes)
    frame = join_same(frame.withColumn("v", F.col("v").cast(kinds["v"])), lasts, ["__b", "side", "v"], "left")
    past = Window.partitionBy("side", "v").orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    got = frame.withColumn("got", F.last("last", True).over(past)).where("got is not null")
    pick = lambda s, c: F.when(F.col("side") == s, c)
    return got.select("__b", F.lit(0).alias("kind"), *[pick(s, F.col(x)).alias(c) for s, cols in _SIDES.items() for c, x in zip(cols, ("v", "got.p", "got.q"))])


def _by_streams(quotes: DataFrame, n_venues: int, bucket: int) -> DataFrame:
    schema = StructType().add("time", quotes.schema["t"].dataType).add("iline", quotes.schema["iline"].dataType)
    for s, (p, q, m, k) in _OUT.items():
        schema.add(p, quotes.schema[_SIDES[s][1]].dataType).add(q, quotes.schema[_SIDES[s][2]].dataType).add(m, LongType()).add(k, IntegerType())
    dealt = quotes.select("t", "iline", *[c for cols in _SIDES.values() for c in cols]).withColumn("__b", F.floor(F.col("t") / bucket))
    both = dealt.withColumn("kind", F.lit(1)).unionByName(_last_quotes(dealt, n_venues), allowMissingColumns=True)
    columns = ["__b", "kind", "t", "iline", *[c for cols in _SIDES.values() for c in cols]]
    streams = both.select(*columns).repartition("__b").sortWithinPartitions("__b", "kind", "t", "iline")
    return streams.mapInArrow(_carried(n_venues, schema.names), schema)


def _carried(n_venues: int, names: list[str], step: int = 2048):
    """Streams of quotes, bucket by bucket, as rows of the book after each quote of kind 1."""

    def numbers(column: pa.Array) -> np.ndarray:
        return column.fill_null(0).to_numpy(zero_copy_only=False)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, book = None, {}
        for batch in batches:
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                buckets = part.column(0).to_pylist()
                cuts = [i for i in range(1, len(buckets)) if buckets[i] != buckets[i - 1]]
                for a, b in zip([0, *cuts], [*cuts, len(buckets)]):
                    if not book or buckets[a] != now:
                        now, book = buckets[a], {}
                    yield fold(part.slice(a, b - a), book)

    def fold(rows: pa.RecordBatch, book: dict) -> pa.RecordBatch:
        out = []
        for i, (side, pick) in enumerate((("b", np.max), ("s", np.min))):
            v, p, q = (rows.column(4 + 3 * i + k) for k in range(3))
            told = np.flatnonzero(v.is_valid().to_numpy(zero_copy_only=False))
            v, p, q = numbers(v).astype(np.int64), numbers(p), numbers(q)
            q = np.where((q > 0) & (p > 0), q, q.dtype.type(0))
            p0, q0 = book.get(side, (np.zeros(n_venues, p.dtype), np.zeros(n_venues, q.dtype)))
            last = np.zeros((rows.num_rows, n_venues), np.int32)
            last[told, v[told]] = told + 1
            np.maximum.accumulate(last, axis=0, out=last)
            old = last == 0
            prices, sizes = np.where(old, p0, p[last - 1]), np.where(old, q0, q[last - 1])
            book[side] = prices[-1], sizes[-1]
            live = sizes > 0
            end = np.iinfo if prices.dtype.kind == "i" else np.finfo
            best = pick(np.where(live, prices, end(prices.dtype).min if side == "b" else end(prices.dtype).max), axis=1)
            some = live.any(axis=1)
            best = np.where(some, best, prices.dtype.type(0))
            here = live & (prices == best[:, None])
            mask = (here * (np.uint64(1) << np.arange(n_venues, dtype=np.uint64))).sum(axis=1, dtype=np.uint64).view(np.int64)
            out += [best, (sizes * here).sum(axis=1).astype(sizes.dtype), mask, here.sum(axis=1).astype(np.int32)]
        own = np.flatnonzero(numbers(rows.column(1)) == 1)
        return pa.RecordBatch.from_arrays([rows.column(2).take(pa.array(own)), rows.column(3).take(pa.array(own)), *[pa.array(x[own]) for x in out]], names=names)

    return run
