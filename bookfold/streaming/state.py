"""NBBO and level history over streams whose rows come out of order, kept in Spark's state store.

State is per instrument or level and event time bounds it: rows newer than the watermark wait or can still be corrected, of
older ones only what later rows need stays (a venue's last quote, a level's last setting). Rows not newer than the watermark are
late and left out; a row that comes again (the same time and number) counts once."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import IntegerType, LongType, StructType

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_QUOTE = ("bv", "bp", "bq", "sv", "sp", "sq")


def _prepared(stream: DataFrame, time: str, delay: str) -> DataFrame:
    """``stream`` with a watermark on ``time``, microseconds; rows without a time are left out."""
    spark: SparkSession = stream.sparkSession
    spark.conf.set(PROVIDER, ROCKS)  # the only store that holds maps
    return stream.where(F.col(time).isNotNull()).withColumn("__ts", F.timestamp_micros(F.col(time).cast("long"))).withWatermark("__ts", delay)


def _number(x) -> int | None:
    return None if pd.isna(x) else int(x)


class _Quotes(StatefulProcessor):
    def __init__(self, by: list[str], columns: list[str]):
        self._by, self._columns = by, columns

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        self._venues = handle.getMapState("venues", "side string, venue long", "p long, q long")
        self._waiting = handle.getMapState("waiting", "t long, iline long", ", ".join(f"{c} long" for c in _QUOTE))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        mark = timerValues.getCurrentWatermarkInMs() * 1000
        for part in rows:
            for t, iline, *quote in zip(*[part[c] for c in ("t", "iline", *_QUOTE)]):
                if int(t) > mark:
                    self._waiting.updateValue((int(t), int(iline)), tuple(map(_number, quote)))
        yield from self._settled(key, mark)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self._settled(key, timerValues.getCurrentWatermarkInMs() * 1000)

    def _settled(self, key, mark: int) -> Iterator[pd.DataFrame]:
        """What the rows up to the watermark make of the book, in order; a timer for the next that waits."""
        waiting = sorted((tuple(k), tuple(v)) for k, v in self._waiting.iterator())
        done = [x for x in waiting if x[0][0] <= mark]
        if len(done) < len(waiting):
            self._handle.registerTimer(max(waiting[len(done)][0][0] // 1000, mark // 1000) + 1)
        if not done:
            return
        book = {tuple(k): tuple(v) for k, v in self._venues.iterator()}
        out, changed = [], set()
        for (t, iline), (bv, bp, bq, sv, sp, sq) in done:
            for side, v, p, q in (("b", bv, bp, bq), ("s", sv, sp, sq)):
                if v is not None:
                    book[side, v] = (p or 0, q if q and p and q > 0 and p > 0 else 0)
                    changed.add((side, v))
            row = {"time": t, "iline": iline}
            for side, pick, names in (("b", max, ("nbb", "nbbq", "b_ii", "num_b")), ("s", min, ("nbo", "nboq", "s_ii", "num_s"))):
                live = [(v, p, q) for (s, v), (p, q) in book.items() if s == side and q > 0]
                best = pick((p for _, p, _ in live), default=0)
                at = [(v, q) for v, p, q in live if p == best]
                mask = sum(1 << v for v, _ in at)
                row |= dict(zip(names, (best, sum(q for _, q in at), mask - (mask >> 63 << 64), len(at))))
            if row["b_ii"] or row["s_ii"]:
                out.append(row)
            self._waiting.removeKey((t, iline))
        for k in changed:
            self._venues.updateValue(k, book[k])
        if out:
            yield pd.DataFrame(out).assign(**dict(zip(self._by, key)))[self._columns]

    def close(self) -> None:
        pass


def stateful_nbbo(stream: DataFrame, by=("symbol",), delay: str = "1 minute") -> DataFrame:
    """The every-event NBBO of each ``by`` (all columns of it not null), as ``nbbo`` gives for all its quotes at once.

    ``stream`` has ``t`` (microseconds), ``iline`` (which tells quotes of a time apart) and ``bv, bp, bq, sv, sp, sq`` with venues from 0 to 63. A quote is told once the
    watermark, ``delay`` behind the latest time, has passed it, so quotes may come in any order within it. State holds
    the last quote of each venue and the quotes that wait.
    """
    names = list(by)
    schema = StructType([stream.schema[c] for c in names])
    for name in ("time", "nbb", "nbo", "nbbq", "nboq", "b_ii", "s_ii", "iline"):
        schema.add(name, LongType())
    for name in ("num_b", "num_s"):
        schema.add(name, IntegerType())
    return _prepared(stream, "t", delay).groupBy(*names).transformWithStateInPandas(_Quotes(names, schema.names), schema, "Append", "EventTime")


class _Level(StatefulProcessor):
    def __init__(self, by: list[str], time: str, qty: str, seq: str, columns: list[str]):
        self._by, self._time, self._qty, self._seq, self._columns = by, time, qty, seq, columns

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._said = handle.getMapState("said", "time long, seq long", "qty long")
        self._was = handle.getValueState("was", "qty long")

    @staticmethod
    def _intervals(said: dict, was: int) -> set[tuple]:
        rows = sorted(said.items())
        out = set()
        for i, ((t, seq), q) in enumerate(rows):
            before = rows[i - 1][1] if i else was
            if q != before:
                out.add((seq, t, rows[i + 1][0][0] if i + 1 < len(rows) else None, q, q - before))
        return out

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        mark = timerValues.getCurrentWatermarkInMs() * 1000
        said = {tuple(k): v[0] for k, v in self._said.iterator()}
        was = self._was.get()[0] if self._was.exists() else 0
        told = self._intervals(said, was)
        new = {}
        for part in rows:
            for t, seq, q in zip(part[self._time], part[self._seq], part[self._qty]):
                if int(t) > mark and not pd.isna(q):
                    new[int(t), int(seq)] = int(q)
        now = self._intervals(said | new, was)
        for k, q in new.items():
            self._said.updateValue(k, (q,))
        # of settings that nothing can come before any more, the last stays
        settled = sorted(k for k in said | new if k[0] <= mark)[:-1]
        if settled:
            self._was.update(((said | new)[settled[-1]],))
            for k in settled:
                self._said.removeKey(k)
        changes = [(-1, *x) for x in sorted(told - now, key=lambda x: x[1])] + [(1, *x) for x in sorted(now - told, key=lambda x: x[1])]
        if changes:
            out = pd.DataFrame(changes, columns=["sign", "seq", "open", "close", "qty", "onqty"]).astype({"close": "Int64"})
            yield out.assign(**dict(zip(self._by, key)))[self._columns]

    def close(self) -> None:
        pass


def stateful_history(stream: DataFrame, by=("side", "price"), time: str = "time", qty: str = "qty", seq: str = "seq", delay: str = "1 minute") -> DataFrame:
    """The level history of ``stream`` as changes: ``by, sign, seq, open, close, qty, onqty``.

    An interval comes with sign 1 as soon as it is known (still open: null ``close``) and with -1 when a row ends it or, coming out of order,
    changes it; the sum of the signs of all that has come is the history that ``level_history`` gives. ``time`` is in
    microseconds; a level's settings may come in any order within ``delay``. State holds the settings newer than the watermark and one more.
    """
    schema = StructType([stream.schema[c] for c in by])
    for name in ("seq", "open", "close", "qty", "onqty"):
        schema.add(name, LongType())
    schema.add("sign", IntegerType())
    return _prepared(stream, time, delay).groupBy(*by).transformWithStateInPandas(_Level(list(by), time, qty, seq, schema.names), schema, "Append", "EventTime")
