"""Scalar functions of the order-book model: venue masks, times in nanoseconds, decimal and level text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def bit(venue: Column | int) -> Column:
    """The mask of one venue, 0 to 63."""
    v = F.lit(venue) if isinstance(venue, int) else venue
    return F.when(v.between(0, 63), F.call_function("shiftleft", F.lit(1).cast("long"), v.cast("int"))).otherwise(F.raise_error(F.lit("venue not in 0..63")))


def set_bit(mask: Column, venue) -> Column:
    return mask.bitwiseOR(bit(venue))


def clear_bit(mask: Column, venue) -> Column:
    return mask.bitwiseAND(F.bitwise_not(bit(venue)))


def has_bit(mask: Column, venue) -> Column:
    return mask.bitwiseAND(bit(venue)) != 0


def mask_text(mask: Column, n: int) -> Column:
    """The mask's last ``n`` bits, venue n - 1 first."""
    return F.right(F.lpad(F.bin(mask), 64, "0"), F.lit(n))


def hms_text(ns: Column) -> Column:
    """Time of day (UTC) as HH:MM:SS and the fraction without trailing zeros."""
    day = F.pmod(ns, F.lit(86_400_000_000_000))
    part = lambda unit, n: F.lpad((F.floor(day / F.lit(unit)) % n).cast("string"), 2, "0")
    sec = F.floor(day / F.lit(1_000_000_000))
    frac = F.rtrim(F.lpad((day - sec * 1_000_000_000).cast("string"), 9, "0"), F.lit("0"))
    text = F.concat_ws(":", part(3_600_000_000_000, 24), part(60_000_000_000, 60), part(1_000_000_000, 60))
    return F.when(frac == "", text).otherwise(F.concat_ws(".", text, frac))


def time_text(ns: Column) -> Column:
    """A time in ns since the epoch as yyyy-mm-dd HH:MM:SS and nine digits."""
    us = F.call_function("div", ns - F.pmod(ns, F.lit(1000)), F.lit(1000))
    return F.concat(F.date_format(F.timestamp_micros(us), "yyyy-MM-dd HH:mm:ss.SSSSSS"), F.lpad(F.pmod(ns, F.lit(1000)).cast("string"), 3, "0"))


def decimal_text(ticks: Column, digits: int) -> Column:
    """Integer ticks with ``digits`` decimals; zero is ``0``."""
    exact = (ticks.cast("decimal(18,0)") * F.lit(f"1e-{digits}").cast(f"decimal(18,{digits})")).cast(f"decimal(18,{digits})")
    return F.when(ticks == 0, "0").otherwise(exact.cast("string"))


def level_text(levels: Column) -> Column:
    """An array of level texts as one nested list."""
    return F.concat(F.lit("["), F.array_join(levels, ","), F.lit("]"))


def floor_to(ns: Column, step: int) -> Column:
    return ns - F.pmod(ns, F.lit(step))


def scaled(ticks: Column, digits: int, keep: int) -> Column:
    """Integer ticks as a decimal of ``digits`` decimals, rounded to ``keep``."""
    return F.round(ticks.cast("decimal(18,0)") * F.lit(f"1e-{digits}").cast(f"decimal(18,{digits})"), keep)


#: SQL functions by name: parameters, result and body.
SQL = {
    "venue_bit": ("v INT", "BIGINT", "CASE WHEN v BETWEEN 0 AND 63 THEN shiftleft(1L, v) ELSE raise_error('venue not in 0..63') END"),
    "set_venue": ("m BIGINT, v INT", "BIGINT", "m | venue_bit(v)"),
    "clear_venue": ("m BIGINT, v INT", "BIGINT", "m & ~venue_bit(v)"),
    "has_venue": ("m BIGINT, v INT", "BOOLEAN", "(m & venue_bit(v)) <> 0"),
    "mask_text": ("m BIGINT, n INT", "STRING", "right(lpad(bin(m), 64, '0'), n)"),
    "floor_ns": ("t BIGINT, step BIGINT", "BIGINT", "t - pmod(t, step)"),
    "time_text": ("t BIGINT", "STRING", "concat(date_format(timestamp_micros((t - pmod(t, 1000L)) div 1000L), 'yyyy-MM-dd HH:mm:ss.SSSSSS'), lpad(cast(pmod(t, 1000L) AS STRING), 3, '0'))"),
    "hms_text": ("t BIGINT", "STRING", "concat(date_format(timestamp_micros((t - pmod(t, 1000L)) div 1000L), 'HH:mm:ss'), CASE WHEN pmod(t, 1000000000L) = 0 THEN '' ELSE concat('.', rtrim('0', lpad(cast(pmod(t, 1000000000L) AS STRING), 9, '0'))) END)"),
}


def register(spark) -> None:
    """SQL functions of the scalars; times are read in the session's time zone, which should be UTC."""
    for name, (parameters, result, body) in SQL.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {result} RETURN {body}")
