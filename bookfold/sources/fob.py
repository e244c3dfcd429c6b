"""Full-order-book text: gz files of lines ``timestamp;type;asks;bids`` with nested level lists."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalar import decimal_text, level_text
from ..operators.asof import asof_join, row_index
from ..operators.levels import run_numbers, snapshot_at

LEVEL = r"\[\s*([0-9]*\.?[0-9]+)\s*,\s*([0-9]*\.?[0-9]+)\s*\]"
#: Digits of a decimal in all.
DIGITS = 15


def _numbers(text: Column) -> tuple[Column, Column]:
    return tuple(F.regexp_extract_all(text, F.lit(LEVEL), F.lit(i)) for i in (1, 2))


def parse_levels(text: Column, price_scale: int, qty_scale: int) -> Column:
    """Levels of a nested list as an array of ``price, qty`` decimals; null where a number has too many digits."""
    prices, quantities = _numbers(text)
    return F.transform(F.arrays_zip(prices.alias("p"), quantities.alias("q")), lambda x: F.struct(x["p"].try_cast(f"decimal({DIGITS},{price_scale})").alias("price"), x["q"].try_cast(f"decimal({DIGITS},{qty_scale})").alias("qty")))


def well_formed(text: Column) -> Column:
    """Whether a nested list holds levels with single commas between them and nothing else.

    Levels become one character each, so no pattern repeats a group and a line may have any number of levels."""
    mark = "\u0001"
    bare = F.regexp_replace(F.regexp_replace(text, LEVEL, mark), r"\s", "")
    lists = (bare == "[]") | (F.replace(bare, F.lit(f"{mark},"), F.lit("")) == f"[{mark}]")
    return F.coalesce(~F.contains(text, F.lit(mark)) & lists, F.lit(False))


#: What may stand at a place of a list: after its opening, levels of five tokens and what follows each.
_TOKEN = r"\s*(?:[0-9]*\.?[0-9]+|\S)|\s+$"
_EXPECTED = ("level", "price", "comma", "quantity", "level end", "comma or end")


def _let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then`` of a value that is worked out once."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def fault(text: Column) -> Column:
    """The first fault of a nested list, null if there is none: ``kind`` (what was expected, ``list``, one of ``_EXPECTED``, or ``nothing``
    after its end), ``place`` (the character, from 0, where that should stand) and ``levels`` (how many whole ones come before it).

    A list has one sequence of tokens, so what a token must be follows from its number; the place is the length of those before it."""

    def kind(x: Column) -> Column:
        bare = F.ltrim(F.regexp_replace(x, r"\s", " "))
        return F.when(bare.rlike(r"^[0-9.]*[0-9]$"), "0").otherwise(F.trim(bare))

    def wrong(last: Column) -> Callable[[Column, Column], Column]:
        def at(x: Column, i: Column) -> Column:
            step = F.pmod(i - 1, F.lit(6))
            fits = F.when(i == 0, x == "[").when((i == 1) & (x == "]"), True).when(step == 0, x == "[").when(step.isin(1, 3), x == "0").when(step == 2, x == ",").when(step == 4, x == "]").otherwise(x.isin(",", "]"))
            return F.when((last >= 0) & (i > last), x != "").otherwise(~fits)

        return at

    def told(raw: Column, kinds: Column, last: Column, first: Column) -> Column:
        at = F.when(first >= 0, first).when(last < 0, F.size(kinds)).cast("int")
        after = (last >= 0) & (at > last)
        before = F.aggregate(F.slice(raw, 1, at), F.lit(0), lambda n, x: n + F.length(x))
        # the blanks before a wrong token are no part of it
        blank = F.when(first >= 0, F.length(F.get(raw, at)) - F.length(F.get(kinds, at))).otherwise(0)
        blank = F.when(F.get(kinds, at) == "0", F.length(F.get(raw, at)) - F.length(F.trim(F.get(raw, at)))).otherwise(blank)
        name = F.when(at == 0, "list").when(after, "nothing").otherwise(F.get(F.array(*map(F.lit, _EXPECTED)), F.pmod(at - 1, F.lit(6))))
        levels = F.floor(F.when(after, last).otherwise(at) / 6).cast("int")
        return F.when(at.isNotNull(), F.struct(name.alias("kind"), (before + blank).cast("int").alias("place"), levels.alias("levels")))

    # a list ends where it may: at once, or after a level
    ends = lambda x, i: (x == "]") & ((i == 1) | ((i > 1) & (F.pmod(i, F.lit(6)) == 0)))
    place = lambda xs, test: F.array_position(F.transform(xs, test), F.lit(True)) - 1
    tokens = F.coalesce(F.regexp_extract_all(text, F.lit(_TOKEN), F.lit(0)), F.array().cast("array<string>"))
    return _let(tokens, lambda raw: _let(F.transform(raw, kind), lambda kinds: _let(place(kinds, ends), lambda last: _let(place(kinds, wrong(last)), lambda first: told(raw, kinds, last, first)))))


def faults(lines: DataFrame, before: bool = False) -> DataFrame:
    """``line_no, field, kind, place, levels`` of the first fault of each line that isn't well formed: its time (``kind`` ``time``), else
    its asks, else its bids. ``before``: also the ``asks`` and ``bids`` that whole levels before the fault give, as texts of price and quantity."""
    bad = _fields(lines).where(~_readable())
    good_time = F.coalesce(F.col("ts").rlike(r"^\d{1,19}$") & F.col("ts").try_cast("long").isNotNull(), F.lit(False))
    told = lambda c, f: F.struct(F.lit(c).alias("field"), f["kind"].alias("kind"), f["place"].alias("place"), f["levels"].alias("levels"))
    lists = _let(fault(F.col("asks")), lambda fa: F.when(fa.isNotNull(), told("asks", fa)).otherwise(_let(fault(F.col("bids")), lambda fb: told("bids", fb))))
    time = F.struct(F.lit("time").alias("field"), F.lit("time").alias("kind"), F.lit(0).alias("place"), F.lit(0).alias("levels"))
    # a generator, so that the scan is done once and not for each field taken from it; an outer one, as Spark filters by what others get
    found = bad.select("line_no", "asks", "bids", F.inline_outer(F.array(F.when(~good_time, time).otherwise(lists))))
    if not before:
        return found.select("line_no", "field", "kind", "place", "levels")

    def levels(c: str, own: Column) -> Column:
        prices, quantities = _numbers(F.col(c))
        return F.slice(F.arrays_zip(prices.alias("price"), quantities.alias("qty")), 1, own)

    asks = F.when(F.col("field") == "time", 0).when(F.col("field") == "asks", F.col("levels")).otherwise(F.lit(1 << 30))
    bids = F.when(F.col("field") == "bids", F.col("levels")).otherwise(0)
    return found.select("line_no", "field", "kind", "place", "levels", levels("asks", asks).alias("asks"), levels("bids", bids).alias("bids"))


def _fields(lines: DataFrame) -> DataFrame:
    parts = F.split("value", "[;|]")
    return lines.where(F.trim("value") != "").select("line_no", "value", F.trim(F.get(parts, F.lit(0))).alias("ts"), F.lower(F.trim(F.get(parts, F.lit(1)))).alias("kind"), F.get(parts, F.lit(2)).alias("asks"), F.get(parts, F.lit(3)).alias("bids"))


def _readable() -> Column:
    return F.coalesce(F.col("ts").rlike(r"^\d{1,19}$"), F.lit(False)) & F.col("ts").try_cast("long").isNotNull() & well_formed(F.col("asks")) & well_formed(F.col("bids"))


def scales(lines: DataFrame) -> DataFrame:
    """One row: ``n_lines, n_corrupt, n_levels, price_scale, qty_scale`` (most digits after a point) of ``lines``."""
    good = _fields(lines).withColumn("good", _readable())
    most = lambda xs: F.coalesce(F.array_max(F.transform(xs, lambda x: F.length(F.split_part(x, F.lit("."), F.lit(2))))), F.lit(0))
    both = F.concat(F.col("asks"), F.col("bids"))
    prices, quantities = _numbers(both)
    per = good.select("good", F.when(F.col("good"), F.size(prices)).alias("n"), F.when(F.col("good"), most(prices)).alias("p"), F.when(F.col("good"), most(quantities)).alias("q"))
    return per.agg(F.count("*").alias("n_lines"), F.count(F.when(~F.col("good"), 1)).alias("n_corrupt"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_levels"), F.coalesce(F.max("p"), F.lit(0)).alias("price_scale"), F.coalesce(F.max("q"), F.lit(0)).alias("qty_scale"))


def parse_lines(lines: DataFrame, price_scale: int = 8, qty_scale: int = 8) -> DataFrame:
    """``lines`` (``line_no, value``) as one row per level: ``line_no, time, us01, bs01, pos, price, qty, corrupt``.

    ``us01`` is 0 for updates, 1 for snapshots, 2 for others; ``bs01`` 0 for bids, 1 for asks; asks come first.
    Lines whose time isn't a 64-bit integer, whose lists hold other than levels, or that have a number of too many
    digits give one row with ``corrupt``.
    """
    us01 = F.when(F.col("kind").startswith("u"), 0).when(F.col("kind").startswith("s"), 1).otherwise(2)
    parsed = _fields(lines).select("line_no", "value", "ts", us01.alias("us01"), _readable().alias("good"), *[parse_levels(F.col(c), price_scale, qty_scale).alias(c) for c in ("asks", "bids")])
    fits = lambda c: F.coalesce(F.forall(c, lambda x: x["price"].isNotNull() & x["qty"].isNotNull()), F.lit(False))
    checked = parsed.withColumn("corrupt", F.when(~(F.col("good") & fits("asks") & fits("bids")), F.col("value")))
    sides = F.array(*[F.struct(F.lit(k).alias("bs01"), F.col(c).alias("levels")) for k, c in ((1, "asks"), (0, "bids"))])
    good = checked.where("corrupt is null").select("line_no", F.col("ts").try_cast("long").alias("time"), F.col("us01").cast("tinyint").alias("us01"), F.explode(sides).alias("s"))
    rows = good.select("line_no", "time", "us01", F.col("s.bs01").cast("tinyint").alias("bs01"), F.posexplode("s.levels").alias("pos", "l")).select("line_no", "time", "us01", "bs01", "pos", "l.price", "l.qty", F.lit(None).cast("string").alias("corrupt"))
    return rows.unionByName(checked.where("corrupt is not null").select("line_no", "corrupt"), allowMissingColumns=True)


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """``line_no, value`` of plain or gz files (one task per gz file), without the first line of each, whatever it says."""
    whole = spark.read.schema("value string").option("header", True).option("sep", "\u0001").option("quote", "").option("escape", "").csv(path)
    return whole.select("value", F.monotonically_increasing_id().alias("line_no"))


def read_fob(spark: SparkSession, path: str, price_scale: int | None = None, qty_scale: int | None = None) -> DataFrame:
    """Read FOB files. Scales that aren't given are those of the file, found in a pass of their own."""
    lines = read_lines(spark, path)
    if price_scale is None or qty_scale is None:
        found = scales(lines).first()
        price_scale = min(found.price_scale, DIGITS) if price_scale is None else price_scale
        qty_scale = min(found.qty_scale, DIGITS) if qty_scale is None else qty_scale
    return parse_lines(lines, price_scale, qty_scale)


def _lines(rows: DataFrame, by: list[str], price_digits: int, qty_digits: int) -> DataFrame:
    """Rows (``seq, bs01, price, qty`` in integer ticks) as ``asks`` and ``bids`` of each group, in the order of ``seq``."""
    level = F.concat(F.lit("["), decimal_text(F.col("price"), price_digits), F.lit(","), decimal_text(F.col("qty"), qty_digits), F.lit("]"))
    side = lambda k: level_text(F.transform(F.sort_array(F.collect_list(F.when(F.col("bs01") == k, F.struct("seq", "level")))), lambda x: x["level"]))
    return rows.select(*by, "seq", "bs01", level.alias("level")).groupBy(*by).agg(side(1).alias("asks"), side(0).alias("bids"))


def encode_updates(rows: DataFrame, price_digits: int = 3, qty_digits: int = 1, time: str = "time", seq: str = "seq", kind: str = "u") -> DataFrame:
    """Rows (``time, seq, bs01, price, qty`` in integer ticks) as one text line per time: asks, then bids, in input order."""
    own = rows.select(F.col(time).alias("timestamp"), F.col(seq).alias("seq"), "bs01", "price", "qty")
    return _lines(own, ["timestamp"], price_digits, qty_digits).select("timestamp", F.lit(kind).alias("type"), "asks", "bids")


def encode_runs(rows: DataFrame, price_digits: int = 3, qty_digits: int = 1, time: str = "time", seq: str = "seq", kind: str = "u", bucket: int = 1 << 20) -> DataFrame:
    """Rows as one text line per run of equal times in the order of ``seq``, whatever the order of the times: ``run`` (from 0),
    ``timestamp, type, asks, bids``. A time that comes back later starts another line; ``bucket`` as in ``run_numbers``."""
    own = run_numbers(rows.select(F.col(time).alias("timestamp"), F.col(seq).alias("seq"), "bs01", "price", "qty"), "timestamp", "seq", bucket)
    return _lines(own, ["run", "timestamp"], price_digits, qty_digits).select("run", "timestamp", F.lit(kind).alias("type"), "asks", "bids")


def format_book(updates: DataFrame, snapshots: DataFrame, **digits) -> DataFrame:
    """Update lines at all times but the snapshots', and a snapshot line at each of those, in order of time."""
    times = snapshots.select("time").distinct()
    return encode_updates(updates.join(times, "time", "left_anti"), **digits).unionByName(encode_updates(snapshots, kind="s", **digits)).orderBy("timestamp")


def encode_snapshot(history: DataFrame, at: int, **digits) -> DataFrame:
    """One line with all levels of a level history (``bs01, price, qty, open, close``) alive at a time, in order of price."""
    return encode_updates(snapshot_at(history, at).select(F.lit(at).cast("long").alias("time"), F.struct("price", "qty").alias("seq"), "bs01", "price", "qty"), kind="s", **digits)


def encode_update(history: DataFrame, at: int, **digits) -> DataFrame:
    """One line with the levels set at exactly a time, in order of price."""
    return encode_updates(history.where(F.col("open") == at).select(F.col("open").alias("time"), F.struct("price", "qty").alias("seq"), "bs01", "price", "qty"), **digits)


def sample_times(history: DataFrame, n: int, seed: int = 1) -> DataFrame:
    """``n`` of the distinct times of a level history, those with the smallest hashes."""
    return history.select(F.col("open").alias("time")).distinct().orderBy(F.xxhash64(F.lit(seed), "time"), "time").limit(n)


def format_history(history: DataFrame, times: DataFrame, bucket: int = 3_600_000_000, **digits) -> DataFrame:
    """A level history as a book: a snapshot line with all live levels at each of ``times`` (column ``time``), an update
    line at each other time, in order of time.

    The snapshots that a level's life holds are a range of their index, found by two as-of joins, so a level meets its
    snapshots in an equi-join."""
    index = row_index(times.select("time").distinct(), "time", bucket)
    own = history.select("bs01", "price", "qty", "open", "close", F.col("open").alias("at"))
    before = asof_join(own, index.withColumnRenamed("time", "at"), "at", values=("k",), allow_exact=False, bucket=bucket).withColumnRenamed("k", "lo").drop("right_time")
    ends = before.withColumn("at", F.coalesce("close", F.lit((1 << 62) - 1)))
    upto = asof_join(ends, index.withColumnRenamed("time", "at"), "at", values=("k",), bucket=bucket).where("k is not null")
    first = F.coalesce(F.col("lo") + 1, F.lit(0).cast("long"))
    held = upto.where(first <= F.col("k")).select("bs01", "price", "qty", "open", F.explode(F.sequence(first, F.col("k"))).alias("k"))
    live = held.join(index, "k").where((F.col("open") == F.col("time")) | (F.col("qty") > 0)).select("time", F.struct("price", "qty").alias("seq"), "bs01", "price", "qty")
    updates = history.select(F.col("open").alias("time"), F.struct("price", "qty").alias("seq"), "bs01", "price", "qty").join(times.select("time").distinct(), "time", "left_anti")
    return encode_updates(updates, **digits).unionByName(encode_updates(live, kind="s", **digits)).orderBy("timestamp")


def write_fob(book: DataFrame, path: str) -> None:
    """Write lines as gz text with a header, in order of time over the files."""
    book.sort("timestamp").write.mode("overwrite").option("sep", ";").option("header", True).option("compression", "gzip").option("quote", "").csv(path)
