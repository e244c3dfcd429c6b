"""Queries over the driver's tables and their SQL, by the mapping of events to quotes, levels and orders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalar as S
from ..operators import levels as L
from ..operators import simulate as G
from ..operators.asof import asof_join, row_index
from ..operators.nbbo import nbbo
from ..operators.intervals import interval_join, overlap_counts
from ..operators.verify import all_crossings, all_violations, first_violation, level_crossings
from ..sources import fob
from ..storage import new_path, stored

HOUR = 3_600_000_000
#: Time buckets of the unkeyed operators, in microseconds of event time.
BUCKET = 24 * HOUR
EV = "ev AS (SELECT event_id, epoch_us(ts) AS t, user_id, event_type, CAST(round(value*100) AS BIGINT) AS cents, event_id%2 AS side, CAST(floor(value/5) AS INTEGER) AS lvl, event_id%7 AS qty, CAST(user_id%8 AS INTEGER) AS venue FROM events)"
T0 = "(SELECT CAST(min(epoch_us(ts)) + (max(epoch_us(ts)) - min(epoch_us(ts))) // 2 AS BIGINT) FROM events)"


def ev(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return e.select("event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("t"), "user_id", "event_type", F.round(F.col("value") * 100).cast("long").alias("cents"), (F.col("event_id") % 2).alias("side"), F.floor(F.col("value") / 5).cast("int").alias("lvl"), (F.col("event_id") % 7).alias("qty"), (F.col("user_id") % 8).cast("int").alias("venue"))


def middle(e: DataFrame) -> int:
    return e.agg(F.expr("cast(min(t) + (max(t) - min(t)) div 2 as long)")).first()[0]


def _levels(s, d, **options) -> DataFrame:
    e = ev(s, d).select("side", "lvl", "t", "event_id", "qty")
    return L.level_history(e, ("side", "lvl"), "t", "qty", "event_id", **options).select("event_id", "side", "lvl", "open", "close", "qty", "onqty")


def level_history(s, d):
    return _levels(s, d)


def level_intervals_coalesced(s, d):
    return _levels(s, d, coalesce_intervals=True)


LEVELS = "lv AS (SELECT event_id, side, lvl, t AS open, lead(t) OVER w AS close, qty, qty - coalesce(lag(qty) OVER w, 0) AS onqty FROM ev WINDOW w AS (PARTITION BY side, lvl ORDER BY t, event_id))"


def snapshot_at(s, d):
    return L.snapshot_at(_levels(s, d), middle(ev(s, d))).select("event_id", "side", "lvl", "qty")


def decoded_flags(s, d):
    return ev(s, d).where("qty <> 0").select("event_id", F.when(F.col("side") == 0, "b").otherwise("s").alias("side"), F.when(F.col("qty") % 3 == 1, "s").otherwise("u").alias("type"), S.floor_to(F.col("t") * 1000, 10_000).alias("t_ns"))


def _views(e, *cols):
    return e.where("event_type = 'view'").select("t", *cols)


def _asof(exact: bool, by=(), **more):
    def run(s, d):
        e = ev(s, d)
        left = e.where("event_type = 'purchase'").select("event_id", "t", *by)
        return asof_join(left, _views(e, F.col("event_id").alias("view_id"), *by), "t", by, ("view_id",), exact, bucket=BUCKET, **more).select("event_id", "view_id", "right_time")

    return run


def _asof_sql(op: str, by: str = "", cond: str = "") -> str:
    inner = f"SELECT l.event_id, r.event_id AS view_id, r.t AS right_time, l.t AS lt FROM (SELECT * FROM ev WHERE event_type='purchase') l ASOF LEFT JOIN (SELECT * FROM ev WHERE event_type='view') r ON {by} l.t {op} r.t"
    if cond:
        return f"WITH {EV}, x AS ({inner}) SELECT event_id, CASE WHEN {cond} THEN view_id END AS view_id, CASE WHEN {cond} THEN right_time END AS right_time FROM x"
    return f"WITH {EV}, x AS ({inner}) SELECT event_id, view_id, right_time FROM x"


def asof_index(s, d):
    e = ev(s, d)
    right = row_index(_views(e), "t", BUCKET)
    left = e.where("event_type = 'purchase'").select("event_id", "t")
    return asof_join(left, right, "t", values=("k",), bucket=BUCKET).select("event_id", F.coalesce("k", F.lit(-1)).cast("long").alias("idx"))


def asof_index_compat(s, d):
    """The index rule that skips ties but at index 0."""
    e = ev(s, d)
    right = row_index(_views(e), "t", BUCKET)
    left = e.where("event_type = 'purchase'").select("event_id", "t")
    found = asof_join(left, right, "t", values=("k",), allow_exact=False, bucket=BUCKET)
    first = right.agg(F.min("t")).first()[0]
    return found.select("event_id", F.when(F.col("t") < F.lit(first), -1).otherwise(F.coalesce("k", F.lit(0))).cast("long").alias("idx"))


def _orders(e):
    # prices around the barrier's middle, so that some orders are never violated
    return e.where("event_type = 'purchase'").select(F.col("event_id").alias("order_id"), F.when(F.col("side") == 0, "b").otherwise("s").alias("side"), F.when(F.col("side") == 0, F.col("cents") % 300).otherwise(30000 + F.col("cents") % 20000).alias("price"), F.col("t").alias("open"), F.when(F.col("event_id") % 11 != 0, F.col("t") + F.col("cents") * 10_000_000).alias("close"))


def _barrier(e):
    return e.where("event_type = 'view'").groupBy("t").agg(F.max("cents").alias("nbb")).withColumn("nbo", F.col("nbb") + 50)


def _verify(eq: bool, same: bool, touch: bool, pdiff: int = 0):
    def run(s, d):
        e = ev(s, d)
        return first_violation(_orders(e), _barrier(e), pdiff, eq, same, touch, BUCKET).select("order_id", "side", "first_violation_k")

    return run


ORDERS = "o AS (SELECT event_id AS order_id, CASE WHEN side=0 THEN 'b' ELSE 's' END AS side, CASE WHEN side=0 THEN cents%300 ELSE 30000+cents%20000 END AS price, t AS open, CASE WHEN event_id%11<>0 THEN t+cents*10000000 END AS close FROM ev WHERE event_type='purchase'), b0 AS (SELECT t, max(cents) AS nbb, max(cents)+50 AS nbo FROM ev WHERE event_type='view' GROUP BY t), b AS (SELECT *, row_number() OVER (ORDER BY t)-1 AS k, lead(t) OVER (ORDER BY t) AS nt FROM b0)"


def _verify_sql(eq: bool, same: bool, touch: bool, pdiff: int = 0) -> str:
    buy, sell = ("nbb", "nbo") if same else ("nbo", "nbb")
    e, c = ("=" if eq else ""), ("=" if touch else "")
    hit = f"(o.side='b' AND o.price+({pdiff}) >{e} b.{buy} OR o.side='s' AND o.price-({pdiff}) <{e} b.{sell})"
    live = f"(o.close IS NULL OR b.t <{c} o.close) AND (b.nt IS NULL OR b.nt >{c} o.open)"
    return f"WITH {EV}, {ORDERS}, v AS (SELECT o.order_id, min(b.k) AS k FROM o JOIN b ON {live} AND {hit} GROUP BY 1) SELECT o.order_id, o.side, CAST(coalesce(v.k, (SELECT count(*) FROM b)) AS BIGINT) AS first_violation_k FROM o LEFT JOIN v USING (order_id)"


def hit_times(s, d):
    """The earlier of two violations and whether it falls in the order's life."""
    e = ev(s, d)
    o, b = _orders(e), _barrier(e)
    two = first_violation(o, b, 0, bucket=BUCKET).withColumnRenamed("first_violation_k", "k1").join(first_violation(o, b, 2000, bucket=BUCKET).select("order_id", F.col("first_violation_k").alias("k2")), "order_id")
    t = row_index(b, "t", BUCKET).select("k", F.col("t").alias("hit_t"))
    j = two.withColumn("kk", F.least("k1", "k2")).join(t, F.col("kk") == F.col("k"), "left")
    return j.select("order_id", "hit_t", F.coalesce((F.col("hit_t") >= F.col("open")) & (F.col("close").isNull() | (F.col("hit_t") < F.col("close"))), F.lit(False)).cast("int").alias("hit"))


def _hit_sql() -> str:
    def body(p):
        return f"SELECT o.order_id, min(b.k) AS k FROM o JOIN b ON (o.close IS NULL OR b.t < o.close) AND (b.nt IS NULL OR b.nt > o.open) AND (o.side='b' AND o.price+{p} > b.nbo OR o.side='s' AND o.price-{p} < b.nbb) GROUP BY 1"

    return f"WITH {EV}, {ORDERS}, v1 AS ({body(0)}), v2 AS ({body(2000)}) SELECT o.order_id, b.t AS hit_t, CASE WHEN b.t >= o.open AND (o.close IS NULL OR b.t < o.close) THEN 1 ELSE 0 END AS hit FROM o LEFT JOIN v1 USING (order_id) LEFT JOIN v2 USING (order_id) LEFT JOIN b ON b.k = least(coalesce(v1.k, v2.k), coalesce(v2.k, v1.k))"


def crossings(s, d):
    e = ev(s, d).where("event_type = 'view'").groupBy("t").agg(F.max("cents").alias("v"))
    return level_crossings(e, 5000, bucket=BUCKET).select("t", "v", "next_time", "next_value")


def _quotes(e):
    return e.select("t", F.col("event_id").alias("iline"), F.col("venue").alias("bv"), F.col("cents").alias("bp"), F.col("qty").alias("bq"), (7 - F.col("venue")).alias("sv"), (F.col("cents") + 10 * F.col("qty")).alias("sp"), ((F.col("event_id") + 3) % 7).alias("sq"))


def nbbo_published(s, d):
    return nbbo(_quotes(ev(s, d)), 8, "published", BUCKET)


def nbbo_every_event(s, d):
    return nbbo(_quotes(ev(s, d)), 8, "every_event", BUCKET)


def nbbo_stats(s, d):
    r = nbbo(_quotes(ev(s, d)), 8, "every_event", BUCKET)
    return r.select("iline", S.mask_text(F.col("b_ii"), 8).alias("bid_mask"), F.bit_count("s_ii").cast("int").alias("ask_venues"), S.has_bit(F.col("b_ii"), 3).cast("int").alias("has3"), S.clear_bit(F.col("s_ii"), 1).alias("without1"))


def _many_quotes(e):
    """Quotes of 64 venues."""
    v = (F.col("user_id") * 7 + F.col("event_id")) % 64
    return _quotes(e.withColumn("venue", v.cast("int"))).withColumn("sv", 63 - F.col("bv"))


def nbbo_many_venues(s, d):
    return nbbo(_many_quotes(ev(s, d)), 64, "every_event", BUCKET)


def nbbo_many_published(s, d):
    return nbbo(_many_quotes(ev(s, d)), 64, "published", BUCKET)


def _nbbo_sql(count: int = 8, venue: str = "venue") -> str:
    cols, side = [], {"b": (venue, "cents", "qty"), "s": (f"{count - 1}-{venue}", "cents+10*qty", "(event_id+3)%7")}
    for k, (v, p, q) in side.items():
        for i in range(count):
            ok = f"({q})>0 AND ({p})>0"
            cols.append(f"last_value(CASE WHEN {v}={i} THEN {{'p': CAST({p} AS BIGINT), 'q': CAST(CASE WHEN {ok} THEN {q} ELSE 0 END AS BIGINT)}} END IGNORE NULLS) OVER w AS {k}{i}")
    out = ["t AS time", "event_id AS iline"]
    best = []
    for k, f in (("b", "greatest"), ("s", "least")):
        best.append(f"{f}({', '.join(f'CASE WHEN {k}{i}.q>0 THEN {k}{i}.p END' for i in range(count))}) AS p{k}")
    for k, p, q, m, n in (("b", "nbb", "nbbq", "b_ii", "num_b"), ("s", "nbo", "nboq", "s_ii", "num_s")):
        at = [f"coalesce({k}{i}.q>0 AND {k}{i}.p=p{k}, false)" for i in range(count)]
        out += [f"coalesce(p{k}, 0) AS {p}", "CAST(" + "+".join(f"CASE WHEN {a} THEN {k}{i}.q ELSE 0 END" for i, a in enumerate(at)) + f" AS BIGINT) AS {q}"]
        out += ["CAST(" + "+".join(f"CASE WHEN {a} THEN {(1 << i) - (i == 63) * (1 << 64)} ELSE 0 END" for i, a in enumerate(at)) + f" AS BIGINT) AS {m}", "CAST(" + "+".join(f"CASE WHEN {a} THEN 1 ELSE 0 END" for a in at) + f" AS INTEGER) AS {n}"]
    return f"{EV}, st AS (SELECT t, event_id, {', '.join(cols)} FROM ev WINDOW w AS (ORDER BY t, event_id ROWS UNBOUNDED PRECEDING)), bst AS (SELECT *, {', '.join(best)} FROM st), al AS (SELECT {', '.join(out)} FROM bst)"


_V64 = "CAST((user_id*7+event_id)%64 AS INTEGER)"
_FIELDS = "(nbb, nbo, nbbq, nboq, b_ii, s_ii)"


def fob_encode(s, d):
    e = ev(s, d).select(((F.floor(F.col("t") / HOUR) * HOUR)).cast("long").alias("time"), F.col("event_id").alias("seq"), F.col("side").alias("bs01"), F.col("cents").alias("price"), "qty")
    return fob.encode_updates(e, 3, 1)


def _text_sql(rows: str, kind: str = "u") -> str:
    exact = lambda c, n: f"CASE WHEN {c}=0 THEN '0' ELSE CAST({c} // {10**n} AS VARCHAR) || '.' || lpad(CAST({c} % {10**n} AS VARCHAR), {n}, '0') END"
    agg = lambda k: f"'[' || coalesce(string_agg('[' || {exact('price', 3)} || ',' || {exact('qty', 1)} || ']', ',' ORDER BY seq) FILTER (bs01={k}), '') || ']'"
    return f"SELECT time AS timestamp, '{kind}' AS type, {agg(1)} AS asks, {agg(0)} AS bids FROM {rows} GROUP BY time"


ENC = "SELECT t // 3600000000 * 3600000000 AS time, event_id AS seq, side AS bs01, cents AS price, qty FROM ev"


def fob_roundtrip(s, d):
    lines = fob_encode(s, d)
    text = lines.select(F.col("timestamp").alias("line_no"), F.concat_ws(";", F.col("timestamp").cast("string"), "type", "asks", "bids").alias("value"))
    return fob.parse_lines(text, 3, 1).select("time", F.col("bs01").cast("int").alias("bs01"), "pos", (F.col("price") * 1000).cast("long").alias("price"), (F.col("qty") * 10).cast("long").alias("qty"))


def book_format(s, d):
    e = ev(s, d).select(F.col("t").alias("time"), F.col("event_id").alias("seq"), F.col("side").alias("bs01"), F.col("cents").alias("price"), "qty")
    return fob.format_book(e, e.where("seq % 97 = 0"))


def cumulate(s, d):
    e = ev(s, d).where("event_type = 'purchase'").select("side", "lvl", "qty", F.col("t").alias("t0"), F.when(F.col("event_id") % 5 != 0, F.col("t") + F.col("cents") * 1_000_000).alias("t1"))
    return L.cumulate(e, ("side", "lvl"))


def distinct_prices(s, d):
    return ev(s, d).groupBy("side").agg(F.countDistinct("lvl").alias("n_levels"), F.countDistinct("user_id").alias("n_ids"), F.max("lvl").alias("max_lvl"))


def counts_by_side(s, d):
    return ev(s, d).groupBy("side").agg(F.count("*").alias("n"), F.sum(F.when(F.col("qty") > 0, 1).otherwise(0)).alias("n_live"), F.sum("qty").alias("qty"), F.min("t").alias("t_min"), F.max("t").alias("t_max"))


def topn_per_side(s, d):
    return L.top_n(ev(s, d).select("event_id", "side", "cents"), ["side"], [F.desc("cents"), "event_id"], 10)


def anti_times(s, d):
    e = ev(s, d).select("t", "event_id")
    return e.join(e.where("event_id % 97 = 0").select("t").distinct(), "t", "left_anti")


def union_books(s, d):
    e = ev(s, d).select("event_id", "side", "lvl")
    return e.where("side = 0").unionByName(e.where("side = 1 and lvl > 5"))


def window_clamp(s, d):
    e = ev(s, d)
    m = middle(e)
    o = _orders(e).where((F.col("open") <= m + HOUR * 100) & (F.coalesce("close", F.lit(1 << 62)) >= m))
    return o.select("order_id", F.greatest(F.col("open"), F.lit(m - 1000)).alias("open"), F.least(F.coalesce("close", F.lit(1 << 62)), F.lit(m + HOUR * 100 + 1000)).alias("close"))


def time_texts(s, d):
    ns = F.col("t") * 1000 + F.col("qty") * 100
    return ev(s, d).select("event_id", S.hms_text(ns).alias("hms"), S.time_text(ns).alias("full_text"))


def _observed(s, d):
    """Start (ns) and numbers of mid prices and orders of a simulated book: those of the events."""
    r = ev(s, d).agg(F.min("t"), F.count(F.when(F.col("event_type") == "view", 1)), F.count(F.when(F.col("event_type") == "purchase", 1))).first()
    return r[0] * 1000, r[1], r[2]


def sim_time_grid(s, d):
    start, n_mid, _ = _observed(s, d)
    return G.time_grid(s, start, n_mid, G.SECOND)


def sim_mid(s, d):
    start, n_mid, _ = _observed(s, d)
    return G.mid_price(s, start, n_mid, G.SECOND)


def sim_orders(s, d):
    start, n_mid, n = _observed(s, d)
    return G.fake_orders(s, n, n_mid, start_ns=start)


def sim_book(s, d):
    return G.fake_book(sim_orders(s, d))


def _history(s, d):
    return _levels(s, d).select("event_id", F.col("side").alias("bs01"), F.col("lvl").alias("price"), "qty", "open", "close")


def snapshot_encode(s, d):
    return fob.encode_snapshot(_history(s, d), middle(ev(s, d)))


def _some_open(s, d):
    return _history(s, d).where("event_id % 397 = 5").agg(F.min("open")).first()[0]


def update_encode(s, d):
    return fob.encode_update(_history(s, d), _some_open(s, d))


def book_snapshots(s, d):
    h = _history(s, d)
    return fob.format_history(h.drop("event_id"), h.where("event_id % 397 = 0").select(F.col("open").alias("time")), BUCKET)


def level_history_bucketed(s, d):
    return _levels(s, d, bucket=BUCKET)


def level_intervals_bucketed(s, d):
    return _levels(s, d, coalesce_intervals=True, bucket=BUCKET)


def _depth(s, d, **options):
    e = ev(s, d).where("event_type = 'purchase'").select("side", "lvl", "qty", F.col("t").alias("t0"), F.when(F.col("event_id") % 5 != 0, F.col("t") + F.col("cents") * 1_000_000).alias("t1"))
    return L.cumulate(e, ("side", "lvl"), **options)


def cumulate_bucketed(s, d):
    return _depth(s, d, bucket=BUCKET)


def depth_close(s, d):
    return L.close_times(_depth(s, d), ("side", "lvl"))


def argsort_side_price_time(s, d):
    return L.argsort(ev(s, d).select("event_id", "side", "lvl", "t"), ("side", "lvl"), ("t", "event_id"))


def argsort_side_price_venue_time(s, d):
    return L.argsort(ev(s, d).select("event_id", "side", "lvl", "venue", "t"), ("side", "lvl", "venue"), ("t", "event_id"))


def argsort_price_time(s, d):
    return L.argsort(ev(s, d).select("event_id", "lvl", "t"), ("lvl",), ("t", "event_id"))


def _crossings(start: str, level: int):
    def run(s, d):
        e = ev(s, d).where("event_type = 'view'").groupBy("t").agg(F.max("cents").alias("v"))
        return level_crossings(e, level, bucket=BUCKET, start=start).select("t", "v", "next_time", "next_value")

    return run


def hits_total(s, d):
    return hit_times(s, d).agg(F.count("*").alias("n"), F.sum("hit").cast("long").alias("hits"))


def scaled_prices(s, d):
    return ev(s, d).select("event_id", S.scaled(F.col("cents"), 3, 1).cast("double").alias("price"), S.scaled(F.col("qty"), 1, 0).cast("double").alias("qty"))


def participants(s, d):
    return ev(s, d).groupBy(G.participant(F.col("venue")).alias("participant")).agg(F.count("*").alias("n"))


def sql_functions(s, d):
    S.register(s)
    ev(s, d).createOrReplaceTempView("bookfold_events")
    return s.sql("SELECT event_id, mask_text(set_venue(qty, venue), 8) AS mask, has_venue(qty, 1) AS has1, clear_venue(qty, 1) AS without1, floor_ns(t * 1000, 10000) AS t_ns, hms_text(t * 1000 + qty * 100) AS hms, time_text(t * 1000 + qty * 100) AS full_text FROM bookfold_events")


def _deep_lines(s, d):
    """Lines of thousands of levels with numbers of varied scale."""
    e = ev(s, d).select("event_id", "side", "cents", "qty", (F.floor(F.col("t") / (720 * HOUR)) * 720 * HOUR).cast("long").alias("time"))
    level = F.concat(F.lit("["), F.when(F.col("cents") == 0, "0").otherwise(F.rtrim(S.decimal_text(F.col("cents"), 3), F.lit("0"))), F.lit("0,"), F.col("qty").cast("string"), F.lit("]"))
    own = e.select("time", "event_id", "side", level.alias("level"))
    side = lambda k: S.level_text(F.transform(F.sort_array(F.collect_list(F.when(F.col("side") == k, F.struct("event_id", "level")))), lambda x: x["level"]))
    return own.groupBy("time").agg(side(1).alias("asks"), side(0).alias("bids")).select(F.col("time").alias("timestamp"), F.lit("u").alias("type"), "asks", "bids")


def fob_deep(s, d):
    """gz files written and read back, their scales found."""
    path = new_path(s, "fob-deep")
    fob.write_fob(_deep_lines(s, d), path)
    return fob.read_fob(s, path).select("time", F.col("bs01").cast("int").alias("bs01"), "pos", F.round(F.col("price").cast("double") * 1000).cast("long").alias("price"), F.col("qty").cast("long").alias("qty"), F.col("corrupt").isNotNull().alias("bad"))


def fob_scales(s, d):
    lines = _deep_lines(s, d)
    return fob.scales(lines.select(F.col("timestamp").alias("line_no"), F.concat_ws(";", F.col("timestamp").cast("string"), "type", "asks", "bids").alias("value")))


def _reset_book(e):
    """Settings by spans of six hours, every fifth of which is a snapshot."""
    span = F.floor(F.col("t") / (6 * HOUR)).cast("long")
    return e.select("event_id", "side", "lvl", (span * 6 * HOUR).alias("t"), "qty", F.when(span % 5 == 0, 1).otherwise(0).alias("us01"))


def snapshot_resets(s, d):
    h = L.level_history(_reset_book(ev(s, d)), ("side", "lvl"), "t", "qty", "event_id", bucket=BUCKET, snapshot_resets=True)
    return h.select("event_id", "side", "lvl", "us01", "open", "close", "qty", "onqty")


def snapshot_resets_coalesced(s, d):
    h = L.level_history(_reset_book(ev(s, d)), ("side", "lvl"), "t", "qty", "event_id", coalesce_intervals=True, snapshot_resets=True)
    return h.select("event_id", "side", "lvl", "open", "close", "qty")


def _mid(e):
    return e.where("event_type = 'view'").groupBy("t").agg(F.max("cents").alias("v"))


def crossings_all(s, d):
    """Crossings of all levels of orders at once."""
    e = ev(s, d)
    return all_crossings(_mid(e), e.where("event_type = 'purchase'").select((F.col("lvl") * 500).alias("price")), bucket=BUCKET)


def crossings_all_above(s, d):
    e = ev(s, d)
    return all_crossings(_mid(e), e.where("event_type = 'purchase'").select((F.col("lvl") * 500).alias("price")), start="above", bucket=BUCKET)


def crossings_per_price(s, d):
    """How often each distinct order price is crossed, and when first and last."""
    e = ev(s, d)
    return all_crossings(_mid(e), e.where("event_type = 'purchase'").select(F.col("cents").alias("price")), bucket=BUCKET, width=5000).groupBy("price").agg(F.count("*").alias("n"), F.min("t").alias("first_t"), F.max("t").alias("last_t"))


def violations_all(s, d):
    """Every barrier row that violates an order."""
    e = ev(s, d)
    return all_violations(_orders(e), _barrier(e), bucket=BUCKET).select("order_id", "violation_k")


def violations_all_touch(s, d):
    e = ev(s, d)
    return all_violations(_orders(e), _barrier(e), -100, True, True, True, BUCKET).select("order_id", "violation_k")


def _lives(e):
    return e.where("event_type = 'purchase'").select(F.col("event_id").alias("order_id"), "side", "lvl", F.col("t").alias("open"), F.when(F.col("event_id") % 11 != 0, F.col("t") + (F.col("cents") - 100) * 10_000_000).alias("close"))


def orders_while_level(s, d):
    """Each order with each setting of its level that stood during its life."""
    e = ev(s, d)
    found = interval_join(_lives(e), _levels(s, d).select("event_id", "side", "lvl", "open", "close"), by=("side", "lvl"), bucket=BUCKET)
    return found.select("left.order_id", "right.event_id", F.greatest("left.open", "right.open").alias("since"))


def orders_alive_together(s, d):
    """How many other orders are alive at some time of each order's life."""
    own = _lives(ev(s, d)).select("order_id", "open", "close").dropna(subset=["order_id"])
    # those of the same id, as a rule the order itself, don't count
    alive, same = overlap_counts(own, bucket=BUCKET), overlap_counts(own, by=("order_id",), bucket=BUCKET)
    parts = alive.select("order_id", "n").unionByName(same.select("order_id", (-F.col("n")).alias("n")))
    return parts.groupBy("order_id").agg(F.sum("n").alias("n")).where("n > 0")


def fob_encode_runs(s, d):
    """A line per run of equal times of rows that aren't sorted by time."""
    e = ev(s, d).select((F.col("event_id") / 3).cast("long").alias("third"), F.col("event_id").alias("seq"), F.col("side").alias("bs01"), F.col("cents").alias("price"), "qty")
    return fob.encode_runs(e.withColumn("time", F.col("third") * 7919 % 4), bucket=500)


def fob_faults(s, d):
    """Where lines with faults of seven kinds break."""
    e = ev(s, d)
    one = lambda k: F.concat(F.lit("["), (F.col("cents") + k).cast("string"), F.lit(", "), F.col("qty").cast("string"), F.lit("]"))
    a, b, c = one(0), one(1), one(2)
    k = F.col("event_id") % 8
    text = F.when(k == 1, F.concat(F.lit("["), a, F.lit(",,"), b, F.lit("]"))).when(k == 2, F.concat(F.lit("["), a, F.lit(" "), b, F.lit("]"))).when(k == 3, F.concat(F.lit("["), a, F.lit(","), b)).when(k == 4, F.concat(F.lit("["), a, F.lit(", [x"), b, F.lit("]"))).when(k == 5, F.concat(F.lit("["), a, F.lit("] ]"))).when(k == 6, F.concat(F.lit("["), a, F.lit(", ["), F.col("cents").cast("string"), F.lit(",1 ,"), c, F.lit("]"))).when(k == 7, a).otherwise(F.concat(F.lit("["), a, F.lit(" , "), b, F.lit(","), c, F.lit("] ")))
    lines = e.select(F.col("event_id").alias("line_no"), F.concat(F.col("t").cast("string"), F.lit(";u;"), F.when(k == 7, F.lit("[]")).otherwise(text), F.lit(";"), F.when(k == 7, text).otherwise(F.lit("[ ]"))).alias("value"))
    return fob.faults(stored(lines))


def _gaps(e):
    """Events with gaps: no user, level or time on some."""
    nullif = lambda c, n: F.nullif(F.col(c) % n, F.lit(0).cast("long")).cast("long")
    return e.withColumns({"user_id": nullif("user_id", 5), "lvl": nullif("lvl", 7), "t": F.when(F.col("event_id") % 13 != 0, F.col("t"))})


def asof_gaps(s, d):
    e = _gaps(ev(s, d))
    return asof_join(e.where("event_type = 'purchase'").select("event_id", "t", "user_id"), _views(e, F.col("event_id").alias("view_id"), "user_id"), "t", ("user_id",), ("view_id",), bucket=BUCKET)


def history_gaps(s, d):
    e = _gaps(ev(s, d)).withColumn("qty", F.when(F.col("event_id") % 17 != 0, F.col("qty"))).select("side", "lvl", "t", "event_id", "qty")
    return L.level_history(e, ("side", "lvl"), "t", "qty", "event_id", bucket=BUCKET).select("event_id", "side", "lvl", "open", "close", "qty", "onqty")


def cumulate_gaps(s, d):
    e = _gaps(ev(s, d)).where("event_type = 'purchase'").select("side", "lvl", "qty", F.col("t").alias("t0"), F.when(F.col("event_id") % 5 != 0, F.col("t") + F.col("cents") * 1_000_000).alias("t1"))
    return L.cumulate(e, ("side", "lvl"), bucket=BUCKET)


def argsort_gaps(s, d):
    return L.argsort(_gaps(ev(s, d)).select("event_id", "lvl", "t"), ("lvl",), ("t", "event_id"))


def index_gaps(s, d):
    return row_index(_gaps(ev(s, d)).select("event_id", "t"), "t", BUCKET, ("event_id",))


FLAGS = [(e, s, t) for e in (False, True) for s in (False, True) for t in (False, True)]
QUERIES = {
    f.__name__: f
    for f in (level_history, level_intervals_coalesced, snapshot_at, decoded_flags, asof_index, asof_index_compat, hit_times, crossings, nbbo_published, nbbo_every_event, nbbo_stats, nbbo_many_venues, nbbo_many_published, fob_encode, fob_roundtrip, book_format, cumulate, distinct_prices, counts_by_side, topn_per_side, anti_times, union_books, window_clamp, time_texts, sim_time_grid, sim_mid, sim_orders, sim_book, snapshot_encode, update_encode, book_snapshots, level_history_bucketed, level_intervals_bucketed, cumulate_bucketed, depth_close, argsort_side_price_time, argsort_side_price_venue_time, argsort_price_time, hits_total, scaled_prices, participants, sql_functions, fob_deep, fob_scales, snapshot_resets, snapshot_resets_coalesced, crossings_all, crossings_all_above, crossings_per_price, violations_all, violations_all_touch, orders_while_level, orders_alive_together, fob_encode_runs, fob_faults, asof_gaps, history_gaps, cumulate_gaps, argsort_gaps, index_gaps)
} | {"crossings_above": _crossings("above", 30000), "crossings_below": _crossings("below", 20000)} | {"asof_inclusive": _asof(True), "asof_strict": _asof(False), "asof_by_user": _asof(True, ("user_id",)), "asof_forward": _asof(True, direction="forward"), "asof_tolerance": _asof(True, tolerance=HOUR)}
QUERIES |= {f"verify_eq{int(e)}_same{int(s)}_touch{int(t)}": _verify(e, s, t) for e, s, t in FLAGS}
QUERIES["verify_pdiff"] = _verify(False, False, False, -100)

_H = f"{EV}, {LEVELS}, h AS (SELECT event_id, side AS bs01, lvl AS price, qty, open, close FROM lv WHERE onqty<>0)"
_SORTED = _text_sql("x", "s").replace("ORDER BY seq", "ORDER BY seq, price, qty")
_CROSS = f"WITH {EV}, g AS (SELECT t, max(cents) AS v FROM ev WHERE event_type='view' GROUP BY t), n AS (SELECT t, v, lead(t) OVER (ORDER BY t) AS next_time, lead(v) OVER (ORDER BY t) AS next_value, row_number() OVER (ORDER BY t) AS k FROM g) SELECT t, v, next_time, next_value FROM n WHERE (next_value IS NOT NULL AND sign(v-{{0}})<>sign(next_value-{{0}})) OR (k=1 AND v{{1}}{{0}})"


def _rank_sql(cols: str, out: str) -> str:
    return f"WITH {EV} SELECT event_id, {out}, t, row_number() OVER (ORDER BY {cols}, t, event_id) - 1 AS rank FROM ev"


_DEEP = "SELECT t // 2592000000000 * 2592000000000 AS time, event_id AS seq, side AS bs01, cents, qty FROM ev"
_LV = "SELECT event_id, side, lvl, open, close, qty, onqty FROM"
ORACLE_SQL = {
    "level_history": f"WITH {EV}, {LEVELS} {_LV} lv WHERE onqty<>0",
    "level_intervals_coalesced": f"WITH {EV}, {LEVELS}, f AS (SELECT * EXCLUDE close FROM lv WHERE onqty<>0) SELECT event_id, side, lvl, open, lead(open) OVER (PARTITION BY side, lvl ORDER BY open, event_id) AS close, qty, onqty FROM f",
    "snapshot_at": f"WITH {EV}, {LEVELS} SELECT event_id, side, lvl, qty FROM lv WHERE onqty<>0 AND open<={T0} AND (close IS NULL OR close>={T0}) AND (open={T0} OR qty>0)",
    "decoded_flags": f"WITH {EV} SELECT event_id, CASE WHEN side=0 THEN 'b' ELSE 's' END AS side, CASE WHEN qty%3=1 THEN 's' ELSE 'u' END AS type, t*1000 - (t*1000)%10000 AS t_ns FROM ev WHERE qty<>0",
    "asof_inclusive": _asof_sql(">="),
    "asof_strict": _asof_sql(">"),
    "asof_by_user": _asof_sql(">=", "l.user_id=r.user_id AND"),
    "asof_forward": _asof_sql("<="),
    "asof_tolerance": _asof_sql(">=", cond=f"lt - right_time <= {HOUR}"),
    "asof_index": f"WITH {EV}, r AS (SELECT t, row_number() OVER (ORDER BY t)-1 AS k FROM ev WHERE event_type='view') SELECT l.event_id, CAST(coalesce(r.k, -1) AS BIGINT) AS idx FROM (SELECT * FROM ev WHERE event_type='purchase') l ASOF LEFT JOIN r ON l.t >= r.t",
    "asof_index_compat": f"WITH {EV}, r AS (SELECT t, row_number() OVER (ORDER BY t)-1 AS k FROM ev WHERE event_type='view') SELECT l.event_id, CAST(CASE WHEN l.t < (SELECT min(t) FROM r) THEN -1 ELSE coalesce(r.k, 0) END AS BIGINT) AS idx FROM (SELECT * FROM ev WHERE event_type='purchase') l ASOF LEFT JOIN r ON l.t > r.t",
    "hit_times": _hit_sql(),
    "crossings": f"WITH {EV}, g AS (SELECT t, max(cents) AS v FROM ev WHERE event_type='view' GROUP BY t), n AS (SELECT t, v, lead(t) OVER (ORDER BY t) AS next_time, lead(v) OVER (ORDER BY t) AS next_value FROM g) SELECT * FROM n WHERE next_value IS NOT NULL AND sign(v-5000)<>sign(next_value-5000)",
    "nbbo_every_event": f"WITH {_nbbo_sql()} SELECT * FROM al WHERE b_ii<>0 OR s_ii<>0",
    "nbbo_published": f"WITH {_nbbo_sql()}, e AS (SELECT * FROM al QUALIFY row_number() OVER (PARTITION BY time ORDER BY iline DESC)=1), c AS (SELECT *, {_FIELDS} AS f, lag({_FIELDS}) OVER (ORDER BY time) AS lf FROM e) SELECT * EXCLUDE (f, lf) FROM c WHERE lf IS NULL OR f<>lf",
    "nbbo_many_venues": f"WITH {_nbbo_sql(64, _V64)} SELECT * FROM al WHERE b_ii<>0 OR s_ii<>0",
    "nbbo_many_published": f"WITH {_nbbo_sql(64, _V64)}, e AS (SELECT * FROM al QUALIFY row_number() OVER (PARTITION BY time ORDER BY iline DESC)=1), c AS (SELECT *, {_FIELDS} AS f, lag({_FIELDS}) OVER (ORDER BY time) AS lf FROM e) SELECT * EXCLUDE (f, lf) FROM c WHERE lf IS NULL OR f<>lf",
    "nbbo_stats": f"WITH {_nbbo_sql()} SELECT iline, lpad(bin(b_ii), 8, '0') AS bid_mask, CAST(bit_count(s_ii) AS INTEGER) AS ask_venues, CAST(b_ii>>3 & 1 AS INTEGER) AS has3, s_ii - (s_ii & 2) AS without1 FROM al WHERE b_ii<>0 OR s_ii<>0",
    "fob_encode": f"WITH {EV}, x AS ({ENC}) {_text_sql('x')}",
    "fob_roundtrip": f"WITH {EV}, x AS ({ENC}) SELECT time, CAST(bs01 AS INTEGER) AS bs01, CAST(row_number() OVER (PARTITION BY time, bs01 ORDER BY seq) - 1 AS INTEGER) AS pos, price, qty FROM x",
    "book_format": f"WITH {EV}, x AS (SELECT t AS time, event_id AS seq, side AS bs01, cents AS price, qty FROM ev), sn AS (SELECT * FROM x WHERE seq%97=0), up AS (SELECT * FROM x WHERE time NOT IN (SELECT time FROM sn)) {_text_sql('up')} UNION ALL {_text_sql('sn', 's')}",
    "cumulate": f"WITH {EV}, o AS (SELECT side, lvl, qty, t AS t0, CASE WHEN event_id%5<>0 THEN t+cents*1000000 END AS t1 FROM ev WHERE event_type='purchase'), n AS (SELECT side, lvl, time, sum(q) AS q FROM (SELECT side, lvl, t0 AS time, qty AS q FROM o UNION ALL SELECT side, lvl, t1, -qty FROM o WHERE t1 IS NOT NULL) GROUP BY ALL) SELECT side, lvl, time, CAST(sum(q) OVER (PARTITION BY side, lvl ORDER BY time) AS BIGINT) AS cm_qty FROM n",
    "distinct_prices": f"WITH {EV} SELECT side, count(DISTINCT lvl) AS n_levels, count(DISTINCT user_id) AS n_ids, max(lvl) AS max_lvl FROM ev GROUP BY side",
    "counts_by_side": f"WITH {EV} SELECT side, count(*) AS n, CAST(sum(CASE WHEN qty>0 THEN 1 ELSE 0 END) AS BIGINT) AS n_live, CAST(sum(qty) AS BIGINT) AS qty, min(t) AS t_min, max(t) AS t_max FROM ev GROUP BY side",
    "topn_per_side": f"WITH {EV} SELECT event_id, side, cents FROM ev QUALIFY row_number() OVER (PARTITION BY side ORDER BY cents DESC, event_id) <= 10",
    "anti_times": f"WITH {EV} SELECT t, event_id FROM ev WHERE t NOT IN (SELECT t FROM ev WHERE event_id%97=0)",
    "union_books": f"WITH {EV} SELECT event_id, side, lvl FROM ev WHERE side=0 OR (side=1 AND lvl>5)",
    "window_clamp": f"WITH {EV}, {ORDERS} SELECT order_id, greatest(open, {T0}-1000) AS open, least(coalesce(close, {1 << 62}), {T0}+{HOUR * 100}+1000) AS close FROM o WHERE open<={T0}+{HOUR * 100} AND coalesce(close, {1 << 62})>={T0}",
    "time_texts": f"WITH {EV}, x AS (SELECT event_id, t*1000+qty*100 AS ns FROM ev), y AS (SELECT *, strftime(make_timestamp(ns//1000), '%H:%M:%S') AS hms0, rtrim(lpad(CAST(ns%1000000000 AS VARCHAR), 9, '0'), '0') AS fr FROM x) SELECT event_id, CASE WHEN fr='' THEN hms0 ELSE hms0||'.'||fr END AS hms, strftime(make_timestamp(ns//1000), '%Y-%m-%d %H:%M:%S') || '.' || lpad(CAST(ns%1000000000 AS VARCHAR), 9, '0') AS full_text FROM y",
    "sim_time_grid": f"WITH {EV}, c AS (SELECT min(t)*1000 AS t0, count(*) FILTER (event_type='view') AS n FROM ev) SELECT i, CAST(t0 + (i - n//4)*1000000000 AS BIGINT) AS t FROM c, range((SELECT n + n//2 FROM c)) r(i)",
    "snapshot_encode": f"WITH {_H}, x AS (SELECT {T0} AS time, price AS seq, bs01, price, qty FROM h WHERE open<={T0} AND (close IS NULL OR close>={T0}) AND (open={T0} OR qty>0)) {_SORTED}",
    "update_encode": f"WITH {_H}, x AS (SELECT open AS time, price AS seq, bs01, price, qty FROM h WHERE open=(SELECT min(open) FROM h WHERE event_id%397=5)) {_SORTED.replace(chr(39) + 's' + chr(39), chr(39) + 'u' + chr(39), 1)}",
    "book_snapshots": f"WITH {_H}, tm AS (SELECT DISTINCT open AS time FROM h WHERE event_id%397=0), x AS (SELECT tm.time, price AS seq, bs01, price, qty FROM h JOIN tm ON open<=tm.time AND (close IS NULL OR close>=tm.time) AND (open=tm.time OR qty>0)), up AS (SELECT open AS time, price AS seq, bs01, price, qty FROM h WHERE open NOT IN (SELECT time FROM tm)) {_SORTED} UNION ALL {_text_sql('up').replace('ORDER BY seq', 'ORDER BY seq, price, qty')}",
    "depth_close": f"WITH {EV}, o AS (SELECT side, lvl, qty, t AS t0, CASE WHEN event_id%5<>0 THEN t+cents*1000000 END AS t1 FROM ev WHERE event_type='purchase'), n AS (SELECT side, lvl, time, sum(q) AS q FROM (SELECT side, lvl, t0 AS time, qty AS q FROM o UNION ALL SELECT side, lvl, t1, -qty FROM o WHERE t1 IS NOT NULL) GROUP BY ALL) SELECT side, lvl, time, CAST(sum(q) OVER (PARTITION BY side, lvl ORDER BY time) AS BIGINT) AS cm_qty, lead(time) OVER (PARTITION BY side, lvl ORDER BY time) AS ctime FROM n",
    "argsort_side_price_time": _rank_sql("side, lvl", "side, lvl"),
    "argsort_side_price_venue_time": _rank_sql("side, lvl, venue", "side, lvl, venue"),
    "argsort_price_time": _rank_sql("lvl", "lvl"),
    "crossings_above": _CROSS.format(30000, "<="),
    "crossings_below": _CROSS.format(20000, ">="),
    "hits_total": f"SELECT count(*) AS n, CAST(sum(hit) AS BIGINT) AS hits FROM ({_hit_sql()})",
    "scaled_prices": f"WITH {EV} SELECT event_id, CAST(round(CAST(cents AS DECIMAL(18,3)) / 1000, 1) AS DOUBLE) AS price, CAST(round(CAST(qty AS DECIMAL(18,3)) / 10, 0) AS DOUBLE) AS qty FROM ev",
    "participants": f"WITH {EV} SELECT CASE WHEN venue>5 THEN 1 ELSE 0 END AS participant, count(*) AS n FROM ev GROUP BY 1",
    "sql_functions": f"WITH {EV}, x AS (SELECT event_id, qty, venue, t, t*1000+qty*100 AS ns FROM ev), y AS (SELECT *, strftime(make_timestamp(ns//1000), '%H:%M:%S') AS hms0, rtrim(lpad(CAST(ns%1000000000 AS VARCHAR), 9, '0'), '0') AS fr FROM x) SELECT event_id, lpad(bin(qty | (1 << venue)), 8, '0') AS mask, (qty & 2) <> 0 AS has1, qty - (qty & 2) AS without1, t*1000 - (t*1000)%10000 AS t_ns, CASE WHEN fr='' THEN hms0 ELSE hms0||'.'||fr END AS hms, strftime(make_timestamp(ns//1000), '%Y-%m-%d %H:%M:%S') || '.' || lpad(CAST(ns%1000000000 AS VARCHAR), 9, '0') AS full_text FROM y",
    "fob_deep": f"WITH {EV}, x AS ({_DEEP}) SELECT time, CAST(bs01 AS INTEGER) AS bs01, CAST(row_number() OVER (PARTITION BY time, bs01 ORDER BY seq) - 1 AS INTEGER) AS pos, cents AS price, qty, false AS bad FROM x",
    "fob_scales": f"WITH {EV}, x AS ({_DEEP}), p AS (SELECT CASE WHEN cents=0 THEN 0 ELSE length(rtrim(lpad(CAST(cents%1000 AS VARCHAR), 3, '0'), '0')) + 1 END AS n FROM x) SELECT (SELECT count(DISTINCT time) FROM x) AS n_lines, CAST(0 AS BIGINT) AS n_corrupt, (SELECT count(*) FROM x) AS n_levels, CAST(max(n) AS INTEGER) AS price_scale, CAST(0 AS INTEGER) AS qty_scale FROM p",
    "verify_pdiff": _verify_sql(False, False, False, -100),
} | {f"verify_eq{int(e)}_same{int(s)}_touch{int(t)}": _verify_sql(e, s, t) for e, s, t in FLAGS}
ORACLE_SQL |= {"level_history_bucketed": ORACLE_SQL["level_history"], "level_intervals_bucketed": ORACLE_SQL["level_intervals_coalesced"], "cumulate_bucketed": ORACLE_SQL["cumulate"]}

_GAPS = f"{EV}, gp AS (SELECT event_id, event_type, CASE WHEN event_id%13<>0 THEN t END AS t, CAST(nullif(user_id%5, 0) AS BIGINT) AS user_id, cents, side, CAST(nullif(lvl%7, 0) AS BIGINT) AS lvl, qty FROM ev)"
#: A snapshot's times and, plainly, a setting to 0 for each level and snapshot without a row at that time; what changes nothing goes.
_RESETS = f"{EV}, bk AS (SELECT event_id, side, lvl, t // 21600000000 * 21600000000 AS t, qty, CASE WHEN t // 21600000000 % 5 = 0 THEN 1 ELSE 0 END AS us01 FROM ev), sn AS (SELECT DISTINCT t FROM bk WHERE us01=1), lev AS (SELECT side, lvl, min(t) AS t0 FROM bk GROUP BY 1, 2), zero AS (SELECT NULL AS event_id, lev.side, lev.lvl, sn.t, 0 AS qty, 1 AS us01 FROM lev JOIN sn ON sn.t>lev.t0 WHERE NOT EXISTS (SELECT 1 FROM bk WHERE bk.side=lev.side AND bk.lvl=lev.lvl AND bk.t=sn.t)), au AS (SELECT *, lag(qty) OVER (PARTITION BY side, lvl ORDER BY t, event_id) AS was FROM (SELECT * FROM bk UNION ALL SELECT * FROM zero)), kp AS (SELECT * FROM au WHERE event_id IS NOT NULL OR was<>0)"
_STEPS = "g AS (SELECT t, max(cents) AS v FROM ev WHERE event_type='view' GROUP BY t), n AS (SELECT t, v, lead(t) OVER (ORDER BY t) AS next_time, lead(v) OVER (ORDER BY t) AS next_value, row_number() OVER (ORDER BY t) AS k FROM g)"
_TICKS = "lv AS (SELECT DISTINCT lvl*500 AS price FROM ev WHERE event_type='purchase')"
_LIVES = "o AS (SELECT event_id AS order_id, side, lvl, t AS open, CASE WHEN event_id%11<>0 THEN t+(cents-100)*10000000 END AS close FROM ev WHERE event_type='purchase')"


def _violations_sql(eq: bool, same: bool, touch: bool, pdiff: int = 0) -> str:
    found = _verify_sql(eq, same, touch, pdiff)
    return found[: found.index("SELECT o.order_id, o.side")].replace("SELECT o.order_id, min(b.k) AS k", "SELECT o.order_id, b.k AS violation_k").replace(" GROUP BY 1)", ")") + "SELECT * FROM v"


ORACLE_SQL |= {
    "snapshot_resets": f"WITH {_RESETS}, x AS (SELECT event_id, side, lvl, us01, t AS open, lead(t) OVER w AS close, qty, qty - coalesce(lag(qty) OVER w, 0) AS onqty FROM kp WINDOW w AS (PARTITION BY side, lvl ORDER BY t, event_id)) SELECT * FROM x WHERE onqty<>0",
    "snapshot_resets_coalesced": f"WITH {_RESETS}, x AS (SELECT *, qty - coalesce(lag(qty) OVER (PARTITION BY side, lvl ORDER BY t, event_id), 0) AS onqty FROM kp) SELECT event_id, side, lvl, t AS open, lead(t) OVER (PARTITION BY side, lvl ORDER BY t, event_id) AS close, qty FROM x WHERE onqty<>0",
    "crossings_all": f"WITH {EV}, {_STEPS}, {_TICKS} SELECT t, v, next_time, next_value, price FROM n JOIN lv ON sign(v-price)<>sign(next_value-price)",
    "crossings_all_above": f"WITH {EV}, {_STEPS}, {_TICKS} SELECT t, v, next_time, next_value, price FROM n JOIN lv ON sign(v-price)<>sign(next_value-price) OR (k=1 AND v<=price)",
    "crossings_per_price": f"WITH {EV}, {_STEPS}, lv AS (SELECT DISTINCT cents AS price FROM ev WHERE event_type='purchase') SELECT price, count(*) AS n, min(t) AS first_t, max(t) AS last_t FROM n JOIN lv ON sign(v-price)<>sign(next_value-price) GROUP BY 1",
    "violations_all": _violations_sql(False, False, False),
    "violations_all_touch": _violations_sql(True, True, True, -100),
    "orders_while_level": f"WITH {EV}, {LEVELS}, {_LIVES} SELECT o.order_id, lv.event_id, greatest(o.open, lv.open) AS since FROM o JOIN lv ON o.side=lv.side AND o.lvl=lv.lvl AND lv.onqty<>0 AND lv.open < coalesce(o.close, {1 << 62}) AND o.open < coalesce(lv.close, {1 << 62}) AND (lv.close IS NULL OR lv.close>lv.open) AND (o.close IS NULL OR o.close>o.open)",
    "orders_alive_together": f"WITH {EV}, {_LIVES}, p AS (SELECT * FROM o WHERE close IS NULL OR close>open) SELECT a.order_id, count(*) AS n FROM p a JOIN p b ON a.order_id<>b.order_id AND b.open < coalesce(a.close, {1 << 62}) AND a.open < coalesce(b.close, {1 << 62}) GROUP BY 1",
    "fob_encode_runs": "WITH " + EV + ", z AS (SELECT (event_id//3)*7919%4 AS time, event_id AS seq, side AS bs01, cents AS price, qty FROM ev), y AS (SELECT *, CASE WHEN lag(time) OVER (ORDER BY seq) IS DISTINCT FROM time THEN 1 ELSE 0 END AS f FROM z), x AS (SELECT *, CAST(sum(f) OVER (ORDER BY seq ROWS UNBOUNDED PRECEDING) - 1 AS BIGINT) AS run FROM y) " + _text_sql("x").replace("SELECT time AS timestamp", "SELECT run, time AS timestamp", 1) + ", run",
    "fob_faults": f"WITH {EV}, x AS (SELECT event_id AS line_no, event_id%8 AS k, length(CAST(cents AS VARCHAR)) AS c, length('['||cents||', '||qty||']') AS a, length('['||(cents+1)||', '||qty||']') AS b FROM ev) SELECT line_no, CASE WHEN k=7 THEN 'bids' ELSE 'asks' END AS field, CASE k WHEN 1 THEN 'level' WHEN 2 THEN 'comma or end' WHEN 3 THEN 'comma or end' WHEN 4 THEN 'price' WHEN 5 THEN 'nothing' WHEN 6 THEN 'level end' ELSE 'level' END AS kind, CAST(CASE k WHEN 1 THEN 1+a+1 WHEN 2 THEN 1+a+1 WHEN 3 THEN 1+a+1+b WHEN 4 THEN 1+a+3 WHEN 5 THEN 1+a+2 WHEN 6 THEN 1+a+3+c+3 ELSE 1 END AS INTEGER) AS place, CAST(CASE k WHEN 3 THEN 2 WHEN 7 THEN 0 ELSE 1 END AS INTEGER) AS levels FROM x WHERE k<>0",
    "asof_gaps": f"WITH {_GAPS} SELECT l.event_id, l.t, l.user_id, r.event_id AS view_id, r.t AS right_time FROM (SELECT * FROM gp WHERE event_type='purchase') l ASOF LEFT JOIN (SELECT * FROM gp WHERE event_type='view' AND t IS NOT NULL) r ON l.user_id=r.user_id AND l.t >= r.t",
    "history_gaps": f"WITH {_GAPS}, q AS (SELECT * FROM gp WHERE event_id%17<>0), x AS (SELECT event_id, side, lvl, t AS open, lead(t) OVER w AS close, qty, qty - coalesce(lag(qty) OVER w, 0) AS onqty FROM q WINDOW w AS (PARTITION BY side, lvl ORDER BY t NULLS FIRST, event_id)) SELECT * FROM x WHERE onqty<>0",
    "cumulate_gaps": f"WITH {_GAPS}, o AS (SELECT side, lvl, qty, t AS t0, CASE WHEN event_id%5<>0 THEN t+cents*1000000 END AS t1 FROM gp WHERE event_type='purchase'), n AS (SELECT side, lvl, time, sum(q) AS q FROM (SELECT side, lvl, t0 AS time, qty AS q FROM o UNION ALL SELECT side, lvl, t1, -qty FROM o WHERE t1 IS NOT NULL) GROUP BY ALL) SELECT side, lvl, time, CAST(sum(q) OVER (PARTITION BY side, lvl ORDER BY time NULLS FIRST) AS BIGINT) AS cm_qty FROM n",
    "argsort_gaps": f"WITH {_GAPS} SELECT event_id, lvl, t, row_number() OVER (ORDER BY lvl NULLS FIRST, t NULLS FIRST, event_id) - 1 AS rank FROM gp",
    "index_gaps": f"WITH {_GAPS} SELECT event_id, t, row_number() OVER (ORDER BY t NULLS FIRST, event_id) - 1 AS k FROM gp",
}
