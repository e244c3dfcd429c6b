"""Interval joins, all violations, all crossings, snapshot resets, runs and nulls against plain versions."""

import random
from collections import Counter

import pytest

from bookfold.operators import intervals, verify
from bookfold.operators import nbbo as nbbo_module
from bookfold.operators.asof import asof_join, row_index
from bookfold.operators.intervals import interval_join
from bookfold.operators.levels import argsort, cumulate, level_history, run_numbers
from bookfold.operators.verify import all_crossings, all_violations, first_violation
from bookfold.sources.fob import encode_runs

EVER = 10**9


def some_intervals(rnd, n, keys=(1, 2, None)):
    rows = []
    for i in range(n):
        a = rnd.choice([None, *range(40)])
        rows.append((i, rnd.choice(keys), a, rnd.choice([None, *range(45)])))
    return rows + [rows[-1], rows[0]]


@pytest.mark.parametrize("bins", [1, 256])
def test_interval_join_equals_all_pairs(spark, monkeypatch, bins):
    monkeypatch.setattr(intervals, "BIN", bins)
    rnd = random.Random(bins)
    left, right = some_intervals(rnd, 60), some_intervals(rnd, 60)
    schema = "left int, k int, open long, close long"
    got = interval_join(spark.createDataFrame(left, schema), spark.createDataFrame(right, schema), by=("k",), bucket=7)
    got = Counter((r.left["left"], r.right["left"]) for r in got.collect())

    def good(x):
        return x[1] is not None and x[2] is not None and (x[3] is None or x[3] > x[2])

    end = lambda x: EVER if x[3] is None else x[3]
    want = Counter((x[0], y[0]) for x in left for y in right if good(x) and good(y) and x[1] == y[1] and y[2] < end(x) and x[2] < end(y))
    assert got == want and len(want) > 40
    free = interval_join(spark.createDataFrame(left, schema), spark.createDataFrame(right, schema).where("false"), bucket=7)
    assert free.count() == 0


@pytest.mark.parametrize("length", [3, 40, 1100])
def test_bins_follow_the_ranges(spark, monkeypatch, length):
    # ranges of 3 met a bin of 256 each, long ones a bin more with every 256 ranks: pieces that grew with the pairs
    monkeypatch.setattr(intervals, "PAIRS", 200)
    rnd = random.Random(length)
    ranges = [(1, i, a := rnd.randrange(10**6), a + rnd.randrange(1, 2 * length)) for i in range(90)]
    pieces, width = intervals._in_pieces(spark.createDataFrame(ranges, "k0 int, row int, a long, b long"), ["k0"])
    pairs = sum(r[3] - r[2] for r in ranges)
    got = pieces.collect()
    assert sum(len(range(max(r.a, r.bin * width), min(r.b, (r.bin + 1) * width))) for r in got) == pairs
    assert len(got) <= (2 * intervals.TOUCHED + 2) * len(ranges) and len(got) * width <= pairs * 9 / 8
    assert pieces.rdd.getNumPartitions() == pairs // 200 or length == 3


def test_interval_join_in_wide_bins(spark, monkeypatch):
    monkeypatch.setattr(intervals, "PAIRS", 500)
    seen = []
    pieces_of = intervals._in_pieces
    monkeypatch.setattr(intervals, "_in_pieces", lambda *a: seen.append(pieces_of(*a)) or seen[-1])
    rnd = random.Random(5)
    left = [(i, a := rnd.randrange(400), rnd.choice([None, a + rnd.randrange(300)])) for i in range(80)]
    right = [(i, a := rnd.randrange(400), a + rnd.randrange(1, 90)) for i in range(500)]
    schema = "id int, open long, close long"
    got = interval_join(spark.createDataFrame(left, schema), spark.createDataFrame(right, schema), bucket=50)
    end = lambda x: EVER if x[2] is None else x[2]
    want = Counter((x[0], y[0]) for x in left for y in right if x[1] < end(x) and y[1] < end(x) and x[1] < end(y))
    assert Counter((r.left.id, r.right.id) for r in got.collect()) == want and len(want) > 10000
    pieces, width = seen[0]  # right rows that start in left ones; the other part has few pairs
    assert 1 < width < 256 and pieces.rdd.getNumPartitions() > 4


def test_all_violations_equal_a_nested_loop(spark, monkeypatch):
    monkeypatch.setattr(verify, "FEW", 3)
    rnd = random.Random(8)
    barrier = [(t, v := rnd.randrange(50), v + 5) for t in sorted(rnd.sample(range(400), 90))]
    orders = [(rnd.randrange(40), rnd.choice("bs"), rnd.randrange(60), a := rnd.randrange(-20, 420), rnd.choice([None, a + rnd.randrange(150)])) for _ in range(80)]
    df, bar = spark.createDataFrame(orders, "order_id int, side string, price int, open long, close long"), spark.createDataFrame(barrier, "t long, nbb int, nbo int")
    for eq, same, touch in ((False, False, False), (True, True, True)):
        want = Counter()
        for o in orders:
            for k, (t, bid, ask) in enumerate(barrier):
                nxt = barrier[k + 1][0] if k + 1 < len(barrier) else None
                alive = (o[4] is None or t < o[4] or touch and t == o[4]) and (nxt is None or nxt > o[3] or touch and nxt == o[3])
                at = (bid if same else ask) if o[1] == "b" else (ask if same else bid)
                diff = o[2] - at if o[1] == "b" else at - o[2]
                if alive and (diff > 0 or eq and diff == 0):
                    want[(*o, k)] += 1
        got = Counter(tuple(r) for r in all_violations(df, bar, 0, eq, same, touch, 50).collect())
        assert got == want
        assert len(want) > 150
        first = {}
        for *o, k in want:
            first[tuple(o)] = min(k, first.get(tuple(o), k))
        found = {tuple(r[:5]): r[5] for r in first_violation(df, bar, 0, eq, same, touch, 50).collect()}
        assert all(found[tuple(o)] == first.get(tuple(o), len(barrier)) for o in orders)
    assert all_violations(df, bar.where("false")).count() == 0


@pytest.mark.parametrize("start", [None, "above", "below"])
def test_all_crossings_equal_a_nested_loop(spark, monkeypatch, start):
    monkeypatch.setattr(verify, "BLOCK", 4)
    rnd = random.Random(3)
    series = [(t, rnd.randrange(30)) for t in sorted(rnd.sample(range(500), 50))]
    series[10] = (series[10][0], series[11][1])
    prices = rnd.sample(range(-5, 40), 25)
    rows = [*series, (None, 5), (7000, None)]
    got = sorted(tuple(r) for r in all_crossings(spark.createDataFrame(rows, "t long, v long"), spark.createDataFrame([(p,) for p in prices + prices[:3] + [None]], "price long"), start=start, bucket=40, width=6).collect())
    want = []
    for i, (t, v) in enumerate(series):
        t2, w = series[i + 1] if i + 1 < len(series) else (None, None)
        for p in prices:
            sign = lambda x: (x > p) - (x < p)
            first = i == 0 and (start == "above" and v <= p or start == "below" and v >= p)
            if w is not None and sign(v) != sign(w) or first:
                want.append((t, v, t2, w, p))
    assert got == sorted(want)
    with pytest.raises(ValueError):
        all_crossings(spark.createDataFrame(rows, "t long, v long"), spark.createDataFrame([(1,)], "price long"), start="up")


def plain_history(rows):
    """Settings (side, price, time, qty, seq, us01), level by level, with what snapshots end."""
    snaps = sorted({r[2] for r in rows if r[5] == 1})
    out = []
    for key in {r[:2] for r in rows}:
        own = sorted((r[2], r[4], r[3]) for r in rows if r[:2] == key)
        times = {t for t, _, _ in own}
        said, was = [], 0
        for t, s, q in sorted([*own, *[(t, -1, None) for t in snaps if t not in times and t > own[0][0]]]):
            if q is None and was == 0:
                continue
            was = q or 0
            said.append((t, None if q is None else s, was))
        for i, (t, s, q) in enumerate(said):
            change = q - (said[i - 1][2] if i else 0)
            if change:
                out.append((*key, s, t, said[i + 1][0] if i + 1 < len(said) else None, q, change))
    return out


def order(rows):
    return sorted(rows, key=lambda r: [(x is not None, x if x is not None else 0) for x in r])


@pytest.mark.parametrize("bucket", [None, 9])
def test_snapshots_end_the_levels_they_lack(spark, bucket):
    rnd = random.Random(6)
    kinds = {t: int(t % 4 == 0) for t in range(60)}
    rows = [(rnd.choice("bs"), rnd.randrange(6), t := rnd.randrange(60), rnd.randrange(3), i, kinds[t]) for i in range(150)]
    book = spark.createDataFrame(rows, "side string, price int, time long, qty int, seq int, us01 int")
    got = [(r.side, r.price, r.seq, r.open, r.close, r.qty, r.onqty) for r in level_history(book, bucket=bucket, snapshot_resets=True).collect()]
    assert order(got) == order(plain_history(rows)) and any(g[2] is None for g in got)
    plain = [(r.seq, r.open, r.close) for r in level_history(book, bucket=bucket).collect()]
    none = [(r.seq, r.open, r.close) for r in level_history(book.where("us01 = 0"), bucket=bucket, snapshot_resets=True).collect()]
    assert order(none) == order((r.seq, r.open, r.close) for r in level_history(book.where("us01 = 0")).collect()) and len(plain) > 0


def test_buckets_keep_rows_with_nulls(spark):
    rnd = random.Random(1)
    rows = [(rnd.choice(["b", "s", None]), rnd.choice([1, 2, None]), rnd.choice([None, *range(30)]), rnd.choice([0, 1, 2, None]), i) for i in range(120)]
    book = spark.createDataFrame(rows, "side string, price int, time long, qty int, seq int")
    for options in ({}, {"coalesce_intervals": True}):
        a, b = (order(tuple(r) for r in level_history(book, bucket=x, **options).collect()) for x in (None, 5))
        assert a == b and any(r[0] is None for r in a) and any(r[2] is None for r in a)
    deep = book.selectExpr("side", "price", "coalesce(qty, 1) as qty", "time as t0", "time + 5 as t1")
    a, b = (order(tuple(r) for r in cumulate(deep, bucket=x).collect()) for x in (None, 5))
    assert a == b and len(a) == len({r[:3] for r in a})
    ranks = argsort(book).collect()
    assert sorted(r["rank"] for r in ranks) == list(range(120))
    last = lambda x: (x is not None, x or 0)
    want = sorted(rows, key=lambda r: ((r[0] is not None, r[0] or ""), last(r[1]), last(r[2]), r[4]))
    assert [r.seq for r in sorted(ranks, key=lambda r: r["rank"])] == [r[4] for r in want]
    assert sorted(r.k for r in row_index(book, "time", 4, ("seq",)).collect()) == list(range(120))


@pytest.mark.parametrize("by", [(), ("k",)])
def test_asof_join_keeps_every_left_row(spark, by):
    rnd = random.Random(2)
    left = [(i, rnd.choice([1, 2, None]), rnd.choice([None, *range(50)]), 9) for i in range(80)] * 2
    right = [(rnd.choice([1, 2, None]), rnd.choice([None, *range(50)]), 100 + i) for i in range(40)]
    l, r = spark.createDataFrame(left, "id int, k int, t long, v int"), spark.createDataFrame(right, "k int, t long, v int")
    got = Counter(tuple(x) for x in asof_join(l, r, "t", by, ("v",), bucket=6).select("id", "k", "t", "v", "right_time").collect())
    want = Counter()
    for i, k, t, _ in left:
        fit = [(b, v) for a, b, v in right if t is not None and b is not None and b <= t and (not by or a is not None and a == k)]
        b, v = max(fit, default=(None, None))
        want[(i, k, t, v, b)] += 1
    assert got == want
    if not by:
        odd = asof_join(l.withColumnsRenamed({"id": "p", "k": "b", "v": "in"}), r, bucket=6)
        assert odd.columns == ["p", "b", "t", "in", "right_time", "v"] and odd.count() == len(left)


def test_runs_of_unsorted_times(spark):
    rnd = random.Random(4)
    rows = [(rnd.choice([5, 7, None]), i, i % 2, 10 + i, i % 3) for i in range(90)] + [(7, 200 + i, 0, 1, 1) for i in range(50)]
    df = spark.createDataFrame(rows, "time long, seq long, bs01 int, price long, qty long").repartition(3)
    runs, run = {}, -1
    for i, r in enumerate(rows):
        run += i == 0 or rows[i - 1][0] != r[0]
        runs[r[1]] = run
    for bucket in (7, 1000):
        assert {r.seq: r.run for r in run_numbers(df, bucket=bucket).collect()} == runs
    lines = encode_runs(df, 0, 0, bucket=7).orderBy("run").collect()
    assert [r.run for r in lines] == list(range(run + 1))
    for r in lines:
        own = [x for x in rows if runs[x[1]] == r.run]
        assert r.timestamp == own[0][0]
        assert r.bids == "[" + ",".join(f"[{x[3]},{x[4]}]" for x in own if x[2] == 0) + "]"


@pytest.mark.parametrize("mode", ["every_event", "published"])
def test_nbbo_as_streams_equals_windows(spark, monkeypatch, mode):
    rnd = random.Random(12)
    price = lambda: rnd.choice([None, 0, *range(95, 105)])
    rows = [(rnd.choice([None, *range(40)]), i, rnd.choice([None, *range(10)]), price(), rnd.choice([None, 0, -1, 3, 7]), rnd.choice([None, *range(10)]), price(), rnd.choice([None, 0, 2, 5])) for i in range(160)]
    quotes = spark.createDataFrame(rows, "t long, iline long, bv int, bp long, bq long, sv int, sp long, sq long")
    found = []
    for few in (16, 0):
        monkeypatch.setattr(nbbo_module, "FEW", few)
        found.append(order(tuple(r) for r in nbbo_module.nbbo(quotes, 10, mode, 6).select("time", "nbb", "nbo", "nbbq", "nboq", "b_ii", "s_ii", "iline", "num_b", "num_s").collect()))
    assert found[0] == found[1] and len(found[0]) > 20
    assert nbbo_module.nbbo(quotes.where("false"), 64, mode, 6).count() == 0


def test_overlaps_are_counted_without_pairs(spark, monkeypatch):
    rnd = random.Random(12)
    rows = some_intervals(rnd, 80)
    df = spark.createDataFrame(rows, "id int, k int, open long, close long")
    good = [r for r in rows if r[2] is not None and (r[3] is None or r[3] > r[2])]
    end = lambda x: EVER if x[3] is None else x[3]
    for by in ((), ("k",)):
        live = [r for r in good if not by or r[1] is not None]
        want = Counter((*x, sum(y[2] < end(x) and x[2] < end(y) and (not by or x[1] == y[1]) for y in live)) for x in live)
        assert Counter(tuple(r) for r in intervals.overlap_counts(df, by=by, bucket=7).collect()) == want
        assert len(want) > 15
    # the query: ids that repeat, never a join that makes the pairs
    from bookfold.plans import registry

    again = [(r[0] % 50 if r[0] else None, *r[2:]) for r in rows]
    monkeypatch.setattr(registry, "ev", lambda *_: df)
    monkeypatch.setattr(registry, "_lives", lambda _: spark.createDataFrame(again, "order_id int, open long, close long"))
    monkeypatch.setattr(registry, "interval_join", None)
    live = [r for r in again if r[0] is not None and r[1] is not None and (r[2] is None or r[2] > r[1])]
    ends = lambda x: EVER if x[2] is None else x[2]
    pairs = Counter(x[0] for x in live for y in live if x[0] != y[0] and y[1] < ends(x) and x[1] < ends(y))
    assert {r.order_id: r.n for r in registry.orders_alive_together(spark, "").collect()} == dict(pairs)


@pytest.mark.parametrize("search", [first_violation, all_violations])
def test_the_plan_of_violations_grows_with_the_levels(spark, monkeypatch, search):
    monkeypatch.setattr(verify, "FEW", 3)
    barrier = spark.createDataFrame([(t, t % 7, t % 7 + 5) for t in range(300)], "t long, nbb int, nbo int")
    orders = spark.createDataFrame([(1, "b", 11, 3, 250), (2, "s", 1, 299, None)], "order_id int, side string, price int, open long, close long")
    found = search(orders, barrier, bucket=50)
    # four levels; twice as many joins for each once made 127 of them
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Join ") <= 8
    assert found.count() == (2 if search is first_violation else 212 + 1)


@pytest.mark.parametrize("width, few", [(4, 0), (16, 1 << 18), (1 << 16, 1 << 18)])
def test_a_violation_that_is_listed_costs_no_join(spark, monkeypatch, width, few):
    # each level of the tree had a join that rows in the making went through
    for name, value in {"FEW": few, "LIST": width, "LEAST": 1, "LEAVES": 600}.items():
        monkeypatch.setattr(verify, name, value)
    rnd = random.Random(width)
    barrier = [(t, rnd.choice([None, float(v := rnd.randrange(40))]), float(v + 3)) for t in range(0, 600, 2)]
    orders = [(rnd.choice(["b", "Sell", None]), rnd.choice([None, *map(float, range(15, 30))]), a := rnd.randrange(620), rnd.choice([None, a + rnd.randrange(300)])) for _ in range(60)]
    df = spark.createDataFrame(orders + orders[:2], "side string, price double, open long, close long")
    got = all_violations(df, spark.createDataFrame(barrier, "t long, nbb double, nbo double"), 1, eqstate=True, bucket=50)
    assert got._jdf.queryExecution().optimizedPlan().toString().count("Join ") == 2
    want = Counter()
    for side, price, start, close in orders + orders[:2]:
        for k, (t, bid, ask) in enumerate(barrier):
            alive = (close is None or t < close) and (k + 1 == len(barrier) or barrier[k + 1][0] > start) and (close is None or close > start or t < start)
            value = ask if side == "b" else bid
            if alive and None not in (price, value) and (price + 1 >= value if side == "b" else price - 1 <= value):
                want[(side, price, start, close, k)] += 1
    assert Counter(tuple(r) for r in got.collect()) == want and len(want) > 1000
