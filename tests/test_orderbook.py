"""Goldens of FIXTURES.md and brute force on random rows."""

import random

import pytest

from bookfold.functions import scalar as S
from bookfold.operators import levels as L
from bookfold.operators.asof import asof_join, row_index
from bookfold.operators.nbbo import nbbo
from bookfold.operators.verify import first_violation
from bookfold.sources import fob

LINES = ["timestamp;type;asks;bids", "100;u;[[101.0,4.0]];[[99.9,10.0]]", "200;u;[];[[99.9,10.0]]", "300;s;[[101.0,0.0]];[[99.9,7.5],[99.8,0.0]]"]


def test_fob_parse_and_level_history(spark, tmp_path):
    (tmp_path / "a.txt").write_text("\n".join(LINES))
    book = fob.read_fob(spark, str(tmp_path / "a.txt"), 1, 1)
    rows = book.orderBy("time", "bs01", "pos").collect()
    assert [(r.time, r.us01, r.bs01, float(r.price), float(r.qty)) for r in rows] == [(100, 0, 0, 99.9, 10.0), (100, 0, 1, 101.0, 4.0), (200, 0, 0, 99.9, 10.0), (300, 1, 0, 99.9, 7.5), (300, 1, 0, 99.8, 0.0), (300, 1, 1, 101.0, 0.0)]
    hist = L.level_history(book, ("bs01", "price"), "time", "qty", "line_no").orderBy("bs01", "price", "open").collect()
    assert [(r.bs01, float(r.price), r.open, r.close, float(r.onqty)) for r in hist] == [(0, 99.9, 100, 200, 10.0), (0, 99.9, 300, None, -2.5), (1, 101.0, 100, 300, 4.0), (1, 101.0, 300, None, -4.0)]


def test_malformed_lines_r1_r4_r23_r24(spark):
    lines = ["1;u;[[99.9,10]];[[.123,7.5]]", "2;u;[[1e-5,1]];[]", "3|s|[]|[[1,2]]", "", "4;u;[99,1];[]", "5.5;u;[];[]"]
    rows = fob.parse_lines(spark.createDataFrame(list(enumerate(lines)), "line_no long, value string"), 3, 1).collect()
    assert sorted(r.line_no for r in rows if r.corrupt) == [1, 4, 5]
    assert sorted((r.time, float(r.price), float(r.qty)) for r in rows if not r.corrupt) == [(1, 0.123, 7.5), (1, 99.9, 10.0), (3, 1.0, 2.0)]


def test_encode_r2_r3(spark):
    rows = spark.createDataFrame([(1, 0, 0, 99900, 100), (1, 1, 1, 101000, 40), (2, 2, 0, 99900, 0)], "time long, seq long, bs01 int, price long, qty long")
    out = [tuple(r) for r in fob.encode_updates(rows).orderBy("timestamp").collect()]
    assert out == [(1, "u", "[[101.000,4.0]]", "[[99.900,10.0]]"), (2, "u", "[]", "[[99.900,0]]")]


def test_write_and_read_back(spark, tmp_path):
    rows = spark.createDataFrame([(1, 0, 0, 99900, 100), (2, 1, 1, 101000, 40)], "time long, seq long, bs01 int, price long, qty long")
    fob.write_fob(fob.encode_updates(rows), str(tmp_path / "o"))
    back = fob.read_fob(spark, str(tmp_path / "o"), 3, 1).orderBy("time").collect()
    assert [(r.time, r.bs01, float(r.price), float(r.qty), r.corrupt) for r in back] == [(1, 0, 99.9, 10.0, None), (2, 1, 101.0, 4.0, None)]


@pytest.mark.parametrize("bucket", [1, 2, 1000])
def test_asof_r5(spark, bucket):
    left = spark.createDataFrame([(t,) for t in (6, 4, 7, 5)], "t long")
    right = row_index(spark.createDataFrame([(5, 0), (5, 1), (6, 2)], "t long, s long"), "t", bucket, ["s"])
    got = {r.t: r.k for r in asof_join(left, right, "t", values=("k",), bucket=bucket).collect()}
    assert got == {4: None, 5: 1, 6: 2, 7: 2}
    assert asof_join(left, right.where("false"), "t", values=("k",), bucket=bucket).where("k is null").count() == 4


BARRIER = [(10, 100), (20, 99), (30, 101), (40, 98)]
ORDERS = {"A": ("b", 99.5, 12, 35, 1, 1, 1, 1), "B": ("b", 99.0, 12, 35, 4, 4, 1, 1), "C": ("b", 98.5, 12, 40, 4, 3, 4, 3), "D": ("s", 100.5, 30, 50, 2, 2, 2, 2), "E": ("s", 100.5, 12, 25, 4, 4, 4, 4), "F": ("b", 98.5, 45, 60, 3, 3, 3, 3), "G": ("s", 98.0, 0, 10, 4, 0, 4, 0), "H": ("b", 200.0, 0, 5, 4, 4, 4, 4)}


@pytest.mark.parametrize("eq", [False, True])
@pytest.mark.parametrize("touch", [False, True])
def test_first_violation_goldens_r6_r7_r8(spark, eq, touch):
    o = spark.createDataFrame([(k, *v[:4]) for k, v in ORDERS.items()], "order_id string, side string, price double, open long, close long")
    b = spark.createDataFrame([(t, float(p), float(p)) for t, p in BARRIER], "t long, nbb double, nbo double")
    got = {r.order_id: r.first_violation_k for r in first_violation(o, b, eqstate=eq, timetouch=touch, bucket=7).collect()}
    assert got == {k: v[4 + 2 * eq + touch] for k, v in ORDERS.items()}


def test_first_violation_random(spark):
    rnd = random.Random(5)
    n = 600
    rows = [(i * 3 + rnd.randint(0, 2), rnd.randint(0, 60), rnd.randint(0, 60)) for i in range(n)]
    orders = [(i, rnd.choice("bs"), rnd.choice([0, 1, 30, 59, 60]), a := rnd.randint(-5, 3 * n), rnd.choice([None, a + rnd.randint(0, 900)])) for i in range(300)]
    b = spark.createDataFrame(rows, "t long, nbb long, nbo long")
    o = spark.createDataFrame(orders, "order_id long, side string, price long, open long, close long")
    got = {r.order_id: r.first_violation_k for r in first_violation(o, b, pdiff=-1, sameside=True, timetouch=True, bucket=100).collect()}
    for i, side, p, lo, hi in orders:
        want = n
        for k, (t, bid, offer) in enumerate(rows):
            nxt = rows[k + 1][0] if k + 1 < n else None
            if (hi is None or t <= hi) and (nxt is None or nxt >= lo) and (p - 1 > bid if side == "b" else p + 1 < offer):
                want = k
                break
        assert got[i] == want, (i, side, p, lo, hi)
    assert first_violation(o, b.where("false")).where("first_violation_k <> 0").count() == 0


QUOTES = [(0, 1, 0, 100, 5, 0, 102, 5), (1, 1, 1, 100, 3, 1, 101, 2), (2, 2, 0, 99, 4, 1, 0, 0), (3, 3, 2, 98, 1, 2, 103, 1), (4, 4, 1, 0, 0, 2, 103, 2)]


@pytest.mark.parametrize("bucket", [1, 2, 100])
def test_nbbo_goldens_r11(spark, bucket):
    q = spark.createDataFrame(QUOTES, "iline long, t long, bv int, bp long, bq long, sv int, sp long, sq long")
    names = ["time", "nbb", "nbo", "nbbq", "nboq", "b_ii", "s_ii", "iline", "num_b", "num_s"]
    got = [tuple(r) for r in nbbo(q, 3, bucket=bucket).select(*names).orderBy("time").collect()]
    assert got == [(1, 100, 101, 8, 2, 3, 2, 1, 2, 1), (2, 100, 102, 3, 5, 2, 1, 2, 1, 1), (4, 99, 102, 4, 5, 1, 1, 4, 1, 1)]
    assert nbbo(q, 3, "every_event", bucket).count() == 5


def test_streaming_nbbo_equals_batch(spark, tmp_path):
    from bookfold.streaming.nbbo import consolidate

    schema = "iline long, t long, bv int, bp long, bq long, sv int, sp long, sq long"
    for k, part in enumerate((QUOTES[:2], QUOTES[2:])):
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(str(tmp_path / "in" / f"p{k}"))
    got = []
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    consolidate(stream, 3, str(tmp_path / "state"), lambda rows, _: got.extend(rows.collect()), str(tmp_path / "cp")).awaitTermination(120)
    want = nbbo(spark.createDataFrame(QUOTES, schema), 3, "every_event").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want))


def test_scalars_r15_r21_r26(spark):
    df = spark.createDataFrame([(0, 0), (1_704_360_798_696_207_100, 40), (1_704_360_000_000_000_000, 99900)], "ns long, p long")
    rows = df.select(S.hms_text(df.ns).alias("h"), S.time_text(df.ns).alias("t"), S.decimal_text(df.p, 3).alias("d"), S.mask_text(S.set_bit(df.p, 0), 8).alias("m"), S.clear_bit(df.p, 1).alias("c")).collect()
    assert rows[0].h == "00:00:00" and rows[0].d == "0" and rows[0].c == 0
    assert rows[1].h == "09:33:18.6962071" and rows[1].t == "2024-01-04 09:33:18.696207100" and rows[1].d == "0.040" and rows[1].m == "00101001"


def test_registry_matches_sql():
    from bookfold.plans import registry

    assert set(registry.ORACLE_SQL) <= set(registry.QUERIES)


def test_sim_orders_hold_their_invariants(spark):
    from bookfold.operators.simulate import fake_book, fake_orders

    o = fake_orders(spark, 200, 200)
    rows = o.collect()
    assert rows and all(r.open <= r.close and r.side in "bs" and 0 <= r.venue < 10 for r in rows)
    assert sorted(map(tuple, rows)) == sorted(map(tuple, fake_orders(spark, 200, 200).collect()))
    assert fake_book(o).where("cm_qty < 0").count() == 0


def test_deep_lines_bad_numbers_and_blind_header(spark, tmp_path):
    import gzip

    deep = "[" + ",".join(f"[{i}.5,{i}]" for i in range(10_000)) + "]"
    lines = ["any;header;at;all", f"1;u;{deep};{deep}", "99999999999999999999;u;[];[]", "9999999999999999999;u;[];[]", "2;u;[[123456789012345678.5,1]];[]", "timestamp;u;[];[]", "3;s;[[1.25,2]];[]", "4;u;" + "[" * 100_000 + ";[]"]
    for k in range(2):
        with gzip.open(tmp_path / f"{k}.csv.gz", "wt") as out:
            out.write("\n".join(lines) + "\n")
    rows = fob.read_fob(spark, str(tmp_path), qty_scale=0)
    assert dict(rows.dtypes)["price"] == "decimal(15,2)"
    got = rows.collect()
    assert sum(r.corrupt is not None for r in got) == 10
    assert sum(r.corrupt is None for r in got) == 2 * (20_000 + 1)
    assert max(r.pos for r in got if r.time == 1) == 9999


def test_first_violation_of_repeated_ids_and_any_names(spark):
    o = spark.createDataFrame([(1, "b", 98.0, 0, 50, 7), (1, "b", 200.0, 0, 50, 8), (None, "buy", 200.0, 0, 50, 9)], "order_id int, side string, price double, open long, close long, k int")
    b = spark.createDataFrame([(10, 100.0, 100.0), (20, 99.0, 99.0)], "t long, nbb double, nbo double")
    got = {r.k: (r.order_id, r.first_violation_k) for r in first_violation(o, b).collect()}
    assert got == {7: (1, 2), 8: (1, 0), 9: (None, 0)}


def test_nbbo_refuses_venues_out_of_range(spark):
    q = spark.createDataFrame([(1, 1, 3, 100, 1, 0, 101, 1)], "iline long, t long, bv int, bp long, bq long, sv int, sp long, sq long")
    with pytest.raises(Exception, match="not a venue"):
        nbbo(q, 3).collect()


def test_nbbo_equals_the_state_of_each_venue_f16(spark):
    rnd = random.Random(3)
    rows = [(i, i // 2, rnd.randrange(5), rnd.choice([0, 98, 99, 100]), rnd.randint(0, 3), rnd.randrange(5), rnd.choice([0, 101, 102]), rnd.randint(0, 3)) for i in range(400)]
    got = {r.iline: r for r in nbbo(spark.createDataFrame(rows, "iline long, t long, bv int, bp long, bq long, sv int, sp long, sq long"), 5, "every_event", 37).collect()}
    state = [{}, {}]
    for i, _, bv, bp, bq, sv, sp, sq in rows:
        state[0][bv], state[1][sv] = (bp, bq if bp > 0 else 0), (sp, sq if sp > 0 else 0)
        live = [{v: x for v, x in s.items() if x[1] > 0} for s in state]
        if not live[0] and not live[1]:
            assert i not in got
            continue
        for s, pick, p, q, m, n in ((live[0], max, "nbb", "nbbq", "b_ii", "num_b"), (live[1], min, "nbo", "nboq", "s_ii", "num_s")):
            best = pick((x[0] for x in s.values()), default=0)
            at = [v for v in s if s[v][0] == best]
            assert (got[i][p], got[i][q], got[i][m], got[i][n]) == (best, sum(s[v][1] for v in at), sum(1 << v for v in at), len(at))


def test_crossings_with_their_start_f15(spark):
    from bookfold.operators.verify import level_crossings

    for values in ([3, 4], [5, 5, 6, 4, 5, 7], [7, 3]):
        series = spark.createDataFrame(list(enumerate(values)), "t long, v long")
        for start in (None, "above", "below"):
            got = sorted(r.t for r in level_crossings(series, 5, bucket=2, start=start).collect())
            sign = lambda x: (x > 5) - (x < 5)
            want = {i for i in range(len(values) - 1) if sign(values[i]) != sign(values[i + 1])}
            if start == "above" and values[0] <= 5 or start == "below" and values[0] >= 5:
                want.add(0)
            assert got == sorted(want)


@pytest.mark.parametrize("bucket", [None, 1, 7, 1000])
def test_history_and_depth_by_bucket(spark, bucket):
    rnd = random.Random(4)
    rows = [(i, rnd.randrange(2), rnd.randrange(3), rnd.randrange(60), rnd.randrange(3)) for i in range(300)]
    book = spark.createDataFrame(rows, "seq long, side int, price int, time long, qty long")
    for merge in (False, True):
        got = sorted((r.seq, r.open, r.close, r.onqty) for r in L.level_history(book, coalesce_intervals=merge, bucket=bucket).collect())
        want = []
        for level in {r[1:3] for r in rows}:
            own = sorted((r[3], r[0], r[4]) for r in rows if r[1:3] == level)
            told = [(s, t, own[k + 1][0] if k + 1 < len(own) else None, q - (own[k - 1][2] if k else 0)) for k, (t, s, q) in enumerate(own)]
            kept = [x for x in told if x[3]]
            want += [(s, t, kept[k + 1][1] if k + 1 < len(kept) else None, q) for k, (s, t, _, q) in enumerate(kept)] if merge else kept
        assert got == sorted(want)
    orders = spark.createDataFrame([(r[1], r[2], r[4], r[3], r[3] + 5 if r[0] % 3 else None) for r in rows], "side int, price int, qty long, t0 long, t1 long")
    assert sorted(map(tuple, L.cumulate(orders, bucket=bucket).collect())) == sorted(map(tuple, L.cumulate(orders).collect()))


def test_streamed_history_equals_batch(spark, tmp_path):
    from bookfold.streaming.levels import open_levels, stream_history

    rnd = random.Random(5)
    rows = [(i, rnd.randrange(2), rnd.randrange(3), i // 2, rnd.randrange(3)) for i in range(90)]
    schema = "seq long, side int, price int, time long, qty long"
    for k in range(3):
        spark.createDataFrame(rows[30 * k : 30 * k + 30], schema).coalesce(1).write.parquet(str(tmp_path / "in" / f"p{k}"))
    got = []
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    stream_history(stream, str(tmp_path / "state"), lambda out, _: got.extend(out.select("seq", "open", "close", "onqty").collect()), str(tmp_path / "cp")).awaitTermination(120)
    got += open_levels(spark.read.parquet(str(tmp_path / "state" / "2"))).select("seq", "open", "close", "onqty").collect()
    want = L.level_history(spark.createDataFrame(rows, schema)).select("seq", "open", "close", "onqty").collect()
    key = lambda r: tuple(map(str, r))
    assert sorted(map(key, got)) == sorted(map(key, want))


def test_simulated_orders_meet_their_limits(spark):
    from bookfold.operators.simulate import SECOND, fake_orders, hit_counts, mid_price

    o = fake_orders(spark, 150, 100)
    assert len(o.columns) == 16
    mids = [(r.t, r.mid) for r in mid_price(spark, 1_700_000_000 * SECOND, 100, int(1.53 * SECOND)).orderBy("t").collect()]
    start, end = 1_700_000_000 * SECOND, 1_700_000_000 * SECOND + 100 * int(1.53 * SECOND)
    rows = o.collect()
    assert sum(r.hits for r in hit_counts(o).collect()) == sum(r.hit for r in rows) > 0
    for r in rows:
        assert r.price == r.mid_open - r.sign * abs(r.mid_open - r.price) and 0 <= r.v_b <= abs(r.price - r.mid_open) <= r.v_c
        if not start <= r.open:
            continue
        near = r.price + r.sign * r.v_b
        far = r.price + r.sign * r.v_c
        held = [(t, m) for k, (t, m) in enumerate(mids) if t < r.sim_close and (k + 1 == len(mids) or mids[k + 1][0] > r.open)]
        bad = next((t for t, m in held if (m - near) * r.sign < 0 or (m - far) * r.sign > 0), None)
        assert r.hit == int(bad is not None and r.open <= bad < r.sim_close)
        assert r.close <= end + 1000 and (r.hit == 0 or r.close <= bad)
    safe = fake_orders(spark, 20, 100, safe=True).where("hit = 0").groupBy("side").count().collect()
    assert all(r["count"] >= 0 for r in safe)
