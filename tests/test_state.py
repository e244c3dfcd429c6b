"""Streams kept in the state store: rows out of order, late and repeated, equal the batch results."""

import random
from collections import Counter

from bookfold.operators.levels import level_history
from bookfold.operators.nbbo import nbbo
from bookfold.streaming.state import stateful_history, stateful_nbbo

SECOND = 1_000_000


def batches(rows, each, reach, rnd):
    """Rows in order of time, each moved by less than ``reach``, in batches; the first of a batch come again in the next."""
    moved = sorted(rows, key=lambda r: r[0] + rnd.randrange(reach))
    parts = [moved[i : i + each] for i in range(0, len(moved), each)]
    return [p + (parts[i - 1][:3] if i else []) for i, p in enumerate(parts)]


def run(spark, make, parts, schema, tmp_path, name):
    folder = tmp_path / "in"
    for i, part in enumerate(parts):
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(str(folder / f"{i:03d}"))
        for f in (folder / f"{i:03d}").glob("*.parquet"):
            import os

            os.utime(f, (1_600_000_000 + i, 1_600_000_000 + i))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(folder))
    q = make(stream).writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    assert q.awaitTermination(200)
    return spark.table(name)


def test_nbbo_out_of_order(spark, tmp_path):
    rnd = random.Random(1)
    quotes = [((i // 2 + 1) * SECOND, i, rnd.choice("ab"), rnd.choice([None, 0, 1, 63]), rnd.randrange(95, 100), rnd.choice([0, 1, 2]), rnd.choice([None, 0, 2]), rnd.randrange(98, 104), rnd.choice([0, 1, 5])) for i in range(120)]
    schema = "t long, iline long, symbol string, bv int, bp long, bq long, sv int, sp long, sq long"
    # the last ones are so late that all before are settled; one comes too late
    parts = batches(quotes, 30, 8 * SECOND, rnd)
    end = [(1000 * SECOND, 900 + k, s, None, 0, 0, None, 0, 0) for k, s in enumerate("ab")]
    parts += [end, [(5 * SECOND, 500, "a", 0, 500, 9, 0, 1, 9)], [(2000 * SECOND, 990 + k, s, None, 0, 0, None, 0, 0) for k, s in enumerate("ab")]]
    got = run(spark, lambda s: stateful_nbbo(s, delay="20 seconds"), parts, schema, tmp_path, "nbbo_state")
    columns = ["time", "nbb", "nbo", "nbbq", "nboq", "b_ii", "s_ii", "iline", "num_b", "num_s"]
    found = {s: Counter(tuple(r) for r in got.where(f"symbol = '{s}' and time < 1000000000").select(*columns).collect()) for s in "ab"}
    for s in "ab":
        own = spark.createDataFrame([q for q in quotes if q[2] == s], schema).drop("symbol")
        assert found[s] == Counter(tuple(r) for r in nbbo(own, 64, "every_event").select(*columns).collect()) and len(found[s]) > 20


def test_history_out_of_order(spark, tmp_path):
    rnd = random.Random(2)
    rows = [(SECOND + i * SECOND // 3, rnd.choice("bs"), rnd.randrange(3), rnd.choice([0, 1, 2, None]), i) for i in range(150)]
    schema = "time long, side string, price int, qty long, seq long"
    parts = batches(rows, 30, 9 * SECOND, rnd)
    got = run(spark, lambda s: stateful_history(s, delay="15 seconds"), parts, schema, tmp_path, "history_state")
    total = Counter()
    for r in got.collect():
        total[(r.side, r.price, r.seq, r.open, r.close, r.qty, r.onqty)] += r.sign
    want = level_history(spark.createDataFrame(rows, schema)).collect()
    assert {k: n for k, n in total.items() if n} == {(r.side, r.price, r.seq, r.open, r.close, r.qty, r.onqty): 1 for r in want}
    assert got.where("sign < 0").count() > 10
