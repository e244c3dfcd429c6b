"""The fob format against the native reader."""

import gzip
import os
import random

import pytest

from bookfold.sources import datasource
from bookfold.sources.fob import read_fob

FIELDS = ["time", "us01", "bs01", "pos", "price", "qty", "corrupt"]


def text(rnd, n, swap=False):
    lines = ["timestamp;type;asks;bids"]
    for i in range(n):
        a, b = ("[" + ", ".join(f"[{rnd.randrange(10**rnd.randint(1, 5))}.{rnd.randrange(1000)},{rnd.randrange(50)}]" for _ in range(rnd.randint(0, 4))) + "]" for _ in range(2))
        lines.append(f"{1000 + i};{rnd.choice(['u', 'S', 'x', 'Update'])};{a};{b}")
    odd = ["", "  ", "x;u;[];[]", "9999999999999999999;u;[];[]", "5;u;[[1,2],,[3,4]];[]", "5;u;[[1,2]]", "7|s|[[1.23456789, .5]]|[[ 2 ,3 ]]", "8;u;[[12345678901234567,1]];[]", "9;u;[[0.000000004,1]];[]"]
    return lines + odd


def folder(tmp_path):
    rnd = random.Random(3)
    at = tmp_path / "in"
    at.mkdir()
    for i in range(3):
        with gzip.open(at / f"{i}.gz", "wt") as f:
            f.write("\n".join(text(rnd, 40)) + "\n")
    (at / "3.csv").write_text("\n".join(text(rnd, 5)))
    (at / "_SUCCESS").write_text("")
    return str(at)


def rows(df):
    return sorted((tuple(map(str, r)) for r in df.select(*FIELDS).collect()))


def test_format_equals_the_native_reader(spark, tmp_path):
    datasource.register(spark)
    path = folder(tmp_path)
    df = spark.read.format("fob").options(path=path, price_scale=6, qty_scale=3).load()
    native = read_fob(spark, path, 6, 3)
    assert rows(df) == rows(native) and df.where("corrupt is not null").count() >= 20
    assert [f.dataType for f in df.select(*FIELDS).schema] == [f.dataType for f in native.select(*FIELDS).schema]
    assert df.rdd.getNumPartitions() == 4 and df.select("line_no").distinct().count() <= df.count()
    swapped = spark.read.format("fob").options(path=path, price_scale=6, qty_scale=3, column_order="bids,asks").load()
    assert rows(swapped.where("corrupt is null").selectExpr("*", "1 - bs01 as other").drop("bs01").withColumnRenamed("other", "bs01")) == rows(native.where("corrupt is null"))
    with pytest.raises(Exception, match="column_order"):
        spark.read.format("fob").options(path=path, column_order="x").load()


def test_time_is_pushed_down(spark, tmp_path, capsys):
    datasource.register(spark)
    path = folder(tmp_path)
    df = spark.read.format("fob").option("path", path).load().where("time >= 1010 and time < 1020 and pos = 0")
    df.explain()
    plan = capsys.readouterr().out
    # what the source takes isn't filtered again
    assert "1010" not in plan[: plan.index("BatchScan")] and "pos" in plan
    assert rows(df) == rows(read_fob(spark, path, 8, 8).where("time >= 1010 and time < 1020 and pos = 0")) and df.count() > 10


def test_stream_of_files(spark, tmp_path):
    datasource.register(spark)
    path = folder(tmp_path)
    stream = spark.readStream.format("fob").options(path=path, price_scale=6, qty_scale=3).load()

    def go():
        q = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        assert q.awaitTermination(120)
        return rows(spark.read.schema(stream.schema).parquet(str(tmp_path / "out")))

    assert go() == rows(read_fob(spark, path, 6, 3))
    with gzip.open(os.path.join(path, "a.gz"), "wt") as f:
        f.write("\n".join(text(random.Random(8), 9)))
    assert go() == rows(read_fob(spark, path, 6, 3))
