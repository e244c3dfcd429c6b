"""Where order-book text breaks, against a scanner that walks the text."""

import random
import re

from pyspark.sql import functions as F

from bookfold.sources import fob


def walk(text):
    """The first fault of a list by walking it, token by token: kind, place, whole levels before."""
    at, levels = 0, 0

    def blank():
        nonlocal at
        at += len(re.match(r"\s*", text[at:]).group())

    def take(pattern):
        nonlocal at
        blank()
        m = re.match(pattern, text[at:])
        at += m.end() if m else 0
        return bool(m)

    number = r"[0-9]*\.?[0-9]+"
    if not take(r"\["):
        return "list", at, 0
    if not take(r"\]"):
        while True:
            for kind, p in (("level", r"\["), ("price", number), ("comma", ","), ("quantity", number), ("level end", r"\]")):
                if not take(p):
                    return kind, at, levels
            levels += 1
            if take(r"\]"):
                break
            if not take(","):
                return "comma or end", at, levels
    blank()
    return None if at == len(text) else ("nothing", at, levels)


def test_faults_equal_a_walk(spark):
    rnd = random.Random(9)
    good = ["[]", " [ ] ", "[[1,2]]", "[ [1 , .5] ,[30.25,4]\t, [5,6]]"]
    texts = good + ["[[1,2],,[3,4]]", "[[1,2] [3,4]]", "[[1,2],[3,4]", "[[1,2]]]", "[[1,-2]]", "[[1.,2]]", "[[1,2,3]]", "", "[", "x", "[,[1,2]]", "[[1,2],]", "[[1;2]]", "[[1 2]]", "[L]", "[\u0001]", "[[1.2.3,4]]", "[[1,2]] x"]
    for _ in range(300):
        t = list("[" + ",".join(f"[{rnd.randrange(100)},{rnd.randrange(9)}.5]" for _ in range(rnd.randint(0, 4))) + "]")
        for _ in range(rnd.randint(0, 2)):
            i = rnd.randrange(len(t) + 1)
            t[i : i + rnd.randint(0, 2)] = rnd.choice(["", ",", "[", "]", " ", "7", ".", "e"])
        texts.append("".join(t))
    texts.append("[" + "[1,2]," * 30_000 + "[3,4]]")
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, text string").select("i", F.inline_outer(F.array(F.struct(fob.fault(F.col("text")).alias("f"), fob.well_formed(F.col("text")).alias("ok")))))
    for r in rows.collect():
        want = walk(texts[r.i])
        assert (None if r.f is None else (r.f.kind, r.f.place, r.f.levels)) == want, texts[r.i][:200]
        assert r.ok == (want is None), texts[r.i][:200]


def test_lines_that_break(spark):
    lines = [(1, "5;u;[[1,2]];[]"), (2, "5;u;[[1,2],[3,4],,];[[7,8]]"), (3, "5;s;[[1,2]];[[7,8],[9,9"), (4, "x;u;[];[]"), (5, "5;u;[[1,2]]"), (6, " ")]
    df = spark.createDataFrame(lines, "line_no int, value string")
    got = {r.line_no: r for r in fob.faults(df, before=True).collect()}
    assert {k: (r.field, r.kind, r.place, r.levels) for k, r in got.items()} == {2: ("asks", "level", 13, 2), 3: ("bids", "level end", 11, 1), 4: ("time", "time", 0, 0), 5: ("bids", "list", 0, 0)}
    assert [tuple(x) for x in got[2].asks] == [("1", "2"), ("3", "4")] and got[2].bids == []
    assert [tuple(x) for x in got[3].asks] == [("1", "2")] and [tuple(x) for x in got[3].bids] == [("7", "8")]
    assert {r.line_no for r in fob.parse_lines(df).where("corrupt is not null").collect()} == {2, 3, 4, 5}
    assert fob.faults(df.where("false")).columns == ["line_no", "field", "kind", "place", "levels"]
