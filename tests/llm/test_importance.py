"""Importance resampling against a plain version, over partitionings, with clashing names."""

import math
import random

import pytest
import xxhash
from pyspark.sql import functions as F

from bookfold.llm import importance, substring

MASK = (1 << 64) - 1


def plain_buckets(text):
    half = importance.BUCKETS // 2
    w = [xxhash.xxh64_intdigest(x, 11) for x in text.lower().encode().split()]
    out = [(x >> 32) % half for x in w]
    for a, b in zip(w, w[1:]):
        p = (a * 0x9E3779B97F4A7C15 + b) & MASK
        p ^= p >> 29
        p = p * 0xBF58476D1CE4E5B9 & MASK
        out.append(half + (p >> 32) % half)
    return out


def corpus(n=500):
    rnd = random.Random(3)
    good, junk = [f"good{i}" for i in range(60)], [f"junk{i}" for i in range(60)]
    docs = [(i, " ".join(rnd.choices(junk if i % 4 == 0 else good, k=rnd.randint(0, 40)))) for i in range(n)]
    return docs, [(i, int(i % 4 > 0), int(i % 19 == 0)) for i in range(0, n, 2)]


def test_weights_and_draw_equal_a_plain_version(spark):
    docs, labels = corpus()
    df, lab = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    good = [i for i, q, t in labels if q == 1 and t == 0]
    held = {r.doc_id for r in spark.createDataFrame([(i,) for i in good], "doc_id long").where(F.pmod(F.xxhash64(F.lit(42), "doc_id"), F.lit(4)) == 0).collect()}
    raw, target = [0] * importance.BUCKETS, [0] * importance.BUCKETS
    for i, text in docs:
        for b in plain_buckets(text):
            raw[b] += 1
            target[b] += i in good and i not in held
    half = importance.BUCKETS // 2

    def ratio(b):
        part = slice(0, half) if b < half else slice(half, None)
        p = [(x[b] + 0.5) / (sum(x[part]) + 0.5 * half) for x in (target, raw)]
        return math.log(p[0] / p[1])

    known = {b: ratio(b) for b in {b for _, t in docs for b in plain_buckets(t)}}
    weights = {i: sum(known[b] for b in plain_buckets(t)) for i, t in docs}
    cut = sorted((weights[i] for i in held), reverse=True)[len(held) - int(0.01 * len(held)) - 1]
    k = sum(w >= cut - 1e-9 for w in weights.values())
    got = importance.importance_resample(df, lab).collect()
    assert all(r.log_weight == pytest.approx(weights[r.doc_id], abs=1e-6) for r in got)
    assert {r.doc_id for r in got if r.kept} == {r.doc_id for r in sorted(got, key=lambda r: -r.sample_key)[:k]} and 0 < k < len(docs)


def test_partitions_do_not_decide(spark):
    rnd = random.Random(5)
    values = [(rnd.gauss(0, 1),) for _ in range(60_000)]
    want = {k: sorted((v for v, in values), reverse=True)[k - 1] for k in (1, 600, 59_400)}
    docs, labels = corpus(200)
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    kept = set()
    for parts in (1, 7, 50):
        df = spark.createDataFrame(values, "v double").repartition(parts)
        assert {k: importance.kth_highest(df, "v", k) for k in want} == want
        own = spark.createDataFrame(docs, "doc_id long, text string").repartition(parts)
        kept.add(tuple(sorted(r.doc_id for r in importance.importance_resample(own, lab).where("kept").collect())))
    assert len(kept) == 1


def test_clashing_names(spark):
    docs, labels = corpus(60)
    df = spark.createDataFrame([(i, t, 1.0, 2, "x", "y") for i, t in docs], "doc_id long, text string, log_weight double, Kept int, c1 string, `a.b` string")
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    out = importance.importance_resample(df, lab)
    assert out.columns == ["doc_id", "text", "c1", "a.b", "log_weight", "sample_key", "kept"] and out.count() == 60
    whole = importance.resampled(df, lab)
    assert whole.columns == df.columns and {r.Kept for r in whole.collect()} == {2}
    repeated = spark.createDataFrame([(1, "a b c " * 20, 5), (2, "x a b c " + "a b c " * 20, 6)], "doc_id long, text string, `a.b` int")
    found = {r.id: (r.row["a.b"], r.n_removed) for r in substring.substring_dedup(repeated).collect()}
    assert found[1][0] == 5 and found[2][0] == 6 and found[2][1] > 0
