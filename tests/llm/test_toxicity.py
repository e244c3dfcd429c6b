"""Nearest examples against brute force, held-out accuracy, odd rows."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from bookfold.llm import toxicity
from bookfold.llm.common import Scratch


def vector(rnd, n=30):
    terms = sorted(rnd.sample(range(n), rnd.randint(1, 6)))
    w = np.array([rnd.choice([0.5, 1.0, 2.0]) for _ in terms])
    return np.array(terms), w / np.sqrt((w * w).sum())


@pytest.mark.parametrize("k", [1, 5, 40])
def test_nearest_equals_all_cosines(k):
    rnd = random.Random(k)
    entries = sorted((vector(rnd) for _ in range(3000)), key=lambda v: v[0].tolist())
    index = toxicity.BlockMaxIndex(entries, 30)
    dense = np.zeros((len(entries), 30))
    for i, (t, w) in enumerate(entries):
        dense[i, t] = w
    for _ in range(60):
        t, w = vector(rnd)
        q = np.zeros(30)
        q[t] = w
        cosines = np.round(dense @ q, 9)
        want = [i for i in np.lexsort((np.arange(len(cosines)), -cosines))[:k] if cosines[i] > 0]
        ids, found = index.nearest(t.tolist(), w, k)
        assert np.allclose(found, cosines[want], atol=2e-9)
        # of entries whose cosine is that of the last, rounding may take another
        sure = [i for i in want if cosines[i] > found[-1] + 1e-8]
        assert set(sure) <= set(ids.tolist())
    if k < 10:
        assert index.looked_at < 60 * len(entries) / toxicity.BLOCK * 0.6


def test_isotonic_rises_and_pools():
    votes, scores = toxicity.isotonic(np.array([0.1, 0.2, 0.3, 0.9, 0.9]), np.array([0, 5, 0, 8, 0]), np.array([50, 10, 10, 8, 2]))
    assert (np.diff(scores) >= 0).all() and (np.diff(votes) > 0).all() and len(votes) == 3
    assert scores[1] == (5 + 0.5) / 21 and scores[2] == 8.5 / 11


def corpus(seed=2, n=900):
    rnd = random.Random(seed)
    words = [f"w{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}" for i in range(400)]
    docs, labels = [], []
    for i in range(n):
        toxic = int(rnd.random() < 0.15)
        text = rnd.choices(words, k=rnd.randint(1, 200)) + (rnd.sample(["Dolt", "nitwit", "OAF", "churl"], rnd.randint(1, 3)) if toxic else [])
        rnd.shuffle(text)
        docs.append((i, " ".join(text), 1))
        if i % 2:
            labels.append((i, toxic))
    return docs, labels, {i: int(any(w in t.lower().split() for w in ("dolt", "nitwit", "oaf", "churl"))) for i, t, _ in docs}


def test_held_out_documents_and_odd_rows(spark):
    docs, labels, truth = corpus()
    odd = [(None, "a dolt"), (None, None), (5000, ""), (5001, None), (5002, "dolt"), (5002, "dolt"), (5003, "x " * 200_000 + "churl nitwit")]
    df = spark.createDataFrame([*docs, *[(*o, 2) for o in odd]], "doc_id long, text string, toxic int").repartition(3)
    lab = spark.createDataFrame([*labels, (5000, 1), (5000, 0), (None, 1), (5001, None)], "doc_id long, toxic int")
    got = toxicity.toxicity(df, lab.where(~toxicity.held_out())).select("*", toxicity.held_out().alias("held_out")).collect()
    assert len(got) == len(docs) + len(odd)
    assert all(r.predicted == truth[r.doc_id] for r in got if r.doc_id in truth)
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append(r)
    assert {x.predicted for x in by[5002]} == {1} and by[5002][0].score == by[5002][1].score and by[5003][0].predicted == 1
    assert sorted(x.predicted for x in by[None]) == [0, 1] and by[5000][0].score == by[5001][0].score < 0.1
    assert all(0 <= r.score <= 1 for r in got)
    near = by[5002][0].evidence[0]
    assert near.cosine == 1.0 and truth[near.doc_id] == 1 and near.doc_id in dict(labels)


def test_whole_scores_equal_a_plain_version(spark):
    docs, labels, _ = corpus(4, 400)
    df, lab = spark.createDataFrame(docs, "doc_id long, text string, n int"), spark.createDataFrame(labels, "doc_id long, toxic int")
    scratch = Scratch(spark)
    terms = toxicity.telling_terms(df.join(lab, "doc_id").select("text", "toxic"), scratch, 0.01, 256)
    rows = scratch.keep(toxicity.vectors(df, terms, "text", "doc_id"))
    model = toxicity.fit(rows, lab, terms, 7, 1000)
    got = {r.doc_id: r.score for r in toxicity.scored(rows, model, "doc_id").collect()}

    # plainly: all cosines of all examples, equal vectors taken together
    def features(text):
        words = text.lower().split()
        found = {w: words.count(w) for w in words}
        for b in {w[:k] for w in words for k in range(3, min(8, len(w)) + 1)}:
            found |= {f"{b}*{m}": 1 for m in (1, 2, 3) if sum(w.startswith(b) for w in set(words)) >= m}
        return found

    plain = {i: tuple(sorted((terms.index(f), n) for f, n in features(t).items() if f in terms)) for i, t, _ in docs}
    assert any("*" in t for t in terms)
    df_ = {t: sum(any(x == t for x, _ in v) for v in plain.values()) for t in range(len(terms))}
    groups = {}
    for i, y in labels:
        groups.setdefault(plain[i], []).append(y)

    def weights(v):
        w = {t: (1 + np.log(n)) * np.log1p(len(docs) / df_[t]) for t, n in v}
        size = np.sqrt(sum(x * x for x in w.values()))
        return {t: x / size for t, x in w.items()}

    base = sum(y for _, y in labels) / len(labels)
    for i, v in plain.items():
        cosines = sorted((-round(sum(x * weights(o).get(t, 0) for t, x in weights(v).items()), 9), o) for o in groups if o) if v else []
        cut = [c for c in cosines if c[0] < 0]
        if len(cut) > 7 and abs(cut[6][0] - cut[7][0]) < 1e-8:
            continue  # tied at the cut
        w = [(-c * np.log1p(len(groups[o])), sum(groups[o]) / len(groups[o])) for c, o in cut[:7]]
        vote = (sum(a * b for a, b in w) + toxicity.PRIOR * base) / (sum(a for a, _ in w) + toxicity.PRIOR)
        assert got[i] == pytest.approx(float(np.interp(vote, model.votes, model.scores)), abs=1e-6)
    scratch.close()


def test_nothing_to_learn_from(spark):
    docs = spark.createDataFrame([(1, "a"), (2, None)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert [(r.score, r.predicted, r.evidence) for r in toxicity.toxicity(docs, none).collect()] == [(0.0, 0, []), (0.0, 0, [])]
    assert toxicity.toxicity(docs.where(F.lit(False)), none).count() == 0
