"""Spelling variants against brute force."""

import random
import re
import zlib

import pytest

from bookfold.llm import variants


def edits(w, letters):
    out = {w[:i] + w[i + 1 :] for i in range(len(w))}
    out |= {w[:i] + c + w[i + 1 :] for i in range(len(w)) for c in letters} | {w[:i] + c + w[i:] for i in range(len(w) + 1) for c in letters}
    return out - {w}


def brute(rows):
    counts = {}
    for key, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = "".join(c.lower() if c < "\x80" else c for c in run)
            h = zlib.crc32(f"{'' if key is None else key}:{w}".encode())
            if h % 199 == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            counts[w] = counts.get(w, 0) + 1
    n = {w: k for w, k in counts.items() if len(w) >= 6 and k >= 5}
    letters = sorted({c for w in n for c in w})
    near = {w: sorted(edits(w, letters) & n.keys(), key=lambda x: (-n[x], x)) for w in n}
    form = {w: near[w][0] if near[w] and n[near[w][0]] >= 5 * n[w] else None for w in n}

    def root(w):
        return w if form[w] is None else root(form[w])

    return {(w, form[w], root(w), n[w], len(near[w]), n[form[w]] if form[w] else None) for w in n}


def corpus(seed, docs=150):
    rnd = random.Random(seed)
    syllables = ["an", "te", "ro", "ß", "né", "sch", "li", "÷a", "on", "tt", "aa"]
    words = ["".join(rnd.choices(syllables, k=rnd.randint(2, 6))) for _ in range(60)] + ["aaaaaaa", "aaaaaaaa", "aaaaaaaaa", "a" * 70, "a" * 71, "É" * 6]
    for _ in range(4):
        words += [rnd.choice(sorted(edits(rnd.choice(words), "antÿ"))) for _ in range(40)]
    weights = [5 ** rnd.randint(0, 4) for _ in words]
    rows = [(rnd.randrange(10**6), " ".join(w.upper() if rnd.random() < 0.1 and w.isascii() else w for w in rnd.choices(words, weights, k=rnd.randint(0, 300)))) for _ in range(docs)]
    return rows + [rows[0], rows[0], (None, rows[1][1]), (None, None), (7, None), (8, ""), (9, "\U0001f600 abcdefg"), (10, "Kſ" * 9)]


@pytest.mark.parametrize("small", [False, True])
def test_variants_equal_brute_force(spark, monkeypatch, small):
    if small:  # lists in cells, flushes and pieces of every kind
        for name, value in {"CELL": 6, "_ROWS": 40, "_PAIRS": 9, "_HELD": 50, "_PIECE": 64}.items():
            monkeypatch.setattr(variants, name, value)
        monkeypatch.setattr(variants, "HOT_KEYS", 10**9)
        cells = variants.into_cells
        monkeypatch.setattr(variants, "into_cells", lambda lists: cells(lists, 6))
    rows = corpus(3)
    docs = spark.createDataFrame([(a, b, 1) for a, b in rows], "doc_id long, text string, `n` int").repartition(3)
    got = [tuple(r) for r in variants.group_variants(docs).select("word", "form", "root", "n", "n_near", "form_n").collect()]
    assert len(got) == len(set(got)) and set(got) == brute(rows)
    assert any(r[1] and r[1] != r[2] for r in got) and max(r[4] for r in got) > 3


def test_variants_of_nothing(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert variants.group_variants(docs).columns == ["word", "form", "root", "n", "n_near", "form_n"]
    assert variants.group_variants(docs).count() == 0
    with pytest.raises(ValueError):
        variants.group_variants(docs, least_length=5)


def test_checksums_by_tables_equal_those_of_the_whole():
    counter = variants._Counter()
    words = [f"{'wörter' * k}{c}" for k in range(1, 14) for c in "abcdefgh"]
    for i in range(40):
        counter.add([(f"{i}:".encode(), " ".join(words))])
    got = dict(zip(*[c.to_pylist() for c in counter.batch().columns]))
    want = {}
    for i in range(40):
        for w in words:
            x = variants.shortened(f"{i}:".encode(), w)
            want[x] = want.get(x, 0) + 1
    assert got == want
