"""Brute force, invariants and odd rows of the operators whose results SQL can't express."""

import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from bookfold.llm import bpe, common, edit_bands, edit_embedding, language, packing, pii, quality_rules, sharding, simhash

SCHEMA = "doc_id long, text string"


def _lowest(nodes, edges):
    low = {n: n for n in nodes}

    def root(x):
        while low[x] != x:
            low[x] = low[low[x]]
            x = low[x]
        return x

    for a, b in edges:
        x, y = sorted((root(a), root(b)))
        low[y] = x
    return {n: root(n) for n in nodes}


def test_components_with_hot_nodes(spark, monkeypatch):
    monkeypatch.setattr(common, "HOT_KEYS", 16)
    rnd = random.Random(1)
    edges = [(0, i) for i in range(1, 5000)] + [(10**6, i) for i in range(5000, 8000)] + [(7, 10**6)] + [(20_000 + i, 20_001 + i) for i in range(300)]
    edges += [(rnd.randrange(40_000, 40_200), rnd.randrange(40_000, 40_200)) for _ in range(90)]
    edges = [e for e in edges if e[0] != e[1]]
    scratch = common.Scratch(spark)
    got = {r.node: r.component for r in common.connected_components(spark.createDataFrame(edges, "a long, b long").repartition(5), scratch).collect()}
    scratch.close()
    assert got == _lowest({x for e in edges for x in e}, edges)


def test_pii_texts_that_repeat_a_part(spark):
    texts = ["x@" + "a." * 3000 + "com", "x@a." * 200_000, "1" * 3000, "1-" * 500_000, "a@" * 500_000, "+1 (" * 250_000, "1.2.3." * 160_000, "0f" * 1500, "@" * 1_000_000, "-" * 1_000_000]
    docs = spark.createDataFrame(list(enumerate(texts)), SCHEMA)
    assert [len(r.text) for r in pii.pseudonymise(docs, "k").orderBy("doc_id").collect()] == list(map(len, texts))


def test_pii_is_injective_valid_and_keeps_other_columns(spark):
    ids = [f"{a:03d}-{b:02d}-{c:04d}" for a in (1, 665, 899) for b in (1, 50, 99) for c in range(1, 60)]
    rows = [(i, t, "f", 5) for i, t in enumerate(ids)] + [(9000, "000-12-1234", "f", 5), (9001, "3782 822463 10005", "f", 5), (9002, "3782 822463 10006", "f", 5)]
    got = {r.doc_id: r for r in pii.pseudonymise(spark.createDataFrame(rows, SCHEMA + ", __found string, `new` int"), "k", count_col="n").collect()}
    new = [got[i].text for i in range(len(ids))]
    assert len(set(new)) == len(ids) and all(a != b for a, b in zip(ids, new))
    assert all(n[:3] not in ("000", "666") and n[:3] < "900" and n[4:6] != "00" and n[7:] != "0000" for n in new)
    assert got[9000].text == "000-12-1234" and got[9002].text == "3782 822463 10006" and got[9001].text != "3782 822463 10005"
    luhn = [int(c) for c in got[9001].text if c != " "][::-1]
    assert sum(d if k % 2 == 0 else (2 * d - 9 * (d > 4)) for k, d in enumerate(luhn)) % 10 == 0
    assert all(r["__found"] == "f" and r["new"] == 5 for r in got.values()) and got[0].n == 1 and got[9000].n == 0


def test_near_dedup_whatever_the_names(spark):
    rows = [(5, "one two three four five six seven", 1, 7, 9), (6, "one two three four five six seven", 2, 8, 9), (None, None, 3, 8, 9), (None, "", 4, 8, 9)]
    docs = spark.createDataFrame(rows + rows[:1], SCHEMA + ", __k int, __id int, node int")
    got = sorted((r.doc_id is None, r.doc_id, r["__k"], r["__id"], r["node"]) for r in simhash.near_dedup(docs).collect())
    assert got[0] == (False, 5, 1, 7, 9) and len(got) == 2 and got[1][0]
    assert simhash.near_dedup(docs.where("false")).count() == 0


def test_near_dedup_equals_brute_force_in_mixed_buckets(spark, monkeypatch):
    rnd = random.Random(3)
    base = [f"w{rnd.randrange(10**6)}" for _ in range(120)]
    rows = []
    for i in range(60):
        w = list(base)
        for _ in range(rnd.choice([1, 2, 4, 8, 40])):
            w[rnd.randrange(len(w))] = f"x{rnd.randrange(10**6)}"
        rows.append((i, " ".join(w)))
    sets = {i: set(simhash.shingle_set(t.encode()).tolist()) for i, t in rows}
    close = [(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.8]
    want = sorted(set(_lowest(sets, close).values()))
    assert 1 < len(want) < 60
    docs = spark.createDataFrame(rows, SCHEMA)
    for listed, side, crowded in ((3, 4096, 4096), (-1e9, 3, 8)):
        monkeypatch.setattr(edit_bands, "LISTED", listed)
        monkeypatch.setattr(edit_bands, "SIDE", side)
        assert sorted(r.doc_id for r in simhash.near_dedup(docs, crowded=crowded).collect()) == want


def test_short_fingerprints_meet_on_blocks():
    rnd = random.Random(4)
    for _ in range(400):
        n = rnd.randint(1, 37)
        a = np.array([rnd.randint(1, 15) for _ in range(n)], np.uint8)
        b = a[: max(1, n - rnd.randint(0, 6))].copy()
        for _ in range(rnd.randint(0, 5)):
            b[rnd.randrange(len(b))] = rnd.randint(1, 15)
        x = edit_bands.matrix([bytes.fromhex("".join(f"{d:x}" for d in v) + "0" * (len(v) % 2)) for v in (a, b)], [len(a), len(b)])
        if edit_bands.alike(x[:1], x[1:], np.array([len(a)]))[0] >= 0.8 and min(len(a), len(b)) < edit_bands.LEAST:
            keys = [set(edit_bands.band_keys(v, 5, 6, 15, 0.8)[0].tolist()) for v in (a, b)]
            assert keys[0] & keys[1]


def test_bands_find_pairs_wherever_they_differ():
    rnd = random.Random(5)
    shape = edit_bands.band_shape(200_000, 0.8)
    missed = {}
    for place in ("even", "start", "middle", "end"):
        found = total = 0
        while total < 150:
            n = rnd.randint(150, 260)
            a = np.array([rnd.randint(1, 15) for _ in range(n)], np.uint8)
            b = a.copy()
            reach = edit_bands._REACH[:n] / edit_bands._REACH[n - 1]
            if place == "even":
                at = [k for k in range(n) if rnd.random() < 0.19]
            else:
                low = {"start": 0.0, "middle": 0.4, "end": 0.82}[place]
                at = [k for k in range(n) if low <= reach[k] <= low + 0.19]
            for k in at:
                b[k] = rnd.randint(1, 15)
            agree = float(edit_bands._WEIGHTS[:n][a == b].sum() / edit_bands._REACH[n - 1])
            if (agree - edit_embedding.CHANCE) / (1 - edit_embedding.CHANCE) < 0.8:
                continue
            total += 1
            found += bool(set(edit_bands.band_keys(a, *shape, 0.8)[0].tolist()) & set(edit_bands.band_keys(b, *shape, 0.8)[0].tolist()))
        missed[place] = 1 - found / total
    assert max(missed.values()) <= 0.06, missed


def test_edited_texts_follow_descending_ids(spark):
    rnd = random.Random(6)
    rows = [(rnd.choice([None, 4, *range(10, 90)]), "".join(rnd.choice("abcé😀 ") for _ in range(rnd.randint(0, 40)))) for _ in range(300)]
    docs = spark.createDataFrame(rows, SCHEMA)
    h = {r.text: r.h for r in docs.select("text", F.xxhash64(F.col("text").cast("binary")).alias("h")).collect()}
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), h[r[1]], r[1].encode()))
    want = []
    for (i, t), (_, after) in zip(order, [*order[1:], order[0]]):
        edit = t[: len(t) - len(t) // 2] + after[: len(t) // 2]
        a, b, c = edit_embedding.fingerprints([t, edit, after])
        want.append((i, len(t), hashlib.sha256(edit.encode()).hexdigest(), a, b, edit_embedding.likeness(a, b), edit_embedding.likeness(a, c)))
    key = lambda r: tuple(map(str, r))
    for part in (8 << 20, 100):
        got = [tuple(r)[:7] for r in edit_embedding.fingerprint_documents(docs, part_bytes=part).collect()]
        assert sorted(got, key=key) == sorted(want, key=key)


def test_language_takes_letters_of_mixed_runs(spark):
    assert language.words_of("5 m² a½b CO₂ x".encode()) == ["m", "a", "b", "co", "x"]
    docs = spark.createDataFrame([("the and of this " * 9, "en"), ("der die das und " * 9, "de")] * 10, "text string, lang string")
    models = language.train(docs)
    got = language.identify(spark.createDataFrame([(1, "the²"), (2, "²½"), (3, "")], SCHEMA), models, "doc_id").collect()
    assert [r.lang_pred for r in sorted(got)] == ["en", "und", "und"] and all(0 <= r.score <= 1 for r in got)
    assert language.identify(docs.where("false").selectExpr("1 as doc_id", "text"), models, "doc_id").count() == 0


def test_language_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    from bookfold.llm.language import op9_language

    got = op9_language(spark, "/root/testdata/sf0.01").join(docs.select("doc_id", "lang", "n_chars"), "doc_id").where("held_out and lang is not null and n_chars > 100").collect()
    assert len(got) > 100 and sum(r.lang == r.lang_pred for r in got) >= 0.97 * len(got)


def test_sharding_laws(spark):
    rnd = random.Random(7)
    rows = [(i, "x" * rnd.randint(0, 300) if i % 5 else None) for i in range(2000)]
    got = sharding.shard(spark.createDataFrame(rows, SCHEMA), 8).collect()
    text = dict(rows)
    size = {}
    for r in got:
        t = (text[r.doc_id] or "").encode()
        assert r.size == len(t) + 1 and r.text_crc32 == (None if text[r.doc_id] is None else zlib.crc32(t)) and r.law == "bytes" and r.grown_shard is None
        size[r.shard] = size.get(r.shard, 0) + r.size
    mean = sum(size.values()) / 8
    assert set(size) == set(range(8)) and all(abs(n - mean) <= 0.02 * mean + 2 * 301 for n in size.values())


def test_written_shards_keep_repeated_rows(spark, tmp_path):
    docs = spark.createDataFrame([(1, "a", 1), (1, "a", 2), (2, "b", 3), (None, None, 4)], SCHEMA + ", crc int")
    sharding.write_shards(docs, str(tmp_path / "s"), 2)
    back = spark.read.parquet(str(tmp_path / "s"))
    assert sorted(r.crc for r in back.collect()) == [1, 2, 3, 4]


def _least_cost(points, cost, length):
    f = [0.0] + [float("inf")] * (len(points) - 1)
    for j in range(1, len(points)):
        for i in range(j):
            n = points[j] - points[i]
            if n <= length:
                pad = 0 if n & (n - 1) == 0 else length - n
                f[j] = min(f[j], f[i] + pad + cost[j])
    return f[-1]


def test_packing_costs_the_least():
    rnd = random.Random(8)
    for _ in range(500):
        length = rnd.choice([16, 64])
        ids = np.array([rnd.choice([0, 0, 0, 1]) for _ in range(rnd.randint(1, 260))])
        ends = sorted({rnd.randint(1, len(ids)) for _ in range(rnd.randint(0, 6))} | {len(ids)})
        points, cost = packing.cut_points(ids, np.array(ends), np.array([False, True]), length)
        cuts = packing.cheapest_cuts(points, cost, length, True)
        price = dict(zip(points.tolist(), cost.tolist()))
        paid = sum((0 if (n := b - a) & (n - 1) == 0 else length - n) + (price.get(b, packing.INSIDE) if b < len(ids) else 0) for a, b in zip(cuts, cuts[1:]))
        assert cuts[0] == 0 and cuts[-1] == len(ids) and all(0 < b - a <= length for a, b in zip(cuts, cuts[1:]))
        assert paid <= _least_cost(points.tolist(), cost.tolist(), length) + 1e-9


def test_bpe_ids_are_those_of_the_library(spark):
    import public_tokenizers as P
    import tiktoken

    codec = bpe.codec(P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    ranks = {b: i for i, b in codec._bytes.items()}
    library = tiktoken.Encoding("all", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rnd = random.Random(9)
    texts = ["".join(rnd.choice(["the ", "Of", "'ll", " \n", "\t", "1234", "é", "日本", "\x1c", "x" * 50, "<|endoftext|>", "—"]) for _ in range(rnd.randint(0, 300))) for _ in range(60)]
    docs = spark.createDataFrame(list(enumerate(texts)), SCHEMA)
    got = {r.doc_id: (r.n_tokens, r.ids_sha256) for r in bpe.encode_documents(docs, P.path("byte_bpe_50k.tiktoken"), P.PATTERN, chunk=200, overlap=40).collect()}
    for i, t in enumerate(texts):
        ids = library.encode_ordinary(t)
        assert got[i] == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())


def _counts(text):
    import re

    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    seen = {}
    for k in range(len(words) - 7):
        seen.setdefault(tuple(words[k : k + 8]), []).append(k)
    again = {j for at in seen.values() if len(at) > 1 for k in at for j in range(k, k + 8)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(again)


def test_quality_counts_equal_brute_force(spark):
    rnd = random.Random(10)
    texts = [None, "", " \n", "a" * 100_000, "a b\n" * 3000] + ["".join(rnd.choice(["a ", "b ", "c\n", "é#", "  ", "\t|", "a b a b a b a b\n"]) for _ in range(rnd.randint(0, 120))) for _ in range(150)]
    docs = spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts)], "id long, text string, lang string")
    labels = spark.createDataFrame([(i, 1, 0) for i in range(40)], "id long, quality int, toxic int")
    for r in quality_rules.quality_rules(docs, labels, id_col="id").collect():
        want = _counts(texts[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 20 or 100 * want[4] > 30 * want[0])
        assert r.kept == (not r.base_failed and r.failed_rules == "")
    assert quality_rules.quality_rules(docs.where("false"), labels, id_col="id").count() == 0


def test_quality_cutoffs_keep_their_promise(spark):
    rnd = random.Random(11)
    # symbols per word of good documents: a few over each cutoff
    rows = [(i, 100, 500, int(100 * rnd.paretovariate(2) * 0.02), 10, 0, 0, "en") for i in range(6000)]
    counts = spark.createDataFrame(rows, "doc_id long, n_words long, word_chars long, n_symbols long, n_lines long, n_dup_lines long, n_repeat_words long, stratum string")
    labels = spark.createDataFrame([(r[0], 1, 0) for r in rows[:3000]], "doc_id long, quality int, toxic int")
    cut = quality_rules.thresholds(counts, labels).collect()[0]
    assert cut.n_good == 3000
    from math import comb

    each = quality_rules.RISK / len(quality_rules.CUTOFFS)
    over = sum(r[3] / r[1] > cut.symbols_per_word for r in rows[:3000])
    assert sum(comb(3000, k) * each**k * (1 - each) ** (3000 - k) for k in range(over + 1)) <= 0.05 / len(quality_rules.CUTOFFS)
    stricter = max((c for c in quality_rules.CUTOFFS["symbols_per_word"] if c < cut.symbols_per_word), default=None)
    if stricter is not None:
        over = sum(r[3] / r[1] > stricter for r in rows[:3000])
        assert sum(comb(3000, k) * each**k * (1 - each) ** (3000 - k) for k in range(over + 1)) > 0.05 / len(quality_rules.CUTOFFS)


@pytest.mark.parametrize("name", ["quality", "near_dedup", "substring_dedup", "pii", "packing"])
def test_pipeline_stage_keeps_columns_and_odd_rows(spark, name):
    import corpus_pipeline

    docs = spark.createDataFrame([(1, "a b c " * 40, "en", "s", 240), (2, "a b c " * 40, "en", "s", 240), (None, None, None, None, None), (4, "", "en", "s", 0)], "doc_id long, text string, lang string, source string, n_chars long")
    stage = dict(corpus_pipeline.STAGES)[name]
    out = stage(spark, docs, "/root/testdata/sf0.001")
    rows = out.collect()
    assert stage(spark, docs.where("false"), "/root/testdata/sf0.001").count() == 0
    if name != "packing":
        assert out.columns == docs.columns and len(rows) <= 4
    if name == "near_dedup":
        assert sorted(r.doc_id for r in rows if r.doc_id is not None) == [1, 4]


@pytest.mark.parametrize("dense", [16, -1])
def test_parities_leave_every_close_pair_open(dense):
    rnd = np.random.default_rng(6)
    sets = []
    for n in [1, 2, 5, 9, 30, 63, 64, 90, 91, 200, 724, 725, 1448, 3000]:
        own = rnd.integers(0, 2**64, n, np.uint64)
        sets += [own] + [np.unique(np.concatenate([own[int(n * cut) :], rnd.integers(0, 2**64, int(n * more), np.uint64)])) for cut in (0, 0.1, 0.19, 0.4) for more in (0, 0.1, 0.24, 0.4)]
    sets = {i: set(s.tolist()) for i, s in enumerate(sets)}
    odd = [simhash.parities(np.array(sorted(sets[i]), np.uint64)) for i in sets]
    t = pa.table({"key": [7] * len(sets), "cell": [9] * len(sets), "node": list(sets), "component": [i // 2 for i in sets], "n": list(map(len, sets.values())), "odd": odd})
    got = simhash._open_across(0.8, dense)(t).to_pylist()
    pairs = {(a, b): len(sets[a] & sets[b]) / len(sets[a] | sets[b]) for a in sets for b in sets if a < b and a // 2 != b // 2}
    close = {p for p, similarity in pairs.items() if similarity >= 0.8}
    assert len(close) > 100
    assert all(simhash.differing(odd[a], odd[b]) <= len(sets[a] ^ sets[b]) for a, b in pairs)
    if dense < 0:
        assert {r["key"] for r in got} == {7} and {r["cell"] for r in got} == {9} and all(r["b"] == r["a"] // 2 for r in got)
        assert {x for p in close for x in p} <= {r["a"] for r in got}
    else:
        found = {(r["a"], r["b"]) for r in got}
        assert len(found) == len(got) and close <= found <= set(pairs) and {r["key"] for r in got} == {None}
        assert not [p for p in found if pairs[p] < 0.3 and min(len(sets[x]) for x in p) > 60]


@pytest.mark.parametrize("dense", [16, -1])
def test_near_dedup_moves_no_sets_for_chance_meetings(spark, monkeypatch, dense):
    monkeypatch.setattr(simhash, "ORDER_SHINGLES", 0)
    monkeypatch.setattr(simhash, "DENSE", dense)
    rnd = random.Random(11)
    word = lambda: f"w{rnd.randrange(10**6)}"
    phrase = []
    while len(phrase) < 6:  # first in the order of prefixes
        x = " ".join(word() for _ in range(5))
        if xxhash.xxh64_intdigest(x, 42) < 2**64 // 50:
            phrase.append(x)
    rows = [(i, " ".join([*[word() for _ in range(80)], *rnd.sample(phrase, 3), *[word() for _ in range(80)]])) for i in range(60)]
    moved = []

    def keep(scratch, df, plain=common.Scratch.keep):
        out = plain(scratch, df)
        if "set" in out.columns:
            moved.append(out.count())
        return out

    monkeypatch.setattr(common.Scratch, "keep", keep)
    assert simhash.near_dedup(spark.createDataFrame(rows, SCHEMA)).count() == 60
    assert moved and sum(moved) == 0


@pytest.mark.parametrize("name", ["quality", "near_dedup", "substring_dedup", "packing"])
def test_pipeline_stage_sends_small_batches(spark, name):
    import corpus_pipeline

    conf = "spark.sql.execution.arrow.maxBytesPerBatch"
    spark.conf.unset(conf)
    docs = spark.createDataFrame([(1, "a b c " * 40, "en", "s", 240)], "doc_id long, text string, lang string, source string, n_chars long")
    try:
        dict(corpus_pipeline.STAGES)[name](spark, docs, "/root/testdata/sf0.001")
        sizes = lambda batches: (pa.RecordBatch.from_arrays([pa.array([b.nbytes])], names=["n"]) for b in batches)
        sent = spark.range(0, 400, 1, 1).select(F.repeat(F.lit("x"), 50_000).alias("text")).mapInArrow(sizes, "n long").collect()
        assert sum(r.n for r in sent) >= 400 * 50_000 and max(r.n for r in sent) < 4 << 20
    finally:
        spark.conf.unset(conf)
