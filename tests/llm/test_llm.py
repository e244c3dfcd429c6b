"""Brute force and edge cases on small rows."""

import hashlib
import random
import tracemalloc
import zlib

import numpy as np
import pyarrow as pa
import pytest

from bookfold.llm import bpe, common, edit_bands, edit_embedding, importance, language, packing, pii, quality_rules, sharding, simhash, substring

ODD = [(3, None), (1, ""), (2, "one"), (2, "one"), (None, "two words"), (7, " \t\n"), (5, "a b c d e f g h i j k l m n o p q r s t u v " * 3)]
SCHEMA = "doc_id long, text string"


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(*r, "x", 1) for r in ODD], SCHEMA + ", fp string, id long")


def test_simhash_components(spark, odd):
    rnd = random.Random(2)
    texts = [" ".join(rnd.choice("abcdefgh") for _ in range(60)) for _ in range(12)]
    rows = [(i, (t := texts[i % 12])[:-1] + rnd.choice("ab") if i % 3 else texts[i % 12]) for i in range(80)]
    docs = spark.createDataFrame(rows, SCHEMA)
    fps = {i: simhash.fingerprint(t.encode()) for i, t in rows}
    low = {i: i for i in fps}
    for _ in fps:
        for a in fps:
            for b in fps:
                if (fps[a] ^ fps[b]).bit_count() <= 4:
                    low[a] = low[b] = min(low[a], low[b])
    for crowded in (4096, 1):
        got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.simhash_components(docs, crowded=crowded).collect()}
        assert got == {i: (f"{fps[i]:016x}", low[i]) for i in fps}
    assert simhash.simhash_components(odd).count() == len(ODD)
    assert simhash.near_dedup(odd).columns == odd.columns


def test_near_dedup_groups(spark):
    rnd = random.Random(5)
    base = [[f"w{rnd.randrange(5000)}" for _ in range(200)] for _ in range(40)]
    rows = []
    for i, w in enumerate(base):
        rows.append((i, " ".join(w)))
        rows += [(100 + 3 * i + k, " ".join([*w[: 60 + k], "new", *w[61 + k :]])) for k in range(3)]
    docs = spark.createDataFrame(rows, SCHEMA)
    for crowded in (4096, 1):
        assert sorted(r.doc_id for r in simhash.near_dedup(docs, crowded=crowded).collect()) == list(range(40))


def _jaccard(a: str, b: str) -> float:
    x, y = (set(simhash.shingle_set(t.encode()).tolist()) for t in (a, b))
    return len(x & y) / len(x | y)


def test_near_dedup_keeps_pairs_below_the_similarity(spark):
    rnd = random.Random(8)
    rows = []
    for i in range(30):
        w = [f"w{rnd.randrange(10**6)}" for _ in range(200)]
        rows.append((i, " ".join(w)))
        n = 178 - i % 10
        rows.append((100 + i, " ".join([*w[:n], *[f"x{rnd.randrange(10**6)}" for _ in range(200 - n)]])))
    assert all(0.7 < _jaccard(a[1], b[1]) < 0.8 for a, b in zip(rows[::2], rows[1::2]))
    docs = spark.createDataFrame(rows, SCHEMA)
    for crowded in (4096, 1):
        assert simhash.near_dedup(docs, crowded=crowded).count() == len(rows)


def test_near_dedup_finds_every_pair_at_the_similarity(spark, monkeypatch):
    rnd = random.Random(9)
    rows = []
    for i in range(60):
        w = [f"w{rnd.randrange(10**6)}" for _ in range(204)]
        # 178 of 222 shingles are shared: 0.802
        rows += [(i, " ".join(w)), (100 + i, " ".join([*w[:182], *[f"x{rnd.randrange(10**6)}" for _ in range(22)]]))]
    assert all(0.8 <= _jaccard(a[1], b[1]) < 0.81 for a, b in zip(rows[::2], rows[1::2]))
    docs = spark.createDataFrame(rows, SCHEMA)
    for listed, crowded in ((3, 4096), (-1e9, 1)):
        monkeypatch.setattr(edit_bands, "LISTED", listed)
        assert sorted(r.doc_id for r in simhash.near_dedup(docs, crowded=crowded).collect()) == list(range(60))


def test_near_dedup_finds_short_pairs(spark):
    rnd = random.Random(10)
    rows = []
    for i in range(40):
        w = [f"w{rnd.randrange(10**6)}" for _ in range(8 + i % 13)]
        # 4 against 5 shingles at 8 words
        rows += [(i, " ".join(w)), (100 + i, " ".join([*w, "more"]))]
    assert all(_jaccard(a[1], b[1]) >= 0.8 for a, b in zip(rows[::2], rows[1::2]))
    assert sorted(r.doc_id for r in simhash.near_dedup(spark.createDataFrame(rows, SCHEMA)).collect()) == list(range(40))


def test_bpe_stitch_and_digests(spark, odd):
    import public_tokenizers as P

    pattern = bpe.compiled(P.PATTERN)
    rnd = random.Random(1)
    for _ in range(300):
        t = "".join(rnd.choice("ab'sl  \n\t1.é") * rnd.choice([1, 1, 2, 30]) for _ in range(60))
        parts = [t[i : i + 48] for i in range(0, len(t), 32)]
        assert bpe.stitch(pattern, t, 32, 16, [bpe.starts(pattern, x) for x in parts]) == bpe.starts(pattern, t).tolist()
    got = bpe.encode_documents(odd, P.path("byte_bpe_50k.tiktoken"), P.PATTERN, chunk=16, overlap=8).collect()
    assert sorted(r.decoded_sha256 for r in got) == sorted(hashlib.sha256((t or "").encode()).hexdigest() for _, t in ODD)


def test_substring_brute_force(spark, odd):
    rnd = random.Random(4)
    rows = [(i, " ".join(rnd.choice("ab") for _ in range(rnd.randint(0, 60)))) for i in range(60)]
    first, words = {}, {i: t.encode().split() for i, t in rows}
    for i, w in words.items():
        for k in range(len(w) - 7):
            first.setdefault(tuple(w[k : k + 8]), (i, k))
    got = {r.id: r for r in substring.substring_dedup(spark.createDataFrame(rows, SCHEMA).repartition(3), window=8, batch_words=100, home_bytes=200, bucket_windows=50).collect()}
    for i, w in words.items():
        gone = {j for k in range(len(w) - 7) if first[tuple(w[k : k + 8])] < (i, k) for j in range(k, k + 8)}
        assert (got[i].n_words, got[i].n_removed, got[i].kept.encode().split()) == (len(w), len(gone), [x for k, x in enumerate(w) if k not in gone])
    assert substring.substring_dedup(odd, digest=True).count() == len(ODD)


def test_substring_map_tasks_hold_and_send_little():
    rnd = random.Random(13)
    texts = [" ".join(f"w{rnd.randrange(5000)}" for _ in range(1000)).encode() for _ in range(400)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(400), pa.int64()), pa.array(texts, pa.binary())], names=["id", "text"])
    tracemalloc.start()
    sent = [b.nbytes for b in substring._find(20, 256, 64, False, 1_500_000)(iter([batch]))]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert sum(sent) > 3_000_000 and max(sent) < 2_000_000
    # bytes a word
    assert peak < 40 * 400_000


def test_workers_remember_few_words():
    import public_tokenizers as P

    known = substring._Hashes()
    w = packing.WordIds(P.path("word_bpe_49k.json"), 2)
    for k in range(15):
        words = [b"w%d" % (10_000 * k + i) for i in range(10_000)]
        assert [known[x] for x in words] == [substring.xxhash.xxh64_intdigest(x, 7) for x in words]
        w.documents([b" ".join(words)], 50_000)
        assert max(len(known), len(w._known)) <= 60_000


def test_workers_give_memory_back_after_a_task(monkeypatch):
    done = []
    monkeypatch.setattr(common, "give_back", lambda: done.append(len(got)))
    got = []
    for b in common.thrifty(lambda batches: (2 * b for b in batches))(iter([1, 2])):
        got.append(b)
    assert (got, done) == ([2, 4], [2])


def test_sharding(odd):
    rows = sharding.shard(odd, 3).collect()
    assert len(rows) == len(ODD)
    for s in {r.shard for r in rows}:
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(sum(r.shard == s for r in rows)))
    assert sharding.shard(odd.where("false"), 3).count() == 0


def test_packing_ids_and_sequences(spark, odd):
    import public_tokenizers as P
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    t.encode_special_tokens = True
    w = packing.WordIds(P.path("word_bpe_49k.json"), 2)
    rnd = random.Random(3)
    for _ in range(300):
        x = "".join(rnd.choice("abcX'.,!?\n\x1c\x85 é각Σß①1<|endoftext|>") for _ in range(40))
        assert np.frombuffer(w.documents([x.encode()])[0], "<u4").tolist() == [*t.encode(x, add_special_tokens=False).ids, 2]
    for docs in (odd, odd.where("false")):
        rows = packing.pack(docs, P.path("word_bpe_49k.json"), length=64, block=100).collect()
        at = {}
        for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
            assert r.offset == at.get(r.sequence_id, 0)
            at[r.sequence_id] = r.offset + r.length
        assert all(n <= 64 for n in at.values())
        assert sum(at.values()) == sum(r.doc_tokens for r in rows if r.start == 0)


def test_importance_keeps_good_and_ties(spark):
    docs = spark.createDataFrame([(i, ("junk zzz " if i % 4 == 0 else "fine text here ") * 20) for i in range(200)], SCHEMA)
    labels = spark.createDataFrame([(i, int(i % 4 > 0), 0) for i in range(100)], "doc_id long, quality int, toxic int")
    kept = {r.doc_id for r in importance.resampled(docs, labels).collect()}
    assert all(i not in kept for i in range(0, 200, 4)) and len(kept) > 140
    assert importance.resampled(docs, labels.where("false")).count() == 200


def test_edit_embedding_walk_and_rows(odd):
    a = "the quick brown fox jumps over the lazy dog " * 20
    x, y, z = edit_embedding.fingerprints([a, a[:300] + "XYZ" + a[305:], a[::-1]])
    assert edit_embedding.likeness(x, y) > 0.9 > 0.3 > edit_embedding.likeness(x, z)
    got = edit_embedding.fingerprint_documents(odd).collect()
    assert len(got) == len(ODD) and {r.near_component for r in got if r.doc_id == 2} == {2}
    assert {r.near_component for r in got if r.fingerprint == ""} == {1}
    assert edit_embedding.fingerprint_documents(odd.where("false")).count() == 0


def test_edit_bands_brute_force(spark):
    rnd = random.Random(6)
    rows = []
    for i in range(30):
        base = "".join(rnd.choice("abcdefgh ") for _ in range(rnd.randint(200, 900)))
        for k in range(8):
            at = rnd.randrange(len(base))
            rows.append((8 * i + k, base[:at] + "zy" * rnd.randint(0, 3) + base[at + rnd.randint(0, 5) :]))
    # one crowded group, and a member of it that is like others but not like the first
    rows += [(1000 + k, rows[0][1][:150] + "xyz"[k % 3] * (k // 3 % 40) + rows[0][1][150:]) for k in range(120)]
    prints = edit_embedding.fingerprints([t for _, t in rows])
    low = {i: i for i, _ in rows}
    for _ in range(3):
        for (i, _), a in zip(rows, prints):
            for (j, _), b in zip(rows, prints):
                if low[i] != low[j] and edit_embedding.likeness(a, b) >= 0.8:
                    low[i] = low[j] = min(low[i], low[j])
    docs = spark.createDataFrame(rows, SCHEMA)
    packed = [(i, edit_embedding._packed(f), len(f)) for (i, _), f in zip(rows, prints)]
    distinct = spark.createDataFrame(packed, "node long, digits binary, n_digits int").dropDuplicates(["digits"])
    for crowded in (4096, 16):
        found = {r.node: r.component for r in edit_bands.near_components(distinct, common.Scratch(spark), crowded=crowded).collect()}
        assert all(low[a] == low[b] for a, b in found.items())
    got = {r.doc_id: r.near_component for r in edit_embedding.fingerprint_documents(docs).collect()}
    assert all(low[i] == low[c] for i, c in got.items())
    assert sum(got[i] == low[i] for i in low) >= 0.98 * len(low)


def test_quality_counts(spark, odd):
    got = {r.n_words: r.n_repeat_words for r in quality_rules.metrics(odd, stratum=None).collect()}
    assert got[66] == 66 and got[0] == 0 and got[2] == 0


def test_language(spark, odd):
    docs = spark.createDataFrame([("the and of this " * 9, "en"), ("der die das und " * 9, "de")] * 10, "text string, lang string")
    models = language.train(docs)
    got = language.identify(spark.createDataFrame([(1, "and the"), (2, "und das"), (3, "12!"), (4, None)], SCHEMA), models, "doc_id").collect()
    assert [r.lang_pred for r in sorted(got)] == ["en", "de", "und", "und"]


def test_pii_is_a_permutation_within_formats(spark):
    rows = [(i, t) for i, t in enumerate(["mail a.b1@x.example.com now", "4325404893167225", "4325404893167226", "+1 (389) 555-5010", "20.118.157.107.", "300.1.1.1", "2024-02-29", "2024-13-01", None, ""])]
    docs = spark.createDataFrame(rows + [(99, "4325404893167225")], SCHEMA)
    got = {r.doc_id: r.text for r in pii.pseudonymise(docs, "k").collect()}
    assert [got[i] == t for i, t in rows] == [False, False, True, False, False, True, False, True, True, True]
    assert got[99] == got[1] and len(got[1]) == 16 and got[6][4] == "-"
    assert zlib.crc32(b"") == 0


def test_pii_long_secrets_and_far_dates(spark):
    rnd = random.Random(12)
    secret = "".join(rnd.choice("0123456789abcdef") for _ in range(300))
    rows = [(0, secret), (1, "1815-06-18"), (2, "2150-01-01"), (3, "0001-01-01"), (4, "9999-12-31"), (5, "1815-02-30")]
    got = {r.doc_id: r.text for r in pii.pseudonymise(spark.createDataFrame(rows, SCHEMA), "k").collect()}
    assert len(got[0]) == 300 and set(got[0]) <= set("0123456789abcdef")
    assert all(got[0][at : at + 32] != secret[at : at + 32] for at in range(0, 300, 32))
    assert len({got[i] for i in range(1, 5)}) == 4 and got[5] == "1815-02-30"
    assert all(got[i] != t and len(got[i]) == 10 and not "1900" <= got[i][:4] <= "2099" for i, t in rows[1:5])
