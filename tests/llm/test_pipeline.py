"""The whole pipeline against a plain version: pairs of sets, windows in a dictionary, texts encoded whole by the library."""

import re
import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from bookfold.llm import importance, pii, simhash

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def near_kept(rows):
    """Of each component of sets at 0.8 the document with the smallest id."""
    sets = {i: set(simhash.shingle_set((t or "").encode()).tolist()) for i, t in rows}
    low = {i: i for i in sets}

    def root(x):
        while low[x] != x:
            x = low[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            both = len(sets[a] & sets[b])
            if (both >= 0.8 * len(sets[a] | sets[b])) if sets[a] or sets[b] else True:
                x, y = sorted((root(a), root(b)))
                low[y] = x
    return {i for i in ids if root(i) == i}


def without_repeats(rows):
    """Texts with removed intervals as one space, what is between kept words as it was."""
    seen, out = {}, {}
    words = {i: list(WORD.finditer(t or "")) for i, t in rows}
    for i in sorted(words):
        for k in range(len(words[i]) - 19):
            seen.setdefault(tuple(m.group() for m in words[i][k : k + 20]), (i, k))
    for i, ms in words.items():
        gone = set()
        for k in range(len(ms) - 19):
            if seen[tuple(m.group() for m in ms[k : k + 20])] < (i, k):
                gone |= set(range(k, k + 20))
        out[i] = [m.group() for k, m in enumerate(ms) if k not in gone]
    return out


def test_whole_pipeline(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    drawn = [(r.doc_id, r.text) for r in importance.importance_resample(docs, labels).where("kept").select("doc_id", "text").collect()]
    texts = dict(drawn)
    kept = near_kept(drawn)
    assert 0 < len(kept) < len(drawn) < docs.count()
    words = without_repeats([(i, texts[i]) for i in kept])
    found = corpus_pipeline.substring_dedup(spark, docs.where(docs.doc_id.isin(sorted(kept))), SF)
    rest = {r.doc_id: r.text for r in found.select("doc_id", "text").collect()}
    assert {i: WORD.findall(t or "") for i, t in rest.items()} == words and any(len(w) < len(WORD.findall(texts[i])) for i, w in words.items())
    last = {r.doc_id: r.text for r in pii.pseudonymise(spark.createDataFrame([*rest.items()], "doc_id long, text string"), corpus_pipeline.PII_KEY).collect()}
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    ids = {i: np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 2], "<u4") for i, t in last.items()}
    pieces = corpus_pipeline.run(spark, SF).collect()
    assert {r.doc_id for r in pieces} == kept
    assert all(r.doc_tokens == len(ids[r.doc_id]) and r.ids_crc32 == zlib.crc32(ids[r.doc_id][r.start : r.start + r.length].tobytes()) for r in pieces)
    for i in kept:
        own = sorted((r.start, r.length) for r in pieces if r.doc_id == i)
        assert [s for s, _ in own] == [0, *np.cumsum([n for _, n in own])[:-1]] and sum(n for _, n in own) == len(ids[i])
    for s in {r.sequence_id for r in pieces}:
        own = sorted((r.offset, r.length) for r in pieces if r.sequence_id == s)
        assert [o for o, _ in own] == [0, *np.cumsum([n for _, n in own])[:-1]] and sum(n for _, n in own) <= 4096
