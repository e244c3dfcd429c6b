"""Alignment of two tokenizers against whole texts encoded by the libraries."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from bookfold.llm import alignment

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
ODD = [
    "", " ", "  ", "\n", "\n\n", "\t", "a", " a", "a ", "a  ", "a \n", "a\n ", "x\r\ny", "x;\r\n\r\ny\r", "foo\tbar\t", "foo\t \nbar", "a　b", "a  b", "\x00a\x00", "<s> </s> <unk> <0x41> <|endoftext|>",
    "x▁y", "▁", "\U0001f600\U0001f469‍\U0001f680 café café", "it's they'll 'twas I'd", "\x1c\x1d a\x1cb ", "1234567 12,345.67", "日本語のテキスト 中文", "   indented\n        more\n\t\ttabs", "..... !!! ???\n---\n", "a\x85b c d",
]


def brute(rows):
    a_tok = Tokenizer.from_file(A)
    a_tok.encode_special_tokens = True
    b_tok = SentencePieceProcessor(model_file=B)
    letters = alignment._byte_letters()
    names = {i: bytes(letters[c] for c in p) for p, i in a_tok.get_vocab(with_added_tokens=False).items()}

    def b_bytes(i):
        p = b_tok.id_to_piece(i)
        return bytes([int(p[3:5], 16)]) if len(p) == 6 and p.startswith("<0x") and p[5] == ">" else p.replace("▁", " ").encode()

    docs, counts = [], {}
    for key, text in rows:
        a = a_tok.encode(" " + text, add_special_tokens=False).ids if text else []
        b = b_tok.encode(text) if text else []
        raw = (" " + text).encode() if text else b""
        if b"".join(names[i] for i in a) != raw or b"".join(map(b_bytes, b)) != raw:
            a, b = [], []
        ends_a, ends_b = np.cumsum([len(names[i]) for i in a]).tolist(), np.cumsum([len(b_bytes(i)) for i in b]).tolist()
        groups, links, p, q = [], [], 0, 0
        for end in sorted(set(ends_a) & set(ends_b)):
            i, j = ends_a.index(end, p) + 1, ends_b.index(end, q) + 1
            groups.append(f"{','.join(map(str, a[p:i]))}|{','.join(map(str, b[q:j]))}")
            links.append((a[i - 1], b[j - 1]))
            p, q = i, j
        for x in links:
            counts[x] = counts.get(x, 0) + 1
        docs.append((key, a, b, groups, links))
    most = {}
    for (_, j), n in counts.items():
        most[j] = max(most.get(j, 0), n)
    return sorted((str(k), len(a), len(b), len(g), len(li), sum(counts[x] == most[x[1]] for x in li), sum(counts[x] for x in li), hashlib.sha256(";".join(g).encode()).hexdigest() if a else "") for k, a, b, g, li in docs)


@pytest.mark.parametrize("small", [False, True])
def test_alignment_equals_whole_encodings(spark, monkeypatch, small):
    if small:
        for name, value in {"SLICE": 40, "_PAIRS": 10, "UNITS_HELD": 20, "_SHORT": 4}.items():
            monkeypatch.setattr(alignment, name, value)
        alignment.aligner.cache_clear()
    rnd = random.Random(5)
    words = ["the", "strange", "Überraschung", "été", "don't", "x=1;", "\r", "\n", "\n\n", "\t", "  ", "naïve", "1999", "…", "antidisestablishmentarianism", "­", "é", "%%%"]
    texts = ODD + [rnd.choice(["", " "]).join(rnd.choices(words, k=rnd.randint(1, 60))) for _ in range(60)] + ["the " * 9000, "ab" * 5000]
    rows = [(i, t) for i, t in enumerate(texts)] + [(1, None), (None, "the strange"), (None, "the strange"), (3, texts[40]), (3, texts[40])]
    docs = spark.createDataFrame([(a, b, 1) for a, b in rows], "doc_id long, text string, `pairs` int").repartition(3)
    got = alignment.align(docs, A, B, digest=True)
    assert sorted((str(r.doc_id), *r[1:]) for r in got.collect()) == brute(rows)
    alignment.aligner.cache_clear()


def test_groups_as_text_and_nothing(spark):
    docs = spark.createDataFrame([(1, "hello wörld")], "doc_id long, text string")
    text = alignment.align(docs, A, B).first().groups
    assert hashlib.sha256(text.encode()).hexdigest() == alignment.align(docs, A, B, digest=True).first().groups and "|" in text
    assert alignment.align(docs.where("false"), A, B).count() == 0


def test_slices_share_frequent_ids_evenly():
    n = np.array([10, 100_000, 3, 50_000, 7])
    s = alignment.Slices(np.arange(5), n, 30)
    rows = np.arange(100_000)
    found = np.bincount(np.concatenate([s.of(rows[:k], np.full(k, i)) for i, k in enumerate(n)]), minlength=30)
    # the slice where one id ends and the next begins has a share of both
    assert found.max() < 2.1 * n.sum() / 30 and found.min() > 0.5 * n.sum() / 30
