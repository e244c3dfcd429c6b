"""Packing: order-preserving dynamic programming over cut points, with a monotone queue.

Documents are joined in the order of their partition into one stream of ids. A sequence is a stretch of
at most ``length`` ids between two cut points: document ends, sentence ends and, where neither comes
for long, fixed points inside a sentence. The chosen cuts minimise padding plus a penalty for each cut
inside a document. f(j) = penalty(j) + min over i in (j - length .. j) of f(i) + padding(j - i); since
padding is length - (j - i) but for powers of two, the minimum of f(i) + i over a sliding window
serves, and the powers of two are looked up."""

from __future__ import annotations

import re
import zlib
from array import array
from collections import deque
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import by_bytes, table, text_bytes, thrifty

#: Costs in padding tokens of a cut at a sentence end and of one inside a sentence.
SENTENCE, INSIDE = 2.0, 16.0
#: A stretch of more than length / SPARSE ids without a sentence end gets cut points at every length / GRID ids.
SPARSE, GRID = 8, 32
#: Ids of one dynamic programme; the open end of one is the start of the next.
BLOCK = 1 << 20
#: Words whose ids are remembered from one batch to the next at most. Part of their memory stays with the Python worker.
WORDS_HELD = 300_000
_SEPARATORS = re.compile("[\x1c-\x1f]")
_WORD = re.compile("[^\t-\r \x85\xa0  -     　]+")


#: The tokenizer file's own pattern.
_PIECE = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
#: Marks a word's end in bytes, where the vocabulary has </w>; no UTF-8 text holds this byte.
_END = b"\xff"


def _byte_letters() -> dict[str, int]:
    """The letter that a byte-level vocabulary writes for each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class WordIds:
    """Ids of a tokenizer that drops white space and never joins words across it, remembered by word.

    Words of Latin letters are merged by ranks; in this vocabulary the order of ids is that of the merges.
    All others go to the tokenizer itself.
    """

    def __init__(self, path: str, end_id: int):
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        self._tokenizer.encode_special_tokens = True
        self._known: dict[str, bytes] = {}
        self._pieces: dict[str, bytes] = {}
        self._end = np.array([end_id], "<u4").tobytes()
        vocabulary = self._tokenizer.get_vocab(with_added_tokens=False)
        self.ends_sentence = np.zeros(self._tokenizer.get_vocab_size(), bool)
        letters, ranks = _byte_letters(), {}
        for text, i in vocabulary.items():
            own = text.removesuffix("</w>")
            self.ends_sentence[i] = bool(own) and not own.strip(".!?")
            if all(c in letters for c in own):
                ranks[bytes(map(letters.__getitem__, own)) + _END * (own != text)] = i
        self._merge = tiktoken.Encoding("words", pat_str=".", mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece

    def _word(self, word: str) -> bytes:
        if max(word) >= "\u0250":
            return np.array(self._tokenizer.encode(word, add_special_tokens=False).ids, "<u4").tobytes()
        low = word.lower()
        known = self._pieces
        out = []
        for p in [low] if low.isalpha() else _PIECE.findall(low):
            ids = known.get(p)
            if ids is None:
                ids = known[p] = array("I", self._merge(p.encode() + _END)).tobytes()
            out.append(ids)
        return b"".join(out)

    def forget(self) -> None:
        """Let go of the words seen, so that a worker that waits for its next task holds the vocabulary only."""
        self._known.clear()
        self._pieces.clear()

    def documents(self, texts: list[bytes | None], words_held: int = WORDS_HELD) -> list[bytes]:
        """Ids of each text and the end id, as little-endian 32-bit integers."""
        for kept in (self._known, self._pieces):
            if len(kept) > words_held:
                kept.clear()
        known, out = self._known, []
        for t in texts:
            text = t.decode() if t else ""
            words = _WORD.findall(text) if _SEPARATORS.search(text) else text.split()
            ids = list(map(known.get, words))
            if None in ids:
                for k, (w, x) in enumerate(zip(words, ids)):
                    if x is None:
                        x = known.get(w)
                        if x is None:
                            x = known[w] = self._word(w)
                        ids[k] = x
            ids.append(self._end)
            out.append(b"".join(ids))
        return out


@lru_cache(maxsize=2)
def _word_ids(path: str, end_id: int) -> WordIds:
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return WordIds(path, end_id)


def cut_points(ids: np.ndarray, doc_ends: np.ndarray, ends_sentence: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions (0 and the end included) and penalties of the allowed cuts."""
    sentence = np.flatnonzero(ends_sentence[ids]) + 1
    points = np.unique(np.concatenate([[0], sentence, doc_ends, [len(ids)]]))
    gaps = np.diff(points)
    wide = np.flatnonzero(gaps > length // SPARSE)
    step = max(1, length // GRID)
    grid = [np.arange(points[i] + step, points[i + 1], step) for i in wide.tolist()]
    inside = np.concatenate([*grid, np.empty(0, np.int64)]).astype(np.int64)
    points = np.concatenate([points, inside])
    cost = np.concatenate([np.full(len(points) - len(inside), SENTENCE), np.full(len(inside), INSIDE)])
    order = np.argsort(points, kind="stable")
    points, cost = points[order], cost[order]
    cost[np.isin(points, doc_ends)] = 0.0
    cost[0] = 0.0
    return points, cost


def cheapest_cuts(points: np.ndarray, cost: np.ndarray, length: int, last: bool) -> list[int]:
    """The chosen cuts from 0 on. Unless ``last``, they may end up to ``length`` before the end.

    With ``last`` no other choice of the points costs less; ids after the last chosen point may also be cut into powers
    of two anywhere, at ``INSIDE`` each, where that costs less still."""
    n = len(points)
    f, g, back = [0.0] * n, [0.0] * n, [0] * n
    exact: dict[int, list[int]] = {}
    for power in (1 << k for k in range(length.bit_length())):
        if power < length:
            at = np.searchsorted(points, points - power)
            hit = np.flatnonzero((points >= power) & (points[np.minimum(at, n - 1)] == points - power))
            for j, i in zip(hit.tolist(), at[hit].tolist()):
                exact.setdefault(j, []).append(i)
    where, price = points.tolist(), cost.tolist()
    queue = deque([0])
    g[0] = float(where[0])
    for j in range(1, n):
        p = where[j]
        low = p - length
        while where[queue[0]] < low:
            queue.popleft()
        i = queue[0]
        best = g[i] + length - p
        for k in exact.get(j, ()):
            if f[k] < best:
                i = k
                best = f[k]
        f[j] = best + price[j]
        back[j] = i
        g[j] = f[j] + p
        while queue and g[queue[-1]] >= g[j]:
            queue.pop()
        queue.append(j)
    end = where[-1]
    tail: list[int] = []
    first = int(np.searchsorted(points, end - length))
    if last:
        def rest(i: int) -> float:
            left = end - where[i]
            return f[i] + min(float(length - left) if left else 0.0, INSIDE * (left.bit_count() - 1) if left else 0.0)

        j = min(range(first, n), key=rest)
        left, at = end - where[j], where[j]
        if left and INSIDE * (left.bit_count() - 1) < length - left:
            for bit in reversed(range(left.bit_length())):
                if left >> bit & 1:
                    at += 1 << bit
                    tail.append(at)
        elif left:
            tail.append(end)
    else:
        j = min(range(max(1, first), n), key=f.__getitem__)
    cuts = []
    while j > 0:
        cuts.append(where[j])
        j = back[j]
    return [0, *reversed(cuts), *tail]


def _packer(path: str, end_id: int, length: int, block: int, words_held: int = WORDS_HELD):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _word_ids(path, end_id)
        context = TaskContext.get()
        base = (context.partitionId() if context else 0) << 36
        made = 0
        # of the open stream: ids, and for each document its id, its ids before the stream, its ids in it
        stream, docs, held = [], deque(), 0

        def flush(last: bool) -> pa.RecordBatch:
            nonlocal stream, held, made
            raw = b"".join(stream)
            ids = np.frombuffer(raw, "<u4")
            doc_ends = np.cumsum([d[2] for d in docs])
            cuts = cheapest_cuts(*cut_points(ids, doc_ends, words.ends_sentence, length), length, last)
            view, out = memoryview(raw), []
            for a, b in zip(cuts, cuts[1:]):
                at = a
                while at < b:
                    doc, before, n, total = docs[0]
                    k = min(n, b - at)
                    out.append((doc, before, k, zlib.crc32(view[4 * at : 4 * (at + k)]), total, base + made, at - a))
                    if k == n:
                        docs.popleft()
                    else:
                        docs[0] = (doc, before + k, n - k, total)
                    at += k
                made += 1
            stream, held = [raw[4 * cuts[-1] :]], len(ids) - cuts[-1]
            columns = list(zip(*out)) or [[]] * 7
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

        for b in by_bytes(batches, 1, 2 << 20):
            for doc, ids in zip(b.column(0).to_pylist(), words.documents(b.column(1).to_pylist(), words_held)):
                stream.append(ids)
                docs.append((doc, 0, len(ids) // 4, len(ids) // 4))
                held += len(ids) // 4
            if held >= block:
                yield flush(False)
        if held:
            yield flush(True)
        words.forget()
        if words_held < WORDS_HELD:
            _word_ids.cache_clear()  # where memory is short, the tokenizer goes as well

    return run


def pack(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 2, length: int = 4096, block: int = BLOCK, words_held: int = WORDS_HELD) -> DataFrame:
    """Pack documents into sequences of at most ``length`` ids; a row for each piece of a document.

    A document is its text's ids (no special tokens; null: none) and ``end_id``. Returns ``doc_id, start``
    (its document's ids before it), ``length, ids_crc32, doc_tokens, sequence_id, offset`` (in the
    sequence). Documents keep the order of their partition and each partition packs its own, so no row
    moves; the last sequences of a partition are cut to powers of two, which need no padding, where that
    costs less. Within a partition the cuts are the cheapest of all choices of cut points but for where one block of
    ``block`` ids hands over to the next. Very long texts are cut like others. Null and repeated ids and repeated rows are documents like others; other columns are not
    read; an empty table gives none.
    """
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_bytes(text_col).alias("text"))
    return own.mapInArrow(thrifty(_packer(path, end_id, length, block, words_held)), "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")


def padding(pieces: DataFrame, length: int = 4096) -> DataFrame:
    """``sequences, ids, padding``: a sequence is padded to ``length`` unless its ids are a power of two."""
    sizes = pieces.groupBy("sequence_id").agg(F.sum("length").alias("n"))
    pad = F.when(F.bit_count("n") == 1, 0).otherwise(length - F.col("n"))
    return sizes.agg(F.count("*").alias("sequences"), F.sum("n").alias("ids"), F.sum(pad).alias("padding"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
