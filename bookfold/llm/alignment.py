"""Cross-tokenizer alignment: a postings cogroup over the tokens of two tokenizers.

Both tokenizers encode a text; byte offsets where tokens of both end cut them into groups, and the two tokens that end
there are linked. How often a pair of ids is linked in the corpus decides how a document's links look: each document's
pairs with their multiplicities are shuffled by the second tokenizer's id, together with the counted pairs of that id.
In a task both come as sorted streams: an id's counts (at most one per id of the first tokenizer) first, then the
postings, which are never held. A task sends what it adds to the documents of a block, and these are summed by document.
Ids are dealt over slices of equal numbers of postings by prefix sums, so a frequent id spans several slices."""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator
from contextlib import contextmanager
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructType

from .common import Scratch, by_bytes, table, text_bytes, thrifty

#: A unit of a text: both tokenizers cut before a space or a line's end that follows no white space.
_UNIT = re.compile(r"\s*\S+(?:[^\S \n]\s*(?:\S+|\Z))*|\s+")
#: Units that a worker remembers, and characters up to which it does.
UNITS_HELD, _SHORT = 250_000, 48
#: Postings of a slice, at most, and distinct pairs that a task counts at once.
SLICE, _PAIRS = 4_000_000, 1_000_000
#: Bytes of an Arrow batch for Python; Spark's own bound is 10,000 rows, whatever they hold.
BATCH = "4m"
_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"
#: An id pair as one number: the first tokenizer's id times this, plus the second's.
_SECOND = 1 << 20


@contextmanager
def small_batches(spark: SparkSession):
    before = spark.conf.get(_BYTES, None)
    spark.conf.set(_BYTES, BATCH)
    try:
        yield
    finally:
        spark.conf.unset(_BYTES) if before is None else spark.conf.set(_BYTES, before)


def _byte_letters() -> dict[str, int]:
    """The letters that byte-level vocabularies write bytes as: printable ones as themselves, the rest from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Aligner:
    """Tokens and links of units, which it remembers."""

    def __init__(self, path_a: str, path_b: str):
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self._a = Tokenizer.from_file(path_a)
        self._a.encode_special_tokens = True
        self._b = SentencePieceProcessor(model_file=path_b)
        letters = _byte_letters()
        self._bytes_a = {i: bytes(letters[c] for c in piece) for piece, i in self._a.get_vocab(with_added_tokens=False).items()}
        pieces = [self._b.id_to_piece(i) for i in range(self._b.get_piece_size())]
        self._bytes_b = [bytes([int(p[3:5], 16)]) if self._b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self._lengths_a, self._lengths_b = np.zeros(max(self._bytes_a) + 1, np.int64), np.fromiter(map(len, self._bytes_b), np.int64)
        for i, x in self._bytes_a.items():
            self._lengths_a[i] = len(x)
        # ids as text with what follows them within a group and at the end of its side
        self._shown = np.array([f"{i}{c}" for n, end in ((len(self._lengths_a), "|"), (len(self._lengths_b), ";")) for i in range(n) for c in (",", end)], object)
        self._space = self._b.piece_to_id("▁")
        # the cuts hold if no piece goes on with a space or a line's end after something else
        self._whole = any("▁" in p.lstrip("▁") or "\n" in p for p in pieces)
        self._known: dict[str, int] = {}
        self._clear()

    def _clear(self) -> None:
        self._known.clear()
        self._groups: list[str | None] = []
        self._sizes = np.zeros((0, 3), np.int64)  # tokens of both, links
        self._starts, self._links = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _second(self, units: list[str]) -> list[list[int]]:
        """Ids of the second tokenizer, which puts a space before what it encodes."""
        found = self._b.encode([u[1:] if u[0] == " " else u for u in units], num_threads=1)
        return [(ids or [self._space]) if u[0] == " " else ids[1:] for u, ids in zip(units, found)]

    def _fits(self, unit: str, a: list[int], b: list[int]) -> bool:
        raw = unit.encode()
        return b"".join([self._bytes_b[i] for i in b]) == raw and b"".join([self._bytes_a[i] for i in a]) == raw

    def _learn(self, units: list[str]) -> None:
        first, second = [e.ids for e in self._a.encode_batch_fast(units, add_special_tokens=False)], self._second(units)
        bad = []
        raw = "".join(units).encode()
        if any(b"".join(map(known.__getitem__, chain.from_iterable(ids))) != raw for known, ids in ((self._bytes_a, first), (self._bytes_b, second))):
            bad = [k for k, x in enumerate(zip(units, first, second)) if not self._fits(*x)]
            for k in bad:
                first[k] = second[k] = []
        n = [np.fromiter(map(len, ids), np.int64, len(units)) for ids in (first, second)]
        a, b = (np.fromiter(chain.from_iterable(ids), np.int64, int(k.sum())) for ids, k in zip((first, second), n))
        ends_a, ends_b = np.cumsum(self._lengths_a[a]), np.cumsum(self._lengths_b[b])
        ends = np.intersect1d(ends_a, ends_b, assume_unique=True)
        last_a, last_b = np.searchsorted(ends_a, ends), np.searchsorted(ends_b, ends)
        links = a[last_a] * _SECOND + b[last_b]
        own = np.diff(np.searchsorted(last_a, np.cumsum(n[0])), prepend=0)
        # all tokens in the order of the text of the groups, each with what follows it
        order = np.argsort(np.concatenate([np.searchsorted(ends, ends_a) * 2, np.searchsorted(ends, ends_b) * 2 + 1]), kind="stable")
        shown = np.concatenate([a * 2, 2 * len(self._lengths_a) + b * 2])
        shown[last_a] += 1
        shown[len(a) + last_b] += 1
        parts = self._shown[shown[order]].tolist()
        stop = np.cumsum(n[0] + n[1]).tolist()
        groups: list[str | None] = ["".join(parts[i:j])[:-1] for i, j in zip([0, *stop], stop)]
        for k in bad:
            groups[k] = None
        self._starts = np.concatenate([self._starts, len(self._links) + np.cumsum(own) - own])
        self._links = np.concatenate([self._links, links])
        self._sizes = np.concatenate([self._sizes, np.stack([*n, own], 1)])
        self._groups += groups

    def texts(self, texts: list[bytes | None]) -> tuple[np.ndarray, list[str], np.ndarray, np.ndarray]:
        """For each text its tokens in both and its links, and its groups; all links as text and pair."""
        if len(self._known) > UNITS_HELD:
            self._clear()
        known = self._known
        docs = [([" " + t.decode()] if self._whole else _UNIT.findall(" " + t.decode())) if t else [] for t in texts]
        new = list({u for d in docs for u in d}.difference(known))
        if new:
            known.update(zip(new, range(len(self._groups), len(self._groups) + len(new))))
            for at in range(0, len(new), 20_000):
                self._learn(new[at : at + 20_000])
        counts, groups, kept = np.zeros((len(docs), 3), np.int64), [], []
        for k, d in enumerate(docs):
            at = np.fromiter(map(known.__getitem__, d), np.int64, len(d))
            parts = [self._groups[i] for i in at]
            if None in parts:
                at, parts = at[:0], []
            counts[k] = self._sizes[at].sum(axis=0)
            groups.append(";".join(parts))
            kept.append(at)
        units = np.concatenate([*kept, np.zeros(0, np.int64)])
        n = self._sizes[units, 2]
        links = self._links[np.repeat(self._starts[units] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))]
        for u in new:
            if len(u) > _SHORT:
                del known[u]
        return counts, groups, np.repeat(np.arange(len(docs)), counts[:, 2]), links


@lru_cache(maxsize=1)
def aligner(path_a: str, path_b: str) -> Aligner:
    return Aligner(path_a, path_b)


def _lists(values: np.ndarray, sizes: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.array(values))


def aligned(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text", digest: bool = False) -> DataFrame:
    """``doc_id, n_a, n_b, n_groups, n_links, groups, pairs, times`` for every row of ``docs``.

    ``groups`` is text such as ``1,2|1;3|2,3`` (``digest``: its SHA-256, of texts with tokens), ``pairs`` the distinct
    linked pairs (first id times 2 ** 20, plus the second) and ``times`` how often each is linked there.
    Null and empty texts, and those whose tokens don't give back a space and the text, have no tokens.
    """
    schema = StructType([docs.select(F.col(f"`{id_col}`").alias("doc_id")).schema[0]])
    for name in ("n_a", "n_b", "n_groups", "n_links"):
        schema.add(name, LongType())
    schema.add("groups", StringType()).add("pairs", ArrayType(LongType())).add("times", ArrayType(IntegerType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = aligner(path_a, path_b)
        for b in by_bytes(batches, 1, 2 << 20):
            counts, groups, doc, links = tokens.texts(b.column(1).to_pylist())
            order = np.lexsort((links, doc))
            doc, links = doc[order], links[order]
            first = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (links[1:] != links[:-1])])) if len(doc) else np.zeros(0, np.int64)
            sizes = np.bincount(doc[first], minlength=b.num_rows)
            times = np.diff(np.append(first, len(doc))).astype(np.int32)
            shown = [hashlib.sha256(g.encode()).hexdigest() if g and digest else g for g in groups]
            n = [pa.array(counts[:, k]) for k in (0, 1, 2, 2)]
            yield pa.RecordBatch.from_arrays([b.column(0), *n, pa.array(shown, pa.string()), _lists(links[first], sizes), _lists(times, sizes)], names=schema.names)

    return docs.select(F.col(f"`{id_col}`"), text_bytes(f"`{text_col}`")).mapInArrow(thrifty(run), schema)


def _tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows ``pairs, times`` each pair's links and postings in a task."""
    keys, links, rows, n = [], [], [], 0

    def sums() -> None:
        key, at = np.unique(np.concatenate(keys), return_inverse=True)
        both = [np.bincount(at, np.concatenate(x), len(key)).astype(np.int64) for x in (links, rows)]
        keys[:], links[:], rows[:] = [key], [both[0]], [both[1]]

    def flush() -> pa.RecordBatch:
        sums()
        return pa.RecordBatch.from_arrays([pa.array(keys[0] // _SECOND), pa.array(keys[0] % _SECOND), pa.array(links[0]), pa.array(rows[0])], names=["a", "b", "links", "postings"])

    for b in batches:
        key = b.column(0).flatten().to_numpy()
        keys.append(key)
        links.append(b.column(1).flatten().to_numpy())
        rows.append(np.ones(len(key), np.int64))
        n += len(key)
        if n > 4 * _PAIRS:
            sums()
            n = len(keys[0])
            if n > _PAIRS:
                yield flush()
                keys, links, rows, n = [], [], [], 0
    if keys:
        yield flush()


def pair_counts(docs: DataFrame) -> DataFrame:
    """``a, b, links, postings, best`` of the pairs in ``docs`` (``pairs, times``): how many links have the pair, how
    many rows, and whether no pair of the same ``b`` has more links. A ``b`` has at most one row per id of the first
    tokenizer, which bounds what the window holds."""
    counts = docs.select("pairs", "times").mapInArrow(thrifty(_tally), "a long, b long, links long, postings long")
    counts = counts.groupBy("a", "b").agg(F.sum("links").alias("links"), F.sum("postings").alias("postings"))
    return counts.withColumn("best", F.col("links") == F.max("links").over(Window.partitionBy("b")))


class Slices:
    """Which slices have the postings of each id: prefix sums of the ids' postings, cut at equal targets."""

    def __init__(self, ids: np.ndarray, postings: np.ndarray, slices: int):
        ends = np.cumsum(postings)
        total = max(1, int(ends[-1]) if len(ends) else 1)
        scale = slices / total
        self.first, self.width = np.zeros(_SECOND, np.int64), np.ones(_SECOND, np.int64)
        self.first[ids] = np.minimum((ends - postings) * scale, slices - 1).astype(np.int64)
        self.width[ids] = np.minimum((ends - 1) * scale, slices - 1).astype(np.int64) - self.first[ids] + 1

    def of(self, rows: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The slice of a posting: one of its id's, by a hash of its row."""
        mixed = (rows.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)
        return self.first[b] + (mixed % self.width[b].astype(np.uint64)).astype(np.int64)


#: Rows of a block, whose sums are one array.
_BLOCK = 1 << 10
_STREAM = "slice int, kind int, block long, keys array<bigint>, pairs array<bigint>, times array<int>"
_SUMS = "block long, rows array<bigint>, n_best array<bigint>, count_sum array<bigint>"


def _stream(kind: int, where: np.ndarray, block: np.ndarray, keys: np.ndarray, pairs: np.ndarray, times: np.ndarray) -> pa.RecordBatch:
    """A row for each slice and block of what is in it."""
    order = np.lexsort((block, where))
    where, block = where[order], block[order]
    start = np.flatnonzero(np.append(True, (where[1:] != where[:-1]) | (block[1:] != block[:-1])))
    sizes = np.diff(np.append(start, len(where)))
    lists = [_lists(x[order], sizes) for x in (keys.astype(np.int64), pairs.astype(np.int64), times.astype(np.int32))]
    return pa.RecordBatch.from_arrays([pa.array(where[start].astype(np.int32)), pa.array(np.full(len(start), kind, np.int32)), pa.array(block[start].astype(np.int64)), *lists], names=["slice", "kind", "block", "keys", "pairs", "times"])


def _contributions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What the postings of a task's slices add to the rows of a block; a slice's counted pairs come first."""
    now, counted, pairs, links, best = None, [], None, None, None
    for batch in batches:
        for s, kind, block, k, p, t in zip(*[c.to_pylist() for c in batch.columns[:3]], *batch.columns[3:]):
            k, p, t = (x.values.to_numpy(zero_copy_only=False) for x in (k, p, t))
            if s != now:
                now, counted, pairs = s, [], None
            if kind == 0:
                counted.append((p, k, t))
                continue
            if pairs is None:
                pairs, links, best = (np.concatenate(x) for x in zip(*counted))
                order = np.argsort(pairs)
                pairs, links, best, counted = pairs[order], links[order], best[order], []
            at = np.searchsorted(pairs, p)
            start = np.flatnonzero(np.append(True, k[1:] != k[:-1]))
            sums = (k[start], np.add.reduceat(t * best[at].astype(np.int64), start), np.add.reduceat(t * links[at], start))
            yield pa.RecordBatch.from_arrays([pa.array([block]), *[_lists(x, np.array([len(x)])) for x in sums]], names=["block", "rows", "n_best", "count_sum"])


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The sums of each row of a block; blocks come one after another."""
    now, sums = None, None

    def done() -> pa.RecordBatch:
        some = np.flatnonzero(sums[2])
        return pa.RecordBatch.from_arrays([pa.array(some + now * _BLOCK), pa.array(sums[0, some]), pa.array(sums[1, some])], names=["row", "n_best", "count_sum"])

    for batch in batches:
        for block, rows, best, total in zip(batch.column(0).to_pylist(), *batch.columns[1:]):
            if block != now:
                if now is not None:
                    yield done()
                now, sums = block, np.zeros((3, _BLOCK), np.int64)
            at = rows.values.to_numpy() - block * _BLOCK
            sums[:, at] += np.stack([best.values.to_numpy(), total.values.to_numpy(), np.ones(len(at), np.int64)])
    if now is not None:
        yield done()


def link_sums(docs: DataFrame, counts: DataFrame) -> DataFrame:
    """``row, n_best, count_sum`` of ``docs`` (``row, pairs, times``) by the counted pairs of ``counts``: how many of a
    row's links have a pair that is ``best``, and the sum of the pairs' links over its links."""
    spark = docs.sparkSession
    # a row per id of the second tokenizer: bounded by its vocabulary
    per = counts.groupBy("b").agg(F.sum("postings").alias("n")).orderBy("b").toArrow()
    ids, n = per.column("b").to_numpy(), per.column("n").to_numpy()
    slices = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-int(n.sum()) // SLICE))
    shared = spark.sparkContext.broadcast(Slices(ids, n, slices))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            pairs = b.column(1).flatten().to_numpy()
            keys = np.repeat(b.column(0).to_numpy(), b.column(1).value_lengths().to_numpy())
            if len(keys):
                yield _stream(1, shared.value.of(keys, pairs % _SECOND), keys // _BLOCK, keys, pairs, b.column(2).flatten().to_numpy())

    def copy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            a, second, links, best = (c.to_numpy(zero_copy_only=False) for c in b.columns)
            width = shared.value.width[second]
            each = np.repeat(np.arange(len(a)), width)
            step = np.arange(len(each)) - np.repeat(np.cumsum(width) - width, width)
            if len(each):
                yield _stream(0, shared.value.first[second[each]] + step, np.zeros(len(each), np.int64), links[each], (a * _SECOND + second)[each], best[each])

    both = counts.select("a", "b", "links", "best").mapInArrow(copy, _STREAM).unionByName(docs.select("row", "pairs", "times").mapInArrow(deal, _STREAM))
    found = both.repartition(slices, "slice").sortWithinPartitions("slice", "kind").mapInArrow(thrifty(_contributions), _SUMS)
    return found.repartition("block").sortWithinPartitions("block").mapInArrow(_added, "row long, n_best long, count_sum long")


def align(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text", digest: bool = False) -> DataFrame:
    """``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups`` for every row of ``docs``; ``groups`` as in ``aligned``.

    ``n_best`` counts a row's links whose pair is the corpus-wide most frequent of its second id (ties included),
    ``count_sum`` adds up how often the pair of each of its links is linked in the corpus. Rows with null and repeated ids
    and repeated rows stay, each on its own, and all count; texts of any length are encoded whole; an empty table
    gives no rows; further columns, whatever their names, are not read.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark)
    with small_batches(spark):
        rows = scratch.keep(aligned(docs, path_a, path_b, id_col, text_col, digest).withColumn("row", F.monotonically_increasing_id()))
        counts = scratch.keep(pair_counts(rows))
        sums = scratch.keep(link_sums(rows, counts))
    none = F.lit(0).cast("long")
    out = rows.join(sums, "row", "left")
    return out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", F.coalesce("n_best", none).alias("n_best"), F.coalesce("count_sum", none).alias("count_sum"), "groups")


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    found = align(table(spark, sf_dir, "documents").select("doc_id", "text"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"), digest=True)
    return found.withColumn("doc_id", F.col("doc_id").cast("long")).withColumnRenamed("groups", "groups_sha256")
