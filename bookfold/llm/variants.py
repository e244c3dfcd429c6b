"""Spelling variant grouping: words one edit apart, by a positional q-gram inverted index with a count filter.

A word's postings are its rarest ``GRAM + 1`` q-grams with their positions: one edit destroys at most ``GRAM`` of
a word's q-grams, so two words one edit apart share one of these, at the same place or (in the longer word) the next.
Postings are shuffled by gram and length; each list is merged with those that the length and position limits allow,
pairs stay whose number of common positional q-grams reaches the one-edit bound, and these are verified."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import HOT_KEYS, Scratch, by_bytes, give_back, table, text_bytes, thrifty

GRAM = 3
#: Letters of words, A-Z lower-cased: 90 of them, so there are at most 729,000 q-grams.
_RUN = re.compile("[a-zÀ-ÿ]+")
_BREAK = re.compile("[^a-zÀ-ÿ]")
#: Every so-manieth run of a document (by its checksum) loses a letter.
EVERY = 199
#: Distinct words that a task counts at once, and characters of a text that are split at once.
_HELD, _PIECE = 250_000, 1 << 20
#: Bytes of a run up to which checksums come from tables.
_LONG = 64
#: Postings of a list that are compared in one cell, at least; rows of a partition and pairs that are looked at at once.
CELL, _ROWS, _PAIRS = 20_000, 100_000, 200_000


class _Words(dict):
    """Numbers of words; of words that are new the checksum and the size in bytes."""

    def __init__(self):
        self.crc, self.size = [], []

    def __missing__(self, word: str) -> int:
        raw = word.encode()
        self.crc.append(zlib.crc32(raw))
        self.size.append(len(raw))
        n = self[word] = len(self)
        return n


_ZEROS = [bytes(n) for n in range(_LONG + 1)]
_OF_ZEROS = np.array([zlib.crc32(z) for z in _ZEROS], np.uint32)


def shortened(prefix: bytes, word: str) -> str:
    """``word``, less a letter if ``EVERY`` divides the checksum of ``prefix`` and the word."""
    h = zlib.crc32(word.encode(), zlib.crc32(prefix))
    k = h % len(word)
    return word if h % EVERY else word[:k] + word[k + 1 :]


def pieces(text: str, size: int = _PIECE) -> Iterator[str]:
    """A text in pieces of about ``size`` characters, none of which ends within a run."""
    at = 0
    while at < len(text):
        end = _BREAK.search(text, at + size)
        end = end.start() if end else len(text)
        yield text[at:end]
        at = end


class _Counter:
    """Counts of the words of texts that come with the prefix of their checksums."""

    def __init__(self):
        self.known, self.other = _Words(), {}
        self.counts, self.crcs, self.sizes = np.zeros(0, np.int64), np.zeros(0, np.uint32), np.zeros(0, np.int64)

    def add(self, texts: list[tuple[bytes, str]]) -> None:
        known = self.known
        runs = [_RUN.findall(t) for _, t in texts]
        ids = [np.fromiter(map(known.__getitem__, r), np.int64, len(r)) for r in runs]
        self.crcs = np.concatenate([self.crcs, np.array(known.crc, np.uint32)])
        self.sizes = np.concatenate([self.sizes, np.array(known.size, np.int64)])
        known.crc, known.size = [], []
        same = []
        for (prefix, _), r, i in zip(texts, runs, ids):
            # a checksum from another start differs by what as many zero bytes make of the start
            start = zlib.crc32(prefix)
            shift = np.array([zlib.crc32(z, start) for z in _ZEROS], np.uint32) ^ _OF_ZEROS
            size = self.sizes[i]
            odd = ((self.crcs[i] ^ shift[np.minimum(size, _LONG)]) % EVERY == 0) | (size > _LONG)
            for k in np.flatnonzero(odd):
                w = shortened(prefix, r[k])
                self.other[w] = self.other.get(w, 0) + 1
            same.append(i[~odd])
        counts = np.bincount(np.concatenate(same), minlength=len(known))
        counts[: len(self.counts)] += self.counts
        self.counts = counts

    def batch(self) -> pa.RecordBatch:
        names, n = [*self.known, *self.other], np.concatenate([self.counts, np.fromiter(self.other.values(), np.int64, len(self.other))])
        some = np.flatnonzero(n)
        return pa.RecordBatch.from_arrays([pa.array([names[i] for i in some], pa.string()), pa.array(n[some])], names=["word", "n"])


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counter = _Counter()
    for b in by_bytes(batches, 1, _PIECE):
        texts = ((f"{key}:".encode(), part) for key, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) if raw for part in pieces(raw.lower().decode()))
        for some in ([x] for x in texts) if b.num_rows == 1 else [list(texts)]:
            if some:
                counter.add(some)
            if len(counter.known) + len(counter.other) > _HELD:
                yield counter.batch()
                counter = _Counter()
    yield counter.batch()


def count_words(docs: DataFrame, id_col: str, text_col: str, least_n: int, least_length: int) -> DataFrame:
    """``word, n`` of the words of at least ``least_length`` characters and ``least_n`` occurrences."""
    own = docs.select(F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("")), text_bytes(f"`{text_col}`"))
    found = own.mapInArrow(thrifty(_count), "word string, n long").where(F.length("word") >= least_length)
    return found.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_n)


def _matrix(words: list[str], length: int) -> np.ndarray:
    return np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).reshape(len(words), length)


def gram_codes(m: np.ndarray) -> np.ndarray:
    """The q-grams at each position of words of equal length, as exact 63-bit numbers."""
    c = m.astype(np.int64)
    return c[:, :-2] << 42 | c[:, 1:-1] << 21 | c[:, 2:]


def _of_equal_length(words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of the words of each length, ``_ROWS`` at a time, and their letters."""
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    for length in np.unique(lengths):
        at = np.flatnonzero(lengths == length)
        for some in np.array_split(at, -(-len(at) // _ROWS)):
            yield some, _matrix([words[i] for i in some], int(length))


def _gram_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for _, m in _of_equal_length(b.column(0).to_pylist()):
            g, n = np.unique(gram_codes(m), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(g), pa.array(n)], names=["gram", "n"])


_POSTING = "len int, gram long, shorter boolean, pos int, word string, n long, at array<int>"


def postings(words: DataFrame) -> DataFrame:
    """The postings of ``words`` (``word, n``) in the lists of their own length and, as the shorter of a pair, of the next.

    ``at`` are the places of all the word's indexed grams. How rare a gram is reaches the workers as a sorted
    array of at most 90 ** ``GRAM`` numbers, the alphabet being fixed.
    """
    spark = words.sparkSession
    counted = words.select("word").mapInArrow(_gram_counts, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")).orderBy("gram").toArrow()
    shared = spark.sparkContext.broadcast((counted.column("gram").to_numpy(), counted.column("n").to_numpy()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams, rows = shared.value
        order = np.empty(len(grams), np.int64)  # rarest first, ties by the gram
        order[np.lexsort((grams, rows))] = np.arange(len(grams))
        for b in batches:
            names, ns = b.column(0).to_pylist(), b.column(1).to_numpy(zero_copy_only=False)
            for some, m in _of_equal_length(names):
                codes = gram_codes(m)
                k = min(GRAM + 1, codes.shape[1])
                rank = order[np.searchsorted(grams, codes)] * codes.shape[1] + np.arange(codes.shape[1])
                at = np.sort(np.argsort(rank, axis=1)[:, :k], axis=1).astype(np.int32)
                taken = np.take_along_axis(codes, at, 1).ravel()
                row = np.repeat(np.arange(len(some)), k)
                ats = pa.ListArray.from_arrays(pa.array(np.arange(0, at.size + 1, k, dtype=np.int32)), pa.array(at.ravel())).take(pa.array(row))
                own = pa.array([names[i] for i in some], pa.string()).take(pa.array(row))
                for shorter in (False, True):
                    n = len(row)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(n, m.shape[1] + shorter, np.int32)), pa.array(taken), pa.array(np.full(n, shorter)), pa.array(at.ravel()), own, pa.array(ns[some][row]), ats],
                        names=["len", "gram", "shorter", "pos", "word", "n", "at"],
                    )
        give_back()

    return words.select("word", "n").mapInArrow(run, _POSTING)


def into_cells(lists: DataFrame, cell: int = CELL) -> DataFrame:
    """``lists`` with ``part, low, high``: a list with over ``cell`` postings (or a ``HOT_KEYS``-th of all, if that is
    more) is cut in parts by a hash of the word, and each pair of parts is a cell of its own, so that no task gets a
    list of any size. A list that isn't cut is the cell (0, 0)."""
    sizes = lists.groupBy("len", "gram").count()
    total = lists.count()
    limit = max(cell, total // HOT_KEYS)
    # fewer than HOT_KEYS lists are larger than the limit
    large = sizes.where(F.col("count") > limit).select(F.col("len").alias("__len"), F.col("gram").alias("__gram"), F.ceil(F.col("count") / limit).cast("int").alias("parts"))
    cut = lists.join(F.broadcast(large), (F.col("len") == F.col("__len")) & (F.col("gram") == F.col("__gram")), "left").drop("__len", "__gram")
    cut = cut.withColumn("part", F.coalesce(F.pmod(F.hash("word"), F.col("parts")), F.lit(0)))
    other = F.explode(F.sequence(F.lit(0), F.coalesce(F.col("parts"), F.lit(1)) - 1))
    return cut.withColumn("other", other).select("len", "gram", "shorter", "pos", "word", "n", "at", "part", F.least("part", "other").alias("low"), F.greatest("part", "other").alias("high"))


def _merge(key: np.ndarray, keys: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places i, j with ``key[i] == keys[j]``, ``keys`` sorted, about ``_PAIRS`` at a time."""
    a, b = np.searchsorted(keys, key, "left"), np.searchsorted(keys, key, "right")
    ends = np.cumsum(b - a)
    start = 0
    while start < len(key):
        done = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, done + _PAIRS, "right")))
        n = (b - a)[start:stop]
        i = np.repeat(np.arange(start, stop), n)
        j = np.arange(len(i)) + np.repeat(a[start:stop] - (np.cumsum(n) - n), n)
        if len(i):
            yield i, j
        start = stop


def overlap(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of pairs of words (rows of letters; ``y`` as long or longer by one): how many q-grams of ``x`` are at the same
    place or the next in ``y``; whether one edit makes them equal."""
    if x.shape[1] == y.shape[1]:
        same = x == y
        return (same[:, :-2] & same[:, 1:-1] & same[:, 2:]).sum(axis=1), same.sum(axis=1) == x.shape[1] - 1
    same, moved = x == y[:, :-1], x == y[:, 1:]
    common = (same[:, :-2] & same[:, 1:-1] & same[:, 2:]) | (moved[:, :-2] & moved[:, 1:-1] & moved[:, 2:])
    ahead = np.logical_and.accumulate(same, axis=1).sum(axis=1)
    behind = np.logical_and.accumulate(moved[:, ::-1], axis=1).sum(axis=1)
    return common.sum(axis=1), ahead + behind >= x.shape[1]


_NEAR = "word string, near long, most long, form string"


def _near_in(t: pa.Table) -> Iterator[pa.RecordBatch]:
    """Near words of whole cells whose words are of one length or (``shorter``) one less: for each word and cell how many
    there are and the most frequent. A pair counts in the list of its smallest common indexed gram alone."""
    length = t.column("len")[0].as_py()
    get = {c: t.column(c).to_numpy() for c in ("gram", "pos", "n", "part", "low", "high")}
    shorter = t.column("shorter").to_numpy(zero_copy_only=False)
    names = t.column("word").to_pylist()
    ats = t.column("at").combine_chunks().flatten().to_numpy()
    full, less = np.flatnonzero(~shorter), np.flatnonzero(shorter)
    if not len(full):
        return
    ks = t.column("at").combine_chunks().value_lengths().to_numpy()
    starts = np.cumsum(ks) - ks

    def side(rows: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        m = _matrix([names[i] for i in rows], size)
        at = ats[starts[rows][:, None] + np.arange(ks[rows[0]])]
        return m, at, np.take_along_axis(gram_codes(m), at, 1)

    keys = np.stack([get["gram"], get["low"], get["high"]])
    cell = np.append(0, (keys[:, 1:] != keys[:, :-1]).any(axis=0)).cumsum() * (length + 2)
    ms, ats_f, grams_f = side(full, length)
    key = cell[full] + get["pos"][full]
    by = np.argsort(key, kind="stable")
    found: list[tuple[np.ndarray, np.ndarray]] = []
    kinds = [(full, ms, ats_f, grams_f, 0)]
    if len(less):
        kinds += [(less, *side(less, length - 1), step) for step in (0, 1)]
    for rows, m, at, grams, step in kinds:
        same = rows is full
        for i, j in _merge(cell[rows] + get["pos"][rows] + step, key[by]):
            j = by[j]
            a, b = rows[i], full[j]
            across = np.where(get["low"][a] == get["high"][a], True, get["part"][a] != get["part"][b])
            use = across & (a < b) if same else across
            i, j = i[use], j[use]
            if not len(i):
                continue
            x, y = m[i], ms[j]
            common, edit = overlap(x, y)
            near = (common >= length - GRAM + 1 - GRAM) & edit
            i, j = i[near], j[near]
            # the list whose gram is the smallest that the two have indexed at allowed places
            moved = ats_f[j][:, None, :] - at[i][:, :, None]
            match = (grams[i][:, :, None] == grams_f[j][:, None, :]) & ((moved == 0) if same else (moved == 0) | (moved == 1))
            least = np.where(match, grams[i][:, :, None], np.iinfo(np.int64).max).min(axis=(1, 2))
            first = least == get["gram"][rows[i]]
            found.append((rows[i[first]], full[j[first]]))
    if not found:
        return
    a, b = (np.concatenate(x) for x in zip(*found))
    # a pair that meets at several places of one list is one pair
    ids = np.unique(names, return_inverse=True)[1]
    pair = np.unique(np.minimum(ids[a], ids[b]).astype(np.int64) * len(names) + np.maximum(ids[a], ids[b]), return_index=True)[1]
    a, b = np.concatenate([a[pair], b[pair]]), np.concatenate([b[pair], a[pair]])
    order = np.lexsort((ids[b], -get["n"][b], ids[a]))
    a, b = a[order], b[order]
    start = np.flatnonzero(np.concatenate([[True], ids[a][1:] != ids[a][:-1]])) if len(a) else np.zeros(0, np.int64)
    yield pa.RecordBatch.from_arrays(
        [pa.array([names[i] for i in a[start]], pa.string()), pa.array(np.diff(np.append(start, len(a)))), pa.array(get["n"][b[start]]), pa.array([names[i] for i in b[start]], pa.string())],
        names=["word", "near", "most", "form"],
    )


def _near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Near words of a partition sorted by length and cell, about ``_ROWS`` rows at a time (or one cell)."""
    held: list[pa.RecordBatch] = []
    n = 0

    def runs(t: pa.Table, last: bool) -> tuple[list[pa.Table], pa.Table]:
        keys = np.stack([t.column(c).to_numpy().astype(np.int64) for c in ("len", "gram", "low", "high")])
        ends = np.append(np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1, t.num_rows)
        stop = t.num_rows if last else (ends[-2] if len(ends) > 1 else 0)
        lens = keys[0, :stop]
        cuts = [0, *(np.flatnonzero(lens[1:] != lens[:-1]) + 1), stop] if stop else [0]
        return [t.slice(a, b - a) for a, b in zip(cuts, cuts[1:])], t.slice(stop)

    for b in batches:
        held.append(b)
        n += b.num_rows
        if n >= _ROWS:
            done, rest = runs(pa.Table.from_batches(held), False)
            for t in done:
                yield from _near_in(t)
            # a cell that isn't whole yet is looked at again once it has doubled, so that a large one costs no square
            held, n = rest.combine_chunks().to_batches(), 0
    if held:
        for t in runs(pa.Table.from_batches(held), True)[0]:
            yield from _near_in(t)
    give_back()


def near_words(words: DataFrame, scratch: Scratch) -> DataFrame:
    """``word, n, near, most, form`` for every row of ``words`` (``word, n``, words distinct): how many of the others are
    one edit away, and the most frequent of these (ties: the first in code-point order)."""
    lists = scratch.keep(postings(words))
    cells = into_cells(lists)
    found = cells.repartition("len", "gram", "low", "high").sortWithinPartitions("len", "gram", "low", "high").mapInArrow(_near, _NEAR)
    rows = words.select("word", "n", F.lit(0).cast("long").alias("near"), F.lit(None).cast("struct<less:bigint,word:string>").alias("best"))
    rows = rows.unionByName(found.select("word", F.lit(None).cast("long").alias("n"), "near", F.struct((-F.col("most")).alias("less"), F.col("form").alias("word")).alias("best")))
    out = rows.groupBy("word").agg(F.max("n").alias("n"), F.sum("near").alias("near"), F.min("best").alias("best"))
    return out.select("word", "n", "near", (-F.col("best.less")).alias("most"), F.col("best.word").alias("form"))


def group_variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_n: int = 5, least_length: int = 6, ratio: int = 5) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` for every word of the texts with ``least_n`` occurrences and ``least_length`` letters.

    Words are the runs of letters (A-Z lower-cased), of which every ``EVERY``-th by the checksum of ``<id>:<run>`` loses a
    letter. A word's form is its most frequent near word (one letter inserted, deleted or replaced; ties: the first in
    code-point order), if that is ``ratio`` times as frequent, else null; its root is the end of the chain of forms.

    A null id counts as an empty one, a null text has no words; repeated rows count as often as they are there;
    texts of any length are read whole, a megabyte at once; an empty table gives no rows; further columns, whatever their
    names, are not read.
    """
    if least_length < 2 * GRAM:
        raise ValueError(f"words of under {2 * GRAM} letters may have no q-gram left after an edit")
    scratch = Scratch(docs.sparkSession)
    words = scratch.keep(count_words(docs, id_col, text_col, least_n, least_length))
    held = F.col("most") >= ratio * F.col("n")
    own = near_words(words, scratch).select("word", "n", "near", F.when(held, F.col("form")).alias("form"), F.when(held, F.col("most")).alias("form_n"))
    now = scratch.keep(own.withColumn("root", F.coalesce("form", "word")))
    # a form is ``ratio`` times as frequent, which bounds a chain's length; each round doubles what a root has behind it
    most = (now.agg(F.max("n")).first()[0] or 0) // max(least_n, 1)
    length, reach = 0, 1
    while most >= ratio:
        most, length = most // ratio, length + 1
    while reach < length:
        ends = now.where("form is not null").select(F.col("word").alias("__w"), F.col("root").alias("__r"))
        after = scratch.keep(now.join(ends, F.col("root") == F.col("__w"), "left").withColumn("root", F.coalesce("__r", "root")).drop("__w", "__r"))
        scratch.drop(now)
        now, reach = after, reach * 2
    return now.select("word", "form", "root", "n", F.col("near").alias("n_near"), "form_n")


def op12_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return group_variants(table(spark, sf_dir, "documents"))
