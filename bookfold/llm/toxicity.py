"""Toxicity: nearest labelled examples by exact TF-IDF cosine, found with a block-max inverted index.

Texts are vectors over words and beginnings of words (one, two or three distinct words that begin so) that tell toxic
from other labelled texts beyond chance (likelihood ratio, corrected for the number of features tried), weighted by
frequency and by rarity in the whole corpus. The index holds the distinct vectors of the labelled examples in blocks of
similar ones, with the largest weight of each term in each block. Blocks are looked at in order of what they can reach at
most, until none can reach the k-th nearest: the k nearest are exact. They vote with weights by cosine, and votes of
examples on one another (each without itself) calibrate the score."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructType

from .common import Scratch, by_bytes, table, text_bytes, thrifty

_WORD = re.compile(r"[^\W\d_]+")
#: Letters of the beginnings of words, and how many distinct words begin so.
BEGINNINGS, SEVERAL = range(3, 9), (1, 2, 3)
#: Entries of a block of the index.
BLOCK = 64
#: Distinct features that a task counts at once; answers that a worker remembers.
_HELD, _REMEMBER = 400_000, 50_000
#: Weight of the examples' base rate in a vote.
PRIOR = 0.25


def words_of(text: bytes | None) -> list[str]:
    return _WORD.findall(text.decode().lower()) if text else []


def features_of(text: bytes | None) -> list[str]:
    """The distinct words of a text, and its beginnings as ``begin*1`` to ``begin*3`` for so many distinct words or more."""
    words = set(words_of(text))
    begin = Counter([w[:k] for w in words for k in BEGINNINGS if k <= len(w)])
    return [*words, *[f"{b}*{m}" for b, n in begin.items() for m in SEVERAL if m <= n]]


class Numbers:
    """The features that are terms, by word and by beginning."""

    def __init__(self, terms: list[str]):
        self._words = {t: i for i, t in enumerate(terms) if "*" not in t}
        self._begin: dict[str, list[tuple[int, int]]] = {}
        for i, t in enumerate(terms):
            if "*" in t:
                begin, least = t.split("*")
                self._begin.setdefault(begin, []).append((int(least), i))
        least = min(BEGINNINGS)
        self._heads = {t[:least] for t in [*self._words, *self._begin]}

    def vector(self, text: bytes | None) -> list[tuple[int, int]]:
        """Rising numbers of a text's features and how often they are there (beginnings: once)."""
        words, heads, least = words_of(text), self._heads, min(BEGINNINGS)
        times, begin = {}, Counter()
        for w in [w for w in set(words) if w[:least] in heads]:
            if (own := self._words.get(w, -1)) >= 0:
                times[own] = words.count(w)
            begin.update([b for k in BEGINNINGS if k <= len(w) and (b := w[:k]) in self._begin])
        for b, n in begin.items():
            times |= {i: 1 for m, i in self._begin[b] if m <= n}
        return sorted(times.items())


class BlockMaxIndex:
    """Vectors (rising term numbers and weights, of length one) in blocks: of each the lists of its terms, as a row of
    weights a term, and in ``most`` each term's largest weight."""

    def __init__(self, vectors: list[tuple[np.ndarray, np.ndarray]], terms: int):
        self.terms, self.looked_at = terms, 0
        parts = [vectors[i : i + BLOCK] for i in range(0, len(vectors), BLOCK)]
        self.most = np.zeros((len(parts), terms))
        self.blocks = []
        for b, part in enumerate(parts):
            own = np.unique(np.concatenate([t for t, _ in part]))
            lists = np.zeros((len(own), len(part)))
            for j, (t, w) in enumerate(part):
                lists[np.searchsorted(own, t), j] = w
            self.most[b, own] = lists.max(axis=1)
            self.blocks.append((own, lists))

    def nearest(self, terms: list[int], weights: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The k entries of the largest positive cosine (to nine digits; ties: the first) and their cosines."""
        query = np.zeros(self.terms)
        query[terms] = weights
        bound = self.most[:, terms] @ weights
        ids, cosines = np.zeros(0, np.int64), np.zeros(0)
        for block in np.argsort(-bound, kind="stable")[: np.count_nonzero(bound)]:
            if len(ids) == k and bound[block] < cosines[-1] - 1e-8:
                break
            self.looked_at += 1
            own, lists = self.blocks[block]
            found = np.round(query[own] @ lists, 9)
            some = np.flatnonzero(found > (max(0, cosines[-1] - 1e-8) if len(ids) == k else 0))
            if len(some):
                ids, cosines = np.concatenate([ids, some + block * BLOCK]), np.concatenate([cosines, found[some]])
                best = np.lexsort((ids, -cosines))[:k]
                ids, cosines = ids[best], cosines[best]
        return ids, cosines


@dataclass
class Model:
    """What scores a vector: the rarity of the terms, the index, of its entries the examples, the toxic ones and the
    smallest id, the base rate, and the calibration."""

    terms: list[str]
    rarity: np.ndarray
    index: BlockMaxIndex
    examples: np.ndarray
    toxic: np.ndarray
    ids: np.ndarray
    base: float
    k: int
    votes: np.ndarray
    scores: np.ndarray

    def weights(self, terms: list[int], times: list[int]) -> np.ndarray:
        w = (1 + np.log(np.array(times, float))) * self.rarity[terms]
        return w / np.sqrt((w * w).sum())

    def vote(self, terms: list[int], times: list[int], less: tuple[int, int] | None = None) -> tuple[float, np.ndarray, np.ndarray]:
        """The share of toxic examples among the nearest, by cosine; these and their cosines. ``less``: an entry that
        counts with one example less, and whether that one is toxic."""
        if not terms:
            return self.base, np.zeros(0, np.int64), np.zeros(0)
        ids, cosines = self.index.nearest(terms, self.weights(terms, times), self.k + (less is not None))
        n, toxic = self.examples[ids].astype(float), self.toxic[ids].astype(float)
        if less is not None:
            own = ids == less[0]
            n, toxic = n - own, toxic - own * less[1]
            left = np.flatnonzero(n > 0)[: self.k]
            ids, cosines, n, toxic = ids[left], cosines[left], n[left], toxic[left]
        w = cosines * np.log1p(n)
        return float((w @ (toxic / n) + PRIOR * self.base) / (w.sum() + PRIOR)), ids, cosines

    def score(self, vote: float) -> float:
        return float(np.interp(vote, self.votes, self.scores)) if len(self.votes) else 0.0


def isotonic(votes: np.ndarray, toxic: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rising scores by pooling neighbours that fall: the mean vote of each pool and its smoothed share of toxic ones."""
    pools: list[list[float]] = []
    each, at = np.unique(votes, return_inverse=True)
    for v, t, m in zip(each.tolist(), np.bincount(at, toxic).tolist(), np.bincount(at, n).tolist()):
        pools.append([v * m, t, m])
        while len(pools) > 1 and pools[-2][1] * pools[-1][2] >= pools[-1][1] * pools[-2][2]:
            last = pools.pop()
            pools[-1] = [a + b for a, b in zip(pools[-1], last)]
    p = np.array(pools).reshape(-1, 3)
    return p[:, 0] / p[:, 2], np.maximum.accumulate((p[:, 1] + 0.5) / (p[:, 2] + 1)) if len(p) else p[:, 1]


def _term_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    n, toxic = Counter(), Counter()

    def flush() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([*n], pa.string()), pa.array([*n.values()], pa.int64()), pa.array([toxic[w] for w in n], pa.int64())], names=["term", "n", "toxic"])

    for b in by_bytes(batches, 0, 2 << 20):
        for t, label in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            own = features_of(t)
            n.update(own)
            if label:
                toxic.update(own)
        if len(n) > _HELD:
            yield flush()
            n, toxic = Counter(), Counter()
    yield flush()


def telling_terms(examples: DataFrame, scratch: Scratch, alpha: float, max_terms: int) -> list[str]:
    """The features of ``examples`` (``text, toxic``) whose documents are toxic more or less often than chance explains.

    Of the likelihood ratio of two rates (one degree of freedom) x, chance reaches x with probability exp(-x / 2)
    at most; the limit is that of ``alpha`` over all features tried. At most ``max_terms``, those with the highest ratios.
    """
    counts = scratch.keep(examples.select(text_bytes("text"), "toxic").mapInArrow(thrifty(_term_counts), "term string, n long, toxic long").groupBy("term").agg(F.sum("n").alias("n"), F.sum("toxic").alias("toxic")))
    total, toxic = examples.agg(F.count("*"), F.sum("toxic")).first()
    tried = counts.count()
    if not tried or not toxic or toxic == total:
        return []

    def part(seen, expected):
        return F.when(seen > 0, seen * F.log(seen / expected)).otherwise(0.0)

    n, t = F.col("n").cast("double"), F.col("toxic").cast("double")
    rate = toxic / total
    ratio = 2 * (part(t, n * rate) + part(n - t, n * (1 - rate)) + part(toxic - t, (total - n) * rate) + part((total - toxic) - (n - t), (total - n) * (1 - rate)))
    found = counts.withColumn("ratio", ratio).where(F.col("ratio") >= 2 * math.log(tried / alpha)).orderBy(F.desc("ratio"), "term").limit(max_terms)
    return sorted(r.term for r in found.select("term").collect())


def vectors(docs: DataFrame, terms: list[str], text_col: str, *keep: str) -> DataFrame:
    """``keep`` and ``terms, times``: the numbers of the terms in each text, rising, and how often they are there."""
    k = len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers = Numbers(terms)
        for b in by_bytes(batches, k, 2 << 20):
            found = [numbers.vector(t) for t in b.column(k).to_pylist()]
            lists = [pa.array([[x[side] for x in f] for f in found], pa.list_(pa.int32())) for side in (0, 1)]
            yield pa.RecordBatch.from_arrays([*b.columns[:k], *lists], names=[*keep, "terms", "times"])

    schema = StructType(docs.select(*keep).schema.fields).add("terms", ArrayType(IntegerType())).add("times", ArrayType(IntegerType()))
    return docs.select(*keep, text_bytes(text_col)).mapInArrow(thrifty(run), schema)


def rows_with(rows: DataFrame, terms: int) -> np.ndarray:
    """How many of the vectors ``rows`` have each term; a task sends one row a term at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(terms, np.int64)
        for b in batches:
            n += np.bincount(b.column(0).flatten().to_numpy(), minlength=terms)
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(n[some])], names=["term", "n"])

    out = np.zeros(terms, np.int64)
    for term, n in rows.select("terms").mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n")).collect():
        out[term] = n
    return out


def fit(rows: DataFrame, marks: DataFrame, terms: list[str], k: int, max_entries: int) -> Model:
    """The index and the calibration from the vectors ``rows`` (``doc_id, terms, times``) and the labels ``marks`` of examples."""
    spark = rows.sparkSession
    rarity = np.log1p(rows.count() / np.maximum(1, rows_with(rows, len(terms)))) if terms else np.zeros(0)
    found = rows.join(F.broadcast(marks), "doc_id").groupBy("terms", "times").agg(F.count("*").alias("n"), F.sum("toxic").alias("toxic"), F.min("doc_id").cast("long").alias("id"))
    drawn = found.orderBy(F.size("terms") > 0, F.xxhash64("terms", "times"), "terms", "times").limit(max_entries + 1).collect()
    base = sum(r.toxic for r in drawn) / max(1, sum(r.n for r in drawn))
    model = Model(terms, rarity, BlockMaxIndex([], len(terms)), np.zeros(0), np.zeros(0), np.zeros(0), base, k, np.zeros(0), np.zeros(0))
    # similar entries next to each other: by their terms, heaviest first
    entries = [(r, model.weights(r.terms, r.times)) for r in drawn if r.terms]
    entries.sort(key=lambda x: [r for _, r in sorted(zip((-x[1]).tolist(), x[0].terms))] + x[0].times)
    model.index = BlockMaxIndex([(np.array(r.terms), w) for r, w in entries], len(terms))
    model.examples, model.toxic, model.ids = (np.array([r[c] for r, _ in entries], np.int64) for c in ("n", "toxic", "id"))
    empty = [r for r in drawn if not r.terms]
    shared = spark.sparkContext.broadcast((model, [(r.terms, r.times) for r, _ in entries]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, own = shared.value
        for b in batches:
            out = []
            for i in b.column(0).to_pylist():
                toxic, clean = int(m.toxic[i]), int(m.examples[i] - m.toxic[i])
                out += [(m.vote(*own[i], (i, y))[0], y * c, c) for y, c in ((1, toxic), (0, clean)) if c]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out) if out else ((), (), ()), (pa.float64(), pa.int64(), pa.int64()))], names=["vote", "toxic", "n"])

    votes = [(base, sum(r.toxic for r in empty), sum(r.n for r in empty))] if empty else []
    if entries:
        votes += [tuple(r) for r in spark.range(len(entries)).repartition(8).mapInArrow(run, "vote double, toxic long, n long").collect()]
    if votes:
        model.votes, model.scores = isotonic(*map(np.array, zip(*votes)))
    return model


def scored(rows: DataFrame, model: Model, *keep: str, shown: int = 3) -> DataFrame:
    """``keep, score, evidence`` of the vectors ``rows``; ``evidence``: the ``shown`` nearest examples and their cosines."""
    shared = rows.sparkSession.sparkContext.broadcast(model)
    k = len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, known = shared.value, {}
        for b in batches:
            out = []
            for key in zip(b.column(k).to_pylist(), b.column(k + 1).to_pylist()):
                key = (*map(tuple, key),)
                if key not in known:
                    if len(known) >= _REMEMBER:
                        known.clear()
                    vote, ids, cosines = m.vote(list(key[0]), list(key[1]))
                    known[key] = (m.score(vote), [{"doc_id": int(m.ids[i]), "cosine": float(c)} for i, c in zip(ids[:shown], cosines)])
                out.append(known[key])
            kind = pa.list_(pa.struct([("doc_id", pa.int64()), ("cosine", pa.float64())]))
            yield pa.RecordBatch.from_arrays([*b.columns[:k], pa.array([x for x, _ in out], pa.float64()), pa.array([x for _, x in out], kind)], names=[*keep, "score", "evidence"])

    schema = StructType(rows.select(*keep).schema.fields)
    for f in rows.sparkSession.createDataFrame([], "score double, evidence array<struct<doc_id: bigint, cosine: double>>").schema:
        schema.add(f)
    return rows.select(*keep, "terms", "times").mapInArrow(run, schema)


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 15, alpha: float = 0.01, threshold: float = 0.7, max_examples: int = 100_000, max_entries: int = 20_000, max_terms: int = 512) -> DataFrame:
    """``doc_id, score, predicted, evidence`` for every row of ``docs``, learnt from ``labels`` (``id_col, toxic``).

    Bounded sample of labelled rows: at most ``max_examples`` labelled ids and of their distinct vectors at most
    ``max_entries``, those with the smallest hashes. How rare a word is counts over all rows of ``docs``. Ids whose labels
    disagree, null ids and null labels are no examples. Null and empty texts and texts without a telling feature get the calibrated
    rate of examples without one; without any example the score is 0. Rows with null or repeated ids and
    repeated rows stay, with equal scores for equal texts; texts are read whole; an empty table gives no rows; further
    columns are not read.
    """
    scratch = Scratch(docs.sparkSession)
    own = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    label = F.col("toxic").cast("long")
    marks = labels.where(F.col(id_col).isNotNull() & F.col("toxic").isNotNull()).groupBy(F.col(f"`{id_col}`").alias("doc_id")).agg(F.min(label).alias("low"), F.max(label).alias("toxic")).where("low = toxic")
    marks = scratch.keep(marks.select("doc_id", "toxic").orderBy(F.xxhash64(F.lit(13), "doc_id"), "doc_id").limit(max_examples))
    terms = telling_terms(own.join(F.broadcast(marks), "doc_id").select("text", "toxic"), scratch, alpha, max_terms)
    rows = scratch.keep(vectors(own, terms, "text", "doc_id"))
    model = fit(rows, marks, terms, k, max_entries)
    return scored(rows, model, "doc_id").select("doc_id", "score", F.when(F.col("score") >= threshold, 1).otherwise(0).alias("predicted"), "evidence")


def held_out(id_col: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def op13_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").where(~held_out())
    return toxicity(table(spark, sf_dir, "documents"), labels).select("doc_id", held_out().alias("held_out"), "score", "predicted", "evidence")
