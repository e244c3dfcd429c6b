"""Language ID: interpolated Kneser-Ney character models per language in sorted hash arrays.

A text's score for a language is the cross-entropy per character of its words (runs of letters, lower-cased,
with a space around them), so a word's score is worked out once. Characters are packed (hashed, beyond the
basic plane) to 16 bits, so that a 4-gram is one 64-bit key; keys are sorted and looked up by binary search.
Score and rejection are calibrated on documents that the models haven't seen."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from .common import by_bytes, materialize, table, text_bytes

ORDER = 4
#: Languages up to which their totals are broadcast.
MOST_BROADCAST = 10_000
_WORD = re.compile(r"[^\W\d_]+")
_MASKS = [np.uint64((1 << 16 * n) - 1) for n in range(ORDER + 1)]
_BITS = np.uint64(16)


def words_of(text: bytes | None) -> list[str]:
    """Lower-cased runs of letters. (The pattern also takes numbers such as \u00b2 into a run; these end a word.)"""
    found = _WORD.findall(text.decode().lower()) if text else []
    if all(map(str.isalpha, found)):
        return found
    return [w for run in found for w in ([run] if run.isalpha() else "".join(c if c.isalpha() else " " for c in run).split())]


def grams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The 4-gram that ends at each character of each word and at the space after it; the words' lengths in these."""
    joined = "".join(["   " + w + " " for w in words])
    c = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    c = (c ^ (c >> _BITS) * np.uint64(0x9E37)) & _MASKS[1]
    g = c[3:] | c[2:-1] << _BITS | c[1:-2] << np.uint64(32) | c[:-3] << np.uint64(48)
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 1
    starts = np.cumsum(sizes + 3) - sizes - 3
    return g[np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))], sizes


class Models:
    """For each order the keys seen in any language with their log probabilities in each (rows), and the
    contexts with the log weight of the next lower order."""

    def __init__(self, languages: list[str], counts: list[tuple[np.ndarray, np.ndarray]]):
        self.languages = languages
        self.keys: dict[int, np.ndarray] = {}
        self.logs: dict[int, np.ndarray] = {}
        self.contexts: dict[int, np.ndarray] = {}
        self.weights: dict[int, np.ndarray] = {}
        own = {ORDER: counts}
        for n in range(ORDER - 1, 0, -1):
            # continuation counts: in how many contexts one longer a gram occurs
            own[n] = [np.unique(k & _MASKS[n], return_counts=True) for k, _ in own[n + 1]]
        alphabet = len(np.unique(np.concatenate([k for k, _ in own[1]]))) + 1
        self.unknown = float(np.log(1.0 / alphabet))
        for n in range(1, ORDER + 1):
            keys = np.unique(np.concatenate([k for k, _ in own[n]]))
            contexts = np.unique(keys >> _BITS)
            probs, weights = [], []
            for at, (k, c) in enumerate(own[n]):
                once, twice = (c == 1).sum(), (c == 2).sum()
                d = float(np.clip(once / max(1, once + 2 * twice), 0.1, 0.9))
                context, inverse = np.unique(k >> _BITS, return_inverse=True)
                total = np.bincount(inverse, c)
                gamma = np.ones(len(contexts))
                here = np.searchsorted(contexts, context)
                gamma[here] = d * np.bincount(inverse) / total
                share = np.zeros(len(keys))
                share[np.searchsorted(keys, k)] = (c - d) / total[inverse]
                lower = np.full(len(keys), 1.0 / alphabet) if n == 1 else np.exp(self.logs[n - 1][np.searchsorted(self.keys[n - 1], keys & _MASKS[n - 1]), at])
                probs.append(np.log(share + gamma[np.searchsorted(contexts, keys >> _BITS)] * lower))
                weights.append(np.log(gamma))
            self.keys[n], self.logs[n] = keys, np.stack(probs, 1).astype(np.float32)
            self.contexts[n], self.weights[n] = contexts, np.stack(weights, 1).astype(np.float32)
        #: filled by calibration
        self.sharpness, self.limits = 50.0, np.full(len(languages), np.inf)

    def log_probs(self, keys: np.ndarray) -> np.ndarray:
        """Log probability of each 4-gram's last character in each language."""
        out = np.zeros((len(keys), len(self.languages)), np.float32)
        left = np.arange(len(keys))
        for n in range(ORDER, 0, -1):
            k = keys[left] & _MASKS[n]
            at = np.minimum(np.searchsorted(self.keys[n], k), len(self.keys[n]) - 1)
            hit = self.keys[n][at] == k
            out[left[hit]] += self.logs[n][at[hit]]
            left, k = left[~hit], k[~hit] >> _BITS
            if not len(left):
                return out
            at = np.minimum(np.searchsorted(self.contexts[n], k), len(self.contexts[n]) - 1)
            hit = self.contexts[n][at] == k
            out[left[hit]] += self.weights[n][at[hit]]
        out[left] += self.unknown
        return out


class Scorer:
    """Cross-entropies of texts, with the scores of words remembered up to a bound."""

    def __init__(self, models: Models, remember: int = 300_000):
        self.models, self.remember = models, remember
        self.known: dict[str, int] = {}
        self.table = np.zeros((0, len(models.languages)), np.float32)
        self.sizes = np.zeros(0, np.int64)

    def entropies(self, texts: list[bytes | None]) -> np.ndarray:
        """A row per text, NaN where it has no letter."""
        docs = [words_of(t) for t in texts]
        if len(self.known) > self.remember:
            self.known, self.table, self.sizes = {}, self.table[:0], self.sizes[:0]
        new = list({w for d in docs for w in d}.difference(self.known))
        for at in range(0, len(new), 50_000):
            some = new[at : at + 50_000]
            keys, sizes = grams(some)
            logs = np.add.reduceat(self.models.log_probs(keys), np.cumsum(sizes) - sizes, axis=0)
            self.known.update(zip(some, range(len(self.sizes), len(self.sizes) + len(some))))
            self.table, self.sizes = np.concatenate([self.table, logs]), np.concatenate([self.sizes, sizes])
        out = np.full((len(docs), len(self.models.languages)), np.nan)
        for i, d in enumerate(docs):
            if d:
                at = np.fromiter(map(self.known.__getitem__, d), np.int64, len(d))
                out[i] = -self.table[at].sum(axis=0, dtype=np.float64) / self.sizes[at].sum()
        return out


def _entropies(docs: DataFrame, models: Models, *keep: str) -> DataFrame:
    """``keep`` and ``entropy``, an array in the order of the languages (null without a letter)."""
    shared = docs.sparkSession.sparkContext.broadcast(models)
    n = len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for b in by_bytes(batches, n, 2 << 20):
            e = scorer.entropies(b.column(n).to_pylist())
            yield pa.RecordBatch.from_arrays([*b.columns[:n], pa.array([None if np.isnan(x[0]) else x.tolist() for x in e], pa.list_(pa.float64()))], names=[*keep, "entropy"])

    schema = docs.select(*keep).schema.add("entropy", ArrayType(DoubleType()))
    return docs.select(*keep, text_bytes("text").alias("text")).mapInArrow(run, schema)


def train(docs: DataFrame, max_chars: int = 6_000_000) -> Models | None:
    """Models of the languages of ``docs`` (columns ``text, lang``, both not null).

    Bounded: of each language, documents are taken by a hash of their text up to about ``max_chars``
    characters, an eighth of them for calibration. None if there is nothing to learn from.
    """
    per = docs.groupBy("lang").agg(F.sum(F.length("text")).alias("chars"))
    per = materialize(per.withColumnRenamed("lang", "l"))
    # a row per language: small enough to broadcast, or joined by the planner's choice
    per = F.broadcast(per) if per.count() <= MOST_BROADCAST else per
    u = F.shiftrightunsigned(F.xxhash64(F.lit(9), "text"), 11).cast("double") / float(1 << 53)
    sample = docs.join(per, F.col("lang") == F.col("l")).where(u * F.col("chars") <= max_chars).select("lang", "text", (F.pmod(F.xxhash64(F.lit(10), "text"), F.lit(8)) == 0).alias("held"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in by_bytes(batches, 1, 4 << 20):
            langs = b.column(0).to_pylist()
            for lang in set(langs):
                words = [w for l, t in zip(langs, b.column(1).to_pylist()) if l == lang for w in words_of(t)]
                if words:
                    k, c = np.unique(grams(words)[0], return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(k)), pa.array(k.view(np.int64)), pa.array(c)], names=["lang", "gram", "n"])

    found = sample.where("not held").select("lang", text_bytes("text").alias("text")).mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")).toArrow()
    lang, gram, n = (np.array(found.column("lang").to_pylist(), object), found.column("gram").to_numpy().view(np.uint64), found.column("n").to_numpy())
    if not len(gram):
        return None
    names = sorted(set(lang.tolist()))
    counts = []
    for name in names:
        own = lang == name
        order = np.argsort(gram[own])
        counts.append((gram[own][order], n[own][order]))
    models = Models(names, counts)
    held = [(names.index(r.lang), r.entropy) for r in _entropies(sample.where("held"), models, "lang").where("entropy is not null").collect() if r.lang in names]
    if held:
        calibrate(models, np.array([i for i, _ in held]), np.array([e for _, e in held]))
    return models


def calibrate(models: Models, true: np.ndarray, entropies: np.ndarray, accept: float = 0.995) -> None:
    """Set the sharpness that makes the held-out scores likeliest, and each language's limit: the
    ``accept`` quantile of the entropy of its own held-out documents."""

    def loss(t: float) -> float:
        z = -entropies * t
        z -= z.max(axis=1, keepdims=True)
        return float(np.mean(np.log(np.exp(z).sum(axis=1)) - z[np.arange(len(true)), true]))

    models.sharpness = min([2.0**k for k in range(-1, 9)], key=loss)
    for i in range(len(models.languages)):
        own = entropies[true == i, i]
        if len(own) >= 20:
            models.limits[i] = np.quantile(own, accept)


def identify(docs: DataFrame, models: Models | None, *keep: str) -> DataFrame:
    """``keep, lang_pred, score, rejected`` for the texts in column ``text`` of ``docs``.

    ``lang_pred`` is ``und`` and ``score`` 0 for null texts and texts without a letter (or without models);
    ``rejected`` says that the best entropy is over the limit of its language, or that there is none. Very long texts
    are scored whole; repeated rows stay, with equal results; of other columns only ``keep`` is read; an empty table
    gives no rows.
    """
    if models is None:
        return docs.select(*keep, F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(True).alias("rejected"))
    e = F.col("entropy")
    best = F.array_min(e)
    at = F.array_position(e, best).cast("int") - 1
    spread = F.aggregate(F.transform(e, lambda x: F.exp((best - x) * models.sharpness)), F.lit(0.0), lambda a, x: a + x)
    return _entropies(docs, models, *keep).select(
        *keep,
        F.coalesce(F.get(F.array(*map(F.lit, models.languages)), at), F.lit("und")).alias("lang_pred"),
        F.coalesce(1.0 / spread, F.lit(0.0)).alias("score"),
        F.coalesce(best > F.get(F.array(*[F.lit(float(x)) for x in models.limits]), at), F.lit(True)).alias("rejected"),
    )


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("text").cast("string").alias("text"), "lang", held.alias("held_out"))
    models = train(docs.where("not held_out and doc_id is not null and lang is not null and text is not null").select("text", "lang"))
    return identify(docs, models, "doc_id", "held_out")
