"""Near pairs of edit-embedding fingerprints: bit-sampled banding, verification by the whole fingerprint, components.

A band is a few digits, sampled by the steps that they stand for. Each band's digits are a key; fingerprints that
share a key meet. First each bucket's members are held against one node of theirs, which settles groups of near
copies in one comparison a member; components that still have a bucket in common are compared member by member, once
for all their buckets. Short fingerprints meet on pigeonhole blocks instead, which every close pair shares.

The whole fingerprint is the verification: the embedding turns edit distance into Hamming distance, and likeness is
that distance over all sampled steps. The texts themselves are not compared again."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from math import ceil, log, log10

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, connected_components, join_hot, thrifty
from .edit_embedding import CHANCE, FULL, PER_OCTAVE, SEED, _WEIGHTS, _mix

#: Fingerprints of fewer digits meet on blocks of all their digits.
LEAST = 1 << FULL
#: Digits a level of prefixes.
STEP = PER_OCTAVE // 4
#: No band lies within this share of the steps at the start or at the end: so a passage that many texts begin with fills no bucket.
SPREAD = 0.6
#: Of so many unrelated fingerprints one meets another in a band, about.
APART = 250
#: Rows that a map task groups at once, and members from which it sends on only one of a bucket without a node of the key's own level.
_HELD, _MANY = 1 << 18, 32
_REACH = np.cumsum(_WEIGHTS)
_FACTORS = _mix(np.arange(64)) | np.uint64(1)


def share_alike(likeness: float) -> float:
    """The share of steps in which fingerprints of a likeness agree."""
    return likeness + (1 - likeness) * CHANCE


def band_shape(n: int, likeness: float, missed: float = 0.02) -> tuple[int, int, int]:
    """``bands, width, kinds`` for ``n`` distinct fingerprints: so selective that unrelated ones seldom meet (one in
    ``APART`` in a band), and so many that a pair at ``likeness`` is missed in a share of ``missed`` where its
    differences lie worst. Of the last of ``width`` digits only ``kinds`` kinds are told apart, so that a band becomes
    more selective in small steps as ``n`` grows, and the chance meetings of a fingerprint stay as many.

    Worst is that all differences are within the digits that bands are drawn from (a level leaves out up to a fifth of
    the steps) and at one of its ends, where ``SPREAD`` forbids some of the bands that would agree."""
    wanted = max(6.0, log10(APART * max(n, 2)))
    width = int(wanted)
    # unrelated digits agree by CHANCE, others fall in the same kind
    kinds = round((1 - CHANCE) / max(10 ** (width - wanted) - CHANCE, (1 - CHANCE) / 15))
    covered = min(float(_REACH[LEAST + k * STEP - 1] / _REACH[LEAST + (k + 1) * STEP - 2]) for k in range(64))
    all_agree = lambda w: ((1 - (1 - share_alike(likeness)) / covered) ** w - SPREAD**w) / (1 - 2 * SPREAD**w + (2 * SPREAD - 1) ** w)
    agree = all_agree(width)
    if kinds > 1:
        width += 1
        agree = all_agree(width) + (agree - all_agree(width)) / kinds
    return ceil(log(missed) / log(1 - agree)), width, kinds if kinds > 1 else 15


@lru_cache(maxsize=None)
def _positions(level: int, bands: int, width: int) -> np.ndarray:
    """Digits of each band among the first ``LEAST + level * STEP``, drawn by weight without repeats."""
    n = LEAST + level * STEP
    rnd = np.random.default_rng((SEED, level))
    middle = (_REACH[:n] - _WEIGHTS[:n] / 2) / _REACH[n - 1]
    picked: list[np.ndarray] = []
    while len(picked) < bands:
        some = np.argsort(-(np.log(_WEIGHTS[:n]) + rnd.gumbel(size=n)))[:width]
        if middle[some].max() > SPREAD and middle[some].min() < 1 - SPREAD:
            picked.append(some)
    return np.stack(picked)


def digits(packed: bytes, n: int) -> np.ndarray:
    """The digits, 1 to 15, of a packed fingerprint."""
    both = np.frombuffer(packed, np.uint8)
    return np.stack([both >> 4, both & 15], axis=1).ravel()[:n]


def _block_keys(own: np.ndarray, likeness: float) -> tuple[np.ndarray, np.ndarray]:
    """Keys of a short fingerprint, and whether they are for a shorter partner.

    Up to 2 * LEAST digits every step counts once. A pair whose shorter one has m digits differs in at most
    floor((1 - share) * n) of the longer one's n <= m / share, so with one block more than that cut from the first m
    digits, some block is the same: all such pairs meet under the blocks of m."""
    share = share_alike(likeness)
    keys, lower = [np.empty(0, np.uint64)], [np.empty(0, bool)]
    for m in range(min(len(own), LEAST - 1), max(0, ceil(share * len(own) - 1e-9) - 1), -1):
        most = int((1 - share) * int(m / share + 1e-9) + 1e-9)
        cuts = np.arange(most + 1) * m // (most + 1)
        picked = (own[:m].astype(np.uint64) + np.uint64(1)) * _FACTORS[:m]
        keys.append(_mix(np.add.reduceat(picked, cuts) + _mix(np.arange(most + 1) + (1 << 40) + (m << 8))))
        lower.append(np.full(most + 1, m < len(own)))
    return np.concatenate(keys), np.concatenate(lower)


def band_keys(own: np.ndarray, bands: int, width: int, kinds: int, likeness: float) -> tuple[np.ndarray, np.ndarray]:
    """Keys of a fingerprint for its level and for those below that a partner of ``likeness`` may have, and whether they
    are for a lower level: such a partner's walk has at least the share of its steps in which they must agree."""
    out, lower = [], []
    if len(own) * share_alike(likeness) < LEAST:
        out, lower = [[x] for x in _block_keys(own, likeness)]
    top = level = (len(own) - LEAST) // STEP
    least = share_alike(likeness) * _REACH[len(own) - 1]
    while level >= 0 and _REACH[min(len(_REACH), LEAST + (level + 1) * STEP) - 1] >= least:
        picked = own[_positions(level, bands, width)].astype(np.uint64) + np.uint64(1)
        picked[:, -1] = (picked[:, -1] - np.uint64(2)) * np.uint64(kinds) // np.uint64(15)
        out.append(_mix((picked * _FACTORS[:width]).sum(axis=1) + _mix(np.arange(bands) + (level << 20))))
        lower.append(np.full(bands, level < top))
        level -= 1
    return np.concatenate(out), np.concatenate(lower)


def matrix(packed: list[bytes], sizes: list[int]) -> np.ndarray:
    """A row of digits per fingerprint, zeros after its end."""
    out = np.zeros((len(sizes), max(sizes, default=0)), np.uint8)
    for row, p, n in zip(out, packed, sizes):
        row[:n] = digits(p, n)
    return out


def alike(a: np.ndarray, b: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Likeness of rows of digits; ``n``: the longer one's digits."""
    agree = ((a == b) & (a > 0)) @ _WEIGHTS[: a.shape[1]] / _REACH[n - 1]
    return (agree - CHANCE) / (1 - CHANCE)


_STAR = "key long, node long, rep long"


def local_stars(key: np.ndarray, lower: np.ndarray, node: np.ndarray) -> pa.RecordBatch:
    """A map task's rows ``key, node, rep``: of each bucket one goes on (without ``rep``), the others become star rows.

    The lowest bit of a key is set for nodes of which it isn't the own level, so these come last in their bucket."""
    full = (key & ~1) | lower
    order = np.lexsort((node, full))
    full, node = full[order], node[order]
    bucket = full >> 1
    at = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
    sizes = np.diff(np.append(at, len(node)))
    rep = np.repeat(node[at], sizes)
    closed = (rep != node) & np.repeat((full[at] & 1 == 0) | (sizes > _MANY), sizes)
    use = np.concatenate([[True], (bucket[1:] != bucket[:-1]) | (node[1:] != node[:-1])])
    return pa.RecordBatch.from_arrays([pa.array(full[use]), pa.array(node[use]), pa.array(rep[use], mask=~closed[use])], names=["key", "node", "rep"])


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``key, rep, node`` of all star rows; of the others for all but the first node of each key.

    Others come sorted by ``key, node``. A key without a node of its own level gives none: its pairs meet at a level of
    their own."""
    last: tuple[int, int, bool] | None = None
    names = ["key", "rep", "node"]
    for b in batches:
        done = b.filter(b.column("rep").is_valid())
        if done.num_rows:
            yield pa.RecordBatch.from_arrays([pa.array(done.column("key").to_numpy() >> 1), done.column("rep"), done.column("node")], names=names)
        b = b.filter(b.column("rep").is_null())
        if not b.num_rows:
            continue
        full, node = b.column("key").to_numpy(), b.column("node").to_numpy()
        key = full >> 1
        at = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        reps, only_lower = node[at].copy(), full[at] & 1 == 1
        if last and last[0] == key[0]:
            reps[0], only_lower[0] = last[1:]
        sizes = np.diff(np.append(at, len(key)))
        rep = np.repeat(reps, sizes)
        last = (int(key[-1]), int(reps[-1]), bool(only_lower[-1]))
        other = (rep != node) & ~np.repeat(only_lower, sizes)
        yield pa.RecordBatch.from_arrays([pa.array(key[other]), pa.array(rep[other]), pa.array(node[other])], names=names)


def stars(keys: DataFrame) -> DataFrame:
    """``key, rep, node``: the members of each bucket of ``keys`` (rows of ``local_stars``) as a tree of comparisons.

    A bucket that fills map tasks reaches its reduce task as one row from each; star rows are dealt by their node."""
    dealt = keys.repartition(F.when(F.col("rep").isNull(), F.shiftright("key", 1)).otherwise(F.col("node")))
    return dealt.sortWithinPartitions(F.col("rep").isNull(), "key", "node").mapInArrow(_stars, "key long, rep long, node long")


def _judge(likeness: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 4096):
                s = b.slice(at, 4096)
                na, nb = s.column("n_a").to_pylist(), s.column("n_b").to_pylist()
                x = matrix(s.column("f_a").to_pylist() + s.column("f_b").to_pylist(), na + nb)
                close = alike(x[: len(na)], x[len(na) :], np.maximum(na, nb)) >= likeness
                yield pa.RecordBatch.from_arrays([s.column("rep"), s.column("node"), pa.array(close)], names=["rep", "node", "close"])

    return run


def _across(likeness: float):
    """Links between members of a bucket (or of two cells of one) that are in different components."""

    def run(t: pa.Table) -> pa.Table:
        node, label = t.column("node").to_numpy(), np.unique(t.column("component").to_numpy(), return_inverse=True)[1]
        sizes = t.column("n_digits").to_pylist()
        x, n = matrix(t.column("digits").to_pylist(), sizes), np.array(sizes)
        found = []
        # members of the largest component are compared with the others only
        for i in np.flatnonzero(label != np.bincount(label).argmax()).tolist():
            other = np.flatnonzero(label != label[i])
            for j in other[alike(x[other], x[i], np.maximum(n[other], n[i])) >= likeness].tolist():
                if label[j] != label[i]:
                    found.append((node[i], node[j]))
                    label[label == label[j]] = label[i]
        pairs = np.array(found, np.int64).reshape(-1, 2)
        return pa.table([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

    return run


#: Pairs a component up to which a bucket's pairs of components are listed, however few its members; members of a cell's side.
LISTED, SIDE = 3, 4096
#: Keys of buckets, 8 bytes each, that are broadcast at most.
KEYS_SENT = 1 << 20


def not_joined(judged: DataFrame, parts: DataFrame, scratch: Scratch) -> DataFrame:
    """Pairs ``rep, node`` that were not ``close`` and are in different components ``ca, cb`` of ``parts``."""
    far = scratch.keep(judged.where("not close").select("rep", "node").join(parts.toDF("node", "cb"), "node", "left"))
    both = join_hot(far, parts.toDF("rep", "ca"), "rep", "left").withColumns({"ca": F.coalesce("ca", "rep"), "cb": F.coalesce("cb", "node")})
    out = scratch.keep(both.where("ca <> cb").select("rep", "node", "ca", "cb"))
    scratch.drop(far)
    return out


def component_pairs(star: DataFrame, apart: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """Pairs ``a, b, n`` of components that ``n`` buckets have in common, and the ``key`` of buckets whose pairs aren't
    listed, as they would be more than the members and more than ``LISTED`` a component.

    A bucket's star rows are a tree, so each of its components is at an end of a row that joins two: rows that join none,
    almost all in a group of near copies, aren't looked at."""
    rows = star.join(apart, ["rep", "node"]).select("key", F.explode(F.array("ca", "cb")).alias("c"))
    kinds = scratch.keep(rows.distinct())
    per = kinds.groupBy("key").agg(F.count("*").alias("k")).join(star.groupBy("key").agg(F.count("*").alias("m")), "key")
    many = scratch.keep(per.where(F.col("k") * (F.col("k") - 1) / 2 > F.greatest(F.col("k") * LISTED, F.col("m"))).select("key"))
    listed = kinds if many.isEmpty() else kinds.join(many, "key", "left_anti")
    cs = F.col("cs")
    each = F.flatten(F.transform(cs, lambda x, i: F.transform(F.slice(cs, i + 2, F.size(cs)), lambda y: F.struct(x.alias("a"), y.alias("b")))))
    pairs = listed.groupBy("key").agg(F.sort_array(F.collect_list("c")).alias("cs")).select(F.explode(each).alias("p")).groupBy("p.a", "p.b").agg(F.count("*").alias("n"))
    return scratch.keep(pairs), many


def hosted(pairs: DataFrame, sizes: DataFrame, parts: DataFrame, scratch: Scratch) -> DataFrame:
    """Cells ``key, cell, node, component`` in which all members of the components ``a`` and ``b`` of each pair meet.

    The larger component is host to the members of all that it is paired with; both sides are cut into parts of about
    ``SIDE`` members, and each two parts meet in a cell of their own. ``sizes`` has ``component, size`` of all but those of
    one node."""
    for k in ("a", "b"):
        pairs = pairs.join(sizes.toDF(k, f"n_{k}"), k, "left").withColumn(f"n_{k}", F.coalesce(f"n_{k}", F.lit(1)))
    first = F.col("n_a") >= F.col("n_b")
    met = scratch.keep(pairs.select(F.when(first, F.col("a")).otherwise(F.col("b")).alias("host"), F.greatest("n_a", "n_b").alias("n"), F.when(first, F.col("b")).otherwise(F.col("a")).alias("component")))
    guests = scratch.keep(met.join(parts, "component", "left").select("host", "n", "component", F.coalesce("node", "component").alias("node")))
    per = scratch.keep(guests.groupBy("host").agg(F.ceil(F.count("*") / SIDE).alias("g"), F.ceil(F.max("n") / SIDE).alias("h")))
    own = parts.select(F.col("component").alias("host"), "node").unionByName(per.where("h = 1").select("host", F.col("host").alias("node"))).distinct()
    own = scratch.keep(own.join(per.select("host"), "host", "left_semi"))
    cell = lambda h, g: (h * F.col("g") + g).cast("long").alias("cell")
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1)).alias("other")
    hosts = join_hot(own, per, "host").select("host", "h", "g", "node", every("g")).select(F.col("host").alias("key"), cell(F.pmod("node", "h"), F.col("other")), "node", F.col("host").alias("component"))
    come = join_hot(guests.drop("n"), per, "host").select("host", "h", "g", "node", "component", every("h")).select(F.col("host").alias("key"), cell(F.col("other"), F.pmod("node", "g")), "node", "component")
    return hosts.unionByName(come)


def bucket_members(star: DataFrame, keys: DataFrame, parts: DataFrame, scratch: Scratch) -> DataFrame:
    """``key, n, node, component``: all members of some buckets."""
    held = scratch.keep(star.join(F.broadcast(keys), "key", "left_semi") if keys.count() <= KEYS_SENT else join_hot(star, keys, "key"))
    nodes = scratch.keep(held.select("key", "node").unionByName(held.select("key", F.col("rep").alias("node"))).distinct())
    scratch.drop(held)
    return nodes.join(nodes.groupBy("key").agg(F.count("*").alias("n")), "key").join(parts, "node", "left").withColumn("component", F.coalesce("component", "node"))


def cells(members: DataFrame, crowded: int) -> DataFrame:
    """Rows ``key, cell`` and the other columns of ``members``: a bucket of up to ``crowded`` members is one cell; of a
    larger one each pair of parts is, so that every pair of members meets in some cell."""
    parts = F.when(F.col("n") > crowded, F.ceil(2 * F.col("n") / crowded).cast("long")).otherwise(1)
    dealt = members.withColumn("n", parts).withColumn("part", F.pmod("node", "n"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))
    return dealt.withColumn("cell", F.least("part", "other") * F.col("n") + F.greatest("part", "other")).drop("n", "part", "other")


def near_components(prints: DataFrame, scratch: Scratch, likeness: float = 0.8, crowded: int = 1 << 13) -> DataFrame:
    """``node, component`` for the nodes of ``prints`` (columns ``node, digits, n_digits``, distinct, stored) that have links.

    Two fingerprints link if they share a band (or block) and their likeness is ``likeness`` or more. Every pair of a
    bucket is judged, already in one component, or has buckets at a level of its own. Components that share a bucket are
    compared in cells, each in a task of its own; so are the members of a bucket with very many components, by pairs of
    parts if they are over ``crowded``. An empty table gives none.
    """
    own = prints.where(F.col("n_digits") > 0)
    shape = band_shape(own.count(), likeness)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        n = 0
        for b in batches:
            for node, p, k in zip(*[c.to_pylist() for c in b.columns]):
                keys, lower = band_keys(digits(p, k), *shape, likeness)
                held.append((keys.view(np.int64), lower.astype(np.int64), np.full(len(keys), node, np.int64)))
                n += len(keys)
                if n >= _HELD:
                    yield local_stars(*map(np.concatenate, zip(*held)))
                    held, n = [], 0
        if n:
            yield local_stars(*map(np.concatenate, zip(*held)))

    star = scratch.keep(stars(own.select("node", "digits", "n_digits").mapInArrow(thrifty(cut), _STAR)))
    sides = [own.select(F.col("node").alias(k), F.col("digits").alias(f"f_{s}"), F.col("n_digits").alias(f"n_{s}")) for k, s in (("rep", "a"), ("node", "b"))]
    pairs = scratch.keep(star.select("rep", "node").distinct().join(sides[1], "node"))
    judged = scratch.keep(join_hot(pairs, sides[0], "rep").select("rep", "node", "f_a", "n_a", "f_b", "n_b").mapInArrow(thrifty(_judge(likeness)), "rep long, node long, close boolean"))
    scratch.drop(pairs)
    parts = connected_components(judged.where("close").select(F.col("rep").alias("a"), F.col("node").alias("b")), scratch)
    apart = not_joined(judged, parts, scratch)
    pairs, many = component_pairs(star, apart, scratch)
    sizes = scratch.keep(parts.groupBy("component").agg(F.count("*").alias("size")))
    # two components of one node each that are the ends of a row were judged
    told = apart.select(F.least("ca", "cb").alias("a"), F.greatest("ca", "cb").alias("b")).distinct()
    for k in ("a", "b"):
        told = told.join(sizes.select(F.col("component").alias(k)), k, "left_anti")
    pairs = scratch.keep(pairs.join(told, ["a", "b"], "left_anti"))
    scratch.drop(judged)
    met = []
    if not pairs.isEmpty():
        met.append(hosted(pairs, sizes, parts, scratch))
    if not many.isEmpty():
        met.append(cells(bucket_members(star, many, parts, scratch), crowded).select("key", "cell", "node", "component"))
    if not met:
        return parts
    edges = parts.select(F.col("node").alias("a"), F.col("component").alias("b"))
    for rows in met:
        whole = rows.join(own.select("node", "digits", "n_digits"), "node")
        edges = edges.unionByName(whole.groupBy("key", "cell").applyInArrow(_across(likeness), "a long, b long"))
    return connected_components(edges, scratch)
