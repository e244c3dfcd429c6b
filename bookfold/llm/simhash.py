"""SimHash near-dedup: 64-bit fingerprints, pigeonhole blocks, components of close fingerprints."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce
from itertools import combinations
from math import ceil, comb, log2
from operator import xor

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, by_bytes, connected_components, join_hot, materialize, renamed, table, text_bytes, thrifty
from .edit_bands import _HELD, _STAR, bucket_members, cells, component_pairs, hosted, local_stars, not_joined, stars

BITS = 64
#: Shingles whose bits are summed at once.
_STEP = 1 << 15


def fingerprint(text: bytes | None, shingle: int = 4) -> int:
    """SimHash of a text: A-Z lower-cased, words between ASCII white space, XXH64 (seed 42) of each
    space-joined shingle, repeats included; a bit is set if it is in over half of the hashes.

    A text with fewer words than ``shingle`` is one shingle; one without words (or null) gives 0.
    """
    words = (text or b"").lower().split()
    n = len(words)
    if not n:
        return 0
    joined = b" ".join(words)
    digest = xxhash.xxh64_digest
    if n <= shingle:
        return int.from_bytes(digest(joined, 42), "big")
    lengths = np.fromiter(map(len, words), np.int64, n)
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths)[: n - shingle + 1]
    ends = ends[shingle - 1 :]
    counts = np.zeros(BITS, np.int64)
    for at in range(0, len(starts), _STEP):
        spans = zip(starts[at : at + _STEP].tolist(), ends[at : at + _STEP].tolist())
        hashes = np.frombuffer(b"".join([digest(joined[a:b], 42) for a, b in spans]), np.uint8)
        counts += np.unpackbits(hashes.reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > len(starts)).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4) -> DataFrame:
    """``id, fp`` (a signed long) and ``th`` (a hash of the text) of every row of ``docs``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in by_bytes(batches, 2, 8 << 20):
            fps = np.array([fingerprint(t, shingle) for t in b.column(2).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(fps)], names=["id", "th", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(F.col(text_col)).alias("th"), text_bytes(text_col).alias("text")).mapInArrow(run, "id long, th long, fp long")


def block_masks(n: int, radius: int) -> list[int]:
    """Masks of the block sets to join on, for ``n`` distinct fingerprints.

    With b blocks, a pair that differs in at most ``radius`` bits agrees on b - radius blocks, so it
    meets under one of the C(b, radius) masks. b grows with n so that unrelated fingerprints
    seldom meet; the links found are the same for any b.
    """
    blocks = radius + 1
    while blocks < radius + 8 and comb(blocks, radius) * n / 2.0 ** (BITS * (blocks - radius) / blocks) > 4:
        blocks += 1
    cuts = [round(BITS * i / blocks) for i in range(blocks + 1)]
    parts = [((1 << (hi - lo)) - 1) << lo for lo, hi in zip(cuts, cuts[1:])]
    return [sum(kept) for kept in combinations(parts, blocks - radius)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _bucket_links(radius: int):
    """Links inside buckets: rows come sorted by ``mask, key``; of the close pairs of a bucket a
    spanning forest is returned, which has the same components and at most one row per member."""

    def forest(where: np.ndarray, fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        parent = np.arange(len(fps))

        def root(i: int) -> int:
            while parent[i] != i:
                parent[i] = parent[parent[i]]
                i = parent[i]
            return i

        joined = []
        live = np.arange(len(fps) - 1)
        gap = 1
        while len(live):
            live = live[live + gap < len(fps)]
            live = live[where[live] == where[live + gap]]
            close = live[np.bitwise_count(fps[live] ^ fps[live + gap]) <= radius]
            for i in close.tolist():
                a, b = root(i), root(i + gap)
                if a != b:
                    parent[b] = a
                    joined.append((i, i + gap))
            gap += 1
        pairs = np.array(joined, np.int64).reshape(-1, 2)
        return fps[pairs[:, 0]], fps[pairs[:, 1]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.empty(0, np.int64)] * 3
        for b in batches:
            held = [np.concatenate([h, c.to_numpy()]) for h, c in zip(held, b.columns)]
            new = np.flatnonzero((np.diff(held[0]) != 0) | (np.diff(held[1]) != 0)) + 1
            if len(new) and len(held[0]) >= 1 << 16:
                done, held = [h[: new[-1]] for h in held], [h[new[-1] :] for h in held]
                yield links(done)
        if len(held[0]):
            yield links(held)

    def links(held: list[np.ndarray]) -> pa.RecordBatch:
        where = np.concatenate([[0], np.cumsum((np.diff(held[0]) != 0) | (np.diff(held[1]) != 0))])
        a, b = forest(where, held[2].view(np.uint64))
        return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

    return run


def _ball(radius: int):
    """Every point within ``radius`` bits of each fingerprint."""
    steps = np.array([sum(1 << i for i in flips) for k in range(radius + 1) for flips in combinations(range(BITS), k)], np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = b.column(0).to_numpy()
            for at in range(0, len(fps), 64):
                own = fps[at : at + 64]
                points = own.view(np.uint64)[:, None] ^ steps[None, :]
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(own, len(steps))), pa.array(points.ravel().view(np.int64))], names=["fp", "point"])

    return run


def links(fps: DataFrame, scratch: Scratch, radius: int = 4, crowded: int = 4096) -> DataFrame:
    """Edges ``a, b`` between distinct fingerprints (column ``fp``, a stored table) whose components are those of
    all pairs at ``radius`` or fewer differing bits.

    Fingerprints are joined on pigeonhole blocks and verified. A bucket of more than ``crowded``
    distinct fingerprints is not compared pairwise: two fingerprints are within an even radius 2q
    exactly if some point lies within q bits of both, so each member is linked to the smallest
    member that shares a point with it. Both ways are exact; none drops a pair.
    """
    if radius % 2 or not 0 <= radius < BITS:
        raise ValueError("radius must be even and below 64")
    masks = block_masks(fps.count(), radius)
    keys = fps.select("fp", F.explode(F.array(*[F.struct(F.lit(i).cast("long").alias("mask"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("key")) for i, m in enumerate(masks)])).alias("k")).select("k.mask", "k.key", "fp")
    full = keys.groupBy("mask", "key").agg(F.count("*").alias("n")).where(F.col("n") > crowded).select("mask", "key")
    full = scratch.keep(full)
    pairs = keys
    crowd = None
    if not full.isEmpty():
        pairs = keys.join(full, ["mask", "key"], "left_anti")
        crowd = keys.join(full, ["mask", "key"], "left_semi").select("fp").distinct()
    near = pairs.select("mask", "key", "fp").repartition("mask", "key").sortWithinPartitions("mask", "key").mapInArrow(_bucket_links(radius), "a long, b long")
    if crowd is not None:
        points = scratch.keep(crowd).mapInArrow(_ball(radius // 2), "fp long, point long")
        least = points.groupBy("point").agg(F.min("fp").alias("b"), F.max("fp").alias("top")).where("b <> top").drop("top")
        near = near.unionByName(points.join(least, "point").select(F.col("fp").alias("a"), "b").where("a <> b").distinct())
    return near


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, radius: int = 4, crowded: int = 4096) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, fingerprint`` (16 lowercase hex digits), ``component_id``.

    ``component_id`` is the smallest id reachable over links of ``radius`` or fewer differing bits.
    Null and empty texts have fingerprint zero and link like any other; rows with a null id get the
    smallest id of their component, null if it has none; repeated rows stay repeated; other columns of
    ``docs`` are not read; an empty table gives no rows.
    """
    own = materialize(fingerprints(docs, id_col, text_col, shingle))
    scratch = Scratch(docs.sparkSession)
    distinct = scratch.keep(own.groupBy("fp").agg(F.min("id").alias("first")))
    parts = connected_components(links(distinct.select("fp"), scratch, radius, crowded), scratch).toDF("fp", "component")
    named = scratch.keep(distinct.join(parts, "fp", "left").withColumn("component", F.coalesce("component", "fp")))
    lows = named.groupBy("component").agg(F.min("first").alias("low"))
    low = materialize(join_hot(named.select("fp", "component"), lows, "component").select("fp", "low"))
    scratch.close()
    return join_hot(own, low, "fp").select(F.col("id").alias("doc_id"), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), F.col("low").alias("component_id"))


def shingle_set(text: bytes | None, shingle: int = 5) -> np.ndarray:
    """The XXH64 hashes of a text's distinct shingles, ascending; none for a text without words."""
    words = (text or b"").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    joined = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    last = ends[min(shingle, len(words)) - 1 :]
    starts = np.concatenate([[0], ends[: len(last) - 1] + 1])
    return np.sort(np.fromiter({digest(joined[a:b], 42) for a, b in zip(starts.tolist(), last.tolist())}, np.uint64))


def set_fingerprint(hashes: np.ndarray) -> int:
    """SimHash of a set of shingle hashes: a bit is set if it is in over half of them."""
    counts = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), _STEP):
        counts += np.unpackbits(hashes[at : at + _STEP].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > len(hashes)).tobytes(), "big")


def parities(hashes: np.ndarray) -> bytes:
    """A bit for each of 2^k bins of a set of hashes, about as many as hashes and 64 at least: whether the bin, a hash's
    last k bits, holds an odd number. Sets differ in at least as many hashes as these bits differ, and the halves of the
    bits joined by XOR are those of half the bins."""
    bins = 1 << max(6, round(log2(max(1, len(hashes)))))
    return np.packbits((np.bincount((hashes & np.uint64(bins - 1)).astype(np.int64), minlength=bins) & 1).astype(np.uint8)).tobytes()


def differing(x: bytes, y: bytes) -> int:
    """In how many of the shorter one's bits ``parities`` differ."""
    size = min(len(x), len(y))
    x, y = (reduce(xor, (int.from_bytes(v[at : at + size]) for at in range(0, len(v), size))) for v in (x, y))
    return (x ^ y).bit_count()


#: Documents that the order of shingles is taken from, and shingles that it holds at most.
ORDER_DOCS, ORDER_SHINGLES = 8192, 200_000


def prefix_of(hashes: np.ndarray, similarity: float, common: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The first ``n - ceil(similarity * n) + 1`` of a set of ``n`` in the order of ``common`` (hashes, ascending, and
    their counts; others count 0), then of hash. Two sets at ``similarity`` or more share one of these, whatever the order."""
    n = len(hashes)
    if not n:
        return hashes
    count = np.zeros(n, np.int64)
    if len(common[0]):
        at = np.minimum(np.searchsorted(common[0], hashes), len(common[0]) - 1)
        count = np.where(common[0][at] == hashes, common[1][at], 0)
    return hashes[np.argsort(count, kind="stable")[: n - ceil(similarity * n - 1e-9) + 1]]


def _common(plain: DataFrame, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that several documents of a bounded sample have, and in how many. They only order the prefixes: the
    links found are the same for any sample."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in by_bytes(batches, 0, 2 << 20):
            h, n = np.unique(np.concatenate([shingle_set(t, shingle) for t in b.column(0).to_pylist()]), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n)], names=["h", "n"])

    share = min(1.0, ORDER_DOCS / max(1, plain.count()))
    sample = plain.where(F.pmod(F.xxhash64(F.lit(11), "id", "th"), F.lit(1 << 30)) < int(share * (1 << 30))).select("text")
    found = sample.mapInArrow(thrifty(run), "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).where("n > 2").orderBy(F.desc("n"), "h").limit(ORDER_SHINGLES).toArrow()
    h, n = found.column("h").to_numpy().view(np.uint64), found.column("n").to_numpy()
    by = np.argsort(h)
    return h[by], n[by]


def _similar(similarity: float) -> Column:
    """Whether the exact Jaccard similarity of the sets ``s_a`` and ``s_b`` is ``similarity`` or more. It is judged a row
    at a time in the JVM, so no batch of pairs of whole sets is held."""
    both = F.size(F.array_intersect("s_a", "s_b"))
    return both / (F.size("s_a") + F.size("s_b") - both) >= similarity


def _left_open(similarity: float):
    """Pairs with whether their ``parities`` leave it open that their sets are at ``similarity``."""
    most = (1 - similarity) / (1 + similarity)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = zip(*[b.column(c).to_pylist() for c in ("odd_a", "odd_b", "n_a", "n_b")])
            left = pa.array([differing(x, y) <= most * (n + m) + 1e-9 for x, y, n, m in rows], pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b"), left], names=["a", "b", "open"])

    return run


#: Pairs a member up to which a cell's pairs are listed, to be judged once for all cells.
DENSE = 16


def _open_across(similarity: float, dense: float):
    """Of the members of two parts of a bucket (``node, component, n, odd``), the pairs ``a, b`` in different components
    that their ``parities`` leave open, without ``key`` and ``cell``. If these are more than ``dense`` a member, the rows
    are the members of such pairs instead, ``a, b`` their node and component. Every pair at ``similarity`` is left open."""
    most = (1 - similarity) / (1 + similarity)

    def run(t: pa.Table) -> pa.Table:
        n = t.column("n").to_numpy()
        order = np.argsort(n, kind="stable")
        n, node, component = n[order], t.column("node").to_numpy()[order], t.column("component").to_numpy()[order]
        odd = t.column("odd").to_pylist()
        odd = [odd[i] for i in order.tolist()]
        length = np.array(list(map(len, odd)))
        ends = np.searchsorted(n, n / similarity + 1e-9, "right")
        found, listed, held = np.zeros(len(n), bool), [], 0
        for size in np.unique(length).tolist():
            # larger sets have as many bits or more
            low, high = np.searchsorted(length, [size, size + 1]).tolist()
            bits = np.empty((ends[high - 1] - low, size // 8), np.uint64)
            for other in np.unique(length[low : ends[high - 1]]).tolist():
                at, to = np.searchsorted(length[: ends[high - 1]], [other, other + 1]).tolist()
                wide = np.frombuffer(b"".join(odd[at:to]), np.uint64).reshape(to - at, -1)
                while wide.shape[1] > size // 8:
                    wide = wide[:, : wide.shape[1] // 2] ^ wide[:, wide.shape[1] // 2 :]
                bits[at - low : to - low] = wide
            for i in range(low, high):
                j = i + 1 + np.flatnonzero(component[i + 1 : ends[i]] != component[i])
                if len(j):
                    j = j[np.bitwise_count(bits[j - low] ^ bits[i - low]).sum(axis=1, dtype=np.int64) <= most * (n[j] + n[i]) + 1e-9]
                if len(j):
                    found[i] = found[j] = True
                    held += len(j)
                    if held <= dense * len(n):
                        listed.append((np.full(len(j), node[i]), node[j]))
        if held > dense * found.sum():
            place = [np.full(found.sum(), t.column(c)[0].as_py()) for c in ("key", "cell")]
            return pa.table([*map(pa.array, place), pa.array(node[found]), pa.array(component[found])], names=["key", "cell", "a", "b"])
        a, b = (np.concatenate([np.empty(0, np.int64), *x]) for x in (zip(*listed) if listed else ((), ())))
        none = pa.nulls(len(a), pa.int64())
        return pa.table([none, none, pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["key", "cell", "a", "b"])

    return run


def _jaccard_across(similarity: float):
    """Links between members of two parts of a bucket that are in different components."""

    def run(t: pa.Table) -> pa.Table:
        node, label = t.column("node").to_numpy(), np.unique(t.column("component").to_numpy(), return_inverse=True)[1]
        sets = t.column("set").combine_chunks()
        n = sets.value_lengths().to_numpy().astype(np.int64)
        starts = np.cumsum(n) - n
        values, flat = np.unique(sets.flatten().to_numpy(), return_inverse=True)
        found = []
        # members of the largest component are compared with the others only
        for i in np.flatnonzero(label != np.bincount(label).argmax()).tolist():
            own = np.zeros(len(values), np.int64)
            own[flat[starts[i] : starts[i] + n[i]]] = 1
            both = np.add.reduceat(own[flat], starts)
            for j in np.flatnonzero(both / (n + n[i] - both) >= similarity).tolist():
                if label[j] != label[i]:
                    found.append((node[i], node[j]))
                    label[label == label[j]] = label[i]
        pairs = np.array(found, np.int64).reshape(-1, 2)
        return pa.table([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

    return run


def _shared(similarity: float) -> Column:
    """How many hashes of their prefixes sets of ``n_a`` and ``n_b`` at ``similarity`` share at least: the hashes that they
    share must be so many, and beyond the prefix that ends first there are only the rest of its set. None if the sizes differ too much."""
    both = F.ceil(similarity / (1 + similarity) * (F.col("n_a") + F.col("n_b")) - 1e-9)
    rest = F.ceil(similarity * F.greatest("n_a", "n_b") - 1e-9) - 1
    return F.when(F.least("n_a", "n_b") >= similarity * F.greatest("n_a", "n_b") - 1e-9, F.greatest(both - rest, F.lit(1)))


def fingerprint_pairs(own: DataFrame, scratch: Scratch, radius: int, crowded: int) -> DataFrame:
    """Candidate pairs ``a, b`` of nodes by SimHash: of ``own`` (``node, print``), nodes with the same fingerprint are held
    against one of them, and these against each other where pigeonhole blocks find ``radius`` or fewer differing bits."""
    nodes = scratch.keep(own.select("node", F.col("print").alias("fp")).distinct())
    firsts = scratch.keep(nodes.groupBy("fp").agg(F.min("node").alias("first")))
    same = join_hot(nodes, firsts, "fp").where("node <> first").select(F.col("first").alias("a"), F.col("node").alias("b"))
    near = links(firsts.select("fp"), scratch, radius, crowded)
    for k in ("a", "b"):
        near = near.join(firsts.select(F.col("fp").alias(k), F.col("first").alias(f"first_{k}")), k)
    near = near.select(F.least("first_a", "first_b").alias("a"), F.greatest("first_a", "first_b").alias("b"))
    return scratch.keep(same.unionByName(near).distinct())


def set_links(own: DataFrame, sets_of: Callable[[DataFrame], DataFrame], scratch: Scratch, similarity: float, radius: int, crowded: int) -> DataFrame:
    """Edges ``a, b`` whose components are those of all pairs of sets at Jaccard ``similarity`` or more.

    ``own``, a stored table, has ``node, n, print, prefix, odd`` of sets (``odd``: their ``parities``), ``sets_of`` gives
    ``node, set`` for a table of ``node``.

    First come the pairs whose SimHash fingerprints differ in at most ``radius`` bits, found on pigeonhole blocks; each is
    confirmed by its sets. Fingerprints of sets at 0.8 differ in about ten bits of 64, up to twenty, and no block
    would be left for these; so what the fingerprints don't join is completed exactly: sets at ``similarity`` or more share
    a hash of their prefixes. Each bucket of such a hash holds its members against one of them. Components that still
    share buckets are compared: those of one node each if they share enough of them, others member by member in cells,
    each in a task of its own; so are the members of a bucket with very many components, by pairs of parts if they are
    over ``crowded``. Cells get the parities of sets, a 64th of their size; only the pairs that these leave open are
    judged by their sets, each once however many cells it is in, or in their cell where there are too many to list. So
    are pairs that share enough hashes.
    """
    odd = scratch.keep(own.select("node", "n", "odd").distinct())

    def judge(pairs: DataFrame) -> DataFrame:
        """``a, b, close`` of stored ``pairs`` ``a, b, open``; false without a look where not ``open``."""
        wanted = pairs.where("open").select("a", "b")
        sets = scratch.keep(sets_of(wanted.select(F.explode(F.array("a", "b")).alias("node")).distinct()))
        for k in ("a", "b"):
            wanted = wanted.join(sets.select(F.col("node").alias(k), F.col("set").alias(f"s_{k}")), k)
        done = wanted.select("a", "b", _similar(similarity).alias("close"))
        out = scratch.keep(done.unionByName(pairs.where("not open").select("a", "b", F.lit(False).alias("close"))))
        scratch.drop(sets)
        return out

    def sized(pairs: DataFrame) -> DataFrame:
        """Pairs ``a, b, n`` with ``open``: whether they share enough hashes of their prefixes."""
        for k in ("a", "b"):
            pairs = pairs.join(odd.select(F.col("node").alias(k), F.col("n").alias(f"n_{k}")), k)
        return pairs.withColumn("open", F.coalesce(F.col("n") >= _shared(similarity), F.lit(False)))

    def left_open(pairs: DataFrame) -> DataFrame:
        """Stored pairs ``a, b, open``, ``open`` no longer where their parities differ too much."""
        wanted = pairs.where("open").select("a", "b")
        for k in ("a", "b"):
            wanted = wanted.join(odd.toDF(k, f"n_{k}", f"odd_{k}"), k)
        told = wanted.mapInArrow(thrifty(_left_open(similarity)), "a long, b long, open boolean")
        return scratch.keep(told.unionByName(pairs.where("not open")))

    first = judge(fingerprint_pairs(own, scratch, radius, crowded).withColumn("open", F.lit(True)))
    known = connected_components(first.where("close").select("a", "b"), scratch)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        n = 0
        for b in batches:
            for node, prefix in zip(*[c.to_pylist() for c in b.columns]):
                key = np.frombuffer(prefix, np.int64)
                held.append((key, np.zeros(len(key), np.int64), np.full(len(key), node, np.int64)))
                n += len(key)
                if n >= _HELD:
                    yield local_stars(*map(np.concatenate, zip(*held)))
                    held, n = [], 0
        if n:
            yield local_stars(*map(np.concatenate, zip(*held)))

    star = scratch.keep(stars(own.select("node", "prefix").mapInArrow(thrifty(cut), _STAR)))
    pairs = star.groupBy(F.col("rep").alias("a"), F.col("node").alias("b")).agg(F.count("*").alias("n"))
    for k in ("a", "b"):
        pairs = pairs.join(known.toDF(k, f"c_{k}"), k, "left")
    joined = F.coalesce("c_a", "a") == F.coalesce("c_b", "b")
    pairs = left_open(scratch.keep(sized(pairs.where(~joined)).select("a", "b", "open")))
    judged = judge(pairs)
    edges = known.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(judged.where("close").select("a", "b"))
    parts = connected_components(edges, scratch)
    edges = parts.select(F.col("node").alias("a"), F.col("component").alias("b"))
    apart = not_joined(judged.toDF("rep", "node", "close"), parts, scratch)
    met, many = component_pairs(star, apart, scratch)
    scratch.drop(pairs, judged)
    grown = scratch.keep(parts.groupBy("component").agg(F.count("*").alias("size")))
    for k in ("a", "b"):
        met = met.join(grown.toDF(k, f"g_{k}"), k, "left")
    met = scratch.keep(met)
    # components of one node each share as many hashes of their prefixes as buckets
    single = F.col("g_a").isNull() & F.col("g_b").isNull()
    counted = scratch.keep(sized(met.where(single).select("a", "b", "n")).where("open").select("a", "b", "open"))
    listed, across = left_open(counted).where("open").select("a", "b"), []
    cell_rows = []
    grown_pairs = met.where(~single).select("a", "b")
    if not grown_pairs.isEmpty():
        cell_rows.append(hosted(grown_pairs, grown, parts, scratch))
    if not many.isEmpty():
        cell_rows.append(cells(bucket_members(star, many, parts, scratch), crowded).select("key", "cell", "node", "component"))
    for rows in cell_rows:
        rows = scratch.keep(rows).join(odd, "node")
        across.append(scratch.keep(rows.groupBy("key", "cell").applyInArrow(_open_across(similarity, DENSE), "key long, cell long, a long, b long")))
        listed = listed.unionByName(across[-1].where("key is null").select("a", "b"))
    edges = edges.unionByName(judge(scratch.keep(listed.distinct().withColumn("open", F.lit(True)))).where("close").select("a", "b"))
    for found in across:
        rows = found.where("key is not null").select("key", "cell", F.col("a").alias("node"), F.col("b").alias("component"))
        if not rows.isEmpty():
            sets = scratch.keep(sets_of(rows.select("node").distinct()))
            edges = edges.unionByName(scratch.keep(rows.join(sets, "node").groupBy("key", "cell").applyInArrow(_jaccard_across(similarity), "a long, b long")))
    return edges


#: Rows up to which keys of rows are broadcast.
FEW = 1 << 20


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, similarity: float = 0.8, radius: int = 4, crowded: int = 4096) -> DataFrame:
    """``docs`` with one row of each component: the one with the smallest id (nulls last), then text hash.

    Links are pairs of texts whose sets of shingle hashes have a Jaccard similarity of ``similarity`` or more, all of
    them at any number of rows (see ``set_links``). Null and empty texts and others without words are equal; very long
    texts are taken whole. All columns of ``docs`` stay, whatever their names; of repeated rows one stays; an empty
    table gives no rows.
    """
    own_names, (docs, at) = docs.columns, renamed(docs)
    spark = docs.sparkSession
    scratch = Scratch(spark)
    ident = F.col(at[id_col]).cast("long")
    row_id = [F.coalesce(ident, F.lit(0).cast("long")).alias("id"), ident.isNull().alias("none"), F.xxhash64(F.col(at[text_col])).alias("th")]
    keys = ["id", "none", "th"]
    plain = docs.select(*row_id, text_bytes(at[text_col]).alias("text"))
    common = spark.sparkContext.broadcast(_common(plain, shingle))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in by_bytes(batches, 3, 2 << 20):
            sets = [shingle_set(t, shingle) for t in b.column(3).to_pylist()]
            node = np.array([xxhash.xxh64_intdigest(s.tobytes(), 42) for s in sets], np.uint64).view(np.int64)
            prints = np.array(list(map(set_fingerprint, sets)), np.uint64).view(np.int64)
            prefix = [prefix_of(s, similarity, common.value).tobytes() for s in sets]
            odd = pa.array(map(parities, sets), pa.binary())
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(node), pa.array(list(map(len, sets)), pa.int64()), pa.array(prints), pa.array(prefix, pa.binary()), odd], names=[*keys, "node", "n", "print", "prefix", "odd"])

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in by_bytes(batches, 1, 2 << 20):
            found = [shingle_set(t, shingle).view(np.int64) for t in b.column(1).to_pylist()]
            ends = np.cumsum([0, *map(len, found)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(found)))], names=["node", "set"])

    own = scratch.keep(plain.mapInArrow(thrifty(run), "id long, none boolean, th long, node long, n long, print long, prefix binary, odd binary"))
    first = scratch.keep(own.groupBy("node").agg(F.min(F.struct("none", "id", "th")).alias("first")))

    def sets_of(wanted: DataFrame) -> DataFrame:
        rows = scratch.keep(first.join(wanted, "node", "left_semi").select("node", "first.*"))
        few = F.broadcast(rows) if rows.count() <= FEW else rows
        return plain.join(few, keys).select("node", "text").mapInArrow(thrifty(sets), "node long, set array<long>").dropDuplicates(["node"])

    parts = connected_components(set_links(own.where("n > 0"), sets_of, scratch, similarity, radius, crowded), scratch)
    kept = first.join(parts, "node", "left").groupBy(F.coalesce("component", "node").alias("component")).agg(F.min("first").alias("first")).select("first.*")
    kept = scratch.keep(kept)
    again = scratch.keep(own.groupBy(*keys).count().where("count > 1").select(keys))
    gone = materialize(own.select(keys).distinct().join(kept, keys, "left_anti").unionByName(again).distinct())
    back = materialize(again.join(kept, keys, "left_semi"))
    scratch.close()
    keyed = docs.select("*", *row_id)
    out = keyed.join(F.broadcast(gone) if gone.count() <= FEW else gone, keys, "left_anti")
    if not back.isEmpty():
        out = out.unionByName(keyed.join(back, keys, "left_semi").dropDuplicates(keys))
    return out.drop(*keys).toDF(*own_names)


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_components(table(spark, sf_dir, "documents"))
