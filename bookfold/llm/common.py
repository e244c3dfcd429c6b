"""Helpers that the operators share: tables in the shared folder, row keys, components."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Keys that are treated apart at most, because so many rows have them.
HOT_KEYS = 8192
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_folder(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``; a temporary folder only where none is set and the master is local."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        folder = sc.getConf().get("spark.checkpoint.dir", None)
        if folder is None and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="bookfold-checkpoint-"))
    return sc._jsc.sc().getCheckpointDir().get()


@contextmanager
def shuffles_removed(spark: SparkSession):
    """What is run inside leaves no shuffle files behind once it is done."""
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)


def materialize(df: DataFrame) -> DataFrame:
    """Cut the lineage of ``df`` with a reliable checkpoint. Spark removes it with its last reader only where
    ``spark.cleaner.referenceTracking.cleanCheckpoints`` is set; else it stays in the shared folder."""
    shared_folder(df.sparkSession)
    with shuffles_removed(df.sparkSession):
        return df.checkpoint(eager=True)


class Scratch:
    """Tables of an operator's steps, written as Parquet in the shared folder and removed when no longer read."""

    def __init__(self, spark: SparkSession):
        self._spark = spark
        self._folder = f"{shared_folder(spark)}/bookfold-{uuid.uuid4().hex}"
        self._made = 0
        self._paths: dict[int, str] = {}

    def keep(self, df: DataFrame) -> DataFrame:
        """``df`` from a table of its own."""
        self._made += 1
        path = f"{self._folder}/{self._made}"
        with shuffles_removed(self._spark):
            df.write.option("compression", "zstd").parquet(path)
        out = self._spark.read.schema(df.schema).parquet(path)
        self._paths[id(out)] = path
        out._kept = self
        return out

    def _remove(self, path: str) -> None:
        at = self._spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(self._spark._jsc.hadoopConfiguration()).delete(at, True)

    def drop(self, *tables: DataFrame) -> None:
        """Remove tables that nothing reads any more."""
        for t in tables:
            if path := self._paths.pop(id(t), None):
                self._remove(path)

    def close(self) -> None:
        self._paths.clear()
        self._remove(self._folder)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def renamed(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """``docs`` with its columns as c0, c1, …, and these by their old names, so that no name clashes with one of the operator's."""
    names = [f"c{i}" for i in range(len(docs.columns))]
    return docs.toDF(*names), dict(zip(docs.columns, names))


def text_bytes(column: str = "text"):
    """The UTF-8 bytes of a text column, so that Python workers get bytes without decoding."""
    return F.col(column).cast("string").cast("binary")


def partitions_for(spark: SparkSession, total_bytes: int, each: int) -> int:
    """How many shuffle partitions hold ``total_bytes`` at about ``each`` bytes a partition."""
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return max(least, -(-int(total_bytes) // each))


def rows(batch: pa.RecordBatch, step: int) -> Iterator[pa.RecordBatch]:
    """Slices of a batch of at most ``step`` rows."""
    for at in range(0, batch.num_rows, step):
        yield batch.slice(at, step)


def by_bytes(batches: Iterator[pa.RecordBatch], column: int, limit: int) -> Iterator[pa.RecordBatch]:
    """Slices of batches whose binary ``column`` holds at most ``limit`` bytes (or one row)."""
    for batch in batches:
        sizes = pc.binary_length(batch.column(column)).fill_null(0).to_pylist()
        start = held = 0
        for i, n in enumerate(sizes):
            if i > start and held + n > limit:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += n
        if batch.num_rows > start:
            yield batch.slice(start)


def join_hot(left: DataFrame, right: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """``left``, a stored table, joined with ``right``, which has at most one row for each ``key``.

    Keys with more than a ``HOT_KEYS``-th of the rows, of which there are at most as many, are found by pre-aggregated
    counts and their rows of ``right`` are broadcast, so that no key's rows meet in one task.
    """
    total = left.count()
    limit = max(1000, total // HOT_KEYS)
    hot = left.where(F.col(key).isNotNull()).groupBy(key).count().where(F.col("count") > limit).select(key).collect() if total > limit else []
    if not hot:
        return left.join(right, key, how)
    few = F.broadcast(left.sparkSession.createDataFrame(hot, left.select(key).schema))
    rest = left.join(few, key, "left_anti").join(right, key, how)
    return left.join(few, key, "left_semi").join(F.broadcast(right.join(few, key)), key, how).unionByName(rest)


def give_back() -> None:
    """Memory that Arrow and the C library keep after it was freed goes back to the system, where they can do so."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def thrifty(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
    """``run`` over a task's batches, after which the Python worker, which Spark keeps for its next task, gives back what it freed."""

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        give_back()

    return over


def local_components(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of a list of edges and each node's smallest reachable node."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    low = np.arange(len(nodes))
    while True:
        p, q = low[x], low[y]
        apart = p != q
        if not apart.any():
            return nodes, nodes[low]
        x, y, p, q = x[apart], y[apart], p[apart], q[apart]
        np.minimum.at(low, np.maximum(p, q), np.minimum(p, q))
        while (low[low] != low).any():
            low = low[low]


_EDGE = "hi long, lo long, changed boolean"


def _edges(hi: np.ndarray, lo: np.ndarray, changed: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(hi), pa.array(lo), pa.array(changed)], names=["hi", "lo", "changed"])


def _forest(batches: Iterator[pa.RecordBatch], most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """The edges of a task, ``most`` at a time, as edges from each node to the smallest of its component among them.

    Of a node's edges only one is left, so a node seldom has more smaller neighbours than there are tasks.
    """
    held: list[list[np.ndarray]] = [[], [], []]
    n = 0

    def flush() -> pa.RecordBatch:
        a, b, changed = (np.concatenate(x) for x in held)
        nodes, low = local_components(a, b)
        other = nodes != low
        return _edges(nodes[other], low[other], np.full(int(other.sum()), bool(changed.any())))

    for batch in batches:
        for k in range(3):
            held[k].append(batch.column(k).to_numpy(zero_copy_only=False))
        n += batch.num_rows
        if n >= most:
            yield flush()
            held, n = [[], [], []], 0
    if n:
        yield flush()


def _star(large: bool):
    """Large-star or small-star over rows ``u, v, changed`` sorted by ``u, v``: the first row of a key has its least neighbour."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last_u = last_v = least = None
        for b in batches:
            if not b.num_rows:
                continue
            u, v, changed = (c.to_numpy(zero_copy_only=False) for c in b.columns)
            fresh = np.concatenate([[last_u is None or last_u != u[0]], u[1:] != u[:-1]])
            new = fresh | np.concatenate([[last_v is None or last_v != v[0]], v[1:] != v[:-1]])
            lead = np.maximum.accumulate(np.where(fresh, np.arange(len(u)), -1))
            m = np.where(lead >= 0, v[np.maximum(lead, 0)], v[0] if least is None else least)
            last_u, last_v, least = u[-1], v[-1], m[-1]
            if large:
                m = np.minimum(m, u)
                use = new & (v > u)
                yield _edges(v[use], m[use], changed[use] | (m[use] != u[use]))
            else:
                yield _edges(u[fresh], m[fresh], changed[fresh])
                more = new & ~fresh
                yield _edges(v[more], m[more], np.ones(int(more.sum()), bool))

    return run


def connected_components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """Components of an undirected graph given as edges ``a, b`` of longs.

    Returns ``node, component`` (the smallest node reachable) for every node that has an edge, from a table of ``scratch``.
    Alternates large-star and small-star rounds (Kiveris et al., 2014). A star is one shuffle: rows come sorted, so a
    key's least neighbour is its first and no neighbourhood is held. Before each, a task's own edges become a forest.
    Nodes with so many larger neighbours that they would fill a task (at most ``HOT_KEYS`` of them) are broadcast with
    their least neighbour instead. The number of rounds grows with the logarithm of the longest path.
    """
    plain = edges.where("a <> b").select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo"), F.lit(False).alias("changed"))
    now = scratch.keep(plain.mapInArrow(_forest, _EDGE))
    while True:
        n = now.count()
        both = now.select(F.col("hi").alias("u"), F.col("lo").alias("v"), "changed").unionByName(now.select(F.col("lo").alias("u"), F.col("hi").alias("v"), "changed"))
        both = both.withColumn("changed", F.lit(False))
        limit = max(1000, 2 * n // HOT_KEYS)
        hot = [tuple(r) for r in both.groupBy("u").agg(F.least(F.min("v"), "u").alias("m"), F.count("*").alias("n")).where(F.col("n") > limit).select("u", "m").collect()] if n > limit else []
        rest = both
        if hot:
            few = F.broadcast(now.sparkSession.createDataFrame(hot, "u long, m long"))
            rest = both.join(F.broadcast(few.select("u")), "u", "left_anti").select("u", "v", "changed")
        # one Python worker for both steps: a task with two keeps two alive
        large = rest.repartition("u").sortWithinPartitions("u", "v").mapInArrow(lambda batches: _forest(_star(True)(batches)), _EDGE)
        if hot:
            large = large.unionByName(both.join(few, "u").where("v > u").select(F.col("v").alias("hi"), F.col("m").alias("lo"), (F.col("m") != F.col("u")).alias("changed")).mapInArrow(_forest, _EDGE))
        small = large.select(F.col("hi").alias("u"), F.col("lo").alias("v"), "changed")
        small = small.repartition("u").sortWithinPartitions("u", "v").mapInArrow(_star(False), _EDGE)
        after = scratch.keep(small)
        scratch.drop(now)
        now = after
        if now.where("changed").isEmpty():
            break
    return now.select(F.col("hi").alias("node"), F.col("lo").alias("component")).unionByName(now.select("lo", "lo").toDF("node", "component").distinct())
