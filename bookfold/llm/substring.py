"""Substring dedup: Rabin-Karp hashes of every window of words, counted in Spark; windows that also
start earlier merge into maximal removal intervals.

Windows travel packed: a map task sends, for each bucket of hashes, one row with the hashes and the
positions of the windows that it saw first, so the shuffle takes about ten bytes a window. What a map
task saw twice itself is marked there and then; a passage that a third of all documents share so
reaches its bucket once a task, not once a document. Marks and documents then meet, packed again, by a
hash of the id."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StringType, StructField, StructType

from .common import by_bytes, give_back, table, thrifty

NO_ID = np.iinfo(np.int64).max
_WORD = re.compile(rb"[^\x20\x09-\x0D]+")
_BASES = (0x9E3779B97F4A7C1B, 0xC2B2AE3D27D4EB53)
#: Bytes of windows that a map task sends at once.
_SENT = 1 << 20
#: Words whose hashes a Python worker remembers at most.
_WORDS_HELD = 50_000


class _Hashes(dict):
    """64-bit hashes of words, remembered up to a bound."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= _WORDS_HELD:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word, 7)
        return h


def _mixed(h: np.ndarray) -> np.ndarray:
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    return h


def _window_hash(words: np.ndarray, window: int, base: int) -> np.ndarray:
    """The Rabin-Karp hash (modulo 2^64) of every window of a sequence of word hashes."""
    n = max(0, len(words) - window + 1)
    h = np.zeros(n, np.uint64)
    for j in range(window):
        h *= np.uint64(base)
        h += words[j : j + n]
    return _mixed(h)


def window_hashes(words: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Two Rabin-Karp hashes (modulo 2^64) of every window of a sequence of word hashes."""
    return _window_hash(words, window, _BASES[0]), _window_hash(words, window, _BASES[1])


def _pack(*columns: np.ndarray) -> bytes:
    """Arrays of one length as compressed byte planes, the first of them as differences."""
    n = len(columns[0])
    first = np.diff(columns[0], prepend=0)
    planes = [np.ascontiguousarray(c).view(np.uint8).reshape(n, -1).T.tobytes() for c in (first, *columns[1:])]
    return zstandard.ZstdCompressor(level=1).compress(b"".join(planes))


def _unpack(blob: bytes, *kinds: str) -> list[np.ndarray]:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8)
    widths = [np.dtype(k).itemsize for k in kinds]
    n = len(raw) // sum(widths)
    out, at = [], 0
    for k, w in zip(kinds, widths):
        out.append(np.ascontiguousarray(raw[at : at + n * w].reshape(w, n).T).view(k).reshape(n))
        at += n * w
    return [np.cumsum(out[0]), *out[1:]]


def _home(ids: np.ndarray, homes: int) -> np.ndarray:
    """Which of ``homes`` (a power of two) groups of documents an id is in."""
    return ((_mixed(ids.astype(np.uint64)) * np.uint64(_BASES[0])) >> np.uint64(40)).astype(np.int64) & (homes - 1)


def _runs(keys: np.ndarray) -> Iterator[tuple[int, slice]]:
    cuts = np.flatnonzero(np.diff(keys)) + 1
    for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(keys)]):
        if b > a:
            yield int(keys[a]), slice(a, b)


def _find(window: int, buckets: int, homes: int, checked: bool, batch_words: int):
    """Map side: packed first windows by bucket (kind 0) and marks of the others by home (kind 1)."""
    shift = np.uint64(64 - (buckets.bit_length() - 1))

    def flush(held: list[tuple[int, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        # every array here has a row a word, so none is kept or made wider than it must be
        held.sort(key=lambda x: x[0])
        sizes = np.array([len(w) for _, w in held], np.int64)
        ids = np.array([i for i, _ in held], np.int64)
        words = np.concatenate([w for _, w in held])
        held.clear()
        give_back()
        inside = np.ones(len(words), bool)
        for j in range(1, window):
            inside[np.cumsum(sizes) - j] = False
        inside = inside[: len(words) - window + 1]
        narrow = np.uint16 if buckets <= 1 << 16 else np.int32
        if buckets == 1:
            b = np.zeros(np.count_nonzero(inside), narrow)
        else:
            b = (_window_hash(words, window, _BASES[1])[inside] >> shift).astype(narrow)
        h = _window_hash(words, window, _BASES[0])[inside]
        del words, inside
        give_back()
        order = np.argsort(h, kind="stable").astype(np.int32)
        same = np.zeros(len(h), bool)
        ordered = h[order]
        np.equal(ordered[1:], ordered[:-1], out=same[1:])
        del ordered
        lead = np.arange(len(h), dtype=np.int32)
        lead[same] = 0
        np.maximum.accumulate(lead, out=lead)
        again, first = order[same], order[lead[same]]
        new = np.sort(order[~same])
        del order, same, lead
        counts = sizes - window + 1
        place = np.repeat(np.arange(len(ids), dtype=np.int32), counts)
        starts = np.arange(len(h), dtype=np.uint32)
        starts -= np.repeat((np.cumsum(counts) - counts).astype(np.uint32), counts)
        give_back()
        late = (ids[place[again]] != ids[place[first]]) | (starts[again] != starts[first])
        again = np.sort(again[late])
        yield from _marks(ids[place[again]], starts[again], h[again])
        del again, first, late
        b = b[new]
        by = np.argsort(b, kind="stable").astype(np.int32)
        new, b = new[by], b[by]
        del by
        out, size = [], 0
        for k, s in _runs(b):
            own = new[s]
            out.append((0, k, h[own].tobytes(), _pack(ids[place[own]], starts[own])))
            size += len(out[-1][2]) + len(out[-1][3])
            if size >= _SENT:
                yield _rows(out)
                out, size = [], 0
        if out:
            yield _rows(out)

    def _marks(doc, starts, h) -> Iterator[pa.RecordBatch]:
        if len(doc):
            yield _rows([(1, k, b"", x) for k, x in _by_home(doc, starts, h, homes, checked)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Hashes()
        held, n = [], 0
        for b in by_bytes(batches, 1, 2 << 20):
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                words = t.split() if t else []
                if len(words) >= window:
                    held.append((NO_ID if i is None else i, np.fromiter(map(known.__getitem__, words), np.uint64, len(words))))
                    n += len(words)
                if n >= batch_words:
                    yield from flush(held)
                    n = 0
        if held:
            yield from flush(held)

    return run


def _rows(found: list[tuple]) -> pa.RecordBatch:
    kind, key, hashes, places = zip(*found)
    return pa.RecordBatch.from_arrays([pa.array(kind, pa.int32()), pa.array(key, pa.int64()), pa.array(hashes, pa.binary()), pa.array(places, pa.binary())], names=["kind", "key", "hashes", "places"])


def _by_home(doc: np.ndarray, starts: np.ndarray, h: np.ndarray, homes: int, checked: bool) -> Iterator[tuple[int, bytes]]:
    home = _home(doc, homes)
    order = np.lexsort((starts, doc, home))
    for k, s in _runs(home[order]):
        own = order[s]
        yield k, _pack(doc[own], starts[own], *([h[own]] if checked else []))


def _judge(homes: int, checked: bool):
    """Reduce side: in a bucket, all windows but the earliest of each hash are marked."""

    def run(t: pa.Table) -> pa.Table:
        kinds = t.column("kind").to_pylist()
        passed = [(k, p) for n, k, p in zip(kinds, t.column("key").to_pylist(), t.column("places").to_pylist()) if n]
        own = [i for i, n in enumerate(kinds) if not n]
        if own:
            h = np.concatenate([np.frombuffer(t.column("hashes")[i].as_py(), np.uint64) for i in own])
            places = [_unpack(t.column("places")[i].as_py(), "<i8", "<u4") for i in own]
            doc, starts = (np.concatenate(x) for x in zip(*places))
            del places
            order = np.argsort(h)
            equal = h[order[1:]] == h[order[:-1]]
            some = order[np.concatenate([[False], equal]) | np.concatenate([equal, [False]])]
            some = some[np.lexsort((starts[some], doc[some], h[some]))]
            h, doc, starts = h[some], doc[some], starts[some]
            fresh = np.concatenate([[True], h[1:] != h[:-1]])[: len(h)]
            lead = np.maximum.accumulate(np.where(fresh, np.arange(len(h)), 0)) if len(h) else np.arange(0)
            late = (doc != doc[lead]) | (starts != starts[lead])
            passed += list(_by_home(doc[late], starts[late], h[late], homes, checked))
        return pa.table([pa.array([k for k, _ in passed], pa.int64()), pa.array([p for _, p in passed], pa.binary())], names=["home", "places"])

    return run


def _gather(homes: int, level: int = 3):
    """Documents packed by home."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        options = pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", level))
        for b in batches:
            ids = b.column(0).fill_null(NO_ID).to_numpy(zero_copy_only=False)
            home = _home(ids, homes)
            order = np.argsort(home, kind="stable")
            keys, blobs = [], []
            for k, s in _runs(home[order]):
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, b.schema, options=options) as out:
                    out.write_batch(b.take(pa.array(order[s])))
                keys.append(k)
                blobs.append(sink.getvalue().to_pybytes())
            if keys:
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(blobs, pa.binary())], names=["home", "docs"])

    return run


def _remove(window: int, checked: bool, digest: bool):
    """A home's documents with their marks."""
    known = _Hashes()

    def kept(text: bytes | None, own: tuple[np.ndarray, np.ndarray | None] | None) -> tuple[int, int, str | bytes | None]:
        if own is None:
            words = text.split() if text else []
            return len(words), 0, hashlib.sha256(b" ".join(words)).hexdigest() if digest else text
        words = text.split() if text else []
        starts, h = own
        if checked:
            true = window_hashes(np.fromiter(map(known.__getitem__, words), np.uint64, len(words)), window)[0]
            fits = starts < len(true)
            starts = starts[fits][true[starts[fits]] == h[fits]]
        n = len(words)
        change = np.zeros(n + 1, np.int64)
        np.add.at(change, starts, 1)
        np.add.at(change, starts.astype(np.int64) + window, -1)
        gone = np.cumsum(change)[:n] > 0
        if not gone.any():
            return n, 0, hashlib.sha256(b" ".join(words)).hexdigest() if digest else text
        if digest:
            return n, int(gone.sum()), hashlib.sha256(b" ".join([w for w, x in zip(words, gone.tolist()) if not x])).hexdigest()
        spans = [m.span() for m in _WORD.finditer(text)]
        edges = np.flatnonzero(np.diff(np.concatenate([[True], gone, [True]])))
        return n, int(gone.sum()), b" ".join([text[spans[a][0] : spans[b - 1][1]] for a, b in edges.reshape(-1, 2).tolist()])

    def run(docs: pa.Table, marks: pa.Table) -> pa.Table:
        found: dict[int, tuple] = {}
        if marks.num_rows:
            parts = [_unpack(x, "<i8", "<u4", *(["<u8"] if checked else [])) for x in marks.column("places").to_pylist()]
            columns = [np.concatenate(x) for x in zip(*parts)]
            order = np.argsort(columns[0], kind="stable")
            columns = [c[order] for c in columns]
            for i, s in _runs(columns[0]):
                found[i] = (columns[1][s], columns[2][s] if checked else None)
        out = []
        for blob in docs.column("docs").to_pylist():
            t = pa.ipc.open_stream(blob).read_all()
            ids = t.column("id").to_pylist()
            n, gone, rest = zip(*[kept(x, found.get(NO_ID if i is None else i)) for i, x in zip(ids, t.column("text").to_pylist())])
            out.append(pa.table([t.column("id"), *([] if digest else [t.column("row")]), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(rest, pa.string() if digest else pa.binary())], names=["id", *([] if digest else ["row"]), "n_words", "n_removed", "kept"]))
        return pa.concat_tables(out)

    return run


def _power(x: float) -> int:
    return 1 << max(0, int(np.ceil(np.log2(max(1.0, x)))))


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 20, digest: bool = False, batch_words: int = 1_500_000, home_bytes: int = 4 << 20, bucket_windows: int | None = None) -> DataFrame:
    """Remove every word covered by a window of ``window`` words whose word sequence also starts earlier.

    Words are separated by ASCII white space. Earlier means a smaller id, or the same id and an earlier
    start; all windows are judged on the input. Null ids count as one id after all others. Rows that
    share an id are judged each by its own words, and windows at equal id and start are not earlier than
    one another. Null texts have no words. An empty table gives no rows.

    Returns ``id, n_words, n_removed, kept`` per row; with ``digest``, ``kept`` is the SHA-256 of the kept
    words joined by one space; else it is the text (what was between kept words stays, a removed interval
    becomes one space) and ``row`` holds the columns of ``docs``.

    Windows are compared by 64 bits of one hash inside buckets chosen by another, so two different
    windows pass for equal with a chance of 2^-64 over the number of buckets.
    """
    total, repeated = docs.select(F.sum(F.octet_length(text_col))).first()[0] or 0, False
    per = docs.groupBy(F.col(id_col).alias("k")).agg(F.count("*").alias("n")).where("n > 1").limit(1)
    repeated = not per.isEmpty()
    words = total / 6
    buckets = _power(words / (bucket_windows or min(max(words / 4096, 1 << 19), 1 << 23)))
    homes = min(_power(total / home_bytes), 1 << 23)
    text = F.col(text_col).cast("string").cast("binary").alias("text")
    ids = F.col(id_col).cast("long").alias("id")
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    found = docs.select(ids, text).mapInArrow(thrifty(_find(window, buckets, homes, repeated, batch_words)), "kind int, key long, hashes binary, places binary")
    marks = found.repartition(max(parts, buckets), "key").groupBy("key").applyInArrow(_thrifty_group(_judge(homes, repeated)), "home long, places binary")
    whole = docs.select(ids, text, *([] if digest else [F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != text_col]).alias("row")]))
    packed = whole.mapInArrow(thrifty(_gather(homes)), "home long, docs binary")
    schema = StructType([StructField("id", LongType()), *([] if digest else [whole.schema["row"]]), StructField("n_words", LongType()), StructField("n_removed", LongType()), StructField("kept", StringType() if digest else BinaryType())])
    out = packed.groupBy("home").cogroup(marks.groupBy("home")).applyInArrow(_guard(_remove(window, repeated, digest)), schema)
    return out if digest else out.withColumn("kept", F.col("kept").cast("string"))


def _thrifty_group(f):
    """``f`` over a group's table, after which the worker gives back what it freed."""

    def run(t: pa.Table) -> pa.Table:
        out = f(t)
        give_back()
        return out

    return run


def _guard(f):
    """No rows for a home that has marks of no documents (there is none, but Spark may offer an empty side)."""

    def run(docs: pa.Table, marks: pa.Table) -> pa.Table:
        if docs.num_rows:
            out = f(docs, marks)
            give_back()
            return out
        return pa.table({})

    return run


def op3_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(table(spark, sf_dir, "documents"), digest=True).select(F.col("id").alias("doc_id"), "n_words", "n_removed", F.col("kept").alias("kept_sha256"))
