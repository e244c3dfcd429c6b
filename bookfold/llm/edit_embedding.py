"""Document fingerprints: randomised edit embedding (Chakraborty, Goldenberg and Koucky, 2016), sampled.

All texts walk with the same random bits: in step j the walk writes its current character and moves on if
bit r_j(character) is set. Texts at a small edit distance so write strings at a small Hamming distance: after
an edit their walks soon meet again. A fingerprint samples what is written: every early step, then a fixed
number of steps per octave, a hex digit each. The steps that a character takes are tabled, so a walk costs a
look-up per character, and all texts of a batch walk at once."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, by_bytes, give_back, join_hot, materialize, table, text_bytes, thrifty

SEED, CLASSES, PERIOD = 42, 256, 4096
#: Sampled steps: all below 2 ** FULL, then PER_OCTAVE between 2 ** k and 2 ** (k + 1).
FULL, PER_OCTAVE, OCTAVES = 5, 32, 40
#: How often two digits of unrelated texts agree, about.
CHANCE = 0.1
_LOW = np.iinfo(np.int64).min
_HEX = np.frombuffer(b"0123456789abcdef", np.uint8)


def _mix(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.uint64) + np.uint64(SEED * 0x9E3779B97F4A7C15 % (1 << 64))
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return x ^ (x >> np.uint64(31))


def step_table() -> np.ndarray:
    """For class c and step j (modulo PERIOD), at c * PERIOD + j: the steps until the walk moves on."""
    bits = (_mix(np.arange(CLASSES * PERIOD)) >> np.uint64(63)).astype(bool).reshape(CLASSES, PERIOD)
    bits[:, -1] |= ~bits.any(axis=1)
    steps = np.zeros((CLASSES, PERIOD), np.int64)
    ahead = np.full(CLASSES, 0)
    for j in range(2 * PERIOD - 1, -1, -1):
        ahead = np.where(bits[:, j % PERIOD], 1, ahead + 1)
        if j < PERIOD:
            steps[:, j] = ahead
    return steps.ravel()


def sampled_steps() -> np.ndarray:
    """One step at random in each of PER_OCTAVE equal parts of an octave."""
    picked = [np.arange(1 << FULL)]
    for k in range(FULL, OCTAVES):
        part = (1 << k) // PER_OCTAVE
        draw = (_mix(np.arange(PER_OCTAVE) + (k << 20)) % np.uint64(part)).astype(np.int64)
        picked.append((1 << k) + np.arange(PER_OCTAVE) * part + draw)
    return np.concatenate(picked)


_TABLE, _SAMPLES = step_table(), sampled_steps()
#: How many steps each sample stands for.
_WEIGHTS = np.concatenate([np.ones(1 << FULL), np.repeat(2.0 ** np.arange(FULL, OCTAVES) / PER_OCTAVE, PER_OCTAVE)])


def fingerprints(texts: list[str]) -> list[str]:
    """A hex string per text; an empty text has an empty one."""
    order = sorted(range(len(texts)), key=lambda i: -len(texts[i]))
    flat = np.frombuffer("".join([texts[i] for i in order]).encode("utf-32-le", "surrogatepass"), np.uint32)
    kinds = _mix(flat)
    symbols = (kinds % np.uint64(15) + np.uint64(1)).astype(np.uint8)
    kinds = (kinds >> np.uint64(56)).astype(np.int64) * PERIOD
    sizes = np.array([len(texts[i]) for i in order], np.int64)
    starts = np.cumsum(sizes) - sizes
    at = np.empty(len(flat), np.int64)
    step = np.zeros(len(order), np.int64)
    active = np.searchsorted(-sizes, -np.arange(1, (sizes[0] if len(sizes) else 0) + 1), side="right").tolist()
    for t, n in enumerate(active):
        here, j = starts[:n] + t, step[:n]
        at[here] = j
        j += _TABLE[kinds[here] + (j & (PERIOD - 1))]
    out = [""] * len(texts)
    for k, i in enumerate(order):
        if sizes[k]:
            own = slice(starts[k], starts[k] + sizes[k])
            samples = _SAMPLES[: np.searchsorted(_SAMPLES, step[k])]
            out[i] = _HEX[symbols[own][np.searchsorted(at[own], samples, side="right") - 1]].tobytes().decode()
    return out


def likeness(a: str, b: str) -> float:
    """An estimate, 0 to 1, of the share of steps in which two walks write the same."""
    if a == b:
        return 1.0
    longer, n = max(len(a), len(b)), min(len(a), len(b))
    if not n:
        return 0.0
    same = np.frombuffer(a[:n].encode(), np.uint8) == np.frombuffer(b[:n].encode(), np.uint8)
    agree = float(_WEIGHTS[:n][same].sum() / _WEIGHTS[:longer].sum())
    return min(1.0, max(0.0, (agree - CHANCE) / (1 - CHANCE)))


def edited(text: str, following: str) -> str:
    """``text`` with its last floor(n / 2) code points replaced by the first as many of ``following``."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def _packed(digits: str) -> bytes:
    return bytes.fromhex(digits + "0" * (len(digits) % 2))


_PACKED = "doc_id long, n_chars long, edited binary, digits binary, n_digits int, edited_digits binary, n_edited int, near_edited double, near_next double, node long"
#: Ranges of documents at most; bytes of text that walk at once.
MOST_RANGES, AT_ONCE = 200_000, 3 << 20


class Ranges:
    """Ranges of documents in the order of descending ids (nulls last), equal ids by the hash of their text.

    ``bounds`` are ids in ascending order. One that occurs k times is an id with rows for k + 1 ranges: these are dealt
    by their hash, whose values are spread evenly."""

    def __init__(self, bounds: np.ndarray):
        self.bounds = bounds
        # the first document of each range, as id and hash, and the range that ends before it
        self.heads = np.empty(0, [("id", np.int64), ("h", np.int64)])
        self.before = np.empty(0, np.int64)

    def place(self, ids: np.ndarray, h: np.ndarray) -> np.ndarray:
        low, high = np.searchsorted(self.bounds, ids, "left"), np.searchsorted(self.bounds, ids, "right")
        width = high - low
        part = ((h.astype(np.float64) + 2.0**63) / 2.0**64 * (width + 1)).astype(np.int64)
        return len(self.bounds) - high + np.minimum(part, width)

    def starts(self, first: list[tuple[int, int, int]]) -> None:
        """``first``: range, id and hash of the first document of each range that has any."""
        first.sort()
        order = sorted(range(len(first)), key=lambda k: first[k][1:])
        self.heads = np.array([first[k][1:] for k in order], self.heads.dtype)
        self.before = np.array([first[k - 1][0] for k in order], np.int64)

    def follows(self, ids: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which documents are the first of a range, and the range before each."""
        own = np.empty(len(ids), self.heads.dtype)
        own["id"], own["h"] = ids, h
        at = np.minimum(np.searchsorted(self.heads, own), len(self.heads) - 1)
        found = np.flatnonzero(self.heads[at] == own)
        return found, self.before[at[found]]


def fingerprint_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_bytes: int = 8 << 20) -> DataFrame:
    """Fingerprints of each text and of its edited text, in a row per row of ``docs``.

    Columns: ``doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, near_component``.
    ``near_component`` is the smallest id among the documents linked, directly or by others, by fingerprints of
    likeness 0.8 or more (see ``edit_bands``), or by equal texts; null if all of these have null ids. Fingerprints are
    told apart by 64-bit hashes.
    The next document is the one with the next smaller id (nulls last; equal ids by a hash of the text, then by text),
    after the last the first. Null texts are empty. Documents are dealt in packed form to ranges of about equal numbers
    of rows, found from quantiles; the first document of each range (known beforehand) also goes to the range before,
    whose last document it follows. Ids that many rows share, null among them, are dealt to several ranges by the hash.
    A range is worked through ``AT_ONCE`` bytes at a time, so long texts take no more than themselves. Repeated rows
    stay; other columns aren't read; an empty table gives none.
    """
    text = text_bytes(f"`{text_col}`")
    ident = F.col(f"`{id_col}`").cast("long")
    own = docs.select(F.coalesce(ident, F.lit(_LOW)).alias("id"), F.coalesce(text, F.lit(b"")).alias("text"), ident.alias("doc_id"), F.xxhash64(F.coalesce(text, F.lit(b""))).alias("h"))
    n, total = docs.select(F.count("*"), F.coalesce(F.sum(F.octet_length(text)), F.lit(0))).first()
    parts = min(max(1, -(-total // part_bytes), min(24, n // 500)), MOST_RANGES)
    ranges = Ranges(np.array(own.agg(F.percentile_approx("id", [k / parts for k in range(1, parts)], max(10_000, 10 * parts))).first()[0] if parts > 1 and n else [], np.int64))

    def highest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first: dict[int, tuple[int, int]] = {}
        for b in batches:
            ids, h = b.column(0).to_numpy(), b.column(1).to_numpy()
            home = ranges.place(ids, h)
            order = np.lexsort((h, ~ids, home))
            fresh = np.flatnonzero(np.concatenate([[True], np.diff(home[order]) != 0])) if len(order) else []
            for k in order[fresh].tolist():
                p, own = int(home[k]), (-int(ids[k]), int(h[k]))
                first[p] = min(own, first.get(p, own))
        yield pa.RecordBatch.from_arrays([pa.array(first.keys(), pa.int64()), pa.array([-i for i, _ in first.values()], pa.int64()), pa.array([h for _, h in first.values()], pa.int64())], names=["part", "id", "h"])

    firsts = own.select("id", "h").mapInArrow(highest, "part long, id long, h long").groupBy("part").agg(F.min(F.struct(F.bitwise_not("id").alias("back"), "h", "id")).alias("r"))
    ranges.starts([tuple(r) for r in firsts.select("part", "r.id", "r.h").collect()])

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        options = pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", 3))
        for b in by_bytes(batches, 1, part_bytes):
            if not b.num_rows:
                continue
            ids, h = b.column(0).to_numpy(), b.column(3).to_numpy()
            home = ranges.place(ids, h)
            order = np.argsort(home, kind="stable")
            cuts = np.flatnonzero(np.diff(home[order])) + 1
            rows = [(int(home[at[0]]), 0, at) for at in np.split(order, cuts)]
            rows += [(p, 1, np.array([k])) for k, p in zip(*[x.tolist() for x in ranges.follows(ids, h)])]
            blobs = []
            for _, _, at in rows:
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, b.schema, options=options) as out:
                    out.write_batch(b.take(pa.array(at)))
                blobs.append(sink.getvalue().to_pybytes())
            yield pa.RecordBatch.from_arrays([pa.array([p for p, _, _ in rows], pa.int64()), pa.array([k for _, k, _ in rows], pa.int32()), pa.array(blobs, pa.binary())], names=["part", "kind", "rows"])

    def walk(t: pa.Table) -> pa.Table:
        found: list[list[tuple]] = [[], []]
        for kind, blob in zip(t.column("kind").to_pylist(), t.column("rows").to_pylist()):
            x = pa.ipc.open_stream(blob).read_all()
            found[kind] += zip(*[x.column(c).to_pylist() for c in ("id", "h", "text", "doc_id")])
        order = lambda r: (-r[0], r[1], r[2])
        rows = sorted(found[0], key=order)
        after = min(found[1], key=order)
        out, at = [], 0
        while at < len(rows):
            end, held = at, 0
            while end < len(rows) and (end == at or held + len(rows[end][2]) <= AT_ONCE):
                held += len(rows[end][2])
                end += 1
            out.append(walked(rows[at:end], (rows[end] if end < len(rows) else after)[2].decode()))
            at = end
        del rows, found
        give_back()
        return pa.concat_tables(out)

    from .edit_bands import near_components

    scratch = Scratch(docs.sparkSession)
    rows = scratch.keep(own.mapInArrow(thrifty(deal), "part long, kind int, rows binary").groupBy("part").applyInArrow(walk, _PACKED))
    distinct = scratch.keep(rows.groupBy("node").agg(F.min("doc_id").alias("low"), F.min(F.struct("n_digits", "digits")).alias("f")).select("node", "low", "f.digits", "f.n_digits"))
    parts_of = scratch.keep(distinct.select("node", "low").join(near_components(distinct, scratch), "node", "left").withColumn("component", F.coalesce("component", "node")))
    lows = parts_of.groupBy("component").agg(F.min("low").alias("near_component"))
    named = scratch.keep(join_hot(parts_of, lows, "component").select("node", "near_component"))

    def hexed(packed: str, n: str):
        return F.substring(F.lower(F.hex(packed)), F.lit(1), F.col(n))

    out = materialize(join_hot(rows, named, "node"))
    scratch.close()
    return out.select(
        "doc_id",
        "n_chars",
        F.lower(F.hex("edited")).alias("edited_sha256"),
        hexed("digits", "n_digits").alias("fingerprint"),
        hexed("edited_digits", "n_edited").alias("edited_fingerprint"),
        "near_edited",
        "near_next",
        "near_component",
    )

def walked(rows: list[tuple], after: str) -> pa.Table:
    """The results of neighbours ``id, h, text, doc_id`` in order; ``after`` is the text that follows the last."""
    texts = [r[2].decode() for r in rows]
    changed = [edited(a, b) for a, b in zip(texts, [*texts[1:], after])]
    prints = fingerprints([*texts, after])
    other = fingerprints(changed)
    columns = [
        [r[3] for r in rows],
        list(map(len, texts)),
        [hashlib.sha256(c.encode()).digest() for c in changed],
        list(map(_packed, prints[:-1])),
        list(map(len, prints[:-1])),
        list(map(_packed, other)),
        list(map(len, other)),
        [likeness(a, b) for a, b in zip(prints, other)],
        [likeness(a, b) for a, b in zip(prints, prints[1:])],
        np.array([xxhash.xxh64_intdigest(f) for f in prints[:-1]], np.uint64).view(np.int64),
    ]
    kinds = [pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.int32(), pa.binary(), pa.int32(), pa.float64(), pa.float64(), pa.int64()]
    return pa.table([pa.array(c, k) for c, k in zip(columns, kinds)], names=[c.split()[0] for c in _PACKED.split(", ")])


def op7_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_documents(table(spark, sf_dir, "documents"))
