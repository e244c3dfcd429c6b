"""Byte-level BPE: pre-tokenise overlapping chunks in parallel, stitch them where their pre-token
boundaries resynchronise, encode the pieces; decoding concatenates raw bytes."""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import by_bytes, table, text_bytes

#: A boundary this many characters before the end of a chunk doesn't depend on what follows the chunk:
#: the pattern looks at most three characters past a piece.
MARGIN = 8
#: Pieces whose ids a worker remembers.
REMEMBER = 200_000


def compiled(pattern: str) -> regex.Pattern:
    r"""The pre-token pattern, with ``\s`` as Unicode's White_Space, which leaves out U+001C to U+001F."""
    return regex.compile(pattern.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}"))


class Codec:
    """Encodes pieces and decodes ids by a file of ranks."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.pattern = compiled(pattern)
        self._core = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self._bytes = {i: b for b, i in ranks.items()}
        self._known: dict[str, bytes] = {}

    def piece(self, text: str) -> bytes:
        """Ids of one pre-token as little-endian 32-bit integers."""
        ids = np.array(self._core._encode_single_piece(text), "<u4").tobytes()
        if len(text) < 64:
            if len(self._known) >= REMEMBER:
                self._known.clear()
            self._known[text] = ids
        return ids

    def encode(self, pieces: list[str]) -> bytes:
        known = self._known.get
        return b"".join([known(p) or self.piece(p) for p in pieces])

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self._bytes.__getitem__, np.frombuffer(ids, "<u4").tolist()))

    def digest(self, pieces: list[str]) -> tuple[int, str, str]:
        ids = self.encode(pieces)
        return len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(self.decode(ids)).hexdigest()


@lru_cache(maxsize=4)
def codec(path: str, pattern: str) -> Codec:
    return Codec(path, pattern)


def starts(pattern: regex.Pattern, text: str) -> np.ndarray:
    """Where the pre-tokens of a chunk start."""
    return np.fromiter((m.start() for m in pattern.finditer(text)), np.int64)


def stitch(pattern: regex.Pattern, text: str, chunk: int, overlap: int, bounds: list[np.ndarray]) -> list[int]:
    """Pre-token starts of a whole text from those of its chunks (``bounds``, from each chunk's start).

    Chunk k covers ``chunk + overlap`` characters from ``k * chunk``. The pattern doesn't look behind,
    so two scans that share a boundary agree from there on. Where the boundaries of neighbours don't
    meet in the overlap, the text is scanned on from the last sure boundary until they do.
    """
    n = len(text)
    out: list[int] = []
    sure = 0  # all pre-token starts up to here are known; it is one itself
    for k, own in enumerate(bounds):
        own = own + k * chunk
        end = min(n, k * chunk + chunk + overlap)
        trusted = own if end == n else own[own <= end - MARGIN]
        at = np.searchsorted(trusted, sure)
        while not (at < len(trusted) and trusted[at] == sure):
            if sure >= n or not len(trusted) or sure > trusted[-1]:
                break
            out.append(sure)
            sure = pattern.match(text, sure).end()
            at = np.searchsorted(trusted, sure)
        else:
            # the next chunk takes over at the first boundary that it shares, from its start on
            nxt = bounds[k + 1] + (k + 1) * chunk if k + 1 < len(bounds) else None
            mine = trusted[at:]
            if nxt is None:
                out += mine.tolist()
                sure = n
                continue
            common = np.intersect1d(mine, nxt, assume_unique=True)
            sure = int(common[0]) if len(common) else int(mine[-1])
            out += mine[mine < sure].tolist()
    while sure < n:
        out.append(sure)
        sure = pattern.match(text, sure).end()
    return out


def encode_documents(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", chunk: int = 1 << 15, overlap: int = 1 << 10) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, n_tokens, ids_sha256, decoded_sha256``.

    Ids are those of ordinary text (no special tokens); the digests are of the ids as little-endian
    unsigned 32-bit integers and of the bytes that they decode to. A null text counts as empty. Null and
    repeated ids and repeated rows stay as they are; other columns are not read. Texts of over ``chunk``
    characters are cut into overlapping chunks that are pre-tokenised as rows of their own.
    """
    own = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    long = F.coalesce(F.octet_length("text"), F.lit(0)) > chunk
    kind = dict(own.dtypes)["doc_id"]
    out = "n_tokens long, ids_sha256 string, decoded_sha256 string"

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, pattern)
        for b in by_bytes(batches, 1, 8 << 20):
            found = [c.digest(c.pattern.findall(t.decode()) if t else []) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), *map(pa.array, zip(*found))], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in by_bytes(batches, 1, 8 << 20):
            for key, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                text = t.decode()
                parts = [text[i : i + chunk + overlap] for i in range(0, len(text), chunk)]
                yield pa.RecordBatch.from_arrays([pa.array([key] * len(parts)), pa.array(range(len(parts)), pa.int64()), pa.array(parts)], names=["key", "k", "part"])

    def pretokenise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = compiled(pattern)
        for b in batches:
            bounds = [starts(p, t).astype("<u4").tobytes() for t in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(bounds, pa.binary())], names=["key", "k", "part", "bounds"])

    def join(t: pa.Table) -> pa.Table:
        c = codec(path, pattern)
        t = t.sort_by("k")
        parts = t.column("part").to_pylist()
        text = "".join(p[:chunk] for p in parts)
        at = stitch(c.pattern, text, chunk, overlap, [np.frombuffer(x, "<u4").astype(np.int64) for x in t.column("bounds").to_pylist()])
        found = c.digest([text[a:b] for a, b in zip(at, [*at[1:], len(text)])])
        return pa.table([t.column("key")[:1], *[pa.array([x]) for x in found]], names=["key", "n_tokens", "ids_sha256", "decoded_sha256"])

    short = own.where(~long).select("doc_id", text_bytes("text").alias("text")).mapInArrow(whole, f"doc_id {kind}, {out}")
    keyed = own.where(long).select("doc_id", F.sha2("text", 256).alias("key"), text_bytes("text").alias("text"))
    chunks = keyed.select("key", "text").mapInArrow(cut, "key string, k long, part string").dropDuplicates(["key", "k"])
    done = chunks.mapInArrow(pretokenise, "key string, k long, part string, bounds binary").groupBy("key").applyInArrow(join, f"key string, {out}")
    return short.unionByName(keyed.select("doc_id", "key").join(done, "key").drop("key"))


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return encode_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
