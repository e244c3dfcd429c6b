"""``spark.read.format("fob")`` and ``spark.readStream.format("fob")`` for full-order-book text.

A file is a partition (gz can't be cut), read as a stream in Arrow batches. Options: ``path`` (a file or folder), ``price_scale`` and ``qty_scale`` (8),
``column_order`` (``asks,bids`` or ``bids,asks``). Comparisons of ``time`` with a number are pushed down where
``spark.sql.python.filterPushdown.enabled`` is set: lines outside are left before their lists are read. Rows are those of
``read_fob`` with these scales. Paths are opened by Arrow, so they may be local or of a store that Arrow knows (s3, gs, hdfs)."""

from __future__ import annotations

import io
import re
from collections.abc import Iterator
from decimal import ROUND_HALF_UP, Decimal

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual
from pyspark.sql.types import StructType

from .fob import DIGITS, LEVEL

_LEVEL = re.compile(LEVEL, re.ASCII)
_TIME = re.compile(r"[0-9]{1,19}")
_ROWS = 8192
_TESTS = {EqualTo: int.__eq__, GreaterThan: int.__gt__, GreaterThanOrEqual: int.__ge__, LessThan: int.__lt__, LessThanOrEqual: int.__le__}


class _File(InputPartition):
    def __init__(self, number: int, path: str):
        self.number, self.path = number, path


def _files(path: str) -> tuple[fs.FileSystem, list[fs.FileInfo]]:
    """The files at a path or below it, but hidden ones, by time of change and name."""
    store, at = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
    info = store.get_file_info(at)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    found = [info] if info.type == fs.FileType.File else [x for x in store.get_file_info(fs.FileSelector(at, recursive=True)) if x.type == fs.FileType.File]
    own = [x for x in found if not any(p.startswith(("_", ".")) for p in x.path[len(at) :].strip("/").split("/"))] if len(found) != 1 or found[0] is not info else found
    return store, sorted(own, key=lambda x: (x.mtime_ns or 0, x.path))


class _Parser:
    """Lines as rows; ``tests`` are what a time must meet."""

    def __init__(self, options: dict):
        self.path = options["path"]
        self.scales = int(options.get("price_scale", 8)), int(options.get("qty_scale", 8))
        order = options.get("column_order", "asks,bids")
        if order not in ("asks,bids", "bids,asks"):
            raise ValueError("column_order is asks,bids or bids,asks")
        self.asks = 2 if order == "asks,bids" else 3
        self.tests: list[tuple[type, int]] = []

    @property
    def ddl(self) -> str:
        p, q = self.scales
        return f"line_no bigint, time bigint, us01 tinyint, bs01 tinyint, pos int, price decimal({DIGITS},{p}), qty decimal({DIGITS},{q}), corrupt string"

    def _decimal(self, text: str, scale: int) -> Decimal | None:
        x = Decimal(text).quantize(Decimal(1).scaleb(-scale), ROUND_HALF_UP)
        return x if abs(x) < 10 ** (DIGITS - scale) else None

    def _levels(self, text: str) -> list[tuple] | None:
        bare = re.sub(r"\s", "", _LEVEL.sub("\u0001", text), flags=re.ASCII)
        if "\u0001" in text or bare != "[]" and bare.replace("\u0001,", "") != "[\u0001]":
            return None
        out = [tuple(map(self._decimal, x, self.scales)) for x in _LEVEL.findall(text)]
        return None if any(None in x for x in out) else out

    def rows(self, number: int, line: str) -> list[tuple]:
        parts = re.split("[;|]", line)
        ts = parts[0].strip(" ")
        good = bool(_TIME.fullmatch(ts)) and int(ts) < 1 << 63
        if self.tests and not (good and all(_TESTS[kind](int(ts), value) for kind, value in self.tests)):
            return []
        sides = [self._levels(parts[c]) if good and len(parts) > c else None for c in (self.asks, 5 - self.asks)]
        if None in sides:
            return [(number, *[None] * 6, line)]
        kind = parts[1].strip(" ").lower()[:1]
        us01 = 0 if kind == "u" else 1 if kind == "s" else 2
        return [(number, int(ts), us01, side, i, *x, None) for side, own in ((1, sides[0]), (0, sides[1])) for i, x in enumerate(own)]

    def read(self, partition: _File) -> Iterator[pa.RecordBatch]:
        p, q = self.scales
        kinds = [pa.int64(), pa.int64(), pa.int8(), pa.int8(), pa.int32(), pa.decimal128(DIGITS, p), pa.decimal128(DIGITS, q), pa.string()]
        names = [x.split()[0] for x in re.sub(r"\([^)]*\)", "", self.ddl).split(", ")]
        store, at = fs.FileSystem.from_uri(partition.path) if "://" in partition.path else (fs.LocalFileSystem(), partition.path)

        def batch(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

        held: list[tuple] = []
        with store.open_input_stream(at, compression="gzip" if at.endswith(".gz") else None) as raw:
            for n, line in enumerate(io.TextIOWrapper(raw, "utf-8", newline=None)):
                line = line.rstrip("\n")
                if n and line.strip(" "):
                    held += self.rows((partition.number << 33) + n - 1, line)
                if len(held) >= _ROWS:
                    yield batch(held)
                    held = []
        if held:
            yield batch(held)


class _Reader(DataSourceReader):
    def __init__(self, parser: _Parser):
        self._parser = parser

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if type(f) in _TESTS and f.attribute == ("time",) and isinstance(f.value, int):
                self._parser.tests.append((type(f), f.value))
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        return [_File(i, _address(self._parser.path, x.path)) for i, x in enumerate(_files(self._parser.path)[1])]

    def read(self, partition: _File) -> Iterator[pa.RecordBatch]:
        return self._parser.read(partition)


def _address(path: str, found: str) -> str:
    """A found file's path with the scheme of ``path``."""
    return f"{path.split('://')[0]}://{found}" if "://" in path else found


class _StreamReader(DataSourceStreamReader):
    """Files in order of their time of change; an offset is how many were read. Files must not be changed or removed meanwhile."""

    def __init__(self, parser: _Parser):
        self._parser = parser

    def initialOffset(self) -> dict:
        return {"files": 0}

    def latestOffset(self) -> dict:
        return {"files": len(_files(self._parser.path)[1])}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        own = _files(self._parser.path)[1]
        return [_File(i, _address(self._parser.path, own[i].path)) for i in range(start["files"], end["files"])]

    def read(self, partition: _File) -> Iterator[pa.RecordBatch]:
        return self._parser.read(partition)

    def commit(self, end: dict) -> None:
        pass


class FobSource(DataSource):
    def __init__(self, options: dict):
        super().__init__(options)
        self._parser = _Parser(dict(options))

    @classmethod
    def name(cls) -> str:
        return "fob"

    def schema(self) -> str:
        return self._parser.ddl

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(self._parser)

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return _StreamReader(self._parser)


def register(spark: SparkSession) -> None:
    """Make ``format("fob")`` known to a session, with filters pushed down."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", True)
    spark.dataSource.register(FobSource)
