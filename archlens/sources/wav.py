"""WAV files as PCM blocks: a partitioned data source and its in-memory twin."""
from __future__ import annotations

import io
import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, Filter, InputPartition

from .files import Pushed, in_groups, list_files, open_file

SCHEMA = ("path string, channel bigint, block_no bigint, start_sample bigint, sample_rate bigint, "
          "samples array<float>, error string")
NAMES = [c.split()[0] for c in SCHEMA.split(", ")]
SUFFIXES = (".wav", ".wave", ".bwf")
# Format codes of the fmt chunk.
PCM, FLOAT, EXTENSIBLE = 1, 3, 0xFFFE
READABLE = {(PCM, 8), (PCM, 16), (PCM, 24), (PCM, 32), (FLOAT, 32), (FLOAT, 64)}


@dataclass
class Header:
    code: int
    channels: int
    rate: int
    bits: int
    data_at: int
    data_len: int


class Unreadable(ValueError):
    """A file that does not give samples, with the reason."""


def _take(f, where: int, count: int) -> bytes:
    f.seek(where)
    got = f.read(count)
    if len(got) < count:
        raise Unreadable(f"ends inside a header at byte {where}")
    return got


def read_header(f, size: int) -> Header:
    """Format facts and the place of the sample data; :class:`Unreadable` where there are none."""
    head = _take(f, 0, 12) if size >= 12 else b""
    if head[:4] not in (b"RIFF", b"RF64") or head[8:] != b"WAVE":
        raise Unreadable("not a RIFF/WAVE file")
    at, fmt, wide = 12, None, None
    while at + 8 <= size:
        name, length = struct.unpack("<4sI", _take(f, at, 8))
        if name == b"ds64":
            wide = struct.unpack("<QQ", _take(f, at + 8, 16))[1]
        elif name == b"fmt ":
            raw = _take(f, at + 8, min(max(length, 16), 40))
            code, channels, rate, _, _, bits = struct.unpack("<HHIIHH", raw[:16])
            if code == EXTENSIBLE and len(raw) >= 26:
                code = struct.unpack("<H", raw[24:26])[0]
            fmt = (code, channels, rate, bits)
        elif name == b"data":
            if fmt is None:
                raise Unreadable("sample data before its format")
            if not fmt[1] or (fmt[0], fmt[3]) not in READABLE:
                raise Unreadable(f"unsupported format: code {fmt[0]}, {fmt[3]} bits, {fmt[1]} channels")
            length = wide if length == 0xFFFFFFFF and wide else length
            return Header(*fmt, at + 8, min(length, size - at - 8))
        at += 8 + length + (length & 1)
    raise Unreadable("no sample data")


def decode(raw: bytes, head: Header) -> np.ndarray:
    """Interleaved bytes as float32 (frames, channels) in [-1, 1)."""
    if head.code == FLOAT and head.bits in (32, 64):
        x = np.frombuffer(raw, f"<f{head.bits // 8}").astype(np.float32)
    elif head.code == PCM and head.bits == 24:
        b = np.frombuffer(raw, np.uint8).reshape(-1, 3).astype(np.int32)
        x = (((b[:, 2] << 24) | (b[:, 1] << 16) | (b[:, 0] << 8)) >> 8).astype(np.float32) / (1 << 23)
    elif head.code == PCM and head.bits in (16, 32):
        x = np.frombuffer(raw, f"<i{head.bits // 8}").astype(np.float64) / (1 << (head.bits - 1))
    else:
        x = (np.frombuffer(raw, np.uint8).astype(np.float32) - 128) / 128
    return x.astype(np.float32).reshape(-1, head.channels)


def _batch(columns: dict[str, list | np.ndarray], samples: pa.Array) -> pa.RecordBatch:
    kinds = [pa.string(), *[pa.int64()] * 4]
    arrays = [pa.array(columns[n], k) for n, k in zip(NAMES, kinds)]
    return pa.RecordBatch.from_arrays([*arrays, samples, pa.array(columns["error"], pa.string())], NAMES)


def read_blocks(path: str, f, size: int, block: int, low: int, high: int, strict: bool = False,
                pushed: Pushed | None = None) -> Iterator[pa.RecordBatch]:
    """Blocks whose first byte lies in [low, high): a file split by bytes loses none.

    Blocks that ``pushed`` does not allow are skipped by seek, channels left undelivered.

    One batch holds a block of every channel. A file that cannot be read is one
    row with ``error`` (from the part at byte 0), or raises if ``strict``.
    """
    try:
        head = read_header(f, size)
    except Unreadable as why:
        if strict:
            raise Unreadable(f"{path}: {why}") from None
        if low == 0:
            none = pa.nulls(1, pa.list_(pa.float32()))
            yield _batch({n: [None] for n in NAMES} | {"path": [path], "error": [str(why)]}, none)
        return
    frame = head.channels * head.bits // 8
    step = block * frame
    first = max(0, -(-(low - head.data_at) // step))
    at = head.data_at + first * step
    end = head.data_at + head.data_len // frame * frame
    wanted = [c for c in range(head.channels) if pushed is None or pushed.allows("channel", c)]
    while wanted and at < min(high, end):
        n, c = (at - head.data_at) // step, len(wanted)
        if pushed and not (pushed.allows("block_no", n) and pushed.allows("start_sample", n * block)):
            at += step
            continue
        x = decode(_take(f, at, min(step, end - at)), head)
        x = x if c == head.channels else x[:, wanted]
        bounds = pa.array(np.arange(c + 1) * len(x), pa.int32())
        samples = pa.ListArray.from_arrays(bounds, pa.array(np.ascontiguousarray(x.T).ravel()))
        yield _batch({"path": [path] * c, "channel": wanted, "block_no": [n] * c, "start_sample": [n * block] * c,
                      "sample_rate": [head.rate] * c, "error": [None] * c}, samples)
        at += step


@dataclass
class Split(InputPartition):
    path: str
    size: int
    low: int
    high: int


@dataclass
class Group(InputPartition):
    splits: list


class WavReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path = options["path"]
        self.block = int(options.get("blockSamples", 48000))
        self.split = int(options.get("splitBytes", 128 << 20))
        self.per_task = int(options.get("filesPerTask", 1))
        self.strict = options.get("mode", "PERMISSIVE").upper() == "FAILFAST"
        self.pushed = Pushed("path", "channel", "block_no", "start_sample")

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        return self.pushed.take(filters)

    def partitions(self) -> list[Group]:
        """A part of a long file alone; short files one by one, or together where they are very many."""
        long, short = [], []
        for p, n in list_files(self.path, SUFFIXES):
            if self.pushed.allows("path", p):
                parts = [Split(p, n, lo, min(lo + self.split, n)) for lo in range(0, max(n, 1), self.split)]
                (short if n <= self.split else long).extend(parts)
        return [*(Group([s]) for s in long), *(Group(g) for g in in_groups(short, self.per_task))]

    def read(self, group: Group | None) -> Iterator[pa.RecordBatch]:
        for split in group.splits if group else []:  # Spark makes one task where no file is left
            with open_file(split.path) as f:
                yield from read_blocks(split.path, f, split.size, self.block, split.low, split.high, self.strict, self.pushed)


class WavBlocks(DataSource):
    """``spark.read.format("wav_blocks")`` after ``files.register(spark, WavBlocks)``.

    Filters on path, channel, block_no and start_sample leave files, channels and
    blocks unread. The driver lists the folder; for very many files take
    :func:`blocks_of_files`, which reads what a Spark listing found.

    Files that give no samples are rows with a reason in ``error``; with option
    ``mode=FAILFAST`` the read fails on them instead.
    """

    @classmethod
    def name(cls) -> str:
        return "wav_blocks"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WavReader:
        return WavReader(self.options)


def blocks_of_files(files: DataFrame, block: int, *, split: int = 128 << 20, tasks: int | None = None) -> DataFrame:
    """The same rows for a table of (path, length), such as a listing gives.

    Listing, pruning and reading are Spark's: a row of work per ``split`` bytes
    of a file, dealt by hash over ``tasks`` tasks (four per core by default),
    so neither a long file nor a full folder stays in one task.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, size, low in zip(*[batch.column(i).to_pylist() for i in range(3)]):
                with open_file(path) as f:
                    yield from read_blocks(path, f, size, block, low, min(low + split, max(size, 1)))

    zero = F.lit(0).cast("bigint")
    low = F.explode(F.sequence(zero, F.greatest(F.col("length") - 1, zero), F.lit(split).cast("bigint")))
    parts = files.select("path", "length", low.alias("low"))
    return parts.repartition(tasks or 4 * files.sparkSession.sparkContext.defaultParallelism, "path", "low").mapInArrow(run, SCHEMA)


def blocks_from_content(files: DataFrame, block: int) -> DataFrame:
    """The same rows from a (path, content) table of small files."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                yield from read_blocks(path, io.BytesIO(content), len(content), block, 0, len(content))

    return files.select("path", "content").mapInArrow(run, SCHEMA)
