"""ISO media boxes as rows: headers are read by seek, payloads are skipped."""
from __future__ import annotations

import hashlib
import io
import itertools
import struct
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, Filter, InputPartition

from .files import Pushed, in_groups, list_files, list_units, open_file

SCHEMA = ("path string, box_no bigint, parent string, type string, start bigint, size bigint, handler string, "
          "entry string, guid string, sha256 string, timescale bigint, duration bigint, brand string, references string")
NAMES = [c.split()[0] for c in SCHEMA.split(", ")]
SUFFIXES = (".mp4", ".mov", ".m4v", ".m4a")
# Boxes that hold boxes.
CONTAINERS = {"moov", "trak", "mdia", "minf", "stbl", "edts", "udta", "tref", "dinf"}
CHUNK = 1 << 20


BROKEN = "broken"
BATCH = 4096  # rows handed over at once
TYPES = [pa.int64() if c.endswith("bigint") else pa.string() for c in SCHEMA.split(", ")]


def _children(f, start: int, end: int) -> Iterator[tuple[str, int, int, int]]:
    """(type, start, payload start, end) of the boxes in a range.

    A size that cannot be right ends the range with one ``broken`` entry from there on.
    """
    while start < end:
        head = _at(f, start, 16)
        if end - start < 8 or len(head) < 8:
            if any(head[:end - start]):  # zero padding is not a box, nor a fault
                yield BROKEN, start, start, end
            return
        size, kind = struct.unpack(">I4s", head[:8])
        data = start + 8
        if size == 1:
            if len(head) < 16:
                yield BROKEN, start, start, end
                return
            size, data = struct.unpack(">Q", head[8:])[0], start + 16
        size = size or end - start
        if size < data - start or start + size > end:
            yield BROKEN, start, start, end
            return
        yield kind.decode("latin-1"), start, data, start + size
        start += size


def _at(f, where: int, count: int) -> bytes:
    f.seek(where)
    return f.read(count)


def _digest(f, start: int, end: int) -> str:
    h = hashlib.sha256()
    f.seek(start)
    while start < end:
        part = f.read(min(CHUNK, end - start))
        h.update(part)
        start += len(part) or end
    return h.hexdigest()


def _facts(f, kind: str, data: int, end: int, parent: str) -> dict:
    if kind == "ftyp":
        return {"brand": _at(f, data, 4).decode("latin-1")}
    if kind == "mvhd":
        body = _at(f, data, min(32, end - data))
        if body[:1] == b"\1" and len(body) == 32:
            return dict(zip(("timescale", "duration"), struct.unpack(">IQ", body[20:])))
        if body[:1] == b"\0" and len(body) >= 20:
            return dict(zip(("timescale", "duration"), struct.unpack(">II", body[12:20])))
        return {}
    if kind == "hdlr" and end - data >= 12:
        return {"handler": _at(f, data + 8, 4).decode("latin-1")}
    if kind == "stsd" and end - data >= 16:
        return {"entry": ",".join(_entries(f, data, end))}
    if kind == "uuid" and end - data >= 16:
        return {"guid": _at(f, data, 16).hex(), "sha256": _digest(f, data + 16, end)}
    if parent.endswith("/tref") and kind != BROKEN:
        n = (end - data) // 4
        return {"references": ",".join(map(str, struct.unpack(f">{n}I", _at(f, data, 4 * n))))}
    return {}


def _entries(f, data: int, end: int) -> Iterator[str]:
    """Codes of all sample descriptions of a track, in order; a size that cannot be right ends them."""
    count, at = struct.unpack(">I", _at(f, data + 4, 4))[0], data + 8
    while count and at + 8 <= end:
        size, kind = struct.unpack(">I4s", _at(f, at, 8))
        yield kind.decode("latin-1")
        if size < 8:
            return
        count, at = count - 1, at + size


def walk(path: str, f, size: int) -> Iterator[tuple]:
    """Every box of a file in order, with the few facts its kind carries.

    Where a size is wrong a row of type ``broken`` says from which byte to which
    the range could not be read.
    """
    number, stack = 0, [("", iter(_children(f, 0, size)))]
    while stack:
        parent, boxes = stack[-1]
        box = next(boxes, None)
        if box is None:
            stack.pop()
            continue
        kind, start, data, end = box
        row = dict.fromkeys(NAMES) | {"path": path, "box_no": number, "parent": parent, "type": kind, "start": start, "size": end - start}
        yield tuple((row | _facts(f, kind, data, end, parent)).values())
        number += 1
        if kind in CONTAINERS:
            # a track is told apart by its number, so children keep their own
            name = f"{kind}[{number - 1}]" if kind == "trak" else kind
            stack.append((f"{parent}/{name}", iter(_children(f, data, end))))


def _walk_file(path: str, size: int) -> Iterator[tuple]:
    with open_file(path) as f:
        yield from walk(path, f, size)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), TYPES)], NAMES)


@dataclass
class Group(InputPartition):
    files: list
    folders: list


class BoxReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path = options["path"]
        self.per_task = int(options.get("filesPerTask", 64))
        self.pushed = Pushed("path")

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        return self.pushed.take(filters)

    def partitions(self) -> list[Group]:
        files, folders = list_units(self.path, SUFFIXES)
        files = [f for f in files if self.pushed.allows("path", f[0])]
        return [*(Group(g, []) for g in in_groups(files, self.per_task)), *(Group([], g) for g in in_groups(folders, 1))]

    def read(self, group: Group | None) -> Iterator[pa.RecordBatch]:
        if group is None:  # Spark makes one task where no file is left
            return
        below = (f for folder in group.folders for f in list_files(folder, SUFFIXES) if self.pushed.allows("path", f[0]))
        rows = (row for path, size in itertools.chain(group.files, below) for row in _walk_file(path, size))
        while some := list(itertools.islice(rows, BATCH)):
            yield _batch(some)


class MediaBoxes(DataSource):
    """``spark.read.format("isobmff_boxes")`` after ``files.register(spark, MediaBoxes)``; a filter on path opens those files only."""

    @classmethod
    def name(cls) -> str:
        return "isobmff_boxes"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> BoxReader:
        return BoxReader(self.options)


def boxes_from_content(files: DataFrame) -> DataFrame:
    """The same rows from a (path, content) table of small files."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            files = zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())
            rows = (row for path, content in files for row in walk(path, io.BytesIO(content), len(content)))
            while some := list(itertools.islice(rows, BATCH)):
                yield _batch(some)

    return files.select("path", "content").mapInArrow(run, SCHEMA)


def container_facts(boxes: DataFrame) -> DataFrame:
    """Per file: brand, box order, movie length, tracks, uuid items and data references."""
    top = F.col("parent") == ""
    at = lambda kind: F.min(F.when(top & (F.col("type") == kind), F.col("start")))
    has = lambda c: F.count_if(c)
    return boxes.groupBy("path").agg(
        F.max("brand").alias("brand"), (at("moov") < at("mdat")).alias("moov_first"),
        (F.max("duration") / F.max("timescale")).alias("mvhd_sec"), has(F.col("type") == "trak").alias("trak_count"),
        has(F.col("type") == "uuid").alias("uuid_count"), (has(F.col("parent").endswith("/tref") & (F.col("type") == "cdsc")) > 0).alias("has_cdsc"),
        F.array_max(F.flatten(F.collect_set(F.filter(F.split("entry", ","), lambda e: e.isin("rtmd", "djmd"))))).alias("data_entry"),
        has((F.col("type") == "meta") & F.col("parent").isin("", "/moov")).alias("meta_scopes"))


def uuid_items(boxes: DataFrame) -> DataFrame:
    """Inventory rows (path, ctx, guid, sha): root, moov, or the handler of the track."""
    track = F.regexp_extract("parent", r"(/moov/trak\[\d+\])", 1)
    # a QuickTime track has a second handler, of its data, below minf
    own = F.col("parent").endswith("/mdia") & (F.col("type") == "hdlr")
    handlers = boxes.where(own).groupBy("path", track.alias("_t")).agg(F.max("handler").alias("_h"))
    items = boxes.where("type = 'uuid'").withColumn("_t", track).join(handlers, ["path", "_t"], "left")
    ctx = F.when(F.col("parent") == "", "root").when(F.col("_t") == "", "moov").otherwise(F.concat(F.lit("trak:"), F.coalesce("_h", F.lit(""))))
    return items.select("path", ctx.alias("ctx"), "guid", F.col("sha256").alias("sha"))
