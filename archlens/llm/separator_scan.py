"""Token counts of documents in flat token files, by scanning for the end id.

The files are runs of big-endian 16-bit ids without any index. Spark reads them
in byte ranges, so a file of any size is many tasks' work; blocks of a range
are searched as arrays at both alignments. Running totals over the blocks give
each its place in the stream, and with it the alignment that holds and the
start of a document that began blocks or files before.
"""
from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession, functions as F

from archlens.llm import token_stream as S
from archlens.llm.batches import bounded
from archlens.llm.prefix import running
from archlens.llm.registry import query, table
from archlens.session import cut_lineage, scratch_path

BLOCK = 1 << 16           # ids searched at once
CHUNK = 1 << 20           # bytes gathered before they are handed on
FILE_CHUNKS = 16          # chunks to a file, so no file is large


def _flat(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of whole documents' ids, without the last byte of each run."""
    parts: list[bytes] = []
    size = 0

    def run() -> pa.RecordBatch:
        ids = np.frombuffer(b"".join(parts), dtype="<u2").astype(">u2").tobytes()
        return pa.RecordBatch.from_arrays([pa.array([ids[:-1]], pa.binary())], ["ids"])

    for batch in batches:
        for text in batch.column(0).to_pylist():
            ids = S.document_ids(text)
            parts.append(ids)
            size += len(ids)
            if size >= CHUNK:
                yield run()
                parts, size = [], 0
    if parts:
        yield run()


def write_token_files(docs: DataFrame, path: str, *, text: str = "text") -> None:
    """Flat files of the ids of every document, each document followed by the end id.

    Spark's text writer puts the bytes; its line separator is the end id's last
    byte, which every run ends with, so files hold ids and nothing else.
    """
    last = S.END.to_bytes(2, "big")[1:].decode("ascii")
    runs = bounded(docs).select(F.col(text).cast("string")).mapInArrow(_flat, "ids binary")
    runs.select(F.col("ids").cast("string")).write.option("lineSep", last).option(
        "maxRecordsPerFile", FILE_CHUNKS).text(path)


def find_ends(data: np.ndarray, end: int, block: int) -> np.ndarray:
    """Byte positions, even and odd, of the two bytes of ``end``, found block by block."""
    high, low = divmod(end, 256)
    found = [np.flatnonzero((data[a:a + block] == high) & (data[a + 1:a + block + 1] == low)
                            if a + block < len(data) else (data[a:-1] == high) & (data[a + 1:] == low)) + a
             for a in range(0, len(data) - 1, block)]
    return np.concatenate(found) if found else np.zeros(0, dtype=np.int64)


def _scan(batches: Iterator[pa.RecordBatch], end: int, block: int) -> Iterator[pa.RecordBatch]:
    """(path, block, chunk, n_bytes, at) per run of bytes; each line lacks its last byte, the end id's."""
    last = np.array([end % 256], dtype=np.uint8).tobytes()
    chunk = 0
    for batch in batches:
        path, start = batch.column("path"), batch.column("block").to_numpy(zero_copy_only=False)
        first = np.flatnonzero(np.concatenate([[True], (start[1:] != start[:-1]) | _differs(path)])) if len(start) else []
        for a, b in zip(first, [*first[1:], len(start)]):
            lines = batch.column("line").slice(a, b - a)
            data = np.frombuffer(last.join(lines.to_pylist()) + last, dtype=np.uint8)
            at = find_ends(data, end, 2 * block)
            yield pa.RecordBatch.from_arrays(
                [path.slice(a, 1), pa.array([start[a]], pa.int64()), pa.array([chunk], pa.int64()),
                 pa.array([len(data)], pa.int64()), pa.array([at], pa.list_(pa.int64()))],
                ["path", "block", "chunk", "n_bytes", "at"])
            chunk += 1


def _differs(values: pa.Array) -> np.ndarray:
    """Whether each value but the first is another one than before."""
    return pa.compute.not_equal(values[1:], values[:-1]).to_numpy(zero_copy_only=False).astype(bool)


def document_counts(spark: SparkSession, path: str, *, end: int = S.END, block: int = BLOCK) -> DataFrame:
    """(doc_no, start, n_tokens, ended): one row per document of the token files below ``path``.

    The files, in order of their names, are one stream; ``start`` is a document's
    place in it, ``n_tokens`` counts its ids without the end id. Ids after the
    last end id are a document that is not ``ended``; no files give no rows. Files
    are read by Spark's line reader, the last byte of ``end`` (below 128) for a
    line's end, in ranges of ``spark.sql.files.maxPartitionBytes``; bytes without it
    are one value. A file that holds half an id, or whose bytes do not add up, is an error.
    """
    if end % 256 > 127:
        raise ValueError("the end id's last byte must be below 128")
    lines = spark.read.option("lineSep", chr(end % 256)).text(path).select(
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"),
        F.col("_metadata.file_size").alias("size"), F.col("value").cast("binary").alias("line"))
    scanned = cut_lineage(bounded(lines.select("path", "block", "line")).mapInArrow(
        functools.partial(_scan, end=end, block=block), "path string, block long, chunk long, n_bytes long, at array<long>"))
    sizes = lines.groupBy("path").agg(F.first("size").alias("size"))
    # the last line of a file may lack the byte that every other one ends with
    files = (scanned.groupBy("path").agg(F.sum("n_bytes").alias("read"), F.max(F.struct("block", "chunk")).alias("last"))
             .join(sizes, "path")
             .withColumn("over", F.when((F.col("size") % 2 == 0) & (F.col("read") - F.col("size")).isin(0, 1),
                                        F.col("read") - F.col("size")).otherwise(F.raise_error(
                                            F.concat(F.col("path"), F.lit(" holds half an id, or was not read whole")))))
             .select(F.col("path").alias("file"), "last", "over"))
    whole = scanned.join(files, F.col("path") == F.col("file")).select(
        "path", "block", "chunk", "at",
        (F.col("n_bytes") - F.when(F.struct("block", "chunk") == F.col("last"), F.col("over")).otherwise(0)).alias("n_bytes"))
    order = [F.col("path").asc(), F.col("block").asc(), F.col("chunk").asc()]
    placed = running(whole, order, {"base": "n_bytes"}, totals={"all_bytes": "n_bytes"})
    ends = F.filter(F.transform("at", lambda x: x + F.col("base")), lambda x: x % 2 == 0)
    aligned = (placed.withColumn("ends", ends).drop("at", "n_bytes").withColumns(
        {"n_ends": F.size("ends").cast("long"), "last_end": F.try_element_at("ends", F.lit(-1)) + 2}))
    stitched = cut_lineage(running(aligned, order, {"first_no": "n_ends"}, {"from": "last_end"},
                                   {"all_ends": "n_ends"}))
    found = stitched.select("first_no", F.coalesce("from", F.lit(0)).alias("from"), "ends",
                            F.posexplode("ends").alias("k", "end"))
    start = F.when(F.col("k") == 0, F.col("from")).otherwise(F.element_at("ends", F.greatest(F.col("k"), F.lit(1))) + 2)
    done = found.select((F.col("first_no") + F.col("k")).alias("doc_no"), start.alias("start"), "end").select(
        "doc_no", F.expr("start div 2").alias("start"), F.expr("(end - start) div 2").alias("n_tokens"),
        F.lit(True).alias("ended"))
    last_end = F.coalesce(F.max("last_end"), F.lit(0))
    rest = (stitched.agg(F.max("all_ends").alias("doc_no"), F.expr("coalesce(max(last_end), 0) div 2").alias("start"),
                         ((F.max("all_bytes") - last_end) / 2).cast("long").alias("n_tokens"))
            .where("n_tokens > 0").withColumn("ended", F.lit(False)))
    return done.union(rest)


@query("op7_separator_counts")
def op7_separator_counts(spark, sf_dir: str) -> DataFrame:
    """Token counts of all documents, read back from flat token files written from them."""
    path = scratch_path(spark)
    write_token_files(table(spark, sf_dir, "documents"), path)
    return document_counts(spark, path)
