"""Contiguous byte-balanced shards from global prefix sums.

Sizes are summed per range partition, the partition totals give every row its
global byte position, and shards are cut at equal byte targets. Column
expressions and shuffles only.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from archlens.llm.prefix import running
from archlens.llm.registry import query, table


def text_bytes(text: Column) -> Column:
    """UTF-8 bytes of a text plus one; a null text has none."""
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long")


def shard_by_bytes(rows: DataFrame, *, order: list[Column], size: str, shards: int) -> DataFrame:
    """``rows`` plus shard (0 to shards - 1) and slot (gapless from 0 inside its shard).

    Rows stay contiguous in ``order``; a row goes where its middle byte falls
    among equal cuts of all bytes, so each cut is off by half a row at most. A
    row longer than a cut takes the place of several shards, and those stay
    empty. Ties in ``order`` get one fixed order; an empty table gives no rows.
    """
    placed = running(rows.withColumn("__one", F.lit(1).cast("long")), order,
                     {"__before": size, "__index": "__one"}, totals={"__total": size})
    cut = placed.withColumn(
        "shard", F.least(F.lit(shards - 1), F.expr(
            f"((2 * __before + {size}) * {shards}) div (2 * __total)")).cast("int"))
    first = cut.groupBy("shard").agg(F.min("__index").alias("__first"))  # one row a shard
    return (cut.join(F.broadcast(first), "shard")
            .withColumn("slot", F.col("__index") - F.col("__first"))
            .drop("__one", "__before", "__index", "__first", "__total"))


def _crc_steps() -> list[int]:
    """Remainders of the reflected CRC-32 polynomial for every byte."""
    steps = []
    for byte in range(256):
        for _ in range(8):
            byte = byte >> 1 ^ (0xEDB88320 if byte & 1 else 0)
        steps.append(byte)
    return steps


ORACLE = f"""
WITH t AS (SELECT {_crc_steps()}::BIGINT[] AS steps),
b AS (SELECT doc_id, (strlen(coalesce(text, '')) + 1)::BIGINT AS size, list_prepend(4294967295::BIGINT,
  [('0x' || x)::BIGINT FOR x IN regexp_extract_all(hex(encode(coalesce(text, ''))), '..')]) AS bytes FROM documents),
d AS (SELECT doc_id, size, xor(list_reduce(bytes, lambda a, x: xor(a >> 8, steps[(xor(a, x) & 255) + 1])),
  4294967295::BIGINT)::BIGINT AS text_crc32 FROM b, t),
p AS (SELECT *, (sum(size) OVER w - size)::BIGINT AS before, (sum(size) OVER ())::BIGINT AS total, row_number() OVER w AS k
  FROM d WINDOW w AS (ORDER BY doc_id NULLS LAST, size, text_crc32 ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
s AS (SELECT *, least(15, ((2 * before + size) * 16) // (2 * total))::INTEGER AS shard FROM p)
SELECT doc_id, size, text_crc32, 'bytes' AS law, shard, (k - min(k) OVER (PARTITION BY shard))::BIGINT AS slot,
  NULL::INTEGER AS grown_shard FROM s
"""


@query("op5_shard_documents", ORACLE)
def op5_shard_documents(spark, sf_dir: str) -> DataFrame:
    """All documents in 16 contiguous shards of near equal bytes, in order of doc_id."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = table(spark, sf_dir, "documents").select(
        "doc_id", text_bytes(F.col("text")).alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"))
    order = [F.col("doc_id").asc_nulls_last(), F.col("size").asc(), F.col("text_crc32").asc()]
    return shard_by_bytes(rows, order=order, size="size", shards=16).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"))
