"""Logical tables derived from the driver's test tables.

Each view is SQL text valid in Spark and DuckDB (``{us}`` is the engine's
microseconds-since-epoch function), so operators and checks read equal rows.
Facts of one file are bounded by construction: streams are folded to one row
per (file, line number) and audio to one row per 64-sample block.
"""
from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from .session import configure

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()

VIEWS = {
    "v_file": """
SELECT p_partkey AS file_id, p_brand AS dir,
       concat(replace(p_name,' ','_'),'_',CAST(p_partkey AS STRING),CASE WHEN p_partkey % 2 = 0 THEN '.MP4' ELSE '.MOV' END) AS name,
       CASE p_type WHEN 'PROMO' THEN 'prores' WHEN 'SMALL' THEN 'h264' ELSE 'hevc' END AS codec,
       CASE WHEN p_size % 4 = 0 THEN 3840 WHEN p_size % 4 = 1 THEN 1920 WHEN p_size % 4 = 2 THEN 1280 ELSE 0 END AS width,
       CASE WHEN p_size % 4 = 0 THEN 2160 WHEN p_size % 4 = 1 THEN 1080 WHEN p_size % 4 = 2 THEN 720 ELSE 0 END AS height,
       CASE WHEN p_size % 3 = 0 THEN '60000/1001' WHEN p_size % 3 = 1 THEN '30000/1001' ELSE '0/0' END AS rate_text,
       CAST(p_size AS DOUBLE) * 2.5 AS duration_sec,
       CAST(round(p_retailprice * 100000) AS BIGINT) AS size_bytes
FROM part""",
    "v_stream": """
SELECT l_orderkey AS file_id, CAST(l_linenumber AS BIGINT) AS stream_index,
       CASE min(l_returnflag) WHEN 'A' THEN 'audio' WHEN 'N' THEN 'video' ELSE 'data' END AS codec_type,
       CASE WHEN max(l_linestatus) = 'O' THEN 'pcm_s24be' ELSE 'aac' END AS codec_name,
       CAST(CASE WHEN min(l_suppkey) % 10 = 0 THEN 44100 ELSE 48000 END AS BIGINT) AS sample_rate,
       CAST(1 + min(l_partkey) % 2 AS BIGINT) AS channels,
       max(l_quantity) AS duration_sec, CAST(min(l_partkey) AS BIGINT) AS tag_key
FROM lineitem GROUP BY l_orderkey, l_linenumber""",
    "v_frame": """
SELECT user_id AS file_id, CAST(0 AS BIGINT) AS ref, CAST(1 + event_id % 3 AS BIGINT) AS tgt,
       event_id AS frame_no,
       CAST(floor(({us} - 1704067200000000) / 125000) AS BIGINT) AS center_sample,
       CASE WHEN event_type = 'error' THEN NULL ELSE value END AS delay_samples,
       CAST(regexp_extract(props, '([0-9]+)', 1) AS DOUBLE) / 100 AS confidence
FROM events""",
    "v_track_a": """
SELECT o_custkey AS file_id, o_orderkey AS track_id,
       CASE o_orderstatus WHEN 'F' THEN 'fixed' WHEN 'O' THEN 'untouched' ELSE 'already_aligned' END AS decision,
       CASE WHEN o_orderstatus = 'O' THEN CASE o_orderpriority WHEN '1-URGENT' THEN 'non_constant' WHEN '2-HIGH' THEN 'low_confidence'
            WHEN '3-MEDIUM' THEN 'recheck_residual' WHEN '4-NOT SPECIFIED' THEN 'out_of_range' ELSE 'silent_track' END ELSE NULL END AS reason,
       o_totalprice / 1000 AS delay_ms, CAST(o_orderkey % 40 AS BIGINT) AS usable_frames,
       CAST(o_orderkey % 17 AS DOUBLE) / 10 AS mad_ms, CAST(o_orderkey % 23 AS DOUBLE) / 10 AS spread_ms
FROM orders""",
    "v_track_b": """
SELECT file_id, track_id,
       CASE WHEN track_id % 7 = 0 THEN 'fixed' WHEN track_id % 13 = 0 THEN 'anchor' ELSE decision END AS decision, reason,
       CASE WHEN track_id % 5 = 0 THEN delay_ms + 1 ELSE delay_ms END AS delay_ms, usable_frames, mad_ms, spread_ms
FROM v_track_a WHERE track_id % 11 <> 0""",
    "v_fact": """
SELECT c_custkey AS file_id, 'original' AS side, 'video.codec' AS item, c_mktsegment AS value FROM customer
UNION ALL SELECT c_custkey, 'original', 'video.timescale', CAST(c_nationkey AS STRING) FROM customer
UNION ALL SELECT c_custkey, 'original', 'format.title', CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE c_name END FROM customer
UNION ALL SELECT c_custkey, 'final', 'format.title', CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE c_name END FROM customer
UNION ALL SELECT c_custkey, 'final', 'video.codec', CASE WHEN c_custkey % 6 = 0 THEN 'other' ELSE c_mktsegment END FROM customer
UNION ALL SELECT c_custkey, 'final', 'video.timescale', CAST(c_nationkey AS STRING) FROM customer WHERE c_custkey % 10 <> 0""",
    "v_check": """
SELECT doc_id AS file_id, 'CTR-01' AS check_id, CASE WHEN quality = 1 THEN 'PASS' ELSE 'WARN' END AS verdict FROM labels
UNION ALL SELECT doc_id, 'AUD-03',
       CASE WHEN toxic = 1 THEN 'FAIL' WHEN doc_id % 9 = 0 THEN 'UNMEASURABLE' ELSE 'PASS' END FROM labels
UNION ALL SELECT doc_id, 'FMT-04', 'SKIP' FROM labels""",
    "v_path": """
SELECT page_id AS path_id, url AS path FROM pages""",
    "v_log": """
SELECT conv_id, turn, role, text AS log_text FROM conversations""",
    "v_base": """
SELECT CAST(floor(vec_id / 100) AS BIGINT) AS file_id, vec_id % 100 AS block_no, embedding AS samples
FROM embeddings""",
}

_DEPENDS = {"v_track_b": ["v_track_a"]}


def view_sql(name: str, sf_dir: str) -> str:
    """Spark text of a view, with its tables read straight from parquet."""
    text = VIEWS[name].replace("{us}", "unix_micros(CAST(ts AS TIMESTAMP))")
    for dep in _DEPENDS.get(name, ()):
        text = re.sub(rf"\bFROM {dep}\b", f"FROM ({view_sql(dep, sf_dir)})", text)
    for table in TABLES:
        text = re.sub(rf"\bFROM {table}\b", f"FROM parquet.`{sf_dir}/{table}.parquet`", text)
    return text


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One derived view or driver table."""
    configure(spark)
    if name in TABLES:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spark.sql(view_sql(name, sf_dir))


def duck_sql(name: str) -> str:
    return VIEWS[name].replace("{us}", "epoch_us(ts)")


def with_views(body: str, *extra: str) -> str:
    """DuckDB text: the views ``body`` names, as common table expressions."""
    used: list[str] = []

    def need(name: str) -> None:
        for dep in _DEPENDS.get(name, ()):
            need(dep)
        if name not in used:
            used.append(name)

    for name in VIEWS:
        if re.search(rf"\b{name}\b", body + " ".join(extra)):
            need(name)
    parts = [f"{n} AS ({duck_sql(n)})" for n in used]
    parts += list(extra)
    return ("WITH " + ",\n".join(parts) + "\n" if parts else "") + body
