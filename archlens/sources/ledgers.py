"""CSV ledgers with fixed columns: blank is null, unknown columns are not written."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

# The columns of each ledger, in file order.
_STREAM_TAIL = ("stream_index codec_type codec_name codec_long_name profile codec_tag_string codec_tag width height pix_fmt "
                "r_frame_rate avg_frame_rate time_base start_time duration nb_frames bit_rate_bps bit_rate_kbps channels "
                "sample_rate sample_fmt channel_layout bits_per_raw_sample bits_per_coded_sample")
COLUMNS = {
    "pre": ("timestamp preset source source_name source_ext source_dir source_size_bytes source_size_mb source_size_gib source_size_gb "
            "container_bitrate_kbps container_bitrate_mbps video_bitrate_kbps video_bitrate_mbps format_name format_long_name "
            "format_start_time probe_score file_mtime file_ctime codec codec_long_name profile codec_tag_string codec_tag width height "
            "resolution pix_fmt fps r_frame_rate avg_frame_rate duration_sec duration_min total_frames_est time_base start_time field_order "
            "color_range color_space color_transfer color_primaries bits_per_raw_sample bits_per_coded_sample stream_count video_streams "
            "audio_streams subtitle_streams data_streams attachment_streams audio_codecs subtitle_codecs data_codecs attachment_codecs").split(),
    "stream": ("timestamp preset source source_name " + _STREAM_TAIL).split(),
    "post": ("timestamp preset source output status elapsed_sec source_size_bytes source_size_mb source_size_gib output_size_bytes "
             "output_size_mb output_size_gib output_source_ratio space_saved_ratio source_fps source_duration_sec source_frames_est "
             "output_fps output_duration_sec output_frames_est output_width output_height output_pix_fmt output_codec output_profile "
             "output_r_frame_rate output_avg_frame_rate output_stream_count output_video_streams output_audio_streams "
             "output_subtitle_streams output_data_streams output_attachment_streams output_audio_codecs output_subtitle_codecs "
             "output_data_codecs output_attachment_codecs error").split(),
    "post_stream": ("timestamp preset source output " + _STREAM_TAIL).split(),
    "scaling": ("timestamp preset source source_name source_class normalized_ob_bpp ob_kbps spatial_factor temporal_factor "
                "pixel_rate_factor effective_rc_lookahead effective_gop_lookahead effective_min_keyint effective_merange "
                "effective_vbv_maxrate effective_vbv_bufsize").split(),
}
_LONGS = {c for cols in COLUMNS.values() for c in cols if c.endswith(("_bytes", "_streams", "_est", "_count", "_index")) or c in (
    "width", "height", "channels", "sample_rate", "probe_score", "nb_frames")}
_DOUBLES = {c for cols in COLUMNS.values() for c in cols if c.endswith(("_mb", "_gib", "_gb", "_kbps", "_mbps", "_ratio", "_sec", "_min", "_fps", "_factor", "_bpp")) or c == "fps"}


def schema(kind: str) -> T.StructType:
    of = lambda c: T.LongType() if c in _LONGS else T.DoubleType() if c in _DOUBLES else T.StringType()
    return T.StructType([T.StructField(c, of(c)) for c in COLUMNS[kind]])


def conform(rows: DataFrame, kind: str) -> DataFrame:
    """The ledger's columns in order; missing ones null, others dropped."""
    have = set(rows.columns)
    return rows.select(*[(F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema(kind)])


def write_ledger(rows: DataFrame, kind: str, path: str) -> None:
    """Append rows, one folder per preset."""
    conform(rows, kind).write.mode("append").option("nullValue", "").option("emptyValue", "").option("header", True).partitionBy("preset").csv(path)


def read_ledger(spark: SparkSession, kind: str, path: str) -> DataFrame:
    """Read by the fixed schema; the preset comes from the folder name."""
    body = T.StructType([f for f in schema(kind) if f.name != "preset"] + [T.StructField("preset", T.StringType())])
    return spark.read.schema(body).option("header", True).option("nullValue", "").csv(path).select(*COLUMNS[kind])
