"""Audio plans: selection and mapping checks, packets, grouping, formats, windows."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.scalar import bitrate_text, channel_parts, is_pcm, samples_from_seconds
from ..operators.ordered import carry, neighbours, running_sum
from ..session import cut_lineage

# Codecs an output format can be inherited from, and lossless formats.
FORMAT_FOR_CODEC = {"aac": "aac", "opus": "opus", "flac": "flac"}
LOSSLESS = ["pcm", "flac"]


def alignment_policy(sources: DataFrame) -> DataFrame:
    """Whether alignment runs, is off or is refused, from request and formats.

    One row per participating stream with its plan's ``requested`` policy.
    """
    per = sources.groupBy("plan_id").agg(
        F.max("requested").alias("requested"), F.count("codec_name").alias("n"),
        F.count_if(is_pcm(F.col("codec_name"))).alias("pcm"))
    mixed, requested = F.col("pcm") < F.col("n"), F.col("requested")
    reason = (F.when(F.col("n") == 0, "audio_alignment_no_channels")
              .when(requested == "disabled", "alignment_disabled_by_request")
              .when((requested == "enabled") & mixed, "alignment_enabled_rejected_non_pcm")
              .when(requested == "enabled", "alignment_enabled_pcm")
              .when(mixed & (F.col("pcm") > 0), "alignment_default_mixed")
              .when(mixed, "alignment_default_compressed").otherwise("alignment_default_pcm"))
    out = per.withColumn("reason", reason)
    return out.select("plan_id", "requested", "reason",
                      F.col("reason").isin("alignment_enabled_pcm", "alignment_default_pcm").alias("enabled"),
                      (F.col("reason") == "alignment_enabled_rejected_non_pcm").alias("refused"))


def output_format(streams: DataFrame, requests: DataFrame, default: str = "pcm") -> DataFrame:
    """Format and bitrate of each plan: manual, else from the first stream, else default."""
    s = F.struct("codec_name", "bit_rate")
    codec = F.lower(F.trim(F.col("codec_name")))
    inherited = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in FORMAT_FOR_CODEC.items() for x in kv]), codec),
                           F.when(is_pcm(codec), "pcm"))
    first = streams.groupBy("plan_id").agg(F.min_by(s, "output_index").alias("f")).select("plan_id", "f.codec_name")
    chosen = requests.join(first, "plan_id", "left").withColumn("_inherited", inherited)
    chosen = chosen.withColumn("format", F.coalesce("format_request", "_inherited", F.lit(default))).withColumn(
        "codec_origin", F.when(F.col("format_request").isNotNull(), "manual").when(F.col("_inherited").isNotNull(), "source").otherwise("encoder_default"))
    rated = streams.withColumn("rate", bitrate_text(F.col("bit_rate"))).where(F.col("rate") != "").groupBy(
        "plan_id", F.lower(F.trim("codec_name")).alias("format")).agg(F.min_by("rate", "output_index").alias("rate"))
    joined = chosen.join(rated, ["plan_id", "format"], "left")
    lossy = ~F.col("format").isin(*LOSSLESS)
    manual = F.nullif("bitrate_request", F.lit(""))
    bitrate = F.coalesce(manual, F.when(lossy & (F.col("codec_origin") != "encoder_default"), F.col("rate")), F.lit(""))
    return joined.select("plan_id", "format", "codec_origin", bitrate.alias("bitrate"),
                         F.when(manual.isNotNull(), "manual").when(bitrate != "", "source").otherwise("none").alias("bitrate_origin"),
                         F.when(manual.isNotNull() & ~lossy, "audio_format_bitrate_not_applicable").alias("error"))


def _resolved(rows: DataFrame, known: DataFrame) -> DataFrame:
    """Rows with their parsed channel id and what of it exists in ``known`` streams.

    A stream that is found vouches for its source, so only rows without one look for the source.
    """
    p = channel_parts(F.col("channel_id"))
    parsed = rows.select("*", *[c.alias(n) for n, c in p.items()])
    known = cut_lineage(known.select("plan_id", "source_id", "stream_index", "channels"))
    looked = cut_lineage(parsed.join(known, ["plan_id", "source_id", "stream_index"], "left"))
    lost = F.col("channels").isNull() & F.col("source_id").isNotNull()
    sources = known.select("plan_id", "source_id", F.lit(True).alias("_source")).distinct()
    checked = looked.where(~lost).withColumn("_source", F.lit(True)).unionByName(
        looked.where(lost).join(sources, ["plan_id", "source_id"], "left"))
    return (checked
            .withColumn("canonical", F.concat(F.col("source_id"), F.lit(":s"), F.col("stream_index").cast("string"),
                                              F.lit(":c"), F.col("channel_index").cast("string")))
            .withColumn("reason", F.when(F.col("source_id").isNull(), "audio_channel_not_found")
                        .when(F.col("_source").isNull(), "audio_source_not_found")
                        .when(F.col("channels").isNull(), "audio_stream_not_found")
                        .when(F.col("channel_index") >= F.col("channels"), "audio_channel_not_found")))


def selection_issues(selected: DataFrame, known: DataFrame) -> DataFrame:
    """Unknown, malformed and repeated channels of a selection (plan_id, pos, channel_id)."""
    r = _resolved(selected, known)
    first = r.where(F.col("reason").isNull()).groupBy("plan_id", "canonical").agg(F.min("pos").alias("_first"))
    again = F.when(F.col("reason").isNull() & (F.col("pos") > F.col("_first")), "audio_source_duplicate")
    return r.join(first, ["plan_id", "canonical"], "left").select(
        "plan_id", "pos", "channel_id", F.coalesce("reason", again).alias("reason")).where(F.col("reason").isNotNull())


def mapping_issues(entries: DataFrame, selected: DataFrame, known: DataFrame) -> DataFrame:
    """Issues of a mapping (plan_id, output_index, channel_id), references first.

    Structure (fan-in, index order, copies, collapse) is only judged for plans
    whose references are all valid.
    """
    # selection and mapping are resolved in one pass; what feeds several checks is written out once
    named = selected.select("plan_id", F.lit(None).cast(entries.schema["output_index"].dataType).alias("output_index"), "channel_id", F.lit(True).alias("_sel"))
    both = _resolved(named.unionByName(entries.select("plan_id", "output_index", "channel_id", F.lit(False).alias("_sel"))), known)
    ok = cut_lineage(both.where(F.col("_sel") & F.col("reason").isNull()).select("plan_id", "canonical").distinct())
    r = both.where(~F.col("_sel")).select("plan_id", "output_index", "channel_id", "canonical", "reason").join(
        ok.withColumn("_selected", F.lit(True)), ["plan_id", "canonical"], "left")
    r = cut_lineage(r.withColumn("reason", F.coalesce("reason", F.when(F.col("_selected").isNull(), "audio_mapping_not_selected"))).drop("_selected"))
    bad = F.col("reason").isNotNull()
    out = r.where(bad).select("plan_id", "reason", F.col("channel_id").alias("location"))
    text = lambda c: F.col(c).cast("string")
    # per output, then per plan; a plan with a bad reference has ``bad`` above 0 and is no further judged
    outputs = cut_lineage(r.groupBy("plan_id", "output_index").agg(
        F.count_distinct("canonical").alias("k"), F.count(F.lit(1)).alias("n"), F.count_if(bad).alias("bad")))
    plans = cut_lineage(outputs.groupBy("plan_id").agg(
        F.sum("n").alias("n"), F.count("output_index").alias("d"), F.min("output_index").alias("lo"), F.max("output_index").alias("hi"), F.sum("bad").alias("bad")))
    shape = plans.where("bad = 0")
    fan = outputs.where("k > 1").join(shape, "plan_id", "left_semi").select(
        "plan_id", F.lit("audio_mix_not_supported").alias("reason"), text("output_index").alias("location"))
    order = shape.where(~((F.col("d") == F.col("n")) & (F.col("lo") == 0) & (F.col("hi") == F.col("n") - 1))).select(
        "plan_id", F.lit("audio_mapping_output_order").alias("reason"), F.lit("indices").alias("location"))
    copies = r.where(~bad).groupBy("plan_id", "canonical").agg(F.count(F.lit(1)).alias("k")).where("k > 1").join(
        shape, "plan_id", "left_semi").select(
        "plan_id", F.lit("audio_mapping_output_order").alias("reason"), F.col("canonical").alias("location"))
    wanted = ok.groupBy("plan_id").agg(F.count(F.lit(1)).alias("wanted")).join(plans, "plan_id", "left")
    empty = F.col("n").isNull()
    whole = wanted.where(empty | ((F.col("bad") == 0) & (F.col("wanted") > F.col("n")))).select(
        "plan_id", F.when(empty, "audio_mapping_incomplete").otherwise("audio_mix_not_supported").alias("reason"),
        F.when(empty, "mapping").otherwise("collapse").alias("location"))
    for part in (fan, order, copies, whole):
        out = out.unionByName(part)
    return out


def output_packets(entries: DataFrame, streams: DataFrame) -> DataFrame:
    """Per source stream of a plan: copied whole, or routed and why.

    Copying needs consecutive outputs that cover all channels in source order.
    A stream's entries are as few as its channels.
    """
    keys = ["plan_id", "source_id", "stream_index"]
    order = F.transform(F.array_sort(F.collect_list(F.struct("output_index", "channel_index"))), lambda e: e["channel_index"])
    per = entries.groupBy(*keys).agg(
        order.alias("_c"), F.min("output_index").alias("first_output"), F.max("output_index").alias("_hi"), F.count(F.lit(1)).alias("n_channels"))
    joined = per.join(streams, keys, "left").withColumn("total", F.coalesce("channels", F.lit(0)))
    natural_order = F.when(F.col("total") > 0, F.sequence(F.lit(0).cast("bigint"), F.col("total") - 1))
    complete = F.coalesce(F.array_sort("_c") == natural_order, F.lit(False))
    natural = F.coalesce(F.col("_c") == natural_order, F.lit(False))
    together = F.col("_hi") - F.col("first_output") + 1 == F.col("n_channels")
    note = F.when(~complete, "channel subset").when(~natural, "channel reorder").when(~together, "split across outputs")
    return joined.select(*keys, "first_output", "n_channels", "total",
                         F.when(note.isNull(), "COPY").otherwise("ROUTED").alias("kind"), note.alias("note"))


def output_groups(entries: DataFrame, group_size: int) -> DataFrame:
    """Mapped channels as output streams, nothing lost.

    Runs of primary and external channels alternate; a primary run breaks where
    its source stream changes, an external one after every ``group_size``.
    """
    wide, window, keep = neighbours(entries, ["plan_id"], "output_index", 1)
    lag = lambda c: F.lag(c).over(window)
    new_run = lag("kind").isNull() | (lag("kind") != F.col("kind"))
    other = ~lag("source_id").eqNullSafe(F.col("source_id")) | ~lag("stream_index").eqNullSafe(F.col("stream_index"))
    marked = wide.withColumn("_run", new_run).withColumn("_other", other).where(keep).select(*entries.columns, "_run", "_other")
    placed = carry(marked, ["plan_id"], "output_index", F.when(F.col("_run"), F.col("output_index")), "_from")
    starts = F.col("_run") | F.when(F.col("kind") == "primary", F.col("_other")).otherwise(
        (F.col("output_index") - F.col("_from")) % group_size == 0)
    grouped = running_sum(placed, ["plan_id"], "output_index", F.when(starts, 1).otherwise(0), "group_no")
    return grouped.groupBy("plan_id", "group_no", "kind").agg(
        F.count(F.lit(1)).alias("n_channels"), F.min("output_index").alias("first_output"), F.max("output_index").alias("last_output"))


def render_window(spans: DataFrame, *, intersection: bool = False) -> DataFrame:
    """Start and end over the known channel spans of a plan, or the reason there is none."""
    lo, hi = (F.max, F.min) if intersection else (F.min, F.max)
    rate = F.col("sample_rate")
    per = spans.groupBy("plan_id").agg(
        lo("start_sample").alias("start_sample"), hi("end_sample").alias("end_sample"), F.bool_or(F.coalesce(rate, F.lit(0)) <= 0).alias("_none"),
        F.min(rate).alias("_lo"), F.max(rate).alias("_hi"), F.count("end_sample").alias("known"), F.count(F.lit(1)).alias("channels"))
    reason = (F.when(F.col("_none"), "audio_timeline_invalid").when(F.col("_lo") != F.col("_hi"), "audio_sample_rate_mismatch")
              .when(F.col("known") == 0, "audio_duration_unknown").when(F.col("end_sample") < F.col("start_sample"), "audio_negative_render_duration"))
    keep = lambda c: F.when(F.col("reason").isNull(), F.col(c)).alias(c)
    return per.withColumn("reason", reason).select("plan_id", "channels", "known", "reason", keep("start_sample"), keep("end_sample"))


def declared_mismatches(streams: DataFrame, actual: DataFrame, tolerance: int = 1) -> DataFrame:
    """Streams whose decoded samples differ from what they declare; both must be known."""
    counted = F.col("nb_frames").try_cast("bigint")
    by_time = F.when(F.col("sample_rate") > 0, samples_from_seconds(F.col("duration_sec"), F.col("sample_rate")))
    declared = streams.withColumn("declared", F.when(counted > 0, counted).otherwise(by_time))
    joined = declared.join(actual, ["file_id", "stream_index"], "left")
    delta = F.col("actual") - F.col("declared")
    return joined.where(F.abs(delta) > tolerance).select("file_id", "stream_index", "declared", "actual", delta.alias("delta"))
