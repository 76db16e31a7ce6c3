"""Plans that must stay small: each step of a long chain is read, not planned, again."""
from archlens import registry
from archlens.operators import curves
from tests.conftest import SF


def exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange ")


def test_curve_sum_plans_each_part_once(spark):
    assert exchanges(registry.QUERIES["win_14"](spark, SF)) < 20


def test_mapping_issues_derive_each_table_once(spark):
    """Every kind of issue, and each of the three inputs is read by one pass."""
    from pyspark.sql import functions as F
    from archlens.plans import audio
    names = ["entries", "selected", "known"]
    seen = {n: spark.sparkContext.accumulator(0) for n in names}

    def counted(name, rows, schema):
        def same(value, at=seen[name]):
            at.add(1)
            return value
        return spark.createDataFrame(rows, schema).withColumn("plan_id", F.udf(same, "bigint")("plan_id"))

    known = [(p, "cam", s, 2) for p in range(1, 9) for s in (1, 2)]
    selected = [(p, f"cam:s{s}:c0") for p in range(1, 9) for s in (1, 2)] + [(4, "cam:s1:c0"), (7, "cam:s2:c1"), (9, "cam:s1:c0")]
    entries = [(1, 0, "cam:s1:c0"), (1, 1, " cam:s2c0 "),                                # right
               (2, 0, "cam:s1:c0"), (2, 0, "cam:s2:c0"),                                # two channels on one output
               (3, 0, "cam:s1:c0"), (3, 1, "cam:s1:c0"), (3, 2, "cam:s2:c0"),           # a channel twice
               (4, 1, "cam:s1:c0"), (4, 2, "cam:s2:c0"),                                # does not begin at 0
               (5, 0, "cam:s1:c0"),                                                     # fewer than selected
               (6, 0, "mic:s1:c0"), (6, 0, "cam:s9:c0"), (6, 0, "cam:s1:c5"), (6, 0, "odd"), (6, 0, "cam:s1:c1"), (6, 0, None),
               (9, 0, "cam:s1:c0")]                                                     # a plan without streams
    got = audio.mapping_issues(counted("entries", entries, "plan_id bigint, output_index bigint, channel_id string"),
                               counted("selected", selected, "plan_id bigint, channel_id string"),
                               counted("known", known, "plan_id bigint, source_id string, stream_index bigint, channels bigint"))
    rows = sorted(((r.plan_id, r.reason, r.location) for r in got.collect()), key=str)
    assert rows == sorted([
        (2, "audio_mix_not_supported", "0"), (2, "audio_mapping_output_order", "indices"),
        (3, "audio_mapping_output_order", "cam:s1:c0"), (4, "audio_mapping_output_order", "indices"), (5, "audio_mix_not_supported", "collapse"),
        (6, "audio_source_not_found", "mic:s1:c0"), (6, "audio_stream_not_found", "cam:s9:c0"), (6, "audio_channel_not_found", "cam:s1:c5"),
        (6, "audio_channel_not_found", "odd"), (6, "audio_mapping_not_selected", "cam:s1:c1"), (6, "audio_channel_not_found", None),
        (7, "audio_mapping_incomplete", "mapping"), (8, "audio_mapping_incomplete", "mapping"), (9, "audio_source_not_found", "cam:s1:c0")], key=str)
    assert {n: seen[n].value for n in names} == {"entries": len(entries), "selected": len(selected), "known": len(known)}


def nodes(plan):
    return [plan] + [n for i in range(plan.children().size()) for n in nodes(plan.children().apply(i))]


def unfolds(plan):
    """Whether rows that a Generate makes come out of ``plan`` one by one."""
    if plan.nodeName() == "Aggregate":
        return False
    return plan.nodeName() == "Generate" or any(unfolds(plan.children().apply(i)) for i in range(plan.children().size()))


def test_curve_sum_joins_no_unfolded_seconds(spark, monkeypatch):
    """Spark takes unfolded seconds for as few as the points they come from, and broadcasts them."""
    frames, write = [], curves.cut_lineage
    monkeypatch.setattr(curves, "cut_lineage", lambda df: frames.append(df) or write(df))
    frames.append(registry.QUERIES["win_14"](spark, SF))
    found = [n for df in frames for n in nodes(df._jdf.queryExecution().optimizedPlan())]
    assert any(n.nodeName() == "Generate" for n in found) and any(n.nodeName() == "Join" for n in found)
    assert not [n.toString() for n in found if n.nodeName() == "Join" and unfolds(n)]
