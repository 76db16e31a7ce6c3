"""External audio of videos, where a folder repeats its names."""
from archlens.operators import ledger as g


def test_equal_names_meet_a_video_once(spark):
    videos = spark.createDataFrame([(i, "d", "Clip1") for i in range(40)], "video_id bigint, dir string, stem string")
    names = ["clip1-2.wav", "CLIP1-2.wav", "clip1.flac", "clip1x.wav"] * 30
    audios = spark.createDataFrame([("d", n) for n in names], "dir string, name string")
    found = g.match_external(videos, audios)
    assert sorted((r.video_id, r.name, r.remainder, r.rank, r["index"]) for r in found.collect()) == sorted(
        row for i in range(40) for row in ((i, "CLIP1-2.wav", "-2", 1, 2), (i, "clip1.flac", "", 0, None)))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Join") < plan.rindex("Aggregate"), "copies of a name are joined before they are folded"
