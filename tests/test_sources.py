"""Files on disk: listing, WAV blocks, boxes, ledgers; streams over a folder."""
import io
import struct
import wave

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, GreaterThan

from archlens import registry
from archlens.sources import files, isobmff, ledgers, logs, media, probe, wav
from archlens.streaming import jobs


def write_wav(path, frames, width=2, channels=2):
    with wave.open(str(path), "wb") as f:
        f.setnchannels(channels)
        f.setsampwidth(width)
        f.setframerate(48000)
        f.writeframes(frames)


@pytest.mark.parametrize("width", [2, 3, 4])
@pytest.mark.parametrize("split", [10_000_000, 1000])
def test_wav_blocks(spark, tmp_path, width, split):
    n = 1000
    x = np.random.default_rng(0).integers(-(1 << (8 * width - 1)), (1 << (8 * width - 1)) - 1, (n, 2))
    raw = b"".join(int(v).to_bytes(width, "little", signed=True) for v in x.ravel())
    write_wav(tmp_path / "a.wav", raw, width)
    (tmp_path / "junk.wav").write_bytes(b"not a wav")
    spark.dataSource.register(wav.WavBlocks)
    df = spark.read.format("wav_blocks").option("path", str(tmp_path)).option("blockSamples", 64).option("splitBytes", split).load()
    got = df.where("error IS NULL").toPandas()
    junk = df.where("error IS NOT NULL").collect()
    assert [(r.path.rsplit("/", 1)[1], r.samples, r.error) for r in junk] == [("junk.wav", None, "not a RIFF/WAVE file")]
    strict = spark.read.format("wav_blocks").option("path", str(tmp_path)).option("mode", "FAILFAST").load()
    with pytest.raises(Exception, match="not a RIFF/WAVE file"):
        strict.count()
    assert len(got) == 2 * 16 and set(got.sample_rate) == {48000}
    for c in range(2):
        part = got[got.channel == c].sort_values("block_no")
        np.testing.assert_allclose(np.concatenate(list(part.samples)), x[:, c] / float(1 << (8 * width - 1)), atol=1e-6)
        assert list(part.start_sample) == [64 * i for i in range(16)]


def test_wav_errors():
    header = b"RIFF\x00\x00\x00\x00WAVE"
    a_law = b"fmt " + struct.pack("<IHHIIHH", 16, 6, 1, 8000, 8000, 1, 8) + b"data" + struct.pack("<I", 4) + bytes(4)
    for raw, why in ((b"", "not a RIFF"), (header, "no sample data"), (header + b"fmt \x10\x00\x00\x00\x01", "ends inside"),
                     (header + b"data" + bytes(4), "before its format"), (header + a_law, "unsupported format: code 6")):
        rows = [r for b in wav.read_blocks("p", io.BytesIO(raw), len(raw), 8, 0, max(1, len(raw))) for r in b.to_pylist()]
        assert len(rows) == 1 and why in rows[0]["error"] and rows[0]["path"] == "p"


def mp4_box(kind, body=b""):
    return struct.pack(">I", len(body) + 8) + kind.encode() + body


def sample_movie():
    hdlr = mp4_box("hdlr", bytes(8) + b"soun" + bytes(12))
    stsd = mp4_box("stsd", bytes(4) + struct.pack(">I", 1) + struct.pack(">I", 16) + b"ipcm" + bytes(8))
    data_hdlr = mp4_box("hdlr", bytes(4) + b"dhlr" + b"url " + bytes(12))
    trak = mp4_box("trak", mp4_box("mdia", hdlr + mp4_box("minf", data_hdlr + mp4_box("stbl", stsd))) + mp4_box("uuid", b"\x01" * 16 + b"abc"))
    mvhd = mp4_box("mvhd", bytes(12) + struct.pack(">II", 600, 6000) + bytes(4))
    wide = struct.pack(">I", 1) + b"mdat" + struct.pack(">Q", 16 + 100) + bytes(100)
    return mp4_box("ftyp", b"isom" + bytes(4)) + wide + mp4_box("moov", mvhd + trak + mp4_box("uuid", b"\x02" * 16 + b"z"))


def test_boxes(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "a.MP4").write_bytes(sample_movie())
    (tmp_path / "b.mov").write_bytes(sample_movie()[:60])
    spark.dataSource.register(isobmff.MediaBoxes)
    df = spark.read.format("isobmff_boxes").option("path", str(tmp_path)).option("filesPerTask", 1).load()
    a = df.where("path LIKE '%a.MP4'")
    assert [r.type for r in a.where("parent = ''").orderBy("box_no").collect()] == ["ftyp", "mdat", "moov"]
    fact = isobmff.container_facts(a).first()
    assert (fact.brand, fact.moov_first, fact.mvhd_sec, fact.trak_count, fact.uuid_count) == ("isom", False, 10.0, 1, 2)
    assert sorted(r.ctx for r in isobmff.uuid_items(a).collect()) == ["moov", "trak:soun"]
    assert a.where("entry = 'ipcm'").count() == 1 and [(r.type, r.start, r.size) for r in df.where("path LIKE '%b.mov'").orderBy("box_no").collect()] == [("ftyp", 0, 16), ("broken", 16, 44)]
    for cut in range(len(sample_movie())):  # no cut makes it fail, and none goes unsaid but those between boxes
        kinds = [r[3] for r in isobmff.walk("p", io.BytesIO(sample_movie()[:cut]), cut)]
        whole = max(b for b in (0, 16, 132) if b <= cut)
        padding = cut - whole < 8 and not any(sample_movie()[whole:cut])
        assert ("broken" in kinds) == (not padding)


def test_listing(spark, tmp_path):
    for name in ("B/x.MOV", "a/y.mp4", "a/z.txt", "c1/w.mkv", "top.mp4"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(b"1")
    got = [r.path.removeprefix(f"{tmp_path}/") for r in media.list_media(spark, str(tmp_path)).collect()]
    assert got == ["a/y.mp4", "B/x.MOV", "c1/w.mkv", "top.mp4"]
    some = media.list_media(spark, str(tmp_path), dir_regex="[a-c]").collect()
    assert [r.path.removeprefix(f"{tmp_path}/") for r in some] == ["a/y.mp4"]


@pytest.mark.parametrize("kind", sorted(ledgers.COLUMNS))
def test_ledger_round_trip(spark, tmp_path, kind):
    rows = spark.createDataFrame([("UHQ", "a.mov", None), ("HQ", "b,\"c\".mov", "t")], "preset string, source string, timestamp string")
    for _ in range(2):
        ledgers.write_ledger(rows, kind, str(tmp_path / kind))
    back = ledgers.read_ledger(spark, kind, str(tmp_path / kind))
    assert back.columns == ledgers.COLUMNS[kind] and back.count() == 4
    assert {(r.preset, r.source, r.timestamp) for r in back.collect()} == {("UHQ", "a.mov", None), ("HQ", "b,\"c\".mov", "t")}


def test_probe_files_and_metric_lines(spark, tmp_path):
    (tmp_path / "p.json").write_text('{"format": {"size": "100"}, "streams": [{"index": 0, "codec_type": "audio"}, '
                                     '{"index": 1, "codec_type": "video", "duration": "2.0", "r_frame_rate": "25/1"}]}')
    probes = probe.read_probe(spark, str(tmp_path / "p.json"))
    row = probe.media_files(probes).first()
    assert (row.duration_sec, row.fps, row.total_frames, row.bitrate_bps) == (2.0, 25.0, 50, 400.0)
    assert probe.media_streams(probes).count() == 2
    (tmp_path / "m.txt").write_text("n:1 psnr_avg:31.5\nother\nn:2 psnr_avg:inf\n")
    assert [r.psnr for r in logs.read_metric_lines(spark, str(tmp_path / "m.txt")).collect()] == [31.5]


def test_arrivals_once_and_again(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.mp4").write_bytes(b"1")
    seen = []
    run = lambda: jobs.process_arrivals(jobs.arriving_files(spark, str(tmp_path / "in")), lambda df, n: seen.extend(r.path for r in df.collect()),
                                        str(tmp_path / "cp")).awaitTermination()
    run()
    (tmp_path / "in" / "b.MOV").write_bytes(b"2")
    (tmp_path / "in" / "c.txt").write_bytes(b"3")
    run()
    run()
    assert [p.rsplit("/", 1)[1] for p in seen] == ["a.mp4", "b.MOV"]


def test_status_ignores_blank_and_unknown(spark):
    rows = [("a", 1, "update", "x", "early", "", 9, 0.0), ("a", 2, "admit", "HQ", "", "", 0, 0.0), ("a", 3, "admit", "SMALL", "", "", 0, 0.0),
            ("a", 4, "update", "", "run", "d", 5, 2.0), ("a", 5, "update", "", "", "", 0, 0.0), ("b", 6, "update", "", "run", "", 1, 1.0),
            ("c", 7, "admit", "HQ", "", "", 0, 0.0), ("c", 9, "finish", "", "done", "", 0, 0.0)]
    df = spark.createDataFrame(rows, "source string, seq bigint, kind string, preset string, status string, detail string, frames bigint, fps double")
    df = df.withColumn("ts", F.timestamp_seconds(F.col("seq") * 10))
    got = {r.source: (r.preset, r.status, r.detail, r.frames, r.fps, r.elapsed) for r in jobs.latest_status(df).collect()}
    assert got == {"a": ("HQ", "run", "d", 5, 2.0, None), "c": ("HQ", "done", "", 0, 0.0, 20.0)}


def job_events(spark, rows):
    df = spark.createDataFrame(rows, "source string, seq bigint, kind string, preset string, status string, detail string, frames bigint, fps double")
    return df.withColumn("ts", F.timestamp_seconds(F.col("seq") * 10))


def test_snapshots_merge_batches_and_replay_changes_nothing(spark, tmp_path):
    batches = [[("a", 1, "update", "x", "early", "", 9, 0.0), ("a", 2, "admit", "HQ", "", "", 0, 0.0), ("b", 3, "admit", "HQ", "", "", 0, 0.0)],
               [("a", 5, "update", "", "run", "d", 5, 2.0), ("c", 4, "update", "", "run", "", 1, 1.0)],
               [("a", 6, "update", "", "", "", 0, 0.0), ("c", 7, "admit", "S", "", "", 0, 0.0), ("b", 8, "finish", "", "done", "", 0, 0.0)]]
    root, source = str(tmp_path / "status"), str(tmp_path / "in")
    stream = lambda: spark.readStream.schema(job_events(spark, batches[0]).schema).parquet(source)
    seen, early = [], None
    for part in batches:
        job_events(spark, part).coalesce(1).write.mode("append").parquet(source)
        jobs.status_snapshots(stream(), root, str(tmp_path / "cp")).awaitTermination()
        if early is None:
            early = jobs.read_snapshot(spark, root)  # a reader that began before the next batch was published
        elif len(seen) == 1:
            assert {r.source for r in early.collect()} == {"a", "b"}
        seen.append(jobs._published(spark, root))
    got = sorted(map(tuple, jobs.status_rows(jobs.read_snapshot(spark, root)).collect()))
    whole = job_events(spark, [r for part in batches for r in part])
    assert got == sorted(map(tuple, jobs.latest_status(whole).collect()))
    assert [n for _, n in seen] == [0, 1, 2]
    assert len([p for p in (tmp_path / "status").iterdir() if p.name.startswith("snapshot-")]) == 2
    # the checkpoint is lost: batches up to the published one change nothing
    jobs.status_snapshots(stream(), root, str(tmp_path / "cp2")).awaitTermination()
    assert jobs._published(spark, root) == seen[-1]


def test_snapshot_of_nothing_and_repeated_writes(spark, tmp_path):
    root = str(tmp_path / "s")
    with pytest.raises(FileNotFoundError):
        jobs.read_snapshot(spark, root)
    rows = job_events(spark, [("a", 1, "admit", "HQ", "", "", 0, 0.0)])
    for part in (rows.limit(0), rows, rows):
        jobs.write_snapshot(jobs.latest_status(part), root, meta={"run": "r"})
    last = jobs.read_snapshot(spark, root).collect()
    assert [(r.source, r.status, r.finished, r.meta) for r in last] == [("a", "queued", False, {"run": "r"})] and last[0].written_at


def test_filters_leave_files_unopened(spark, tmp_path):
    raw = np.arange(200, dtype="<i2").tobytes()
    for name in "abc":
        write_wav(tmp_path / f"{name}.wav", raw)
    (tmp_path / "m.mov").write_bytes(sample_movie())
    files.register(spark, wav.WavBlocks, isobmff.MediaBoxes)
    blocks = spark.read.format("wav_blocks").option("path", str(tmp_path)).option("blockSamples", 16).load()
    parts = lambda df: df.rdd.getNumPartitions()
    one = blocks.where(F.col("path") == f"{tmp_path}/b.wav")
    assert parts(blocks) == 3 and parts(one) == 1 and one.count() == 14
    some = blocks.where("path LIKE '%c.wav' AND channel = 1 AND block_no BETWEEN 2 AND 3 AND start_sample > 32")
    assert parts(some) == 1 and [(r.channel, r.block_no, len(r.samples)) for r in some.collect()] == [(1, 3, 16)]
    assert one.where("channel IS NULL OR block_no IN (0, 5)").count() == 4 and one.where("channel = 7").count() == 0
    assert blocks.where("path = 'x'").count() == 0
    boxes = spark.read.format("isobmff_boxes").option("path", str(tmp_path)).option("filesPerTask", 1).load()
    assert parts(boxes.where("path = 'x'")) <= 1 and boxes.where("path = 'x'").count() == 0 and boxes.where("path LIKE '%m.mov'").count() == boxes.count()


def test_pushed_blocks_are_not_read():
    class Counting(io.BytesIO):
        taken = 0
        def read(self, n=-1):
            Counting.taken += n
            return super().read(n)
    with io.BytesIO() as made:
        with wave.open(made, "wb") as f:
            f.setparams((2, 2, 48000, 0, "NONE", ""))
            f.writeframes(bytes(4 * 100_000))
        content = made.getvalue()
    pushed = files.Pushed("block_no")
    assert len(list(pushed.take([GreaterThan(("block_no",), 97), GreaterThan(("block_no", "x"), 200), EqualTo(("other",), 1)]))) == 3
    rows = [r for b in wav.read_blocks("p", Counting(content), len(content), 1000, 0, len(content), pushed=pushed) for r in b.to_pylist()]
    assert [(r["block_no"], r["channel"]) for r in rows] == [(98, 0), (98, 1), (99, 0), (99, 1)] and Counting.taken < 8200


def test_blocks_of_a_listing(spark, tmp_path):
    raw = np.arange(4000, dtype="<i2").tobytes()
    for name in "ab":
        write_wav(tmp_path / f"{name}.wav", raw)
    (tmp_path / "empty.wav").write_bytes(b"")
    listed = spark.createDataFrame([(str(p), p.stat().st_size) for p in tmp_path.glob("*.wav")], "path string, length bigint")
    got = wav.blocks_of_files(listed, 16, split=1000, tasks=6)
    files.register(spark, wav.WavBlocks)
    want = spark.read.format("wav_blocks").option("path", str(tmp_path)).option("blockSamples", 16).load()
    key = lambda df: sorted(map(str, df.collect()))
    assert key(got) == key(want) and want.where("error IS NOT NULL").count() == 1
    assert len({r.p for r in got.select(F.spark_partition_id().alias("p")).collect()}) > 1
    assert wav.blocks_of_files(listed.limit(0), 16).count() == 0


def test_all_sample_descriptions(spark):
    entry = lambda code: struct.pack(">I", 16) + code + bytes(8)
    stsd = mp4_box("stsd", bytes(4) + struct.pack(">I", 3) + entry(b"tmcd") + entry(b"rtmd") + entry(b"djmd"))
    movie = mp4_box("moov", mp4_box("trak", mp4_box("mdia", mp4_box("minf", mp4_box("stbl", stsd)))))
    df = isobmff.boxes_from_content(spark.createDataFrame([("p", bytearray(movie)), ("q", bytearray(movie[:60]))], "path string, content binary"))
    assert df.where("type = 'stsd'").first().entry == "tmcd,rtmd,djmd"
    assert {r.path: r.data_entry for r in isobmff.container_facts(df).collect()} == {"p": "rtmd", "q": None}


def test_resumable_skips_finished(spark, tmp_path):
    (tmp_path / "in").mkdir()
    def feed(*names):
        spark.createDataFrame([(n,) for n in names], "source string").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    def run(checkpoint):
        src = spark.readStream.schema("source string").parquet(str(tmp_path / "in"))
        jobs.resumable(src, str(tmp_path / "done"), str(tmp_path / checkpoint), lambda df: df).awaitTermination()
    feed("a", "b", "a")
    run("cp1")
    feed("c")
    run("cp1")
    run("cp2")  # the checkpoint is lost: the finished table alone must prevent repeats
    assert sorted(r.source for r in spark.read.parquet(str(tmp_path / "done")).collect()) == ["a", "b", "c"]


def test_throughput_drops_late_rows(spark, tmp_path):
    rows = lambda *r: spark.createDataFrame(list(r), "t string, backend string, fps double").selectExpr("CAST(t AS TIMESTAMP) AS ts", "backend", "fps")
    batches = [rows(("2024-01-01 00:10:00", "a", 1.0), ("2024-01-01 00:50:00", "a", 2.0)), rows(("2024-01-01 09:00:00", "a", 4.0)),
               rows(("2024-01-01 00:20:00", "a", 100.0), ("2024-01-01 20:00:00", "a", 8.0))]  # the first of these is too late
    for number, batch in enumerate(batches):
        batch.coalesce(1).write.parquet(f"{tmp_path}/in/{number}")
        stream = spark.readStream.schema(batch.schema).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
        windows = jobs.throughput(stream, window="1 hour", slide="1 hour", late="1 hour")
        writer = windows.writeStream.outputMode("append").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True)
        writer.format("parquet").start(f"{tmp_path}/out").awaitTermination()
    got = spark.read.parquet(f"{tmp_path}/out").orderBy("window_start").collect()
    assert [(r.window_start.hour, r.n, r.fps_sum) for r in got] == [(0, 2, 3.0), (9, 1, 4.0)]


def test_all_events_are_in_their_windows(spark):
    n = spark.read.parquet("/root/testdata/sf0.001/events.parquet").count()
    rows = registry.QUERIES["str_03_all"](spark, "/root/testdata/sf0.001").collect()
    assert sum(r.n for r in rows) == 2 * n and len({(r.window_start, r.backend) for r in rows}) == len(rows)


def test_many_small_files_share_tasks(spark, tmp_path):
    """Tasks stay bounded however many files there are, and folders are listed where they are read."""
    write_wav(tmp_path / "0.wav", np.zeros((4, 1), np.int16), channels=1)
    raw = (tmp_path / "0.wav").read_bytes()
    for i in range(1, 3000):
        (tmp_path / f"{i}.wav").write_bytes(raw)
    files.register(spark, wav.WavBlocks, isobmff.MediaBoxes)
    rows = spark.read.format("wav_blocks").option("path", str(tmp_path)).load()
    assert rows.rdd.getNumPartitions() <= files.TASKS and rows.select("path").distinct().count() == 3000
    movies = tmp_path / "movies"
    for i in range(200):
        (movies / f"{i % 100}" / "deep").mkdir(parents=True, exist_ok=True)
        (movies / f"{i % 100}" / "deep" / f"{i}.mp4").write_bytes(b"\0\0\0\x08free")
    (movies / "top.mp4").write_bytes(b"\0\0\0\x08free")
    assert [len(found) for found in files.list_units(str(movies), (".mp4",))] == [1, 100]
    boxes = spark.read.format("isobmff_boxes").option("path", str(movies)).load()
    assert boxes.select("path").distinct().count() == 201
    one = boxes.where(F.col("path") == f"{movies}/7/deep/107.mp4")
    assert [r.type for r in one.collect()] == ["free"]
