"""The data source of sampled files: parts of long files, filters, every container, safe writing."""

import struct

import numpy as np
import pytest
from pyarrow import fs as arrow_fs
from pyspark.sql import functions as F

from sampleloom.sources import containers, files

FRAMES = "clip bigint, channel int, frame bigint, sample float"
EXACT = {("wav", "f32"), ("aiff", "f32"), ("au", "f64"), ("caf", "f32"), ("wav", "s32")}


def signal(n, channels, seed=1):
    return (np.random.default_rng(seed).random((n, channels)) * 1.9 - 0.95).astype(np.float32)


def as_frames(spark, clips):
    return spark.createDataFrame([(k, c, f, float(x[f, c])) for k, x in clips.items() for f in range(len(x)) for c in range(x.shape[1])], FRAMES)


def read_back(df):
    out = {}
    for r in df.orderBy("path", "frame", "channel").collect():
        out.setdefault(r.path.rsplit("/", 1)[1], []).append((r.frame, r.channel, r.sample))
    return out


@pytest.mark.parametrize("container, kind", [("wav", "u8"), ("wav", "s16"), ("wav", "f64"), ("aiff", "s24"), ("aiff", "f32"), ("au", "s32"), ("au", "f64"), ("caf", "s16"), ("caf", "f32")])
def test_written_folders_are_read_back_equal(spark, tmp_path, container, kind):
    clips = {1: signal(5, 1), 2: signal(777, 3), 30: signal(64, 2)}
    path = f"file://{tmp_path}/{container}"
    files.write_clips(as_frames(spark, clips), path, 8000, container, kind)
    assert sorted(p.name for p in (tmp_path / container).iterdir()) == sorted(f"{k}.{container}" for k in clips)
    for k, x in clips.items():
        data = (tmp_path / container / f"{k}.{container}").read_bytes()
        assert data == containers.encode(x, 8000, container, kind)
    df = files.read_frames(spark, path, splitBytes="200")
    assert {r.rate for r in df.select("rate").distinct().collect()} == {8000}
    got = read_back(df)
    for k, x in clips.items():
        want = containers.decode(containers.encode(x, 8000, container, kind))[0]
        assert got[f"{k}.{container}"] == [(f, c, want[f, c]) for f in range(len(x)) for c in range(x.shape[1])]


def test_a_long_file_is_the_work_of_many_tasks_and_filters_reach_it(spark, tmp_path):
    n = 300_000
    x = signal(n, 2)
    (tmp_path / "a.wav").write_bytes(containers.encode(x, 48_000, "wav", "s16"))
    df = files.read_frames(spark, str(tmp_path), splitBytes="100000", openBytes="0")
    assert df.rdd.getNumPartitions() == 13
    assert files.read_frames(spark, str(tmp_path)).rdd.getNumPartitions() == 1
    assert df.count() == 2 * n
    some = df.where("frame >= 123456 and frame < 123460 and channel = 1")
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert "123456" not in plan  # only null checks are left above the source
    want = containers.decode((tmp_path / "a.wav").read_bytes())[0]
    assert [(r.frame, r.channel, r.sample) for r in some.orderBy("frame").collect()] == [(f, 1, want[f, 1]) for f in range(123_456, 123_460)]
    assert files.read_frames(spark, str(tmp_path), channel="1").agg(F.min("channel"), F.count(F.lit(1))).first() == (1, n)
    assert df.where("path = 'none'").count() == 0 and df.where("channel = 7").count() == 0
    assert df.where("channel in (0, 1) and sample > 0").count() == int((want > 0).sum())


def test_heads_are_enough_for_the_layout(tmp_path):
    """Only heads are read, so a file's length does not matter to its listing."""
    x, touched = signal(50_000, 2), []
    for box, kind in (("wav", "s16"), ("aiff", "s24"), ("au", "s16"), ("caf", "f32")):
        data = containers.encode(x, 8000, box, kind)

        def read(at, n, data=data):
            touched.append(n)
            return data[at : at + n]

        found = files.layout(read, len(data))
        assert (found.frames, found.channels, found.rate, found.kind) == (50_000, 2, 8000, kind)
        assert np.array_equal(found.samples(lambda a, n, data=data: data[a : a + n], 17, 40), containers.decode(data)[0][17:40])
    assert max(touched) < 100


def test_several_data_chunks_and_wide_sizes():
    x = signal(100, 1)
    body = containers.to_pcm(x, "s16")
    fmt = b"fmt " + struct.pack("<IHHIIHH", 16, 1, 1, 8000, 16000, 2, 16)
    chunk = lambda name, b, size=None: name + struct.pack("<I", len(b) if size is None else size) + b + bytes(len(b) % 2)
    parted = fmt + chunk(b"data", body[:61]) + chunk(b"odd ", b"abc") + chunk(b"data", body[61:])
    parted = b"RIFF" + struct.pack("<I", 4 + len(parted)) + b"WAVE" + parted
    wide = b"RF64" + struct.pack("<I", 0xFFFFFFFF) + b"WAVE" + chunk(b"ds64", struct.pack("<QQQI", 0, len(body), 100, 0)) + fmt + chunk(b"data", body, 0xFFFFFFFF)
    for data in (parted, wide):
        found = files.layout(lambda a, n, data=data: data[a : a + n], len(data))
        assert found.frames == 100
        assert np.array_equal(np.concatenate([found.samples(lambda a, n, data=data: data[a : a + n], a, e) for a, e in ((0, 30), (30, 31), (31, 100))]), containers.decode(data)[0])
    head = containers.head(1 << 31, 2, 48_000, "wav", "s16")
    assert head[:4] == b"RF64" and struct.unpack_from("<Q", head, 12 + 8 + 8)[0] == 1 << 33
    for bad in (b"", b"RIFF", b"OggS" + bytes(40), containers.encode(x, 8000, "wav", "s16")[:30], parted[:20]):
        with pytest.raises(ValueError):
            files.layout(lambda a, n, bad=bad: bad[a : a + n], len(bad))


def test_files_without_heads_and_companded_ones(spark, tmp_path):
    x = signal(100, 2)
    (tmp_path / "a.raw").write_bytes(containers.to_pcm(x, "s24"))
    got = files.read_frames(spark, f"{tmp_path}/a.raw", kind="s24", channels="2", rate="100", splitBytes="64").orderBy("frame", "channel").collect()
    assert np.array_equal([r["sample"] for r in got], containers.from_pcm(containers.to_pcm(x, "s24"), "s24", 2).ravel())
    au = b".snd" + struct.pack(">IIIII", 24, 256, 1, 8000, 1) + bytes(range(256))
    found = files.layout(lambda a, n: au[a : a + n], len(au))
    assert np.array_equal(found.samples(lambda a, n: au[a : a + n], 0, 256).ravel(), (containers.companded("ulaw") / 32768).astype(np.float32))


def test_bad_clips_leave_no_files(spark, tmp_path):
    good = as_frames(spark, {1: signal(20, 2)})
    path = f"file://{tmp_path}/out"
    for bad in (good.where("frame <> 3"), good.unionByName(good.where("frame = 3")), good.where("not (frame = 3 and channel = 1)")):
        with pytest.raises(Exception, match="missing|other frames"):
            files.write_clips(bad, path, 8000)
        assert not (tmp_path / "out").exists() or list((tmp_path / "out").iterdir()) == []
    files.write_clips(good, path, 8000)
    files.write_clips(as_frames(spark, {2: signal(3, 1)}), path, 8000)
    assert sorted(p.name for p in (tmp_path / "out").iterdir()) == ["1.wav", "2.wav"]
    files.write_clips(as_frames(spark, {3: signal(3, 1)}), path, 8000, mode="overwrite")
    assert [p.name for p in (tmp_path / "out").iterdir()] == ["3.wav"]
    files.write_clips(good.limit(0), path, 8000, mode="overwrite")
    assert list((tmp_path / "out").iterdir()) == [] and files.read_frames(spark, path).count() == 0
    assert arrow_fs.LocalFileSystem().get_file_info(f"{tmp_path}/out").type == arrow_fs.FileType.Directory


def test_coded_aiff_files():
    body = bytes(range(256))
    for coding, kind in ((b"ulaw", "ulaw"), (b"ALAW", "alaw")):
        comm = struct.pack(">hIh", 2, 128, 16) + containers._extended(8000) + coding + b"\x00\x00"
        chunks = b"COMM" + struct.pack(">I", len(comm)) + comm + b"SSND" + struct.pack(">III", 8 + 5 + 256, 5, 0) + b"?" * 5 + body + b"\x00"
        data = b"FORM" + struct.pack(">I", 4 + len(chunks)) + b"AIFC" + chunks
        x, rate, said = containers.decode(data)
        want = (containers.companded(kind) / 32768).astype(np.float32).reshape(-1, 2)
        assert np.array_equal(x, want) and (rate, said) == (8000, kind)
        found = files.layout(lambda a, n, data=data: data[a : a + n], len(data))
        assert found.frames == 128 and np.array_equal(found.samples(lambda a, n, data=data: data[a : a + n], 3, 9), want[3:9])
    x = signal(40, 2)
    comm = struct.pack(">hIh", 2, 40, 64) + containers._extended(8000) + b"fl64\x00\x00"
    chunks = b"COMM" + struct.pack(">I", len(comm)) + comm + b"SSND" + struct.pack(">III", 8 + 640, 0, 0) + x.astype(">f8").tobytes()
    data = b"FORM" + struct.pack(">I", 4 + len(chunks)) + b"AIFC" + chunks
    assert np.array_equal(containers.decode(data)[0], x) and containers.decode(data)[2] == "f64"
    coded = containers.encode(x, 8000, "wav", "f32")
    assert b"fact" + struct.pack("<II", 4, 40) in coded and np.array_equal(containers.decode(coded)[0], x)


def test_other_numbers_of_channels_are_an_error(spark):
    from sampleloom.operators import shape

    one, two = as_frames(spark, {1: signal(20, 1), 2: signal(20, 2)}), as_frames(spark, {1: signal(20, 2), 2: signal(20, 2)})
    for made in (shape.mix(one, two, 0, 1.0, False), shape.mix(one, two, 0, 1.0, True), shape.crossfade(one, two, 4)):
        with pytest.raises(Exception, match="clip 1 has 1 channels, but 2"):
            made.collect()
    assert shape.mix(one.where("clip = 2"), two, 0, 1.0, False).count() == 40
