"""Sequence sources: batch and stream give the same frames, a restart resumes, lists match by time; PNG round trips."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cairn.sources import png, readers, sequences

W, H = 8, 4


def raw(frames, start=0):
    size = np.array([W, H], "<u4").tobytes()
    return b"".join(size + (1000 * (f + np.arange(W * H))).astype("<u2").tobytes() + size + bytes((f + i) % 256 for i in range(3 * W * H)) for f in range(start, start + frames))


def rows(df):
    return sorted((r["sequence"].rsplit("/", 1)[1], r["frame"], tuple(r["depth"]), bytes(r["rgb"])) for r in df.collect())


def test_batch_of_many_sequences(spark, tmp_path):
    (tmp_path / "a.raw").write_bytes(raw(7))
    (tmp_path / "b.raw").write_bytes(raw(3, 10) + b"half a frame")
    df = sequences.read_raw_sequence(spark, str(tmp_path), W, H, framesPerPartition=2)
    assert df.rdd.getNumPartitions() == 6
    got = rows(df)
    assert [(n, f) for n, f, _, _ in got] == [("a.raw", k) for k in range(7)] + [("b.raw", k) for k in range(3)]
    assert got[8][2] == tuple(np.float32(11 + np.arange(W * H))) and got[8][3] == bytes((11 + i) % 256 for i in range(96))
    some = sequences.read_raw_sequence(spark, str(tmp_path / "a.raw"), W, H, first=1, rate=3)
    assert sorted(r["frame"] for r in some.select("frame").collect()) == [1, 4]
    (tmp_path / "bad").mkdir()
    (tmp_path / "bad" / "c.raw").write_bytes(raw(1)[8:] + raw(1)[:8])
    with pytest.raises(Exception, match="another size"):
        sequences.read_raw_sequence(spark, str(tmp_path / "bad"), W, H).collect()


def test_stream_resumes_and_equals_batch(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.raw").write_bytes(raw(5))

    def run():
        stream = sequences.read_raw_sequence(spark, str(tmp_path / "in"), W, H, stream=True, framesPerPartition=2)
        q = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        q.awaitTermination()

    run()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 5
    (tmp_path / "in" / "a.raw").write_bytes(raw(9))
    (tmp_path / "in" / "b.raw").write_bytes(raw(2, 4))
    run()
    assert rows(spark.read.parquet(str(tmp_path / "out"))) == rows(sequences.read_raw_sequence(spark, str(tmp_path / "in"), W, H))


def test_png(tmp_path):
    rng = np.random.default_rng(1)
    for shape, kind in (((5, 7), np.uint16), ((5, 7), np.uint8), ((4, 3, 3), np.uint8), ((4, 3, 4), np.uint8)):
        a = rng.integers(0, np.iinfo(kind).max, shape).astype(kind)
        assert (png.decode(png.encode(a)) == a).all()
    with pytest.raises(ValueError):
        png.decode(b"nothing")


@pytest.mark.parametrize("kind", range(5))
def test_png_filters(kind):
    import struct
    import zlib

    a = np.random.default_rng(2).integers(0, 256, (6, 5, 3)).astype(np.uint8)
    flat, out = a.reshape(6, 15).astype(int), []
    for y in range(6):
        line = []
        for i in range(15):
            left, up, corner = (flat[y, i - 3] if i >= 3 else 0), (flat[y - 1, i] if y else 0), (flat[y - 1, i - 3] if y and i >= 3 else 0)
            p = left + up - corner
            paeth = min((abs(p - left), 0, left), (abs(p - up), 1, up), (abs(p - corner), 2, corner))[2]
            line.append((flat[y, i] - (0, left, up, (left + up) // 2, paeth)[kind]) % 256)
        out.append(bytes([kind, *line]))
    chunk = lambda k, b: struct.pack(">I", len(b)) + k + b + struct.pack(">I", zlib.crc32(k + b))
    data = b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 5, 6, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(b"".join(out))) + chunk(b"IEND", b"")
    assert (png.decode(data) == a).all()


def test_tum_sequences(spark, tmp_path):
    rng = np.random.default_rng(3)
    for s in ("one", "two"):
        for d in ("depth", "rgb"):
            (tmp_path / s / d).mkdir(parents=True)
        depth = {t: rng.integers(0, 60_000, (H, W)).astype(np.uint16) for t in (1.0, 1.1, 1.2)}
        colour = {t: rng.integers(0, 256, (H, W, 3)).astype(np.uint8) for t in (1.015, 1.19)}
        for t, a in depth.items():
            (tmp_path / s / "depth" / f"{t}.png").write_bytes(png.encode(a))
        for t, a in colour.items():
            (tmp_path / s / "rgb" / f"{t}.png").write_bytes(png.encode(a))
        (tmp_path / s / "depth.txt").write_text("# depth\n" + "".join(f"{t} depth/{t}.png\n" for t in depth) + "1.3 depth/gone.png\n")
        (tmp_path / s / "rgb.txt").write_text("# colour\n" + "".join(f"{t} rgb/{t}.png\n" for t in colour))
        (tmp_path / s / "groundtruth.txt").write_text("# poses\n0.99 1 0 0 0 0 0 1\n1.005 2 0 0 0 0 0 1\n1.11 3 0 0 0 0 0 1\n")
    got = {(r["sequence"].rsplit("/", 1)[1], r["frame"]): r for r in readers.open_sequence("tum", spark, str(tmp_path)).collect()}
    assert sorted(got) == [(s, k) for s in ("one", "two") for k in range(4)]
    assert [got["two", k]["status"] for k in range(4)] == ["ok", "skip", "ok", "error"]
    assert [got["two", k]["tx"] for k in range(4)] == [2.0, 3.0, None, None]
    assert np.allclose(got["two", 2]["depth"], depth[1.2].ravel() / 5000) and bytes(got["two", 0]["rgb"]) == colour[1.015].tobytes()


def test_interiornet_and_scans(spark, tmp_path):
    a = np.arange(W * H, dtype=np.uint16).reshape(H, W)
    for d in ("depth0", "cam0"):
        (tmp_path / "s" / d / "data").mkdir(parents=True)
        (tmp_path / "s" / d / "data.csv").write_text("#timestamp [ns],filename\n2000000000,b.png\n1000000000,a.png\n")
        for k, n in enumerate("ab"):
            (tmp_path / "s" / d / "data" / f"{n}.png").write_bytes(png.encode(a + k if d == "depth0" else np.stack([a + k] * 3, 2).astype(np.uint8)))
    got = {r["frame"]: r for r in readers.open_sequence("interiornet", spark, str(tmp_path)).collect()}
    assert sorted(got) == [0, 1] and got[1]["time"] == 2.0 and np.allclose(got[1]["depth"], (a + 1).ravel() / 1000) and got[0]["status"] == "ok" and got[0]["rgb"][3] == 1
    (tmp_path / "p").mkdir()
    points = np.array([[3, 4, 0], [0, 0, 2], [np.nan, 0, 0], [1, 2, 2]], "<f4")
    head = "VERSION .7\nFIELDS x y z i\nSIZE 4 4 4 4\nTYPE F F F F\nCOUNT 1 1 1 1\nWIDTH 2\nHEIGHT 2\nVIEWPOINT 0 0 0 1 0 0 0\nPOINTS 4\nDATA "
    (tmp_path / "p" / "cloud_2.pcd").write_bytes(head.encode() + b"binary\n" + np.c_[points, np.zeros(4, "<f4")].astype("<f4").tobytes())
    (tmp_path / "p" / "cloud_1.pcd").write_text(head + "ascii\n" + "".join(f"{x} {y} {z} 0\n" for x, y, z in points))
    scans = {r["frame"]: r["depth"] for r in readers.open_sequence("newercollege", spark, str(tmp_path / "p"), width=2, height=2).collect()}
    assert scans == {0: [5.0, 2.0, 0.0, 3.0], 1: [5.0, 2.0, 0.0, 3.0]}


def test_status_and_segmentation(spark, tmp_path):
    s = spark.createDataFrame([("ok", "skip"), ("eof", "ok"), ("error", "eof")], "a string, b string")
    assert [r[0] for r in s.select(sequences.merge_status(F.col("a"), F.col("b"))).collect()] == ["skip", "eof", "error"]
    for d, a in (("m", np.ones((2, 1, 2), np.uint8)), ("c", np.array([4, 9])), ("p", np.array([[0.25, 0.75], [1, 0]]))):
        (tmp_path / d).mkdir()
        np.save(tmp_path / d / "f1.npy", a)
    pixels, told = readers.read_segmentation(spark, *[str(tmp_path / d) for d in "mcp"])
    assert pixels.count() == 4 and sorted((r["name"], r["det_id"], r["class_id"], r["conf"][0]) for r in told.collect()) == [("f1.npy", 0, 4, 0.25), ("f1.npy", 1, 9, 1.0)]
