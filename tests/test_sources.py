import io

import numpy as np
import pytest

from cairn.sources import readers, writers


def test_poses(spark, tmp_path):
    (tmp_path / "p.txt").write_text("# comment\n1.5 1 2 3 0 0 0 1\nx 4 5 6 0 0 1 0\n1 2 3\n2.5 1 2 3 0 0 0 2\n")
    got = readers.read_poses(spark, str(tmp_path / "p.txt")).collect()
    assert [(r["line"], r["time"], r["tx"]) for r in got] == [(0, 1.5, 1.0), (1, None, 4.0)]


def test_raw_frames(spark, tmp_path):
    w, h = 8, 4
    data = b"".join(np.array([w, h], "<u4").tobytes() + (1000 * (f + np.arange(w * h))).astype("<u2").tobytes() + np.array([w, h], "<u4").tobytes() + bytes(range(96)) for f in range(2))
    (tmp_path / "s.raw").write_bytes(data)
    frames = readers.read_raw_frames(spark, str(tmp_path / "s.raw"), w, h)
    got = {r["frame"]: r for r in frames.collect()}
    assert len(got) == 2 and got[1]["depth"][3] == 4.0 and len(got[0]["rgb"]) == 96
    assert readers.pixels(frames, w).where("frame = 1 and u = 3 and v = 2").first()["depth"] == 20.0


def test_masks_confidences_images(spark, tmp_path):
    a = np.zeros((2, 3, 4), np.uint8)
    a[1, 2, 3] = a[0, 0, 0] = 1
    (tmp_path / "m").mkdir()
    np.save(tmp_path / "m" / "a.npy", a)
    assert {(r["det_id"], r["u"], r["v"]) for r in readers.read_masks(spark, str(tmp_path / "m")).collect()} == {(0, 0, 0), (1, 3, 2)}
    (tmp_path / "c").mkdir()
    np.save(tmp_path / "c" / "c.npy", np.array([[0.1, 0.9]], np.float32))
    assert readers.read_confidences(spark, str(tmp_path / "c")).first()["conf"][1] == pytest.approx(0.9)
    (tmp_path / "i").mkdir()
    (tmp_path / "i" / "x.pgm").write_text("P2\n# c\n2 1\n65535\n1000 500\n")
    assert readers.open_sequence("pgm", spark, str(tmp_path / "i")).first()["depth"] == [1.0, 0.5]
    with pytest.raises(ValueError):
        readers.open_sequence("nothing", spark, "")


def test_results(spark, tmp_path):
    (tmp_path / "r.tsv").write_text("junk\nframe\ta\tb\n0\t1\t2\n1\t3\t4\n")
    assert [(r["frame"], r["b"]) for r in readers.read_results(spark, str(tmp_path / "r.tsv")).orderBy("frame").collect()] == [(0.0, 2.0), (1.0, 4.0)]


def test_writers(spark, tmp_path):
    points = spark.createDataFrame([(1, 0.5, 1.0, 2.0), (0, 1.5, 2.0, 3.0)], "i int, px double, py double, pz double")
    writers.save_lines(writers.ply_points(points, ["i"]), str(tmp_path / "ply"))
    lines = "".join(p.read_text() for p in sorted((tmp_path / "ply").glob("part-*"))).splitlines()
    assert lines[0] == "ply" and lines[2] == "element vertex 2" and lines[-2:] == ["1.5 2.0 3.0", "0.5 1.0 2.0"]
    triangle = spark.createDataFrame([(0, v, float(v), 0.0, 1.0) for v in range(3)], "t int, vertex int, vx double, vy double, vz double")
    assert [r["line"] for r in writers.obj_mesh(triangle, ["t"]).orderBy("part", "at").collect()][-1] == "f 1 2 3"
    voxels = spark.createDataFrame([(0, 0, 0, -1.0), (0, 0, 1, 0.0), (1, 0, 0, 2.0)], "x long, y long, z long, value double")
    assert {r["occupied"] for r in writers.occupancy(voxels).collect()} == {True, False} and writers.occupancy(voxels, True).count() == 2
    octants = spark.createDataFrame([(0, None), (1, 0)], "key long, parent long")
    assert writers.dot_graph(octants, octants["key"]).count() == 5
