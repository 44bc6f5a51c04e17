"""Binary sinks: what is read back equals what was written, in order, whatever the number of tasks."""

import numpy as np
import pytest

from cairn.sources import png, readers, sinks


@pytest.fixture(autouse=True)
def many_tasks(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


@pytest.fixture
def triangles(spark):
    rng = np.random.default_rng(5)
    rows = [(i, *map(float, rng.integers(-50, 50, 9))) for i in range(57)]
    rng.shuffle(rows)
    names = [f"{k}{i}" for i in range(3) for k in "xyz"]
    df = spark.createDataFrame([(int(r[0]), *map(float, r[1:])) for r in rows], "t long, " + ", ".join(f"{n} double" for n in names)).repartition(5)
    return df, np.array(sorted(rows, key=lambda r: r[0]))[:, 1:].reshape(-1, 3)


def parts(path):
    return sorted(p.name for p in path.iterdir() if not p.name.startswith("."))


def split(data, end):
    at = data.index(end) + len(end)
    return data[:at].decode(), data[at:]


def test_ply_mesh(spark, tmp_path, triangles):
    df, corners = triangles
    sinks.save_mesh(df, str(tmp_path / "m"), ["t"])
    head, body = split(sinks.read_back(str(tmp_path / "m")), b"end_header\n")
    assert "element vertex 171" in head and "element face 57" in head
    assert (np.frombuffer(body, "<f4", 171 * 3).reshape(-1, 3) == corners).all()
    faces = np.frombuffer(body, np.dtype([("n", "u1"), ("v", "<i4", 3)]), offset=171 * 12)
    assert (faces["n"] == 3).all() and (faces["v"].ravel() == np.arange(171)).all()
    assert len([n for n in parts(tmp_path / "m") if n.startswith("1-")]) > 1  # several tasks wrote
    sinks.save_mesh(df.limit(2), str(tmp_path / "m"), ["t"])  # again: nothing old stays
    assert b"element face 2\n" in sinks.read_back(str(tmp_path / "m"))


def test_vtk_and_obj_meshes(spark, tmp_path, triangles):
    df, corners = triangles
    sinks.save_mesh(df, str(tmp_path / "v"), ["t"], "vtk")
    head, body = split(sinks.read_back(str(tmp_path / "v")), b"POINTS 171 float\n")
    assert "POLYDATA" in head and (np.frombuffer(body, ">f4", 513).reshape(-1, 3) == corners).all()
    middle, faces = split(body[513 * 4 :], b"POLYGONS 57 228\n")
    assert middle.startswith("\n") and (np.frombuffer(faces, ">i4").reshape(-1, 4)[:, 1:].ravel() == np.arange(171)).all()
    sinks.save_mesh(df, str(tmp_path / "o"), ["t"], "obj")
    lines = sinks.read_back(str(tmp_path / "o")).decode().splitlines()
    assert (np.array([x.split()[1:] for x in lines if x[0] == "v"], float) == corners).all() and lines[-1] == "f 169 170 171"
    with pytest.raises(ValueError):
        sinks.save_mesh(df, str(tmp_path / "x"), ["t"], "stl")


def test_clouds_rays_structure(spark, tmp_path, triangles):
    df, corners = triangles
    points = df.selectExpr("t", "x0 x", "y0 y", "z0 z")
    sinks.save_cloud(points, str(tmp_path / "c"), ["t"])
    head, body = split(sinks.read_back(str(tmp_path / "c")), b"end_header\n")
    assert "element vertex 57" in head and (np.frombuffer(body, "<f4").reshape(-1, 3) == corners[::3]).all()
    sinks.save_cloud(points, str(tmp_path / "p"), ["t"], "pcd", width=19, height=3)
    (tmp_path / "one").mkdir()
    (tmp_path / "one" / "cloud.pcd").write_bytes(sinks.read_back(str(tmp_path / "p")))
    scan = readers.open_sequence("newercollege", spark, str(tmp_path / "one"), width=19, height=3).first()
    assert np.allclose(scan["depth"], np.sqrt((corners[::3] ** 2).sum(1)))
    sinks.save_rays(df.selectExpr("t", "x0 ox", "y0 oy", "z0 oz", "x1 px", "y1 py", "z1 pz"), str(tmp_path / "r"), ["t"])
    head, body = split(sinks.read_back(str(tmp_path / "r")), b"end_header\n")
    assert "element edge 57" in head and (np.frombuffer(body, "<i4", offset=114 * 12) == np.arange(114)).all()
    boxes = spark.createDataFrame([(0, 0, 0, 8), (8, 0, 0, 4)], "x long, y long, z long, size long")
    sinks.save_structure(boxes, str(tmp_path / "s"), ["x"])
    head, body = split(sinks.read_back(str(tmp_path / "s")), b"end_header\n")
    corner = np.frombuffer(body, "<f4", 48).reshape(2, 8, 3)
    assert "element vertex 16" in head and "element face 12" in head and corner[1].min(0).tolist() == [8, 0, 0] and corner[1].max(0).tolist() == [12, 4, 4]


def test_slice_and_objects(spark, tmp_path, triangles):
    voxels = spark.createDataFrame([(x, y, 3, float(x + 10 * y)) for x in range(4) for y in range(3) if (x, y) != (2, 1)], "x long, y long, z long, value double")
    sinks.save_slice(voxels, str(tmp_path / "g"), (0, 0, 3), (4, 3, 4), 0.5, unknown=-1.0)
    head, body = split(sinks.read_back(str(tmp_path / "g")), b"LOOKUP_TABLE default\n")
    want = np.array([[x + 10 * y for x in range(4)] for y in range(3)], float)
    want[1, 2] = -1
    assert "DIMENSIONS 4 3 1" in head and (np.frombuffer(body, ">f4").reshape(3, 4) == want).all()
    df, corners = triangles
    assert sinks.save_object_meshes(df.selectExpr("*", "t % 3 AS object"), str(tmp_path / "all"), "object", ["t"]) == [0, 1, 2]
    assert b"element face 19\n" in sinks.read_back(str(tmp_path / "all" / "object-1"))
    shifted = sinks.moved(df, (0, 0, 2**-0.5, 2**-0.5), (1, 2, 3), 2.0).orderBy("t").first()  # a quarter turn about z
    x, y, z = corners[0]
    assert [shifted["x0"], shifted["y0"], shifted["z0"]] == pytest.approx([1 - 2 * y, 2 + 2 * x, 3 + 2 * z])


@pytest.mark.parametrize("kind", ["pgm", "png"])
def test_images(spark, tmp_path, kind):
    depth = [[float(i * k) / 1000 for i in range(12)] for k in (1, 100)]
    images = spark.createDataFrame([(f"f{k}", 4, 3, d) for k, d in enumerate(depth)], "name string, width int, height int, depth array<double>")
    assert sinks.save_images(images, str(tmp_path / "i"), kind).count() == 2
    if kind == "pgm":
        got = {r["path"].rsplit("/", 1)[1]: r["depth"] for r in readers.read_pgm(spark, str(tmp_path / "i")).collect()}
        assert [got[f"f{k}.pgm"] for k in range(2)] == [pytest.approx(d) for d in depth]
    else:
        assert (png.decode((tmp_path / "i" / "f1.png").read_bytes()).ravel() == np.arange(12) * 100).all()
