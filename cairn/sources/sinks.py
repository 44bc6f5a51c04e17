"""Binary files of clouds, meshes, octrees, slices and images: each task writes its own part, and the commit writes the header.

A target is a folder whose parts, one after another by name, are the file (`read_back` joins them; `cat 0-* 1-*` does). Parts begin at
the number of their first row, so indices in them are right from the start and no task waits for another.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from . import png
from .scratch import Scratch
from .sequences import _filesystem


def numbered(df: DataFrame, order: list[str], scratch: Scratch, label: str = "numbered") -> DataFrame:
    """Adds n, the number of each row in an order: rows are sorted by ranges, and the sizes of the ranges (one number for each task) give where each begins."""
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__part", F.spark_partition_id()).withColumn("__at", F.monotonically_increasing_id())
    ranged = scratch.save(ranged, label)
    starts, upto = [], 0
    for r in ranged.groupBy("__part").agg(F.count("*").alias("c"), F.min("__at").alias("first")).orderBy("__part").collect():
        starts.append((r["__part"], upto - r["first"]))
        upto += r["c"]
    starts = df.sparkSession.createDataFrame(starts, "__part int, __shift long")
    return ranged.join(F.broadcast(starts), "__part").withColumn("n", F.col("__at") + F.col("__shift")).drop("__part", "__at", "__shift")


@dataclass
class _Parts(WriterCommitMessage):
    rows: int
    names: list[str]


class _Writer(DataSourceWriter):
    def __init__(self, options: dict):
        self.path, self.kind, self.section = options["path"].rstrip("/"), options["kind"], options.get("section", "1")
        self.extra = json.loads(options.get("extra", "{}"))

    def write(self, iterator) -> _Parts:
        """A part for each run of consecutive rows, as a task may read several ranges; a few MB are held at once."""
        from pyspark import TaskContext

        attempt, done, names, out, last, held = TaskContext.get().taskAttemptId(), 0, [], None, None, []
        system, path = _filesystem(self.path)
        system.create_dir(path, recursive=True)
        try:
            for row in iterator:
                if out is None or row["n"] != last + 1:
                    if out is not None:
                        out.write(b"".join(held))
                        out.close()
                    held = []
                    names.append(f"{self.section}-{row['n']:020d}-{attempt}")  # attempts write apart, and only those committed get their name
                    out = system.open_output_stream(f"{path}/_{names[-1]}")
                last, done = row["n"], done + 1
                held.append(_BODIES[self.kind](row))
                if len(held) >= 65536:
                    out.write(b"".join(held))
                    held = []
        finally:
            if out is not None:
                out.write(b"".join(held))
                out.close()
        return _Parts(done, names)

    def commit(self, messages) -> None:
        parts = [m for m in messages if m is not None]
        system, path = _filesystem(self.path)
        system.create_dir(path, recursive=True)
        for name in (n for m in parts for n in m.names):
            system.move(f"{path}/_{name}", f"{path}/{name}")
        if self.kind in _HEADS:
            with system.open_output_stream(f"{path}/0-head") as f:
                f.write(_HEADS[self.kind](sum(m.rows for m in parts), self.extra).encode())

    def abort(self, messages) -> None:
        system, path = _filesystem(self.path)
        for name in (n for m in messages if m is not None for n in m.names):
            try:
                system.delete_file(f"{path}/_{name}")
            except FileNotFoundError:
                pass


class Sink(DataSource):
    """Format cairn_sink, which the functions below use."""

    @classmethod
    def name(cls) -> str:
        return "cairn_sink"

    def writer(self, schema, overwrite: bool):
        return _Writer({k.lower(): v for k, v in self.options.items()})


_floats = lambda *x: np.array(x, "<f4").tobytes()
_big = lambda *x: np.array(x, ">f4").tobytes()
_CORNERS = [f"{k}{i}" for i in range(3) for k in "xyz"]
_BODIES = {
    "ply_points": lambda r: _floats(r["x"], r["y"], r["z"]),
    "ply_mesh": lambda r: _floats(*[r[c] for c in _CORNERS]),
    "ply_faces": lambda r: b"\x03" + np.array([3 * r["n"], 3 * r["n"] + 1, 3 * r["n"] + 2], "<i4").tobytes(),
    "ply_rays": lambda r: _floats(r["ox"], r["oy"], r["oz"], r["px"], r["py"], r["pz"]),
    "ply_edges": lambda r: np.array([2 * r["n"], 2 * r["n"] + 1], "<i4").tobytes(),
    "ply_boxes": lambda r: b"".join(_floats(*[r[k] + r["size"] * (i >> j & 1) for j, k in enumerate("xyz")]) for i in range(8)),
    "ply_box_faces": lambda r: b"".join(b"\x04" + (np.array(f, "<i4") + np.int32(8 * r["n"])).tobytes() for f in ((0, 2, 3, 1), (4, 5, 7, 6), (0, 1, 5, 4), (2, 6, 7, 3), (0, 4, 6, 2), (1, 3, 7, 5))),
    "pcd_points": lambda r: _floats(r["x"], r["y"], r["z"]),
    "vtk_mesh": lambda r: _big(*[r[c] for c in _CORNERS]),
    "vtk_faces": lambda r: np.array([3, 3 * r["n"], 3 * r["n"] + 1, 3 * r["n"] + 2], ">i4").tobytes(),
    "vtk_grid": lambda r: _big(r["value"]),
    "obj_mesh": lambda r: "".join(f"v {r[f'x{i}']!r} {r[f'y{i}']!r} {r[f'z{i}']!r}\n" for i in range(3)).encode(),
    "obj_faces": lambda r: f"f {3 * r['n'] + 1} {3 * r['n'] + 2} {3 * r['n'] + 3}\n".encode(),
}
_XYZ = "property float x\nproperty float y\nproperty float z\n"
_PLY = "ply\nformat binary_little_endian 1.0\n"
_HEADS = {
    "ply_points": lambda n, _: f"{_PLY}element vertex {n}\n{_XYZ}end_header\n",
    "ply_mesh": lambda n, _: f"{_PLY}element vertex {3 * n}\n{_XYZ}element face {n}\nproperty list uchar int vertex_indices\nend_header\n",
    "ply_rays": lambda n, _: f"{_PLY}element vertex {2 * n}\n{_XYZ}element edge {n}\nproperty int vertex1\nproperty int vertex2\nend_header\n",
    "ply_boxes": lambda n, _: f"{_PLY}element vertex {8 * n}\n{_XYZ}element face {6 * n}\nproperty list uchar int vertex_indices\nend_header\n",
    "pcd_points": lambda n, x: f"VERSION .7\nFIELDS x y z\nSIZE 4 4 4\nTYPE F F F\nCOUNT 1 1 1\nWIDTH {x.get('width', n)}\nHEIGHT {x.get('height', 1)}\nVIEWPOINT {x.get('viewpoint', '0 0 0 1 0 0 0')}\nPOINTS {n}\nDATA binary\n",
    "vtk_mesh": lambda n, _: f"# vtk DataFile Version 3.0\nmesh\nBINARY\nDATASET POLYDATA\nPOINTS {3 * n} float\n",
    "vtk_faces": lambda n, _: f"\nPOLYGONS {n} {4 * n}\n",
    "vtk_grid": lambda n, x: f"# vtk DataFile Version 3.0\nslice\nBINARY\nDATASET STRUCTURED_POINTS\nDIMENSIONS {x['size'][0]} {x['size'][1]} {x['size'][2]}\nORIGIN {x['origin'][0]} {x['origin'][1]} {x['origin'][2]}\nSPACING {x['step']} {x['step']} {x['step']}\nPOINT_DATA {n}\nSCALARS {x['name']} float 1\nLOOKUP_TABLE default\n",
}


def _save(df: DataFrame, path: str, kind: str, section: str = "1", **extra) -> None:
    df.sparkSession.dataSource.register(Sink)
    df.write.format("cairn_sink").mode("append").option("path", path).option("kind", kind).option("section", section).option("extra", json.dumps(extra)).save()


def _fresh(df: DataFrame, path: str, order: list[str]) -> DataFrame:
    """Empties the target, and numbers the rows."""
    system, at = _filesystem(path)
    system.create_dir(at, recursive=True)
    system.delete_dir_contents(at)
    return numbered(df, order, Scratch(df.sparkSession, "sink"))


def save_cloud(points: DataFrame, path: str, order: list[str], kind: str = "ply", **extra) -> None:
    """Points x, y, z as a PLY or PCD (kind) of floats. An organised PCD has width and height, and a row for each pixel."""
    _save(_fresh(points, path, order), path, f"{kind}_points", **extra)


def moved(triangles: DataFrame, q: tuple, t: tuple, scale: float = 1.0) -> DataFrame:
    """Triangles with corners scaled, turned by a unit quaternion (x, y, z, w) and shifted."""
    from ..functions.geometry import transform

    out = {}
    for i in range(3):
        p = transform([F.lit(float(c)) for c in q], [F.lit(float(c)) for c in t], [F.col(f"{k}{i}") * scale for k in "xyz"])
        out |= {f"{k}{i}": c for k, c in zip("xyz", p)}
    return triangles.withColumns(out)


def save_mesh(triangles: DataFrame, path: str, order: list[str], kind: str = "ply") -> None:
    """Triangles x0, y0, z0 .. z2 as a PLY, VTK or OBJ (kind): all corners, then the faces that number them. Two parallel passes over numbered rows."""
    if kind not in ("ply", "vtk", "obj"):
        raise ValueError(f"no meshes are written as {kind}; there are ply, vtk and obj")
    rows = _fresh(triangles, path, order)
    _save(rows, path, f"{kind}_mesh")
    if kind == "vtk":  # faces have a head of their own, between the sections
        system, at = _filesystem(path)
        system.move(f"{at}/0-head", f"{at}/0-start")
        _save(rows.select("n"), path, "vtk_faces", "3")
        system.move(f"{at}/0-head", f"{at}/2-head")
        system.move(f"{at}/0-start", f"{at}/0-head")
    else:
        _save(rows.select("n"), path, f"{kind}_faces", "2")


def save_object_meshes(triangles: DataFrame, path: str, object_col: str, order: list[str], kind: str = "ply") -> list:
    """One mesh for each object, in a folder of its name. The objects' ids, which are as many as there are meshes to write."""
    ids = [r[0] for r in triangles.select(object_col).distinct().orderBy(object_col).toLocalIterator()]
    for i in ids:
        save_mesh(triangles.where(F.col(object_col) == i).drop(object_col), f"{path.rstrip('/')}/{object_col}-{i}", order, kind)
    return ids


def save_rays(rays: DataFrame, path: str, order: list[str]) -> None:
    """Rays from ox, oy, oz to px, py, pz as a PLY of edges."""
    rows = _fresh(rays, path, order)
    _save(rows, path, "ply_rays")
    _save(rows.select("n"), path, "ply_edges", "2")


def save_structure(octants: DataFrame, path: str, order: list[str]) -> None:
    """Octants x, y, z, size as a PLY of boxes."""
    rows = _fresh(octants, path, order)
    _save(rows, path, "ply_boxes")
    _save(rows.select("n"), path, "ply_box_faces", "2")


def save_slice(voxels: DataFrame, path: str, low: tuple, high: tuple, step: float = 1.0, value: str = "value", unknown: float = 0.0) -> None:
    """Values of the voxels from low to high (high excluded) as a VTK grid, x fastest; voxels that aren't there have the value of unknown ones. A threshold slice is one whose z range is a single layer."""
    size = [h - a for a, h in zip(low, high)]
    n = size[0] * size[1] * size[2]
    grid = voxels.sparkSession.range(n).select(*[(F.lit(a) + F.floor(F.col("id") / d) % s).cast("long").alias(k) for k, a, d, s in zip("xyz", low, (1, size[0], size[0] * size[1]), size)])
    full = grid.join(voxels.select("x", "y", "z", F.col(value).cast("double").alias("value")), ["x", "y", "z"], "left").fillna(unknown, ["value"])
    _save(_fresh(full, path, ["z", "y", "x"]), path, "vtk_grid", size=size, origin=list(low), step=step, name=value)


def save_images(images: DataFrame, path: str, kind: str = "pgm", scale: float = 1000.0) -> DataFrame:
    """Depth images (name, width, height, depth, row by row) as 16-bit PGM or PNG files path/name.kind; (name, bytes) of what was written. Each task writes its own."""
    def run(batches):
        system, at = _filesystem(path)
        system.create_dir(at, recursive=True)
        for pdf in batches:
            out = []
            for name, w, h, depth in zip(pdf["name"], pdf["width"], pdf["height"], pdf["depth"]):
                a = np.clip(np.rint(np.asarray(depth, float) * scale), 0, 65535).astype(">u2").reshape(h, w)
                data = f"P5\n{w} {h}\n65535\n".encode() + a.tobytes() if kind == "pgm" else png.encode(a.astype(np.uint16))
                with system.open_output_stream(f"{at}/{name}.{kind}") as f:
                    f.write(data)
                out.append(len(data))
            yield pdf[["name"]].assign(bytes=out)

    scratch = Scratch(images.sparkSession, "images")
    return scratch.save(images.select("name", "width", "height", "depth").mapInPandas(run, "name string, bytes long"), "written")


def read_back(path: str) -> bytes:
    """The file that a target's parts make, for small ones."""
    from pyarrow import fs

    system, at = _filesystem(path)
    names = sorted(f.path for f in system.get_file_info(fs.FileSelector(at)) if f.is_file and not f.base_name.startswith(("_", ".")))
    return b"".join(system.open_input_file(x).read() for x in names)
