"""Writing maps, clouds, meshes and paths. Text files are rows (part, at, line), sorted in parallel by part and then the numbers in at."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def save_lines(lines: DataFrame, path: str, files: int = 1) -> None:
    """Writes line in the order of (part, at), to consecutive files."""
    lines.repartitionByRange(files, "part", "at").sortWithinPartitions("part", "at").select(F.col("line").alias("value")).write.mode("overwrite").text(path)


def _head(spark, *lines: str) -> DataFrame:
    return spark.createDataFrame([(0, [float(i)], x) for i, x in enumerate(lines)], "part int, at array<double>, line string")


def _body(df: DataFrame, part: int, order: list[str], line) -> DataFrame:
    return df.select(F.lit(part).alias("part"), F.array(*[F.col(c).cast("double") for c in order]).alias("at"), line.alias("line"))


def _row(*columns):
    return F.concat_ws(" ", *[F.col(c).cast("string") for c in columns])


def ply_points(points: DataFrame, order: list[str]) -> DataFrame:
    """Cloud of px, py, pz."""
    head = _head(points.sparkSession, "ply", "format ascii 1.0", f"element vertex {points.count()}", "property float x", "property float y", "property float z", "end_header")
    return head.unionByName(_body(points, 1, order, _row("px", "py", "pz")))


def pcd_points(points: DataFrame, width: int, height: int, order: list[str], pose: tuple = (0, 0, 0, 1, 0, 0, 0)) -> DataFrame:
    """Organised cloud: every pixel, those without a point too."""
    head = _head(points.sparkSession, "VERSION .7", "FIELDS x y z", "SIZE 4 4 4", "TYPE F F F", "COUNT 1 1 1", f"WIDTH {width}", f"HEIGHT {height}", "VIEWPOINT " + " ".join(map(str, pose)), f"POINTS {width * height}", "DATA ascii")
    return head.unionByName(_body(points, 1, order, _row("px", "py", "pz")))


def obj_mesh(triangles: DataFrame, order: list[str]) -> DataFrame:
    """Triangles (order, vertex, vx, vy, vz): three vertices each, and a face of them."""
    corners = _body(triangles, 1, [*order, "vertex"], F.concat(F.lit("v "), _row("vx", "vy", "vz")))
    faces = triangles.sparkSession.range(1, triangles.where("vertex = 0").count() + 1).withColumnRenamed("id", "n")
    faces = faces.select(F.lit(2).alias("part"), F.array(F.col("n").cast("double")).alias("at"), F.concat_ws(" ", F.lit("f"), (3 * F.col("n") - 2).cast("string"), (3 * F.col("n") - 1).cast("string"), (3 * F.col("n")).cast("string")).alias("line"))
    return corners.unionByName(faces)


def occupancy(voxels: DataFrame, full: bool = False) -> DataFrame:
    """What an occupancy map takes from voxels (x, y, z, value): those that say something, with the value or just whether occupied."""
    said = voxels.where("value <> 0")
    return said.select("x", "y", "z", "value") if full else said.select("x", "y", "z", (F.col("value") > 0).alias("occupied"))


def dot_graph(octants: DataFrame, label) -> DataFrame:
    """Lines of a graph of octants (key, parent); label: a column."""
    head = _head(octants.sparkSession, "digraph octree {")
    nodes = _body(octants, 1, ["key"], F.concat(F.lit("  n"), F.col("key").cast("string"), F.lit(' [label="'), label.cast("string"), F.lit('"];')))
    links = _body(octants.where("parent is not null"), 2, ["key"], F.concat(F.lit("  n"), F.col("parent").cast("string"), F.lit(" -> n"), F.col("key").cast("string"), F.lit(";")))
    return head.unionByName(nodes).unionByName(links).unionByName(_head(octants.sparkSession, "}").withColumn("part", F.lit(3)))


def save_map(octants: DataFrame, path: str, map_col: str | None = None) -> None:
    """Parquet, one folder for each map if there are several."""
    writer = octants.write.mode("overwrite")
    (writer.partitionBy(map_col) if map_col else writer).parquet(path)


def save_path(poses: DataFrame, path: str) -> None:
    """Tab-separated tx ty tz qx qy qz qw."""
    from .readers import POSE

    poses.select(*POSE).write.mode("overwrite").option("sep", "\t").csv(path)
