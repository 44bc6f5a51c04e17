"""Whole sequences of frames as Spark data sources: many frames of many sequences at once, in batch or as a stream, and lists of images matched by time."""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from . import png
from .readers import POSE, _files

FRAME = "sequence string, frame long, depth array<float>, rgb binary"


def _filesystem(path: str):
    """The file system of a path or URI, and the path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


class _Frames:
    """Files of frames of one length, and how their frames are read from an offset."""

    def __init__(self, options: dict):
        self.path, self.width, self.height = options["path"], int(options["width"]), int(options["height"])
        self.each, self.first, self.rate = int(options.get("framesperpartition", 32)), int(options.get("first", 0)), int(options.get("rate", 1))
        self.length = 16 + 5 * self.width * self.height

    def counts(self) -> dict[str, int]:
        """Whole frames in each .raw file of a folder, or in one file; a frame that is still being written doesn't count."""
        from pyarrow import fs

        system, path = _filesystem(self.path)
        found = system.get_file_info(path)
        files = [found] if found.is_file else [f for f in system.get_file_info(fs.FileSelector(path, recursive=True)) if f.is_file and f.path.endswith(".raw")]
        return {f.path: f.size // self.length for f in sorted(files, key=lambda f: f.path)}

    def ranges(self, start: dict[str, int], stop: dict[str, int]) -> list[InputPartition]:
        """Partitions of a bounded number of frames."""
        return [_Range(name, k, min(k + self.each, n)) for name, n in sorted(stop.items()) for k in range(start.get(name, 0), n, self.each)]

    def read(self, part: _Range):
        """Batches of the frames of a partition: those from `first` on, each `rate`-th of them."""
        wanted = [k for k in range(part.start, part.stop) if k >= self.first and (k - self.first) % self.rate == 0]
        system, _ = _filesystem(self.path)
        n = self.width * self.height
        with system.open_input_file(part.name) as f:
            for k in wanted:
                f.seek(k * self.length)
                data = f.read(self.length)
                if any(tuple(np.frombuffer(data, "<u4", 2, at)) != (self.width, self.height) for at in (0, 8 + 2 * n)):
                    raise ValueError(f"frame {k} of {part.name} is of another size")
                depth = (np.frombuffer(data, "<u2", n, 8) / np.float32(1000)).astype(np.float32)
                yield pa.RecordBatch.from_arrays([pa.array([part.name]), pa.array([k]), pa.array([depth], pa.list_(pa.float32())), pa.array([data[16 + 2 * n :]], pa.binary())], ["sequence", "frame", "depth", "rgb"])


class _Range(InputPartition):
    def __init__(self, name: str, start: int, stop: int):
        self.name, self.start, self.stop = name, start, stop


class _Batch(DataSourceReader):
    def __init__(self, options: dict):
        self.frames = _Frames(options)

    def partitions(self):
        return self.frames.ranges({}, self.frames.counts())

    def read(self, partition):
        yield from self.frames.read(partition)


class _Stream(DataSourceStreamReader):
    """The offset of a stream is the number of frames taken of each file; it stands in Spark's checkpoint, so a restart resumes there."""

    def __init__(self, options: dict):
        self.frames = _Frames(options)

    def initialOffset(self) -> dict:
        return {"frames": "{}"}

    def latestOffset(self) -> dict:
        return {"frames": json.dumps(self.frames.counts(), sort_keys=True)}

    def partitions(self, start: dict, end: dict):
        return self.frames.ranges(json.loads(start["frames"]), json.loads(end["frames"])) or [_Range("", 0, 0)]

    def read(self, partition):
        if partition.name:
            yield from self.frames.read(partition)

    def commit(self, end: dict) -> None:
        pass


class RawFrames(DataSource):
    """Format cairn_raw: .raw files of frames of fixed length (two 32-bit sizes, 16-bit millimetres, the sizes, 3 bytes of colour a pixel).

    Options: path (a file or a folder, in any file system that pyarrow knows), width, height, framesPerPartition, first and rate
    (frames to take). Partitions are ranges of frames, read by seek; depth is in metres, row by row.
    """

    @classmethod
    def name(cls) -> str:
        return "cairn_raw"

    def schema(self) -> str:
        return FRAME

    def reader(self, schema):
        return _Batch({k.lower(): v for k, v in self.options.items()})

    def streamReader(self, schema):
        return _Stream({k.lower(): v for k, v in self.options.items()})


def read_raw_sequence(spark: SparkSession, path: str, width: int, height: int, stream: bool = False, **options) -> DataFrame:
    spark.dataSource.register(RawFrames)
    reader = (spark.readStream if stream else spark.read).format("cairn_raw")
    return reader.options(path=path, width=width, height=height, **options).load()


def merge_status(*columns):
    """Of several readers' states of a frame the worst: ok, skip, eof, error, from best to worst."""
    order = F.array(*map(F.lit, ("ok", "skip", "eof", "error")))
    return F.element_at(order, F.greatest(*[F.array_position(order, c) for c in columns]).cast("int"))


# ---- sequences of image files listed with their times


def _listed(spark: SparkSession, path: str, name: str, separator: str) -> DataFrame:
    """(sequence, time, file) of the lines of every list of that name under a path: a number and a file name."""
    lines = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", name).text(path).select("value", F.regexp_replace("_metadata.file_path", r"/[^/]*$", "").alias("sequence"))
    cells = F.split(F.trim("value"), separator)
    rows = lines.where(~F.trim("value").startswith("#")).select("sequence", cells.alias("c")).where(F.size("c") >= 2)
    return rows.select("sequence", F.element_at("c", 1).try_cast("double").alias("time"), F.trim(F.element_at("c", 2)).alias("file")).where("time is not null")


def nearest_in_time(left: DataFrame, right: DataFrame, columns: list[str], within: float) -> DataFrame:
    """Each row of left (sequence, time, ...) with the columns of the row of right nearest in time in its sequence (ties: the earlier), null beyond `within`.

    One sort by time in each sequence: every row sees the last of right before it and the first after it.
    """
    names = [F.col(c) for c in left.columns if c not in ("sequence", "time")]
    a = left.select("sequence", "time", F.struct(*names).alias("l"), F.lit(None).cast(right.select(F.struct("time", *columns).alias("r")).schema["r"].dataType).alias("r"))
    b = right.select("sequence", "time", F.lit(None).cast(a.schema["l"].dataType).alias("l"), F.struct("time", *columns).alias("r"))
    by_time = Window.partitionBy("sequence").orderBy("time")
    before = F.last("r", True).over(by_time.rangeBetween(Window.unboundedPreceding, 0))
    after = F.first("r", True).over(by_time.rangeBetween(0, Window.unboundedFollowing))
    both = a.unionByName(b).select("sequence", "time", "l", before.alias("p"), after.alias("n")).where("l is not null")
    nearer = F.when(F.col("n.time").isNull() | (F.col("time") - F.col("p.time") <= F.col("n.time") - F.col("time")), F.col("p")).otherwise(F.col("n"))
    found = both.withColumn("r", nearer)
    return found.select("sequence", "time", "l.*", *[F.when(F.abs(F.col("r.time") - F.col("time")) <= within, F.col(f"r.{c}")).alias(c) for c in columns])


def _images(spark: SparkSession, path: str, decode: str) -> DataFrame:
    """(file, width, height, data) of all PNG images under a path: depth as raw numbers, or rgb bytes."""
    def run(batches):
        for batch in batches:
            out = []
            for data in batch.column("content").to_pylist():
                image = png.decode(data)
                if decode == "depth":
                    out.append((image.shape[1], image.shape[0], np.asarray(image if image.ndim == 2 else image[:, :, 0], np.float32).ravel(), None))
                else:
                    colour = image if image.ndim == 3 else np.repeat(image[:, :, None], 3, 2)
                    out.append((image.shape[1], image.shape[0], None, (colour[:, :, :3] if colour.dtype.itemsize == 1 else colour[:, :, :3] // 256).astype(np.uint8).tobytes()))
            w, h, depth, rgb = zip(*out) if out else ((), (), (), ())
            yield pa.RecordBatch.from_arrays([batch.column("path"), pa.array(w, pa.int32()), pa.array(h, pa.int32()), pa.array(depth, pa.list_(pa.float32())), pa.array(rgb, pa.binary())], ["path", "width", "height", "depth", "rgb"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.png").option("recursiveFileLookup", "true").load(path).select("path", "content")
    return files.mapInArrow(run, "path string, width int, height int, depth array<float>, rgb binary")


def _frames(lists: DataFrame, depth: DataFrame, rgb: DataFrame, scale: float) -> DataFrame:
    """Frames numbered by time in their sequence, with the images of the files that lists (sequence, time, depth_path, rgb_path, ...) name."""
    frame = (F.row_number().over(Window.partitionBy("sequence").orderBy("time", "depth_path")) - 1).cast("long").alias("frame")
    lists = lists.select("*", frame)
    got = lists.join(depth.select(F.col("path").alias("depth_path"), "width", "height", F.transform("depth", lambda d: d * F.lit(scale).cast("float")).alias("depth")), "depth_path", "left")
    got = got.join(rgb.select(F.col("path").alias("rgb_path"), "rgb"), "rgb_path", "left").drop("depth_path", "rgb_path")
    status = merge_status(F.when(F.col("depth").isNull(), "error").otherwise("ok"), F.when(F.col("rgb").isNull(), "skip").otherwise("ok"))
    return got.withColumn("status", status)


def read_tum(spark: SparkSession, path: str, scale: float = 1 / 5000, within: float = 0.02) -> DataFrame:
    """(sequence, frame, time, width, height, depth, rgb, tx .. qw, status) of all sequences under a path that have depth.txt, rgb.txt and groundtruth.txt.

    Each depth image takes the colour image and the pose nearest in time, if not farther than `within`. depth: metres; status: error
    without a depth image, skip without a colour image.
    """
    file = lambda c: F.concat("sequence", F.lit("/"), c)
    depth, rgb = (_listed(spark, path, n, r"\s+") for n in ("depth.txt", "rgb.txt"))
    lists = nearest_in_time(depth.select("sequence", "time", file(F.col("file")).alias("depth_path")), rgb.select("sequence", "time", file(F.col("file")).alias("rgb_path")), ["rgb_path"], within)
    lines = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "groundtruth.txt").text(path).select("value", F.regexp_replace("_metadata.file_path", r"/[^/]*$", "").alias("sequence"))
    cells = lines.where(~F.trim("value").startswith("#")).select("sequence", F.split(F.trim("value"), r"\s+").alias("c")).where(F.size("c") >= 8)
    poses = cells.select("sequence", F.element_at("c", 1).try_cast("double").alias("time"), *[F.element_at("c", k + 2).try_cast("double").alias(n) for k, n in enumerate(POSE)]).where("time is not null")
    images = _images(spark, path, "depth"), _images(spark, path, "rgb")
    return _frames(nearest_in_time(lists, poses, POSE, within), *images, scale)


def read_interiornet(spark: SparkSession, path: str, scale: float = 1 / 1000) -> DataFrame:
    """(sequence, frame, time, width, height, depth, rgb, status) of all sequences under a path with depth0 and cam0, whose data.csv list the same times in nanoseconds."""
    def side(name: str) -> DataFrame:
        rows = _listed(spark, path, "data.csv", r",").where(F.col("sequence").endswith("/" + name))
        return rows.select(F.regexp_replace("sequence", f"/{name}$", "").alias("sequence"), (F.col("time") / 1e9).alias("time"), F.concat("sequence", F.lit("/data/"), "file").alias("path"))

    rgb = side("cam0").withColumnRenamed("path", "rgb_path")
    lists = side("depth0").withColumnRenamed("path", "depth_path").join(rgb, ["sequence", "time"], "left")
    return _frames(lists, _images(spark, path, "depth"), _images(spark, path, "rgb"), scale)


def read_scans(spark: SparkSession, path: str, width: int = 1024, height: int = 64) -> DataFrame:
    """(sequence, frame, path, depth) of LiDAR scans in .pcd files (x y z first, ascii or binary, width x height points): ranges, row by row, numbered by name."""
    def run(batches):
        for batch in batches:
            out = []
            for name, data in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist()):
                end = data.index(b"\nDATA ") + 6
                head = {x.split(" ", 1)[0]: x.split(" ", 1)[1] for x in data[:end].decode().splitlines() if " " in x and not x.startswith("#")}
                kind, at = data[end : data.index(b"\n", end)].strip(), data.index(b"\n", end) + 1
                n, sizes = int(head["POINTS"]), [int(a) * int(b) for a, b in zip(head["SIZE"].split(), head.get("COUNT", "1 " * len(head["SIZE"].split())).split())]
                if head["FIELDS"].split()[:3] != ["x", "y", "z"] or n != width * height:
                    raise ValueError(f"{name} holds no scan of {width} x {height} points")
                if kind == b"ascii":
                    points = np.array([x.split()[:3] for x in data[at:].splitlines()[:n]], np.float32)
                else:
                    points = np.frombuffer(data, np.uint8, n * sum(sizes), at).reshape(n, -1)[:, :12].copy().view("<f4")
                reach = np.sqrt((points.astype(np.float64) ** 2).sum(1)).astype(np.float32)
                out.append(np.where(np.isfinite(reach), reach, np.float32(0)))
            yield pa.RecordBatch.from_arrays([batch.column("path"), pa.array(out, pa.list_(pa.float32()))], ["path", "depth"])

    scans = _files(spark, path, "*.pcd").mapInArrow(run, "path string, depth array<float>").withColumn("sequence", F.regexp_replace("path", r"/[^/]*$", ""))
    return scans.select("sequence", (F.row_number().over(Window.partitionBy("sequence").orderBy("path")) - 1).cast("long").alias("frame"), "path", "depth")
