"""Reading sequences: poses, time lists, raw frames, masks, images, results. Paths may be in any store that Spark reads."""

from __future__ import annotations

import io

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

POSE = ["tx", "ty", "tz", "qx", "qy", "qz", "qw"]


def read_poses(spark: SparkSession, path: str, tolerance: float = 1e-3) -> DataFrame:
    """(line, time, tx .. qw) of the text lines that are no comments: the last 7 columns, and the first as time if there are more.

    Lines with fewer columns, other than numbers, or no unit quaternion are skipped. line counts the good lines of each file in
    order: files are numbered apart from one another, by where a line's block begins and its place in the block.
    """
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("__file"), F.col("_metadata.file_block_start").alias("__block")).where(~F.col("value").startswith("#")).withColumn("__at", F.monotonically_increasing_id())
    cells = F.split(F.trim("value"), r"\s+")
    rows = lines.select("__file", "__block", "__at", cells.alias("c")).where(F.size("c") >= 7)
    last = F.slice("c", -7, 7)
    numbers = rows.select("__file", "__block", "__at", F.when(F.size("c") > 7, F.element_at("c", 1).try_cast("double")).alias("time"), *[F.element_at(last, k + 1).try_cast("double").alias(n) for k, n in enumerate(POSE)])
    finite = F.lit(True)
    for n in POSE:
        finite = finite & F.col(n).isNotNull() & ~F.isnan(n) & (F.abs(n) < float("inf"))
    norm = F.sqrt(sum((F.col(n) * F.col(n) for n in POSE[4:]), F.col("qx") * F.col("qx")))
    good = numbers.where(finite & (F.abs(norm - 1) <= tolerance))
    return good.withColumn("line", F.row_number().over(Window.partitionBy("__file").orderBy("__block", "__at")) - 1).select("line", "time", *POSE)


def read_time_list(spark: SparkSession, path: str) -> DataFrame:
    """(time, name) of lines of a number and a file name."""
    cells = F.split(F.trim("value"), r"\s+")
    rows = spark.read.text(path).where(~F.col("value").startswith("#")).select(cells.alias("c")).where(F.size("c") >= 2)
    return rows.select(F.element_at("c", 1).try_cast("double").alias("time"), F.element_at("c", 2).alias("name")).where("time is not null")


def read_raw_frames(spark: SparkSession, path: str, width: int, height: int) -> DataFrame:
    """(frame, depth, rgb) of a file of frames of fixed length: two 32-bit sizes, depths in 16-bit millimetres, the sizes, 3 bytes of colour for each pixel.

    The file is read by ranges of frames, so a long sequence is read in parallel. depth: metres, row by row; rgb: bytes.
    """
    from .sequences import read_raw_sequence

    frames = read_raw_sequence(spark, path, width, height)
    return frames.select("frame", F.transform("depth", lambda d: F.round(d.cast("double") * 1000) / 1000).alias("depth"), "rgb")


def pixels(frames: DataFrame, width: int, value: str = "depth") -> DataFrame:
    """Long form (frame, u, v, value) of images stored row by row."""
    long = frames.select("frame", F.posexplode(value).alias("at", value))
    return long.select("frame", (F.col("at") % width).cast("long").alias("u"), F.floor(F.col("at") / width).cast("long").alias("v"), value)


def _files(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path).select("path", "content")


def read_masks(spark: SparkSession, path: str) -> DataFrame:
    """(path, det_id, u, v) of the pixels set in .npy files of N x height x width bytes, C order."""
    def decode(batches):
        for pdf in batches:
            for name, data in zip(pdf["path"], pdf["content"]):
                a = np.load(io.BytesIO(data), allow_pickle=False)
                if a.ndim != 3 or a.dtype.itemsize != 1 or np.isfortran(a):
                    raise ValueError(f"{name} holds no masks")
                det, v, u = np.nonzero(a)
                yield pd.DataFrame({"path": name, "det_id": det, "u": u, "v": v})

    return _files(spark, path, "*.npy").mapInPandas(decode, "path string, det_id long, u long, v long")


def read_confidences(spark: SparkSession, path: str) -> DataFrame:
    """(path, det_id, conf) of .npy files of N x classes numbers."""
    def decode(batches):
        for pdf in batches:
            for name, data in zip(pdf["path"], pdf["content"]):
                a = np.atleast_2d(np.load(io.BytesIO(data), allow_pickle=False)).astype(float)
                yield pd.DataFrame({"path": name, "det_id": range(len(a)), "conf": a.tolist()})

    return _files(spark, path, "*.npy").mapInPandas(decode, "path string, det_id long, conf array<double>")


def read_pgm(spark: SparkSession, path: str, scale: float = 0.001) -> DataFrame:
    """(path, width, height, depth) of plain (P2) and binary (P5) images; values times scale, row by row."""
    def decode(batches):
        for pdf in batches:
            for name, data in zip(pdf["path"], pdf["content"]):
                head, at = [], 0
                while len(head) < 4:
                    end = data.find(b"\n", at)
                    head += data[at:end].split(b"#")[0].split()
                    at = end + 1
                w, h, most = map(int, head[1:4])
                a = np.array(data[at:].split(), float) if head[0] == b"P2" else np.frombuffer(data, ">u2" if most > 255 else "u1", w * h, at)
                yield pd.DataFrame({"path": [name], "width": [w], "height": [h], "depth": [(a * scale).tolist()]})

    return _files(spark, path, "*.pgm").mapInPandas(decode, "path string, width int, height int, depth array<double>")


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """Table of a tab-separated log whose header is the line that starts with the word frame."""
    lines = spark.read.text(path)
    head = lines.where(F.col("value").startswith("frame")).first()
    names = head["value"].rstrip().split("\t")
    cells = F.split("value", "\t")
    rows = lines.where(~F.col("value").startswith("frame")).select(cells.alias("c")).where(F.element_at("c", 1).try_cast("double").isNotNull())
    return rows.select(*[F.try_element_at("c", F.lit(k + 1)).try_cast("double").alias(n) for k, n in enumerate(names)])


def read_class_ids(spark: SparkSession, path: str) -> DataFrame:
    """(path, det_id, class_id) of .npy files of N numbers."""
    def decode(batches):
        for pdf in batches:
            for name, data in zip(pdf["path"], pdf["content"]):
                a = np.load(io.BytesIO(data), allow_pickle=False).ravel().astype(np.int64)
                yield pd.DataFrame({"path": name, "det_id": range(len(a)), "class_id": a})

    return _files(spark, path, "*.npy").mapInPandas(decode, "path string, det_id long, class_id long")


def read_segmentation(spark: SparkSession, masks: str, classes: str, confidences: str) -> tuple[DataFrame, DataFrame]:
    """A folder each of masks, class ids and confidences, with one .npy file of the same name for each frame: (name, det_id, u, v) and (name, det_id, class_id, conf).

    Detections whose files disagree in number keep what both have, as the masks' detections say.
    """
    name = lambda df: df.withColumn("name", F.regexp_replace("path", r"^.*/", "")).drop("path")
    pixels = name(read_masks(spark, masks))
    told = name(read_class_ids(spark, classes)).join(name(read_confidences(spark, confidences)), ["name", "det_id"], "left")
    return pixels.select("name", "det_id", "u", "v"), told.select("name", "det_id", "class_id", "conf")


def _sequences(kind: str):
    def read(spark: SparkSession, path: str, **options) -> DataFrame:
        from . import sequences

        return getattr(sequences, kind)(spark, path, **options)

    return read


READERS = {"raw": read_raw_frames, "poses": read_poses, "times": read_time_list, "masks": read_masks, "classes": read_class_ids, "confidences": read_confidences, "pgm": read_pgm, "results": read_results}
READERS |= {"raw_sequence": _sequences("read_raw_sequence"), "tum": _sequences("read_tum"), "interiornet": _sequences("read_interiornet"), "newercollege": _sequences("read_scans")}


def open_sequence(kind: str, spark: SparkSession, path: str, **options) -> DataFrame:
    if kind not in READERS:
        raise ValueError(f"no reader for {kind}; there are {', '.join(READERS)}")
    return READERS[kind](spark, path, **options)
