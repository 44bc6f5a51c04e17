"""Segmentations of frames: masks that absorb others, label images, masks limited to measured depths, and lasting numbers for objects."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import Scratch
from ..sources.sinks import numbered


def absorb(own: DataFrame, others: DataFrame, overlap: float) -> tuple[DataFrame, DataFrame]:
    """Each frame's other masks, in the order of their ids, join the first of its own masks that holds more than `overlap` of them, as it has grown so far.

    own: frame, obj_id, u, v; others: frame, det_id, u, v (pixels of masks). Returns (frame, det_id, obj_id), null where none takes it,
    and the grown masks (frame, obj_id, u, v). Frames are independent, so the order within one costs no rounds over all: a task reads its
    frames' pixels sorted by mask, own masks first, and holds the own masks of one frame and one other mask at a time.
    """
    place = (F.shiftleft(F.col("v").cast("long"), 32).bitwiseOR(F.col("u").cast("long"))).alias("place")
    rows = own.select("frame", F.lit(0).alias("other"), F.col("obj_id").alias("mask"), place).unionByName(others.select("frame", F.lit(1).alias("other"), F.col("det_id").alias("mask"), place))

    def one(batches):
        now, masks, parts, out = None, {}, [], []

        def end():
            """The mask now is whole."""
            p, (frame, other, mask) = np.unique(np.concatenate(parts)), now
            if not other:
                masks[mask] = p
                return
            into = next((i for i in sorted(masks) if np.isin(p, masks[i], assume_unique=True).sum() > overlap * len(p)), None)
            if into is not None:
                masks[into] = np.union1d(masks[into], p)
            out.append((frame, mask, into))

        def told():
            frame, mask, into = zip(*out) if out else ((), (), ())
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (frame, mask, into)], ["frame", "det_id", "obj_id"])

        for batch in batches:
            if not batch.num_rows:
                continue
            columns = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("frame", "other", "mask", "place")]
            new = np.flatnonzero(np.any([np.diff(c) != 0 for c in columns[:3]], axis=0)) + 1
            for i, k in zip([0, *new], [*new, batch.num_rows]):
                key = tuple(int(c[i]) for c in columns[:3])
                if now is not None and key != now:
                    end()
                    parts.clear()
                    if key[0] != now[0]:
                        masks.clear()
                now = key
                parts.append(columns[3][i:k])
            yield told()
            out.clear()
        if now is not None:
            end()
        yield told()

    # rows without a frame or a mask's number belong to no mask
    ordered = rows.where("frame is not null and mask is not null").repartition("frame").sortWithinPartitions("frame", "other", "mask")
    taken = ordered.mapInArrow(one, "frame long, det_id long, obj_id long")
    taken = Scratch(own.sparkSession, "absorb").save(taken, "taken")
    more = others.join(taken.where("obj_id is not null"), ["frame", "det_id"]).select("frame", "obj_id", "u", "v")
    return taken, own.select("frame", "obj_id", "u", "v").unionByName(more).distinct()


def label_image(masks: DataFrame, label: str, order: str) -> DataFrame:
    """(frame, u, v, label): of the masks over a pixel the one last in order sets its label, as when they are drawn one after another. Pixels under no mask have none."""
    return masks.groupBy("frame", "u", "v").agg(F.max_by(label, order).alias(label))


def valid_only(masks: DataFrame, depth: DataFrame, near: float, far: float) -> DataFrame:
    """Mask pixels whose depth was measured within the sensor's range. depth: frame, u, v, depth."""
    valid = depth.where((F.col("depth") >= near) & (F.col("depth") <= far)).select("frame", "u", "v")
    return masks.join(valid, ["frame", "u", "v"], "left_semi")


class ObjectTable:
    """Objects with lasting numbers: a batch's detections that match no object become new ones.

    Versions are numbered by batch and never changed, and new numbers follow the order of (frame, det_id), so a batch that comes
    again gives the same numbers.
    """

    SCHEMA = "obj_id long, class_id long, first_frame long, det_id long, updates long"

    def __init__(self, spark, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def objects(self, batch: int) -> DataFrame:
        return self.spark.createDataFrame([], self.SCHEMA) if batch < 0 else self.spark.read.schema(self.SCHEMA).parquet(f"{self.path}/objects-{batch}")

    def update(self, detections: DataFrame, batch: int) -> DataFrame:
        """Takes detections (frame, det_id, class_id, obj_id: the object matched, or null); returns them with the numbers that they have now."""
        old = self.objects(batch - 1)
        count = old.agg(F.coalesce(F.max("obj_id") + 1, F.lit(0))).first()[0]
        fresh = numbered(detections.where("obj_id is null").select("frame", "det_id", "class_id"), ["frame", "det_id"], Scratch(self.spark, "objects"))
        fresh = fresh.select((F.col("n") + count).alias("obj_id"), "class_id", F.col("frame").alias("first_frame"), "det_id", F.lit(1).cast("long").alias("updates"))
        seen = detections.where("obj_id is not null").groupBy("obj_id").agg(F.count("*").alias("more"))
        kept = old.join(seen, "obj_id", "left").select("obj_id", "class_id", "first_frame", "det_id", (F.col("updates") + F.coalesce("more", F.lit(0))).alias("updates"))
        kept.unionByName(fresh).write.mode("overwrite").parquet(f"{self.path}/objects-{batch}")
        now = self.objects(batch).where(F.col("obj_id") >= count).select(F.col("first_frame").alias("frame"), "det_id", F.col("obj_id").alias("new_id"))
        return detections.join(now, ["frame", "det_id"], "left").withColumn("obj_id", F.coalesce("obj_id", "new_id")).drop("new_id")
