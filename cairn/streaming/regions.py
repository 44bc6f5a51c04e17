"""A voxel map kept in regions: each batch rewrites only the regions it touches, with its frontier and its pruned blocks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import morton
from ..operators import frontiers

_BLOCK = ["bx", "by", "bz"]
_VOXEL = "x long, y long, z long, value double, weight double"
_SCHEMA = {"voxels": _VOXEL, "frontier": "bx long, by long, bz long, volume long, ratio double", "pruned": "bx long, by long, bz long, value double, weight double"}


def _block(df: DataFrame) -> DataFrame:
    return df.withColumns({"b" + k: F.col(k) - F.col(k) % 8 for k in "xyz"})


def _around(blocks: DataFrame, edge: int) -> DataFrame:
    """The blocks and their face neighbours."""
    at = F.explode(F.array(F.struct("bx", "by", "bz"), *[F.struct(*[(F.col(b) + 8 * d).alias(b) for b, d in zip(_BLOCK, step)]) for step in morton.FACES])).alias("n")
    return blocks.select(at).select("n.*").where(" and ".join(f"{b} >= 0 and {b} < {edge}" for b in _BLOCK)).distinct()


class RegionMap:
    """Voxels (x, y, z, value, weight), frontier blocks and pruned blocks of a map, brought up to date by foreachBatch.

    The map is cut into 8 ** region_depth regions at most, and a version of a region is a folder of its own that is never changed.
    A batch reads the regions that hold its blocks and what lies within two blocks of them, and writes those within one. The
    manifest that names each region's version (a row for each region and table, a number that doesn't grow with the voxels) is
    written last, so a batch that fails, or comes again, starts from the same state and ends the same.

    A block without unknown voxels and without a frontier, whose greatest value * weight is at most 0.95 * min_occupancy, is
    pruned: its voxels leave the table, and one row stands for all of them. An observation in it brings them back.
    """

    def __init__(self, spark: SparkSession, path: str, depth_of_map: int, region_depth: int = 3, min_ratio: float = 0.0, min_occupancy: float | None = None):
        self.spark, self.path, self.depth, self.region_depth, self.min_ratio, self.min_occupancy = spark, path.rstrip("/"), depth_of_map, min(region_depth, depth_of_map - 3), min_ratio, min_occupancy

    # ---- reading

    def _manifest(self, batch: int) -> dict[tuple[str, int], int]:
        if batch < 0:
            return {}
        return {(r["name"], r["region"]): r["version"] for r in self.spark.read.parquet(f"{self.path}/manifest-{batch}").toLocalIterator()}

    def _read(self, name: str, manifest: dict, regions: set[int] | None = None) -> DataFrame:
        paths = [f"{self.path}/{name}-{v}/region={r}" for (n, r), v in sorted(manifest.items()) if n == name and (regions is None or r in regions)]
        return self.spark.read.schema(_SCHEMA[name]).parquet(*paths) if paths else self.spark.createDataFrame([], _SCHEMA[name])

    def voxels(self, batch: int, whole: bool = False) -> DataFrame:
        """All voxels after a batch; whole: those of pruned blocks too."""
        manifest = self._manifest(batch)
        out = self._read("voxels", manifest)
        return out.unionByName(self._opened(self._read("pruned", manifest))) if whole else out

    def frontier(self, batch: int) -> DataFrame:
        return self._keyed(self._read("frontier", self._manifest(batch))).select("key", "volume", "ratio")

    def pruned(self, batch: int) -> DataFrame:
        """(key, value, weight) of octants that are pruned whole, as large as they can be: eight pruned siblings give way to their parent, which takes the greatest value * weight of them."""
        blocks = self.depth - morton.BLOCK_SCALE
        level = self._keyed(self._read("pruned", self._manifest(batch))).select("key", "value", "weight")
        out = None
        for d in range(blocks, 0, -1):
            up = level.withColumn("up", morton.prefix(F.col("key"), d - 1, self.depth))
            best = F.max_by(F.struct("value", "weight"), F.col("value") * F.col("weight"))
            parents = up.groupBy("up").agg(best.alias("b"), F.count("*").alias("n")).where("n = 8")
            alone = up.join(parents.select("up"), "up", "left_anti").select("key", "value", "weight")
            out = alone if out is None else out.unionByName(alone)
            level = parents.select(F.col("up").alias("key"), "b.value", "b.weight")
        return level if out is None else out.unionByName(level)

    def versions(self, batch: int) -> dict[int, int]:
        """The version of each region's voxels after a batch."""
        return {r: v for (n, r), v in self._manifest(batch).items() if n == "voxels"}

    # ---- writing

    def _keyed(self, df: DataFrame) -> DataFrame:
        return df.withColumn("key", morton.encode(*map(F.col, _BLOCK), self.depth - morton.BLOCK_SCALE, self.depth))

    def _regions(self, df: DataFrame):
        size = 1 << (self.depth - self.region_depth)
        return sum((F.floor(F.col(b) / size).cast("long") * (1 << k * self.region_depth) for k, b in enumerate(_BLOCK)), F.lit(0).cast("long"))

    def _listed(self, blocks: DataFrame) -> set[int]:
        return {r[0] for r in blocks.select(self._regions(blocks)).distinct().toLocalIterator()}  # 8 ** region_depth at most

    @staticmethod
    def _opened(pruned: DataFrame) -> DataFrame:
        i = F.explode(F.sequence(F.lit(0), F.lit(511))).alias("i")
        at = {"x": F.col("i") % 8, "y": F.floor(F.col("i") / 8) % 8, "z": F.floor(F.col("i") / 64)}
        return pruned.select("*", i).select(*[(F.col("b" + k) + c).cast("long").alias(k) for k, c in at.items()], "value", "weight")

    def _write(self, df: DataFrame, name: str, batch: int) -> set[int]:
        """Writes rows by region; the regions that have any."""
        target = f"{self.path}/{name}-{batch}"
        df.withColumn("region", self._regions(df)).drop(*([] if name != "voxels" else _BLOCK)).write.mode("overwrite").partitionBy("region").parquet(target)
        kind = _SCHEMA[name] + ", region long"
        return {r[0] for r in self.spark.read.schema(kind).parquet(target).select("region").distinct().toLocalIterator()}

    def update(self, changed: DataFrame, batch: int) -> None:
        """Takes a batch of new values of voxels (vx, vy, vz, value, weight), one for each."""
        edge, manifest = 1 << self.depth, self._manifest(batch - 1)
        fresh = changed.select(F.col("vx").alias("x"), F.col("vy").alias("y"), F.col("vz").alias("z"), F.col("value").cast("double").alias("value"), F.col("weight").cast("double").alias("weight"))
        fresh.write.mode("overwrite").parquet(f"{self.path}/changed-{batch}")
        fresh = _block(self.spark.read.schema(_VOXEL).parquet(f"{self.path}/changed-{batch}"))
        touched = fresh.select(*_BLOCK).distinct()
        near = _around(touched, edge)
        far = _around(near, edge)
        own, around = self._listed(near), self._listed(far)

        before, shut = _block(self._read("voxels", manifest, around)), self._read("pruned", manifest, around)
        again = shut.join(touched, _BLOCK, "left_semi")
        shut = shut.join(touched, _BLOCK, "left_anti")
        old = before.unionByName(_block(self._opened(again))).join(fresh.select("x", "y", "z"), ["x", "y", "z"], "left_anti")
        now = old.unionByName(fresh)
        now.drop(*_BLOCK).write.mode("overwrite").parquet(f"{self.path}/now-{batch}")
        now = _block(self.spark.read.schema(_VOXEL).parquet(f"{self.path}/now-{batch}"))

        known = now.join(far, _BLOCK, "left_semi").select("x", "y", "z", "value", "weight").unionByName(self._opened(shut.join(far, _BLOCK, "left_semi")))
        edges = _block(frontiers.frontier_voxels(known, edge)).join(near, _BLOCK, "left_semi").groupBy(*_BLOCK).agg(F.count("*").alias("volume"))
        edges = edges.withColumn("ratio", F.col("volume") / 512)
        edges.write.mode("overwrite").parquet(f"{self.path}/edges-{batch}")
        edges = self.spark.read.schema(_SCHEMA["frontier"]).parquet(f"{self.path}/edges-{batch}")
        if self.min_occupancy is None:
            gone = shut.limit(0)
        else:
            most = F.max_by(F.struct("value", "weight"), F.col("value") * F.col("weight"))
            full = now.join(near, _BLOCK, "left_semi").groupBy(*_BLOCK).agg(most.alias("m"), F.count("*").alias("n")).where((F.col("n") == 512) & (F.col("m.value") * F.col("m.weight") <= 0.95 * self.min_occupancy))
            gone = full.join(edges, _BLOCK, "left_anti").select(*_BLOCK, "m.value", "m.weight")

        inside = lambda df: df.where(self._regions(df).isin(*own)) if own else df.limit(0)
        written = {
            "voxels": inside(now).join(gone.select(*_BLOCK), _BLOCK, "left_anti"),
            "frontier": inside(self._read("frontier", manifest, own)).join(near, _BLOCK, "left_anti").unionByName(edges.where(F.col("ratio") >= self.min_ratio)),
            "pruned": inside(shut).unionByName(gone),
        }
        after = {k: v for k, v in manifest.items() if k[1] not in own}
        for name, df in written.items():
            after |= {(name, r): batch for r in self._write(df, name, batch)}
        rows = [(n, r, v) for (n, r), v in sorted(after.items())]
        self.spark.createDataFrame(rows, "name string, region long, version long").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/manifest-{batch}")
