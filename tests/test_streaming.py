from small import SMALL
from pyspark.sql import functions as F

from cairn.operators import frontiers, fusion
from cairn.plans.maps import ORDER
from cairn.plans.relations import relation
from cairn.streaming import maps


def test_stream_ends_as_the_batch_does(spark, tmp_path):
    seen = relation(spark, SMALL, "dense").withColumnsRenamed({"x": "vx", "y": "vy", "z": "vz"})
    early, late = seen.where("ts < timestamp'1995-01-01'"), seen.where("ts >= timestamp'1995-01-01'")
    for k, part in enumerate((early, late)):
        part.coalesce(1).write.parquet(str(tmp_path / f"in/{k}"))
    columns = ["vx", "vy", "vz", *ORDER, "sample"]
    stream = spark.readStream.schema(spark.read.parquet(str(tmp_path / "in/0")).schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").option("latestFirst", "false").parquet(str(tmp_path / "in")).select(*columns)
    table = maps.MapTable(spark, str(tmp_path / "map"), 5)
    query = maps.fuse_stream(stream, ORDER, "sample", 3.0).writeStream.outputMode("update").foreachBatch(table.update).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination()
    last = max(int(p.name.split("-")[1]) for p in (tmp_path / "map").glob("voxels-*"))
    got = {(r["x"], r["y"], r["z"]): round(r["value"], 9) for r in table.voxels(last).collect()}
    want = {(r["vx"], r["vy"], r["vz"]): round(r["x"], 9) for r in fusion.fuse_mean(seen, ["vx", "vy", "vz"], ORDER, "sample", 3.0).collect()}
    assert got == want
    assert table.frontier(last).count() == frontiers.frontier_blocks(table.voxels(last), 5).count()


def test_rates(spark):
    assert [r[0] for r in maps.every(spark.range(10).withColumnRenamed("id", "frame"), 4, 1).collect()] == [0, 1, 4, 8]
    assert maps.least_so_far(spark.createDataFrame([(1, 3), (1, 2)], "k int, v int"), ["k"], "v").first()["v"] == 2
    poses = spark.createDataFrame([(0.0, 0.0, 0.0, 0.1)] * 3, "x double, y double, z double, yaw double")
    assert maps.visits(poses, 1.0, 4, 2).select(F.max("visits")).first()[0] == 2
