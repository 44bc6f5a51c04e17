"""Relations of the map derived from the driver's tables, as DataFrames and as SQL for the oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: name: (table, columns as SQL that both engines read alike)
COLUMNS = {
    "points": ("lineitem", ["l_partkey % 64 AS x", "l_suppkey % 64 AS y", "CAST(floor(l_quantity) AS BIGINT) AS z", "l_shipdate AS ts", "l_linenumber AS frame", "l_orderkey AS o1", "l_partkey AS o2", "l_suppkey AS o3", "CAST(l_extendedprice AS DOUBLE) AS o4", "CAST(l_discount AS DOUBLE) AS disc", "CAST(l_tax AS DOUBLE) AS tax", "CASE WHEN l_returnflag = 'R' THEN 5.015E0 * CAST(l_tax AS DOUBLE) / 8E-2 ELSE -5.015E0 * (1E0 - CAST(l_discount AS DOUBLE) / 1E-1) END AS sample", "(CAST(l_discount AS DOUBLE) - 5E-2) / 5E-2 AS tsdf"]),
    "dense": ("lineitem", ["l_partkey % 32 AS x", "l_suppkey % 32 AS y", "CAST(floor(l_quantity / 2) AS BIGINT) AS z", "l_shipdate AS ts", "l_linenumber AS frame", "l_orderkey AS o1", "l_partkey AS o2", "l_suppkey AS o3", "CAST(l_extendedprice AS DOUBLE) AS o4", "CASE WHEN l_returnflag = 'R' THEN 5.015E0 * CAST(l_tax AS DOUBLE) / 8E-2 ELSE -5.015E0 * (1E0 - CAST(l_discount AS DOUBLE) / 1E-1) END AS sample", "(CAST(l_discount AS DOUBLE) - 5E-2) / 5E-2 AS tsdf"]),
    "detections": ("embeddings", ["vec_id AS det_id", "label AS instance_id", "embedding AS conf", "CAST(1 + vec_id % 3 AS BIGINT) AS n_updates"]),
    "object_pixels": ("lineitem", ["CAST(year(l_shipdate) AS BIGINT) AS frame", "CAST(l_linenumber AS BIGINT) AS obj_id", "l_partkey % 40 AS u", "CAST(floor(l_quantity) AS BIGINT) AS v"]),
    "pixels": ("lineitem", ["CAST(year(l_shipdate) AS BIGINT) AS frame", "l_suppkey AS det_id", "l_partkey % 40 AS u", "CAST(floor(l_quantity) AS BIGINT) AS v"]),
    "poses": ("orders", ["o_orderkey AS seq", "o_custkey AS body", "CAST(o_custkey % 20 AS DOUBLE) AS x", "CAST(floor(o_custkey / 20) AS BIGINT) % 20 * 1E0 AS y", "0E0 AS z", "CAST(o_totalprice AS DOUBLE) - floor(CAST(o_totalprice AS DOUBLE) / 6.283185307E0) * 6.283185307E0 AS yaw", "CAST(o_totalprice AS DOUBLE) AS price"]),
}
#: Depth images of 64 x 64 pixels, one for each 4096 orders: a slanted wall with noise, some pixels without depth. Their number grows with the table.
SHOTS = "round(0.9 + 2.6 * u / 64 + 0.31 * (frame % 5) + 4 * avg(disc), 9) * CASE WHEN sum(hundredths) % 13 = 5 THEN 0 ELSE 1 END"
COLUMNS["shots"] = ("lineitem", ["CAST(floor(l_orderkey / 4096) AS BIGINT) AS frame", "l_partkey % 64 AS u", "l_suppkey % 64 AS v", "CAST(l_discount AS DOUBLE) AS disc", "CAST(round(l_discount * 100) AS BIGINT) AS hundredths"])
DISTINCT = {"pixels", "object_pixels"}
EPOCH = {"spark": "unix_micros(cast(ts as timestamp)) / 1e6", "duckdb": "epoch_us(ts) / 1e6"}
FRAMES = ["event_id AS frame", "user_id AS sensor", "event_type AS stream", "CAST(value AS DOUBLE) AS value"]


def relation(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    if name == "frames":
        return spark.read.parquet(f"{sf_dir}/events.parquet").selectExpr(*FRAMES, f"{EPOCH['spark']} AS t")
    if name == "metrics":
        return relation(spark, sf_dir, "frames").selectExpr("stream AS key", "frame % 100 AS iter", "frame AS seq", "value")
    if name == "image":
        return relation(spark, sf_dir, "points").groupBy("x", "y").agg((F.avg("z") / 10).alias("depth")).selectExpr("x AS u", "y AS v", "depth")
    if name == "voxels":  # the factor keeps means off the ties of rounding
        return relation(spark, sf_dir, "dense").groupBy("x", "y", "z").agg((F.round(F.avg("sample") * 0.98712361, 9) + F.lit(0.0)).alias("value"), F.count("*").cast("double").alias("weight"))
    if name == "depths":  # rows of a frame meet before they are summed: a task holds the pixels of few frames, and not those of all its rows of the table
        return relation(spark, sf_dir, "shots").select("frame", "u", "v", "disc").repartition("frame").withColumn("hundredths", F.expr("CAST(round(disc * 100) AS BIGINT)")).groupBy("frame", "u", "v").agg(F.expr(SHOTS).cast("double").alias("depth"))
    table, columns = COLUMNS[name]
    df = spark.read.parquet(f"{sf_dir}/{table}.parquet").selectExpr(*columns)
    return df.distinct() if name in DISTINCT else df


def sql(*names: str) -> str:
    """WITH clauses of relations for DuckDB."""
    out = {}

    def add(name):
        if name in out:
            return
        if name == "frames":
            out[name] = f"SELECT {', '.join(FRAMES)}, {EPOCH['duckdb']} AS t FROM events"
        elif name == "metrics":
            add("frames")
            out[name] = "SELECT stream AS key, frame % 100 AS iter, frame AS seq, value FROM frames"
        elif name == "image":
            add("points")
            out[name] = "SELECT x AS u, y AS v, avg(z) / 10 AS depth FROM points GROUP BY x, y"
        elif name == "voxels":
            add("dense")
            out[name] = "SELECT x, y, z, round(avg(sample) * 0.98712361e0, 9) + 0e0 AS value, CAST(count(*) AS DOUBLE) AS weight FROM dense GROUP BY x, y, z"
        elif name == "depths":
            add("shots")
            out[name] = f"SELECT frame, u, v, CAST({SHOTS} AS DOUBLE) AS depth FROM shots GROUP BY frame, u, v"
        else:
            table, columns = COLUMNS[name]
            out[name] = f"SELECT {'DISTINCT ' * (name in DISTINCT)}{', '.join(columns)} FROM {table}"

    for n in names:
        add(n)
    return "WITH RECURSIVE " + ", ".join(f"{k} AS ({v})" for k, v in out.items())


def morton_sql(x: str, y: str, z: str, bits: int) -> str:
    """Interleaved coordinates as a sum of bits."""
    return "CAST(" + " + ".join(f"(({c} >> {i}) & 1) * {1 << 3 * i + k}" for i in range(bits) for k, c in enumerate((x, y, z))) + " AS BIGINT)"


def key_sql(x: str, y: str, z: str, depth: int, depth_of_map: int) -> str:
    """Key at a depth: coordinates snapped to the octant's corner, and to blocks of 8 at the least."""
    low = max(depth_of_map - depth, 3)
    snap = lambda c: f"({c} - {c} % {1 << low})"
    return f"({morton_sql(snap(x), snap(y), snap(z), depth_of_map)} + {depth})"
