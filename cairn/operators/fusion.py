"""Fusing observations into voxels: ordered folds, which start from an accumulator of the first observations and apply caps and clamps in time's order."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import clamp
from ..sources.scratch import Scratch

#: Observations of one voxel that are folded as one list at most. Voxels with more are folded by ranges of their order.
MANY = 4096
_FAR = 1e300


@dataclass(frozen=True)
class Algebra:
    """How a range of a voxel's observations folds without knowing the value before it.

    Every update is a clamped affine map x -> clamp(a x + b, low, high), and such maps compose to such maps. one(observation,
    rank) gives the map of an observation that has `rank` others before it: a struct of a, b, low, high. If an update also
    fades the value by the time since the last one, fade(seconds) is the factor, time(observation) its time, null if the
    observation changes nothing. result(x, n, last) makes the state from the start's image, the count and the last time.
    """

    start: float
    one: Callable[[Column, Column], Column]
    result: Callable[[Column, Column, Column], Column]
    fade: Callable[[Column], Column] | None = None
    time: Callable[[Column], Column] | None = None


def _map(a, b, low, high, n, first, last) -> Column:
    names = (("a", a), ("b", b), ("low", low), ("high", high))
    return F.struct(*[(F.lit(float(x)) if isinstance(x, (int, float)) else x.cast("double")).alias(k) for k, x in names], (F.lit(n) if isinstance(n, int) else n).cast("long").alias("n"), first.cast("double").alias("first"), last.cast("double").alias("last"))


def _after(f: Column, g: Column, algebra: Algebra) -> Column:
    """g after f, faded by the time between them."""
    c = g["a"]
    if algebra.fade:
        c = c * F.coalesce(algebra.fade(g["first"] - f["last"]), F.lit(1.0))
    through = lambda x: F.greatest(g["low"], F.least(c * x + g["b"], g["high"]))
    return _map(c * f["a"], c * f["b"] + g["b"], through(f["low"]), through(f["high"]), f["n"] + g["n"], F.coalesce(f["first"], g["first"]), F.coalesce(g["last"], f["last"]))


def fold(observations: DataFrame, keys: list[str], order: list[str], values: list[str], start: Column, step, finish=None, name: str = "state", algebra: Algebra | None = None, many: int = MANY) -> DataFrame:
    """One row for each key: step folded over its observations in order, which should name enough columns to leave no ties that matter.

    With an algebra, no more than `many` observations ever stand in one list: voxels with more are dealt out by ranges of key
    and order, ranges are folded apart to one map each, and a voxel's maps are composed in order, `many` at a time. So an
    observed wall with a third of all rows in one voxel costs no task more than others. Results agree up to rounding.
    """
    listed = lambda df: df.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(*order, *values))).alias("__seen")).select(*keys, F.aggregate("__seen", start, step, finish).alias(name))
    if algebra is None:
        return listed(observations)
    often = observations.groupBy(*keys).agg(F.count("*").alias("__n")).where(F.col("__n") > many).drop("__n")
    scratch = Scratch(observations.sparkSession, "folds")
    often = scratch.save(often, "often")
    if not often.limit(1).count():
        return listed(observations)
    few, hot = observations.join(often, keys, "left_anti"), observations.join(often, keys, "left_semi")
    return listed(few).unionByName(_by_ranges(hot, keys, order, values, algebra, many, scratch).select(*keys, F.col("state").alias(name)))


def _by_ranges(hot: DataFrame, keys: list[str], order: list[str], values: list[str], algebra: Algebra, many: int, scratch: Scratch) -> DataFrame:
    ranged = hot.select(*keys, *order, *values).repartitionByRange(*keys, *order).withColumn("__part", F.spark_partition_id())
    ranged = scratch.save(ranged, "ranged")
    within = Window.partitionBy(*keys, "__part").orderBy(*order)
    ranged = ranged.withColumn("__range", F.floor((F.row_number().over(within) - 1) / many))
    listed = scratch.save(ranged.groupBy(*keys, "__part", "__range").agg(F.array_sort(F.collect_list(F.struct(*order, *values))).alias("__seen")), "listed")
    # a row for each range: what stands before it sets the rank of its observations
    before = Window.partitionBy(*keys).orderBy("__part", "__range").rowsBetween(Window.unboundedPreceding, -1)
    sizes = listed.select(*keys, "__part", "__range", F.size("__seen").alias("__n"))
    starts = sizes.withColumn("__before", F.coalesce(F.sum("__n").over(before), F.lit(0)).cast("long")).drop("__n")
    none = F.lit(None).cast("double")

    def step(s, o):
        told = algebra.one(o, s["n"] + s["skip"])
        t = algebra.time(o) if algebra.time else none
        g = _map(told["a"], told["b"], told["low"], told["high"], 1, t, t)
        return _skipping(_after(s, g, algebra), s["skip"])

    identity = _map(1.0, 0.0, -_FAR, _FAR, 0, none, none)
    maps = listed.join(starts, [*keys, "__part", "__range"]).select(*keys, "__part", "__range", F.aggregate("__seen", _skipping(identity, F.col("__before")), step).alias("m"))
    level, at = scratch.save(maps.withColumn("m", F.struct(*[F.col(f"m.{c}").alias(c) for c in ("a", "b", "low", "high", "n", "first", "last")])), "maps0"), 0
    while level.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1").limit(1).count():
        turn = Window.partitionBy(*keys).orderBy("__part", "__range")
        grouped = level.withColumn("__turn", F.floor((F.row_number().over(turn) - 1) / many)).groupBy(*keys, "__turn").agg(F.array_sort(F.collect_list(F.struct("__part", "__range", "m"))).alias("ms"))
        at += 1
        joined = F.aggregate("ms", identity, lambda s, o: _after(s, o["m"], algebra))
        level = scratch.save(grouped.select(*keys, F.lit(0).alias("__part"), F.col("__turn").alias("__range"), joined.alias("m")), f"maps{at}")
    x = clamp(F.col("m.a") * algebra.start + F.col("m.b"), F.col("m.low"), F.col("m.high"))
    return level.select(*keys, algebra.result(x, F.col("m.n"), F.col("m.last")).alias("state"))


def _skipping(m: Column, skip: Column) -> Column:
    return F.struct(*[m[c].alias(c) for c in ("a", "b", "low", "high", "n", "first", "last")], skip.cast("long").alias("skip"))


def _running_mean(value: str, most: float, start: float, low: float, high: float, result) -> Algebra:
    def one(o, rank):
        w = F.least(rank.cast("double"), F.lit(most))
        return F.struct((w / (w + 1)).alias("a"), (clamp(o[value].cast("double"), low, high) / (w + 1)).alias("b"), F.lit(low).alias("low"), F.lit(high).alias("high"))

    return Algebra(start, one, result)


def fuse_tsdf(observations: DataFrame, keys: list[str], order: list[str], value: str = "tsdf", max_weight: float = 100.0, many: int = MANY) -> DataFrame:
    """x: the running mean of signed distances clamped to [-1, 1]; y: the weight, capped."""
    start = F.struct(F.lit(1.0).alias("x"), F.lit(0.0).alias("y"))
    step = lambda s, o: F.struct(clamp((s["y"] * s["x"] + clamp(o[value], -1.0, 1.0)) / (s["y"] + 1), -1.0, 1.0).alias("x"), F.least(s["y"] + 1, F.lit(max_weight)).alias("y"))
    algebra = _running_mean(value, max_weight, 1.0, -1.0, 1.0, lambda x, n, _: F.struct(x.alias("x"), F.least(n.cast("double"), F.lit(max_weight)).alias("y")))
    return fold(observations, keys, order, [value], start, step, algebra=algebra, many=many).select(*keys, "state.x", "state.y")


def fuse_mean(observations: DataFrame, keys: list[str], order: list[str], value: str = "sample", max_weight: float = 20.0, many: int = MANY) -> DataFrame:
    """Capped weighted mean of log-odds, with the number of observations."""
    start = F.struct(F.lit(0.0).alias("x"), F.lit(0.0).alias("y"), F.lit(0).alias("n"))
    step = lambda s, o: F.struct(((s["x"] * s["y"] + o[value]) / (s["y"] + 1)).alias("x"), F.least(s["y"] + 1, F.lit(max_weight)).alias("y"), (s["n"] + 1).alias("n"))
    algebra = _running_mean(value, max_weight, 0.0, -_FAR, _FAR, lambda x, n, _: F.struct(x.alias("x"), F.least(n.cast("double"), F.lit(max_weight)).alias("y"), n.cast("int").alias("n")))
    return fold(observations, keys, order, [value], start, step, algebra=algebra, many=many).select(*keys, "state.x", "state.y", "state.n")


def fuse_log_odds(observations: DataFrame, keys: list[str], order: list[str], value: str = "p", time: str = "t", tau: float = 4.0, most: float = 100.0, many: int = MANY) -> DataFrame:
    """Decayed log-odds: the old value fades with the time since it was set (to a half at most), then the sample's log-odds are added.

    Samples are probabilities clamped to [0.03, 0.97]; one of a half changes nothing, its time neither.
    """
    start = F.struct(F.lit(0.0).alias("x"), F.lit(0.0).alias("y"))
    faded = lambda gap: F.greatest(F.lit(0.5), 1 / (1 + gap / tau))

    def odds(o):
        p = clamp(o[value], 0.03, 0.97)
        return F.log2(p / (1 - p))

    def step(s, o):
        told = F.struct(clamp(s["x"] * faded(o[time] - s["y"]) + odds(o), -most, most).alias("x"), o[time].cast("double").alias("y"))
        return F.when(o[value] == 0.5, s).otherwise(told)

    def one(o, _):
        still = o[value] == 0.5
        pick = lambda a, b: F.when(still, a).otherwise(b)
        return F.struct(F.lit(1.0).alias("a"), pick(0.0, odds(o)).alias("b"), pick(-_FAR, -most).alias("low"), pick(_FAR, most).alias("high"))

    algebra = Algebra(0.0, one, lambda x, _, last: F.struct(x.alias("x"), F.coalesce(last, F.lit(0.0)).alias("y")), lambda gap: F.when(gap.isNotNull(), faded(gap)), lambda o: F.when(o[value] != 0.5, o[time].cast("double")))
    return fold(observations, keys, order, [time, value] if time not in order else [value], start, step, algebra=algebra, many=many).select(*keys, "state.x", "state.y")
