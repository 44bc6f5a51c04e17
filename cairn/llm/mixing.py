"""Mixing sources to target weights: capped water-filling over sources, then seeded whole and fractional repetitions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD_CLASS, Scratch

#: Hash ranges into which each source's rows are dealt before the partial repetition's last range is cut row by row.
RANGES = 4096


def word_count(text):
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD_CLASS)).cast("long")


def cyclic_weights(sources: DataFrame, weights: tuple[int, ...] = (5, 2, 1)) -> DataFrame:
    """(source, weight): sources in order of code points, null last, get the weights in turn. One row for each source is ranked."""
    rank = F.row_number().over(Window.orderBy(F.col("source").isNull(), F.col("source"))) - 1
    return sources.select("source", F.element_at(F.array(*map(F.lit, weights)), (rank % len(weights) + 1).cast("int")).cast("long").alias("weight"))


def water_fill(sources: DataFrame, scratch: Scratch, budget: int, max_epochs: int = 3) -> DataFrame:
    """Adds target: the budget shared by weight, where no source gets over max_epochs times its size.

    sources: (source, source_size, weight). Sources above their cap are clamped to it and the excess is shared among the
    others by weight, until none is above; each round clamps all sources above the level so far, so rounds are few, and as
    many as needed. Weights of 0 and empty sources get 0.
    A budget over all caps leaves every source at its cap.
    """
    cap = F.col("source_size") * max_epochs
    now = scratch.save(sources.withColumn("full", (F.col("weight") <= 0) | (F.col("source_size") <= 0)), "fill0")
    step = 0
    while True:
        left, weight = now.agg(F.lit(budget) - F.coalesce(F.sum(F.when(F.col("full") & (F.col("weight") > 0), cap)), F.lit(0)), F.coalesce(F.sum(F.when(~F.col("full"), F.col("weight"))), F.lit(0))).first()
        if not weight:
            return now.select("source", "source_size", "weight", F.when(F.col("weight") > 0, cap).otherwise(0).cast("double").alias("target"))
        share = (F.lit(left) * F.col("weight")).cast("double") / F.lit(float(weight))
        over = ~F.col("full") & (share > cap)
        if not now.where(over).limit(1).count():
            return now.select("source", "source_size", "weight", F.when(~F.col("full"), share).when(F.col("weight") > 0, cap.cast("double")).otherwise(0.0).alias("target"))
        step += 1
        now = scratch.save(now.withColumn("full", F.col("full") | over), f"fill{step}")


def mix_sources(docs: DataFrame, weights=cyclic_weights, share: float = 1.0, max_epochs: int = 3, seed: int = 7, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row for each row of docs: id, source, size (words), source_size, target (of its source), copies and taken.

    weights: a function from (source) rows to (source, weight). share of all words is dealt to the sources by water_fill().
    Each source is repeated whole floor(target / source_size) times; the rest is the rows that come first by a seeded hash
    of the id, as long as a row's middle word lies within it, so a source misses its target by half a row at most. The order
    of rows is found by ranges of the hash: sums by range first, and row by row only within the one range that is cut.
    Null texts have size 0; null sources are one source; rows of one id and size are ordered arbitrarily among themselves
    but each is counted. An empty table gives no rows.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "mixing")
    order = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col(id_col).cast("string"), F.md5(F.coalesce(F.col(text_col), F.lit("")))))), 1, 15), 16, 10).cast("long")
    rows = scratch.save(docs.select(F.col(id_col).cast("long").alias("id"), F.col(source_col).cast("string").alias("source"), word_count(F.col(text_col)).alias("size"), order.alias("h")), "rows")
    span = F.expr(f"h div {2**60 // RANGES}")
    ranges = scratch.save(rows.groupBy("source", span.alias("r")).agg(F.sum("size").alias("range_size")), "ranges")
    sources = ranges.groupBy("source").agg(F.sum("range_size").alias("source_size"))
    sources = scratch.save(sources, "sources")
    sources = _with_weights(sources, weights)
    budget = int((ranges.agg(F.sum("range_size")).first()[0] or 0) * share)
    filled = scratch.save(water_fill(sources, scratch, budget, max_epochs), "filled")
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    filled = filled.withColumn("whole", whole).withColumn("part", F.col("target") - F.col("whole") * F.col("source_size"))
    before = F.coalesce(F.sum("range_size").over(Window.partitionBy("source").orderBy("r").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    keyed = ranges.withColumn("before", before).alias("a").join(filled.alias("b"), F.col("a.source").eqNullSafe(F.col("b.source"))).select(F.col("a.source").alias("source"), "r", "before", "range_size", "source_size", "target", "whole", "part")
    plan = scratch.save(keyed, "plan")
    # one row for each source and range: at most RANGES times the sources, and never more than the rows
    dealt = rows.withColumn("r", span).alias("a").join(plan.alias("b"), F.col("a.source").eqNullSafe(F.col("b.source")) & (F.col("a.r") == F.col("b.r"))).select("a.id", "a.source", "a.size", "a.h", "a.r", "before", "range_size", "source_size", "target", "whole", "part")
    within = F.sum("size").over(Window.partitionBy("source", "r").orderBy("h", "id", "size").rowsBetween(Window.unboundedPreceding, 0))
    cut = (F.col("before") < F.col("part")) & (F.col("before") + F.col("range_size") > F.col("part"))
    sure = dealt.where(~cut).withColumn("more", F.col("before") + F.col("range_size") <= F.col("part")).withColumn("more", F.col("more") & (F.col("part") > 0))
    torn = dealt.where(cut).withColumn("more", F.col("before") + within - F.col("size") / 2.0 <= F.col("part"))
    copies = F.col("whole") + F.col("more").cast("long")
    return sure.unionByName(torn).select("id", "source", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"))


def _with_weights(sources: DataFrame, weights) -> DataFrame:
    given = weights(sources.select("source")).alias("w")
    return sources.alias("s").join(given, F.col("s.source").eqNullSafe(F.col("w.source"))).select("s.source", "s.source_size", F.col("w.weight").cast("long").alias("weight"))
