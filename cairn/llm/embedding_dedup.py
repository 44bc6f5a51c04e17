"""Near-duplicate embeddings through a forest of random-projection trees with spill overlap."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, attach, connected_components

#: The trees are fitted on so many vectors at most (the first by a hash of them); all vectors are then indexed.
SAMPLE = 200_000
#: Vectors compared at once within a cell; larger cells are compared block by block.
BLOCK = 4096


class Forest:
    """Random directions and thresholds: at each node, vectors up to the median go left and the others right; those within
    `spill` of it go both ways, so that near vectors rarely part, and hardly ever in all trees. Cells are numbered over all trees."""

    def __init__(self, sample: np.ndarray, trees: int, leaf: int, spill: float, seed: int):
        rng = np.random.default_rng(seed)
        self.spill, self.roots, self.nodes, self.cells = spill, [], [], 0
        for _ in range(trees):
            self.roots.append(self._grow(sample, rng, leaf))

    def _grow(self, x: np.ndarray, rng, leaf: int) -> int:
        at = len(self.nodes)
        self.nodes.append(None)
        direction = rng.standard_normal(x.shape[1])
        direction /= np.linalg.norm(direction)
        p = x @ direction
        cut = float(np.median(p)) if len(p) else 0.0
        left, right = x[p <= cut + self.spill], x[p > cut - self.spill]
        # no split where hardly any vector would leave a side: what lies that close is one cell
        if len(x) <= leaf or max(len(left), len(right)) > 0.9 * len(x):
            self.nodes[at] = self.cells
            self.cells += 1
        else:
            self.nodes[at] = (direction, cut, self._grow(left, rng, leaf), self._grow(right, rng, leaf))
        return at

    def assign(self, x: np.ndarray) -> list[np.ndarray]:
        """Each vector's cells in ascending order, one or more of each tree."""
        rows, cells = [], []
        stack = [(r, np.arange(len(x))) for r in self.roots]
        while stack:
            at, who = stack.pop()
            if not len(who):
                continue
            node = self.nodes[at]
            if isinstance(node, int):
                rows.append(who)
                cells.append(np.full(len(who), node, np.int32))
                continue
            direction, cut, left, right = node
            p = x[who] @ direction
            stack += [(left, who[p <= cut + self.spill]), (right, who[p > cut - self.spill])]
        rows, cells = np.concatenate(rows or [np.empty(0, int)]), np.concatenate(cells or [np.empty(0, np.int32)])
        order = np.lexsort((cells, rows))
        return np.split(cells[order], np.searchsorted(rows[order], np.arange(1, len(x)))) if len(x) else []


def _unit(vectors) -> np.ndarray:
    x = np.array([np.asarray(v, np.float64) for v in vectors])
    with np.errstate(over="ignore"):
        x = x / np.abs(x).max(axis=1, keepdims=True)  # neither tiny nor huge components lose the norm
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _compare(threshold: float):
    def run(key, pdf):
        cell, i, j = (int(k) for k in key)
        x, ids, copies = _unit(pdf["v"]), pdf["id"].to_numpy(), pdf["copies"].to_numpy()
        cells = [np.asarray(c) for c in pdf["cells"]]
        side = pdf["side"].to_numpy()
        left, right = np.flatnonzero(side == 0), np.flatnonzero(side == (1 if i != j else 0))
        links, root, out = np.zeros(len(ids), np.int64), np.arange(len(ids)), []
        names, inverse = np.unique(np.concatenate(cells), return_inverse=True)
        # cells before this one that members share, as a bitmap: a pair with such a cell was counted there
        held = np.zeros((len(ids), len(names)), bool)
        held[np.repeat(np.arange(len(ids)), [len(c) for c in cells]), inverse] = True
        early = np.packbits(held[:, names < cell], axis=1)
        step = max(256, (16 << 20) // max(1, early.shape[1]))
        for lo in range(0, len(left), 512):
            rows = left[lo : lo + 512]
            near = x[rows] @ x[right].T >= threshold
            if i == j:
                near &= rows[:, None] < right[None, :]
            a, b = np.nonzero(near)
            if not len(a):
                continue
            a, b = rows[a], right[b]
            fresh = np.concatenate([~(early[a[k : k + step]] & early[b[k : k + step]]).any(1) for k in range(0, len(a), step)])
            np.add.at(links, a[fresh], copies[b[fresh]])
            np.add.at(links, b[fresh], copies[a[fresh]])
            while True:  # hang together what is linked; a few rounds
                ra, rb = root[a], root[b]
                low = np.minimum(ra, rb)
                if (ra == rb).all():
                    break
                np.minimum.at(root, ra, low)
                np.minimum.at(root, rb, low)
                while (root[root] != root).any():
                    root = root[root]
        hung = np.flatnonzero(root != np.arange(len(ids)))
        counted = np.flatnonzero(links)
        return pd.DataFrame({"a": np.concatenate([ids[counted], ids[hung]]), "b": pd.array([None] * len(counted) + ids[root[hung]].tolist(), dtype="Int64"), "links": np.concatenate([links[counted], np.zeros(len(hung), np.int64)])})
    return run


def embedding_dedup(vectors: DataFrame, threshold: float = 0.95, trees: int = 4, leaf: int = 400, spill: float = 0.02, seed: int = 11, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id, n_links, component_id, kept): links between vectors found with cosine >= threshold in double precision.

    Vectors that are null, zero, or hold null or non-finite components link with nothing and stand alone; so do rows with a
    null id, whose component is null. Lengths may differ between rows: only vectors of one length are compared. Equal vectors
    are one class, compared once with its number of copies; rows that share an id count each. An empty table gives no rows.

    Each tree's cells deal all vectors out; in a cell all are compared, block by block if it is large, so a dense group of any
    size is whole in its cell. A pair counts in its first common cell. Links leave a task as counts and a spanning forest.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark, "embeddings")
    v = F.col("v")
    good = F.col("id").isNotNull() & v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    rows = rows.select("id", F.transform("v", lambda x: x + F.lit(0.0)).alias("v"), F.coalesce(good, F.lit(False)).alias("good"))
    whole = scratch.save(rows.where("good").select("id", F.sha2(F.concat_ws(",", F.transform("v", lambda x: F.hex(x.cast("string")))), 256).alias("d"), "v"), "rows")
    classes = scratch.save(whole.groupBy("d").agg(F.min("id").alias("rep"), F.count("*").alias("copies"), F.first("v").alias("v")), "classes")
    parts = []
    for dims in [r[0] for r in classes.select(F.size("v")).distinct().collect()]:
        own = classes.where(F.size("v") == dims)
        n = own.count()
        sample = own.orderBy(F.xxhash64("d"), "d").limit(SAMPLE).select("v") if n > SAMPLE else own.select("v")
        x = _unit([r["v"] for r in sample.toLocalIterator()])
        forest = spark.sparkContext.broadcast(Forest(x, trees, max(8, leaf * len(x) // n), spill, seed))

        def deal(batches, forest=forest):
            for pdf in batches:
                if len(pdf):
                    yield pdf.assign(cells=[c.tolist() for c in forest.value.assign(_unit(pdf["v"]))])

        cells = scratch.save(own.select(F.col("rep").alias("id"), "copies", "v").mapInPandas(deal, "id long, copies long, v array<double>, cells array<int>"), f"cells{dims}")
        dealt = cells.withColumn("cell", F.explode("cells"))
        blocks = cells.select(F.explode("cells").alias("cell")).groupBy("cell").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
        # cells are as many as the sample's size allows, whatever the number of vectors
        dealt = dealt.join(F.broadcast(blocks), "cell").withColumn("mine", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        dealt = dealt.withColumn("i", F.least("mine", "other")).withColumn("j", F.greatest("mine", "other")).withColumn("side", (F.col("mine") > F.col("other")).cast("int"))
        parts.append(scratch.save(dealt.select("cell", "i", "j", "side", "id", "copies", "v", "cells").groupBy("cell", "i", "j").applyInPandas(_compare(threshold), "a long, b long, links long"), f"links{dims}"))
    found = parts[0] if parts else spark.createDataFrame([], "a long, b long, links long")
    for p in parts[1:]:
        found = found.unionByName(p)
    joined = scratch.save(connected_components(found.where("b is not null").select("a", "b"), scratch), "joined")
    degree = found.groupBy(F.col("a").alias("rep")).agg(F.sum("links").alias("links"))
    named = classes.select("d", "rep", "copies").join(degree, "rep", "left").join(joined.withColumnRenamed("node", "rep"), "rep", "left")
    named = scratch.save(named.select("d", "copies", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id")), "named")
    linked = attach(whole.select("id", "d"), named, "d", "copies", whole.count()).select("id", "n_links", "component_id")
    alone = rows.where("not good").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.col("id") == F.col("component_id"))
