"""Blocks that hold their voxels at one scale and move to a finer or coarser one when it has seen enough: the update of one block, and its batch form."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import morton

#: Where a scale's voxels begin in an array of a block's samples at all scales, finest first: 512, 64, 8 and 1 voxels.
OFFSETS = (0, 512, 576, 584, 585)
MAX_SCALE = 3


@dataclass(frozen=True)
class Rules:
    """max_weight caps weights; free: log-odds of a free observation; free_scale: scale of blocks that are only known to be free; a
    buffer takes over after `turns` frames, once it covers `share` of the volume that the current scale has observed."""

    max_weight: float = 20.0
    free: float = -5.015
    free_scale: int = 2
    turns: int = 20
    share: float = 0.9


@dataclass
class Side:
    """Voxels of a block at one scale: mean log-odds, weight, whether observed since this scale began."""

    scale: int = -1
    x: np.ndarray = field(default_factory=lambda: np.zeros(0))
    y: np.ndarray = field(default_factory=lambda: np.zeros(0))
    observed: np.ndarray = field(default_factory=lambda: np.zeros(0, bool))
    turns: int = 0

    @classmethod
    def empty(cls, scale: int) -> Side:
        n = (8 >> scale) ** 3
        return cls(scale, np.zeros(n), np.zeros(n), np.zeros(n, bool))

    def at(self, scale: int) -> Side:
        """A start at another scale: copies of the parents, or the means of the children with data."""
        n, out = 8 >> scale, Side.empty(scale)
        x, y = (a.reshape([8 >> self.scale] * 3) for a in (self.x, self.y))
        if scale < self.scale:
            by = 1 << self.scale - scale
            out.x, out.y = (a.repeat(by, 0).repeat(by, 1).repeat(by, 2).ravel() for a in (x, y))
        else:
            by = 1 << scale - self.scale
            parts = lambda a: a.reshape(n, by, n, by, n, by).transpose(0, 2, 4, 1, 3, 5).reshape(n**3, -1)
            known = parts(y) > 0
            many = np.maximum(known.sum(1), 1)
            out.x, out.y = (np.where(known, parts(x), 0).sum(1) / many, np.ceil(np.where(known, parts(y), 0).sum(1) / many))
        return out

    def take(self, samples: np.ndarray, rules: Rules) -> None:
        """One frame's samples of this scale's voxels, NaN where nothing is told."""
        told = ~np.isnan(samples)
        self.x[told] = (self.x[told] * self.y[told] + samples[told]) / (self.y[told] + 1)
        self.y[told] = np.minimum(self.y[told] + 1, rules.max_weight)
        self.observed |= told

    def volume(self) -> int:
        return int(self.observed.sum()) << 3 * self.scale


@dataclass
class Block:
    """The current scale and, while another one is wanted, a buffer at that one; last: the last frame taken."""

    current: Side = field(default_factory=Side)
    buffer: Side = field(default_factory=Side)
    last: int = -(1 << 62)

    def take(self, frame: int, wanted: int, free: bool, inside: bool, samples: np.ndarray | None, rules: Rules) -> None:
        """A frame: the scale that its distance asks for, whether the block lies free before all depths, whether it projects into valid
        pixels only, and its samples at all scales (None if free). Frames that were taken already change nothing."""
        if frame <= self.last:
            return
        self.last = frame
        old, fresh = self.current.scale, self.current.scale < 0
        loose = free and (fresh or self.current.x.max() < 0.95 * rules.free)
        low = rules.free_scale if loose else max(0, old - 1)
        high = MAX_SCALE if fresh else min(MAX_SCALE, old + 1)
        scale = min(max(low, wanted), high)
        part = lambda side: np.full(len(side.x), rules.free) if free else samples[OFFSETS[side.scale] : OFFSETS[side.scale + 1]]
        if fresh:
            self.current = Side.empty(scale)
        elif scale == old:
            self.buffer = Side()
        else:
            if scale != self.buffer.scale:
                self.buffer = self.current.at(scale)
            self.buffer.take(part(self.buffer), rules)
            enough = self.buffer.volume() >= rules.share * self.current.volume()
            self.buffer.turns += inside or enough
            if self.buffer.turns >= rules.turns and enough:
                self.current, self.buffer = self.buffer, Side()
                self.current.turns = 0
                return
        self.current.take(part(self.current), rules)

    def pack(self) -> tuple:
        """A row of plain values."""
        side = lambda s: (s.scale, s.x.astype("<f8").tobytes(), s.y.astype("<f8").tobytes(), np.packbits(s.observed).tobytes(), s.turns)
        return (*side(self.current), *side(self.buffer), self.last)

    @classmethod
    def unpack(cls, row: tuple) -> Block:
        def side(scale, x, y, observed, turns):
            x = np.frombuffer(x, "<f8").copy()
            return Side(scale, x, np.frombuffer(y, "<f8").copy(), np.unpackbits(np.frombuffer(observed, np.uint8), count=len(x)).astype(bool) if len(x) else np.zeros(0, bool), turns)

        return cls(side(*row[:5]), side(*row[5:10]), row[10])


STATE = "scale int, x binary, y binary, observed binary, turns int, bscale int, bx binary, by binary, bobserved binary, bturns int, last long"
INPUT = "key long, frame long, wanted int, free boolean, inside boolean, samples array<double>"
OUTPUT = "key long, frame long, scale int, buffer int, value array<double>, weight array<double>"


def take_rows(block: Block, rows: pd.DataFrame, rules: Rules) -> None:
    """A block's rows of INPUT, by frame."""
    for r in rows.sort_values("frame", kind="stable").drop_duplicates("frame").itertuples():
        samples = None if r.free else np.array([np.nan if v is None else v for v in r.samples], float)
        block.take(int(r.frame), int(r.wanted), bool(r.free), bool(r.inside), samples, rules)


def told(key: int, block: Block) -> pd.DataFrame:
    return pd.DataFrame({"key": [key], "frame": [block.last], "scale": [block.current.scale], "buffer": [block.buffer.scale], "value": [block.current.x.tolist()], "weight": [block.current.y.tolist()]})


def replay(updates: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """Each block's state (OUTPUT) after all its updates in the order of frames.

    updates: INPUT, or with samples as array<struct<i int, v double>> of those that tell something. A task reads its blocks' frames
    in order and holds one block and one batch of rows, however many frames there are.
    """
    sparse = "struct" in updates.schema["samples"].dataType.simpleString()

    def run(batches):
        now, block, last = None, None, None
        for batch in batches:
            key, frame, wanted, free, inside = (batch.column(c).to_pylist() for c in ("key", "frame", "wanted", "free", "inside"))
            listed = batch.column("samples")
            ends, flat = listed.offsets.to_numpy(), listed.values
            if sparse:
                place, flat = flat.field(0).to_numpy(), flat.field(1)
            flat = flat.to_numpy(zero_copy_only=False).astype(float)
            for r in range(len(key)):
                if key[r] != now:
                    if now is not None:
                        yield pa.RecordBatch.from_pandas(told(now, block), schema=schema, preserve_index=False)
                    now, block, last = key[r], Block(), None
                if frame[r] == last:
                    continue
                last, samples, a, b = frame[r], None, ends[r], ends[r + 1]
                if not free[r]:
                    samples = np.full(OFFSETS[-1], np.nan) if sparse else flat[a:b]
                    if sparse:
                        samples[place[a:b]] = flat[a:b]
                block.take(int(frame[r]), int(wanted[r]), bool(free[r]), bool(inside[r]), samples, rules)
        if now is not None:
            yield pa.RecordBatch.from_pandas(told(now, block), schema=schema, preserve_index=False)

    wide = pa.list_(pa.float64())
    schema = pa.schema([("key", pa.int64()), ("frame", pa.int64()), ("scale", pa.int32()), ("buffer", pa.int32()), ("value", wide), ("weight", wide)])
    ordered = updates.select("key", "frame", "wanted", "free", "inside", "samples").repartition("key").sortWithinPartitions("key", "frame")
    return ordered.mapInArrow(run, OUTPUT)


def push_down(frees: DataFrame, blocks: DataFrame, depth_of_map: int) -> DataFrame:
    """(frame, key): the blocks of a map that lie in octants which frames free; octants without blocks below stay whole, as (frame, key) too.

    frees: frame, key at any depth; blocks: key. An equi-join on the blocks' ancestors.
    """
    above = blocks.select("key").distinct().select(F.col("key").alias("block"), F.explode(F.concat(F.array("key"), morton.ancestors(F.col("key"), depth_of_map))).alias("key"))
    joined = frees.select("frame", "key").distinct().join(above, "key", "left")
    return joined.select("frame", F.coalesce("block", "key").alias("key")).distinct()


def voxels(states: DataFrame, depth_of_map: int) -> DataFrame:
    """(x, y, z, scale, value, weight) of voxels with data, from states."""
    at = F.posexplode(F.arrays_zip("value", "weight")).alias("i", "v")
    rows = states.select("key", "scale", *[c.alias("b" + k) for c, k in zip(morton.coords(F.col("key"), depth_of_map), "xyz")], at).where("v.weight > 0")
    n = F.call_function("shiftright", F.lit(8), F.col("scale"))
    stride = F.call_function("shiftleft", F.lit(1), F.col("scale"))
    z, y, x = F.floor(F.col("i") / (n * n)), F.floor(F.col("i") / n) % n, F.col("i") % n  # z varies slowest
    return rows.select(*[(F.col("b" + k) + c * stride).cast("long").alias(k) for k, c in zip("xyz", (x, y, z))], "scale", F.col("v.value").alias("value"), F.col("v.weight").alias("weight"))
