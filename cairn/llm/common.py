"""What the operators of this subpackage share: scratch tables, skew-safe lookups, connected components and word hashes."""

from __future__ import annotations

import os
import sys
import tempfile
import time
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space that separates words and is stripped from lines.
SPACES = " \t\n\x0b\x0c\r"
SPACE_CLASS = r"[\x20\x09-\x0D]"
WORD_CLASS = r"[^\x20\x09-\x0D]+"


def shared_root(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which all executors see; a temporary one only where it is unset on a local master (tests)."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = "file://" + os.path.join(tempfile.gettempdir(), "cairn-checkpoints")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


class Scratch:
    """Tables written to the shared folder: they cut lineage, are computed once, and survive the loss of executors."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.path = spark, f"{shared_root(spark)}/cairn-{name}-{uuid.uuid4().hex}"

    def save(self, df: DataFrame, label: str) -> DataFrame:
        df.write.mode("overwrite").option("compression", "zstd").parquet(f"{self.path}/{label}")
        return self.spark.read.schema(df.schema).parquet(f"{self.path}/{label}")

    def drop(self, *labels: str) -> None:
        """Deletes tables that no later step reads."""
        for label in labels:
            jvm = self.spark.sparkContext._jvm
            path = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{label}")
            path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


#: No more hot keys than this are ever broadcast: a hot key has over 1/MAX_HOT of the rows.
MAX_HOT = 1000


def attach(rows: DataFrame, groups: DataFrame, key: str, count: str, total: int, how: str = "inner") -> DataFrame:
    """Joins each row with the single row of its group, however large the group is.

    groups holds one row for each key, with the number of its rows in column count; these add up to at most total. Keys with
    over total / MAX_HOT rows number at most MAX_HOT, so they are broadcast and their rows need no shuffle; for all others
    a shuffled join follows, in which no key has more rows than that. Both inputs should be written tables. how: inner or left.
    """
    bound = max(1000, total // MAX_HOT)
    hot = F.broadcast(groups.where(F.col(count) > bound))
    rest = groups.where(F.col(count) <= bound)
    cold_rows = rows.join(F.broadcast(groups.where(F.col(count) > bound).select(key)), key, "left_anti")
    return rows.join(hot, key, "inner").unionByName(cold_rows.join(rest, key, how))


def prefilter(rows: DataFrame, wanted: DataFrame, key: str, most_bits: int = 1 << 27) -> DataFrame:
    """Rows whose key is in wanted, and a few others: a bitmap of key hashes is broadcast, so that only these rows are shuffled later.

    The bitmap has 16 bits for each wanted row, but never more than most_bits (16 MB): beyond, more rows pass.
    """
    bits = 1 << max(15, min(most_bits.bit_length() - 1, (16 * wanted.count()).bit_length()))

    def place(df: DataFrame) -> DataFrame:
        return df.withColumn("__at", F.pmod(F.xxhash64(key), F.lit(bits))).withColumns({"__bucket": F.expr("bitmap_bucket_number(__at)"), "__bit": F.expr("bitmap_bit_position(__at)")})

    bitmap = place(wanted.select(key)).groupBy("__bucket").agg(F.expr("bitmap_construct_agg(__bit)").alias("__bitmap"))
    byte = F.conv(F.hex(F.expr("substring(__bitmap, cast(__bit div 8 as int) + 1, 1)")), 16, 10).cast("int")
    hit = F.expr("shiftright(__byte, cast(__bit % 8 as int)) & 1") == 1
    return place(rows).join(F.broadcast(bitmap), "__bucket").withColumn("__byte", byte).where(hit).select(*rows.columns)


def connected_components(edges: DataFrame, scratch: Scratch, label: str = "cc") -> DataFrame:
    """(node, component): for each node of an edge, the smallest node that edges lead to.

    edges: long columns a and b, nulls and loops are left out. Alternates the two star operations (each edge's larger end is
    hung on the smallest neighbour of its smaller end, then each node's smaller neighbours on the smallest of them) until all
    edges point to roots. Minima are pre-aggregated, and hub nodes go through attach(), so no node's neighbours meet in one task.
    """
    u, v = F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")
    now = scratch.save(edges.where("a <> b").select(u, v).distinct(), f"{label}0")
    step = 0
    while True:
        nodes = now.count()
        if not nodes or not now.groupBy("u").agg(F.count("*").alias("n")).where("n > 1").limit(1).count() and not now.join(now.select(F.col("u").alias("v")), "v", "left_semi").limit(1).count():
            return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
        both = now.select(F.col("v").alias("x"), F.col("u").alias("y"), F.lit(1).alias("n")).unionByName(now.select(F.col("u").alias("x"), F.col("v").alias("y"), F.lit(0).alias("n")))
        least = scratch.save(both.groupBy("x").agg(F.least(F.col("x"), F.min("y")).alias("m"), F.sum("n").alias("n")).withColumnRenamed("x", "v"), f"{label}{step}m")
        large = scratch.save(attach(now, least, "v", "n", nodes).select("u", F.col("m").alias("v")).distinct(), f"{label}{step}l")
        low = scratch.save(large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")), f"{label}{step}s")
        total = large.count()
        near = attach(large, low, "u", "n", total).select("u", "v", "m")
        after = near.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))).distinct()
        now_after = scratch.save(after, f"{label}{step + 1}")
        scratch.drop(*(f"{label}{step}{x}" for x in ("", "m", "l", "s")))
        now, step = now_after, step + 1


# ---- memory of Python workers, which serve one stage after another

_KEPT: dict[str, dict] = {}
_given = 0.0


def kept(name: str) -> dict:
    """What a worker keeps for an operator from task to task; gone when it is given a task of another one."""
    return _KEPT.setdefault(name, {})


def give_back(every: float = 0.0) -> None:
    """Returns freed memory to the system, as allocators would keep it while the worker stands idle; at most once in so many seconds."""
    global _given
    if time.monotonic() - _given >= every:
        pa.default_memory_pool().release_unused()
        if sys.platform == "linux":
            import ctypes

            ctypes.CDLL(None).malloc_trim(0)
        _given = time.monotonic()


def _enter(name: str) -> None:
    for other in _KEPT.keys() - {name}:
        _KEPT[other].clear()


def in_task(name: str):
    """For functions over a task's batches: forgets what other operators kept, and gives memory back at the end."""
    def wrap(run):
        def inner(batches):
            _enter(name)
            try:
                yield from run(batches)
            finally:
                give_back()

        return inner

    return wrap


def in_group(name: str):
    """The same for functions of one group."""
    def wrap(run):
        def inner(pdf):
            _enter(name)
            try:
                return run(pdf)
            finally:
                give_back(1.0)

        return inner

    return wrap


# ---- hashes of words, in numpy within tasks

_RNG = np.random.default_rng(20240607)
_BYTE = _RNG.integers(0, 2**64, 256, dtype=np.uint64) | np.uint64(1)
for _c in range(65, 91):
    _BYTE[_c] = _BYTE[_c + 32]
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BYTE[_IS_SPACE] = 0
_WINDOW = 1 << 19
_BASE = 0x9E3779B97F4A7C15
_POWERS: list[np.ndarray] = []


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads each bit over all."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _powers() -> list[np.ndarray]:
    if not _POWERS:
        for base in (_BASE, pow(_BASE, -1, 2**64)):
            p = np.full(_WINDOW, base, np.uint64)
            p[0] = 1
            _POWERS.append(np.multiply.accumulate(p))
    return _POWERS


def _window(data: np.ndarray, fresh: np.ndarray, base: int) -> tuple[np.ndarray, np.ndarray]:
    """Sums of bytes times powers of the base, and where the words begin."""
    space = _IS_SPACE[data]
    start = ~space
    start[1:] &= space[:-1] | fresh[1:]
    starts = np.flatnonzero(start)
    if not len(starts):
        return np.empty(0, np.uint64), starts
    power, inverse = _powers()
    return np.add.reduceat(_BYTE[data] * power[: len(data)], starts) * inverse[starts], starts + base


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words (A-Z lower-cased) of UTF-8 texts in one buffer, and how many each text has.

    offsets: where each text begins, and the end. Works through windows of half a MB, cut at white space or between texts;
    the sum of a word that is longer goes on in the next window.
    """
    begin, end = int(offsets[0]), int(offsets[-1])
    hashes, starts, at, open_length = [], [], begin, 0
    while at < end:
        stop, cut = min(end, at + _WINDOW), True
        if stop < end:
            spaces = np.flatnonzero(_IS_SPACE[data[at:stop]])
            text = int(offsets[np.searchsorted(offsets, stop, "right") - 1])
            last = max(at + int(spaces[-1]) + 1 if len(spaces) else 0, text if text > at else 0)
            stop, cut = last or stop, bool(last)
        part = data[at:stop]
        fresh = np.zeros(len(part), bool)
        inside = offsets[np.searchsorted(offsets, at) : np.searchsorted(offsets, stop)] - at
        fresh[inside] = True
        h, s = _window(part, fresh, at)
        if open_length and len(s) and s[0] == at and not fresh[0]:  # the rest of a word
            power = pow(_BASE, open_length, 2**64)
            hashes[-1][-1] = (int(hashes[-1][-1]) + int(h[0]) * power) % 2**64
            h, s = h[1:], s[1:]
        if len(s):
            hashes.append(h)
            starts.append(s)
        open_length = 0 if cut else stop - int(starts[-1][-1])
        at = stop
    if not hashes:
        return np.empty(0, np.uint64), np.zeros(len(offsets) - 1, np.int64)
    at = np.concatenate(starts)
    return mix(np.concatenate(hashes)), np.diff(np.searchsorted(at, offsets)).astype(np.int64)


def text_buffer(column) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and offsets of an Arrow string column; null counts as empty."""
    import pyarrow.compute as pc

    column = pc.fill_null(column.cast(pa.large_string()), "")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    raw = column.buffers()
    offsets = np.frombuffer(raw[1], np.int64)[column.offset : column.offset + len(column) + 1] if raw[1] else np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(raw[2], np.uint8) if raw[2] is not None and raw[2].size else np.empty(0, np.uint8), offsets


def text_slices(batches, most: int = 8 << 20, text: str = "text"):
    """Record batches cut so that none holds over `most` bytes of text, but for single rows that are longer."""
    import pyarrow.compute as pc

    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        upto, lo = np.concatenate([[0], np.cumsum(sizes)]), 0
        while lo < batch.num_rows:
            hi = max(lo + 1, int(np.searchsorted(upto, upto[lo] + most, "right")) - 1)
            yield batch.slice(lo, hi - lo)
            lo = hi
