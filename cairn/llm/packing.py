"""Best-fit packing of token pieces into sequences: large items pair by greedy matching, smaller ones fill the gaps best-fit."""

from __future__ import annotations

import bisect
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, in_task, text_slices
from .encoding import Encoder, with_ends

_PIECE = ["id", "piece", "start", "length", "ids_crc32", "task", "number"]
_OUT = ["id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]


def plan_bins(counts: dict[int, int], capacity: int) -> tuple[list[tuple[int, int, int, int, int, int]], int]:
    """Packs counts[length] items of each length; (ranges, number of bins).

    A range (length, first, until, copies, bin, offset) says: of the items of that length, numbers first to until go into
    consecutive bins from bin on, copies of them in each, one after another from offset. Items of over a third of the capacity
    stand at most two to a bin: from the largest down, each is matched with the largest that still fits. Then smaller ones,
    from the largest down, go where the least gap remains. Bins of equal gap are handled together, so the work depends on
    the number of lengths and not of items.
    """
    left, used, ranges, bins = dict(counts), Counter(), [], 0
    classes: dict[int, list[tuple[int, int]]] = {}  # gap -> runs of (first bin, bins)

    def put(length: int, copies: int, first: int, many: int, offset: int) -> None:
        n = copies * many
        ranges.append((length, used[length], used[length] + n, copies, first, offset))
        used[length] += n
        left[length] -= n

    large = sorted(x for x in counts if 3 * x > capacity)
    for a in reversed(large):
        while left[a]:
            fits = [b for b in large[: bisect.bisect_right(large, min(a, capacity - a))] if left[b] > (b == a)]
            b = fits[-1] if fits else None
            many = left[a] if b is None else left[a] // 2 if b == a else min(left[a], left[b])
            put(a, 2 if b == a else 1, bins, many, 0)
            if b is not None and b != a:
                put(b, 1, bins, many, a)
            classes.setdefault(capacity - a - (b or 0), []).append((bins, many))
            bins += many
    gaps = sorted(classes)
    for s in sorted((x for x in counts if 3 * x <= capacity), reverse=True):
        while left[s]:
            at = bisect.bisect_left(gaps, s)
            if at == len(gaps):
                each = capacity // s
                many = max(1, left[s] // each)
                classes.setdefault(capacity, []).append((bins, many))
                bins += many
                bisect.insort(gaps, capacity) if capacity not in gaps else None
                continue
            gap = gaps[at]
            first, many = classes[gap].pop()
            each = min(gap // s, left[s])
            full = min(many, left[s] // each)
            put(s, each, first, full, capacity - gap)
            for g, run in ((gap - each * s, (first, full)), (gap, (first + full, many - full))):
                if run[1]:
                    if not classes.get(g):
                        classes[g] = []
                        if g not in gaps:
                            bisect.insort(gaps, g)
                    classes[g].append(run)
            if not classes[gap]:
                gaps.remove(gap)
    return ranges, bins


def pack(docs: DataFrame, tokenizer_path: str, kind: str = "bytes", end_id: int = 2, capacity: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, piece, start, length, ids_crc32, sequence_id, offset): a row for each piece of each row of docs.

    A row's ids are its text's and the end id; over capacity they are cut so that all pieces but the first are full. Pieces
    never straddle sequences, and a sequence's pieces follow one another without gaps from 0. Packing is planned on the
    counts of lengths (at most `capacity` numbers, all that the driver sees), and pieces find their places by their number
    among those of their length. Null and empty texts are one piece with the end id. Repeated rows are packed each; null
    ids stay null. Other columns of docs are not read, whatever their names. An empty table gives no rows.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "packing")

    @in_task("encoding")
    def cut(batches):
        encoder, seen = Encoder.of(tokenizer_path, kind), np.zeros(capacity + 1, np.int64)
        task = TaskContext.get().partitionId()
        for batch in text_slices(batches):
            ids, counts = with_ends(*encoder.encode(batch.column("text")), end_id)
            pieces = (counts - 1) // capacity + 1
            row = np.repeat(np.arange(len(counts)), pieces)
            piece = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            first = (counts - 1) % capacity + 1
            start = np.where(piece > 0, first[row] + (piece - 1) * capacity, 0)
            length = np.where(piece > 0, capacity, first[row])
            at = (np.cumsum(counts) - counts)[row] + start
            crc = [zlib.crc32(ids[i:j]) for i, j in zip(at.tolist(), (at + length).tolist())]
            # each piece's number among those of its length in this task
            order = np.argsort(length, kind="stable")
            runs = np.searchsorted(length[order], np.arange(capacity + 2))
            number = np.empty(len(length), np.int64)
            number[order] = np.arange(len(length)) - runs[length[order]] + seen[length[order]]
            seen += np.diff(runs)
            yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(row)), *(pa.array(x, pa.int64()) for x in (piece, start, length, crc, np.full(len(row), task), number))], _PIECE)

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    pieces = scratch.save(rows.mapInArrow(cut, ", ".join(f"{c} long" for c in _PIECE)), "pieces")
    by_task = scratch.save(pieces.groupBy("length", "task").agg(F.count("*").alias("n")), "counts")
    ranges, _ = plan_bins({r["length"]: r["n"] for r in by_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}, capacity)
    before = F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # a row for each length and task: too many for a broadcast when tasks are many, so the pieces' few columns are shuffled
    before = by_task.select("length", "task", before.alias("before"))
    numbered = pieces.join(before.hint("merge"), ["length", "task"]).select("id", "piece", "start", "length", "ids_crc32", (F.col("number") + F.col("before")).alias("number"))
    # as many ranges as there are pairs of lengths in one bin at most, whatever the number of pieces
    plan = np.array(sorted(ranges), np.int64).reshape(len(ranges), 6)
    plan = spark.sparkContext.broadcast(plan)

    @in_task("encoding")
    def place(batches):
        length, first, _, copies, bins, offset = plan.value.T
        least = np.searchsorted(length, np.arange(capacity + 2))
        for batch in batches:
            if not batch.num_rows:
                continue
            n, k = (batch.column(c).to_numpy() for c in ("length", "number"))
            at = np.empty(len(n), np.int64)
            for x in np.unique(n).tolist():  # a binary search among the ranges of each length
                own = n == x
                at[own] = least[x] + np.searchsorted(first[least[x] : least[x + 1]], k[own], "right") - 1
            k = k - first[at]
            found = bins[at] + k // copies[at], offset[at] + k % copies[at] * n
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in _OUT[:5]), *map(pa.array, found)], _OUT)

    placed = numbered.mapInArrow(place, ", ".join(f"{c} long" for c in _OUT))
    return placed.withColumn("piece", F.col("piece").cast("int"))
