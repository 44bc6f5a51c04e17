"""Importance resampling towards a target distribution: n-gram buckets counted and scored in tries of words that are local to a task."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, in_task, text_buffer, text_slices

#: Bytes of words: digits, letters and all bytes of code points beyond ASCII; A-Z become a-z.
_WORD = np.zeros(256, bool)
_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


class Trie:
    """All runs of 1 to n consecutive words of some texts. Level k holds a node for each distinct run of k words.

    A node has the number of its run's occurrences and the CRC of the run's bytes; a child's CRC goes on from its parent's
    state, so no run's text is ever built. path[k] leads from each occurrence to its node.
    """

    def __init__(self, column: pa.Array, n: int):
        data, offsets = text_buffer(column)
        base = int(offsets[0])
        data, offsets = data[base : int(offsets[-1])], offsets - base
        inside = _WORD[data]
        start = inside.copy()
        start[1:] &= ~inside[:-1]
        begins = offsets[:-1][offsets[:-1] < len(data)]
        start[begins] = inside[begins]  # a text's first word doesn't go on from the text before it
        at = np.flatnonzero(start)
        upto = np.concatenate([[0], np.cumsum(inside)])
        bounds = np.concatenate([upto[at], upto[-1:]]).astype(np.int64)
        words = pa.Array.from_buffers(pa.large_binary(), len(at), [None, pa.py_buffer(bounds), pa.py_buffer(_LOWER[data[inside]])]).dictionary_encode()
        self.n_words = np.diff(np.searchsorted(at, offsets))
        self._of = np.repeat(np.arange(len(self.n_words)), self.n_words)
        word, names = words.indices.to_numpy(zero_copy_only=False).astype(np.int64), words.dictionary.to_pylist()
        tails = [b" " + x for x in names]
        self.path, self.texts = [word], [self._of]
        self.count, self.crc = [np.bincount(word, minlength=len(names))], [np.fromiter(map(zlib.crc32, names), np.int64, len(names))]
        for k in range(1, n):
            whole = self._of[k:] == self._of[: len(self._of) - k] if len(word) > k else np.zeros(0, bool)
            child = self.path[-1][: len(whole)] if k == 1 else self._level[: len(whole)]
            nodes, path, count = np.unique(child[whole] * len(names) + word[k:][whole], return_inverse=True, return_counts=True)
            parent, tail = np.divmod(nodes, max(1, len(names)))
            states = map(zlib.crc32, map(tails.__getitem__, tail.tolist()), self.crc[-1][parent].tolist())
            self.path.append(path)
            self.texts.append(self._of[: len(whole)][whole])
            self.count.append(count)
            self.crc.append(np.fromiter(states, np.int64, len(nodes)))
            self._level = np.zeros(len(whole), np.int64)  # node of the run that begins at each word; used where the run is whole
            self._level[whole] = path

    def totals(self, buckets: int) -> np.ndarray:
        """Features in each bucket."""
        out = np.zeros(buckets, np.int64)
        for count, crc in zip(self.count, self.crc):
            np.add.at(out, crc % buckets, count)
        return out

    def sums(self, gains: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each text's features, and the sum of the gains attached to their nodes."""
        n, total = np.zeros(len(self.n_words), np.int64), np.zeros(len(self.n_words), np.int64)
        for path, of, crc in zip(self.path, self.texts, self.crc):
            ends = np.searchsorted(of, np.arange(len(n) + 1))
            n += np.diff(ends)
            upto = np.concatenate([[0], np.cumsum(gains[crc % len(gains)][path])])
            total += np.diff(upto[ends])
        return n, total


def bucket_totals(texts: DataFrame, buckets: int, n: int, text_col: str = "text") -> DataFrame:
    """(bucket, n) over all texts: each task sums its tries' counts by bucket, and the sums are merged."""
    @in_task("tries")
    def count(batches):
        out = np.zeros(buckets, np.int64)
        for batch in text_slices(batches):
            out += Trie(batch.column("text"), n).totals(buckets)
        at = np.flatnonzero(out)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(out[at])], ["bucket", "n"])

    return texts.select(F.col(text_col).alias("text")).mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(source: DataFrame, target: DataFrame, buckets: int) -> np.ndarray:
    """floor(1000 ln) of how much likelier each bucket is in the target than in the source, both smoothed by one."""
    s, t = np.zeros(buckets), np.zeros(buckets)
    for out, totals in ((s, source), (t, target)):
        for r in totals.toLocalIterator():  # buckets rows at most
            out[r["bucket"]] = r["n"]
    return np.floor(1000 * np.log((t + 1) * (s.sum() + buckets) / ((s + 1) * (t.sum() + buckets)))).astype(np.int64)


def noise(id_col: Column, seed: int) -> Column:
    """Gumbel noise of an id, in thousandths: drawing the highest weight + noise draws without replacement in proportion to exp(weight / 1000)."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), id_col.cast("string")), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def resample(docs: DataFrame, target: DataFrame, n: int = 2, buckets: int = 10_000, percent: int = 25, least_words: int = 20, seed: int = 7, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text") -> DataFrame:
    """(id, n_words, n_features, weight, score, rank): documents drawn as if from the target's distribution of n-gram buckets.

    weight: the floored mean of the gains of a document's features (all runs of 1 to n words, repeats counted; none: 0).
    score: weight and seeded noise. Of the N documents with at least least_words words, floor(percent * N / 100) of the highest
    scores are drawn, ties to the smaller id; rank numbers them, and is null for others. Null texts have no words. Rows with a
    null id have no score, don't count in N and are never drawn. Rows that share an id are ranked each; ties among them go to
    the smaller weight, then fewer features. Other columns are not read, whatever their names. An empty table gives no rows.
    Only bucket totals (`buckets` numbers) and the number of rows in each range of scores reach the driver.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "resampling")
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    gain = spark.sparkContext.broadcast(gains(bucket_totals(rows, buckets, n), bucket_totals(target, buckets, n, target_col), buckets))

    @in_task("tries")
    def weigh(batches):
        for batch in text_slices(batches):
            trie = Trie(batch.column("text"), n)
            features, total = trie.sums(gain.value)
            yield pa.RecordBatch.from_arrays([batch.column("id"), *map(pa.array, (trie.n_words.astype(np.int64), features, total // np.maximum(1, features)))], ["id", "n_words", "n_features", "weight"])

    weighed = rows.mapInArrow(weigh, "id long, n_words long, n_features long, weight long")
    scored = scratch.save(weighed.withColumn("score", F.col("weight") + noise(F.col("id"), seed)), "scored")
    open_set = F.col("id").isNotNull() & (F.col("n_words") >= least_words)

    # ranks: rows sorted by ranges of scores are numbered in each range, and the ranges' sizes give what stands before them
    @in_task("tries")
    def number(batches):
        task, upto = TaskContext.get().partitionId(), 0
        for batch in batches:
            k = np.arange(upto, upto + batch.num_rows)
            upto += batch.num_rows
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(batch.num_rows, task)), pa.array(k)], [*batch.schema.names, "range", "number"])

    order = [F.desc("score"), F.asc("id"), F.asc("weight"), F.asc("n_features")]
    ranged = scored.where(open_set).repartitionByRange(*order).sortWithinPartitions(*order)
    numbered = scratch.save(ranged.mapInArrow(number, "id long, n_words long, n_features long, weight long, score long, range long, number long"), "numbered")
    before, upto = [], 0
    for r in numbered.groupBy("range").agg(F.count("*").alias("n")).orderBy("range").collect():
        before.append((r["range"], upto))
        upto += r["n"]
    drawn = percent * upto // 100
    starts = spark.createDataFrame(before, "range long, before long")
    rank = F.col("number") + F.col("before") + 1
    ranked = numbered.join(F.broadcast(starts), "range").withColumn("rank", F.when(rank <= drawn, rank))
    names = ["id", "n_words", "n_features", "weight", "score", "rank"]
    return ranked.select(names).unionByName(scored.where(~open_set).withColumn("rank", F.lit(None).cast("long")).select(names))
