"""Substring dedup: windows of words counted exactly, dealt out as super-k-mers, runs of windows that share a minimiser."""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACES, Scratch, attach, in_group, in_task, text_buffer, text_slices, word_hashes

#: Words of a minimiser: the run of words of the least hash within a window.
MINIMISER = 6
#: Windows of a super-k-mer at most; longer runs are cut.
RUN = 512
#: Bits of the filter of minimisers that occur twice, at most (32 MB): beyond, more super-k-mers travel, with the same results.
MAX_BITS = 1 << 28
#: Super-k-mers in a bucket, about; a minimiser with more than HOT of them is dealt out by its windows instead.
BUCKET, HOT = 20_000, 10_000

_SPACE = np.zeros(256, bool)
_SPACE[list(SPACES.encode())] = True
_CUT = "id long, key long, lo long, hi long"


def _slid(x: np.ndarray, width: int, least) -> np.ndarray:
    """least (np.minimum or np.maximum) of each `width` neighbours, in about log2(width) passes."""
    span = 1
    while 2 * span <= width:
        x, span = least(x[:-span], x[span:]), 2 * span
    return least(x[: len(x) - width + span], x[width - span :]) if width > span else x


class Windows:
    """The windows of some texts and their minimisers."""

    def __init__(self, column: pa.Array, size: int):
        data, offsets = text_buffer(column)
        base = int(offsets[0])
        self.data, self.offsets, self.size = data[base : int(offsets[-1])], offsets - base, size
        hashes, self.n_words = word_hashes(self.data, self.offsets) if len(self.data) else (np.empty(0, np.uint64), np.zeros(len(column), np.int64))
        self.of = np.repeat(np.arange(len(self.n_words)), self.n_words)
        self.first = np.cumsum(self.n_words) - self.n_words
        m = min(MINIMISER, size)
        self.least, self.valid, self.taken = np.empty(0, np.uint64), np.empty(0, bool), np.empty(0, np.uint64)
        if len(hashes) < size:
            return
        grams = hashes[: len(hashes) - m + 1].copy()
        for j in range(1, m):
            grams = grams * np.uint64(0x9E3779B97F4A7C15) + hashes[j : len(hashes) - m + 1 + j]
        grams |= np.uint64(1)
        width = size - m + 1
        self.least = _slid(grams, width, np.minimum)
        self.valid = self.of[: len(hashes) - size + 1] == self.of[size - 1 :]
        # a run of words is some window's minimiser if the greatest minimum of the windows around it is its own hash
        around = np.concatenate([np.zeros(width - 1, np.uint64), np.where(self.valid, self.least, np.uint64(0)), np.zeros(width - 1, np.uint64)])
        self.taken = grams[_slid(around, width, np.maximum)[: len(grams)] == grams]

    def runs(self) -> tuple[np.ndarray, np.ndarray]:
        """First window and number of windows of each super-k-mer."""
        change = self.valid.copy()
        change[1:] &= ~self.valid[:-1] | (self.least[1:] != self.least[:-1])
        starts = np.flatnonzero(change)
        stops = np.flatnonzero(self.valid & np.append(~self.valid[1:] | (self.least[1:] != self.least[:-1]), True)) + 1 if len(self.valid) else starts
        cut = (stops - starts - 1) // RUN + 1
        at = np.repeat(starts, cut) + RUN * (np.arange(cut.sum()) - np.repeat(np.cumsum(cut) - cut, cut))
        return at, np.minimum(RUN, np.repeat(stops, cut) - at)

    def packed(self, at: np.ndarray, words: np.ndarray) -> pa.Array:
        """Strings of some words each, from word `at` on, with one space between words."""
        space = _SPACE[self.data]
        start = ~space
        start[1:] &= space[:-1]
        begins = self.offsets[:-1][self.offsets[:-1] < len(self.data)]
        start[begins] = ~space[begins]
        length = np.add.reduceat(~space, np.flatnonzero(start), dtype=np.int64) if start.any() else np.empty(0, np.int64)
        begin = np.concatenate([[0], np.cumsum(length + 1)])  # of each word in a buffer of all words with a space behind each
        flat = np.full(begin[-1], 32, np.uint8)
        inner = np.ones(len(flat), bool)
        inner[begin[1:] - 1] = False
        flat[inner] = self.data[~space]
        return _strings(flat, begin[at], begin[at + words] - 1)


def _strings(flat: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> pa.Array:
    """flat[lo:hi] for each lo and hi."""
    bounds = np.concatenate([[0], np.cumsum(hi - lo)]).astype(np.int64)
    out = flat[np.repeat(lo - bounds[:-1], hi - lo) + np.arange(bounds[-1])]
    return pa.Array.from_buffers(pa.large_string(), len(lo), [None, pa.py_buffer(bounds), pa.py_buffer(out)])


def _joined(doc: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ranges of each doc (a number), those that touch or overlap joined."""
    if not len(doc):
        return doc, lo, hi
    order = np.lexsort((lo, doc))
    doc, lo, hi = doc[order], lo[order], hi[order]
    span = int(hi.max()) + 1
    reach = np.maximum.accumulate(doc.astype(np.int64) * span + hi) - doc.astype(np.int64) * span
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (lo[1:] > reach[:-1])
    at = np.flatnonzero(new)
    return doc[at], lo[at], reach[np.append(at[1:], len(doc)) - 1]


def _not_first(group: np.ndarray, id: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which places stand behind another one of their group, and one first place of each group, by group."""
    order = np.lexsort((start, id, group))
    g, i, s = group[order], id[order], start[order]
    new = np.ones(len(g), bool)
    new[1:] = g[1:] != g[:-1]
    head = np.maximum.accumulate(np.where(new, np.arange(len(g)), 0))
    behind = np.empty(len(g), bool)
    behind[order] = (i != i[head]) | (s != s[head])
    return behind, order[new]


def _pairs(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A number for each distinct pair."""
    return np.unique(a.astype(np.uint64) << np.uint64(32) | b.astype(np.uint64), return_inverse=True)[1]


def _windows_of(packed: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of super-k-mers' windows: the super-k-mer, the word it begins with therein, its number among distinct windows, its place among all words.

    Distinct words are numbered, then distinct runs of 2, 4, 8 ... words by sorting pairs of numbers, so equal numbers mean
    equal words and no hash decides.
    """
    lists = pc.split_pattern(packed, " ")
    words = lists.values.slice(lists.offsets[0].as_py(), lists.offsets[-1].as_py() - lists.offsets[0].as_py()).dictionary_encode()
    n_words = np.diff(lists.offsets.to_numpy())
    rank, span, parts = words.indices.to_numpy(zero_copy_only=False), 1, []
    left = size
    while True:
        if left & 1:
            parts.append((rank, span))
        left >>= 1
        if not left:
            break
        rank, span = _pairs(rank[: len(rank) - span], rank[span:]), 2 * span
    n = n_words - size + 1
    of = np.repeat(np.arange(len(n)), n)
    start = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
    at = np.repeat(np.cumsum(n_words) - n_words, n) + start
    number, shift = None, 0
    for rank, span in parts:
        number = rank[at + shift] if number is None else _pairs(number, rank[at + shift])
        shift += span
    return of, start, number, at


def dedup_substrings(docs: DataFrame, window: int = 20, id_col: str = "doc_id", text_col: str = "text", max_bits: int = MAX_BITS, hot: int = HOT) -> DataFrame:
    """(id, n_words, n_removed, kept_text): texts without the words of windows that begin somewhere earlier too.

    A window is `window` consecutive words of a text; words are what ASCII white space separates, unchanged. A word goes if a
    window over it has the same words as one that begins earlier: in a document of a smaller id, or further ahead in the same
    one. Windows are those of the input. The words kept are joined by one space. Null and empty texts have no words. Rows that
    share an id are one document for this: windows that begin at the same word of either are at the same place, and neither
    is earlier. Rows with a null id are never compared and stay whole. Other columns are not read, whatever their names. An
    empty table gives no rows.

    Windows travel only where their minimiser occurs twice, several in one string, once for each distinct string of a task's
    slice; all but the first place of such a string go at once. Each bucket of minimisers sorts its windows. A minimiser that
    stands in over `hot` strings is dealt out by windows, whose first places are pre-aggregated.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "substrings")
    every = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    rows = every.where("id is not null").withColumn("key", F.xxhash64("text"))  # the key tells texts under one id apart

    @in_task("substrings")
    def minimisers(batches):
        for batch in text_slices(batches):
            grams, n = np.unique(Windows(batch.column("text"), window).taken, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(grams.view(np.int64)), pa.array(n)], ["gram", "n"])

    grams = rows.select("text").mapInArrow(minimisers, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))
    twice = scratch.save(grams.where("n > 1").select("gram"), "twice")
    repeated = twice.count()
    bits = 1 << max(15, min(int(max_bits).bit_length() - 1, (16 * repeated).bit_length()))
    place = twice.select(F.expr(f"gram & {bits - 1}L").alias("at")).select(F.expr("bitmap_bucket_number(at)").alias("b"), F.expr("bitmap_bit_position(at)").alias("p"))
    bitmap = np.zeros(bits // 8, np.uint8)
    # Spark's bitmaps count positions from 1 and hold 4096 bytes, the lowest bit first
    for r in place.groupBy("b").agg(F.expr("bitmap_construct_agg(p)").alias("m")).toLocalIterator():
        _fill(bitmap, r["b"], r["m"])
    bitmap = spark.sparkContext.broadcast(bitmap)

    @in_task("substrings")
    def super_kmers(batches):
        for batch in text_slices(batches):
            w = Windows(batch.column("text"), window)
            at, n = w.runs()
            gram = w.least[at] if len(at) else np.empty(0, np.uint64)
            bit = gram & np.uint64(bits - 1)
            hit = (bitmap.value[(bit >> np.uint64(3)).astype(np.int64)] >> (bit & np.uint64(7)).astype(np.uint8) & 1).astype(bool)
            at, n, gram = at[hit], n[hit], gram[hit]
            if not len(at):
                continue
            packed = w.packed(at, n + window - 1).dictionary_encode()
            doc, code = w.of[at], packed.indices.to_numpy(zero_copy_only=False)
            lo, ids, keys = at - w.first[doc], batch.column("id").to_numpy(), batch.column("key").to_numpy()
            behind, first = _not_first(code, ids[doc], lo)
            yield _found(gram[first], packed.dictionary.take(pa.array(code[first])), ids[doc[first]], keys[doc[first]], lo[first], lo[first] + n[first] + window - 1)
            gone, a, b = _joined(doc[behind], lo[behind], (lo + n + window - 1)[behind])
            yield _found(None, None, ids[gone], keys[gone], a, b)

    found = scratch.save(rows.mapInArrow(super_kmers, f"gram long, packed string, {_CUT}"), "found")
    strings = found.where("packed is not null")
    cuts = [found.where("packed is null").select("id", "key", "lo", "hi")]

    @in_group("substrings")
    def bucket(table):
        packed = table.column("packed").combine_chunks().cast(pa.large_string())
        id, key, lo = (table.column(c).to_numpy() for c in ("id", "key", "lo"))
        of, start, number, _ = _windows_of(packed, window)
        many = np.bincount(number)[number] > 1
        of, start, number = of[many], start[many], number[many]
        behind, _ = _not_first(number, id[of], lo[of] + start)
        gone, a, b = _joined(of[behind], start[behind], start[behind] + window)
        return pa.table([id[gone], key[gone], lo[gone] + a, lo[gone] + b], names=["id", "key", "lo", "hi"])

    total = strings.count()
    often = scratch.save(strings.groupBy("gram").agg(F.count("*").alias("n")).where(F.col("n") > hot).select("gram"), "often")
    some_hot = bool(often.limit(1).count())
    # how often is decided by numbers of rows alone, so Spark may broadcast `often` only where it is small enough by its own measure
    cold = strings.join(often, "gram", "left_anti") if some_hot else strings
    buckets = max(1, -(-total // BUCKET))
    cold = cold.withColumn("bucket", F.pmod(F.xxhash64("gram"), F.lit(buckets)))
    cuts.append(cold.groupBy("bucket").applyInArrow(bucket, _CUT))

    @in_task("substrings")
    def by_window(batches):
        for batch in batches:
            for part in (batch.slice(k, 4096) for k in range(0, batch.num_rows, 4096)):
                packed = part.column("packed").cast(pa.large_string())
                id, key, lo = (part.column(c).to_numpy() for c in ("id", "key", "lo"))
                of, start, number, at = _windows_of(packed, window)
                behind, first = _not_first(number, id[of], lo[of] + start)
                flat, offsets = text_buffer(packed)
                flat, offsets = flat[offsets[0] : offsets[-1]], offsets - offsets[0]
                ends = np.sort(np.concatenate([np.flatnonzero(flat == 32), offsets[1:]]))
                begins = np.sort(np.concatenate([np.flatnonzero(flat == 32) + 1, offsets[:-1]]))
                words = _strings(flat, begins[at[first]], ends[at[first] + window - 1])
                lowest = (lo[of] + start)[first]
                yield _found(np.zeros(len(first), np.uint64), words, id[of[first]], key[of[first]], lowest, lowest + window)
                gone, a, b = _joined(of[behind], start[behind], start[behind] + window)
                yield _found(None, None, id[gone], key[gone], lo[gone] + a, lo[gone] + b)

    if some_hot:
        singles = scratch.save(strings.join(often, "gram", "left_semi").mapInArrow(by_window, f"gram long, packed string, {_CUT}"), "singles")
        cuts.append(singles.where("packed is null").select("id", "key", "lo", "hi"))
        singles = singles.where("packed is not null")
        firsts = scratch.save(singles.groupBy("packed").agg(F.min(F.struct("id", "lo")).alias("first"), F.count("*").alias("n")).where("n > 1"), "firsts")
        cuts.append(attach(singles, firsts, "packed", "n", singles.count()).where("id <> first.id or lo <> first.lo").select("id", "key", "lo", "hi"))

    gone = cuts[0]
    for x in cuts[1:]:
        gone = gone.unionByName(x)
    gone = scratch.save(gone.groupBy("id", "key").agg(F.array_sort(F.collect_set(F.struct("lo", "hi"))).alias("cuts")), "cuts")

    @in_task("substrings")
    def finish(batches):
        for batch in text_slices(batches):
            texts = batch.column("text").cast(pa.binary()).to_pylist()
            n_words, n_removed, kept = [], [], []
            for text, cuts in zip(texts, batch.column("cuts").to_pylist()):
                words = (text or b"").split()  # at exactly the white space of ASCII
                n_words.append(len(words))
                if cuts:
                    stay = np.ones(len(words), bool)
                    for x in cuts:
                        stay[x["lo"] : x["hi"]] = False
                    words = list(itertools.compress(words, stay.tolist()))
                n_removed.append(n_words[-1] - len(words))
                kept.append(b" ".join(words))
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())], ["id", "n_words", "n_removed", "kept_text"])

    # only texts that lose words are shuffled, and a few others: the rest passes a bitmap of ids
    none = F.lit(None).cast("array<struct<lo:bigint,hi:bigint>>").alias("cuts")
    cut, whole = _split(rows, gone.select("id"), "id")
    texts = cut.join(gone, ["id", "key"], "left").select("id", "text", "cuts")
    texts = texts.unionByName(whole.select("id", "text", none)).unionByName(every.where("id is null").select("id", "text", none))
    return texts.mapInArrow(finish, "id long, n_words long, n_removed long, kept_text string")


def _found(gram, packed, id, key, lo, hi) -> pa.RecordBatch:
    """gram and packed None: ranges of words that go."""
    n = len(id)
    gram = pa.nulls(n, pa.int64()) if gram is None else pa.array(gram.view(np.int64))
    packed = pa.nulls(n, pa.string()) if packed is None else packed.cast(pa.string())
    return pa.RecordBatch.from_arrays([gram, packed, *(pa.array(np.asarray(x, np.int64)) for x in (id, key, lo, hi))], ["gram", "packed", "id", "key", "lo", "hi"])


def _fill(bitmap: np.ndarray, bucket: int, part: bytes) -> None:
    """Positions run from 0 within a bucket of 32768; bucket 1 begins with position 1, bucket 0 holds position 0 alone."""
    bits = np.unpackbits(np.frombuffer(part, np.uint8), bitorder="little")
    at = np.flatnonzero(bits) + (bucket - 1) * len(bits) + 1 if bucket else np.zeros(1, np.int64)
    np.bitwise_or.at(bitmap, at >> 3, (1 << (at & 7)).astype(np.uint8))


def _split(rows: DataFrame, wanted: DataFrame, key: str, most_bits: int = 1 << 27) -> tuple[DataFrame, DataFrame]:
    """Rows whose key is in wanted, with a few others, and the rest: a bitmap of key hashes (16 MB at most) is broadcast."""
    bits = 1 << max(15, min(most_bits.bit_length() - 1, (16 * wanted.count()).bit_length()))

    def place(df: DataFrame) -> DataFrame:
        return df.withColumn("__at", F.pmod(F.xxhash64(key), F.lit(bits))).withColumns({"__bucket": F.expr("bitmap_bucket_number(__at)"), "__bit": F.expr("bitmap_bit_position(__at)")})

    bitmap = place(wanted.select(key)).groupBy("__bucket").agg(F.expr("bitmap_construct_agg(__bit)").alias("__bitmap"))
    byte = F.conv(F.hex(F.expr("substring(__bitmap, cast(__bit div 8 as int) + 1, 1)")), 16, 10).cast("int")
    marked = place(rows).join(F.broadcast(bitmap), "__bucket", "left").withColumn("__hit", F.coalesce(byte.bitwiseAND(F.expr("shiftleft(1, cast(__bit % 8 as int))")) != 0, F.lit(False)))
    return marked.where("__hit").select(*rows.columns), marked.where("not __hit").select(*rows.columns)
