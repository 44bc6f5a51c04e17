"""Line dedup: two Bloom filters tell lines seen once from lines seen twice; only suspected repeats are shuffled and confirmed exactly."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACES, Scratch, attach, in_group, in_task

#: Bits of a filter that one row holds while filters are merged.
SEGMENT = 1 << 19
PROBES = 2
#: Nodes of the merging tree below one node.
FAN_IN = 32
#: A filter never takes more bits (64 MB): beyond, more lines are suspected and confirmed exactly, with the same results.
MAX_BITS = 1 << 29


def line_keys(text: str | None) -> tuple[list[str], list[bytes]]:
    """A text's lines, and their keys: stripped of ASCII white space, A-Z lower-cased, in UTF-8. Null or empty: one empty line."""
    lines = (text or "").split("\n")
    return lines, [x.strip(SPACES).encode("utf-8", "surrogatepass").lower() for x in lines]


def long_enough(key: bytes, least: int) -> bool:
    return len(key) >= least and (len(key) >= 4 * least or len(key.decode("utf-8", "surrogatepass")) >= least)


def _hash(keys) -> np.ndarray:
    import xxhash

    return np.fromiter((xxhash.xxh3_64_intdigest(k) for k in keys), np.uint64, len(keys))


def _positions(hashes: np.ndarray, bits: int) -> np.ndarray:
    """PROBES bit positions of each hash, a row each. bits is a power of two."""
    step = (hashes >> np.uint64(32)) | np.uint64(1)
    return np.stack([(hashes + np.uint64(i) * step) & np.uint64(bits - 1) for i in range(PROBES)])


def repeated_filter(docs: DataFrame, bits: int, least: int) -> dict[int, bytes]:
    """The filter of lines seen twice, as its non-empty segments. Lines count once for each document.

    Each task gives the bit positions that its lines set, and those set by two or more; merging by segment in a tree, a bit
    that two tasks set has been hit twice. So every line of two documents has all its bits in the filter; others rarely.
    """
    @in_task("lines")
    def local(batches):
        for pdf in batches:
            found = [np.empty(0, np.uint64)]
            for text in pdf["text"]:
                found.append(_hash({k for k in line_keys(text)[1] if long_enough(k, least)}))
            hashes, times = np.unique(np.concatenate(found), return_counts=True)
            at, hit = np.unique(np.concatenate([_positions(hashes, bits).ravel(), _positions(hashes[times > 1], bits).ravel()]), return_counts=True)
            if not len(at):
                continue
            cuts = np.flatnonzero(np.diff(at // np.uint64(SEGMENT))) + 1
            firsts = [0, *cuts.tolist()]
            yield pd.DataFrame({
                "segment": (at[firsts] // np.uint64(SEGMENT)).astype(np.int64),
                "at": [(x % np.uint64(SEGMENT)).astype(np.uint32).tobytes() for x in np.split(at, cuts)],
                "twice": [np.packbits(x > 1).tobytes() for x in np.split(hit, cuts)],
            })

    @in_group("lines")
    def merge(pdf):
        once, twice = np.zeros(SEGMENT, bool), np.zeros(SEGMENT, bool)
        for at, more in zip(pdf["at"], pdf["twice"]):
            at = np.frombuffer(at, np.uint32)
            twice[at] |= once[at] | np.unpackbits(np.frombuffer(more, np.uint8), count=len(at)).astype(bool)
            once[at] = True
        return pd.DataFrame({"segment": pdf["segment"][:1], "node": pdf["node"][:1] // FAN_IN, "once": [np.packbits(once).tobytes()], "twice": [np.packbits(twice).tobytes()]})

    @in_group("lines")
    def merge_again(pdf):
        once, twice = np.zeros(SEGMENT // 8, np.uint8), np.zeros(SEGMENT // 8, np.uint8)
        for x, y in zip(pdf["once"], pdf["twice"]):
            x = np.frombuffer(x, np.uint8)
            twice |= np.frombuffer(y, np.uint8) | once & x
            once |= x
        return pd.DataFrame({"segment": pdf["segment"][:1], "node": pdf["node"][:1] // FAN_IN, "once": [once.tobytes()], "twice": [twice.tobytes()]})

    # a tree over the tasks: no group takes the bitmaps of more than FAN_IN nodes, whatever the number of tasks
    parts = docs.select("text").mapInPandas(local, "segment long, at binary, twice binary").withColumn("node", F.spark_partition_id().cast("long"))
    nodes, schema = docs.rdd.getNumPartitions(), "segment long, node long, once binary, twice binary"
    merged = parts.groupBy("segment", F.expr(f"node div {FAN_IN}")).applyInPandas(merge, schema)
    while (nodes := -(-nodes // FAN_IN)) > 1:
        merged = merged.groupBy("segment", F.expr(f"node div {FAN_IN}")).applyInPandas(merge_again, schema)
    return {r["segment"]: r["twice"] for r in merged.select("segment", "twice").toLocalIterator()}


def dedup_lines(docs: DataFrame, least: int = 10, id_col: str = "doc_id", text_col: str = "text", max_bits: int = MAX_BITS) -> DataFrame:
    """(id, n_lines, n_dropped, kept_text): each text without the lines that an earlier document holds.

    A line's key is the line without white space around it, A-Z lower-cased. Keys of at least `least` code points found in
    two documents lose all their lines except those of the smallest id. Other lines stay, joined by \\n. Null and empty texts
    are one empty line. Rows that share an id are one document for this, and each keeps its lines where the id is the smallest;
    rows with a null id are never compared and stay whole. Other columns of docs are not read, whatever their names. An empty
    table gives no rows.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "lines")
    n_lines = F.size(F.split(F.coalesce("text", F.lit("")), "\n")).cast("long").alias("n_lines")
    every = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    docs = every.where("id is not null")
    lines = docs.agg(F.coalesce(F.sum(n_lines), F.lit(0))).first()[0]
    bits = 1 << max(19, min(int(max_bits).bit_length() - 1, int(16 * lines).bit_length()))
    segments = spark.sparkContext.broadcast(repeated_filter(docs, bits, least))

    @in_task("lines")
    def suspects(batches):
        packed = np.zeros(bits // 8, np.uint8)
        for k, x in segments.value.items():
            packed[k * SEGMENT // 8 : (k + 1) * SEGMENT // 8] = np.frombuffer(x, np.uint8)
        for pdf in batches:
            out = []
            for i, text in zip(pdf["id"], pdf["text"]):
                lines, keys = line_keys(text)
                asked = list({k for k in keys if long_enough(k, least)})
                if asked:
                    at = _positions(_hash(asked), bits)
                    hit = ((packed[(at >> np.uint64(3)).astype(np.int64)] >> (7 - (at & np.uint64(7))).astype(np.uint8)) & 1).all(0)
                    asked = [k for k, h in zip(asked, hit) if h]
                out.append((i, text, len(lines), asked))
            yield pd.DataFrame(out, columns=["id", "text", "n_lines", "asked"])

    scanned = scratch.save(docs.mapInPandas(suspects, "id long, text string, n_lines long, asked array<binary>"), "scanned")
    asked = scratch.save(scanned.select("id", F.explode("asked").alias("key")), "asked")
    first = scratch.save(asked.groupBy("key").agg(F.min("id").alias("first"), F.max("id").alias("last"), F.count("*").alias("holders")).where("first < last").select("key", "first", "holders"), "first")
    drops = attach(asked, first, "key", "holders", asked.count()).where("id <> first").groupBy("id").agg(F.collect_set("key").alias("drops"))

    @in_task("lines")
    def finish(batches):
        for pdf in batches:
            dropped, texts = [], []
            for text, drops in zip(pdf["text"], pdf["drops"]):
                gone = set() if drops is None else {bytes(x) for x in drops}
                lines, keys = line_keys(text)
                stay = [x for x, k in zip(lines, keys) if k not in gone] if gone else lines
                dropped.append(len(lines) - len(stay))
                texts.append("\n".join(stay))
            yield pd.DataFrame({"id": pdf["id"], "n_lines": pdf["n_lines"], "n_dropped": dropped, "kept_text": texts})

    clean = scanned.where(F.size("asked") == 0).select("id", "n_lines", F.lit(0).cast("long").alias("n_dropped"), F.coalesce("text", F.lit("")).alias("kept_text"))
    dirty = scanned.where(F.size("asked") > 0).select("id", "text", "n_lines").join(drops, "id", "left").mapInPandas(finish, "id long, n_lines long, n_dropped long, kept_text string")
    alone = every.where("id is null").select("id", n_lines, F.lit(0).cast("long").alias("n_dropped"), F.coalesce("text", F.lit("")).alias("kept_text"))
    return clean.unionByName(dirty).unionByName(alone)
