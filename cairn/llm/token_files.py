"""Token ids in a binary file format: a wavelet matrix for each shard, with rank and select on succinct bit-planes."""

from __future__ import annotations

import functools
import io
import struct
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, in_task, text_slices
from .encoding import Encoder, with_ends

MAGIC = b"CWM2"
#: Bits of a plane that are compressed together, and have one entry in its directory.
BLOCK = 1 << 18
_HEAD = struct.Struct("<4sQQIQQ")
_ENTRY = np.dtype([("ones", "<u8"), ("at", "<u8"), ("size", "<u4")])


def _planes(ids: np.ndarray) -> list[np.ndarray]:
    """Bit-planes from the highest bit down, as packed bits; each plane's zeros come before its ones in the next plane."""
    planes = []
    for level in reversed(range(max(1, int(ids.max()).bit_length()) if len(ids) else 1)):
        ones = (ids >> ids.dtype.type(level) & ids.dtype.type(1)).astype(bool)
        planes.append(np.packbits(ones))
        ids = np.concatenate([np.compress(~ones, ids), np.compress(ones, ids)])
    return planes


def token_file(ids: np.ndarray, doc_ids: np.ndarray, lengths: np.ndarray) -> bytes:
    """The file of a shard: head, directory, documents, planes.

    The head has the magic, the numbers of ids, documents and planes, and the sizes of the compressed document ids and lengths.
    The directory has an entry for each block of each plane: the plane's ones before it, where its bytes begin, and how many
    they are. Documents and blocks are compressed by zstd, each on its own.
    """
    ids = np.asarray(ids)
    planes = _planes(ids)
    docs = [pa.compress(np.asarray(x, "<i8").tobytes(), codec="zstd", asbytes=True) if len(x) else b"" for x in (doc_ids, lengths)]
    blocks = -(-len(ids) // BLOCK)
    entries, body = np.zeros((len(planes), blocks), _ENTRY), []
    at = _HEAD.size + entries.nbytes + sum(map(len, docs))
    for row, plane in zip(entries, planes):
        ones = 0
        for k in range(blocks):
            part = plane[k * BLOCK // 8 : (k + 1) * BLOCK // 8]
            body.append(pa.compress(part.tobytes(), codec="zstd", asbytes=True))
            row[k] = ones, at, len(body[-1])
            ones, at = ones + int(np.bitwise_count(part).sum(dtype=np.int64)), at + len(body[-1])
    return b"".join([_HEAD.pack(MAGIC, len(ids), len(doc_ids), len(planes), *map(len, docs)), entries.tobytes(), *docs, *body])


class TokenFile:
    """Reads a token file where it lies: source is the file's bytes or a seekable file. Only the head and the directory are held;
    an answer reads and decompresses the one or two blocks of each plane that it needs (the last 64 stay in memory)."""

    def __init__(self, source):
        self.file = io.BytesIO(source) if isinstance(source, (bytes, bytearray, memoryview)) else source
        head = self._read(0, _HEAD.size)
        if head[:4] != MAGIC:
            raise ValueError("not a token file")
        _, self.n, self.n_docs, self.levels, self._ids_size, self._lengths_size = _HEAD.unpack(head)
        blocks = -(-self.n // BLOCK)
        self.entries = np.frombuffer(self._read(_HEAD.size, self.levels * blocks * _ENTRY.itemsize), _ENTRY).reshape(self.levels, blocks)
        self.block = functools.lru_cache(64)(self._block)
        self.totals = [int(self.entries[level]["ones"][-1]) + int(np.bitwise_count(self._block(level, blocks - 1)).sum(dtype=np.int64)) if blocks else 0 for level in range(self.levels)]

    def _read(self, at: int, size: int) -> bytes:
        self.file.seek(at)
        return self.file.read(size)

    def _block(self, level: int, k: int) -> np.ndarray:
        e = self.entries[level, k]
        bits = min(BLOCK, self.n - k * BLOCK)
        return np.frombuffer(pa.decompress(self._read(int(e["at"]), int(e["size"])), decompressed_size=(bits + 7) // 8, codec="zstd", asbytes=True), np.uint8)

    def _bit(self, level: int, i: int) -> int:
        return int(self.block(level, i // BLOCK)[i % BLOCK >> 3]) >> (7 - (i & 7)) & 1

    def _ones(self, level: int, i: int) -> int:
        """Rank: ones before position i of a plane."""
        if i >= self.n:
            return self.totals[level]
        k, rest = divmod(i, BLOCK)
        part = self.block(level, k)[: (rest + 7) >> 3]
        ones = int(self.entries[level, k]["ones"]) + int(np.bitwise_count(part).sum(dtype=np.int64))
        return ones - (int(part[-1] & ((1 << (-rest & 7)) - 1)).bit_count() if rest & 7 else 0)

    def _select(self, level: int, bit: int, k: int) -> int:
        """Position of the bit's occurrence k in a plane."""
        ones = self.entries[level]["ones"].astype(np.int64)
        before = ones if bit else np.arange(len(ones)) * BLOCK - ones
        at = int(np.searchsorted(before, k, "right")) - 1
        bits = np.unpackbits(self.block(level, at), count=min(BLOCK, self.n - at * BLOCK))
        return at * BLOCK + int(np.flatnonzero(bits == bit)[k - int(before[at])])

    def access(self, i: int) -> int:
        """The id at position i."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        value = 0
        for level in range(self.levels):
            bit, ones = self._bit(level, i), self._ones(level, i)
            i = self.n - self.totals[level] + ones if bit else i - ones
            value = value << 1 | bit
        return value

    def _interval(self, symbol: int, i: int) -> tuple[int, int]:
        """Where the symbol's occurrences among the first i positions stand behind the last plane."""
        if symbol < 0 or symbol >> self.levels:
            return 0, 0
        lo, hi = 0, i
        for level in range(self.levels):
            a, b = self._ones(level, lo), self._ones(level, hi)
            zeros = self.n - self.totals[level]
            lo, hi = (zeros + a, zeros + b) if symbol >> (self.levels - 1 - level) & 1 else (lo - a, hi - b)
        return lo, hi

    def count(self, symbol: int, i: int | None = None) -> int:
        """Occurrences among the first i positions, or all."""
        lo, hi = self._interval(symbol, self.n if i is None else i)
        return hi - lo

    def occurrence(self, symbol: int, k: int) -> int:
        """Position of occurrence k, from 0."""
        lo, hi = self._interval(symbol, self.n)
        if not 0 <= k < hi - lo:
            raise IndexError(k)
        at = lo + k
        for level in reversed(range(self.levels)):
            bit = symbol >> (self.levels - 1 - level) & 1
            at = self._select(level, bit, at - (self.n - self.totals[level]) if bit else at)
        return at

    def decode(self) -> np.ndarray:
        """All ids, from the last plane up."""
        ids = np.zeros(self.n, np.uint32 if self.levels > 16 else np.uint16)
        for level in reversed(range(self.levels)):
            packed = np.concatenate([np.empty(0, np.uint8), *(self._block(level, k) for k in range(self.entries.shape[1]))])
            ones, zeros = np.unpackbits(packed, count=self.n).astype(bool), self.n - self.totals[level]
            up = np.empty_like(ids)
            up[np.flatnonzero(~ones)] = ids[:zeros]
            up[np.flatnonzero(ones)] = ids[zeros:] | ids.dtype.type(1 << (self.levels - 1 - level))
            ids = up
        return ids

    def documents(self) -> tuple[np.ndarray, np.ndarray]:
        """Document ids and how many ids each has."""
        at = _HEAD.size + self.entries.nbytes
        out = []
        for size in (self._ids_size, self._lengths_size):
            out.append(np.frombuffer(pa.decompress(self._read(at, size), decompressed_size=8 * self.n_docs, codec="zstd", asbytes=True), "<i8") if size else np.empty(0, "<i8"))
            at += size
        return out[0], out[1]


#: Stands for a null document id in a file.
NO_ID = -(2**63)


def write_token_files(docs: DataFrame, path: str, tokenizer_path: str, kind: str = "words", end_id: int = 1, range_bytes: int = 16 << 20, shard_ids: int = 2 << 20, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Writes a table (part, seq, n_ids, n_docs, file) of token files: ordered by (part, seq) they hold all ids in ascending order of ids.

    Each row of docs is encoded whole, with the end id after it; null and empty texts are the end id alone. Rows of one id
    follow each other by text, null ids come first. Rows are dealt to tasks by ranges of ids, of about range_bytes of text,
    and each task closes a file at shard_ids ids or more, never within a document. Other columns of docs are not read,
    whatever their names. An empty table writes no file.
    """
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    total = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    ordered = rows.repartitionByRange(max(1, -(-total // range_bytes)), "id").sortWithinPartitions("id", "text")

    @in_task("encoding")
    def encode(batches):
        encoder, part, seq = Encoder.of(tokenizer_path, kind), TaskContext.get().partitionId(), 0
        ids, keys, lengths, size = [], [], [], 0

        def shard():
            sizes = np.concatenate(lengths)
            file = token_file(np.concatenate(ids).astype(encoder.dtype), np.concatenate(keys), sizes)
            return pa.RecordBatch.from_pylist([{"part": part, "seq": seq, "n_ids": size, "n_docs": len(sizes), "file": file}], schema=_FILES)

        for batch in text_slices(batches):
            flat, counts = with_ends(*encoder.encode(batch.column("text")), end_id)
            ids.append(flat.astype(encoder.dtype))
            keys.append(batch.column("id").to_numpy())
            lengths.append(counts)
            size += len(flat)
            if size >= shard_ids:
                yield shard()
                seq, ids, keys, lengths, size = seq + 1, [], [], [], 0
        if keys:
            yield shard()

    ordered.mapInArrow(encode, "part int, seq int, n_ids long, n_docs long, file binary").write.mode("overwrite").option("compression", "none").parquet(path)


_FILES = pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("n_ids", pa.int64()), ("n_docs", pa.int64()), ("file", pa.binary())])


def read_documents(files: DataFrame) -> DataFrame:
    """(id, start, n_tokens, ids_crc32) of each document in the token files; start counts all ids before it."""
    files_before = F.coalesce(F.sum("n_ids").over(Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = files.groupBy("part").agg(F.sum("n_ids").alias("n"))
    # one row for each task of the writing job
    parts = parts.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("parts_before"))
    base = files.select("part", "seq", files_before.alias("files_before")).join(parts, "part").select("part", "seq", (F.col("files_before") + F.col("parts_before")).alias("base"))

    @in_task("encoding")
    def decode(batches):
        for pdf in batches:
            for part, seq, data in zip(pdf["part"], pdf["seq"], pdf["file"]):
                file = TokenFile(data)
                ids, (keys, lengths) = file.decode().astype("<u4"), file.documents()
                ends = np.cumsum(lengths)
                crc = [zlib.crc32(ids[e - n : e]) for e, n in zip(ends.tolist(), lengths.tolist())]
                yield pd.DataFrame({"part": part, "seq": seq, "key": keys, "within": ends - lengths, "n_tokens": lengths, "ids_crc32": crc})

    rows = files.select("part", "seq", "file").mapInPandas(decode, "part int, seq int, key long, within long, n_tokens long, ids_crc32 long")
    return rows.join(base, ["part", "seq"]).select(F.when(F.col("key") != NO_ID, F.col("key")).alias("id"), (F.col("base") + F.col("within")).alias("start"), "n_tokens", "ids_crc32")


def token_files(docs: DataFrame, tokenizer_path: str, **options) -> DataFrame:
    """Writes token files to a scratch folder and reads the documents back from them."""
    scratch = Scratch(docs.sparkSession, "token-files")
    write_token_files(docs, f"{scratch.path}/files", tokenizer_path, **options)
    return read_documents(docs.sparkSession.read.schema("part int, seq int, n_ids long, n_docs long, file binary").parquet(f"{scratch.path}/files"))
