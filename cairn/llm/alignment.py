"""Cross-tokenizer alignment: which tokens of two public tokenizers overlap, by DuckDB within tasks; pair counts are merged in Spark."""

from __future__ import annotations

import itertools
import json
import os
import pickle

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, attach, in_task, kept, text_buffer, text_slices

#: Bytes of text that are aligned at once.
SLICE = 2 << 20
#: Tokens of A that one run of the SQL takes, about: those up to the next place where tokens of both end.
TOKENS = 40_000
#: A pair of ids in one number: A's id in the upper half, B's in the lower.
_HALF = 32
#: Where both tokenizers surely end a token: before a space behind a character that is no white space for either. After these
#: bytes (ends of spaces beyond ASCII in UTF-8, and their neighbours) no cut is made.
_SURE = np.zeros(256, bool)
_SURE[[*range(0x21, 0x7F), *range(0x80, 0xC0)]] = True
_ODD_TWO = (0xC285, 0xC2A0)
_ODD_THREE = (0xE19A, 0xE1A0, 0xE280, 0xE281, 0xE380, 0xEFBB)

#: Token intervals a and b (k, cell, id, lo, hi) lie on one axis, on which the distinct cells of a slice follow one another.
_LINKS = """
WITH first AS (SELECT a.k, a.cell, a.id, b.k AS f FROM a ASOF JOIN b ON a.lo >= b.lo),
last AS (SELECT a.k, b.k AS l FROM a ASOF JOIN b ON a.hi > b.lo),
spans AS (SELECT cell, id, unnest(range(f, l + 1)) AS bk FROM first JOIN last USING (k))
SELECT s.cell, (s.id::BIGINT << 32) + b.id AS pair, count(*) AS n FROM spans s JOIN b ON b.k = s.bk GROUP BY ALL ORDER BY 1, 2"""
_GROUPS = """
WITH common AS (SELECT hi FROM a JOIN b USING (hi)),
ga AS (SELECT a.*, coalesce(sum((common.hi IS NOT NULL)::BIGINT) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS g FROM a LEFT JOIN common USING (hi)),
gb AS (SELECT b.*, coalesce(sum((common.hi IS NOT NULL)::BIGINT) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS g FROM b LEFT JOIN common USING (hi))
SELECT cell, g::BIGINT AS g, 0 AS side, k, id FROM ga UNION ALL SELECT cell, g::BIGINT, 1, k, id FROM gb ORDER BY g, side, k"""
#: Cells of more characters go to the tokenizer itself.
_LONG = 500
#: How the byte-level tokenizer cuts a text before it merges bytes (fixed by its vocabulary).
_PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def _byte_values() -> dict[str, int]:
    """The bytes that characters of byte-level tokens stand for: printable ones for themselves, the others in order from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [x for x in range(256) if x not in plain]
    return {chr(x): x for x in plain} | {chr(256 + i): x for i, x in enumerate(rest)}


class Sides:
    """Both tokenizers: the ids of strings that begin with a space, and the bytes of each id."""

    @classmethod
    def of(cls, a_path: str, b_path: str) -> Sides:
        own = kept("alignment")
        if (a_path, b_path) not in own:
            own[a_path, b_path] = cls(a_path, b_path)
        return own[a_path, b_path]

    def __init__(self, a_path: str, b_path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import duckdb
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        values = _byte_values()
        vocab = sorted(self.a.get_vocab(with_added_tokens=True).items(), key=lambda x: x[1])
        names: list[bytes] = [b""] * (vocab[-1][1] + 1)
        for name, i in vocab:
            names[i] = bytes(values[c] for c in name) if all(c in values for c in name) else name.encode()
        self.a_bytes = _Flat(names)
        self.short = self._ranked(a_path, names)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = _Flat([bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)])
        self.space = self.b.piece_to_id("▁")
        self.sql = duckdb.connect(":memory:", config={"threads": 1, "memory_limit": "500MB", "temp_directory": "", "preserve_insertion_order": False})

    def _ranked(self, path: str, names: list[bytes]):
        """The same byte pairs merged by a faster library, if the file's ids are in the order of its merges and its pattern is the usual one; else None."""
        import tiktoken

        with open(path, encoding="utf-8") as f:
            model = json.load(f)
        merges = ["".join(m if isinstance(m, list) else m.split(" ")) for m in model["model"]["merges"]]
        ids, cut = model["model"]["vocab"], model.get("pre_tokenizer") or {}
        plain = cut.get("type") == "ByteLevel" and cut.get("use_regex", True) and not cut.get("add_prefix_space") and not model.get("normalizer")
        if not plain or any(ids[m] != 256 + i for i, m in enumerate(merges)):
            return None
        return tiktoken.Encoding("a", pat_str=_PATTERN, mergeable_ranks={names[i]: i for i in range(256 + len(merges))}, special_tokens={})

    def encode(self, cells: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
        """For A and B: the ids of all cells, and how many each has. B puts a space before a text, so that cells go without theirs."""
        out: tuple[list, list] = ([], [])
        for lo in range(0, len(cells), 4096):  # ids move into arrays at once, as lists take much room
            some = cells.slice(lo, 4096).to_pylist()
            if self.short:
                a = [self.short.encode_ordinary(x) if len(x) <= _LONG else self.a.encode(x, add_special_tokens=False).ids for x in some]
            else:
                a = [x.ids for x in self.a.encode_batch_fast(some, add_special_tokens=False)]
            b = self.b.encode([x[1:] for x in some], num_threads=1)
            for k, x in enumerate(some):
                if x == " ":
                    b[k] = [self.space]
            for ids, parts in zip((a, b), out):
                n = np.fromiter(map(len, ids), np.int64, len(ids))
                parts.append((np.fromiter(itertools.chain.from_iterable(ids), np.int32, int(n.sum())), n))
        return [tuple(np.concatenate([np.empty(0, t), *(x[k] for x in parts)]) for k, t in ((0, np.int32), (1, np.int64))) for parts in out]


class _Flat:
    """Byte strings, by number."""

    def __init__(self, names: list[bytes]):
        self.size = np.fromiter(map(len, names), np.int64, len(names))
        self.start, self.data = np.cumsum(self.size) - self.size, np.frombuffer(b"".join(names), np.uint8)

    def joined(self, ids: np.ndarray) -> np.ndarray:
        n = self.size[ids]
        upto = np.cumsum(n)
        return self.data[np.repeat(self.start[ids] - (upto - n), n) + np.arange(upto[-1] if len(upto) else 0)]


def _cells(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Texts, each with a space before it, cut where both tokenizers surely end a token; the number of cells of each."""
    spaced = pc.binary_join_element_wise(pa.scalar(" ", pa.large_string()), texts, pa.scalar("", pa.large_string()))
    data, offsets = text_buffer(spaced)
    base = int(offsets[0])
    data, offsets = data[base : int(offsets[-1])], offsets - base
    cut = data == 32
    cut[1:] &= _SURE[data[:-1]]
    at = np.flatnonzero(cut)
    wide = at[(at > 1) & (data[at - 1] >= 0x80)]
    two = data[wide - 2].astype(np.int64) << 8 | data[wide - 1]
    three = data[np.maximum(wide - 3, 0)].astype(np.int64) << 8 | data[wide - 2]
    cut[wide[np.isin(two, _ODD_TWO) | np.isin(three, _ODD_THREE)]] = False
    cut[offsets[:-1]] = True
    at = np.flatnonzero(cut)
    bounds = np.append(at, len(data)).astype(np.int64)
    return pa.Array.from_buffers(pa.large_string(), len(at), [None, pa.py_buffer(bounds), pa.py_buffer(np.ascontiguousarray(data))]), np.diff(np.searchsorted(at, offsets))


def _misspelt(tokens: np.ndarray, n: np.ndarray, side: _Flat, sizes: np.ndarray, flat: np.ndarray) -> np.ndarray:
    """Which cells' tokens hold other bytes than the cell."""
    cell = np.repeat(np.arange(len(n)), n)
    bad = np.bincount(cell, weights=side.size[tokens], minlength=len(n)).astype(np.int64) != sizes
    of = np.repeat(np.arange(len(n)), sizes)
    stay = ~bad[of]
    bad[of[stay][side.joined(tokens[~bad[cell]]) != flat[stay]]] = True
    return bad


def _intervals(tokens: np.ndarray, n: np.ndarray, side: _Flat, bad: np.ndarray) -> pa.Table:
    cell = np.repeat(np.arange(len(n)), n)
    good = ~bad[cell]
    tokens, cell = tokens[good], cell[good]
    hi = np.cumsum(side.size[tokens])
    return pa.table({"k": np.arange(len(tokens)), "cell": cell, "id": tokens, "lo": hi - side.size[tokens], "hi": hi})


def _aligned(sql, a: pa.Table, b: pa.Table) -> tuple[dict[str, np.ndarray], dict[str, np.ndarray]]:
    """Links, and tokens with their groups. Some tokens at a time, always up to a place where tokens of both end: nothing lies across it."""
    links, tokens, (a_hi, b_hi) = [], [], (x.column("hi").to_numpy() for x in (a, b))
    shared = np.intersect1d(a_hi, b_hi, assume_unique=True)
    at, b_at, groups = 0, 0, 0
    while at < len(a_hi):
        end = shared[np.searchsorted(shared, a_hi[min(at + TOKENS, len(a_hi)) - 1])]
        upto, b_upto = (int(np.searchsorted(x, end, "right")) for x in (a_hi, b_hi))
        sql.register("a", a.slice(at, upto - at))
        sql.register("b", b.slice(b_at, b_upto - b_at))
        for out, query in ((links, _LINKS), (tokens, _GROUPS)):
            out.append({k: np.asarray(v, np.int64) for k, v in sql.sql(query).fetchnumpy().items()})
        for name in "ab":
            sql.unregister(name)
        tokens[-1]["g"] += groups  # numbered anew in each run
        groups, at, b_at = int(tokens[-1]["g"][-1]) + 1, upto, b_upto
    joined = lambda parts, names: {k: np.concatenate([np.empty(0, np.int64), *(x[k] for x in parts)]) for k in names}
    return joined(links, ("cell", "pair", "n")), joined(tokens, ("cell", "g", "side", "id"))


def _listed(tokens: dict[str, np.ndarray], n_cells: int) -> tuple[pa.Array, dict[str, np.ndarray]]:
    """Each cell's groups as a string, with ; behind the last, and its numbers of tokens and groups."""
    cell, g, side = tokens["cell"], tokens["g"], tokens["side"]
    new_group = np.ones(len(cell), bool)
    new_group[1:] = g[1:] != g[:-1]
    behind = np.append(np.where(new_group[1:], 2, np.where(side[1:] != side[:-1], 1, 0)), 2)[: len(cell)]
    parts = pc.binary_join_element_wise(pa.array(tokens["id"]).cast(pa.large_string()), pa.array([",", "|", ";"], pa.large_string()).take(pa.array(behind)), pa.scalar("", pa.large_string()))
    flat, offsets = text_buffer(parts)
    bounds = offsets[np.searchsorted(cell, np.arange(n_cells + 1))] - offsets[0]
    texts = pa.Array.from_buffers(pa.large_string(), n_cells, [None, pa.py_buffer(np.ascontiguousarray(bounds, np.int64)), pa.py_buffer(np.ascontiguousarray(flat[int(offsets[0]) : int(offsets[-1])]))])
    return texts, {"n_a": np.bincount(cell[side == 0], minlength=n_cells), "n_b": np.bincount(cell[side == 1], minlength=n_cells), "n_groups": np.bincount(cell[new_group], minlength=n_cells)}


_SLICE = "slice long, packed binary, pairs array<long>, times array<int>"
_OUT = "id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups string"
_SUMS = ("n_a", "n_b", "n_groups", "n_links")


def _packed(parts: dict[str, np.ndarray]) -> bytes:
    """Arrays in one compressed string; whole numbers take as few bytes as their greatest needs."""
    small = lambda x: x.astype(np.min_scalar_type(int(x.max()))) if x.dtype.kind in "iu" and len(x) and x.min() >= 0 else x
    data = pickle.dumps({k: small(x) for k, x in parts.items()}, 5)
    return len(data).to_bytes(8, "little") + pa.compress(data, "zstd", asbytes=True)


def _unpacked(data: bytes) -> dict[str, np.ndarray]:
    return pickle.loads(pa.decompress(data[8:], int.from_bytes(data[:8], "little"), "zstd", asbytes=True))


def align(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """Aligns tokens of a byte-level BPE (A) and a sentencepiece model (B) on each text with a space before it.

    Returns documents (id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups) and pairs (a_id, b_id, n).
    Groups are cut where tokens of both end; groups lists their ids, as a1,a2|b1;a3|b2,b3. A link is a pair of token
    occurrences whose bytes overlap; n of a pair of ids: how many links hold it in the corpus. n_best: links whose pair has
    the greatest n of its B id (ties included); count_sum: n summed over links. Strings of special tokens are plain text. Null
    and empty texts, and texts that the tokens of A or B don't spell, have zeros and no groups (an empty string). Rows are
    aligned each, repeated and null ids too. Other columns are not read, whatever their names. Empty tables give no rows.

    Each slice of a task is cut into cells (mostly words) at places where both tokenizers surely end a token. DuckDB aligns
    a slice's distinct cells: a table of token intervals for each side, as-of joins to the first and last token that an
    interval overlaps, window sums that number the groups. Slices send their pairs' counts, and get back the corpus's.
    """
    scratch = Scratch(docs.sparkSession, "alignment")

    @in_task("alignment")
    def slices(batches):
        sides, number = Sides.of(a_path, b_path), TaskContext.get().partitionId() << 32
        for batch in text_slices(batches, SLICE):
            number += 1
            text = pc.fill_null(batch.column("text").cast(pa.large_string()), "")
            cells, counts = _cells(text)
            coded = cells.dictionary_encode()
            code, names = coded.indices.to_numpy(zero_copy_only=False), coded.dictionary
            sizes, (flat, offsets) = pc.binary_length(names).to_numpy(zero_copy_only=False), text_buffer(names)
            flat = flat[int(offsets[0]) : int(offsets[-1])]
            (a, n_a), (b, n_b) = sides.encode(names)
            bad = _misspelt(a, n_a, sides.a_bytes, sizes, flat) | _misspelt(b, n_b, sides.b_bytes, sizes, flat)
            links, tokens = _aligned(sides.sql, _intervals(a, n_a, sides.a_bytes, bad), _intervals(b, n_b, sides.b_bytes, bad))
            texts, of_cell = _listed(tokens, len(names))

            # a text is spelt if all its cells are; empty texts have no tokens
            starts = np.concatenate([[0], np.cumsum(counts)])
            spelt = (np.diff(np.concatenate([[0], np.cumsum(bad[code])])[starts]) == 0) & (pc.binary_length(text).to_numpy(zero_copy_only=False) > 0)
            stay = np.repeat(spelt, counts)
            code, counts = code[stay].astype(np.uint32), np.where(spelt, counts, 0)
            starts = np.concatenate([[0], np.cumsum(counts)])
            of_cell["n_links"] = np.zeros(len(names), np.int64)
            np.add.at(of_cell["n_links"], links["cell"], links["n"])
            sums = [np.diff(np.concatenate([[0], np.cumsum(x[code])])[starts]) for x in of_cell.values()]

            used = np.bincount(code, minlength=len(names))
            there = used[links["cell"]] > 0  # cells that only texts without tokens hold have no links
            links = {k: x[there] for k, x in links.items()}
            pairs, at = np.unique(links["pair"], return_inverse=True)
            times = np.zeros(len(pairs), np.int64)
            np.add.at(times, at, links["n"] * used[links["cell"]])
            flat, offsets = text_buffer(texts)
            null = batch.column("id").is_null().to_numpy(zero_copy_only=False)
            ids = pc.fill_null(batch.column("id"), 0).to_numpy()
            packed = _packed({
                "id": ids, "null": null, "cells": counts, "code": code, **dict(zip(_SUMS, sums)), "links": np.bincount(links["cell"], minlength=len(names)), "at": at, "n": links["n"],
                "text": flat[int(offsets[0]) : int(offsets[-1])], "ends": np.diff(offsets),
            })
            yield pa.RecordBatch.from_arrays([pa.array([number]), pa.array([packed], pa.binary()), pa.array([pairs], pa.list_(pa.int64())), pa.array([times.astype(np.int32)], pa.list_(pa.int32()))], ["slice", "packed", "pairs", "times"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    aligned = scratch.save(rows.mapInArrow(slices, _SLICE), "aligned")
    asked = aligned.select("slice", F.explode(F.arrays_zip("pairs", "times")).alias("x"))
    asked = scratch.save(asked.select("slice", F.col("x.pairs").alias("pair"), F.col("x.times").alias("times")), "asked")
    totals = asked.groupBy("pair").agg(F.sum("times").alias("n"), F.count("*").alias("slices"))
    b_id = F.expr(f"pair & {(1 << _HALF) - 1}L")  # an id of B has as many pairs as A has ids, at most
    totals = scratch.save(totals.withColumn("best", F.col("n") == F.max("n").over(Window.partitionBy(b_id))), "totals")
    answers = attach(asked, totals, "pair", "slices", asked.count()).select("slice", "pair", F.col("n").alias("total"), "best")

    def finish(left: pa.Table, right: pa.Table) -> pa.Table:
        x = _unpacked(left.column("packed")[0].as_py())
        order = np.argsort(right.column("pair").to_numpy())  # the slice's distinct pairs, in the order in which it numbered them
        total, best = (right.column(c).to_numpy(zero_copy_only=False)[order].astype(np.int64) for c in ("total", "best"))
        at, n, of = x["at"], x["n"].astype(np.int64), np.repeat(np.arange(len(x["links"])), x["links"])
        of_cell = []
        for values in (best, total):
            sums = np.zeros(len(x["links"]), np.int64)
            np.add.at(sums, of, n * values[at])
            of_cell.append(sums)
        ends = np.cumsum(x["ends"].astype(np.int64))
        text = x["text"].tobytes().decode()  # ids and separators, one byte each
        texts = [text[i:j] for i, j in zip([0, *ends.tolist()], ends.tolist())]
        upto = np.concatenate([[0], np.cumsum(x["cells"].astype(np.int64))])
        code = x["code"].astype(np.int64)
        by_doc = [np.diff(np.concatenate([[0], np.cumsum(sums[code])])[upto]) for sums in of_cell]
        named = [texts[i] for i in code.tolist()]
        groups = ["".join(named[i:j])[:-1] for i, j in zip(upto.tolist(), upto[1:].tolist())]
        columns = [pa.array(x["id"].astype(np.int64), mask=x["null"]), *(pa.array(x[c].astype(np.int64)) for c in _SUMS), *map(pa.array, by_doc), pa.array(groups, pa.string())]
        return pa.table(columns, names=[c.split()[0] for c in _OUT.split(", ")])

    done = aligned.select("slice", "packed").groupBy("slice").cogroup(answers.groupBy("slice")).applyInArrow(finish, _OUT)
    return done, totals.select(F.shiftright("pair", _HALF).alias("a_id"), b_id.alias("b_id"), "n")

