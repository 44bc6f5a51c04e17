"""Quality classifier: labelled latent-semantic vectors are broadcast, and every text is judged by the vote of its nearest ones."""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .common import give_back, in_task, mix, text_buffer, word_hashes

#: Labelled rows that the model is fitted on, at most; which ones, a hash of their ids decides.
SAMPLE = 4000
RANK = 48
NEIGHBOURS = 15

#: Classes of bytes whose trigrams are the terms: each listed character is one, then the groups below.
_SINGLE = " \n.,!?|#$%&*-:;'\"()<>{}[]=+@/_~"
_CLASSES = np.full(256, len(_SINGLE) + 5, np.int64)
for _chars, _k in (("abcdefghijklmnopqrstuvwxyz", 0), ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", 1), ("0123456789", 2)):
    _CLASSES[[ord(c) for c in _chars]] = len(_SINGLE) + _k
_CLASSES[128:192] = len(_SINGLE) + 3  # later bytes of a character
_CLASSES[192:] = len(_SINGLE) + 4
for _k, _c in enumerate(_SINGLE):
    _CLASSES[ord(_c)] = _k
N_CLASSES = len(_SINGLE) + 6
#: Terms behind the trigrams: words like the one before, word pairs and triples seen before in the text, in all and after the first of them.
EXTRA = 4
#: Hashed terms between them: words (A-Z lower-cased), and runs of four bytes, which tell texts apart in scripts without spaces too.
WORDS, GRAMS = 1 << 17, 1 << 16
TERMS = N_CLASSES**3 + WORDS + GRAMS + EXTRA
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


#: Bytes of text whose terms are sorted together, and rows at most.
GROUP, GROUP_ROWS = 1 << 18, 1 << 13
_TERM_BITS = (TERMS - 1).bit_length()


def _repeats(w: np.ndarray) -> np.ndarray:
    """Shares of words like the one before, and of pairs, triples and words that the text had before."""
    if len(w) < 4:
        return np.zeros(EXTRA)
    two = mix(w[:-1] * np.uint64(3) + w[1:])
    three = mix(two[:-1] * np.uint64(3) + w[2:])
    return np.array([(w[1:] == w[:-1]).mean(), *(1 - len(np.unique(x)) / len(x) for x in (two, three, w))])


def _group_terms(data: np.ndarray, lengths: np.ndarray, words: np.ndarray, counts: np.ndarray):
    """For each row of some, its terms in ascending order and their shares."""
    rows = len(lengths)
    row = np.repeat(np.arange(rows, dtype=np.uint32), lengths)
    of_word = np.repeat(np.arange(rows, dtype=np.uint32), counts)
    shift = np.uint32(_TERM_BITS)
    keys = [(of_word << shift) + np.uint32(N_CLASSES**3) + (words >> np.uint64(47)).astype(np.uint32)]
    if len(data) > 2:
        c = _CLASSES[data].astype(np.uint32)
        tri = (c[:-2] * np.uint32(N_CLASSES) + c[1:-1]) * np.uint32(N_CLASSES) + c[2:]
        keys.append(((row[2:] << shift) + tri)[row[:-2] == row[2:]])
    if len(data) > 3:
        x = _LOWER[data].astype(np.uint32)
        x = (x[:-3] | x[1:-2] << np.uint32(8) | x[2:-1] << np.uint32(16) | x[3:] << np.uint32(24)) * np.uint32(0x9E3779B1)
        run = ((x ^ x >> np.uint32(15)) * np.uint32(0x85EBCA6B) >> np.uint32(16)) + np.uint32(N_CLASSES**3 + WORDS)
        keys.append(((row[3:] << shift) + run)[row[:-3] == row[3:]])
    keys = np.sort(np.concatenate(keys))
    starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.empty(0, np.int64)
    n, of, term = np.diff(starts, append=len(keys)), keys[starts] >> shift, (keys[starts] & np.uint32((1 << _TERM_BITS) - 1)).astype(np.int64)
    kind = (term >= N_CLASSES**3).astype(np.int64) + (term >= N_CLASSES**3 + WORDS)
    share = n / np.maximum(1, np.stack([lengths - 2, counts, lengths - 3]))[kind, of]
    cuts, ends = np.searchsorted(of, np.arange(rows + 1)), np.cumsum(counts)
    for i in range(rows):
        extra = _repeats(words[ends[i] - counts[i] : ends[i]])
        mine = slice(cuts[i], cuts[i + 1])
        yield np.concatenate([term[mine], TERMS - EXTRA + np.flatnonzero(extra)]), np.concatenate([share[mine], extra[extra > 0]])


def term_counts(column):
    """For each row of an Arrow string column, its terms and their shares of the text, from the whole text."""
    data, offsets = text_buffer(column)
    lo = 0
    while lo < len(offsets) - 1:
        hi = max(lo + 1, min(lo + GROUP_ROWS, int(np.searchsorted(offsets, offsets[lo] + GROUP, "right")) - 1))
        words, counts = word_hashes(data, offsets[lo : hi + 1])
        yield from _group_terms(data[offsets[lo] : offsets[hi]], np.diff(offsets[lo : hi + 1]), words, counts)
        lo = hi


class Model:
    """idf of all terms, the latent space, and the labelled vectors in it."""

    def __init__(self, idf: np.ndarray, rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, rank: int = RANK, neighbours: int = NEIGHBOURS, seed: int = 5):
        self.idf, self.labels, self.neighbours = idf.astype(np.float32), labels.astype(np.float32), neighbours
        self.prior = float(labels.mean()) if len(labels) else 0.5
        # a row of the latent space for each term that some labelled row has, and one of zeros (row 0) for all others
        own = np.zeros(len(idf), bool)
        for t, _ in rows:
            own[t] = True
        self.row = np.where(own, np.cumsum(own), 0).astype(np.int32)
        sparse, size = [(self.row[t], self._weights(t, s)) for t, s in rows], int(own.sum()) + 1
        shape = len(rows), len(idf)

        def times(q):
            return np.array([w @ q[t] for t, w in sparse], np.float32).reshape(len(sparse), q.shape[1])

        def back(y):
            out = np.zeros((size, y.shape[1]), np.float32)
            for (t, w), z in zip(sparse, y):
                out[t] += w[:, None] * z
            return out

        # randomised truncated SVD of the labelled rows, which stay sparse; one matrix is held at a time
        rank = max(1, min(rank, *shape)) if min(shape) else 0
        q = self._random(own, min(rank + 12, shape[1]) if rank else 0, seed)
        for _ in range(2 if rank else 0):
            y = times(q)
            del q
            q = self._orthonormal(back(y))
        if rank:
            _, _, v = np.linalg.svd(times(q), full_matrices=False)
            q = q @ v[:rank].T
        self.space = q.astype(np.float16)  # half the size to broadcast
        self.vectors = self.vectors_of(rows)

    @staticmethod
    def _random(own: np.ndarray, width: int, seed: int) -> np.ndarray:
        """Normal numbers for each term, drawn for all and kept for those that occur."""
        rng, out = np.random.default_rng(seed), np.zeros((int(own.sum()) + 1, width), np.float32)
        at = 1
        for lo in range(0, len(own) if width else 0, 8192):
            some = own[lo : lo + 8192]
            drawn = rng.standard_normal((len(some), width))[some]
            out[at : at + len(drawn)] = drawn
            at += len(drawn)
        return out

    def _weights(self, terms, share):
        w = np.sqrt(share).astype(np.float32) * self.idf[terms]
        w[terms >= TERMS - EXTRA] *= 2
        norm = np.sqrt((w * w).sum())
        return w / norm if norm else w

    @staticmethod
    def _orthonormal(x):
        """A basis of the columns' space, through their small Gram matrix."""
        parts = (x[lo : lo + 8192].astype(np.float64) for lo in range(0, len(x), 8192))
        values, v = np.linalg.eigh(sum((p.T @ p for p in parts), np.zeros((x.shape[1],) * 2)))
        keep = values > 1e-10 * max(values.max(), 1e-300)
        by = (v[:, keep] / np.sqrt(values[keep])).astype(np.float32)
        for lo in range(0, len(x), 8192):  # in place
            x[lo : lo + 8192, : by.shape[1]] = x[lo : lo + 8192] @ by
        return x[:, : by.shape[1]]

    @staticmethod
    def _normal(x):
        n = np.linalg.norm(x, axis=1, keepdims=True)
        return np.divide(x, n, out=np.zeros_like(x), where=n > 0)

    def vectors_of(self, rows) -> np.ndarray:
        x = [self._weights(t, s) @ self.space[self.row[t]].astype(np.float32) for t, s in rows]
        return self._normal(np.array(x, np.float32).reshape(len(x), self.space.shape[1]))

    def scores(self, rows) -> np.ndarray:
        """Share of label 1 among the nearest labelled vectors, each counted by its similarity. The prior for a text without terms."""
        x, out = self.vectors_of(rows), []
        k = min(self.neighbours, len(self.labels))
        for lo in range(0, len(x), 256):
            block = x[lo : lo + 256]
            if not k:
                out.append(np.full(len(block), self.prior))
                continue
            s = block @ self.vectors.T
            at = np.argpartition(-s, k - 1, axis=1)[:, :k]
            w = np.maximum(np.take_along_axis(s, at, 1), 0).astype(np.float64) ** 8
            total = w.sum(1)
            out.append(np.where((total > 0) & (np.abs(block).sum(1) > 0), (w * self.labels[at]).sum(1) / np.where(total > 0, total, 1), self.prior))
        return np.clip(np.concatenate(out), 0, 1) if out else np.empty(0)


def held_out(id_column, folds: int = 4, fold: int = 2):
    """Rows that labels are never learnt from: crc32 of the id as text leaves that remainder. A null id is not held out."""
    return F.coalesce(F.crc32(id_column.cast("string")) % folds == fold, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE) -> Model:
    """Learns from at most `sample` labelled rows that are not held out; document frequencies are those of all texts.

    Ids and labels that are null are left out; of several labels or texts of one id the smallest counts. The driver gets the sampled
    rows' terms and one number for each term that occurs (at most TERMS). With no label at all every score is 0.5.
    """
    @in_task("quality")
    def count(batches):
        df = np.zeros(TERMS, np.int64)
        n = 0
        for batch in batches:
            for terms, _ in term_counts(batch.column("text")):
                df[terms] += 1
                n += 1
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array([-1, *at.tolist()], pa.int64()), pa.array([n, *df[at].tolist()], pa.int64())], ["term", "n"])

    @in_task("quality")
    def terms(batches):
        for batch in batches:
            rows = list(term_counts(batch.column("text")))
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("label"), pa.array([t.astype(np.int32) for t, _ in rows], pa.list_(pa.int32())), pa.array([x.astype(np.float32) for _, x in rows], pa.list_(pa.float32()))], ["id", "label", "terms", "share"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    counts = rows.select("text").mapInArrow(count, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    at, df = (counts.column(k).to_numpy() for k in ("term", "n"))
    n = int(df[at < 0].sum())
    idf = np.full(TERMS, np.log(n + 1.0) + 1)
    idf[at[at >= 0]] = np.log((n + 1) / (df[at >= 0] + 1)) + 1
    known = labels.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("double").alias("label")).where("id is not null and label is not null")
    known = known.where(~held_out(F.col("id"))).groupBy("id").agg(F.min("label").alias("label"))
    chosen = F.broadcast(known.orderBy(F.xxhash64("id"), "id").limit(sample))
    texts = rows.join(chosen, "id").groupBy("id").agg(F.min("label").alias("label"), F.min("text").alias("text"))
    got = texts.mapInArrow(terms, "id long, label double, terms array<int>, share array<float>").toArrow()
    order = np.argsort(got.column("id").to_numpy())
    rows = [(got.column("terms")[i].values.to_numpy(), got.column("share")[i].values.to_numpy()) for i in order.tolist()]
    model = Model(idf, rows, got.column("label").to_numpy()[order])
    del got, rows
    give_back()
    return model


def score(docs: DataFrame, model: Model, name: str = "score", text_col: str = "text") -> DataFrame:
    """docs with a further column: the vote for label 1 (0 to 1) from each whole text, null and empty ones included.

    No other column is read; all are passed through, so name must be new. Rows are independent; an empty table gives none.
    """
    if name in docs.columns:
        raise ValueError(f"docs has a column {name}")
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @in_task("quality")
    def run(batches):
        for batch in batches:
            rows, votes = term_counts(batch.column(text_col)), [np.empty(0)]
            while some := list(itertools.islice(rows, 256)):  # the terms of few texts at once
                votes.append(shared.value.scores(some))
            votes = np.concatenate(votes)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(votes, pa.float64())], [*batch.schema.names, name])

    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField(name, DoubleType())]))
