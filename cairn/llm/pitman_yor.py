"""Language-model scoring by a hierarchical Pitman-Yor model, with Chinese-restaurant seating sampled by Gibbs."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, in_group, in_task, mix
from .shingles import word_batches

#: Tokens that one row of the token table holds, about.
CHUNK = 2 << 20
#: Discounts and strengths of the restaurants of contexts and of the one that they share as parent.
DISCOUNT, STRENGTH = 0.8, 10.0
ROOT_DISCOUNT, ROOT_STRENGTH = 0.7, 100.0
BURN_IN, SAMPLES, STEPS = 6, 6, 3
END = mix(np.array([0x0E4D], np.uint64))[0]


def _packed(x: np.ndarray, ascending: bool = False) -> bytes:
    """An integer array with its bytes in planes, zstd-compressed; ascending ones as differences."""
    x = np.ascontiguousarray(np.diff(x, prepend=x.dtype.type(0)) if ascending else x)
    planes = x.view(np.uint8).reshape(len(x), x.itemsize).T.tobytes()
    return len(x).to_bytes(8, "little") + pa.compress(planes, codec="zstd", asbytes=True) if len(x) else bytes(8)


def _unpacked(data: bytes, dtype, ascending: bool = False) -> np.ndarray:
    n, dtype = int.from_bytes(data[:8], "little"), np.dtype(dtype)
    if not n:
        return np.empty(0, dtype)
    planes = pa.decompress(data[8:], decompressed_size=n * dtype.itemsize, codec="zstd", asbytes=True)
    x = np.frombuffer(planes, np.uint8).reshape(dtype.itemsize, n).T.copy().view(dtype).ravel()
    return np.cumsum(x, dtype=dtype) if ascending else x


def _packed_samples(x: np.ndarray) -> bytes:
    """Values of some samples, a row each, in 32-bit floats; most are the same in all samples, so what changes is packed."""
    bits = np.ascontiguousarray(x, np.float32).view(np.uint32).copy()
    bits[1:] ^= bits[:-1].copy()
    return _packed(bits.ravel())


def _unpacked_samples(data: bytes) -> np.ndarray:
    return np.bitwise_xor.accumulate(_unpacked(data, np.uint32).reshape(SAMPLES, -1), axis=0).view(np.float32)


# ---- tokens, in rows of some million


@in_task("pitman-yor")
def _tokens(batches):
    part, seq = TaskContext.get().partitionId(), 0
    ids, held, lengths, hashes, size = [], [], [], [], 0

    def row():
        every = np.concatenate(hashes)
        hashes.clear()
        words, at = np.unique(every, return_inverse=True)
        del every
        at, n = at.astype(np.uint32), np.array(lengths, np.uint32)
        train = np.bincount(at[np.repeat(~np.array(held), n)], minlength=len(words)).astype(np.uint32)
        return pa.RecordBatch.from_pydict({"chunk": [part << 24 | seq], "ids": [ids], "held": [held], "lengths": [_packed(n)], "words": [_packed(words, True)], "train": [_packed(train)], "at": [_packed(at)], "size": [len(at)], "trained": [int(train.sum())]}, schema=_ARROW)

    for batch in batches:
        keys, out = batch.column("id").to_pylist(), batch.column("held").to_pylist()
        for lo, words, counts in word_batches(batch.column("text")):
            hi = lo + len(counts)
            hashes.append(np.insert(words, np.cumsum(counts), END))
            ids += keys[lo:hi]
            held += out[lo:hi]
            lengths += (counts + 1).tolist()
            size += len(words) + len(counts)
            if size >= CHUNK:
                yield row()
                seq, ids, held, lengths, hashes, size = seq + 1, [], [], [], [], 0
    if ids:
        yield row()


_TOKENS = "chunk long, ids array<string>, held array<boolean>, lengths binary, words binary, train binary, at binary, size long, trained long"
_ARROW = pa.schema([("chunk", pa.int64()), ("ids", pa.list_(pa.string())), ("held", pa.list_(pa.bool_())), *[(n, pa.binary()) for n in ("lengths", "words", "train", "at")], ("size", pa.int64()), ("trained", pa.int64())])


def _dishes(words, lengths, at):
    """For each token its word's number * how many words there are + its context's: the word before, or the end for a text's first."""
    end = np.searchsorted(words, END)
    previous = np.empty_like(at)
    previous[:1], previous[1:] = end, at[:-1]
    previous[np.cumsum(lengths.astype(np.int64))[:-1]] = end
    dishes = at.astype(np.int64)
    dishes *= len(words)
    dishes += previous
    return dishes


def _owners(words, buckets):
    """(bucket, from, until) of the runs of ascending words that a task owns."""
    return _runs(((words >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64))


def _joined(parts, name, unpack):
    """A column of packed parts, in the order of buckets."""
    return np.concatenate([unpack(x[name]) for x in sorted(parts, key=lambda x: x["bucket"]) if x[name] is not None], axis=-1)


# ---- seating


def _stirling(discount: float, most: int) -> np.ndarray:
    """[c, t]: logarithms of the generalised Stirling numbers of c customers at t tables, for c up to most."""
    out = np.full((most + 1, most + 1), -np.inf)
    out[0, 0] = 0.0
    for c in range(1, most + 1):
        t = np.arange(1, c + 1)
        stay = c - 1 - discount * t
        out[c, 1 : c + 1] = np.logaddexp(out[c - 1, t - 1], np.where(stay > 0, np.log(np.maximum(stay, 1e-300)) + out[c - 1, t], -np.inf))
    return out


def _lone_shares(discount: float) -> tuple[np.ndarray, np.ndarray]:
    """Tables a customer, ascending, and the share of tables with one customer there: sizes of tables are Sibuya numbers tilted to that mean, by the saddle point."""
    log = -np.geomspace(140, 1e-8, 4000)  # of 1 - r, r being the tilt
    r, f = -np.expm1(log), -np.expm1(discount * log)
    return f * np.exp((1 - discount) * log) / (discount * r), discount * r / f


#: Dishes of so many customers are drawn from the Stirling numbers; cells of them at once; leaps of a round over all customers of larger ones.
_LOOK, _CELLS, _LEAPS = 128, 1 << 20, 8
_TABLES: dict[float, tuple] = {}


def _seat(rng, c, weight, discount):
    """Tables after c customers of each dish came one by one (later in growing companies): a new table has weight / (weight + customers - discount * tables)."""
    t, here = np.minimum(c, 1).astype(np.float64), np.minimum(c, 1).astype(np.float64)
    live = np.flatnonzero(c > 1)
    while len(live):
        h, w = here[live], weight[live]
        come = np.minimum(c[live] - h, np.maximum(1, h // 8))
        t[live] += rng.binomial(come.astype(np.int64), w / (w + h - discount * t[live]))
        here[live] = h + come
        live = live[here[live] < c[live]]
    return t


def _gibbs(rng, c, t, weight, discount):
    """Resamples all customers of each dish; its table count's conditional is S(c, t) * weight ** t.

    Up to _LOOK customers it is drawn at once. Beyond, as many customers as the dish has are taken away one by one and seated
    anew, in leaps: of an eighth of them, those that sat alone close a table, others open one. So t forgets its start within
    some rounds, whatever c is.
    """
    if discount not in _TABLES:
        _TABLES[discount] = (_stirling(discount, _LOOK), *_lone_shares(discount))
    stirling, ratio, share = _TABLES[discount]
    n, out = c.astype(np.int64), np.minimum(c, 1).astype(np.float64)
    few = np.flatnonzero((n > 1) & (n <= _LOOK))
    few = few[np.argsort(n[few].astype(np.int16), kind="stable")]
    for k, lo, hi in _runs(n[few]):
        for i in range(lo, hi, _CELLS // k):
            rows = few[i : min(hi, i + _CELLS // k)]
            log = stirling[k, 1 : k + 1] + np.arange(1, k + 1) * np.log(weight[rows])[:, None]
            chance = np.cumsum(np.exp(log - log.max(1, keepdims=True)), axis=1)
            out[rows] = 1 + (rng.random((len(rows), 1)) * chance[:, -1:] > chance).sum(1)
    many = np.flatnonzero(n > _LOOK)
    if len(many):
        h, w, x = c[many].astype(np.float64), weight[many], np.clip(np.rint(t[many]), 1, c[many])
        for _ in range(_LEAPS):
            alone = (x - 1) / (h - 1) * np.interp(x / h, ratio, share)
            opened = (1 - alone) * w / (w + h - 1 - discount * x) * h / _LEAPS
            stayed = h - 1 - discount * (x - 1)
            closed = alone * stayed / (w + stayed) * h / _LEAPS
            less = rng.binomial((x - 1).astype(np.int64), -np.expm1(-closed / np.maximum(x - 1, 1)))
            more = rng.binomial((h - x).astype(np.int64), -np.expm1(-opened / np.maximum(h - x, 1)))
            x = x - less + more
        out[many] = x
    return out


def _seating(w, u, c, guests, tokens, seed):
    """Mean tables of each dish (word w, context u, c customers); and of each sample, the tables of each context, and tables and customers of each word in the shared parent.

    A task has all contexts of its words, and the customers (guests) of each context exactly. What it needs of the contexts'
    other words, their tables, it takes from its own in proportion to the customers; the predictions later use exact sums.
    """
    rng = np.random.default_rng(seed)
    n_words, c = int(w.max()) + 1 if len(w) else 0, c.astype(np.float64)
    p = np.bincount(w, weights=c, minlength=n_words) / max(1, tokens)
    share = guests / np.maximum(np.bincount(u, weights=c, minlength=len(guests)), 1)
    grown = lambda t: np.bincount(u, weights=t, minlength=len(guests)) * share
    t = _seat(rng, c, (STRENGTH + DISCOUNT * 0.3 * guests[u]) * p[w], DISCOUNT)
    root = None
    mean, samples = np.zeros(len(c)), []
    scale = tokens / max(1, c.sum())
    for sweep in range(BURN_IN + SAMPLES):
        customers = np.bincount(w, weights=t, minlength=n_words)
        total = customers.sum() * scale
        if root is None:
            root = _seat(rng, customers, np.full(n_words, ROOT_STRENGTH / max(1, total)) + 0.5, ROOT_DISCOUNT)
        root = np.clip(root, np.minimum(customers, 1), customers)
        for _ in range(STEPS):
            base = (ROOT_STRENGTH + ROOT_DISCOUNT * root.sum() * scale) / (n_words * scale + 1)
            root = _gibbs(rng, customers, root, np.full(n_words, base), ROOT_DISCOUNT)
        p = (customers - ROOT_DISCOUNT * root + base) / (ROOT_STRENGTH + total)
        for _ in range(STEPS):
            t = _gibbs(rng, c, t, (STRENGTH + DISCOUNT * grown(t)[u]) * p[w], DISCOUNT)
        if sweep >= BURN_IN:
            customers = np.bincount(w, weights=t, minlength=n_words)
            mean += t / SAMPLES
            samples.append((np.bincount(u, weights=t, minlength=len(guests)), np.minimum(root, customers), customers))
    return mean, *map(np.array, zip(*samples))


def score_texts(docs: DataFrame, held_out, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score) for each row of docs.

    Tokens are words with A-Z lower-cased, then one end for each text; null and empty texts are the end alone. The model
    learns from the rows where the column held_out is not true. base_score is the unigram's with add-half smoothing; score the
    log10 probability under the hierarchical model: each word is the context of a restaurant for the word behind it (the end
    also for a text's first), all share one parent for words of any context, whose base is uniform over the words known and
    one for the others. Rows are independent given the model; repeated rows, null ids and an empty table are fine.

    Texts become rows of some million tokens. Their distinct words go to the tasks that own them, which count; their distinct
    (word, context) pairs, counted, go to the task that owns the word, which samples the seating of all its restaurants. The
    tables of each context are summed by the task that owns it as a word, and all comes back the same way.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "pitman-yor")
    # ids go through Python as text, so that nulls don't turn them into floats
    rows = docs.select(F.coalesce(F.col(id_col).cast("long").cast("string"), F.lit("")).alias("id"), F.coalesce(held_out, F.lit(False)).alias("held"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    tokens = scratch.save(rows.mapInArrow(_tokens, _TOKENS), "tokens")

    total, size = tokens.agg(F.coalesce(F.sum("trained"), F.lit(0)), F.coalesce(F.sum("size"), F.lit(0))).first()
    # tasks that sample: one for each CHUNK tokens, and up to 8 where these are fewer but not few
    buckets = max(1, min(8, int(size >> 17)), int(size // CHUNK))

    @in_task("pitman-yor")
    def listed(batches):
        for pdf in batches:
            for r in pdf.itertuples():
                words, train = _unpacked(r.words, np.uint64, True), _unpacked(r.train, np.uint32)
                for b, lo, hi in _owners(words, buckets):
                    yield pd.DataFrame({"bucket": [b], "chunk": [r.chunk], "words": [_packed(words[lo:hi], True)], "train": [_packed(train[lo:hi])]})

    @in_group("pitman-yor")
    def counted(pdf):
        parts = [_unpacked(x, np.uint64, True) for x in pdf["words"]]
        words, at = np.unique(np.concatenate(parts), return_inverse=True)
        n = np.bincount(at, weights=np.concatenate([_unpacked(x, np.uint32) for x in pdf["train"]])).astype(np.uint64)
        starts = np.cumsum([0, *map(len, parts)])
        known = [int((n > 0).sum()), *[0] * (len(parts) - 1)]
        return pd.DataFrame({"bucket": pdf["bucket"], "chunk": pdf["chunk"], "known": known, "counts": [_packed(n[at[i:j]]) for i, j in zip(starts, starts[1:])]})

    counts = scratch.save(tokens.select("chunk", "words", "train").mapInPandas(listed, "bucket long, chunk long, words binary, train binary").groupBy("bucket").applyInPandas(counted, "bucket long, chunk long, known long, counts binary"), "counts")
    known = counts.agg(F.coalesce(F.sum("known"), F.lit(0))).first()[0]
    numbered = scratch.save(tokens.select("chunk", "ids", "held", "lengths", "words", "at").join(counts.groupBy("chunk").agg(F.collect_list(F.struct("bucket", "counts")).alias("known")), "chunk"), "numbered")
    scratch.drop("tokens", "counts")

    @in_task("pitman-yor")
    def asked(batches):
        for pdf in batches:
            for r in pdf.itertuples():
                words, lengths, at = _unpacked(r.words, np.uint64, True), _unpacked(r.lengths, np.uint32), _unpacked(r.at, np.uint32)
                counts, width = _joined(r.known, "counts", lambda x: _unpacked(x, np.uint64)), len(words)
                dish = _dishes(words, lengths, at)
                keys, n = np.unique(dish, return_counts=True)
                held = np.repeat(np.array(r.held, bool), lengths)
                if held.any():
                    other, m = np.unique(dish[held], return_counts=True)
                    n[np.searchsorted(keys, other)] -= m
                for b, lo, hi in _owners(words, buckets):
                    i, j = np.searchsorted(keys, (lo * width, hi * width))
                    used, context = np.unique(keys[i:j] % width, return_inverse=True)
                    yield pd.DataFrame({"bucket": [b], "chunk": [r.chunk], "words": [_packed(words[lo:hi], True)], "contexts": [_packed(words[used], True)], "guests": [_packed(counts[used])], "dishes": [_packed((keys[i:j] // width - lo) * len(used) + context, True)], "n": [_packed(n[i:j].astype(np.uint32))]})

    @in_group("pitman-yor")
    def seated(pdf):
        every = [_unpacked(x, np.uint64, True) for x in pdf["words"]], [_unpacked(x, np.uint64, True) for x in pdf["contexts"]]
        words = np.unique(np.concatenate(every[0]))
        contexts, first = np.unique(np.concatenate(every[1]), return_index=True)
        guests, width = np.concatenate([_unpacked(x, np.uint64) for x in pdf["guests"]])[first].astype(np.float64), len(contexts)
        places, keys = [np.searchsorted(words, x) for x in every[0]], []
        for x, place, own in zip(pdf["dishes"], places, every[1]):
            dish = _unpacked(x, np.int64, True)
            keys.append(place[dish // len(own)] * width + np.searchsorted(contexts, own)[dish % len(own)])
        starts = np.cumsum([0, *map(len, keys)])
        dishes, at = np.unique(np.concatenate(keys), return_inverse=True)
        n = np.bincount(at, weights=np.concatenate([_unpacked(x, np.uint32) for x in pdf["n"]]), minlength=len(dishes))
        del keys, every
        trained = n > 0
        used, w = np.unique(dishes[trained] // width, return_inverse=True)
        u, n = dishes[trained] % width, n[trained]
        t, tables, root, customers = _seating(w, u, n, guests, total, int(pdf["bucket"].iloc[0]))
        rest, roots = np.zeros(len(dishes), np.float32), np.zeros((SAMPLES, len(words)), np.float32)
        rest[trained], roots[:, used] = n - DISCOUNT * t, customers - ROOT_DISCOUNT * root
        hosts = tables[0] > 0  # a context with customers has a table in every sample
        return pd.DataFrame({
            "bucket": pdf["bucket"][:1].tolist(), "chunks": [pdf["chunk"].tolist()], "words": [[_packed(x.astype(np.uint32), True) for x in places]],
            "places": [[_packed(at[i:j].astype(np.uint32), True) for i, j in zip(starts, starts[1:])]],
            "rest": [_packed(rest.view(np.uint32))], "roots": [_packed_samples(roots)], "contexts": [_packed(contexts[hosts], True)], "tables": [_packed_samples(tables[:, hosts])],
            "root_tables": [root.sum(1).tolist()], "root_guests": [customers.sum(1).tolist()],
        })

    requests = numbered.select("chunk", "held", "lengths", "words", "at", "known").mapInPandas(asked, "bucket long, chunk long, words binary, contexts binary, guests binary, dishes binary, n binary")
    state = scratch.save(requests.groupBy("bucket").applyInPandas(seated, "bucket long, chunks array<long>, words array<binary>, places array<binary>, rest binary, roots binary, contexts binary, tables binary, root_tables array<double>, root_guests array<double>"), "state")
    sample = lambda k: [F.coalesce(F.sum(F.element_at(c, k + 1)), F.lit(0.0)) for c in ("root_tables", "root_guests")]
    root = state.agg(*[c.alias(f"{k}{n}") for k in range(SAMPLES) for n, c in enumerate(sample(k))]).first()
    root_tables, root_guests = (np.array(root[n::2])[:, None] for n in (0, 1))

    @in_task("pitman-yor")
    def dealt(batches):
        for pdf in batches:
            for chunk, x, y in zip(pdf["chunk"], pdf["words"], pdf["tables"]):
                words = _unpacked(x, np.uint64, True)
                tables = None if y is None else _unpacked_samples(y)
                for b, lo, hi in _owners(words, buckets):
                    yield pd.DataFrame({"bucket": [b], "chunk": [chunk], "words": [_packed(words[lo:hi], True)], "tables": pd.Series([None if tables is None else _packed_samples(tables[:, lo:hi])], dtype=object)})

    @in_group("pitman-yor")
    def summed(pdf):
        parts = [_unpacked(x, np.uint64, True) for x in pdf["words"]]
        words, at = np.unique(np.concatenate(parts), return_inverse=True)
        sums, starts, out = np.zeros((SAMPLES, len(words))), np.cumsum([0, *map(len, parts)]), []
        for i, j, tables in zip(starts, starts[1:], pdf["tables"]):
            if tables is not None:
                sums[:, at[i:j]] += _unpacked_samples(tables)
        for chunk, i, j in zip(pdf["chunk"], starts, starts[1:]):
            if chunk >= 0:
                out.append((chunk, _packed_samples(sums[:, at[i:j]])))
        return pd.DataFrame({"chunk": [x for x, _ in out], "bucket": pdf["bucket"].iloc[0], "rest": pd.Series([None] * len(out), dtype=object), "roots": pd.Series([None] * len(out), dtype=object), "tables": [x for _, x in out]})

    @in_task("pitman-yor")
    def answered(batches):
        for pdf in batches:
            for r in pdf.itertuples():
                rest, roots = _unpacked(r.rest, np.uint32), _unpacked_samples(r.roots)
                for chunk, a, b in zip(r.chunks, r.words, r.places):
                    yield pd.DataFrame({"chunk": [chunk], "bucket": [r.bucket], "rest": [_packed(rest[_unpacked(b, np.uint32, True)])], "roots": [_packed_samples(roots[:, _unpacked(a, np.uint32, True)])], "tables": pd.Series([None], dtype=object)})

    reply = "chunk long, bucket long, rest binary, roots binary, tables binary"
    replies = state.select("bucket", "chunks", "words", "places", "rest", "roots").mapInPandas(answered, reply)
    told = state.select(F.lit(-1).cast("long").alias("chunk"), F.col("contexts").alias("words"), "tables").unionByName(numbered.select("chunk", "words", F.lit(None).cast("binary").alias("tables")))
    tabled = told.mapInPandas(dealt, "bucket long, chunk long, words binary, tables binary").groupBy("bucket").applyInPandas(summed, reply)

    @in_task("pitman-yor")
    def scored(batches):
        for pdf in batches:
            for r in pdf.itertuples():
                words, lengths, at = _unpacked(r.words, np.uint64, True), _unpacked(r.lengths, np.uint32), _unpacked(r.at, np.uint32)
                counts = _joined(r.known, "counts", lambda x: _unpacked(x, np.uint64)).astype(np.float64)
                rest = _joined(r.parts, "rest", lambda x: _unpacked(x, np.uint32)).view(np.float32).astype(np.float64)
                roots, tables = (_joined(r.parts, x, _unpacked_samples) for x in ("roots", "tables"))
                keys, which = np.unique(_dishes(words, lengths, at), return_inverse=True)
                w, u = keys // len(words), keys % len(words)
                del keys
                share = (ROOT_STRENGTH + ROOT_DISCOUNT * root_tables) / (known + 1), ROOT_STRENGTH + root_guests
                logs = np.maximum(rest, 0)
                for of_context, of_word, own, whole in zip(tables, roots, *share):  # the mean of all samples' predictions
                    p = (np.maximum(of_word, 0).astype(np.float64) + own) / whole
                    logs += (STRENGTH + DISCOUNT * of_context.astype(np.float64)[u]) * p[w] / SAMPLES
                logs = np.log10(logs / (STRENGTH + counts[u]))
                base = np.log10((counts + 0.5) / (total + 0.5 * (known + 1)))
                starts = np.cumsum(lengths.astype(np.int64)) - lengths
                yield pd.DataFrame({"id": list(r.ids), "held_out": np.array(r.held, bool), "n_tokens": lengths.astype(np.int64), "n_known": np.add.reduceat((counts[at] > 0).astype(np.int64), starts), "base_score": np.add.reduceat(base[at], starts), "score": np.add.reduceat(logs[which], starts)})

    back = replies.unionByName(tabled).groupBy("chunk").agg(F.collect_list(F.struct("bucket", "rest", "roots", "tables")).alias("parts"))
    found = numbered.join(back, "chunk").mapInPandas(scored, "id string, held_out boolean, n_tokens long, n_known long, base_score double, score double")
    return found.select(F.when(F.col("id") != "", F.col("id")).cast("long").alias("id"), "held_out", "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), "base_score", "score")


def _runs(sorted_labels: np.ndarray):
    """(label, from, until) of each run."""
    cuts = np.flatnonzero(np.diff(sorted_labels)) + 1
    starts = [0, *cuts.tolist()]
    return [(int(sorted_labels[i]), i, j) for i, j in zip(starts, [*starts[1:], len(sorted_labels)])] if len(sorted_labels) else []
