"""Substring dedup and importance resampling against plain loops."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pytest
from brute import HARD
from pyspark.sql import functions as F

from cairn.llm import queries, resampling, substring_dedup


def substrings(rows, size):
    """rows: (id, text). Kept text, by row."""
    cut = [(i, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in rows]
    first = {}
    for i, w in cut:
        if i is not None:
            for k in range(len(w) - size + 1):
                s = tuple(w[k : k + size])
                first[s] = min(first.get(s, (i, k)), (i, k))
    out = []
    for i, w in cut:
        gone = set()
        for k in range(len(w) - size + 1) if i is not None else ():
            if first[tuple(w[k : k + size])] != (i, k):
                gone |= set(range(k, k + size))
        out.append((i, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    return out


def corpus(seed, n=120):
    """Passages shared in other contexts, whole copies, repeats within a text, periods, near copies, many words of case only."""
    rng = random.Random(seed)
    word = lambda: rng.choice(["the", "The", "of", "ab", "ünder", "日本", *(f"w{k}" for k in range(300))])
    passage = [[word() for _ in range(n)] for n in (19, 20, 21, 60, 300)]
    texts = []
    for _ in range(n):
        parts = [[word() for _ in range(rng.randrange(60))]]
        for _ in range(rng.randrange(4)):
            parts += [rng.choice(passage), [word() for _ in range(rng.randrange(30))]]
        if rng.random() < 0.1:
            parts.append(["la", "li"] * rng.randrange(40))
        texts.append(rng.choice([" ", "\n", " \t"]).join(sum(parts, [])))
    return [*texts, *texts[:20], *(t.replace("w7", "w8") for t in texts[20:40])]


@pytest.mark.parametrize(("size", "hot", "bits"), [(20, 10_000, 1 << 28), (20, 3, 1 << 15), (7, 2, 1 << 15), (3, 10_000, 1 << 15)])
def test_substrings_against_brute_force(spark, size, hot, bits, monkeypatch):
    monkeypatch.setattr(substring_dedup, "RUN", 16)
    monkeypatch.setattr(substring_dedup, "BUCKET", 200)
    texts = corpus(size)
    random.Random(1).shuffle(texts)
    rows = list(enumerate(texts, -5))
    docs = spark.createDataFrame([(i, t, 1, "x", 2) for i, t in rows], "doc_id long, text string, id int, key string, lo int").repartition(5)
    got = substring_dedup.dedup_substrings(docs, size, hot=hot, max_bits=bits)
    assert sorted(map(tuple, got.collect())) == sorted(substrings(rows, size))


def test_substrings_of_hard_rows(spark, rest):
    rows = [(r["doc_id"], r["text"]) for r in rest.collect()]
    got = substring_dedup.dedup_substrings(rest, 4)
    key = lambda r: (r[0] is None, r)
    assert sorted(map(tuple, got.collect()), key=key) == sorted(substrings(rows, 4), key=key)
    assert substring_dedup.dedup_substrings(rest.limit(0)).count() == 0


def test_rows_that_share_an_id(spark):
    a, b = " ".join(f"a{k}" for k in range(30)), "x " + " ".join(f"a{k}" for k in range(30))
    rows = [(1, a), (1, a), (1, b), (2, a), (0, "x")]
    got = substring_dedup.dedup_substrings(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(map(tuple, got.collect())) == sorted(substrings(rows, 20))


def resampled(rows, target, n, buckets, percent, least, seed):
    def features(text):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        return len(w), [zlib.crc32(" ".join(w[i : i + k]).encode()) % buckets for k in range(1, n + 1) for i in range(len(w) - k + 1)]

    own, theirs = [features(t) for _, t in rows], [features(t)[1] for t in target]
    s, t = Counter(x for _, f in own for x in f), Counter(x for f in theirs for x in f)
    gain = {x: math.floor(1000 * math.log((t[x] + 1) * (s.total() + buckets) / ((s[x] + 1) * (t.total() + buckets)))) for x in s}
    out = []
    for (i, _), (n_words, f) in zip(rows, own):
        weight = math.floor(sum(gain[x] for x in f) / len(f)) if f else 0
        h = int(hashlib.sha256(f"{seed}:{i}".encode()).hexdigest()[:8], 16)
        out.append([i, n_words, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))) if i is not None else None, None])
    order = sorted((r for r in out if r[0] is not None and r[1] >= least), key=lambda r: (-r[4], r[0], r[3], r[2]))
    for k, r in enumerate(order[: percent * len(order) // 100]):
        r[5] = k + 1
    return sorted(map(tuple, out), key=repr)


@pytest.mark.parametrize(("n", "slice_bytes"), [(1, 8 << 20), (2, 300), (3, 300)])
def test_resampling_against_brute_force(spark, rest, n, slice_bytes, monkeypatch):
    cut = resampling.text_slices
    monkeypatch.setattr(resampling, "text_slices", lambda batches: cut(batches, slice_bytes))
    rng = random.Random(5)
    rows = [(r["doc_id"], r["text"]) for r in rest.select("doc_id", "text").collect()] + [(i, " ".join(rng.choice(["A1", "b", "çé", "d-e", "日本"]) for _ in range(rng.randrange(60)))) for i in range(100, 200)]
    target = [None, "", "b b çé", "A1 d e. d e", *["b D-E çé A1"] * 9]
    docs = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, score int, rank int").repartition(4)
    got = resampling.resample(docs, spark.createDataFrame([(t,) for t in target], "text string"), n, 50, 30, 6, 9)
    assert sorted(map(tuple, got.collect()), key=repr) == resampled(rows, target, n, 50, 30, 6, 9)


def test_resampling_of_empty_tables(spark, rest):
    none = rest.limit(0)
    assert resampling.resample(none, rest).count() == 0
    assert {r["weight"] for r in resampling.resample(rest.where("doc_id = 0"), none).collect()} == {0}


def test_queries_equal_brute_force(spark, tmp_path):
    rows = [(i, t) for i, t, _ in HARD]
    for name in ("documents", "benchmark"):
        spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(str(tmp_path / f"{name}.parquet"))
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    assert sorted(map(tuple, queries.op13_substring_dedup(spark, str(tmp_path)).collect())) == sorted((*r[:3], sha(r[3])) for r in substrings(rows, 20))
    want = [(r[0], *r[2:]) for r in resampled(rows, [t for _, t in rows], 2, 10_000, 25, 20, 7)]
    assert sorted(map(tuple, queries.op12_resampling(spark, str(tmp_path)).collect()), key=repr) == sorted(want, key=repr)
