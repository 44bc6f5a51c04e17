"""Each stage of the corpus pipeline, and the whole, against brute force on small tables."""

import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from brute import labels_of, words
from small import SMALL
from pyspark.sql import functions as F

import corpus_pipeline
from cairn.llm import mixing, packing, quality, queries

STAGES = dict(corpus_pipeline.STAGES)
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def odd(spark, rest):
    """Null and repeated ids, one id with two texts of which one is a copy, and columns whose names the operators use."""
    more = [(9, "quite another text under an id that is there twice"), (21, "quite another text under an  id that is there twice"), (22, None), (9, "one two three four five six seven eight nine ten")]
    return rest.unionByName(spark.createDataFrame(more, "doc_id long, text string"), allowMissingColumns=True)


def _rows(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


def test_quality_stage(spark, odd):
    docs, labels = spark.read.parquet(f"{SMALL}/documents.parquet"), spark.read.parquet(f"{SMALL}/labels.parquet")
    kept = STAGES["quality classifier"](spark, docs, SMALL)
    votes = quality.score(docs, quality.fit(docs, labels), "vote").collect()
    assert kept.columns == docs.columns
    assert Counter(_rows(kept)) == Counter((r["doc_id"], r["text"]) for r in votes if r["vote"] >= 0.7)
    assert STAGES["quality classifier"](spark, odd, SMALL).count() <= odd.count()
    assert STAGES["quality classifier"](spark, docs.limit(0), SMALL).count() == 0


@pytest.mark.parametrize("name", ["exact dedup", "n-gram Jaccard join"])
def test_dedup_stages(spark, odd, name):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    for given in (docs, odd):
        rows, kept = _rows(given), STAGES[name](spark, given, SMALL)
        assert kept.columns == given.columns
        kept = _rows(kept)
        assert not Counter(kept) - Counter(rows)
        group = defaultdict(list)
        if name == "exact dedup":
            for i, t in rows:
                group[re.sub(r"[\x20\x09-\x0D]", "", t or "")].append((i, t))
        else:
            sets = []
            for _, t in rows:
                w = words(t)
                sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
            pairs = [(i, j) for i in range(len(rows)) for j in range(i) if sets[i] and sets[j] and 5 * min(len(sets[i]), len(sets[j])) >= 4 * max(len(sets[i]), len(sets[j])) and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])]
            for k, x in zip(labels_of(len(rows), pairs), rows):
                group[k].append(x)
        left = Counter(kept)
        for members in group.values():  # one of each group
            here = [x for x in set(members) if left[x]]
            assert len(here) == 1
            left[here[0]] -= 1
            if given is docs:
                best = min(members, key=lambda x: (-len(x[1] or "") if name == "exact dedup" else 0, x[0]))
                assert here[0] == best
        assert not +left
    assert STAGES[name](spark, odd.limit(0), SMALL).count() == 0


def test_mixing_stage(spark, odd):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    want = {r["id"]: r for r in mixing.mix_sources(docs).collect()}
    mixed = STAGES["mixing sources"](spark, docs, SMALL)
    got = Counter(i for i, _ in _rows(mixed))
    assert mixed.columns == docs.columns and got == +Counter({i: r["copies"] for i, r in want.items()})
    for given in (docs, odd):
        taken, there, target = Counter(), Counter(), {}
        for r in given.collect():
            there[r["source"]] += len(words(r["text"]))
        for r in STAGES["mixing sources"](spark, given, SMALL).collect():
            taken[r["source"]] += len(words(r["text"]))
        target = {r["source"]: r["target"] for r in mixing.mix_sources(given).collect()}
        longest = max(len(words(t)) for _, t in _rows(given))
        assert all(abs(taken[s] - target[s]) <= longest / 2 + 1 for s in there)
    assert STAGES["mixing sources"](spark, odd.limit(0), SMALL).count() == 0


def test_packing_stage(spark, odd):
    got = STAGES["best-fit packing"](spark, odd, SMALL).collect()
    want = packing.pack(odd, queries.tokenizer("byte_bpe_50k.json")).collect()
    key = lambda rows, i: Counter((r[i], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows)
    assert key(got, "doc_id") == key(want, "id")
    places = defaultdict(list)
    for r in got:
        places[r["sequence_id"]].append((r["offset"], r["length"]))
    for items in places.values():
        at = 0
        for offset, length in sorted(items):
            assert offset == at
            at += length
        assert at <= 1024


def test_whole_pipeline(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SMALL)
    key = lambda df: Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in df.collect())
    assert key(corpus_pipeline.run(spark, SMALL)) == key(docs) and corpus_pipeline.ORACLE_SQL is None
    assert np.isfinite(docs.select(F.sum("length")).first()[0])
