"""The Pitman-Yor scores against a plain sampler that moves one customer after another, and against the unigram on real texts."""

import math
from collections import Counter

import numpy as np
from brute import words
from small import SMALL
from pyspark.sql import functions as F

from cairn.llm import pitman_yor as py


def plain_sampler(pairs, vocabulary, rng, burn=60, samples=200):
    """Mean predictive probabilities (word, context) of the same model: each customer leaves its table and is seated anew."""
    dishes = sorted(set(pairs))
    seats = {d: [] for d in dishes}  # sizes of tables
    root = {w: [] for w in vocabulary}
    guests, tables = Counter(u for _, u in pairs), Counter()
    base = 1 / (len(vocabulary) + 1)

    def p_root(w):
        n, t = sum(map(sum, root.values())), sum(map(len, root.values()))
        return (sum(root[w]) - py.ROOT_DISCOUNT * len(root[w]) + (py.ROOT_STRENGTH + py.ROOT_DISCOUNT * t) * base) / (py.ROOT_STRENGTH + n)

    def sit(at, new, discount):
        x = [k - discount for k in at] + [new]
        k = rng.choice(len(x), p=np.array(x) / sum(x))
        if k == len(at):
            at.append(1)
            return True
        at[k] += 1
        return False

    def leave(at):
        k = rng.choice(len(at), p=np.array(at) / sum(at))
        at[k] -= 1
        if not at[k]:
            at.pop(k)
            return True
        return False

    def enter(w, u):
        if sit(seats[w, u], (py.STRENGTH + py.DISCOUNT * tables[u]) * p_root(w), py.DISCOUNT):
            tables[u] += 1
            sit(root[w], (py.ROOT_STRENGTH + py.ROOT_DISCOUNT * sum(map(len, root.values()))) * base, py.ROOT_DISCOUNT)

    for w, u in pairs:
        enter(w, u)
    mean = Counter()
    for sweep in range(burn + samples):
        for w, u in pairs:
            if leave(seats[w, u]):
                tables[u] -= 1
                leave(root[w])
            enter(w, u)
        if sweep >= burn:
            for w in vocabulary:
                p = p_root(w)
                for u in guests:
                    at = seats.get((w, u), [])
                    mean[w, u] += (sum(at) - py.DISCOUNT * len(at) + (py.STRENGTH + py.DISCOUNT * tables[u]) * p) / (py.STRENGTH + guests[u]) / samples
    return mean


def test_scores_agree_with_a_plain_sampler(spark):
    rng = np.random.default_rng(8)
    names = ["a", "b", "c", "d", "e", "f"]
    texts = [" ".join(rng.choice(names, rng.integers(1, 6), p=[0.4, 0.25, 0.15, 0.1, 0.05, 0.05])) for _ in range(25)]
    asked = ["a b", "c", "a a a", "f e", "d c b a", ""]
    docs = spark.createDataFrame([*enumerate(texts), *((1000 + i, t) for i, t in enumerate(asked))], "doc_id long, text string")
    got = {r["id"]: r["score"] for r in py.score_texts(docs, F.col("doc_id") >= 1000).collect()}
    chain = lambda t: list(zip([*words(t), "\n"], ["\n", *words(t)]))
    pairs = [p for t in texts for p in chain(t)]
    mean = plain_sampler(pairs, sorted({w for w, _ in pairs}), rng)
    for i, t in enumerate(asked):
        want = sum(math.log10(mean[p]) for p in chain(t))
        assert abs(got[1000 + i] - want) < 0.05 * (len(words(t)) + 1), (t, got[1000 + i], want)


def test_held_out_texts_are_likelier_than_under_the_unigram(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    rows = py.score_texts(docs, F.crc32(F.col("doc_id").cast("string")) % 5 == 1).where("held_out").collect()
    n = sum(r["n_tokens"] for r in rows)
    ours, unigram = (10 ** (-sum(r[c] for r in rows) / n) for c in ("score", "base_score"))
    print("perplexity of held-out tokens", round(ours), "unigram", round(unigram))
    assert ours < unigram
