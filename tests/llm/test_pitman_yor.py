"""Seating of the Pitman-Yor model: all customers of a dish move, and each context has a restaurant."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cairn.llm import pitman_yor


@pytest.mark.parametrize("weight", [0.3, 20.0, 3000.0])
def test_table_counts_forget_their_start(weight):
    rng, n = np.random.default_rng(1), 300
    for c in (10_000, 1_000_000):
        means = []
        for start in (1, c):
            t, kept = np.full(n, float(start)), []
            for step in range(36):
                t = pitman_yor._gibbs(rng, np.full(n, float(c)), t, np.full(n, weight), 0.8)
                assert (t >= 1).all() and (t <= c).all()
                kept += [t.mean()] if step >= 18 else []
            means.append(np.mean(kept))
        assert abs(means[0] - means[1]) < 0.03 * means[0], (c, means)


@pytest.mark.parametrize("weight", [0.2, 5.0, 60.0, 900.0])
def test_table_counts_agree_with_the_conditional(weight):
    table = pitman_yor._stirling(0.8, 400)
    rng = np.random.default_rng(2)
    for c in (2, 9, 128, 129, 400):
        log = table[c, 1 : c + 1] + np.arange(1, c + 1) * np.log(weight)
        p = np.exp(log - log.max())
        want = (p / p.sum()) @ np.arange(1, c + 1)
        t, kept = np.ones(2000), []
        for step in range(24):
            t = pitman_yor._gibbs(rng, np.full(2000, float(c)), t, np.full(2000, weight), 0.8)
            kept += [t.mean()] if step >= 8 else []
        assert abs(np.mean(kept) - want) < 0.06 * want, (c, np.mean(kept), want)


def test_rare_contexts_have_restaurants(spark):
    texts = [(3 * i + k, f"left{i} right{i}") for i in range(1500) for k in range(3)]  # no word is one in 1024 tokens
    asked = [(10_000, "left7 right7"), (10_001, "left7 right8"), (10_002, "unseen right7")]
    docs = spark.createDataFrame(texts + asked, "doc_id long, text string")
    got = {r["id"]: r for r in pitman_yor.score_texts(docs, F.col("doc_id") >= 10_000).collect()}
    assert got[10_000]["score"] > got[10_001]["score"] + 0.5
    assert got[21]["score"] > got[21]["base_score"] + 0.5
