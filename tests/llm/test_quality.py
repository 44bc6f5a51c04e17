"""The quality classifier on texts that differ by words only."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cairn.llm import quality

GOOD = "river stone light water green table paper cloud house field story plant".split()
BAD = "bonus prize click cheap deals coins offer loans spins bingo lucky crypt".split()


@pytest.mark.parametrize("script", ["latin", "cyrillic", "han"])
def test_texts_that_differ_by_words_only(spark, script):
    rng = np.random.default_rng(6)
    plain = {"latin": "", "cyrillic": "абвгдежзиклмнопрстуфхцчшщ", "han": "天地玄黄宇宙洪荒日月盈昃辰宿列张寒来暑往秋"}[script]

    def text(words):
        x = "".join if script == "han" else " ".join
        spelt = lambda w: "".join(plain[(ord(c) - 97) % len(plain)] for c in w.ljust(5, "e")[:5]) if plain else w.ljust(5, "e")[:5]
        return x(spelt(words[k]) for k in rng.integers(0, len(words), 60))

    rows = [(i, text(GOOD if i % 2 else BAD), i % 2) for i in range(240)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, quality int")
    model = quality.fit(docs.select("doc_id", "text"), docs.select("doc_id", "quality"))
    got = quality.score(docs, model, "vote").where(quality.held_out(F.col("doc_id"))).collect()
    right = np.mean([(r["vote"] >= 0.7) == bool(r["quality"]) for r in got])
    print(script, len(got), right)
    assert len(got) > 30 and right > 0.95
