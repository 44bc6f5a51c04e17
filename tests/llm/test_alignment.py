"""Cross-tokenizer alignment against whole-text encoding and a plain walk over both sides."""

import hashlib
from collections import Counter, defaultdict

import public_tokenizers as P
import pytest
import sentencepiece
from brute import HARD
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from cairn.llm import alignment, queries
from cairn.llm.alignment import _byte_values

A, B = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")
ODD = [
    "<|endoftext|> and <s> </s> <unk> <0x41>", "▁ a ▁b", "line one\n line two\n\n  three\t four \n", "   lead and trail   ", "a  b  c　 d​ e", "it's we'll I'M  don't",
    "x" * 20_000, "日本語テキスト 漢字\n かな", "emoji 👩‍👩‍👧 and é é", "\x00 nul \x1f in", " ", "  ", "—  – a",
]


def brute(texts):
    a_side, b_side = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    a_side.encode_special_tokens = True
    values, names = _byte_values(), {i: x for x, i in a_side.get_vocab().items()}
    rows, count = [], Counter()
    for text in texts:
        text = text or ""
        want = (" " + text).encode()
        a = [(i, bytes(values[c] for c in names[i])) for i in a_side.encode(" " + text, add_special_tokens=False).ids] if text else []
        b = [(i, bytes([int(b_side.id_to_piece(i)[3:5], 16)]) if b_side.is_byte(i) else b_side.id_to_piece(i).replace("▁", " ").encode()) for i in b_side.encode(text)]
        if not text or b"".join(x for _, x in a) != want or b"".join(x for _, x in b) != want:
            rows.append(None)
            continue
        sides = []
        for tokens in (a, b):
            at, out = 0, []
            for i, x in tokens:
                out.append((i, at, at + len(x)))
                at += len(x)
            sides.append(out)
        a, b = sides
        links, j = [], 0
        for i, lo, hi in a:
            while b[j][2] <= lo:
                j += 1
            k = j
            while k < len(b) and b[k][1] < hi:
                links.append((i, b[k][0]))
                k += 1
        shared = sorted({x[2] for x in a} & {x[2] for x in b})
        groups, p, q = [], 0, 0
        for end in shared:
            r, s = p, q
            while r < len(a) and a[r][2] <= end:
                r += 1
            while s < len(b) and b[s][2] <= end:
                s += 1
            groups.append(",".join(str(x[0]) for x in a[p:r]) + "|" + ",".join(str(x[0]) for x in b[q:s]))
            p, q = r, s
        rows.append((len(a), len(b), groups, links))
        count.update(links)
    best = defaultdict(int)
    for (_, b), n in count.items():
        best[b] = max(best[b], n)
    out = [(0, 0, 0, 0, 0, 0, "") if r is None else (r[0], r[1], len(r[2]), len(r[3]), sum(count[x] == best[x[1]] for x in r[3]), sum(count[x] for x in r[3]), ";".join(r[2])) for r in rows]
    return out, count


@pytest.mark.parametrize("size", [alignment.SLICE, 60])
def test_against_brute_force(spark, monkeypatch, size):
    monkeypatch.setattr(alignment, "SLICE", size)
    texts = [t for _, t, _ in HARD] + ODD
    rows = [(i, t, 1, "n", 5) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, slice int, pairs string, n_a int").repartition(3)
    want, count = brute(texts)
    found, pairs = alignment.align(docs, A, B)
    got = {r["id"]: tuple(r[1:]) for r in found.collect()}
    assert len(got) == len(texts)
    for i, w in enumerate(want):
        assert got[i] == w, texts[i]
    assert {(r["a_id"], r["b_id"]): r["n"] for r in pairs.collect()} == dict(count)


def test_runs_of_any_length_agree(monkeypatch):
    """The same links and groups however the tokens of a few texts, one of them very long, are cut into runs."""
    import pyarrow as pa

    sides, found = alignment.Sides.of(A, B), []
    cells = alignment._cells(pa.array(ODD + ["ab" * 3000 + "日本語" * 500], pa.large_string()))[0].dictionary_encode().dictionary
    (a, n_a), (b, n_b) = sides.encode(cells)
    sizes, (flat, offsets) = [len(x.as_py().encode()) for x in cells], alignment.text_buffer(cells)
    bad = alignment._misspelt(a, n_a, sides.a_bytes, sizes, flat[offsets[0] : offsets[-1]]) | alignment._misspelt(b, n_b, sides.b_bytes, sizes, flat[offsets[0] : offsets[-1]])
    for tokens in (90, 1000, 10**6):
        monkeypatch.setattr(alignment, "TOKENS", tokens)
        links, groups = alignment._aligned(sides.sql, alignment._intervals(a, n_a, sides.a_bytes, bad), alignment._intervals(b, n_b, sides.b_bytes, bad))
        texts, sums = alignment._listed(groups, len(cells))
        total = Counter()
        for c, p, n in zip(links["cell"].tolist(), links["pair"].tolist(), links["n"].tolist()):
            total[c, p] += n
        found.append((total, texts.to_pylist(), {k: v.tolist() for k, v in sums.items()}))
    assert all(x == found[0] for x in found)


def test_null_and_repeated_rows(spark, rest):
    found = alignment.align(rest, A, B)[0].select("id", "n_a", "n_b", "groups").collect()
    assert len(found) == rest.count()
    nine = [r for r in found if r["id"] == 9]
    assert len(nine) == 2 and nine[0] == nine[1] and nine[0]["n_a"] > 0
    assert [r["n_a"] > 0 for r in found if r["id"] is None] == [True]
    assert alignment.align(rest.limit(0), A, B)[0].count() == 0


def test_query_equals_brute_force(spark, tmp_path):
    texts = [t for _, t, _ in HARD]
    spark.createDataFrame([(i, t) for i, t, _ in HARD], "doc_id long, text string").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    got = {r["doc_id"]: tuple(r[1:]) for r in queries.op11_alignment(spark, str(tmp_path)).collect()}
    want, _ = brute(texts)
    assert got == {i: (*w[:6], w[6] and hashlib.sha256(w[6].encode()).hexdigest()) for (i, _, _), w in zip(HARD, want)}
