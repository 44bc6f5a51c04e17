"""Word-shingle sets of texts as sorted 64-bit hashes, in numpy within tasks."""

from __future__ import annotations

import numpy as np

from .common import mix, text_buffer, word_hashes

#: Bytes of text hashed at once.
PART = 2 << 20


def word_batches(column):
    """(first row, hashes of all words, words of each row) for runs of rows of an Arrow string column."""
    data, offsets = text_buffer(column)
    lo = 0
    while lo < len(offsets) - 1:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + PART, "right")) - 1)
        yield lo, *word_hashes(data, offsets[lo : hi + 1])
        lo = hi


def shingle_sets(column, k: int):
    """For each row, its distinct k-word shingles; fewer words are one shingle, no words none."""
    odd = mix(np.arange(1, k + 1, dtype=np.uint64)) | np.uint64(1)
    for _, words, counts in word_batches(column):
        n = max(0, len(words) - k + 1)
        all_shingles = np.zeros(n, np.uint64)
        for j in range(k):
            all_shingles += words[j : j + n] * odd[j]
        all_shingles = mix(all_shingles)
        at = 0
        for c in counts.tolist():
            if c >= k:
                yield np.unique(all_shingles[at : at + c - k + 1])
            elif c:
                yield mix(np.array([(words[at : at + c] * odd[:c]).sum(dtype=np.uint64) + np.uint64(c)], np.uint64))
            else:
                yield words[:0]
            at += c
