"""Texts and brute-force helpers of these tests."""

import re
import zlib

#: Texts that each operator must stand: nothing, white space, repeats, ties, other scripts, and one that is very long.
HARD = [
    (0, None, "a"), (1, "", "a"), (2, " \t\n ", None), (3, "The same line of text\nsecond LINE here\n\nx", "b"), (4, "  the same LINE of text \nother words stand in this one", "b"),
    (5, "The same line of text\nsecond LINE here\n\nx", "b"), (6, "ünïcode Ärger straße ΑΒΓ 日本語 テキスト　x y", "c"), (7, "a", "c"), (8, "word " * 40_000, "c"), (9, "one two three four five six seven eight nine ten", "a"),
    (10, "One two  three four\tfive six seven eight nine TEN", "a"), (11, "one two three four five six seven eight nine eleven", None), (-3, "x y", ""),
]


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def crc(i):
    return zlib.crc32(str(i).encode())


def labels_of(n, pairs):
    root = list(range(n))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for x, y in pairs:
        p, q = find(x), find(y)
        root[max(p, q)] = min(p, q)
    return [find(i) for i in range(n)]
