"""Whole texts to token ids with a public tokenizer, within tasks. Each distinct part of a text is encoded once."""

from __future__ import annotations

import itertools
import json
import os
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import kept, text_buffer

#: Pieces and parts in one generation of a worker's memories. Two generations are kept, and strings of over LONGEST bytes never
#: are, so both memories take some 130 MB at most.
PIECES, PARTS, LONGEST = 250_000, 160_000, 48
#: Parts that the library encodes at once (its answers are large).
BATCH = 2048
#: Bytes of text that are cut at once.
SLICE = 8 << 20

_LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"
#: Bytes of plain texts: printable ASCII, single spaces and line feeds, and Latin-1 letters (0xC3 and one more byte).
_PLAIN_BYTE = np.zeros(256, bool)
_PLAIN_BYTE[[10, *range(32, 127), 0xC3, *(x for x in range(0x80, 0xC0) if x not in (0x97, 0xB7))]] = True
#: What words are cut from: lower case, and spaces for line feeds. In plain texts 0x80 to 0x9E follow 0xC3 only, as capitals.
_FOLDED_BYTE = np.arange(256, dtype=np.uint8)
_FOLDED_BYTE[10] = 32
_FOLDED_BYTE[[*range(65, 91), *range(0x80, 0x97), *range(0x98, 0x9F)]] += 32
#: Plain pieces are cut further, always where the tokenizer's own pattern ends a token: behind letters, and (words) before letters
#: unless an apostrophe stands there or (bytes) behind a line feed. Many pieces are cut at once, with a NUL between them.
_PLAIN_PIECE = re.compile(rf"[ \n]?[!-~{_LETTERS}]+(?:\n[!-~{_LETTERS}]+)*\n?|[ \n]?")
_CUTS = {"words": re.compile(rf"[{_LETTERS}]+|[^{_LETTERS}\0]*'[{_LETTERS}]+|[^{_LETTERS}\0]+|\0"), "bytes": re.compile(rf" ?[{_LETTERS}]+|[\n\0]|[^{_LETTERS}\n\0]+[{_LETTERS}]*")}
#: Parts that every pattern takes as one word. Longer ones go through the tokenizer, as do letters beyond these.
_WORD_PART = {"words": rf"\A[a-zà-öø-ÿ]{{1,{LONGEST}}}\z", "bytes": rf"\A ?[{_LETTERS}]{{1,{LONGEST}}}\z"}
#: Other texts are cut where a tokenizer can't join anything: (words) at ASCII white space, (bytes) before white space behind
#: other characters. _UNSURE: characters that count as white space for some, where the second cut could be wrong.
_PIECES = {"words": re.compile(r"[^\t-\r ]+"), "bytes": re.compile(r"[\t-\r ]*+[^\t-\r ]+|[\t-\r ]+")}
_ODD = "".join(map(chr, [*range(0x1C, 0x20), 0x85, 0xA0, 0x1680, 0x180E, *range(0x2000, 0x2010), *range(0x2028, 0x2030), *range(0x205F, 0x2065), 0x3000, 0xFEFF]))
_UNSURE = re.compile(f"[{_ODD}][\\t-\\r ]")
#: What starts the string of a special token.
_SPECIAL = "<|"


class _Memory:
    """Ids of strings, in Arrow arrays of at most two generations: what the older one still serves moves to the younger one."""

    def __init__(self, most: int):
        self.most = most
        self.young = self.old = (pa.array([], pa.large_string()), None, None)

    def find(self, names: pa.Array, encode) -> tuple[np.ndarray, np.ndarray]:
        """Ids of some strings, one after another, and how many each has. encode tells both for those that are not kept."""
        place, flats, sizes, upto = np.full(len(names), -1), [], [], 0
        for kept_names, flat, size in (self.old, self.young):
            if len(kept_names):
                found = pc.index_in(kept_names, value_set=names)  # few names are hashed, and not all that is kept
                place[found.drop_null().to_numpy()] = upto + np.flatnonzero(found.is_valid().to_numpy(zero_copy_only=False))
                flats.append(flat)
                sizes.append(size)
                upto += len(kept_names)
        missing = place < 0
        if missing.any():
            flat, size = encode(names.filter(pa.array(missing)))
            flats.append(flat)
            sizes.append(size)
            place[missing] = upto + np.arange(len(size))
        if not flats:
            return encode(names)
        ids, n = _taken(np.concatenate(flats), np.concatenate(sizes), place)
        new = (missing | (place < len(self.old[0]))) & (pc.binary_length(names).to_numpy() <= LONGEST)
        if new.any():
            self._put(names.filter(pa.array(new)), ids[np.repeat(new, n)], n[new])
        return ids, n

    def _put(self, names: pa.Array, flat: np.ndarray, size: np.ndarray) -> None:
        if len(self.young[0]) >= self.most:
            self.young, self.old = (names, flat, size), self.young
        elif len(self.young[0]):
            self.young = (pa.concat_arrays([self.young[0], names]), np.concatenate([self.young[1], flat]), np.concatenate([self.young[2], size]))
        else:
            self.young = (names, flat, size)


class _Ranked:
    """Merges the bytes of a single word as the tokenizer does, by a faster library; for vocabularies whose ids are in the order of their merges.

    A tokenizer that marks the ends of words merges the last byte with the mark before all else: the byte 0xFF, which is in no
    UTF-8, stands for it.
    """

    @classmethod
    def of(cls, path: str) -> _Ranked | None:
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        end, vocab = model.get("end_of_word_suffix") or "", model.get("vocab")
        merges = ["".join(m if isinstance(m, list) else m.split(" ")) for m in model.get("merges") or ()]
        first = 512 if end else 256
        if not merges or model.get("dropout") or any(vocab[m] != first + i for i, m in enumerate(merges)):
            return None
        return cls(vocab, merges, end)

    def __init__(self, vocab: dict[str, int], merges: list[str], end: str):
        import tiktoken

        chars = byte_characters()
        value, self.end = {c: b for b, c in enumerate(chars)}, b"\xff" if end else b""
        ranks = {bytes([b]): vocab[c] for b, c in enumerate(chars)}
        if end:
            ranks |= {bytes([b, 255]): vocab[c + end] for b, c in enumerate(chars[:255])}
        for m in merges:
            last = bool(end) and m.endswith(end)
            ranks[bytes(value[c] for c in (m[: -len(end)] if last else m)) + (self.end if last else b"")] = vocab[m]
        self.merge = tiktoken.Encoding("ranked", pat_str=r"\S+", mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece

    def encode(self, words: list[bytes]) -> list[list[int]]:
        return [self.merge(x + self.end) for x in words]


def byte_characters() -> list[str]:
    """The characters by which byte-level tokenizers write the bytes 0 to 255: printable ones stand for themselves, the others follow one another from U+0100 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


class Encoder:
    """Encodes texts exactly as the tokenizer encodes them whole, add_special_tokens=False, strings of special tokens included.

    kind "words": the tokenizer drops white space and case. kind "bytes": a space starts a token unless other white space
    stands before it. Work and memory grow with the text's length only, whatever it holds.
    """

    @classmethod
    def of(cls, path: str, kind: str) -> Encoder:
        """The worker's own, which it keeps from task to task while these encode; only the last one asked for."""
        own = kept("encoding")
        if (path, kind) not in own:
            own.clear()
            own[path, kind] = cls(path, kind)
        return own[path, kind]

    def __init__(self, path: str, kind: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.kind, self.pieces, self.parts, self.ranked = kind, _Memory(PIECES), _Memory(PARTS), _Ranked.of(path)

    def _cut(self, piece: str) -> list[str]:
        if _SPECIAL in piece or not _PLAIN_PIECE.fullmatch(piece):
            return [piece]
        return _CUTS[self.kind].findall(piece.lower() if self.kind == "words" else piece)

    def _parts(self, pieces: list[str], plain: bool) -> tuple[np.ndarray, pa.Array, np.ndarray]:
        """Parts of pieces as places in an array of distinct parts, that array, and how many parts each piece has."""
        together = "\0".join(pieces) if plain else ""
        if plain and _SPECIAL not in together:
            coded = pa.array(_CUTS[self.kind].findall(together.lower() if self.kind == "words" else together), pa.large_string()).dictionary_encode()
            at, names = coded.indices.to_numpy(), coded.dictionary
            between = at == names.index("\0").as_py()
            return at[~between], names, np.diff(np.flatnonzero(between), prepend=-1, append=len(at)) - 1
        split = list(map(self._cut, pieces))
        coded = pa.array(list(itertools.chain.from_iterable(split)), pa.large_string()).dictionary_encode()
        return coded.indices.to_numpy(), coded.dictionary, np.fromiter(map(len, split), np.int64, len(split))

    def _encoded(self, parts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of parts, one after another, and how many each has. Words of letters are merged as they are; other parts go through the tokenizer."""
        plain = pc.match_substring_regex(parts, _WORD_PART[self.kind]).to_numpy(zero_copy_only=False) if self.ranked else np.zeros(len(parts), bool)
        flat, size = [np.empty(0, self.dtype)], np.zeros(len(parts), np.int64)
        for words in (True, False):
            which = np.flatnonzero(plain == words)
            some = parts.take(pa.array(which))
            some = (some.cast(pa.large_binary()) if words else some).to_pylist()
            for lo in range(0, len(some), BATCH):
                ids = self.ranked.encode(some[lo : lo + BATCH]) if words else [x.ids for x in self.tokenizer.encode_batch_fast(some[lo : lo + BATCH], add_special_tokens=False)]
                size[which[lo : lo + BATCH]] = n = list(map(len, ids))
                flat.append(np.fromiter(itertools.chain.from_iterable(ids), self.dtype, sum(n)))
        # ids of words stand before those of others
        order = np.concatenate([np.flatnonzero(plain), np.flatnonzero(~plain)])
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        return _taken(np.concatenate(flat), size[order], place)

    def _ids(self, pieces: pa.Array, plain: bool) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pieces that are not kept, one after another, and how many each has."""
        at, names, counts = self._parts(pieces.to_pylist(), plain)
        ids, n = _taken(*self.parts.find(names, self._encoded), at)
        upto = np.concatenate([[0], np.cumsum(n)])
        return ids, np.diff(upto[np.cumsum(counts)], prepend=0)

    def _gathered(self, pieces: pa.Array, ends: np.ndarray, plain: bool, lead: str = "") -> tuple[np.ndarray, np.ndarray]:
        """Ids of rows of pieces, and how many each row has. plain: all are plain pieces. lead: what stands before all pieces but a row's first."""
        coded = pieces.dictionary_encode()
        at, names = coded.indices.to_numpy(), coded.dictionary
        if lead:
            firsts = np.concatenate([[0], ends[:-1]])
            at, heads = at.copy(), at[firsts]
            at[firsts] = len(names) + np.arange(len(firsts))
            led = pc.binary_join_element_wise(pa.scalar(lead, names.type), names, pa.scalar("", names.type))
            coded = pa.concat_arrays([led, names.take(pa.array(heads))]).dictionary_encode()
            at, names = coded.indices.to_numpy()[at], coded.dictionary
        tokens, n = _taken(*self.pieces.find(names, lambda x: self._ids(x, plain)), at)
        upto = np.concatenate([[0], np.cumsum(n)])
        return tokens, np.diff(upto[ends], prepend=0)

    def _plain(self, texts: pa.Array) -> np.ndarray:
        """Which texts hold plain bytes and no two white spaces in a row; words are folded, so that these texts hold no special token either."""
        data, offsets = text_buffer(texts)
        base, offsets = int(offsets[0]), offsets - offsets[0]
        x = data[base : base + int(offsets[-1])]
        bad, lead, space = ~_PLAIN_BYTE[x], x == 0xC3, (x == 10) | (x == 32)
        bad[1:] |= (x[1:] >= 0x80) & (x[1:] < 0xC0) & ~lead[:-1]
        pair = space[1:] & space[:-1]
        inner = offsets[1:-1]
        pair[inner[(inner > 0) & (inner < len(x))] - 1] = False
        bad[1:] |= pair
        plain = np.diff(np.searchsorted(np.flatnonzero(bad), offsets)) == 0
        return plain & ~pc.match_substring(texts, _SPECIAL).to_numpy(zero_copy_only=False) if self.kind == "words" else plain

    def _others(self, texts: list[str]) -> list[list[str]]:
        out = []
        for text in texts:
            pieces = _PIECES[self.kind].findall(text)
            if self.kind == "bytes" and _UNSURE.search(text):  # what was cut behind such a character is joined again
                whole: list[list[str]] = []
                for p in pieces:
                    if whole and _UNSURE.match(whole[-1][-1][-1] + p[0]):
                        whole[-1].append(p)
                    else:
                        whole.append([p])
                pieces = ["".join(x) for x in whole]
            out.append(pieces)
        return out

    def encode(self, column) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts of an Arrow string column, one after another, and how many each text has. Null: none."""
        texts = pc.fill_null(column.cast(pa.large_string()), "")
        tokens, counts = [np.empty(0, self.dtype)], [np.empty(0, np.int64)]
        upto = np.concatenate([[0], np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64))])
        lo = 0
        while lo < len(texts):
            hi = max(lo + 1, int(np.searchsorted(upto, upto[lo] + SLICE, "right")) - 1)
            ids, n = self._slice(texts.slice(lo, hi - lo))
            tokens.append(ids)
            counts.append(n)
            lo = hi
        return np.concatenate(tokens), np.concatenate(counts)

    def _slice(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        plain = self._plain(texts)
        if plain.all():
            return self._split(texts)
        (a, n), counts = self._split(texts.filter(pa.array(plain))), np.zeros(len(texts), np.int64)
        pieces = self._others(texts.filter(pa.array(~plain)).to_pylist())
        b, m = self._gathered(pa.array(list(itertools.chain.from_iterable(pieces)), pa.large_string()), np.cumsum(list(map(len, pieces))), False)
        counts[plain], counts[~plain] = n, m
        out = np.empty(counts.sum(), self.dtype)
        of_plain = np.repeat(plain, counts)
        out[of_plain], out[~of_plain] = a, b
        return out, counts

    def _split(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Plain texts are cut at spaces; words at line feeds too."""
        if not len(texts):
            return np.empty(0, self.dtype), np.empty(0, np.int64)
        if self.kind == "words":
            data, offsets = text_buffer(texts)
            folded = _FOLDED_BYTE[data[int(offsets[0]) : int(offsets[-1])]]
            texts = pa.LargeStringArray.from_buffers(len(texts), pa.py_buffer(offsets - offsets[0]), pa.py_buffer(folded))
        lists = pc.split_pattern(texts, " ")
        offsets = lists.offsets.to_numpy()
        return self._gathered(lists.values.slice(offsets[0], offsets[-1] - offsets[0]), offsets[1:] - offsets[0], True, " " if self.kind == "bytes" else "")


def _taken(flat: np.ndarray, size: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """flat holds runs of these sizes: the runs at some places, one after another, and their sizes."""
    n = size[at]
    upto = np.concatenate([[0], np.cumsum(n)])
    return flat[np.repeat((np.cumsum(size) - size)[at] - upto[:-1], n) + np.arange(upto[-1])], n


def with_ends(ids: np.ndarray, counts: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """Unsigned 32-bit ids with the end id behind each text, and the new counts."""
    counts = counts + 1
    out = np.full(int(counts.sum()), end_id, "<u4")
    inner = np.ones(len(out), bool)
    inner[np.cumsum(counts) - 1] = False
    out[inner] = ids
    return out, counts
