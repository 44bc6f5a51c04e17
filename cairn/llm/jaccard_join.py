"""N-gram Jaccard self-join: signature trees of token bitmaps and size ranges, traversed in pairs, over exactly routed groups."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, attach, connected_components, in_group, in_task, mix, prefilter
from .shingles import shingle_sets

#: Shingles in one block of a group; larger groups are compared block by block.
BLOCK_SHINGLES = 1_500_000
FANOUT = 8
#: Bits of the bitmap that stands for a set while groups are narrowed down, and members that are then compared at once.
SKETCH = 4096
MEMBERS = 4000


# ---- routing: two sets with a link share the hash of a part of themselves


def part_signatures(s: np.ndarray, num: int, den: int) -> np.ndarray:
    """Hashes of parts of a sorted set, such that two sets of Jaccard similarity >= num / den have one in common.

    Sets of sizes a, b differ in at most D = (a + b)(den - num)/(den + num) elements then. The larger one's size, to a power
    of two, bounds D for all pairs of that class; cut by hash into over D parts, two such sets agree in one. A set whose
    partner can be of the next class signs for that too. Empty parts say nothing and are left out, unless a set has so many
    that the differences could touch all others.
    """
    n, out = len(s), []
    most = n * den // num
    mixed = mix(s ^ np.uint64(0x5851F42D4C957F2D))
    own = n.bit_length() - 1
    for g in (own, own + 1) if most >= 2 << own else (own,):
        worst = 2 * ((2 << g) - 1) * (den - num) // (den + num)
        parts = worst + 3 + worst // 16
        which = ((s >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)
        starts = np.flatnonzero(np.concatenate([[True], which[1:] != which[:-1]]))
        label = which[starts] + np.uint64(g << 48)
        out.append(mix(np.add.reduceat(mixed, starts) + mix(label)))
        if len(starts) <= (n + min(most, (2 << g) - 1)) * (den - num) // (den + num):
            empty = np.setdiff1d(np.arange(parts, dtype=np.uint64), which[starts], assume_unique=True)
            out.append(mix(mix(empty + np.uint64(g << 48)) + np.uint64(1)))
    return np.concatenate(out)


def sketch(s: np.ndarray) -> bytes:
    bits = np.zeros(SKETCH, bool)
    bits[(s & np.uint64(SKETCH - 1)).astype(np.int64)] = True
    return np.packbits(bits).tobytes()


def digest(s: np.ndarray) -> tuple[int, int]:
    import hashlib

    d = hashlib.blake2b(s.tobytes(), digest_size=16).digest()
    return int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True)


def _signed(words: int, num: int, den: int):
    """Per batch: of each distinct set its signatures, those that another set of the batch has too being links to that one."""
    @in_task("jaccard")
    def run(batches):
        for batch in (b.slice(lo, 1000) for b in batches for lo in range(0, b.num_rows, 1000)):  # bounds what a task holds
            n, d1, d2, maps, keys, owner, seen = [], [], [], [], [], [], set()
            for s in shingle_sets(batch.column("text"), words):
                a, b = digest(s) if len(s) else (0, 0)
                if len(s) and (a, b) not in seen:
                    seen.add((a, b))
                    keys.append(part_signatures(s, num, den))
                    owner.append(len(n))
                n.append(len(s))
                d1.append(a)
                d2.append(b)
                maps.append(sketch(s))
            sigs, links, heads = ([np.empty(0, np.int64)] * len(n) for _ in range(3))
            if keys:
                at = np.repeat(owner, [len(x) for x in keys])
                keys = np.concatenate(keys)
                order = np.lexsort((at, keys))
                keys, at = keys[order], at[order]
                first = np.concatenate([[True], keys[1:] != keys[:-1]])
                head = at[np.maximum.accumulate(np.where(first, np.arange(len(at)), 0))]
                other = ~first & (head != at)
                for out, mask, value in ((sigs, first, keys.view(np.int64)), (links, other, keys.view(np.int64)), (heads, other, np.array(d1, np.int64)[head])):
                    rows, value = at[mask], value[mask]
                    order = np.argsort(rows, kind="stable")
                    who, starts = np.unique(rows[order], return_index=True)
                    for i, x in zip(who.tolist(), np.split(value[order], starts[1:])):
                        out[i] = x
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(n, pa.int64()), pa.array(d1, pa.int64()), pa.array(d2, pa.int64()), pa.array(sigs, pa.list_(pa.int64())), pa.array(links, pa.list_(pa.int64())), pa.array(heads, pa.list_(pa.int64())), pa.array(maps, pa.binary())], ["id", "n", "d1", "d2", "sigs", "links", "heads", "map"])
    return run


@in_task("jaccard")
def _stars(batches):
    """Rows (sig, d1) sorted: each further d1 of a signature, with the first one."""
    sig, head = None, None
    for pdf in batches:
        s, d = pdf["sig"].to_numpy(), pdf["d1"].to_numpy()
        if not len(s):
            continue
        first = np.concatenate([[sig is None or s[0] != sig], s[1:] != s[:-1]])
        at = np.maximum.accumulate(np.where(first, np.arange(len(s)), -1))
        heads = np.where(at >= 0, d[np.maximum(at, 0)], head if head is not None else 0)
        sig, head = s[-1], heads[-1]
        out = pd.DataFrame({"sig": s, "a": d, "b": heads})
        yield out[out["a"] != out["b"]].drop_duplicates()


# ---- signature trees


class SignatureTree:
    """Sets by size; nodes hold the OR of their sets' bitmaps, the range of sizes, and the most elements that a bitmap hides.

    levels[0] are the sets; FANOUT nodes in a row have one parent.
    """

    def __init__(self, sets: list[np.ndarray], bits: int, depth: int | None = None):
        self.order = sorted(range(len(sets)), key=lambda i: (len(sets[i]), int(sets[i][0])))
        self.sets = [sets[i] for i in self.order]
        maps = np.zeros((len(sets), bits), bool)
        for row, s in zip(maps, self.sets):
            row[(s & np.uint64(bits - 1)).astype(np.int64)] = True
        self._grow(np.packbits(maps, axis=1).view(np.uint64), np.array([len(s) for s in self.sets]), depth)

    @classmethod
    def of_maps(cls, maps: np.ndarray, sizes: np.ndarray, depth: int | None = None) -> SignatureTree:
        """From bitmaps alone."""
        tree = cls.__new__(cls)
        tree.order = np.lexsort((maps[:, 0], sizes)).tolist()
        tree.sets = None
        tree._grow(maps[tree.order], sizes[tree.order], depth)
        return tree

    def _grow(self, maps: np.ndarray, size: np.ndarray, depth: int | None) -> None:
        self.levels = [(maps, size, size, size - np.bitwise_count(maps).sum(1, dtype=np.int64))]
        while len(self.levels[-1][1]) > 1 or depth and len(self.levels) < depth:
            m, lo, hi, hidden = self.levels[-1]
            at = np.arange(0, len(lo), FANOUT)
            self.levels.append((np.bitwise_or.reduceat(m, at), np.minimum.reduceat(lo, at), np.maximum.reduceat(hi, at), np.maximum.reduceat(hidden, at)))


def candidate_pairs(left: SignatureTree, right: SignatureTree, num: int, den: int, limit: int = 8192):
    """Arrays of pairs of sets that no pair of nodes above rules out; with left is right, each pair once.

    A pair of nodes is ruled out if no two sizes in their ranges are near enough, or if the most that sets of theirs can have
    in common (bits of both, and what the bitmaps hide) is less than the smallest sizes need.
    """
    own = left is right
    stack = [(len(left.levels) - 1, np.zeros(1, np.int64), np.zeros(1, np.int64))]
    while stack:
        level, a, b = stack.pop()
        (ma, la, ha, ca), (mb, lb, hb, cb) = left.levels[level], right.levels[level]
        keep = (ha[a] * den >= num * lb[b]) & (hb[b] * den >= num * la[a])
        a, b = a[keep], b[keep]
        common = np.bitwise_count(ma[a] & mb[b]).sum(1, dtype=np.int64) + np.minimum(ca[a], cb[b])
        keep = (den + num) * np.minimum(common, np.minimum(ha[a], hb[b])) >= num * (la[a] + lb[b])
        a, b = a[keep], b[keep]
        if not len(a):
            continue
        if not level:
            yield a, b
            continue
        fan = np.arange(FANOUT)
        x = np.repeat(a[:, None] * FANOUT + fan, FANOUT, axis=1).ravel()
        y = np.tile(b[:, None] * FANOUT + fan, FANOUT).ravel()
        keep = (x < len(left.levels[level - 1][1])) & (y < len(right.levels[level - 1][1]))
        if own:
            keep &= x < y if level == 1 else x <= y
        x, y = x[keep], y[keep]
        for at in reversed(range(0, len(x), limit)):
            stack.append((level - 1, x[at : at + limit], y[at : at + limit]))


def link(sets: list[np.ndarray], side: np.ndarray, num: int, den: int) -> list[tuple[int, int]]:
    """Indices of linked sets: a spanning forest of all links within side 0, or between sides 0 and 1 if both occur.

    Pairs that earlier links connect already need no look.
    """
    root = list(range(len(sets)))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = i = root[root[i]]
        return i

    if not (side == 0).any():
        return []
    bits = 1 << min(14, max(8, (4 * max(map(len, sets)) - 1).bit_length()))
    at = [np.flatnonzero(side == k) for k in (0, 1)]
    left = SignatureTree([sets[i] for i in at[0]], bits)
    if len(at[1]):
        right = SignatureTree([sets[i] for i in at[1]], bits, len(left.levels))
        if len(right.levels) > len(left.levels):
            left = SignatureTree([sets[i] for i in at[0]], bits, len(right.levels))
        names = at[0][left.order], at[1][right.order]
    else:
        right, names = left, (at[0][left.order],) * 2
    out = []
    for a, b in candidate_pairs(left, right, num, den):
        for i, j, x, y in zip(a.tolist(), b.tolist(), names[0][a].tolist(), names[1][b].tolist()):
            p, q = find(x), find(y)
            if p != q:
                s, t = left.sets[i], right.sets[j]
                common = len(np.intersect1d(s, t, assume_unique=True))
                if den * common >= num * (len(s) + len(t) - common):
                    root[max(p, q)] = min(p, q)
                    out.append((x, y))
    return out


def narrow(maps: np.ndarray, sizes: np.ndarray, side: np.ndarray, num: int, den: int) -> list[tuple[int, int]]:
    """Indices of a spanning forest of the pairs that bitmaps and sizes don't rule out, within side 0 or between sides 0 and 1."""
    root = np.arange(len(sizes))
    at = [np.flatnonzero(side == k) for k in (0, 1)]
    if not len(at[0]):
        return []
    left = right = SignatureTree.of_maps(maps[at[0]], sizes[at[0]])
    if len(at[1]):
        right = SignatureTree.of_maps(maps[at[1]], sizes[at[1]], len(left.levels))
        if len(right.levels) > len(left.levels):
            left = SignatureTree.of_maps(maps[at[0]], sizes[at[0]], len(right.levels))
    a_names, b_names = at[0][left.order], (at[1] if len(at[1]) else at[0])[right.order]
    for a, b in candidate_pairs(left, right, num, den):
        a, b = a_names[a], b_names[b]
        while True:
            ra, rb = root[a], root[b]
            low = np.minimum(ra, rb)
            if (ra == rb).all():
                break
            np.minimum.at(root, ra, low)
            np.minimum.at(root, rb, low)
            while (root[root] != root).any():
                root = root[root]
    hung = np.flatnonzero(root != np.arange(len(sizes)))
    return list(zip(hung.tolist(), root[hung].tolist()))


def narrow_pairs(maps: np.ndarray, sizes: np.ndarray, first: np.ndarray, num: int, den: int) -> np.ndarray:
    """Of pairs (first, first + 1), those that bitmaps and sizes don't rule out: what narrow() does with groups of two, for many at once."""
    a, b = sizes[first], sizes[first + 1]
    hidden = sizes - np.bitwise_count(maps).sum(1, dtype=np.int64)
    common = np.bitwise_count(maps[first] & maps[first + 1]).sum(1, dtype=np.int64) + np.minimum(hidden[first], hidden[first + 1])
    return first[((den + num) * np.minimum(common, np.minimum(a, b)) >= num * (a + b)) & (np.minimum(a, b) * den >= num * np.maximum(a, b))]


def _narrowed(num: int, den: int):
    """Rows (sig, i, j, side, d1, n, map) sorted by group, to the (a, b) that hang a group together. Groups of two, which most are, are judged together."""
    def judge(rows: pa.Table) -> pa.RecordBatch:
        sig, i, j, side, d, n = (rows.column(c).to_numpy() for c in ("sig", "i", "j", "side", "d1", "n"))
        maps = np.frombuffer(b"".join(rows.column("map").to_pylist()), np.uint64).reshape(len(d), SKETCH // 64)
        starts = np.flatnonzero(np.concatenate([[True], (sig[1:] != sig[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])]))
        size = np.diff(starts, append=len(d))
        two = narrow_pairs(maps, n, starts[size == 2], num, den)
        a, b = [d[two + 1]], [d[two]]
        for lo, m in zip(starts[size > 2].tolist(), size[size > 2].tolist()):
            pairs = np.array(narrow(maps[lo : lo + m], n[lo : lo + m], side[lo : lo + m], num, den), np.int64).reshape(-1, 2) + lo
            a.append(d[pairs[:, 0]])
            b.append(d[pairs[:, 1]])
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], ["a", "b"])

    @in_task("jaccard")
    def run(batches):
        rest = None  # rows of the group that may go on in the next batch
        for batch in (b.slice(lo, 4096) for b in batches for lo in range(0, b.num_rows, 4096)):
            rows = pa.Table.from_batches([batch])
            rows = rows if rest is None else pa.concat_tables([rest, rows])
            key = [rows.column(c).to_numpy() for c in ("sig", "i", "j")]
            other = np.flatnonzero((key[0] != key[0][-1]) | (key[1] != key[1][-1]) | (key[2] != key[2][-1]))
            last = int(other[-1]) + 1 if len(other) else 0
            rest = rows.slice(last)
            if last:
                yield judge(rows.slice(0, last))
        if rest is not None:
            yield judge(rest)

    return run


def jaccard_join(docs: DataFrame, words: int = 5, num: int = 4, den: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_shingles, component_id): for each row the number of its distinct shingles and the smallest id that links lead to.

    Two rows link when den * |intersection| >= num * |union| of their sets of `words`-word shingles (A-Z lower-cased). Fewer
    words are one shingle. Rows without words, null texts among them, have an empty set and link with nothing. Equal sets
    are one class, compared once. Rows with a null id link with nothing and have a null component; rows that share an id are
    compared by each of their sets. An empty table gives no rows.

    Sets that can link share a part's hash, exactly (part_signatures). Among the sets of one such hash, signature trees over
    bitmaps tell which pairs can link at all; what these connect is one group. Each group's texts meet once, in a task of bounded size, or, if the group is larger, in one for each two of its blocks, where
    signature trees are traversed in pairs and what remains is compared exactly.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "jaccard")
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    signed = scratch.save(rows.mapInArrow(_signed(words, num, den), "id long, n long, d1 long, d2 long, sigs array<long>, links array<long>, heads array<long>, map binary"), "signed")
    stars = signed.select(F.explode("sigs").alias("sig"), "d1").repartition("sig").sortWithinPartitions("sig", "d1").mapInPandas(_stars, "sig long, a long, b long")
    near = signed.where(F.size("links") > 0).select("d1", F.explode(F.arrays_zip("links", "heads")).alias("x")).select(F.col("x.links").alias("sig"), F.col("d1").alias("a"), F.col("x.heads").alias("b"))
    shared = scratch.save(near.unionByName(stars), "shared")
    members = scratch.save(shared.select("sig", F.explode(F.array("a", "b")).alias("d1")).distinct(), "members")
    # many hashes have the same members, as near copies share most of their parts: one hash of each is enough
    same = members.groupBy("sig").agg(F.count("*").alias("m"), F.sum(F.pmod(F.xxhash64("d1"), F.lit(1 << 40))).alias("h"), F.sum(F.pmod(F.xxhash64("d1", F.lit(1)), F.lit(1 << 40))).alias("h2"))
    blocks = scratch.save(same.groupBy("m", "h", "h2").agg(F.min("sig").alias("sig")).select("sig", F.ceil(F.col("m") / MEMBERS).cast("int").alias("blocks")), "hashes")
    maps = signed.where("n > 0").groupBy("d1").agg(F.first("n").alias("n"), F.first("map").alias("map"))
    spread = lambda df, key: df.withColumn("mine", F.pmod(F.xxhash64(key), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumns({"i": F.least("mine", "other"), "j": F.greatest("mine", "other"), "side": (F.col("mine") > F.col("other")).cast("int")})

    asked = scratch.save(members.join(blocks, "sig").join(maps, "d1"), "asked")
    sorted_groups = spread(asked, "d1").select("sig", "i", "j", "side", "d1", "n", "map").repartition("sig", "i", "j").sortWithinPartitions("sig", "i", "j")
    edges = sorted_groups.mapInArrow(_narrowed(num, den), "a long, b long").distinct()
    edges = scratch.save(edges, "edges")
    sets = scratch.save(signed.select("id", "n", "d1", "d2"), "sets")
    scratch.drop("signed", "shared", "members", "asked")
    groups = scratch.save(connected_components(edges, scratch, "route"), "groups")
    classes = scratch.save(sets.where("n > 0 and id is not null").groupBy("d1", "d2").agg(F.min("id").alias("rep"), F.count("*").alias("copies"), F.first("n").alias("n")), "classes")
    asked = scratch.save(classes.join(groups.withColumnRenamed("node", "d1"), "d1").select("rep", "n", "component"), "candidates")
    blocks = asked.groupBy("component").agg(F.sum("n").alias("work"), F.count("*").alias("members")).where("members > 1").select("component", F.ceil(F.col("work") / BLOCK_SHINGLES).cast("int").alias("blocks"))
    routed = scratch.save(spread(asked.join(blocks, "component"), "rep").select(F.col("rep").alias("id"), "component", "i", "j", "side"), "routed")

    @in_group("jaccard")
    def verify(pdf):
        sets = list(shingle_sets(pa.array(pdf["text"]), words))
        ids = pdf["id"].to_numpy()
        keep = [k for k, s in enumerate(sets) if len(s)]
        pairs = link([sets[k] for k in keep], pdf["side"].to_numpy()[keep], num, den) if len(keep) > 1 else []
        return pd.DataFrame([(ids[keep[x]], ids[keep[y]]) for x, y in pairs], columns=["a", "b"])

    texts = prefilter(rows, routed, "id").join(routed.hint("merge"), "id").repartition("component", "i", "j")
    links = scratch.save(texts.groupBy("component", "i", "j").applyInPandas(verify, "a long, b long"), "links")
    joined = scratch.save(connected_components(links, scratch, "links"), "joined")
    found = scratch.save(classes.join(joined.withColumnRenamed("node", "rep"), "rep", "left").select("d1", "d2", "copies", F.coalesce("component", "rep").alias("component_id")), "found")
    full = sets.where("n > 0 and id is not null").select("id", "n", F.struct("d1", "d2").alias("d"))
    total = full.count()
    named = attach(full, found.select(F.struct("d1", "d2").alias("d"), "copies", "component_id"), "d", "copies", total)
    rest = sets.where("n = 0 or id is null").select("id", "n", F.col("id").alias("component_id"))
    return named.select("id", "n", "component_id").unionByName(rest).withColumnRenamed("n", "n_shingles")
