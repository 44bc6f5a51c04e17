"""Scale switching: the stream against the replay, the replay against a plain voxel-by-voxel form, frees pushed down."""

import random

import pytest

from cairn.operators import scales
from cairn.streaming import blocks

RULES = scales.Rules(turns=3)


def updates(seed, frames=24, n=5):
    rng, rows = random.Random(seed), []
    for k in range(n):
        drift = rng.random()
        for f in range(frames):
            if rng.random() < 0.1:
                continue
            wanted = int(4 * abs((f / frames + drift) % 1)) if k else f // 8 % 4
            free = rng.random() < 0.15
            samples = None if free else [None if rng.random() < 0.05 + 0.2 * (k == 2) else rng.uniform(-5, 5) for _ in range(585)]
            rows.append((k * 4096 + 3, f, wanted, free, rng.random() < 0.5, samples))
    return rows


def plain(rows, RULES=RULES):
    """The same rules written with dictionaries of voxels, one block at a time."""
    out = {}
    for key in {r[0] for r in rows}:
        scale, data, seen, bscale, bdata, bseen, turns, last = -1, {}, set(), -1, {}, set(), 0, None
        cells = lambda s: [(x, y, z) for z in range(8 >> s) for y in range(8 >> s) for x in range(8 >> s)]

        def take(data, seen, s, samples, free):
            for i, c in enumerate(cells(s)):
                v = RULES.free if free else samples[scales.OFFSETS[s] + i]
                if v is not None:
                    x, y = data[c]
                    data[c] = ((x * y + v) / (y + 1), min(y + 1, RULES.max_weight))
                    seen.add(c)

        for _, f, wanted, free, inside, samples in sorted(r for r in rows if r[0] == key):
            last = f
            fresh = scale < 0
            loose = free and (fresh or max(v[0] for v in data.values()) < 0.95 * RULES.free)
            to = min(max(RULES.free_scale if loose else max(0, scale - 1), wanted), 3 if fresh else min(3, scale + 1))
            if fresh:
                scale, data = to, {c: (0.0, 0.0) for c in cells(to)}
            elif to == scale:
                bscale, bdata, bseen, turns = -1, {}, set(), 0
            else:
                if to != bscale:
                    bscale, bseen, turns = to, set(), 0
                    if to < scale:
                        bdata = {c: data[tuple(v >> scale - to for v in c)] for c in cells(to)}
                    else:
                        bdata = {}
                        for c in cells(to):
                            under = [data[d] for d in cells(scale) if tuple(v >> to - scale for v in d) == c and data[d][1] > 0]
                            bdata[c] = (sum(v[0] for v in under) / len(under), float(-(-sum(v[1] for v in under) // len(under)))) if under else (0.0, 0.0)
                take(bdata, bseen, bscale, samples, free)
                enough = (len(bseen) << 3 * bscale) >= RULES.share * (len(seen) << 3 * scale)
                turns += inside or enough
                if turns >= RULES.turns and enough:
                    scale, data, seen, bscale, bdata, bseen, turns = bscale, bdata, bseen, -1, {}, set(), 0
                    continue
            take(data, seen, scale, samples, free)
        out[key] = (last, scale, bscale, [data[c][0] for c in cells(scale)], [data[c][1] for c in cells(scale)])
    return out


def states(rows):
    return {r["key"]: (r["frame"], r["scale"], r["buffer"], r["value"], r["weight"]) for r in rows}


def agree(got, want):
    assert got.keys() == want.keys()
    for k, (frame, scale, buffer, value, weight) in want.items():
        assert got[k][:3] == (frame, scale, buffer), k
        assert got[k][3] == pytest.approx(value, abs=1e-9) and got[k][4] == pytest.approx(weight)


def test_replay_equals_the_plain_form(spark):
    rows = updates(1)
    want = plain(rows)
    agree(states(scales.replay(spark.createDataFrame(rows, scales.INPUT), RULES).collect()), want)
    assert len({w[1] for w in want.values()}) > 1  # scales did change


def test_stream_equals_replay_and_repeats_change_nothing(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", blocks.PROVIDER)
    rows = updates(2)
    parts = [[r for r in rows if r[1] < 8], [r for r in rows if 8 <= r[1] < 15], [r for r in rows if 8 <= r[1] < 15], [r for r in rows if r[1] >= 15]]  # the second comes twice
    for i, part in enumerate(parts):
        spark.createDataFrame(part, scales.INPUT).coalesce(1).write.parquet(str(tmp_path / f"in/{i}"))
    got, sizes = {}, []

    def keep(df, _):
        found = df.collect()
        sizes.append(len(found))
        got.update(states(found))

    stream = spark.readStream.schema(scales.INPUT).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    query = blocks.block_stream(stream, RULES).writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination()
    agree(got, plain(rows))
    assert sorted(x for x in sizes if x or True)[:1] == [0]


def test_frees_reach_all_blocks_below(spark):
    depth = 6
    blocks_of = spark.createDataFrame([(0 + 3,), ((1 << 9) + 3,), ((7 << 15) + 3,)], "key long")  # two blocks in the first octant of depth 1, one in the last
    frees = spark.createDataFrame([(0, 0 + 1), (1, (7 << 15) + 3), (1, (3 << 15) + 1), (2, 0)], "frame long, key long")
    got = {tuple(r) for r in scales.push_down(frees, blocks_of, depth).collect()}
    assert got == {(0, 3), (0, (1 << 9) + 3), (1, (7 << 15) + 3), (1, (3 << 15) + 1), (2, 3), (2, (1 << 9) + 3), (2, (7 << 15) + 3)}


def test_voxels_of_states(spark):
    state = spark.createDataFrame([((1 << 9) + 3, 0, 2, -1, [float(i) for i in range(8)], [1.0, 0.0] + [2.0] * 6)], scales.OUTPUT)
    got = sorted(tuple(r) for r in scales.voxels(state, 6).collect())
    assert got == sorted((8 + 4 * (i & 1), 4 * (i >> 1 & 1), 4 * (i >> 2), 2, float(i), 1.0 if i == 0 else 2.0) for i in range(8) if i != 1)


def test_query_equals_the_plain_form(spark):
    from small import SMALL

    from cairn.plans import upkeep

    rows = [(r["key"], r["frame"], r["wanted"], r["free"], r["inside"], None if r["free"] else r["samples"]) for r in upkeep.block_updates(spark, SMALL).collect()]
    want = plain(rows, upkeep.RULES)
    got = {r["key"]: r for r in upkeep.block_scales(spark, SMALL).collect()}
    assert got.keys() == want.keys()
    for k, (frame, scale, buffer, value, weight) in want.items():
        assert (got[k]["frame"], got[k]["scale"], got[k]["buffer"], got[k]["known"]) == (frame, scale, buffer, sum(w > 0 for w in weight))
        assert got[k]["total"] == pytest.approx(sum(value), abs=1e-5)
