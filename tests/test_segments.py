"""Absorbing masks against a plain loop, on random frames and the query's whole relation; objects' numbers survive repeated batches."""

import random

from small import SMALL

from cairn.operators import segments
from cairn.plans import views
from cairn.plans.relations import relation


def absorbed(own, others, overlap):
    masks, given = {}, {}
    for f, o, u, v in own:
        masks.setdefault(f, {}).setdefault(o, set()).add((u, v))
    for f, d, u, v in others:
        given.setdefault((f, d), set()).add((u, v))
    taken = {}
    for (f, d), p in sorted(given.items()):
        mine = masks.setdefault(f, {})
        into = next((o for o in sorted(mine) if len(mine[o] & p) / len(p) > overlap), None)
        if into is not None:
            mine[into] |= p
        taken[f, d] = into
    return taken, {(f, o, *p) for f, m in masks.items() for o, s in m.items() for p in s}


def test_masks_grow_as_they_absorb(spark):
    rng = random.Random(6)
    box = lambda: (rng.randrange(10), rng.randrange(10), rng.randrange(2, 6))
    rows = lambda n: [(f, i, x + a, y + b) for f in range(4) for i in range(n) for x, y, s in [box()] for a in range(s) for b in range(s)]
    own, others = rows(4), rows(9) + [(9, 1, 0, 0)]
    schema = "frame long, {} long, u long, v long"
    taken, grown = segments.absorb(spark.createDataFrame(own, schema.format("obj_id")), spark.createDataFrame(others, schema.format("det_id")), 0.4)
    want, masks = absorbed(own, others, 0.4)
    assert {(r["frame"], r["det_id"]): r["obj_id"] for r in taken.collect()} == want
    assert {tuple(r) for r in grown.collect()} == masks
    assert any(v is not None for v in want.values()) and want[9, 1] is None


def test_query_equals_the_plain_loop(spark):
    want, _ = absorbed([tuple(r) for r in relation(spark, SMALL, "object_pixels").collect()], [tuple(r) for r in relation(spark, SMALL, "pixels").collect()], 0.3)
    assert {(r["frame"], r["det_id"]): r["obj_id"] for r in views.absorbed_masks(spark, SMALL).collect()} == want


def test_object_numbers(spark, tmp_path):
    schema = "frame long, det_id long, class_id long, obj_id long"
    table = segments.ObjectTable(spark, str(tmp_path))
    first = spark.createDataFrame([(1, 5, 3, None), (0, 2, 4, None), (1, 1, 3, None)], schema)
    for _ in range(2):  # a batch that comes again changes nothing
        got = {(r["frame"], r["det_id"]): r["obj_id"] for r in table.update(first, 0).collect()}
        assert got == {(0, 2): 0, (1, 1): 1, (1, 5): 2}
    table.update(spark.createDataFrame([(2, 0, 4, 0), (2, 1, 9, None), (3, 0, 4, 0)], schema), 1)
    assert sorted((r["obj_id"], r["class_id"], r["first_frame"], r["updates"]) for r in table.objects(1).collect()) == [(0, 4, 0, 3), (1, 3, 1, 1), (2, 3, 1, 1), (3, 9, 2, 1)]
    assert table.objects(0).count() == 3


def test_geometric_segments_equal_a_flood(spark):
    from cairn.plans import scenes

    edge = {(r["u"], r["v"]): r["edge"] for r in scenes.surface_edges(spark, SMALL).collect()}
    thick = {(u + a, v + b) for (u, v), e in edge.items() if e > 0.05 for a in (-1, 0, 1) for b in (-1, 0, 1)}
    left, want = set(edge) - thick, {}
    while left:
        ask, area = [left.pop()], []
        while ask:
            u, v = ask.pop()
            area.append((u, v))
            for n in ((u + 1, v), (u - 1, v), (u, v + 1), (u, v - 1)):
                if n in left:
                    left.remove(n)
                    ask.append(n)
        if len(area) >= 20:
            want |= dict.fromkeys(area, min(v * 2**20 + u for u, v in area))
    assert {(r["u"], r["v"]): r["component"] for r in scenes.geometric_segments(spark, SMALL).collect()} == want and want
