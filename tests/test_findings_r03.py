"""Faults found in round 3: work that grew faster than its input, memory that grew with it, and a difference from SQL."""

import math

from small import SMALL


def test_scalar_functions_beyond_probabilities(spark, tmp_path):
    from cairn.plans import scenes

    rows = "(1, 'view', 520.0), (2, 'view', 0.0), (3, 'view', 500.0), (4, 'view', 250.0)"
    spark.sql(f"SELECT CAST(a AS BIGINT) event_id, timestamp'2024-01-01' ts, CAST(1 AS BIGINT) user_id, b event_type, CAST(c AS DOUBLE) value FROM VALUES {rows} AS t(a, b, c)").write.parquet(f"{tmp_path}/events.parquet")
    got = {r["frame"]: (r["odds"], r["bits"], r["p"]) for r in scenes.scalar_functions(spark, str(tmp_path)).collect()}
    assert math.isnan(got[1][0]) and math.isnan(got[1][1]) and got[1][2] == 1.04
    assert got[2][0] == -math.inf and math.isnan(got[2][1]) and got[2][2] == 0
    assert got[3][0] == math.inf and math.isnan(got[3][1]) and got[3][2] == 1
    assert got[4] == (0.0, 1.0, 0.5)


def test_no_window_runs_to_the_last_row(spark, capsys):
    """A frame up to the end is summed up anew for each row: quadratic in a bucket's rows."""
    from cairn.plans import scenes

    for query in (scenes.interpolated_poses, scenes.nearest_frames):
        query(spark, SMALL).explain()
        assert "unboundedfollowing" not in capsys.readouterr().out.lower()


def test_equal_past_positions_pair_once(spark, capsys):
    """Candidates met every past pose around them, not every past position."""
    from cairn.operators import histories

    past = spark.range(500).selectExpr("0.0 x", "0.0 y", "0.0 z", "id / 100 yaw")
    asked = spark.createDataFrame([(1, 0.0, 0.0, 0.0, 6.2), (2, 0.0, 0.0, 0.0, 2.004), (3, 9.0, 0.0, 0.0, 0.0)], "seq long, x double, y double, z double, yaw double")
    got = {r["seq"]: r["rejection"] for r in histories.density_rejection(asked, past, "seq", (1.0, 1.0, 1.0, 1.0), 1.0).collect()}
    assert abs(got[1] - math.exp(-((2 * math.pi - 6.2) ** 2) / 2)) < 1e-9 and abs(got[2] - math.exp(-(0.004**2) / 2)) < 1e-9 and got[3] == 0
    histories.density_rejection(asked, past, "seq", (1.0, 1.0, 1.0, 1.0), 1.0).explain()
    assert "min_by(hyaw" in capsys.readouterr().out


def _sends_the_map(query, spark, capsys):
    query(spark, SMALL).explain()
    assert "BroadcastHashJoin" in capsys.readouterr().out


def test_reads_send_a_small_map_to_the_tasks(spark, capsys):
    """Each probe's 8 to 48 rows were dealt out to meet the map's voxels."""
    from cairn.plans import maps

    for query in (maps.gradients, maps.ray_hits, maps.interpolation):
        _sends_the_map(query, spark, capsys)


def test_entropy_sends_a_small_map(spark, capsys):
    from cairn.plans import maps

    _sends_the_map(maps.ray_entropy, spark, capsys)


def test_spheres_send_a_small_map(spark, capsys):
    from cairn.plans import maps

    _sends_the_map(maps.sphere_free, spark, capsys)


def test_masks_grow_within_a_row(spark, capsys):
    """All copies of all pixels met in one table of hashes."""
    from cairn.plans import scenes

    for query in (scenes.dilated_masks, scenes.eroded_masks):
        query(spark, SMALL).explain()
        assert "collect_set" in capsys.readouterr().out


def test_halo_blocks_are_read_by_index(spark):
    """Values lay in maps, whose entries are searched one after another."""
    from cairn.operators import gather

    leaf = spark.createDataFrame([(1, 2, 3, 0, 1.5, 1.0)], "x long, y long, z long, scale int, value double, weight double")
    row = gather.halo_blocks(leaf).first()
    assert isinstance(row["values"], list) and len(row["values"]) == 1307 and row["values"][2 + 10 * (3 + 10 * 4)] == 1.5 and len(row["scales"]) == 27


def test_covers_of_small_shapes_are_written_once(spark, monkeypatch):
    """Every level of octants was written twice."""
    from cairn.operators import shapes

    saved, save = [], shapes.Scratch.save
    monkeypatch.setattr(shapes.Scratch, "save", lambda self, df, label: saved.append(label) or save(self, df, label))
    one = spark.createDataFrame([(0, 6.3, 6.1, 5.7, 6.3, 6.1, 5.7, 3.2)], "shape long, ax double, ay double, az double, bx double, by double, bz double, radius double")
    assert shapes.cover(one, 5).count() > 0 and saved == ["shapes"]


def test_replay_takes_rows_in_small_batches(spark):
    """All frames of a block came into one task at once."""
    import inspect

    from cairn.operators import scales

    assert "applyInPandas" not in inspect.getsource(scales.replay)
    dense = [(3, f, f % 4, False, f % 2 == 0, [float(f)] + [None] * 584) for f in range(9)] + [(4099, 0, 0, True, False, None)]
    sparse = [(k, f, w, free, inside, None if free else [(0, s[0])]) for k, f, w, free, inside, s in dense]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2")
    try:
        a, b = (sorted(map(str, scales.replay(spark.createDataFrame(rows, scales.INPUT.replace("array<double>", kind))).collect())) for rows, kind in ((dense, "array<double>"), (sparse, "array<struct<i int, v double>>")))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert a == b and len(a) == 2


def test_masks_are_absorbed_over_batches(spark):
    """All pixels of a frame came into one task at once."""
    import inspect

    from cairn.operators import segments

    assert "applyInPandas" not in inspect.getsource(segments.absorb)
    own = spark.createDataFrame([(f, 1, u, 0) for f in (0, 1) for u in range(4)], "frame long, obj_id long, u long, v long")
    others = spark.createDataFrame([(0, 5, u, 0) for u in range(2, 7)] + [(0, 6, u, 0) for u in range(5, 8)] + [(1, 6, u, 0) for u in range(5, 8)] + [(2, 7, 0, 0)], "frame long, det_id long, u long, v long")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2")
    try:
        got = {(r["frame"], r["det_id"]): r["obj_id"] for r in segments.absorb(own, others, 0.3)[0].collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == {(0, 5): 1, (0, 6): 1, (1, 6): None, (2, 7): None}


def test_known_pieces_are_not_cut_again():
    """Every distinct piece of a slice was cut into parts and looked up again, whether it had come before or not."""
    import pyarrow as pa

    from cairn.llm import encoding, queries

    texts = pa.array(["Some plain words, don't\nstop. Some ÉTÉ\n'tis <|EndOfText|> 12", "plain words stop.", "odd\tspaces  and 日本 <|endoftext|>", "a\n\nb", "", None])
    for file, kind in (("word_bpe_49k.json", "words"), ("byte_bpe_50k.json", "bytes")):
        e = encoding.Encoder(queries.tokenizer(file), kind)
        first = [x.tolist() for x in e.encode(texts)]
        assert first[0] == [i for x in texts.to_pylist() for i in e.tokenizer.encode(x or "", add_special_tokens=False).ids]
        e._parts = None
        assert [x.tolist() for x in e.encode(texts)] == first


def test_squares_meet_pooled_rows_without_broadcast(spark, capsys):
    """All squares of all boxes were sent to all tasks, each of which held the boxes of all frames."""
    from cairn.operators import carving

    boxes = spark.createDataFrame([(0, 1, 0, 0, 0, 0), (0, 2, 0, 0, 2, 1), (0, 3, 3, 0, 3, 2), (1, 1, 2, 1, 3, 3)], "frame long, box long, u0 long, v0 long, u1 long, v1 long")
    image = spark.createDataFrame([(f, u, v, 1.0 + u + 4 * v if u != 3 else 0.0) for f in (0, 1) for u in range(4) for v in range(4)], "frame long, u long, v long, depth double")
    told = [carving.pool_boxes(boxes, carving.pooled(image, 4, 4, ["frame"]), 4, 4, ["frame"], ["box"], few) for few in (False, True)]
    want = {(0, 1): (1.0, 1.0, "all"), (0, 2): (1.0, 7.0, "all"), (0, 3): (None, None, "none"), (1, 1): (7.0, 15.0, "part")}
    for df in told:
        assert {(r["frame"], r["box"]): (r["low"], r["high"], r["known"]) for r in df.collect()} == want
    told[0].explain()
    plan = capsys.readouterr().out
    squares = plan[: plan.index("explode")]
    assert "SortMergeJoin" in squares and "BroadcastHashJoin" not in squares


def test_depths_are_summed_where_frames_meet(spark, capsys):
    """A task summed pixels of all its rows of the table before any were dealt out."""
    from cairn.plans.relations import relation

    relation(spark, SMALL, "depths").explain()
    plan = capsys.readouterr().out
    assert "HashAggregate" in plan and plan.rindex("HashAggregate") < plan.rindex("Exchange")
