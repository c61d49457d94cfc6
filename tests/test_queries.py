from spanlattice.queries import curation, intervals


def test_hashes_of_all_elements(spark, tmp_path):
    """The second half of a vector counts as the first does."""
    flip = lambda v, at: [-x if k in at else x for k, x in enumerate(v)]
    base = [1.0 if k % 3 else -1.0 for k in range(64)]
    rows = [(1, base), (2, flip(base, range(32, 64))), (3, flip(base, [*range(8), 40, 50])), (4, base)]
    spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    at = str(tmp_path)
    kept = {r.id for r in curation.dedup_greedy(spark, at).collect()}
    assert kept in ({1, 2}, {2, 3})
    assert {tuple(r) for r in curation.hash_classes_64(spark, at).collect()} == {(1, 1), (2, 2), (3, 3), (4, 1)}
    assert [tuple(r) for r in curation.hash_pairs_64(spark, at).collect()] == [(1, 3, 10)]


def test_consensus_without_usable_boxes(spark, tmp_path):
    """What the runs share is found, whatever the stored boxes say."""
    meta = [(k, 0, axis) for k, axis in enumerate(("xy", "xz", "yz"))]
    box, far, none = (0, 0, 0, 4, 4, 4), (9, 9, 9, 12, 12, 12), (None,) * 6
    rows = [(10 * k + n, n, 0, 10 * k + n, *b, [100 * k], [10]) for k, pair in enumerate([(box, box), (box, none), (none, none), (box, far)]) for n, b in enumerate(pair)]
    spark.createDataFrame(meta, "src int, dataset_id int, axis string").write.parquet(f"{tmp_path}/tracker_meta.parquet")
    schema = "object_id bigint, src int, class_id int, label bigint, z1 int, y1 int, x1 int, z2 int, y2 int, x2 int, starts array<bigint>, runs array<bigint>"
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/tracked_object.parquet")
    got = {tuple(r) for r in intervals.consensus_runs(spark, str(tmp_path)).collect()}
    assert got == {(k + 1, 100 * k, 100 * k + 10) for k in range(4)}


def test_tiles_to_the_last_index(spark, tmp_path):
    """Runs beyond 400 windows, and beyond 1,000 rows of 1,000."""
    at = [0, 3, 179_263, 179_264, 200_000, 999_999, 1_000_000, 1_500_001]
    li = [(4 * i, 1, 5) for i in at]
    spark.createDataFrame(li, "l_orderkey bigint, l_linenumber int, l_suppkey bigint").write.parquet(f"{tmp_path}/lineitem.parquet")
    clipped = intervals.tile_clip(spark, str(tmp_path)).collect()
    want = {(t, i - 448 * t) for i in at for t in (i // 448 - 1, i // 448) if t >= 0 and i < 448 * t + 512}
    assert sorted((r.tile, i) for r in clipped for i in range(r.s, r.e)) == sorted(want)
    back = [i for r in intervals.tile_round_trip(spark, str(tmp_path)).collect() for i in range(r.s, r.e)]
    assert sorted(back) == at
    (tmp_path / "none").mkdir()
    spark.createDataFrame([], "l_orderkey bigint, l_linenumber int, l_suppkey bigint").write.parquet(f"{tmp_path}/none/lineitem.parquet")
    assert not intervals.tile_clip(spark, f"{tmp_path}/none").collect() and not intervals.tile_round_trip(spark, f"{tmp_path}/none").collect()
