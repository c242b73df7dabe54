"""Search on arrays: the kernel against plain distances, and that many queries never form a row for each pair."""

import numpy as np
import pytest

from nearfold.operators import ivf, kmeans, knn, nearest


def table(spark, n, seed, name, dims=14, digits=1):
    values = np.round(np.random.default_rng(seed).random((n, dims)), digits)
    rows = [(i, [float(x) for x in v], "fraud" if i % 3 == 0 else "legit") for i, v in enumerate(values)]
    made = spark.createDataFrame(rows, f"{name} long, vector array<double>, label string")
    return made.drop("label") if name == "q_id" else made


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize(("dims", "kind"), [(14, "plain"), (64, "plain"), (3, "ties"), (14, "levels"), (5, "far away"), (2, "tiny"), (4, "no numbers"), (2, "few")])
def test_kernel_gives_what_plain_distances_give(dims, kind):
    rng = np.random.default_rng(dims)
    q, v = rng.random((600, dims)), rng.random((3 if kind == "few" else 2500, dims))
    if kind in ("ties", "levels"):
        q, v = np.floor(q * 4), np.floor(v * 4)
    if kind == "far away":
        q, v = q * 1e-3 + 1e6, v * 1e-3 + 1e6
    if kind == "tiny":
        q, v = q * 1e-200, v * 1e-200
    if kind == "no numbers":
        q[3, 2], v[:7, 1], v[9, 1] = np.nan, np.inf, np.nan
    sort = lambda found: [x[np.lexsort((found[1], found[2], found[0]))] for x in found]
    for a, b in zip(sort(nearest.k_nearest(q, v, 5)), sort(nearest._plainly(q, v, 5))):
        assert np.array_equal(a, b, equal_nan=True)


def test_many_queries_form_no_row_for_each_pair(spark, monkeypatch):
    q, r = table(spark, 40, 1, "q_id"), table(spark, 300, 2, "vec_id")
    expected = knn.exact_knn(q, r, 5).orderBy("q_id", "rank").collect()
    monkeypatch.setattr(knn, "PAIRS", 1000)
    monkeypatch.setattr(knn, "WORK", 50_000)
    found = knn.exact_knn(q, r, 5)
    assert found.orderBy("q_id", "rank").collect() == expected
    assert "FlatMapCoGroupsInArrow" in plan(found) and "Join" not in plan(found)
    # Ties don't pass on more than k rows for each query and block.
    assert knn.block_join(q, r, 5, 14, 20_000).count() <= 40 * 5 * np.prod(knn.pieces(40, 300, 14, 20_000, 50_000, knn.COPY_BYTES))


def test_many_queries_of_an_index_form_no_row_for_each_candidate(spark, monkeypatch):
    q, r = table(spark, 40, 3, "q_id"), table(spark, 300, 4, "vec_id")
    index = ivf.build(r, kmeans.evenly_spaced(r, 6), 14)
    rows = lambda f, *x: f(q, index, 5, *x).orderBy("q_id", "rank").collect()
    cases = [(ivf.search, (2,)), (ivf.search_labels, (1, 60))]
    expected = [rows(f, *x) for f, x in cases]
    monkeypatch.setattr(knn, "PAIRS", 1000)
    monkeypatch.setattr(knn, "WORK", 30_000)
    monkeypatch.setattr(knn, "SENT_BYTES", 4000)
    assert [rows(f, *x) for f, x in cases] == expected
    assert "FlatMapCoGroupsInArrow" in plan(ivf.search_labels(q, index, 5, 2))


def test_blocks_fit_and_copies_are_bounded():
    for n, m, dims in ((10, 10, 14), (20_000, 80_000, 64), (120_000, 480_000, 64), (1_600_000, 5_400_000, 14)):
        a, b = knn.pieces(n, m, dims, knn.SENT_BYTES, max(knn.WORK, n * m * dims // knn.SPREAD), knn.COPY_BYTES)
        size = 8 * dims + 16
        assert n * size <= a * knn.SENT_BYTES and m * size <= b * knn.SENT_BYTES
        assert (a * m + b * n) * size <= max(knn.COPY_BYTES, knn.COPIES * (n + m) * size)
        assert n * m * dims <= knn.WORK or a * b >= 24


def test_binary_index_keeps_the_order_of_ties(spark, tmp_path):
    # Equal vectors of several partitions: the file has them by partition, the lower numbers in the later one.
    rows = [(i, [0.5] * 14, "fraud" if i < 5 else "legit") for i in range(10)]
    r = spark.createDataFrame(rows, "vec_id long, vector array<double>, label string")
    made = ivf.build(r, kmeans.centroid_frame(spark, [[0.5] * 14, [0.4] * 14]), 14)
    lists = made.lists.selectExpr("CAST(vec_id < 5 AS INT) AS part_id", "CAST(vec_id < 5 AS INT) AS folder", "vec_id", "levels", "label")
    sizes = made.centroids.selectExpr("part_id", "centroid", "part_id * 70L AS byte_offset", "5L AS cnt")
    path = str(tmp_path / "index.bin")
    ivf.to_binary(ivf.Index(sizes, lists, 14), path)
    found = ivf.search_labels(spark.createDataFrame([(1, [0.5] * 14)], "q_id long, vector array<double>"), ivf.from_binary(spark, path), 5, 2).collect()
    assert sorted((x["vec_id"], x["label"]) for x in found) == [(i, "fraud") for i in range(5)]
    # A file without its numbers is numbered through, and numbers of another file are refused.
    (tmp_path / "index.bin.ids").write_bytes(b"")
    with pytest.raises(ValueError):
        ivf.from_binary(spark, path)
    (tmp_path / "index.bin.ids").unlink()
    assert {x["vec_id"] for x in ivf.from_binary(spark, path).lists.collect()} == set(range(10))
