import numpy as np
import pytest

from chunkloom.llm import vectors as V


def table(spark, rows):
    return spark.createDataFrame(rows, "chunk_id long, embedding array<float>, bucket string, v int, id int")


def rows_of(ids, xs):
    return [(int(i), [float(z) for z in x], "clash", 7, 7) for i, x in zip(ids, xs)]


def brute(ids, x, k, least):
    order = np.argsort(ids)
    ids, x = np.asarray(ids)[order], np.asarray(x, np.float64)[order]
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = (x @ x.T).round(9)
    np.fill_diagonal(s, -2)
    best = np.argsort(-s, axis=1, kind="stable")[:, :k]
    return {(int(ids[i]), int(ids[j])) for i in range(len(ids)) for j in best[i] if s[i, j] >= least - 1e-9}


def clusters(n, dim, noise, seed=1, groups=40):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(groups, dim))
    x = centres[rng.integers(0, groups, n)] + noise * rng.normal(size=(n, dim))
    return np.arange(1, n + 1), (x * rng.uniform(0.5, 4, (n, 1))).astype(np.float32)


def test_hadamard_keeps_lengths():
    x = np.random.default_rng(0).normal(size=(5, 64))
    assert np.allclose(np.linalg.norm(V.hadamard(x), axis=1), np.linalg.norm(x, axis=1))


def test_recall_against_brute_force(spark):
    ids, x = clusters(1500, 64, 0.15)
    got = {(r.id, r.other) for r in V.most_similar(table(spark, rows_of(ids, x)), "chunk_id", "embedding").collect()}
    want = brute(ids, x, 5, 0.9)
    assert len(got & want) >= 0.97 * len(want)
    assert len(got - want) <= 0.01 * len(want)


@pytest.mark.parametrize("bucket_rows", [40, 10_000])
def test_split_buckets_lose_no_pair(spark, bucket_rows):
    ids, x = clusters(600, 16, 0.05, groups=2)  # two hot buckets
    got = {(r.id, r.other) for r in V.most_similar(table(spark, rows_of(ids, x)), "chunk_id", "embedding", dim=16, bucket_rows=bucket_rows).collect()}
    want = brute(ids, x, 5, 0.9)
    assert len(got & want) >= 0.98 * len(want)


def test_copies_ties_bad_vectors_and_repeats(spark):
    one, near = [1.0] + [0.0] * 63, [1.0, 0.1] + [0.0] * 62
    far = [0.0] * 63 + [1.0]
    good = [(i, one, "x", 1, 1) for i in range(1, 21)] + [(30, near, "x", 1, 1), (40, far, "x", 1, 1)]
    bad = [(50, None, "x", 1, 1), (51, [], "x", 1, 1), (52, [0.0] * 64, "x", 1, 1), (53, [1.0] * 32, "x", 1, 1), (54, [float("nan")] * 64, "x", 1, 1), (None, one, "x", 1, 1)]
    best = V.most_similar(table(spark, good + good[:4] + bad), "chunk_id", "embedding")
    by = {}
    for r in best.collect():
        by.setdefault(r.id, []).append((r.rank, r.other))
    assert [o for _, o in sorted(by[1])] == [2, 3, 4, 5, 6]
    assert [o for _, o in sorted(by[20])] == [1, 2, 3, 4, 5]
    assert [o for _, o in sorted(by[30])] == [1, 2, 3, 4, 5]
    assert 40 not in by and not {50, 51, 52, 53, 54} & set(by)
    pairs = {(r.a, r.b) for r in V.mutual(best).collect()}
    assert pairs == {(a, b) for a in range(1, 7) for b in range(a + 1, 7)}


def mutual_brute(ids, x, k, least):
    best = brute(ids, x, k, least)
    return {(a, b) for a, b in best if a < b and (b, a) in best}


def test_near_copies_and_scaled_copies(spark):
    rng = np.random.default_rng(4)
    x = (rng.normal(size=64) + 0.014 * rng.normal(size=(500, 64))).astype(np.float32)
    ids = np.arange(1, 501)
    got = {(r.a, r.b) for r in V.mutual(V.most_similar(table(spark, rows_of(ids, x)), "chunk_id", "embedding")).collect()}
    assert got == mutual_brute(ids, x, 5, 0.9)
    one = rng.normal(size=64).astype(np.float32)
    y = one * rng.uniform(0.5, 4, (60, 1)).astype(np.float32)
    got = {(r.a, r.b) for r in V.mutual(V.most_similar(table(spark, rows_of(ids[:60][::-1], y)), "chunk_id", "embedding")).collect()}
    s = np.asarray(y, np.float64)
    s /= np.linalg.norm(s, axis=1, keepdims=True)
    assert (s @ s.T).round(12).min() == 1.0
    assert got == {(a, b) for a in range(1, 7) for b in range(a + 1, 7)}


@pytest.mark.parametrize("n, hashes", [(100_000, 1), (10_000_000, 2), (500_000_000, 3)])
def test_recall_near_the_threshold_at_every_size(spark, n, hashes):
    assert V.hashes_per_bucket(n, 64) == hashes
    rng = np.random.default_rng(6)
    a, b = rng.normal(size=(2, 800, 64))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b -= (a * b).sum(1, keepdims=True) * a
    b = 0.902 * a + (1 - 0.902**2) ** 0.5 * b / np.linalg.norm(b, axis=1, keepdims=True)
    ids, x = np.arange(1, 1601), np.concatenate((a, b)).astype(np.float32)
    vectors = spark.createDataFrame([(int(i), [float(z) for z in v]) for i, v in zip(ids, x)], "id long, v array<float>")
    got = {(r.a, r.b) for r in V.candidates(vectors, n, 64, 5, 0.9).collect()}
    want = {(i, j) for i, j in brute(ids, x, 5, 0.9) if i < j}
    assert len(want) >= 800
    assert len(got & want) >= 0.995 * len(want)


@pytest.mark.parametrize("noise", [0.003, 0.01, 0.15])
@pytest.mark.parametrize("bucket_rows", [50, 20_000])
def test_recall_on_tight_and_spread_clusters(spark, noise, bucket_rows):
    ids, x = clusters(1000, 64, noise, seed=3, groups=10)
    got = {(r.id, r.other) for r in V.most_similar(table(spark, rows_of(ids, x)), "chunk_id", "embedding", bucket_rows=bucket_rows).collect()}
    want = brute(ids, x, 5, 0.9)
    assert len(got & want) >= 0.98 * len(want)


def test_tiles_of_a_hot_bucket_are_bounded(spark):
    rows = [(1, i, 0 if i < 300 else 1, b"v") for i in range(500)] + [(2, 7, 0, b"v")]
    placed = spark.createDataFrame(rows, "bucket long, id long, role int, v binary")
    large = spark.createDataFrame([(1, 6, 10)], "bucket long, owns int, askers int")
    out = V._tiled(placed, large).toPandas()
    hot = out[out.bucket != 2]
    sizes = hot.groupby(["bucket", "role"]).size().unstack()
    assert len(sizes) == 60 and sizes[1].max() < 90 and sizes[2].max() < 90
    seen = {(a, o) for _, g in hot.groupby("bucket") for a in g.id[g.role == 1] for o in g.id[g.role == 2]}
    assert seen == {(a, o) for a in range(500) for o in range(300)}
    assert out[out.bucket == 2][["id", "role"]].values.tolist() == [[7, 0]]


def test_empty(spark):
    assert V.most_similar(table(spark, []), "chunk_id", "embedding").count() == 0
