import numpy as np

from daqframe.llm import ann
from daqframe.llm.ann import hadamard, keys, neighbours

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, every, k):
    out = {}
    for q, x in rows:
        if q % every:
            continue
        near = {}
        for v, y in rows:
            if v != q and len(x) == len(y):
                d = float(np.sqrt(((np.float64(np.float32(x)) - np.float64(np.float32(y))) ** 2).sum()))
                near[v] = min(d, near.get(v, d))
        out[q] = sorted((d, v) for v, d in near.items())[:k]
    return out


def compare(spark, rows, every, k, recall):
    table = spark.createDataFrame([(i, [float(a) for a in x], 0) for i, x in rows], SCHEMA)
    got = {}
    for r in neighbours(table, every, k).collect():
        got.setdefault(r.query_id, {})[r.rank] = (r.score, r.vec_id)
    want = brute(rows, every, k)
    assert set(got) == {q for q, v in want.items() if v}
    hits = total = 0
    for q, near in want.items():
        mine = [got.get(q, {})[i + 1] for i in range(len(near))]
        assert len(got.get(q, {})) == len(near) and mine == sorted(mine)
        exact = {v: d for d, v in brute([(q, dict(rows)[q]), *[(v, x) for v, x in rows if v != q]], every, 10**9)[q]}
        assert all(abs(exact[v] - d) < 1e-12 for d, v in mine)
        hits += len({v for _, v in mine} & {v for _, v in near})
        total += len(near)
    assert hits >= recall * total


def test_recall_ties_and_small_tables(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(600, 20)) + 2 * rng.normal(size=(12, 20))[rng.integers(0, 12, 600)]
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    compare(spark, [(i, v) for i, v in enumerate(x)], 20, 10, 0.9)
    compare(spark, [(i, x[0]) for i in range(40)] + [(40 + i, v) for i, v in enumerate(x[:30])], 10, 10, 0.9)
    compare(spark, [(0, x[0]), (1, x[1]), (2, x[2]), (3, x[3, :5])], 2, 10, 1.0)


def test_unusable_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0], 0), (1, [0.0, 0.0], 0), (2, None, 0), (3, [nan, 1.0], 0), (4, [inf, 1.0], 0), (5, [None, 1.0], 0), (6, [], 0), (None, [1.0, 1.0], 0), (7, [0.0, 3.0], 0), (7, [0.0, 2.0], 0)]
    got = neighbours(spark.createDataFrame(rows, SCHEMA), 2, 10).collect()
    assert [(r.query_id, r["rank"], r.vec_id, r.score) for r in got] == [(0, 1, 7, 5**0.5)]
    assert neighbours(spark.createDataFrame([], SCHEMA)).collect() == []


def test_hash_is_a_rotation():
    x = np.random.default_rng(2).normal(size=(5, 32))
    assert np.allclose(np.linalg.norm(hadamard(x), axis=1), np.linalg.norm(x, axis=1))
    assert np.allclose(hadamard(hadamard(x)), x)
    for depth in (1, 2, 3):
        assert (keys(x, 3, depth)[:, ::3] == keys(2 * x, 1, depth)).all()


def test_hot_buckets_copies_and_deeper_hashes(spark, monkeypatch):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(450, 24))
    x[:150] = x[0] * 5 + 0.05 * rng.normal(size=(150, 24))  # a third of all vectors in one direction
    x[150:300] = x[150]  # and a third the same
    monkeypatch.setattr(ann, "BLOCK", 64)
    compare(spark, [(i, v) for i, v in enumerate(x)], 30, 10, 0.9)
    monkeypatch.setattr(ann, "BUCKET", 4)
    assert ann.depth_of(450, 24) == 2
    compare(spark, [(i, v) for i, v in enumerate(x)], 30, 10, 0.9)


def test_rough_distances_lose_nothing():
    rng = np.random.default_rng(3)
    for scale in (1e-30, 1.0, 1e8, 1e200):
        x = scale * (rng.normal(size=(300, 6)) * 1e-3 + 1)
        x[50:90] = x[0]
        ids = rng.permutation(250).tolist() + list(range(50))
        ids = np.array(ids)
        got = ann.Meeting(5)(ids[:70], x[:70], ids, x)
        for n, (q, own) in enumerate(zip(x[:70], ids[:70])):
            with np.errstate(over="ignore"):
                near = {}
                for i, y in zip(ids, x):
                    if i != own:
                        d = float(np.sqrt(((y - q) ** 2).sum()))
                        near[int(i)] = min(d, near.get(int(i), d))
            want = sorted((d, v) for v, d in near.items())[:5]
            assert [(got[2][5 * n + j], got[1][5 * n + j]) for j in range(5)] == want
