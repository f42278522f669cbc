import numpy as np
from pyspark.sql import functions as F
from tidemark.llm import embedding_dedup as E

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, cosine=0.93):
    good = []
    for k, (_, v, label) in enumerate(rows):
        if label is not None and v and None not in v and np.isfinite(v).all() and np.any(v):
            good.append((k, np.array(v, np.float32).astype(float), label))
    root, links = list(range(len(rows))), [0] * len(rows)

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for i, (a, x, p) in enumerate(good):
        for b, y, q in good[:i]:
            if p == q and len(x) == len(y) and x @ y / np.sqrt((x @ x) * (y @ y)) >= cosine:
                links[a] += 1
                links[b] += 1
                root[find(a)] = find(b)
    return sorted(((r[0], links[k], min((rows[m][0] for m in range(len(rows)) if find(m) == find(k) and rows[m][0] is not None), default=None)) for k, r in enumerate(rows)), key=str)


def found(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("own") for c in ("node", "vec", "body", "codes", "weight", "group", "dim")})
    return sorted(((r["vec_id"], r["n_links"], r["component_id"]) for r in E.near_vectors(df).collect()), key=str)


def vectors(seed, n, noise=0.2, dim=64):
    rng = np.random.default_rng(seed)
    rows = []
    while len(rows) < n:
        base = rng.normal(size=dim)
        for _ in range(rng.choice([1, 1, 3, 12])):
            v = base + noise * rng.normal(size=dim) * rng.random()
            rows += [(len(rows) + k, v.astype(np.float32).tolist(), int(len(rows) % 2)) for k in range(rng.choice([1, 1, 2]))]
    return rows


def test_against_brute_force(spark):
    rows = vectors(1, 300)
    odd = [(1000, None, 1), (1001, [], 1), (1002, [0.0] * 64, 1), (1003, [1.0, None], 1), (1004, [float("nan")] * 64, 0), (1005, [float("inf")] + [0.0] * 63, 0), (1006, rows[0][1], None), (1007, [1.0, 2.0], 1), (1008, [2.0, 4.0], 1), (None, rows[3][1], rows[3][2]), rows[9]]
    assert found(spark, rows + odd) == brute(rows + odd)
    assert found(spark, []) == []
    assert found(spark, odd[:2]) == [(1000, 0, 1000), (1001, 0, 1001)]


def test_large_groups_in_small_blocks(spark, monkeypatch):
    monkeypatch.setattr(E, "BLOCK", 16)
    rng = np.random.default_rng(2)
    base = rng.normal(size=32)
    rows = [(k, (base + 0.3 * rng.normal(size=32)).astype(np.float32).tolist(), 0) for k in range(150)] + [(k, base.astype(np.float32).tolist(), 0) for k in range(150, 250)]
    assert found(spark, rows) == brute(rows)


def test_recall_at_the_threshold():
    rng = np.random.default_rng(3)
    for dim in (16, 64, 100):
        x = rng.normal(size=(500, dim))
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        z = rng.normal(size=(500, dim))
        z -= (z * x).sum(axis=1, keepdims=True) * x
        y = 0.93 * x + np.sqrt(1 - 0.93**2) * z / np.linalg.norm(z, axis=1, keepdims=True)
        k = E.polytopes_for(50_000, dim)
        t = E.tables_for(dim, k, 0.93)
        met = (E.buckets(x, t, k)[:, :, None] == E.buckets(y, t, k)[:, None, :]).any(axis=(1, 2))
        assert met.mean() > 0.999
