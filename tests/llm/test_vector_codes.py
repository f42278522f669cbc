import hashlib
import math

import numpy as np
import pytest

from tidemark.llm import vector_codes as V


def brute(rows, positions=8, entries=16, rounds=6):
    """Full search in Python's own integers; rows are (id, vector, label)."""
    kept = [(i, [math.floor(4096 * x) for x in v], label) for i, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    width = len(kept[0][1]) // positions
    cut = [[v[p * width : (p + 1) * width] for p in range(positions)] for _, v, _ in kept]
    first = sorted(range(len(kept)), key=lambda k: (kept[k][0] is None, kept[k][0] or 0, kept[k][1]))[:entries]
    books = [[cut[k][p] for k in first] for p in range(positions)]

    def assign():
        return [[min((sum((a - b) ** 2 for a, b in zip(part, e)), k) for k, e in enumerate(books[p])) for p, part in enumerate(parts)] for parts in cut]

    for _ in range(rounds):
        found = assign()
        for p in range(positions):
            for k in range(len(books[p])):
                own = [parts[p] for parts, near in zip(cut, found) if near[p][1] == k]
                if own:
                    books[p][k] = [sum(c) // len(own) for c in zip(*own)]
    found = assign()
    errors = [sum(d for d, _ in near) for near in found]
    labels = {}
    for (_, _, label), error in zip(kept, errors):
        labels[label] = labels.get(label, 0) + error
    sha = hashlib.sha256(",".join(str(x) for book in books for e in book for x in e).encode()).hexdigest()
    return sorted(((i, "".join(f"{k:02x}" for _, k in near), e, labels[label], sha) for (i, _, label), near, e in zip(kept, found, errors)), key=str)


def found(df):
    return sorted(map(tuple, df.select("vec_id", "code", "error", "label_error", "codebooks_sha256").collect()), key=str)


def table(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(3).selectExpr("*", "'x' AS vec", "'y' AS code", "0 AS error", "1 AS body")


def float32(values):
    return [float(np.float32(x)) for x in values]


def test_against_full_search(spark):
    rng = np.random.default_rng(3)
    rows = [(k, float32(rng.normal(0, 0.4, 32) + k % 5), int(k % 4) if k % 7 else None) for k in range(300)]
    rows += [(300 + k, rows[k % 3][1], 1) for k in range(60)]  # copies
    rows += [(k, [0.25] * 32, 2) for k in range(5, 8)]  # ids again, ties between entries
    rows += [(None, float32(rng.normal(size=32)), 0), (900, None, 1), (901, [None] + [0.0] * 31, 1), (902, [float("nan")] * 32, 1), (903, [float("inf")] + [0.0] * 31, None)]
    assert found(V.vector_codes(table(spark, rows))) == brute(rows)


def test_few_vectors_and_none(spark):
    rows = [(k, float32([k / 3, -k / 7] * 8), None) for k in range(5)]
    assert found(V.vector_codes(table(spark, rows))) == brute(rows)
    assert V.vector_codes(table(spark, [(1, None, 1), (2, [], 1)])).count() == 0
    odd = rows + [(50, [1.0] * 8, 1), (51, [1.0] * 7, 1)]  # other lengths go
    assert found(V.vector_codes(table(spark, odd))) == brute(rows)


def test_too_large_components_are_refused(spark):
    with pytest.raises(Exception, match="pass 64 bits"):
        V.vector_codes(table(spark, [(k, [1e9] * 8, 1) for k in range(3)])).count()


def test_bounds_prune_and_never_change_the_result():
    rng = np.random.default_rng(1)
    centres = rng.integers(-4000, 4000, (16, 8))
    parts = centres[rng.integers(0, 16, 2000)] + rng.integers(-60, 60, (2000, 8))
    pivots = V.farthest(centres, 4)
    code, best, tried = V.nearest(parts, centres, V.distances(parts, pivots).astype("<f4"), V.distances(pivots, centres))
    squared = ((parts[:, None] - centres[None]) ** 2).sum(axis=2)
    assert (code == squared.argmin(axis=1)).all() and (best == squared.min(axis=1)).all()
    assert tried < 0.2 * squared.size
    flat = np.zeros((50, 8), np.int64)
    code, best, _ = V.nearest(flat, np.zeros((16, 8), np.int64), V.distances(flat, flat[:1]).astype("<f4"), np.zeros((1, 16)))
    assert not code.any() and not best.any()
