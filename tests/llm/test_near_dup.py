import random

import numpy as np
from tidemark.llm import near_dup as N


def word_set(text, width=5):
    words = "".join(c.lower() if c.isascii() else c for c in text or "").split(" ")
    words = [w for w in words if w]
    if not words:
        return frozenset()
    k = min(width, len(words))
    return frozenset(tuple(words[i : i + k]) for i in range(len(words) - k + 1))


def brute(rows, pct):
    sets = [word_set(r[1]) for r in rows]
    root = list(range(len(rows)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for i in range(len(rows)):
        for j in range(i):
            common = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * common >= pct * (len(sets[i]) + len(sets[j]) - common):
                root[find(i)] = find(j)
    out = []
    for k, r in enumerate(rows):
        ids = [rows[m][0] for m in range(len(rows)) if find(m) == find(k) and rows[m][0] is not None]
        out.append((r[0], len(sets[k]), r[0] if not sets[k] else min(ids, default=None)))
    return sorted(out, key=str)


def texts(seed):
    rnd = random.Random(seed)
    word = lambda: rnd.choice("abcdefghij") + rnd.choice("klmnopqrst") + rnd.choice("uvwxyz")
    rows = []
    for _ in range(30):
        base = [word() for _ in range(rnd.choice([1, 3, 5, 8, 40, 120]))]
        for _ in range(rnd.choice([1, 1, 2, 6])):
            rows.append((len(rows), " ".join(base)))
            base = list(base)
            for _ in range(rnd.choice([0, 1, 1, 2])):
                base[rnd.randrange(len(base))] = word()
    return rows + [(1000, None), (1001, ""), (1002, "  "), (1003, "Same WORDS"), (1004, "same words"), (5, rows[5][1]), (None, rows[7][1])]


def test_against_brute_force(make):
    for pct in (80, 85):
        rows = texts(pct)
        found = N.near_duplicates(make(rows), pct=pct).collect()
        assert sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in found), key=str) == brute(rows, pct)
        assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in found)


def test_one_large_group_and_no_documents(make):
    words = [f"w{k}" for k in range(200)]
    rows = [(k, " ".join([*words[:k], f"x{k}", *words[k + 1 :]])) for k in range(150)] + [(k, " ".join(words)) for k in range(150, 400)]
    found = N.near_duplicates(make(rows)).collect()
    assert {r["component_id"] for r in found} == {0} and sum(r["kept"] for r in found) == 1
    assert N.near_duplicates(make(rows).limit(0)).count() == 0


def test_estimates():
    rng = np.random.default_rng(1)
    for share in (0.2, 0.5, 0.9):
        pool = rng.integers(0, 2**63, (40, 3000), dtype=np.uint64)
        n = int(3000 * share)
        rest = (3000 - n) // 2
        one, two = pool[:, : n + rest], np.concatenate([pool[:, :n], pool[:, n + rest :]], axis=1)
        a, b = N.sketch(list(one), 256), N.sketch(list(two), 256)
        sizes = np.full(40, one.shape[1]), np.full(40, two.shape[1])
        assert abs(N.estimate(a, b, *sizes).mean() - n / 3000) < 0.03
        merged = np.maximum(a, b)
        assert (merged == N.sketch([np.union1d(x, y) for x, y in zip(one, two)], 256)).all()


def test_components(spark):
    from tidemark.llm.components import components

    path = [(k, k + 1) for k in range(40)] + [(100, 100 + k) for k in range(1, 30)] + [(7, 7)]
    found = {r["node"]: r["root"] for r in components(spark.createDataFrame(path, "a long, b long")).collect()}
    assert found == {k: 0 for k in range(1, 41)} | {100 + k: 100 for k in range(1, 30)}


def test_likelihood_drops_no_more_than_the_bands_miss():
    from math import lgamma

    for limit in (0.8, 0.85):
        size = N.bands_for(limit) * N.ROWS
        for larger in (1.0, (1 / limit) ** 0.5, 1 / limit):  # sets of sizes 1 and this, similarity at the limit
            u = 1 / (1 + larger)
            chance = lambda x: -np.log1p(-x * (N.BASE - 1) / N.BASE) / np.log(N.BASE)
            p, q = max(chance(u - (1 - u) * limit), 0.0), max(chance(1 - u - u * limit), 0.0)
            above, below = (x.ravel() for x in np.meshgrid(np.arange(size + 1), np.arange(size + 1)))
            fits = above + below <= size
            above, below = above[fits], below[fits]
            ways = np.vectorize(lgamma)
            log = lambda n, x: np.where(n == 0, 0.0, n * np.log(max(x, 1e-300)))
            level = size - above - below
            mass = np.exp(lgamma(size + 1) - ways(above + 1) - ways(below + 1) - ways(level + 1) + log(above, p) + log(below, q) + log(level, 1 - p - q))
            some = mass > 1e-16
            above, below, mass = above[some], below[some], mass[some]
            at = np.arange(size)
            a = np.where(at < above[:, None], 2, np.where(at < (above + below)[:, None], 0, 1))
            found = N.estimate(a, np.ones_like(a), np.full(len(a), 1.0), np.full(len(a), larger))
            assert abs(mass.sum() - 1) < 1e-9 and mass[found < N.worth(limit, size)].sum() <= N.MISS
