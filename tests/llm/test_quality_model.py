import random

from tidemark.llm import quality_model as Q


def corpus(seed=1, n=400):
    rnd = random.Random(seed)
    rows, labels = [], []
    for k in range(n):
        words = ["".join(rnd.choice("aeioubcdst") for _ in range(rnd.randint(1, 8))) for _ in range(rnd.randint(5, 80))]
        good = k % 4 != 0
        if not good:
            words = [w + rnd.choice(["***", "%%%"]) for w in words] if k % 8 else [w for w in words[:10] for _ in range(9)]
        rows.append((k, " ".join(words)))
        labels.append((k, int(good)))
    return rows, labels


def test_held_out_accuracy(spark, make):
    rows, labels = corpus()
    marked = spark.createDataFrame([x for x in labels if x[0] % 5], "doc_id long, quality int")
    model = Q.train(make(rows), marked)
    scored = {r["doc_id"]: r["score"] for r in Q.score(make(rows), model).collect()}
    truth = dict(labels)
    held = [k for k in truth if k % 5 == 0]
    assert sum((scored[k] >= 0.3) == bool(truth[k]) for k in held) >= 0.95 * len(held)
    assert all(0 <= s <= 1 for s in scored.values())
    again = Q.train(make(rows).repartition(5), marked)
    assert (again.weights == model.weights).all()


def test_odd_rows(spark, make):
    rows, labels = corpus(2, 80)
    odd = [(900, None), (901, ""), (902, "\n "), (None, "x"), (3, rows[3][1]), (903, "long " * 30000)]
    marked = spark.createDataFrame(labels + [(None, 1), (5, None), (7, 0), (904, 1), (900, 1)], "doc_id long, quality int")
    docs = make(rows + odd)
    model = Q.train(docs, marked, max_rows=60)
    scored = Q.score(docs, model).collect()
    assert len(scored) == len(rows) + len(odd) and {r["label"] for r in scored} == {"own"}
    same = {r["score"] for r in scored if not (r["text"] or "").split()}
    assert len(same) == 1
    none = Q.train(docs, marked.limit(0))
    assert {r["score"] for r in Q.score(docs, none).collect()} == {0.5}
    assert Q.score(docs.limit(0), model).count() == 0


def test_scores_are_dot_products():
    rows, _ = corpus(3, 5)
    known = Q.Words()
    model = Q.Model(Q._weights(*[x for x in __import__("numpy").random.default_rng(1).normal(size=(2, (1 << Q.BITS) + 1)) ** 2]))
    texts = [t.encode() for _, t in rows]
    apart = [float(model.score([t], known)[0]) for t in texts]
    assert [round(x, 12) for x in model.score(texts, known)] == [round(x, 12) for x in apart]
