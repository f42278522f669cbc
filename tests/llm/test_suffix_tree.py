import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tidemark import session
from tidemark.llm import ngrams as N
from tidemark.llm import suffix_tree as M

END = object()


def split(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return [*re.findall(r"[^\x20\x09-\x0D]+", low), END]


class Tree:
    """The same model over tuples of words."""

    def __init__(self, texts, depth, context_min, symbol_min, gain):
        count, self.depth = Counter(), depth
        for words in map(split, texts):
            for i in range(len(words)):
                for k in range(min(depth, i) + 1):
                    count[tuple(words[i - k : i + 1])] += 1
        self.count = count
        words = {w: n for w, n in count.items() if len(w) == 1}
        self.tokens, self.distinct = sum(words.values()), len(words)
        stored = {}
        for run, n in count.items():
            if len(run) > 1 and n >= symbol_min and count[run[:-1]] >= context_min:
                stored.setdefault(run[:-1], {})[run[-1]] = n
        self.kept = {}
        for s, after in stored.items():
            n, shorter = count[s], self.tokens if len(s) == 1 else count[s[1:]]
            lower = {w: count[(*s[1:], w)] for w in after}
            gained = sum(m * math.log((m / n) / (lower[w] / shorter)) for w, m in after.items())
            rest = n - sum(after.values())
            if rest:
                gained += rest * math.log((rest / n) / (max(shorter - sum(lower.values()), 0.5) / shorter))
            if gained >= gain * len(after):
                for k in range(len(s)):
                    self.kept[s[k:]] = None
        self.kept = {s: stored[s] for s in self.kept}

    def chance(self, history, word):
        p = (self.count[(word,)] + 0.1) / (self.tokens + 0.1 * (self.distinct + 1))
        for k in range(1, self.depth + 1):
            s = tuple(history[-k:])
            if len(s) < k or s not in self.kept:
                break
            after = self.kept[s]
            rest = self.count[s] - sum(after.values())
            p = (after.get(word, 0) + (M.MASS + rest) * p) / (self.count[s] + M.MASS)
        return p

    def score(self, text):
        words = split(text)
        known = [self.count[(w,)] for w in words]
        base = sum(math.log10((c + 0.1) / (self.tokens + 0.1 * (self.distinct + 1))) for c in known)
        return len(words), sum(c > 0 for c in known), base, sum(math.log10(self.chance(words[:i], w)) for i, w in enumerate(words))


def corpus(seed, n):
    rnd = random.Random(seed)
    after = {w: rnd.choices("abcdefgh", k=3) for w in "abcdefgh"}
    out = []
    for _ in range(n):
        words = [rnd.choice("abcdefgh")]
        while rnd.random() < 0.95:
            usual = rnd.choice(after.get(words[-1], "abcdefgh"))
            words.append(usual if rnd.random() < 0.8 else rnd.choice(["A", "é", "zz", f"r{rnd.randrange(200)}"]))
        out.append(" ".join(words))
    return out


@pytest.mark.parametrize("depth, context_min, symbol_min, gain", [(3, 12, 3, 1.0), (2, 5, 5, 0.0), (1, 40, 2, 3.0)])
def test_against_brute_force(make, monkeypatch, depth, context_min, symbol_min, gain):
    monkeypatch.setattr(M, "PAGE_BYTES", 4000)
    monkeypatch.setattr(N, "BUCKET_BYTES", 3000)
    monkeypatch.setattr(N, "HELD", 300)
    monkeypatch.setattr(M, "HELD", 300)
    monkeypatch.setattr(M, "MOST_CODES", 6)
    texts = [*corpus(1, 250), None, "", " \n", "x " * 3000, *["the same passage of text that many copies share"] * 40]
    docs = make([*enumerate(texts), (None, texts[0]), (7, texts[7])])
    tree = Tree([*texts, texts[0], texts[7]], depth, context_min, symbol_min, gain)
    model = M.learn(docs, depth=depth, context_min=context_min, symbol_min=symbol_min, gain=gain)
    assert (model.train_tokens, model.distinct) == (tree.tokens, tree.distinct)
    assert model.rows.where("rest >= 0").count() == len(tree.kept) > 3
    queries = [*texts, texts[0], texts[7], "unseen words only", "a b unseen c d e"]
    asked = make([*enumerate(queries)])
    found = M.score(asked, model).collect()
    assert len(found) == len(queries)
    for row in found:
        want = tree.score(queries[row["doc_id"]])
        assert (row["n_tokens"], row["n_known"], row["train_tokens"]) == (*want[:2], tree.tokens)
        assert row["base_score"] == pytest.approx(want[2], abs=1e-8) and row["score"] == pytest.approx(want[3], abs=1e-8)
        assert row["text"] == queries[row["doc_id"]] and row["n"] == "own"


def test_contexts_give_distributions():
    tree = Tree(corpus(3, 200), 3, 10, 3, 1.0)
    words = [w for (w,) in (k for k in tree.count if len(k) == 1)]
    for s in [(), *list(tree.kept)[:20]]:
        assert sum(tree.chance(list(s), w) for w in words) + tree.chance(list(s), "never seen") == pytest.approx(1)


def test_codes(spark):
    import numpy as np

    rows = [(k * 7919 - 40_000, 1 + 1000 // (k + 1)) for k in range(100)]
    words = spark.createDataFrame(rows, "key long, n long")
    sent = np.array([k for k, _ in rows] * 3 + [5, -5], np.int64).view(np.uint64)
    for codes in (M.Codes.of(words), M.Codes.of(words.limit(0))):
        assert (codes.unpack(*codes.pack(sent)) == sent).all() and len(codes.unpack(*codes.pack(sent[:0]))) == 0
    assert len(M.Codes.of(words).by_rank) == 100


def test_frequent_pairs_are_asked_for_by_codes():
    import numpy as np
    import pyarrow as pa

    texts = ["a b c a b", "b a zz a b"]
    word, _, place = M.tokens([t.encode() for t in texts])
    codes = M.Codes(N.distinct(word[[0, 1, 2]]))
    every = N.Filter(20)
    every.words[:] = np.uint64(2**64 - 1)
    body = M._packed(0, [pa.RecordBatch.from_arrays([pa.array(texts)], names=["__text"])]).column("body")[0].as_py()
    keys, pairs = M._wanted(body, 2, every, codes)
    assert pairs.dtype == np.uint32 and len(pairs) == 4  # ab, bc, ca, ba
    runs = M.runs(word, place, 2)
    assert len(word) == 12 and set(codes.runs(pairs).tolist()) == {int(runs[1][k]) for k in (1, 2, 3, 7)}
    asked, order = M._asked(keys, pairs, codes, 5)
    wanted = {int(r[k]) for depth, r in enumerate(runs) for k in range(12) if place[k] >= depth}
    assert set(asked.tolist()) == wanted and len(asked) == len(wanted) and sorted(order.tolist()) == list(range(len(asked)))


def test_a_reply_spends_a_bit_on_what_is_no_context():
    import numpy as np

    rnd = np.random.default_rng(3)
    rest = np.where(rnd.random(20_000) < 0.1, rnd.integers(0, 200, 20_000), -1)
    for some in (rest, rest[:0], rest[:7], np.full(9, -1), np.array([0, -1, 2**40])):
        assert (M._unpack_rest(M._pack_rest(some), len(some)) == some).all()
    assert len(M._pack_rest(rest)) < 0.7 * len(N.pack(rest))


def test_rows_of_frequent_words_are_sent_once_and_not_asked_for(make, monkeypatch):
    import numpy as np
    import pyarrow as pa

    monkeypatch.setattr(M, "MOST_KNOWN", 20)
    texts = corpus(7, 300)
    tree = Tree(texts, 3, 12, 3, 1.0)
    model = M.learn(make([*enumerate(texts)], clash=False), context_min=12, symbol_min=3, gain=1.0)
    known, words = model.known.value, [w for (w,) in (k for k in tree.count if len(k) == 1)]
    hashes = {int(M.tokens([w.encode()])[0][0]): (w,) for w in words if w is not END} | {int(M.END): (END,)}
    assert 8 < len(known.key) <= 20 and (np.diff(known.key) > 0).all()
    for key, n, rest in zip(known.key.tolist(), known.n.tolist(), known.rest.tolist()):
        word = hashes[key]
        assert n == tree.count[word] and rest == (n - sum(tree.kept[word].values()) if word in tree.kept else -1)
    assert min(known.n) > max(tree.count[w] for h, w in hashes.items() if h not in set(known.key.tolist()))
    body = M._packed(0, [pa.RecordBatch.from_arrays([pa.array(texts)], names=["__text"])]).column("body")[0].as_py()
    (every, pairs), (keys, same) = (M._wanted(body, 3, model.held, model.codes.value, x) for x in (None, known))
    assert set(every.tolist()) - set(keys.tolist()) == set(known.key.tolist()) and (pairs == same).all()
    for row in M.score(make([*enumerate(texts)], clash=False), model).collect():
        want = tree.score(texts[row["doc_id"]])
        assert (row["n_tokens"], row["n_known"]) == want[:2] and (row["base_score"], row["score"]) == pytest.approx(want[2:], abs=1e-8)


def test_counts_of_runs_go_when_the_model_is_written(make, tmp_path, monkeypatch):
    monkeypatch.setattr(session, "scratch_root", lambda spark: str(tmp_path))
    model = M.learn(make([*enumerate(corpus(9, 100))], clash=False), context_min=12, symbol_min=3)
    assert {p.name.split("-")[0] for p in tmp_path.iterdir()} == {"words", "retained", "stored"}
    assert model.rows.where("rest >= 0").count() > 3


def test_keys_are_looked_up_in_order(monkeypatch):
    import numpy as np

    table = np.array([3, 5, 9, 2**63], np.uint64)
    keys = np.array([9, 2**64 - 1, 3, 4, 2**63, 0, 5, 9], np.uint64)
    at = M._nearest(table, keys)
    assert (table[at] == keys).tolist() == [True, False, True, False, True, False, True, True] and len(M._nearest(table, keys[:0])) == 0
    page, looked_up = M.Page(N.distinct(M.tokens([b"a b"])[0]), np.array([5, 4, 3]), np.full(3, -1), 12, 3, 3), []
    find = page.find
    monkeypatch.setattr(page, "find", lambda keys: looked_up.append(len(keys)) or find(keys))
    page.score([b"a b", b"b a"])
    assert looked_up == [6, 0, 0, 0]  # no word is a context, so no longer run is held


def test_empty_tables_and_unknown_words(make):
    none = make([(1, "a")]).limit(0)
    model = M.learn(none)
    assert M.score(none, model).count() == 0
    row = M.score(make([(1, "a b")]), model).first()
    assert (row["n_tokens"], row["n_known"], row["train_tokens"], row["base_score"], row["score"]) == (3, 0, 0, 0.0, 0.0)


def test_held_out_texts_gain(make):
    texts = corpus(5, 600)
    model = M.learn(make([*enumerate(texts[:500])], clash=False), context_min=20, symbol_min=4)
    sums = M.score(make([*enumerate(texts[500:])], clash=False), model, keep=[]).agg(F.sum("base_score"), F.sum("score")).first()
    assert sums[1] > sums[0] + 200


def test_pages_are_written_in_parts(make, monkeypatch):
    monkeypatch.setattr(M, "PAGE_BYTES", 4000)
    monkeypatch.setattr(M, "SLICE_BYTES", 500)
    texts = [*corpus(11, 300), None, "", "x " * 1000]
    tree = Tree(texts, 3, 12, 3, 1.0)
    docs = make([*enumerate(texts)], clash=False)
    parts: dict[int, list[int]] = {}
    for row in M._pages(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("__text")), 3).collect():
        parts.setdefault(row["page"], []).append(sum(len(t) for _, part in M._unpacked(row["body"]) for t in part))
    assert sum(map(sum, parts.values())) == sum(len((t or "").encode()) for t in texts)
    assert max(map(len, parts.values())) > 3 and sorted(n for own in parts.values() for n in own)[-2] <= 500
    scored = M.score(docs, M.learn(docs, context_min=12, symbol_min=3, gain=1.0)).collect()
    assert len(scored) == len(texts)
    for row in scored:
        want = tree.score(texts[row["doc_id"]])
        assert (row["n_tokens"], row["n_known"]) == want[:2] and (row["base_score"], row["score"]) == pytest.approx(want[2:], abs=1e-8)


def test_texts_are_copied_a_slice_at_a_time(monkeypatch):
    import pyarrow as pa

    from tidemark.llm import common

    copied, copy = [], common.texts_of
    monkeypatch.setattr(common, "texts_of", lambda column: copied.append(len(column)) or copy(column))
    texts = ["ab", None, "é", "x" * 9, "", "c", None, "dd"]
    for column in (pa.array(["zz", *texts]).slice(1), pa.array(texts, pa.large_string()), pa.array([t and t.encode() for t in texts])):
        copied.clear()
        cut = list(common.slices(column, 4))
        assert cut == [(0, [b"ab", b"", "é".encode()]), (3, [b"x" * 9]), (4, [b"", b"c", b"", b"dd"])] and copied == [3, 1, 4]
    assert list(common.slices(pa.array([], pa.string()))) == []


def test_tasks_get_small_batches(spark, make, monkeypatch):
    import pyarrow as pa

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows])], names=["n"])

    before = spark.conf.get(session.BATCH_CONF)
    texts = spark.range(0, 200, 1, 1).select(F.expr("repeat('x', 1000)").alias("text"))
    with session.small_batches(spark, 20_000):
        assert max(r["n"] for r in texts.mapInArrow(sizes, "n long").collect()) <= 25
    assert spark.conf.get(session.BATCH_CONF) == before
    seen, settle = [], M.settle
    monkeypatch.setattr(M, "settle", lambda *a, **b: seen.append(spark.conf.get(session.BATCH_CONF)) or settle(*a, **b))
    M.learn(make([*enumerate(corpus(13, 50))], clash=False), context_min=12, symbol_min=3)
    assert len(seen) > 5 and set(seen) == {str(4 << 20)} and spark.conf.get(session.BATCH_CONF) == before
