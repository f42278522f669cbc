import random
import re
from collections import Counter

import numpy as np

from tidemark.llm import collocations as C
from tidemark.llm.ngrams import Filter, words_of

COLUMNS = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


def brute(rows, threshold, longest=5, top=2000):
    count, total = {}, Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", low):
            words = re.findall("[^ \t]+", piece)
            total[lang] += len(words)
            for width in range(1, longest + 1):
                for i in range(len(words) - width + 1):
                    key = lang, tuple(words[i : i + width])
                    count[key] = count.get(key, 0) + 1
    often = {k: n for k, n in count.items() if n >= threshold}
    out = []
    for (lang, words), a in often.items():
        if len(words) == 1:
            continue
        inside = lambda longer: any(longer[i : i + len(words)] == words for i in range(len(longer) - len(words) + 1))
        if any(m == a and other == lang and len(q) > len(words) and inside(q) for (other, q), m in often.items()):
            continue
        cuts = [(1000 * a * total[lang] // (often[lang, words[:k]] * often[lang, words[k:]]), k) for k in range(1, len(words))]
        score, k = min(cuts)
        out.append((lang, " ".join(words), a, often[lang, words[:k]], often[lang, words[k:]], total[lang], score))
    ranked = []
    for lang in {x[0] for x in out}:
        own = sorted((x for x in out if x[0] == lang), key=lambda x: (-x[6], -x[2], x[1].encode()))[:top]
        ranked += [(x[0], k, *x[1:]) for k, x in enumerate(own, 1)]
    return sorted(ranked)


def table(spark, rows):
    full = [(k, text, lang) for k, (text, lang) in enumerate(rows)]
    df = spark.createDataFrame(full, "doc_id long, text string, lang string").repartition(4)
    return df.selectExpr("*", "1 AS n", "'x' AS phrase", "2 AS width", "3 AS shard", "4 AS rank", "5 AS score")


def found(df):
    return sorted(tuple(r[c] for c in COLUMNS) for r in df.collect())


def texts(seed, n):
    rnd = random.Random(seed)
    vocabulary = ["the", "The", "of", "a", "Ärger", "x", "été", "in", "und", "naïve"]
    fixed = ["as a matter of fact", "the end of the world is near", "x x x x", "very  rare\tevent"]
    for _ in range(n):
        words = []
        for _ in range(rnd.randint(0, 30)):
            words.append(rnd.choice(fixed) if rnd.random() < 0.2 else rnd.choice(vocabulary))
            if rnd.random() < 0.15:
                words.append(rnd.choice([".", ",", "\n", "!", "\r", "\x0b", " ; ", " "]))
        yield " ".join(words), rnd.choice(["en", "de", None, "und"])


def test_against_brute_force(spark):
    rows = [*texts(2, 300), (None, "en"), ("", "fr"), ("...", "fr"), ("x " * 5000, "en"), *[("one group of copies here", "en")] * 120]
    for threshold, shards in ((20, 3), (100, 1), (60, 2)):
        assert found(C.collocations(table(spark, rows), threshold=threshold, shards=shards)) == brute(rows, threshold)
    assert found(C.collocations(table(spark, rows), threshold=15, longest=3, top=7)) == brute(rows, 15, 3, 7)
    assert C.collocations(table(spark, rows).limit(0)).count() == 0


def test_late_phrases_are_counted_in_full(spark):
    """Phrases that become frequent in the last shard only, one length after the other."""
    rows = [("a b c d e", "en")] * 30 + [(f"w{k}", "en") for k in range(50)]
    phrases = C.frequent_phrases(table(spark, rows), "text", "lang", 30, 5, shards=4)
    assert {(r["phrase"], r["n"]) for r in phrases.where("width > 1").collect()} == {(p, 30) for p in ("a b", "b c", "c d", "d e", "a b c", "b c d", "c d e", "a b c d", "b c d e", "a b c d e")}


def test_a_task_sends_a_row_per_bucket_and_language(spark, monkeypatch):
    """However many slices of texts and phrases it has; where a task may gather little, sums stay the same."""
    texts = table(spark, [("a b c", "en"), ("a b", "de"), ("b c.", "en")] * 60).coalesce(1)
    want = {("en", 0, ""): 300, ("de", 0, ""): 120, ("en", 1, "a"): 60, ("en", 1, "b"): 120, ("en", 1, "c"): 120, ("de", 1, "a"): 60, ("de", 1, "b"): 60}
    want |= {("en", 2, "a b"): 60, ("en", 2, "b c"): 120, ("en", 3, "a b c"): 60, ("de", 2, "a b"): 60}
    every = Filter(20)
    every.words[:] = np.uint64(2**64 - 1)
    monkeypatch.setattr(C, "SLICE_BYTES", 40)
    assert C._spelt(texts, 5, every, 1).count() == 2
    monkeypatch.setattr(C, "SPELT", 12)
    for buckets, least in ((1, 1), (5, 100)):
        sums = C._spelt(texts, 5, every, buckets).groupBy("bucket", "lang").applyInArrow(C._together(least), C.COUNTED).collect()
        often = {k: n for k, n in want.items() if n >= least}
        assert len(sums) == len(often) and {(r["lang"], r["width"], r["phrase"]): r["n"] for r in sums} == often


def test_scores_beyond_64_bits(spark):
    huge = spark.createDataFrame([("en", 0, "", 10**15), ("en", 1, "a", 10**15 // 3), ("en", 1, "b", 10**15 // 7), ("en", 2, "a b", 10**14 + 1)], "lang string, width int, phrase string, n long")
    keep = C.frequent_phrases
    C.frequent_phrases = lambda *args: huge
    try:
        row = C.collocations(table(spark, [("a", "en")])).collect()[0]
    finally:
        C.frequent_phrases = keep
    assert row["score"] == 1000 * (10**14 + 1) * 10**15 // ((10**15 // 3) * (10**15 // 7))


def test_filter_never_forgets(spark):
    keys = np.random.default_rng(5).integers(-(2**63), 2**63 - 1, 5000)
    full = Filter(20).with_keys(spark.createDataFrame([(int(k),) for k in keys[:2500]], "key long")).with_keys(spark.createDataFrame([(int(k),) for k in keys[2500:]], "key long"))
    assert full.holds(keys.view(np.uint64)).all()
    assert full.holds(np.random.default_rng(6).integers(0, 2**63, 5000).astype(np.uint64) * np.uint64(2)).mean() < 0.01


def test_words_of_long_and_odd_texts():
    texts = ["Ab c", "", "x" * 300_000, " \t ", "Ab", "é\u00a0É c"]
    words = words_of([t.encode() for t in texts], b" \t", b"\n")
    assert words.spelt(np.arange(len(words.start)), 1) == [b"ab", b"c", b"x" * 300_000, b"ab", "é\u00a0É".encode(), b"c"]
    assert words.text.tolist() == [0, 0, 2, 4, 5, 5]
    assert words.hashes[0] == words.hashes[3] and len(set(words.hashes.tolist())) == 4
