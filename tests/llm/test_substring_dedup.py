import random

import numpy as np
from tidemark.llm import substring_dedup as D
from tidemark.llm.common import hash_words


def brute(rows, width=13):
    first = {}
    for doc, text in rows:
        words = (text or "").split(" ") if text else []
        for i in range(len(words) - width + 1):
            key = tuple(words[i : i + width])
            first[key] = min(first.get(key, D.LAST), D.LAST if doc is None else doc)
    out = []
    for doc, text in rows:
        words = text.split(" ") if text else []
        gone = set()
        for i in range(len(words) - width + 1):
            if first[tuple(words[i : i + width])] < (D.LAST if doc is None else doc):
                gone.update(range(i, i + width))
        out.append((doc, len(words), len(gone), " ".join(w for k, w in enumerate(words) if k not in gone)))
    return sorted(out, key=str)


def found(df):
    return sorted(((r["doc_id"], r["n_words"], r["n_removed"], r["kept_text"]) for r in df.collect()), key=str)


def texts(seed, n=60):
    rnd = random.Random(seed)
    word = lambda: rnd.choice("abc") if rnd.random() < 0.7 else str(rnd.randrange(40))
    shared = [[word() for _ in range(rnd.choice([12, 13, 14, 20, 60]))] for _ in range(12)]
    rows = []
    for k in range(n):
        words = []
        for _ in range(rnd.randint(0, 6)):
            words += rnd.choice(shared) if rnd.random() < 0.5 else [word() for _ in range(rnd.randint(0, 30))]
        rows.append((k * 3 % n, " ".join(words)))
    return rows + [(500, None), (501, ""), (502, "the " * 50 + "end"), (503, "the " * 30 + "x"), (rows[4][0], rows[4][1]), (None, rows[3][1]), (None, rows[3][1])]


def test_against_brute_force(make, monkeypatch):
    for seed, page in ((1, D.PAGE_BYTES), (2, 2000), (3, 1)):
        monkeypatch.setattr(D, "PAGE_BYTES", page)  # one page, some, one per document
        rows = texts(seed)
        assert found(D.remove_repeats(make(rows))) == brute(rows)
    assert D.remove_repeats(make(rows).limit(0)).count() == 0


def test_every_shared_window_shares_a_name():
    rnd = random.Random(5)
    for _ in range(300):
        window = [rnd.choice("abcdefgh").encode() for _ in range(13)]
        names = []
        for _ in range(2):
            words = [rnd.choice("abcdefgh").encode() for _ in range(rnd.randint(0, 9))] + window + [rnd.choice("abcdefgh").encode() for _ in range(rnd.randint(0, 9))]
            page = D.Page([b" ".join(words)], 13)
            name, first, last = page.names()
            at = page.starts[page.window[page.starts] == D.Page([b" ".join(window)], 13).window[0]][0]
            names.append(set(name[(first <= at) & (at <= last)].tolist()))
        assert names[0] & names[1]


def test_closures_fit_the_width():
    words = hash_words([b"%d" % (k * k % 50) for k in range(500)])
    low, high = D.symbols(words, np.zeros(500, int), 13)
    assert len(low) and (low >= 0).all() and (high <= 500).all() and (high - low <= 13).all()
