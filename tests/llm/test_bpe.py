import random

import pytest
from tidemark.llm import bpe
from tidemark.llm.queries import VOCABULARY

tokenizers = pytest.importorskip("tokenizers")

ODD = [None, "", " ", "a", "\n\n  x \t y  ", "don't we'll  I'M", "日本語 текст éà", "<|endoftext|>a<|endoftext|>", "a" * 20000, "ab " * 5000, "\x1c\x1d\u2028\u3000x", "½²٣ 3.14 --- ***", "😀 family 👩‍👩‍👧", "x" * 50 + " " * 50]


@pytest.fixture(scope="module")
def library():
    return tokenizers.Tokenizer.from_file(VOCABULARY)


@pytest.fixture(scope="module")
def own():
    with open(VOCABULARY, "rb") as file:
        return bpe.Codec(file.read())


def test_every_token_of_the_vocabulary(library, own):
    for raw in own.bytes_of:
        try:
            text = raw.decode()
        except UnicodeDecodeError:
            continue
        assert own.encode(text).tolist() == library.encode(text, add_special_tokens=False).ids


def test_random_texts(library, own):
    rnd = random.Random(1)
    letters = "aaabbcdeert nthis'll\n\t 123.,!é日\x1c" + "the and ing "
    for _ in range(3000):
        text = "".join(rnd.choice(letters) for _ in range(rnd.randint(0, 80)))
        assert own.encode(text).tolist() == library.encode(text, add_special_tokens=False).ids, text


def test_documents(spark, make, library):
    docs = make(list(enumerate(ODD)) + [(3, "a"), (None, "b")])
    rows = bpe.encode(docs, VOCABULARY, ids_col="ids", decoded_col="decoded").collect()
    assert len(rows) == len(ODD) + 2
    for r in rows:
        text = r["text"] or ""
        found = library.encode(text, add_special_tokens=False).ids
        assert r["ids"] == found and r["decoded"] == library.decode(found, skip_special_tokens=False)
        assert r["fp"] == "own"
    back = bpe.decode(bpe.encode(docs, VOCABULARY, keep=["doc_id"]), VOCABULARY, text_col="again").collect()
    assert {(r["doc_id"], r["again"]) for r in back} == {(r["doc_id"], r["text"] or "") for r in rows}
    assert bpe.encode(docs.limit(0), VOCABULARY).count() == 0


def test_broken_bytes_decode_as_replacements(own, library):
    ids = own.encode("日")[:1]
    assert own.decode(ids).decode() == library.decode(ids.tolist())


def test_long_texts_without_spaces(own, library):
    rnd = random.Random(2)
    for text in ("".join(rnd.choice("日本語文字列天地人") for _ in range(30_000)), "ab" * 40_000, "".join(rnd.choice("abcdefgh") for _ in range(50_000))):
        before = own.units.size
        assert own.encode(text).tolist() == library.encode(text, add_special_tokens=False).ids
        assert own.units.size - before < 100_000  # long units are not remembered


def test_tables_are_bounded(own, library, monkeypatch):
    monkeypatch.setattr(bpe, "TABLE_BYTES", 50_000)
    monkeypatch.setattr(bpe, "TOGETHER", 100)
    rnd = random.Random(3)
    texts = [" ".join("".join(rnd.choice("abcdeéß日'1.") for _ in range(rnd.randint(1, 12))) for _ in range(200)) for _ in range(30)]
    for k in range(0, 30, 5):
        own.prepare(texts[k : k + 5])
        for text in texts[k : k + 5]:
            assert own.encode(text).tolist() == library.encode(text, add_special_tokens=False).ids
            assert own.units.size <= 50_000


def test_side_by_side_equals_one_by_one(own):
    rnd = random.Random(4)
    pieces = ["".join(rnd.choice("aabcdehinorst Ġé日🙂0") for _ in range(rnd.randint(1, 30))) for _ in range(2000)] + ["a" * 200]
    assert own.side_by_side.encode([p.encode() for p in pieces]) == [own.encode_piece(p) for p in pieces]


def test_other_vocabularies_are_refused():
    with pytest.raises(ValueError, match="byte-level"):
        bpe.Codec(b'{"model": {"vocab": {}, "merges": []}, "pre_tokenizer": {"type": "Whitespace"}}')
