import random
import re

from tidemark.llm.quality_rules import Rules, clean_documents, judge, quality_rules

CLEAN = "This is a plain line of text that ends well. And here comes one more sentence, with words of all kinds."

OTHER = "Another line that stands for text of a page, no word of which is out of place in it. So it may stay."


def brute(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    seen, again = set(), 0
    for line in (text or "").split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            again += line in seen
            seen.add(line)
    places = {}
    for i in range(len(words) - 7):
        places.setdefault(tuple(words[i : i + 8]), []).append(i)
    covered = {k for at in places.values() if len(at) > 1 for i in at for k in range(i, i + 8)}
    symbols = len(re.findall(r"[#*$%&|<>]", text or ""))
    failed = len(words) < 20 or 100 * len(covered) > 30 * len(words)
    return len(words), sum(map(len, words)), symbols, again, len(covered), failed


def test_counts_against_brute_force(make):
    rnd = random.Random(2)
    texts = [None, "", " \n\t", "é" * 3000, "a\u00a0b c\x0bd\x0ce"]
    texts += ["".join(rnd.choice(["a ", "b ", "c\n", "d# ", "é ", "\n"]) for _ in range(rnd.randint(1, 200))) for _ in range(60)]
    rows = quality_rules(make([(k, t) for k, t in enumerate(texts)] + [(0, None)]), clean_col="clean").collect()
    assert len(rows) == len(texts) + 1
    for r in rows:
        found = (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"])
        assert found == brute(texts[r["doc_id"]]), texts[r["doc_id"]]
        assert not (r["base_failed"] and r["kept"]) and r["fp"] == "own"


def test_line_rules():
    rules = Rules()
    for line in ("Home | News | Sport | Mail | About", "menu top", "buy*** now### cheap$$$ best%%% of&&& all***", "THIS IS ALL VERY LOUD AND GOES ON!! AND ON!!", "no no no no no no no no no no no no", "Read more about this"):
        kept, clean = judge(f"{CLEAN}\n{line}\n{OTHER}".encode(), rules)[6:]
        assert kept and clean == f"{CLEAN}\n{OTHER}", line
    for line in ("A line that ends in no mark but is long enough", "- 1.", "Why?", "They said: “no”"):
        assert line in judge(f"{CLEAN}\n{line}".encode(), rules)[7]


def test_documents_that_lose_too_much_go(make):
    bad = CLEAN + "\n" + "\n".join(f"w{i} | x{i} | y{i} | z{i} | v{i} | u{i}" for i in range(9))
    left = clean_documents(make([(1, CLEAN), (2, bad), (3, CLEAN + "\nmenu"), (4, None)])).collect()
    assert {(r["doc_id"], r["text"]) for r in left} == {(1, CLEAN), (3, CLEAN)}
    assert clean_documents(make([(1, CLEAN)]).limit(0)).count() == 0
