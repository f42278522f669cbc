import random

import corpus_pipeline as P


def planted(spark, tmp_path):
    rnd = random.Random(6)
    line = lambda n: " ".join("".join(rnd.choice("aeioubcdst") for _ in range(rnd.randint(2, 9))) for _ in range(n)).capitalize() + "."
    furniture = line(9)
    rows = []
    for k in range(200):
        lines = [line(20) for _ in range(4)]
        if k % 3 == 0:
            lines.insert(rnd.randint(0, 4), furniture)
        rows.append((k, "\n".join(lines), "en", f"s{k % 20}", 1))
    rows += [(1000 + k, rows[k][1], "en", "s1", 1) for k in range(10)]
    rows += [(2000 + k, rows[k][1].replace(".\n", " changed.\n", 1), "en", "s2", 1) for k in range(10)]
    rows += [(3000 + k, " | ".join(line(1) for _ in range(60)), "en", "s3", 1) for k in range(10)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    return str(tmp_path), furniture


def test_stages(spark, tmp_path):
    folder, furniture = planted(spark, tmp_path)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, seen = docs.columns, {}
    for k, (name, stage) in enumerate(P.STAGES):
        out = f"{folder}/{name}"
        stage(spark, docs, folder).write.parquet(out)
        docs = spark.read.parquet(out)
        seen[name] = docs.collect()
        if k < len(P.STAGES) - 1:
            assert docs.columns == columns
    assert {r["doc_id"] for r in seen["quality_rules"]} == {*range(200), *range(1000, 1010), *range(2000, 2010)}
    assert sum(furniture in r["text"] for r in seen["line_dedup"]) == 1
    assert all(r["n_chars"] == len(r["text"]) for r in seen["line_dedup"])
    assert {r["doc_id"] for r in seen["near_dup"]} == set(range(200))
    assert {r["doc_id"] for r in seen["mixing"]} <= set(range(200)) and len(seen["bpe"]) == len(seen["mixing"])
    assert sorted(r["ids_sha256"] for r in P.run(spark, folder).collect()) == sorted(r["ids_sha256"] for r in seen["bpe"])


def test_names():
    import __spark_entry__ as E

    names = [n for n in E.queries() if n.startswith("op") and n[2].isdigit()]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14)) and "pipeline" in E.queries()


def test_line_stage_takes_furniture_of_several_lines_and_hot_copies(make):
    own = "a body of its own that is longer than the furniture around it, as pages have"
    rows = [(k, f"{own} {k}\nfirst of three\nsecond of three\nthird of three", f"s{k % 12}") for k in range(24)]
    rows += [(100 + k, f"head {own} {k}\nhot line\ntail {k}", f"s{k}") for k in range(12)]
    rows += [(200 + k, f"one page {own}\nhot line\nits end", f"s{k % 12}") for k in range(60)]
    left = {r["doc_id"]: r["text"] for r in P.lines(None, make(rows, clash=False), "").collect()}
    assert [k for k, text in left.items() if "of three" in text] == [0]
    assert [k for k, text in left.items() if "hot line" in text] == [100]


def test_near_copies_stage_leaves_one_row_of_each_group(make):
    page = lambda t, k=0: " ".join(f"{t}{j}" for j in range(60)) + f" end{k}"
    rows = [(None, page("a", k)) for k in range(5)]  # a group without ids
    rows += [(None, page("b"))] * 4 + [(7, page("b", 1)), (7, page("b", 2)), (9, page("b"))]  # null and repeated ids
    rows += [(8, page("c"))] * 3 + [(8, page("d")), (5, page("e")), (5, page("e", 1))]  # repeated rows, one id with several texts
    rows += [(None, None), (None, ""), (None, " "), (20, " "), (20, " ")]  # no words: linked with nothing
    left = P.near_copies(None, make(rows), "")
    assert left.columns == make(rows).columns
    found = [(r["doc_id"], r["text"]) for r in left.collect()]
    by = {t: [x for x in found if (x[1] or "").startswith(f"{t}0 ")] for t in "abcde"}
    assert {t: len(x) for t, x in by.items()} == dict.fromkeys("abcde", 1)
    assert [by[t][0][0] for t in "abcde"] == [None, 7, 8, 8, 5]
    assert sorted((x for x in found if not (x[1] or "").strip()), key=str) == sorted(rows[-5:], key=str)
    assert len(found) == 10


def test_near_copies_stage_chooses_the_same_repeated_row(spark):
    rows = [(1, "some words here", "en", f"s{k}", 15) for k in range(6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert len({tuple(P.near_copies(None, docs.repartition(n), "").collect()[0]) for n in (1, 3)}) == 1
