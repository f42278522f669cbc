import zlib
from collections import defaultdict

from tidemark.llm import sharding as S


def test_shards(make):
    rows = [(k, "x" * (k % 97) + "é") for k in range(2000)] + [(None, None), (None, ""), (7, "again"), (7, "again"), (3000, "y" * 100_000)]
    found = S.shard_documents(make(rows), shards=24).collect()
    assert len(found) == len(rows)
    size, places = defaultdict(int), defaultdict(list)
    texts = dict(rows[8:2000])
    for r in found:
        size[r["shard"]] += r["size"]
        places[r["shard"]].append(r["slot"])
        if r["doc_id"] in texts:
            raw = texts[r["doc_id"]].encode()
            assert (r["size"], r["text_crc32"]) == (len(raw) + 8, zlib.crc32(raw))
    assert all(sorted(p) == list(range(len(p))) for p in places.values()) and len(places) == 24
    rest = sorted(size.values())[:-1]  # the last holds the one very long text
    assert max(rest) - min(rest) < 120
    assert S.shard_documents(make(rows).limit(0)).count() == 0


def test_maps_are_edited_not_rebuilt(spark, tmp_path):
    totals = {k: (100 + k % 7, 1) for k in range(S.SLOTS)}
    first = S.new_map(totals, 10)
    assert S.rebalanced(first, totals, 10) == first
    totals |= {k: (1000, 9) for k in [k for k in first if first[k] == 3][:80]}
    edited = S.rebalanced(first, totals, 10)
    moved = [k for k in first if edited[k] != first[k]]
    held = [sum(totals[k][0] for k in edited if edited[k] == s) for s in range(10)]
    assert 0 < len(moved) < S.SLOTS // 4 and max(held) - min(held) <= 0.02 * sum(held) / 10
    grown = S.rebalanced(edited, totals, 11)
    assert {grown[k] for k in grown if grown[k] != edited[k]} == {10}
    path = str(tmp_path / "map")
    for version, m in enumerate((first, edited, grown)):
        S.store_map(spark, m, totals, version, path)
    assert S.latest_map(spark, path) == (2, grown)


def test_written_shards_hold_their_documents(spark, make, tmp_path):
    docs = make([(k, f"t{k}") for k in range(200)], clash=False)
    records = S.record_sizes(docs)
    totals = S.slot_totals(records)
    slot_map = S.store_map(spark, S.new_map(totals, 4), totals, 1)
    S.write_shards(docs, slot_map, str(tmp_path / "shards"))
    back = {(r["doc_id"], r["shard"]) for r in spark.read.parquet(str(tmp_path / "shards")).collect()}
    assert back == {(r["doc_id"], r["shard"]) for r in S.assign(records, slot_map).collect()}
