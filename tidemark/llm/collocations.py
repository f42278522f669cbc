"""Phrase collocations by dynamic itemset counting.

Texts are dealt to a few shards, which are scanned in a cycle. A step counts all lengths that are
active in one shard: words from the start, and a longer phrase from the step after both its
subphrases (without the last and without the first word) have reached the threshold. A phrase is
counted for exactly one cycle, wherever in the cycle it became active. Scanning ends when a cycle
activates nothing more.

What has reached the threshold is sent to the scans as a filter of bounded size; a phrase is active
where the filter holds both subphrases, and has had its cycle where the filter of one cycle ago held
both. The filter only grows, so each phrase is counted in each shard exactly once. Its false
positives are counted in vain and change no result.

In the cycle phrases are 64-bit hashes, and their counts are packed columns of a bucket of hashes;
those that have had their cycle leave them. A last scan spells the frequent phrases and takes their
counts from the phrases themselves, so that no count rests on a hash: a task sums what it has spelt
and sends a row per bucket and language.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import mix, slices
from tidemark.llm.ngrams import SLICE_BYTES, Filter, Words, added, bucket_of, buckets_for, count_keys, heads, longer, pack, pack_sorted, room, unpack, unpack_sorted, words_of
from tidemark.session import scratch_path, settle

BLANKS, BREAKS = b" \t", b".,;:!?\n\x0b\x0c\r"
SHARDS = 3
#: Rows of a language are ranked within so many groups, then the best of those within fewer.
RANK_GROUPS = (4096, 64, 1)
COUNTED = "lang string, width int, phrase string, n long"
SPELT = 1 << 19  # phrases that a task gathers before it sends them
_SEEDS: dict[str, int] = {}


def _seed(lang: str) -> int:
    if lang not in _SEEDS:
        if len(_SEEDS) >= 10_000:
            _SEEDS.clear()
        _SEEDS[lang] = xxhash.xxh3_64_intdigest(lang.encode(), 12)
    return _SEEDS[lang]


def _word_keys(words: Words, langs: list[str]) -> np.ndarray:
    seeds = np.array([_seed(x) for x in langs], np.uint64)
    return mix(words.hashes + seeds[words.text])


def _tagged(run: np.ndarray, width: int) -> np.ndarray:
    """The key of a run: its hash with the number of its words in the last three bits."""
    return run & np.uint64(2**64 - 8) | np.uint64(width)


def active_runs(words: Words, langs: list[str], longest: int, now: Filter, past: Filter | None, first_cycle: bool) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(width, positions, keys) of the occurrences of phrases whose subphrases ``now`` holds and ``past`` does not."""
    word = _word_keys(words, langs)
    run, at = word, np.arange(len(word))
    if first_cycle:
        yield 1, at, _tagged(word, 1)
    for width in range(2, longest + 1):
        here = now.holds(run)
        frequent = np.zeros(len(word) + 1, bool)
        frequent[at[here]] = True
        fits = here & frequent[at + 1] & (at + width <= len(word))
        known = past.holds(run[here]) if past else None
        if past:
            old = np.zeros(len(word) + 1, bool)
            old[at[here]] = known
        at, run = at[fits], run[fits]
        inside = words.piece[at + width - 1] == words.piece[at]
        at, run = at[inside], run[inside]
        run = longer(run, word[at + width - 1])
        if past:
            new = ~(old[at] & old[at + 1])
            yield width, at[new], _tagged(run[new], width)
        else:
            yield width, at, _tagged(run, width)


def _scan(texts: DataFrame, buckets: int, longest: int, now: Filter, past: Filter | None, first_cycle: bool):
    """Packed counts of what is active in these texts, and the broadcast that they need."""
    shared = texts.sparkSession.sparkContext.broadcast((now, past))

    def build():
        own, old = shared.value

        def take(batch: pa.RecordBatch, first: int, texts: list[bytes]) -> Iterator[np.ndarray]:
            langs = batch.column("lang").slice(first, len(texts)).to_pylist()
            words = words_of(texts, BLANKS, BREAKS)
            for _, _, keys in active_runs(words, langs, longest, own, old, first_cycle):
                yield keys

        return take

    return count_keys(texts.select("text", "lang"), buckets, build), shared


STATE = "bucket int, keys binary, n binary, first binary, passed binary"


def _merge(step: int, shards: int, threshold: int):
    """Adds the counts of a step to those of a bucket: what has had its cycle leaves, what has just reached the threshold is named."""

    def run(table: pa.Table) -> pa.Table:
        old = table.filter(table.column("first").is_valid())
        keys, n = added(table.filter(table.column("first").is_null()))
        first = np.full(len(keys), step, np.int64)
        before = np.zeros(len(keys), np.int64)
        for row in old.to_pylist():
            was = unpack(row["n"], "<i8")
            keys, n, before = np.concatenate([keys, unpack_sorted(row["keys"])]), np.concatenate([n, was]), np.concatenate([before, was])
            first = np.concatenate([first, unpack(row["first"], "<u2").astype(np.int64)])
        order = np.argsort(keys)
        at = heads(keys[order])
        keys = keys[order][at]
        if len(at):
            n, before, first = np.add.reduceat(n[order], at), np.add.reduceat(before[order], at), np.minimum.reduceat(first[order], at)
        passed = keys[(n >= threshold) & (before < threshold)]
        stay = first > step - shards + 1
        packed = [pack_sorted(keys[stay]), pack(n[stay]), pack(first[stay].astype("<u2")), pack_sorted(passed)]
        return pa.table([table.column("bucket").slice(0, 1), *[pa.array([p], pa.binary()) for p in packed]], names=["bucket", "keys", "n", "first", "passed"])

    return run


def _passed(state: DataFrame, widest: int) -> DataFrame:
    """The keys named in a step, of phrases of up to ``widest`` words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for packed in batch.column("passed").to_pylist():
                keys = unpack_sorted(packed)
                yield pa.RecordBatch.from_arrays([pa.array(keys[(keys & np.uint64(7)) <= np.uint64(widest)].view(np.int64))], names=["key"])

    return state.select("passed").mapInArrow(run, "key long")


PHRASES = "bucket int, lang string, phrases binary, n binary"


def _summed(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
    """Equal phrases (not hashes) drawn together, their counts summed."""
    keys = parts[0].schema.names[:-1]
    summed = pa.Table.from_batches(parts).group_by(keys, use_threads=False).aggregate([("n", "sum")])
    return summed.select([*keys, "n_sum"]).rename_columns([*keys, "n"]).combine_chunks().to_batches()[0]


def _packed_phrases(part: pa.RecordBatch) -> pa.RecordBatch:
    """Phrases and counts in a row per bucket and language. No phrase has a line feed."""
    part = part.sort_by([("bucket", "ascending"), ("lang", "ascending"), ("phrase", "ascending")])
    bucket, lang, phrase = (part.column(c).to_pylist() for c in ("bucket", "lang", "phrase"))
    n = part.column("n").to_numpy().astype("<u4")
    at = [k for k in range(len(part)) if k == 0 or (bucket[k], lang[k]) != (bucket[k - 1], lang[k - 1])]
    cut = list(zip(at, [*at[1:], len(part)]))
    columns = [[bucket[x] for x in at], [lang[x] for x in at], [zstandard.compress("\n".join(phrase[x:y]).encode(), 1) for x, y in cut], [pack(n[x:y]) for x, y in cut]]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.string(), pa.binary(), pa.binary()))], names=["bucket", "lang", "phrases", "n"])


def _spelt(texts: DataFrame, longest: int, frequent: Filter, buckets: int) -> DataFrame:
    """Packed counts per task, bucket and language of the phrases that the filter holds; the phrase '' has the number of words."""
    shared = texts.sparkSession.sparkContext.broadcast(frequent)
    names = ["bucket", "lang", "phrase", "n"]

    def rows(batch: pa.RecordBatch, first: int, part: list[bytes]) -> Iterator[pa.RecordBatch]:
        langs = batch.column("lang").slice(first, len(part)).to_pylist()
        words = words_of(part, BLANKS, BREAKS)
        if not len(words.start):
            return
        totals: dict[str, int] = {}
        for lang, n in zip(langs, np.bincount(words.text, minlength=len(langs)).tolist()):
            totals[lang] = totals.get(lang, 0) + n
        yield pa.RecordBatch.from_arrays([pa.array([0] * len(totals), pa.int32()), pa.array(list(totals)), pa.array([""] * len(totals)), pa.array(list(totals.values()), pa.int64())], names=names)
        for width, at, keys in active_runs(words, langs, longest, shared.value, None, True):
            held = shared.value.holds(keys)
            at, keys = at[held], keys[held]
            if not len(at):
                continue
            order = np.argsort(keys)
            where = heads(keys[order])
            seen, n = at[order[where]], np.diff(where, append=len(at))
            bucket = bucket_of(keys[order[where]], buckets).astype(np.int32)
            lang = pa.DictionaryArray.from_arrays(pa.array(words.text[seen].astype(np.int32)), pa.array(langs)).cast(pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(bucket), lang, pa.array(words.spelt(seen, width), pa.binary()).cast(pa.string()), pa.array(n)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, size = [], 0
        for batch in batches:
            for first, part in slices(batch.column("text"), SLICE_BYTES):
                for made in rows(batch, first, part):
                    parts.append(made)
                    size += len(made)
                if size >= SPELT:
                    parts = [_summed(parts)]
                    size = len(parts[0])
                    if size >= SPELT // 2:
                        yield _packed_phrases(parts.pop())
                        size = 0
        if size:
            yield _packed_phrases(_summed(parts))

    return texts.select("lang", "text").mapInArrow(run, PHRASES)


def _together(threshold: int):
    """Adds the counts of the phrases of a bucket and language; the frequent ones and '' stay."""

    def run(table: pa.Table) -> pa.Table:
        phrases: list[bytes] = []
        for packed in table.column("phrases").to_pylist():
            phrases += zstandard.decompress(packed).split(b"\n")
        n = np.concatenate([unpack(x, "<u4") for x in table.column("n").to_pylist()]).astype(np.int64)
        summed = _summed([pa.RecordBatch.from_arrays([pa.array(phrases, pa.binary()).cast(pa.string()), pa.array(n)], names=["phrase", "n"])])
        stay = summed.filter(pc.or_(pc.greater_equal(summed.column("n"), threshold), pc.equal(summed.column("phrase"), "")))
        phrase = stay.column("phrase")
        width = pc.if_else(pc.equal(phrase, ""), 0, pc.add(pc.count_substring(phrase, " "), 1)).cast(pa.int32())
        lang = pa.array([table.column("lang")[0].as_py()] * len(stay), pa.string())
        return pa.table([lang, width, phrase, stay.column("n")], names=["lang", "width", "phrase", "n"])

    return run


def frequent_phrases(docs: DataFrame, text_col: str, lang_col: str, threshold: int, longest: int, shards: int = SHARDS) -> DataFrame:
    """(lang, width, phrase, n): every phrase of 1 to ``longest`` words with ``threshold`` occurrences, and per language the number of words (width 0, phrase '')."""
    spark = docs.sparkSession
    texts = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.col(text_col).cast("string").alias("text")).where("text <> ''")
    dealt = texts.withColumn("shard", F.pmod(F.monotonically_increasing_id(), F.lit(shards)).cast("int"))
    path = scratch_path(spark, "shards")
    dealt.write.option("compression", "zstd").partitionBy("shard").parquet(path)
    stored = spark.read.schema("lang string, text string, shard int").parquet(path)
    size = stored.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    buckets = buckets_for(size)
    # Of each width at most words / threshold phrases are frequent; a word of text takes some 5 bytes.
    bits = room(longest * size / 5 / threshold)
    filters: list[Filter | None] = [Filter(bits)]
    states: list[DataFrame] = []
    step, grew = 0, []
    while True:
        past = filters[step - shards] if step >= shards else Filter(bits)
        scanned, shared = _scan(stored.where(F.col("shard") == step % shards), buckets, longest, filters[step], past, step < shards)
        both = scanned.withColumn("first", F.lit(None).cast("binary"))
        if states:
            both = both.unionByName(states[-1].select(*both.columns))
        states.append(settle(both.groupBy("bucket").applyInArrow(_merge(step, shards, threshold), STATE), f"counts{step}"))
        shared.unpersist()
        filters.append(filters[step].with_keys(_passed(states[-1], longest - 1)))
        grew.append(not np.array_equal(filters[-1].words, filters[-2].words))
        if step >= shards:
            filters[step - shards] = None
        if step >= shards - 1 and not any(grew[-shards:]):
            break
        step += 1
    every = Filter(bits).with_keys(_passed(reduce(DataFrame.unionByName, states), longest))
    counted = _spelt(stored, longest, every, buckets).groupBy("bucket", "lang").applyInArrow(_together(threshold), COUNTED)
    return settle(counted, "phrases")


def _best(ranked: DataFrame, order: list[Column], top: int) -> DataFrame:
    """The first ``top`` rows of each language with their rank; no task sorts all rows of a language."""
    for groups in RANK_GROUPS:
        dealt = ranked.withColumn("dealt", F.pmod(F.xxhash64("phrase"), F.lit(groups)))
        ranked = dealt.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "dealt").orderBy(*order))).where(F.col("rank") <= top).drop("dealt")
    return ranked


def collocations(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", threshold: int = 100, longest: int = 5, top: int = 2000, shards: int = SHARDS) -> DataFrame:
    """The ``top`` phrases of 2 to ``longest`` words of each language: lang, rank, phrase, a, l, r, n, score.

    A-Z are lower-cased; words are runs of bytes other than space and tab within pieces, which end
    at ``.,;:!?`` and 0x0A-0x0D. a is the number of occurrences (``threshold`` at least), l and r
    those of the two parts of the cut with the lowest score (ties: the shortest first part), n the
    number of words of the language, score = floor(1000 a n / (l r)), computed without rounding. A
    phrase goes if a longer one that contains it occurs as often. Order: score and a descending,
    phrase ascending by bytes. A null language is ``und``; null and empty texts have no words;
    repeated rows count each; other columns are not read. No texts, no rows.
    """
    found = frequent_phrases(docs, text_col, lang_col, threshold, longest, shards)
    totals = found.where("width = 0").select(F.col("lang").alias("of"), F.col("n").alias("words"))
    counts = found.where(F.col("width") > 0).select("lang", "phrase", "n")
    candidates = found.where("width > 1").select("lang", "width", "phrase", F.col("n").alias("a"))
    words = F.split("phrase", " ", -1)
    joined = lambda first, size: F.array_join(F.slice(words, first, size), " ")
    longer_ones = candidates.where("width > 2").select("lang", F.explode(F.array(joined(F.lit(1), F.col("width") - 1), joined(F.lit(2), F.col("width") - 1))).alias("phrase"), F.col("a").alias("n"))
    whole = longer_ones.groupBy("lang", "phrase").agg(F.max("n").alias("within"))
    own = candidates.join(whole, ["lang", "phrase"], "left").where(F.coalesce(F.col("within") < F.col("a"), F.lit(True))).drop("within")
    cut = F.explode(F.sequence(F.lit(1), F.col("width") - 1))
    cuts = own.withColumn("k", cut).withColumns({"left": joined(F.lit(1), F.col("k")), "right": joined(F.col("k") + 1, F.col("width") - F.col("k"))})
    sided = cuts
    for side, name in (("left", "l"), ("right", "r")):
        part = counts.select(F.col("lang").alias(f"{side}_lang"), F.col("phrase").alias(f"{side}_phrase"), F.col("n").alias(name))
        sided = sided.join(part, (F.col("lang") == F.col(f"{side}_lang")) & (F.col(side) == F.col(f"{side}_phrase"))).drop(f"{side}_lang", f"{side}_phrase")
    full = sided.join(totals, F.col("lang") == F.col("of")).drop("of")
    exact = lambda c: f"cast({c} as decimal(18,0))"
    scored = full.withColumn("score", F.expr(f"cast((cast(1000 as decimal(4,0)) * {exact('a')} * {exact('words')}) div ({exact('l')} * {exact('r')}) as bigint)"))
    lowest = scored.groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "a", "l", "r", "words")).alias("at")).select("lang", "phrase", "at.*")
    best = _best(lowest, [F.desc("score"), F.desc("a"), F.asc("phrase")], top)
    return best.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", F.col("words").alias("n"), "score")
