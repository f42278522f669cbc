"""Language-model scoring by a probabilistic suffix tree over words.

The model keeps contexts of variable length. A context (the words before a token) is considered from
``CONTEXT_MIN`` training occurrences on, and retained if its next-word distribution diverges from
that of the context without its first word by enough log-likelihood, or if a longer retained context
ends in it. Words that follow a context ``SYMBOL_MIN`` times are stored with their counts; what else
follows it falls back to the shorter context:

    P(w | s) = (n(s, w) + (MASS + rest(s)) P(w | shorter s)) / (n(s) + MASS)

A token is scored by the longest retained context that ends before it; the empty context is the
smoothed word distribution. Every document ends with a token of its own.

Counts, contexts and the model are tables whose rows are spread by 64-bit hashes of word runs. Runs
of length k + 1 are counted once those of length k are known: filters of bounded size say which
contexts and which runs after their first word are frequent enough, and later which rows the model holds. To score, the documents
are dealt to pages, each written in parts of some 2 MB of text; a page asks once for each distinct row
that it may need (by two codes, where the row is of two frequent words, else by its hash), the rows
come back to the page, and its parts stream past them. The rows of the most frequent words, which most pages need,
are sent to all tasks instead (``MOST_KNOWN`` at most). Nothing else of the corpus or the model is held
by the driver.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast, TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tidemark.llm.common import slices
from tidemark.llm.ngrams import (
    SLICE_BYTES, Filter, added, bucket_of, buckets_for, count_keys, distinct, heads, longer, pack, pack_sorted, ranges, room, unpack, unpack_sorted, words_of,
)
from tidemark.session import scratch_path, scratch_scope, settle, small_batches

BLANKS = b" \t\n\x0b\x0c\r"
DEPTH = 3
CONTEXT_MIN = 32
SYMBOL_MIN = 8
MASS = 4.0
#: Log-likelihood (nats) that a retained context gains for each word it stores.
GAIN = 2.0
PAGE_BYTES = 16 << 20
PAGE_LEVEL = 6
MOST_PAGE_BUCKETS = 50_000
MOST_CODES = (1 << 16) - 1
MOST_KNOWN = 1 << 18
HELD = 1 << 19  # pairs that a task gathers before it sends them
END = np.uint64(0x5851F42D4C957F2D)


def tokens(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, text number, place in its text) of every token, ends included."""
    words = words_of(texts, BLANKS, b"")
    counts = np.bincount(words.text, minlength=len(texts))
    ends = np.cumsum(counts + 1)
    out = np.full(int(ends[-1]), END)
    inside = np.ones(len(out), bool)
    inside[ends - 1] = False
    out[inside] = words.hashes
    text = np.repeat(np.arange(len(texts)), counts + 1)
    return out, text, np.arange(len(out)) - np.repeat(ends - counts - 1, counts + 1)


def runs(word: np.ndarray, place: np.ndarray, depth: int) -> list[np.ndarray]:
    """Of each token the hashes of the runs of 1, 2, ..., depth + 1 tokens that end in it (0 where its text starts later)."""
    out = [word]
    for k in range(1, depth + 1):
        run = np.zeros(len(word), np.uint64)
        run[1:] = longer(out[k - 1][:-1], word[1:])
        run[place < k] = 0
        out.append(run)
    return out


def _signed(keys: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(keys).view(np.int64))


def _merged(columns: list[np.ndarray]) -> list[np.ndarray]:
    """Equal pairs (first two columns) drawn together, counts (last column) summed."""
    pair = longer(columns[0], columns[1])
    order = np.argsort(pair)
    at = heads(pair[order])
    total = np.add.reduceat(columns[-1][order], at) if len(at) else columns[-1]
    return [*[c[order[at]] for c in columns[:-1]], total]


def _step(n: str) -> Column:
    return F.floor(F.log2(n) * 8).cast("int")


def _least_step(words: DataFrame, most: int) -> int | None:
    """The least step of counts that leaves ``most`` words at most; None if the last step has more."""
    taken, least = 0, None
    for row in sorted(words.groupBy(_step("n").alias("step")).agg(F.count("*").alias("words")).collect(), reverse=True):
        taken += row["words"]
        if taken > most:
            break
        least = row["step"]
    return least


def _nearest(table: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Where each key is in a sorted table, if it is there. Keys are looked up in order, which stays in a cache that a search per key would leave."""
    order = np.argsort(keys)
    at = np.empty(len(keys), np.int64)
    at[order] = np.searchsorted(table, keys[order])
    return np.minimum(at, len(table) - 1)


class Codes:
    """Two bytes for each of the most frequent words, which most tokens are; other words are sent in full."""

    def __init__(self, by_rank: np.ndarray):
        self.by_rank, order = by_rank, np.argsort(by_rank)
        self.sorted, self.rank = by_rank[order], order.astype("<u2")

    @classmethod
    def of(cls, words: DataFrame) -> Codes:
        """Of the words above the least count that leaves ``MOST_CODES`` of them at most."""
        least = _least_step(words, MOST_CODES)
        if least is None:
            return cls(np.empty(0, np.uint64))
        rows = words.where(_step("n") >= least).select("key", "n").collect()
        return cls(np.array([r["key"] for r in sorted(rows, key=lambda r: (-r["n"], r["key"]))], np.int64).view(np.uint64))

    def number(self, words: np.ndarray) -> np.ndarray:
        """The code of each word, ``MOST_CODES`` where it has none."""
        code = np.full(len(words), MOST_CODES, "<u2")
        if len(self.sorted):
            at = _nearest(self.sorted, words)
            known = self.sorted[at] == words
            code[known] = self.rank[at[known]]
        return code

    def pack(self, words: np.ndarray) -> tuple[bytes, bytes]:
        """Codes in order, and the words that have none."""
        code = self.number(words)
        return pack(code), pack(words[code == MOST_CODES])

    def runs(self, pairs: np.ndarray) -> np.ndarray:
        """Hashes of the runs of two words given as first code * 2**16 + second code."""
        return longer(self.by_rank[pairs >> 16], self.by_rank[pairs & 0xFFFF])

    def unpack(self, codes: bytes, others: bytes) -> np.ndarray:
        code = unpack(codes, "<u2")
        known = code < MOST_CODES
        out = np.empty(len(code), np.uint64)
        out[known], out[~known] = self.by_rank[code[known]], unpack(others, "<u8")
        return out


class Known:
    """The model's rows of the most frequent words, sorted by key. Pages need not ask for them."""

    def __init__(self, key: np.ndarray, n: np.ndarray, rest: np.ndarray):
        self.key, self.n, self.rest = key, n, rest

    @classmethod
    def of(cls, words: DataFrame, retained: DataFrame) -> Known:
        """Of the words above the least count that leaves ``MOST_KNOWN`` of them at most; ``retained`` has the contexts of one word."""
        least = _least_step(words, MOST_KNOWN)
        if least is None:
            return cls(np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64))
        rows = words.where(_step("n") >= least).select("key", "n").toArrow()
        key, n = rows.column("key").to_numpy().view(np.uint64), rows.column("n").to_numpy()
        order = np.argsort(key)
        known = cls(key[order], n[order], np.full(len(key), -1))
        rows = retained.where(_step("all") >= least).select("context", "rest").toArrow()
        known.rest[np.searchsorted(known.key, rows.column("context").to_numpy().view(np.uint64))] = rows.column("rest").to_numpy()
        return known

    def lacks(self, words: np.ndarray) -> np.ndarray:
        """The words that are not among them."""
        if not len(self.key):
            return words
        return words[self.key[np.minimum(np.searchsorted(self.key, words), len(self.key) - 1)] != words]


PAIRS = "bucket int, context binary, length binary, word binary, other binary, n binary"


def _packed_pairs(columns: list[np.ndarray], buckets: int, hot: Filter, codes: Codes) -> pa.RecordBatch:
    """(context, word, n) per bucket. A context's pairs lie in its own bucket, or, if it is hot, in those of the pairs."""
    spread = hot.holds(columns[0])
    rows: list[list] = [[] for _ in range(6)]
    for some, place in ((~spread, columns[0]), (spread, longer(columns[0], columns[1]))):
        bucket = bucket_of(place[some], buckets)
        own = [c[some] for c in columns]
        order = np.lexsort((own[0], bucket))
        own, bucket = [c[order] for c in own], bucket[order]
        cuts = heads(bucket)
        for a, b in zip(cuts, [*cuts[1:], len(bucket)]):
            context, word, n = (c[a:b] for c in own)
            at = heads(context)
            made = (int(bucket[a]), pack_sorted(context[at]), pack(np.diff(at, append=b - a).astype("<u4")), *codes.pack(word), pack(n.astype("<u4")))
            for column, x in zip(rows, made):
                column.append(x)
    return pa.RecordBatch.from_arrays([pa.array(rows[0], pa.int32()), *[pa.array(r, pa.binary()) for r in rows[1:]]], names=["bucket", "context", "length", "word", "other", "n"])


def _deeper(texts: DataFrame, buckets: int, k: int, contexts: Filter, ends: Filter, hot: Filter, codes: Broadcast) -> DataFrame:
    """Packed counts of the runs of k + 1 tokens whose first k are a frequent context and whose last k are a frequent run.

    No run is more frequent than its last k tokens, so no frequent one is left out.
    """
    shared = texts.sparkSession.sparkContext.broadcast((contexts, ends, hot))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often, common, spread = shared.value
        parts, size = [], 0
        for batch in batches:
            for _, part in slices(batch.column("text"), SLICE_BYTES):
                word, _, place = tokens(part)
                before = runs(word, place, k - 1)
                at = np.flatnonzero(place >= k)
                at = at[often.holds(before[k - 1][at - 1])]
                at = at[common.holds(before[k - 1][at])]
                parts.append(_merged([before[k - 1][at - 1], word[at], np.ones(len(at), np.uint32)]))
                size += len(parts[-1][0])
                if size >= HELD:
                    parts = [_merged([np.concatenate(c) for c in zip(*parts)])]
                    size = len(parts[0][0])
                    if size >= HELD // 2:
                        yield _packed_pairs(parts.pop(), buckets, spread, codes.value)
                        size = 0
        if size:
            yield _packed_pairs(_merged([np.concatenate(c) for c in zip(*parts)]), buckets, spread, codes.value)

    return texts.mapInArrow(run, PAIRS)


def _totals(gathered: DataFrame, least: int, codes: Broadcast) -> DataFrame:
    """(key, context, word, n) of the pairs with ``least`` occurrences; key is the run of context and word."""

    def merge(table: pa.Table) -> pa.Table:
        parts = []
        for row in table.to_pylist():
            context = np.repeat(unpack_sorted(row["context"]), unpack(row["length"], "<u4"))
            parts.append([context, codes.value.unpack(row["word"], row["other"]), unpack(row["n"], "<u4").astype(np.int64)])
        context, word, n = _merged([np.concatenate(c) for c in zip(*parts)])
        often = n >= least
        context, word = context[often], word[often]
        return pa.table([_signed(longer(context, word)), _signed(context), _signed(word), pa.array(n[often])], names=["key", "context", "word", "n"])

    return gathered.groupBy("bucket").applyInArrow(merge, "key long, context long, word long, n long")


def _lowered(level: DataFrame, below: DataFrame | None) -> DataFrame:
    """(key, context, shorter, lower, n): the context without its first word, and the run of that and the word."""
    if below is None:
        return level.select("key", "context", F.lit(0).cast("long").alias("shorter"), F.col("word").alias("lower"), "n")
    joined = level.join(below.select(F.col("key").alias("context"), F.col("lower").alias("shorter")), "context")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shorter, word = (batch.column(c).to_numpy().view(np.uint64) for c in ("shorter", "word"))
            columns = [batch.column("key"), batch.column("context"), batch.column("shorter"), _signed(longer(shorter, word)), batch.column("n")]
            yield pa.RecordBatch.from_arrays(columns, names=["key", "context", "shorter", "lower", "n"])

    return joined.mapInArrow(run, "key long, context long, shorter long, lower long, n long")


@dataclass
class Model:
    """A suffix tree as a table (key, n, rest): occurrences of a run, and, where the run is a retained context, how many of its next words are not stored (else -1). A run may have a row of either kind."""

    rows: DataFrame
    held: Filter
    train_tokens: int
    distinct: int
    depth: int
    codes: Broadcast
    known: Broadcast


def _word_counts(texts: DataFrame, buckets: int) -> DataFrame:
    """(key, n) of every distinct token."""

    def merge(table: pa.Table) -> pa.Table:
        key, n = added(table)
        return pa.table([_signed(key), pa.array(n)], names=["key", "n"])

    counted = count_keys(texts, buckets, lambda: lambda batch, first, part: iter([tokens(part)[0]]))
    return counted.groupBy("bucket").applyInArrow(merge, "key long, n long")


def learn(docs: DataFrame, text_col: str = "text", depth: int = DEPTH, context_min: int = CONTEXT_MIN, symbol_min: int = SYMBOL_MIN, gain: float = GAIN) -> Model:
    """A model of all texts of the documents. A null text is empty (an end only). No documents, no tokens."""
    if symbol_min > context_min:
        raise ValueError("a context must be as frequent as the words that it stores")
    spark = docs.sparkSession
    texts = docs.select(F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    size = texts.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    buckets = buckets_for(size)
    with small_batches(spark):
        words = settle(_word_counts(texts, buckets), "words")
    sums = words.agg(F.sum("n").alias("n"), F.count("*").alias("v")).first()
    train_tokens = sums["n"] or 0
    # Of each length, at most tokens / minimum runs are frequent, texts have far fewer; a token takes some 6 bytes.
    frequent = words.where(F.col("n") >= symbol_min)
    codes = spark.sparkContext.broadcast(Codes.of(frequent))
    with scratch_scope(spark), small_batches(spark):  # counts and tests of the runs go as soon as what is kept of them is written
        level, counts = frequent, []
        for k in range(1, depth + 1):
            ends = Filter(room(size / 24 / symbol_min)).with_keys(level)
            contexts = Filter(room(size / 24 / context_min)).with_keys(level.where(F.col("n") >= context_min))
            hot = Filter(room(4 * buckets)).with_keys(level.where(F.col("n") >= max(1000, train_tokens // (4 * buckets))))
            level = settle(_lowered(_totals(_deeper(texts, buckets, k, contexts, ends, hot, codes), symbol_min, codes), counts[-1] if counts else None), f"runs{k}")
            counts.append(level)
        # Divergence of each context from the shorter one, over the words it stores and all others together.
        tested: list[DataFrame] = []
        for k, level in enumerate(counts, 1):
            below = frequent if k == 1 else counts[k - 2]
            lower = below.select(F.col("key").alias("lower"), F.col("n").alias("lower_n"))
            whole = below.where(F.col("n") >= context_min).select(F.col("key").alias("context"), F.col("n").alias("all"))
            gained = F.sum(F.col("n") * F.ln(F.col("n") / F.col("lower_n"))).alias("gained")
            sides = level.join(lower, "lower").groupBy("context", "shorter").agg(F.sum("n").alias("stored"), F.sum("lower_n").alias("lower_stored"), F.count("*").alias("symbols"), gained).join(whole, "context")
            if k == 1:
                sides = sides.withColumn("shorter_all", F.lit(float(train_tokens)))
            else:
                short = frequent if k == 2 else counts[k - 3]
                sides = sides.join(short.select(F.col("key").alias("shorter"), F.col("n").cast("double").alias("shorter_all")), "shorter")
            rest = F.col("all") - F.col("stored")
            lower_rest = F.greatest(F.col("shorter_all") - F.col("lower_stored"), F.lit(0.5))
            others = F.when(rest > 0, rest * F.ln(rest / lower_rest)).otherwise(0.0)
            divergence = F.col("gained") + others - F.col("all") * F.ln(F.col("all") / F.col("shorter_all"))
            tested.append(settle(sides.select("context", "shorter", "all", rest.alias("rest"), (divergence >= gain * F.col("symbols")).alias("kept")), f"contexts{k}"))
        kept: list[DataFrame] = []
        for own in reversed(tested):  # what a longer retained context ends in is retained as well
            if kept:
                ends = kept[0].select(F.col("shorter").alias("context"), F.lit(True).alias("ends")).distinct()
                own = own.join(ends, "context", "left").withColumn("kept", F.col("kept") | F.coalesce("ends", F.lit(False)))
            kept.insert(0, settle(own.where("kept").select("context", "shorter", "all", "rest"), "retained", outer=True))
        stored = settle(_union([c.join(x.select("context"), "context", "left_semi").select("key", "n") for c, x in zip(counts, kept)]), "stored", outer=True)
    retained = _union([x.select(F.col("context").alias("key"), F.col("all").alias("n"), "rest") for x in kept])
    plain = stored.unionByName(words).withColumn("rest", F.lit(-1).cast("long"))
    held = Filter(room(size / 24 / symbol_min)).with_keys(stored.select("key").unionByName(retained.select("key")))
    known = spark.sparkContext.broadcast(Known.of(words, kept[0]))
    return Model(plain.unionByName(retained), held, train_tokens, sums["v"], depth, codes, known)


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame)
    return out


def _wanted(body: bytes, depth: int, held: Filter, codes: Codes, known: Known | None = None) -> tuple[np.ndarray, np.ndarray]:
    """What a part of a page may need of the model: its words but the known ones, and the longer runs that the model may hold.

    Sorted keys, and, of runs of two words that have codes, sorted pairs of codes. The model holds
    the last k tokens of every run of k + 1 tokens that it holds, and the first k as well where the
    run is too long for a context. A run for which a filter denies these is not asked for.
    """
    found, pairs = [], []
    for _, texts in _unpacked(body):
        word, _, place = tokens(texts)
        every = runs(word, place, depth)
        found.append(distinct(word) if known is None else known.lacks(distinct(word)))
        maybe = np.ones(len(word), bool)
        for k in range(1, depth + 1):
            at = np.flatnonzero(maybe & (place >= k))
            if k == depth:
                at = at[maybe[at - 1]]
            at = at[held.holds(every[k][at])]
            maybe = np.zeros(len(word), bool)
            maybe[at] = True
            if k == 1:
                code = codes.number(word)
                coded = (code[at - 1] < MOST_CODES) & (code[at] < MOST_CODES)
                pairs.append(distinct(code[at[coded] - 1].astype(np.uint32) << np.uint32(16) | code[at[coded]]))
                at = at[~coded]
            found.append(distinct(every[k][at]))
    return distinct(np.concatenate(found)), distinct(np.concatenate(pairs))


def _wanted_of(bodies: pa.ChunkedArray, depth: int, held: Filter, codes: Codes, known: Known) -> tuple[np.ndarray, np.ndarray]:
    """What all parts of a page want together."""
    every = (np.empty(0, np.uint64), np.empty(0, np.uint32))
    for body in bodies:  # drawn together part by part, as most parts want much the same
        every = tuple(distinct(np.concatenate(x)) for x in zip(every, _wanted(body.as_py(), depth, held, codes, known)))
    return every


def _asked(keys: np.ndarray, pairs: np.ndarray, codes: Codes, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """All keys that a page asks for by bucket, within it those of its pairs last, and the place of each in keys and pairs together."""
    every = np.concatenate([keys, codes.runs(pairs)])
    order = np.argsort(bucket_of(every, buckets), kind="stable")
    return every[order], order


class Page:
    """The model rows that a page has asked for and the known ones, sorted by key."""

    def __init__(self, key: np.ndarray, n: np.ndarray, rest: np.ndarray, model_tokens: int, distinct: int, depth: int):
        self.key, self.n, self.rest = key, n, rest
        self.tokens, self.distinct, self.depth = model_tokens, distinct, depth

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(n, rest) of each key: 0 and -1 where there is no row."""
        if not len(self.key):
            return np.zeros(len(keys), np.int64), np.full(len(keys), -1)
        at = _nearest(self.key, keys)
        same = self.key[at] == keys
        return np.where(same, self.n[at], 0), np.where(same, self.rest[at], -1)

    def score(self, texts: list[bytes]) -> list[np.ndarray]:
        """n_tokens, n_known, base_score and score of each text."""
        word, text, place = tokens(texts)
        count, rest = self.find(word)
        chance = (count + 0.1) / (self.tokens + 0.1 * (self.distinct + 1))
        base = np.log10(chance)
        every = runs(word, place, self.depth)
        whole = count  # occurrences of the run of k tokens that ends in each token; rest: of its next words not stored
        for k in range(1, self.depth + 1):
            before, open_ = np.zeros(len(word), np.int64), np.full(len(word), -1)
            before[1:], open_[1:] = whole[:-1], rest[:-1]
            used = (place >= k) & (open_ >= 0)
            # Runs are stored under retained contexts, and a retained context ends in a retained one.
            at = np.flatnonzero(used | (place >= k) & (rest >= 0) if k < self.depth else used)
            n, left = np.zeros(len(word), np.int64), np.full(len(word), -1)
            n[at], left[at] = self.find(every[k][at])
            chance[used] = (n[used] + (MASS + open_[used]) * chance[used]) / (before[used] + MASS)
            whole, rest = n, left
        sums = [np.bincount(text, weights=x, minlength=len(texts)) for x in (np.ones(len(word)), count > 0, base, np.log10(chance))]
        return [sums[0].astype(np.int64), sums[1].astype(np.int64), *sums[2:]]


def _pack_rest(rest: np.ndarray) -> bytes:
    """A bit for each number that is not -1, then those numbers."""
    some = rest >= 0
    return np.packbits(some).tobytes() + pack(rest[some])


def _unpack_rest(packed: bytes, size: int) -> np.ndarray:
    bits = -(-size // 8)
    some = np.unpackbits(np.frombuffer(packed[:bits], np.uint8), count=size).astype(bool)
    rest = np.full(size, -1)
    rest[some] = unpack(packed[bits:], "<i8")
    return rest


def _pages(rows: DataFrame, buckets: int) -> DataFrame:
    """(page, body): consecutive rows with some ``PAGE_BYTES`` of texts are a page, a compressed body holds a slice of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        page, size = TaskContext.get().partitionId() << 32, 0
        for batch in batches:
            for first, texts in slices(batch.column("__text"), SLICE_BYTES):
                yield _packed(page, [batch.slice(first, len(texts))])
                size += sum(map(len, texts))
                if size >= PAGE_BYTES:
                    page, size = page + 1, 0

    # Bucketed by page, so that the replies come to the pages and no text is shuffled.
    path, name = scratch_path(rows.sparkSession, "pages"), f"pages_{uuid.uuid4().hex}"
    paged = rows.mapInArrow(run, "page long, body binary")
    with small_batches(rows.sparkSession):
        paged.write.options(path=path, compression="uncompressed").bucketBy(buckets, "page").saveAsTable(name)  # bodies are compressed already
    return rows.sparkSession.table(name)


def _packed(page: int, held: list[pa.RecordBatch]) -> pa.RecordBatch:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, held[0].schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", compression_level=PAGE_LEVEL))) as out:
        for batch in held:
            out.write_batch(batch)
    return pa.RecordBatch.from_arrays([pa.array([page]), pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["page", "body"])


def _unpacked(body: bytes) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Slices of the rows of a part of a page, and their texts."""
    for batch in pa.ipc.open_stream(body):
        for first, texts in slices(batch.column("__text"), SLICE_BYTES // 2):  # the page's rows are held beside them
            yield batch.slice(first, len(texts)), texts


RESULTS = T.StructType().add("n_tokens", "long").add("n_known", "long").add("train_tokens", "long").add("base_score", "double").add("score", "double")


def score(docs: DataFrame, model: Model, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Columns ``keep`` (default: all) and n_tokens, n_known, train_tokens, base_score and score (log10 probability) of each whole text.

    ``base_score`` is that of the empty context alone. A null or empty text has one token, its end. A
    column named like a result gives way. Repeated rows are scored alike.
    """
    spark = docs.sparkSession
    kept = [c for c in (docs.columns if keep is None else keep) if c not in RESULTS.fieldNames()]
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    size = docs.agg(F.coalesce(F.sum(F.octet_length(text)), F.lit(0))).first()[0]
    buckets = buckets_for(size)
    pages = _pages(docs.select(*[F.col(f"`{c}`").alias(f"__in{k}") for k, c in enumerate(kept)], text.alias("__text")), min(buckets, MOST_PAGE_BUCKETS))
    shared = spark.sparkContext.broadcast(model.held)
    depth, train_tokens, vocabulary, codes, known = model.depth, model.train_tokens, model.distinct, model.codes, model.known

    def ask(parts: pa.Table) -> pa.Table:
        page = parts.column("page")[0].as_py()
        keys, pairs = _wanted_of(parts.column("body"), depth, shared.value, codes.value, known.value)
        every, order = _asked(keys, pairs, codes.value, buckets)
        rows: list[list] = [[] for _ in range(4)]
        for b, x, y in ranges(every, buckets):
            own = order[x:y]
            plain = int(np.count_nonzero(own < len(keys)))
            for column, made in zip(rows, (b, page, pack_sorted(every[x : x + plain]), pack_sorted(pairs[own[plain:] - len(keys)]))):
                column.append(made)
        return pa.table([pa.array(rows[0], pa.int32()), pa.array(rows[1], pa.int64()), *[pa.array(r, pa.binary()) for r in rows[2:]]], names=["bucket", "page", "keys", "pairs"])

    def answer(model_rows: pa.Table, requests: pa.Table) -> pa.Table:
        key = model_rows.column("key").to_numpy().view(np.uint64)
        order = np.argsort(key)
        first = heads(key[order])
        n, rest = (model_rows.column(c).to_numpy()[order] for c in ("n", "rest"))
        if len(key):
            key, n, rest = key[order[first]], n[first], np.maximum.reduceat(rest, first)
        out: list[list] = [[] for _ in range(5)]
        for page, bucket, packed, pairs in zip(*(requests.column(c).to_pylist() for c in ("page", "bucket", "keys", "pairs"))) if len(key) else ():
            wanted = np.concatenate([unpack_sorted(packed), codes.value.runs(np.cumsum(unpack(pairs, "<u4"), dtype=np.int64))])
            at = _nearest(key, wanted)
            found = key[at] == wanted
            at = at[found]
            for column, x in zip(out, (page, bucket, np.packbits(found).tobytes(), pack(n[at]), _pack_rest(rest[at]))):
                column.append(x)
        return pa.table([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int32()), *[pa.array(c, pa.binary()) for c in out[2:]]], names=["page", "bucket", "found", "n", "rest"])

    requests = pages.groupBy("page").applyInArrow(ask, "bucket int, page long, keys binary, pairs binary")
    number = F.shiftrightunsigned(F.shiftrightunsigned("key", 32) * buckets, 32).cast("int")
    spread = model.rows.select(number.alias("bucket"), "key", "n", "rest")
    replies = spread.groupBy("bucket").cogroup(requests.groupBy("bucket")).applyInArrow(answer, "page long, bucket int, found binary, n binary, rest binary")
    fields = T.StructType([T.StructField(f"__in{k}", docs.schema[c].dataType) for k, c in enumerate(kept)] + RESULTS.fields)
    arrow = to_arrow_schema(fields)

    def fill(parts: pa.Table, found: pa.Table) -> pa.Table:
        made, bodies = [], parts.column("body")
        key, _ = _asked(*_wanted_of(bodies, depth, shared.value, codes.value, known.value), codes.value, buckets)
        n, rest = np.zeros(len(key), np.int64), np.full(len(key), -1)
        place = {b: (x, y) for b, x, y in ranges(key, buckets)}
        for row in found.to_pylist():
            x, y = place[row["bucket"]]
            at = x + np.flatnonzero(np.unpackbits(np.frombuffer(row["found"], np.uint8), count=y - x))
            n[at], rest[at] = unpack(row["n"], "<i8"), _unpack_rest(row["rest"], len(at))
        key, n, rest = (np.concatenate(c) for c in zip((key, n, rest), (known.value.key, known.value.n, known.value.rest)))
        order = np.argsort(key)
        ready = Page(key[order], n[order], rest[order], train_tokens, vocabulary, depth)
        del key, n, rest, order
        for body in bodies:
            for part, texts in _unpacked(body.as_py()):
                scored = ready.score(texts)
                columns = [*part.columns[:-1], *map(pa.array, scored[:2]), pa.array(np.full(len(texts), train_tokens)), *map(pa.array, scored[2:])]
                made.append(pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, arrow)], schema=arrow))
        return pa.Table.from_batches(made, schema=arrow)

    done = pages.groupBy("page").cogroup(replies.groupBy("page")).applyInArrow(fill, fields)
    return done.select(*[F.col(f"__in{k}").alias(c) for k, c in enumerate(kept)], *RESULTS.fieldNames())
