"""Removal of repeated word runs, found by recompression.

Every text is a string of word hashes. In each round, neighbouring symbols are named as one new
symbol when a bit of the left name is 1 and of the right name is 0 (so pairs never overlap and
equal neighbours never pair) and the joint length stays within the round's limit. Names are
hashes of what they stand for, so equal substrings get equal interior symbols everywhere without
any exchange; only symbols at the ends of a common substring can differ. To tell which ones,
every symbol carries its *closure*: the words that fix its being a symbol at all. A symbol whose
closure lies inside a window of ``width`` words is the same in every occurrence of that window.

1. Each page (some megabytes of documents) sends the names of its symbols with their closures, and
   the few windows that contain no closure, as 32-bit fingerprints to buckets. A bucket reports
   back to each page which of them other pages have as well. A run of equal symbols has equal
   closures and so gives one name.
2. Pages send the hashes of the windows around shared symbols only. A bucket reports back the
   windows that start in a smaller document of another page.
3. Each page adds the repeats among its own documents and removes the covered words.

A fingerprint only proposes; what is removed follows from 64-bit window hashes over 64-bit word
hashes, told apart by bucket as well. Each page sends a name once, so a passage that a third of all
documents share reaches a bucket once per page, never once per document, and no pair of documents
is ever formed. Texts are written once, bucketed by page, and are not shuffled.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import hash_words, mix, texts_of, windows
from tidemark.session import scratch_path

#: Longest symbol, in words, of each round: the shares of names sent and of windows without a
#: closure are smallest with these for windows of 13 words.
ROUNDS = (2, 2, 4, 5)
PAGE_BYTES = 4 << 20
BUCKET_NAMES = 500_000
POWER = 0x9FB21C651E98DF25
LAST = np.iinfo(np.int64).max


def symbols(words: np.ndarray, doc: np.ndarray, width: int, rounds=ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """(first, end) of the closures, at most ``width`` words long, of the last round's symbols.

    ``words`` holds the word hashes of documents one after the other, ``doc`` the document of each.
    """
    name, first = words, np.arange(len(words))
    end, low, high = first + 1, first, first + 1
    for k, limit in enumerate(rounds):
        if len(name) < 2:
            break
        left = (mix(name ^ np.uint64(0x9E37 + 7919 * k)) >> np.uint64(63)).astype(bool)
        span = end - first
        near = doc[:-1] == doc[1:]
        pair = near & left[:-1] & ~left[1:] & (span[:-1] + span[1:] <= limit)
        head, tail = np.zeros(len(name), bool), np.zeros(len(name), bool)
        head[:-1], tail[1:] = pair, pair
        lower, higher = low.copy(), high.copy()
        # A symbol that stays alone does so because of its neighbour; at the end of a document,
        # because of that end, which lies in no window.
        alone = ~head & ~tail & (span < limit)
        for mine, step, at_edge in ((alone & left, 1, np.append(~near, True)), (alone & ~left, -1, np.insert(~near, 0, True))):
            at = np.flatnonzero(mine & ~at_edge)
            lower[at] = np.minimum(low[at], low[at + step])
            higher[at] = np.maximum(high[at], high[at + step])
            higher[np.flatnonzero(mine & at_edge)] += 2 * width
        at = np.flatnonzero(pair)
        lower[at] = np.minimum(low[at], low[at + 1])
        higher[at] = np.maximum(high[at], high[at + 1])
        ends, names = end.copy(), name.copy()
        ends[at] = end[at + 1]
        names[at] = mix(name[at] * np.uint64(0xA0761D6478BD642F) + name[at + 1])
        keep = ~tail
        name, first, end, low, high, doc = names[keep], first[keep], ends[keep], lower[keep], higher[keep], doc[keep]
    fits = high - low <= width
    return low[fits], high[fits]


class Page:
    """Word hashes, windows and names of the documents of one page."""

    def __init__(self, texts: list[bytes], width: int):
        self.words = [t.split() for t in texts]
        self.counts = np.array([len(w) for w in self.words], np.int64)
        self.width = width
        self.hashes = hash_words([w for own in self.words for w in own])
        self.doc = np.repeat(np.arange(len(texts)), self.counts)
        n = len(self.hashes)
        self.window = windows(self.hashes, width)
        whole = self.doc[: len(self.window)] == self.doc[width - 1 :][: len(self.window)] if len(self.window) else np.empty(0, bool)
        self.starts = np.flatnonzero(whole)  # windows within one document
        self.whole = np.zeros(n + 1, bool)
        self.whole[self.starts] = True

    def _cover(self, first: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Which positions lie in one of the ranges."""
        n = len(self.hashes)
        change = np.bincount(np.clip(first, 0, n), minlength=n + 1)[: n + 1] - np.bincount(np.clip(end, 0, n), minlength=n + 1)[: n + 1]
        return np.cumsum(change) > 0

    def names(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(name, first, last) where first..last are the starts of the windows that contain it."""
        low, high = symbols(self.hashes, self.doc, self.width)
        n = len(self.hashes)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(self.hashes * _powers(POWER, n), out=sums[1:])
        # The words of a closure as one number that does not depend on where it lies.
        content = (sums[high] - sums[low]) * _powers(pow(POWER, -1, 1 << 64), n + 1)[low]
        without = self.starts[~self._cover(high - self.width, low + 1)[self.starts]]
        name = np.concatenate([mix(content + (high - low).astype(np.uint64)), mix(self.window[without] ^ np.uint64(0x5BD1E995))])
        return name, np.concatenate([high - self.width, without]), np.concatenate([low, without])

    def around(self, shared: np.ndarray, buckets: int) -> np.ndarray:
        """Starts of the windows that contain a shared name."""
        name, first, last = self.names()
        hit = np.isin(_codes(name, buckets), shared)
        return np.flatnonzero(self._cover(first[hit], last[hit] + 1) & self.whole)


def _powers(base: int, n: int) -> np.ndarray:
    powers = np.full(max(n, 1), base, np.uint64)
    powers[0] = 1
    return np.multiply.accumulate(powers)[:n]


def _codes(name: np.ndarray, buckets: int) -> np.ndarray:
    """Bucket and fingerprint of a name, in one number."""
    return ((name >> np.uint64(32)) % np.uint64(buckets)) << np.uint64(32) | (name & np.uint64(0xFFFFFFFF))


def _by_bucket(page: int, bucket: np.ndarray, *values: np.ndarray) -> dict[str, list]:
    """One row per bucket with its values (ordered by bucket already) as bytes."""
    cuts = np.flatnonzero(np.diff(bucket, prepend=-1)) if len(bucket) else np.empty(0, int)
    ends = np.append(cuts[1:], len(bucket))
    rows = {"page": [page] * len(cuts), "bucket": bucket[cuts].tolist()}
    for k, v in enumerate(values):
        rows[f"v{k}"] = [v[a:b].tobytes() for a, b in zip(cuts, ends)]
    return rows


def _joined(table: pa.Table, column: str, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of all rows of a column of bytes, and the row of each."""
    parts = [np.frombuffer(x, kind) for x in table.column(column).to_pylist()]
    return np.concatenate(parts) if parts else np.empty(0, kind), np.repeat(np.arange(len(parts)), [len(x) for x in parts])


RECORD = "page long, bucket long, v0 binary"
RECORD_DOC = RECORD + ", v1 binary"


def _table(rows: dict[str, list], schema: str) -> pa.Table:
    types = {"long": pa.int64(), "binary": pa.binary(), "string": pa.string()}
    fields = [c.split() for c in schema.split(", ")]
    return pa.table([pa.array(rows.get(n, []), types[t]) for n, t in fields], names=[n for n, _ in fields])


def _send_names(width: int, buckets: int):
    def run(docs: pa.Table) -> pa.Table:
        page = Page(texts_of(docs.column("text").combine_chunks()), width)
        codes = np.unique(_codes(page.names()[0], buckets))
        names = (codes & np.uint64(0xFFFFFFFF)).astype("<u4")
        return _table(_by_bucket(docs.column("page")[0].as_py(), (codes >> np.uint64(32)).astype(np.int64), names), RECORD)

    return run


def _shared_names(records: pa.Table) -> pa.Table:
    """Of each page's names in a bucket those that another page has too."""
    names, row = _joined(records, "v0", "<u4")
    order = np.argsort(names, kind="stable")
    same = names[order][1:] == names[order][:-1]
    twice = np.zeros(len(names), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    return _answer(records, row, names, twice)


def _answer(records: pa.Table, row: np.ndarray, values: np.ndarray, chosen: np.ndarray) -> pa.Table:
    pages, bucket = records.column("page").to_pylist(), records.column("bucket")[0].as_py()
    rows: dict[str, list] = {"page": [], "bucket": [], "v0": []}
    row, values = row[chosen], values[chosen]
    for k, at in zip(*np.unique(row, return_index=True)):
        rows["page"].append(pages[k])
        rows["bucket"].append(bucket)
        rows["v0"].append(values[at : np.searchsorted(row, k, "right")].tobytes())
    return _table(rows, RECORD)


def _ids(docs: pa.Table) -> np.ndarray:
    return docs.column("doc").combine_chunks().fill_null(LAST).to_numpy(zero_copy_only=False).astype(np.int64)


def _send_windows(width: int, buckets: int):
    def run(docs: pa.Table, answers: pa.Table) -> pa.Table:
        if not answers.num_rows or not docs.num_rows:
            return _table({}, RECORD_DOC)
        page = Page(texts_of(docs.column("text").combine_chunks()), width)
        names, row = _joined(answers, "v0", "<u4")
        bucket_of = np.array(answers.column("bucket").to_pylist(), np.uint64)
        starts = page.around(bucket_of[row] << np.uint64(32) | names.astype(np.uint64), buckets)
        found, doc = page.window[starts], _ids(docs)[page.doc[starts]]
        bucket = (windows(page.hashes, width, seed=2)[starts] % np.uint64(buckets)).astype(np.int64)
        order = np.lexsort((doc, found, bucket))
        found, doc, bucket = found[order], doc[order], bucket[order]
        first = np.ones(len(found), bool)
        first[1:] = (found[1:] != found[:-1]) | (bucket[1:] != bucket[:-1])
        return _table(_by_bucket(docs.column("page")[0].as_py(), bucket[first], found[first].astype("<u8"), doc[first].astype("<i8")), RECORD_DOC)

    return run


def _earlier_elsewhere(records: pa.Table) -> pa.Table:
    """Of each page's windows in a bucket those that start in a smaller document of another page."""
    found, row = _joined(records, "v0", "<u8")
    doc, _ = _joined(records, "v1", "<i8")
    return _answer(records, row, found, doc > _least(found, doc))


def _least(values: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """For each entry the smallest document among those of its value."""
    if not len(values):
        return doc
    order = np.argsort(values, kind="stable")
    cuts = np.flatnonzero(np.append(True, values[order][1:] != values[order][:-1]))
    least = np.minimum.reduceat(doc[order], cuts)
    out = np.empty_like(doc)
    out[order] = np.repeat(least, np.diff(np.append(cuts, len(values))))
    return out


def _remove(width: int):
    schema = "doc long, n_words long, n_removed long, kept_text string"

    def run(docs: pa.Table, answers: pa.Table) -> pa.Table:
        if not docs.num_rows:
            return _table({}, schema)
        page = Page(texts_of(docs.column("text").combine_chunks()), width)
        found, doc = page.window[page.starts], _ids(docs)[page.doc[page.starts]]
        again = doc > _least(found, doc)
        if answers.num_rows:
            again |= np.isin(found, _joined(answers, "v0", "<u8")[0])
        starts = page.starts[again]
        covered = page._cover(starts, starts + width)
        rows: dict[str, list] = {"doc": docs.column("doc").to_pylist(), "n_words": page.counts.tolist(), "n_removed": [], "kept_text": []}
        at = 0
        for words in page.words:
            gone = covered[at : at + len(words)]
            at += len(words)
            left = [w for w, g in zip(words, gone.tolist()) if not g] if gone.any() else words
            rows["n_removed"].append(len(words) - len(left))
            rows["kept_text"].append(b" ".join(left).decode())
        return _table(rows, schema)

    return run, schema


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 13) -> DataFrame:
    """Per document ``id_col`` (long), ``n_words``, ``n_removed`` and ``kept_text`` (words joined by a space).

    A word goes when a window of ``width`` words that covers it also starts in a document with a
    smaller id; all windows are those of the input. Null and empty texts have no words. Rows with
    the same id (repeated rows) do not remove each other; a null id counts as larger than any
    other. Columns other than these two are not read.
    """
    spark = docs.sparkSession
    source = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).cast("string").alias("text"))
    size = F.coalesce(F.octet_length("text"), F.lit(0))
    total, mean = source.agg(F.coalesce(F.sum(size), F.lit(0)), F.coalesce(F.avg(size), F.lit(1.0))).first()
    per_page = int(min(1 << 16, max(1, PAGE_BYTES // max(mean, 64))))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    buckets = int(max(4 * parts, total // 16 // BUCKET_NAMES))
    row = F.monotonically_increasing_id()
    page = F.when(size > PAGE_BYTES, -1 - F.col("row")).otherwise(F.shiftright("row", 33) * F.lit(1 << 33) + F.floor(F.col("row").bitwiseAND(F.lit((1 << 33) - 1)) / per_page))
    name = f"pages_{uuid.uuid4().hex}"
    paged = source.withColumn("row", row).select(page.cast("long").alias("page"), "doc", "text")
    paged.write.option("path", scratch_path(spark, name)).bucketBy(parts, "page").saveAsTable(name)
    pages = spark.table(name)

    names = pages.groupBy("page").applyInArrow(_send_names(width, buckets), RECORD)
    shared = names.groupBy("bucket").applyInArrow(_shared_names, RECORD)
    around = pages.groupBy("page").cogroup(shared.groupBy("page")).applyInArrow(_send_windows(width, buckets), RECORD_DOC)
    earlier = around.groupBy("bucket").applyInArrow(_earlier_elsewhere, RECORD)
    remove, schema = _remove(width)
    done = pages.groupBy("page").cogroup(earlier.groupBy("page")).applyInArrow(remove, schema)
    return done.withColumnRenamed("doc", id_col)
