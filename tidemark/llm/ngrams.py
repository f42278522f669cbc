"""Words of whole texts as numpy arrays, hashes of word runs, counts of hashes, and a bounded membership filter.

A slice of texts is cut into words at once: byte classes mark blanks and breaks, and every word gets
a 64-bit hash from its bytes, eight at a time. Runs of words are hashed from the left, so the hash
of a run follows from that of the run without its last word and from that word.

Counts travel as packed columns: each task counts what it has seen, cuts the sorted hashes into
buckets of equal ranges and sends a row per bucket; one group adds the rows of a bucket. Hashes are
spread evenly, and a frequent one comes once per task, so no bucket is hot.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame

from tidemark.llm.common import mix, slices

SLICE_BYTES = 2 << 20
BUCKET_BYTES = 16 << 20  # of text per bucket of counts
HELD = 1 << 20  # hashes that a task gathers before it sends them
#: A longer word is hashed on its own.
LONG_WORD = 256
BLOCK_BITS = 19  # bits of a filter that are set in one group
LEAST_BITS, MOST_BITS = 20, 28  # a filter has 32 MB at most
BITS_PER_KEY = 4  # of the proven number of keys at most, which real texts never come near

_FOLD = bytes(k + 32 if 65 <= k < 91 else k for k in range(256))
_STEP = np.uint64(0x9E3779B97F4A7C15)
_MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


@dataclass
class Words:
    """Words of some texts in order: where they lie in ``body`` (A-Z lower-cased), text and piece numbers, hashes."""

    body: np.ndarray
    start: np.ndarray
    end: np.ndarray
    text: np.ndarray
    piece: np.ndarray
    hashes: np.ndarray

    def spelt(self, at: np.ndarray, width: int) -> list[bytes]:
        """The ``width`` words from each of the positions on, joined by one space."""
        joined, first, last = self.body.tobytes(), self.start[at], self.end[at + width - 1]
        runs = [joined[a:b] for a, b in zip(first.tolist(), last.tolist())]
        return runs if width == 1 else [b" ".join(r.split()) for r in runs]


def _hash(body: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each stretch."""
    size = end - start
    out = mix(size.astype(np.uint64) * _STEP)
    padded = np.concatenate([body, np.zeros(8, np.uint8)])
    eight = np.ndarray(len(body) + 1, "<u8", padded, strides=(1,))  # the eight bytes from each place on
    at = np.flatnonzero(size <= LONG_WORD) if len(size) and size.max() > LONG_WORD else np.arange(len(size))
    done = 0
    while len(at):
        left = size[at] - done
        out[at] = mix(out[at] * _STEP + (eight[start[at] + done] & _MASKS[np.minimum(left, 8)]))
        done += 8
        at = at[left > 8]
    for k in np.flatnonzero(size > LONG_WORD):
        out[k] = xxhash.xxh3_64_intdigest(body[start[k] : end[k]].tobytes())
    return out


def words_of(texts: list[bytes], blanks: bytes, breaks: bytes) -> Words:
    """Words (runs of bytes that are neither blanks nor breaks) of the texts; pieces end at breaks. A line feed is one or the other."""
    joined = b"\n".join(texts)
    table = bytes(2 if k in breaks else 1 if k in blanks else 0 for k in range(256))
    kind = np.frombuffer(joined.translate(table), np.uint8)
    outside = np.ones(len(kind) + 2, bool)
    outside[1:-1] = kind > 0
    edges = np.flatnonzero(outside[1:] != outside[:-1])
    start, end = edges[::2], edges[1::2]
    body = np.frombuffer(joined.translate(_FOLD), np.uint8)
    offsets = np.cumsum([0] + [len(t) + 1 for t in texts])
    text = np.repeat(np.arange(len(texts)), np.diff(np.searchsorted(start, offsets)))
    cuts = np.searchsorted(start, np.flatnonzero(kind == 2)) if breaks else np.empty(0, np.int64)
    piece = np.cumsum(np.bincount(cuts, minlength=len(start) + 1))[: len(start)] if breaks else text
    return Words(body, start, end, text, piece, _hash(body, start, end))


def longer(run: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Hash of a run of words followed by a word."""
    return mix(run * _STEP + word)


def pack(numbers: np.ndarray) -> bytes:
    """Numbers as compressed bytes, the first byte of all, the second of all, and so on."""
    return zstandard.compress(np.ascontiguousarray(numbers.view(np.uint8).reshape(len(numbers), numbers.itemsize).T).tobytes(), 1)


def unpack(packed: bytes, kind: str) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(zstandard.decompress(packed), np.uint8).reshape(size, -1).T).view(kind).ravel()


def pack_sorted(keys: np.ndarray) -> bytes:
    """Sorted keys as their packed differences."""
    return pack(np.diff(keys, prepend=np.zeros(1, keys.dtype)))


def unpack_sorted(packed: bytes) -> np.ndarray:
    return np.cumsum(unpack(packed, "<u8"))


def heads(ordered: np.ndarray) -> np.ndarray:
    """Where runs of equal values begin."""
    return np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]])) if len(ordered) else np.empty(0, np.int64)


def distinct(keys: np.ndarray) -> np.ndarray:
    """Sorted distinct keys."""
    ordered = np.sort(keys)
    return ordered[heads(ordered)]


def tally(keys: np.ndarray, n: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys and their sums (of ones, if no numbers are given)."""
    if n is None:
        ordered = np.sort(keys)
        at = heads(ordered)
        return ordered[at], np.diff(at, append=len(ordered))
    order = np.argsort(keys)
    ordered = keys[order]
    at = heads(ordered)
    return ordered[at], np.add.reduceat(n[order], at) if len(at) else n[:0]


def bucket_of(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Number of each key's range."""
    return (keys >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)


def ranges(keys: np.ndarray, buckets: int) -> list[tuple[int, int, int]]:
    """(bucket, first, last) of sorted keys."""
    bucket = bucket_of(keys, buckets)
    at = heads(bucket)
    return list(zip(bucket[at].tolist(), at.tolist(), [*at[1:].tolist(), len(keys)]))


PACKED = "bucket int, keys binary, n binary"


def count_keys(texts: DataFrame, buckets: int, build: Callable[[], Callable[[pa.RecordBatch, int, list[bytes]], Iterator[np.ndarray]]]) -> DataFrame:
    """Counts per task and bucket, packed, of the keys that a function takes from slices of texts.

    The texts are the column ``text``. ``build()`` is called once per task; its result gets the batch,
    the slice's first row in it and the texts of the slice.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        take, parts, size = build(), [], 0
        for batch in batches:
            for first, part in slices(batch.column("text"), SLICE_BYTES):
                for keys in take(batch, first, part):
                    parts.append(tally(keys))
                    size += len(parts[-1][0])
                if size >= HELD:
                    parts = [tally(*map(np.concatenate, zip(*parts)))]
                    size = len(parts[0][0])
                    if size >= HELD // 2:
                        yield packed(*parts[0])
                        parts, size = [], 0
        if size:
            yield packed(*tally(*map(np.concatenate, zip(*parts))))

    def packed(keys: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        cut = ranges(keys, buckets)
        columns = [[b for b, _, _ in cut], [pack_sorted(keys[x:y]) for _, x, y in cut], [pack(n[x:y].astype("<u4")) for _, x, y in cut]]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.binary(), pa.binary()))], names=["bucket", "keys", "n"])

    return texts.mapInArrow(run, PACKED)


def added(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Keys and counts of the packed rows of a bucket."""
    parts = [(unpack_sorted(k), unpack(n, "<u4").astype(np.int64)) for k, n in zip(table.column("keys").to_pylist(), table.column("n").to_pylist())]
    return tally(*map(np.concatenate, zip(*parts))) if parts else (np.empty(0, np.uint64), np.empty(0, np.int64))


def buckets_for(size: int) -> int:
    """Buckets for so many bytes of text."""
    return max(1, -(-size // BUCKET_BYTES))


def room(keys: float) -> int:
    """Bits (as a power of two) of a filter for so many keys."""
    return min(MOST_BITS, max(LEAST_BITS, int(np.ceil(np.log2(max(keys, 1) * BITS_PER_KEY)))))


class Filter:
    """Membership of 64-bit keys with false positives and no false negatives; two bits per key. The last three bits of a key do not matter."""

    def __init__(self, bits: int):
        self.bits = bits
        self.words = np.zeros(1 << (bits - 6), np.uint64)

    def holds(self, keys: np.ndarray) -> np.ndarray:
        found = np.ones(len(keys), bool)
        for place in (keys >> np.uint64(3) & np.uint64((1 << self.bits) - 1), keys >> np.uint64(64 - self.bits)):
            found &= (self.words[(place >> np.uint64(6)).astype(np.int64)] >> (place & np.uint64(63)) & np.uint64(1)).astype(bool)
        return found

    def with_keys(self, keys: DataFrame, key: str = "key") -> Filter:
        """A filter that holds the keys of a table (a long column) as well.

        Each task sends the places of its keys sorted and packed, per group of 64 KB in which bits are
        set; what comes to the driver is as large as the filter at most.
        """
        bits, inside = self.bits, np.uint64((1 << BLOCK_BITS) - 1)

        def packed(parts: list[np.ndarray]) -> pa.RecordBatch:
            place = distinct(np.concatenate(parts))
            block, bit = (place >> np.uint64(BLOCK_BITS)).astype(np.int32), (place & inside).astype("<u4")
            at = heads(block)
            bodies = [pack_sorted(bit[x:y]) for x, y in zip(at, [*at[1:], len(bit)])]
            return pa.RecordBatch.from_arrays([pa.array(block[at]), pa.array(bodies, pa.binary())], names=["block", "bits"])

        def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            parts, size = [], 0
            for batch in batches:
                own = batch.column(0).to_numpy().view(np.uint64)
                parts += [own >> np.uint64(3) & np.uint64((1 << bits) - 1), own >> np.uint64(64 - bits)]
                size += 2 * len(own)
                if size >= HELD:
                    yield packed(parts)
                    parts, size = [], 0
            if size:
                yield packed(parts)

        def fill(table: pa.Table) -> pa.Table:
            flags = np.zeros(1 << BLOCK_BITS, bool)
            for body in table.column("bits").to_pylist():
                flags[np.cumsum(unpack(body, "<u4"))] = True
            return pa.table({"block": table.column("block").slice(0, 1), "body": pa.array([np.packbits(flags, bitorder="little").tobytes()], pa.binary())})

        wider = Filter(self.bits)
        wider.words |= self.words
        for row in keys.select(key).mapInArrow(places, "block int, bits binary").groupBy("block").applyInArrow(fill, "block int, body binary").collect():
            part = np.frombuffer(row["body"], "<u8")
            wider.words[row["block"] * len(part) : (row["block"] + 1) * len(part)] |= part
        return wider
