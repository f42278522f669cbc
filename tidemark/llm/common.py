"""Shared helpers: Arrow batches of texts, words and their hashes, 64-bit mixing in numpy.

A word is a run of bytes other than the six ASCII blanks (space and 0x09-0x0D); that is exactly
what ``bytes.split()`` returns, and it never cuts a UTF-8 character.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: Texts are handed to Python code in slices of about so many bytes, so memory follows neither
#: the Arrow batch size nor the size of the other texts. A longer text is a slice of its own.
SLICE_BYTES = 4 << 20
#: A byte of a word, as a pattern for Spark.
WORD = r"[^\x20\x09-\x0D]"


def texts_of(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of each text; null counts as empty."""
    filled = pc.fill_null(column, "") if column.null_count else column
    return filled.cast(pa.large_binary()).to_pylist()


def slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, list[bytes]]]:
    """(first row, texts) of consecutive slices of about ``limit`` bytes, at least one row each. Only the texts of one slice are copied at a time."""
    sizes = pc.fill_null(pc.binary_length(column), 0).to_pylist()
    first, size = 0, 0
    for k, n in enumerate(sizes):
        if k > first and size + n > limit:
            yield first, texts_of(column.slice(first, k - first))
            first, size = k, 0
        size += n
    if sizes:
        yield first, texts_of(column.slice(first))


def map_texts(
    df: DataFrame,
    text_col: str,
    fields: T.StructType,
    build: Callable[[], Callable[[list[bytes]], list]],
    keep: list[str] | None = None,
) -> DataFrame:
    """Columns ``keep`` (default: all) and one new column per field, computed from whole texts.

    ``build()`` is called once per task and returns a function from the texts of a slice to one
    Arrow array, numpy array or list per field. A kept column with the name of a field gives way
    to it.
    """
    names = fields.fieldNames()
    kept = [c for c in (df.columns if keep is None else keep) if c not in names]
    schema = T.StructType([df.schema[c] for c in kept] + list(fields.fields))
    arrow = to_arrow_schema(schema)
    types = [arrow.field(n).type for n in names]
    text = "__text"
    while text in kept:
        text += "_"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compute = build()
        for batch in batches:
            for first, texts in slices(batch.column(len(kept))):
                made = [a if isinstance(a, pa.Array) else pa.array(a, t) for a, t in zip(compute(texts), types)]
                part = batch.slice(first, len(texts))
                old = [part.column(k).cast(arrow.field(k).type) for k in range(len(kept))]
                yield pa.RecordBatch.from_arrays(old + made, schema=arrow)

    source = df.select(*[df[f"`{c}`"] for c in kept], df[f"`{text_col}`"].cast("string").alias(text))
    return source.mapInArrow(run, schema)


def shadowed(df: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """The table under names of our own, all renamed at once, and the name that each column got."""
    names = {c: f"__in{k}" for k, c in enumerate(df.columns)}
    return df.select(*[df[f"`{c}`"].alias(n) for c, n in names.items()]), names


def hash_words(words: list[bytes]) -> np.ndarray:
    """A 64-bit hash of each word."""
    return np.frombuffer(b"".join(map(xxhash.xxh3_64_digest, words)), ">u8").astype(np.uint64)


def odd_constants(n: int, seed: int) -> np.ndarray:
    """n odd 64-bit numbers that follow from the seed."""
    return np.frombuffer(b"".join(xxhash.xxh3_64_digest(b"%d:%d" % (seed, k)) for k in range(n)), ">u8").astype(np.uint64) | np.uint64(1)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers whose outputs look random (multiply and xor-shift rounds)."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


def windows(hashes: np.ndarray, width: int, seed: int = 1) -> np.ndarray:
    """A 64-bit hash of every run of ``width`` consecutive words (empty if there are fewer)."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    total = np.zeros(n, np.uint64)
    for k, c in enumerate(odd_constants(width, seed)):
        total += hashes[k : k + n] * c
    return mix(total)
