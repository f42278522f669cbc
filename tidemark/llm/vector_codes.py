"""Vector codes by product quantisation in whole numbers, with pivots that save distances.

A vector is cut into equal parts; each part is coded by its nearest entry of the codebook of its
position. Codebooks are refined by rounds of assignment and averaging. The distances of every part
to a few fixed pivots are computed once and stored with it (LAESA). In a round the pivots' distances
to the entries give lower bounds by the triangle inequality: entries are tried in the order of
their bounds, and a part is done when its next bound exceeds the best exact distance. Distances are
squared and exact in 64-bit integers; bounds are lowered by more than their rounding, so the codes
are those of a full search.

Vectors stay where they lie: a round sends sums per position and entry only.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.operators.combine import join_groups
from tidemark.session import settle

PIVOTS = 4
ROWS = 4096  # vectors that are coded at a time
#: Components beyond this have distances that may pass 64 bits.
LIMIT = 1 << 27
#: More than the relative rounding of a stored (32-bit) distance.
SLACK = 2.0**-21
NEAR = 1 + 1e-9


def usable(vectors: DataFrame, vec_col: str) -> DataFrame:
    """Rows whose vector has numbers throughout."""
    fine = F.forall(F.col(vec_col), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vectors.where(F.col(vec_col).isNotNull() & fine)


def farthest(entries: np.ndarray, pivots: int) -> np.ndarray:
    """Entries that lie far from each other: the first, then always the one farthest from those taken."""
    taken = [0]
    gaps = ((entries - entries[0]) ** 2).sum(axis=1)
    while len(taken) < min(pivots, len(entries)):
        taken.append(int(gaps.argmax()))
        gaps = np.minimum(gaps, ((entries - entries[taken[-1]]) ** 2).sum(axis=1))
    return entries[taken]


def distances(parts: np.ndarray, points: np.ndarray) -> np.ndarray:
    """Euclidean distance of each part to each point."""
    gaps = parts[:, None, :] - points[None, :, :]
    return np.sqrt((gaps * gaps).sum(axis=2).astype(np.float64))


def nearest(parts: np.ndarray, book: np.ndarray, to_pivots: np.ndarray, between: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Nearest entry (ties: lower index) of each part, its squared distance, and the number of exact distances.

    ``to_pivots`` are the stored distances of the parts, ``between`` those of pivots and entries.
    """
    near, far = to_pivots[:, :, None].astype(np.float64), between[None]
    low = np.maximum((np.abs(near - far) - (near + far) * SLACK).max(axis=1), 0)
    order = np.argsort(low, axis=1, kind="stable")
    best, code = np.full(len(parts), np.iinfo(np.int64).max), np.zeros(len(parts), np.int64)
    still, tried = np.arange(len(parts)), 0
    for k in range(len(book)):
        entry = order[still, k]
        if k:
            wanted = low[still, entry] ** 2 <= best[still] * NEAR
            still, entry = still[wanted], entry[wanted]
        if not len(still):
            break
        tried += len(still)
        gap = parts[still] - book[entry]
        squared = (gap * gap).sum(axis=1)
        better = (squared < best[still]) | (squared == best[still]) & (entry < code[still])
        best[still[better]], code[still[better]] = squared[better], entry[better]
    return code, best, tried


class Coder:
    """Codebooks (positions, entries, width) in whole numbers, and the pivots of each position."""

    def __init__(self, books: np.ndarray, pivots: list[np.ndarray]):
        self.books, self.pivots = books, pivots
        self.between = [distances(p, b) for p, b in zip(pivots, books)]

    def pivot_distances(self, vectors: np.ndarray) -> np.ndarray:
        """Distances of every part to the pivots of its position, in a row per vector."""
        parts = vectors.reshape(len(vectors), *self.books.shape[::2])
        return np.concatenate([distances(parts[:, p], own) for p, own in enumerate(self.pivots)], axis=1).astype("<f4")

    def codes(self, vectors: np.ndarray, to_pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index of the entry, squared distance) per vector and position."""
        parts = vectors.reshape(len(vectors), *self.books.shape[::2])
        stored = to_pivots.reshape(len(vectors), len(self.books), -1)
        found = [nearest(parts[:, p], book, stored[:, p], self.between[p])[:2] for p, book in enumerate(self.books)]
        return np.stack([c for c, _ in found], axis=1), np.stack([e for _, e in found], axis=1)

    def digest(self) -> str:
        """SHA-256 of all components, by position, entry and place, in decimal and joined by commas."""
        return hashlib.sha256(",".join(map(str, self.books.ravel().tolist())).encode()).hexdigest()


def _whole(column: pa.Array, scale: int) -> np.ndarray:
    rows = np.array(column.to_pylist(), np.float64).reshape(len(column), -1)
    numbers = np.floor(rows * scale)
    if numbers.size and np.abs(numbers).max() >= LIMIT:
        raise ValueError(f"a component reaches {LIMIT / scale:g}; squared distances of such vectors pass 64 bits")
    return numbers.astype(np.int64)


def _blocks(batch: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of a batch with their vectors and pivot distances."""
    for k in range(0, batch.num_rows, ROWS):
        part = batch.slice(k, ROWS)
        raw = [np.frombuffer(b"".join(part.column(c).to_pylist()), kind).reshape(part.num_rows, -1) for c, kind in (("body", "<i4"), ("to_pivots", "<f4"))]
        yield part, raw[0].astype(np.int64), raw[1]


def _refined(stored: DataFrame, coder: Coder) -> np.ndarray:
    """Books after a round: each entry becomes the mean of its parts, rounded down; unused ones stay."""
    positions, entries, width = coder.books.shape
    shared = stored.sparkSession.sparkContext.broadcast(coder)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        total = np.zeros((positions, entries, width + 1), np.int64)
        for batch in batches:
            for _, vectors, to_pivots in _blocks(batch):
                codes, _ = own.codes(vectors, to_pivots)
                parts = vectors.reshape(len(vectors), positions, width)
                for p in range(positions):
                    np.add.at(total[p], codes[:, p], np.concatenate([parts[:, p], np.ones((len(parts), 1), np.int64)], axis=1))
        used = np.flatnonzero(np.repeat(total[:, :, -1].ravel() > 0, width + 1))
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(total.ravel()[used])], names=["cell", "amount"])

    sent = stored.select("body", "to_pivots").mapInArrow(sums, "cell int, amount long").groupBy("cell").agg(F.sum("amount").alias("amount"))
    total = np.zeros(positions * entries * (width + 1), np.int64)
    for row in sent.collect():  # positions * entries * (width + 1) rows at most
        total[row["cell"]] = row["amount"]
    total = total.reshape(positions, entries, width + 1)
    count = total[:, :, -1:]
    return np.where(count > 0, total[:, :, :-1] // np.maximum(count, 1), coder.books)


def vector_codes(
    vectors: DataFrame,
    id_col: str = "vec_id",
    vec_col: str = "embedding",
    label_col: str = "label",
    positions: int = 8,
    entries: int = 16,
    rounds: int = 6,
    scale: int = 4096,
    pivots: int = PIVOTS,
) -> DataFrame:
    """id, ``code`` (two hex digits per part), ``error``, ``label_error`` and ``codebooks_sha256`` of every usable vector.

    Rows whose vector is null or holds null or non-finite components go. A component x counts as
    floor(scale * x). The first codebooks are the parts of the vectors with the smallest ids (null
    ids last; equal ids by their components); with fewer vectors than ``entries`` there are so many
    entries. Vectors must be of one length to be comparable: rows of another than the most frequent
    usable length (ties: the longest; a length that ``positions`` does not divide is not usable) go.
    Components of ``LIMIT`` / ``scale`` or more raise an error. ``label_error`` is the sum over equal labels, nulls
    together. Repeated rows count each. No usable rows, no rows. Other columns are not read.
    """
    spark = vectors.sparkSession
    rows = usable(vectors.select(F.col(id_col).alias("vec"), F.col(vec_col).cast("array<double>").alias("vector"), F.col(label_col).alias("label")), "vector")
    out = T.StructType([T.StructField(id_col, vectors.schema[id_col].dataType)])
    out.add("code", "string").add("error", "long").add("label_error", "long").add("codebooks_sha256", "string")
    sizes = rows.groupBy(F.size("vector").alias("size")).count().where((F.col("size") > 0) & (F.col("size") % positions == 0))
    usual = sizes.orderBy(F.desc("count"), F.desc("size")).first()
    if usual is None:
        return spark.createDataFrame([], out)
    rows = rows.where(F.size("vector") == usual["size"])
    firsts = rows.orderBy(F.col("vec").asc_nulls_last(), "vector").select("vector").limit(entries).toArrow().column("vector").combine_chunks()
    books = _whole(firsts, scale).reshape(len(firsts), positions, -1).transpose(1, 0, 2)
    fixed = [farthest(b, pivots) for b in books]
    first = spark.sparkContext.broadcast(Coder(books, fixed))

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, ROWS):
                part = batch.slice(k, ROWS)
                whole = _whole(part.column("vector"), scale)
                measured = first.value.pivot_distances(whole)
                body = [pa.array([r.tobytes() for r in a], pa.binary()) for a in (whole.astype("<i4"), measured)]
                yield pa.RecordBatch.from_arrays([part.column("vec"), part.column("label"), *body], names=["vec", "label", "body", "to_pivots"])

    schema = T.StructType([rows.schema["vec"], rows.schema["label"]]).add("body", "binary").add("to_pivots", "binary")
    stored = settle(rows.mapInArrow(store, schema), "vectors")
    for _ in range(rounds):
        books = _refined(stored, Coder(books, fixed))
    last = Coder(books, fixed)
    shared = spark.sparkContext.broadcast(last)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, whole, to_pivots in _blocks(batch):
                codes, errors = shared.value.codes(whole, to_pivots)
                text = [bytes(c).hex() for c in codes.astype(np.uint8)]
                yield pa.RecordBatch.from_arrays([part.column("vec"), part.column("label"), pa.array(text), pa.array(errors.sum(axis=1))], names=["vec", "label", "code", "error"])

    coded = settle(stored.mapInArrow(write, T.StructType(schema.fields[:2]).add("code", "string").add("error", "long")), "codes")
    by_label = settle(coded.groupBy("label").agg(F.sum("error").alias("label_error")), "label_errors")
    joined = join_groups(coded, by_label, ["label"])
    return joined.select(F.col("vec").alias(id_col), "code", "error", "label_error", F.lit(last.digest()).alias("codebooks_sha256"))
