"""Near-duplicate vectors by cross-polytope hashing.

A vector is rotated by three rounds of random signs and fast Hadamard transforms; its hash is the
coordinate of largest size with its sign, several such coordinates in a row per table. Each table
also probes the buckets that follow from taking the second largest coordinate once. Vectors that
meet in a bucket are compared exactly; a pair that meets several times counts where it meets first.
Only sums per vector and a spanning set of links leave a block, never all its pairs.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import mix
from tidemark.llm.components import components
from tidemark.session import settle

MISS = 1e-6
BLOCK = 512  # vectors of a bucket in a block
GROUP_ROWS = 4000
SEED = 10


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of the rows; their length is a power of two."""
    n, d = x.shape
    step = 1
    while step < d:
        x = x.reshape(n, d // (2 * step), 2, step)
        x = np.stack([x[:, :, 0] + x[:, :, 1], x[:, :, 0] - x[:, :, 1]], axis=2)
        step *= 2
    return x.reshape(n, d) / math.sqrt(d)


def buckets(vectors: np.ndarray, tables: int, polytopes: int) -> np.ndarray:
    """Bucket numbers of each row: of every table its own and one probe per polytope."""
    n, d = vectors.shape
    size = 1 << max(0, (d - 1).bit_length())
    padded = np.zeros((n, size))
    padded[:, :d] = vectors
    out = []
    for t in range(tables):
        first, second = [], []
        for k in range(polytopes):
            signs = np.random.default_rng([SEED, t, k]).choice([-1.0, 1.0], (3, size))
            turned = padded
            for s in signs:
                turned = hadamard(turned * s)
            strength = np.abs(turned)
            best = strength.argmax(axis=1)
            rows = np.arange(n)
            first.append(2 * best + (turned[rows, best] < 0))
            strength[rows, best] = -1
            best = strength.argmax(axis=1)
            second.append(2 * best + (turned[rows, best] < 0))
        for probe in range(polytopes + 1):
            code = np.full(n, t + 1, np.uint64)
            for k in range(polytopes):
                code = mix(code * np.uint64(0x9E3779B97F4A7C15) + (second if k + 1 == probe else first)[k].astype(np.uint64))
            out.append(code)
    return np.stack(out, axis=1).astype(np.int64)


def polytopes_for(vectors: int, dim: int) -> int:
    """Coordinates per table so that a bucket's share follows the number of vectors."""
    return max(1, round(math.log(max(vectors, 2)) / math.log(2 * max(dim, 2))))


def tables_for(dim: int, polytopes: int, cosine: float, trials: int = 2000) -> int:
    """Tables with which a pair at this cosine is missed with probability MISS, by simulation."""
    rng = np.random.default_rng(SEED)
    x = rng.normal(size=(trials, dim))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    z = rng.normal(size=(trials, dim))
    z -= (z * x).sum(axis=1, keepdims=True) * x
    z /= np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-12)
    y = cosine * x + math.sqrt(1 - cosine**2) * z
    a, b = buckets(x, 2, polytopes), buckets(y, 2, polytopes)
    wide = polytopes + 1
    met = np.mean([(a[:, t * wide : (t + 1) * wide, None] == b[:, None, t * wide : (t + 1) * wide]).any(axis=(1, 2)).mean() for t in range(2)])
    return max(2, math.ceil(math.log(MISS) / math.log(1 - min(max(met, 0.01), 0.999))))


def _usable(x: list | None) -> np.ndarray | None:
    """The vector in double precision, or None if it is null, empty, zero or not finite throughout."""
    if not x or None in x:
        return None
    v = np.array(x, np.float64)
    return v if np.isfinite(v).all() and v.any() else None


def _classes(vec_type: T.DataType):
    """Marks each vector with the hash of its contents; null where it links with nothing."""

    def run(batches):
        for batch in batches:
            marks, dims, raw = [], [], []
            for x, label in zip(batch.column("vector").to_pylist(), batch.column("label").to_pylist()):
                v = None if label is None else _usable(x)
                body = None if v is None else v.tobytes()
                marks.append(None if v is None else xxhash.xxh3_128_digest(body + b"|" + str(label).encode()))
                dims.append(None if v is None else len(v))
                raw.append(body)
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec"), batch.column("label"), pa.array(marks, pa.binary()), pa.array(dims, pa.int32()), pa.array(raw, pa.binary())], names=["vec", "label", "node", "dim", "body"]
            )

    return run


def _hashed(tables: dict[int, tuple[int, int]]):
    def run(batches):
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            codes: list = [None] * len(dims)
            for dim in np.unique(dims):
                at = np.flatnonzero(dims == dim)
                rows = np.frombuffer(b"".join(batch.column("body").take(pa.array(at)).to_pylist()), np.float64).reshape(-1, dim)
                found = buckets(rows / np.linalg.norm(rows, axis=1, keepdims=True), *tables[int(dim)])
                for k, row in zip(at, found):
                    codes[k] = np.unique(row)
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(codes, pa.list_(pa.int64()))], names=["node", "codes"])

    return run


def _first_common(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest bucket number that rows of a and b share."""
    top = np.iinfo(np.int64).max
    return np.where((a[:, :, None] == b[:, None, :]).any(axis=2), a, top).min(axis=1)


def _block(left: np.ndarray, right: np.ndarray, code: int, unit: np.ndarray, codes: np.ndarray, weight: np.ndarray, limit: float):
    """(row, None, vectors it is linked with) and (row, row, 0): links that keep the block's components together.

    ``left`` and ``right`` are the rows of the two blocks (the same ones for a block with itself).
    """
    near = unit[left] @ unit[right].T >= limit
    x, y = np.nonzero(np.triu(near, 1) if left is right else near)
    x, y = left[x], right[y]
    if not len(x):
        return
    own = np.concatenate([_first_common(codes[x[s : s + 2048]], codes[y[s : s + 2048]]) == code for s in range(0, len(x), 2048)])
    x, y = x[own], y[own]
    if not len(x):
        return
    for a, b in ((x, y), (y, x)):
        total = np.bincount(a, weights=weight[b])
        for k in np.flatnonzero(total):
            yield int(k), None, int(total[k])
    label = np.arange(len(unit))
    while True:
        least = label.copy()
        np.minimum.at(least, x, label[y])
        np.minimum.at(least, y, label[x])
        least = least[least]
        if (least == label).all():
            break
        label = least
    for k in np.unique(np.concatenate([x, y])):
        if label[k] != k:
            yield int(k), int(label[k]), 0


def _compare(cosine: float):
    def run(table: pa.Table) -> pa.Table:
        node = table.column("node").to_pylist()
        keys = list(zip(*(table.column(c).to_pylist() for c in ("label", "dim", "code", "i", "j"))))
        block = np.array(table.column("block").to_pylist())
        body = table.column("body").to_pylist()
        known = [np.array(c) for c in table.column("codes").to_pylist()]
        wide = max(map(len, known), default=0)
        codes = np.array([np.pad(c, (0, wide - len(c)), mode="edge") for c in known])
        weight = table.column("weight").to_numpy()
        members: dict[tuple, list[int]] = {}
        for k, key in enumerate(keys):
            members.setdefault(key, []).append(k)
        a, b, links = [], [], []
        for (_, _, code, i, j), rows in members.items():
            rows_at = np.array(rows)
            unit = np.frombuffer(b"".join(body[k] for k in rows), np.float64).reshape(len(rows), -1)
            unit = unit / np.linalg.norm(unit, axis=1, keepdims=True)
            left = np.flatnonzero(block[rows_at] == i)
            right = left if i == j else np.flatnonzero(block[rows_at] == j)
            for x, y, count in _block(left, right, code, unit, codes[rows_at], weight[rows_at].astype(np.float64), cosine):
                a.append(node[rows[x]])
                b.append(None if y is None else node[rows[y]])
                links.append(count)
        return pa.table([pa.array(a, pa.binary()), pa.array(b, pa.binary()), pa.array(links, pa.int64())], names=["a", "b", "links"])

    return run


def near_vectors(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", cosine: float = 0.93) -> DataFrame:
    """Per row its id (long), ``n_links``, ``component_id`` and ``kept``.

    Vectors of one label and length are linked at this cosine or more. Equal vectors form a class
    and are compared once; each links with the others of its class. Vectors that are null, empty,
    zero or hold null or non-finite components, and those without a label, link with nothing. A
    null id is never the smallest: where no vector of a group has an id, ``component_id`` is null
    and all are kept. Repeated rows count as vectors of their own. Other columns are not read.
    """
    spark = df.sparkSession
    source = df.select(F.col(id_col).cast("long").alias("vec"), F.col(label_col).cast("string").alias("label"), F.col(vector_col).alias("vector"))
    marked = settle(source.mapInArrow(_classes(source.schema["vector"].dataType), "vec long, label string, node binary, dim int, body binary"), "vectors")
    classes = settle(
        marked.where("node IS NOT NULL").groupBy("node").agg(F.count("*").alias("weight"), F.min("vec").alias("least"), F.first("label").alias("label"), F.first("dim").alias("dim"), F.first("body").alias("body")),
        "classes",
    )
    sizes = {r["dim"]: r["n"] for r in classes.groupBy("dim").agg(F.count("*").alias("n")).collect()}  # one row per vector length
    setup = {}
    for dim, n in sizes.items():
        k = polytopes_for(n, dim)
        setup[dim] = (tables_for(dim, k, cosine), k)
    hashed = settle(classes.select("node", "dim", "body").mapInArrow(_hashed(setup), "node binary, codes array<long>"), "hashed")
    coded = hashed.join(classes.select("node", "label", "dim"), "node").select("label", "dim", "node", F.explode("codes").alias("code"))
    busy = coded.groupBy("label", "dim", "code").agg(F.count("*").alias("members")).where("members > 1")
    parts = F.ceil(F.col("members") / BLOCK).cast("int")
    met = (
        coded.join(busy, ["label", "dim", "code"])
        .withColumn("blocks", parts)
        .withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select("label", "dim", "code", "node", "block", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))
    )
    met = settle(met, "met")
    groups = max(2 * int(spark.conf.get("spark.sql.shuffle.partitions")), met.count() // GROUP_ROWS)
    full = met.join(classes.select("node", "body", "weight"), "node").join(hashed, "node")
    dealt = full.withColumn("group", F.pmod(F.xxhash64("label", "dim", "code", "i", "j"), F.lit(groups)))
    found = settle(dealt.groupBy("group").applyInArrow(_compare(cosine), "a binary, b binary, links long"), "links")
    counts = found.groupBy(F.col("a").alias("node")).agg(F.sum("links").alias("links"))
    roots = components(found.where("b IS NOT NULL").select("a", "b"))
    own = classes.select("node", "weight", "least").join(roots, "node", "left").join(counts, "node", "left").withColumn("root", F.coalesce("root", "node"))
    smallest = own.groupBy("root").agg(F.min("least").alias("component_id"))
    known = own.join(smallest, "root").select("node", "component_id", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"))
    done = marked.select("vec", "node").join(known, "node", "left")
    component = F.when(F.col("node").isNull(), F.col("vec")).otherwise(F.col("component_id"))
    return done.select(F.col("vec").alias(id_col), F.coalesce("n_links", F.lit(0)).alias("n_links"), component.alias("component_id"), F.col("vec").eqNullSafe(component).alias("kept"))
