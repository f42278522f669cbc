"""Quality classifier: logistic regression on hashed word n-grams, trained by FTRL-proximal.

Features are runs of one and two words and of one and two word shapes (letters, capitals and digits
stand for their kind, repeats are drawn together; a second word equal to the first is marked). Each
is hashed to one of 2**BITS places; its value is its share of the document's n-grams of that kind.
A score is a sparse dot product, so scoring is one pass without a shuffle.

The model is fitted on a bounded sample of labelled rows (``MAX_ROWS``, those with the smallest
hash of their id), dealt to a fixed number of parts that train side by side; their states are
averaged after each round. What is scored is never sampled.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import map_texts, mix
from tidemark.session import settle

BITS = 18
MAX_ROWS = 8000  # labelled rows that a model is fitted on, at most
PARTS = 8
ROUNDS, EPOCHS = 2, 2
ALPHA, BETA, L1, L2 = 0.5, 1.0, 1e-4, 1e-4
SCALE = 10.0
CACHED_WORDS = 300_000

_KINDS = [(regex.compile(p), s) for p, s in ((r"\p{Lu}+", "A"), (r"[\p{Ll}\p{Lo}\p{Lm}\p{M}]+", "a"), (r"\p{N}+", "9"), (r"(.)\1+", r"\1"))]


def shape(word: bytes) -> bytes:
    text = word.decode()
    for pattern, stand in _KINDS:
        text = pattern.sub(stand, text)
    return text[:12].encode()


class Words(dict):
    """Hashes of a word and of its shape, 16 bytes; a bounded number is remembered."""

    def __missing__(self, word: bytes) -> bytes:
        if len(self) >= CACHED_WORDS:
            self.clear()
        found = self[word] = xxhash.xxh3_64_digest(word) + xxhash.xxh3_64_digest(shape(word), 1)
        return found


def features(texts: list[bytes], known: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, place, value) of every n-gram of the texts, in order of documents within each kind."""
    split = [t.split() for t in texts]
    counts = np.array([len(w) for w in split])
    both = np.frombuffer(b"".join(map(known.__getitem__, (w for words in split for w in words))), ">u8").astype(np.uint64).reshape(-1, 2)
    doc = np.repeat(np.arange(len(texts)), counts)
    word, kind = np.ascontiguousarray(both[:, 0]), np.ascontiguousarray(both[:, 1])
    pair = doc[:-1] == doc[1:] if len(doc) else np.empty(0, bool)
    again = (word[:-1] == word[1:]).astype(np.uint64)[pair]
    c = np.uint64(0x9E3779B97F4A7C15)
    places = [word, mix(word[:-1][pair] * c + word[1:][pair]), mix(kind + np.uint64(1)), mix(kind[:-1][pair] * c + kind[1:][pair] + again)]
    owners = [doc, doc[:-1][pair], doc, doc[:-1][pair]]
    share = SCALE / 4 / np.maximum(np.stack([counts, counts - 1]), 1)
    values = [share[k % 2][o] for k, o in enumerate(owners)]
    return np.concatenate(owners), (np.concatenate(places) >> np.uint64(64 - BITS)).astype(np.int64), np.concatenate(values)


@dataclass
class Model:
    """Weights of the places and the bias (last)."""

    weights: np.ndarray

    def score(self, texts: list[bytes], known: Words) -> np.ndarray:
        doc, place, value = features(texts, known)
        margin = np.bincount(doc, weights=self.weights[place] * value, minlength=len(texts)) + self.weights[-1]
        return 1 / (1 + np.exp(-np.clip(margin, -500, 500)))


def _weights(z: np.ndarray, n: np.ndarray) -> np.ndarray:
    return np.where(np.abs(z) <= L1, 0.0, (np.sign(z) * L1 - z) / ((BETA + np.sqrt(n)) / ALPHA + L2))


def train_part(rows: list[tuple[np.ndarray, np.ndarray, float]], z: np.ndarray, n: np.ndarray, epochs: int = EPOCHS) -> None:
    """FTRL-proximal over rows (places, values, label), in their order; z and n change in place."""
    for _ in range(epochs):
        for at, x, y in rows:
            w = _weights(z[at], n[at])
            p = 1 / (1 + np.exp(-min(max(float(w @ x), -35.0), 35.0)))
            g = (p - y) * x
            more = n[at] + g * g
            z[at] += g - (np.sqrt(more) - np.sqrt(n[at])) / ALPHA * w
            n[at] = more


def _rows(docs: DataFrame) -> DataFrame:
    """Places and values of each labelled document, summed by place, as bytes."""
    fields = T.StructType([T.StructField("places", T.BinaryType()), T.StructField("values", T.BinaryType())])

    def build():
        known = Words()

        def run(texts: list[bytes]) -> list:
            doc, place, value = features(texts, known)
            key, inverse = np.unique(doc << BITS | place, return_inverse=True)
            total = np.bincount(inverse, weights=value, minlength=len(key)).astype("<f4")
            cuts = np.searchsorted(key >> BITS, np.arange(len(texts) + 1))
            places = (key & ((1 << BITS) - 1)).astype("<i4")
            spans = list(zip(cuts, cuts[1:]))
            return [[places[a:b].tobytes() for a, b in spans], [total[a:b].tobytes() for a, b in spans]]

        return run

    return map_texts(docs, "text", fields, build, ["part", "turn", "label"])


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_rows: int = MAX_ROWS) -> Model:
    """A model of the labels (0 or 1) of at most ``max_rows`` documents.

    Labels without an id or a value are not used; of several labels of an id the smallest counts.
    Without usable labels every score is 0.5.
    """
    spark = docs.sparkSession
    usable = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull())
    one = usable.groupBy(F.col(id_col).alias("own")).agg(F.min(label_col).cast("double").alias("label")).withColumn("turn", F.xxhash64("own"))
    sample = one.orderBy("turn", "own").limit(max_rows).withColumn("part", F.pmod(F.shiftright("turn", 8), F.lit(PARTS)).cast("int"))
    texts = docs.select(F.col(id_col).alias("doc"), F.col(text_col).cast("string").alias("text"))
    joined = texts.join(F.broadcast(sample), F.col("doc") == F.col("own"))  # at most max_rows short rows
    rows = settle(_rows(joined.select("part", "turn", "label", "text")), "features")
    size = (1 << BITS) + 1
    z, n = np.zeros(size), np.zeros(size)
    for _ in range(ROUNDS):
        shared = spark.sparkContext.broadcast((z, n))

        def fit(table: pa.Table) -> pa.Table:
            own_z, own_n = (a.copy() for a in shared.value)
            ordered = table.sort_by([("turn", "ascending"), ("label", "ascending")])
            examples = []
            for places, values, label in zip(*(ordered.column(c).to_pylist() for c in ("places", "values", "label"))):
                at = np.append(np.frombuffer(places, "<i4").astype(np.int64), size - 1)
                examples.append((at, np.append(np.frombuffer(values, "<f4").astype(np.float64), 1.0), label))
            train_part(examples, own_z, own_n)
            return pa.table([pa.array([len(examples)]), pa.array([own_z.tobytes()], pa.binary()), pa.array([own_n.tobytes()], pa.binary())], names=["rows", "z", "n"])

        states = rows.groupBy("part").applyInArrow(fit, "rows long, z binary, n binary").collect()  # PARTS rows
        total = sum(s["rows"] for s in states)
        if not total:
            break
        z, n = (sum(np.frombuffer(s[c]) * s["rows"] for s in states) / total for c in ("z", "n"))
    return Model(_weights(z, n))


def score(docs: DataFrame, model: Model, text_col: str = "text", score_col: str = "score", keep: list[str] | None = None) -> DataFrame:
    """Columns ``keep`` (default: all) and ``score_col``: probability of label 1 of each whole text.

    A null or empty text has the score of the bias alone. A column named like the score gives way.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model.weights)

    def build():
        own, known = Model(shared.value), Words()
        return lambda texts: [own.score(texts, known)]

    return map_texts(docs, text_col, T.StructType([T.StructField(score_col, T.DoubleType())]), build, keep)
