"""Near-duplicate texts by SetSketch registers.

A text is the set of its shingles. Each shingle throws points of a Poisson process on registers; a
register keeps the smallest point, truncated to a power of a base close to 1. Such registers merge
by maximum and are equal in two sketches with about the sets' Jaccard similarity.

1. Texts with the same set form one class. One sketch per class.
2. Bands of registers are hashed. The smallest class of each band bucket is its hub, and every
   member is compared with its hubs: first by the likelihood of the two sketches, then on full sets.
3. Links are contracted to components. Among the members of a hub that still belong to several
   components, those that the likelihood puts near a member of another one are compared with each
   other on full sets, in blocks, and links between components are kept. So no link is lost to the
   choice of hubs, and what leaves a block is never more than its members.

The number of bands follows from the threshold: a pair at the threshold shares no bucket with a
probability below ``MISS``, and the likelihood drops it with a probability below ``MISS``. Blocks bound what a task holds, however large a bucket is.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import WORD, hash_words, map_texts, mix, shadowed, texts_of, windows
from tidemark.llm.components import components
from tidemark.session import settle

BASE = 1.001
RATE = 20.0
TOP = 65535
ROWS = 5  # registers in a band
MISS = 1e-8
BLOCK = 512  # members of a hub in a block
GROUP_PAIRS = 1000
GROUP_ROWS = 4000
CHUNK = 8192  # pairs whose likelihood is worked out at once


def bands_for(similarity: float) -> int:
    """Bands of ROWS registers with which a pair of this similarity is missed with probability MISS."""
    return math.ceil(math.log(MISS) / math.log1p(-(similarity**ROWS)))


def shingles(text: bytes, width: int) -> np.ndarray:
    """Distinct 64-bit hashes of the runs of ``width`` words, ASCII lower case; a shorter text is one run."""
    words = text.lower().split()
    if not words:
        return np.empty(0, np.uint64)
    return np.unique(windows(hash_words(words), min(width, len(words))))


def fingerprint(found: np.ndarray) -> bytes:
    """128 bits that stand for a set."""
    return xxhash.xxh3_128_digest(found.tobytes())


def sketch(sets: list[np.ndarray], size: int) -> np.ndarray:
    """Registers (one row of ``size`` per set, 16 bits); those of an empty set are 0.

    All sets advance together, one point of each element a round; an element is done when its
    point lies beyond all its set's registers.
    """
    n = len(sets)
    least = np.full(n * size, np.inf)
    element = np.concatenate(sets) if n else np.empty(0, np.uint64)
    owner = np.repeat(np.arange(n), [len(s) for s in sets])
    point = np.zeros(len(element))
    turn = 0
    while len(element):
        turn += 1
        draw = mix(element + np.uint64((turn * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF))
        point = point - np.log(((draw >> np.uint64(32)).astype(np.float64) + 0.5) / 2.0**32) / (RATE * size)
        register = ((draw & np.uint64(0xFFFFFFFF)) * np.uint64(size) >> np.uint64(32)).astype(np.int64)
        np.minimum.at(least, owner * size + register, point)
        if turn < 4 or turn % 4 == 0:
            live = np.unique(owner)
            furthest = np.empty(n)
            furthest[live] = least.reshape(n, size)[live].max(axis=1)
            going = point < furthest[owner]
            element, owner, point = element[going], owner[going], point[going]
    with np.errstate(divide="ignore"):
        level = np.floor(1 - np.log(least) / math.log(BASE))
    return np.clip(level, 0, TOP).astype("<u2").reshape(n, size)


def estimate(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """Most likely Jaccard similarity of pairs of sketches (rows of a and b) of sets of known sizes.

    How often one register lies above, below or level with the other has probabilities that
    follow from the sizes and the similarity; their likelihood has one maximum.
    """
    above, below = (a > b).sum(axis=1), (a < b).sum(axis=1)
    level = a.shape[1] - above - below
    u = na / np.maximum(na + nb, 1)
    v = 1 - u
    spread = (BASE - 1) / BASE

    def chance(x):
        return -np.log1p(-np.clip(x, 0, 1) * spread) / math.log(BASE)

    def likelihood(j):
        p, q = chance(u - v * j), chance(v - u * j)
        rest = 1 - p - q
        tiny = 1e-300
        return above * np.log(p + tiny) + below * np.log(q + tiny) + level * np.log(np.maximum(rest, tiny))

    low, high = np.zeros(len(u)), np.minimum(u, v) / np.maximum(np.maximum(u, v), 1e-12)
    for _ in range(40):
        third = (high - low) / 3
        left, right = low + third, high - third
        better = likelihood(left) < likelihood(right)
        low, high = np.where(better, left, low), np.where(better, high, right)
    return (low + high) / 2


def worth(similarity: float, size: int) -> float:
    """Estimates below this come from a pair that reaches the similarity with a probability below MISS.

    Level registers of a pair at the threshold are binomial; the cut lies half a register below
    the exact quantile.
    """
    low, level = 0.0, 0
    while True:
        ways = math.lgamma(size + 1) - math.lgamma(level + 1) - math.lgamma(size - level + 1)
        low += math.exp(ways + level * math.log(similarity) + (size - level) * math.log1p(-similarity))
        if low > MISS:
            return (level - 0.5) / size
        level += 1


def _sketches(docs: DataFrame, id_col: str, text_col: str, width: int, size: int) -> DataFrame:
    """id, ``text_hash``, ``n``, ``fp`` (fingerprint of the set) and ``registers`` of every document."""
    fields = T.StructType([T.StructField("n", T.LongType()), T.StructField("fp", T.BinaryType()), T.StructField("registers", T.BinaryType())])

    def build():
        def run(texts: list[bytes]) -> list:
            sets = [shingles(t, width) for t in texts]
            rows = sketch(sets, size)
            return [[len(s) for s in sets], [fingerprint(s) for s in sets], [r.tobytes() if len(s) else None for s, r in zip(sets, rows)]]

        return run

    text = F.col(text_col).cast("string")
    source = docs.select(F.col(id_col).cast("long").alias("doc"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("text_hash"), text.alias("text"))
    return map_texts(source, "text", fields, build, ["doc", "text_hash"])


def _numbers(column: pa.ChunkedArray, kind: str, size: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(-1, size)


def _likely(similarity: float, size: int):
    """Keeps the pairs (a, b, registers and sizes of both) whose estimate is worth a comparison."""

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                x, y = _numbers(batch.column("ra"), "<u2", size), _numbers(batch.column("rb"), "<u2", size)
                found = estimate(x, y, batch.column("na").to_numpy(), batch.column("nb").to_numpy())
                kept = batch.filter(pa.array(found >= worth(similarity, size)))
                yield pa.RecordBatch.from_arrays([kept.column("a"), kept.column("b")], names=["a", "b"])

    return run


def _blocks(rows: pa.Table, which: np.ndarray):
    """(left, right) members of the two blocks of each hub's pair of blocks, by number."""
    block = rows.column("block").to_numpy()
    members: dict[tuple, list[int]] = {}
    for k, place in enumerate(zip(*(rows.column(c).to_pylist() for c in ("hub", "i", "j")))):
        members.setdefault(place, []).append(k)
    for (hub, i, j), at in members.items():
        own = np.array(at)
        yield hub, which[own[block[own] == i]], which[own[block[own] == j]]


def _distinct(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct values, the first row of each, and the number of each row's value."""
    values, first, which = np.unique(np.array(column.to_pylist(), dtype=object), return_index=True, return_inverse=True)
    return values, first, which


def _active(similarity: float, size: int):
    """(hub, node) of members that may be similar to a member of another component.

    A call holds the blocks of many small groups, or a few large ones; each pair is looked at once.
    """

    def run(rows: pa.Table) -> pa.Table:
        node, first, which = _distinct(rows.column("node"))
        registers = _numbers(rows.column("registers").take(pa.array(first)), "<u2", size)
        n = rows.column("n").to_numpy()[first]
        root = _distinct(rows.column("root"))[2][first]
        hubs, nodes = [], []
        for hub, left, right in _blocks(rows, which):
            x, y = np.nonzero(root[left][:, None] != root[right][None, :])
            x, y = left[x], right[y]
            found = [np.empty(0, np.int64)]
            for at in range(0, len(x), CHUNK):
                p, q = x[at : at + CHUNK], y[at : at + CHUNK]
                near = estimate(registers[p], registers[q], n[p], n[q]) >= worth(similarity, size)
                found += [p[near], q[near]]
            own = node[np.unique(np.concatenate(found))].tolist()
            hubs += [hub] * len(own)
            nodes += own
        return pa.table([pa.array(hubs, pa.binary()), pa.array(nodes, pa.binary())], names=["hub", "node"])

    return run


def _bridges(pct: int, width: int):
    """Links between members of different components, on full sets: at most one less than there are members.

    The intersections of a set with all sets of a block come from one look at their shingles.
    """

    def run(rows: pa.Table, bodies: pa.Table) -> pa.Table:
        if not rows.num_rows:
            return pa.table([pa.array([], pa.binary())] * 2, names=["a", "b"])
        node, first, which = _distinct(rows.column("node"))
        above = list(_distinct(rows.column("root"))[2][first])
        sets = _sets(bodies, width)
        every, codes = np.unique(np.concatenate([sets[x] for x in node]), return_inverse=True)
        cuts = np.cumsum([len(sets[x]) for x in node])[:-1]
        coded = np.split(codes, cuts)
        sizes = np.array([len(c) for c in coded])
        parent = {r: r for r in above}

        def top(r):
            while parent[r] != r:
                parent[r] = r = parent[parent[r]]
            return r

        out_a, out_b = [], []
        mark = np.zeros(len(every), bool)
        for _, left, right in _blocks(rows, which):
            joined = np.concatenate([coded[k] for k in right])
            starts = np.cumsum(np.append(0, sizes[right][:-1]))
            for x in left:
                mark[coded[x]] = True
                common = np.add.reduceat(mark[joined].astype(np.int64), starts)
                mark[coded[x]] = False
                for y in right[100 * common >= pct * (sizes[x] + sizes[right] - common)]:
                    p, q = top(above[x]), top(above[y])
                    if p != q:
                        parent[p] = q
                        out_a.append(node[x])
                        out_b.append(node[y])
        return pa.table([pa.array(out_a, pa.binary()), pa.array(out_b, pa.binary())], names=["a", "b"])

    return run


def _sets(bodies: pa.Table, width: int) -> dict[bytes, np.ndarray]:
    """The shingle set of each class whose text came along."""
    sets: dict[bytes, np.ndarray] = {}
    if bodies.num_rows:
        for fp, text in zip(bodies.column("fp").to_pylist(), texts_of(bodies.column("text").combine_chunks())):
            if fp not in sets:
                found = shingles(text, width)
                if fingerprint(found) == fp:  # another text under the same id and hash is not it
                    sets[fp] = found
    return sets


def _linked(pct: int, width: int):
    """Pairs of a group whose full sets reach the threshold."""

    def run(pairs: pa.Table, bodies: pa.Table) -> pa.Table:
        sets = _sets(bodies, width) if pairs.num_rows else {}
        kept = []
        for a, b in zip(pairs.column("a").to_pylist(), pairs.column("b").to_pylist()):
            x, y = sets[a], sets[b]
            common = len(np.intersect1d(x, y, assume_unique=True))
            kept.append(100 * common >= pct * (len(x) + len(y) - common))
        return pairs.select(["a", "b"]).filter(pa.array(kept, pa.bool_()))

    return run


class _Corpus:
    """Classes of documents, and the way to their texts."""

    def __init__(self, docs: DataFrame, classes: DataFrame, id_col: str, text_col: str, pct: int, width: int):
        text = F.col(text_col).cast("string")
        self.texts = docs.select(F.col(id_col).cast("long").alias("own"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("own_hash"), text.alias("text"))
        self.classes, self.pct, self.width = classes, pct, width
        self.parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def brought(self, needed: DataFrame) -> DataFrame:
        """(group, fp, text) of the needed (group, fp): only texts of these classes move."""
        one_of = self.classes.join(needed.select("fp").distinct(), "fp").select("fp", "rep.doc", "rep.text_hash")
        same = F.col("own").eqNullSafe(F.col("doc")) & (F.col("own_hash") == F.col("text_hash"))
        bodies = settle(self.texts.join(one_of, same).select("fp", "text"), "bodies")
        return needed.join(bodies, "fp").select("group", "fp", "text")

    def confirmed(self, pairs: DataFrame) -> DataFrame:
        """The pairs (a, b) whose full sets reach the threshold.

        Pairs are dealt to groups of about GROUP_PAIRS by their first member; a first member with
        many pairs is split over several groups.
        """
        pairs = settle(pairs, "pairs")
        groups = max(self.parts, pairs.count() // GROUP_PAIRS)
        many = pairs.groupBy("a").count().select("a", F.ceil(F.col("count") / GROUP_PAIRS * 2).cast("int").alias("parts"))
        part = F.pmod(F.xxhash64("b"), F.col("parts"))
        dealt = settle(pairs.join(many, "a").withColumn("part", part).select("a", "b", F.pmod(F.xxhash64("a", "part"), F.lit(groups)).alias("group")), "dealt")
        needed = settle(dealt.select("group", F.col("a").alias("fp")).union(dealt.select("group", F.col("b").alias("fp"))).distinct(), "needed")
        return dealt.groupBy("group").cogroup(self.brought(needed).groupBy("group")).applyInArrow(_linked(self.pct, self.width), "a binary, b binary")

    def bridged(self, members: DataFrame) -> DataFrame:
        """Links (a, b) between the components of each hub's members (hub, node, root)."""
        dealt = _paired(members, self.parts)
        needed = settle(dealt.select("group", F.col("node").alias("fp")).distinct(), "needed")
        return dealt.groupBy("group").cogroup(self.brought(needed).groupBy("group")).applyInArrow(_bridges(self.pct, self.width), "a binary, b binary")


def _paired(members: DataFrame, parts: int) -> DataFrame:
    """The members of each hub in blocks of BLOCK, each block next to every other and itself, dealt to groups."""
    blocks = members.groupBy("hub").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    placed = members.join(blocks, "hub").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    met = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = settle(met.select("hub", "node", "root", "block", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j")), "paired")
    groups = max(2 * parts, rows.count() // GROUP_ROWS)
    return rows.withColumn("group", F.pmod(F.xxhash64("hub", "i", "j"), F.lit(groups)))


def _grouped(docs: DataFrame, id_col: str, text_col: str, pct: int, width: int) -> tuple[DataFrame, DataFrame]:
    """The sketch of every document, and the classes (fp, least, rep) with the ``root`` of their group."""
    similarity = pct / 100
    bands = bands_for(similarity)
    size = bands * ROWS
    sketches = settle(_sketches(docs, id_col, text_col, width, size), "sketches")
    classes = settle(
        sketches.where("n > 0").groupBy("fp").agg(F.min("doc").alias("least"), F.min(F.struct(F.col("doc").isNull().alias("no_id"), "doc", "text_hash")).alias("rep"), F.first("n").alias("n"), F.first("registers").alias("registers")),
        "classes",
    )
    # Registers are 2 bytes; substring counts from 1.
    keys = F.array(*[F.xxhash64(F.lit(k), F.substring("registers", 1 + 2 * ROWS * k, 2 * ROWS)) for k in range(bands)])
    banded = classes.select(F.col("fp").alias("node"), F.explode(keys).alias("key"))
    buckets = banded.groupBy("key").agg(F.min("node").alias("hub"), F.count("*").alias("members")).where("members > 1")
    stars = settle(banded.join(buckets, "key").where("node <> hub").select("hub", "node").distinct(), "stars")

    known = classes.select("fp", "n", "registers")
    corpus = _Corpus(docs, classes, id_col, text_col, pct, width)

    def likely(pairs: DataFrame) -> DataFrame:
        one = pairs.join(known.select(F.col("fp").alias("a"), F.col("n").alias("na"), F.col("registers").alias("ra")), "a")
        two = one.join(known.select(F.col("fp").alias("b"), F.col("n").alias("nb"), F.col("registers").alias("rb")), "b")
        return two.select("a", "b", "na", "nb", "ra", "rb").mapInArrow(_likely(similarity, size), "a binary, b binary")

    first = settle(corpus.confirmed(likely(stars.select(F.col("hub").alias("a"), F.col("node").alias("b")))), "links")
    roots = components(first)

    # All members of a bucket share its hub, so every pair of a bucket is one of its hub's group.
    together = stars.union(stars.select("hub", F.col("hub").alias("node")).distinct())
    labelled = settle(together.join(roots, "node", "left").select("hub", "node", F.coalesce("root", "node").alias("root")), "labelled")
    mixed = labelled.groupBy("hub").agg(F.min("root").alias("least"), F.max("root").alias("most")).where("least <> most").select("hub")
    paired = _paired(labelled.join(mixed, "hub"), corpus.parts).join(known.withColumnRenamed("fp", "node"), "node")
    active = settle(paired.groupBy("group").applyInArrow(_active(similarity, size), "hub binary, node binary").distinct(), "active")
    more = settle(corpus.bridged(active.join(labelled, ["hub", "node"])), "links")
    roots = components(first.union(more))

    return sketches, classes.select("fp", "least", "rep").join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", pct: int = 80, width: int = 5) -> DataFrame:
    """Per document its id (long), ``n_shingles``, ``component_id`` and ``kept``.

    Documents are linked when 100 * intersection >= pct * union of their shingle sets, and
    ``component_id`` is the smallest id that links reach, ``kept`` whether it is the own id. Texts
    without words are linked with nothing. Rows with the same id and text (repeated rows) are all
    kept or all not. A null id is never the smallest; where no document of a group has an id,
    ``component_id`` is null and all are kept. Columns other than these two are not read.
    """
    sketches, own = _grouped(docs, id_col, text_col, pct, width)
    smallest = own.groupBy("root").agg(F.min("least").alias("component_id"))
    found = own.join(smallest, "root").select("fp", "component_id")
    labelled_docs = sketches.select("doc", "n", "fp").join(found, "fp", "left")
    component = F.when(F.col("n") == 0, F.col("doc")).otherwise(F.col("component_id"))
    return labelled_docs.select(F.col("doc").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("doc").eqNullSafe(component).alias("kept"))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", pct: int = 80, width: int = 5) -> DataFrame:
    """The documents, all columns, without near copies: exactly one row of each group that ``near_duplicates`` finds.

    It is the row with the smallest id, of these the one with the smallest text hash; a null id
    counts as larger than any other. Of repeated rows with this id and text one stays, whichever
    columns they differ in. Texts without words have no copies and all stay.
    """
    sketches, own = _grouped(docs, id_col, text_col, pct, width)
    rows = sketches.where("n > 0").groupBy("doc", "text_hash").agg(F.count("*").alias("rows"))
    first = own.groupBy("root").agg(F.min("rep").alias("rep")).select("rep.doc", "rep.text_hash")
    same = F.col("doc").eqNullSafe(F.col("one_doc")) & (F.col("text_hash") == F.col("one_hash"))
    kept = settle(rows.join(first.select(F.col("doc").alias("one_doc"), F.col("text_hash").alias("one_hash")), same).select("one_doc", "one_hash", "rows"), "kept")

    renamed, names = shadowed(docs)
    body = F.coalesce(F.col(names[text_col]).cast("string"), F.lit(""))
    keyed = renamed.withColumns({"doc": F.col(names[id_col]).cast("long"), "text_hash": F.xxhash64(body)})
    worded = keyed.where(body.rlike(WORD))
    single = worded.join(kept.where("rows = 1"), same, "left_semi").select(*names.values())
    # Only repeated rows are aggregated; the hash makes the choice the same in every run. Their list
    # is a table of its own, so that Spark knows its size: where it is small, no text moves for it.
    again = worded.join(settle(kept.where("rows > 1"), "repeated"), same, "left_semi")
    one = again.groupBy("doc", "text_hash").agg(F.min_by(F.struct(*names.values()), F.xxhash64(*names.values())).alias("row")).select("row.*")
    left = single.unionByName(one).unionByName(keyed.where(~body.rlike(WORD)).select(*names.values()))
    return left.select(*[F.col(own_name).alias(c) for c, own_name in names.items()])
