"""Sharding through fixed virtual slots.

Records are hashed into a fixed number of slots, bytes are summed per slot, and a map that is kept
as a table with a version says which shard holds a slot. Only the map is edited when shards are
rebalanced or added; the slot of a record never changes. A map has one row per slot, so the driver
may hold it whatever the size of the data.
"""

from __future__ import annotations

import heapq

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.session import settle

SLOTS = 8192
MAP_SCHEMA = "version int, virtual_slot int, shard int, slot_bytes long, slot_rows long"


def virtual_slot(id_col: Column, text_col: Column, slots: int = SLOTS) -> Column:
    """The slot of a record: from its id, or from its text where it has none."""
    return F.pmod(F.xxhash64(F.coalesce(id_col.cast("string"), F.concat(F.lit("text:"), F.coalesce(text_col.cast("string"), F.lit(""))))), F.lit(slots)).cast("int")


def record_sizes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", slots: int = SLOTS) -> DataFrame:
    """id, ``size`` (UTF-8 bytes and 8), ``text_crc32`` and slot of every record, in one pass over the texts."""
    text = F.col(text_col).cast("string")
    return docs.select(
        F.col(id_col),
        (F.coalesce(F.octet_length(text), F.lit(0)) + 8).cast("long").alias("size"),
        F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"),
        virtual_slot(F.col(id_col), text, slots).alias("virtual_slot"),
    )


def slot_totals(records: DataFrame) -> dict[int, tuple[int, int]]:
    """Bytes and rows per slot: at most one row per slot comes to the driver."""
    totals = records.groupBy("virtual_slot").agg(F.sum("size").alias("b"), F.count("*").alias("n"))
    return {r["virtual_slot"]: (r["b"], r["n"]) for r in totals.collect()}


def new_map(totals: dict[int, tuple[int, int]], shards: int, slots: int = SLOTS) -> dict[int, int]:
    """Slots in falling size, each to the shard that has least so far."""
    heap = [(0, s) for s in range(shards)]
    out = {}
    for slot in sorted(range(slots), key=lambda s: (-totals.get(s, (0, 0))[0], s)):
        held, shard = heapq.heappop(heap)
        out[slot] = shard
        heapq.heappush(heap, (held + totals.get(slot, (0, 0))[0], shard))
    return out


def rebalanced(current: dict[int, int], totals: dict[int, tuple[int, int]], shards: int, tolerance: float = 0.01) -> dict[int, int]:
    """An edited map: slots move from the fullest shard to the emptiest until these are within the tolerance of the mean.

    Also adds shards (those up to ``shards`` that hold nothing yet); every slot moves at most once.
    """
    out = dict(current)
    held = [0] * shards
    own: list[list[tuple[int, int]]] = [[] for _ in range(shards)]
    for slot, shard in out.items():
        size = totals.get(slot, (0, 0))[0]
        held[shard] += size
        if size:
            own[shard].append((size, slot))
    for each in own:
        each.sort()
    mean = sum(held) / shards
    while True:
        full, empty = held.index(max(held)), held.index(min(held))
        gap = held[full] - held[empty]
        if gap <= tolerance * mean:
            return out
        fits = [x for x in own[full] if x[0] < gap]
        if not fits:
            return out
        size, slot = min(fits, key=lambda x: abs(2 * x[0] - gap))
        own[full].remove((size, slot))  # a moved slot is not moved again
        out[slot] = empty
        held[full] -= size
        held[empty] += size


def store_map(spark: SparkSession, slot_map: dict[int, int], totals: dict[int, tuple[int, int]], version: int, path: str | None = None) -> DataFrame:
    """Write a version of the map (appended to the table at ``path``, or to the shared folder) and read it back."""
    rows = [(version, slot, shard, *totals.get(slot, (0, 0))) for slot, shard in sorted(slot_map.items())]
    df = spark.createDataFrame(rows, MAP_SCHEMA).coalesce(1)
    if path is None:
        return settle(df, "slot-map")
    df.write.mode("append").parquet(path)
    return spark.read.schema(MAP_SCHEMA).parquet(path).where(F.col("version") == version)


def latest_map(spark: SparkSession, path: str) -> tuple[int, dict[int, int]]:
    """Number and contents of the newest version of a stored map."""
    stored = spark.read.schema(MAP_SCHEMA).parquet(path)
    version = stored.agg(F.max("version")).first()[0]
    return version, {r["virtual_slot"]: r["shard"] for r in stored.where(F.col("version") == version).collect()}


def assign(records: DataFrame, slot_map: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``shard`` and ``slot`` of every record: the place within its shard, from 0 without gaps.

    Records are numbered within their virtual slot, and each virtual slot starts where the one
    before it in the shard ends, so no task ever holds a whole shard.
    """
    from pyspark.sql import Window

    before = Window.partitionBy("shard").orderBy("virtual_slot").rowsBetween(Window.unboundedPreceding, -1)
    bases = slot_map.select("virtual_slot", "shard", F.coalesce(F.sum("slot_rows").over(before), F.lit(0)).alias("base"))  # one row per slot
    within = Window.partitionBy("virtual_slot").orderBy(F.col(id_col), "text_crc32", "size")
    numbered = records.withColumn("at", F.row_number().over(within) - 1)
    return numbered.join(bases, "virtual_slot").withColumn("slot", (F.col("base") + F.col("at")).cast("long")).drop("base", "at")


def shard_documents(docs: DataFrame, shards: int = 24, id_col: str = "doc_id", text_col: str = "text", slots: int = SLOTS) -> DataFrame:
    """id, ``size``, ``text_crc32``, ``virtual_slot``, ``shard`` and ``slot`` of every document, with shards near equal in bytes.

    A null text has size 8. Repeated rows lie in one virtual slot; their order among themselves is
    open, their places are not. An empty table gives no rows. Other columns are not read.
    """
    records = settle(record_sizes(docs, id_col, text_col, slots), "records")
    totals = slot_totals(records)
    first = new_map(totals, shards, slots)
    return assign(records, store_map(docs.sparkSession, rebalanced(first, totals, shards), totals, 1), id_col)


def write_shards(docs: DataFrame, slot_map: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", slots: int = SLOTS) -> None:
    """All documents under ``path``/shard=n; a shard is written by many tasks, each with some of its virtual slots."""
    placed = docs.withColumn("virtual_slot", virtual_slot(F.col(id_col), F.col(text_col), slots)).join(slot_map.select("virtual_slot", "shard"), "virtual_slot")
    placed.repartition("shard", (F.col("virtual_slot") % 16)).drop("virtual_slot").write.partitionBy("shard").parquet(path)
