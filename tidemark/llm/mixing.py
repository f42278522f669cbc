"""Mixing sources to target weights by Poisson replication.

Each source has a mean repetition rate: its share of the wanted amount over what it holds. The
number of copies of a document is Poisson with that mean, found by inverting the distribution at a
number in (0, 1) that a hash of seed and id gives; so it depends on the document alone and not on
partitions or retries. Rates above ``STEP`` are sums of several draws with smaller means, which
is the same distribution without underflow or long tables.

Only DataFrame functions are used; documents are shuffled once, in the order of a second hash.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import shadowed
from tidemark.session import settle

STEP = 16.0
#: At a mean of STEP, more than this has a probability below 2**-53.
MOST = 96
HEX_DIGITS = 13


def uniform(*parts: Column) -> Column:
    """A number in (0, 1) from the hash of the parts, 52 bits."""
    digest = F.sha2(F.concat_ws(":", *parts), 256)
    return (F.conv(F.substring(digest, 1, HEX_DIGITS), 16, 10).cast("double") + 0.5) / float(1 << 52)


def poisson_table(rate: Column) -> Column:
    """Array of P(X <= k), k = 0, 1, ..., of a Poisson variable with a mean in (0, STEP]."""
    logs = F.array(*[F.lit(math.lgamma(k + 1)) for k in range(MOST + 1)])
    each = F.transform(logs, lambda log, k: F.exp(k * F.log(rate) - rate - log))
    summed = F.aggregate(
        each,
        F.struct(F.lit(0.0).alias("sum"), F.array().cast("array<double>").alias("all")),
        lambda a, p: F.struct((a["sum"] + p).alias("sum"), F.concat(a["all"], F.array(a["sum"] + p)).alias("all")),
    )
    return summed["all"]


def source_rates(docs: DataFrame, weights: DataFrame | None, source_col: str, text_col: str, amount: float | None) -> DataFrame:
    """(source, rate, draws, table): one row per source of the documents."""
    size = F.coalesce(F.octet_length(F.col(text_col)), F.lit(0)).cast("long")
    held = settle(docs.groupBy(F.col(source_col).alias("source")).agg(F.sum(size).alias("bytes")), "held")
    if weights is None:
        weighted = held.withColumn("weight", F.lit(1.0))
    else:
        wanted = weights.select(F.col("source").alias("named"), F.col("weight").cast("double").alias("weight"))
        weighted = held.join(wanted, F.col("source").eqNullSafe(F.col("named")), "left").select("source", "bytes", F.coalesce("weight", F.lit(0.0)).alias("weight"))
    all_weights = weighted.agg(F.sum("weight").alias("w")).scalar()
    total = F.lit(float(amount)) if amount is not None else weighted.agg(F.sum("bytes").alias("b")).scalar()
    rate = F.col("weight") / all_weights * total / F.col("bytes")
    rated = weighted.select("source", F.when(F.col("weight") <= 0, 0.0).when(F.col("bytes") == 0, 1.0).otherwise(rate).alias("rate"))
    drawn = rated.withColumn("draws", F.ceil(F.col("rate") / STEP).cast("int"))
    return drawn.withColumn("table", F.when(F.col("rate") > 0, poisson_table(F.col("rate") / F.col("draws"))))


def mix_sources(
    docs: DataFrame,
    weights: DataFrame | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    seed: int = 1,
    amount: float | None = None,
    result_cols: tuple[str, str] | None = None,
) -> DataFrame:
    """Copies of the documents, all columns, in globally shuffled order.

    ``weights`` has columns source and weight (default: the same for every source); a source that
    it does not name gets none. ``amount`` is the wanted sum of text bytes (default: what the
    documents hold). ``result_cols`` adds the number of each copy (from 1) and the key that the order
    follows; a column named like one gives way. A null source is a source of its own. A source
    without any text bytes has rate 1. The draw of a document follows from its id (null: from
    its text), so repeated rows are repeated alike. No documents, no rows.
    """
    renamed, names = shadowed(docs)
    text = F.coalesce(F.col(names[text_col]).cast("string"), F.lit(""))
    who = F.coalesce(F.col(names[id_col]).cast("string"), F.sha2(text, 256))
    rates = settle(source_rates(docs, weights, source_col, text_col, amount), "rates")
    joined = renamed.join(rates, F.col(names[source_col]).eqNullSafe(F.col("source")))
    seeded = F.lit(f"copies:{seed}")
    draw = lambda j: F.size(F.filter("table", lambda p: p < uniform(seeded, who, j.cast("string"))))
    copies = F.when(F.col("draws") > 0, F.aggregate(F.sequence(F.lit(1), F.greatest("draws", F.lit(1))), F.lit(0), lambda n, j: n + draw(j))).otherwise(0)
    counted = joined.withColumn("copies", copies).where("copies > 0").drop("table", "rate", "draws", "source")
    repeated = counted.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    key = F.sha2(F.concat_ws(":", F.lit(f"order:{seed}"), who, F.col("copy").cast("string")), 256)
    mixed = repeated.withColumn("key", key).repartition("key").sortWithinPartitions("key")
    kept = [F.col(own).alias(c) for c, own in names.items() if not result_cols or c not in result_cols]
    extra = [F.col(c).alias(name) for c, name in zip(("copy", "key"), result_cols)] if result_cols else []
    return mixed.select(*kept, *extra)
