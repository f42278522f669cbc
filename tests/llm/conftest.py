import pytest
from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that the operators use themselves.
CLASHES = ["doc", "n", "fp", "registers", "page", "row", "text_hash", "gone", "left", "copy", "key", "copies", "table", "draws", "virtual_slot", "shard", "slot", "label", "group", "kept", "score", "ids", "node", "count", "size", "__0", "__text", "h", "c", "bytes", "rate", "seed", "part", "turn"]


@pytest.fixture(scope="session")
def make(spark):
    """Documents from (id, text) or (id, text, source) rows, with columns whose names clash."""

    def build(rows, clash=True):
        full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", None if r[1] is None else len(r[1])) for r in rows]
        df = spark.createDataFrame(full, SCHEMA).repartition(3)
        return df.withColumns({c: F.lit("own") for c in CLASHES}) if clash else df

    return build
