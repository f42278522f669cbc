"""Reading delimited files with declared types; writing and reading the harmonised table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.sources.schemas import BIO_RESPONSES

#: Column of :func:`read_csv_checked` with the faults of a record, and the field that stands for a whole record there.
UNREADABLE = "unreadable"
WHOLE_RECORD = "record"
_LINE = "tm_line"


def read_csv(spark: SparkSession, path: str, schema: T.StructType, mode: str = "PERMISSIVE") -> DataFrame:
    """CSV with a header line that is not trusted; empty fields and ``NA`` are missing.

    Columns are matched by position, so repeated or changed headers do no harm, and the types
    need no extra pass over the data. A field that is no value of its type is missing, unless
    ``mode`` is ``FAILFAST``; :func:`read_csv_checked` tells such fields from missing ones.
    """
    return (
        spark.read.schema(schema)
        .option("header", True)
        .option("enforceSchema", True)
        .option("nullValue", "NA")
        .option("dateFormat", "yyyy-MM-dd")
        .option("mode", mode)
        .csv(path)
    )


def _typed(text: Column, kind: T.DataType) -> Column:
    """A field's text as a value of its type; NULL where it is none. Numbers have to be finite."""
    if isinstance(kind, T.StringType):
        return text
    trimmed = F.trim(text)
    if isinstance(kind, T.DateType):
        return F.try_to_date(trimmed, "yyyy-MM-dd")
    value = trimmed.try_cast(kind)
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        # Java also reads a type letter at the end of a number
        finite = ~F.isnan(value) & (F.abs(value) < float("inf")) & ~trimmed.rlike("[dDfF]$")
        return F.when(finite, value)
    return value


def read_csv_checked(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Like :func:`read_csv`, with the faults of each record in an array column ``unreadable``.

    An entry holds the name of a field and its text, where that is no value of the field's type; the
    value itself is NULL. A record with too few or too many fields has an entry ``record`` with its
    whole line. The array is empty for a sound record; missing fields (empty or ``NA``) are no fault.
    All of it is one scan: fields are read as text and cast behind it, so a column that nobody asks
    for is not cast.
    """
    if taken := {UNREADABLE, _LINE} & set(schema.names):
        raise ValueError(f"the layout may not have a column {min(taken)}")
    texts = T.StructType([T.StructField(c, T.StringType()) for c in [*schema.names, _LINE]])
    read = (
        spark.read.schema(texts)
        .option("header", True)
        .option("enforceSchema", True)
        .option("nullValue", "NA")
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", _LINE)
        .option("columnPruning", False)  # the length of a record is judged on all of its fields
        .csv(path)
    )

    def fault(condition: Column, field: str, text: Column) -> Column:
        return F.when(condition, F.struct(F.lit(field).alias("field"), text.alias("value")))

    values = {f.name: _typed(F.col(f"`{f.name}`"), f.dataType) for f in schema}
    faults = [
        fault(F.col(f"`{f.name}`").isNotNull() & values[f.name].isNull(), f.name, F.col(f"`{f.name}`"))
        for f in schema
        if not isinstance(f.dataType, T.StringType)
    ]
    faults.append(fault(F.col(_LINE).isNotNull(), WHOLE_RECORD, F.col(_LINE)))
    found = F.filter(F.array(*faults), lambda x: x.isNotNull())
    return read.select(*[v.alias(c) for c, v in values.items()], found.alias(UNREADABLE))


def unreadable_fields(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The quarantine of a checked table: keys, field and text of each fault, a row per fault."""
    return df.where(F.size(UNREADABLE) > 0).select(*[F.col(f"`{k}`") for k in keys], F.inline(UNREADABLE))


def read_csv_inferred(spark: SparkSession, path: str) -> DataFrame:
    """CSV whose types are found from the data: one more pass, for exploration only."""
    return spark.read.option("header", True).option("nullValue", "NA").option("inferSchema", True).csv(path)


def write_csv(df: DataFrame, path: str) -> None:
    """Export as CSV files with a header, missing values as ``NA``."""
    df.write.option("header", True).option("nullValue", "NA").option("dateFormat", "yyyy-MM-dd").csv(path)


def write_partitioned(df: DataFrame, path: str, by: list[str]) -> None:
    """Parquet, one folder per value of ``by``.

    Rows are first rebalanced by those columns: few files for small values, and a value that
    holds much of the data is split over many tasks instead of one.
    """
    df.hint("rebalance", *by).write.partitionBy(*by).parquet(path)


def write_responses(df: DataFrame, path: str) -> None:
    """The long table by site and species, the two columns every consumer filters on."""
    write_partitioned(df, path, ["location", "species"])


def read_responses(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(BIO_RESPONSES).parquet(path).select(*BIO_RESPONSES.names)
