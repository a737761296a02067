"""Small pieces that several operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spoor.session import scratch_path


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def free_name(taken: list[str], wish: str) -> str:
    """A column name that clashes with none of ``taken``, whatever their case."""
    low = {t.lower() for t in taken}
    while wish.lower() in low:
        wish += "_"
    return wish


def free_prefix(taken: list[str], wish: str) -> str:
    """A prefix that no column name of ``taken`` begins with, whatever their case."""
    while any(t.lower().startswith(wish.lower()) for t in taken):
        wish += "_"
    return wish


def with_columns_last(df: DataFrame, added: dict[str, Column]) -> DataFrame:
    """Add columns; a column of the input that has one of their names gives way."""
    low = {n.lower() for n in added}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in low], *[v.alias(n) for n, v in added.items()])


def row_hash(df: DataFrame) -> Column:
    """A hash of all columns that can be hashed, so that rows numbered by it get the same numbers again."""
    plain = [f.name for f in df.schema.fields if not any(t in f.dataType.simpleString() for t in ("map<", "variant"))]
    return F.xxhash64(*[F.col(f"`{c}`") for c in plain]) if plain else F.lit(0).cast("long")


def store(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared folder and read again: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def draw(df: DataFrame, rows: int, *key: str, exact: bool = True) -> DataFrame:
    """``rows`` rows of least hash of ``key``: the same ones however the table is laid out.

    Rows are first cut down to little more than ``rows`` by their hash, so that not every task
    sends that many to the one that sorts them. Without ``exact`` that is all, and about ``rows``
    rows are returned, in no order.
    """
    n = df.count()
    spare = 10 * rows**0.5 + 100 if exact else 0
    bits = 40
    drawn = F.pmod(F.xxhash64(F.lit("draw"), *key), F.lit(1 << bits))
    some = df if rows + spare >= n else df.filter(drawn < int((rows + spare) / n * (1 << bits)))
    return some.orderBy(drawn, *key).limit(rows) if exact else some
