"""Relational forms of what ordered lists do: first of equals, carry-forward, first of a kind, positions, limits by group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .lineage import cut


def _row(df: DataFrame, keys, order) -> DataFrame:
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))


def ordered_distinct(df: DataFrame, keys: list, order: list) -> DataFrame:
    """The first row of each key."""
    return _row(df, keys, order).where("_n = 1").drop("_n")


def cap_per_group(df: DataFrame, keys: list, order: list, most: int | None) -> DataFrame:
    """The first rows of each group; all of them for no cap."""
    return df if not most or most <= 0 else _row(df, keys, order).where(F.col("_n") <= most).drop("_n")


def locf(col: Column, keys: list, order: list) -> Column:
    """The last value that isn't null so far, the row's own included."""
    return F.last(col, ignorenulls=True).over(Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow))


def last_before(col: Column, keys: list, order: list) -> Column:
    """The last value that isn't null in the rows before."""
    return F.last(col, ignorenulls=True).over(Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))


def first_unless_upgraded(df: DataFrame, keys: list, order: Column, good: Column, values: list[str]) -> DataFrame:
    """Of each key the first good row's values, or the first row's if none is good; first_at: where the key was first seen."""
    return df.groupBy(*keys).agg(F.min_by(F.struct(*values), F.struct((~good).alias("bad"), order.alias("at"))).alias("v"), F.min(order).alias("first_at")).select(*keys, "first_at", "v.*")


def kept_once(df: DataFrame, keys: list, order: list, kept: Column) -> Column:
    """Whether a kept row repeats an earlier kept row of its key. Rows that aren't kept don't count."""
    return kept & (F.row_number().over(Window.partitionBy(*keys, kept).orderBy(*order)) > 1)


def zip_by_seq(left: DataFrame, right: DataFrame, keys: list, seq: str = "seq") -> DataFrame:
    """Rows side by side by their position."""
    return left.join(right, [*keys, seq])


def collision_suffix(folder: Column, name: Column, order: Column) -> Column:
    """name, or name_1, name_2 ... before the extension for later rows of a folder with the same name."""
    n = F.row_number().over(Window.partitionBy(folder, name).orderBy(order)) - 1
    stem, suffix = F.regexp_extract(name, r"^(.+?)(\.[^.]*)?$", 1), F.regexp_extract(name, r"^(.+?)(\.[^.]*)?$", 2)
    return F.when(n == 0, name).otherwise(F.concat(stem, F.lit("_"), n.cast("string"), suffix))


def islands(line: Column, blank: Column, keys: list, order: list) -> Column:
    """The number of blank rows so far: rows between the same blanks share it."""
    return F.sum(blank.cast("int")).over(Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow))


def numbered(df: DataFrame, order: list, name: str = "number") -> DataFrame:
    """df with its rows numbered from 1 in a total order, without one task that holds them all: ranges are numbered each on its own, and their sizes, a row for each range, give where they begin."""
    rows = df.repartitionByRange(*order).withColumn("_p", F.spark_partition_id())
    rows = cut(rows.withColumn("_i", F.row_number().over(Window.partitionBy("_p").orderBy(*order))), "numbered")
    sizes = rows.groupBy("_p").agg(F.count("*").alias("n")).withColumn("_before", F.coalesce(F.sum("n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return rows.join(F.broadcast(sizes.drop("n")), "_p").withColumn(name, (F.col("_before") + F.col("_i")).cast("long")).drop("_p", "_i", "_before")
