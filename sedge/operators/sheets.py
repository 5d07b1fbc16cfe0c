"""Key-driven coding and auditing of tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ordinals import numbered


def filled(column: Column) -> Column:
    return F.coalesce(F.trim(column) != "", F.lit(False))


def key_rows(sheet: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of a key sheet with all keys filled, keys trimmed."""
    kept = sheet
    for k in keys:
        kept = kept.where(filled(F.col(k)))
    return kept.select(*[F.trim(c).alias(c) if c in keys else F.col(c) for c in sheet.columns])


def sequence_codes(rows: DataFrame, layer: str, row_id: str, prefix: Column) -> DataFrame:
    """rows with code: prefix_n, n counting the layer's rows by id; blanks are taken out of it. All layers in one pass."""
    counted = numbered(rows, "_n", [layer], row_id)
    return counted.withColumn("code", F.replace(F.concat(prefix, F.lit("_"), F.col("_n").cast("string")), F.lit(" "), F.lit(""))).drop("_n")


def update_from(table: DataFrame, changes: DataFrame, key: str, column: str) -> DataFrame:
    """The table as it is after column := changes.column where keys meet: a new snapshot."""
    new = changes.select(F.col(key), F.col(column).alias("_new"))
    return table.join(new, key, "left").withColumn(column, F.coalesce("_new", column)).drop("_new")


def blank_audit(rows: DataFrame, groups: list[str], column: str) -> DataFrame:
    """groups, n_blank and n_rows of the groups with a null or blank value in the column."""
    counts = rows.groupBy(*groups).agg(F.count_if(~filled(F.col(column))).alias("n_blank"), F.count("*").alias("n_rows"))
    return counts.where("n_blank > 0")
