"""Bounded samples of labelled rows for the classifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import held_out, uniform


def training_rows(docs: DataFrame, labels: DataFrame, label: str, *, most_rows: int, columns: list[str | Column], seed: int = 5) -> DataFrame:
    """Columns of whole labelled documents that are not held out, with column label (0 or 1).

    At most about most_rows rows, the bound of the sample: beyond it, rows are taken by a hash of the id, so that
    reruns agree. Null labels and ids are left out; several labels of one id each give a row.
    """
    usable = labels.select(F.col("doc_id").alias("label_id"), F.col(label).cast("double").alias("label")).where(F.col("label").isin(0.0, 1.0) & F.col("label_id").isNotNull() & ~held_out(F.col("label_id")))
    n = usable.count()
    if n > most_rows:
        usable = usable.where(uniform("label_id", F.lit(seed)) < most_rows / n)
    # At most about most_rows ids and labels are broadcast, whatever the size of either table; texts stay where they are.
    usable = F.broadcast(usable)
    return docs.join(usable, docs["doc_id"] == usable["label_id"]).select(*columns, "label", "label_id")
