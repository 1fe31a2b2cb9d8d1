"""Bounded, seeded samples of labelled documents, for the classifiers to learn from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, spread


def held_out(doc_id: Column) -> Column:
    """True for the third of all ids that no classifier may learn from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def training_texts(
    docs: DataFrame, labels: DataFrame, label: str, most: int, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(``text``, ``label``) of at most ``most`` labelled documents that are not held out.

    The sample is the labelled ids with the smallest hashes, so it does not
    depend on how tables are stored. Its ids are broadcast (at most ``most``
    rows), and the texts are written once. Null ids or labels, and ids labelled
    both ways, are left out; of repeated rows one text is taken.
    """
    known = labels.select(F.col("doc_id").alias("of"), F.col(f"`{label}`").cast("int").alias("label"))
    known = known.where("of is not null and label is not null").where(~held_out(F.col("of")))
    known = known.groupBy("of").agg(F.min("label").alias("label"), F.max("label").alias("other")).where("label = other")
    picked = known.orderBy(spread(F.col("of")), "of").limit(most).select("of", "label")
    texts = docs.select(F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    found = texts.join(F.broadcast(picked), F.col("id") == F.col("of")).select("id", "text", "label")
    return cut(found.dropDuplicates(["id"]).select("text", "label"))
