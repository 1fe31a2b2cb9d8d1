"""From raw documents to packed training sequences, stage by stage.

Each stage takes (spark, docs, sf_dir), where docs is all that the stage before
kept, and returns a DataFrame; all but the last return the columns of documents.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallymark.llm.common import shared_folder, table
from tallymark.llm.line_dedup import drop_shared_lines
from tallymark.llm.mixing import mix
from tallymark.llm.packing import pack
from tallymark.llm.queries import tokenizer_path
from tallymark.llm.simhash_dedup import keep_one_per_class
from tallymark.llm.toxicity import keep_harmless


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents with a toxicity of 0.7 or more, learned from the labels."""
    return keep_harmless(docs, table(spark, sf_dir, "labels"), reject=0.7)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Take shared lines out of all documents but their first holder; n_chars follows.

    A document that loses all its lines stays, with an empty text.
    """
    done = drop_shared_lines(docs, max_docs=1, min_chars=10)
    kinds = {f.name: f.dataType for f in docs.schema.fields}
    new = {"text": F.col("kept")}
    if "n_chars" in kinds:
        new["n_chars"] = F.char_length("kept").cast(kinds["n_chars"])
    return done.select(*[new.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of texts whose fingerprints of 3-word shingles are linked within 3 bits the smallest id stays."""
    return keep_one_per_class(docs, words=3, reach=3)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mixture of sources draws them: all once, none over twice."""
    return mix(docs, max_repeats=2.0)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 4096 tokens, a row per piece with its ids."""
    return pack(docs, tokenizer_path(), length=4096)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxicity),
    ("line_dedup", line_dedup),
    ("simhash_dedup", simhash_dedup),
    ("mixing", mixing),
    ("packing", packing),
]

#: The toxicity model is learned, which SQL cannot express; tests compare with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result is written as Parquet and read by the next."""
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for at, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{at}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
