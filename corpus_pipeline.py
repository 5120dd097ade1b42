"""The corpus pipeline: stages that each keep part of the documents, in a fixed order."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trialweave.llm import line_chunks, mixing, pieces, quality_trees, signature_trees
from trialweave.llm.queries import levels, model_file, quality_model
from trialweave.sources.stages import stage

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _like(rows: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of ``docs``, with the number of characters of texts that have changed."""
    if "n_chars" in docs.columns:
        rows = rows.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return rows.select(*docs.columns)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject.

    A null or empty text is scored as a text without words.  Equal texts are kept or rejected
    together, and repeated rows stay repeated.
    """
    return quality_trees.keep(docs, quality_model(spark, sf_dir), threshold=0.7)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the line chunks that an earlier document has; every document stays.

    A null text stays null, an empty one empty; a whole copy keeps an empty text.  Of rows that
    share a key, neither removes the other's chunk at the same place.
    """
    return _like(line_chunks.remove_repeats(docs, spaced=True), docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: shingles of five words, similarity 0.8.

    The smallest key stays.  Documents without words, null texts included, link with nothing
    and all stay; rows that share a key are one document.
    """
    return signature_trees.keep_one(docs, width=5, percent=80)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Four fifths of the tokens, mixed to the target weights, no document more than once.

    Documents without tokens, null texts included, cost nothing and stay if they come before the
    cut of their leaf; a leaf without tokens goes.  Null languages and sources are leaves of
    their own; rows that share a key are chosen together.
    """
    return _like(mixing.mix(docs, levels(), share=(4, 5), epochs=1, seed=17), docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids, their byte spans and the text they decode to, for every document.

    A null text has null arrays, an empty one empty arrays; repeated rows are encoded each.
    """
    return pieces.encode(docs, model_file(), decoded="decoded")


STAGES: list[tuple[str, Stage]] = [
    ("quality_trees", quality),
    ("line_chunks", lines),
    ("signature_trees", near_copies),
    ("mixing", mixture),
    ("piece_codec", encoded),
]

#: The classifier and the piece model have no SQL form.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; each is written as parquet and read back."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, apply) in enumerate(STAGES):
        docs = apply(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = stage(docs, name)
    return docs
