"""The corpus pipeline: quality, exact dedup, near-dedup, secrets, packing.

Each stage takes (spark, docs, sf_dir) and works on all documents that its
predecessor kept; all but the last return the columns of documents. It uses
the operators of the training-data subpackage with production parameters.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from pixelgrove.llm.common import documents, stage, unused
from pixelgrove.llm.exact_dedup import drop_copies
from pixelgrove.llm.near_dedup import drop_near_copies
from pixelgrove.llm.packing import pack
from pixelgrove.llm.quality import SAMPLE_ROWS, score, train
from pixelgrove.llm.queries import QUALITY_THRESHOLD, vocabulary
from pixelgrove.llm.secrets import labelled_samples, redact
from pixelgrove.llm.secrets import train as train_markov
from pixelgrove.llm.training import held_out, labelled_rows


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go.

    A null or empty text is judged as one empty line; a row without an id is judged like any other; repeated rows are
    judged each, all alike. An empty table stays empty, without usable labels every row stays. Other columns, whatever
    their names, pass through.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = train(labelled_rows(docs, labels, "quality", ~held_out(F.col("doc_id"), 5, 0), SAMPLE_ROWS))
    name = unused(docs, "__quality")
    return score(docs, model, out_col=name).where(F.col(name) >= QUALITY_THRESHOLD).select(*docs.columns)


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the row with the largest doc_id stays.

    Null and empty texts are equal. Of rows that repeat id and text one stays, whatever their other columns; a row
    without an id stays only if no row of its class has one. An empty table stays empty; other columns pass through.
    """
    return drop_copies(docs, keep="largest")


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of near duplicates (five-word shingles, similarity of 0.8 or more), the document with the smallest doc_id stays.

    Null texts and those without words are near to nothing and stay. Rows that repeat the id that stays, with texts of
    that group, stay together; a row without an id stays unless its text is near one with an id. An empty table stays
    empty; other columns pass through.
    """
    return drop_near_copies(docs, shingle=5, percent=80)


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked; n_chars, where there is such a column, follows the text.

    No row goes, repeated ones neither. A null text stays null and keeps its n_chars; an empty one stays empty. An empty
    table stays empty; other columns pass through.
    """
    clean = redact(docs, train_markov(labelled_samples(spark)))
    if "n_chars" not in docs.columns:
        return clean
    return clean.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 2048 tokens, one row per piece.

    A null or empty text is its closing id alone; a row without an id is packed with a null id; repeated rows are packed
    each. An empty table gives no pieces; other columns are left out.
    """
    return pack(docs, vocabulary("byte_bpe_50k.json"))


STAGES = [("quality", quality_stage), ("exact_dedup", exact_stage), ("near_dedup", near_stage), ("secrets", secrets_stage), ("packing", packing_stage)]

#: The classifier and the packer can't be stated in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on documents; what each returns is written and read again."""
    docs = documents(spark, sf_dir)
    for name, function in STAGES[:-1]:
        docs = stage(function(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
