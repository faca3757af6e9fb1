"""From raw documents to packed training sequences.

Stages, in order: the quality classifier drops rejected documents; near copies by SimHash leave one document of each
group; secrets are redacted; sources are mixed to target weights, with copies in the order of the curriculum; documents
are packed. Each stage works on what its predecessor has kept.
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmill.llm import mixing, packing, quality, secrets, simhash
from quillmill.llm.common import discard, fresh, swept, table
from quillmill.llm.learn import sample_rows


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score reaches the threshold. Without labels of both kinds nothing is rejected."""
    model = quality.fit_model(sample_rows(docs, table(spark, sf_dir, "labels"), "quality"))
    score = fresh(docs, "__score")
    return quality.score_quality(docs, model, docs.columns, score).where(F.col(score) >= quality.THRESHOLD).select(docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document, by id, of each group at a similarity of 0.8 or more in sets of five words; other documents are
    their own group. A document is a row: rows that repeat an id and a text are copies, another text under the same id
    is another document, and a missing id comes after all others."""
    return simhash.drop_near_copies(docs)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with a mark in place of each secret; n_chars follows the text."""
    found = fresh(docs, "__secrets")
    out = secrets.scan_secrets(docs, out=found, parts=True).withColumn("text", secrets.redact(F.col("text"), F.col(found)))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.size(found) > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.select(docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """As many copies of each document as the mix takes, in the order of the curriculum."""
    return mixing.mix_documents(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences, with their ids, in the order in which the documents were written."""
    place = docs.metadataColumn("_metadata")
    placed = docs.select("doc_id", "text", place["file_name"].alias("file_name"), place["row_index"].alias("row_index"))
    return packing.pack(placed, keep_ids=True, order=("file_name", "row_index"))


STAGES = [
    ("quality classifier", keep_quality),
    ("SimHash near-dedup", drop_near_copies),
    ("secret scans", redact_secrets),
    ("source mixing", mix_sources),
    ("packing", pack_sequences),
]
#: A classifier, fingerprints and a tokenizer: SQL cannot express the rows.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to the documents of sf_dir, each result written and read again; what a stage wrote besides it
    goes when the stage is done, and a result when the next one is there."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        before, docs = docs, swept(spark, functools.partial(stage, spark, docs, sf_dir), name.replace(" ", "-"))
        discard(before)
    return docs
