"""A corpus pipeline of five training-data operators: documents in, packed token sequences out.

Each stage takes the documents that its predecessor kept and returns documents (the last: packed pieces). Between stages the
documents are written as Parquet and read again, so a lost executor costs one stage at most. What a written stage no longer
needs is deleted.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskspan.llm import crf, decontam, near_dedup, packing, secrets
from riskspan.llm.common import drop_tables, materialise, table, tables_written

#: Percent of shared word shingles from which the near-dedup stage takes documents for copies.
SIMILAR = 80


def _aside(docs: DataFrame) -> tuple[DataFrame, list[str]]:
    """The documents with neutral names for all columns but doc_id and text, so that none clashes with an operator's results."""
    names = [c if c in ("doc_id", "text") else f"_c{i}" for i, c in enumerate(docs.columns)]
    return docs.toDF(*names), names


def _back(df: DataFrame, names: list[str], columns: list[str]) -> DataFrame:
    return df.select(*[F.col(n).alias(c) for n, c in zip(names, columns, strict=True)])


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the line field scores at 0.5 or more. Null and empty texts, repeated rows and null ids are scored like others."""
    inner, names = _aside(docs)
    scored = crf.score(inner, crf.training_labels(spark, sf_dir), keep=tuple(names))
    return _back(scored.where(F.col("score") >= 0.5), names, docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of texts that are 80 % alike (op6's limit is 85 %), that with the least id; documents without an id stay."""
    gone = near_dedup.near_duplicates(docs, SIMILAR).where(F.col("doc_id").isNotNull() & ~F.col("kept")).select(F.col("doc_id").alias("_gone"))
    return docs.join(gone.hint("shuffle_hash"), F.col("doc_id") == F.col("_gone"), "left_anti")


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share no window with the benchmark; texts without words share none."""
    inner, names = _aside(docs)
    marked = decontam.decontaminate(inner, table(spark, sf_dir, "benchmark"), names)
    return _back(marked.where(~F.col("contaminated")), names, docs.columns)


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets masked in their texts; n_chars stays that of the source text."""
    return secrets.redact(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces with their sequence and offset."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality classifier", quality_classifier),
    ("MinHash near-dedup", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("secret scans", secret_scans),
    ("best-fit packing", best_fit_packing),
]

#: Trained models and tokenizers have no SQL form; the stages are tested one by one against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of all stages' documents. A written stage replaces the tables before it; those behind the pieces, which are
    computed when they are read, stay until the caller drops them with drop_tables()."""
    docs, before = table(spark, sf_dir, "documents"), tables_written()
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialise(docs, f"stage-{k}")
            drop_tables(spark, before, but_last=True)
    return docs
