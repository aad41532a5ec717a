"""A corpus from documents to packed sequences: five stages, each written as Parquet and read by the next.

Defined results of the first four stages: rows keep all their columns, whatever their names, and only text and, if it is
there as a whole number, n_chars may change; an empty table stays empty.

* quality_classifier: documents with a score below the threshold go. A null text, or one without a non-empty line, has
  the score of the sample's share of good documents. Repeated rows are scored one by one.
* near_duplicates: one row of each group stays, that of the least doc_id. Rows without words are groups of their own by
  doc_id; those without doc_id too all stay. Repeated rows are copies.
* decontamination: documents with two benchmark items go; the passages of a single item are cut out of the others.
  Null and empty texts have none.
* secret_scans: secrets and linked parts are replaced; null and empty texts stay as they are.
* packing: a null text is packed as its end id alone; repeated rows are documents of their own; null doc_ids stay null.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from weftwork.llm import decontaminate, jaccard, packing, quality_crf, secrets
from weftwork.llm.common import table, write_shared


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the line classifier takes for good ones."""
    model = quality_crf.fit(docs.select("doc_id", "text"), table(spark, sf_dir, "labels"))
    return quality_crf.good_ones(docs, model)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return jaccard.one_of_each(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """No contaminated documents; what is left of a single benchmark item is cut out."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets and linked parts replaced in the texts."""
    return secrets.redact(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences."""
    return packing.packed(docs)


STAGES = [
    ("quality_classifier", quality),
    ("near_duplicates", near_duplicates),
    ("decontamination", benchmark),
    ("secret_scans", secret_scan),
    ("packing", packed),
]

#: SQL can express neither the classifier nor the packing; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = write_shared(docs, f"pipeline-{name}")
    return docs
