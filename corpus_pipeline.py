"""From raw documents to token ids: five stages, each a table that the next one reads.

1. toxicity: documents scored CUTOFF or more go; the model learns from the labelled ones among them.
2. near_duplicates: of each group of near copies (five words, 0.8) the one with the least id stays. Every row
   is a document of its own, also where ids are null (these come last) or repeated; texts without words stay.
3. decontamination: documents that hold a benchmark item go.
4. secrets: spans are replaced by their kind in brackets; n_chars follows.
5. pieces: the columns of documents with n_pieces and ids.

Null and empty texts pass every stage and have no ids; texts of any length are read whole. Copies that tie in
their id are one document, whichever stays. Other columns go through untouched, whatever their names, but for
n_pieces and ids, which the last stage replaces. Empty tables give empty tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.llm import decontaminate, minhash, pieces, secrets, toxicity
from siltstone.llm.tables import table, written


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.reject(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    row = _free("row", docs)
    rows = written(docs.withColumn(row, F.monotonically_increasing_id()))  # written, so that a row keeps its number
    classes = minhash.near_duplicates(rows.select(F.col(row).alias("doc_id"), "text")).where("n_shingles > 0")
    member = classes.select(F.col("doc_id").alias(row), F.col("component_id").alias("component")).join(rows.select(row, "doc_id"), row)
    first = member.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", row)).getField(row).alias("first"), F.count("*").alias("n"))
    gone = member.join(first.where("n > 1"), "component").where(F.col(row) != F.col("first")).select(row)
    return rows.join(gone, row, "left_anti").select(docs.columns)


def _free(name: str, df: DataFrame) -> str:
    """A column name that df doesn't have."""
    taken = {c.lower() for c in df.columns} | {"component", "first", "n"}
    while name in taken:
        name += "_"
    return name


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.redact(docs)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pieces.encode(docs).withColumn("n_pieces", F.size("ids").cast("long"))


STAGES = [
    ("toxicity", toxic),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("secrets", secret_scan),
    ("pieces", encoding),
]

#: A trained model and similarity groups: tests/llm/test_pipeline.py has a plain version instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir))
    return docs
