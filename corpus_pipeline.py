"""From raw documents to packed training sequences: each stage calls one operator of ``medloom.llm``.

Documents that the quality classifier rejects go; of each group of near duplicates one stays; documents contaminated
by the benchmark go; secrets are masked; what is left is packed. All stages but the last return the columns of
``documents``.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from medloom.llm.base import table
from medloom.llm.decontamination import drop_contaminated
from medloom.llm.jaccard import keep_one
from medloom.llm.packing import pack
from medloom.llm.quality import keep_good
from medloom.llm.secrets import redact
from medloom.session import use_checkpoint_dir

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def keep_good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_good(docs, table(spark, sf_dir, "labels"))


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_one(docs)


def drop_contaminated_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return redact(docs)


def pack_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack(docs)


STAGES: list[tuple[str, Stage]] = [
    ("quality classifier", keep_good_documents),
    ("n-gram Jaccard join", keep_one_of_each_group),
    ("benchmark decontamination", drop_contaminated_documents),
    ("secret scans", mask_secrets),
    ("packing", pack_documents),
]
# Classifier, components and tokenizer are beyond SQL; the stages are tested against plain versions instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages; what one returns is written to the shared folder and read again as the next one's documents."""
    use_checkpoint_dir(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs.write.parquet(f"{folder}/{k}")
            docs = spark.read.parquet(f"{folder}/{k}")
    return docs


QUERIES = {"pipeline": run}
ORACLES = {} if ORACLE_SQL is None else {"pipeline": ORACLE_SQL}
