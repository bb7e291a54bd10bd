"""Shared readers and rounding for the driver's queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from medloom.functions.rewriting import rewritten


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents; one small file is one task, so it is spread over the cores if they outnumber its splits."""
    df = table(spark, sf_dir, "documents")
    cores = spark.sparkContext.defaultParallelism
    return df.repartition(cores, "doc_id") if df.rdd.getNumPartitions() < cores else df


def events(spark: SparkSession, sf_dir: str, *types: str) -> DataFrame:
    df = table(spark, sf_dir, "events")
    return df.filter(F.col("event_type").isin(*types)) if types else df


def r6(column: Column, digits: int = 6) -> Column:
    """Rounded for the comparison; adding zero turns -0.0 into 0.0."""
    return F.round(column, digits) + F.lit(0.0)


# The driver's texts are invented words. These replacements, one after the other, turn the frequent ones into
# report vocabulary, so that the report operators meet what they look for on whole tables of whole texts. All other
# letters stay as they are; patterns count ASCII letters, digits and "_" as word characters on both sides.
REPORT_WORDS = [
    ("The ", "Final Diagnosis:\nLIVER, core biopsy: "),
    ("And ", "Note: "),
    ("Of ", "Gross description:\n"),
    ("Ti", "IMPRESSION: "),
    ("Es ", "Recommendations: "),
    (" the ", " portal "),
    (" of ", " inflammation "),
    (" and ", " mild "),
    (" to ", " no "),
    (" a ", " zone 3 "),
    (" in ", " fibrosis "),
    (" that ", " lobular "),
    (" it ", " hepatitis "),
    (" for ", " moderate "),
    (" was ", " steatosis "),
    (" on ", " fibrosis stage 2-3 of 4 "),
    (" with ", " without "),
    (" be ", " bridging fibrosis "),
    (" by ", " biliary cirrhosis "),
    (" as ", " ulcerative colitis "),
    (" this ", " severe "),
    (" are ", " vascular "),
    (" at ", " loss of "),
    (" from ", " active "),
    (" th ", " is absent "),
    (" er ", " but "),
    (" an ", " normal colon "),
    (" nd ", " mayo 2 "),
    (" ha ", " proctitis "),
    (" re ", " shallow ulcer "),
    (" he ", " left "),
    (" ed ", " erythema "),
    (" ing ", " rather than "),
    (" ou ", " ishak stage 5/6 "),
    (" ble ", " granuloma "),
    (" ly ", " friable "),
    ("To ", "This was mild. "),
]
SITE_CODES = ["MGH", "BWH", "NWH", "FH", "NSM", "OTHER", "MGH"]


def _in_report_words(text: Column) -> Column:
    return rewritten(text, REPORT_WORDS)


def reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as reports: report_id, site and text in report vocabulary."""
    site = F.get(F.array(*[F.lit(s) for s in SITE_CODES]), (F.col("doc_id") % len(SITE_CODES)).cast("int"))
    return texts(spark, sf_dir).select(
        F.col("doc_id").alias("report_id"), site.alias("MRN_Type"), _in_report_words(F.col("text")).alias("Report_Text")
    )


def dialogues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of conversations as reports, keyed by conversation and turn."""
    key = F.concat_ws("_", F.col("conv_id").cast("string"), F.col("turn").cast("string"))
    return table(spark, sf_dir, "conversations").select(
        key.alias("report_id"), _in_report_words(F.col("text")).alias("Report_Text")
    )


def _sql_text(text: str) -> str:
    return " || chr(10) || ".join("'" + part.replace("'", "''") + "'" for part in text.split("\n"))


def nested_replace_sql(column: str, rules) -> str:
    for old, new in rules:
        column = f"replace({column}, {_sql_text(old)}, {_sql_text(new)})"
    return column


def _text_sql(column: str) -> str:
    return nested_replace_sql(column, REPORT_WORDS)


REPORTS_SQL = (
    "reports AS MATERIALIZED (SELECT doc_id AS report_id, CASE doc_id % 7 "
    + " ".join(f"WHEN {i} THEN '{s}'" for i, s in enumerate(SITE_CODES))
    + f" END AS site, {_text_sql('text')} AS txt FROM documents)"
)
DIALOGUES_SQL = (
    "reports AS MATERIALIZED (SELECT conv_id || '_' || turn AS report_id, "
    + f"{_text_sql('text')} AS txt FROM conversations)"
)
