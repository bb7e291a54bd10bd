"""Sources (S1, S2, S8-S11): lines made from whole tables, broken, quoted and shuffled the way extracts are, and read back."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from driverqueries.common import table, texts
from medloom.session import use_checkpoint_dir
from medloom.sources import readers

LAB_HEADER = ["EMPI", "Group_Id", "Result", "Note", "Date"]
REPORT_HEADER = [
    "EMPI", "EPIC_PMRN", "MRN_Type", "MRN", "Report_Number", "Report_Date_Time", "Report_Description", "Report_Status",
    "Report_Type", "Report_Text",
]
ORDER_HEADER = ["key", "customer", "status", "priority", "clerk"]


def _lab_lines(spark, sf_dir):
    """Line items as lines; every quarter has a field too many or too few, and all have a delimiter in quotes."""
    items = table(spark, sf_dir, "lineitem")
    kind = F.col("l_linenumber") % 4
    fields = F.concat_ws(
        "|", F.col("l_orderkey").cast("string"),
        F.concat(F.lit('"'), F.col("l_linestatus"), F.lit("|"), F.col("l_linenumber").cast("string"), F.lit('"')),
        F.col("l_quantity").cast("int").cast("string"))
    rest = F.when(kind == 3, F.lit("|a|b|c")).when(kind == 2, F.lit("")).otherwise(F.concat(F.lit("|n|"), F.col("l_shipdate").cast("date").cast("string")))
    return items.select(F.col("l_returnflag").alias("source_file"), F.concat(fields, rest).alias("value"))


def lab_lines(spark, sf_dir):
    rows, malformed = readers.lab_lines(_lab_lines(spark, sf_dir), LAB_HEADER)
    kept = rows.select(*[F.coalesce(F.col(c), F.lit("-")).alias(c.lower()) for c in LAB_HEADER], F.lit("").alias("line"))
    lost = malformed.select(*[F.lit("").alias(c.lower()) for c in LAB_HEADER], "line")
    return kept.unionByName(lost)


def report_records(spark, sf_dir):
    """Documents as reports of many lines, one file per language."""
    number = F.col("doc_id").cast("string")
    status = F.when(F.col("doc_id") % 9 == 0, F.lit("Pending")).otherwise(F.lit("Final"))
    fields = [number, F.lit("1"), F.lit("MGH"), F.lit("2"), number, F.lit("1/2/2003"), F.lit("S"), status, F.lit("PAT"), F.col("text")]
    record = F.concat(F.concat_ws("|", *fields), F.lit(readers.REPORT_END))
    lines = texts(spark, sf_dir).select(
        F.col("lang").alias("source_file"), F.col("doc_id").alias("block"), F.posexplode(F.split(record, "\n")).alias("line", "value"))
    records = readers.records_of_lines(lines, rows_per_task=5000)
    out = readers.report_records(records, REPORT_HEADER, final_only=True)
    return out.select("report_id", F.md5("Report_Text").alias("text_md5"), F.col("Report_Status").alias("status"))


def broken_lines(spark, sf_dir):
    """Orders as lines, a third of them broken in the third field, some with a field too many."""
    orders = table(spark, sf_dir, "orders")
    key = F.col("o_orderkey")
    line = F.concat_ws("|", key.cast("string"), F.col("o_custkey").cast("string"), F.concat(F.lit("st"), "o_orderstatus"), "o_orderpriority", F.lit("c"))
    line = F.when(key % 11 == 1, F.concat(line, F.lit("|more"))).otherwise(line)
    at = F.locate("st", line)
    pieces = F.when(key % 3 == 0, F.array(F.substring(line, F.lit(1), at), F.substring(line, at + 1, F.length(line)))).otherwise(F.array(line))
    lines = orders.select(
        F.concat(F.lit("f"), (F.col("o_custkey") % 3).cast("string")).alias("source_file"), key.alias("block"),
        F.posexplode(pieces).alias("line", "value"))
    records, rejects = readers.procedure_lines(lines, ORDER_HEADER, rows_per_task=5000)
    kept = records.select(*[F.coalesce(F.col(c), F.lit("-")).alias(c) for c in ORDER_HEADER], F.lit("").alias("reject"))
    lost = rejects.select(*[F.lit("").alias(c) for c in ORDER_HEADER], F.col("value").alias("reject"))
    return kept.unionByName(lost)


def _folders(spark, sf_dir) -> str:
    """Suppliers and customers in sub-folders, with the columns in two orders and one missing, and a folder without."""
    use_checkpoint_dir(spark)
    root = f"{spark.sparkContext.getCheckpointDir()}/folders-{uuid.uuid4().hex}"
    supplier, customer = table(spark, sf_dir, "supplier"), table(spark, sf_dir, "customer")
    as_text = {"sep": "|", "header": True}
    supplier.select(F.col("s_suppkey").alias("key"), F.col("s_name").alias("name"), F.col("s_nationkey").alias("nation")).write.options(**as_text).csv(f"{root}/a")
    customer.select(F.col("c_name").alias("name"), F.col("c_custkey").alias("key")).write.options(**as_text).csv(f"{root}/b/c")
    customer.select("c_custkey").write.json(f"{root}/d")
    return root


def folder_headers(spark, sf_dir):
    out = readers.read_folders(spark, _folders(spark, sf_dir), "part-*.csv")
    return out.select("key", "name", "nation")


def folders_without_file(spark, sf_dir):
    out = readers.missing_folders(spark, _folders(spark, sf_dir), "part-*.csv")
    return out.select(F.substring_index("folder", "/", -1).alias("folder"))


QUERIES = {
    "lab_lines": lab_lines,
    "report_records": report_records,
    "broken_lines": broken_lines,
    "folder_headers": folder_headers,
    "folders_without_file": folders_without_file,
}

ORACLES = {
    "lab_lines": """
        WITH l AS (SELECT *, l_linenumber % 4 AS kind, l_linestatus || '|' || l_linenumber AS grp, CAST(CAST(l_quantity AS INT) AS VARCHAR) AS q FROM lineitem)
        SELECT CAST(l_orderkey AS VARCHAR) AS empi, grp AS group_id, q AS result, CASE WHEN kind = 2 THEN '-' ELSE 'n' END AS note,
          CASE WHEN kind = 2 THEN '-' ELSE CAST(CAST(l_shipdate AS DATE) AS VARCHAR) END AS date, '' AS line FROM l WHERE kind <> 3
        UNION ALL
        SELECT '', '', '', '', '', l_orderkey || '|"' || grp || '"|' || q || '|a|b|c' FROM l WHERE kind = 3""",
    "report_records": """
        SELECT doc_id || '_' || doc_id AS report_id, md5(text || '[report_end]') AS text_md5, 'Final' AS status
        FROM documents WHERE doc_id % 9 <> 0""",
    "broken_lines": """
        SELECT CASE WHEN o_orderkey % 11 <> 1 THEN CAST(o_orderkey AS VARCHAR) ELSE '' END AS key,
          CASE WHEN o_orderkey % 11 <> 1 THEN CAST(o_custkey AS VARCHAR) ELSE '' END AS customer,
          CASE WHEN o_orderkey % 11 <> 1 THEN 'st' || o_orderstatus ELSE '' END AS status,
          CASE WHEN o_orderkey % 11 <> 1 THEN o_orderpriority ELSE '' END AS priority,
          CASE WHEN o_orderkey % 11 <> 1 THEN 'c' ELSE '' END AS clerk,
          CASE WHEN o_orderkey % 11 = 1 THEN o_orderkey || '|' || o_custkey || '|st' || o_orderstatus || '|' || o_orderpriority || '|c|more'
            ELSE '' END AS reject
        FROM orders""",
    "folder_headers": """
        SELECT CAST(s_suppkey AS VARCHAR) AS key, s_name AS name, CAST(s_nationkey AS VARCHAR) AS nation FROM supplier
        UNION ALL SELECT CAST(c_custkey AS VARCHAR), c_name, NULL FROM customer""",
    "folders_without_file": "SELECT DISTINCT 'd' AS folder FROM customer",
}
