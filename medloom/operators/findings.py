"""One tri-state column per finding and report: null never mentioned, else whether any mention affirms it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from medloom.operators.mentions import Extractor, mentions
from medloom.operators.sections import _gate
from medloom.rules import colon, liver
from medloom.rules.need import any_holds
from medloom.rules.report_sections import SITES


def tri_state(rule: Column, affirmed: str = "affirmed") -> Column:
    return F.bool_or(F.when(rule, F.col(affirmed)))


def finding_columns(rules) -> dict[str, Column]:
    return {name: tri_state(any_holds(F.col("text"), needs)) for name, needs in rules.FINDINGS.items()}


def _states_finding(rules) -> Column:
    return any_holds(F.col("text"), [need for needs in rules.FINDINGS.values() for need in needs])


def ordered_list(when: Column) -> Column:
    """Mention texts in report order; the group is the mentions of one report."""
    place = F.struct("sent_no", "segment_no", "ent_no", "text")
    return F.transform(F.array_sort(F.collect_list(F.when(when, place))), lambda m: m["text"])


def first_stage(scale: int) -> Column:
    return F.min_by(
        F.when(F.col("stage_scale") == scale, F.col("stage")),
        F.when(F.col("stage_scale") == scale, F.struct("sent_no", "segment_no", "ent_no")),
    )


def liver_findings(mention_rows: DataFrame, key: str) -> DataFrame:
    """45 findings, the first stage on each scale and the list of stated mentions, per report."""
    listed = (F.col("affirmed") & _states_finding(liver)) | F.col("stage").isNotNull()
    return mention_rows.groupBy(key).agg(
        *[col.alias(name) for name, col in finding_columns(liver).items()],
        *[first_stage(scale).alias(f"fibrosis_stage_{scale}") for scale in liver.STAGE_SCALES],
        ordered_list(listed).alias("disease_list"),
    )


def colon_findings(rows: DataFrame, key: str) -> DataFrame:
    """65 findings, the capped score and the list of affirmed mentions, per report, from scored mention rows.

    A report's greatest score counts as one more affirmed mention of colitis, after all others.
    """
    states = _states_finding(colon)
    found = rows.groupBy(key).agg(
        *[col.alias(name) for name, col in finding_columns(colon).items()],
        F.max("score").alias("_score"), ordered_list(F.col("affirmed") & states).alias("disease_list"),
    )
    graded = found.withColumn("text", F.concat(F.lit("colitis mayo-"), F.col("_score").cast("string")))
    stated = {
        name: F.coalesce(any_holds(F.col("text"), needs), F.lit(False)) for name, needs in colon.FINDINGS.items()
    }
    return graded.select(
        key, *[F.when(also, F.lit(True)).otherwise(F.col(name)).alias(name) for name, also in stated.items()],
        F.least(F.col("_score"), F.when(F.col("_score").isNotNull(), F.lit(float(colon.SCORE_CAP)))).alias("mayo_score"),
        F.when(states, F.array_append("disease_list", F.col("text"))).otherwise(F.col("disease_list")).alias("disease_list"),
    )


def _attach(df: DataFrame, chosen: DataFrame, found: DataFrame, key: str, update: bool) -> DataFrame:
    return (df if update else chosen).join(found, key, "left")


def add_liver_findings(
    df: DataFrame, key: str = "report_id", text: str = "Report_Text", site: str = "MRN_Type", update: bool = True,
    only_liver_biopsy: bool = True, extractor: Extractor | None = None,
) -> DataFrame:
    """Reports with the liver findings; reports outside the gate keep nulls, or are left out without ``update``."""
    gate = F.col(site).isin(SITES) & _gate(df, "is_liver_biopsy" if only_liver_biopsy else None)
    chosen = df.filter(gate)
    found = liver_findings(mentions(chosen, key, text, liver, extractor), key)
    return _attach(df, chosen, found, key, update)


def add_colon_findings(
    df: DataFrame, key: str = "report_id", text: str = "Report_Text", site: str = "MRN_Type", update: bool = True,
    only_truncated: bool = False, extractor: Extractor | None = None,
) -> DataFrame:
    gate = F.col(site).isin(SITES) & _gate(df, "has_final_diagnosis" if only_truncated else None)
    chosen = df.filter(gate)
    found = colon_findings(mentions(chosen, key, text, colon, extractor, scored=True), key)
    return _attach(df, chosen, found, key, update)
