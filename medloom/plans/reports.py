"""From a report extract to findings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from medloom.operators import findings, sections
from medloom.operators.mentions import Extractor
from medloom.sources.readers import read_reports


def pathology_sections(reports: DataFrame) -> DataFrame:
    """Final diagnosis, lower section, specimen line, note and the text between the last two."""
    out = sections.cut_final_diagnosis(reports)
    out = sections.cut_lower_section(out)
    out = sections.mark_liver_biopsy(out)
    out = sections.mark_note_start(out)
    return sections.extract_final_diagnosis(out)


def pathology_findings(
    spark: SparkSession, root: str, file_name: str, extractor: Extractor | None = None
) -> DataFrame:
    reports = read_reports(spark, root, file_name, final_only=True)
    return findings.add_liver_findings(pathology_sections(reports), extractor=extractor)


def endoscopy_findings(
    spark: SparkSession, root: str, file_name: str, extractor: Extractor | None = None
) -> DataFrame:
    reports = read_reports(spark, root, file_name)
    cut = sections.cut_endoscopy_end(sections.cut_endoscopy_start(reports))
    return findings.add_colon_findings(cut, extractor=extractor)
