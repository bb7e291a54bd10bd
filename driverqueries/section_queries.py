"""Report sections and line tests."""

from __future__ import annotations

from pyspark.sql import functions as F

from driverqueries.common import REPORTS_SQL, reports
from medloom.operators import sections


def _digest(df, *columns):
    return df.select("report_id", *columns, F.md5("Report_Text").alias("text_md5"))


def section_start(spark, sf_dir):
    out = sections.cut_final_diagnosis(reports(spark, sf_dir))
    return _digest(out, "has_final_diagnosis", "final_diagnosis_line")


def section_end(spark, sf_dir):
    out = sections.cut_lower_section(sections.cut_final_diagnosis(reports(spark, sf_dir)))
    return _digest(out, "has_lowersec", "lowersec_line", "lowersec_start_LAFD")


def endoscopy_sections(spark, sf_dir):
    out = sections.cut_endoscopy_end(sections.cut_endoscopy_start(reports(spark, sf_dir)))
    return _digest(out, "has_dx_start", "dx_start_line", "has_dx_end", "dx_end_line_LAFD")


def line_first_hit(spark, sf_dir):
    out = sections.mark_liver_biopsy(reports(spark, sf_dir), only_final_diagnosis=False)
    return out.select("report_id", "is_liver_biopsy", "is_liver_biopsy_line", "liver_biopsy_LAFD")


def heading_lines(spark, sf_dir):
    lines = sections.lines_of(F.col("Report_Text"))
    return reports(spark, sf_dir).select(
        "report_id",
        F.size(lines).cast("bigint").alias("n_lines"),
        F.size(F.filter(lines, sections.is_heading_case)).cast("bigint").alias("n_headings"),
    )


def _marked(spark, sf_dir):
    df = sections.mark_liver_biopsy(reports(spark, sf_dir), only_final_diagnosis=False)
    return sections.mark_note_start(df, only_final_diagnosis=False)


def note_after_marker(spark, sf_dir):
    return _marked(spark, sf_dir).select("report_id", "has_note_start", "note_line", "note_start_LAFD")


def section_between(spark, sf_dir):
    out = sections.extract_final_diagnosis(_marked(spark, sf_dir))
    return out.select("report_id", "has_finaldx_text", F.md5("finaldx_text").alias("finaldx_md5"), "finaldx_LAFD")


_START = """
pred AS (
  SELECT *, site IN ('MGH', 'BWH', 'NWH', 'FH', 'NSM')
    AND NOT regexp_matches(lower(txt), '\\b(fetus|fetopsy|autopsy)\\b') AS ok FROM reports),
dx AS (
  SELECT report_id, site, txt, ok, unnest(string_split(txt, chr(10))) AS line,
    generate_subscripts(string_split(txt, chr(10)), 1) - 1 AS i FROM pred),
hits AS (
  SELECT report_id, min(i) AS i FROM dx WHERE ok
    AND ((regexp_matches(line, 'Final|Pathologic|FINAL|PATHOLOGIC') AND lower(line) LIKE '%diagnosis%')
      OR regexp_matches(lower(line), '^\\s*diagnosis:') OR regexp_matches(line, '^\\s*Diagnosis\\s*$')
      OR line LIKE 'SPECIMEN(S):%')
    AND NOT regexp_matches(lower(line), 'amend|final diagnosis by|clinical data|cytogenetic|reason for|'
      || 'gross description|original|epithelial|unsatisfactory for evaluation|clinical history')
  GROUP BY report_id),
started AS (
  SELECT p.report_id, p.site, h.i IS NOT NULL AS has_final_diagnosis,
    CASE WHEN h.i IS NULL THEN '' ELSE string_split(txt, chr(10))[h.i + 1] END AS final_diagnosis_line,
    CASE WHEN h.i IS NULL THEN txt ELSE array_to_string(string_split(txt, chr(10))[h.i + 1:], chr(10)) END AS txt
  FROM pred p LEFT JOIN hits h ON h.report_id = p.report_id)
"""

_BIOPSY = """
alllines AS (
  SELECT report_id, unnest(string_split(txt, chr(10))) AS line,
    generate_subscripts(string_split(txt, chr(10)), 1) - 1 AS i FROM reports),
cased AS (
  SELECT *, len(list_filter(regexp_split_to_array(line, '\\s+'), lambda w: w <> '' AND w = lower(w) AND w <> upper(w))) AS lc,
    len(list_filter(regexp_split_to_array(line, '\\s+'), lambda w: w <> '' AND w = upper(w) AND w <> lower(w))) AS uc
  FROM alllines),
bx AS (
  SELECT report_id, min(i) AS bi FROM cased
  WHERE ((regexp_matches(lower(line), '\\b(liver|hepatic)\\b') AND regexp_matches(lower(line),
      '\\b(biopsy|biopsies|lobe|random|non-focal|nonfocal|non focal|core|cores|specimen|mass|lesion|tissue|parenchyma|'
      || 'operation|segment|segments|excision|nodule|explant|resection|hepatectomy|lobectomy|native)\\b'))
    OR (lower(line) LIKE '%hepatectomy%' AND regexp_matches(lower(line), '\\b(left|right|partial|central)\\b'))
    OR regexp_matches(lower(line), '^\\s*[a-f][.].*\\bliver\\b')
    OR regexp_matches(lower(line), '^\\s*[a-f]/1.*\\bliver\\b')
    OR regexp_matches(lower(line), '\\bliver\\b.*:'))
    AND NOT regexp_matches(lower(line), 'colon|renal|kidney|flexure|flex|metastatic|glomerulosclerosis|lymph|brush|'
      || 'artery|fluid|cautery artifact|duct|clinical data|gross description|original pathologic|fna|aspiration|'
      || 'bile|history|^\\s*specimen:')
    AND NOT (lc > 3 AND uc < 3) AND lc <= 8
  GROUP BY report_id),
biopsy AS (
  SELECT r.report_id, r.site, r.txt, string_split(r.txt, chr(10)) AS ls, coalesce(bi, -1) AS bi
  FROM reports r LEFT JOIN bx ON bx.report_id = r.report_id)
"""

_NOTE = _BIOPSY + """,
firstwords AS (
  SELECT a.report_id, a.i, b.bi, list_filter(string_split(lower(a.line), ' '), lambda w: w <> '')[1:2] AS ws
  FROM alllines a JOIN biopsy b ON b.report_id = a.report_id WHERE b.site = 'MGH'),
nt AS (
  SELECT report_id, coalesce(min(i) FILTER (i > bi), min(i)) AS ni FROM firstwords
  WHERE len(list_filter(ws, lambda w: regexp_matches(w, 'note|comment') AND NOT contains(w, ')'))) > 0
  GROUP BY report_id),
noted AS (
  SELECT b.*, coalesce(ni, -1) AS ni FROM biopsy b LEFT JOIN nt ON nt.report_id = b.report_id)
"""

QUERIES = {
    "section_start": section_start,
    "section_end": section_end,
    "endoscopy_sections": endoscopy_sections,
    "line_first_hit": line_first_hit,
    "heading_lines": heading_lines,
    "note_after_marker": note_after_marker,
    "section_between": section_between,
}

ORACLES = {
    "section_start": f"""WITH {REPORTS_SQL}, {_START}
        SELECT report_id, has_final_diagnosis, final_diagnosis_line, md5(txt) AS text_md5 FROM started""",
    "section_end": f"""WITH {REPORTS_SQL}, {_START},
        low AS (
          SELECT report_id, unnest(string_split(txt, chr(10))) AS line,
            generate_subscripts(string_split(txt, chr(10)), 1) - 1 AS i
          FROM started WHERE has_final_diagnosis AND site IN ('MGH', 'BWH', 'NWH', 'FH', 'NSM')),
        lowhit AS (
          SELECT report_id, min(i) AS i FROM low WHERE
            regexp_matches(regexp_replace(line, ' +', ' ', 'g'),
              'CLINICAL DATA|Final Diagnosis by|Reports to:|SPECIMEN TYPE:')
            OR regexp_matches(regexp_replace(lower(line), ' +', ' ', 'g'), 'by his/her signature below|'
              || 'electronically signed out|diagnosis by:|gross description:|o\\. r\\. consultation report:')
            OR contains(lower(line), 'clinical diagnosis & history')
            OR contains(lower(line), 'pathology dept report date/time') OR line = 'Clinical History:'
          GROUP BY report_id)
        SELECT s.report_id, h.i IS NOT NULL AS has_lowersec,
          CASE WHEN h.i IS NULL THEN '' ELSE string_split(txt, chr(10))[h.i + 1] END AS lowersec_line,
          CAST(coalesce(h.i, -1) AS INT) AS "lowersec_start_LAFD",
          md5(CASE WHEN h.i IS NULL THEN txt ELSE array_to_string(string_split(txt, chr(10))[1:h.i], chr(10)) END)
            AS text_md5
        FROM started s LEFT JOIN lowhit h ON h.report_id = s.report_id""",
    "endoscopy_sections": f"""WITH {REPORTS_SQL},
        pos AS (
          SELECT *, CASE WHEN site <> 'OTHER' THEN list_position(list_transform(string_split(txt, chr(10)),
            lambda l: regexp_matches(lower(l), 'findings:|impression:')), true) END AS p FROM reports),
        cut AS (
          SELECT report_id, site, p IS NOT NULL AS has_dx_start,
            CASE WHEN p IS NULL THEN '' ELSE string_split(txt, chr(10))[p] END AS dx_start_line,
            CASE WHEN p IS NULL THEN txt ELSE array_to_string(string_split(txt, chr(10))[p:], chr(10)) END AS t FROM pos),
        pos2 AS (
          SELECT *, CASE WHEN has_dx_start THEN list_position(list_transform(string_split(t, chr(10)),
            lambda l: regexp_matches(lower(l), 'recommendation:|recommend:|recommendations:|procedure codes:|'
              || 'procedure code\\(s\\):')), true) END AS q FROM cut)
        SELECT report_id, has_dx_start, dx_start_line, q IS NOT NULL AS has_dx_end,
          CAST(coalesce(q - 1, -1) AS INT) AS "dx_end_line_LAFD",
          md5(CASE WHEN q IS NULL THEN t ELSE array_to_string(string_split(t, chr(10))[1:q - 1], chr(10)) END) AS text_md5
        FROM pos2""",
    "line_first_hit": f"""WITH {REPORTS_SQL}, {_BIOPSY}
        SELECT report_id, bi >= 0 AS is_liver_biopsy,
          CASE WHEN bi >= 0 THEN ls[bi + 1] ELSE '' END AS is_liver_biopsy_line,
          CAST(bi AS INT) AS "liver_biopsy_LAFD" FROM biopsy""",
    "heading_lines": f"""WITH {REPORTS_SQL}, {_BIOPSY}
        SELECT report_id, count(*) AS n_lines, count(*) FILTER (NOT (lc > 3 AND uc < 3) AND lc <= 8) AS n_headings
        FROM cased GROUP BY report_id""",
    "note_after_marker": f"""WITH {REPORTS_SQL}, {_NOTE}
        SELECT report_id, ni >= 0 AS has_note_start, CASE WHEN ni >= 0 THEN ls[ni + 1] ELSE '' END AS note_line,
          CAST(ni AS INT) AS "note_start_LAFD" FROM noted""",
    "section_between": f"""WITH {REPORTS_SQL}, {_NOTE}
        SELECT report_id, site = 'MGH' AND bi >= 0 AND ni > bi AS has_finaldx_text,
          md5(CASE WHEN site = 'MGH' AND bi >= 0 AND ni > bi
            THEN trim(regexp_replace(array_to_string(ls[bi + 2:ni], ' '), ' +', ' ', 'g')) ELSE '' END) AS finaldx_md5,
          CAST(CASE WHEN site = 'MGH' AND bi >= 0 AND ni > bi THEN bi + 1 ELSE -1 END AS INT) AS "finaldx_LAFD"
        FROM noted""",
}
