"""Report sections: walk the lines of a report, take the first that fits, cut the text there.

Line positions count from 0; -1 means no line. Everything stays in the row: no explode, no shuffle.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from medloom.functions.text import (
    ascii_bounds, collapse_spaces, contains_any, count_words, has_word, is_lower_word, is_upper_word, literal, words,
)
from medloom.operators.tables import require_columns, set_where
from medloom.rules import report_sections as fixed

LineTest = Callable[[Column], Column]


def strip(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def lines_of(text: Column) -> Column:
    return F.split(text, "\n")


def first_hit(lines: Column, test: LineTest) -> Column:
    """Position of the first line that fits, or -1."""
    return F.coalesce(F.array_position(F.transform(lines, test), True).cast("int") - 1, F.lit(-1))


def first_hit_after(lines: Column, test: LineTest, position: Column) -> Column:
    """Position of the first line that fits after ``position``, else of the first that fits at all."""
    hits = F.filter(
        F.transform(lines, lambda line, i: F.when(test(line), i.cast("int"))), lambda i: i.isNotNull()
    )
    later = F.get(F.filter(hits, lambda i: i > position), F.lit(0))
    return F.coalesce(later, F.get(hits, F.lit(0)), F.lit(-1))


def line_at(lines: Column, position: Column) -> Column:
    return F.when(position >= 0, F.get(lines, position)).otherwise("")


def text_from(lines: Column, position: Column) -> Column:
    return F.array_join(F.slice(lines, position + 1, F.size(lines)), "\n")


def text_before(lines: Column, position: Column) -> Column:
    return F.array_join(F.slice(lines, F.lit(1), position), "\n")


def text_between(lines: Column, first: Column, last: Column) -> Column:
    """Lines strictly between two positions, joined and space-collapsed."""
    inner = F.slice(lines, first + 2, F.greatest(last - first - 1, F.lit(0)))
    return collapse_spaces(F.array_join(inner, " "))


def _cut(
    df: DataFrame, text: str, test: LineTest, eligible: Column, keep: str, flag: str, line: str, position: str | None,
    update: bool,
) -> DataFrame:
    """Find the first fitting line on eligible rows, add flag, line and position, and cut the text there."""
    lines = lines_of(F.col(text))
    hit = set_where(df, eligible, {"_hit": (first_hit(lines, test), F.lit(-1))}, update)
    at = F.col("_hit")
    part = text_from(lines, at) if keep == "from" else text_before(lines, at)
    out = hit.select(
        *[c for c in df.columns if c not in (text, flag, line, position)],
        F.when(at >= 0, part).otherwise(F.col(text)).alias(text),
        (at >= 0).alias(flag),
        line_at(lines, at).alias(line),
        *([at.alias(position)] if position else []),
    )
    return out


def _gate(df: DataFrame, flag: str | None) -> Column:
    if flag is None:
        return F.lit(True)
    require_columns(df, flag)
    return F.col(flag)


def cut_before_line(
    df: DataFrame, text: str, test: LineTest, flag: str, line: str, position: str | None = None,
    eligible: Column | None = None, update: bool = True,
) -> DataFrame:
    """Drop everything above the first fitting line."""
    return _cut(df, text, test, F.lit(True) if eligible is None else eligible, "from", flag, line, position, update)


def cut_from_line(
    df: DataFrame, text: str, test: LineTest, flag: str, line: str, position: str | None = None,
    eligible: Column | None = None, update: bool = True,
) -> DataFrame:
    """Drop the first fitting line and everything below it."""
    return _cut(df, text, test, F.lit(True) if eligible is None else eligible, "before", flag, line, position, update)


def mark_line(
    df: DataFrame, text: str, test: LineTest, flag: str, line: str, position: str,
    eligible: Column | None = None, update: bool = True, after: str | None = None,
) -> DataFrame:
    """Add flag, line and position of the first fitting line, preferring one after column ``after``."""
    lines = lines_of(F.col(text))
    hit = first_hit(lines, test) if after is None else first_hit_after(lines, test, F.col(after))
    everywhere = F.lit(True) if eligible is None else eligible
    found = set_where(df, everywhere, {position: (hit, F.lit(-1))}, update)
    at = F.col(position)
    return found.withColumns({flag: at >= 0, line: line_at(lines, at)})


# Line tests of pathology and endoscopy reports.


def is_diagnosis_heading(line: Column) -> Column:
    low = F.lower(strip(line))
    qualified = contains_any(line, fixed.DIAGNOSIS_QUALIFIERS) & low.contains("diagnosis")
    heading = (
        qualified
        | low.startswith("diagnosis:")
        | (strip(line) == "Diagnosis")
        | line.startswith("SPECIMEN(S):")
    )
    return heading & ~contains_any(low, fixed.DIAGNOSIS_EXCLUSIONS)


def is_lower_section(line: Column) -> Column:
    low = F.lower(line)
    return (
        contains_any(collapse_spaces(line), fixed.LOWER_SECTION_EXACT)
        | contains_any(collapse_spaces(low), fixed.LOWER_SECTION_ANY_CASE)
        | contains_any(low, fixed.LOWER_SECTION_RAW)
        | (line == fixed.LOWER_SECTION_LINE)
    )


def is_heading_case(line: Column) -> Column:
    """Not prose: few lower-case words, or some upper-case ones among them."""
    lower, upper = count_words(line, is_lower_word), count_words(line, is_upper_word)
    prose = (lower > fixed.PROSE_LOWER_WORDS) & (upper < fixed.PROSE_UPPER_WORDS)
    return ~prose & (lower <= fixed.MOST_LOWER_WORDS)


def is_specimen_line(line: Column) -> Column:
    low = F.regexp_replace(F.lower(line), r"^\s+", "")
    named = has_word(low, *fixed.ORGAN_WORDS) & has_word(low, *map(literal, fixed.SPECIMEN_WORDS))
    resected = low.contains(fixed.RESECTION) & has_word(low, *fixed.RESECTION_SIDES)
    listed = low.rlike(ascii_bounds("|".join(fixed.SPECIMEN_LISTS)))
    excluded = contains_any(low, fixed.SPECIMEN_EXCLUSIONS) | low.startswith(fixed.SPECIMEN_EXCLUDED_START)
    return (named | resected | listed) & ~excluded & is_heading_case(line)


def starts_note(line: Column) -> Column:
    """The first or second word names a note or comment and is not the end of a "(see note)"."""
    parts = words(F.lower(line))

    def names_note(place: int) -> Column:
        word = F.get(parts, F.lit(place))
        return F.coalesce(contains_any(word, fixed.NOTE_WORDS) & ~word.contains(")"), F.lit(False))

    return names_note(0) | names_note(1)


def contains_marker(markers: list[str]) -> LineTest:
    return lambda line: contains_any(F.lower(line), markers)


def cut_final_diagnosis(df: DataFrame, text="Report_Text", site="MRN_Type") -> DataFrame:
    """Pathology text from the final-diagnosis heading on, for the known sites, autopsies left alone."""
    eligible = F.col(site).isin(fixed.SITES) & ~has_word(F.lower(text), *fixed.OTHER_EXAMINATION_WORDS)
    return cut_before_line(
        df, text, is_diagnosis_heading, "has_final_diagnosis", "final_diagnosis_line", eligible=eligible
    )


def cut_lower_section(
    df: DataFrame, text="Report_Text", site="MRN_Type", update=True, only_final_diagnosis=True
) -> DataFrame:
    gate = F.col(site).isin(fixed.SITES) & _gate(df, "has_final_diagnosis" if only_final_diagnosis else None)
    return cut_from_line(
        df, text, is_lower_section, "has_lowersec", "lowersec_line", "lowersec_start_LAFD", gate, update
    )


def mark_liver_biopsy(df: DataFrame, text="Report_Text", update=True, only_final_diagnosis=True) -> DataFrame:
    gate = _gate(df, "has_final_diagnosis" if only_final_diagnosis else None)
    return mark_line(
        df, text, is_specimen_line, "is_liver_biopsy", "is_liver_biopsy_line", "liver_biopsy_LAFD", gate, update
    )


def mark_note_start(
    df: DataFrame, text="Report_Text", site="MRN_Type", update=True, only_final_diagnosis=True
) -> DataFrame:
    require_columns(df, "is_liver_biopsy", "liver_biopsy_LAFD")
    gate = _gate(df, "has_final_diagnosis" if only_final_diagnosis else None)
    eligible = (F.col(site) == fixed.NOTE_SITE) & gate
    return mark_line(
        df, text, starts_note, "has_note_start", "note_line", "note_start_LAFD", eligible, update,
        after="liver_biopsy_LAFD",
    )


def extract_final_diagnosis(df: DataFrame, text="Report_Text", site="MRN_Type", update=True) -> DataFrame:
    """Text between the specimen line and the note that follows it."""
    require_columns(df, "is_liver_biopsy", "has_note_start")
    eligible = (F.col(site) == fixed.NOTE_SITE) & F.col("is_liver_biopsy")
    first, last = F.col("liver_biopsy_LAFD"), F.col("note_start_LAFD")
    found = last > first
    between = text_between(lines_of(F.col(text)), first, last)
    return set_where(
        df,
        eligible,
        {
            "has_finaldx_text": (found, F.lit(False)),
            "finaldx_text": (F.when(found, between).otherwise(""), F.lit("")),
            "finaldx_LAFD": (F.when(found, first + 1).otherwise(-1), F.lit(-1)),
        },
        update,
    )


def cut_endoscopy_start(df: DataFrame, text="Report_Text", site="MRN_Type") -> DataFrame:
    return cut_before_line(
        df, text, contains_marker(fixed.ENDOSCOPY_STARTS), "has_dx_start", "dx_start_line",
        eligible=F.col(site).isin(fixed.SITES),
    )


def cut_endoscopy_end(
    df: DataFrame, text="Report_Text", site="MRN_Type", update=True, only_dx_start=True
) -> DataFrame:
    gate = F.col(site).isin(fixed.SITES) & _gate(df, "has_dx_start" if only_dx_start else None)
    return cut_from_line(
        df, text, contains_marker(fixed.ENDOSCOPY_ENDS), "has_dx_end", "dx_end_line", "dx_end_line_LAFD", gate, update
    )
