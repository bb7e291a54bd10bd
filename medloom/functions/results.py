"""Laboratory results: numbers in text, censoring signs, numeric coercion and antibody titers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The tests whose results are plain numbers, and those reported as antibody titers.
NUMERIC_TESTS = ["ALT", "AST", "AKP", "DBILI", "TBILI", "CR", "INR", "IGG"]
TITER_TESTS = ["LKM", "ASMA", "ANA", "AMA", "SLA"]

# Fixed values of the titer reading.
TITER_CUTOFF = 20
POSITIVE_WINDOW = 26
TITER_WINDOW = 17
SEE_TITER = ["ANA SCREEN POSITIVE, TITRE PERFORMED", "POSITIVE - SEE TITER"]

NUMBER = r"(-?\d+\.?\d*)"


def numbers_in(text: Column) -> Column:
    """All numbers in order, signed, with optional decimals; "40-80" gives 40 and -80."""
    return F.transform(F.regexp_extract_all(text, F.lit(NUMBER), F.lit(1)), lambda x: x.cast("double"))


def window_from_word(text: Column, word: str, length: int) -> Column:
    """``length`` characters from the word's first occurrence on; null when it does not occur."""
    at = F.locate(word, F.lower(text))
    return F.when(at > 0, F.substr(text, at, F.lit(length)))


def numbers_near(text: Column, word: str, length: int) -> Column:
    return F.coalesce(numbers_in(window_from_word(text, word, length)), F.array().cast("array<double>"))


def censoring_flag(result: Column) -> Column:
    """-1 below, 1 above the assay's limit, else 0; "<" wins over ">"."""
    return F.when(result.contains("<"), -1).when(result.contains(">"), 1).otherwise(0)


def strip_sign(result: Column) -> Column:
    """Without the "<" signs, or without the ">" signs where there is no "<"."""
    return F.when(result.contains("<"), F.replace(result, F.lit("<"), F.lit(""))).otherwise(
        F.replace(result, F.lit(">"), F.lit(""))
    )


def to_number(text: Column) -> Column:
    """Double, or null when the text is not a number."""
    value = F.trim(text).try_cast("double")
    return F.when(~F.isnan(value), value)


def _ratio(numbers: Column, at_four: bool = False) -> Column:
    """A lone number, or the second of a pair 1:n; of two pairs the second one if it is 1:n."""
    size = F.size(numbers)
    out = F.when(size == 1, F.get(numbers, F.lit(0))).when(
        (size == 2) & (F.get(numbers, F.lit(0)) == 1), F.get(numbers, F.lit(1))
    )
    if at_four:
        out = out.when((size == 4) & (F.get(numbers, F.lit(2)) == 1), F.get(numbers, F.lit(3)))
    return out


def _says(text: Column) -> tuple[Column, Column]:
    """(positive, negative): which of the two words the text has."""
    low = F.lower(text)
    return low.contains("positive"), low.contains("negative")


def _positive_result(numbers: Column, comment: Column) -> Column:
    """A result that is positive only: its own titer, else the one in the comment, else the cutoff."""
    comment_positive, _ = _says(comment)
    near = numbers_near(comment, "positive", POSITIVE_WINDOW)
    after_titer = numbers_near(comment, "titer", TITER_WINDOW)
    from_comment = F.coalesce(_ratio(near), F.when(F.size(near) > 2, _ratio(after_titer)))
    return F.coalesce(
        _ratio(numbers, at_four=True),
        F.when(comment_positive, from_comment).when(comment.isNotNull(), F.lit(float(TITER_CUTOFF))),
    )


def _mixed_result(result: Column) -> Column:
    """Both words: the titer next to "positive", else the second number from there on."""
    tail = F.substr(result, F.locate("positive", F.lower(result)))
    return F.coalesce(
        _ratio(numbers_near(result, "positive", POSITIVE_WINDOW)), F.get(numbers_in(tail), F.lit(1))
    )


def _comment_only(comment: Column) -> Column:
    """The result is missing and the comment has to tell."""
    positive, negative = _says(comment)
    near = numbers_near(comment, "positive", POSITIVE_WINDOW)
    stated = F.regexp_extract(F.lower(comment), r"positive at 1:(\d+)", 1)
    positive_only = F.coalesce(
        _ratio(near, at_four=True),
        F.when(F.size(near) > 0, F.coalesce(stated.try_cast("double"), F.array_max(near))),
    )
    mixed = F.coalesce(
        _ratio(near),
        F.when(F.size(near) == 4, F.array_max(near)).when(F.lower(comment).contains("negative at"), F.lit(0.0)),
    )
    return (
        F.when(negative & ~positive, F.lit(0.0))
        .when(positive & ~negative, positive_only)
        .when(positive & negative, mixed)
        .otherwise(_ratio(numbers_in(comment)))
    )


def titer_value(result: Column, comment: Column) -> Column:
    """The titer that a result and its free-text comment state; null when they state none."""
    plain = to_number(result)
    positive, negative = _says(result)
    numbers = numbers_in(result)
    see_titer = result.contains(SEE_TITER[0]) | result.contains(SEE_TITER[1])
    return (
        F.when(result.isNull(), F.when(comment.isNotNull(), _comment_only(comment)))
        .when(plain < TITER_CUTOFF, F.lit(0.0))
        .when(plain.isNotNull(), plain)
        .when(result.contains("<"), F.lit(0.0))
        .when(see_titer, F.lit(None).cast("double"))
        .when(negative & ~positive, F.lit(0.0))
        .when(positive & ~negative, _positive_result(numbers, comment))
        .when(positive & negative, _mixed_result(result))
        .otherwise(_ratio(numbers))
    )


def interpret_results(
    df: DataFrame,
    test: str = "test_desc",
    result: str = "result",
    comment: str = "Result_Text",
    numeric_tests: list[str] | None = None,
    titer_tests: list[str] | None = None,
    flag: str = "above_below_assay_limit",
) -> DataFrame:
    """Numeric value, censoring flag and ``rejected`` per row.

    Results of tests in neither list keep their text in ``<result>_orig`` and are never rejected.
    """
    numeric = F.col(test).isin(numeric_tests or NUMERIC_TESTS)
    titer = F.col(test).isin(titer_tests or TITER_TESTS)
    raw = F.col(result).cast("string")
    value = F.when(numeric, to_number(strip_sign(raw))).when(titer, titer_value(raw, F.col(comment))).otherwise(
        to_number(raw)
    )
    listed = [*(numeric_tests or NUMERIC_TESTS), *(titer_tests or TITER_TESTS)]
    sign = F.when(F.coalesce(numeric, F.lit(False)), F.coalesce(censoring_flag(raw), F.lit(0))).otherwise(0)
    # One row in, one row out: behind the explode, a filter on the value does not compute it a second time.
    out = df.select(
        *[c for c in df.columns if c != result],
        raw.alias(f"{result}_orig"), sign.alias(flag), F.explode(F.array(value)).alias(result),
    )
    return out.withColumn(
        "rejected", F.coalesce(F.col(test).isin(*listed), F.lit(False)) & F.col(result).isNull()
    )


def accepted(df: DataFrame) -> DataFrame:
    return df.filter(~F.col("rejected")).drop("rejected")


def rejects(df: DataFrame) -> DataFrame:
    return df.filter(F.col("rejected")).drop("rejected")
