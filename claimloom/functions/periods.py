"""Reporting periods: fiscal years, year-ended dates, dates, months and years.

Parsing is staged over columns: every regular expression runs once per row and its
parts are kept in a helper column, which keeps the generated code small.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimloom.functions.text import squeeze
from claimloom.functions.units import literal_map

# --- fixed values -----------------------------------------------------------
MONTH_NAMES = ["january", "february", "march", "april", "may", "june", "july",
               "august", "september", "october", "november", "december"]
FISCAL = r"^(?:fy|fiscal year|financial year)\s*'?([0-9]{2}|[0-9]{4})$"
YEAR_ENDED = "year ended "
# 2025-03-31 | March 31, 2025 | 31 Mar. 2025 -> year, month, day
DATE = (r"^(?:year ended )?(?:([0-9]{4})-([0-9]{2})-([0-9]{2})|([a-z]+)\.? ([0-9]{1,2}),? ([0-9]{4})"
        r"|([0-9]{1,2}) ([a-z]+)\.? ([0-9]{4}))$")
DATE_PARTS = "$1$6$9|$2$4$8|$3$5$7"
# 2025-03 | March 2025 -> year, month
MONTH = r"^(?:([0-9]{4})-([0-9]{2})|([a-z]+)\.? ([0-9]{4}))$"
MONTH_PARTS = "$1$4|$2$3"
YEAR = r"^[0-9]{4}$"
# ---------------------------------------------------------------------------

MONTHS = ({name: f"{i + 1:02d}" for i, name in enumerate(MONTH_NAMES)}
          | {name[:3]: f"{i + 1:02d}" for i, name in enumerate(MONTH_NAMES)}
          | {f"{i:02d}": f"{i:02d}" for i in range(1, 13)})


@dataclass(frozen=True)
class PeriodPolicy:
    """Fiscal assumptions; a fiscal label names the year in which the period ends."""

    two_digit_century: int | None = None
    fiscal_year_end_month: int = 12
    fiscal_year_end_day: int = 31
    resolve_fiscal_dates: bool = False

    def __post_init__(self):
        if self.two_digit_century not in (None, 1900, 2000):
            raise ValueError("two_digit_century must be 1900, 2000 or None")
        if not 1 <= self.fiscal_year_end_month <= 12 or not 1 <= self.fiscal_year_end_day <= 31:
            raise ValueError("fiscal year end must be a month 1-12 and a day 1-31")


def _calendar_date(year: Column, month: Column, day: Column) -> Column:
    """A date, or null where the calendar has none (the first year is 1)."""
    text = F.concat(year, F.lit("-"), month, F.lit("-"), F.lpad(day, 2, "0"))
    return F.when(year != "0000", text.try_cast("date"))


def _parts(df: DataFrame, text: str, pattern: str, parts: str, name: str) -> DataFrame:
    """Split ``text`` by the groups of ``pattern`` and translate the month word."""
    split = F.split(F.when(F.col(text).rlike(pattern), F.regexp_replace(text, pattern, parts)), r"\|")
    return (df.withColumn(f"{name}_parts", split)
            .withColumn(f"{name}_month", F.try_element_at(literal_map(MONTHS), F.get(f"{name}_parts", 1))))


def _shaped(name: str) -> Column:
    """The text has the shape: a known month word, or month digits (valid or not)."""
    word = F.get(f"{name}_parts", 1)
    return F.coalesce(F.col(f"{name}_month").isNotNull() | word.rlike("^[0-9]"), F.lit(False))


def with_date(df: DataFrame, source: str, output: str) -> DataFrame:
    """Add ``output`` = ``struct<shaped, value>``; shaped without a value is an error."""
    staged = _parts(df.withColumn("_text", squeeze(F.lower(F.col(source)))), "_text", DATE, DATE_PARTS, "_d")
    value = _calendar_date(F.get("_d_parts", 0), F.col("_d_month"), F.get("_d_parts", 2))
    return (staged.withColumn(output, F.struct(_shaped("_d").alias("shaped"), value.alias("value")))
            .drop("_text", "_d_parts", "_d_month"))


def with_period(df: DataFrame, source: str, output: str, policy: PeriodPolicy = PeriodPolicy()) -> DataFrame:
    """Add ``output`` = ``struct<raw,canonical,kind,fiscal_year,start_date,end_date,error>`` of a period text."""
    raw, text = F.col(source), F.col("_text")
    staged = df.withColumn("_text", squeeze(F.lower(raw))).withColumn("_fiscal", F.regexp_extract("_text", FISCAL, 1))
    staged = _parts(_parts(staged, "_text", DATE, DATE_PARTS, "_d"), "_text", MONTH, MONTH_PARTS, "_m")
    staged = staged.withColumn("_date", _calendar_date(F.get("_d_parts", 0), F.col("_d_month"), F.get("_d_parts", 2)))
    staged = staged.withColumn("_first", _calendar_date(F.get("_m_parts", 0), F.col("_m_month"), F.lit("01")))

    digits = F.col("_fiscal")
    century = F.lit(None).cast("int") if policy.two_digit_century is None else (
        F.lit(policy.two_digit_century) + digits.try_cast("int"))
    staged = staged.withColumn("_year", F.when(F.length(digits) == 4, digits.try_cast("int")).when(
        F.length(digits) == 2, century))
    staged = staged.withColumn("_kind", (
        F.when(digits != "", F.lit("fiscal_year"))
        .when(_shaped("_d"), F.when(text.startswith(YEAR_ENDED), F.lit("year_ended")).otherwise(F.lit("date")))
        .when(_shaped("_m"), F.lit("month")).when(text.rlike(YEAR), F.lit("year")).otherwise(F.lit("unknown"))))

    kind, date, first, year = (F.col(c) for c in ("_kind", "_date", "_first", "_year"))
    fiscal_start = fiscal_end = F.lit(None).cast("date")
    fiscal_ok = year.isNull() | (year >= 1)
    if policy.resolve_fiscal_dates:
        month, day = F.lit(f"{policy.fiscal_year_end_month:02d}"), F.lit(str(policy.fiscal_year_end_day))
        fiscal_end = _calendar_date(F.lpad(year.cast("string"), 4, "0"), month, day)
        fiscal_start = F.date_add(_calendar_date(F.lpad((year - 1).cast("string"), 4, "0"), month, day), 1)
        fiscal_ok = year.isNull() | (fiscal_end.isNotNull() & fiscal_start.isNotNull())
    failed = (F.when(text == "", F.lit("blank_period"))
              .when(((kind == "fiscal_year") & ~fiscal_ok) | (kind.isin("year_ended", "date") & date.isNull())
                    | ((kind == "month") & first.isNull()) | ((kind == "year") & (text == "0000")),
                    F.lit("invalid_period")))
    name = (F.when(kind == "fiscal_year", F.concat(F.lit("FY"), F.coalesce(F.lpad(year.cast("string"), 4, "0"), digits)))
            .when(kind == "year_ended", F.concat(F.lit("year_ended:"), date.cast("string")))
            .when(kind == "date", date.cast("string"))
            .when(kind == "month", F.substring(first.cast("string"), 1, 7)).otherwise(text))
    start = F.when(kind == "month", first).when(kind == "fiscal_year", fiscal_start)
    end = (F.when(kind.isin("year_ended", "date"), date).when(kind == "month", F.last_day(first))
           .when(kind == "fiscal_year", fiscal_end))
    staged = staged.withColumn("_error", failed)
    good = F.col("_error").isNull()
    made = F.struct(
        raw.alias("raw"), F.when(good, name).alias("canonical"), F.when(good, kind).alias("kind"),
        F.when(good, year).alias("fiscal_year"), F.when(good, start).alias("start_date"),
        F.when(good, end).alias("end_date"), F.col("_error").alias("error"))
    return staged.withColumn(output, F.when(raw.isNotNull(), made)).drop(
        "_text", "_fiscal", "_d_parts", "_d_month", "_m_parts", "_m_month", "_date", "_first", "_year", "_kind", "_error")
