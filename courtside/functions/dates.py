"""Columns over date texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Shapes tried in order (day first before month first), and the plausible range.
DATE_FORMATS = [
    (r"^\d{4}-\d{1,2}-\d{1,2}$", "yyyy-M-d"),
    (r"^\d{1,2}/\d{1,2}/\d{4}$", "d/M/yyyy"),
    (r"^\d{1,2}/\d{1,2}/\d{4}$", "M/d/yyyy"),
    (r"^\d{4}/\d{1,2}/\d{1,2}$", "yyyy/M/d"),
]
FIRST_DATE, LAST_DATE = "1990-01-01", "2030-12-31"
ERA_OFFSET = 543


def parse_date(text: Column) -> Column:
    """Date by the first format that fits, else null."""
    text = F.trim(text)
    return F.coalesce(*[
        F.when(text.rlike(shape), F.try_to_timestamp(text, F.lit(fmt)).cast("date")) for shape, fmt in DATE_FORMATS])


def plausible(date: Column) -> Column:
    return date.between(F.lit(FIRST_DATE).cast("date"), F.lit(LAST_DATE).cast("date"))


def date_part(text: Column) -> Column:
    """First ten characters when shaped ____-__-__, else null."""
    part = F.substring(F.trim(text), 1, 10)
    return F.when(part.rlike(r"^.{4}-..-..$"), part)


def repair_era(day: Column) -> Column:
    """A Buddhist-era year (543 ahead) is set back when only that makes it plausible."""
    year = F.substring(day, 1, 4).try_cast("int")
    shifted = year - ERA_OFFSET
    fixed = F.concat(F.lpad(shifted.cast("string"), 4, "0"), F.substring(day, 5, 6))
    return F.when((year > 2100) & shifted.between(1990, 2100), fixed).otherwise(day)


def local_date(text: Column) -> Column:
    return repair_era(date_part(text))
