"""Fiscal calendar: years, quarters, labels, tags and periods as Columns, and periods out of literals."""

from __future__ import annotations

import datetime as dt
import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Calendar:
    """A fiscal year begins with `start_month` and is named by the year it begins in."""

    start_month: int = 1
    label_format: str | None = None

    @property
    def format(self) -> str:
        return self.label_format or ("FY {yyyy1}" if self.start_month == 1 else "FY {yy1}-{yy2}")

    def year_of(self, date: Column) -> Column:
        return F.year(F.add_months(date, 1 - self.start_month))

    def end_of(self, year: Column) -> Column:
        return year + (0 if self.start_month == 1 else 1)

    def label(self, year: Column) -> Column:
        end = self.end_of(year)
        two = lambda y: F.lpad((y % 100).cast("string"), 2, "0")
        out = F.lit(self.format)
        for mark, value in (("{yyyy1}", F.lpad(year.cast("string"), 4, "0")), ("{yyyy2}", F.lpad(end.cast("string"), 4, "0")), ("{yy1}", two(year)), ("{yy2}", two(end))):
            out = F.replace(out, F.lit(mark), value)
        return out

    def tag(self, year: Column) -> Column:
        return F.trim(F.regexp_replace(F.regexp_replace(F.lower(self.label(year)), "[ \t\n\r]+", ""), "[^a-z0-9]+", "-"), F.lit("-"))

    def starts(self, year: Column) -> Column:
        return F.make_date(year, F.lit(self.start_month), F.lit(1))

    def range(self, year: Column) -> tuple[Column, Column]:
        """First day, and first day of the next."""
        return self.starts(year), F.add_months(self.starts(year), 12)

    def quarter_of(self, date: Column) -> Column:
        return (F.floor(F.pmod(F.month(date) - self.start_month, F.lit(12)) / 3) + 1).cast("int")

    def quarter_range(self, year: Column, quarter: Column) -> tuple[Column, Column]:
        return F.add_months(self.starts(year), 3 * (quarter - 1)), F.add_months(self.starts(year), 3 * quarter)

    def quarter_label(self, year: Column, quarter: Column) -> Column:
        return F.concat(self.label(year), F.lit(" Q"), quarter.cast("string"))

    def period(self, expression: Column) -> tuple[Column, Column]:
        """First day and first day after, of periods such as 2026, 2026-05, 2026-05-11, FY2026-27, FY26Q3 and 2026-Q3; nulls for others."""
        s = F.upper(F.trim(expression))
        plain = r"^([0-9]{4})(?:-([0-9]{1,2}))?$"
        year = F.regexp_extract(s, plain, 1).try_cast("int")
        month = F.regexp_extract(s, plain, 2).try_cast("int")
        day = F.when(s.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), F.try_to_date(s, "yyyy-MM-dd"))
        fiscal = r"^(?:FY *)?([0-9]{2,4})(?:-([0-9]{2,4}))?-? *(?:Q *([1-4]))?$"
        is_fiscal = s.rlike("^FY|Q") & s.rlike(fiscal)
        start = F.regexp_extract(s, fiscal, 1).try_cast("int")
        start = F.when(start < 100, start + 2000).otherwise(start)
        end = F.regexp_extract(s, fiscal, 2).try_cast("int")
        end = F.when(end < 100, end + F.floor(start / 100) * 100).otherwise(end)
        quarter = F.regexp_extract(s, fiscal, 3).try_cast("int")
        good = is_fiscal & (end.isNull() | (end == self.end_of(start)))
        first = F.when(month.isNull(), F.make_date(year, F.lit(1), F.lit(1))).when(month.between(1, 12), F.make_date(year, month, F.lit(1)))
        after = F.add_months(first, F.when(month.isNull(), 12).otherwise(1))
        q_first, q_after = self.quarter_range(start, quarter)
        y_first, y_after = self.range(start)
        return (
            F.when(day.isNotNull(), day).when(good, F.when(quarter.isNotNull(), q_first).otherwise(y_first)).when(~is_fiscal, first),
            F.when(day.isNotNull(), F.date_add(day, 1)).when(good, F.when(quarter.isNotNull(), q_after).otherwise(y_after)).when(~is_fiscal, after),
        )

    # the same for single values on the driver

    def label_of(self, year: int) -> str:
        end = year + (self.start_month != 1)
        return self.format.replace("{yyyy1}", f"{year:04d}").replace("{yyyy2}", f"{end:04d}").replace("{yy1}", f"{year % 100:02d}").replace("{yy2}", f"{end % 100:02d}")

    def tag_of(self, year: int) -> str:
        return re.sub("[^a-z0-9]+", "-", re.sub(r"[ \t\n\r]+", "", self.label_of(year).lower())).strip("-")

    def parse(self, expression: str) -> Period:
        """A period, or ValueError."""
        s = expression.strip()
        if m := re.fullmatch(r"(\d{4})(?:-(\d{1,2}))?(?:-(\d{2}))?", s):
            year, month, day = (int(x) if x else None for x in m.groups())
            if day:
                first = dt.date(year, month, day)
                return Period(s, first, first + dt.timedelta(1))
            if month is not None and not 1 <= month <= 12:
                raise ValueError(f"no such month in {expression!r}")
            return Period(s, dt.date(year, month or 1, 1), months_on(dt.date(year, month or 1, 1), 1 if month else 12))
        m = re.fullmatch(r"(?:FY *)?(\d{2,4})(?:-(\d{2,4}))?-? *(?:Q *([1-4]))?", s.upper())
        if not m or not (s.upper().startswith("FY") or m[3]):
            raise ValueError(f"{expression!r} is no period")
        start = int(m[1]) + (2000 if int(m[1]) < 100 else 0)
        if m[2]:
            end = int(m[2]) + (start // 100 * 100 if int(m[2]) < 100 else 0)
            if end != start + (self.start_month != 1):
                raise ValueError(f"{expression!r} ends in {end}, which the fiscal year from {start} does not")
        first, label = dt.date(start, self.start_month, 1), self.label_of(start)
        if m[3]:
            first = months_on(first, 3 * (int(m[3]) - 1))
            return Period(f"{label} Q{m[3]}", first, months_on(first, 3))
        return Period(label, first, months_on(first, 12))


@dataclass(frozen=True)
class Period:
    """Half open: from the first day to before `to`."""

    label: str
    first: dt.date
    to: dt.date

    def contains(self, date: Column) -> Column:
        day = F.to_date(date)
        return (day >= F.lit(self.first)) & (day < F.lit(self.to))

    def overlaps(self, first: Column, to: Column) -> Column:
        return (first < F.lit(self.to)) & (F.lit(self.first) < to)


def months_on(d: dt.date, n: int) -> dt.date:
    k = d.year * 12 + d.month - 1 + n
    return dt.date(k // 12, k % 12 + 1, d.day)
