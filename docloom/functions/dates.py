"""Dates in Vietnamese legal text, as ISO strings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Forms of a date, and the phrase that a date of taking effect follows.
ISO = r"(\d{4})-(\d{1,2})-(\d{1,2})"
SPELLED = r"(?iu)ngày\s+(\d{1,2})\s+tháng\s+(\d{1,2})\s+năm\s+(\d{4})"
NUMBERS = r"(\d{1,2})[/.-](\d{1,2})[/.-](\d{4})"


def iso_date(c: Column) -> Column:
    """yyyy-mm-dd from an ISO date, "ngày d tháng m năm y" or d/m/y, whichever comes first in this order; null if there is no such day."""

    def made(pattern: str, order: tuple[int, int, int]) -> Column:
        y, m, d = (F.lpad(F.regexp_extract(c, pattern, k), w, "0") for k, w in zip(order, (4, 2, 2)))
        return F.date_format(F.try_to_date(F.concat_ws("-", y, m, d), "yyyy-MM-dd"), "yyyy-MM-dd")

    return F.when(F.rlike(c, F.lit(ISO)), made(ISO, (1, 2, 3))).when(F.rlike(c, F.lit(SPELLED)), made(SPELLED, (3, 2, 1))).when(F.rlike(c, F.lit(NUMBERS)), made(NUMBERS, (3, 2, 1)))


_BARE = lambda pattern: pattern.removeprefix("(?iu)").replace("(", "").replace(")", "")
EFFECT = rf"(?iu)có\s+hiệu\s+lực(?:\s+thi\s+hành)?\s+(?:kể\s+)?từ\s+(ngày\s+(?:ký|ban\s+hành|{_BARE(NUMBERS)})|{_BARE(SPELLED)})"


def effective_date(c: Column, issued: Column) -> Column:
    """The last date of taking effect that the text gives; the day of issue if it says so."""
    phrase = F.try_element_at(F.regexp_extract_all(c, F.lit(EFFECT), F.lit(1)), F.lit(-1))
    return F.when(F.rlike(F.lower(phrase), F.lit("ký|ban hành")), issued).otherwise(iso_date(phrase))


def validity(issued: Column, effective: Column, expiry: Column, replaced: Column, repealed: Column, today: Column) -> Column:
    """bi_thay_the (replaced), het_hieu_luc (over), khong_xac_dinh (unknown), chua_co_hieu_luc (to come) or con_hieu_luc (in force), in this order; dates are ISO strings, today's day is neither past nor to come."""
    since = F.coalesce(effective, issued)
    return F.when(replaced, "bi_thay_the").when(repealed | (expiry < today), "het_hieu_luc").when(since.isNull(), "khong_xac_dinh").when(since > today, "chua_co_hieu_luc").otherwise("con_hieu_luc")
