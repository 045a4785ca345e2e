"""Column helpers with the semantics of graph query languages: null order, guarded rates, ordered cases."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EVIDENCE = {"A": 4, "B": 3, "C": 2, "D": 1}


def rate(part: Column, whole: Column, digits: int = 2) -> Column:
    """100 part / whole, 0 where whole isn't above 0."""
    return F.round(F.when(whole > 0, part * F.lit(100.0) / whole).otherwise(F.lit(0.0)), digits)


def cases(pairs: list[tuple[Column, object]], otherwise: object) -> Column:
    """The value of the first condition that holds."""
    first, *rest = pairs
    out = F.when(*first)
    for c, v in rest:
        out = out.when(c, v)
    return out.otherwise(otherwise)


def lookup(column: Column, values: dict, otherwise: object) -> Column:
    """values as a constant map; otherwise for null and unknown keys."""
    return cases([(column == k, v) for k, v in values.items()], otherwise)


def evidence_score(level: Column) -> Column:
    return lookup(level, EVIDENCE, 0)


def all_of(*conditions: Column | None) -> Column:
    """The conjunction of the conditions given; those that are None don't restrict."""
    return reduce(lambda a, b: a & b, [c for c in conditions if c is not None], F.lit(True))


def any_of(*conditions: Column) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def distinct_if(condition: Column, value: Column) -> Column:
    """Distinct values among the rows where a condition holds."""
    return F.count_distinct(F.when(condition, value))


def day(name: str) -> Column:
    """The day of a time as text."""
    return F.date_format(name, "yyyy-MM-dd").alias("day")


def desc(name: str) -> Column:
    """Descending with nulls first, as graph query languages sort."""
    return F.col(name).desc_nulls_first()


def asc(name: str) -> Column:
    return F.col(name).asc_nulls_last()


def page(df: DataFrame, order: list[Column], number: int, size: int) -> DataFrame:
    """The rows of a page, counted from 1, in an order that must be total."""
    return df.orderBy(*order).offset((number - 1) * size).limit(size)


def total_pages(total: int, size: int) -> int:
    return (total + size - 1) // size
