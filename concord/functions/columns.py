"""Scalar column expressions: parsing, null rules, names, labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def to_number(column: Column) -> Column:
    """The number a text stands for; null where it stands for none."""
    return column.try_cast("double")


def zero_to_null(column: Column) -> Column:
    return F.when(column == 0, None).otherwise(column)


def clean_id(column: Column, length: int = 12) -> Column:
    """The first characters of a sample's barcode."""
    return F.substring(column, 1, length)


def t_statistic(r: Column, n: Column | int) -> Column:
    """t of a correlation over n individuals; null where \\|r\\| is 1."""
    return F.try_divide(r * F.sqrt(F.lit(n) - 2 if isinstance(n, int) else n - 2), F.sqrt(F.greatest(F.lit(0.0), 1 - r * r)))


def label_of_largest(columns: list[str]) -> Column:
    """The name of the column with the largest value of a row; the first of equal ones."""
    values = F.array(*(F.col(c) for c in columns))
    return F.element_at(F.array(*(F.lit(c) for c in columns)), F.array_position(values, F.array_max(values)).cast("int"))


def component(k: int) -> str:
    return f"comp{k}"
