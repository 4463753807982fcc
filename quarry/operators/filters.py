"""Metadata filters: a flat list of conditions joined by and or or, compiled to one predicate."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType, IntegralType

OPERATORS = ("==", "!=", ">", "<", ">=", "<=", "in", "nin", "exists")
NO = ("0", "false", "no", "off", "")


@dataclass(frozen=True)
class Condition:
    key: str
    operator: str
    value: object = True


def predicate(c: Condition) -> Column:
    """A missing key satisfies exists alone; order compares as numbers, and what is none doesn't match."""
    if c.operator not in OPERATORS:
        raise ValueError(f"unknown operator {c.operator!r}")
    key = F.col(c.key)
    if c.operator == "exists":
        return key.isNotNull() if str(c.value).strip().lower() not in NO else key.isNull()
    if c.operator in ("in", "nin"):
        if not isinstance(c.value, list | tuple | set):
            return F.lit(False) if c.operator == "in" else key.isNotNull()
        found = key.isin(list(c.value))
        return F.coalesce(found if c.operator == "in" else ~found, F.lit(False))
    if c.operator in ("==", "!="):
        return F.coalesce(key == F.lit(c.value) if c.operator == "==" else key != F.lit(c.value), F.lit(False))
    left, right = key.try_cast("double"), F.lit(c.value).try_cast("double")
    compared = {">": left > right, "<": left < right, ">=": left >= right, "<=": left <= right}[c.operator]
    return F.coalesce(compared, F.lit(False))


def compile_filter(conditions: list[Condition], mode: str = "and") -> Column:
    """One predicate; without conditions all rows match."""
    if mode not in ("and", "or"):
        raise ValueError(f"unknown mode {mode!r}")
    parts = [predicate(c) for c in conditions]
    return reduce((lambda a, b: a & b) if mode == "and" else (lambda a, b: a | b), parts) if parts else F.lit(True)


def default_modality(column: str) -> Column:
    return F.coalesce(F.nullif(F.trim(F.col(column)), F.lit("")), F.lit("text"))


def _bare(rows: DataFrame, c: Condition) -> Column:
    """predicate() for a filter whose rows must be true: null fails by itself, so a bare comparison in the column's
    own type is enough, and the scan can take it."""
    kind, key = rows.schema[c.key].dataType, F.col(c.key)
    if c.operator in ("==", "!="):
        return key == F.lit(c.value) if c.operator == "==" else key != F.lit(c.value)
    if c.operator in ("in", "nin") and isinstance(c.value, list | tuple | set):
        found = key.isin(list(c.value))
        return found if c.operator == "in" else ~found
    if c.operator in (">", "<", ">=", "<="):
        try:
            number = float(str(c.value))
        except ValueError:
            return F.lit(False)
        if isinstance(kind, IntegralType) and number.is_integer() or isinstance(kind, DoubleType | FloatType):
            value = F.lit(int(number) if isinstance(kind, IntegralType) else number)
            return {">": key > value, "<": key < value, ">=": key >= value, "<=": key <= value}[c.operator]
    return predicate(c)


def filtered(rows: DataFrame, conditions: list[Condition], mode: str = "and") -> DataFrame:
    """The rows that match. Conditions joined by and reach the scan as pushed filters; or ones as one predicate."""
    if mode == "or" or not conditions:
        return rows.where(compile_filter(list(conditions), mode))
    for c in conditions:
        if c.operator not in OPERATORS:
            raise ValueError(f"unknown operator {c.operator!r}")
        rows = rows.where(_bare(rows, c))
    return rows


def with_modality(conditions: list[Condition], mode: str, modality: str, exclude: bool = False, column: str = "source_modality") -> Column:
    """A filter and besides that modality, or anything but it. A filter joined by or stays one: both parts must hold."""
    own = predicate(Condition(column, "!=" if exclude else "==", modality))
    return compile_filter(list(conditions), mode) & own
