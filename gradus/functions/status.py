"""Column expressions that keep a missing value apart from a zero."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import NOT_APPLICABLE, OBSERVED, UNRECORDED, ZERO_EXPOSURE, Feature
from ..operators.ordered import finite


def scalar_status(text: Column, kind: Column) -> Column:
    """Status of a JSON scalar given its text and its JSON type name."""
    number = text.try_cast("double")
    return (
        F.when(text.isNull() | (kind == "null") | (text == ""), "missing")
        .when(kind.isin("boolean", "string"), "categorical")
        .when((kind == "number") & finite(number), "numeric")
        .otherwise("invalid")
    )


def numeric_text(text: Column, empty_zero: bool = False) -> tuple[Column, Column]:
    """(status, value) of a table cell: thousands commas and a trailing % are accepted."""
    cell = F.regexp_replace(F.trim(text), ",", "")
    blank = cell.isin("", "-", "—")
    number = cell.rlike(r"^[-+]?[0-9]+(\.[0-9]+)?%?$")
    value = F.regexp_replace(cell, "%$", "").try_cast("double")
    if empty_zero:
        return (
            F.when(blank | number, "numeric").when(cell.isin("N/A", "NA") | cell.isNull(), "missing").otherwise("categorical"),
            F.when(blank, F.lit(0.0)).when(number, value),
        )
    return (
        F.when(cell.isNull() | blank | cell.isin("N/A", "NA"), "missing").when(number, "numeric").otherwise("categorical"),
        F.when(number, value),
    )


def ratio_status(numerator: Column, denominator: Column) -> Column:
    both = finite(numerator) & finite(denominator)
    return F.when(
        both & ((denominator < 0) | ((denominator == 0) & (numerator != 0))), "invalid"
    ).when(both & (denominator == 0) & (numerator == 0), "na")


def nonnegative(column: Column) -> Column:
    return finite(column) & (column >= 0)


def feature_value(f: Feature) -> Column:
    a, b = F.col(f.numerator).cast("double"), F.col(f.denominator).cast("double")
    return F.when(a.isNotNull() & (b > 0), a / b * F.lit(f.scale))


def measurement_status(f: Feature, missing: str = UNRECORDED) -> Column:
    a, b = F.col(f.numerator), F.col(f.denominator)
    return (
        F.when(a.isNull() | b.isNull(), missing)
        .when(b > 0, OBSERVED)
        .when(F.lit(f.denominator == "minutes"), ZERO_EXPOSURE)
        .otherwise(NOT_APPLICABLE)
    )


def rating(z: Column) -> Column:
    """Base 50, 15 points per standard deviation, floored at 1 and without a cap."""
    return F.when(z.isNotNull(), F.greatest(F.lit(1.0), F.lit(50.0) + F.lit(15.0) * z))


def close(a: Column, b: Column, tolerance: float = 1e-6) -> Column:
    """Equal up to an absolute or relative tolerance, whichever is wider."""
    return F.abs(a - b) <= F.greatest(
        F.lit(tolerance), F.lit(tolerance) * F.greatest(F.abs(a), F.abs(b))
    )
