"""Row null tests of SQL: a row IS NULL when all fields are, IS NOT NULL when none is."""

from functools import reduce

from pyspark.sql import Column


def row_is_null(value: Column, fields: list[str]) -> Column:
    return reduce(lambda a, b: a & b, [value[f].isNull() for f in fields])


def row_is_not_null(value: Column, fields: list[str]) -> Column:
    return reduce(lambda a, b: a & b, [value[f].isNotNull() for f in fields])
