"""Values or errors as one column, ``struct<value, error>``: a row that fails carries its reason on, others go ahead."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def ok(value: Column) -> Column:
    return F.struct(value.alias("value"), F.lit(None).cast("string").alias("error"))


def attempt(value: Column, error: Column | str) -> Column:
    """A value, or the error where it is null (as ``try_cast`` and the like make it)."""
    return F.struct(value.alias("value"), F.when(value.isNull(), F.lit(error) if isinstance(error, str) else error).alias("error"))


def is_ok(a: Column) -> Column:
    return a["error"].isNull()


def map_value(a: Column, fn: Callable[[Column], Column]) -> Column:
    """The function of the value; an error stays."""
    return F.struct(F.when(is_ok(a), fn(a["value"])).alias("value"), a["error"].alias("error"))


def and_then(a: Column, fn: Callable[[Column], Column]) -> Column:
    """What a function that may fail itself gives for the value; an error stays."""
    after = fn(a["value"])
    return F.struct(F.when(is_ok(a), after["value"]).alias("value"), F.when(is_ok(a), after["error"]).otherwise(a["error"]).alias("error"))


def or_else(a: Column, fn: Callable[[Column], Column]) -> Column:
    """Another attempt, made of the error, where there is one."""
    after = fn(a["error"])
    return F.struct(F.when(is_ok(a), a["value"]).otherwise(after["value"]).alias("value"), F.when(~is_ok(a), after["error"]).alias("error"))


def value_or(a: Column, default: Column) -> Column:
    return F.when(is_ok(a), a["value"]).otherwise(default)
