"""Pieces of program output as Column expressions: blocks between markers, numbers, reshaped rows. Nothing leaves the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NUMBER = r"[-+]?\d+\.\d+(?:[DEde][-+]?\d+)?"


def block(text: Column, start: str, end: str, which: int = -1) -> Column:
    """What follows the which-th occurrence of a literal marker (from the end if negative) up to the next end marker; null if absent."""
    parts = F.split(text, rf"\Q{start}\E", -1)
    at = F.when(F.size(parts) > (abs(which) if which < 0 else which), F.element_at(parts, which if which < 0 else which + 1))
    return F.element_at(F.split(at, rf"\Q{end}\E", -1), 1)


def numbers(text: Column) -> Column:
    """All decimal numbers of a text as doubles; a D exponent counts as E."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(NUMBER), F.lit(0))
    return F.transform(found, lambda x: F.translate(x, "Dd", "Ee").cast("double"))


def every(values: Column, step: int, first: int) -> Column:
    """Elements first, first + step, ... (from 0)."""
    return F.filter(values, lambda x, i: i % step == first)


def once(value: Column, f) -> Column:
    """f(value), with value computed once a row: a function of array elements would compute it anew for each."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def rows_of(values: Column, width: int) -> Column:
    """An array cut into arrays of `width`; an incomplete last one drops out."""
    n = lambda v: F.floor(F.size(v) / width).cast("int")
    return once(values, lambda v: F.when(n(v) > 0, F.transform(F.sequence(F.lit(0), n(v) - 1), lambda i: F.slice(v, i * width + 1, width))).otherwise(F.array().cast("array<array<double>>")))


def line_after(text: Column, marker: str) -> Column:
    """The first line below the last line that holds a literal marker."""
    tail = F.element_at(F.split(text, rf"\Q{marker}\E", -1), -1)
    lines = F.split(tail, "\n", -1)
    return F.when(F.contains(text, F.lit(marker)), F.get(lines, F.lit(1)))


def count_of(text: Column, phrase: str) -> Column:
    return F.regexp_count(text, F.lit(rf"\Q{phrase}\E"))


def leading(values: Column, value: float = 0.0) -> Column:
    """How many elements an array begins with that equal a value."""
    other = F.array_position(F.transform(values, lambda x: x != value), True)
    return F.when(other > 0, other - 1).otherwise(F.size(values)).cast("int")


def paired(values: Column) -> Column:
    """An array's elements two by two, as arrays: the even places with the odd ones after them; a last one alone drops out."""
    n = F.floor(F.size(values) / 2).cast("int")
    return F.transform(F.filter(F.sequence(F.lit(0), n), lambda i: i < n), lambda i: F.array(F.get(values, 2 * i), F.get(values, 2 * i + 1)))
