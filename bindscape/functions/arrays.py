"""Helpers on array columns. Shifts fill with zeros; squared distance has no root; the first of equal extremes wins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .dna import uniform


def _c(a: Column | str) -> Column:
    return (F.col(a) if isinstance(a, str) else a).cast("array<double>")


def total(a) -> Column:
    return F.aggregate(_c(a), F.lit(0.0), lambda s, x: s + x)


def mean(a) -> Column:
    return total(a) / F.size(_c(a))


def largest(a) -> Column:
    return F.array_max(_c(a))


def smallest(a) -> Column:
    return F.array_min(_c(a))


def which_largest(a) -> Column:
    """0-based place of the first largest value."""
    return F.array_position(_c(a), largest(a)) - 1


def which_smallest(a) -> Column:
    return F.array_position(_c(a), smallest(a)) - 1


def dot(a, b) -> Column:
    return total(multiply(a, b))


def sq_length(a) -> Column:
    return dot(a, a)


def norm(a) -> Column:
    return F.sqrt(sq_length(a))


def sq_dist(a, b) -> Column:
    return sq_length(subtract(a, b))


def frobenius(rows: Column | str) -> Column:
    m = F.col(rows) if isinstance(rows, str) else rows
    return norm(F.flatten(m))


def each(a, f: Callable[[Column], Column]) -> Column:
    return F.transform(_c(a), f)


def absolute(a) -> Column:
    return each(a, F.abs)


def exponential(a) -> Column:
    return each(a, F.exp)


def logarithm(a) -> Column:
    return each(a, F.ln)


def scale(a, by: float) -> Column:
    return each(a, lambda x: x * F.lit(float(by)))


def shift_values(a, by: float) -> Column:
    """a - by in every place."""
    return each(a, lambda x: x - F.lit(float(by)))


def add(a, b) -> Column:
    return F.zip_with(_c(a), _c(b), lambda x, y: x + y)


def subtract(a, b) -> Column:
    return F.zip_with(_c(a), _c(b), lambda x, y: x - y)


def multiply(a, b) -> Column:
    return F.zip_with(_c(a), _c(b), lambda x, y: x * y)


def divide(a, b) -> Column:
    return F.zip_with(_c(a), _c(b), lambda x, y: x / y)


def add_scaled(a, b, by: float) -> Column:
    """a + by * b."""
    return F.zip_with(_c(a), _c(b), lambda x, y: x + F.lit(float(by)) * y)


def over_largest(a) -> Column:
    top = largest(a)
    return F.transform(_c(a), lambda x: x / top)


def over_norm(a) -> Column:
    n = norm(a)
    return F.transform(_c(a), lambda x: x / n)


def cat(*arrays) -> Column:
    """Joined end to end; null counts as empty."""
    return F.concat(*[F.coalesce(_c(a), F.array().cast("array<double>")) for a in arrays])


def ones(n: int) -> Column:
    return F.array_repeat(F.lit(1.0), n)


def any_true(flags: Column) -> Column:
    return F.exists(flags, lambda x: x)


def block_reverse(a, block: int) -> Column:
    """Blocks in reverse order, each as it was."""
    arr = _c(a)
    n = (F.size(arr) / block).cast("int")
    return F.flatten(F.transform(F.sequence(n - 1, F.lit(0), F.lit(-1)), lambda i: F.slice(arr, i * block + 1, F.lit(block))))


def reversed_(a) -> Column:
    return F.reverse(_c(a))


def shift_left(a, by: int) -> Column:
    """Values move to the front by `by`; zeros come in at the end. Not a rotation."""
    arr = _c(a)
    return F.concat(F.slice(arr, by + 1, F.greatest(F.size(arr) - by, F.lit(0))), F.array_repeat(F.lit(0.0), F.least(F.lit(by), F.size(arr))))


def shift_right(a, by: int) -> Column:
    arr = _c(a)
    return F.concat(F.array_repeat(F.lit(0.0), F.least(F.lit(by), F.size(arr))), F.slice(arr, 1, F.greatest(F.size(arr) - by, F.lit(0))))


def _places(n: Column | int) -> Column:
    """0 .. n - 1; empty for 0 and null."""
    n = F.coalesce(F.lit(n) if isinstance(n, int) else n, F.lit(0)).cast("int")
    return F.slice(F.sequence(F.lit(0), F.greatest(n, F.lit(1))), F.lit(1), F.greatest(n, F.lit(0)))


def _rows(rows: Column | str) -> Column:
    return (F.col(rows) if isinstance(rows, str) else rows).cast("array<array<double>>")


def matrix(a, width: int) -> Column:
    """Rows of `width` values, in order; what is left over at the end is dropped."""
    arr = _c(a)
    return F.transform(_places(F.floor(F.size(arr) / width)), lambda i: F.slice(arr, i * width + 1, F.lit(width)))


def transpose(rows) -> Column:
    """Columns as rows; values that a short row lacks are null."""
    m = _rows(rows)
    return F.transform(_places(F.size(F.get(m, F.lit(0)))), lambda j: F.transform(m, lambda r: F.get(r, j)))


def symmetrize(rows) -> Column:
    """The mean of a square matrix and its transpose."""
    return F.zip_with(_rows(rows), transpose(rows), lambda r, c: F.zip_with(r, c, lambda x, y: (x + y) / 2))


def printed(a, digits: int = 4) -> Column:
    """Values with so many decimals, as "[x, y]"."""
    return F.concat(F.lit("["), F.array_join(F.transform(_c(a), lambda x: F.format_string(f"%.{digits}f", x)), ", "), F.lit("]"))


def random(n: int, low: float, high: float, *key: Column | str) -> Column:
    """n numbers in [low, high) that the key gives: the same wherever and whenever they are made."""
    return F.transform(_places(n), lambda i: F.lit(float(low)) + F.lit(float(high - low)) * uniform(*key, i))
