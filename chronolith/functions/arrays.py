"""Typed arrays as array columns: made with a length, read and set by index (from 0), and bit sets of whole numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The value of a new array's elements.
ZERO = {"boolean": False, "byte": 0, "int": 0, "long": 0, "double": 0.0}


def new_array(kind: str, size: Column | int) -> Column:
    if kind not in ZERO:
        raise ValueError(f"no such array type: {kind}")
    return F.array_repeat(F.lit(ZERO[kind]).cast(kind), size)


def get(array: Column, index: Column | int) -> Column:
    """Null beyond the array's ends."""
    return F.get(array, index if isinstance(index, Column) else F.lit(index))


def put(array: Column, index: Column, value: Column) -> Column:
    """The array with one element replaced; unchanged if there is no such index."""
    return F.transform(array, lambda x, i: F.when(i == index, value).otherwise(x))


def bit_set(indices: Column, size: Column | int) -> Column:
    """A boolean array of ``size``, true at the ``indices``."""
    places = F.sequence(F.lit(0), (size if isinstance(size, Column) else F.lit(size)) - 1)
    return F.transform(places, lambda i: F.array_contains(indices, i))


def set_bits(bits: Column) -> Column:
    """The indices that are true, ascending."""
    return F.filter(F.sequence(F.lit(0), F.size(bits) - 1), lambda i: F.get(bits, i))
