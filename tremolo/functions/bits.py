"""Messages: drawing, packing and mapping of bits."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tremolo.functions.rng import uniform


def message(seed: str, n: int, *place: Column) -> Column:
    """n bits for seed and place; without a place one message for a whole run."""
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda b: (uniform(seed, *place, b) > 0.5).cast("int"))


def pack(bits: Column) -> Column:
    """Bytes, most significant bit first; a last group of fewer bits is a smaller number."""
    groups = F.ceil(F.size(bits) / 8).cast("int")
    one = lambda g: F.conv(F.array_join(F.slice(bits, g * 8 + 1, F.least(F.lit(8), F.size(bits) - g * 8)), ""), 2, 10).cast("int")
    return F.when(groups > 0, F.transform(F.sequence(F.lit(0), groups - 1), one)).otherwise(F.array().cast("array<int>"))


def unpack(values: Column) -> Column:
    """Eight bits for each byte."""
    digits = F.array_join(F.transform(values, lambda v: F.lpad(F.bin(v.cast("long")), 8, "0")), "")
    return F.transform(F.filter(F.split(digits, ""), lambda c: c != ""), lambda c: c.cast("int"))


def bipolar(bits: Column) -> Column:
    return F.transform(bits, lambda b: b * 2 - 1)


def decide(values: Column) -> Column:
    return F.transform(values, lambda v: (v >= 0).cast("int"))
