"""Scores of detected messages and of degraded signals, as column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tremolo.functions.arrays import let, lets, total


def accuracy(sent: Column, got: Column) -> Column:
    """Percentage of equal bits; 50 if nothing, or nothing whole, was detected.

    Messages of different lengths raise, unless one has a single bit.
    """
    n, m = F.size(sent), F.size(got)
    wide = F.when(m == 1, F.array_repeat(F.get(got, F.lit(0)), n)).otherwise(got)
    equal = F.aggregate(F.zip_with(sent, wide, lambda a, b: (a == b).cast("int")), F.lit(0), lambda s, x: s + x)
    value = F.when((n != m) & (m != 1), F.raise_error(F.lit("messages differ in length"))).otherwise(F.lit(100.0) * equal / n)
    return F.when(got.isNull() | F.exists(F.coalesce(got, F.array().cast("array<double>")), lambda v: v.isNull()), F.lit(50.0)).otherwise(value)


def trim(a: Column, b: Column) -> tuple[Column, Column]:
    n = F.least(F.size(a), F.size(b))
    return F.slice(a, F.lit(1), n), F.slice(b, F.lit(1), n)


def _power(x: Column) -> Column:
    return total(x, lambda v: v * v)


def snr(signal: Column, noisy: Column) -> Column:
    """Decibels; infinite without noise, null if the lengths differ by more than one."""
    s, n = trim(signal, noisy)
    value = lets([_power(s), _power(F.zip_with(n, s, lambda a, b: a - b))], lambda p, q: F.when(q == 0, F.lit(float("inf"))).when(p == 0, F.lit(float("-inf"))).otherwise(F.lit(10.0) * F.log10(p / q)))
    return F.when(F.abs(F.size(signal) - F.size(noisy)) > 1, F.lit(None).cast("double")).otherwise(value)


def psnr(original: Column, marked: Column, most: float = 1.0) -> Column:
    a, b = trim(original, marked)
    error = _power(F.zip_with(a, b, lambda x, y: x - y)) / F.size(a)
    return let(error, lambda e: F.when(e == 0, F.lit(float("inf"))).otherwise(F.lit(10.0) * F.log10(F.lit(most * most) / e)))


def si_sdr(reference: Column, estimate: Column) -> Column:
    r, e = trim(reference, estimate)
    n = F.size(r)

    def score(mr: Column, me: Column) -> Column:
        products = F.zip_with(r, e, lambda a, b: F.struct(((a - mr) * (a - mr)).alias("rr"), ((b - me) * (b - me)).alias("ee"), ((a - mr) * (b - me)).alias("re")))
        sums = F.aggregate(products, F.struct(F.lit(0.0).alias("rr"), F.lit(0.0).alias("ee"), F.lit(0.0).alias("re")), lambda s, x: F.struct((s["rr"] + x["rr"]).alias("rr"), (s["ee"] + x["ee"]).alias("ee"), (s["re"] + x["re"]).alias("re")))

        def ratio(s: Column) -> Column:
            alpha = s["re"] / (s["rr"] + 1e-8)
            return F.lit(10.0) * F.log10(alpha * alpha * s["rr"] / (F.greatest(s["ee"] - 2 * alpha * s["re"] + alpha * alpha * s["rr"], F.lit(0.0)) + 1e-8))

        return let(sums, ratio)

    return F.when(n > 0, lets([total(r) / n, total(e) / n], score))


def renormalize(original: Column, processed: Column) -> Column:
    """Processed values mapped to the original's range; a constant signal stays as it is."""
    return lets(
        [F.array_min(original), F.array_max(original), F.array_min(processed), F.array_max(processed)],
        lambda a, b, c, d: F.when(d == c, processed).otherwise(F.transform(processed, lambda x: (x - c) / (d - c) * (b - a) + a)),
    )
