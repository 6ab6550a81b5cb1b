"""Counter-based random numbers: the same in Spark, in NumPy and in other SQL engines.

A draw is the first 32 bits of an MD5 of its seed and place, so it depends on neither
partitions nor order, and a task that runs again draws the same.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def uniform(seed: str | int, *place: Column) -> Column:
    """A number in (0, 1) for seed and place."""
    text = F.concat_ws(":", F.lit(str(seed)), *(p.cast("string") for p in place))
    return (F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("long") + F.lit(0.5)) / F.lit(4294967296.0)


def normal(seed: str | int, *place: Column) -> Column:
    """A standard normal number by Box and Muller."""
    return F.sqrt(F.lit(-2.0) * F.ln(uniform(f"{seed}a", *place))) * F.cos(F.lit(2 * math.pi) * uniform(f"{seed}b", *place))


def uniform_of(seed: str | int, *place) -> float:
    """The same number without Spark."""
    text = ":".join(map(str, (seed, *place)))
    return (int(hashlib.md5(text.encode()).hexdigest()[:8], 16) + 0.5) / 4294967296.0


def normals_of(seed: str | int, key, n: int) -> np.ndarray:
    u = np.array([[uniform_of(f"{seed}a", key, i), uniform_of(f"{seed}b", key, i)] for i in range(n)]).reshape(n, 2)
    return np.sqrt(-2 * np.log(u[:, 0])) * np.cos(2 * math.pi * u[:, 1])
