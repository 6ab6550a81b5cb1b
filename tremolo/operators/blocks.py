"""The block self-join by its relational steps: spectra, distances, exclusion band, first k, nearest, overlap-add.

Distances are between magnitudes of spectra, with or without what masking hides. The join is
within a clip, so it is an equi-join on clip_id with a residual condition and never a product
of all blocks. Each pair is made once and gives both directions.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def spectra(blocks: DataFrame, size: int, rate: int | None = None) -> DataFrame:
    """blocks(clip_id, m, block) with arrays x, magnitudes of half the spectrum, and limit.

    Without rate the inner bins, which a whole spectrum has twice, are scaled by the root of
    two, so that distances are those of whole spectra; limit is null. With the rate the block's
    masking thresholds are in limit, and magnitudes not above them are 0 in x.
    """
    twice = np.where(np.arange(size // 2 + 1) % (size / 2) == 0, 1.0, math.sqrt(2))

    @F.pandas_udf("x array<double>, limit array<double>")
    def go(block: pd.Series) -> pd.DataFrame:
        from tremolo.functions.psychoacoustics import MaskingModel

        if not len(block):
            return pd.DataFrame({"x": [], "limit": []})
        m = np.abs(np.fft.rfft(np.stack(block), axis=1))
        if rate is None:
            return pd.DataFrame({"x": list(m * twice), "limit": [None] * len(m)})
        limit = MaskingModel(size, rate).threshold(m)
        return pd.DataFrame({"x": list(m * (m > limit)), "limit": list(limit)})

    return blocks.select("clip_id", "m", go("block").alias("s")).select("clip_id", "m", "s.x", "s.limit")


def _norm(gaps: Column) -> Column:
    return F.sqrt(F.aggregate(gaps, F.lit(0.0), lambda s, v: s + v * v))


def distances(spectra: DataFrame, band: int, masked: bool = False) -> DataFrame:
    """(clip_id, m, other, dist) for blocks of a clip more than band apart, both ways.

    masked: the other block's magnitudes count only above the thresholds of both blocks, so
    the two directions differ.
    """
    a = spectra.select("clip_id", "m", "x", F.col("limit").alias("t"))
    b = spectra.select("clip_id", F.col("m").alias("other"), F.col("x").alias("y"), F.col("limit").alias("u"))
    pairs = a.join(b, "clip_id").where(F.col("other") - F.col("m") > band)
    if masked:
        above = lambda v, limit: F.zip_with(v, limit, lambda p, q: F.when(p > q, p).otherwise(0.0))
        there = _norm(F.zip_with("x", above("y", "t"), lambda p, q: p - q))
        back = _norm(F.zip_with("y", above("x", "u"), lambda p, q: p - q))
    else:
        there = back = _norm(F.zip_with("x", "y", lambda p, q: p - q))
    pairs = pairs.select("clip_id", "m", "other", there.alias("there"), back.alias("back"))
    both = F.explode(F.array(F.struct("m", "other", F.col("there").alias("dist")), F.struct(F.col("other").alias("m"), F.col("m").alias("other"), F.col("back").alias("dist"))))
    return pairs.select("clip_id", both.alias("p")).select("clip_id", "p.m", "p.other", "p.dist")


def candidates(dist: DataFrame, upper: float) -> DataFrame:
    return dist.where(F.col("dist") <= upper)


def first_k(found: DataFrame, k: int) -> DataFrame:
    """The first k candidates of each block by position, not by distance."""
    rank = F.row_number().over(Window.partitionBy("clip_id", "m").orderBy("other"))
    return found.withColumn("rank", rank.cast("int")).where(F.col("rank") <= k)


def nearest(dist: DataFrame) -> DataFrame:
    """The nearest other block of each; the first one on ties."""
    best = F.min(F.struct("dist", "other"))
    return dist.groupBy("clip_id", "m").agg(best.alias("b")).select("clip_id", "m", F.col("b.other").alias("other"), F.col("b.dist").alias("dist"))


def overlap_add(blocks: DataFrame, size: int, hop: int) -> DataFrame:
    """(clip_id, i, x): blocks windowed again, summed and divided by the summed squared window."""
    w = F.lit(0.5) - F.lit(0.5) * F.cos(F.lit(2 * math.pi) * (F.col("j") + 1) / F.lit(size + 1))
    each = blocks.select("clip_id", "m", F.posexplode("block").alias("j", "v")).withColumn("w", w)
    return each.groupBy("clip_id", (F.col("m") * hop + F.col("j")).alias("i")).agg((F.sum(F.col("v") * F.col("w")) / F.sum(F.col("w") * F.col("w"))).alias("x"))


def fits(blocks: DataFrame, chosen: DataFrame, near: DataFrame, size: int, rate: int | None = None) -> DataFrame:
    """Least-squares fits of blocks(clip_id, m, block) from their chosen ones, and whether they are kept.

    chosen(clip_id, m, other, rank) has a bounded number of rows for each block, near(clip_id, m, dist) its
    smallest distance. A row for each block with chosen ones: n_used, fit, fit_dist (distance of spectra,
    with what masking hides left out where rate is given), best_dist and kept: the fit is no
    farther than the nearest block.
    """

    @F.pandas_udf("fit array<double>, fit_dist double")
    def solve(block: pd.Series, basis: pd.Series) -> pd.DataFrame:
        from tremolo.functions import dsp
        from tremolo.functions.psychoacoustics import MaskingModel

        fit, dist = [None] * len(block), np.zeros(len(block))
        count = np.array([len(b) for b in basis], int)
        half = lambda x: np.abs(np.fft.rfft(x, axis=1))
        for k in np.unique(count):
            at = np.flatnonzero(count == k)
            x, a = np.stack(block.iloc[at]), np.stack([np.stack(basis.iloc[i]) for i in at])
            y = dsp.fit_blocks(x, a)
            p, q = half(x), half(y)
            if rate is None:
                dist[at] = np.linalg.norm((p - q) * np.where(np.arange(size // 2 + 1) % (size / 2) == 0, 1.0, math.sqrt(2)), axis=1)
            else:
                model = MaskingModel(size, rate)
                t = model.threshold(p)
                dist[at] = np.linalg.norm(p * (p > t) - q * (q > np.maximum(t, model.threshold(q))), axis=1)
            for i, v in zip(at, y):
                fit[i] = v
        return pd.DataFrame({"fit": fit, "fit_dist": dist})

    others = blocks.select("clip_id", F.col("m").alias("other"), F.col("block").alias("near"))
    basis = chosen.join(others, ["clip_id", "other"]).groupBy("clip_id", "m").agg(F.sort_array(F.collect_list(F.struct("rank", "near"))).alias("basis"))
    rows = blocks.join(basis, ["clip_id", "m"]).select("clip_id", "m", F.size("basis").alias("n_used"), solve("block", F.col("basis.near")).alias("s"))
    rows = rows.select("clip_id", "m", "n_used", "s.fit", F.col("s.fit_dist").alias("fit_dist")).join(near.select("clip_id", "m", F.col("dist").alias("best_dist")), ["clip_id", "m"])
    return rows.withColumn("kept", F.col("fit_dist") <= F.col("best_dist"))


def replaced(blocks: DataFrame, fitted: DataFrame) -> DataFrame:
    """blocks(clip_id, m, block) with the kept fits in place, and whether each was replaced."""
    kept = fitted.where("kept").select("clip_id", "m", "fit")
    return blocks.join(kept, ["clip_id", "m"], "left").select("clip_id", "m", F.coalesce("fit", "block").alias("block"), F.col("fit").isNotNull().alias("replaced"))


def replaced_share(done: DataFrame) -> DataFrame:
    """(clip_id, n_blocks, n_replaced, per_cent) of replaced()."""
    n = done.groupBy("clip_id").agg(F.count("*").alias("n_blocks"), F.sum(F.col("replaced").cast("long")).alias("n_replaced"))
    return n.withColumn("per_cent", F.col("n_replaced") * 100.0 / F.col("n_blocks"))
