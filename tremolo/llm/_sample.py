"""Bounded samples of labelled rows for fitting models on the driver."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_SEED = 20_240_611
_FINE = 1_000_003


def per_class(rows: DataFrame, label: str, key: str, most: int, known: dict | None = None) -> DataFrame:
    """Of each value of label about most rows, all if it has fewer; chosen by a hash of key.

    Only the count of each label goes to the driver.
    """
    counts = known if known is not None else {r[0]: r[1] for r in rows.groupBy(label).count().collect()}
    share = F.lit(0.0)
    for value, n in sorted(counts.items(), key=lambda x: str(x[0])):
        share = F.when(F.col(label) == F.lit(value), F.lit(min(1.0, most / max(n, 1)))).otherwise(share)
    return rows.where(F.pmod(F.xxhash64(F.lit(_SEED), F.col(key)), F.lit(_FINE)) < share * _FINE)


def labelled(docs: DataFrame, labels: DataFrame, label: str, most: int, where: Column | None = None) -> list[tuple]:
    """(doc_id, text, label), in order of doc_id, of at most about most rows of each label.

    labels: doc_id and 0/1 label; null ids and labels are left out, and of several labels of
    an id the smallest counts. where: condition on doc_id. The ids are chosen first, so that
    what is broadcast is bounded by most and the number of labels.
    """
    one = labels.select(F.col("doc_id").cast("long"), F.col(label).cast("int").alias("label")).where("doc_id is not null and label is not null")
    if where is not None:
        one = one.where(where)
    one = one.groupBy("doc_id").agg(F.min("label").alias("label")).where("label in (0, 1)")
    ids = per_class(one, "label", "doc_id", most)
    got = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string").alias("text")).join(F.broadcast(ids), "doc_id")
    seen, out = set(), []
    for r in sorted(got.collect(), key=lambda r: (r[0], r[1] or "")):
        if r[0] not in seen:
            seen.add(r[0])
            out.append((r[0], r[1] or "", r[2]))
    return out
