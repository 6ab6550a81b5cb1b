r"""How five filters of texts act on one another, whatever the order they are applied in.

What a filter does depends only on which filters came before it, not on their order, so the
120 orders of five filters are paths in a lattice of 32 subsets with 80 edges (filters already
applied, next filter). Rows are first counted in cells of equal part, failed filters and
labels, so a hot part or text is a few rows of each task before it is shuffled; each cell
then adds to the 80 edges, and the summed edges are joined to the 600 steps of the orders.

Failure: A under 100 words, B 100 * distinct words < 80 * words, C 100 * [A-Z] > 10 * code
points, D holds one of [#$%&*|], E equal to the text of any smaller doc_id of the table.

Defined cases: null texts are empty; a null lang is the part ''; a null doc_id has no labels,
isn't smaller than any id and has no smaller one, so such rows neither fail E nor make others
fail; rows of one doc_id and one text don't fail E by one another; of several labels of an id
a 1 counts; an empty table has no part and gives no row; very long texts count whole; other
columns are ignored, whatever their names.
"""

from __future__ import annotations

from itertools import permutations
from math import factorial

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

FILTERS = "ABCDE"
_ALL = (1 << len(FILTERS)) - 1
_COUNTS = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost"]


def failures(docs: DataFrame) -> DataFrame:
    """(id, part, digest, failed): the filters A to D that each row's text fails, as bits, A the lowest."""
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("words", F.array_remove(F.split("text", r"[\x20\x09-\x0D]+"), ""))
    rows = rows.select(
        "id", "part", "text", F.size("words").alias("n"), F.size(F.array_distinct("words")).alias("d"), F.length("text").alias("chars"),
        F.length(F.regexp_replace("text", "[A-Z]+", "")).alias("others"), F.sha2(F.col("text").cast("binary"), 256).alias("digest"),
    )
    fails = [F.col("n") < 100, 100 * F.col("d") < 80 * F.col("n"), 100 * (F.col("chars") - F.col("others")) > 10 * F.col("chars"), F.col("text").rlike(r"[#$%&*|]")]
    return rows.select("id", "part", "digest", sum((F.when(c, 1 << k).otherwise(0) for k, c in enumerate(fails)), F.lit(0)).alias("failed"))


def cells(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, failed, good, toxic, n): rows alike in these, counted; E is the highest bit of failed."""
    rows = failures(docs).groupBy("id", "part", "digest", "failed").agg(F.count("*").alias("m"))
    # Null ids have no label and never match: dealt by their text, so that they don't meet in one task.
    rows = rows.withColumn("deal", F.when(F.col("id").isNull(), F.xxhash64("digest")).otherwise(F.lit(0).cast("long")))
    has = lambda name: F.max((F.coalesce(F.col(name), F.lit(0)) == 1).cast("int")).alias(name)
    marks = labels.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("id"), "quality", "toxic").groupBy("id").agg(has("quality"), has("toxic"))
    rows = rows.join(marks.withColumn("deal", F.lit(0).cast("long")), ["id", "deal"], "left")
    kind = ["digest", "part", "failed", "good", "toxic"]
    rows = rows.select("id", "m", "digest", "part", "failed", F.coalesce("quality", F.lit(0)).alias("good"), F.coalesce("toxic", F.lit(0)).alias("toxic"))
    known = F.when(F.col("id").isNotNull(), F.struct("id", "m"))
    kinds = rows.groupBy(*kind).agg(F.sum("m").alias("n"), F.sum(known["m"]).alias("known"), F.min(known).alias("least"))
    kinds = kinds.withColumn("first", F.min("least.id").over(Window.partitionBy("digest")))
    later = F.coalesce(F.col("known") - F.when(F.col("least.id") == F.col("first"), F.col("least.m")).otherwise(0), F.lit(0))
    both = F.array(F.struct(F.col("failed"), (F.col("n") - later).alias("n")), F.struct((F.col("failed") + 16).alias("failed"), later.alias("n")))
    split = kinds.select("part", "good", "toxic", F.explode(both).alias("x")).select("part", "good", "toxic", "x.failed", "x.n")
    return split.where("n > 0").groupBy("part", "failed", "good", "toxic").agg(F.sum("n").alias("n"))


def lattice_edges(counted: DataFrame) -> DataFrame:
    """Of cells() the sums of all 80 edges of each part, and the share of each filter over all orders."""
    made = [F.struct(F.lit(s).alias("applied"), F.lit(f).alias("next")) for s in range(_ALL + 1) for f in range(len(FILTERS)) if not s >> f & 1]
    e = counted.select("*", F.explode(F.array(*made)).alias("e")).select("part", "failed", "good", "toxic", "n", "e.applied", "e.next")
    bit = F.expr("shiftleft(1, next)")
    fails, before = F.col("failed").bitwiseAND(bit) != 0, F.col("failed").bitwiseAND(F.col("applied")) != 0
    removed = fails & ~before
    what = [~fails & ~before, removed, fails & before, F.col("failed") == bit, removed & (F.col("good") == 1), removed & (F.col("toxic") == 1)]
    e = e.groupBy("part", "applied", "next").agg(*(F.sum(F.when(c, F.col("n")).otherwise(0)).alias(name) for name, c in zip(_COUNTS, what)))
    # An edge lies on |applied|! * (4 - |applied|)! of the 120 paths.
    ways = F.lit(0)
    for k in range(len(FILTERS)):
        ways = F.when(F.bit_count("applied") == k, factorial(k) * factorial(len(FILTERS) - 1 - k)).otherwise(ways)
    return e.withColumn("shapley", F.sum(F.col("removed") * ways).over(Window.partitionBy("part", "next")))


def orders() -> list[tuple[str, int, int, int]]:
    """The 600 steps: order, step from 1, filters applied before it, filter of the step."""
    out = []
    for p in permutations(range(len(FILTERS))):
        name, applied = "".join(FILTERS[f] for f in p), 0
        for k, f in enumerate(p):
            out.append((name, k + 1, applied, f))
            applied |= 1 << f
    return out


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per part, filter order and step; docs(doc_id, text, lang), labels(doc_id, quality, toxic)."""
    steps = docs.sparkSession.createDataFrame(orders(), "filter_order string, step int, applied int, next int")
    got = lattice_edges(cells(docs, labels)).join(F.broadcast(steps), ["applied", "next"])
    return got.select("part", "filter_order", "step", *_COUNTS, "shapley")
