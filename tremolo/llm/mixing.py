"""Mixing sources to target weights: exact block quotas dealt by a hypergeometric tree.

Every source's documents fall by a hash into a fixed number of blocks, and its blocks have a
fixed permuted order. A source's target (its weight's share of all words, at most `most`
times its own size, the rest reshared) fixes how often all its blocks are taken and which
further blocks, in permuted order, are taken once more; only the block where the target is
met is split, between documents in hash order. What is taken of a block at once is a slot,
and a source's count of slots is its quota.

A binary tree deals the quotas to the output shards: each node gives its left half an exact
number of its slots, drawn without replacement, so the counts by source follow the
multivariate hypergeometric law. A leaf's quota of a source then takes the next slots of
that source's permuted list, so shards get disjoint blocks, and within a shard rows are
sorted by a hash: emit() brings each shard's rows together. Only counts of blocks meet in
windows, never documents of a source.

Everything is DataFrame expressions. Defined cases: null and empty texts have size 0 and are
taken 0 words; null sources are one source, after all others; rows that repeat a doc_id are
taken alike; an empty table gives no row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tremolo.llm._store import cut

BLOCKS = 128
SHARDS = 8
SEED = "mix-1"
#: Rows of the table of blocks up to which it is broadcast; beyond, the join shuffles.
SMALL = 200_000


def draw(*parts: Column) -> Column:
    """Hex digits that depend on nothing but the parts."""
    return F.md5(F.concat_ws("|", F.lit(SEED), *(F.coalesce(p.cast("string"), F.lit("\u0000")) for p in parts)).cast("binary"))


def _number(hex_digits: Column) -> Column:
    return F.conv(F.substring(hex_digits, 1, 8), 16, 10).cast("long")


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sources: DataFrame, most: float = 3.0, weights: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """sources(source, source_size) with weight and target.

    A source stops at most * its size; with sources in order of most * size / weight the ones
    that stop come first, and what is left is shared by the weights of the others.
    """
    all_rows = Window.orderBy(F.col("source").isNull(), "source")
    s = sources.withColumn("place", F.row_number().over(all_rows))
    s = s.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("place") - 1) % len(weights) + 1))
    s = s.withColumn("stops_at", F.lit(most) * F.col("source_size") / F.col("weight"))
    order = Window.orderBy("stops_at", "place")
    before, after = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    whole = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    stopped = F.coalesce(F.sum(F.lit(most) * F.col("source_size")).over(before), F.lit(0.0))
    s = s.withColumn("level", (F.sum("source_size").over(whole) - stopped) / F.sum("weight").over(after))
    fits = F.when(F.col("level") <= F.col("stops_at"), F.struct("stops_at", "place", "level"))
    s = s.withColumn("share", F.min(fits).over(whole)["level"])
    return s.select("source", "source_size", "weight", F.least(F.lit(most) * F.col("source_size"), F.coalesce("share", F.lit(0.0)) * F.col("weight")).alias("target"))


def _blocks(sized: DataFrame, most: float) -> DataFrame:
    """Blocks with their source's numbers, place in permuted order, and what is taken of them."""
    blocks = cut(sized.groupBy("source", "block").agg(F.sum("size").alias("block_size")))
    t = targets(blocks.groupBy("source").agg(F.sum("block_size").alias("source_size")), most).withColumnRenamed("source", "of")
    b = blocks.join(t, F.col("source").eqNullSafe(F.col("of"))).drop("of")
    order = Window.partitionBy("source").orderBy(draw(F.col("source"), F.col("block")), "block")
    b = b.withColumn("place", F.row_number().over(order) - 1).withColumn("upto", F.sum("block_size").over(order))
    b = b.withColumn("n_blocks", F.count("*").over(Window.partitionBy("source")))
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    b = b.withColumn("passes", F.least(F.floor(ratio), F.lit(int(most))))
    b = b.withColumn("rest", F.col("target") - F.col("passes") * F.col("source_size"))
    b = b.withColumn("want", F.col("rest") - (F.col("upto") - F.col("block_size")))
    b = b.withColumn("extra", F.when(F.col("want") <= 0, 0).when(F.col("want") >= F.col("block_size"), 2).otherwise(1))
    return cut(b.withColumn("slots", F.col("passes") + (F.col("extra") > 0).cast("int")))


def deal(quotas: DataFrame, shards: int = SHARDS) -> DataFrame:
    """(shard, source, quota) from (source, quota): shards is a power of two."""
    node = quotas.select(F.lit(1).alias("node"), "source", F.col("quota").cast("long").alias("quota"))
    size = 1
    while size < shards:
        slots = node.select("node", "source", F.explode(F.when(F.col("quota") > 0, F.sequence(F.lit(1), F.col("quota").cast("int"))).otherwise(F.array().cast("array<int>"))).alias("slot"))
        rank = F.row_number().over(Window.partitionBy("node").orderBy(draw(F.lit("tree"), F.col("node"), F.col("source"), F.col("slot")), "slot"))
        half = F.floor(F.count("*").over(Window.partitionBy("node")) / 2)
        slots = slots.withColumn("left", (rank <= half).cast("int"))
        node = slots.groupBy((F.col("node") * 2 + 1 - F.col("left")).alias("node"), "source").agg(F.count("*").alias("quota"))
        size *= 2
    return node.select((F.col("node") - shards).cast("int").alias("shard"), "source", "quota")


def _shards_of(b: DataFrame, shards: int) -> DataFrame:
    """(source, block, shards): the shard of each slot of a block, first pass first."""
    leaves = deal(b.groupBy("source").agg(F.sum("slots").alias("quota")), shards)
    order = Window.partitionBy("source").orderBy("shard")
    leaves = leaves.withColumn("upto", F.sum("quota").over(order))
    leaves = leaves.select("source", "shard", F.explode(F.sequence(F.col("upto") - F.col("quota"), F.col("upto") - 1)).alias("slot"))
    own = b.where("slots > 0").select("source", "block", F.explode(F.transform(F.sequence(F.lit(0), (F.col("slots") - 1).cast("int")), lambda k: k * F.col("n_blocks") + F.col("place"))).alias("slot"))
    both = own.join(leaves.withColumnsRenamed({"source": "of", "slot": "of_slot"}), F.col("source").eqNullSafe(F.col("of")) & (F.col("slot") == F.col("of_slot"))).select("source", "block", "slot", "shard")
    return both.groupBy("source", "block").agg(F.transform(F.sort_array(F.collect_list(F.struct("slot", "shard"))), lambda x: x["shard"]).alias("shards"))


def mix(docs: DataFrame, most: float = 3.0, blocks: int = BLOCKS, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", carry: bool = False) -> DataFrame:
    """Per row of docs: doc_id, size, source_size, target, copies, taken, shards (one for each copy).

    carry: keep the input's row under `row`, for emit().
    """
    sized = docs.select(
        F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"), word_count(F.col(text_col).cast("string")).alias("size"),
        _number(draw(F.lit("block"), F.col(id_col))).alias("h"), *([F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")] if carry else []),
    )
    sized = sized.withColumn("block", F.pmod(F.col("h"), F.lit(blocks)).cast("int")).drop("h")
    b = _blocks(sized.select("source", "block", "size"), most)
    s = _shards_of(b, shards).withColumnsRenamed({"source": "s_source", "block": "s_block"})
    b = b.join(s, F.col("source").eqNullSafe(F.col("s_source")) & (F.col("block") == F.col("s_block")), "left")
    b = b.select(F.col("source").alias("b_source"), F.col("block").alias("b_block"), "source_size", "target", "passes", "extra", "want", "shards")
    on = F.col("source").eqNullSafe(F.col("b_source")) & (F.col("block") == F.col("b_block"))
    # The one split block of a source: its documents in hash order, ties together.
    split = sized.select("source", "block", "size", "doc_id").join(b.where("extra = 1").select("b_source", "b_block", "want"), on)
    split = split.withColumn("key", draw(F.lit("split"), F.col("doc_id"))).groupBy("source", "block", "want", "key").agg(F.sum("size").alias("size"))
    upto = F.sum("size").over(Window.partitionBy("source", "block").orderBy("key"))
    split = split.withColumn("in", upto - F.col("size") / 2 <= F.col("want")).where("in").groupBy("source", "block").agg(F.max("key").alias("last_key"))
    split = split.withColumnsRenamed({"source": "l_source", "block": "l_block"})
    b = b.join(split, F.col("b_source").eqNullSafe(F.col("l_source")) & (F.col("b_block") == F.col("l_block")), "left").drop("l_source", "l_block")
    b = cut(b)
    if b.count() <= SMALL:  # a row for each block of each source
        b = F.broadcast(b)
    rows = sized.join(b, on)
    once = F.when(F.col("extra") == 2, 1).when((F.col("extra") == 1) & (draw(F.lit("split"), F.col("doc_id")) <= F.col("last_key")), 1).otherwise(0)
    rows = rows.withColumn("copies", (F.col("passes") + once).cast("int"))
    out = ["doc_id", "size", "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken"), F.slice(F.coalesce("shards", F.array().cast("array<int>")), F.lit(1), F.col("copies")).alias("shards")]
    return rows.select(*out, *(["row"] if carry else []))


def emit(mixed: DataFrame, shards: int = SHARDS, slices: int | None = None, shard_col: str | None = None) -> DataFrame:
    """The mix itself: a row for each copy, with the input's columns, shard by shard.

    mixed: mix(..., shards=shards, carry=True). Each shard is `slices` partitions in a row (by
    the session's shuffle partitions if none are given), a range of the order each, so shard k
    is partitions k * slices to (k + 1) * slices - 1 and is sorted by a hash throughout.
    shard_col: name for a column with the shard.
    """
    if slices is None:
        slices = max(1, -(-int(mixed.sparkSession.conf.get("spark.sql.shuffle.partitions")) // shards))
    each = mixed.select("row", "doc_id", F.posexplode("shards").alias("copy", "shard"))
    # Rows that share an id, or have none, are told apart by their values.
    values = F.xxhash64(*(F.col(f"row.`{f.name}`") for f in mixed.schema["row"].dataType.fields if isinstance(f.dataType, T.AtomicType)))
    each = each.withColumn("turn", draw(F.lit("order"), F.col("doc_id"), F.col("copy"), values))
    place = F.col("shard") * slices + F.floor(_number(F.col("turn")) * slices / F.lit(float(2**32)))
    each = each.repartitionById(shards * slices, place.cast("int")).sortWithinPartitions("shard", "turn")
    return each.select("row.*", *([F.col("shard").alias(shard_col)] if shard_col else []))
