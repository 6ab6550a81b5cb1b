"""Exact top-k inner products by an impact-ordered index, score at a time.

Components are quantised to whole impacts. Rows are dealt to shards of a bounded size; a
shard keeps for each dimension its rows in order of impact, cut into posting segments. For a
query, a row's contribution in a dimension counts by its excess over the least one in the
shard, so that none is negative. Segments of all dimensions are processed in descending order
of the excess at their heads. From time to time the excess still to come to any row is bounded
by the heads of each dimension's next segment; rows whose partial score plus that bound
reaches the k-th best exact score known so far are possible members. Processing stops only
when these are proved to be few, or cost less to rescore than the postings left; they are
rescored exactly.

A shard stays in place and queries come to it in blocks. Where there are many shards, each
query first meets one of them; its k-th best score there is where the search of all begins.

Defined cases: vectors that are null or have null or non-finite components take no part;
shorter vectors count as if they had zeros up to the longest; rows with one id count once,
with the smallest vector; ties go to the smaller id; empty tables give no row.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tremolo.llm import _text as X
from tremolo.llm._store import cut

SHARD_ROWS = 16384
QUERY_BLOCK = 256
SEGMENT = 256
#: Segments processed before the first look at the bound; each further stretch adds a share.
FIRST = 64
#: Possible members that are rescored without waiting for a tighter bound.
FEW = 64
#: What a posting costs, in components of a row that is rescored.
POSTING = 3
#: From so many shards on, each query first meets one of them; with fewer that costs too large a share.
CARRY = 16
NONE = np.iinfo(np.int64).min


class Shard:
    """Postings of a shard's rows by dimension, in order of impact, in segments. read and rescored count its work."""

    def __init__(self, ids: np.ndarray, impacts: np.ndarray):
        self.ids, self.impacts = ids, impacts.astype(np.int64)
        self.read = self.rescored = 0
        n, d = impacts.shape
        count = -(-n // SEGMENT)
        order = np.argsort(impacts, axis=0, kind="stable").T  # ascending in each dimension
        pad = count * SEGMENT - n
        self.rows = np.stack([np.pad(o, ((0, 0), (0, pad)), constant_values=n).reshape(d, count, SEGMENT) for o in (order[:, ::-1], order)])
        full = np.vstack([self.impacts, np.zeros((1, d), np.int64)]).astype(np.float64)
        self.last = np.stack([self.impacts.min(axis=0), self.impacts.max(axis=0)]).astype(np.float64)
        self.over = full[self.rows, np.arange(d)[:, None, None]] - self.last[:, :, None, None]
        self.floats = full[:-1]
        self.largest = int(np.abs(self.impacts).max(initial=0))

    def exact(self, q: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """Whole inner products; in floating point where every sum is below 2^53 and so exact."""
        self.rescored += len(rows)
        if self.largest * int(np.abs(q).max(initial=0)) * len(q) >= 2**53:
            return self.impacts[rows] @ q
        return (self.floats[rows] @ q.astype(np.float64)).astype(np.int64)

    def search(self, q: np.ndarray, own: int, k: int, floor: int = NONE) -> tuple[np.ndarray, np.ndarray]:
        """Ids and exact scores of the k best rows of at least floor, without the query's own."""
        n, d = self.impacts.shape
        side, dims = (q < 0).astype(int), np.arange(d)
        least = self.last[side, dims] * q
        excess = self.over[side, dims, :, 0] * q[:, None]
        count = excess.shape[1]
        order = np.argsort(-excess, axis=None, kind="stable")[: int((excess > 0).sum())]
        dim, place = order // count, order % count
        base, slack = least.sum(), 1e-12 * self.largest * np.abs(q).sum()  # of sums in floating point
        partial, done, at, reach = np.zeros(n + 1), np.zeros(d, np.int64), 0, floor
        mine = self.ids == own
        while True:
            upto = min(len(order), max(FIRST, at + max(at // 4, len(order) // 8)))
            i, s = dim[at:upto], place[at:upto]
            weights = self.over[side[i], i, s] * q[i, None]
            partial += np.bincount(self.rows[side[i], i, s].ravel(), weights=weights.ravel(), minlength=n + 1)
            done += np.bincount(i, minlength=d)
            self.read += SEGMENT * len(i)
            at = upto
            to_come = np.where(done < count, excess[dims, np.minimum(done, count - 1)], 0).sum()
            seen = base + partial[:n]
            seen[mine] = -np.inf
            first = np.argpartition(-seen, min(2 * k, n - 1))[: 2 * k]
            first = first[~mine[first]]
            if len(first) >= k:
                reach = max(reach, int(np.sort(self.exact(q, first))[-k]))
            possible = np.flatnonzero((seen + to_come + slack >= reach) & ~mine)
            if at == len(order) or len(possible) <= FEW or (2 * len(possible) <= n and len(possible) * d <= POSTING * SEGMENT * (len(order) - at)):
                break
        exact = self.exact(q, possible)
        possible, exact = possible[exact >= reach], exact[exact >= reach]
        best = np.lexsort((self.ids[possible], -exact))[:k]
        return self.ids[possible][best], exact[best]


@X.releases
def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, vec_id, impacts, floor) of a partition in packed form, a row for each key; impacts in the smallest type."""
    groups: dict[int, list] = {}
    for batch in batches:
        for key, *x in zip(*(batch.column(c).to_pylist() for c in range(4))):
            groups.setdefault(key, []).append(x)
    for key, rows in sorted(groups.items()):
        rows.sort(key=lambda r: r[0])
        m = np.zeros((len(rows), max(len(v) for _, v, _ in rows)), np.int64)
        for r, (_, v, _) in enumerate(rows):
            m[r, : len(v)] = v
        small = next(t for t in (np.int8, np.int16, np.int32, np.int64) if not m.size or np.iinfo(t).min <= m.min() and m.max() <= np.iinfo(t).max)
        ids, floor = (np.array([r[c] for r in rows], np.int64).tobytes() for c in (0, 2))
        yield pa.RecordBatch.from_pydict({"key": [key], "n": [len(rows)], "ids": [ids], "kind": [np.dtype(small).str], "impacts": [m.astype(small).tobytes()], "floors": [floor]}, pa.schema([("key", pa.int32()), ("n", pa.int32()), ("ids", pa.binary()), ("kind", pa.string()), ("impacts", pa.binary()), ("floors", pa.binary())]))


_PACKED = "key int, n int, ids binary, kind string, impacts binary, floors binary"
_FOUND = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])


@X.releases
def _search(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """Rows come in order of shard, the shard's own row before the blocks of queries."""
    shard = None
    for batch in batches:
        for x in batch.to_pylist():
            ids, impacts = np.frombuffer(x["ids"], np.int64), np.frombuffer(x["impacts"], x["kind"]).reshape(x["n"], -1)
            if x["block"] < 0:
                shard = Shard(ids, impacts)
                continue
            wide = shard.impacts.shape[1]
            out: list[tuple] = []
            for own, q, floor in zip(ids.tolist(), impacts.astype(np.int64), np.frombuffer(x["floors"], np.int64).tolist()):
                q = np.pad(q, (0, max(0, wide - len(q))))[:wide]
                if wide:
                    out += [(own, i, s) for i, s in zip(*(v.tolist() for v in shard.search(q, own, k, floor)))]
            yield pa.RecordBatch.from_pydict({name: [o[c] for o in out] for c, name in enumerate(_FOUND.names)}, _FOUND)


def impacts_of(vectors: DataFrame, scale: int = 256, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """vec_id and whole impacts floor(scale * component) of the vectors that take part."""
    v = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("v"))
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    v = v.where(F.col("vec_id").isNotNull() & F.col("v").isNotNull()).where(~bad).groupBy("vec_id").agg(F.min("v").alias("v"))
    return v.select("vec_id", F.transform("v", lambda x: F.floor(x * scale)).alias("impacts"))


def top_k(vectors: DataFrame, is_query, k: int = 5, scale: int = 256, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: of each row that is_query (a condition on vec_id) holds for, the k best others."""
    rows = cut(impacts_of(vectors, scale, id_col, vec_col))
    total, asked = rows.agg(F.count("*"), F.count(F.when(is_query, 1))).first()
    shards, blocks = max(1, -(-total // SHARD_ROWS)), max(1, -(-asked // QUERY_BLOCK))
    # Where there are few shards, each stands in several tasks, which share out the blocks.
    groups = max(1, min(blocks, 2 * vectors.sparkSession.sparkContext.defaultParallelism // shards))
    spread = lambda n, salt: F.pmod(F.xxhash64("vec_id", F.lit(salt)), F.lit(n)).cast("int")
    pack = lambda df, n: df.repartitionById(n, "key").mapInArrow(_pack, _PACKED)
    index = cut(pack(rows.select(spread(shards, 1).alias("key"), "vec_id", "impacts", F.lit(0).cast("long").alias("floor")), shards))
    ask = rows.where(is_query)

    def search(queries: DataFrame, to_shard) -> DataFrame:
        """queries: key (block), vec_id, impacts, floor, packed by block; to_shard: the shards they go to."""
        left = index.select(F.col("key").alias("shard"), F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("group"), F.lit(-1).alias("block"), *index.columns[1:])
        right = queries.select(to_shard.alias("shard"), F.pmod("key", F.lit(groups)).alias("group"), F.col("key").alias("block"), *queries.columns[1:])
        both = left.union(right).withColumn("task", (F.col("shard") * groups + F.col("group")).cast("int"))
        both = both.repartitionById(shards * groups, "task").sortWithinPartitions("task", "block").drop("task")
        return both.mapInArrow(partial(_search, k=k), "query_id long, vec_id long, score long")

    floor = F.lit(NONE).alias("floor")
    if shards >= CARRY:
        near = pack(ask.select(spread(blocks, 2).alias("key"), "vec_id", "impacts", floor), blocks)
        kth = search(near, F.pmod("key", F.lit(shards))).groupBy("query_id").agg(F.count("*").alias("found"), F.min("score").alias("least")).where(F.col("found") == k)
        ask = ask.join(kth.select(F.col("query_id").alias("vec_id"), "least"), "vec_id", "left")
        floor = F.coalesce("least", F.lit(NONE)).alias("floor")
    asks = pack(ask.select(spread(blocks, 2).alias("key"), "vec_id", "impacts", floor), blocks)
    found = search(asks, F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")).cast("int")
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
