"""N-gram Jaccard join: size-banded tiles, bitmap bounds, exact intersection.

A text's set holds the hashes of its distinct n-word shingles. Equal sets are one node.
Sizes are cut into geometric bands; sets of one band, and of the band below as far as
their size allows, meet in tiles. If L bounds the sizes in a tile, two linked sets there
differ in at most H = floor(2 L (1 - t) / (1 + t)) members, so if the hash range is cut
into H + 1 + s slices, at least 1 + s slices hold equal members. A tile is a band and one
slice's content; each set goes to the tiles of its non-empty slices, and a set with more
than s empty slices to the tiles of its empty ones too. So every linked pair meets in a
tile, whatever passages other documents share with it, and no frequency list is needed.

Each set is first paired with the smallest and the largest set of its tiles, and links found
that way make first components. Tiles with the same smallest member are one family. Only
families that hold sets of different components are compared pair by pair, in blocks: first
for as few pairs as would join these components, then, in the families where such a pair
didn't link, for all that is left. In all steps parity bitmaps bound the overlap from above:
the set bits of the xor of two bitmaps can't outnumber the members that the sets don't share.
What is left is decided by intersecting the sorted hash arrays of the two whole texts; the
text that many pairs have in common travels once for a block of them.

Defined cases: null and empty texts, and texts without words, have an empty set, link with
nothing and are their own component; repeated rows share a node; texts with under n words
have their whole sequence as the one member; texts of any length count whole, a task holds
one at a time; a null id takes part in links, and a component has null for its id only if all
its ids are null; several texts under one id are nodes of their own, each row has its own
text's component; an empty table gives an empty one; columns of the input other than the two
named are ignored. Shingles, and sets as a whole, are compared as 64-bit hashes: among 10^9
different sets two are expected to be taken for one with a chance of 3 %.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tremolo.llm import _text as X
from tremolo.llm._store import cut
from tremolo.llm.components import connected_components

#: Bands of sizes grow by the largest power of 1 / t up to this, or by 1 / t.
BAND_RATIO = 1.4
#: Entries of a tile bucket; a task takes one bucket.
BUCKET = 1_000_000
#: Entries that are dealt out at once.
DEAL = 1 << 18
#: Sets of a family that are compared as one block, and the most members they have together.
BLOCK, BLOCK_MEMBERS = 512, 1 << 24
#: Nodes in one row of a tile's list.
LIST = 2048
#: Blocks of the pairs of one text.
PAIR_BLOCKS = 1024
#: Rows of a table of numbers up to which it is broadcast; beyond that the join shuffles.
BROADCAST_ROWS = 400_000


def shingle_sets(t: X.Text, n: int) -> Iterator[tuple[int, np.ndarray]]:
    """Row number and sorted distinct shingle hashes of each text of a column."""
    for first, last, s in X.slices(t):
        data = X.lower(s.data)
        w = X.words_of(s, data, X.SPACE_WORD[data])
        shingles = X.windows(w.hashes, n)
        for i in range(last - first):
            a, b = w.first[i], w.first[i + 1]
            if b - a >= n:
                h = np.sort(shingles[a : b - n + 1])
                keep = np.ones(len(h), bool)
                np.not_equal(h[1:], h[:-1], out=keep[1:])
                yield first + i, h[keep]
            elif b > a:
                short = X.windows(w.hashes[a:b], b - a)
                yield first + i, X.mix(short ^ np.uint64(b - a))
            else:
                yield first + i, np.zeros(0, np.uint64)


def set_id(h: np.ndarray) -> int:
    """One number for a set; sets with the same number count as equal."""
    return int(X.mix(np.array([int(np.add.reduce(h)) ^ (len(h) << 48 & (1 << 64) - 1)], np.uint64)).view(np.int64)[0])


def parity_bitmap(h: np.ndarray) -> bytes:
    """Bit b is set if an odd number of members fall on it; two bits a member or more."""
    bits = 64
    while bits < 2 * len(h):
        bits *= 2
    odd = np.bincount((h & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def fold(bitmap: np.ndarray, words: int) -> np.ndarray:
    """A bitmap (last axis: 64-bit words) brought to fewer words."""
    while bitmap.shape[-1] > words:
        half = bitmap.shape[-1] // 2
        bitmap = bitmap[..., :half] ^ bitmap[..., half:]
    return bitmap


def most_apart(size: int, other, num: int, den: int):
    """Most members that linked sets of these sizes don't share."""
    both = size + other
    least = -(-num * both // (num + den))
    return both - 2 * least


class Bands:
    """Bounds of the size bands and the slices that a tile of a band needs."""

    def __init__(self, num: int, den: int):
        self.num, self.den = num, den
        self.ratio = (den / num) ** max(1, int(math.log(BAND_RATIO) / math.log(den / num))) if num < den else 2.0

    def band(self, n: int) -> int:
        return int(math.log(n) / math.log(self.ratio) + 1e-9)

    @lru_cache(256)  # noqa: B019
    def slices_of(self, band: int) -> tuple[int, int]:
        """Slices and spare ones in the tiles of a band."""
        most = math.ceil(self.ratio ** (band + 1)) + 1
        apart = int(2 * most * (self.den - self.num) / (self.den + self.num))
        if not apart:
            return 0, 0
        # As many as the smallest sets of the tile are likely to leave empty, so that few sets
        # have to meet in tiles of empty slices.
        smallest, spare = self.ratio**band * self.num / self.den, 1
        while spare < 0.6 * (apart + 1):
            empty = (apart + 1 + spare) * math.exp(-smallest / (apart + 1 + spare))
            if spare >= 1 + 1.5 * empty + 2 * math.sqrt(empty):
                break
            spare += 1
        return apart + 1 + spare, spare

    def bands_of(self, n: int) -> list[int]:
        """Bands of a set: its own, and the next if a linked set can be there."""
        own = self.band(n)
        return [own, own + 1] if self.band(max(n, n * self.den // self.num)) > own else [own]


@lru_cache(256)
def _edges(count: int) -> np.ndarray:
    return np.arange(count, dtype=np.uint64) * np.uint64((1 << 64) // count)


@lru_cache(256)
def _tags(band: int, count: int) -> np.ndarray:
    return X.mix(np.arange(count, dtype=np.uint64) + np.uint64(band << 40))


def tile_keys(h: np.ndarray, bands: Bands) -> np.ndarray:
    """Keys of the tiles that a set is in."""
    out = []
    sums = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(h, out=sums[1:])
    for band in bands.bands_of(len(h)):
        count, spare = bands.slices_of(band)
        if not count:
            continue
        edges = np.append(np.searchsorted(h, _edges(count)), len(h))
        keys = X.mix(np.diff(sums[edges]) + _tags(band, count))
        filled = edges[1:] > edges[:-1]
        if count - np.count_nonzero(filled) <= spare:
            keys = keys[filled]
        out.append(keys)
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


@X.releases
def _read_sets(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        nodes, sizes, maps = np.zeros(len(batch), np.int64), np.zeros(len(batch), np.int64), [None] * len(batch)
        for i, h in shingle_sets(X.text_of(batch.column(2)), n):
            sizes[i] = len(h)
            if len(h):
                nodes[i], maps[i] = set_id(h), parity_bitmap(h)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(nodes), pa.array(sizes), pa.array(maps, pa.binary())], ["id", "key", "node", "n", "bitmap"])


@X.releases
def _deal_tiles(batches: Iterator[pa.RecordBatch], n: int, num: int, den: int, buckets: int) -> Iterator[pa.RecordBatch]:
    """Entries of tiles, a row for each bucket at a time: the low six bytes of the keys, and the nodes."""
    bands, seen, keys, nodes, count = Bands(num, den), set(), [], [], 0
    small = np.uint16 if buckets < 1 << 16 else np.int64

    def flush():
        key, node = np.concatenate(keys), np.repeat(np.array(nodes, np.int64), [len(k) for k in keys])
        to = ((key >> np.uint64(32)) % np.uint64(buckets)).astype(small)
        order = np.argsort(to, kind="stable")
        to, key, node = to[order], key[order].view(np.uint8).reshape(-1, 8)[:, :6], node[order]
        at = np.flatnonzero(np.append(True, to[1:] != to[:-1]))
        ends = np.append(at[1:], len(to))
        return pa.RecordBatch.from_arrays([pa.array(to[at].astype(np.int32)), *(pa.array([x[a:b].tobytes() for a, b in zip(at, ends)], pa.binary()) for x in (key, node))], ["bucket", "keys", "nodes"])

    for batch in batches:
        for _, h in shingle_sets(X.text_of(batch.column(0)), n):
            if not len(h) or (node := set_id(h)) in seen:
                continue
            if len(seen) >= 1_000_000:  # what is dealt twice is found once
                seen.clear()
            seen.add(node)
            k = tile_keys(h, bands)
            if len(k):
                keys.append(k)
                nodes.append(node)
                count += len(k)
            if count >= DEAL:
                yield flush()
                keys, nodes, count = [], [], 0
    if count:
        yield flush()


@X.releases
def _find_tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lists of the sets of each tile of a bucket with two or more; tiles with the same list count once."""
    six, nodes = [], []
    for batch in batches:
        six += [np.frombuffer(x.as_buffer(), np.uint8) for x in batch.column(1)]
        nodes += [np.frombuffer(x.as_buffer(), np.int64) for x in batch.column(2)]
    if not nodes:
        return
    node = np.concatenate(nodes)
    wide = np.zeros((len(node), 8), np.uint8)
    wide[:, :6] = np.concatenate(six).reshape(-1, 6)
    del six, nodes
    key = wide.view("<u8").ravel()
    # keys that occur once are most; they go before the rest is sorted by node too
    order = np.argsort(key)
    key, node = key[order], node[order]
    same = key[1:] == key[:-1]
    twice = np.append(same, False) | np.append(False, same)
    key, node = key[twice], node[twice]
    order = np.lexsort((node, key))
    key, node = key[order], node[order]
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (node[1:] != node[:-1])
    key, node = key[new], node[new]
    if not len(key):
        return
    start = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    length = np.diff(np.append(start, len(key)))
    start, length = start[length > 1], length[length > 1]
    if not len(start):
        return
    sums = np.append(np.uint64(0), np.cumsum(X.mix(node.astype("<u8"))))
    content = X.mix(sums[start + length] - sums[start] + length.astype(np.uint64))
    _, once = np.unique(content, return_index=True)
    rows: dict[str, list] = {"tile": [], "part": [], "nodes": [], "low": [], "high": []}
    held = 0
    names = pa.schema([("tile", pa.int64()), ("part", pa.int32()), ("nodes", pa.list_(pa.int64())), ("low", pa.int64()), ("high", pa.int64())])
    for k in once:
        run = node[start[k] : start[k] + length[k]]
        for p, i in enumerate(range(0, len(run), LIST)):
            part = run[i : i + LIST]
            for name, x in zip(rows, (content[k].astype(np.int64), p, part, run[0], run[-1]), strict=True):
                rows[name].append(x)
            held += len(part)
        if held > 100_000:
            yield pa.RecordBatch.from_pydict(rows, names)
            rows, held = {x: [] for x in rows}, 0
    if held:
        yield pa.RecordBatch.from_pydict(rows, names)


def _bound(a: bytes, b: bytes, na: int, nb: int, num: int, den: int) -> bool:
    """Whether sizes and bitmaps leave room for a link."""
    if min(na, nb) * den < max(na, nb) * num:
        return False
    x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
    w = min(len(x), len(y))
    return int(np.bitwise_count(fold(x, w) ^ fold(y, w)).sum()) <= most_apart(na, nb, num, den)


def _bounded_pairs(batches: Iterator[pa.RecordBatch], num: int, den: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        c = [batch.column(i).to_pylist() for i in range(6)]
        keep = [_bound(p, q, m, n, num, den) for m, p, n, q in zip(c[2], c[3], c[4], c[5])]
        yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))


@X.releases
def _compare(batches: Iterator[pa.RecordBatch], num: int, den: int, forest: bool) -> Iterator[pa.RecordBatch]:
    """Pairs (tile, a, b) of each block, or of two blocks of a family; rows come in order of tile, i, j."""
    held = None
    for batch in batches:
        held = pa.concat_tables([held, pa.Table.from_batches([batch])]) if held else pa.Table.from_batches([batch])
        group = [held.column(x).to_numpy() for x in ("tile", "i", "j")]
        cuts = np.flatnonzero(np.append(True, np.any([x[1:] != x[:-1] for x in group], axis=0))) if len(held) else []
        if len(cuts) > 1:
            yield _compare_groups(held.slice(0, cuts[-1]), cuts, num, den, forest)
            held = held.slice(cuts[-1])
    if held:
        yield _compare_groups(held, np.array([0, len(held)]), num, den, forest)


def _compare_groups(rows: pa.Table, cuts: np.ndarray, num: int, den: int, forest: bool) -> pa.RecordBatch:
    rows = rows.combine_chunks()
    tile, i, j, side, node, n, comp = (rows.column(x).to_numpy() for x in ("tile", "i", "j", "side", "node", "n", "comp"))
    comp, bitmaps = comp.copy(), rows.column("bitmap")
    out: list[tuple] = []
    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
        if (comp[a:b] == comp[a]).all():
            continue
        maps = [np.frombuffer(x.as_buffer(), np.uint64) for x in bitmaps.slice(a, b - a)]
        width = min(map(len, maps))
        maps = np.stack([fold(x, width) for x in maps])
        first, at = int(tile[a]), np.arange(a, b)
        left, right = (at, at) if i[a] == j[a] else (at[side[at] == 1], at[side[at] == 2])
        out += [(first, *x) for x in _block_pairs(left, right, i[a] == j[a], node, n, comp, maps, a, num, den, forest)]
    tiles, x, y = zip(*out) if out else ((), (), ())
    return pa.RecordBatch.from_arrays([pa.array(z, pa.int64()) for z in (tiles, x, y)], ["tile", "a", "b"])


def _block_pairs(left, right, own: bool, node, n, comp, maps, zero: int, num: int, den: int, forest: bool) -> list[tuple[int, int]]:
    """Pairs of different components, one of left and one of right, that sizes and bitmaps allow.

    forest: only as many as join the components that such pairs join. own: left is right.
    """
    out = []
    for k, x in enumerate(left):
        to = right[k + 1 :] if own else right
        at = to[(comp[to] != comp[x]) & (np.minimum(n[x], n[to]) * den >= np.maximum(n[x], n[to]) * num)]
        if len(at):
            far = np.bitwise_count(maps[at - zero] ^ maps[x - zero]).sum(axis=1, dtype=np.int64)
            at = at[far <= most_apart(int(n[x]), n[at], num, den)]
        if forest and len(at):
            met, first = np.unique(comp[at], return_index=True)
            at = at[first]
            for rows in (left, right):
                comp[rows[np.isin(comp[rows], met)]] = comp[x]
        out += [(int(min(node[x], y)), int(max(node[x], y))) for y in node[at]]
    return out


@X.releases
def _linked(batches: Iterator[pa.RecordBatch], n: int, num: int, den: int) -> Iterator[pa.RecordBatch]:
    """Pairs whose whole texts' sets share enough; rows come in order of a, block and side, the common text first."""
    common, x = None, np.zeros(0, np.uint64)
    for batch in batches:
        a, side, node = (batch.column(k).to_pylist() for k in ("a", "side", "node"))
        keep = np.zeros(len(batch), bool)
        for i, y in shingle_sets(X.text_of(batch.column("text")), n):
            if not len(y) or set_id(y) != node[i]:
                continue
            if side[i] == 0:
                common, x = a[i], y
            elif common == a[i]:
                small, big = (x, y) if len(x) <= len(y) else (y, x)
                at = np.searchsorted(big, small)
                at[at == len(big)] = 0
                both = int((big[at] == small).sum())
                keep[i] = den * both >= num * (len(x) + len(y) - both)
        keep = pa.array(keep)
        yield pa.RecordBatch.from_arrays([batch.column("a").filter(keep), batch.column("node").filter(keep)], ["a", "b"])


def _small(df: DataFrame) -> DataFrame:
    """A checkpointed table of numbers, to be broadcast if it has few rows."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def _components(docs: DataFrame, n: int, num: int, den: int) -> tuple[DataFrame, DataFrame]:
    """Of docs(id, key, text), key being the row's own: sets(id, key, node, n) and nodes(node, comp, least).

    least: the smallest id of the node, null only if it has none, and the key of a row with it.
    """
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    bands = Bands(num, den)
    sets = cut(docs.mapInArrow(partial(_read_sets, n=n), "id long, key long, node long, n long, bitmap binary"))
    least = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "key")).alias("least")
    nodes = cut(sets.where("n > 0").groupBy("node").agg(least, F.max("n").alias("n"), F.first("bitmap").alias("bitmap")))
    by_band = sets.where("n > 0").groupBy(F.floor(F.log("n") / math.log(bands.ratio) + 1e-9).cast("int").alias("band")).count().collect()
    entries = sum(r["count"] * (bands.slices_of(r.band)[0] + bands.slices_of(r.band + 1)[0]) for r in by_band)
    buckets = max(parts, entries // BUCKET + 1)
    tiles = docs.select("text").mapInArrow(partial(_deal_tiles, n=n, num=num, den=den, buckets=buckets), "bucket int, keys binary, nodes binary")
    tiles = tiles.repartitionById(buckets, "bucket").mapInArrow(_find_tiles, "tile long, part int, nodes array<long>, low long, high long")
    tiles = cut(tiles.dropDuplicates(["tile", "part"]))
    hubs = tiles.select("low", "high", F.explode("nodes").alias("node")).groupBy("node").agg(F.min("low").alias("low"), F.max("high").alias("high"))
    stars = hubs.select(F.explode(F.array_distinct(F.array("low", "high"))).alias("a"), F.col("node").alias("b")).where("a <> b")
    sig = nodes.select("node", "n", "bitmap")
    stars = stars.join(sig.toDF("a", "na", "ma"), "a").join(sig.toDF("b", "nb", "mb"), "b").select("a", "b", "na", "ma", "nb", "mb")
    stars = stars.mapInArrow(partial(_bounded_pairs, num=num, den=den), "a long, b long")
    links = cut(_verify(stars, nodes, docs, n, num, den, parts))
    comp = cut(connected_components(links))
    for forest in (True, False):  # the second time what still can link, all of it
        rest = cut(_rest(tiles, nodes, comp, num, den, forest, parts))
        found = cut(_verify(rest.select("a", "b").distinct(), nodes, docs, n, num, den, parts))
        links = links.unionByName(found)
        failed = cut(rest.join(found, ["a", "b"], "left_anti").select("tile").distinct()) if forest else None
        if not found.isEmpty():
            comp = cut(connected_components(links))
        if not forest or failed.isEmpty():
            break
        tiles = tiles.join(_small(failed.toDF("low")), "low", "left_semi")
    nodes = nodes.select("node", "least").join(comp, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    return sets.drop("bitmap"), nodes


def jaccard_components(docs: DataFrame, n: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of docs: doc_id, n_shingles, component_id (smallest id linked).

    Sets link if den * intersection >= num * union.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    sets, nodes = _components(docs.select("id", F.xxhash64("id", "text").alias("key"), "text"), n, num, den)
    ids = nodes.groupBy("comp").agg(F.min("least.id").alias("component_id"))
    ids = nodes.join(ids, "comp").select("node", "component_id")
    return (
        sets.select("id", "n", "node")
        .join(ids, "node", "left")
        .select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("id")).alias("component_id"))
    )


def keep_one_of_each(docs: DataFrame, n: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Of the rows of each component the one with the smallest id, all columns as they are.

    Rows without an id come last, ties go by a hash of the whole row, so reruns agree. Rows
    without words all stay; rows that are alike in every column are one.
    """
    key = "_row_key"
    keyed = docs.withColumn(key, F.xxhash64(*docs.columns))
    sets, nodes = _components(keyed.select(F.col(id_col).cast("long").alias("id"), F.col(key).alias("key"), F.col(text_col).cast("string").alias("text")), n, num, den)
    first = nodes.groupBy("comp").agg(F.min("least").alias("least")).select(F.col("least.key").alias(key))
    kept = first.union(sets.where("n = 0").select("key"))
    return keyed.join(kept, key, "left_semi").dropDuplicates(keyed.columns).select(docs.columns)


def _verify(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, n: int, num: int, den: int, parts: int) -> DataFrame:
    """Of pairs (a, b) of nodes, those that link."""
    key = nodes.select("node", "least.key")
    pairs = pairs.join(key.toDF("a", "key_a"), "a").join(key.toDF("b", "key_b"), "b")
    pairs = cut(pairs.withColumn("block", F.pmod(F.xxhash64("b"), F.lit(PAIR_BLOCKS)).cast("int")))
    ask = pairs.select(F.col("key_a").alias("key"), "a", "block", F.lit(0).alias("side"), F.col("a").alias("node")).distinct()
    ask = cut(ask.union(pairs.select("key_b", "a", "block", F.lit(1), "b")))
    rows = docs.select("key", "text").join(_small(ask), "key").select("a", "block", "side", "node", "text")
    rows = rows.repartition(parts, "a", "block").sortWithinPartitions("a", "block", "side")
    return rows.mapInArrow(partial(_linked, n=n, num=num, den=den), "a long, b long").distinct()


def _rest(tiles: DataFrame, nodes: DataFrame, comp: DataFrame, num: int, den: int, forest: bool, parts: int) -> DataFrame:
    """Pairs (tile, a, b) of nodes of a family that are in different components and may link; none only if there are none."""
    # Near copies share most of their tiles, and by families their pairs are compared about
    # once and not once for each tile.
    known = nodes.select("node", "n").join(comp, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    each = cut(tiles.select(F.col("low").alias("tile"), F.explode("nodes").alias("node")).distinct().join(known, "node"))
    mixed = each.groupBy("tile").agg(F.min("comp").alias("x"), F.max("comp").alias("y"), F.count("*").alias("m"), F.sum("n").alias("members")).where("x <> y")
    mixed = cut(mixed.select("tile", F.ceil(F.greatest(F.col("m") / BLOCK, F.col("members") / BLOCK_MEMBERS)).cast("int").alias("blocks")))
    each = each.join(_small(mixed), "tile").join(nodes.select("node", "bitmap"), "node")
    each = each.withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    each = each.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    each = each.withColumn("i", F.least("own", "other")).withColumn("j", F.greatest("own", "other"))
    each = each.withColumn("side", F.when(F.col("own") == F.col("other"), 0).when(F.col("own") == F.col("i"), 1).otherwise(2))
    each = each.select("tile", "i", "j", "side", "node", "n", "comp", "bitmap")
    each = each.repartition(parts, "tile", "i", "j").sortWithinPartitions("tile", "i", "j", "node")
    return each.mapInArrow(partial(_compare, num=num, den=den, forest=forest), "tile long, a long, b long")
