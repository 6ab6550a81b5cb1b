"""SentencePiece encoding by sampling without replacement, and decoding.

A text's lattice has a node between any two characters and an arc for every piece that fits;
characters without a piece get an arc of byte pieces. Forward sums give each arc its
probability given its end node, so a segmentation is a row of decisions, taken from the end
of each unit (blanks and the word after them; no piece crosses units) to its beginning.

Distinct segmentations come by perturbed A-star search (Gumbel top-k): a subtree of
decisions has the log mass of its prefix and a Gumbel-perturbed maximum below its parent's.
The best subtree is opened by drawing one leaf from it; every decision of that leaf leaves a
sibling subtree, whose perturbed maximum is drawn truncated at the leaf's value. Leaves thus
come in order of perturbed value, each segmentation at most once. The best value left in the
queue gives each sample's inclusion probability, 1 - exp(-exp(log_prob - left)), kept as a
logarithm. All draws are a hash of the row's key and a counter, so reruns agree.

A BPE vocabulary has merge ranks for scores; the log probability of a piece is then taken
from its rank by Zipf's law. Lattices are built for distinct units, kept from one slice of
texts to the next, and all units of a slice are drawn at once, in array steps. Probabilities
and draws are in double precision, the mass of siblings is summed without cancellation: a
segmentation is out of reach only if its probability can't be told from 0 in a double. Decoding puts the pieces' bytes one after
another and gives back every text exactly.

Defined cases: null and empty texts have one sample without pieces, log_prob 0 and
inclusion 1; texts with fewer than k segmentations have all of them; rows that repeat a key
and text get equal samples; very long texts count whole (a slice has at least one text).
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tremolo.llm import _text as X

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SLICE_BYTES = 1 << 19
#: Nodes of lattices that a task keeps, or those of one slice if it has more.
KEPT_NODES = 1_000_000
U64 = np.uint64
_MARK, _LITERAL = 0x2581, 0x110001


class Vocabulary:
    """Pieces of a SentencePiece model as tables: hashes of their prefixes, ids, log probabilities, bytes."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        sp = SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        self.unknown = sp.unk_id()
        raw: list[bytes] = []
        self.byte_ids = np.full(256, self.unknown, np.int32)
        codes: list[np.ndarray] = []
        ids: list[int] = []
        for i in range(n):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.byte_ids[int(piece[3:-1], 16)] = i
                raw.append(bytes([int(piece[3:-1], 16)]))
            elif sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i):
                raw.append(b"")
            else:
                raw.append(piece.replace("▁", " ").encode())
                if "▁" in piece.lstrip("▁"):
                    raise ValueError(f"piece {i} crosses a blank")
                codes.append(np.frombuffer(piece.encode("utf-32-le"), np.uint32))
                ids.append(i)
        scores = np.array([sp.get_score(i) for i in ids])
        if (scores == np.round(scores)).all():  # merge ranks
            rank = np.empty(len(ids))
            rank[np.lexsort((ids, -scores))] = np.arange(len(ids))
            scores = -np.log(rank + 2)
        self.log_prob = scores - np.log(np.exp(scores).sum())
        self.byte_log_prob = float(self.log_prob.min()) - 1
        self.ids = np.array(ids, np.int32)
        self.start = np.concatenate([[0], np.cumsum([len(b) for b in raw])])
        self.bytes = np.frombuffer(b"".join(raw), np.uint8)
        # every prefix of a piece, by hash; the number of its piece or -1
        known: dict[int, int] = {}
        for k, c in enumerate(codes):
            total = code_sums(c)
            for h in X.hash_spans(total, np.zeros(len(c), np.int64), np.arange(1, len(c) + 1)).tolist():
                known.setdefault(h, -1)
                last = h
            known[last] = k
        self.hashes = np.array(sorted(known), U64)
        self.piece = np.array([known[h] for h in self.hashes.tolist()], np.int32)
        bucket = (self.hashes >> U64(44)).astype(np.int64)
        self.bucket = np.searchsorted(bucket, np.arange((1 << 20) + 1)).astype(np.int32)
        self.fullest = int(np.diff(self.bucket).max())
        self.hashes = np.append(self.hashes, np.zeros(self.fullest, U64))
        self.longest = max(map(len, codes))

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which hashes are prefixes of pieces, and of those the piece's number or -1."""
        at = (h >> U64(44)).astype(np.int32)
        first, last = self.bucket[at], self.bucket[at + 1]
        near = np.flatnonzero(last > first)
        h, first, last = h[near], first[near], last[near]
        to = np.full(len(h), -1, np.int32)
        for k in range(self.fullest):
            hit = (self.hashes[first + k] == h) & (first + k < last)
            to[hit] = first[hit] + k
        real = to >= 0
        return near[real], self.piece[to[real]]


@lru_cache(2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def code_sums(codes: np.ndarray) -> np.ndarray:
    """Running sums for hash_spans over code points."""
    out = np.zeros(len(codes) + 1, U64)
    x = X.mix(codes.astype(U64))
    x *= X.powers(len(codes) + 1)[0][: len(codes)]
    np.cumsum(x, out=out[1:])
    return out


def uniforms(key: np.ndarray, counter: np.ndarray) -> np.ndarray:
    """Numbers in (0, 1) that depend on key and counter alone."""
    h = X.mix(key + counter.astype(U64) * U64(0xA0761D6478BD642F))
    return ((h >> U64(11)).astype(np.float64) + 0.5) * 2.0**-53


class Lattices:
    """Lattices of units, kept from slice to slice, as words recur.

    Node x has count[x] arcs from base[x] on, by length; roots have none. Of an arc: its
    probability given its end node summed up to this arc (infinite for the last, so that no
    draw goes beyond it), log_p, log_rest (of the node's other arcs), length in characters, and
    its piece's number, or -1 - code for bytes. leaf maps a unit's hash to its last node. Columns
    have room beyond the nodes and arcs in use, so that new units are added in place. Over
    KEPT_NODES the store begins again with the units of the slice at hand.
    """

    def __init__(self, v: Vocabulary, theta: float):
        self.v, self.theta, self.nodes, self.arcs = v, theta, 0, 0
        self.hashes, self.leaf = np.zeros(0, U64), np.zeros(0, np.int64)
        self.base, self.count = np.zeros(0, np.int64), np.zeros(0, np.int8)
        self.upto, self.log_p, self.log_rest = np.zeros(0), np.zeros(0), np.zeros(0)
        self.length, self.piece = np.zeros(0, np.int8), np.zeros(0, np.int32)

    def leaves(self, hashes: np.ndarray, codes: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Last node of each unit codes[begins:ends]; hashes are sorted and distinct."""
        at = np.searchsorted(self.hashes, hashes)
        at[at == len(self.hashes)] = 0
        new = np.flatnonzero(self.hashes[at] != hashes) if len(self.hashes) else np.arange(len(hashes))
        if not len(new):
            return self.leaf[at]
        if len(self.hashes) and self.nodes + int((ends - begins)[new].sum()) + len(new) > KEPT_NODES:
            self.__init__(self.v, self.theta)
            new = np.arange(len(hashes))
        sizes = (ends - begins)[new]
        offsets = np.concatenate([[0], np.cumsum(sizes)])
        take = np.repeat(begins[new] - offsets[:-1], sizes) + np.arange(offsets[-1])
        made = _built(self.v, codes[take], offsets, self.theta)
        leaf = np.concatenate([self.leaf, self.nodes + offsets[1:] + np.arange(len(new))])
        made["base"] += self.arcs
        nodes, arcs = len(made["base"]), len(made["piece"])
        for name in list(made):
            self._add(name, made.pop(name), self.nodes if name in ("base", "count") else self.arcs)
        self.nodes, self.arcs = self.nodes + nodes, self.arcs + arcs
        known = np.concatenate([self.hashes, hashes[new]])
        order = np.argsort(known, kind="stable")
        self.hashes, self.leaf = known[order], leaf[order]
        return self.leaf[np.searchsorted(self.hashes, hashes)]

    def _add(self, name: str, x: np.ndarray, at: int) -> None:
        """x from place at on in a column, which grows by a quarter at least where it has no room."""
        column = getattr(self, name)
        if at + len(x) > len(column):
            grown = np.empty(max(at + len(x), at + at // 4), column.dtype)
            grown[:at] = column[:at]
            setattr(self, name, grown)
            column = grown
        column[at : at + len(x)] = x

    def draw(self, nodes: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Decisions from each node to its unit's root, start by start: (index of the start, node, arc)."""
        who, node, out, count = np.arange(len(nodes)), nodes, [], np.zeros(len(nodes), np.int64)
        while True:
            on = self.count[node] > 0
            if not on.all():
                who, node = who[on], node[on]
            if not len(who):
                break
            arc = self.base[node]
            u = uniforms(key[who], np.array([len(out)]))
            more = np.flatnonzero(u >= self.upto[arc])
            while len(more):
                arc[more] += 1
                more = more[u[more] >= self.upto[arc[more]]]
            out.append((who, node, arc))
            count[who] += 1
            node = node - self.length[arc]
        start = np.cumsum(count) - count
        nodes, arcs = np.empty((2, int(count.sum())), np.int64)
        for step, (who, node, arc) in enumerate(out):
            at = start[who]
            at += step
            nodes[at], arcs[at] = node, arc
        return np.repeat(np.arange(len(count)), count), nodes, arcs


def _built(v: Vocabulary, codes: np.ndarray, offsets: np.ndarray, theta: float) -> dict[str, np.ndarray]:
    """Columns of Lattices for units codes[offsets[i]:offsets[i + 1]]; node of unit i at place p: offsets[i] + i + p."""
    n, m = len(codes), len(offsets) - 1
    sums = code_sums(codes)
    unit = np.repeat(np.arange(m), np.diff(offsets))
    room = offsets[1:][unit] - np.arange(n)
    at, node_of = np.arange(n), np.arange(n) + unit
    count = np.zeros(n + m, np.int8)
    ends, slots, pieces, lengths = [], [], [], []
    for length in range(1, v.longest + 1):
        at = at[room[at] >= length]
        if not len(at):
            break
        near, piece = v.find(X.hash_spans(sums, at, at + length))
        at = at[near]
        start, piece = at[piece >= 0], piece[piece >= 0]
        if length == 1:  # what isn't a piece becomes bytes
            every = -1 - codes.astype(np.int64)
            every[start] = piece
            start, piece = np.arange(n), every.astype(np.int32)
        end = node_of[start] + length
        ends.append(end)
        slots.append(count[end])
        pieces.append(piece)
        lengths.append(np.full(len(end), length, np.int8))
        count[end] += 1
    # nodes by their place in the unit, so that each place is one array step; their arcs lie in this order
    roots = offsets[:-1] + np.arange(m)
    place = np.arange(n + m) - np.repeat(roots, np.diff(offsets) + 1)
    by_place = np.argsort(place.astype(np.uint16) if place.max(initial=0) < 65536 else place, kind="stable")
    base = np.empty(n + m, np.int64)
    base[by_place] = np.cumsum(count[by_place], dtype=np.int64) - count[by_place]
    end = np.concatenate(ends)
    at = base[end] + np.concatenate(slots)
    total = len(at)
    start, length, piece = np.empty(total, np.int64), np.empty(total, np.int8), np.empty(total, np.int32)
    length[at], piece[at] = np.concatenate(lengths), np.concatenate(pieces)
    start[at] = end - np.concatenate(lengths)
    lone = np.flatnonzero(piece < 0)
    p = v.log_prob[np.maximum(piece, 0)]
    p[lone] = utf8_length((-1 - piece[lone]).astype(np.uint32)) * v.byte_log_prob
    p *= theta
    alpha = np.zeros(n + m)
    cuts = np.searchsorted(place[by_place], np.arange(1, place.max(initial=0) + 2))
    for i, j in zip(cuts[:-1], cuts[1:]):
        e = by_place[i:j]
        a, b = base[e[0]], base[e[-1]] + count[e[-1]]
        w = p[a:b]
        w += alpha[start[a:b]]
        first = base[e] - a
        top = np.maximum.reduceat(w, first)
        w -= np.repeat(top, count[e])
        np.exp(w, out=w)
        mass = np.add.reduceat(w, first)
        w /= np.repeat(mass, count[e])
        alpha[e] = top + np.log(mass)
    # sums up to an arc, and over the arcs after it, slot by slot
    upto, after = p.copy(), np.zeros(total)
    rows = [np.flatnonzero(count > k) for k in range(int(count.max(initial=0)))]
    for k, r in enumerate(rows[1:], 1):
        upto[base[r] + k] += upto[base[r] + k - 1]
    for k, r in reversed(list(enumerate(rows[1:], 1))):
        after[base[r] + k - 1] = after[base[r] + k] + p[base[r] + k]
    rest = after
    for k, r in enumerate(rows[1:], 1):
        rest[base[r] + k] += upto[base[r] + k - 1]
    last = np.flatnonzero(count)
    upto[base[last] + count[last] - 1] = np.inf
    with np.errstate(divide="ignore"):
        return {"base": base, "count": count, "upto": upto, "log_p": np.log(p), "log_rest": np.log(rest), "length": length, "piece": piece}


def utf8_length(codes: np.ndarray) -> np.ndarray:
    c = np.where(codes == _LITERAL, _MARK, codes)
    return 1 + (c > 0x7F) + (c > 0x7FF) + (c > 0xFFFF)


#: No draw of gumbel() is larger.
_MOST = 38.0


class _Sample:
    """One text's queue of subtrees. A leaf is its decisions from the text's end on: nodes, arcs, units."""

    def __init__(self, key: int):
        self.key, self.count = U64(key), 0
        self.gumbel_key = X.mix(np.array([self.key ^ U64(0x5DEECE66D)]))[0]
        self.leaves: list[tuple] = []
        self.queue: list[list] = []

    def add(self, lattices: Lattices, leaf: tuple, value: float, since: int, used: set[int]) -> None:
        """A leaf whose decisions from `since` on leave siblings; at `since` the arcs `used` are taken too.

        Decisions are opened later, in growing stretches; see _open_for_best.
        """
        arcs = leaf[1]
        before = np.zeros(len(arcs) + 1)
        np.cumsum(lattices.log_p[arcs], out=before[1:])
        self.leaves.append((*leaf, float(before[-1]), value, before))
        own = used | {int(arcs[since])} if since < len(arcs) else used
        self.queue.append([np.zeros(0), since, len(self.leaves) - 1, own])

    def best(self) -> tuple[float, int, int]:
        """Value of the best subtree that is open, its queue entry and decision."""
        out = (-np.inf, -1, -1)
        for k, (values, since, _, _) in enumerate(self.queue):
            if len(values):
                i = int(values.argmax())
                if values[i] > out[0]:
                    out = (float(values[i]), k, since + i)
        return out

    def unopened(self, best: float) -> int:
        """An entry with a stretch that isn't open and could hold more than that, or -1."""
        out = -1
        for k, (values, since, leaf, _) in enumerate(self.queue):
            at, before = since + len(values), self.leaves[leaf][5]
            if at < len(before) - 1 and before[at] + _MOST >= best:
                out = k
        return out

    def anew(self, lattices: Lattices, turn: int) -> tuple | None:
        """Takes the best subtree: node below its first decision, that decision's arc, value, place, arcs used there, leaf."""
        value, entry, decision = self.best()
        if entry < 0:
            return None
        values, since, parent, own = self.queue[entry]
        values[decision - since] = -np.inf
        nodes, arcs = self.leaves[parent][:2]
        at, taken = int(nodes[decision]), own if decision == since else {int(arcs[decision])}
        free = _others(lattices, at, taken)
        weights = np.cumsum(np.exp(lattices.log_p[free]))
        u = uniforms(self.key + U64(77 + turn), np.array([decision]))[0] * weights[-1]
        chosen = free[min(int(np.searchsorted(weights, u, "right")), len(free) - 1)]
        return at - int(lattices.length[chosen]), chosen, value, decision, taken, parent


def _gumbel(u: np.ndarray) -> np.ndarray:
    return -np.log(-np.log(u))


def _open(lattices: Lattices, wanted: list[tuple[_Sample, int]]) -> None:
    """Opens the next stretch of each queue entry's decisions, all in the same array steps; a search comes once at most."""
    own = []
    for search, k in wanted:
        values, since, leaf, _ = search.queue[k]
        a = since + len(values)
        own.append((a, min(len(search.leaves[leaf][1]), a + max(256, len(values))), search.leaves[leaf]))
    size = np.array([b - a for a, b, _ in own])
    first = np.concatenate([[0], np.cumsum(size)])
    mass = lattices.log_rest[np.concatenate([leaf[1][a:b] for a, b, leaf in own])]
    mass += np.concatenate([leaf[5][a:b] for a, b, leaf in own])
    for (search, k), (a, b, leaf), i in zip(wanted, own, first.tolist()):
        values, since, _, used = search.queue[k]
        if a == since and b > a and len(used) > 1:
            rest = np.exp(lattices.log_p[_others(lattices, leaf[0][since], used)]).sum()
            mass[i] = leaf[5][since] + np.log(rest) if rest > 0 else -np.inf
    ok = np.isfinite(mass)
    some = X.counts_between(ok, first)
    drawn = np.array([search.count for search, _ in wanted])
    counter = np.arange(int(some.sum())) + np.repeat(drawn - np.cumsum(some) + some, some)
    high = mass[ok] + _gumbel(uniforms(np.repeat(np.array([search.gumbel_key for search, _ in wanted], U64), some), counter))
    # -logaddexp(-value, -high)
    value = np.repeat(np.array([leaf[4] for _, _, leaf in own]), some)
    high -= value
    new = np.full(len(mass), -np.inf)
    new[ok] = np.minimum(high, 0) - np.log1p(np.exp(-np.abs(high))) + value
    for (search, k), n, i, j in zip(wanted, some.tolist(), first[:-1].tolist(), first[1:].tolist()):
        search.count += n
        search.queue[k][0] = np.concatenate([search.queue[k][0], new[i:j]])


#: Searches whose stretches are opened at once.
_TOGETHER = 64


def _open_newest(lattices: Lattices, searches: list[_Sample]) -> None:
    for i in range(0, len(searches), _TOGETHER):
        _open(lattices, [(x, len(x.queue) - 1) for x in searches[i : i + _TOGETHER]])


def _open_for_best(lattices: Lattices, searches: list[_Sample]) -> None:
    """Opens stretches until what is left of the mass can't reach any search's best, even with the largest draw."""
    while searches:
        wanted = [(x, k) for x in searches if (k := x.unopened(x.best()[0])) >= 0]
        for i in range(0, len(wanted), _TOGETHER):
            _open(lattices, wanted[i : i + _TOGETHER])
        searches = [x for x, _ in wanted]


def _others(lattices: Lattices, node: int, used: set[int]) -> list[int]:
    """A node's arcs but for those used."""
    first = int(lattices.base[node])
    return [x for x in range(first, first + int(lattices.count[node])) if x not in used]


def sample_slice(v: Vocabulary, lattices: Lattices, s: X.Text, keys: np.ndarray, k: int) -> list[list[tuple[np.ndarray, float, float]]]:
    """For each text its samples: (piece ids, log probability, log inclusion)."""
    out: list[list] = [[] for _ in range(len(s))]
    text = s.data.tobytes().decode("utf-8", "replace")
    codes = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    n_codes = X.counts_between((s.data & 0xC0) != 0x80, s.offsets)
    full = np.flatnonzero(n_codes > 0)
    for i in np.flatnonzero(n_codes == 0):
        out[i] = [(np.zeros(0, np.int32), 0.0, 0.0)]
    if not len(full):
        return out
    codes = np.where(codes == _MARK, _LITERAL, np.where(codes == 32, _MARK, codes)).astype(np.uint32)
    at = np.concatenate([[0], np.cumsum(n_codes[full])])
    codes = np.insert(codes, at[:-1], _MARK)
    begins = at[:-1] + np.arange(len(full))
    mark = codes == _MARK
    head = mark.copy()
    head[1:] &= ~mark[:-1]
    head[begins] = True
    unit_at = np.append(np.flatnonzero(head), len(codes))
    per_text = np.searchsorted(unit_at, np.append(begins, len(codes)))
    h = X.hash_spans(code_sums(codes), unit_at[:-1], unit_at[1:])
    known, once, kind = np.unique(h, return_index=True, return_inverse=True)
    ends = lattices.leaves(known, codes, unit_at[once], unit_at[once + 1])
    # units of a text from its last to its first
    text_of = np.repeat(np.arange(len(full)), np.diff(per_text))
    place = np.arange(len(kind)) - per_text[text_of]
    leaf = ends[kind[(per_text[1:] - 1)[text_of] - place]]
    text_key = X.mix(keys[full])
    searches = [_Sample(int(x)) for x in text_key]
    for turn in range(k):
        unit_key = X.mix(text_key[text_of] + (place * k + turn).astype(U64) * U64(0xE7037ED1A0B428DB))
        who, node, arc = lattices.draw(leaf, unit_key)
        cut = np.searchsorted(who, per_text).tolist()
        who -= per_text[text_of[who]]
        if turn == 0:
            values = _gumbel(uniforms(np.array([x.gumbel_key for x in searches], U64), np.zeros(len(searches), np.int64))).tolist()
            for t, search in enumerate(searches):
                a, b = cut[t], cut[t + 1]
                search.count = 1
                search.add(lattices, (node[a:b], arc[a:b], who[a:b]), values[t], 0, set())
            _open_newest(lattices, searches)
            continue
        # one decision anew, then the rest of its unit (drawn for all texts at once), then the units after it
        _open_for_best(lattices, searches)
        anew = [(t, *found) for t, search in enumerate(searches) if (found := search.anew(lattices, turn))]
        if not anew:
            break
        starts, draw_keys = np.array([x[1] for x in anew]), X.mix(np.array([searches[x[0]].key + U64(991 + turn) for x in anew], U64))
        rest_of, more_nodes, more_arcs = lattices.draw(starts, draw_keys)
        rest = np.searchsorted(rest_of, np.arange(len(anew) + 1)).tolist()
        for j, (t, _, chosen, value, decision, taken, parent) in enumerate(anew):
            search, a, b = searches[t], cut[t], cut[t + 1]
            nodes, arcs, units = search.leaves[parent][:3]
            more, unit = slice(rest[j], rest[j + 1]), int(units[decision])
            later = a + int(np.searchsorted(who[a:b], unit, "right"))
            new = (
                np.concatenate([nodes[: decision + 1], more_nodes[more], node[later:b]]),
                np.concatenate([arcs[:decision], [chosen], more_arcs[more], arc[later:b]]),
                np.concatenate([units[: decision + 1], np.full(rest[j + 1] - rest[j], unit), who[later:b]]),
            )
            search.add(lattices, new, value, decision, taken)
        _open_newest(lattices, [searches[x[0]] for x in anew])
    ids = _ids_of(v, lattices, [leaf[1] for search in searches for leaf in search.leaves])
    _open_for_best(lattices, searches)
    for t, search in enumerate(searches):
        left = search.best()[0]
        out[full[t]] += [(next(ids), log_prob, log_inclusion(log_prob, left)) for *_, log_prob, _, _ in search.leaves]
    return out


def log_inclusion(log_prob: float, left: float) -> float:
    """log(1 - exp(-exp(log_prob - left)))."""
    if left == -np.inf:
        return 0.0
    x = log_prob - left
    return x if x < -30 else float(np.log(-np.expm1(-np.exp(min(x, 700.0)))))


def _ids_of(v: Vocabulary, lattices: Lattices, leaves: list[np.ndarray]) -> Iterator[np.ndarray]:
    """Ids of each leaf's pieces from the text's beginning on; characters without a piece become the ids of their bytes."""
    for part in range(0, len(leaves), _TOGETHER):
        own = leaves[part : part + _TOGETHER]
        piece = lattices.piece[np.concatenate(own)[::-1]]
        ids, ends = v.ids[np.maximum(piece, 0)], np.cumsum([len(x) for x in own[::-1]])
        lone = np.flatnonzero(piece < 0)
        if len(lone):
            codes = -1 - piece[lone]
            raw = [chr(_MARK if c == _LITERAL else c).encode("utf-8", "replace") for c in codes.tolist()]
            size = np.ones(len(piece), np.int64)
            size[lone] = [len(x) for x in raw]
            before = np.cumsum(size)
            ids = np.repeat(ids, size)
            at = np.repeat(before[lone] - size[lone], size[lone])
            at += np.arange(len(at)) - np.repeat(np.cumsum(size[lone]) - size[lone], size[lone])
            ids[at] = v.byte_ids[np.frombuffer(b"".join(raw), np.uint8)]
            ends = before[ends - 1]
        yield from np.split(ids, ends[:-1])[::-1]


def decode(ids: np.ndarray, path: str = MODEL) -> bytes:
    """The text's bytes, without the blank that encoding puts before it."""
    return next(_decoded(vocabulary(path), [ids])).tobytes()


def _decoded(v: Vocabulary, samples: list[np.ndarray]) -> Iterator[np.ndarray]:
    """The bytes of each sample, without the blank before it; some are put together at once."""
    for part in range(0, len(samples), _TOGETHER):
        own = samples[part : part + _TOGETHER]
        ids = np.concatenate(own).astype(np.int64)
        start = v.start[ids]
        size = v.start[ids + 1] - start
        ends = np.concatenate([[0], np.cumsum(size)])
        data = v.bytes[np.repeat(start - ends[:-1], size) + np.arange(ends[-1])]
        cuts = ends[np.concatenate([[0], np.cumsum([len(x) for x in own])])].tolist()
        for a, b in zip(cuts[:-1], cuts[1:]):
            yield data[a + 1 : b]


@X.releases
def _encode(batches: Iterator[pa.RecordBatch], path: str, k: int, theta: float) -> Iterator[pa.RecordBatch]:
    v = vocabulary(path)
    lattices = Lattices(v, theta)
    names = ["doc_id", "sample", "ids", "log_prob", "log_inclusion", "round_trip"]
    for batch in batches:
        t, keys = X.text_of(batch.column(2)), np.asarray(batch.column(1)).view(U64)
        for first, last, s in X.slices(t, SLICE_BYTES):
            rows = [(first + i, n, *x) for i, samples in enumerate(sample_slice(v, lattices, s, keys[first:last], k)) for n, x in enumerate(samples)]
            ids = [r[2] for r in rows]
            sizes = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
            trip = [np.array_equal(x, t.data[t.offsets[r[0]] : t.offsets[r[0] + 1]]) for r, x in zip(rows, _decoded(v, ids))]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array([r[0] for r in rows])), pa.array([r[1] for r in rows], pa.int32()), pa.ListArray.from_arrays(pa.array(sizes), pa.array(np.concatenate(ids).astype(np.int32) if ids else np.zeros(0, np.int32))), pa.array([r[3] for r in rows], pa.float64()), pa.array([r[4] for r in rows], pa.float64()), pa.array(trip, pa.bool_())], names)


def sample_encodings(docs: DataFrame, k: int = 2, theta: float = 1.0, model: str = MODEL, seed: int = 17, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, sample (from 0), ids, log_prob, log_inclusion, round_trip: up to k rows for each row of docs."""
    docs = docs.select(F.col(id_col), F.xxhash64(F.lit(seed), F.col(id_col)).alias("key"), F.col(text_col).cast("string").alias("text"))
    kind = docs.schema[id_col].dataType.simpleString()
    return docs.mapInArrow(partial(_encode, path=model, k=k, theta=theta), f"doc_id {kind}, sample int, ids array<int>, log_prob double, log_inclusion double, round_trip boolean")
