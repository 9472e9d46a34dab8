"""SentencePiece encoding and decoding: distinct sampled segmentations of whole texts.

Segmentations are paths through the lattice of all pieces that match; a path's weight
is the product of its pieces' probabilities, which follow the vocabulary's order as a
Zipf law (the file's scores are merge ranks, not probabilities) sharpened by ``ALPHA``.
Characters without a piece take their bytes' pieces, as the library does.

k distinct segmentations are drawn without replacement by Gumbel top-k: every complete
path has a Gumbel variable at its log weight, and the k largest win.  The variables
are never all drawn.  An A* search keeps an agenda of sets of paths (a shared prefix
and what its next step may still be), each with its greatest Gumbel as exact
priority.  Popping a set reveals its best path, drawn step by step, and splits the rest
into one set per step: same prefix, another choice there, whose greatest Gumbel
is truncated at the popped one.  A step is a piece at a place of the lattice, drawn with
its probability given the place (backward sums over the lattice).  No piece crosses
a word start, so lattices are built per unit of text, for all new units of a batch at
once, and kept for a task (the first ``CACHE`` units; others for the batch).  All texts of a batch go through
the search in step, so that draws and sums are array operations.  Weights of units of
any length are summed in logarithms.

Inclusion scores follow from the (k+1)-th Gumbel kappa: log(1 - exp(-exp(log p - kappa))).
Draws are seeded by row key, never by position, so reruns and other partitionings
agree.

Edge cases: null and empty texts have one segmentation, the empty one, of probability
1; texts with fewer than k segmentations give them all, each with inclusion 1; null
keys are a key of their own; equal keys with equal texts give equal results; a literal
mark (U+2581) is read as the blank that it stands for, as by the library; extra columns
are kept, whatever their names, except those named as the new ones.
"""

from __future__ import annotations

import hashlib
import heapq
import math
from dataclasses import dataclass
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import vocab
from .common import arrow_map, fresh, keeps, table, without
from .token_count import model_path

TOP, ALPHA, SEED, CHARS, CACHE = 2, 1.0, "pieces-1", 1 << 16, 120_000


_U = np.uint64
_GOLD, _ONE = _U(0x9E3779B97F4A7C15), 2.0**-53
#: Draws compare numbers of ``BITS`` bits; log probabilities are summed as whole multiples of 2^-32, so
#: that sums are exact and do not depend on what else is in a batch.
BITS, FIXED = 30, 2.0**32


def _mix(x):
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _uniform(key: np.ndarray) -> np.ndarray:
    """Uniforms in (0, 1) from 64-bit keys: draws depend on keys alone, not on their order."""
    return ((_mix(key * _GOLD) >> _U(11)).astype(np.float64) + 0.5) * _ONE


def _spread(first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The numbers first[i] .. first[i] + n[i] - 1 of all i, one after the other."""
    stop = np.cumsum(n)
    return np.arange(stop[-1] if len(stop) else 0) + np.repeat(first - (stop - n), n)


class Pairs:
    """A hash table from non-negative 64-bit keys to numbers, probed for whole arrays."""

    def __init__(self, keys: list[int], vals: list[int]):
        self.bits = max(4, math.ceil(math.log2(max(1, len(keys)) * 4)))
        self.key, self.val = np.full(1 << self.bits, -1, np.int64), np.zeros(1 << self.bits, np.int64)
        todo_k, todo_v = np.array(keys, np.int64), np.array(vals, np.int64)
        slot = self._slot(todo_k)
        while len(todo_k):  # one of those that want a slot gets it, the rest move on
            free = self.key[slot] < 0
            _, first = np.unique(np.where(free, slot, -1 - np.arange(len(slot))), return_index=True)
            win = first[free[first]]
            self.key[slot[win]], self.val[slot[win]] = todo_k[win], todo_v[win]
            left = np.ones(len(todo_k), bool)
            left[win] = False
            todo_k, todo_v, slot = todo_k[left], todo_v[left], (slot[left] + 1) & ((1 << self.bits) - 1)

    def _slot(self, k):
        return ((k.astype(np.uint64) * _GOLD) >> _U(64 - self.bits)).astype(np.int64)

    def get(self, k: np.ndarray) -> np.ndarray:
        s = self._slot(k)
        have = self.key[s]
        out = np.where(have == k, self.val[s], -1)
        todo = np.flatnonzero((have >= 0) & (have != k))
        while todo.size:
            s[todo] = (s[todo] + 1) & ((1 << self.bits) - 1)
            have = self.key[s[todo]]
            hit = have == k[todo]
            out[todo[hit]] = self.val[s[todo[hit]]]
            todo = todo[~hit & (have >= 0)]
        return out


class Lattice:
    """The pieces as a trie, with their log weights."""

    def __init__(self, path: str, alpha: float):
        self.v = v = vocab.load(path)
        order = sorted(v.ids.values(), key=lambda i: (v.rank[i], i))
        z = math.log(sum(1 / r for r in range(1, len(order) + 2)))
        self.logp = np.zeros(v.size)
        for r, i in enumerate(order, 1):
            self.logp[i] = alpha * (-math.log(r) - z)
        self.byte_logp = alpha * (-math.log(len(order) + 1) - z)
        self.longest = max(map(len, v.ids))
        chars = sorted({c for p in v.ids for c in p})
        char = {c: i for i, c in enumerate(chars)}
        self.n = len(chars) + 1
        self.code = np.full(0x110000, self.n - 1, np.int32)
        self.code[[ord(c) for c in chars]] = np.arange(len(chars))
        self.ascii = np.array([v.byte_id.get(x, v.unk) for x in range(0x80)], np.int64)
        nodes, edges, self.piece = {"": 0}, {}, [-1]
        for p, i in v.ids.items():
            for k in range(1, len(p) + 1):
                if p[:k] not in nodes:
                    nodes[p[:k]] = len(nodes)
                    self.piece.append(-1)
                    edges[nodes[p[: k - 1]] * self.n + char[p[k - 1]]] = nodes[p[:k]]
            self.piece[nodes[p]] = i
        self.piece = np.array(self.piece)
        self.next = Pairs(list(edges), list(edges.values()))

    def arcs(self, flat: str, end: np.ndarray) -> list[tuple]:
        """By length, longest first: (length, starts, ids, log weights) of every step in ``flat``; no step leaves its unit.

        ``end``: for each place, where its unit ends.  Characters without a piece
        have the id -1 - code point, or their byte's piece where that is one byte.
        """
        point = np.frombuffer(flat.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        code = self.code[point]
        at, node, out = np.arange(len(flat)), np.zeros(len(flat), np.int64), []
        for d in range(1, self.longest + 1):
            node = self.next.get(node * self.n + code[at + (d - 1)])
            ok = node >= 0
            piece = np.where(ok, self.piece[node], -1)
            hit = np.flatnonzero(piece >= 0)
            if d == 1:
                lone = np.flatnonzero(piece < 0)
                p = point[lone]
                wide = 1 + (p > 0x7F) + (p > 0x7FF) + (p > 0xFFFF)
                out.append((1, lone, np.where(p < 0x80, self.ascii[np.minimum(p, 0x7F)], -1 - p), wide * self.byte_logp))
            out.append((d, at[hit], piece[hit], self.logp[piece[hit]]))
            go = np.flatnonzero(ok & (at + d < end[at]))
            at, node = at[go], node[go]
            if not len(at):
                break
        return out[::-1]


class Store:
    """Lattices of the units met so far, as flat arrays over places and steps.

    A place's steps lie together, the likeliest first, with cumulative probabilities, so
    a draw looks at one or two of them.
    """

    KINDS = {"next": np.int32, "id": np.int32, "place": np.int32, "cum": np.int32, "rest": np.float32, "logp": np.float64}

    def __init__(self, lat: Lattice):
        self.lat = lat
        self.n_places = self.n_steps = 0
        self.first = np.zeros(1 << 16, np.int32)  # step of a place; one more at the end
        self.steps = {k: np.zeros(1 << 18, kind) for k, kind in self.KINDS.items()}

    @staticmethod
    def _put(old: np.ndarray, at: int, new: np.ndarray) -> np.ndarray:
        """``old`` with ``new`` written at ``at``; it grows by doubling."""
        if at + len(new) > len(old):
            grown = np.zeros(max(2 * len(old), at + len(new)), old.dtype)
            grown[:at] = old[:at]
            old = grown
        old[at : at + len(new)] = new
        return old

    def add(self, units: list[str]) -> np.ndarray:
        """First places of new units, whose lattices are made as many at once as fit in ``CHARS`` characters."""
        out, part, size = np.empty(len(units), np.int64), [], 0
        for i in np.argsort([-len(u) for u in units], kind="stable").tolist():
            if part and size + len(units[i]) > CHARS:
                out[part] = self._append([units[j] for j in part])
                part, size = [], 0
            part.append(i)
            size += len(units[i])
        if part:
            out[part] = self._append([units[j] for j in part])
        return out

    def _append(self, units: list[str]) -> np.ndarray:
        """Lattices of units by falling length, so that those still open at a distance from their end come first."""
        size = np.array([len(u) for u in units])
        stop = np.cumsum(size)
        end = np.repeat(stop, size)
        arcs = self.lat.arcs("".join(units).replace(" ", vocab.MARK), end)
        total = len(end)
        n = np.zeros(total, np.int64)
        for _, start, _, _ in arcs:
            n[start] += 1  # a place has one step of a length
        first = np.cumsum(n) - n
        fill, m = first.copy(), int(n.sum())
        to, ids, logw, at = np.empty(m, np.int64), np.empty(m, np.int64), np.empty(m), np.repeat(np.arange(total), n)
        for length, start, piece, w in arcs:
            k = fill[start]
            fill[start] += 1
            to[k], ids[k], logw[k] = start + length, piece, w
        # A place at a unit's end has the sum 0; it is also the next unit's first place, so ends are told apart.
        inner = to < end[at]
        back = np.zeros(total + 1)
        small, to_ = -size, np.where(inner, to, total)  # back[total] stays 0
        for d in range(1, int(size[0]) + 1):
            place = stop[: np.searchsorted(small, -d, side="right")] - d
            k = _spread(first[place], n[place])
            val = logw[k] + back[to_[k]]
            head = np.cumsum(n[place]) - n[place]
            top = np.maximum.reduceat(val, head)
            back[place] = top + np.log(np.add.reduceat(np.exp(val - np.repeat(top, n[place])), head))
        logp = logw + back[to_] - back[at]
        cond = np.exp(logp)
        run = np.cumsum(np.rint(cond * (1 << BITS)).astype(np.int64))
        cum = run - np.repeat(np.concatenate([[0], run])[first], n)
        cum[first + n - 1] = (1 << BITS) + 1  # the last choice takes what rounding leaves
        # Log probability of any other choice at the place: for the likeliest by a sum over the others, never by 1 - p.
        best = np.flatnonzero(logp == np.repeat(np.maximum.reduceat(logp, first), n))
        best = best[np.r_[True, at[best[1:]] != at[best[:-1]]]]
        others = logp.copy()
        others[best] = -np.inf
        second = np.maximum.reduceat(others, first)
        some = second > -np.inf
        floor = np.where(some, second, 0.0)
        tail = np.add.reduceat(np.exp(others - np.repeat(floor, n)), first)
        rest = np.log1p(-np.minimum(cond, 0.75))
        rest[best] = np.where(some, floor + np.log(np.where(some, tail, 1.0)), -np.inf)
        base, old = self.n_places, self.n_steps
        new = {"rest": rest, "next": np.where(inner, to + base, -1), "id": ids, "place": at + base, "cum": cum, "logp": logp}
        self.steps = {k: self._put(a, old, new[k]) for k, a in self.steps.items()}
        self.first = self._put(self.first, base, np.append(first, m) + old)
        self.n_places, self.n_steps = base + total, old + m
        return stop - size + base

    def draw(self, place: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Steps drawn from each place to its unit's end, in order, and how many each has."""
        got, who, row, n = [], [], np.arange(len(place)), np.zeros(len(place), np.int64)
        cum, nxt, shift, t = self.steps["cum"], self.steps["next"], _U(64 - BITS), 0
        while len(row):
            step, u = self.first[place], (_mix((key + _U(t)) * _GOLD) >> shift).astype(np.int32)
            more = np.flatnonzero(u >= cum[step])
            while len(more):
                step[more] += 1
                more = more[u[more] >= cum[step[more]]]
            got.append(step)
            who.append(row)
            t += 1
            n[row] = t
            to = nxt[step]
            on = np.flatnonzero(to >= 0)
            place, key, row = to[on], key[on], row[on]
        first, out = np.cumsum(n) - n, np.empty(int(n.sum()), np.int64)
        for t, (step, row) in enumerate(zip(got, who)):
            out[first[row] + t] = step
        return out, n

    def ids(self, steps: np.ndarray) -> np.ndarray:
        """Piece ids of steps; characters without a piece become their bytes' pieces."""
        out = self.steps["id"][steps]
        if (out < 0).any():
            unk, byte = self.lat.v.unk, self.lat.v.byte_id
            out = np.concatenate([[byte.get(x, unk) for x in chr(-1 - i).encode("utf-8", "surrogatepass")] if i < 0 else [i] for i in out.tolist()])
        return out.astype(np.int32)


@dataclass
class _Set:
    """Paths with a common prefix that choose at ``spot`` none of ``taboo``; spot -1: all paths of the text."""

    gumbel: float
    found: int = -1  # the sample whose first ``cut`` steps are the prefix
    cut: int = 0
    logp: int = 0  # of the prefix, in units of 1 / FIXED
    spot: int = -1
    taboo: tuple = ()
    unit: int = 0


def _least(size: np.ndarray, first: np.ndarray, n: np.ndarray, k: int):
    """Places of the k least of each run of ``size``, round by round; infinite ones are none."""
    size = size.copy()
    some = np.flatnonzero(n > 0)
    first, n = first[some], n[some]
    for _ in range(k):
        low = np.minimum.reduceat(size, first) if len(first) else np.empty(0)
        at = np.flatnonzero(size == np.repeat(low, n))
        owner = np.searchsorted(first, at, side="right") - 1
        lead = np.r_[True, owner[1:] != owner[:-1]] if len(at) else np.empty(0, bool)
        at, owner = at[lead], owner[lead]
        fine = size[at] < np.inf
        yield from zip(some[owner[fine]].tolist(), at[fine].tolist())
        size[at] = np.inf


def sample(store: Store, texts: list[np.ndarray], seeds: np.ndarray, k: int) -> list[list[tuple]]:
    """For each text (its units' first places) up to k (steps, log p, inclusion), by falling Gumbel.

    All texts of the list go through the search in step: each round pops every text's
    best set, draws all of them together and pushes what is left of each, the k
    greatest at most (no more can be popped).
    """
    first, logp, rest, nxt, where = store.first, store.steps["logp"], store.steps["rest"], store.steps["next"], store.steps["place"]
    rows = _mix(np.asarray(seeds, np.uint64))
    found: list[list[tuple]] = [[] for _ in texts]
    agenda: list[list[tuple]] = [[] for _ in texts]
    jobs = [(i, _Set(float(g))) for i, g in enumerate(-np.log(-np.log(_uniform(rows))))]
    serial = 0
    for turn in range(k):
        if not jobs:
            break
        own = rows[[i for i, _ in jobs]]
        seed = _mix(own + _U(turn + 1))
        heads, todo, begin = [], [], []
        for (i, s), x in zip(jobs, _uniform(seed + _U(1)).tolist()):
            head, part = -1, texts[i][s.unit :]
            if s.spot >= 0:  # one choice at this place, none of those taken before
                free = [c for c in range(first[s.spot], first[s.spot + 1]) if c not in s.taboo]
                p = np.cumsum(np.exp(logp[free] - logp[free].max()))
                head = free[min(int(np.searchsorted(p / p[-1], x, side="right")), len(free) - 1)]
                part = texts[i][s.unit + 1 :]
                if nxt[head] >= 0:
                    part = np.concatenate([[nxt[head]], part])
            heads.append(head)
            todo.append(part)
            begin.append(len(texts[i]) - len(part))
        n_units = np.array([len(p) for p in todo])
        job_of = np.repeat(np.arange(len(jobs)), n_units)
        no = _spread(np.array(begin), n_units)  # number of each unit in its text
        steps, per = store.draw(np.concatenate(todo).astype(np.int64), _mix(no.astype(np.uint64) * _GOLD + seed[job_of]) + _U(2))
        of_unit = np.repeat(no, per)
        n = np.bincount(job_of, weights=per, minlength=len(jobs)).astype(np.int64)
        begin = np.cumsum(n) - n
        # Log probabilities of what precedes each step, exactly: head and prefix first.
        whole = np.rint(logp[steps] * FIXED).astype(np.int64)
        run = np.cumsum(whole) - whole
        base = np.array([s.logp + (round(float(logp[h]) * FIXED) if h >= 0 else 0) for (_, s), h in zip(jobs, heads)], np.int64)
        before = run - np.repeat(np.concatenate([run, [0]])[begin] - base, n) if len(steps) else run
        loc = before / FIXED + rest[steps]
        # G = loc - log(exp(loc - g) + E) falls as E exp(-loc) rises, so only the least of these need be worked out.
        salt = ~_mix(own + _U(turn + 1))
        place = _spread(np.ones(len(jobs), np.int64), n).astype(np.uint64)  # 0 is the head's
        e = -np.log(_uniform(_mix(place * _GOLD + np.repeat(salt, n))))
        head_e = -np.log(_uniform(_mix(salt)))
        push: list[list[_Set]] = [[] for _ in jobs]
        for j, at in _least(np.log(e) - loc, begin, n, k - turn):
            i, s = jobs[j]
            g = loc[at] - math.log(math.exp(min(loc[at] - s.gumbel, 700.0)) + e[at])
            cut = s.cut + (heads[j] >= 0) + int(at - begin[j])
            push[j].append(_Set(float(g), len(found[i]), cut, int(before[at]), int(where[steps[at]]), (int(steps[at]),), int(of_unit[at])))
        jobs_, jobs = jobs, []
        for j, (i, s) in enumerate(jobs_):
            tail = steps[begin[j] : begin[j] + n[j]]
            prefix = found[i][s.found][1][: s.cut] if s.found >= 0 else tail[:0]
            mass = int(base[j]) + int(whole[begin[j] : begin[j] + n[j]].sum())
            if heads[j] >= 0:
                tail = np.concatenate([prefix, [heads[j]], tail])
                taboo = (*s.taboo, heads[j])
                left = [c for c in range(first[s.spot], first[s.spot + 1]) if c not in taboo]
                if left:
                    top = float(logp[left].max())
                    l0 = s.logp / FIXED + top + math.log(math.fsum(np.exp(logp[left] - top)))
                    g = l0 - math.log(math.exp(min(l0 - s.gumbel, 700.0)) + head_e[j])
                    push[j].append(_Set(float(g), len(found[i]), s.cut, s.logp, s.spot, taboo, s.unit))
            found[i].append((s.gumbel, tail, mass / FIXED))
            for x in push[j]:
                serial += 1
                heapq.heappush(agenda[i], (-x.gumbel, serial, x))
            if turn + 1 < k and agenda[i]:
                jobs.append((i, heapq.heappop(agenda[i])[2]))
    out = []
    for got, left in zip(found, agenda):
        kappa = -left[0][0] if left else -math.inf
        out.append([(s, lp, 1.0 if kappa == -math.inf else -math.expm1(-math.exp(min(lp - kappa, 700.0)))) for _, s, lp in got])
    return out


@lru_cache(maxsize=2)
def lattice(path: str, alpha: float) -> Lattice:
    return Lattice(path, alpha)


def row_seed(seed: str, key) -> int:
    return int.from_bytes(hashlib.blake2b(f"{seed}:{key}".encode(), digest_size=8).digest(), "little")


class _Numbers(dict):
    """Units by number, new ones as they are asked for."""

    def __missing__(self, unit: str) -> int:
        n = self[unit] = len(self)
        return n


class Sampler:
    """Samples texts; lattices of the first ``CACHE`` units it meets are kept, others for one call."""

    def __init__(self, path: str, alpha: float, k: int):
        self.lat, self.k = lattice(path, alpha), k
        self.store, self.number, self.places = Store(self.lat), _Numbers(), np.empty(0, np.int64)

    def __call__(self, texts: list[str], seeds: list[int]) -> list[list[tuple]]:
        known, get = len(self.number), self.number.__getitem__
        each = []
        for t in texts:
            units = self.lat.v.units(t) if t else []
            each.append(np.fromiter(map(get, units), np.int64, len(units)))
        new = list(islice(reversed(self.number), len(self.number) - known))[::-1]
        room = max(0, CACHE - known)
        self.places = np.concatenate([self.places, self.store.add(new[:room])])
        mark, spare = (self.store.n_places, self.store.n_steps), new[room:]
        places = np.concatenate([self.places, self.store.add(spare)])
        out = [[(self.store.ids(s), lp, inc) for s, lp, inc in got] for got in sample(self.store, [places[u] for u in each], np.array(seeds, np.uint64), self.k)]
        self.store.n_places, self.store.n_steps = mark
        for u in spare:
            del self.number[u]
        return out


@lru_cache(maxsize=1)
def sampler(path: str, alpha: float, k: int) -> Sampler:
    """One per worker process, for a task."""
    return Sampler(path, alpha, k)


keeps(__name__, sampler.cache_clear)


_FIELDS = [("ids", T.ArrayType(T.IntegerType()), pa.list_(pa.int32())), ("log_prob", T.DoubleType(), pa.float64()), ("inclusion", T.DoubleType(), pa.float64()), ("ids_sha256", T.StringType(), pa.string())]


def encode(
    docs: DataFrame, *, id_col="doc_id", text_col="text", k: int = TOP, alpha: float = ALPHA, seed: str = SEED, path: str | None = None, verify: bool = False, fingerprint: bool = False,
    carry: list[str] | None = None,
) -> DataFrame:
    """``docs`` (its columns in ``carry``, all by default) with samples: array<struct<ids, log_prob, inclusion>>, in order of being drawn.

    ``verify`` adds decodes: whether every sample decodes to the text (a literal mark
    counts as the blank that it encodes).  ``fingerprint`` adds ids_sha256 to each
    sample: the hex digest of its ids as little-endian 32-bit numbers.
    """
    path = path or model_path()
    new = ["samples"] + ["decodes"] * verify
    keep = without(docs.columns if carry is None else carry, new)
    fields = _FIELDS if fingerprint else _FIELDS[:3]

    def run(batches):
        draw, n = sampler(path, alpha, k), len(keep)
        try:
            for batch in batches:
                for at in range(0, batch.num_rows, 512):
                    part = batch.slice(at, 512)
                    texts = [t or "" for t in part.column(n + 1).to_pylist()]
                    got = draw(texts, [row_seed(seed, x) for x in part.column(n).to_pylist()])
                    flat = [one for row in got for one in row]
                    ids = [one[0] for one in flat]
                    starts = pa.array(np.cumsum([0, *map(len, ids)]), pa.int32())
                    cols = [pa.ListArray.from_arrays(starts, pa.array(np.concatenate(ids) if ids else np.empty(0, np.int32), pa.int32())), pa.array([x[1] for x in flat], pa.float64()), pa.array([x[2] for x in flat], pa.float64())]
                    if fingerprint:
                        cols.append(pa.array([hashlib.sha256(x.astype("<i4").tobytes()).hexdigest() for x in ids], pa.string()))
                    one = pa.StructArray.from_arrays(cols, fields=[pa.field(f, a) for f, _, a in fields])
                    out = [*[part.column(i) for i in range(n)], pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, got)]), pa.int32()), one)]
                    if verify:
                        want = [t.replace(vocab.MARK, " ").encode("utf-8", "surrogatepass") for t in texts]
                        out.append(pa.array([all(decoded_bytes(path, x[0]) == w for x in row) for row, w in zip(got, want)], pa.bool_()))
                    yield pa.RecordBatch.from_arrays(out, names=[*keep, *new])
        finally:
            sampler.cache_clear()  # an idle worker must not hold lattices beside the stages that follow

    samples = T.ArrayType(T.StructType([T.StructField(f, s) for f, s, _ in fields]))
    schema = T.StructType([*[docs.schema[c] for c in keep], T.StructField("samples", samples), *([T.StructField("decodes", T.BooleanType())] if verify else [])])
    return arrow_map(docs.select(*keep, F.col(id_col).alias(fresh(keep, "key")), F.col(text_col).alias(fresh(keep, "text"))), run, schema)


@lru_cache(maxsize=2)
def _bytes_of(path: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """UTF-8 of all pieces in a row, marks as blanks; where each begins, and its length."""
    v = vocab.load(path)
    byte = {i: bytes([b]) for b, i in v.byte_id.items()}
    each = [byte[i] if i in byte else p.replace(vocab.MARK, " ").encode() for i, p in enumerate(v.pieces)]
    size = np.array([len(x) for x in each])
    return np.frombuffer(b"".join(each), np.uint8), np.cumsum(size) - size, size


def decoded_bytes(path: str, ids) -> bytes:
    """UTF-8 of the text of piece ids: byte pieces joined to characters, marks to blanks, the first dropped."""
    flat, first, size = _bytes_of(path)
    ids = np.asarray(ids, np.int64)
    return flat[_spread(first[ids], size[ids])].tobytes()[1:]


def decode_ids(path: str, ids) -> str:
    return decoded_bytes(path, ids).decode(errors="replace")


def decode(df: DataFrame, *, ids_col="ids", out_col="text", path: str | None = None) -> DataFrame:
    """``df`` with the text of a column of piece ids (null ids: null)."""
    path = path or model_path()
    keep = without(df.columns, [out_col])

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 128):
                part = batch.slice(at, 128)
                text = [None if x is None else decode_ids(path, x) for x in part.column(len(keep)).to_pylist()]
                yield pa.RecordBatch.from_arrays([*[part.column(i) for i in range(len(keep))], pa.array(text, pa.string())], names=[*keep, out_col])

    schema = T.StructType([*[df.schema[c] for c in keep], T.StructField(out_col, T.StringType())])
    return arrow_map(df.select(*keep, F.col(ids_col).alias(fresh(keep, "ids"))), run, schema)


def digest(encoded: DataFrame, id_col="doc_id") -> DataFrame:
    """One row per text: whether it decodes, and each sample's length, fingerprint of ids, log probability and inclusion."""
    return encoded.select(
        id_col, F.size("samples").alias("n_samples"), F.transform("samples", lambda s: F.size(s["ids"])).alias("n_pieces"), F.transform("samples", lambda s: s["ids_sha256"]).alias("ids_sha256"),
        F.transform("samples", lambda s: F.round(s["log_prob"], 6)).alias("log_prob"), F.transform("samples", lambda s: s["inclusion"]).alias("inclusion"), "decodes",
    )


def op3_piece_sampling(spark, sf_dir) -> DataFrame:
    return digest(encode(table(spark, sf_dir, "documents"), carry=["doc_id"], verify=True, fingerprint=True))
