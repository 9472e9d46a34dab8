"""A subword vocabulary as arrays: pieces, merge pairs and their ranks.

Everything is read through the tokenizer library's own accessors; the file's path is a
parameter and nothing of it is copied.  Merging follows the published rule of
BPE with scores: of all neighbouring pairs whose joined string is a piece, the one
with the best score goes first, the leftmost among equals.
"""

from __future__ import annotations

import heapq
import re
from functools import lru_cache

import numpy as np

MARK = "▁"  # stands for a blank in pieces
DEAD = np.int64(1) << 40


class Vocab:
    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.ids: dict[str, int] = {}
        score: list[float] = []
        self.byte_id = {}
        for i in range(sp.get_piece_size()):
            p = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.byte_id[int(p[1:-1], 16)] = i
            elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
                self.ids[p] = i
            score.append(sp.get_score(i))
        self.unk = sp.unk_id()
        self.size = len(score)
        self.pieces = [sp.id_to_piece(i) for i in range(self.size)]
        # Symbols: pieces by id, then characters that occur in pieces without being one.
        chars = sorted({c for p in self.ids for c in p} - self.ids.keys())
        self.sym = dict(self.ids) | {c: self.size + k for k, c in enumerate(chars)}
        self.other = self.size + len(chars)  # any other character; it never merges
        self.n_sym = self.other + 1
        order = sorted({score[i] for i in self.ids.values()}, reverse=True)
        dense = {s: r for r, s in enumerate(order)}
        self.rank = np.zeros(self.n_sym, np.int64)
        keys, made = [], []
        for p, i in self.ids.items():
            self.rank[i] = dense[score[i]]
            for k in range(1, len(p)):
                a, b = self.sym.get(p[:k]), self.sym.get(p[k:])
                if a is not None and b is not None:
                    keys.append(a * self.n_sym + b)
                    made.append(i)
        at = np.argsort(np.array(keys, np.int64), kind="stable")
        self.keys, self.made = np.array(keys, np.int64)[at], np.array(made, np.int64)[at]
        # A hash table with linear probing, for whole arrays of pairs at once.
        self.bits = max(4, int(np.ceil(np.log2(len(keys) * 6))))
        self.slot_key = np.full(1 << self.bits, -1, np.int64)
        self.slot_val = np.zeros(1 << self.bits, np.int64)
        for k, v in zip(self.keys.tolist(), self.made.tolist()):
            s = self._hash(k)
            while self.slot_key[s] >= 0:
                s = (s + 1) & ((1 << self.bits) - 1)
            self.slot_key[s], self.slot_val[s] = k, v
        # Characters of no longer piece are units of their own: texts may be cut at them.
        glued = {c for p in self.ids if len(p) > 1 for c in p}
        cut = "\n" if "\n" not in glued else ""
        self.unit = re.compile(f"[ {MARK}]+[^ {MARK}{cut}]*|[^ {MARK}{cut}]+" + ("|\n" if cut else ""))
        if any(MARK in p[1:] and set(p) != {MARK} for p in self.ids):
            raise ValueError("pieces that reach over word starts are not supported")

    def _hash(self, k):
        return ((k * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF) >> (64 - self.bits)

    def joined(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The piece that each pair makes, or -1."""
        k = left * self.n_sym + right
        s = ((k.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)
        have = self.slot_key[s]
        out = np.where(have == k, self.slot_val[s], -1)
        todo = np.flatnonzero((have >= 0) & (have != k))
        while todo.size:
            s[todo] = (s[todo] + 1) & ((1 << self.bits) - 1)
            have = self.slot_key[s[todo]]
            hit = have == k[todo]
            out[todo[hit]] = self.slot_val[s[todo[hit]]]
            todo = todo[~hit & (have >= 0)]
        return out

    def units(self, text: str) -> list[str]:
        """A text's units, the blank before its first word included; joined they are the text."""
        return self.unit.findall(" " + text) if text else []

    def symbols(self, unit: str) -> list[int]:
        get, other = self.sym.get, self.other
        return [get(c, other) for c in unit.replace(" ", MARK)]

    def counts(self, units: list[str], long_unit: int = 64) -> list[int]:
        """Tokens of each unit, by rank-synchronous merging of ragged arrays.

        Units are held as one flat symbol array, cut by length; in each round every
        unit that still has a mergeable pair merges its best one, all at the same
        time.  Units longer than ``long_unit`` go through a heap instead, whose
        cost does not grow with the square of the length.
        """
        out = np.zeros(len(units), np.int64)
        by_len: dict[int, list[int]] = {}
        for i, u in enumerate(units):
            if len(u) > long_unit:
                out[i] = self._long(u)
            else:
                by_len.setdefault(len(u), []).append(i)
        for n, which in by_len.items():
            for k in range(0, len(which), 4096):
                part = which[k : k + 4096]
                out[part] = self._merged(n, [units[i] for i in part])
        return out.tolist()

    def _merged(self, n: int, units: list[str]) -> np.ndarray:
        flat = "".join(units).replace(" ", MARK)
        get, other = self.sym.get, self.other
        sym = np.array([get(c, other) for c in flat], np.int64).reshape(len(units), n)
        # What a surviving character costs: 1 as a piece, else its bytes.
        cost = np.ones(sym.shape, np.int64)
        odd = np.flatnonzero(sym.ravel() >= self.size)
        if odd.size:
            cost.ravel()[odd] = [len(flat[i].encode()) for i in odd]
        if n == 1:
            return cost.sum(1)
        nxt = np.tile(np.arange(1, n + 1), (len(units), 1))
        prv = np.tile(np.arange(-1, n - 1), (len(units), 1))
        made = np.full((len(units), n), -1, np.int64)
        made[:, :-1] = self.joined(sym[:, :-1].ravel(), sym[:, 1:].ravel()).reshape(len(units), n - 1)
        rank = np.where(made >= 0, self.rank[made], DEAD)
        total = cost.sum(1)
        live = np.arange(len(units))
        while True:
            p = rank[live].argmin(1)  # the leftmost of the best
            ok = rank[live, p] < DEAD
            live, p = live[ok], p[ok]
            if not live.size:
                return total
            q = nxt[live, p]
            total[live] += 1 - cost[live, p] - cost[live, q]
            cost[live, p] = 1
            sym[live, p] = made[live, p]
            rank[live, q] = DEAD
            r = nxt[live, q]
            nxt[live, p] = r
            has = r < n
            prv[live[has], r[has]] = p[has]
            for at, to, on in ((p, r, has), (prv[live, p], p, prv[live, p] >= 0)):
                rows, a, b = live[on], at[on], to[on]
                m = self.joined(sym[rows, a], sym[rows, b])
                made[rows, a], rank[rows, a] = m, np.where(m >= 0, self.rank[m], DEAD)
            rows, a = live[~has], p[~has]
            rank[rows, a] = DEAD

    def merge_long(self, unit: str) -> list[tuple[int, int]]:
        """(symbol, first position) of what is left of one unit, by a heap of pairs."""
        sym = self.symbols(unit)
        n = len(sym)
        nxt, prv = list(range(1, n + 1)), list(range(-1, n - 1))
        pair = dict(zip(self.keys.tolist(), self.made.tolist())) if not hasattr(self, "_pair") else self._pair
        self._pair = pair
        heap = []

        def push(a, b):
            m = pair.get(sym[a] * self.n_sym + sym[b])
            if m is not None:
                heapq.heappush(heap, (int(self.rank[m]), a, b, m, sym[a], sym[b]))

        for i in range(n - 1):
            push(i, i + 1)
        while heap:
            _, a, b, m, x, y = heapq.heappop(heap)
            if sym[a] != x or b >= n or sym[b] != y or nxt[a] != b:
                continue
            sym[a], sym[b] = m, -1
            nxt[a] = nxt[b]
            if nxt[a] < n:
                prv[nxt[a]] = a
                push(a, nxt[a])
            if prv[a] >= 0:
                push(prv[a], a)
        out, i = [], 0
        while i < n:
            out.append((sym[i], i))
            i = nxt[i]
        return out

    def _long(self, unit: str) -> int:
        return sum(1 if s < self.size else len(unit[i].replace(" ", MARK).encode()) for s, i in self.merge_long(unit))


@lru_cache(maxsize=2)
def load(path: str) -> Vocab:
    return Vocab(path)
