"""A robust-pruned directed proximity graph over unit vectors, in batched NumPy.

Points are inserted in batches.  A batch searches the graph built so far (greedy
beam search), the found points are pruned with a relaxed distance test so that
the kept edges point in different directions, and reverse edges are added (and
pruned again where a list overflows).  All steps work on whole batches, so the
interpreter runs a handful of array operations per search step, not per vector.
"""

from __future__ import annotations

import numpy as np

_ID_BITS = 31
#: Rows worked on at once: the gathered vectors of one step then stay in a core's cache.
CHUNK = 32
_TABLE = 2048


def _pack(sims: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """One sortable int64 per candidate: similarity in the high half, id in the low half."""
    bits = (sims.astype(np.float32) + np.float32(2.0)).view(np.int32).astype(np.int64)
    return (bits << 32) | (ids.astype(np.int64) << 1)


def _ids(keys: np.ndarray) -> np.ndarray:
    return ((keys >> 1) & ((1 << _ID_BITS) - 1)).astype(np.int32)


class ProximityGraph:
    """Graph of one shard.

    degree: out-edges kept by a prune; a list may grow to 1.5 times that before it
    is pruned again.  beam: points kept during a search while building.  relax:
    a candidate c of x is dropped when a kept p has relax * d(p, c) <= d(x, c),
    with d = 1 - cosine.

    With min_sim, every insertion also reports the pairs (later point, earlier point) of at
    least that similarity which its search met; pairs inside one batch are compared directly.
    """

    def __init__(self, vectors: np.ndarray, degree: int = 16, beam: int = 24, relax: float = 1.2,
                 pivots: int = 256, batch: int = 512, seed: int = 7, min_sim: float | None = None):
        n, dim = vectors.shape
        self.n, self.degree, self.beam, self.relax, self.batch = n, degree, beam, relax, batch
        self.min_sim, self.met = min_sim, []
        self.width = degree + degree // 2
        self.x = np.zeros((n + 1, dim), np.float32)
        self.x[:n] = vectors
        self.edges = np.full((n + 1, self.width), n, np.int32)
        self.fill = np.zeros(n + 1, np.int32)
        rng = np.random.default_rng(seed)
        order = rng.permutation(n).astype(np.int32)
        self.entry = order[: min(n, pivots)]
        self._build(order)

    def _build(self, order: np.ndarray) -> None:
        first = order[: min(self.n, 4 * self.beam)]
        self._report(first)
        self._link(first, np.broadcast_to(first, (len(first), len(first))))
        done = len(first)
        while done < self.n:
            block = order[done: done + min(done, self.batch)]
            sims, found = self.search(self.x[block], self.beam)
            if self.min_sim is not None:
                r, c = np.nonzero(sims >= self.min_sim)
                self.met.append((block[r], found[r, c]))
                self._report(block)
            self._link(block, found)
            done += len(block)

    def _report(self, block: np.ndarray) -> None:
        if self.min_sim is not None:
            r, c = np.nonzero(np.triu(self.x[block] @ self.x[block].T >= self.min_sim, 1))
            self.met.append((block[r], block[c]))

    def pairs(self) -> tuple[np.ndarray, np.ndarray]:
        """The reported pairs, both ways round, without repeats.

        A point with so many partners that a beam may not have held them all is looked up
        again in the finished graph, with a beam that is doubled until it ends below min_sim
        or holds eight times as many.  No result depends on that end: only the few nearest
        partners of a point are asked for, and they head its beam.
        """
        a = np.concatenate([x for x, _ in self.met]) if self.met else np.zeros(0, np.int32)
        b = np.concatenate([y for _, y in self.met]) if self.met else np.zeros(0, np.int32)
        crowded = np.flatnonzero(np.bincount(np.concatenate([a, b]), minlength=self.n) * 2 >= self.beam)
        more = [(a, b)]
        wide = 2 * self.beam
        while len(crowded):
            sims, ids = self.search(self.x[crowded], wide, block=crowded.astype(np.int32))
            r, c = np.nonzero(sims >= self.min_sim)
            more.append((crowded[r], ids[r, c]))
            crowded = crowded[sims[:, -1] >= self.min_sim] if wide < min(self.n, 8 * self.beam) else crowded[:0]
            wide *= 2
        a, b = (np.concatenate([x[i] for x in more]).astype(np.int64) for i in (0, 1))
        both = np.unique(np.concatenate([a * self.n + b, b * self.n + a]))
        # partners of a partner are compared as well; crowded points had their own search
        a, b = both // self.n, both % self.n
        first, count = np.searchsorted(a, np.arange(self.n)), np.bincount(a, minlength=self.n)
        few = count[b] < self.beam
        x, via = a[few], b[few]
        reach = count[via]
        c = b[np.repeat(first[via] - np.r_[0, np.cumsum(reach)[:-1]], reach) + np.arange(reach.sum())] if len(via) else via
        x = np.repeat(x, reach)
        new = np.setdiff1d(x[x != c] * self.n + c[x != c], both)
        for lo in range(0, len(new), 1 << 16):
            i, j = new[lo: lo + (1 << 16)] // self.n, new[lo: lo + (1 << 16)] % self.n
            near = np.einsum("ij,ij->i", self.x[i], self.x[j]) >= self.min_sim
            both = np.concatenate([both, new[lo: lo + (1 << 16)][near]])
        both = np.unique(both)
        return both // self.n, both % self.n

    def _prune(self, owners: np.ndarray, cand: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The kept candidates of each owner, nearest first, and how many there are."""
        n, b = self.n, len(owners)
        cv = self.x[cand]
        sims = np.matmul(cv, self.x[owners][:, :, None])[:, :, 0]
        sims[(cand == n) | (cand == owners[:, None])] = -1.9
        near = np.argsort(-sims, axis=1, kind="stable")
        cand, sims = np.take_along_axis(cand, near, 1), np.take_along_axis(sims, near, 1)
        cv = self.x[cand]
        between = np.matmul(cv, cv.transpose(0, 2, 1))
        alive = sims > -1.5
        alive[:, 1:] &= ~((cand[:, 1:] == cand[:, :-1]) & alive[:, :-1])
        limit = 1.0 - (1.0 - sims) / self.relax  # dropped when the kept point is at least so similar
        kept = np.full((b, self.degree), n, np.int32)
        size = np.zeros(b, np.int32)
        rows = np.arange(b)
        for _ in range(self.degree):
            at = alive.argmax(axis=1)
            ok = alive[rows, at]
            if not ok.any():
                break
            kept[rows[ok], size[ok]] = cand[rows[ok], at[ok]]
            size += ok
            alive &= between[rows, at] < limit
            alive[rows, at] = False
        return kept, size

    def _link(self, owners: np.ndarray, cand: np.ndarray) -> None:
        for lo in range(0, len(owners), CHUNK):
            own = owners[lo: lo + CHUNK]
            kept, size = self._prune(own, cand[lo: lo + CHUNK])
            self.edges[own, : self.degree] = kept
            self.edges[own, self.degree:] = self.n
            self.fill[own] = size
        # reverse edges, grouped by target
        src = np.repeat(owners, self.degree)
        dst = self.edges[owners, : self.degree].ravel()
        real = dst < self.n
        src, dst = src[real], dst[real]
        by = np.argsort(dst, kind="stable")
        src, dst = src[by], dst[by]
        start = np.flatnonzero(np.r_[True, dst[1:] != dst[:-1]]) if len(dst) else np.zeros(0, int)
        rank = np.arange(len(dst)) - np.repeat(start, np.diff(np.r_[start, len(dst)]))
        target = dst[start] if len(dst) else dst
        count = np.diff(np.r_[start, len(dst)])
        over_t = self.fill[target] + count > self.width
        over = np.repeat(over_t, count)
        at = self.fill[dst] + rank
        self.edges[dst[~over], at[~over]] = src[~over]
        self.fill[target[~over_t]] += count[~over_t].astype(np.int32)
        if over_t.any():
            # crowded targets: old list and all newcomers go through one prune, widest lists apart
            t, c, s = target[over_t], count[over_t], start[over_t]
            for lo_c, hi_c in ((0, 16), (16, 64), (64, len(dst) + 1)):
                pick = np.flatnonzero((c > lo_c) & (c <= hi_c))
                step = CHUNK if hi_c <= 64 else 16
                for lo in range(0, len(pick), step):
                    p = pick[lo: lo + step]
                    wide = int(c[p].max())
                    col = np.arange(wide)
                    take = s[p][:, None] + np.minimum(col, c[p][:, None] - 1)
                    new = np.where(col < c[p][:, None], src[take], self.n).astype(np.int32)
                    if wide > 96:  # a hub keeps `degree` edges anyway, out of its nearest; no result is dropped here
                        sims = np.matmul(self.x[new], self.x[t[p]][:, :, None])[:, :, 0]
                        sims[new == self.n] = -2
                        new = np.take_along_axis(new, np.argpartition(-sims, 95, axis=1)[:, :96], 1)
                    kept, size = self._prune(t[p], np.concatenate([self.edges[t[p]], new], axis=1))
                    self.edges[t[p], : self.degree] = kept
                    self.edges[t[p], self.degree:] = self.n
                    self.fill[t[p]] = size

    def search(self, queries: np.ndarray, beam: int, block: np.ndarray | None = None,
               expand: int = 4) -> tuple[np.ndarray, np.ndarray]:
        """Similarities and ids of the beam of each query, best first; id n fills empty places.

        block: ids of the queries where they are points of the graph; their edges then
        join the entry points and the point itself is left out.
        """
        n, sims_out, ids_out = self.n, [], []
        size = CHUNK
        for lo in range(0, len(queries), size):
            q = queries[lo: lo + size]
            s, i = self._search(q, beam, None if block is None else block[lo: lo + size], expand)
            sims_out.append(s)
            ids_out.append(i)
        if not sims_out:
            return np.zeros((0, beam), np.float32), np.zeros((0, beam), np.int32)
        return np.concatenate(sims_out), np.concatenate(ids_out)

    def _search(self, q, beam, own, expand):
        n, b = self.n, len(q)
        # which points a query has met: a small direct-mapped table, so that it stays in cache
        met = np.full((b, _TABLE), -1, np.int32)
        turn = np.zeros((b, _TABLE), np.uint16)
        rows = np.arange(b)
        entry = q @ self.x[self.entry].T
        take = min(len(self.entry), max(4, beam // 4))
        at = np.argpartition(-entry, take - 1, axis=1)[:, :take]
        cand = self.entry[at]
        if own is not None:
            cand = np.concatenate([cand, self.edges[own]], axis=1)
        keys = np.sort(self._score(q, rows, cand, met, turn, own), axis=1)
        if keys.shape[1] < beam:
            keys = np.concatenate([np.full((b, beam - keys.shape[1]), 1, np.int64), keys], axis=1)
        keys = np.ascontiguousarray(keys[:, -beam:])
        live = rows
        while len(live):
            whole = len(live) == b
            part = keys if whole else keys[live]
            open_ = (part & 1) == 0
            pick = np.argsort(open_, axis=1, kind="stable")[:, -expand:]  # the last open places are the best
            r = np.arange(len(part))[:, None]
            nodes = np.where(open_[r, pick], _ids(part[r, pick]), n)
            part[r, pick] |= 1
            cand = self.edges[nodes].reshape(len(part), -1)
            new = self._score(q if whole else q[live], live, cand, met, turn, None if own is None else own[live])
            part = np.sort(np.concatenate([part, new], axis=1), axis=1)[:, -beam:]
            # a point that the table forgot and that was met again
            twice = (part[:, 1:] | 1) == (part[:, :-1] | 1)
            if twice.any():
                part[:, :-1][twice & (part[:, 1:] > 1)] = 1
            keys[live] = part
            live = live[((part & 1) == 0).any(axis=1)]
        keys = np.sort(keys, axis=1)[:, ::-1]
        none = keys < (1 << 32)
        ids = np.where(none, n, _ids(keys)).astype(np.int32)
        sims = (keys >> 32).astype(np.int32).view(np.float32) - np.float32(2.0)
        sims[none] = -2
        return sims, ids

    def _score(self, q, rows, cand, met, turn, own):
        """Packed keys of candidates met for the first time; 1 (a closed, empty place) for the others."""
        r = rows[:, None]
        slot = cand & (_TABLE - 1)
        order = np.arange(cand.shape[1], dtype=np.uint16)[None, :]
        fresh = (met[r, slot] != cand) & (cand != self.n)
        if own is not None:
            fresh &= cand != own[:, None]
        met[r, slot] = cand
        turn[r, slot] = order
        fresh &= (turn[r, slot] == order) | (met[r, slot] != cand)
        sims = np.matmul(self.x[cand], q[:, :, None])[:, :, 0]
        return np.where(fresh, _pack(sims, cand), 1)
