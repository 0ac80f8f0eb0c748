"""A hierarchical navigable small-world graph over unit vectors, built and searched in batches with numpy.

Points are inserted in batches: a batch searches the graph as it stands (all its beams advance in lock
step; up to SMALL points one matrix product costs less and finds the same or better), is linked to diverse neighbours among what it found and among itself, and is linked back. Upper
levels hold a 1/M share of the level below, by a hash of the id, so a rebuild gives the same graph.
"""

from __future__ import annotations

import numpy as np

from .textkit import mix64

M, M0, EF_BUILD, BATCH, BRIDGES, HUB_SIM, HUB_SIZE, SMALL = 12, 24, 48, 512, 4, 0.8, 4, 16_384


class Level:
    """One level: local points, their vectors, and neighbour lists (-1: none)."""

    def __init__(self, x: np.ndarray, width: int) -> None:
        self.x, self.width = x, width
        self.nbrs = np.full((len(x), width + BRIDGES), -1, dtype=np.int32)
        self.n = 0  # points inserted so far: a prefix

    def search(self, q: np.ndarray, entry: np.ndarray, ef: int) -> tuple[np.ndarray, np.ndarray]:
        """Best ef points for each query from its entry points: (ids, similarities), best first, -1 where fewer."""
        nq = len(q)
        rows = np.arange(nq)[:, None]
        ids = np.full((nq, ef), -1, dtype=np.int32)
        sims = np.full((nq, ef), -9.0, dtype=np.float32)
        seen = np.zeros((nq, self.n + 1), dtype=bool)  # the last column takes the -1s
        done = np.zeros((nq, ef), dtype=bool)
        k = min(entry.shape[1], ef)
        ids[:, :k] = entry[:, :k]
        sims[:, :k] = np.where(ids[:, :k] >= 0, np.einsum("qkd,qd->qk", self.x[ids[:, :k]], q), -9)
        seen[rows, ids[:, :k]] = True
        seen[:, -1] = True
        seen, first = seen.reshape(-1), np.arange(nq) * (self.n + 1)
        nbrs = self.nbrs[:, : self.width + int((self.nbrs[:, self.width :] >= 0).any(0).sum())]  # bridges fill from the left
        live = np.arange(nq)
        ahead = max(1, ef // 8)  # every point that stays in a beam is opened in the end, so opening some at once adds little
        while len(live):
            open_ = np.where(done[live] | (ids[live] < 0), -9, sims[live])
            live = live[go := open_.max(1) > -9]
            if not len(live):
                break
            open_ = open_[go]
            at = np.argpartition(-open_, ahead - 1, 1)[:, :ahead] if ahead < ef else np.arange(ef)[None, :].repeat(len(live), 0)
            col = live[:, None]
            from_ = np.where(np.take_along_axis(open_, at, 1) > -9, ids[col, at], -1)
            done[col, at] = True
            near = nbrs[from_].astype(np.int64)
            near[(from_[:, :, None] < 0) | (near < 0)] = self.n
            fresh = np.empty(near.shape, dtype=bool)
            for k in range(near.shape[1]):  # a point counts where it is met first
                place = near[:, k] + first[live][:, None]
                fresh[:, k] = ~seen.take(place)
                seen[place.reshape(-1)] = True
            near, fresh = near.reshape(len(live), -1), fresh.reshape(len(live), -1)
            r, c = np.nonzero(fresh)
            s = np.full(near.shape, -9, dtype=np.float32)
            s[r, c] = np.einsum("nd,nd->n", self.x[near[r, c]], q[live[r]])
            all_s = np.concatenate([sims[live], s], 1)
            top = np.argpartition(-all_s, ef - 1, 1)[:, :ef]
            best = np.take_along_axis(all_s, top, 1)
            ids[live] = np.where(best > -9, np.take_along_axis(np.concatenate([ids[live], near], 1), top, 1), -1)
            done[live] = np.take_along_axis(np.concatenate([done[live], np.zeros(near.shape, dtype=bool)], 1), top, 1)
            sims[live] = best
        order = np.argsort(-sims, 1, kind="stable")
        ids, sims = np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1)
        return ids, sims

    def choose(self, ids: np.ndarray, sims: np.ndarray) -> np.ndarray:
        """Up to width diverse neighbours from candidates (best first): one is taken unless it is nearer to a
        taken one than to the point; free places go to the best of the rest."""
        n, c = ids.shape
        vec = self.x[ids]
        among = vec @ vec.transpose(0, 2, 1)
        nearest = np.full((n, c), -9, dtype=np.float32)  # of each candidate to the taken ones
        count = np.zeros(n, dtype=np.int64)
        used = np.zeros((n, c), dtype=bool)
        for j in range(c):
            r = np.flatnonzero((ids[:, j] >= 0) & (count < self.width) & (nearest[:, j] < sims[:, j]))
            nearest[r, j + 1 :] = np.maximum(nearest[r, j + 1 :], among[r, j, j + 1 :])
            count[r] += 1
            used[r, j] = True
        taken = np.full((n, self.width), -1, dtype=np.int32)
        rest = (ids >= 0) & ~used
        place = np.where(used, np.cumsum(used, 1) - 1, count[:, None] + np.cumsum(rest, 1) - 1)
        r, j = np.nonzero((used | rest) & (place < self.width))
        taken[r, place[r, j]] = ids[r, j]
        return taken

    def insert(self, upto: int, entry: np.ndarray | None) -> None:
        """Insert the points n:upto; entry: entry points of each (None for the first batch)."""
        new = np.arange(self.n, upto)
        x = self.x[new]
        # one product with all points costs less than beams while the graph is small; else beams and the batch itself
        small = upto <= SMALL
        pool = np.arange(upto) if small else new
        among = x @ self.x[pool].T
        among[np.arange(len(new)), new - pool[0]] = -9
        k = min(EF_BUILD, len(pool) - 1)
        part = np.argpartition(-among, max(k - 1, 0), 1)[:, :k]
        part = np.take_along_axis(part, np.argsort(-np.take_along_axis(among, part, 1), 1, kind="stable"), 1)
        ids, sims = pool[part].astype(np.int32), np.take_along_axis(among, part, 1)
        if not small:
            a, s = self.search(x, entry, EF_BUILD)
            ids, sims = np.concatenate([ids, a], 1), np.concatenate([sims, s], 1)
            top = np.argsort(-sims, 1, kind="stable")[:, :EF_BUILD]
            ids, sims = np.take_along_axis(ids, top, 1), np.take_along_axis(sims, top, 1)
        self.n = upto
        if not ids.shape[1]:
            return
        self.nbrs[new, : self.width] = self.choose(ids, sims)
        # links back
        src = np.repeat(new, self.width)
        dst = self.nbrs[new, : self.width].ravel()
        src, dst = src[dst >= 0], dst[dst >= 0]
        order = np.argsort(dst, kind="stable")
        src, dst = src[order], dst[order]
        begin = np.concatenate([[0], np.flatnonzero(np.diff(dst)) + 1, [len(dst)]])
        size = np.diff(begin)
        most = min(int(size.max()), 2 * self.width) if len(size) else 0
        if not most:
            return
        at = begin[:-1, None] + np.arange(most)[None, :]
        extra = np.where(np.arange(most)[None, :] < size[:, None], src[np.minimum(at, len(src) - 1)], -1)
        who = dst[begin[:-1]]
        have = self.nbrs[who, : self.width]
        extra = np.where((extra[:, :, None] == have[:, None, :]).any(2), -1, extra)
        cand = np.concatenate([have, extra], 1)
        for lo in range(0, len(who), 512):
            c, w = cand[lo : lo + 512], who[lo : lo + 512]
            s = np.where(c >= 0, np.einsum("ncd,nd->nc", self.x[c], self.x[w]), -9)
            top = np.argsort(-s, 1, kind="stable")
            self.nbrs[w, : self.width] = self.choose(np.take_along_axis(c, top, 1), np.take_along_axis(s, top, 1))


    def connect(self, batch: int = 4096) -> None:
        """Bridge what the entry point cannot reach: tight groups keep links only among themselves.

        A point that is not reached is linked from its nearest reached point with a free bridge, until all are.
        """
        reached = np.zeros(self.n + 1, dtype=bool)
        reached[-1] = True
        frontier = np.zeros(1, dtype=np.int64)
        rest = np.arange(self.n)
        while True:
            reached[frontier] = True
            while len(frontier):
                nxt = np.unique(self.nbrs[frontier])
                frontier = nxt[~reached[nxt]]
                reached[frontier] = True
            rest = rest[~reached[rest]]
            if not len(rest):
                return
            u = int(rest[0])
            sims = np.where(reached[:-1] & (self.nbrs[:, -1] < 0), self.x[: self.n] @ self.x[u], -9)
            r = int(sims.argmax())
            free = self.width + int(np.flatnonzero(self.nbrs[r, self.width :] < 0)[0])
            self.nbrs[r, free] = u
            frontier = np.array([u])


class Graph:
    """Levels over points sorted so that each level is a prefix: the highest first."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        u = mix64(ids.astype(np.uint64)).astype(np.float64) / 2.0**64
        level = np.floor(-np.log(np.maximum(u, 1e-18)) / np.log(M)).astype(int)
        order = np.lexsort((ids, -level))
        self.ids, self.raw, level = ids[order], vectors[order], level[order]
        self._scaled()
        top = int(level[0])
        while top and (level >= top).sum() < 2:
            top -= 1
        self.levels = [Level(self.unit[: int((level >= k).sum())], M0 if k == 0 else M) for k in range(top + 1)]
        for k in range(top, -1, -1):  # a level's points enter where the levels above lead them
            lv = self.levels[k]
            while lv.n < len(lv.x):
                upto = min(len(lv.x), lv.n + min(BATCH, max(64, lv.n)))
                entry = None
                if lv.n and upto > SMALL:
                    entry = self.entries(lv.x[lv.n : upto], k) if k < top else np.zeros((upto - lv.n, 1), dtype=np.int32)
                lv.insert(upto, entry)
            lv.connect()
        self.hubs = self.find_hubs()

    def _scaled(self) -> None:
        wide = self.raw.astype(np.float64)
        self.norm = np.linalg.norm(wide, axis=1)
        self.unit = (wide / self.norm[:, None]).astype(np.float32)

    def find_hubs(self) -> np.ndarray:
        """One point of each tight group (points linked at HUB_SIM or more, at least HUB_SIZE): such a group fills its
        members' lists on every level, so beams may find no way in."""
        base = self.levels[0]
        n = base.n
        src = np.repeat(np.arange(n), base.nbrs.shape[1])
        dst = base.nbrs[:n].ravel().astype(np.int64)
        src, dst = src[dst >= 0], dst[dst >= 0]
        close = np.zeros(len(src), dtype=bool)
        for lo in range(0, len(src), 1 << 16):
            a, b = src[lo : lo + (1 << 16)], dst[lo : lo + (1 << 16)]
            close[lo : lo + (1 << 16)] = np.einsum("nd,nd->n", base.x[a], base.x[b]) >= HUB_SIM
        src, dst = np.concatenate([src[close], dst[close]]), np.concatenate([dst[close], src[close]])
        label = np.arange(n)
        while True:  # least labels spread and jump
            nxt = label.copy()
            np.minimum.at(nxt, src, label[dst])
            nxt = nxt[nxt]
            if (nxt == label).all():
                break
            label = nxt
        size = np.bincount(label, minlength=n)
        return np.flatnonzero(size >= HUB_SIZE).astype(np.int32)

    def entries(self, q: np.ndarray, k: int, ef: int = 8) -> np.ndarray:
        """Entry points for level k, by beams down the levels above."""
        at = np.zeros((len(q), 1), dtype=np.int32)
        for lv in self.levels[:k:-1]:
            at = lv.search(q, at, ef)[0]
        if k == 0 and len(self.hubs_or_none()):
            sims = q @ self.levels[0].x[self.hubs].T
            best = np.argsort(-sims, 1)[:, :4]
            at = np.concatenate([self.hubs[best], np.where((at[:, :, None] == self.hubs[best][:, None, :]).any(2), -1, at)], 1)
        return np.where(at < self.levels[k].n, at, -1)

    def hubs_or_none(self) -> np.ndarray:
        return self.__dict__.get("hubs", np.zeros(0, dtype=np.int32))

    def _incoming(self) -> tuple[np.ndarray, np.ndarray]:
        """Links of the base level against their direction: point i has those at begin[i]:begin[i + 1]."""
        if "incoming" not in self.__dict__:
            base = self.levels[0]
            dst = base.nbrs.ravel()
            order = np.argsort(dst, kind="stable")
            order = order[dst[order] >= 0]
            self.incoming = (order // base.nbrs.shape[1]).astype(np.int32), np.searchsorted(dst[order], np.arange(base.n + 1))
        return self.incoming

    def near(self, q: np.ndarray, threshold: float, ef: int, slack: float, region: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query rows, points) with similarity of threshold - slack or more that the beams meet, and the rows left out; a
        beam that ends inside the region goes on through the region's own links until nothing new turns up. A query
        with more than `region` points there is left out.

        Links are followed against their direction too: pruning can leave a member of a tight group without a link to it."""
        rows, points, wide = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)], []
        base = self.levels[0]
        src, begin = self._incoming()
        ids, sims = base.search(q, self.entries(q, 0, ef), ef)
        inside = sims >= threshold - slack
        for i in np.flatnonzero(inside.any(1)):
            found = ids[i][inside[i]]
            seen = np.zeros(base.n + 1, dtype=bool)
            seen[-1] = True
            seen[ids[i]] = True
            frontier, got, n = found, [found], len(found)
            while len(frontier) and n <= region:
                size = begin[frontier + 1] - begin[frontier]
                back = src[np.repeat(begin[frontier] - np.cumsum(size) + size, size) + np.arange(size.sum())]
                nxt = np.unique(np.concatenate([base.nbrs[frontier].ravel(), back]))
                nxt = nxt[(nxt >= 0) & ~seen[nxt]]
                seen[nxt] = True
                frontier = nxt[base.x[nxt] @ q[i] >= threshold - slack]
                got.append(frontier)
                n += len(frontier)
            if n > region:
                wide.append(i)
            else:
                rows.append(np.full(n, i))
                points.append(np.concatenate(got))
        return np.concatenate(rows), np.concatenate(points), np.array(wide, dtype=np.int64)

    def state(self) -> dict[str, np.ndarray]:
        return {"ids": self.ids, "raw": self.raw, "hubs": self.hubs, **{f"n{k}": lv.nbrs for k, lv in enumerate(self.levels)}}

    @classmethod
    def restored(cls, state) -> Graph:
        g = cls.__new__(cls)
        g.ids, g.raw, g.hubs = state["ids"], state["raw"], state["hubs"]
        g._scaled()
        g.levels = []
        k = 0
        while f"n{k}" in state:
            nbrs = state[f"n{k}"]
            lv = Level(g.unit[: len(nbrs)], nbrs.shape[1] - BRIDGES)
            lv.nbrs, lv.n = nbrs, len(nbrs)
            g.levels.append(lv)
            k += 1
        return g
