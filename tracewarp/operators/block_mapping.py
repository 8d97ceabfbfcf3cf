"""Many short signals mapped to many: a block of reads meets the stream of all references, and chains are made and aligned many at a time.

All pairs are compared, so work is quadratic; what a task holds isn't: a block of reads, HITS hits, PENDING chains, and of each read the
chains that may still count.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import MapOptions
from ..functions.sketch import seeds_of
from .dtw import warp_alike
from .mapping import ALIGNED, CELLS, CHAIN, HITS, chain, ends_of

SIDE = "id long, strand int, hashes array<int>, places array<int>, signal array<double>"
#: Chains that wait to be aligned together, and reads of a block: at most, and where there are fewer blocks than tasks.
PENDING, MOST, FEWEST = 1 << 18, 1 << 16, 256


def block_chains(reads: DataFrame, refs: DataFrame, o: MapOptions, others_only: bool = False) -> DataFrame:
    """What align(chains()) gives for the hits of reads (read_id, signal) on refs (ref_id, strand, signal), or chains() where o.least_aligned is None.

    Every block of reads is a partition, to which all references come in the order of ref_id and strand. So what a read's earlier strands
    reached is known when its next one comes, and no hit or chain is shuffled.
    """
    spark = reads.sparkSession
    n = reads.count()
    blocks = max(1, -(-n // MOST), min(2 * spark.sparkContext.defaultParallelism, -(-n // FEWEST)))
    columns = [c.split()[0] for c in SIDE.split(", ")]
    told = _sketched(reads.select(F.col("read_id").alias("id"), F.lit(0).alias("strand"), "signal"), o)
    asked = _sketched(refs.select(F.col("ref_id").alias("id"), "strand", "signal"), o)
    told = told.select(F.lit(0).alias("side"), F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int").alias("one"), *columns)
    asked = asked.where(F.size("hashes") > 0).select(F.lit(1).alias("side"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("one"), *columns)

    def run(batches):
        held, block = [], None
        for b in batches:
            first = int(np.searchsorted(b.column("side").to_numpy(), 1))
            if first:
                held.append(b.slice(0, first))
            if first < b.num_rows and held:
                block = block or Block(pa.Table.from_batches(held), o, others_only)
                yield from block.meet(pa.Table.from_batches([b.slice(first)]))
        if block:
            yield from block.rest()

    rows = told.unionByName(asked).repartitionById(blocks, "one").sortWithinPartitions("side", "id", "strand")
    return rows.mapInArrow(run, CHAIN if o.least_aligned is None else CHAIN + ", aligned double")


def _sketched(rows: DataFrame, o: MapOptions) -> DataFrame:
    """SIDE of rows (id, strand, signal): sketch() as arrays, hashes by their 32 bits. Rows without an id map to nothing."""

    def run(batches):
        for b in batches:
            found = [seeds_of(np.asarray(x.values, float), o.e, o.w, o.least_change) if x.is_valid else (np.zeros(0, int), np.zeros(0, np.int64)) for x in b.column(2)]
            at = pa.array(np.cumsum([0, *(len(h) for _, h in found)]), pa.int32())
            lists = [pa.ListArray.from_arrays(at, pa.array(np.concatenate([f[k] for f in found]).astype(np.int32) if found else [], pa.int32())) for k in (1, 0)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *lists, b.column(2)], [c.split()[0] for c in SIDE.split(", ")])

    signal = F.transform("signal", lambda x: x.cast("double"))
    return rows.where("id is not null").select(F.col("id").cast("long"), F.col("strand").cast("int"), signal.alias("signal")).mapInArrow(run, SIDE)


def _flat(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Sizes and elements of lists."""
    lists = column.combine_chunks()
    return lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64), lists.flatten().to_numpy(zero_copy_only=False)


def _spread(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of each list, size of them."""
    return np.repeat(start - (np.cumsum(size) - size), size) + np.arange(size.sum())


def _before(size: np.ndarray) -> np.ndarray:
    return np.cumsum(size) - size


def chain_alike(t: np.ndarray, q: np.ndarray, o: MapOptions) -> tuple[np.ndarray, np.ndarray]:
    """chain() of many lists of equal length, at most o.band, a row each."""
    f, pred, every = np.full(t.shape, float(o.e)), np.tile(np.arange(t.shape[1]), (len(t), 1)), np.arange(len(t))
    for i in range(1, t.shape[1]):
        dt, dq = (v[:, i, None] - v[:, :i][:, ::-1] for v in (t, q))  # nearest first
        ahead = (dt > 0) & (dq > 0) & (dt <= o.far)
        straight = ahead & (np.abs(dt - dq) < o.gap) & (4 * dq > 3 * dt) & (dq < 5 * dt)
        score = np.where(straight, f[:, :i][:, ::-1] + np.minimum(np.minimum(dt, dq), o.e), 0.0)
        if i > o.skips:
            better = score > np.maximum.accumulate(np.concatenate([f[:, i, None], score[:, :-1]], 1), 1)
            tired = np.cumsum(np.where(ahead, np.where(better, -1, 1), 0), 1) > o.skips
            score[np.maximum.accumulate(tired, 1)] = 0.0
        at = score.argmax(1)
        top = score[every, at]
        some = top > f[:, i]
        f[some, i], pred[some, i] = top[some], i - 1 - at[some]
    return f, pred


def ends_alike(f: np.ndarray, pred: np.ndarray, o: MapOptions) -> list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """ends_of() of many lists of equal length: (rows, score of the end, score of the chain, members as a mask) for each place of an end."""
    n, k = f.shape
    able = (f >= o.least_score) & (f > np.maximum.accumulate(f, 1) / 2) if o.prune else np.ones(f.shape, bool)
    used, out = np.zeros(f.shape, bool), []
    for _ in range(o.best_chains):
        rows = np.flatnonzero(able.any(1))
        if not len(rows):
            break
        at = k - 1 - np.argmax(np.where(able[rows], f[rows], -np.inf)[:, ::-1], 1)  # the last one of the best
        able[rows, at] = False
        end, score, members = f[rows, at], f[rows, at].copy(), np.zeros((len(rows), k), bool)
        going = np.arange(len(rows))
        while len(going):
            taken = used[rows[going], at[going]]
            score[going[taken]] -= f[rows[going[taken]], at[going[taken]]]
            going = going[~taken]
            members[going, at[going]] = used[rows[going], at[going]] = True
            before = pred[rows[going], at[going]]
            more = before != at[going]
            going = going[more]
            at[going] = before[more]
        out.append((rows, end, score, members))
    return out


class Block:
    """A block of reads, and what is known of their chains by now."""

    FIELDS = ("x", "ref_id", "strand", "slot", "score", "n", "reach", "aligned")

    def __init__(self, rows: pa.Table, o: MapOptions, others_only: bool):
        self.o, self.others_only = o, others_only
        self.bare = 2 if o.least_anchors >= 2 and (not o.prune or 2 * o.least_score >= o.e) else 1
        self.ids = rows["id"].to_numpy()
        size, self.signal = _flat(rows["signal"])
        self.at = _before(size)
        size, hashes = _flat(rows["hashes"])
        order = np.argsort(hashes, kind="stable")
        self.hashes, self.first, self.count = np.unique(hashes[order], return_index=True, return_counts=True)
        self.seed_x, self.seed_q = np.repeat(np.arange(len(size)), size)[order], _flat(rows["places"])[1].astype(np.int64)[order]
        self.seen = np.zeros(len(size))
        self.waiting: list[dict] = []
        self.kept: dict | None = None

    def meet(self, refs: pa.Table):
        """The hits of a batch of references, HITS at a time unless one reference has more."""
        if not len(self.hashes):
            return
        size, g = _flat(refs["hashes"])
        t, (length, signal) = _flat(refs["places"])[1].astype(np.int64), _flat(refs["signal"])
        ref, strand, start = refs["id"].to_numpy(), refs["strand"].to_numpy(), _before(length)
        y = np.repeat(np.arange(len(size)), size)
        place = np.minimum(np.searchsorted(self.hashes, g), len(self.hashes) - 1)
        n, low = np.where(self.hashes[place] == g, self.count[place], 0), self.first[place]
        past, last_seed = np.concatenate([[0], np.cumsum(n)]), np.cumsum(size)
        wide = [int(v.max(initial=0)).bit_length() for v in (t, self.seed_q)]
        most = 1 << max(0, 62 - sum(wide) - len(self.ids).bit_length())
        first = done = 0
        while first < len(size):
            last = min(max(first + 1, int(np.searchsorted(past[last_seed], past[done] + HITS, "right"))), first + most)
            seeds = slice(done, last_seed[last - 1])
            if past[seeds.stop] > past[done]:
                self._hits(ref[first:last], strand[first:last], start[first:last], signal, y[seeds] - first, t[seeds], low[seeds], n[seeds], wide)
            first, done = last, int(last_seed[last - 1])
        if sum(len(c["x"]) for c in self.waiting) >= PENDING:
            yield from self._align()

    def rest(self):
        yield from self._align()
        if self.kept is not None:
            yield self._batch(self._judged(), True)

    def _hits(self, ref, strand, start, signal, y, t, low, n, wide):
        """Chains of all pairs of a read and a reference that share seeds."""
        o, (wt, wq) = self.o, wide
        wy = len(ref).bit_length()
        key = (self.seed_x << (wy + wt + wq) | self.seed_q)[_spread(low, n)] + np.repeat(y << (wt + wq) | t << wq, n)
        key.sort()  # by read, reference, t and q
        new = np.flatnonzero(np.concatenate([[True], (key[1:] ^ key[:-1]) >> (wt + wq) != 0]))
        size = np.diff(np.append(new, len(key)))
        some = size >= self.bare
        new, size = new[some], size[some]
        pair = key[new] >> (wt + wq)
        x, y = pair >> wy, pair & (1 << wy) - 1
        if self.others_only:
            some = self.ids[x] != ref[y]
            new, size, x, y = new[some], size[some], x[some], y[some]
        key = key[_spread(new, size)]
        t, q, new = (key >> wq & (1 << wt) - 1).astype(np.int32), (key & (1 << wq) - 1).astype(np.int32), _before(size)
        if o.prune and len(new):  # a chain's score is at most that of its span
            span = np.minimum(t[new + size - 1] - t[new], np.maximum.reduceat(q, new) - np.minimum.reduceat(q, new))
            some = np.minimum(size * o.e, o.e + span) >= o.least_score
            new, size, x, y = new[some], size[some], x[some], y[some]
        best, found = np.zeros(len(new)), []

        def add(of, f, pred, listed):
            best[of] = f.max(1)
            before = np.full(len(of), np.inf)
            for slot, (rows, end, score, members) in enumerate(listed):
                held = members.sum(1)
                some = held >= o.least_anchors
                where = np.nonzero(members[some])
                found.append((of[rows[some]], np.full(some.sum(), slot), end[some], before[rows[some]], score[some], held[some], new[of[rows[some]]][where[0]] + where[1]))
                before = np.full(len(of), np.inf)
                before[rows] = end

        for k in np.unique(size):
            of = np.flatnonzero(size == k)
            if k > o.band:
                for i in of:
                    f, pred = chain(t[new[i] : new[i] + k], q[new[i] : new[i] + k], o.e, o.band, o.gap, o.far, o.skips)
                    _, ends = ends_of(f, pred, o)
                    members = [np.isin(np.arange(k), path)[None] for _, _, path in ends]
                    add(np.array([i]), f[None], pred[None], [(np.array([0]), np.array([end]), np.array([score]), m) for (end, score, _), m in zip(ends, members, strict=True)])
                continue
            cells = new[of][:, None] + np.arange(k)
            f, pred = chain_alike(t[cells], q[cells], o)
            if o.prune:
                some = f.max(1) >= o.least_score
                of, f, pred = of[some], f[some], pred[some]
            if len(of):
                add(of, f, pred, ends_alike(f, pred, o))
        if not found:
            return
        of, slot, end, before, score, held, cells = (np.concatenate(c) for c in zip(*found, strict=True))
        if o.prune:  # pairs are in the order of their reads, and for each read of its references
            able = np.flatnonzero(best >= o.least_score)
            step = 2.0 ** int(np.ceil(np.log2(best.max() + 1)))
            upto = np.maximum.accumulate(best[able] + x[able] * step) - x[able] * step
            first = np.concatenate([[True], x[able[1:]] != x[able[:-1]]])
            seen = np.zeros(len(best))
            seen[able] = np.maximum(np.where(first, 0.0, np.append(0.0, upto[:-1])), self.seen[x[able]])
            np.maximum.at(self.seen, x[able], best[able])
            some = (end > seen[of] / 2) & (before >= np.maximum(seen[of], best[of]) / 2)
            of, slot, score, cells, held = of[some], slot[some], score[some], cells[np.repeat(some, held)], held[some]
        if not len(of):
            return
        t, q, head = t[cells], q[cells], _before(held)
        span = t[head + held - 1] - t[head] + 1
        self.waiting.append({
            "x": x[of], "ref_id": ref[y[of]], "strand": strand[y[of]], "slot": slot, "score": score, "n": held, "t": t, "q": q,
            "span": span, "y": signal[_spread(start[y[of]] + t[head], span)] if o.least_aligned is not None else signal[:0],
        })

    def _align(self):
        """Chains that wait join those kept; those that no order of what is to come would let count are dropped."""
        if not self.waiting:
            return
        c = {k: np.concatenate([w[k] for w in self.waiting]) for k in self.waiting[0]}
        self.waiting = []
        if self.o.least_aligned is None:
            yield self._batch(c, False)
            return
        c["reach"], c["aligned"] = self._scores(c)
        c = _chosen(c, c["aligned"] >= self.o.least_aligned)
        if self.kept is not None:
            c = {k: np.concatenate([self.kept[k], c[k]]) for k in c}
        c = _chosen(c, np.lexsort((c["slot"], c["strand"], c["ref_id"], -c["score"], c["x"])))
        # after a chain, what its read has reached is at least its bar, whether it counts or is given up
        bar = np.minimum(c["reach"], c["aligned"])
        values, rank = np.unique(bar, return_inverse=True)
        upto = np.maximum.accumulate(rank + c["x"] * len(values)) - c["x"] * len(values)
        first = np.concatenate([[True], c["x"][1:] != c["x"][:-1]])[: len(bar)]
        reached = np.maximum(0.0, np.where(first, 0.0, np.append(0.0, values[upto[:-1]])[: len(bar)])) if len(bar) else bar
        self.kept = _chosen(c, c["reach"] >= reached)

    def _scores(self, c: dict) -> tuple[np.ndarray, np.ndarray]:
        """(what a chain could reach before its last piece is aligned, its score) as chain_score() has them."""
        o, head, t, q = self.o, _before(c["n"]), c["t"], c["q"]
        last = head + c["n"] - 1
        if o.sparse:
            pieces = c["n"] - 1
            left = _spread(head, pieces)
            right = left + 1
        else:
            pieces, left, right = np.ones(len(head), np.int64), head, last
        of = np.repeat(np.arange(len(head)), pieces)
        number = np.arange(len(of)) - np.repeat(_before(pieces), pieces)
        rows, columns = q[right] - q[left] + 1, t[right] - t[left] + 1
        x, y = self.at[c["x"]][of] + q[left], _before(c["span"])[of] + t[left] - t[head][of]
        cost = np.zeros(len(of))
        shape = rows * (columns.max(initial=0) + 1) + columns
        order = np.argsort(shape, kind="stable")
        for at in np.split(order, np.flatnonzero(np.diff(shape[order])) + 1) if len(order) else []:
            r, k = int(rows[at[0]]), int(columns[at[0]])
            a, b = self.signal[np.arange(r)[:, None] + x[at]], c["y"][np.arange(k)[:, None] + y[at]]
            part = warp_alike(a, b, max(1, int(r * o.share)) if o.banded else None)
            inner = number[at] < pieces[of[at]] - 1
            cost[at] = np.where(inner, part - np.abs(a[-1] - b[-1]), part)
        reach, total = (q[last] - q[head] + 1) * o.bonus, np.zeros(len(head))
        reach[pieces == 0] += 1e-6
        by = np.argsort(number, kind="stable")  # sums run from piece to piece
        for at in np.split(by, np.flatnonzero(np.diff(number[by])) + 1) if len(by) else []:
            total[of[at]] += cost[at]
            inner = at[number[at] < pieces[of[at]] - 1]
            reach[of[inner]] -= cost[inner]
        return reach, np.bincount(of, rows, len(head)) * o.bonus - total

    def _judged(self) -> dict:
        """The kept chains that scored() would keep: each is taken if it could reach the best alignment before it."""
        c = self.kept
        first = np.concatenate([[True], c["x"][1:] != c["x"][:-1]])[: len(c["x"])]
        turn = np.arange(len(first)) - np.flatnonzero(first)[np.cumsum(first) - 1]
        best, good = np.zeros(len(self.ids)), np.zeros(len(first), bool)
        by = np.argsort(turn, kind="stable")
        for at in np.split(by, np.flatnonzero(np.diff(turn[by])) + 1) if len(by) else []:
            at = at[c["reach"][at] >= best[c["x"][at]]]
            good[at] = True
            best[c["x"][at]] = np.maximum(best[c["x"][at]], c["aligned"][at])
        return _chosen(c, good)

    def _batch(self, c: dict, aligned: bool) -> pa.RecordBatch:
        head = _before(c["n"])
        last = head + c["n"] - 1
        cells = pa.StructArray.from_arrays([pa.array(c[k].astype(np.int32)) for k in ("t", "q")], fields=list(CELLS.value_type))
        lists = pa.ListArray.from_arrays(pa.array(np.append(head, c["n"].sum()), pa.int32()), cells)
        ends = [c["t"][head], c["t"][last], c["q"][head], c["q"][last]]
        columns = [self.ids[c["x"]], c["ref_id"], c["strand"], c["slot"], c["score"], c["n"], *ends]
        schema = ALIGNED if aligned else pa.schema(list(ALIGNED)[:-1])
        arrays = [pa.array(v, f.type) for v, f in zip(columns, schema, strict=False)] + [lists]
        return pa.RecordBatch.from_arrays(arrays + ([pa.array(c["aligned"])] if aligned else []), schema=schema)


def _chosen(c: dict, at: np.ndarray) -> dict:
    """The chains of a mask or of places, with their anchors and spans."""
    at = np.flatnonzero(at) if at.dtype == bool else at
    size, head = c["n"][at], _before(c["n"])[at]
    cells = _spread(head, size)
    return {k: v[cells] if k in ("t", "q") else v[at] for k, v in c.items() if k not in ("span", "y")}
