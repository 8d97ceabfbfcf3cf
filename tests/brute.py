"""The mapping rules written out one anchor, cell and chain at a time, for comparison with the operators."""

import math


def chain_scores(anchors, o):
    """(f, pred) of anchors [(t, q)] in order."""
    f, pred = [], []
    for i, (t, q) in enumerate(anchors):
        f.append(float(o.e))
        pred.append(i)
        skips = 0
        for p in range(i - 1, max(0, i - o.band) - 1, -1):
            pt, pq = anchors[p]
            if pq == q or pt == t:
                continue
            if pt + o.far < t:
                break
            dt, dq, score = t - pt, q - pq, 0.0
            if dq < 0:
                continue
            if abs(dt - dq) < o.gap and 0.75 < dq / dt < 5:
                score = f[p] + min(dt, dq, o.e)
            if score > f[i]:
                f[i], pred[i] = score, p
                skips -= 1
            else:
                skips += 1
                if skips > o.skips:
                    break
    return f, pred


def read_chains(strands, o):
    """Chains of a read: strands is {(ref, strand): [(t, q)]}. Dictionaries with anchors from the first to the last one."""
    most, out = 0.0, []
    for (ref, strand), anchors in sorted(strands.items()):
        anchors = sorted(anchors)
        f, pred = chain_scores(anchors, o)
        ends = []
        for i, score in enumerate(f):
            most = max(most, score)
            if not o.prune or (score >= o.least_score and score > most / 2):
                ends.append((score, i))
        ends.sort(reverse=True)
        used = set()
        for slot, (score, i) in enumerate(ends[: o.best_chains]):
            if i not in used:
                places, at, hit = [i], i, pred[i] != i and pred[i] in used
                used.add(i)
                while pred[at] != at and pred[at] not in used:
                    at = pred[at]
                    places.append(at)
                    hit = hit or (pred[at] != at and pred[at] in used)
                    used.add(at)
                if len(places) >= o.least_anchors:
                    cells = [anchors[k] for k in reversed(places)]
                    out.append({"ref_id": ref, "strand": strand, "slot": slot, "score": score - (f[pred[at]] if hit else 0), "anchors": cells})
            if o.prune and score < most / 2:
                break
    return out


def band_cells(n, m, radius):
    """Cells (i, j) of the band along the slanted diagonal of n rows and m <= n columns: a set of antidiagonals through moving centres."""
    radius += math.ceil((n - m) * radius / n)
    odd, even = sorted((radius, radius + 1), key=lambda x: -(x % 2))
    cells, column = set(), 0
    for row in range(n):
        if row and (column + 1) * n <= m * row:
            column += 1
            cells |= {(row + even // 2 - 1 - k, column - even // 2 + k) for k in range(even)}
        if row == 0:
            cells.add((0, 0))
        else:
            cells |= {(row + odd // 2 - k, column - odd // 2 + k) for k in range(odd)}
    return {(i, j) for i, j in cells if 0 <= i < n and 0 <= j < m}


def banded_cost(a, b, radius=None):
    if len(a) < len(b):
        a, b = b, a
    allowed = band_cells(len(a), len(b), radius) if radius is not None else {(i, j) for i in range(len(a)) for j in range(len(b))}
    cost = {}
    for i in range(len(a)):
        for j in range(len(b)):
            if (i, j) in allowed:
                before = min((cost.get(x, math.inf) for x in ((i - 1, j), (i, j - 1), (i - 1, j - 1))), default=math.inf)
                cost[i, j] = abs(a[i] - b[j]) + (0 if i == j == 0 else before)
    return cost[len(a) - 1, len(b) - 1]


def aligned(cells, read, ref, o, least):
    """Score of a chain, or None where it is given up."""
    bonus, parts = o.bonus, list(zip(cells, cells[1:], strict=False)) if o.sparse else [(cells[0], cells[-1])]
    left, score = (cells[-1][1] - cells[0][1] + 1) * bonus, 0.0
    for k, ((t0, q0), (t1, q1)) in enumerate(parts):
        if left < least:
            return None
        x, y = read[q0 : q1 + 1], ref[t0 : t1 + 1]
        cost = banded_cost(x, y, max(1, int(len(x) * o.share)) if o.banded else None)
        if k < len(parts) - 1:
            cost -= abs(x[-1] - y[-1])
        left -= cost
        score += len(x) * bonus - cost
    return score


def best_place(strands, read, refs, o):
    """The primary chain of a read, judged; None without chains."""
    return next(iter(primaries(strands, read, refs, o)), None)


def primaries(strands, read, refs, o):
    """The primary chains of a read, the first one judged. refs is {(ref, strand): signal}."""
    found, by = read_chains(strands, o), "score"
    if o.least_aligned is not None:
        by, best, kept = "aligned", 0.0, []
        for c in sorted(found, key=lambda c: (-c["score"], c["ref_id"], c["strand"], c["slot"])):
            c["aligned"] = aligned(c["anchors"], read, refs[c["ref_id"], c["strand"]], o, best)
            if c["aligned"] is not None and c["aligned"] >= o.least_aligned:
                best = max(best, c["aligned"])
                kept.append(c)
        found = kept
    for c in found:
        c |= {"t_start": c["anchors"][0][0], "t_end": c["anchors"][-1][0], "q_start": c["anchors"][0][1], "q_end": c["anchors"][-1][1], "n_anchors": len(c["anchors"])}
    found.sort(key=lambda c: (c[by], c["n_anchors"], c["ref_id"], c["strand"], c["t_start"], c["t_end"], c["q_start"], c["q_end"]), reverse=True)
    primary = []
    for c in found:
        if primary and c[by] < primary[-1][by] / 3:
            break
        if not any(p["ref_id"] == c["ref_id"] and max(p["t_start"], c["t_start"]) <= min(p["t_end"], c["t_end"]) for p in primary):
            primary.append(c)
    if primary:
        scores = [c[by] for c in primary]
        sure, mapq = primary[0]["n_anchors"] >= o.least_anchors, 60
        if len(primary) > 1:
            sure = scores[0] / scores[1] >= o.ratio or scores[0] >= o.over_mean * sum(scores) / len(scores)
            mapq = min(60, max(0, int(40 * (1 - scores[1] / scores[0]))))
        primary[0] |= {"n": len(primary), "mapq": mapq, "confident": sure}
    return primary
