"""Arrangements of many small groups at once: the same as `arrangement` by strips, for groups whose edges fit in one row's place.

Groups come sorted, a few shapes each, and are taken together in arrays; nothing of a group leaves its task but one row.
A group with more than SMALL edges, or more than PIECES pieces, is only named, for the strips.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

#: Edges of a group up to which it is arranged in one task, and pieces of it; pairs of either that are held at once.
SMALL, PIECES, PAIRS = 256, 1024, 1_000_000


def spans(cost: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Runs of groups whose costs stay within the limit; one group at least."""
    total, a = np.concatenate([[0], np.cumsum(cost)]), 0
    while a < len(cost):
        b = max(a + 1, int(np.searchsorted(total, total[a] + limit, "right")) - 1)
        yield a, b
        a = b


def numbered(*cols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A number for each row, equal where rows are, and the first row of each number."""
    order = np.lexsort(cols[::-1])
    new = np.ones(len(order), bool)
    new[1:] = np.any([c[order][1:] != c[order][:-1] for c in cols], axis=0)
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(new) - 1
    return out, order[new]


def crossed(n: np.ndarray, m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of all pairs of one of n and one of m rows of each group, rows standing by groups."""
    per = np.repeat(m, n)
    first = np.repeat(np.repeat(np.cumsum(m) - m, n), per)
    return np.repeat(np.arange(n.sum()), per), first + np.arange(per.sum()) - np.repeat(np.cumsum(per) - per, per)


class Edges:
    """Edges of shapes, ordered by groups: group g, ring, ends; of rings their polygon and whether they are holes; of polygons whether they cut."""

    def __init__(self, group: np.ndarray, owner: np.ndarray, role: np.ndarray, points: pa.ListArray, digits: int) -> None:
        sizes = np.asarray(points.value_lengths().fill_null(0))
        row, flat = np.repeat(np.arange(len(sizes)), sizes), points.flatten()
        part, ring, x, y = (np.asarray(flat.field(c)) for c in ("part", "ring", "x", "y"))
        here, starts = numbered(row, part, ring)
        i = np.arange(len(row))
        following = np.minimum(i + 1, max(len(row) - 1, 0))
        following = np.where((here[following] == here) & (following > i), following, starts[here]) if len(i) else i
        keep = (x != x[following]) | (y != y[following])
        e = np.stack([x, y, x[following], y[following]])
        e = np.rint(e * 10**digits) / 10**digits
        keep &= (e[0] != e[2]) | (e[1] != e[3])
        self.ends, row, part, ring = e[:, keep], row[keep], part[keep], ring[keep]
        self.g = group[row]
        self.ring, first = numbered(owner[row], part, ring)
        self.hole = ring[first] > 0
        self.polygon, lead = numbered(owner[row][first], part[first])
        self.cut = role[row][first][lead] != 0


def pieces(g: np.ndarray, ring: np.ndarray, e: np.ndarray, n: np.ndarray, digits: int) -> tuple[np.ndarray, ...]:
    """g, ring, ends, w and times of the pieces of some groups' edges, of which there are n in each."""
    near = 10.0**-digits
    a, b = crossed(n, n)
    a, b = a[a < b], b[a < b]
    low, high = np.minimum(e[1], e[3]), np.maximum(e[1], e[3])
    west, east = np.minimum(e[0], e[2]), np.maximum(e[0], e[2])
    met = (low[a] <= high[b] + near) & (low[b] <= high[a] + near) & (west[a] <= east[b] + near) & (west[b] <= east[a] + near)
    a, b = a[met], b[met]

    def side(o: np.ndarray, d: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """How far an end of d lies to the left of o, times o's length, and whether it lies on o."""
        dx, dy, px, py = e[2][o] - e[0][o], e[3][o] - e[1][o], e[2 * k][d] - e[0][o], e[2 * k + 1][d] - e[1][o]
        s, along = dx * py - dy * px, dx * px + dy * py
        return s, (np.abs(s) <= near * np.sqrt(dx * dx + dy * dy)) & (along >= 0) & (along <= dx * dx + dy * dy)

    (sa0, ta0), (sa1, ta1), (sb0, tb0), (sb1, tb1) = side(a, b, 0), side(a, b, 1), side(b, a, 0), side(b, a, 1)
    over = ~(ta0 | ta1 | tb0 | tb1) & (sa0 * sa1 < 0) & (sb0 * sb1 < 0)
    t = sa0[over] / (sa0[over] - sa1[over])
    p, q = a[over], b[over]
    at = [np.rint((e[c][q] + t * (e[c + 2][q] - e[c][q])) * 10**digits) / 10**digits for c in (0, 1)]
    i = np.arange(len(g))
    edge = np.concatenate([i, i, p, q, a[ta0], a[ta1], b[tb0], b[tb1]])
    x, y = (np.concatenate([e[c], e[c + 2], at[c], at[c], e[c][b[ta0]], e[c + 2][b[ta1]], e[c][a[tb0]], e[c + 2][a[tb1]]]) for c in (0, 1))
    along = (x - e[0][edge]) * (e[2] - e[0])[edge] + (y - e[1][edge]) * (e[3] - e[1])[edge]
    order = np.lexsort((y, x, along, edge))
    edge, x, y = edge[order], x[order], y[order]
    new = np.ones(len(edge), bool)
    new[1:] = (edge[1:] != edge[:-1]) | (x[1:] != x[:-1]) | (y[1:] != y[:-1])
    edge, x, y = edge[new], x[new], y[new]
    run = np.flatnonzero(edge[1:] == edge[:-1])
    ends = np.stack([x[run], y[run], x[run + 1], y[run + 1]])
    right = (ends[0] < ends[2]) | ((ends[0] == ends[2]) & (ends[1] < ends[3]))
    ends = np.where(right, ends, ends[[2, 3, 0, 1]])
    own = edge[run]
    same, first = numbered(g[own], ring[own], *ends)
    w, times = np.bincount(same, np.where(right, 1, -1)).astype(np.int64), np.bincount(same)
    keep = w != 0
    first = first[keep]
    return g[own][first], ring[own][first], ends[:, first], w[keep], times[keep]


def boundary(of: Edges, g: np.ndarray, ring: np.ndarray, e: np.ndarray, w: np.ndarray, inside: Callable) -> tuple[np.ndarray, np.ndarray]:
    """g and ends of the pieces with the inside on one side only, drawn with it on their left."""
    _, place = numbered(g, *e)
    place = place[np.argsort(g[place], kind="stable")]
    pg, pe = g[place], e[:, place]
    mx, my = (pe[0] + pe[2]) / 2, (pe[1] + pe[3]) / 2
    flat = np.flatnonzero(e[0] < e[2])
    top = int(g.max()) + 1
    i, j = crossed(np.bincount(pg, minlength=top), np.bincount(g[flat], minlength=top))
    j = flat[j]
    near = (e[0][j] <= mx[i]) & (mx[i] <= e[2][j])
    i, j = i[near], j[near]
    f = e[:, j]
    same = (f == pe[:, i]).all(axis=0)
    lower = (f[1] + (mx[i] - f[0]) * (f[3] - f[1]) / (f[2] - f[0]) < my[i]) & ~same
    upright = (pe[0] == pe[2])[i]
    right = lower & (mx[i] < f[2])
    left = np.where(upright, lower & (f[0] < mx[i]), same | right)
    keep = lower | same
    i, j, right, left = i[keep], j[keep], right[keep], left[keep]
    wound, first = numbered(i, ring[j])
    on, rings = i[first], ring[j][first]
    polygon = of.polygon[rings]
    owned, lead = numbered(on, polygon)
    sides = []
    for s in (right, left):
        turned = np.bincount(wound, np.where(s, w[j], 0), len(first)) != 0
        hole = of.hole[rings]
        within = (np.bincount(owned, turned & ~hole, len(lead)) > 0) & ~(np.bincount(owned, turned & hole, len(lead)) > 0)
        cut, at = of.cut[polygon[lead]], on[lead]
        sides.append(inside(*(np.bincount(at, within & (cut == c), len(place)) > 0 for c in (False, True))))
    limit = sides[0] != sides[1]
    return pg[limit], np.where(sides[1], pe, pe[[2, 3, 0, 1]])[:, limit]


def arrange(table: pa.Table, group: np.ndarray, n_groups: int, inside: Callable, digits: int, walk: Callable | None, every: bool, limits: tuple[int, int]) -> dict[str, list | np.ndarray]:
    """big, changed, limits, area, length and points of each group."""
    owner, first = numbered(group, np.asarray(table.column("role")), np.unique(table.column("owner").to_pylist(), return_inverse=True)[1])
    of = Edges(group, owner, np.asarray(table.column("role")), table.column("points").combine_chunks(), digits)
    n = np.bincount(of.g, minlength=n_groups)
    big = n > limits[0]
    out = {"changed": np.zeros(n_groups, bool), "limits": np.zeros(n_groups, np.int64), "area": np.zeros(n_groups), "length": np.zeros(n_groups)}
    points: list[list | None] = [None] * n_groups
    starts = np.concatenate([[0], np.cumsum(n)])
    for a, b in spans(np.where(big, 0, n * n), PAIRS):
        mine = np.arange(starts[a], starts[b])
        mine = mine[~big[of.g[mine]]]
        if not len(mine):
            continue
        g, ring, e, w, times = pieces(of.g[mine] - a, of.ring[mine], of.ends[:, mine], np.bincount(of.g[mine] - a, minlength=b - a), digits)
        m = np.bincount(g, minlength=b - a)
        big[a:b] |= m > limits[1]
        drawn = []
        begins = np.concatenate([[0], np.cumsum(m)])
        for c, d in spans(np.where(big[a:b], 0, m * m), PAIRS):
            some = np.arange(begins[c], begins[d])
            some = some[~big[a:b][g[some]]]
            if len(some):
                drawn.append(boundary(of, g[some], ring[some], e[:, some], w[some], inside))
        at, limit = np.concatenate([x for x, _ in drawn] or [np.zeros(0, np.int64)]), np.concatenate([x for _, x in drawn] or [np.zeros((4, 0))], axis=1)
        x0, y0, x1, y1 = limit
        count = np.bincount(at, minlength=b - a)
        out["limits"][a:b] = count
        out["area"][a:b] = np.bincount(at, (x0 * y1 - x1 * y0) / 2, b - a)
        out["length"][a:b] = np.bincount(at, np.sqrt((x1 - x0) ** 2 + (y1 - y0) ** 2), b - a)
        out["changed"][a:b] = (n[a:b] != np.bincount(g, times, b - a)) | (n[a:b] != count)
        if walk:
            order = np.argsort(at, kind="stable")
            rows, ends = list(zip(*limit[:, order].tolist(), strict=True)), np.concatenate([[0], np.cumsum(count)])
            for k in np.flatnonzero((count > 0) & (every | out["changed"][a:b])).tolist():
                points[a + k] = walk(rows[ends[k] : ends[k + 1]])
    return out | {"big": big, "points": points, "none": n == 0}


def stream(batches: Iterator[pa.RecordBatch], inside: Callable, digits: int, walk: Callable | None, every: bool, limits: tuple[int, int]) -> Iterator[pa.RecordBatch]:
    """One row for each group of rows g, role, owner, points, which come sorted by g, role and owner; of a big one its g alone."""
    held: pa.Table | None = None
    over = None  # the group, in a list, whose rows so far were too many to be held
    point = pa.list_(pa.struct([("part", pa.int32()), ("ring", pa.int32()), ("x", pa.float64()), ("y", pa.float64())]))

    def done(table: pa.Table) -> pa.RecordBatch:
        keys = table.column("g").to_pylist()
        new = np.array([True, *(x != y for x, y in zip(keys[1:], keys, strict=False))])
        first = np.flatnonzero(new)
        got = arrange(table, np.cumsum(new) - 1, len(first), inside, digits, walk, every, limits)
        if over is not None and keys[0] == over[0]:
            got["big"][0] = True
        keep = ~got["none"] | got["big"]
        cols = [table.column("g").take(first).combine_chunks(), *(pa.array(got[c]) for c in ("big", "changed", "limits", "area", "length")), pa.array(got["points"], point)]
        batch = pa.RecordBatch.from_arrays(cols, ["g", "big", "changed", "limits", "area", "length", "points"])
        return batch.filter(pa.array(keep))

    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        held = pa.concat_tables([held, table]) if held is not None else table
        keys = held.column("g").to_pylist()
        last = len(keys) - 1
        while last > 0 and keys[last - 1] == keys[-1]:
            last -= 1
        if last:
            yield done(held.slice(0, last))
            over = over if over is not None and over[0] == keys[-1] else None
        held = held.slice(last)
        if sum(x or 0 for x in held.column("points").combine_chunks().value_lengths().to_pylist()) > 4 * limits[0]:
            over, held = [keys[-1]], held.slice(0, 1)
    if held is not None:
        yield done(held)
