"""Overlay of polygon borders: noding, cover counts on both sides of every edge, and rings of what is covered.

Coordinates are snapped to a grain and counted in half grains as integers, so every decision is exact. Input vertices and crossings have
even coordinates; the lines of the work grid have odd ones and never meet a vertex. A ring adds +1 to the cover on its left, so an
outer ring runs anticlockwise and a hole clockwise; pieces may lie in layers that are counted apart.

On tables the plane is cut into cells. A cell needs its own border pieces and one number besides, the cover of its lower left corner,
which a running sum over the crossings of its lower grid line gives. So no task sees more than one cell until the final borders of a
geometry are chained, as that is one value. Many cells, or many small geometries, go through numpy together, side by side in x.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldspark.functions import ring as R
from fieldspark.session import cut_lineage, spread

#: About a millionth of a unit, and a power of two: halves, quarters and so on stay as they are.
GRAIN = 2.0**-20
PARTS_SQL = "array<array<array<struct<x:double,y:double>>>>"
#: Rows, or edge pieces of cells, that go through numpy together, about.
TOGETHER, EDGES_TOGETHER = 512, 8192
#: Corners of a key that is closed in one task, and such keys that go through numpy together.
FEW, KEYS_TOGETHER = 256, 128
#: Corners of a full circle.
CORNERS = 16

#: Exact products need extents of at most so many grains.
EXTENT = 2**27

Inside = Callable[[np.ndarray], np.ndarray]


def grain_for(extent: float, grain: float = GRAIN) -> float:
    """The given grain, or the smallest coarser power of two for which an extent stays exact."""
    return max(grain, 2.0 ** math.ceil(math.log2(extent / EXTENT))) if extent > 0 else grain


def covered(cover: np.ndarray) -> np.ndarray:
    """In some piece of the first layer and in none of the second."""
    inside = cover[:, 0] > 0
    return inside & (cover[:, 1] <= 0) if cover.shape[1] > 1 else inside


def odd(cover: np.ndarray) -> np.ndarray:
    """Even-odd rule over all borders."""
    return cover.sum(1) % 2 != 0


# --- one arrangement ------------------------------------------------------------------------------------------------------------------


def merged_edges(edges: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each edge once, from its smaller end to its larger one, with the sum of its weights by that direction."""
    return _merged(edges, weight, np.zeros(len(edges), bool))[:2]


def _merged(edges: np.ndarray, weight: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``merged_edges``, and which of them are equal to a known one."""
    turn = (edges[:, 0] > edges[:, 2]) | ((edges[:, 0] == edges[:, 2]) & (edges[:, 1] > edges[:, 3]))
    edges = np.where(turn[:, None], edges[:, [2, 3, 0, 1]], edges)
    weight = np.where(turn[:, None], -weight, weight)
    real = np.flatnonzero((edges[:, :2] != edges[:, 2:]).any(1))
    order = real[np.lexsort(edges[real].T[::-1])]
    edges = edges[order]
    new = np.ones(len(edges), bool)
    new[1:] = (edges[1:] != edges[:-1]).any(1)
    first = np.flatnonzero(new)
    if not len(first):
        return edges, weight[:0], known[:0]
    return edges[first], np.add.reduceat(weight[order], first), np.logical_or.reduceat(known[order], first)


def _meeting_boxes(edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of edges whose boxes touch: a sweep over the left sides."""
    lo, hi = np.minimum(edges[:, :2], edges[:, 2:]), np.maximum(edges[:, :2], edges[:, 2:])
    order = np.argsort(lo[:, 0], kind="stable")
    upto = np.searchsorted(lo[order, 0], hi[order, 0], "right")
    firsts, seconds = [], []
    n = upto - np.arange(len(order)) - 1
    for begin in range(0, len(order), 4096):  # some edges at a time: the sweep's pairs before the test of heights
        some = np.arange(begin, min(begin + 4096, len(order)))
        i = np.repeat(some, n[some])
        j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(n[some]) - n[some], n[some])
        i, j = order[i], order[j]
        touch = (lo[i, 1] <= hi[j, 1]) & (lo[j, 1] <= hi[i, 1])
        firsts.append(i[touch])
        seconds.append(j[touch])
    return (np.concatenate(firsts), np.concatenate(seconds)) if firsts else (np.zeros(0, int), np.zeros(0, int))


def _side(e: np.ndarray, p: np.ndarray) -> np.ndarray:
    return (e[:, 2] - e[:, 0]) * (p[:, 1] - e[:, 1]) - (e[:, 3] - e[:, 1]) * (p[:, 0] - e[:, 0])


def _reach(e: np.ndarray) -> np.ndarray:
    """The largest ``_side`` of points less than half a grain from the edge (so never an odd one beside an even line)."""
    return 0.75 * np.sqrt(((e[:, 2:] - e[:, :2]) ** 2).sum(1).astype(np.float64))


def _on(e: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Points that are not an end of the edge, lie between its ends and less than half a grain from it."""
    out = np.zeros(len(e), bool)
    out[_places_on(e, p, _side(e, p), _reach(e))] = True
    return out


def _places_on(e: np.ndarray, p: np.ndarray, side: np.ndarray, reach: np.ndarray) -> np.ndarray:
    """Where the points are ``_on`` the edges."""
    near = np.flatnonzero(np.abs(side).astype(np.float64) < reach)
    e, p = e[near], p[near]
    d = e[:, 2:] - e[:, :2]
    along = ((p - e[:, :2]) * d).sum(1)
    return near[(along > 0) & (along < (d * d).sum(1)) & (p != e[:, :2]).any(1) & (p != e[:, 2:]).any(1)]


def node(edges: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Cuts all edges where they meet, so that two edges share nothing but ends; equal ones are merged."""
    edges, weight = merged_edges(edges, weight)
    fresh = np.ones(len(edges), bool)  # two edges that met before and stayed whole do not cut each other
    for _ in range(40):
        i, j = _meeting_boxes(edges)
        some = fresh[i] | fresh[j]
        i, j = i[some], j[some]
        a, b = edges[i], edges[j]
        reach = _reach(edges)
        sides = [_side(a, b[:, :2]), _side(a, b[:, 2:]), _side(b, a[:, :2]), _side(b, a[:, 2:])]
        cut_edge, cut_at = [], []
        for k, (one, e, other) in enumerate(((i, a, b), (i, a, b), (j, b, a), (j, b, a))):
            ends = other[:, 2:] if k % 2 else other[:, :2]
            on = _places_on(e, ends, sides[k], reach[one])
            cut_edge.append(one[on])
            cut_at.append(ends[on])
        cross = (np.sign(sides[0]) * np.sign(sides[1]) < 0) & (np.sign(sides[2]) * np.sign(sides[3]) < 0)
        if cross.any():
            s, t = sides[2][cross].astype(np.float64), sides[3][cross].astype(np.float64)
            share = (s / (s - t))[:, None]
            at = a[cross][:, :2] + share * (a[cross][:, 2:] - a[cross][:, :2])
            at = (2 * np.round(at / 2)).astype(np.int64)
            for k in (i[cross], j[cross]):
                keep = (at != edges[k][:, :2]).any(1) & (at != edges[k][:, 2:]).any(1)
                cut_edge.append(k[keep])
                cut_at.append(at[keep])
        k, at = np.concatenate(cut_edge), np.concatenate(cut_at)
        if not len(k):
            return edges, weight
        whole = np.ones(len(edges), bool)
        whole[k] = False
        along = ((at - edges[k][:, :2]) * (edges[k][:, 2:] - edges[k][:, :2])).sum(1)
        cut = np.unique(k)
        chain_edge = np.concatenate([cut, k, cut])
        chain_at = np.concatenate([edges[cut][:, :2], at, edges[cut][:, 2:]])
        chain_along = np.concatenate([np.full(len(cut), np.iinfo(np.int64).min), along, np.full(len(cut), np.iinfo(np.int64).max)])
        order = np.lexsort((chain_along, chain_edge))
        chain_edge, chain_at = chain_edge[order], chain_at[order]
        same = chain_edge[1:] == chain_edge[:-1]
        new = np.hstack([chain_at[:-1][same], chain_at[1:][same]])
        known = np.repeat([True, False], [whole.sum(), len(new)])
        edges, weight, known = _merged(np.vstack([edges[whole], new]), np.vstack([weight[whole], weight[chain_edge[:-1][same]]]), known)
        fresh = ~known
    raise RuntimeError("edges did not settle")


def covers(
    edges: np.ndarray, weight: np.ndarray, lane: int | None = None, base: np.ndarray | None = None
) -> tuple[np.ndarray, np.ndarray]:
    """Cover on the left and on the right of each noded edge.

    A ray goes down from the middle of each edge. Cells stand side by side, each in a lane of width ``lane`` with its lower left corner at (1, 1); there
    the ray goes on along the lower side to that corner, where the cover is ``base`` (lanes x layers).
    """
    layers = weight.shape[1]
    right = np.zeros((len(edges), layers), np.int64)
    home = edges[:, 0] // lane if lane is not None else None
    if base is not None:
        right += base[home]
    twice = 2 * edges
    upright = edges[:, 0] == edges[:, 2]
    mid = edges[:, :2] + edges[:, 2:]  # in doubled coordinates
    flat = np.flatnonzero(~upright)
    floor = [(end, np.flatnonzero(edges[:, end + 1] == 1)) for end in (0, 2)] if base is not None else []
    order = np.argsort(mid[:, 0], kind="stable")
    low, high = twice[flat, 0], twice[flat, 2]
    for begin in range(0, len(order), 256):
        e = order[begin : begin + 256]
        f = flat[(low <= mid[e[-1], 0]) & (high >= mid[e[0], 0])]
        x, y, up = mid[e, 0][:, None], mid[e, 1][:, None], upright[e][:, None]
        # beside an upright edge the ray starts on its left, else a trifle right of the middle
        spans = np.where(up, (twice[f, 0] < x) & (x <= twice[f, 2]), (twice[f, 0] <= x) & (x < twice[f, 2]))
        k, m = np.nonzero(spans)
        g = f[m]
        above = (twice[g, 2] - twice[g, 0]) * (mid[e[k], 1] - twice[g, 1]) - (twice[g, 3] - twice[g, 1]) * (mid[e[k], 0] - twice[g, 0]) > 0
        np.add.at(right, e[k[above]], weight[g[above]])
        for end, own in floor:  # eastward over an edge that rises from the lower side, or falls to it
            g = own[(home[own] >= home[e].min()) & (home[own] <= home[e].max())]
            if len(g):
                passed = np.where(up, twice[g, end] < x, twice[g, end] <= x) & (home[g] == home[e][:, None])
                right[e] += (1 if end else -1) * (passed.astype(np.int64) @ weight[g])
    left = right + weight
    # beside an upright edge the ray gave the cover on its left
    return np.where(upright[:, None], right, left), np.where(upright[:, None], right - weight, right)


def border_edges(edges: np.ndarray, weight: np.ndarray, inside: Inside = covered, lane: int | None = None, base: np.ndarray | None = None) -> np.ndarray:
    """The edges with the inside on one side only, that on their left."""
    edges, weight = node(edges, weight)
    if not len(edges):
        return edges
    left, right = (inside(c) for c in covers(edges, weight, lane, base))
    keep = left != right
    return np.where(left[keep][:, None], edges[keep], edges[keep][:, [2, 3, 0, 1]])


def chain_rings(edges: np.ndarray) -> tuple[list[np.ndarray], int]:
    """Rings without repeated vertices from border edges, and the number of edges that close none.

    Where several borders meet, the walk turns sharply left and so stays with its part; a vertex that comes again closes a ring.
    """
    ends = [((a, b), (c, d)) for a, b, c, d in edges.tolist()]
    leaving: dict[tuple[int, int], list[int]] = {}
    for k, (a, _) in enumerate(ends):
        leaving.setdefault(a, []).append(k)
    used = [False] * len(ends)
    rings, opened = [], 0

    def leftmost(k: int, options: list[int]) -> int:
        (ax, ay), (bx, by) = ends[k]
        heading = math.atan2(by - ay, bx - ax)
        return max(options, key=lambda m: (math.atan2(ends[m][1][1] - by, ends[m][1][0] - bx) - heading + math.pi) % (2 * math.pi))

    for start in range(len(ends)):
        path: list[tuple[int, int]] = []
        place: dict[tuple[int, int], int] = {}
        k = None if used[start] else start
        while k is not None:
            used[k] = True
            a, b = ends[k]
            place[a] = len(path)
            path.append(a)
            if b in place:
                ring = path[place[b] :]
                rings.append(np.array(ring, np.int64))
                del path[place[b] :]
                for p in ring:
                    del place[p]
                if not path:
                    break
            options = [m for m in leaving.get(b, ()) if not used[m]]
            k = leftmost(k, options) if len(options) > 1 else options[0] if options else None
        opened += len(path)
    return rings, opened


def ring_area(ring: np.ndarray) -> float:
    p = (ring - ring[0]).astype(np.float64)
    q = np.roll(p, -1, axis=0)
    return float((p[:, 0] * q[:, 1] - p[:, 1] * q[:, 0]).sum() / 2)


def tidy(ring: np.ndarray) -> np.ndarray:
    """Without vertices on the lines of the work grid, which are odd, and without those in the middle of a straight side."""
    ring = ring[(ring % 2 == 0).all(1)]
    while len(ring) >= 3:
        a, b = ring - np.roll(ring, 1, axis=0), np.roll(ring, -1, axis=0) - ring
        keep = a[:, 0] * b[:, 1] - a[:, 1] * b[:, 0] != 0
        if keep.all():
            break
        # neighbours are judged again, so only every other one goes at a time
        drop = ~keep
        drop[1:] &= ~drop[:-1]
        ring = ring[~drop]
    return ring


def assemble(rings: list[np.ndarray]) -> list[list[np.ndarray]]:
    """Parts, largest first: an outer ring and the holes in it."""
    rings = [r for r in map(tidy, rings) if len(r) >= 3]
    areas = [ring_area(r) for r in rings]
    outer = sorted((k for k, a in enumerate(areas) if a > 0), key=lambda k: -areas[k])
    parts = {k: [rings[k]] for k in outer}
    boxes = {k: (rings[k].min(0), rings[k].max(0)) for k in outer}
    for k, a in enumerate(areas):
        if a < 0:
            mid = rings[k][0] + rings[k][1]  # doubled
            # the smallest outer ring around it
            home = next((o for o in reversed(outer) if areas[o] >= -a and (2 * boxes[o][0] <= mid).all() and (mid <= 2 * boxes[o][1]).all() and _holds(2 * rings[o], mid)), None)
            if home is not None:
                parts[home].append(rings[k])
    return list(parts.values())


def _holds(ring: np.ndarray, p: np.ndarray) -> bool:
    a, b = ring, np.roll(ring, -1, axis=0)
    spans = (a[:, 1] > p[1]) != (b[:, 1] > p[1])
    side = (b[:, 0] - a[:, 0]) * (p[1] - a[:, 1]) - (b[:, 1] - a[:, 1]) * (p[0] - a[:, 0])
    return bool((spans & ((side > 0) == (b[:, 1] > a[:, 1]))).sum() % 2)


# --- floats in and out ----------------------------------------------------------------------------------------------------------------


def snapped(ring, grain: float = GRAIN) -> np.ndarray:
    """Even integers; ``ring`` is a list of points with x and y."""
    p = np.array([(v["x"], v["y"]) for v in ring], np.float64).reshape(-1, 2)
    return (2 * np.round(p / grain)).astype(np.int64)


def ring_edges(ring: np.ndarray) -> np.ndarray:
    return np.hstack([ring, np.roll(ring, -1, axis=0)]) if len(ring) else np.zeros((0, 4), np.int64)


def as_points(ring: np.ndarray, grain: float = GRAIN) -> list[dict]:
    return [{"x": x, "y": y} for x, y in (ring * (grain / 2)).tolist()]


def turned(rings: list[np.ndarray]) -> list[np.ndarray]:
    """First ring anticlockwise, the others clockwise."""
    return [r[::-1] if len(r) >= 3 and (ring_area(r) < 0) == (not k) else r for k, r in enumerate(rings)]


def overlay_many(rows: list[list[tuple[list, int]]], inside: Inside = covered) -> list[list[list[np.ndarray]]]:
    """Parts of what the pieces of each row cover, in one task; a piece is (its rings as integer arrays, its layer)."""
    layers = 1 + max((layer for pieces in rows for _, layer in pieces), default=0)
    edges = [(ring_edges(r), layer, k) for k, pieces in enumerate(rows) for rings, layer in pieces for r in rings if len(r) > 2]
    if not edges:
        return [[] for _ in rows]
    of = np.repeat([k for *_, k in edges], [len(e) for e, *_ in edges])
    weight = np.eye(layers, dtype=np.int64)[np.repeat([layer for _, layer, _ in edges], [len(e) for e, *_ in edges])]
    return _parts_of(np.vstack([e for e, *_ in edges]), of, weight, len(rows), inside)


def _parts_of(every: np.ndarray, of: np.ndarray, weight: np.ndarray, rows: int, inside: Inside = covered) -> list[list[list[np.ndarray]]]:
    """Parts for each row from the edges of closed rings; ``of`` is the row of each edge. Rows stand side by side in x."""
    origin = np.full((rows, 2), np.iinfo(np.int64).max)
    np.minimum.at(origin, of, every[:, :2])  # ring edges begin at every vertex
    local = every - np.tile(origin[of], 2)
    lane = int(local.max()) + 2
    local[:, [0, 2]] += (of * lane)[:, None]
    found: list[list] = [[] for _ in range(rows)]
    for r in chain_rings(border_edges(local, weight, inside))[0]:
        k = int(r[0, 0]) // lane
        found[k].append(r - [k * lane, 0] + origin[k])
    return [assemble(rings) for rings in found]


def overlay(pieces: list[tuple[list, int]], inside: Inside = covered) -> list[list[np.ndarray]]:
    return overlay_many([pieces], inside)[0]


def parts_area(parts: list[list[np.ndarray]], grain: float = GRAIN) -> float:
    return sum(ring_area(r) for part in parts for r in part) * (grain / 2) ** 2


# --- tables ---------------------------------------------------------------------------------------------------------------------------


def _schema(df: DataFrame, extra: str) -> str:
    return ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields), extra])


def _boxed(rings: Column | str) -> Column:
    """Each ring in a struct: rings of unequal length do not come to Python as one array of arrays."""
    return F.transform(rings, lambda r: F.struct(r.alias("r")))


def repair(polygons: DataFrame, ring: str = "ring", grain: float = GRAIN) -> DataFrame:
    """Valid geometry of any ring by the even-odd rule: adds ``parts`` (largest first, holes after their outer ring), ``area`` and ``n_parts``.

    Self-crossings become vertices, sides that go and come back vanish, a loop inside another becomes a hole. A null ring, or one that encloses
    nothing, gives no parts.
    """
    rest = [c for c in polygons.columns if c not in (ring, "parts", "area", "n_parts")]

    def grain_of(r) -> float:
        x, y = [v["x"] for v in r], [v["y"] for v in r]
        return grain_for(max(max(x) - min(x), max(y) - min(y)), grain)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for whole in batches:
            for begin in range(0, len(whole), TOGETHER):
                pdf = whole.iloc[begin : begin + TOGETHER]
                rings = [r if r is not None and len(r) > 2 else [] for r in pdf[ring]]
                grains = [grain_of(r) if len(r) else grain for r in rings]
                found = overlay_many([[([snapped(r, g)], 0)] if len(r) else [] for r, g in zip(rings, grains)], odd)
                yield pdf[rest].assign(
                    parts=[[[as_points(q, g) for q in part] for part in parts] for parts, g in zip(found, grains)],
                    area=[parts_area(parts, g) for parts, g in zip(found, grains)], n_parts=[len(parts) for parts in found],
                )

    return polygons.select(*rest, ring).mapInPandas(run, _schema(polygons.select(*rest), f"parts {PARTS_SQL}, area double, n_parts int"))


def _shift(step: int) -> int:
    """Where grid line 0 lies: odd, and away from round numbers."""
    return 2 * round(0.19098 * step) + 1


def _cuts(edges: np.ndarray, axis: int, step: int) -> tuple[np.ndarray, np.ndarray]:
    """Which edge crosses which grid line of an axis; line k lies at k * step + shift."""
    shift = _shift(step)
    lo = np.minimum(edges[:, axis], edges[:, axis + 2])
    hi = np.maximum(edges[:, axis], edges[:, axis + 2])
    first, last = -(-(lo - shift) // step), (hi - shift) // step
    n = np.maximum(0, last - first + 1)
    who = np.repeat(np.arange(len(edges)), n)
    return who, first[who] + np.arange(len(who)) - np.repeat(np.cumsum(n) - n, n)


def _even(v: np.ndarray) -> np.ndarray:
    return (2 * np.round(v / 2)).astype(np.int64)


def cell_fragments(edges: np.ndarray, step: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(fragments, edge of each, cell of each, events): edges cut at the grid lines, and where they cross lower sides of cells.

    Events are rows (edge, cell column, cell row, sign): what the cover gains eastward at that crossing.
    """
    who_x, line_x = _cuts(edges, 0, step)
    who_y, line_y = _cuts(edges, 1, step)
    d = (edges[:, 2:] - edges[:, :2]).astype(np.float64)

    def crossing(who, value, axis):
        e = edges[who]
        share = (value - e[:, axis]) / d[who, axis]
        other = _even(e[:, 1 - axis] + share * d[who, 1 - axis])
        return np.column_stack([value, other] if axis == 0 else [other, value]), share

    shift = _shift(step)
    at_x, share_x = crossing(who_x, line_x * step + shift, 0)
    at_y, share_y = crossing(who_y, line_y * step + shift, 1)
    n = len(edges)
    who = np.concatenate([np.arange(n), who_x, who_y, np.arange(n)])
    at = np.vstack([edges[:, :2], at_x, at_y, edges[:, 2:]])
    # by place along the edge; of two crossings at almost the same place the coordinates tell which comes first
    forward = np.sign(edges[:, 2:] - edges[:, :2])
    along = (at * forward[who]).sum(1)
    share = np.concatenate([np.zeros(n), share_x, share_y, np.ones(n)])
    rank = np.concatenate([np.full(n, -1), np.zeros(len(who_x) + len(who_y)), np.full(n, 1)])
    order = np.lexsort((share, along, rank, who))
    who, at = who[order], at[order]
    same = who[1:] == who[:-1]
    pieces = np.hstack([at[:-1][same], at[1:][same]])
    owner = who[:-1][same]
    cell = (np.minimum(pieces[:, :2], pieces[:, 2:]) - shift) // step
    events = np.column_stack([who_y, (at_y[:, 0] - shift) // step, line_y, -np.sign(d[who_y, 1]).astype(np.int64)])
    return pieces, owner, cell, events


def _groups_of(cell: np.ndarray, n: int) -> list[tuple[int, int]]:
    """Stretches of about n rows that do not part equal neighbours."""
    if not len(cell):
        return []
    ends = np.concatenate((np.flatnonzero(cell[1:] != cell[:-1]) + 1, [len(cell)]))
    cuts = [0]
    while cuts[-1] < len(cell):
        cuts.append(int(ends[min(np.searchsorted(ends, cuts[-1] + n), len(ends) - 1)]))
    return list(zip(cuts, cuts[1:]))


def dissolve(
    pieces: DataFrame, keys: list[str], cell: float, inside: Inside = covered, layers: int = 1, grain: float = GRAIN,
) -> DataFrame:
    """Union per key of pieces that may overlap, touch or repeat: keys, ``parts``, ``area``, ``n_parts``, ``n_open``.

    ``pieces``: keys, ``rings`` (outer ring and holes, in any direction) and, for several layers, ``layer``. ``inside`` says from the covers of
    the layers what is kept. ``cell`` should hold some hundred edges of one key. ``n_open`` counts border edges that close no ring: 0.

    Equal edge pieces are added up before they meet, so repeated pieces, and borders that two pieces share, cost one row or none.
    """
    grain = grain_for(cell, grain)
    step = 2 * max(1, round(cell / grain))
    pieces = spread(pieces.select(*keys, _boxed("rings").alias("rings"), F.col("layer") if layers > 1 else F.lit(0).alias("layer")))
    names = [*keys, "layer", "row", "col", "event", "ax", "ay", "bx", "by", "w"]
    kind = _schema(pieces.select(*keys), "layer int, row long, col long, event boolean, ax long, ay long, bx long, by long, w long")

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rings = [[snapped(r["r"], grain) for r in own if r["r"] is not None] if own is not None else [] for own in pdf["rings"]]
            edges = [np.vstack([np.zeros((0, 4), np.int64), *(ring_edges(r) for r in turned(own) if len(r) > 2)]) for own in rings]
            of = np.repeat(np.arange(len(pdf)), [len(e) for e in edges])
            every = np.vstack([np.zeros((0, 4), np.int64), *edges])
            real = (every[:, :2] != every[:, 2:]).any(1)
            every, of = every[real], of[real]
            part, owner, at, events = cell_fragments(every, step)
            turn = (part[:, 0] > part[:, 2]) | ((part[:, 0] == part[:, 2]) & (part[:, 1] > part[:, 3]))
            part = np.where(turn[:, None], part[:, [2, 3, 0, 1]], part)
            of_part = np.column_stack([at[:, 1], at[:, 0], np.zeros(len(part), np.int64), part, np.where(turn, -1, 1)])
            of_event = np.column_stack([events[:, 2], events[:, 1], np.ones(len(events), np.int64), np.zeros((len(events), 4), np.int64), events[:, 3]])
            out = pdf[[*keys, "layer"]].iloc[np.concatenate([of[owner], of[events[:, 0]]])].reset_index(drop=True)
            for name, column in zip(names[len(keys) + 1 :], np.vstack([of_part, of_event]).T):
                out[name] = column.astype(bool) if name == "event" else column
            yield out[names]

    sums = [F.sum(F.when(F.col("layer") == k, F.col("w")).otherwise(0)).alias(f"w{k}") for k in range(layers)]
    fragments = pieces.mapInPandas(cut, kind).groupBy(*keys, "row", "col", "event", "ax", "ay", "bx", "by").agg(*sums)
    # the cover of a cell's lower left corner: what the crossings of its lower grid line farther west add up to
    west = Window.partitionBy(*keys, "row").orderBy("col").rangeBetween(Window.unboundedPreceding, -1)
    gained = {f"base{k}": F.coalesce(F.sum(F.when(F.col("event"), F.col(f"w{k}")).otherwise(0)).over(west), F.lit(0)) for k in range(layers)}
    some = F.lit(False)
    for k in range(layers):
        some = some | (F.col(f"w{k}") != 0)
    kept = fragments.withColumns(gained).where(~F.col("event") & some).drop("event")

    lane = 2 * step
    w, g = [f"w{k}" for k in range(layers)], [f"base{k}" for k in range(layers)]

    def border(pdf: pd.DataFrame) -> pd.DataFrame:
        """Cells side by side; the rows of each follow each other."""
        cell = pdf["_cell"].to_numpy()
        first = np.flatnonzero(np.concatenate(([True], cell[1:] != cell[:-1])))
        of = np.repeat(np.arange(len(first)), np.diff(np.concatenate((first, [len(cell)]))))
        corner = pdf[["col", "row"]].to_numpy(np.int64)[first] * step + _shift(step) - 1  # at (1, 1) of the lane then
        edges = pdf[["ax", "ay", "bx", "by"]].to_numpy(np.int64) - np.tile(corner[of], 2)
        edges[:, [0, 2]] += (of * lane)[:, None]
        out = border_edges(edges, pdf[w].to_numpy(np.int64), inside, lane, pdf[g].to_numpy(np.int64)[first])
        home = np.minimum(out[:, 0], out[:, 2]) // lane
        out = out + np.tile(corner[home], 2)
        out[:, [0, 2]] -= (home * lane)[:, None]
        frame = pd.DataFrame(out, columns=["ax", "ay", "bx", "by"])
        for at, c in enumerate(keys):
            frame.insert(at, c, pd.Series(pdf[c].to_numpy()[first[home]], dtype=object))
        return frame

    def borders_of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        for pdf in batches:
            held.append(pdf)
            if sum(map(len, held)) < EDGES_TOGETHER:
                continue
            whole = pd.concat(held, ignore_index=True)
            cell = whole["_cell"].to_numpy()
            full = int(np.flatnonzero(cell != cell[-1])[-1]) + 1 if cell[0] != cell[-1] else 0  # the last cell may go on
            for lo, hi in _groups_of(cell[:full], EDGES_TOGETHER):
                yield border(whole.iloc[lo:hi])
            held = [whole.iloc[full:]]
        if held and sum(map(len, held)):
            whole = pd.concat(held, ignore_index=True)
            for lo, hi in _groups_of(whole["_cell"].to_numpy(), EDGES_TOGETHER):
                yield border(whole.iloc[lo:hi])

    key_kind = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.select(*keys).schema.fields)
    tasks = int(pieces.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cells = kept.withColumn("_cell", F.xxhash64(*keys, "row", "col")).repartition(tasks, "_cell").sortWithinPartitions("_cell")
    borders = cells.mapInPandas(borders_of, f"{key_kind}, ax long, ay long, bx long, by long")

    def chained(edges: np.ndarray) -> dict:
        rings, opened = chain_rings(edges)
        parts = assemble(rings)
        return {"parts": [[as_points(r, grain) for r in part] for part in parts], "area": parts_area(parts, grain), "n_parts": len(parts), "n_open": opened}

    return each_key(borders, keys, ["ax", "ay", "bx", "by"], chained, f"parts {PARTS_SQL}, area double, n_parts int, n_open int")


def each_key(rows: DataFrame, keys: list[str], values: list[str], make: Callable[[np.ndarray], dict], extra: str) -> DataFrame:
    """One row per key from the numbers of its rows. The rows of many keys come as one batch, since a frame for each of millions of small keys costs more
    than its work; and the keys are dealt out to all tasks, however few bytes they have."""
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.select(*keys, *values).repartition(tasks, *keys).sortWithinPartitions(*keys)

    def starts(pdf: pd.DataFrame) -> np.ndarray:
        new = np.zeros(len(pdf), bool)
        new[:1] = True
        for k in keys:
            code = pd.factorize(pdf[k], use_na_sentinel=False)[0]
            new[1:] |= code[1:] != code[:-1]
        return np.flatnonzero(new)

    def made(pdf: pd.DataFrame, first: np.ndarray, end: int) -> pd.DataFrame:
        numbers = pdf[values].to_numpy()
        out = [make(numbers[lo:hi]) for lo, hi in zip(first, [*first[1:], end])]
        frame = pdf[keys].iloc[first].reset_index(drop=True)
        for name in out[0]:
            frame[name] = [row[name] for row in out]
        return frame

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        for pdf in batches:
            if not len(pdf):
                continue
            # a key that fills whole batches is joined once, at its end
            if held and len(starts(pd.concat([held[-1].iloc[-1:], pdf], ignore_index=True))) == 1:
                held.append(pdf)
                continue
            whole = pd.concat([*held, pdf], ignore_index=True) if held else pdf
            first = starts(whole)
            if len(first) > 1:
                yield made(whole, first[:-1], int(first[-1]))
            held = [whole.iloc[first[-1] :]]  # the last key may go on
        if held:
            whole = pd.concat(held, ignore_index=True)
            yield made(whole, starts(whole), len(whole))

    kind = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*keys).schema.fields)
    return dealt.mapInPandas(run, f"{kind}, {extra}")


# --- growing and closing --------------------------------------------------------------------------------------------------------------


def zones(a: np.ndarray, b: np.ndarray, c: np.ndarray, radius: float, inner: bool = False, corners: int = CORNERS) -> list[tuple[np.ndarray, np.ndarray]]:
    """All points up to ``radius`` from edges a-b that are followed by b-c, as anticlockwise rings: (edge of each ring, rings x corners x 2), by number of corners.

    Along an edge goes a strip with pointed ends, at a turn a wedge whose arc has chords of at most a ``corners``-th of a circle; pieces overlap, so rounding
    opens nothing between them. ``inner`` gives only what lies on the left of rings with their inside there.
    """
    d, d2 = b - a, c - b
    u, u2 = d / np.hypot(*d.T)[:, None], d2 / np.hypot(*d2.T)[:, None]
    left, ahead = np.column_stack([-u[:, 1], u[:, 0]]) * radius, u * radius / 2
    if inner:
        strip = [a, b, b + left / 2 + ahead, b + left, a + left, a + left / 2 - ahead]
    else:
        strip = [a - left, b - left, b + ahead, b + left, a + left, a - ahead]
    out = [(np.arange(len(a)), np.stack(strip, 1))]
    turn = np.arctan2(u[:, 0] * u2[:, 1] - u[:, 1] * u2[:, 0], (u * u2).sum(1))
    chords = np.maximum(1, np.ceil(np.abs(turn) * corners / (2 * math.pi) - 1e-9)).astype(int)
    chords[(turn >= 0) if inner else (turn == 0)] = 0
    for n in np.unique(chords[chords > 0]):
        at = np.flatnonzero(chords == n)
        side = np.where(turn[at] > 0, -1.0, 1.0)[:, None]  # the outside of the turn
        first, last = left[at] * side, np.column_stack([-u2[at, 1], u2[at, 0]]) * radius * side
        angle = np.arctan2(first[:, 1], first[:, 0])[:, None] + turn[at][:, None] * np.arange(1, n) / n
        arc = np.stack([np.cos(angle), np.sin(angle)], 2) * radius
        half = np.arctan2(first[:, 1], first[:, 0]) + turn[at] / 2
        back = -np.column_stack([np.cos(half), np.sin(half)]) * radius / 2
        wedge = b[at][:, None] + np.concatenate([back[:, None], first[:, None], arc, last[:, None]], 1)
        out.append((at, np.where((turn[at] > 0)[:, None, None], wedge, wedge[:, ::-1])))
    return out


def border_zones(pieces: DataFrame, keys: list[str], radius: float, inner: bool = False, corners: int = CORNERS) -> DataFrame:
    """keys, rings: convex rings around the edges of each ring, or what they hold of the inside."""
    turning = F.transform(F.col("rings"), lambda r, i: F.when((R.signed_area(r) < 0) == (i == 0), F.reverse(r)).otherwise(r))
    rings = pieces.select(*keys, F.explode(turning if inner else F.col("rings")).alias("ring"))
    real = rings.select(*keys, F.filter(R.edges(F.col("ring")), lambda e: e["a"] != e["b"]).alias("es"))
    ahead = F.concat(F.slice("es", 2, F.greatest(F.size("es") - 1, F.lit(0))), F.slice("es", 1, 1))
    edges = real.select(*keys, F.explode(F.zip_with("es", ahead, lambda e, f: F.struct(e["a"].alias("a"), e["b"].alias("b"), f["b"].alias("c")))).alias("e"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if not len(pdf):
                continue
            for at, made in zones(*(pdf[[p + "x", p + "y"]].to_numpy(float) for p in "abc"), radius, inner, corners):
                yield pdf[keys].iloc[at].assign(rings=[[[{"x": x, "y": y} for x, y in z]] for z in made.tolist()])

    slim = edges.select(*keys, *[F.col(f"e.{p}.{v}").alias(p + v) for p in "abc" for v in "xy"])
    return spread(slim).mapInPandas(run, _schema(pieces.select(*keys), "rings array<array<struct<x:double,y:double>>>"))


def grow(pieces: DataFrame, keys: list[str], radius: float, cell: float, grain: float = GRAIN) -> DataFrame:
    """Everything up to ``radius`` from the union of the pieces, per key; round corners are chords of ``CORNERS`` per circle."""
    return dissolve(pieces.select(*keys, "rings").union(border_zones(pieces, keys, radius)), keys, cell, grain=grain)


def shrink(pieces: DataFrame, keys: list[str], radius: float, cell: float, grain: float = GRAIN) -> DataFrame:
    """What lies farther than ``radius`` from the outside. ``pieces`` must not overlap."""
    both = pieces.select(*keys, "rings", F.lit(0).alias("layer")).union(border_zones(pieces, keys, radius, True).select(*keys, "rings", F.lit(1).alias("layer")))
    return dissolve(both, keys, cell, layers=2, grain=grain)


def _zone_edges(rings: list[np.ndarray], of: np.ndarray, radius: float, inner: bool) -> tuple[np.ndarray, np.ndarray]:
    """Edges of the zones of integer rings without repeated vertices, and the row of each; ``of`` is the row of each ring."""
    a, b, c = (np.vstack([np.roll(r, -k, axis=0) for r in rings]).astype(np.float64) for k in range(3))
    home = np.repeat(of, [len(r) for r in rings])
    edges, owner = [], []
    for at, made in zones(a, b, c, radius, inner):
        z = _even(made)
        edges.append(np.concatenate([z, np.roll(z, -1, axis=1)], 2).reshape(-1, 4))
        owner.append(np.repeat(home[at], made.shape[1]))
    return np.vstack(edges), np.concatenate(owner)


def _distinct(ring: np.ndarray) -> np.ndarray:
    return ring[(ring != np.roll(ring, 1, axis=0)).any(1)] if len(ring) else ring


def closed_many(rows: list[list[np.ndarray]], radius: float) -> list[list[list[np.ndarray]]]:
    """Parts of the pieces of each row grown and shrunk by ``radius`` half grains, in one task; a piece is one integer ring."""
    rings = [(r, k) for k, own in enumerate(rows) for r in map(_distinct, own) if len(r) > 2]
    if not rings:
        return [[] for _ in rows]
    of = np.array([k for _, k in rings])
    zone, home = _zone_edges([r for r, _ in rings], of, radius, False)
    every = np.vstack([*(ring_edges(turned([r])[0]) for r, _ in rings), zone])
    grown = _parts_of(every, np.concatenate([np.repeat(of, [len(r) for r, _ in rings]), home]), np.ones((len(every), 1), np.int64), len(rows))
    rings = [(r, k) for k, parts in enumerate(grown) for part in parts for r in part]
    of = np.array([k for _, k in rings])
    zone, home = _zone_edges([r for r, _ in rings], of, radius, True)
    own = np.vstack([ring_edges(r) for r, _ in rings])
    weight = np.eye(2, dtype=np.int64)[np.repeat([0, 1], [len(own), len(zone)])]
    return _parts_of(np.vstack([own, zone]), np.concatenate([np.repeat(of, [len(r) for r, _ in rings]), home]), weight, len(rows))


def as_pieces(dissolved: DataFrame, keys: list[str]) -> DataFrame:
    return dissolved.select(*keys, F.explode("parts").alias("rings"))


def close_gaps(pieces: DataFrame, keys: list[str], radius: float, cell: float, grain: float = GRAIN) -> DataFrame:
    """The union of the pieces grown and shrunk by ``radius``: gaps of less than twice that are closed."""
    grown = cut_lineage(as_pieces(grow(pieces, keys, radius, cell, grain), keys))  # read as pieces and for its border
    return shrink(grown, keys, radius, cell, grain)


def merge_pieces(
    pieces: DataFrame, key: str, cell: float, radius: float = 3.0, least_share: float = 0.85, name: str = "nombre", order: str = "pos"
) -> DataFrame:
    """Chosen pieces of a plot as one: their union if that is one part, else the union with gaps closed, if that is one part of enough area.

    ``pieces``: key, ``ring``, name and order. Returns key, ``nombre`` (joined with " + "), ``n_piezas``, ``parts``, ``area`` and ``status``: ``ok``, ``closed`` or,
    with the plain union's parts, ``rejected``. Keys of up to ``FEW`` corners, which most are, are worked on whole in one task, many at a time, and only
    their pieces travel; others are cut into cells.
    """
    box = R.bounds(F.col("ring"))
    sizes = pieces.groupBy(key).agg(
        F.sum(F.greatest(F.size("ring"), F.lit(0))).alias("_n"),
        F.greatest(*[F.max(box[f"max{v}"]) - F.min(box[f"min{v}"]) for v in "xy"]).alias("_side"),
    )
    few = F.coalesce((F.col("_n") <= FEW) & (F.col("_side") + 4 * radius <= EXTENT * GRAIN), F.lit(False))
    rows = pieces.select(key, name, order, "ring").join(sizes.select(key, few.alias("_few")).hint("shuffle_merge"), key)

    def gathered(df: DataFrame, *more: Column) -> DataFrame:
        return df.groupBy(key).agg(
            F.concat_ws(" + ", F.transform(F.array_sort(F.collect_list(F.struct(order, name))), lambda s: s[name])).alias("nombre"),
            F.count("*").alias("n_piezas"), F.sum(R.area(F.col("ring"))).alias("area_sum"), *more,
        )

    small = gathered(rows.where("_few"), _boxed(F.collect_list("ring")).alias("_rings"))
    here = small.drop("_rings").columns
    shape = "struct<parts: {}, area: double, n_parts: int>".format(PARTS_SQL)

    def as_shape(parts: list) -> dict | None:
        return {"parts": [[as_points(r) for r in part] for part in parts], "area": parts_area(parts), "n_parts": len(parts)} if parts else None

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for whole in batches:
            for begin in range(0, len(whole), KEYS_TOGETHER):
                pdf = whole.iloc[begin : begin + KEYS_TOGETHER]
                rings = [[snapped(r["r"]) for r in own] for own in pdf["_rings"]]
                plain = overlay_many([[(turned([r]), 0) for r in own] for own in rings])
                apart = [k for k, parts in enumerate(plain) if len(parts) > 1]
                closed = dict(zip(apart, closed_many([rings[k] for k in apart], 2 * radius / GRAIN)))
                out = pdf[here].assign(plain=[as_shape(parts) for parts in plain], closed=[as_shape(closed.get(k, [])) for k in range(len(plain))])
                yield out[[parts != [] for parts in plain]]

    joined = spread(small).mapInPandas(run, _schema(small.select(*here), f"plain {shape}, closed {shape}"))
    large = rows.where("not _few").select(key, name, order, "ring", F.array("ring").alias("rings"))
    plain = cut_lineage(dissolve(large, [key], cell).select(key, F.struct("parts", "area", "n_parts").alias("plain")))
    apart = plain.where("plain.n_parts <> 1").select(key)
    closed = close_gaps(cut_lineage(large.join(apart, key, "left_semi")), [key], radius, cell).select(key, F.struct("parts", "area", "n_parts").alias("closed"))
    joined = joined.union(gathered(large).join(plain.hint("shuffle_merge"), key).join(closed.hint("shuffle_merge"), key, "left"))
    good = (F.col("closed.n_parts") == 1) & (F.col("closed.area") >= least_share * F.col("area_sum"))
    whole = F.col("plain.n_parts") == 1
    best = F.when(~whole & good, F.col("closed")).otherwise(F.col("plain"))
    return joined.select(
        key, "nombre", "n_piezas", best["parts"].alias("parts"), best["area"].alias("area"),
        F.when(whole, "ok").when(good, "closed").otherwise("rejected").alias("status"),
    )
