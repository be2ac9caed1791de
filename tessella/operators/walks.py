"""The ordered walks over one mesh: connectivity with repair, connectivity symbols, coding order.

These depend on corner order and a shared stack, so a mesh is one group of an Arrow function; its memory is that of the
mesh's corners (some hundred bytes each). Everything local is in topology.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .surfaces import edges_of, mates

NONE = -1


def after(c: int) -> int:
    return c - 2 if c % 3 == 2 else c + 1


def before(c: int) -> int:
    return c + 2 if c % 3 == 0 else c - 1


def turns(n: int) -> tuple[list[int], list[int]]:
    """after and before of n corners, for the loops that would call them for each."""
    c = np.arange(n).reshape(-1, 3)
    return c[:, [1, 2, 0]].ravel().tolist(), c[:, [2, 0, 1]].ravel().tolist()


class Surface:
    """Corners of triangles with vertices (vert) and opposite corners (opp, NONE on a boundary); one fan a vertex."""

    def __init__(self, triangles: list[tuple[int, int, int]]):
        self.vert = [v for t in triangles for v in t]
        self.opp = [NONE] * len(self.vert)
        self.first: list[int] = []  #: of each vertex, the corner that is left-most in its fan
        self.parent: dict[int, int] = {}  #: of vertices that were split off
        self._pair()
        if self._crowded():
            self._break()
        self._fan()

    def _pair(self) -> None:
        v = np.array(self.vert, np.int64).reshape(-1, 3)
        tip, src, snk = v.ravel(), v[:, [1, 2, 0]].ravel(), v[:, [2, 0, 1]].ravel()
        c = np.flatnonzero((tip != src) & (src != snk) & (snk != tip))
        self.opp = mates(len(tip), *edges_of(c, np.zeros(len(c), np.int64), src[c], snk[c]), src, snk, tip).tolist()

    def _crowded(self) -> bool:
        """Whether an edge has more than two faces."""
        v = np.array(self.vert, np.int64).reshape(-1, 3)
        c = np.arange(v.size)
        return bool((edges_of(c, 0 * c, v[:, [1, 2, 0]].ravel(), v[:, [2, 0, 1]].ravel())[2] > 2).any())

    def _break(self) -> None:
        """Cuts fans that come by one neighbour twice, until none does."""
        opp, vert = self.opp, self.vert
        nxt, prv = turns(len(vert))
        done = [False] * len(vert)
        again = True
        while again:
            again = False
            for start in range(len(vert)):
                if done[start]:
                    continue
                if opp[nxt[start]] == NONE == opp[prv[start]]:
                    done[start] = True
                    continue
                c = start
                while (o := opp[nxt[c]]) != NONE and (n := nxt[o]) != start and not done[n]:
                    c = n
                begin, met = c, {}
                while c != NONE:
                    done[c] = True
                    edge, sink = prv[c], vert[nxt[c]]
                    other = met.get(sink)
                    if other is not None and opp[edge] != other:
                        for e in (edge, other):
                            if opp[e] != NONE:
                                opp[opp[e]] = NONE
                            opp[e] = NONE
                        again = True
                        break
                    met.setdefault(vert[edge], nxt[c])
                    o = opp[edge]
                    c = prv[o] if o != NONE else NONE
                    if c == begin:
                        break

    def _fan(self) -> None:
        opp, vert = self.opp, self.vert
        nxt, prv = turns(len(vert))
        first = self.first = [NONE] * (max(vert, default=-1) + 1)
        seen = [False] * len(vert)
        for start in range(len(vert)):
            if seen[start]:
                continue
            fan, o = [start], opp[nxt[start]]
            while o != NONE and (c := nxt[o]) != start:
                fan.append(c)
                o = opp[nxt[c]]
            most = fan[-1]
            if o == NONE:
                o = opp[prv[start]]
                while o != NONE:
                    fan.append(prv[o])
                    o = opp[prv[prv[o]]]
            v = vert[start]
            if first[v] != NONE:
                self.parent[len(first)] = v
                v = len(first)
                first.append(NONE)
            first[v] = most
            for c in fan:
                seen[c], vert[c] = True, v

    def over(self, c: int) -> int:
        return self.opp[c] if c != NONE else NONE

    def left(self, c: int) -> int:
        """The corner of the same vertex in the face on the left."""
        o = self.over(after(c))
        return after(o) if o != NONE else NONE

    def right(self, c: int) -> int:
        o = self.over(before(c))
        return before(o) if o != NONE else NONE

    def right_face(self, c: int) -> int:
        """The corner across the right edge."""
        return self.over(after(c))

    def left_face(self, c: int) -> int:
        return self.over(before(c))

    def border(self, v: int) -> bool:
        return self.left(self.first[v]) == NONE


class Cut:
    """A surface cut along the seams of an attribute: edges that two faces see with other values at an end."""

    def __init__(self, base: Surface, value: list[int]):
        """value: of each corner."""
        self.base, n = base, len(base.vert)
        nxt, prv = turns(n)
        val, opp, to, back = (np.array(x, np.int64) for x in (value, base.opp, nxt, prv))
        seam = (opp < 0) | (val[to] != val[back[opp]]) | (val[back] != val[to[opp]])
        self.seam, self.opp = seam.tolist(), np.where(seam, NONE, opp).tolist()
        on = np.zeros(len(base.first), bool)
        vert = np.array(base.vert, np.int64)
        on[vert[to[seam]]] = on[vert[back[seam]]] = True
        self.vert, self.first = [0] * n, []
        over, cut, own, first = base.opp, self.seam, self.vert, self.first
        for c, ends in zip(base.first, on.tolist(), strict=True):
            if c == NONE:
                continue
            start = c
            if ends:
                while (o := self.opp[nxt[start]]) != NONE and (x := nxt[o]) != c:
                    start = x
            own[start] = len(first)
            first.append(start)
            o = over[prv[start]]
            while o != NONE and (x := prv[o]) != start:
                if cut[nxt[x]]:
                    first.append(x)
                own[x] = len(first) - 1
                o = over[prv[x]]

    over, left, right = Surface.over, Surface.left, Surface.right
    right_face, left_face, border = Surface.right_face, Surface.left_face, Surface.border


@dataclass
class Walk:
    symbols: list[str] = field(default_factory=list)
    inner_starts: list[bool] = field(default_factory=list)  #: of each component, whether it starts inside
    splits: list[tuple[int, int, bool]] = field(default_factory=list)  #: (merging symbol, split symbol, on the right side)
    corners: list[int] = field(default_factory=list)  #: in order of symbols
    starts: list[int] = field(default_factory=list)  #: corners of the faces that inner components start with


def holes(s: Surface) -> dict[int, int]:
    """vertex to number of its boundary loop."""
    out: dict[int, int] = {}
    loops, opp, vert = 0, s.opp, s.vert
    nxt, _ = turns(len(vert))
    for c in range(len(vert)):
        v = vert[nxt[c]]
        if opp[c] != NONE or v in out:
            continue
        while v not in out:
            out[v] = loops
            c = nxt[c]
            while opp[c] != NONE:  # round the vertex to the next boundary edge
                c = nxt[opp[c]]
            v = vert[nxt[c]]
        loops += 1
    return out


def symbols(s: Surface) -> Walk:
    """Each component is eaten face by face from a gate: C a new inner vertex, R and L a side is gone, E both, S it splits."""
    out, hole = Walk(), holes(s)
    opp, vert = s.opp, s.vert
    nxt, prv = turns(len(vert))
    eaten = [False] * (len(vert) // 3)
    known, rounded = set(), set()
    split_at: dict[int, int] = {}

    def gone(c: int) -> bool:
        return c == NONE or eaten[c // 3]

    def round_hole(c: int, with_start: bool) -> None:
        start = vert[c]
        rounded.add(hole[start])
        if with_start:
            known.add(start)
        edge = prv[c]
        while True:
            while opp[edge] != NONE:
                edge = nxt[opp[edge]]
            v = vert[prv[edge]]
            if v == start:
                return
            known.add(v)
            edge = nxt[edge]

    def merge(c: int, right: bool) -> None:
        if c != NONE and c // 3 in split_at:
            out.splits.append((len(out.symbols), split_at[c // 3], right))

    def gate_of(face: int) -> tuple[bool, int]:
        for c in range(3 * face, 3 * face + 3):
            if opp[c] == NONE:
                return False, c
            if vert[c] in hole:
                while (n := s.right(c)) != NONE:
                    c = n
                return False, before(c)
        return True, 3 * face

    for face in range(len(eaten)):
        if eaten[face]:
            continue
        inside, gate = gate_of(face)
        out.inner_starts.append(inside)
        if inside:
            known.update(vert[3 * face : 3 * face + 3])
            eaten[face] = True
            out.starts.append(after(gate))
            gate = opp[after(gate)]
        else:
            round_hole(after(gate), True)
        stack = [gate]
        while stack:
            c = stack.pop()
            if eaten[c // 3]:
                continue
            while True:
                eaten[c // 3] = True
                out.corners.append(c)
                v = vert[c]
                new = v not in known
                known.add(v)
                r, l = opp[nxt[c]], opp[prv[c]]  # noqa: E741
                if new and v not in hole:
                    out.symbols.append("C")
                    c = r
                    continue
                if gone(r):
                    merge(r, True)
                if gone(l):
                    merge(l, False)
                if gone(r) and gone(l):
                    out.symbols.append("E")
                    break
                if gone(r) or gone(l):
                    out.symbols.append("R" if gone(r) else "L")
                    c = l if gone(r) else r
                    continue
                if v in hole and hole[v] not in rounded:
                    round_hole(c, False)
                split_at[c // 3] = len(out.symbols)
                out.symbols.append("S")
                stack += (l, r)
                break
    return out


def order(s: Surface | Cut, walk: Walk) -> list[int]:
    """A corner for each vertex in the order in which values are coded: depth first, from the component that was eaten last."""
    opp, vert, first = s.opp, s.vert, s.first
    nxt, prv = turns(len(vert))
    seen, done, out = [False] * len(first), [False] * (len(vert) // 3), []

    def visit(c: int) -> None:
        if not seen[vert[c]]:
            seen[vert[c]] = True
            out.append(c)

    stack = [*reversed(walk.starts), *walk.corners]
    while stack:
        c = stack.pop()
        if done[c // 3]:
            continue
        n, p = nxt[c], prv[c]
        if not (seen[vert[n]] and seen[vert[p]]):
            visit(n)
            visit(p)
        done[c // 3] = True
        new = not seen[vert[c]]
        visit(c)
        r, l = opp[n], opp[p]  # noqa: E741
        if new and opp[nxt[first[vert[c]]]] != NONE:
            stack.append(r)
            continue
        for x, y in ((l, r), (r, l)):  # the right side comes first
            if x != NONE and not done[x // 3]:
                stack.append(x)
    return out


def mesh_walks(faces: DataFrame) -> DataFrame:
    """faces: mesh_id, face_idx, p0, p1, p2 (vertices). mesh_id, rank, symbol, corner: the symbols of each mesh."""

    def run(group: pa.Table) -> pa.Table:
        own = group.sort_by("face_idx")
        rows: Iterable = zip(*(own.column(c).to_pylist() for c in ("p0", "p1", "p2")), strict=True)
        w = symbols(Surface([t for t in rows if len(set(t)) == 3]))
        n = len(w.symbols)
        return pa.table({"mesh_id": pa.array([own.column("mesh_id")[0].as_py()] * n, pa.int64()), "rank": pa.array(range(n), pa.int64()), "symbol": pa.array(w.symbols, pa.string()), "corner": pa.array(w.corners, pa.int64())})

    return faces.select("mesh_id", "face_idx", "p0", "p1", "p2").groupBy("mesh_id").applyInArrow(run, "mesh_id long, rank long, symbol string, corner long")


def coding_orders(faces: DataFrame) -> DataFrame:
    """mesh_id, rank, corner, vertex (an id after splitting): the order in which the values of positions are coded."""

    def run(group: pa.Table) -> pa.Table:
        own = group.sort_by("face_idx")
        rows = zip(*(own.column(c).to_pylist() for c in ("p0", "p1", "p2")), strict=True)
        s = Surface([t for t in rows if len(set(t)) == 3])
        o = order(s, symbols(s))
        return pa.table({"mesh_id": pa.array([own.column("mesh_id")[0].as_py()] * len(o), pa.int64()), "rank": pa.array(range(len(o)), pa.int64()), "corner": pa.array(o, pa.int64()), "vertex": pa.array([s.vert[c] for c in o], pa.int64())})

    return faces.select("mesh_id", "face_idx", "p0", "p1", "p2").groupBy("mesh_id").applyInArrow(run, "mesh_id long, rank long, corner long, vertex long")
