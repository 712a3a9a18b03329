"""Statistics of the cells of all levels of a batch from its rows, or from the cells of its finest level.

What lies below one root comes together and is sorted by depth-first position
here, so every cell of any level is a run. Levels are summed from the root
downwards, each from what lies in cells that may still split.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa

from ..functions.geometry import EXACT_CELLS

CHUNK = 1 << 16  # rows handled at once, and at least those below one root


def changes(columns: list[np.ndarray]) -> np.ndarray:
    """Whether each row differs from the one before it; the first does."""
    new = np.zeros(len(columns[0]), bool)
    new[:1] = True
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return new


def whole_roots(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Sorted rows in tables that never part the rows of one root."""
    held: list[pa.RecordBatch] = []
    rows, wanted = 0, CHUNK
    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        if rows < wanted:
            continue
        table = pa.Table.from_batches(held)
        last = int(np.flatnonzero(changes([table.column(c).to_numpy() for c in keys]))[-1])
        if last:
            yield table.slice(0, last)
        held = table.slice(last).combine_chunks().to_batches()
        rows -= last
        wanted = max(CHUNK, 2 * rows)
    if rows:
        yield pa.Table.from_batches(held)


def half_names(k: int) -> list[str]:
    return [f"h{d}_{b}_{n}0" for d in range(1, k + 1) for b in (0, 1) for n in "ns"]


def schema(k: int, halves: bool, numbered: bool = False) -> str:
    dims = range(1, k + 1)
    numbers = [*[f"{n}{d}" for n in ("tpc" if numbered else "tp") for d in dims], "rows", "n0", "s0", "code"]
    spans = [f"{n}{d} double" for d in dims for n in ("mn", "mx")]
    return ", ".join(["combo int", "level int", *[f"{n} bigint" for n in numbers], *spans,
                      *[f"{n} bigint" for n in (half_names(k) if halves else [])]])


def positions(places: list[np.ndarray], bits: int) -> np.ndarray:
    """Depth-first positions: the bits of all places interleaved, first dimension on top."""
    k, code = len(places), np.zeros(len(places[0]), np.int64)
    for d, place in enumerate(places):
        for b in range(bits):
            code |= (place >> b & 1) << (b * k + k - 1 - d)
    return code


@dataclass(frozen=True)
class Ranges:
    """Root ranges of each subset (rows) and dimension (columns): what ``Forest.with_cells`` and ``with_places`` know, for arrays."""

    lo: np.ndarray
    last: np.ndarray
    size: np.ndarray

    def cells_from_zero(self, combo: np.ndarray, d: int, value: np.ndarray, level: int) -> np.ndarray:
        inside = np.maximum(self.lo[combo, d - 1], np.fmin(self.last[combo, d - 1], value))
        with np.errstate(over="ignore"):
            return inside * math.ldexp(1.0, level >> 1) / self.size[combo, d - 1] * math.ldexp(1.0, level - (level >> 1))

    def places(self, combo: np.ndarray, d: int, value: np.ndarray, base: int, bits: int) -> np.ndarray:
        cells = self.cells_from_zero(combo, d, value, base)
        near = np.abs(cells) < EXACT_CELLS
        cells = np.where(near, cells, 0.0)
        return np.floor((cells - np.floor(cells)) * 2.0 ** bits).astype(np.int64)

    def numbers(self, combo: np.ndarray, d: int, value: np.ndarray, level: int) -> pa.Array:
        """Cell numbers below the root; NULL where the value itself numbers its cell."""
        cells = self.cells_from_zero(combo, d, value, level)
        near = np.abs(cells) < EXACT_CELLS
        return pa.array(np.floor(np.where(near, cells, 0.0)).astype(np.int64), mask=~near)


def shared_levels(root: np.ndarray, code: np.ndarray, k: int, bits: int) -> np.ndarray:
    """Levels below their root on which each cell lies in one cell with the one before it; -1 where the root is another."""
    differ = code[1:] ^ code[:-1]
    shared = np.full(len(code), bits, np.int64)
    for level in range(bits):
        shared[1:] -= differ >> k * level != 0
    shared[:1] = -1
    shared[1:][root[1:] != root[:-1]] = -1
    return shared


def rolled_up(k: int, base: int, first: int, levels: int, extra: int, threshold: int,
              deepest: Sequence[int] | None = None, ranges: Ranges | None = None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """All levels from ``first`` to ``levels`` below the roots at ``base``; places are given ``extra`` levels deeper.

    Input are cells with places f1.. or rows with values x1.. inside ``ranges``,
    in the order of the roots or of a column ``root``.
    With an extra level the halves of each cell are counted, too. A cell with
    fewer entities than the threshold, with a single value or below the deepest
    level of its subset does not split, so nothing below it is a node.
    """
    dims, bits = range(1, k + 1), levels + extra
    keys = ["combo", *[f"t{d}" for d in dims]]
    sums, lows, highs = ["rows", "n0", "s0"], [f"mn{d}" for d in dims], [f"mx{d}" for d in dims]
    limits = None if deepest is None else np.array(deepest)

    def depth_first(get: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The order of roots and places in them, and both in that order."""
        root = get["root"] if "root" in get else np.cumsum(changes([get[c] for c in keys]))
        get |= {f"f{d}": ranges.places(get["combo"], d, get[f"x{d}"], base, bits) for d in dims if f"f{d}" not in get}
        code = positions([get[f"f{d}"] for d in dims], bits)
        order = np.lexsort((code, root))
        root = np.cumsum(changes([root[order]]))
        if int(root[-1]) < int(changes([root, *[get[c][order] for c in keys]]).sum()):  # two roots of one hash
            order = np.lexsort((code, *[get[c] for c in keys]))
            root = np.cumsum(changes([get[c][order] for c in keys]))
        return order, root, code[order]

    def tables(cells: pa.Table) -> Iterator[pa.RecordBatch]:
        get = {c: cells.column(c).to_numpy() for c in cells.column_names}
        order, root, code = depth_first(get)
        begin = np.flatnonzero(changes([root, code]))
        at = order[begin]
        root, code = root[begin], code[begin]
        get["rows"] = get["rows"] if "rows" in get else np.ones(len(order), np.int64)
        now = {c: np.add.reduceat(get[c][order], begin) for c in sums}
        for d in dims:  # NaN is the greatest number
            now[f"mn{d}"] = np.fmin.reduceat(get[f"mn{d}" if f"mn{d}" in get else f"x{d}"][order], begin)
            now[f"mx{d}"] = np.maximum.reduceat(get[f"mx{d}" if f"mx{d}" in get else f"x{d}"][order], begin)
        top = {c: get[c][at] for c in keys}
        places = [get[f"f{d}"][at] for d in dims]
        shared = shared_levels(root, code, k, bits)
        for level in range(levels + 1):
            begin = np.flatnonzero(shared < level)
            stats = {c: np.add.reduceat(now[c], begin) for c in sums}
            stats |= {c: np.fmin.reduceat(now[c], begin) for c in lows}
            stats |= {c: np.maximum.reduceat(now[c], begin) for c in highs}
            if level >= first:
                out = {"combo": top["combo"][begin], "level": np.full(len(begin), base + level, np.int32)}
                out |= {f"t{d}": top[f"t{d}"][begin] for d in dims}
                out |= {f"p{d}": places[d - 1][begin] >> (bits - level) for d in dims}
                out |= {f"c{d}": ranges.numbers(out["combo"], d, stats[f"mn{d}"], base + level) for d in dims} if ranges else {}
                out |= {c: stats[c] for c in sums} | {"code": code[begin] >> (bits - level) * k}
                out |= {f"{n}{d}": stats[f"{n}{d}"] for d in dims for n in ("mn", "mx")}
                for d in dims if extra else []:
                    side = places[d - 1] >> (bits - level - 1) & 1
                    high = {c: np.add.reduceat(now[c] * side, begin) for c in ("n0", "s0")}
                    out |= {f"h{d}_0_{c}": stats[c] - high[c] for c in ("n0", "s0")} | {f"h{d}_1_{c}": high[c] for c in ("n0", "s0")}
                yield pa.RecordBatch.from_arrays([v if isinstance(v, pa.Array) else pa.array(v) for v in out.values()], names=list(out))
                open_ = (stats["n0"] >= threshold) & np.logical_or.reduce([~(stats[a] >= stats[b]) for a, b in zip(lows, highs)])
                if limits is not None:
                    open_ &= limits[top["combo"][begin]] >= base + level
            else:
                open_ = np.ones(len(begin), bool)  # the root is known to split
            if level == levels or not open_.any():
                return
            kept = np.flatnonzero(np.repeat(open_, np.diff(begin, append=len(shared))))
            if len(kept) < len(shared):  # whole cells go, so what is left of each level begins where it did
                shared, code, places = shared[kept], code[kept], [p[kept] for p in places]
                now, top = {c: v[kept] for c, v in now.items()}, {c: v[kept] for c, v in top.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batch = next(batches, None)
        if batch is None:
            return
        for cells in whole_roots(chain([batch], batches), ["root"] if "root" in batch.schema.names else keys):
            yield from tables(cells)

    return run
