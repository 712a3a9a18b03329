"""Ranges, power-of-two snapping, cells and rounding as Column expressions."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Bounds of the 1-2-5 rounding ladder and its smallest input.
MONEY_STEPS = ((1.5, 1.0), (3.5, 2.0), (7.5, 5.0))
MONEY_MIN = 1e-10


def next_power_of_two(x: Column) -> Column:
    """Smallest power of two >= x; corrects the rounding of log2 near exact powers."""
    guess = F.pow(F.lit(2.0), F.ceil(F.log2(x)).cast("double"))
    return (F.when(guess / 2 >= x, guess / 2).when(guess < x, guess * 2).otherwise(guess))


def floor_by(value: Column, step: Column | float) -> Column:
    return F.floor(value / step).cast("double") * step


def ceil_by(value: Column, step: Column | float) -> Column:
    return F.ceil(value / step).cast("double") * step


def round_away(value: Column) -> Column:
    """Whole number nearest to value, halves away from zero."""
    return F.signum(value) * F.floor(F.abs(value) + 0.5)


def money_round(value: Column) -> Column:
    tens = F.pow(F.lit(10.0), F.floor(F.log10(value)).cast("double"))
    lead = value / tens
    step = F.lit(10.0)
    for bound, result in reversed(MONEY_STEPS):
        step = F.when(lead < bound, result).otherwise(step)
    return F.when(value < MONEY_MIN, 0.0).otherwise(tens * step)


def is_money_rounded(value: Column) -> Column:
    return F.abs(money_round(value) - value) < MONEY_MIN / 100


def noise_scale_for_report(sd: Column) -> Column:
    """A noise deviation rounded up to a money-style resolution of 5 %."""
    return F.when(sd == 0, 0.0).otherwise(ceil_by(sd, money_round(sd * 0.05)))


# Ranges are (lo, hi) pairs of double columns.

def middle(lo: Column, hi: Column) -> Column:
    return F.when(lo == hi, lo).otherwise((lo + hi) / 2)


def half_index(value: Column, lo: Column, hi: Column) -> Column:
    return F.when((lo == hi) | (value < middle(lo, hi)), 0).otherwise(1)


def half(index: Column, lo: Column, hi: Column) -> Column:
    mid = middle(lo, hi)
    return F.when(index == 0, F.struct(lo.alias("lo"), mid.alias("hi"))).otherwise(
        F.struct(mid.alias("lo"), hi.alias("hi")))


def contains(lo: Column, hi: Column, inner_lo: Column, inner_hi: Column) -> Column:
    return (inner_lo >= lo) & (inner_hi <= hi)


def contains_value(lo: Column, hi: Column, value: Column) -> Column:
    return (value == lo) | ((value > lo) & (value < hi))


def contains_value_inclusive(lo: Column, hi: Column, value: Column) -> Column:
    return (value >= lo) & (value <= hi)


def overlaps(lo: Column, hi: Column, other_lo: Column, other_hi: Column) -> Column:
    return (other_lo < hi) & (other_hi > lo)


def is_singular(lo: Column, hi: Column) -> Column:
    return lo == hi


def snap_range(lo: Column, hi: Column) -> Column:
    """Struct (lo, size): the aligned power-of-two range covering [lo, hi].

    When the first alignment falls short the range is snapped once more from the
    aligned bound; a second shortfall is impossible because the gap is then below
    1.5 sizes and the size has doubled.
    """
    size = F.when(hi == lo, 1.0).otherwise(next_power_of_two(hi - lo))
    aligned = floor_by(lo, size / 2)
    wider = next_power_of_two(hi - aligned)
    return F.when(
        aligned + size >= hi, F.struct(aligned.alias("lo"), size.alias("size"))
    ).otherwise(F.struct(floor_by(aligned, wider / 2).alias("lo"), wider.alias("size")))


def cell_of(value: Column, lo: float | Column, size: float | Column, level: int | Column) -> Column:
    """Cell of a value at a level: what repeated halving of the root range gives.

    Values outside the root end in the edge cells. The closing comparison repairs
    the one-cell error that an inexact subtraction can cause.
    """
    cells = F.pow(F.lit(2.0), F.lit(level) if isinstance(level, int) else level.cast("double"))
    share = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (value - lo) / size))
    cell = F.least(F.floor(share * cells), (cells - 1).cast("bigint"))
    too_high = (cell > 0) & (value < F.lit(lo) + cell.cast("double") * (F.lit(size) / cells))
    return F.when(too_high, cell - 1).otherwise(cell)


# Cells of a tree. Below the root a cell is numbered by its distance from zero in
# widths, so a number does not depend on the root and halves when one level up.
# A cell that holds two different doubles has a number below 2^53 at any depth; a
# deeper one holds a single value, whose hash numbers it, above 2^62. The root is cell 0.

EXACT_CELLS = float(1 << 53)


def cell_width(size: float | Column, level: Column) -> Column:
    """size / 2^level, in two steps because 2^level has no limit."""
    half = F.shiftright(level, 1)
    return F.lit(size) / F.pow(F.lit(2.0), half.cast("double")) / F.pow(F.lit(2.0), (level - half).cast("double"))


def _binade(value: Column) -> Column:
    """Largest e with 2^e <= |value|, for values other than 0; not below the exponent of the smallest normal double."""
    guess = F.greatest(F.floor(F.log2(F.abs(value))), F.lit(-1022).cast("bigint"))
    power = F.pow(F.lit(2.0), guess.cast("double"))
    e = F.when(power > F.abs(value), guess - 1).when(power * 2 <= F.abs(value), guess + 1).otherwise(guess)
    return F.greatest(e, F.lit(-1022).cast("bigint"))


def _significand(value: Column, binade: Column) -> Column:
    return (F.abs(value) / F.pow(F.lit(2.0), (binade - 52).cast("double"))).cast("bigint")


def cells_from_zero(value: Column, size: float | Column, level: Column) -> Column:
    """How many cell widths a value is away from zero: exact, as widths are powers of two."""
    half = F.shiftright(level, 1)
    return value * F.pow(F.lit(2.0), half.cast("double")) / size * F.pow(F.lit(2.0), (level - half).cast("double"))


def value_cell(value: Column) -> Column:
    """Number of a cell that holds a single value."""
    return F.shiftrightunsigned(F.xxhash64(value), 2).bitwiseOR(F.lit(1 << 62))


def cell_number(value: Column, cells: Column, level: Column) -> Column:
    """Cell of a value inside the root, ``cells`` widths away from zero."""
    return (F.when(level == 0, F.lit(0).cast("bigint")).when(F.abs(cells) < EXACT_CELLS, F.floor(cells))
            .otherwise(value_cell(value)))


def parent_cell(cell: Column, level: Column) -> Column:
    """Cell one level up, for cells numbered by their distance from zero."""
    return F.when(level <= 1, F.lit(0).cast("bigint")).otherwise(F.shiftright(cell, 1))


def cell_bounds(cell: Column, level: Column, lo: float | Column, size: float | Column) -> tuple[Column, Column]:
    width = cell_width(size, level)
    start = F.when(level == 0, F.lit(lo)).otherwise(cell.cast("double") * width)
    return start, start + width


def shared_levels(low: Column, high: Column, size: float | Column, level: Column, deepest: int = 2200) -> Column:
    """Deepest level, from ``level`` on, at which two values of one cell at ``level`` still share a cell."""
    def together(at: Column) -> Column:
        ends = [cells_from_zero(v, size, at) for v in (low, high)]
        # From 2^53 cells on, different doubles are in different cells.
        near = (F.abs(ends[0]) < EXACT_CELLS) & (F.abs(ends[1]) < EXACT_CELLS)
        return near & (F.floor(ends[0]) == F.floor(ends[1]))

    steps = F.array(*[F.lit(1 << b) for b in range(deepest.bit_length() - 1, -1, -1)])
    found = F.aggregate(steps, level.cast("int"), lambda at, step: F.when(together(at + step), at + step).otherwise(at))
    return F.when(low < high, found)


def binade(value: Column) -> Column:
    """Exponent of a double as :func:`exact_label` asks for it."""
    return _binade(value)


def exact_label(value: Column, exponent: Column | None = None) -> Column:
    """Text of a double's exact value: exponent and significand.

    The exponent is used several times: where it has a column of its own it is computed once.
    """
    e = _binade(value) if exponent is None else exponent
    sign = F.when(value < 0, "-").otherwise("")
    return F.when(value == 0, "0").otherwise(F.concat(sign, e.cast("string"), F.lit(":"), _significand(value, e).cast("string")))


def child_code(cells: Sequence[Column], bits: int) -> Column:
    """Depth-first position of a node: its low bits interleaved, first dimension on top."""
    k = len(cells)
    code = F.lit(0).cast("bigint")
    for d, cell in enumerate(cells):
        for b in range(bits):
            bit = F.shiftright(cell, b).bitwiseAND(F.lit(1).cast("bigint"))
            code = code + F.shiftleft(bit, b * k + (k - 1 - d))
    return code


def column_combinations(columns: Sequence[int], k: int) -> list[tuple[int, ...]]:
    """Ordered subsets of k columns; k = 0 has none."""
    return list(combinations(sorted(columns), k)) if k else []


def rescale_prefix(prefix: Column, target: Column, total: Column, lead: Column) -> Column:
    """Running total after scaling counts from ``total`` to ``target`` with carried remainders.

    Up to ``lead`` all counts scale exactly and nothing is carried. From there on a
    remainder is carried only when it exceeds one whole unit, so between nothing
    and a whole unit always stays behind.
    """
    wide = [c.cast("decimal(19,0)") for c in (prefix, target, total)]  # products have no limit in practice
    exact = F.call_function("div", wide[0] * wide[1], wide[2])
    carried = F.call_function("div", wide[0] * wide[1] + wide[2] - F.lit(1), wide[2]) - 1
    return F.when(prefix <= lead, exact).otherwise(F.greatest(carried, F.lit(0).cast("bigint")))
