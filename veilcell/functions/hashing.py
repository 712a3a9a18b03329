"""Stable hashes and seeded noise as Column expressions.

All seeds are 60-bit non-negative integers, so they fit a bigint under ANSI mode
and any SQL engine with SHA-256 can reproduce them.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_HALF_MASK = (1 << 30) - 1
_HALF_SPAN = float(1 << 30)
NORMAL_LIMIT = 6.6  # above every value that two 30-bit halves give: sqrt(62 * ln 2) = 6.556


def text_seed(text: str) -> int:
    """Driver-side twin of :func:`hash_text` for constants."""
    return max(int(hashlib.sha256(text.encode()).hexdigest()[:15], 16), 1)


def hash_text(text: Column) -> Column:
    """60-bit hash of a string; never 0, which is kept for "no entity"."""
    digest = F.conv(F.substring(F.sha2(text.cast("string"), 256), 1, 15), 16, 10)
    return F.greatest(digest.cast("bigint"), F.lit(1).cast("bigint"))


def entity_hash(entity: Column) -> Column:
    """Hash of an entity id; NULL and the empty string are no entity at all."""
    text = entity.cast("string")
    missing = text.isNull() | (text == "")
    return F.when(missing, F.lit(0).cast("bigint")).otherwise(hash_text(text))


def salted(seed: Column, salt: str) -> Column:
    return hash_text(F.concat(F.lit(f"{salt}:"), seed.cast("string")))


def mix(seed: Column, step: str) -> Column:
    return seed.bitwiseXOR(F.lit(text_seed(step)))


def combine_texts(seed: Column, texts: Sequence[Column]) -> Column:
    """XOR the hashes of the distinct texts into a seed; equal texts count once."""
    result = seed
    for i, text in enumerate(texts):
        value = hash_text(text)
        if i:
            repeated = text.isin(*texts[:i])
            value = F.when(repeated, F.lit(0).cast("bigint")).otherwise(value)
        result = result.bitwiseXOR(value)
    return result


def uniform_int(seed: Column, lower: Column, upper: Column) -> Column:
    return lower + seed % (upper - lower + 1)


def normal(seed: Column) -> Column:
    """Standard normal value from the two 30-bit halves of a seed (Box-Muller)."""
    low = (seed.bitwiseAND(F.lit(_HALF_MASK)) + 0.5) / _HALF_SPAN
    high = (F.shiftrightunsigned(seed, 30) + 0.5) / _HALF_SPAN
    return F.sqrt(-2.0 * F.log(low)) * F.sin(2.0 * math.pi * high)


def layered_noise(seeds: Sequence[Column], step: str, sd: Column | float, salt: str) -> Column:
    """Sum of one normal value per seed, each scaled by ``sd``."""
    total = None
    for seed in seeds:
        layer = normal(mix(salted(seed, salt), step))
        total = layer if total is None else total + layer
    return total * sd


def noisy_row_limit(seed: Column, rows: Column, fraction: int, salt: str) -> Column:
    """rows/fraction with up to 5 % of seeded noise, in whole rows."""
    limit = F.floor(rows / fraction)
    spread = F.floor(limit / 20)
    return limit + uniform_int(mix(salted(seed, salt), "precision_limit"), -spread, spread)


def draw_key(*keys: Column) -> Column:
    """Repeatable 60-bit number for data that is anonymous already; any SQL engine can compute it."""
    return hash_text(F.concat_ws("|", *[k.cast("string") for k in keys]))


def unit_draw(*keys: Column) -> Column:
    """Repeatable draw from [0, 1) for data that is anonymous already."""
    return F.shiftrightunsigned(draw_key(*keys), 7) / float(1 << 53)


def index_draw(size: Column, *keys: Column) -> Column:
    """Repeatable draw from 0 .. size-1."""
    return draw_key(*keys) % size


# Fixed value: the prime 2^31 - 1, below which products of two numbers fit a bigint.
_PRIME = (1 << 31) - 1
SHUFFLE_ROUNDS = 40


def shuffle_rounds(size: int, *keys: object) -> list[tuple[int, int, int]]:
    """The constants of each round of :func:`shuffled_position`: where positions are mirrored, and which are."""
    def number(round_: int, name: str) -> int:
        return text_seed("|".join([name, str(round_), *map(str, keys)]))

    return [(number(i, "mirror") % size, number(i, "factor") % (_PRIME - 1) + 1, number(i, "shift") % _PRIME) for i in range(SHUFFLE_ROUNDS)]


def shuffled_position(position: Column, size: int, *keys: object) -> Column:
    """A keyed permutation of 0 .. size-1: every position gets one of its own, without sorting or seeing the others.

    Each round mirrors the positions at a point and swaps some of the pairs, told
    by a number both of a pair share, so each round is a permutation of any size.
    All positions of a batch take a round at once.
    """
    rounds = shuffle_rounds(size, *keys)

    @F.pandas_udf("bigint")
    def shuffled(at: pd.Series) -> pd.Series:
        here = at.to_numpy(np.int64)
        for mirror, factor, shift in rounds:
            other = (mirror - here) % size
            mixed = (np.maximum(here, other) % _PRIME * factor % _PRIME + shift) % _PRIME
            here = np.where(mixed * mixed % _PRIME & 1 << 13, other, here)
        return pd.Series(here)

    at = position.cast("bigint")
    return F.when(at.isNotNull(), shuffled(F.coalesce(at, F.lit(0).cast("bigint"))))
