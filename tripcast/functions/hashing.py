"""Reproducible randomness from row ids.

Every random choice is a function of ``(seed, id)`` only, so it does not change
with the partitioning, with a retried task or with the order of rows. MD5 is
used because its value is the same in every SQL engine.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_WORD = 4294967296.0


Seed = int | str | Column      # a column gives rows of one table seeds of their own


def part_of(seed: Seed, name: str) -> Seed:
    """The seed of one of several uses: ``seed/name``."""
    return F.concat(seed.cast("string"), F.lit(f"/{name}")) if isinstance(seed, Column) else f"{seed}/{name}"


def digest(seed: Seed, *ids: Column) -> Column:
    """32 hex digits for ``seed:id[:id...]``."""
    first = seed.cast("string") if isinstance(seed, Column) else F.lit(str(seed))
    return F.md5(F.concat_ws(":", first, *[i.cast("string") for i in ids]))


def unit(hex_digest: Column, word: int = 0) -> Column:
    """Uniform in [0, 1) from one of the four 32-bit words of a digest."""
    piece = F.substring(hex_digest, 1 + 8 * word, 8)
    return F.conv(piece, 16, 10).cast("double") / F.lit(_WORD)


def uniform(seed: Seed, *ids: Column) -> Column:
    """Uniform in [0, 1) from 52 bits, as many as tell all rows of a group of
    10^15 apart; normals make do with 32."""
    return F.conv(F.substring(digest(seed, *ids), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def gaussians(hex_digest: Column) -> tuple[Column, Column, Column, Column]:
    """Four independent standard normals from one digest (two Box-Muller pairs)."""
    out = []
    for first in (0, 2):
        radius = F.sqrt(-2.0 * F.log(1.0 - unit(hex_digest, first)))
        angle = 2.0 * F.pi() * unit(hex_digest, first + 1)
        out += [radius * F.cos(angle), radius * F.sin(angle)]
    return tuple(out)


def gaussian(seed: Seed, *ids: Column) -> Column:
    return gaussians(digest(seed, *ids))[0]
