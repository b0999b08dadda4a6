"""Seeded, engine-independent orders.

Every "random" choice in the package is an order by ``md5(seed ':' key)``: it does not
depend on partitioning, retries or row order, and plain SQL can reproduce it.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _as_column(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def seeded_md5(seed: int | Column, *keys: Column | str) -> Column:
    """Hex md5 of ``seed:key[:key...]``; a seed may itself be a column (one seed per fold)."""
    first = seed.cast("string") if isinstance(seed, Column) else F.lit(str(seed))
    return F.md5(F.concat_ws(":", first, *[_as_column(k).cast("string") for k in keys]))


def unit_interval(md5_hex: Column) -> Column:
    """The first 32 bits of a hex digest as a number in [0, 1)."""
    return F.conv(F.substring(md5_hex, 1, 8), 16, 10).cast("double") / F.lit(float(2**32))


#: Step between the orders of successive folds on the circle of 32-bit positions.
CIRCLE, CIRCLE_STEP = 2**32, 2654435761


def circle_position(md5_hex: Column, turn: Column) -> Column:
    """A seeded position in [0, 2**32), turned by a fold number.

    One digest per row serves all folds: every fold starts reading the circle elsewhere,
    so each takes its own uniform sample while the row is hashed once.
    """
    base = F.conv(F.substring(md5_hex, 1, 8), 16, 10).cast("long")
    return F.pmod(base + turn.cast("long") * F.lit(CIRCLE_STEP), F.lit(CIRCLE))


def crc_order(seed: int, key: Column | str) -> Column:
    """CRC-32 of ``seed:key``, the order in which probe groups are held out."""
    return F.crc32(F.concat_ws(":", F.lit(str(seed)), _as_column(key).cast("string")).cast("binary"))
