"""Keyed permutations of 0 .. n-1 as column arithmetic.

A place is written as (left, right) in a grid of about sqrt(n) by sqrt(n), and four rounds add to
one side a keyed digest of the other: a bijection of the grid for every key (a Feistel network).  A
result outside 0 .. n-1 is fed in again until it falls inside; it can stay outside for fewer steps than the grid
has cells beyond n, which is less than sqrt(n) + 1, and each step leads inside with probability
1 - 1/sqrt(n) at least, so ``WALK`` steps always do below 4,000 rows and fail with
probability below 2^-380 above; a failure is an error, never a wrong place.

With one rank per row, any number of permutations needs no further sort or shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ROUNDS, WALK = 4, 64


def grid(n: Column) -> tuple[Column, Column]:
    """Sides of the smallest such grid: ceil(sqrt(n)) columns, and rows enough for n."""
    root = F.ceil(F.sqrt(n.cast("double")))
    return F.ceil(n / root).cast("long"), root.cast("long")


def _round_trip(x: Column, key: Column, rows: Column, columns: Column) -> Column:
    """All rounds: a fold over round numbers, so that every digest is taken once."""

    def turn(side: Column, number: Column) -> Column:
        even = number % 2 == 0
        seen = F.when(even, side["right"]).otherwise(side["left"])
        text = F.concat_ws("", key, F.lit("/"), number.cast("string"), F.lit(":"), seen.cast("string"))
        drawn = F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")
        return F.struct(
            F.when(even, (side["left"] + drawn) % rows).otherwise(side["left"]).alias("left"),
            F.when(even, side["right"]).otherwise((side["right"] + drawn) % columns).alias("right"),
        )

    first = F.struct(F.floor(x / columns).cast("long").alias("left"), (x % columns).alias("right"))
    return F.aggregate(F.array(*[F.lit(k) for k in range(ROUNDS)]), first, turn, lambda s: s["left"] * columns + s["right"])


def permuted(place: Column, n: Column, key: Column) -> Column:
    """Where the permutation ``key`` (a string column) of ``n`` places puts the 0-based ``place``."""

    def of_row(row: Column) -> Column:
        n, key, rows, columns = (row[c] for c in ("n", "key", "rows", "columns"))

        def walked(once: Column) -> Column:
            again = F.aggregate(F.sequence(F.lit(1), F.lit(WALK)), once, lambda x, _: F.when(x < n, x).otherwise(_round_trip(x, key, rows, columns)))
            return F.when(once < n, once).otherwise(again)

        return F.element_at(F.transform(F.array(_round_trip(row["place"], key, rows, columns)), walked), 1)

    # Wrapped in one-element arrays, so that no value is computed again where it is used.
    rows, columns = grid(n)
    row = F.struct(place.cast("long").alias("place"), n.alias("n"), key.alias("key"), rows.alias("rows"), columns.alias("columns"))
    found = F.transform(F.array(row), of_row)
    lost = F.raise_error(F.lit("a keyed permutation did not come back")).cast("long")
    return F.element_at(F.transform(found, lambda x: F.when(x < n, x).otherwise(lost)), 1)


def permuted_sql(source: str, out: str) -> str:
    """The same as recursive common table expressions (DuckDB): ``source`` has ``place``, ``n`` and ``perm_key``; ``out`` adds ``landed``."""
    text = lambda number, side: f"CAST('0x' || substr(md5(perm_key || '/{number}:' || {side}), 1, 8) AS BIGINT)"
    step = f"""SELECT * EXCLUDE (l0, r0, l1, r1, l2, x, step), step + 1 AS step, l2 * c + (r1 + {text(3, 'l2')}) % c AS x
    FROM (SELECT *, (l1 + {text(2, 'r1')}) % g AS l2
      FROM (SELECT *, (r0 + {text(1, 'l1')}) % c AS r1
        FROM (SELECT *, (l0 + {text(0, 'r0')}) % g AS l1
          FROM (SELECT *, x // c AS l0, x % c AS r0 FROM {out}_walk WHERE step = 0 OR x >= n))))"""
    return f"""{out}_sides AS (SELECT *, CAST(ceil(sqrt(n)) AS BIGINT) AS c, CAST(ceil(n / ceil(sqrt(n))) AS BIGINT) AS g FROM {source}),
{out}_walk AS (SELECT *, 0 AS step, place AS x FROM {out}_sides UNION ALL {step}),
{out} AS (SELECT * EXCLUDE (x, step, c, g), x AS landed FROM {out}_walk WHERE step > 0 AND x < n)"""
