"""Hashes that Spark and other SQL engines agree on, and what is drawn from them.

Draws are keyed, not sequential: a row's draw depends on its key and the seed alone, whatever the partitioning.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _cols(parts) -> list[Column]:
    return [p.cast("string") if isinstance(p, Column) else F.lit(str(p)) for p in parts]


def portable_hash(*parts: Column | str | int) -> Column:
    """A number in [0, 2**32) from the MD5 of the parts joined by '|'."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *_cols(parts))), 1, 8), 16, 10).cast("long")


def order_key(*parts: Column | str | int) -> Column:
    """A string to order by: a seeded shuffle."""
    return F.md5(F.concat_ws("|", *_cols(parts)))


def draw(n: Column | int, *parts: Column | str | int) -> Column:
    """A number in [0, n)."""
    return F.pmod(portable_hash(*parts), n if isinstance(n, Column) else F.lit(n))


def surrogate_score(*parts: Column | str | int) -> Column:
    """A stand-in rating from 1 to 10. It checks plumbing, never judgement."""
    return (F.lit(1) + draw(10, *parts)).cast("double")


def normal(*parts: Column | str | int) -> Column:
    """A normal draw, by the Box-Muller rule."""
    u = lambda tag: (draw(1 << 32, *parts, tag) + 0.5) / float(1 << 32)
    return F.sqrt(-2 * F.log(u("a"))) * F.cos(2 * F.pi() * u("b"))
