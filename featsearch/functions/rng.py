"""Counter-based random numbers.

Every random draw is a hash of a key (seed, purpose, generation, slot, gene),
so results never depend on partitioning or task order, and the same numbers
can be written in plain SQL (see ``u32_sql``).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TWO32 = 4294967296


def _part(p) -> Column:
    if isinstance(p, Column):
        return p.cast("string")
    return F.lit(str(p))


def u32(*parts) -> Column:
    """Unsigned 32-bit hash of the ':'-joined key parts, as BIGINT."""
    key = F.concat_ws(":", *[_part(p) for p in parts])
    return F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("bigint")


def u32_sql(*parts: str) -> str:
    """SQL (DuckDB) text twin of :func:`u32`; parts are SQL expressions."""
    return f"CAST(('0x' || substr(md5(concat_ws(':', {', '.join(parts)})), 1, 8)) AS BIGINT)"


def threshold(rate: float) -> int:
    """Integer threshold t with P(u32 < t) = rate (compare integers, not doubles)."""
    return int(rate * TWO32)
