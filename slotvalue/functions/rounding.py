"""Rounding of shares by their exact binary value.

``round`` and ``bround`` work on the shortest decimal form of a double, so 0.925 counts as a
tie although its binary value lies above it.  Scores that are compared with each other must
follow the binary value, as C and most languages do.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def scaled_share(share: Column, digits: int) -> Column:
    """``share * 10**digits`` as a bigint, exact, halves to even; for shares from 0 to 1.

    The share times 2**62 is a whole number (below 2**-10 up to less than one unit, where no
    ties exist), and the rest of the computation is in decimals.
    """
    scaled = (share * F.lit(2.0**62)).cast("bigint").cast("decimal(20,0)") * F.lit(10**digits)
    unit, half = F.lit(2**62), F.lit(2**61)
    rest = scaled % unit
    down = ((scaled - rest) / unit).cast("bigint")
    up = (rest > half) | ((rest == half) & (down % 2 == 1))
    return down + up.cast("int")


def round_share(share: Column, digits: int) -> Column:
    return scaled_share(share, digits) / F.lit(10**digits)


def six_decimals(share: Column) -> Column:
    """A share printed with ``%.6f``."""
    micro = scaled_share(share, 6)
    return F.format_string("%d.%06d", F.floor(micro / 1_000_000), micro % 1_000_000)
