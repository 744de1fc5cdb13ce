"""Column functions over numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def rounded(x: Column, digits: int = 4) -> Column:
    """x to some decimals by its binary value, ties to the even digit, as Python rounds; for sizes below 4, others by their decimals.

    Spark rounds what a double looks like: 0.00015, whose binary value is a little less, goes up there and down here. The value
    times a power of two is a whole number, so what it is above the decimals below it can be told exactly.
    """
    size, one = F.abs(x), 10**digits
    # A double has 53 bits: from 2^-7 on none of them is behind the 60th after the point, from 2^-17 on none behind the 69th.
    small = size < 2.0**-7
    power = F.when(small, F.lit(str(2**69)).cast("decimal(22,0)")).otherwise(F.lit(str(2**60)).cast("decimal(22,0)"))
    whole = F.when(small, size * 2.0**69).otherwise(size * 2.0**60).cast("long").cast("decimal(20,0)")
    down = F.floor(size * one).cast("long")
    rest = whole * F.lit(one).cast("decimal(12,0)") - down.cast("decimal(10,0)") * power
    # The product of doubles may have come out just above or just at the next whole number.
    down = F.when(rest < 0, down - 1).when(rest >= power, down + 1).otherwise(down)
    rest = F.when(rest < 0, rest + power).when(rest >= power, rest - power).otherwise(rest)
    up = F.when(2 * rest > power, 1).when(2 * rest < power, 0).otherwise(down % 2)
    return F.when(size < 4, F.signum(x) * (down + up) / float(one)).otherwise(F.bround(x, digits))
