"""A set of numbers as one bitmap of fixed size, small enough to send to every task whatever the corpus holds.

A number's remainder is its bit, so a number that was never put in may seem to be there: callers do more work for it, and give the same result.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits of a bitmap (16 MiB), and how many of them Spark's own bitmaps hold each.
BITS, _MAP = 1 << 27, 1 << 15


def bitmap(rows: DataFrame, number: Column) -> np.ndarray:
    """The bytes of the bitmap of the long column ``number``; at most BITS / _MAP rows come to the driver."""
    at = F.pmod(number, F.lit(BITS)) + 1
    maps = rows.groupBy(F.bitmap_bucket_number(at).alias("at")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("bits"))
    out = np.zeros((BITS // _MAP, _MAP // 8), dtype=np.uint8)
    for r in maps.toLocalIterator():
        out[r["at"] - 1] = np.frombuffer(r.bits, dtype=np.uint8)
    return out.ravel()


def there(bits: np.ndarray, number: np.ndarray) -> np.ndarray:
    at = number & (BITS - 1)
    return (bits[at >> 3] >> (at & 7).astype(np.uint8) & 1) == 1
