"""Bits that tell which 64-bit hashed keys may be in a table, small enough to go to every task.

A key sets one of `MAX_BITS` bits or fewer. A bit that is not set proves that the key is not in the table;
one that is set says nothing for sure, so an exact join follows on the rows that pass. The bound holds at
every size: with more keys than bits more rows go on to the join, none is lost.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: 16 MB at most; BITS_A_KEY bits a key below that.
MAX_BITS = 1 << 27
BITS_A_KEY = 32
#: Positions of one bitmap of Spark's functions.
PAGE = 1 << 15


def key_bits(keys: DataFrame, column: str) -> np.ndarray:
    """Bits of the keys in a bigint column of hashes; the length is a power of two."""
    n = keys.count()
    size = PAGE
    while size < min(MAX_BITS, n * BITS_A_KEY):
        size *= 2
    place = F.pmod(F.col(column), F.lit(size))
    pages = keys.select((place / PAGE).cast("int").alias("page"), (place % PAGE).alias("place")).groupBy("page").agg(F.bitmap_construct_agg("place").alias("bits"))
    out = np.zeros(size // 8, np.uint8)
    for row in pages.toLocalIterator():
        at = row["page"] * PAGE // 8
        out[at : at + PAGE // 8] = np.frombuffer(bytes(row["bits"]), np.uint8)
    return out


def may_hold(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which of the keys (64-bit integers) may be in the table."""
    place = keys.astype(np.int64) & np.int64(len(bits) * 8 - 1)
    return (bits[place >> 3] >> (place & 7).astype(np.uint8) & 1).astype(bool)
