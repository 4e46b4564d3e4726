"""A bitmap of key hashes that lets most rows of a wide table skip a shuffle.

A join of wide rows (texts) with few keys shuffles every row. Here the keys' hashes set bits of a bitmap of at most
2**MOST_BITS bits, 16 MB, whatever the number of keys; it is broadcast. A row whose bit isn't set surely has no key; only
the others need the exact join, which stays. With more keys than the bitmap can part, more rows take the exact join;
the result is the same.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.runtime import fresh

MOST_BITS, CELL = 27, 1 << 15


def may_match(rows: DataFrame, row_hash: Column, keys: DataFrame, key_hash: Column, to: str = "_may") -> DataFrame:
    """rows with a boolean column `to`: False only where no key has the row's hash. No shuffle of rows. Columns of rows may
    have any names; one named `to` is replaced."""
    h, place_, cell_of, cell, bits_ = fresh((*rows.columns, to), "h", "place", "cell_of", "cell", "bits")
    hashed = keys.select(key_hash.alias(h))
    bits = 1 << max(15, min(MOST_BITS, math.ceil(math.log2(16 * hashed.count() + 1))))
    place = lambda x: F.pmod(F.coalesce(x, F.lit(0).cast("long")), F.lit(bits))
    p = place(F.col(h))
    cells = hashed.groupBy(F.floor(p / CELL).cast("int").alias(cell)).agg(F.bitmap_construct_agg(F.pmod(p, F.lit(CELL))).alias(bits_))
    at = rows.withColumn(place_, place(row_hash)).withColumn(cell_of, F.floor(F.col(place_) / CELL).cast("int"))
    both = at.join(F.broadcast(cells), F.col(cell_of) == F.col(cell), "left")
    bit = F.pmod(F.col(place_), F.lit(CELL)).cast("int")
    octet = F.conv(F.hex(F.substring(bits_, F.floor(bit / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    mask = F.pow(F.lit(2), F.pmod(bit, F.lit(8))).cast("int")
    out = both.withColumn(to, F.coalesce(octet.bitwiseAND(mask) > 0, F.lit(False)))
    return out.drop(place_, cell_of, cell, bits_)
