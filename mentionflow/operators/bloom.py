"""A Bloom filter of keys, to drop rows without a partner before their wide columns are shuffled.

It never drops a row whose key is in it, and lets some others pass, so an exact join follows. Its
size follows the number of keys up to a bound; beyond that more rows pass.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS_PER_KEY = 12
MOST_BITS = 1 << 23
LEAST_BITS = 1 << 10
HASHES = 4


def _places(key: Column, bits: int) -> list[Column]:
    return [F.pmod(F.xxhash64(key, F.lit(n)), F.lit(bits)) for n in range(HASHES)]


def bloom_filter(keys: DataFrame, key: str, most_bits: int = MOST_BITS) -> Callable[[Column], Column]:
    """A condition on a column: whether its value, NULL included, may be one of ``keys``. Reads ``keys``
    twice; at most ``most_bits`` go through the driver into the plan."""
    wanted = BITS_PER_KEY * keys.count()
    bits = LEAST_BITS
    while bits < min(wanted, most_bits):
        bits *= 2
    set_bits = keys.select(F.explode(F.array(*_places(F.col(key), bits))).alias("p"))
    word = F.bit_or(F.expr("shiftleft(1L, cast(p % 64 as int))")).alias("word")
    rows = set_bits.groupBy(F.floor(F.col("p") / 64).alias("at")).agg(word).toArrow()
    words = np.zeros(bits // 64, "<i8")
    words[rows["at"].to_numpy()] = rows["word"].to_numpy()
    packed = F.split(F.lit(",".join(map(str, words.tolist()))), ",").cast("array<bigint>")  # made once, by the optimizer

    def may_have(value: Column) -> Column:
        found = F.lit(True)
        for place in _places(value, bits):
            word = F.get(packed, F.shiftright(place, 6).cast("int"))
            found = found & (F.call_function("getbit", word, F.pmod(place, F.lit(64)).cast("int")) == 1)
        return found

    return may_have
