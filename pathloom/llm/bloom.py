"""A blocked Bloom filter of 64-bit hashes: built by tasks, held by the driver within a bound, tested in the tasks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A block is one 512-bit cache line of eight 64-bit words; a key sets one bit in each word.
WORDS = 8
BITS_PER_KEY = 16
#: The filter's size has this bound in bytes, enough for 33 million keys; with more it lets more pass, and the join still decides.
MAX_BYTES = 64 << 20
#: Odd multipliers that choose a key's bits, fixed values of split block Bloom filters.
ODD = (0x47B6137B, 0x44974D91, 0x8824AD5B, 0xA2B7289D, 0x705495C7, 0x2DF1424B, 0x9EFC4947, 0x5C6BFB31)


def _set_bits(keys: np.ndarray, blocks: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each hashed key its block, and the bit in each of the block's words."""
    h = keys.view(np.uint64)
    block = ((h >> np.uint64(32)) * np.uint64(blocks)) >> np.uint64(32)
    low = h & np.uint64(0xFFFFFFFF)
    bit = ((low[:, None] * np.array(ODD, np.uint64)) & np.uint64(0xFFFFFFFF)) >> np.uint64(26)
    return block.astype(np.int64), np.uint64(1) << bit


def build(keys: DataFrame, count: int, most: int = MAX_BYTES) -> np.ndarray:
    """The filter of a column ``h`` of 64-bit hashes: tasks fill parts, Spark ors the words of each block.

    Its size follows ``count`` up to ``most`` bytes, so what the driver gets and broadcasts is bounded.
    """
    blocks = max(1, min(most // (WORDS * 8), -(-count * BITS_PER_KEY // (WORDS * 64))))

    def run(batches):
        words = np.zeros((blocks, WORDS), np.uint64)
        for batch in batches:
            block, bits = _set_bits(batch.column(0).to_numpy(), blocks)
            np.bitwise_or.at(words, block, bits)
        used = np.flatnonzero(words.any(axis=1))
        for at in range(0, len(used), 4096):
            some = used[at : at + 4096]
            filled = [pa.array(words[some, w].view(np.int64)) for w in range(WORDS)]
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), *filled], names=["block", *[f"w{w}" for w in range(WORDS)]])

    schema = "block long, " + ", ".join(f"w{w} long" for w in range(WORDS))
    merged = keys.select("h").mapInArrow(run, schema).groupBy("block").agg(*[F.bit_or(f"w{w}").alias(f"w{w}") for w in range(WORDS)])
    out = np.zeros((blocks, WORDS), np.uint64)
    for row in merged.toLocalIterator():
        out[row["block"]] = np.array(row[1:], np.int64).view(np.uint64)
    return out


def may_hold(bloom: np.ndarray, keys: np.ndarray) -> np.ndarray:
    block, bits = _set_bits(np.ascontiguousarray(keys), len(bloom))
    return ((bloom[block] & bits) == bits).all(axis=1)


def tester(listed: DataFrame, key: Column, count: int):
    """A function from a column to whether ``listed`` may hold its value; the filter is broadcast."""
    words = build(listed.select(F.xxhash64(key).alias("h")), count).tobytes()
    held = listed.sparkSession.sparkContext.broadcast(words)

    @F.pandas_udf("boolean")
    def test(column):
        import pandas as pd

        return pd.Series(may_hold(np.frombuffer(held.value, np.uint64).reshape(-1, WORDS), column.to_numpy(np.int64)))

    return lambda column: test(F.xxhash64(column))
