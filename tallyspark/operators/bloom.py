"""A Bloom filter as a table: built by one aggregation, probed in a join, of a set size.

The filter has ``BLOCKS`` blocks of 2^15 bits. A key's hash names its block and ``PROBES`` bits in
it, so a probe meets one row of the filter. However many keys it is built from, it holds at
most 16 MB, which is the proven bound of its broadcast; with more keys (some 10 million for one
false hit in a hundred) it only lets more false hits through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLOCKS = 1 << 12
PROBES = 3


def _block(key: Column) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(BLOCKS)).cast("int")


def _bits(key: Column) -> list[Column]:
    """Bit numbers of a key in its block, 15 bits each of a second hash."""
    h = F.xxhash64(F.lit(1), key)
    return [F.shiftrightunsigned(h, 15 * k).bitwiseAND(F.lit((1 << 15) - 1)) for k in range(PROBES)]


def build(df: DataFrame, key: Column) -> DataFrame:
    """(_block, _words): each block's bits as 512 longs. Null keys are left out."""
    rows = df.select(key.alias("_key")).where("_key IS NOT NULL")
    bits = rows.select(_block(F.col("_key")).alias("_block"), F.explode(F.array(*_bits(F.col("_key")))).alias("_bit"))
    blocks = bits.groupBy("_block").agg(F.bitmap_construct_agg("_bit").alias("_bytes"))
    # bit p is bit p % 8 of byte p / 8; eight bytes are read as one number, the first byte highest
    word = F.transform(F.sequence(F.lit(0), F.lit(511)), lambda i: F.conv(F.hex(F.substring(F.col("_bytes"), i * 8 + 1, F.lit(8))), 16, -10).cast("long"))
    return blocks.select("_block", word.alias("_words"))


def may_hold(df: DataFrame, blocks: DataFrame, key: str) -> DataFrame:
    """The rows whose ``key`` may be one that the filter was built from: all that are, few others."""
    bits = [f"_bloom{k}" for k in range(PROBES)]
    asked = df.select("*", _block(F.col(key)).alias("_block"), *[b.alias(n) for b, n in zip(_bits(F.col(key)), bits, strict=True)])
    hit = F.lit(True)
    for n in bits:
        place = (7 - F.shiftright(F.col(n), 3).bitwiseAND(F.lit(7))) * 8 + F.col(n).bitwiseAND(F.lit(7))
        hit = hit & (F.getbit(F.get("_words", F.shiftright(F.col(n), 6).cast("int")), place.cast("int")) == 1)
    return asked.join(F.broadcast(blocks), "_block").where(hit).select(*df.columns)
