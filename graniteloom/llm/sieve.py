"""A set of bits that keeps rows without a partner out of an exchange."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The set has two to this power bits, 64 of them in a row: at most 262,144 rows of two numbers (some 10 MB) are broadcast at any size of the data.
BITS = 24


def _place(key: Column, bits: int) -> tuple[Column, Column]:
    b = F.shiftrightunsigned(F.xxhash64(key), 64 - bits)
    return F.shiftright(b, 6), b.bitwiseAND(F.lit(63)).cast("int")


def sieve(keys: DataFrame, key: str, bits: int = BITS) -> DataFrame:
    """(sieve_word, sieve_mask): the hashes of a column as bits; null keys set none."""
    word, bit = _place(F.col(key), bits)
    return keys.where(F.col(key).isNotNull()).select(word.alias("sieve_word"), F.call_function("shiftleft", F.lit(1).cast("long"), bit).alias("m")).groupBy("sieve_word").agg(F.bit_or("m").alias("sieve_mask"))


def marked(rows: DataFrame, key: str, by: DataFrame, name: str, bits: int = BITS) -> DataFrame:
    """``rows`` with a boolean column: false means that ``key`` is certainly not among the keys of ``by``; a null key is never among them.

    Some rows are marked true by chance, about the share of bits that are set. The more keys, the more of these: nothing is ever lost, an exchange is spared only.
    """
    word, bit = _place(F.col(key), bits)
    j = rows.withColumns({"sieve_word": word, "sieve_bit": bit}).join(F.broadcast(by), "sieve_word", "left")
    hit = F.call_function("shiftright", F.col("sieve_mask"), F.col("sieve_bit")).bitwiseAND(F.lit(1)) == 1
    return j.withColumn(name, F.coalesce(hit & F.col(key).isNotNull(), F.lit(False))).drop("sieve_word", "sieve_bit", "sieve_mask")


def sifted(rows: DataFrame, key: str, by: DataFrame, bits: int = BITS) -> DataFrame:
    """The rows that ``marked`` marks true."""
    return marked(rows, key, by, "sieve_hit", bits).where("sieve_hit").drop("sieve_hit")
