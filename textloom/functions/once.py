"""One row a key, without moving the rows of keys that stand alone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BITS = 22  # the filter of repeated keys has 2^22 bits, in at most 2^16 words, whatever the input


def once(df: DataFrame, keys: list[str]) -> DataFrame:
    """df with one row of each key; rows of equal key are taken to be equal. What is shuffled are 8-byte hashes of all keys, and whole
    rows only where the key's bit is set in a filter of the repeated ones: those of repeated keys and the few that share a bit
    with them. The filter is broadcast; its size is fixed. Null keys count as equal. The input is scanned three times, once for
    its keys alone."""
    hashed = F.xxhash64(*[F.col(f"`{k}`") for k in keys])
    place = F.pmod(F.col("__h"), F.lit(1 << BITS))
    repeated = df.select(hashed.alias("__h")).groupBy("__h").count().filter("count > 1")
    words = repeated.select(place.alias("__p")).groupBy(F.shiftrightunsigned("__p", 6).alias("__w")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.col("__p"), F.lit(64)).cast("int"))).alias("__b"))
    looked = df.withColumn("__h", hashed).withColumn("__p", place).join(F.broadcast(words), F.shiftrightunsigned("__p", 6) == F.col("__w"), "left")
    doubtful = F.coalesce(F.call_function("shiftrightunsigned", F.col("__b"), F.pmod(F.col("__p"), F.lit(64)).cast("int")).bitwiseAND(F.lit(1)) == 1, F.lit(False))
    marked = looked.withColumn("__d", doubtful).drop("__h", "__p", "__w", "__b")
    return marked.filter(~F.col("__d")).drop("__d").unionByName(marked.filter("__d").drop("__d").dropDuplicates(keys))
