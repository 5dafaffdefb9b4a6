"""Shards that all have the mixture of the sources, by DataFrame functions alone.

Rows of a source are ranked in a seeded order; the rank over the source's size is a row's place
between 0 and 1, and all rows sorted by place are cut into shards of equal counts.  Ranks come in
two levels (rows before the bucket, then inside it), so no source and no whole table is one window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Hexadecimal digits of a row's hash that name its bucket; places have as many buckets.
DIGITS = 3


def _before(counts: DataFrame, by: list[str], bucket: str) -> DataFrame:
    """Rows in smaller buckets and in all, of counts by bucket (a fixed number of rows for each key)."""
    w = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    return counts.select(*by, bucket, F.sum("c").over(w.orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)).alias("before"), F.sum("c").over(w).alias("total"))


def proportional_shards(docs: DataFrame, shards: int = 8, seed: int = 20) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for each row of ``docs``.

    The law is ``rows``: counts of shards differ by one at most.  size is the bytes of the text plus
    1; a null text has size 1 and the crc32 of nothing, 0.  A null source is a source of its own and a
    null doc_id sorts first.  Rows that agree in all that is sorted by may change places.  An empty table gives an
    empty result; other columns are ignored.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    places = 16**DIGITS
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.concat(F.lit("="), "source"), F.lit("")).alias("stratum"),
        (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"),
        F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))).alias("hash"),
    ).withColumn("bucket", F.substring("hash", 1, DIGITS))
    before = _before(rows.groupBy("stratum", "bucket").agg(F.count("*").alias("c")), ["stratum"], "bucket")
    inside = Window.partitionBy("stratum", "bucket").orderBy("hash", "doc_id", "text_crc32")
    ranked = rows.withColumn("n", F.row_number().over(inside)).join(before, ["stratum", "bucket"])
    rank: Column = F.coalesce("before", F.lit(0)) + F.col("n")
    placed = ranked.select("doc_id", "stratum", "size", "text_crc32", "hash", ((2 * rank - 1) / (2.0 * F.col("total"))).alias("place")).withColumn("bucket", F.floor(F.col("place") * places))
    before = _before(placed.groupBy("bucket").agg(F.count("*").alias("c")), [], "bucket")
    inside = Window.partitionBy("bucket").orderBy("place", "stratum", "hash", "doc_id", "text_crc32")
    at = F.coalesce("before", F.lit(0)) + F.col("n") - 1
    cut = placed.withColumn("n", F.row_number().over(inside)).join(before, "bucket").withColumn("at", at).withColumn("shard", F.expr(f"at * {shards} div total"))
    return cut.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), F.col("shard").cast("int").alias("shard"),
        F.expr(f"at - (shard * total + {shards - 1}) div {shards}").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )
