"""Sharding by extendible hashing: only oversized buckets split, on one more bit of the hash.

A document's hash is the MD5 of its id. The directory is indexed by the first BITS bits: bytes are summed for
each of its entries (at most 2^BITS rows, whatever the input), and each entry gets the least depth at which
the bytes of all that share that many bits fit the limit. Entries that are oversized at BITS bits are split
again on the next BITS bits of the hash, among their own documents alone, and so on. Documents that agree in
all bits (repeated ids) are told apart by their text's hash, and rows repeated whole by pages of the limit.

Defined results: null text has 0 bytes; null ids hash as an empty string; a document larger than the limit
has a shard alone, or with others of 0 bytes; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from orrery.llm.session import checkpointed, packed

LIMIT_BYTES = 1 << 20
BITS = 16
ROUNDS = 128 // BITS


def _bits(digest: Column) -> Column:
    """The digest's 128 bits as a string of 0 and 1."""
    halves = [F.lpad(F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 2), 32, "0") for i in range(4)]
    return F.concat(*halves)


def directory(sizes: DataFrame, limit: int, taken: int) -> DataFrame:
    """Of `sizes` (prefix of `taken` + BITS bits, bytes): the shard of each prefix, null where it must split further."""
    levels = sizes.select("prefix", "bytes", F.explode(F.sequence(F.lit(taken), F.lit(taken + BITS))).alias("depth"))
    held = levels.withColumn("shard", F.substring("prefix", F.lit(1), F.col("depth")))
    fits = held.groupBy("shard", "depth").agg(F.sum("bytes").alias("total")).where(F.col("total") <= limit)
    found = held.join(fits.select("shard", "depth"), ["shard", "depth"]).groupBy("prefix").agg(F.min(F.struct("depth", "shard"))["shard"].alias("shard"))
    return sizes.select("prefix").join(found, "prefix", "left")


def placed(documents: DataFrame, limit: int = LIMIT_BYTES) -> DataFrame:
    """`row`, the columns of `documents`, with bytes, shard (the bits that lead to it) and page (0 but for repeated rows)."""
    text = F.col("text").cast("string")
    digest = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    rest = packed(documents, F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("bytes"), _bits(digest).alias("bits"), F.md5(F.coalesce(text, F.lit(""))).alias("text_key"))
    done = None
    for taken in range(0, ROUNDS * BITS, BITS):
        keyed = rest.withColumn("prefix", F.substring("bits", 1, taken + BITS))
        # At most 2^BITS entries, so small enough to send to every task; deeper rounds hold only what is oversized.
        entries = checkpointed(directory(keyed.groupBy("prefix").agg(F.sum("bytes").alias("bytes")), limit, taken))
        found = keyed.join(F.broadcast(entries) if not taken else entries, "prefix")
        settled = found.where("shard is not null").select("row", "bytes", "shard", F.lit(0).cast("long").alias("page"))
        done = settled if done is None else done.unionAll(settled)
        full = entries.where("shard is null").count()
        if not full:
            return done
        rest = checkpointed(found.where("shard is null").drop("prefix", "shard"))
        if rest.select("bits").distinct().count() == full and rest.select("bits", "text_key").distinct().count() == full:
            break  # no bit tells these apart
    return done.unionAll(_pages(rest, limit).select("row", "bytes", "shard", "page"))


def _pages(rest: DataFrame, limit: int) -> DataFrame:
    """Documents that no bit of their id's hash tells apart, by their text's hash and then by running size, dealt over 64 tasks."""
    dealt = rest.withColumn("shard", F.concat("bits", F.lit("-"), F.substring("text_key", 1, 8))).withColumn("deal", F.pmod(F.monotonically_increasing_id(), F.lit(64)))
    part = Window.partitionBy("shard", "deal")
    before = F.sum("bytes").over(part.orderBy("text_key").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("bytes")
    page = F.floor(before / F.greatest(F.lit(limit) - F.max("bytes").over(part), F.lit(1))) * 64 + F.col("deal")
    return dealt.withColumn("page", page.cast("long"))


def shards(documents: DataFrame, limit: int = LIMIT_BYTES) -> DataFrame:
    """Per document: doc_id, bytes, shard, page."""
    return placed(documents.select("doc_id", "text"), limit).select("row.doc_id", "bytes", "shard", "page")


def write_shards(documents: DataFrame, path: str, limit: int = LIMIT_BYTES) -> None:
    """Write the documents by shard and page, each to a folder of its own; the folders' names, shard_bits and shard_page, are refused as columns."""
    if clash := {"shard_bits", "shard_page"} & {c.lower() for c in documents.columns}:
        raise ValueError(f"the documents have columns named {sorted(clash)}")
    out = placed(documents, limit).select(*(F.col("row").getField(c).alias(c) for c in documents.columns), F.col("shard").alias("shard_bits"), F.col("page").alias("shard_page"))
    out.repartition("shard_bits", "shard_page").write.partitionBy("shard_bits", "shard_page").parquet(path)
