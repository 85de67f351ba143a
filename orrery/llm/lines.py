"""Line dedup by distinct-site spread: lines that many sites share stay in one document alone.

Each line's sites are counted in a HyperLogLog sketch, made for each partition and merged by aggregation.
Lines whose estimate lies near the threshold are counted exactly; the others are decided by the sketch. A line
on `min_sites` sites or more is boilerplate: its first occurrence stays (least doc_id, nulls last, then position) and all
others go. Lines are compared without leading and trailing blanks; blank lines are never boilerplate.

Defined results: null text has no lines and stays null; a null site counts as no site; rows repeated whole are
treated alike, so each keeps a first occurrence; a document all of whose lines go keeps its row with an empty
text; other columns stay.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.llm.session import broadcast_if_small, checkpointed, packed

MIN_SITES = 5
LOG2_REGISTERS = 12
#: Estimates this far from the threshold, as a share and at least in sites, are settled by exact counts.
NEAR_SHARE, NEAR_SITES = 0.1, 1.5
#: Tables of so many line hashes, of less than 100 bytes each, are broadcast; larger ones are joined by shuffle.
BROADCAST_LINES = 200_000


def boilerplate(lines: DataFrame, min_sites: int = MIN_SITES) -> DataFrame:
    """Of `lines` (line, site, doc_id, at), those on min_sites sites or more, with their first doc_id and position."""
    per = lines.groupBy("line").agg(F.hll_sketch_agg("site", F.lit(LOG2_REGISTERS)).alias("sketch"), F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "at")).alias("first"))
    sized = checkpointed(per.select("line", "first", F.hll_sketch_estimate("sketch").alias("sites")).where(F.col("sites") >= min_sites - max(NEAR_SITES, NEAR_SHARE * min_sites)))
    near = F.col("sites") <= min_sites + max(NEAR_SITES, NEAR_SHARE * min_sites)
    doubtful = broadcast_if_small(sized.where(near).select("line"), BROADCAST_LINES)
    exact = lines.join(doubtful, "line", "left_semi").select("line", "site").distinct().groupBy("line").agg(F.count("site").alias("exact")).where(F.col("exact") >= min_sites)
    return checkpointed(sized.where(~near).select("line", "first").unionAll(sized.where(near).join(exact, "line", "left_semi").select("line", "first")))


def spread_lines(documents: DataFrame, min_sites: int = MIN_SITES, site: str = "source") -> DataFrame:
    """`row`, the columns of `documents`, with text (the lines that stay), lines and removed (how many there were and went)."""
    # Lines stand in for the text from here on: joined by line ends they are the text again.
    text = F.col("text").cast("string")
    rows = packed(documents, F.split(text, "\n").alias("split"), F.col("doc_id").alias("doc"), F.md5(text).alias("key"), F.col(site).cast("string").alias("site"), without=("text",))
    pieces = rows.select(F.col("doc").alias("doc_id"), "key", "site", F.posexplode("split").alias("at", "line"))
    lines = pieces.withColumn("line", F.trim("line")).where("line != ''").withColumn("line", F.unhex(F.md5("line")))
    common = broadcast_if_small(boilerplate(lines.select("line", "site", "doc_id", "at"), min_sites), BROADCAST_LINES)
    again = lines.select("doc_id", "key", "at", "line").join(common, "line").where(~(F.col("first.doc_id").eqNullSafe(F.col("doc_id")) & (F.col("first.at") == F.col("at"))))
    gone = again.groupBy("doc_id", "key").agg(F.collect_set("at").alias("gone")).withColumnsRenamed({"doc_id": "gone_doc", "key": "gone_key"})
    joined = rows.join(gone, rows["doc"].eqNullSafe(gone["gone_doc"]) & (rows["key"] == gone["gone_key"]), "left")
    n = F.coalesce(F.size("split"), F.lit(0))
    kept = F.array_except(F.sequence(F.lit(0), n - 1), "gone")
    whole = F.when(F.col("split").isNotNull(), F.concat_ws("\n", "split"))
    left = F.when(F.col("gone").isNull(), whole).otherwise(F.concat_ws("\n", F.transform(kept, lambda i: F.get("split", i))))
    row = F.struct(*(whole.cast(documents.schema["text"].dataType).alias("text") if c == "text" else F.col("row").getField(c).alias(c) for c in documents.columns))
    return joined.select(row.alias("row"), left.alias("text"), n.alias("lines"), F.coalesce(F.when(F.col("gone").isNotNull(), F.size("gone")), F.lit(0)).alias("removed"))


def without_spread_lines(documents: DataFrame, min_sites: int = MIN_SITES) -> DataFrame:
    """The documents with repeated boilerplate lines taken out of their texts; n_chars follows."""
    out = spread_lines(documents, min_sites)
    own = {c: F.col("row").getField(c) for c in documents.columns}
    own["text"] = F.col("text").cast(documents.schema["text"].dataType)
    if "n_chars" in own:
        own["n_chars"] = F.when(F.col("removed") > 0, F.length("text")).otherwise(own["n_chars"]).cast(documents.schema["n_chars"].dataType)
    return out.select(*(own[c].alias(c) for c in documents.columns))
