"""Benchmark decontamination: a prefix-filtered set join of documents with windows of benchmark items.

Every item is cut into windows of `window` consecutive words (an item of fewer words is one window). A
window's tokens are its shingles of up to three words. One scan of the documents finds where shingles of the
benchmark stand. Tokens are ordered by rarity over all documents, and as containment must be whole, the
necessary prefix of a window is its rarest token alone. Documents join on that token; its place gives the only
position the window could have, the length bound drops positions beyond the document, and a window occurs
where each of its tokens stands in its place, which is exact as tokens are compared word by word.
Main path: DataFrame functions only.

Defined results: null or wordless text has no words and is clean; a null item_id counts its hits but not as
an item; repeated document rows each get their own, equal row; repeated items count once; an empty
benchmark leaves every document clean; other columns of either table are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orrery.llm.session import checkpointed, packed, unpacked
from orrery.llm.textkit import words

SHINGLE = 3
#: Windows that one scan of the documents takes; their shingles are broadcast. More go in blocks.
BLOCK_WINDOWS = 200_000


def benchmark_windows(benchmark: DataFrame, window: int = 10) -> DataFrame:
    """Distinct windows (their words, joined by blanks), their words and the ids of the items that hold them."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item"), words(F.col("text").cast("string")).alias("w")).where(F.size("w") > 0)
    length = F.least(F.size("w"), F.lit(window))
    cut = items.select("item", "w", length.alias("length"), F.explode(F.sequence(F.lit(0), F.size("w") - length)).alias("at"))
    cut = cut.select("item", F.slice("w", F.col("at") + 1, F.col("length")).alias("words"))
    return cut.groupBy(F.concat_ws(" ", "words").alias("window")).agg(F.first("words").alias("words"), F.collect_set("item").alias("items"))


def _tokens(windows: DataFrame) -> DataFrame:
    """The shingles of each window: their words and the word where they begin."""
    n = F.least(F.size("words"), F.lit(SHINGLE))
    at = F.explode(F.sequence(F.lit(0), F.size("words") - n)).alias("offset")
    cut = windows.select("window", "words", n.alias("n"), at)
    return cut.select("window", F.size("words").alias("length"), "n", "offset", F.slice("words", F.col("offset") + 1, F.col("n")).alias("token"))


def _hash(n: int, word) -> Column:
    return F.xxhash64(F.lit(n), *(word(j) for j in range(n)))


def token_places(documents: DataFrame, tokens: DataFrame, sizes: list[int]) -> DataFrame:
    """A row for each document (at = -1), and for each place of a token in one."""
    token_hash = F.lit(None)
    for n in sizes:
        token_hash = F.when(F.col("n") == n, _hash(n, lambda j: F.get("token", F.lit(j)))).otherwise(token_hash)
    wanted = tokens.select("token", token_hash.alias("hash"), F.col("n").alias("size")).distinct()
    docs = documents.select("doc_id", F.xxhash64("text").alias("text_key"), words(F.col("text")).alias("w"))
    # posexplode_outer: posexplode adds a filter on its array, for which the words would be made twice.
    rows = docs.select("doc_id", "text_key", "w", F.posexplode_outer(F.concat(F.array(F.lit("")), "w")).alias("next", "word"))
    at = F.col("next") - 1
    hashes = [_hash(n, lambda j: F.get("w", at + j)) for n in sizes]
    if len(sizes) == 1:
        rows = rows.withColumn("which", F.lit(0)).withColumn("hash", hashes[0])
    else:
        rows = rows.select("*", F.posexplode_outer(F.array(*hashes)).alias("which", "hash"))
    found = rows.join(F.broadcast(wanted), "hash", "left")
    is_document = (F.col("next") == 0) & (F.col("which") == 0)
    is_token = (F.col("next") > 0) & F.coalesce(F.slice("w", F.greatest(at, F.lit(0)) + 1, F.col("size")) == F.col("token"), F.lit(False))
    found = found.where(is_document | is_token)
    return found.select("doc_id", "text_key", F.size("w").alias("n_words"), at.alias("at"), F.when(F.col("next") > 0, F.col("token")).alias("token"))


def occurrences(documents: DataFrame, windows: DataFrame, sizes: list[int]) -> DataFrame:
    """A row for each document (window null), and for each occurrence of a window in one: begin and end."""
    tokens = checkpointed(_tokens(windows))
    places = checkpointed(token_places(documents, tokens, sizes))
    here = places.where(F.col("at") >= 0)
    rarity = here.groupBy("token").agg(F.count("*").alias("seen"))
    ranked = tokens.join(rarity, "token", "left").groupBy("window").agg(F.min(F.struct(F.coalesce("seen", F.lit(0)).alias("seen"), "offset", "token", "length")).alias("prefix"), F.count("*").alias("n_tokens"))
    prefix = F.broadcast(ranked.select("window", "prefix.token", "prefix.offset", "prefix.length", "n_tokens"))
    begin = F.col("at") - F.col("offset")
    candidates = here.join(prefix, "token").where((begin >= 0) & (begin + F.col("length") <= F.col("n_words"))).select("doc_id", "text_key", "n_words", "window", "length", "n_tokens", begin.alias("begin"))
    needed = candidates.distinct().join(F.broadcast(tokens.select("window", "offset", F.col("token").alias("need"))), "window")
    needed = needed.select("doc_id", "text_key", "n_words", "window", "length", "n_tokens", "begin", (F.col("begin") + F.col("offset")).alias("at"), F.col("need").alias("token"))
    stands = here.select("doc_id", "text_key", "at", "token").distinct()
    whole = needed.join(stands, [needed["doc_id"].eqNullSafe(stands["doc_id"]), *(needed[c] == stands[c] for c in ("text_key", "at", "token"))], "left_semi")
    keys = ["doc_id", "text_key", "n_words", "window", "begin", "length", "n_tokens"]
    whole = whole.groupBy(*keys).agg(F.count("*").alias("n")).where(F.col("n") == F.col("n_tokens"))
    hits = whole.join(F.broadcast(windows.select("window", "items")), "window").select("doc_id", "text_key", "n_words", "begin", (F.col("begin") + F.col("length")).alias("end"), "items")
    docs = places.where(F.col("at") < 0).select("doc_id", "text_key", "n_words", F.lit(None).cast("int").alias("begin"), F.lit(None).cast("int").alias("end"), F.lit(None).cast("array<string>").alias("items"))
    return docs.unionByName(hits)


def contamination(documents: DataFrame, benchmark: DataFrame, window: int = 10, block_windows: int = BLOCK_WINDOWS) -> DataFrame:
    """Per document: doc_id, text_key, n_words, n_hit, item_ids (sorted strings), contaminated."""
    documents = documents.select("doc_id", F.col("text").cast("string").alias("text"))
    windows = checkpointed(benchmark_windows(benchmark, window))
    sizes = sorted(r[0] for r in windows.select(F.least(F.size("words"), F.lit(SHINGLE))).distinct().collect()) or [SHINGLE]
    blocks = -(-windows.count() // block_windows) or 1
    of = F.pmod(F.xxhash64("window"), F.lit(blocks))
    rows = reduce(DataFrame.unionAll, (occurrences(documents, windows.where(of == b) if blocks > 1 else windows, sizes) for b in range(blocks)))
    per = rows.groupBy("doc_id", "text_key", "n_words").agg(
        (F.count_if(F.col("begin").isNull()) / blocks).cast("int").alias("copies"),
        F.array_sort(F.collect_set(F.when(F.col("begin").isNotNull(), F.struct("begin", "end")))).alias("spans"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("item_ids"),
    )
    zero = F.struct(F.lit(0).alias("n"), F.lit(0).alias("to"))
    covered = F.aggregate("spans", zero, lambda a, s: F.struct((a["n"] + F.greatest(F.lit(0), s["end"] - F.greatest(s["begin"], a["to"]))).alias("n"), F.greatest(a["to"], s["end"]).alias("to")))["n"]
    per = per.withColumn("n_hit", covered).withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    return per.select("doc_id", "text_key", F.col("n_words").cast("long"), F.col("n_hit").cast("long"), "item_ids", (F.col("n_hit") > 0).alias("contaminated"))


def decontaminated(documents: DataFrame, benchmark: DataFrame, window: int = 10) -> DataFrame:
    """The documents without those that hold a benchmark window; all their columns stay."""
    bad = contamination(documents, benchmark, window).where("contaminated").select(F.col("doc_id").alias("bad_id"), F.col("text_key").alias("bad_key")).distinct()
    rows = packed(documents, F.col("doc_id").alias("id"), F.xxhash64(F.col("text").cast("string")).alias("key"))
    return unpacked(rows.join(bad, rows["id"].eqNullSafe(bad["bad_id"]) & (rows["key"] == bad["bad_key"]), "left_anti"), documents.columns)
