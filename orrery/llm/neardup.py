"""MinHash near-duplicates: DartMinHash signatures, banded joins, exact verification, connected classes.

A text's elements are its shingles of five words. Every element owns the plane of weight and rank; darts fall
on it as a Poisson process that depends on the element alone, so equal elements get equal darts. A text keeps
the darts below its elements' weights, deals them over COORDINATES by a hash, and its signature holds the
earliest dart of each: two texts agree in a coordinate with the probability of their (weighted) Jaccard
similarity. Only ranks below about k ln k darts' worth are thrown, whatever the text's length; texts with an
empty coordinate throw again with twice the ranks. `weights` is "set" (each shingle 1) or "count".

Exact copies share one node. Nodes join on BANDS bands of ROWS coordinates. In every bucket the member met by
most others leads, and each member is verified against it, so a bucket of n copies costs n - 1 pairs. Members
that links connect need no more. Texts of buckets that still hold several classes meet once more, across classes
alone, in a prefix-filtered set join: their shingles are ordered by rarity, those that one class alone has
coming first as no link can use them; a text offers only the few that a link cannot do without, and lengths
and places rule out most pairs that meet. What is left is verified and joins classes. So every pair that
shares a bucket is verified, ruled out or already in one class, without a cap.

A link is a similarity of shingle sets of at least `similarity`, shingles being compared by 64-bit hashes.
Shingle sets are cut once, for the texts that share a bucket.

Defined results: null text is empty; texts without words are copies of each other and link to nothing else;
a text of fewer than five words has one shingle of all of them; the class id is the least doc_id of the class,
null only if all of its are; the document kept is the one with the least (doc_id, text digest), nulls last;
repeated rows are one document for keeping; other columns stay as they are.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orrery.llm.session import checkpointed, join_hot, packed, released, unpacked
from orrery.llm.textkit import WORDS, mix, ngrams, seeded, slices, token_hashes

SHINGLE = 5
BANDS, ROWS = 24, 5
COORDINATES = BANDS * ROWS
#: Texts whose darts, about COORDINATES ln COORDINATES each however short the text, are in memory together.
SLICE_TEXTS = 512


def _poisson_table(mean: float) -> np.ndarray:
    """P(at most n) for n = 0, 1, ..."""
    p, total, out = math.exp(-mean), 0.0, []
    for n in range(int(mean + 12 * math.sqrt(mean) + 20)):
        total += p
        out.append(total)
        p *= mean / (n + 1)
    return np.array(out)


def _unit(x: np.ndarray) -> np.ndarray:
    return (x >> np.uint64(11)) * (1.0 / (1 << 53))


def _darts(element: np.ndarray, weight: np.ndarray, highest: np.ndarray):
    """All darts under the elements' weights and below their texts' highest ranks: index of the element, rank, dart's hash."""
    wide, tall = int(math.log2(1 + weight.max())), int(math.log2(1 + highest.max()))
    for v in range(wide + 1):
        for r in range(tall + 1):
            left, low, side, height = (1 << v) - 1, (1 << r) - 1, 1 << v, 1 << r
            owner = np.flatnonzero((weight > left) & (highest > low))
            cell = seeded(element[owner], 1000 * v + r)
            # Cells are halved until few darts are expected in each, so that exp(-mean) stays well above 0.
            parts = max(1, side * height // 16)
            for part in range(parts):
                own = cell if parts == 1 else seeded(cell, part)
                n = np.searchsorted(_poisson_table(side * height / parts), _unit(own))
                at = np.repeat(np.arange(owner.size), n)
                dart = mix(own[at] + np.arange(at.size).astype(np.uint64) - np.repeat(np.cumsum(n) - n, n).astype(np.uint64) + np.uint64(1))
                rank = low + height * (part + _unit(dart)) / parts
                keep = (rank < highest[owner[at]]) & (left + side * _unit(seeded(dart, 1)) < weight[owner[at]])
                yield owner[at[keep]], rank[keep], dart[keep]


def signatures(shingle: np.ndarray, text: np.ndarray, weight: np.ndarray, texts: int, k: int = COORDINATES) -> np.ndarray:
    """Rank bits of the earliest dart in each coordinate, a row for each text; all ones for texts without shingles."""
    out = np.full(texts * k, np.inf)
    total = np.bincount(text, weight, texts)
    aim = k * (math.log(k) + 2)
    live = total > 0
    ranks = np.where(live, aim / np.maximum(total, 1e-300), 0)
    while live.any():
        rows = np.flatnonzero(live[text])
        for owner, rank, dart in _darts(shingle[rows], weight[rows], ranks[text[rows]]):
            coordinate = (seeded(dart, 2) % np.uint64(k)).astype(np.int64)
            np.minimum.at(out, text[rows[owner]] * k + coordinate, rank)
        live &= np.isinf(out.reshape(texts, k)).any(axis=1)
        ranks = ranks * 2
    return out.view(np.uint64).reshape(texts, k)


def _elements(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct shingles of each text, their texts and how often they occur there."""
    shingle, text = ngrams(*token_hashes(data, offsets, WORDS), SHINGLE, short=True)
    _, first, times = np.unique(mix(shingle + seeded(text.astype(np.uint64), 5)), return_index=True, return_counts=True)
    return shingle[first], text[first], times.astype(float)


def sketches(texts: DataFrame, weights: str = "set", bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """`texts` (key, doc_id, text) as key, doc_id, n (distinct shingles) and the hashes of the bands; null for texts without words."""

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in slices(batch.column(2), most=SLICE_TEXTS):
                shingle, text, times = _elements(data, offsets)
                weight = times if weights == "count" else np.ones(times.size)
                sign = signatures(shingle, text, weight, hi - lo, bands * rows).reshape(hi - lo, bands, rows)
                band = np.tile(np.arange(bands, dtype=np.uint64), (hi - lo, 1))
                for j in range(rows):
                    band = mix(band + sign[:, :, j] + np.uint64(j + 1))
                n = np.bincount(text, minlength=hi - lo)
                found = pa.array([x if m else None for x, m in zip(band.view(np.int64), n, strict=True)], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), batch.column(1).slice(lo, hi - lo), pa.array(n), found], names=["key", "doc_id", "n", "bands"])
        released()

    return texts.mapInArrow(sketch, "key binary, doc_id long, n long, bands array<long>")


def shingle_sets(texts: DataFrame) -> DataFrame:
    """`texts` (key, text) as key and the hashes of the distinct shingles."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in slices(batch.column(1)):
                shingle, text, _ = _elements(data, offsets)
                order = np.argsort(text, kind="stable")
                bounds = np.searchsorted(text[order], np.arange(hi - lo + 1)).astype(np.int32)
                sets = pa.ListArray.from_arrays(pa.array(bounds), pa.array(shingle[order].view(np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), sets], names=["key", "shingles"])
        released()

    return texts.mapInArrow(cut, "key binary, shingles array<long>")


def _enough(n: Column, n2: Column, similarity: float) -> Column:
    """How many shingles sets of n and n2 must share for a link."""
    return (F.lit(similarity) * (n + n2) - 1e-9) / (1 + similarity)


def verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Of `pairs` (a, b and other columns), those whose shingle sets (key, shingles) are similar enough."""
    left, right = (sets.select(F.col("key").alias(k), F.col("shingles").alias(f"set_{k}")) for k in "ab")
    shared = F.size(F.array_intersect("set_a", "set_b"))
    return pairs.join(left, "a").join(right, "b").where(shared >= _enough(F.size("set_a"), F.size("set_b"), similarity)).select(*pairs.columns)


def cross_pairs(rest: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Pairs a, b of `rest` (key, label, n) of different labels (label_a, label_b) that a prefix-filtered set join doesn't rule out."""
    each = rest.join(sets, "key").select("key", "label", "n", F.explode("shingles").alias("shingle"))
    met = each.groupBy("shingle").agg(F.count("*").alias("texts"), F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo != hi").select("shingle", "texts")
    own = Window.partitionBy("key")
    place = F.col("n") - F.count("*").over(own) + F.row_number().over(own.orderBy("texts", "shingle")) - 1
    prefix = each.join(met, "shingle").withColumn("place", place).where(F.col("place") <= F.col("n") - F.ceil(F.lit(similarity) * F.col("n") - 1e-9))
    prefix = checkpointed(prefix.select("shingle", "key", "label", "n", "place"))
    other = prefix.withColumnsRenamed({"key": "key2", "label": "label2", "n": "n2", "place": "place2"})
    n, n2 = F.col("n"), F.col("n2")
    near = (F.col("label") < F.col("label2")) & (F.least(n - F.col("place"), n2 - F.col("place2")) >= _enough(n, n2, similarity)) & (F.least(n, n2) >= similarity * F.greatest(n, n2) - 1e-9)
    first = F.col("key") < F.col("key2")
    pairs = prefix.join(other, "shingle").where(near).select(*(F.when(first, x).otherwise(y).alias(z) for x, y, z in (("key", "key2", "a"), ("key2", "key", "b"), ("label", "label2", "label_a"), ("label2", "label", "label_b"))))
    return pairs.distinct()


def components(edges: DataFrame) -> DataFrame:
    """The least key of its component for each key of `edges` (a, b): least labels of neighbours, then of those labels, until none changes."""
    sides = checkpointed(edges.select("a", "b").unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    label = checkpointed(sides.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("key"), F.least("a", "m").alias("label")))
    while True:
        near = join_hot(sides, label.select(F.col("key").alias("b"), "label"), "b").groupBy("a").agg(F.min("label").alias("near"))
        step = checkpointed(label.join(near, label["key"] == near["a"]).select("key", F.col("label").alias("old"), F.least("label", "near").alias("label")))
        over = step.select(F.col("key").alias("label"), F.col("label").alias("far"))
        step = checkpointed(join_hot(step, over, "label").select("key", "old", F.least("label", "far").alias("label")))
        label = step.select("key", "label")
        if step.where("old != label").isEmpty():
            return label


def class_map(documents: DataFrame, similarity: float = 0.8, weights: str = "set") -> DataFrame:
    """For each text (key) in a class of several documents: class_id, least_key (the text of the document kept) and class_docs."""
    texts = documents.select(_key(F.col("text")).alias("key"), F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    nodes = sketches(texts, weights).groupBy("key").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("docs"), F.first("n").alias("n"), F.first("bands").alias("bands"))
    nodes = checkpointed(nodes)
    member = nodes.select("key", "n", F.explode("bands").alias("bucket"))
    size = member.groupBy("bucket").agg(F.count("*").alias("size")).where("size > 1")
    member = checkpointed(member.join(size, "bucket"))
    met = checkpointed(member.groupBy("key").agg(F.sum("size").alias("met")))
    leader = member.join(met, "key").groupBy("bucket").agg(F.max(F.struct("met", "key", "n")).alias("leader"))
    star = member.join(leader, "bucket").where((F.col("key") != F.col("leader.key")) & (F.least("n", "leader.n") >= similarity * F.greatest("n", "leader.n") - 1e-9))
    star = checkpointed(star.select(F.least("key", "leader.key").alias("a"), F.greatest("key", "leader.key").alias("b")).distinct())
    # One row has each text; the id beside the text's key keeps large groups of copies out of one task. Null ids may share 0's: their texts are equal.
    chosen = nodes.join(met, "key", "left_semi").select("key", F.coalesce("doc_id", F.lit(0)).alias("id"))
    shared = texts.select("key", F.coalesce("doc_id", F.lit(0)).alias("id"), "text").join(chosen, ["key", "id"], "left_semi")
    sets = checkpointed(shingle_sets(shared.groupBy("key", "id").agg(F.first("text").alias("text")).select("key", "text")))
    label = components(verified(star, sets, similarity))

    placed = member.select("bucket", "key", "n").join(label, "key", "left").withColumn("label", F.coalesce("label", "key"))
    several = placed.groupBy("bucket").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo != hi").select("bucket")
    rest = checkpointed(placed.join(several, "bucket", "left_semi").select("key", "label", "n").distinct())
    if not rest.isEmpty():
        cross = checkpointed(cross_pairs(rest, sets, similarity).join(star, ["a", "b"], "left_anti"))
        more = checkpointed(verified(cross, sets, similarity))
        if not more.isEmpty():
            over = components(more.select(F.col("label_a").alias("a"), F.col("label_b").alias("b"))).select(F.col("key").alias("old"), F.col("label").alias("new"))
            # Classes that no link between texts made before are a text alone, named by its key.
            single = more.select(F.explode(F.array("label_a", "label_b")).alias("key")).distinct().join(label, "key", "left_anti")
            label = label.unionByName(single.withColumn("label", F.col("key")))
            over = checkpointed(over.withColumnRenamed("old", "label"))
            label = checkpointed(join_hot(label, over, "label").select("key", F.coalesce("new", "label").alias("label")))

    least = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")
    named = nodes.select("key", "doc_id", "docs").join(label, "key", "left").select("key", "doc_id", "docs", F.coalesce("label", "key").alias("label"))
    per = checkpointed(named.groupBy("label").agg(F.min(least).alias("least"), F.sum("docs").alias("class_docs")).where("class_docs > 1"))
    mapped = join_hot(named.select("key", "label"), per, "label").where("class_docs is not null")
    return checkpointed(mapped.select("key", F.col("least.doc_id").alias("class_id"), F.col("least.key").alias("least_key"), "class_docs"))


def _key(text: Column) -> Column:
    return F.unhex(F.md5(F.coalesce(text.cast("string"), F.lit(""))))


def labelled(rows: DataFrame, mapped: DataFrame) -> DataFrame:
    """`rows` (key, doc and others) with class_id, class_docs and kept."""
    out = join_hot(rows, mapped, "key")
    alone = F.col("class_docs").isNull()
    return out.withColumns(
        {
            "kept": alone | ((F.col("key") == F.col("least_key")) & F.col("doc").eqNullSafe(F.col("class_id"))),
            "class_id": F.when(alone, F.col("doc")).otherwise(F.col("class_id")),
            "class_docs": F.coalesce("class_docs", F.lit(1)),
        }
    ).drop("least_key")


def classes(documents: DataFrame, similarity: float = 0.8, weights: str = "set") -> DataFrame:
    """`row`, the columns of `documents`, with class_id, class_docs (rows in the class) and kept (true for one document of each class)."""
    rows = packed(documents, _key(F.col("text")).alias("key"), F.col("doc_id").cast("long").alias("doc"))
    return labelled(rows, class_map(documents, similarity, weights)).select("row", "class_id", "class_docs", "kept")


def document_classes(documents: DataFrame, similarity: float = 0.8, weights: str = "set") -> DataFrame:
    """Per document: doc_id, class_id, class_docs, kept; no text is carried along."""
    rows = documents.select(F.col("doc_id").alias("doc_id"), _key(F.col("text")).alias("key"), F.col("doc_id").cast("long").alias("doc"))
    return labelled(rows, class_map(documents, similarity, weights)).select("doc_id", "class_id", "class_docs", "kept")


def one_of_each(documents: DataFrame, similarity: float = 0.8, weights: str = "set") -> DataFrame:
    """The documents with one of each class; all their columns stay."""
    rows = packed(documents, _key(F.col("text")).alias("key"), F.col("doc_id").cast("long").alias("doc"))
    repeated = rows.groupBy("doc", "key").count().where("count > 1")
    kept = labelled(rows, class_map(documents, similarity, weights)).where("kept")
    if not repeated.isEmpty():
        kept = kept.dropDuplicates(["doc", "key"])
    return unpacked(kept, documents.columns)
