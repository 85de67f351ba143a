"""Exact top-k inner products with a pivot-distance index.

Vectors of integers get one more component that gives all the same length M, so that the largest inner
products of a query are its nearest vectors: |q - x|^2 = |q|^2 + M^2 - 2 q.x. Each vector is keyed by its nearest
pivot and its distance to it, and cut into rings of about equally many rows; a ring's rows are packed, sorted by distance,
into chunks. Pivots grow with the root of the rows and rings with the rows, so that one holds about RING_ROWS rows; the
directory of rings has MOST_RINGS entries at most. A ring is one join key, so keys grow with the rows too.

A search goes in rounds. Each query orders the rings by how far they lie from its own distance to their
pivot, and each round takes the next of them: one, then ever more. After a round the k-th best score so far
bounds the search, and by the triangle inequality a ring can only hold a better row if it lies within the
radius of that bound. A query stops where no ring left does; in a chunk it reads its annulus alone. Queries
travel packed by ring, chunks only where a query asks for their ring, and neither is copied for the other: a
packed block of queries meets a chunk in one product. Every row is indexed; pivots only steer the search, so
results are exact.

Defined results: vectors that are null, empty or hold null or non-finite components take no part, nor rows
without an id; shorter vectors count as padded with 0; rows with the query's id are its own; an id queried
twice is one query; fewer than k others give as many rows as there are; ties go to the smaller id.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orrery.llm.session import checkpointed

#: Pivots are chosen, far from one another, among SAMPLE vectors; CHUNK rows and QUERIES queries are multiplied at a time.
PIVOTS, SAMPLE, RINGS = 32, 2048, 8
CHUNK, QUERIES = 2048, 1024
#: Least numbers are PIVOTS and RINGS; most are MOST_PIVOTS, and MOST_RINGS of all pivots together.
MOST_PIVOTS, RING_ROWS, MOST_RINGS = 1024, 16_384, 1 << 18
#: Entries of the directory times queries that a task looks at together.
LOOKED_AT = 1 << 22
#: Each round takes GROWTH times as many rings as all before.
GROWTH = 8


def quantised(vectors: DataFrame, scale: int = 1024) -> DataFrame:
    """vec_id and v, the floors of the scaled components; rows that take no part are left out."""
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    usable = vectors.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & (F.size("embedding") > 0) & ~F.coalesce(bad, F.lit(True)))
    return usable.select(F.col("vec_id").cast("long"), F.transform("embedding", lambda x: F.floor(F.lit(scale) * x.cast("double")).cast("double")).alias("v"))


def _matrix(packed, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(packed), "<f8").reshape(-1, dim)


def index_size(rows: int) -> tuple[int, int]:
    """Pivots, and rings of each, for so many rows."""
    pivots = int(min(max(PIVOTS, math.isqrt(rows) // 8), MOST_PIVOTS))
    return pivots, int(min(max(RINGS, -(-rows // (pivots * RING_ROWS))), MOST_RINGS // pivots))


class Space:
    """The pivots, distances to them after the lift to length sqrt(longest), and the edges of rings: quantiles of the sample's distances."""

    def __init__(self, sample: np.ndarray, longest: float, pivots: int = PIVOTS, rings: int = RINGS):
        self.longest = longest
        self.pivots = sample[:1]
        self.lifted = self.lift(self.pivots)
        far = None
        for _ in range(min(pivots, len(sample)) - 1):
            # Only the newest pivot can have come nearer.
            near = self.distances(sample, self.lift(sample), -1)[:, 0]
            far = near if far is None else np.minimum(far, near)
            if far.max() <= 0:
                break
            self.pivots = np.concatenate([self.pivots, sample[[far.argmax()]]])
            self.lifted = self.lift(self.pivots)
        near = self.distances(sample, self.lift(sample)).min(axis=1)
        self.edges = np.unique(np.quantile(near, np.linspace(0, 1, rings + 1)[1:-1]))

    def lift(self, x: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(self.longest - (x * x).sum(axis=1), 0))

    def distances(self, x: np.ndarray, last: np.ndarray, first: int = 0) -> np.ndarray:
        """To the pivots from `first` on."""
        pivots = self.pivots[first:]
        sq = (x * x).sum(axis=1)[:, None] + (pivots * pivots).sum(axis=1) - 2 * (x @ pivots.T) + (last[:, None] - self.lifted[first:]) ** 2
        return np.sqrt(np.maximum(sq, 0))

    def radius(self, x: np.ndarray, bound: np.ndarray) -> np.ndarray:
        """What is farther from the query than this scores less than the bound."""
        return np.sqrt(np.maximum((x * x).sum(axis=1) + self.longest - 2 * bound, 0)) * (1 + 1e-9) + 1e-6


def indexed(packed: DataFrame, space: Space, dim: int) -> DataFrame:
    """Chunks of the rows of `packed` (vec_id, v): pivot, ring and the rows' ids, distances (ascending) and vectors, packed."""
    def key(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                x = _matrix(b["v"], dim)
                d = space.distances(x, space.lift(x))
                near = d.argmin(axis=1)
                dist = d[np.arange(len(b)), near]
                yield b.assign(pivot=near.astype(np.int32), ring=np.searchsorted(space.edges, dist, side="right").astype(np.int32), dist=dist)

    def chunks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Rows come sorted by pivot, ring and distance; a chunk ends with its ring, its CHUNK rows or its batch."""
        for b in batches:
            for (pivot, ring), rows in b.groupby(["pivot", "ring"], sort=True):
                for at in range(0, len(rows), CHUNK):
                    part = rows.iloc[at : at + CHUNK]
                    dist = part["dist"].to_numpy()
                    yield pd.DataFrame({"pivot": [pivot], "ring": [ring], "n": [len(part)], "lo": [dist.min()], "hi": [dist.max()], "ids": [part["vec_id"].to_numpy().astype("<i8").tobytes()], "dists": [dist.astype("<f8").tobytes()], "rows": [b"".join(part["v"])]})

    keyed = packed.mapInPandas(key, "vec_id long, v binary, pivot int, ring int, dist double")
    # Ranges of (pivot, distance) keep a ring's rows together and still split a ring that holds many.
    keyed = keyed.repartitionByRange("pivot", "dist", "vec_id").sortWithinPartitions("pivot", "ring", "dist", "vec_id")
    return keyed.mapInPandas(chunks, "pivot int, ring int, n int, lo double, hi double, ids binary, dists binary, rows binary")


def _gaps(away: np.ndarray, directory: pd.DataFrame) -> np.ndarray:
    """How far each ring lies at least from each query, by the triangle inequality."""
    d = away[:, directory["pivot"]]
    return np.maximum(np.maximum(directory["lo"].to_numpy() - d, d - directory["hi"].to_numpy()), 0)


def searched(vectors: DataFrame, is_query: Column, k: int = 10) -> tuple[DataFrame, DataFrame] | None:
    """For the rows of `vectors` (vec_id, v) where is_query holds: their best (query_id, vec_id, score), and the rows each met (query_id, met)."""
    facts = vectors.agg(F.max(F.size("v")).alias("dim"), F.max(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)).alias("sq"), F.count("*").alias("rows")).first()
    if facts["dim"] is None:
        return None
    dim = facts["dim"]

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = np.zeros((len(b), dim))
            for row, v in zip(out, b["v"], strict=True):
                row[: len(v)] = v
            yield pd.DataFrame({"vec_id": b["vec_id"], "v": [r.astype("<f8").tobytes() for r in out]})

    packed = vectors.mapInPandas(pack, "vec_id long, v binary")
    pivots, rings = index_size(facts["rows"])
    space = Space(_matrix(packed.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).toPandas()["v"], dim), float(facts["sq"]), pivots, rings)
    chunks = checkpointed(indexed(packed, space, dim))
    directory = chunks.groupBy("pivot", "ring").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).orderBy("pivot", "ring").toPandas()
    entry = {key: i for i, key in enumerate(zip(directory["pivot"], directory["ring"], strict=True))}
    queries = checkpointed(packed.where(is_query).groupBy(F.col("vec_id").alias("query_id")).agg(F.min("v").alias("q")))
    best, met, first, last = None, None, 0, 1

    def asks(begin: int, end: int):
        def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            """The queries of a batch that take a ring in this round, packed by ring."""
            for whole in batches:
                size = max(1, min(QUERIES, LOOKED_AT // max(1, len(directory))))
                for at in range(0, len(whole), size):
                    b = whole.iloc[at : at + size]
                    x, bound = _matrix(b["q"], dim), b["bound"].fillna(-np.inf).to_numpy()
                    away, radius = space.distances(x, np.zeros(len(b))), space.radius(x, bound)
                    gaps = _gaps(away, directory)
                    place = np.argsort(np.argsort(gaps, axis=1, kind="stable"), axis=1, kind="stable")
                    wanted = (place >= begin) & (place < end) & (gaps <= radius[:, None])
                    for i in np.flatnonzero(wanted.any(axis=0)):
                        own = np.flatnonzero(wanted[:, i])
                        pivot, ring = directory["pivot"].iloc[i], directory["ring"].iloc[i]
                        yield pd.DataFrame({
                            "pivot": [pivot], "ring": [ring], "query_ids": [b["query_id"].to_numpy()[own].astype("<i8").tobytes()], "queries": [x[own].astype("<f8").tobytes()],
                            "bounds": [np.stack([bound[own], away[own, pivot], radius[own]]).astype("<f8").tobytes()],
                        })

        return ask

    def meet(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """The best k of a chunk for each query of a block, read in its annulus; met counts the rows there."""
        for b in batches:
            for row in b.itertuples(index=False):
                ids, dist, x = np.frombuffer(row.ids, "<i8"), np.frombuffer(row.dists, "<f8"), np.frombuffer(row.rows, "<f8").reshape(-1, dim)
                own, q = np.frombuffer(row.query_ids, "<i8"), np.frombuffer(row.queries, "<f8").reshape(-1, dim)
                bound, away, radius = np.frombuffer(row.bounds, "<f8").reshape(3, -1)
                lo, hi = np.searchsorted(dist, away - radius - 1e-6), np.searchsorted(dist, away + radius + 1e-6)
                some = np.flatnonzero(hi > lo)
                if not some.size:
                    continue
                a, z = lo[some].min(), hi[some].max()
                scores = q[some] @ x[a:z].T
                place = np.arange(a, z)
                scores[(place < lo[some, None]) | (place >= hi[some, None]) | (ids[a:z] == own[some, None]) | (scores < bound[some, None])] = -np.inf
                if z - a > k:  # the k best, with all ties of the last
                    scores[scores < -np.partition(-scores, k - 1, axis=1)[:, k - 1 : k]] = -np.inf
                i, j = np.nonzero(np.isfinite(scores))
                found = pd.DataFrame({"query_id": own[some[i]], "vec_id": ids[a + j], "score": scores[i, j].astype(np.int64), "met": 0})
                found = found.sort_values(["query_id", "score", "vec_id"], ascending=[True, False, True]).groupby("query_id").head(k)
                yield pd.concat([found, pd.DataFrame({"query_id": own[some], "vec_id": -1, "score": 0, "met": (hi - lo)[some]})])

    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    while first < len(entry):
        bounds = None if best is None else best.groupBy("query_id").agg(F.min("score").cast("double").alias("bound"), F.count("*").alias("n")).where(F.col("n") == k).select("query_id", "bound")
        state = queries.withColumn("bound", F.lit(None).cast("double")) if bounds is None else queries.join(bounds, "query_id", "left")
        asked = checkpointed(state.mapInPandas(asks(first, last), "pivot int, ring int, query_ids binary, queries binary, bounds binary"))
        if not asked.isEmpty():
            both = checkpointed(chunks.select("pivot", "ring", "ids", "dists", "rows").join(asked, ["pivot", "ring"]).mapInPandas(meet, "query_id long, vec_id long, score long, met long"))
            found = both.where("met = 0").select("query_id", "vec_id", "score")
            ranked = (found if best is None else best.unionByName(found)).withColumn("rank", F.row_number().over(order))
            best = checkpointed(ranked.where(F.col("rank") <= k).drop("rank"))
            here = both.where("met > 0").select("query_id", "met")
            met = here if met is None else met.unionByName(here)
        first, last = last, last * (1 + GROWTH)
    return best, met.groupBy("query_id").agg(F.sum("met").alias("met"))


def top_k(vectors: DataFrame, is_query: Column, k: int = 10) -> DataFrame:
    """For the rows of `vectors` (vec_id, v) where is_query holds: query_id, rank, vec_id, score."""
    found = searched(vectors, is_query, k)
    if found is None or found[0] is None:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found[0].select("query_id", F.row_number().over(order).alias("rank"), "vec_id", "score")
