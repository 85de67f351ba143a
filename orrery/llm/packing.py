"""Bounded-space online packing of tokenised documents into sequences of a fixed number of ids.

Each partition keeps `open_windows` windows. A piece goes to the window that it fills best; when none has
room, the fullest is topped up with the piece's first ids and emitted. The windows left at the end are merged
in groups of `merge` partitions by the same rule, and what such a group leaves is emitted as it is. Only the
ids of leftover windows, at most `open_windows` x `capacity` a partition, leave the task that made them.

Words repeat, so each process keeps the ids of the space-delimited chunks it meets again (at most CHUNKS); merges
never cross white space, so these are the ids of the whole text.

Defined results: null text is empty; an empty text is its end id alone; repeated rows and ids are packed
each; a text longer than a sequence is cut; an empty table gives no pieces; other columns are ignored.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.llm.session import checkpointed, released

END = 1
CHUNKS, SEEN = 500_000, (1 << 23) - 1
#: Chunks encoded in one string, and what stands between them.
GROUP, MARK = 64, "\x01"
#: Marks that, after a letter or digit, begin a pre-token of their own.
CLOSERS = ".,;:!?#&%$*+-_/()[]{}<>=~^|@\"`"
#: The last letter of which that is certain, folded or not.
LATIN = "\u024f"
#: Texts whose chunks are looked up together.
TEXTS = 1_000
#: With the space, separators in every sense of the tokenizer; any other white space stays inside its chunk.
BLANKS = ("\n", "\t", "\r")
PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence long, offset long"


class ChunkIds:
    """Ids of texts, by the space-delimited chunks met twice or more in this process so far.

    Chunks not met are encoded GROUP at a time, a mark after each that is one pre-token and one id of its own.
    Chunks that hold the mark, or strings of special tokens, which the tokenizer takes out before anything else, are encoded alone.
    """

    def __init__(self, tokenizer_path: str):
        # Tasks share the machine's cores already.
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(tokenizer_path)
        self.mark = self.tokenizer.encode(MARK, add_special_tokens=False).ids[0]
        self.seen = bytearray(SEEN + 1)
        self.chunks: dict[str, bytes] = {}  # ids as little-endian 32-bit integers

    def _plain(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _learn(self, chunks: set[str]) -> dict[str, bytes]:
        """Ids of chunks that are not kept: from their letters, folded, and closing marks where these are pre-tokens apart."""
        known, found, whole = self.chunks, {}, []
        odd = [c for c in chunks if "<|" in c or MARK in c]
        found = {c: self._plain(c) for c in odd}
        parts, todo = [], set()
        for c in chunks.difference(odd):
            stem = c.rstrip(CLOSERS)
            if stem and stem[-1] <= LATIN and stem[-1].lower().isalnum() and (len(stem) < len(c) or c.isascii()):
                closing = c[len(stem) :]
                if c.isascii():
                    stem = stem.lower()
                parts.append((c, stem, closing))
                if stem not in known:
                    todo.add(stem)
                if closing and closing not in known:
                    todo.add(closing)
            else:
                whole.append(c)
        todo.update(whole)
        new = self._encode(list(todo))
        self._keep(new)
        for c in whole:
            found[c] = new[c]
        made = {}
        for c, stem, closing in parts:
            ids = new[stem] if stem in new else known[stem]
            made[c] = ids + (new[closing] if closing in new else known[closing]) if closing else ids
        self._keep(made)
        return found | made

    def _keep(self, found: dict[str, bytes]) -> None:
        """Most chunks are met once. One is kept when it is met again, as far as a small table of hashes tells."""
        seen, kept = self.seen, self.chunks
        for c, x in found.items():
            at = hash(c) & SEEN
            if seen[at] and len(kept) < CHUNKS and len(c) < 64:
                kept[c] = x
            seen[at] = 1

    def _encode(self, todo: list[str]) -> dict[str, bytes]:
        groups = [f" {MARK} ".join(todo[i : i + GROUP]) + f" {MARK}" for i in range(0, len(todo), GROUP)]
        whole = self.tokenizer.encode_batch_fast(groups, add_special_tokens=False)
        ids = np.concatenate([np.array(w.ids, "<u4") for w in whole]) if whole else np.zeros(0, "<u4")
        end = np.flatnonzero(ids == self.mark)
        if len(end) != len(todo):
            raise AssertionError("a mark of the tokenizer's was lost")
        data, lo, found = ids.tobytes(), 0, {}
        for c, hi in zip(todo, (4 * end).tolist(), strict=True):
            found[c] = data[lo:hi]
            lo = hi + 4
        return found

    def of(self, texts: list[str]) -> Iterator[np.ndarray]:
        """The ids of each text."""
        # Empty chunks, between neighbouring separators, have no ids.
        for blank in BLANKS:
            texts = [t.replace(blank, " ") for t in texts]
        parts = [t.split(" ") for t in texts]
        known = self.chunks
        new = self._learn(set().union(*parts).difference(known))
        # Chunks beyond those kept stay for these texts only.
        spare = {c: ids for c, ids in new.items() if c not in known}
        known.update(spare)
        for p in parts:
            yield np.frombuffer(b"".join(map(known.__getitem__, p)), "<u4")
        for c in spare:
            del known[c]


@lru_cache(maxsize=1)
def _chunk_ids(tokenizer_path: str) -> ChunkIds:
    return ChunkIds(tokenizer_path)


class Windows:
    """A fixed number of open windows; each holds pieces (document, start, document's ids, ids)."""

    def __init__(self, count: int, capacity: int):
        self.count, self.capacity = count, capacity
        self.open: list[list] = []
        self.free: list[int] = []

    def put(self, doc, start: int, total: int, ids: np.ndarray) -> Iterator[list]:
        """Place ids, as few pieces as fit allows; yields the windows that are full."""
        while len(ids):
            if len(ids) >= self.capacity:
                yield [(doc, start, total, ids[: self.capacity])]
                start, ids = start + self.capacity, ids[self.capacity :]
                continue
            fitting = [i for i, f in enumerate(self.free) if f >= len(ids)]
            if fitting:
                best = min(fitting, key=self.free.__getitem__)
            elif len(self.open) < self.count:
                best = len(self.open)
                self.open.append([])
                self.free.append(self.capacity)
            else:
                best = min(range(len(self.free)), key=self.free.__getitem__)
            part = ids[: self.free[best]]
            self.open[best].append((doc, start, total, part))
            self.free[best] -= len(part)
            start, ids = start + len(part), ids[len(part) :]
            if not self.free[best]:
                self.free.pop(best)
                yield self.open.pop(best)


def _rows(windows: Iterator[list], first: int) -> Iterator[tuple]:
    for n, window in enumerate(windows, first):
        offset = 0
        for doc, start, total, ids in window:
            yield doc, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), total, n, offset
            offset += len(ids)


def _batches(rows: Iterator[tuple], names: list[str], size: int = 20_000) -> Iterator[pd.DataFrame]:
    batch = []
    for row in rows:
        batch.append(row)
        if len(batch) == size:
            yield pd.DataFrame(batch, columns=names).astype({"doc_id": "Int64"})
            batch = []
    if batch:
        yield pd.DataFrame(batch, columns=names).astype({"doc_id": "Int64"})


NAMES = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence", "offset"]


def pack(documents: DataFrame, tokenizer_path: str, capacity: int = 2048, open_windows: int = 16, merge: int = 32) -> DataFrame:
    """Pieces: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    texts = documents.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of, windows = _chunk_ids(tokenizer_path), Windows(open_windows, capacity)
        from pyspark import TaskContext

        task = TaskContext.get().partitionId()
        done = 0
        for batch in batches:
            out = []
            for start in range(0, batch.num_rows, TEXTS):
                part = batch.slice(start, TEXTS)
                for doc, ids in zip(part.column(0).to_pylist(), ids_of.of(part.column(1).to_pylist()), strict=True):
                    ids = np.append(ids, np.uint32(END))
                    for full in windows.put(doc, 0, len(ids), ids):
                        out += [(*row, None) for row in _rows([full], done)]
                        done += 1
            if out:
                yield _arrow(out, task)
        left = []
        for n, window in enumerate(windows.open):
            left += [(d, s, len(i), 0, t, n, 0, i.astype("<u4").tobytes()) for d, s, t, i in window]
        if left:
            yield _arrow(left, task)
        released()

    def _arrow(rows: list[tuple], task: int) -> pa.RecordBatch:
        cols = list(zip(*rows, strict=True))
        kinds = [pa.int64()] * 7 + [pa.binary()]
        return pa.RecordBatch.from_arrays([*(pa.array(c, k) for c, k in zip(cols, kinds, strict=True)), pa.array([task] * len(rows), pa.int64())], names=[*NAMES, "ids", "task"])

    first = checkpointed(texts.mapInArrow(fill, PIECE + ", ids binary, task long"))

    def join(key: tuple, pieces: pd.DataFrame) -> pd.DataFrame:
        pieces = pieces.sort_values(["task", "sequence", "doc_id", "start"], kind="stable")
        windows = Windows(open_windows, capacity)
        full = [w for doc, start, total, ids in zip(pieces["doc_id"], pieces["start"], pieces["doc_tokens"], pieces["ids"], strict=True) for w in windows.put(doc, start, total, np.frombuffer(ids, "<u4"))]
        rows = list(_rows(iter(full + windows.open), 0))
        return pd.DataFrame(rows, columns=NAMES).astype({"doc_id": "Int64"}).assign(grp=key[0])

    emitted = first.where("ids is null").select(*NAMES[:5], (F.shiftleft("task", 32) + F.col("sequence")).alias("sequence_id"), "offset")
    left = first.where("ids is not null").withColumn("grp", F.floor(F.col("task") / merge).cast("long")).groupBy("grp").applyInPandas(join, PIECE + ", grp long")
    merged = left.select(*NAMES[:5], (F.shiftleft(F.col("grp"), 32) + F.col("sequence") + F.lit(1 << 62)).alias("sequence_id"), "offset")
    return emitted.unionByName(merged)
