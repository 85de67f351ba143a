"""Byte-level BPE by ranks, encoded and decoded by a tree of joins.

A text is cut in halves until they are at most LEAF characters; leaves are encoded as they stand, and neighbours
are joined by encoding anew only a window around their boundary. Texts of more than PART characters are cut into
parts that are encoded in tasks of their own and joined FAN at a time, level by level, so no task needs a long
text before the top of its tree. Decoding concatenates the tokens' bytes up the same tree.

Why tokens outside a window are stable. Pre-tokens never have white space after any other character, so a
place where white space follows one is a cut in every text that has these two characters. Between two such cuts
nothing outside is looked at, so a segment is known by its ids, how many of them come before its first cut and how
many after its last, and the window is what lies between the last cut on the left and the first on the right.
A window may be long (a word of a megabyte). Where one pre-token spans the boundary, its halves' ids are joined
by windows of 8, 16, 32, ... ids about the boundary, until each end of the window's new ids and its outer neighbour
encode, together, to these two ids. Merges by rank then never cross these places: the first that did would also be made
in the pair alone. Failing that, the window grows to the whole pre-token, which is encoded anew.

Defined results: null text is empty and has no ids (digest of an empty string); special tokens' strings are plain
text; rows repeated whole get equal rows, a long one being encoded once; null and repeated doc_ids keep their own rows; an
empty table gives none; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.llm.session import checkpointed, released

LEAF = 4_096
PART = 1 << 16
#: Parts, or their joins, that one task joins.
FAN = 16
#: Windows of more bytes are first looked at for one pre-token that spans the boundary.
LONG_WINDOW = 2_048
FIRST_WINDOW = 8


@dataclass
class Segment:
    """Ids of a text; `head` of them lie before its first cut and `tail` after its last. Without a cut both are all ids."""

    ids: np.ndarray
    head: int
    tail: int
    cut: bool
    first_blank: bool
    last_blank: bool


class BytePairs:
    """The tokenizer of a rank file, and joins of its results."""

    def __init__(self, path: str, pattern: str):
        import regex
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encoding = tiktoken.Encoding(path, pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        # White space is Unicode's property; this module's \s has a few control characters more.
        self.pieces = regex.compile(pattern.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}"))
        self.blank = regex.compile(r"\p{White_Space}").match
        self.blank_after = regex.compile(r"(?<=\P{White_Space})\p{White_Space}")
        self.last_blank_after = regex.compile(r"(?r)(?<=\P{White_Space})\p{White_Space}")
        # Blocks where all versions of Unicode give characters the same classes.
        self.settled = regex.compile(r"[\x00-\u052f\u4e00-\u9fa5]+").fullmatch
        self.token = [b""] * (max(ranks.values(), default=-1) + 1)
        for t, i in ranks.items():
            self.token[i] = t
        self.size = np.array([len(t) for t in self.token], np.int64)
        self.decimal = [str(i) for i in range(len(self.token))]

    def plain(self, text: str) -> np.ndarray:
        """Ids of a text that is encoded in one piece."""
        return np.array(self.encoding.encode_ordinary(text), np.int32)

    def bytes_of(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.token.__getitem__, ids.tolist()))

    def leaf(self, text: str) -> Segment:
        ids = self.plain(text)
        first = self.blank_after.search(text)
        if first is None:
            return Segment(ids, len(ids), len(ids), False, self.blank(text[:1]) is not None, self.blank(text[-1:]) is not None)
        ends = np.cumsum(self.size[ids])
        before = lambda at: int(np.searchsorted(ends, len(text[:at].encode()), side="right"))
        last = self.last_blank_after.search(text)
        return Segment(ids, before(first.start()), len(ids) - before(last.start()), True, self.blank(text[0]) is not None, self.blank(text[-1]) is not None)

    def join(self, a: Segment, b: Segment) -> Segment:
        """The segment of both texts together."""
        if not len(a.ids) or not len(b.ids):
            return b if not len(a.ids) else a
        if b.first_blank and not a.last_blank:
            # The boundary itself is a cut.
            return Segment(np.concatenate([a.ids, b.ids]), a.head if a.cut else len(a.ids), b.tail if b.cut else len(b.ids), True, a.first_blank, b.last_blank)
        window = self._window(a.ids[len(a.ids) - a.tail :], b.ids[: b.head])
        ids = np.concatenate([a.ids[: len(a.ids) - a.tail], window, b.ids[b.head :]])
        return Segment(ids, a.head if a.cut else len(window), b.tail if b.cut else len(window), a.cut or b.cut, a.first_blank, b.last_blank)

    def _window(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ids of the text that two neighbouring runs of ids, cut off at sure places outside, make together."""
        one, two = self.bytes_of(left), self.bytes_of(right)
        text = (one + two).decode()
        if len(one) + len(two) <= LONG_WINDOW or not self.settled(text):
            return self.plain(text)
        at = len(one.decode())
        spans = next((m for m in self.pieces.finditer(text) if m.end() > at), None)
        if spans is None or spans.start() >= at:
            return self.plain(text)
        mine = [m for m in self.pieces.finditer(text[:at]) if m.end() == at]
        other = self.pieces.match(text[at:])
        if not mine or mine[-1].start() != spans.start() or other is None or at + other.end() != spans.end():
            return self.plain(text)
        n_left = int(np.searchsorted(np.cumsum(self.size[left]), len(text[: spans.start()].encode()), side="right"))
        n_right = int(np.searchsorted(np.cumsum(self.size[right]), len(text[at : spans.end()].encode()), side="right"))
        return np.concatenate([left[:n_left], self._grown(left[n_left:], right[:n_right]), right[n_right:]])

    def _piece(self, data: bytes) -> list[int]:
        return self.encoding._core_bpe.encode_single_piece(data)

    def _stands(self, x: int, y: int) -> bool:
        """Whether two neighbouring ids are what their bytes encode to."""
        return self._piece(self.token[x] + self.token[y]) == [x, y]

    def _grown(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ids of one pre-token from those of its two parts, by growing windows."""
        n = FIRST_WINDOW
        while n < len(left) or n < len(right):
            lo, hi = max(0, len(left) - n), min(n, len(right))
            new = self._piece(self.bytes_of(left[lo:]) + self.bytes_of(right[:hi]))
            if (not lo or self._stands(int(left[lo - 1]), new[0])) and (hi == len(right) or self._stands(new[-1], int(right[hi]))):
                return np.concatenate([left[:lo], np.array(new, np.int32), right[hi:]])
            n *= 2
        return np.array(self._piece(self.bytes_of(left) + self.bytes_of(right)), np.int32)

    def segment(self, text: str, leaf: int = LEAF) -> Segment:
        """Encode halves and join them."""
        if len(text) <= leaf:
            return self.leaf(text)
        half = len(text) // 2
        return self.join(self.segment(text[:half], leaf), self.segment(text[half:], leaf))

    def fold(self, parts: list[Segment]) -> Segment:
        """Join neighbours in rounds, as a balanced tree."""
        while len(parts) > 1:
            parts = [self.join(*parts[i : i + 2]) if i + 1 < len(parts) else parts[i] for i in range(0, len(parts), 2)]
        return parts[0]

    def decode(self, ids: np.ndarray, leaf: int = LEAF) -> bytes:
        """The bytes of all ids: halves, concatenated."""
        if len(ids) <= leaf:
            return self.bytes_of(ids)
        half = len(ids) // 2
        return self.decode(ids[:half], leaf) + self.decode(ids[half:], leaf)

    def digests(self, ids: np.ndarray) -> tuple[str, str]:
        """SHA-256 of the ids in decimal joined by commas, and of the bytes they decode to."""
        written = ",".join(map(self.decimal.__getitem__, ids.tolist()))
        return hashlib.sha256(written.encode()).hexdigest(), hashlib.sha256(self.decode(ids)).hexdigest()


@lru_cache(maxsize=2)
def byte_pairs(path: str, pattern: str) -> BytePairs:
    return BytePairs(path, pattern)


NODE = "doc_id long, digest binary, copies long, node long, ids binary, head long, tail long, cut boolean, first_blank boolean, last_blank boolean"
ROW = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def _packed(s: Segment) -> tuple:
    return s.ids.astype("<i4").tobytes(), s.head, s.tail, s.cut, s.first_blank, s.last_blank


def _unpacked(r) -> Segment:
    return Segment(np.frombuffer(r.ids, "<i4"), r.head, r.tail, r.cut, r.first_blank, r.last_blank)


def parts_of(texts: DataFrame, part: int) -> DataFrame:
    """`texts` (doc_id, digest, text) as parts of so many characters: doc_id, digest, node, text."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                text = batch.column(2)[i].as_py()
                for n in range(0, len(text), part * FAN):
                    own = [text[j : j + part] for j in range(n, min(n + part * FAN, len(text)), part)]
                    doc, digest = (pa.array([batch.column(c)[i].as_py()] * len(own), batch.schema.field(c).type) for c in (0, 1))
                    yield pa.RecordBatch.from_arrays([doc, digest, pa.array(range(n // part, n // part + len(own)), pa.int64()), pa.array(own)], names=["doc_id", "digest", "node", "text"])

    return texts.mapInArrow(cut, "doc_id long, digest binary, node long, text string")


def encoded(documents: DataFrame, path: str, pattern: str, part: int = PART, leaf: int = LEAF) -> DataFrame:
    """Per document: doc_id, n_tokens, ids_sha256, decoded_sha256."""
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))

    def short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = byte_pairs(path, pattern)
        for batch in batches:
            rows = []
            for text in batch.column(1).to_pylist():
                ids = pairs.segment(text, leaf).ids
                rows.append((len(ids), *pairs.digests(ids)))
            cols = list(zip(*rows, strict=True)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
        released()

    def encode_parts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pairs = byte_pairs(path, pattern)
        for rows in batches:
            out = pd.DataFrame([_packed(pairs.segment(t, leaf)) for t in rows["text"]], columns=["ids", "head", "tail", "cut", "first_blank", "last_blank"])
            yield pd.concat([rows[["doc_id", "digest", "copies", "node"]].reset_index(drop=True), out], axis=1)
        released()

    def join(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("node")
        whole = byte_pairs(path, pattern).fold([_unpacked(r) for r in rows.itertuples()])
        first = rows.iloc[0]
        return pd.DataFrame([(first["doc_id"], first["digest"], first["copies"], first["node"] // FAN, *_packed(whole))], columns=list(rows.columns)).astype({"doc_id": "Int64"})

    def finish(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pairs = byte_pairs(path, pattern)
        for rows in batches:
            out = []
            for r in rows.itertuples():
                ids = np.frombuffer(r.ids, "<i4")
                out += [(r.doc_id, len(ids), *pairs.digests(ids))] * r.copies
            yield pd.DataFrame(out, columns=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]).astype({"doc_id": "Int64"})
        released()

    size = F.length("text")
    done = texts.where(size <= part).mapInArrow(short, ROW)
    most = texts.agg(F.max(size)).first()[0] or 0
    if most <= part:
        return done
    # Parts of one text are dealt over the tasks; copies of a row meet here, part by part, and are encoded once.
    long_texts = texts.where(size > part).select("doc_id", F.unhex(F.sha2("text", 256)).alias("digest"), "text")
    dealt = parts_of(long_texts, part).groupBy("doc_id", "digest", "node").agg(F.count("*").alias("copies"), F.first("text").alias("text"))
    nodes = dealt.select("doc_id", "digest", "copies", "node", "text").mapInPandas(encode_parts, NODE)
    left = -(-most // part)
    while left > 1:
        nodes = checkpointed(nodes).groupBy("doc_id", "digest", F.floor(F.col("node") / FAN)).applyInPandas(join, NODE)
        left = -(-left // FAN)
    return done.unionAll(nodes.mapInPandas(finish, ROW))
