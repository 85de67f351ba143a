"""Cross-tokenizer alignment: two tokenizations of a text, the groups they share, and how common each linked id pair is.

Tokenizer A (byte-level ranks) encodes a space and the text, tokenizer B (sentence pieces, which add that space) the text.
Both cut before a space that follows no space and precedes none, so a text falls into chunks that are aligned apart;
each process keeps the alignment of the chunks it met lately (at most about CHUNKS). A text in which white space follows a
space, or one of whose chunks B doesn't give back, is one chunk.

One pass writes a row for each document and, for each block of documents and each A id, that id's postings:
the B ids linked to it, in which documents and how often. Postings are shuffled by A id and sorted, so a task streams
over whole ids: it counts each pair's documents, finds the id's maximum, and adds up what that contributes to each
document. Sums leave the task packed by block and are added by document. An A id with more than `hot` postings is dealt over
several tasks by block; its counts, one row for each of its pairs, are summed beforehand and join each of these streams.

Defined results: texts null, empty, or not given back by both tokenizers byte by byte have no tokens: zeros and an empty
string; special tokens' strings are plain text; repeated rows are documents like others; null doc_ids keep their own rows; an
empty table gives none; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.llm.batches import cell_bytes, cells, column_slices, run_starts, spread, whole_groups
from orrery.llm.session import released, written

CHUNKS = 150_000
CHUNK_BYTES = 32 << 20
BLOCK_CHARS, BLOCK_DOCS = 4 << 20, 1 << 16
HOT = 1 << 22
#: Contributions that a task adds up before it sends them on.
HELD = 1 << 21
#: A space that white space or the end follows.
_UNSURE = re.compile(r" (?:\s|\Z)").search

TABLE = "block long, a int, doc int, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, bs binary, ns binary, docs binary, times binary"
NAMES = [f.split()[0] for f in TABLE.split(", ")]




class Aligner:
    """Both tokenizers, and the alignments of chunks met lately."""

    def __init__(self, a_path: str, b_path: str, pattern: str):
        import sentencepiece
        import tiktoken

        with open(a_path, "rb") as f:
            ranks = {base64.b64decode(t): int(i) for t, i in map(bytes.split, f)}
        self.a = tiktoken.Encoding(a_path, pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        self.a_size = np.zeros(max(ranks.values()) + 1, np.int64)
        for t, i in ranks.items():
            self.a_size[i] = len(t)
        names = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(names)]
        self.b_size = np.array([len(x) for x in self.b_bytes], np.int64)
        self.width = len(names)
        self.decimal = np.array([f"{i}{s}".encode() for s in ",|;" for i in range(max(len(self.a_size), self.width))], object).reshape(3, -1)
        self.clear()

    def clear(self) -> None:
        self.known: dict[str, int] = {}
        self.written: list[bytes] = []
        self.held = 0
        self.facts = np.zeros((1024, 4), np.int64)  # tokens of A and B, groups, links; all 0 where bytes differ
        self.start = np.zeros(1025, np.int64)
        self.pairs = np.zeros(1 << 16, np.int64)

    def learn(self, chunks: list[str]) -> None:
        """Align chunks (without their space) not met before."""
        if not chunks:
            return
        a_ids = [self.a.encode_ordinary(" " + c) for c in chunks]
        b_ids = self.b.encode(chunks, num_threads=1)
        # What is not given back has no tokens.
        for i, c in enumerate(chunks):
            if b"".join([self.b_bytes[t] for t in b_ids[i]]) != b" " + c.encode():
                a_ids[i] = b_ids[i] = []
        a, b = (np.fromiter(chain.from_iterable(x), np.int64) for x in (a_ids, b_ids))
        of = [np.cumsum([len(x) for x in y], dtype=np.int64) for y in (a_ids, b_ids)]
        a_end, b_end = np.cumsum(self.a_size[a]), np.cumsum(self.b_size[b])
        ends = np.unique(np.concatenate([a_end, b_end]))
        pairs = a[np.searchsorted(a_end, ends)] * self.width + b[np.searchsorted(b_end, ends)]
        shared = a_end[np.isin(a_end, b_end, assume_unique=True)]
        upto = np.concatenate([[0], a_end])[of[0]]  # bytes up to each chunk's end
        links, groups = np.searchsorted(ends, upto, side="right"), np.searchsorted(shared, upto, side="right")
        self._write(a, b, 2 * np.searchsorted(shared, a_end), 2 * np.searchsorted(shared, b_end) + 1, of[0] + of[1])
        facts = np.diff(np.stack([*of, groups, links], axis=1), axis=0, prepend=0)
        n, first = len(self.known), self.start[len(self.known)]
        while n + len(chunks) > len(self.facts):
            self.facts, self.start = np.concatenate([self.facts, np.zeros_like(self.facts)]), np.concatenate([self.start, np.zeros(len(self.facts), np.int64)])
        while first + len(pairs) > len(self.pairs):
            self.pairs = np.concatenate([self.pairs, np.zeros_like(self.pairs)])
        self.facts[n : n + len(chunks)] = facts
        self.pairs[first : first + len(pairs)] = pairs
        self.start[n + 1 : n + len(chunks) + 1] = first + links
        self.known.update(zip(chunks, range(n, n + len(chunks)), strict=True))
        self.held += sum(map(len, chunks))

    def _write(self, a: np.ndarray, b: np.ndarray, a_key: np.ndarray, b_key: np.ndarray, upto: np.ndarray) -> None:
        """Each chunk's groups in writing, with ; after each: a1,a2|b1;a3|b2;"""
        key, ids = np.concatenate([a_key, b_key]), np.concatenate([a, b])
        order = np.argsort(key, kind="stable")
        key, ids = key[order], ids[order]
        after = np.append(key[1:], -1)
        tokens = self.decimal[np.where(after == key, 0, np.where(key % 2 == 0, 1, 2)), ids].tolist()
        lo = 0
        for hi in upto.tolist():
            self.written.append(b"".join(tokens[lo:hi]))
            lo = hi

    def chunks_of(self, text: str) -> list[str]:
        return [text] if text[:1].isspace() or _UNSURE(text) else text.split(" ")

    def block(self, texts: list[str | None]) -> tuple[list[tuple], tuple]:
        """A row (n_a, n_b, n_groups, n_links, groups_sha256) for each text, and the block's pairs: pair, doc, times, in this order."""
        if len(self.known) > CHUNKS or self.held > CHUNK_BYTES:
            self.clear()
        parts = [self.chunks_of(t) if t else [] for t in texts]
        self.learn(list(set().union(*parts).difference(self.known)))
        known = self.known
        at = [list(map(known.__getitem__, p)) for p in parts]
        # A chunk without tokens: the text is looked at as a whole.
        size = np.array([len(x) for x in at], np.int64)
        chunk = np.fromiter(chain.from_iterable(at), np.int64, size.sum())
        doc = np.repeat(np.arange(len(texts)), size)
        odd = np.unique(doc[self.facts[chunk, 0] == 0])
        if len(odd):
            self.learn(list({texts[i] for i in odd}.difference(known)))
            for i in odd:
                at[i] = [known[texts[i]]]
            size[odd] = 1
            chunk = np.fromiter(chain.from_iterable(at), np.int64, size.sum())
            doc = np.repeat(np.arange(len(texts)), size)
        sums = np.concatenate([np.zeros((1, 4), np.int64), np.cumsum(self.facts[chunk], axis=0)])
        bounds = np.concatenate([[0], np.cumsum(size)])
        facts = (sums[bounds[1:]] - sums[bounds[:-1]]).tolist()
        written, rows = self.written, []
        for f, x in zip(facts, at, strict=True):
            rows.append((*f, hashlib.sha256(b"".join([written[i] for i in x])[:-1]).hexdigest() if f[0] else ""))
        many = len(known)
        key, times = np.unique(doc * many + chunk, return_counts=True)
        doc, chunk = key // many, key % many
        n = self.start[chunk + 1] - self.start[chunk]
        pair = self.pairs[spread(self.start[chunk], n)]
        key, times = pair * len(texts) + np.repeat(doc, n), np.repeat(times, n)
        order = np.argsort(key, kind="stable")
        key, times = key[order], times[order]
        first = np.flatnonzero(np.diff(key, prepend=-1))
        key, times = key[first], np.add.reduceat(times, first) if len(first) else times
        return rows, (key // max(1, len(texts)), key % max(1, len(texts)), times)


@lru_cache(maxsize=1)
def aligner(a_path: str, b_path: str, pattern: str) -> Aligner:
    return Aligner(a_path, b_path, pattern)



def postings(documents: DataFrame, a_path: str, b_path: str, pattern: str) -> DataFrame:
    """Rows of documents (a null) and of postings (a, with the B ids, how many documents each has, these, and how often)."""
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        own, task, n = aligner(a_path, b_path, pattern), TaskContext.get().partitionId(), 0
        for batch in batches:
            for lo, hi in column_slices(batch.column(1), BLOCK_CHARS, BLOCK_DOCS):
                block = (task << 32) + n
                n += 1
                rows, (pair, doc, times) = own.block(batch.column(1).slice(lo, hi - lo).to_pylist())
                cols = list(zip(*rows, strict=True))
                none = lambda kind, k: pa.nulls(k, kind)
                facts = [pa.array(c, k) for c, k in zip(cols, [*[pa.int64()] * 4, pa.string()], strict=True)]
                m = hi - lo
                yield pa.RecordBatch.from_arrays([pa.array([block] * m, pa.int64()), none(pa.int32(), m), pa.array(range(m), pa.int32()), batch.column(0).slice(lo, m), *facts, *(none(pa.binary(), m) for _ in range(4))], names=NAMES)
                if not len(pair):
                    continue
                first = run_starts(pair)
                a = pair[first] // own.width
                row = run_starts(a)
                pairs_of, docs_of = np.append(row, len(first)), np.append(first[row], len(pair))
                wide = "<u1" if times.max() < 256 else "<u4"
                m = len(row)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([block] * m, pa.int64()), pa.array(a[row], pa.int32()), *(none(k, m) for k in (pa.int32(), *[pa.int64()] * 5, pa.string())),
                        cells((pair[first] % own.width).astype("<i4"), pairs_of), cells(np.diff(np.append(first, len(pair))).astype("<i8"), pairs_of), cells(doc.astype("<u2"), docs_of), cells(times.astype(wide), docs_of),
                    ], names=NAMES)
        released()

    return written(texts.mapInArrow(align, TABLE))



def _times(column: pa.Array, docs: np.ndarray) -> np.ndarray:
    """How often: rows of one block have one byte, or four, for each document."""
    data, size = cell_bytes(column)
    wide = size > docs
    if not wide.any():
        return data.astype(np.int64)
    out, at, lo = np.empty(docs.sum(), np.int64), 0, 0
    for n, s, w in zip(docs.tolist(), size.tolist(), wide.tolist(), strict=True):
        out[at : at + n] = data[lo : lo + s].view("<u4") if w else data[lo : lo + s]
        at, lo = at + n, lo + s
    return out


def _counts(rows: DataFrame) -> DataFrame:
    """Of postings: a, b and how many documents hold the pair."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            b, n = (cell_bytes(batch.column(i))[0].view(k).astype(np.int64) for i, k in ((1, "<i4"), (2, "<i8")))
            key = np.repeat(batch.column(0).to_numpy().astype(np.int64), cell_bytes(batch.column(1))[1] // 4) << 32 | b
            pair, of = np.unique(key, return_inverse=True)
            total = np.zeros(len(pair), np.int64)
            np.add.at(total, of, n)
            yield pa.RecordBatch.from_arrays([pa.array((pair >> 32).astype(np.int32)), pa.array((pair & 0xFFFFFFFF).astype(np.int32)), pa.array(total)], names=["a", "b", "n"])

    return rows.select("a", "bs", "ns").mapInArrow(count, "a int, b int, n long").groupBy("a", "b").agg(F.sum("n").alias("n"))


def contributions(rows: DataFrame, hot: int = HOT) -> DataFrame:
    """Of postings: block, doc, n_best and count_sum."""
    size = rows.groupBy("a").agg(F.sum(F.octet_length("docs") / 2).cast("long").alias("size")).where(F.col("size") > hot)
    # At most one row for each id of A's vocabulary.
    many = F.broadcast(written(size.select("a", F.ceil(F.col("size") / hot).cast("int").alias("parts"))))
    dealt = rows.select("block", "a", "bs", "ns", "docs", "times").join(many, "a", "left")
    dealt = dealt.withColumn("part", F.pmod(F.xxhash64("block"), F.coalesce("parts", F.lit(1))).cast("int")).drop("parts")
    counted = _counts(rows.join(many, "a", "left_semi")).groupBy("a").agg(F.array_sort(F.collect_list(F.struct("b", "n"))).alias("c"))
    counted = counted.join(many, "a").select("a", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "c.b", "c.n")
    none = F.lit(None)
    stream = dealt.select("a", "part", "block", "bs", "ns", "docs", "times", none.cast("array<int>").alias("all_b"), none.cast("array<long>").alias("all_n"))
    stream = stream.unionAll(counted.select("a", "part", F.lit(-1).cast("long").alias("block"), *(none.cast("binary").alias(c) for c in ("bs", "ns", "docs", "times")), "b", "n"))
    stream = stream.repartition("a", "part").sortWithinPartitions("a", "part", "block")

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for table in whole_groups(batches, ["a", "part"]):
            blocks, docs, sums, bests = _group_contributions(table)
            held.append((blocks, docs, sums, bests))
            n += len(docs)
            if n > HELD:
                yield _packed(held)
                held, n = [], 0
        if n:
            yield _packed(held)
        released()

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, ["block"]):
            doc, sums, bests = (cell_bytes(c.combine_chunks())[0].view(k) for c, k in zip(table.columns[1:], ("<u2", "<i8", "<i8"), strict=True))
            block = np.repeat(table.column(0).to_numpy(), cell_bytes(table.column(1).combine_chunks())[1] // 2)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in _by_doc(block, doc.astype(np.int32), sums, bests)], names=["block", "doc", "count_sum", "n_best"])

    packed = stream.mapInArrow(add, "block long, docs binary, sums binary, bests binary")
    return packed.repartition("block").sortWithinPartitions("block").mapInArrow(total, "block long, doc int, count_sum long, n_best long")


def _group_contributions(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of all postings of some ids: block, doc, multiplicity times the pair's count, and multiplicity if that is its id's maximum."""
    part = lambda t, c: t.column(c).combine_chunks()
    is_counts = np.asarray(part(table, "block")) < 0
    given, rows = table.filter(pa.array(is_counts)), table.filter(pa.array(~is_counts))
    group = np.asarray(part(rows, "a")).astype(np.int64)
    b, size = cell_bytes(part(rows, "bs"))
    b, n, per_row = b.view("<i4"), cell_bytes(part(rows, "ns"))[0].view("<i8"), size // 4
    doc, docs = cell_bytes(part(rows, "docs"))
    doc, docs = doc.view("<u2"), docs // 2
    times = _times(part(rows, "times"), docs)
    key = np.repeat(group, per_row) << 32 | b
    pair, of = np.unique(key, return_inverse=True)
    count = np.zeros(len(pair), np.int64)
    np.add.at(count, of, n)
    of_group = pair >> 32
    if given.num_rows:
        # Ids dealt over several tasks bring the counts of all.
        b_all, n_all = part(given, "all_b"), part(given, "all_n")
        whole = np.repeat(np.asarray(part(given, "a")).astype(np.int64), np.diff(np.asarray(b_all.offsets))) << 32 | np.asarray(b_all.flatten())
        order = np.argsort(whole, kind="stable")
        whole, n_all = whole[order], np.asarray(n_all.flatten())[order]
        at = np.minimum(np.searchsorted(whole, pair), len(whole) - 1)
        count = np.where(whole[at] == pair, n_all[at], count)
        most_pair, most_count = np.concatenate([pair, whole]), np.concatenate([count, n_all])
    else:
        most_pair, most_count = pair, count
    ids, at = np.unique(most_pair >> 32, return_inverse=True)
    most = np.zeros(len(ids), np.int64)
    np.maximum.at(most, at, most_count)
    best = count == most[np.searchsorted(ids, of_group)]
    of_doc = np.repeat(of, n)
    blocks = np.repeat(np.asarray(part(rows, "block")), docs)
    return _by_doc(blocks, doc.astype(np.int32), times * count[of_doc], times * best[of_doc])


def _by_doc(block: np.ndarray, doc: np.ndarray, sums: np.ndarray, bests: np.ndarray) -> tuple[np.ndarray, ...]:
    """Sums of each document of each block, in order."""
    blocks, of = np.unique(block, return_inverse=True)
    key = of * (1 << 16) + doc
    order = np.argsort(key, kind="stable")
    key = key[order]
    first = run_starts(key)
    if not len(first):
        return block, doc, sums, bests
    return blocks[key[first] >> 16], (key[first] & 0xFFFF).astype(np.int32), np.add.reduceat(sums[order], first), np.add.reduceat(bests[order], first)


def _packed(held: list[tuple]) -> pa.RecordBatch:
    block, doc, sums, bests = _by_doc(*(np.concatenate(x) for x in zip(*held, strict=True)))
    first = run_starts(block)
    bounds = np.append(first, len(block))
    return pa.RecordBatch.from_arrays([pa.array(block[first]), cells(doc.astype("<u2"), bounds), cells(sums.astype("<i8"), bounds), cells(bests.astype("<i8"), bounds)], names=["block", "docs", "sums", "bests"])


def aligned(documents: DataFrame, a_path: str, b_path: str, pattern: str, hot: int = HOT) -> DataFrame:
    """Per document: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256."""
    rows = postings(documents, a_path, b_path, pattern)
    docs = rows.where("a is null").select("block", "doc", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256")
    found = contributions(rows.where("a is not null"), hot)
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    return docs.join(found, ["block", "doc"], "left").select("doc_id", "n_a", "n_b", "n_groups", "n_links", zero("n_best"), zero("count_sum"), "groups_sha256")
