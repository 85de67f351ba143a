"""Phrase collocations by pattern growth: frequent prefixes, the occurrences that follow each, grown to the right.

Words are counted for each language first. Every occurrence of a frequent word that a frequent word follows is projected
to a pointer: the word (its prefix) and the `longest` - 1 words after it in its piece. Pointers of one slice of the texts
are summed where they are equal and packed, a row for each prefix. They are shuffled by prefix and sorted, and one task at
a time has all of a prefix: it grows the prefix to the right depth-first, on the ever narrower runs of its sorted pointers
in which a phrase occurs often enough. A prefix of more than `hot` occurrences is dealt over several tasks by the words
that follow; the counts of its shorter phrases, which several tasks share, are summed once more.

Words are compared by 64-bit hashes; the texts are read once more for the spelling of the words of what is returned. A
fixed bitmap of frequent words, which every task gets, only spares pointers: what passes it by chance is too rare to be grown.

Defined results: null text is empty; null lang is `und`; words of other scripts, digits and marks that are no separators count
as they are; a tie in score at the last rank is resolved by count, then by the phrase in byte order; repeated rows count each; an
empty table gives no phrases; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orrery.llm.batches import cell_bytes, cells, column_slices, run_starts, whole_groups
from orrery.llm.session import broadcast_if_small, released, written
from orrery.llm.textkit import mix, runs, token_hashes

LEAST, LONGEST, COVERED, TOP = 10, 3, 50, 2000
#: Texts are hashed in small slices, and what they hold is summed over large ones.
SMALL_BYTES, SLICE_BYTES = 1 << 19, 4 << 20
#: Bits of the bitmap of frequent words.
SLOTS = 1 << 26
HOT, HOT_PREFIXES = 1 << 21, 1 << 16
BROADCAST_ROWS = 200_000
#: Counts below 10^14 keep all products within 38 digits.
SCORE = "(cast(1000000 as decimal(7,0)) * (cast(a as decimal(14,0)) * cast(a as decimal(14,0)))) div (cast(l as decimal(14,0)) * cast(r as decimal(14,0)))"


def _table() -> tuple[np.ndarray, np.ndarray]:
    """Class (0 blank, 1 word, 2 end of a piece) and value of each byte, A-Z as a-z."""
    byte = np.arange(256)
    kind = np.ones(256, np.uint8)
    kind[[0x20, 0x09]] = 0
    kind[[*b".,;:!?", *range(0x0A, 0x0E)]] = 2
    folded = np.where((byte >= 65) & (byte <= 90), byte + 32, byte)
    value = mix(folded.astype(np.uint64) + np.uint64(0x5851F42D4C957F2D))
    value[kind != 1] = 0
    return kind, value


TABLE = _table()


def _words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of a slice of texts: each word's hash (never 0), its text, whether the next word follows in its piece, its first byte and length, and all bytes."""
    texts = texts.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    offsets = offsets - offsets[0]
    none = np.zeros(0, np.int64)
    if not data.size:
        return none.view(np.uint64), none, none.astype(bool), none, none, data
    kind, value = TABLE
    first, length, of = runs(data, offsets, kind)
    # token_hashes takes all that is no separator; ends of pieces are separators to it.
    hashes, bounds = token_hashes(data, offsets, ((kind == 1).astype(np.uint8), value))
    is_word = of == 1
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(bounds))
    piece = np.cumsum(of == 2)[is_word]
    follows = np.zeros(len(hashes), bool)
    follows[:-1] = (piece[1:] == piece[:-1]) & (text[1:] == text[:-1])
    return np.maximum(hashes, np.uint64(1)), text, follows, first[is_word], length[is_word], data


def _slices(batch: pa.RecordBatch) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]]:
    """Of slices of a batch (lang, text): the languages, each word's language among them, its hash, and whether the next word follows."""
    for lo, hi in column_slices(batch.column(1), SLICE_BYTES):
        names, lang = _coded(batch.column(0).slice(lo, hi - lo))
        texts, found = batch.column(1).slice(lo, hi - lo), []
        for a, b in column_slices(texts, SMALL_BYTES):
            word, text, follows, *_ = _words(texts.slice(a, b - a))
            found.append((lang[a:b][text], word, follows))
        yield names, *(np.concatenate(x) for x in zip(*found, strict=True))


def _with_langs(documents: DataFrame) -> DataFrame:
    return documents.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def _coded(langs: pa.Array) -> tuple[pa.Array, np.ndarray]:
    found = langs.dictionary_encode()
    return found.dictionary, np.asarray(found.indices).astype(np.int64)


def word_counts(texts: DataFrame) -> DataFrame:
    """lang, word (its hash), n."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for names, of, word, _ in _slices(batch):
                for i in range(len(names)):
                    each, n = np.unique(word[of == i], return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array([names[i].as_py()] * len(each), pa.string()), pa.array(each.view(np.int64)), pa.array(n.astype(np.int64))], names=["lang", "word", "n"])
        released()

    return texts.mapInArrow(count, "lang string, word long, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))


def _slot(words: np.ndarray) -> np.ndarray:
    return (words & np.uint64(SLOTS - 1)).astype(np.int64)


def bitmap(words: DataFrame) -> np.ndarray:
    """A bit for each slot that a word's hash falls into: SLOTS / 8 bytes, whatever the number of words."""
    slot = (F.col("word").bitwiseAND(F.lit(SLOTS - 1)) + 1).alias("slot")
    parts = words.select(slot).groupBy(F.bitmap_bucket_number("slot").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("slot")).alias("bits")).collect()
    out = np.zeros(SLOTS // 8, np.uint8)
    for r in parts:
        own = np.frombuffer(bytes(r["bits"]), np.uint8)
        at = (r["bucket"] - 1) * 4096
        out[at : at + len(own)] = own
    return out


def _in(bits: np.ndarray, words: np.ndarray) -> np.ndarray:
    slot = _slot(words)
    return (bits[slot >> 3] >> (slot & 7).astype(np.uint8)) & 1 == 1


def _summed(lang: np.ndarray, codes: list[np.ndarray], many: int) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
    """Distinct rows of lang and codes (below `many`), sorted, and how often each occurs."""
    key, levels = lang * many + codes[0], []
    for c in codes[1:-1]:
        each, key = np.unique(key * many + c, return_inverse=True)
        levels.append(each)
    each, times = np.unique(key * many + codes[-1], return_counts=True)
    out, key = [each % many], each // many
    for level in reversed(levels):
        row = level[key]
        out.append(row % many)
        key = row // many
    return key // many, [key % many, *reversed(out)], times


def pointers(texts: DataFrame, bits, hot: dict, longest: int) -> DataFrame:
    """Packed projections: lang, prefix, part, and for each distinct run of following words (0: none) these and how often."""
    names_out = ["lang", "prefix", "part", *(f"next{i}" for i in range(1, longest)), "times"]

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent, parts_of = bits.value, hot.value
        for batch in batches:
            for names, lang, word, follows in _slices(batch):
                good = _in(frequent, word)
                # 0 is no word, and comes first.
                values, code = np.unique(np.append(np.where(good, word, np.uint64(0)), np.uint64(0)), return_inverse=True)
                code = code[:-1]
                after, reach = [], good & follows
                for i in range(1, longest):
                    reach[:-i] &= good[i:]
                    reach[-i:] = False
                    step = np.zeros(len(word), np.int64)
                    step[:-i] = code[i:]
                    after.append(np.where(reach, step, 0))
                    reach[:-i] &= follows[i:]
                begins = np.flatnonzero(after[0])
                if not len(begins):
                    continue
                of, codes, times = _summed(lang[begins], [code[begins], *(a[begins] for a in after)], len(values))
                prefix, *nexts = (values[c] for c in codes)
                part = np.zeros(len(times), np.int64)
                for (name, w), n in parts_of.items():
                    if name in (found := names.to_pylist()):
                        at = np.flatnonzero((prefix == np.uint64(w)) & (of == found.index(name)))
                        mixed = np.zeros(len(at), np.uint64)
                        for x in nexts:
                            mixed = mix(mixed + x[at])
                        part[at] = (mixed % np.uint64(n)).astype(np.int64)
                if parts_of:
                    order = np.lexsort((part, prefix, of))
                    of, prefix, part, times = of[order], prefix[order], part[order], times[order]
                    nexts = [x[order] for x in nexts]
                change = (of[1:] != of[:-1]) | (prefix[1:] != prefix[:-1]) | (part[1:] != part[:-1])
                first = np.flatnonzero(np.concatenate([[True], change]))
                bounds = np.append(first, len(times))
                yield pa.RecordBatch.from_arrays(
                    [names.take(pa.array(of[first])), pa.array(prefix[first].view(np.int64)), pa.array(part[first].astype(np.int32)), *(cells(x.astype("<u8"), bounds) for x in nexts), cells(times.astype("<u4"), bounds)], names=names_out
                )
        released()

    return texts.mapInArrow(project, "lang string, prefix long, part int, " + ", ".join(f"next{i} binary" for i in range(1, longest)) + ", times binary")


def grow(nexts: list[np.ndarray], times: np.ndarray, least: int, keep_all: bool) -> Iterator[tuple[tuple[int, ...], int]]:
    """Phrases of a prefix's sorted pointers: the words after the prefix and how often; depth-first, on runs that are frequent.

    `keep_all`: this is a part of a prefix's pointers, so all but the longest phrases are given with whatever count they have here."""

    def right(lo: int, hi: int, depth: int, words: tuple[int, ...]) -> Iterator[tuple[tuple[int, ...], int]]:
        own = nexts[depth][lo:hi]
        first = run_starts(own)
        total = np.add.reduceat(times[lo:hi], first)
        last = depth == len(nexts) - 1
        some = np.flatnonzero((own[first] != 0) & ((total >= least) | (keep_all and not last)))
        ends = np.append(first, hi - lo)
        for i, w, n in zip(some.tolist(), own[first[some]].tolist(), total[some].tolist(), strict=True):
            phrase = (*words, w)
            yield phrase, n
            if not last and n >= (1 if keep_all else least):
                yield from right(lo + int(ends[i]), lo + int(ends[i + 1]), depth + 1, phrase)

    if len(times):
        yield from right(0, len(times), 0, ())


def frequent_phrases(packed: DataFrame, least: int, longest: int) -> DataFrame:
    """lang, size, words (hashes) and a of every phrase of 2 to `longest` words that occurs at least `least` times."""
    names = [f"next{i}" for i in range(1, longest)]

    def mine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, ["lang", "prefix", "part"]):
            columns = {c: table.column(c).combine_chunks() for c in table.column_names}
            per = cell_bytes(columns["times"])[1] // 4
            times = cell_bytes(columns["times"])[0].view("<u4").astype(np.int64)
            nexts = [cell_bytes(columns[c])[0].view("<u8") for c in names]
            prefix, part = np.asarray(columns["prefix"]), np.asarray(columns["part"])
            lang = columns["lang"].dictionary_encode()
            code = np.asarray(lang.indices)
            change = (code[1:] != code[:-1]) | (prefix[1:] != prefix[:-1]) | (part[1:] != part[:-1])
            first = np.flatnonzero(np.concatenate([[True], change]))
            group = np.repeat(np.cumsum(np.concatenate([[False], change])), per)
            order = np.lexsort((*reversed(nexts), group))
            nexts, times, group = [x[order] for x in nexts], times[order], group[order]
            bounds = np.searchsorted(group, np.arange(len(first) + 1)).tolist()
            rows = []
            for g, (lo, hi) in enumerate(zip(bounds[:-1], bounds[1:], strict=True)):
                row = first[g]
                split = bool(columns["shared"][int(row)].as_py())
                w, name = int(prefix[row]), lang.dictionary[int(code[row])].as_py()
                rows += [(name, [w, *(x - (1 << 64) if x >= 1 << 63 else x for x in phrase)], n) for phrase, n in grow([x[lo:hi] for x in nexts], times[lo:hi], least, split)]
                if len(rows) > 20_000:
                    yield _phrase_rows(rows)
                    rows = []
            if rows:
                yield _phrase_rows(rows)
        released()

    dealt = packed.repartition("lang", "prefix", "part").sortWithinPartitions("lang", "prefix", "part")
    found = dealt.mapInArrow(mine, "lang string, words array<long>, a long")
    return found.groupBy("lang", "words").agg(F.sum("a").alias("a")).where(F.col("a") >= least)


def _phrase_rows(rows: list[tuple]) -> pa.RecordBatch:
    lang, words, a = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(lang, pa.string()), pa.array(words, pa.list_(pa.int64())), pa.array(a, pa.int64())], names=["lang", "words", "a"])


def spellings(texts: DataFrame, words: DataFrame) -> DataFrame:
    """word (hash) and the text of each of `words`, looked up in one more reading of the texts."""
    bits = texts.sparkSession.sparkContext.broadcast(bitmap(words))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi in column_slices(batch.column(1), SMALL_BYTES):
                word, _, _, first, length, data = _words(batch.column(1).slice(lo, hi - lo))
                at = np.flatnonzero(_in(bits.value, word))
                each, one = np.unique(word[at], return_index=True)
                spelled = [data[first[i] : first[i] + length[i]].tobytes() for i in at[one]]
                yield pa.RecordBatch.from_arrays([pa.array(each.view(np.int64)), pa.array(spelled, pa.binary())], names=["word", "spelled"])
        released()

    found = texts.mapInArrow(find, "word long, spelled binary").join(broadcast_if_small(words, BROADCAST_ROWS), "word", "left_semi")
    text = F.translate(F.decode("spelled", "UTF-8"), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return found.select("word", text.alias("text")).groupBy("word").agg(F.min("text").alias("text"))


def collocations(documents: DataFrame, least: int = LEAST, longest: int = LONGEST, covered: int = COVERED, top: int = TOP, hot: int = HOT) -> DataFrame:
    """Each language's first `top` phrases of 2 to `longest` words: lang, rank, phrase, a, l, r, n, score."""
    spark = documents.sparkSession
    texts = _with_langs(documents)
    counts = written(word_counts(texts))
    total = counts.groupBy("lang").agg(F.sum("n").alias("n"))
    frequent = written(counts.where(F.col("n") >= least))
    # At most HOT_PREFIXES words can have more than the HOT_PREFIXES-th part of all occurrences.
    all_words = counts.agg(F.sum("n")).first()[0] or 0
    limit = max(hot, all_words // HOT_PREFIXES)
    parts = {(r["lang"], r["word"] % (1 << 64)): -(-r["n"] // limit) for r in frequent.where(F.col("n") > limit).collect()}
    shared = spark.createDataFrame([(k, w - (1 << 64) if w >= 1 << 63 else w, True) for k, w in parts], "lang string, prefix long, shared boolean")
    packed = pointers(texts, spark.sparkContext.broadcast(bitmap(frequent)), spark.sparkContext.broadcast(parts), longest).join(F.broadcast(shared), ["lang", "prefix"], "left")
    phrases = written(frequent_phrases(packed, least, longest))

    # Every phrase of any size with its count, words alone too; parts of frequent phrases are frequent.
    known = phrases.unionAll(frequent.select("lang", F.array("word").alias("words"), F.col("n").alias("a")))
    known = broadcast_if_small(written(known), BROADCAST_ROWS)
    cut = phrases.select("lang", "words", "a", F.explode(F.sequence(F.lit(1), F.size("words") - 1)).alias("k"))
    cut = cut.withColumns({"left": F.slice("words", F.lit(1), F.col("k")), "right": F.slice("words", F.col("k") + 1, F.size("words"))})
    cut = cut.join(known.select("lang", F.col("words").alias("left"), F.col("a").alias("l")), ["lang", "left"])
    cut = cut.join(known.select("lang", F.col("words").alias("right"), F.col("a").alias("r")), ["lang", "right"])
    scored = cut.withColumn("score", F.expr(SCORE)).groupBy("lang", "words").agg(F.first("a").alias("a"), F.min(F.struct("score", "k", "l", "r")).alias("least"))
    scored = scored.select("lang", "words", "a", "least.score", "least.l", "least.r")

    longer = phrases.where(F.size("words") > 2).select("lang", F.col("a").alias("over"), "words")
    spans = F.flatten(F.transform(F.sequence(F.lit(2), F.size("words") - 1), lambda m: F.transform(F.sequence(F.lit(1), F.size("words") - m + 1), lambda i: F.slice("words", i, m))))
    over = longer.select("lang", "over", F.explode(spans).alias("words")).groupBy("lang", "words").agg(F.max("over").alias("over"))
    left = scored.join(over, ["lang", "words"], "left").where(F.coalesce(100 * F.col("over") < covered * F.col("a"), F.lit(True))).drop("over")

    # The first ranks, with all that tie with the last of them, are spelled and then ordered among themselves.
    first = F.rank().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a")))
    best = written(left.withColumn("place", first).where(F.col("place") <= top).drop("place"))
    spelled = spellings(texts, written(best.select(F.explode("words").alias("word")).distinct()))
    one = best.select("lang", "words", "a", "l", "r", "score", F.posexplode("words").alias("at", "word")).join(spelled, "word")
    named = one.groupBy("lang", "words").agg(*(F.first(c).alias(c) for c in ("a", "l", "r", "score")), F.concat_ws(" ", F.transform(F.array_sort(F.collect_list(F.struct("at", "text"))), lambda x: x["text"])).alias("phrase"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))
    ranked = named.withColumn("rank", rank.cast("long")).where(F.col("rank") <= top)
    return ranked.join(F.broadcast(total) if total.count() <= BROADCAST_ROWS else total, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
