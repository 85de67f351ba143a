"""Language identification by compression: the language whose zstandard dictionary makes a text smallest.

Each language's dictionary is raw text: labelled training documents until DICTIONARY_BYTES are full, drawn by
a hash of the document so that about SAMPLE_DOCS of each language are read; of a longer one a slice of
SLICE_CHARS characters, at a place that its hash names, is read. That sample is the one bound here; every
text's words are then compressed whole with every dictionary, at one level. Where the two smallest sizes are
within `narrow` of each other the prediction stands but `rejected` is true. Equal sizes are settled by the
language with more training documents.

Defined results: null text and text without a letter is `und` with score 0; documents without a language are
predicted but never learned from; with no labelled row at all every text is `und`; repeated rows are
predicted alike; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SAMPLE_DOCS = 300
DICTIONARY_BYTES = 112_000
#: Of a longer document a slice of so many characters goes into a dictionary.
SLICE_CHARS = 6_000
LEVEL = 12


def letters(text: Column) -> Column:
    """The whole text's words in lower case between single blanks: numbers and markup are of no language."""
    return F.regexp_replace(F.concat(F.lit(" "), F.lower(text), F.lit(" ")), r"[^\p{L}]+", " ")


def held_out(doc_id: Column, folds: int = 4, fold: int = 2) -> Column:
    return F.coalesce(F.pmod(F.crc32(F.encode(doc_id.cast("string"), "utf-8")), F.lit(folds)) == fold, F.lit(False))


def dictionaries(labelled: DataFrame, sample_docs: int = SAMPLE_DOCS) -> dict[str, bytes]:
    """Raw-content dictionaries by language, from `labelled` (doc_id, text, lang); the most frequent language first."""
    usable = labelled.where(F.col("lang").isNotNull() & (F.length("text") > 0))
    counts = {r["lang"]: r["count"] for r in usable.groupBy("lang").count().collect()}
    if not counts:
        return {}
    share = F.lit(0.0)
    for lang, n in counts.items():
        share = F.when(F.col("lang") == lang, F.lit(min(1.0, sample_docs / n))).otherwise(share)
    hashed = F.xxhash64("doc_id", "text")
    draw = F.pmod(hashed, F.lit(1 << 30)) / (1 << 30)
    begin = F.pmod(F.shiftright(hashed, 30), F.greatest(F.length("text") - SLICE_CHARS, F.lit(0)) + 1).cast("int") + 1
    sample = usable.select("lang", F.substring("text", begin, F.lit(SLICE_CHARS)).alias("text"), draw.alias("draw"), share.alias("share")).where("draw < share")
    sample = sample.select("lang", letters(F.col("text")).alias("text"), "draw").where(F.length("text") > 1).distinct()
    out = {}
    for lang, own in sample.toPandas().sort_values(["draw", "text"]).groupby("lang"):
        parts, size = [], 0
        for text in own["text"]:
            data = text.encode()
            if size + len(data) < DICTIONARY_BYTES:
                parts.append(data)
                size += len(data)
        out[lang] = b"\n".join(parts)
    return {lang: out[lang] for lang in sorted(out, key=lambda x: (-counts[x], x)) if out[lang]}


def identify(texts: DataFrame, content: dict[str, bytes], narrow: float = 0.01) -> DataFrame:
    """`texts` (doc_id, text, held_out) with lang_pred, score and rejected."""
    shared = texts.sparkSession.sparkContext.broadcast(content)

    def predict(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import zstandard as zstd

        langs = list(shared.value)
        by_lang = [compressor(zstd, shared.value[x]) for x in langs]
        for batch in batches:
            rows = []
            for text, known in zip(batch["text"], batch["has_letter"], strict=True):
                if not known or not langs:
                    rows.append(("und", 0.0, True))
                    continue
                data = text.encode()
                sizes = [len(c.compress(data)) for c in by_lang]
                best = min(range(len(sizes)), key=sizes.__getitem__)
                others = [s for i, s in enumerate(sizes) if i != best]
                margin = (min(others) - sizes[best]) / max(min(others), 1) if others else 1.0
                rows.append((langs[best], 1 / (1 + math.exp(-40 * margin)), margin < narrow))
            out = pd.DataFrame(rows, columns=["lang_pred", "score", "rejected"], index=batch.index)
            yield pd.concat([batch[["doc_id", "held_out"]], out], axis=1)

    kinds = dict(texts.dtypes)
    whole = texts.withColumn("text", letters(F.col("text"))).withColumn("has_letter", F.coalesce(F.length("text") > 1, F.lit(False)))
    return whole.mapInPandas(predict, f"doc_id {kinds['doc_id']}, held_out boolean, lang_pred string, score double, rejected boolean")


def compressor(zstd, content: bytes):
    """Compresses with raw content as dictionary and writes no header fields that would add to every size."""
    prepared = zstd.ZstdCompressionDict(content, dict_type=zstd.DICT_TYPE_RAWCONTENT)
    prepared.precompute_compress(level=LEVEL)
    return zstd.ZstdCompressor(level=LEVEL, dict_data=prepared, write_content_size=False, write_checksum=False, write_dict_id=False)


def languages(documents: DataFrame) -> DataFrame:
    """Per document: doc_id, held_out, lang_pred, score, rejected; learns from the rows not held out."""
    rows = documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.col("lang").cast("string"), held_out(F.col("doc_id")).alias("held_out"))
    return identify(rows.select("doc_id", "text", "held_out"), dictionaries(rows.where(~F.col("held_out"))))
