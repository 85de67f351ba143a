"""Small tables and brute force for the operators of the subpackage."""

import re

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def words(text):
    return WORD.findall((text or "").translate(str.maketrans(UPPER, LOWER)))


def documents(spark, rows):
    """Rows of (doc_id, text[, lang[, source]])."""
    full = [(r[0], r[1], r[2] if len(r) > 2 else "en", r[3] if len(r) > 3 else "src0", len(r[1]) if r[1] is not None else None) for r in rows]
    return spark.createDataFrame(full, DOCS)


def with_odd_columns(df):
    """The table with more columns, of names that an operator might use itself."""
    from pyspark.sql import functions as F

    names = ["key", "label", "bands", "bucket", "w", "at", "size", "gone", "line", "score", "a", "b", "shard", "first", "row", "doc", "id", "split", "bits", "prefix", "bytes", "page", "kept", "class_id", "class_docs", "least_key", "lines", "removed", "bad_id", "bad_key", "gone_doc", "gone_key", "site", "text_key", "deal"]
    names += ["__class_id", "__class_docs", "__gone", "__text", "__removed", "__shard", "__text_key", "__score", "__key", "__doc", "__split", "__bits", "__bytes", "__prefix", "__hot", "__deal", "__far_class_id", "a.b", "a`b"]
    return df.select("*", *(F.lit(i).alias(n) for i, n in enumerate(names)))


def prose(n, seed=0, size=400):
    import random

    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("aeioustrnlm") for _ in range(rng.randint(2, 9))) for _ in range(size)]
    return [rng.choice(vocabulary) for _ in range(n)]
