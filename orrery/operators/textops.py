"""Text checks on documents: formulas, blocks of lines, multisets, script counts, graders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def display_math(text: Column) -> Column:
    """All \\[..\\] and \\(..\\) formulas, without their tags, blanks squeezed."""
    found = F.regexp_extract_all(text, F.lit(r"(?s)(\\\[.*?\\\]|\\\(.*?\\\))"), F.lit(1))
    return F.transform(found, lambda x: F.trim(F.regexp_replace(F.regexp_replace(x, r"\\tag\{[^}]*\}", ""), r"\s+", " ")))


def han_count(text: Column) -> Column:
    """Characters from U+4E00 to U+9FFF."""
    return F.length(text) - F.length(F.regexp_replace(text, "[\u4e00-\u9fff]", ""))


def block_kind(line: Column) -> Column:
    return (
        F.when(F.trim(line) == "", F.lit(None))
        .when(line.startswith("#"), "heading")
        .when(line.startswith(">"), "blockquote")
        .when(line.contains("|"), "table")
        .when(line.startswith("\\["), "display_math")
        .otherwise("paragraph")
    )


def blocks(documents: DataFrame, text: str = "text", doc: str = "doc_id") -> DataFrame:
    """Runs of lines of one kind: document, block number, kind, first line, lines, characters, preview of 160."""
    lines = documents.select(doc, F.posexplode(F.split(text, "\n")).alias("at", "line")).withColumn("kind", block_kind(F.col("line")))
    order = Window.partitionBy(doc).orderBy("at")
    before = F.lag("kind").over(order)
    starts = F.col("kind").isNotNull() & ~F.coalesce(before.eqNullSafe(F.col("kind")), F.lit(False))
    numbered = lines.withColumn("block", F.sum(F.when(starts, 1).otherwise(0)).over(order)).where("kind is not null")
    joined = F.concat_ws(" ", F.transform(F.array_sort(F.collect_list(F.struct("at", "line"))), lambda x: x["line"]))
    preview = F.left(F.regexp_replace(joined, r"\s+", " "), F.lit(160))
    return numbered.groupBy(doc, "block").agg(F.first("kind").alias("kind"), F.min("at").alias("first_line"), F.count("*").alias("lines"), F.sum(F.length("line")).alias("chars"), preview.alias("preview"))


def multiset_missing(source: DataFrame, candidate: DataFrame, by: list[str]) -> DataFrame:
    """Items that the source has more often than the candidate, with how many are missing."""
    a = source.groupBy(*by).agg(F.count("*").alias("a"))
    b = candidate.groupBy(*by).agg(F.count("*").alias("b"))
    return a.join(b, by, "left").select(*by, (F.col("a") - F.coalesce("b", F.lit(0))).alias("missing")).where("missing > 0")


def grade(kind: str, output: Column, expected: Column, tolerance: float = 0.0) -> Column:
    """Scores of the graders exact, contains, regex and numeric_abs_error."""
    if kind == "numeric_abs_error":
        err = F.abs(output.try_cast("double") - expected.try_cast("double"))
        return F.coalesce(F.greatest(F.lit(0.0), 1.0 - err / tolerance), F.lit(0.0))
    test = {"exact": F.trim(output) == F.trim(expected), "contains": F.contains(output, expected), "regex": F.regexp_like(output, expected)}[kind]
    return F.when(F.coalesce(test, F.lit(False)), 1.0).otherwise(0.0)


def summarize(results: DataFrame, by: str, score: str, weight: str) -> DataFrame:
    """Weighted score and pass rate."""
    return results.groupBy(by).agg((F.sum(F.col(score) * F.col(weight)) / F.sum(weight)).alias("score"), F.avg((F.col(score) >= 1.0).cast("double")).alias("pass_rate"), F.count("*").alias("n"))
