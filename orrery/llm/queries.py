"""The registered queries of this subpackage and, where SQL can express them, their oracles."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.llm.alignment import aligned
from orrery.llm.bytepair import encoded
from orrery.llm.decontaminate import contamination
from orrery.llm.html import extract
from orrery.llm.langid import languages
from orrery.llm.lines import spread_lines
from orrery.llm.neardup import document_classes
from orrery.llm.packing import pack
from orrery.llm.phrases import collocations
from orrery.llm.quality import quality_scores
from orrery.llm.secrets import findings
from orrery.llm.session import read_table
from orrery.llm.sharding import shards
from orrery.llm.topk import quantised, top_k


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    """Where the vocabulary lies: in the folder TOKENIZERS_DIR names, else where the installed package has it."""
    if "TOKENIZERS_DIR" in os.environ:
        return os.path.join(os.environ["TOKENIZERS_DIR"], name)
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "item_ids"), 256).alias("items_sha256"), "contaminated",
    )


def op2_minhash_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return document_classes(read_table(spark, sf_dir, "documents"))


def op3_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(read_table(spark, sf_dir, "pages"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(read_table(spark, sf_dir, "documents"), tokenizer_path())


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards(read_table(spark, sf_dir, "documents"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = spread_lines(read_table(spark, sf_dir, "documents"))
    return found.select("row.doc_id", F.col("lines").cast("long").alias("n_lines"), F.col("removed").cast("long").alias("n_removed"), F.md5("text").alias("text_md5"))


def op8_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(quantised(read_table(spark, sf_dir, "embeddings")), F.col("vec_id") % 100 == 0)


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return findings(read_table(spark, sf_dir, "documents"))


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return languages(read_table(spark, sf_dir, "documents"))


def op11_bytepair(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return encoded(read_table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return aligned(read_table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.tiktoken"), tokenizer_path("piece_bpe_32k.model"), public_tokenizers.PATTERN)


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(read_table(spark, sf_dir, "documents"))


QUERIES = {
    f.__name__: f
    for f in (op1_decontaminate, op2_minhash_neardup, op3_html_text, op4_quality, op5_packing, op6_sharding, op7_line_dedup, op8_topk, op9_secrets, op10_language, op11_bytepair, op12_alignment, op13_collocations)
}

ORACLES = {
    "op1_decontaminate": r"""
        WITH words AS (
            SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
        items AS (
            SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
        windows AS (
            SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS win
            FROM (SELECT item_id, w, least(len(w), 10) AS n, unnest(generate_series(1, len(w) - least(len(w), 10) + 1)) AS i FROM items WHERE len(w) > 0)),
        sizes AS (SELECT DISTINCT n FROM windows),
        places AS (
            SELECT r, n, i, array_to_string(w[i:i + n - 1], ' ') AS win
            FROM (SELECT r, w, n, unnest(generate_series(1, len(w) - n + 1)) AS i FROM words, sizes WHERE len(w) >= n)),
        hits AS (SELECT p.r, p.i, p.n, v.item_id FROM places p JOIN windows v ON p.win = v.win AND p.n = v.n),
        covered AS (SELECT r, count(DISTINCT j) AS n_hit FROM (SELECT r, unnest(generate_series(i, i + n - 1)) AS j FROM hits) GROUP BY r),
        named AS (SELECT r, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS id FROM hits) GROUP BY r)
        SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
               sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
        FROM words LEFT JOIN covered USING (r) LEFT JOIN named USING (r)""",
    "op6_sharding": r"""
        WITH docs AS (
            SELECT doc_id, coalesce(strlen(text), 0) AS bytes, md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
        hashed AS (
            SELECT doc_id, bytes, array_to_string(list_transform(string_split(left(h, 8), ''), lambda c: substr('0000000100100011010001010110011110001001101010111100110111101111', 4 * strpos('0123456789abcdef', c) - 3, 4)), '') AS bits FROM docs),
        levels AS (SELECT doc_id, bytes, bits, unnest(generate_series(0, 16)) AS depth FROM hashed),
        sums AS (SELECT left(bits, depth) AS shard, depth, sum(bytes) AS total FROM levels GROUP BY ALL),
        least_depth AS (
            SELECT l.doc_id, l.bytes, l.bits, min(l.depth) AS depth
            FROM levels l JOIN sums s ON left(l.bits, l.depth) = s.shard AND l.depth = s.depth WHERE s.total <= 1048576 GROUP BY ALL)
        SELECT doc_id, CAST(bytes AS BIGINT) AS bytes, left(bits, depth) AS shard, CAST(0 AS BIGINT) AS page FROM least_depth""",
    "op7_line_dedup": r"""
        WITH pieces AS (
            SELECT doc_id, source, md5(text) AS k, unnest(string_split(text, chr(10))) AS line, unnest(generate_series(0, len(string_split(text, chr(10))) - 1)) AS pos FROM documents WHERE text IS NOT NULL),
        lines AS (SELECT doc_id, source, k, pos, trim(line, ' ') AS line FROM pieces WHERE trim(line, ' ') <> ''),
        common AS (
            SELECT line, min({'d': doc_id, 'a': pos}) AS f FROM lines GROUP BY line HAVING count(DISTINCT source) >= 5),
        gone AS (
            SELECT doc_id, k, pos FROM lines JOIN common USING (line) WHERE NOT (f.d IS NOT DISTINCT FROM doc_id AND f.a = pos)),
        kept AS (
            SELECT p.doc_id, p.k, count(*) AS n_lines, count(g.pos) AS n_removed,
                   coalesce(string_agg(p.line, chr(10) ORDER BY p.pos) FILTER (WHERE g.pos IS NULL), '') AS text
            FROM (SELECT DISTINCT doc_id, k, pos, line FROM pieces) p LEFT JOIN gone g ON p.doc_id IS NOT DISTINCT FROM g.doc_id AND p.k = g.k AND p.pos = g.pos
            GROUP BY p.doc_id, p.k)
        SELECT d.doc_id, CAST(coalesce(n_lines, 0) AS BIGINT) AS n_lines, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, md5(kept.text) AS text_md5
        FROM documents d LEFT JOIN kept ON d.doc_id IS NOT DISTINCT FROM kept.doc_id AND md5(d.text) = kept.k""",
    "op8_topk": r"""
        WITH v AS (
            SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS q
            FROM embeddings WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS (
            SELECT a.vec_id AS query_id, b.vec_id, CAST(list_sum(list_transform(list_zip(a.q, b.q), lambda z: z[1] * z[2])) AS BIGINT) AS score
            FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
        r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
        SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10""",
    "op13_collocations": r"""
        WITH pieces AS (
            SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
        words AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
        grams AS (SELECT lang, m, unnest(list_transform(generate_series(1, len(w) - m + 1), lambda i: w[i:i + m - 1])) AS p FROM words, (SELECT unnest([1, 2, 3]) AS m) WHERE len(w) >= m),
        f AS (SELECT lang, m, p, count(*) AS f FROM grams GROUP BY ALL),
        n AS (SELECT lang, sum(f) AS n FROM f WHERE m = 1 GROUP BY lang),
        cand AS (SELECT lang, m, p, f AS a FROM f WHERE m > 1 AND f >= 10),
        cut AS (
            SELECT c.lang, c.m, c.p, c.a, k, x.f AS l, y.f AS r, (1000000 * CAST(c.a AS HUGEINT) * c.a) // (CAST(x.f AS HUGEINT) * y.f) AS score
            FROM (SELECT *, unnest(generate_series(1, m - 1)) AS k FROM cand) c
            JOIN f x ON x.lang = c.lang AND x.p = c.p[1:k] JOIN f y ON y.lang = c.lang AND y.p = c.p[k + 1:c.m]),
        scored AS (SELECT * FROM cut QUALIFY row_number() OVER (PARTITION BY lang, p ORDER BY score, k) = 1),
        inside AS (SELECT lang, p[1:2] AS p, a AS o FROM cand WHERE m = 3 UNION ALL SELECT lang, p[2:3], a FROM cand WHERE m = 3),
        kept AS (SELECT s.* FROM scored s WHERE NOT EXISTS (SELECT 1 FROM inside i WHERE i.lang = s.lang AND i.p = s.p AND 100 * i.o >= 50 * s.a)),
        ranked AS (SELECT *, array_to_string(p, ' ') AS phrase, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, array_to_string(p, ' ')) AS rank FROM kept)
        SELECT lang, CAST(rank AS BIGINT) AS rank, phrase, CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score
        FROM ranked JOIN n USING (lang) WHERE rank <= 2000""",
}
