"""Byte-pair trees, alignments and collocations: against the plain libraries and brute force, and with odd input."""

import hashlib
import random

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from orrery.llm import bytepair
from orrery.llm.queries import QUERIES, tokenizer_path
from tests.llm.common import DOCS, documents, with_odd_columns

MULTI = tokenizer_path("byte_bpe_multi_50k.tiktoken")
ODD = [(1, None), (2, ""), (3, " \n .,; "), (4, "Ünïcode ÉCOLE"), (None, "no id here at all"), (5, "twice the same row"), (5, "twice the same row"), (6, "<|endoftext|> <s>▁x"), (7, "a\x00b\x1cc\x85d  e   f \n\n g\n")]


@pytest.fixture(scope="module")
def pairs():
    return bytepair.BytePairs(MULTI, public_tokenizers.PATTERN)


def test_trees_equal_one_piece(pairs, monkeypatch):
    rng = random.Random(1)
    some = ["a", "aa", "the", " ", "  ", "\n", "'", "'s", "re", "1", "23", "é", "漢", "!!", "-", "\t", "x" * 50, "<|endoftext|>", "▁", "\x00", "s", "\x1c", "\x85", "​", "　"]
    for window in (2_048, 10):
        monkeypatch.setattr(bytepair, "LONG_WINDOW", window)
        for i in range(600):
            few = rng.sample(some, rng.randint(1, len(some)))
            text = "".join(rng.choice(few) for _ in range(rng.randint(0, 150)))
            for leaf in (1, 5, 40):
                whole = pairs.encoding.encode_ordinary(text)
                assert pairs.segment(text, leaf).ids.tolist() == whole, (i, text, leaf)
        assert pairs.decode(pairs.segment(text).ids, 3) == text.encode()


def test_long_words_are_joined_by_small_windows(pairs, monkeypatch):
    rng, seen = random.Random(2), []
    text = "".join(rng.choice(["a", "b", "th", "e", "ing"]) for _ in range(40_000))
    plain = pairs._piece
    monkeypatch.setattr(pairs, "_piece", lambda data: seen.append(len(data)) or plain(data))
    assert pairs.segment(text, 4_000).ids.tolist() == pairs.encoding.encode_ordinary(text)
    assert 0 < max(seen) < 1_000


def test_encoded_documents(spark, pairs):
    rng = random.Random(3)
    rows = [*ODD, *((10 + i, "".join(rng.choice(["word ", "x", "\n", "é", " "]) for _ in range(rng.randint(0, 900)))) for i in range(30))]
    rows += [(90, "long " * 3_000), (91, "y" * 9_000), (92, " " * 5_000), (None, "z " * 2_000), (90, "long " * 3_000), (93, "long " * 3_000)]
    docs = with_odd_columns(documents(spark, rows)).withColumns({c: F.lit(1) for c in ("digest", "copies", "node", "ids")})
    expected = []
    for d, t, *_ in rows:
        ids = pairs.encoding.encode_ordinary(t or "")
        expected.append((d if d is not None else -1, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    for part in (1 << 16, 100):
        got = bytepair.encoded(docs, MULTI, public_tokenizers.PATTERN, part=part, leaf=64).collect()
        assert sorted((r["doc_id"] if r["doc_id"] is not None else -1, *r[1:]) for r in got) == sorted(expected)
    assert bytepair.encoded(spark.createDataFrame([], DOCS), MULTI, public_tokenizers.PATTERN).count() == 0


def test_op11_equals_the_library(spark, pairs):
    folder = "/root/testdata/sf0.001"
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()}
    got = QUERIES["op11_bytepair"](spark, folder).collect()
    assert len(got) == len(texts)
    for r in got:
        ids = pairs.encoding.encode_ordinary(texts[r["doc_id"]])
        assert (r["n_tokens"], r["ids_sha256"]) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
        assert r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest()


def tokens_of(text, a, b):
    """Ids and byte ends on both sides; nothing if the bytes differ."""
    whole = (" " + (text or "")).encode()
    x, y = a.encode_ordinary(" " + (text or "")), b.encode(text or "")
    as_bytes = [bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode() for i in y for p in [b.id_to_piece(i)]]
    if not text or a.decode_bytes(x) != whole or b"".join(as_bytes) != whole:
        return [], [], [], []
    ends = lambda parts: [sum(map(len, parts[: i + 1])) for i in range(len(parts))]
    return x, ends([a.decode_single_token_bytes(i) for i in x]), y, ends(as_bytes)


def brute_alignment(texts):
    import base64

    import sentencepiece
    import tiktoken

    with open(tokenizer_path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(t): int(i) for t, i in map(bytes.split, f)}
    a = tiktoken.Encoding("a", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    b = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path("piece_bpe_32k.model"))
    links, groups, sizes, counts = [], [], [], {}
    for text in texts:
        x, xe, y, ye = tokens_of(text, a, b)
        found, j = [], 0
        for i, e in enumerate(xe):
            begin = xe[i - 1] if i else 0
            while j and ye[j - 1] > begin:
                j -= 1
            while j < len(ye) and ye[j] <= begin:
                j += 1
            while j < len(ye) and (ye[j - 1] if j else 0) < e:
                found.append((x[i], y[j]))
                j += 1
        links.append(found)
        sizes.append((len(x), len(y)))
        for pair in set(found):
            counts[pair] = counts.get(pair, 0) + 1
        cut, text_groups = 0, []
        for e in sorted(set(xe) & set(ye)):
            side = lambda ids, ends: ",".join(str(i) for i, at in zip(ids, ends, strict=True) if cut < at <= e)  # noqa: B023, E731
            text_groups.append(side(x, xe) + "|" + side(y, ye))
            cut = e
        groups.append(text_groups)
    most = {}
    for (i, _), n in counts.items():
        most[i] = max(n, most.get(i, 0))
    out = []
    for found, text_groups, size in zip(links, groups, sizes, strict=True):
        digest = hashlib.sha256(";".join(text_groups).encode()).hexdigest() if text_groups else ""
        out.append((*size, len(text_groups), len(found), sum(counts[p] == most[p[0]] for p in found), sum(counts[p] for p in found), digest))
    return out


def test_alignment_equals_brute_force(spark):
    from orrery.llm.alignment import aligned

    rng = random.Random(5)
    some = ["the ", "tokens", " ", "  ", "\n", " \n", "é", "漢字 ", "naïve ", "x1y2 ", ".", "!!! ", "aaaa", "ing ", "▁", "\t", "<s>", "can't ", " ", "\x00"]
    rows = [*ODD, *((10 + i, "".join(rng.choice(some) for _ in range(rng.randint(0, 60)))) for i in range(60))]
    rows += [(100 + i, "common words are here in all of them " * 3) for i in range(40)] + [(200, "word " * 3_000 + "end"), (201, "w" * 2_000), (None, "naïve tokens"), (202, "a ▁ b ")]
    docs = with_odd_columns(documents(spark, rows)).withColumns({c: F.lit(1) for c in ("block", "doc", "n_a", "pair", "part")}).repartition(3)
    expected = sorted((d if d is not None else -1, *x) for (d, *_), x in zip(rows, brute_alignment([t for _, t, *_ in rows]), strict=True))
    from orrery.llm import alignment

    for hot, block in ((1 << 22, 4 << 20), (20, 300)):
        alignment.BLOCK_CHARS = block
        try:
            got = aligned(docs, tokenizer_path("byte_bpe_50k.tiktoken"), tokenizer_path("piece_bpe_32k.model"), public_tokenizers.PATTERN, hot).collect()
        finally:
            alignment.BLOCK_CHARS = 4 << 20
        assert sorted((r["doc_id"] if r["doc_id"] is not None else -1, *r[1:]) for r in got) == expected
    assert aligned(spark.createDataFrame([], DOCS), tokenizer_path("byte_bpe_50k.tiktoken"), tokenizer_path("piece_bpe_32k.model"), public_tokenizers.PATTERN).count() == 0


def test_op12_equals_brute_force(spark):
    folder = "/root/testdata/sf0.001"
    rows = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()
    expected = {r["doc_id"]: x for r, x in zip(rows, brute_alignment([r["text"] for r in rows]), strict=True)}
    assert {r["doc_id"]: tuple(r[1:]) for r in QUERIES["op12_alignment"](spark, folder).collect()} == expected


def brute_phrases(rows, least, longest, covered, top):
    import re

    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    f, n = {}, {}
    for lang, text in rows:
        lang = lang if lang is not None else "und"
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(lower)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] = n.get(lang, 0) + len(w)
            for m in range(1, longest + 1):
                for i in range(len(w) - m + 1):
                    f[lang, tuple(w[i : i + m])] = f.get((lang, tuple(w[i : i + m])), 0) + 1
    some = {k: a for k, a in f.items() if len(k[1]) > 1 and a >= least}
    over = {}
    for (lang, p), a in some.items():
        for m in range(2, len(p)):
            for i in range(len(p) - m + 1):
                over[lang, p[i : i + m]] = max(a, over.get((lang, p[i : i + m]), 0))
    out = {}
    for (lang, p), a in some.items():
        if 100 * over.get((lang, p), 0) < covered * a:
            score, _, left, right = min((1000000 * a * a // (f[lang, p[:k]] * f[lang, p[k:]]), k, f[lang, p[:k]], f[lang, p[k:]]) for k in range(1, len(p)))
            out.setdefault(lang, []).append((-score, -a, " ".join(p).encode(), left, right))
    return sorted((lang, i + 1, p.decode(), -a, x, y, n[lang], -s) for lang, found in out.items() for i, (s, a, p, x, y) in enumerate(sorted(found)[:top]))


def test_collocations_equal_brute_force(spark):
    from orrery.llm.phrases import collocations

    rng = random.Random(7)
    vocabulary = ["New", "york", "city", "the", "of", "É", "漢", "x-y", "a\x00b", "\u00a0"]
    make = lambda: "".join(rng.choice(vocabulary) + rng.choice([" ", " ", " ", "\t", "  ", ". ", "\n", ", "]) for _ in range(rng.randint(0, 60)))
    rows = [(d, t, None if d == 3 else "en") for d, t, *_ in ODD] + [(20 + i, make(), ["en", "de", None, "und"][i % 4]) for i in range(60)] + [(90, "new york " * 500, "en"), (91, "new york " * 500, "fr")]
    docs = with_odd_columns(documents(spark, rows)).withColumns({c: F.lit(1) for c in ("prefix", "part", "words", "n", "rank")})
    pairs_of = [(lang, t) for _, t, lang in rows]
    for least, longest, covered, top, hot in ((10, 3, 50, 2000, 1 << 21), (3, 4, 30, 2000, 5), (2, 2, 50, 7, 40)):
        got = sorted(tuple(r) for r in collocations(docs, least, longest, covered, top, hot).collect())
        assert got == brute_phrases(pairs_of, least, longest, covered, top)
    assert collocations(spark.createDataFrame([], DOCS)).count() == 0


def test_growth_is_exact_at_large_counts(spark):
    """Products beyond 64 bits: the score's arithmetic on its own."""
    from orrery.llm.phrases import SCORE

    rows = [(3_000_000_000, 5_000_000_000, 7_000_000_001), (10**13, 10**13 + 7, 10**13 + 9)]
    got = [r[0] for r in spark.createDataFrame(rows, "a long, l long, r long").select(F.expr(SCORE)).collect()]
    assert got == [1000000 * a * a // (x * y) for a, x, y in rows]
