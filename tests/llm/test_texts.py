"""Decontamination, near duplicates, lines, sharding: against brute force, and with odd input."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from orrery.llm import neardup, textkit
from orrery.llm.decontaminate import contamination, decontaminated
from orrery.llm.lines import spread_lines, without_spread_lines
from orrery.llm.queries import ORACLES, QUERIES
from orrery.llm.sharding import shards, write_shards
from tests.llm.common import DOCS, documents, prose, with_odd_columns, words
from tests.oracle import same

DATA = "/root/testdata/sf0.001"
ODD = [(1, None), (2, ""), (3, " \n .,; "), (4, "Ünïcode ÉCOLE"), (None, "no id here at all"), (5, "twice the same row"), (5, "twice the same row")]


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equals_sql(spark, name):
    same(spark, QUERIES[name], ORACLES[name], DATA)


def test_words_in_spark_and_numpy_agree(spark):
    import pyarrow as pa

    texts = [None, "", "Ab-cd École 12x", "ÀB ab\x00c", "x" * 3000, "Éa Éa éa"]
    got = [r["w"] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(textkit.words(F.col("t")).alias("w")).collect()]
    assert got == [words(t) for t in texts]
    hashes = {}
    for lo, hi, data, offsets in textkit.slices(pa.array(texts, pa.string()), budget=10):
        h, bounds = textkit.token_hashes(data, offsets)
        for i in range(lo, hi):
            own = h[bounds[i - lo] : bounds[i - lo + 1]]
            assert len(own) == len(words(texts[i]))
            for w, x in zip(words(texts[i]), own, strict=True):
                assert hashes.setdefault(w, x) == x
    assert len(set(hashes.values())) == len(hashes)


def hits(text, items, window=10):
    w, covered, found = words(text), set(), set()
    for item, t in items:
        iw = words(t)
        n = min(len(iw), window)
        for i in range(len(iw) - n + 1 if n else 0):
            for j in range(len(w) - n + 1):
                if w[j : j + n] == iw[i : i + n]:
                    covered |= set(range(j, j + n))
                    found |= {str(item)} - {"None"}
    return len(w), len(covered), sorted(found)


def test_contamination_equals_brute_force(spark):
    base = prose(60, 1)
    items = [(7, " ".join(base[:30])), (8, "Short Item here"), (9, "pair one"), (10, "solo"), (11, None), (12, "..."), (None, " ".join(base[30:45])), (8, "Short Item here")]
    rng = random.Random(2)
    rows = [(100 + i, " ".join(prose(20, i + 5) + base[(a := rng.randint(0, 40)) : a + rng.randint(5, 20)] + prose(9, i))) for i in range(20)]
    rows += [(200, "a SHORT item, here; pair one. Solo"), (201, " ".join(base * 3)), *ODD]
    docs = with_odd_columns(documents(spark, rows))
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", F.lit(1))
    for block in (200_000, 9):
        got = sorted(((r["doc_id"] or -1), r["n_words"], r["n_hit"], r["item_ids"]) for r in contamination(docs, bench, block_windows=block).collect())
        assert got == sorted(((d or -1), *hits(t, items)) for d, t, *_ in rows)
    clean = decontaminated(docs, bench)
    assert clean.columns == docs.columns
    assert sorted(r["doc_id"] or -1 for r in clean.select("doc_id").collect()) == sorted((d or -1) for d, t, *_ in rows if not hits(t, items)[1])


def test_contamination_of_empty_tables(spark):
    docs, none = documents(spark, [(1, "a b c"), (2, None)]), spark.createDataFrame([], "item_id long, text string")
    assert [r["n_hit"] for r in contamination(docs, none).collect()] == [0, 0]
    assert contamination(docs.where("doc_id < 0"), none).count() == 0


def shingles(text):
    w = words(text)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())


def brute_classes(rows, similarity=0.8):
    sets, parent = [shingles(t) for _, t in rows], list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            x, y = sets[i], sets[j]
            if (rows[i][1] or "") == (rows[j][1] or "") or (x and y and len(x & y) >= similarity * len(x | y)):
                parent[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), 1 << 60), 1 << 60 if d is None else d)
    return sorted((-1 if d is None else d, least[find(i)]) for i, (d, _) in enumerate(rows))


def test_classes_equal_brute_force(spark):
    rng, base, rows = random.Random(4), prose(150, 3), []
    for i in range(60):  # one group around a base, each copy with its own changes
        w = list(base)
        for _ in range(rng.randint(0, 6)):
            w[rng.randrange(len(w))] = rng.choice(prose(40, 9))
        rows.append((1000 - i, " ".join(w)))
    for g in range(8):
        w = prose(rng.randint(3, 60), 50 + g)
        rows += [(2000 + 10 * g + i, " ".join(w[: len(w) - (i % 2)])) for i in range(4)]
    rows += [(3000 + i, rows[0][1]) for i in range(30)] + ODD
    rows = [(d, t) for d, t, *_ in rows]
    docs = with_odd_columns(documents(spark, rows))
    got = neardup.classes(docs)
    found = sorted((-1 if r["row"]["doc_id"] is None else r["row"]["doc_id"], 1 << 60 if r["class_id"] is None else r["class_id"]) for r in got.collect())
    assert found == brute_classes(rows)
    kept = neardup.one_of_each(docs)
    assert kept.columns == docs.columns
    assert kept.count() == len({c for _, c in brute_classes(rows)})


def test_classes_of_whole_documents_equal_a_set_join(spark):
    """Every link of sf0.01's documents at 0.8, found through all shingles that two texts share."""
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()]
    sets, having, parent = [shingles(t) for _, t in rows], {}, list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    first, near = {}, 0
    for i, x in enumerate(sets):
        parent[i] = first.setdefault(rows[i][1] or "", i)
        shared = {}
        for s in x:
            for j in having.setdefault(s, []):
                shared[j] = shared.get(j, 0) + 1
            having[s].append(i)
        for j, n in shared.items():
            if n >= 0.8 * (len(x) + len(sets[j]) - n):
                near += rows[i][1] != rows[j][1]
                parent[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), d), d)
    assert near >= 10
    got = {r["doc_id"]: r["class_id"] for r in QUERIES["op2_minhash_neardup"](spark, "/root/testdata/sf0.01").collect()}
    assert got == {d: least[find(i)] for i, (d, _) in enumerate(rows)}


def test_links_between_classes_are_found(spark):
    """Two groups of copies around leaders that are not similar enough, joined by one pair of members."""
    w = prose(200, 31, 4000)
    change = lambda text, at, seed: text[:at] + prose(8, seed, 4000) + text[at + 8 :]
    left, right = [change(w, 10, 1)], [change(w, 150, 2)]
    left += [change(left[0], 60, s) for s in range(10, 18)]
    right += [change(right[0], 100, s) for s in range(20, 28)]
    rows = [(i, " ".join(t)) for i, t in enumerate([w, *left, *right])] + [(90, "a few words"), (91, None), (92, "x " * 50_000), (93, "x " * 50_001)]
    assert sorted((r["row"]["doc_id"], r["class_id"]) for r in neardup.classes(documents(spark, rows)).collect()) == brute_classes(rows)
    assert neardup.one_of_each(spark.createDataFrame([], DOCS)).count() == 0


def test_classes_of_an_empty_table(spark):
    assert neardup.classes(spark.createDataFrame([], DOCS)).count() == 0


@pytest.mark.parametrize("weights", ["set", "count"])
def test_darts_agree_with_weighted_similarity(weights):
    rng = np.random.default_rng(0)
    element = rng.integers(1, 1 << 62, 300).astype(np.uint64)
    w = rng.integers(1, 6, 300).astype(float) if weights == "count" else np.ones(300)
    other = np.where(np.arange(300) < 240, w, 0)
    both = np.concatenate([element, element[:240]])
    text = np.repeat([0, 1], [300, 240])
    sign = neardup.signatures(both, text, np.concatenate([w, other[:240]]), 3, k=2000)
    expected = np.minimum(w, other).sum() / np.maximum(w, other).sum()
    assert abs((sign[0] == sign[1]).mean() - expected) < 0.04
    assert not np.isinf(sign[:2].view(float)).any() and np.isinf(sign[2].view(float)).all()


def test_lines_keep_one_occurrence(spark):
    rows = [(i, f"own {i}\n shared line \n\nown {i}", "en", f"s{i % 6}") for i in range(12)]
    rows += [(20, "shared line\nshared line\nrest", "en", None), (21, None), (22, "rare\nrare", "en", "s1"), (30, "shared line", "en", "s2"), (30, "shared line", "en", "s2"), (None, "shared line\nx", "en", "s3")]
    docs = with_odd_columns(documents(spark, rows))
    out = {(r["row"]["doc_id"], r["row"]["text"]): r["text"] for r in spread_lines(docs, 5).collect()}
    assert out[0, rows[0][1]] == rows[0][1]
    assert out[3, rows[3][1]] == "own 3\n\nown 3"
    assert (out[20, rows[12][1]], out[21, None], out[22, "rare\nrare"], out[30, "shared line"], out[None, "shared line\nx"]) == ("rest", None, "rare\nrare", "", "x")
    cleaned = without_spread_lines(docs, 5)
    assert cleaned.columns == docs.columns and cleaned.count() == len(rows)
    assert cleaned.where("doc_id = 3").first()["n_chars"] == len("own 3\n\nown 3")
    assert spread_lines(docs, 7).agg(F.sum("removed")).first()[0] == 0
    assert spread_lines(docs.where("doc_id = -5"), 5).count() == 0


def test_shards_fit_and_hold_all(spark, tmp_path):
    rng = random.Random(6)
    rows = [(i, "x" * rng.randint(0, 300)) for i in range(400)] + [(7, "same" * 20)] * 60 + [(8, None), (None, ""), (9, "y" * 3000)]
    docs = documents(spark, rows)
    out = shards(docs, 2000)
    assert out.count() == len(rows)
    held = out.groupBy("shard", "page").agg(F.sum("bytes").alias("b"), F.count("*").alias("n")).collect()
    assert all(r["b"] <= 2000 or r["n"] == 1 or r["b"] >= 3000 for r in held)
    assert sum(r["b"] > 2000 for r in held) == 1
    names = sorted({r["shard"] for r in held if "-" not in r["shard"]})
    assert not any(b.startswith(a) for a, b in zip(names, names[1:], strict=False))
    assert shards(docs.where("doc_id < 0"), 10).count() == 0
    write_shards(documents(spark, rows[:50]), f"{tmp_path}/s", 2000)
    assert spark.read.parquet(f"{tmp_path}/s").count() == 50


def test_items_digest_of_no_items(spark):
    row = QUERIES["op1_decontaminate"](spark, DATA).where("not contaminated").first()
    assert row["items_sha256"] == hashlib.sha256(b"").hexdigest()


def test_callers_columns_stay_whatever_their_names(spark):
    from orrery.llm.lines import spread_lines
    from orrery.llm.quality import good_documents
    from orrery.llm.sharding import placed

    docs = with_odd_columns(documents(spark, [*ODD, *((50 + i, f"shared line\nown {i} " + " ".join(prose(30, i)), "en", f"s{i}") for i in range(8))]))
    bench = spark.createDataFrame([(1, " ".join(prose(30, 3)))], "item_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(50, 58)], "doc_id long, quality int")
    rest = [c for c in docs.columns if c not in ("text", "n_chars")]
    whole = sorted(map(repr, docs.select(*(f"`{c.replace('`', '``')}`" for c in rest)).collect()))
    some = lambda df: sorted(map(repr, df.select(*(F.col("row").getField(c).alias(c) if "row" in df.columns and len(df.columns) < 9 else F.col(f"`{c.replace('`', '``')}`") for c in rest)).collect()))
    for out in (neardup.classes(docs), spread_lines(docs), placed(docs, 100), without_spread_lines(docs)):
        assert some(out) == whole
    for out in (neardup.one_of_each(docs), decontaminated(docs, bench), good_documents(docs, labels)):
        assert out.columns == docs.columns
        assert set(some(out)) <= set(whole)


def test_hot_keys_join_like_others(spark):
    from orrery.llm.session import join_hot

    rows = spark.createDataFrame([(i % 7 if i % 3 else 1, i) for i in range(300)] + [(None, -1)], "k int, v int")
    table = spark.createDataFrame([(k, f"t{k}") for k in range(0, 6)], "k int, t string")
    want = sorted(map(repr, rows.join(table, "k", "left").select("k", "v", "t").collect()))
    for most, shares in ((100, 8), (0, 8), (0, 2048)):
        assert sorted(map(repr, join_hot(rows, table, "k", most, shares).select("k", "v", "t").collect())) == want
