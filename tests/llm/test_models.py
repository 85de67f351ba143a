"""HTML text, quality, packing, top-k, secrets, language, pipeline: against brute force, round trips, held-out accuracy."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from orrery.llm import langid, packing, quality, secrets
from orrery.llm.html import extract, main_text
from orrery.llm.queries import QUERIES, tokenizer_path
from orrery.llm import topk
from orrery.llm.topk import quantised, searched, top_k
from tests.llm.common import DOCS, documents, prose, with_odd_columns

DATA = "/root/testdata/sf0.01"
ODD = [(1, None), (2, ""), (3, "?"), (None, "no id"), (5, "same"), (5, "same"), (6, "z" * 200_000)]


def test_html_page():
    page = """<!DOCTYPE html><html><head><title>T</title><script>var a="<p>no</p>";</script><style>p{}</style></head><body>
    <header><h1>Site</h1></header><nav><ul><li><a href="/a">A</a></li></ul></nav><div class="cookie-notice">We use cookies</div>
    <div id="page"><div class="sidebar"><p>Side words here</p></div><article><header><h1>Title</h1></header><p>One &amp; two&nbsp;three
    <b>bold<br>text</b> &lt;tag&gt;<p>Second <a href="x">link</a>.<ul><li>item one<li>item two</ul><aside>Read more</aside><form><input><label>Mail</label></form></article>
    <section class="comments"><p>Great post, thanks a lot for all of it</p></section></div><footer>&copy; us</footer></body></html>"""
    assert main_text(page) == "Title\nOne & two three bold text <tag>\nSecond link.\nitem one\nitem two"
    plain = "<body><div class=menu><a href=1>Home</a> <a href=2>About</a></div><div><p>First paragraph of words.</p><p>Second one, &eacute;crit.</p></div><div class='ad'>Buy</div></body>"
    assert main_text(plain) == "First paragraph of words.\nSecond one, écrit."
    assert main_text("<p>Only one.</p>") == "Only one."
    assert main_text("no tags  at\nall") == "no tags at all"
    assert main_text("<article><p>cut off &am") == "cut off &am"
    assert main_text(None) == main_text("") == main_text("<nav>x</nav>") == ""
    assert main_text("<p>" * 3000 + "deep" + "<div>" * 3000 + "er") == "deep\ner"


def test_html_wrappers_keep_the_article():
    article = "<h1>Title</h1><p>One paragraph of some words.</p><p>And another one of them.</p>"
    want = "Title\nOne paragraph of some words.\nAnd another one of them."
    for mark in ("class='content has-sidebar'", "class=no-comments", "class='layout-with-nav'", "class=page-widget", "id=page class=sticky-header"):
        for inner in (f"<article>{article}</article>", article):
            page = f"<body><nav>Menu</nav><div {mark}>{inner}<div class=sidebar>Side words</div></div></body>"
            assert main_text(page) == want, page
    assert main_text(f"<form><article>{article}</article></form>") == main_text(f"<form><div>{article}</div></form>") == want
    comments = "<div class=comments><p>" + "A very long comment. " * 40 + "</p></div>"
    assert main_text(f"<article>{article}</article>{comments}") == want


def test_html_names_that_are_no_marks():
    for mark in ("id=related-work", "class=search-results", "class='share-price-table'", "class=no-sidebar", "class='header-less intro'"):
        page = f"<body><nav>Menu</nav><article><h1>T</h1><p>First words of it.</p><div {mark}><p>Part of the article.</p></div><p {mark}>And more of it.</p></article></body>"
        assert main_text(page) == "T\nFirst words of it.\nPart of the article.\nAnd more of it.", mark
    for mark in ("class=site-nav", "class='ad-300'", "id=sidebar-wrapper", "class='post comments-list'", "role=banner", "class=cookie-notice"):
        page = f"<body><article><h1>T</h1><p>First words of it.</p><div {mark}><p>Not of it.</p></div><p>And more of it, some words.</p></article></body>"
        assert main_text(page) == "T\nFirst words of it.\nAnd more of it, some words.", mark
    held = "<p>" + "Most of the article's words. " * 5 + "</p>"
    assert main_text(f"<article><h1>T</h1><div class=widget>{held}</div></article>") == "T\n" + ("Most of the article's words. " * 5).strip()


def test_html_several_articles():
    teaser = "<article><h2>Other</h2><a href=x>Read it</a></article>"
    long = "<article><h1>T</h1><p>" + "Words of the article. " * 9 + "</p></article>"
    assert main_text(f"<body><main>{long}<section>{teaser * 3}</section></main></body>") == "T\n" + ("Words of the article. " * 9).strip()
    parts = [f"<article><h2>Part {i}</h2><p>Some words of part {i}.</p></article>" for i in range(3)]
    assert main_text(f"<body><nav>Menu</nav><div>{''.join(parts)}</div><footer>x</footer></body>") == "\n".join(f"Part {i}\nSome words of part {i}." for i in range(3))


def test_html_odd_quotes():
    assert main_text('<article><p>One <a title="x>link</a> two.</p><p>Three "quoted" <b class=\'y>four</b>.</p></article>') == 'One link two.\nThree "quoted" four.'
    assert main_text('<article><p>One <img alt="a > b"> two <img alt="a < b"> three.</p></article>') == "One two three."
    assert main_text("<article><p>cut <a href='x") == "cut"
    assert main_text("<article><p>1 < 2 and 3 > 2 <b <i>four</i></p></article>") == "1 < 2 and 3 > 2 four"


def test_html_long_pages_take_linear_time():
    import time

    for page in (
        "<b>" * 8_000 + "x" + "</i>" * 100_000, "<article>" + "</p x>" * 100_000 + "x", "<div>" * 50_000 + "x" + "</span>" * 50_000, "<b>" * 20_000 + "<li>x" * 5_000,
        '<a "' * 50_000, "<p>" * 50_000 + "<b>" * 8_000 + "<div></div>" * 8_000 + "x", "<ul><li>" + "<b>" * 8_000 + "<li>y" * 8_000,
    ):
        began = time.process_time()
        main_text(page)
        assert time.process_time() - began < 6, page[:20]


LONG = "The long and quiet words of a text that goes on about its own matters, as texts will do when left alone. "


def test_html_places_and_titles_are_kept():
    """Ids that document generators write for headings, titles in headers of the text, what only narrow screens hide."""
    body = f"<h1>Guide</h1><p>{LONG * 4}</p>"
    for name, title in (("pagination", "Pagination"), ("search", "Search"), ("related-comments", "Related comments"), ("discussion", "Discussion")):
        page = f'<body><nav><a href="/">Home</a></nav><article>{body}<section id="{name}"><h2>{title}</h2><p>Own part. {LONG}</p></section></article><footer>f</footer></body>'
        assert f"{title}\nOwn part." in main_text(page)
    page = f'<body><article>{body}<section id="search"><h2>Find us</h2><p>Own part.</p></section><div class="comments" id="c"><h2>c</h2><p>Nice one</p></div></article></body>'
    assert "Own part" not in main_text(page) and "Nice one" not in main_text(page)
    page = f'<body><article>{body}<figure class="hidden md:block"><figcaption>A caption that stays here</figcaption></figure><p class="hidden">gone for good</p></article></body>'
    assert "A caption that stays" in main_text(page) and "gone for good" not in main_text(page)
    for header in ('<header class="entry-header"><h1>The title</h1></header>', '<div class="entry-header"><h1>The title</h1></div>'):
        page = f'<body><div class="site-header"><a href="/">Site</a></div><div class="post">{header}<p>{LONG * 3}</p><p>{LONG * 3}</p></div><footer>f</footer></body>'
        assert main_text(page).startswith("The title\n") and "Site" not in main_text(page)


def test_html_readers_comments_never_win():
    comments = "".join(f'<div class="post-message"><p>{LONG * 3}</p></div>' for _ in range(6))
    page = f'<body><article><h1>A short one</h1><p>Its only words, not many.</p></article><div id="disqus_thread">{comments}</div></body>'
    assert main_text(page) == "A short one\nIts only words, not many."
    page = f'<body><article><h1>A short one</h1><p>Its only words, not many.</p></article><div class="voices">{comments}</div></body>'
    assert main_text(page) == "A short one\nIts only words, not many."
    page = f'<body><article><h1>T</h1><p>{LONG * 4}</p><div id="discussion"><div class="comment-body">I liked it</div></div></article></body>'
    assert "I liked it" not in main_text(page)


def test_html_empty_table(spark):
    assert extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_html_table(spark):
    rows = [(1, "u", "<p>a</p>"), (2, None, None), (1, "u", "<p>a</p>"), (None, "v", "")]
    out = extract(with_odd_columns(spark.createDataFrame(rows, "page_id long, url string, html string")))
    assert sorted((r["page_id"] or 0, r["text"], r["n_chars"]) for r in out.collect()) == [(0, "", 0), (1, "a", 1), (1, "a", 1), (2, "", 0)]


def test_html_of_the_tables(spark):
    """The pages' articles have no elements within but p, b, br and h1."""
    from html import unescape

    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{DATA}/pages.parquet").collect()}
    for r in QUERIES["op3_html_text"](spark, DATA).collect():
        body = re.search(r"<article>(.*?)(</article>|$)", pages[r["page_id"]], re.S)[1]
        lines = re.sub(r"</?(?:p|h1)>", "\n", re.sub(r"</?b>", "", body)).replace("<br>", " ").split("\n")
        want = [x for x in (re.sub(r"\s+", " ", unescape(line)).strip() for line in lines) if x]
        assert r["text"].split("\n") == want


def test_quality_held_out(spark):
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    got = QUERIES["op4_quality"](spark, DATA).join(labels, "doc_id").where("held_out").toPandas()
    assert (got["predicted"] == got["quality"]).mean() > 0.9
    assert got["score"].between(0, 1).all()


def test_quality_odd_input(spark):
    docs = with_odd_columns(documents(spark, ODD + [(i, " ".join(prose(30, i))) for i in range(20, 60)]))
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(20, 60)] + [(None, 1, 0), (30, None, 1), (31, 0, 0)], "doc_id long, quality int, toxic int")
    out = quality.quality_scores(docs, labels)
    assert out.count() == docs.count() and out.where("score < 0 or score > 1 or score is null").count() == 0
    assert out.where("doc_id in (1, 2)").agg(F.count_distinct("score")).first()[0] == 1
    assert {r["score"] for r in quality.quality_scores(docs, labels.where("doc_id < 0")).collect()} == {0.5}
    assert quality.good_documents(docs, labels).columns == docs.columns
    assert quality.quality_scores(docs.where("doc_id = -1"), labels).count() == 0
    held = {r["doc_id"] for r in out.where("held_out").collect()}
    assert held == {d for d in [1, 2, 3, 5, 6, *range(20, 60)] if zlib.crc32(str(d).encode()) % 5 == 0}


def test_quality_model_equals_a_plain_loop(spark):
    """FTRL and the sparse dot products, one weight at a time."""
    import math

    rng = random.Random(3)
    rows = [np.array([rng.randint(1, 40) for _ in range(rng.randint(0, 30))], np.int32) for _ in range(60)]
    labels = np.array([rng.randint(0, 1) for _ in rows])
    got, z, n = quality.fit(rows, labels), {}, {}

    def weight(i):
        if abs(z.get(i, 0.0)) <= quality.L1:
            return 0.0
        return -(z[i] - math.copysign(quality.L1, z[i])) / ((quality.BETA + math.sqrt(n[i])) / quality.ALPHA + quality.L2)

    for _ in range(quality.EPOCHS):
        for row, y in zip(rows, labels, strict=True):
            x = {int(i): np.count_nonzero(row == i) / math.sqrt(max(len(row), 1)) for i in set(row.tolist())} | {0: 1.0}
            w = {i: weight(i) for i in x}
            p = 1 / (1 + math.exp(-sum(w[i] * v for i, v in x.items())))
            for i, v in x.items():
                g = (p - y) * v
                z[i] = z.get(i, 0.0) + g - (math.sqrt(n.get(i, 0.0) + g * g) - math.sqrt(n.get(i, 0.0))) / quality.ALPHA * w[i]
                n[i] = n.get(i, 0.0) + g * g
    assert np.allclose(got[:50], [weight(i) for i in range(50)]) and not got[50:].any()

    texts = ["Some words, twice: some words", None, "", "ÉCOLE 12 12", "w " * 40_000]
    weights = np.random.default_rng(2).normal(size=quality.BUCKETS)
    scored = {r["row"]["doc_id"]: r["score"] for r in quality.scores(documents(spark, list(enumerate(texts))), weights).collect()}
    for i, t in enumerate(texts):
        data = np.frombuffer((t or "").encode(), np.uint8)
        bucket, _ = quality.features(data, np.array([0, len(data)]))
        assert abs(scored[i] - 1 / (1 + math.exp(-(sum(weights[b] for b in bucket) / math.sqrt(max(len(bucket), 1)) + weights[0])))) < 1e-9


def test_quality_learns_from_a_bounded_number_of_rows(spark):
    docs = documents(spark, [(7, " ".join(prose(20, i))) for i in range(50)] + [(i, " ".join(prose(20, i))) for i in range(100, 130)])
    labels = spark.createDataFrame([(7, 1, 0)] + [(i, i % 2, 0) for i in range(100, 130)], "doc_id long, quality int, toxic int")
    assert np.array_equal(quality.train(docs, labels, sample=20), quality.train(docs.repartition(7), labels, sample=20))


def test_packing_round_trip(spark):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizer_path())
    rows = [(i, " ".join(prose(random.Random(i).randint(1, 900), i))) for i in range(10, 60)] + [(1, None), (2, ""), (3, "It's Über-Straße İstanbul ΣΑΣ é <|endoftext|> WE'LL a b c\x0bd 한글 ٣٤ _a__b_"), (4, "x " * 9000)]
    docs = with_odd_columns(documents(spark, rows)).repartition(3)
    out = packing.pack(docs, tokenizer_path(), capacity=256, open_windows=4, merge=2).toPandas()
    texts = dict(rows)
    for doc, pieces in out.groupby("doc_id"):
        ids = np.array([*tokenizer.encode(texts[doc] or "", add_special_tokens=False).ids, 1], "<u4")
        at = 0
        for p in pieces.sort_values("start").itertuples():
            assert (p.start, p.doc_tokens) == (at, len(ids))
            assert p.ids_crc32 == zlib.crc32(ids[at : at + p.length].tobytes())
            at += p.length
        assert at == len(ids)
    assert set(out["doc_id"]) == set(texts)
    for _, s in out.sort_values("offset").groupby("sequence_id"):
        assert list(s["offset"]) == [0, *s["length"].cumsum()[:-1]] and s["length"].sum() <= 256
    sizes = out.groupby("sequence_id")["length"].sum()
    assert (256 - sizes).sum() <= 256 * 4 * 3
    assert packing.pack(documents(spark, [(None, "a b"), (7, "a"), (7, "a")]), tokenizer_path()).count() == 3
    assert packing.pack(spark.createDataFrame([], DOCS), tokenizer_path()).count() == 0


def test_topk_equals_brute_force(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(0, 0.2, (700, 12))
    x[300:500] = x[300]  # many copies of one vector
    rows = [(i, [float(v) for v in row], 1) for i, row in enumerate(x)]
    rows += [(900, None, 1), (901, [], 1), (902, [1.0, None], 1), (903, [float("nan")] * 12, 1), (904, [float("inf")] * 12, 1), (None, [0.1] * 12, 1), (1000, [0.5], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = top_k(quantised(df), F.col("vec_id") % 100 == 0).toPandas()
    q = {i: np.floor(1024 * np.float32(row).astype(float)).astype(int) for i, row in enumerate(x)}
    q[1000] = np.array([512] + [0] * 11)
    for i in (0, 100, 300, 400, 600, 1000):
        want = sorted(((-int(q[i] @ v), j) for j, v in q.items() if j != i))[:10]
        own = got[got["query_id"] == i].sort_values("rank")
        assert [(-s, j) for s, j in zip(own["score"], own["vec_id"], strict=True)] == want
    assert len(got) == 80
    few = top_k(quantised(df.where("vec_id < 3")), F.col("vec_id") == 0)
    assert few.count() == 2
    assert top_k(quantised(df.where("vec_id < 0")), F.col("vec_id") == 0).count() == 0


def test_topk_index_grows_with_its_rows():
    sizes = [topk.index_size(n) for n in (0, 2_000, 10**6, 10**9, 10**12)]
    assert sizes[0] == sizes[1] == (topk.PIVOTS, topk.RINGS)
    keys = [p * r for p, r in sizes]
    assert keys[2] > keys[1] and keys[3] > 20 * keys[2] and keys[4] <= topk.MOST_RINGS
    assert 10**9 / keys[3] <= 2 * topk.RING_ROWS


@pytest.mark.parametrize("ring_rows", [16_384, 2])
def test_topk_prunes_clustered_vectors(spark, monkeypatch, ring_rows):
    """Small chunks and blocks, and many rings; on vectors in clusters a query meets less than half of the rows, and results are exact."""
    monkeypatch.setattr(topk, "RING_ROWS", ring_rows)
    monkeypatch.setattr(topk, "CHUNK", 50)
    monkeypatch.setattr(topk, "QUERIES", 3)
    rng = np.random.default_rng(8)
    centres = rng.normal(0, 1, (20, 16))
    x = centres[rng.integers(20, size=2000)] / np.linalg.norm(centres, axis=1).mean() + rng.normal(0, 0.02, (2000, 16))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    df = spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)], "vec_id long, embedding array<float>")
    best, met = searched(quantised(df), F.col("vec_id") % 100 == 0)
    rows = met.toPandas()
    assert len(rows) == 20 and rows["met"].mean() < 0.5 * 2000 and rows["met"].min() >= 10
    q = np.floor(1024 * np.float32(x).astype(float)).astype(int)
    got = best.toPandas()
    for i in range(0, 2000, 100):
        s = q @ q[i]
        want = sorted((-int(v), j) for j, v in enumerate(s) if j != i)[:10]
        own = got[got["query_id"] == i]
        assert sorted((-v, j) for v, j in zip(own["score"], own["vec_id"], strict=True)) == want


ASSIGN = re.compile(r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def base_spans(text):
    text = text or ""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return [f"{('assign', 'access', 'hex')[k]}:{a}:{b}" for a, k, b in sorted(found)]


def secret_rows(n):
    rng, rows = random.Random(1), []
    for i in range(n):
        key = "".join(rng.choice("0123456789abcdefGHIJKLMNOP") for _ in range(32))
        w = prose(40, i)
        w.insert(rng.randrange(40), rng.choice([f'token = "{key}"', f"API_Key:{key}", f"AKIA{key.upper()[:16]}", key, "".join(rng.choice("0123456789abcdef") for _ in range(40))]))
        rows.append((100 + i, "é " * (i % 3) + " ".join(w)))
    return rows


def test_secrets_base_findings_stay(spark):
    rows = secret_rows(300) + ODD + [(7, "password: token: abcdefg"), (8, "ſecret=abcdefgh PASSWD='abc.def' token:short"), (9, "AKIA" * 5), (10, "passWORD=" + "a" * 30)]
    out = secrets.findings(with_odd_columns(documents(spark, rows))).toPandas()
    assert len(out) == len(rows)
    texts = {None if d != d or d is None else int(d): t for d, t, *_ in rows}
    for r in out.itertuples():
        want = base_spans(texts[None if r.doc_id != r.doc_id else int(r.doc_id)])
        spans = [s for s in r.spans.split(",") if s]
        assert [s for s in spans if not s.startswith("cnn")] == want
        assert r.base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest()
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(s.startswith(k) for s in want) for k in ("assign", "access", "hex"))
    bare = out[(out["n_assign"] + out["n_access"] + out["n_hex"] == 0) & (out["doc_id"] >= 100)]
    assert len(bare) > 10 and (bare["n_cnn"] == 1).mean() > 0.6  # keys that no pattern names


def test_secrets_threshold_keeps_the_recall_below_one_half():
    rng, network = np.random.default_rng(0), secrets.Network()
    y = np.concatenate([np.ones(200), np.zeros(3000)])
    network._calibrate(logit := rng.normal(0.3 * y, 1.0), y, np.ones(len(y)))
    p = 1 / (1 + np.exp(-(network.slope * logit + network.shift)))
    assert network.threshold < 0.5 and (p[y == 1] >= network.threshold).mean() >= secrets.RECALL


def test_secrets_look_along_the_whole_candidate():
    class Sees:
        """A network that knows one character, with what follows it."""

        def score(self, x):
            return (x == secrets.ALPHABET.index('"')).any(axis=1) + 0.0

    for n in (20, 48, 49, 73, 500, 5000):
        for at in (0, n // 2, n - 1, n + 20):
            body = b"x" * 30 + b"a" * n + b" " * 60
            body = body[: 30 + at] + b'"' + body[31 + at :]
            if n > 48 or at < 48:
                assert secrets.best_scores(Sees(), [(body, 30, 30 + n)], 1)[0] == 1, (n, at)
    assert secrets.starts(5, 53) == [5]


def test_secrets_network_on_keys_unlike_the_training_ones(spark):
    """Bare keys and look-alikes, made another way than the training ones, in the prose of real documents."""
    import base64
    import string
    import uuid

    rng, chars = random.Random(99), string.ascii_letters + string.digits
    texts = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text")
    network = secrets.train(texts)
    prose_of = [r["text"] for r in texts.where("length(text) > 400").collect()]
    word = lambda t: [w for w in t.split() if w.isascii() and w.isalpha()]
    keys = {
        "plain": lambda: "".join(rng.choices(chars, k=32)), "long": lambda: "".join(rng.choices(chars, k=100)), "base64": lambda: base64.b64encode(rng.randbytes(30)).decode(),
        "url": lambda: base64.urlsafe_b64encode(rng.randbytes(32)).decode().rstrip("="), "prefixed": lambda: "ghp_" + "".join(rng.choices(chars, k=36)), "live": lambda: "sk_live_" + "".join(rng.choices(chars, k=24)),
    }
    others = {
        "uuid": lambda: str(uuid.UUID(int=rng.getrandbits(128))), "path": lambda: "/".join(word(rng.choice(prose_of))[:5]) + f"/index{rng.randrange(99)}", "time": lambda: f"2024-0{rng.randrange(1, 9)}-1{rng.randrange(9)}T12-{rng.randrange(10, 59)}-00Z",
        "number": lambda: str(rng.randrange(10**19, 10**20)), "slug": lambda: "articles/" + "-".join(word(rng.choice(prose_of))[:6]).lower() + "-2023",
    }

    def flagged(make, n=150):
        found = []
        for _ in range(n):
            text = rng.choice(prose_of).encode()
            at = text.find(b" ", rng.randrange(100, 250))
            key = make().encode()
            found.append((text[:at] + b" " + key + text[at:], at + 1, at + 1 + len(key)))
        return float((secrets.best_scores(network, found, n) >= network.threshold).mean())

    words_of = lambda n: [rng.choice(word(rng.choice(prose_of)) or ["x"]) for _ in range(n)]
    # Kinds that training makes nothing like.
    unseen = {
        "serial": lambda: "-".join("".join(rng.choices("0123456789ABCDEF", k=2)) for _ in range(8)), "method": lambda: "get" + "".join(w.capitalize() for w in words_of(4)), "time": others["time"],
        "chess": lambda: "-".join(rng.choice("KQRBN") * rng.randrange(2) + rng.choice("abcdefgh") + rng.choice("12345678") for _ in range(8)), "phone": lambda: f"+49/30/{rng.randrange(10**6, 10**7)}-{rng.randrange(100)}",
        "query": lambda: f"page={rng.randrange(99)}_sort={words_of(1)[0]}_lang={rng.choice(['en', 'de'])}_view={words_of(1)[0]}", "version": lambda: "release-v" + "-".join(str(rng.randrange(30)) for _ in range(3)) + f"-beta{rng.randrange(9)}/{words_of(1)[0]}",
        "book": lambda: f"ISBN-978-3-{rng.randrange(10**4, 10**5)}-{rng.randrange(100, 999)}-{rng.randrange(9)}", "rule": lambda: "=" * rng.randrange(2, 6) + "-" * rng.randrange(10, 30) + "=" * rng.randrange(2, 6),
        "marks": lambda: "".join(rng.choice("-_=") for _ in range(30)), "dated": lambda: "-".join(words_of(3)).lower() + f"-2023-1{rng.randrange(3)}-2{rng.randrange(9)}",
    }
    others |= {
        "protein": lambda: "".join(rng.choices("ACDEFGHIKLMNPQRSTVWY", k=60)), "constant": lambda: "_".join(words_of(4)).upper(), "upload": lambda: f"uploads/2019/0{rng.randrange(1, 9)}/IMG_{rng.randrange(10**8)}",
        "encoded": lambda: base64.b64encode(" ".join(words_of(9)).encode()).decode(), "card": lambda: str(rng.randrange(10**15, 10**16)),
    }
    recall, wrong, new = ({k: flagged(f) for k, f in kinds.items()} for kinds in (keys, others, unseen))
    assert min(recall.values()) >= 0.9, recall
    assert max(wrong.values()) <= 0.15 and sum(wrong.values()) / len(wrong) <= 0.05, wrong
    assert max(new.values()) <= 0.1, new
    labelled = secrets._examples(texts, secrets.SAMPLE).where(f"label = {secrets.SECRET}").toPandas()
    own = [(a + b + c, len(a), len(a) + len(b)) for a, b, c in labelled[["before", "body", "after"]].itertuples(index=False)]
    assert (secrets.best_scores(network, own, len(own)) >= network.threshold).mean() >= 0.9


def test_secrets_every_row_of_training_is_bounded_and_made_once(spark):
    rows = secret_rows(200) + [(900, "AKIA" + "A1" * 4_000 + " end"), (901, None), (902, "a b"), (902, "a b")]
    found = secrets._examples(documents(spark, rows).select("doc_id", "text"), 60).toPandas()
    assert (found.groupby("label").size() <= 30).all() and set(found["label"]) == {0, 1, 2}
    assert found["body"].map(len).max() <= 4 * secrets.WIDTH
    again = secrets.Network.from_bytes(secrets.learn(found).to_bytes())
    x = np.random.default_rng(1).integers(0, 70, (50, secrets.WIDTH))
    assert np.array_equal(again.score(x), secrets.learn(found).score(x))


def test_secrets_without_labelled_findings(spark):
    out = secrets.findings(documents(spark, [(1, "plain words " * 5), (2, "long1" * 9)])).collect()
    assert {r["spans"] for r in out} == {""}
    assert secrets.findings(spark.createDataFrame([], DOCS)).count() == 0


def test_language_held_out(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "lang")
    got = QUERIES["op10_language"](spark, DATA).join(docs, "doc_id").where("held_out").toPandas()
    assert (got["lang"] == got["lang_pred"]).mean() > 0.95
    assert got["score"].between(0, 1).all()


def test_language_odd_input(spark):
    rows = [(i, " ".join(prose(60, 7 * i, 80)), "xx" if i % 2 else None) for i in range(40, 60)] + [(d, t, "yy") for d, t in ODD] + [(70, "123 ... !!", "yy")]
    out = langid.languages(with_odd_columns(documents(spark, rows))).collect()
    assert len(out) == len(rows)
    assert all(r["lang_pred"] == "und" for r in out if r["doc_id"] in (1, 2, 3, 70))
    assert {r["lang_pred"] for r in out} <= {"xx", "yy", "und"}
    assert {r["doc_id"] for r in out if r["held_out"]} == {d for d, *_ in rows if d is not None and zlib.crc32(str(d).encode()) % 4 == 2}
    assert {r["lang_pred"] for r in langid.languages(documents(spark, [(1, "a b", None)])).collect()} == {"und"}
    assert langid.languages(spark.createDataFrame([], DOCS)).count() == 0


def test_language_equals_a_plain_loop(spark):
    import zstandard

    content = {"aa": " ".join(prose(3000, 1)).encode(), "bb": " ".join(prose(3000, 2)).encode(), "cc": " ".join(prose(3000, 3)).encode()}
    rows = [(i, " ".join(prose(n, i % 3 + 1))) for i, n in enumerate([1, 2, 5, 30, 300, 3000] * 3)] + [(90, "ONE, Two 3"), (91, None), (92, "123"), (93, "é" * 30_000)]
    docs = documents(spark, rows).withColumn("held_out", F.lit(True))
    got = {r["doc_id"]: r for r in langid.identify(docs, content).collect()}
    for i, text in rows:
        folded = re.sub(r"[\W\d_]+", " ", f" {(text or '').lower()} ")
        if folded == " ":
            assert got[i]["lang_pred"] == "und" and got[i]["score"] == 0
            continue
        size = {}
        for lang, c in content.items():
            d = zstandard.ZstdCompressionDict(c, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            size[lang] = len(zstandard.ZstdCompressor(level=langid.LEVEL, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False).compress(folded.encode()))
        assert size[got[i]["lang_pred"]] == min(size.values())
        a, b = sorted(size.values())[:2]
        assert got[i]["rejected"] == ((b - a) / max(b, 1) < 0.01)


def test_language_of_long_documents_alone_is_learned(spark):
    rows = [(i, " ".join(prose(9000, 7, 3000)), "xx") for i in range(8, 14)] + [(i, " ".join(prose(60, 8, 3000)), "yy") for i in range(20, 40)]
    out = langid.languages(documents(spark, rows + [(50, " ".join(prose(400, 7, 3000)), None)])).collect()
    assert {r["lang_pred"] for r in out if r["doc_id"] in (50, *range(8, 14))} == {"xx"}


def test_pipeline_stages(spark):
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality", "line_dedup", "near_dedup", "decontaminate", "packing"]
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    count = docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, folder)
        assert out.schema.simpleString() == docs.schema.simpleString()
        docs = spark.createDataFrame(out.toPandas(), docs.schema)
        assert 0.5 * count < docs.count() <= count
        count = docs.count()
        assert docs.select("doc_id").distinct().count() == count
    pieces = corpus_pipeline.run(spark, folder)
    assert pieces.select("doc_id").distinct().count() == count


def test_pipeline_stages_with_odd_rows(spark):
    """Nulls, empty and long texts, repeated rows, clashing names and empty tables in every stage."""
    folder = "/root/testdata/sf0.001"
    rows = [*ODD, *((100 + i, " ".join(prose(80, i))) for i in range(6)), (200, None, None, None), (201, "a line\n" * 500)]
    docs = with_odd_columns(documents(spark, rows))
    ids = {r["doc_id"] for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, folder)
        assert out.columns == docs.columns and {r["doc_id"] for r in out.select("doc_id").collect()} <= ids, name
        assert stage(spark, docs.where("doc_id = -9"), folder).count() == 0, name
    stages = dict(corpus_pipeline.STAGES)
    one = stages["near_dedup"](spark, docs, folder).collect()
    assert sum(r["doc_id"] == 5 for r in one) == 1 and sum(r["text"] is None or r["text"] == "" for r in one) == 1
    assert stages["decontaminate"](spark, docs, folder).count() == len(rows)
    lines = {r["doc_id"]: r["text"] for r in stages["line_dedup"](spark, docs, folder).collect()}
    assert lines[1] is None and lines[201] == "a line\n" * 500
    pieces = stages["packing"](spark, docs, folder)
    assert pieces.select("doc_id").distinct().count() == len(ids) and pieces.where("length < 1").count() == 0
    assert stages["packing"](spark, docs.where("doc_id = -9"), folder).count() == 0


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_runs(spark, name):
    assert QUERIES[name](spark, "/root/testdata/sf0.001").count() > 0
