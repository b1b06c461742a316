"""Training-data operators: brute force, SQL, round trips and edge cases on small tables."""

import hashlib
import re
import tracemalloc
import zlib
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from herdlens.llm import ann, chat, common, html_extract, line_dedup, mixing, packing, quality, sharding, simhash, topk
from herdlens.llm import queries as Q
from herdlens.plans import check

from conftest import SF_ORACLE, SF_SMALL

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, size long, key string"


@pytest.fixture(scope="module", autouse=True)
def shipped(spark):
    common.ship(spark)


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in every column, empty and very long texts, ties, repeated rows, columns with clashing names."""
    long_line = "x" * 300_000
    rows = [
        (1, None, None, None, None, None, None, None),
        (2, "", "en", "a", 0, 1.0, 1, "k"),
        (3, " \t\n\x0b ", "en", "a", 5, 1.0, 1, "k"),
        (4, "one two three four five", "en", "b", 5, 1.0, 1, "k"),
        (4, "one two three four five", "en", "b", 5, 1.0, 1, "k"),
        (5, "One TWO three four five", "en", "b", 5, 1.0, 1, "k"),
        (None, "one two three four five", "en", None, 5, 1.0, 1, "k"),
        (6, long_line + "\n" + "word " * 40_000, "fr", "c", 5, 1.0, 1, "k"),
        (7, "é" * 39 + "\n" + "é" * 40, "fr", "c", 5, 1.0, 1, "k"),
        *[(10 + k, "  The very same line that is long enough to be counted \nown " + str(k), "en", "b", 5, 1.0, 1, "k") for k in range(6)],
    ]
    return spark.createDataFrame(rows, DOCS)


def rows_of(df):
    return [r.asDict() for r in df.collect()]


@pytest.mark.parametrize("name", sorted(Q.SQL))
def test_matches_sql(spark, name):
    sc, sr = check.spark_rows(Q.QUERIES[name](spark, SF_ORACLE))
    ok, msg = check.compare(sc, sr, *check.duckdb_frame(SF_ORACLE, Q.SQL[name]))
    assert ok, msg


# ---------------------------------------------------------------- packing


def check_packing(docs: dict, rows, capacity=1024):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(packing.default_vocabulary()[0])
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
        by_seq[r["sequence_id"]].append(r)
    assert set(by_doc) == set(docs)
    for i, text in docs.items():
        ids = np.array([*tok.encode(text or "", add_special_tokens=False).ids, packing.END_ID], "<u4")
        at = 0
        for k, r in enumerate(sorted(by_doc[i], key=lambda r: r["piece"])):
            assert (r["piece"], r["start"]) == (k, at)
            assert zlib.crc32(ids[at:at + r["length"]].tobytes()) == r["ids_crc32"]
            assert r["length"] == capacity or k == 0 and r["length"] < capacity
            at += r["length"]
        assert at == len(ids)
    for pieces in by_seq.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= capacity
    return len(by_seq), -(-sum(r["length"] for r in rows) // capacity)


def test_packing_round_trip(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()}
    used, least = check_packing(docs, rows_of(Q.QUERIES["op1_packing"](spark, SF_SMALL)))
    assert used <= least + 2


def test_packing_odd_rows(spark, odd):
    rows = rows_of(packing.pack(packing.token_pieces(odd.where("doc_id <> 4"))))
    check_packing({r.doc_id: r.text for r in odd.where("doc_id <> 4").collect()}, rows)
    twice = rows_of(packing.pack(packing.token_pieces(odd.where("doc_id = 4"))))
    assert len(twice) == 2 and len({(r["sequence_id"], r["offset"]) for r in twice}) == 2
    assert rows_of(packing.pack(packing.token_pieces(odd.limit(0)))) == []


def test_added_token_in_a_text(spark):
    docs = {1: "a <|endoftext|> b", 2: "plain"}
    rows = rows_of(packing.pack(packing.token_pieces(spark.createDataFrame(list(docs.items()), "doc_id long, text string"))))
    check_packing(docs, rows)


def test_crossover_keeps_every_document():
    rng = np.random.default_rng(3)
    counts = dict(Counter(rng.integers(1, 400, 500).tolist()))
    a = packing.best_fit({}, counts, 1024, rng)
    b = packing.best_fit({}, counts, 1024, rng)
    for s in (a, packing.crossover(a, b, counts, 1024, rng), packing.mutate(a, 1024, rng), packing._bounded(a, 1024, 20)):
        held = Counter()
        for p, n in s.items():
            assert sum(p) <= 1024 and n > 0
            for x in p:
                held[x] += n
        assert held == counts


# ---------------------------------------------------------------- top-k and neighbours


def brute(rows, k, every, value):
    rows = {i: value(v) for i, v in rows}
    out = {}
    for q in (i for i in rows if i % every == 0):
        best = sorted(((-float(rows[q] @ v), i) for i, v in rows.items() if i != q))[:k]
        out[q] = [i for _, i in best]
    return out


def test_top_k_ties_and_odd_rows(spark):
    rows = [(0, [1.0, 0.0, 0.5]), (50, [-1.0, 0.25, 0.0]), (1, [1.0, 0.0, 0.5]), (2, [1.0, 0.0, 0.5]), (2, [1.0, 0.0, 0.5]),
            (3, None), (4, [1.0, None, 0.0]), (5, [float("nan"), 0.0, 0.0]), (6, [float("inf"), 0.0, 0.0]), (None, [1.0, 1.0, 1.0]),
            (7, [0.0, 0.0, 0.0]), (8, []), (9, [-1.0, 0.1, 0.0]), (11, [0.1, 0.1, 0.1]), (12, [3.0, 1.0, 1.0]), (100, None)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = defaultdict(list)
    for r in sorted(topk.op2_query(df).collect(), key=lambda r: (r.query_id, r["rank"])):
        got[r.query_id].append((r.vec_id, r.score))
    assert got == {0: [(12, 256 * 768 + 128 * 256), (1, 81920), (2, 81920), (11, 25 * 256 + 25 * 128), (7, 0)],
                   50: [(9, 256 * 256 + 64 * 25), (7, 0), (8, 0), (11, -256 * 25 + 64 * 25), (0, -65536)]}
    assert topk.op2_query(df.limit(0)).count() == 0
    assert topk.op2_query(df.where("vec_id = 0")).count() == 0


def test_top_k_beside_a_hot_id_keeps_its_cutoff(spark, monkeypatch):
    rng = np.random.default_rng(8)
    rows = [(i, (v / np.linalg.norm(v)).tolist()) for i, v in enumerate(rng.standard_normal((2000, 16)))]
    top = (2 * np.ones(16)).tolist()
    hot = rows + [(7, top)] * 300 + [(11, [float(x) + k / 100 for x in top]) for k in range(300)]
    df = spark.createDataFrame(hot, "vec_id long, embedding array<double>").repartition(4)
    sent = []
    real = topk.stored
    monkeypatch.setattr(topk, "stored", lambda t, purpose: (sent.append(real(t, purpose)) if purpose == "topk-first" else None) or real(t, purpose))
    got = defaultdict(list)
    for r in topk.op2_query(df).collect():
        got[r.query_id].append((r["rank"], r.vec_id, r.score))
    first = Counter(r.query_id for r in sent[0].collect())
    assert len(first) == 40 and min(first.values()) >= 5  # five ids and more, so every query has a cutoff
    best = {}
    for i, v in hot:
        best.setdefault(i, set()).add(tuple(int(np.floor(256 * x)) for x in v))
    for q in range(0, 2000, 50):
        (own,) = best[q]
        want = sorted((-max(sum(a * b for a, b in zip(own, v)) for v in vs), i) for i, vs in best.items() if i != q)[:5]
        assert sorted(got[q]) == [(k + 1, i, -s) for k, (s, i) in enumerate(want)]


def test_top_k_blocks_and_lists(spark):
    table = spark.read.parquet(f"{SF_ORACLE}/embeddings.parquet")
    rows = table.select("vec_id", F.transform("embedding", lambda x: F.floor(x.cast("double") * 256)).alias("v"))
    queries = rows.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("v").alias("q"))
    got = {tuple(r) for r in topk.top_k(rows, queries, 7, lists=4, query_block=3).collect()}
    want = brute([(r.vec_id, r.v) for r in rows.collect()], 7, 50, lambda v: np.array(v, float))
    assert {(r[0], r[2]) for r in got} == {(q, i) for q, ids in want.items() for i in ids}


def test_neighbours_recall(spark):
    table = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = table.select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    queries = rows.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("v").alias("q"))
    data = [(r.vec_id, r.v) for r in rows.collect()]
    want = brute(data, 20, 20, np.array)
    got = defaultdict(list)
    by_id = {i: np.array(v) for i, v in data}
    for r in ann.nearest(rows, queries, 20).collect():
        got[r.query_id].append(r.vec_id)
        assert abs(r.score - by_id[r.query_id] @ by_id[r.vec_id]) < 1e-12
    assert all(len(v) == 20 for v in got.values()) and set(got) == set(want)
    assert np.mean([len(set(got[q]) & set(want[q])) / 20 for q in want]) >= 0.9


def test_neighbours_odd_rows(spark):
    rows = [(0, [1.0, 0.0]), (20, [0.0, 0.0]), (1, [2.0, 0.0]), (2, [2.0, 0.0]), (2, [2.0, 0.0]), (3, None), (4, [None, 1.0]), (5, [float("nan"), 1.0]),
            (None, [1.0, 1.0]), (6, []), (7, [1000.0, 0.0]), (8, [-1.0, 0.5])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = [(r.query_id, r["rank"], r.vec_id, r.score) for r in ann.op5_query(df).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 7, 1000.0), (0, 2, 1, 2.0), (0, 3, 2, 2.0), (0, 4, 8, -1.0)]
    assert ann.op5_query(df.limit(0)).count() == 0


@pytest.mark.parametrize("alike", [True, False])
def test_neighbours_beside_a_hot_id(spark, alike):
    rng = np.random.default_rng(5)
    n, hot = 1500, 700
    x = rng.standard_normal((n, 8))
    x /= np.linalg.norm(x, axis=1)[:, None]
    around = np.repeat(x[:1] * 1.2, hot, axis=0) + (0 if alike else 1e-3) * rng.standard_normal((hot, 8))
    rows = [(k + 1, v.tolist()) for k, v in enumerate(x)] + [(9999, v.tolist()) for v in around]
    # Queries near the hot id, which scores highest in all of them.
    queries = [(20_000 + k, (x[0] + 0.05 * rng.standard_normal(8)).tolist()) for k in range(10)]
    vectors = spark.createDataFrame(rows, "vec_id long, v array<double>").coalesce(1)
    got = defaultdict(dict)
    for r in ann.nearest(vectors, spark.createDataFrame(queries, "query_id long, q array<double>"), 20).collect():
        got[r.query_id][r["rank"]] = r.vec_id, r.score
    found = []
    for q, v in queries:
        score = {i: max(np.dot(u, v) for u in us) for i, us in {**{k: [u] for k, u in rows[:n]}, 9999: around}.items()}
        want = sorted(score, key=lambda i: (-score[i], i))[:20]
        assert len(got[q]) == 20 and len({i for i, _ in got[q].values()}) == 20 and got[q][1][0] == 9999
        assert all(abs(s - score[i]) < 1e-12 for i, s in got[q].values())
        found.append(len(set(want) & {i for i, _ in got[q].values()}) / 20)
    assert np.mean(found) >= 0.9


# ---------------------------------------------------------------- html


def test_article_without_the_rest():
    page = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a = "<p>no</p>";</script></head><body class="has-sidebar">
    <header>Site</header><nav><ul><li><a href="/a">menu</a></ul></nav><div class="ad">Buy now, many words to buy things with.</div>
    <article><h1>Head &amp; line</h1><p>First <a href="#">linked</a>\n  para<b>graph</b>.<br>After break<p>Second&nbsp;one &lt;ok&gt;
    <aside>Aside words</aside><form>Name <input></form></p><!-- gone --><p>3 < 4</article>
    <section id="comments"><div class="comment"><p>A reader says a lot of words here, more than the article has in all its lines.</p></div></section>
    <div class="cookie-notice">We use cookies</div><footer>Foot</footer></body></html>"""
    assert html_extract.extract(page) == "Head & line\nFirst linked paragraph.\nAfter break\nSecond one <ok>\n3 < 4"


def test_pages_equal_their_articles(spark):
    import html

    pages = spark.read.parquet(f"{SF_ORACLE}/pages.parquet")
    got = {r.page_id: r for r in Q.QUERIES["op3_html_main_text"](spark, SF_ORACLE).collect()}
    assert len(got) == pages.count()
    for r in pages.collect():
        body = r.html.split("<article>")[1].split("</article>")[0]
        blocks = (" ".join(html.unescape(re.sub("<[^>]+>", "", b)).split()) for b in re.split(r"</?(?:p|br|h1)\b[^>]*>", body))
        want = "\n".join(b for b in blocks if b)
        assert got[r.page_id].text == want and got[r.page_id].n_chars == len(want)


def test_html_odd_rows(spark):
    rows = [(1, "u", None), (2, None, ""), (3, "u", "plain words"), (3, "u", "plain words"), (None, "u", "<p>a"), (4, "u", "<"), (5, "u", "<p " + "x" * 100_000),
            (6, "u", "<!-- open"), (7, "u", "<script>open"), (8, "u", "<div>" * 5000 + "deep"), (9, "u", "<p>\U0001F600 é</p>")]
    got = sorted((r.page_id or 0, r.text, r.n_chars) for r in html_extract.op3_query(spark.createDataFrame(rows, "page_id long, url string, html string")).collect())
    assert [g for g in got if g[0] != 8] == [(0, "a", 1), (1, "", 0), (2, "", 0), (3, "plain words", 11), (3, "plain words", 11), (4, "<", 1), (5, "", 0), (6, "", 0), (7, "", 0), (9, "\U0001F600 é", 3)]
    assert html_extract.op3_query(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


HTML = "page_id long, url string, html string"


def test_wrapper_of_articles_is_no_boilerplate(spark):
    wrapped = """<body><div class="page"><div class="crumbs">Home and on</div>{}</div></body>"""
    marked = [(k, "u", wrapped.format(f"<article><h1>Head {k}</h1><p>Body of page {k} in words</p></article>")) for k in range(40)]
    unclosed = [(40 + k, "u", f"<body><div class=page><div class=nav>go<article><p>Open {k} words</p></article></div>") for k in range(30)]
    plain = [(100 + k, "u", wrapped.format(f"<h1>Title {k}</h1><p>Words of unmarked page {k} here</p>")) for k in range(20)]
    pages = spark.createDataFrame(marked + unclosed + plain, HTML)
    weights, learned = html_extract.fit(pages)
    assert "div.page" not in learned and weights.get("div.page", -0.5) == -0.5 and "div.crumbs" in learned
    got = {r.page_id: r.text for r in html_extract.op3_query(pages).collect()}
    assert all(got[k] == f"Head {k}\nBody of page {k} in words" for k in range(40))
    assert all(got[40 + k] == f"Open {k} words" for k in range(30))
    assert all(got[100 + k] == f"Title {k}\nWords of unmarked page {k} here" for k in range(20))


def test_copies_of_a_page_are_one_label(spark):
    import hashlib

    copied = min((f"<body><div class=lead>Out {k}</div><article><p>Some more text</p></article></body>" for k in range(5000)), key=lambda p: hashlib.md5(p.encode()).hexdigest())
    others = [f"<body><article><div class=lead>In {k}</div><p>Text {k}</p></article></body>" for k in range(60)]
    pages = spark.createDataFrame([(k, "u", p) for k, p in enumerate([copied] * 300 + others)], HTML).repartition(7)
    weights, learned = html_extract.fit(pages)
    assert not learned and abs(weights["div.lead"] + 8 * 1.05 / 61.1) < 1e-9
    got = {r.page_id: r.text for r in html_extract.op3_query(pages).collect()}
    assert all(got[300 + k] == f"In {k}\nText {k}" for k in range(60)) and got[0] == "Some more text"


def test_anchors_of_an_article_stay():
    page = """<body><article><h1 class="notice">Head</h1><h2 id="related-work">Related work</h2><p class="notice-period">A notice period</p>
    <h3 id="search">Search</h3><section id="legal-analysis"><h2>Legal analysis</h2><p>By <span class="social">social</span> law</p></section>
    <div class="section level2" id="related"><p>Also related</p></div><div id="comments-on-method"><p>On method</p></div>
    <div class="share-buttons">Share this</div><ul class="related">Other posts</ul><div id="comments">Readers say</div><section class="newsletter">Sign up</section>
    <p>End</p></article><h2 id="related">Outside</h2></body>"""
    learned = frozenset(("p.notice-period", "div.share"))
    want = "Head\nRelated work\nA notice period\nSearch\nLegal analysis\nBy social law\nAlso related\nOn method\nEnd"
    assert html_extract.extract(page) == want and html_extract.extract(page, None, learned) == want


def test_marked_elements_hold_the_scan():
    comments = "".join(f"<p>Reader {k} says a lot of words, more than the article has.</p>" for k in range(5))
    assert html_extract.extract(f"<article><h1>Head</h1><p>Short text.</p></article><div class=thread>{comments}</div>") == "Head\nShort text."
    two = "<article><p>First part here</p></article><p>Text between the two</p><article><p>Second part there</p></article>"
    assert html_extract.extract(two) == "First part here\nSecond part there"
    assert html_extract.extract("<main></main><p>All else is here</p>") == "All else is here"


def test_boilerplate_is_free_to_cross():
    page = "<body><h1>A title of five words</h1><p>One two three four</p><div class=ad><b>Buy</b> now, many words to buy things with</div><p>Five six</p><ul><li>Seven and more</li></ul><p>Eight nine ten</p></body>"
    assert html_extract.extract(page) == "A title of five words\nOne two three four\nFive six\nSeven and more\nEight nine ten"


def test_names_inside_an_article_must_agree():
    page = """<article><p>Start</p><div class="legal-text">Legal text</div><div class="search-algorithms">Search</div><div class="social-history">History</div>
    <p>Sum <math><mi>x</mi></math></p><div class="reader-feedback">Fine piece</div><div class="ad-slot wide">Buy</div><div class="newsletter-signup">Mail</div>
    <div class="related-posts">More</div></article>"""
    assert html_extract.extract(page) == "Start\nLegal text\nSearch\nHistory\nSum x"


@pytest.mark.parametrize("page", ["<b>" * 20_000 + "</i>" * 20_000, "<p>" * 20_000 + "</b>" * 20_000, "<b>" * 20_000 + "<p>" + "</b>" * 20_000,
                                  "<div>" * 9_000 + "<article></article>" * 9_000])
def test_unclosed_tags_take_linear_time(page):
    import time

    t = time.process_time()
    assert html_extract.extract(page + "<p>some words here</p>") == "some words here"
    assert time.process_time() - t < 2


# ---------------------------------------------------------------- quality


def test_quality_held_out(spark):
    out = Q.QUERIES["op4_quality_classifier"](spark, "/root/testdata/sf0.1").toPandas()
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet").toPandas()
    assert (out.held_out == [zlib.crc32(str(i).encode()) % 5 == 0 for i in out.doc_id]).all()
    assert ((out.score >= 0.3) == (out.predicted == 1)).all() and out.score.between(0, 1).all()
    m = out[out.held_out].merge(labels, on="doc_id")
    assert m[m.quality == 1].predicted.mean() >= 0.99 and m[m.quality == 0].predicted.mean() <= 0.03


def test_quality_features_match_plain_python():
    texts = ["Ab cd  cd", "", "x", "one two"]
    for codes, starts, owners, carried in quality.blocks(texts):
        bucket, part = quality.features(codes, starts, carried)
        for n, k in enumerate(owners):
            words = texts[k].split()
            padded = " " + " ".join(words) + " "
            grams = sum(1 for g in quality.GRAMS for i in range(len(padded) - g + 1) if " " not in padded[i + 1:i + g - 1]
                        and padded[i:i + g].strip() and len(padded[i:i + g]) == g)
            assert (part == n).sum() == len(words) + max(0, len(words) - 1) + grams
    one = [b for c, s, _, d in quality.blocks(["the cat"]) for b in quality.features(c, s, d)[0]]
    two = [b for c, s, _, d in quality.blocks(["zzz", "the cat"]) for b in quality.features(c, s, d)[0][quality.features(c, s, d)[1] == 1]]
    assert sorted(one) == sorted(two)


def test_long_texts_in_blocks_score_alike(monkeypatch):
    rng = np.random.default_rng(0)
    weight = rng.standard_normal(1 << quality.BITS)
    text = " ".join("w" * int(n) for n in rng.integers(1, 9, 3000))
    whole = quality.score_texts([text], weight, 0.1)
    monkeypatch.setattr(quality, "BLOCK", 1000)
    assert abs(quality.score_texts([text], weight, 0.1) - whole) < 1e-12
    monkeypatch.setattr(quality, "BLOCK", 7)  # cuts at nearly every word
    assert abs(quality.score_texts(["ab", text, "", "c d"], weight, 0.1)[1] - whole) < 1e-12


def test_quality_odd_rows(spark, odd):
    labels = spark.createDataFrame([(4, 1, 0), (6, 0, 0), (None, 1, 0), (5, None, 0), (4, 1, 0)], "doc_id long, quality int, toxic int")
    out = rows_of(quality.op4_query(odd, labels))
    assert len(out) == odd.count() and all(0 <= r["score"] <= 1 for r in out)
    none = rows_of(quality.op4_query(odd, labels.limit(0)))
    assert {r["score"] for r in none} == {0.5}
    assert quality.op4_query(odd.limit(0), labels).count() == 0
    assert quality.keep_good(odd, labels).columns == odd.columns
    # Of several texts of a labelled id the same one is learned from whatever the order.
    many = spark.createDataFrame([(4, f"text {k} of many", "a") for k in range(9)] + [(6, "other words", "a")], "doc_id long, text string, source string")
    a, b = (quality.fit(many.repartition(n), labels)[0] for n in (1, 7))
    assert (a == b).all()


# ---------------------------------------------------------------- mixing


def n_words(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def targets_brute(rows):
    """(size, target) of each source of (source, text)."""
    sizes = Counter()
    for source, text in rows:
        sizes[source] += n_words(text)
    order = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    left, capped = 1.5 * sum(sizes.values()), {}
    while True:
        open_ = [s for s in order if s not in capped]
        level = left / sum(weight[s] for s in open_) if open_ else 0
        over = [s for s in open_ if level * weight[s] > 2 * sizes[s]]
        if not over:
            break
        for s in over:
            capped[s] = 2 * sizes[s]
            left -= capped[s]
    return {s: (sizes[s], capped.get(s, level * weight[s])) for s in order}


def copies_brute(rows):
    """How often each of (doc_id, source, text) goes into the mix, in the rows' order."""
    per, seen, out = targets_brute([r[1:] for r in rows]), Counter(), []
    for doc_id, source, text in rows:
        size, target = per[source]
        rate = min(target / size, 2.0) if size else 0.0
        text_hash = hashlib.md5((text or "").encode()).hexdigest()
        name = "null" if doc_id is None else doc_id
        unit = int(hashlib.md5(f"mix:{name}:{text_hash}:{seen[doc_id, text_hash]}".encode()).hexdigest()[:13], 16) / 2 ** 52
        seen[doc_id, text_hash] += 1
        out.append(int(rate) + (unit < rate - int(rate)))
    return out


def test_mix_targets_and_copies(spark, odd):
    m = rows_of(mixing.op6_query(odd))
    assert len(m) == odd.count()
    assert all(0 <= r["taken"] <= 2 * r["size"] for r in m)
    per = targets_brute([(r["source"], r["text"]) for r in rows_of(odd)])
    assert {(r["source_size"], round(r["target"], 6)) for r in m} == {(s, round(t, 6)) for s, t in per.values()}
    assert rows_of(mixing.op6_query(odd.limit(0))) == []
    assert mixing.mixed(odd).columns == odd.columns


def test_mix_comes_near_targets_and_agrees(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    a = mixing.op6_query(docs.withColumn("source", F.substring("source", 1, 4)))
    t = a.groupBy("source_size", "target").agg(F.sum("taken").alias("taken")).collect()
    assert sum(r.taken for r in t) == pytest.approx(sum(r.target for r in t), rel=0.02)
    assert all(abs(r.taken / r.target - 1) < 0.2 for r in t)
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, a.collect()))


def test_mix_draws_for_every_row(spark):
    rows = [(5, f"t{k} one two three", "hot") for k in range(600)] + [(None, "equal rows of three", "null") for _ in range(900)] + [(k, "a b c d", "z") for k in range(500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    a, b = (mixing.op6_query(docs.repartition(n)) for n in (2, 7))
    assert Counter(map(tuple, a.collect())) == Counter(map(tuple, b.collect()))
    for r in a.groupBy("target").agg(F.sum("taken").alias("taken")).collect():
        assert abs(r.taken / r.target - 1) < 0.1
    small = mixing.drawn(docs.select(*mixing.sized(docs, "doc_id", "text", "source")), broadcast_rows=0)
    assert Counter((r.id, r["size"], r.copies * r["size"]) for r in small.collect()) == Counter((r.doc_id, r["size"], r.taken) for r in a.collect())


HELPERS = ("_key _n_lines _n_dropped _source _size _copies _rate _score _id _label _text record _record print number copies rate target source_size "
           "id size title buckets counts row rows _first _print").split()


def test_helper_names_as_extra_columns_stay(spark):
    import corpus_pipeline as P

    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").limit(60)
    wide = docs.withColumns({c: F.concat(F.lit(c), F.col("doc_id").cast("string")) for c in HELPERS})
    for n, f in P.STAGES[:-1]:
        out = f(spark, wide, SF_SMALL)
        rows = out.collect()
        assert out.columns == wide.columns and rows
        assert all(r[c] == f"{c}{r.doc_id}" for r in rows for c in HELPERS), n
        plain = f(spark, docs, SF_SMALL).collect()
        assert Counter((r.doc_id, r.text) for r in rows) == Counter((r.doc_id, r.text) for r in plain), n
    assert P.STAGES[-1][1](spark, wide, SF_SMALL).count()


# ---------------------------------------------------------------- chat

CHAT = "conv_id long, turn long, role string, text string"


def chat_equals_sql(spark, rows):
    import duckdb

    con = duckdb.connect()
    con.execute("CREATE TABLE conversations(conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    con.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", rows)
    rel = con.execute(chat.OP7_SQL)
    cols = [d[0] for d in rel.description]
    ok, msg = check.compare(*check.spark_rows(chat.op7_query(spark.createDataFrame(rows, CHAT))), cols, rel.fetchall())
    assert ok, msg


def test_nested_interleaved_quotes_wrapped_anew_equal_sql(spark):
    rng = np.random.default_rng(11)
    words = "one two three four five six seven eight nine ten".split()

    def wrapped(text, width, marks):
        ws = text.split()
        return "\n".join(marks + " ".join(ws[i:i + width]) for i in range(0, len(ws), width))

    rows = []
    for conv in range(12):
        said = []  # each message's paragraphs, with their depth
        for turn in range(8):
            parts = []
            for _ in range(rng.integers(0, 4) if said else 0):
                d, text = said[rng.integers(len(said))]
                if rng.random() < 0.5 and parts:
                    parts.append((0, " ".join(rng.choice(words, 3))))
                parts.append((d + 1, text))
                if rng.random() < 0.3:
                    parts.append((d + 1, ""))
            parts.append((0, " ".join(rng.choice(words, rng.integers(2, 14)))))
            if rng.random() < 0.4:
                parts += [(0, ""), (0, " ".join(rng.choice(words, 5)))]
            text = "\n".join(wrapped(t, int(rng.integers(2, 6)), "> " * d) if t else ("> " * d).strip() for d, t in parts)
            said += [(d, t) for d, t in parts if t and d < 4]
            rows.append((conv, turn, "ab"[turn % 2], text))
    # Conversations without a quote beside them.
    rows += [(100 + i, t, "a", "plain words") for i in range(3) for t in range(3)]
    chat_equals_sql(spark, rows)
    linked = [r for r in chat.op7_query(spark.createDataFrame(rows, CHAT)).collect() if r.parent_turn is not None]
    assert len(linked) > 40 and all(r.conv_id < 100 for r in linked)


def test_quotes_are_linked_and_gone(spark):
    rows = [
        (1, 0, "a", "Hello there\nHow are you?"),
        (1, 1, "b", "On Monday, a wrote:\n> Hello   THERE\n> How are you?\nFine thanks."),
        (1, 2, "c", "Something else"),
        (1, 3, "a", "> > Hello there\n> Fine thanks.\nGood."),
        (1, 4, "b", "> > > hello there how are you?\n>> fine thanks.\n> good.\nBye"),
        (1, 5, "b", "> never said\nok"),
        (2, 0, "a", "Good."), (None, 1, "a", "> x\ny"), (None, 0, "a", "x"), (3, None, "a", "> x"), (3, 0, None, None),
    ]
    df = spark.createDataFrame(rows, CHAT)
    got = {(r.conv_id, r.turn): r for r in chat.op7_query(df).collect()}
    assert {k[1]: r.parent_turn for k, r in got.items() if k[0] == 1} == {0: None, 1: 0, 2: None, 3: 1, 4: 3, 5: None}
    assert {k[1]: r.root_turn for k, r in got.items() if k[0] == 1} == {0: 0, 1: 0, 2: 2, 3: 0, 4: 0, 5: 5}
    assert [t for t, _ in sorted(((k[1], r.message_no) for k, r in got.items() if k[0] == 1), key=lambda x: x[1])] == [0, 1, 3, 4, 2, 5]
    assert got[1, 1].text == "Fine thanks." and got[1, 4].text == "Bye" and got[1, 5].text == "ok"
    assert got[None, 1].parent_turn == 0 and got[3, None].parent_turn is None and got[3, 0].text == ""
    chat_equals_sql(spark, rows)


def test_chat_repeated_and_empty(spark):
    rows = [(1, 0, "a", "same line"), (1, 0, "a", "same line"), *[(1, t, "b", "> same line\nsame line") for t in range(1, 40)]]
    got = chat.op7_query(spark.createDataFrame(rows, CHAT)).collect()
    assert sorted(r.message_no for r in got) == list(range(41))
    assert all(r.parent_turn == 0 for r in got if r.turn)
    assert chat.op7_query(spark.createDataFrame([], CHAT)).count() == 0


def test_interleaved_quotes_wrapped_anew(spark):
    rows = [
        (1, 0, "a", "The first passage is long\nand goes over two lines.\n\nThe second one says something\nelse, also at length.\n\nA third is\nhere."),
        (1, 1, "b", "Unrelated words"),
        (1, 2, "c", "> The first passage is\n> long and goes over two\n> lines.\nI agree with it.\nVery much so.\n"
                    "> The second one\n> says something else, also\n> at length.\nI do not."),
        # Two paragraphs in one passage, and a quote of a quote.
        (1, 3, "a", "> The second one says\n> something else, also at length.\n>\n> A third\n> is here.\nSee both."),
        (1, 4, "d", "On Monday, c wrote:\n>> The first passage\n>> is long and goes\n>> over two lines.\n> I agree with it. Very\n> much so.\nGood.\n> I do\n> not.\nBad."),
        (2, 0, "a", "x y"), (2, 1, "b", "> x\n\n> y\nz"), (2, 2, "b", "> x\nbetween\n> other y\nz"),
    ]
    chat_equals_sql(spark, rows)
    got = {(r.conv_id, r.turn): r for r in chat.op7_query(spark.createDataFrame(rows, CHAT)).collect()}
    assert {k[1]: r.parent_turn for k, r in got.items() if k[0] == 1} == {0: None, 1: None, 2: 0, 3: 0, 4: 2}
    assert {k[1]: r.root_turn for k, r in got.items() if k[0] == 1} == {0: 0, 1: 1, 2: 0, 3: 0, 4: 0}
    assert got[2, 1].parent_turn == 0 and got[2, 2].parent_turn is None
    assert got[1, 2].text == "I agree with it.\nVery much so.\nI do not." and got[1, 2].n_quoted == 6


# ---------------------------------------------------------------- lines


def test_perfect_hash_is_minimal():
    rng = np.random.default_rng(5)
    a, b = rng.integers(0, 1 << 63, (2, 5000)).astype(np.uint64)
    h = line_dedup.PerfectHash.build(a, b)
    assert sorted(h.index(a, b)) == list(range(5000))
    assert len(line_dedup.PerfectHash.build(a[:0], b[:0]).index(a, b)) == 5000


def dedup_brute(rows):
    keys = lambda t: [re.sub("[A-Z]", lambda m: m[0].lower(), x.strip(" \t\n\x0b\x0c\r")) for x in (t or "").split("\n")]
    seen = defaultdict(list)
    for i, t in rows:
        for k in {k for k in keys(t) if len(k) >= 40}:
            seen[k].append(float("-inf") if i is None else i)
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        gone = [len(seen.get(k, ())) >= 5 and max(seen[k]) != (float("-inf") if i is None else i) for k in keys(t)]
        out.append((i, "\n".join(x for x, g in zip(lines, gone) if not g), len(lines), sum(gone)))
    return out


@pytest.mark.parametrize("params", [{}, {"keys_per_shard": 1, "broadcast_bytes": 60}])
def test_line_dedup_brute_force(spark, odd, params):
    line = "A line that is repeated in more than five documents here"
    more = spark.createDataFrame([(100 + k, f"{line}\n{'B ' + line if k % 2 else ''}\n{line}\n" + "C" * 45) for k in range(12)] + [(100, line)], "doc_id long, text string")
    docs = odd.select("doc_id", "text", "score").unionByName(more, allowMissingColumns=True)
    want = Counter(dedup_brute([(r.doc_id, r.text) for r in docs.collect()]))
    out = line_dedup.dedup_lines(docs, **params)
    assert out.columns == ["doc_id", "text", "score", "_n_lines", "_n_dropped"]
    assert Counter((r.doc_id, r.text, r._n_lines, r._n_dropped) for r in out.collect()) == want
    assert sum(r[3] for r in want) > 20
    assert line_dedup.dedup_lines(docs.limit(0), **params).count() == 0


def test_line_runs_hold_every_row_once(monkeypatch):
    monkeypatch.setattr(line_dedup, "_RUN_BYTES", 10)
    texts = ["", "abcd", "efghij", "k" * 25, "", "é" * 5, "x", "", ""]
    batch = pa.RecordBatch.from_arrays([pa.array(texts)], names=["text"])
    runs = [r.column(0).to_pylist() for r in line_dedup._runs(iter([batch.slice(0, 0), batch, batch.slice(2, 4)]), "text")]
    assert runs == [["", "abcd", "efghij"], ["k" * 25], ["", "é" * 5], ["x", "", ""], ["efghij"], ["k" * 25], ["", "é" * 5]]


def test_line_dedup_holds_a_run_of_a_batch_as_objects():
    line, n = "A line of some two thousand letters " + "abc " * 500, 8000
    ids, texts = pa.array(range(n), pa.int64()), pa.array([f"{line} {k % 3}\nB{k}\n{line}".encode() for k in range(n)])
    batch = pa.RecordBatch.from_arrays([ids, texts, ids, ids, ids], names=["doc_id", "text", "_n_lines", "_n_dropped", "_key"])
    assert batch.nbytes > 32_000_000
    counted = next(line_dedup._scan(iter([batch]), 40)).to_pylist()
    frequent = pd.DataFrame(counted)
    a, b = (frequent[c].to_numpy().view(np.uint64) for c in ("h1", "h2"))
    perfect = line_dedup.PerfectHash.build(a, b)
    order = np.argsort(perfect.index(a, b))
    row = {"shard": 0, "sizes": perfect.sizes, "words": perfect.words.tobytes(), "prints": b[order].tobytes(),
           "counts": frequent["n"].to_numpy()[order].tobytes(), "lasts": frequent["last"].to_numpy()[order].tobytes()}
    index = line_dedup.LineIndex([row], 1)
    dropped = 0
    tracemalloc.start()
    for _ in line_dedup._scan(iter([batch]), 40):
        pass
    for out in line_dedup._clean(iter([batch]), "text", index, 40, 5):
        dropped += sum(out.column("_n_dropped").to_pylist())
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert sorted(x["n"] for x in counted) == [2666, 2667, 2667, 8000]
    assert dropped == 8000 - 3 + 8000 - 1  # the last of each of three first lines, and of the line that all share, stay
    assert peak < 16_000_000, peak


# ---------------------------------------------------------------- sharding


def test_hilbert_steps_are_neighbours():
    for dims, bits in ((2, 4), (3, 3)):
        grid = np.stack(np.meshgrid(*[np.arange(1 << bits)] * dims, indexing="ij")).reshape(dims, -1)
        at = sharding.hilbert_index(grid, bits)
        assert sorted(at) == list(range(1 << bits * dims))
        walk = grid[:, np.argsort(at)]
        assert (np.abs(np.diff(walk, axis=1)).sum(0) == 1).all()


def check_shards(docs, got):
    assert len(got) == len(docs)
    want = Counter((r.doc_id, 8 + len((r.text or "").encode()), zlib.crc32((r.text or "").encode())) for r in docs)
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in got) == want
    by = defaultdict(list)
    for r in got:
        assert r.law == "rows" and r.grown_shard is None
        by[r.shard].append(r.slot)
    counts = [len(by.get(s, ())) for s in range(24)]
    assert set(by) <= set(range(24)) and max(counts) - min(counts) <= 1
    assert all(sorted(v) == list(range(len(v))) for v in by.values())


def test_sharding(spark, odd):
    check_shards(odd.collect(), sharding.op9_query(odd).collect())
    docs = spark.read.parquet(f"{SF_ORACLE}/documents.parquet")
    got = sharding.op9_query(docs)
    check_shards(docs.collect(), got.collect())
    spans = got.groupBy("shard").agg(F.countDistinct("curve").alias("c"), F.min("curve").alias("a"), F.max("curve").alias("b")).orderBy("shard").collect()
    assert all(x.b <= y.a for x, y in zip(spans, spans[1:]))
    assert sharding.op9_query(docs.limit(0)).count() == 0


def placement_brute(docs):
    """doc_id, size, text hash -> shard and slot: quantiles, curve, sort and cut in plain Python."""
    rows = [(r.doc_id, 8 + len((r.text or "").encode()), zlib.crc32((r.text or "").encode()), r.source, r.lang) for r in docs]
    cells = []
    for n in (3, 4, 1):
        values = [r[n] for r in rows]
        if n > 1:
            rank = {v: i for i, v in enumerate(sorted({v for v in values if v is not None}))}
            values = [rank.get(v) for v in values]
        known = sorted(v for v in values if v is not None)
        edges = sorted({known[-(-k * len(known) // 256) - 1] for k in range(1, 256)}) if known else []
        cells.append([0 if v is None else sum(e < v for e in edges) for v in values])
    curve = sharding.hilbert_index(np.array(cells), 8)
    order = sorted(range(len(rows)), key=lambda i: (curve[i], rows[i][1], rows[i][2], rows[i][0] is not None, rows[i][0] or 0))
    out = Counter()
    for place, i in enumerate(order):
        shard = place * 24 // len(rows)
        out[(*rows[i][:3], shard, place - -(-shard * len(rows) // 24))] += 1
    return out


def test_sharding_brute_force(spark, odd):
    for docs in (odd, spark.read.parquet(f"{SF_ORACLE}/documents.parquet")):
        got = sharding.op9_query(docs).collect()
        assert Counter((r.doc_id, r["size"], r.text_crc32, r.shard, r.slot) for r in got) == placement_brute(docs.collect())


def test_sources_with_a_common_prefix_are_apart(spark):
    rows = [(k, "word " * (k % 7), "en", f"common_crawl_{k * 7919 % 10}") for k in range(2400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = sharding.op9_query(docs).join(docs, "doc_id").select("shard", "source", "curve").collect()
    curves = defaultdict(set)
    for r in got:
        curves[r.source].add(r.curve)
    assert sum(len(c) for c in curves.values()) == len(set().union(*curves.values()))
    # A source's rows lie in few shards, so its files can be told from the others.
    by = defaultdict(set)
    for r in got:
        by[r.shard].add(r.source)
    assert np.mean([len(v) for v in by.values()]) < 5


def test_written_shards_hold_each_row_once(spark, odd, tmp_path):
    again = odd.unionByName(odd.where("doc_id = 4").withColumn("text", F.lit("another text of the id")))
    again = again.unionByName(again.where("doc_id IS NULL"))
    docs = sharding.with_rows(again)
    placed = sharding.shard(docs.select("_row", "doc_id", "source", "n_chars"), {"source": F.col("source"), "n_chars": F.col("n_chars")}, ["doc_id", "_row"], n_shards=5)
    sharding.write_shards(docs, placed, str(tmp_path / "shards"))
    got = spark.read.parquet(str(tmp_path / "shards"))
    assert Counter(tuple(r) for r in got.select(*again.columns).collect()) == Counter(tuple(r) for r in again.collect())
    want = {(r.shard, r.slot): r._row for r in placed.collect()}
    assert Counter((r.shard, r.slot) for r in got.select("shard", "slot").collect()) == Counter(want.keys())
    text = {r._row: r.text for r in docs.collect()}
    assert all(text[want[r.shard, r.slot]] == r.text for r in got.collect())


# ---------------------------------------------------------------- simhash


def fingerprint_brute(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    grams = [" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    bits = [sum(xxhash.xxh64_intdigest(g.encode(), seed=42) >> b & 1 for g in grams) for b in range(64)]
    return sum(1 << b for b in range(64) if bits[b] * 2 > len(grams))


def groups_brute(prints, radius=2):
    parent = list(range(len(prints)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if bin(prints[i] ^ prints[j]).count("1") <= radius and find(i) != find(j):
                parent[max(find(i), find(j))] = min(find(i), find(j))
    return [find(i) for i in range(len(prints))]


def test_simhash_brute_force(spark, odd):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text").unionByName(
        odd.select((F.col("doc_id") + 10_000).alias("doc_id"), F.substring("text", 1, 2000).alias("text")))
    rows = docs.collect()
    prints = [fingerprint_brute(r.text) for r in rows]
    group = groups_brute(prints)
    low = defaultdict(lambda: None)
    for g, r in zip(group, rows):
        if r.doc_id is not None:
            low[g] = r.doc_id if low[g] is None else min(low[g], r.doc_id)
    want = Counter((r.doc_id, f"{p:016x}", low[g]) for r, p, g in zip(rows, prints, group))
    assert Counter((r.doc_id, r.fingerprint, r.component_id) for r in simhash.op10_query(docs).collect()) == want
    assert simhash.op10_query(docs.limit(0)).count() == 0


@pytest.mark.parametrize("radius,split_over", [(2, 2048), (2, 3), (1, 3), (0, 2)])
def test_links_join_all_close_fingerprints(spark, radius, split_over):
    rng = np.random.default_rng(radius + split_over)
    base = rng.integers(0, 1 << 63, 40).tolist()
    prints = set(base)
    for b in base[:20]:
        for _ in range(6):
            prints.add(b ^ sum(1 << int(k) for k in rng.choice(63, int(rng.integers(1, 5)), replace=False)))
    prints |= {base[0] ^ i << 5 for i in range(70)}  # a large bucket
    prints = sorted(prints)
    df = spark.createDataFrame([(p,) for p in prints], "fp long")
    edges = [(r.u, r.v) for r in simhash.links(df, radius, split_over).collect()]
    assert all(bin(a ^ b).count("1") > 0 for a, b in edges)
    at = {p: i for i, p in enumerate(prints)}
    parent = list(range(len(prints)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in edges:
        x, y = find(at[a]), find(at[b])
        parent[max(x, y)] = min(x, y)
    assert [find(i) for i in range(len(prints))] == groups_brute(prints, radius)


def test_components_of_chains_and_hubs(spark):
    from herdlens.llm.components import components

    edges = [(i, i + 1) for i in range(100, 160)] + [(500, i) for i in range(501, 560)] + [(7, 7), (9, 3), (3, 9)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**{i: 100 for i in range(101, 161)}, **{i: 500 for i in range(501, 560)}, 9: 3}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_keep_one_of_each_group(spark, odd):
    kept = rows_of(simhash.keep_one(odd))
    assert simhash.keep_one(odd).columns == odd.columns
    ids = sorted(r["doc_id"] for r in kept)
    # 1, 2 and 3 have no words; 4 (twice), 5 and the null id are equal but for case.
    assert ids[:3] == [1, 4, 6] and len(ids) == len(set(ids))


def test_one_of_equal_rows_stays_with_columns_of_any_name(spark):
    rows = [(1, "the same words in every row", f"p{k}", k) for k in range(5)] + [(None, None, "x", 9)] * 3
    docs = spark.createDataFrame(rows, "doc_id long, text string, _print string, id long").withColumns({"print": F.lit("y"), "record": F.lit("z")})
    got = simhash.keep_one(docs).collect()
    assert [r.doc_id for r in got if r.doc_id] == [1] and len(got) == 2
    assert all((r._print, r.id) in {(f"p{k}", k) for k in range(5)} | {("x", 9)} and (r["print"], r.record) == ("y", "z") for r in got)


# ---------------------------------------------------------------- pipeline


def test_pipeline_stages(spark):
    import corpus_pipeline as P

    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    assert [n for n, _ in P.STAGES] == ["quality_classifier", "line_dedup", "simhash_dedup", "mix_sources", "best_fit_packing"]
    seen = docs
    for n, f in P.STAGES[:-1]:
        out = common.stored(f(spark, seen, SF_SMALL), "test-stage")
        assert out.columns == docs.columns, n
        if n == "quality_classifier":
            good = quality.op4_query(docs, spark.read.parquet(f"{SF_SMALL}/labels.parquet")).where("predicted = 1")
            assert Counter(r.doc_id for r in out.collect()) == Counter(r.doc_id for r in good.collect())
            assert out.count() < docs.count()
        if n == "line_dedup":
            assert Counter((r.doc_id, r.text) for r in out.collect()) == Counter((i, t) for i, t, _, _ in dedup_brute([(r.doc_id, r.text) for r in seen.collect()]))
        if n == "simhash_dedup":
            rows = seen.collect()
            group = groups_brute([fingerprint_brute(r.text) for r in rows])
            assert Counter(r.doc_id for r in out.collect()) == Counter(min(r.doc_id for r, h in zip(rows, group) if h == g) for g in set(group))
        if n == "mix_sources":
            rows = [(r.doc_id, r.source, r.text) for r in seen.collect()]
            want = Counter({i: n for (i, _, _), n in zip(rows, copies_brute(rows)) if n})
            assert Counter(r.doc_id for r in out.collect()) == want
        seen = out
    last = rows_of(P.STAGES[-1][1](spark, seen, SF_SMALL))
    assert Counter(r["doc_id"] for r in last if r["piece"] == 0) == Counter(r.doc_id for r in seen.collect())
    by = defaultdict(list)
    for r in last:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for places in by.values():
        ends = [0]
        for at, length in sorted(places):
            assert at == ends[-1]
            ends.append(at + length)
        assert ends[-1] <= 1024


def test_pipeline_stages_on_odd_rows(spark, odd):
    import corpus_pipeline as P

    for n, f in P.STAGES:
        for docs in (odd, odd.limit(0)):
            out = f(spark, docs, SF_SMALL)
            out.collect()
            assert n == P.STAGES[-1][0] or out.columns == odd.columns
