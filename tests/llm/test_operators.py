"""Each operator against a brute-force version or an exact round trip, on odd rows and on an empty table."""

import hashlib
import itertools
import math
import os
import random
import re
import uuid
import zlib
from collections import Counter, defaultdict

import pytest
import xxhash
from pyspark.sql import functions as F

from railyard.llm import decontaminate as D, fingerprints as P, html_text as H, langid as L, licenses as C
from railyard.llm import mixing as M, ppm, simhash as S, suffix_dedup as X, warc as W
from railyard.llm.registry import CURVES

SF = "/root/testdata/sf0.001"

TEXTS = [
    (1, "Der Hund und die Katze sind im Haus. " * 8, "de", "a"), (2, None, "en", "a"), (3, "", None, None), (4, "the cat sat on the mat " * 12, "en", "b"),
    (5, "the cat sat on the mat " * 12, "en", "b"), (5, "another text that has the same id as the one before it, and is long enough to be cut " * 2, "en", "b"),
    (6, "1234 56 ... \t\r\n", "en", None), (7, "x" * 300, "en", "c"), (7, "x" * 300, "en", "c"), (None, "le chat est dans la maison avec les autres " * 5, "fr", "c"),
    (9, "Licensed under the Apache License, Version 2.0.\nsome words", "en", "c"), (10, "É ß漢字 " * 60, "de", "c"),
    (11, "word%d " * 5000 % tuple(range(5000)), "en", "a"), (12, "kurz", "de", "b"), (13, "\x00\x01 odd \x7f", "en", "b"),
]


@pytest.fixture(scope="session")
def docs(spark):
    """Nulls in every column, empty and long texts, ties, repeated rows, and columns whose names the operators use."""
    rows = [(*r, len(r[1] or ""), 1, "k", None) for r in TEXTS]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, size int, key string, blk int").repartition(3)


@pytest.fixture(scope="session")
def empty(docs):
    return docs.filter("false")


def rows_of(df):
    return [tuple(r) for r in df.select("doc_id", "text").collect()]


@pytest.fixture(scope="module")
def some(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").filter("doc_id < 80")


# mixing --------------------------------------------------------------------
def test_mix(spark, docs, empty):
    got = M.curriculum_mix(docs, CURVES).collect()
    assert len(got) == docs.count()
    by = defaultdict(list)
    for r in got:
        by[r.source].append(r)
        assert r.taken <= 3 * r["size"] and len(r.positions) <= 3 and all(0 <= t <= 1 for t in r.positions)
    total = sum(r["size"] for r in got)
    assert sum(rs[0].target for rs in by.values()) == pytest.approx(total)
    level = None
    for i, s in enumerate(sorted(by, key=lambda s: (s is None, s))):
        rs, weight = by[s], (5, 2, 1)[i % 3]
        own = sum(r["size"] for r in rs)
        assert rs[0].source_size == own and sum(r.taken for r in rs) == math.floor(rs[0].target)
        if rs[0].target < 3 * own:                  # uncapped sources share one level of words per weight
            assert level is None or level == pytest.approx(rs[0].target / weight)
            level = rs[0].target / weight
        else:
            assert rs[0].target == 3 * own
    assert sorted(map(str, M.curriculum_mix(docs, CURVES).collect())) == sorted(map(str, got))
    assert M.curriculum_mix(empty, CURVES).count() == 0


def test_mix_inverts_the_curve(spark):
    one = spark.range(400).select(F.col("id").alias("doc_id"), F.lit("s").alias("source"), F.lit("w").alias("text"))
    t = sorted(r.positions[0] for r in M.curriculum_mix(one, [[(0, 0), (0.5, 2), (1, 0)]]).collect())
    assert t[100] == pytest.approx(math.sqrt(1 / 8), abs=1e-9) and t[200] == pytest.approx(0.5) and t == sorted(t)


# suffix array --------------------------------------------------------------
def brute_repeats(rows, n=100):
    order = sorted({(i is None, i or 0, t or "") for i, t in rows})
    ids = sorted({(a, b) for a, b, _ in order})
    assert ids
    out, seen = {}, set()
    for none, i, t in order:
        b = t.encode()
        gone = bytearray(len(b))
        for p in range(len(b) - n + 1):
            if b[p:p + n] in seen:
                gone[p:p + n] = b"\1" * n
            seen.add(b[p:p + n])
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out[None if none else i, t] = (len(b), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(kept).hexdigest())
    return out


def test_suffix_dedup(spark, some, docs, empty, monkeypatch):
    assert X.suffix_array_dedup(empty).count() == 0
    want = brute_repeats(rows_of(some))
    for r in X.suffix_array_dedup(some).collect():
        assert [v for (i, _), v in want.items() if i == r.doc_id] == [tuple(r)[1:5]]
    got = Counter((r.doc_id, r.n_bytes) for r in X.suffix_array_dedup(docs, carry=["size", "blk"]).collect())
    assert got == Counter((i, len((t or "").encode())) for i, t in rows_of(docs))
    one = docs.filter("doc_id <> 5")                # ids that repeat with other text are ordered by digest
    want = brute_repeats(rows_of(one))
    for r in X.suffix_array_dedup(one).collect():
        assert tuple(r)[1:5] in [v for (i, _), v in want.items() if i == r.doc_id]


@pytest.mark.parametrize("seed", range(3))
def test_deep_shallow_order(seed):
    import numpy as np
    rng = np.random.default_rng(seed)
    s = rng.integers(0, 2, (300, 30)).astype(np.uint8) * 7
    s[rng.integers(0, 300, 200)] = s[0]
    g = rng.integers(0, 4, 300).astype(np.uint64)
    order, lcp = X.deep_shallow_sort(s, g, 8)
    strings = [(int(g[i]), s[i].tobytes()) for i in order]
    assert strings == sorted((int(a), b.tobytes()) for a, b in zip(g, s))
    for k in range(300):
        same = k and strings[k][0] == strings[k - 1][0]
        want = next((j for j in range(30) if strings[k][1][j] != strings[k - 1][1][j]), 30) if same else -1
        assert lcp[k] == want


# licences ------------------------------------------------------------------
def test_licences(spark, empty):
    files = spark.createDataFrame([
        (1, "a/LICENSE", "Released under the MIT License."), (2, "a/b/c.txt", "nothing"), (3, "a/b/d.txt", "x\nLicensed under CC BY-NC 4.0.\ny"),
        (4, "z/q.txt", "license of the public version"), (5, None, None), (6, "a/b/LICENSE", "hello"), (6, "a/b/LICENSE", "hello"), (7, "top.txt", "")],
        "doc_id long, path string, text string")
    got = {(r.doc_id, r.path): (r.licence, r.origin, r.origin_path) for r in C.licence_scan(files).collect()}
    assert got[1, "a/LICENSE"] == ("MIT", "own", "a/LICENSE")
    assert got[2, "a/b/c.txt"] == ("MIT", "inherited", "a/LICENSE")
    assert got[3, "a/b/d.txt"][:2] == ("CC-BY-NC-4.0", "own")
    assert got[4, "z/q.txt"] == got[5, None] == got[7, "top.txt"] == (None, None, None)
    assert got[6, "a/b/LICENSE"][1] == "inherited" and C.licence_scan(files).count() == 8
    assert C.licence_scan(empty.withColumn("path", F.lit("a"))).count() == 0


def test_key_terms_lose_no_match():
    weights = defaultdict(dict)
    for name, term, w in C.template_weights()[0]:
        weights[name][term] = w
    for ws in weights.values():
        assert math.sqrt(sum(w * w for t, w in ws.items() if t not in C.key_terms())) < C.THRESHOLD


def test_licence_texts_headers_and_tags(spark):
    """Whole licence files, comment headers of several lines, titles and SPDX tags, with version variants."""
    folder = f"{os.path.dirname(C.__file__)}/licence_texts"
    text = {n: open(f"{folder}/{n}.txt").read() for n in ("GPL-2", "GPL-3", "MPL-2.0", "Apache-2.0")}
    blocks = [t for n, t in C.templates() if n in ("BSD-2-Clause", "BSD-3-Clause") and "Redistribution and use" in t]
    mit = next(t for n, t in C.templates() if n == "MIT" and t.startswith("Permission"))
    gnu = next(t for n, t in C.templates() if n == "GPL-2.0-or-later" and "redistribute" in t)
    comment = lambda t: "/*\n * Copyright (c) 2020 A. Writer\n *\n" + "".join(f" * {x}\n *\n" for x in t.splitlines()) + " */\nint main() { return 0; }\n"
    rows = [(text["GPL-2"], "GPL-2.0"), (text["GPL-3"], "GPL-3.0"), (text["MPL-2.0"], "MPL-2.0"), (text["Apache-2.0"], "Apache-2.0"),
            (comment(blocks[0]), "BSD-2-Clause"), (comment(blocks[1]), "BSD-3-Clause"), (comment(mit), "MIT"), ("".join(f"# {x}\n" for x in gnu.split("; ")) + "x = 1\n", "GPL-2.0-or-later"),
            ("// SPDX-License-Identifier: Apache-2.0\ncode", "Apache-2.0"), ("# SPDX-License-Identifier: (GPL-3.0-only)\n", "GPL-3.0-only"), ("SPDX-License-Identifier: Other-1.0", None),
            ("MIT License\n", "MIT"), ("The MIT License (MIT)", "MIT"), ("no licence here\n\nat all", None), ("", None)]
    files = spark.createDataFrame([(i, f"d{i}/x", t) for i, (t, _) in enumerate(rows)], "doc_id long, path string, text string")
    got = {r.doc_id: r.licence for r in C.licence_scan(files).collect()}
    assert got == {i: want for i, (_, want) in enumerate(rows)}


def test_licence_products_are_dealt_once(spark, monkeypatch):
    """Lengths and products of units come of one exchange, and the texts of those that are left of none."""
    plans, kept = {}, C.checkpointed

    def seen(df):
        plans[tuple(df.columns)] = df._jdf.queryExecution().executedPlan().toString()
        return kept(df)
    monkeypatch.setattr(C, "checkpointed", seen)
    files = [(i, f"d/{i}", "Released under the MIT License.\nzzz" if i % 3 else "nothing") for i in range(9)]
    got = C.licence_scan(spark.createDataFrame(files, "doc_id long, path string, text string")).collect()
    assert {r.doc_id: r.licence for r in got} == {i: "MIT" if i % 3 else None for i in range(9)}
    assert plans["unit", "template", "dot", "square", "others"].count("Exchange hashpartitioning") == 1
    assert not any("Exchange" in line and "text" in line for line in plans["unit", "term", "n"].splitlines())


def test_licence_weights_come_from_the_corpus(spark):
    """Everyday words beside a grant weigh little once the files show them to be everyday."""
    files = [(i, f"d{i}/x", f"was written by someone for the project number {i}") for i in range(300)]
    files.append((300, "d300/x", "this was written by someone for the project: released under the MIT License"))
    got = {r.doc_id: r.licence for r in C.licence_scan(spark.createDataFrame(files, "doc_id long, path string, text string")).collect()}
    assert got[300] == "MIT" and not any(got[i] for i in range(300))


# html ----------------------------------------------------------------------
PAGE = ('<html><head><title>T</title></head><body><header>Top</header><nav><a>Home</a></nav><div class="cookie-notice">ok?</div><article><h1>One &amp; two</h1>'
        '<p>A\n  b<b>c</b>&nbsp;d<br>e<script>x</script><p>next<div class="ad">buy</div><ul><li>i1<li>i2</ul><form>f</form><section id="comments"><p>me too</p></section>'
        "</article><aside>s</aside><footer>f</footer><!-- <p>no</p> --></body></html>")


def test_html(spark):
    shared = "<div>Welcome to our lovely site please accept all</div>"
    pages = spark.createDataFrame([(1, "http://h/1", PAGE, 0), (2, "http://h/2", f"{shared}<p>first own text</p>", 0), (3, "http://h/3", f"{shared}<p>second, other words</p>", 0),
                                   (4, "http://g/3", f"{shared}<p>alone here</p>", 0), (7, "http://h/7", f"<p>the third one</p>{shared}", 0), (5, None, None, 0), (5, None, None, 0), (None, "", "", 0), (6, "u", "a < b &am &lt;", 0)],
                                  "page_id long, url string, html string, main int")
    got = {(r.page_id, r.url): r.text for r in H.extract_main_text(pages).collect()}
    assert got[1, "http://h/1"] == "One & two\nA bc d e\nnext\ni1\ni2"
    assert got[2, "http://h/2"] == "first own text" and got[3, "http://h/3"] == "second, other words" and got[7, "http://h/7"] == "the third one"
    assert got[4, "http://g/3"].startswith("Welcome to our") and got[5, None] == "" and got[None, ""] == "" and got[6, "u"] == "a < b &am <"
    assert H.extract_main_text(pages).count() == 9 and H.extract_main_text(pages.filter("false")).count() == 0


@pytest.mark.parametrize("wrapper", ["<div class='site has-sidebar'>", "<div class='no-sidebar'>", "<div class='no-comments'>", "<div class='with-nav'>", "<div class='ad-free'>",
                                     "<div class='sticky-header'>", "<form id='aspnetForm'>", "<div class='sidebar'>"])
def test_html_article_in_a_wrapper(wrapper):
    end = "</form>" if "form" in wrapper else "</div>"
    assert H.read_page(f"<body>{wrapper}<div class='menu'>m</div><article>the text<form>f</form></article><div class='site-header'>h</div>{end}</body>")[0] == "the text"
    assert H.read_page(f"<body><article>the text</article>{wrapper}<article class='comment'>c</article>{end}</body>")[0] == "the text"
    assert H.read_page("<div class='related'><article>other</article></div><p>own</p>")[0] is None


def test_html_page_in_a_form():
    assert H.read_page("<body><form action='x'><p>all the text</p><div class='menu'>m</div></form></body>") == (None, [(H.REST, "all the text"), (H.BOILERPLATE, "m")])
    assert H.read_page("<p>text</p><form>name</form>") == (None, [(H.REST, "text"), (H.BOILERPLATE, "name")])


@pytest.mark.parametrize("name", ["comment-form", "related-articles", "share-buttons", "cookie-bar", "ad-slot", "google-ad", "newsletter-form", "reader-comments",
                                  "user-comments", "sidebar-left", "signup-form", "popup-overlay", "adsbygoogle", "c-newsletter__inner", "adbox"])
def test_html_components_inside_an_article(name):
    assert H.read_page(f"<article><p>one</p><div class='{name}'><p>gone</p></div><p id='x'>two</p></article>")[0] == "one\ntwo"
    assert H.read_page(f"<main><p>one</p><section id='{name}'>gone</section></main>")[0] == "one"


def test_html_modifiers_and_headers():
    for name in ("has-comments", "no-ads", "with-sidebar", "entry-content", "adverb", "post-header"):
        assert H.read_page(f"<article><div class='{name}'>kept</div></article>")[0] == "kept"
    for tag in ("main", "article"):
        assert H.read_page(f"<{tag}><header><h1>Title</h1></header><p>text</p></{tag}>")[0] == "Title\ntext"
    assert H.read_page("<body><header>Top</header><main>text</main></body>")[0] == "text"


def test_html_copies_and_quotations_keep_their_text(spark):
    """Pages without an article: three copies, copies with other menus, and two pages that share a quotation."""
    text = " ".join(f"word{i}" for i in range(60))
    quote = "<p>to be or not to be that is the question</p>"
    rows = [(i, "http://copies/x", f"<p>{text}</p>") for i in range(3)]
    rows += [(10 + i, "http://near/x", f"<p>{text}</p><div>{i} {i + 1}</div>") for i in range(4)]
    rows += [(20 + i, "http://quote/x", f"<p>{'abcdefgh'[i]} first</p>{quote if i < 2 else ''}<p>own {i}</p>") for i in range(6)]
    got = {r.page_id: r.text for r in H.extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(got[i] == text for i in range(3)) and all(got[10 + i] == f"{text}\n{i} {i + 1}" for i in range(4))
    assert got[20] == "a first\nto be or not to be that is the question\nown 0"


def brute_html(rows):
    """Texts by page id: zones as parsed, repeated runs by comparing the streams of all pages."""
    read = {i: (u.split("/")[2] if u else "", *H.read_page(h or "")) for i, u, h in rows}
    streams = {}
    for i, (host, main, found) in read.items():
        streams[i] = host, tuple(w for _, t in found for w in t.split(" "))
    distinct, having = defaultdict(set), defaultdict(set)
    for host, every in streams.values():
        distinct[host].add(every)
        for p in range(len(every) - H.RUN + 1):
            having[host, every[p:p + H.RUN]].add(every)
    out = {}
    for i, (host, main, found) in read.items():
        every = streams[i][1]
        least = max(H.LEAST_STREAMS, math.ceil(len(distinct[host]) * H.SHARE))
        gone = {q for p in range(len(every) - H.RUN + 1) if len(having[host, every[p:p + H.RUN]]) >= least for q in range(p, p + H.RUN)}
        own, at = [], 0
        for zone, t in found:
            words = t.split(" ")
            if zone != H.BOILERPLATE:
                own.append([(w, q in gone) for q, w in enumerate(words, at)])
            at += len(words)
        copy = sum(g for b in own for _, g in b) > H.COPY * sum(map(len, own))
        out[i] = main if main is not None else "\n".join(filter(None, (" ".join(w for w, g in b if copy or not g) for b in own)))
    return out


@pytest.mark.parametrize("n, words, batch", [(60, 2, 10_000), (60, 2, 7), (400, 40, 100)])
def test_html_whole_path_equals_brute_force(spark, n, words, batch):
    """Pages with and without articles; a line that every page has, heads that only one page repeats and heads that some
    share, so that intervals cross the sorted ranges and the batches; copies and repeated rows."""
    rng = random.Random(n * words + batch)
    line = " ".join(f"menu{i}" for i in range(9))
    rows = []
    for i in range(n):
        own = " ".join(f"w{rng.randrange(words)}" for _ in range(rng.randrange(30)))
        body = f"<p>{own}</p>" if i % 5 else f"<article><p>{own}</p><div class='share-bar'>{line}</div><p>{line}</p></article>"
        rows.append((i, f"http://h{i % 7 == 0}/{i}", f"{body}<div>{line}</div><p>{f'r{i} ' * (200 if i % 20 == 0 else 3)}</p>"))
    rows += rows[:3] + [(n + i, u, h) for i, (_, u, h) in enumerate(rows[:4])]
    expected = brute_html(rows)
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        got = H.extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(5)).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    assert len(got) == len(rows) and all(r.text == expected[r.page_id] and r.n_chars == len(r.text) for r in got)
    assert any(line not in t for t in expected.values()) and any(line in t for t in expected.values())


def test_html_runs_decide_inside_articles(spark):
    """An untagged notice that nearly all articles of a host have falls; copies, quotations, headings, a sentence inside
    a paragraph and the same line on another host stay."""
    notice = "Subscribe to our letter and get all the news"
    page = lambda *t: "<article>" + "".join(f"<p>{x}</p>" for x in t) + "</article><div>menu</div>"
    rows, expected = [], {}
    for i in range(20):
        blocks = ["The story", f"own text number {i} is here", f"{notice} of page {i}", notice]
        if i % 2:
            blocks.append("to be or not to be that is the question")
        rows.append((i, "http://h/x", page(*(b for b in blocks if i < 18 or b != notice))))
        expected[i] = "\n".join(b for b in blocks if b != notice)
    rows += [(100 + i, "http://copies/x", page(notice, "the same text on every page")) for i in range(30)]
    expected |= {100 + i: f"{notice}\nthe same text on every page" for i in range(30)}
    rows += [(200 + i, "http://lines/x", page(*[f"{notice} {j}" for j in range(9)], f"{i}")) for i in range(12)]
    expected |= {200 + i: "\n".join([*(f"{notice} {j}" for j in range(9)), f"{i}"]) for i in range(12)}
    rows += [(300 + i, "http://few/x", page(notice, f"few pages have this number {i}")) for i in range(H.LEAST_ARTICLES - 1)]
    expected |= {300 + i: f"{notice}\nfew pages have this number {i}" for i in range(H.LEAST_ARTICLES - 1)}
    rows += [(400 + i, "http://some/x", page(notice, f"{i} of ten") if i < 12 else f"<p>{i} has none</p>") for i in range(18)]
    expected |= {400 + i: f"{notice}\n{i} of ten" if i < 12 else f"{i} has none" for i in range(18)}
    rows += [(i, "http://h/y", h) for i, _, h in rows[:3]] + [(None, "http://h/z", None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(5)
    got = H.extract_main_text(pages).collect()
    assert len(got) == len(rows) and all(r.text == expected.get(r.page_id, "") and r.n_chars == len(r.text) for r in got)
    kept = {r.page_id: r.text for r in H.extract_main_text(pages, article_share=1.0).collect()}
    assert kept[0].endswith(f"of page 0\n{notice}")


# language model ------------------------------------------------------------
def brute_ppm(rows):
    k_max, seen, words = ppm.ORDER, defaultdict(Counter), Counter()
    sym = lambda t: [-1] * k_max + list((t or "").encode().lower()) + [-1]
    for i, t in rows:
        if zlib.crc32(str("" if i is None else i).encode()) % 10:
            s = sym(t)
            for j, k in itertools.product(range(k_max, len(s)), range(k_max + 1)):
                seen[tuple(s[j - k:j])][s[j]] += 1
            words.update((t or "").encode().lower().split() + [None])
    n, v, out = sum(words.values()), len(words), []
    for i, t in rows:
        s, score = sym(t), 0.0
        for j in range(k_max, len(s)):
            out_of = set()
            for k in range(k_max, -1, -1):
                c = {a: b for a, b in seen.get(tuple(s[j - k:j]), {}).items() if a not in out_of}
                if c and s[j] in c:
                    score += math.log10((c[s[j]] - 0.5) / sum(c.values()))
                    break
                if c:
                    score += math.log10(len(c) / 2 / sum(c.values()))
                    out_of |= set(c)
            else:
                score -= math.log10(257 - len(out_of))
        tokens = (t or "").encode().lower().split() + [None]
        out.append((i, len(tokens), sum(words[w] > 0 for w in tokens), n, sum(math.log10((words[w] + 0.1) / (n + 0.1 * (v + 1))) for w in tokens), score))
    return sorted(out, key=str)


def test_ppm(spark, docs, empty, monkeypatch):
    monkeypatch.setattr(ppm, "BLOCK", 6000)
    monkeypatch.setattr(ppm, "CHUNK", 900)          # pieces within a document
    short = docs.filter("length(text) < 5000 or text is null")
    got = sorted([(r.doc_id, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in ppm.score_documents(short).collect()], key=str)
    for a, b in zip(got, brute_ppm(rows_of(short)), strict=True):
        assert a[:4] == b[:4] and a[4] == pytest.approx(b[4], abs=1e-6) and a[5] == pytest.approx(b[5], rel=1e-5, abs=1e-4)
    assert ppm.score_documents(empty).count() == 0


@pytest.mark.parametrize("hot", [4, 64, 10**9])
def test_ppm_frequent_pairs_and_long_texts(spark, docs, monkeypatch, hot):
    """No pair, some and every pair dealt by one symbol more; texts longer than a piece."""
    monkeypatch.setattr(ppm, "HOT", hot)
    monkeypatch.setattr(ppm, "BLOCK", 20_000)
    monkeypatch.setattr(ppm, "CHUNK", 5000)
    some = docs.filter("doc_id in (1, 4, 10, 11) or doc_id is null")
    got = sorted([(r.doc_id, r.score) for r in ppm.score_documents(some).collect()], key=str)
    want = sorted([(b[0], b[5]) for b in brute_ppm(rows_of(some))], key=str)
    assert [g[0] for g in got] == [w[0] for w in want] and [g[1] for g in got] == pytest.approx([w[1] for w in want], rel=1e-5, abs=1e-4)


def test_ppm_triples():
    import pyarrow as pa
    texts = [b"ab", b"", b"a\xff\x00"]
    got = {}
    for b in ppm._triple_counts([pa.RecordBatch.from_arrays([pa.array([t.decode("latin-1") for t in texts[:2]], pa.string())], names=["t"])]):
        got |= dict(zip(b.column(0).to_pylist(), b.column(1).to_pylist()))
    want = Counter()
    for t in texts[:2]:
        sym = [0, 0] + [x + 1 for x in t] + [0]
        want.update((sym[i - 1] << 18) | (sym[i - 2] << 9) | sym[i] for i in range(2, len(sym)))
    assert got == dict(want)


# archives ------------------------------------------------------------------
def test_warc_round_trip(spark, tmp_path):
    big, small = "<p>é</p>" * 30, "<p>tiny</p>"
    pages = spark.createDataFrame([(3, "http://a b/\n", big), (1, "http://x", big), (2, None, big), (4, "u", small), (5, "u", small), (6, "u", None), (7, "u", "\r\n\r\nWARC/1.1\r\n" * 20),
                                   (7, "u", "\r\n\r\nWARC/1.1\r\n" * 20)], "page_id long, url string, html string")
    got = sorted(map(tuple, W.archive_round_trip(pages, str(tmp_path / "w")).collect()), key=str)
    text = dict(pages.select("page_id", "html").collect())
    assert [g[0] for g in got] == [1, 2, 3, 4, 5, 6, 7, 7]
    for page, size, digest, kind, refers in got:
        b = (text[page] or "").encode()
        assert (size, digest) == (len(b), hashlib.sha256(b).hexdigest())
        if page in (2, 3):
            assert (kind, refers) == ("revisit", 1)
        elif page != 7:
            assert (kind, refers) == ("response", None)
    assert sorted(g[3:] for g in got if g[0] == 7) == sorted([("response", None), ("revisit", 7)], key=str)
    assert W.archive_round_trip(pages.filter("false"), str(tmp_path / uuid.uuid4().hex)).count() == 0


@pytest.mark.parametrize("version", [1, 2])
def test_arc_records(version):
    data = W.arc_version_block(version, "20240101") + b"\n" + W.arc_record(version, "http://a/", "1.2.3.4", "20240101", "text/html", b"x\ny") + b"\n"
    (_, fields, block), = W.parse_arc(data)
    assert block == b"x\ny" and fields["URL"] == "http://a/" and fields["Archive-length"] == "3" and W._iso("20240102") == "2024-01-02T00:00:00Z"
    with pytest.raises(ValueError):
        list(W.parse_arc(data[:-3]))


# language ------------------------------------------------------------------
def test_language(spark, docs, empty):
    train = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = L.fit(train, per_language=60)
    got = L.identify(train, model).join(train.select("doc_id", "lang"), "doc_id").filter("held_out").collect()
    assert sum(r.lang == r.lang_pred for r in got) > 0.97 * len(got) and all(0 <= r.score <= 1 for r in got)
    odd = {(r.doc_id, r.lang_pred == "und") for r in L.identify(docs, model).collect()}
    assert {(2, True), (3, True), (6, True), (1, False), (None, False)} <= odd and L.identify(docs, model).count() == docs.count()
    assert L.identify(empty, L.fit(empty)).count() == 0 and {r.lang_pred for r in L.identify(docs, L.fit(empty)).collect()} == {"und"}


# decontamination -----------------------------------------------------------
def test_decontaminate(spark, docs, empty):
    word = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    items = [(1, "Cat sat ON the mat, the cat sat on the mat the cat"), (2, "kurz"), (3, None), (4, ""), (5, "la maison avec les"), (None, "Der Hund und die Katze sind"),
             (6, "x " * 30), (6, "word1 word2")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    windows = defaultdict(set)
    for i, t in items:
        w = word(t)
        m = min(10, len(w))
        for p in range(len(w) - m + 1 if m else 0):
            windows[tuple(w[p:p + m])].add(None if i is None else str(i))
    want = Counter()
    for i, t in rows_of(docs):
        w, hit, found = word(t), set(), set()
        for m, p in ((m, p) for m in {len(k) for k in windows} for p in range(len(w) - m + 1)):
            if tuple(w[p:p + m]) in windows:
                hit |= set(range(p, p + m))
                found |= windows[tuple(w[p:p + m])] - {None}
        want[i, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)] += 1
    assert Counter(map(tuple, D.decontaminate(docs, bench).collect())) == want
    assert D.decontaminate(empty, bench).count() == 0
    assert all(r.n_hit == 0 and not r.contaminated for r in D.decontaminate(docs, bench.filter("false")).collect())


# simhash -------------------------------------------------------------------
def test_triples_cover_every_four_positions():
    assert all(any(set(t) <= set(c) for t in S.position_triples()) for c in itertools.combinations(range(8), 4))


def test_simhash(spark, docs, empty, monkeypatch):
    base = xxhash.xxh64_intdigest(b"seed")
    for frame in (docs, spark.read.parquet(f"{SF}/documents.parquet")):
        got = S.simhash_near_dedup(frame).collect()
        fp = {r.fp: r.fp % (1 << 64) for r in got}
        group = {f: f for f in fp}

        def top(f):
            while group[f] != f:
                f = group[f]
            return f
        for a, b in itertools.combinations(fp, 2):
            if (fp[a] ^ fp[b]).bit_count() <= 4:
                group[top(a)] = top(b)
        low = defaultdict(list)
        for r in got:
            low[top(r.fp)].append(r.doc_id)
        assert len(got) == frame.count()
        assert all(r.component_id == min(x for x in low[top(r.fp)] if x is not None) for r in got if any(x is not None for x in low[top(r.fp)]))
    words = "A b c d e".lower().split()
    votes = [xxhash.xxh64_intdigest(" ".join(words[i:i + 4]), 42) for i in range(2)]
    assert S.fingerprint(b"A b c d e", 4) == sum(1 << b for b in range(64) if sum(v >> b & 1 for v in votes) * 2 > 2)
    assert S.fingerprint(b" ", 4) == 0 and S.simhash_near_dedup(empty).count() == 0 and base
    monkeypatch.setattr(S, "LONG_LIST", 3)          # posting lists that are dealt again
    near = spark.createDataFrame([(base ^ (1 << i),) for i in range(62) if base >> 63 == 0 or True and base ^ (1 << i) < 1 << 63] or [(1,), (3,)], "fp long")
    found = S.links(near.distinct()).distinct().collect()
    reach = {r.a for r in found} | {r.b for r in found}
    assert reach == {r.fp for r in near.collect()}


def test_posteriors_equal_enumeration():
    import numpy as np
    rng = np.random.default_rng(5)
    k, lengths = 3, np.array([4, 3, 3, 1])
    model = L.Model(list("abc"), np.zeros((1, k)), {}, rng.normal(size=(k, k)), rng.normal(size=k))
    scores = rng.normal(size=(lengths.sum(), k))
    pairs = np.zeros((k, k))
    got = L.posteriors(scores, lengths, model, pairs)
    want, near, at = np.zeros_like(scores), np.zeros((k, k)), 0
    for n in lengths:
        paths = list(itertools.product(range(k), repeat=int(n)))
        value = np.array([math.exp(model.start[p[0]] + sum(scores[at + i, y] for i, y in enumerate(p)) + sum(model.transition[a, b] for a, b in zip(p, p[1:]))) for p in paths])
        value /= value.sum()
        for p, v in zip(paths, value):
            for i, y in enumerate(p):
                want[at + i, y] += v
            for a, b in zip(p, p[1:]):
                near[a, b] += v
        at += n
    assert np.allclose(got, want) and np.allclose(pairs, near)


def test_training_in_parts_equals_training_at_once(monkeypatch):
    import numpy as np
    rng = random.Random(1)
    pieces = [(lang, " ".join("".join(rng.choices(letters, k=5)) for _ in range(60))) for lang, letters in [("a", "abcde"), ("b", "defgh")] * 6]
    whole = L.train(pieces, rounds=5)
    monkeypatch.setattr(L, "CELLS", 100)
    parts = L.train(pieces, rounds=5)
    assert np.allclose(whole.weights, parts.weights) and np.allclose(whole.transition, parts.transition)


def test_training_memory_with_a_hundred_languages():
    """In a process of its own: 1,000 pieces of 120 words over 100 languages (4,000 take as much)."""
    import subprocess
    import sys
    code = ("import random, resource; from railyard.llm import langid as L; r = random.Random(1);"
            "words = [[''.join(r.choices('abcdefghijklmnopqrstuvwxyz', k=r.randint(2, 9))) for _ in range(900)] for _ in range(100)];"
            "before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss;"
            "m = L.train([(f'l{k:03}', ' '.join(r.choices(words[k], k=120))) for k in range(100) for _ in range(10)], rounds=1);"
            "assert len(m.languages) == 100; print((resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) // 1024)")
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    used = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, cwd=root, env={**os.environ, "PYTHONPATH": root})
    assert used.returncode == 0, used.stderr
    assert int(used.stdout.split()[-1]) < 1000


def test_labelling_memory_of_a_piece_of_text():
    """In a process of its own: 8 MB of text, the words of which are not all held as objects or scores."""
    import subprocess
    import sys
    code = ("import random, resource; from railyard.llm import langid as L; r = random.Random(1);"
            "words = [''.join(r.choices('abcdefghijklmnopqrstuvwxyz', k=r.randint(2, 9))) for _ in range(4000)];"
            "m = L.train([(f'l{k}', ' '.join(r.choices(words[k::4], k=120))) for k in range(4) for _ in range(10)], rounds=1);"
            "texts = [' '.join(r.choices(words, k=500)) for _ in range(2500)]; L.label_texts(texts[:20], m);"
            "before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss;"
            "assert len(L.label_texts(texts, m)) == 2500; print((resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) // 1024)")
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    used = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, cwd=root, env={**os.environ, "PYTHONPATH": root})
    assert used.returncode == 0, used.stderr
    assert int(used.stdout.split()[-1]) < 120


def test_labels_do_not_depend_on_pieces_or_blocks_of_words(spark, monkeypatch):
    words = {"en": "the house and the garden of this man", "de": "das haus und der garten von diesem mann"}
    rows = [(i, f"{words[lang]} {i} {words[lang]}", lang) for i in range(30) for lang in words]
    rows += [(90, None, None), (91, "12 34", "en"), (92, "", "de"), (93, "\u00c9t\u00e9 " * 40, "de"), (93, "12 34 the", "en"), (None, "der", "de")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").coalesce(1)
    model = L.fit(docs)

    def found():
        return [(r.doc_id, r.carried.text, r.held_out, r.lang_pred, round(r.score, 12)) for r in L.identify(docs, model, carry=["text"]).collect()]
    whole = found()
    assert len(whole) == len(rows) and [r[:2] for r in whole] == [r[:2] for r in rows]
    assert {r[3] for r in whole} == {"en", "de", "und"}
    monkeypatch.setattr(L, "PIECE", 50)
    assert found() == whole
    texts = [r[1] for r in rows]
    monkeypatch.setattr(L, "WORDS", 3)              # in this process; tasks have their own
    assert [(lang, round(score, 12)) for lang, score in L.label_texts(texts, model)] == [r[3:] for r in whole]


def test_more_languages_than_a_fixed_number(spark):
    """Every language has a piece in the sample, and all together no more than asked for."""
    rows = [(i, f"text of language {i % 300}", f"l{i % 300}") for i in range(3000)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    for most, low, high in [(900, 1, 3), (100, 1, 1)]:
        n = {r.lang: r["count"] for r in L.training_pieces(d, "lang", "text", "doc_id", 250, 120, most).groupBy("lang").count().collect()}
        assert max(n.values()) <= high and sum(n.values()) <= max(most, 300) and len(n) >= 0.6 * 300 * low


# fingerprints --------------------------------------------------------------
def test_fingerprints(spark, docs, empty):
    rows = sorted(rows_of(docs), key=lambda r: (r[0] is None, r[0] or 0, hashlib.sha256((r[1] or "").encode()).hexdigest()))
    want = Counter()
    for (i, t), (_, n) in zip(rows, rows[1:] + rows[:1]):
        t, n = t or "", n or ""
        q = len(t) // 4
        want[i, len(t), hashlib.sha256((t[:len(t) - q] + n[:q]).encode()).hexdigest()] += 1
    got = P.neighbour_likeness(docs).collect()
    assert Counter((r.doc_id, r.n_chars, r.edited_sha256) for r in got) == want
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got)
    same = P.fingerprint_documents(docs).filter("doc_id in (4, 5)").select("fingerprint").collect()
    assert Counter(r.fingerprint for r in same).most_common(1)[0][1] == 2
    assert P.neighbour_likeness(empty).count() == 0


def test_near_copies_of_short_texts_share_hashes():
    """Texts of 11 to 78 bytes with the last quarter replaced."""
    rng = random.Random(3)
    for n in range(11, 79):
        text, other = (bytes(rng.choices(range(97, 123), k=n)) for _ in range(2))
        near = text[:n - n // 4] + other[:n // 4]
        (_, a), (_, b) = P.winnowed([text, near])
        assert P.likeness(a, b) > 0


def brute_winnowed(text, gram, window):
    """Place and hash of the smallest gram, the rightmost of equal ones, of every window that meets the text."""
    if not text:
        return []
    gram = min(gram, len(text))
    h = [int(x) for x in P.gram_hashes(P.np.frombuffer(text, P.np.uint8), gram)]
    kept = set()
    for start in range(1 - window, len(h)):
        inside = range(max(0, start), min(len(h), start + window))
        low = min(h[i] >> 24 for i in inside)
        kept.add(max(i for i in inside if h[i] >> 24 == low))
    return [(i, h[i] >> 32) for i in sorted(kept)]


@pytest.mark.parametrize("piece", [200, 1 << 20])
def test_fingerprints_equal_brute_force(monkeypatch, piece):
    """Texts below a gram, below a window, around two windows and longer than a piece, alone and in groups."""
    monkeypatch.setattr(P, "PIECE", piece)
    rng = random.Random(piece)
    for _ in range(120):
        texts = [bytes(rng.choices(range(97, 97 + rng.choice([2, 5, 26])), k=rng.choice([0, 1, 7, 8, 9, 15, 22, 23, 24, 45, 46, 47, 199, 400, 900]))) for _ in range(rng.randrange(1, 6))]
        gram, window = rng.choice([(8, 16), (5, 8), (16, 4)])
        assert [list(zip(a.tolist(), h.tolist())) for a, h in P.winnowed(texts, gram, window)] == [brute_winnowed(t, gram, window) for t in texts]


def test_likenesses_equal_brute_force(spark, docs):
    rows = sorted(rows_of(docs), key=lambda r: (r[0] is None, r[0] or 0, hashlib.sha256((r[1] or "").encode()).hexdigest()))
    keep = lambda t: {h for _, h in brute_winnowed(t.encode(), P.GRAM, P.WINDOW)}
    like = lambda a, b: len(a & b) / len(a | b) if a or b else 1.0
    want = Counter()
    for (i, t), (_, n) in zip(rows, rows[1:] + rows[:1]):
        t, n = t or "", n or ""
        q = len(t) // 4
        edited, shown = t[:len(t) - q] + n[:q], "".join(f"{h:08x}" for _, h in brute_winnowed(t.encode(), P.GRAM, P.WINDOW))
        want[i, shown, round(like(keep(t), keep(edited)), 12), round(like(keep(t), keep(n)), 12)] += 1
    got = P.neighbour_likeness(docs).collect()
    assert Counter((r.doc_id, r.fingerprint, round(r.near_edited, 12), round(r.near_next, 12)) for r in got) == want


def test_likeness_does_not_jump_at_any_length():
    """Mean likeness of a text and its edited form by length: no two neighbouring lengths differ much."""
    rng, means = random.Random(3), []
    for n in range(30, 70, 4):
        total = 0
        for _ in range(200):
            text, other = (bytes(rng.choices(range(97, 123), k=n)) for _ in range(2))
            (_, a), (_, b) = P.winnowed([text, text[:n - n // 4] + other[:n // 4]])
            total += P.likeness(a, b)
        means.append(total / 200)
    assert min(means) > 0.3 and max(abs(a - b) for a, b in zip(means, means[1:])) < 0.1


def test_winnowing_guarantee():
    import random
    random.seed(5)
    text = bytes(random.choices(range(97, 107), k=700))
    (at, hashes), = P.winnowed([text], 5, 8)
    grams = [int(h) for h in (P.gram_hashes(P.np.frombuffer(text, P.np.uint8), 5) >> P.np.uint64(32))]
    assert [grams[i] for i in at] == hashes.tolist()
    assert all(any(p <= a < p + 8 for a in at) for p in range(len(grams) - 7))
    shared = text[200:212]                          # 5 + 8 - 1 bytes
    (_, other), = P.winnowed([b"Z" * 50 + shared + b"Y" * 50], 5, 8)
    assert set(other.tolist()) & set(hashes.tolist())


# pipeline ------------------------------------------------------------------
def test_pipeline_stages(spark):
    import corpus_pipeline as cp
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = docs
    for name, stage in cp.STAGES[:-1]:
        out = spark.createDataFrame(stage(spark, out, SF).collect(), docs.schema)
        assert out.columns == docs.columns and 0 < out.count() <= docs.count(), name
    assert cp.mixture(spark, out, SF).count() > 0
    for _, stage in cp.STAGES:
        assert stage(spark, docs.filter("false"), SF).count() == 0


def test_pipeline_odd_rows(spark, docs, tmp_path):
    """Nulls, ties, repeated rows and clashing columns through every stage; genuine replacement characters stay."""
    import corpus_pipeline as cp
    mark = spark.createDataFrame([(50, "a genuine \uFFFD mark in words " + "\u00e9t\u00e9 \u6f22 " * 40, "fr", "a", 1, 1, "k", None)], docs.schema)
    cut = spark.createDataFrame([(51, "x \uFFFD\u00e9" + "\u00e9t\u00e9 \u6f22 " * 40 + "\u6f22\uFFFD own end", "fr", "a", 1, 1, "k", None)], docs.schema)
    every = docs.unionByName(mark).unionByName(cut)
    out = every
    for name, stage in cp.STAGES[:-1]:
        out = spark.createDataFrame(stage(spark, out, SF).collect(), docs.schema)
        assert out.dtypes == docs.dtypes, name
    kept = {r.doc_id: r.text for r in out.collect()}
    assert "genuine \uFFFD mark" in kept[50] and kept[51].count("\uFFFD") == 2
    assert 2 not in kept and 3 not in kept and 6 not in kept           # no letters
    assert sorted(r.doc_id for r in cp.near_duplicates(spark, every, SF).collect() if r.doc_id in (4, 7)) == [4, 7]
    assert cp.mixture(spark, out, SF).count() > 0


def test_pipeline_run(spark, tmp_path):
    """``run`` writes and rereads every stage and returns what the stages return in turn."""
    import corpus_pipeline as cp
    got = cp.run(spark, SF)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for name, stage in cp.STAGES:
        docs = spark.createDataFrame(stage(spark, docs, SF).collect(), stage(spark, docs, SF).schema)
    assert Counter(map(str, got.collect())) == Counter(map(str, docs.collect()))
