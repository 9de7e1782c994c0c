"""Importance resampling, MinHash near-dedup and ranked search against brute force, on odd rows and on empty tables."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from railyard.llm import minhash as H, ranked_search as R, resample as I
from railyard.llm.common import connected_components
from railyard.llm.words import slices, words
from test_operators import SF, docs, empty, rows_of  # noqa: F401


@pytest.fixture(scope="module")
def items(spark):
    rows = [(1, "the cat sat on the mat", "x"), (1, "the cat sat on the mat", "x"), (2, None, None), (3, "", ""), (4, "a chat maison DANS 1234", "y"),
            (None, "word17 word18 word4999 É 漢字", None), (6, "nothing here zzz qqq", "z")]
    return spark.createDataFrame(rows, "item_id long, text string, doc_id string")


def lowered(text):
    return (text or "").translate({i: i + 32 for i in range(65, 91)})


# words ----------------------------------------------------------------------
def test_slices_and_words():
    import pyarrow as pa
    texts = ["One two", None, "", "x" * 50, " two  One ", "é É"]
    batch = pa.RecordBatch.from_arrays([pa.array(range(6)), pa.array(texts)], names=["i", "t"])
    cut = list(slices(batch, 1, 20))
    assert [r for s in cut for r in s.column(0).to_pylist()] == list(range(6)) and len(cut) == 3
    got = []
    for s in cut:
        w = words(s.column(1), r"[\x20\x09-\x0D]+")
        got += [[w.dictionary[c].decode() for c in w.code[w.row == i]] for i in range(w.rows)]
    assert got == [lowered(t).split(" ") if t and t.strip() == t else [x for x in lowered(t).split(" ") if x] for t in texts]


# importance resampling --------------------------------------------------------
def brute_resample(docs, target, runs, buckets, percent, least, seed):
    def feats(t):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered(t))
        return w, [zlib.crc32(" ".join(w[i:i + n]).encode()) % buckets for n in range(1, runs + 1) for i in range(len(w) - n + 1)]
    s, t = Counter(), Counter()
    for _, x in docs:
        s.update(feats(x)[1])
    for x in target:
        t.update(feats(x)[1])
    S, T = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (S + buckets) / ((s[b] + 1) * (T + buckets)))) for b in range(buckets)]
    out = []
    for i, x in docs:
        w, f = feats(x)
        weight = sum(gain[b] for b in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append((i, len(w), len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    able = sorted((r for r in out if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0] or 0, r[2], r[3]))
    drawn = able[:len(able) * percent // 100]
    rest = able[len(drawn):] + [r for r in out if r[1] < least]
    return Counter([(*r, k + 1) for k, r in enumerate(drawn)] + [(*r, None) for r in rest])


@pytest.mark.parametrize("runs,percent,least", [(2, 50, 3), (1, 100, 0), (3, 25, 20)])
def test_resample_equals_brute_force(docs, items, runs, percent, least):
    got = I.importance_resample(docs, items, runs=runs, buckets=97, percent=percent, least_words=least, seed=7)
    want = brute_resample(rows_of(docs), [r.text for r in items.collect()], runs, 97, percent, least, 7)
    assert Counter(tuple(r) for r in got.select("doc_id", "n_words", "n_features", "weight", "score", "rank").collect()) == want


def test_resample_many_rows_and_ranges(spark, monkeypatch):
    rng = random.Random(1)
    rows = [(i, " ".join(rng.choices(["alpha", "beta", "gamma", "delta"], k=rng.randrange(0, 30)))) for i in range(400)]
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    target = spark.createDataFrame([("alpha beta alpha",)], "text string")
    got = I.importance_resample(d, target, buckets=11, percent=30, least_words=5)
    want = brute_resample(rows, ["alpha beta alpha"], 2, 11, 30, 5, 7)
    assert Counter(tuple(r) for r in got.select("doc_id", "n_words", "n_features", "weight", "score", "rank").collect()) == want


def test_resampled_rows_and_empty(docs, empty, items):
    out = I.resampled(docs, items, percent=50, least_words=3)
    assert out.columns == docs.columns and out.dtypes == docs.dtypes
    assert out.count() == docs.filter(F.size(F.regexp_extract_all(F.lower("text"), F.lit("[a-z0-9\u0080-￿]+"), 0)) >= 3).count() // 2
    assert I.importance_resample(empty, items).count() == 0
    assert I.importance_resample(docs, items.filter("false"), buckets=50).count() == docs.count()


# MinHash ------------------------------------------------------------------------
def brute_components(rows, shingle, percent):
    def shingles(t):
        w = re.findall(r"[^\x20\x09-\x0D]+", lowered(t))
        return frozenset([tuple(w[i:i + shingle]) for i in range(len(w) - shingle + 1)] or ([tuple(w)] if w else []))
    sets = [shingles(t) for _, t in rows]
    low = list(range(len(rows)))

    def root(i):
        while low[i] != i:
            i = low[i]
        return i
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                low[root(i)] = root(j)
    by = {}
    for i, (k, _) in enumerate(rows):
        if sets[i] and k is not None:
            by[root(i)] = min(by.get(root(i), k), k)
    return Counter((k, len(s), c, k == c) for (k, _), s, c in (
        (r, s, by.get(root(i)) if s else r[0]) for i, (r, s) in enumerate(zip(rows, sets))))


def found(df):
    return Counter(tuple(r) for r in df.select("doc_id", "n_shingles", "component_id", "kept").collect())


def test_minhash_odd_rows(docs, empty):
    assert found(H.minhash_near_dedup(docs)) == brute_components(rows_of(docs), 2, 80)
    assert H.minhash_near_dedup(empty).count() == 0


@pytest.mark.parametrize("shingle,percent", [(2, 80), (5, 80), (1, 90)])
def test_minhash_equals_brute_force(spark, shingle, percent):
    """Families of copies with a growing number of edits, chains, and pairs on both sides of the limit."""
    rng = random.Random(shingle)
    vocabulary = [f"w{i}" for i in range(300)]
    rows, n = [], 0
    for family in range(8):
        base = rng.choices(vocabulary, k=rng.choice([1, 3, 12, 60, 200]))
        for edits in (0, 0, 1, 2, 4, 8, 16, 32):
            text = list(base)
            for _ in range(min(edits, len(text) // 2)):
                text[rng.randrange(len(text))] = rng.choice(vocabulary)
            rows.append((n, " ".join(text)))
            n += 1
    text = rng.choices(vocabulary, k=120)
    for _ in range(40):         # a chain: far ends are not similar
        for _ in range(3):
            text[rng.randrange(len(text))] = rng.choice(vocabulary)
        rows.append((n, " ".join(text)))
        n += 1
    rng.shuffle(rows)
    got = H.minhash_near_dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), shingle=shingle, percent=percent)
    assert found(got) == brute_components(rows, shingle, percent)


def test_minhash_large_group_of_near_copies(spark):
    """More members than pivots, and long posting lists that are merged in parts."""
    rng = random.Random(9)
    base = [f"w{i}" for i in range(150)]
    rows = [(i, " ".join([*base[:p], f"x{i}", *base[p + 1:]])) for i, p in enumerate(rng.choices(range(150), k=300))]
    rows += [(1000 + i, " ".join([*base[:75], *[f"y{i}_{j}" for j in range(75)]])) for i in range(30)]
    got = H.minhash_near_dedup(spark.createDataFrame(rows, "doc_id long, text string"))
    assert found(got) == brute_components(rows, 2, 80)


def test_narrow_rows_take_few_tasks(spark, monkeypatch):
    """Few edges and labels stay in few tasks, however many an exchange is dealt to; a group's sets meet its pivots in parts."""
    held = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    for k, v in zip(held, ("40", "false")):
        spark.conf.set(k, v)
    try:
        chain = spark.createDataFrame([(i, i + 1) for i in range(30)] + [(i, i + 1) for i in range(50, 60)], "a long, b long")
        comp = connected_components(chain)
        assert comp.rdd.getNumPartitions() <= 4
        assert {r.node: r.component for r in comp.collect()} == {i: 0 if i <= 30 else 50 for i in (*range(31), *range(50, 61))}
        plans = []

        def seen(edges):
            plans.append(edges._jdf.queryExecution().executedPlan().toString())
            return connected_components(edges)
        monkeypatch.setattr(H, "connected_components", seen)
        # one group: neighbours share nine of eleven members, the last set is alone
        groups = [(i, 1, list(range(i, i + 10))) for i in range(25)] + [(25, 1, [1000])]
        got = H.confirmed_components(spark.createDataFrame(groups, "node long, grp long, members array<long>"), 80)
        assert {r.node: r.component for r in got.collect()} == {i: 0 if i < 25 else 25 for i in range(26)}
        assert plans and all(re.search(r"hashpartitioning\(grp#\d+L, part#\d+", p) for p in plans)
    finally:
        for k, v in held.items():
            spark.conf.set(k, v)


def test_least_matches():
    t = H.least_matches(80)
    tail = sum(math.comb(64, k) * .8 ** k * .2 ** (64 - k) for k in range(t))
    assert tail <= H.MISS < tail + math.comb(64, t) * .8 ** t * .2 ** (64 - t)
    assert H.least_matches(100) == H.COORDINATES


# ranked search ------------------------------------------------------------------
def brute_search(rows, items, k):
    def terms(t):
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered(t))
    tf = [Counter(terms(t)) for _, t in rows]
    n = [sum(c.values()) for c in tf]
    N, L = sum(x > 0 for x in n), sum(n)
    df = Counter(w for c in tf for w in c)
    out = Counter()
    for item, text in set(items):
        scored = []
        for (i, _), c, size in zip(rows, tf, n):
            s = sum(math.floor(1000 * math.log((2 * N + 2) / (2 * df[w] + 1))) * ((1_000_000_000 * c[w]) // (1000 * c[w] + 20 * (50 + 50 * size * N // L)))
                    for w in set(terms(text)) if w in c)
            if s > 0:
                scored.append((s, i))
        scored.sort(key=lambda x: (-x[0], x[1] is not None, x[1] or 0))
        out.update((item, r + 1, i, s) for r, (s, i) in enumerate(scored[:k]))
    return out


def ranks(df):
    return Counter(tuple(r) for r in df.select("item_id", "rank", "doc_id", "score").collect())


@pytest.mark.parametrize("k", [1, 3, 50])
def test_search_odd_rows(docs, empty, items, k):
    want = brute_search(rows_of(docs), [(r.item_id, r.text) for r in items.collect()], k)
    assert ranks(R.ranked_search(docs, items, k)) == want
    if k == 3:
        assert R.ranked_search(empty, items).count() == 0 and R.ranked_search(docs, items.filter("false")).count() == 0


def test_search_many_shards_blocks_and_item_groups(spark, tmp_path, monkeypatch):
    """Common and rare terms over many blocks and shards; groups of items; ties."""
    rng = random.Random(4)
    vocabulary = [f"t{i}" for i in range(400)]
    weights = [1 / (i + 1) for i in range(400)]
    rows = [(i, " ".join(rng.choices(vocabulary, weights, k=rng.randrange(0, 60)))) for i in range(3000)]
    rows += [(5000 + i, "t1 t2 t3 t4") for i in range(200)]
    asked = [(i, " ".join(rng.choices(vocabulary, k=12))) for i in range(20)] + [(99, "t1 t2 t3")]
    monkeypatch.setattr(R, "ITEMS_PER_GROUP", 8)
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    index = R.build_index(d, str(tmp_path / "index"), shard_bytes=8_000)
    assert index.filter("term is null").count() > 4
    got = R.search(index, spark.createDataFrame(asked, "item_id long, text string"), k=10)
    assert ranks(got) == brute_search(rows, asked, 10)


def test_posting_blocks_round_trip_and_bounds():
    rng = np.random.default_rng(2)
    n_docs = 100_000
    doc = np.sort(rng.choice(n_docs, 5000, replace=False))
    tf = np.where(rng.random(5000) < .01, 70_000, rng.integers(1, 4, 5000))
    lengths = rng.integers(1, 500, n_docs) + 70_000
    term, df, (heads, head_ends), (body, body_ends) = R._posting_lists(np.full(tf.sum(), 0), np.repeat(doc, tf), n_docs, lengths)
    norm = R._Norm(lengths, n_docs, int(lengths.sum()))
    one = R._List(heads, body, 3, norm)
    scores = np.zeros(n_docs, np.int64)
    one.add_range(0, n_docs, scores)
    want = np.zeros(n_docs, np.int64)
    want[doc] = 3 * R._impact(tf, norm.of(doc))
    assert df.tolist() == [5000] and (scores == want).all() and (one.bounds(doc) >= want[doc]).all()
    assert one.bound == one.block_max.max() and body_ends[-1] == len(body) and head_ends[-1] == len(heads)


def test_blocks_are_rejected_before_decompression():
    """A common term whose blocks cannot lift any candidate over the heap stays compressed."""
    rng = np.random.default_rng(1)
    n = 20_000
    lengths = np.full(n, 100)
    lists = []
    for docs, weight in ((np.arange(n), 1), (np.sort(rng.choice(n, 300, replace=False)), 5000)):
        _, _, (heads, _), (body, _) = R._posting_lists(np.zeros(len(docs), np.int64), docs, n, lengths)
        lists.append(R._List(heads, body, weight, R._Norm(lengths, n, 100 * n)))
    docs, scores = R.top_documents(lists, n, 5)
    assert len(docs) == 5 and len(lists[0]._open) < len(lists[0].heads) / 4
