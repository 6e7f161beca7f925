"""Ranked lexical search, exact top-k and whitening on small rows and against plain loops."""

import math
import re
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.llm import lexical, neighbours, threshold, toxicity, warc, whitening
from tessella.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
NAN = float("nan")


def terms(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def plain_ranking(docs, items, k):
    """Every document scored for every item."""
    held = [(i, Counter(t)) for i, t in ((i, terms(t)) for i, t in docs) if t]
    n, words = len(held), sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    out = []
    for item, asked in items.items():
        scores = []
        for i, c in held:
            m = 10 + 90 * sum(c.values()) * n // words
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 8 * m)) for t in asked if t in c)
            if s > 0:
                scores.append((-s, i is None, i or 0, i))
        out += [(item, at, i, -s) for at, (s, _, _, i) in enumerate(sorted(scores)[:k], 1)]
    return out


TEXTS = [
    (1, "Apple pear apple"), (2, "pear"), (3, None), (4, ""), (5, " \t..."), (6, "apple pear"), (7, "apple pear"), (7, "apple pear"), (None, "apple pear"),
    (8, "plum " * 4000 + "apple"), (9, "Éclair éclair plum"), (10, "x1-x1_x1 apple\x7fpear"), (11, "zebra"),
]
ITEMS = [(1, "APPLE, pear!"), (2, "éclair x1"), (3, None), (4, "nowhere"), (5, "plum"), (5, "zebra"), (None, "pear pear pear")]


@pytest.mark.parametrize("looked_up", [10, 0])
def test_lexical_search_of_odd_rows(spark, monkeypatch, looked_up):
    """Terms looked up in tasks, and joined by Spark; tiny shards and blocks."""
    monkeypatch.setattr(lexical, "LOOKED_UP", looked_up)
    monkeypatch.setattr(lexical, "SHARD_DOCS", 4)
    monkeypatch.setattr(lexical, "ITEM_BLOCK", 2)
    docs = spark.createDataFrame([(i, t, 9, "rank", "score") for i, t in TEXTS], "doc_id long, text string, n int, terms string, id string")
    items = spark.createDataFrame([(i, t, "w", 1) for i, t in ITEMS], "item_id long, text string, values string, number int")
    asked = {}
    for i, t in ITEMS:
        asked.setdefault(i, set()).update(terms(t))
    got = [tuple(r) for r in lexical.ranked(docs, items, k=4).collect()]
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    assert sorted(got, key=key) == sorted(plain_ranking(TEXTS, asked, 4), key=key)
    assert lexical.ranked(docs.limit(0), items).count() == 0 == lexical.ranked(docs, items.limit(0)).count()


@pytest.mark.parametrize("leaf", [1, 3, 24])
def test_trie_bounds_every_document_and_finds_the_best(leaf):
    rng = np.random.default_rng(3)
    rows = [np.sort(rng.choice(30, rng.integers(1, 9), replace=False, p=np.arange(30, 0, -1) / 465)) for _ in range(300)]
    rows += [rows[0]] * 60 + [np.arange(12)] * 30  # equal vectors, a long shared path
    counts, m = [rng.integers(1, 6, len(r)) for r in rows], rng.integers(10, 200, len(rows))
    trie = lexical.Trie(np.concatenate([[0], np.cumsum([len(r) for r in rows])]), np.concatenate(rows), np.concatenate(counts), m, leaf)
    covered = [i for i in range(len(trie.low)) if not trie.children[i]]
    assert sorted(x for i in covered for x in range(trie.low[i], trie.high[i])) == list(range(len(rows)))
    for _ in range(30):
        asked = np.sort(rng.choice(32, 5, replace=False))
        weights, ids = rng.integers(1, 50, 5), rng.permutation(len(rows))
        weigh = dict(zip(asked.tolist(), weights.tolist()))
        scores = [sum(weigh.get(int(t), 0) * (1_000_000_000 * int(c) // (1000 * int(c) + 8 * int(x))) for t, c in zip(r, k)) for r, k, x in zip(rows, counts, m)]
        want = sorted((-s, ids[i], i) for i, s in enumerate(scores) if s)[:10]
        assert sorted((-s, ids[i], i) for s, i in trie.search(asked, weights, 10, ids)) == want


def plain_top(vectors, asks, k, scale):
    best = {}
    for i, v in vectors:
        if i is not None and v and all(x is not None and math.isfinite(x) for x in v):
            x = [math.floor(scale * c) for c in v]
            best[i] = min(best.get(i, (len(x), x)), (len(x), x))
    out = []
    for q, (d, x) in best.items():
        if asks(q):
            near = sorted((-sum(a * b for a, b in zip(x, y)), i) for i, (e, y) in best.items() if i != q and e == d)
            out += [(q, at, i, -s) for at, (s, i) in enumerate(near[:k], 1)]
    return out


def odd_vectors():
    rng = np.random.default_rng(5)
    some = [(i, [float(x) for x in rng.standard_normal(6)]) for i in range(0, 80)]
    same = [(100 + i, [1.0, 0.0, 0.0, -1.0, 0.5, 0.0]) for i in range(40)]
    odd = [(200, None), (201, []), (202, [NAN] * 6), (203, [None, 1.0]), (204, [0.0] * 6), (210, [0.0] * 6), (205, [1.0, 2.0]), (206, [3.0, 4.0]), (207, [9.0]), (208, [1e5] * 6), (0, [0.5] * 6), (None, [9.0] * 6)]
    return some + same + odd


@pytest.mark.parametrize("block", [8192, 16])
def test_threshold_algorithm_against_all_pairs(spark, block):
    rows = odd_vectors()
    df = spark.createDataFrame([(i, v, 1, "rep", 2.0) for i, v in rows], "vec_id long, embedding array<double>, part int, rep string, least double")
    got = [tuple(r) for r in threshold.top_k(df, F.col("id") % 2 == 0, k=3, block=block).collect()]
    assert sorted(got) == sorted(plain_top(rows, lambda i: i % 2 == 0, 3, 256))
    assert threshold.top_k(df.limit(0), F.lit(True), k=3).count() == 0


def test_lists_stop_early_and_respect_ties():
    rng = np.random.default_rng(7)
    x = np.concatenate([rng.integers(-5, 6, (400, 4)), rng.integers(90, 99, (30, 4))]).astype(float)
    ids = rng.permutation(430)
    lists = threshold.Lists(ids, x)
    reads = []
    lists.order = type("Counted", (), {"__getitem__": lambda self, key, order=lists.order: reads.append(order[key].size) or order[key]})()
    for q in (np.array([1.0, 2, 0, 1]), np.array([-1.0, 0, 0, 3]), np.zeros(4)):
        reads.clear()
        scores, near = lists.search(q, 5, None)
        want = sorted((-s, i) for s, i in zip(x @ q, ids))[:5]
        assert sorted((-s, i) for s, i in zip(scores, near)) == want
        assert sum(reads) < 2 * 430
        least = -want[2][0]
        assert sorted(lists.search(q, 5, least)[0])[::-1][:3] == [-w[0] for w in want[:3]]


def plain_whitening(vectors, scale=64, offset=1_000_000):
    rows = [(i, tuple(math.floor(scale * c) + offset for c in v)) for i, v in vectors if v and all(x is not None and math.isfinite(x) for x in v)]
    fit = sorted({x for _, x in rows})
    n, d = len(fit), len(fit[0])
    sums = [sum(x[j] for x in fit) for j in range(d)]
    cov = [[float(Fraction(sum((n * x[a] - sums[a]) * (n * x[b] - sums[b]) for x in fit), n**3)) for b in range(d)] for a in range(d)]
    return rows, n, sums, np.array(cov)


def test_whitening_of_a_small_table(spark):
    rng = np.random.default_rng(9)
    mix = rng.standard_normal((5, 5))
    rows = [(i, (mix @ rng.standard_normal(5)).tolist()) for i in range(90)] + [(3, [1.0] * 5), (None, [2.0] * 5), (91, None), (92, [NAN] * 5), (93, []), (94, [None] * 5)]
    rows += [(i, [0.5] * 5) for i in range(100, 140)]
    df = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], "vec_id long, embedding array<double>, n int, dim string")
    usable, n, sums, cov = plain_whitening(rows)
    e, u = np.linalg.eigh(cov)
    e, u = e[::-1], u[:, ::-1]
    got = whitening.whiten(df, components=3).collect()
    assert len(got) == 3 * len(usable) and {(r.component, r.n) for r in got} == {(1, n), (2, n), (3, n)}
    dev = Counter((i, sum((n * a - s) ** 2 for a, s in zip(x, sums))) for i, x in usable)
    assert Counter((r.vec_id, r.deviation) for r in got if r.component == 2) == dev
    for r in got:
        assert r.explained == pytest.approx(e[r.component - 1] / np.trace(cov)) and r.identity_error < 1e-9
    for c in (1, 2, 3):
        mine = {r.vec_id: r.whitened for r in got if r.component == c}
        want = {i: float((np.array(x) - np.array(sums) / n) @ u[:, c - 1] / math.sqrt(e[c - 1])) for i, x in usable}
        sign = 1 if mine[7] * want[7] > 0 else -1
        assert all(sign * mine[i] == pytest.approx(want[i], abs=1e-6) for i in want if i != 3)


def test_whitening_without_variance_and_of_several_lengths(spark):
    make = lambda rows: spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    assert whitening.whiten(make([])).count() == 0
    one = whitening.whiten(make([(1, [1.0, 2.0]), (2, [1.0, 2.0])])).collect()
    assert [(r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in one] == [(1, 0, None, None, None)] * 4
    flat = whitening.whiten(make([(1, [0.0, 5.0]), (2, [1.0, 5.0]), (3, [7.0])])).collect()
    assert sorted((r.vec_id, r.component) for r in flat) == [(1, 1), (1, 2), (2, 1), (2, 2), (3, 1)]
    assert {(r.whitened is None, r.explained) for r in flat if r.vec_id == 1} == {(False, 1.0), (True, 0.0)}


def test_square_sums_of_large_numbers():
    rng = np.random.default_rng(1)
    z = rng.integers(-(2**61), 2**61, (50, 3))
    assert whitening.square_sums(z).tolist() == (z.astype(object) ** 2).sum(0).tolist()
    x = np.array([[2**50, 1], [3, -(2**52)]])
    s = x.astype(object).sum(0)
    assert whitening.centred(x, 2**20, s).tolist() == (2**20 * x.astype(object) - s).tolist()


def test_whitening_query_against_numpy(spark):
    got = QUERIES["op13_whiten_embeddings"](spark, SF).collect()
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    usable, n, sums, cov = plain_whitening(rows)
    e = np.linalg.eigvalsh(cov)[::-1]
    assert len(got) == 16 * len(usable)
    x = np.zeros((len(usable), 16))
    place = {i: at for at, (i, _) in enumerate(usable)}
    for r in got:
        x[place[r.vec_id], r.component - 1] = r.whitened
        assert r.explained == pytest.approx(e[r.component - 1] / np.trace(cov), rel=1e-6) and r.identity_error <= 1e-4
    assert np.abs(np.cov(x.T, bias=True) - np.eye(16)).max() < 1e-6


def test_archives_of_repeated_page_ids(spark):
    """Each record is judged by its own payload: a page_id may carry several."""
    a, b, small = "A" * 1500, "B" * 1500, "B" * 10
    rows = [(1, "http://x/1", a), (1, "http://x/2", small), (1, "http://x/3", b), (2, "http://x/4", a), (2, "http://x/4", a), (None, "http://x/5", a), (3, None, None), (3, "http://x/6", b)]
    pages = spark.createDataFrame([(*r, "d", 1) for r in rows], "page_id long, url string, html string, digest string, refers_to int")
    archive = warc.write_archive(pages)
    found = warc.look_up(archive, pages.select(warc.url_key(F.col("url")).alias("key"), "page_id"))
    got = Counter((r.page_id, r.payload_bytes, r.record_type, r.refers_to) for r in found.collect())
    assert set(got) == {(1, 1500, "revisit", 2), (1, 10, "response", None), (1, 1500, "revisit", 3), (2, 1500, "response", None), (None, 1500, "response", None), (3, 0, "response", None), (3, 1500, "response", None)}


def test_training_rows_of_a_repeated_doc_id_are_fixed(spark):
    docs = spark.createDataFrame([(1, "b b"), (1, "a a"), (1, None), (2, "x y")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, toxic int")
    assert toxicity.train(docs, labels) == toxicity.train(docs.orderBy(F.col("text").desc()).repartition(3), labels)


def test_heads_bound_every_score_of_their_block():
    rng = np.random.default_rng(12)
    x, q = rng.standard_normal((40, 7)) * 3 + 1, rng.standard_normal((25, 7))
    centre = x.mean(0)
    head = np.array([[*centre, np.sqrt(((x - centre) ** 2).sum(1).max())]])
    assert (neighbours.farthest(q, head)[:, 0] >= (q @ x.T).max(1)).all()
    assert (neighbours.farthest(q * 1e160, head * 1e160) == np.inf).any()
    low, high = x.min(0), x.max(0)
    assert (threshold.depth_0(q, np.array([[*low, *high]]))[:, 0] >= (q @ x.T).max(1)).all()


def test_neighbours_in_groups_over_many_parts(spark, monkeypatch):
    """Small parts and blocks: heads leave most parts out, and nothing of the result."""
    monkeypatch.setattr(neighbours, "ANSWERING", 64)
    rng = np.random.default_rng(13)
    centres = rng.standard_normal((12, 5)) * 6
    x = centres[rng.integers(0, 12, 500)] + rng.standard_normal((500, 5)) * 0.2
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {(r.query_id, r["rank"]): r.vec_id for r in neighbours.nearest(df, F.col("id") % 20 == 0, k=4, block=16).collect()}
    s = x @ x.T
    assert got == {(i, at): j for i in range(0, 500, 20) for at, (_, j) in enumerate(sorted((-s[i, j], j) for j in range(500) if j != i)[:4], 1)}
