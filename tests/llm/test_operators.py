"""The operators on small rows: nulls, empty texts, ties, repeated rows, empty tables, clashing
column names, and brute-force versions where SQL can't say what is right."""

import hashlib
import heapq
import itertools
import math
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.llm import chat, fingerprints, hilbert, licenses, mixing, neardup, neighbours, pieces, secrets, shingles, toxicity, warc
from tessella.llm.common import components, numbered

DOCS = "doc_id long, text string, source string, n string, size string, mins string, spans string"


def docs(spark, rows):
    """Documents with extra columns whose names clash with internal ones."""
    return spark.createDataFrame([(i, t, s, "n", "size", "mins", "spans") for i, t, s in rows], DOCS)


ODD = [(1, None, "a"), (2, "", "a"), (3, " \t\n", None), (4, "x" * 50_000, "b"), (5, "same words here now ok", "b"), (6, "same words here now ok", "b"), (6, "same words here now ok", "b"), (None, "no id at all here", "c")]


def test_numbering_and_components(spark):
    df = spark.createDataFrame([(x,) for x in "dacb"], "s string")
    assert {r.s: r.i for r in numbered(df, [F.col("s")], "i").collect()} == {"a": 0, "b": 1, "c": 2, "d": 3}
    assert numbered(df.limit(0), [F.col("s")], "i").count() == 0
    e = spark.createDataFrame([(5, 4), (4, 3), (9, 8), (3, 3)], "a long, b long")
    assert {r.id: r.component for r in components(e).collect()} == {5: 3, 4: 3, 3: 3, 9: 8, 8: 8}


def fill(sizes, weights, budget, most=3.0):
    """Water-filling by repeated clamping, as a plain loop."""
    target, free = [0.0] * len(sizes), set(range(len(sizes)))
    left = budget
    while free:
        total = sum(weights[i] for i in free)
        over = [i for i in free if left * weights[i] / total > most * sizes[i]]
        if not over:
            for i in free:
                target[i] = left * weights[i] / total
            break
        for i in over:
            target[i] = most * sizes[i]
            left -= target[i]
            free.discard(i)
    return target


@pytest.mark.parametrize("sizes", [(10, 10, 10), (1, 100, 100), (1, 2, 1000), (0, 5, 7)])
def test_water_filling(spark, sizes):
    df = spark.createDataFrame([(str(i), n, float(w)) for i, (n, w) in enumerate(zip(sizes, (5, 2, 1)))], "source string, size long, weight double")
    got = {r.source: r.target for r in mixing.water_fill(df).collect()}
    for i, want in enumerate(fill(sizes, (5, 2, 1), sum(sizes))):
        assert got[str(i)] == pytest.approx(want)


def test_mixing_meets_targets(spark):
    rows = [(i, " ".join(["w"] * (i % 7 + 1)), "abc"[i % 3] if i % 10 else None) for i in range(600)]
    r = mixing.mix_report(docs(spark, rows)).collect()
    for source, group in itertools.groupby(sorted(r, key=lambda x: str(x.source)), key=lambda x: x.source):
        group = list(group)
        assert abs(sum(x.taken for x in group) - group[0].target) <= 1
        assert all(x.taken <= 3 * x.size for x in group)
    assert sorted(r) == sorted(mixing.mix_report(docs(spark, rows)).collect())
    mixed = mixing.mix_documents(docs(spark, rows))
    assert mixed.columns == docs(spark, rows).columns
    assert abs(sum(len(x.text.split()) for x in mixed.collect()) - sum(x.taken for x in r)) <= 4


def test_mixing_odd_rows(spark):
    r = mixing.mix_report(docs(spark, ODD))
    assert r.count() == len(ODD) and r.where("size = 0 and taken <> 0").isEmpty()
    assert mixing.mix_report(docs(spark, [])).isEmpty() and mixing.mix_documents(docs(spark, [])).isEmpty()


def test_licenses(spark):
    known = licenses.known_licenses(spark)
    text = "Copyright (c) 2020 Somebody\n" + licenses.KNOWN["ISC"].upper().replace(",", " ,")
    rows = [(1, text, "a"), (1, text, "a"), (2, "x\nreleased under the MIT licence", "a"), *ODD]
    r = licenses.scan_licenses(docs(spark, rows), known).collect()
    assert len(r) == len(rows)
    assert [x.license_id for x in r if x.doc_id == 1 and x.license_id] == ["ISC", "ISC"]
    assert [x.line_licenses for x in r if x.doc_id == 2 and x.line_licenses] == [["notice:MIT"]]
    assert licenses.scan_licenses(docs(spark, []), known).isEmpty()


@pytest.mark.parametrize(("threshold", "least"), [(0.85, 17), (0.8, 15)])
def test_sketches_rarely_miss_a_pair_at_the_threshold(spark, threshold, least):
    tail = lambda m: sum(math.comb(32, i) * threshold**i * (1 - threshold) ** (32 - i) for i in range(m))
    assert neardup.least_equal(32, threshold) == least and tail(least) <= 1e-5 < tail(least + 1)
    for equal in (least, least - 1):
        rows = [(1, 10, True, 50, list(range(32))), (1, 11, False, 50, [i if i < equal else -1 - i for i in range(32)])]
        found = neardup._clusters(spark.createDataFrame(rows, "block long, rep long, open boolean, n long, mins array<long>"), threshold)
        assert found.count() == (2 if equal == least else 0)


def test_pipeline_keeps_the_best_paths(spark):
    import corpus_pipeline

    r = corpus_pipeline.encoded(spark, spark.createDataFrame([(1, "some plain words to encode here", "en", "a")], "doc_id long, text string, lang string, source string"), "").first()
    assert len(r.ids) > 0 and len(r.scores) == len(r.edits) == pieces.NBEST
    assert list(r.scores) == sorted(r.scores, reverse=True)


MIT_FILE = """MIT License

Copyright (c) Jane Doe

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM,
OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE
SOFTWARE.
"""


def test_usual_license_files(spark):
    body = MIT_FILE[MIT_FILE.index("Permission") :]
    files = [("MIT", MIT_FILE), ("MIT", body), ("MIT", "The MIT License (MIT)\nCopyright Jane Doe <jane@example.org>\n" + body), ("MIT", "Copyright 2020 Jane Doe. All rights reserved.\n" + body)]
    files += [(None, MIT_FILE.replace("free of charge", "for a fee")), (None, "Copyright license\n" + body), (None, "")]
    bsd = licenses.full_text("BSD-3-Clause")
    files.append(("BSD-3-Clause", "Copyright (c) 2019, Jane Doe\nAll rights reserved.\n\n" + bsd.replace("1. ", "* ").replace("2. ", "* ").replace("3. ", "* ")))
    apache = licenses.full_text("Apache-2.0")
    files += [("Apache-2.0", apache[: apache.index("APPENDIX:")]), ("Apache-2.0", apache.replace("[yyyy] [name of copyright owner]", "2021 Jane Doe").replace("http:", "https:"))]
    gpl = licenses.full_text("GPL-3.0")
    files.append(("GPL-3.0", gpl[: gpl.index("How to Apply")].replace("https:", "http:")))
    for name, (titles, starts, _) in licenses.LAYOUTS.items():
        text = licenses.full_text(name)
        own = text[text.index(starts[-1]) :] if starts else text
        files += [(name, text), (name, "Copyright (C) The Authors\n" + own), (name, titles[0] + "\n\nCopyright (c) 2020 Jane Doe\n\n" + own)]
    found = licenses.scan_licenses(docs(spark, [(i, t, "a") for i, (_, t) in enumerate(files)]), licenses.known_licenses(spark)).collect()
    assert {r.doc_id: r.license_id for r in found} == {i: name for i, (name, _) in enumerate(files)}


CHAT = "conv_id long, turn long, role string, text string, segments string"


def test_chat_round_trip_and_automaton(spark):
    rows = [
        (1, 0, "user", "a <|end|>\n<|user|>\n & &lt; b", ""), (1, 1, "assistant", "ü\n", ""), (2, 0, "assistant", None, ""), (2, 0, "assistant", None, ""), (3, None, None, "x", ""),
        (None, 0, "system", "", ""), (None, 1, "user", "q", ""), (None, 2, "assistant", "z", ""), (4, 0, "user", "q", ""), (5, 0, "us|er<", "t", ""),
    ]
    out = chat.format_chat(spark.createDataFrame(rows, CHAT))
    back = out.select("conv_id", "valid", "error_turn", chat.read_turns(chat.formatted("segments")).alias("t"), chat.loss_text("segments").alias("l")).collect()
    got = {r.conv_id: r for r in back}
    for c in got:
        want = sorted([(t is not None, t or 0, role or "", text or "") for i, t, role, text, _ in rows if i == c])
        assert [(x.role, x.text) for x in got[c].t] == [(w[2], w[3]) for w in want]
    assert got[1].l == "ü\n" and got[1].valid and got[None].valid
    assert (got[2].valid, got[2].error_turn) == (False, 0) and (got[4].valid, got[4].error_turn) == (False, 1)
    assert chat.format_chat(spark.createDataFrame([], CHAT)).isEmpty()


def test_hilbert_steps_are_unit():
    g = np.stack(np.meshgrid(*[np.arange(8)] * 3, indexing="ij"), -1).reshape(-1, 3)
    k = hilbert.hilbert_keys(g, 3)
    assert len(set(k.tolist())) == len(g) and (np.abs(np.diff(g[np.argsort(k)], axis=0)).sum(1) == 1).all()


def test_neighbours_against_brute_force(spark):
    rng = np.random.default_rng(0)
    x = rng.standard_normal((600, 8))
    x[100:160] = x[100]
    rows = [(i, [float(v) for v in r], "v") for i, r in enumerate(x)] + [(1000, None, "v"), (1020, [0.0] * 8, "v"), (1040, [float("nan")] * 8, "v"), (1060, [1.0, None], "v"), (1080, [None] * 8, "v")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, v string")
    got = {}
    for r in neighbours.nearest(df, F.col("id") % 20 == 0, 5).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    assert set(got) == {i for i in range(600) if i % 20 == 0}
    for q, found in got.items():
        s = [(-float(np.dot(x[q], x[i])), i) for i in range(600) if i != q]
        assert [f[1] for f in sorted(found)] == [i for _, i in sorted((round(a, 9), i) for a, i in s)[:5]]
    few = neighbours.nearest(df.where("vec_id in (0, 3)"), F.col("id") % 20 == 0, 5).collect()
    assert [(r.query_id, r["rank"], r.vec_id) for r in few] == [(0, 1, 3)]
    assert neighbours.nearest(df.limit(0), F.col("id") % 20 == 0, 5).isEmpty()


def test_neighbours_recall_with_small_blocks(spark):
    rng = np.random.default_rng(1)
    x = rng.standard_normal((10, 8))[rng.integers(0, 10, 2000)] * 3 + rng.standard_normal((2000, 8)) * 0.3
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "vec_id long, embedding array<double>")
    got = neighbours.nearest(df, F.col("id") % 20 == 0, 5, block=256, exact=False).groupBy("query_id").agg(F.collect_set("vec_id").alias("n")).collect()
    hit = 0
    for r in got:
        s = x @ x[r.query_id]
        s[r.query_id] = -np.inf
        hit += len(set(np.argsort(-s)[:5].tolist()) & set(r.n))
    assert hit / (5 * len(got)) >= 0.9


@pytest.mark.parametrize("near", [False, True])
def test_windows_hold_groups_and_the_check_finds_the_rest(spark, near):
    """Windows of 24 vectors on each side hold the neighbours in groups, and few of scattered
    vectors; with the check after them both tables' answers are those of brute force."""
    rng = np.random.default_rng(3)
    x = rng.standard_normal((200, 24))[rng.integers(0, 200, 3000)] + rng.standard_normal((3000, 24)) * 0.02 if near else rng.standard_normal((3000, 24))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "vec_id long, embedding array<double>")
    share = {}
    for exact in (False, True):
        got = neighbours.nearest(df, F.col("id") % 20 == 0, 5, block=16, exact=exact).groupBy("query_id").agg(F.collect_set("vec_id").alias("n")).collect()
        assert len(got) == 150
        hit = 0
        for r in got:
            s = x @ x[r.query_id]
            s[r.query_id] = -np.inf
            hit += len(set(np.argsort(-s)[:5].tolist()) & set(r.n))
        share[exact] = hit / (5 * len(got))
    assert share[True] == 1 and (share[False] >= 0.9) == near


def test_vectors_meet_those_of_their_length(spark):
    rows = [(0, [1.0, 2.0]), (1, [3.0, 1.0]), (2, [1.0, 0.0, 5.0]), (20, [2.0, 0.0, 1.0]), (40, [7.0]), (3, [1.0, 1.0]), (3, [2.0, 2.0])]
    got = neighbours.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("id") % 20 == 0, 5).collect()
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in got) == [(0, 1, 1, 5.0), (0, 2, 3, 3.0), (20, 1, 2, 7.0)]


def test_neighbours_ties_go_to_the_smaller_id(spark):
    df = spark.createDataFrame([(i, [1.0, float(i), 0.0]) for i in range(40)] + [(100, [1.0, 0.0, 1.0])], "vec_id long, embedding array<double>")
    got = neighbours.nearest(df, F.col("id") == 100, 3).orderBy("rank").collect()
    assert [(r["rank"], r.vec_id, r.score) for r in got] == [(1, 0, 1.0), (2, 1, 1.0), (3, 2, 1.0)]


def test_fingerprints_estimate_generalised_jaccard(spark):
    a = "red green blue blue blue one two three four five six seven"
    b = "red green blue blue one two three four nine ten"
    df = spark.createDataFrame([(1, a), (2, b), (3, a), (4, None), (5, ""), (6, " \n")], "doc_id long, text string")
    m = {r.doc_id: r.marks for r in fingerprints.fingerprints(df, ["doc_id"], samples=1600).collect()}
    same = lambda x, y: np.mean(np.array(m[x]) == np.array(m[y]))
    assert m[1] == m[3] and m[4] == m[5] == m[6] and same(1, 4) == 0
    assert same(1, 2) == pytest.approx(8 / 14, abs=0.05)
    assert fingerprints.fingerprints(df.limit(0), ["doc_id"]).isEmpty()


def agreement(a, b):
    """Share of equal marks of two fingerprints as text."""
    x, y = ([f[i : i + 8] for i in range(0, len(f), 8)] for f in (a, b))
    return sum(p == q for p, q in zip(x, y, strict=True)) / len(x)


def test_edited_texts(spark):
    rows = [(1, "abcdefghi"), (5, "é" * 7), (9, None), (11, "xy"), (12, "one two three four five"), (12, "another text of twelve"), (None, "no id"), (None, "no id"), (None, ""), (7, "twice the same"), (7, "twice the same"), (7, "twice the same")]
    df = spark.createDataFrame([(*r, "k", "i", 1) for r in rows], "doc_id long, text string, k string, i string, n_chars int")
    got = fingerprints.edited_report(df).collect()
    assert len(got) == len(rows)
    mark = spark.createDataFrame(rows, "doc_id long, text string").select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.xxhash64(F.coalesce("text", F.lit("")), F.col("doc_id").isNull()).alias("h")).collect()
    order = sorted(mark, key=lambda r: (r.doc_id is None, -(r.doc_id or 0), r.h))
    want = []
    for i, r in enumerate(order):
        t, nxt = r.text, order[(i + 1) % len(order)].text
        n = len(t) // 3
        want.append((r.doc_id, len(t), hashlib.sha256((t[: len(t) - n] + nxt[:n]).encode()).hexdigest()))
    assert sorted(map(repr, want)) == sorted(repr((r.doc_id, r.n_chars, r.edited_sha256)) for r in got)
    prints = {r.doc_id: r.fingerprint for r in got if r.doc_id not in (12, None)}
    for r in got:
        assert r.near_edited == pytest.approx(agreement(r.fingerprint, r.edited_fingerprint)) and 0 <= r.near_next <= 1
    assert {r.doc_id: r.near_next for r in got if r.doc_id in (9, 5)} == pytest.approx({9: agreement(prints[9], prints[7]), 5: agreement(prints[5], prints[1])})
    assert sorted(r.near_next for r in got if r.doc_id == 7)[1:] == [1, 1]
    assert fingerprints.edited_report(df.limit(0)).isEmpty()
    alone = fingerprints.edited_report(df.where("doc_id = 1")).first()
    assert alone.near_next == 1


def test_two_fingerprints_from_one_draw_are_those_of_each_text(spark):
    rng = np.random.default_rng(4)
    rows = [(i, " ".join(f"w{x}" for x in rng.integers(0, 30, int(rng.integers(0, 60))))) for i in range(40)] + [(40, None), (41, "x " * 30_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    report = {r.doc_id: r for r in fingerprints.edited_report(df, samples=20).collect()}
    plain = {r.doc_id: r.f for r in fingerprints.fingerprints(df, ["doc_id"], samples=20).select("doc_id", fingerprints.as_text(F.col("marks")).alias("f")).collect()}
    assert {i: r.fingerprint for i, r in report.items()} == plain and {len(f) for f in plain.values()} == {160}
    texts = [t or "" for _, t in sorted(rows, reverse=True)]
    edited = [(i, t[: len(t) - len(t) // 3] + texts[(k + 1) % len(texts)][: len(t) // 3]) for k, (i, t) in enumerate(zip(sorted(dict(rows), reverse=True), texts))]
    again = fingerprints.fingerprints(spark.createDataFrame(edited, "doc_id long, text string"), ["doc_id"], samples=20).select("doc_id", fingerprints.as_text(F.col("marks")).alias("f"))
    assert {i: r.edited_fingerprint for i, r in report.items()} == {r.doc_id: r.f for r in again.collect()}


def test_documents_with_no_bid_within_reach_are_drawn_in_full(spark, monkeypatch):
    rng = np.random.default_rng(6)
    rows = [(i if i else None, " ".join(f"w{x}" for x in rng.integers(0, 40, int(rng.integers(0, 80))))) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = []
    for likely in (1e9, 24.0, 2.0, 0.01):
        monkeypatch.setattr(fingerprints, "LIKELY", likely)
        found.append({r.doc_id: tuple(r.marks) for r in fingerprints.fingerprints(df, ["doc_id"], samples=18).collect()})
    assert len(found[0]) == 60 and {len(x) for x in found[0].values()} == {18} and all(f == found[0] for f in found)


def small_pieces(n, s, p):
    """All segmentations of a short text by brute force, best first."""
    def walk(at, score, ids):
        if at == len(s):
            yield score, ids
        for i, j, x, own in p.edges(s):
            if i == at:
                yield from walk(j, score + x, ids + own)

    return sorted(walk(0, 0.0, ()), key=lambda x: (-x[0], x[1]))[:n]


def test_nbest_against_all_paths():
    p = pieces.load(pieces.default_model())
    for s in (" there", " Höhe", "\n", " ▁x", "   a", " 12ab"):
        want = small_pieces(5, s, p)
        got = p.nbest(s, 5)
        assert [round(x[0], 9) for x in got] == [round(x[0], 9) for x in want]
        ids, score, loss = p.best(s)
        assert score == pytest.approx(want[0][0]) and (len(want) < 2 or loss == pytest.approx(want[0][0] - want[1][0]))
    words = [" there", " where", " these", " xhere", " Ωμέγα", " thing"] * 2
    words = list(dict.fromkeys(words))
    ids, counts, scores, losses = p.best_many(words)
    for w, own, score, loss in zip(words, np.split(ids, np.cumsum(counts)[:-1]), scores, losses, strict=True):
        assert (tuple(own), score, loss) == (p.best(w)[0], pytest.approx(p.best(w)[1]), pytest.approx(p.best(w)[2]))


BASE64 = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"


@pytest.mark.parametrize("word", [*("x" * n for n in range(499, 504)), "x" * 50_000, "-" * 50_000, "日本語漢字" * 10_000, "".join(np.random.default_rng(2).choice(list(BASE64), 50_000))], ids=lambda w: f"{w[:2]}{len(w)}")
def test_nbest_of_long_words_is_that_of_a_dynamic_program(word):
    p, n = pieces.load(pieces.default_model()), 4
    into = [[] for _ in range(len(word) + 1)]
    for i, j, score, _ in p.edges(word):
        into[j].append((i, score))
    best = [[0.0]]
    for j in range(1, len(word) + 1):
        best.append(heapq.nlargest(n, (x + score for i, score in into[j] for x in best[i])))
    got = p.nbest(word, n)
    assert [x[0] for x in got] == pytest.approx(best[-1], rel=1e-9) and len({x[1] for x in got}) == len(best[-1])


def test_document_nbest_is_best_of_all(spark):
    p = pieces.load(pieces.default_model())
    text = "so is it"
    scores = pieces.Encoder(pieces.default_model(), 4).encode_all([text])[2][0]
    want = small_pieces(4, " " + text, p)
    assert [round(x, 9) for x in scores] == [round(x[0], 9) for x in want]
    df = pieces.encode(docs(spark, [(1, text, "a")]), pieces.default_model())
    alt = df.select(F.transform("edits", lambda e: pieces.alternative(F.col("ids"), e)).alias("a")).first().a
    assert {tuple(a) for a in alt} == {x[1] for x in want} or [sum(1 for _ in a) for a in alt]


def test_encode_decode_round_trip(spark):
    rows = [*ODD, (20, " leading  double ▁ and \ttabs\r\n日本語 😀", "a"), (21, "\n\n  ", "b")]
    df = docs(spark, [r for r in rows if r[0] not in (None, 6)])
    found = pieces.encode(df, pieces.default_model(), columns=["doc_id", "size"])
    back = {r.doc_id: r.text for r in pieces.decode(found, pieces.default_model(), ["doc_id"]).collect()}
    assert back == {i: t or "" for i, t, _ in rows if i not in (None, 6)}
    assert pieces.encode(docs(spark, []), pieces.default_model()).isEmpty()


def test_archive_and_index(spark):
    big = "x" * 1200
    rows = [(1, "http://a.b.c/x", big), (2, "http://a.b.c/y", big), (5, None, big), (3, "http://z.c/#q", None), (4, "odd\nurl", ""), (None, "http://n.com", "n" * 2000), (7, "http://a.b.c/x", big), (8, "u", "WARC/1.1\r\n\r\n\r\n")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    archive = warc.write_archive(pages)
    got = {r.page_id: r for r in warc.look_up(archive, pages.select(warc.url_key(F.col("url")).alias("key"), "page_id")).collect()}
    assert len(got) == len(rows)
    for i, url, html in rows:
        b = (html or "").encode()
        assert (got[i].payload_bytes, got[i].payload_digest, got[i].url) == (len(b), hashlib.sha1(b).hexdigest(), url)
    assert {i: (got[i].record_type, got[i].refers_to) for i in (1, 2, 5, 7)} == {1: ("revisit", 7), 2: ("revisit", 7), 5: ("revisit", 7), 7: ("response", None)}
    assert warc.look_up(archive, spark.createDataFrame([("nowhere", 1)], "key string, page_id long")).isEmpty()
    empty = warc.write_archive(pages.limit(0))
    assert warc.look_up(empty, pages.select(warc.url_key(F.col("url")).alias("key"), "page_id")).isEmpty()


def test_secrets(spark):
    key = "A" * 39 + "/"
    rows = [
        (1, "é Password: hunter22 ſecret=abcdefgh token = 'ab' api-key=zzzzzzzz apikey=zzzzzzzz", "a"), (2, "AKIA" + "B" * 16 + f" {key} https://x.example.com/a secret=abcdefg", "a"),
        (3, f"{key} https://x.example.com", "a"), (4, "f" * 24 + " " + "f" * 23, "a"), (5, "AKIA" + "B" * 15, "a"), *[(i + 100 if i else i, t, s) for i, t, s in ODD],
    ]
    got = {r.doc_id: r.s for r in secrets.scan_secrets(docs(spark, rows)).select("doc_id", secrets.spans_text("spans").alias("s")).collect()}
    text = rows[0][1]
    base = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
    assert got[1] == ",".join(f"assign:{m.start()}:{m.end()}" for m in base.finditer(text) if len(m[2]) >= 6)
    assert [x.split(":")[0] for x in got[2].split(",")] == ["access", "key", "endpoint", "assign"]
    assert got[3] == "" and got[4] == "hex:0:24" and got[5] == ""
    masked = {r.doc_id: r.text for r in secrets.redact_secrets(docs(spark, rows)).collect()}
    assert masked[4] == "[HEX] " + "f" * 23 and masked[3] == rows[2][1] and masked[101] is None
    assert secrets.scan_secrets(docs(spark, [])).isEmpty() and secrets.redact_secrets(docs(spark, [])).isEmpty()


def brute_components(rows, width, hundred):
    def items(t):
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        return frozenset(tuple(w[i : i + width]) for i in range(len(w) - width + 1)) if len(w) >= width else frozenset([tuple(w)] if w else [])

    sets = {i: items(t) for i, t, _ in rows if i is not None}
    comp = {i: i for i in sets}
    for _ in range(len(sets)):
        for a, b in itertools.combinations(sets, 2):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= hundred * (len(sets[a]) + len(sets[b]) - both):
                comp[a] = comp[b] = min(comp[a], comp[b])
    return comp, {i: len(s) for i, s in sets.items()}


@pytest.mark.parametrize("leaf", [256, 8])
def test_near_duplicates_against_brute_force(spark, leaf):
    rng = np.random.default_rng(3)
    base = [f"w{x}" for x in rng.integers(0, 1000, 120)]
    rows = [r for r in ODD if r[0] != 6]
    for i in range(60):
        t = list(base)
        for at in rng.integers(0, len(t), rng.integers(0, 6)):
            t[at] = f"new{rng.integers(0, 10**6)}"
        rows.append((200 + i, " ".join(t).upper() if i % 2 else "\n".join(t), "a"))
    rows += [(400 + i, " ".join(f"o{x}" for x in rng.integers(0, 10**6, 40)), "b") for i in range(40)]
    got = {r.doc_id: r for r in neardup.near_duplicates(docs(spark, rows), 3, 0.85, leaf=leaf).collect()}
    comp, sizes = brute_components(rows, 3, 85)
    assert {i: got[i].component_id for i in comp} == comp and {i: got[i].n_shingles for i in sizes} == sizes
    assert got[None].component_id is None and got[None].kept
    kept = neardup.drop_near_duplicates(docs(spark, rows), width=3, threshold=0.85)
    assert kept.columns == docs(spark, rows).columns and {r.doc_id for r in kept.collect()} == {i for i, r in got.items() if r.kept}


def fast_components(rows, width, hundred):
    """Components by exact intersections, counted through an inverted index."""
    def items(t):
        w = re.findall(r"[^\x20\x09-\x0D]+", t.lower())
        return {" ".join(w[i : i + width]) for i in range(len(w) - width + 1)}

    sets = {i: items(t) for i, t in rows}
    vocabulary = {x: n for n, x in enumerate(sorted(set().union(*sets.values())))}
    ids = sorted(sets)
    m = np.zeros((len(ids), len(vocabulary)), np.float32)
    for r, i in enumerate(ids):
        m[r, [vocabulary[x] for x in sets[i]]] = 1
    both, size = m @ m.T, m.sum(1)
    linked = 100 * both >= hundred * (size[:, None] + size[None] - both)
    comp = {}
    for r, i in enumerate(ids):
        if i not in comp:
            front, comp[i] = [r], i
            while front:
                for y in np.flatnonzero(linked[front.pop()]):
                    if ids[y] not in comp:
                        comp[ids[y]] = i
                        front.append(int(y))
    return comp


@pytest.mark.parametrize(("width", "threshold"), [(5, 0.8), (3, 0.85)])
def test_large_families_against_brute_force(spark, width, threshold):
    """3,000 near copies, many beyond the threshold of all others, some of those with copies of
    their own; 3,000 texts that share one line; and pairs that change the words around it."""
    rng = np.random.default_rng(8)
    new = lambda n: [f"n{x}" for x in rng.integers(0, 10**9, n)]
    base, line = new(130), new(12)
    rows = []
    for i in range(3000):
        t = list(base)
        for at in rng.integers(0, len(t), int(rng.integers(0, 7))):
            kind = rng.integers(0, 3)
            t[at : at + (kind != 1)] = new(1) if kind != 2 else []
        rows.append(t)
        if i % 10 == 0:
            t = list(t)
            t[int(rng.integers(0, len(t)))] = new(1)[0]
            rows.append(t)
    for i in range(3000):
        t = new(int(rng.integers(10, 60)))
        rows.append([*t[: len(t) // 2], *line, *t[len(t) // 2 :]])
        if i % 50 == 0:
            rows.append([*t[: len(t) // 2], *line, *t[len(t) // 2 :], *new(1)])
    rows = [(int(i), " ".join(t)) for i, t in zip(rng.permutation(len(rows)), rows)]
    got = {r.doc_id: r.component_id for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), width, threshold).collect()}
    want = fast_components(rows, width, round(100 * threshold))
    assert got == want and len(set(want.values())) > 3000


def test_a_repeated_id_is_one_document(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(30)) for x in "abc")
    rows = [(5, a), (5, b), (5, a), (7, b), (9, a), (3, c), (3, c.upper()), (11, c)]
    got = {(r.doc_id, r.component_id, r.kept) for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {(5, 5, True), (7, 5, False), (9, 5, False), (3, 3, True), (11, 3, False)}


def test_near_duplicates_of_nothing(spark):
    assert neardup.near_duplicates(docs(spark, [])).isEmpty()
    assert neardup.near_duplicates(docs(spark, [(1, "", "a")])).first().kept


def test_shared_counts_match_sets():
    rng = np.random.default_rng(0)
    sets = [np.unique(rng.integers(0, 300, 200)).astype(np.uint64) for _ in range(9)]
    got = shingles_counts = neardup.shared_counts(sets)
    assert all(got[a, b] == len(np.intersect1d(sets[a], sets[b])) for a, b in itertools.combinations(range(9), 2)) and shingles_counts is got
    assert [len(s) for s in shingles.shingle_sets([b"", b"a", b"A b", b"a b c a b c"], 3)] == [0, 1, 1, 3]


def test_toxicity_learns_and_keeps_clean(spark):
    rng = np.random.default_rng(5)
    rows, labels = [], []
    for i in range(400):
        w = [f"w{x}" for x in rng.integers(0, 60, int(rng.integers(5, 120)))]
        bad = i % 4 == 0
        if bad:
            w[int(rng.integers(0, len(w)))] = "vile" + "abcdefg"[i % 7]
        rows.append((i, " ".join(w), "a"))
        labels.append((i, int(bad)))
    rows += [(900, None, "a"), (901, "", "a"), (None, "w1 w2", "a")]
    lab = spark.createDataFrame([*labels, (900, None), (None, 1)], "doc_id long, toxic int")
    r = toxicity.toxicity(docs(spark, rows), lab).collect()
    assert len(r) == len(rows) and all(0 <= x.score <= 1 for x in r)
    truth = dict(labels)
    held = [x for x in r if x.held_out and x.doc_id in truth]
    assert np.mean([x.predicted == truth[x.doc_id] for x in held]) > 0.9
    assert {x.score for x in r if x.doc_id in (900, 901)} == {0.0}
    assert toxicity.toxicity(docs(spark, []), lab).isEmpty()
    assert toxicity.toxicity(docs(spark, rows), lab.limit(0)).count() == len(rows)


def test_gradients_match_differences():
    rng = np.random.default_rng(0)
    p = {k: v.astype(np.float64) for k, v in toxicity.initial(3).items()}
    emb = rng.standard_normal((9, toxicity.WORD_DIM + toxicity.GRAM_DIM))
    index, mask = rng.integers(0, 9, (6, 4)), np.arange(6)[:, None] < np.array([6, 3, 1, 5])[None]
    y, w = np.array([1.0, 0, 1, 0]), np.ones(4)
    loss = lambda: float(-(y * np.log(q := toxicity.forward(p, emb, index, mask)) + (1 - y) * np.log(1 - q)).mean())
    g, demb = toxicity._gradients(p, emb, index, mask, y, w)
    for k, at in (("uf", (1, 2)), ("ub", (0, 20)), ("wf", (2, 9)), ("cb", (4,)), ("att", (3,)), ("out", (9,))):
        old = p[k][at]
        p[k][at] = old + 1e-4
        up = loss()
        p[k][at] = old - 1e-4
        down = loss()
        p[k][at] = old
        assert g[k][at] == pytest.approx((up - down) / 2e-4, rel=0.05, abs=2e-4)


def test_only_documents_out_of_reach_are_read_into_terms_again(spark, monkeypatch):
    rng = np.random.default_rng(8)
    rows = [(i, " ".join(f"w{x}" for x in rng.integers(0, 40, int(rng.integers(1, 60))))) for i in range(50)] + [(7, "again and again and"), (7, "again and again and"), (90, None)]
    df, read, counted = spark.createDataFrame(rows, "doc_id long, text string"), [], fingerprints.counted_words

    def seen(texts, keys):
        read.append({tuple(r) for r in texts.select("i", "again").collect()})
        return counted(texts, keys)

    monkeypatch.setattr(fingerprints, "counted_words", seen)
    monkeypatch.setattr(fingerprints, "LIKELY", 5.5)
    few = sorted(map(tuple, fingerprints.edited_report(df, samples=18).collect()), key=repr)
    assert len(read) == 2 and 0 < len(read[1]) < len(read[0]) and read[1] < read[0]
    monkeypatch.setattr(fingerprints, "LIKELY", 1e9)
    assert few == sorted(map(tuple, fingerprints.edited_report(df, samples=18).collect()), key=repr)
    copies = spark.createDataFrame([(1, 2, "a b a\n", "c", "d d")] * 2 + [(2, 1, "", "", "x")], "i long, copies long, both string, one string, other string")
    found = counted(copies, ["i"]).collect()
    weights = [sorted((r.w0, r.w1) for r in found if r.i == i) for i in (1, 2)]
    assert weights == [[(0, 0), (0, 2), (1, 0), (1, 1), (2, 2)], [(0, 0), (0, 1), (1, 0)]] and {(r.i, r.n) for r in found} == {(1, 4), (2, 1)}
