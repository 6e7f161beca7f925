"""The registered queries of the package, over the smallest tables, against SQL or plain loops."""

import collections
import hashlib
import io
import json
import re

import duckdb
import numpy as np
import pytest
import regex
from pyspark.sql import functions as F

import corpus_pipeline
from tessella.llm import licenses, mixing, pieces, secrets, toxicity
from tessella.llm.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
TABLES = ("documents", "embeddings", "pages", "conversations", "labels", "benchmark")


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


@pytest.fixture(scope="session")
def texts(duck):
    return {i: t or "" for i, t in duck.execute("select doc_id, text from documents").fetchall()}


def rows(spark, name):
    return {r[0]: r for r in QUERIES[name](spark, SF).collect()}


def plain(value):
    return f"{value:.9g}" if isinstance(value, float) else str(value)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_gives_the_rows_of_its_sql(spark, duck, name):
    df, want = QUERIES[name](spark, SF), duck.execute(ORACLE_SQL[name])
    names = [d[0] for d in want.description]
    assert sorted(df.columns) == sorted(names)
    got = sorted(tuple(plain(r[n]) for n in names) for r in df.collect())
    assert got == sorted(tuple(map(plain, r)) for r in want.fetchall())


def test_mixing_takes_by_the_order_of_hashes(spark, duck):
    got = rows(spark, "op1_mix_sources")
    docs = duck.execute("select doc_id, source, text from documents").fetchall()
    size = {i: len(WORD.findall(t or "")) for i, _, t in docs}
    sources = sorted({s for _, s, _ in docs}, key=lambda s: (s is None, s or ""))
    total = {s: sum(size[i] for i, x, _ in docs if x == s) for s in sources}
    weight = {s: (5, 2, 1)[n % 3] for n, s in enumerate(sources)}
    target, free, left = {}, set(sources), sum(size.values())
    while free:
        level = left / sum(weight[s] for s in free)
        over = {s for s in free if level * weight[s] > 3 * total[s]}
        target |= {s: 3.0 * total[s] if s in over else level * weight[s] for s in (over or free)}
        left -= sum(target[s] for s in over)
        free = free - over if over else set()
    order = {r.doc_id: r.h for r in spark.createDataFrame([(i,) for i in size], "doc_id long").select("doc_id", F.shiftrightunsigned(F.xxhash64(F.lit(42), "doc_id"), 1).alias("h")).collect()}
    for s in sources:
        own = sorted((i for i, x, _ in docs if x == s and size[i]), key=order.get)
        whole, taken = int(target[s] // total[s]) if total[s] else 0, {}
        need = target[s] - whole * total[s]
        for i in own:
            more = min(size[i], max(0.0, need))
            taken[i] = whole * size[i] + int(more + 1e-6)
            need -= size[i]
        for i in (i for i, x, _ in docs if x == s):
            assert (got[i].size, got[i].source_size, got[i].taken) == (size[i], total[s], taken.get(i, 0))
            assert got[i].target == pytest.approx(target[s]) and got[i].taken <= 3 * size[i]


def canonical(line):
    text = regex.sub(r"[^\p{L}\p{N}©]+", " ", line.lower()).strip(" ")
    for old, new in licenses.SPELLINGS:
        text = text.replace(old, new)
    if regex.search(r"^(?:copyright (?:c |©|[0-9]|by )|c [0-9]{4}|©|all rights reserved$)", text) or regex.search(licenses.HOLDER.replace(r"\p{Punct}", r"!-/:-@\[-`{-~"), line):
        return ""
    return text.replace("©", "").strip(" ")


def test_license_scan_against_plain_digests(spark, texts):
    lines = lambda t: [x for x in map(canonical, re.split("\r\n|\r|\n", t)) if x]
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    known = {}
    for name in sorted({*licenses.KNOWN, *licenses.LAYOUTS}, reverse=True):
        known |= {sha(" ".join(lines(form))): name for form in licenses.usual_forms(name)}
    known.pop(sha(""), None)
    got = rows(spark, "op2_license_scan")
    assert set(got) == set(texts)
    for i, t in texts.items():
        own = lines(t)
        found = sorted({known[d] for d in map(sha, own) if d in known})
        assert (got[i].text_digest, got[i].license_id, got[i].line_licenses) == (sha(" ".join(own)), known.get(sha(" ".join(own))), ",".join(found))


def test_fingerprints_estimate_the_similarity(spark, texts):
    got, order = rows(spark, "op5_fingerprints"), sorted(texts, reverse=True)
    off = []
    for n, i in enumerate(order):
        t, after = texts[i], texts[order[(n + 1) % len(order)]]
        cut = len(t) // 3
        edited = t[: len(t) - cut] + after[:cut]
        assert got[i].n_chars == len(t) and got[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        for other, near in ((edited, got[i].near_edited), (after, got[i].near_next)):
            a, b = (collections.Counter(WORD.findall(x)) for x in (t, other))
            off.append(near - (sum((a & b).values()) / sum((a | b).values()) if a or b else 1.0))
    assert np.abs(off).max() < 0.4 and np.abs(off).mean() < 0.07 and abs(np.mean(off)) < 0.02
    prints = collections.defaultdict(set)
    for i, t in texts.items():
        prints[t].add(got[i].fingerprint)
    assert {len(x) for x in prints.values()} == {1}


def test_pieces_have_the_best_score_and_come_back(spark, texts):
    p = pieces.load(pieces.default_model())
    for i, r in rows(spark, "op6_sentencepiece").items():
        parts = [p.best(s) for s in pieces._STRETCH.findall(" " + texts[i])] if texts[i] else []
        ids = [x for part in parts for x in part[0]]
        assert r.round_trip and r.n_tokens == len(ids)
        assert float(r.best_scores.split(";")[0]) == pytest.approx(sum(x[1] for x in parts), abs=2e-6)
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest() and json.loads(r.edits)[0] == []


def spans_by_loops(text):
    base = [(m.start(), m.end(), "assign") for m in re.finditer(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text, re.ASCII | re.IGNORECASE) if len(m[2]) >= 6]
    base += [(m.start(), m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    base += [(m.start(), m.end(), "hex") for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    weak = [(m.start(), m.end(), "key") for m in secrets._KEY.finditer(text)] + [(m.start(), m.end(), "endpoint") for m in secrets._ENDPOINT.finditer(text)]
    parts = base + (weak if any(k == "access" for *_, k in base) else [])
    near = lambda s, *kinds: any(abs(x[0] - s[0]) <= secrets.SCOPE and x[2] in kinds for x in parts)
    linked = [s for s in parts if s[2] in ("assign", "access", "hex") or (near(s, "access") and (s[2] == "key" or near(s, "assign", "key", "hex")))]
    text_of = lambda spans: ",".join(f"{k}:{a}:{b}" for a, b, k in sorted(spans, key=lambda s: (s[0], secrets.KINDS.index(s[2]))))
    return collections.Counter(k for *_, k in base), text_of(base), text_of(linked)


def test_secrets_against_loops(spark, texts):
    for i, r in rows(spark, "op8_secret_scan").items():
        n, base, linked = spans_by_loops(texts[i])
        assert (r.n_assign, r.n_access, r.n_hex, r.base_sha256, r.spans) == (n["assign"], n["access"], n["hex"], hashlib.sha256(base.encode()).hexdigest(), linked)


def components_by_loops(texts, width, hundred):
    sets = {}
    for i, t in texts.items():
        w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t))
        sets[i] = {tuple(w[k : k + width]) for k in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set()
    ids, comp = sorted(sets), {}
    linked = collections.defaultdict(list)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= hundred * (len(sets[a]) + len(sets[b]) - both):
                linked[a].append(b)
                linked[b].append(a)
    for i in ids:
        front = [i] if i not in comp else []
        while front:
            x = front.pop()
            if x not in comp:
                comp[x] = i
                front += linked[x]
    return comp, {i: len(s) for i, s in sets.items()}


def test_near_duplicates_against_all_pairs(spark, texts):
    comp, size = components_by_loops(texts, 3, 85)
    got = rows(spark, "op9_near_duplicates")
    assert {i: (r.n_shingles, r.component_id, r.kept) for i, r in got.items()} == {i: (size[i], comp[i], comp[i] == i) for i in texts}


def test_toxicity_scores_every_window(spark, texts):
    """The query's scores are the highest of windows that are scored one at a time."""
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    p = dict(np.load(io.BytesIO(toxicity.train(docs, labels))))
    got = rows(spark, "op10_toxicity")
    for i in sorted(texts)[::4]:
        words, best = WORD.findall(texts[i]), 0.0
        at = 0
        while words:
            w = toxicity.Words([" ".join(words[at : at + toxicity.WINDOW]).encode()])
            best = max(best, float(toxicity.forward(p, toxicity.embedded(p, w), w.which[:, None], np.ones((len(w.which), 1), bool))[0]))
            if at + toxicity.WINDOW >= len(words):
                break
            at += toxicity.STRIDE
        assert got[i].score == pytest.approx(best, abs=1e-3)
    for i, r in got.items():
        assert r.predicted == int(r.score >= 0.3) and r.held_out == (__import__("zlib").crc32(str(i).encode()) % 4 == 2)


def test_pipeline_stage_by_stage(spark, texts):
    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumns({"score": F.lit(1), "ids": F.lit("x"), "n": F.lit(2)})
    names, kept = [n for n, _ in corpus_pipeline.STAGES], {}
    assert names == ["toxicity", "near_duplicates", "secrets", "mixing", "sentencepiece"]
    base = spark.read.parquet(f"{SF}/documents.parquet").columns
    for name, stage in corpus_pipeline.STAGES:
        extra = docs if name in ("toxicity", "near_duplicates") else docs.select(base)
        out = stage(spark, extra, SF)
        if name != "sentencepiece":
            assert out.columns == extra.columns
        path = corpus_pipeline.written(out, f"test-{name}")
        kept[name] = path.collect()
        docs = path
    scores = {i: r.score for i, r in rows(spark, "op10_toxicity").items()}
    clean = {i for i in texts if scores[i] < toxicity.THRESHOLD}
    assert {r.doc_id for r in kept["toxicity"]} == clean
    comp, _ = components_by_loops({i: texts[i] for i in clean}, 5, 80)
    assert {r.doc_id for r in kept["near_duplicates"]} == {i for i in comp if comp[i] == i}
    masked = {r.doc_id: r.text for r in kept["secrets"]}
    for i, t in masked.items():
        _, _, spans = spans_by_loops(texts[i])
        assert (t == texts[i]) == (not spans)
        assert not re.search("AKIA[A-Z0-9]{16}", t or "")
    before = {r.doc_id: r.source for r in kept["secrets"]}
    sizes = collections.Counter()
    for r in kept["mixing"]:
        sizes[r.source] += len(WORD.findall(r.text or ""))
        assert before[r.doc_id] == r.source and masked[r.doc_id].startswith(r.text)
    target = {r.source: r.target for r in mixing.mix_report(spark.createDataFrame([(i, before[i], t) for i, t in masked.items()], "doc_id long, source string, text string")).collect()}
    assert all(abs(sizes[s] - target[s]) <= 1 for s in target)
    want = collections.Counter((r.doc_id, r.text) for r in kept["mixing"])
    back = pieces.decode(docs.select("doc_id", "ids"), pieces.default_model(), ["doc_id"]).collect()
    assert collections.Counter((r.doc_id, r.text) for r in back) == want


def test_stages_on_empty_tables(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SF).isEmpty()
