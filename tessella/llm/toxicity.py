"""Toxicity by a bidirectional gated recurrent network with attention pooling, in numpy.

Each word enters as a hashed word embedding beside the mean of hashed character n-gram
embeddings (byte trigrams with the word's ends marked, and prefixes of 4 and 5 bytes).
A text is scored as the highest score of its overlapping windows of ``WINDOW`` words, every
``STRIDE`` words, so all words of a text are read. Training takes a bounded sample of the
labelled rows (``sample`` rows at most, by a hash of the id) in one task; scoring runs over
Arrow batches.
"""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import written
from tessella.llm.shingles import _BYTE, _LOWER, _SPACE, chunks, mixed

WINDOW, STRIDE = 32, 24
WORD_BUCKETS, GRAM_BUCKETS, WORD_DIM, GRAM_DIM, HIDDEN = 1 << 15, 1 << 15, 8, 16, 8
SAMPLE_ROWS = 3000
#: Words that are hashed at once; only memory depends on it.
WORDS_AT_ONCE = 1 << 16
THRESHOLD = 0.3
_MARK = np.uint64(0xD6E8FEB86659FD93)
_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63], np.uint64)


class Words:
    """Words of some texts: an index into distinct words for each occurrence, where each
    text begins, and the hashed features of each distinct word."""

    def __init__(self, texts: list[bytes]):
        data = _LOWER[np.frombuffer(b" ".join(texts) + b" ", np.uint8)]
        ends = np.cumsum([len(t) + 1 for t in texts])
        solid = ~_SPACE[data]
        first = np.flatnonzero(solid & ~np.concatenate([[False], solid[:-1]]))
        last = np.flatnonzero(solid & ~np.concatenate([solid[1:], [False]]))
        size = last - first + 1
        self.begin = np.searchsorted(first, np.concatenate([[0], ends])).astype(np.int64)
        if not len(first):
            self.which, self.word, self.gram, self.gram_begin = (np.zeros(0, np.int64) for _ in range(4))
            self.n = 0
            return
        h = np.empty(len(first), np.uint64)
        for a in range(0, len(first), WORDS_AT_ONCE):
            own, n = first[a : a + WORDS_AT_ONCE], size[a : a + WORDS_AT_ONCE]
            begin = np.cumsum(n) - n
            place = np.arange(n.sum()) - np.repeat(begin, n)
            letters = _BYTE[data[np.repeat(own, n) + place]] * mixed(place.astype(np.uint64) + np.uint64(1))
            h[a : a + WORDS_AT_ONCE] = mixed(np.add.reduceat(letters, begin) + n.astype(np.uint64))
        _, at, self.which = np.unique(h, return_index=True, return_inverse=True)
        self.n = len(at)
        self.word = (h[at] % np.uint64(WORD_BUCKETS)).astype(np.int64)
        first, size = first[at], size[at]
        begin = np.cumsum(size) - size
        flat = np.repeat(first, size) + (np.arange(size.sum()) - np.repeat(begin, size))
        b = _BYTE[data[flat]]
        before, after = np.empty_like(b), np.empty_like(b)
        before[1:], after[:-1] = b[:-1], b[1:]
        before[begin], after[begin + size - 1] = _MARK, _MARK
        tri = mixed(before * _MIX[0] + b * _MIX[1] + after * _MIX[2])
        heads = []
        for k in (4, 5):
            take = np.minimum(size, k)
            near = np.repeat(begin, take) + (np.arange(take.sum()) - np.repeat(np.cumsum(take) - take, take))
            heads.append(mixed(np.add.reduceat(b[near] * _MIX[near - np.repeat(begin, take)], np.cumsum(take) - take) + np.uint64(k)))
        gram = np.insert(tri, np.repeat(begin, 2), np.stack(heads, 1).ravel())
        self.gram = (gram % np.uint64(GRAM_BUCKETS)).astype(np.int64)
        self.gram_begin = np.cumsum(size + 2) - (size + 2)
        self.gram_size = size + 2

    def windows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, first word, words) of every window; texts without words have none."""
        n = np.diff(self.begin)
        count = np.where(n > 0, np.maximum(1, -(-(n - WINDOW) // STRIDE) + 1), 0)
        text = np.repeat(np.arange(len(n)), count)
        nth = np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count)
        start = nth * STRIDE
        return text, self.begin[:-1][text] + start, np.minimum(WINDOW, n[text] - start)


def initial(seed: int) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    put = lambda *s: (rng.standard_normal(s) * 0.1).astype(np.float32)
    p = {"word": put(WORD_BUCKETS, WORD_DIM), "gram": put(GRAM_BUCKETS, GRAM_DIM), "att": put(2 * HIDDEN), "out": put(2 * HIDDEN), "bias": np.full(1, -2, np.float32)}
    for d in "fb":
        p |= {f"w{d}": put(WORD_DIM + GRAM_DIM, 3 * HIDDEN) * 3, f"u{d}": put(HIDDEN, 3 * HIDDEN) * 3, f"c{d}": np.zeros(3 * HIDDEN, np.float32)}
    return p


def _sig(x):
    return 0.5 * (1 + np.tanh(0.5 * x))


def embedded(p: dict, w: Words) -> np.ndarray:
    grams = np.add.reduceat(p["gram"][w.gram], w.gram_begin) / w.gram_size[:, None].astype(np.float32) if w.n else np.zeros((0, GRAM_DIM), np.float32)
    return np.concatenate([p["word"][w.word], grams], 1)


def _gru(x, mask, u, back, keep):
    """x: [steps, rows, 3H] inputs. The states of all steps, and what the way back needs."""
    steps, rows, _ = x.shape
    h, states, saved = np.zeros((rows, HIDDEN), np.float32), np.empty((steps, rows, HIDDEN), np.float32), []
    for t in reversed(range(steps)) if back else range(steps):
        g = h @ u
        zr = _sig(x[t, :, : 2 * HIDDEN] + g[:, : 2 * HIDDEN])
        z, r = zr[:, :HIDDEN], zr[:, HIDDEN:]
        n = np.tanh(x[t, :, 2 * HIDDEN :] + r * g[:, 2 * HIDDEN :])
        new = n + z * (h - n)
        if keep:
            saved.append((t, h, z, r, n, g[:, 2 * HIDDEN :]))
        h = np.where(mask[t][:, None], new, h)
        states[t] = h
    return states, saved


def forward(p: dict, emb: np.ndarray, index: np.ndarray, mask: np.ndarray, keep: bool = False):
    """index, mask: [steps, rows]. Probability of each row."""
    sides, saved = [], []
    for d in "fb":
        table = emb @ p[f"w{d}"] + p[f"c{d}"]
        s, v = _gru(table[index], mask, p[f"u{d}"], d == "b", keep)
        sides.append(s)
        saved.append(v)
    h = np.concatenate(sides, 2)
    a = np.where(mask, h @ p["att"], -1e9)
    a = np.exp(a - a.max(0))
    a /= a.sum(0)
    pooled = (a[:, :, None] * h).sum(0)
    prob = _sig(pooled @ p["out"] + p["bias"][0])
    return (prob, h, a, pooled, saved) if keep else prob


def _summed(at: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct places and the sums of the rows there."""
    order = np.argsort(at, kind="stable")
    rows, first = np.unique(at[order], return_index=True)
    return rows, np.add.reduceat(d[order], first, axis=0)


def _gradients(p, emb, index, mask, y, weight):
    prob, h, a, pooled, saved = forward(p, emb, index, mask, True)
    dl = ((prob - y) * weight / len(y)).astype(np.float32)
    g = {"out": pooled.T @ dl, "bias": dl.sum(keepdims=True)}
    dpool = dl[:, None] * p["out"]
    da = (h * dpool[None]).sum(2)
    ds = a * (da - (a * da).sum(0))
    dh = a[:, :, None] * dpool[None] + ds[:, :, None] * p["att"]
    g["att"] = (h * ds[:, :, None]).sum((0, 1))
    demb = np.zeros_like(emb)
    for k, d in enumerate("fb"):
        u = p[f"u{d}"]
        dx = np.zeros((*index.shape, 3 * HIDDEN), np.float32)
        gu, carry = np.zeros_like(u), np.zeros((index.shape[1], HIDDEN), np.float32)
        for t, was, z, r, n, un in reversed(saved[k]):
            total = dh[t, :, k * HIDDEN : (k + 1) * HIDDEN] + carry
            on = mask[t][:, None]
            live = np.where(on, total, 0)
            dn = live * (1 - z) * (1 - n * n)
            dz = live * (was - n) * z * (1 - z)
            dr = dn * un * r * (1 - r)
            dx[t] = np.concatenate([dz, dr, dn], 1)
            dg = np.concatenate([dz, dr, dn * r], 1)
            gu += was.T @ dg
            carry = np.where(on, live * z + dg @ u.T, total)
        flat = np.zeros((len(emb), 3 * HIDDEN), np.float32)
        rows, total = _summed(index.ravel(), dx.reshape(-1, 3 * HIDDEN))
        flat[rows] = total
        g[f"u{d}"], g[f"w{d}"], g[f"c{d}"] = gu, emb.T @ flat, flat.sum(0)
        demb += flat @ p[f"w{d}"].T
    return g, demb


def _laid(w: Words, start: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    steps = np.arange(WINDOW)[:, None]
    mask = steps < n[None]
    return w.which[np.minimum(start[None] + np.minimum(steps, np.maximum(n - 1, 0)[None]), len(w.which) - 1)], mask


def fit(texts: list[bytes], y: np.ndarray, seed: int = 7, epochs: int = 6, batch: int = 128, rate: float = 0.01) -> dict[str, np.ndarray]:
    """Train on texts with 0/1 labels.

    A label belongs to a text, not to a window: of a toxic text, training takes the window
    whose words lean most towards the toxic texts (first by the log odds of their features,
    halfway through by the network itself); of a clean one the worst such window and two others.
    """
    rng = np.random.default_rng(seed)
    p = initial(seed)
    w = Words(texts)
    if not len(w.which) or y.min() == y.max():
        p["out"][:] = 0
        rate_1 = float(np.clip(y.mean() if len(y) else 0, 1e-4, 1 - 1e-4))
        p["bias"][:] = np.log(rate_1 / (1 - rate_1))
        return p
    # In how many toxic and clean texts each feature is, some texts at a time.
    pos, neg = np.zeros(GRAM_BUCKETS, np.int64), np.zeros(GRAM_BUCKETS, np.int64)
    for text, first, end in zip(range(len(texts)), w.begin[:-1], w.begin[1:], strict=True):
        words = np.unique(w.which[first:end])
        size = w.gram_size[words]
        at = np.repeat(w.gram_begin[words] - np.cumsum(size) + size, size) + np.arange(size.sum())
        (pos if y[text] > 0 else neg)[np.unique(w.gram[at])] += 1
    flat = np.repeat(np.arange(w.n), w.gram_size)
    odds = np.where(pos > 1, np.log((pos + 0.5) / (y.sum() + 1)) - np.log((neg + 0.5) / ((1 - y).sum() + 1)), -9)
    lean = np.full(w.n, -9.0)
    np.maximum.at(lean, flat, odds[w.gram])
    text, start, n = w.windows()
    index, mask = _laid(w, start, n)

    def worst(score):
        order = np.lexsort((score, text))
        return order[np.append(text[order][1:] != text[order][:-1], True)]

    score = np.where(mask, lean[index], -9).max(0)
    m = {k: np.zeros_like(v) for k, v in p.items()}
    v2 = {k: np.zeros_like(v) for k, v in p.items()}
    step = 0
    for epoch in range(epochs):
        if epoch in (0, epochs // 2, epochs - 2):
            if epoch:
                emb = embedded(p, w)
                score = np.concatenate([forward(p, emb, index[:, i : i + 1024], mask[:, i : i + 1024]) for i in range(0, index.shape[1], 1024)])
            top = worst(score)
            clean = np.flatnonzero(y[text] == 0)
            chosen = np.unique(np.concatenate([top, rng.choice(clean, min(len(clean), 2 * len(texts)), replace=False)]))
        labels = y[text].astype(np.float32)
        share = max(1.0, np.sqrt((1 - labels[chosen]).sum() / max(1, labels[chosen].sum())))
        # Few windows go in smaller batches, for as many steps.
        for rows in np.array_split(rng.permutation(chosen), max(1, len(chosen) // max(8, min(batch, len(chosen) // 64)))):
            used, local = np.unique(index[:, rows], return_inverse=True)
            local = local.reshape(WINDOW, len(rows))
            part = Words.__new__(Words)
            part.n, part.word, part.gram_size = len(used), w.word[used], w.gram_size[used]
            part.gram_begin = np.cumsum(part.gram_size) - part.gram_size
            part.gram = w.gram[np.repeat(w.gram_begin[used], part.gram_size) + (np.arange(part.gram_size.sum()) - np.repeat(part.gram_begin, part.gram_size))]
            weight = np.where(labels[rows] > 0, share, 1).astype(np.float32)
            g, demb = _gradients(p, embedded(p, part), local, mask[:, rows], labels[rows], weight)
            step += 1
            fix = np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
            for k, d in g.items():
                m[k] += 0.1 * (d - m[k])
                v2[k] += 0.001 * (d * d - v2[k])
                p[k] -= (rate * fix * m[k] / (np.sqrt(v2[k]) + 1e-8)).astype(np.float32)
            grams = np.repeat(demb[:, WORD_DIM:] / part.gram_size[:, None].astype(np.float32), part.gram_size, axis=0)
            for k, at_, d in (("word", part.word, demb[:, :WORD_DIM]), ("gram", part.gram, grams)):
                rows_, total = _summed(at_, d)
                m[k][rows_] += 0.1 * (total - m[k][rows_])
                v2[k][rows_] += 0.001 * (total * total - v2[k][rows_])
                p[k][rows_] -= (rate * fix * m[k][rows_] / (np.sqrt(v2[k][rows_]) + 1e-8)).astype(np.float32)
    return p


def score_texts(p: dict, texts: list[bytes]) -> np.ndarray:
    """Highest window score of each text; 0 for texts without words."""
    out = np.zeros(len(texts))
    w = Words(texts)
    if not w.n:
        return out
    text, start, n = w.windows()
    emb = embedded(p, w)
    for i in range(0, len(text), 2048):
        index, mask = _laid(w, start[i : i + 2048], n[i : i + 2048])
        np.maximum.at(out, text[i : i + 2048], forward(p, emb, index, mask))
    return np.clip(out, 0, 1)


def held_out(doc_id: Column) -> Column:
    """The quarter of ids that training never sees."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", sample: int = SAMPLE_ROWS) -> bytes:
    """Fit on at most ``sample`` labelled rows that aren't held out, whole texts, in one
    task; the weights as bytes (of fixed size). Null labels are left out; of several texts
    of a doc_id that of the smallest hash (then the smallest) is used, null as empty."""
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.max(label).alias("__y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    rows = docs.select("doc_id", "text").join(written(known, "toxic-labels"), "doc_id").select("doc_id", "text", F.col("__y").cast("double").alias("__y"))
    text = F.coalesce("text", F.lit(""))
    rows = rows.groupBy("doc_id", "__y").agg(F.min(F.struct(F.xxhash64(text).alias("h"), text.alias("text"))).alias("r"))
    rows = written(rows.select("doc_id", "r.text", "__y"), "toxic-rows")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        df = pd.concat([pd.DataFrame({"doc_id": [], "text": [], "__y": []}), *batches])
        df = df.sort_values("doc_id")
        p = fit([(t or "").encode() for t in df["text"]], (df["__y"].to_numpy(float) > 0).astype(int))
        np.savez(out := io.BytesIO(), **p)
        yield pd.DataFrame({"weights": [out.getvalue()]})

    return bytes(written(rows.coalesce(1).mapInPandas(run, "weights binary"), "toxic-weights").first()[0]) if not rows.isEmpty() else _saved(fit([], np.zeros(0)))


def _saved(p: dict) -> bytes:
    np.savez(out := io.BytesIO(), **p)
    return out.getvalue()


def score(docs: DataFrame, weights: bytes, columns: list[str] | None = None, name: str = "score") -> DataFrame:
    """``docs(doc_id, text)`` -> ``doc_id, score``, or all of ``columns`` and the score, named
    ``name`` (which may not be among the columns). Null or empty text scores 0; long texts are
    read whole; every row gives one row, repeated rows the same; no rows give no rows."""
    columns = columns or ["doc_id"]
    chosen = docs.select(*columns, F.col("text").alias("__text"))
    schema = docs.select(*columns).schema.add(name, "double")
    held = docs.sparkSession.sparkContext.broadcast(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = dict(np.load(io.BytesIO(held.value)))
        for batch in batches:
            found = [score_texts(p, texts) for _, texts in chunks(batch.column(batch.num_columns - 1))]
            scores = np.concatenate(found) if found else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(scores)], [*columns, name])

    return chosen.mapInArrow(run, schema)


def toxicity(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE_ROWS) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every row of ``docs``. Only texts are
    inputs of a score; a null doc_id isn't held out. No rows give no rows."""
    out = score(docs, train(docs, labels, sample=sample))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE_ROWS) -> DataFrame:
    """Every row and column of ``docs`` that isn't predicted toxic, whatever the columns' names
    (but ``__score``). Repeated rows stay or go together; no rows give no rows."""
    scored = score(docs, train(docs, labels, sample=sample), docs.columns, "__score")
    return scored.where(F.col("__score") < THRESHOLD).select(docs.columns)
