"""SentencePiece encoding and decoding with N-best segmentation.

The piece lattice of a text falls apart at spaces (no piece has a space after another
character) and at characters that no piece holds, so each stretch between is a lattice of
its own. Forward Viterbi scores are the exact heuristic of a backward A* search; the
document's N best take other paths only in the stretches that lose least by it. Encoding
is lossless: the dummy space is undone, and characters outside the pieces, "▁" itself
included, become byte pieces.
"""

from __future__ import annotations

import heapq
import math
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.shingles import mixed

NBEST = 4
#: Stretches whose paths a task remembers, and characters of text that it handles at once;
#: only speed and memory depend on them.
CACHE, BATCH_CHARS = 100_000, 1_000_000
_STRETCH = re.compile(r"\n| *[^ \n]+| +")


class Pieces:
    """Scores, ids and bytes of a model's pieces."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.vocab_size()
        plain = [i for i in range(n) if not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i) or model.is_byte(i))]
        score = {i: model.get_score(i) for i in plain}
        if all(x == round(x) for x in score.values()):
            # Merge ranks, not log probabilities: those that Zipf's law gives the ranks.
            total = math.log(sum(1 / r for r in range(1, len(plain) + 1)))
            score = {i: -math.log(r) - total for r, i in enumerate(sorted(plain, key=lambda i: (-score[i], i)), 1)}
        self.score = {model.id_to_piece(i).replace("▁", " "): (score[i], i) for i in plain}
        self.byte_score = min(score.values()) - 10
        self.byte_id = {int(model.id_to_piece(i)[3:5], 16): i for i in range(n) if model.is_byte(i)}
        self.longest = max(map(len, self.score))
        self._index()
        self.bytes = {i: model.id_to_piece(i).replace("▁", " ").encode() for i in plain} | {i: bytes([b]) for b, i in self.byte_id.items()}

    def _index(self) -> None:
        """Hash tables of the pieces, for looking up many stretches at once: a second table
        holds what finds its place in the first taken."""
        self.power = np.cumprod(np.full(self.longest, 0x9E3779B97F4A7C15, np.uint64))
        found = list(self.score.items())
        self.piece_hash = np.zeros(len(found), np.uint64)
        size_of = np.array([len(p) for p, _ in found])
        for n in np.unique(size_of):
            at = np.flatnonzero(size_of == n)
            codes = np.array([[ord(c) for c in found[i][0]] for i in at], np.uint64)
            self.piece_hash[at] = self._hashes(codes)[-1][:, 0]
        self.piece_score = np.array([x[0] for _, x in found] + [-np.inf])
        self.piece_id = np.array([x[1] for _, x in found] + [-1], np.int32)
        size = 1 << 20
        self.tables, left = [], np.arange(len(found))
        while len(left):
            slots = (self.piece_hash[left] >> np.uint64(20 * len(self.tables))) & np.uint64(size - 1)
            _, first = np.unique(slots, return_index=True)
            table = np.full(size, len(found), np.int32)
            table[slots[first]] = left[first]
            self.tables.append(table)
            left = np.delete(left, first)
        self.piece_hash = np.append(self.piece_hash, np.uint64(0))

    def _hashes(self, codes: np.ndarray) -> list[np.ndarray]:
        """For each length from 1, the hashes of all runs of a matrix of code points."""
        c = mixed(codes + np.uint64(1))
        out, run = [], np.zeros_like(c)
        for k in range(min(self.longest, codes.shape[1])):
            run = run[:, : codes.shape[1] - k] + c[:, k:] * self.power[k]
            out.append(mixed(run + np.uint64(k)))
        return out

    def _found(self, h: np.ndarray) -> np.ndarray:
        """The piece that each hash names, or the place after the last. What lost its place in a
        table to another piece finds that one there, so only such hashes go on to the next."""
        none, flat = len(self.piece_hash) - 1, h.ravel()
        at = self.tables[0][flat & np.uint64((1 << 20) - 1)]
        open_ = np.flatnonzero(at != none)
        for k in range(len(self.tables)):
            if k:
                at[open_] = self.tables[k][(flat[open_] >> np.uint64(20 * k)) & np.uint64((1 << 20) - 1)]
            open_ = open_[self.piece_hash[at[open_]] != flat[open_]]
        at[open_] = none
        return at.reshape(h.shape)

    def best_many(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """``best`` of many stretches, those of one length side by side: all ids, how many each
        stretch has, scores and losses of the second-best."""
        total = len(words)
        parts: list = [None] * total
        scores, losses = np.zeros(total), np.zeros(total)
        groups: dict[int, list[int]] = {}
        for i, w in enumerate(words):
            groups.setdefault(len(w), []).append(i)
        alone = []
        for n, all_of in groups.items():
            for a in range(0, len(all_of), 4096):
                own = np.array(all_of[a : a + 4096])
                if n > 64 or len(own) < 4:
                    alone += own.tolist()
                    continue
                codes = np.frombuffer("".join([words[i] for i in own]).encode("utf-32-le"), np.uint32).reshape(-1, n).astype(np.uint64)
                which = [self._found(h).T for h in self._hashes(codes)]
                odd = (which[0] == len(self.piece_hash) - 1).any(0)
                score = [self.piece_score[w] for w in which]
                live = [s > -np.inf for s in score]
                some = [x.any(1) for x in live]
                ahead, via = np.full((n + 1, len(own)), -np.inf), np.zeros((n + 1, len(own)), np.int64)
                ahead[0] = 0
                for j in range(1, n + 1):
                    for k in range(min(j, self.longest) - 1, -1, -1):
                        if some[k][j - 1 - k]:
                            v = ahead[j - 1 - k] + score[k][j - 1 - k]
                            better = v > ahead[j]
                            ahead[j][better] = v[better]
                            via[j][better] = k
                behind = np.full((n + 1, len(own)), -np.inf)
                behind[n] = 0
                ids, used, end = np.zeros((len(own), n), np.int32), np.zeros(len(own), np.int64), np.full(len(own), n)
                on = np.full((n + 1, len(own)), -1)
                while (left := np.flatnonzero((end > 0) & ~odd)).size:
                    e, k = end[left], via[end[left], left]
                    start = e - 1 - k
                    on[start, left] = k
                    for m in np.unique(k):
                        part = left[k == m]
                        ids[part, n - 1 - used[part]] = self.piece_id[which[m][start[k == m], part]]
                    used[left] += 1
                    end[left] = start
                loss = np.full(len(own), np.inf)
                with np.errstate(invalid="ignore"):
                    for i in range(n - 1, -1, -1):
                        for k in range(min(n - i, self.longest)):
                            if some[k][i]:
                                v = score[k][i] + behind[i + 1 + k]
                                behind[i] = np.maximum(behind[i], v)
                                lost = ahead[n] - (ahead[i] + v)
                                np.fmin(loss, np.where(on[i] != k, lost, np.inf), out=loss)
                scores[own], losses[own] = ahead[n], np.maximum(loss, 0)
                for r, i in enumerate(own.tolist()):
                    parts[i] = ids[r, n - used[r] :]
                alone += own[odd].tolist()
        for i in alone:
            own_ids, scores[i], losses[i] = self.best(words[i])
            parts[i] = np.array(own_ids, np.int32)
        counts = np.fromiter(map(len, parts), np.int64, total)
        return np.concatenate([np.zeros(0, np.int32), *parts]), counts, scores, losses

    def edges(self, s: str) -> list[tuple[int, int, float, tuple[int, ...]]]:
        """The lattice of a stretch, by end: (start, end, score, ids)."""
        out, get, longest = [], self.score.get, self.longest
        for j in range(1, len(s) + 1):
            for i in range(max(0, j - longest), j):
                found = get(s[i:j])
                if found is not None:
                    out.append((i, j, found[0], (found[1],)))
                elif i == j - 1:
                    raw = s[i:j].encode()
                    out.append((i, j, self.byte_score * len(raw), tuple(self.byte_id[b] for b in raw)))
        return out

    def best(self, s: str):
        """(ids, score, loss of the second-best path, infinite if there is none)."""
        edges, n = self.edges(s), len(s)
        ahead, via = [0.0] + [-math.inf] * n, [None] * (n + 1)
        for e in edges:
            v = ahead[e[0]] + e[2]
            if v > ahead[e[1]]:
                ahead[e[1]], via[e[1]] = v, e
        behind = [-math.inf] * n + [0.0]
        loss, on = math.inf, set()
        at = n
        while at:
            on.add(id(via[at]))
            at = via[at][0]
        for e in reversed(edges):
            v = e[2] + behind[e[1]]
            if v > behind[e[0]]:
                behind[e[0]] = v
        for e in edges:
            if id(e) not in on:
                loss = min(loss, ahead[n] - (ahead[e[0]] + e[2] + behind[e[1]]))
        ids, at = [], n
        while at:
            ids.append(via[at][3])
            at = via[at][0]
        return tuple(x for part in reversed(ids) for x in part), ahead[n], max(loss, 0.0)

    def nbest(self, s: str, n: int) -> list[tuple[float, tuple[int, ...]]]:
        """The n best paths as (score, ids), best first: A* from the end, whose estimate of
        what is left is the forward Viterbi score, so paths leave the queue in order.

        What an edge costs is what it loses against the forward score of its end, so partial
        paths are ordered by score so far and exact estimate together; of equal ones the one
        nearest the start goes on. The n best paths hold the n best ways from a position to
        the end at most, so a position leaves the queue n times at most: the work grows with
        the edges, however many paths tie.
        """
        edges = self.edges(s)
        ahead = [0.0] + [-math.inf] * len(s)
        into: list[list] = [[] for _ in range(len(s) + 1)]
        for e in edges:
            v = ahead[e[0]] + e[2]
            if v > ahead[e[1]]:
                ahead[e[1]] = v
            into[e[1]].append((v, e[0], e[3]))
        out, queue, taken, tick = [], [(0.0, len(s), 0, None)], [0] * (len(s) + 1), count(1)
        while queue and len(out) < n:
            lost, at, _, path = heapq.heappop(queue)
            if taken[at] == n:
                continue
            taken[at] += 1
            if at == 0:
                ids = []
                while path:
                    ids += path[0]
                    path = path[1]
                out.append((ahead[-1] - lost, tuple(ids)))
                continue
            for v, i, own in into[at]:
                if taken[i] < n:
                    heapq.heappush(queue, (lost + ahead[at] - v, i, next(tick), (own, path)))
        return out


@lru_cache(2)
def load(path: str) -> Pieces:
    return Pieces(path)


class Encoder:
    """Encodes batches of texts; remembers the paths of the stretches it has met."""

    def __init__(self, path: str, nbest: int):
        self.pieces, self.nbest = load(path), nbest
        self._forget()

    def _forget(self) -> None:
        self.place: dict[str, int] = {}
        self.others: dict[str, list] = {}
        self.ids, self.begin, self.score, self.loss = np.zeros(0, np.int32), np.zeros(1, np.int64), np.zeros(0), np.zeros(0)

    def _learn(self, new: list[str]) -> None:
        ids, counts, score, loss = self.pieces.best_many(new)
        self.place.update(zip(new, range(len(self.score), len(self.score) + len(new)), strict=True))
        self.ids = np.concatenate([self.ids, ids])
        self.begin = np.concatenate([self.begin, self.begin[-1] + np.cumsum(counts)])
        self.score, self.loss = np.concatenate([self.score, score]), np.concatenate([self.loss, loss])

    def encode_all(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, list[list[float]], list[list]]:
        """All ids of some texts, where each text's begin (n + 1), and for each text the scores
        of its N best and their edits: an edit is (token, tokens replaced, ids put there), an
        alternative a list of edits. The paths of all new stretches are found together."""
        if len(self.place) >= CACHE:
            self._forget()
        stretches = [_STRETCH.findall(" " + t) if t else [] for t in texts]
        self._learn(list(set().union(*stretches).difference(self.place)))
        bounds = np.cumsum([0, *map(len, stretches)])
        at = np.fromiter((p for s in stretches for p in map(self.place.__getitem__, s)), np.int64, bounds[-1])
        counts = self.begin[at + 1] - self.begin[at]
        token = np.concatenate([[0], np.cumsum(counts)])
        ids = self.ids[np.repeat(self.begin[at] - token[:-1], counts) + np.arange(token[-1])]
        scores, loss = self.score[at], self.loss[at]
        best, edits = [], []
        for s, a, b in zip(stretches, bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            own = self._alternatives(s, loss[a:b], token[a : b + 1] - token[a])
            total = float(scores[a:b].sum())
            best.append([total - lost for lost, _ in own])
            edits.append([e for _, e in own])
        return ids, token[bounds], best, edits

    def _alternatives(self, stretches: list[str], loss: np.ndarray, token: np.ndarray) -> list[tuple[float, list]]:
        """(loss, edits) of the N best paths of a text. Those beyond the first take other paths
        only in the N - 1 stretches that lose least by it."""
        most = min(self.nbest - 1, len(loss))
        if not most:
            return [(0.0, [])]
        edge = np.partition(loss, most - 1)[most - 1]
        under = np.flatnonzero(loss < edge)
        open_ = [*under.tolist(), *np.flatnonzero(loss == edge)[: most - len(under)].tolist()]
        places = sorted(i for i in open_ if loss[i] < np.inf)
        for i in places:
            if stretches[i] not in self.others:
                found = self.pieces.nbest(stretches[i], self.nbest)
                self.others[stretches[i]] = [(found[0][0] - x[0], list(x[1])) for x in found]
        paths = [self.others[stretches[i]] for i in places]
        start = (0.0, (0,) * len(places))
        queue, seen, chosen = [start], {start[1]}, []
        while queue and len(chosen) < self.nbest:
            lost, pick = heapq.heappop(queue)
            chosen.append((lost, [(int(token[places[k]]), int(token[places[k] + 1] - token[places[k]]), paths[k][x][1]) for k, x in enumerate(pick) if x]))
            for k in range(len(places)):
                if pick[k] + 1 < len(paths[k]):
                    new = (*pick[:k], pick[k] + 1, *pick[k + 1 :])
                    if new not in seen:
                        seen.add(new)
                        heapq.heappush(queue, (math.fsum(paths[m][x][0] for m, x in enumerate(new)), new))
        return chosen


_EDIT = pa.struct([("at", pa.int32()), ("n", pa.int32()), ("ids", pa.list_(pa.int32()))])


def _lists(values: list) -> tuple[pa.Array, list]:
    """Offsets of the lists of a list, and all that they hold."""
    return pa.array(np.cumsum([0, *map(len, values)]).astype(np.int32)), [x for v in values for x in v]


def encode(docs: DataFrame, model: str, nbest: int = NBEST, columns: list[str] | None = None) -> DataFrame:
    """``docs(*columns, text)`` -> ``*columns, ids array<int>, scores array<double>,
    edits array<array<struct<at, n, ids>>>``: the best path, and for each of the N best its
    score and how it differs from the best (the first not at all).

    Null or empty text has no ids and one path of score 0. Every row gives one row, repeated
    rows the same. Texts are read whole; work and memory grow with a text's length, whatever
    it holds. ``columns`` may not be named ``ids``, ``scores`` or ``edits`` (an error); other
    columns are ignored; no rows give no rows. ``model`` is the path of a model file on every
    machine. Of a model that holds merge ranks the lattice takes the log probabilities that
    Zipf's law gives the ranks, so the best path isn't that model's own order of merges.
    """
    columns = columns or ["doc_id"]
    if clash := {"ids", "scores", "edits"}.intersection(columns):
        raise ValueError(f"columns named as results: {sorted(clash)}")
    chosen = docs.select(*columns, F.col("text").alias("__text"))
    schema = docs.sparkSession.range(0).selectExpr("cast(null as array<int>) ids", "cast(null as array<double>) scores", "cast(null as array<array<struct<at: int, n: int, ids: array<int>>>>) edits").schema
    for field in reversed(docs.select(*columns).schema.fields):
        schema.fields.insert(0, field)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(model, nbest)
        for batch in batches:
            for at, texts in text_chunks(batch.column(batch.num_columns - 1)):
                ids, begin, best, edits = encoder.encode_all(texts)
                of_best, scores = _lists(best)
                of_edits, paths = _lists(edits)
                of_paths, changes = _lists(paths)
                of_ids, put = _lists([e[2] for e in changes])
                changed = pa.StructArray.from_arrays([pa.array([e[0] for e in changes], pa.int32()), pa.array([e[1] for e in changes], pa.int32()), pa.ListArray.from_arrays(of_ids, pa.array(put, pa.int32()))], fields=list(_EDIT))
                found = [
                    pa.ListArray.from_arrays(pa.array(begin.astype(np.int32)), pa.array(ids)),
                    pa.ListArray.from_arrays(of_best, pa.array(scores, pa.float64())),
                    pa.ListArray.from_arrays(of_edits, pa.ListArray.from_arrays(of_paths, changed)),
                ]
                yield pa.RecordBatch.from_arrays([*(c.slice(at, len(texts)) for c in batch.columns[:-1]), *found], [*columns, "ids", "scores", "edits"])

    return chosen.mapInArrow(run, schema)


def text_chunks(column: pa.Array) -> Iterator[tuple[int, list[str]]]:
    """A column of texts as (first row, texts) of about BATCH_CHARS; null is empty."""
    start, size, part = 0, 0, []
    for i, t in enumerate(column):
        part.append(t.as_py() or "")
        size += len(part[-1])
        if size >= BATCH_CHARS:
            yield start, part
            start, size, part = i + 1, 0, []
    if part:
        yield start, part


def alternative(ids, edits) -> F.Column:
    """The ids of one of the N best: the best's with the edits applied."""
    step = lambda acc, e: F.struct(
        F.concat(acc["out"], F.slice(ids, acc["at"] + 1, e["at"] - acc["at"]), e["ids"]).alias("out"), (e["at"] + e["n"]).alias("at")
    )
    start = F.struct(F.array().cast("array<int>").alias("out"), F.lit(0).alias("at"))
    return F.aggregate(edits, start, step, lambda acc: F.concat(acc["out"], F.slice(ids, acc["at"] + 1, F.size(ids))))


def decode(rows: DataFrame, model: str, columns: list[str], ids: str = "ids") -> DataFrame:
    """``*columns, text``: the texts that ids stand for; null ids give null."""
    schema = rows.select(*columns).schema.add("text", "string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw = load(model).bytes
        parts = [raw.get(i, b"") for i in range(max(raw) + 1)]
        for batch in batches:
            last = batch.column(batch.num_columns - 1)
            texts = [None if not x.is_valid else b"".join(map(parts.__getitem__, x.values.to_numpy().tolist())).decode("utf-8", "replace")[1:] for x in last]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(texts, pa.string())], [*columns, "text"])

    return rows.select(*columns, F.col(ids).alias("__ids")).mapInArrow(run, schema)


def default_model() -> str:
    """The public 32k model of the installed tokenizer files."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")
