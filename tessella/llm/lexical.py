"""Ranked lexical search: documents of a shard in an FP-tree, branch and bound per item.

Texts are cut into terms once; of each document only the terms that occur in some item
stay, as (term, count), beside its length ``m``. Documents and items are dealt to a grid of
shards and blocks of items. A task orders each document's terms by falling document
frequency (rising weight), so that documents share the paths of a trie, whose nodes keep
the largest count of each term below them and the smallest ``m``. As a score rises with
counts and falls with ``m``, these bound every document below a node: the search goes
depth-first into the child of the highest bound and leaves out what can't reach the k-th
score found. Small subtrees end in a leaf, whose documents are scored exactly. The best of
all shards merge by rank.
"""

from __future__ import annotations

import heapq
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tessella.llm.common import numbered, written

#: What ends a term: ASCII without digits and letters. Only A-Z become a-z.
APART = bytes([*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)])
LETTERS = bytes(range(0x41, 0x5B))
TO_TERMS = bytes.maketrans(APART + LETTERS, b" " * len(APART) + LETTERS.lower())

#: Terms (and their bytes) up to which tasks look terms up themselves; beyond, Spark joins.
LOOKED_UP, LOOKED_UP_BYTES = 500_000, 16_000_000
#: Counts and documents in a shard, items in a block, documents in a leaf.
SHARD_COUNTS, SHARD_DOCS, ITEM_BLOCK, LEAF = 1_000_000, 16_384, 1024, 24


def terms_of(text: bytes) -> list[bytes]:
    return text.translate(TO_TERMS).split()


def _count(df: DataFrame, id_col: str, text_col: str, vocabulary: dict[bytes, int] | None) -> DataFrame:
    """``id, n, terms, counts`` of each row: all its terms with repeats, and its different terms,
    as numbers where a vocabulary is given, which then leaves out the others."""
    kind = pa.binary() if vocabulary is None else pa.int64()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths, ends, terms, counts = [], [0], [], []
            for text in batch.column(1).cast(pa.binary()):
                words = terms_of(text.as_py() or b"")
                lengths.append(len(words))
                of = Counter(words if vocabulary is None else map(vocabulary.get, words))
                of.pop(None, None)
                terms += of.keys()
                counts += of.values()
                ends.append(len(terms))
            ends = pa.array(ends, pa.int32())
            lists = [pa.ListArray.from_arrays(ends, pa.array(x, t)) for x, t in ((terms, kind), (counts, pa.int64()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lengths, pa.int64()), *lists], ["id", "n", "terms", "counts"])

    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(count, f"id long, n long, terms array<{'binary' if vocabulary is None else 'long'}>, counts array<long>")


def _restricted(documents: DataFrame, vocabulary: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``id, n, terms array<long>, counts`` of every document, with terms of ``vocabulary(term,
    number)`` only."""
    size = vocabulary.agg(F.count("*"), F.coalesce(F.sum(F.length("term")), F.lit(0))).first()
    if size[0] <= LOOKED_UP and size[1] <= LOOKED_UP_BYTES:
        known = {bytes(r.term): r.number for r in vocabulary.collect()}
        return written(_count(documents, id_col, text_col, known), "lexical-vectors")
    rows = written(_count(documents, id_col, text_col, None).withColumn("row", F.monotonically_increasing_id()), "lexical-terms")
    pairs = rows.select("row", F.explode(F.arrays_zip("terms", "counts")).alias("p")).select("row", F.col("p.terms").alias("term"), "p.counts")
    own = pairs.join(vocabulary, "term").groupBy("row").agg(F.collect_list(F.struct("number", "counts")).alias("p"))
    none = F.array().cast("array<long>")
    joined = rows.select("row", "id", "n").join(own, "row", "left")
    return written(joined.select("id", "n", F.coalesce("p.number", none).alias("terms"), F.coalesce("p.counts", none).alias("counts")), "lexical-vectors")


class Trie:
    """Documents in the order of their terms (numbers by falling document frequency), with
    counts, and the nodes over them. ``starts`` bounds the terms of each document, one at least."""

    def __init__(self, starts: np.ndarray, terms: np.ndarray, counts: np.ndarray, m: np.ndarray, leaf: int = LEAF):
        keys = [terms[a:b].astype(">u4").tobytes() for a, b in zip(starts, starts[1:])]
        self.docs = np.array(sorted(range(len(m)), key=keys.__getitem__), dtype=np.int64)
        length = np.diff(starts)[self.docs]
        self.starts = np.concatenate([[0], np.cumsum(length)])
        at = np.repeat(starts[self.docs] - self.starts[:-1], length) + np.arange(self.starts[-1])
        self.terms, self.counts, self.m = terms[at], counts[at], m[self.docs]
        self.gains = share(self.counts, np.repeat(self.m, length))
        self._split(length, leaf)
        self._maxima()

    def _split(self, length: np.ndarray, leaf: int) -> None:
        """Nodes as ranges of documents. Children cut their parent's range where the term after
        the common path changes; neighbouring children of few documents make one leaf."""
        self.low, self.high, self.parent, self.children = [0], [len(self.m)], [-1], [[]]
        work = [0] if len(self.m) > leaf else []
        while work:
            node = work.pop()
            lo, hi = self.low[node], self.high[node]
            first, last = (self.terms[self.starts[i] : self.starts[i + 1]] for i in (lo, hi - 1))
            both = min(len(first), len(last))
            differ = np.flatnonzero(first[:both] != last[:both])
            depth = int(differ[0]) if len(differ) else both  # sorted: what these two share, all share
            longer = length[lo:hi] > depth
            nxt = np.where(longer, self.terms[np.minimum(self.starts[lo:hi] + depth, max(0, len(self.terms) - 1))], -1) if len(self.terms) else np.full(hi - lo, -1)
            cuts = [lo, *(lo + 1 + np.flatnonzero(nxt[1:] != nxt[:-1])).tolist(), hi]
            if len(cuts) == 2:  # equal terms: no further branch
                continue
            begin = lo
            for a, b in zip(cuts, cuts[1:]):
                if b - a > leaf or b - begin > leaf:
                    if begin < a:
                        self._add(node, begin, a)
                    begin = a
                if b - a > leaf:
                    work.append(self._add(node, a, b))
                    begin = b
            if begin < hi:
                self._add(node, begin, hi)

    def _add(self, parent: int, lo: int, hi: int) -> int:
        node = len(self.low)
        self.low.append(lo), self.high.append(hi), self.parent.append(parent), self.children.append([])
        self.children[parent].append(node)
        return node

    def _maxima(self) -> None:
        """For each node the largest count of every term below, as (term, node, best share of the
        score), and its smallest m: leaves first, then level by level up."""
        n = len(self.low)
        level, parent = np.zeros(n, np.int64), np.array(self.parent)
        for node in range(1, n):
            level[node] = level[self.parent[node]] + 1
        self.m_min = np.full(n, np.iinfo(np.int64).max)
        leaves = [i for i in range(n) if not self.children[i] and self.high[i] > self.low[i]]
        owner = np.zeros(len(self.m), np.int64)
        for i in leaves:
            owner[self.low[i] : self.high[i]] = i
        if len(self.m):
            np.minimum.at(self.m_min, owner, self.m)
        node, term, count = _largest(np.repeat(owner, np.diff(self.starts)), self.terms, self.counts)
        deepest = int(level.max(initial=0))
        waiting = [tuple(x[level[node] == deep] for x in (node, term, count)) for deep in range(deepest + 1)]
        for deep in range(deepest, 0, -1):
            own = np.flatnonzero(level == deep)
            np.minimum.at(self.m_min, parent[own], self.m_min[own])
            (node, term, count), above = waiting[deep], waiting[deep - 1]
            waiting[deep - 1] = _largest(*(np.concatenate(x) for x in zip(above, (parent[node], term, count))))
        node, term, count = (np.concatenate(x) for x in zip(*waiting))
        order = np.lexsort((node, term))
        self.at_node, term, count = node[order], term[order], count[order]
        self.best = share(count, self.m_min[self.at_node])
        self.from_term = np.searchsorted(term, np.arange(int(term.max(initial=-1)) + 2))

    def search(self, terms: np.ndarray, weights: np.ndarray, k: int, ids: np.ndarray) -> list[tuple[int, int]]:
        """``(score, document)`` of the k highest scores above 0, ties to the smaller of ``ids``."""
        held = terms < len(self.from_term) - 1
        terms, weights = terms[held], weights[held]
        bounds, weigh = np.zeros(len(self.low), np.int64), np.zeros(len(self.from_term), np.int64)
        weigh[terms] = weights
        for t, w in zip(terms.tolist(), weights.tolist()):
            s = slice(self.from_term[t], self.from_term[t + 1])
            bounds[self.at_node[s]] += w * self.best[s]
        found: list[tuple[int, int, int]] = []
        stack = [0]
        while stack:
            node = stack.pop()
            if bounds[node] <= 0 or len(found) == k and bounds[node] < found[0][0]:
                continue
            if self.children[node]:
                own = self.children[node]
                stack += [own[i] for i in np.argsort(bounds[own], kind="stable")]
                continue
            a, b = self.low[node], self.high[node]
            s = slice(self.starts[a], self.starts[b])
            scores = np.add.reduceat(weigh[self.terms[s]] * self.gains[s], self.starts[a:b] - s.start)
            for i in np.flatnonzero(scores >= max(1, found[0][0] if len(found) == k else 1)):
                one = (int(scores[i]), -int(ids[self.docs[a + i]]), int(self.docs[a + i]))
                if len(found) < k:
                    heapq.heappush(found, one)
                elif one > found[0]:
                    heapq.heapreplace(found, one)
        return [(score, doc) for score, _, doc in found]


def share(count: np.ndarray, m: np.ndarray) -> np.ndarray:
    """What a term of weight 1 adds to a score: rises with its count, falls with m."""
    return (1_000_000_000 * count) // (1000 * count + 8 * m)


def _largest(node: np.ndarray, term: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One row for each (node, term), with the largest count."""
    if not len(node):
        return node, term, count
    key = node * (int(term.max()) + 1) + term
    order = np.argsort(key, kind="stable")
    key = key[order]
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    return node[order][first], term[order][first], np.maximum.reduceat(count[order], first)


def _flat(lists: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bounds and values of a column of lists."""
    arrays = [a for a in lists.chunks if len(a)]
    sizes = [np.diff(a.offsets.to_numpy()) for a in arrays]
    values = [a.flatten().to_numpy(zero_copy_only=False) for a in arrays]
    return np.concatenate([[0], np.cumsum(np.concatenate(sizes))]) if sizes else np.zeros(1, np.int64), np.concatenate(values) if values else np.zeros(0, np.int64)


def _searcher(k: int):
    def search(rows: pa.Table) -> pa.Table:
        asks = rows.column("asks").to_numpy()
        items, docs = rows.filter(pa.array(asks)), rows.filter(pa.array(~asks))
        (i_starts, i_terms), (_, i_weights) = _flat(items["terms"]), _flat(items["values"])
        (starts, terms), (_, counts) = _flat(docs["terms"]), _flat(docs["values"])
        # Numbers by falling document frequency: a lower weight is a more frequent term.
        distinct, first = np.unique(i_terms, return_index=True)
        order = np.lexsort((distinct, i_weights[first]))
        number = np.empty(len(distinct), np.int64)
        number[order] = np.arange(len(distinct))
        place = np.minimum(np.searchsorted(distinct, terms), max(0, len(distinct) - 1))
        keep = distinct[place] == terms if len(distinct) else np.zeros(len(terms), bool)
        owner = np.repeat(np.arange(len(starts) - 1), np.diff(starts))[keep]
        terms, counts = number[place[keep]], counts[keep]
        by = np.lexsort((terms, owner))
        some, n = np.unique(owner, return_counts=True)  # documents with a term of these items
        docs = docs.take(pa.array(some))
        trie = Trie(np.concatenate([[0], np.cumsum(n)]), terms[by], counts[by], docs["m"].to_numpy())
        ids = docs["id"].fill_null(np.iinfo(np.int64).max).to_numpy()
        found = [(i, doc, score) for i, (a, b) in enumerate(zip(i_starts, i_starts[1:])) for score, doc in trie.search(number[np.searchsorted(distinct, i_terms[a:b])], i_weights[a:b], k, ids)]
        item, doc, score = (pa.array([f[x] for f in found], pa.int64()) for x in range(3))
        return pa.table({"item_id": items["id"].take(item), "doc_id": docs["id"].take(doc), "score": score})

    return search


def ranked(documents: DataFrame, items: DataFrame, k: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """``item_id, rank, doc_id, score``: for each item the k documents of highest score above 0,
    ties to the smaller id.

    Terms are runs of ASCII digits and letters (A-Z lower-cased) and of all other characters
    beyond ASCII. With N documents that hold a term, L terms in all, ``df`` documents that hold
    a term, ``tf`` of it among the ``n`` terms of a document and m = 10 + (90 n N) div L, a score
    is the sum over the item's different terms of
    ``floor(1000 ln((2 N + 2) / (2 df + 1))) * ((1000000000 tf) div (1000 tf + 8 m))``.

    Null and empty texts hold no term. Document rows of null or repeated ids are documents of
    their own, null ids last in a tie; item rows that share an id (or null) are one item with
    the terms of all. Items whose terms no document holds have no rows. Other columns are
    ignored. Ids are taken as longs.
    """
    asked = written(_count(items, item_col, item_text, None).select("id", F.explode("terms").alias("term")).distinct(), "lexical-items")
    vocabulary = written(numbered(asked.select("term").distinct(), [F.col("term")], "number"), "lexical-vocabulary")
    vectors = _restricted(documents, vocabulary, id_col, text_col)
    total = vectors.agg(F.count_if(F.col("n") > 0).alias("N"), F.coalesce(F.sum("n"), F.lit(0)).alias("L"), F.coalesce(F.sum(F.size("terms")), F.lit(0)).alias("held"), F.count_if(F.size("terms") > 0).alias("rows")).first()
    df = vectors.select(F.explode("terms").alias("number")).groupBy("number").count()
    weight = F.floor(1000 * F.log(F.lit(2.0 * total.N + 2) / (2 * F.col("count") + 1))).cast("long").alias("w")
    weights = vocabulary.join(df, "number").select("term", "number", weight).where("w > 0")
    wanted = written(asked.join(weights, "term").groupBy("id").agg(F.sort_array(F.collect_list(F.struct("number", "w"))).alias("p")).select("id", F.col("p.number").alias("terms"), F.col("p.w").alias("values")), "lexical-weights")

    shards = max(1, -(-total.held // SHARD_COUNTS), -(-total.rows // SHARD_DOCS))
    blocks = max(1, -(-wanted.count() // ITEM_BLOCK))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    dealt = lambda n, *by: F.pmod(F.xxhash64(*by), F.lit(n)).cast("int")
    m = F.lit(10).cast("long") + F.expr(f"(90 * cast(n AS DECIMAL(20,0)) * {total.N}) div {max(1, total.L)}")
    docs = vectors.where(F.size("terms") > 0).select(F.lit(False).alias("asks"), "id", "terms", F.col("counts").alias("values"), m.alias("m"), dealt(shards, "id", "n", "terms", "counts").alias("shard"), every(blocks).alias("block"))
    ask = wanted.select(F.lit(True).alias("asks"), "id", "terms", "values", F.lit(0).cast("long").alias("m"), every(shards).alias("shard"), dealt(blocks, "id").alias("block"))
    return best_of_item(docs.unionByName(ask).groupBy("block", "shard").applyInArrow(_searcher(k), "item_id long, doc_id long, score long"), k)


def best_of_item(found: DataFrame, k: int) -> DataFrame:
    at = F.row_number().over(W.partitionBy("item_id").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last()))
    return found.withColumn("rank", at).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")
