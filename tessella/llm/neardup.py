"""MinHash near-duplicates by a chosen-path set similarity join.

Documents become sets of word shingles. Equal sets fall together first; then each of
``trees`` independent trees branches the distinct sets: at every level a set goes to the
children named by its minimum under ``branches`` selected hash functions, so two sets of
similarity J part only with probability (1 - J) ** branches a level. No two levels or trees
share a function: a tree of 4 levels loses a pair of similarity 0.85 with a probability of
0.09 at most, and all four trees with 0.00007 (0.8: 0.16, 0.0007). Nodes with one set end;
nodes of up to ``leaf`` sets are compared exhaustively; larger ones branch again, unless they
keep more than half of their parent or are of the last level: such families of near copies
aren't split by their minima.

A family is compared with one of its sets, its leader, and so is what no branching splits.
Let D be a set's symmetric difference with the leader. A set without a link to the leader
can be linked only to sets whose D shares an item with its own, and shares more than
(|D| - k (size - leader's size)) / 2 of theirs, k = (1 - threshold) / (1 + threshold). So
of each set the rarest items of D suffice as index, and what is in the family without a link
to the leader looks itself up there by all items of its own D: work grows with the family's
differences, not with its pairs. Every link is confirmed on the full sets.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from math import comb

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tessella.llm.common import components, written
from tessella.llm.shingles import chunks, minwise, mixed, shingle_sets
from tessella.operators.bloom import might_hold

TREES, LEVELS, BRANCHES, LEAF = 4, 4, 2, 256
FUNCTIONS = TREES * LEVELS * BRANCHES
#: Minima by which a family's leader is chosen, and members that one task holds beside it.
LEADING, PIECE = 8, 2048
#: Names from here on are those of sets whose doc_id names another set.
OTHER = 1 << 62
#: Columns of the shared-shingle matrix that are multiplied at once.
BLOCK = 4096


def sketches(docs: DataFrame, width: int, functions: int = FUNCTIONS) -> DataFrame:
    """``docs(doc_id, text)`` -> ``doc_id, n, h1, h2, mins``; n, h1, h2 name the set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, texts in chunks(batch.column(1)):
                sets = shingle_sets(texts, width)
                low = minwise(sets, functions)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(at, len(texts)),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array(np.array([s.sum(dtype=np.uint64) for s in sets], np.uint64).view(np.int64)),
                        pa.array(np.array([np.bitwise_xor.reduce(mixed(s)) if len(s) else 0 for s in sets], np.uint64).view(np.int64)),
                        pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1, dtype=np.int32) * functions), pa.array(low.ravel())),
                    ],
                    ["doc_id", "n", "h1", "h2", "mins"],
                )

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n long, h1 long, h2 long, mins array<long>")


def full_sets(docs: DataFrame, width: int) -> DataFrame:
    """``docs(keys, rep, h1, text)`` -> ``key, id, items``: the sorted shingles of each text whose
    own ``h1`` is the one given, once for each of its keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            wanted, keys = batch.column(2).to_numpy(), batch.column(0).to_pylist()
            for at, texts in chunks(batch.column(3)):
                sets = shingle_sets(texts, width)
                right = [i for i, s in enumerate(sets) if s.sum(dtype=np.uint64).view(np.int64) == wanted[at + i]]
                for i in right:  # a set at a time: its keys may be many
                    own = keys[at + i]
                    items = pa.array(np.tile(sets[i].view(np.int64), len(own)))
                    ends = pa.array(np.arange(len(own) + 1, dtype=np.int32) * len(sets[i]))
                    rep = batch.column(1)[at + i].as_py()
                    yield pa.RecordBatch.from_arrays([pa.array(own, pa.int64()), pa.array([rep] * len(own), pa.int64()), pa.ListArray.from_arrays(ends, items)], ["key", "id", "items"])

    return docs.select("keys", "rep", "h1", "text").mapInArrow(run, "key long, id long, items array<long>")


def _sets(docs: DataFrame, reps: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """``key, id, items``: the sets that ``wanted(key long, rep)`` names, once for each key. The
    texts meet only the documents that are wanted."""
    keys = wanted.groupBy("rep").agg(F.collect_set("key").alias("keys"))
    named = written(reps.select("rep", "h1", "owner").join(keys, "rep").select(F.col("owner").alias("doc_id"), "rep", "h1", "keys"), "dup-wanted")
    might = might_hold(named.select("doc_id").distinct(), "doc_id")
    texts = docs if might is None else docs.where(might(F.col("doc_id").cast("long")))
    texts = texts.join(named, "doc_id").withColumn("same", F.xxhash64("text"))
    return full_sets(texts.dropDuplicates(["doc_id", "rep", "same"]), width)


def _runs(batches: Iterator[pd.DataFrame], key: str) -> Iterator[pd.DataFrame]:
    """The rows of each key, of batches in the order of the key."""
    rest = None
    for df in batches:
        if rest is not None:
            df = pd.concat([rest, df], ignore_index=True)
        k = df[key].to_numpy()
        cut = [0, *(np.flatnonzero(k[1:] != k[:-1]) + 1)] if len(df) else [0]
        for a, b in zip(cut[:-1], cut[1:], strict=True):
            yield df.iloc[a:b]
        rest = df.iloc[cut[-1] :]
    if rest is not None and len(rest):
        yield rest


def _forest(linked: np.ndarray) -> tuple[list[tuple[int, int]], np.ndarray]:
    """Edges that join what a boolean matrix links, and each row's label."""
    n = len(linked)
    label, edges = np.full(n, -1), []
    for s in range(n):
        if label[s] < 0:
            label[s], front = s, [s]
            while front:
                x = front.pop()
                new = np.flatnonzero(linked[x] & (label < 0))
                label[new] = s
                edges += [(x, int(y)) for y in new]
                front += new.tolist()
    return edges, label


def least_equal(k: int, threshold: float, miss: float = 1e-5) -> int:
    """The most equal minima of ``k`` that a pair at the threshold falls short of with a
    probability (the binomial tail) of ``miss`` at most."""
    least, tail = 0, 0.0
    while least < k and (tail := tail + comb(k, least) * threshold**least * (1 - threshold) ** (k - least)) <= miss:
        least += 1
    return least


def _clusters(members: DataFrame, threshold: float) -> DataFrame:
    """``members(block, rep, open, n, low)`` -> distinct ``(cluster, rep)``: within each block,
    sets that their sketches may join, one of a pair at least being open. A sketch passes at a
    share of equal minima that a pair at the threshold misses with probability 1e-5 at most
    (the exact binomial tail). ``low`` holds 15 bits of each minimum: that
    lets a few more pass, and none less."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in _runs(batches, "block"):
            if len(df) < 2:
                continue
            ids, n, open_ = df["rep"].to_numpy(), df["n"].to_numpy(), df["open"].to_numpy(bool)
            low = np.stack(df["low"].to_numpy())
            k = low.shape[1]
            least = least_equal(k, threshold)
            near = np.zeros((len(df), len(df)), bool)
            for i in range(len(df)):
                near[i] = ((low == low[i]).sum(1) >= least) & (np.minimum(n, n[i]) >= threshold * np.maximum(n, n[i]) - 1e-9)
            near &= open_[:, None] | open_[None]
            np.fill_diagonal(near, False)
            if not near.any():
                continue
            _, label = _forest(near)
            for c in np.unique(label):
                own = np.sort(ids[label == c])
                if len(own) > 1:
                    name = mixed(own.astype(np.uint64) + np.arange(len(own), dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)).sum(dtype=np.uint64)
                    yield pd.DataFrame({"cluster": np.full(len(own), name.astype(np.int64)), "rep": own})

    sorted_ = members.repartition("block").sortWithinPartitions("block")
    return sorted_.mapInPandas(run, "cluster long, rep long").distinct()


def shared_counts(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections of a few sets, by blocks of a 0/1 matrix product."""
    n = len(sets)
    who = np.repeat(np.arange(n), [len(s) for s in sets])
    _, which, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    many = times > 1
    place = np.cumsum(many) - 1
    keep = many[which]
    who, col = who[keep], place[which[keep]]
    order = np.argsort(col, kind="stable")
    who, col = who[order], col[order]
    out = np.zeros((n, n), np.float64)
    for start in range(0, int(many.sum()), BLOCK):
        a, b = np.searchsorted(col, [start, start + BLOCK])
        m = np.zeros((n, BLOCK), np.float32)
        m[who[a:b], col[a:b] - start] = 1
        out += m @ m.T
    return out


def _merged(clusters: DataFrame, leaf: int) -> DataFrame:
    """``cluster, rep`` with every pair that a cluster holds. The trees find much the same sets
    again and again: clusters that overlap are one where all they hold is a leaf's size at
    most; larger unions stay as the clusters that they are."""
    clusters = written(clusters, "dup-clusters")
    first = clusters.groupBy("cluster").agg(F.min("rep").alias("a"))
    unions = components(clusters.join(first, "cluster").select("a", F.col("rep").alias("b")))
    sizes = unions.groupBy("component").agg(F.count("*").alias("size"))
    at = written(unions.join(sizes, "component").select(F.col("id").alias("rep"), "component", (F.col("size") <= leaf).alias("whole")), "dup-unions")
    parts = clusters.join(at.where("not whole").select("rep"), "rep", "left_semi").select("cluster", "rep")
    return at.where("whole").select(F.xxhash64("component", F.lit(0)).alias("cluster"), "rep").unionByName(parts)


def _confirmed(clusters: DataFrame, docs: DataFrame, reps: DataFrame, width: int, threshold: float) -> DataFrame:
    """Edges ``(a, b)`` from the smallest id of what is linked within each cluster to the
    others of it; the links are confirmed on full sets."""
    clusters = written(clusters, "dup-clusters")
    sets = _sets(docs, reps, clusters.select(F.col("cluster").alias("key"), "rep"), width)
    hundred = round(threshold * 100)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in _runs(batches, "key"):
            ids = df["id"].to_numpy()
            sets = [np.asarray(x).view(np.uint64) for x in df["items"]]
            size = np.array([len(s) for s in sets], float)
            both = shared_counts(sets) if len(sets) > 2 else np.full((2, 2), float(len(np.intersect1d(*sets, assume_unique=True))) if len(sets) == 2 else 0)
            linked = 100 * both >= hundred * (size[:, None] + size[None] - both)
            np.fill_diagonal(linked, False)
            label = _forest(linked)[1]
            for c in np.unique(label):
                own = np.sort(ids[label == c])
                if len(own) > 1:
                    yield pd.DataFrame({"a": own[0], "b": own[1:]})

    return sets.repartition("key").sortWithinPartitions("key").mapInPandas(run, "a long, b long").distinct()


def _led(families: DataFrame, docs: DataFrame, reps: DataFrame, width: int, threshold: float) -> DataFrame:
    """``families(leader, rep, size)`` -> ``leader, rep, n, n_leader, linked, d``: whether a
    member's full set is linked to its leader's, and the items in which they differ. Members
    go by pieces to tasks, each piece with a copy of the leader."""
    pieces = F.ceil(F.col("size") / F.lit(PIECE)).cast("int")
    own = families.select("leader", "rep", F.pmod(F.xxhash64("rep"), pieces).cast("int").alias("piece"), F.lit(1).alias("turn"))
    first = families.groupBy("leader").agg(F.max(pieces).alias("pieces"))
    first = first.select("leader", F.col("leader").alias("rep"), F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)).alias("piece"), F.lit(0).alias("turn"))
    rows = written(first.unionByName(own.where("rep <> leader")).withColumn("key", F.monotonically_increasing_id()), "dup-led")
    placed = rows.join(_sets(docs, reps, rows.select("key", "rep"), width), "key").select("leader", "piece", "turn", "rep", "items")
    hundred = round(threshold * 100)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, best = None, np.zeros(0, np.int64)
        for batch in batches:
            out: list[list] = [[] for _ in range(6)]
            items, offsets = batch.column(4).values.to_numpy(), batch.column(4).offsets.to_numpy()
            for i, (leader, piece, turn, rep) in enumerate(zip(*(batch.column(c).to_pylist() for c in range(4)), strict=True)):
                own = items[offsets[i] : offsets[i + 1]]
                if turn == 0:
                    name, best = (leader, piece), own
                    continue
                assert name == (leader, piece)
                d = np.setxor1d(own, best, assume_unique=True)
                both = (len(own) + len(best) - len(d)) // 2
                for c, x in enumerate((leader, rep, len(own), len(best), 100 * both >= hundred * (len(own) + len(best) - both), d)):
                    out[c].append(x)
            if out[0]:
                ends = pa.array(np.cumsum([0, *map(len, out[5])]).astype(np.int32))
                yield pa.RecordBatch.from_arrays([*(pa.array(x, pa.int64()) for x in out[:4]), pa.array(out[4], pa.bool_()), pa.ListArray.from_arrays(ends, pa.array(np.concatenate(out[5])))], ["leader", "rep", "n", "n_leader", "linked", "d"])

    ordered = placed.repartition("leader", "piece").sortWithinPartitions("leader", "piece", "turn")
    return ordered.mapInArrow(run, "leader long, rep long, n long, n_leader long, linked boolean, d array<long>")


def _leaders(members: DataFrame, reps: DataFrame) -> DataFrame:
    """``members(node, rep)`` -> distinct ``leader, rep, size``: every node is led by the member
    that has most of the node's most frequent minima; nodes of one leader are one family."""
    at = written(members.join(reps.select("rep", F.slice("mins", FUNCTIONS - LEADING + 1, LEADING).alias("low")), "rep"), "dup-members")
    counts = at.select("node", F.posexplode("low").alias("pos", "low")).groupBy("node", "pos", "low").count()
    modes = counts.groupBy("node", "pos").agg(F.max_by("low", F.struct("count", "low")).alias("mode")).groupBy("node").agg(F.sort_array(F.collect_list(F.struct("pos", "mode"))).alias("m"))
    equal = F.aggregate(F.zip_with("low", F.col("m.mode"), lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, x: s + x)
    leaders = at.join(modes, "node").select("node", "rep", equal.alias("equal")).groupBy("node").agg(F.max_by("rep", F.struct("equal", -F.col("rep"))).alias("leader"))
    families = written(members.join(leaders, "node").select("leader", "rep").distinct(), "dup-families")
    return families.join(families.groupBy("leader").agg(F.count("*").alias("size")), "leader")


def _differing(led: DataFrame, threshold: float, leaf: int) -> DataFrame:
    """``block, rep, open``: blocks that hold all pairs of members which may be linked though
    one of them isn't linked to the leader."""
    k = (1 - threshold) / (1 + threshold)
    rest = led.where("not linked").select("leader").distinct()
    items = led.join(rest, "leader", "left_semi").select("leader", "rep", "linked", "n", "n_leader", F.size("d").alias("nd"), F.explode("d").alias("item"))
    # Items that one member alone has stand first in the order of rareness, and join nothing.
    counts = items.groupBy("leader", "item").agg(F.count("*").alias("times")).where("times > 1")
    shared = items.join(counts, ["leader", "item"])
    own = W.partitionBy("leader", "rep")
    needed = F.floor((F.col("nd") - F.lit(k) * (F.col("n") - F.col("n_leader"))) / 2 - F.lit(1e-9)) + 1
    prefix = F.col("nd") - needed + 1 - (F.col("nd") - F.count("*").over(own))
    shared = shared.withColumn("index", F.row_number().over(own.orderBy("times", "item")) <= prefix)
    used = written(shared.where("index or not linked").select("leader", "rep", "item", "index", (~F.col("linked")).alias("open")), "dup-shared")
    groups = used.groupBy("leader", "item").agg(F.count_if("index").alias("n_index"), F.count_if("open").alias("n_open"), F.count("*").alias("n_all")).where("n_index > 0 and n_open > 0 and n_all > 1")
    found = used.join(groups, ["leader", "item"])
    # A frequent item's members are dealt to a grid of blocks: those that look up, by those of the index.
    rows = F.when(F.col("n_all") > leaf, F.ceil(F.col("n_open") / F.lit(leaf))).otherwise(1).cast("int")
    cols = F.when(F.col("n_all") > leaf, F.ceil(F.col("n_index") / F.lit(leaf))).otherwise(1).cast("int")
    upto = lambda n: F.sequence(F.lit(0), n - 1)
    place = lambda n, salt: F.pmod(F.xxhash64("rep", F.lit(salt)), n).cast("int")
    looks = F.when(F.col("open"), F.transform(upto(cols), lambda j: F.struct(place(rows, 1).alias("i"), j.alias("j")))).otherwise(F.array())
    holds = F.when(F.col("index"), F.transform(upto(rows), lambda i: F.struct(i.alias("i"), place(cols, 2).alias("j")))).otherwise(F.array())
    dealt = found.select("leader", "item", "rep", "open", F.inline(F.array_distinct(F.concat(looks, holds))))
    return dealt.select(F.xxhash64("leader", "item", "i", "j").alias("block"), "rep", "open")


def near_duplicates(docs: DataFrame, width: int = 5, threshold: float = 0.8, trees: int = TREES, leaf: int = LEAF) -> DataFrame:
    """``docs(doc_id, text)`` -> ``doc_id, n_shingles, component_id, kept``, one row per row.

    Documents are linked at a Jaccard similarity of ``threshold`` (a whole percentage) or
    more of their sets of ``width``-word shingles (A-Z lower-cased; fewer words: the whole
    sequence as one); ``component_id`` is the smallest doc_id that links reach, and only
    that document is ``kept``. A text without words, or null, is linked with nothing. A
    null doc_id is linked with nothing, has a null component and is kept. Rows that repeat
    a doc_id are one document, linked by each of its texts. Other columns are ignored; no rows
    give no rows.
    """
    if not 1 <= trees <= TREES:
        raise ValueError(f"1 to {TREES} trees")
    docs = docs.select("doc_id", "text")
    marks = written(sketches(docs, width), "dup-sketches")
    full = marks.where("n > 0 and doc_id is not null")
    reps = full.groupBy("n", "h1", "h2").agg(F.min("doc_id").alias("rep"), F.first("mins").alias("mins"))
    # A doc_id that stands for several sets names one of them; the others have names of their own.
    nth = F.row_number().over(W.partitionBy("rep").orderBy("n", "h1", "h2"))
    other = F.xxhash64("n", "h1", "h2").bitwiseAND(F.lit(OTHER - 1)).bitwiseOR(F.lit(OTHER))
    reps = written(reps.select("n", "h1", "h2", "mins", F.col("rep").alias("owner"), F.when(nth == 1, F.col("rep")).otherwise(other).alias("rep")), "dup-reps")
    edges = []
    sides = [f(F.struct("n", "h1", "h2")).alias(x) for f, x in ((F.min, "lo"), (F.max, "hi"))]
    several = written(full.groupBy("doc_id").agg(*sides).where("lo <> hi").select("doc_id"), "dup-several")
    if not several.isEmpty():
        own = full.join(several, "doc_id", "left_semi").select("doc_id", "n", "h1", "h2").distinct().join(reps, ["n", "h1", "h2"])
        edges.append(own.join(own.groupBy("doc_id").agg(F.min("rep").alias("a")), "doc_id").select("a", F.col("rep").alias("b")))

    # Branch: nodes of each level with more than one set; those above the leaf size go on.
    leaves, families, large, above = [], [], None, reps.count()
    for level in range(LEVELS):
        pick = lambda t, i: F.col("mins")[(t * LEVELS + level) * BRANCHES + i]  # noqa: B023, E731
        if level:
            # A tree's own minima travel with what is still to be branched: few rows.
            own = lambda i: F.get("own", F.lit(level * BRANCHES + i))  # noqa: B023, E731
            kids = [F.struct("tree", F.xxhash64("node", F.lit(i), own(i)).alias("node")) for i in range(BRANCHES)]
            named = large.select("rep", "own", F.col("size").alias("above"), F.inline(F.array(*kids)))
        else:
            kids = [F.struct(F.lit(t).alias("tree"), F.xxhash64(F.lit(t), F.lit(i), pick(t, i)).alias("node")) for t in range(trees) for i in range(BRANCHES)]
            named = reps.select("rep", F.lit(above).alias("above"), F.inline(F.array(*kids)))
        named = written(named, "dup-nodes")
        sizes = named.groupBy("node").agg(F.count("*").alias("size")).where("size > 1")
        alive = written(named.join(sizes, "node"), "dup-alive")
        leaves.append(alive.where(F.col("size") <= leaf).select("rep", F.col("node").alias("block"), F.lit(True).alias("open")))
        last = F.lit(level == LEVELS - 1) | (F.col("size") * 2 > F.col("above"))
        families.append(alive.where((F.col("size") > leaf) & last).select("node", "rep"))
        large = alive.where((F.col("size") > leaf) & ~last)
        if large.isEmpty():
            break
        if not level:
            of_tree = F.slice("mins", F.col("tree") * (LEVELS * BRANCHES) + 1, LEVELS * BRANCHES)
            large = written(large.select("rep", "node", "tree", "size").join(reps.select("rep", "mins"), "rep").withColumn("own", of_tree).drop("mins"), "dup-large")
    whole = written(reduce(DataFrame.unionByName, families), "dup-unsplit")
    members = leaves
    if not whole.isEmpty():
        led = written(_led(_leaders(whole, reps), docs, reps, width, threshold), "dup-led")
        edges.append(led.where("linked").select(F.least("leader", "rep").alias("a"), F.greatest("leader", "rep").alias("b")))
        members = [*leaves, _differing(led, threshold, leaf)]
    blocks = reduce(DataFrame.unionByName, members).join(reps.select("rep", "n", F.transform("mins", lambda m: (m % 32768).cast("short")).alias("low")), "rep")
    edges.append(_confirmed(_merged(_clusters(blocks, threshold), leaf), docs, reps, width, threshold))
    labels = components(written(reduce(DataFrame.unionByName, edges), "dup-edges"))

    named = reps.select("n", "h1", "h2", "rep").join(labels.withColumnRenamed("id", "rep"), "rep", "left")
    named = named.select("n", "h1", "h2", F.coalesce("component", "rep").alias("component_id"))
    named = written(named, "dup-named")
    out = marks.select("doc_id", "n", "h1", "h2").join(named, ["n", "h1", "h2"], "left")
    component = F.when(F.col("n") > 0, F.coalesce("component_id", "doc_id")).otherwise(F.col("doc_id"))
    component = F.when(F.col("doc_id").isNotNull(), component)
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def drop_near_duplicates(docs: DataFrame, **options) -> DataFrame:
    """Every row and column of ``docs`` but those of documents that aren't kept."""
    gone = near_duplicates(docs, **options).where("not kept").select("doc_id").distinct()
    return docs.join(written(gone, "dup-gone"), "doc_id", "left_anti").select(docs.columns)
