"""Similarities of all pairs of sparse profiles, in meetings of two parts.

Profiles are laid in parts, those with the same strong column side by side. Only parts that
share a column meet, and a task holds two of them as arrays: what leaves it are the pairs, or
just a summary, the few best, or the pairs that were asked for. The products of single cells,
many to a pair, are added up where they arise and never shuffled.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella.sources.scratch import in_order, running, written

#: Profiles and cells of a part, cells of a block of pairs, and products held at once.
PART, MOST, CELLS, PRODUCTS = 8192, 1_500_000, 1_000_000, 1_000_000
#: A column with more products than this share of a block's cells is multiplied as a matrix.
DENSE = 64
#: Bits that hold a place in a part, beside a score.
PLACE = 24


def half_away(c: Column, digits: int) -> Column:
    """Round as SQL engines do with doubles: the scaled double, halves away from zero."""
    return F.round(c * F.lit(10.0**digits)) / F.lit(10.0**digits)


def to_units(x: np.ndarray, digits: int) -> np.ndarray:
    """The same as whole numbers of the last digit (not yet cast)."""
    scaled = np.abs(x) * 10.0**digits
    whole = np.floor(scaled)
    return np.copysign(whole + (scaled - whole >= 0.5), x)


@dataclass(frozen=True)
class Layer:
    """``cells(id, k, x)`` and how two profiles of them are held together: ``cosine``,
    ``jaccard`` (of the columns; x doesn't count) or ``masked`` (cosine over the shared cells, of
    ``least`` at least). Values are rounded to ``digits``, if given."""

    cells: DataFrame
    kind: str
    digits: int | None = 6
    least: int = 3


class _Held:
    """One layer of a block: values (NaN without one) and what they are made of."""

    def __init__(self, kind: str, digits: int | None, least: int, sums: dict, na: np.ndarray, nb: np.ndarray, upper: np.ndarray | None):
        self.digits, n = digits, sums["n"]
        self.known = n > 0 if upper is None else (n > 0) & upper
        with np.errstate(divide="ignore", invalid="ignore"):
            if kind == "jaccard":
                value = n / (na[:, None] + nb[None, :] - n)
            elif kind == "cosine":
                norms = na[:, None] * nb[None, :]
                value = np.where(norms > 0, sums["xy"] / norms, 0.0)
            else:
                zero = (sums["xx"] <= 0) | (sums["yy"] <= 0)
                self.degenerate = (n >= least) & zero
                value = np.where((n >= least) & ~zero, sums["xy"] / np.sqrt(sums["xx"] * sums["yy"]), np.nan)
        if digits is not None:
            value = to_units(value, digits) / 10.0**digits
        self.overlap, self.value, self.sizes = n, np.where(self.known, value, np.nan), (na, nb)


@dataclass
class Block:
    """Some rows of one part beside all rows of another: ``layers`` by name. ``same``: both are
    one part; ``at`` is the place of the first row."""

    ids: np.ndarray
    others: np.ndarray
    at: int
    same: bool
    layers: dict[str, _Held]


def _flat(lists: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    arrays = [a for a in lists.chunks if len(a)]
    size = np.concatenate([np.diff(a.offsets.to_numpy()) for a in arrays]) if arrays else np.zeros(0, int)
    values = np.concatenate([a.flatten().to_numpy(zero_copy_only=False) for a in arrays]) if arrays else np.zeros(0)
    return np.repeat(np.arange(len(size)), size), values


class _Side:
    """A part: its ids in order, and for each layer the cells by row, by column, and the sizes."""

    def __init__(self, rows: pa.Table, n: int):
        self.ids = np.unique(rows["id"].to_numpy())
        self.layers = []
        for i in range(n):
            own = rows.filter(pc.equal(rows["layer"], i))
            at = np.searchsorted(self.ids, own["id"].to_numpy())
            r, k = _flat(own["ks"])
            _, x = _flat(own["xs"])
            r, k = at[r], k.astype(np.int64)
            x = x.astype(float) if len(x) else np.ones(len(k))
            size = np.zeros(len(self.ids))
            size[at] = own["size"].to_numpy()
            by_row = np.lexsort((k, r))
            r, k, x = r[by_row], k[by_row], x[by_row]
            by_column = np.argsort(k, kind="stable")
            self.layers.append((r, k, x, size, by_column))


def _add(sums: dict, row: np.ndarray, low: np.ndarray, times: np.ndarray, x: np.ndarray, t: np.ndarray, tx: np.ndarray, width: int) -> None:
    """Add the products of cells with those at ``low`` and after, a few at a time."""
    upto = np.cumsum(times)
    at = 0
    while at < len(times):
        end = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + PRODUCTS, side="right")))
        s, n = slice(at, end), times[at:end]
        if total := int(n.sum()):
            post = np.repeat(low[s] - np.cumsum(n) + n, n) + np.arange(total)
            cell = np.repeat(row[s] * width, n) + t[post]
            most = len(sums["n"])
            sums["n"] += np.bincount(cell, minlength=most)
            if "xy" in sums:
                mine, his = np.repeat(x[s], n), tx[post]
                sums["xy"] += np.bincount(cell, weights=mine * his, minlength=most)
                if "xx" in sums:
                    sums["xx"] += np.bincount(cell, weights=mine * mine, minlength=most)
                    sums["yy"] += np.bincount(cell, weights=his * his, minlength=most)
        at = end


def _sums(kind: str, a: tuple, b: tuple, lo: int, hi: int, width: int) -> dict:
    """Over the shared columns of rows lo..hi of a and all of b: ``n``, and products ``xy``,
    ``xx``, ``yy`` as the kind needs them."""
    r, k, x, _, _ = a
    s = slice(*np.searchsorted(r, [lo, hi]))
    r, k, x = r[s] - lo, k[s], x[s]
    br, bk, bx, _, order = b
    t, tk, tx = br[order], bk[order], bx[order]
    height = hi - lo
    names = {"jaccard": ("n",), "cosine": ("n", "xy"), "masked": ("n", "xy", "xx", "yy")}[kind]
    sums = {name: np.zeros(height * width) for name in names}
    columns, place, mine = np.unique(k, return_inverse=True, return_counts=True)
    low, high = np.searchsorted(tk, columns), np.searchsorted(tk, columns, side="right")
    full = mine * (high - low) * DENSE > height * width
    rest = ~full[place]
    _add(sums, r[rest], low[place[rest]], (high - low)[place[rest]], x[rest], t, tx, width)
    wide = np.flatnonzero(full)
    for at in range(0, len(wide), 256):
        some = wide[at : at + 256]
        column = np.full(len(columns), -1)
        column[some] = np.arange(len(some))
        here = column[place] >= 0
        his = np.concatenate([np.arange(low[c], high[c]) for c in some])
        of = np.repeat(np.arange(len(some)), (high - low)[some])

        def matrix(rows: np.ndarray, of: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
            out = np.zeros((n, len(some)))  # noqa: B023
            np.add.at(out, (rows, of), values)
            return out

        left = lambda v: matrix(r[here], column[place[here]], v[here], height)  # noqa: B023, E731
        right = lambda v: matrix(t[his], of, v[his], width).T  # noqa: B023, E731
        one, other = left(np.ones(len(x))), right(np.ones(len(tx)))
        sums["n"] += (one @ other).ravel()
        if "xy" in sums:
            sums["xy"] += (left(x) @ right(tx)).ravel()
        if "xx" in sums:
            sums["xx"] += (left(x * x) @ other).ravel()
            sums["yy"] += (one @ right(tx * tx)).ravel()
    return {name: v.reshape(height, width) for name, v in sums.items()}


def _blocks(a: _Side, b: _Side, same: bool, kinds: list[tuple], whole: bool) -> Iterator[Block]:
    width = len(b.ids)
    step = max(1, CELLS // max(1, width))
    for lo in range(0, len(a.ids) if width else 0, step):
        hi = min(lo + step, len(a.ids))
        upper = None
        if same:
            place = np.arange(lo, hi)[:, None]
            upper = np.arange(width)[None, :] != place if whole else np.arange(width)[None, :] > place
        held = {name: _Held(kind, digits, least, _sums(kind, a.layers[i], b.layers[i], lo, hi, width), a.layers[i][3][lo:hi], b.layers[i][3], upper) for i, (name, kind, digits, least) in enumerate(kinds)}
        yield Block(a.ids[lo:hi], b.ids, lo, same, held)


def _numbered(df: DataFrame, c: str) -> tuple[DataFrame, DataFrame | None]:
    """Whole numbers in place of a column that has none, in its order, and what they stand for."""
    if isinstance(df.schema[c].dataType, (T.LongType, T.IntegerType, T.ShortType, T.ByteType)):
        return df.withColumn(c, F.col(c).cast("long")), None
    codes = written(in_order(df.select(F.col(c).alias("__name")).distinct(), [F.col("__name")], "__code"), "codes")
    return df.join(codes, F.col(c) == F.col("__name")).withColumn(c, F.col("__code")).drop("__name", "__code"), codes


def _visits(shared: DataFrame, n: int) -> DataFrame:
    """``pa, pb`` (pa <= pb): the parts of ``n`` that meet, from ``shared(parts)``: lists of the
    parts that hold a column. A task folds its lists into a table of all parts by all."""

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met = np.zeros((n, n), bool)
        for batch in batches:
            for parts in batch.column(0):
                own = parts.values.to_numpy()
                met[own[:, None], own[None, :]] = True
        a, b = np.nonzero(np.triu(met))
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["pa", "pb"])

    return shared.mapInArrow(fold, "pa long, pb long").distinct()


def meet(layers: dict[str, Layer], reducer: Callable, schema: str, whole: bool = False, wanted: DataFrame | None = None, by: tuple[str, ...] | None = None, part: int | None = None) -> tuple[DataFrame, T.DataType, DataFrame | None]:
    """What ``reducer(asked)`` makes of the meetings: it gives a function that takes a block
    and yields tables, then is called with None for what is left. ``by``: the layers whose
    columns make parts meet (all, if not given; with ``wanted``, its pairs do). With ``whole``, a part that meets itself has both
    halves. ``wanted(src, dst)`` reaches the reducer of its meeting as ``asked(src, dst)``.
    Also given: the type of the ids, and what whole numbers stand for where they aren't."""
    by = by or tuple(layers)
    kind, codes = next(iter(layers.values())).cells.schema["id"].dataType, None
    cells = [layer.cells.select("id", "k", F.lit(i).alias("layer"), (F.col("x").cast("double") if layer.kind != "jaccard" else F.lit(1.0)).alias("x"), F.lit(name in by).alias("by")).where("id is not null and k is not null") for i, (name, layer) in enumerate(layers.items())]
    if not isinstance(kind, (T.LongType, T.IntegerType, T.ShortType, T.ByteType)):
        every = cells[0].select("id")
        for c in cells[1:]:
            every = every.union(c.select("id"))
        codes = written(in_order(every.distinct(), [F.col("id")], "__code").withColumnRenamed("id", "__name"), "ids")
        coded = lambda df, c: df.join(codes, F.col(c) == F.col("__name")).withColumn(c, F.col("__code")).drop("__name", "__code")
        cells = [coded(c, "id") for c in cells]
        wanted = wanted if wanted is None else coded(coded(wanted, "src"), "dst")
    cells = [_numbered(c, "k")[0].withColumn("id", F.col("id").cast("long")) for c in cells]
    rows = None
    for c, layer in zip(cells, layers.values()):
        size = F.count("*").cast("double") if layer.kind == "jaccard" else F.coalesce(F.sqrt(F.sum(F.col("x") * F.col("x"))), F.lit(0.0))
        sorted_ = F.sort_array(F.collect_list(F.struct("k", F.coalesce("x", F.lit(0.0)).alias("x"))))
        xs = F.array().cast("array<double>") if layer.kind == "jaccard" else F.col("p.x")
        own = c.groupBy("id", "layer", "by").agg(sorted_.alias("p"), size.alias("size"), F.max_by("k", F.struct("x", "k")).alias("first")).select("id", "layer", "by", F.col("p.k").alias("ks"), xs.alias("xs"), "size", "first")
        rows = own if rows is None else rows.unionByName(own)
    rows = written(rows, "profiles")
    ids = rows.groupBy("id").agg(F.min_by("first", F.struct(~F.col("by"), "layer")).alias("first"), F.sum(F.size("ks")).alias("cells"))
    placed = running(ids, [], [F.col("first"), F.col("id")], {"at": F.lit(1).cast("long"), "before": F.col("cells").cast("long")})
    parts = written(placed.select("id", (F.floor(F.col("at") / (part or PART)) + F.floor(F.col("before") / MOST)).alias("part")), "parts")
    rows = rows.join(parts, "id")
    if wanted is None:
        lists = rows.where("by").select("part", "layer", F.explode("ks").alias("k")).groupBy("layer", "k").agg(F.sort_array(F.collect_set("part")).alias("parts")).select("parts").distinct()
        count = 1 + (parts.agg(F.max("part")).first()[0] or 0)
        visits = written(_visits(lists, count), "meetings")
    else:
        place = lambda c: parts.select(F.col("id").alias(c), F.col("part").alias(f"__{c}"))
        ask = wanted.select(F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst")).distinct().join(place("src"), "src").join(place("dst"), "dst")
        ask = written(ask.select(F.least("__src", "__dst").alias("pa"), F.greatest("__src", "__dst").alias("pb"), "src", "dst", (F.col("__src") > F.col("__dst")).alias("turned")), "asked")
        visits = written(ask.select("pa", "pb").distinct(), "meetings")
    there = visits.select(F.col("pa").alias("part"), "pa", "pb", F.lit(True).alias("here")).unionByName(visits.where("pa <> pb").select(F.col("pb").alias("part"), "pa", "pb", F.lit(False).alias("here")))
    sent = rows.join(there, "part").select("pa", "pb", "here", "id", "layer", "ks", "xs", "size")
    kinds = [(name, x.kind, x.digits, x.least) for name, x in layers.items()]
    out = pa.schema([pa.field(f.name, {"long": pa.int64(), "double": pa.float64(), "boolean": pa.bool_(), "string": pa.string()}[{"bigint": "long"}.get(f.dataType.simpleString(), f.dataType.simpleString())]) for f in T._parse_datatype_string(schema).fields])

    def run(met: pa.Table, asked: pa.Table | None) -> pa.Table:
        own, other = met.filter(met["here"]), met.filter(pc.invert(met["here"]))
        found, step = [], reducer(asked)
        if len(met):
            a = _Side(own, len(kinds))
            same = not len(other)
            b = a if same else _Side(other, len(kinds))
            for block in _blocks(a, b, same, kinds, whole):
                found += step(block)
        found += step(None)
        return pa.concat_tables([out.empty_table(), *[pa.table({f.name: pa.array(x[f.name], f.type, from_pandas=True) for f in out}) for x in found]])

    if wanted is None:
        done = sent.groupBy("pa", "pb").applyInArrow(lambda met: run(met, None), schema)
    else:
        done = sent.groupBy("pa", "pb").cogroup(ask.groupBy("pa", "pb")).applyInArrow(run, schema)
    return done, kind, codes


def _named(found: tuple[DataFrame, T.DataType, DataFrame | None]) -> DataFrame:
    """Ids as they were."""
    df, kind, codes = found
    for c in ("src", "dst"):
        if codes is not None:
            df = df.join(codes, F.col(c) == F.col("__code")).withColumn(c, F.col("__name")).drop("__name", "__code")
        else:
            df = df.withColumn(c, F.col(c).cast(kind))
    return df


def _columns(layers: dict[str, Layer]) -> str:
    return ", ".join(f"{name} double" + (f", {name}_overlap long, {name}_degenerate boolean" if x.kind == "masked" else f", {name}_shared long, {name}_least long" if x.kind == "jaccard" else "") for name, x in layers.items())


def _at(block: Block, layers: dict[str, str], r: np.ndarray, c: np.ndarray) -> dict:
    out = {}
    for name, kind in layers.items():
        held = block.layers[name]
        known = held.known[r, c]
        out[name] = held.value[r, c]
        if kind != "cosine":
            out[f"{name}_{'overlap' if kind == 'masked' else 'shared'}"] = np.where(known, held.overlap[r, c], np.nan)
        if kind == "jaccard":
            out[f"{name}_least"] = np.where(known, np.minimum(held.sizes[0][r], held.sizes[1][c]), np.nan)
        if kind == "masked":
            out[f"{name}_degenerate"] = held.degenerate[r, c] & known
    return out


def all_pairs(layers: dict[str, Layer], by: tuple[str, ...] | None = None) -> DataFrame:
    """``src, dst`` and the values of each layer (null without one), for the pairs that share a
    column of a layer of ``by``, each once, the smaller id first."""
    kinds, least = {n: x.kind for n, x in layers.items()}, by or tuple(layers)

    def reducer(asked):
        def step(block):
            if block is None:
                return []
            r, c = np.nonzero(np.logical_or.reduce([block.layers[n].known for n in least]))
            a, b = block.ids[r], block.others[c]
            return [{"src": np.minimum(a, b), "dst": np.maximum(a, b), **_at(block, kinds, r, c)}]

        return step

    return _named(meet(layers, reducer, f"src long, dst long, {_columns(layers)}", by=by))


def pair_values(layers: dict[str, Layer], wanted: DataFrame) -> DataFrame:
    """``src, dst`` and the values of each layer for the wanted pairs ``(src, dst)`` that share a
    column of a layer, either way round."""
    kinds = {n: x.kind for n, x in layers.items()}

    def reducer(asked):
        src, dst, turned = (asked[c].to_numpy() for c in ("src", "dst", "turned"))
        first, second = np.where(turned, dst, src), np.where(turned, src, dst)

        def step(block):
            if block is None or not len(src):
                return []
            r, c = np.searchsorted(block.ids, first), np.searchsorted(block.others, second)
            here = (r < len(block.ids)) & (c < len(block.others))
            here[here] = (block.ids[r[here]] == first[here]) & (block.others[c[here]] == second[here])
            r, c, s, d = r[here], c[here], src[here], dst[here]
            known = np.logical_or.reduce([h.known[r, c] for h in block.layers.values()])
            r, c = r[known], c[known]
            return [{"src": s[known], "dst": d[known], **_at(block, kinds, r, c)}]

        return step

    return _named(meet(layers, reducer, f"src long, dst long, {_columns(layers)}", whole=True, wanted=wanted))


def nearest(layers: dict[str, Layer], k: int, value: Callable[[Block], np.ndarray], digits: int, by: tuple[str, ...] | None = None, part: int | None = None) -> DataFrame:
    """``src, dst, value, rank``: of each profile the k others of largest ``value`` (of a block;
    NaN counts for nothing), rounded to ``digits``, ties to the smaller id."""
    from tessella.operators.similarity import top_k

    return top_k(best_of(layers, k, {"": value}, digits, by, part).drop("view"), k)


def best_of(layers: dict[str, Layer], k: int, values: dict[str, Callable[[Block], np.ndarray]], digits: int, by: tuple[str, ...] | None = None, part: int | None = None) -> DataFrame:
    """``view, src, dst, value``: for several values at once rows that hold the k nearest of each
    profile, and some more."""
    scale, mask = 10**digits, (1 << PLACE) - 1

    def cut(keys, n):
        return keys if keys.shape[-1] <= n else np.partition(keys, keys.shape[-1] - n, axis=-1)[..., keys.shape[-1] - n :]

    def table(view, keys, ids, others):
        r, c = np.nonzero(keys >= 0)
        found = keys[r, c]
        return {"view": [view] * len(r), "src": ids[r], "dst": others[mask - (found & mask)], "value": ((found >> PLACE) - 2 * scale) / scale}

    def keyed(x, at):
        return np.where(x >= 0, (x << PLACE) | (mask - at), -1)

    def reducer(asked):
        theirs, sides = {}, [None, []]

        def step(block):
            if block is None:
                return [table(view, cut(keys, k), sides[0], np.concatenate(sides[1])) for view, keys in theirs.items()]
            found = []
            sides[0] = block.others
            sides[1].append(block.ids)
            for view, value in values.items():
                v = value(block)
                score = np.where(np.isnan(v), -1, to_units(np.nan_to_num(v), digits).astype(np.int64) + 2 * scale)
                found.append(table(view, cut(keyed(score, np.arange(len(block.others))[None, :]), k), block.ids, block.others))
                if not block.same:
                    # Of each row of the other part the best so far, among the rows met.
                    new = keyed(score.T, (block.at + np.arange(len(block.ids)))[None, :])
                    theirs[view] = cut(np.concatenate([theirs[view], new], axis=1) if view in theirs else new, k)
            return found

        return step

    return _named(meet(layers, reducer, "view string, src long, dst long, value double", whole=True, by=by, part=part))


def value_counts(layers: dict[str, Layer], value: Callable[[Block], np.ndarray], digits: int) -> DataFrame:
    """``value, n``: how many pairs (each once) have a value, rounded to ``digits``."""

    def reducer(asked):
        seen: list = []

        def step(block):
            if block is None:
                if not seen:
                    return []
                units, place = np.unique(np.concatenate([s[0] for s in seen]), return_inverse=True)
                return [{"value": units / 10.0**digits, "n": np.bincount(place, weights=np.concatenate([s[1] for s in seen])).astype(np.int64)}]
            v = value(block)
            v = v[~np.isnan(v)]
            if len(v):
                seen.append(np.unique(to_units(v, digits), return_counts=True))
            return []

        return step

    return meet(layers, reducer, "value double, n long")[0].groupBy("value").agg(F.sum("n").alias("n"))


def summary(layers: dict[str, Layer], told: Callable[[Block], dict[str, float]], schema: str) -> DataFrame:
    """One row of ``told`` for each block of pairs (each pair once); ``schema`` names its figures."""

    def reducer(asked):
        return lambda block: [] if block is None else [{n: [x] for n, x in told(block).items()}]

    return meet(layers, reducer, schema)[0]
