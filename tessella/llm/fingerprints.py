"""Document fingerprints by consistent weighted sampling, in built-in expressions only.

A text is its words with their counts. For each of ``SAMPLES`` samples a word draws two
Gamma(2, 1) values r and c and a uniform b from its hash; with weight S it stands at
t = floor(ln S / r + b) and bids ln a = ln c - r (t - b + 1). The lowest bid's (word, t) is
the sample, and two texts agree on a sample with probability equal to the generalised
Jaccard similarity of their counts.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import numbered, written

SAMPLES = 48
#: Samples that one row of the aggregation holds; the generated code stays small.
BLOCK = 4
#: How far above its mean the lowest bid of a document may lie before it is drawn in full.
LIKELY = 16.0
#: ASCII white space, as words are told apart by it.
SPACES = " \t\n\x0b\f\r"
#: The hash of a term that no text has; its last bits are 3.
NO_WORD = -1


def _runs(sorted_values: Column) -> Column:
    """array<struct<value, n>>: the distinct values of a sorted array and how often each is there."""

    def counted(h: Column) -> Column:
        n = F.size(h)
        starts = F.filter(F.sequence(F.lit(0), n - 1), lambda i: (i == 0) | (F.get(h, i) != F.get(h, i - 1)))
        ends = F.concat(F.slice(starts, F.lit(2), F.size(starts)), F.array(n))
        return F.zip_with(starts, ends, lambda a, b: F.struct(F.get(h, a).alias("value"), (b - a).cast("double").alias("n")))

    # The sorted values are bound once, not spelled out again for each use.
    return F.flatten(F.transform(F.array(sorted_values), counted))


def _hashed_words(text: Column, mark: int) -> Column:
    """Hashes of all words, with ``mark`` (0 to 3) as last bits."""
    bare = F.btrim(text, F.lit(SPACES))
    words = F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, f"[{SPACES}]+"))
    return F.transform(words, lambda w: F.xxhash64(w).bitwiseAND(F.lit(-4)).bitwiseOR(F.lit(mark)))


def weighted_terms(text: Column) -> Column:
    """array<struct<term long, w0 double>>: the text's words, hashed, with their counts.
    A text without words has one term of its own."""

    def counted(h: Column) -> Column:
        runs = _runs(F.sort_array(F.when(F.size(h) > 0, h).otherwise(F.array(F.lit(3).cast("long")))))
        return F.transform(runs, lambda r: F.struct(r["value"].alias("term"), r["n"].alias("w0")))

    return F.flatten(F.transform(F.array(_hashed_words(text, 3)), counted))


def marked_words(both: Column, one: Column, other: Column) -> Column:
    """struct<n int, words array<long>>: the words of two texts, hashed, one entry an occurrence,
    whose last bits say where it stands: in both texts (0), in the first (1) or in the second (2);
    and n, the words of the shorter. ``NO_WORD`` (3) stands in neither. The texts are ``both`` + ``one`` and ``both`` + ``other``;
    ``both`` is empty or ends with white space. A text without words has one word of its own."""

    def joined(both: Column, one: Column, other: Column) -> Column:
        n = F.size(both) + F.least(F.size(one), F.size(other))
        return F.struct(n.alias("n"), F.concat(both, one, other, F.array(F.lit(NO_WORD).cast("long"))).alias("words"))

    none = lambda h, part, mark: F.when(F.size(h["both"]) + F.size(part) == 0, F.array(F.lit(mark).cast("long"))).otherwise(part)
    hashed = F.struct(_hashed_words(both, 0).alias("both"), _hashed_words(one, 1).alias("one"), _hashed_words(other, 2).alias("other"))
    # The hashed words are bound once, not spelled out again for each use.
    whole = F.transform(F.array(hashed), lambda h: F.struct(h["both"].alias("both"), none(h, h["one"], 1).alias("one"), none(h, h["other"], 2).alias("other")))
    return F.get(F.transform(whole, lambda h: joined(h["both"], h["one"], h["other"])), F.lit(0))


def counted_words(texts: DataFrame, keys: list[str]) -> DataFrame:
    """``texts(*keys, copies, both, one, other)`` -> ``*keys, n, term, w0, w1``: the distinct
    words of two texts (see ``marked_words``) with their counts in each (0 where a text hasn't
    the word), and n, the words of the shorter. ``copies`` equal rows are one document. Each
    document has a term without weight, see ``_least_bids``.

    Words are counted by an aggregation: a lambda of the array functions is interpreted for
    every word, an aggregation is compiled.
    """
    words = texts.select(*keys, "copies", marked_words(F.col("both"), F.col("one"), F.col("other")).alias("words"))
    words = words.select(*keys, "copies", "words.n", F.explode("words.words").alias("word"))
    mark = F.col("word").bitwiseAND(F.lit(3))
    words = words.select(*keys, "copies", "n", F.col("word").bitwiseOR(F.lit(3)).alias("term"), F.when(mark < 2, 1).otherwise(0).alias("in0"), F.when(mark.isin(0, 2), 1).otherwise(0).alias("in1"))
    counts = words.groupBy(*keys, "copies", "n", "term").agg(F.sum("in0").alias("w0"), F.sum("in1").alias("w1"))
    return counts.select(*keys, "n", "term", *[(F.col(w) / F.col("copies")).alias(w) for w in ("w0", "w1")])


def _bid(term: Column, log_weight: Column, r: Column, log_c: Column, b: Column) -> Column:
    """A word's bid for a sample: the bid in the high half, the mark of the word and its t in
    the low half. A null weight or draw makes no bid."""
    t = F.floor(log_weight / r + b)
    mark = term.bitwiseXOR(t).bitwiseAND(F.lit(0xFFFFFFFF))
    return F.shiftleft(((log_c - r * (t - b + 1.0) + 128.0) * F.lit(2.0**23)).cast("long"), 32).bitwiseOR(mark)


def _least_bids(terms: DataFrame, keys: list[str], weights: list[str], samples: int, reach: Column | None) -> DataFrame:
    """``terms(*keys, term, *weights)`` -> ``*keys, sure``, and for each weight ``m_<weight>
    array<int>``, the marks of the lowest bids.

    With r = -ln p and c = -ln q a bid is ln a, a >= c p / weight >= (1 - q) p / weight; so
    where that is beyond ``reach`` (a bound on a), the draw's logarithms are left out, and a
    block whose draws are all beyond it isn't aggregated. ``sure`` says that all lowest bids are
    within reach, so that no bid left out can be lower. A term without weight makes no bid, but
    its blocks stay: with one, no document is lost.
    """
    unit = lambda x, at: (F.shiftrightunsigned(x, at).bitwiseAND(F.lit((1 << 26) - 1)) + F.lit(0.5)) * F.lit(2.0**-26)
    ks, own = range(BLOCK), [*keys, "block", "term", "reach", *[f"log_{w}" for w in weights]]
    heaviest = F.greatest(*weights) if len(weights) > 1 else F.col(weights[0])
    rows = terms.withColumn("reach", F.lit(None).cast("double") if reach is None else reach).withColumn("within", F.col("reach") * heaviest)
    rows = rows.select(*keys, "term", "reach", "within", *[F.log(w).alias(f"log_{w}") for w in weights], F.explode(F.array(*[F.lit(i) for i in range(-(-samples // BLOCK))])).alias("block"))
    rows = rows.withColumn("seed", F.xxhash64("term", "block")).withColumns({f"h{k}": F.xxhash64("seed", F.lit(k)) for k in ks}).withColumns({f"g{k}": F.xxhash64(f"h{k}") for k in ks})
    draws = {f"{x}{k}": unit(F.col(f"{h}{k}"), 0) * unit(F.col(f"{h}{k}"), 26) for k in ks for x, h in (("p", "h"), ("q", "g"))}
    rows = rows.withColumns(draws | {f"b{k}": (F.shiftrightunsigned(F.col(f"h{k}"), 52) + F.lit(0.5)) * F.lit(2.0**-12) for k in ks})
    on = lambda k: F.col("within").isNull() | ((1.0 - F.col(f"q{k}")) * F.col(f"p{k}") <= F.col("within"))
    # The partition's number, which isn't deterministic, keeps Spark from moving the filter below
    # the draws, where it would hash all again for each use.
    bids = reduce(lambda x, y: x | y, [on(k) for k in ks]) | reduce(lambda x, y: x & y, [F.col(f"log_{w}").isNull() for w in weights])
    rows = rows.withColumn("part", F.spark_partition_id()).where(bids | (F.col("part") < 0))
    rows = rows.select(*own, *[c for k in ks for c in (F.when(on(k), -F.log(f"p{k}")).alias(f"r{k}"), F.when(on(k), F.log(-F.log(f"q{k}"))).alias(f"c{k}"), F.col(f"b{k}"))])
    least = [F.min(_bid(F.col("term"), F.col(f"log_{w}"), F.col(f"r{k}"), F.col(f"c{k}"), F.col(f"b{k}"))).alias(f"{w}_{k}") for k in ks for w in weights]
    found = rows.groupBy(*keys, "block").agg(*least, F.min("reach").alias("reach"))
    low = lambda c: F.shiftright(F.shiftleft(F.col(c), 32), 32).cast("int")
    most = F.floor((F.log("reach") + 128.0) * F.lit(2.0**23)).cast("long") - 1
    used = lambda k: F.lit(True) if samples % BLOCK == 0 else F.col("block") * BLOCK + k < samples
    sure = reduce(lambda x, y: x & y, [~used(k) | F.coalesce(F.shiftright(f"{w}_{k}", 32) <= most, F.lit(False)) for w in weights for k in ks])
    marks = [F.array(*[low(f"{w}_{k}") for k in ks]).alias(w) for w in weights]
    blocks = found.select(*keys, (F.col("reach").isNull() | sure).alias("sure"), F.struct("block", *marks).alias("b"))
    found = blocks.groupBy(*keys).agg(F.sort_array(F.collect_list("b")).alias("b"), F.bool_and("sure").alias("sure"))
    return found.select(*keys, "sure", *[F.slice(F.flatten(F.col(f"b.{w}")), 1, samples).alias(f"m_{w}") for w in weights])


def _marked(rows: Callable[[DataFrame | None], DataFrame], keys: list[str], weights: list[str], samples: int) -> DataFrame:
    """``*keys``, and for each weight ``m_<weight> array<int>``, the marks of the lowest bids of
    ``rows(left)(*keys, n, term, *weights)``: the terms of all documents, or of those whose keys
    are in ``left``. Of n words the lowest a is over LIKELY / n once in exp(LIKELY); such
    documents are drawn again in full, and only their texts are read into terms again."""
    first = written(_least_bids(rows(None), keys, weights, samples, F.lit(LIKELY) / F.col("n")), "prints")
    if first.where("not sure").isEmpty():
        return first.drop("sure")
    left = written(first.where("not sure").select(*keys), "prints-left")
    again = written(_least_bids(rows(left), keys, weights, samples, None), "prints-in-full")
    return first.where("sure").unionByName(again).drop("sure")


def _among(rows: DataFrame, left: DataFrame | None, keys: list[str]) -> DataFrame:
    """The rows whose keys are in ``left``, a null key being a key; without it all of them."""
    if left is None:
        return rows
    left = left.select(*[F.col(k).alias(f"__{k}") for k in keys]).distinct()
    return rows.join(left, reduce(lambda x, y: x & y, [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys]), "left_semi")


def fingerprints(texts: DataFrame, keys: list[str], text: str = "text", samples: int = SAMPLES) -> DataFrame:
    """``texts(*keys, text)`` -> ``*keys, marks array<int>``, one row per distinct key, with
    ``samples`` marks.

    Rows that share their keys are one document, whose terms' bids all count; a null key is a
    key. A null or empty text, or one of white space, has a fingerprint of its own that only
    such texts share. Texts are read whole, long ones too. Other columns are ignored; keys may
    not have the names of the columns used here. No rows give no rows. Bids of a partition are
    aggregated before any shuffle.
    """

    def rows(left: DataFrame | None) -> DataFrame:
        arrays = _among(texts.select(*keys, text), left, keys).select(*keys, weighted_terms(F.coalesce(F.col(text), F.lit(""))).alias("terms"))
        none = F.array(F.struct(F.lit(NO_WORD).cast("long").alias("term"), F.lit(0.0).alias("w0")))
        return arrays.select(*keys, F.size("terms").alias("n"), F.concat("terms", none).alias("terms")).select(*keys, "n", F.inline("terms"))

    return _marked(rows, keys, ["w0"], samples).withColumnRenamed("m_w0", "marks")


def likeness(a: Column, b: Column) -> Column:
    """Share of samples on which two fingerprints agree."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, x: s + x) / F.size(a)


def as_text(marks: Column) -> Column:
    return F.array_join(F.transform(marks, lambda x: F.lpad(F.hex(x.cast("long").bitwiseAND(F.lit(0xFFFFFFFF))), 8, "0")), "")


def with_next(docs: DataFrame) -> DataFrame:
    """``docs(k, h, doc_id, n_chars, text)`` -> one row for each distinct (k, h), which are
    equal rows: ``i, k, h, doc_id, n_chars, copies, next_i, next_k, next_h``. The order is
    descending doc_id (null last), then h; the last is followed by the first."""
    distinct = docs.groupBy("k", "h").agg(F.max("doc_id").alias("doc_id"), F.max("n_chars").alias("n_chars"), F.count("*").alias("copies"))
    order = written(numbered(distinct, [F.col("doc_id").desc_nulls_last(), F.col("h")], "i"), "print-order")
    n = order.count()
    after = order.select(((F.col("i") + F.lit(n) - 1) % F.lit(max(n, 1))).alias("i"), F.col("i").alias("next_i"), F.col("k").alias("next_k"), F.col("h").alias("next_h"))
    return written(order.join(after, "i"), "print-next")


def edited_texts(texts: DataFrame, nexts: DataFrame) -> DataFrame:
    """``texts(k, h, text)`` of all documents and the rows of ``with_next`` that are wanted ->
    ``k, h, i, again, n_chars, sha, copies, both, one, other``: a text is ``both`` + ``one``, its
    edited text ``both`` + ``other``, of digest ``sha``. Where there are copies, ``again`` is 1
    for those that an equal row follows. Each row is there as often as its copies."""
    third = F.floor(F.col("n_chars") / 3).cast("int")
    # The texts are shuffled once by (k, h): both joins and the aggregation share that exchange.
    lent = texts.join(nexts.select(F.col("next_k").alias("k"), F.col("next_h").alias("h"), F.col("k").alias("to_k"), F.col("h").alias("to_h"), "i", "n_chars", "copies"), ["k", "h"])
    lent = lent.select(F.col("to_k").alias("k"), F.col("to_h").alias("h"), "i", "n_chars", "copies", F.substring("text", F.lit(1), third).alias("tail"))
    lent = lent.dropDuplicates(["k", "h", "i"])
    own = F.struct(F.lit(1).alias("again"), F.substring("text", F.lit(1), third).alias("tail"))
    ends = F.when(F.col("copies") > 1, F.array(F.struct(F.lit(0).alias("again"), F.col("tail")), own)).otherwise(F.array(F.struct(F.lit(0).alias("again"), F.col("tail"))))
    edited = texts.join(lent, ["k", "h"]).select("k", "h", "i", "n_chars", "copies", "text", F.inline(ends))
    # What an edited text keeps, up to its last white space, is hashed once for both texts. The
    # digest stands below the explosion of words, so it is taken once a document.
    edited = edited.withColumn("kept", F.substring("text", F.lit(1), (F.col("n_chars") - third).cast("int")))
    edited = edited.select("k", "h", "i", "again", "n_chars", "copies", F.sha2(F.concat("kept", "tail").cast("binary"), 256).alias("sha"), "text", "kept", "tail", F.regexp_extract("kept", f"^(?s:.*[{SPACES}])", 0).alias("both"))
    rest = lambda t: F.substring(t, F.length("both") + 1, F.length(t))
    return edited.select("k", "h", "i", "again", "n_chars", "sha", "copies", "both", rest(F.col("text")).alias("one"), F.concat(rest(F.col("kept")), F.col("tail")).alias("other"))


def edited_report(docs: DataFrame, samples: int = SAMPLES) -> DataFrame:
    """``docs(doc_id, text)`` -> ``doc_id, n_chars, edited_sha256, fingerprint,
    edited_fingerprint, near_edited, near_next``: fingerprints of every text and of its edited
    text, whose last third is replaced by the beginning of the next document (the first, after
    the last), and their likenesses.

    One row per row. Documents follow each other by descending doc_id, rows without one last,
    rows of one doc_id by a hash of their texts; so of equal rows each but one is followed by
    an equal row. A null text is the empty text. Other columns are ignored, whatever their
    names; a single row is followed by itself; no rows give no rows.
    """
    text = F.coalesce("text", F.lit(""))
    docs = docs.select("doc_id", text.alias("text")).withColumns({"k": F.coalesce("doc_id", F.lit(0).cast("long")), "h": F.xxhash64("text", F.col("doc_id").isNull()), "n_chars": F.length("text").cast("long")})
    nexts = with_next(docs)
    keys = ["k", "h", "i", "again", "n_chars", "sha"]

    def rows(left: DataFrame | None) -> DataFrame:
        few = nexts if left is None else written(_among(nexts, left, ["i"]), "print-again")
        return counted_words(_among(edited_texts(docs.select("k", "h", "text"), few), left, keys), keys)

    prints = _marked(rows, keys, ["w0", "w1"], samples)
    after = prints.where("again = 0").select(F.col("i").alias("next_i"), F.col("m_w0").alias("next_marks"))
    after = nexts.select("i", "doc_id", "copies", "next_i").join(after, "next_i").select("i", "doc_id", "copies", "next_marks")
    out = prints.join(after, "i").withColumn("next_marks", F.when(F.col("again") == 1, F.col("m_w0")).otherwise(F.col("next_marks")))
    rows = F.when(F.col("again") == 1, F.col("copies") - 1).otherwise(F.lit(1).cast("long"))
    return out.select(
        "doc_id",
        "n_chars",
        F.col("sha").alias("edited_sha256"),
        as_text(F.col("m_w0")).alias("fingerprint"),
        as_text(F.col("m_w1")).alias("edited_fingerprint"),
        likeness(F.col("m_w0"), F.col("m_w1")).alias("near_edited"),
        likeness(F.col("m_w0"), F.col("next_marks")).alias("near_next"),
        F.explode(F.sequence(F.lit(1).cast("long"), rows)).alias("row"),
    ).drop("row")
